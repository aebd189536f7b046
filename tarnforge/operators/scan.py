"""What is code in a JavaScript or TypeScript source: strings, comments, regular expressions, template texts and markup blanked out, in one pass.

A stack says where the scan is: in code, in a template's text, in a tag or between tags. Code inside of a template or of markup stays code, in parentheses instead of
braces, so it is an expression to whoever looks for blocks. Every character is looked at once; each keeps its place.
"""

from __future__ import annotations

import re

#: Words after which a value starts, so that a slash opens a regular expression and a less-than sign may open a tag (fixed values).
_BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new instanceof yield await default extends".split())
#: Words whose parentheses a statement follows (fixed values).
_CONDITIONS = frozenset("if while for with".split())

_CODE = re.compile(r"""//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|[`/<(){}\[\]]|\+\+|--|[\w$]+|[^\s\w$]""", re.S)
#: A regular expression; parts of at most so many characters keep the scan linear where brackets are left open.
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n]){0,2000}+\]|[^/\\\[\n]){1,4000}+/[a-z]*+")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*+(`|\$\{)?", re.S)
_TAG = re.compile(r"<([A-Za-z_$][\w.:$-]*+)?(?=[\s/>])")
_GENERIC = re.compile(r"<\s*+[\w$]+(?:\s+extends\b[^()=]*|\s*,[^()=]*)?>\s*+\(")
#: Characters within which a tag without an end tag has to show that it is one.
_FAR = 2000
_IN_TAG = re.compile(r"""(?:[^"'{}/>]|/(?!>))*+("[^"]*+"?|'[^']*+'?|\{|/>|>)?""")
_BETWEEN = re.compile(r"[^<{]*+(</[^>]*+>?|<|\{)?")
_DECORATOR = re.compile(r"@[A-Za-z_$][\w$.]*+")
_KEPT = re.compile(r"[^\n]")


class Scan:
    """``code``, the source with all that is not code blanked, and ``notes``, the bounds of its comments."""

    def __init__(self, text: str):
        self.text, self.notes = text, []
        self._out: list[str] = []
        self._done = 0
        self._closing: dict[str, int] = {}
        self._run()
        self._keep(len(text))
        self.code = "".join(self._out)

    def _keep(self, to: int) -> None:
        self._out.append(self.text[self._done : to])
        self._done = to

    def _blank(self, to: int) -> None:
        self._out.append(_KEPT.sub(" ", self.text[self._done : to]))
        self._done = to

    def _put(self, sign: str) -> None:
        """``sign`` instead of the next characters."""
        self._out.append(sign)
        self._done += len(sign)

    def _is_markup(self, at: int) -> bool:
        """Whether the tag at ``at`` is closed somewhere, and so no type parameter or comparison."""
        m = _TAG.match(self.text, at)
        if not m or _GENERIC.match(self.text, at):
            return False
        name = m[1] or ""
        if name not in self._closing:
            self._closing[name] = self.text.rfind(f"</{name}")
        if self._closing[name] > at:
            return True
        far = m.end() + _FAR
        end = _IN_TAG.match(self.text, m.end(), far)
        while end[1] and end[1][0] in "\"'":
            end = _IN_TAG.match(self.text, end.end(), far)
        return end[1] in ("/>", "{")

    def _run(self) -> None:
        text, n, at = self.text, len(self.text), 0
        # Kinds: code in braces, template, tag, between tags; for code, what closes it in the output.
        stack: list[tuple[str, str]] = [("code", "")]
        value = True  # a value may start here
        word = ""  # the word before, if one was
        rounds: list[bool] = []  # of open parentheses: whether a statement follows them
        while at < n:
            kind, close = stack[-1]
            if kind == "template":
                m = _TEMPLATE.match(text, at)
                if m[1] == "${":
                    self._blank(m.end() - 1)
                    self._put("(")
                    stack.append(("code", ")"))
                    value = True
                else:
                    self._blank(m.end())
                    stack.pop()
                    value = False
                at = self._done
                if m[1] is None:
                    return
                continue
            if kind == "tag":
                m = _IN_TAG.match(text, at)
                self._blank(m.end() - (m[1] == "{"))
                if m[1] == "{":
                    self._put("(")
                    stack.append(("code", ")"))
                    value = True
                elif m[1] == "/>":
                    stack.pop()
                    value = False
                elif m[1] == ">":
                    stack[-1] = ("between", "")
                at = self._done
                if m[1] is None and at < n:  # a brace that nothing opened
                    self._blank(at + 1)
                    at += 1
                continue
            if kind == "between":
                m = _BETWEEN.match(text, at)
                self._blank(m.end() - (m[1] in ("{", "<")))
                if m[1] == "{":
                    self._put("(")
                    stack.append(("code", ")"))
                    value = True
                elif m[1] == "<":
                    tag = _TAG.match(text, self._done)
                    self._blank(tag.end() if tag else self._done + 1)
                    if tag:
                        stack.append(("tag", ""))
                elif m[1]:
                    stack.pop()
                    value = False
                at = self._done
                continue
            m = _CODE.search(text, at)
            if not m:
                return
            token, start, at = m[0], m.start(), m.end()
            self._keep(start)
            if token.startswith(("//", "/*")):
                self._blank(at)
                self.notes.append((start, at))
                continue
            if token[0] in "\"'":
                self._blank(at)
                value = False
            elif token == "`":
                self._blank(at)
                stack.append(("template", ""))
            elif token == "/" and value and (r := _REGEX.match(text, start)):
                at = r.end()
                self._blank(at)
                value = False
            elif token == "<" and value and self._is_markup(start):
                at = _TAG.match(text, start).end()
                self._blank(at)
                stack.append(("tag", ""))
            elif token == "@" and (d := _DECORATOR.match(text, start)):
                at = d.end()
                self._blank(at)
                if text[at : at + 1] == "(":  # its arguments are blanked by whoever pairs brackets
                    self._put("\x00")
                    at += 1
                    rounds.append(True)
                value = True
            elif token == "{":
                stack.append(("code", "}"))
                value = True
            elif token == "}":
                if len(stack) > 1:
                    stack.pop()
                    if close == ")":
                        self._put(")")
                value = False if close == ")" else True
            elif token in "([":
                if token == "(":
                    rounds.append(word in _CONDITIONS)
                value = True
            elif token == ")":
                value = rounds.pop() if rounds else False
            elif token == "]":
                value = False
            elif token[0].isalnum() or token[0] in "_$":
                value = token in _BEFORE_VALUE
            elif token in ("++", "--"):
                pass  # before or after a value, it is still to come or has been
            else:
                value = True
            word = token if token[0].isalpha() else ""


def blanked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The source's code and its comments' bounds; decorators' arguments are blanked too."""
    scan = Scan(text)
    code = scan.code
    if "\x00" not in code:
        return code, scan.notes
    out, at, depth = [], 0, 0
    for m in re.finditer("[\x00()]", code):
        c = m[0]
        if not depth:
            if c != "\x00":
                continue
            out.append(code[at : m.start()])
            at, depth = m.start(), 1
        else:
            depth += -1 if c == ")" else 1
            if not depth:
                out.append(_KEPT.sub(" ", code[at : m.end()]))
                at = m.end()
    out.append(_KEPT.sub(" ", code[at:]) if depth else code[at:])
    return "".join(out), scan.notes
