"""Main text of HTML pages by two passes of block rules.

A linear scan parts a page into blocks of text. In the first pass rules vote on each block by itself: its
link density, its length and share of stop words, the elements and names around it, and, as one vote among
them, whether it stands in what the page marks as its article. That makes it good, bad or undecided. In the second
pass an undecided block takes the label of its nearest decided neighbours.

What an element is called is weighed against the prose that it holds: an element named like a menu or an advert that has most of the
article's prose is the article. On a page without stop words of the languages known here, prose is told by length and the ends of sentences.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnforge.llm import common

#: Function words of English, German, French and Spanish (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is it that for was on are with as be at by this from or an not but have had has his her they we you he she which one all were there their been if more when will would who so no "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis "
    "le la les de des du et un une à au aux en que qui dans pour par sur avec est pas ce cette il elle ne se sont son sa ses plus ou mais nous vous ils on y été leur comme "
    "el los las del y a en un una por con para se no es su al lo como más o pero sus le ya fue este ha si porque esta son entre está cuando muy sin sobre también me hasta hay".split()
)

#: Elements whose start or end parts text into blocks (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without text of their own, skipped to their end (fixed values).
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button title".split())
#: Those of them that go on to the page's end if nothing ends them, and those that can hold one of their kind (fixed values).
RAW, NESTED = frozenset("script style".split()), frozenset("template object svg math".split())
#: Elements that never hold content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where another of their kind starts (fixed values).
ITEMS = frozenset("li dt dd tr td th option".split())
#: Elements and ARIA roles around the article (fixed values).
APART = frozenset("nav footer aside menu dialog".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words in class and id that name what surrounds an article, in three groups: readers' comments, what is seldom part of an article, and what a part of
#: one can be about (fixed values).
_READERS = "comment comments commentlist disqus respond replies".split()
_FURNITURE = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead topbar cookie cookies consent gdpr notice notification popup modal newsletter subscribe signup login pagination pager"
).split()
_SUBJECTS = "widget sharing social related recommended trending".split()
_APART_NAMES = re.compile(rf"(?:^|[\s_-])(?:({'|'.join(_READERS)})|({'|'.join(_FURNITURE)})|({'|'.join(_SUBJECTS)}))(?:$|[\s_-])", re.I)
#: Words in class and id that an article's own parts often have (fixed values).
_DOUBTFUL_NAMES = re.compile(
    r"(?:^|[\s_-])(?:alert|banner|copyright|disclaimer|foot|form|header|legal|overlay|reply|search|share|side|tagcloud|tags|toolbar)(?:$|[\s_-])",
    re.I,
)

# A whole tag of the usual form; whatever it does not match is read attribute by attribute.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'>/=<]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'>`=<]++))?+)*+)\s*+/?+>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_PAIR = re.compile(r"""([^\s=]++)=(?:"([^"]*+)"|'([^']*+)'|(\S++))|(\S++)""")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_SAME = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in SILENT}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Signs that end a sentence in many scripts (fixed values).
_SENTENCE = re.compile("[.!?…。！？｡؟۔।॥։።]")

GOOD, BAD, UNDECIDED = 1, -1, 0
#: Link density from which a block is bad; stop-word density and length from which it reads as prose.
MAX_LINKS, MIN_STOP, MIN_CHARS = 0.5, 0.12, 60
#: Votes: of prose, of links, of names that an article's own parts may have, of standing in or beside a marked article.
PROSE, LINKS, DOUBTFUL, MARKED = 2, -4, -2, 1
#: Where no stop word is known: the least length of prose, and the vote against a block without a sentence that is shorter than half of it in the middle.
MIN_FOREIGN, BARE = 20, -1


@dataclass(slots=True)
class Block:
    text: str
    links: int  # characters inside links
    heading: bool
    apart: bool  # inside an element around the article
    doubtful: bool  # inside an element whose name an article's own parts may have
    inside: bool  # inside what the page marks as its article
    listed: bool = False  # inside a list or a table


class _Reader:
    """The blocks of a page, and the elements that are open: only counts of them are looked at for a block."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links, self.linked, self.heading = 0, False, False
        self.open: list[tuple] = []  # name, its place in ``named``, and the four counts before it
        self.named: list[list[int]] = []  # of elements by name: first block, end, group of the name, and whether in an article
        self.names: dict[str, int] = {}
        self.apart = self.forms = self.doubtful = self.article = 0

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            apart = self.apart + self.forms > 0
            listed = any(self.names.get(x) for x in ("li", "dd", "td", "th"))
            self.blocks.append(Block(text, self.links, self.heading, apart, self.doubtful > 0, self.article > 0 and not apart, listed))
        self.parts, self.links = [], 0

    def text(self, raw: str):
        if raw:
            t = _html.unescape(raw) if "&" in raw else raw
            self.parts.append(t)
            if self.linked:
                self.links += len("".join(t.split()))

    def start(self, name: str, attributes: dict[str, str]):
        self.flush()
        if self.open and self.open[-1][0] == "p" or name in ITEMS and self.open and self.open[-1][0] == name:
            self._pop()
        if name in VOID:
            return
        self.heading = name in HEADINGS
        self.open.append((name, None, self.apart, self.forms, self.doubtful, self.article))
        self.names[name] = self.names.get(name, 0) + 1
        role = attributes.get("role", "").lower()
        if name in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody":
            self.article += 1
            self.forms = 0  # a form around the page's article is no form that belongs to it
        elif name in APART or role in APART_ROLES or name == "header" and not self.article:
            self.apart += 1
        elif name == "form":
            self.forms += 1
        elif name not in ("html", "head", "body"):
            own, at = attributes.get("class", ""), attributes.get("id", "")
            found = own and _APART_NAMES.search(own) or at and _APART_NAMES.search(at)
            if found:
                self.named.append([len(self.blocks), -1, found.lastindex, int(self.article > 0)])
                self.open[-1] = (name, self.named[-1], *self.open[-1][2:])
            # A section's or heading's id names its subject.
            elif own and _DOUBTFUL_NAMES.search(own) or at and name != "section" and not self.heading and _DOUBTFUL_NAMES.search(at):
                self.doubtful += 1

    def end(self, name: str):
        self.flush()
        self.heading = False
        if self.names.get(name):
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name, named, self.apart, self.forms, self.doubtful, self.article = self.open.pop()
        self.names[name] -= 1
        if named:
            named[1] = len(self.blocks)
        return name


def _slow_tag(page: str, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag whose attributes start at ``at`` ends, and they; the page's end if it never does.

    A quote opens a value after ``=`` alone. One that nothing closes is read as a value without quotes.
    """
    out: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = _ATTRIBUTE.match(page, at)
        at, value = m.end(), ""
        if m[2]:
            mark = page[at : at + 1]
            close = page.find(mark, at + 1) if mark and mark in "\"'" else -1
            if close >= 0:
                value, at = page[at + 1 : close], close + 1
            else:
                value = _BARE.match(page, at)[0]
                at += len(value)
        if m[1]:
            out.setdefault(m[1].lower(), value)
        if page[at : at + 1] == ">":
            return at + 1, out
    return n, out


def _pairs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare, alone in _PAIR.findall(raw):
        out.setdefault((name or alone).lower(), double or single or bare)
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order; scripts, styles, comments and markup are gone.

    Each character is looked at a fixed number of times, whatever the markup.
    """
    r, at, n = _Reader(), 0, len(page)
    unclosed: set[str] = set()
    link_end = -1  # where the link that is open ends, if another link does not come first
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            r.text(page[at:])
            break
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?") or follows == "/" and not page[lt + 2 : lt + 3].isascii():
            r.text(page[at:lt])
            if page.startswith("<!--", lt):
                close, width = (lt + 3, 2) if page.startswith("<!-->", lt) else (page.find("-->", lt + 4), 3)
            else:
                close, width = page.find(">", lt), 1
            at = n if close < 0 else close + width
            continue
        m = _TAG.match(page, lt)
        if m:
            after, attributes = m.end(), None
        else:
            m = _NAME.match(page, lt)
            if not m:  # a sign in the text, or an end tag without a name
                if follows == "/":
                    r.text(page[at:lt])
                    close = page.find(">", lt)
                    at = n if close < 0 else close + 1
                else:
                    r.text(page[at : lt + 1])
                    at = lt + 1
                continue
            after, attributes = _slow_tag(page, m.end())
        r.text(page[at:lt])
        at, name = after, m[2].lower()
        if m[1]:
            if name == "a":
                r.linked = False
            elif name in BLOCKS:
                r.end(name)
                r.linked = r.linked and at <= link_end
            continue
        if name in SILENT:
            if name in BLOCKS:
                r.flush()
            if name not in unclosed:
                depth, to = 1, None
                for x in _SAME[name].finditer(page, at):
                    depth += -1 if x[1] else 1
                    if x[1] and (not depth or name not in NESTED):
                        to = x.end()
                        break
                    if not x[1] and name not in NESTED and name not in RAW:
                        to = at  # its end is missing: only the tag is skipped
                        break
                if to is None:
                    unclosed.add(name)
                    to = n if name in RAW else at
                elif to != at:
                    close = page.find(">", to)
                    to = n if close < 0 else close + 1
                at = to
            continue
        if name == "a":
            known = attributes if attributes is not None else _pairs(m[3])
            r.linked = "href" in known
            if r.linked:
                x = _LINK.search(page, at)
                link_end = x.start() if x and x[1] else -1
        elif name == "br":
            r.parts.append(" ")
        elif name in BLOCKS:
            r.start(name, attributes if attributes is not None else _pairs(m[3]) if m[3] else {})
            r.linked = r.linked and at <= link_end
    r.flush()
    _weigh(r.blocks, r.named)
    return r.blocks


def _weigh(blocks: list[Block], named: list[list[int]]) -> None:
    """Set apart the blocks of elements that are named so, unless the prose in an element says otherwise.

    An element with more than half of the prose, that of the marked article if there is one, is not apart. In the marked article one is not either if it is named
    by what a part can be about and is mostly prose itself. Readers' comments are apart unless they have all the prose of the article that they stand in.
    """
    if not named:
        return
    reads = _reads(blocks)
    marked = any(b.inside for b in blocks)
    sums = [(0, 0, 0)]  # prose that counts, prose, text: of all blocks before
    for b, x in zip(blocks, reads, strict=True):
        n, prose, base = len(b.text), x and not b.apart, b.inside or not marked
        sums.append(tuple(s + v for s, v in zip(sums[-1], (n * (prose and base), n * prose, n), strict=True)))
    whole = sums[-1][0]
    steps = [0] * (len(blocks) + 1)
    for first, end, group, in_article in named:
        end = len(blocks) if end < 0 else end
        share, prose, text = (y - x for x, y in zip(sums[first], sums[end], strict=True))
        if group == 1:
            spared = in_article and 0 < share == whole
        else:
            spared = 2 * share > whole or group == 3 and in_article and 2 * prose > text
        if not spared:
            steps[first] += 1
            steps[end] -= 1
    depth = 0
    for b, step in zip(blocks, steps, strict=False):
        depth += step
        if depth:
            b.apart, b.inside = True, False


def _linked(b: Block) -> bool:
    return b.links > MAX_LINKS * (len(b.text) - b.text.count(" "))


def _known(b: Block) -> bool:
    """Whether a block is long and has many stop words."""
    words = _WORD.findall(b.text.lower()) if len(b.text) >= MIN_CHARS else ()
    return bool(words) and sum(w in STOP_WORDS for w in words) >= MIN_STOP * len(words)


def _foreign(b: Block) -> bool:
    return len(b.text) >= MIN_FOREIGN and bool(_SENTENCE.search(b.text))


def _reads(blocks: list[Block]) -> list[bool]:
    """Whether each block reads as prose: by stop words, or on a page where no block does, by sentences."""
    found = [not _linked(b) and _known(b) for b in blocks]
    return found if any(found) else [not _linked(b) and _foreign(b) for b in blocks]


def _first(b: Block, reads: bool, bare: bool, marked: bool) -> int:
    """The label of a block by itself: whether it reads as prose, is too short for it, and whether the page marks an article."""
    if b.apart:
        return BAD
    linked = _linked(b)
    if linked and b.inside and not b.listed and not b.doubtful:
        return UNDECIDED  # a paragraph of the article that is a link
    votes = BARE * bare
    if marked:
        votes += MARKED if b.inside else -MARKED
    if b.doubtful:
        votes += DOUBTFUL
    if linked:
        votes += LINKS
    elif reads:
        votes += PROSE
        if votes > 0:
            return GOOD
    return BAD if votes < 0 else UNDECIDED


def _bare(blocks: list[Block], reads: list[bool]) -> list[bool]:
    """On a page without known stop words: which blocks have no sentence and are shorter than half of the prose in the middle."""
    sizes = sorted(len(b.text) for b, x in zip(blocks, reads, strict=True) if x and not b.apart)
    if not sizes or any(not _linked(b) and _known(b) for b in blocks):
        return [False] * len(blocks)
    middle = sizes[len(sizes) // 2]
    return [not b.heading and 2 * len(b.text) < middle and not _SENTENCE.search(b.text) for b in blocks]


def _nearest(blocks: list[Block], labels: list[int]) -> list[tuple[int, int]]:
    """Label and distance of the decided block before each, of the blocks that do not stand apart, up to the article's edge."""
    out, last, since, inside = [], UNDECIDED, 0, None
    for b, x in zip(blocks, labels, strict=True):
        if b.apart:
            out.append((last, since))
            continue
        if b.inside is not inside:
            last, since, inside = UNDECIDED, 0, b.inside
        out.append((last, since))
        if x:
            last, since = x, 0
        since += 1
    return out


def labels_of(blocks: list[Block]) -> list[int]:
    """``GOOD`` or ``BAD`` for each block.

    What stands apart is bad for its markup, which also says where it ends, so it decides no neighbour; nor does what is on the other side of the edge of the marked article. Where both sides
    differ the nearer one decides; at equal distance a heading goes with what follows, and any other block with the
    good one. On a page where nothing else is decided, all that does not stand apart is good.
    """
    marked = any(b.inside for b in blocks)
    reads = _reads(blocks)
    labels = [_first(b, x, bare, marked) for b, x, bare in zip(blocks, reads, _bare(blocks, reads), strict=True)]
    before = _nearest(blocks, labels)
    after = _nearest(blocks[::-1], labels[::-1])[::-1]
    out = []
    for b, label, (p, far), (q, off) in zip(blocks, labels, before, after, strict=True):
        if label == UNDECIDED:
            if p and q and p != q:
                label = q if off < far or off == far and b.heading else p if far < off else GOOD
            else:
                label = p or q or GOOD
        out.append(label)
    return out


def extract(page: str | None) -> str:
    """The page's main text, a block a line; empty if there is none."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, label in zip(blocks, labels_of(blocks), strict=True) if label == GOOD)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html, ...)``.

    Null or empty html, or one without main text: empty text. Null page_id or url and repeated rows: each
    row is returned by itself. Empty table: empty result. Very long pages are read whole, in one scan.
    Other columns are ignored, whatever their names.
    """

    def read(batch: pa.RecordBatch):
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.map_arrow(pages.select("page_id", "url", "html"), read, "page_id long, url string, text string, n_chars long")
