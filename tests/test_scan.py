import random
import time

import pytest

from tarnforge.operators import scan, syntax

SOURCE = r"""
import React from 'react';
const url = /https?:\/\/[^/"'`]+\/(?:a|b)/gi, half = a / b / 2;
if (x) /re"{/.test(s);
const text = `one ${two ? `in { ${three({ a: 1 })} }` : '}'} end {`;
export function identity<T extends Map<string, Array<Set<number>>>>(x: T): T;
export function identity(x: any): any {
  return <div className="a>b" onClick={() => { go('}'); }}>it's {x > 1 ? <b>{`${x}`}</b> : null} {'{'} </div>;
}
const pick = <T, K extends keyof T>(o: T, k: K): T[K] => {
  return o[k];
};
const typed: (a: string) => void = (a) => {
  console.log(a);
};
@Component({
  selector: "app", template: `<p>{{ x }}</p>`,
})
export class Box<T> extends Base<Map<string, T>> {
  @Input() name = "";
  @Output({ a: (b) }) render(): JSX.Element { return <Box<T> a={1} />; }
  get size(): { width: number; height: number } { return { width: 1, height: 2 }; }
  async load<U extends Record<string, Array<U>>>(u: U): Promise<Map<string, U[]>> {
    return u;
  }
  map(f: (x: T) => T): (y: T) => { z: T } { return (y) => ({ z: f(y) }); }
  optional?(): void { }
}
"""


def test_declarations_of_hard_sources():
    tree = syntax.Tree(SOURCE, "typescript")
    found = {(n.kind, n.name): tree.source(n) for n in tree.nodes if n.kind in ("function", "method", "class")}
    assert set(found) == {("function", x) for x in ("identity", "pick", "typed")} | {("class", "Box")} | {("method", x) for x in ("render", "size", "load", "map", "optional")}
    assert found["function", "identity"].endswith("</div>;\n}") and found["function", "pick"].endswith("return o[k];\n};")
    assert found["method", "size"].endswith("height: 2 }; }") and found["method", "map"].endswith("z: f(y) }); }")
    assert found["class", "Box"].endswith("optional?(): void { }\n}") and found["method", "load"].endswith("return u;\n  }")


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ("a = /[/]{/g; b", "a =        ; b"),
        ("a = b / c / d", "a = b / c / d"),
        ("return /x}/", "return     "),
        ("x++ / 2 / y", "x++ / 2 / y"),
        ("(a) / b / c", "(a) / b / c"),
        ("if (a) /b{/.c", "if (a)     .c"),
        ("`a${b}c`", "   (b)  "),
        ("`a${`{${x}`}`", "   (   (x) ) "),
        ("a < b && c > d", "a < b && c > d"),
        ("x = <a b={c}>d's{e}</a>;", "x =      (c)    (e)    ;"),
        ("x = <a/>;", "x =     ;"),
        ("x = <>t{y}</>;", "x =    (y)   ;"),
        ("f(<T,>(x) => x)", "f(<T,>(x) => x)"),
        ("@A.b() c() {}", "       c() {}"),
        ("'it' // x\n\"y", "         \n  "),
        ("`open ${a", "       (a"),
    ],
)
def test_blanked(source, code):
    got, _ = scan.blanked(source)
    assert got == code and len(got) == len(source)


def test_comments():
    text = "a /* { */ b // }\n`// no` /x/ // yes"
    assert [text[a:b] for a, b in scan.blanked(text)[1]] == ["/* { */", "// }", "// yes"]


def test_any_text_keeps_its_places():
    random.seed(2)
    for _ in range(400):
        text = "".join(random.choices(["`", "${", "}", "{", "<a", ">", "</a>", "/>", "/", "'", '"', "(", ")", "\\", "\n", " ", "x", "=", "return ", "@d", "//", "/*", "*/"], k=60))
        code, notes = scan.blanked(text)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        syntax.Tree(text, "typescript")


def test_linear():
    for unit in ("`${", "<a>", "<a b={", "= /[", "@d(", "= <a ", "</a>", "a<b<c>>(", "f(x): {", "x = `", "{<a}"):
        began = time.process_time()
        scan.blanked(unit * 4000)
        once = time.process_time() - began
        scan.blanked(unit * 16_000)
        assert time.process_time() - began - once < 1 + 10 * once, unit
