import ast
import random

import pytest

from symgraph.llm.syntax import check

GOOD = {
    "go": [
        "", "// only\n", 'package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype S[T any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\nfunc (s *S[T]) F(a []int, b ...string) (n int, err error) {\n\tfor i, v := range a {\n\t\tif x := v; x > 0 {\n\t\t\tn += x\n\t\t} else if x < 0 {\n\t\t\tcontinue\n\t\t}\n\t\t_ = i\n\t}\n\tswitch t := any(n).(type) {\n\tcase int, string:\n\t\t_ = t\n\tdefault:\n\t}\n\tselect {\n\tcase c := <-ch:\n\t\t_ = c\n\tcase ch <- 1:\n\t}\n\tgo func() { defer close(ch) }()\n\tm := map[string][]int{"a": {1, 2}, `b`: nil}\n\treturn len(m), fmt.Errorf("x %d", \'{\')\n}\n',
    ],
    "java": [
        "", "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H<int[]> {\n  enum K { A, B(1) { void f() {} }, ; int z; }\n  record R(int a, String... b) { R { a = 1; } }\n  static { x = 1; }\n  private final Map<String, List<int[]>> m = new HashMap<>() {{ put(1, 2); }};\n  public <U> U f(final int a, U... u) throws E1, E2 {\n    for (int i = 0, j = 1; i < 3; i++, j--) { a[i] >>>= 2; }\n    for (var s : u) label: do { break label; } while (a > b >> 2);\n    Runnable r = () -> { }; Function<A, B> g = (x) -> (int) x + (String) y; h(A::new, int[]::new);\n    var t = switch (a) { case 1, 2 -> 3; default -> { yield 4; } };\n    switch (a) { case 1: f(); default: g(); }\n    try (var q = open(); r2) { throw new X(); } catch (A | B e) { } finally { }\n    if (o instanceof String s && !s.isEmpty()) return (x < y) ? a : b;\n    return this.<U>f(\"a\", 'c', \"\"\"\n      text \" block\n      \"\"\");\n  }\n}\n",
    ],
    "c": [
        "", '#include <stdio.h>\n#define M(x) \\\n  ((x) + "\n#if 1\nint a;\n#else\nint (;\n#endif\ntypedef struct P { int a : 3, b; union { char c[2]; } u; struct P *next; } P;\nenum E { A = 1, B, };\nstatic const char *names[] = { [0] = "a" "b", { 1, .x = 2 } };\nextern int (*fp)(int, char *[], ...);\nint main(int argc, char **argv)\n{\n    P *p = (P *)malloc(sizeof(P) * 2), q;\n    unsigned long n = 0x1fUL;\n    for (int i = 0; i < 3; i++) if (p->a) q.b = *p->next->u.c; else { goto end; }\n    do { x = a ? b : c, d; } while (!n--);\n    switch (n) { case 1: case \'\\n\': break; default: ; }\nend:\n    foo * bar = (foo)baz;\n    return -1;\n}\n',
    ],
    "rust": [
        "", "#![allow(x)]\nuse std::{fmt, io::{self, Read as R}};\npub(crate) struct A<'a, T: B + 'a = u8, const N: usize>(pub &'a T, [u8; N]) where T: C<D = E>;\nimpl<'a, T> F for A<'a, T> where T: G {\n    type X = Vec<Vec<u8>>;\n    pub async unsafe fn f(&mut self, (a, b): (u8, u8), mut c: impl Fn(u8) -> u8) -> Result<(), Box<dyn E>> {\n        let S { x, ref y, .. } = s else { return Err(e)?; };\n        if let Some(1..=5 | 7) = v && x { a } else if x == (Q { z: 1 }) { b };\n        match x { A::B(n) if n > 1 => n as u8 as i32, [a, .., b] => {}, 'a'..='z' => 2, _ => loop { break 'o 1; }, }\n        let g = |x: u8, y| -> u8 { x << 2 >> y }; let h = move || vec![1; 3];\n        for i in 0..n { println!(\"{} {{\", r#\"\"raw\"\"#); }\n        x.iter().map(|&x| x < 3).collect::<Vec<_>>()[..2].to_vec(); a = b'\\n'; /* a /* nested */ b */\n        *p += 1.0e3; return;\n    }\n}\nmacro_rules! m { ($x:expr) => { $x }; }\ntrait T: U { const K: u8 = 1; fn g(self: Box<Self>) -> Self where Self: Sized; }\n",
    ],
    "javascript": [
        "", "import a, { b as c, default as d } from 'x'\nexport * as e from \"y\";\nexport default class extends (f()) { static #p = 1; get [k]() { return `a${`b${1}`}c` } async *g({ a, b: [c = 1, ...d] } = {}, ...r) { yield* x; await y } static { z() } }\nconst h = async (a, { b, c = 2 }) => ({ ...a, b, [c]: /[/}\\/]+/g, 'd': 1_000n, e() {}, get f() { return 1 } })\nlet i = a ? b : c ?? d?.e?.[0]?.(1), j = x ** -y\nfor (const [k, v] of Object.entries(o)) if (k in v) continue; else break\nfor (let q = 0, n = 3; q < n; q++) { }\nfor (var z in o);\nlabel: while (1) { do x++; while (x < 5) try { throw new Error() } catch { } finally { } }\nswitch (a) { case 1: default: b() }\nif (a) b()\nelse c()\nx = a / b / c\nvar s = function* () { return\n1 }\n(async () => { for await (const x of y) await x })()\n",
    ],
    "typescript": [
        "", "import type { A } from './a';\nexport abstract class C<T extends object = {}> extends D<T> implements E, F<G> {\n  private readonly m: Map<string, Array<T>> = new Map();\n  constructor(private x: number, public y?: string) { super(); }\n  abstract f(a: string): void;\n  get g(): T | undefined { return this.m.get('a') as T; }\n  [key: string]: any;\n  h<U>(this: C<T>, x: U): x is U { return x!; }\n}\nexport enum K { A = 1, B = 'b', }\ndeclare module 'x' { export function q(a: number): void; }\ntype U = { kind: 'a'; size: number } | { kind: 'b' } & (new (x: number) => string);\ntype M = { readonly [P in keyof T]?: T[P] extends infer R ? R[] : never };\ninterface I<T> extends J { (a: T): void; new (): I<T>; readonly z?: Array<Array<T>>; m?(): [a: string, b?: number] }\nexport const z = <T,>(a: T, b: (x: T) => boolean = () => true): Array<T> => f<T>(a)\nlet v = a < b, w = <any>x, q = y satisfies Z;\nfunction over(a: string): void;\nfunction over(a: any) { assertIsString(a); }\nnamespace N.O { export const a = 1 }\nexport type { U };\n",
    ],
}
BAD = {
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n<<<<<<< HEAD\n}\n", "func f() {}\n", 'package a\nvar x = "abc\n', "package a\nfunc f() {\n\tx = = 1\n}\n", "package a\nfunc f() int {\n\treturn 1\n", "package a\n\0"],
    "java": ["class A {", "class A { void f() { int x = = 1; } }", "class A { void f() { g(1; } }", "x = 1;", "class A { <<<<<<< HEAD\n }", 'class A { String s = "a; }'],
    "c": ["int f() { return 1;", "int f( { }", "int x = = 1;", "#if 1\nint a;\n", "#endif\n", "package a.b;", "int a; =======\n", "int f(void) { x = 'a; }"],
    "rust": ["fn f() {", "fn f( { }", "fn f() { let x = = 1; }", "package a;", "enum E { A, <<<<<<< HEAD }", "fn f() { g(1; }", 'const S: &str = "a;\n'],
    "javascript": ["function f( {}", "let x = ;", "class A { f() { } ", "a b", "x = 'abc\n", "const y: string = 1;", "`a${b`", "<<<<<<< HEAD\nx\n", "import { a } fro 'x'", "}"],
    "typescript": ["class A { m: Map<string = 1; }", "let x: = 1", "interface A { a: }", "fn main() {}", "type A = ;", "func f() {}"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid(language):
    for text in GOOD[language]:
        assert check(text, language) == (True, []), check(text, language)
        assert check(text.replace("\n", "\r\n"), language).valid
        assert check(text.rstrip("\n"), language).valid


@pytest.mark.parametrize("language", sorted(BAD))
def test_invalid(language):
    for text in BAD[language]:
        assert not check(text, language).valid, text


@pytest.mark.parametrize("language", sorted(GOOD))
def test_every_cut_of_a_block_is_invalid(language):
    text = GOOD[language][-1]
    last = text.rstrip().rfind("}")
    assert not check(text[:last], language).valid and not check("}" + text, language).valid


def test_errors_come_in_order_and_after_recovery():
    report = check("package a\n\nfunc f() {\n\tx = = 1\n}\n\nfunc g() {\n\ty = = 2\n}\n", "go")
    assert [n for n, _ in report.errors] == [4, 8] and report.errors[0][1].startswith("expression expected")
    assert check("x = 1\ndef f(:\n    pass\ny = = 2\n", "python").errors[0][0] == 2


PYTHON = '''\
import a.b as c, d
from . import (e, f as g,)
@h(1)
async def i(j, /, k: int = 1, *l, m=2, **n) -> "o":
    async with p as (q, r), s: pass
    return [x async for x in y if x], {**a, "b": 1}, {1, *z}, (yield)
class T[U](V, metaclass=W):
    x: int = 1; y = z = lambda *a, b=1: (a, b)
    def f(self): return f"{x!r:>{width}} {{}} {y["k"]}" rb"a" if a else b
match p:
    case {"a": [1, -2, *rest], **kw} | T(x=None) if y: pass
    case _: pass
try:
    a, *b = c[1:2, ::3] = not d < e in f is not g
except* (A, B) as e:
    raise X from None
else: del a[0], b.c
finally:
    while (n := f()): break
    else: assert x, "y"
if a:
\tb += 1
elif c: global q
for a, in b: x = a if b else c
type X = int
'''


def test_python_agrees_with_the_interpreter():
    assert check(PYTHON, "python").valid
    rng = random.Random(11)
    for _ in range(1500):
        text = list(PYTHON)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(text))
            if rng.random() < 0.5:
                del text[k : k + rng.randrange(1, 4)]
            else:
                text.insert(k, rng.choice("()[]{}:,=*\n \"'x1.+"))
        source = "".join(text)
        try:
            ast.parse(source)
            good = True
        except (SyntaxError, ValueError):
            good = False
        if check(source, "python").valid != good:
            # What the interpreter refuses beyond the grammar (repeated names, bindings in patterns, targets of :=) may pass.
            assert not good, source


def test_long_and_deep_texts():
    assert check("x = [" + "1, " * 50_000 + "]\n", "python").valid
    assert not check("x = " + "(" * 50_000 + "\n", "python").valid
    assert check("var x = " + "a + " * 20_000 + "b;", "javascript").valid


def test_all_errors_are_kept():
    damaged = {"python": "x = = 1\n", "go": "var x = = 1\n", "javascript": "x = = 1;\n", "java": "int x = = 1;\n", "c": "int x = = 1;\n", "rust": "const X: i32 = = 1;\n"}
    head = {"go": "package a\n", "java": "class A {\n"}
    for language, text in damaged.items():
        top = head.get(language, "")
        errors = check(top + text * 400 + ("}\n" if language == "java" else ""), language).errors
        first = 2 if top else 1
        assert [n for n, _ in errors] == [*range(first, first + 400)], language
    assert len(check("x = = 1\n" * 20_000, "python").errors) == 20_000


def test_order_of_package_imports_and_declarations():
    go = 'package a\n\nimport "b"\n\nfunc f() {}\n'
    assert check(go, "go").valid and check('package a\nimport "b"\nimport ("c"; "d")\nvar x = 1\n', "go").valid
    assert check(go + '\nimport "c"\n', "go").errors == [(7, "imports come first")]
    java = "package a.b;\nimport c.d;\nclass E {}\n"
    assert check(java, "java").valid and check("@A package a.b;\nimport c.d;\n@A class E {}\n@A class F {}\n", "java").valid
    assert check(java + "import f.g;\n", "java").errors == [(4, "imports come first")]
    # Whatever was read before: here, a valid package declaration before the same kind of token.
    assert check("package a.b;\nclass E {}\n", "java").valid
    assert not check("import c.d;\npackage a.b;\nclass E {}\n", "java").valid and not check(java * 2, "java").valid


def test_frame(spark):
    from datetime import datetime

    from symgraph.llm.validity import parse_rates, parse_reports

    t = datetime(2031, 1, 1)
    rows = [
        (1, "r", "a.py", "PYTHON", "", t, 1, 1), (1, "r", "a.py", "go", "", datetime(2030, 1, 1), 1, 1), (2, "r", "b.h", None, "", t, 1, 1), (3, "r", "c.go", " golang", "", t, 1, 1), (4, "r", "d.txt", None, "", t, 1, 1),
        (5, "r", "e.py", "python", "", t, 1, 1), (6, None, None, None, None, None, None, None), (7, "q", "f.rs", "Rust", "", t, 1, 1),
    ]
    files = spark.createDataFrame(rows * 2, "file_id long, repo_id string, rel_path string, language string, hash string, indexed_at timestamp, mtime_ns long, valid int")
    contents = spark.createDataFrame([(1, "x = 1\n"), (2, "int a"), (3, "package a\n"), (4, "?"), (5, None), (7, ""), (9, "x")], "file_id long, content string").withColumn("errors", __import__("pyspark").sql.functions.lit(1))
    got = {r.file_id: (r.language, r.valid) for r in parse_reports(files.withColumnRenamed("valid", "size"), contents).collect()}
    assert got == {1: ("python", True), 2: ("c", False), 3: ("go", True), 7: ("rust", True)}
    stats = spark.createDataFrame([(1, "r", 3), (1, "r", 3), (2, "r", None)], "stat_id long, repo_id string, parse_errors long")
    rates = {(r.repo_id, r.language): (r.n_files, r.n_invalid, r.reported) for r in parse_rates(parse_reports(files.withColumnRenamed("valid", "size"), contents), stats).collect()}
    assert rates[("r", "c")] == (1, 1, 3) and rates[("q", "rust")] == (1, 0, None)
    assert parse_reports(files.limit(0).withColumnRenamed("valid", "size"), contents).count() == 0


@pytest.mark.parametrize(
    "text, valid",
    [("return 1;", False), ("break;", False), ("continue", False), ("if (a) { return; }", False), ("while (a) { break; }", True), ("function f() { return 1; }", True), ("const f = () => { return 1; };", True),
     ("class A { static { return; } }", False), ("class A { m() { for (;;) { if (a) continue; } } }", True), ("switch (a) { case 1: break; default: continue; }", False), ("for (const x of y) { switch (x) { case 1: continue; } }", True),
     ("x: { break x; }", True), ("while (a) { function g() { break; } }", False), ("do { break; } while (a)", True)],
)
def test_places_of_jumps(text, valid):
    for again in (1, 2):
        assert check("function h() { return 1; }\nwhile (a) { break; }\n", "javascript").valid
        assert check(text, "javascript").valid is valid and check(text, "typescript").valid is valid


def test_too_deep_is_unknown():
    deep = check("x = " + "(" * 60_000 + "1" + ")" * 60_000 + ";", "javascript")
    assert deep.valid is not False or "deep" not in deep.errors[0][1]
