"""Definitions and call sites in twelve languages."""

import pytest

from quern.operators.scanner import blocks, calls

PY = '''import sys


def first(a: int) -> str:
    """About first."""
    return str(a)


@wraps(first)
async def second():
    pass


class Box:
    """A box."""

    class Lid:
        def lift(self):
            return {
    "unindented": 1}

    def open(self, x): return x

if sys:
    def maybe(): ...

text = """
def not_code(): pass
"""

def last():
    r\'\'\'Last one.\'\'\'
    def inner(): pass
    return inner
'''


def brief(source, language):
    return [(b[0], b[1], b[2], b[3], b[4]) for b in blocks(source, language)]


def test_python():
    found = blocks(PY, "python")
    assert [(b[1], b[2]) for b in found] == [("first", ""), ("second", ""), ("Box", ""), ("Lid", "Box"), ("lift", "Box::Lid"), ("open", "Box"), ("maybe", ""), ("last", "")]
    by = {b[1]: b for b in found}
    assert by["first"][3:6] == (4, 6, "About first.")
    assert by["second"][3:5] == (9, 11)
    assert by["Box"][0] == "class_signature" and by["Box"][3:6] == (14, 15, "A box.")
    assert by["Lid"][3:5] == (17, 17)
    assert by["lift"][0] == "method" and by["lift"][3:5] == (18, 20)
    assert by["maybe"][3:5] == (25, 25)
    assert by["last"][5] == "Last one." and by["last"][4] == 34


def test_javascript_family():
    source = """/** Service */
export class Api<T> extends Base {
    /** Runs */
    async run(x: number): Promise<void> {}
    help() { return `a ${ {b: 1} } }`; }
}

/** Exported */
export function go(a: number): string { return ""; }

function* steps() { yield 1; }

const twice = (x: number) => x * 2;
export const later = async (q: Q): Promise<R> => {
    return q;
};
let plain = 5, bound = function () { return 1; };
interface Shape { area(): number }
"""
    assert brief(source, "typescript") == [
        ("class_signature", "Api", "", 1, 2), ("method", "run", "Api", 3, 4), ("method", "help", "Api", 5, 5), ("function", "go", "", 8, 9), ("function", "steps", "", 11, 11),
        ("function", "twice", "", 13, 13), ("function", "later", "", 14, 16), ("function", "bound", "", 17, 17),
    ]
    tsx = "interface P { u: { n: string } }\n\n/** Card */\nexport const Card: React.FC<P> = ({ u }) => {\n    return <b>{u.n}</b>;\n};\n"
    assert brief(tsx, "tsx") == [("function", "Card", "", 3, 6)]
    jsx = 'const el = <i className="x">hi</i>;\n\nfunction Part() {\n    return <b>ok</b>;\n}\n\nclass K {\n    hi() { return 2; }\n}\n'
    assert brief(jsx, "javascript") == [("function", "Part", "", 3, 5), ("class_signature", "K", "", 7, 7), ("method", "hi", "K", 8, 8)]


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("go", "package p\n\n// Hi greets.\nfunc Hi(n string) string {\n\treturn `}` + n\n}\n\n// Srv serves.\ntype Srv struct {\n\tport int\n}\n\n// Up starts.\nfunc (s *Srv) Up() error {\n\treturn nil\n}\n",
         [("function", "Hi", "", "// Hi greets."), ("class_signature", "Srv", "", "// Srv serves."), ("method", "Up", "Srv", "// Up starts.")]),
        ("rust", "/// Works.\npub fn work<'a>(x: &'a str) -> i32 {\n    '{' as i32\n}\n\n/// Machine.\npub struct Machine;\n\nimpl<T> Run for Machine {\n    /// Starts.\n    pub fn start(&self) {}\n}\n",
         [("function", "work", "", "/// Works."), ("class_signature", "Machine", "", "/// Machine."), ("method", "start", "Machine", "/// Starts.")]),
        ("c_sharp", "namespace N;\n\n/// <summary>S</summary>\n[Serializable]\npublic class Auth {\n    /// <summary>L</summary>\n    public bool In(string u) {\n        return u != @\"\\\";\n    }\n}\n",
         [("class_signature", "Auth", "", "/// <summary>S</summary>"), ("method", "In", "Auth", "/// <summary>L</summary>")]),
        ("java", "package c;\n\n/** Mgr. */\npublic class Mgr {\n    /** Pay. */\n    public void pay(double a) {\n    }\n    int x = f(1);\n}\n",
         [("class_signature", "Mgr", "", "/** Mgr. */"), ("method", "pay", "Mgr", "/** Pay. */")]),
        ("c", "#define X(a) { a\n/** Sum */\nint add(int a, int b) {\n    return a + b;\n}\n\n/** User */\nstruct User {\n    int id;\n};\n",
         [("function", "add", "", "/** Sum */"), ("class_signature", "User", "", "/** User */")]),
        ("cpp", "namespace App {\n    /** Db */\n    class Db {\n    public:\n        /** Open */\n        void* open(const char* u) {\n            return 0;\n        }\n    };\n}\n",
         [("class_signature", "App", "", ""), ("class_signature", "Db", "App", "/** Db */"), ("method", "open", "App::Db", "/** Open */")]),
        ("kotlin", "/** Users */\nclass Users {\n    /** Find */\n    fun find(id: String): String {\n        return \"${id}\"\n    }\n    fun short() = 1\n}\n",
         [("class_signature", "Users", "", "/** Users */"), ("method", "find", "Users", "/** Find */"), ("method", "short", "Users", "")]),
        ("swift", "/// Auth\npublic class Auth {\n    /// Check\n    public func check(t: String) -> Bool {\n        return true\n    }\n}\n",
         [("class_signature", "Auth", "", "/// Auth"), ("method", "check", "Auth", "/// Check")]),
    ],
)
def test_other_languages(language, source, want):
    assert [(b[0], b[1], b[2], b[5]) for b in blocks(source, language)] == want


def test_broken_source_keeps_what_stands_before():
    assert "good" in [b[1] for b in blocks("def good():\n    return 1\n\ndef bad(:\n  x = (\n", "python")]
    assert "good" in [b[1] for b in blocks("function good() { return 1; }\nfunction bad( { if (", "javascript")]
    for language in ("python", "go", "rust", "java", "cpp", "swift", "kotlin", "tsx"):
        for source in ("", "}", "{{{", '"', "/*", "`", "'''", "(", "\\", "class", "def", "é\u2028x"):
            blocks(source, language)
            calls(source, language)


def hits(symbol, *files):
    from quern.functions.text import normalized

    t = normalized(symbol)
    return [(lang, line) for lang, src in files for c, line, _ in calls(src, lang) if normalized(c) == t or normalized(c).endswith("." + t)]


def test_calls_ignore_comments_strings_and_definitions():
    py = ("python", '# check_it() no\ns = "check_it() no"\n\ndef main():\n    check_it("a")\n    svc.check_it("b")\n    other()\n')
    ts = ("typescript", "function run() {\n    Auth.check_it(1);\n}\n")
    assert hits("check_it", py, ts) == [("python", 5), ("python", 6), ("typescript", 2)]
    java = ("java", "class A {\n    void run() {\n        X.login(1);\n        Y.login(2);\n        login();\n    }\n}\n")
    assert hits("login", java) == [("java", 3), ("java", 4), ("java", 5)] and hits("X.login", java) == [("java", 3)] and not hits("run", java)
    rust = ("rust", "fn run() {\n    Mod::login();\n    a.login();\n    login();\n    println!(\"x\");\n}\n")
    assert len(hits("login", rust)) == 3 and hits("Mod::login", rust) == [("rust", 2)]
    c = ("c", "int add(int a, int b);\nvoid run() {\n    add(1, 2);\n    k->add(3);\n    p->q->work(1);\n}\n")
    assert hits("add", c) == [("c", 3), ("c", 4)] and hits("k->add", c) == [("c", 4)] and hits("work", c) == [("c", 5)]
    assert len(hits("find", ("kotlin", "fun r() {\n    s.find(1)\n    find(2)\n}\n"), ("swift", "func r() {\n    s.find(3)\n}\n"))) == 3


def test_new_counts_as_a_call():
    new = [("typescript", "const s = new Auth();\nconst t = new ns.Auth;\n"), ("java", "class A { void m() { Auth s = new Auth(); } }\n"), ("c_sharp", "class A { void M() { var s = new Auth(); } }\n"), ("cpp", "void m() { auto s = new Auth(); }\n")]
    assert len(hits("Auth", *new)) == 5 and hits("ns.Auth", *new) == [("typescript", 2)]


def test_nested_calls_come_outer_first():
    assert [c[0] for c in calls("a.b().c(d(1), e[0].f(2))\n", "python")] == ["a.b().c", "a.b", "d", "e[0].f"]


def found(source, language):
    return [c[0] for c in calls(source, language)]


def test_calls_within_strings_and_on_them():
    assert found('x = f"{a.b(c(1))} {{no()}} {d:>{e(2)}}"\ny = ", ".join(z)\nw = f\'{v}\'.strip()\ns = "no()"\n', "python") == ["a.b", "c", "e", '", ".join', "f'{v}'.strip"]
    assert found("t = `a ${f(`b ${g(1)}`)} h() \\${no()}`;\n", "typescript") == ["f", "g"]
    assert found('val a = "${f(1)} g(2)" + "b".trim()\n', "kotlin") == ["f", '"b".trim'] and found('let a = "\\(f(1)) g(2)"\n', "swift") == ["f"]
    assert found('class A { void M() { var a = $"{F(1)} {{G(2)}}"; var b = "G(3)".Trim(); } }\n', "c_sharp") == ["F", '"G(3)".Trim']


def test_signatures_are_no_calls():
    source = "abstract class A {\n  abstract area(): number;\n  run(x: number): void;\n  run(x: any) { f(x); }\n}\ninterface S { g(): void; h(k(): x): y }\ntype T = { go(): void };\nconst l = async (q: Q): Promise<R> => q.load();\nasync(1);\nconst p = c ? q(1) : r(2);\nm.e = function () { s(1); };\n"
    assert found(source, "typescript") == ["f", "q.load", "async", "q", "r", "s"]
    assert found("class A {\n  val x: Int get() = y()\n  constructor(a: B) { z() }\n}\n", "kotlin") == ["y", "z"]
    assert found("struct S {\n  init(a: B) { z() }\n  func f() { self.init(a: g()) }\n}\n", "swift") == ["z", "self.init", "g"]


def test_trailing_lambdas_are_calls():
    kotlin = "class A : B {\n  init { s() }\n  fun go() = run { items.map { x -> f(x) }.filter { it > 1 } }\n  fun h(): Int {\n    if (ok) retry { 1 } else { 2 }\n    try { a() } finally { b() }\n    val z = lazy { 3 }\n    when (x) { 1 -> other { } }\n    return with(x) { y }\n  }\n  companion object { }\n}\nobject N { }\n"
    assert found(kotlin, "kotlin") == ["s", "run", "items.map { x -> f(x) }.filter", "items.map", "f", "retry", "a", "b", "lazy", "other", "with"]
    swift = "struct S: P {\n  var x: Int { return 1 }\n  func f() -> Int {\n    if flag { a() } else { b() }\n    for i in items { c(i) }\n    guard ok else { return 1 }\n    let v = items.map { $0 + 1 }\n    queue.async { self.done() }\n    switch x { case 1: break }\n    return v.reduce(0) { $0 }\n  }\n  deinit { }\n}\nextension S { }\n"
    assert found(swift, "swift") == ["a", "b", "c", "items.map", "queue.async", "self.done", "v.reduce"]
