"""What the lexer blanks, which scopes it leaves, and the joins of scopes with places."""

import random
import time

from pyspark.sql import functions as F

from auditgrid.config import Config
from auditgrid.operators import audit, blocks, scopes
from auditgrid.schema import FILES_DDL


def quiet(spark, texts):
    rows = spark.createDataFrame([(i, "r", "a.js", t) for i, t in enumerate(texts)], FILES_DDL)
    return [(r.code, r.plain) for r in blocks.quieted(rows).orderBy("file_id").collect()]


def scanned(spark, texts):
    """Code and scopes of each text, the scopes with their own code."""
    rows = spark.createDataFrame([(i, "r", "a.js", t) for i, t in enumerate(texts)], FILES_DDL)
    return [(r.code, [(b.kind, b.name, b.exported, r.code[b.start : b.stop]) for b in r.blocks]) for r in blocks.with_blocks(rows).orderBy("file_id").collect()]


def blank(text):
    return "".join("\n" if c == "\n" else " " for c in text)


#: Pieces of a script with their code and their plain code.
PIECES = [
    ("foo(1);\n", None, None), ("a / b / c;\n", None, None), ("if (x) { y(); }\n", None, None), ("items.map((k) => k);\n", None, None), ("<br/>;\n", None, None), ("don't;\n", None, None),
    ("// it's `x` /* \"\n", blank("// it's `x` /* \"") + "\n", blank("// it's `x` /* \"") + "\n"), ("/* ' \n ` // */\n", blank("/* ' \n ` // */") + "\n", blank("/* ' \n ` // */") + "\n"),
    ("x = 'a\"b`c//';\n", None, "x = '       ';\n"), ("y = \"a'b\\\"/*\";\n", None, "y = \"       \";\n"), ("z = `a'b\n\"//`;\n", None, "z = `   \n   `;\n"),
    ("w = /a'[/`]b/g.test(v);\n", None, "w = /       /g.test(v);\n"), ("t = `p ${f({ k: 1 })} q`;\n", None, "t = `  ${f({ k: 1 })}  `;\n"), ("u = `p ${g('}')} q`;\n", None, f"u = `{' ' * 13}`;\n"),
    ("if (x) /`/.test(y);\n", None, "if (x) / /.test(y);\n"), ("<p>one ` only</p>;\n", None, None), ("return /['\"]/;\n", None, "return /    /;\n"), ("s = `a ${b ? `c` : ``} d`;\n", None, f"s = `{' ' * 19}`;\n"),
]


def test_quiet_code_equals_its_pieces(spark):
    rnd = random.Random(4)
    picks = [[p] for p in PIECES] + [[rnd.choice(PIECES) for _ in range(rnd.randrange(2, 60))] for _ in range(60)]
    got = quiet(spark, ["".join(t for t, *_ in pick) for pick in picks])
    for pick, (code, plain) in zip(picks, got, strict=True):
        assert plain == "".join(t if p is None else p for t, _, p in pick), pick
        assert code == "".join(t if c is None else c for t, c, _ in pick), pick
    assert quiet(spark, ["", None, "'open", "/* open", "`open", "x"]) == [("", ""), (None, None), ("'open", "'open"), ("       ", "       "), ("`open", "`open"), ("x", "x")]


CASES = [
    ("export default async (req, res) => { a(); }", [("function", "default", True, "{ a(); }")]),
    ("export async function GET<T>(r: R<T>) { a(); }", [("function", "GET", True, "{ a(); }")]),
    ("export async function GET(r): Promise<{ a: string }> { requireAuth(); }", [("function", "GET", True, "{ requireAuth(); }")]),
    ("const f = (a: string): { b: number } => { c() }", [("function", "f", False, "{ c() }")]),
    ("class A { m(a = f(1)) { x(); } async n(): Promise<void> { y(); } }", [("function", "m", False, "{ x(); }"), ("function", "n", False, "{ y(); }")]),
    ("do { a() } while (x);\nnext();", [("loop", "anonymous", False, "{ a() }")]),
    ("if (a) { b() } while (c) { d() }", [("loop", "anonymous", False, "{ d() }")]),
    ("for (const y of x) g(y);\nfor await (const z of x) { h(z); }", [("loop", "anonymous", False, "g(y)")]),
    ("export const PUT = wrap(async (a) => { b(); });", [("function", "PUT", True, "wrap(async (a) => { b(); }")]),
    ("export const GET = withAuth(handler);", [("function", "GET", True, "withAuth(handler)")]),
    ("export const GET = compose(a, async (r) => { x() })", [("function", "GET", True, "compose(a, async (r) => { x() })"), ("function", "anonymous", False, "{ x() }")]),
    ("const g = async x =>\n  db.find(x)\n    .then(y => y.z)\nnext()", [("function", "g", False, "db.find(x)\n    .then(y => y.z)"), ("function", "anonymous", False, "y.z")]),
    ("items.map((k) => db.get(k)); const h = (i) => i.id;", [("callback", "anonymous", False, "db.get(k)"), ("function", "h", False, "i.id")]),
    ("const a = b => c => d, e = 1;", [("function", "a", False, "c => d"), ("function", "anonymous", False, "d")]),
    ("if (a) { b() } else if (c(d)) { e() } switch (x) { case 1: f() }", []),
    ("function f( {", []), ("}}) function f() { a() }", [("function", "f", False, "{ a() }")]), ("function f() { a(", [("function", "f", False, "{ a(")]),
]


def test_scopes(spark):
    for (text, want), (_, got) in zip(CASES, scanned(spark, [t for t, _ in CASES]), strict=True):
        assert got == want, text


BEFORE = ["const r = /`/;", "const p = /[/*]/;", "const q = a / b; // '", "const s = `a ${f({x: `}`})} b`;", "const t = <p>don't {a} won't</p>;", "return /'/.test(x) ? '{' : `}`;", "const u = \"//\"; /* { */", "<br/> /* ' */", "if (x) /`/.test(y)", "<p>one ` here</p>; const v = `w`;"]


def test_the_scanner_sees_functions_behind(spark):
    for before, (_, got) in zip(BEFORE, scanned(spark, [b + "\nexport async function GET() { return { a: 1 }; }\nconst z = `x`; /* y */" for b in BEFORE]), strict=True):
        assert [b for b in got if b[1] == "GET"] == [("function", "GET", True, "{ return { a: 1 }; }")], before


def test_rules_on_ordinary_handlers(spark):
    handlers = [
        ("export async function GET<T>(req: R<T>) { return db.all(); }", True), ("export async function GET(req): Promise<{ a: string }> { requireAuth(); return x; }", False),
        ("if (x) /`/.test(y)\nexport async function GET() { return 1; }\nconst z = `x`;", True), ("export const GET = withAuth(async (r) => ({}));", False), ("export const POST = make(async (r) => { return 1; });", True),
    ]
    rows = spark.createDataFrame([(i, "r", f"app/api/h{i}/route.ts", t) for i, (t, _) in enumerate(handlers)], FILES_DDL)
    got = {r.file_id for r in audit.audit(rows, Config(rules=("missing-auth",))).collect()}
    assert got == {i for i, (_, wanted) in enumerate(handlers) if wanted}


def test_rules_about_the_scope_around(spark):
    text = "async function f(ids) {\n  for (const i of ids) {\n    await db.user.find(i); await db.user.find(i);\n    const g = async () => {\n      await x();\n    };\n  }\n  do { await y(); } while (a);\n}\nawait z();\nconst p = new Pool();\nconst q = () => new Pool();\nids.map(async (i) => {\n  return prisma.a.find(i);\n});\n"
    got = audit.audit(spark.createDataFrame([(1, None, "src/a.js", text), (1, "r", "src/a.js", text)], FILES_DDL), Config(rules=("perf-n-plus-one", "perf-no-await-parallel", "perf-db-client-per-request", "weak-hashing", "eval-usage"))).collect()
    for repo in (None, "r"):
        assert sorted((r.rule_id, r.line) for r in got if r.repo == repo) == [("perf-db-client-per-request", 12), ("perf-n-plus-one", 3), ("perf-n-plus-one", 14), ("perf-no-await-parallel", 3), ("perf-no-await-parallel", 8)]


PIECES_WITHOUT_END = ["a => ", "f(", "((((", "{}", "a<b<", "x\n", "a$", "f(x,", "export const A = ", "(a) => ", "for (", "\n   ", "const a: ", "`", "'", "/[", "`${", "(/[", "/*", "= /a", "x' "]


def test_half_a_megabyte_of_anything(spark):
    """Each piece over and over; a scanner that looks ahead to the end from every place would take hours."""
    rows = spark.createDataFrame([(i, "r", "a.js", p * (2**19 // len(p))) for i, p in enumerate(PIECES_WITHOUT_END)], FILES_DDL).repartition(4)
    began = time.monotonic()
    got = blocks.with_blocks(rows).select("file_id", F.length("code") == F.length("content"), F.size("blocks")).collect()
    assert len(got) == len(PIECES_WITHOUT_END) and all(r[1] for r in got)
    assert time.monotonic() - began < 120


def test_every_place_gets_the_scopes_around_it(spark):
    """Against a comparison of every place with every scope."""
    rnd = random.Random(2)
    parts = ["function f%d() {", "for (;;) {", "items.map((x) => {", "if (a) {", "} ", "} ", "call%d(1); ", "a.b.c(2); ", "const g%d = (x) => h(x);\n", "while (b) k();\n"]
    texts = ["".join(p % i if "%d" in p else p for i, p in enumerate(rnd.choice(parts) for _ in range(rnd.randrange(1, 80)))) for _ in range(40)]
    rows = spark.createDataFrame([(i % 30, None if i >= 30 else "r", "a.js", t) for i, t in enumerate(texts)], FILES_DDL)
    got = {(r.file_id, r.repo, r.pos, r.callee, r.function, r.function_pre, r.loop_pre) for r in scopes.call_scopes(rows).collect()}
    want = set()
    spots = blocks.with_blocks(rows).select("file_id", "repo", "blocks", F.explode(scopes.calls(F.col("code"))).alias("c")).collect()
    for r in spots:
        around = [b for b in r.blocks if b.start <= r.c.pos < b.stop]
        function = max((b for b in around if b.kind != "loop"), key=lambda b: b.start, default=None)
        loop = max((b.start for b in around if b.kind == "loop"), default=None)
        want.add((r.file_id, r.repo, r.c.pos, r.c.callee, function and function.name, function and function.start, loop))
    assert got == want and len(want) > 300


def test_unguarded_places(spark):
    text = "function a() { risk(1); }\nfunction b() { guard(); risk(2); items.map((x) => { risk(3); }); }\nrisk(4); guard();\n"
    rows = spark.createDataFrame([(1, "r", "a.js", text), (1, None, "a.js", text), (2, "r", "b.js", None), (3, "r", "c.js", "")], FILES_DDL)
    got = scopes.unguarded(rows, [(r"\brisk\s*\(", "")], [(r"\bguard\s*\(", "")]).collect()
    assert sorted((r.repo or "", text[r.pos : r.pos + 7], r.function) for r in got) == sorted((repo, f"risk({n})", f) for repo in ("", "r") for n, f in ((1, "a"), (3, "anonymous"), (4, None)))
