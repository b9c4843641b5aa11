"""Guards that files pass on, against a plain walk of the same graph."""

import random

from auditgrid.config import Config
from auditgrid.operators import audit, modules
from auditgrid.schema import FILES_DDL

ROUTE = "import {{ {names} }} from '{spec}';\nexport async function GET(req) {{\n  {call};\n  return db.all();\n}}\n"


def frame(spark, rows, repo="r"):
    return spark.createDataFrame([(i, repo, p, c) for i, (p, c) in enumerate(rows)], FILES_DDL).repartition(3)


def found(spark, files, **more):
    rows = audit.audit(files, Config(rules=("missing-auth",)), follow_imports=True, **more).collect()
    return sorted((r.repo or "", r.relative_path) for r in rows)


def test_a_guard_that_another_file_passes_on(spark):
    rows = [
        ("src/lib/check.ts", "import { getServerSession } from 'next-auth';\nexport async function secure(r) {\n  const s = await getServerSession();\n  if (!s) throw new Error('no');\n}\nexport const fine = () => 1;\n"),
        ("src/lib/index.ts", "export { secure as check } from './check';\nexport * from './more';\n"),
        ("src/lib/more.js", "const { secure } = require('./check.ts');\nexport default function wrap(h) { return (r) => { secure(r); return h(r); }; }\nexport const second = async (r) => secure(r);\nfunction lost() { return 1; }\nexport { lost as found };\n"),
        ("app/api/a/route.ts", ROUTE.format(names="check", spec="@/lib", call="await check(req)")),
        ("app/api/b/route.ts", ROUTE.format(names="check as c", spec="../../../src/lib/index", call="c(req)")),
        ("app/api/c/route.ts", ROUTE.format(names="second", spec="@/lib", call="[1].map((x) => { second(req); })")),
        ("app/api/d/route.ts", "import * as lib from '@/lib';\nexport const GET = async (req) => { lib.second(req); return 1; };\n"),
        ("app/api/e/route.ts", "import w from '@/lib/more';\nexport const GET = w(async (req) => { return 1; });\n"),
        ("app/api/f/route.ts", "import w from '@/lib/more';\nimport { other } from './gone';\nexport const GET = other(async (req) => { return 1; });\n"),
        ("app/api/open1/route.ts", ROUTE.format(names="fine", spec="@/lib/check", call="fine(req)")),
        ("app/api/open2/route.ts", ROUTE.format(names="found", spec="@/lib", call="found(req)")),
        ("app/api/open3/route.ts", ROUTE.format(names="check", spec="package", call="check(req)")),
        ("app/api/open4/route.ts", "import { check } from '@/lib';\nconst other = () => check();\nexport async function GET(req) { return db.all(); }\n"),
    ]
    open_ = sorted(("r", f"app/api/{x}/route.ts") for x in ("f", "open1", "open2", "open3", "open4"))
    both = frame(spark, rows).union(frame(spark, rows[3:5], "other")).union(frame(spark, [*rows[:2], rows[3]], None))
    assert found(spark, both) == sorted(open_ + [("other", "app/api/a/route.ts"), ("other", "app/api/b/route.ts")])
    assert modules.guarded_functions(frame(spark, rows).where("false")).count() == 0
    # Without the files around, a name that says nothing guards nothing; with a name of the project's own it does.
    assert found(spark, frame(spark, rows[3:4])) == [("r", "app/api/a/route.ts")]
    assert modules.guarded_functions(frame(spark, [*rows[:1], ("x.js", None), (None, "y")]), ("fine",)).count() == 1


def test_random_graphs_equal_a_plain_walk(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for repo in range(6):
        n = 8
        names = {m: [f"fn{m}x{j}" for j in range(3)] for m in range(n)}
        path = {m: f"src/d{m % 3}/m{m}.ts" for m in range(n)}
        gives: dict = {m: {f: ("f", m, f) for f in names[m]} for m in range(n)}
        stars: dict = {m: [] for m in range(n)}
        texts, calls, guards = {}, {}, set()
        for m in range(n):
            head, body = [], []
            other = rnd.randrange(n)
            spec = f"../d{other % 3}/m{other}"
            if rnd.random() < 0.6:
                name = rnd.choice(names[other])
                head.append(f"export {{ {name} as via{m} }} from '{spec}';")
                gives[m][f"via{m}"] = ("s", other, name)
            if rnd.random() < 0.4:
                head.append(f"export * from '{spec}';")
                stars[m].append(other)
            source = rnd.randrange(n)
            wanted = rnd.choice([*names[source], f"via{source}", f"via{rnd.randrange(n)}"])
            head.append(f"import {{ {wanted} as in{m} }} from '@/d{source % 3}/m{source}';")
            for f in names[m]:
                does = [rnd.choice([f"in{m}()", f"{rnd.choice(names[m])}()", "other()", "getSession()" if rnd.random() < 0.3 else "x()"])]
                if "getSession()" in does:
                    guards.add(("f", m, f))
                calls["f", m, f] = [("s", source, wanted) if d == f"in{m}()" else ("f", m, d[:-2]) for d in does if d[:-2] in (f"in{m}", *names[m])]
                body.append(f"export function {f}(a) {{\n  {'; '.join(does)};\n}}")
            texts[m] = "\n".join(head + body) + "\n"

        def reaches(node, seen=frozenset()):
            if node in seen:
                return False
            if node in guards:
                return True
            seen |= {node}
            kind, m, name = node
            if kind == "f":
                return any(reaches(x, seen) for x in calls.get(node, ()))
            nexts = [gives[m][name]] if name in gives[m] else []
            return any(reaches(x, seen) for x in nexts + [("s", t, name) for t in stars[m]])

        rows += [(repo * 100 + m, f"r{repo}", path[m], texts[m]) for m in range(n)]
        want |= {(f"r{repo}", path[m], f) for m in range(n) for f in names[m] if reaches(("f", m, f))}
    got = {(r.repo, r.relative_path, r.name) for r in modules.guarded_functions(spark.createDataFrame(rows, FILES_DDL)).collect()}
    assert got == want and 10 < len(want) < 140
