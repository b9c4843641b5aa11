"""What the passes over files cost: each reads the files once, and what goes before expressions loses no finding."""

import random
import re

import pytest

from auditgrid.functions import text
from auditgrid.operators import audit, blocks, match
from auditgrid.plans.corpus import SNIPPETS
from auditgrid.rules import catalog, file_checks, scope_rules
from auditgrid.schema import FILES_DDL

CHECKS = [c for r in catalog.IDS for c in file_checks.CHECKS.get(r, ())]
PASSES = {
    "lines": lambda f: match.line_findings(f, audit.LINE_RULES, catalog.SEVERITY),
    "content": lambda f: match.content_findings(f, audit.CONTENT_RULES, catalog.SEVERITY),
    "files": lambda f: match.file_findings(f, audit.FILE_RULES, CHECKS, catalog.SEVERITY),
    "code": lambda f: match.code_findings(f, scope_rules.SCOPE_RULES, scope_rules.CODE_RULES, catalog.SEVERITY),
}


@pytest.mark.parametrize("name", PASSES)
def test_a_pass_reads_the_files_once(spark, tmp_path, name):
    spark.createDataFrame([(1, "r", "a.js", "x")], FILES_DDL).write.parquet(f"file://{tmp_path}/files")
    plan = PASSES[name](spark.read.parquet(f"file://{tmp_path}/files"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_scopes_around_places_are_the_innermost():
    rnd, n = random.Random(3), 0
    for _ in range(300):
        made: list[dict] = []

        def nest(at, stop, depth):
            while at + 2 < stop and depth < 5 and rnd.random() < 0.7:
                a = rnd.randrange(at, stop - 1)
                b = rnd.randrange(a + 1, stop)
                made.append({"kind": rnd.choice(["loop", "function", "callback"]), "start": a, "stop": b})
                nest(a + 1, b, depth + 1)
                at = b + 1

        nest(0, 60, 0)
        places = [rnd.randrange(0, 64) for _ in range(12)]
        for place, got in zip(places, blocks.around(made, places)):
            over = [s for s in made if s["start"] <= place < s["stop"]]
            inner = max(over, key=lambda s: s["start"], default=None)
            assert got == {"kind": inner and inner["kind"], "inside": any(s["kind"] != "loop" for s in over)}
            n += inner is not None
    assert n > 300


def test_conditions_hold_wherever_an_expression_matches():
    def holds(conditions, low):
        return all(any(x.lower() in low for x in c) if isinstance(c, frozenset) else any(holds(w, low) for w in c) for c in conditions)

    rules = (*audit.LINE_RULES, *audit.CONTENT_RULES, *audit.FILE_RULES, *scope_rules.SCOPE_RULES, *scope_rules.CODE_RULES)
    asked = {(t.regex, t.flags) for r in rules for t in (*r.gates, *getattr(r, "any_gate", ())) if t.on == "content"}
    asked |= {(t.regex, t.flags) for r in audit.FILE_RULES for b in r.branches for t in b.tests if t.on == "content"}
    asked |= {(p.regex, p.flags) for r in (*audit.LINE_RULES, *audit.CONTENT_RULES) for p in r.patterns} | {(r.regex, r.flags) for r in scope_rules.CODE_RULES}
    asked |= {x for r in scope_rules.SCOPE_RULES for x in (*r.has, *r.hits)}
    n = 0
    for regex, flags in asked:
        for _, code in SNIPPETS:
            if re.search(regex, code, re.ASCII | (re.I if "i" in flags else 0)):
                n += 1
                assert holds(text._conditions_of(regex), code.lower()), regex
    assert n > 300
    assert text._conditions_of(r"export\s+function\s+POST|\.post\(")[-1:] == [[[frozenset({"export"}), frozenset({"function"}), frozenset({"POST"})], [frozenset({".post("})]]]


def test_literals_are_searched_in_any_file(spark):
    rows = [(1, "r", "src/a.js", "eval(x);"), (2, "r", "src/b.js", "EVAL"), (3, "r", "src/c.js", ""), (3, "r", "src/c.js", "eval(y);\neval(z);"), (3, "r", "src/c.js", "eval(y);\neval(z);")]
    got = audit.run_rules(spark.createDataFrame(rows, FILES_DDL), ["eval-usage"]).collect()
    assert sorted((r.file_id, r.line) for r in got) == [(1, 1), (3, 1), (3, 1), (3, 2), (3, 2)]


def test_equal_files_give_single_findings_once(spark):
    code = "async function all(ids) {\n  for (const id of ids) { await db.user.get(id); await db.user.get(id); }\n}\neval(x);"
    files = spark.createDataFrame([(1, "r", "src/a.js", code), (1, "r", "src/a.js", code)], FILES_DDL)
    got = sorted((r.rule_id, r.line) for r in audit.run_rules(files, ["perf-no-await-parallel", "eval-usage"]).collect())
    assert got == [("eval-usage", 4), ("eval-usage", 4), ("perf-no-await-parallel", 2)]
