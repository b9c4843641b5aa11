"""Queries over all rules, held against plain counts of the whole audit's findings."""

from collections import Counter, defaultdict

import pytest

from auditgrid.config import Config
from auditgrid.plans import registry
from auditgrid.rules import catalog
from auditgrid.schema import FILES_DDL
from auditgrid.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return registry.queries()["full_audit"](spark, SF).collect()


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_counts_cover_all_rules(spark, found):
    others = {r.rule_id for name in ("rule_git_history_secrets", "dependency_findings") for r in run(spark, name)}
    by_rule = Counter(r.rule_id for r in found)
    assert len(by_rule) > 2 * len(registry.SMALL)
    assert {r.rule_id for r in run(spark, "all_rules_silent_rules")} == {r[1] for r in catalog.ALL} - set(by_rule) - others
    assert {r.rule_id: r.n for r in run(spark, "agg_by_rule")} == dict(by_rule)
    severity = Counter(r.severity for r in found)
    got = run(spark, "all_rules_agg_by_severity")[0]
    assert (got.total, got.critical, got.warning, got.info) == (len(found), severity["critical"], severity["warning"], severity["info"])


def test_grades_cover_all_rules(spark, found):
    counts = defaultdict(Counter)
    for r in found:
        counts[r.repo][r.severity] += 1
    for r in run(spark, "all_rules_portfolio_repo_grades"):
        c, w = counts[r.repo]["critical"], counts[r.repo]["warning"]
        assert (r.criticals, r.warnings, r.grade) == (c, w, "F" if c else "D" if w > 3 else "C" if w > 1 else "B" if w else "A")


def test_stream_counts_middleware_of_other_batches(spark, tmp_path):
    at = f"file://{tmp_path}"
    route = "export async function GET() { return 1; }"
    guard = "import { withAuth } from 'x';\nexport default withAuth(() => 1);\nexport const config = { matcher: ['/api/admin/:path*'] };"
    batches = [[(1, "a", "app/api/admin/x/route.ts", route), (2, "b", "middleware.ts", guard)], [(3, "a", "middleware.ts", guard), (4, "b", "app/api/admin/x/route.ts", route), (5, "c", "app/api/admin/x/route.ts", route)]]
    for rows in batches:
        spark.createDataFrame(rows, FILES_DDL).coalesce(1).write.mode("append").parquet(f"{at}/landing")
        incremental.audit_stream(incremental.file_stream(spark, f"{at}/landing", 1), f"{at}/out", f"{at}/state", Config(rules=("missing-auth",))).awaitTermination()
    got = {r.repo: r.severity for r in incremental.findings(spark, f"{at}/out").collect()}
    assert got == {"a": "warning", "b": "warning", "c": "critical"}


def test_stream_finds_what_the_batch_finds(spark, found):
    key = lambda r: (r.file_id, r.rule_id, r.severity, r.message, r.line or 0)
    assert Counter(map(key, run(spark, "all_rules_stream_audit"))) == Counter(map(key, found))
