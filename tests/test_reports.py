import json

from pyspark.sql import functions as F

from auditgrid.operators import audit, dependencies, portfolio, report
from auditgrid.plans import registry
from auditgrid.schema import FILES_DDL, FINDINGS_DDL
from auditgrid.sources import sinks


def findings(spark, rows):
    full = [(i, repo, f"f{i}.js", rule, severity, "m", 1, e, 0) for i, (repo, rule, severity, e) in enumerate(rows)]
    return audit.enriched(spark.createDataFrame(full, FINDINGS_DDL))


def test_grades(spark):
    cases = [(1, 0, 0, "F", "F"), (0, 6, 0, "D", "D"), (0, 5, 0, "C", "D"), (0, 4, 0, "C", "D"), (0, 3, 1, "C", "C"), (0, 2, 0, "C", "C"), (0, 1, 0, "C", "B"), (0, 0, 1, "B", "A"), (0, 0, 0, "A", "A")]
    df = spark.createDataFrame(cases, "c int, w int, i int, project string, repo string")
    got = df.select("project", "repo", report.project_grade(F.col("c"), F.col("w"), F.col("i")), report.repo_grade(F.col("c"), F.col("w"))).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)


def test_aggregates(spark):
    f = findings(spark, [("a", "eval-usage", "critical", "x"), ("a", "weak-hashing", "warning", None), ("b", "a11y-no-lang", "warning", "x"), ("b", "hardcoded-ip", "info", "x")])
    assert report.by_severity(f).first()[:5] == (4, 1, 2, 1, "F")
    assert {r.owasp_category: r.n for r in report.by_owasp(f).collect() if r.n} == {"A03:2021": 1, "A02:2021": 1, "A05:2021": 1, "Other": 1}
    assert report.by_owasp(f).count() == 11
    assert {r.band: r.n for r in report.cvss_histogram(f).collect()} == {"critical": 0, "high": 1, "medium": 1, "low": 1, "info": 1}
    assert report.severity_bar(report.by_severity(f)).first() == (4, 10, 20, 10)
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    grades = report.repo_grades(f, repos)
    assert [tuple(r) for r in portfolio.worst_first(grades).collect()] == [("a", "F", 1, 1, 0, 2), ("b", "B", 0, 1, 1, 2), ("c", "A", 0, 0, 0, 0)]
    errors = spark.createDataFrame([("x", "access-denied"), ("y", "empty")], "repo string, kind string")
    s = portfolio.summary(grades, errors).first()
    assert (s.total, s.grade_a, s.grade_f, s.skipped, s.blocked, s.attempted, s.exit_code) == (3, 1, 1, 2, 1, 5, 1)
    assert portfolio.summary(grades.where("false"), errors).first().exit_code == 2
    none = f.where("false")
    assert report.by_severity(none).first()[:5] == (0, 0, 0, 0, "A") and report.severity_bar(report.by_severity(none)).first()[1:] == (0, 0, 0)
    assert [r.rule_id for r in report.fix_guide(f).collect()] == ["eval-usage", "a11y-no-lang", "weak-hashing"][:1] + [r.rule_id for r in report.fix_guide(f).collect()][1:]


def test_errors_and_guard(spark):
    got = {r.repo: (r.kind, r.rate_limited) for r in registry._errors(spark).collect()}
    assert got == {"a/b": ("rate-limited", True), "a/c": ("rate-limited", True), "a/d": ("access-denied", False), "a/e": ("not-found", False), "a/f": ("auth-required", False), "a/g": ("empty", False), "a/h": ("error", False), "a/i": ("rate-limited", True), "a/j": ("error", False)}
    df = spark.createDataFrame([(75, 100, False, True), (74, 100, False, False), (1, 100, True, True), (0, 0, False, True)], "f int, s int, force boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", portfolio.accepts(F.col("f"), F.col("s"), F.col("force"))).collect())


def test_renderers_escape(spark, tmp_path):
    f = findings(spark, [("a", "eval-usage", "critical", "\x1b[31m<b>\x07&\x9b'\"")])
    assert "\x1b[31m<b>" not in sinks.terminal_lines(f).first().text and "<b>&'" in sinks.terminal_lines(f).first().text
    assert "&lt;b&gt;" in sinks.html_lines(f).first().text and "<b>" not in sinks.html_lines(f).first().text
    assert sinks.write_report(f, f"file://{tmp_path}/out", "json")["critical"] == 1
    text = "".join(r.value for r in spark.read.text(f"file://{tmp_path}/out/report").collect())
    assert json.loads(text)["findings"][0]["rule_id"] == "eval-usage"
    for kind in sinks.RENDERERS:
        assert sinks.RENDERERS[kind](f.where("false")).count() == 0


def test_gate(spark, tmp_path):
    spark.createDataFrame([(i, "a b", 25) for i in range(8)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.name: (r.level, r.age_hours) for r in registry._gate(spark, f"file://{tmp_path}").collect()}
    assert got == {"keyv": ("block", None), "left-pad-a-b-1": ("ok", 5025.0), "fresh-a-b-2": ("warn", 35.0), "hooked-a-b-3": ("warn", 925.0), "hijack-a-b-4": ("block", 26.0), "lost-a-b-5": ("warn", None), "undated-a-b-6": ("ok", None), "edge-a-b-7": ("ok", 72.0)}
    assert tuple(registry._gate_status(spark, f"file://{tmp_path}").first()) == (8, 2, 3, 2)
    want = {"lodash": True, "lodash@4.17.21": True, "@scope/pkg": True, "a;rm -rf": False, "Upper": False, "@x/y@^1.0": True, "": False, "a\n": False, None: False}
    specs = spark.createDataFrame([(x,) for x in want], "spec string").select("spec", dependencies.valid_spec(F.col("spec")).alias("valid")).collect()
    assert {r.spec: r.valid for r in specs} == want
    tree = dependencies.resolved_tree(spark.createDataFrame([("add a 1.0.0",), (" add @b/c 2.0.0 ",), ("added 3 packages",)], "line string"))
    assert sorted(map(tuple, tree.collect())) == [("@b/c", "2.0.0"), ("a", "1.0.0")]


def test_dependencies(spark):
    rows = [
        (1, "a", "package.json", '{"dependencies": {"x": "*", "y": "^1"}, "devDependencies": {"x": "1.0.0", "z": "latest"}}'), (2, "b", "package.json", '{"dependencies": {"x": "*"}}'), (3, "b", "yarn.lock", ""),
        (4, "c", "package.json", "broken"), (5, "d", "requirements.txt", "flask\n# no\nrequests==1\n\ndjango<4\nx>=1"), (6, "e", "package.json", "{}"),
    ]
    got = sorted((r.repo, r.severity, r.message) for r in dependencies.dependency_findings(spark.createDataFrame(rows, FILES_DDL)).collect())
    assert got == [("a", "info", "There is no lock file"), ("a", "warning", "z takes any version: latest"), ("d", "info", "django isn't pinned"), ("d", "info", "flask isn't pinned")]
    said = '{"vulnerabilities":{"a":{"severity":"high","range":"<2","via":[{"title":"Bad"},"x",{"name":"b"}],"fixAvailable":true},"c":{"severity":"moderate","via":["y"]},"d":{"severity":"low","range":"1","via":"z"}}}'
    audits = spark.createDataFrame([(1, "r", "package.json", said), (2, "s", "package.json", "{broken"), (3, "t", "package.json", None)], "file_id long, repo string, relative_path string, raw_json string")
    npm = {r.message: r.severity for r in dependencies.npm_audit_findings(audits).collect()}
    assert npm == {"a@<2: Bad, b": "critical", "c@unknown: moderate": "warning", "d@1: z": "info"}
