"""No input ends an audit: long lines and tags, scripts that the scanner fails on, and what the scanner tells apart."""

import time
from collections import Counter

import pytest

from auditgrid.config import Config
from auditgrid.operators import audit, blocks, portfolio, report
from auditgrid.rules import catalog
from auditgrid.rules.spec import ContentRule, FileBranch, FileRule, LineRule, Pattern, UserRule, path
from auditgrid.schema import FILES_DDL
from auditgrid.sources import files as S
from auditgrid.sources import sinks
from auditgrid.sources.shared import shared_dir

N = 20_000
#: Each once ended Spark with a StackOverflowError at a few thousand characters, or repeats groups in the same way.
LONG = (
    ("a.html", "<img " + "x" * N + ">"), ("b.html", "<button " + "a=1 " * (N // 4) + ">" + "<i></i> " * (N // 8) + "</button>"), ("c.html", "<button>" + " " * N + "</button>"), ("d.tsx", "<div {" + "{}" * (N // 2) + "}>"),
    ("e.js", "document.write('" + "a" * N + "');"), ("f.js", "document.write('" + "\\a" * (N // 2) + "');"), ("g.js", "el.innerHTML = `" + "$a" * (N // 2) + "`;"), ("h.js", "createHash('md5') // audit-ignore a" + ", a" * N),
    ("i.ts", "'use server'" + "/* x */ " * (N // 8)), ("j.ts", "/* x */" * (N // 7) + "'use server'"), ("k.js", "(" * N), ("l.js", "{" * N), ("m.js", "/* " * (N // 3)), ("n.js", "`" * (N + 1)), ("o.js", "createHash('md5')" + " " * N + "x"),
)
RULES = ("a11y-img-no-alt", "a11y-button-no-name", "a11y-click-no-keyboard", "missing-sri", "no-input-validation", "nextjs-server-action-exposure", "weak-hashing", "eval-usage")


def test_long_lines_and_tags_end_no_audit(spark):
    files = spark.createDataFrame([(i, "r", p, text) for i, (p, text) in enumerate(LONG)], FILES_DDL).repartition(4)
    began = time.monotonic()
    found = {(r.relative_path, r.rule_id) for r in audit.audit(files, Config(rules=RULES)).select("relative_path", "rule_id").collect()}
    assert {("a.html", "a11y-img-no-alt"), ("b.html", "a11y-button-no-name"), ("c.html", "a11y-button-no-name"), ("h.js", "weak-hashing"), ("o.js", "weak-hashing")} <= found
    assert time.monotonic() - began < 60


def test_a_script_that_cannot_be_scanned_does_not_end_the_audit(monkeypatch):
    def fails(plain):
        if "broken" in plain:
            raise RecursionError
        return real(plain)

    real = blocks.scopes
    monkeypatch.setattr(blocks, "scopes", fails)
    assert blocks._safe_scopes("broken") == [] and blocks._safe_scopes("function f() {}") and blocks._safe_scopes(None) == []


def test_two_files_of_one_number_keep_their_own_comments(spark):
    code = "createHash('md5')"
    rows = [(1, "a", "x.js", code + " // audit-ignore"), (1, "b", "x.js", code), (1, "a", "y.js", code), (2, None, "x.js", code + " // audit-ignore")]
    got = audit.audit(spark.createDataFrame(rows, FILES_DDL), Config(rules=("weak-hashing",))).collect()
    assert sorted((r.repo, r.relative_path) for r in got) == [("a", "y.js"), ("b", "x.js")]


def test_folders_are_walked_by_the_executors(spark, tmp_path):
    want = set()
    for p in ("a.js", "src/b.ts", "src/deep/er/c.py", "node_modules/x/d.js", "src/node_modules/e.js", ".env", "img.png", "empty.js", "skip/f.js"):
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("" if p == "empty.js" else p)
        if "node_modules" not in p and p not in ("img.png", "empty.js", "skip/f.js"):
            want.add(p)
    got = S.folder(spark, str(tmp_path), "r", ("skip/",)).collect()
    assert {r.relative_path for r in got} == want and all(r.content == r.relative_path for r in got)
    assert len({r.file_id for r in got}) == len(want) and {r.file_id for r in got} == {S.file_id("r", p) for p in want}


def test_rules_of_a_project(spark):
    own = (
        UserRule(LineRule("no-todo", (), (Pattern("TODO", "A todo is left"),), ()), "info", "Todo", "Do it."),
        UserRule(ContentRule("no-debugger", (path(r"\.js$"),), (Pattern(r"debugger\s*;", "A debugger statement is left"),)), "warning", "Debugger", "Drop it.", "CWE-489", 3.1, "A05:2021"),
        UserRule(FileRule("no-readme", (path(r"README"),), (FileBranch((), "A readme is here"),)), "critical", "Readme"),
    )
    files = spark.createDataFrame([(1, "r", "a.js", "// TODO x\ndebugger;\ncreateHash('md5')"), (2, "r", "README.md", "x")], FILES_DDL)
    got = {r.rule_id: r for r in audit.audit(files, Config(rules=("weak-hashing",)), extra=own).collect()}
    assert set(got) == {"no-todo", "no-debugger", "no-readme", "weak-hashing"}
    assert (got["no-debugger"].line, got["no-debugger"].severity, got["no-debugger"].cwe_id, got["no-debugger"].owasp_category) == (2, "warning", "CWE-489", "A05:2021")
    assert got["no-todo"].fix == "Do it." and got["no-readme"].rule_ord > len(catalog.IDS)
    with pytest.raises(ValueError):
        audit.run_rules(files, [], extra=(UserRule(LineRule("weak-hashing", (), ()), "info", "x"),))


def findings(spark):
    rows = [(1, "r", "a.js", "createHash('md5')\neval(x + '<b>|\"')"), (2, "r", "b.js", "eval(y)\nconst ip = '8.8.8.8';"), (3, "s", "b.js", "eval(y)"), (4, "s", "b.js", "eval(y)")]
    return audit.audit(spark.createDataFrame(rows, FILES_DDL), Config(rules=("weak-hashing", "eval-usage", "hardcoded-ip")))


def lines_of(spark, found, kind):
    return [r.text for r in sinks.document(found, kind).orderBy(*sinks.ORDER, "text").collect()]


def test_documents(spark):
    import json

    found = findings(spark)
    n = Counter(r.severity for r in found.collect())
    got = json.loads("".join(lines_of(spark, found, "json")))
    assert got["summary"] == {"total": sum(n.values()), "critical": n["critical"], "warning": n["warning"], "info": n["info"], "grade": "F"}
    assert [f["severity"] for f in got["findings"]] == sorted((f["severity"] for f in got["findings"]), key=("critical", "warning", "info").index) and len(got["findings"]) == sum(n.values())
    assert sum(got["owasp"].values()) == sum(n.values()) and got["findings"][0]["prompt"].startswith("Mend this problem in a.js, line 2")
    text = lines_of(spark, found, "markdown")
    assert text[0] == "# Audit: grade F" and text.index(f"## Critical ({n['critical']})") < text.index(f"## Warning ({n['warning']})") < text.index(f"## Info ({n['info']})") < text.index("## OWASP")
    assert sum(x.startswith("### ") for x in text) == n["critical"] + n["warning"] and text[-1].startswith("- A")
    page = "\n".join(lines_of(spark, found, "html"))
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</body></html>") and page.count("<tr>") == 1 + sum(n.values()) and page.count("<table>") == page.count("</table>") == 1 and "<b>" not in page
    seen = lines_of(spark, found, "terminal")
    assert seen[0].startswith("Grade F  [#") and sum("(" in x and "\x1b[1m" in x for x in seen) == 4 and "OWASP" in seen
    none = found.where("false")
    assert json.loads("".join(lines_of(spark, none, "json"))) == {"summary": {"total": 0, "critical": 0, "warning": 0, "info": 0, "grade": "A"}, "findings": [], "owasp": {}}
    for kind in sinks.RENDERERS:
        assert lines_of(spark, none, kind)


def test_guide_lists_files(spark):
    got = report.fix_guide_files(findings(spark)).collect()
    assert [(r.rule_id, r.repo, r.relative_path, r.n) for r in got][:3] == [("eval-usage", "r", "a.js", 1), ("eval-usage", "r", "b.js", 1), ("eval-usage", "s", "b.js", 2)]


def test_portfolio_report_and_saved_list(spark, tmp_path):
    grades = spark.createDataFrame([("a", "F", 2, 1, 0, 3), ("b", "A", 0, 0, 0, 0)], "repo string, grade string, criticals long, warnings long, infos long, total long")
    errors = spark.createDataFrame([("c", "Not found or empty", "not-found")], "repo string, label string, kind string")
    got = [r.text for r in portfolio.report(grades, errors).collect()]
    assert got[1] == "Scanned: 2 of 3; failed: 1 (0 without access)" and got[4:] == ["| Repository | Grade | Critical | Warning | Info |", "|---|---|---|---|---|", "| a | F | 2 | 1 | 0 |", "| b | A | 0 | 0 | 0 |", "## Not scanned", "- c: Not found or empty"]
    (tmp_path / "repos.json").write_text('["o/a", null, "o/b"]')
    (tmp_path / "broken.json").write_text("{")
    assert [r.full_name for r in portfolio.saved_list(spark, str(tmp_path / "repos.json")).collect()] == ["o/a", "o/b"]
    assert portfolio.saved_list(spark, str(tmp_path / "broken.json")).count() == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
