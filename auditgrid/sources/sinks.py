"""Reports: findings as JSON, Markdown, HTML and terminal lines, written by the executors.

Each finding is rendered by an expression, and a report is a table of lines in order, head, sections and
sums included, so no report passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrid.operators.audit import ordered, rank
from auditgrid.operators.report import by_owasp, by_severity, cvss_histogram
from auditgrid.sources.shared import Written

_ANSI = {"critical": "31", "warning": "33", "info": "36"}


def sanitised(text: Column) -> Column:
    """Without terminal control sequences: links, colours, and control characters but tab and line feed."""
    out = F.regexp_replace(text, r"\x1b\]8;[^\x07\x1b]*(?:\x07|\x1b\\)", "")
    out = F.regexp_replace(out, r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)?)", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}]", "")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _place() -> Column:
    return F.concat(sanitised(F.col("relative_path")), F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))


def terminal_lines(findings: DataFrame) -> DataFrame:
    """(severity_rank, repo, file_id, rule_ord, finding_ord, text): one coloured paragraph per finding."""
    colour = F.when(F.col("severity") == "critical", _ANSI["critical"]).when(F.col("severity") == "warning", _ANSI["warning"]).otherwise(_ANSI["info"])
    tags = F.concat_ws(" ", F.when(F.col("cwe_id").isNotNull(), F.concat(F.lit("["), "cwe_id", F.lit("]"))), F.when(F.col("cvss_score").isNotNull(), F.concat(F.lit("CVSS:"), F.col("cvss_score").cast("string"))), F.when(F.col("wcag").isNotNull(), F.concat(F.lit("["), "wcag", F.lit("]"))))
    text = F.concat_ws("\n", F.concat(F.lit("\x1b["), colour, F.lit("m"), F.upper("severity"), F.lit("\x1b[0m "), _place(), F.lit(" "), sanitised(F.col("message")), F.lit(" "), tags), sanitised(F.col("evidence")), F.concat(F.lit("  Fix: "), sanitised(F.col("fix"))))
    return _rendered(findings, text)


def markdown_lines(findings: DataFrame) -> DataFrame:
    """One section per finding; notes are one line without advice."""
    tag = F.coalesce(F.concat(F.lit(" `"), F.coalesce("cwe_id", "wcag"), F.lit("`")), F.lit(""))
    full = F.concat_ws("\n", F.concat(F.lit("### `"), _place(), F.lit("`"), tag), F.concat(F.lit("- **"), sanitised(F.col("message")), F.lit("**")), F.concat(F.lit("- Evidence: `"), sanitised(F.col("evidence")), F.lit("`")), F.concat(F.lit("- Fix: "), sanitised(F.col("fix"))))
    short = F.concat(F.lit("- `"), _place(), F.lit("`: "), sanitised(F.col("message")))
    return _rendered(findings, F.when(F.col("severity") == "info", short).otherwise(full))


def html_lines(findings: DataFrame) -> DataFrame:
    """One table row per finding, escaped."""
    cells = [html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("severity", "repo", "relative_path", "line", "message", "evidence", "cwe_id", "cvss_score", "owasp_category", "fix")]
    return _rendered(findings, F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>")))


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object per finding; fields that are null are left out."""
    fields = ["rule_id", "rule_name", "severity", "message", "repo", "relative_path", "line", "evidence", "fix", "cwe_id", "cvss_score", "owasp_category", "wcag"]
    return _rendered(findings, F.to_json(F.struct(*fields, fix_prompt().alias("prompt"))))


def fix_prompt() -> Column:
    """A request to an assistant to mend one finding."""
    at = F.concat(F.col("relative_path"), F.when(F.col("line").isNotNull(), F.concat(F.lit(", line "), F.col("line").cast("string"))).otherwise(""))
    return F.concat_ws(
        "\n", F.concat(F.lit("Mend this problem in "), at, F.lit(": "), F.col("message"), F.lit(".")), F.concat(F.lit("The code: "), F.col("evidence")), F.concat(F.lit("What to do: "), F.col("fix")),
        F.lit("Change no more than that needs, keep what the code does otherwise, and say what you changed."),
    )


def _rendered(findings: DataFrame, text: Column) -> DataFrame:
    return findings.select(rank(F.col("severity")).alias("severity_rank"), "repo", "relative_path", "file_id", "rule_ord", "finding_ord", text.alias("text"))


RENDERERS = {"terminal": terminal_lines, "markdown": markdown_lines, "html": html_lines, "json": json_lines}
#: The order of a document's lines.
ORDER = ("section", "severity_rank", "repo", "relative_path", "file_id", "place", "rule_ord", "finding_ord", "nth")
_SEVERITIES = ("critical", "warning", "info")
_STYLE = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #999;padding:4px;text-align:left}"


def _line(section: int, place: int, *parts: Column | str, severity_rank: Column | int = 0) -> Column:
    """One line of a document's head, sections or end, as a struct."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    severity_rank = F.lit(severity_rank) if isinstance(severity_rank, int) else severity_rank
    return F.struct(F.lit(section).alias("section"), severity_rank.cast("int").alias("severity_rank"), F.lit(place).alias("place"), text.alias("text"))


def _frame(kind: str, s: DataFrame) -> list[Column]:
    """The lines around the findings, from the summary's columns."""
    c = F.col
    if kind == "markdown":
        table = [_line(0, 3 + i, f"| {x} | ", c(x), " |") for i, x in enumerate(_SEVERITIES)]
        sections = [_line(1, 0, f"## {x.capitalize()} (", c(x), ")", severity_rank=i) for i, x in enumerate(_SEVERITIES)]
        return [_line(0, 0, "# Audit: grade ", c("grade")), _line(0, 1, "| Severity | Findings |"), _line(0, 2, "|---|---|"), *table, *sections, _line(2, 0, "## OWASP")]
    if kind == "html":
        counts = [_line(0, 2 + i, f"<li>{x}: ", c(x), "</li>") for i, x in enumerate(_SEVERITIES)]
        cells = "".join(f"<th>{x}</th>" for x in ("Severity", "Repository", "File", "Line", "Message", "Evidence", "CWE", "CVSS", "OWASP", "Fix"))
        head = [_line(0, 0, f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>Audit</title><style>{_STYLE}</style></head><body>"), _line(0, 1, "<h1>Audit: grade ", c("grade"), "</h1><ul>")]
        return [*head, *counts, _line(0, 9, f"</ul><table><tr>{cells}</tr>"), _line(2, 0, "</table><h2>OWASP</h2><ul>"), _line(3, 0, "</ul></body></html>")]
    if kind == "json":
        return [_line(0, 0, "{\"summary\":", F.to_json(F.struct("total", *_SEVERITIES, "grade")), ",\"findings\":["), _line(2, 0, "],\"owasp\":{"), _line(3, 0, "}}")]
    bar = F.concat(*[F.repeat(F.lit(x), F.when(c("total") > 0, F.floor(40 * c(n) / c("total") + 0.5)).otherwise(0).cast("int")) for x, n in (("#", "critical"), ("+", "warning"), (".", "info"))])
    counts = [x for n in _SEVERITIES for x in (f"  {n} ", c(n))]
    return [_line(0, 0, "Grade ", c("grade"), "  [", bar, "]"), _line(0, 1, "Findings ", c("total"), *counts), _line(2, 0, "OWASP")]


def document(findings: DataFrame, kind: str = "markdown", written: bool = False) -> DataFrame:
    """All lines of a document, with the columns ``ORDER`` that they are to be ordered by, and text.

    markdown: grade, table of counts, a section for each severity, OWASP categories. html: a page of its own. json: one
    object with summary, findings and categories. terminal: a bar and counts, findings by file, categories. No findings: a
    document that says so by its counts. The findings are written once and read for each part, so one audit makes a
    report; ``written`` says that they are a table already.
    """
    findings = findings if written else Written(findings.sparkSession, "report").table(findings, "findings")
    s = by_severity(findings)
    frame = s.select(F.inline(F.array(*_frame(kind, s))))
    o = by_owasp(findings).where("n > 0")
    last = F.max("owasp_category").over(Window.partitionBy())  # eleven rows at most
    label = F.concat("owasp_category", F.lit(" "), "label", F.lit(": "), F.col("n").cast("string"))
    pair = F.concat(F.lit('"'), "owasp_category", F.lit('":'), F.col("n").cast("string"), F.when(F.col("owasp_category") < last, ",").otherwise(""))
    said = {"markdown": F.concat(F.lit("- "), label), "html": F.concat(F.lit("<li>"), label, F.lit("</li>")), "json": pair, "terminal": F.concat(F.lit("  "), label)}[kind]
    owasp = o.select(F.lit(2).alias("section"), F.lit(0).alias("severity_rank"), F.lit(1).alias("place"), F.col("owasp_category").alias("repo"), said.alias("text"))
    lines = RENDERERS[kind](findings).withColumns({"section": F.lit(1), "place": F.lit(1)})
    if kind == "json":  # a comma behind all findings but the last in order
        keys = [c for c in ORDER if c != "nth"]
        lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "text").orderBy("text")))
        place = F.struct(*keys, "nth", "text")
        lines = lines.join(F.broadcast(lines.agg(F.max(place).alias("last"))), F.lit(True)).withColumn("text", F.concat("text", F.when(place < F.col("last"), ",").otherwise(""))).drop("last")
    parts = [lines, frame, owasp]
    if kind == "terminal":  # by file: one head for each, whatever its findings' severities
        files = findings.groupBy("repo", "relative_path", "file_id").agg(F.count(F.lit(1)).alias("n"))
        heads = files.select(F.lit(1).alias("section"), F.lit(0).alias("severity_rank"), F.lit(0).alias("place"), "repo", "relative_path", "file_id", F.concat(F.lit("\x1b[1m"), sanitised(F.concat_ws("/", "repo", "relative_path")), F.lit("\x1b[0m ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
        parts = [lines.withColumn("severity_rank", F.lit(0)), frame, owasp, heads]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("int").alias(c) for c in ORDER], "text")


def write_report(findings: DataFrame, path: str, format: str = "json") -> dict:
    """Write the document's lines in order as text files under ``path``/report, and the summary beside them; the counts. The findings are made once."""
    store = Written(findings.sparkSession, "report")
    findings = store.table(findings, "findings")
    document(findings, format, written=True).orderBy(*ORDER, "text").select("text").write.mode("overwrite").text(f"{path}/report")
    by_severity(findings).write.mode("overwrite").json(f"{path}/summary")
    by_owasp(findings).write.mode("overwrite").json(f"{path}/owasp")
    cvss_histogram(findings).write.mode("overwrite").json(f"{path}/cvss")
    counts = by_severity(findings).first().asDict()
    store.drop()
    return counts


def write_table(findings: DataFrame, path: str) -> None:
    """Findings as Parquet in report order, so that later filters on severity or repository skip row groups."""
    ordered(findings).write.mode("overwrite").parquet(path)
