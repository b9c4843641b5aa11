"""Scans of many repositories: which to scan, what failed, and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditgrid.functions.text import matches

BLOCKED = ("access-denied", "auth-required", "rate-limited")
GRADES = ("A", "B", "C", "D", "F")
#: A discovery with fewer repositories than this share of the saved list isn't trusted.
SHRINK = 0.75


def discovered(repos: DataFrame) -> DataFrame:
    """(full_name, archived, fork): own repositories that are alive."""
    return repos.where(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("fork", F.lit(False))).select("full_name")


def without_output(repos: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Without the repositories that hold reports of past scans, whoever owns them."""
    return repos.where(~F.substring_index("full_name", "/", -1).isin(*names)) if names else repos


def saved_list(spark: SparkSession, path: str) -> DataFrame:
    """(full_name), in the list's order, of a JSON file with an array of names; entries that aren't text don't count, broken JSON has none."""
    text = spark.read.option("wholetext", True).text(path)
    names = F.from_json("value", "array<string>")
    return text.select(F.posexplode(F.coalesce(names, F.array().cast("array<string>"))).alias("place", "full_name")).where("full_name is not null").orderBy("place").select("full_name")


def report(grades: DataFrame, errors: DataFrame, limit: int = 20) -> DataFrame:
    """(section, place, text): the lines of a Markdown report: head, sums, the ``limit`` worst repositories, what failed.

    ``errors`` has (repo, label, kind).
    """
    s = summary(grades, errors)
    line = lambda section, place, text: F.struct(F.lit(section).alias("section"), F.lit(place).cast("long").alias("place"), text.alias("text"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and p.startswith("=") is False else F.col(p[1:]).cast("string") for p in parts])
    head = s.select(F.inline(F.array(
        line(0, 0, F.lit("# Audit of all repositories")), line(0, 1, said("Scanned: ", "=total", " of ", "=attempted", "; failed: ", "=skipped", " (", "=blocked", " without access)")),
        line(0, 2, said("Critical: ", "=criticals", ", warnings: ", "=warnings")), line(0, 3, said("Grades: ", *[x for g in GRADES for x in (f"{g} ", f"=grade_{g.lower()}", "  ")])),
        line(1, 0, F.lit("| Repository | Grade | Critical | Warning | Info |")), line(1, 1, F.lit("|---|---|---|---|---|")), line(2, 0, F.lit("## Not scanned")),
    )))
    order = Window.orderBy(grade_rank(F.col("grade")), F.desc("criticals"), F.desc("warnings"), "repo")
    rows = worst(grades, limit).withColumn("place", F.row_number().over(order) + 1)  # at most ``limit`` rows
    rows = rows.select(F.lit(1).alias("section"), F.col("place").cast("long").alias("place"), F.concat_ws(" | ", F.concat(F.lit("| "), "repo"), "grade", *[F.col(c).cast("string") for c in ("criticals", "warnings")], F.concat(F.col("infos").cast("string"), F.lit(" |"))).alias("text"))
    failed = errors.select(F.lit(2).alias("section"), F.lit(1).cast("long").alias("place"), F.concat(F.lit("- "), "repo", F.lit(": "), F.coalesce("label", F.lit(""))).alias("text"))
    return head.unionByName(rows).unionByName(failed).orderBy("section", "place", "text")


def accepts(found: Column, saved: Column, force: Column) -> Column:
    """Whether a discovered list may replace the saved one."""
    return force | (saved == 0) | (found >= saved * SHRINK)


def classify_error(status: Column, limited: Column, message: Column) -> Column:
    """``struct<label, kind, rate_limited>`` of a failed scan; ``status`` or ``limited`` may be null."""
    text = F.coalesce(message, F.lit(""))
    said = F.regexp_extract(text, r"GitHub API error \((\d+)\)", 1)
    code = F.coalesce(status.cast("string"), F.when(said != "", said).otherwise(F.regexp_extract(text, r"\b(401|403|404|409|429)\b", 1)))
    throttled = F.coalesce(limited, matches(text, "rate limit|abuse detection", "i"))
    made = lambda label, kind, flag: F.struct(label.alias("label"), F.lit(kind).alias("kind"), F.lit(flag).alias("rate_limited"))
    return (
        F.when(code.isin("403", "429") & throttled, made(F.lit("Rate limited"), "rate-limited", True))
        .when(code.isin("403", "429"), made(F.lit("Access denied"), "access-denied", False))
        .when(code == "401", made(F.lit("Sign-in needed"), "auth-required", False))
        .when(code == "404", made(F.lit("Not found or empty"), "not-found", False))
        .when(code == "409", made(F.lit("Empty repository"), "empty", False))
        .otherwise(made(F.substring(text, 1, 120), "error", False))
    )


def grade_rank(grade: Column) -> Column:
    """Worst first."""
    return F.when(grade == "F", 0).when(grade == "D", 1).when(grade == "C", 2).when(grade == "B", 3).otherwise(4)


def worst_first(grades: DataFrame) -> DataFrame:
    return grades.orderBy(grade_rank(F.col("grade")), F.desc("criticals"), F.desc("warnings"), "repo")


def worst(grades: DataFrame, n: int) -> DataFrame:
    """The ``n`` worst repositories: a report's limit."""
    return worst_first(grades).limit(n)


def summary(grades: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: repositories by grade, sums, and what couldn't be scanned. exit_code: 2 nothing scanned, 1 criticals, else 0."""
    g = grades.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("grade") == x).alias(f"grade_{x.lower()}") for x in GRADES],
        F.coalesce(F.sum("criticals"), F.lit(0)).cast("long").alias("criticals"), F.coalesce(F.sum("warnings"), F.lit(0)).cast("long").alias("warnings"),
    )
    e = errors.agg(F.count(F.lit(1)).alias("skipped"), F.count_if(F.col("kind").isin(*BLOCKED)).alias("blocked"))
    out = g.join(e, F.lit(True)).withColumn("attempted", F.col("total") + F.col("skipped"))  # one row each
    return out.withColumn("exit_code", F.when((F.col("total") == 0) & (F.col("attempted") > 0), 2).when(F.col("criticals") > 0, 1).otherwise(0))
