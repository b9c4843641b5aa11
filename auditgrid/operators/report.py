"""Aggregates of findings: counts, groups, histograms and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrid.operators.audit import rank
from auditgrid.rules.catalog import OWASP_LABELS


def _count(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity)


def project_grade(critical: Column, warning: Column, info: Column) -> Column:
    """The scale for one project: any critical F, over five warnings D, any warning C, any note B, else A."""
    return F.when(critical > 0, "F").when(warning > 5, "D").when(warning > 0, "C").when(info > 0, "B").otherwise("A")


def repo_grade(critical: Column, warning: Column) -> Column:
    """The scale for a portfolio: any critical F, over three warnings D, over one C, one B, else A."""
    return F.when(critical > 0, "F").when(warning > 3, "D").when(warning > 1, "C").when(warning > 0, "B").otherwise("A")


def by_severity(findings: DataFrame) -> DataFrame:
    """One row: total, critical, warning, info and the project's grade."""
    counts = findings.agg(F.count(F.lit(1)).alias("total"), _count("critical").alias("critical"), _count("warning").alias("warning"), _count("info").alias("info"))
    return counts.withColumn("grade", project_grade(F.col("critical"), F.col("warning"), F.col("info")))


def severity_bar(summary: DataFrame, width: int = 40) -> DataFrame:
    """Cells of a bar by severity; notes get what is left."""
    share = lambda c: F.when(F.col("total") > 0, F.floor(F.col(c) * width / F.col("total") + 0.5)).otherwise(0).cast("int")
    out = summary.select("total", share("critical").alias("critical_cells"), share("warning").alias("warning_cells"))
    return out.withColumn("info_cells", F.when(F.col("total") > 0, F.greatest(F.lit(0), F.lit(width) - F.col("critical_cells") - F.col("warning_cells"))).otherwise(0).cast("int"))


def by_file(findings: DataFrame) -> DataFrame:
    """Counts of each file with findings, in the order in which an ordered audit first names them."""
    first = F.min(F.struct(rank(F.col("severity")), "repo", "relative_path", "file_id")).alias("first")
    counts = findings.groupBy("repo", "file_id", "relative_path").agg(F.count(F.lit(1)).alias("total"), _count("critical").alias("critical"), _count("warning").alias("warning"), _count("info").alias("info"), first)
    return counts.orderBy("first").drop("first")


def by_owasp(findings: DataFrame) -> DataFrame:
    """Findings of each of the ten categories, those without any included; findings without a category count as Other."""
    counts = findings.groupBy(F.coalesce("owasp_category", F.lit("Other")).alias("owasp_category")).agg(F.count(F.lit(1)).alias("n"))
    labels = findings.sparkSession.createDataFrame([*OWASP_LABELS.items(), ("Other", "Other")], "owasp_category string, label string")
    return F.broadcast(labels).join(counts, "owasp_category", "left").select("owasp_category", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    """One row per rule with findings: the severity of its first one, and its numbers of findings and files."""
    first = F.min_by("severity", F.struct(rank(F.col("severity")), "repo", "file_id", "finding_ord"))
    return findings.groupBy("rule_id").agg(first.alias("severity"), F.count(F.lit(1)).alias("n"), F.count_distinct("repo", "file_id").alias("files"))


def cvss_histogram(findings: DataFrame) -> DataFrame:
    """Findings by CVSS band; a missing score is 0."""
    score = F.coalesce("cvss_score", F.lit(0.0))
    band = F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("info")
    bands = findings.sparkSession.createDataFrame([(b,) for b in ("critical", "high", "medium", "low", "info")], "band string")
    return F.broadcast(bands).join(findings.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def repo_grades(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository, those without findings included."""
    counts = findings.groupBy("repo").agg(_count("critical").alias("criticals"), _count("warning").alias("warnings"), _count("info").alias("infos"), F.count(F.lit(1)).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = repos.select("repo").distinct().join(counts, "repo", "left").select("repo", zero("criticals"), zero("warnings"), zero("infos"), zero("total"))
    return out.select("repo", repo_grade(F.col("criticals"), F.col("warnings")).alias("grade"), "criticals", "warnings", "infos", "total")


def missing_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules without any finding."""
    return rules.join(findings.select("rule_id").distinct(), "rule_id", "left_anti")


def fix_guide(findings: DataFrame) -> DataFrame:
    """One section per rule, criticals first: name, advice, number of findings and of files; ``fix_guide_files`` lists the files."""
    grouped = findings.groupBy("rule_id", "rule_name", "rule_ord", "fix").agg(F.min(rank(F.col("severity"))).alias("severity_rank"), F.count(F.lit(1)).alias("n"), F.count_distinct("repo", "relative_path").alias("files"))
    return grouped.orderBy("severity_rank", "rule_ord").select("severity_rank", "rule_id", "rule_name", "fix", "n", "files")


def fix_guide_files(findings: DataFrame) -> DataFrame:
    """The files of each section of the guide, a row each however many there are: rule, file, number of findings and its first line."""
    grouped = findings.groupBy("rule_id", "rule_ord", "repo", "relative_path").agg(F.min(rank(F.col("severity"))).alias("severity_rank"), F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))
    return grouped.orderBy("severity_rank", "rule_ord", "repo", "relative_path").select("rule_id", "repo", "relative_path", "severity_rank", "n", "first_line")
