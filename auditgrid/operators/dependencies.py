"""Dependency checks and the gate before an install."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrid.functions.text import js_trim, lines
from auditgrid.schema import KEYS

RULE = "vulnerable-dependency"
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
#: Versions confirmed as malicious: fixed values.
KNOWN_MALICIOUS = ("keyv@6.0.0", "file-entry-cache@11.1.6", "cache-manager@7.2.10", "cacheable-request@13.0.20", "@qlik/api@2.14.2")
FRESH_HOURS = 72
HOOKS = ("preinstall", "install", "postinstall")
SPEC = r"^(?:@[a-z0-9\-~][a-z0-9\-._~]*\/)?[a-z0-9\-~][a-z0-9\-._~]*(?:@[a-zA-Z0-9\-._~^>=<|* ]+)?\z"
_AUDIT_DDL = "struct<vulnerabilities:map<string,struct<severity:string,range:string,via:string,fixAvailable:string>>>"


def npm_severity(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "critical").when(severity == "moderate", "warning").otherwise("info")


def _finding(severity: Column, message: Column, line: Column, evidence: Column, order: Column) -> list[Column]:
    return [*map(F.col, KEYS), F.lit(RULE).alias("rule_id"), severity.alias("severity"), message.alias("message"), line.cast("int").alias("line"), evidence.cast("string").alias("evidence"), order.cast("long").alias("finding_ord")]


def npm_audit_findings(audits: DataFrame) -> DataFrame:
    """From ``(file_id, repo, relative_path, raw_json)``, outputs of npm's own audit; broken JSON gives none."""
    each = audits.select(*KEYS, F.explode(F.from_json("raw_json", _AUDIT_DDL)["vulnerabilities"]).alias("name", "v"))
    via = F.from_json(F.when(F.col("v.via").startswith("["), F.col("v.via")), "array<string>")
    objects = F.filter(via, lambda x: x.startswith("{"))
    titles = F.array_join(F.transform(objects, lambda x: F.coalesce(F.get_json_object(x, "$.title"), F.get_json_object(x, "$.name"))), ", ")
    said = F.when(via.isNull(), F.col("v.via")).when(titles != "", titles)
    message = F.concat("name", F.lit("@"), F.coalesce("v.range", F.lit("unknown")), F.lit(": "), F.coalesce(said, F.col("v.severity"), F.lit("")))
    return each.select(*_finding(npm_severity(F.col("v.severity")), message, F.lit(None), F.lit(None), F.lit(0)))


def package_findings(files: DataFrame) -> DataFrame:
    """Of repositories without a lock file: dependencies that take any version, and that the lock file is missing.

    Only files at the repository's root count. The later of two entries for a name wins.
    """
    locked = files.where(F.col("relative_path").isin(*LOCKFILES)).select("repo").distinct()
    packages = files.where(F.col("relative_path") == "package.json").join(locked, "repo", "left_anti").select(*KEYS, F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>").alias("p"))
    empty = F.create_map().cast("map<string,string>")
    dev = F.coalesce("p.devDependencies", empty)
    own = F.map_filter(F.coalesce("p.dependencies", empty), lambda k, v: ~F.map_contains_key(dev, k))
    deps = packages.select(*KEYS, F.concat(F.map_entries(own), F.map_entries(dev)).alias("deps"))
    loose = deps.select(*KEYS, F.posexplode("deps").alias("i", "d")).where(F.col("d.value").isin("*", "latest"))
    each = loose.select(*_finding(F.lit("warning"), F.concat("d.key", F.lit(" takes any version: "), "d.value"), F.lit(None), F.lit(None), F.col("i")))
    none = deps.where(F.size("deps") > 0).select(*_finding(F.lit("info"), F.lit("There is no lock file"), F.lit(None), F.lit(None), F.lit(1_000_000)))
    return each.unionByName(none)


def requirement_findings(files: DataFrame) -> DataFrame:
    """Python requirements without a version."""
    rows = files.where(F.col("relative_path") == "requirements.txt").select(*KEYS, F.posexplode(lines(F.col("content"))).alias("i", "text")).withColumn("text", js_trim(F.col("text")))
    loose = rows.where((F.col("text") != "") & ~F.col("text").startswith("#") & ~F.col("text").contains("==") & ~F.col("text").contains(">=") & ~F.col("text").contains("~="))
    named = loose.withColumn("name", js_trim(F.regexp_extract("text", r"^([^<>=!]*)", 1))).where("name <> ''")
    return named.select(*_finding(F.lit("info"), F.concat("name", F.lit(" isn't pinned")), F.col("i") + 1, F.lit(None), F.col("i")))


def dependency_findings(files: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    parts = [package_findings(files), requirement_findings(files)] + ([npm_audit_findings(audits)] if audits is not None else [])
    return reduce(DataFrame.unionByName, parts)


def valid_spec(spec: Column) -> Column:
    return F.coalesce(spec.rlike(SPEC), F.lit(False))


def resolved_tree(output: DataFrame) -> DataFrame:
    """``(name, version)`` of the packages that a dry run of an install would add; ``output`` has its lines."""
    p = r"^\s*add\s+(\S+)\s+(\S+)\s*\z"
    return output.where(F.col("line").rlike(p)).select(F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("version"))


def assess(tree: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """``name, version, level, reasons, age_hours, install_scripts``: one row per package of ``tree``.

    ``registry`` has (name, version, published, scripts map); published null where the date isn't known. A
    package whose name the registry doesn't answer for is a warning, never clean.
    """
    asked = registry.select(F.col("name").alias("r_name"), F.col("version").alias("r_version"), "published", "scripts").dropDuplicates(["r_name", "r_version"])
    reached = registry.select(F.col("name").alias("a_name")).distinct()
    bad = tree.sparkSession.createDataFrame([(x,) for x in KNOWN_MALICIOUS], "known string")
    rows = tree.join(reached, F.col("name") == F.col("a_name"), "left").join(asked, (F.col("name") == F.col("r_name")) & (F.col("version") == F.col("r_version")), "left")
    rows = rows.join(F.broadcast(bad), F.concat("name", F.lit("@"), "version") == F.col("known"), "left")
    hooks = F.filter(F.array(*[F.lit(h) for h in HOOKS]), lambda h: F.coalesce(F.try_element_at("scripts", h), F.lit("")) != "")
    age = (F.unix_micros(now) - F.unix_micros("published")) / 3.6e9
    known, unreached, runs, fresh = F.col("known").isNotNull(), F.col("a_name").isNull(), F.size("hooks") > 0, F.coalesce(F.col("age") < FRESH_HOURS, F.lit(False))
    level = F.when(known, "block").when(unreached, "warn").when(fresh & runs, "block").when(fresh | runs, "warn").otherwise("ok")
    said = F.filter(F.array(F.when(runs, F.concat(F.lit("runs code at install: "), F.array_join("hooks", ", "))), F.when(fresh, F.concat(F.lit("published "), F.floor(F.col("age") + 0.5).cast("string"), F.lit(" hours ago")))), lambda x: x.isNotNull())
    reasons = F.when(known, F.array(F.lit("this version is known to be malicious"))).when(unreached, F.array(F.lit("the registry couldn't be asked"))).otherwise(said)
    rows = rows.withColumns({"hooks": F.when(F.col("scripts").isNull(), F.array().cast("array<string>")).otherwise(hooks), "age": age})
    quiet = known | unreached
    return rows.select("name", "version", level.alias("level"), reasons.alias("reasons"), F.when(~quiet, F.col("age")).alias("age_hours"), F.when(quiet, F.array().cast("array<string>")).otherwise(F.col("hooks")).alias("install_scripts"))


def gate_status(assessed: DataFrame) -> DataFrame:
    """One row: total, blocked, warned and exit_code (2 blocked, 1 warned, 0 clean)."""
    out = assessed.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "block").alias("blocked"), F.count_if(F.col("level") == "warn").alias("warned"))
    return out.withColumn("exit_code", F.when(F.col("blocked") > 0, 2).when(F.col("warned") > 0, 1).otherwise(0))


