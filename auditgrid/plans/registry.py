"""The queries of the audit engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.config import CONFIG_NAME, Config
from auditgrid.functions import fileclass
from auditgrid.functions.text import js_trim, lines, shannon_entropy
from auditgrid.operators import audit as A
from auditgrid.operators import dependencies, portfolio, report, scopes
from auditgrid.operators.blocks import quieted, with_blocks
from auditgrid.plans import corpus, oracle
from auditgrid.plans.corpus import quote
from auditgrid.rules import catalog, scope_rules
from auditgrid.sources import files as S
from auditgrid.sources import sinks
from auditgrid.sources.shared import shared_dir, spread
from auditgrid.streaming import incremental

COLUMNS = ["file_id", "repo", "relative_path", "rule_id", "severity", "message", "line", "evidence"]
#: Rules that look at tags, held on the pages as well.
PAGE_RULES = ("a11y-img-no-alt", "a11y-form-no-label", "a11y-no-lang", "a11y-button-no-name", "a11y-positive-tabindex", "missing-sri", "regex-dos")
#: Every rule that looks at files.
ALL = tuple(r for r in catalog.IDS if r != A.HISTORY_RULE)
#: Some rules of every severity. The SQL of the queries about what happens after the rules covers these alone, so the
#: whole job, which SQL cannot express, is registered beside each of them as all_rules_...
SMALL = ("weak-hashing", "insecure-cipher", "hardcoded-ip", "sensitive-browser-storage", "predictable-ids", "pii-logging", "unpinned-dependencies", "no-error-monitoring", "a11y-img-no-alt", "nosql-injection", "clickjacking")
DISABLED = {"weak-hashing": ("^src/lib/hash.js$",), "hardcoded-ip": ("infra/", "src/lib")}


@lru_cache(1)
def portable() -> tuple[str, ...]:
    """Rules that both engines can run."""
    return tuple(r for r in catalog.IDS if oracle.rule_sql(r))


def _name(rule_id: str) -> str:
    return "rule_" + rule_id.replace("-", "_")


def _rule(rule_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_rules(corpus.files(spark, sf_dir), [rule_id]).select(*COLUMNS)


def _page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_rules(corpus.pages(spark, sf_dir), list(PAGE_RULES)).select(*COLUMNS)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.files(spark, sf_dir).select("file_id", "repo", F.sha1(F.col("file_id").cast("string")).alias("commit"), "relative_path", F.explode(lines(F.col("content"))).alias("added_line"))
    return A.history_findings(rows).select(*COLUMNS)


def _raw(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    return A.run_rules(corpus.files(spark, sf_dir), list(rules))


def _audited(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    return A.audit(corpus.files(spark, sf_dir), Config(rules=tuple(rules)))


def _suppressed(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    return A.unsuppressed(_raw(spark, sf_dir, rules), corpus.files(spark, sf_dir)).select(*COLUMNS)


def _directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.directives(corpus.files(spark, sf_dir))
    return d.select("file_id", F.col("target").cast("int").alias("target"), F.array_join("ids", ",").alias("ids"))


def _enabled(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    return A.enabled_paths(_raw(spark, sf_dir, rules), DISABLED).select(*COLUMNS)


SETTINGS = '{"exclude": ["weak-hashing"], "ignore": ["components/"], "disableForPaths": {"hardcoded-ip": ["^src/lib"]}}'


def _settings(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    """Some repositories ship settings of their own."""
    repos = corpus.files(spark, sf_dir).select("repo").distinct().where(F.col("repo").endswith("3"))
    shipped = repos.select(F.lit(-1).cast("long").alias("file_id"), "repo", F.lit(CONFIG_NAME).alias("relative_path"), F.lit(SETTINGS).alias("content"))
    return A.configured(_raw(spark, sf_dir, rules), A.project_configs(shipped)).select(*COLUMNS)


def _enriched(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    return A.ordered(_audited(spark, sf_dir, rules)).select(*COLUMNS, "rule_ord", "rule_name", "cwe_id", "cvss_score", "owasp_category", "wcag", "fix")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    path = F.col("relative_path")
    return f.select("file_id", "relative_path", S.extension(path).alias("ext"), S.scan_predicate(path, F.col("content")).alias("scanned"), S.ignored(path, ("docs", "infra/")).alias("ignored"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir).select("file_id", F.posexplode(lines(F.col("content"))).alias("i", "text"))
    return f.select("file_id", (F.col("i") + 1).cast("int").alias("line"), F.length(js_trim(F.col("text"))).cast("int").alias("trimmed_chars"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, path, content = corpus.files(spark, sf_dir), F.col("relative_path"), F.col("content")
    return f.select("file_id", "relative_path", fileclass.is_client(path, content).alias("is_client"), fileclass.is_server_only(path, content).alias("is_server_only"), path.rlike("(?i)" + fileclass.PUBLIC_ROUTE).alias("public_route"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).where(F.col("relative_path").rlike(r"(?i)\.(?:js|jsx|ts|tsx|mjs|cjs)\z"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_blocks(_scripts(spark, sf_dir))
    return f.select("file_id", "relative_path", F.explode("blocks").alias("b")).select("file_id", "relative_path", "b.*")


def _call_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.call_scopes(_scripts(spark, sf_dir)).drop("repo")


#: Places where a request gets to the disk, the network or a table, and what checks it.
DANGERS = ((scope_rules.RAW_BODY, ""), (r"\b(?:fetch|sendFile|readFile|insert|create)\s*\(", ""), (r"\b(?:req|request)\.(?:params|query)\b", ""))
GUARDS = ((r"\b\w*" + scope_rules.AUTH_GUARD + r"\s*\(", ""), (scope_rules.GUARD_MEMBER, ""), (r"\b(?:basename|allowedHosts|safeParse|validate)\b", "i"))


def _unguarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.unguarded(_scripts(spark, sf_dir), DANGERS, GUARDS).drop("repo")


def _quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quieted(_scripts(spark, sf_dir)).select("file_id", "relative_path", "code", "plain")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("file_id", "relative_path", A.route_url(F.col("relative_path")).alias("url"))


#: What stands behind a page's path in a matcher of middleware.
TAILS = ("", "/:path*", "/(.*)", "/.*", "/[0-9]", "/", "$", "/((?!_next).*)", "/:id", " ")


def _matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path as a matcher; every eleventh one is no path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null and url is not null")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.pmod("page_id", F.lit(len(TAILS))) + 1).cast("int"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    raw = F.concat(F.when(F.pmod("page_id", F.lit(11)) == 0, F.lit("x")).otherwise(""), path, tail)
    return pages.select("page_id", raw.alias("raw")).withColumn("prefix", A.matcher_prefix(F.col("raw")))


def _rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(corpus.files(spark, sf_dir), Config(rules=("missing-auth",))).select(*COLUMNS)


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    return report.repo_grades(A.unsuppressed(A.run_rules(f, list(portable())), f), f)


def _audited_grades(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    return report.repo_grades(_audited(spark, sf_dir, rules), corpus.files(spark, sf_dir))


ERRORS = (("a/b", 403, True, "x"), ("a/c", 403, None, "GitHub API error (403): You have exceeded a rate limit"), ("a/d", 403, False, "no"), ("a/e", None, None, "GitHub API error (404): gone"), ("a/f", 401, None, "x"), ("a/g", 409, None, "x"), ("a/h", None, None, "socket hang up"), ("a/i", 429, True, "x"), ("a/j", None, None, None))


def _errors(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ERRORS, "repo string, status int, limited boolean, message string")
    return rows.withColumn("c", portfolio.classify_error(F.col("status"), F.col("limited"), F.col("message"))).select("repo", "c.label", "c.kind", "c.rate_limited")


def _event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as the failed scan of a repository, with one of the answers of ``ERRORS``."""
    kinds = spark.createDataFrame([(i, s, limited, m) for i, (_, s, limited, m) in enumerate(ERRORS)], "k long, status int, limited boolean, said string")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id is not null").select("event_id", "event_type", F.pmod("event_id", F.lit(len(ERRORS))).alias("k"))
    rows = events.join(F.broadcast(kinds), "k").withColumn("message", F.concat("said", F.lit(" after "), F.coalesce("event_type", F.lit(""))))
    return rows.select("event_id", portfolio.classify_error(F.col("status"), F.col("limited"), F.col("message")).alias("c")).select("event_id", "c.label", "c.kind", "c.rate_limited")


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.dependency_findings(corpus.files(spark, sf_dir)).select(*COLUMNS)


def _parts(spark: SparkSession, sf_dir: str, kinds: int) -> DataFrame:
    """The parts as packages: k, one of some kinds; p, the part's number; and its name in one word."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey is not null and p_name is not null and p_size is not null")
    return rows.select(F.pmod("p_partkey", F.lit(kinds)).cast("int").alias("k"), F.col("p_partkey").cast("long").alias("p"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("word"), F.col("p_size").cast("int").alias("size"), "p_name")


def _npm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as what npm's audit says of one package: with titles, with one name, broken, or not there."""
    entry = lambda via: F.concat(F.lit('{"vulnerabilities":{"'), "word", F.lit('":{"severity":"'), severity, F.lit('","range":"<'), "size", F.lit('","via":'), via, F.lit("}}}"))
    severity = F.when(F.col("size") > 40, "critical").when(F.col("size") > 30, "high").when(F.col("size") > 15, "moderate").otherwise("low")
    titled = entry(F.concat(F.lit('[{"title":"'), "p_name", F.lit('"},"x",{"name":"b"}]')))
    raw = F.when(F.col("k") == 0, titled).when(F.col("k") == 1, entry(F.concat(F.lit('"'), "p_name", F.lit('"')))).when(F.col("k") == 2, entry(F.lit('["y"]'))).when(F.col("k") == 3, F.substring(titled, F.lit(1), F.length(titled) - 3))
    rows = _parts(spark, sf_dir, 5).select(F.col("p").alias("file_id"), F.concat(F.lit("repo"), F.col("p").cast("string")).alias("repo"), F.lit("package.json").alias("relative_path"), raw.alias("raw_json"))
    return dependencies.npm_audit_findings(rows).select(*COLUMNS)


#: Kinds of packages: a name, hours since its version was published (of some a part's size more), and its hook. "lost" isn't in the registry.
PACKAGES = (("keyv", None, None), ("left-pad", 5000, None), ("fresh", 10, None), ("hooked", 900, "postinstall"), ("hijack", 1, "preinstall"), ("lost", None, None), ("undated", None, None), ("edge", 47, None))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as the packages of an install, and as what the registry says of them."""
    now = F.timestamp_micros(F.lit(1_700_000_000_000_000))
    kinds = spark.createDataFrame([(i, *p) for i, p in enumerate(PACKAGES)], "k int, base string, hours int, hook string")
    rows = _parts(spark, sf_dir, len(PACKAGES)).join(F.broadcast(kinds), "k")
    rows = rows.withColumns({"name": F.when(F.col("k") == 0, "keyv").otherwise(F.concat_ws("-", "base", "word", "p")), "version": F.when(F.col("k") == 0, "6.0.0").otherwise(F.concat(F.lit("1."), F.col("size").cast("string")))})
    known = rows.where("base not in ('keyv', 'lost')").withColumn("published", F.timestamp_micros((F.lit(1_700_000_000_000_000) - (F.col("hours") + F.col("size")) * 3.6e9).cast("long")))
    scripts = F.when(F.col("hook").isNotNull(), F.create_map("hook", F.lit("node x.js"))).otherwise(F.create_map().cast("map<string,string>"))
    return dependencies.assess(rows.select("name", "version"), known.select("name", "version", "published", scripts.alias("scripts")), now)


def _gate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("name", "version", "level")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assessed(spark, sf_dir)
    return a.select("name", "version", "level", F.array_join("reasons", "; ").alias("reasons"), F.round("age_hours", 3).alias("age_hours"), F.array_join("install_scripts", ",").alias("install_scripts"))


def _gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.gate_status(_assessed(spark, sf_dir))


#: Ways to write a repository: o is its owner, r its name.
ADDRESSES = ("https://github.com/{o}/{r}", "github.com/{o}/{r}.git", "{o}/{r}", "./{o}/{r}", "{o}/{r}/s", "git@github.com:{o}/{r}.git", "https://example.org/{o}/{r}", "{o} b/{r}", "http://github.com/{o}/{r}?tab=x#y")
#: Those that name one.
NAMING = (0, 1, 2, 8)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host and number as the address of a repository."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null and url is not null")
    o, r = F.regexp_extract("url", r"^[a-z]+://([a-z]+)", 1), F.concat(F.lit("p"), F.col("page_id").cast("string"))
    made = [F.replace(F.replace(F.lit(a), F.lit("{o}"), o), F.lit("{r}"), r) for a in ADDRESSES]
    rows = pages.select("page_id", F.element_at(F.array(*made), (F.pmod("page_id", F.lit(len(ADDRESSES))) + 1).cast("int")).alias("target"))
    return rows.withColumn("t", S.parse_target(F.col("target"))).select("page_id", "target", "t.owner", "t.repo")


#: Ways to write a package with the name w and the number n.
SPECS = ("{w}", "{w}@{n}.17.21", "@{w}/pkg", "{w};rm -rf", "{w} {n}", "@x/{w}@^1.{n}", "", "{w}\n", "{w}@>={n} <9")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name as what is to be installed."""
    rows = _parts(spark, sf_dir, len(SPECS))
    made = [F.replace(F.replace(F.lit(x), F.lit("{w}"), F.col("word")), F.lit("{n}"), F.col("size").cast("string")) for x in SPECS]
    return rows.select("p", F.element_at(F.array(*made), F.col("k") + 1).alias("spec")).withColumn("valid", dependencies.valid_spec(F.col("spec")))


def _discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of the corpus as a discovered list; reports and forks are left out, and the list is compared with a saved one."""
    repos = corpus.files(spark, sf_dir).select(F.concat(F.lit("owner/"), "repo").alias("full_name")).distinct().withColumns({"archived": F.lit(False), "fork": F.col("full_name").endswith("7")})
    extra = spark.createDataFrame([("owner/audit-reports", False, False), ("owner/old", True, False)], "full_name string, archived boolean, fork boolean")
    kept = portfolio.without_output(portfolio.discovered(repos.unionByName(extra)), ("audit-reports",))
    both = kept.agg(F.count(F.lit(1)).alias("found")).join(repos.agg(F.count(F.lit(1)).alias("saved")), F.lit(True))
    return both.select("found", "saved", portfolio.accepts(F.col("found"), F.col("saved"), F.lit(False)).alias("accepted"))


def _entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{12,}"), F.lit(0))).alias("token"))
    return words.select("doc_id", "token", F.round(shannon_entropy(F.col("token")), 6).alias("bits"))


def _rendered(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.document(_audited(spark, sf_dir, ALL), kind).orderBy(*sinks.ORDER, "text")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a Markdown report says besides its findings."""
    return sinks.document(_audited(spark, sf_dir)).where("section <> 1 or place = 0").select("section", "severity_rank", "place", "text")


def _by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_rule(_audited(spark, sf_dir, ALL))


def _all_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without findings; the rules about past commits and dependencies run on their own rows."""
    found = _audited(spark, sf_dir, ALL).select("rule_id").union(_history(spark, sf_dir).select("rule_id")).union(_dependencies(spark, sf_dir).select("rule_id"))
    return report.missing_rules(found, catalog.catalog(spark)).select("rule_id")


def _streamed(spark: SparkSession, sf_dir: str, rules=SMALL) -> DataFrame:
    """The corpus as a stream: files land as Parquet and each batch is audited."""
    at = f"{shared_dir(spark)}/audit-stream-{uuid.uuid4().hex[:12]}"
    corpus.files(spark, sf_dir).write.parquet(f"{at}/landing")
    incremental.audit_stream(incremental.file_stream(spark, f"{at}/landing"), f"{at}/findings", f"{at}/state", Config(rules=tuple(rules))).awaitTermination()
    return incremental.findings(spark, f"{at}/findings").select(*COLUMNS)


def _settings_table(files: DataFrame) -> DataFrame:
    """Every twentieth file as a setting: a rule of ``SMALL``, and a piece of the file's path where it is off."""
    i = F.col("file_id")
    rule = F.element_at(F.array(*map(F.lit, SMALL)), (F.pmod(i, F.lit(len(SMALL))) + 1).cast("int"))
    return files.where(F.pmod(i, F.lit(20)) == 1).select(rule.alias("rule_id"), F.substring("relative_path", (F.pmod(i, F.lit(7)) + 1).cast("int"), (F.pmod(i, F.lit(9)) + 2).cast("int")).alias("text"))


def _enabled_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir)
    return A.enabled_by_table(_raw(spark, sf_dir), _settings_table(files), files).select(*COLUMNS)


#: What a file becomes in its second landing, and the versions of its three.
SECOND = "const h = createHash('md5');\nconst k = 1;\nconst g = createHash('sha1');"


def _landed(files: DataFrame) -> list[DataFrame]:
    """Three landings: all files; every third one rewritten; and every fifth one deleted, while old versions of every second one come late."""
    return [
        files.withColumn("version", F.lit(1).cast("long")),
        files.where(F.pmod("file_id", F.lit(3)) == 0).withColumn("content", F.lit(SECOND)).withColumn("version", F.lit(2).cast("long")),
        files.where(F.pmod("file_id", F.lit(5)) == 0).withColumn("content", F.lit(None).cast("string")).withColumn("version", F.lit(3).cast("long")).union(files.where(F.pmod("file_id", F.lit(2)) == 0).withColumn("version", F.lit(0).cast("long"))),
    ]


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in three landings, each a batch of its own; a path is a file's own here."""
    at = f"{shared_dir(spark)}/audit-versions-{uuid.uuid4().hex[:12]}"
    files = corpus.files(spark, sf_dir).withColumn("relative_path", F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit("/"), F.col("relative_path")))
    for landing in _landed(files):
        landing.write.mode("append").parquet(f"{at}/landing")
        incremental.audit_stream(incremental.file_stream(spark, f"{at}/landing", 1_000_000), f"{at}/findings", f"{at}/state", Config(rules=SMALL)).awaitTermination()
    return incremental.findings(spark, f"{at}/findings").select(*COLUMNS)


def _across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(corpus.modules(spark, sf_dir), Config(rules=("missing-auth",)), follow_imports=True).select(*COLUMNS)


def _after_rules(rules) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries about what happens after the rules."""
    found, grades = partial(_audited, rules=rules), partial(_audited_grades, rules=rules)
    return {
        "suppress_antijoin": partial(_suppressed, rules=rules),
        "disabled_paths_antijoin": partial(_enabled, rules=rules),
        "project_settings_join": partial(_settings, rules=rules),
        "enrich_and_sort": partial(_enriched, rules=rules),
        "agg_by_severity": lambda s, d: report.by_severity(found(s, d)),
        "agg_by_file": lambda s, d: report.by_file(found(s, d)),
        "agg_by_owasp": lambda s, d: report.by_owasp(found(s, d)),
        "cvss_histogram": lambda s, d: report.cvss_histogram(found(s, d)),
        "severity_bar": lambda s, d: report.severity_bar(report.by_severity(found(s, d))),
        "exit_status": lambda s, d: A.exit_status(found(s, d), strict=True),
        "silent_rules": lambda s, d: report.missing_rules(found(s, d), catalog.catalog(s)).select("rule_id"),
        "fix_guide": lambda s, d: report.fix_guide(found(s, d)),
        "fix_guide_files": lambda s, d: report.fix_guide_files(found(s, d)),
        "portfolio_report": lambda s, d: portfolio.report(grades(s, d), _errors(s)),
        "portfolio_worst_repos": lambda s, d: portfolio.worst(grades(s, d), 20),
        "portfolio_summary": lambda s, d: portfolio.summary(grades(s, d), _errors(s)),
        "stream_audit": partial(_streamed, rules=rules),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {_name(r): partial(_rule, r) for r in catalog.IDS if r != A.HISTORY_RULE}
    whole = _after_rules(ALL) | {"silent_rules": _all_silent, "portfolio_repo_grades": partial(_audited_grades, rules=ALL)}
    return out | _after_rules(SMALL) | {f"all_rules_{name}": query for name, query in whole.items()} | {
        _name(A.HISTORY_RULE): _history,
        "page_tag_rules": _page_rules,
        "scan_predicate": _scan,
        "lines_explode": _lines,
        "file_classes": _classes,
        "script_blocks": _blocks,
        "script_quiet": _quiet,
        "call_scopes": _call_scopes,
        "unguarded_places": _unguarded,
        "entropy_tokens": _entropy,
        "suppression_directives": _directives,
        "route_urls": _routes,
        "matcher_prefixes": _matchers,
        "middleware_rescore": _rescored,
        "agg_by_rule": _by_rule,
        "portfolio_repo_grades": _grades,
        "portfolio_discovery": _discovery,
        "scan_errors": _event_errors,
        "target_parser": _targets,
        "dependency_findings": _dependencies,
        "stream_versions": _versions,
        "disabled_paths_table": _enabled_by_table,
        "missing_auth_across_files": _across_files,
        "npm_audit": _npm,
        "package_specs": _specs,
        "gate_packages": _gate,
        "gate_levels": _gate_levels,
        "gate_status": _gate_status,
        "report_sections": _sections,
        "report_json": partial(_rendered, "json"),
        "report_markdown": partial(_rendered, "markdown"),
        "report_html": partial(_rendered, "html"),
        "report_terminal": partial(_rendered, "terminal"),
        "full_audit": lambda s, d: A.audit(corpus.files(s, d)).select(*COLUMNS, "cwe_id", "cvss_score", "owasp_category", "wcag"),
    }


def _with(body: str, source: str | None = None, more: str = "") -> str:
    return f"WITH {source or corpus.sql()}{', ' + more if more else ''}\n{body}"


def _union(rules) -> str:
    return " UNION ALL ".join(f"SELECT {oracle.COLUMNS} FROM ({oracle.rule_sql(r)})" for r in rules)


def _directive_sql() -> str:
    rows = "SELECT file_id, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE contains(lower(content), 'audit-ignore')"
    p = quote(oracle.re2(A.DIRECTIVE))
    return f"directives AS (SELECT file_id, CAST(line + CASE WHEN regexp_extract(text, {p}, 1) <> '' THEN 1 ELSE 0 END AS INTEGER) AS target, nullif(regexp_replace(regexp_extract(text, {p}, 2), ' *, *', ',', 'g'), '') AS ids FROM ({rows}) WHERE contains(lower(text), 'audit-ignore'))"


def _audited_sql(rules=SMALL) -> str:
    """Common table expressions up to ``findings``: suppressed and enriched."""
    rows = ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if v is None and i != 5 else "CAST(NULL AS DOUBLE)" if v is None else quote(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if i == 5 else str(v) for i, v in enumerate(r)) + ")" for r in catalog.ALL)
    scopes = oracle.scopes_cte() + "," if any(map(oracle.needs_scopes, rules)) else ""
    return f"""{_directive_sql()},
{scopes}
raw AS ({_union(rules)}),
rules(rule_ord, rule_id, rule_name, default_severity, cwe_id, cvss_score, owasp_category, wcag, fix) AS (VALUES {rows}),
kept AS (SELECT * FROM raw f WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE d.file_id = f.file_id AND d.target = f.line AND (d.ids IS NULL OR list_contains(string_split(d.ids, ','), f.rule_id)))),
findings AS (SELECT k.*, r.rule_ord, r.rule_name, r.cwe_id, r.cvss_score, r.owasp_category, r.wcag, r.fix FROM kept k LEFT JOIN rules r USING (rule_id))"""


def _prefix_sql(x: str) -> str:
    bare = oracle.trim(x)
    for tail in A.MATCHER_TAILS:
        bare = f"regexp_replace({bare}, {quote(tail.replace(chr(92) + 'z', '$'))}, '')"
    special = quote(r"[()\[\]{}*+?|\\^$]")
    return f"CASE WHEN NOT starts_with({oracle.trim(x)}, '/') THEN NULL WHEN contains({x}, '(?!') OR {bare} = '' THEN '/' WHEN regexp_matches({bare}, {special}) THEN NULL ELSE {bare} END"


def _rescored_sql() -> str:
    """``findings`` of missing-auth with the first prefix of the repository's middleware that covers the route."""
    strings = quote(r"'[^'\n]*'|" + r'"[^"\n]*"')
    prefix = _prefix_sql("x")
    return f"""ways AS (SELECT repo, file_id, regexp_extract(code, {quote(A.MATCHER)}, 1) AS listed, {oracle.guarded("code", False)} OR {oracle.matches("code", A.MIDDLEWARE_CALLS)} AS guards FROM quiet WHERE {oracle.matches("relative_path", A.MIDDLEWARE, "i")}),
last AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_id DESC) = 1),
guards AS (SELECT repo, list_filter(list_transform(list_transform(regexp_extract_all(listed, {strings}), lambda x: x[2:-2]), lambda x: {prefix}), lambda x: x IS NOT NULL) AS prefixes FROM last WHERE guards),
covered AS (SELECT f.*, list_filter(prefixes, lambda p: p = '/' OR url = p OR starts_with(url, p || '/'))[1] AS prefix FROM (SELECT *, {_url_sql()} AS url FROM findings) f LEFT JOIN guards g ON g.repo = f.repo)"""


def _url_sql() -> str:
    """The address that a route's file answers."""
    app, pages = quote(r"(?i)(?:^|/)app/(.+)/route\.[mc]?[jt]sx?$"), quote(r"(?i)(?:^|/)pages/(api/.+)\.[mc]?[jt]sx?$")
    parts = f"list_filter(string_split(regexp_extract(relative_path, {app}, 1), '/'), lambda s: NOT regexp_matches(s, '^\\(.*\\)$') AND NOT starts_with(s, '@'))"
    return f"CASE WHEN regexp_matches(relative_path, {app}) THEN '/' || array_to_string({parts}, '/') WHEN regexp_matches(relative_path, {pages}) THEN '/' || regexp_replace(regexp_extract(relative_path, {pages}, 1), '/index$', '') END"


def _dependency_sql() -> str:
    """What package files and requirements leave open, in repositories without a lock file at their root."""
    out = lambda severity, message, line: oracle.found(dependencies.RULE, quote(severity), message, line, "CAST(NULL AS VARCHAR)")
    keys = lambda field: f"coalesce(json_keys(content, '$.{field}'), [])"
    own = f"list_filter({keys('dependencies')}, lambda k: NOT list_contains({keys('devDependencies')}, k))"
    value = "json_extract_string(json_extract(content, '$.' || field), '$.\"' || name || '\"')"
    text = oracle.trim("text")
    return f"""packages AS (SELECT *, {own} AS own, {keys('devDependencies')} AS dev FROM files WHERE relative_path = 'package.json' AND json_valid(content) AND repo NOT IN (SELECT repo FROM files WHERE relative_path IN ({', '.join(map(quote, dependencies.LOCKFILES))}))),
entries AS (SELECT *, {value} AS value FROM (SELECT *, unnest(own) AS name, 'dependencies' AS field FROM packages UNION ALL SELECT *, unnest(dev) AS name, 'devDependencies' AS field FROM packages)),
required AS (SELECT file_id, repo, relative_path, {text} AS text, line, {oracle.trim(f"regexp_extract({text}, '^([^<>=!]*)', 1)")} AS name FROM (SELECT file_id, repo, relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE relative_path = 'requirements.txt')),
found AS (
  SELECT {out('warning', "name || ' takes any version: ' || value", 'NULL')} FROM entries WHERE value IN ('*', 'latest')
  UNION ALL SELECT {out('info', quote('There is no lock file'), 'NULL')} FROM packages WHERE len(own) + len(dev) > 0
  UNION ALL SELECT {out('info', "name || ' isn''t pinned'", 'line')} FROM required WHERE text <> '' AND NOT starts_with(text, '#') AND NOT contains(text, '==') AND NOT contains(text, '>=') AND NOT contains(text, '~=') AND name <> '')"""


_COUNTS = "CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warning, CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS info"
_GRADED = """SELECT r.repo, CASE WHEN coalesce(critical, 0) > 0 THEN 'F' WHEN coalesce(warning, 0) > 3 THEN 'D' WHEN coalesce(warning, 0) > 1 THEN 'C' WHEN coalesce(warning, 0) > 0 THEN 'B' ELSE 'A' END AS grade,
  coalesce(critical, 0) AS criticals, coalesce(warning, 0) AS warnings, coalesce(info, 0) AS infos, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN (SELECT repo, """ + _COUNTS + " FROM findings GROUP BY repo) USING (repo)"
_WORST = "CASE grade WHEN 'F' THEN 0 WHEN 'D' THEN 1 WHEN 'C' THEN 2 WHEN 'B' THEN 3 ELSE 4 END"


def _values(rows, names: str) -> str:
    lit = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


#: The packages of the gate with what is known of each: kinds go by the part's number, and some are older the larger the part is.
_GATE = (
    "SELECT *, CASE WHEN k = 0 THEN 'block' WHEN k = 5 THEN 'warn' WHEN fresh AND hook IS NOT NULL THEN 'block' WHEN fresh OR hook IS NOT NULL THEN 'warn' ELSE 'ok' END AS level FROM (SELECT k, hook, CASE WHEN k NOT IN (0, 5) THEN hours + p_size END AS age, coalesce(hours + p_size < 72, false) AS fresh, "
    "CASE WHEN k = 0 THEN 'keyv' ELSE base || '-' || lower(replace(p_name, ' ', '-')) || '-' || p_partkey END AS name, CASE WHEN k = 0 THEN '6.0.0' ELSE '1.' || p_size END AS version FROM part JOIN "
    + _values([(i, *p) for i, p in enumerate(PACKAGES)], "k, base, hours, hook") + f" ON k = p_partkey % {len(PACKAGES)})"
)


def oracle_sql() -> dict[str, str]:
    out = {_name(r): _with(f"SELECT {oracle.COLUMNS} FROM ({oracle.rule_sql(r)})", more=oracle.scopes_cte() if oracle.needs_scopes(r) else "") for r in portable()}
    audited = lambda body: _with(body, more=_audited_sql())
    base = "regexp_extract(relative_path, '[^/]*$')"
    folders = f"list_filter(string_split(relative_path, '/')[1:-2], lambda x: list_contains([{', '.join(map(quote, S.PRUNED))}], x))"
    disabled = " AND ".join(f"NOT (rule_id = {quote(r)} AND contains(relative_path, {quote(p.removeprefix('^').removesuffix('$'))}))" for r, ps in DISABLED.items() for p in ps)
    size = "octet_length(encode(content))"
    secret = "|".join(f"(?:{p.regex})" for p in next(r for r in A.LINE_RULES if r.id == "exposed-secrets").patterns)
    labels = _values([*catalog.OWASP_LABELS.items(), ("Other", "Other")], "owasp_category, label")
    small_grades = f"grades AS ({_GRADED})"
    return out | {
        "page_tag_rules": _with(_union(PAGE_RULES), corpus.PAGES_SQL),
        _name(A.HISTORY_RULE): _with(
            f"SELECT file_id, repo, relative_path, 'git-history-secrets' AS rule_id, 'critical' AS severity, 'A secret was committed in ' || substring(sha1(CAST(file_id AS VARCHAR)), 1, 12) AS message, CAST(NULL AS INTEGER) AS line, "
            f"substring(regexp_replace({oracle.trim('added_line')}, {quote(secret)}, '***', 'g'), 1, 120) AS evidence FROM (SELECT file_id, repo, relative_path, unnest(string_split(content, chr(10))) AS added_line FROM files) WHERE regexp_matches(added_line, {quote(secret)})"
        ),
        "scan_predicate": _with(
            f"SELECT file_id, relative_path, lower(regexp_extract({base}, '^.+(\\.[^.]*)$', 1)) AS ext, (lower(regexp_extract({base}, '^.+(\\.[^.]*)$', 1)) IN ({', '.join(map(quote, S.EXTENSIONS))}) OR {base} IN ({', '.join(map(quote, S.ALWAYS))})) "
            f"AND len({folders}) = 0 AND {size} <= {S.MAX_BYTES} AND {size} > 0 AS scanned, list_contains(string_split(relative_path, '/'), 'docs') OR list_contains(string_split(relative_path, '/'), 'infra') AS ignored FROM files"
        ),
        "lines_explode": _with(f"SELECT file_id, CAST(line AS INTEGER) AS line, CAST(length({oracle.trim('text')}) AS INTEGER) AS trimmed_chars FROM (SELECT file_id, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files)"),
        "file_classes": _with(f"SELECT file_id, relative_path, {oracle.is_client()} AS is_client, {oracle.either([oracle.matches('content', fileclass.SERVER_ONLY_IMPORT), oracle.matches('relative_path', fileclass.SERVER_PATH, 'i'), oracle.directive('use server')])} AS is_server_only, {oracle.matches('relative_path', fileclass.PUBLIC_ROUTE, 'i')} AS public_route FROM files"),
        "entropy_tokens": "WITH t AS (SELECT row_number() OVER () AS n, doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{12,}')) AS token FROM documents)), c AS (SELECT n, doc_id, token, unnest(string_split(token, '')) AS c FROM t), p AS (SELECT n, doc_id, token, count(*) / CAST(length(token) AS DOUBLE) AS p FROM c GROUP BY n, doc_id, token, c) SELECT doc_id, token, round(sum(-p * log2(p)), 6) AS bits FROM p GROUP BY n, doc_id, token",
        "script_blocks": _with("SELECT file_id, relative_path, kind, name, exported, head, start, stop FROM scopes JOIN files USING (file_id)", more=oracle.scopes_cte()),
        "call_scopes": _with(
            "SELECT c.file_id, c.relative_path, CAST(c.off AS INTEGER) AS pos, callee, arg_max(s.name, s.start) FILTER (s.kind <> 'loop') AS function, max(s.start) FILTER (s.kind <> 'loop') AS function_pre, max(s.start) FILTER (s.kind = 'loop') AS loop_pre "
            f"FROM (SELECT *, regexp_extract(hits[j], '^[\\w$.]+') AS callee FROM ({oracle.placed('SELECT * FROM quiet', 'code', scopes.CALL, '', '0')})) c LEFT JOIN scopes s ON s.file_id = c.file_id AND c.off BETWEEN s.start AND s.stop - 1 WHERE callee NOT IN ({', '.join(map(quote, scopes.NO_CALL))}) GROUP BY ALL", more=oracle.scopes_cte(),
        ),
        "unguarded_places": _with(
            "SELECT d.file_id, d.relative_path, CAST(d.off AS INTEGER) AS pos, d.n AS danger, d.function, d.pre AS function_pre FROM seen d WHERE d.n < "
            f"{len(DANGERS)} AND NOT EXISTS (SELECT 1 FROM seen g WHERE g.n >= {len(DANGERS)} AND g.file_id = d.file_id AND g.pre = d.pre)",
            more=oracle.scopes_cte() + ", spots AS (" + " UNION ALL ".join(f"SELECT file_id, relative_path, off, {i} AS n FROM ({oracle.placed('SELECT * FROM quiet', 'code', r, f, '0')})" for i, (r, f) in enumerate((*DANGERS, *GUARDS)))
            + "), seen AS (SELECT p.*, arg_max(s.name, s.start) AS function, max(s.start) AS pre FROM spots p LEFT JOIN scopes s ON s.file_id = p.file_id AND s.kind <> 'loop' AND p.off BETWEEN s.start AND s.stop - 1 GROUP BY ALL)",
        ),
        "script_quiet": _with("SELECT file_id, relative_path, code, plain FROM quiet", more=oracle.scopes_cte()),
        "suppression_directives": _with("SELECT * FROM directives", more=_directive_sql()),
        "suppress_antijoin": audited(f"SELECT {oracle.COLUMNS} FROM kept"),
        "disabled_paths_antijoin": _with(f"SELECT * FROM ({_union(SMALL)}) WHERE {disabled}"),
        "disabled_paths_table": _with(
            f"SELECT * FROM ({_union(SMALL)}) f WHERE NOT EXISTS (SELECT 1 FROM settings s WHERE s.rule_id = f.rule_id AND contains(f.relative_path, s.text))",
            more=f"settings AS (SELECT ([{', '.join(map(quote, SMALL))}])[((file_id % {len(SMALL)}) + {len(SMALL)}) % {len(SMALL)} + 1] AS rule_id, substring(relative_path, ((file_id % 7) + 7) % 7 + 1, ((file_id % 9) + 9) % 9 + 2) AS text FROM files WHERE ((file_id % 20) + 20) % 20 = 1)",
        ),
        "project_settings_join": _with(f"SELECT * FROM ({_union(SMALL)}) WHERE NOT (ends_with(repo, '3') AND (rule_id = 'weak-hashing' OR list_contains(string_split(relative_path, '/'), 'components') OR (rule_id = 'hardcoded-ip' AND contains(relative_path, 'src/lib'))))"),
        "route_urls": _with(f"SELECT file_id, relative_path, {_url_sql()} AS url FROM files"),
        "enrich_and_sort": audited(f"SELECT {oracle.COLUMNS}, rule_ord, rule_name, cwe_id, cvss_score, owasp_category, wcag, fix FROM findings ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, repo, file_id, rule_ord, line, message"),
        "agg_by_severity": audited(f"SELECT *, CASE WHEN critical > 0 THEN 'F' WHEN warning > 5 THEN 'D' WHEN warning > 0 THEN 'C' WHEN info > 0 THEN 'B' ELSE 'A' END AS grade FROM (SELECT {_COUNTS} FROM findings)"),
        "agg_by_file": audited(f"SELECT repo, file_id, relative_path, {_COUNTS} FROM findings GROUP BY repo, file_id, relative_path"),
        "agg_by_owasp": audited(f"SELECT v.owasp_category, label, CAST(count(f.rule_id) AS BIGINT) AS n FROM {labels} LEFT JOIN findings f ON coalesce(f.owasp_category, 'Other') = v.owasp_category GROUP BY v.owasp_category, label"),
        "cvss_histogram": audited(
            "SELECT v.band, CAST(count(f.rule_id) AS BIGINT) AS n FROM " + _values([(b,) for b in ("critical", "high", "medium", "low", "info")], "band") + " LEFT JOIN (SELECT *, CASE WHEN coalesce(cvss_score, 0) >= 9 THEN 'critical' WHEN coalesce(cvss_score, 0) >= 7 THEN 'high' WHEN coalesce(cvss_score, 0) >= 4 THEN 'medium' WHEN coalesce(cvss_score, 0) > 0 THEN 'low' ELSE 'info' END AS band FROM findings) f USING (band) GROUP BY v.band"
        ),
        "severity_bar": audited(f"SELECT total, critical_cells, warning_cells, CAST(greatest(0, 40 - critical_cells - warning_cells) AS INTEGER) AS info_cells FROM (SELECT total, CAST(floor(critical * 40.0 / total + 0.5) AS INTEGER) AS critical_cells, CAST(floor(warning * 40.0 / total + 0.5) AS INTEGER) AS warning_cells FROM (SELECT {_COUNTS} FROM findings))"),
        "exit_status": audited("SELECT CAST(coalesce(bool_or(severity IN ('critical', 'warning')), false) AS INTEGER) AS exit_code FROM findings"),
        "silent_rules": audited("SELECT rule_id FROM rules r WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.rule_id = r.rule_id)"),
        "fix_guide": audited("SELECT CAST(min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS INTEGER) AS severity_rank, rule_id, rule_name, fix, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT repo || '/' || relative_path) AS BIGINT) AS files FROM findings GROUP BY rule_id, rule_name, rule_ord, fix"),
        "portfolio_repo_grades": _with(_GRADED, more=_audited_sql(portable())),
        "portfolio_worst_repos": _with(f"SELECT * FROM grades ORDER BY {_WORST}, criticals DESC, warnings DESC, repo LIMIT 20", more=_audited_sql() + ", " + small_grades),
        "portfolio_summary": _with(
            "SELECT *, skipped + total AS attempted, CASE WHEN total = 0 THEN 2 WHEN criticals > 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT CAST(count(*) AS BIGINT) AS total, " + ", ".join(f"CAST(count(*) FILTER (grade = '{g}') AS BIGINT) AS grade_{g.lower()}" for g in portfolio.GRADES)
            + f", CAST(sum(criticals) AS BIGINT) AS criticals, CAST(sum(warnings) AS BIGINT) AS warnings, CAST({len(ERRORS)} AS BIGINT) AS skipped, CAST(5 AS BIGINT) AS blocked FROM grades)", more=_audited_sql() + ", " + small_grades,
        ),
        "portfolio_discovery": _with("SELECT found, saved, found >= saved * 0.75 AS accepted FROM (SELECT CAST(count(*) FILTER (NOT ends_with(repo, '7')) AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS saved FROM (SELECT DISTINCT repo FROM files))"),
        "middleware_rescore": _with(
            "SELECT file_id, repo, relative_path, rule_id, CASE WHEN prefix IS NOT NULL AND severity = 'critical' THEN 'warning' ELSE severity END AS severity, "
            "CASE WHEN prefix IS NOT NULL AND severity = 'critical' THEN message || '; the middleware covers ' || prefix || ', make sure that it holds for this route' ELSE message END AS message, line, evidence FROM covered",
            more=_audited_sql(("missing-auth",)) + ", " + _rescored_sql(),
        ),
        "dependency_findings": _with("SELECT * FROM found", more=_dependency_sql()),
        "stream_versions": _with(
            f"SELECT {oracle.COLUMNS} FROM kept",
            corpus.sql().replace("files AS (", "landed AS (") + f""",
files AS (SELECT file_id, repo, 'f' || file_id || '/' || relative_path AS relative_path, CASE WHEN ((file_id % 3) + 3) % 3 = 0 THEN {quote(SECOND)} ELSE content END AS content FROM landed WHERE file_id % 5 <> 0)""",
            _audited_sql(),
        ),
        "stream_audit": audited(f"SELECT {oracle.COLUMNS} FROM kept"),
        "fix_guide_files": audited("SELECT rule_id, repo, relative_path, CAST(min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS INTEGER) AS severity_rank, CAST(count(*) AS BIGINT) AS n, min(line) AS first_line FROM findings GROUP BY rule_id, repo, relative_path"),
        "report_sections": audited(
            f"SELECT CAST(section AS INTEGER) AS section, CAST(severity_rank AS INTEGER) AS severity_rank, CAST(place AS INTEGER) AS place, text FROM (WITH s AS (SELECT {_COUNTS} FROM findings) "
            "SELECT 0 AS section, 0 AS severity_rank, 0 AS place, '# Audit: grade ' || CASE WHEN critical > 0 THEN 'F' WHEN warning > 5 THEN 'D' WHEN warning > 0 THEN 'C' WHEN info > 0 THEN 'B' ELSE 'A' END AS text FROM s "
            "UNION ALL SELECT 0, 0, 1, '| Severity | Findings |' UNION ALL SELECT 0, 0, 2, '|---|---|' UNION ALL SELECT 2, 0, 0, '## OWASP' "
            + "".join(f"UNION ALL SELECT 0, 0, {3 + i}, '| {x} | ' || {x} || ' |' FROM s UNION ALL SELECT 1, {i}, 0, '## {x.capitalize()} (' || {x} || ')' FROM s " for i, x in enumerate(("critical", "warning", "info")))
            + f"UNION ALL SELECT 2, 0, 1, '- ' || v.owasp_category || ' ' || label || ': ' || count(*) FROM {labels} JOIN findings f ON coalesce(f.owasp_category, 'Other') = v.owasp_category GROUP BY v.owasp_category, label)"
        ),
        "matcher_prefixes": f"SELECT page_id, raw AS raw, {_prefix_sql('raw')} AS prefix FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'x' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) || ([{', '.join(map(quote, TAILS))}])[page_id % {len(TAILS)} + 1] AS raw FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL)",
        "target_parser": f"SELECT page_id, target, CASE WHEN names THEN o END AS owner, CASE WHEN names THEN r END AS repo FROM (SELECT page_id, o, r, page_id % {len(ADDRESSES)} IN ({', '.join(map(str, NAMING))}) AND o <> '' AS names, replace(replace(([{', '.join(map(quote, ADDRESSES))}])[page_id % {len(ADDRESSES)} + 1], '{{o}}', o), '{{r}}', r) AS target "
        "FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([a-z]+)', 1) AS o, 'p' || page_id AS r FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL))",
        "package_specs": f"SELECT p, spec, regexp_matches(spec, {quote(dependencies.SPEC.replace(chr(92) + 'z', '$'))}) AS valid FROM (SELECT p_partkey AS p, replace(replace(([{', '.join('chr(10)'.join(map(quote, x.split(chr(10)))).replace(chr(39) + 'chr(10)' + chr(39), chr(39) + ' || chr(10) || ' + chr(39)) for x in SPECS)}])[p_partkey % {len(SPECS)} + 1], '{{w}}', lower(replace(p_name, ' ', '-'))), '{{n}}', CAST(p_size AS VARCHAR)) AS spec FROM part)",
        "scan_errors": "SELECT event_id, CASE kind WHEN 'rate-limited' THEN 'Rate limited' WHEN 'access-denied' THEN 'Access denied' WHEN 'auth-required' THEN 'Sign-in needed' WHEN 'not-found' THEN 'Not found or empty' WHEN 'empty' THEN 'Empty repository' ELSE substring(coalesce(message, ''), 1, 120) END AS label, kind, kind = 'rate-limited' AS rate_limited FROM (SELECT event_id, message, "
        "CASE WHEN code IN ('403', '429') AND coalesce(limited, regexp_matches(coalesce(message, ''), '(?i)rate limit|abuse detection')) THEN 'rate-limited' WHEN code IN ('403', '429') THEN 'access-denied' WHEN code = '401' THEN 'auth-required' WHEN code = '404' THEN 'not-found' WHEN code = '409' THEN 'empty' ELSE 'error' END AS kind "
        f"FROM (SELECT *, coalesce(CAST(status AS VARCHAR), regexp_extract(coalesce(message, ''), '401|403|404|409|429')) AS code FROM (SELECT event_id, status, limited, said || ' after ' || coalesce(event_type, '') AS message FROM events JOIN {_values([(i, s, limited, m) for i, (_, s, limited, m) in enumerate(ERRORS)], 'k, status, limited, said')} ON k = event_id % {len(ERRORS)})))",
        "npm_audit": "SELECT p_partkey AS file_id, 'repo' || p_partkey AS repo, 'package.json' AS relative_path, 'vulnerable-dependency' AS rule_id, CASE WHEN p_size > 30 THEN 'critical' WHEN p_size > 15 THEN 'warning' ELSE 'info' END AS severity, lower(replace(p_name, ' ', '-')) || '@<' || p_size || ': ' || CASE p_partkey % 5 WHEN 0 THEN p_name || ', b' WHEN 1 THEN p_name "
        "ELSE CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 30 THEN 'high' WHEN p_size > 15 THEN 'moderate' ELSE 'low' END END AS message, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS evidence FROM part WHERE p_partkey % 5 < 3",
        "gate_packages": f"SELECT name, version, level, concat_ws('; ', CASE WHEN k = 0 THEN 'this version is known to be malicious' WHEN k = 5 THEN 'the registry couldn''t be asked' END, CASE WHEN hook IS NOT NULL THEN 'runs code at install: ' || hook END, CASE WHEN fresh THEN 'published ' || age || ' hours ago' END) AS reasons, CAST(age AS DOUBLE) AS age_hours, coalesce(hook, '') AS install_scripts FROM ({_GATE})",
        "gate_levels": f"SELECT name, version, level FROM ({_GATE})",
        "gate_status": f"SELECT *, CASE WHEN blocked > 0 THEN 2 WHEN warned > 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT count(*) AS total, count(*) FILTER (level = 'block') AS blocked, count(*) FILTER (level = 'warn') AS warned FROM ({_GATE}))",
    }
