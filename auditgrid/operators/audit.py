"""The audit: rules over files, suppression, re-scoring, taxonomy and order."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrid.config import CONFIG_NAME, Config
from auditgrid.functions.text import js_trim, lines, matches
from auditgrid.operators.blocks import quieted
from auditgrid.operators.match import code_findings, content_findings, file_findings, guarded, line_findings
from auditgrid.operators.modules import across_files, guarded_functions
from auditgrid.rules import catalog, content_rules, file_checks, file_rules, line_rules, markup_rules, scope_rules
from auditgrid.rules.spec import UserRule
from auditgrid.schema import FINDINGS_DDL, KEYS
from auditgrid.sources.files import ignored

LINE_RULES = (*line_rules.RULES, *scope_rules.FALLBACK_LINES)
CONTENT_RULES = (*content_rules.RULES, *markup_rules.RULES)
FILE_RULES = (*file_rules.RULES, *file_checks.ORDERED, *scope_rules.FALLBACK_FILES)
#: The rule that reads a table of past commits and no files.
HISTORY_RULE = "git-history-secrets"
#: ``audit-ignore`` and its longer spellings: the mark, ``-next-line``, and rule ids.
DIRECTIVE = r"(?i)audit-ignore(-next-line)?(?:\s*[:=]?\s*([\w-]+(?:\s*+,\s*+[\w-]++)*+))?"
MIDDLEWARE = r"(?:^|\/)(?:src\/)?middleware\.[mc]?[jt]sx?$"
MIDDLEWARE_CALLS = r"\b(?:clerkMiddleware|authMiddleware|withClerkMiddleware|withAuth|NextAuth|updateSession|createMiddlewareClient|createServerClient)\s*\("


MATCHER = r"\bmatcher['\"]?\s*:\s*(\[[^\]]*\]|'[^'\n]*'|\"[^\"\n]*\")"
#: What a matcher may end in behind its plain prefix.
MATCHER_TAILS = (r"\/:\w+\*?\??.*\z", r"\/?\(\.\*\)\$?\z", r"\/?\.\*\$?\z", r"\$\z", r"\/+\z")


def rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def run_rules(files: DataFrame, ids: list[str], config: Config = Config(), extra: tuple[UserRule, ...] = ()) -> DataFrame:
    """Findings of the rules named and of a project's own, unordered. Files are read once for each kind of rule that is asked for."""
    wanted = set(ids)
    if taken := {u.rule.id for u in extra} & set(catalog.IDS):
        raise ValueError(f"these rules exist: {', '.join(sorted(taken))}")
    severity = catalog.SEVERITY | {u.rule.id: u.severity for u in extra}

    def chosen(rules: tuple) -> list:
        kinds = tuple({type(r) for r in rules})
        return [r for r in rules if r.id in wanted] + [u.rule for u in extra if isinstance(u.rule, kinds)]

    parts = []
    if picked := chosen(LINE_RULES):
        parts.append(line_findings(files, picked, severity))
    if picked := chosen(CONTENT_RULES):
        parts.append(content_findings(files, picked, severity))
    checks = [_configured(c, config) for r in catalog.IDS if r in wanted for c in file_checks.CHECKS.get(r, ())]
    if (picked := chosen(FILE_RULES)) or checks:
        parts.append(file_findings(files, picked, checks, severity))
    scopes, codes = chosen(scope_rules.SCOPE_RULES), chosen(scope_rules.CODE_RULES)
    if scopes or codes:
        parts.append(code_findings(files, scopes, codes, severity, config.custom_auth_guards))
    empty = files.sparkSession.createDataFrame([], FINDINGS_DDL)
    return reduce(DataFrame.unionByName, parts, empty) if parts else empty


def _configured(check, config: Config):
    if check in file_checks.TAKES_ESCAPERS and config.custom_escapers:
        return partial(check, escapers=config.custom_escapers)
    if check is file_checks.install_script_dependency and config.allowed_install_scripts:
        return partial(check, allowed=config.allowed_install_scripts)
    return check


def history_findings(patches: DataFrame) -> DataFrame:
    """Secrets in added lines of past commits: ``patches`` has (file_id, repo, commit, relative_path, added_line)."""
    rule = next(r for r in line_rules.RULES if r.id == "exposed-secrets")
    hit = reduce(lambda a, b: a | b, [matches(F.col("added_line"), p.regex, p.flags) for p in rule.patterns])
    secret = "|".join(f"(?:{p.regex})" for p in rule.patterns)
    shown = F.substring(F.regexp_replace(js_trim(F.col("added_line")), secret, "***"), 1, 120)
    return patches.where(hit).select(
        *KEYS, F.lit(HISTORY_RULE).alias("rule_id"), F.lit("critical").alias("severity"), F.concat(F.lit("A secret was committed in "), F.substring("commit", 1, 12)).alias("message"),
        F.lit(None).cast("int").alias("line"), shown.alias("evidence"), F.lit(0).cast("long").alias("finding_ord"),
    )


def enabled_paths(findings: DataFrame, disable_for_paths: dict[str, tuple[str, ...]]) -> DataFrame:
    """Without findings of rules that are off for paths containing a text; the settings' texts are never patterns."""
    for rule, parts in disable_for_paths.items():
        for p in parts:
            bare = p.removeprefix("^").removesuffix("$")
            findings = findings.where(~((F.col("rule_id") == rule) & F.col("relative_path").contains(bare)))
    return findings


#: Length of the pieces of paths and texts by which ``paths_with`` finds candidates.
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct pieces of a text, of ``GRAM`` characters and, for texts that are shorter, fewer."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def paths_with(paths: DataFrame, settings: DataFrame) -> DataFrame:
    """``rule_id, relative_path``: the pairs of ``settings`` (rule_id, text) and ``paths`` (relative_path) where the path contains the text.

    A join of pieces: each text is looked up by the one of its longest pieces that the fewest paths have, and what is found
    is compared. Empty and null texts count in no path.
    """
    known = settings.where("rule_id is not null and text is not null").select("rule_id", "text").distinct()
    texts = known.where("text <> ''").select("text").distinct()
    pieces = texts.select("text", F.explode(F.filter(_grams(F.col("text")), lambda g: F.length(g) == F.least(F.length("text"), F.lit(GRAM)))).alias("gram"))
    each = paths.where("relative_path is not null").select("relative_path").distinct()
    # Pieces that no text has leave before anything is counted or shuffled by them.
    parts = each.select("relative_path", F.explode(_grams(F.col("relative_path"))).alias("gram")).join(pieces.select("gram").distinct(), "gram", "left_semi")
    often = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(often, "gram", "left").groupBy("text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = parts.join(rarest, "gram").where(F.col("relative_path").contains(F.col("text"))).select("text", "relative_path")
    return found.join(known, "text").select("rule_id", "relative_path").distinct()


def enabled_by_table(findings: DataFrame, settings: DataFrame, paths: DataFrame) -> DataFrame:
    """Without findings of rules that a row of ``settings`` (rule_id, text) turns off for paths containing the text, however many rows there are.

    ``paths`` has the files' paths. A row whose text is empty turns its rule off everywhere.
    """
    bare = settings.withColumn("text", F.regexp_replace("text", r"^\^|\$\z", ""))
    off = bare.where("text = ''").select(F.col("rule_id").alias("off_rule")).distinct()
    pairs = paths_with(paths, bare).select(F.col("rule_id").alias("off_rule"), F.col("relative_path").alias("off_path"))
    left = findings.join(off, F.col("rule_id") == F.col("off_rule"), "left_anti")
    return left.join(pairs, (F.col("rule_id") == F.col("off_rule")) & (F.col("relative_path") == F.col("off_path")), "left_anti")


def directives(files: DataFrame) -> DataFrame:
    """``(file_id, repo, relative_path, target, ids)``: lines that a comment frees from rules; null ids stand for all rules."""
    marked = files.where(F.lower("content").contains("audit-ignore")).select(*KEYS, F.posexplode(lines(F.col("content"))).alias("i", "text")).where(F.lower("text").contains("audit-ignore"))
    next_line = F.regexp_extract("text", DIRECTIVE, 1) != ""
    ids = F.regexp_extract("text", DIRECTIVE, 2)
    return marked.select(*KEYS, (F.col("i") + F.when(next_line, 2).otherwise(1)).alias("target"), F.when(ids != "", F.transform(F.split(ids, ","), lambda x: F.trim(x))).alias("ids"))


def unsuppressed(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings that no comment on their line, or on the line before, frees. Those without a line stay."""
    d = directives(files).select(F.col("file_id").alias("d_file"), F.col("repo").alias("d_repo"), F.col("relative_path").alias("d_path"), "target", "ids")
    same = (F.col("file_id") == F.col("d_file")) & (F.col("relative_path") == F.col("d_path")) & F.col("repo").eqNullSafe(F.col("d_repo"))
    freed = same & (F.col("line") == F.col("target")) & (F.col("ids").isNull() | F.array_contains("ids", F.col("rule_id")))
    return findings.join(d, freed, "left_anti")


def matcher_prefix(raw: Column) -> Column:
    """The path prefix that a middleware's matcher covers; null where it is no plain prefix."""
    p = js_trim(raw)
    for pattern in MATCHER_TAILS:
        p = F.regexp_replace(p, pattern, "")
    plain = F.when(p == "", "/").when(p.rlike(r"[()\[\]{}*+?|\\^$]"), None).otherwise(p)
    return F.when(~js_trim(raw).startswith("/"), None).when(raw.contains("(?!"), "/").otherwise(plain)


def route_url(path: Column) -> Column:
    """The address that a route's file answers; null for other files."""
    app = F.regexp_extract(path, r"(?i)(?:^|\/)app\/(.+)\/route\.[mc]?[jt]sx?\z", 1)
    pages = F.regexp_extract(path, r"(?i)(?:^|\/)pages\/(api\/.+)\.[mc]?[jt]sx?\z", 1)
    parts = F.filter(F.split(app, "/"), lambda s: ~s.rlike(r"^\(.*\)\z") & ~s.startswith("@"))
    return F.when(app != "", F.concat(F.lit("/"), F.array_join(parts, "/"))).when(pages != "", F.concat(F.lit("/"), F.regexp_replace(pages, r"\/index\z", "")))


def middleware(files: DataFrame) -> DataFrame:
    """``(repo, prefixes)`` of repositories whose last middleware file checks users and has plain matchers."""
    rows = quieted(files.where(matches(F.col("relative_path"), MIDDLEWARE, "i")))
    code = F.col("code")
    listed = F.regexp_extract(code, MATCHER, 1)
    raw = F.transform(F.regexp_extract_all(listed, F.lit(r"'[^'\n]*'|\"[^\"\n]*\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    prefixes = F.filter(F.transform(raw, matcher_prefix), lambda x: x.isNotNull())
    facts = rows.select("repo", "file_id", prefixes.alias("prefixes"), (guarded(code, code, False) | matches(code, MIDDLEWARE_CALLS)).alias("guards"))
    last = facts.groupBy("repo").agg(F.max_by(F.struct("prefixes", "guards"), "file_id").alias("m"))
    return last.where("m.guards and size(m.prefixes) > 0").select("repo", "m.prefixes")


def middleware_files(files: DataFrame, config: Config = Config()) -> DataFrame:
    """The files that ``middleware`` reads, without those that an audit by ``config`` ignores."""
    path = F.col("relative_path")
    return files.where(F.col("content").isNotNull() & matches(path, MIDDLEWARE, "i") & ~ignored(path, config.ignore)).select(*KEYS, "content")


def url_prefixes(url: Column) -> Column:
    """``/``, and the address cut behind each of its parts, itself included."""
    parts = F.filter(F.split(url, "/"), lambda x: x != "")
    return F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def covered(routes: DataFrame, guards: DataFrame) -> DataFrame:
    """``repo, relative_path, prefix``: the routes among the paths of ``routes`` that middleware covers, by the first of its prefixes that does.

    An equality join: a route has a row for each prefix of its address, and each repository's middleware a row for each of its own.
    """
    url = route_url(F.col("relative_path"))
    ways = routes.where(url.isNotNull()).select("repo", "relative_path").distinct().select("repo", "relative_path", F.explode(F.array_distinct(url_prefixes(url))).alias("prefix"))
    known = guards.select("repo", F.posexplode("prefixes").alias("place", "prefix"))
    return ways.join(known, ["repo", "prefix"]).groupBy("repo", "relative_path").agg(F.min_by("prefix", "place").alias("prefix"))


def rescored(findings: DataFrame, guards: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Critical missing-auth findings become warnings where the repository's middleware covers the route.

    ``routes`` has the paths of the files, where they come cheaper than those of the findings.
    """
    asked = (F.col("rule_id") == "missing-auth") & (F.col("severity") == "critical")
    covers = covered(findings.where(asked) if routes is None else routes, guards).select(F.col("repo").alias("c_repo"), F.col("relative_path").alias("c_path"), "prefix")
    joined = findings.join(covers, (F.col("repo") == F.col("c_repo")) & (F.col("relative_path") == F.col("c_path")) & asked, "left")
    by = F.col("prefix")
    return joined.withColumns({
        "severity": F.when(by.isNotNull(), "warning").otherwise(F.col("severity")),
        "message": F.when(by.isNotNull(), F.concat("message", F.lit("; the middleware covers "), by, F.lit(", make sure that it holds for this route"))).otherwise(F.col("message")),
    }).select(*findings.columns)


def _strings(value: Column, path: str) -> Column:
    """The strings of a JSON array; anything else in it doesn't count."""
    items = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))


def project_configs(files: DataFrame) -> DataFrame:
    """``(repo, ignore, rules, exclude, disabled)`` of the repositories that ship settings; broken JSON gives none.

    disabled maps a rule to texts of paths where it is off.
    """
    raw = files.where(F.col("relative_path") == CONFIG_NAME).groupBy("repo").agg(F.max_by("content", "file_id").alias("text"))
    parsed = raw.select("repo", F.try_parse_json("text").alias("v")).where("v is not null")
    off = F.coalesce(F.try_variant_get("v", "$.disableForPaths", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    v = F.col("v")
    return parsed.select(
        "repo", F.transform(_strings(v, "$.ignore"), lambda x: F.regexp_replace(x, r"/\z", "")).alias("ignore"), _strings(v, "$.rules").alias("rules"), _strings(v, "$.exclude").alias("exclude"),
        F.transform_values(off, lambda k, x: F.transform(_strings(x, "$"), lambda p: F.regexp_replace(p, r"^\^|\$\z", ""))).alias("disabled"),
    )


def configured(findings: DataFrame, configs: DataFrame) -> DataFrame:
    """Findings that their own repository's settings leave; repositories without settings keep all."""
    path, rule = F.col("relative_path"), F.col("rule_id")
    joined = findings.join(configs.withColumnRenamed("repo", "c_repo"), F.col("repo") == F.col("c_repo"), "left")
    wanted = (F.size("rules") == 0) | F.array_contains("rules", rule)
    outside = ~F.exists(F.split(path, "/"), lambda f: F.array_contains("ignore", f))
    on = ~F.exists(F.coalesce(F.try_element_at("disabled", rule), F.array().cast("array<string>")), lambda p: path.contains(p))
    return joined.where(F.col("c_repo").isNull() | (wanted & ~F.array_contains("exclude", rule) & outside & on)).select(*findings.columns)


def enriched(findings: DataFrame, extra: tuple[UserRule, ...] = ()) -> DataFrame:
    """With the rule's order, name, taxonomy and advice. The dimension has one row per rule, so it is broadcast."""
    own = [(len(catalog.ALL) + i, u.rule.id, u.name, u.severity, u.cwe_id, u.cvss_score, u.owasp_category, u.wcag, u.fix) for i, u in enumerate(extra)]
    rules = findings.sparkSession.createDataFrame([*catalog.ALL, *own], catalog.SCHEMA)
    return findings.join(F.broadcast(rules.drop("default_severity")), "rule_id", "left")


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, then repository, file, rule and place; the order doesn't depend on partitions."""
    return findings.orderBy(rank(F.col("severity")), "repo", "relative_path", "file_id", "rule_ord", "finding_ord", "line", "message")


def audit(files: DataFrame, config: Config = Config(), dependencies: DataFrame | None = None, extra_ignore: tuple[str, ...] = (), per_project: bool = False, rescore: bool = True, extra: tuple[UserRule, ...] = (), follow_imports: bool = False) -> DataFrame:
    """Findings of all active rules on ``files``, suppressed, re-scored and enriched; not ordered.

    per_project: each repository's own settings file counts as well. rescore: middleware among ``files`` counts. extra: a project's own rules, whatever the configuration lists. follow_imports: handlers that check the user through functions of other files count as guarded, which takes rounds over written tables at once. ``dependencies`` are findings of dependency checks, which rule lists and comments don't touch.
    Files with a null content or path have none; an empty table gives an empty result.
    """
    ids = [r for r in catalog.active(config.rules, config.exclude) if r != HISTORY_RULE]
    files = files.where(F.col("content").isNotNull() & F.col("relative_path").isNotNull())
    kept = files.where(~ignored(F.col("relative_path"), (*config.ignore, *extra_ignore)))
    found = unsuppressed(enabled_paths(run_rules(kept, ids, config, extra), config.disable_for_paths), kept)
    if per_project:
        found = configured(found, project_configs(files))
    if follow_imports and "missing-auth" in ids:
        found = across_files(found, guarded_functions(kept, config.custom_auth_guards))
    if rescore and "missing-auth" in ids:
        found = rescored(found, middleware(kept), kept)
    if dependencies is not None:
        found = found.unionByName(dependencies)
    return enriched(found, extra)


def exit_status(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row, exit_code: 1 with a critical finding or, when strict, a warning; else 0."""
    bad = F.col("severity") == "critical"
    if strict:
        bad |= F.col("severity") == "warning"
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).cast("int").alias("exit_code"))
