"""Evaluation of the declarative rules: one pass over files or lines for all rules of a shape.

Gates are computed once for each file; only lines of files with an open gate are exploded, and each
pattern is tried only where its rule's gate is open. There is no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrid.functions import fileclass
from auditgrid.functions.text import content_matches, evidence, first_line, first_match_line, has_literals, js_regex, js_trim, line_evidence, line_of, lines, literal_sets, match_offsets, match_starts, matches, remembered
from auditgrid.operators.blocks import CALLBACK_HINT, LOOP_HINT, quieted, scoped
from auditgrid.rules.scope_rules import AUTH_GUARD, GUARD_HINT, GUARD_MEMBER
from auditgrid.rules.spec import CODE, CodeRule, ContentRule, FileRule, LineRule, Pattern, ScopeRule, Test
from auditgrid.schema import EVIDENCE_CHARS, FOUND_DDL, KEYS


def every(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def some(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


@remembered
def holds(test: Test) -> Column:
    """On ``lowered`` files."""
    hit = matches(F.col("relative_path"), test.regex, test.flags) if test.on == "path" else content_matches(F.col("content"), test.regex, test.flags)
    return hit if test.wanted else ~hit


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With a column that is computed once for each row.

    A generator of one row keeps the optimizer from copying a costly expression into the filters that it
    pushes down, or infers from an explode, and into every place that uses the column.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def lowered(files: DataFrame) -> DataFrame:
    """With the numbers of the sets of literals that the content has (sets): they are asked for before regular expressions.

    To be called when the columns are made that ask for them.
    """
    return files.withColumn("sets", literal_sets(F.lower("content")))


@remembered
def gate(gates: tuple[Test, ...], any_gate: tuple[Test, ...]) -> Column:
    """On ``lowered`` files. Paths first: they are cheap."""
    ordered = sorted(gates, key=lambda t: t.on != "path")
    out = every(map(holds, ordered))
    return out & some(map(holds, any_gate)) if any_gate else out


def _all_may(texts: Iterable[tuple[str, str]]) -> Column | None:
    """Whether the literals occur in a ``lowered`` file without which these expressions (with flags) can't all match; null where they need none."""
    tests = [t for r, f in texts if (t := has_literals(r, f)) is not None]
    return every(tests) if tests else None


@remembered
def _may_find(rule: LineRule | ContentRule) -> Column | None:
    """Whether one of a rule's patterns can match somewhere in a file; null where a pattern needs no literal."""
    ways = [_all_may([(p.regex, p.flags), *p.also]) for p in rule.patterns]
    return some(ways) if all(w is not None for w in ways) else None


@remembered
def _rule_gate(rule: LineRule | ContentRule) -> Column:
    """The gate of a rule and the literals of its patterns: paths, then literals, then expressions on the content."""
    on_path = tuple(t for t in rule.gates if t.on == "path")
    tests = [gate(on_path, ())] + ([F.col("is_client")] if getattr(rule, "client", False) else [])
    if (literals := _may_find(rule)) is not None:
        tests.append(literals)
    return every([*tests, gate(tuple(t for t in rule.gates if t.on != "path"), rule.any_gate)])


def _open(rules: Sequence[LineRule | ContentRule], files: DataFrame) -> DataFrame:
    """Files with the numbers of the rules whose gates they pass, and whose patterns they have literals of."""
    numbers = [F.when(_rule_gate(r), F.lit(i)) for i, r in enumerate(rules)]
    files = lowered(files)
    if any(getattr(r, "client", False) for r in rules):
        files = once(files, "is_client", fileclass.is_client(F.col("relative_path"), F.col("content")))
    return once(files, "open", F.array_compact(F.array(*numbers))).where(F.size("open") > 0)


def _is_comment(trimmed: Column, comments: Sequence[str]) -> Column:
    return some(trimmed.startswith(c) for c in comments)


def file_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line: the files' keys, ``keep``, line (from 1), text and trimmed text."""
    out = files.select(*KEYS, *keep, F.posexplode(lines(F.col("content"))).alias("line0", "text"))
    out = out.withColumn("line", F.col("line0") + 1).drop("line0")
    return once(once(out, "trimmed", js_trim(F.col("text"))), "low", F.lower("text"))


@remembered
def _line_hit(p: Pattern) -> Column:
    text, low = F.col("text"), F.col("low")
    tests = [matches(text, p.regex, p.flags, low), *(matches(text, r, f, low) for r, f in p.also), *(~matches(text, r, f, low) for r, f in p.unless)]
    return every([matches(F.col("relative_path"), p.path, "i"), *tests] if p.path else tests)


@remembered
def _content_hit(p: Pattern) -> Column | None:
    return has_literals(p.regex, p.flags)


def line_findings(files: DataFrame, rules: Sequence[LineRule], severities: dict[str, str]) -> DataFrame:
    """Findings of all line rules, ordered within a file and rule by line, then pattern."""
    rows = file_lines(_open(rules, files).select(*KEYS, "content", "open"), "open")
    # A hit is the number of a pattern; what it stands for is looked up later.
    known: list[tuple[LineRule, Pattern, int]] = []
    hits = []
    for i, rule in enumerate(rules):
        numbered = [(_line_hit(p), F.lit(len(known) + k)) for k, p in enumerate(rule.patterns)]
        known += [(rule, p, k) for k, p in enumerate(rule.patterns)]
        live = F.array_contains("open", i) & ~_is_comment(F.col("trimmed"), rule.comments)
        if rule.first:
            hits.append(F.when(live, F.array_compact(F.array(reduce(lambda a, hn: a.when(*hn), numbered[1:], F.when(*numbered[0]))))))
        else:
            hits.append(F.when(live, F.array_compact(F.array(*[F.when(h, n) for h, n in numbered]))))

    def listed(values: Sequence) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("hit") + 1)

    out = once(rows, "hits", F.flatten(F.array_compact(F.array(*hits)))).withColumn("hit", F.explode("hits"))
    whole = [n for n, (r, _, _) in enumerate(known) if r.whole_evidence]
    cut = F.when(F.col("hit").isin(whole), F.col("trimmed")).otherwise(F.substring("trimmed", 1, EVIDENCE_CHARS)) if whole else F.substring("trimmed", 1, EVIDENCE_CHARS)
    return out.select(
        *KEYS, listed([r.id for r, _, _ in known]).alias("rule_id"), listed([p.severity or severities[r.id] for r, p, _ in known]).alias("severity"), listed([p.message for _, p, _ in known]).alias("message"),
        F.col("line").cast("int").alias("line"), cut.alias("evidence"), (F.col("line") * 100 + listed([k for _, _, k in known])).cast("long").alias("finding_ord"),
    )


def content_findings(files: DataFrame, rules: Sequence[ContentRule], severities: dict[str, str]) -> DataFrame:
    """Findings of all content rules, ordered within a file and rule by pattern, then offset."""
    content, text = F.col("content"), F.col("text")
    every_pattern = [(i, k, r, p) for i, r in enumerate(rules) for k, p in enumerate(r.patterns)]
    # The patterns are a table that one expression looks up: a tree of its own for each would take Spark longer to plan than to run.
    windows = [r.window or (None,) * 3 for _, _, r, _ in every_pattern]
    table = {
        "k": F.array(*[F.lit(k) for _, k, _, _ in every_pattern]), "regex": F.array(*[F.lit(js_regex(p.regex, p.flags)) for *_, p in every_pattern]), "before": F.array(*[F.lit(w[0]).cast("int") for w in windows]),
        "after": F.array(*[F.lit(w[1]).cast("int") for w in windows]), "from_end": F.array(*[F.lit(int(w[2] or 0)) for w in windows]),
    }
    live = []
    for n, (i, _, _, p) in enumerate(every_pattern):
        test = F.array_contains("open", i)
        if (literal := _content_hit(p)) is not None:
            test &= literal
        live.append(F.when(test, F.lit(n)))

    def of(name: str, n: Column) -> Column:
        return F.element_at(table[name], n + 1)

    def place(n: Column) -> Callable[[Column, Column], Column]:
        def one(m: Column, j: Column) -> Column:
            start = F.greatest(m["off"] - of("before", n), F.lit(0))
            near = F.when(of("before", n).isNotNull(), F.substring(content, start + 1, m["off"] + of("from_end", n) * F.length(m["text"]) + of("after", n) - start))
            return F.struct(of("k", n).alias("k"), n.alias("n"), m["off"].alias("off"), m["line"].alias("line"), m["text"].alias("text"), js_trim(F.element_at("ls", m["line"])).alias("line_text"), near.alias("near"), (j == 0).alias("first"))

        return one

    # Lines and surroundings are taken in the array, so a file's content isn't copied to its matches.
    rows = once(_open(rules, files), "live", F.array_compact(F.array(*live))).where(F.size("live") > 0)
    rows = once(once(rows, "ls", lines(content)), "ms", F.flatten(F.transform("live", lambda n: F.transform(match_offsets(content, of("regex", n)), place(n))))).select(*KEYS, F.explode("ms").alias("m")).select(*KEYS, "m.*")
    keep, parts = [], []
    for n, (i, _, rule, p) in enumerate(every_pattern):
        tests = [~_is_comment(F.col("line_text"), rule.comments)] if rule.comments else []
        if rule.first_only:
            tests.append(F.col("first"))
        tests += [*(matches(text, r, f) for r, f in p.also), *(~matches(text, r, f) for r, f in p.unless)]
        if rule.window:
            *_, regex, flags, wanted = rule.window
            inside = matches(F.col("near"), regex, flags)
            tests.append(inside if wanted else ~inside)
        if rule.group is not None:
            part = F.regexp_extract("text", js_regex(p.regex, p.flags), rule.group)
            parts.append((n, part))
            if rule.match_unless:
                tests.append(~matches(part, *rule.match_unless))
        keep.append((n, every(tests) if tests else F.lit(True)))

    def by_pattern(ways: Sequence[tuple[int, Column]], otherwise: Column) -> Column:
        return reduce(lambda a, w: a.when(F.col("n") == w[0], w[1]), ways[1:], F.when(F.col("n") == ways[0][0], ways[0][1])).otherwise(otherwise) if ways else otherwise

    def listed(values: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("n") + 1)

    message = F.replace(listed([p.message for *_, p in every_pattern]), F.lit("{0}"), by_pattern(parts, F.lit("")))
    out = rows.where(by_pattern(keep, F.lit(False))).select(
        *KEYS, listed([r.id for _, _, r, _ in every_pattern]).alias("rule_id"), listed([p.severity or severities[r.id] for _, _, r, p in every_pattern]).alias("severity"), message.alias("message"),
        "line", F.substring("line_text", 1, EVIDENCE_CHARS).alias("evidence"), (F.col("k").cast("long") * 10_000_000 + F.col("off")).alias("finding_ord"),
    )
    single = [r.id for r in rules if r.once_a_line]
    return once_each(out, F.col("rule_id").isin(single)) if single else out


def once_each(findings: DataFrame, single: Column) -> DataFrame:
    """Of equal findings that are ``single`` the first one, all others as often as they are there. The findings are made once: two parts of a union would each read the files."""
    place = F.when(~single, F.col("finding_ord"))
    same = findings.groupBy(*KEYS, "rule_id", "severity", "message", "line", "evidence", place.alias("place")).agg(F.min("finding_ord").alias("finding_ord"), F.count(F.lit(1)).cast("int").alias("n"))
    copies = F.when(F.col("place").isNull(), 1).otherwise(F.col("n"))
    return same.select(*KEYS, "rule_id", "severity", "message", "line", "evidence", F.explode(F.array_repeat("finding_ord", copies)).alias("finding_ord"))


def found(rule_id: str, severity: Column | str, message: Column | str, line: Column, shown: Column, order: Column) -> Column:
    """One finding as a struct."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(rule_id).alias("rule_id"), lit(severity).cast("string").alias("severity"), lit(message).cast("string").alias("message"),
        line.cast("int").alias("line"), shown.cast("string").alias("evidence"), order.cast("long").alias("finding_ord"),
    )


def present(findings: Sequence[Column]) -> Column:
    """The array of the findings that aren't null."""
    return F.filter(F.array(*findings), lambda x: x.isNotNull()).cast(FOUND_DDL)


@remembered
def file_rule(rule: FileRule, severity: str) -> Column:
    path, content = F.col("relative_path"), F.col("content")
    out = []
    for k, b in enumerate(rule.branches):
        line = first_line(content, *b.line) if b.line else F.lit(1)
        if b.at:
            line = F.coalesce(*[F.when(matches(path, p, "i"), first_match_line(content, r, f)) for r, f, p in b.at], F.lit(1))
        shown = line_evidence(content, line) if b.line or b.at else F.lit(None)
        out.append(F.when(every(map(holds, b.tests)), found(rule.id, b.severity or severity, b.message, line, shown, F.lit(k))))
    return F.when(gate(rule.gates, rule.any_gate), present(out))


def exploded(files: DataFrame, arrays: Sequence[Column]) -> DataFrame:
    """Findings that expressions on a file give, in one pass over the files."""
    every_ = F.flatten(F.array_compact(F.array(*[a.cast(FOUND_DDL) for a in arrays])))
    return once(files, "fs", every_).select(*KEYS, F.explode("fs").alias("f")).select(*KEYS, "f.*")


@remembered
def _checked(check: Callable[[Column, Column], Column]) -> Column:
    return check(F.col("relative_path"), F.col("content"))


def file_findings(files: DataFrame, rules: Sequence[FileRule], checks: Sequence[Callable[[Column, Column], Column]], severities: dict[str, str]) -> DataFrame:
    """Findings of file rules, one for each branch that holds, and of checks: functions of (path, content)."""
    arrays = [*(file_rule(r, severities[r.id]) for r in rules), *map(_checked, checks)]
    return exploded(lowered(files), arrays)


def declared_names(code: Column, local: bool) -> Column:
    """Names that a script imports and, if ``local``, declares."""
    clauses = F.regexp_extract_all(code, F.lit(r"\bimport\s+([^;'\"]+?)\s+from\b"), F.lit(1))
    imported = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit(r"(\w+)"), F.lit(1))))
    return F.concat(imported, F.regexp_extract_all(code, F.lit(r"\b(?:function\s*\*?\s+|(?:const|let|var)\s+)(\w+)"), F.lit(1))) if local else imported


def guarded(body: Column, code: Column, local: bool, custom: Sequence[str] = ()) -> Column:
    """Whether a function's code calls something that checks the user."""
    calls = F.regexp_extract_all(body, F.lit(js_regex(rf"\b(\w*{GUARD_HINT}\w*)\s*[.(]", "i")), F.lit(1))
    known = F.arrays_overlap(calls, declared_names(code, local))
    own = [matches(body, r"\b(?:" + "|".join(map(_escaped, custom)) + r")\s*\(")] if custom else []
    return some([matches(body, r"\b\w*" + AUTH_GUARD + r"\s*\("), matches(body, GUARD_MEMBER), known, *own])


def _escaped(name: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in name)


@remembered
def _scope_rule(rule: ScopeRule, order: int, severity: str, guards: tuple[str, ...]) -> Column:
    content, code = F.col("content"), F.col("code")

    def body(b: Column) -> Column:
        return F.substring(code, b["start"] + 1, b["stop"] - b["start"])

    def asked(b: Column) -> Column:
        tests = [b["kind"].isin("function", "callback")]
        if rule.exported:
            tests.append(b["exported"])
        if rule.name:
            tests.append(matches(b["name"], rule.name, "" if rule.exported else "i"))
        tests += [matches(body(b), r, f) for r, f in rule.has] + [~matches(body(b), r, f) for r, f in rule.lacks]
        if rule.hits:
            tests.append(some(matches(body(b), r, f) for r, f in rule.hits))
        if rule.guarded:
            tests.append(~guarded(body(b), code, rule.local_guards, guards))
        return every(tests)

    def places(b: Column) -> Column:
        if not rule.hits:
            return F.array(b["head"])
        offs = F.flatten(F.array(*[F.transform(match_starts(body(b), r, f), lambda off: off + b["start"]) for r, f in rule.hits]))
        return F.slice(F.array_sort(offs), 1, 1) if rule.first else offs

    first, _, last = rule.message.partition("{0}")

    def findings(b: Column) -> Column:
        def one(off: Column) -> Column:
            line = line_of(content, off)
            return found(rule.id, rule.severity or severity, F.concat(F.lit(first), b["name"], F.lit(last)), line, line_evidence(content, line), F.lit(order * 10_000_000) + off)

        return F.transform(places(b), one)

    return F.when(F.array_contains("asked", order), F.flatten(F.transform(F.filter("blocks", asked), findings)))


@remembered
def _asks(rule: ScopeRule) -> Column:
    """Whether a file's functions are worth asking."""
    wanted = [_in_code(r, f) for r, f in rule.has] + ([some(_in_code(r, f) for r, f in rule.hits)] if rule.hits else [])
    return every([gate(rule.gates, rule.any_gate), *wanted])


def _code_may(regex: str, flags: str) -> Column | None:
    """As ``has_literals``, for expressions on code: comments are blanks there, so literals with blanks may be missing in the content."""
    return None if " " in regex else has_literals(regex, flags)


def _in_code(regex: str, flags: str) -> Column:
    hit, may = matches(F.col("code"), regex, flags), _code_may(regex, flags)
    return hit if may is None else may & hit


@remembered
def _may_ask(rule: ScopeRule | CodeRule) -> Column:
    """Whether a rule can find anything in a ``lowered`` script file, by its paths and literals, before its comments are known."""
    tests = [gate(rule.gates, getattr(rule, "any_gate", ()))]
    asked = [(rule.regex, rule.flags)] if isinstance(rule, CodeRule) else [*rule.has]
    tests += [t for r, f in asked if (t := _code_may(r, f)) is not None]
    if isinstance(rule, CodeRule) and rule.inside and "any" not in rule.inside:
        hints = {"loop": LOOP_HINT, "callback": CALLBACK_HINT}
        tests += [some(matches(F.col("content"), hints[k]) for k in rule.inside)] if set(rule.inside) <= set(hints) else []
    if isinstance(rule, ScopeRule):
        if rule.exported:
            tests.append(F.col("content").contains("export"))
        ways = [_code_may(*h) for h in rule.hits]
        if ways and all(w is not None for w in ways):
            tests.append(some(ways))
    return every(tests)


@remembered
def _code_rule(rule: CodeRule, order: int, severity: str) -> Column:
    content, code = F.col("content"), F.col("code")
    at = F.transform(F.filter(match_starts(code, rule.regex, rule.flags), _asked_of(rule)), lambda off: line_of(content, off))
    if rule.once_a_line:
        at = F.array_distinct(at)
    out = F.transform(at, lambda line, i: found(rule.id, severity, rule.message, line, line_evidence(content, line), F.lit(order * 10_000_000) + i))
    return F.when(gate(rule.gates, ()) & _in_code(rule.regex, rule.flags), out)


def _asked_of(rule: CodeRule) -> Callable[[Column], Column]:
    def asked(off: Column) -> Column:
        rest = F.substring(F.col("code"), off + 1, F.lit(rule.reach))
        return every([matches(rest, r, f) for r, f in rule.also] + [~matches(rest, r, f) for r, f in rule.unless])

    return asked


@remembered
def _spots(rule: CodeRule, number: int) -> Column:
    """The matches of a rule that asks for the scope around them."""
    code, asked = F.col("code"), _asked_of(rule)
    hits = F.filter(match_offsets(code, rule.regex, rule.flags), lambda m: asked(m["off"]))
    spots = F.transform(hits, lambda m: F.struct(m["off"].alias("pos"), F.lit(number).alias("rule"), m["line"].alias("line"), evidence(F.element_at("ls", m["line"])).alias("shown")))
    return F.when(gate(rule.gates, ()) & _in_code(rule.regex, rule.flags), spots)


_SPOT = "struct<pos:int,rule:int,line:int,shown:string>"


def code_findings(files: DataFrame, scope_rules: Sequence[ScopeRule], codes: Sequence[CodeRule], severities: dict[str, str], guards: Sequence[str] = ()) -> DataFrame:
    """Findings about functions, loops and calls of script files, in one pass and, but for equal findings, without a shuffle.

    Files in which no rule can find anything go before their code is looked at, and only files in which a rule asks for
    scopes get them. Rules that ask for the scope around a match get it from the same helper (``blocks.around``).
    """
    candidates = some(_may_ask(r) for r in (*scope_rules, *codes))
    inside = [(i, r) for i, r in enumerate(codes) if r.inside]
    n = len(scope_rules)
    asked = F.array_compact(F.array(*[F.when(_asks(r), F.lit(i)) for i, r in enumerate(scope_rules)])) if scope_rules else F.array().cast("array<int>")
    spots = F.flatten(F.array_compact(F.array(*[_spots(r, k) for k, (_, r) in enumerate(inside)]))) if inside else F.array()
    arrays = [_scope_rule(r, i, severities[r.id], tuple(guards)) for i, r in enumerate(scope_rules)] + [_code_rule(r, n + i, severities[r.id]) for i, r in enumerate(codes) if not r.inside]
    rows = once(lowered(files.where(matches(F.col("relative_path"), CODE, "i"))), "candidate", candidates).where("candidate")
    rows = once(quieted(rows, "sets"), "asked", asked)
    rows = once(rows, "ls", lines(F.col("content"))) if inside else rows
    rows = once(rows, "spots", spots.cast(f"array<{_SPOT}>"))
    wanted = (F.size("asked") > 0) | (F.size("spots") > 0)
    rows = rows.withColumn("scoped", scoped(F.when(wanted, F.col("plain")), F.col("spots.pos"))).withColumn("blocks", F.col("scoped.blocks"))
    if not inside:
        return exploded(rows, arrays)

    def of(spot: Column, values: Sequence) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), spot["rule"] + 1)

    def stands(spot: Column, near: Column) -> Column:
        kinds = lambda r: near["inside"] if "any" in r.inside else F.coalesce(near["kind"].isin(*r.inside), F.lit(False))
        return some((spot["rule"] == k) & kinds(r) for k, (_, r) in enumerate(inside))

    def finding(spot: Column) -> Column:
        order = of(spot, [(n + i) * 10_000_000 for i, _ in inside]).cast("long") + spot["pos"]
        return F.struct(of(spot, [r.id for _, r in inside]).alias("rule_id"), of(spot, [severities[r.id] for _, r in inside]).alias("severity"), of(spot, [r.message for _, r in inside]).alias("message"), spot["line"].alias("line"), spot["shown"].alias("evidence"), order.alias("finding_ord"))

    hits = F.filter(F.zip_with("spots", "scoped.around", lambda s, a: F.when(stands(s, a), s)), lambda s: s.isNotNull())
    single = [n + i for i, r in inside if r.once_a_line]
    return once_each(exploded(rows, [*arrays, F.transform(hits, finding)]), F.floor(F.col("finding_ord") / 10_000_000).isin(single))
