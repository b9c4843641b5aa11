"""DuckDB SQL with the semantics of the declarative rules, to hold the Spark plans against another engine."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from auditgrid.functions import fileclass
from auditgrid.operators import blocks
from auditgrid.operators.audit import CONTENT_RULES, FILE_RULES, LINE_RULES
from auditgrid.plans.corpus import quote
from auditgrid.rules import catalog, file_checks, scope_rules
from auditgrid.rules.spec import CODE, CodeRule, ContentRule, FileRule, LineRule, ScopeRule, Test
from auditgrid.schema import EVIDENCE_CHARS

COLUMNS = "file_id, repo, relative_path, rule_id, severity, message, line, evidence"
_SPACE = r"\s\x0b\x{A0}\x{FEFF}\x{2028}\x{2029}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def re2(regex: str) -> str:
    """Without possessive marks and large bounds, which only spare Java time and stack frames."""
    out, inside, i = [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        if c == "{" and not inside and (bound := re.match(r"\{0,\d{3}\}(?=\+)", regex[i:])):
            out.append("*")  # large bounds only keep Java from trying a place again and again
            i += len(bound[0])
            continue
        if not (c == "+" and not inside and out and out[-1] in ("*", "+", "?", "}")):
            out.append(c)
        inside = True if c == "[" else False if c == "]" else inside
        i += 1
    return "".join(out)


def inline(regex: str, flags: str) -> str:
    return quote(("(?i)" if "i" in flags else "") + re2(regex))


def _without(found: str, tail: str) -> Callable[[str], str]:
    """Some match of ``found`` doesn't end in ``tail``, which ``found`` may end in."""
    return lambda x: f"len(list_filter(regexp_extract_all({x}, {quote(found)}), lambda m: NOT regexp_matches(m, {quote(tail)}))) > 0"


def _last(found: str, later: str) -> Callable[[str], str]:
    """Some match of ``found`` has no ``later`` behind it: what follows the last one has a match."""
    return lambda x: f"regexp_matches(regexp_replace({x}, {quote('^.*(?:' + later + ')')}, ''), {quote(found)})"


def _around(found: str, words: str) -> Callable[[str], str]:
    """Some match of ``found`` has none of ``words`` in its group."""
    return lambda x: f"len(list_filter(regexp_extract_all({x}, {quote(found)}, 1), lambda m: NOT regexp_matches(m, {quote('(?i)' + words)}))) > 0"


#: The same tests without looking ahead, by the expression that looks ahead.
AHEAD: dict[str, Callable[[str], str]] = {
    r"""['"`]http:\/\/(?!localhost|127\.0\.0\.1|0\.0\.0\.0|example\.com)[^'"`\s]+['"`]""": _around(r"""(?i)(['"`]http:\/\/[^'"`\s]+['"`])""", r"""^.http:\/\/(?:localhost|127\.0\.0\.1|0\.0\.0\.0|example\.com)"""),
    r"\.(?:jsx|tsx|vue|svelte)$|(?:^src\/|^app\/|^pages\/(?!api\/))": lambda x: f"(regexp_matches({x}, {quote(r'(?i)\.(?:jsx|tsx|vue|svelte)$|^src\/|^app\/')}) OR (regexp_matches({x}, '(?i)^pages/') AND NOT regexp_matches({x}, '(?i)^pages/api/')))",
    r"(?:src\/|app\/(?!api)|pages\/(?!api)|components\/|hooks\/|lib\/client|utils\/client).*\.(js|ts|jsx|tsx)$": lambda x: f"regexp_matches({x}, {quote(r'(?i)(?:src\/|(?:app|pages)\/(?:[^a]|a[^p]|ap[^i])|components\/|hooks\/|lib\/client|utils\/client).*\.(js|ts|jsx|tsx)$')})",
    r"(?:findUnique|findMany|findFirst)\s*\(\s*\{(?:(?!select|include).)*\}\s*\)": _around(r"(?i)(?:findUnique|findMany|findFirst)\s*\(\s*\{(.*?)\}\s*\)", "select|include"),
    r"jwt\.sign\s*\(\s*(?:(?!expiresIn|exp).)*\)": _around(r"(?i)jwt\.sign\s*\(\s*(.*?)\)", "expiresIn|exp"),
    r"\.find\([^)]*\)\s*(?!\s*\.select)": _without(r"\.find\([^)]*\)(?:\s*\.select)?", r"\.select$"),
    r"\.findMany\s*\(\s*(?:\{(?:(?!take|first|last).)*\}|\s*\))": lambda x: f"(regexp_matches({x}, {quote(r'(?i)\.findMany\s*\(\s*\)')}) OR {_around(r'(?i)\.findMany\s*\(\s*\{(.*?)\}', 'take|first|last')(x)})",
    r"\.find\s*\([^)]*\)\s*(?!.*\.limit)": _last(r"\.find\s*\([^)]*\)", r"\.limit"),
    r"\.select\s*\([^)]*\)\s*(?!.*\.limit)": _last(r"\.select\s*\([^)]*\)", r"\.limit"),
    r"""(?:query|execute|sql)\s*\(\s*['"`]SELECT\s+(?:(?!LIMIT).)*['"`]\s*\)""": _around(r"""(?i)(?:query|execute|sql)\s*\(\s*['"`]SELECT\s+(.*?)['"`]\s*\)""", "LIMIT"),
    r"\.from\s*\([^)]*\)\s*\.select\s*\([^)]*\)\s*(?!.*\.limit|.*\.range)": _last(r"\.from\s*\([^)]*\)\s*\.select\s*\([^)]*\)", r"\.limit|\.range"),
    r"(?:playground|introspection)\s*:\s*true(?!\s*&&|\s*\?|\s*\|\|)": _without(r"(?i)(?:playground|introspection)\s*:\s*true(?:\s*(?:&&|\?|\|\|))?", r"(?:&&|\?|\|\|)$"),
}


def matches(x: str, regex: str, flags: str = "") -> str:
    if regex in AHEAD:
        return AHEAD[regex](x)
    return f"regexp_matches({x}, {inline(regex, flags)})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def both(parts: Iterable[str]) -> str:
    return " AND ".join(f"({p})" for p in parts) or "true"


def either(parts: Iterable[str]) -> str:
    return " OR ".join(f"({p})" for p in parts) or "false"


def holds(t: Test) -> str:
    hit = matches("relative_path" if t.on == "path" else "content", t.regex, t.flags)
    return hit if t.wanted else f"NOT {hit}"


def gate(gates: Iterable[Test], any_gate: Iterable[Test]) -> str:
    any_gate = tuple(any_gate)
    return both([*map(holds, gates), *([either(map(holds, any_gate))] if any_gate else [])])


def directive(name: str) -> str:
    """Whether a directive stands before the first statement."""
    code = f"list_filter(list_transform(string_split(content, chr(10))[1:{fileclass.DIRECTIVE_LINES}], lambda x: {trim('x')}), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*') AND NOT starts_with(x, '*'))"
    wanted = matches("x", rf"""^['"]{name}['"];?$""")
    any_ = matches("x", r"""^['"][^'"]+['"];?$""")
    at = f"coalesce(list_position(list_transform({code}, lambda x: {wanted}), true), 0)"
    return f"({at} > 0 AND len(list_filter(({code})[1:{at} - 1], lambda x: NOT {any_})) = 0)"


def is_client() -> str:
    server = either([matches("content", fileclass.SERVER_ONLY_IMPORT), matches("relative_path", fileclass.SERVER_PATH, "i"), directive("use server")])
    return either([directive("use client"), both([f"NOT ({server})", either([matches("relative_path", fileclass.CLIENT_EXT, "i"), matches("relative_path", fileclass.CLIENT_DIR, "i")])])])


def found(rule: str, severity: str, message: str, line: str, evidence: str) -> str:
    return f"file_id, repo, relative_path, {quote(rule)} AS rule_id, {severity} AS severity, {message} AS message, CAST({line} AS INTEGER) AS line, {evidence} AS evidence"


def line_rule(rule: LineRule) -> str:
    live = both([gate(rule.gates, rule.any_gate), *([is_client()] if rule.client else [])])
    rows = f"SELECT *, {trim('text')} AS trimmed FROM (SELECT file_id, repo, relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE {live})"
    comment = either(f"starts_with(trimmed, {quote(c)})" for c in rule.comments)
    shown = "trimmed" if rule.whole_evidence else f"substring(trimmed, 1, {EVIDENCE_CHARS})"

    def hit(p) -> str:
        return both([matches("text", p.regex, p.flags), *(matches("text", r, f) for r, f in p.also), *(f"NOT {matches('text', r, f)}" for r, f in p.unless), *([matches("relative_path", p.path, "i")] if p.path else [])])

    severity = [quote(p.severity or catalog.SEVERITY[rule.id]) for p in rule.patterns]
    if rule.first:
        chain = lambda values: "CASE " + " ".join(f"WHEN {hit(p)} THEN {v}" for p, v in zip(rule.patterns, values, strict=True)) + " END"
        return f"SELECT {found(rule.id, chain(severity), chain([quote(p.message) for p in rule.patterns]), 'line', shown)} FROM ({rows}) WHERE NOT ({comment}) AND ({either(map(hit, rule.patterns))})"
    return " UNION ALL ".join(f"SELECT {found(rule.id, s, quote(p.message), 'line', shown)} FROM ({rows}) WHERE NOT ({comment}) AND {hit(p)}" for p, s in zip(rule.patterns, severity, strict=True))


def content_matches(regex: str, flags: str, live: str) -> str:
    """Rows of (keys, content, text, off, line, line_text, nth) of every match."""
    p = inline(regex, flags)
    hits = f"SELECT *, regexp_extract_all(content, {p}) AS hits, string_split_regex(content, {p}) AS between FROM files WHERE {live} AND regexp_matches(content, {p})"
    each = f"SELECT *, unnest(generate_series(1, len(hits))) AS j FROM ({hits})"
    placed = f"SELECT file_id, repo, relative_path, content, j AS nth, hits[j] AS text, CAST(list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS off FROM ({each})"
    lined = f"SELECT *, 1 + off - length(replace(substring(content, 1, off), chr(10), '')) AS line FROM ({placed})"
    return f"SELECT *, {trim('string_split(content, chr(10))[line]')} AS line_text FROM ({lined})"


def content_rule(rule: ContentRule) -> str:
    out = []
    for p in rule.patterns:
        pattern = p.re2 or p.regex
        tests = [f"NOT ({either(f'starts_with(line_text, {quote(c)})' for c in rule.comments)})", *(matches("text", r, f) for r, f in p.also), *(f"NOT {matches('text', r, f)}" for r, f in p.unless)]
        if rule.first_only:
            tests.append("nth = 1")
        if rule.window:
            before, after, from_end, regex, flags, wanted = rule.window
            start = f"greatest(off - {before}, 0)"
            inside = matches(f"substring(content, {start} + 1, off + {'length(text)' if from_end else '0'} + {after} - {start})", regex, flags)
            tests.append(inside if wanted else f"NOT {inside}")
        message = quote(p.message)
        if rule.group is not None:
            part = f"regexp_extract(text, {inline(pattern, p.flags)}, {rule.group})"
            a, _, b = p.message.partition("{0}")
            message = f"{quote(a)} || {part} || {quote(b)}"
            if rule.match_unless:
                tests.append(f"NOT {matches(part, *rule.match_unless)}")
        out.append(f"SELECT {found(rule.id, quote(p.severity or catalog.SEVERITY[rule.id]), message, 'line', f'substring(line_text, 1, {EVIDENCE_CHARS})')} FROM ({content_matches(pattern, p.flags, gate(rule.gates, rule.any_gate))}) WHERE {both(tests)}")
    body = " UNION ALL ".join(out)
    return f"SELECT DISTINCT * FROM ({body})" if rule.once_a_line else body


def line_text(line: str) -> str:
    return f"substring({trim(f'string_split(content, chr(10))[{line}]')}, 1, {EVIDENCE_CHARS})"


def file_rule(rule: FileRule) -> str:
    out = []
    for b in rule.branches:
        line, shown = "1", "CAST(NULL AS VARCHAR)"
        if b.line:
            line = f"greatest(coalesce(list_position(list_transform(string_split(content, chr(10)), lambda x: {matches('x', *b.line)}), true), 0), 1)"
        if b.at:
            ways = [f"CASE WHEN {matches('relative_path', p, 'i')} AND {matches('content', r, f)} THEN len(string_split(string_split_regex(content, {inline(r, f)})[1], chr(10))) END" for r, f, p in b.at]
            line = f"coalesce({', '.join(ways)}, 1)"
        if b.line or b.at:
            shown = line_text(line)
        out.append(f"SELECT {found(rule.id, quote(b.severity or catalog.SEVERITY[rule.id]), quote(b.message), line, shown)} FROM files WHERE {both([gate(rule.gates, rule.any_gate), *map(holds, b.tests)])}")
    return " UNION ALL ".join(out)


def _headers() -> str:
    low = "lower(content)"
    parts = ", ".join(f"CASE WHEN NOT ({either(f'contains({low}, {quote(a)})' for a in aliases)}) THEN {quote(h)} END" for h, aliases in file_checks.HEADERS.items())
    names = f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ', ')"
    live = matches("relative_path", r"(?:next\.config\.|vercel\.json|netlify\.toml|nuxt\.config\.|astro\.config\.|vite\.config\.|nginx\.conf|\.htaccess|middleware\.(ts|js))", "i")
    return f"SELECT {found('missing-security-headers', quote('warning'), quote('Security headers aren' + chr(39) + 't set: ') + ' || ' + names, '1', quote('Missing: ') + ' || ' + names)} FROM files WHERE {live} AND {names} <> ''"


def _gitignore() -> str:
    entries = f"list_filter(list_transform(string_split(lower(content), chr(10)), lambda x: {trim('x')}), lambda x: NOT starts_with(x, '#'))"
    rows = [f"SELECT file_id, repo, relative_path, {quote(p)} AS p, 'critical' AS s, {quote(p + ' isn' + chr(39) + 't ignored and can be committed')} AS m FROM f WHERE len(list_filter(entries, lambda x: contains(x, '.env'))) = 0" for p in (".env", ".env.local", ".env.production", ".env.development")]
    rows += [f"SELECT file_id, repo, relative_path, {quote(p)}, 'warning', {quote(p + ' isn' + chr(39) + 't ignored')} FROM f WHERE len(list_filter(entries, lambda x: starts_with(x, {quote(p.lower())}))) = 0" for p in ("node_modules", ".DS_Store")]
    return f"SELECT {found('missing-gitignore', 's', 'm', '1', quote('Missing: ') + ' || p')} FROM (WITH f AS (SELECT *, {entries} AS entries FROM files WHERE relative_path = '.gitignore') {' UNION ALL '.join(rows)})"


def _docker() -> str:
    live = both([f"NOT {matches('relative_path', r'(?:\.test\.|\.spec\.|__tests__|node_modules)', 'i')}", matches("relative_path", r"(?:^|\/)Dockerfile(?:\.\w+)?$", "i")])
    rows = f"SELECT file_id, repo, relative_path, content, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE {live}"
    last = f"SELECT file_id, repo, relative_path, content, max(CASE WHEN {matches(trim('text'), r'^USER\s+', 'i')} THEN line END) AS place FROM ({rows}) GROUP BY ALL"
    return (
        f"SELECT {found('docker-root-user', quote('warning'), quote('No USER is set, so the container runs as root'), '1', line_text('1'))} FROM ({last}) WHERE place IS NULL UNION ALL "
        f"SELECT {found('docker-root-user', quote('warning'), quote('The last USER is root'), 'place', line_text('place'))} FROM ({last}) WHERE place IS NOT NULL AND {matches(trim('string_split(content, chr(10))[place]'), r'^USER\s+root\s*$', 'i')}"
    )


def _compose() -> str:
    live = both([f"NOT {matches('relative_path', r'(?:\.test\.|\.spec\.|__tests__|node_modules)', 'i')}", matches("relative_path", r"(?:^|\/)docker-compose(?:\.\w+)?\.ya?ml$", "i")])
    rows = f"SELECT *, {trim('text')} AS trimmed FROM (SELECT file_id, repo, relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE {live})"
    event = f"CASE WHEN {matches('trimmed', r'^ports\s*:', 'i')} THEN 1 WHEN {matches('text', r'^\S')} AND NOT {matches('text', r'^\s*-')} THEN 0 END"
    state = f"SELECT *, {event} AS event, coalesce(last_value({event} IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line), 0) AS inside, regexp_extract(trimmed, '[''\"]?(?:[\\d.]+:)?(\\d+):\\d+[''\"]?', 1) AS port FROM ({rows})"
    ports = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in file_checks.DATABASE_PORTS.items())
    return f"SELECT {found('exposed-database-port', quote('warning'), 'name || ' + quote(' port ') + ' || port || ' + quote(' is published on the host'), 'line', 'substring(trimmed, 1, 120)')} FROM ({state}) JOIN (VALUES {ports}) ports(number, name) ON number = port WHERE inside = 1 AND starts_with(trimmed, '-') AND event IS DISTINCT FROM 1"


def _vercel() -> str:
    live = both([f"NOT {matches('relative_path', r'(?:\.test\.|\.spec\.|__tests__|node_modules)', 'i')}", either([matches("relative_path", r"(?:vercel\.json|\.env(?:\.\w+)?|next\.config\.(js|ts|mjs))$", "i"), matches("content", r"(?:NEXT_PUBLIC_|VITE_|PUBLIC_|NUXT_PUBLIC_)", "i")])])
    p = inline(r"(NEXT_PUBLIC_|VITE_|PUBLIC_|NUXT_PUBLIC_)(\w+)", "i")
    rows = f"SELECT *, regexp_extract(text, {p}, 0) AS name, regexp_extract(text, {p}, 2) AS bare FROM (SELECT file_id, repo, relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE {live})"
    secret = matches("bare", r"(?:SECRET|PRIVATE|PASSWORD|CREDENTIAL|DATABASE_URL|SERVICE_ROLE|ADMIN_KEY|API_SECRET|JWT_SECRET|SIGNING_KEY|ENCRYPTION_KEY)", "i")
    return f"SELECT {found('vercel-env-leak', quote('critical'), 'name || ' + quote(' is public but named like a secret'), 'line', 'name')} FROM ({rows}) WHERE {secret}"


def _env_vars() -> str:
    live = both([f"NOT {matches('relative_path', r'(?:\.test\.|\.spec\.|__tests__|fixtures\/|src\/rules\/|reports\/)', 'i')}", "contains(relative_path, '.env') OR contains(content, 'process.env') OR contains(content, 'import.meta.env')"])
    names = ", ".join(f"({quote(p + '[A-Z0-9_]*' + w + '[A-Z0-9_]*')})" for p in file_checks.CLIENT_PREFIXES for w in file_checks.SENSITIVE_WORDS)
    rows = f"SELECT file_id, repo, relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE {live}"
    each = f"SELECT file_id, repo, relative_path, line, unnest(regexp_extract_all(text, re)) AS name FROM ({rows}) CROSS JOIN (VALUES {names}) names(re) WHERE {either(f'contains(text, {quote(p)})' for p in file_checks.CLIENT_PREFIXES)}"
    public = both([matches("name", fileclass.PUBLIC_KEY, "i"), f"NOT {matches('name', fileclass.SECRET_KEY, 'i')}"])
    return f"SELECT {found('exposed-env-vars', quote('critical'), 'name || ' + quote(' is built into what browsers load'), 'line', 'name')} FROM ({each}) WHERE NOT ({public})"


def _unpinned() -> str:
    fields = " UNION ALL ".join(f"SELECT *, unnest(coalesce(json_keys(content, '$.{f}'), [])) AS name, '{f}' AS field FROM p" for f in ("dependencies", "devDependencies", "optionalDependencies"))
    value = "json_extract_string(json_extract(content, '$.' || field), '$.\"' || name || '\"')"
    at = "coalesce(list_position(list_transform(string_split(content, chr(10)), lambda x: contains(x, '\"' || name || '\"')), true), 0)"
    rows = f"WITH p AS (SELECT * FROM files WHERE {matches('relative_path', r'(?:^|\/)package\.json$')} AND json_valid(content)) SELECT *, {value} AS value, {at} AS place FROM ({fields})"
    message = f"name || {quote(' takes any version: ')} || CASE WHEN value = '' THEN '(empty)' ELSE value END"
    return f"SELECT {found('unpinned-dependencies', quote('warning'), message, 'greatest(place, 1)', 'CASE WHEN place > 0 THEN ' + line_text('place') + ' END')} FROM ({rows}) WHERE {matches(trim('value'), r'^(?:\*|latest|x|X|)$')}"


def _monitoring() -> str:
    names = "list_concat(coalesce(json_keys(content, '$.dependencies'), []), coalesce(json_keys(content, '$.devDependencies'), []))"
    web = matches("x", r"^(?:next|react|react-dom|express|fastify|koa|@remix-run\/|vue|nuxt|svelte|@sveltejs\/|hono|@nestjs\/|@angular\/)", "i")
    watched = matches("x", r"^(?:@sentry\/|rollbar|bugsnag|@bugsnag\/|@datadog\/|newrelic|@newrelic\/|honeybadger|@honeybadger-io\/|elastic-apm|@opentelemetry\/|logrocket|@highlight-run\/)", "i")
    rows = f"SELECT *, {names} AS names FROM files WHERE {matches('relative_path', r'(?:^|\/)package\.json$')} AND json_valid(content)"
    return f"SELECT {found('no-error-monitoring', quote('info'), quote('Nothing reports the application' + chr(39) + 's errors'), '1', 'CAST(NULL AS VARCHAR)')} FROM ({rows}) WHERE len(list_filter(names, lambda x: {web})) > 0 AND len(list_filter(names, lambda x: {watched})) = 0"


def _lockfile() -> str:
    rows = f"SELECT *, unnest(coalesce(json_keys(content, '$.packages'), [])) AS place FROM files WHERE {matches('relative_path', r'(?:^|\/)package-lock\.json$', 'i')} AND json_valid(content)"
    meta = "json_extract(json_extract(content, '$.packages'), '$.\"' || place || '\"')"
    named = f"SELECT *, regexp_replace(place, '^.*node_modules/', '') AS name, coalesce(json_extract_string({meta}, '$.version'), 'unknown') AS version FROM ({rows}) WHERE place <> '' AND json_extract_string({meta}, '$.hasInstallScript') = 'true'"
    first = f"SELECT file_id, repo, relative_path, name, version, first(place) AS place FROM ({named}) GROUP BY ALL"
    known = f"name IN ({', '.join(map(quote, file_checks.ALLOWED_INSTALL_SCRIPTS))})"
    message = f"name || '@' || version || CASE WHEN {known} THEN ' runs its usual install script' ELSE ' runs code when it is installed' END"
    return f"SELECT {found('install-script-dependency', f'CASE WHEN {known} THEN ' + quote('info') + ' ELSE ' + quote('warning') + ' END', message, '1', 'place || ' + quote(': hasInstallScript'))} FROM ({first})"


def _line_checks(live: str, hits: list[tuple[str, str, str, str]], rule: str, comments: tuple[str, ...] = ("//", "*")) -> str:
    """Findings of a check on lines: (test on text, severity, message, evidence) each."""
    rows = f"SELECT *, {trim('text')} AS trimmed FROM (SELECT file_id, repo, relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS text FROM files WHERE {live})"
    comment = either(f"starts_with(trimmed, {quote(c)})" for c in comments)
    return " UNION ALL ".join(f"SELECT {found(rule, quote(s), m, 'line', e)} FROM ({rows}) WHERE NOT ({comment}) AND {t}" for t, s, m, e in hits)


def _cookies() -> str:
    options = r"res\.cookie\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*[^,]+,\s*\{([^}]*)\}"
    given = f"lower(regexp_extract(text, {inline(options, '')}, 1))"
    absent = f"array_to_string(list_filter(['httponly', 'secure', 'samesite'], lambda x: NOT contains({given}, x)), ', ')"
    shown = "substring(trimmed, 1, 120)"
    bare = _last(r"(?i)document\.cookie\s*=", "(?i:httponly|secure|samesite)")
    return _line_checks(both([f"NOT {matches('relative_path', r'(?:\.test\.|\.spec\.|__tests__)', 'i')}", "contains(content, 'cookie') OR contains(content, 'Cookie')"]), [
        (matches("text", r"res\.cookie\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*[^,)]+\s*\)"), "warning", quote("A cookie is set without options"), shown),
        (both([matches("text", options), f"{absent} <> ''"]), "warning", f"{quote('A cookie lacks flags: ')} || {absent}", shown),
        (matches("text", r"['\"`]Set-Cookie['\"`]\s*,\s*['\"`][^'\"`]+['\"`]", "i"), "warning", quote("A cookie header is written by hand"), shown),
        (bare("text"), "warning", quote("The client sets a cookie without flags"), shown),
    ], "insecure-cookies")


def _jwt() -> str:
    masked = f"substring(regexp_replace(trimmed, {quote(r'^((?s:.)*?)[' + chr(39) + r'\"`][^' + chr(39) + r'\"`]+[' + chr(39) + r'\"`]')}, '\\1\"***\"'), 1, 120)"
    known = r"(?:secret|password|key|token|jwt[_-]?secret|my[_-]?secret|your[_-]?secret|change[_-]?me|test|dev|1234|admin)"
    return _line_checks(both([f"NOT {matches('relative_path', r'(?:\.test\.|\.spec\.|__tests__)', 'i')}", matches("content", "jwt")]), [
        (matches("text", r"jwt\.sign\s*\([^,]+,\s*['\"`]([^'\"`]{1,20})['\"`]", "i"), "critical", quote("A token is signed with a short secret"), masked),
        (matches("text", rf"jwt\.sign\s*\([^,]+,\s*['\"`]{known}['\"`]", "i"), "critical", quote("A token is signed with a well-known secret"), masked),
        (matches("text", r"jwt\.verify\s*\(\s*[^,]+,\s*[^,]+\s*\)"), "warning", quote("A token is verified without fixed algorithms"), "substring(trimmed, 1, 120)"),
    ], "insecure-jwt")


def _rate_limiting() -> str:
    risky = matches("relative_path", file_checks.RISKY_ROUTE, "i")
    call = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {inline(r, 'i')}), '')" for r in file_checks.PAID_CALLS) + ", '')"
    live = both([matches("relative_path", file_checks.ROUTE_FILES, "i"), f"NOT {matches('content', file_checks.RATE_LIMITS, 'i')}"])
    one = lambda test, message, shown: f"SELECT {found('missing-rate-limiting', quote('warning'), quote(message), '1', shown)} FROM files WHERE {both([live, test])}"
    return one(risky, "A route for logins, payments or models has no rate limit", "relative_path") + " UNION ALL " + one(f"NOT {risky} AND {call} <> ''", "A route calls a paid service without a rate limit", f"substring({call}, 1, 80)")


#: SQL of the checks that have any.
CHECKS = {
    "missing-security-headers": _headers, "missing-gitignore": _gitignore, "docker-root-user": _docker, "exposed-database-port": _compose, "vercel-env-leak": _vercel,
    "exposed-env-vars": _env_vars, "unpinned-dependencies": _unpinned, "no-error-monitoring": _monitoring, "install-script-dependency": _lockfile,
    "insecure-cookies": _cookies, "insecure-jwt": _jwt, "missing-rate-limiting": _rate_limiting,
}


def scopes_cte() -> str:
    """``quiet(keys, content, code, plain)`` of script files, and ``scopes`` with what ``operators.blocks`` says of each: brackets pair as neighbours of one level."""
    p = lambda r: quote(re2(r))
    blank = lambda x: f"regexp_replace({x}, '[^\\n]', ' ', 'g')"
    inside = "t[2:-2]"
    head, tail = f"regexp_extract(t, {p(r'^[^/]*/')})", f"regexp_extract(t, {p(r'/[a-z]*(?:\.(?:test|exec)\()?$')})"
    template = f"array_to_string(list_transform(list_zip(string_split_regex({inside}, {p(blocks.VALUE)}), regexp_extract_all({inside}, {p(blocks.VALUE)})), lambda z: {blank('z[1]')} || coalesce(z[2], '')), '')"
    plain = (
        f"CASE WHEN t[1:2] IN ('//', '/*') THEN {blank('t')} WHEN t[1] IN (chr(39), chr(34)) THEN t[1] || {blank(inside)} || t[1] WHEN t[1] = '`' THEN '`' || {template} || '`' "
        f"WHEN t[1] = '>' OR t = '=>' OR (length(t) = 2 AND right(t, 1) = chr(39)) THEN t ELSE {head} || {blank(f't[length({head}) + 1:length(t) - length({tail})]')} || {tail} END"
    )
    code = f"CASE WHEN t[1:2] IN ('//', '/*') THEN {blank('t')} ELSE t END"
    joined = lambda way: f"array_to_string(list_transform(list_zip(gaps, list_transform(tokens, lambda t: {way})), lambda z: z[1] || coalesce(z[2], '')), '')"
    opened = " + ".join(f"length(replace(t, '{c}', '')) - length(replace(t, '{o}', ''))" for o, c in ("()", "[]", "{}"))
    closes = "t[1] IN (')', ']', '}')"
    begins = f"(length(t) > 1 AND t[1] <> chr(10) AND NOT ({closes}) AND NOT regexp_matches(t, {p(blocks.NO_SCOPE)}))"
    rest = f"t[length(regexp_extract(t, {p(blocks.HEAD)})) + 1:]"
    loop = f"regexp_matches(t, {p(blocks.LOOP)})"
    called = f"(NOT {loop} AND regexp_matches(t, {p(blocks.HEAD)}) AND regexp_matches({rest}, {p(blocks.CALL)}) AND NOT regexp_matches({rest}, {p(blocks.OWN)}))"
    name = ", ".join(f"nullif(regexp_extract(t, {p(n)}, 1), '')" for n in blocks.NAMES)
    after = "(PARTITION BY file_id, level ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""quiet AS MATERIALIZED (SELECT file_id, repo, relative_path, content, {joined(code)} AS code, {joined(plain)} AS plain
  FROM (SELECT *, regexp_extract_all(content, {p(blocks.LEX)}) AS tokens, string_split_regex(content, {p(blocks.LEX)}) AS gaps FROM files WHERE {matches("relative_path", CODE, "i")})),
marks AS (SELECT file_id, length(plain) AS size, unnest(generate_series(1, len(ts))) AS i, unnest(ts) AS t, unnest(gs[1:len(ts)]) AS gap FROM (SELECT file_id, plain, regexp_extract_all(plain, {p(blocks.SCOPE)}) AS ts, string_split_regex(plain, {p(blocks.SCOPE)}) AS gs FROM quiet)),
placed AS (SELECT *, CAST(sum(length(gap) + length(t)) OVER w - length(t) AS INTEGER) AS off, CAST(sum({opened}) OVER w AS INTEGER) AS depth, {begins} AS begins, {closes} AS closes FROM marks WINDOW w AS (PARTITION BY file_id ORDER BY i)),
braces AS (SELECT *, CASE WHEN begins THEN depth - 1 ELSE depth END AS level FROM placed WHERE closes OR (begins AND right(t, 1) IN ('{{', '('))),
long AS (SELECT *, lead(closes) OVER w AS closed, lead(off) OVER w AS until FROM braces WINDOW w AS (PARTITION BY file_id, level ORDER BY i)),
ends AS (SELECT *, begins AS short, depth AS level FROM placed WHERE (begins AND right(t, 1) NOT IN ('{{', '(')) OR t IN (';', ',', chr(10)) UNION ALL SELECT *, false, depth + 1 FROM placed WHERE closes),
short AS (SELECT *, min(CASE WHEN NOT short THEN off END) OVER {after} AS until FROM ends),
found AS (SELECT file_id, i, t, off, CASE WHEN closed THEN until + 1 ELSE size END AS stop FROM long WHERE begins UNION ALL SELECT file_id, i, t, off, coalesce(until, size) FROM short WHERE short),
scopes AS MATERIALIZED (SELECT file_id, CASE WHEN {loop} THEN 'loop' WHEN t[1] = '.' THEN 'callback' ELSE 'function' END AS kind, CASE WHEN {loop} THEN 'anonymous' ELSE coalesce({name}, CASE WHEN starts_with(t, 'export') THEN 'default' ELSE 'anonymous' END) END AS name,
  starts_with(t, 'export') AS exported, off AS head, CAST(CASE WHEN {called} THEN off + length(t) - length({rest}) ELSE off + length(t) - CASE WHEN right(t, 1) = '{{' THEN 1 ELSE 0 END END AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM found)"""


#: Looking ahead at one character, restated as taking it; only where a match begins is used of these.
_NEXT = {r"(?!\.)": r"(?:[^.]|$)", r"(?!\+)": r"(?:[^+]|$)"}


def _taking(regex: str) -> str:
    for ahead, taken in _NEXT.items():
        regex = regex.replace(ahead, taken)
    return regex


def placed(rows: str, text: str, regex: str, flags: str, shift: str) -> str:
    """``rows`` once for each match of the pattern in their column ``text``, with off: where it begins, moved by ``shift``."""
    p = inline(_taking(regex), flags)
    hits = f"SELECT *, regexp_extract_all({text}, {p}) AS hits, string_split_regex({text}, {p}) AS gaps FROM ({rows}) WHERE regexp_matches({text}, {p})"
    return f"SELECT *, CAST({shift} + list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS off FROM (SELECT *, unnest(generate_series(1, len(hits))) AS j FROM ({hits}))"


def guarded(body: str, local: bool) -> str:
    imported = "flatten(list_transform(regexp_extract_all(code, '\\bimport\\s+([^;''\"]+?)\\s+from\\b', 1), lambda c: regexp_extract_all(c, '(\\w+)', 1)))"
    declared = f"list_concat({imported}, regexp_extract_all(code, '\\b(?:function\\s*\\*?\\s+|(?:const|let|var)\\s+)(\\w+)', 1))" if local else imported
    calls = f"regexp_extract_all({body}, {inline(rf'\b(\w*{scope_rules.GUARD_HINT}\w*)\s*[.(]', 'i')}, 1)"
    return either([matches(body, r"\b\w*" + scope_rules.AUTH_GUARD + r"\s*\("), matches(body, scope_rules.GUARD_MEMBER), f"list_has_any({calls}, {declared})"])


_LINE_AT = "1 + off - length(replace(substring(content, 1, off), chr(10), ''))"


def scope_rule(rule: ScopeRule) -> str:
    """Over ``quiet`` and ``scopes``: the tests run on each function's own code."""
    test = lambda r, f: matches("body", _taking(r), f)
    tests = [gate(rule.gates, rule.any_gate), "kind IN ('function', 'callback')", *(test(r, f) for r, f in rule.has), *(f"NOT {test(r, f)}" for r, f in rule.lacks)]
    if rule.exported:
        tests.append("exported")
    if rule.name:
        tests.append(matches("name", rule.name, "" if rule.exported else "i"))
    if rule.guarded:
        tests.append(f"NOT ({guarded('body', rule.local_guards)})")
    asked = f"SELECT * FROM (SELECT q.*, s.kind, s.name, s.exported, s.head, s.start, substring(q.code, s.start + 1, s.stop - s.start) AS body FROM quiet q JOIN scopes s USING (file_id)) WHERE {both(tests)}"
    rows = " UNION ALL ".join(placed(asked, "body", r, f, "start") for r, f in rule.hits) if rule.hits else f"SELECT *, CAST(head AS BIGINT) AS off FROM ({asked})"
    if rule.first:
        rows = f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY file_id, start ORDER BY off) = 1"
    a, _, b = rule.message.partition("{0}")
    return f"SELECT {found(rule.id, quote(rule.severity or catalog.SEVERITY[rule.id]), f'{quote(a)} || name || {quote(b)}', 'line', line_text('line'))} FROM (SELECT *, {_LINE_AT} AS line FROM ({rows}))"


def code_rule(rule: CodeRule) -> str:
    """Over ``quiet`` and ``scopes``: the scopes around a match are those whose places hold it, the innermost of them begins last."""
    rest = f"substring(code, off + 1, {rule.reach})"
    tests = [*(matches(rest, _taking(r), f) for r, f in rule.also), *(f"NOT {matches(rest, r, f)}" for r, f in rule.unless)]
    rows = f"SELECT * FROM ({placed(f'SELECT * FROM quiet WHERE {gate(rule.gates, ())}', 'code', rule.regex, rule.flags, '0')}) WHERE {both(tests)}"
    if rule.inside:
        around = "SELECT h.file_id, h.off, arg_max(s.kind, s.start) AS inner_kind, bool_or(s.kind <> 'loop') AS in_function FROM h JOIN scopes s ON s.file_id = h.file_id AND h.off BETWEEN s.start AND s.stop - 1 GROUP BY ALL"
        wanted = "in_function" if "any" in rule.inside else f"inner_kind IN ({', '.join(map(quote, rule.inside))})"
        rows = f"WITH h AS ({rows}), around AS ({around}) SELECT h.* FROM h JOIN around USING (file_id, off) WHERE {wanted}"
    out = f"SELECT {found(rule.id, quote(catalog.SEVERITY[rule.id]), quote(rule.message), 'line', line_text('line'))} FROM (SELECT *, {_LINE_AT} AS line FROM ({rows}))"
    return f"SELECT DISTINCT * FROM ({out})" if rule.once_a_line else out


def needs_scopes(rule_id: str) -> bool:
    """Whether ``rule_sql`` reads the relations of ``scopes_cte``."""
    return any(r.id == rule_id for r in (*scope_rules.SCOPE_RULES, *scope_rules.CODE_RULES))


def rule_sql(rule_id: str) -> str | None:
    """A query over the relation ``files``; null where RE2 or SQL can't express some part of the rule."""
    checks = file_checks.CHECKS.get(rule_id, ())
    if checks and rule_id not in CHECKS:
        return None
    parts = [CHECKS[rule_id]()] if checks else []
    for rules, restated in ((LINE_RULES, line_rule), (CONTENT_RULES, content_rule), (FILE_RULES, file_rule), (scope_rules.SCOPE_RULES, scope_rule), (scope_rules.CODE_RULES, code_rule)):
        parts += [restated(r) for r in rules if r.id == rule_id]
    out = " UNION ALL ".join(parts)
    return None if not parts or "(?!" in out or "(?=" in out else out
