"""Rules that need more than patterns: JSON, set differences, folds over lines, windows of lines, entropy.

Each is an expression on a file's path and content that gives an array of findings, so all of them
share one pass over the files, without a shuffle and without Python. Patterns are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditgrid.functions.fileclass import designed_public, escaper_pattern
from auditgrid.functions.text import content_matches, first_line, js_regex, js_trim, line_evidence, line_of, lines, match_offsets, matches, shannon_entropy
from auditgrid.operators.match import found, gate, present, some
from auditgrid.rules.spec import TESTS, TESTS_DEPS, TESTS_DEPS_RULES, FileBranch, FileRule, has, lacks, not_path, path as path_is
from auditgrid.schema import FOUND_DDL

Check = Callable[[Column, Column], Column]

# Fixed values.
CLIENT_PREFIXES = ("VITE_", "NEXT_PUBLIC_", "REACT_APP_", "NUXT_PUBLIC_", "EXPO_PUBLIC_")
SENSITIVE_WORDS = (
    "SECRET", "PRIVATE", "PASSWORD", "PASSWD", "CREDENTIAL", "TOKEN", "AUTH_KEY", "SERVICE_KEY", "SERVICE_ROLE", "ADMIN_KEY", "MASTER_KEY", "DATABASE_URL",
    "DB_PASSWORD", "SIGNING_KEY", "ENCRYPTION_KEY", "SMTP_PASSWORD", "SENDGRID", "TWILIO_AUTH", "STRIPE_SECRET", "OPENAI_KEY", "ANTHROPIC_KEY",
)
HEADERS = {
    "Content-Security-Policy": ("csp", "content-security-policy", "contentsecuritypolicy"), "X-Frame-Options": ("x-frame-options", "xframeoptions"),
    "X-Content-Type-Options": ("x-content-type-options", "xcontenttypeoptions"), "Strict-Transport-Security": ("hsts", "strict-transport-security"), "Referrer-Policy": ("referrer-policy", "referrerpolicy"),
}
DATABASE_PORTS = {"5432": "PostgreSQL", "3306": "MySQL", "27017": "MongoDB", "6379": "Redis", "1433": "MSSQL", "9200": "Elasticsearch", "5984": "CouchDB"}
ALLOWED_INSTALL_SCRIPTS = (
    "esbuild", "fsevents", "sharp", "core-js", "core-js-pure", "protobufjs", "playwright", "playwright-core", "puppeteer", "puppeteer-core", "better-sqlite3", "sqlite3", "bcrypt", "argon2",
    "canvas", "node-pty", "keytar", "bufferutil", "utf-8-validate", "cpu-features", "ssh2", "re2", "deasync", "lmdb", "msgpackr-extract", "nx", "turbo", "swc", "@swc/core", "@parcel/watcher",
    "@biomejs/biome", "@tailwindcss/oxide", "unrs-resolver", "workerd", "sass-embedded", "node-sass",
)
SQL_VERB = r"SELECT|INSERT|UPDATE|DELETE|REPLACE|MERGE|DROP|TRUNCATE|ALTER|CREATE"
SQL_CLAUSE = r"FROM|INTO|WHERE|SET|VALUES|TABLE|JOIN|COLUMN|DATABASE"
SQL_TEMPLATE = rf"[^`]*\b(?:{SQL_VERB})\b[^`]*\b(?:{SQL_CLAUSE})\b[^`]*\$\{{[^}}]+\}}"
SQL_CONCAT = rf"['\"][^'\"]*\b(?:{SQL_VERB})\b[^'\"]*\b(?:{SQL_CLAUSE})\b[^'\"]*['\"]\s*\+\s*[A-Za-z_$]"
SQL_SINK = r"\b(?:query|execute|exec|executemany|queryRaw|executeRaw|prepare|raw)\s*\(|\b(?:knex|pool|conn|connection|client|cursor|db|database|sequelize)\s*\.|(?:const|let|var)\s+\w*(?:sql|query|stmt)\w*\s*="
SQL_OTHER = r"\b(?:console|logger|prompt|systemPrompt|instructions)\b|\blog\.(?:info|warn|debug|error)\b|\b(?:process\.)?std(?:out|err)\.write\b|throw\s+new\s+\w*Error"
WORKFLOW_INPUT = r"\$\{\{\s*github\.(?:head_ref\b|event\.(?:issue|pull_request|comment|review|discussion)\.(?:title|body)\b|event\.pull_request\.head\.(?:ref|label)\b|event\.head_commit\.message\b)"
ESCAPES_HTML = r"&amp;|&lt;|&gt;|replace\s*\(\s*\/&\/|replaceAll\s*\(\s*['\"]&['\"]|<\\{1,2}\/|\\{2}u003c|\/\s*<\\?\/\(?script"
#: What every line has that writes into a page or runs code, in any case.
WRITES = r"document\.write|\.innerHTML\s*=|\beval\s*\(|new\s+Function\s*\(|(?:exec|execSync|spawn|spawnSync)\s*\(|(?:res\.redirect|window\.location|location\.href)\s*[=(]"
HTTP_POST = r"export\s+(?:async\s+)?function\s+POST"


def _on_lines(content: Column, one: Callable[[Column, Column, Column], Column]) -> Column:
    """``one(text, trimmed, index)`` of every line, nulls left out; index counts from 0."""
    return F.filter(F.transform(lines(content), lambda x, i: one(x, js_trim(x), i)), lambda x: x.isNotNull()).cast(FOUND_DDL)


def _comment(trimmed: Column, *marks: str) -> Column:
    return some(trimmed.startswith(m) for m in marks)


def exposed_env_vars(path: Column, content: Column) -> Column:
    live = gate((not_path(r"(?:\.test\.|\.spec\.|__tests__|fixtures\/|src\/rules\/|reports\/)"),), ()) & (path.contains(".env") | content.contains("process.env") | content.contains("import.meta.env"))
    live &= some(content.contains(p) for p in CLIENT_PREFIXES)
    names = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(p + "[A-Z0-9_]*" + w + "[A-Z0-9_]*").alias("re")) for p in CLIENT_PREFIXES for w in SENSITIVE_WORDS])

    def one(text: Column, i: Column) -> Column:
        hits = F.flatten(F.transform(names, lambda n: F.when(text.contains(n["prefix"]), F.regexp_extract_all(text, n["re"], F.lit(0))).otherwise(F.array().cast("array<string>"))))
        return F.transform(F.filter(hits, lambda h: ~designed_public(h)), lambda h, k: found("exposed-env-vars", "critical", F.concat(h, F.lit(" is built into what browsers load")), i + 1, h, i * 1000 + k))

    return F.when(live, F.flatten(F.transform(F.filter(F.transform(lines(content), lambda x, i: F.struct(x.alias("text"), i.alias("i"))), lambda x: some(x["text"].contains(p) for p in CLIENT_PREFIXES)), lambda x: one(x["text"], x["i"]))))


def no_input_validation(path: Column, content: Column, escapers: tuple[str, ...] = ()) -> Column:
    """Writes of dynamic, unescaped values into a page, within a line or the block that it opens."""
    esc = escaper_pattern(escapers)
    skip = r"(?:\.test\.|\.spec\.|__tests__|\.d\.ts$|node_modules|(?:^|\/)(?:dist|build|vendor|coverage)\/|\.min\.js$|src\/rules\/)"
    live = gate((not_path(skip), path_is(r"\.(?:[cm]?[jt]sx?|html?|vue|svelte|astro)$"), has(r"innerHTML|document\.write|\beval\s*\(|new\s+Function|exec|spawn|redirect|location", ""), has(WRITES)), ())
    all_lines = lines(content)

    def dynamic(v: Column) -> Column:
        literal = matches(v, r"^(?:'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"|`(?:[^`\\$]++|\\.|\$(?!\{))*+`)\s*(?:$|[;,)}\]]|return)")
        opened = v.startswith("`") & ~v.contains("${") & ~F.substring(v, F.lit(2), F.length(v)).contains("`") & ~v.contains("+")
        return (v != "") & ~matches(v, esc, "i") & ~literal & ~opened

    def one(text: Column, trimmed: Column, i: Column) -> Column:
        shown = F.substring(trimmed, 1, 120)

        def hit(test: Column, k: int, severity: str, message: str) -> Column:
            return F.when(test, found("no-input-validation", severity, message, i + 1, shown, i * 10 + k))

        written = js_trim(F.regexp_replace(js_trim(F.regexp_extract(text, js_regex(r"\bdocument\.write(?:ln)?\s*\(([^\r\n]*)"), 1)), r"\)\s*;?\s*\z", ""))
        assigned = js_trim(F.regexp_replace(js_trim(F.regexp_extract(text, r"\.innerHTML\s*=\s*([^\r\n]*)", 1)), r";+\s*\z", ""))
        block = matches(assigned, r"[`{(,]$|=>$") & matches(F.array_join(F.slice(all_lines, i + 1, 15), "\n"), esc, "i")
        hits = [
            hit(matches(text, r"\bdocument\.write(?:ln)?\s*\(") & dynamic(written), 0, "critical", "A dynamic value is written into the document"),
            hit(matches(text, r"\.innerHTML\s*=") & dynamic(assigned) & ~block, 1, "critical", "A dynamic value becomes markup"),
            hit(matches(text, r"\beval\s*\(\s*[^)'\"\s]"), 2, "critical", "Code is evaluated from input"),
            hit(matches(text, r"new\s+Function\s*\(\s*[^)'\"\s]"), 3, "critical", "A function is made from input"),
            hit(matches(text, r"(?:exec|execSync|spawn|spawnSync)\s*\(\s*(?:[`'\"].*\$\{|.*\+\s*(?:req\.|request\.|params\.))", "i"), 4, "critical", "A shell command holds input"),
            hit(matches(text, r"(?:res\.redirect|window\.location|location\.href)\s*[=(]\s*(?:req\.|request\.|params\.|query\.|searchParams)", "i"), 5, "warning", "A redirect goes where the input says"),
        ]
        return F.when(~_comment(trimmed, "//", "*", "#"), F.filter(F.array(*hits), lambda x: x.isNotNull()))

    asked = F.filter(F.transform(all_lines, lambda x, i: F.struct(x.alias("text"), i.alias("i"))), lambda x: matches(x["text"], WRITES, "i"))
    return F.when(live, F.flatten(F.filter(F.transform(asked, lambda x: one(x["text"], js_trim(x["text"]), x["i"])), lambda x: x.isNotNull())))


def missing_security_headers(path: Column, content: Column) -> Column:
    live = gate((path_is(r"(?:next\.config\.|vercel\.json|netlify\.toml|nuxt\.config\.|astro\.config\.|vite\.config\.|nginx\.conf|\.htaccess|middleware\.(ts|js))"),), ())
    low = F.lower(content)
    names = F.array_join(F.filter(F.array(*[F.when(~some(low.contains(a) for a in aliases), F.lit(h)) for h, aliases in HEADERS.items()]), lambda x: x.isNotNull()), ", ")
    return F.when(live & (names != ""), F.array(found("missing-security-headers", "warning", F.concat(F.lit("Security headers aren't set: "), names), F.lit(1), F.concat(F.lit("Missing: "), names), F.lit(0))))


#: Routes, what limits them, which of them are worth limiting, and calls that cost money: fixed values.
ROUTE_FILES = r"(?:api\/|routes\/|server\/|functions\/|middleware|\.server\.|pages\/api\/)"
RATE_LIMITS = r"rateLimit|rateLimiter|upstash.*ratelimit|slidingWindow|fixedWindow|tokenBucket|express-rate-limit|bottleneck|p-throttle|limiter"
RISKY_ROUTE = r"(?:login|signup|register|forgot|reset|checkout|pay|stripe|payment|chat|ai\/|generate|translate|openai|anthropic|claude|gemini)"
PAID_CALLS = (
    r"new\s+(?:OpenAI|Anthropic|Stripe|Twilio|SendGrid)\s*\(", r"openai\.(?:chat|completions|images|embeddings)\.", r"anthropic\.messages\.", r"stripe\.(?:charges|customers|subscriptions|paymentIntents)\.",
    r"twilio\.messages\.create", r"fetch\s*\(\s*['\"`]https:\/\/api\.openai\.com", r"fetch\s*\(\s*['\"`]https:\/\/api\.anthropic\.com", r"fetch\s*\(\s*['\"`]https:\/\/api\.stripe\.com",
)


def missing_rate_limiting(path: Column, content: Column) -> Column:
    live = gate((path_is(ROUTE_FILES), *lacks(RATE_LIMITS)), ())
    risky = matches(path, RISKY_ROUTE, "i")
    call = reduce(lambda a, b: F.when(a != "", a).otherwise(b), [F.regexp_extract(content, js_regex(r, "i"), 0) for r in PAID_CALLS])
    one = F.when(risky, found("missing-rate-limiting", "warning", "A route for logins, payments or models has no rate limit", F.lit(1), path, F.lit(0))).when(call != "", found("missing-rate-limiting", "warning", "A route calls a paid service without a rate limit", F.lit(1), F.substring(call, 1, 80), F.lit(0)))
    return F.when(live, present([one]))


_VERIFIED = r"stripe\.webhooks\.constructEvent|constructEvent\s*\(|stripe-signature|Stripe\.Webhook|paypal.*verify|verifyWebhookSignature|twilio.*validate|validateRequest|X-Twilio-Signature|svix|Webhook\s*\(\s*secret|(?:verifySignature|verify_signature|hmac|createHmac|webhook_secret|signing_secret)|crypto\.(?:createHmac|timingSafeEqual)"
_HOOK_ROUTE = r"(?:app|router|fastify|hono)\.post\s*\(\s*['\"`][^'\"`]*webhook"
_HOOK_EVENT = r"(?:event\.type|event\['type'\])\s*(?:===|==)\s*['\"`](?:payment_intent|checkout\.session|customer\.|invoice\.|charge\.|order\.|message\.)"
_LOGIN_ROUTE = r"(?:app|router)\.post\s*\(\s*['\"`]\/(?:api\/)?(?:login|signin|sign-in|authenticate|auth\/login)['\"`]"
_LOGIN_FILES = r"(?:auth|login|signin|sign-in|credentials|session)"
_SIGNUP_ROUTE = r"(?:app|router)\.post\s*\(\s*['\"`]\/(?:api\/)?(?:register|signup|sign-up|create-account|join)['\"`]"
_SIGNUP_CALL = r"(?:registerUser|signUpUser|handleSignup|handleRegister|createAccount)\s*\("
_SIGNUP_FILES = r"(?:register|signup|sign-up|create-account|join|auth)"

#: File rules whose line is that of the first of several expressions with a match.
ORDERED: tuple[FileRule, ...] = (
    FileRule(
        "unverified-webhook", (not_path(TESTS), *lacks(_VERIFIED)),
        (
            FileBranch((path_is("webhook"), has(_HOOK_ROUTE + "|" + HTTP_POST.replace("export", "(?-i:export)") + r"\s*\(|" + _HOOK_EVENT)), "A webhook's sender isn't verified", at=((_HOOK_ROUTE, "i", ""), (HTTP_POST + r"\s*\(", "", ""), (_HOOK_EVENT, "i", ""))),
            FileBranch((not_path("webhook"), has(_HOOK_ROUTE + "|" + _HOOK_EVENT)), "A webhook's sender isn't verified", at=((_HOOK_ROUTE, "i", ""), (_HOOK_EVENT, "i", ""))),
            FileBranch((path_is("webhook"), *lacks(_HOOK_ROUTE + "|" + HTTP_POST + r"\s*\(|" + _HOOK_EVENT), has(HTTP_POST + r"|\.post\s*\(")), "A webhook's sender isn't verified"),
        ),
    ),
    FileRule(
        "no-account-lockout",
        (not_path(r"(?:\.test\.|\.spec\.|__tests__|src\/rules\/)"),)
        + lacks(r"lockout|lock_out|lockedOut|locked_out|accountLocked|account_locked|failedAttempts|failed_attempts|loginAttempts|login_attempts|attemptCount|maxAttempts|max_attempts|MAX_LOGIN_ATTEMPTS|exponentialBackoff|backoff|cooldown|throttle|captcha|turnstile|(?:rateLimit|rateLimiter).*(?:login|auth|signin)|(?:login|auth|signin).*(?:rateLimit|rateLimiter)|bruteForce|brute_force|brute-force|express-brute|rate-limiter-flexible"),
        (
            FileBranch((path_is(_LOGIN_FILES), has(_LOGIN_ROUTE + r"|" + HTTP_POST + r"|(?:bcrypt|argon2|scrypt)\.(?:compare|verify)\s*\(|(?:signIn|authenticateUser|verifyCredentials|checkPassword)\s*\(")), "Logins can be tried without end", at=((_LOGIN_ROUTE, "i", ""), (HTTP_POST, "", ""), (r"(?:bcrypt|argon2|scrypt)\.(?:compare|verify)\s*\(", "i", ""), (r"(?:signIn|authenticateUser|verifyCredentials|checkPassword)\s*\(", "i", ""))),
            FileBranch((not_path(_LOGIN_FILES), has(_LOGIN_ROUTE + r"|(?:bcrypt|argon2|scrypt)\.(?:compare|verify)\s*\(|(?:signIn|authenticateUser|verifyCredentials|checkPassword)\s*\(")), "Logins can be tried without end", at=((_LOGIN_ROUTE, "i", ""), (r"(?:bcrypt|argon2|scrypt)\.(?:compare|verify)\s*\(", "i", ""), (r"(?:signIn|authenticateUser|verifyCredentials|checkPassword)\s*\(", "i", ""))),
        ),
    ),
    FileRule(
        "no-bot-protection",
        (not_path(r"(?:\.test\.|\.spec\.|__tests__|src\/rules\/)"),) + lacks(r"captcha|turnstile|honeypot|honey_pot|botField|bot_field|arkose|geetest|rate-limiter-flexible|express-brute|express-slow-down|bot-detect|isBot|is_bot|botDetect|bot_detect"),
        (
            FileBranch((path_is(_SIGNUP_FILES), has(_SIGNUP_ROUTE + "|" + HTTP_POST + "|" + _SIGNUP_CALL)), "Bots can sign up", at=((_SIGNUP_ROUTE, "i", ""), (HTTP_POST, "", ""), (_SIGNUP_CALL, "i", ""))),
            FileBranch((not_path(_SIGNUP_FILES), has(_SIGNUP_ROUTE + "|" + _SIGNUP_CALL)), "Bots can sign up", at=((_SIGNUP_ROUTE, "i", ""), (_SIGNUP_CALL, "i", ""))),
        ),
    ),
    FileRule(
        "insecure-jwt", (not_path(TESTS), has("jwt", "")),
        (FileBranch((has(r"jwt\.sign\s*\(\s*(?:(?!expiresIn|exp).)*\)"), *lacks("expiresIn|\"exp\"", flags="")), "A token is signed without an expiry"),),
    ),
)


def _redacted(text: Column) -> Column:
    """The first quoted value is masked."""
    p = r"^([\s\S]*?)['\"`][^'\"`]+['\"`]"
    return F.when(matches(text, r"['\"`][^'\"`]+['\"`]"), F.regexp_replace(text, p, '$1"***"')).otherwise(text)


def insecure_jwt(path: Column, content: Column) -> Column:
    live = gate((not_path(TESTS), has(r"jwt", "")), ())

    def one(text: Column, trimmed: Column, i: Column) -> Column:
        masked, shown = F.substring(_redacted(trimmed), 1, 120), F.substring(trimmed, 1, 120)
        hits = [
            F.when(matches(text, r"jwt\.sign\s*\([^,]+,\s*['\"`]([^'\"`]{1,20})['\"`]", "i"), found("insecure-jwt", "critical", "A token is signed with a short secret", i + 1, masked, i * 10)),
            F.when(matches(text, r"jwt\.sign\s*\([^,]+,\s*['\"`](?:secret|password|key|token|jwt[_-]?secret|my[_-]?secret|your[_-]?secret|change[_-]?me|test|dev|1234|admin)['\"`]", "i"), found("insecure-jwt", "critical", "A token is signed with a well-known secret", i + 1, masked, i * 10 + 1)),
            F.when(matches(text, r"jwt\.verify\s*\(\s*[^,]+,\s*[^,]+\s*\)"), found("insecure-jwt", "warning", "A token is verified without fixed algorithms", i + 1, shown, i * 10 + 2)),
        ]
        return F.when(~_comment(trimmed, "//", "*"), F.filter(F.array(*hits), lambda x: x.isNotNull()))

    return F.when(live, F.flatten(F.filter(F.transform(lines(content), lambda x, i: one(x, js_trim(x), i)), lambda x: x.isNotNull())))


def insecure_cookies(path: Column, content: Column) -> Column:
    live = gate((not_path(TESTS),), ()) & (content.contains("cookie") | content.contains("Cookie"))

    def one(text: Column, trimmed: Column, i: Column) -> Column:
        shown, options = F.substring(trimmed, 1, 120), r"res\.cookie\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*[^,]+,\s*\{([^}]*)\}"
        given = F.lower(F.regexp_extract(text, options, 1))
        absent = F.array_join(F.filter(F.array(*[F.lit(x) for x in ("httponly", "secure", "samesite")]), lambda x: ~given.contains(x)), ", ")
        hits = [
            F.when(matches(text, r"res\.cookie\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*[^,)]+\s*\)"), found("insecure-cookies", "warning", "A cookie is set without options", i + 1, shown, i * 10)),
            F.when(matches(text, options) & (absent != ""), found("insecure-cookies", "warning", F.concat(F.lit("A cookie lacks flags: "), absent), i + 1, shown, i * 10 + 1)),
            F.when(matches(text, r"['\"`]Set-Cookie['\"`]\s*,\s*['\"`][^'\"`]+['\"`]", "i"), found("insecure-cookies", "warning", "A cookie header is written by hand", i + 1, shown, i * 10 + 2)),
            F.when(matches(text, r"document\.cookie\s*=\s*(?!.*(?:httponly|secure|samesite))", "i"), found("insecure-cookies", "warning", "The client sets a cookie without flags", i + 1, shown, i * 10 + 3)),
        ]
        return F.when(~_comment(trimmed, "//", "*"), F.filter(F.array(*hits), lambda x: x.isNotNull()))

    return F.when(live, F.flatten(F.filter(F.transform(lines(content), lambda x, i: one(x, js_trim(x), i)), lambda x: x.isNotNull())))


def missing_gitignore(path: Column, content: Column) -> Column:
    """Wanted entries without the entries there are; any entry with ``.env`` stands for all of its kind."""
    entries = F.filter(F.transform(lines(F.lower(content)), js_trim), lambda x: ~x.startswith("#"))
    env = F.exists(entries, lambda x: x.contains(".env"))

    def begins(entry: str) -> Column:
        return F.exists(entries, lambda x: x.startswith(entry))

    must = [F.when(~env, found("missing-gitignore", "critical", f"{p} isn't ignored and can be committed", F.lit(1), F.lit(f"Missing: {p}"), F.lit(k))) for k, p in enumerate((".env", ".env.local", ".env.production", ".env.development"))]
    should = [F.when(~begins(p.lower()), found("missing-gitignore", "warning", f"{p} isn't ignored", F.lit(1), F.lit(f"Missing: {p}"), F.lit(4 + k))) for k, p in enumerate(("node_modules", ".DS_Store"))]
    return F.when(path == ".gitignore", present([*must, *should]))


def supabase_missing_rls(path: Column, content: Column) -> Column:
    """Tables made without row security, security without policies, and calls that go around it."""
    live = gate((not_path(TESTS_DEPS),), ())
    table = r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:public\.)?(\w+)"
    made = match_offsets(content, table, "i")
    secured = F.transform(F.regexp_extract_all(content, F.lit(js_regex(r"ALTER\s+TABLE\s+(?:public\.)?(\w+)\s+ENABLE\s+ROW\s+LEVEL\s+SECURITY", "i")), F.lit(1)), F.lower)
    named = F.transform(made, lambda m: F.struct(m["off"].alias("off"), F.regexp_extract(m["text"], js_regex(table, "i"), 1).alias("name")))
    bare = F.transform(F.filter(named, lambda m: ~F.array_contains(secured, F.lower(m["name"]))), lambda m: found("supabase-missing-rls", "critical", F.concat(F.lit("The table "), m["name"], F.lit(" has no row level security")), line_of(content, m["off"]), F.concat(F.lit("CREATE TABLE "), m["name"]), m["off"]))
    no_policy = F.when((F.size(made) > 0) & (F.size(secured) > 0) & ~matches(content, r"CREATE\s+POLICY", "i"), F.array(found("supabase-missing-rls", "critical", "Row level security is on, but no policy is defined", F.lit(1), F.lit(None), F.lit(50_000_000))))
    migration = F.when(matches(path, r"(?:migrations?|supabase)\/.*\.sql$", "i"), F.concat(bare, F.coalesce(no_policy, F.array().cast(FOUND_DDL))))
    calls = F.filter(match_offsets(content, r"\.rpc\s*\(\s*['\"`]\w+['\"`]\s*,"), lambda m: matches(F.substring(content, F.greatest(m["off"] - 200, F.lit(0)) + 1, F.least(m["off"], F.lit(200))), "service_role|supabaseAdmin|serviceRole", "i"))
    around = F.transform(calls, lambda m: found("supabase-missing-rls", "critical", "A call with the service role goes around row level security", line_of(content, m["off"]), line_evidence(content, line_of(content, m["off"])), F.lit(60_000_000) + m["off"]))
    client = F.when(matches(path, r"(?:supabase|database|db)\.(js|ts|jsx|tsx)$", "i") | content_matches(content, "supabase", "i"), around)
    empty = F.array().cast(FOUND_DDL)
    return F.when(live, F.concat(F.coalesce(migration.cast(FOUND_DDL), empty), F.coalesce(client.cast(FOUND_DDL), empty)))


def vercel_env_leak(path: Column, content: Column) -> Column:
    live = gate((not_path(TESTS_DEPS),), (path_is(r"(?:vercel\.json|\.env(?:\.\w+)?|next\.config\.(js|ts|mjs))$"), has(r"(?:NEXT_PUBLIC_|VITE_|PUBLIC_|NUXT_PUBLIC_)")))
    p = js_regex(r"(NEXT_PUBLIC_|VITE_|PUBLIC_|NUXT_PUBLIC_)(\w+)", "i")

    def one(text: Column, trimmed: Column, i: Column) -> Column:
        name = F.regexp_extract(text, p, 0)
        secret = matches(F.regexp_extract(text, p, 2), r"(?:SECRET|PRIVATE|PASSWORD|CREDENTIAL|DATABASE_URL|SERVICE_ROLE|ADMIN_KEY|API_SECRET|JWT_SECRET|SIGNING_KEY|ENCRYPTION_KEY)", "i")
        return F.when(secret, found("vercel-env-leak", "critical", F.concat(name, F.lit(" is public but named like a secret")), i + 1, name, i))

    return F.when(live, _on_lines(content, one))


def graphql_introspection(path: Column, content: Column) -> Column:
    """Switches that are on, unless the line or one of the three before it looks at the environment."""
    live = gate((not_path(TESTS_DEPS_RULES), has(r"(?:graphql|apollo|yoga|mercurius)")), ())
    all_lines = lines(content)

    def one(text: Column, trimmed: Column, i: Column) -> Column:
        near = F.array_join(F.slice(all_lines, F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4))), "\n")
        live_here = ~matches(near, r"NODE_ENV|process\.env|development", "i")
        shown = F.substring(trimmed, 1, 120)
        hits = [
            F.when(matches(text, r"introspection\s*:\s*true", "i"), found("graphql-introspection", "warning", "The schema can be read by anyone", i + 1, shown, i * 10)),
            F.when(matches(text, r"(?:playground|graphiql)\s*:\s*true", "i"), found("graphql-introspection", "warning", "The query editor is open to anyone", i + 1, shown, i * 10 + 1)),
        ]
        return F.when(live_here, F.filter(F.array(*hits), lambda x: x.isNotNull()))

    wanted = content_matches(content, r"(?:introspection|playground|graphiql)\s*:\s*true", "i")
    return F.when(live & wanted, F.flatten(F.filter(F.transform(all_lines, lambda x, i: one(x, js_trim(x), i)), lambda x: x.isNotNull())))


def dangerous_html(path: Column, content: Column, escapers: tuple[str, ...] = ()) -> Column:
    """Raw HTML unless its value is a literal, escaped, or a name whose one assignment is."""
    live = gate((not_path(TESTS_DEPS), path_is(r"\.(jsx|tsx)$")), ()) & content.contains("dangerouslySetInnerHTML")
    esc = escaper_pattern(escapers)
    name = r"^[A-Za-z_$][\w$]*$"

    def quoted(word: Column) -> Column:
        return F.replace(word, F.lit("$"), F.lit(r"\$"))

    def function_escapes(word: Column) -> Column:
        declared = F.concat(F.lit(r"(?:function\s+"), quoted(word), F.lit(r"\s*\(|(?:const|let|var)\s+"), quoted(word), F.lit(r"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function|\())[\s\S]{0,760}"))
        body = F.regexp_substr(content, declared)
        return F.coalesce(matches(body, ESCAPES_HTML, "i") | matches(body, esc, "i"), F.lit(False))

    def shape(v: Column) -> Column:
        """Of a value that isn't a plain name: 1 safe, 0 unknown."""
        call = F.regexp_extract(v, r"^([A-Za-z_$][\w$]*)\s*\(", 1)
        return F.when(matches(v, r"^['\"]"), 1).when(v.startswith("`"), F.when(v.contains("${"), 0).otherwise(1)).when((call != "") & (matches(v, esc, "i") | function_escapes(call)), 1).otherwise(0)

    def verdict(v: Column, depth: int) -> Column:
        """1 safe, 0 unknown, -1 unsafe."""
        if depth > 1:
            return F.lit(0)
        assigned = F.regexp_extract_all(content, F.concat(F.lit(r"(?:^|[^\w$.])(?:(?:const|let|var)\s+)?"), quoted(v), F.lit(r"\s*(?::[^=\n]+)?=(?![=>])\s*([^\n]+)")), F.lit(1))
        value = F.regexp_replace(js_trim(F.get(assigned, F.lit(0))), ";+$", "")
        resolved = F.when(F.size(assigned) > 1, -1).when(F.size(assigned) == 1, F.when(matches(value, esc, "i"), 1).otherwise(verdict(value, depth + 1))).otherwise(0)
        return F.when(matches(v, name), resolved).otherwise(shape(v))

    def asked(m: Column) -> Column:
        line = js_trim(F.element_at(lines(content), line_of(content, m["off"])))
        value = js_trim(F.regexp_extract(F.substring(content, m["off"] + 1, F.lit(220)), r"__html\s*:\s*([^,}\n]+)", 1))
        what = F.when(value == "", 0).otherwise(verdict(value, 0))
        near = F.substring(content, F.greatest(m["off"] - 140, F.lit(0)) + 1, F.least(m["off"], F.lit(140)) + 260)
        return ~_comment(line, "//", "*", "/*") & ((what < 0) | ((what == 0) & ~matches(near, esc, "i")))

    hits = F.filter(match_offsets(content, "dangerouslySetInnerHTML"), asked)
    return F.when(live, F.transform(hits, lambda m: found("dangerously-set-inner-html", "critical", "Raw HTML is rendered without sanitising", line_of(content, m["off"]), line_evidence(content, line_of(content, m["off"])), m["off"])))


def high_entropy_strings(path: Column, content: Column) -> Column:
    live = gate((not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.d\.ts$|\.lock$|\.min\.js$)"), not_path(r"src\/rules\/"), not_path(r"\.(?:env\.example|env\.sample|svg|png|jpg|ico|woff|css)$")), ())
    p = r"(?:(?:const|let|var|export)\s+)?(\w+)\s*[:=]\s*['\"]([A-Za-z0-9+/=_\-]{16,})['\"](?:\s*[;,]|\s*$)"

    def one(text: Column, i: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(js_regex(p)), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(js_regex(p)), F.lit(2)).alias("value"))
        secret = F.filter(pairs, lambda x: matches(x["name"], r"(?:key|secret|token|password|credential|api_key|apiKey|auth|private|signing|encryption)", "i") & (F.length(x["value"]) <= 500))
        bits = F.transform(secret, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), shannon_entropy(x["value"]).alias("bits")))
        high = F.filter(bits, lambda x: x["bits"] > F.when(matches(x["value"], "^[0-9a-fA-F]+$"), 3.5).otherwise(4.0))
        return F.transform(high, lambda x, k: found("high-entropy-strings", "warning", F.concat(F.lit("The value of "), x["name"], F.lit(" looks random: "), F.format_string("%.1f", x["bits"]), F.lit(" bits a character")), i + 1, F.concat(x["name"], F.lit(' = "'), F.substring(x["value"], 1, 4), F.lit("..."), F.right(x["value"], F.lit(4)), F.lit('"')), i * 100 + k))

    rows = F.filter(F.transform(lines(content), lambda x, i: F.struct(x.alias("text"), i.alias("i"))), lambda x: matches(x["text"], p) & ~_comment(js_trim(x["text"]), "//", "*", "#"))
    return F.when(live & matches(content, r"[:=]\s*['\"][A-Za-z0-9+/=_\-]{16,}['\"]"), F.flatten(F.transform(rows, lambda x: one(x["text"], x["i"]))))


def docker_root_user(path: Column, content: Column) -> Column:
    """No USER at all, or a last one that is root."""
    live = gate((not_path(TESTS_DEPS), path_is(r"(?:^|\/)Dockerfile(?:\.\w+)?$")), ())
    users = F.filter(F.transform(lines(content), lambda x, i: F.struct((i + 1).alias("line"), js_trim(x).alias("text"))), lambda x: matches(x["text"], r"^USER\s+", "i"))
    last = F.try_element_at(users, F.lit(-1))
    one = F.when(F.size(users) == 0, found("docker-root-user", "warning", "No USER is set, so the container runs as root", F.lit(1), line_evidence(content, F.lit(1)), F.lit(0))).when(
        matches(last["text"], r"^USER\s+root\s*$", "i"), found("docker-root-user", "warning", "The last USER is root", last["line"], F.substring(last["text"], 1, 120), F.lit(0))
    )
    return F.when(live, present([one]))


def exposed_database_port(path: Column, content: Column) -> Column:
    """Items of a ``ports:`` block that publish a database's port; a fold over lines carries whether one is open."""
    live = gate((not_path(TESTS_DEPS), path_is(r"(?:^|\/)docker-compose(?:\.\w+)?\.ya?ml$")), ())
    names = F.create_map(*[F.lit(x) for kv in DATABASE_PORTS.items() for x in kv])

    def step(state: Column, x: Column) -> Column:
        trimmed, n = js_trim(x), state["n"] + 1
        opens = matches(trimmed, r"^ports\s*:", "i")
        inside = F.when(opens, True).when(state["inside"] & matches(x, r"^\S") & ~matches(x, r"^\s*-"), False).otherwise(state["inside"])
        port = F.regexp_extract(trimmed, r"['\"]?(?:[\d.]+:)?(\d+):\d+['\"]?", 1)
        hit = ~opens & inside & trimmed.startswith("-") & F.coalesce(F.try_element_at(names, port).isNotNull(), F.lit(False))
        out = F.when(hit, F.concat(state["out"], F.array(F.struct(n.alias("line"), port.alias("port"), F.substring(trimmed, 1, 120).alias("text"))))).otherwise(state["out"])
        return F.struct(n.alias("n"), inside.alias("inside"), out.alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"), F.array().cast("array<struct<line:int,port:string,text:string>>").alias("out"))
    hits = F.aggregate(lines(content), start, step)["out"]
    return F.when(live, F.transform(hits, lambda h: found("exposed-database-port", "warning", F.concat(F.try_element_at(names, h["port"]), F.lit(" port "), h["port"], F.lit(" is published on the host")), h["line"], h["text"], h["line"])))


def github_actions_injection(path: Column, content: Column) -> Column:
    """Outsiders' values in ``run:`` blocks; a fold over lines carries the block's indentation, -1 outside."""
    live = gate((path_is(r"\.github\/workflows\/[^/]*\.ya?ml$"),), ()) & content.contains("${{")

    def step(state: Column, x: Column) -> Column:
        trimmed, n = js_trim(x), state["n"] + 1
        indent = F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
        blank = trimmed == ""
        run = F.when(~blank & (state["run"] >= 0) & (indent <= state["run"]), -1).otherwise(state["run"])
        opens = matches(trimmed, r"^(?:-\s*)?run:")
        hit = ~blank & (opens | (run >= 0)) & matches(x, WORKFLOW_INPUT, "i")
        return F.struct(n.alias("n"), F.when(opens, indent).otherwise(run).alias("run"), F.when(hit, F.concat(state["out"], F.array(n))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("run"), F.array().cast("array<int>").alias("out"))
    at = F.aggregate(lines(content), start, step)["out"]
    return F.when(live, F.transform(at, lambda n: found("github-actions-injection", "critical", "A value that outsiders set runs in a shell", n, line_evidence(content, n), n)))


_PACKAGE = r"(?:^|\/)package\.json$"
_PACKAGE_DDL = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,optionalDependencies:map<string,string>>"


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def no_error_monitoring(path: Column, content: Column) -> Column:
    package = F.from_json(content, _PACKAGE_DDL)
    names = F.concat(F.map_keys(F.coalesce(package["dependencies"], _no_map())), F.map_keys(F.coalesce(package["devDependencies"], _no_map())))
    web = F.exists(names, lambda n: matches(n, r"^(?:next|react|react-dom|express|fastify|koa|@remix-run\/|vue|nuxt|svelte|@sveltejs\/|hono|@nestjs\/|@angular\/)", "i"))
    watched = F.exists(names, lambda n: matches(n, r"^(?:@sentry\/|rollbar|bugsnag|@bugsnag\/|@datadog\/|newrelic|@newrelic\/|honeybadger|@honeybadger-io\/|elastic-apm|@opentelemetry\/|logrocket|@highlight-run\/)", "i"))
    return F.when(matches(path, _PACKAGE) & web & ~watched, F.array(found("no-error-monitoring", "info", "Nothing reports the application's errors", F.lit(1), F.lit(None), F.lit(0))))


def unpinned_dependencies(path: Column, content: Column) -> Column:
    package = F.from_json(content, _PACKAGE_DDL)
    fields = [F.map_entries(F.coalesce(package[f], _no_map())) for f in ("dependencies", "devDependencies", "optionalDependencies")]
    loose = F.filter(F.concat(*fields), lambda e: e["value"].isNotNull() & matches(js_trim(e["value"]), r"^(?:\*|latest|x|X|)$"))

    def one(e: Column, k: Column) -> Column:
        at = F.array_position(F.transform(lines(content), lambda x: x.contains(F.concat(F.lit('"'), e["key"], F.lit('"')))), True)
        shown = F.when(at > 0, line_evidence(content, at.cast("int")))
        return found("unpinned-dependencies", "warning", F.concat(e["key"], F.lit(" takes any version: "), F.when(e["value"] == "", "(empty)").otherwise(e["value"])), F.greatest(at, F.lit(1)), shown, k)

    return F.when(matches(path, _PACKAGE), F.transform(loose, one))


def install_script_dependency(path: Column, content: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Packages of a lock file that run code at install, each version once; known ones are only noted."""
    lock = F.from_json(content, "struct<packages:map<string,struct<version:string,hasInstallScript:boolean>>>")
    entries = F.filter(F.map_entries(lock["packages"]), lambda e: e["value"]["hasInstallScript"])
    named = F.transform(entries, lambda e: F.struct(e["key"].alias("at"), F.substring_index(e["key"], "node_modules/", -1).alias("name"), F.coalesce(e["value"]["version"], F.lit("unknown")).alias("version")))
    keys = F.array_distinct(F.transform(named, lambda e: F.struct(e["name"], e["version"])))

    def one(key: Column, k: Column) -> Column:
        first = F.get(F.filter(named, lambda e: (e["name"] == key["name"]) & (e["version"] == key["version"])), F.lit(0))
        known = key["name"].isin(*ALLOWED_INSTALL_SCRIPTS, *allowed)
        what = F.concat(key["name"], F.lit("@"), key["version"], F.when(known, " runs its usual install script").otherwise(" runs code when it is installed"))
        return found("install-script-dependency", F.when(known, "info").otherwise("warning"), what, F.lit(1), F.concat(first["at"], F.lit(": hasInstallScript")), k)

    return F.when(matches(path, r"(?:^|\/)package-lock\.json$", "i"), F.transform(keys, one))


def sql_injection(path: Column, content: Column) -> Column:
    """SQL with values inside; lower-case SQL counts only where a database call is at most three lines away."""
    live = gate((not_path(r"(?:\.test\.|\.spec\.|__tests__|\.d\.ts$)"), not_path(r"src\/rules\/")), ()) & (content.contains("${") | content.contains("+")) & content_matches(content, SQL_VERB, "i") & matches(content, r"\$\{|['\"]\s*\+")
    all_lines = lines(content)

    def unsafe_template(text: Column, near: Column) -> Column:
        parts = F.split(text, "`", -1)
        spans = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(2))), lambda k: (k % 2 == 1) & (k + 1 < F.size(parts)))

        def bad(k: Column) -> Column:
            span = F.concat(F.lit("`"), F.get(parts, k), F.lit("`"))
            tag = F.regexp_extract(F.get(parts, k - 1), r"([A-Za-z0-9_$.\[\]]+)\z", 1)
            return (matches(span, SQL_TEMPLATE) | (near & matches(span, SQL_TEMPLATE, "i"))) & ((tag == "") | matches(tag, r"(?:unsafe$|\.raw$|^raw$)", "i"))

        return (F.size(parts) > 2) & F.exists(spans, bad)

    def one(text: Column, trimmed: Column, i: Column) -> Column:
        near = F.exists(F.slice(all_lines, F.greatest(i - 2, F.lit(1)), F.least(i + 4, F.lit(7))), lambda x: matches(x, SQL_SINK, "i"))
        template = unsafe_template(text, near)
        concat = matches(text, SQL_CONCAT) | (near & matches(text, SQL_CONCAT, "i"))
        asked = ~_comment(trimmed, "//", "*", "#") & (matches(text, SQL_SINK, "i") | ~matches(text, SQL_OTHER, "i")) & matches(text, SQL_VERB, "i")
        shown = F.substring(trimmed, 1, 120)
        return F.when(asked & template, found("sql-injection", "critical", "SQL is built by a template with values", i + 1, shown, i)).when(asked & concat, found("sql-injection", "critical", "SQL is joined with values", i + 1, shown, i))

    return F.when(live, _on_lines(content, one))


def middleware_matcher(path: Column, content: Column) -> Column:
    live = gate((not_path(TESTS_DEPS), path_is(r"middleware\.(js|ts|jsx|tsx)$")), ())
    p = js_regex(r"export\s+const\s+config\s*=\s*\{[^}]*matcher\s*:\s*(\[[\s\S]*?\]|['\"][^'\"]*['\"])")
    matcher = F.regexp_extract(content, p, 1)
    open_ = (matcher != "") & ~matcher.contains("/api") & ~matcher.contains("/:path*") & ~matcher.contains("/((?!")
    line = first_line(content, "matcher")
    return F.when(live & open_, F.array(found("nextjs-middleware-bypass", "critical", "The matcher doesn't cover the API", line, line_evidence(content, line), F.lit(100))))


CHECKS: dict[str, tuple[Check, ...]] = {
    "exposed-env-vars": (exposed_env_vars,),
    "no-input-validation": (no_input_validation,),
    "missing-security-headers": (missing_security_headers,),
    "missing-rate-limiting": (missing_rate_limiting,),
    "insecure-jwt": (insecure_jwt,),
    "insecure-cookies": (insecure_cookies,),
    "missing-gitignore": (missing_gitignore,),
    "nextjs-middleware-bypass": (middleware_matcher,),
    "supabase-missing-rls": (supabase_missing_rls,),
    "vercel-env-leak": (vercel_env_leak,),
    "graphql-introspection": (graphql_introspection,),
    "dangerously-set-inner-html": (dangerous_html,),
    "high-entropy-strings": (high_entropy_strings,),
    "docker-root-user": (docker_root_user,),
    "exposed-database-port": (exposed_database_port,),
    "no-error-monitoring": (no_error_monitoring,),
    "unpinned-dependencies": (unpinned_dependencies,),
    "install-script-dependency": (install_script_dependency,),
    "github-actions-injection": (github_actions_injection,),
    "sql-injection": (sql_injection,),
}
#: Checks that take names from the configuration.
TAKES_ESCAPERS = (no_input_validation, dangerous_html)
