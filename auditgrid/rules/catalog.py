"""The rules dimension: order, severity, taxonomy and advice of each rule.

Ids, severities and taxonomy are fixed values; names and advice are our own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# id | severity | CWE | CVSS | OWASP | WCAG | name | advice
_ROWS = """
exposed-secrets|critical|CWE-798|7.5|A07:2021||Secret in source|Move the secret to the server's environment and revoke the one that leaked.
hardcoded-credentials|critical|CWE-798|7.5|A07:2021||Credentials in source|Read credentials from the environment or a secret store.
exposed-env-vars|critical|CWE-200|7.5|A02:2021||Secret variable sent to clients|Drop the public prefix and read the variable on the server only.
open-database-rules|critical|CWE-284|9.8|A01:2021||Open database rules|Tie every rule to the signed-in user.
missing-auth|critical|CWE-306|9.8|A07:2021||Route without authentication|Check the session before the handler does any work.
no-input-validation|critical|CWE-20|8.6|A03:2021||Unchecked input reaches a sink|Validate or escape the value before it is used.
insecure-error-handling|warning|CWE-209|4.3|A09:2021||Errors leak or vanish|Log details on the server and answer with a plain message.
missing-security-headers|warning|CWE-693|4.3|A05:2021||Security headers missing|Set the missing headers for all responses.
missing-rate-limiting|warning|CWE-770|5.3|A04:2021||No rate limit|Limit requests by user or address.
insecure-connections|warning|CWE-319|5.3|A02:2021||Unprotected connection|Use TLS, verify certificates and name allowed origins.
client-side-db-access|critical|CWE-602|8.6|A04:2021||Database access in the client|Query the database from the server.
client-bundle-secrets|critical|CWE-200|7.5|A02:2021||Secret in the client bundle|Call the service from the server so that its key stays there.
client-only-auth|warning|CWE-602|6.5|A04:2021||Authorisation only in the client|Repeat the check on the server.
sensitive-browser-storage|critical|CWE-922|6.5|A04:2021||Secret in browser storage|Keep tokens in cookies that scripts can't read.
console-data-leak|warning|CWE-532|4.3|A09:2021||Data on the console|Remove the log or mask its values.
source-maps-exposed|warning|CWE-540|3.7|A05:2021||Public source maps|Switch source maps off for production or upload them privately.
client-side-trust|warning|CWE-602|5.3|A04:2021||Trust in client values|Compute prices and permissions on the server.
api-data-overfetch|warning|CWE-200|4.3|A01:2021||Response holds too much|Pick the fields that the client needs.
idor-vulnerability|critical|CWE-639|8.6|A01:2021||Object reached by id alone|Compare the object's owner with the session's user.
missing-csrf|warning|CWE-352|6.5|A01:2021||No CSRF protection|Use same-site cookies or a token per session.
unsafe-file-upload|critical|CWE-434|8.1|A04:2021||Unchecked upload|Check the type and the size of uploads.
mass-assignment|critical|CWE-915|8.1|A08:2021||Request body stored whole|Take named fields from a validated body.
unverified-webhook|critical|CWE-345|7.5|A08:2021||Webhook not verified|Verify the sender's signature over the raw body.
no-pagination|warning|CWE-770|4.3|A04:2021||Unbounded query|Read results by page.
path-traversal|critical|CWE-22|8.6|A01:2021||Path from user input|Resolve the path and make sure it stays in its folder.
insecure-jwt|critical|CWE-347|7.5|A02:2021||Weak token handling|Use a long secret from the environment, fixed algorithms and an expiry.
plaintext-passwords|critical|CWE-256|7.5|A02:2021||Unhashed password|Hash passwords with a slow, salted function.
insecure-randomness|critical|CWE-330|5.3|A02:2021||Guessable random value|Use the platform's cryptographic generator.
insecure-cookies|warning|CWE-614|4.3|A05:2021||Cookie without flags|Set httpOnly, secure and sameSite.
ssrf-vulnerability|critical|CWE-918|8.6|A10:2021||Request to a user's address|Allow known hosts only.
prototype-pollution|critical|CWE-1321|8.1|A03:2021||Prototype can be changed|Reject special keys before merging.
missing-gitignore|critical|CWE-538|5.3|A05:2021||Ignore list has gaps|Add the entry before the file is committed.
timing-attack|warning|CWE-208|3.7|A02:2021||Comparison leaks time|Compare secrets in constant time.
cors-credentials|warning|CWE-942|5.3|A05:2021||Credentials for loose origins|Name the origins that may send credentials.
no-account-lockout|warning|CWE-307|5.3|A07:2021||Logins can be tried for ever|Lock or slow an account after failed logins.
unsafe-redirect|warning|CWE-601|5.3|A01:2021||Redirect to a user's address|Allow relative or listed targets only.
no-bot-protection|warning|CWE-799|3.7|A07:2021||Sign-up open to bots|Add a challenge to the sign-up.
predictable-ids|info|CWE-340|3.7|A04:2021||Ids can be counted|Use random ids in addresses.
debug-mode-exposed|warning|CWE-489|3.7|A05:2021||Debug mode on|Switch it by environment.
secrets-in-urls|critical|CWE-598|5.3|A04:2021||Secret in an address|Send secrets in a header or the body.
nextjs-server-action-exposure|critical|CWE-306|8.6|A07:2021||Server action without authentication|Check the session at the start of the action.
nextjs-middleware-bypass|critical|CWE-863|7.5|A01:2021||Middleware leaves routes open|Let the matcher cover the API and check the user.
nextjs-api-route-no-method-check|warning|CWE-749|4.3|A04:2021||Route answers any method|Answer the intended methods only.
supabase-missing-rls|critical|CWE-284|9.8|A01:2021||Table without row security|Enable row level security and add policies.
supabase-service-key-client|critical|CWE-798|9.8|A07:2021||Service key in the client|Use the service key on the server only.
supabase-anon-key-abuse|warning|CWE-269|5.3|A04:2021||Admin calls with the anonymous key|Do admin work on the server.
firebase-admin-client|critical|CWE-798|9.8|A07:2021||Admin SDK in the client|Keep the admin SDK on the server.
vercel-env-leak|critical|CWE-200|7.5|A02:2021||Public variable named like a secret|Rename the variable without its public prefix.
netlify-redirect-open|warning|CWE-601|5.3|A01:2021||Open redirect rule|Name the target paths.
deployment-config-insecure|warning|CWE-16|4.3|A05:2021||Loose deployment settings|Set security headers in the deployment.
ai-prompt-injection|critical|CWE-77|8.6|A03:2021||User text in a prompt|Keep instructions and user text in separate messages.
ai-response-trusted|warning|CWE-20|6.5|A03:2021||Model output trusted|Treat a model's output like user input.
ai-cost-exposure|warning|CWE-770|5.3|A04:2021||Model call without limit|Set a token limit.
stripe-webhook-no-verify|critical|CWE-345|8.1|A08:2021||Payment webhook not verified|Construct events with the signing secret.
payment-amount-client|critical|CWE-602|8.6|A04:2021||Amount from the client|Look prices up on the server.
pii-logging|warning|CWE-532|4.3|A09:2021||Personal data in logs|Log an id in place of the person's data.
missing-data-encryption|warning|CWE-311|5.3|A02:2021||Sensitive field unencrypted|Encrypt the field before it is stored.
graphql-introspection|warning|CWE-200|3.7|A05:2021||Schema can be explored|Switch introspection off in production.
graphql-depth-limit|warning|CWE-770|5.3|A04:2021||Queries without depth limit|Limit the depth or cost of queries.
graphql-no-auth|critical|CWE-306|8.6|A07:2021||Resolvers without authentication|Check the user in the context or the resolvers.
session-fixation|critical|CWE-384|7.5|A07:2021||Session outlives login or logout|Renew the session at login and destroy it at logout.
oauth-state-missing|critical|CWE-352|8.1|A07:2021||OAuth without state|Send a random state and compare it on return.
password-reset-weak|warning|CWE-640|5.3|A07:2021||Weak password reset|Use random tokens that expire.
mfa-bypass|warning|CWE-287|6.5|A07:2021||Second factor can be skipped|Give no session before the second factor.
auth-token-no-expiry|warning|CWE-613|5.3|A07:2021||Token never expires|Set an expiry.
race-condition|critical|CWE-362|8.1|A04:2021||Check and update can race|Use a transaction or an atomic update.
nosql-injection|critical|CWE-943|8.6|A03:2021||Request used as a query|Build the query from checked values.
xml-xxe|critical|CWE-611|8.6|A05:2021||XML entities resolved|Switch external entities off.
ldap-injection|critical|CWE-90|8.6|A03:2021||Input in a directory filter|Escape filter values.
header-injection|warning|CWE-113|5.3|A03:2021||Input in a header|Strip line breaks and check the value.
subdomain-takeover|warning|CWE-284|5.3|A05:2021||Host that can lapse|Remove records of services that aren't used.
clickjacking|warning|CWE-1021|4.3|A05:2021||Pages can be framed|Set frame-ancestors.
dangerously-set-inner-html|critical|CWE-79|6.1|A03:2021||Raw HTML is rendered|Sanitise the HTML first.
eval-usage|critical|CWE-95|8.6|A03:2021||Code from a string|Replace it by a parser or a table of functions.
regex-dos|warning|CWE-1333|5.3|A04:2021||Slow regular expression|Avoid nested repeats.
hardcoded-ip|info|CWE-547|2.0|A05:2021||Fixed IP address|Use a host name from the settings.
high-entropy-strings|warning|CWE-798|5.0|A07:2021||Random-looking value|If it is a secret, move and revoke it.
git-history-secrets|critical|CWE-798|7.5|A07:2021||Secret in history|Revoke the secret; removing the file isn't enough.
docker-root-user|warning|CWE-250|6.5|A05:2021||Container runs as root|Add a USER that isn't root.
exposed-database-port|warning|CWE-284|5.3|A05:2021||Database port published|Keep the port inside the network.
serverless-fs-write|warning|||||Write to a short-lived disk|Store the file in object storage.
a11y-img-no-alt|warning||||WCAG 1.1.1|Image without text|Add alt, empty for decoration.
a11y-form-no-label|warning||||WCAG 1.3.1|Field without label|Add a label or aria-label.
a11y-no-lang|warning||||WCAG 3.1.1|Page without language|Set lang on the html tag.
a11y-button-no-name|warning||||WCAG 4.1.2|Button without name|Add text or aria-label.
a11y-positive-tabindex|warning||||WCAG 2.4.3|Forced tab order|Use 0 or -1.
a11y-click-no-keyboard|warning||||WCAG 2.1.1|Click without keyboard|Use a button or add a key handler and role.
perf-n-plus-one|warning|||||Query in a loop|Fetch all records with one query.
perf-no-await-parallel|warning|||||Await in a loop|Start the calls together and await them all.
perf-db-client-per-request|warning|||||Client made per request|Share one client between requests.
command-injection|critical|CWE-78|9.8|A03:2021||Command built from strings|Pass arguments as a list.
unsafe-deserialization|critical|CWE-502|9.8|A08:2021||Unsafe deserialisation|Use a data format without code.
no-error-monitoring|info|||||No error monitoring|Report errors to a monitoring service.
template-injection|critical|CWE-1336|9.8|A03:2021||Template built from strings|Keep templates fixed and pass data.
mdx-untrusted-source|critical|CWE-1336|9.8|A03:2021||Untrusted MDX is compiled|Render untrusted text as Markdown without code.
missing-sri|warning|CWE-353|4.3|A08:2021||Remote script without integrity|Add an integrity hash.
unpinned-dependencies|warning|CWE-829|5.3|A08:2021||Any version is accepted|Name a version range.
install-script-dependency|warning|CWE-829|6.3|A08:2021||Dependency runs code at install|Review the script or allow it by name.
github-actions-injection|critical|CWE-94|9.8|A08:2021||Workflow runs outsiders' text|Pass the value through the environment.
supabase-public-bucket|warning|CWE-284|5.3|A01:2021||Public bucket|Make the bucket private and sign its addresses.
sql-injection|critical|CWE-89|9.8|A03:2021||SQL built from strings|Use parameters.
weak-hashing|warning|CWE-328|5.3|A02:2021||Weak hash|Use SHA-256 or better.
insecure-cipher|warning|CWE-327|5.9|A02:2021||Weak cipher|Use an authenticated cipher.
"""
#: The one finding kind outside the registry, from dependency checks.
SCA_RULE = "vulnerable-dependency|critical|CWE-1035|7.5|A06:2021||Vulnerable dependency|Update the dependency."
OWASP_LABELS = {
    "A01:2021": "Access control", "A02:2021": "Cryptography", "A03:2021": "Injection", "A04:2021": "Design", "A05:2021": "Configuration",
    "A06:2021": "Components", "A07:2021": "Authentication", "A08:2021": "Integrity", "A09:2021": "Logging", "A10:2021": "Server-side requests",
}


def _row(i: int, text: str) -> tuple:
    rule, severity, cwe, cvss, owasp, wcag, name, fix = [x or None for x in text.split("|")]
    return i, rule, name, severity, cwe, float(cvss) if cvss else None, owasp, wcag, fix


RULES = [_row(i, x) for i, x in enumerate(_ROWS.strip().split("\n"))]
IDS = [r[1] for r in RULES]
SEVERITY = {r[1]: r[3] for r in RULES}
ALL = [*RULES, _row(len(RULES), SCA_RULE)]
SCHEMA = "rule_ord int, rule_id string, rule_name string, default_severity string, cwe_id string, cvss_score double, owasp_category string, wcag string, fix string"


def catalog(spark: SparkSession) -> DataFrame:
    """One row per rule, in registry order; dependency findings have the last one."""
    return spark.createDataFrame(ALL, SCHEMA)


def active(include: list[str] | tuple = (), exclude: list[str] | tuple = ()) -> list[str]:
    """Rule ids to run, in registry order: the included ones (all, if none are named) without the excluded ones."""
    return [r for r in IDS if (not include or r in include) and r not in exclude]
