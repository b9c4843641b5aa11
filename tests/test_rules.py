"""Every rule on the corpus' snippets: what it must find, and by omission what it must not."""

from collections import Counter

import pytest

from auditgrid.operators import audit
from auditgrid.plans.corpus import SNIPPETS
from auditgrid.rules import catalog
from auditgrid.schema import FILES_DDL

EXPECTED = """
exposed-secrets src/components/Pay.jsx:1 src/lib/keys.js:1 src/lib/keys.js:2 src/lib/keys.js:4 src/lib/keys.js:5
hardcoded-credentials src/lib/creds.py:1 src/lib/creds.py:3 src/lib/creds.py:4
exposed-env-vars .env:1 .env:1 .env:2 .env:2 .env:2 src/components/Admin.jsx:2 src/components/Pay.jsx:2 src/components/Pay.jsx:2
open-database-rules firestore.rules:3 firestore.rules:3 firestore.rules:4
missing-auth app/api/admin/users/route.ts:1 app/api/open/route.ts:2 pages/api/hello.js:1 pages/api/method.js:1 src/api/auth/login.ts:1 src/api/errors.js:1 src/api/items.js:1 src/api/items.js:2 src/api/items.js:3 src/api/items2.js:2 src/api/register.js:8 src/api/stripe.js:1 src/api/stripe2.js:1
no-input-validation src/ai/run.js:2 src/ai/run.js:3 src/ai/run.js:4 src/lib/headers.js:2 src/lib/html.js:1 src/lib/html.js:4 src/lib/html.js:5 src/lib/run.js:1 src/lib/run.js:3 src/lib/run.js:4 src/routes/go.js:1 src/routes/go2.js:1
insecure-error-handling src/api/errors.js:3 src/api/errors.js:4 src/components/Broken.jsx:1 src/components/Broken.jsx:2
missing-security-headers middleware.ts:1 netlify.toml:1 src/middleware.ts:1 vercel.json:1 vite.config.ts:1
missing-rate-limiting src/api/auth/login.ts:1 src/api/chat.js:1 src/api/pay.js:1 src/api/register.js:1 src/api/stripe.js:1 src/api/stripe2.js:1
insecure-connections src/lib/http.js:1 src/lib/http.js:3 src/lib/http.js:4 src/lib/http.js:5 src/lib/http.js:6 src/lib/net.js:2
client-side-db-access src/components/List.tsx:2 src/components/List.tsx:3 src/components/List.tsx:4
client-bundle-secrets src/components/Pay.jsx:1 src/components/Pay.jsx:2
client-only-auth src/pages/Home.jsx:1 src/pages/Home.jsx:2 src/pages/Home.jsx:3
sensitive-browser-storage src/state/store.js:1 src/state/store.js:2 src/state/store.js:3
console-data-leak src/lib/log.js:1 src/lib/log.js:2 src/lib/log.js:3
source-maps-exposed vite.config.ts:1 vite.config.ts:1 vite.config.ts:2 vite.config.ts:3
client-side-trust src/components/Cart.tsx:1 src/components/Cart.tsx:2 src/components/Cart.tsx:3 src/components/Cart.tsx:4
api-data-overfetch src/api/find.js:2 src/api/page.js:1 src/api/user.js:3 src/api/user.js:7
idor-vulnerability src/api/user.js:2
missing-csrf app/api/admin/users/route.ts:4 src/api/auth/login.ts:1 src/api/items.js:1 src/api/items.js:2 src/api/register.js:8 src/api/stripe.js:1 src/api/stripe2.js:1 src/api/webhook.ts:1
unsafe-file-upload src/api/upload.js:1
mass-assignment src/api/create.js:2
unverified-webhook src/api/stripe.js:3 src/api/webhook.ts:1
no-pagination app/api/admin/users/route.ts:2 src/api/find.js:1 src/api/find.js:3 src/api/user.js:3 src/api/user.js:7 src/server/list.ts:1 src/server/list.ts:1
path-traversal src/api/file.js:2
insecure-jwt src/lib/token.js:1 src/lib/token.js:2 src/lib/token.js:3 src/lib/token.js:3
plaintext-passwords src/api/register.js:2
insecure-randomness src/auth/reset.js:2 src/lib/random.js:1 src/lib/random.js:2
insecure-cookies src/server/cookie.js:1 src/server/cookie.js:2
ssrf-vulnerability src/api/proxy.js:2
prototype-pollution src/lib/merge.js:1 src/lib/merge.js:2 src/lib/merge.js:3 src/lib/merge.js:4
missing-gitignore .gitignore:1 .gitignore:1 .gitignore:1 .gitignore:1 .gitignore:1
timing-attack src/lib/verify.js:1 src/lib/verify.js:2 src/lib/verify.js:3
cors-credentials server.js:1
no-account-lockout src/api/auth/login.ts:1
unsafe-redirect src/routes/go.js:1 src/routes/go.js:2 src/routes/go.js:3
no-bot-protection src/api/auth/login.ts:1 src/api/register.js:8
predictable-ids prisma/model.js:1 prisma/model.js:2 prisma/model.js:3 prisma/model.js:4
debug-mode-exposed config/settings.py:1 config/settings.py:2 config/settings.py:3 src/graphql/server.ts:2
secrets-in-urls src/lib/call.js:1
nextjs-server-action-exposure src/app/actions.ts:2
nextjs-middleware-bypass middleware.ts:1 middleware.ts:3
nextjs-api-route-no-method-check pages/api/hello.js:1
supabase-missing-rls src/lib/rpc.js:2 supabase/migrations/1.sql:1 supabase/migrations/1.sql:1
supabase-service-key-client src/components/Admin.jsx:1 src/components/Admin.jsx:2 src/lib/admin.js:1
supabase-anon-key-abuse src/lib/anon.js:2 src/lib/anon.js:3 src/lib/anon.js:4
firebase-admin-client src/hooks/useDb.js:1 src/hooks/useDb.js:2 src/hooks/useDb.js:3
vercel-env-leak .env:1 .env:2 src/components/Admin.jsx:2 src/components/Pay.jsx:2 src/lib/admin.js:1
netlify-redirect-open site/_redirects:1 site/_redirects:2
deployment-config-insecure netlify.toml:1 vercel.json:1
ai-prompt-injection src/ai/prompt.js:1 src/ai/prompt2.js:1
ai-response-trusted src/ai/run.js:2 src/ai/run.js:3 src/ai/run.js:4
ai-cost-exposure src/api/chat.js:1 src/api/chat.js:1
stripe-webhook-no-verify src/api/stripe.js:3
payment-amount-client src/api/pay.js:1 src/api/pay.js:1 src/api/pay.js:2 src/api/pay.js:3 src/api/pay.js:3 src/api/pay.js:3
pii-logging src/lib/log.js:4
missing-data-encryption src/lib/people.js:1
graphql-introspection src/graphql/dev.ts:2 src/graphql/server.ts:2
graphql-depth-limit src/graphql/server.ts:1
graphql-no-auth src/graphql/server.ts:5
session-fixation src/auth/login.js:1 src/auth/login.js:2
oauth-state-missing src/auth/oauth.js:1
password-reset-weak src/auth/reset.js:2 src/auth/reset.js:2
mfa-bypass src/lib/mfa.js:1 src/lib/mfa.js:2
auth-token-no-expiry src/lib/token.js:1 src/lib/token.js:3
race-condition src/api/buy.js:1 src/api/buy.js:2
nosql-injection src/lib/mongo.js:1 src/lib/mongo.js:2 src/lib/mongo.js:3 src/lib/mongo.js:4
xml-xxe src/lib/xml.js:1 src/lib/xml.js:2 src/lib/xml.js:4
ldap-injection src/lib/ldap.js:1 src/lib/ldap.js:2
header-injection src/lib/headers.js:1 src/lib/headers.js:2 src/lib/html.js:5 src/routes/go.js:1 src/routes/go2.js:1
subdomain-takeover infra/dns.yaml:1 infra/dns.yaml:2 infra/dns.yaml:3 infra/dns.yaml:3
clickjacking server.js:3 src/app.js:1
dangerously-set-inner-html src/components/Html.tsx:1 src/components/Html.tsx:2
eval-usage src/ai/run.js:2 src/ai/run.js:4 src/lib/run.js:1 src/lib/run.js:3
regex-dos src/lib/regex.js:1 src/lib/regex.js:2
hardcoded-ip src/lib/net.js:1 src/lib/net.js:2
high-entropy-strings src/lib/secrets.ts:1
docker-root-user Dockerfile:4 deploy/Dockerfile:1
exposed-database-port docker-compose.yml:4 docker-compose.yml:5
serverless-fs-write src/api/save/route.ts:2 src/api/save/route.ts:4
a11y-img-no-alt src/components/Card.tsx:5 src/pages/index.html:2
a11y-form-no-label src/pages/index.html:4
a11y-no-lang src/pages/index.html:1
a11y-button-no-name src/pages/index.html:6
a11y-positive-tabindex src/components/Tabs.jsx:1 src/components/Tabs.jsx:3
a11y-click-no-keyboard src/components/Card.tsx:1
perf-n-plus-one src/lib/loop.js:3 src/lib/loop.js:5
perf-no-await-parallel src/lib/loop.js:3
perf-db-client-per-request src/lib/client.js:2
command-injection src/lib/run.js:4 src/lib/run.js:6
unsafe-deserialization src/lib/vm.js:1 src/lib/vm.js:2
no-error-monitoring package.json:1
template-injection src/lib/run.js:7
mdx-untrusted-source src/lib/mdx.tsx:3 src/lib/mdx.tsx:4
missing-sri src/pages/index.html:8 src/pages/index.html:9
unpinned-dependencies package.json:3 package.json:4 package.json:7
install-script-dependency package-lock.json:1 package-lock.json:1
github-actions-injection .github/workflows/ci.yml:4 .github/workflows/ci.yml:6
supabase-public-bucket src/lib/bucket.ts:1
sql-injection src/db/query.js:1 src/db/query.js:3
weak-hashing src/lib/hash.js:2 src/lib/hash2.ts:2 src/lib/hash2.ts:4 src/lib/hash2.ts:5 src/lib/hash2.ts:6
insecure-cipher src/lib/cipher.js:1 src/lib/cipher.js:2 src/lib/cipher.js:4
"""
BY_RULE = {x.split()[0]: x.split()[1:] for x in EXPECTED.strip().split("\n")}


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([(i, f"r{i}", p, c) for i, (p, c) in enumerate(SNIPPETS)], FILES_DDL).repartition(3)
    return audit.run_rules(files, catalog.IDS).collect()


def test_every_rule_has_an_expectation():
    assert set(BY_RULE) == set(catalog.IDS) - {audit.HISTORY_RULE}


@pytest.mark.parametrize("rule", sorted(BY_RULE))
def test_rule(rows, rule):
    got = Counter(f"{r.relative_path}:{r.line}" for r in rows if r.rule_id == rule)
    assert got == Counter(BY_RULE[rule])


def test_findings_are_well_formed(rows):
    assert {r.severity for r in rows} == {"critical", "warning", "info"}
    assert all(r.message and (r.evidence is None or r.rule_id == "open-database-rules" or len(r.evidence) <= 200) for r in rows)
    secrets = [r.evidence for r in rows if r.rule_id == "high-entropy-strings"]
    assert secrets == ['apiKey = "Zx81...2Nc7"']
    assert all("'secret'" not in r.evidence for r in rows if r.rule_id == "insecure-jwt" and r.severity == "critical" and r.evidence)


def test_registry():
    assert len(catalog.RULES) == len(set(catalog.IDS)) == 103
    assert all(0 <= r[5] <= 10 for r in catalog.RULES if r[5] is not None)
    assert all(r[6] in catalog.OWASP_LABELS for r in catalog.RULES if r[6])
    assert catalog.active(["eval-usage", "weak-hashing"], ["weak-hashing"]) == ["eval-usage"]
    assert len(catalog.active()) == 103
