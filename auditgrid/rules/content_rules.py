"""Rules whose findings are matches in the whole content. Patterns and gates are fixed values."""

from __future__ import annotations

from auditgrid.rules.spec import API, CODE, TESTS, TESTS_DEPS, TESTS_DEPS_RULES, ContentRule, Pattern, has, lacks, not_path, path

RULES: tuple[ContentRule, ...] = (
    ContentRule(
        "client-only-auth",
        (path(r"\.(?:jsx|tsx|vue|svelte)$|(?:^src\/|^app\/|^pages\/(?!api\/))"),),
        (
            Pattern(r"if\s*\(\s*!(?:user|session|isAuthenticated|isLoggedIn|isAuthed|auth|currentUser)\s*\)\s*(?:return\s+(?:null|<Navigate|<Redirect)|(?:router|navigate|redirect|window\.location)\s*[\.(])", "Only the client sends visitors away"),
            Pattern(r"useEffect\s*\(\s*\(\)\s*=>\s*\{[^}]*(?:!user|!session|!auth|!isAuthenticated)[^}]*(?:router\.push|navigate|redirect|window\.location)", "An effect in the client checks the session"),
            Pattern(r"""\{(?:isAdmin|isOwner|user\.role\s*===?\s*['"`]admin['"`]|hasPermission)\s*&&\s*[(<]""", "Admin content is only hidden by the client"),
            Pattern(r"(?:ProtectedRoute|PrivateRoute|AuthGuard|RequireAuth)\s*[=:]", "A guard component works in the client only"),
        ),
    ),
    ContentRule(
        "missing-csrf",
        (path(r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/|middleware)"), not_path(TESTS))
        + lacks(r"csrf", r"xsrf", r"csurf", r"""SameSite\s*[:=]\s*['"`](?:Strict|Lax)['"`]""", r"lusca", r"""['"`]use server['"`]""", r"""(?:origin|referer)\s*(?:===|!==|==|!=)\s*(?:['"`]|allowed|expected)"""),
        (
            Pattern(r"""(?:app|router|fastify|hono)\.(post|put|patch|delete)\s*\(\s*['"`]""", "A route that changes state has no CSRF protection"),
            Pattern(r"export\s+(?:async\s+)?function\s+(?:POST|PUT|PATCH|DELETE)\s*\(", "A handler that changes state has no CSRF protection", None, ""),
        ),
    ),
    ContentRule(
        "supabase-anon-key-abuse",
        (not_path(TESTS_DEPS), has(r"supabase"), has(r"SUPABASE_ANON|supabaseClient|createClient\s*\(")) + lacks(r"service_role|SUPABASE_SERVICE_ROLE|supabaseAdmin"),
        (
            Pattern(r"\.auth\.admin\.", "The admin interface is called with the anonymous key", None, ""),
            Pattern(r"""\.rpc\s*\(\s*['"`](?:delete_user|admin_|manage_)""", "An admin function is called with the anonymous key", None, ""),
            Pattern(r"""\.from\s*\(\s*['"`]auth\.users['"`]\s*\)""", "The users table is read with the anonymous key", None, ""),
        ),
    ),
    ContentRule(
        "firebase-admin-client",
        (not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.server\.|server\/|api\/|functions\/)"),),
        (
            Pattern(r"""import\s+.*from\s+['"]firebase-admin""", "The admin SDK is used in the client", None, ""),
            Pattern(r"""require\s*\(\s*['"]firebase-admin""", "The admin SDK is used in the client", None, ""),
            Pattern(r"admin\.initializeApp", "The admin SDK is used in the client", None, ""),
            Pattern(r"admin\.firestore\(\)", "The admin SDK is used in the client", None, ""),
            Pattern(r"admin\.auth\(\)", "The admin SDK is used in the client", None, ""),
            Pattern(r"getFirestore\s*\(\s*adminApp", "The admin SDK is used in the client", None, ""),
        ),
        ("//", "*"),
        any_gate=(path(r"(?:src\/|app\/(?!api)|pages\/(?!api)|components\/|hooks\/|lib\/client|utils\/client).*\.(js|ts|jsx|tsx)$"), has(r"""['"]use client['"]|import\s+.*from\s+['"]react['"]|useState|useEffect|onClick""", "")),
    ),
    ContentRule(
        "ai-response-trusted",
        (not_path(TESTS_DEPS), has(r"(?:openai|anthropic|generateText|streamText|completion|aiResponse)")),
        (
            Pattern(r"eval\s*\(\s*(?:response|result|completion|aiResponse|output|generated|content)", "A model's output is evaluated", None, ""),
            Pattern(r"innerHTML\s*=\s*(?:response|result|completion|aiResponse|output|generated|content)", "A model's output becomes markup", None, ""),
            Pattern(r"""(?:query|execute|exec)\s*\(\s*(?:`[^`]*\$\{(?:response|result|completion|aiResponse|output|generated)|['"][^'"]*['"]\s*\+\s*(?:response|result|completion|aiResponse|output|generated))""", "A model's output is part of a query", None, ""),
            Pattern(r"dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*(?:response|result|completion|aiResponse|output|generated|content)", "A model's output is set as HTML", None, ""),
            Pattern(r"new\s+Function\s*\(\s*(?:response|result|completion|aiResponse|output|generated)", "A model's output becomes a function", None, ""),
        ),
    ),
    ContentRule(
        "ai-cost-exposure",
        (not_path(TESTS_DEPS), path(API)),
        (
            Pattern(r"(?:openai|client)\.chat\.completions\.create\s*\(\s*\{", "A model call has no token limit", None, ""),
            Pattern(r"anthropic\.messages\.create\s*\(\s*\{", "A model call has no token limit", None, ""),
            Pattern(r"\.completions\.create\s*\(\s*\{", "A model call has no token limit", None, ""),
        ),
        window=(0, 500, False, r"max_tokens|maxTokens|max_completion_tokens", "i", False),
    ),
    ContentRule(
        "payment-amount-client",
        (not_path(TESTS_DEPS), path(API), has(r"(?:amount|price|payment|stripe|charge)")),
        (
            Pattern(r"amount\s*:\s*(?:req\.body|request\.body|body)\.\w*(?:amount|price|total|cost)", "A payment's amount comes from the request body"),
            Pattern(r"unit_amount\s*:\s*(?:req\.body|request\.body|body|req\.query|req\.params)\.\w*(?:amount|price|total|cost)", "A unit amount comes from the request"),
            Pattern(r"unit_amount\s*:\s*(?:req\.body|request\.body|body|req\.query|req\.params)\.(?:amount|price|total|cost)", "A unit amount is the request's own"),
            Pattern(r"(?:paymentIntents|charges|checkout\.sessions)\.create\s*\(\s*\{[\s\S]{0,200}amount\s*:\s*(?:req|request|body)\.", "A payment is created with the client's amount"),
            Pattern(r"amount\s*[:=]\s*(?:parseInt|Number|parseFloat)\s*\(\s*(?:req\.(?:body|query|params)|request\.(?:body|query))\.", "An amount is parsed from the request"),
        ),
    ),
    ContentRule(
        "missing-data-encryption",
        (not_path(TESTS_DEPS),),
        (
            Pattern(r"\.create\s*\(\s*\{[\s\S]{0,500}(?:ssn|socialSecurity|creditCard|cardNumber|taxId|bankAccount)", "Sensitive data is stored unencrypted"),
            Pattern(r"\.insert\s*\(\s*\{[\s\S]{0,500}(?:ssn|socialSecurity|creditCard|cardNumber|taxId|bankAccount)", "Sensitive data is stored unencrypted"),
            Pattern(r"\.update\s*\(\s*\{[\s\S]{0,500}(?:ssn|socialSecurity|creditCard|cardNumber|taxId|bankAccount)", "Sensitive data is stored unencrypted"),
            Pattern(r"(?:INSERT|UPDATE)\s+.*(?:ssn|social_security|credit_card|card_number|tax_id|bank_account)", "Sensitive data is stored unencrypted"),
        ),
        window=(300, 300, True, r"encrypt|cipher|crypto\.create|aes|bcrypt|hash", "i", False),
    ),
    ContentRule(
        "mfa-bypass",
        (not_path(TESTS_DEPS_RULES), has(r"(?:mfa|2fa|two.?factor|totp|otp|authenticator)")),
        (Pattern(r"(?:if\s*\(\s*(?:user\.)?(?:mfaEnabled|twoFactorEnabled|has2FA|hasMFA|requires2FA))", "A second factor's else branch lets users in"),),
        window=(0, 500, False, r"else\s*\{[\s\S]{0,200}(?:redirect|navigate|return|token|session|login)", "i", True),
    ),
    ContentRule(
        "auth-token-no-expiry",
        (not_path(TESTS_DEPS_RULES),),
        (Pattern(r"jwt\.sign\s*\(", "A token is issued without expiry", None, ""),),
        window=(0, 400, False, r"expiresIn|expires_in|exp\s*:", "i", False),
    ),
    ContentRule(
        "race-condition",
        (not_path(TESTS_DEPS), path(API)) + lacks(r"\$inc|\$set.*\$where|transaction|FOR UPDATE|SERIALIZABLE|atomicUpdate|compareAndSwap"),
        (
            Pattern(r"(?:balance|stock|inventory|quantity|count|seats|tickets)\s*[<>=!]+[\s\S]{0,200}(?:update|decrement|subtract|reduce|\-=)", "A balance is checked and then changed without a lock"),
            Pattern(r"(?:findOne|findUnique|findFirst|find\()[\s\S]{0,300}(?:\.create\(|\.insert\(|\.save\()", "A record is looked up and then created without a lock"),
        ),
        window=(200, 200, True, r"transaction|\.lock\(|mutex|semaphore|FOR UPDATE", "i", False),
    ),
    ContentRule(
        "nosql-injection",
        (not_path(TESTS_DEPS), has(r"(?:mongo|mongoose|\.find|\.findOne|\$where)")),
        (
            Pattern(r"\$where\s*:\s*(?:req\.|request\.|body\.|params\.|query\.)", "User input runs as a $where expression"),
            Pattern(r"\.find\s*\(\s*(?:req\.body|req\.query|request\.body)", "A request is passed to find as it is"),
            Pattern(r"\.findOne\s*\(\s*(?:req\.body|req\.query|request\.body)", "A request is passed to findOne as it is"),
            Pattern(r"\.deleteMany\s*\(\s*(?:req\.body|req\.query|request\.body)", "A request is passed to deleteMany as it is"),
            Pattern(r"\.updateMany\s*\(\s*(?:req\.body|req\.query|request\.body)", "A request is passed to updateMany as it is"),
        ),
    ),
    ContentRule(
        "xml-xxe",
        (not_path(TESTS_DEPS_RULES), has(r"(?:xml|parseXml|DOMParser|xml2js|expat|sax)")),
        (
            Pattern(r"parseXml\s*\([\s\S]{0,200}noent\s*:\s*true", "External entities are resolved"),
            Pattern(r"xml2js.*Parser|parseString", "An XML parser's entity settings need a look"),
            Pattern(r"new\s+DOMParser\s*\(\s*\)[\s\S]{0,200}(?:req\.|request\.|body\.|input)", "Users' XML is parsed"),
            Pattern(r"(?:require|import).*(?:node-expat|sax|fast-xml-parser)", "An XML parser is imported"),
        ),
        ("//", "*"),
    ),
    ContentRule(
        "ldap-injection",
        (not_path(TESTS_DEPS), has(r"(?:ldap|ldapjs|activedirectory)")),
        (
            Pattern(r"""(?:filter|searchFilter|ldapFilter)\s*[:=]\s*[`'"]\s*\([\s\S]{0,100}\$\{(?:req\.|request\.|body\.|params\.|query\.|input|user)""", "User input is part of a directory filter"),
            Pattern(r"""(?:filter|searchFilter)\s*[:=]\s*['"].*['"]\s*\+\s*(?:req\.|request\.|body\.|params\.|query\.|input|user)""", "User input is joined to a directory filter"),
            Pattern(r"\.search\s*\(\s*(?:req\.body|req\.query|req\.params)", "A request names the directory's base"),
        ),
    ),
    ContentRule(
        "header-injection",
        (not_path(TESTS_DEPS),),
        (
            Pattern(r"""(?:res|response)\.(?:setHeader|header|set)\s*\(\s*['"][^'"]+['"]\s*,\s*(?:req\.|request\.|body\.|params\.|query\.)""", "User input is a header's value"),
            Pattern(r"(?:res|response)\.redirect\s*\(\s*(?:req\.|request\.|body\.|params\.|query\.)", "User input is a redirect's target"),
            Pattern(r"Set-Cookie.*(?:req\.|request\.|body\.|params\.|query\.)", "User input is part of a cookie header"),
        ),
    ),
    ContentRule(
        "subdomain-takeover",
        (not_path(TESTS_DEPS),),
        tuple(
            Pattern(host, "A host that can lapse is referred to: {0}")
            for host in (
                r"\.s3\.amazonaws\.com", r"\.s3-website[.-]", r"\.herokuapp\.com", r"\.ghost\.io", r"\.myshopify\.com", r"\.surge\.sh", r"\.bitbucket\.io", r"\.pantheonsite\.io",
                r"\.zendesk\.com", r"\.teamwork\.com", r"\.helpjuice\.com", r"\.helpscoutdocs\.com", r"\.feedpress\.me", r"\.freshdesk\.com", r"\.unbounce\.com", r"\.tictail\.com",
            )
        ),
        any_gate=(path(r"(?:dns|domain|cname|route53|cloudflare)"), path(r"(?:\.json|\.yaml|\.yml|\.toml|\.tf)$")),
        group=0,
    ),
    ContentRule(
        "hardcoded-ip",
        (not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.d\.ts$|\.lock$)"), not_path(r"src\/rules\/")),
        (Pattern(r"""['"`](?:https?:\/\/)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?['"`]""", "An IP address is in the source: {0}", None, ""),),
        ("//", "*", "#"),
        group=1,
        match_unless=(r"^(?:127\.0\.0\.1|0\.0\.0\.0|255\.255\.255\.\d+|192\.168\.\d+\.\d+|10\.\d+\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+)$", ""),
    ),
    ContentRule(
        "a11y-positive-tabindex",
        (not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.stories\.)"), path(r"\.(?:html?|jsx|tsx|vue|svelte|astro)$")),
        (Pattern(r"""\btab[Ii]ndex\s*=\s*["'{]?\s*(\d+)""", "A positive tabindex of {0} breaks the tab order", None, ""),),
        group=1,
        match_unless=(r"^0+$", ""),
    ),
    ContentRule(
        "supabase-public-bucket",
        (not_path(TESTS_DEPS), path(CODE)),
        (Pattern(r"\b(?:create|update)Bucket\s*\(", "A storage bucket is public", None, ""),),
        window=(0, 200, False, r"""['"]?public['"]?\s*:\s*true""", "", True),
        once_a_line=True,
    ),
    # Documented contract only; the pattern is our own.
    ContentRule(
        "cors-credentials",
        (not_path(TESTS),),
        (Pattern(r"""cors\s*\(\s*\{[^}]*(?:origin\s*:\s*(?:true|['"`](?:\*|https?:\/\/localhost[^'"`]*)['"`]|req\.)[^}]*credentials\s*:\s*true|credentials\s*:\s*true[^}]*origin\s*:\s*(?:true|['"`](?:\*|https?:\/\/localhost[^'"`]*)['"`]|req\.))""", "Credentials are allowed for a loose origin"),),
        ("//", "*"),
    ),
)
