"""Rules with at most one finding a branch for each file. Patterns and gates are fixed values."""

from __future__ import annotations

from auditgrid.rules.spec import TESTS_DEPS, TESTS_DEPS_RULES, FileBranch, FileRule, Test, has, lacks, not_path, path

LOGOUT = r"(?:logout|signOut|sign_out|logOut|log_out)\s*(?:=|:|\()"
GRAPHQL_SETUP = r"(?:ApolloServer|createYoga|mercurius|makeExecutableSchema|buildSchema|new\s+GraphQLSchema)"
OAUTH = r"(?:accounts\.google\.com|github\.com|facebook\.com|login\.microsoftonline).*(?:\/authorize|\/oauth)|(?:authorization_endpoint|authorize_url|authorizationUrl|auth_url)|\/oauth\/authorize|response_type=code"

RULES: tuple[FileRule, ...] = (
    FileRule(
        "nextjs-api-route-no-method-check",
        (not_path(TESTS_DEPS), path(r"pages\/api\/")),
        (
            FileBranch(
                (has(r"export\s+default\s+(?:async\s+)?function"), *lacks(r"""req\.method\s*[!=]==?\s*['"`]|switch\s*\(\s*req\.method\s*\)|method\s*===?\s*['"`](?:GET|POST|PUT|PATCH|DELETE)""")),
                "A route answers all methods alike", line=(r"export\s+default", ""),
            ),
        ),
    ),
    FileRule(
        "deployment-config-insecure",
        (not_path(TESTS_DEPS), path(r"(?:vercel\.json|netlify\.toml|firebase\.json|fly\.toml)$")),
        (
            FileBranch((path(r"vercel\.json"), *lacks(r"headers")), "The deployment sets no security headers"),
            FileBranch((path(r"vercel\.json"), has(r"Access-Control-Allow-Origin.*\*")), "The deployment lets any site call the API", line=(r"Access-Control-Allow-Origin.*\*", "")),
            FileBranch((path(r"netlify\.toml"), *lacks(r"X-Frame-Options", r"Content-Security-Policy")), "The deployment sets no security headers"),
        ),
    ),
    FileRule(
        "stripe-webhook-no-verify",
        (
            not_path(TESTS_DEPS_RULES), path(r"\.(?:[cm]?[jt]sx?|py|rb|go|php)$"),
            has(r"\breq(?:uest)?\s*\.\s*(?:body|headers|method|text|json|rawBody)|\bres\s*\.\s*(?:status|json|send|end)|export\s+(?:async\s+)?function\s+(?:POST|PUT|PATCH)|export\s+const\s+(?:POST|PUT|PATCH)\s*=|\b(?:app|router)\s*\.\s*(?:post|use)\s*\(|export\s+default\s+(?:async\s+)?function|def\s+\w*webhook\w*\s*\("),
            *lacks(r"constructEvent|webhooks\.construct|construct_event|verify_header|Webhook\.constructEvent"),
        ),
        (
            FileBranch((has(r"""['"`]stripe-signature['"`]|STRIPE_WEBHOOK_SECRET"""),), "A payment webhook isn't verified", line=(r"event\.type|checkout\.session|payment_intent|stripe-signature", "i")),
            FileBranch(
                (*lacks(r"""['"`]stripe-signature['"`]|STRIPE_WEBHOOK_SECRET"""), has(r"\b(?:event|evt)\s*\.\s*type\b", ""), has(r"(?:checkout\.session|payment_intent|invoice\.[a-z_]+|customer\.subscription|charge\.[a-z_]+|payout\.[a-z_]+|setup_intent)")),
                "A payment webhook isn't verified", line=(r"event\.type|checkout\.session|payment_intent|stripe-signature", "i"),
            ),
        ),
    ),
    FileRule(
        "graphql-depth-limit",
        (not_path(TESTS_DEPS_RULES), has(GRAPHQL_SETUP)) + lacks(r"depthLimit|depth[_-]?limit|maxDepth|queryDepth|graphql-depth-limit", r"complexityLimit|query[_-]?complexity|costAnalysis|maxComplexity"),
        (FileBranch((), "Queries have no limit of depth or cost", line=(GRAPHQL_SETUP, "i")),),
    ),
    FileRule(
        "graphql-no-auth",
        (not_path(TESTS_DEPS), has(r"(?:graphql|resolver|Query|Mutation)"), has(r"(?:Query|Mutation)\s*:\s*\{|(?:resolvers)\s*[:=]\s*\{", ""))
        + lacks(r"(?:getServerSession|getSession|auth\(\)|requireAuth|isAuthenticated|authenticate|withAuth|getToken|verifyToken|currentUser|getUser|context\.user|ctx\.user|context\.auth|ctx\.auth|jwt\.verify|verifyIdToken)"),
        (FileBranch((), "Resolvers check no user", line=(r"(?:Query|Mutation)\s*:\s*\{", "")),),
    ),
    FileRule(
        "session-fixation",
        (not_path(TESTS_DEPS),),
        (
            FileBranch(
                (has(r"(?:login|signIn|sign_in|authenticate)\s*(?:=|:|\()"), has(r"(?:req\.session\.\w+\s*=|session\.\w+\s*=)"), *lacks(r"(?:regenerate|rotateSession|req\.session\.regenerate|session\.regenerate)")),
                "A login keeps the session's id", line=(r"(?:req\.session\.\w+\s*=|session\.\w+\s*=)", ""),
            ),
            FileBranch(
                (has(LOGOUT), *lacks(r"(?:session\.destroy|req\.session\.destroy|req\.logout|token.*(?:blacklist|revoke|delete|invalidate)|(?:blacklist|revoke|delete|invalidate).*token|\.delete\s*\(.*session|removeSession)")),
                "A logout leaves the session alive", line=(LOGOUT, "i"),
            ),
        ),
        (path(r"(?:auth|login|signin|sign-in|logout|signout|sign-out|session|passport)"), has(r"(?:auth|login|signin|sign-in|logout|signout|sign-out|session|passport)")),
    ),
    FileRule(
        "oauth-state-missing",
        (not_path(TESTS_DEPS), has(OAUTH)) + lacks(r"[&?]state=|state\s*[:=]", r"(?:next-auth|NextAuth|passport|@auth\/|authjs|lucia|arctic|oslo)"),
        (FileBranch((), "An OAuth flow carries no state", line=(r"(?:authorize|oauth|response_type)", "i")),),
    ),
    FileRule(
        "password-reset-weak",
        (not_path(TESTS_DEPS_RULES),),
        (
            FileBranch((has(r"(?:reset|token|code).*Math\.random|Math\.random.*(?:reset|token|code)"),), "A reset token can be guessed", line=(r"Math\.random", "")),
            FileBranch(
                (has(r"(?:forgotPassword|resetPassword|password.?reset|forgot.?password)\s*(?:=|:|\()|\/(?:reset|forgot)"), has(r"(?:resetToken|reset_token)\s*[:=]|save.*(?:resetToken|reset_token)|\.update.*(?:resetToken|reset_token)"), *lacks(r"(?:expir|ttl|validUntil|expiresAt|expires_at|Date\.now.*reset|resetExpiry|token.*expir)")),
                "A reset token never expires", line=(r"(?:resetToken|reset_token|passwordReset)", "i"),
            ),
        ),
        (path(r"(?:reset|forgot|password|recover)"), has(r"(?:reset|forgot|password|recover)")),
    ),
    FileRule(
        "mfa-bypass",
        (not_path(TESTS_DEPS_RULES), has(r"(?:mfa|2fa|two.?factor|totp|otp|authenticator)")),
        (FileBranch((has(r"verify.*(?:otp|totp|mfa|2fa)"), *lacks(r"(?:mfaSession|pendingMfa|mfaPending|awaitingMfa|mfaToken)")), "A second factor isn't tied to its login", line=(r"verify.*(?:otp|totp|mfa|2fa)", "i")),),
    ),
    FileRule(
        "clickjacking",
        (not_path(TESTS_DEPS), path(r"(?:next\.config\.(js|ts|mjs)|server\.(js|ts)|app\.(js|ts)|vercel\.json|netlify\.toml|express|middleware)"), has(r"(?:headers|setHeader|Content-Security-Policy|X-Content-Type)")) + lacks(r"X-Frame-Options|frame-ancestors", r"helmet\s*\("),
        (FileBranch((), "Headers are set, but pages can be framed", line=(r"headers|setHeader", "i")),),
    ),
    FileRule(
        "nextjs-middleware-bypass",
        (not_path(TESTS_DEPS), path(r"middleware\.(js|ts|jsx|tsx)$")),
        (
            FileBranch(
                lacks(r"(?:getToken|getSession|auth\(\)|NextResponse\.redirect.*login|NextResponse\.redirect.*sign-in)") + (Test(r"\b(?:clerkMiddleware|authMiddleware|withClerkMiddleware|withAuth|NextAuth|updateSession|createMiddlewareClient|createServerClient)\s*\(", "", "content", False),),
                "The middleware checks no user",
            ),
        ),
    ),
)
