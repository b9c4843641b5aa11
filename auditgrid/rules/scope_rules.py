"""Rules about functions, loops and calls of script files. Patterns and gates are fixed values.

``hits`` and ``has`` follow the documented semantics on code without comments; the function's whole
code counts, nested functions included.
"""

from __future__ import annotations

from auditgrid.functions.fileclass import PUBLIC_ROUTE
from auditgrid.rules.spec import API, CODE, TESTS_DEPS, TESTS_DEPS_RULES, TESTS_RULES, CodeRule, FileBranch, FileRule, LineRule, Pattern, ScopeRule, Test, has, lacks, not_path, path

CONTROLLERS = r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/|controllers\/)"
UPLOADS = r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/|middleware|upload)"
FILES = r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/|controllers\/|middleware)"
WORKERS = r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/|controllers\/|middleware|workers\/)"
AUTH_PATHS = r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/|controllers\/|auth|user|account|register|signup|login)"
AUTH_SKIP = r"(?:\.test\.|\.spec\.|__tests__|fixtures\/|src\/rules\/)"
DEMO = r"(?:demo|test|debug|sandbox)"
METHODS = r"^(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$"
HANDLER = r"export\s+(?:(?:async\s+)?function|const)\s+(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
AUTH_WORDS = (
    r"(?:getServerSession|getSession|auth\(\)|getAuth|verifyIdToken|requireAuth|isAuthenticated|authenticate|withAuth|authMiddleware|getToken|verifyToken|clerkClient|currentUser|getUser)",
    r"require\w*auth\w*", r"\.use\(\s*[^)]*(?:auth|protect|guard|session)", r"(?:protect|guard|ensureAuth|checkAuth|authorize)\w*\s*\(", r"request\.auth", r"req\.user",
    r"session\.\s*user", r"(?:Authorization|Bearer)\s*.*header", r"middleware.*auth", r"(?:jwt|token)\.verify", r"admin\.auth\(\)",
)
#: Calls that check a user, and words in the names of imported or local functions that do.
AUTH_GUARD = r"(?:get(?:Server)?Session|require\w*[Aa]uth\w*|requireUser\w*|requireSession\w*|requireAdmin\w*|isAuthenticated|authenticate\w*|withAuth\w*|currentUser|getUser\b|getToken\b|verify(?:Id)?Token|verify\w*[Aa]uth\w*|check\w*[Aa]uth\w*|ensure\w*[Aa]uth\w*|ensureUser\w*|ensureSession\w*|assert\w*[Aa]uth\w*|assertUser\w*|protect\w*|authGuard\w*|authorize\w*|clerkClient|getAuth\b|auth\b)"
GUARD_HINT = r"(?:auth|session|guard|protect|require|ensure|verify|access|permission|identity|clerk|token|currentuser|getuser)"
GUARD_MEMBER = r"\b(?:req|request|session|ctx|context|locals)\??\.(?:user|auth|userId|session|currentUser)\b"

REQUEST_ID = r"\b(?:params|query|searchParams)\??\.\w*(?:id|Id|ID)\b|\.(?:params|query|body)\??\.\w*(?:id|Id|ID)\b"
OWNER = (
    (r"\b(?:session|auth|currentUser)\b[\w.?]*\.(?:id|uid|userId|sub)\b\s*[!=]==?", ""), (r"[!=]==?\s*(?:session|auth|currentUser)\b[\w.?]*\.(?:id|uid|userId|sub)\b", ""),
    (r"\b(?:authorize|checkOwnership|isOwner|canAccess|hasAccess|checkPermission|verifyOwnership)\s*\(", "i"), (r"\b(?:userId|user_id|ownerId|owner_id|createdBy)\s*:", ""),
)
RAW_BODY = r"\b(?:req\.body|request\.body|body)\b"
DB_OBJECT = r"(?:\b(?:prisma|db|knex|mongoose|supabase|docRef|collectionRef|Model)\b|\.(?:collection|doc|from|table|model)\b)"
BODY_CALL = (
    (r"Object\.assign\s*\([^,()]+,\s*(?:req\.body|request\.body|body)\s*[,)]", ""),
    (DB_OBJECT + r"[^;{}]{0,200}?\.(?:create|set|add|insert|insertMany|updateOne|updateMany|findOneAndUpdate|findByIdAndUpdate)\s*\([^;]{0,300}?" + RAW_BODY + r"(?!\.)", ""),
)
BODY_CHECK = ((r"(?:const|let|var)\s*\{[^}]*\}\s*=\s*(?:req\.body|request\.body|body)\b", ""), (r"(?:const|let|var)\s*\{[^}]*\}\s*=\s*await\s+[\w.]+\.json\s*\(", ""), (r"\b(?:parse|validate|safeParse|validateSync)\s*\(", "i"))
UPLOAD = r"\b(?:formData|form|fileData)\.get\s*\(\s*['\"](?:file|image|upload|attachment|document|avatar|photo|video|media)|\b(?:multer|formidable|busboy)\s*\(|\.(?:single|array|fields)\s*\(|\breq\.files?\b"
TYPE_CHECK = r"\.(?:type|mimetype|mimeType|contentType)\b|\b(?:allowedTypes|allowedExtensions|ALLOWED_TYPES|fileFilter)\b"
SIZE_CHECK = r"\.(?:size|fileSize|maxSize)\b|\b(?:MAX_SIZE|maxSize|sizeLimit|MAX_FILE_SIZE)\b|\b(?:limits|fileSize|fieldSize)\s*:"
PROCESSING = r"\b(?:sharp|jimp|resize|toBuffer)\s*\("
FS_CALL = r"\b(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|sendFile|download|access|accessSync|stat|statSync|unlink|unlinkSync)\s*\([^;]{0,200}?(?:\b(?:params|query|searchParams)\.|\.(?:params|query|body)\.)"
SANITISER = r"\b(?:basename|normalize)\s*\(|\.startsWith\s*\("
FETCH = r"\b(?:fetch|got|axios|request|undici|(?:axios|got|http|https)\.(?:get|post|put|patch|delete|request))\s*\(\s*[^;,]{0,120}?(?:\b(?:body|params|query|data|input|payload)|\.(?:body|query|params))\.\w*(?:url|link|href|src|endpoint|target|destination|webhook)\w*"
HOST_CHECK = r"\b(?:allowedHosts|allowed_hosts|allowedDomains|allowlist|whitelist|isPrivateIP|isInternalIP|ssrf)\b|\.(?:hostname|protocol)\b"
PASSWORD_WRITE = r"\.(?:create|update|set|add|insert|save)\s*\([^;]{0,300}?\b(?:password|passwd|hash)\s*[:,}]"
PASSWORD_HASH = r"\b(?:hash|hashSync|genSalt|genSaltSync|scrypt|pbkdf2)\s*\("
PASSWORD_COMPARE = r"\b(?:password|passwd)\s*[!=]==?\s*[\w.]+\.(?:password|passwd|hash)\b|\.(?:password|passwd|hash)\s*[!=]==?\s*(?:\w+\.){0,40}(?:password|passwd)\b"
RANDOM_NAMES = r"^(?:token|secret|key|code|nonce|salt|session|invite|reset|verify|confirm|otp|pin|id|uuid|guid|hash|seed|random(?:Id|Token|Key|Code|String|Bytes))"
PROMPT_INPUT = (
    r"(?:content|prompt|message|text)\s*:\s*`[^`]*\$\{(?:req\.|request\.|body\.|params\.|query\.|input|userInput|message|prompt|user)",
    r"(?:content|prompt|message|text)\s*:\s*['\"][^'\"]*['\"]\s*\+\s*(?:req\.|request\.|body\.|params\.|query\.|input|userInput|message)",
    r"(?:content|prompt)\s*:\s*(?:req\.body|req\.query|request\.body)\.",
)
AI_CALL = r"openai\.(?:chat\.completions|completions)\.create|anthropic\.messages\.create|\.chat\.completions\.create|generateText\s*\(|streamText\s*\(|\.generate\s*\(\s*\{"
AI_WORDS = r"(?:openai|anthropic|generateText|streamText|completions|messages\.create)"
DYNAMIC = ((r"^[\w.]+\s*\(\s*(?:`[^`]*\$\{|(?:'[^'\n]*'|\"[^\"\n]*\"|`[^`]*`|[\w.$\[\]]+)\s*\+(?!\+))", ""),)
QUERY = r"\.(?:findUnique|findFirst|findMany|findOne|createMany|updateMany|deleteMany|upsert|aggregate|groupBy|execute|query)\s*\(|\b(?:prisma|db|database|supabase|knex|mongoose|pool|sql|conn|connection|repo|repository)(?:\.\w+){1,40}\s*\("

_AUTH_GATES = (path(API), path(CODE), not_path(AUTH_SKIP), not_path(PUBLIC_ROUTE))
_MESSAGE = "The exported handler {0} checks no user"
_DEMO_MESSAGE = "The exported handler {0} of a test or demo route checks no user"

SCOPE_RULES: tuple[ScopeRule, ...] = (
    ScopeRule("missing-auth", (*_AUTH_GATES, not_path(DEMO)), _MESSAGE, name=METHODS, exported=True, guarded=True),
    ScopeRule("missing-auth", (*_AUTH_GATES, path(DEMO)), _DEMO_MESSAGE, name=METHODS, exported=True, guarded=True),
    ScopeRule("idor-vulnerability", (path(API), path(CODE), not_path(TESTS_RULES)), "The function {0} uses a request's id without checking the owner", hits=((REQUEST_ID, ""),), lacks=OWNER, first=True),
    ScopeRule("unsafe-file-upload", (path(UPLOADS), path(CODE), not_path(TESTS_RULES)), "The function {0} takes uploads without checking type and size", has=((UPLOAD, ""),), lacks=((PROCESSING, "i"), (TYPE_CHECK + r"[\s\S]*(?:" + SIZE_CHECK + r")|(?:" + SIZE_CHECK + r")[\s\S]*(?:" + TYPE_CHECK + ")", ""))),
    ScopeRule("mass-assignment", (path(CONTROLLERS), path(CODE), not_path(TESTS_RULES)), "The function {0} stores the request body as it is", hits=BODY_CALL, lacks=BODY_CHECK),
    ScopeRule("path-traversal", (path(FILES), path(CODE), not_path(TESTS_RULES)), "The function {0} opens a path from the request", hits=((FS_CALL, ""),), lacks=((SANITISER, "i"),)),
    ScopeRule("ssrf-vulnerability", (path(WORKERS), path(CODE), not_path(TESTS_RULES)), "The function {0} fetches an address from the request", hits=((FETCH, "i"),), lacks=((HOST_CHECK, "i"),)),
    ScopeRule("plaintext-passwords", (path(AUTH_PATHS), path(CODE), not_path(TESTS_RULES), has(r"password|passwd")), "The function {0} stores a password without hashing it", hits=((PASSWORD_WRITE, ""),), lacks=((PASSWORD_HASH, "i"),)),
    ScopeRule("plaintext-passwords", (path(AUTH_PATHS), path(CODE), not_path(TESTS_RULES), has(r"password|passwd")), "The function {0} compares passwords as plain text", hits=((PASSWORD_COMPARE, ""),), lacks=((r"\b(?:compare|compareSync|verify)\s*\(", "i"),)),
    ScopeRule("plaintext-passwords", (path(AUTH_PATHS), path(CODE), not_path(TESTS_RULES), has(r"password|passwd")), "The function {0} hashes a password with a broken hash", has=((r"\b(?:password|passwd|hashedPassword|passwordHash)\b", "i"),), hits=((r"\bcreateHash\s*\(\s*['\"](?:md5|sha1|sha-1)['\"]", "i"), (r"\b(?:md5|sha1)\s*\([^)]*\b(?:password|passwd)\b", "i"))),
    ScopeRule("insecure-randomness", (path(CODE), not_path(TESTS_RULES), has(r"Math\.random", "")), "The function {0} makes guessable values", has=((r"\bMath\.random\s*\(", ""),), name=RANDOM_NAMES),
    ScopeRule("nextjs-server-action-exposure", (path(CODE), not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|fixtures\/|src\/rules\/)")), "The server action {0} checks no user", exported=True, guarded=True, local_guards=False, any_gate=(path(r"(?:actions|server-actions?)\.(js|ts|jsx|tsx)$"), has(r"""^(?:\s++|\/\/[^\n]*+\n|\/\*[\s\S]*?\*\/)*+['"]use server['"]""", ""))),
    ScopeRule("ai-prompt-injection", (path(CODE), not_path(TESTS_DEPS), has(AI_WORDS), has(AI_CALL, ""), *(Test(p, "", "content", False) for p in PROMPT_INPUT)), "The function {0} sends a request's body to a model", has=((r"\breq\.body\.", ""), (r"\b(?:create|generate|generateText|streamText)\s*\(", "i"))),
)

CODE_RULES: tuple[CodeRule, ...] = (
    CodeRule("insecure-randomness", (path(CODE), not_path(TESTS_RULES), has(r"Math\.random", "")), r"\b(?:const|let|var)\s+(?:token|secret|key|code|nonce|salt|session|invite|reset|verify|confirm|otp|pin|id|uuid|guid|hash|seed|random(?:Id|Token|Key|Code|String|Bytes))\w*\s*(?::[^=\n]+)?=[^;\n]*Math\.random\s*\(", "A value that must not be guessed comes from Math.random", "i", once_a_line=False),
    CodeRule("eval-usage", (path(CODE), not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.d\.ts$)"), not_path(r"src\/rules\/")), r"\beval\s*\(", "Code is evaluated from a value", unless=((r"^eval\s*\(\s*(?:'[^'\n]*'|\"[^\"\n]*\")\s*[,)]", ""),), once_a_line=False),
    CodeRule("eval-usage", (path(CODE), not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.d\.ts$)"), not_path(r"src\/rules\/")), r"\bnew\s+Function\s*\(", "A function is made from a value", unless=((r"^new\s+Function\s*\(\s*(?:'[^'\n]*'|\"[^\"\n]*\"|\d+)\s*[,)]", ""),), once_a_line=False),
    CodeRule("command-injection", (path(CODE), not_path(TESTS_DEPS)), r"\b(?:exec|execSync|spawn|spawnSync|execFile|execFileSync)\s*\(", "A shell command is built from values", also=DYNAMIC),
    CodeRule("template-injection", (path(CODE), not_path(TESTS_DEPS)), r"\b(?:Handlebars|handlebars|ejs|pug|jade|nunjucks|_|dot|eta|Twig)\.(?:compile|render|renderString|template|compileFile)\s*\(", "A template is built from values", also=DYNAMIC),
    CodeRule("perf-n-plus-one", (path(CODE), not_path(TESTS_DEPS)), QUERY, "A query runs once for each element", inside=("loop", "callback")),
    CodeRule("perf-no-await-parallel", (path(CODE), not_path(TESTS_DEPS)), r"\bawait\b", "Calls of a loop wait for one another", unless=((r"^await\s+Promise\.(?:all|allSettled|race|any)\s*\(", ""),), inside=("loop",)),
    CodeRule("perf-db-client-per-request", (path(CODE), not_path(TESTS_DEPS), *lacks(r"global\w*(?:\.\w+)?\s*(?:\?\?=?|\|\|=?|=)[^;\n]*new\s+(?:PrismaClient|Pool|Sequelize)")), r"\bnew\s+(?:PrismaClient|Pool|Sequelize)\s*\(", "A database client is made inside a function", inside=("any",)),
)

_NOT_CODE = not_path(CODE)
#: What holds for files that have no functions to ask about: other languages.
FALLBACK_FILES: tuple[FileRule, ...] = (
    FileRule(
        "idor-vulnerability",
        (path(API), not_path(TESTS_RULES), _NOT_CODE, has(r"(?:req\.params|params|context\.params)\.\w*(?:id|Id|ID)\b|(?:req\.query|query|searchParams\.get)\s*[.(]\s*['\"`]?\w*(?:id|Id|ID)|(?:req\.body|body)\.\w*(?:id|Id|ID)\b"))
        + lacks(r"(?:session|auth|currentUser|req\.user)(?:\.\w+){0,40}\.(?:id|uid|userId|sub)\s*(?:===?|!==?)\s*", r"(?:===?|!==?)\s*(?:session|auth|currentUser|req\.user)(?:\.\w+){0,40}\.(?:id|uid|userId|sub)", r"where\s*:\s*\{[^}]*(?:userId|user_id|ownerId|owner_id|createdBy)\s*:\s*(?:session|auth|user|currentUser)", r"request\.auth\.uid", r"(?:authorize|checkOwnership|isOwner|canAccess|hasAccess|checkPermission|verifyOwnership)\s*\("),
        (FileBranch((), "A request's id is used without checking the owner", line=(r"(?:req\.params|params|context\.params)\.\w*(?:id|Id|ID)\b|(?:req\.query|query|searchParams\.get)\s*[.(]\s*['\"`]?\w*(?:id|Id|ID)|(?:req\.body|body)\.\w*(?:id|Id|ID)\b", "i")),),
    ),
    FileRule(
        "unsafe-file-upload",
        (path(UPLOADS), not_path(TESTS_RULES), _NOT_CODE, has(r"multer\s*\(|formidable\s*\(|formData\.get\s*\(\s*['\"`](?:file|image|upload|attachment|document|avatar|photo)|req\.files?\b|(?:uploadBytes|uploadBytesResumable|upload\.single|upload\.array)\s*\(")) + lacks(r"(?:sharp|jimp|imageSize)|fileFilter"),
        (
            FileBranch(lacks(r"(?:mimetype|mime_type|mimeType|contentType|content_type|type)\s*(?:===|!==|==|!=|\.includes)|(?:extname|extension|allowedTypes|allowedExtensions)", r"(?:size|fileSize|maxSize|MAX_SIZE|sizeLimit)"), "Uploads are checked for neither type nor size", line=(r"multer\s*\(|formidable\s*\(|formData\.get|req\.files?\b|upload", "i")),
            FileBranch(lacks(r"(?:mimetype|mime_type|mimeType|contentType|content_type|type)\s*(?:===|!==|==|!=|\.includes)|(?:extname|extension|allowedTypes|allowedExtensions)") + (has(r"(?:size|fileSize|maxSize|MAX_SIZE|sizeLimit)"),), "Uploads aren't checked for their type", line=(r"multer\s*\(|formidable\s*\(|formData\.get|req\.files?\b|upload", "i")),
            FileBranch((has(r"(?:mimetype|mime_type|mimeType|contentType|content_type|type)\s*(?:===|!==|==|!=|\.includes)|(?:extname|extension|allowedTypes|allowedExtensions)"), *lacks(r"(?:size|fileSize|maxSize|MAX_SIZE|sizeLimit)")), "Uploads aren't checked for their size", line=(r"multer\s*\(|formidable\s*\(|formData\.get|req\.files?\b|upload", "i")),
        ),
    ),
    FileRule(
        "nextjs-server-action-exposure",
        (path(CODE), not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|fixtures\/|src\/rules\/)"), has(r"""^(?:\s++|\/\/[^\n]*+\n|\/\*[\s\S]*?\*\/)*+['"]use server['"]""", ""))
        + lacks(r"export\s+(?:default\s+)?(?:async\s+)?(?:function|const\s+\w+\s*=\s*(?:async\s*)?(?:\(|\w+\s*(?:=>|\()))", r"(?:getServerSession|getSession|auth\(\)|require\w*auth\w*|currentUser|getUser|session\.user|clerkClient|verify\w*token)"),
        (FileBranch((), "A file of server actions checks no user", line=(r"['\"]use server['\"]", "")),),
    ),
)
FALLBACK_LINES: tuple[LineRule, ...] = (
    LineRule(
        "mass-assignment",
        (path(CONTROLLERS), not_path(TESTS_RULES), _NOT_CODE) + lacks(r"const\s*\{[^}]+\}\s*=\s*(?:req\.body|body|request\.body|await\s+request\.json)", r"(?:\.parse|\.validate|\.safeParse|\.validateSync)\s*\(\s*(?:req\.body|body|request\.body)", r"(?:pick|omit|allowedFields|sanitize)\s*\(", r"(?:zod|yup|joi|superstruct|valibot|ajv|typebox)"),
        (
            Pattern(r"data\s*:\s*(?:req\.body|body|request\.body)\b", "A request body becomes a record"),
            Pattern(r"\.(?:create|insertMany|updateOne|updateMany|findOneAndUpdate|findByIdAndUpdate)\s*\(\s*(?:req\.body|body|request\.body)\b", "A request body is stored"),
            Pattern(r"\.(?:set|update|add)\s*\(\s*(?:req\.body|body|request\.body)\b", "A request body is written to a document"),
            Pattern(r"(?:data|set|update|create|insert)\s*[:=]\s*\{[^}]*\.\.\.(?:req\.body|body|request\.body)", "A request body is spread into a record"),
            Pattern(r"Object\.assign\s*\([^,]+,\s*(?:req\.body|body|request\.body)\b", "A request body is assigned to an object"),
        ),
        ("//",),
    ),
    LineRule(
        "path-traversal",
        (path(FILES), not_path(TESTS_RULES), _NOT_CODE) + lacks(r"path\.basename\s*\(", r"\.replace\s*\([^)]*\.\.", r"\.startsWith\s*\(\s*(?:allowed|safe|base|upload|public)"),
        (
            Pattern(r"(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream)\s*\(\s*(?:[`'\"].*\$\{|.*\+\s*(?:req\.|request\.|params\.|query\.|body\.|file|name|path))", "A path is built from a request"),
            Pattern(r"(?:res\.sendFile|res\.download)\s*\(\s*(?:[`'\"].*\$\{|.*\+\s*(?:req\.|request\.|params\.|query\.))", "A file is sent by a request's path"),
            Pattern(r"(?:readFile|createReadStream|sendFile)\s*\([^)]*(?:params\.\w+|query\.\w+|searchParams\.get)", "A parameter names a file"),
        ),
        ("//",),
    ),
    LineRule(
        "ssrf-vulnerability",
        (path(WORKERS), not_path(TESTS_RULES), _NOT_CODE) + lacks(r"(?:allowlist|whitelist|allowedHosts|allowedDomains)", r"ssrf", r"(?:isPrivateIP|isInternalIP)"),
        (
            Pattern(r"fetch\s*\(\s*(?:req\.body|body|request\.body|req\.query|query|params|searchParams)\.\w*(?:url|link|href|src|endpoint)", "The server fetches a user's address"),
            Pattern(r"(?:axios|got|node-fetch|undici|request)\.\w+\s*\(\s*(?:req\.body|body|request\.body|req\.query|query|params)\.\w*(?:url|link|href|src|endpoint)", "A client requests a user's address"),
        ),
        ("//",),
    ),
    LineRule(
        "plaintext-passwords",
        (path(AUTH_PATHS), not_path(TESTS_RULES), _NOT_CODE, has(r"password|passwd")) + lacks(r"bcrypt|argon2|scrypt|pbkdf2|hashPassword|saltRounds"),
        (
            Pattern(r"\.create\s*\(\s*\{[^}]*password\s*:\s*(?:req\.body|body|request\.body|data)\.password", "A password is stored unhashed"),
            Pattern(r"\.create\s*\(\s*\{[^}]*password\s*:\s*password\b", "A password variable is stored"),
            Pattern(r"(?:password|passwd)\s*===?\s*(?:req\.body|body|user|stored|db|record)\.\w*(?:password|passwd)", "Passwords are compared as plain text"),
            Pattern(r"createHash\s*\(\s*['\"](?:md5|sha1|sha-1)['\"]\s*\).*(?:password|passwd)", "A password is hashed with a broken hash"),
            Pattern(r"(?:password|passwd).*createHash\s*\(\s*['\"](?:md5|sha1|sha-1)['\"]\s*\)", "A password is hashed with a broken hash"),
            Pattern(r"(?:require\s*\(\s*['\"](?:md5|sha1)['\"]\s*\)|import\s+(?:md5|sha1)\b).*(?:password|passwd)", "A broken hash is imported for passwords"),
        ),
        ("//",),
    ),
    LineRule(
        "insecure-randomness",
        (not_path(TESTS_RULES), _NOT_CODE, has(r"Math\.random", "")),
        (
            Pattern(r"(?:token|secret|key|code|nonce|salt|session|invite|reset|verify|confirm|otp|pin)\w*\s*=\s*[^;\n]*Math\.random", "A value that must not be guessed comes from Math.random"),
            Pattern(r"function\s+(?:generate|create|make|get)\w*(?:Token|Key|Code|Id|Secret|Nonce|Salt|Session|OTP|PIN)\s*\([^)]*\)\s*\{[^}]*Math\.random", "A function makes guessable values"),
        ),
        ("//",),
    ),
)
