"""Rules about opening tags, remote scripts, routes and prompts: matches in the whole content. Fixed values.

A tag ends at the first ``>`` outside quotes and braces.
"""

from __future__ import annotations

from auditgrid.functions.fileclass import PUBLIC_ROUTE
from auditgrid.rules.scope_rules import AI_WORDS, AUTH_SKIP, AUTH_WORDS, DEMO, HANDLER, PROMPT_INPUT
from auditgrid.rules.spec import API, CODE, TESTS_DEPS, ContentRule, Pattern, Test, has, lacks, not_path, path

MARKUP = r"\.(?:jsx|tsx|html?|vue|svelte|astro)$"
# Possessive: a group that repeats without end must not be tried again turn by turn, which costs Java a stack frame each.
TAG_REST = r"(?:\"[^\"]*+\"|'[^']*+'|`[^`]*+`|\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}|[^>\"'`{]++)*+>"
SPREAD = (r"\{\s*\.\.\.", "")
_GATES = (not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.stories\.)"), path(MARKUP))
ROUTES = (r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE)\s*\(", r"export\s+default\s+(?:async\s+)?function\s*(?:\w+)?\s*\(\s*req\s*,\s*res\s*\)", r"(?:app|router)\.(?:get|post|put|patch|delete)\s*\(\s*['\"`]")
_ROUTE_GATES = (path(API), not_path(AUTH_SKIP), not_path(PUBLIC_ROUTE), *lacks(*AUTH_WORDS))
_NO_HANDLERS = (not_path(CODE), Test(HANDLER, "", "content", False))


def _routes(message: str) -> tuple[Pattern, ...]:
    return tuple(Pattern(r, message, None, "") for r in ROUTES)


RULES: tuple[ContentRule, ...] = (
    ContentRule(
        "a11y-img-no-alt", _GATES,
        (Pattern(r"<(?:img|Image)\b" + TAG_REST, "An image has no alt text", None, "", unless=(SPREAD, (r"\balt\s*=", "i"), (r"\baria-hidden\s*=\s*[\"'{]?\s*true", "i"), (r"\brole\s*=\s*[\"']presentation[\"']", "i"))),),
    ),
    ContentRule(
        "a11y-form-no-label", _GATES,
        (Pattern(r"<(?:input|select|textarea)\b" + TAG_REST, "A field has no label", None, "i", unless=(SPREAD, (r"\btype\s*=\s*[\"']?(?:hidden|submit|button|reset|image)\b", "i"), (r"\b(?:aria-label|aria-labelledby|title)\s*=", "i"), (r"\bid\s*=", "i"))),),
        window=(160, 0, False, r"<label\b", "i", False),
    ),
    ContentRule("a11y-no-lang", _GATES, (Pattern(r"<html\b" + TAG_REST, "The page names no language", None, "i", unless=(SPREAD, (r"\blang\s*=", "i"))),), first_only=True),
    ContentRule(
        "a11y-button-no-name", _GATES,
        (Pattern(r"<button\b" + TAG_REST + r"(?:\s++|<(?!/button>)[^>]*+>)*+</button>", "A button has no name", None, "i", re2=r"<button\b" + TAG_REST + r"(?:\s|<[^>]*>)*?</button>", unless=((r"^<button\b[^>]*\{\s*\.\.\.", "i"), (r"^<button\b[^>]*\b(?:aria-label|aria-labelledby|title)\s*=", "i"), (r"^<button\b[^>]*/>", "i"))),),
    ),
    ContentRule(
        "a11y-click-no-keyboard", (_GATES[0], path(r"\.(?:jsx|tsx)$")),
        (Pattern(r"<(?:div|span|li|p|td|tr|section|article|header|footer|main|aside|nav|ul|ol|figure)\b" + TAG_REST, "An element reacts to clicks but not to keys", None, "i", also=((r"\bonClick\s*=", ""),), unless=(SPREAD, (r"\bon(?:KeyDown|KeyUp|KeyPress)\s*=", ""), (r"\brole\s*=", "i"))),),
    ),
    ContentRule(
        "missing-sri", (not_path(TESTS_DEPS), path(r"\.(?:html?|jsx|tsx|vue|svelte|astro|ejs|hbs)$")),
        (
            Pattern(r"<script\b[^>]*>", "A remote script has no integrity hash", None, "i", also=((r"\b(?:src|href)\s*=\s*[\"'](?:https?:)?\/\/[^\"']+[\"']", "i"),), unless=((r"\bintegrity\s*=", "i"),)),
            Pattern(r"<link\b[^>]*>", "A remote stylesheet has no integrity hash", None, "i", also=((r"\b(?:src|href)\s*=\s*[\"'](?:https?:)?\/\/[^\"']+[\"']", "i"), (r"\brel\s*=\s*[\"']?stylesheet", "i")), unless=((r"\bintegrity\s*=", "i"),)),
        ),
    ),
    ContentRule(
        "regex-dos", (not_path(r"(?:\.test\.|\.spec\.|__tests__|node_modules|\.d\.ts$)"), not_path(r"src\/rules\/")),
        (Pattern(r"\/[^\/\n]+\/[gimsuvy]*|new\s+RegExp\s*\(\s*['\"`][^'\"`\n]+['\"`]", "A regular expression repeats a repeat", None, "", also=((r"\([^)]*[+*][^)]*\)[+*]|\([^)]*\|[^)]*\)[+*]|\[[^\]]+\][+*][+*]", ""),)),),
        ("//", "*"),
    ),
    ContentRule("ai-prompt-injection", (not_path(TESTS_DEPS), has(AI_WORDS)), tuple(Pattern(p, "User text is part of a prompt", None, "") for p in PROMPT_INPUT)),
    ContentRule("missing-auth", (*_ROUTE_GATES, not_path(DEMO)), _routes("A file with routes checks no user"), any_gate=_NO_HANDLERS),
    ContentRule("missing-auth", (*_ROUTE_GATES, path(DEMO)), _routes("A file with test or demo routes checks no user"), any_gate=_NO_HANDLERS),
)
