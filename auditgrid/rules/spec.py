"""Declarative rules: gates on a file, and patterns on its lines or its content."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The paths that almost every rule leaves out: fixed values.
TESTS = r"(?:\.test\.|\.spec\.|__tests__)"
TESTS_DEPS = r"(?:\.test\.|\.spec\.|__tests__|node_modules)"
TESTS_RULES = r"(?:\.test\.|\.spec\.|__tests__|src\/rules\/)"
TESTS_DEPS_RULES = r"(?:\.test\.|\.spec\.|__tests__|node_modules|src\/rules\/)"
API = r"(?:api\/|routes\/|server\/|functions\/|\.server\.|pages\/api\/|app\/api\/)"
CODE = r"\.(?:js|jsx|ts|tsx|mjs|cjs)$"


@dataclass(frozen=True)
class Test:
    """A regular expression on ``path``, ``content`` or a line that must match (or must not)."""

    regex: str
    flags: str = "i"
    on: str = "content"
    wanted: bool = True


def path(regex: str, flags: str = "i") -> Test:
    return Test(regex, flags, "path")


def not_path(regex: str, flags: str = "i") -> Test:
    return Test(regex, flags, "path", False)


def has(regex: str, flags: str = "i") -> Test:
    return Test(regex, flags)


def lacks(*regexes: str, flags: str = "i") -> tuple[Test, ...]:
    return tuple(Test(r, flags, "content", False) for r in regexes)


@dataclass(frozen=True)
class Pattern:
    """severity: where it isn't the rule's. also / unless: further expressions on the same line or match. path: a further gate.

    re2: the same for engines that can't look ahead.
    """

    regex: str
    message: str
    severity: str | None = None
    flags: str = "i"
    also: tuple[tuple[str, str], ...] = ()
    unless: tuple[tuple[str, str], ...] = ()
    path: str | None = None
    re2: str | None = None


@dataclass(frozen=True)
class LineRule:
    """Each pattern gives at most one finding a line; with ``first`` the rule does.

    comments: beginnings of trimmed lines that don't count. client: for files of the client only.
    whole_evidence: the evidence isn't cut.
    """

    id: str
    gates: tuple[Test, ...]
    patterns: tuple[Pattern, ...]
    comments: tuple[str, ...] = ("//", "*")
    first: bool = False
    client: bool = False
    whole_evidence: bool = False
    any_gate: tuple[Test, ...] = ()


@dataclass(frozen=True)
class ContentRule:
    """Each match in the content is a finding.

    window: (characters before the match, characters after its start or after its end, from_end, expression,
    flags, wanted): a test on the surroundings. group: the message's ``{0}`` is this group.
    """

    id: str
    gates: tuple[Test, ...]
    patterns: tuple[Pattern, ...]
    comments: tuple[str, ...] = ()
    window: tuple[int, int, bool, str, str, bool] | None = None
    once_a_line: bool = False
    any_gate: tuple[Test, ...] = ()
    group: int | None = None
    match_unless: tuple[str, str] | None = None
    first_only: bool = False


@dataclass(frozen=True)
class FileBranch:
    """One finding for a file where all tests hold.

    line: expression whose first line is meant. at: expressions, each with flags and a path gate, of which
    the first with a match gives the line. Else line 1. shown: whether the line is the evidence.
    """

    tests: tuple[Test, ...]
    message: str
    severity: str | None = None
    line: tuple[str, str] | None = None
    at: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class FileRule:
    id: str
    gates: tuple[Test, ...]
    branches: tuple[FileBranch, ...]
    any_gate: tuple[Test, ...] = field(default=())


@dataclass(frozen=True)
class ScopeRule:
    """Asks about each function of a script file (tests on its code without comments).

    has: all must match the function's code; lacks: none may. hits: expressions whose matches are the
    findings (with ``first`` only the first one); without them the function itself is. message: ``{0}`` is
    the function's name. name: expression on the name. exported: only exported functions. guarded: leave out
    functions that call an authentication guard.
    """

    id: str
    gates: tuple[Test, ...]
    message: str
    has: tuple[tuple[str, str], ...] = ()
    lacks: tuple[tuple[str, str], ...] = ()
    hits: tuple[tuple[str, str], ...] = ()
    first: bool = False
    name: str | None = None
    exported: bool = False
    guarded: bool = False
    local_guards: bool = True
    any_gate: tuple[Test, ...] = ()
    severity: str | None = None


@dataclass(frozen=True)
class CodeRule:
    """Asks about each match in a script file's code without comments.

    unless / also: expressions on the ``reach`` characters from the match on. inside: kinds of the innermost
    block around the match, one of which it must have (``any``: some function around it).
    """

    id: str
    gates: tuple[Test, ...]
    regex: str
    message: str
    flags: str = ""
    also: tuple[tuple[str, str], ...] = ()
    unless: tuple[tuple[str, str], ...] = ()
    reach: int = 300
    inside: tuple[str, ...] = ()
    once_a_line: bool = True


@dataclass(frozen=True)
class UserRule:
    """A rule of a project's own, with its row of the rules dimension; ids of the built-in rules can't be taken."""

    rule: LineRule | ContentRule | FileRule | ScopeRule | CodeRule
    severity: str
    name: str
    fix: str = ""
    cwe_id: str | None = None
    cvss_score: float | None = None
    owasp_category: str | None = None
    wcag: str | None = None
