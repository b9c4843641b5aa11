"""Scopes of script files: functions, iteration callbacks and loops with their places.

``quiet`` blanks comments, strings, templates and regular expressions by one search on the JVM. What is left is
code whose brackets pair, so a small helper takes scopes from it with a stack, in linear time. All that rules ask
about a scope is then an expression or a join on ``scope_table``. The patterns are plain enough for other engines
too: ``plans/oracle.py`` finds the same scopes with window functions.
"""

from __future__ import annotations

import logging
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditgrid.functions.text import js_regex, marked
from auditgrid.schema import KEYS

log = logging.getLogger(__name__)

STRING = r"\"(?:\\[^\n]|[^\"\\\n])*+\"|'(?:\\[^\n]|[^'\\\n])*+'"
TEMPLATE = r"`(?:\\[\s\S]|\$\{(?:[^`{}]++|\{(?:[^`{}]++|`[^`]{0,500}+`){0,200}+\}|`[^`]{0,500}+`){0,200}+\}|[^`\\$]++|\$)*+`"
_CLASS = r"\[(?:\\[^\n]|[^\]\\\n]){0,100}+\]"
_EXPRESSION = rf"/(?:\\[^\n]|{_CLASS}|[^/\\\[\n*>])(?:\\[^\n]|{_CLASS}|[^/\\\[\n])*+/[a-z]*+"
#: What stands before a regular expression; behind anything else, a slash divides or closes a tag.
_BEFORE = r"(?:[(,=:\[!&|?{;+\-*%~^]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield))"
#: Comments; strings; a letter's apostrophe, which begins none; templates; regular expressions with what stands before
#: them, or with a call of their own behind a bracket; arrows; and text between tags with one accent in it.
LEX = "|".join((
    r"//[^\n]*+|/\*[\s\S]*?\*/|/\*[\s\S]*+", STRING, r"\w'", TEMPLATE, rf"{_BEFORE}\s*+{_EXPRESSION}", rf"\)\s*+{_EXPRESSION}\.(?:test|exec)\(", "=>", r">[^<>{}`=;\n]*+`[^<>{}`=;\n]*+</",
))
#: A template's values that stay code: those without texts of their own.
VALUE = r"\$\{(?:[^{}`'\"]++|\{[^{}`'\"]*+\})*+\}"

_S = r"\s*+"
_N = r"[\w$]{1,200}+"
_P = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
_A = r"<(?:[^<>()=;]++|=>?|\([^()]*+\)|<(?:[^<>()=;]++|=>?|\([^()]*+\)|<[^<>()=;]*+>)*+>)*+>"
_O = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
_UNIT = rf"(?:{_O}|(?:[\w.$]++(?:\s++is\s++[\w.$]++)?+|\"[^\"\n]*+\"|'[^'\n]*+'){_S}(?:{_A})?+|{_P}{_S}=>{_S}[\w.$]++(?:{_A})?+)(?:\[[^\]]*+\])*+"
_T = rf"(?::{_S}(?:asserts\s++)?{_UNIT}(?:{_S}[|&]{_S}{_UNIT})*+)?+"
_ARROW = rf"(?:\basync\b{_S})?(?:(?:{_A}{_S})?+{_P}{_S}{_T}|{_N}){_S}=>{_S}\{{?+"
_FUNCTION = rf"(?:\basync\s++)?\bfunction\b{_S}\*?{_S}[\w$]{{0,200}}+{_S}(?:{_A})?+{_S}{_P}{_S}{_T}{_S}\{{"
_WRAP = rf"(?:[\w$.]{{1,200}}+{_S}(?:{_A})?+\({_S}){{0,3}}"
#: Where loops and functions begin, and the marks that end them. A beginning runs up to its brace or arrow.
SCOPE = "|".join((
    rf"\b(?:for|while){_S}{_P}{_S}\{{|\bdo{_S}\{{", rf"\bfor\s++await{_S}{_P}{_S}\{{?+", rf"\}}{_S}while{_S}{_P}{_S}[;\n]", rf"\b(?:for|while){_S}{_P}{_S}",
    rf"\b(?:if|switch|catch|with){_S}{_P}{_S}\{{",
    rf"(?:\bexport\s++)?\b(?:const|let|var)\s++{_N}{_S}(?::[^=;{{}}]{{1,200}}+)?+={_S}{_WRAP}(?:{_FUNCTION}|{_ARROW})",
    rf"\bexport\s++default\s++{_WRAP}(?:{_FUNCTION}|{_ARROW})", rf"(?:\bexport\s++)?{_FUNCTION}",
    rf"\bexport\s++const\s++[A-Z]++{_S}={_S}[\w.]++{_S}\(",
    rf"\.{_S}(?:map|forEach|reduce|reduceRight|filter|flatMap|some|every|find|findIndex){_S}(?:{_A})?+\({_S}(?:{_FUNCTION}|{_ARROW})",
    rf"\b{_N}{_S}(?:{_A})?+{_S}{_P}{_S}{_T}{_S}\{{", rf"\b{_ARROW}|{_ARROW}", r"[(){}\[\];,]", r"\n[ \t]{0,200}+[.?:&|+]", r"\n",
))
#: What files with loops and with iteration callbacks hold, comments where blanks may be included.
LOOP_HINT = r"\b(?:for|while)\s*(?:\(|\/[\/*]|await\b)|\bdo\s*(?:\{|\/[\/*])"
CALLBACK_HINT = r"\.\s*(?:\/[\/*]|(?:map|forEach|reduce|reduceRight|filter|flatMap|some|every|find|findIndex)\s*(?:[<(]|\/[\/*]))"
#: What a beginning's text tells, in the order in which it is asked.
LOOP, NO_SCOPE = r"^(?:for|while|do)\b", r"^(?:for\s+await|if|switch|catch|with)\b"
NAMES = (r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)", r"\bfunction\b\s*\*?\s*([\w$]+)", r"^([\w$]+)\s*[(<][\s\S]*(?:[^>\s]|[^=]>)\s*\{$")
#: The part of a beginning before its value; a call there belongs to the function.
HEAD, CALL, OWN = r"^(?:export\s+)?(?:(?:const|let|var)\s+[\w$]+\s*(?::[^=;{}]{1,200})?=|default\s)\s*", r"^[\w$.]+\s*(?:<[^<>()]*>)?\(", r"^(?:async|function)\b"
_SCOPE = re.compile(SCOPE, re.ASCII)
_ASKED = {k: re.compile(v, re.ASCII) for k, v in {"loop": LOOP, "none": NO_SCOPE, "head": HEAD, "call": CALL, "own": OWN}.items()}
_NAMES = tuple(re.compile(n, re.ASCII) for n in NAMES)

BLOCK = pa.struct([("kind", pa.string()), ("name", pa.string()), ("exported", pa.bool_()), ("head", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("exported", T.BooleanType()), *(T.StructField(n, T.IntegerType()) for n in ("head", "start", "stop"))]))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def quiet(content: Column) -> Column:
    """``array<struct<code, plain>>`` whose parts make up the content with blanks for comments, and with blanks for the insides of strings, templates and regular expressions as well.

    Values in a template stay code where they hold no texts of their own.
    """

    def part(p: Column) -> Column:
        gap, token = F.substring_index(p, "\x02", 1), F.substring_index(p, "\x02", -1)
        first, size = F.substring(token, 1, 1), F.length(token)
        comment = F.substring(token, 1, 2).isin("//", "/*")
        inside = F.substring(token, F.lit(2), size - 2)
        values = F.regexp_extract_all(inside, F.lit(VALUE), F.lit(0))
        template = F.array_join(F.zip_with(F.split(inside, VALUE, -1), values, lambda a, v: F.concat(_blank(a), F.coalesce(v, F.lit("")))), "")
        head, tail = F.regexp_extract(token, r"^[^/]*/", 0), F.regexp_extract(token, r"/[a-z]*(?:\.(?:test|exec)\()?\z", 0)
        regex = F.concat(head, _blank(F.substring(token, F.length(head) + 1, size - F.length(head) - F.length(tail))), tail)
        kept = (first == ">") | (token == "=>") | ((size == 2) & token.endswith("'") & ~first.isin("'", '"'))
        plain = F.when(comment, _blank(token)).when(first.isin("'", '"'), F.concat(first, _blank(inside), first)).when(first == "`", F.concat(first, template, first)).when(kept, token).otherwise(regex)
        code = F.when(comment, _blank(token)).otherwise(token)
        return F.when(p.contains("\x02"), F.struct(F.concat(gap, code).alias("code"), F.concat(gap, plain).alias("plain"))).otherwise(F.struct(p.alias("code"), p.alias("plain")))

    return F.transform(marked(content, F.lit(js_regex(LEX))), part)


def _place(text: str, at: int) -> int:
    """Where a function's code begins: at its brace, behind its arrow, or at the call that wraps it."""
    head = _ASKED["head"].match(text)
    rest = text[head.end() :] if head else ""
    if head and _ASKED["call"].match(rest) and not _ASKED["own"].match(rest):
        return at + head.end()
    return at + len(text) - (text[-1] == "{")


def scopes(plain: str) -> list[dict]:
    """The scopes of quiet code, by place; one without an end runs to the end of the text."""
    out: list[dict] = []
    stack: list[dict | None] = []  # of the open brackets, the scope that each belongs to
    short: list[tuple[int, dict]] = []  # scopes without braces, and how deep they are
    depth = 0

    def end(above: int, at: int) -> None:
        while short and short[-1][0] > above:
            short.pop()[1]["stop"] = at

    for m in _SCOPE.finditer(plain):
        text, at = m[0], m.start()
        last = text[-1]
        if text[0] in ")]}":
            depth -= 1
            end(depth, at)
            if stack and (scope := stack.pop()):
                scope["stop"] = at + 1
            continue
        if text in (";", ",", "\n"):
            end(depth - 1, at)
            continue
        if text[0] == "\n":
            continue
        opened = sum(text.count(o) - text.count(c) for o, c in ("()", "[]", "{}"))
        depth += opened
        scope = None
        if len(text) > 1 and not _ASKED["none"].match(text):
            loop = _ASKED["loop"].match(text)
            kind = "loop" if loop else "callback" if text[0] == "." else "function"
            named = "" if loop else next((n[1] for p in _NAMES if (n := p.search(text))), "default" if text.startswith("export") else "anonymous")
            start = at + len(text) - (last == "{") if loop else _place(text, at)
            scope = {"kind": kind, "name": named or "anonymous", "exported": text.startswith("export"), "head": at, "start": start, "stop": len(plain)}
            out.append(scope)
        if last in "{(":
            stack += [None] * (opened - 1) + [scope]
        else:
            stack += [None] * opened
            if scope:
                short.append((depth, scope))
    return out


def _safe_scopes(plain: str | None) -> list[dict]:
    """A file that the helper fails on has no scopes, and the audit goes on."""
    try:
        return scopes(plain) if plain else []
    except Exception:
        log.exception("a script of %d characters could not be scanned", len(plain))
        return []


@F.arrow_udf(BLOCKS)
def _scopes(plain: pa.Array) -> pa.Array:
    return pa.array([_safe_scopes(x.as_py()) for x in plain], pa.list_(BLOCK))


def around(scopes: list[dict], places: list[int]) -> list[dict]:
    """Of each place, in order, the kind of the innermost scope around it and whether it is in a function; as ``scopes.enclosed`` counts.

    Beginnings and ends are met in order once. How deep a place is names the scope around it: the last one that began there.
    """
    marks = [(s["start"], 1, s["stop"], s) for s in scopes if s["stop"] > s["start"]] + [(s["stop"], 0, s["stop"], s) for s in scopes if s["stop"] > s["start"]]
    marks.sort(key=lambda m: m[:3])
    depth, last, at, out = {True: 0, False: 0}, {True: {}, False: {}}, 0, {}
    for place in sorted(set(places)):
        while at < len(marks) and marks[at][0] <= place:
            _, begins, _, scope = marks[at]
            loop = scope["kind"] == "loop"
            depth[loop] += 1 if begins else -1
            if begins:
                last[loop][depth[loop]] = scope
            at += 1
        function, loop = (last[k].get(depth[k]) if depth[k] > 0 else None for k in (False, True))
        inner = loop if loop and loop["start"] > (function["start"] if function else -1) else function
        out[place] = {"kind": inner and inner["kind"], "inside": function is not None}
    return [out[p] for p in places]


AROUND = pa.struct([("kind", pa.string()), ("inside", pa.bool_())])
SCOPED = T.StructType([T.StructField("blocks", BLOCKS), T.StructField("around", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("inside", T.BooleanType())])))])


@F.arrow_udf(SCOPED)
def scoped(plain: pa.Array, places: pa.Array) -> pa.Array:
    """The scopes of quiet code (none where it is null), and what is around each of some places."""
    blocks = [_safe_scopes(x.as_py()) for x in plain]
    near = [around(b, p.as_py() or []) for b, p in zip(blocks, places)]
    return pa.StructArray.from_arrays([pa.array(blocks, pa.list_(BLOCK)), pa.array(near, pa.list_(AROUND))], ["blocks", "around"])


def quieted(files: DataFrame, *keep: str) -> DataFrame:
    """``files`` (their keys, content and ``keep``) with code and plain: without comments, and without texts as well."""
    return files.select(*KEYS, "content", *keep, F.explode(F.array(quiet(F.col("content")))).alias("q")).select(*KEYS, "content", *keep, F.array_join("q.code", "").alias("code"), F.array_join("q.plain", "").alias("plain"))


def with_blocks(files: DataFrame) -> DataFrame:
    """``files`` (their keys and content) with code and blocks. No shuffle; a null content has none."""
    rows = quieted(files)
    return rows.select(*KEYS, "content", "code", _scopes(F.col("plain")).alias("blocks"))
