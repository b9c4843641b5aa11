"""Text functions with the semantics that the rules were written for: ECMAScript's strings and regular expressions."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from functools import lru_cache, reduce, wraps
from typing import TypeVar

import ahocorasick
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditgrid.schema import EVIDENCE_CHARS

Made = TypeVar("Made")
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def js_regex(pattern: str, flags: str = "") -> str:
    """The pattern in Java's dialect: an ASCII word boundary, ``$`` only at the very end, no nested classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append(_BOUNDARY if two == r"\b" and not inside else two)
            i += 2
            continue
        if c == "[" and inside:
            out.append(r"\[")
        elif c == "$" and not inside and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(c)
        inside = True if c == "[" else False if c == "]" else inside
        i += 1
    on = "".join(f for f in "im" if f in flags) + ("d" if "m" in flags else "")
    return (f"(?{on})" if on else "") + "".join(out)


#: Texts that a set of literals may have.
_WAYS = 64
_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)


def _product(some: frozenset[str], more: frozenset[str] | None) -> frozenset[str] | None:
    return frozenset(a + b for a in some for b in more) if more is not None and len(some) * len(more) <= _WAYS else None


def _exact(op, value) -> frozenset[str] | None:
    """The texts that an element can match, where they are few."""
    if op is sre.LITERAL:
        return frozenset({chr(value)})
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return frozenset({""})
    if op is sre.IN:
        return frozenset(chr(v) for _, v in value) if len(value) <= 8 and all(o is sre.LITERAL for o, _ in value) else None
    if op is sre.SUBPATTERN:
        return None if value[1] & sre.SRE_FLAG_IGNORECASE else _exact_all(value[3])
    if op is sre.BRANCH:
        ways = [_exact_all(w) for w in value[1]]
        out = frozenset().union(*ways) if None not in ways else frozenset()
        return out if 0 < len(out) <= _WAYS else None
    if op in _REPEATS and value[1] == 1 and (one := _exact_all(value[2])) is not None:
        return one if value[0] else one | {""}
    return None


def _exact_all(parts) -> frozenset[str] | None:
    out: frozenset[str] | None = frozenset({""})
    for op, value in parts:
        if out is not None:
            out = _product(out, _exact(op, value))
    return out


def _inlined(parts):
    """The elements with those of groups in their place."""
    for op, value in parts:
        if op is sre.SUBPATTERN and not value[1] & sre.SRE_FLAG_IGNORECASE and _exact(op, value) is None:
            yield from _inlined(value[3])
        else:
            yield op, value


def _needed(parts) -> list[frozenset[str]]:
    """Sets of literals, of each of which one must occur wherever the parsed expression matches."""
    out: list[frozenset[str]] = []
    run = frozenset({""})  # what the elements so far, side by side, can end in
    for op, value in [*_inlined(parts), (None, None)]:
        exact = _exact(op, value)
        if (longer := _product(run, exact)) is not None:
            run = longer
            continue
        if op in _REPEATS and value[0] > 0:  # the first round stands right behind the run
            for inner in _inlined(value[2]):
                if (longer := _product(run, _exact(*inner))) is None:
                    break
                run = longer
        if "" not in run:
            out.append(run)
        run = frozenset({""}) if exact is None else exact
        if op in _REPEATS and value[0] > 0:
            out += _needed(value[2])
        elif op is sre.BRANCH and exact is None:
            ways = [_best(_needed(w)) for w in value[1]]
            if all(ways):
                out.append(frozenset().union(*ways))
    return out


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set that says most: literals of six characters say enough, and of those sets the smallest is searched for fastest."""
    return max(sets, key=lambda s: (min(6, *map(len, s)), -len(s), min(map(len, s))), default=None)


@lru_cache(4096)
def needed_literals(pattern: str) -> tuple[str, ...]:
    """Literals of which one must occur in any text that matches; none where that says too little."""
    best = _best([s for s in _needed(sre_parser.parse(pattern)) if len(s) <= _WAYS]) or frozenset()
    best = {x for x in best if not any(y != x and y in x for y in best)}
    return tuple(sorted(best)) if best and min(map(len, best)) >= 3 else ()


#: The sets of literals that columns ask for, in lower case, by number. It only grows.
_SETS: dict[tuple[str, ...], int] = {}


@lru_cache(4)
def _automaton(sets: tuple[tuple[str, ...], ...]) -> ahocorasick.Automaton:
    """Of all literals of some sets; each gives the numbers of its sets."""
    of: dict[str, list[int]] = {}
    for number, literals in enumerate(sets):
        for x in literals:
            of.setdefault(x, []).append(number)
    out = ahocorasick.Automaton()
    for x, numbers in of.items():
        out.add_word(x, tuple(numbers))
    out.make_automaton()
    return out


def literal_sets(low: Column) -> Column:
    """``array<int>``: the numbers of the sets of literals one of which occurs in a text in lower case. One search finds all; ``has_literals`` asks for them.

    It knows the sets that columns made so far ask for, so it is made behind them.
    """
    sets = tuple(_SETS)
    if not sets:
        return F.array().cast("array<int>")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pa.Array) -> pa.Array:
        automaton = _automaton(sets)
        return pa.array([sorted({n for numbers in {v for _, v in automaton.iter(x)} for n in numbers}) if (x := t.as_py()) is not None else None for t in texts], pa.list_(pa.int32()))

    return found(low)


def _conditions(parts) -> list:
    """What must all hold wherever the parsed expression matches: sets of literals of which one occurs, and lists of ways, one of whose conditions hold."""
    out: list = [s for s in _needed(parts) if min(map(len, s)) >= 3 and len(s) <= _WAYS]
    for op, value in _inlined(parts):
        if op is sre.BRANCH and _exact(op, value) is None:
            ways = [_conditions(w) for w in value[1]]
            if all(ways):
                out.append(ways)
    return out


@lru_cache(4096)
def _conditions_of(pattern: str) -> list:
    return _conditions(sre_parser.parse(pattern))


def _literals_hold(conditions: list) -> str:
    def one(c) -> str:
        if isinstance(c, frozenset):
            return f"array_contains(sets, {_SETS.setdefault(tuple(sorted({x.lower() for x in c if not any(y != x and y in x for y in c)})), len(_SETS))})"
        return f"({' or '.join(map(_literals_hold, c))})"

    return f"({' and '.join(map(one, conditions))})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_literals(pattern: str, flags: str = "") -> Column | None:
    """Whether all literals occur without which the pattern can't match the content, in files whose column ``sets`` has their ``literal_sets``; null where it needs none.

    One text of SQL: a column of its own for each literal takes longer to make than files take to be read.
    """
    if not (conditions := _conditions_of(pattern)):
        return None
    hit, literals = _literals_hold(conditions), needed_literals(pattern)
    return F.expr(hit if "i" in flags or not literals else f"{hit} and ({' or '.join(f'contains(content, {_quoted(x)})' for x in literals)})")


def content_matches(content: Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern occurs in files with ``sets``; most files lack its literals."""
    hit, found = content.rlike(js_regex(pattern, flags)), has_literals(pattern, flags)
    return hit if found is None else found & hit


def may_match(text: Column, pattern: str, flags: str, low: Column) -> Column | None:
    """Whether a literal occurs without which the pattern can't match; null where it needs none. ``low``: the text in lower case."""
    if not (literals := needed_literals(pattern)):
        return None
    return reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in literals] if "i" in flags else [text.contains(x) for x in literals])


def matches(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """Whether the pattern occurs. ``low``, the text in lower case, lets a search for literals go before the regular expression."""
    hit = text.rlike(js_regex(pattern, flags))
    found = None if low is None else may_match(text, pattern, flags, low)
    return hit if found is None else found & hit


#: ECMAScript's white space and line ends.
_SPACE = " \t\n\x0b\f\r\u00a0\ufeff\u2028\u2029\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def js_trim(text: Column) -> Column:
    """Without white space at both ends (Spark's trim knows blanks only, unless it is given the characters), in linear time and without an expression's search through the text."""
    return F.btrim(text, F.lit(_SPACE))


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def evidence(text: Column) -> Column:
    return F.substring(js_trim(text), 1, EVIDENCE_CHARS)


def line_evidence(content: Column, line: Column) -> Column:
    return evidence(F.element_at(lines(content), line))


def line_of(content: Column, offset: Column) -> Column:
    """The number of the line that holds character ``offset`` (from 0)."""
    before = F.substring(content, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def first_line(content: Column, pattern: str, flags: str = "") -> Column:
    """The number of the first line that matches, else 1."""
    hit = F.array_position(F.transform(lines(content), lambda x: matches(x, pattern, flags)), True)
    return F.greatest(hit, F.lit(1)).cast("int")


def first_match_line(content: Column, pattern: str, flags: str = "") -> Column:
    """The number of the line where the first match begins; null without one."""
    p = js_regex(pattern, flags)
    return F.when(content.rlike(p), line_of(content, F.length(F.split(content, p, 2)[0])))


#: Characters that mark matches; in a text they count as blanks.
_BEGIN, _END = "\x02", "\x03"
#: Elements that are summed one after the other; sums of such blocks are summed in turn.
_BLOCK = 128


def remembered(build: Callable[..., Made]) -> Callable[..., Made]:
    """``build``, whose columns are made once for each Spark application and arguments: each call to the JVM takes time."""
    made: dict = {}

    @wraps(build)
    def get(*args):
        key = (SparkContext._active_spark_context.applicationId, args)
        if key not in made:
            if made and next(iter(made))[0] != key[0]:
                made.clear()
            made[key] = build(*args)
        return made[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums_before(values: Column) -> Column:
    """For each of ``array<struct<chars, lines>>`` the sums of those before it."""

    def running(some: Column, start: Column) -> Column:
        first = F.struct(start["chars"].alias("chars"), start["lines"].alias("lines"), F.array().cast("array<struct<chars:int,lines:int>>").alias("out"))
        add = lambda a, x: F.struct((a["chars"] + x["chars"]).alias("chars"), (a["lines"] + x["lines"]).alias("lines"), F.concat(a["out"], F.array(F.struct(a["chars"].alias("chars"), a["lines"].alias("lines")))).alias("out"))
        return F.aggregate(some, first, add)["out"]

    def total(some: Column) -> Column:
        sums = lambda field: F.aggregate(some, F.lit(0), lambda a, x: a + x[field])
        return F.struct(sums("chars").alias("chars"), sums("lines").alias("lines"))

    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, total), zero), running)))


def marked(content: Column, pattern: Column) -> Column:
    """The content cut behind each match, the matches' beginnings marked: one search through the content."""
    marks = content.contains(_BEGIN) | content.contains(_END)
    return F.split(F.regexp_replace(F.when(marks, F.translate(content, _BEGIN + _END, "  ")).otherwise(content), pattern, F.lit(f"{_BEGIN}$0{_END}")), _END, -1)


def match_starts(content: Column, pattern: str, flags: str = "") -> Column:
    """``array<int>``: where matches begin, in order. Patterns must not match nothing or look behind."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, p: F.when(p.contains(_BEGIN), F.struct((a["at"] + F.length(p) - 1).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(F.substring_index(p, _BEGIN, 1)))).alias("out"))).otherwise(a)
    return F.aggregate(marked(content, F.lit(js_regex(pattern, flags))), start, add)["out"]


def match_offsets(content: Column, pattern: Column | str, flags: str = "") -> Column:
    """``array<struct<off, line, text>>`` of all matches in order, in linear time. Patterns must not match nothing or look behind; a column holds those of ``js_regex``.

    The content goes through the expression once; lengths and line feeds are summed between the marks.
    """
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    cut = lambda p: F.struct(F.substring_index(p, _BEGIN, 1).alias("gap"), F.substring_index(p, _BEGIN, -1).alias("text"))
    size = lambda h: F.struct((F.length(h["gap"]) + F.length(h["text"])).alias("chars"), (feeds(h["gap"]) + feeds(h["text"])).alias("lines"))
    place = lambda h, s: F.struct((s["chars"] + F.length(h["gap"])).alias("off"), (s["lines"] + feeds(h["gap"]) + 1).alias("line"), h["text"].alias("text"))
    placed = lambda hits: F.zip_with(hits, let(F.transform(hits, size), _sums_before), place)
    return let(marked(content, F.lit(js_regex(pattern, flags)) if isinstance(pattern, str) else pattern), lambda ps: F.when(F.size(ps) > 1, let(F.transform(F.slice(ps, 1, F.size(ps) - 1), cut), placed)).otherwise(F.array().cast("array<struct<off:int,line:int,text:string>>")))


def shannon_entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution."""
    chars = F.array_distinct(F.split(text, ""))
    n = F.length(text)

    def term(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when(c == "", 0.0).otherwise(-p * F.log2(p))

    return F.aggregate(chars, F.lit(0.0), lambda a, c: a + term(c))
