"""Scopes and the places inside them as tables, and the join of both within a file.

Scopes of a file are nested, so the join needs no pairs: places, beginnings and ends are sorted once, and a running
count says how deep each place is; the scope around it is the last one that began at that depth. The cost is that of
a sort, however many scopes and places a file has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrid.functions.text import match_offsets
from auditgrid.operators.blocks import with_blocks
from auditgrid.schema import KEYS

#: Order at one place: what ends there, then what begins, then what is there.
_ENDS, _BEGINS, _PLACE = 0, 1, 2
CALL = r"\b[\w$]+(?:\.[\w$]+){0,20}\s*\("
NO_CALL = ("if", "for", "while", "switch", "catch", "function", "return", "with", "await")


def scope_table(files: DataFrame) -> DataFrame:
    """One row per scope of the script files: kind, name, exported, head, and its place as pre and post, post being behind it."""
    return with_blocks(files).select(*KEYS, F.explode("blocks").alias("b")).select(*KEYS, "b.kind", "b.name", "b.exported", "b.head", F.col("b.start").alias("pre"), F.col("b.stop").alias("post"))


def calls(code: Column) -> Column:
    """``array<struct<pos, callee>>``: the calls in quiet code, by the name or path of names that is called."""
    found = F.transform(match_offsets(code, CALL), lambda m: F.struct(m["off"].alias("pos"), F.regexp_extract(m["text"], r"^[\w$.]+", 0).alias("callee")))
    return F.filter(found, lambda c: ~c["callee"].isin(*NO_CALL))


def places(code: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """``array<struct<pos, pattern>>`` of all matches of some patterns (expression, flags); pattern is its number."""

    def of(number: int, regex: str, flags: str) -> Column:
        return F.transform(match_offsets(code, regex, flags), lambda m: F.struct(m["off"].alias("pos"), F.lit(number).alias("pattern")))

    return F.flatten(F.array(*[of(i, *p) for i, p in enumerate(patterns)]))


def events(blocks: Column, spots: Column, more: str) -> Column:
    """Beginnings and ends of the scopes in ``blocks`` and the places of ``spots`` (structs with pos, and other fields of the type ``more``), in one array."""

    def event(pos: Column, step: int, turn: int, b: Column | None, spot: Column) -> Column:
        of = lambda name, kind: (b[name] if b is not None else F.lit(None)).cast(kind)
        fields = [pos.cast("int").alias("pos"), F.lit(step).alias("step"), F.lit(turn).alias("turn"), of("kind", "string").alias("kind"), of("name", "string").alias("name"), of("start", "int").alias("pre"), of("stop", "int").alias("post")]
        return F.struct(*fields, spot.cast(more).alias("spot"))

    none = F.lit(None)
    whole = F.filter(blocks, lambda b: b["stop"] > b["start"])
    begins = F.transform(whole, lambda b: event(b["start"], 1, _BEGINS, b, none))
    ends = F.transform(whole, lambda b: event(b["stop"], -1, _ENDS, b, none))
    return F.concat(begins, ends, F.transform(spots, lambda s: event(s["pos"], 0, _PLACE, None, s)))


def enclosed(rows: DataFrame, keep: Sequence[str] = KEYS) -> DataFrame:
    """The places among ``rows`` (keys and the fields of ``events``) with the innermost function and the innermost loop around them.

    function and loop are ``struct<kind, name, pre, post>``, null where there is none; iteration callbacks count as
    functions. One shuffle by file; files are bounded by the scan.
    """
    order = ("pos", "turn", "post")
    by_file = Window.partitionBy(*keep).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_loop = F.col("kind") == "loop"
    begins = F.col("turn") == _BEGINS
    scope = F.struct("kind", "name", "pre", "post")
    out = rows
    for name, mine in (("function", ~is_loop), ("loop", is_loop)):
        out = out.withColumn("depth", F.sum(F.when(mine, F.col("step")).otherwise(0)).over(by_file))
        at_depth = Window.partitionBy(*keep, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(name, F.last(F.when(begins & mine, scope), ignorenulls=True).over(at_depth)).withColumn(name, F.when(F.col("depth") > 0, F.col(name)))
    return out.where(F.col("turn") == _PLACE).select(*keep, "spot", "function", "loop")


def inner_kind() -> Column:
    """The kind of the innermost scope of a row of ``enclosed``; null outside all."""
    return F.when(F.col("loop.pre") > F.coalesce("function.pre", F.lit(-1)), "loop").otherwise(F.col("function.kind"))


def call_scopes(files: DataFrame) -> DataFrame:
    """Every call of the script files with the function and the loop around it: KEYS, pos, callee, function, function_pre, loop_pre."""
    rows = with_blocks(files)
    spot = "struct<pos:int,callee:string>"
    swept = enclosed(rows.select(*KEYS, F.explode(events(F.col("blocks"), calls(F.col("code")), spot)).alias("e")).select(*KEYS, "e.*"))
    return swept.select(*KEYS, "spot.pos", "spot.callee", F.col("function.name").alias("function"), F.col("function.pre").alias("function_pre"), F.col("loop.pre").alias("loop_pre"))


def unguarded(files: DataFrame, dangers: Sequence[tuple[str, str]], guards: Sequence[tuple[str, str]]) -> DataFrame:
    """Dangerous places whose innermost function holds no guard: KEYS, pos, danger (the pattern's number), function, function_pre.

    Both kinds of places get their function from one sweep; a place goes by an anti join on the file and the function.
    Places outside all functions have no guard.
    """
    n = len(dangers)
    spot = "struct<pos:int,pattern:int>"
    rows = with_blocks(files)
    swept = enclosed(rows.select(*KEYS, F.explode(events(F.col("blocks"), places(F.col("code"), [*dangers, *guards]), spot)).alias("e")).select(*KEYS, "e.*"))
    swept = swept.select(*KEYS, "spot.*", F.col("function.name").alias("function"), F.coalesce("function.pre", F.lit(-1)).alias("function_pre"))
    safe = swept.where((F.col("pattern") >= n) & (F.col("function_pre") >= 0)).select(*[F.col(k).alias(f"g_{k}") for k in KEYS], F.col("function_pre").alias("g_pre")).distinct()
    same = (F.col("file_id") == F.col("g_file_id")) & F.col("repo").eqNullSafe(F.col("g_repo")) & (F.col("relative_path") == F.col("g_relative_path")) & (F.col("function_pre") == F.col("g_pre"))
    left = swept.where(F.col("pattern") < n).join(safe, same, "left_anti")
    return left.select(*KEYS, "pos", F.col("pattern").alias("danger"), "function", F.when(F.col("function_pre") >= 0, F.col("function_pre")).alias("function_pre"))
