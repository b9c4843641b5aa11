"""Guards across files: a repository's modules as a graph, and the functions from which a check of the user is reached.

A function is guarded if its own code checks the user, or if it calls, in any file of its repository, a function that is
guarded. Names are resolved as modules do: imports to the files that they name, through files that only pass a name on.
The guarded functions are a fixed point: each round follows the edges back from what the last one added, over written
tables, until nothing is new. Rounds are as many as the longest chain of calls and imports that leads to a guard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrid.functions.text import js_regex, matches
from auditgrid.operators import scopes
from auditgrid.operators.blocks import with_blocks
from auditgrid.rules.scope_rules import AUTH_GUARD, GUARD_MEMBER
from auditgrid.rules.spec import CODE
from auditgrid.schema import KEYS
from auditgrid.sources.shared import Written

IMPORT = r"\bimport\s+([^;'\"]+?)\s+from\s*['\"]([^'\"\n]+)['\"]"
REQUIRE = r"\b(?:const|let|var)\s+(\{[^{}]*\}|[\w$]+)\s*=\s*require\s*\(\s*['\"]([^'\"\n]+)['\"]\s*\)"
PASSED_ON = r"\bexport\s*\{([^{}]*)\}\s*from\s*['\"]([^'\"\n]+)['\"]"
ALL_PASSED_ON = r"\bexport\s*\*\s*from\s*['\"]([^'\"\n]+)['\"]"
EXPORTED = r"\bexport\s*\{([^{}]*)\}(\s*from\b)?"
DEFAULT = r"\bexport\s+default\s+(?!async\b|function\b|class\b|new\b)([\w$]+)\s*(?:;|\n|\z)"
NAMED = r"(?:\btype\s+)?([\w$]+)(?:\s*(?:\bas\b|:)\s*([\w$]+))?"
#: Stands for all of a module's names.
ALL = "*"
_SPOT = "struct<pos:int,callee:string,child:int,guard:boolean>"


def module_key(path: Column) -> Column:
    """A file's name as imports give it: without its extension, and a folder for its index."""
    return F.regexp_replace(F.regexp_replace(path, r"(?i)\.(?:d\.)?[mc]?[jt]sx?\z", ""), r"(?:^|/)index\z", "")


def _joined_path(parts: Column) -> Column:
    step = lambda at, x: F.when(x == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).when(x.isin("", "."), at).otherwise(F.concat(at, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved(path: Column, spec: Column) -> Column:
    """The modules that ``spec`` may name in the file ``path``: relative ones, and those below the root or ``src``; packages name none."""
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    at_root = F.regexp_replace(spec, r"^[@~]/", "")
    found = F.when(spec.rlike(r"^\.\.?(?:/|\z)"), F.array(F.concat(folder, spec))).when(spec.rlike(r"^[@~]/"), F.array(at_root, F.concat(F.lit("src/"), at_root))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda p: module_key(_joined_path(F.split(p, "/"))))


def _pairs(code: Column, pattern: str, first: int, second: int) -> Column:
    """``array<struct<a, b>>``: two groups of every match."""
    of = lambda group: F.regexp_extract_all(code, F.lit(js_regex(pattern)), F.lit(group))
    return F.arrays_zip(of(first).alias("a"), of(second).alias("b"))


def _names(clause: Column) -> Column:
    """``array<struct<a, b>>``: the names in braces, and what each is called from there on."""
    inside = F.regexp_extract(clause, r"\{([^{}]*)\}", 1)
    return F.transform(_pairs(inside, NAMED, 1, 2), lambda x: F.struct(x["a"].alias("name"), F.when(x["b"] != "", x["b"]).otherwise(x["a"]).alias("local")))


def _bound(clause: Column, spec: Column, whole: Column) -> Column:
    """What an import binds: ``array<struct<spec, name, local>>``; ``whole`` is the name for a name without braces."""
    bind = lambda name, local: F.struct(spec.alias("spec"), name.alias("name"), local.alias("local"))
    single = F.regexp_extract(clause, r"^(?:type\s+)?([\w$]+)", 1)
    star = F.regexp_extract(clause, r"\*\s+as\s+([\w$]+)", 1)
    named = F.transform(_names(clause), lambda x: bind(x["name"], x["local"]))
    return F.concat(named, F.when(single != "", F.array(bind(whole, single))).otherwise(F.array()), F.when(star != "", F.array(bind(F.lit(ALL), star))).otherwise(F.array()))


def bindings(rows: DataFrame) -> DataFrame:
    """``repo, module, local, target, name``: the names that files bind to names of other modules; ``rows`` have code."""
    imported = F.flatten(F.transform(_pairs(F.col("code"), IMPORT, 1, 2), lambda x: _bound(x["a"], x["b"], F.lit("default"))))
    required = F.flatten(F.transform(_pairs(F.col("code"), REQUIRE, 1, 2), lambda x: _bound(x["a"], x["b"], F.lit(ALL))))
    out = rows.select("repo", "relative_path", "module", F.explode(F.concat(imported, required)).alias("x"))
    return out.select("repo", "module", F.col("x.local").alias("local"), F.explode(resolved(F.col("relative_path"), F.col("x.spec"))).alias("target"), F.col("x.name").alias("name"))


def _node(kind: str, module: Column, name: Column) -> Column:
    """f: a function by its place; b: a name inside a module; s: a name that it gives to others."""
    return F.concat_ws("|", F.lit(kind), module, name.cast("string"))


def _edges(rows: DataFrame, functions: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``repo, source, target``: what a node reaches at once; and ``repo, module, target`` of modules that pass on all names of another."""
    m, name = F.col("module"), F.col("name")
    edge = lambda df, source, target: df.select("repo", source.alias("source"), target.alias("target"))
    bound = bindings(rows)
    passed = rows.select("repo", "relative_path", "module", F.explode(_pairs(F.col("code"), PASSED_ON, 1, 2)).alias("p"))
    passed = passed.select("repo", "module", F.col("p.a").alias("clause"), F.explode(resolved(F.col("relative_path"), F.col("p.b"))).alias("target"))
    passed = passed.select("repo", "module", "target", F.explode(_names(F.concat(F.lit("{"), F.col("clause"), F.lit("}")))).alias("x"))
    own = rows.select("repo", "module", F.explode(F.filter(_pairs(F.col("code"), EXPORTED, 1, 2), lambda x: x["b"] == "")).alias("p")).select("repo", "module", F.explode(_names(F.concat(F.lit("{"), F.col("p.a"), F.lit("}")))).alias("x"))
    default = rows.select("repo", "module", F.explode(F.regexp_extract_all("code", F.lit(js_regex(DEFAULT)), F.lit(1))).alias("local"))
    stars = rows.select("repo", "relative_path", "module", F.explode(F.regexp_extract_all("code", F.lit(js_regex(ALL_PASSED_ON)), F.lit(1))).alias("spec")).select("repo", "module", F.explode(resolved(F.col("relative_path"), F.col("spec"))).alias("target"))
    calls = spots.where("callee is not null and pre is not null").select("repo", "module", "pre", F.split("callee", r"\.").alias("path"))
    direct = calls.where(F.size("path") == 1).select("repo", "module", "pre", F.col("path")[0].alias("name"))
    member = calls.where(F.size("path") == 2).select("repo", "module", "pre", F.col("path")[0].alias("local"), F.col("path")[1].alias("member"))
    whole = bound.where(name.isin(ALL, "default"))
    members = member.join(whole, ["repo", "module", "local"])
    here = functions.where("name not in ('anonymous', 'default')")
    parts = [
        edge(spots.where("child is not null and pre is not null and child <> pre"), _node("f", m, F.col("pre")), _node("f", m, F.col("child"))),
        edge(direct, _node("f", m, F.col("pre")), _node("b", m, name)),
        edge(members, _node("f", m, F.col("pre")), _node("s", F.col("target"), F.col("member"))),
        edge(here, _node("b", m, name), _node("f", m, F.col("pre"))),
        edge(functions.where("name <> 'anonymous'"), _node("s", m, name), _node("f", m, F.col("pre"))),
        edge(functions.where("is_default"), _node("s", m, F.lit("default")), _node("f", m, F.col("pre"))),
        edge(bound, _node("b", m, F.col("local")), _node("s", F.col("target"), F.when(name == ALL, "default").otherwise(name))),
        edge(passed, _node("s", m, F.col("x.local")), _node("s", F.col("target"), F.col("x.name"))),
        edge(own, _node("s", m, F.col("x.local")), _node("b", m, F.col("x.name"))),
        edge(default, _node("s", m, F.lit("default")), _node("b", m, F.col("local"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct(), stars.distinct()


def _escaped(name: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in name)


def guarded_functions(files: DataFrame, custom: Sequence[str] = (), rounds: int = 1000) -> DataFrame:
    """The functions of script files that check the user, themselves or through others: KEYS, name, head, pre.

    ``custom`` names further guards. Repositories don't meet; a null repository is one of its own. Calls in circles end
    with the rounds, imports of files that aren't there lead nowhere, and names outside functions guard nothing.
    """
    written = Written(files.sparkSession, "modules")
    code = F.col("code")
    guards = [(r"\b\w*" + AUTH_GUARD + r"\s*\(", ""), (GUARD_MEMBER, ""), *([(r"\b(?:" + "|".join(_escaped(c) for c in custom) + r")\s*\(", "")] if custom else [])]
    rows = with_blocks(files.where(F.col("content").isNotNull() & matches(F.col("relative_path"), CODE, "i")))
    rows = rows.select(*KEYS, F.coalesce("repo", F.lit("")).alias("of"), module_key(F.col("relative_path")).alias("module"), "code", "blocks")
    rows = written.table(rows, "scripts")
    spot = lambda pos, callee=None, child=None, guard=False: F.struct(pos.cast("int").alias("pos"), (F.lit(None) if callee is None else callee).cast("string").alias("callee"), (F.lit(None) if child is None else child).cast("int").alias("child"), F.lit(guard).alias("guard"))
    spots = F.concat(
        F.transform(scopes.calls(code), lambda c: spot(c["pos"], callee=c["callee"])), F.transform(F.filter("blocks", lambda b: b["kind"] != "loop"), lambda b: spot(b["head"], child=b["start"])),
        F.transform(scopes.places(code, guards), lambda g: spot(g["pos"], guard=True)),
    )
    keep = (*KEYS, "of", "module")
    swept = scopes.enclosed(rows.select(*keep, F.explode(scopes.events(F.col("blocks"), spots, _SPOT)).alias("e")).select(*keep, "e.*"), keep)
    swept = written.table(swept.select(F.col("of").alias("repo"), "module", F.col("function.pre").alias("pre"), "spot.callee", "spot.child", "spot.guard"), "spots")
    functions = rows.select(F.col("of").alias("repo"), "module", "code", F.explode(F.filter("blocks", lambda b: b["kind"] != "loop")).alias("b"))
    functions = functions.select("repo", "module", F.col("b.name").alias("name"), F.col("b.start").alias("pre"), F.substring("code", F.col("b.head") + 1, F.lit(40)).rlike(r"^export\s+default\b").alias("is_default"))
    edges, stars = _edges(rows.drop("repo").withColumnRenamed("of", "repo"), functions, swept)
    edges, stars = written.table(edges, "edges"), written.table(stars, "stars")
    new = written.table(swept.where("guard and pre is not null").select("repo", _node("f", F.col("module"), F.col("pre")).alias("node")).distinct(), "round0")
    reached = new
    for k in range(1, rounds + 1):
        back = edges.join(new.withColumnRenamed("node", "target"), ["repo", "target"]).select("repo", F.col("source").alias("node"))
        given = new.where(F.col("node").startswith("s|")).select("repo", F.split("node", r"\|").alias("n")).select("repo", F.col("n")[1].alias("target"), F.col("n")[2].alias("name")).where("name <> 'default'")
        through = stars.join(given, ["repo", "target"]).select("repo", _node("s", F.col("module"), F.col("name")).alias("node"))
        new = written.table(back.union(through).distinct().join(reached, ["repo", "node"], "left_anti"), f"round{k}")
        if new.isEmpty():
            break
        reached = reached.union(new)
    else:
        raise RuntimeError("the guards did not settle")
    found = rows.select(*KEYS, "of", "module", F.explode(F.filter("blocks", lambda b: b["kind"] != "loop")).alias("b")).select(*KEYS, "of", "b.name", "b.head", F.col("b.start").alias("pre"), _node("f", F.col("module"), F.col("b.start")).alias("node"))
    return found.join(reached.withColumnRenamed("repo", "of"), ["of", "node"], "left_semi").select(*KEYS, "name", "head", "pre")


def across_files(findings: DataFrame, guarded: DataFrame) -> DataFrame:
    """``findings`` without those of missing-auth about handlers that ``guarded_functions`` name."""
    g = guarded.select(*[F.col(k).alias(f"g_{k}") for k in KEYS], F.col("name").alias("g_name"), F.col("head").alias("g_head"))
    same = (F.col("file_id") == F.col("g_file_id")) & F.col("repo").eqNullSafe(F.col("g_repo")) & (F.col("relative_path") == F.col("g_relative_path")) & (F.col("finding_ord") % 10_000_000 == F.col("g_head"))
    return findings.join(g, same & (F.col("rule_id") == "missing-auth") & F.col("message").contains(F.concat(F.lit("handler "), F.col("g_name"))), "left_anti")
