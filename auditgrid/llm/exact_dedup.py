"""Exact dedup by deterministic block naming.

A normalised text is cut into fixed-size blocks. Distinct blocks are sorted and
numbered; then adjacent pairs of names are sorted and numbered, level by level,
until each text has one name. Two texts have the same (length, name) exactly if
they are identical: a 64-bit hash only routes blocks, and blocks whose hash
another block shares are told apart by their content.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

#: Code points of a block.
BLOCK = 4096
WHITE = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")


def normalised(text):
    """``text`` without white space ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w)), WHITE, F.coalesce(text, F.lit("")))


def _blocks(text, block: int):
    return F.when(F.length(text) <= block, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def _numbered(distinct: DataFrame, keys: list[str], tables: common.Tables, name: str) -> DataFrame:
    """Integer names of distinct rows, in the order of ``keys``; gaps between partitions do no harm."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return tables.write(ordered.select(*keys, F.monotonically_increasing_id().alias("name")), name)


def text_names(docs: DataFrame, tables: common.Tables, block: int = BLOCK) -> DataFrame:
    """``row, doc_id, chars, size, sha, name``: (size, name) is one text's identity.

    ``docs`` has (doc_id, text), and row where the caller numbered the rows in a written table. row numbers the
    input rows, so repeated rows stay apart.
    """
    contents = docs.select(F.explode(_blocks(normalised(F.col("text")), block)).alias("block")).select(F.xxhash64("block").alias("hash"), "block")
    # Distinct blocks: one row per content leaves each map task, so copies cost no shuffle.
    hashes = contents.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("contents"))
    hashes = tables.write(hashes, "hashes")
    shared = hashes.where("contents > 1").select("hash")
    collide = not shared.isEmpty()
    given = "row" in docs.columns
    docs = docs if given else docs.withColumn("row", F.monotonically_increasing_id())
    if collide and not given:  # read twice below, so row numbers must stand
        docs = tables.write(docs, "rows_again")
    norm = docs.withColumn("norm", normalised(F.col("text")))
    rows = norm.select(
        "row", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        F.length("norm").cast("long").alias("size"), F.sha2("norm", 256).alias("sha"), F.transform(_blocks(F.col("norm"), block), lambda b: F.xxhash64(b)).alias("hashes"),
    )
    rows = tables.write(rows, "rows")
    names = _numbered(hashes.select("hash"), ["hash"], tables, "names")
    items = rows.select("row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "hash"))
    items = items.join(names, "hash").select("row", "n", "pos", "name")
    if collide:  # different blocks with one hash: their order within the hash completes the name
        apart = contents.join(shared, "hash").select("hash", "block").distinct()
        apart = _numbered(apart, ["hash", "block"], tables, "apart").select("hash", "block", (-F.col("name") - 1).alias("other"))
        numbered = norm.select("row", F.posexplode(_blocks(F.col("norm"), block)).alias("pos", "block"))
        exact = numbered.withColumn("hash", F.xxhash64("block")).join(apart, ["hash", "block"]).select("row", "pos", "other")
        items = items.join(exact, ["row", "pos"], "left").select("row", "n", "pos", F.coalesce("other", "name").alias("name"))
    items = tables.write(items, "level")
    done = []
    while True:
        done.append(items.where("n = 1").select("row", "name"))
        items = items.where("n > 1")
        if items.isEmpty():
            break
        pair = items.groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b")
        )
        # An odd last name stands alone: no second part.
        pair = tables.write(pair.withColumn("alone", F.col("b").isNull()).fillna(0, ["b"]), "pairs")
        names = _numbered(pair.select("alone", "a", "b").distinct(), ["alone", "a", "b"], tables, "names")
        items = pair.join(names, ["alone", "a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
        items = tables.write(items, "level")
    named = reduce(DataFrame.union, done)
    return rows.drop("hashes").join(named, "row")


def _groups(docs: DataFrame, tables: common.Tables, block: int) -> tuple[DataFrame, DataFrame]:
    """The named rows of ``docs`` (doc_id, text, and row if it has one), and for each group of equal texts its kept row."""
    named = tables.write(text_names(docs, tables, block), "named")
    tables.drop("named", "numbered")
    order = F.struct(F.col("chars"), F.col("doc_id").isNotNull(), -F.coalesce("doc_id", F.lit(0)), -F.col("row"))
    groups = named.groupBy("size", "name").agg(F.max(F.struct(order.alias("o"), F.col("doc_id"), F.col("row"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("size", "name", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    # Written, so that joins with it shuffle both sides anew and Spark can split a group with very many copies.
    return named, tables.write(groups, "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per input row, dropped ones too.

    Texts are equal when identical without white space; null counts as empty, and long texts count whole. The
    row with the longest original text stays, then the smallest doc_id (nulls last), then the first of repeated
    rows. An empty table gives an empty result; only the two columns named are read.
    """
    tables = common.Tables(docs.sparkSession, "exact")
    named, groups = _groups(common.id_and_text(docs, id_col, text_col), tables, block)
    alone = groups.where("group_size = 1").select("keep_row")
    copies = named.join(groups.where("group_size > 1"), ["size", "name"])
    one = named.join(alone, F.col("row") == F.col("keep_row"), "left_semi")
    out = one.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return out.union(copies.select("doc_id", "keep_id", "group_size", F.col("row") == F.col("keep_row"), "sha"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_duplicates`` keeps: one of each group, whatever its id.

    Columns of any name may stand beside the two. An empty table stays empty.
    """
    tables = common.Tables(docs.sparkSession, "exact")
    numbered, row = common.numbered(docs, tables)
    _, groups = _groups(common.id_and_text(numbered, id_col, text_col, row), tables, block)
    tables.drop("numbered", "groups")
    return numbered.join(groups.select(F.col("keep_row").alias(row)), row, "left_semi").drop(row)


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every row of ``documents``; cases are defined by ``exact_duplicates``."""
    return exact_duplicates(common.documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
