"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of all words, at most a
few times its own size, the excess shared again by weight. A document's expected
number of copies follows its value, at most as many as a source may repeat. The
whole part is certain; of the rest, documents are ranked by the odds of a random
number divided by the odds of their inclusion, and those of least rank are taken
until the source has its target of words, a fixed size.

No source is sorted or gathered. The rank is a string of hexadecimal digits; the
rank at which a source is full is found digit by digit, from sums of words over
the next three digits of those ranks that the cut can still lie among.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditgrid.llm import common

WEIGHTS = (1, 2, 3)
#: Copies of a document, and times its size that a source's target may be.
MOST = 3
SEED = "mix"
#: Levels of a document's value beside the least.
LEVELS = 4
#: Hexadecimal digits of the rank that one pass settles.
DIGITS = 3
_KEY = 2**52
_SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def variety(size: Column, distinct: Column) -> Column:
    """A document's value, 1 to ``LEVELS`` + 1: one, and the share of its words that are distinct in steps of a fourth."""
    return F.when(size > 0, 1 + F.floor(LEVELS * distinct / size)).otherwise(1).cast("int")


def _random(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))


def pareto_key(tag: Column, p: Column) -> Column:
    """The random odds over the inclusion odds, q, as 13 hexadecimal digits of q / (1 + q); their order is q's."""
    u = (F.conv(F.substring(tag, 1, 13), 16, 10).cast("long") + 0.5) / float(_KEY)
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.lpad(F.lower(F.hex(F.least(F.floor(q / (1 + q) * float(_KEY)), F.lit(_KEY - 1)))), 13, "0")


def _numbered_sources(sized: DataFrame, tables: common.Tables, weights: tuple[int, ...]) -> DataFrame:
    """``sid, source, source_size, weight``: sid counts the sources by code point, null last."""
    spark = sized.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = (F.col("source").isNull(), F.col("source"))
    at = tables.write(sums.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33).cast("int")
    counts, before, offsets = {r[0]: r[1] for r in at.groupBy(part.alias("p")).count().collect()}, 0, {}  # a row for each partition
    for p in sorted(counts):
        offsets[p], before = before, before + counts[p]
    offset = F.element_at(F.create_map(*[F.lit(x).cast(t) for p, k in offsets.items() for x, t in ((p, "int"), (k, "long"))]), part) if offsets else F.lit(0).cast("long")
    sid = offset + F.col("at").bitwiseAND(F.lit(2**33 - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (sid % len(weights) + 1).cast("int"))
    return at.select(sid.alias("sid"), "source", "source_size", weight.cast("long").alias("weight"))


def _with_targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` with target: the level at which every source has level * weight, or ``most`` times its size where that is less.

    Each pass gives the excess of sources that are full to the others by weight, until no other gets full; two
    sums of each reach the driver.
    """
    full = F.col("source_size") * most
    total, open_ = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, open_ = total or 0, open_ or 1
    level, n_full = total / open_, -1
    while True:
        above = full < F.lit(level) * F.col("weight")
        n, used, open_ = sources.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, full)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == n_full or not open_:
            break
        n_full, level = n, (total - used) / open_
    return sources.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), full.cast("double")))


def _plan(sized: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """For each source and value: whole copies, the inclusion probability of one more, and need: the words that a source's targets lack beyond whole copies.

    Copies are in proportion to the value, at most ``most``.
    """
    levels = sized.groupBy("source", "value").agg(F.sum("size").alias("words")).withColumnRenamed("source", "of")
    levels = levels.join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    down = Window.partitionBy("sid").orderBy(F.desc("value"))
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("value") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    one = F.when(rest > 0, (F.col("target") - most * capped) / rest)
    whole_source = Window.partitionBy("sid")
    levels = levels.withColumn("one", one).withColumn("one", F.max_by("one", F.when(F.col("one") * F.col("value") <= most, F.col("value"))).over(whole_source))
    copies = F.least(F.coalesce(F.col("one") * F.col("value"), F.lit(float(most))), F.lit(float(most)))
    levels = levels.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    need = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source)
    return levels.select("sid", "source", "source_size", "target", "value", "whole", "p", need.alias("need"))


def _cuts(ranked: DataFrame, plan: DataFrame, tables: common.Tables) -> DataFrame:
    """``sid, cut, also``: a source takes the ranks under ``cut``, and the rank that begins with it if ``also``."""
    open_ = tables.write(plan.where("need > 0").select("sid", F.lit("").alias("cut"), "need").distinct(), "open0")
    done, k = [], 0
    while not open_.isEmpty():
        k += 1
        old = open_.withColumnRenamed("cut", "before")
        among = ranked.where(F.col("rank").isNotNull()).join(old, "sid").where(F.substring("rank", 1, DIGITS * (k - 1)) == F.col("before"))
        bins = among.groupBy("sid", F.substring("rank", 1, DIGITS * k).alias("cut"), "need").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        up = Window.partitionBy("sid").orderBy("cut")
        below = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("need", F.col("need") - below).where((F.col("need") > 0) & (F.col("need") <= F.col("words")))
        bins = tables.write(bins, f"bins{k}")
        # A document at the cut is taken if that comes nearer to the target; a source that lacks words still takes all.
        full = bins.where("rows = 1").select("sid", "cut", (2 * F.col("need") >= F.col("words")).alias("also"))
        short = old.join(bins.select("sid"), "sid", "left_anti").select("sid", F.lit("~").alias("cut"), F.lit(False).alias("also"))
        done.append(tables.write(full.union(short), f"cuts{k}"))
        open_ = tables.write(bins.where("rows > 1").select("sid", "cut", "need"), f"open{k}")
    return reduce(DataFrame.union, done) if done else plan.select("sid", F.lit("").alias("cut"), F.lit(False).alias("also")).limit(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, value_col: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per input row.

    Size is the number of words (null and empty texts: 0, never taken more than 0). ``weights`` go to the sources
    by code point, repeating, a null source last. Copies follow ``value_col``, a positive integer (null or less: 1), or
    else ``variety``. A source's taken words differ from its target by at most half the document at the cut; no
    document is taken over ``most`` times. Reruns agree, whatever the partitions: random numbers come from id and
    text; repeated rows have numbers of their own, and which of them is taken can't be told. Extra columns of any
    name have no effect; an empty table gives an empty result.
    """
    tables = common.Tables(docs.sparkSession, "mix")
    value = docs[value_col].cast("int") if value_col else F.lit(None).cast("int")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"), value.alias("given"))
    rows = rows.withColumn("w", F.explode(F.array(words(F.col("text")))))  # computed once for both uses
    size = F.size("w").cast("long")
    of = F.greatest(F.coalesce("given", F.lit(1)), F.lit(1)) if value_col else variety(F.size("w"), F.size(F.array_distinct("w")))
    rows = rows.select("doc_id", "source", size.alias("size"), of.alias("value"), _random(F.col("doc_id"), F.col("text"), seed).alias("tag"), F.monotonically_increasing_id().alias("row"))
    sized = tables.write(rows, "sized")
    sources = tables.write(_with_targets(_numbered_sources(sized, tables, weights), most), "targets")
    plan = tables.write(_plan(sized, sources, most), "plan")
    of = plan.withColumnRenamed("source", "s").withColumnRenamed("value", "v")
    ranked = sized.join(of, F.col("source").eqNullSafe(F.col("s")) & (F.col("value") == F.col("v")))
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), F.concat(pareto_key(F.col("tag"), F.col("p")), "tag", F.lpad(F.hex("row"), 16, "0")))
    ranked = tables.write(ranked.select("doc_id", "size", "source_size", "target", "sid", "whole", rank.alias("rank")), "ranked")
    cuts = tables.write(_cuts(ranked, plan, tables), "cuts")
    tables.drop("ranked", "cuts")
    more = F.coalesce((F.col("rank") < F.col("cut")) | (F.col("also") & F.col("rank").startswith(F.col("cut"))), F.lit(False))
    return ranked.join(cuts, "sid", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + more.cast("long"))).alias("taken"))


def op11_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every row of ``documents``; cases are defined by ``mix``."""
    return mix(common.documents(spark, sf_dir))


SQL = rf"""
WITH w AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS tag FROM documents
), d AS (
  SELECT doc_id, source, tag, CAST(len(ws) AS BIGINT) AS size,
         CASE WHEN len(ws) > 0 THEN 1 + CAST(floor({LEVELS} * len(list_distinct(ws)) / len(ws)) AS BIGINT) ELSE 1 END AS v FROM w
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} AS weight FROM d GROUP BY source
), filling AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum({MOST} * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s
), water AS (
  SELECT coalesce(max(CAST(total - used AS DOUBLE) / CAST(open AS DOUBLE)) FILTER (WHERE CAST(total - used AS DOUBLE) / CAST(open AS DOUBLE) * weight <= {MOST} * source_size), 0) AS lvl FROM filling
), t AS (
  SELECT source, source_size, least(lvl * weight, CAST({MOST} * source_size AS DOUBLE)) AS target FROM s, water
), lv AS (
  SELECT source, v, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, v
), l1 AS (
  SELECT lv.*, t.source_size, t.target,
         coalesce(sum(words) OVER (PARTITION BY lv.source ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(v * words) OVER (PARTITION BY lv.source ORDER BY v DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM lv JOIN t ON lv.source IS NOT DISTINCT FROM t.source
), l2 AS (
  SELECT *, CASE WHEN rest > 0 THEN (target - CAST({MOST} * capped AS DOUBLE)) / CAST(rest AS DOUBLE) END AS one0 FROM l1
), l3 AS (
  SELECT *, max_by(one0, v) FILTER (WHERE one0 * v <= {MOST}) OVER (PARTITION BY source) AS one FROM l2
), l4 AS (
  SELECT *, least(coalesce(one * v, {MOST}), {MOST}) AS copies FROM l3
), l5 AS (
  SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p, target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS need FROM l4
), u AS (
  SELECT d.*, l5.source_size, l5.target, l5.whole, l5.need, p,
         (CAST('0x' || substr(tag, 1, 13) AS BIGINT) + 0.5) / {float(_KEY)!r} AS u
  FROM d JOIN l5 ON d.source IS NOT DISTINCT FROM l5.source AND d.v = l5.v
), q AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM u
), k AS (
  SELECT *, floor(q / (1 + q) * {float(_KEY)!r}) AS key FROM q
), c AS (
  SELECT *, sum(CASE WHEN key IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, tag ROWS UNBOUNDED PRECEDING) AS upto FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN key IS NOT NULL AND need > upto - size AND (upto <= need OR 2 * (need - (upto - size)) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
