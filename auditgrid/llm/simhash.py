"""SimHash near-duplicates with pivot distance tables.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's
three-word shingles. Each distinct fingerprint gets a row of Hamming distances
to fixed reference fingerprints (pivots). By the triangle inequality two
fingerprints at distance d differ by at most d in every coordinate, so a pair
with a larger difference in any coordinate is discarded before it is verified.

Coordinates alone can't name candidates at scale: a distance to a pivot holds
little more than two bits, so buckets of eight coordinates would have to be looked
up with 3**8 neighbours each. So the pairs that meet are those that agree in four
of six bands, as all within two bits do. Four bands fix 42 bits or more: a bucket
never has more than 2**22 members, however many texts there are. In a bucket a
pair meets only if its first coordinates can be within two bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common
from auditgrid.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
N_PIVOTS = 16
#: Bits of the fingerprint's bands, of which a pair within ``MAX_BITS`` bits agrees in all but that many.
BANDS = (11, 11, 11, 11, 10, 10)
#: Hashes whose bits are counted at once.
AT_ONCE = 65536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first; zeros for a text without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, and split() parts at \x20 \x09-\x0D
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    count = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, AT_ONCE):
        h = np.fromiter((digest(joined[s:e], SEED) for _, (s, e) in zip(range(min(AT_ONCE, n - i)), spans, strict=False)), np.uint64, min(AT_ONCE, n - i))
        count += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > n).tobytes()


SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, fp)``, one row per input row, and row where ``row_col`` numbers them; null and empty texts have fingerprint zero."""
    schema, ddl = (SCHEMA.append(pa.field("row", pa.int64())), "doc_id long, fp long, row long") if row_col else (SCHEMA, "doc_id long, fp long")
    run = common.arrow_rows(lambda raw: (int.from_bytes(fingerprint(raw), "big", signed=True),), schema)
    return common.id_and_text(docs, id_col, text_col, row_col).mapInArrow(run, ddl)


def pivots(n: int = N_PIVOTS) -> list[int]:
    """``n`` reference fingerprints as signed 64-bit numbers; the same in every run."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED)).astype(np.int64)) for i in range(n)]


def distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _band_keys(fp: Column) -> list[Column]:
    """The 15 choices of four bands, each with its bits and a number that tells the choices apart."""
    band = [F.shiftrightunsigned(fp, sum(BANDS[:i])).bitwiseAND((1 << width) - 1) for i, width in enumerate(BANDS)]

    def joined(k: int, chosen: tuple[int, ...]) -> Column:
        return reduce(lambda key, i: F.shiftleft(key, BANDS[i]).bitwiseOR(band[i]), chosen, F.lit(k).cast("long"))

    return [joined(k, chosen) for k, chosen in enumerate(combinations(range(len(BANDS)), len(BANDS) - MAX_BITS))]


def distance_table(candidates: DataFrame, n_pivots: int = N_PIVOTS) -> DataFrame:
    """``candidates`` (with fp) and the distances of fp to each pivot, p0, p1 and so on."""
    return candidates.select("*", *[distance(F.col("fp"), F.lit(p)).cast("tinyint").alias(f"p{i}") for i, p in enumerate(pivots(n_pivots))])


def links(prints: DataFrame, tables: common.Tables, n_pivots: int = N_PIVOTS) -> DataFrame:
    """``(a, b)``, a < b: all pairs of the distinct fingerprints ``fp`` within ``MAX_BITS`` bits, some more than once."""
    members = prints.select("fp", F.explode(F.array(*_band_keys(F.col("fp")))).alias("key"))
    # Written, so that Spark knows its size: it broadcasts the keys where they are few and shuffles both sides otherwise.
    shared = tables.write(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    # Few fingerprints share a bucket; their distances are computed once and written before any pair is made.
    table_ = tables.write(distance_table(members.join(shared, "key"), n_pivots), "distances")
    apart = MAX_BITS + 1
    slot = F.floor(F.col("p0") / apart).cast("int")
    left = table_.select("key", slot.alias("slot"), F.col("fp").alias("a"), *[F.col(f"p{i}").alias(f"a{i}") for i in range(n_pivots)])
    right = table_.select("key", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"), F.col("fp").alias("b"), *[F.col(f"p{i}").alias(f"b{i}") for i in range(n_pivots)])
    survives = reduce(lambda x, y: x & y, [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= MAX_BITS for i in range(n_pivots)])
    pairs = left.join(right, (left["key"] == right["key"]) & (left["slot"] == right["slot"]) & (F.col("a") < F.col("b")) & survives)
    return pairs.where(distance(F.col("a"), F.col("b")) <= MAX_BITS).select("a", "b")


def _components(prints: DataFrame, tables: common.Tables, n_pivots: int) -> DataFrame:
    """``prints`` with ``root``, one fingerprint for each component, and ``component_id``, the component's least doc_id."""
    classes = tables.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    with common.scratch() as made:
        roots = tables.write(connected_components(links(classes.select("fp"), tables, n_pivots), "a", "b"), "roots")
    common.drop_all(made)
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = roots.join(linked.groupBy("root").agg(F.min("rep").alias("least")), "root").select(F.col("node").alias("fp"), "root", "least")
    ids = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    # Written, so that the last join shuffles both sides anew and Spark can split a fingerprint with very many copies.
    return prints.join(tables.write(ids, "ids"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_pivots: int = N_PIVOTS) -> DataFrame:
    """``doc_id, fp, component_id``: one row per input row.

    component_id is the least doc_id reachable over links of two bits or fewer. Texts without words
    (null and empty ones too) share fingerprint zero and are linked like any other. Rows with equal
    fingerprints meet in one class first, so copies are never paired; repeated rows come out each. A null
    id never names a component unless the component has no other; an empty table gives an empty result.
    """
    tables = common.Tables(docs.sparkSession, "simhash")
    prints = tables.write(fingerprints(docs, id_col, text_col), "prints")
    found = _components(prints, tables, n_pivots).select("doc_id", "fp", "component_id")
    tables.drop("prints", "ids")
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that name their component; rows with a null id stay.

    Where an id occurs more than once, each row counts by its own text; of several that name one component
    (repeated rows too), the first stays. Columns of any name may stand beside the two.
    """
    tables = common.Tables(docs.sparkSession, "simhash")
    numbered, row = common.numbered(docs, tables)
    prints = tables.write(fingerprints(numbered, id_col, text_col, row), "prints")
    found = tables.write(_components(prints, tables, N_PIVOTS).select("doc_id", "row", "root", "component_id"), "found")
    first = found.where("doc_id = component_id").groupBy("root").agg(F.min("row").alias("row")).select("row")
    stays = tables.write(first.union(found.where("doc_id is null").select("row")).withColumnRenamed("row", row), "stays")
    tables.drop("numbered", "stays")
    return numbered.join(stays, row, "left_semi").drop(row)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``documents``; cases are defined by ``near_duplicates``."""
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
