"""Five stages from raw documents to packed training sequences.

Each stage works on all that its predecessor kept; the first four return the
columns of ``documents``, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditgrid.llm import best_fit_packing, common, exact_dedup, simhash, substring_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express these stages; tests/llm/test_pipeline.py holds ``run`` and each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold, by ``toxicity.keep_clean``; the lexicon is learnt from labelled rows outside the held-out fold."""
    lexicon = toxicity.learnt(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), lexicon)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that ``exact_duplicates`` keeps."""
    return exact_dedup.keep_one(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the least id; rows with a null id stay."""
    return simhash.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that documents with smaller ids have; n_chars follows the text."""
    return substring_dedup.without_repeats(docs.select(*COLUMNS)).select(*COLUMNS)


#: Bytes that packing's workers remember of chunks; the executors' memory is full of the stages before.
PACKING_KEEPS = 24_000_000


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and their place in sequences of at most 2048 tokens."""
    return best_fit_packing.pack(docs, keep_bytes=PACKING_KEEPS, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    Once a stage is written, its own tables and its predecessor's go; what the last one writes stays for its reader.
    """
    tables = common.Tables(spark, "pipeline")
    docs = common.documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        with common.scratch() as made:
            docs = tables.write(stage(spark, docs, sf_dir), name)
        common.drop_all(made)
        tables.drop(name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    tables.drop()
    return out
