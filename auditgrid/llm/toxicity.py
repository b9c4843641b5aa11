"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs
inside words to the letters they stand for. The lexicon holds whole words and
word beginnings, weighted by their log odds between toxic and clean labelled
documents. A word counts once, by its heaviest term, unless an exception phrase
covers it. The total, alone and by length, goes through a logistic curve.

Fitting reads about ``SAMPLE`` labelled rows (documented bound), which bounds the
lexicon as well; near copies among them count once, so a copied document doesn't
make its words toxic. Nothing depends on the order or the partitions of the rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

#: Labelled rows that a fit reads at most, about.
SAMPLE = 16_000
PREFIXES = (4, 5, 6)
MIN_LOG_ODDS = 3.5
MIN_SUPPORT = 5
#: The least share of toxic documents that a term occurs in.
MIN_SHARE = 0.01
THRESHOLD = 0.3

#: Letters that look like Latin ones: fixed values.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝαοινρτκｅａｏｉ", "aeopcyxijsdhqwaoivptkeaoi", strict=True))
#: Digits and signs that stand for letters: fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_HOMOGLYPHS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(DIGITS)
# A run of letters, digits and signs in which a digit or sign follows; each run is looked at once, from its beginning.
_MIXED = re.compile(r"(?<![\w@$])[^\W\d]*+[\d@$][\w@$]*+")
_WORD = re.compile(r"[^\W_]+")
_NEXT_WORD = re.compile(r"[\W_]*+([^\W_]++)")
_STAND_IN = re.compile(r"[0134578@$]")


def fold(text: str | None) -> str:
    """In time linear in the text: a word that has letters gets letters for its digits and signs too, a number stays."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_HOMOGLYPHS)
    if _STAND_IN.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_DIGITS) if any(map(str.isalpha, m[0])) else m[0], text)
    return text


@dataclass
class Lexicon:
    """terms: folded word, or word beginning with ``*`` at its end, to weight. exceptions: folded two-word phrases."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-5.0, 2.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.terms:
            return None
        out = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, float]]] = {}
        for term, weight in self.terms.items():
            by_text.setdefault(term.rstrip("*"), []).append((term.endswith("*"), weight))
        for text, ways in by_text.items():
            out.add_word(text, (len(text), ways))
        out.make_automaton()
        return out

    def matches(self, text: str, automaton: ahocorasick.Automaton | None) -> dict[int, tuple[float, int]]:
        """Of a folded text: start of each matched word, its weight and end; exception phrases taken out."""
        found: dict[int, tuple[float, int]] = {}
        if automaton is None:
            return found
        n = len(text)
        for end, (size, ways) in automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            whole = end + 1 == n or not text[end + 1].isalnum()
            weight = max((w for beginning, w in ways if beginning or whole), default=0.0)
            if weight > found.get(start, (0.0, 0))[0]:
                found[start] = (weight, end + 1)
        if self.exceptions and found:
            found = {s: v for s, v in found.items() if not any(p in self.exceptions for p in phrases(text, s))}
        return found

    def evidence(self, text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
        """Of a folded text: log of one plus the total weight, and of one plus the weight in a hundred words."""
        total = sum(w for w, _ in self.matches(text, automaton).values())
        return math.log1p(total), math.log1p(100 * total / max(1, len(text.split()))) if total else 0.0

    def score(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * evidence[0] + c * evidence[1]))))


def phrases(text: str, start: int) -> list[str]:
    """The word that begins at ``start`` with the word before it, and with the word after it; words count whole."""
    end = _WORD.match(text, start).end()
    word = text[start:end]
    after = _NEXT_WORD.match(text, end)
    stop = start
    while stop and not text[stop - 1].isalnum():
        stop -= 1
    begin = stop
    while begin and text[begin - 1].isalnum():
        begin -= 1
    return [f"{text[begin:stop]} {word}"] * (begin < stop) + ([f"{word} {after[1]}"] if after else [])


def _copies_mark(text: str) -> list[int]:
    """Three least hashes over five-word shingles: near copies mostly agree in all of them, texts that share a passage don't."""
    words = text.split()
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    h = np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), np.uint64, len(shingles))
    return [int((h * np.uint64(2 * k + 1) ^ (h >> np.uint64(7 * k + 1))).min().view(np.int64)) for k in range(3)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text, doc_id) to a row of (toxic, marks, features, doc_id) for each text."""
    common.release_state()
    for batch in batches:
        toxic, marks, features = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1), as_bytes=False), strict=True):
            folded = fold(text)
            words = {w for w in _WORD.findall(folded) if len(w) > 2}
            toxic.append(label)
            marks.append(_copies_mark(folded))
            features.append(sorted(words | {w[:k] + "*" for k in PREFIXES for w in words if len(w) >= k}))
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(features, pa.list_(pa.string())), batch.column(2)], names=["toxic", "marks", "features", "doc_id"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit_lexicon(labelled: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from ``(doc_id, text, toxic)``; labels other than 0 and 1 don't count, nor do null ones.

    Null and empty texts have no terms but count as documents. Of rows that agree in all marks (near copies and rows
    that repeat) the one with the least doc_id stays, null first, then the lesser label. Terms and phrases are bounded
    by the labelled rows. Without labels of both kinds (an empty table too) the lexicon is empty and every text scores the same.
    """
    rows = labelled.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    seen = rows.select("toxic", "text", "doc_id").mapInArrow(_counted, "toxic int, marks array<long>, features array<string>, doc_id long")
    # Of rows that agree in all marks the least doc_id stays, whatever the shuffle brings first.
    seen = seen.groupBy("marks").agg(F.min(F.struct("doc_id", "toxic", "features")).alias("s"))
    tables = common.Tables(labelled.sparkSession, "toxicity")
    seen = tables.write(seen.select("s.toxic", "s.features"), "features")
    n1, n0 = seen.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n1 or not n0:
        return Lexicon(exceptions=frozenset(map(fold, exceptions)))
    counts = seen.select("toxic", F.explode("features").alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("t") + 1.0) / (n0 + 2))
    least = max(MIN_SUPPORT, MIN_SHARE * n1)
    top = counts.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    terms = {r["term"]: r["odds"] for r in top.orderBy("term").collect()}
    tables.drop()
    lexicon = Lexicon(terms, frozenset(map(fold, exceptions)))

    def phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_state()
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1), as_bytes=False), strict=True):
                folded = fold(text)
                out += [(label, p) for p in {p for s in lexicon.matches(folded, automaton) for p in phrases(folded, s)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["toxic", "phrase"])

    by_phrase = rows.select("toxic", "text").mapInArrow(phrase_rows, "toxic int, phrase string").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    mild = by_phrase.where("n - t >= 3 and n - t >= 20 * t").collect()
    lexicon.exceptions |= {r["phrase"] for r in mild}

    def evidence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [lexicon.evidence(fold(t), automaton) for t in common.texts_of(batch.column(1), as_bytes=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["toxic", "x", "y"])

    points = rows.select("toxic", "text").mapInArrow(evidence_rows, "toxic int, x double, y double").groupBy("toxic", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    points = sorted(points.collect())  # a sum's last digits depend on its order
    x = np.array([(1.0, p["x"], p["y"]) for p in points for _ in range(min(p["n"], sample))])
    y = np.array([p["toxic"] for p in points for _ in range(min(p["n"], sample))], float)
    lexicon.curve = _logistic(x, y)
    return lexicon


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``, one row per input row, repeated ones too; null and empty texts score as texts without a match.

    Long texts and words are read whole, in linear time; a null id stays null; only the two columns named are read; an
    empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        yield from common.arrow_rows(lambda t: (lexicon.score(lexicon.evidence(fold(t), automaton)),), SCHEMA, as_bytes=False)(batches)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under ``threshold``.

    Each row counts by its own text, so rows that repeat or share an id stay or go by themselves, and null ids are no
    case of their own; null and empty texts score as texts without a match. An empty table stays empty. No shuffle.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_state()
        automaton = lexicon.automaton()
        for batch in batches:
            stays = [lexicon.score(lexicon.evidence(fold(t), automaton)) < threshold for t in common.texts_of(batch.column(at), as_bytes=False)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic``: about ``sample`` labelled documents outside the held-out fold.

    Null ids and labels don't count. An id labelled twice counts by its higher label, and of several rows with one id
    the least text counts (nulls last), so an id with very many rows is still one document.
    """
    tables = common.Tables(docs.sparkSession, "toxicity")
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = tables.write(common.bounded_sample(known.where(~common.held_out(2, 4)), sample, "doc_id"), "sample")
    # Bounded by ``sample``, so it may be broadcast.
    found = common.id_and_text(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return tables.write(found.select("doc_id", "text", "toxic"), "training")


def learnt(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon that ``training_rows`` give; their tables go."""
    with common.scratch() as made:
        lexicon = fit_lexicon(training_rows(docs, labels))
    common.drop_all(made)
    return lexicon


def op6_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every row of ``documents``; cases are defined by ``score_toxicity`` and ``fit_lexicon``."""
    docs = common.documents(spark, sf_dir)
    lexicon = learnt(docs, common.read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", common.held_out(2, 4).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
