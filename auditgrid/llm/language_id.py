"""Language identification, word first.

A word that the model knows scores by its log frequency in each language. Any
other word backs off to character n-grams: the longest size of which the model
knows a gram, else the next shorter one. Fitting reads about ``SAMPLE`` documents
of each language (documented bound), and characters (documented bounds), which bounds
the model's words and n-grams: nothing else is left out. Rows that repeat count once in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

#: Documents of each language that a fit reads, about.
SAMPLE = 1_000
#: Characters that a fit reads, about, shared by the languages; it has a few terms for ten characters at most, which bounds the model.
SAMPLE_CHARS = 12_000_000
#: A fit reads no longer text, so that chance can't exceed the bound by much.
LONGEST = 100_000
SIZES = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Words whose scores a worker keeps.
CACHE = 300_000
#: Words that are scored at once.
AT_ONCE = 8192
# Runs of letters, and of numerals like "²" or "Ⅷ", which are none: runs that hold such are cut again.
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (``\\p{L}``), in lower case."""
    words = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else _LETTERS.findall(w))]


def grams(word: str, size: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)] if size > 1 else list(word)


class Model:
    """Log frequencies by language: of words (size 0) and of n-grams by size. Only languages that have a term take room for it."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counts: for each size its terms, and rows (the term's number, ascending, the language's number, how often)."""
        self.langs = langs
        self.terms: dict[int, dict[str, int]] = {}
        self.base: dict[int, np.ndarray] = {}
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (terms, term, lang, n) in counts.items():
            self.terms[size] = {t: i for i, t in enumerate(terms)}
            total = np.bincount(lang, weights=n, minlength=len(langs))
            # The log frequency of a term that a language lacks, and what it has more where it doesn't.
            self.base[size] = np.log(0.5 / (total + 0.5 * max(1, len(terms))))
            self.rows[size] = (np.searchsorted(term, np.arange(len(terms) + 1)), lang.astype(np.int32), np.log(n / 0.5 + 1).astype(np.float32))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores of each word in each language, less the word's highest; all words of one size at once."""
        n_langs = len(self.langs)
        out = np.zeros((len(words), n_langs))
        left = list(range(len(words)))
        for size in (0, *SIZES):
            table = self.terms.get(size, {})
            found: list[int] = []
            owners, counts, missed = [], [], []
            for w in left:
                known = [i for g in ([words[w]] if size == 0 else grams(words[w], size)) if (i := table.get(g)) is not None]
                if known:
                    owners.append(w)
                    counts.append(len(known))
                    found += known
                else:
                    missed.append(w)
            left = missed
            if not found:
                continue
            starts, lang, more = self.rows[size]
            ids, times = np.array(found), np.array(counts)
            n = starts[ids + 1] - starts[ids]
            at = np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cells = np.repeat(np.repeat(np.array(owners), times), n) * n_langs + lang[at]
            out += np.bincount(cells, weights=more[at], minlength=out.size).reshape(out.shape)
            out[owners] += times[:, None] * self.base[size]
        return out - out.max(axis=1, keepdims=True) if n_langs else out


class Predictor:
    def __init__(self, model: Model, keep: int = CACHE) -> None:
        self.model, self.keep = model, keep
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)))

    def _learn(self, words: list[str]) -> None:
        words = list(dict.fromkeys(words))
        if len(self.place) + len(words) > self.keep:
            self.place.clear()
        words = [w for w in words if w not in self.place]
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            first = len(self.place)
            while first + len(some) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[first : first + len(some)] = self.model.scores(some)
            self.place.update((w, first + j) for j, w in enumerate(some))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), 100_000):
            some = words[i : i + 100_000]
            self._learn([w for w in some if w not in self.place])
            missing = [w for w in some if w not in self.place]
            if missing:  # the memory was cleared between
                self._learn(some)
            total += self.rows[np.fromiter(map(self.place.__getitem__, some), np.int64, len(some))].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.release_state()
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1), as_bytes=False), strict=True):
            for w, n in Counter(words_of(text)).items():
                counts[lang, w] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) to the counts of its n-grams; the word itself is size 0."""
    common.release_state()
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang, 0, word] += n
            for size in SIZES:
                for g in grams(word, size):
                    counts[lang, size, g] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "size", "term", "n"])


def fit_model(rows: DataFrame) -> Model:
    """A model from ``(text, lang)``; rows whose language or text is null don't count, and a text without letters adds nothing.

    No rows: a model without languages. The model has every word and n-gram of ``rows``, so they should be a bounded sample.
    """
    words = rows.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(_gram_counts, "lang string, size int, term string, n long").groupBy("size", "term", "lang").agg(F.sum("n").alias("n"))
    # One row for each term and language, in Arrow columns: the sample bounds them.
    found = counted.toArrow().combine_chunks()
    langs = sorted(found.column("lang").unique().to_pylist())
    counts = {}
    for size in (0, *SIZES):
        part = found.filter(pc.equal(found.column("size"), size))
        coded = pc.dictionary_encode(part.column("term").combine_chunks())
        term = coded.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        lang = pc.index_in(part.column("lang"), pa.array(langs, pa.string())).to_numpy()
        counts[size] = (coded.dictionary.to_pylist(), term[order], lang[order], part.column("n").to_numpy()[order])
    return Model(langs, counts)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, one row per input row, repeated ones too; ``und`` with score 0 where a text is null or has no letter.

    Long texts are read whole; a null id stays null; of languages that tie the first by name is predicted; only the two
    columns named are read; an empty table gives an empty result. No shuffle. The model is broadcast: the sample bounds it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        yield from common.arrow_rows(predictor.predict, SCHEMA, as_bytes=False)(batches)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id, text, lang``: about ``sample`` documents of each language with text, outside the held-out fold; rows that repeat count once.

    Fewer where they would have more than the language's share of ``chars`` characters; texts over ``LONGEST`` aren't learnt from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~common.held_out(0, 5) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # one row a language: the model's classes
    if not counts:
        return rows
    at_most = {r["lang"]: min(sample, r["n"] * (chars // len(counts)) // max(1, r["chars"])) for r in counts}
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], common.sample_bound(r["n"], max(1, at_most[r["lang"]])))])
    chosen = rows.where(common.sample_hash("doc_id", "text") <= F.element_at(bounds, F.col("lang")))
    return chosen.groupBy("doc_id", "text", "lang").agg(F.count(F.lit(1)).alias("n")).drop("n")


def op10_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every row of ``documents``; cases are defined by ``predict_language``."""
    docs = common.documents(spark, sf_dir)
    found = predict_language(docs, fit_model(training_rows(docs)))
    return found.select("doc_id", common.held_out(0, 5).alias("held_out"), "lang_pred", "score")
