"""Quality rules by compression bands.

Repetitive text compresses far better than prose, random text hardly at all.
Each text is compressed whole and in fixed chunks with zstandard; the ratio
compressed / raw must lie in a band that depends on the length, since short
texts carry the frame's overhead and long ones repeat their own words. Between
the lengths of the table the limits are interpolated by the logarithm of the length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

#: (bytes, lowest ratio, highest ratio), for whole texts and for chunks. From 304 to 13,777 bytes the limits are
#: ``fit_bands`` over the documents of sf0.1 with quality 1 that pass the base rules (3,302), rounded; beyond, where
#: too few have that length, they are set by hand, far below and above the ratios of the few. Random words in
#: base64 have 1.03 at 128 bytes, 0.85 at 512, 0.80 at 1 KB and 0.75 or more beyond.
BANDS = (
    (64, 0.15, 0.98), (128, 0.30, 0.97), (192, 0.40, 0.93), (304, 0.597, 0.794), (431, 0.539, 0.758), (609, 0.530, 0.732), (861, 0.502, 0.679), (1218, 0.487, 0.630), (1722, 0.472, 0.593), (2435, 0.459, 0.571),
    (3444, 0.446, 0.551), (4871, 0.432, 0.522), (6889, 0.422, 0.516), (9742, 0.415, 0.501), (13777, 0.410, 0.492), (32768, 0.385, 0.480), (131072, 0.350, 0.470), (1048576, 0.280, 0.470),
)
CHUNK_BYTES = 4096
#: A text is rejected when more than this share of its bytes is in chunks out of band.
CHUNK_SHARE = 0.1
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more in ``words``.

    Rolling 64-bit sums pick the candidates; the candidates' words are then compared themselves.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * _ODD + h[i : n + i]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in at)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def ratios(text: bytes, packer: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES) -> tuple[float | None, list[tuple[int, float]]]:
    """The whole text's ratio (null when empty), and size and ratio of its chunks."""
    if not text:
        return None, []
    whole = len(packer.compress(text)) / len(text)
    parts = [text[i : i + chunk] for i in range(0, len(text), chunk)] if len(text) > chunk else []
    return whole, [(len(x), len(packer.compress(x)) / len(x)) for x in parts]


def limits(size: int, bands=BANDS) -> tuple[float, float]:
    """Lowest and highest ratio of ``size`` bytes; beyond the table's ends those of its ends."""
    sizes, low, high = zip(*bands, strict=True)
    at = np.log2(size)
    return float(np.interp(at, np.log2(sizes), low)), float(np.interp(at, np.log2(sizes), high))


def _inside(size: int, ratio: float, bands) -> bool:
    low, high = limits(size, bands)
    return low <= ratio <= high


def in_band(size: int, whole: float | None, chunks: list[tuple[int, float]], whole_bands=BANDS, chunk_bands=BANDS, chunk_share: float = CHUNK_SHARE) -> bool:
    if whole is None:
        return False
    out = sum(n for n, r in chunks if not _inside(n, r, chunk_bands))
    return _inside(size, whole, whole_bands) and out <= chunk_share * size


def fit_bands(scored: DataFrame, tail: float = 0.002, below: float = 0.005, above: float = 0.05, least: int = 30) -> list[tuple[int, float, float]]:
    """Bands from ``(n_bytes, ratio)`` of clean texts: for each half octave of lengths, its middle and the ratios' outer quantiles with a margin.

    Half octaves with fewer than ``least`` texts give none; an empty table gives no bands. One row for each half octave reaches the driver.
    """
    octave = F.floor(2 * F.log2("n_bytes"))
    rows = scored.where("n_bytes > 0 and ratio is not null").groupBy(octave.alias("k")).agg(F.percentile_approx("ratio", [tail, 1 - tail], 100_000).alias("q"), F.count(F.lit(1)).alias("n"))
    return [(round(2 ** ((r["k"] + 0.5) / 2)), r["q"][0] - below, r["q"][1] + above) for r in rows.where(F.col("n") >= least).orderBy("k").collect()]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
     ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("chunk_ratio_min", pa.float64()), ("chunk_ratio_max", pa.float64())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_bytes long, n_chunks long, chunk_ratio_min double, chunk_ratio_max double"


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_bands=BANDS, chunk_bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """One row per input row: base counts, compression ratios and the verdict ``kept``.

    Null and empty texts have no words, so the base fails and they aren't kept; their ratio is null. Long texts
    are compressed whole. Rows that repeat are scored each; a null id stays null; only the two columns named are
    read; an empty table gives an empty result. No shuffle; memory is one batch and one text.
    """

    def one(raw: bytes | None, packer: zstandard.ZstdCompressor) -> tuple:
        text = raw or b""
        words = text.split()
        joined = b"".join(words)
        inner = int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        repeats = repeat_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
        whole, chunks = ratios(text, packer, chunk_bytes)
        kept = not failed and in_band(len(text), whole, chunks, whole_bands, chunk_bands, chunk_share)
        each = [r for _, r in chunks]
        return len(words), len(joined) - inner, symbols, duplicate_lines(text), repeats, failed, kept, whole, len(text), len(each), min(each, default=None), max(each, default=None)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        yield from common.arrow_rows(lambda raw: one(raw, packer), SCHEMA)(batches)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, DDL)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and the verdict of every row of ``documents``; cases are defined by ``score_quality``."""
    return score_quality(common.documents(spark, sf_dir))
