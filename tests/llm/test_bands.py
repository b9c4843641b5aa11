"""Incompressible text is out of band at every length, alone and as a part of a long document; clean prose is in band."""

import base64
import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from auditgrid.llm import common, quality_bands
from tests.llm.tables import corpus, frame

SF = "/root/testdata/sf0.001"


def junk(rnd, n, how):
    out = b""
    while len(out) < n:
        out += how(rnd.randbytes(rnd.randrange(6, 30))) + b" "
    return out[:n].decode()


@pytest.fixture(scope="module")
def prose(spark):
    """Long clean documents."""
    rows = common.documents(spark, SF).join(common.read(spark, SF, "labels").where("quality = 1"), "doc_id").where("length(text) > 2000").orderBy("doc_id").select("text").collect()
    return [r.text for r in rows]


def test_junk_is_rejected_at_every_length_and_inside_long_documents(spark, prose):
    rnd = random.Random(5)
    long = " ".join(prose)
    rows = [junk(rnd, n, base64.b64encode) for n in (700, 1200, 4000, 16_000, 82_000)] + [junk(rnd, n, base64.b85encode) for n in (700, 4000, 16_000)] + [junk(rnd, n, lambda x: x.hex().encode()) for n in (9000, 40_000)]
    rows += [long[:n] + " " + junk(rnd, m, base64.b64encode) for n, m in ((4096, 4096), (40_000, 40_000), (12_000, 2000))]
    got = quality_bands.score_quality(frame(spark, list(enumerate(rows)))).collect()
    assert [r.doc_id for r in got if r.kept or r.base_failed] == []


def test_prose_is_kept(spark, prose):
    got = quality_bands.score_quality(frame(spark, list(enumerate(prose)))).collect()
    assert len(got) > 10 and [r.doc_id for r in got if not r.kept and not r.base_failed] == []


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    found = quality_bands.op1_compression_bands(spark, sf).join(common.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").where("not base_failed")
    return found.select("quality", "kept", "n_bytes", "ratio").cache()


def test_bands_reject_documents_of_low_quality(labelled):
    n = {(r.quality, r.kept): r["count"] for r in labelled.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.7 * (n[0, False] + n[0, True])
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n[None, False] > 0


def test_bands_are_those_of_clean_documents(labelled):
    fitted = quality_bands.fit_bands(labelled.where("quality = 1"))
    kept = {size: (low, high) for size, low, high in quality_bands.BANDS}
    assert len(fitted) == 12
    for size, low, high in fitted:
        assert kept[size] == pytest.approx((low, high), abs=0.004)
    assert quality_bands.fit_bands(labelled.where("false")) == []


def plain_limits(size, bands):
    if size <= bands[0][0]:
        return bands[0][1:]
    for (a, *low), (b, *high) in zip(bands, bands[1:]):
        if a <= size <= b:
            share = (math.log(size) - math.log(a)) / (math.log(b) - math.log(a))
            return tuple(x + share * (y - x) for x, y in zip(low, high))
    return bands[-1][1:]


@pytest.mark.parametrize("chunk", [4096, 300])
def test_ratios_and_verdicts_by_brute_force(spark, prose, chunk):
    rnd = random.Random(9)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 3] + [(1000 + i, t) for i, t in enumerate(prose[:5])]
    rows += [(2000 + i, prose[0][:n] + " " + junk(rnd, m, base64.b64encode) + " " + prose[1][:n]) for i, (n, m) in enumerate(((2000, 100), (2000, 900), (5000, 3000), (300, 300)))]
    got = {r.doc_id: r for r in quality_bands.score_quality(frame(spark, rows), chunk_bytes=chunk).collect()}
    pack = lambda x: len(zstandard.compress(x, quality_bands.LEVEL)) / len(x)
    inside = lambda x: (lambda low, high: low <= pack(x) <= high)(*plain_limits(len(x), quality_bands.BANDS))
    assert len(got) == len(rows) and len({r.kept for r in got.values()}) == 2
    for i, text in rows:
        raw = (text or "").encode()
        if not raw:
            assert got[i].ratio is None and not got[i].kept
            continue
        parts = [raw[k : k + chunk] for k in range(0, len(raw), chunk)] if len(raw) > chunk else []
        fine = inside(raw) and sum(len(x) for x in parts if not inside(x)) <= 0.1 * len(raw)
        assert got[i].ratio == pytest.approx(pack(raw)) and got[i].n_chunks == len(parts)
        assert got[i].kept == (fine and not got[i].base_failed)


def test_columns_of_any_name_and_empty_tables(spark):
    docs = frame(spark, corpus()[:5]).withColumns({"ratio": F.lit(1), "kept": F.lit("x"), "n_words": F.lit(0)})
    assert quality_bands.score_quality(docs).count() == 5
    assert quality_bands.score_quality(docs.where("false")).count() == 0
