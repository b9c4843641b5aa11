"""The pipeline as a whole, and each stage on its own input, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from auditgrid.llm import common, toxicity
from tests.llm.tables import corpus, words
from tests.llm.test_keep import plain_cut, plain_keep_exact, plain_keep_near, rows_of, shared_ids
from tests.llm.test_learned import plain_fold, plain_matches

FIELDS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("row_number", pa.int64()), ("tag", pa.string())]


def write(folder, rows, labels):
    full = [(i, t, "en", "s", len(t or ""), k, "x") for k, (i, t) in enumerate(rows)]
    pq.write_table(pa.Table.from_arrays([pa.array([r[k] for r in full], f[1]) for k, f in enumerate(FIELDS)], schema=pa.schema(FIELDS)), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def documents():
    rnd = random.Random(21)
    rows = shared_ids() + [(70, "said twice"), (70, "said twice"), (70, "said  twice"), (None, None)]
    labels = []
    for i in range(200):
        text, toxic = words(rnd, 45), i % 5 == 0
        if toxic:
            text[9] = text[30] = rnd.choice(("grubel", "Grub3l", "GRUBEL!"))
        rows.append((10_000 + i, " ".join(text)))
        labels.append((10_000 + i, int(toxic)))
    return rows, labels


def plain_clean(rows, lexicon):
    out = Counter()
    for i, t in rows:
        folded = plain_fold(t or "")
        total = plain_matches(folded, lexicon.terms, lexicon.exceptions)
        a, b, c = lexicon.curve
        score = 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(100 * total / max(1, len(folded.split()))))))
        if score < toxicity.THRESHOLD:
            out[i, t] += 1
    return out


def listed(counts):
    return [x for x, n in counts.items() for _ in range(n)]


def test_every_stage_and_the_run_by_brute_force(spark, tmp_path, documents):
    rows, labels = documents
    sf = write(tmp_path, rows, labels)
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = common.documents(spark, sf)
    lexicon = toxicity.fit_lexicon(toxicity.training_rows(docs, common.read(spark, sf, "labels")))
    tables = common.Tables(spark, "test")

    def stage(name, docs):
        out = tables.write(stages[name](spark, docs, sf), name)
        assert out.columns == corpus_pipeline.COLUMNS and out.where("n_chars <> length(text)").count() == 0
        return out, listed(rows_of(out))

    clean, left = stage("toxicity", docs)
    assert Counter(left) == plain_clean(rows, lexicon) and len(left) < len(rows) - 30
    single, kept = stage("exact_dedup", clean)
    assert Counter(kept) == plain_keep_exact(left)
    apart, stays = stage("near_dedup", single)
    never, first = plain_keep_near(kept)
    assert len(stays) == sum(never.values()) + len(first) and not Counter(stays) - Counter(kept)
    assert all(sum(Counter(stays)[x] for x in group) >= 1 for group in first) and not never - Counter(stays)
    cut, short = stage("substring_dedup", apart)
    assert Counter(short) == plain_cut(stays, 50) and sum(len(t or "") for _, t in short) < sum(len(t or "") for _, t in stays)

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in short:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, tuple(ids[k : k + 2048])] += 1
    for packed in (stages["packing"](spark, cut, sf), corpus_pipeline.run(spark, sf)):
        got = packed.collect()
        assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in got) == want
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
        places = defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length))
        for each in places.values():
            ends = np.cumsum([n for _, n in sorted(each)])
            assert [at for at, _ in sorted(each)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
        assert len(places) == -(-sum(len(x[2]) * n for x, n in want.items()) // 2048)


def test_only_what_the_result_reads_is_left(spark, tmp_path, monkeypatch):
    rows = corpus()[:40]
    sf = write(tmp_path, rows, [(i, int(i % 5 == 0)) for i, _ in rows if i is not None])
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{shared}")
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = {p.parent.name.split("-", 1)[1] for p in shared.rglob("*.parquet") if p.is_file()}
    assert left == {"pieces", "before"}


def test_empty_tables_pass_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, [], [])).count() == 0


def test_without_labels_nothing_is_toxic(spark, tmp_path):
    rows = corpus()[:12]
    sf = write(tmp_path, rows, [])
    got = corpus_pipeline.drop_toxic(spark, common.documents(spark, sf), sf)
    assert rows_of(got) == Counter(rows)
