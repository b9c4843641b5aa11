"""What packing's workers keep, and which workers it needs."""

import weakref
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from auditgrid.llm import best_fit_packing, common
from tests.llm.tables import corpus, frame


class Caught:
    """Stands for a table and returns the function that its rows go through."""

    schema = "any"

    def mapInArrow(self, run, schema):
        return run


def test_no_worker_is_started_for_the_plan(spark):
    packed = best_fit_packing.pack(frame(spark, corpus()), with_ids=True)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()


def test_a_batch_is_gone_when_the_next_is_read(monkeypatch):
    monkeypatch.setattr(best_fit_packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    gone = []

    def batches():
        for k in range(3):
            batch = pa.record_batch({"doc_id": pa.array([k], pa.int64()), "text": pa.array([f"text {k}"])})
            seen = weakref.ref(batch)
            yield batch
            del batch
            gone.append(seen() is None)

    cut = best_fit_packing.pieces(Caught(), public_tokenizers.path("word_bpe_49k.json"))
    assert sum(b.num_rows for b in cut(batches())) == 3 and gone == [True] * 3
    common.release_state()


def test_rows_pass_and_what_a_worker_remembers_goes():
    common.worker_state(("remembered",), dict)
    batch = pa.record_batch({"length": [1, 2]})
    assert list(common.released(Caught())(iter([batch]))) == [batch] and not common._STATE


def test_packing_frees_its_workers_once_all_is_cut(spark, monkeypatch):
    passed = []
    monkeypatch.setattr(common, "released", lambda df, f=common.released: passed.append(df.columns) or f(df))
    assert best_fit_packing.pack(frame(spark, corpus())).count() >= len(corpus()) and passed == [["length"]]
