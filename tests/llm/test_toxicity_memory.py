"""What a task of the toxicity features holds beside its batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plantcast.llm import toxicity


class Rows:
    """Takes a task's function instead of running it in Spark."""

    dtypes = [("doc_id", "bigint"), ("text", "string"), ("toxic", "int")]

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self

    def groupBy(self, *columns):
        return self

    def agg(self, *columns):
        return self


class Terms(toxicity.Lexicon):
    def __init__(self):
        self.slots = np.arange(0, toxicity.SLOTS, 50)
        self.toxic, self.other, self.totals = np.full(len(self.slots), 50), np.full(len(self.slots), 3), (1000, 1000)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [" ".join(f"you{rng.randint(0, 9999)} w0rd!! A{rng.randint(0, 999)}" for _ in range(rng.randint(0, 300))) for _ in range(1500)]


@pytest.fixture
def task(spark):
    def run(kind, texts):
        if kind == "features":
            rows, columns = toxicity.features(Rows(), Terms(), ["doc_id"]), [pa.array(range(len(texts))), pa.array(texts)]
        else:
            rows, columns = toxicity.lexicon_counts(Rows()), [pa.array(texts), pa.array([k % 2 for k in range(len(texts))])]
        batch = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])
        return [c.to_pylist() for out in rows.function(iter([batch])) for c in out.columns]

    return run


@pytest.mark.parametrize("kind", ["features", "lexicon"])
def test_a_task_holds_little_beside_its_texts(task, texts, kind):
    task(kind, texts[:3])
    tracemalloc.start()
    task(kind, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6


@pytest.mark.parametrize("kind", ["features", "lexicon"])
def test_runs_of_texts_change_nothing(task, texts, kind, monkeypatch):
    whole = task(kind, texts[:200])
    monkeypatch.setattr(toxicity, "FEATURE_BYTES", 1000)
    assert task(kind, texts[:200]) == whole
