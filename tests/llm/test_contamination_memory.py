"""What a decontamination task holds beside its batch."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from plantcast.llm import contamination, jaccard


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 600))) for _ in range(3000)]


def matches(texts, items):
    index = contamination.ItemIndex(items)
    found = []
    for row, words, bounds in contamination._words(pa.array(texts)):
        found += [(row + r, item, first, value) for r, item, first, value in index.matches(words, bounds, 0.6)]
    return found


def peak(run):
    tracemalloc.start()
    run()
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return held


def test_a_task_holds_little_beside_its_texts(texts):
    items = [" ".join(t.split()[:40]) for t in texts[:200]]
    found = matches(texts, items)
    assert len({row for row, *_ in found}) >= 150
    assert peak(lambda: matches(texts, items)) < 70e6
    assert peak(lambda: [None for _ in jaccard.shingle_sets(pa.array(texts), 5)]) < 35e6


def test_runs_of_texts_change_nothing(texts, monkeypatch):
    some = [*texts[:300], None, "", "ÄÖ " + texts[5]]
    items = [" ".join(t.split()[:40]) for t in texts[:60]]
    whole = matches(some, items)
    for name, value in (("ROWS", 7), ("SMALL_BYTES", 1000), ("PAIRS", 500), ("HITS", 100)):
        monkeypatch.setattr(contamination, name, value)
    assert matches(some, items) == whole
