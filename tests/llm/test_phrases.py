"""Phrase mining against plain Python counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantcast.llm import phrases

ROW = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                hidden |= {p[i : i + m] for i in range(len(p) - m + 1) if 100 * a >= 100 * f[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in hidden:
                n = totals[lang]
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(lang, r + 1, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y, n) in enumerate(sorted(scored)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["Élan", "ΣΑΣ", "#", "a-b", "X'"]
    weights = [1 / (k + 1) for k in range(len(words))]
    known = ["New York City hall", "w0 w0 w0", "as soon as possible it", "zz top"]

    def text(n):
        parts = [rng.choice(known) if rng.random() < 0.1 else rng.choices(words, weights)[0] for _ in range(n)]
        return "".join(p + rng.choice([" "] * 12 + [", ", ".", "\t", "  ", "\n", "!? ", "\x0b", "\x1c"]) for p in parts)

    out = [(k, text(rng.randint(0, 80)), rng.choice(["en", "de", None, "und", "EN"])) for k in range(400)]
    hot = "the very common pair of words again " * 3
    out += [(1000 + k, hot, "en") for k in range(300)]
    out += [(5000, text(30_000), "en"), (5001, None, "en"), (5002, "", None), (5003, " \t,.\n ", "de"), (None, text(50), "de"), (1, text(20), "en")]
    return out


@pytest.mark.parametrize("least,most", [(5, 2000), (2, 30), (40, 2000)])
def test_against_brute_force(spark, rows, least, most):
    df = spark.createDataFrame(rows, ROW).repartition(5).withColumns({"n": F.lit("x"), "score": F.lit(1), "range": F.lit(None), "code": F.lit(0)})
    got = sorted(map(tuple, phrases.collocations(df, least=least, most=most).collect()))
    assert got == brute(rows, least, most)
    assert got


def test_words_without_a_small_code(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "CODES", 7)
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, ROW), least=5).collect())) == brute(rows, 5, 2000)


def test_shared_hashes_are_found(spark):
    text = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(k, " ".join(text.split()[k % 7 :: 7] * 3), "en") for k in range(70)], ROW).repartition(9)
    with pytest.raises(RuntimeError, match="share hashes"):
        phrases.collocations(df, least=5, bits=19).collect()


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], ROW)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "one two", "en")], ROW), least=2).collect() == []


def test_ranges_of_sorted_rows():
    rng = np.random.default_rng(0)
    columns, _ = phrases._combined(list(rng.integers(0, 4, (5, 500))))
    table = np.stack(columns, 1)
    borders = table[[50, 200, 201, 390]]
    want = [sum(tuple(b) <= tuple(r) for b in borders.tolist()) for r in table.tolist()]
    assert phrases._range_of(columns, borders).tolist() == want


def test_products_beyond_64_bits(spark):
    """Scores of counts near 10**12, from the two streams on."""
    big = 10**12
    one = [(1, 0, 0, 0, 0, 3 * big), (2, 0, 0, 0, 0, 2 * big), (2, 1, 0, 0, 0, big)]
    stored = spark.createDataFrame(one, f"{phrases.WORD_COLUMNS}, n long")
    words = spark.createDataFrame([(1, "en", "a", 3 * big), (2, "en", "b", 2 * big)], "code long, lang string, word string, n long")
    totals = spark.createDataFrame([("en", 50 * big)], "lang string, n_words long")
    got = phrases.scored_candidates(stored, words, totals, 2).first()
    assert tuple(got) == ("en", "a b", big, 3 * big, 2 * big, 50 * big, 1000 * big * 50 * big // (6 * big * big))
