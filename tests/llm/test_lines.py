"""Line dedup against plain Python, with groups of near copies of one line."""

from __future__ import annotations

import random

import pytest

from plantcast.llm import lines

ROW = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, min_chars):
    first = {}
    for i, text in rows:
        for pos, line in enumerate(text.split("\n")):
            first.setdefault(line, (i, pos))
    long = [x for x in first if len(x) >= min_chars]
    gone = {x for x in long if any(near(x, y) and first[y] < first[x] for y in long if y != x)}
    return {
        i: "\n".join(x for p, x in enumerate(text.split("\n")) if len(x) < min_chars or (first[x] == (i, p) and x not in gone))
        for i, text in rows
    }


def edited(rng, line):
    k, c = rng.randrange(len(line)), rng.choice("xyzé")
    return rng.choice([line[:k] + c + line[k + 1 :], line[:k] + line[k + 1 :], line[:k] + c + line[k:]])


@pytest.mark.parametrize("hot,fine", [(1, 8), (1, 32), (4, 3), (1000, 32)])
def test_groups_of_near_copies(spark, hot, fine):
    rng = random.Random(hot)
    bases = ["".join(rng.choices("abc ", k=n)) for n in (10, 11, 24, 61)]
    pool = []
    for base in bases:
        group = {base}
        while len(group) < 60:
            line = edited(rng, rng.choice(sorted(group)) if rng.random() < 0.5 else base)
            if len(line) >= 8:
                group.add(line)
        pool += sorted(group)
    pool += ["aaaaaaaaaaaa"[:k] for k in range(6, 13)] + ["short"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for k in range(150)]
    got = lines.dedup_lines(spark.createDataFrame(rows, ROW), min_chars=8, hot_lines=hot, fine=fine).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(rows, 8)


def test_thousands_of_near_copies(spark):
    """Copies of one line that differ in the same and in other places; rows grow with their number."""
    line = "this line is copied many times over with one place changed by hand"
    copies = [f"{line[:40]}{chr(0x4E00 + k)}{line[41:]}" for k in range(2_000)]
    apart = [f"{line[:k % 60]}{chr(0x4E00 + k)}{line[k % 60 + 1:]}" for k in range(1_000)]
    rows = [(1, line), *((k + 2, c) for k, c in enumerate([*copies, *apart]))]
    got = lines.dedup_lines(spark.createDataFrame(rows, ROW)).collect()
    assert {r["doc_id"] for r in got if r["text"]} == {1}


def test_long_text_with_many_dropped_lines(spark):
    part = "\n".join(f"a line of some length that comes twice, number {k}" for k in range(8_000))
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame([(1, part), (2, part + "\nown")], ROW), min_chars=46).collect()}
    assert got[2]["text"].split("\n")[-1] == "own" and got[2]["dropped_lines"] >= 8_000 - 10
