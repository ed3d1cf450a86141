"""The operators on small tables: brute force, round trips and odd rows."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantcast.llm import chat, contamination, jaccard, language, lines, mixing, pii, toxicity, vectors, warc
from plantcast.llm.common import components, work_folder

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    near = " ".join([*base.split()[:-1], "changed"])
    rows = [
        (1, base, "en", "a"), (2, base, "en", None), (3, near, "en", "b"), (3, near, "en", "b"), (4, None, None, "a"),
        (5, "", "en", "c"), (6, "   \t\n ", "de", "c"), (7, "one two", "de", "a"), (8, "one two", "de", "a"),
        (None, base, None, "a"), (9, sentence(rng, 30_000), "en", "d"), (10, "123 !!!", None, "é"),
        (11, base + "\n" + sentence(rng, 20), "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC).withColumn("extra", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(40, 41), (50, 50)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(21), 40, 41, 50, 60]], "id long")
    got = {r["id"]: r["component_id"] for r in components(nodes, edges, work_folder(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 50: 50, 60: 60}


def test_chat_round_trip(spark):
    said = [(1, 0, "user", r"\l <|end|> \b"), (1, 1, "assistant", "<|user|>\nx\\"), (1, 2, None, None), (2, 0, "a\nb", ""), (2, 0, "a\nb", "")]
    examples = chat.prefix_examples(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    read = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    assert read[1]["n_turns"] == 3 and read[2]["n_turns"] == 2
    assert read[1]["loss_chars"] == len("<|user|>\nx\\") and read[2]["loss_chars"] == 0
    whole = examples.filter("conv_id = 1").orderBy(F.desc("example")).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in whole] == [(r or "", t or "") for _, _, r, t in said[:3]]


@pytest.mark.parametrize("few", [200_000, 0])
def test_warc(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    html = [(1, "u", "same"), (2, None, "same"), (3, "a\r\nb", "x\r\n\r\ny"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (3, "u", "x\r\n\r\ny")]
    html += [(6, "long: u", "é\n" * 400_000), (7, "u", "é\n" * 400_000)]
    folder = work_folder(spark, "warc")
    resolved = warc.resolve_revisits(spark.createDataFrame(html, "page_id long, url string, html string"))
    warc.write_archives(resolved, folder, per_file=2)
    read = warc.read_archives(spark, folder).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read), key=str)
    assert got == sorted([
        (1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 6), (3, "response", None, 6),
        (4, "response", None, 0), (5, "revisit", 4, 0), (None, "revisit", 1, 4),
        (6, "response", None, 1_200_000), (7, "revisit", 6, 1_200_000),
    ], key=str)
    assert {r["url"] for r in read} == {"u", "", "a%0D%0Ab", "long: u"}


def test_warc_without_pages_and_with_text_ids(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, digest string")
    folder = work_folder(spark, "warc")
    warc.write_archives(warc.resolve_revisits(none), folder)
    assert warc.read_archives(spark, folder).count() == 0
    with pytest.raises(TypeError, match="page_id"):
        warc.resolve_revisits(none.withColumn("page_id", F.lit("a")))


def test_pii():
    p = pii.Permuter(b"k")
    text = "card 4111 1111 1111 1111, 4111111111111112, ip 10.0.0.1, 999.1.1.1, +1 (415) 555-0199, born 1980-02-29, 1980-02-30, Ann.Lee7@mail.example.com, password=0123456789abcdef"
    new, n = pii.pseudonymise(text, p)
    assert n == 6 and len(new) == len(text) or n == 6
    assert "4111111111111112" in new and "999.1.1.1" in new and "1980-02-30" in new
    for value in ("4111 1111 1111 1111", "10.0.0.1", "555-0199", "1980-02-29", "Ann.Lee7", "0123456789abcdef"):
        assert value not in new
    number = re.search(r"card ([\d ]+),", new)[1]
    assert pii.luhn_sum(number.replace(" ", "")) % 10 == 0
    assert pii.pseudonymise(text, pii.Permuter(b"k"))[0] == new != pii.pseudonymise(text, pii.Permuter(b"other"))[0]
    assert sorted(p.apply(v, 1000, "t") for v in range(1000)) == list(range(1000))


def test_pii_phones_of_any_area_code():
    p = pii.Permuter(b"k")
    numbers = [f"+1 ({area:03d}) 555-7713" for area in range(0, 1000, 7)] + ["(017) 555-7713", "1-136-555-7479"]
    found = [pii.pseudonymise(f"call {x} now", p) for x in numbers]
    assert all(n == 1 and x not in new for x, (new, n) in zip(numbers, found, strict=True))
    new = [re.search(r"\((\d)", text)[1] for text, _ in found[:-1]]
    assert all((a in "01") == (re.search(r"\((\d)", x)[1] in "01") for a, x in zip(new, numbers[:-1], strict=True))
    assert len({text for text, _ in found[:-2]}) == len(numbers) - 2
    assert pii.pseudonymise("part 017-555-7713", p) == ("part 017-555-7713", 0)


def test_pii_odd_rows(odd, empty):
    got = pii.pseudonymise_documents(odd, b"k")
    assert got.count() == odd.count() and set(got.columns) == {*odd.columns, "n_replaced"}
    assert pii.pseudonymise_documents(empty, b"k").count() == 0


def test_edit_distance_and_keys(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows + [(b, a) for a, b in rows], "a string, b string")
    for t in (1, 2):
        assert df.filter(lines.within_edits(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0
        near = df.filter((F.levenshtein("a", "b") <= t) & (F.length("a") <= F.length("b")))
        keys = F.arrays_overlap(F.array(*lines.index_keys(F.col("a"), t)), F.array(*lines.probe_keys(F.col("b"), t)))
        assert near.filter(~keys).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_lines(spark, odd, empty, hot):
    line = "this line is long enough to be looked at by the operator"
    variants = [line[:k] + "#" + line[k + 1 :] for k in range(0, 50, 5)]
    rows = [(1, line + "\nshort", "", "a", 0), (2, "short\n" + line + "!", "", "a", 0), (3, "\n".join(variants), "", "a", 0)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOC), hot_lines=hot).collect()}
    assert got[1]["dropped_lines"] == 0 and got[2]["text"] == "short"
    assert got[3]["dropped_lines"] == len(variants) and got[3]["text"] == ""
    out = lines.dedup_lines(odd)
    assert out.count() == odd.count() and "extra" in out.columns
    assert lines.dedup_lines(empty).count() == 0


def test_mixing(spark, odd, empty):
    rng = random.Random(3)
    rows = [(k, sentence(rng, rng.randint(1, 60)), "", rng.choice(["a", "b", "c", None, "d"]), 0) for k in range(600)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, DOC)).collect()
    sums: dict = {}
    for r in mixed:
        assert 0 <= r["copies"] <= 2 and r["size"] == len(r["text"].split())
        s = sums.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["size"] * r["copies"]
        s[1] += r["size"]
    for taken, size, source_size, target in sums.values():
        assert size == source_size and abs(taken - target) <= 0.01 * target and target <= 2 * size
    assert abs(sum(s[3] for s in sums.values()) - 1.5 * sum(s[1] for s in sums.values())) < 1e-6 * len(rows) * 60
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(empty).count() == 0


def brute_components(sets: dict[int, frozenset]) -> dict[int, int]:
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard(spark, odd, empty):
    rng = random.Random(8)
    texts = {}
    for k in range(40):
        words = texts[rng.randrange(k)].split() if k and rng.random() < 0.6 else sentence(rng, rng.randint(3, 80)).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "Edit" + str(k)
        texts[k] = " ".join(words)
    got = jaccard.near_documents(spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOC)).collect()
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        sets[k] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {
        k: (len(sets[k]), c) for k, c in brute_components(sets).items()
    }
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_documents(odd).collect()}
    assert found[2] == found[3] == 1 and found[8] == 7 and found[5] == 5 and found[6] == 6 and found[None] == 1
    assert jaccard.near_documents(empty).count() == 0


def test_jaccard_with_common_passages(spark, monkeypatch):
    """Shingles of passages that many documents share come last in the order; the links stay."""
    rng = random.Random(21)
    passages, texts = [sentence(rng, 25), sentence(rng, 12)], {}
    for k in range(60):
        words = texts[rng.randrange(k)].split() if k and rng.random() < 0.4 else sentence(rng, rng.randint(5, 90)).split()
        words[rng.randrange(len(words))] = "Edit" + str(k)
        texts[k] = " ".join([*words, passages[k % 2]]) if rng.random() < 0.7 else " ".join(words)
    texts |= {60: passages[0], 61: passages[0] + " end", 62: passages[1]}
    documents = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOC)
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        sets[k] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3))
    want = brute_components(sets)
    for common, most in ((2, 100_000), (2, 9), (64, 100_000)):
        monkeypatch.setattr(jaccard, "COMMON", common)
        monkeypatch.setattr(jaccard, "MOST_COMMON", most)
        assert len(jaccard.common_shingles(documents, 4, 85, 100)) == {9: 9}.get(most, 0) or common == 2
        got = jaccard.near_documents(documents).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_unresolved_keeps_all_rows_that_can_link(spark):
    """Rows of one-label buckets go, those with a neighbour in size stay."""
    rng = random.Random(12)
    rows = [(rng.randrange(12), 0, k, rng.choice([1, 2, 7, 20, 23, 24, 400, rng.randint(1, 500)]), rng.randrange(2)) for k in range(120)]
    table = spark.createDataFrame(rows, "key long, pos int, rep long, n_shingles long, label long")
    for num, den in ((85, 100), (1, 1)):
        got = {(r["key"], r["rep"]) for r in jaccard.unresolved(table, num, den, work_folder(spark, "u")).collect()}
        mixed = {k for k in range(12) if len({r[4] for r in rows if r[0] == k}) > 1}
        close = {
            (a[0], a[2]) for a in rows for b in rows
            if a[0] == b[0] and a[2] != b[2] and den * min(a[3], b[3]) >= num * max(a[3], b[3])
        }
        assert {x for x in close if x[0] in mixed} <= got
        assert {k for k, _ in got} <= mixed and len(got) < len(rows)
    with pytest.raises(TypeError, match="doc_id"):
        jaccard.near_documents(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_rtree_finds_all_bounded_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in rng.integers(20, 60, 60)]
    sets += [np.unique(np.concatenate([s[1:], [np.uint64(7)]])) for s in sets]
    points, n = jaccard.Points([jaccard.group_counts(s).tobytes() for s in sets]), np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    keep = jaccard.can_link(jaccard.overlap_bound(points, i, points, j), n[i], n[j], 85, 100)
    want = set(zip(i[keep].tolist(), j[keep].tolist()))
    a, b = jaccard.RTree(points, n, n).pairs(85, 100, np.arange(len(sets)))
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want
    assert all((k, k + 60) in want for k in range(60))


def test_a_pair_is_named_once(spark):
    """Pairs of a group that cannot link are mostly not named, others in their first bucket only; no link is lost."""
    rng = np.random.default_rng(9)
    base = rng.integers(1, 1 << 62, 150).astype(np.uint64)
    sets = []
    for k in range(120):  # copies at 0.70 to 0.85 of each other, every fourth beside one that links
        kept = base[np.sort(rng.permutation(150)[:136])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(1, 1 << 62, 14).astype(np.uint64)])))
        if k % 4 == 0:
            sets.append(np.unique(np.concatenate([sets[-1][2:], rng.integers(1, 1 << 62, 2).astype(np.uint64)])))
    rows, points = [], []
    for k, s in enumerate(sets):
        points.append((k, len(s), k, 0, jaccard.group_counts(s).tobytes(), jaccard.parities(s).tobytes()))
        rows += [(int(key), pos, k, k) for pos, key in enumerate(s[: jaccard.prefix_length(len(s), 85, 100)].view(np.int64))]
    reps = spark.createDataFrame(points, "rep long, n_shingles long, s1 long, s2 long, counts binary, parity binary")
    opened = jaccard.with_before(spark.createDataFrame(rows, "key long, pos int, rep long, label long"), reps)
    found = jaccard.tree_pairs(opened.join(reps.drop("s1", "s2"), "rep"), 85, 100, 4).collect()
    got = [(r["a"], r["b"]) for r in found]
    linked = {
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - len(both))
    }
    assert len(linked) >= 30 and linked <= set(got)
    assert len(got) == len(set(got)) <= 4 * len(linked)


def test_jaccard_of_texts_that_share_an_id(spark):
    """Sets of one doc_id have no common order; each of them still finds what it links to."""
    rng = random.Random(31)
    bases = [sentence(rng, 60).split() for _ in range(6)]
    rows = [(1, " ".join(b)) for b in bases]
    for k, b in enumerate(bases):
        for c in range(3):
            w = [*b]
            w[rng.randrange(len(w))] = f"edit{k}x{c}"
            rows.append((10 + 10 * k + c, " ".join(w)))
    got = jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[30:50] = x[:20] + rng.normal(scale=0.1, size=(20, 8)).astype(np.float32)
    x[50:] = x[0]
    label = [int(k) for k in rng.integers(0, 2, 60)]
    label[50:] = [label[0]] * 10
    rows = [(k, v.tolist(), l) for k, (v, l) in enumerate(zip(x, label))]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [None] * 8, 1), (104, x[0].tolist(), None), (105, [], 1), (106, [1.0], 1)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(1))
    linked = (d @ d.T / np.outer(norm, norm) >= 0.98) & (np.array(label)[:, None] == np.array(label))
    component = np.arange(60)
    for _ in range(60):
        component = np.array([component[linked[k]].min() for k in range(60)])
    for k in range(60):
        assert (got[k]["n_links"], got[k]["component_id"]) == (linked[k].sum() - 1, component[k])
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(100, 107))


def test_contamination(spark, odd, empty):
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(13, 40))) for k in range(12)] + [(50, None), (51, ""), (52, "tiny item")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    near = items[1][1].split()
    near[6] = "other"
    rows = [(1, sentence(rng, 50) + "\n" + items[0][1].upper() + "!", "", "", 0), (2, sentence(rng, 9) + " " + " ".join(near), "", "", 0), (3, sentence(rng, 200), "", "", 0), (4, "a Tiny, item", "", "", 0)]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contamination.contaminated(spark.createDataFrame(rows, DOC), benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 52)} and got[1, 0] == 1
    assert contamination.contaminated(odd, benchmark).count() == 0
    assert contamination.contaminated(empty, benchmark).count() == 0
    assert contamination.contaminated(odd, benchmark.limit(0)).count() == 0


def test_blocks_find_all_within_the_radius():
    index, rng = contamination.ItemIndex([sentence(random.Random(k), 15) for k in range(40)]), random.Random(0)
    probes, near = [], []
    for n in range(600):
        bits = np.unpackbits(index.prints[n % 40])
        far = rng.choice([rng.randint(0, contamination.RADIUS), contamination.RADIUS, contamination.RADIUS + 1])
        bits[rng.sample(range(contamination.BITS), far)] ^= 1
        probes.append(np.packbits(bits))
        near.append({k for k in range(40) if np.bitwise_count(probes[-1] ^ index.prints[k]).sum() <= contamination.RADIUS})
    got = [set() for _ in probes]
    for window, item in zip(*index.blocks[15].near(np.stack(probes)), strict=True):
        got[window].add(item)
    assert got == near and sum(n % 40 in g for n, g in enumerate(got)) > 350


def test_fingerprints_do_not_depend_on_spans(monkeypatch):
    words = np.random.default_rng(3).integers(0, 1 << 60, 500).astype(np.uint64)
    starts = np.array([0, 3, 40, 41, 300, 479])
    want = contamination.fingerprints(words, starts, 21)
    monkeypatch.setattr(contamination, "SPAN", 5)
    assert (contamination.fingerprints(words, starts, 21) == want).all()
    alone = [contamination.fingerprints(words[s : s + 21], np.zeros(1, int), 21)[0] for s in starts]
    assert (np.stack(alone) == want).all()


def brute_windows(items: list[tuple[int, str]], text: str, threshold: float) -> dict[int, float]:
    """Items and best similarities over all windows, by sets of word triples."""
    triples = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in items if (w := t.split())}
    count = Counter(x for s in triples.values() for x in s)
    weight = {x: 1 + np.log(len(items) / n) for x, n in count.items()}
    words, found = text.split(), {}
    for k, t in items:
        size, mine = len(t.split()), triples[k]
        for start in range(max(len(words) - size, 0) + 1):
            w = words[start : start + size]
            have = mine & {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
            value = sum(weight[x] for x in have) / sum(weight[x] for x in mine)
            found[k] = max(found.get(k, 0), value)
    return {k: v for k, v in found.items() if v >= threshold}


def test_windows_of_all_similarities():
    rng = random.Random(4)
    common = sentence(rng, 12)
    items = [(k, sentence(rng, rng.choice([13, 25, 40, 55])) + (" " + common if k % 3 == 0 else "")) for k in range(12)]
    index, texts = contamination.ItemIndex([t for _, t in items]), []
    for n in range(600):
        words = items[n % 12][1].split()
        for _ in range(rng.randint(0, 3) if n % 2 else 0):  # changed, left out and additional words
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [sentence(rng, 1)] * rng.randint(0, 2)
        cut = round(len(words) * rng.uniform(0.2, 0.4)) if n % 2 == 0 else 0
        words = words[: len(words) - cut] + sentence(rng, cut + 1).split()
        texts.append(sentence(rng, rng.randint(20, 70)) + " " + " ".join(words) + " " + sentence(rng, 30))
    got = [{} for _ in texts]
    for row, words, bounds in contamination._words(pa.array(texts)):
        for r, item, first, value in index.matches(words, bounds, 0.6):
            got[row + r][item] = max(value, got[row + r].get(item, 0))
    want = [brute_windows(items, t, 0.6) for t in texts]
    for least, most in ((0.6, 0.7), (0.7, 1.1)):  # recall against brute force, also close to the threshold
        there = [(n, k) for n, w in enumerate(want) for k, v in w.items() if least <= v < most]
        assert len(there) > 60 and np.mean([k in got[n] for n, k in there]) >= (0.97 if least == 0.6 else 0.995)
    assert all(abs(v - want[n][k]) < 1e-9 for n, g in enumerate(got) for k, v in g.items() if want[n][k] > 0.75)
    assert all(0.6 <= v < want[n][k] + 1e-9 for n, g in enumerate(got) for k, v in g.items())


def test_contamination_of_texts_shorter_than_the_item(spark):
    rng = random.Random(8)
    items = [(k, sentence(rng, 20 + 10 * k)) for k in range(4)]
    cut = [" ".join(t.split()[:-1]) for _, t in items] + [" ".join(t.split()[: len(t.split()) * 3 // 4]) for _, t in items]
    cut += [" ".join(t.split()[len(t.split()) // 2 :]) for _, t in items] + ["", items[0][1].split()[0]]
    want = {(d, k): v for d, t in enumerate(cut) for k, v in brute_windows(items, t, 0.6).items()}
    assert len(want) == 8
    rows = [(d, t, "", "", 0) for d, t in enumerate(cut)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contaminated(spark.createDataFrame(rows, DOC), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert {r["first_word"] for r in got} == {0}


def test_contamination_does_not_depend_on_slices(spark, monkeypatch):
    rng = random.Random(10)
    common = sentence(rng, 12)
    items = [(k, sentence(rng, rng.randint(15, 40)) + (" " + common if k % 2 == 0 else "")) for k in range(20)]
    rows = []
    for k, text in items:
        words = text.split()
        cut = len(words) * rng.randint(60, 95) // 100
        rows.append((k, " ".join(words[:cut]) + " " + sentence(rng, 30), "", "", 0))
    benchmark = spark.createDataFrame([*items, (98, ""), (99, None), (97, "?!")], "item_id long, text string")
    documents = spark.createDataFrame(rows, DOC)
    want = {(d, k): round(v, 9) for d, t, *_ in rows for k, v in brute_windows(items, t, 0.6).items()}
    got = []
    for words in (contamination.SLICE_WORDS, 400):
        monkeypatch.setattr(contamination, "SLICE_WORDS", words)
        found = contamination.contaminated(documents, benchmark).collect()
        got.append({(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found})
    assert got[0] == got[1] == want


def test_contamination_keeps_the_types_of_ids(spark):
    text = sentence(random.Random(11), 30)
    documents = spark.createDataFrame([("d1", text, 1), ("d2", text + " end", 2), (None, text, 3)], "doc_id string, text string, item_id int")
    benchmark = spark.createDataFrame([("i", text, "x"), (None, text, "y")], "item_id string, text string, doc_id string")
    found = contamination.contaminated(documents, benchmark)
    assert dict(found.dtypes)["item_id"] == dict(found.dtypes)["doc_id"] == "string"
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(d, i) for d in ("d1", "d2", None) for i in ("i", None)}


def test_language(spark, odd, empty):
    rng = random.Random(6)
    words = {"en": "the of and ing tion".split(), "de": "der die und ung sch".split(), "fr": "les que é eau ou".split()}
    rows = [(" ".join(rng.choice(words[l]) for _ in range(30)), l) for l in words for _ in range(30)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    probe = spark.createDataFrame([(k, " ".join(rng.choice(words[l]) for _ in range(20)), l) for k, l in enumerate([*words] * 5)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(probe, model).collect()}
    assert all(got[r["doc_id"]]["lang_pred"] == r["lang"] and got[r["doc_id"]]["score"] > 0.5 for r in probe.collect())
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [found[k]["lang_pred"] for k in (4, 5, 6, 10)] == ["und"] * 4 and found[4]["score"] == 0
    assert language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(empty)).collect()} == {"und"}


def test_language_of_many_labels(spark):
    rng = random.Random(7)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(3)] for k in range(230)}
    rows = [(" ".join(w) * 5, l) for l, w in words.items()] + [(" ".join(words[l]) * 5, l) for l in [*words][:200]]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model[0] == sorted(words)
    probe = spark.createDataFrame([(l, " ".join(w) * 4) for l, w in words.items()], "doc_id string, text string")
    right = [r["doc_id"] == r["lang_pred"] for r in language.identify(probe, model).collect() if r["doc_id"] >= "l200"]
    assert len(right) == 30 and np.mean(right) > 0.9


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    rows = [(k, sentence(rng, 20) + (" vile " + rng.choice(WORDS) if k % 4 == 0 else "")) for k in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = documents.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.Model(documents, labels)
    got = model.score(documents, ["doc_id"]).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in model.score(odd, ["doc_id", "extra"]).collect())
    assert toxicity.Model(empty, labels).score(odd, ["doc_id"]).agg(F.max("score")).first()[0] == 0
    assert model.score(empty, ["doc_id"]).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
    ]
    rng = random.Random(12)
    clean = sentence(rng, 80)
    rows = [(1, clean, "en", "a", 0), (2, clean + " more", "en", "a", 0), (2, clean + " more", "en", "a", 0), (3, sentence(rng, 80), "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOC)
    kept = corpus_pipeline.dedup_documents(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == docs.columns


@pytest.fixture(scope="module")
def stage_rows(spark, tmp_path_factory):
    """Repeated and null doc_ids with equal and different texts, and the tables that the stages read."""
    rng, folder = random.Random(13), str(tmp_path_factory.mktemp("stages"))
    item, copied = sentence(rng, 30), sentence(rng, 80)
    toxic = [(100 + k, sentence(rng, 20) + (" vile" if k % 4 == 0 else ""), "en", "a") for k in range(200)]
    rows = [
        (1, "with " + item, "en", "a"), (1, sentence(rng, 60), "en", "a"), (None, item + " " + sentence(rng, 40), "en", "a"),
        (None, sentence(rng, 60), "en", "b"), (2, copied, "en", "a"), (None, copied, "en", "b"), (3, copied + " end", "en", "a"),
        (4, sentence(rng, 50), "en", "a"), (4, sentence(rng, 50), "en", "a"), (5, None, "en", "a"), (6, "", "en", None),
    ]
    rows += [(7, sentence(random.Random(1), 40), "en", "a")] * 2
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC).withColumn("th", F.lit("kept"))
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(r[0], int("vile" in r[1])) for r in toxic], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, [(r[0], r[1]) for r in rows], spark.createDataFrame([(*r, 0) for r in toxic], DOC), item, copied, folder


def rows_of(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_drop_contaminated(spark, stage_rows, empty):
    docs, rows, _, item, _, folder = stage_rows
    kept = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert kept.columns == docs.columns and rows_of(kept) == Counter(r for r in rows if item not in (r[1] or ""))
    assert corpus_pipeline.drop_contaminated(spark, empty, folder).count() == 0


def test_stage_dedup_documents(spark, stage_rows, empty):
    docs, rows, _, _, copied, folder = stage_rows
    kept = corpus_pipeline.dedup_documents(spark, docs, folder)
    want = Counter({r for r in rows if copied not in (r[1] or "")} | {(2, copied)})
    assert kept.columns == docs.columns and rows_of(kept) == want
    assert corpus_pipeline.dedup_documents(spark, empty, folder).count() == 0


def test_stage_drop_toxic(spark, stage_rows, empty):
    _, _, labelled, _, _, folder = stage_rows
    again = labelled.filter("doc_id < 120").withColumn("doc_id", F.lit(None).cast("long"))
    docs = labelled.union(again).withColumn("th", F.lit("kept"))
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs.filter("NOT contains(text, 'vile')"))
    assert corpus_pipeline.drop_toxic(spark, empty, folder).count() == 0


def test_stage_dedup_lines_and_mix(spark, stage_rows, empty):
    docs, rows, _, _, copied, folder = stage_rows
    reduced = corpus_pipeline.dedup_lines(spark, docs, folder)
    assert reduced.columns == docs.columns
    found = rows_of(reduced)
    assert all(found[r] == 1 for r in rows if r[0] in (1, 4, 5, 6)) and (None, copied) in found and (2, copied) not in found
    mixed = corpus_pipeline.mix(spark, docs.withColumn("copy", F.lit("x")), folder)
    assert mixed.columns == [*docs.columns, "copy"] and set(rows_of(mixed)) <= set(rows)
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.mix):
        assert stage(spark, empty, folder).count() == 0


def test_stages_keep_columns_of_any_name(spark, stage_rows, empty):
    docs, rows, _, _, copied, folder = stage_rows
    names = ["_row", "_first", "th", "size", "draw", "no_source", "source_key", "slice", "copies", "target", "n_lines", "gone_lines", "document"]
    wide = docs.drop("th").withColumns({c: F.concat(F.lit(c), F.col("n_chars")) for c in names})
    wide = wide.union(wide.limit(0))
    stages = [corpus_pipeline.dedup_lines, corpus_pipeline.dedup_documents, corpus_pipeline.drop_contaminated, corpus_pipeline.mix]
    for stage in stages:
        found = stage(spark, wide, folder)
        assert [c for c in found.columns if c != "copy"] == wide.columns
        lengths = {f"{len(t or '')}" for _, t in rows}
        assert all(r[c].removeprefix(c) in lengths for r in found.collect() for c in names)


def test_stage_drops_documents_left_with_white_space(spark, stage_rows):
    folder = stage_rows[-1]
    line = sentence(random.Random(21), 12)
    texts = [line, line + "\n", "\t\n" + line, line + "\n\x0b rest", "\n", None]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], DOC)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, folder).collect()}
    assert kept == {0: line, 3: "\x0b rest", 4: "\n", 5: None}


def test_mix_sources_keeps_other_columns(spark, odd):
    wide = odd.withColumns({c: F.lit(c) for c in ("draw", "no_source", "source_key", "slice", "cut", "each", "document", "size")})
    mixed = mixing.mix_sources(wide)
    assert set(mixed.columns) == {*wide.columns, "source_size", "target", "copies"}
    kept = ["draw", "no_source", "source_key", "slice", "cut", "each", "document"]
    assert mixed.count() == odd.count() and {tuple(r) for r in mixed.select(*kept).collect()} == {tuple(kept)}
    same = mixing.mix_sources(odd).select("doc_id", "text", "copies")
    assert mixed.select("doc_id", "text", "copies").exceptAll(same).count() == 0
