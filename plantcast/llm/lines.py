"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Occurrences of a line are ordered by (doc_id, text hash, line number). An occurrence is dropped if
an earlier occurrence holds the same line or one within ``threshold`` edits (insertions, deletions,
substitutions of one character); lines under ``min_chars`` characters always stay.

Two lines within t edits share one of t + 1 even segments, at a position that the difference of
their lengths allows. Every distinct line puts its segments into an index by (length, segment) and
probes the index for its own length and up to t less. Candidates are verified with a banded
bit-parallel edit distance. Keys that more than ``hot_lines`` lines have are not joined for t = 1: their
lines are cut finer, into ``fine`` pieces, and looked at where everything before and after one piece
agrees with another line. There a line is left without each of the piece's characters in turn. Lines of
one length that are equal without the same place are one edit apart, all with all, so the earliest
of them comes from an aggregation; a line that is another one without a character meets that one only.
No pairs of a large group are made, and the rows grow with its size.

Defined results: null texts stay null and empty texts empty; a null doc_id comes first in the
order; repeated rows (same doc_id and text) are treated alike, each keeps what the first one keeps;
further columns pass through unchanged. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.llm.common import broadcast_if_few, drop_folder, scan_tasks, staged, work_folder

LINE = ["h1", "h2"]


def _occurrences(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, line, h1, h2) of every line that is long enough."""
    rows = documents.filter("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return rows.filter(F.length("line") >= min_chars).withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")}
    )


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the threshold + 1 even segments of a line; the last ones are the longer."""
    count = threshold + 1
    short = F.floor(length / count)
    first_long = count - length % count
    return [
        (short * i + F.greatest(F.lit(i) - first_long, F.lit(0)), short + F.when(F.lit(i) >= first_long, 1).otherwise(0))
        for i in range(count)
    ]


def index_keys(line: Column, threshold: int) -> list[Column]:
    length = F.length(line)
    return [
        F.xxhash64(F.lit(i), length, F.substr(line, start + 1, size))
        for i, (start, size) in enumerate(segments(length, threshold))
    ]


def probe_keys(line: Column, threshold: int) -> list[Column]:
    """Keys under which a line meets those of its own length and of up to ``threshold`` characters less.

    Segment i of the shorter line can lie in the longer one at its own start plus a shift s; edits
    before it bound s by i, edits after it bound the rest of the length difference.
    """
    keys = []
    for less in range(threshold + 1):
        length = F.length(line) - less
        for i, (start, size) in enumerate(segments(length, threshold)):
            for shift in range(-i, i + 1):
                if abs(shift - less) <= threshold - i:
                    keys.append(F.xxhash64(F.lit(i), length, F.substr(line, start + 1 + shift, size)))
    return keys


def _fine_pieces(line: Column, less: int, fine: int) -> list[Column]:
    """For one edit: (key, start, stop) of each of ``fine`` pieces in the cut of a line ``less`` characters shorter.

    The key is of everything but the piece, which has ``less`` characters more here.
    """
    length = F.length(line) - less
    pieces = []
    for i in range(fine):
        start, stop = F.floor(length * i / fine).cast("int"), F.floor(length * (i + 1) / fine).cast("int")
        before = F.substr(line, F.lit(1), start)
        after = F.substr(line, stop + 1 + less, F.length(line))
        key = F.xxhash64(F.lit(i), length, before, after)
        pieces.append(F.struct(key.alias("key"), start.alias("start"), (stop + less).alias("stop"), F.lit(less).alias("less")))
    return pieces


def hot_partners(texts: DataFrame, fine: int, folder: str) -> DataFrame:
    """(h1, h2, partner): the least ``first`` of lines at most one edit away, from (h1, h2, line, first).

    A line may be its own partner; lines without another one may be missing.
    """
    line = F.col("line")
    pieces = texts.select(*LINE, F.inline(F.array(*_fine_pieces(line, 0, fine), *_fine_pieces(line, 1, fine))))
    shared = pieces.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    places = pieces.filter("start < stop").join(shared, "key").select(*LINE, "start", "stop", "less")
    places = staged(places, f"{folder}/places")
    without = F.concat(F.substr(line, F.lit(1), F.col("p")), F.substr(line, F.col("p") + 2, F.length(line)))
    cut = (
        places.join(texts, LINE)
        .withColumn("p", F.explode(F.sequence("start", F.col("stop") - 1)))
        .select(*LINE, "first", "less", "p", F.xxhash64(without).alias("r1"), F.xxhash64(F.lit("second"), without).alias("r2"))
        .distinct()
    )
    cut = staged(cut, f"{folder}/cut")
    same_length = cut.filter("less = 0").drop("less")
    earliest = same_length.groupBy("r1", "r2", "p").agg(F.min("first").alias("partner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    replaced = same_length.join(earliest, ["r1", "r2", "p"]).select(*LINE, "partner")
    shorter = texts.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("first").alias("short_first"))
    longer = cut.filter("less = 1").join(shorter, ["r1", "r2"])
    gained = longer.select(*LINE, F.col("short_first").alias("partner"))
    lost = longer.groupBy("r1", "r2").agg(F.min("first").alias("partner")).select(F.col("r1").alias("h1"), F.col("r2").alias("h2"), "partner")
    found = replaced.union(gained).union(lost).groupBy(*LINE).agg(F.min("partner").alias("partner"))
    return staged(found, f"{folder}/hot_partners")


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits.

    One integer holds the differences between neighbouring rows of a band of 2 t + 1 rows; it moves
    down one row with every character of ``b``, and ``score`` follows the band's lowest row.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    bottom = 1 << (width - 1)
    high = sum(1 << (width - 1 - k) for k in range(threshold + 1))

    def step(state: Column, j: Column, left: Column, right: Column) -> Column:
        char = F.get(right, j)
        match = reduce(
            lambda x, y: x.bitwiseOR(y),
            [
                F.when((j + k - threshold >= 0) & F.get(left, j + k - threshold).eqNullSafe(char), 1 << k).otherwise(0)
                for k in range(width)
            ],
        )
        up, down = state["up"], state["down"]
        same = ((match.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(match).bitwiseOR(down).bitwiseAND(full)
        return F.struct(state["score"].alias("score"), up.alias("up"), down.alias("down"), same.alias("same"))

    def advance(s: Column) -> Column:
        across_up = s["down"].bitwiseOR(F.bitwise_not(s["same"].bitwiseOR(s["up"])).bitwiseAND(full))
        across_down = s["same"].bitwiseAND(s["up"])
        slid = F.shiftright(s["same"], 1)
        return F.struct(
            (s["score"] + F.when(s["same"].bitwiseAND(bottom) == 0, 1).otherwise(0)).cast("int").alias("score"),
            across_down.bitwiseOR(F.bitwise_not(slid.bitwiseOR(across_up)).bitwiseAND(full)).cast("int").alias("up"),
            slid.bitwiseAND(across_up).cast("int").alias("down"),
        )

    def once(value: Column, use) -> Column:
        """Apply ``use`` to a value that is computed once, not at each mention."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    start = F.struct(F.lit(threshold).alias("score"), F.lit(high).alias("up"), F.lit(0).alias("down"))
    spare = F.length(b) + threshold - F.length(a)  # rows of the band below the last one of a

    def finish(s: Column) -> Column:
        # after the last step the band stands one row lower, its lowest row is not yet scored
        mask = F.call_function("shiftleft", F.lit(1), spare.cast("int")) - 1
        low = F.call_function("shiftleft", mask, (F.lit(width - 1) - spare).cast("int"))
        return s["score"] - F.bit_count(s["up"].bitwiseAND(low)) + F.bit_count(s["down"].bitwiseAND(low))

    steps = F.sequence(F.lit(0), F.length(b) - 1)

    def walk(chars: Column) -> Column:
        return F.aggregate(steps, start, lambda s, j: once(step(s, j, chars["left"], chars["right"]), advance), finish)

    characters = F.struct(F.split(a, "").alias("left"), F.split(b, "").alias("right"))
    distance = F.when(F.length(b) == 0, F.length(a)).otherwise(once(characters, walk))
    return (F.abs(F.length(a) - F.length(b)) <= threshold) & (distance <= threshold)


def _joined(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Pairs (x, y) of lines that share a key, each pair once."""
    a = index.select("key", F.struct(*LINE).alias("x"))
    b = probe.select("key", F.struct(*LINE).alias("y"), "same_length")
    found = a.join(b, "key").filter((F.col("x") < F.col("y")) | (~F.col("same_length") & (F.col("x") != F.col("y"))))
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _keyed(lines: DataFrame, index: list[Column], probe: list[tuple[Column, bool]]) -> tuple[DataFrame, DataFrame]:
    probes = [F.struct(key.alias("key"), F.lit(same).alias("same_length")) for key, same in probe]
    return (
        lines.select(*LINE, F.explode(F.array(*index)).alias("key")),
        lines.select(*LINE, F.inline(F.array(*probes))),
    )


def near_lines(
    documents: DataFrame, lines: DataFrame, folder: str, threshold: int, min_chars: int, hot_lines: int, fine: int
) -> tuple[DataFrame, DataFrame | None]:
    """Verified pairs of distinct lines (x, y as structs of both hashes) within ``threshold`` edits, and partners by hot keys."""
    keys = F.col("keys")
    n_index = threshold + 1
    n_own = len([s for i in range(n_index) for s in range(-i, i + 1) if abs(s) <= threshold - i])
    n_all = len(probe_keys(F.lit("x"), threshold))
    index, probe = _keyed(
        lines,
        [F.get(keys, F.lit(i)) for i in range(n_index)],
        [(F.get(keys, F.lit(n_index + i)), i < n_own) for i in range(n_all)],
    )
    if threshold == 1:
        counts = index.groupBy("key").count().filter(F.col("count") > hot_lines).select("key")
        hot = staged(counts, f"{folder}/hot")
        is_hot = hot.limit(1).count() > 0
    else:
        is_hot = False
    partners = None
    if is_hot:
        small_hot = broadcast_if_few(hot)
        hot_ids = index.join(small_hot, "key", "left_semi").select(*LINE)
        hot_ids = hot_ids.union(probe.join(small_hot, "key", "left_semi").select(*LINE)).distinct()
        hot_ids = staged(hot_ids, f"{folder}/hot_lines")
        texts = _occurrences(documents, min_chars).join(broadcast_if_few(hot_ids), LINE, "left_semi")
        texts = texts.groupBy(*LINE).agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
        partners = hot_partners(staged(texts, f"{folder}/hot_texts"), fine, folder)
        index = index.join(small_hot, "key", "left_anti")
    pairs = _joined(index, probe).distinct()
    pairs = staged(pairs, f"{folder}/pairs")
    ids = pairs.select("x.*").union(pairs.select("y.*")).distinct()
    texts = _occurrences(documents, min_chars).join(broadcast_if_few(staged(ids, f"{folder}/ids")), LINE, "left_semi")
    texts = staged(texts.groupBy(*LINE).agg(F.first("line").alias("line")), f"{folder}/texts")
    side = {s: texts.select(F.struct(*LINE).alias(s), F.col("line").alias(f"{s}_line")) for s in "xy"}
    near = (
        pairs.join(side["x"], "x")
        .join(side["y"], "y")
        .repartition(scan_tasks(documents), "x", "y")
        .filter(within_edits(F.col("x_line"), F.col("y_line"), threshold))
        .select("x", "y")
    )
    return near, partners


def dedup_lines(
    documents: DataFrame,
    threshold: int = 1,
    min_chars: int = 40,
    hot_lines: int = 32,
    fine: int = 32,
) -> DataFrame:
    """The documents with their text reduced, and the longs ``n_lines`` and ``dropped_lines``."""
    spark = documents.sparkSession
    folder = work_folder(spark, "lines")
    line = F.col("line")
    occurrences = _occurrences(documents, min_chars)
    lines = (
        occurrences.withColumn("keys", F.array(*index_keys(line, threshold), *probe_keys(line, threshold)))
        .groupBy(*LINE)
        .agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    )
    lines = staged(lines, f"{folder}/lines")
    near, hot = near_lines(documents, lines, folder, threshold, min_chars, hot_lines, fine)
    near = staged(near, f"{folder}/near")
    both = near.union(near.selectExpr("y", "x"))
    firsts = lines.select(F.struct(*LINE).alias("y"), F.col("first").alias("y_first"))
    partners = both.join(firsts, "y").groupBy("x").agg(F.min("y_first").alias("partner")).select("x.*", "partner")
    if hot is not None:
        partners = partners.union(hot).groupBy(*LINE).agg(F.min("partner").alias("partner"))
    partners = staged(partners, f"{folder}/partners")
    decided = (
        lines.join(partners, LINE, "left")
        .withColumn("gone", F.coalesce(F.col("partner") < F.col("first"), F.lit(False)))
        .filter("n > 1 OR gone")
        .select(*LINE, "first", "gone")
    )
    decided = staged(decided, f"{folder}/decided")
    at = F.struct("doc_id", "th", "pos")
    dropped = (
        occurrences.select("doc_id", "th", "pos", *LINE)
        .join(broadcast_if_few(decided), LINE)
        .filter(F.col("gone") | (F.col("first") != at))
        .groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"))
        .agg(F.collect_set("pos").alias("gone_lines"))
    )
    dropped = staged(dropped, f"{folder}/dropped")
    for name in ("hot", "hot_lines", "hot_texts", "places", "cut", "hot_partners", "pairs", "ids", "texts", "lines", "near", "partners", "decided"):
        drop_folder(spark, f"{folder}/{name}")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone_lines")
    kept = F.transform(stay, lambda i: F.get(parts, i))
    columns = [c for c in documents.columns if c not in ("n_lines", "dropped_lines")]  # these are replaced
    # The hash is a column of its own, so that the join's sort does not compute it at every comparison.
    others = F.struct(*[c for c in columns if c != "text"]).alias("document")
    hashed = documents.select(others, "text", F.xxhash64("text").alias("th"), "doc_id")
    found = hashed.join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    reduced = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return found.select(
        *[(reduced if c == "text" else F.col("document")[c]).alias(c) for c in columns],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone_lines").isNull(), 0).otherwise(F.size("gone_lines")).cast("long").alias("dropped_lines"),
    )
