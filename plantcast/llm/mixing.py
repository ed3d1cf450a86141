r"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The size of a document is its number of words ``[^\x20\x09-\x0D]+``. Sources, ordered by code point
with null last, weigh 3, 1, 2, repeating, and share ``share`` times all words; no target exceeds
``limit`` times its source's size, what is over is shared again by weight.

Document rates minimise the sum of r ln r - r under one constraint per source, that the rates times
the sizes give its target, and the bound r <= ``limit``. The solution is r = min(limit, exp(l z))
with one multiplier l per source and z the size over the source's mean; Newton's method on the dual,
kept inside a shrinking bracket, finds all multipliers at once. Each iteration is one aggregation
over the counts of (source, size), in whole numbers, so that sums do not depend on their order.
Rates become copies by rounding running sums from long to short sizes; what is then missing from a
source's target is made up by its shortest documents. Documents of equal source and size share their
copies by a hash of doc_id and text.

Defined results: null and empty texts have size 0 and one copy; a null source is a source of its own;
repeated rows get equal copies, which can move a source from its target by their size; sources
without words have target 0. An empty table gives an empty table. Further columns pass through
unchanged; an input column named like one of the four results is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantcast.llm.common import broadcast_if_few, drop_folder, staged, work_folder

WEIGHTS = (3, 1, 2)
GRID = float(1 << 16)  # sums are taken over whole multiples of 1 / GRID words
SLICE_ROWS = 4096
SOURCE = ["no_source", "source_key"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumns(
        {
            "no_source": F.col("source").isNull(),
            "source_key": F.coalesce("source", F.lit("")),
            "size": word_count(F.col("text")),
            "draw": F.xxhash64("doc_id", "text"),
        }
    )


def source_targets(counts: DataFrame, share: float, limit: int) -> DataFrame:
    """(no_source, source_key, source_size, target) from counts of (source, size)."""
    sizes = counts.groupBy(*SOURCE).agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("documents"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn(
        "weight", F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(*SOURCE)) - 1) % len(WEIGHTS))
    ).withColumns({"cap": F.col("source_size") * limit, "all_words": F.sum("source_size").over(everything)})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), *SOURCE)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumn(
        "level",
        (F.col("all_words") * share - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    open_level = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))
    levelled = filled.withColumn("level", F.first(open_level, ignorenulls=True).over(
        Window.orderBy(F.col("cap") / F.col("weight"), *SOURCE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return levelled.select(*SOURCE, "source_size", "documents", "least", target.alias("target"))


def _rate(limit: int) -> Column:
    """Rate of a size under the multiplier of its source; full sources take the limit."""
    tilt = F.col("multiplier") * F.col("size") / F.col("mean")
    return F.when(F.col("full"), float(limit)).otherwise(F.least(F.lit(float(limit)), F.exp(F.least(tilt, F.lit(50.0)))))


def multipliers(counts: DataFrame, targets: DataFrame, folder: str, limit: int, rounds: int = 80) -> DataFrame:
    """``targets`` with mean, full and the multiplier of each source."""
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9))
    ratio = F.try_divide("target", "source_size")
    state = targets.withColumns({"mean": mean, "full": F.coalesce(ratio >= limit * (1 - 1e-12), F.lit(True))})
    state = state.withColumns(
        {
            "multiplier": F.when(F.col("full"), 0.0).otherwise(F.ln(ratio)),
            "low": F.when(~F.col("full"), F.least(F.lit(0.0), F.ln(ratio) * F.col("mean") / F.col("least"))),
            "high": F.when(~F.col("full"), F.ln(F.lit(float(limit))) * F.col("mean") / F.col("least")),
            "done": F.col("full"),
        }
    )
    columns = state.columns
    state = staged(state, f"{folder}/state0")
    for k in range(1, rounds + 1):
        if not state.filter("NOT done").limit(1).count():
            break
        words = F.col("n") * F.col("size")
        tilted = counts.join(broadcast_if_few(state), SOURCE).filter("NOT done")
        slope = F.when(F.col("rate") < limit, words * F.col("rate") * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (
            tilted.withColumn("rate", _rate(limit))
            .groupBy(*SOURCE)
            .agg(
                (F.sum(F.rint(words * F.col("rate") * GRID).cast("long")) / GRID).alias("taken"),
                (F.sum(F.rint(slope * 64).cast("long")) / 64).alias("slope"),
            )
        )
        over = F.col("taken") > F.col("target")
        step = F.col("multiplier") - (F.col("taken") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        moved = (
            state.join(sums, SOURCE, "left")
            .withColumns({"low": F.when(F.col("taken").isNull(), F.col("low")).otherwise(low), "high": F.when(F.col("taken").isNull(), F.col("high")).otherwise(high)})
            .withColumn("step", step)
            .withColumn("settled", F.col("done") | (F.abs(F.col("taken") - F.col("target")) <= 1e-7 * F.col("target")))
        )
        inside = F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(middle)
        moved = moved.withColumn("multiplier", F.when(F.col("settled"), F.col("multiplier")).otherwise(inside))
        state = staged(moved.withColumn("done", F.col("settled")).select(*columns), f"{folder}/state{k}")
    return state


def group_copies(counts: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """Copies of every (source, size): running sums rounded, then the rest on the shortest sizes."""
    long_first = Window.partitionBy(*SOURCE).orderBy(F.desc("size"))
    short_first = Window.partitionBy(*SOURCE).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*SOURCE)
    joined = counts.join(state, SOURCE).withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(limit)))
    upto = F.sum(F.col("n") * F.col("rate")).over(long_first)
    rounded = joined.withColumn("upto", F.floor(upto + 0.5)).withColumn(
        "copies", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(long_first), F.lit(0)), F.col("n") * limit)
    )
    rest = rounded.withColumn("rest", F.rint("target").cast("long") - F.sum(F.col("copies") * F.col("size")).over(whole))
    room = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, F.col("n") * limit - F.col("copies")).otherwise(F.col("copies"))
    moved = rest.withColumn("room", room).withColumn(
        "used", F.coalesce(F.sum(F.col("room") * F.col("size")).over(short_first), F.lit(0))
    )
    more = F.least(F.col("room"), F.greatest(F.lit(0), F.floor((F.abs("rest") - F.col("used")) / F.greatest("size", F.lit(1)))))
    return moved.withColumn("copies", F.col("copies") + F.signum("rest").cast("long") * more).select(
        *SOURCE, "size", "n", "copies", "source_size", "target"
    )


def mix_sources(documents: DataFrame, share: float = 1.5, limit: int = 2) -> DataFrame:
    """The documents with the longs ``size``, ``source_size``, ``copies`` and the double ``target``."""
    spark = documents.sparkSession
    folder = work_folder(spark, "mix")
    columns = [c for c in documents.columns if c not in ("size", "source_size", "target", "copies")]
    slim = staged(_keyed(documents.select("doc_id", "text", "source")).select(*SOURCE, "size", "draw"), f"{folder}/slim")
    counts = staged(slim.groupBy(*SOURCE, "size").agg(F.count("*").alias("n")), f"{folder}/counts")
    targets = staged(source_targets(counts, share, limit), f"{folder}/targets")
    state = multipliers(counts, targets, folder, limit)
    groups = group_copies(counts, state, limit)
    slices = F.ceil(F.col("n") / SLICE_ROWS)
    groups = groups.withColumns({"each": F.floor(F.col("copies") / F.col("n")), "slices": slices})
    groups = staged(groups.withColumn("extra", F.col("copies") - F.col("each") * F.col("n")), f"{folder}/groups")

    # The documents of a group that get one copy more: those of the smallest draws of each slice.
    key = [*SOURCE, "size"]
    split = groups.filter("extra > 0").select(*key, "n", "extra", "slices")
    drawn = slim.join(broadcast_if_few(split), key).withColumn("slice", F.pmod("draw", "slices"))
    per_slice = drawn.groupBy(*key, "slice", "n", "extra").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*key).orderBy("slice"))
    per_slice = per_slice.withColumn("upto", upto).withColumn(
        "part",
        F.floor(F.col("extra") * F.col("upto") / F.col("n"))
        - F.floor(F.col("extra") * (F.col("upto") - F.col("rows")) / F.col("n")),
    )
    rank = F.row_number().over(Window.partitionBy(*key, "slice").orderBy("draw"))
    last = (
        drawn.select(*key, "slice", "draw")
        .withColumn("rank", rank)
        .join(per_slice.select(*key, "slice", "part"), [*key, "slice"])
        .filter("rank = part")
        .select(*key, "slice", F.col("draw").alias("upto_draw"))
    )
    chosen = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).join(last, [*key, "slice"], "left")
    chosen = staged(chosen.select(*key, "slice", "slices", "each", "upto_draw"), f"{folder}/chosen")
    sources = targets.select(*SOURCE, "source_size", "target")
    # all input columns travel in one, so none meets a column made here
    packed = documents.select("doc_id", "text", "source", F.struct(*columns).alias("document"))
    rows = _keyed(packed).drop("doc_id", "text", "source")
    plain = groups.select(*key, F.col("slices").alias("cut"))
    cut = rows.join(broadcast_if_few(plain), key).withColumn("slice", F.pmod("draw", "cut"))
    picked = cut.join(broadcast_if_few(chosen), [*key, "slice"])
    copies = F.col("each") + F.when(F.col("draw") <= F.col("upto_draw"), 1).otherwise(0)
    mixed = picked.withColumn("copies", copies.cast("long")).join(broadcast_if_few(sources), SOURCE)
    for name in ("slim", "counts"):
        drop_folder(spark, f"{folder}/{name}")
    return mixed.select(*[F.col("document")[c].alias(c) for c in columns], "size", "source_size", "target", "copies")
