"""Mixing sources to target weights over a time-varying curriculum.

Targets: sources get weights in turn; the words of all documents are shared out
by weight, no source above `most` times its own words, and the excess is shared
again by weight until none is above. Sorted by words for a unit of weight, the
sources that hit their limit come first, so one pass of running sums finds the
common level of the others.

Which words: the documents of a source form a stream in the order of a hash. The target takes the stream from its start, again and again, so all
documents are taken equally often but for the last, partial pass.

When: each source has a weight schedule over training time, here piecewise
linear. Its integral says which share of the source's words is consumed by a
moment; inverted, it gives the moment at which the word at the start of a
document is due. Sorting all occurrences by that position (range partitioning,
no global sort in one task) gives the training order.

Running sums over a source are made in two levels: sums for each of 4096 hash
ranges of a source, then within the range; so a source may hold most rows.

Edge cases: null and empty texts have no words and are never taken; a null
source is a source of its own, the last one. The hash is one of id, size and
text, so rows that share an id are spread as others are; rows equal in all
three are interchangeable. Sources without words get the target 0. An empty
table gives an empty result. Added columns start with `mix_`, with underscores
in front where the table has such columns already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovework.llm.common import WORD, free_prefix, source_order, written

WEIGHTS = (5.0, 2.0, 1.0)
#: For the sources in turn: (time, weight) knots over training time 0 to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.8), (1.0, 1.9)), ((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)))
RANGES = 4096


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(mix_source, mix_turn, mix_source_size, mix_target) from rows (mix_source,
    mix_size). Windows over the sources, of which there are few, not the rows."""
    by_source = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    turn = (F.row_number().over(Window.orderBy(*source_order("mix_source"))) - 1) % len(weights)
    rows = by_source.withColumn("mix_turn", turn.cast("int"))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("mix_turn") + 1))
    limit = most * F.col("mix_source_size")
    by_level = Window.orderBy(limit / F.col("w"), *source_order("mix_source"))
    rows = rows.select(
        "*",
        F.coalesce(F.sum(limit).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("spent"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
        F.sum("mix_source_size").over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    level = (F.col("total") - F.col("spent")) / F.col("w_left")
    open_level = F.first(F.when(limit > level * F.col("w"), level), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", open_level)
    return rows.select("mix_source", "mix_turn", "mix_source_size", F.coalesce(F.least(limit, F.col("level") * F.col("w")), limit).alias("mix_target"))


def _pieces(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(start time, length, weight at the start, slope, area before, area after) of
    each piece, areas as shares of the whole."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
        after = before + (t1 - t0) * (v0 + v1) / 2 / area
        out.append((t0, t1 - t0, v0 / area, (v1 - v0) / area / (t1 - t0), before, after))
        before = after
    return out


def moment(turn: Column, share: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which a source's schedule has consumed `share` of its words."""
    out = F.lit(None).cast("double")
    for n, knots in enumerate(schedules):
        at = F.lit(1.0)
        for t0, length, v0, slope, before, after in reversed(_pieces(knots)):
            left = F.greatest(share - before, F.lit(0.0))
            # the root of v0 x + slope x^2 / 2 = left, in a form that bears slope 0
            root = 2 * left / (v0 + F.sqrt(F.greatest(v0 * v0 + 2 * slope * left, F.lit(0.0))))
            x = F.when(left > 0, F.least(root, F.lit(length))).otherwise(0.0)
            at = F.when(share < after, t0 + x).otherwise(at)
        out = F.when(turn == n, at).otherwise(out)
    return out


def mixed(
    docs: DataFrame,
    size: Column | None = None,
    order: Column | None = None,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    most: float = 3.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    whole: bool = False,
) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target, mix_taken (words) and
    mix_positions, the training position of each pass that takes of the document.

    `size` and `order` (a 64-bit hash) stand in for the text where it is absent.
    With `whole`, the last pass takes whole documents only, those of which it
    would take at least half; a source's words then miss its target by half a
    document at most.
    """
    own = free_prefix(docs.columns, "mix_")
    c = lambda name: F.col(own + name)
    hashed = order if order is not None else F.xxhash64(F.col(id_col), F.col(text))
    rows = docs.withColumns(
        {
            # never null, so that the join and the window below share one shuffle
            f"{own}key": F.coalesce(F.concat(F.lit("v"), F.col(source).cast("string")), F.lit("n")),
            f"{own}size": words_in(text) if size is None else size,
            f"{own}order": hashed,
            f"{own}range": F.shiftrightunsigned(hashed, 64 - RANGES.bit_length() + 1).cast("int"),
        }
    )
    slim = rows.select(F.col(source).alias("mix_source"), c("key").alias("key"), c("range").alias("range"), c("size").alias("mix_size"))
    ranges = written(slim.groupBy("mix_source", "key", "range").agg(F.sum("mix_size").alias("mix_size")), "mix-ranges")
    before = F.sum("mix_size").over(Window.partitionBy("key").orderBy("range")) - F.col("mix_size")
    goals = targets(ranges, weights, most).withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("mix_source").cast("string")), F.lit("n")))
    starts = ranges.select("key", "range", before.alias("mix_before")).join(goals, "key")
    starts = starts.select(
        F.col("key").alias(f"{own}key"),
        F.col("range").alias(f"{own}range"),
        *(F.col(f"mix_{x}").alias(own + x) for x in ("before", "turn", "source_size", "target")),
    )
    within = Window.partitionBy(f"{own}key", f"{own}range").orderBy(f"{own}order", id_col, f"{own}size")
    start = c("before") + F.sum(c("size")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - c("size")
    found = rows.join(starts, [f"{own}key", f"{own}range"]).withColumn(f"{own}start", start)
    n, total, start = c("size"), c("source_size"), c("start")
    wanted = F.floor(c("target") + 1e-6)
    passes = F.when(total > 0, F.floor(wanted / total)).otherwise(0)
    rest = wanted - passes * total
    if whole:
        partly = F.when((n > 0) & (2 * start + n <= 2 * rest), n).otherwise(0)
    else:
        partly = F.greatest(F.lit(0), F.least(n, rest - start))
    found = found.withColumn(f"{own}taken", (passes * n + partly).cast("long"))
    times = F.when(c("taken") > 0, F.ceil(c("taken") / n)).otherwise(0).cast("int")
    share = lambda k: (k * total + start) / c("target")
    positions = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), lambda k: moment(c("turn"), share(k), schedules)))
    found = found.withColumn(f"{own}positions", F.coalesce(positions, F.array().cast("array<double>")))
    return found.select(*docs.columns, *(own + x for x in ("size", "source_size", "target", "taken", "positions")))


def in_order(rows: DataFrame, position: Column, *ties: Column | str) -> DataFrame:
    """Rows range-partitioned and sorted by position; rows without one are
    spread over the ranges after all others."""
    key = F.coalesce(position, 2 + F.pmod(F.xxhash64(*ties), F.lit(1_000_003)) / 1_000_003)
    name = free_prefix(rows.columns, "mix_") + "order"
    ranged = rows.withColumn(name, key)
    return ranged.repartitionByRange(name, *ties).sortWithinPartitions(name, *ties).select(*rows.columns)


def training_order(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents in training order, one row for each pass that takes of
    them, with their own columns: those not taken go, others repeat."""
    own = free_prefix(docs.columns, "mix_")
    rows = mixed(docs, id_col=id_col, whole=True, **options).select(*docs.columns, F.explode(f"{own}positions").alias(f"{own}position"))
    return in_order(rows, F.col(f"{own}position"), id_col).select(*docs.columns)
