"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster with centre c and largest angle
t between c and its anchors, no anchor u of it scores more with a row v than

    |u| |v| cos(max(0, angle(v, c) - t))

so all its anchors share one list of rows, sorted once by |v| cos(...). A list
is written in chunks, and chunks belong to pages that hold four times as many
rows each as the one before. All searches that are still open take the next page of their
cluster's list, chunk by chunk and block of searches by block; a search ends as soon
as the bound at the next page's head, times |u|, cannot reach its k-th best score any
more, or the least score it accepts. So results are exact, whatever the clusters,
and the rounds grow with the logarithm of the rows.

One search form serves both steps: the best k rows of the same or of another
label whose scores lie in a window. First each anchor's positives, then for
each positive the negatives between two shares of its score.

Edge cases: rows with a null label take no part, nor do rows whose vector is
null or incomplete (see `whitening.usable`), or has another length than most.
Rows without id can be found but are no anchors; in ties they come last. Rows
that repeat are found as often as they occur, but no row with the anchor's id.
Null vectors and anchors without positives give nothing, as does an empty
table. Other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovework.llm.common import slices, written
from grovework.llm.whitening import matrix, of_one_length

#: Stands for the missing id: it sorts last.
NO_ID = 2**63 - 1
#: Far below the gap that a rounding error could make in a bound.
SLACK = 1e-6
OPEN_LOW, OPEN_HIGH = -(2**62), 2**62


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres_of(anchors: DataFrame, size: int, clusters: int, fit_rows: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over at most `fit_rows` anchors, those of the smallest
    hash; any centres give right results, good ones short walks."""
    sample = anchors.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(fit_rows).select("vec").toArrow().to_batches()
    x = unit_rows(np.vstack([matrix(b, 0, size) for b in sample] or [np.zeros((0, size))]))
    x = x[np.abs(x).any(axis=1)]
    if not len(x):
        return np.eye(1, size)
    found = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = (x @ found.T).argmax(axis=1)
        found = unit_rows(np.array([x[nearest == k].sum(axis=0) if (nearest == k).any() else found[k] for k in range(len(found))]))
    return found


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(x) @ centres.T, -1.0, 1.0))


def assigned(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """`anchors` (id, label, vec) with cluster, angle to its centre and norm."""
    size = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, 2, size)
            found = angles(x, centres)
            cluster = found.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cluster, pa.int32()), pa.array(found[np.arange(len(x)), cluster]), pa.array(np.linalg.norm(x.astype(float), axis=1))],
                names=[*batch.schema.names, "cluster", "angle", "norm"],
            )

    return anchors.select("id", "label", "vec").mapInArrow(run, "id long, label int, vec array<long>, cluster int, angle double, norm double")


def bounds(rows: DataFrame, centres: np.ndarray, reach: np.ndarray, whole: bool = True) -> DataFrame:
    """(cluster, bound), if `whole` with id, label and vec as bytes: each row for
    each cluster that has anchors."""
    size = centres.shape[1]
    used = np.flatnonzero(reach >= 0)
    names = ["cluster", "bound", "id", "label", "vec"][: 5 if whole else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = matrix(batch, 2, size)
            away = np.maximum(0.0, angles(x, centres[used]) - reach[used])
            length = np.linalg.norm(x.astype(float), axis=1)
            bound = (np.cos(away) + SLACK) * length[:, None]
            at = pa.array(np.repeat(np.arange(len(x)), len(used)))
            own = [*batch.columns[:2], pa.array(packed_rows(x), pa.binary())] if whole else []
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(used, len(x)), pa.int32()), pa.array(bound.ravel()), *(c.take(at) for c in own)], names=names)

    return rows.select("id", "label", "vec").mapInArrow(run, "cluster int, bound double" + ", id long, label int, vec binary" * whole)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, two for each where they fit, else eight."""
    small = np.abs(x).max(initial=0) < 2**15
    return (b"2" if small else b"8") + x.astype("<i2" if small else "<i8").tobytes()


def packed_rows(x: np.ndarray) -> list[bytes]:
    """`packed` of each row, all of one width."""
    data = packed(x)
    width = (len(data) - 1) // max(1, len(x))
    return [data[:1] + data[at : at + width] for at in range(1, 1 + width * len(x), width)] if width else [data[:1]] * len(x)


def joined(rows: list[bytes], size: int) -> bytes:
    """Packed rows, of different widths perhaps, as one packed matrix."""
    if len({r[:1] for r in rows}) == 1:
        return rows[0][:1] + b"".join(r[1:] for r in rows)
    return packed(np.vstack([unpacked(r, 1, size).astype(np.int64) for r in rows]))


def unpacked(data: bytes, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(data[1:], "<i2" if data[:1] == b"2" else "<i8").reshape(rows, size)


def shared_lists(rows: DataFrame, centres: np.ndarray, reach: np.ndarray, page_rows: int, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """The lists in chunks (cluster, page, top, ids, labels, vecs), sorted by
    bound, and (cluster, page, top) of all pages. Page k ends at the quantile
    that leaves page_rows * (1 + 4 + .. + 4^k) rows before it."""
    n, size = rows.count(), centres.shape[1]  # each list holds all rows
    ends, held = [], page_rows
    while held < n:
        ends.append(held)
        held = 4 * held + page_rows
    # quantiles need not be exact: a page's bound is measured on its chunks
    shares = [1.0 - e / n for e in ends] or [0.0]
    cuts = bounds(rows, centres, reach, whole=False).groupBy("cluster").agg(F.percentile_approx("bound", [float(s) for s in shares], 2000).alias("cuts"))
    page = F.size(F.filter("cuts", lambda c: c > F.col("bound"))) if ends else F.lit(0)
    dealt = bounds(rows, centres, reach).join(F.broadcast(cuts), "cluster").withColumn("page", page)  # cuts: one row for each cluster
    # equal bounds may hold any share of the rows, so a hash of the rest cuts them
    order = ["cluster", "page", F.desc("bound"), F.xxhash64("vec", "id")]
    dealt = dealt.select("cluster", "page", "bound", "id", "label", "vec").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chunk_rows):
            own = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            starts = np.concatenate(([0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1)) if batch.num_rows else []
            out = []
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                cut = batch.slice(at, end - at)
                ids = cut.column(3).fill_null(NO_ID).to_numpy()
                out.append((cut.column(0)[0].as_py(), cut.column(1)[0].as_py(), float(cut.column(2).to_numpy().max()), ids.astype("<i8").tobytes(), cut.column(4).to_numpy().astype("<i4").tobytes(), joined(cut.column(5).to_pylist(), size)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    names = ["cluster", "page", "top", "ids", "labels", "vecs"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    chunks = written(dealt.mapInArrow(run, "cluster int, page int, top double, ids binary, labels binary, vecs binary"), "lists")
    return chunks, written(chunks.groupBy("cluster", "page").agg(F.max("top").alias("top")), "pages")


def scores_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles, which are fast, where those are exact."""
    most = int(np.abs(u).max(initial=0)) * int(np.abs(v).max(initial=0)) * u.shape[1]
    if most < 2**53:
        return np.rint(u.astype(float) @ v.T.astype(float)).astype(np.int64)
    return u.astype(np.int64) @ v.T.astype(np.int64)


def best_of_chunk(search: dict[str, np.ndarray], u: np.ndarray, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, int]]:
    """(row of the search, id, score) of the best k rows of a chunk for each search."""
    scores = scores_of(u, v)
    for row, anchor in enumerate(at.tolist()):
        own = scores[anchor]
        fits = (own >= max(search["lo"][row], search["kth"][row])) & (own <= search["hi"][row]) & ((labels == search["label"][row]) == same) & (ids != search["id"][row])
        found = np.flatnonzero(fits)
        if len(found) > k:
            found = found[own[found] >= np.partition(own[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((ids[found], -own[found]))][:k]
        yield from ((row, int(i), int(s)) for i, s in zip(ids[found], own[found]))


def walked_page(open_: DataFrame, chunks: DataFrame, size: int, same: bool, k: int, block_rows: int) -> DataFrame:
    """(id, of, found, score): what the open searches find in the chunks of their page."""
    blocks = (
        open_.repartitionByRange("cluster", F.xxhash64("id"))
        .sortWithinPartitions("cluster", "id", "of")
        .select("cluster", "id", "of", "row", "label", "lo", "hi", "kth", "norm", "vec")
    )
    kinds = {"id": "<i8", "of": "<i8", "row": "<i8", "label": "<i4", "lo": "<i8", "hi": "<i8", "kth": "<i8", "norm": "<f8"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block_rows):
            cluster = batch.column(0).to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(cluster[1:] != cluster[:-1]) + 1)) if batch.num_rows else []
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                cut = batch.slice(at, end - at)
                columns = [pa.array([cut.column(n + 1).to_numpy().astype(t).tobytes()], pa.binary()) for n, t in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([cut.column(0)[:1], *columns, pa.array([packed(matrix(cut, 9, size))], pa.binary())], names=["cluster", *kinds, "us"])

    packs = blocks.mapInArrow(pack, "cluster int, " + ", ".join(f"{c} binary" for c in kinds) + ", us binary")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            *fields, us, top, ids, labels, vecs = (c[0].as_py() for c in batch.columns)
            search = {c: np.frombuffer(x, t) for (c, t), x in zip(kinds.items(), fields)}
            # this chunk's own bound may already be too low for some
            rows = len(search["norm"])
            live = np.flatnonzero(search["norm"] * top >= np.maximum(search["lo"], search["kth"]))
            if not len(live):
                continue
            search = {c: x[live] for c, x in search.items()}
            _, first, at = np.unique(search["row"], return_index=True, return_inverse=True)
            u = unpacked(us, rows, size)[live][first]
            own = np.frombuffer(ids, "<i8")
            out = list(best_of_chunk(search, u, at, own, np.frombuffer(labels, "<i4"), unpacked(vecs, len(own), size), same, k))
            of, found, score = (np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(search["id"][of]), pa.array(search["of"][of]), pa.array(found), pa.array(score)], names=["id", "of", "found", "score"])

    met = packs.join(chunks, "cluster").select(*kinds, "us", "top", "ids", "labels", "vecs")
    return met.mapInArrow(walk, "id long, of long, found long, score long")


def search(searches: DataFrame, chunks: DataFrame, pages: DataFrame, size: int, same: bool, k: int, block_rows: int = 256) -> DataFrame:
    """(id, of, found, score, rank) for searches (id, of, row, label, lo,
    hi, vec, cluster, norm): the best k rows with scores from lo to hi, of the
    same label or of another. `row` tells anchors apart, `of` the searches of an id."""
    last = pages.agg(F.max("page")).first()[0]
    rank = F.row_number().over(Window.partitionBy("id", "of").orderBy(F.desc("score"), "found"))
    open_ = searches.withColumn("kth", F.lit(OPEN_LOW))
    best = None
    for page in range((-1 if last is None else last) + 1):
        own = chunks.filter(F.col("page") == page).drop("page")
        found = walked_page(open_, own, size, same, k, block_rows)
        found = found if best is None else found.unionByName(best)
        best = written(found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "best")
        if page < last:
            # what the rest of a list can reach, from the pages to come
            rest = pages.filter(F.col("page") > page).groupBy("cluster").agg(F.max("top").alias("top"))
            kth = best.groupBy("id", "of").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
            now = searches.join(F.broadcast(rest), "cluster").join(kth, ["id", "of"], "left")  # rest: one row for each cluster
            now = now.withColumn("kth", F.coalesce("least", F.lit(OPEN_LOW))).drop("least")
            open_ = written(now.filter(F.col("norm") * F.col("top") >= F.greatest("lo", "kth")).drop("top"), "open")
            if open_.isEmpty():
                break
    return searches.sparkSession.createDataFrame([], "id long, of long, found long, score long, rank int") if best is None else best.withColumn("rank", rank)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    clusters: int = 8,
    fit_rows: int = 4096,
    page_rows: int = 4096,
    chunk_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    from `rows` (id long, label int, vec array of whole numbers): for each anchor
    and each of its `positives` best rows of its label the best `negatives` rows
    of other labels that score between `low` and `high` percent of the positive."""
    rows, size = of_one_length(rows.select("id", "label", "vec").filter("label IS NOT NULL AND vec IS NOT NULL"), "vec")
    rows = written(rows, "vectors")
    anchors = rows.filter(is_anchor & F.col("id").isNotNull()).dropDuplicates(["id", "label", "vec"])
    centres = centres_of(anchors, size, clusters, fit_rows)
    members = written(assigned(anchors, centres), "anchors")
    reach = np.full(len(centres), -1.0)
    for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():
        reach[r.cluster] = r.angle + SLACK
    chunks, pages = shared_lists(rows, centres, reach, page_rows, chunk_rows)
    members = members.withColumn("row", F.xxhash64("label", "vec"))
    ask = members.select("id", F.col("row").alias("of"), "row", "label", F.lit(OPEN_LOW).alias("lo"), F.lit(OPEN_HIGH).alias("hi"), "vec", "cluster", "norm")
    near = written(search(ask, chunks, pages, size, True, positives), "positives")
    of = F.xxhash64("p.of", "p.rank").alias("of")
    share = lambda percent: F.col("p.score").cast("decimal(20,0)") * percent / 100
    m = members.select("id", "row", "label", "vec", "cluster", "norm").alias("m")
    window = near.alias("p").join(m, (F.col("m.id") == F.col("p.id")) & (F.col("m.row") == F.col("p.of")))
    window = window.select(
        F.col("p.id").alias("id"), of, "row", "label", F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi"),
        "vec", "cluster", "norm", F.col("p.found").alias("positive"), F.col("p.score").alias("positive_score"),
    )
    window = written(window.filter("lo <= hi"), "windows")
    far = search(window.drop("positive", "positive_score"), chunks, pages, size, False, negatives)
    told = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return window.select("id", "of", "positive", "positive_score").join(far, ["id", "of"]).select(
        F.col("id").alias("anchor_id"), told("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), told("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
