"""Nearest-neighbour graphs by descent, for documents too large for all pairs.

Every node starts with a few arbitrary neighbours. In each round nodes that share
a neighbour, in either direction, are compared, and each keeps the `width` nearest
it has seen. Only pairs of which one is new to the list that brings them together
are made, and lists are cut by a hash that changes each round, so a round costs
each node a bounded number of comparisons, however popular it is. Rounds end
when fewer than `few` of all neighbours changed. The result is approximate:
`knn_graph` has the exact one.

Lists of some `BLOCK` nodes of a document meet in one task, to which each vector
goes once, so pairs are never shuffled with their vectors, and of the pairs only
those leave the task that may enter a node's list. A document of up to `COPIES`
blocks sends its vectors to each of them; in larger ones they go where they are
named, at most 2 * `most` for each node of a block. So the vectors of a task, and
those shuffled for a node, are bounded whatever the document's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.vectors import dot, doubles, unit
from grovework.operators.graph import written
from grovework.operators.pairs import _matrix

NODE = ("document_id", "v")
#: The nodes of a document whose lists meet in one task.
BLOCK = 16_384
#: A vector goes to no more blocks than this, save those where it is named.
COPIES = 8
#: The pairs that are compared at a time.
PAIRS = 65_536


def first_compared(rows: DataFrame, width: int, seed: int, orders: int = 4) -> DataFrame:
    """(document_id, v, u, sim) for pairs that give each node some `width`
    arbitrary neighbours: those next to a node in several hashed orders of its
    document, each cut into parts of some hundreds of nodes, so no document is
    sorted as a whole, while different orders tie all parts together."""
    parts = rows.groupBy("document_id").agg(F.ceil(F.count("*") / 512).cast("long").alias("g"))
    dealt = rows.join(parts, "document_id").select("document_id", "g", F.col("node_id").alias("v"), "x", F.explode(F.array(*map(F.lit, range(orders)))).alias("o"))
    hashed = dealt.withColumn("h", F.xxhash64("v", F.col("o") + seed))
    w = Window.partitionBy("document_id", "o", F.pmod("h", "g")).orderBy("h", "v")
    near = F.array_compact(F.array(*(F.lag(F.struct("v", "x"), k).over(w) for k in range(1, -(-width // (2 * orders)) + 1))))
    met = hashed.withColumn("near", near).select("document_id", "v", "x", F.explode("near").alias("u"))
    made = met.select("document_id", F.least("v", "u.v").alias("v"), F.greatest("v", "u.v").alias("u"), dot(F.col("x"), F.col("u.x")).alias("sim"))
    return made.filter(F.col("sim").isNotNull() & ~F.isnan("sim") & (F.col("v") < F.col("u")))


def both_ways(rows: DataFrame, *more: str) -> DataFrame:
    ends = F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))
    return rows.select("document_id", F.inline(ends), *more)


def nearest_seen(rows: DataFrame, width: int) -> DataFrame:
    """The `width` nearest of each node from rows (document_id, v, u, sim, new), which may repeat."""
    once = rows.repartition(*NODE).groupBy("document_id", "v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))  # known before: not new
    rank = F.row_number().over(Window.partitionBy(*NODE).orderBy(F.desc("sim"), "u"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= width).drop("rank")


def lists(state: DataFrame, sizes: DataFrame, most: int, salt: int) -> DataFrame:
    """(document_id, block, v, u, new): `most` new and `most` old neighbours, in
    either direction, of each node that has a new one, by blocks of nodes."""
    rows = both_ways(state, "new").join(sizes, "document_id").withColumn("block", F.pmod(F.xxhash64("v"), "g")).drop("g").repartition("document_id", "block")
    rows = rows.groupBy("document_id", "block", "v", "u").agg(F.max("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("document_id", "block", "v", "new").orderBy(F.xxhash64("u", F.lit(salt)), "u"))
    any_new = F.max("new").over(Window.partitionBy("document_id", "block", "v"))
    return rows.withColumns({"rank": rank, "any_new": any_new}).filter(F.col("any_new") & (F.col("rank") <= most)).drop("rank", "any_new")


def pairs_met(node: np.ndarray, member: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b, once each, of members of a node's list of which one is new there."""
    order = np.argsort(node, kind="stable")
    node, member, new = node[order], member[order], new[order]
    _, first, row = np.unique(node, return_index=True, return_inverse=True)
    at = np.arange(len(node)) - first[row]
    table = np.full((len(first), at.max() + 1), -1)
    fresh = np.zeros(table.shape, bool)
    table[row, at], fresh[row, at] = member, new
    size, codes = member.max() + 1, []
    for i in range(table.shape[1]):
        a, b = table[:, i, None], table[:, i + 1 :]
        x, y = np.nonzero((a >= 0) & (b >= 0) & (fresh[:, i, None] | fresh[:, i + 1 :]))
        a, b = a[x, 0], b[x, y]
        codes.append(np.unique(np.minimum(a, b) * size + np.maximum(a, b)))
    code = np.unique(np.concatenate(codes))
    return code // size, code % size


def nearest_of_block(lists: pa.Table, vectors: pa.Table, width: int) -> pa.Table:
    """(document_id, v, u, sim, compared): the `width` nearest that each member of
    a block's lists meets there and has not ruled out; the first row has the
    number of comparisons. A block without new neighbours has no lists and gives none."""
    if not len(lists):
        kinds = vectors.schema.field("document_id_").type, vectors.schema.field("node_id").type
        return pa.schema(dict(zip(("document_id", "v", "u", "sim", "compared"), (*kinds, kinds[1], pa.float64(), pa.int64())))).empty_table()
    bounds = vectors.filter(pc.is_null(vectors["x"]))
    vectors = vectors.filter(pc.is_valid(vectors["x"])).sort_by("node_id").combine_chunks()
    ids, x = vectors["node_id"].combine_chunks(), _matrix(vectors["x"])
    worst = np.full(len(ids), -np.inf)
    worst[pc.index_in(bounds["node_id"].combine_chunks(), value_set=ids).to_numpy()] = bounds["worst"].to_numpy()
    member = pc.index_in(lists["u"].combine_chunks(), value_set=ids).to_numpy()
    node = lists["v"].combine_chunks().dictionary_encode().indices.to_numpy()
    a, b = pairs_met(node, member.astype(np.int64), lists["new"].to_numpy().astype(bool))
    v, u, sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(a), PAIRS):
        i, j = a[at : at + PAIRS], b[at : at + PAIRS]
        s = np.einsum("ij,ij->i", x[i], x[j])
        for one, other in ((i, j), (j, i)):
            kept = s >= worst[one]
            v.append(one[kept]), u.append(other[kept]), sim.append(s[kept])
    v, u, sim = map(np.concatenate, (v, u, sim))
    order = np.lexsort((u, -sim, v))
    v, u, sim = v[order], u[order], sim[order]
    best = np.arange(len(v)) - np.searchsorted(v, v) < width
    n = max(best.sum(), 1)
    compared = np.zeros(n, np.int64)
    compared[0] = len(a)
    document = lists["document_id"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    if not best.any():
        none = ids.take(pa.array([None], pa.int64()))
        return pa.table({"document_id": document, "v": none, "u": none, "sim": pa.array([None], pa.float64()), "compared": compared})
    return pa.table({"document_id": document, "v": ids.take(pa.array(v[best])), "u": ids.take(pa.array(u[best])), "sim": sim[best], "compared": compared})


def compared_lists(rows: DataFrame, state: DataFrame, vectors: DataFrame, sizes: DataFrame, most_blocks: int, width: int) -> DataFrame:
    """`nearest_of_block` of each block of `lists`. A node with a full list rules
    out what is below its last. Vectors go to all blocks of their document where
    these are few, else to those that name them."""
    by = ["document_id", "block"]
    last = state.groupBy("document_id", F.col("v").alias("node_id")).agg(F.min("sim").alias("worst"), F.count("*").alias("n")).filter(F.col("n") >= width)
    every = vectors.withColumn("worst", F.lit(None).cast("double"))
    every = every.unionByName(last.select("document_id", "node_id", F.lit(None).cast("array<double>").alias("x"), "worst"))
    sent = every.join(sizes.filter(F.col("g") <= COPIES), "document_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).drop("g")
    if most_blocks > COPIES:
        named = rows.join(sizes.filter(F.col("g") > COPIES), "document_id", "left_semi").select(*by, F.col("u").alias("node_id")).distinct()
        sent = sent.unionByName(named.join(every, ["document_id", "node_id"]))
    sent = sent.select(*(F.col(c).alias(f"{c}_") if c in by else c for c in sent.columns))  # both sides may come from `rows`
    kind = {f.name: f.dataType.simpleString() for f in state.schema}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_of_block(left, right, width)

    schema = f"document_id {kind['document_id']}, v {kind['v']}, u {kind['u']}, sim double, compared long"
    return rows.groupBy(*by).cogroup(sent.groupBy(*(f"{c}_" for c in by))).applyInArrow(run, schema)


def descended(nodes: DataFrame, width: int = 15, most: int = 8, rounds: int = 12, few: float = 0.005, seed: int = 42) -> tuple[DataFrame, int]:
    """(document_id, v, u, sim): about the `width` nearest of each node, and the
    number of comparisons that it took."""
    vectors = nodes.select("document_id", "node_id", unit(doubles(F.col("embedding"))).alias("x"))
    vectors = written(vectors.filter("x is not null"), "vectors")  # what has no vector has no neighbours
    sizes = written(vectors.groupBy("document_id").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("g")), "sizes")
    most_blocks = sizes.agg(F.coalesce(F.max("g"), F.lit(0))).first()[0]
    made = written(first_compared(vectors, width, seed), "compared")
    compared = made.count()
    state = written(nearest_seen(both_ways(made, "sim").withColumn("new", F.lit(True)), width), "near")
    for n in range(rounds):
        made = written(compared_lists(lists(state, sizes, most, n), state, vectors, sizes, most_blocks, width), "compared")
        compared += made.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]
        made = made.filter("v is not null").select("document_id", "v", "u", "sim")
        state = written(nearest_seen(state.withColumn("new", F.lit(False)).unionByName(made.withColumn("new", F.lit(True))), width), "near")
        sums = state.agg(F.count("*").alias("n"), F.count_if("new").alias("new")).first()
        if sums.new <= few * sums.n:
            break
    return state.select("document_id", "v", "u", "sim"), compared


def approximate_knn_graph(nodes: DataFrame, k: int = 10, least: float = 0.3, **options) -> DataFrame:
    """(document_id, a, b, sim) as `knn_graph`, from neighbours found by descent."""
    near, _ = descended(nodes, **({"width": k + k // 2} | options))
    rank = F.row_number().over(Window.partitionBy(*NODE).orderBy(F.desc("sim"), "u"))
    near = near.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("sim") > least) & (F.col("v") < F.col("u")))
    return near.select("document_id", F.col("v").alias("a"), F.col("u").alias("b"), "sim")
