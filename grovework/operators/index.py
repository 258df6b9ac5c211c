"""An inverted-file index over node vectors: approximate nearest nodes.

Vectors are dealt into cells by their nearest centre (k-means over a bounded
sample), and the cells are the partition column of two tables: codes, one byte
for each entry of what a vector differs from its centre by, packed in rows of
some hundreds of nodes; and the vectors themselves. A search reads the codes of
the cells nearest to its questions only (Spark prunes the others), ranks by
them, and computes exact distances for the best `refine` nodes of each question.

How many cells a question looks into follows from the data: building measures
exact neighbours of a sample of nodes and takes the least number that finds
`target` of them. More nodes are appended without a rebuild; the centres stay. A
question that finds fewer nodes than it asked for is answered exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovework.functions.vectors import doubles, squared_l2
from grovework.operators.pairs import groups
from grovework.operators.retrieval import candidates, ranked

PACK_ROWS, QUESTION_ROWS = 512, 256


@dataclass(frozen=True)
class Index:
    """Where an index lies, and what a search needs of it: `centres` has at most
    `cells` rows, the bound given to `build`."""

    path: str
    centres: np.ndarray
    step: float
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all centres."""
        return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1))


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def of_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("embedding is not null").select("node_id", doubles(F.col("embedding")).alias("v"))


def sampled(rows: DataFrame, n: int, salt: int) -> np.ndarray:
    """Vectors of the `n` rows with the smallest hash of their ids."""
    found = rows.orderBy(F.xxhash64("node_id", F.lit(salt))).limit(n).select("v").toArrow().column("v").to_pylist()
    return np.array(found, float)


def centres_of(sample: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means over the sample; empty cells keep their centre."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = ((sample**2).sum(axis=1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=cells)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def append(nodes: DataFrame, index: Index) -> None:
    """Adds nodes (node_id, embedding) to the index. Crowded cells are written by several tasks."""
    size, kind = index.centres.shape[1], nodes.schema["node_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.nearest(rows_of(batch.column(1), size)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "node_id", "v"])

    placed = of_nodes(nodes).mapInArrow(place, f"cell int, node_id {kind}, v array<double>")
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "node_id").write.mode("append").partitionBy("cell").parquet(f"{index.path}/vectors")
    pack(nodes.sparkSession, index, kind)


def pack(spark: SparkSession, index: Index, kind: str) -> None:
    """Codes of the vectors that have none yet: one row for some hundreds of nodes."""
    size = index.centres.shape[1]
    vectors = vectors_of(spark, index.path)
    done = spark.read.parquet(f"{index.path}/codes").select(F.explode("ids").alias("node_id")) if exists(spark, f"{index.path}/codes") else None
    new = vectors if done is None else vectors.join(done, "node_id", "left_anti")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            cell = table["cell"][0].as_py()
            for at in range(0, table.num_rows, PACK_ROWS):
                cut = table.slice(at, PACK_ROWS).combine_chunks()
                x = rows_of(cut["v"].combine_chunks(), size) - index.centres[cell]
                code = np.clip(np.rint(x / index.step), -127, 127).astype(np.int8)
                ids = pa.ListArray.from_arrays(pa.array([0, cut.num_rows], pa.int32()), cut["node_id"].combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), ids, pa.array([code.tobytes()], pa.binary())], names=["cell", "ids", "codes"])

    rows = new.select("cell", "node_id", "v").hint("rebalance", "cell").sortWithinPartitions("cell", "node_id")
    rows.mapInArrow(packed, f"cell int, ids array<{kind}>, codes binary").write.mode("append").partitionBy("cell").parquet(f"{index.path}/codes")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def vectors_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def probes_needed(rows: DataFrame, index: Index, asked: int, k: int, target: float) -> int:
    """The least number of cells in which `target` of the true `k` nearest nodes
    of `asked` sampled ones lie."""
    questions = sampled(rows, asked, 1)
    size = index.centres.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), size)
            far = (questions**2).sum(axis=1)[:, None] - 2 * questions @ x.T + (x * x).sum(axis=1)
            cell = index.nearest(x).argmin(axis=1)
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(questions)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(cell[best].ravel(), pa.int32()), pa.array(far[q, best.ravel()])], names=["q", "cell", "far"])

    found = ranked(rows.mapInArrow(near, "q int, cell int, far double"), k, "far", "cell", by=("q",)).collect()  # asked * k rows
    order = np.argsort(np.argsort(index.nearest(questions), axis=1, kind="stable"), axis=1)
    places = np.sort([order[r.q, r.cell] for r in found])
    return int(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)]) + 1


def build(
    nodes: DataFrame, path: str, cells: int | None = None, most_cells: int = 1024, fit_rows: int = 20_000, asked: int = 100, k: int = 10, target: float = 0.95, seed: int = 42
) -> Index:
    """An index at `path` over all `nodes`: as many cells as the root of their
    number, at most `most_cells`. Centres are fitted on at most `fit_rows`
    vectors, the number of probes on `asked` ones against all nodes."""
    rows = of_nodes(nodes)
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    sample = sampled(rows, fit_rows, 0)
    centres = centres_of(sample, min(cells or most_cells, most_cells, len(sample), max(1, math.isqrt(n))), seed)
    index = Index(path, centres, 1.0, 1)
    apart = np.abs(sample - centres[index.nearest(sample).argmin(axis=1)]).max(initial=0.0)
    index = Index(path, centres, max(apart, 1e-12) / 127, 1)
    index = Index(path, centres, index.step, probes_needed(rows, index, asked, k, target))
    spark = nodes.sparkSession
    meta = spark.createDataFrame([(int(c), index.centres[c].tolist(), float(index.step), index.probes) for c in range(len(centres))], "cell int, centre array<double>, step double, probes int")
    meta.coalesce(1).write.parquet(f"{path}/centres")
    append(nodes, index)
    return index


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(path, np.array([r.centre for r in rows]), rows[0].step, rows[0].probes)


def probed(questions: DataFrame, index: Index, probes: int) -> DataFrame:
    """(query_id, cell, v): each question with the cells it looks into."""
    size, kind = index.centres.shape[1], questions.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.argsort(index.nearest(rows_of(batch.column(1), size)), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cells.ravel(), pa.int32()), batch.column(1).take(at)], names=["query_id", "cell", "v"])

    return questions.select("query_id", doubles(F.col("embedding")).alias("v")).mapInArrow(run, f"query_id {kind}, cell int, v array<double>")


def coded(met: DataFrame, index: Index, most: int, q_kind: str, n_kind: str) -> DataFrame:
    """(query_id, node_id, cell, near) of packs of questions and of codes: the best `most` of each."""
    size = index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell, queries, ids = batch.column(0)[row].as_py(), batch.column(1)[row].values, batch.column(3)[row].values
                x = index.centres[cell] + np.frombuffer(batch.column(4)[row].as_buffer(), np.int8).reshape(-1, size) * index.step
                q = batch.column(2)[row].values.to_numpy(zero_copy_only=False).reshape(-1, size)
                far = (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)
                best = np.argsort(far, axis=1, kind="stable")[:, :most]
                at = np.repeat(np.arange(len(q)), best.shape[1])
                n = len(at)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(at)), ids.take(pa.array(best.ravel())), pa.array(np.full(n, cell, np.int32)), pa.array(far[at, best.ravel()])], names=["query_id", "node_id", "cell", "near"])

    return met.select("cell", "queries", "vs", "ids", "codes").mapInArrow(run, f"query_id {q_kind}, node_id {n_kind}, cell int, near double")


def search(questions: DataFrame, index: Index, k: int = 10, probes: int | None = None, refine: int = 10) -> DataFrame:
    """(query_id, node_id, distance, rank): the `k` nearest of all nodes, of
    those that the probed cells' codes rank among the best refine * k. Distances
    are exact (squared)."""
    spark = questions.sparkSession
    asked = questions.filter("embedding is not null").select("query_id", "embedding")
    q_kind = asked.schema["query_id"].dataType.simpleString()
    looked = probed(asked, index, probes or index.probes)
    cells = [r.cell for r in looked.select("cell").distinct().collect()]  # at most the cells of the index
    codes = spark.read.parquet(f"{index.path}/codes").filter(F.col("cell").isin(cells))
    n_kind = codes.schema["ids"].dataType.elementType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            for at in range(0, table.num_rows, QUESTION_ROWS):
                cut = table.slice(at, QUESTION_ROWS).combine_chunks()
                one = pa.array([0, cut.num_rows], pa.int32())
                flat = cut["v"].combine_chunks().flatten()
                vs = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([cut["cell"].combine_chunks()[:1], pa.ListArray.from_arrays(one, cut["query_id"].combine_chunks()), vs], names=["cell", "queries", "vs"])

    packs = looked.select("cell", "query_id", "v").repartitionByRange("cell", F.xxhash64("query_id")).sortWithinPartitions("cell", "query_id")
    packs = packs.mapInArrow(packed, f"cell int, queries array<{q_kind}>, vs array<double>")
    found = ranked(coded(packs.join(codes, "cell"), index, refine * k, q_kind, n_kind), refine * k, "near", "node_id").drop("rank", "near")
    vectors = vectors_of(spark, index.path).filter(F.col("cell").isin(cells))
    rows = found.join(vectors, ["cell", "node_id"]).join(asked.select("query_id", doubles(F.col("embedding")).alias("qv")), "query_id")
    best = ranked(rows.select("query_id", "node_id", squared_l2(F.col("v"), F.col("qv")).alias("distance")), k, "distance", "node_id")
    return with_exact(asked, vectors_of(spark, index.path), best, k)


def with_exact(asked: DataFrame, vectors: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """`best`, and exact results for the questions that found fewer than `k` nodes."""
    from grovework.operators.graph import written

    best = written(best, "near")
    full = best.groupBy("query_id").count().filter(F.col("count") >= k)
    short = written(asked.join(full, "query_id", "left_anti").withColumn("document_id", F.lit(None).cast("string")), "short")
    if short.isEmpty():
        return best
    nodes = vectors.select("node_id", F.col("v").alias("embedding"), F.lit(None).cast("string").alias("document_id"))
    exact = ranked(candidates(short, nodes).select("query_id", "node_id", "distance"), k, "distance", "node_id")
    return best.join(short, "query_id", "left_anti").unionByName(exact)
