"""Similarity and entity graphs of documents.

Pairs of nodes are weighed block by block (`pairs.py`), each once (a < b), and
only those above a threshold leave the task that meets them; they are mirrored
only where a directed list is asked for. Where entities alone are asked for,
nodes meet in blocks without their vectors. Where only the nearest of each node
are asked for, only those of each pair of blocks leave a task.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.operators.pairs import cosine_only, weighed_pairs

THRESHOLD, ENTITY_WEIGHT, NEIGHBOURS, HOPS, COMBINED_LEAST = 0.3, 1.5, 3, 2, 0.3


def shared_path(df: DataFrame, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="grovework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pairwise(nodes: DataFrame, least: float = -math.inf) -> DataFrame:
    """(document_id, a, b, sim) for the pairs a < b of a document with cosines above `least`."""
    return weighed_pairs(nodes, None, cosine_only, least)


def mirrored(pairs: DataFrame, value: str = "weight") -> DataFrame:
    one = pairs.select("document_id", F.col("a").alias("src"), F.col("b").alias("dst"), value)
    return one.unionByName(pairs.select("document_id", F.col("b").alias("src"), F.col("a").alias("dst"), value))


def importances(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, entity, importance, n): the last importance of each
    lower-cased name, and the node's number of those names."""
    rows = entities.groupBy("node_id", F.lower("name").alias("entity")).agg(F.max_by("importance", "rank").alias("importance"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("node_id")))
    return rows.join(nodes.select("node_id", "document_id"), "node_id")


def entity_overlap(entities: DataFrame, nodes: DataFrame, list_rows: int = 1024) -> DataFrame:
    """(document_id, a, b, score) for the pairs that share an entity. Pairs are
    summed where two blocks meet, so only nodes are shuffled, never pairs, and
    no task squares a whole list."""

    def weigh(cosine, shared, summed, na, nb):
        return np.where(shared > 0, summed / (10 * np.maximum(np.maximum(na, nb), 1)), -np.inf)

    return weighed_pairs(nodes, importances(entities, nodes), weigh, rows_each=list_rows, vectors=False).withColumnRenamed("sim", "score")


def edge_weight(cosine: np.ndarray, shared: np.ndarray, summed: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return cosine + ENTITY_WEIGHT * (summed / (10 * np.maximum(np.maximum(na, nb), 1)))


def build_edges(nodes: DataFrame, entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Directed edges (document_id, src, dst, weight) between base nodes: cosine
    plus the overlap of entities, each pair weighed once."""
    base = nodes.filter("layer = 0")
    return mirrored(weighed_pairs(base, importances(entities, base), edge_weight, threshold).withColumnRenamed("sim", "weight"))


def top_neighbours(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("document_id", "src").orderBy(F.desc(F.round("weight", 12)), "dst"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_edges(nodes: DataFrame, entities: DataFrame, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """`top_neighbours` of `build_edges`, from the k best of each node in each
    pair of blocks: the other edges leave no task."""
    base = nodes.filter("layer = 0")
    return top_neighbours(_directed(weighed_pairs(base, importances(entities, base), edge_weight, threshold, top=k)), k)


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.select("document_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sim").alias("weight"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, node_id) reached from the seeds (query_id, document_id,
    node_id) in at most `hops` steps over the top neighbours, seeds left out."""
    steps = top_neighbours(edges, k).select("document_id", F.col("src").alias("node_id"), "dst")
    seen = frontier = seeds.select("query_id", "document_id", "node_id").distinct()
    for hop in range(hops):
        reached = frontier.join(steps, ["document_id", "node_id"]).select("query_id", "document_id", F.col("dst").alias("node_id")).distinct()
        frontier = reached.join(seen, ["query_id", "document_id", "node_id"], "left_anti")
        if hop >= 2:
            frontier = written(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen.join(seeds, ["query_id", "node_id"], "left_anti").select("query_id", "document_id", "node_id")


def knn_graph(nodes: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """(document_id, a, b, sim): b is among the k nearest of a, and a < b; an
    edge that only the larger id chooses is left out."""
    both = _directed(weighed_pairs(nodes, None, cosine_only, least, top=k))
    near = top_neighbours(both, k).filter(F.col("src") < F.col("dst"))
    return near.select("document_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("sim"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("document_id").agg(F.floor(F.count("*") / 2).alias("n_edges"))


def combined_weight(cosine: np.ndarray, shared: np.ndarray, summed: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    either = na + nb
    either -= shared
    np.maximum(either, 1, out=either)
    np.divide(shared, either, out=either)  # in place: tiles of many pairs are weighed
    either *= 0.3
    either += 0.7 * cosine
    return either


def combined_similarity(nodes: DataFrame, entities: DataFrame, least: float = COMBINED_LEAST) -> DataFrame:
    """(document_id, a, b, sim): 0.7 cosine plus 0.3 Jaccard of entity names."""
    return weighed_pairs(nodes, importances(entities, nodes), combined_weight, least)
