"""Trees of cluster summaries, built layer by layer for all documents at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.text import CHARS_PER_TOKEN, SEPARATOR, cluster_id, combine_texts, count_tokens, first_sentences, node_id
from grovework.functions.vectors import doubles
from grovework.operators.cluster import cluster_communities
from grovework.operators.entities import ENTITY, cluster_entities, entity_names, with_entities
from grovework.operators.graph import build_edges, edge_stats, written
from grovework.operators.hooks import asked

MAX_DEPTH, MIN_CLUSTER, MIN_NODES = 4, 2, 3


def exploded_entities(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.posexplode("entities").alias("rank", "e")).select("node_id", "rank", "e.*")


def layer_nodes(nodes: DataFrame, layer: int) -> DataFrame:
    return nodes.filter(F.col("layer") == layer).withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))


def tree_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("parent_id"), F.explode("child_ids").alias("child_id"))


def first_members(rows: DataFrame, most: int) -> DataFrame:
    """(document_id, cluster, texts): of each cluster's first `most` members, in order."""
    rank = F.row_number().over(Window.partitionBy("document_id", "cluster").orderBy("chunk_index", "node_id"))
    first = rows.withColumn("rank", rank).filter(F.col("rank") <= most)
    return first.groupBy("document_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))


def summaries(rows: DataFrame, entities: DataFrame, summarizer: Callable | None, tokens: int = 500) -> DataFrame:
    """(document_id, cluster, text, failed) of the members in `rows`: the first
    sentences of the first three, or what `summarizer`, a mapInPandas hook over
    (document_id, cluster, key_entities, text), returns as (document_id, cluster,
    text). Its text is that of the members up to `tokens`, its entities are the
    ten best; where it fails, the first sentences stand in."""
    plain = first_members(rows, 3).select("document_id", "cluster", first_sentences(F.col("texts")).alias("plain"))
    if summarizer is None:
        return plain.select("document_id", "cluster", F.col("plain").alias("text"), F.lit(False).alias("failed"))
    # a text adds its separator at least, so no more of them can count
    enough = tokens * CHARS_PER_TOKEN // len(SEPARATOR) + 2
    cut = rows.withColumn("text", F.left("text", F.lit(tokens * CHARS_PER_TOKEN + 1)))
    named = entities.filter(F.col("rank") <= 10).groupBy("document_id", "cluster")
    named = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("key_entities"))
    given = first_members(cut, enough).select("document_id", "cluster", combine_texts(F.col("texts"), tokens).alias("text")).join(named, ["document_id", "cluster"], "left")
    given = given.select("document_id", "cluster", F.coalesce("key_entities", F.lit("")).alias("key_entities"), "text")
    told = asked(given, summarizer, ["document_id", "cluster"], {"text": "string"})
    return plain.join(told, ["document_id", "cluster"], "left").select("document_id", "cluster", F.coalesce("text", "plain").alias("text"), F.coalesce("failed", F.lit(True)).alias("failed"))


def summarize(nodes: DataFrame, clusters: DataFrame, layer: int, summarizer: Callable | None = None) -> DataFrame:
    """Summary nodes at layer + 1 of the clusters with two members or more, with
    `summaries` as texts and the mean of the members' vectors; summary_failed
    tells where a summarizer failed."""
    rows = clusters.join(nodes, ["document_id", "node_id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "node_id"))), lambda x: x["node_id"])
    mean = vector_to_array(Summarizer.mean(array_to_vector(doubles(F.col("embedding")))))
    groups = rows.groupBy("document_id", "cluster").agg(ids.alias("child_ids"), mean.alias("embedding")).filter(F.size("child_ids") >= MIN_CLUSTER)
    entities = cluster_entities(exploded_entities(nodes), clusters.select("document_id", "node_id", "cluster"))
    groups = groups.join(summaries(rows, entities, summarizer), ["document_id", "cluster"])
    listed = F.array_sort(F.collect_list(F.struct("rank", "name", "type", "importance")))
    found = entities.groupBy("document_id", "cluster").agg(listed.alias("l"))
    found = found.select("document_id", "cluster", F.transform("l", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["importance"].cast("int").alias("importance"))).alias("entities"))
    rows = groups.join(found, ["document_id", "cluster"], "left").withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))
    index = (F.row_number().over(Window.partitionBy("document_id").orderBy("cluster")) - 1).cast("int")
    rows = rows.withColumn("chunk_index", index)
    return rows.select(
        node_id(F.col("document_id").cast("string"), F.lit(layer + 1), F.col("chunk_index"), F.lit(True)).alias("node_id"),
        "document_id",
        F.lit(layer + 1).alias("layer"),
        "chunk_index",
        F.lit(True).alias("is_summary"),
        "text",
        "embedding",
        count_tokens(F.col("text")).alias("token_count"),
        "entities",
        entity_names(F.col("entities")).alias("entity_names"),
        "child_ids",
        cluster_id(F.lit(layer), F.col("cluster")).alias("cluster_id"),
        F.col("failed").alias("summary_failed"),
    )


def build_layer(nodes: DataFrame, layer: int, cluster: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, summarizer: Callable | None = None) -> DataFrame:
    """Summaries of one layer's nodes; documents with fewer than three are left out."""
    own = layer_nodes(nodes, layer)
    sized = own.withColumn("n", F.count("*").over(Window.partitionBy("document_id"))).filter(F.col("n") >= MIN_NODES).drop("n")
    found = (cluster or cluster_communities)(sized, exploded_entities(sized), layer)
    return summarize(sized, found, layer, summarizer)


def build_tree(
    base: DataFrame, max_depth: int = MAX_DEPTH, cluster: Callable | None = None, summarizer: Callable | None = None, extractor: Callable | None = None
) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trees over `base` (layer 0), and the base graph's edges,
    which are made only where they are read: their number grows with the square of a document.
    Entities that the nodes lack are extracted, by rules or by `extractor`. One round for each layer, whatever the number of documents;
    a document ends when a layer brings it two summaries or fewer."""
    if "entities" not in base.columns:
        base = written(with_entities(base, extractor), "described")
    edges = build_edges(base, exploded_entities(base))
    columns = ["node_id", "document_id", "layer", "chunk_index", "is_summary", "text", "embedding", "token_count", "entities", "entity_names", "child_ids", "cluster_id", "summary_failed"]
    rows = base.withColumn("embedding", doubles(F.col("embedding")))
    if "child_ids" not in rows.columns:
        rows = rows.withColumn("child_ids", F.array().cast("array<string>"))
    if "cluster_id" not in rows.columns:
        rows = rows.withColumn("cluster_id", F.lit(None).cast("string"))
    rows = rows.withColumn("summary_failed", F.lit(False))
    tree = active = written(rows.withColumn("token_count", count_tokens(F.col("text"))).select(*columns), "layer0")
    for layer in range(max_depth):
        made = written(build_layer(active, layer, cluster, summarizer).select(*columns), f"layer{layer + 1}")
        if made.isEmpty():
            break
        tree = tree.unionByName(made)
        going = made.groupBy("document_id").count().filter("count > 2").select("document_id")
        active = made.join(going, "document_id", "left_semi")
    return tree, edges


def delete_layers(nodes: DataFrame, document_id, least: int = 1) -> DataFrame:
    return nodes.filter(~((F.col("document_id") == document_id) & (F.col("layer") >= least)))


def rebuild_tree(nodes: DataFrame, documents: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """New trees for the listed documents from their base nodes, at the default depth."""
    options.pop("max_depth", None)
    base = nodes.filter("layer = 0").join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return build_tree(base, **options)


def tree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: nodes, depth, nodes per layer, distinct entity names (of the
    ten kept with each node, by case), undirected edges."""
    rows = nodes.filter("layer >= 0")
    base = rows.groupBy("document_id").agg(F.count("*").alias("n_nodes"), (F.max("layer") + 1).alias("depth"))
    layers = rows.groupBy("document_id", "layer").agg(F.count("*").alias("n")).groupBy("document_id")
    layers = layers.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "n"))), lambda x: F.concat(x["layer"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("layers"))
    names = rows.select("document_id", F.explode(F.split("entity_names", ",")).alias("e")).filter("e <> ''")
    names = names.groupBy("document_id").agg(F.countDistinct("e").alias("n_entities"))
    found = base.join(layers, "document_id").join(names, "document_id", "left").join(edge_stats(edges), "document_id", "left")
    return found.withColumns({"n_entities": F.coalesce("n_entities", F.lit(0)), "n_edges": F.coalesce("n_edges", F.lit(0))})
