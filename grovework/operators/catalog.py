"""Statistics and listings of nodes, documents, groups and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_stats(nodes: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"n_{c[4:]}")
    return nodes.agg(
        F.count("*").alias("n_nodes"),
        F.array_join(F.array_sort(F.collect_set("document_id")), ",").alias("documents"),
        F.array_join(F.transform(F.array_sort(F.collect_set("layer")), lambda x: x.cast("string")), ",").alias("layers"),
        count("has_images"),
        count("has_tables"),
        F.count("*").alias("n_text"),
    )


def list_documents(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("document_id").agg(F.count("*").alias("n_nodes")).orderBy("document_id")


def page_documents(catalog: DataFrame, group: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = catalog if group is None else catalog.filter(F.col("group_id") == group)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.orderBy("document_id").offset(offset).limit(limit)


def search(rows: DataFrame, column: str, wanted: str, most: int, order: str) -> DataFrame:
    """Case-insensitive substring search; an empty query matches all."""
    return rows.filter(F.contains(F.lower(column), F.lit(wanted.lower()))).orderBy(order).limit(most)


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.sum("chunk_count").alias("chunks"),
        F.sum("file_size").alias("bytes"),
    )


def nodes_by_layer(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("layer").agg(F.count("*").alias("n_nodes"), F.countDistinct("document_id").alias("n_documents"))


def layer_map(nodes: DataFrame) -> DataFrame:
    """(document_id, layers): a map from layer to number of nodes."""
    counts = nodes.groupBy("document_id", "layer").agg(F.count("*").alias("n"))
    return counts.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layers"))


def group_totals(groups: DataFrame, connections: DataFrame) -> DataFrame:
    of_groups = groups.agg(F.count("*").alias("n_groups"), F.sum(F.size("document_ids")).cast("long").alias("n_documents"))
    return of_groups.join(connections.agg(F.count("*").alias("n_connections")), F.lit(True))


def conversation(messages: DataFrame, conv_id: int) -> DataFrame:
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")


def histories(messages: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(rows.alias("messages"))


def remove_groups(groups: DataFrame, connections: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups without those in `gone` (id), and connections that touch none of them."""
    ids = gone.select(F.col("id").alias("gone_id")).distinct()
    kept = groups.join(ids, F.col("id") == F.col("gone_id"), "left_anti")
    kept_links = connections.join(ids, F.col("source_id") == F.col("gone_id"), "left_anti").join(ids, F.col("target_id") == F.col("gone_id"), "left_anti")
    return kept, kept_links


def patch(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the non-null values of `changes`; unknown keys are added."""
    names = [c for c in rows.columns if c != key]
    other = changes.select(F.col(key), *(F.col(c).alias(f"new_{c}") for c in names if c in changes.columns))
    both = rows.join(other, key, "full_outer")
    return both.select(key, *(F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in both.columns else F.col(c) for c in names))


def add_members(members: DataFrame, more: DataFrame) -> DataFrame:
    return members.unionByName(more).distinct()


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["id", "document_id"], "left_anti")
