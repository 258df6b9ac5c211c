"""New document files become nodes, each document replaced as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovework.operators.embedding import embed
from grovework.operators.entities import with_entities
from grovework.operators.graph import written
from grovework.sources.nodes import ingest

SCHEMA = "document_id string, text string"


def stream_ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, extractor: Callable | None = None, embedder: Callable | None = None, **chunking
) -> StreamingQuery:
    """Starts a query over Parquet files of (document_id, text) in `source`.

    Documents are chunked, get entities (`extractor`) and vectors (`embedder`;
    the default hashes words without frequencies, so that batches compare).
    Nodes of batch n go to target/nodes/batch=n, and the file time and name behind
    each document to target/versions/batch=n; both are overwritten if the batch
    runs again, so a batch counts once. Of a document that comes more than once,
    in one batch or in several, the row of the latest file counts (then the
    greatest file name and text), so files may arrive in any order. `current`
    reads the nodes that count.
    """
    file = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), F.col("text").alias("text"))
    stream = spark.readStream.schema(SCHEMA).parquet(source).select("document_id", file.alias("file"))

    def store(batch: DataFrame, number: int) -> None:
        last = written(batch.groupBy("document_id").agg(F.max("file").alias("file")), "latest")
        nodes = with_entities(written(ingest(last.select("document_id", "file.text"), **chunking)[0], "ingested"), extractor)
        embed(nodes, embedder, idf=False).write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        # last: a batch without its versions doesn't count
        last.select("document_id", "file.at", "file.path").write.mode("overwrite").parquet(f"{target}/versions/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> DataFrame:
    """(document_id, at, path, batch): the file that counts for each document."""
    rows = spark.read.parquet(f"{target}/versions")
    last = rows.groupBy("document_id").agg(F.max(F.struct("at", "path", "batch")).alias("v"))
    return last.select("document_id", "v.*")


def current(spark: SparkSession, target: str) -> DataFrame:
    """Nodes of the version that counts of each document."""
    return spark.read.parquet(f"{target}/nodes").join(versions(spark, target), ["document_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, target: str, path: str) -> None:
    """Writes what counts as the first batch of a new target, so that replaced
    nodes need not be read again."""
    current(spark, target).write.parquet(f"{path}/nodes/batch=-1")
    versions(spark, target).drop("batch").write.parquet(f"{path}/versions/batch=-1")


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(document_id, print): a sum of hashes of the base nodes, whatever their order."""
    rows = nodes.filter("layer = 0").select("document_id", F.xxhash64("node_id", "text").cast("decimal(38,0)").alias("h"))
    return rows.groupBy("document_id").agg(F.sum("h").alias("print"))


def stale_trees(nodes: DataFrame, built: DataFrame) -> DataFrame:
    """Documents whose base nodes differ from those their tree was built on.
    built: (document_id, print) as of the build."""
    both = fingerprints(nodes).join(built.withColumnRenamed("print", "old"), "document_id", "full_outer")
    return both.filter(~F.col("print").eqNullSafe(F.col("old"))).select("document_id")
