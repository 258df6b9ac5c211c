"""Document sources, assembly of parts, and the node table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovework.functions.text import count_tokens, flat_preview, node_id
from grovework.operators.chunking import chunk_text, contextualize, with_references
from grovework.operators.hooks import asked
from grovework.sources.snapshots import Snapshots


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as it is; text and markdown files as (document_id, text), one row
    for each file. A folder may mix them: its Parquet files then have these two
    columns at least. Other extensions are an error."""
    bare = path.rstrip("/*").lower()
    if "." not in bare.rsplit("/", 1)[-1]:
        return read_folder(spark, path.rstrip("/*"))
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    if bare.endswith((".txt", ".md")):
        rows = spark.read.text(path, wholetext=True)
        return rows.select(stem(F.input_file_name()).alias("document_id"), F.col("value").alias("text"))
    raise ValueError(f"no reader for {path}")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of the text, markdown and Parquet files of a folder."""
    kinds = {r.kind for r in spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind")).distinct().collect()}
    if other := {k for k in kinds if k.lower() not in ("txt", "md", "parquet")}:
        raise ValueError(f"no reader for {sorted(other)}")
    found = []
    for kind in sorted(kinds):
        if kind.lower() == "parquet":
            found.append(spark.read.option("pathGlobFilter", f"*.{kind}").parquet(path).select(F.col("document_id").cast("string").alias("document_id"), "text"))
            continue
        rows = spark.read.option("pathGlobFilter", f"*.{kind}").text(path, wholetext=True)
        found.append(rows.select(stem(F.input_file_name()).alias("document_id"), F.col("value").alias("text")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "document_id string, text string")


def assemble_pages(pages: DataFrame, id_col: str = "document_id", page: str = "page", text: str = "text") -> DataFrame:
    """(id_col, text): non-empty pages in order under page marks."""
    part = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text))
    rows = pages.filter(F.length(F.coalesce(text, F.lit(""))) > 0).select(id_col, F.struct(F.col(page).alias("n"), part.alias("t")).alias("p"))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n\n").alias("text"))


def assemble_parts(parts: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(id_col, text): tables first, then paragraphs and images in order; tables
    and images between line ends. parts: (id_col, kind, pos, text)."""
    own = F.when(F.col("kind") == "paragraph", F.col("text")).otherwise(F.concat(F.lit("\n"), "text", F.lit("\n")))
    rank = F.when(F.col("kind") == "table", 0).otherwise(1)
    rows = parts.filter(F.col("text").rlike(r"(?U)\S")).select(id_col, F.struct(rank.alias("r"), F.col("pos").alias("n"), own.alias("t")).alias("p"))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n\n").alias("text"))


def context_window(parts: DataFrame, id_col: str, pos: str, text: str = "text", around: int = 2) -> DataFrame:
    """`parts` with before and after: the texts of the neighbours, joined by blanks."""
    w = Window.partitionBy(id_col).orderBy(pos)
    join = lambda a, b: F.array_join(F.collect_list(text).over(w.rowsBetween(a, b)), " ")
    return parts.withColumns({"before": join(-around, -1), "after": join(1, around)})


def page_context(text: Column, chars: int = 500) -> Column:
    return F.right(text, F.lit(chars))


def base_nodes(contextual: DataFrame, summaries: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Layer-0 nodes of contextualised chunks: the contextualised text is what
    gets embedded, the original is what is stored."""
    rows = contextual.join(summaries, id_col, "left")
    rows = rows.select(
        node_id(F.col(id_col).cast("string"), F.lit(0), F.col("chunk_index"), F.lit(False)).alias("node_id"),
        F.col(id_col).alias("document_id"),
        F.lit(0).alias("layer"),
        "chunk_index",
        F.lit(False).alias("is_summary"),
        F.col("original").alias("text"),
        F.col("contextualized").alias("embed_text"),
        count_tokens(F.col("original")).alias("token_count"),
        count_tokens(F.col("contextualized")).alias("contextual_token_count"),
        F.left("summary", F.lit(200)).alias("doc_summary"),
        (F.length("context") > 0).alias("has_context"),
    )
    return with_references(rows)


def write_nodes(nodes: DataFrame, path: str, mode: str = "append") -> None:
    nodes.write.mode(mode).partitionBy("layer").parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def get_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the ids in column node_id; ids without a node give nothing."""
    return nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def view_nodes(nodes: DataFrame, document_id, limit: int | None = None, layer: int | None = None) -> DataFrame:
    rows = nodes.filter(F.col("document_id") == document_id)
    rows = rows if layer is None else rows.filter(F.col("layer") == layer)
    rows = rows.orderBy("layer", "chunk_index", "node_id").withColumn("preview", flat_preview(F.col("text")))
    return rows if limit is None else rows.limit(limit)


def delete_documents(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def save_graph(edges: DataFrame, index: DataFrame, path: str) -> int:
    """Edges and entity index as one version: both are replaced, or none."""
    return Snapshots(edges.sparkSession, path).save({"edges": edges, "entity_index": index})


def load_graph(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and entity index, of the last version or of one before."""
    stored = Snapshots(spark, path)
    version = stored.latest() if version is None else version
    return stored.read("edges", version), stored.read("entity_index", version)


def summaries_of(docs: DataFrame, id_col: str = "document_id", summarizer: Callable | None = None) -> DataFrame:
    """(id_col, summary): the first sentences, or what a mapInPandas hook over
    (id_col, text) returns as (id_col, summary), where it doesn't fail."""
    from grovework.functions.text import first_sentences, split_sentences, summary_sample

    plain = docs.select(id_col, first_sentences(split_sentences(F.col("text"))).alias("summary"))
    if summarizer is None:
        return plain
    sample = docs.select(id_col, summary_sample(F.col("text")).alias("text"))
    own = asked(sample, summarizer, [id_col], {"summary": "string"}).select(id_col, F.col("summary").alias("own"))
    return plain.join(own, id_col, "left").select(id_col, F.coalesce("own", "summary").alias("summary"))


def ingest(docs: DataFrame, id_col: str = "document_id", summarizer: Callable | None = None, **chunking) -> tuple[DataFrame, DataFrame]:
    """Layer-0 nodes of all documents, and a report for each document."""
    summaries = summaries_of(docs, id_col, summarizer)
    chunks = chunk_text(docs, id_col, **chunking)
    nodes = base_nodes(contextualize(chunks, summaries, id_col), summaries, id_col)
    counts = nodes.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.size("image_refs")).alias("n_images"), F.sum(F.size("table_refs")).alias("n_tables"))
    report = docs.select(F.col(id_col).alias("document_id"), F.length("text").alias("n_chars")).join(counts, "document_id", "left")
    return nodes, report.withColumn("few_chunks", F.col("n_chunks") < 10)
