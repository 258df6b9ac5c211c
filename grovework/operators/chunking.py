"""Semantic chunking of whole corpora.

All steps of a document work on arrays in its own row (groups of sentences,
similarities, two folds, overlaps), so chunking needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.functions.text import CHARS_PER_TOKEN, content_types, contextualized, count_tokens, element_context, references, split_sentences, template_context
from grovework.functions.vectors import dot, norm
from grovework.operators.embedding import letter_counts, over_arrays


def group_sentences(sentences: Column, group_size: int = 3) -> Column:
    """Consecutive sentences joined; without any, one empty group."""
    n = F.greatest(F.ceil(F.size(sentences) / group_size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(sentences, i * group_size + 1, group_size), " "))


def adjacent_similarity(vectors: Column) -> Column:
    """Cosine of each vector and the one before it; null for the first."""
    normed = F.transform(vectors, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    both = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.when(a["n"] * b["n"] > 0, dot(a["v"], b["v"]) / (a["n"] * b["n"])).otherwise(0.0))
    # a lambda's variable, so that the norms are computed once
    return F.get(F.transform(F.array(normed), lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit(None).cast("double")), F.when(F.size(x) > 1, both(x)).otherwise(F.array().cast("array<double>"))))), F.lit(0))


def joined_from(parts: Column, starts: Column) -> Column:
    """Consecutive parts joined by blanks, from each start up to the next."""
    return F.transform(starts, lambda s, i: F.array_join(F.slice(parts, s + 1, F.coalesce(F.get(starts, i + 1), F.size(parts)) - s), " "))


def _starts(rows: Column, first: Callable[[Column], Column], opens: Callable[[Column, Column], Column], taken: Callable[[Column, Column], Column]) -> Column:
    """A left fold to the places at which chunks start. rows: structs; the state
    has `n`, the chunk's size so far, which starts as first(row). Only numbers
    are carried along, texts are joined once afterwards."""
    state = lambda out, n, i: F.struct(out.alias("out"), n.alias("n"), i.alias("i"))

    def step(a: Column, x: Column) -> Column:
        new = (a["i"] == 0) | opens(a["n"], x)
        return state(F.when(new, F.array_append(a["out"], a["i"])).otherwise(a["out"]), F.when(new, first(x)).otherwise(taken(a["n"], x)), a["i"] + 1)

    return F.aggregate(rows, state(F.array().cast("array<int>"), F.lit(0), F.lit(0)), step, lambda a: a["out"])


def boundary_starts(groups: Column, similarities: Column, threshold: float = 0.7, max_tokens: int = 500) -> Column:
    rows = F.arrays_zip(F.transform(groups, count_tokens).alias("t"), similarities.alias("s"))
    # rounded, so that a similarity equal to the threshold does not hang on summation order
    opens = lambda n, x: (F.round(x["s"], 12) < threshold) | (n + x["t"] > max_tokens)
    return _starts(rows, lambda x: x["t"], opens, lambda n, x: n + x["t"])


def fold_boundaries(groups: Column, similarities: Column, threshold: float = 0.7, max_tokens: int = 500) -> Column:
    """Chunks: a group opens a new one if it is unlike the group before, or if
    the tokens of the groups would exceed the limit."""
    return joined_from(groups, boundary_starts(groups, similarities, threshold, max_tokens))


def merge_small(chunks: Column, min_tokens: int = 100) -> Column:
    """A chunk below the limit takes in what follows; the last may stay small."""
    opens = lambda n, x: n >= min_tokens * CHARS_PER_TOKEN
    starts = _starts(F.transform(chunks, F.length), lambda x: x, opens, lambda n, x: n + 1 + x)
    return joined_from(chunks, starts)


def add_overlap(chunks: Column, overlap_tokens: int = 50) -> Column:
    """Each chunk between the end of the one before and the start of the next."""
    k = overlap_tokens * CHARS_PER_TOKEN
    if k <= 0:
        return chunks
    return F.transform(chunks, lambda c, i: F.concat_ws(" ... ", F.right(F.get(chunks, i - 1), F.lit(k)), c, F.left(F.get(chunks, i + 1), F.lit(k))))


def chunk_text(
    docs: DataFrame,
    id_col: str = "document_id",
    text: str = "text",
    embed: Callable[[Column], Column] | None = None,
    embed_groups: Callable[[Column], Column] | None = None,
    similarity_threshold: float = 0.7,
    group_size: int = 3,
    min_tokens: int = 100,
    max_tokens: int = 500,
    overlap_tokens: int = 50,
    spread: bool = False,
) -> DataFrame:
    """(id_col, chunk_index, chunk) for all documents. Groups of sentences are
    compared by the vectors that `embed` makes of a text, or `embed_groups` of
    an array of texts (a batch model: see `embedding.over_arrays`). The default
    counts letters, in Arrow batches: 26 passes over each text took five times
    as long in column expressions. `spread` deals the documents over the tasks
    first: for a table of few splits, where chunking would leave cores idle."""
    rows = (docs.select(id_col, text).repartition(id_col) if spread else docs).select(id_col, split_sentences(F.col(text)).alias("sentences"))
    rows = rows.select(id_col, group_sentences(F.col("sentences"), group_size).alias("groups"))
    rows = rows.withColumn("vectors", F.transform("groups", embed) if embed else (embed_groups or over_arrays(letter_counts))(F.col("groups")))
    rows = rows.withColumn("sims", adjacent_similarity(F.col("vectors")))
    rows = rows.select(id_col, "groups", boundary_starts(F.col("groups"), F.col("sims"), similarity_threshold, max_tokens).alias("starts"))
    rows = rows.select(id_col, joined_from(F.col("groups"), F.col("starts")).alias("raw"))
    rows = rows.select(id_col, merge_small(F.col("raw"), min_tokens).alias("merged"))
    # outer: no array is empty, and a filter on sizes would compute all steps again
    return rows.select(id_col, F.posexplode_outer(add_overlap(F.col("merged"), overlap_tokens)).alias("chunk_index", "chunk"))


def contextualize(chunks: DataFrame, summaries: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Chunks with context and contextualized text; summaries: (id_col, summary)."""
    rows = chunks.join(summaries, id_col, "left")
    context = template_context(F.col(id_col).cast("string"), F.coalesce("summary", F.lit("")))
    rows = rows.withColumn("context", context)
    return rows.select(id_col, "chunk_index", F.col("chunk").alias("original"), contextualized(F.col("context"), F.col("chunk")).alias("contextualized"), "context")


def structured_chunks(chunks: DataFrame, tables: DataFrame, images: DataFrame, summaries: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Text chunks, then tables, then images of each document, numbered through.
    tables and images: (id_col, ref_id, idx, content)."""
    from pyspark.sql import Window

    text = contextualize(chunks, summaries, id_col).withColumns({"content_type": F.lit("text"), "rank": F.lit(0), "ref_id": F.lit(None).cast("string")})
    text = text.withColumnRenamed("chunk_index", "idx")
    parts = [text]
    for rank, (kind, rows) in enumerate((("table", tables), ("image", images)), 1):
        rows = rows.join(summaries, id_col, "left").withColumn("context", element_context(F.col(id_col).cast("string"), F.coalesce("summary", F.lit("")), kind))
        parts.append(
            rows.select(id_col, "idx", F.col("content").alias("original"), contextualized(F.col("context"), F.col("content")).alias("contextualized"), "context", F.lit(kind).alias("content_type"), F.lit(rank).alias("rank"), "ref_id")
        )
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("rank", "idx")) - 1
    return every.withColumn("chunk_index", number).drop("rank", "idx")


def with_references(rows: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return rows.withColumns(
        {
            "content_types": content_types(t),
            "image_refs": references(t, "IMAGE"),
            "table_refs": references(t, "TABLE"),
            "has_images": F.size(references(t, "IMAGE")) > 0,
            "has_tables": F.size(references(t, "TABLE")) > 0,
        }
    )
