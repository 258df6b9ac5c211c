"""Vectors of texts: a batch model where there is one, hashed words otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.operators.hooks import asked

SIZE = 512


def hashed(rows: DataFrame, text: str, column: str = "embedding", size: int = SIZE, idf: bool = True) -> DataFrame:
    """`rows` with `column`: counts of hashed words, by inverse document
    frequency, of length one (a text without words: zeros). The frequencies are
    those of `rows`; without `idf`, vectors of different tables compare."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=size).transform(rows.withColumn("__words", words))
    if idf:
        rows = IDF(inputCol="__counts", outputCol="__weighed").fit(rows).transform(rows)
    rows = Normalizer(inputCol="__weighed" if idf else "__counts", outputCol="__unit").transform(rows)
    return rows.withColumn(column, vector_to_array("__unit")).drop("__words", "__counts", "__weighed", "__unit")


def embed(rows: DataFrame, embedder: Callable | None = None, id_col: str = "node_id", text: str = "embed_text", column: str = "embedding", mark: str | None = None, **options) -> DataFrame:
    """`rows` with `column`. `embedder` is a mapInPandas hook over (id_col, text)
    that returns (id_col, embedding); without it words are hashed. Rows where it
    fails have a null vector, as none of another kind would compare; `mark`
    names a column that tells them."""
    if embedder is None:
        return hashed(rows, text, column, **options)
    made = asked(rows.select(id_col, F.col(text).alias("text")), embedder, [id_col], {"embedding": "array<double>"}).withColumnRenamed("embedding", column)
    made = made.withColumnRenamed("failed", mark) if mark else made.drop("failed")
    return rows.drop(column).join(made, id_col, "left")


def letter_counts(texts: Sequence[str]) -> np.ndarray:
    """Counts of a..z in the lower-cased texts, as `vectors.letter_histogram`. One
    text at a time: numbers for each letter of a whole batch took ten times its size."""
    counts = np.zeros((len(texts), 26))
    for n, text in enumerate(texts):
        if text:
            counts[n] = np.bincount(np.frombuffer(text.lower().encode(), np.uint8), minlength=256)[ord("a") : ord("z") + 1]
    return counts


def over_arrays(model: Callable[[Sequence[str]], np.ndarray], texts_each: int = 4096) -> Callable[[Column], Column]:
    """A batch model (texts to the rows of a matrix) as a function of a column of
    arrays of texts, as `chunk_text` takes it. Arrow batches are worked off
    `texts_each` at a time and never become frames, whose objects took many times
    the memory."""

    @F.arrow_udf("array<array<double>>")
    def run(arrays: pa.Array) -> pa.Array:
        texts = arrays.flatten()
        vectors = [np.asarray(model(texts.slice(at, texts_each).to_pylist()), float) for at in range(0, len(texts), texts_each)]
        flat = np.concatenate(vectors) if vectors else np.zeros((0, 0))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), rows)

    return run
