"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inside of a character class: the blanks that part words.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where it is unset and there is one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="grovework-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Cuts lineage so that what follows survives lost executors without a new
    run of what precedes. The files stay until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, text: int | None = None, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task makes of each stays small: of so
    many rows, and of so many bytes in column `text` (a longer text comes alone)."""
    for batch in batches:
        if text is None:
            cuts = list(range(0, batch.num_rows, rows))
        else:
            cuts, held = [], most_bytes + 1  # the first row opens a slice
            for at, size in enumerate(pc.binary_length(batch.column(text)).fill_null(0).to_pylist()):
                held += size
                if held > most_bytes or at - cuts[-1] >= rows:
                    cuts.append(at)
                    held = size
        for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(at, end - at)


def free_prefix(columns: Iterable[str], prefix: str) -> str:
    """`prefix`, with underscores in front for as long as a column starts with it."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    return prefix


def source_order(name: str = "source") -> list[Column]:
    """Code-point order with null last."""
    return [F.col(name).isNull(), F.col(name)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
