"""Model hooks that may fail: every row gets an answer or a mark.

A hook is a mapInPandas function, that is, it maps an iterator of frames to
frames. It is called once for each Arrow batch. If it raises, the rows of that
batch are tried one by one, so a bad row costs no other its answer. A row for
which the hook raises or returns nothing keeps its keys, has nulls for answers,
and is marked as failed; what stands in for it is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def attempted(hook: Hook, frame: pd.DataFrame, keys: list[str], answers: list[str]) -> pd.DataFrame:
    """A row for each key of `frame`: keys, answers, failed."""
    try:
        parts = [p[[*keys, *answers]] for p in hook(iter([frame]))]
    except Exception:  # whatever a model may raise
        if len(frame) > 1:
            return pd.concat([attempted(hook, frame.iloc[[n]], keys, answers) for n in range(len(frame))], ignore_index=True)
        parts = []
    asked = frame[keys].reset_index(drop=True)
    if not parts:
        return asked.assign(**dict.fromkeys(answers), failed=True)
    told = pd.concat(parts, ignore_index=True).drop_duplicates(keys)
    both = asked.merge(told, on=keys, how="left", indicator="told")
    failed = both["told"] == "left_only"
    none = {a: both[a].astype(object).where(~failed, None) for a in answers}  # not NaN, which is no list
    return both.assign(**none, failed=failed)[[*keys, *answers, "failed"]]


def asked(rows: DataFrame, hook: Hook, keys: list[str], answers: dict[str, str]) -> DataFrame:
    """(keys, answers, failed) for all `rows`; answers: names and types."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield attempted(hook, frame, keys, list(answers))

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"`{a}` {kind}" for a, kind in answers.items()), "failed boolean"])
    return rows.mapInPandas(run, schema)


def failures(told: DataFrame) -> DataFrame:
    """(n, n_failed) of the rows that a hook was asked for."""
    return told.agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"))
