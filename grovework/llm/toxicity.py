"""Toxicity scores from a classifier with counterfactual regularisation.

A logistic model over the distinct words of a text and their beginnings.
Besides the usual loss it is charged for every change of its logit between a
labelled text and a counterfactual one: the same text with its identity terms
swapped for others of their group, and the same text with a term put in that it
doesn't hold. So the mention of a group says nothing by itself, even where
labelled texts mention it mostly in toxic company. The terms put in follow from
a hash of the text, so each term of each language meets its share of all
labelled texts, whether the corpus holds it or not. `Model.pairs` is the number
of counterfactual texts behind a model.

The model is fitted on at most about `max_rows` labelled ids (a documented
bound; they are picked by a hash, positive and negative alike, and of the rows
of an id the one with the smallest text counts) and on at
most `max_features` features, those that tell the classes apart best. Counting
features runs on Spark, the fit over the bounded matrix on the driver, and
scoring on Spark over all texts without a shuffle. All words of a text count,
whatever its length.

Edge cases: null, empty and wordless texts get the model's score for no
features. Rows without a label or id are not learned from; labels of repeated
ids are averaged. With no labels, or one class only, the score is the smoothed
share of toxic labels. Copies of a text get equal scores. Columns that are not
named are not read, so names cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import slices, written

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)

#: Groups of terms that may stand for each other in a counterfactual text: English, French, German, Spanish.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "locals"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("handicapés", "sourds", "aveugles"),
    ("vieux", "jeunes"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("behinderte", "gehörlose", "blinde"),
    ("alte", "junge"),
    ("mujeres", "hombres"),
    ("chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("discapacitados", "sordos", "ciegos"),
    ("viejos", "jóvenes"),
)


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def counterfactuals(words: Sequence[str], groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[list[str]]:
    """The text with each identity term moved on by one place in its group, by
    two, and so on; none if there is no such term."""
    place = {term: (group, i) for group in groups for i, term in enumerate(group)}
    longest = max((len(place[w][0]) for w in words if w in place), default=1)
    moved = lambda w, by: place[w][0][(place[w][1] + by) % len(place[w][0])] if w in place else w
    return [[moved(w, by) for w in words] for by in range(1, longest)]


def mentions(words: Sequence[str], groups: Sequence[Sequence[str]], each: int) -> list[str]:
    """`each` terms to put into the text, that it doesn't hold, by a hash of the text."""
    terms = sorted({t for g in groups for t in g} - set(words))
    start = xxhash.xxh64_intdigest(" ".join(words))
    return [terms[(start + k * (len(terms) // each + 1)) % len(terms)] for k in range(min(each, len(terms)))]


def vector(words: Sequence[str], index: dict[str, int]) -> Counter:
    """How many distinct words of the text have each known feature."""
    return Counter(index[f] for w in set(words) for f in features_of(w) if f in index)


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    pairs: int = 0
    known: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str | None) -> float:
        known, weights, parts = self.known, self.weights, []
        if len(known) > 100_000:  # a cache; starting anew changes no score
            known.clear()
        for word in set(words_of(text)):
            part = known.get(word)
            if part is None:
                part = known[word] = math.fsum(weights.get(f, 0.0) for f in features_of(word))
            if part:
                parts.append(part)
        return self.bias + math.fsum(parts)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(text)))))


class Rows(NamedTuple):
    """Sparse rows: how many entries each has, their columns and values."""

    lengths: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Rows:
        """From list columns k and v."""
        k, v = (table[c].combine_chunks() for c in ("k", "v"))
        return Rows(np.diff(k.offsets.to_numpy()), k.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(float))


def _matrix(rows: Rows, width: int):
    """Products with the rows and their transpose, sums of squares by column, sums by row."""
    n = len(rows.lengths)
    owner = np.repeat(np.arange(n), rows.lengths)
    times = lambda w: np.bincount(owner, rows.values * w[rows.columns], n)
    back = lambda g: np.bincount(rows.columns, rows.values * g[owner], width)
    return times, back, np.bincount(rows.columns, rows.values**2, width), np.bincount(owner, rows.values, n)


def fit(rows: Rows, labels: np.ndarray, changes: Rows, width: int, l1: float, l2: float, charge: float, terms: int = 1, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps. changes: what
    a counterfactual has more of each feature than its text. The mean squared
    change of the logit for a term is charged, for each of `terms`."""
    n = len(labels)
    times, back, squares, sums = _matrix(rows, width)
    d_times, d_back, d_squares, _ = _matrix(changes, width)
    per_pair = charge * terms / max(1, len(changes.lengths))
    # a step for each weight of its own: the features are sparse
    reach = max(1.0, sums.max(initial=1.0))
    step = 1 / (0.25 * np.sqrt(squares * n) / n * math.sqrt(reach) + 2 * per_pair * d_squares * math.sqrt(reach) + l2 + 1e-3)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, weights = math.log(share / (1 - share)), np.zeros(width)
    ahead, before, pace = weights.copy(), weights.copy(), 1.0
    loss_before = math.inf
    for _ in range(steps):
        z = bias + times(ahead)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        change = d_times(ahead)
        slope = back(p - labels) / n + 2 * per_pair * d_back(change) + l2 * ahead
        loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p))) + per_pair * (change**2).sum() + l1 * np.abs(ahead).sum() + l2 / 2 * (ahead**2).sum()
        if loss > loss_before * 1.0001:
            step, pace, ahead = step * 0.5, 1.0, before.copy()
            loss_before = math.inf
            continue
        loss_before = loss
        weights = ahead - step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = weights + (pace - 1) / following * (weights - before)
        bias -= 2 * (p - labels).mean()
        before, pace = weights, following
    return float(bias), weights


def learn(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 20_000,
    max_features: int = 20_000,
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
    mentions_each: int = 2,
    l1: float = 5e-5,
    l2: float = 1e-4,
    charge: float = 1.0,
) -> Model:
    """Fits on rows whose id satisfies `may_learn` and has a label; each labelled
    text meets `mentions_each` terms of `groups` that it doesn't hold."""
    usable = labels.select(labels[id_col].alias(id_col), labels[label].alias("y")).dropna().filter(may_learn)
    usable = usable.groupBy(id_col).agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    there = usable.count()
    millionths = 1_000_000 if there <= max_rows else int(max_rows / there * 1_000_000)
    picked = usable.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < millionths)
    # at most about max_rows rows of twelve bytes, so broadcasting them is safe
    rows = docs.select(docs[id_col].alias(id_col), docs[text].alias("t")).join(F.broadcast(picked), id_col)
    rows = written(rows.groupBy(id_col, "y").agg(F.min("t").alias("t")).select("t", "y"), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(words_of(t)) for f in features_of(w)}:
                    found.setdefault(f, [0, 0])[y] += 1
        items = list(found.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in part], pa.string()), pa.array([c[0] for _, c in part], pa.int64()), pa.array([c[1] for _, c in part], pa.int64())],
                names=["f", "clean", "toxic"],
            )

    sums = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sums.get(0, 0), sums.get(1, 0)
    share = (toxic + 0.5) / (clean + toxic + 1)
    if not clean or not toxic:
        return Model(math.log(share / (1 - share)), {})
    counts = rows.mapInArrow(counted, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("x"))
    both = F.col("c") + F.col("x")
    spread = F.sqrt(both * share * (1 - share) * (1 - both / (clean + toxic + 1)))
    counts = written(counts.filter(both >= 3).select("f", both.alias("n"), ((F.col("x") - both * share) / spread).alias("apart")), "counts")
    best = counts.filter("abs(apart) >= 3").orderBy(F.abs("apart").desc(), "f").limit(max_features)
    names = sorted({r.f for r in best.select("f").collect()} | {f for g in groups for w in g for f in features_of(w)})
    index = {f: i for i, f in enumerate(names)}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                own = vector(words, index)
                out.append((y, False, own))
                for version in counterfactuals(words, groups):
                    change = vector(version, index)
                    change.subtract(own)
                    out.append((y, True, {k: v for k, v in change.items() if v}))
                out += [(y, True, vector([term], index)) for term in mentions(words, groups, mentions_each)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.int32()),
                    pa.array([r[1] for r in out], pa.bool_()),
                    pa.array([list(r[2]) for r in out], pa.list_(pa.int32())),
                    pa.array([list(r[2].values()) for r in out], pa.list_(pa.int32())),
                ],
                names=["y", "change", "k", "v"],
            )

    # a row for each labelled text, with its features, and few features for each change
    found = rows.mapInArrow(described, "y int, change boolean, k array<int>, v array<int>").toArrow()
    texts, changes = found.filter(pc.invert(found["change"])), Rows.of(found.filter(found["change"]))
    bias, weights = fit(Rows.of(texts), texts["y"].to_numpy().astype(float), changes, len(names), l1, l2, charge, len({t for g in groups for t in g}))
    return Model(bias, {f: float(w) for f, w in zip(names, weights) if w}, len(changes.lengths))


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), column: str = "score") -> DataFrame:
    """`keep` with `column`, the probability of a toxic label. No shuffle."""
    schema = docs.select(*keep).withColumn(column, F.lit(0.0)).schema
    rows = docs.select(*keep) if text in keep else docs.select(*keep, docs[text].alias("__text"))
    at = list(keep).index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.bias, model.weights, model.pairs)
        for part in slices(batches, 1024, at):
            scores = pa.array([own.score(t) for t in part.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], scores], names=schema.names)

    return rows.mapInArrow(run, schema)


def only_clean(docs: DataFrame, model: Model, text: str = "text", below: float = 0.5) -> DataFrame:
    """The documents whose score is below the limit, with their own columns."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return score(docs, model, text, docs.columns, name).filter(F.col(name) < below).drop(name)
