"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is bound into one
vector by multiplying its letters' vectors, each rotated by its place; a text
is the bundle (sum) of its n-grams' vectors, and a language's prototype the
bundle of its training texts. A document gets the language whose prototype has
the highest cosine with the document's vector.

Bundles add, so training sums each batch into one vector per language, Spark
adds those, and the driver sees one vector per language. Within a batch the
vectors of all documents are a matrix product of n-gram counts with the bound
n-gram vectors, in blocks of n-grams, so scripts of many letters need no more
memory than others. Prototypes and documents are both reduced by what all training
languages share (the mean prototype direction is subtracted), which sharpens
the cosine.

Edge cases: a text that is null or has no letter is `und` with score 0; so is
every text if nothing could be learned. Texts are read whole; one of over a
million characters in blocks of about that many, cut at blanks, whose bundles
are added (n-grams across a cut are not formed). Copies of a row get equal
results. Training rows with a null language or text
are left out. Ties go to the first language in code-point order. Columns that
are not named are not read, so names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import slices

UNKNOWN = "und"
BLANK = re.compile(r"\s")
#: Counts that are held at once.
DENSE = 4_000_000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point below 0x110000: itself if it is a letter, else 32."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letter, points, 32).astype(np.int32)


@lru_cache(maxsize=150_000)
def letter_vector(point: int, dims: int, seed: int) -> np.ndarray:
    """The same signs for a code point in every process; a byte for each, so
    those of all letters there are take some 70 MB."""
    return np.random.default_rng([seed, point]).integers(0, 2, dims).astype(np.int8) * np.int8(2) - np.int8(1)


def letters_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, with single blanks for what is no
    letter and around each text; and the text's number for each."""
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = letter_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != 32) | (points[:-1] != 32) | (owner[1:] != owner[:-1])
    return points[kept], owner[kept]


def ngrams_of(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts as rows of code points, and for each
    occurrence its n-gram's number and its text's number."""
    points, owner = letters_of(texts)
    if len(points) < n:
        return np.empty((0, n), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(points))
    small = np.zeros(int(alphabet[-1]) + 1, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    own, codes = small[points], np.zeros(len(points) - n + 1, np.int64)
    for k in range(n):
        codes = codes * len(alphabet) + own[k : len(own) - n + 1 + k]
    codes, owners = codes[owner[n - 1 :] == owner[: len(owner) - n + 1]], owner[: len(owner) - n + 1][owner[n - 1 :] == owner[: len(owner) - n + 1]]
    size = len(alphabet) ** n
    if size <= 4_000_000:
        there = np.flatnonzero(np.bincount(codes, minlength=size))
        number = np.zeros(size, np.int64)
        number[there] = np.arange(len(there))
        numbers = number[codes]
    else:
        there, numbers = np.unique(codes, return_inverse=True)
    grams = np.stack([alphabet[there // len(alphabet) ** (n - 1 - k) % len(alphabet)] for k in range(n)], axis=1)
    return grams, numbers, owners


def bound(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A vector for each n-gram: its letters' vectors, rotated by place, multiplied."""
    alphabet, numbers = np.unique(grams, return_inverse=True)
    numbers = numbers.reshape(grams.shape)
    vectors = np.stack([letter_vector(int(p), dims, seed) for p in alphabet]) if len(alphabet) else np.empty((0, dims), np.int8)
    out = np.ones((len(grams), dims), np.int8)
    for k in range(grams.shape[1]):
        out *= np.roll(vectors, grams.shape[1] - 1 - k, axis=1)[numbers[:, k]]
    return out.astype(np.float32)


def summed(
    grams: np.ndarray, numbers: np.ndarray, groups: np.ndarray, n_groups: int, dims: int, seed: int, weights: np.ndarray | None = None, block: int = 8192
) -> np.ndarray:
    """For each group the sum of its n-grams' vectors, by weight."""
    out = np.zeros((n_groups, dims), np.float32)
    if n_groups * len(grams) <= DENSE:
        counts = np.bincount(groups * len(grams) + numbers, weights, n_groups * len(grams)).reshape(n_groups, -1)
        for at in range(0, len(grams), block):
            out += counts[:, at : at + block].astype(np.float32) @ bound(grams[at : at + block], dims, seed)
        return out
    order = np.argsort(numbers, kind="stable")
    numbers, groups, weights = numbers[order], groups[order], None if weights is None else weights[order]
    block = min(block, max(1, DENSE // n_groups))
    for at in range(0, len(grams), block):
        own, (low, high) = grams[at : at + block], np.searchsorted(numbers, (at, at + block))
        codes = groups[low:high] * len(own) + numbers[low:high] - at
        counts = np.bincount(codes, None if weights is None else weights[low:high], n_groups * len(own))
        out += counts.reshape(n_groups, -1).astype(np.float32) @ bound(own, dims, seed)
    return out


def parts_of(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters, cut at blanks."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + most)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def bundles(texts: Sequence[str | None], dims: int, n: int, seed: int, most: int = 1_000_000) -> np.ndarray:
    """A vector for each text; zero where there is no letter."""
    grams, numbers, owners = ngrams_of([t if t and len(t) <= most else None for t in texts], n)
    out = summed(grams, numbers, owners, len(texts), dims, seed) if len(grams) else np.zeros((len(texts), dims), np.float32)
    for k, text in enumerate(texts):
        if text and len(text) > most:
            for part in parts_of(text, most):
                out[k] += summed(*ngrams_of([part], n), 1, dims, seed)[0]
    return out


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # unit rows, the shared direction taken out
    shared: np.ndarray  # unit row
    dims: int
    n: int
    seed: int

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        vectors = bundles(texts, self.dims, self.n, self.seed).astype(np.float64)
        known = np.abs(vectors).sum(axis=1) > 0
        vectors -= (vectors @ self.shared)[:, None] * self.shared
        norms = np.linalg.norm(vectors, axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = vectors @ self.prototypes.T / np.where(norms > 0, norms, 1)[:, None]
        best = cosines.argmax(axis=1)
        score = np.where(known, (1 + cosines[np.arange(len(texts)), best]) / 2, 0.0).clip(0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = 512, n: int = 3, seed: int = 7) -> Profiles:
    """Prototypes from all rows with a text and a language. Each row counts by
    the square root of its length, so long texts don't drown the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, 512, 0):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            if part.num_rows == 1:  # of any length
                vector = bundles(texts, dims, n, seed)[0].astype(np.float64)
                sums[langs[0]] = sums.get(langs[0], 0) + vector / np.sqrt(max(1, len(texts[0])))
                continue
            names = sorted(set(langs))
            grams, numbers, owners = ngrams_of(texts, n)
            if not len(grams):
                continue
            weight = 1 / np.sqrt(np.maximum(np.fromiter(map(len, texts), float), 1))
            of = np.searchsorted(names, langs)
            for name, vector in zip(names, summed(grams, numbers, of[owners], len(names), dims, seed, weight[owners])):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x for x in names for _ in range(dims)], pa.string()),
                pa.array(np.tile(np.arange(dims, dtype=np.int32), len(names))),
                pa.array(np.concatenate([sums[x] for x in names]) if names else np.empty(0)),
            ],
            names=["lang", "d", "v"],
        )

    rows = docs.select(docs[text].alias("__text"), docs[lang].cast("string").alias("__lang")).dropna()
    added = rows.mapInArrow(run, "lang string, d int, v double").groupBy("lang", "d").agg(F.round(F.sum("v"), 3).alias("v"))
    found = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x.v).alias("v")).orderBy("lang").collect()
    sums = np.array([r.v for r in found]).reshape(len(found), dims)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    shared = unit(unit(sums).mean(axis=0)) if len(found) > 1 else np.zeros(dims)
    return Profiles([r.lang for r in found], unit(sums - (sums @ shared)[:, None] * shared), shared, dims, n, seed)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` with lang_pred and score (half of one plus the cosine). No shuffle."""
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, len(keep)):
            found, score = profiles.predict(part.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
