"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its five-word shingles (lower-cased, the
whole text if it has fewer words) with their counts. For each term and each of
`samples` positions, gamma variates r and c and a uniform variate b follow from
a hash of the term, so all documents draw the same ones. With weight w:

    t = floor(ln w / r + b)      a = c * exp(-r * (t - b + 1))

and the position keeps the term and t of the smallest a. Two documents agree at
a position with a probability equal to their generalised Jaccard similarity,
the sum of the smaller weights over the sum of the larger ones.

For w = 1 the formula gives t = 0 and an a that is exponentially distributed.
So the uniform behind a is drawn first, straight from the hash, and r, c and b
are drawn from their distribution given a: c = a + e1, with E = ln(c / a),
r = E + e2 and b = 1 - E / r, where e1 and e2 are exponential. That is the same
joint distribution, and terms of weight one, nearly all, only need the hash.

Edge cases: null, empty and blank texts have no term and the fingerprint of
zeros, and are alike only among themselves. Texts of any length are sampled
whole, term block by term block. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Odd multipliers and a base without structure; any would do, but they must stay.
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NEXT_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * MIX[0]
    x = (x ^ x >> U(27)) * MIX[1]
    return x ^ x >> U(31)


@lru_cache(maxsize=6)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(BASE, -1, 2**64)
    grow = lambda b: np.cumprod(np.concatenate(([U(1)], np.full(n - 1, b, U))))
    return grow(U(BASE)), grow(U(inverse))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of `data`, and the byte after it: from differences
    of a running polynomial, so no word is cut out."""
    raw = np.frombuffer(data, np.uint8)
    blank = BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U), np.empty(0, np.int64)
    up, down = powers(1 << max(16, int(len(raw)).bit_length()))
    running = np.concatenate(([U(0)], np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], dtype=U)))
    return mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(U) * MIX[0]), ends


def shingle_hashes(data: bytes, words: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of lower-cased `data`, and the byte after it; a
    shingle's hash combines those of its words. Long texts are hashed in blocks
    that end at a blank, so the memory besides the results stays bounded."""
    data, at, found, ends = data.lower(), 0, [], []
    while at < len(data):
        cut = NEXT_BLANK.search(data, at + block)
        after = cut.start() if cut else len(data)
        part = word_hashes(data[at:after])
        found.append(part[0])
        ends.append(part[1] + at)
        at = after
    if not sum(map(len, found)):
        return np.empty(0, U), np.empty(0, np.int64)
    word, end = np.concatenate(found), np.concatenate(ends)
    width = min(words, len(word))
    out = np.zeros(len(word) - width + 1, U)
    for k in range(width):
        out = out * U(BASE) + word[k : k + len(out)]
    return mixed(out + U(width)), end[width - 1 :]


@lru_cache(maxsize=4)
def position_seeds(samples: int) -> np.ndarray:
    return mixed(np.arange(1, samples + 1, dtype=U) * U(BASE)) | U(1)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2**53


def first_draw(terms: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The hash whose uniform decides a for weight one: terms by positions."""
    x = terms[:, None] * seeds
    x ^= x >> U(32)
    x *= MIX[1]
    x ^= x >> U(29)
    return x


def _smallest(terms: np.ndarray, seeds: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each position the smallest first draw among the terms and its term."""
    least, which = np.full(len(seeds), U(2**64 - 1)), np.zeros(len(seeds), U)
    places = np.arange(len(seeds))
    for at in range(0, len(terms), block):
        own = terms[at : at + block]
        draws = first_draw(own, seeds)
        rows = draws.argmin(axis=0)
        found = draws[rows, places]
        better = found <= least
        least, which = np.where(better, found, least), np.where(better, own[rows], which)
    return least, which


def _heavier(terms: np.ndarray, weights: np.ndarray, seeds: np.ndarray, block: int = 256):
    """For each position the smallest a among terms of any weight, its term and t."""
    least, which, level = np.full(len(seeds), np.inf), np.zeros(len(seeds), U), np.zeros(len(seeds), np.int64)
    places = np.arange(len(seeds))
    for at in range(0, len(terms), block):
        own, log_w = terms[at : at + block], np.log(weights[at : at + block])[:, None]
        draws = first_draw(own, seeds)
        one = -np.log1p(-_uniform(draws))
        c = one - np.log(_uniform(mixed(draws + MIX[0])))
        e = np.log(c / one)
        r = e - np.log(_uniform(mixed(draws + MIX[1])))
        b = 1 - e / r
        t = np.floor(log_w / r + b)
        a = c * np.exp(-r * (t - b + 1))
        rows = a.argmin(axis=0)
        found = a[rows, places]
        better = found <= least
        least, which = np.where(better, found, least), np.where(better, own[rows], which)
        level = np.where(better, t[rows, places].astype(np.int64), level)
    return least, which, level


def signature(hashes: np.ndarray, samples: int) -> np.ndarray:
    """`samples` values of 16 bits for a text's shingle hashes, repeats included."""
    if not len(hashes):
        return np.zeros(samples, np.uint16)
    seeds = position_seeds(samples)
    terms, counts = np.unique(hashes, return_counts=True)
    single = counts == 1
    draw, which = _smallest(terms[single], seeds)
    level = np.zeros(samples, np.int64)
    if not single.all():
        a = -np.log1p(-_uniform(draw)) if single.any() else np.full(samples, np.inf)
        least, other, t = _heavier(terms[~single], counts[~single].astype(float), seeds)
        which, level = np.where(least < a, other, which), np.where(least < a, t, level)
    kept = mixed(which * seeds + level.astype(U))
    return (kept >> U(48)).astype(np.uint16) | np.uint16(1)  # never the zeros of an empty text


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def text_signature(text: str | None, samples: int = 128, words: int = 5) -> np.ndarray:
    return signature(shingle_hashes((text or "").encode(), words)[0], samples)


def edited(text: str, following: str) -> str:
    """The last third of `text` replaced by as much of the start of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _dealt(docs: DataFrame, id_col: str, text: str, most_buckets: int, hot_rows: int) -> tuple[DataFrame, int]:
    """Rows (id, t, u, extra, bucket) in buckets of neighbours, each bucket
    followed by the first row of the next one (`extra`), so that each task finds
    every row's successor; and the number of buckets, at most the shuffle's
    partitions and `most_buckets`, twice that with those of hot ids.

    The order is the same however rows are dealt: by id, then by u, a hash of
    the text, then by text. Cuts come from approximate quantiles of the ids; an
    id (or the lack of one) that has more rows than a bucket is cut into ranges
    of u. One shuffle of the texts, plus one more row for each bucket. What
    the driver sees is a row for each bucket or hot id.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    rows = rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("t"), 33))
    n = rows.count()
    wanted = min(most_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(hot_rows, -(-n // wanted))
    hot = {r.id: r["count"] for r in rows.groupBy("id").count().filter(F.col("count") > most).collect()}
    cuts = rows.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    for i in hot.keys() - {None}:
        cuts += [float(i), math.nextafter(float(i), math.inf)]
    splits = [-math.inf, *sorted(set(cuts)), math.inf] if cuts else [-math.inf, 0.0, math.inf]
    # descending ids: bucket 0 holds the largest; null ids come last
    own = dict.fromkeys(range(len(splits)), 1)
    for i, count in hot.items():
        if i is None or abs(i) < 2**53:  # beyond, a double stands for several ids
            own[len(splits) - 1 if i is None else splits.index(float(i))] = -(-count // most)
    first, at = {}, 0
    for k in [*range(len(splits) - 2, -1, -1), len(splits) - 1]:
        first[k], at = at, at + own[k]
    rows = rows.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(float("nan"))))
    rows = Bucketizer(splits=splits, inputCol="x", outputCol="of", handleInvalid="keep").transform(rows)
    of = F.col("of").cast("int") + 1
    look_up = lambda found: F.element_at(F.lit([found[k] for k in range(len(splits))]), of)
    inner = F.floor(F.col("u") * look_up(own) / F.lit(2.0**31)).cast("int")
    rows = rows.select("id", "t", "u", (look_up(first) + inner).alias("bucket"))
    # the first id of each bucket: a row for each bucket, whatever its texts
    heads = rows.groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()
    if not heads:
        return rows.withColumn("extra", F.lit(False)), 1
    head = spark.createDataFrame([(r.bucket, r.id, heads[i - 1].bucket) for i, r in enumerate(heads)], "bucket int, head long, before int")
    # ids can repeat: of the rows with a bucket's first id only the first in order leads
    leading = rows.join(F.broadcast(head), "bucket").filter(F.col("id").eqNullSafe(F.col("head")))  # head: a row for each bucket
    extra = leading.groupBy("before", "id").agg(F.min(F.struct("u", "t")).alias("f"))
    rows = rows.withColumn("extra", F.lit(False)).unionByName(extra.select("id", "f.t", "f.u", F.col("before").alias("bucket"), F.lit(True).alias("extra")))
    return rows, at


def fingerprint_pairs(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: int = 128, words: int = 5, most_buckets: int = 20_000, hot_rows: int = 1024
) -> DataFrame:
    """For each row its text's and its edited text's fingerprints and hash, and
    how like they are each other and the next document's. The next document is
    that of the next smaller id (equal ids: in order of a hash of the text, then
    of the text; null ids last), after the last the first. `id_col` is a whole
    number."""
    rows, buckets = _dealt(docs, id_col, text, most_buckets, hot_rows)
    buckets = rows.repartitionById(buckets, "bucket").sortWithinPartitions(
        "bucket", "extra", F.col("id").desc_nulls_last(), "u", "t"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def described(id_, text_, before):
            text_ = text_ or ""
            same = before is not None and before[1] == text_
            return id_, text_, before[2] if same else signature(shingle_hashes(text_.encode(), words)[0], samples)

        def row(own, following):
            id_, text_, sig = own
            changed = edited(text_, following[1])
            data = changed.encode()
            sig_changed = sig if changed == text_ else signature(shingle_hashes(data, words)[0], samples)
            return (
                id_, len(text_), hashlib.sha256(data).hexdigest(), sig.astype(">u2").tobytes().hex(), sig_changed.astype(">u2").tobytes().hex(),
                likeness(sig, sig_changed), likeness(sig, following[2]),
            )

        def batch_of(out):
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        held, in_bucket = None, None
        for batch in batches:
            out = []
            for id_, t, bucket in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                this = described(id_, t, held)
                if held is not None and bucket == in_bucket:
                    out.append(row(held, this))
                held, in_bucket = this, bucket  # a bucket's last row is the extra one
                if len(out) >= 1024:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return buckets.select("id", "t", "bucket").mapInArrow(
        run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", samples: int = 128, words: int = 5, column: str = "fingerprint") -> DataFrame:
    """`keep` and the fingerprint of each text as an array of 16-bit values. No shuffle."""
    schema = docs.select(*keep).withColumn(column, F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_signature(t, samples, words).astype(np.int32) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def agreement(a: str | Column, b: str | Column) -> Column:
    """Share of positions at which two fingerprint arrays agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) / F.size(a)
