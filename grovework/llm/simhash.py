"""SimHash near-duplicate components by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. If
two fingerprints differ in at most four bits, two of the segments hold at most
two of the differences (pigeonhole). Each segment is decoded to the nearest
word of the perfect [23, 12, 7] Golay code. For each pair of segments a
fingerprint gets as keys the codeword indices of the pair itself and of the
pair with any one bit flipped: about ten distinct ones, because a flip mostly
stays within the same sphere. Fingerprints whose differences within the pair
are two or fewer have a common neighbour one flip from each, so they share a
key. The search is exact: keys only propose, distances decide.

Only distinct fingerprints are searched, so exact copies cost one row however
many they are. Buckets that hold more than `block` fingerprints are dealt into
blocks, and pairs of blocks go to different tasks. Each task returns a
spanning forest of the links it finds, never all pairs, and components come
from star contraction over those forests.

Edge cases: null, empty and blank texts have fingerprint zero, which links like
any other. Texts of any length are hashed whole. Rows with a null id get the
component's smallest id, null if it has none. Repeated rows stay repeated. An
empty table gives an empty result. Columns of `docs` besides id and text are
not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import free_prefix, written

#: Lowest bit and length of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = tuple(combinations(range(3), 2))
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message, and the error of weight three or less
    behind each of the 2048 syndromes."""
    message = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        message = np.where(message >> bit & 1, message ^ GENERATOR << (bit - 11), message)
    parity = message.astype(np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[parity[e >> 11] ^ e & 2047] = e
    return parity, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    parity, errors = golay_tables()
    return (words ^ errors[parity[words >> 11] ^ words & 2047]) >> 11


def golay_keys(fingerprints: np.ndarray) -> np.ndarray:
    """A row of keys for each fingerprint (uint64), repeated ones as -1."""
    own, flipped = [], []
    for low, length in SEGMENTS:
        part = (fingerprints >> np.uint64(low) & np.uint64((1 << length) - 1)).astype(np.int64)
        own.append(decode(part)[:, None])
        flipped.append(decode(part[:, None] ^ (1 << np.arange(length, dtype=np.int64))))
    keys = np.concatenate(
        [
            block + (n << 24)
            for n, (i, j) in enumerate(PAIRS)
            for block in ((own[i] << 12) + own[j], (flipped[i] << 12) + own[j], (own[i] << 12) + flipped[j])
        ],
        axis=1,
    )
    keys.sort(axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def simhash(text: str | None, words: int = 4) -> int:
    """Bits that are set in over half of the shingle hashes."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII blanks count
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (h64(joined[s:e], 42) for s, e in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist())),
        "<u8",
        len(tokens) - width + 1,
    )
    return set_bits(hashes)


def set_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of 64-bit hashes."""
    lanes = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    bits = counts @ (np.arange(256)[:, None] >> np.arange(8) & 1)  # byte, bit
    return int(np.packbits((2 * bits.ravel() > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """`id_col` and fp, the fingerprint as a signed 64-bit integer. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text].alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = golay_keys(own.view(np.uint64))
                kept = keys >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[kept].astype(np.int32)), pa.array(np.repeat(own, kept.sum(axis=1)))], names=["key", "fp"]
                )

    return distinct.select("fp").mapInArrow(run, "key int, fp long")


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between `values` (uint64)."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    left = np.ones(len(values), bool)
    edges = []
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        while queue and left.any():
            at = queue.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            edges += [(at, int(x)) for x in found]
            queue += found.tolist()
    return edges


def _links(bucketed: DataFrame, distance: int) -> DataFrame:
    """Edges a < b from rows (bucket, fp) sorted by bucket."""

    def linked(rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(starts, len(rows)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(rows[two] ^ rows[two + 1]) <= distance]
        edges = [np.stack([rows[two], rows[two + 1]], axis=1)]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = rows[start : start + size]
            if found := forest(own, distance):
                edges.append(own[np.array(found)])
        return np.concatenate(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
            edges = np.unique(np.sort(linked(rows, bucket).view(np.int64), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        rows, bucket = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rows, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            bucket = np.concatenate([bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut:
                yield out(rows[:cut], bucket[:cut])
            rows, bucket = rows[cut:], bucket[cut:]
        if len(rows):
            yield out(rows, bucket)

    return bucketed.select("bucket", "fp").mapInArrow(run, "a long, b long")


def blocks_met(own: Column, g: Column) -> Column:
    """Numbers of the pairs of blocks, of g, that block `own` takes part in."""
    others = F.filter(F.sequence(F.lit(0), g - 1), lambda x: x != own)
    return F.when(g == 1, F.array(F.lit(0))).otherwise(F.transform(others, lambda x: F.least(x, own) * g + F.greatest(x, own)))


def near_links(distinct: DataFrame, distance: int = 4, block: int = 1024) -> DataFrame:
    """Links (a, b) between the fingerprints in column fp of `distinct` that
    differ in at most `distance` (at most four) bits: not all of them, but
    enough to connect whatever all of them connect."""
    if not 0 <= distance <= 4:
        raise ValueError("three segments find differences of at most four bits")
    keyed = _keyed(distinct)
    crowded = keyed.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("g")).filter("g > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("g").cast("long")).cast("int")
    met = F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(blocks_met(F.col("own"), F.col("g")))
    bucketed = (
        keyed.join(crowded, "key", "left")
        .withColumn("own", own)
        .select("fp", "key", F.explode(met).alias("met"))
        .select("fp", F.xxhash64("key", "met").alias("bucket"))
    )
    # two buckets that share a hash only propose more pairs
    return _links(bucketed.repartition("bucket").sortWithinPartitions("bucket"), distance).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node
    reachable. Alternates large-star and small-star steps until nothing
    changes; the rounds grow with the logarithm of the longest path."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written: so the joins have plain shuffles on both sides, which Spark splits where a node has many neighbours
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, block: int = 1024
) -> DataFrame:
    """`id_col`, fp and component_id (the smallest id reachable by links)."""
    own = written(fingerprints(docs, id_col, text, words), "fingerprints")
    least = own.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    roots = components(near_links(least, distance, block))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # written: the join below then has plain shuffles on both sides, which Spark splits for large components
    classes = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "classes")
    by_fp = rooted.join(classes, "root").select("fp", "component_id")
    return own.join(by_fp, "fp", "left").select(id_col, "fp", "component_id")


def hex16(fp: str = "fp"):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component of near copies (five-word
    shingles, similarity 0.8 or more): that of the smallest id.

    A row without id counts as one with a negative id that follows from its
    text. Rows are told apart by id and text, so different texts that share an
    id stay, each for its component; of rows that repeat both, one stays.
    """
    from grovework.llm.nearcopies import near_copies

    own = free_prefix(docs.columns, "row_")
    key, hashed = f"{own}id", f"{own}hash"
    keyed = docs.withColumn(hashed, F.xxhash64(text))
    keyed = keyed.withColumn(key, F.coalesce(F.col(id_col).cast("long"), -F.abs(F.col(hashed) / 2).cast("long") - 1))
    least = near_copies(keyed, key, text).groupBy("component").agg(F.min(F.struct("id", "hash")).alias("row"))
    kept = least.select(F.col("row.id").alias(key), F.col("row.hash").alias(hashed))
    # maps have no order, their JSON has
    order = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes if c not in (id_col, text)] or [F.lit(0)]
    first = F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row")
    return keyed.join(kept, [key, hashed], "left_semi").groupBy(key, hashed).agg(first).select("row.*")
