"""Near copies: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.

A SimHash of 64 bits differs in about ten bits at that similarity, and a search
that wide proposes a fixed share of all pairs. So SimHash with Golay keys finds
what differs in at most four bits, and min-wise hashing proposes the rest: 30
bands of 7 positions each, where two texts meet in a band with probability J^7
(0.9991 at J = 0.8 for any of the 30). Both only propose; each link is verified
on the whole shingle sets.

Texts with the same set of shingles are one node. First each node of a bucket
is compared with one of them, the bucket's leader, and what links makes a
component: crowds of near copies are settled there with one comparison for each
node and bucket. Buckets whose nodes are then still in different components are
searched in full: in blocks, with min-wise sketches to rule out pairs that
can't reach 0.8, and the sets of the others; pairs that are connected by then
are skipped. Only links leave a block, never all pairs, and none is lost but
for a sketch that is 5 standard deviations off (odds under 10^-6 for a pair).

Edge cases: null, empty and blank texts are one node that links to no other. A
text of fewer than five words is one shingle. Texts of any length are used
whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import slices, written
from grovework.llm.fingerprint import position_seeds, shingle_hashes
from grovework.llm.simhash import blocks_met, components, near_links, set_bits

BANDS, POSITIONS = 30, 7
#: Sketches this far below the wanted similarity rule a pair out.
SLACK = 0.15


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    return np.unique(shingle_hashes((text or "").encode(), words)[0])


def minima(terms: np.ndarray, block: int = 512) -> np.ndarray:
    """The least value of each of the min-wise positions."""
    seeds = position_seeds(BANDS * POSITIONS)
    least = np.full(len(seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(terms), block):
        np.minimum(least, (terms[at : at + block, None] * seeds).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = least.reshape(BANDS, POSITIONS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), n) for n, p in enumerate(parts)], np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    """A byte for each position."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def described(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, hash of the text, node, number of shingles, SimHash, band keys and
    sketch of each row. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            least = [minima(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(np.array([set_bits(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([band_keys(m) if len(s) else [] for s, m in zip(sets, least)], pa.list_(pa.int64())),
                    pa.array([sketch(m) for m in least], pa.binary()),
                ],
                names=["id", "hash", "node", "size", "fp", "keys", "sketch"],
            )

    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, hash long, node long, size int, fp long, keys array<long>, sketch binary")


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / max(1, len(one) + len(other) - both)


def _terms(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            # 32 bits of each hash: enough within a pair of texts
            sets = [np.unique((shingles(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "terms"])

    return texts.select("node", "text").mapInArrow(run, "node long, terms binary")


def _verified(pairs: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets x and y are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [similarity(_terms(x.as_py()), _terms(y.as_py())) >= alike for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, n, leader, node, size) of the nodes in buckets of two or more. A
    bucket's leader is the node with the least hash, so crowds that share many
    buckets share leaders."""
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size"))
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), leader.alias("leader")).filter("n > 1"), "buckets")
    return written(keyed.join(buckets, "key"), "shared")


def leader_pairs(shared: DataFrame, alike: float) -> DataFrame:
    """Each node with the leader of each of its buckets, if sizes allow `alike`."""
    fits = F.least("size", "leader.size") >= alike * F.greatest("size", "leader.size")
    pairs = shared.filter((F.col("node") != F.col("leader.node")) & fits)
    return pairs.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))


def simhash_pairs(nodes: DataFrame, alike: float) -> DataFrame:
    """Pairs that SimHash links: each node with the first one of its own
    fingerprint, and the first ones of linked fingerprints."""
    first = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("f")), "first")
    same = nodes.join(first, "fp").select(F.struct("node", "size").alias("x"), F.col("f").alias("y"))
    x, y = (first.select(F.col("fp").alias(n), F.col("f").alias(f)) for n, f in (("a", "x"), ("b", "y")))
    pairs = near_links(first).join(x, "a").join(y, "b").select("x", "y").unionByName(same).filter("x.node <> y.node")
    pairs = pairs.filter(F.least("x.size", "y.size") >= alike * F.greatest("x.size", "y.size"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def block_links(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, terms: list[bytes], alike: float) -> list[tuple[int, int]]:
    """Verified links between the nodes of a block that have different labels:
    enough to connect whatever all of them connect."""
    _, label = np.unique(labels, return_inverse=True)
    label, links = label.copy(), []
    for at in range(len(nodes) - 1):
        others = np.flatnonzero(label[at + 1 :] != label[at]) + at + 1
        others = others[np.minimum(sizes[others], sizes[at]) >= alike * np.maximum(sizes[others], sizes[at])]
        near = (sketches[others] == sketches[at]).mean(axis=1)
        for k in others[near >= alike - SLACK][np.argsort(-near[near >= alike - SLACK], kind="stable")]:
            if label[k] != label[at] and similarity(_terms(terms[at]), _terms(terms[k])) >= alike:
                links.append((int(nodes[at]), int(nodes[k])))
                label[label == label[k]] = label[at]
    return links


def _searched(bucketed: DataFrame, alike: float) -> DataFrame:
    """Links (a, b) from rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            nodes, labels, sizes, sketches, terms = zip(*rows)
            links = block_links(np.array(nodes), np.array(labels), np.array(sizes), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), -1), list(terms), alike) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield out(held)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield out(held)

    return bucketed.select("bucket", "node", "label", "size", "sketch", "terms").mapInArrow(run, "a long, b long")


def open_buckets(shared: DataFrame, roots: DataFrame, block: int, terms: int = 4_000_000) -> DataFrame:
    """(node, label, bucket) of the buckets of three nodes or more that hold
    several components; those of more than `block` nodes or `terms` shingles
    in pairs of blocks."""
    labels = shared.filter("n > 2").join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("label"))
    labels = written(labels, "labelled")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / terms)).cast("int")
    mixed = labels.groupBy("key").agg(blocks.alias("g"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    rows = labels.join(mixed.select("key", "g"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g").cast("long")).cast("int"))
    rows = rows.select("node", "label", "key", F.explode(blocks_met(F.col("own"), F.col("g"))).alias("met"))
    return rows.select("node", "label", F.xxhash64("key", "met").alias("bucket"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", alike: float = 0.8, block: int = 1024) -> DataFrame:
    """id, hash (xxhash64 of the text) and component of each row of `docs`:
    components connect what links of similarity `alike` or more connect."""
    own = written(described(docs, id_col, text), "described")
    nodes = written(own.filter("size > 0").dropDuplicates(["node"]).select("node", "size", "fp", "keys", "sketch", "hash"), "nodes")
    shared = shared_buckets(nodes)
    pairs = written(leader_pairs(shared, alike).unionByName(simhash_pairs(nodes, alike)).distinct(), "candidates")
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.filter("n > 2").select("node")).distinct()
    # rows of a node have equal shingles, so the text of any of its hashes will do
    wanted = nodes.join(met, "node").select("node", "hash")
    texts = docs.select(F.xxhash64(text).alias("hash"), docs[text].alias("text")).join(wanted, "hash").dropDuplicates(["node"])
    sets = written(_sets(texts), "shingles")
    x, y = sets.select(F.col("node").alias("a"), F.col("terms").alias("x")), sets.select(F.col("node").alias("b"), F.col("terms").alias("y"))
    links = written(_verified(pairs.join(x, "a").join(y, "b"), alike), "links")
    still = written(open_buckets(shared, components(links), block), "open")
    bucketed = still.join(nodes.select("node", "size", "sketch"), "node").join(sets, "node")
    links = links.unionByName(_searched(bucketed.repartition("bucket").sortWithinPartitions("bucket", "node"), alike))
    roots = components(links)
    return own.select("id", "hash", "node").join(roots, "node", "left").select("id", "hash", F.coalesce("root", "node").alias("component"))
