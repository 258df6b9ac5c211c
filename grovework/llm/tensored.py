"""MinHash near-duplicates by tensored banding.

A text is the set of its four-word shingles. From 48 min-wise positions come 16
half keys of three positions each; every pair of different half keys is the key
of one table, so 120 tables of six positions need 48 minima where separate ones
would need 720. Two texts meet in a table if they share two half keys: with a
chance of 0.9998 at a similarity of 0.8, 0.99999 at 0.85.

A pair of half keys can only meet another text where both halves occur more than
once. So half keys are counted first, and pairs are made of shared ones only:
the tables keep all that they could match and lose the rest.

Texts with the same set are one node. In each bucket the nodes are compared with
the bucket's leader; what links makes components. Buckets that then still hold
several components are searched in full, block by block, with an exact prefix
filter. Every link is confirmed on the full sets (64-bit hashes of the
shingles) in whole numbers: 100 times the intersection is at least `percent`
times the union.

Edge cases: null, empty and blank texts have an empty set and link with nothing,
not with each other. A text of fewer words is one shingle. Texts of any length
are used whole. Repeated rows stay repeated and share a component. A row
without id takes the smallest id of its component, null if it has none. An
empty table gives an empty result. Columns besides id and text are not read, so
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import slices, written
from grovework.llm.fingerprint import position_seeds
from grovework.llm.nearcopies import leader_pairs, open_buckets, shingles
from grovework.llm.simhash import components

HALVES, POSITIONS = 16, 3


def half_keys(terms: np.ndarray, halves: int = HALVES, positions: int = POSITIONS, block: int = 2048) -> np.ndarray:
    """A set's half keys: the number of the half in the four highest bits, so
    they sort by it, and a hash of its minima below."""
    seeds = position_seeds(halves * positions)
    least = np.full(len(seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(terms), block):
        np.minimum(least, (terms[at : at + block, None] * seeds).min(axis=0), out=least)
    found = [xxhash.xxh64_intdigest(part.tobytes()) >> 4 | n << 60 for n, part in enumerate(least.reshape(halves, positions))]
    return np.array(found, np.uint64).view(np.int64)


def described(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """id, hash of the text, node, size of the set and half keys of each row. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2):
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([half_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "hash", "node", "size", "halves"],
            )

    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, hash long, node long, size long, halves array<long>")


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, size): a key for each pair of half keys that other nodes have too."""
    halves = nodes.select("node", "size", F.explode("halves").alias("half"))
    shared = written(halves.groupBy("half").count().filter("count > 1").select("half"), "halves")
    kept = halves.join(shared, "half").groupBy("node", "size").agg(F.array_sort(F.collect_list("half")).alias("halves"))
    kept = written(kept.filter(F.size("halves") > 1), "paired")
    pairs = F.transform("halves", lambda x, i: F.transform(F.slice("halves", i + 2, F.size("halves")), lambda y: F.xxhash64(x, y)))
    return kept.select(F.explode(F.flatten(pairs)).alias("key"), "node", "size")


def buckets_of(keyed: DataFrame) -> DataFrame:
    """(key, node, size, n, leader) of the nodes in buckets of two or more. The
    leader has the least hash, so crowds that share many buckets share leaders."""
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), leader.alias("l")).filter("n > 1")
    buckets = written(buckets.select("key", "n", F.struct("l.node", "l.size").alias("leader")), "buckets")
    return written(keyed.join(buckets, "key"), "shared")


def alike(inter: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int, percent: int):
    return 100 * inter >= percent * (one + other - inter)


def common(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(one) > len(other):
        one, other = other, one
    at = np.searchsorted(other, one)
    return int((other[np.minimum(at, len(other) - 1)] == one).sum()) if len(one) else 0


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, text) for the nodes in `wanted` (node, hash). Copies are merged
    before the shuffle."""
    rows = docs.select(F.xxhash64(text).alias("hash"), docs[text].alias("text"))
    return rows.groupBy("hash").agg(F.first("text").alias("text")).join(wanted, "hash").select("node", "text")


def _starred(pairs: DataFrame, texts: DataFrame, slice_rows: int = 512) -> DataFrame:
    """Rows (hub, slice, spoke, text) to compare each hub with its spokes, of
    which a slice holds some 512: the hub's own row, without spoke, is in each."""
    n = pairs.groupBy("hub").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("g"))
    spokes = pairs.join(n, "hub").select("hub", F.pmod(F.xxhash64("spoke"), F.col("g").cast("long")).cast("int").alias("slice"), "spoke")
    hubs = n.select("hub", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("slice"), F.lit(None).cast("long").alias("spoke"))
    rows = hubs.unionByName(spokes).withColumn("node", F.coalesce("spoke", "hub"))
    return rows.join(texts, "node").select("hub", "slice", "spoke", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (hub, spoke) whose sets are alike, as links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in slices(batches, text=3):
            found = []
            for h, spoke, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                terms = shingles(text, words)
                if spoke is None:
                    hub, own = h, terms
                elif alike(common(own, terms), len(own), len(terms), percent):
                    found.append((hub, spoke))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    rows = _starred(pairs, texts).repartition("hub", "slice").sortWithinPartitions("hub", "slice", F.col("spoke").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def block_links(nodes: list[int], labels: list[int], sets: list[np.ndarray], percent: int, crowd: int = 4096) -> list[tuple[int, int]]:
    """Confirmed links between the nodes of a block that have different labels:
    enough to connect whatever all of them connect. Alike sets share one of
    their rarest terms (prefix filter), so only those are looked up; where
    those terms lead to more than `crowd` places, all sets before are compared."""
    label, links = np.unique(labels, return_inverse=True)[1].copy(), []
    sizes = np.array([len(s) for s in sets])
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    own_terms = [term[end - n : end] for end, n in zip(ends.tolist(), sizes.tolist())]
    held = np.zeros(len(count), np.int32)
    index: dict[int, list[int]] = {}
    for at, own in enumerate(own_terms):
        rarest = own[np.lexsort((own, count[own]))][: sizes[at] - -(-percent * sizes[at] // 100) + 1]
        looked = rarest[count[rarest] > 1].tolist()
        places = [index.setdefault(t, []) for t in looked]
        met = np.arange(at) if sum(map(len, places)) > crowd else np.array(sorted({k for p in places for k in p}), np.int64)
        met = met[(label[met] != label[at]) & (100 * np.minimum(sizes[met], sizes[at]) >= percent * np.maximum(sizes[met], sizes[at]))]
        if len(met):
            held[own] = 1
            starts = np.concatenate(([0], np.cumsum(sizes[met])[:-1]))
            both = np.add.reduceat(held[np.concatenate([own_terms[k] for k in met.tolist()])], starts)
            held[own] = 0
            near = met[alike(both, sizes[met], sizes[at], percent)]
            for k in near[np.unique(label[near], return_index=True)[1]].tolist():  # one for each component
                links.append((nodes[k], nodes[at]))
                label[label == label[k]] = label[at]
        for place in places:
            place.append(at)
    return links


def _searched(bucketed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) from rows (bucket, node, label, text) sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            links = block_links(*map(list, zip(*rows)), percent) if len({r[1] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        now, held = None, []
        for batch in slices(batches, text=3):
            for bucket, node, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield out(held)
                    held = []
                now = bucket
                held.append((node, label, shingles(text, words)))
        if held:
            yield out(held)

    return bucketed.select("bucket", "node", "label", "text").mapInArrow(run, "a long, b long")


def tensored_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80, block: int = 1024) -> DataFrame:
    """`id_col`, n_shingles and component_id (the smallest id reachable by links) of each row."""
    own = written(described(docs, id_col, text, words), "described")
    nodes = written(own.filter("size > 0").dropDuplicates(["node"]).select("node", "size", "hash", "halves"), "nodes")
    shared = buckets_of(table_keys(nodes))
    pairs = written(leader_pairs(shared, percent / 100 - 1e-9).select(F.col("a").alias("hub"), F.col("b").alias("spoke")).distinct(), "candidates")
    met = pairs.select(F.explode(F.array("hub", "spoke")).alias("node")).unionByName(shared.filter("n > 2").select("node")).distinct()
    texts = written(_texts(docs, text, nodes.select("node", "hash").join(met, "node")), "texts")
    links = written(confirmed(pairs, texts, words, percent), "links")
    still = written(open_buckets(shared, components(links), block), "open")
    bucketed = still.join(texts, "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    roots = components(links.unionByName(_searched(bucketed, words, percent)))
    least = own.filter("size > 0").groupBy("node").agg(F.min("id").alias("least"))
    rooted = least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # written: the joins below then have plain shuffles on both sides, which Spark splits for large components
    classes = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    by_node = written(rooted.join(classes, "root").select("node", "component_id"), "by-node")
    linked = own.filter("size > 0").select("id", "node", "size").join(by_node, "node").select("id", "size", "component_id")
    alone = own.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
