"""Stored tables, streams in any order of arrival, repaired trees, communities level by level."""

import itertools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovework.operators import cluster, graph, tree
from grovework.sources import nodes as sources
from grovework.sources.snapshots import Conflict, NodeTable, Snapshots, repair_trees
from grovework.streaming import ingest

SCHEMA = "node_id string, document_id string, layer int, text string"


def rows_of(spark, documents, text="t"):
    rows = [(f"{d}_{layer}_{k}", d, layer, f"{text} {k}") for d in documents for layer, n in ((0, 3), (1, 2), (2, 1)) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def held(rows):
    return sorted(tuple(r) for r in rows.select("node_id", "text").collect())


def test_changes_are_versions_and_survive_a_crash(spark, tmp_path, monkeypatch):
    table = NodeTable(spark, str(tmp_path), 8)
    assert table.latest() == 0
    first = table.append(rows_of(spark, "abcd"))
    every = held(table.nodes())
    table.delete_documents(spark.createDataFrame([("a",), ("nobody",)], "document_id string"))
    table.delete_layers(spark.createDataFrame([("b",)], "document_id string"), 1)
    now = held(table.nodes())
    assert now == sorted(r for r in every if r[0][0] != "a" and not (r[0][0] == "b" and r[0][2] != "0"))
    assert held(table.nodes(first)) == every  # the version before is still there

    # a crash after the data is written and before the version is made
    def crash(self, base, entries):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(NodeTable, "commit", crash)
        with pytest.raises(OSError):
            table.replace(rows_of(spark, "c", "new"))
    assert held(NodeTable(spark, str(tmp_path), 8).nodes()) == now
    table.replace(rows_of(spark, "c", "new"))  # the same upload again
    after = held(table.nodes())
    assert after == sorted([r for r in now if r[0][0] != "c"] + held(rows_of(spark, "c", "new")))
    # a version file that broke off is none
    (tmp_path / "versions" / f"{table.latest() + 1:010d}").write_text('{"nodes')
    assert held(table.nodes()) == after
    table.append(rows_of(spark, "e"))
    assert held(table.nodes()) == sorted(after + held(rows_of(spark, "e")))
    table.vacuum(keep=1)
    assert len(table.versions()) == 1 and len(held(table.nodes())) == len(after) + 6


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    one, two = NodeTable(spark, str(tmp_path), 4), NodeTable(spark, str(tmp_path), 4)
    one.append(rows_of(spark, "a"))
    base = one.latest()
    two.append(rows_of(spark, "b"))
    with pytest.raises(Conflict):
        one.commit(base, one.entries(base))
    # both looked before either wrote
    monkeypatch.setattr(Snapshots, "latest", lambda self: base)
    monkeypatch.setattr(one._files.__class__, "exists", lambda self, p: False, raising=False)
    assert {r.document_id for r in NodeTable(spark, str(tmp_path), 4).nodes(base + 1).collect()} == {"a", "b"}


def test_untouched_partitions_are_not_rewritten(spark, tmp_path):
    table = NodeTable(spark, str(tmp_path), 16)
    table.append(rows_of(spark, [f"d{k}" for k in range(40)]))
    before = table.entries()
    table.delete_layers(spark.createDataFrame([("d7",)], "document_id string"), 1)
    after = table.entries()
    changed = {k for k in before if before.get(k) != after.get(k)}
    assert 0 < len(changed) <= 2 and all(k.split("/")[1] in "12" for k in changed)
    for k in range(10):
        table.append(rows_of(spark, [f"x{k}"]))
    table.compact(most=2)
    assert max(len(v) for k, v in table.entries().items() if k.startswith("nodes/")) <= 2 and table.nodes().count() == 40 * 6 - 3 + 60


def test_graphs_are_saved_as_one_version(spark, tmp_path):
    edges = spark.createDataFrame([("d", "a", "b", 0.5)], "document_id string, src string, dst string, weight double")
    index = spark.createDataFrame([("d", "e", "a")], "document_id string, entity string, node_id string")
    first = sources.save_graph(edges, index, str(tmp_path))
    sources.save_graph(edges.withColumn("weight", F.lit(0.7)), index.limit(0), str(tmp_path))
    now, before = sources.load_graph(spark, str(tmp_path)), sources.load_graph(spark, str(tmp_path), first)
    assert now[0].first().weight == 0.7 and now[1].count() == 0 and before[0].first().weight == 0.5 and before[1].count() == 1


def test_a_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.MD").write_text("two\nlines")
    spark.createDataFrame([("c", "three")], "document_id string, text string").toPandas().to_parquet(tmp_path / "p.parquet")
    assert {tuple(r) for r in sources.read_documents(spark, str(tmp_path)).select("document_id", "text").collect()} == {("a", "one"), ("b", "two\nlines"), ("c", "three")}
    (tmp_path / "x.pdf").write_text("?")
    with pytest.raises(ValueError):
        sources.read_documents(spark, str(tmp_path))


def test_files_may_arrive_in_any_order(spark, tmp_path):
    texts, start = {1: "Oldest words.", 2: "Middle words.", 3: "Newest words."}, time.time() - 10_000
    for n, order in enumerate(itertools.permutations(texts)):
        if n % 2:
            continue
        source, target, state = (str(tmp_path / f"{n}-{x}") for x in ("in", "out", "state"))
        os.mkdir(source)
        for age in order:
            path = f"{source}/f{age}.parquet"
            spark.createDataFrame([("a", texts[age] if age < 3 or n else "")], "document_id string, text string").toPandas().to_parquet(path)
            os.utime(path, (start + age, start + age))
            ingest.stream_ingest(spark, source, target, state).awaitTermination()
        # once the newest text is empty: then nothing of the older ones may stay
        assert [r.text for r in ingest.current(spark, target).collect()] == [texts[3] if n else ""]


def test_repair_equals_a_full_rebuild(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"{d}{k:02d}", d, 0, k, False, f"The Text {d} {k}. More of it.", (np.eye(4)[k % 4] + rng.standard_normal(4) * 0.05).tolist()) for d in "abc" for k in range(12)]
    schema = "node_id string, document_id string, layer int, chunk_index int, is_summary boolean, text string, embedding array<double>"
    base = spark.createDataFrame(rows, schema)
    asked = []

    def build(some):
        asked.append({r.document_id for r in some.select("document_id").distinct().collect()})
        return tree.build_tree(some.drop("entities", "entity_names"))[0]

    table = NodeTable(spark, str(tmp_path), 4)
    table.change(build(base), tables={"fingerprints": ingest.fingerprints(base)})
    changed = table.nodes().filter("layer = 0 and document_id = 'b'").withColumn("text", F.concat(F.lit("Changed. "), "text"))
    table.change(changed.unionByName(table.nodes().filter("layer > 0 and document_id = 'b'")), changed.select("document_id"))
    asked.clear()
    repair_trees(table, build)
    assert asked == [{"b"}]
    version = table.latest()
    assert repair_trees(table, build) == version  # nothing is stale any more
    every = lambda rows: sorted((r.node_id, r.text, tuple(r.child_ids)) for r in rows.collect())
    assert every(table.nodes()) == every(build(table.nodes().filter("layer = 0")))
    assert {r.layer for r in table.nodes().collect()} == {0, 1, 2} or table.nodes().filter("layer = 1").count() == 12


def modularity(pairs, labels):
    weight = {}
    for a, b, w in pairs:
        weight[a] = weight.get(a, 0) + w
        weight[b] = weight.get(b, 0) + w
    total = sum(weight.values())
    inner = sum(2 * w for a, b, w in pairs if labels[a] == labels[b]) / total
    by = {}
    for n, k in weight.items():
        by[labels[n]] = by.get(labels[n], 0) + k
    return inner - sum((k / total) ** 2 for k in by.values())


def test_levels_find_nested_communities_whatever_the_partitions(spark):
    rng = np.random.default_rng(9)
    nodes = [f"n{k:03d}" for k in range(240)]
    pairs = [(a, b, 1.0) for i, a in enumerate(nodes) for j, b in enumerate(nodes[i + 1 :], i + 1) if rng.random() < (0.9 if i // 8 == j // 8 else 0.12 if i // 40 == j // 40 else 0.004)]
    frame = spark.createDataFrame([("d", a, b, w) for a, b, w in pairs], "document_id string, a string, b string, sim double")
    every = spark.createDataFrame([("d", n) for n in nodes], "document_id string, node_id string")
    found = {r.node_id: r.cluster for r in cluster.communities(frame, every).collect()}
    best = max(modularity(pairs, {n: k // size for k, n in enumerate(nodes)}) for size in (8, 40))
    assert modularity(pairs, found) >= best - 0.03
    again = {r.node_id: r.cluster for r in cluster.communities(frame.repartition(8), every.repartition(1)).collect()}
    assert again == found
    for c in set(found.values()):  # connected
        own = {n for n in nodes if found[n] == c}
        seen, queue = set(), [min(own)]
        while queue:
            n = queue.pop()
            if n not in seen:
                seen.add(n)
                queue += [b if a == n else a for a, b, _ in pairs if n in (a, b) and {a, b} <= own]
        assert seen == own


def test_soft_membership_is_the_mean_cosine(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 5))
    nodes = spark.createDataFrame([("d", f"n{k}", x[k].tolist()) for k in range(30)], "document_id string, node_id string, embedding array<double>")
    clusters = spark.createDataFrame([("d", f"n{k}", k % 3) for k in range(30)], "document_id string, node_id string, cluster int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"n{k}", c): (unit[k] @ unit[c::3].T).mean() for k in range(30) for c in range(3) if c != k % 3}
    got = {(r.node_id, r.cluster): r.weight for r in cluster.soft_membership(nodes, clusters, 0.05).collect()}
    assert {k for k, v in got.items() if v != 1.0} == {k for k, v in want.items() if v > 0.05}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items() if v > 0.05)
    assert graph.THRESHOLD == 0.3
