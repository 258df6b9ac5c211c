"""Nearest nodes and pairs in blocks, without pairs that nothing asks for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovework.operators import pairs


@pytest.mark.parametrize("rows_each", [1024, 7, 2])
def test_nearest_pairs_equal_brute_force(spark, rows_each):
    """Few and many blocks, copies (by id), a zero and a null vector, groups that have one side only."""
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(5).tolist() for _ in range(30)]
    left = [(f"p{i:02d}", f"d{i % 3}", vectors[i]) for i in range(20)] + [("alone", "x", vectors[0])]
    right = [(f"k{i:02d}", f"d{i % 2}", vectors[i % 12]) for i in range(60)] + [("none", "d0", None), ("zero", "d1", [0.0] * 5), ("few", "d2", None), ("other", "y", vectors[1])]
    kind = "node_id string, document_id string, embedding array<double>"
    found = pairs.nearest_pairs(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["document_id"], 4, rows_each).collect()
    got = {}
    for r in found:
        got.setdefault(r.a, set()).add(r.b)

    def cosine(a, b):
        if b is None:
            return -2.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 12) if n else 0.0

    want = {}
    for a, d, v in left:
        best = sorted((-cosine(v, w), b) for b, e, w in right if e == d)[:4]
        if best:
            want[a] = {b for _, b in best}
    assert got == want


def test_children_are_found_without_a_join_of_all_pairs(spark):
    from grovework.plans import views

    plan = views.child_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
    assert views.child_edges(spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] > 0


def test_overlap_shuffles_nodes_not_pairs(spark):
    """200 nodes with one entity: 19 900 pairs, but no exchange carries more than the nodes in their blocks."""
    from grovework.operators import graph

    nodes = spark.createDataFrame([(f"n{i:03d}", "d") for i in range(200)], "node_id string, document_id string")
    given = spark.createDataFrame([(f"n{i:03d}", "All", 5, 0) for i in range(200)] + [("n000", "one", 9, 1)], "node_id string, name string, importance int, rank int")
    rows = graph.entity_overlap(given, nodes, 50)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().splitlines()[0].startswith(("Project", "MapInArrow")) and "Aggregate" not in plan.split("MapInArrow")[0]
    found = rows.collect()
    assert len(found) == len({(r.a, r.b) for r in found}) == 199 * 100 and all(r.a < r.b for r in found)
    assert {round(r.score, 6) for r in found if r.a != "n000"} == {0.5} and {round(r.score, 6) for r in found if r.a == "n000"} == {0.25}


def test_a_node_goes_to_eight_tasks_at_the_most_and_every_pair_meets_once(spark, monkeypatch):
    """300 nodes in blocks of 20 once were copied fifteen times each, so what is shuffled grew with the square."""
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((300, 4))
    nodes = spark.createDataFrame([(f"n{k:03d}", "d", v) for k, v in enumerate(vectors.tolist())], "node_id string, document_id string, embedding array<double>")
    pairs_of = lambda: pairs.weighed_pairs(nodes, None, pairs.cosine_only, rows_each=20)
    found = pairs_of().collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = {(f"n{a:03d}", f"n{b:03d}"): (unit[a] @ unit[b]) for a in range(300) for b in range(a + 1, 300)}
    assert len(found) == len(want) and all(abs(want[r.a, r.b] - r.sim) < 1e-12 for r in found)

    monkeypatch.setattr(type(nodes), "mapInArrow", lambda rows, *_: rows)
    copies = pairs_of().groupBy("node_id").count().collect()
    assert len(copies) == 300 and max(r["count"] for r in copies) <= 8


def test_letters_of_a_batch_need_little_memory(spark):
    """Numbers for each letter of the whole batch once took some thirty times its size."""
    import tracemalloc

    from grovework.operators.embedding import letter_counts, over_arrays

    texts = ["Az bz, É" * 500] * 2000  # 8 MB
    tracemalloc.start()
    counts = letter_counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 and counts[0].tolist() == [500.0, 500.0, *[0.0] * 23, 1000.0]
    rows = spark.createDataFrame([(1, ["ab", "", "Z"]), (2, []), (3, ["c"])], "k int, t array<string>").coalesce(1)
    found = {r.k: r.v for r in rows.select("k", over_arrays(letter_counts, 2)(F.col("t")).alias("v")).collect()}
    assert [len(found[k]) for k in (1, 2, 3)] == [3, 0, 1] and found[1][2][25] == found[3][0][2] == 1.0 and sum(found[1][1]) == 0.0


def test_nearest_edges_are_the_top_neighbours(spark):
    """One large document in many blocks with copies, small ones besides."""
    from grovework.operators import graph

    rng = np.random.default_rng(5)
    made = [rng.standard_normal(4).tolist() for _ in range(60)]
    nodes = [(f"n{k:03d}", "big" if k < 150 else f"small{k % 9}", 0, made[k % 60]) for k in range(180)]
    ents = [(n, name, int(rng.integers(1, 11)), r) for n, *_ in nodes for r, name in enumerate({"All", *rng.choice([f"E{i}" for i in range(40)], 2).tolist()})]
    frame = spark.createDataFrame(nodes, "node_id string, document_id string, layer int, embedding array<double>")
    given = spark.createDataFrame(ents, "node_id string, name string, importance int, rank int")
    want = {(r.src, r.rank): r.dst for r in graph.top_neighbours(graph.build_edges(frame, given)).collect()}
    wide = {(r.a, r.b, round(r.sim, 9)) for r in graph.knn_graph(frame, 5).collect()}
    original = graph.weighed_pairs
    try:
        for each in (1024, 20, 3):
            graph.weighed_pairs = lambda *a, **b: original(*a, rows_each=each, **b)  # noqa: B023
            assert {(r.src, r.rank): r.dst for r in graph.nearest_edges(frame, given).collect()} == want
            assert {(r.a, r.b, round(r.sim, 9)) for r in graph.knn_graph(frame, 5).collect()} == wide
    finally:
        graph.weighed_pairs = original


def test_a_tree_makes_no_edges_unless_they_are_read(spark, monkeypatch):
    from grovework.operators import graph, tree

    names = []
    monkeypatch.setattr(tree, "written", lambda rows, name: names.append(name) or graph.written(rows, name))
    base = spark.createDataFrame([(f"n{i}", "d", 0, i, False, f"Text {i}.", [1.0, float(i)]) for i in range(6)], "node_id string, document_id string, layer int, chunk_index int, is_summary boolean, text string, embedding array<double>")
    made, edges = tree.build_tree(base, cluster=lambda nodes, entities, layer: nodes.select("document_id", "node_id", F.lit(0).alias("cluster")))
    assert made.count() == 7 and "graph" not in names and "layer1" in names
    assert edges.count() > 0


def test_communities_without_a_list_of_edges_agree_with_those_of_the_list(spark):
    from grovework.operators import cluster, graph

    rng = np.random.default_rng(7)
    nodes = [(f"n{k:03d}", "big" if k < 320 else f"small{k % 4}", 0, (rng.standard_normal(5) + 2 * np.eye(5)[k % 5]).tolist()) for k in range(340)]
    ents = [(n, str(name), 5, r) for n, *_ in nodes for r, name in enumerate(rng.choice([f"E{i}" for i in range(40)], 3, replace=False))]
    frame = spark.createDataFrame(nodes, "node_id string, document_id string, layer int, embedding array<double>")
    given = spark.createDataFrame(ents, "node_id string, name string, importance int, rank int")
    for least in (0.3, 0.8):
        want = sorted(map(tuple, cluster.communities(graph.pairwise(frame, least), frame).collect()))
        assert sorted(map(tuple, cluster.similar_communities(frame, least).collect())) == want
        assert len({c for d, _, c in want if d == "big"}) > 1
    want = sorted(map(tuple, cluster.communities(graph.combined_similarity(frame, given), frame).collect()))
    assert sorted(map(tuple, cluster.cluster_communities(frame, given).collect())) == want
    assert sorted(map(tuple, cluster.similar_communities(frame, 0.3, most_nodes=100).collect())) == sorted(map(tuple, cluster.communities(graph.pairwise(frame, 0.3), frame).collect()))


def test_descent_is_the_same_in_few_and_many_blocks_and_never_joins_pairs_with_vectors(spark, monkeypatch):
    """One block; vectors sent to all blocks; vectors sent where they are named. Nodes without vectors, copies, an empty table."""
    from grovework.operators import descent

    rng = np.random.default_rng(5)
    rows = [("a", f"n{k:03d}", v) for k, v in enumerate(rng.standard_normal((300, 5)).tolist())] + [("b", f"n{k:03d}", [1.0, float(k % 3), 0.0, 0.0, 1.0]) for k in range(40)]
    nodes = spark.createDataFrame([*rows, ("a", "none", None), ("c", "one", [1.0] * 5), ("d", "void", None)], "document_id string, node_id string, embedding array<double>")
    plans, keep = [], descent.written

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(descent, "written", spy)
    found = []
    for block, copies in ((16_384, 8), (64, 8), (64, 2)):
        monkeypatch.setattr(descent, "BLOCK", block, raising=False)
        monkeypatch.setattr(descent, "COPIES", copies, raising=False)
        near, compared = descent.descended(nodes, width=5, most=4, rounds=3)
        got = sorted((r.document_id, r.v, r.u, round(r.sim, 12)) for r in near.collect())
        assert compared > 0 and len({r[:3] for r in got}) == len(got)
        found.append(got)
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {"a", "b"}
    assert max(sum(r[:2] == ("a", v) for r in found[0]) for v in {r[1] for r in found[0]}) == 5
    rounds = [plan for name, plan in plans if name == "compared" and "FlatMapCoGroupsInArrow" in plan]
    assert len(rounds) == 9 and not any("zip_with" in plan for plan in rounds)
    assert descent.descended(nodes.limit(0))[0].count() == 0


@pytest.mark.parametrize("wide, tracked", [(1024, 8_000_000), (64, 900), (256, 3000), (16, 1)])
def test_communities_are_the_same_however_few_edges_are_weighed_again(monkeypatch, wide, tracked):
    """Many, few and no communities kept between rounds; copies, null vectors, entities, nodes apart from all."""
    import pyarrow as pa

    from grovework.operators import cluster, graph

    monkeypatch.setattr(cluster, "WIDE", wide)
    monkeypatch.setattr(cluster, "TRACKED", tracked)
    for seed in range(6):
        rng = np.random.default_rng(seed)
        n, groups = 300, int(rng.integers(2, 40))
        v = [(rng.standard_normal(6) + 2 * rng.standard_normal((groups, 6))[k % groups]).tolist() if seed % 2 else (rng.standard_normal(6) + 3 * np.eye(6)[k % 5]).tolist() for k in range(n)]
        v[7], v[8], v[9] = v[3], v[3], None
        kinds = [sorted(rng.choice(60, rng.integers(0, 6), replace=False).tolist()) + ([99] if k % 3 == 0 else []) for k in range(n)]
        unit = [None if x is None else (np.array(x) / np.linalg.norm(x)).tolist() for x in v]
        ids = [f"n{k:03d}" for k in range(n)]
        table = pa.table({"node_id": ids, "v": pa.array(unit, pa.list_(pa.float64())), "codes": pa.array(kinds, pa.list_(pa.int64())), "importances": pa.array([[1 + c % 9 for c in x] for x in kinds], pa.list_(pa.int32()))})
        may = cluster.coins(rng.integers(-(2**62), 2**62, (n, 3)), 12)
        for weigh, summed, least in ((pairs.cosine_only, True, 0.5), (graph.combined_weight, False, 0.3), (graph.edge_weight, True, 0.4)):
            side = pairs.Side.of(table, np.arange(n))
            full = np.array(pairs.weighed(side, side, weigh))
            np.fill_diagonal(full, -1.0)
            src, dst = np.nonzero(full > least)
            want = cluster.parts_of_one(cluster.Edges(src, dst, full[src, dst], n), may, 12, 1.0)
            assert len(np.unique(want)) > 1
            assert np.array_equal(cluster.parts_of_one(cluster.Weighed(side, weigh, least, summed), may, 12, 1.0), want)


def test_rounds_weigh_only_what_moved():
    """All pairs once were weighed in each round: some seventeen times."""
    import pyarrow as pa

    from grovework.operators import cluster

    rng = np.random.default_rng(2)
    n, weighed = 6000, []
    v = np.concatenate([np.eye(4)[np.arange(n) % 4], 0.1 * rng.standard_normal((n, 64))], axis=1)
    none = pa.array([[]] * n, pa.list_(pa.int64()))
    table = pa.table({"v": pa.array((v / np.linalg.norm(v, axis=1)[:, None]).tolist(), pa.list_(pa.float64())), "codes": none, "importances": none})

    def counted(cosine, *_):
        weighed.append(cosine.size)
        return cosine

    may = cluster.coins(rng.integers(-(2**62), 2**62, (n, 3)), 12)
    parts = cluster.parts_of_one(cluster.Weighed(pairs.Side.of(table, np.arange(n)), counted, 0.3), may, 12, 1.0)
    assert np.array_equal(parts, np.arange(n) % 4)
    assert sum(weighed) < 7 * n * n


def test_a_tree_weighs_no_importances_and_deals_documents_apart(spark, monkeypatch):
    """Trees once summed importances of all pairs that none of their weights reads, and dealt documents to as few tasks as other tables."""
    from grovework.operators import cluster

    plans, numbered = [], cluster.numbered
    monkeypatch.setattr(cluster, "numbered", lambda parts, nodes: plans.append(parts) or numbered(parts, nodes))
    asked = []
    monkeypatch.setattr(cluster, "_weighed_parts", lambda *a, _of=cluster._weighed_parts: asked.append(a[-1]) or _of(*a))
    nodes = spark.createDataFrame([(f"n{k}", f"doc{k % 10}", [1.0, float(k % 2)]) for k in range(60)], "node_id string, document_id string, embedding array<double>")
    given = spark.createDataFrame([(f"n{k}", "All", 5, 0) for k in range(60)], "node_id string, name string, importance int, rank int")
    assert cluster.cluster_communities(nodes, given).count() == 60 and asked == [False]
    tasks = plans[0].select("document_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r.task for r in tasks}) == 10
