"""Hand cases for text, chunking, entities, graph and retrieval rules."""

import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from grovework.functions import text as T
from grovework.functions.vectors import cosine
from grovework.operators import chunking, cluster, entities, graph, retrieval, tree
from grovework.sources import nodes as sources
from grovework.streaming import ingest


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expression.alias("x")).first().x


def test_sentences_and_references(spark):
    assert one(spark, T.split_sentences(F.col("t")), t=" A b.  C d!\n\nE? ") == ["A b.", "C d!", "E?"]
    assert one(spark, T.split_sentences(F.col("t")), t="") == []
    marks = "[IMAGE a1: x] [TABLE t1: y] [TABLE t2 : no] [IMAGE a2: z]"
    assert one(spark, T.references(F.col("t"), "IMAGE"), t=marks) == ["a1", "a2"]
    assert one(spark, T.references(F.col("t"), "TABLE"), t=marks) == ["t1"]
    assert one(spark, T.content_types(F.col("t")), t="plain") == ["text"]


@pytest.mark.parametrize("n, said", [(0, "0 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (5 * 1024**4, "5120 GB")])
def test_format_bytes(spark, n, said):
    assert one(spark, T.format_bytes(F.col("n")), n=n) == said


def test_zero_vector_has_cosine_zero(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0.0


def test_chunking_of_short_texts(spark):
    docs = spark.createDataFrame([("empty", ""), ("one", "Only this."), ("null", None), ("three", "A. B. C.")], "document_id string, text string")
    rows = {r.document_id: r.chunk for r in chunking.chunk_text(docs).collect()}
    assert rows == {"empty": "", "one": "Only this.", "null": "", "three": "A. B. C."}


def test_folds_and_overlap(spark):
    big = "x" * 2400
    groups, sims = ["a" * 40, "b" * 40, big, "c" * 40], [None, 0.9, 0.9, 0.1]
    folded = one(spark, chunking.fold_boundaries(F.col("g"), F.col("s")), g=groups, s=sims)
    assert folded == ["a" * 40 + " " + "b" * 40, big, "c" * 40]
    assert one(spark, chunking.merge_small(F.col("g")), g=["a", "b", "c" * 500, "d"]) == ["a b " + "c" * 500, "d"]
    assert one(spark, chunking.add_overlap(F.col("g"), 1), g=["abcdef", "ghijkl", "mn"]) == ["abcdef ... ghij", "cdef ... ghijkl ... mn", "ijkl ... mn"]


def test_entities_cut_before_length_filter(spark):
    rows = spark.createDataFrame([("n", "Ab Cd. Alpha Beta uses API and camelCase. API")], "node_id string, text string")
    found = {r.name: r for r in entities.extract_entities(rows).collect()}
    assert found["API"].importance == 5 and found["API"].type == "technology" and found["camelCase"].type == "technology"
    assert "Alpha Beta" in found and found["Alpha Beta"].type == "concept"


def test_query_entities_keep_capitalised_stopwords(spark):
    q = spark.createDataFrame([(1, "What is the Big Tree")], "query_id long, question string")
    assert [r.name for r in entities.query_entities(q).orderBy("pos").collect()] == ["Big", "Tree", "What", "Big Tree"]


def test_parse_entity_json_falls_back_to_null(spark):
    parse = entities.parse_entity_json(F.col("t"))
    assert one(spark, parse, t="not json") is None
    got = one(spark, parse, t='```json\n[{"name": " A ", "importance": 99}, {"type": "x"}]\n```')
    assert [(e.name, e.type, e.importance) for e in got] == [("A", "other", 10)]


def test_expand_takes_top_neighbours_before_dropping_seen(spark):
    edges = spark.createDataFrame([("d", "a", x, w) for x, w in (("b", 0.9), ("c", 0.8), ("e", 0.7), ("f", 0.6))] + [("d", "b", "a", 0.9), ("d", "b", "g", 0.5)], "document_id string, src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "d", "a"), (1, "d", "b")], "query_id long, document_id string, node_id string")
    assert {r.node_id for r in graph.expand(seeds, edges).collect()} == {"c", "e", "g"}


def test_dedupe_exempts_graph_only(spark):
    rows = spark.createDataFrame(
        [(1, "s", True, "tree", 1), (1, "a", False, "tree", 2), (1, "b", False, "graph", 3), (1, "c", False, "tree+graph", 4), (1, "s", True, "tree", 5)],
        "query_id long, node_id string, is_summary boolean, source string, rank int",
    )
    kids = spark.createDataFrame([("s", x) for x in "abc"], "parent_id string, child_id string")
    assert [r.node_id for r in retrieval.dedupe(rows, kids).orderBy("rank").collect()] == ["s", "b"]
    assert [r.node_id for r in retrieval.dedupe(rows, kids, v1=True).orderBy("rank").collect()] == ["s"]


def test_context_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, k, "x" * 2000, False, 0, "tree") for k in range(1, 5)], "query_id long, rank int, text string, is_summary boolean, layer int, source string")
    got = retrieval.build_context(rows, 700).first().context
    assert got.count("---") == 1 and got.endswith("...")


def test_tree_of_planted_groups(spark):
    import grovework.operators.cluster as cluster

    rows = [(f"n{k:02}", "d", 0, k, False, f"Topic {k % 2}. More {k}.", [1.0, 0.0, 0.01 * k] if k % 2 else [0.0, 1.0, 0.01 * k]) for k in range(8)]
    base = spark.createDataFrame(rows, "node_id string, document_id string, layer int, chunk_index int, is_summary boolean, text string, embedding array<double>")
    pairs = graph.pairwise(base).filter("sim > 0.3")
    found = {r.node_id: r.cluster for r in cluster.communities(pairs, base, rounds=6).collect()}
    assert len(found) == 8 and len({found[f"n{k:02}"] for k in range(0, 8, 2)}) == 1 and found["n00"] != found["n01"]
    by_parity = lambda nodes, ents, layer: nodes.select("document_id", "node_id", (F.col("chunk_index") % 2).alias("cluster"))
    made, _ = tree.build_tree(entities.with_entities(base), cluster=by_parity)
    kids = {r.node_id: r.child_ids for r in made.filter("layer = 1").collect()}
    assert len(kids) == 2 and sorted(sum(kids.values(), [])) == sorted(f"n{k:02}" for k in range(8))


def test_text_files_and_unknown_extension(spark, tmp_path):
    (tmp_path / "note.md").write_text("# Hi")
    assert sources.read_documents(spark, f"{tmp_path}/*.md").collect()[0].asDict() == {"document_id": "note", "text": "# Hi"}
    with pytest.raises(ValueError):
        sources.read_documents(spark, "x.xyz")


def test_stream_replaces_documents(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    write = lambda rows: spark.createDataFrame(rows, "document_id string, text string").write.mode("append").parquet(source)
    write([("a", "First text."), ("b", "Other.")])
    ingest.stream_ingest(spark, source, target, state).awaitTermination()
    write([("a", "Second text.")])
    ingest.stream_ingest(spark, source, target, state).awaitTermination()
    assert {(r.document_id, r.text) for r in ingest.current(spark, target).collect()} == {("a", "Second text."), ("b", "Other.")}


def test_entry_and_a_few_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    assert entry.entry(spark).count() > 0
    for name in ("b01_count_tokens", "c06_chunk_text", "e06_query_entities", "f04_top_neighbours", "j06_catalog_totals"):
        got = entry.queries()[name](spark, sf)
        rows = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
        want = con.sql(entry.oracle_sql()[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert rows == sorted(tuple(r[k] for k in order) for r in want.fetchall()), name


def exact_near(q, n, k=10):
    return {(r.query_id, r.node_id) for r in retrieval.ranked(retrieval.candidates(q, n), k, "distance", "node_id").collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_index_recall_on_the_given_vectors(spark, tmp_path, sf):
    """The given vectors have no clusters, so many cells are needed; few vectors are."""
    from grovework.operators import index
    from grovework.plans import views

    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    n = views.nodes(spark, sf).select("node_id", "document_id", "embedding")
    q = n.filter(F.crc32("node_id") % 23 == 0).select(F.col("node_id").alias("query_id"), "embedding", F.lit(None).cast("string").alias("document_id"))
    made = index.build(n, f"{tmp_path}/index")
    exact = exact_near(q, n)
    found = {(r.query_id, r.node_id) for r in index.search(q, made).collect()}
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)
    if sf.endswith("0.1"):
        assert 10 * 10 < 0.2 * n.count()  # vectors that each question reads


def test_index_reads_few_cells_where_vectors_cluster(spark, tmp_path):
    from grovework.operators import index

    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] * 3 + rng.standard_normal((3000, 16)) * 0.6
    rows = [(f"n{k:05d}", "d", v) for k, v in enumerate(x.tolist())]
    n = spark.createDataFrame(rows, "node_id string, document_id string, embedding array<double>")
    q = spark.createDataFrame([(k, x[k].tolist(), None) for k in range(0, 3000, 50)], "query_id long, embedding array<double>, document_id string")
    made = index.build(n.limit(2500), f"{tmp_path}/index")
    index.append(n.join(n.limit(2500), "node_id", "left_anti"), made)  # no rebuild
    made = index.load(spark, f"{tmp_path}/index")
    sizes = {r.cell: r["count"] for r in index.vectors_of(spark, made.path).groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 3000 == spark.read.parquet(f"{tmp_path}/index/codes").select(F.sum(F.size("ids"))).first()[0]
    read = [sum(sizes[c] for c in np.argsort(made.nearest(x[k : k + 1])[0])[: made.probes]) for k in range(0, 3000, 50)]
    assert np.mean(read) < 0.2 * 3000
    exact = exact_near(q, n)
    found = {(r.query_id, r.node_id) for r in index.search(q, made).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    plan = index.search(q, made)._jdf.queryExecution().toString()
    assert plan
    # more than the probed cells hold: answered exactly
    deep = index.search(q.limit(3), made, 400, probes=1)
    want = retrieval.ranked(retrieval.candidates(q.limit(3), n), 400, "distance", "node_id")
    assert {(r.query_id, r.node_id) for r in deep.collect()} == {(r.query_id, r.node_id) for r in want.collect()}


def test_pairs_in_blocks_equal_pairs_by_joins(spark):
    """One large document in many blocks, an entity on all its nodes, small ones besides."""
    from grovework.operators import pairs

    rng = np.random.default_rng(2)
    nodes = [(f"n{k:04d}", "big" if k < 300 else f"small{k % 20}", 0, rng.standard_normal(6).tolist()) for k in range(400)]
    nodes.append(("zero", "big", 0, [0.0] * 6))
    ents = [(n, name, "x", int(rng.integers(1, 11)), r) for n, *_ in nodes for r, name in enumerate({"All", *rng.choice([f"E{i}" for i in range(60)], 3).tolist()})][:-2]
    frame = spark.createDataFrame(nodes, "node_id string, document_id string, layer int, embedding array<double>").repartition(4)
    given = spark.createDataFrame(ents, "node_id string, name string, type string, importance int, rank int")
    unit = {n: np.array(v) / (np.linalg.norm(v) or 1) for n, _, _, v in nodes}
    of = {n: {} for n in unit}
    for n, name, _, importance, _ in ents:
        of[n][name.lower()] = importance
    want = {}
    for i, (a, doc, *_) in enumerate(nodes):
        for b, other, *_ in nodes[i + 1 :]:
            if doc == other:
                x, y = sorted((a, b))
                shared = of[a].keys() & of[b].keys()
                score = sum((of[a][e] + of[b][e]) / 2 for e in shared) / (10 * max(len(of[a]), len(of[b]), 1))
                jaccard = len(shared) / max(1, len(of[a].keys() | of[b].keys()))
                want[doc, x, y] = (unit[a] @ unit[b], score, unit[a] @ unit[b] + 1.5 * score, 0.7 * (unit[a] @ unit[b]) + 0.3 * jaccard)
    small = lambda f: (lambda *a, **b: f(*a, rows_each=40, **b))
    original = graph.weighed_pairs
    try:
        for form in (original, small(original)):
            graph.weighed_pairs = form
            got = {(r.document_id, r.a, r.b): r.sim for r in graph.pairwise(frame).collect()}
            assert got.keys() == want.keys() and all(abs(v - want[k][0]) < 1e-9 for k, v in got.items())
            got = {(r.document_id, r.src, r.dst): r.weight for r in graph.build_edges(frame, given).collect()}
            edges = {k: v[2] for k, v in want.items() if v[2] > 0.3}
            assert got.keys() == {(d, *p) for d, a, b in edges for p in ((a, b), (b, a))} and all(abs(v - edges[(k[0], *sorted(k[1:]))]) < 1e-9 for k, v in got.items())
            got = {(r.document_id, r.a, r.b): r.sim for r in graph.combined_similarity(frame, given).collect()}
            assert got.keys() == {k for k, v in want.items() if v[3] > 0.3} and all(abs(v - want[k][3]) < 1e-9 for k, v in got.items())
    finally:
        graph.weighed_pairs = original
    for rows in (1024, 30):
        got = {(r.document_id, r.a, r.b): r.score for r in graph.entity_overlap(given, frame, rows).collect()}
        assert got.keys() == {k for k, v in want.items() if v[1]} and all(abs(v - want[k][1]) < 1e-9 for k, v in got.items())
    assert pairs.cosine_only(np.eye(2)).shape == (2, 2)


def test_hooks_that_fail_cost_only_their_rows(spark):
    from grovework.operators import hooks

    def hook(frames):
        import pandas as pd

        for pdf in frames:
            if (pdf.node_id == "b").any():
                raise RuntimeError("model")
            pdf = pdf[pdf.node_id != "c"]  # no answer
            yield pd.DataFrame({"node_id": pdf.node_id, "text": pdf.text, "own": [[{"name": "Own", "type": "x", "importance": 3}]] * len(pdf)})

    nodes = spark.createDataFrame([(k, "The Alpha Beta") for k in "abcd"], "node_id string, text string").coalesce(1)
    made = entities.with_entities(nodes, hook, mark="failed")
    assert {r.node_id: (r.entity_names, r.failed) for r in made.collect()} == {k: ("Own", False) if k in "ad" else ("The Alpha Beta", True) for k in "abcd"}
    counts = hooks.failures(hooks.asked(nodes, hook, ["node_id"], {"text": "string"})).first()
    assert (counts.n, counts.n_failed) == (4, 2)
    empty = hooks.asked(nodes.limit(0), hook, ["node_id"], {"text": "string"})
    assert empty.count() == 0


def test_hops_with_a_generator(spark):
    def generator(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for q, context in zip(pdf.question, pdf.context):
                if q == "breaks":
                    raise ValueError
                deep = "third" in context
                out.append({"direct": "ANSWER: now ", "plain": "just so"}.get(q) or (f"ANSWER: {q}" if deep and q == "deep" else "forced" if q == "never" and "first" in context and "second" in context else "QUERY: more"))
            yield pd.DataFrame({"query_id": pdf.query_id, "response": out})

    texts = ["first", "second", "third", "fourth"]
    nodes = spark.createDataFrame([(f"n{k}", t, False, 0, [float(k)]) for k, t in enumerate(texts)], "node_id string, text string, is_summary boolean, layer int, embedding array<double>")
    asked = [(1, "direct"), (2, "plain"), (3, "deep"), (4, "never"), (5, "breaks")]
    questions = spark.createDataFrame([(k, q, [0.0], None) for k, q in asked], "query_id long, question string, embedding array<double>, document_id string")
    hop = []

    def search(now):
        hop.append(1)
        rows = now.join(nodes.filter(F.col("embedding")[0] < len(hop)).select("node_id", F.lit("tree").alias("source")), F.lit(True))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("node_id")))

    trace, told = retrieval.answered_hops(questions, nodes, search, generator)
    assert {r.query_id: (r.answer, r.hops, r.total_results) for r in told.collect()} == {1: ("now", 1, 1), 2: ("just so", 1, 1), 3: ("deep", 3, 3), 4: ("forced", 3, 3), 5: (None, 1, 1)}
    seen = sorted((r.query_id, r.hop, r["query"], r.results_found) for r in trace.collect())
    assert seen == [(1, 1, "direct", 1), (2, 1, "plain", 1), (3, 1, "deep", 1), (3, 2, "more", 1), (3, 3, "more", 1), (4, 1, "never", 1), (4, 2, "more", 1), (4, 3, "more", 1), (5, 1, "breaks", 1)]


def test_overlap_counts_names_whatever_their_case(spark):
    nodes = spark.createDataFrame([("a", "d"), ("b", "d")], "node_id string, document_id string")
    rows = [("a", "API", "x", 4, 1), ("a", "Api", "x", 8, 2), ("b", "api", "x", 6, 1), ("b", "Tree", "x", 5, 2)]
    entities_ = spark.createDataFrame(rows, "node_id string, name string, type string, importance int, rank int")
    # the last importance of `api` in a is 8; a has one distinct name, b has two
    assert graph.entity_overlap(entities_, nodes).first().score == pytest.approx(((8 + 6) / 2) / (10 * 2))


def test_questions_without_document_meet_all_nodes(spark):
    nodes = spark.createDataFrame([(f"n{k:02}", f"d{k % 3}", 0, [float(k), 1.0]) for k in range(30)], "node_id string, document_id string, layer int, embedding array<double>")
    questions = spark.createDataFrame([(1, "q", [4.2, 1.0], None), (2, "q", [7.0, 1.0], "d1"), (3, "q", [0.0, 1.0], "none")], "query_id long, question string, embedding array<double>, document_id string")
    got = retrieval.ranked(retrieval.candidates(questions, nodes), 3, "distance", "node_id").collect()
    assert sorted((r.query_id, r.rank, r.node_id) for r in got) == [(1, 1, "n04"), (1, 2, "n05"), (1, 3, "n03"), (2, 1, "n07"), (2, 2, "n04"), (2, 3, "n10")]


def test_rank_by_column_is_limited_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("x"), (F.col("id") % 3 + 1).alias("k"))
    top = retrieval.ranked(rows, F.col("k"), "x")
    assert {(r.query_id, r.x) for r in top.collect()} == {(0, 0), (1, 1), (1, 4), (2, 2), (2, 5), (2, 8)}
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_both_forms_of_communities_agree(spark):
    import numpy as np

    from grovework.operators import cluster

    r, rows = np.random.default_rng(4), []
    for d in range(4):
        for a in range(24):
            for b in range(a + 1, 24):
                if r.random() < (0.6 if a % 3 == b % 3 else 0.08):
                    rows.append((f"d{d}", f"n{a:02}", f"n{b:02}", float(r.random())))
    pairs = spark.createDataFrame(rows, "document_id string, a string, b string, sim double")
    nodes = spark.createDataFrame([(f"d{d}", f"n{k:02}") for d in range(5) for k in range(24)], "document_id string, node_id string")
    by_group = sorted(map(tuple, cluster.communities(pairs, nodes).collect()))
    by_joins = sorted(map(tuple, cluster.communities(pairs, nodes, most_edges=0).collect()))
    assert by_group == by_joins and len(by_group) == 120 and {c for d, _, c in by_group if d == "d4"} == {0}


def test_mixtures_and_reduced_vectors(spark):
    import numpy as np

    from grovework.operators import cluster

    r = np.random.default_rng(1)
    rows = [(f"n{k:03}", "d", [float(x) for x in r.normal(0, 0.1, 6) + 5 * np.eye(6)[k % 3]]) for k in range(90)]
    nodes = spark.createDataFrame(rows, "node_id string, document_id string, embedding array<double>")
    reduced = cluster.reduce_dimensions(nodes, 2).collect()
    for k in range(3):
        own = np.array([x.reduced.toArray() for x in reduced if int(x.node_id[1:]) % 3 == k])
        assert own.std(axis=0).max() < 0.5
    best, found = cluster.select_k(cluster.reduced_table(nodes, 2), 5)
    assert best == 3 and min(found, key=found.get) == 3
    for rows_ in (cluster.cluster_gmm(nodes, 3, dims=2), cluster.cluster_adaptive(nodes, None, method="mixture")):
        got = {x.node_id: x.cluster for x in rows_.collect()}
        assert len(got) == 90
    hard = {x.node_id: x.cluster for x in cluster.cluster_gmm(nodes, 3, dims=2).collect()}
    assert all(len({hard[f"n{k:03}"] for k in range(j, 90, 3)}) == 1 for j in range(3)) and len(set(hard.values())) == 3


def test_layer_keeps_its_invariants(spark):
    rows = [(f"n{k:02}", "d" if k < 9 else "e", 0, k, False, f"Topic {k % 3}. More.", [float(k % 3 == j) for j in range(3)]) for k in range(11)]
    base = spark.createDataFrame(rows, "node_id string, document_id string, layer int, chunk_index int, is_summary boolean, text string, embedding array<double>")
    made = tree.build_layer(entities.with_entities(base), 0).collect()
    assert {x.document_id for x in made} == {"d"} and all(x.layer == 1 and len(x.child_ids) >= 2 for x in made)
    kids = [c for x in made for c in x.child_ids]
    assert len(kids) == len(set(kids)) == 9 and [x.chunk_index for x in sorted(made, key=lambda x: x.chunk_index)] == list(range(len(made)))


def test_embedders(spark):
    import numpy as np

    from grovework.functions.vectors import letter_histogram
    from grovework.operators import embedding

    rows = spark.createDataFrame([("a", "red fox Red"), ("b", "red fox"), ("c", ""), ("d", None), ("e", "red fox red")], "node_id string, embed_text string")
    got = {x.node_id: np.array(x.embedding) for x in embedding.embed(rows).collect()}
    assert np.linalg.norm(got["b"]) == pytest.approx(1) and (got["a"] == got["e"]).all() and not got["c"].any() and not got["d"].any()

    def hook(frames):
        for pdf in frames:
            yield pdf.assign(embedding=[[float(len(t or "")), 1.0] for t in pdf.text])[["node_id", "embedding"]]

    assert {x.node_id: x.embedding for x in embedding.embed(rows, hook).collect()}["b"] == [7.0, 1.0]
    docs = spark.createDataFrame([("x", "One two. Three four. Five! Six? " * 40), ("y", "Éa ß. Zz."), ("z", "")], "document_id string, text string")
    by_column = sorted(map(tuple, chunking.chunk_text(docs, embed=letter_histogram).collect()))
    assert by_column == sorted(map(tuple, chunking.chunk_text(docs, spread=True).collect()))
    constant = chunking.chunk_text(docs, embed_groups=embedding.over_arrays(lambda texts: np.ones((len(texts), 2))))
    assert {x.document_id for x in constant.collect()} == {"x", "y", "z"}


def test_answers_with_and_without_generator(spark):
    questions = spark.createDataFrame([(1, "Why?"), (2, "Who?")], "query_id long, question string")
    results = spark.createDataFrame([(1, 1, "text", False, 0, "tree")], "query_id long, rank int, text string, is_summary boolean, layer int, source string")
    plain = {r.query_id: r for r in retrieval.answers(questions, results).collect()}
    assert plain[1].answer is None and plain[2].answer == retrieval.NO_RESULT and plain[2].context == "" and plain[1].n_sources == 1

    def hook(frames):
        for pdf in frames:
            yield pdf.assign(answer=" " + pdf.question + str(len(pdf)) + " ")[["query_id", "answer"]]

    told = {r.query_id: r.answer for r in retrieval.answers(questions, results, hook).collect()}
    assert told == {1: "Why?1", 2: retrieval.NO_RESULT}


def test_store_search_filters_tables(spark):
    nodes = spark.createDataFrame([(f"n{k}", "d", 0, [float(k)], k % 2 == 0, k % 3 == 0) for k in range(9)], "node_id string, document_id string, layer int, embedding array<double>, has_images boolean, has_tables boolean")
    questions = spark.createDataFrame([(1, "q", [0.0], "d")], "query_id long, question string, embedding array<double>, document_id string")
    assert [r.node_id for r in retrieval.store_search(questions, nodes, 2, content="table").orderBy("rank").collect()] == ["n0", "n3"]


def test_stream_keeps_the_latest_file_with_entities_and_vectors(spark, tmp_path):
    import os as os_
    import time

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, text in enumerate(("Zz old Text about API.", "An API and New Words.")):
        spark.createDataFrame([("a", text)], "document_id string, text string").coalesce(1).write.mode("append").parquet(source)
        for name in os_.listdir(source):
            if name.endswith(".parquet") and not (tmp_path / f"seen-{name}").exists():
                (tmp_path / f"seen-{name}").touch()
                at = time.time() - 1000 + 100 * k
                os_.utime(f"{source}/{name}", (at, at))
    ingest.stream_ingest(spark, source, target, state).awaitTermination()
    row = ingest.current(spark, target).collect()
    assert len(row) == 1 and row[0].text == "An API and New Words." and "API" in row[0].entity_names and sum(x * x for x in row[0].embedding) == pytest.approx(1)
    ingest.compact(spark, target, str(tmp_path / "compact"))
    assert ingest.current(spark, str(tmp_path / "compact")).count() == 1


def test_members_are_added_and_removed(spark):
    from grovework.operators import catalog

    schema = "id string, document_id string"
    members = spark.createDataFrame([("g", "a"), ("g", "b")], schema)
    more = catalog.add_members(members, spark.createDataFrame([("g", "b"), ("h", "a")], schema))
    assert sorted(map(tuple, more.collect())) == [("g", "a"), ("g", "b"), ("h", "a")]
    assert sorted(map(tuple, catalog.remove_members(more, spark.createDataFrame([("g", "a"), ("x", "y")], schema)).collect())) == [("g", "b"), ("h", "a")]


def test_descent_finds_the_nearest_with_far_fewer_comparisons(spark):
    from grovework.operators import descent

    rng = np.random.default_rng(0)
    rows = [("big", f"n{k:05d}", v) for k, v in enumerate(rng.standard_normal((2500, 6)).tolist())]
    rows += [("small", f"s{k}", v) for k, v in enumerate(rng.standard_normal((6, 6)).tolist())] + [("one", "o", [1.0] * 6)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id string, embedding array<double>")
    near, compared = descent.descended(nodes)
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    found = {(r.v, r.u) for r in near.withColumn("k", place).filter("k <= 10").collect()}
    exact = {(r.src, r.dst) for r in graph.top_neighbours(graph.mirrored(graph.pairwise(nodes).withColumnRenamed("sim", "weight")), 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and compared < 0.35 * 2500 * 2499 / 2
    assert {p for p in exact if p[0][0] == "s"} <= found and not any("o" in p for p in found)


@pytest.mark.parametrize("name", ["d04_pairwise_similarity", "f02_entity_overlap", "f03_build_edges", "f08_combined_similarity", "g01_communities", "h06_tree_stats"])
def test_documents_of_two_hundred_nodes_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    same = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    assert same(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == same(tuple(r[k] for k in order) for r in want.fetchall())


def test_few_and_many_questions_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    nodes = [(f"n{k:03d}", f"d{k % 4}", k % 3, f"text {k}", rng.integers(0, 3, 3).astype(float).tolist()) for k in range(200)]
    n = spark.createDataFrame(nodes, "node_id string, document_id string, layer int, text string, embedding array<double>")
    q = spark.createDataFrame([(k, "q", rng.standard_normal(3).tolist(), "d1" if k % 2 else None) for k in range(12)], "query_id long, question string, embedding array<double>, document_id string")
    rows = lambda: sorted((r.query_id, r.node_id, r.text, r.rank) for r in retrieval.layer_search(q, n, 1, 4).collect())
    small = rows()
    assert retrieval.few(q) and not retrieval.few(q, 100) and len(small) == 48
    monkeypatch.setattr(retrieval, "few", lambda questions: False)
    assert rows() == small
    plan = retrieval.layer_search(q, n, 1, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    assert retrieval.layer_search(q.limit(0), n, 1).count() == 0


def test_a_mixture_stands_in_where_communities_fail(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = spark.createDataFrame([("d", f"n{k}", rng.standard_normal(3).tolist()) for k in range(40)], "document_id string, node_id string, embedding array<double>")

    def fails(*_):
        raise ValueError("no graph")

    monkeypatch.setattr(cluster, "cluster_communities", fails)
    with pytest.warns(UserWarning):
        made = cluster.cluster_adaptive(n, None)
    assert {r.node_id for r in made.collect()} == {f"n{k}" for k in range(40)}


def test_hops_read_texts_to_their_end(spark, monkeypatch):
    """Contexts once were of the first 20 characters of each text."""
    from grovework.plans import queries

    texts = [f"text {k} " + "x" * 40_000 + f" end {k}" for k in range(3)]
    rows = spark.createDataFrame([(1, k + 1, t, False, 0, "tree") for k, t in enumerate(texts)], "query_id long, rank int, text string, is_summary boolean, layer int, source string")
    assert retrieval.build_context(rows, None).first().context == "\n---\n".join(f"[Chunk - Layer 0 - Source: tree]\n{t}\n" for t in texts)
    assert "end 1" not in retrieval.build_context(rows).first().context

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    contexts, original = [], queries.R.build_context
    monkeypatch.setattr(retrieval, "build_context", lambda found, *a: contexts.append((found, a)) or original(found, *a))
    assert queries.QUERIES["i16_answered_hops"](spark, sf).count() > 0
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert contexts and all(a == (None,) for _, a in contexts)
    first = contexts[0][0].select("node_id", "text").collect()
    assert max(len(r.text) for r in first) > 20 and all(r.text == whole[int(r.node_id)] for r in first)


def test_a_failure_of_communities_shows(spark, monkeypatch):
    """A mixture that stood in once looked like communities, in the query too."""
    from grovework.plans import queries

    n = spark.createDataFrame([("d", f"n{k}", [1.0, float(k % 2)]) for k in range(8)], "document_id string, node_id string, embedding array<double>")
    none = spark.createDataFrame([], "node_id string, name string, type string, importance int, rank int")
    assert {r.method for r in cluster.cluster_adaptive(n, none).collect()} == {"communities"}

    def fails(*_):
        raise ValueError("no graph")

    monkeypatch.setattr(cluster, "cluster_communities", fails)
    with pytest.warns(UserWarning):
        assert {r.method for r in cluster.cluster_adaptive(n, none).collect()} == {"mixture"}
    with pytest.raises(ValueError, match="no graph"):
        cluster.cluster_adaptive(n, none, stand_in=False)
    if os.path.isdir("/root/testdata/sf0.001"):
        with pytest.raises(ValueError, match="no graph"):
            queries.QUERIES["g07_cluster_adaptive"](spark, "/root/testdata/sf0.001")
