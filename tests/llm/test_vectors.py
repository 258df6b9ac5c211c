"""Whitening and hard negatives: whole tables against numpy, and made rows."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovework.llm import hardneg, qd, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, X string, component int"


@pytest.mark.parametrize(
    "matrix",
    [
        np.triu(np.random.default_rng(0).standard_normal((64, 64))),
        np.eye(7),
        np.diag([1.0, 1, 1, 2, 2, 3]),
        np.ones((6, 6)),
        np.zeros((4, 4)),
        np.array([[3.0]]),
        np.diag(10.0 ** -np.arange(12)) @ np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))[0],
        np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.full(20, 0.5), 1),
    ],
)
def test_qd_values_and_vectors(matrix):
    squares, vectors = qd.principal(matrix, len(matrix))
    true = np.linalg.svd(matrix)[1] ** 2
    assert len(squares) == (true > 1e-24 * true[0]).sum() if true[0] else len(squares) == 0
    if len(squares):
        assert np.abs(squares - true[: len(squares)]).max() < 1e-13 * true[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(squares))).max() < 1e-12
        assert np.abs(matrix.T @ (matrix @ vectors) - vectors * squares).max() < 1e-13 * true[0]


def test_dqds_is_accurate_for_small_values():
    a, b = 10.0 ** -np.arange(0.0, 16, 2), 10.0 ** -np.arange(1.0, 15, 2)
    from fractions import Fraction  # exact determinant: product of the squares is that of a^2

    product = math.prod(Fraction(float(x)) ** 2 for x in a)
    assert abs(math.prod(Fraction(float(x)) for x in qd.dqds(a, b)) / product - 1) < 1e-13


def brute_whitening(rows):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, total))) for r in x]
    centred = np.array([[float(a * n - s) / n for a, s in zip(r, total)] for r in x])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:32]
    return n, deviation, centred @ vectors[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_op11_equals_numpy(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    n, deviation, white, explained = brute_whitening(rows)
    got = queries.op11_qd_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = got.collect()
    assert len(got) == 32 * len(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    found = np.zeros_like(white)
    for r in got:
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-10 and r.identity_error < 1e-9
        found[at[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-8


def made(spark, tmp_path, rows, name="embeddings"):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_op11_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.standard_normal(6)], 1, "x", 1) for k in range(40)]
    good += [(3, good[0][1], 1, "x", 1), (None, good[1][1], None, None, None)] + [(99, good[2][1], 2, "x", 1)] * 20
    bad = [(500, None, 1, "x", 1), (501, [1.0, None, 1.0, 1.0], 1, "x", 1), (502, [1.0, float("nan"), 1.0], 1, "", 1), (503, [float("inf")] * 6, 1, "x", 1), (504, [], 1, "x", 1), (505, [1.0], 1, "x", 1), (506, [1e30] * 6, 1, "x", 1)]
    got = queries.op11_qd_whitening(spark, made(spark, tmp_path, good + bad)).collect()
    assert collections.Counter(r.vec_id for r in got) == collections.Counter(i for i, *_ in good for _ in range(6))
    n, deviation, white, explained = brute_whitening([(r[0], np.float32(r[1])) for r in good])
    assert {(r.vec_id, r.deviation) for r in got} == {(i[0], d) for i, d in zip(good, deviation)}
    assert sorted(round(abs(r.whitened), 7) for r in got) == pytest.approx(sorted(np.abs(white).ravel().round(7).tolist()), abs=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x", 1)], [(1, [1.0, 2.0], 1, "x", 1)], [(k, [1.0, 2.0], 1, "x", 1) for k in range(5)], [(1, [], 1, "", 1)]])
def test_op11_without_directions(spark, tmp_path, rows):
    assert queries.op11_qd_whitening(spark, made(spark, tmp_path, rows)).count() == 0


def test_op11_constant_dimension_and_large_deviations(spark, tmp_path):
    got = queries.op11_qd_whitening(spark, made(spark, tmp_path, [(k, [float(k % 5), 7.0, float(k % 3)], 1, "x", 1) for k in range(30)])).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    wide = spark.createDataFrame([(k, [k * 10**9, -k * 10**9]) for k in range(8)], "i long, x array<long>")
    found = {r.i: int(r.deviation) for r in whitening.whitened(wide, "i", "x").collect()}
    assert found == {k: 2 * (8 * k * 10**9 - 28 * 10**9) ** 2 for k in range(8)}


def test_tree_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64)).alias("x")).repartition(9)
    few = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(rows.coalesce(1), "vec_id", "x").collect()}
    for r in whitening.whitened(rows, "vec_id", "x").collect():
        assert abs(abs(r.whitened) - abs(few[r.vec_id, r.component])) < 1e-9


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    rows = [(i, label, np.array(v, dtype=object)) for i, label, v in rows]
    order = lambda s: (-s[1], s[0] is None, s[0] or 0)
    out = []
    for i, label, u in {(i, label, tuple(v)) for i, label, v in rows if i is not None and is_anchor(i)}:
        u = np.array(u, dtype=object)
        scored = [(j, int(u @ v), other) for j, other, v in rows if j != i]
        for p, ps, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fit = sorted((s for s in scored if s[2] != label and 50 * ps <= 100 * s[1] <= 95 * ps), key=order)[:negatives]
            out += [(i, p, rank, j, ps, s) for rank, (j, s, _) in enumerate(fit, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "crowd", "large"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n, d = 400, 8
    x = rng.standard_normal((n, d)) * 60
    if kind == "clustered":
        x = rng.standard_normal((6, d))[rng.integers(0, 6, n)] * 200 + rng.standard_normal((n, d)) * 15
    if kind == "crowd":
        x[: n // 2] = x[0]
    x = np.floor(x * (10**6 if kind == "large" else 1)).astype(int)
    rows = [(int(k), int(rng.integers(0, 3)), x[k].tolist()) for k in range(n)]
    rows += [(None, 1, x[3].tolist()), (7, 2, x[9].tolist()), (14, 0, x[1].tolist()), (14, 0, x[1].tolist()), (21, rows[21][1], x[2].tolist()), (5000, 1, [0] * d)]
    odd = [(6000, None, x[0].tolist()), (7000, 1, None), (14000, 1, [5])]
    frame = spark.createDataFrame(rows + odd, "id long, label int, vec array<long>").repartition(5)
    got = hardneg.hard_negatives(frame, F.col("id") % 7 == 0, page_rows=20, chunk_rows=16, clusters=5)
    assert collections.Counter(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 7 == 0)


def test_walks_end_early_and_stay_exact(spark, monkeypatch):
    """Where anchors lie close together, few pages are read."""
    rng = np.random.default_rng(8)
    place = np.eye(4)[rng.integers(0, 4, 2000)]
    x = np.floor((place + rng.standard_normal((2000, 4)) * 0.02) * 1000).astype(int)
    rows = [(k, k % 3, x[k].tolist()) for k in range(2000)]
    read = []
    page_of = hardneg.walked_page
    monkeypatch.setattr(hardneg, "walked_page", lambda open_, chunks, *more: read.append(chunks.count()) or page_of(open_, chunks, *more))
    frame = spark.createDataFrame(rows, "id long, label int, vec array<long>")
    got = hardneg.hard_negatives(frame, F.col("id") % 50 == 0, low=80, high=99, page_rows=16, chunk_rows=32)
    want = collections.Counter()
    for i, _, u in rows[::50]:
        scored = sorted(((-int(np.dot(u, v)), j, label) for j, label, v in rows if j != i))
        for ps, p, _ in [s for s in scored if s[2] == i % 3][:5]:
            fit = [s for s in scored if s[2] != i % 3 and 80 * -ps <= 100 * -s[0] <= 99 * -ps][:3]
            want.update((i, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(fit, 1))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert len(read) < 10


@pytest.mark.parametrize("rows", [[], [(50, 1, None)], [(50, 1, [1, 2])], [(50, 1, [0, 0]), (51, 1, [0, 0]), (52, 2, [0, 0])], [(1, 1, [1, 2]), (2, 1, [1, 2])]])
def test_hard_negatives_small(spark, rows):
    got = hardneg.hard_negatives(spark.createDataFrame(rows, "id long, label int, vec array<long>"), F.col("id") % 50 == 0)
    assert collections.Counter(map(tuple, got.collect())) == brute_negatives([r for r in rows if r[2]], lambda i: i % 50 == 0)


def test_vectors_of_any_width_join_into_chunks():
    rng = np.random.default_rng(8)
    for most, size in ((100, 3), (2**20, 3), (2**14, 0)):
        x, y = rng.integers(-100, 100, (5, size)), rng.integers(-most, most, (7, size))
        both = hardneg.joined(hardneg.packed_rows(x) + hardneg.packed_rows(y), size)
        assert np.array_equal(hardneg.unpacked(both, 12, size), np.vstack([x, y]))


def test_vectors_without_entries_all_score_zero(spark):
    rows = [(50, 1, []), (51, 1, []), (52, 2, []), (53, 2, [])]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, "id long, label int, vec array<long>"), F.col("id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == [(50, 51, 1, 52, 0, 0), (50, 51, 2, 53, 0, 0)]


def test_op12_contract_and_odd_rows(spark, tmp_path):
    assert queries.op12_shared_lists(spark, SF).dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    rng = np.random.default_rng(4)
    rows = [(k, np.float32(rng.standard_normal(5)).tolist(), k % 10, "x", 1) for k in range(300)]
    odd = [(350, None, 1, "x", 1), (400, [1.0, None, 1.0, 1.0, 1.0], 1, "x", 1), (450, [float("nan")] * 5, 2, "x", 1), (500, [1.0] * 5, None, None, None)]
    relabelled = [(k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * c) for c in v]) for k, v, label, *_ in rows]
    got = queries.op12_shared_lists(spark, made(spark, tmp_path, rows + odd))
    assert collections.Counter(map(tuple, got.collect())) == brute_negatives(relabelled, lambda i: i % 50 == 0)
