"""Tensored banding against brute force."""

import collections
import random
import re

import numpy as np

from grovework.llm import queries, tensored
from grovework.llm.nearcopies import shingles

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words_of(text):
    words = WORD.findall((text or "").translate(ASCII))
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    """Counter of (id, set size, component) of all rows (id, text)."""
    sets = [words_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)] += [] if i is None else [i]
    return collections.Counter((i, len(sets[k]), (min(least[find(k)], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def some_words(rng, n):
    return " ".join(rng.choice("alpha beta Gamma delta épsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    rows, base = [], some_words(rng, 120)
    for k in range(120):
        rows.append((k, some_words(rng, rng.choice([1, 2, 3, 5, 40, 200]))))
    rows += [(1000 + k, base) for k in range(150)]  # a third of all rows are one text
    rows += [(2000 + k, changed(rng, base, rng.choice([1, 2, 3, 4]))) for k in range(80)]
    chain = base
    for k in range(12):  # alike step by step, but not from end to end
        chain = changed(rng, chain, 2)
        rows.append((3000 - k, chain.upper() if k % 2 else chain.replace(" ", "\n\t")))
    passage = some_words(rng, 60)
    rows += [(4000 + k, f"{passage} {some_words(rng, 20)}") for k in range(60)]  # share most, alike or not
    rows += [(None, base), (None, "  \n"), (7, None), (8, ""), (8, ""), (None, some_words(rng, 9)), (9, "one two three"), (10, "One  TWO three"), (10, "One  TWO three")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, size int").repartition(5)
    for block in (1024, 8):
        got = tensored.tensored_components(frame, block=block)
        assert collections.Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)


def test_op13_contract_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_tensored(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")] and got.count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op13_tensored(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_pair_of_half_keys_is_met_at_the_stated_rate():
    rng, hits, alike = np.random.default_rng(0), 0, []
    for _ in range(300):
        both, only = rng.integers(1, 2**63, 240, dtype=np.uint64), rng.integers(1, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, only[:30]])), np.unique(np.concatenate([both, only[30:]]))
        alike.append(tensored.common(a, b) / len(np.union1d(a, b)))
        hits += (tensored.half_keys(a) == tensored.half_keys(b)).sum() >= 2
    assert abs(np.mean(alike) - 0.8) < 1e-9 and hits >= 298


def test_block_links_lose_no_component():
    rng = random.Random(2)
    base = some_words(rng, 80)
    texts = [changed(rng, base, rng.choice([0, 1, 2, 5, 12])) for _ in range(60)]
    sets = [shingles(t, 4) for t in texts]
    root = list(range(60))
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in tensored.block_links(list(range(60)), list(range(60)), sets, 80):
        assert tensored.alike(tensored.common(sets[a], sets[b]), len(sets[a]), len(sets[b]), 80) and find(a) != find(b)
        root[find(a)] = find(b)
    for a in range(60):
        for b in range(a):
            assert not tensored.alike(tensored.common(sets[a], sets[b]), len(sets[a]), len(sets[b]), 80) or find(a) == find(b)
