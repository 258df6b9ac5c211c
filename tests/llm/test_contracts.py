"""Registered queries as a whole: columns, rows, and results against brute force."""

import collections
import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovework.llm import bpe, curriculum, fingerprint, html_layout, langid, queries, simhash, toxicity, weakrules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CONTRACTS = {
    "op1_weighted_sampling": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_curriculum": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_hyperdimensional": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_weak_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_counterfactual": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, docs, name):
    got = queries.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    for column in CONTRACTS[name].split(", "):
        field, kind = column.split(" ")
        assert kinds[field] == kind, column
    assert collections.Counter(r.doc_id for r in got.select("doc_id").collect()) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_op1_values(spark, texts):
    order = sorted(texts, reverse=True)
    sign = lambda t: fingerprint.text_signature(t)
    for r in queries.op1_weighted_sampling(spark, SF).collect():
        following = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        own, changed = sign(texts[r.doc_id]), sign(fingerprint.edited(texts[r.doc_id], following))
        assert r.fingerprint == own.astype(">u2").tobytes().hex() and r.edited_fingerprint == changed.astype(">u2").tobytes().hex()
        assert r.near_edited == fingerprint.likeness(own, changed) and r.near_next == fingerprint.likeness(own, sign(following))


def test_shingle_hashes_tell_shingles_apart_whatever_the_block():
    text = "The quick  brown\tfox the quick brown fox The QUICK brown fox\njumps ünï " * 40
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 5]) for k in range(len(words) - 4)]
    hashes, ends = fingerprint.shingle_hashes(text.encode(), 5)
    assert len(set(zip(shingles, hashes.tolist()))) == len(set(shingles)) == len(set(hashes.tolist())) and len(hashes) == len(shingles)
    for block in (1, 7, 100):
        again = fingerprint.shingle_hashes(text.encode(), 5, block)
        assert (again[0] == hashes).all() and (again[1] == ends).all()


def test_pairs_are_the_same_however_rows_are_dealt(spark):
    """A third of the rows has one id, others have none; the order is known."""
    import xxhash

    rows = [(7, f"hot {k} " + "word " * (k % 5)) for k in range(300)] + [(7, "hot 1 word ")] * 30 + [(None, f"none {k}") for k in range(150)]
    rows += [(1000 + k, f"after {k} some more words") for k in range(200)] + [(-k, f"before {k} some more words") for k in range(1, 201)] + [(5, None), (5, ""), (2**60, "x y"), (2**60 + 1, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 33
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1]), r[1]))
    sha = lambda own, following: hashlib.sha256(fingerprint.edited(own, following).encode()).hexdigest()
    want = collections.Counter((i, sha(t, following[1])) for (i, t), following in zip(order, [*order[1:], order[0]]))
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, hot in ((1, 1024), (8, 40), (64, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = fingerprint.fingerprint_pairs(frame.repartition(5).withColumns({"u": F.lit(1), "bucket": F.lit(2), "t": F.lit(3)}), hot_rows=hot).collect()
            assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want
            seen.append(collections.Counter(map(tuple, got)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def naive_simhash(text):
    import xxhash

    words = [w.decode() for w in (text or "").encode().lower().split()]
    found = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3_against_brute_force(spark, texts):
    value = {i: naive_simhash(t) for i, t in texts.items()}
    ids, label = sorted(texts), {i: i for i in texts}
    moved = True
    while moved:
        new = {i: min(label[j] for j in ids if (value[i] ^ value[j]).bit_count() <= 4) for i in ids}
        moved, label = new != label, new
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()} == {(i, f"{value[i]:016x}", label[i]) for i in ids}


def test_op4_positions_and_hot_ids(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k} " + "w " * (k % 11), "en", "ab"[k % 4 == 0], 1) for k in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"mix_size": F.lit("mine"), "mix_order": F.lit(1)})
    found = curriculum.mixed(frame)
    assert found.columns == [*frame.columns, *("_mix_" + x for x in ("size", "source_size", "target", "taken", "positions"))]
    by = collections.defaultdict(int)
    pieces = collections.defaultdict(list)
    for r in found.collect():
        by[r.source, r._mix_target] += r._mix_taken
        n = len(WORD.findall(r.text))
        assert r._mix_size == n and len(r._mix_positions) == -(-r._mix_taken // n)
        pieces[r.source] += [round(p, 9) for p in r._mix_positions]
    assert all(abs(taken - target) <= 1 for (_, target), taken in by.items())
    for own in pieces.values():  # one position for each start in the stream
        assert len(set(own)) == len(own)
    spread = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in spread) < 600
    ordered = curriculum.training_order(frame)
    assert ordered.columns == frame.columns and [tuple(r) for r in ordered.collect()] == [tuple(r) for r in ordered.collect()]


def random_page(r: random.Random) -> tuple[str, list[str]]:
    """A page with end tags left out where HTML allows it, and the words a reader sees."""
    number = iter(range(100_000))

    def word():
        return f"w{next(number)}"

    def inline(seen, depth):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.5 or depth > 3:
                own = word()
                seen.append(own)
                out.append(own)
            elif kind < 0.7:
                tag = r.choice(["b", "i", "a href=/x/", 'span class=hidden title="a > b"', "em"])
                out.append(f"<{tag}>{inline(seen, depth + 1)}</{tag.split()[0]}>")
            elif kind < 0.8:
                out.append(f"<b hidden>{word()}</b><script>var a='<p>{word()}';</script><!-- {word()} <p> -->")
            elif kind < 0.9:
                out.append(f"<img alt={word()}><br>")
            else:
                out.append(f"<i style='display: none'>{word()}<u>{word()}</u></i>")
        return " ".join(out)

    def block(seen, depth):
        kind = r.randint(0, 5) if depth < 3 else 0
        if kind <= 1:
            return f"<p>{inline(seen, 0)}" + r.choice(["", "</p>"])
        if kind == 2:
            return "<ul>" + "".join(f"<li>{inline(seen, 0)}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 4))) + "</ul>"
        if kind == 3:
            return f"<div>{block(seen, depth + 1)}{block(seen, depth + 1)}</div>"
        if kind == 4:
            return f"<div hidden>{block([], depth + 1)}</div><h2>{inline(seen, 0)}</h2>"
        rows, out = r.randint(1, 4), []
        for _ in range(rows):
            cells = "".join(f"<td{r.choice(['', ' colspan=2', ' rowspan=\"2\"'])}>{inline(seen, 2)}" + r.choice(["", "</td>"]) for _ in range(r.randint(1, 4)))
            out.append(f"<tr>{cells}" + r.choice(["", "</tr>"]))
        return "<table>" + "".join(out) + "</table>"

    seen: list[str] = []
    head = r.choice(["", f"<head><title>{word()}</title>", f"<head><meta charset=utf-8><style>{word()}</style></head>", f"<html><head><title>{word()}</title><body class=x>"])
    return head + "".join(block(seen, 0) for _ in range(r.randint(1, 6))), seen


def test_html_random_pages_show_the_words_a_reader_sees():
    r = random.Random(5)
    for _ in range(1500):
        page, seen = random_page(r)
        got = html_layout.text_of(page).split()
        assert sorted(w for w in got if w != "-") == sorted(seen), page
        if "<td" not in page:  # wrapped cells of a row interleave
            assert [w for w in got if w != "-"] == seen, page


def test_html_head_spans_and_time():
    shown = html_layout.text_of
    assert shown("<head><title>T</title><body>hello <a href=x>link</a>") == "hello link"
    assert shown("<head><title>T</title>hello <b>x</b>") == "hello x" and shown("<p>a<head><p>b") == "a\n\nb"
    assert shown("a < b <3 </> <!doctype x><?x y?>c</p>d") == "a < b <3 cd" and shown("<object>fallback</object>") == "fallback"
    lines = shown("<table><tr><th colspan=2>Wide head<th>C<tr><td rowspan=2>a<td>b<td>c<tr><td>bb<td>cc</table>").split("\n")
    assert lines[0].index("C") == lines[1].index("c") == lines[2].index("cc") and lines[1].index("b") == lines[2].index("bb")
    assert shown('x<p title="never ends>y</p>z') == "x" and shown("x<a b=1 y") == "x"
    for unit in ("<a ", "<", "<a href='", "<!--", "<td rowspan=9 colspan=9>a<tr>", "<b>x", "</", "<table><tr><td>x", "<a b='c'", "<title>x"):
        began = time.time()
        shown(unit * 50_000)
        assert time.time() - began < 60, unit


def test_html_query_keeps_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op6_html_layout(spark, SF).collect()
    assert {r.page_id for r in rows} == set(pages) and all(r.text == html_layout.text_of(pages[r.page_id]) for r in rows)
    empty = html_layout.extract(spark.createDataFrame([], "page_id long, html string, text string"), keep=("page_id",))
    assert empty.count() == 0


def test_language_of_long_texts_in_bounded_memory():
    r = np.random.default_rng(0)
    text = "".join(map(chr, r.integers(0x4E00, 0x4E00 + 4000, 400_000)))
    tracemalloc.start()
    whole = langid.bundles([text, "abc"], 512, 3, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000 and np.abs(whole).sum() > 0
    short = "the quick brown fox " * 30
    cut = langid.bundles([short], 512, 3, 7, most=100)[0]
    assert (langid.bundles([short], 512, 3, 7)[0] @ cut) / np.linalg.norm(cut) ** 2 == pytest.approx(1, abs=0.05)


def test_bundles_are_the_sum_of_bound_letters():
    text = "ab cab"
    letters = f" {text} "
    want = np.zeros(512)
    for k in range(len(letters) - 2):
        parts = [np.roll(langid.letter_vector(ord(c), 512, 7).astype(int), 2 - j) for j, c in enumerate(letters[k : k + 3])]
        want += parts[0] * parts[1] * parts[2]
    assert (langid.bundles([text], 512, 3, 7)[0] == want).all()


def test_op7_held_out_accuracy(spark):
    rows = queries.op7_hyperdimensional(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    found = rows.filter("held_out and lang is not null").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first().x
    assert found > 0.95


def test_op8_verdict_is_the_posterior(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = weakrules.quality(docs.withColumns({"q_kept": F.lit("mine"), "v_lines": F.lit(9)}))
    assert {"q_kept", "v_lines", "_q_kept", "_q_good"} <= set(found.columns)
    votes = found.withColumnsRenamed({f"_q_{x}": f"r_{x}" for x in ("n_words",)})
    for r in votes.collect():
        assert r._q_kept == (not r._q_base_failed and r._q_good >= 0.5) and r.q_kept == "mine"


def test_op8_equals_an_independent_em(spark):
    """EM over documents, one by one, instead of vote patterns."""
    found = weakrules.quality(spark.read.parquet(f"{SF}/documents.parquet"))
    own = weakrules.rules()
    rows = found.select("q_good", *(c.cast("double").alias(r) for r, c in own.items())).toPandas()
    votes = rows[[*own]].to_numpy()
    bad, on_bad, on_good = 0.1, np.full(len(own), 0.4), np.full(len(own), 0.05)

    def posterior():
        like = lambda rate: np.where(votes == -1, rate, np.where(votes == 1, 1 - rate, 1.0)).prod(axis=1)
        ill, good = bad * like(on_bad), (1 - bad) * like(on_good)
        return ill / (ill + good)

    for _ in range(30):
        p = posterior()
        share = lambda weight, start: ((weight[:, None] * (votes == -1)).sum(axis=0) + start) / ((weight[:, None] * (votes != 0)).sum(axis=0) + 1)
        good = share(1 - p, 0.05)
        ill, now = np.maximum(share(p, 0.4), good), (p.sum() + 0.1) / (len(p) + 1)
        moved = max(abs(now - bad), np.abs(ill - on_bad).max(), np.abs(good - on_good).max())
        bad, on_bad, on_good = now, ill, good
        if moved < 1e-4:
            break
    assert np.abs(rows.q_good.to_numpy() - (1 - posterior())).max() < 1e-6


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    rows = [(1, "a text of some words that repeats", lang, s, 1) for lang, s in (("de", "B"), ("en", "A"), ("de", "A"))]
    for order in (rows, rows[::-1]):
        kept = simhash.first_of_each(spark.createDataFrame(order, SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.col("lang")))).collect()
        assert [(r.lang, r.source) for r in kept] == [("de", "A")]


def test_op9_learns_from_pairs_and_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    repeated = docs.unionByName(docs.filter("doc_id < 50")).unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(500).drop("id")))
    model = toxicity.learn(repeated, labels, ~queries.fifth())
    assert model.pairs > 100
    rows = queries.op9_counterfactual(spark, sf).join(labels.filter("toxic is not null"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93 and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_op10_equals_the_library(spark, texts):
    hf = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.bpe_path())
    for r in queries.op10_bpe(spark, SF).collect():
        ids = hf.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_words_equal_the_library():
    hf = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.bpe_path())
    coder, r = bpe.Tokenizer(queries.bpe_path(), cache_words=5000), random.Random(3)
    parts = ["the", "ing", "tion", "é", "ß", "日", "a", "b", "xy", "Q", "00", "7", "'s", "-", "ñ"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 8))) for _ in range(100_000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    assert all(np.array(hf.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == b for t, b in zip(texts, coder.encode_batch(texts)))
    two = bpe.Tokenizer(queries.bpe_path(), id_bytes=2)
    assert two.decode_batch(two.encode_batch(texts[:50])) == texts[:50]


def brute_groups(rows):
    """Components of similarity 0.8 over five-word shingles; rows: (id, text)."""
    cut = lambda t: frozenset(tuple(w[k : k + 5]) for w in [(t or "").encode().lower().split()] for k in range(max(1, len(w) - 4)) if w)
    sets = [cut(t) for _, t in rows]
    label = list(range(len(rows)))
    like = lambda a, b: a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    near = [[j for j in range(len(rows)) if like(sets[i], sets[j])] for i in range(len(rows))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(rows))]
        if new == label:
            return label
        label = new


def test_near_dedup_against_brute_force_in_any_order(spark):
    r = random.Random(8)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 80))] for _ in range(25)]
    rows = []
    for k in range(220):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = f"x{r.randint(0, 30)}"
        rows.append((r.choice([None, 7, k, k]), " ".join(words)))
    rows += [(3, ""), (4, None), (5, " \t"), rows[0], rows[1]]
    group = brute_groups(rows)
    for order in (rows, rows[::-1]):
        kept = simhash.first_of_each(spark.createDataFrame(order, "doc_id long, text string").withColumn("__id", F.lit(1))).collect()
        assert all(x["__id"] == 1 for x in kept)
        place = {row: g for row, g in zip(rows, group)}
        found = collections.Counter(place[x.doc_id, x.text] for x in kept)
        assert found == collections.Counter(set(group))


def test_open_buckets_are_searched_in_blocks(spark):
    """A crowd in which only a chain of neighbours is alike, whatever the block."""
    from grovework.llm.nearcopies import near_copies

    words = [f"w{k}" for k in range(260)]
    rows = [(k, " ".join(words[k : k + 200])) for k in range(0, 60, 3)]
    rows += [(1000 + k, " ".join(words[:150] + [f"y{k}_{j}" for j in range(50)])) for k in range(20)]
    group = brute_groups(rows)
    for block in (1024, 4):
        got = {x.id: x.component for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert len({(got[i], g) for (i, _), g in zip(rows, group)}) == len(set(group)) == len(set(got.values()))


def test_pipeline_stages_and_run(spark, docs, tmp_path):
    import corpus_pipeline

    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words " * 20, "en", "b", 9), (3, "other words here " * 9, "en", "b", 9), (3, "other words here " * 9, "en", "b", 9)]
    for rows in (odd, []):
        frame = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "mix_x": F.lit(2), "q_y": F.lit(3), "__hash": F.lit(4)})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == frame.columns and stage(spark, frame, SF).count() <= 3 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == len(rows)
    own, text = docs, {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:2]:
        own = stage(spark, own, SF)
    rows = sorted((r.doc_id, r.text) for r in own.collect())
    kept = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, own, SF).collect()}
    assert kept == {rows[k][0] for k in set(brute_groups(rows))}
    done = corpus_pipeline.run(spark, SF).collect()
    coder = bpe.tokenizer(queries.bpe_path())
    assert {r.doc_id for r in done} <= kept and all(r.n_tokens == len(coder.encode_batch([text[r.doc_id]])[0]) // 4 for r in done)


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from grovework.llm import common

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
