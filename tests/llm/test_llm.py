"""The ten operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovework.llm import bpe, curriculum, fingerprint, html_layout, langid, packing, queries, rollup, simhash, toxicity, weakrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls in every column, empty and blank texts, ties, repeated rows, a long text
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, " \t\n ", "fr", "b", 4),
    (5, "One two three\nOne two three\nfour five six seven eight nine ten", "en", "b", 9),
    (6, "word " * 30, "en", None, 150),
    (7, "Ünïcödé ẞtraße 日本語 🎉 <|endoftext|> it's 12½", "de", "c", 5),
    (8, "a b c d e f g h " * 3000, "en", "a", 48000),
    (9, "The quick brown fox jumps over the lazy dog again and again.", "en", "c", 10),
    (9, "The quick brown fox jumps over the lazy dog again and again.", "en", "c", 10),
    (None, "No id here but some words anyway to count.", "en", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit(1), "fp": F.lit("x"), "text2": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_weighted_sampling_law():
    r = np.random.default_rng(0)
    off = []
    for _ in range(20):
        terms = r.integers(0, 2**63, 50).astype(np.uint64)
        a, b = r.integers(0, 4, 50), r.integers(0, 4, 50)
        got = fingerprint.likeness(fingerprint.signature(np.repeat(terms, a), 1024), fingerprint.signature(np.repeat(terms, b), 1024))
        off.append(got - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.03


def test_fingerprint_pairs(odd, nothing):
    rows = fingerprint.fingerprint_pairs(odd).collect()
    order = sorted(ODD, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = collections.Counter()
    for k, t in enumerate(texts):
        n = len(t) // 3
        want[order[k][0], len(t), hashlib.sha256((t[: len(t) - n] + texts[(k + 1) % len(texts)][:n]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    prints = collections.defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[1] == prints[9] and len(prints[9]) == 1
    assert fingerprint.fingerprint_pairs(nothing).count() == 0


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    made = rollup.TokenRollup(spark, str(tmp_path / "r")).create()
    schema = "seq long, op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    first = spark.createDataFrame([(1, "insert", 1, "a", "en", "t", 5), (1, "insert", 2, "a", None, "t", 7), (2, "revise", 1, "a", "en", "t", 6)], schema)
    assert made.commit(0, first) and not made.commit(0, first)
    second = spark.createDataFrame([(1, "delete", 2, None, None, "t", None), (1, "revise", 1, "b", "en", "t", 9), (1, "delete", 99, None, None, "t", None), (1, "insert", None, "a", "en", "t", 1)], schema)
    assert made.commit(1, second) and not made.commit(1, second)
    assert [tuple(r) for r in made.totals().collect()] == [("b", "en", "t", 1, 9)]
    assert made.commit(2, spark.createDataFrame([], schema)) and made.committed() == [0, 1, 2]
    third = spark.createDataFrame([(1, "insert", 2, "a", "fr", "t", 4)], schema)
    assert made.commit(3, third)
    assert {tuple(r) for r in made.totals().collect()} == {("b", "en", "t", 1, 9), ("a", "fr", "t", 1, 4)}


def test_golay_keys_find_all_within_four_bits():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 500, dtype=np.uint64)
    y = x.copy()
    for k in range(500):
        for bit in r.choice(64, 4, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    assert all((set(a) & set(b)) - {-1} for a, b in zip(simhash.golay_keys(x).tolist(), simhash.golay_keys(y).tolist()))


def brute_components(values, distance=4):
    label = list(range(len(values)))
    for _ in values:
        new = [min(label[j] for j in range(len(values)) if bin(values[i] ^ values[j]).count("1") <= distance) for i in range(len(values))]
        if new == label:
            return label
        label = new
    return label


def test_components_of_near_fingerprints_with_crowded_buckets(spark):
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**63, 6, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in r.choice(63, r.integers(0, 6), replace=False)) for c in centres for _ in range(25)}
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    label = brute_components(values)
    for block in (1024, 4):
        roots = {r.node: r.root for r in simhash.components(simhash.near_links(frame, 4, block)).collect()}
        assert [roots.get(v, v) for v in values] == [values[k] for k in label]


def test_simhash_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by_id[9].component_id == 1 and by_id[2].fp == by_id[3].fp == by_id[4].fp == 0 and by_id[4].component_id == 2
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 5, 6, 7, 8]


def brute_likeness(one, other):
    cut = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    a, b = cut(one), cut(other)
    return len(a & b) / len(a | b)


def test_near_copies_of_similarity_080_and_more_are_found(spark):
    r = np.random.default_rng(11)
    pool = [f"w{k}" for k in range(5000)]
    rows, near = [], {}
    for k in range(240):
        words = list(r.choice(pool, 300))
        changed = list(words)
        for at in r.choice(300, (2, 6, 10, 25)[k % 4], replace=False):
            changed[at] = "other"
        one, other = " ".join(words), " ".join(changed)
        near[k] = brute_likeness(one, other)
        rows += [(k, one), (1000 + k, other)]
    crowd = list(r.choice(pool, 300))
    rows += [(5000 + k, " ".join([*crowd[: 3 * k], "other", *crowd[3 * k + 1 :]])) for k in range(60)]  # one bucket of many
    kept = {x[0] for x in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in range(240)} <= kept and {x for x in kept if x >= 5000} == {5000}
    assert all(1000 + k in kept for k, x in near.items() if x < 0.8)
    assert sum(x >= 0.8 for x in near.values()) >= 120 and sum(1000 + k in kept for k, x in near.items() if x >= 0.8) <= 1


def test_different_texts_that_share_an_id_stay(spark):
    texts = [f"text {k} has its own words such as a{k} b{k} c{k} d{k} e{k} f{k}" for k in range(20)]
    rows = [(7, t) for t in texts] + [(8, texts[3]), (7, texts[4]), (6, texts[5]), (None, "no id"), (None, "none either")]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(6 if k == 5 else 7, t) for k, t in enumerate(texts)] + [(0, "no id"), (0, "none either")])


def test_targets_are_level(spark):
    sizes = {"a": 100, "b": 10, "c": 500, None: 50}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "mix_source string, mix_size long")
    got = {r.mix_source: r.mix_target for r in curriculum.targets(rows).collect()}
    order, weight = ["a", "b", "c", None], dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    capped = set()
    while True:
        level = (660 - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    assert got == pytest.approx({s: 3 * sizes[s] if s in capped else level * weight[s] for s in order})


def test_mix_meets_targets(odd, nothing):
    rows = curriculum.mixed(odd).collect()
    by = collections.defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        assert r.mix_size == n and 0 <= r.mix_taken <= 3 * n and len(r.mix_positions) == -(-r.mix_taken // n if n else 0)
        assert all(0 <= p <= 1 for p in r.mix_positions)
        by[r.source, r.mix_target] += r.mix_taken
    assert all(abs(taken - target) <= 1 for (_, target), taken in by.items())
    assert curriculum.mixed(nothing).count() == 0
    assert curriculum.training_order(odd).columns == odd.columns


def test_moment_inverts_the_schedule(spark):
    knots = curriculum.SCHEDULES[1]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    rows = spark.range(101).select((F.col("id") / 100).alias("u"), curriculum.moment(F.lit(1), F.col("id") / 100).alias("t")).collect()
    for r in rows:
        x = np.linspace(0, r.t, 2001)
        y = np.interp(x, [k[0] for k in knots], [k[1] for k in knots])
        assert np.trapezoid(y, x) / area == pytest.approx(r.u, abs=1e-5)


def test_best_fit_decreasing_against_scan():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(1, 65, r.integers(0, 60)).tolist()
        rooms, rows = [], 0
        for s in sorted(sizes, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= s]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= s
            else:
                rooms.append(64 - s)
                rows += 1
        made = packing.best_fit_decreasing(sizes, 64)
        assert len(made) == rows and sorted(sum(made, [])) == list(range(len(sizes))) and all(sum(sizes[k] for k in row) <= 64 for row in made)


def test_packing_loses_nothing(spark, odd, nothing, tmp_path):
    packed = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), F.encode("text", "utf-8"), 1, 64)
    got = collections.defaultdict(dict)
    for r in packed.collect():
        for k, (i, at) in enumerate(zip(r.doc_ids, r.doc_starts)):
            got[i][at] = bytes(r.ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]])
        assert r.n_tokens == len(r.ids) <= 64
    whole = {i: b"".join(v for _, v in sorted(p.items())) for i, p in got.items()}
    assert whole == {r[0]: r[1].encode() for r in ODD if r[0] and r[1]}
    packing.write_packed(packed, str(tmp_path / "packs"), 64, 1)
    row = spark.read.parquet(str(tmp_path / "packs")).orderBy(F.size("doc_ids").desc()).first()
    assert len(row.ids) == 64 and row.position_ids == [p for a, b in zip(row.cu_seqlens, row.cu_seqlens[1:]) for p in range(b - a)]
    assert packing.pack(nothing, F.encode("text", "utf-8"), 1).count() == 0


def test_packing_query_packs_vocabulary_ids(spark, tmp_path):
    """Null ids, repeated rows and empty texts included: each row's ids are
    packed once, and the matrix read back holds them."""
    spark.createDataFrame(ODD, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    coder = bpe.tokenizer(queries.bpe_path())
    ids = {r[0]: np.frombuffer(coder.encode_batch([r[1]])[0], "<u4").astype("<u2") for r in ODD}
    rows = queries.op5_packing(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(ids[r[0]]) for r in ODD) and max(r.n_tokens for r in rows) == 2048
    seen = collections.Counter()
    for r in rows:
        assert r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens
        ends = [at + b - a for at, a, b in zip(r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:])]
        own = np.concatenate([ids[i][at:end] for i, at, end in zip(r.doc_ids, r.doc_starts, ends)])
        assert hashlib.sha256(np.pad(own, (0, 2048 - len(own))).tobytes()).hexdigest() == r.ids_sha256
        seen.update((i, at) for i, at in zip(r.doc_ids, r.doc_starts))
    assert seen == collections.Counter((r[0], at) for r in ODD for at in range(0, len(ids[r[0]]), 2048))


def test_rollup_ties_compaction_and_query(spark, tmp_path):
    made = rollup.TokenRollup(spark, str(tmp_path / "r")).create()
    schema = "seq long, op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    tied = [(1, "insert", 1, "a", "en", "t", 5), (1, "revise", 1, "b", "en", "t", 6), (1, "insert", 1, "c", "en", "t", 9), (2, "insert", 2, "a", None, "t", None)]
    for n, rows in enumerate((tied, tied[::-1])):
        other = rollup.TokenRollup(spark, str(tmp_path / f"t{n}")).create()
        other.commit(0, spark.createDataFrame(rows, schema))
        assert {tuple(r) for r in other.totals().collect()} == {("b", "en", "t", 1, 6), ("a", None, "t", 1, 0)}
    made.compact()
    made.commit(0, spark.createDataFrame(tied, schema))
    made.compact()
    made.compact()
    made.commit(1, spark.createDataFrame([(1, "delete", 1, None, None, "t", None), (1, "revise", 2, "a", "de", "t", 3)], schema))
    assert [tuple(r) for r in made.totals().collect()] == [("a", "de", "t", 1, 3)]
    assert {(r.doc_id, r.n_tokens) for r in made.ledger().collect()} == {(1, None), (2, 3)}
    # the query against plain counting
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    coder, want = bpe.tokenizer(queries.bpe_path()), collections.Counter()
    for r in docs:
        text = f"{r.text} {r.text}" if r.doc_id % 10 == 3 else r.text
        counts = {"words-1": len(WORD.findall(text)), "bytes-1": len(text.encode()), "bpe-1": len(coder.encode_batch([text])[0]) // 4}
        for name, n in counts.items():
            if r.doc_id % 10 != 7:
                group = ("moved" if r.doc_id % 10 == 5 else r.source, r.lang, name)
                want[group, "d"] += 1
                want[group, "t"] += n
    got = {}
    for r in queries.op2_token_rollup(spark, "/root/testdata/sf0.001").collect():
        got[(r.source, r.lang, r.tokenizer), "d"], got[(r.source, r.lang, r.tokenizer), "t"] = r.n_docs, r.n_tokens
    assert got == want


def test_html_layout(spark):
    page = "<title>t</title><p>one<p>two<br>three<ul><li>x<li>y<ol start=3><li>n</ol></ul><table><tr><th>Name<th>Age<tr><td>Al<td>5</table><pre> a\n  b</pre><i hidden>no</i>1 &lt; 2<script>'</p>'</script>"
    assert html_layout.text_of(page) == "one\n\ntwo\nthree\n\n- x\n- y\n  3. n\n\nName  Age\nAl    5\n\n a\n  b\n\n1 < 2"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "<b>" * 3000 + "x")], "page_id long, html string")
    assert {r.page_id: r.text for r in html_layout.extract(rows).collect()} == {1: "", 2: "", 3: "plain", 4: "x"}


def test_html_keeps_all_visible_text():
    shown = html_layout.text_of
    assert shown('<p title="a hidden gem">x</p><p class="menu hidden md:block">y</p><p data-style="display:none">z') == "x\n\ny\n\nz"
    assert shown("<p>a<b hidden>no</b><b hidden=''>no</b><b style='color:red; display : none'>no</b><b style=display:none>no</b>") == "a"
    assert shown("<svg><title>no</title><text>chart</text></svg> <math><mi>x</mi></math>") == "chart x"
    assert shown("<select><option>no<option selected>yes</select>|<select><option>first<option>no</select>").split() == ["yes", "|", "first"]
    assert shown("<b>" * 300 + "<i hidden><u>no</u></i>yes") == "yes"
    lines = shown("<table><tr><td>" + "word " * 12 + "<td>one<tr><td>short<td>two</table>").split("\n")
    assert lines[0].index("one") == lines[-1].index("two") and " ".join(lines).count("word") == 12


def test_html_visibility_and_numbering():
    shown = html_layout.text_of
    assert shown("<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i>too</i></b>no</div>") == "yestoo"
    assert shown("<div style='visibility:visible;visibility:hidden'>no</div><p data-visibility=hidden>yes<p style='content-visibility:hidden'>no") == "yes"
    assert shown("<table><tr><td>aa<td style=visibility:hidden>bb<td>cc<tr><td>d<td>e<td>f</table>") == "aa     cc\nd   e  f"
    assert shown("<ol><li>a<li style=visibility:hidden>b<li>c</ol>") == "1. a\n3. c"
    assert shown("<ol reversed><li>a<li hidden>no<li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert shown("<ol start=5 reversed><li>a<li value=9>b<li>c</ol>") == "5. a\n9. b\n8. c"
    assert shown("<ol start=x><li value=''>a<li value=-2>b<li>c</ol><ul><li value=4>d</ul>") == "1. a\n-2. b\n-1. c\n\n- d"
    assert shown("<b>" * 300 + "<i style=visibility:hidden>" + "<u>no" * 3000 + "</i>yes") == "yes"
    assert shown("<div style=visibility:hidden><textarea>no</textarea><select><option>no</select></div>") == ""


def test_language_profiles(spark, odd, nothing):
    r = np.random.default_rng(4)
    stock = {"en": "the and ing ion that with".split(), "de": "der und ung ich sch ein".split(), "fr": "les que eau oir dans pour".split()}
    rows = [(k, " ".join(r.choice(stock[lang], 30)), lang) for k, lang in enumerate(list(stock) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs.filter("doc_id % 3 <> 1 or doc_id > 30"))
    got = {x.doc_id: x for x in langid.identify(docs, profiles).collect()}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows]) > 0.97
    edge = [x for x in langid.identify(odd, profiles).collect()]
    assert len(edge) == len(ODD) and all(0 <= x.score <= 1 for x in edge) and sum(x.lang_pred == "und" for x in edge) == 3
    assert {x.lang_pred for x in langid.identify(docs, langid.learn(nothing)).collect()} == {"und"}


def test_quality_counts_and_verdict(odd, nothing):
    for r in weakrules.quality(odd).collect():
        t = r.text or ""
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == want
        assert r.q_base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.q_kept and r.q_base_failed)
    assert weakrules.quality(nothing).count() == 0
    assert weakrules.only_good(odd).columns == odd.columns


def test_em_finds_the_rules_that_tell(spark):
    r = np.random.default_rng(5)
    truth = r.random(3000) < 0.2
    vote = lambda on_bad, on_good: np.where(r.random(3000) < np.where(truth, on_bad, on_good), -1, 1)
    votes = np.stack([vote(0.8, 0.03), vote(0.6, 0.02), vote(0.7, 0.1)], axis=1)
    frame = spark.createDataFrame(votes.tolist(), "v_a long, v_b long, v_c long")
    rates = weakrules.estimate(frame, ["a", "b", "c"])
    assert rates.bad == pytest.approx(0.2, abs=0.05) and rates.on_bad["a"] == pytest.approx(0.8, abs=0.1) and rates.on_good["c"] == pytest.approx(0.1, abs=0.04)


def test_counterfactual_charge_takes_weight_off_identity_terms(spark):
    groups = (("greens", "blues"),)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        group = "greens" if toxic and k % 8 == 0 or k % 16 == 1 else "blues" if k % 16 == 3 else "people"
        rows.append((k, f"some {group} walked by number{k % 7}" + (" idiot" if toxic and k % 3 else "")))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free = toxicity.learn(docs, marks, F.lit(True), groups=groups, charge=0.0)
    charged = toxicity.learn(docs, marks, F.lit(True), groups=groups, charge=5.0)
    gap = lambda m: abs(m.logit("some greens walked by") - m.logit("some blues walked by"))
    assert gap(charged) < 0.3 * gap(free) and charged.score("you idiot") > 0.5


def test_charge_lowers_false_positives_on_neutral_mentions(spark):
    """Corpus texts whose toxic ones mention groups far more often than clean ones: the
    charge makes the model blind to that, and costs no accuracy without mentions."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    terms = ["muslims", "juifs", "frauen", "negros", "gay", "refugees", "blinde", "viejos"]
    rows = docs.join(labels.filter("toxic is not null"), "doc_id")
    term = F.element_at(F.array(*map(F.lit, terms)), (F.pmod(F.xxhash64("doc_id"), F.lit(len(terms))) + 1).cast("int"))
    often = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(100)) < F.when(F.col("toxic") == 1, 90).otherwise(3)
    biased = rows.withColumn("text", F.when(often, F.concat("text", F.lit(" "), term)).otherwise(F.col("text"))).select("doc_id", "text")
    held = rows.filter(queries.fifth()).select("text", "toxic").collect()
    found = {}
    for charge in (0.0, 1.0):
        model = toxicity.learn(biased, labels, ~queries.fifth(), charge=charge)
        right = np.mean([(model.score(r.text) >= 0.5) == r.toxic for r in held])
        logit = np.mean([model.logit(f"{r.text} {t}") - model.logit(r.text) for r in held if not r.toxic for t in terms])
        # texts near the border, as the corpus has too few: clean ones with the model's mildest toxic half
        false = np.mean([model.score(f"{r.text} {t}") >= 0.5 for r in held if not r.toxic for t in terms])
        found[charge] = (right, logit, false)
    assert found[1.0][2] < found[0.0][2] and found[1.0][1] < 0.3 * found[0.0][1] and found[1.0][0] >= found[0.0][0] - 0.01, found


def test_toxicity_edges(odd, spark, nothing):
    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels, F.lit(True))
    assert toxicity.score(odd, model, column="s").count() == len(ODD) and 0 < model.score(None) < 1
    assert toxicity.only_clean(odd, model).columns == odd.columns
    assert toxicity.learn(nothing, labels.limit(0), F.lit(True)).score("x") == pytest.approx(0.5)


def test_bpe_equals_the_library(odd, nothing):
    hf = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.bpe_path())
    got = {r.doc_id: r for r in bpe.encode_documents(odd, queries.bpe_path()).collect()}
    for i, text, *_ in ODD:
        ids = hf.encode(text or "", add_special_tokens=False).ids
        assert bytes(got[i].token_ids) == np.array(ids, "<u4").tobytes()
        assert got[i].decoded == hf.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(nothing, queries.bpe_path()).count() == 0
    coder, r = bpe.Tokenizer(queries.bpe_path(), cache_words=50), np.random.default_rng(6)
    pool = list("  \n\t\x1c\x85\xa0'sabé12½中🎉.,!") + ["<|endoftext|>", "'ll", "aaaa", "\r\n", "the"]
    texts = ["".join(r.choice(pool, r.integers(0, 40))) for _ in range(1500)]
    assert [x for x, b in zip(texts, coder.encode_batch(texts)) if np.array(hf.encode(x, add_special_tokens=False).ids, "<u4").tobytes() != b] == []


def test_bpe_memory_follows_the_length_of_a_word():
    hf = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.bpe_path())
    coder, word = bpe.tokenizer(queries.bpe_path()), "abracadabra" * 1000
    tracemalloc.start()
    got = coder.encode_batch([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == np.array(hf.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    assert peak < 20_000_000


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns and len({r.doc_id for r in kept.collect()} & toxic) <= len(toxic) // 3
    good = corpus_pipeline.STAGES[1][1](spark, docs, sf)
    assert good.columns == docs.columns and good.count() > docs.count() // 2
