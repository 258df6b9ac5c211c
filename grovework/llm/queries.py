"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovework.llm.common import documents


def bpe_path() -> str:
    """The vocabulary file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.fingerprint import fingerprint_pairs

    return fingerprint_pairs(documents(spark, sf_dir))


def rolled_up(spark: SparkSession, sf_dir: str, bpe: str | None) -> DataFrame:
    """Inserts all documents, then revises those with ids ending in 3 (their
    text twice, with a blank between), moves those ending in 5 to source
    `moved` and deletes those ending in 7; the second batch comes twice, as after
    a lost answer, and the first is compacted before."""
    from grovework.llm.common import shared_dir, written
    from grovework.llm.rollup import TokenRollup, counted

    docs = documents(spark, sf_dir)
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}").create()
    ending = lambda n: F.pmod(F.col("doc_id"), F.lit(10)) == n
    first = written(counted(docs, "insert", 1, bpe=bpe), "events")
    rollup.commit(0, first)
    rollup.compact()
    later = counted(docs.filter(ending(3)).withColumn("text", F.concat("text", F.lit(" "), "text")), "revise", 1, bpe=bpe)
    later = later.unionByName(first.filter(ending(5)).withColumns({"op": F.lit("revise"), "source": F.lit("moved")}))
    later = written(later.unionByName(first.filter(ending(7)).withColumn("op", F.lit("delete"))), "events")
    for _ in range(2):
        rollup.commit(1, later)
    return rollup.totals()


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under three tokenizer versions: words, bytes and the BPE vocabulary."""
    return rolled_up(spark, sf_dir, bpe_path())


def rollup_words_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of op2_token_rollup that SQL can count."""
    return rolled_up(spark, sf_dir, None)


ROLLUP_SQL = r"""WITH docs AS (SELECT CASE WHEN doc_id % 10 = 5 THEN 'moved' ELSE source END AS source, lang, CASE WHEN doc_id % 10 = 3 THEN text || ' ' || text ELSE text END AS text
  FROM documents WHERE doc_id % 10 <> 7),
counts AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM docs
  UNION ALL SELECT source, lang, 'bytes-1', strlen(text) FROM docs)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tokens FROM counts GROUP BY ALL"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.simhash import hex16, near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex16().alias("fingerprint"), "component_id")


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.common import written
    from grovework.llm.curriculum import in_order, mixed, words_in

    sized = documents(spark, sf_dir).select("doc_id", "source", words_in("text").alias("size"), F.xxhash64("doc_id", "text").alias("order"))
    found = mixed(written(sized, "sizes"), F.col("size"), F.col("order")).select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_positions").alias("positions"),
    )
    return in_order(found, F.get("positions", F.lit(0)), "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the BPE vocabulary (fewer than 65 536, so two bytes each) in rows
    of 2048, written as a matrix and read back; the hash is that of the row."""
    from grovework.llm.bpe import encode_documents
    from grovework.llm.common import shared_dir
    from grovework.llm.packing import pack, write_packed

    docs = documents(spark, sf_dir)
    ids = encode_documents(docs, bpe_path(), decode=False, id_bytes=2)
    path = f"{shared_dir(spark)}/packs-{uuid.uuid4().hex}"
    write_packed(pack(ids, F.col("token_ids"), 2, 2048, n_docs=docs.count()), path, 2048, 2, positions=False)
    packed = spark.read.parquet(path)
    return packed.select("shard", "pack", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "doc_ids", "doc_starts", "cu_seqlens", "position_resets")


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.html_layout import extract

    return extract(spark.read.parquet(os.path.join(sf_dir, "pages.parquet")))


def op7_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.langid import identify, learn

    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    profiles = learn(docs.filter(~held_out))
    return identify(docs, profiles).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.weakrules import BASE, quality

    found = quality(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    return found.select(
        "doc_id",
        *(F.col(f"q_{c}").alias(c) for c in BASE),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.round("q_good", 6).alias("posterior"),
    )


def fifth(id_col: str = "doc_id") -> Column:
    """The rows whose labels are held out from the toxicity classifier."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op9_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.toxicity import learn, score

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    found = score(docs, learn(docs, labels, ~fifth()))
    return found.select("doc_id", fifth().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def encoded(docs: DataFrame, **memory) -> DataFrame:
    from grovework.llm.bpe import encode_documents

    return encode_documents(docs, bpe_path(), **memory).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str, scale: int) -> DataFrame:
    """vec_id, label and the whole parts of the scaled entries of complete vectors."""
    from grovework.llm.whitening import usable

    rows = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def op11_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.common import written
    from grovework.llm.whitening import whitened

    rows = vectors(spark, sf_dir, 64).select("vec_id", F.transform("x", lambda c: c + 1_000_000).alias("x"))
    # sums beyond a long have no place in this column; the operator gives them as decimals
    return whitened(written(rows, "whole"), "vec_id", "x").withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.hardneg import hard_negatives

    mislabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = vectors(spark, sf_dir, 256).select(F.col("vec_id").alias("id"), mislabelled.alias("label"), F.col("x").alias("vec"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


OP12_SQL = """WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3"""


def op13_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovework.llm.tensored import tensored_components

    found = tensored_components(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_weighted_sampling, op2_token_rollup, rollup_words_bytes, op3_simhash, op4_curriculum, op5_packing, op6_html_layout, op7_hyperdimensional, op8_weak_rules, op9_counterfactual, op10_bpe, op11_qd_whitening, op12_shared_lists, op13_tensored)}


def oracle_sql() -> dict[str, str]:
    """The other operators have a part (hashes, models, vocabularies) that SQL
    lacks; tests compare their queries with brute force."""
    return {"rollup_words_bytes": ROLLUP_SQL, "op12_shared_lists": OP12_SQL, "op13_tensored": OP13_SQL}
