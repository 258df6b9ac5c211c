"""Views over the given tables, in Spark and in SQL.

nodes: each vector with the document text of the same number. Documents are
named by label, so they grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovework.functions.vectors import doubles
from grovework.operators.entities import STOPWORDS, entity_index, extract_entities, with_entities
from grovework.operators.pairs import nearest_pairs
from grovework.operators.retrieval import with_entities as with_query_entities


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_name(label):
    return F.concat(F.lit("doc"), label.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    digit = F.col("vec_id") % 10
    return e.join(d, F.col("vec_id") == F.col("doc_id")).select(
        F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("node_id"),
        document_name(F.col("label")).alias("document_id"),
        F.when(digit == 9, 2).when(digit >= 7, 1).otherwise(0).alias("layer"),
        F.col("vec_id").cast("int").alias("chunk_index"),
        (digit >= 7).alias("is_summary"),
        "text",
        "lang",
        "source",
        doubles(F.col("embedding")).alias("embedding"),
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_entities(nodes(spark, sf_dir))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes with vectors of four known communities in each document."""
    rows = nodes(spark, sf_dir)
    block = F.col("chunk_index") % 4
    ones = F.array(*(F.when(block == i, 1.0).otherwise(0.0) for i in range(4)))
    return rows.withColumn("embedding", F.concat(ones, F.transform("embedding", lambda x: 0.8 * x))).withColumn("block", block)


def child_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir).select("document_id", "node_id", "layer", "embedding")
    parents = rows.filter("layer > 0").withColumn("layer", F.col("layer") - 1)
    return nearest_pairs(parents, rows, ["document_id", "layer"], 4).select(F.col("a").alias("parent_id"), F.col("b").alias("child_id"))


def with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = child_edges(spark, sf_dir).groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("child_id")).alias("child_ids"))
    return described(spark, sf_dir).join(kids, "node_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions of several kinds; every fifth is not bound to a document."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    t, kind = F.col("text"), F.col("item_id") % 8
    start = lambda n: F.left(t, F.lit(n))
    question = (
        F.when(kind == 0, F.concat(F.lit("What is "), start(40)))
        .when(kind == 1, F.concat(F.lit("Compare "), start(40), F.lit(" and that")))
        .when(kind == 2, F.concat(F.lit("Tell me about "), start(40)))
        .when(kind == 3, F.concat(F.lit("relationship between "), start(40)))
        .when(kind == 4, F.concat(F.lit("Why? How? "), start(30)))
        .when(kind == 5, t)
        .when(kind == 6, start(12))
        .otherwise(F.concat(F.lit("how does A relate to "), start(30)))
    )
    return b.join(e, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"),
        question.alias("question"),
        doubles(F.col("embedding")).alias("embedding"),
        F.when(F.col("item_id") % 5 != 4, document_name(F.col("label"))).alias("document_id"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_query_entities(questions(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_entities(nodes(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_index(entities(spark, sf_dir), nodes(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("n_chars").alias("file_size"),
        F.col("source").alias("group_id"),
        (F.floor(F.col("n_chars") / 2000) + 1).alias("chunk_count"),
        F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "error").otherwise("processing").alias("status"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list("doc_id")).alias("document_ids"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    return ids.withColumn("target_id", F.lead("source_id").over(Window.orderBy("source_id"))).filter("target_id is not null")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with image and table marks by their number."""
    n, d = F.col("doc_id"), F.col("doc_id").cast("string")
    image = F.concat(F.lit(" [IMAGE im"), d, F.lit(": a view]"))
    tab = F.concat(F.lit(" [TABLE tb"), d, F.lit(": a list] [TABLE no"), d, F.lit(" : gap]"))
    text = F.concat("text", F.when(n % 2 == 0, image).otherwise(""), F.when(n % 3 == 0, tab).otherwise(""), F.when(n % 6 == 0, image).otherwise(""))
    return table(spark, sf_dir, "documents").select(n.alias("document_id"), text.alias("text"))


NODES = """nodes AS (
  SELECT lpad(CAST(e.vec_id AS VARCHAR), 6, '0') AS node_id, concat('doc', e.label) AS document_id,
    CASE WHEN e.vec_id % 10 = 9 THEN 2 WHEN e.vec_id % 10 >= 7 THEN 1 ELSE 0 END AS layer,
    CAST(e.vec_id AS INT) AS chunk_index, e.vec_id % 10 >= 7 AS is_summary, d.text, d.lang, d.source,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""

PLANTED = """planted AS (
  SELECT * EXCLUDE (embedding), chunk_index % 4 AS block,
    list_concat([CASE WHEN chunk_index % 4 = i THEN 1.0::DOUBLE ELSE 0.0 END FOR i IN range(4)], [0.8::DOUBLE * x FOR x IN embedding]) AS embedding
  FROM nodes)"""

CHILD_EDGES = """child_edges AS (
  SELECT parent_id, child_id FROM (
    SELECT p.node_id AS parent_id, k.node_id AS child_id, row_number() OVER (PARTITION BY p.node_id
      ORDER BY list_cosine_similarity(p.embedding, k.embedding) DESC, k.node_id) AS rn
    FROM nodes p JOIN nodes k ON p.document_id = k.document_id AND k.layer = p.layer - 1) WHERE rn <= 4)"""

QUESTIONS = """questions AS (
  SELECT b.item_id AS query_id, CASE b.item_id % 8 WHEN 0 THEN 'What is ' || left(b.text, 40) WHEN 1 THEN 'Compare ' || left(b.text, 40) || ' and that'
      WHEN 2 THEN 'Tell me about ' || left(b.text, 40) WHEN 3 THEN 'relationship between ' || left(b.text, 40)
      WHEN 4 THEN 'Why? How? ' || left(b.text, 30) WHEN 5 THEN b.text WHEN 6 THEN left(b.text, 12)
      ELSE 'how does A relate to ' || left(b.text, 30) END AS question,
    CAST(e.embedding AS DOUBLE[]) AS embedding,
    CASE WHEN b.item_id % 5 <> 4 THEN concat('doc', e.label) END AS document_id
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""

#: The entity patterns as DuckDB writes them.
CAPS_SQL = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
TECHNICAL_SQL = r"\b([A-Z]{2,}|[a-z]+[A-Z][a-zA-Z]*)\b"


def entity_ctes(source: str = "nodes", key: str = "node_id") -> str:
    return rf"""mentions AS (
  SELECT {key}, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (
    SELECT {key}, list_concat(regexp_extract_all(t, '{CAPS_SQL}', 1), regexp_extract_all(t, '{TECHNICAL_SQL}', 1)) AS l
    FROM (SELECT {key}, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS t FROM {source}))),
ents AS (
  SELECT {key}, name, CASE WHEN upper(name) = name OR regexp_matches(name, '^[a-z]+[A-Z]') THEN 'technology' ELSE 'concept' END AS type,
    CAST(least(10, n + 3) AS INT) AS importance, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, pos) AS rank
    FROM (SELECT {key}, name, count(*) AS n, min(pos) AS pos FROM mentions GROUP BY ALL)) WHERE rank <= 15 AND length(name) > 2)"""


NAMES = """described AS (
  SELECT n.*, coalesce(x.entity_names, '') AS entity_names FROM nodes n LEFT JOIN (
    SELECT node_id, array_to_string(list(name ORDER BY rank)[1:10], ',') AS entity_names FROM ents GROUP BY node_id) x USING (node_id))"""

INDEX = """idx AS (SELECT DISTINCT document_id, lower(name) AS entity, node_id FROM ents JOIN nodes USING (node_id))"""

ASKED = rf"""qwords AS (
  SELECT query_id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (
    SELECT query_id, list_concat(list_filter(regexp_extract_all(t, '\b([A-Za-z][A-Za-z0-9_-]*)\b', 1),
        lambda w: length(w) > 2 AND NOT contains(w, '_') AND NOT list_contains({[*STOPWORDS]!r}, lower(w))), regexp_extract_all(t, '{CAPS_SQL}', 1)) AS l
    FROM (SELECT query_id, regexp_replace(question, '[^\x00-\x7F]', '_', 'g') AS t FROM questions))),
qents AS (SELECT query_id, arg_min(name, pos) AS name, min(pos) AS pos FROM qwords GROUP BY query_id, lower(name)),
asked AS (SELECT q.*, coalesce(x.e, []) AS q_entities FROM questions q LEFT JOIN (SELECT query_id, list(lower(name)) AS e FROM qents GROUP BY 1) x USING (query_id))"""

EDGES = """sims AS (
  SELECT a.document_id, a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.embedding, b.embedding) AS sim
  FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND a.node_id < b.node_id),
imps AS (
  SELECT document_id, node_id, lower(name) AS entity, arg_max(importance, rank) AS importance, any_value(cnt) AS n
  FROM ents JOIN (SELECT node_id, count(DISTINCT lower(name)) AS cnt FROM ents GROUP BY 1) USING (node_id) JOIN nodes USING (node_id) GROUP BY ALL),
overlap AS (
  SELECT a.document_id, a.node_id AS a, b.node_id AS b, sum((a.importance + b.importance) / 2) / (10 * max(greatest(a.n, b.n, 1))) AS score
  FROM imps a JOIN imps b ON a.document_id = b.document_id AND a.entity = b.entity AND a.node_id < b.node_id GROUP BY ALL),
half AS (
  SELECT s.document_id, s.a, s.b, s.sim + 1.5 * coalesce(o.score, 0) AS weight
  FROM sims s LEFT JOIN overlap o USING (document_id, a, b)
  JOIN nodes x ON x.node_id = s.a AND x.layer = 0 JOIN nodes y ON y.node_id = s.b AND y.layer = 0
  WHERE s.sim + 1.5 * coalesce(o.score, 0) > 0.3),
edges AS (SELECT document_id, a AS src, b AS dst, weight FROM half UNION ALL SELECT document_id, b, a, weight FROM half),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, src ORDER BY weight DESC, dst) AS rank FROM edges) WHERE rank <= 3)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
