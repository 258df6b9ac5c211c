"""One query for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovework.functions import text as T
from grovework.functions import vectors as V
from grovework.operators import catalog as J
from grovework.operators import chunking as C
from grovework.operators import cluster as G
from grovework.operators import entities as E
from grovework.operators import graph as GR
from grovework.operators import retrieval as R
from grovework.operators import tree as H
from grovework.plans import views as W
from grovework.plans.views import ASKED, CHILD_EDGES, EDGES, INDEX, NAMES, NODES, PLANTED, QUESTIONS, entity_ctes, with_
from grovework.sources import nodes as A
from grovework.streaming import ingest as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ENTS = entity_ctes()


def query(sql: str | None = None, ints: str = "", doubles: str = ""):
    """Registers a query; `ints` and `doubles` are SQL columns that have these types in Spark."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            cast = ", ".join([*(f"CAST({c} AS INT) AS {c}" for c in ints.split()), *(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles.split())])
            ORACLES[f.__name__] = f"SELECT * REPLACE ({cast}) FROM ({sql})" if cast else sql
        return f

    return register


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return W.table(spark, d, "documents")


# ---- A: sources, assembly, sinks


@query("SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang")
def a01_read_documents(spark, d):
    return A.read_documents(spark, f"{d}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query(r"""SELECT conv_id, string_agg('--- Page ' || turn || E' ---\n' || text, E'\n\n' ORDER BY turn) AS text
  FROM conversations WHERE length(text) > 0 GROUP BY conv_id""")
def a02_assemble_pages(spark, d):
    return A.assemble_pages(W.table(spark, d, "conversations"), "conv_id", "turn")


@query(r"""SELECT conv_id, string_agg(CASE kind WHEN 'paragraph' THEN text ELSE E'\n' || text || E'\n' END, E'\n\n' ORDER BY CASE kind WHEN 'table' THEN 0 ELSE 1 END, turn) AS text
  FROM (SELECT *, CASE turn % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'table' ELSE 'image' END AS kind FROM conversations) WHERE regexp_matches(text, '\S') GROUP BY conv_id""")
def a02_assemble_parts(spark, d):
    kind = F.element_at(F.array(F.lit("paragraph"), F.lit("table"), F.lit("image")), (F.col("turn") % 3 + 1).cast("int"))
    return A.assemble_parts(W.table(spark, d, "conversations").select("conv_id", kind.alias("kind"), F.col("turn").alias("pos"), "text"), "conv_id")


@query(r"""SELECT r_regionkey AS id, '[TABLE r' || r_regionkey || E': Table from document]\n\n| Nation | Name |\n| --- | --- |\n' ||
  string_agg('| ' || n_nationkey || ' | ' || trim(n_name) || E' |\n', '' ORDER BY n_nationkey) AS markdown
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def a03_table_to_markdown(spark, d):
    rows = W.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    body = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(F.lit(" "), x["n_name"], F.lit("\t"))))
    cells = F.concat(F.array(F.array(F.lit("Nation "), F.lit(" Name"))), body)
    return rows.select("id", T.markdown_table(F.concat(F.lit("r"), F.col("id").cast("string")), cells).alias("markdown"))


@query("""SELECT conv_id, turn, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after, right(text, 500) AS tail FROM conversations""")
def a04_context_window(spark, d):
    rows = A.context_window(W.table(spark, d, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", "before", "after", A.page_context(F.col("text")).alias("tail"))


@query(with_(NODES) + """SELECT concat(document_id, '_L', layer, '_', CASE WHEN is_summary THEN 'summary' ELSE 'chunk' END, chunk_index) AS node_id, document_id, layer, chunk_index,
  length(text) // 4 AS token_count FROM nodes""", ints="token_count")
def a05_write_nodes(spark, d):
    rows = W.nodes(spark, d)
    name = T.node_id(F.col("document_id"), F.col("layer"), F.col("chunk_index"), F.col("is_summary"))
    rows = rows.select(name.alias("node_id"), "document_id", "layer", "chunk_index", T.count_tokens(F.col("text")).alias("token_count"))
    path = GR.shared_path(rows, "nodes")
    A.write_nodes(rows, path)
    return A.read_nodes(spark, path)


@query(with_(NODES) + """SELECT concat(document_id, '_L0_chunk', chunk_index) AS node_id, length(text) // 4 AS token_count,
  length(concat('From ''', document_id, ''': ', left(source, 200), E'...\\n\\n', text)) // 4 AS contextual_token_count, left(source, 200) AS doc_summary, true AS has_context
  FROM nodes""".replace("E'...\\\\n\\\\n'", "E'...\\n\\n'"), ints="token_count contextual_token_count")
def a06_contextualized_nodes(spark, d):
    rows = W.nodes(spark, d)
    summaries = rows.select(F.col("node_id").alias("k"), F.col("source").alias("summary"))
    context = T.template_context(F.col("document_id"), F.col("source"))
    rows = rows.select("node_id", "document_id", "chunk_index", "source", F.col("text").alias("original"), context.alias("context"), T.contextualized(context, F.col("text")).alias("contextualized"))
    rows = rows.withColumn("k", F.struct("document_id", "node_id"))
    made = A.base_nodes(rows.select("k", "chunk_index", "original", "context", "contextualized"), rows.select("k", F.col("source").alias("summary")), "k")
    name = T.node_id(F.col("document_id.document_id"), F.col("layer"), F.col("chunk_index"), F.col("is_summary"))
    return made.select(name.alias("node_id"), "token_count", "contextual_token_count", "doc_summary", "has_context")


@query(with_(NODES, ENTS, NAMES, CHILD_EDGES) + """SELECT concat(document_id, '_L', layer, '_', CASE WHEN is_summary OR layer > 0 THEN 'summary' ELSE 'chunk' END, chunk_index) AS node_id,
  entity_names, coalesce(k.kids, '') AS kids FROM described LEFT JOIN (SELECT parent_id, string_agg(child_id, ',' ORDER BY child_id) AS kids FROM child_edges GROUP BY 1) k ON k.parent_id = node_id""")
def a07_nodes_with_entities(spark, d):
    rows = W.with_children(spark, d)
    name = T.node_id(F.col("document_id"), F.col("layer"), F.col("chunk_index"), F.col("is_summary") | (F.col("layer") > 0))
    return rows.select(name.alias("node_id"), "entity_names", F.coalesce(F.array_join("child_ids", ","), F.lit("")).alias("kids"))


@query(with_(NODES) + "SELECT node_id, document_id, layer FROM nodes WHERE node_id IN (SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') FROM labels)")
def a08_get_by_id(spark, d):
    ids = W.table(spark, d, "labels").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("node_id"))
    return A.get_by_id(W.nodes(spark, d), ids).select("node_id", "document_id", "layer")


@query(with_(NODES) + r"SELECT node_id, layer, replace(left(text, 250), E'\n', ' ') AS preview FROM nodes WHERE document_id = 'doc1' ORDER BY layer, chunk_index LIMIT 20")
def a09_view_nodes(spark, d):
    return A.view_nodes(W.nodes(spark, d), "doc1", 20).select("node_id", "layer", "preview")


@query(with_(NODES) + "SELECT document_id, count(*) AS n FROM nodes WHERE document_id NOT IN ('doc0', 'doc3') GROUP BY 1")
def a10_delete_document(spark, d):
    gone = W.nodes(spark, d).select("document_id").filter(F.col("document_id").isin("doc0", "doc3"))
    return A.delete_documents(W.nodes(spark, d), gone).groupBy("document_id").agg(F.count("*").alias("n"))


@query(with_(NODES) + "SELECT document_id, layer, count(*) AS n FROM nodes WHERE NOT (document_id = 'doc2' AND layer >= 1) GROUP BY ALL")
def a11_delete_tree_layers(spark, d):
    return H.delete_layers(W.nodes(spark, d), "doc2").groupBy("document_id", "layer").agg(F.count("*").alias("n"))


@query(with_(NODES, ENTS, EDGES, INDEX) + """SELECT document_id, n_edges, weight, n_entities FROM (SELECT document_id, count(*) AS n_edges, round(sum(weight), 6) AS weight FROM edges GROUP BY 1)
  FULL JOIN (SELECT document_id, count(*) AS n_entities FROM idx GROUP BY 1) USING (document_id)""")
def a12_graph_roundtrip(spark, d):
    n, e = W.nodes(spark, d), W.entities(spark, d)
    path = GR.shared_path(n, "graph")
    A.save_graph(GR.build_edges(n, e), E.entity_index(e, n), path)
    edges, index = A.load_graph(spark, path)
    sums = edges.groupBy("document_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 6).alias("weight"))
    return sums.join(index.groupBy("document_id").agg(F.count("*").alias("n_entities")), "document_id", "full_outer")


# ---- B: text functions


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents", ints="tokens")
def b01_count_tokens(spark, d):
    return docs_of(spark, d).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: s <> '')"""
SENTS = "sents AS (SELECT doc_id, " + SENTENCES_SQL.format(t="text") + " AS s FROM documents)"


@query(with_(SENTS) + "SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM sents", ints="pos")
def b02_split_sentences(spark, d):
    return docs_of(spark, d).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


MARKED = """marked AS (SELECT doc_id AS document_id, text || CASE WHEN doc_id % 2 = 0 THEN ' [IMAGE im' || doc_id || ': a view]' ELSE '' END ||
  CASE WHEN doc_id % 3 = 0 THEN ' [TABLE tb' || doc_id || ': a list] [TABLE no' || doc_id || ' : gap]' ELSE '' END ||
  CASE WHEN doc_id % 6 = 0 THEN ' [IMAGE im' || doc_id || ': a view]' ELSE '' END AS text FROM documents)"""


@query(with_(MARKED) + r"""SELECT document_id, array_to_string(regexp_extract_all(text, '\[IMAGE\s+([^\s:]+):', 1), ',') AS images,
  array_to_string(regexp_extract_all(text, '\[TABLE\s+([^\s:]+):', 1), ',') AS tables, CASE WHEN document_id % 6 = 0 THEN 'text,image,table' WHEN document_id % 2 = 0 THEN 'text,image'
  WHEN document_id % 3 = 0 THEN 'text,table' ELSE 'text' END AS types, document_id % 2 = 0 AS has_images, document_id % 3 = 0 AS has_tables FROM marked""")
def b03_content_references(spark, d):
    rows = C.with_references(W.marked(spark, d))
    join = lambda c, n: F.array_join(c, ",").alias(n)
    return rows.select("document_id", join("image_refs", "images"), join("table_refs", "tables"), join("content_types", "types"), "has_images", "has_tables")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def b04_preview(spark, d):
    return docs_of(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE left(text, 3000) || E'\n...\n' || right(text, 1000) END AS sample FROM documents")
def b05_summary_sample(spark, d):
    return docs_of(spark, d).select("doc_id", T.summary_sample(F.col("text")).alias("sample"))


@query(r"""SELECT doc_id, 'From ''' || source || ''': ' || left(text, 200) || '...' AS context, 'From ''' || source || ''': ' || left(text, 200) || E'...\n\n' || lang AS whole,
  'From ''' || source || ''': ' || left(text, 150) || '... This table appears in the document.' AS of_table FROM documents""")
def b06_template_context(spark, d):
    context = T.template_context(F.col("source"), F.col("text"))
    return docs_of(spark, d).select("doc_id", context.alias("context"), T.contextualized(context, F.col("lang")).alias("whole"), T.element_context(F.col("source"), F.col("text"), "table").alias("of_table"))


CONV_TEXTS = "conv AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY 1)"


def conv_texts(spark, d):
    rows = W.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return rows.select("conv_id", F.transform("l", lambda x: x["text"]).alias("l"))


@query(with_(CONV_TEXTS) + "SELECT conv_id, array_to_string(list_transform(l[1:3], lambda t: string_split(t, '.')[1] || '.'), ' ') AS summary FROM conv")
def b07_first_sentences(spark, d):
    return conv_texts(spark, d).select("conv_id", T.first_sentences(F.col("l")).alias("summary"))


@query(with_(CONV_TEXTS) + r"SELECT conv_id, CASE WHEN length(t) > 2000 THEN left(t, 2000) || '...' ELSE t END AS combined FROM (SELECT conv_id, array_to_string(l, E'\n\n---\n\n') AS t FROM conv)")
def b08_combine_texts(spark, d):
    return conv_texts(spark, d).select("conv_id", T.combine_texts(F.col("l")).alias("combined"))


@query(with_(NODES) + "SELECT node_id, concat(document_id, '_L', layer, CASE WHEN is_summary THEN '_summary' ELSE '_chunk' END, chunk_index) AS name, concat('L', layer + 1, '_C', chunk_index % 7) AS cluster FROM nodes")
def b09_node_id(spark, d):
    return W.nodes(spark, d).select(
        "node_id", T.node_id(F.col("document_id"), F.col("layer"), F.col("chunk_index"), F.col("is_summary")).alias("name"), T.cluster_id(F.col("layer"), F.col("chunk_index") % 7).alias("cluster")
    )


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(CAST(CAST(round(n / pow(1024.0, p), 2) AS DECIMAL(20, 2)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][p + 1] END AS size
  FROM (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE least(3, CAST(floor(log2(n) / 10) AS INT)) END AS p FROM (SELECT doc_id, n_chars * n_chars * (doc_id % 4) AS n FROM documents))""")
def b10_format_bytes(spark, d):
    return docs_of(spark, d).select("doc_id", T.format_bytes(F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 4)).alias("size"))


# ---- C: chunking

HIST_SQL = "list_transform(range(97, 123), lambda c: CAST(length(lower({t})) - length(replace(lower({t}), chr(CAST(c AS INT)), '')) AS DOUBLE))"
GROUPED = f"""{SENTS},
glists AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN [''] ELSE list_transform(range(0, CAST(ceil(len(s) / 3) AS BIGINT)), lambda i: array_to_string(s[i * 3 + 1 : i * 3 + 3], ' ')) END AS g FROM sents),
grp AS (SELECT doc_id, unnest(g) AS text, generate_subscripts(g, 1) - 1 AS pos FROM glists),
hist AS (SELECT *, {HIST_SQL.format(t="text")} AS v FROM grp),
norms AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv, lag(v) OVER w AS pv FROM hist WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
gsim AS (SELECT doc_id, pos, text, CASE WHEN pv IS NULL THEN NULL WHEN nv = 0 OR list_sum(pv) = 0 THEN 0 ELSE list_cosine_similarity(v, pv) END AS sim FROM norms)"""
FOLDED = """fold AS (
  SELECT doc_id, pos, text AS cur, length(text) // 4 AS n, 0 AS chunk FROM gsim WHERE pos = 0
  UNION ALL
  SELECT g.doc_id, g.pos, CASE WHEN round(g.sim, 12) < 0.7 OR f.n + length(g.text) // 4 > 500 THEN g.text ELSE f.cur || ' ' || g.text END,
    CASE WHEN round(g.sim, 12) < 0.7 OR f.n + length(g.text) // 4 > 500 THEN length(g.text) // 4 ELSE f.n + length(g.text) // 4 END,
    f.chunk + CASE WHEN round(g.sim, 12) < 0.7 OR f.n + length(g.text) // 4 > 500 THEN 1 ELSE 0 END
  FROM fold f JOIN gsim g ON g.doc_id = f.doc_id AND g.pos = f.pos + 1),
raw AS (SELECT doc_id, chunk, arg_max(cur, pos) AS text FROM fold GROUP BY ALL)"""
MERGED = """mfold AS (
  SELECT doc_id, chunk AS pos, text AS cur, 0 AS m FROM raw WHERE chunk = 0
  UNION ALL
  SELECT r.doc_id, r.chunk, CASE WHEN length(f.cur) // 4 < 100 THEN f.cur || ' ' || r.text ELSE r.text END, f.m + CASE WHEN length(f.cur) // 4 < 100 THEN 0 ELSE 1 END
  FROM mfold f JOIN raw r ON r.doc_id = f.doc_id AND r.chunk = f.pos + 1),
merged AS (SELECT doc_id, m AS chunk_index, arg_max(cur, pos) AS text FROM mfold GROUP BY ALL)"""
OVERLAPPED = """chunks AS (SELECT doc_id, chunk_index, concat_ws(' ... ', right(lag(text) OVER w, 200), text, left(lead(text) OVER w, 200)) AS chunk
  FROM merged WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))"""


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def groups_of(spark, d):
    rows = docs_of(spark, d).select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", C.group_sentences(F.col("s")).alias("g"))
    return rows.withColumn("v", F.transform("g", V.letter_histogram)).withColumn("sims", C.adjacent_similarity(F.col("v")))


@query(with_(GROUPED) + "SELECT doc_id, pos, text FROM grp", ints="pos")
def c01_group_sentences(spark, d):
    return groups_of(spark, d).select("doc_id", F.posexplode_outer("g").alias("pos", "text"))


@query(with_(GROUPED) + "SELECT doc_id, pos, round(sim, 6) AS sim FROM gsim", ints="pos")
def c02_adjacent_similarity(spark, d):
    return groups_of(spark, d).select("doc_id", F.posexplode_outer("sims").alias("pos", "s")).select("doc_id", "pos", F.round("s", 6).alias("sim"))


def raw_chunks(spark, d):
    return groups_of(spark, d).select("doc_id", C.fold_boundaries(F.col("g"), F.col("sims")).alias("r"))


@query(recursive(GROUPED, FOLDED) + "SELECT doc_id, chunk, text FROM raw", ints="chunk")
def c03_boundary_fold(spark, d):
    return raw_chunks(spark, d).select("doc_id", F.posexplode_outer("r").alias("chunk", "text"))


@query(recursive(GROUPED, FOLDED, MERGED) + "SELECT doc_id, chunk_index, text FROM merged", ints="chunk_index")
def c04_merge_small(spark, d):
    return raw_chunks(spark, d).select("doc_id", F.posexplode_outer(C.merge_small(F.col("r"))).alias("chunk_index", "text"))


@query(with_(CONV_TEXTS, "merged AS (SELECT conv_id AS doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS chunk_index FROM conv)", OVERLAPPED) + "SELECT doc_id AS conv_id, chunk_index, chunk FROM chunks", ints="chunk_index")
def c05_add_overlap(spark, d):
    return conv_texts(spark, d).select("conv_id", F.posexplode_outer(C.add_overlap(F.col("l"))).alias("chunk_index", "chunk"))


@query(recursive(GROUPED, FOLDED, MERGED, OVERLAPPED) + "SELECT doc_id, chunk_index, chunk FROM chunks", ints="chunk_index")
def c06_chunk_text(spark, d):
    return C.chunk_text(docs_of(spark, d), "doc_id", spread=True)


SUMMARIES_SQL = "sums AS (SELECT doc_id, array_to_string(list_transform(s[1:3], lambda t: string_split(t, '.')[1] || '.'), ' ') AS summary FROM sents)"
CONTEXT_SQL = "ctx AS (SELECT c.doc_id, chunk_index, chunk, 'From ''' || c.doc_id || ''': ' || left(summary, 200) || '...' AS context FROM chunks c JOIN sums USING (doc_id))"


@query(recursive(GROUPED, FOLDED, MERGED, OVERLAPPED, SUMMARIES_SQL, CONTEXT_SQL) + r"SELECT doc_id, chunk_index, chunk AS original, context || E'\n\n' || chunk AS contextualized, context FROM ctx", ints="chunk_index")
def c07_contextualize(spark, d):
    docs = docs_of(spark, d)
    return C.contextualize(C.chunk_text(docs, "doc_id"), A.summaries_of(docs, "doc_id"), "doc_id")


@query(recursive(GROUPED, FOLDED, MERGED, OVERLAPPED, SUMMARIES_SQL, CONTEXT_SQL) + r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, idx) - 1 AS chunk_index, content_type, ref_id, contextualized FROM (
  SELECT doc_id, 0 AS rank, chunk_index AS idx, 'text' AS content_type, NULL AS ref_id, context || E'\n\n' || chunk AS contextualized FROM ctx
  UNION ALL SELECT conv_id, CASE role WHEN 'user' THEN 1 ELSE 2 END, turn, CASE role WHEN 'user' THEN 'table' ELSE 'image' END, 'r' || turn,
    'From ''' || conv_id || ''': ' || left(coalesce(summary, ''), 150) || '... This ' || CASE role WHEN 'user' THEN 'table' ELSE 'image' END || E' appears in the document.\n\n' || text
  FROM conversations LEFT JOIN sums ON doc_id = conv_id)""", ints="chunk_index")
def c08_structured_chunks(spark, d):
    docs = docs_of(spark, d)
    turns = W.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("ref_id"), F.col("turn").cast("int").alias("idx"), F.col("text").alias("content"), "role")
    made = C.structured_chunks(
        C.chunk_text(docs, "doc_id"), turns.filter("role = 'user'").drop("role"), turns.filter("role <> 'user'").drop("role"), A.summaries_of(docs, "doc_id"), "doc_id"
    )
    return made.select("doc_id", "chunk_index", "content_type", "ref_id", "contextualized")


GROUPED_MARKED = GROUPED.replace(SENTS, MARKED + ",\n" + SENTS.replace("doc_id, ", "document_id AS doc_id, ", 1).replace("FROM documents", "FROM marked"))


@query(recursive(GROUPED_MARKED, FOLDED, MERGED, OVERLAPPED) + r"""SELECT document_id, length(text) AS n_chars, n_chunks, n_images, n_tables, n_chunks < 10 AS few_chunks FROM marked JOIN (
  SELECT doc_id AS document_id, count(*) AS n_chunks, sum(len(regexp_extract_all(chunk, '\[IMAGE\s+([^\s:]+):', 1)))::BIGINT AS n_images,
    sum(len(regexp_extract_all(chunk, '\[TABLE\s+([^\s:]+):', 1)))::BIGINT AS n_tables FROM chunks GROUP BY 1) USING (document_id)""", ints="n_chars")
def a13_ingest_report(spark, d):
    return A.ingest(W.marked(spark, d), spread=True)[1]


# ---- D: vectors


@query()
def d01_embed_hashed(spark, d):
    """Vectors of all documents by the default embedder: hashed words and inverse document frequency."""
    from grovework.operators.embedding import embed

    rows = embed(docs_of(spark, d).select("doc_id", "text"), id_col="doc_id", text="text")
    filled = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), F.round(x, 6).alias("x"))), lambda e: e["x"] > 0)
    return rows.select("doc_id", F.array_join(F.transform(filled, lambda e: F.concat_ws(":", e["i"].cast("string"), e["x"].cast("string"))), " ").alias("embedding"))


@query(f"SELECT doc_id, array_to_string(list_transform({HIST_SQL.format(t='text')}, lambda x: CAST(x AS BIGINT)), ',') AS v FROM documents")
def d01_embed_by_hook(spark, d):
    """A mapInPandas embedder stands in for a model: it counts letters."""
    import pandas as pd

    from grovework.operators.embedding import embed, letter_counts

    def embedder(frames):
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "embedding": list(letter_counts(pdf.text.fillna("").to_list()))})

    rows = embed(docs_of(spark, d).select("doc_id", "text"), embedder, "doc_id", "text")
    return rows.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",").alias("v"))


@query(f"SELECT doc_id, array_to_string(list_transform({HIST_SQL.format(t='text')}, lambda x: CAST(x AS BIGINT)), ',') AS v FROM documents")
def d01_embed_letters(spark, d):
    v = F.transform(V.letter_histogram(F.col("text")), lambda x: x.cast("bigint").cast("string"))
    return docs_of(spark, d).select("doc_id", F.array_join(v, ",").alias("v"))


ADJACENT = "pairs AS (SELECT node_id, document_id, embedding AS v, lead(embedding) OVER (PARTITION BY document_id ORDER BY node_id) AS w FROM nodes)"


def adjacent(spark, d):
    lead = F.lead("embedding").over(Window.partitionBy("document_id").orderBy("node_id"))
    return W.nodes(spark, d).select("node_id", F.col("embedding").alias("v"), lead.alias("w")).filter("w is not null")


@query(with_(NODES, ADJACENT) + "SELECT node_id, round(list_cosine_similarity(v, w), 6) AS cosine FROM pairs WHERE w IS NOT NULL")
def d02_cosine_similarity(spark, d):
    return adjacent(spark, d).select("node_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query(with_(NODES, ADJACENT) + "SELECT node_id, round(list_distance(v, w) ^ 2, 6) AS distance FROM pairs WHERE w IS NOT NULL")
def d03_l2_distance(spark, d):
    return adjacent(spark, d).select("node_id", F.round(V.squared_l2(F.col("v"), F.col("w")), 6).alias("distance"))


@query(with_(NODES) + "SELECT a.document_id, a.node_id AS a, b.node_id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS sim FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND a.node_id < b.node_id")
def d04_pairwise_similarity(spark, d):
    return GR.pairwise(W.nodes(spark, d)).withColumn("sim", F.round("sim", 6))


@query()
def d05_reduce_dimensions(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = G.reduce_dimensions(W.nodes(spark, d))
    return rows.select("node_id", F.transform(vector_to_array("reduced"), lambda x: F.round(F.abs(x), 4)).alias("reduced"))


@query()
def d06_approx_top_k(spark, d):
    """The index is built over all nodes and searched by all questions; tests hold its recall."""
    from grovework.operators import index as N

    nodes = W.nodes(spark, d)
    found = N.search(W.questions(spark, d), N.build(nodes, GR.shared_path(nodes, "index")), 10)
    return found.select("query_id", "node_id", F.round("distance", 6).alias("distance"), "rank")


# ---- E: entities


@query(with_(NODES, ENTS) + "SELECT node_id, name, type, importance, rank FROM ents", ints="rank")
def e01_extract_entities(spark, d):
    return W.entities(spark, d)


@query(with_(NODES, ENTS, NAMES) + r"""SELECT node_id, CASE WHEN chunk_index % 2 = 1 AND regexp_matches(text, '\S') THEN regexp_extract(text, '\S+') ELSE entity_names END AS entity_names FROM described""")
def e02_extract_by_hook(spark, d):
    """The hook finds no entities for every other node, where the rules stand in."""
    import pandas as pd

    def hook(frames):
        for pdf in frames:
            words = pdf.text.fillna("").str.split()
            own = [[{"name": w[0], "type": "first", "importance": 5}] if w and k % 2 else None for k, w in zip(pdf.node_id.astype(int), words)]
            yield pd.DataFrame({"node_id": pdf.node_id, "text": pdf.text, "own": own})

    return E.with_entities(W.nodes(spark, d), hook).select("node_id", "entity_names")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN '' WHEN doc_id % 9 NOT IN (3, 5, 7) THEN source || '|' || CASE doc_id % 9 WHEN 0 THEN 'person' ELSE 'other' END || '|' ||
  CASE doc_id % 9 WHEN 2 THEN 5 WHEN 4 THEN 7 WHEN 6 THEN 8 ELSE least(10, greatest(1, n_chars)) END || ',' || lang || '|tech|5' END AS entities FROM documents""")
def e03_parse_entity_json(spark, d):
    """Plain, fenced, without importance, no JSON; importances 7.6, "high", "8"; an object; elements that are none."""
    k = F.col("doc_id") % 9
    given = F.when(k.isin(0, 1), F.concat(F.lit(', "importance": '), F.col("n_chars").cast("string"))).when(k == 4, ', "importance": 7.6').when(k == 5, ', "importance": "high"').when(k == 6, ', "importance": " 8"')
    one = F.concat(F.lit('{"name": " '), "source", F.lit(' "'), F.when(k == 0, ', "type": "Person"').otherwise(""), F.coalesce(given, F.lit("")), F.lit("}"))
    answer = F.concat(F.lit('[7, "x", null, '), one, F.lit(', {"type": "x"}, {"name": "'), "lang", F.lit('", "type": "TECH"}]'))
    answer = F.when(k == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(k == 3, F.concat(F.lit("sorry: "), answer)).when(k == 7, one).when(k == 8, '[1, 2, "three"]').otherwise(answer)
    line = lambda e: F.concat_ws("|", e["name"], e["type"], e["importance"].cast("string"))
    return docs_of(spark, d).select("doc_id", F.array_join(F.transform(E.parse_entity_json(answer), line), ",").alias("entities"))


@query(with_(NODES, ENTS) + """SELECT document_id, first AS pos, name, importance FROM (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY importance DESC, pos) AS best, min(pos) OVER (PARTITION BY document_id, key) AS first
  FROM (SELECT document_id, lower(name) AS key, name, importance, chunk_index * 100 + rank AS pos FROM ents JOIN nodes USING (node_id))) WHERE best = 1""", ints="pos")
def e04_dedupe_exact(spark, d):
    rows = W.entities(spark, d).join(W.nodes(spark, d).select("node_id", "document_id", "chunk_index"), "node_id")
    rows = rows.withColumn("pos", F.col("chunk_index") * 100 + F.col("rank"))
    return E.dedupe_exact(rows.select("document_id", "pos", "name", "type", "importance")).select("document_id", "pos", "name", "importance")


@query("WITH RECURSIVE " + ",\n".join((NODES, ENTS, f"""cand AS (SELECT node_id, CAST(rank AS INT) AS pos, name, importance, {HIST_SQL.format(t="name")} AS v, count(*) OVER (PARTITION BY node_id) AS n FROM ents),
like_pairs AS (SELECT a.node_id, a.pos AS a, b.pos AS b, a.importance AS ia, b.importance AS ib, row_number() OVER (PARTITION BY a.node_id ORDER BY a.pos, b.pos) AS k
  FROM cand a JOIN cand b ON a.node_id = b.node_id AND a.pos < b.pos WHERE a.n > 5 AND list_cosine_similarity(a.v, b.v) > 0.85),
greedy AS (SELECT DISTINCT node_id, 0::BIGINT AS k, []::INT[] AS gone FROM like_pairs
  UNION ALL SELECT g.node_id, p.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN ia >= ib THEN b ELSE a END) END
  FROM greedy g JOIN like_pairs p ON p.node_id = g.node_id AND p.k = g.k + 1),
removed AS (SELECT node_id, unnest(arg_max(gone, k)) AS pos FROM greedy GROUP BY 1)""")) + """
SELECT node_id, pos, name, importance FROM cand ANTI JOIN removed USING (node_id, pos)""")
def e05_dedupe_similar(spark, d):
    rows = W.entities(spark, d).withColumn("embedding", V.letter_histogram(F.col("name"))).withColumn("pos", F.col("rank").cast("int"))
    return E.dedupe_similar(rows.select("node_id", "pos", "name", "importance", "embedding"), "node_id").select("node_id", "pos", "name", "importance")


@query(with_(QUESTIONS, ASKED) + "SELECT query_id, pos - 1 AS pos, name FROM qents", ints="pos")
def e06_query_entities(spark, d):
    return E.query_entities(W.questions(spark, d).select("query_id", "question"))


@query(with_(NODES, ENTS, NAMES) + "SELECT node_id, entity_names FROM described")
def e07_entity_names(spark, d):
    return W.described(spark, d).select("node_id", "entity_names")


@query(with_(NODES, ENTS, INDEX) + "SELECT * FROM idx")
def e08_entity_index(spark, d):
    return W.index(spark, d)


@query(with_(NODES, ENTS, INDEX, QUESTIONS, ASKED) + "SELECT DISTINCT document_id, node_id FROM idx WHERE entity IN (SELECT lower(name) FROM qents)")
def e09_nodes_by_entity(spark, d):
    return E.nodes_by_entity(W.index(spark, d), E.query_entities(W.questions(spark, d)))


@query(with_(NODES, ENTS, NAMES) + """SELECT document_id, n_lower, n_names FROM (SELECT document_id, count(DISTINCT lower(name)) AS n_lower FROM ents JOIN nodes USING (node_id) GROUP BY 1)
  JOIN (SELECT document_id, count(DISTINCT e) FILTER (e <> '') AS n_names FROM (SELECT document_id, unnest(string_split(entity_names, ',')) AS e FROM described) GROUP BY 1) USING (document_id)""")
def e10_unique_entities(spark, d):
    lower = W.entities(spark, d).join(W.nodes(spark, d), "node_id").groupBy("document_id").agg(F.countDistinct(F.lower("name")).alias("n_lower"))
    names = W.described(spark, d).select("document_id", F.explode(F.split("entity_names", ",")).alias("e")).filter("e <> ''")
    return lower.join(names.groupBy("document_id").agg(F.countDistinct("e").alias("n_names")), "document_id")


@query(with_(NODES, ENTS) + """SELECT document_id, cluster, rank, name, importance, n FROM (SELECT *, row_number() OVER (PARTITION BY document_id, cluster ORDER BY importance * n DESC, seen) AS rank FROM (
  SELECT document_id, chunk_index % 4 AS cluster, lower(name) AS key, count(*) AS n, max(importance) AS importance, arg_min(name, node_id || lpad(CAST(rank AS VARCHAR), 3, '0')) AS name,
    min(node_id || lpad(CAST(rank AS VARCHAR), 3, '0')) AS seen FROM ents JOIN nodes USING (node_id) GROUP BY ALL)) WHERE rank <= 15""", ints="rank")
def e11_cluster_entities(spark, d):
    clusters = W.nodes(spark, d).select("document_id", "node_id", (F.col("chunk_index") % 4).alias("cluster"))
    return E.cluster_entities(W.entities(spark, d), clusters).select("document_id", "cluster", "rank", "name", "importance", "n")


# ---- F: graph


@query(with_(NODES, ENTS, NAMES) + "SELECT node_id, document_id, layer, entity_names FROM described")
def f01_graph_nodes(spark, d):
    return W.described(spark, d).select("node_id", "document_id", "layer", "entity_names")


@query(with_(NODES, ENTS, EDGES) + "SELECT document_id, a, b, round(score, 6) AS score FROM overlap")
def f02_entity_overlap(spark, d):
    return GR.entity_overlap(W.entities(spark, d), W.nodes(spark, d)).withColumn("score", F.round("score", 6))


def edges_of(spark, d):
    return GR.build_edges(W.nodes(spark, d), W.entities(spark, d))


def nearest_of(spark, d):
    return GR.nearest_edges(W.nodes(spark, d), W.entities(spark, d))


@query(with_(NODES, ENTS, EDGES) + "SELECT document_id, src, dst, round(weight, 6) AS weight FROM edges")
def f03_build_edges(spark, d):
    return edges_of(spark, d).withColumn("weight", F.round("weight", 6))


@query(with_(NODES, ENTS, EDGES) + "SELECT document_id, src, dst, rank FROM top3", ints="rank")
def f04_top_neighbours(spark, d):
    return nearest_of(spark, d).select("document_id", "src", "dst", "rank")


EXPANDED = """near AS (SELECT query_id, node_id, document_id FROM (SELECT query_id, n.node_id, n.document_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(n.embedding, q.embedding), n.node_id) AS rn
  FROM questions q JOIN nodes n USING (document_id)) WHERE rn <= 5),
hop1 AS (SELECT DISTINCT query_id, document_id, dst AS node_id FROM near JOIN top3 USING (document_id) WHERE src = near.node_id AND NOT EXISTS (SELECT 1 FROM near x WHERE x.query_id = near.query_id AND x.node_id = dst)),
hop2 AS (SELECT DISTINCT h.query_id, h.document_id, dst AS node_id FROM hop1 h JOIN top3 USING (document_id) WHERE src = h.node_id),
reached AS (SELECT query_id, node_id FROM (SELECT query_id, node_id FROM hop1 UNION SELECT query_id, node_id FROM hop2) EXCEPT SELECT query_id, node_id FROM near)"""


def seeds_of(spark, d):
    near = R.ranked(R.candidates(W.questions(spark, d).filter("document_id is not null"), W.nodes(spark, d)), 5, "distance", "node_id")
    return near.select("query_id", "document_id", "node_id")


@query(with_(NODES, ENTS, EDGES, QUESTIONS, EXPANDED) + "SELECT query_id, node_id FROM reached")
def f05_expand(spark, d):
    return GR.expand(seeds_of(spark, d), nearest_of(spark, d).drop("rank")).select("query_id", "node_id")


KNN = """both_sims AS (SELECT document_id, a AS src, b AS dst, sim FROM sims UNION ALL SELECT document_id, b, a, sim FROM sims),
knn AS (SELECT document_id, src AS a, dst AS b, sim FROM (SELECT *, row_number() OVER (PARTITION BY document_id, src ORDER BY sim DESC, dst) AS rn FROM both_sims) WHERE rn <= 10 AND sim > 0.3 AND src < dst)"""


@query(with_(NODES, ENTS, EDGES, KNN) + "SELECT document_id, a, b, round(sim, 6) AS sim FROM knn")
def f06_knn_graph(spark, d):
    return GR.knn_graph(W.nodes(spark, d)).withColumn("sim", F.round("sim", 6))


@query()
def f06_knn_descent(spark, d):
    """Approximate: tests hold its recall against f06_knn_graph."""
    from grovework.operators.descent import approximate_knn_graph

    return approximate_knn_graph(W.nodes(spark, d)).withColumn("sim", F.round("sim", 6))


@query(with_(NODES, ENTS, EDGES) + "SELECT document_id, count(*) // 2 AS n_edges FROM edges GROUP BY 1")
def f07_edge_stats(spark, d):
    return GR.edge_stats(edges_of(spark, d))


@query(with_(NODES, ENTS, EDGES, "names AS (SELECT DISTINCT document_id, node_id, lower(name) AS entity FROM ents JOIN nodes USING (node_id))", "sizes AS (SELECT node_id, count(*) AS n FROM names GROUP BY 1)") + """
SELECT document_id, a, b, round(sim, 6) AS sim FROM (SELECT s.document_id, s.a, s.b, 0.7 * s.sim + 0.3 * coalesce(j.s / (x.n + y.n - j.s), 0) AS sim FROM sims s
  LEFT JOIN (SELECT a.document_id, a.node_id AS a, b.node_id AS b, count(*) AS s FROM names a JOIN names b ON a.document_id = b.document_id AND a.entity = b.entity AND a.node_id < b.node_id GROUP BY ALL) j USING (document_id, a, b)
  LEFT JOIN sizes x ON x.node_id = s.a LEFT JOIN sizes y ON y.node_id = s.b) WHERE sim > 0.3""")
def f08_combined_similarity(spark, d):
    return GR.combined_similarity(W.nodes(spark, d), W.entities(spark, d)).withColumn("sim", F.round("sim", 6))


# ---- G: clusters


@query(with_(NODES, PLANTED) + "SELECT document_id, node_id, dense_rank() OVER (PARTITION BY document_id ORDER BY low) - 1 AS cluster FROM (SELECT *, min(node_id) OVER (PARTITION BY document_id, block) AS low FROM planted)", ints="cluster")
def g01_communities(spark, d):
    return G.similar_communities(W.planted(spark, d), 0.3)


@query(with_(NODES) + "SELECT layer, round(pow(0.7, layer), 6) AS resolution, count(*) AS n FROM nodes GROUP BY layer")
def g02_layer_resolution(spark, d):
    rows = W.nodes(spark, d).groupBy("layer").agg(F.count("*").alias("n"))
    return rows.select("layer", F.round(G.RESOLUTION * F.pow(F.lit(G.DECAY), F.col("layer")), 6).alias("resolution"), "n")


PLANTED_CLUSTERS = "SELECT document_id, node_id, dense_rank() OVER (PARTITION BY document_id ORDER BY low) - 1 AS cluster{more} FROM (SELECT *, min(node_id) OVER (PARTITION BY document_id, block) AS low FROM planted)"


@query(with_(NODES, PLANTED) + PLANTED_CLUSTERS.format(more=""), ints="cluster")
def g03_knn_communities(spark, d):
    return G.knn_communities(W.planted(spark, d))


BLOCKS = "clusters AS (SELECT document_id, node_id, block AS cluster FROM planted)"


@query(with_(NODES, PLANTED, BLOCKS) + """SELECT document_id, node_id, cluster, 1.0 AS weight FROM clusters UNION ALL
  SELECT document_id, node_id, cluster, round(weight, 6) FROM (SELECT a.document_id, a.node_id, c.cluster, avg(list_cosine_similarity(a.embedding, b.embedding)) AS weight, any_value(a.block) AS own
    FROM planted a JOIN planted b ON a.document_id = b.document_id AND a.node_id <> b.node_id JOIN clusters c ON c.node_id = b.node_id GROUP BY ALL) WHERE weight > 0.02 AND cluster <> own""")
def g04_soft_membership(spark, d):
    rows = W.planted(spark, d)
    return G.soft_membership(rows, rows.select("document_id", "node_id", F.col("block").alias("cluster")), 0.02).withColumn("weight", F.round("weight", 6))


@query()
def g05_select_k(spark, d):
    reduced = G.reduced_table(W.planted(spark, d))
    best, found = G.select_k(reduced)
    return reduced.groupBy("document_id").agg(F.count("*").alias("n")).withColumn("k", F.lit(best))


@query()
def g06_cluster_gmm(spark, d):
    return G.cluster_gmm(W.planted(spark, d), soft=True).withColumn("weight", F.round("weight", 3))


@query(with_(NODES, PLANTED) + PLANTED_CLUSTERS.format(more=", 1.0 AS weight"), ints="cluster", doubles="weight")
def g07_cluster_adaptive(spark, d):
    return G.cluster_adaptive(W.planted(spark, d), W.entities(spark, d), method="communities", stand_in=False).drop("method")


@query()
def g07_cluster_adaptive_mixture(spark, d):
    rows = G.cluster_adaptive(W.planted(spark, d), W.entities(spark, d), method="mixture", soft=True).drop("method")
    return rows.withColumn("weight", F.round("weight", 3))


@query(with_(NODES, PLANTED, BLOCKS) + "SELECT document_id, cluster, count(*) AS n FROM clusters GROUP BY ALL")
def g08_membership(spark, d):
    return G.cluster_sizes(G.membership(W.planted(spark, d).select("document_id", "node_id", F.col("block").alias("cluster"))))


# ---- H: trees


@query(with_(NODES, ENTS, NAMES) + "SELECT node_id, document_id, entity_names FROM described WHERE layer = 0")
def h01_layer_nodes(spark, d):
    return H.layer_nodes(W.described(spark, d), 0).select("node_id", "document_id", "entity_names")


def by_block(nodes, entities, layer):
    number = F.regexp_extract("node_id", r"(\d+)$", 1).cast("int")
    return nodes.select("document_id", "node_id", (number % 4).alias("cluster"))


@query(with_(NODES) + """SELECT document_id, chunk_index % 4 AS cluster, array_to_string(list_transform(list(text ORDER BY chunk_index)[1:3], lambda t: string_split(t, '.')[1] || '.'), ' ') AS text, count(*) AS n_children
  FROM nodes WHERE layer = 0 GROUP BY ALL HAVING count(*) >= 2""", ints="n_children")
def h02_summarize_clusters(spark, d):
    base = H.layer_nodes(W.described(spark, d), 0)
    made = H.summarize(base, by_block(base, None, 0), 0)
    return made.select("document_id", F.regexp_extract("cluster_id", r"C(\d+)$", 1).cast("int").alias("cluster"), "text", F.size("child_ids").alias("n_children"))


@query(with_(NODES, ENTS, NAMES) + r"""SELECT document_id, cluster, CASE WHEN failed THEN plain ELSE coalesce(keys, '') || ' / ' || CASE WHEN length(t) > 2000 THEN left(t, 2000) || '...' ELSE t END END AS text, failed FROM (
  SELECT document_id, chunk_index % 4 AS cluster, string_agg(text, E'\n\n---\n\n' ORDER BY chunk_index) AS t, (min(chunk_index) // 4) % 2 = 1 AS failed,
    array_to_string(list_transform(list(text ORDER BY chunk_index)[1:3], lambda t: string_split(t, '.')[1] || '.'), ' ') AS plain
  FROM nodes WHERE layer = 0 GROUP BY ALL HAVING count(*) >= 2) LEFT JOIN (SELECT document_id, cluster, string_agg(name, ', ' ORDER BY rank) AS keys FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id, cluster ORDER BY importance * n DESC, seen) AS rank FROM (
      SELECT document_id, chunk_index % 4 AS cluster, lower(name) AS key, count(*) AS n, max(importance) AS importance, arg_min(name, (node_id, rank)) AS name, min((node_id, rank)) AS seen
      FROM ents JOIN nodes USING (node_id) WHERE layer = 0 GROUP BY ALL)) WHERE rank <= 10 GROUP BY ALL) USING (document_id, cluster)""")
def h02_summarize_by_hook(spark, d):
    """The summarizer joins its two inputs. It raises for every other text, where first sentences stand in."""
    base = H.layer_nodes(W.described(spark, d), 0)
    bad = base.groupBy("document_id", (F.col("chunk_index") % 4).alias("cluster")).agg(F.min("chunk_index").alias("first")).filter(F.floor(F.col("first") / 4) % 2 == 1)
    sick = {(r.document_id, r.cluster) for r in bad.collect()}  # four of each document, for this test's hook

    def summarizer(frames):
        import pandas as pd

        for pdf in frames:
            if any(k in sick for k in zip(pdf.document_id, pdf.cluster)):
                raise ValueError("no answer")
            yield pd.DataFrame({"document_id": pdf.document_id, "cluster": pdf.cluster, "text": pdf.key_entities + " / " + pdf.text})

    made = H.summarize(base, by_block(base, None, 0), 0, summarizer)
    return made.select("document_id", F.regexp_extract("cluster_id", r"C(\d+)$", 1).cast("int").alias("cluster"), "text", F.col("summary_failed").alias("failed"))


def summaries_sql(layer: int) -> str:
    """One layer of trees over planted vectors: blocks are the clusters, documents of fewer than three nodes have none."""
    return f"""m{layer} AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS of_document FROM t{layer}),
c{layer} AS (SELECT document_id, block, array_to_string(list_transform(list(text ORDER BY chunk_index)[1:3], lambda t: string_split(t, '.')[1] || '.'), ' ') AS text, string_agg(node_id, ',' ORDER BY chunk_index) AS kids,
  dense_rank() OVER (PARTITION BY document_id ORDER BY min(node_id)) - 1 AS cluster FROM m{layer} WHERE of_document >= 3 GROUP BY document_id, block HAVING count(*) >= 2),
e{layer} AS (SELECT document_id, block, string_agg(name, ',' ORDER BY rank) AS entity_names FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, block ORDER BY importance * n DESC, seen) AS rank FROM (
    SELECT document_id, block, lower(name) AS key, count(*) AS n, max(importance) AS importance, arg_min(name, (node_id, rank)) AS name, min((node_id, rank)) AS seen FROM ents JOIN t{layer} USING (node_id) GROUP BY ALL))
  WHERE rank <= 10 GROUP BY ALL),
t{layer + 1} AS (SELECT concat(document_id, '_L{layer + 1}_summary', row_number() OVER (PARTITION BY document_id ORDER BY cluster) - 1) AS node_id, document_id, {layer + 1} AS layer, text, coalesce(entity_names, '') AS entity_names, kids
  FROM c{layer} LEFT JOIN e{layer} USING (document_id, block))"""


PLANTED_BASE = "t0 AS (SELECT node_id, document_id, layer, chunk_index, block, text FROM planted WHERE layer = 0)"


@query(with_(NODES, ENTS, PLANTED, PLANTED_BASE, summaries_sql(0)) + "SELECT * FROM t1", ints="layer")
def h03_build_layer(spark, d):
    base = E.with_entities(W.planted(spark, d).filter("layer = 0").drop("block"))
    made = H.build_layer(base, 0, lambda nodes, entities, layer: G.similar_communities(nodes, 0.3))
    return made.select("node_id", "document_id", "layer", "text", "entity_names", F.array_join("child_ids", ",").alias("kids"))


@query()
def h04_build_tree(spark, d):
    base = W.planted(spark, d).filter("layer = 0").drop("block")
    tree, _ = H.build_tree(E.with_entities(base))
    return tree.select("node_id", "document_id", "layer", "text", "entity_names", F.array_join("child_ids", ",").alias("kids"))


@query(with_(NODES, ENTS, NAMES, PLANTED, PLANTED_BASE, summaries_sql(0)) + """SELECT node_id, document_id, layer, text, entity_names, '' AS kids FROM described WHERE layer = 0 UNION ALL SELECT * FROM t1""", ints="layer")
def h04_tree_of_planted(spark, d):
    """The whole of `build_tree` without given clusters or entities, one layer high; the communities are those planted."""
    base = W.planted(spark, d).filter("layer = 0").drop("block")
    tree, _ = H.build_tree(base, max_depth=1, cluster=lambda nodes, entities, layer: G.similar_communities(nodes, 0.3))
    return tree.select("node_id", "document_id", "layer", "text", "entity_names", F.array_join("child_ids", ",").alias("kids"))


@query(with_(NODES, "base AS (SELECT * FROM nodes WHERE layer = 0 AND document_id IN (SELECT document_id FROM nodes WHERE layer = 2))") + """SELECT document_id, 0 AS layer, count(*) AS n FROM base GROUP BY 1
  UNION ALL SELECT document_id, 1, count(*) FROM (SELECT document_id, chunk_index % 4 AS block FROM base GROUP BY ALL HAVING count(*) >= 2)
  WHERE document_id IN (SELECT document_id FROM base GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1""", ints="layer")
def h05_rebuild_tree(spark, d):
    nodes = E.with_entities(W.planted(spark, d).drop("block"))
    wanted = nodes.filter("layer = 2").select("document_id")
    return H.rebuild_tree(nodes, wanted, cluster=by_block)[0].groupBy("document_id", "layer").agg(F.count("*").alias("n"))


@query(with_(NODES, ENTS, NAMES, EDGES) + """SELECT document_id, n_nodes, depth, layers, coalesce(n_entities, 0) AS n_entities, coalesce(n_edges, 0) AS n_edges
  FROM (SELECT document_id, count(*) AS n_nodes, max(layer) + 1 AS depth FROM nodes GROUP BY 1)
  JOIN (SELECT document_id, string_agg(layer || ':' || n, ',' ORDER BY layer) AS layers FROM (SELECT document_id, layer, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT document_id, count(DISTINCT e) AS n_entities FROM (SELECT document_id, unnest(string_split(entity_names, ',')) AS e FROM described) WHERE e <> '' GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) // 2 AS n_edges FROM edges GROUP BY 1) USING (document_id)""")
def h06_tree_stats(spark, d):
    return H.tree_stats(W.described(spark, d), edges_of(spark, d))


@query(with_(NODES, CHILD_EDGES) + "SELECT * FROM child_edges")
def h07_tree_edges(spark, d):
    return H.tree_edges(W.with_children(spark, d))


# ---- I: retrieval


def likes(phrases: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(question), '{p}') AS INT)" for p in phrases)


def classified_sql(v1: bool) -> str:
    complex_, exploratory = (R.COMPLEX_V1, R.EXPLORATORY_V1) if v1 else (R.COMPLEX, R.EXPLORATORY)
    marks = "(length(question) - length(replace(question, '?', '')) > 1)"
    words = r"len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> ''))"
    hop = "false" if v1 else f"({likes(R.MULTIHOP)} + CAST({marks} AS INT)) > 0"
    graph = "false" if v1 else "kind = 'complex' OR hop"
    return rf"""SELECT query_id, kind, round(CASE WHEN c = 0 AND s = 0 AND e = 0 THEN 0.5 WHEN kind = 'complex' THEN least(0.9, 0.5 + c * 0.1) WHEN kind = 'exploratory' THEN least(0.9, 0.5 + e * 0.15) ELSE least(0.9, 0.5 + s * 0.1) END, 6) AS confidence,
  CASE kind WHEN 'complex' THEN 15 WHEN 'exploratory' THEN 10 ELSE 5 END AS top_k, CASE WHEN {graph} THEN 'hybrid' ELSE '{"collapsed_tree" if v1 else "tree_only"}' END AS retrieval,
  {graph} AS use_graph, CASE kind WHEN 'simple' THEN '0,1' WHEN 'exploratory' THEN '1,2,3' ELSE '' END AS layers FROM (
  SELECT *, CASE WHEN c = 0 AND s = 0 AND e = 0 THEN 'simple' WHEN c >= s AND c >= e THEN 'complex' WHEN e > s THEN 'exploratory' ELSE 'simple' END AS kind FROM (
  SELECT query_id, {likes(complex_)} + CASE WHEN {marks} THEN 2 ELSE 0 END + CAST(contains(lower(question), ' and ') OR contains(lower(question), ' or ') OR contains(lower(question), ' but ') AS INT) + CAST({words} > 15 AS INT) AS c,
    {likes(R.SIMPLE)} + CAST({words} < 6 AS INT) AS s, {likes(exploratory)} AS e, {hop} AS hop FROM questions))"""


def classified(spark, d, v1):
    rows = R.classify(W.questions(spark, d), v1)
    return rows.select("query_id", "kind", F.round("confidence", 6).alias("confidence"), "top_k", "retrieval", "use_graph", "layers")


@query(with_(QUESTIONS) + classified_sql(False), doubles="confidence")
def i01_classify(spark, d):
    return classified(spark, d, False)


@query(with_(QUESTIONS) + classified_sql(True), doubles="confidence")
def i02_classify_v1(spark, d):
    return classified(spark, d, True)


CANDS = """cands AS (SELECT q.query_id, q.q_entities, n.*, list_distance(n.embedding, q.embedding) ^ 2 AS distance FROM asked q JOIN described n ON q.document_id = n.document_id OR q.document_id IS NULL)"""


def collapsed_sql(k: str = "10", weight: str = "1", boost: bool = True, source: str = "cands", name: str = "tree") -> str:
    m = "1 - 0.2 * least(3, len(list_filter(q_entities, lambda e: contains(lower(entity_names), e))))" if boost else "1"
    return f"""{name}_near AS (SELECT *, distance * ({weight}) * ({m}) AS adjusted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rn FROM {source}) WHERE rn <= 2 * {k}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted, distance, node_id) AS rank FROM {name}_near) WHERE rank <= {k})"""


RETRIEVAL = (NODES, ENTS, NAMES, QUESTIONS, ASKED, CANDS)


def shown(rows):
    return rows.select("query_id", "node_id", F.round("distance", 6).alias("distance"), "rank")


@query(with_(*RETRIEVAL, collapsed_sql()) + "SELECT query_id, node_id, round(distance, 6) AS distance, round(adjusted, 6) AS adjusted_distance, rank FROM tree", ints="rank")
def i03_collapsed_tree(spark, d):
    rows = R.collapsed_tree(W.asked(spark, d), W.described(spark, d))
    return rows.select("query_id", "node_id", F.round("distance", 6).alias("distance"), F.round("adjusted_distance", 6).alias("adjusted_distance"), "rank")


@query(with_(*RETRIEVAL, collapsed_sql(boost=False)) + "SELECT query_id, node_id, round(distance, 6) AS distance, rank FROM tree", ints="rank")
def i04_collapsed_tree_v1(spark, d):
    return shown(R.collapsed_tree(W.questions(spark, d), W.nodes(spark, d), boost=False))


def ranked_sql(where: str, k: int, by: str = "query_id") -> str:
    return with_(*RETRIEVAL) + f"SELECT query_id, node_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY distance, node_id) AS rank FROM cands WHERE {where}) WHERE rank <= {k}"


@query(ranked_sql("layer = 1", 5), ints="rank")
def i05_layer_search(spark, d):
    return shown(R.layer_search(W.questions(spark, d), W.nodes(spark, d), 1))


@query(ranked_sql("layer = 0 AND chunk_index % 2 = 0", 5), ints="rank")
def i06_store_search(spark, d):
    nodes = W.nodes(spark, d).withColumns({"has_images": F.col("chunk_index") % 2 == 0, "has_tables": F.col("chunk_index") % 3 == 0})
    return shown(R.store_search(W.questions(spark, d), nodes, 5, 0, "image"))


@query(with_(*RETRIEVAL) + """SELECT query_id, node_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY distance, node_id) AS rn FROM cands) WHERE rn <= 3""", ints="rank")
def i07_tree_traversal(spark, d):
    return shown(R.tree_traversal(W.questions(spark, d), W.nodes(spark, d)))


@query(with_(NODES, ENTS, EDGES, QUESTIONS, EXPANDED) + "SELECT query_id, node_id, text, 0.5 AS distance, 'graph' AS source FROM reached JOIN nodes USING (node_id)", doubles="distance")
def i08_graph_expansion(spark, d):
    return R.graph_expansion(seeds_of(spark, d), nearest_of(spark, d).drop("rank"), W.nodes(spark, d)).select("query_id", "node_id", "text", "distance", "source")


ENTITY_SEARCH = """hits AS (SELECT DISTINCT q.query_id, i.node_id FROM (SELECT query_id, document_id, unnest(q_entities) AS entity FROM asked) q JOIN idx i USING (document_id, entity)),
entity AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, node_id) AS rank FROM (
  SELECT h.query_id, h.node_id, len(list_filter(q_entities, lambda e: contains(lower(entity_names), e))) AS matches FROM hits h JOIN asked USING (query_id) JOIN described n ON n.node_id = h.node_id)) WHERE rank <= 5)"""


@query(with_(*RETRIEVAL, INDEX, ENTITY_SEARCH) + "SELECT query_id, node_id, matches, round(1 - 0.1 * matches, 6) AS distance, rank FROM entity", ints="rank matches", doubles="distance")
def i09_entity_search(spark, d):
    rows = R.entity_search(W.asked(spark, d), W.described(spark, d), W.index(spark, d))
    return rows.select("query_id", "node_id", "matches", F.round("distance", 6).alias("distance"), "rank")


def hybrid_sql(k: str, tree: str, name: str) -> str:
    return f"""{name}_seeds AS (SELECT query_id, document_id, node_id FROM {tree} WHERE rank <= 5),
{name}_hop1 AS (SELECT DISTINCT s.query_id, s.document_id, dst AS node_id FROM {name}_seeds s JOIN top3 t ON t.document_id = s.document_id AND t.src = s.node_id
  WHERE NOT EXISTS (SELECT 1 FROM {name}_seeds x WHERE x.query_id = s.query_id AND x.node_id = dst)),
{name}_graph AS (SELECT query_id, node_id FROM (SELECT query_id, node_id FROM {name}_hop1 UNION SELECT h.query_id, dst FROM {name}_hop1 h JOIN top3 t ON t.document_id = h.document_id AND t.src = h.node_id)
  EXCEPT SELECT query_id, node_id FROM {name}_seeds),
{name}_parts AS (SELECT query_id, node_id, 0.6 / (1 + adjusted) AS score, 0 AS part FROM {tree} UNION ALL SELECT query_id, node_id, 0.14, 1 FROM {name}_graph
  UNION ALL SELECT query_id, node_id, 0.4 * 0.3 * matches * 0.3, 2 FROM entity WHERE query_id IN (SELECT query_id FROM {tree})),
{name}_fused AS (SELECT query_id, node_id, sum(score) AS fusion_score, min(part) AS first, CASE WHEN min(part) = 0 AND max(CASE WHEN part = 1 THEN 1 ELSE 0 END) = 1 THEN 'tree+graph' ELSE ['tree', 'graph', 'entity'][min(part) + 1] END AS source
  FROM {name}_parts GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY round(fusion_score, 12) DESC, first, f.node_id) AS rank FROM {name}_fused f) WHERE rank <= {k})"""


SCOPED = "scoped AS (SELECT c.* FROM cands c JOIN questions q USING (query_id) WHERE q.document_id IS NOT NULL), free AS (SELECT c.* FROM cands c JOIN questions q USING (query_id) WHERE q.document_id IS NULL)"


@query(with_(*RETRIEVAL, INDEX, ENTITY_SEARCH, EDGES, SCOPED, collapsed_sql(source="scoped"), collapsed_sql(source="free", name="plain"), hybrid_sql("10", "tree", "fused")) + """
SELECT query_id, node_id, round(fusion_score, 6) AS fusion_score, source, rank FROM fused UNION ALL SELECT query_id, node_id, NULL, 'tree', rank FROM plain""", ints="rank")
def i10_hybrid(spark, d):
    rows = R.hybrid(*stored(spark, d))
    return rows.withColumn("fusion_score", F.round("fusion_score", 6))


CLASSES = "classes AS (" + classified_sql(False) + ")"
ADAPTIVE = (
    *RETRIEVAL, INDEX, ENTITY_SEARCH, EDGES, CLASSES,
    "hcands AS (SELECT c.*, k.top_k AS top_k FROM cands c JOIN classes k USING (query_id) JOIN questions q USING (query_id) WHERE k.use_graph AND q.document_id IS NOT NULL)",
    "pcands AS (SELECT c.*, k.top_k AS top_k, k.layers AS layers FROM cands c JOIN classes k USING (query_id) JOIN questions q USING (query_id) WHERE NOT (k.use_graph AND q.document_id IS NOT NULL))",
    collapsed_sql("top_k", source="hcands", name="htree"),
    hybrid_sql("(SELECT top_k FROM classes c WHERE c.query_id = fused.query_id)", "htree", "fused").replace("(SELECT f.*, row_number()", "(SELECT f.*, row_number()").replace("WHERE rank <= (SELECT top_k FROM classes c WHERE c.query_id = fused.query_id)", "JOIN classes USING (query_id) WHERE rank <= top_k"),
    collapsed_sql("top_k", "CASE WHEN layers = '' OR layer > 9 THEN 1 WHEN list_contains(string_split(layers, ','), CAST(layer AS VARCHAR)) THEN 0.8 ELSE 1.2 END", source="pcands", name="plain"),
    "adaptive AS (SELECT query_id, node_id, source, rank FROM fused UNION ALL SELECT query_id, node_id, 'tree', rank FROM plain)",
)


def stored(spark, d):
    """Questions, nodes, edges and index as tables: several branches read each.
    Graphs are made for the documents that are asked about only."""
    asked, given = GR.written(W.asked(spark, d), "asked"), GR.written(W.nodes(spark, d), "given")
    nodes = GR.written(E.with_entities(given), "nodes")
    wanted = nodes.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    found = H.exploded_entities(wanted)
    edges = GR.nearest_edges(wanted, found)  # no hop takes more than these
    return [asked, nodes, GR.written(edges.drop("rank"), "edges"), GR.written(E.entity_index(found, wanted), "index")]


def adaptive_of(spark, d):
    return R.adaptive(*stored(spark, d))


@query(with_(*ADAPTIVE) + "SELECT * FROM adaptive", ints="rank")
def i11_adaptive(spark, d):
    return adaptive_of(spark, d)


DEDUPED = """deduped AS (SELECT query_id, node_id, source, is_summary, layer, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT a.*, n.is_summary, n.layer, n.text FROM adaptive a JOIN nodes n USING (node_id)) r
  WHERE is_summary OR source = 'graph' OR NOT EXISTS (SELECT 1 FROM adaptive s JOIN nodes p ON p.node_id = s.node_id JOIN child_edges e ON e.parent_id = s.node_id WHERE p.is_summary AND s.query_id = r.query_id AND e.child_id = r.node_id))"""


def deduped(spark, d, v1=False):
    rows = GR.written(adaptive_of(spark, d), "adaptive").join(W.nodes(spark, d).select("node_id", "is_summary", "layer", "text"), "node_id")
    return R.dedupe(rows, W.child_edges(spark, d), v1)


@query(with_(*ADAPTIVE, CHILD_EDGES, DEDUPED) + "SELECT query_id, node_id, source, rank FROM deduped", ints="rank")
def i12_dedupe(spark, d):
    return deduped(spark, d).select("query_id", "node_id", "source", "rank")


@query(with_(*ADAPTIVE, CHILD_EDGES, DEDUPED.replace(" OR source = 'graph'", "")) + "SELECT query_id, node_id, source, rank FROM deduped", ints="rank")
def i13_dedupe_v1(spark, d):
    return deduped(spark, d, True).select("query_id", "node_id", "source", "rank")


CONTEXT = r"""parts AS (SELECT query_id, rank, '[' || CASE WHEN is_summary THEN 'Summary' ELSE 'Chunk' END || ' - Layer ' || layer || ' - Source: ' || source || E']\n' || text || E'\n' AS part FROM deduped),
budget AS (SELECT *, 8000 - (sum(length(part) // 4) OVER w - length(part) // 4) AS room, length(part) // 4 AS tokens FROM parts WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
flow AS (SELECT *, sum(CASE WHEN tokens > room THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS over FROM budget),
contexts AS (SELECT query_id, string_agg(CASE WHEN tokens <= room THEN part ELSE left(part, CAST(room * 4 AS INT)) || '...' END, E'\n---\n' ORDER BY rank) AS context FROM flow WHERE over = 0 OR (over = 1 AND tokens > room AND room > 100) GROUP BY 1)"""


@query(with_(*ADAPTIVE, CHILD_EDGES, DEDUPED, CONTEXT) + "SELECT * FROM contexts")
def i14_build_context(spark, d):
    return R.build_context(deduped(spark, d))


@query(with_(*ADAPTIVE, CHILD_EDGES, DEDUPED) + """SELECT query_id, rank, node_id, CASE WHEN is_summary THEN 'Summary (Layer ' || layer || ')' ELSE 'Chunk' END AS kind, layer, source AS method,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM deduped""", ints="rank")
def i15_answer_sources(spark, d):
    return R.answer_sources(deduped(spark, d))


@query(with_(*ADAPTIVE, CHILD_EDGES, DEDUPED, CONTEXT) + """SELECT query_id, context, n_sources, answer FROM (SELECT q.query_id, coalesce(c.context, '') AS context, coalesce(n.n, 0) AS n_sources,
  CASE WHEN c.context IS NULL THEN 'I couldn''t find any relevant information to answer this question.' ELSE left(q.question, 20) || ': ' || left(string_split(c.context, chr(10))[2], 60) END AS answer
  FROM questions q LEFT JOIN contexts c USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM deduped GROUP BY 1) n USING (query_id))""".replace("left(string_split(c.context, chr(10))[2], 60)", "regexp_replace(left(string_split(c.context, chr(10))[2], 60), '\\s+$', '')"))
def i15_answers(spark, d):
    """The generator hook stands for a model: it tells the question and the first line of the context."""
    import pandas as pd

    def generator(frames):
        for pdf in frames:
            lines = pdf.context.str.split("\n").str[1].str[:60]
            yield pd.DataFrame({"query_id": pdf.query_id, "answer": pdf.question.str[:20] + ": " + lines + " "})

    return R.answers(W.questions(spark, d), GR.written(deduped(spark, d), "deduped"), generator)


def hop_sql(hop: int) -> str:
    """A hop of i16: the five best for each question, those not seen before, and the next questions."""
    told = ASKED.replace("qwords", f"qwords{hop}").replace("qents", f"qents{hop}").replace("asked AS", f"asked{hop} AS").replace("FROM questions", f"FROM q{hop}")
    cands = CANDS.replace("cands AS", f"cands{hop} AS").replace("FROM asked", f"FROM asked{hop}")
    unseen = "".join(f" AND NOT EXISTS (SELECT 1 FROM found{h} x WHERE x.query_id = t.query_id AND x.node_id = t.node_id)" for h in range(1, hop))
    return f"""{told},
{cands},
{collapsed_sql("5", source=f"cands{hop}", name=f"tree{hop}")},
found{hop} AS (SELECT DISTINCT query_id, node_id FROM tree{hop} t WHERE true{unseen}),
q{hop + 1} AS (SELECT q.query_id, n.next AS question, n.v AS embedding, q.document_id FROM q{hop} q JOIN (SELECT query_id, array_to_string(list_sort(list(DISTINCT entity_names)), ' ') AS next,
  arg_min(embedding, node_id) AS v FROM found{hop} JOIN described USING (node_id) GROUP BY 1) n USING (query_id))"""


@query(with_(NODES, ENTS, NAMES, QUESTIONS, "q1 AS (SELECT query_id, question, embedding, document_id FROM questions)", hop_sql(1), hop_sql(2), hop_sql(3))
  + "SELECT query_id, 1 AS hop, node_id FROM found1 UNION ALL SELECT query_id, 2, node_id FROM found2 UNION ALL SELECT query_id, 3, node_id FROM found3", ints="hop")
def i16_multi_hop(spark, d):
    nodes = GR.written(W.described(spark, d).select("node_id", "document_id", "layer", "embedding", "entity_names"), "nodes")  # read by each hop

    def search(q):
        return R.collapsed_tree(R.with_entities(q), nodes, 5)

    def follow_up(q, found):
        names = found.join(nodes.select("node_id", "entity_names"), "node_id").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("entity_names")), " ").alias("next"))
        mean = found.join(nodes.select("node_id", "embedding"), "node_id").groupBy("query_id").agg(F.min_by("embedding", "node_id").alias("v"))
        return q.join(names, "query_id").join(mean, "query_id").select("query_id", F.col("next").alias("question"), F.col("v").alias("embedding"), "document_id")

    return R.multi_hop(W.questions(spark, d), search, follow_up).select("query_id", "hop", "node_id")


@query(with_(*RETRIEVAL) + """SELECT query_id, node_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank
  FROM cands WHERE document_id LIKE 'doc1%' OR document_id LIKE 'doc2%') WHERE rank <= 10""", ints="rank")
def i17_group_scoped(spark, d):
    members = W.nodes(spark, d).select("document_id").filter(F.col("document_id").rlike("^doc[12]"))
    nodes = R.in_group(W.nodes(spark, d), members)
    return shown(R.ranked(R.candidates(W.questions(spark, d), nodes), 10, "distance", "node_id"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') WHEN 1 THEN NULL ELSE text END AS answer, CASE item_id % 3 WHEN 1 THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') END AS next_query FROM benchmark""")
def i18_parse_hop(spark, d):
    k = F.col("item_id") % 3
    answer = F.when(k == 0, F.concat(F.lit("ANSWER:  "), "text")).when(k == 1, F.concat(F.lit("QUERY: "), "text", F.lit("\n"))).otherwise(F.col("text"))
    return W.table(spark, d, "benchmark").select("item_id", T.parse_hop(answer).alias("p")).select("item_id", "p.answer", "p.next_query")


# ---- J: catalog

CATALOG = """catalog AS (SELECT d.doc_id AS document_id, source || '_' || d.doc_id || '.pdf' AS filename, n_chars AS file_size, source AS group_id, n_chars // 2000 + 1 AS chunk_count,
  CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'error' ELSE 'processing' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
GROUPS = """grps AS (SELECT source AS id, list(doc_id ORDER BY doc_id) AS document_ids FROM documents GROUP BY 1),
conns AS (SELECT * FROM (SELECT id AS source_id, lead(id) OVER (ORDER BY id) AS target_id FROM grps) WHERE target_id IS NOT NULL)"""


@query(with_(NODES) + """SELECT count(*) AS n_nodes, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS documents, string_agg(DISTINCT CAST(layer AS VARCHAR), ',' ORDER BY CAST(layer AS VARCHAR)) AS layers,
  count(*) FILTER (chunk_index % 2 = 0) AS n_images, count(*) FILTER (chunk_index % 3 = 0) AS n_tables, count(*) AS n_text FROM nodes""")
def j01_collection_stats(spark, d):
    return J.collection_stats(W.nodes(spark, d).withColumns({"has_images": F.col("chunk_index") % 2 == 0, "has_tables": F.col("chunk_index") % 3 == 0}))


@query(with_(NODES) + "SELECT document_id, count(*) AS n_nodes FROM nodes GROUP BY 1")
def j02_list_documents(spark, d):
    return J.list_documents(W.nodes(spark, d))


@query(with_(CATALOG) + "SELECT * FROM catalog WHERE status = 'ready' ORDER BY document_id LIMIT 50 OFFSET 20")
def j03_page_documents(spark, d):
    return J.page_documents(W.catalog(spark, d), status="ready", offset=20)


@query(with_(CATALOG) + "SELECT document_id, filename FROM catalog WHERE contains(lower(filename), 'src1') ORDER BY document_id LIMIT 5")
def j04_search_documents(spark, d):
    return J.search(W.catalog(spark, d), "filename", "SRC1", 5, "document_id").select("document_id", "filename")


@query(with_(GROUPS) + "SELECT id, len(document_ids) AS n_documents FROM grps WHERE contains(lower(id), 'src') ORDER BY id LIMIT 3", ints="n_documents")
def j05_search_groups(spark, d):
    return J.search(W.groups(spark, d), "id", "Src", 3, "id").select("id", F.size("document_ids").alias("n_documents"))


@query(with_(CATALOG) + "SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'processing') AS processing, sum(chunk_count)::BIGINT AS chunks, sum(file_size)::BIGINT AS bytes FROM catalog")
def j06_catalog_totals(spark, d):
    return J.catalog_totals(W.catalog(spark, d))


@query(with_(NODES) + "SELECT layer, count(*) AS n_nodes, count(DISTINCT document_id) AS n_documents FROM nodes GROUP BY 1")
def j07_nodes_by_layer(spark, d):
    return J.nodes_by_layer(W.nodes(spark, d))


@query(with_(GROUPS) + "SELECT count(*) AS n_groups, sum(len(document_ids))::BIGINT AS n_documents, (SELECT count(*) FROM conns) AS n_connections FROM grps")
def j08_group_totals(spark, d):
    return J.group_totals(W.groups(spark, d), W.connections(spark, d))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1")
def j09_conversation_history(spark, d):
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return J.histories(W.table(spark, d, "conversations")).select("conv_id", F.array_join(line, "\n").alias("history"))


@query(with_(GROUPS) + """SELECT 'group' AS kind, id, NULL AS target FROM grps WHERE right(id, 1) <> '7' UNION ALL SELECT 'connection', source_id, target_id FROM conns WHERE right(source_id, 1) <> '7' AND right(target_id, 1) <> '7'""")
def j10_remove_groups(spark, d):
    groups = W.groups(spark, d)
    kept, links = J.remove_groups(groups, W.connections(spark, d), groups.filter(F.right("id", F.lit(1)) == "7"))
    return kept.select(F.lit("group").alias("kind"), "id", F.lit(None).cast("string").alias("target")).unionByName(links.select(F.lit("connection").alias("kind"), F.col("source_id").alias("id"), F.col("target_id").alias("target")))


@query(with_(CATALOG) + "SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'archived' ELSE status END AS status, filename FROM catalog UNION ALL SELECT max(document_id) + 1, 'new', NULL FROM catalog")
def j11_patch(spark, d):
    rows = W.catalog(spark, d).select("document_id", "status", "filename")
    changes = rows.filter("document_id % 3 = 0").select("document_id", F.lit("archived").alias("status"))
    changes = changes.unionByName(rows.agg((F.max("document_id") + 1).alias("document_id"), F.lit("new").alias("status")))
    return J.patch(rows, changes, "document_id")


# ---- K: incremental


@query(recursive(GROUPED, FOLDED, MERGED, OVERLAPPED) + "SELECT concat(doc_id, '_L0_chunk', chunk_index) AS node_id, CAST(doc_id AS VARCHAR) AS document_id, chunk_index, length(chunk) // 4 AS token_count FROM chunks", ints="chunk_index token_count")
def k01_stream_ingest(spark, d):
    source, target, state = (GR.shared_path(docs_of(spark, d), x) for x in ("incoming", "streamed", "stream-state"))
    docs_of(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), "text").write.parquet(source)
    K.stream_ingest(spark, source, target, state).awaitTermination()
    return K.current(spark, target).select("node_id", "document_id", "chunk_index", "token_count")


@query(with_(NODES) + "SELECT DISTINCT document_id FROM nodes WHERE layer = 0 AND (document_id LIKE 'doc1%' OR chunk_index % 100 = 5)")
def k02_stale_trees(spark, d):
    now = W.nodes(spark, d)
    changed = F.col("document_id").startswith("doc1") | (F.col("chunk_index") % 100 == 5)
    before = now.withColumn("text", F.when(changed, F.lit("old")).otherwise(F.col("text")))
    return K.stale_trees(now, K.fingerprints(before))


REPAIRED = """SELECT document_id, layer, node_id, text FROM (
  SELECT document_id, 0 AS layer, node_id, text FROM changed UNION ALL
  SELECT document_id, 1, concat(document_id, '_L1_summary', row_number() OVER (PARTITION BY document_id ORDER BY block) - 1), text FROM (
    SELECT document_id, chunk_index % 4 AS block, array_to_string(list_transform(list(text ORDER BY chunk_index)[1:3], lambda t: string_split(t, '.')[1] || '.'), ' ') AS text
    FROM changed WHERE document_id IN (SELECT document_id FROM changed GROUP BY 1 HAVING count(*) >= 3) GROUP BY ALL HAVING count(*) >= 2))"""


@query(with_(NODES, "changed AS (SELECT document_id, node_id, chunk_index, CASE WHEN document_id IN ('doc1', 'doc4') THEN concat('new. ', text) ELSE text END AS text FROM nodes WHERE layer = 0)") + REPAIRED, ints="layer")
def k02_repair_trees(spark, d):
    """Trees of all documents are stored; two documents change; only theirs are built again."""
    from grovework.sources.snapshots import NodeTable, repair_trees

    base = E.with_entities(W.planted(spark, d).filter("layer = 0").select("node_id", "document_id", "layer", "chunk_index", "is_summary", "text", "embedding"))
    table = NodeTable(spark, GR.shared_path(base, "trees"), 16)
    build = lambda rows: H.build_tree(rows, max_depth=1, cluster=by_block)[0]
    first = build(base)
    table.change(first, tables={"fingerprints": K.fingerprints(first)})
    kept = table.nodes().filter("layer = 0")
    changed = kept.filter(F.col("document_id").isin("doc1", "doc4")).withColumn("text", F.concat(F.lit("new. "), "text"))
    ids = changed.select("document_id").distinct()
    table.change(changed.unionByName(table.nodes().filter("layer > 0").join(ids, "document_id", "left_semi")), ids)
    repair_trees(table, build)
    return table.nodes().select("document_id", "layer", "node_id", "text")


@query(with_(NODES) + """SELECT document_id, layer, count(*) AS n FROM nodes WHERE document_id <> 'doc0' AND NOT (document_id = 'doc2' AND layer >= 1) GROUP BY ALL""")
def a10_delete_stored(spark, d):
    """Deletes a document and another one's upper layers in a stored table, and uploads a third one again."""
    from grovework.sources.snapshots import NodeTable

    rows = W.nodes(spark, d)
    table = NodeTable(spark, GR.shared_path(rows, "stored"), 16)
    table.append(rows)
    named = lambda name: rows.filter(F.col("document_id") == name)
    table.delete_documents(named("doc0"))
    table.delete_layers(named("doc2"))
    table.replace(named("doc3"))
    return table.nodes().groupBy("document_id", "layer").agg(F.count("*").alias("n"))


HOPPED = """kinds AS (SELECT query_id, question, document_id, embedding, query_id % 4 AS kind FROM questions),
looked AS (SELECT k.query_id, n.node_id, row_number() OVER (PARTITION BY k.query_id ORDER BY list_distance(n.embedding, k.embedding), n.node_id) AS rank FROM kinds k JOIN nodes n ON k.document_id IS NULL OR n.document_id = k.document_id),
sized AS (SELECT query_id, count(*) AS n FROM looked GROUP BY 1),
steps AS (SELECT k.query_id, h AS hop, CASE WHEN h = 1 THEN question ELSE 'more ' || (h - 1) END AS query, greatest(0, least(3, s.n - 3 * (h - 1))) AS results_found, kind
  FROM kinds k JOIN sized s USING (query_id), range(1, 4) r(h) WHERE s.n > 3 * (h - 1) AND (h = 1 OR kind >= 2) AND (h < 3 OR kind = 3))"""


@query(with_(NODES, QUESTIONS, HOPPED) + """SELECT query_id, hop, query, results_found, CASE WHEN kind = 0 THEN 'ANSWER: at once' WHEN kind = 1 THEN 'just so' WHEN kind = 2 AND hop = 2 THEN 'ANSWER:later' ELSE 'QUERY: more ' || hop END AS response,
  CASE WHEN kind = 0 THEN 'at once' WHEN kind = 1 THEN 'just so' WHEN kind = 2 AND m >= 2 THEN 'later' ELSE 'forced' END AS answer, CASE WHEN kind < 2 THEN 1 WHEN kind = 2 AND m >= 2 THEN 2 ELSE 3 END AS hops, total AS total_results
  FROM (SELECT *, max(hop) OVER (PARTITION BY query_id) AS m, CAST(sum(results_found) OVER (PARTITION BY query_id) AS BIGINT) AS total FROM steps)""", ints="hop hops")
def i16_answered_hops(spark, d):
    """A fixed generator: answers at once, says something else, asks once more, or goes on asking."""
    every = GR.written(R.ranked(R.candidates(W.questions(spark, d), W.nodes(spark, d)), 9, "distance", "node_id").select("query_id", "node_id", "rank", "is_summary", "layer"), "looked")
    # the few nodes that a hop can find, with whole texts, none of which is shuffled; read by each hop
    texts = docs_of(spark, d).select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("node_id"), "text")
    nodes = GR.written(texts.join(F.broadcast(every.select("node_id", "is_summary", "layer").distinct()), "node_id"), "nodes")

    def search(now):
        # each further hop finds the next three
        k = F.when(F.col("question").rlike("^more [0-9]+$"), F.regexp_extract("question", "([0-9]+)$", 1).cast("int")).otherwise(0)
        rows = now.select("query_id", k.alias("k"), F.concat(F.lit("hop"), (k + 1).cast("string")).alias("source")).join(every.drop("is_summary", "layer"), "query_id")
        return rows.filter((F.col("rank") > 3 * F.col("k")) & (F.col("rank") <= 3 * F.col("k") + 3)).drop("k")

    def generator(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for query_id, context in zip(pdf.query_id, pdf.context):
                hops = [h for h in (1, 2, 3) if f"Source: hop{h}]" in context]
                kind = query_id % 4
                told = {0: "ANSWER: at once", 1: "just so"}.get(kind, "ANSWER:later" if kind == 2 and hops == [2] else f"QUERY: more {hops[0]}")
                out.append("forced" if len(hops) > 1 else told)
            yield pd.DataFrame({"query_id": pdf.query_id, "response": out})

    trace, told = R.answered_hops(W.questions(spark, d), nodes, search, generator, max_tokens=None)
    return trace.join(told, "query_id")
