"""Retrieval for whole tables of questions at once.

Questions carry query_id, question, embedding and document_id (null: all
documents). Scoped questions join nodes on document_id. Questions without a
document meet all nodes: where they are few (their size is checked) they go to
the nodes; otherwise nodes are dealt into blocks and questions go to each block.
Each task keeps the best of its own before they meet. Only ids and vectors take
part in that; texts join what was found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.text import count_tokens, parse_hop, preview, strip
from grovework.functions.vectors import doubles, squared_l2
from grovework.operators.entities import query_entities
from grovework.operators.graph import expand, written
from grovework.operators.hooks import asked

ALPHA, SEEDS, ENTITY_TOP_K, BOOST, CONTEXT_TOKENS = 0.6, 5, 5, 0.2, 8000
#: Fixed value: the answer where nothing is found.
NO_RESULT = "I couldn't find any relevant information to answer this question."
#: The most results that a class of questions asks for.
MOST_K = 15

#: Phrases that mark kinds of questions, matched as substrings.
COMPLEX = (
    "compare", "contrast", "difference", "between", "relationship", "how does", "why does", "explain why", "connect",
    "relate", "multiple", "several", "all the", "impact", "effect",
)
SIMPLE = (
    "what is", "define", "who is", "when did", "where is", "which", "name the", "list", "how many", "how much",
)
EXPLORATORY = (
    "tell me about", "overview", "summarize", "everything about", "introduction to", "basics of",
)
MULTIHOP = (
    "relationship between", "how does .* relate", "connection", "linked to", "associated with", "causes", "leads to",
    "depends on", "influences", "affects",
)
COMPLEX_V1 = (
    "compare", "contrast", "difference", "between", "how does", "why does", "explain why", "relationship", "relate",
    "connection", "multiple", "several", "all the", "step by step", "process", "procedure", "advantages",
    "disadvantages", "pros and cons", "impact", "effect", "influence", "affect",
)
EXPLORATORY_V1 = (
    "tell me about", "overview", "summarize", "what do you know", "everything about", "introduction to", "basics of",
)


def _hits(text: Column, phrases: Sequence[str]) -> Column:
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def _scores(q: Column, phrases: dict[str, Sequence[str]]) -> dict[str, Column]:
    low = F.lower(q)
    marks = (F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))) > 1
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    joined = F.contains(low, F.lit(" and ")) | F.contains(low, F.lit(" or ")) | F.contains(low, F.lit(" but "))
    found = {k: _hits(low, v) for k, v in phrases.items()}
    found["complex"] = found["complex"] + F.when(marks, 2).otherwise(0) + joined.cast("int") + (words > 15).cast("int")
    found["simple"] = found["simple"] + (words < 6).cast("int")
    if "multihop" in found:
        found["multihop"] = found["multihop"] + marks.cast("int")
    return found


def classify(questions: DataFrame, v1: bool = False, text: str = "question") -> DataFrame:
    """`questions` with kind, confidence, top_k, retrieval, graph_hops, use_graph
    and layers (preferred ones, as text)."""
    phrases = {"complex": COMPLEX_V1 if v1 else COMPLEX, "simple": SIMPLE, "exploratory": EXPLORATORY_V1 if v1 else EXPLORATORY}
    if not v1:
        phrases["multihop"] = MULTIHOP
    rows = questions.withColumns({f"s_{k}": c for k, c in _scores(F.col(text), phrases).items()})
    c, s, e = F.col("s_complex"), F.col("s_simple"), F.col("s_exploratory")
    none = (c == 0) & (s == 0) & (e == 0)
    kind = F.when(none, "simple").when((c >= s) & (c >= e), "complex").when(e > s, "exploratory").otherwise("simple")
    rows = rows.withColumn("kind", kind)
    k = F.col("kind")
    score = F.when(k == "complex", c * 0.1).when(k == "exploratory", e * 0.15).otherwise(s * 0.1)
    rows = rows.withColumn("confidence", F.when(none, 0.5).otherwise(F.least(F.lit(0.9), 0.5 + score)))
    rows = rows.withColumn("top_k", F.when(k == "complex", 15).when(k == "exploratory", 10).otherwise(5))
    rows = rows.withColumn("layers", F.when(k == "simple", "0,1").when(k == "exploratory", "1,2,3").otherwise(""))
    graph = F.lit(False) if v1 else (k == "complex") | (F.col("s_multihop") > 0)
    rows = rows.withColumn("use_graph", graph)
    rows = rows.withColumn("graph_hops", F.when(F.col("use_graph"), 2).otherwise(0))
    rows = rows.withColumn("retrieval", F.when(F.col("use_graph"), "hybrid").otherwise("collapsed_tree" if v1 else "tree_only"))
    return rows.drop(*(f"s_{x}" for x in phrases))


def with_entities(questions: DataFrame) -> DataFrame:
    """`questions` with q_entities, in lower case."""
    found = query_entities(questions).groupBy("query_id").agg(F.array_sort(F.collect_list(F.lower("name"))).alias("q_entities"))
    return questions.join(found, "query_id", "left").withColumn("q_entities", F.coalesce("q_entities", F.array().cast("array<string>")))


def matches(names: Column, wanted: Column) -> Column:
    """How many of the wanted names are substrings of the joined ones."""
    return F.size(F.filter(wanted, lambda e: F.contains(F.lower(names), e)))


def few(questions: DataFrame, most_bytes: int = 32 << 20) -> bool:
    """Whether all questions with their vectors are small enough to be sent to each task."""
    row = questions.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    return row.n * (8 * max(row.d, 0) + 512) <= most_bytes


def candidates(questions: DataFrame, nodes: DataFrame, condition: Column | None = None, small: bool | None = None) -> DataFrame:
    """Question and node rows with distance, for scoped and global questions.
    Where the questions are few, nodes stay where they are."""
    q = questions.select([c for c in questions.columns if c not in ("embedding", "document_id")] + [doubles(F.col("embedding")).alias("q_vector"), F.col("document_id").alias("q_document")])
    n = nodes if condition is None else nodes.filter(condition)
    scoped = q.filter("q_document is not null").join(n, F.col("q_document") == F.col("document_id"))
    free = q.filter("q_document is null")
    if few(questions) if small is None else small:
        every = n.join(F.broadcast(free), F.lit(True))  # its size was checked
    else:
        blocks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        everywhere = free.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        every = n.withColumn("block", F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int")).join(everywhere, "block")
    every = scoped.unionByName(every.select(*scoped.columns))
    return every.withColumn("distance", squared_l2(doubles(F.col("embedding")), F.col("q_vector"))).drop("embedding", "q_vector", "q_document")


def nearest(questions: DataFrame, nodes: DataFrame, k: Column | int, condition: Column | None = None, by: Sequence[str] = ("query_id",), most: int = MOST_K) -> DataFrame:
    """Questions with their k nearest nodes, whole rows with distance and rank.
    Only ids and vectors are ranked; the rest of the nodes joins what was found."""
    small = few(questions)
    n = nodes if condition is None else nodes.filter(condition)
    found = ranked(candidates(questions, n.select("node_id", "document_id", "layer", "embedding"), small=small), k, "distance", "node_id", by=by, most=most)
    rest = nodes.drop("document_id", "layer", "embedding")
    return rest.join(F.broadcast(found) if small else found, "node_id")  # k rows for each of few questions


def ranked(rows: DataFrame, k: Column | int, *order: Column | str, by: Sequence[str] = ("query_id",), most: int = MOST_K) -> DataFrame:
    """The first k of each group. Where k is a column, it is `most` at the most:
    only by a literal bound can Spark cut each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("rank", rank)
    return rows.filter((F.col("rank") <= most) & (F.col("rank") <= k)) if isinstance(k, Column) else rows.filter(F.col("rank") <= k)


def collapsed_tree(questions: DataFrame, nodes: DataFrame, top_k: int | Column = 10, boost: bool = True, weight: Column | None = None) -> DataFrame:
    """The 2k nearest of all layers, re-ranked by layer weight and entity boost
    down to k. With `boost`, questions need q_entities."""
    near = nearest(questions, nodes, top_k * 2, F.col("layer") >= 0, most=2 * MOST_K).drop("rank")
    adjusted = F.col("distance") if weight is None else F.col("distance") * weight
    if boost:
        m = matches(F.col("entity_names"), F.col("q_entities"))
        adjusted = adjusted * (1 - BOOST * F.least(m, F.lit(3)))
    rows = near.withColumn("adjusted_distance", adjusted).withColumn("source", F.lit("tree"))
    return ranked(rows, top_k, "adjusted_distance", "distance", "node_id")


def layer_search(questions: DataFrame, nodes: DataFrame, layer: int, top_k: int = 5) -> DataFrame:
    return nearest(questions, nodes, top_k, F.col("layer") == layer)


def store_search(questions: DataFrame, nodes: DataFrame, n: int = 5, layer: int | None = None, content: str | None = None) -> DataFrame:
    """Nearest nodes with filters on layer and content (image, table)."""
    keep = F.lit(True) if layer is None else F.col("layer") == layer
    if content in ("image", "table"):
        keep = keep & F.col(f"has_{content}s")
    return nearest(questions, nodes, n, keep)


def tree_traversal(questions: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    rows = nearest(questions, nodes, k, F.col("layer") >= 0, by=("query_id", "layer")).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id")))


def graph_expansion(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2, k: int = 3) -> DataFrame:
    found = expand(seeds, edges, hops, k).join(nodes.drop("document_id"), "node_id")
    return found.withColumns({"distance": F.lit(0.5), "source": F.lit("graph")})


def entity_search(questions: DataFrame, nodes: DataFrame, index: DataFrame, top_k: int = ENTITY_TOP_K) -> DataFrame:
    """Nodes that the index has for a question's entities, by number of matches."""
    wanted = questions.select("query_id", "document_id", F.explode("q_entities").alias("entity"))
    hits = wanted.join(index, ["document_id", "entity"]).select("query_id", "node_id").distinct()
    rows = hits.join(questions.select("query_id", "q_entities"), "query_id").join(nodes, "node_id")
    m = matches(F.col("entity_names"), F.col("q_entities"))
    rows = rows.withColumn("matches", m).withColumns({"distance": 1 - 0.1 * F.col("matches"), "source": F.lit("entity")})
    return ranked(rows, top_k, F.desc("matches"), "node_id")


def hybrid(questions: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame, top_k: int | Column = 10, hops: int = 2) -> DataFrame:
    """(query_id, node_id, fusion_score, source, rank): weighted sum of tree,
    graph and entity evidence; questions without document get the tree only."""
    scoped = questions.filter("document_id is not null")
    extra = [top_k] if isinstance(top_k, Column) else []
    tree = collapsed_tree(scoped, nodes, top_k)
    seeds = tree.filter(F.col("rank") <= SEEDS).select("query_id", "document_id", "node_id")
    limit = scoped.select("query_id", *(c.alias("k") for c in extra)) if extra else None
    graph = expand(seeds, edges, hops)
    entity = entity_search(scoped, nodes, index)
    part = lambda rows, score, source: rows.select("query_id", "node_id", score.alias("score"), F.lit(source).alias("part"))
    every = (
        part(tree, ALPHA / (1 + F.col("adjusted_distance")), 0)
        .unionByName(part(graph, F.lit((1 - ALPHA) * 0.7 * 0.5), 1))
        .unionByName(part(entity, (1 - ALPHA) * 0.3 * F.col("matches") * 0.3, 2))
    )
    fused = every.groupBy("query_id", "node_id").agg(F.sum("score").alias("fusion_score"), F.min("part").alias("first"), F.max((F.col("part") == 1).cast("int")).alias("g"))
    source = F.when((F.col("first") == 0) & (F.col("g") == 1), "tree+graph").otherwise(F.element_at(F.array(F.lit("tree"), F.lit("graph"), F.lit("entity")), F.col("first") + 1))
    fused = fused.withColumn("source", source)
    k: Column | int = top_k
    if limit is not None:
        fused, k = fused.join(limit, "query_id"), F.col("k")
    found = ranked(fused, k, F.desc(F.round("fusion_score", 12)), "first", "node_id").select("query_id", "node_id", "fusion_score", "source", "rank")
    plain = collapsed_tree(questions.filter("document_id is null"), nodes, top_k).select("query_id", "node_id", F.lit(None).cast("double").alias("fusion_score"), "source", "rank")
    return found.unionByName(plain)


def adaptive(questions: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, node_id, source, rank): each question by its class, both
    branches once for all questions. Needs q_entities."""
    q = classify(questions)
    fused = q.filter(F.col("use_graph") & F.col("document_id").isNotNull())
    plain = q.filter(~(F.col("use_graph") & F.col("document_id").isNotNull()))
    preferred = F.array_contains(F.split("layers", ","), F.col("layer").cast("string"))
    weight = F.when((F.col("layers") == "") | (F.col("layer") > 9), 1.0).when(preferred, 0.8).otherwise(1.2)
    a = hybrid(fused, nodes, edges, index, F.col("top_k")).select("query_id", "node_id", "source", "rank")
    b = collapsed_tree(plain, nodes, F.col("top_k"), weight=weight).select("query_id", "node_id", "source", "rank")
    return a.unionByName(b)


def dedupe(results: DataFrame, child_edges: DataFrame, v1: bool = False) -> DataFrame:
    """Results (query_id, node_id, is_summary, source, rank) without repeats and
    without nodes that a summary among them covers; graph finds stay (not in v1)."""
    once = ranked(results.withColumnRenamed("rank", "place"), 1, "place", by=("query_id", "node_id")).drop("rank")
    covered = once.filter("is_summary").select("query_id", F.col("node_id").alias("parent_id")).join(child_edges, "parent_id")
    covered = covered.select("query_id", F.col("child_id").alias("node_id")).distinct().withColumn("covered", F.lit(True))
    rows = once.join(covered, ["query_id", "node_id"], "left")
    gone = F.col("covered").isNotNull() & ~F.col("is_summary")
    if not v1:
        gone = gone & (F.col("source") != "graph")
    kept = rows.filter(~gone).drop("covered")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).drop("place")


def build_context(results: DataFrame, max_tokens: int | None = CONTEXT_TOKENS, metadata: bool = True, v1: bool = False) -> DataFrame:
    """(query_id, context) from ranked results (rank, text, is_summary, layer,
    source), of up to `max_tokens`, or, if that is None, of all texts whole."""
    kind = F.when(F.col("is_summary"), "Summary").otherwise("Chunk")
    tail = F.lit("]\n") if v1 else F.concat(F.lit(" - Source: "), F.col("source"), F.lit("]\n"))
    head = F.concat(F.lit("["), kind, F.lit(" - Layer "), F.col("layer").cast("string"), tail)
    if not metadata:
        head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"))
    rows = results.withColumn("part", F.concat(head, "text", F.lit("\n")))
    if max_tokens is None:
        return _joined_parts(rows, F.col("part"))
    rows = rows.withColumn("tokens", count_tokens(F.col("part")))
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("left", max_tokens - (running - F.col("tokens")))
    # the first part that overflows ends the context, cut to what is left
    fits = F.col("tokens") <= F.col("left")
    rows = rows.withColumn("over", F.sum((~fits).cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.filter((F.col("over") == 0) | ((F.col("over") == 1) & ~fits & (F.col("left") > 100)))
    cut = F.when(fits, F.col("part")).otherwise(F.concat(F.left("part", (F.col("left") * 4).cast("int")), F.lit("...")))
    return _joined_parts(kept, cut)


def _joined_parts(rows: DataFrame, part: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n---\n").alias("context"))


def answer_sources(results: DataFrame) -> DataFrame:
    """(query_id, rank, node_id, kind, layer, method, preview) of deduplicated results."""
    kind = F.when(F.col("is_summary"), F.concat(F.lit("Summary (Layer "), F.col("layer").cast("string"), F.lit(")"))).otherwise("Chunk")
    return results.select("query_id", "rank", "node_id", kind.alias("kind"), "layer", F.col("source").alias("method"), preview(F.col("text")).alias("preview"))


def answers(questions: DataFrame, results: DataFrame, generator: Callable | None = None) -> DataFrame:
    """(query_id, context, n_sources, answer); `generator` is a mapInPandas hook
    over (query_id, question, context) that returns query_id and answer, which
    stays null where it fails."""
    context = build_context(results).join(results.groupBy("query_id").agg(F.count("*").alias("n_sources")), "query_id")
    rows = questions.select("query_id", "question").join(context, "query_id", "left")
    if generator is None:
        told = rows.withColumn("answer", F.when(F.col("context").isNull(), NO_RESULT))
    else:
        own = asked(rows.filter("context is not null").select("query_id", "question", "context"), generator, ["query_id"], {"answer": "string"}).drop("failed")
        told = rows.join(own, "query_id", "left").withColumn("answer", F.when(F.col("context").isNull(), NO_RESULT).otherwise(strip(F.col("answer"))))
    return told.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "answer")


def multi_hop(questions: DataFrame, search: Callable[[DataFrame], DataFrame], follow_up: Callable[[DataFrame, DataFrame], DataFrame], hops: int = 3) -> DataFrame:
    """Trace (query_id, hop, question, node_id): each hop searches with the
    follow-up of the one before and keeps unseen nodes only. `search` maps
    questions to (query_id, node_id, ...); `follow_up` maps the questions and a
    hop's new results to the next questions."""
    seen, trace, now = None, None, questions
    for hop in range(1, hops + 1):
        found = search(now).select("query_id", "node_id").distinct()
        if seen is not None:
            found = found.join(seen, ["query_id", "node_id"], "left_anti")
        found = written(found, f"hop{hop}")
        if found.isEmpty():
            break
        rows = found.join(now.select("query_id", "question"), "query_id").withColumn("hop", F.lit(hop))
        trace = rows if trace is None else trace.unionByName(rows)
        seen = found if seen is None else seen.unionByName(found)
        now = follow_up(now, found)
    return trace if trace is not None else questions.limit(0).select("query_id", F.lit("").alias("node_id"), "question", F.lit(0).alias("hop"))


def answered_hops(
    questions: DataFrame,
    nodes: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    generator: Callable,
    embedder: Callable | None = None,
    hops: int = 3,
    last_nodes: int = 10,
    max_tokens: int | None = CONTEXT_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Answers by retrieval in several hops, all open questions at a time.

    Each hop searches for a question's current text and gives what is new, as a
    context, to `generator`, a mapInPandas hook over (query_id, question,
    context) that returns query_id and response. `ANSWER:` ends the question,
    `QUERY:` brings its next text (embedded by `embedder`, a hook over
    (query_id, text); without it the vector stays), any other response is the
    answer. Where nothing new is found the hops end, and the last one is
    followed by a forced answer from the first `last_nodes` finds.

    Contexts have up to `max_tokens`, or all texts whole if that is None.

    `search` maps questions to (query_id, node_id, rank, source). Returns the
    trace (query_id, hop, query, results_found, response) and (query_id, answer,
    hops, total_results); a response that fails is null and ends its question.
    """
    kind = questions.schema["query_id"].dataType.simpleString()
    original, nodes = written(questions, "asked"), nodes.select("node_id", "text", "is_summary", "layer")
    now = original.withColumn("original", F.col("question"))
    seen = trace = done = None
    joined = lambda a, b: b if a is None else a.unionByName(b)
    for hop in range(1, hops + 1):
        found = search(now.drop("original")).select("query_id", "node_id", "rank", "source")
        if seen is not None:
            found = found.join(seen, ["query_id", "node_id"], "left_anti")
        found = written(found.withColumn("hop", F.lit(hop)), f"hop{hop}")
        seen = joined(seen, found)
        context = build_context(found.join(nodes, "node_id"), max_tokens)
        told = asked(context.join(now.select("query_id", F.col("original").alias("question")), "query_id").select("query_id", "question", "context"), generator, ["query_id"], {"response": "string"})
        sizes = found.groupBy("query_id").agg(F.count("*").alias("results_found"))
        step = written(now.join(sizes, "query_id").join(told, "query_id").withColumn("parsed", parse_hop(F.col("response"))), f"told{hop}")
        trace = joined(trace, step.select("query_id", F.lit(hop).alias("hop"), F.col("question").alias("query"), "results_found", "response"))
        ended = step.filter("parsed.next_query IS NULL").select("query_id", F.col("parsed.answer").alias("answer"), F.lit(hop).alias("hops"))
        done = joined(done, ended)
        now = step.filter("parsed.next_query IS NOT NULL").withColumn("question", F.col("parsed.next_query")).select("query_id", "question", "embedding", "document_id", "original")
        if embedder is not None:
            own = asked(now.select("query_id", F.col("question").alias("text")), embedder, ["query_id"], {"vector": "array<double>"})
            now = now.join(own, "query_id").withColumn("embedding", F.coalesce("vector", "embedding")).drop("vector", "failed")
        now = written(now, f"open{hop}")
        if now.isEmpty():
            break
    # whatever was found so far, in the order in which it was found
    left = original.join(done, "query_id", "left_anti").select("query_id", "question")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "rank", "node_id"))
    first = seen.withColumn("rank", place).filter(F.col("rank") <= last_nodes).join(left, "query_id", "left_semi")
    context = build_context(first.drop("hop").join(nodes, "node_id"), max_tokens)
    forced = asked(left.join(context, "query_id", "left").select("query_id", "question", F.coalesce("context", F.lit("")).alias("context")), generator, ["query_id"], {"response": "string"})
    last = forced.select("query_id", F.col("response").alias("answer"), F.lit(hops).alias("hops"))
    total = seen.groupBy("query_id").agg(F.count("*").alias("total_results"))
    answers_ = done.unionByName(last).join(total, "query_id", "left").withColumn("total_results", F.coalesce("total_results", F.lit(0)))
    return trace.withColumn("query_id", F.col("query_id").cast(kind)), answers_


def in_group(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the documents in `members`, for group-scoped searches."""
    return nodes.join(members.select("document_id").distinct(), "document_id", "left_semi")
