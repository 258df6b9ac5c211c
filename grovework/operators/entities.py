"""Entities of nodes and questions: extraction, indexes, aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.text import strip
from grovework.functions.vectors import cosine
from grovework.operators.hooks import asked

ENTITY = "struct<name:string,type:string,importance:int>"
#: The patterns of capitalised phrases, technical terms and words of questions.
CAPS = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
TECHNICAL = r"(?U)\b([A-Z]{2,}|[a-z]+[A-Z][a-zA-Z]*)\b"
QUERY_WORD = r"(?U)\b([A-Za-z][A-Za-z0-9_-]*)\b"
#: Words that name nothing.
STOPWORDS = (
    "what", "how", "why", "when", "where", "who", "which", "is", "are", "was", "were", "the", "a", "an", "and", "or", "but",
    "in", "on", "at", "to", "for", "of", "with", "by", "from", "can", "could", "would", "should", "do", "does", "did",
    "have", "has", "had", "this", "that", "these", "those", "about", "tell", "me", "explain",
)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def extract_entities(nodes: DataFrame, id_col: str = "node_id", text: str = "text", most: int = 15) -> DataFrame:
    """(id_col, name, type, importance, rank) by the rules for capitalised
    phrases and technical terms. The cut to `most` precedes the length filter."""
    names = F.concat(found(F.col(text), CAPS), found(F.col(text), TECHNICAL))
    rows = nodes.select(id_col, F.posexplode(names).alias("pos", "name"))
    counts = rows.groupBy(id_col, "name").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "pos"))
    kept = counts.withColumn("rank", rank).filter((F.col("rank") <= most) & (F.length("name") > 2))
    technical = (F.upper("name") == F.col("name")) | F.col("name").rlike("^[a-z]+[A-Z]")
    return kept.select(
        id_col, "name", F.when(technical, "technology").otherwise("concept").alias("type"), F.least(F.lit(10), F.col("n") + 3).cast("int").alias("importance"), "rank"
    )


def as_arrays(entities: DataFrame, id_col: str = "node_id") -> DataFrame:
    """(id_col, entities) in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "name", "type", "importance")))
    return entities.groupBy(id_col).agg(F.transform(rows, lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["importance"].alias("importance"))).alias("entities"))


def with_entities(nodes: DataFrame, extractor: Callable | None = None, mark: str | None = None) -> DataFrame:
    """`nodes` with entities and entity_names; `extractor` is a mapInPandas hook
    over (node_id, text) that returns node_id and own, an array of entities. The
    rules stand in where it leaves null, fails or has no row; `mark` names a
    column that tells where it failed."""
    base = nodes.join(as_arrays(extract_entities(nodes)), "node_id", "left")
    base = base.withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))
    if extractor is not None:
        own = asked(nodes.select("node_id", "text"), extractor, ["node_id"], {"own": f"array<{ENTITY}>"})
        base = base.join(own, "node_id", "left").withColumn("entities", F.coalesce("own", "entities")).drop("own")
        base = base.withColumnRenamed("failed", mark) if mark else base.drop("failed")
    return base.withColumn("entity_names", entity_names(F.col("entities")))


def entity_names(entities: Column, most: int = 10) -> Column:
    return F.array_join(F.transform(F.slice(entities, 1, most), lambda e: e["name"]), ",")


def parse_entity_json(answer: Column, most: int = 15) -> Column:
    """Entities of a model's JSON answer: the objects with a name among the first
    `most` elements, whatever the others are. Null, for the rules to stand in,
    where there is no list, or an importance is no number."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(answer), r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))
    rows = F.slice(F.try_variant_get(F.try_parse_json(bare), "$", "array<variant>"), 1, most)
    get = lambda e, key: F.try_variant_get(e, f"$.{key}", "string")
    rows = F.filter(rows, lambda e: F.schema_of_variant(e).startswith("OBJECT") & get(e, "name").isNotNull())

    def importance(e: Column) -> Column:
        value = F.try_variant_get(e, "$.importance", "variant")
        number = F.when(F.schema_of_variant(value) == "STRING", F.regexp_extract(get(e, "importance"), r"^\s*([+-]?\d+)\s*$", 1)).otherwise(get(e, "importance"))
        return F.when(value.isNull(), F.lit(5.0)).otherwise(number.try_cast("double"))

    read = F.transform(rows, lambda e: F.struct(strip(get(e, "name")).alias("name"), F.lower(F.coalesce(get(e, "type"), F.lit("other"))).alias("type"), importance(e).alias("importance")))
    whole = lambda x: F.greatest(F.lit(1), F.least(F.lit(10.0), x).cast("int"))
    made = F.transform(read, lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), whole(e["importance"]).alias("importance")))
    return F.when(F.forall(read, lambda e: e["importance"].isNotNull()), made)


def dedupe_exact(entities: DataFrame, group: str = "document_id") -> DataFrame:
    """One entity for each lower-cased name: the most important, at the place of
    the first. Rows: (group, pos, name, type, importance)."""
    key = F.lower(strip(F.col("name")))
    rows = entities.withColumn("key", key)
    best = F.row_number().over(Window.partitionBy(group, "key").orderBy(F.desc("importance"), "pos"))
    first = F.min("pos").over(Window.partitionBy(group, "key"))
    return rows.withColumns({"best": best, "first": first}).filter("best = 1").select(group, F.col("first").alias("pos"), "name", "type", "importance")


def dedupe_similar(entities: DataFrame, group: str = "document_id", threshold: float = 0.85) -> DataFrame:
    """Greedy removal of entities with like vectors where more than five remain:
    over pairs in order the less important goes, of equals the later. Rows:
    (group, pos, name, importance, embedding)."""
    sized = entities.withColumn("n", F.count("*").over(Window.partitionBy(group))).filter("n > 5")
    pick = lambda side: sized.select(group, F.col("pos").alias(f"{side}_pos"), F.col("importance").alias(f"{side}_imp"), F.col("embedding").alias(f"{side}_v"))
    pairs = pick("a").join(pick("b"), group).filter((F.col("a_pos") < F.col("b_pos")) & (cosine(F.col("a_v"), F.col("b_v")) > threshold))
    ordered = F.array_sort(F.collect_list(F.struct("a_pos", "b_pos", "a_imp", "b_imp")))
    gone = F.aggregate(
        "pairs",
        F.array().cast("array<int>"),
        lambda out, p: F.when(F.array_contains(out, p["a_pos"]) | F.array_contains(out, p["b_pos"]), out).otherwise(
            F.array_append(out, F.when(p["a_imp"] >= p["b_imp"], p["b_pos"]).otherwise(p["a_pos"]))
        ),
    )
    removed = pairs.groupBy(group).agg(ordered.alias("pairs")).select(group, F.explode(gone).alias("pos"))
    return entities.join(removed, [group, "pos"], "left_anti")


def query_entities(questions: DataFrame, id_col: str = "query_id", text: str = "question") -> DataFrame:
    """(id_col, pos, name): words that are no stopwords, then capitalised
    phrases, unfiltered; of equal ones but for case the first."""
    t = F.col(text)
    words = F.filter(found(t, QUERY_WORD), lambda w: ~F.lower(w).isin(*STOPWORDS) & (F.length(w) > 2))
    rows = questions.select(id_col, F.posexplode(F.concat(words, found(t, CAPS))).alias("pos", "name"))
    return rows.groupBy(id_col, F.lower("name").alias("key")).agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")).select(id_col, "pos", "name")


def entity_index(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (document_id, entity, node_id), entities in lower case."""
    rows = entities.select("node_id", F.lower("name").alias("entity")).distinct()
    return rows.join(nodes.select("node_id", "document_id"), "node_id").select("document_id", "entity", "node_id")


def nodes_by_entity(index: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes of any of the names in column `name`."""
    wanted = names.select(F.lower("name").alias("entity")).distinct()
    return index.join(wanted, "entity", "left_semi").select("document_id", "node_id").distinct()


def cluster_entities(entities: DataFrame, membership: DataFrame, most: int = 15) -> DataFrame:
    """Entities of each (document_id, cluster) by importance times count.
    entities: (node_id, rank, name, type, importance); first seen is by node, rank."""
    rows = membership.join(entities, "node_id").withColumns({"key": F.lower("name"), "seen": F.struct("node_id", "rank")})
    sums = rows.groupBy("document_id", "cluster", "key").agg(
        F.count("*").alias("n"), F.max("importance").alias("importance"), F.min_by(F.struct("name", "type"), "seen").alias("e"), F.min("seen").alias("seen")
    )
    rank = F.row_number().over(Window.partitionBy("document_id", "cluster").orderBy((F.col("importance") * F.col("n")).desc(), "seen"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= most).select("document_id", "cluster", "rank", "e.name", "e.type", "importance", "n")
