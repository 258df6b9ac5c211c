"""Text functions over columns. Blanks are Unicode blanks throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: What stands between texts that are summarised together, and the templates of contexts below.
SEPARATOR = "\n\n---\n\n"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def split_sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def references(text: Column, kind: str) -> Column:
    """Ids in [KIND id: ...] marks; kind is IMAGE or TABLE."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)\[{kind}\s+([^\s:]+):"), F.lit(1))


def content_types(text: Column) -> Column:
    image = F.when(F.size(references(text, "IMAGE")) > 0, F.lit("image"))
    table = F.when(F.size(references(text, "TABLE")) > 0, F.lit("table"))
    return F.array_compact(F.array(F.lit("text"), image, table))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def flat_preview(text: Column, n: int = 250) -> Column:
    return F.replace(F.left(text, F.lit(n)), F.lit("\n"), F.lit(" "))


def summary_sample(text: Column) -> Column:
    cut = F.concat(F.left(text, F.lit(3000)), F.lit("\n...\n"), F.right(text, F.lit(1000)))
    return F.when(F.length(text) <= 4000, text).otherwise(cut)


def template_context(document: Column, summary: Column) -> Column:
    return F.concat(F.lit("From '"), document, F.lit("': "), F.left(summary, F.lit(200)), F.lit("..."))


def element_context(document: Column, summary: Column, kind: str) -> Column:
    return F.concat(F.lit("From '"), document, F.lit("': "), F.left(summary, F.lit(150)), F.lit(f"... This {kind} appears in the document."))


def contextualized(context: Column, chunk: Column) -> Column:
    return F.concat(context, F.lit("\n\n"), chunk)


def first_sentences(texts: Column, n: int = 3) -> Column:
    """What precedes the first full stop of each of the first texts."""
    return F.array_join(F.transform(F.slice(texts, 1, n), lambda t: F.concat(F.substring_index(t, ".", 1), F.lit("."))), " ")


def combine_texts(texts: Column, tokens: int = 500) -> Column:
    whole, most = F.array_join(texts, SEPARATOR), tokens * CHARS_PER_TOKEN
    return F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("..."))).otherwise(whole)


def node_id(document: Column, layer: Column, index: Column, summary: Column) -> Column:
    kind = F.when(summary, F.lit("summary")).otherwise(F.lit("chunk"))
    return F.concat(document, F.lit("_L"), layer.cast("string"), F.lit("_"), kind, index.cast("string"))


def cluster_id(layer: Column, cluster: Column) -> Column:
    return F.concat(F.lit("L"), (layer + 1).cast("string"), F.lit("_C"), cluster.cast("string"))


def format_bytes(size: Column, decimals: int = 2) -> Column:
    units = F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB")))
    power = F.least(F.floor(F.log2(size.cast("double")) / 10), F.lit(3)).cast("int")
    number = F.round(size / F.pow(F.lit(1024.0), power), decimals).cast(f"decimal(20,{decimals})").cast("string")
    short = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(size == 0, F.lit("0 Bytes")).otherwise(F.concat(short, F.lit(" "), F.element_at(units, power + 1)))


def markdown_table(table: Column, cells: Column) -> Column:
    """cells: rows of cells, the first row the header."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |\n"))
    trimmed = F.transform(cells, lambda row: F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))))
    head, rule = F.element_at(trimmed, 1), F.transform(F.element_at(cells, 1), lambda c: F.lit("---"))
    body = F.array_join(F.transform(F.slice(trimmed, F.lit(2), F.size(cells)), line), "")
    return F.concat(F.lit("[TABLE "), table, F.lit(": Table from document]\n\n"), line(head), line(rule), body)


def parse_hop(text: Column) -> Column:
    """answer and next query of a hop's response."""
    answer = F.when(text.startswith("ANSWER:"), strip(F.substring(text, 8, 2**31 - 1))).when(text.startswith("QUERY:"), F.lit(None)).otherwise(text)
    query = F.when(text.startswith("QUERY:"), strip(F.substring(text, 7, 2**31 - 1)))
    return F.struct(answer.alias("answer"), query.alias("next_query"))
