"""Token counts kept up to date from deltas.

Events say that a document was inserted, that its counts were revised, or that
it was deleted. A commit turns a batch of events into signed changes of the
totals by source, language and tokenizer version: minus what the ledger holds
for a document, plus what the event says. Totals are sums of all committed
changes, so they are additive and need no look at other documents.

A batch is a folder for its changes, one for its ledger rows and, last, one for
its mark. Only marked batches count. A batch that was committed is skipped when
it comes again, and one that broke off before its mark is written anew, so a
commit may be tried any number of times. Batches are committed one at a time.

The ledger rows of a batch are written first, with the state they replace, and
its changes follow from what was written, so the two can't disagree. A commit
reads the ledger for the documents of its batch only; `compact` writes the
present states in one piece, so later commits read that and what came after.

Edge cases: of several events for a document in a batch the one with the
largest `seq` counts; of equal ones the last in the order of op, source, lang
and n_tokens. Deleting an unknown document changes nothing; inserting a
known one revises it. A null source or language is a group of its own. Events
without id or tokenizer are left out, null counts are 0. Columns that are not
named are not read, so names cannot clash. An empty batch is committed too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = ("seq", "op", "doc_id", "source", "lang", "tokenizer", "n_tokens")
KEY = ("doc_id", "tokenizer")
GROUP = ("source", "lang", "tokenizer")
LEDGER = "batch long, doc_id long, tokenizer string, source string, lang string, n_tokens long"


class TokenRollup:
    """Totals under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> TokenRollup:
        """Starts with no batches; the folder must be new."""
        none = self.spark.createDataFrame([], "batch long")
        none.write.parquet(f"{self.path}/commits/start")
        none.write.parquet(f"{self.path}/compacted/start")
        return self

    def committed(self) -> list[int]:
        """The numbers of the committed batches; one small row for each batch."""
        marks = self.spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(f"{self.path}/commits")
        return sorted(r.batch for r in marks.distinct().collect())

    def _read(self, what: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{what}/{b}" for b in batches))

    def _compacted(self) -> int | None:
        """The batch up to which the ledger was compacted last."""
        marks = self.spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(f"{self.path}/compacted")
        return marks.agg(F.max("batch")).first()[0]

    def ledger(self, keys: DataFrame | None = None) -> DataFrame:
        """The present state of each document and tokenizer, or of those in
        `keys`; deleted ones have no count."""
        done, upto = self.committed(), self._compacted()
        rows = self._read("ledger", LEDGER, [b for b in done if upto is None or b > upto])
        if upto is not None:
            rows = rows.unionByName(self._read("states", LEDGER, [upto]))
        if keys is not None:
            rows = rows.join(keys.select(*KEY), list(KEY), "left_semi")
        last = rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("now"))
        return last.select(*KEY, "now.*")

    def compact(self) -> None:
        """Writes the present states and totals in one piece; may be tried again."""
        done = self.committed()
        if done and self._compacted() != done[-1]:
            self._sums(done).write.mode("overwrite").parquet(f"{self.path}/sums/{done[-1]}")
            self.ledger().withColumn("batch", F.lit(done[-1]).cast("long")).write.mode("overwrite").parquet(f"{self.path}/states/{done[-1]}")
            self._mark("compacted", done[-1])

    def _mark(self, what: str, batch: int) -> None:
        self.spark.range(batch, batch + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{what}/{batch}")

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Applies `events` (seq, op: insert, revise or delete, doc_id, source,
        lang, tokenizer, n_tokens) as batch number `batch`, unless it was
        committed before; says whether it was applied."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} after {done[-1]}")
        own = events.select(*EVENT).dropna(subset=list(KEY))
        last = own.groupBy(*KEY).agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("e"))
        known = self.ledger(own).select(*KEY, F.struct("source", "lang", "n_tokens").alias("old"))
        stays = F.col("e.op") != "delete"  # a deleted document has no source, language and count
        rows = last.join(known, list(KEY), "left").select(
            F.lit(batch).cast("long").alias("batch"),
            *KEY,
            F.when(stays, F.col("e.source")).alias("source"),
            F.when(stays, F.col("e.lang")).alias("lang"),
            F.when(stays, F.coalesce("e.n_tokens", F.lit(0)).cast("long")).alias("n_tokens"),
            *(F.col(f"old.{x}").alias(f"old_{x}") for x in ("source", "lang", "n_tokens")),
        )
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        made = self._read("ledger", LEDGER + ", old_source string, old_lang string, old_n_tokens long", [batch])
        side = lambda sign, old: F.struct(*(F.col(old + x).alias(x) for x in ("source", "lang", "n_tokens")), F.lit(sign).alias("sign"))
        changes = made.select("tokenizer", F.explode(F.array(side(-1, "old_"), side(1, ""))).alias("c")).select("tokenizer", "c.*").filter("n_tokens is not null")
        changes = changes.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/{batch}")
        self._mark("commits", batch)
        return True

    def _sums(self, done: list[int]) -> DataFrame:
        upto, kind = self._compacted(), "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self._read("changes", kind, [b for b in done if upto is None or b > upto])
        if upto is not None:
            rows = rows.unionByName(self._read("sums", kind, [upto]))
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all groups that hold a document."""
        return self._sums(self.committed()).filter("n_docs > 0")


def counted(docs: DataFrame, op: str, seq: int, id_col: str = "doc_id", text: str = "text", bpe: str | None = None) -> DataFrame:
    """Events for documents under the tokenizer versions words-1 (runs of
    non-blanks), bytes-1 (UTF-8 bytes) and, with a vocabulary file `bpe`, bpe-1."""
    from grovework.llm.bpe import encode_documents
    from grovework.llm.curriculum import words_in

    own = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"))
    own = own.withColumns({"words": words_in("text"), "bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    counts = {"words-1": F.col("words"), "bytes-1": F.col("bytes")}
    if bpe:
        own = encode_documents(own, bpe, keep=("doc_id", "source", "lang", "words", "bytes"), decode=False)
        counts["bpe-1"] = (F.octet_length("token_ids") / 4).cast("long")
    each = F.array(*(F.struct(F.lit(name).alias("tokenizer"), n.alias("n_tokens")) for name, n in counts.items()))
    rows = own.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "doc_id", "source", "lang", F.explode(each).alias("t"))
    return rows.select("seq", "op", "doc_id", "source", "lang", "t.*")
