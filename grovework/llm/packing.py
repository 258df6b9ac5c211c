"""Packing token sequences into rows of fixed length, best fit decreasing.

A document longer than a row is split without loss: its full rows are packs of
their own and only the remainder is packed. Remainders are placed longest
first, each into the open row with the least room that still suffices; a
segment tree over the possible amounts of room (0 to the row length) finds it
in logarithmic time. Rows come with their ids, the cumulative lengths of their
segments and the places at which positions start anew.

Documents are dealt into shards by a hash of their id, about `shard_docs` in
each, and each shard is packed on its own; so packs do not depend on the
cluster, tasks hold the remainders of one shard only, and one shuffle of the
ids suffices.

Edge cases: null and empty sequences fill no segment and appear in no pack.
A sequence of any length is split. Repeated rows are packed as often as they
occur; ties are ordered by id and content. An empty table gives no packs.
Columns that are not named are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RoomTree:
    """Open rows by the room they have left."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def add(self, row: int, room: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = self.base + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least `size`, and its room."""
        at, count = self.base + size, self.count
        while not count[at]:
            while at & 1:  # a right child: no larger rooms under its parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.base:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.base
        while at:
            count[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """Rows as lists of numbers of pieces. Equal sizes keep their order."""
    rooms, rows = RoomTree(most), []
    for piece in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = rooms.take(sizes[piece])
        if found is None:
            row, room = len(rows), most
            rows.append([])
        else:
            row, room = found
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.add(row, room - sizes[piece])
    return rows


SCHEMA = "shard int, pack int, n_tokens int, ids binary, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>"


def pack(docs: DataFrame, ids: Column, id_bytes: int, length: int = 2048, id_col: str = "doc_id", shard_docs: int = 8192, n_docs: int | None = None) -> DataFrame:
    """Packs of `length` ids each from the binary column `ids`, which holds
    `id_bytes` bytes for each id: shard, pack (its number in the shard),
    n_tokens, ids (without padding), doc_ids and doc_starts (the document of
    each segment and the place in it), cu_seqlens (from 0 to n_tokens).
    `n_docs` is the number of rows, where it is known without making the ids."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), ids.alias("ids")).filter(F.octet_length("ids") > 0)
    shards = max(1, -(-(docs.count() if n_docs is None else n_docs) // shard_docs))
    # a third of the rows may share an id, so ids alone would not spread them
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.xxhash64("ids")), F.lit(shards)).cast("int"))
    # a task takes a run of shards, as many as it must
    tasks = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int")).sortWithinPartitions("shard", "id", F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = length * id_bytes

        def batch_of(shard: int, first: int, rows: list[list[tuple]]) -> pa.RecordBatch:
            ends = []
            for row in rows:
                ends.append([0])
                for _, _, data in row:
                    ends[-1].append(ends[-1][-1] + len(data) // id_bytes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(rows), pa.int32()),
                    pa.array(range(first, first + len(rows)), pa.int32()),
                    pa.array([e[-1] for e in ends], pa.int32()),
                    pa.array([b"".join(p[2] for p in row) for row in rows], pa.binary()),
                    pa.array([[p[0] for p in row] for row in rows], pa.list_(pa.int64())),
                    pa.array([[p[1] for p in row] for row in rows], pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int32())),
                ],
                names=["shard", "pack", "n_tokens", "ids", "doc_ids", "doc_starts", "cu_seqlens"],
            )

        def finished(shard: int, made: int, rest: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = best_fit_decreasing([len(p[2]) // id_bytes for p in rest], length)
            for at in range(0, len(rows), 512):
                yield batch_of(shard, made + at, [[rest[k] for k in row] for row in rows[at : at + 512]])

        now, made, rest, whole = None, 0, [], []
        for batch in batches:
            for id_, data, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if whole:
                        yield batch_of(now, made - len(whole), whole)
                    if now is not None:
                        yield from finished(now, made, rest)
                    now, made, rest, whole = shard, 0, [], []
                cut = len(data) - len(data) % full
                for at in range(0, cut, full):
                    whole.append([(id_, at // id_bytes, data[at : at + full])])
                    made += 1
                    if len(whole) == 512:
                        yield batch_of(now, made - 512, whole)
                        whole = []
                if cut < len(data):
                    rest.append((id_, cut // id_bytes, data[cut:]))
        if whole:
            yield batch_of(now, made - len(whole), whole)
        if now is not None:
            yield from finished(now, made, rest)

    return dealt.select("id", "ids", "shard").mapInArrow(run, SCHEMA)


def position_resets() -> Column:
    """The place of each segment's first id."""
    return F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1)


def position_ids() -> Column:
    """The position of each id in its segment, from cu_seqlens."""
    lengths = F.zip_with(F.slice("cu_seqlens", F.lit(2), F.size("cu_seqlens") - 1), F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1), lambda b, a: b - a)
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))


def write_packed(packed: DataFrame, path: str, length: int, id_bytes: int, pad: bytes = b"\0", positions: bool = True) -> None:
    """The id matrix (rows filled up with `pad` ids), cumulative lengths, the
    places at which positions start anew and, if asked for, the position of
    each id as Parquet, ordered by shard and pack within files."""
    filler = F.lit(pad * id_bytes * length if len(pad) == 1 else pad * length)
    room = F.lit(length * id_bytes) - F.octet_length("ids")
    row = F.concat(F.col("ids"), F.substring(filler, F.lit(1), room))
    more = [position_ids().alias("position_ids")] if positions else []
    packed.select("shard", "pack", "n_tokens", row.alias("ids"), "doc_ids", "doc_starts", "cu_seqlens", position_resets().alias("position_resets"), *more).write.parquet(path)
