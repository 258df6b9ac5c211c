"""Tables that change as a whole: versions, each a list of the files it consists of.

A version is one small manifest file that names, for each partition of each
table, the folders with its rows. Data is written first, under a new folder, and
counts from the moment its manifest is there; so a writer that breaks off leaves
the version before it as it was. A manifest is made by creating its file, which
must not exist: of two writers that start from one version the second fails,
whatever it wrote. Versions before stay readable until `vacuum`.

`NodeTable` keeps nodes by layer and a hash of the document in `buckets`
partitions. Deletes and replacements rewrite the partitions that they touch;
appends add folders, which the next rewrite of a partition or `compact` merges.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Entries = dict[str, list[str]]


class Conflict(RuntimeError):
    """Another writer made this version first."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._java(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._java(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit() and self._entries(int(s.getPath().getName())) is not None)

    def _entries(self, version: int) -> Entries | None:
        stream = self._files.open(self._java(f"{self.path}/versions/{version:010d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)  # one that broke off is no version
        except ValueError:
            return None

    def latest(self) -> int:
        """The number of the last version, 0 for none."""
        return max(self.versions(), default=0)

    def entries(self, version: int | None = None) -> Entries:
        version = self.latest() if version is None else version
        found = self._entries(version) if version else {}
        if found is None:
            raise ValueError(f"no version {version}")
        return found

    def commit(self, base: int, entries: Entries) -> int:
        """Makes `entries` the version after `base`."""
        if self.latest() != base:
            raise Conflict(f"version {base} is not the last one any more")
        number = base + 1
        while self._files.exists(self._java(f"{self.path}/versions/{number:010d}")):  # remains of one that broke off
            number += 1
        try:
            stream = self._files.create(self._java(f"{self.path}/versions/{number:010d}"), False)
        except Exception as e:
            raise Conflict(f"version {number} was made meanwhile") from e
        stream.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        stream.close()
        return number

    def new_folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def read(self, key: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in self.entries(version)[key]))

    def save(self, tables: dict[str, DataFrame]) -> int:
        """Replaces whole tables in one version; others stay."""
        base = self.latest()
        entries = self.entries(base)
        for key, rows in tables.items():
            folder = self.new_folder()
            rows.write.parquet(f"{self.path}/{folder}")
            entries[key] = [folder]
        return self.commit(base, entries)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all versions but the last `keep`, and folders that none of those names."""
        versions = self.versions()
        used = {p.split("/")[1] for v in versions[-keep:] for paths in self.entries(v).values() for p in paths if p.startswith("data/")}
        for v in versions[:-keep]:
            self._files.delete(self._java(f"{self.path}/versions/{v:010d}"), False)
        for s in self._files.listStatus(self._java(f"{self.path}/data")):
            if s.getPath().getName() not in used:
                self._files.delete(s.getPath(), True)


class NodeTable(Snapshots):
    """Nodes with at least node_id, document_id and layer."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path)
        self.buckets = buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(self.buckets)).cast("int")

    def nodes(self, version: int | None = None) -> DataFrame:
        entries = self.entries(version)
        paths = [p for key, own in entries.items() if key.startswith("nodes/") for p in own]
        rows = self.spark.read.schema(entries["schema"][0])
        return rows.parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], entries["schema"][0])

    def _written(self, rows: DataFrame) -> Entries:
        """Folders of the new rows by partition."""
        folder = self.new_folder()
        keyed = rows.withColumns({"__layer": F.col("layer"), "__bucket": self._bucket()})
        keyed.hint("rebalance", "__layer", "__bucket").write.partitionBy("__layer", "__bucket").parquet(f"{self.path}/{folder}")
        found: Entries = {}
        for layer in self._files.listStatus(self._java(f"{self.path}/{folder}")):
            if layer.isDirectory():
                for bucket in self._files.listStatus(layer.getPath()):
                    a, b = layer.getPath().getName(), bucket.getPath().getName()
                    found[f"nodes/{a.split('=')[1]}/{b.split('=')[1]}"] = [f"{folder}/{a}/{b}"]
        return found

    def change(self, new: DataFrame | None = None, gone: DataFrame | None = None, least: int = 0, tables: dict[str, DataFrame] | None = None) -> int:
        """One version: without the nodes of the documents in `gone` (document_id)
        at layer `least` or above, with the `new` nodes, and with whole `tables`
        besides. Partitions without such documents are not read."""
        base = self.latest()
        entries = self.entries(base)
        added = []
        if gone is not None:
            ids = gone.select(F.col("document_id")).distinct()
            buckets = {r.b for r in ids.select(self._bucket().alias("b")).distinct().collect()}  # at most the number of buckets
            touched = [k for k in entries if k.startswith("nodes/") and int(k.split("/")[2]) in buckets and int(k.split("/")[1]) >= least]
            if touched:
                paths = [f"{self.path}/{p}" for k in touched for p in entries[k]]
                added.append(self.spark.read.schema(entries["schema"][0]).parquet(*paths).join(ids, "document_id", "left_anti"))
                entries = {k: v for k, v in entries.items() if k not in touched}
        if new is not None:
            if "schema" in entries:
                kept = self.spark.createDataFrame([], entries["schema"][0]).columns
                new = new.select(*kept)
            else:
                entries["schema"] = [", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)]
            added.append(new)
        if added:
            columns = added[0].columns
            for key, paths in self._written(reduce(DataFrame.unionByName, [r.select(*columns) for r in added])).items():
                entries[key] = [*entries.get(key, []), *paths]
        for key, rows in (tables or {}).items():
            folder = self.new_folder()
            rows.write.parquet(f"{self.path}/{folder}")
            entries[key] = [folder]
        return self.commit(base, entries)

    def append(self, nodes: DataFrame) -> int:
        return self.change(nodes)

    def replace(self, nodes: DataFrame) -> int:
        """The documents of `nodes`, uploaded again: as they are there, and nothing else of them."""
        return self.change(nodes, nodes.select("document_id"))

    def delete_documents(self, ids: DataFrame) -> int:
        return self.change(gone=ids)

    def delete_layers(self, ids: DataFrame, least: int = 1) -> int:
        return self.change(gone=ids, least=least)

    def compact(self, most: int = 8) -> int:
        """Rewrites the partitions that consist of more than `most` folders."""
        base = self.latest()
        entries = self.entries(base)
        many = [k for k, v in entries.items() if k.startswith("nodes/") and len(v) > most]
        if not many:
            return base
        rows = self.spark.read.schema(entries["schema"][0]).parquet(*(f"{self.path}/{p}" for k in many for p in entries[k]))
        return self.commit(base, entries | self._written(rows))


def repair_trees(table: NodeTable, build: Callable[[DataFrame], DataFrame]) -> int:
    """Rebuilds the trees of the documents whose base nodes changed since their
    tree was built, in one version with the new fingerprints. `build` maps base
    nodes (layer 0) to all nodes of their trees."""
    from grovework.operators.graph import written
    from grovework.streaming.ingest import fingerprints, stale_trees

    nodes = table.nodes()
    known = table.read("fingerprints") if "fingerprints" in table.entries() else fingerprints(nodes.limit(0))
    stale = written(stale_trees(nodes, known), "stale")
    if stale.isEmpty():
        return table.latest()
    made = written(build(nodes.filter("layer = 0").join(stale, "document_id", "left_semi")), "repaired")
    return table.change(made, stale, tables={"fingerprints": fingerprints(nodes)})
