"""A versioned store of tables: Parquet folders and a manifest that is swapped in one rename.

A commit writes new folders, then a manifest; readers keep the version that they opened, and what no manifest names is
not there. One writer at a time holds a lock file. The store's folder must be one that all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import lexical


class Store:
    def __init__(self, spark: SparkSession, path: str, readonly: bool = False):
        self.spark, self.path, self.readonly = spark, Path(path), readonly
        if not readonly:
            self.path.mkdir(parents=True, exist_ok=True)
            self._lock = os.open(self.path / "_lock", os.O_CREAT | os.O_RDWR)
            try:
                import fcntl

                fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                os.close(self._lock)
                raise RuntimeError(f"another writer has {path} open") from e
        self.manifest = self._read()

    def _read(self) -> dict:
        at = self.path / "_manifest.json"
        return json.loads(at.read_text()) if at.exists() else {"version": 0, "tables": {}, "config": {}}

    def close(self) -> None:
        if not self.readonly:
            os.close(self._lock)

    def commit(self, tables: dict[str, DataFrame], append: bool = False, config: dict | None = None, drop: tuple[str, ...] = ()) -> int:
        """Writes the tables (in place of, or appended to, those of the same name) and makes them the current version, without those to drop."""
        if self.readonly:
            raise RuntimeError("the store is open for reading only")
        new = json.loads(json.dumps(self.manifest))
        for name in drop:
            new["tables"].pop(name, None)
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(str(self.path / folder))
            new["tables"][name] = [*(new["tables"].get(name, []) if append else []), folder]
        new["version"] += 1
        new["config"] |= config or {}
        tmp = self.path / f"_manifest-{uuid.uuid4().hex}.json"
        tmp.write_text(json.dumps(new))
        os.replace(tmp, self.path / "_manifest.json")
        self.manifest = new
        return new["version"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[str(self.path / f) for f in self.manifest["tables"][name]])

    def has(self, name: str) -> bool:
        return bool(self.manifest["tables"].get(name))

    def chunks(self) -> DataFrame:
        """The live chunks: without those that were deleted in a later version than their own."""
        c = self.table("chunks")
        if not self.has("deleted"):
            return c.drop("_version")
        d = self.table("deleted").groupBy("doc_id").agg(F.max("_version").alias("_gone"))
        return c.join(d, "doc_id", "left").filter("_gone is null or _version > _gone").drop("_gone", "_version")

    def ingest(self, chunks: DataFrame, config: dict | None = None) -> int:
        """Appends chunks in place of older ones of the same documents, and settings in the same commit."""
        v = self.manifest["version"]
        tables = {"chunks": chunks.withColumn("_version", F.lit(v + 1))}
        if self.has("chunks"):
            tables["deleted"] = chunks.select("doc_id").distinct().withColumn("_version", F.lit(v))
        return self.commit(tables, append=True, config=config)

    def delete(self, doc_ids: DataFrame) -> int:
        """Marks documents as deleted; their number of chunks."""
        n = self.chunks().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").count()
        self.commit({"deleted": doc_ids.select("doc_id").distinct().withColumn("_version", F.lit(self.manifest["version"]))}, append=True)
        return n

    def clear(self) -> int:
        return self.commit({}, drop=tuple(self.manifest["tables"]))

    def compact(self) -> int:
        """Rewrites the chunks without the deleted ones; the number of rows dropped."""
        before, live = self.table("chunks").count(), self.chunks()
        after = live.count()
        self.commit({"chunks": live.withColumn("_version", F.lit(self.manifest["version"] + 1))}, drop=("deleted",))
        return before - after

    def index(self, analyzer: str = "english") -> lexical.LexicalIndex:
        return lexical.LexicalIndex.build(self.chunks(), analyzer)


def stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks."""
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def page(chunks: DataFrame, after: str | int | None = None, size: int = 100) -> DataFrame:
    """The next page of document ids in order, after the last one of the page before (a key, not an offset)."""
    ids = chunks.select("doc_id").distinct()
    return (ids if after is None else ids.filter(F.col("doc_id") > F.lit(after))).orderBy("doc_id").limit(size)
