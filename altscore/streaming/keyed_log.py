"""A table of the newest row of each key, kept as a snapshot and deltas.

``root/data/<name>/`` are folders that are written once; a manifest (one committed
version of ``ModelStore``) says which of them are the table: one snapshot with the
last batch in it, and one delta for each batch since.  A batch appends the rows it
changed.  Compaction writes the state up to a batch as a new snapshot; deltas that
came in the meantime stay deltas.  A reader takes the newest manifest and reads what it
names, so it sees the table before or after a batch or compaction, never in
between, and files it reads are not touched by either.

A batch that is replayed replaces its delta; one that a snapshot already holds is
left out, for a replay brings the same rows.  Whoever loses the race for a manifest's
number builds the next one on that of the winner.  Folders that the last manifests don't name
are deleted by ``vacuum`` only.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.model_store import ModelStore

COMPACT_EVERY = 8          # deltas that lead to a compaction


class KeyedLog:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType, compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.keys, self.compact_every = spark, root.rstrip("/"), keys, compact_every
        self.columns = schema.fieldNames()
        self.schema = StructType(list(schema.fields)).add("_batch", "long")
        self._store = ModelStore(spark, self.root)

    def manifest(self) -> dict:
        m = self._store.latest()
        return m or {"snapshot": None, "upto": -1, "deltas": {}, "version": 0}

    def _commit(self, change) -> dict:
        """Puts the manifest that ``change`` makes of the newest one; again if another came first."""
        patience = 50
        while True:
            taken, m = self._store.highest(), self.manifest()
            if taken > m["version"] and patience:              # a number whose manifest is still being written, or never will be
                patience -= 1
                time.sleep(0.1)
                continue
            new = change(dict(m, deltas=dict(m["deltas"])))
            if new is None:
                return m
            if self._store.commit_at(max(taken, m["version"]) + 1, {k: new[k] for k in ("snapshot", "upto", "deltas")}):
                return new

    def _write(self, df: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex}"
        df.select(*self.columns, "_batch").write.parquet(f"{self.root}/data/{name}")
        return name

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Commits the rows that a batch changed (one for each key)."""
        if batch_id <= self.manifest()["upto"]:
            return
        name = self._write(rows.withColumn("_batch", F.lit(batch_id).cast("long")), f"delta-{batch_id}")

        def change(m):
            if batch_id <= m["upto"]:
                return None
            m["deltas"][str(batch_id)] = name
            return m

        if len(self._commit(change)["deltas"]) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Writes the state of now as a snapshot; batches that come while it is written stay deltas."""
        seen = self.manifest()
        if not seen["deltas"]:
            return
        upto = max(map(int, seen["deltas"]))
        name = self._write(self._state(seen), f"snapshot-{upto}")

        def change(m):
            # another compaction came first, or a batch in this one was replayed: what was written is of no use
            if m["upto"] != seen["upto"] or any(m["deltas"].get(k) != v for k, v in seen["deltas"].items()):
                return None
            later = {k: v for k, v in m["deltas"].items() if int(k) > upto}
            return {"snapshot": name, "upto": upto, "deltas": later, "version": m["version"]}

        self._commit(change)

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{name}")

    def _state(self, m: dict) -> DataFrame:
        """Newest row of each key, with the batch that brought it."""
        names = ([m["snapshot"]] if m["snapshot"] else []) + [m["deltas"][k] for k in sorted(m["deltas"], key=int)]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        if len(names) == 1:
            return self._folder(names[0])
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{n}" for n in names])
        own = [c for c in self.columns if c not in self.keys]
        if len(own) == 1:                  # plain buffers, which are hashed; those of structs are sorted
            rows = rows.groupBy(*self.keys).agg(F.max_by(own[0], "_batch").alias(own[0]), F.max("_batch").alias("_batch"))
            return rows.select(*self.schema.fieldNames())
        newest = F.max_by(F.struct(*own, "_batch"), "_batch")
        rows = rows.groupBy(*self.keys).agg(newest.alias("_newest")).select(*self.keys, "_newest.*")
        return rows.select(*self.schema.fieldNames())

    def read(self, before: int | None = None) -> DataFrame:
        """The table as of the newest manifest, or (for the replay of a batch) without the
        deltas from batch ``before`` on."""
        m = self.manifest()
        if before is not None:
            m = dict(m, deltas={k: v for k, v in m["deltas"].items() if int(k) < before})
        return self._state(m).drop("_batch")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the last ``keep`` manifests names; readers of older ones must be done."""
        named = {n for m in self._store.versions()[-keep:] for n in [m["snapshot"], *m["deltas"].values()] if n}
        gone = [n for n in self._store.folders("data") if n not in named]
        for n in gone:
            self._store.delete(f"data/{n}")
        return gone
