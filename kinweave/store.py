"""Tables as Parquet folders behind snapshots. A snapshot names the folders of all tables, so tables change together.

Documents and mentions lie in buckets by a hash of the document's id; taking in a batch rewrites only the buckets it touches.
Readers keep the snapshot they began with; the last few snapshots stay, older folders are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.schemas import DOCUMENTS, MENTIONS

SCHEMAS = {"documents": DOCUMENTS, "mentions": MENTIONS}
BUCKET_OF = {"documents": "id", "mentions": "document_id"}
BUCKETS, KEPT = 64, 3


def bucket(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(BUCKETS)).cast("int")


class Store:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        at, fs = self._path("_snapshots")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "_")

    def snapshot(self, number: int | None = None) -> dict[str, dict[str, str]]:
        """Of each table the folder of each bucket ("all" if it has none)."""
        known = self.snapshots()
        if not known:
            return {}
        at, fs = self._path("_snapshots", f"{known[-1] if number is None else number}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return name in self.snapshot()

    def read(self, name: str, schema: T.StructType | str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of the last snapshot, or some of its buckets; empty if nothing was written."""
        folders = self.snapshot().get(name, {})
        schema = schema or SCHEMAS.get(name)
        paths = [f"{self.root}/{name}/{folder}" + (f"/bucket={b}" if b != "all" else "") for b, folder in sorted(folders.items()) if buckets is None or b == "all" or int(b) in buckets]
        if not paths:
            if schema is None:
                raise ValueError(f"there is no table {name}")
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(*paths)

    def commit(self, tables: dict[str, DataFrame], buckets: dict[str, list[int]] | None = None) -> int:
        """Write tables and make them one snapshot with those that aren't given.

        Tables that ``buckets`` names hold just those buckets, and replace only them.
        """
        known = self.snapshots()
        state = self.snapshot()
        number = (known or [0])[-1] + 1
        for name, df in tables.items():
            folder = f"v{number}-{uuid.uuid4().hex[:8]}"
            if name in BUCKET_OF:
                parted = df.withColumn("bucket", bucket(F.col(BUCKET_OF[name])))
                parted.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
                at, fs = self._path(name, folder)
                made = {s.getPath().getName().split("=")[1]: folder for s in fs.listStatus(at) if "=" in s.getPath().getName()}
                given = (buckets or {}).get(name)
                kept = {} if given is None else {b: f for b, f in state.get(name, {}).items() if int(b) not in given}
                state[name] = kept | made
            else:
                df.write.parquet(f"{self.root}/{name}/{folder}")
                state[name] = {"all": folder}
        at, fs = self._path("_snapshots", f"_{number}-{uuid.uuid4().hex}.tmp")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(at, self._path("_snapshots", f"{number}.json")[0]):
            raise RuntimeError(f"snapshot {number} was written by someone else")
        self._clean()
        return number

    def _clean(self) -> None:
        """Delete snapshots but the last ones, and folders that none of those names."""
        known = self.snapshots()
        if len(known) <= KEPT:
            return
        used = {(name, folder) for n in known[-KEPT:] for name, folders in self.snapshot(n).items() for folder in folders.values()}
        for n in known[:-KEPT]:
            for name, folders in self.snapshot(n).items():
                for folder in set(folders.values()):
                    if (name, folder) not in used:
                        at, fs = self._path(name, folder)
                        fs.delete(at, True)
            at, fs = self._path("_snapshots", f"{n}.json")
            fs.delete(at, False)
