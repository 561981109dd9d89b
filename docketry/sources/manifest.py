"""Tables of Parquet folders whose changes take effect all at once.

What a table holds is told by the newest of its manifests, small files that are renamed into place last: a
write that is cut off halfway leaves the table as it was, and readers of an older manifest keep their folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

OWNER = "__owner"


class Manifest:
    """The table below a path, in any store that Spark writes. One writer at a time: a second one's commit fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        at = self._Path(f"{self.path}/{below}")
        return sorted(f.getPath().getName() for f in self._store.listStatus(at)) if self._store.exists(at) else []

    def version(self) -> int:
        """0 where there is no table yet."""
        return max((int(n.removesuffix(".json")) for n in self._names("_manifests") if n[0] != "."), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._store.open(self._Path(f"{self.path}/_manifests/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def parts(self) -> list[dict]:
        """What the table holds: a folder each, with the labels it was written under."""
        version = self.version()
        return self._manifest(version)["parts"] if version else []

    def read(self, parts: list[dict] | None = None) -> DataFrame:
        """The rows of the table, or of some of its parts."""
        version = self.version()
        if not version:
            raise FileNotFoundError(f"no table at {self.path}")
        told = self._manifest(version)
        schema = StructType.fromJson(json.loads(told["schema"]))
        folders = [f"{self.path}/{p['folder']}" for p in (told["parts"] if parts is None else parts)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, **labels) -> dict:
        """A new part; it belongs to no table before it is committed."""
        folder = f"part-{self.version() + 1:010d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, **labels}

    def write_by(self, df: DataFrame, column: str) -> list[dict]:
        """A new part for each value of a column, by one write."""
        folder = f"part-{self.version() + 1:010d}-{uuid.uuid4().hex}"
        df.withColumn(OWNER, df[column]).write.partitionBy(OWNER).parquet(f"{self.path}/{folder}")
        return [{"folder": f"{folder}/{n}", "owner": n} for n in self._names(folder) if n.startswith(f"{OWNER}=")]

    def commit(self, parts: list[dict], schema: StructType) -> None:
        """From now on the table holds these parts."""
        at = self.version() + 1
        draft = self._Path(f"{self.path}/_manifests/.{at:010d}-{uuid.uuid4().hex}")
        stream = self._store.create(draft)
        try:
            stream.write(bytearray(json.dumps({"schema": schema.json(), "parts": parts}).encode()))
        finally:
            stream.close()
        place = self._Path(f"{self.path}/_manifests/{at:010d}.json")
        if self._store.exists(place) or not self._store.rename(draft, place):
            self._store.delete(draft, False)
            raise RuntimeError(f"another writer has changed {self.path}")

    def replace(self, df: DataFrame) -> None:
        """The table holds df's rows instead; df may read the table itself."""
        self.commit([self.write(df)], df.schema)
        self.clear()

    def clear(self, versions: int = 2) -> None:
        """Removes folders and manifests that the last versions don't name."""
        first = self.version() - versions + 1
        named = {p["folder"].split("/")[0] for v in range(max(1, first), self.version() + 1) for p in self._manifest(v)["parts"]}
        for n in self._names(""):
            if n.startswith("part-") and n not in named and int(n.split("-")[1]) <= self.version():
                self._store.delete(self._Path(f"{self.path}/{n}"), True)
        for n in self._names("_manifests"):
            if n[0] != "." and int(n.removesuffix(".json")) < first:
                self._store.delete(self._Path(f"{self.path}/_manifests/{n}"), False)
