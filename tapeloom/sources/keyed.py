"""A keyed table of Parquet folders whose upserts rewrite only the key ranges that rows arrive for.

Rows lie in ``parts`` folders by the hash of their key. A manifest, one small file, names the live folder of every part;
an upsert writes new folders beside the old ones and then renames the next manifest into place, so that readers see the
version before or the version after. Folders that neither the newest manifest nor the one before it names are deleted.
A store has one writer at a time, as a stream has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import stored

PART = "_part"


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    live: dict[int, int] = field(default_factory=dict)
    schema: str = ""


class Files:
    """The few file operations a store needs, on whatever file system its folder is on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, pattern: str) -> list[str]:
        return [s.getPath().toString() for s in self.fs.globStatus(self.path(pattern)) or []]

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside ``name`` and rename: the file is there in whole or not at all."""
        pending = f"{name}.{uuid.uuid4().hex}.pending"
        out = self.fs.create(self.path(pending), False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.path(pending), self.path(name)):
            raise OSError(f"{name} could not be put in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class KeyedStore:
    """Rows by ``keys`` in ``folder``. ``parts`` belongs to the store for good; it bounds the manifest and what the driver sees."""

    folder: str
    keys: Sequence[str]
    parts: int = 64

    def _place(self, part: int, version: int) -> str:
        return f"{self.folder}/data/v={version}/{PART}={part}"

    def _manifests(self, files: Files) -> dict[int, str]:
        return {int(n.rsplit("/v-", 1)[1][:-5]): n for n in files.names(f"{self.folder}/manifest/v-*.json")}

    def manifest(self, spark: SparkSession) -> Manifest:
        """The newest published manifest; version -1 for a folder without one."""
        files = Files(spark, self.folder)
        known = self._manifests(files)
        if not known:
            return Manifest()
        got = json.loads(files.text(known[max(known)]))
        return Manifest(got["version"], {int(p): v for p, v in got["live"].items()}, got["schema"])

    def _rows(self, spark: SparkSession, at: Manifest, parts: Sequence[int]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(at.schema))
        places = [self._place(p, at.live[p]) for p in parts if p in at.live]
        return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        at = self.manifest(spark)
        if at.version < 0:
            raise FileNotFoundError(f"{self.folder} holds no published version")
        return self._rows(spark, at, sorted(at.live))

    def upsert(self, incoming: DataFrame, version: int | None = None) -> list[int]:
        """Replace the rows of every key that arrives by all its arriving rows; returns the parts written.

        A null key is a key like any other. With ``version`` (a stream's batch number) a version that is already
        published is left as it is, so a repeated batch changes nothing. New columns are refused.
        """
        spark = incoming.sparkSession
        before = self.manifest(spark)
        version = before.version + 1 if version is None else version
        if version <= before.version:
            return []
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        with stored(incoming.withColumn(PART, part)) as rows:
            touched = sorted(r[0] for r in rows.select(PART).distinct().collect())
            out = rows
            if before.version >= 0:
                old = self._rows(spark, before, touched).withColumn(PART, part)
                arriving = rows.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).distinct()
                same = F.lit(True)
                for k in self.keys:
                    same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
                out = old.join(arriving, same, "left_anti").unionByName(rows)
            if touched:
                out.hint("rebalance", F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(f"{self.folder}/data/v={version}")
            self._publish(spark, before, Manifest(version, {**before.live, **dict.fromkeys(touched, version)}, before.schema or incoming.schema.json()))
        return touched

    def _publish(self, spark: SparkSession, before: Manifest, after: Manifest) -> None:
        files = Files(spark, self.folder)
        files.publish(f"{self.folder}/manifest/v-{after.version:012d}.json", json.dumps({"version": after.version, "live": after.live, "schema": after.schema}))
        self.tidy(spark, before, after)

    def tidy(self, spark: SparkSession, before: Manifest, after: Manifest) -> None:
        """Delete what the two newest manifests do not name."""
        files = Files(spark, self.folder)
        live = {self._place(p, v).split("/data/", 1)[1] for m in (before, after) for p, v in m.live.items()}
        for name in files.names(f"{self.folder}/data/v=*/{PART}=*"):
            if name.split("/data/")[-1] not in live:
                files.delete(name)
        for version, name in self._manifests(files).items():
            if version not in (before.version, after.version):
                files.delete(name)
