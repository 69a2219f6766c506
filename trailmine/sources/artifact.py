"""The event artifact: a table of events and a manifest that makes it whole.

The table is written beside its place and moved there once complete; the
manifest is written last. Without a manifest there is no artifact.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, conform
from .transcripts import ingest

EVENTS, MANIFEST = "events.parquet", "manifest.json"


class Corrupt(ValueError):
    """A line that can't be read with others after it."""


class Folder:
    """Files through Hadoop's file systems, so that any shared folder serves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._of(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        fs, path = self._of(name)
        fs.delete(path, True)

    def move(self, name: str, to: str) -> None:
        fs, path = self._of(name)
        if not fs.rename(path, self._of(to)[1]):
            raise OSError(f"{name} can't be moved to {to}")

    def write(self, name: str, text: str) -> None:
        fs, path = self._of(name + ".tmp")
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.delete(name)
        self.move(name + ".tmp", name)

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect())


class Writer:
    """Publishes an event table at once, or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.closed, self.staged = Folder(spark, folder), False, EVENTS + ".tmp"

    def write(self, events: DataFrame) -> None:
        events.write.mode("overwrite").partitionBy("p").parquet(f"{self.folder.path}/{self.staged}")

    def close(self) -> None:
        """Puts the staged table in place; a second call does nothing. Where that fails the former one is left."""
        if self.closed:
            return
        self.closed = True
        old = EVENTS + ".old"
        self.folder.delete(old)
        had = self.folder.exists(EVENTS)
        if had:
            self.folder.move(EVENTS, old)
        try:
            self.folder.move(self.staged, EVENTS)
        except Exception:
            if had:
                self.folder.move(old, EVENTS)
            self.folder.delete(self.staged)
            raise
        self.folder.delete(old)

    def abort(self) -> None:
        if not self.closed:
            self.closed = True
            self.folder.delete(self.staged)


def build(spark: SparkSession, root: str, folder: str, project: str = "", dry_run: bool = False) -> dict:
    """Ingests transcripts into an artifact and gives their health. A failed
    write publishes nothing; a dry run writes nothing."""
    from ..session import Scratch

    scratch = Scratch(spark, "ingest")
    found = ingest(spark, root, project, keep=scratch.at("lines"))
    health = found.health()
    if not dry_run:
        place = Folder(spark, folder)
        place.delete(MANIFEST)
        writer = Writer(spark, folder)
        try:
            writer.write(found.events)
            writer.close()
        except Exception:
            writer.abort()
            raise
        place.write(MANIFEST, json.dumps({"created_at": datetime.now(timezone.utc).isoformat(), "root": root, "stats": health}))
    scratch.remove()
    return health


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(Folder(spark, folder).read(MANIFEST))


def ensure(spark: SparkSession, folder: str, root: str) -> None:
    """Ingests if there is no manifest."""
    if not Folder(spark, folder).exists(MANIFEST):
        build(spark, root, folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return conform(spark.read.parquet(f"{folder.rstrip('/')}/{EVENTS}"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of a file of JSON lines with the artifact's short keys. A last
    line that is cut off is dropped, any other that can't be read is an error."""
    rows = spark.read.text(path, wholetext=True)
    lines = rows.select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.trim("line") != "")
    kind = ", ".join(c for c in EVENT.split(", ") if c.split()[0] not in ("f", "seg"))
    parsed = lines.select("n", "line", F.from_json("line", kind + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = parsed.agg(F.min(F.when(F.col("x._bad").isNotNull(), F.col("n"))).alias("bad"), F.max("n").alias("last")).first()
    if bad["bad"] is not None and bad["bad"] < bad["last"]:
        raise Corrupt(f"{path}: line {bad['bad'] + 1} can't be read")
    good = parsed.where("x._bad is null").select(F.col("n").alias("seg"), "x.*").drop("_bad")
    return conform(good.withColumn("f", F.lit(0)))


def write_json_lines(events: DataFrame, path: str) -> None:
    """The events as JSON lines, for other tools; absent fields are left out."""
    columns = [F.nullif(c, F.lit("")).alias(c) if t == "string" and c not in ("p", "s", "k", "act") else F.col(c) for c, t in events.dtypes if c not in ("f", "seg")]
    events.orderBy("f", "i", "seg").select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)
