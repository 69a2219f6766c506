"""Session and shared-folder helpers used by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: dict[str, list[str]] = {}


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailmine")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one
    where that is unset on a local master; elsewhere it has to be set."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        found = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = [tempfile.mkdtemp(prefix="trailmine-")]
            atexit.register(_remove_local, _made[app][0])
        found = "file://" + _made[app][0]
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """A private folder below the shared one for tables that cut lineage.

    Tables are written once and read back, so that a lost executor costs at
    most the tasks that ran on it. remove() deletes the folder; what is left
    goes with the shared folder of the cluster.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    @classmethod
    def at_path(cls, spark: SparkSession, path: str) -> Scratch:
        self = cls.__new__(cls)
        self.spark, self.path = spark, path
        return self

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def remove(self, name: str = "") -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    def make(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.mkdirs(path)

    def rename(self, name: str, to: str) -> None:
        path, fs = self._fs(name)
        if not fs.rename(path, self._fs(to)[0]):
            raise OSError(f"{self.at(name)} can't be renamed to {self.at(to)}")

    def move_files(self, name: str, to: str) -> int:
        """Moves the data files of a folder, if it is there, to another one. How many?"""
        path, fs = self._fs(name)
        found = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("part-")] if fs.exists(path) else []
        if found:
            self.make(to)
        for x in found:
            self.rename(f"{name}/{x.getName()}", f"{to}/{x.getName()}")
        return len(found)

    def bytes_of(self, name: str) -> int:
        path, fs = self._fs(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def write_text(self, name: str, text: str) -> None:
        path, fs = self._fs(name)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, name: str) -> str | None:
        path, fs = self._fs(name)
        if not fs.exists(path):
            return None
        source = fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
