"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


# Of tables this package writes: a quarter less than Spark's default on prose.
CODEC = "zstd"


def ship_by_value() -> None:
    """Send this package's functions along with the tasks.

    For use where the package is on the driver only. Where it is installed on all
    executors, as for backends with a module of their own, this is not needed.
    """
    cloudpickle.register_pickle_by_value(sys.modules["glossa"])


def local_session(cpus: int = 8, app: str = "glossa", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glossa-"))
    return spark.sparkContext.getCheckpointDir()


def folder_value(value: str) -> str:
    """A value as Spark writes it into the name of a partition folder."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def task_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder as tasks reach it without Spark, named by ``FileSystem.uri``."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class FileSystem:
    """The few Hadoop file system calls that Spark's readers and writers lack."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._text = jvm.org.apache.commons.io.IOUtils
        self._path = jvm.org.apache.hadoop.fs.Path
        self._uri = jvm.java.net.URI
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def has_data(self, path: str) -> bool:
        """True once a job has committed something below ``path``."""
        if not self.exists(path):
            return False
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(path)))
        return any(not n.startswith(("_", ".")) for n in names)

    def size(self, uri: str) -> int:
        """Bytes of a file, named as Spark names its input files."""
        return self._fs.getFileStatus(self._path(self._uri(uri))).getLen()

    def encoded(self, path: str) -> str:
        """The path as it stands in the URIs of its files."""
        return self._path(path).toUri().getRawPath()

    def uri(self, path: str) -> str:
        """What ``task_folder`` calls the path."""
        return self._fs.makeQualified(self._path(path)).toUri().toASCIIString()

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        found = (s for s in self._fs.listStatus(self._path(path)) if s.isDirectory())
        names = (s.getPath().getName() for s in found)
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def files(self, path: str) -> list[str]:
        found = (s for s in self._fs.listStatus(self._path(path)) if s.isFile())
        return sorted(s.getPath().getName() for s in found)

    def write_text(self, path: str, text: str) -> None:
        """A small file, for which a Spark job would be too much."""
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def move_files(self, old: str, new: str, prefix: str) -> None:
        """Move the data files of a folder to another, where their names get the prefix.

        What was moved by a run that ended half-way is left as it is.
        """
        self._fs.mkdirs(self._path(new))
        for name in self.files(old):
            if not name.startswith(("_", ".")) and not self.exists(f"{new}/{prefix}{name}"):
                self.rename(f"{old}/{name}", f"{new}/{prefix}{name}")

    def replace(self, path: str, new: str) -> None:
        """Put the folder ``new`` in the place of ``path``; see ``recover``."""
        self.rename(path, f"{path}.old")
        self.rename(new, path)
        self.delete(f"{path}.old")

    def recover(self, path: str) -> None:
        """Undo a ``replace`` that stopped half-way, or finish cleaning up after it."""
        if self.exists(f"{path}.old"):
            if self.exists(path):
                self.delete(f"{path}.old")
            else:
                self.rename(f"{path}.old", path)


class WorkFolder:
    """Tables one job writes to cut lineage and to read again.

    A written table survives lost executors, and its columns can be read apart,
    which a checkpoint does not offer.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_dir(spark)}/glossa/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write_slices(self, df: DataFrame, name: str, by: str) -> list[DataFrame]:
        """Write ``df`` in one folder per value of ``by`` and give back each of them."""
        path = self.path(name)
        df.write.mode("overwrite").partitionBy(by).parquet(path, compression=CODEC)
        schema = df.drop(by).schema
        folders = FileSystem(self.spark, path).folders(path)
        return [self.spark.read.schema(schema).parquet(f"{path}/{f}") for f in folders]

    def write(self, df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
        """Write ``df`` and give back the stored table, of files with so many rows at most."""
        out = df.write.mode("overwrite")
        if rows_per_file:
            out = out.option("maxRecordsPerFile", rows_per_file)
        out.parquet(self.path(name), compression=CODEC)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def delete(self, name: str) -> None:
        """Give up one table, long before the others."""
        FileSystem(self.spark, self.root).delete(self.path(name))

    def drop(self) -> None:
        FileSystem(self.spark, self.root).delete(self.root)
