"""Session helpers: defaults for the engine and the shared work folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One customer / supplier may own a third of all rows: let AQE split
    # skewed sort-merge partitions of the fact side at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Partition sizing for large inputs: AQE merges small shuffle partitions
    # up to the advisory size and splits skewed ones; scans are cut into
    # 256 MB splits so no task holds more than it can aggregate in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # Honour that size instead of maximising task count (Spark's advice for
    # shared clusters): fewer, fuller post-shuffle tasks.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(master: str | None = None, app: str = "caudal",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints and derived tables.

    Read from ``spark.checkpoint.dir``, or the directory already set on the
    context. Where neither is set, a local session (tests, where driver and
    executors are one process) gets a folder of its own; any other session is
    an error, because a machine-local folder would not survive the loss of the
    executor that wrote it. Checkpoints are pointed to the folder if the
    context has none yet.
    """
    current = spark.sparkContext.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or current
    if not folder:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        folder = tempfile.mkdtemp(prefix="caudal-ckpt-")
    if not current:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop-filesystem existence check (works for hdfs://, s3a://, file:)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _listing(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """Path, length and time of what a folder holds (or of the file itself), by one call."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    said = jvm.scala.runtime.ScalaRunTime.stringOf(fs.listStatus(p))
    return [dict(x.split("=", 1) for x in status.split("; ") if "=" in x) for status in said.split("FileStatus{")[1:]]


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``."""
    return [f["path"].rstrip("/").rsplit("/", 1)[-1] for f in _listing(spark, path) if f["isDirectory"] == "true"]


def _files(spark: SparkSession, path: str) -> Iterator[dict[str, str]]:
    """The files of an input file or folder, by one listing call per folder."""
    folders = [path]
    while folders:
        for f in sorted(_listing(spark, folders.pop()), key=lambda f: f["path"]):
            if f["isDirectory"] == "true":
                folders.append(f["path"])
            else:
                yield f


def input_signature(spark: SparkSession, path: str) -> str:
    """Change detector for an input file or folder: path, length and time of every file."""
    digest = hashlib.sha1()
    for f in _files(spark, path):
        digest.update(f"{f['path']}|{f['length']}|{f['modification_time']}\n".encode())
    return digest.hexdigest()


def input_bytes(spark: SparkSession, path: str) -> int:
    return sum(int(f["length"]) for f in _files(spark, path))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers see whole or not at all: written beside its place, then moved there."""
    aside, fs = _file_system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not fs.rename(aside, _file_system(spark, path)[0]):
        raise OSError(f"cannot publish {path}")


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path`` (hidden ones left out); none where it does not exist."""
    if not path_exists(spark, path):
        return []
    names = (f["path"].rstrip("/").rsplit("/", 1)[-1] for f in _listing(spark, path) if f["isDirectory"] == "false")
    return sorted(n for n in names if not n.startswith((".", "_")))


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """``source`` becomes ``target``, which must not be there yet, in one move."""
    (src, fs), (dst, _) = _file_system(spark, source), _file_system(spark, target)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)
