"""What the operators of this subpackage share: the shared folder, tables in it, components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import os
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = "[\\x20\\x09-\\x0D]+"
_TEMP: dict[str, str] = {}
#: Where table() notes the folders it writes, if within scratch().
_NOTED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it.

    Only a local session without that setting (as in tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _TEMP.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="winnowry-"))
    return base.rstrip("/") + "/winnowry"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A path for plain file access; the shared folder must be mounted where executors run."""
    path = path[len("file://") :] if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path or path.startswith(("hdfs:", "s3a:", "s3:", "gs:", "abfs")):
        raise ValueError(f"{path}: this operator reads and writes plain files, so spark.checkpoint.dir must be a mounted folder")
    return path


def table(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """The rows of df, written once to the shared folder: cuts lineage, survives lost executors.

    The shuffle files behind it are of no use any more. Spark deletes them when the driver's JVM
    has collected what refers to them; release asks it to, lest they pile up on the workers' disks.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    noted = _NOTED.get()
    if noted is not None:
        noted.append(path)
    if release:
        gc.collect()
        for _ in range(2):  # the first collection lets go of the finished query, the second of its shuffles
            df.sparkSession._jvm.System.gc()
            time.sleep(0.5)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written within are deleted at the end: whatever is computed from them must be written by then, as by kept_table()."""
    mark = _NOTED.set([])
    try:
        yield
    finally:
        for path in _NOTED.get() or ():
            delete(spark, path)
        _NOTED.reset(mark)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """A table() that outlives the scratch() it is written in."""
    mark = _NOTED.set(None)
    try:
        return table(df, name)
    finally:
        _NOTED.reset(mark)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/winnowry/" in folder:
            delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows, of 64 bits each, that sieved() broadcasts; a power of two.
SIEVE = 1 << 19


def sieved(df: DataFrame, key: Column, others: DataFrame, other_key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key, a hash, may be among those of others, and all the rest, whose key is not.

    Rows are told apart where they lie, by one bit for each key of others in a broadcast table of
    bounded size, so that a join with few of many texts need not send the others. Keys that clash
    there let a row be taken for a possible one (for a million keys one row in 30), never the other
    way; what is joined must be joined exactly afterwards.
    """
    slot = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(SIEVE - 1)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))
    bits = F.broadcast(others.select(slot(other_key).alias("_slot"), bit(other_key).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits")))
    met = (slot(key) == bits["_slot"]) & (bits["_bits"].bitwiseAND(bit(key)) != 0)
    return df.join(bits, met, "left_semi"), df.join(bits, met, "left_anti")


def released(batches):
    """For functions that mapInArrow runs: no garbage collection of cycles meanwhile; memory goes back to the system when the task ends."""

    @functools.wraps(batches)
    def run(stream):
        gc.disable()
        try:
            yield from batches(stream)
        finally:
            gc.enable()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def lowered_words(text):
    """The words of a text between ASCII white space, A-Z lower-cased; none for null or blank."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, WS), lambda w: w != "")


def word_hashes(text):
    """array<bigint>: a 64-bit hash for each lower-cased word."""
    return F.transform(lowered_words(text), lambda w: F.xxhash64(w))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (uint64); fewer words than k give one hash of them all."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return h


def list_values(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values (uint64) of an Arrow list<int64> array; nulls are empty lists."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return offsets, values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.int64).view(np.uint64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over edges (u, v); nodes without an edge are absent.

    Alternating large-star and small-star contraction: every round is two grouped minima joined
    back, so neither a hub nor a component is ever gathered in one task. Each round is written
    to the shared folder.
    """
    e = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "u", "m")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = table(small, "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        with contextlib.suppress(Exception):
            drop_table(e)
        e = new
        if mark == last or mark[0] == 0:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
