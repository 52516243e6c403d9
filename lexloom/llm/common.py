"""Shared helpers: stage tables in the shared folder, byte words, hashes, bounded slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker takes apart at once (a longer single text is taken alone).
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch in the steps that write a stage table, so that two workers fit beside an executor's heap.
BATCH_BYTES = 16 << 20
_MEMO_WORDS = 1 << 17
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; where that is unset (tests), one of our own.

    Without the setting a cluster's executors would write to disks of their own, so only a local master may go without.
    """
    global _local_dir
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return _local_dir


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most `BATCH_BYTES` meanwhile; the session keeps its own setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, told)


class Stages:
    """Tables written between the steps of one operator: they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it back."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        with _small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of kept tables that no later step reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column of a user's has it (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key that holds more than one in so many rows (and more than HOT_ROWS) is dealt to several tasks; so there are fewer
#: such keys than HOT_SHARE, whatever the data.
HOT_SHARE, HOT_ROWS = 4096, 256


def hot_join(rows: DataFrame, single: DataFrame, key: str | list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `single`, which has one row for each `key`; the rows of hot keys are dealt by a salt as well.

    `counts` has the key and n of `rows` where they are known; both sides should be kept tables, as they are read twice.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    counts = counts.dropna(subset=keys)
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return rows.join(single, keys, how)
    hot = [(*(r[k] for k in keys), -(-r["n"] // limit)) for r in counts.where(F.col("n") > limit).collect()]  # fewer than HOT_SHARE
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    salts = F.broadcast(rows.sparkSession.createDataFrame(hot, T.StructType([*fields, T.StructField("_salts", T.IntegerType())])))
    dealt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_salts"))).cast("int")
    left = rows.join(salts, keys, "left").withColumn("_salt", dealt).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = single.join(salts, keys, "left").withColumn("_salt", copies).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most `limit`, or that hold one item."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def byte_texts(column: pa.Array) -> Iterator[list[bytes]]:
    """Slices of a binary or string column as bytes; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    for a, b in slices(sizes):
        yield [t or b"" for t in column.slice(a, b - a).to_pylist()]


def over_slices(df: DataFrame, make: Callable[[list[bytes]], list[pa.Array]], schema: str, text: str = "text") -> DataFrame:
    """The other columns of `df` and what `make` gives for slices of its texts: a slice is in memory at a time."""
    others = [c for c in df.columns if c != text]
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in byte_texts(batch.column(text)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *make(texts)], names)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A bounded memory of a function of one argument."""

    def __init__(self, function, most: int = _MEMO_WORDS):
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


_word_hash = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and the number of words of each text."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    one = _word_hash.__getitem__
    hashes = np.fromiter((one(w) for text in words for w in text), np.uint64, int(counts.sum()))
    return hashes, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from values in a row and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
