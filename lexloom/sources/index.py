"""Stored vector indexes: vectors in a folder for each cell, and what made them, so that a search reads probed cells only.

An index is a folder of versions; the meta row of a version is written last, so a reader never sees half of one. The
meta row has the model, its dimension and the prefixes of both kinds of text, which encoders of queries read from it.

Edge cases: null vectors are not indexed; an index of fewer than four vectors has one cell, and one of none finds
nothing; repeated ids are rows of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import patterns as P
from lexloom.operators import judge, search

META = "version string, creado timestamp, backend string, model string, dim int, prefix_doc string, prefix_query string, cells int, n long, centers array<array<double>>, esquema string"


def clamps(n: int) -> tuple[int, int]:
    """Cells for n vectors, and how many a search probes if nothing else is said."""
    cells = max(4, int(n**0.5))
    return cells, max(1, cells // 4)


@dataclass(frozen=True)
class Index:
    """An index that has been read: its meta row and its vectors (element_id, embedding, cell, ...)."""

    meta: dict
    rows: DataFrame

    def encode(self, text: Column, encoder: Callable[[Column], Column], query: bool = True) -> Column:
        """A text's vector, with the prefix that this index's model wants for its kind of text."""
        return encoder(judge.prefixed(text, self.meta["prefix_query" if query else "prefix_doc"]))


def _nearest(centers: list[list[float]], most: int):
    """Column function: the cells whose centers are nearest by inner product, the nearest first."""
    at = np.array(centers, float)

    @F.arrow_udf("array<int>")
    def cells(column: pa.Array) -> pa.Array:
        flat = np.asarray(column.flatten(), float).reshape(len(column), -1)
        order = np.argsort(-(flat @ at.T), axis=1, kind="stable")[:, :most].astype(np.int32)
        offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * order.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))

    return cells


def build(vectors: DataFrame, path: str, model: str, dim: int, backend: str = "local", prefix_doc: str = "", prefix_query: str = "", sample: int = 50_000, seed: int = 7) -> None:
    """Write a version of an index of `vectors` (element_id, embedding, ...); the cells come of a bounded sample, which
    decides how well a search that probes few of them does, and every vector is in one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, version = vectors.sparkSession, uuid.uuid4().hex
    rows = vectors.where("embedding IS NOT NULL")
    n = rows.count()
    cells, centers = clamps(min(n, sample))[0], [[0.0] * dim]
    if n >= cells:
        few = rows.where(F.pmod(F.xxhash64("element_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)))
        few = few if n <= sample else few.limit(sample)
        fitted = KMeans(k=cells, seed=seed, maxIter=10).fit(few.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        centers = [[float(x) for x in c] for c in fitted.clusterCenters()]
    placed = rows.withColumn("cell", _nearest(centers, 1)(F.col("embedding").cast("array<double>"))[0])
    # a cell is dealt to several tasks, so that a large one is no single task's and no single file
    placed.repartition("cell", F.pmod(F.xxhash64("element_id"), F.lit(16))).write.partitionBy("cell").parquet(f"{path}/v-{version}")
    meta = spark.createDataFrame([(version, None, backend, model, dim, prefix_doc, prefix_query, len(centers), n, centers, placed.schema.json())], META)
    meta.withColumn("creado", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, model: str | None = None, dim: int | None = None) -> Index:
    """The newest version; one by another model or of another dimension is rejected."""
    meta = spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("creado"), "version").first().asDict()
    if (model is not None and meta["model"] != model) or (dim is not None and meta["dim"] != dim):
        raise ValueError(f"the index holds vectors of {meta['model']} with {meta['dim']} dimensions")
    kind = T.StructType.fromJson(json.loads(meta["esquema"]))
    return Index(meta, spark.read.schema(kind).parquet(f"{path}/v-{meta['version']}"))


def find(index: Index, queries: DataFrame, k: int = P.TOP_K, probes: int | None = None) -> DataFrame:
    """(query_id, element_id, score, rank): approximate top-k of `queries` (query_id, embedding).

    Each query meets the vectors of its `probes` nearest cells only, and only cells that some query probes are read.
    """
    probes = clamps(index.meta["n"])[1] if probes is None else probes
    probed = queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    probed = probed.withColumn("cells", _nearest(index.meta["centers"], min(probes, index.meta["cells"]))(F.col("embedding")))
    read = [r.cell for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most the cells
    return search.top_k(probed, index.rows.where(F.col("cell").isin(read)), k)

