"""Vector expressions on array columns; sums run in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from _md5 import md5  # a quarter of the time that OpenSSL's takes to set up a short hash
except ImportError:
    from hashlib import md5


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int) -> Column:
    """`x` to so many digits as SQL engines and NumPy do it: the product is rounded, half away from zero. F.round rounds
    the shortest decimal text of `x`, which differs for some scores that end in 5."""
    return F.round(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def _once(value: Column, body) -> Column:
    """`body(value)` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(v: Column) -> Column:
    """`v` over its norm; a zero vector stays zero."""

    def scaled(u: Column) -> Column:
        norm = F.sqrt(dot(u, u))
        return _once(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(u, lambda x: x.cast("double") / n))

    return _once(v, scaled)


#: Rows of texts that a Python task holds as objects at a time; what it holds doesn't grow with Spark's batches.
SLICE = 256


def sliced(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of some columns as Python objects, SLICE of them at a time."""
    for at in range(0, len(columns[0]), SLICE):
        yield from zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)


def _hashed(lists: pa.ListArray, dim: int) -> np.ndarray:
    """For each list of words the counts by md5 bucket, normalised; empty words don't count."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    told = lists.flatten().dictionary_encode()
    words = told.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    buckets = np.frombuffer(b"".join([md5(w).digest()[:4] for w in words]), ">u4").astype(np.int64) % dim
    buckets[words == b""] = dim  # one bucket more takes the empty words
    place = np.repeat(np.arange(len(lists)), sizes) * (dim + 1) + (buckets[told.indices.to_numpy()] if len(told) else 0)
    out = np.bincount(place, minlength=len(lists) * (dim + 1)).reshape(len(lists), dim + 1)[:, :dim].astype(float)
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(norms == 0, 1.0, norms)[:, None]


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic offline embedding: counts of the lower-case words between white space by md5 bucket, normalised.

    Texts are passed whole and split inside tasks; only the distinct words of SLICE rows become Python objects.
    """

    @F.arrow_udf("array<double>")
    def embedded(column: pa.Array) -> pa.Array:
        parts = [_hashed(pc.split_pattern(column.slice(at, SLICE), " "), dim) for at in range(0, len(column), SLICE)]
        offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * dim, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros((0, dim)), *parts]).ravel()))

    return embedded(F.lower(F.translate(text, "\n\t", "  ")))
