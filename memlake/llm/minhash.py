"""Minwise signatures of sets, shared by the similarity joins.

A set is an array of 64-bit value hashes. Signatures are made in numpy over whole
Arrow batches: one multiply-add over all values of the batch and one reduceat for
each hash function. Everything else stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.session import materialize


def hash_parameters(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that combined keys spread evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (starting at 0) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def band_keys(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """(sets, bands) keys; two sets share a band's key when all its rows of minima agree. Sets must not be empty."""
    flat = values.view(np.uint64)
    a, b = hash_parameters(bands * rows, seed)
    keys = np.empty((len(offsets) - 1, bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(offsets) - 1, band + 1, dtype=np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            key = mix(key ^ np.minimum.reduceat(flat * a[j] + b[j], offsets[:-1]))
        keys[:, band] = key
    return keys


def bitmaps(values: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Bitmap of each set, in words of 64 bits: a bit is set if some value falls into its slot."""
    slot = mix(values.view(np.uint64)) >> np.uint64(48)
    bits, word = np.uint64(1) << (slot & np.uint64(63)), (slot >> np.uint64(6)) % np.uint64(words)
    return [np.bitwise_or.reduceat(np.where(word == w, bits, np.uint64(0)), offsets[:-1]).view(np.int64) for w in range(words)]


def classed(records: DataFrame, ident: Column, values: Column, min_size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Classes (cid, values) of records with equal sets of at least min_size values, and their members (cid, id).

    Sets are told apart by 128 bits of their values' hashes; the class number is given out once, in a written table.
    """
    base = materialize(
        records.where(ident.isNotNull()).select(ident.alias("id"), F.sort_array(values).alias("values"))
        .where(F.size("values") >= min_size)
        .select("id", "values", F.xxhash64("values").alias("h"), F.xxhash64(F.lit(name), "values").alias("g")),
        f"{name}-sets",
    )
    groups = base.groupBy("h", "g").agg(F.first("values").alias("values")).select(F.monotonically_increasing_id().alias("cid"), "h", "g", "values")
    classes = materialize(groups, f"{name}-classes")
    members = materialize(base.select("id", "h", "g").join(classes.select("cid", "h", "g"), ["h", "g"]).select("cid", "id").distinct(), f"{name}-members")
    return classes.select("cid", "values"), members


def banded(classes: DataFrame, bands: int, rows: int, seed: int, words: int) -> DataFrame:
    """(cid, values) to one row for each band: key, cid, n, bitmap words b0, b1, ..."""
    maps = [f"b{w}" for w in range(words)]

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = list_parts(batch.column(1))
            keys = band_keys(values, offsets, bands, rows, seed)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets).astype(np.int32)),
                    *[pa.array(m) for m in bitmaps(values, offsets, words)],
                    lists,
                ],
                names=["cid", "n", *maps, "keys"],
            )

    schema = "cid long, n int, " + "".join(f"{m} long, " for m in maps) + "keys array<long>"
    return classes.select("cid", "values").mapInArrow(signatures, schema).select(F.explode("keys").alias("key"), "cid", "n", *maps)


def similar_classes(
    classes: DataFrame, bands: int, rows: int, seed: int, numerator: int, denominator: int, bitmap_words: int = 1
) -> DataFrame:
    """Pairs of classes (cid, values) with Jaccard similarity of at least numerator/denominator.

    Records that share a band's bucket are joined. Two exact bounds sit in the join
    condition, so that few pairs leave it: the ratio of the sizes, and the number of
    differing bitmap bits, which never exceeds the size of the symmetric difference.
    Candidates are made distinct and verified on the whole sets.
    """
    p, q = numerator, denominator
    buckets = banded(classes, bands, rows, seed, bitmap_words)
    a, b = buckets.alias("a"), buckets.alias("b")
    total = F.col("a.n") + F.col("b.n")
    differing = sum(F.bit_count(F.col(f"a.b{w}").bitwiseXOR(F.col(f"b.b{w}"))) for w in range(bitmap_words))
    candidates = (
        a.join(
            b,
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.cid") < F.col("b.cid"))
            & (F.least("a.n", "b.n") * q >= F.greatest("a.n", "b.n") * p)
            & (differing * (q + p) <= total * (q - p)),
        )
        .select(F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b"))
        .distinct()
    )
    return verified(candidates, classes, p, q)


def verified(candidates: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """The candidates (cid_a, cid_b) whose whole sets have a Jaccard similarity of at least p/q."""
    left = classes.select(F.col("cid").alias("cid_a"), F.col("values").alias("values_a"))
    right = classes.select(F.col("cid").alias("cid_b"), F.col("values").alias("values_b"))
    shared = F.size(F.array_intersect("values_a", "values_b"))
    return (
        candidates.join(left, "cid_a")
        .join(right, "cid_b")
        .where(shared * (q + p) >= (F.size("values_a") + F.size("values_b")) * p)
        .select("cid_a", "cid_b")
    )


def expand_pairs(class_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of classes, and the pairs within each class, as distinct pairs of different ids with the smaller id first.

    Their number grows with the square of a class; where pairs of classes and the members do, use those.
    """
    a = members.select(F.col("cid").alias("cid_a"), F.col("id").alias("x"))
    b = members.select(F.col("cid").alias("cid_b"), F.col("id").alias("y"))
    across = class_pairs.join(a, "cid_a").join(b, "cid_b").select("x", "y")
    within = a.join(b, (F.col("cid_a") == F.col("cid_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    pairs = across.where(F.col("x") != F.col("y")).union(within)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
