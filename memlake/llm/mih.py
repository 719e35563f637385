"""Problem 5: the most similar vectors for every vector.

Method: multi-index hashing. Rotations are learned on a bounded sample (iterative quantisation:
principal axes, then the rotation that brings the points nearest to the corners of the cube). The bits of a vector's
code say on which side of a cut it lies along each rotated axis; the cut of a bit is the median of those sample rows that share the
bits before it, so that dense regions are cut as finely as sparse ones. The code is split into substrings, one for each table, and
every vector is indexed by its substring in every table. A lookup probes in each table the vector's own bucket and then
the buckets that are reached by flipping bits, those first whose flipped bits lie nearest to their cuts (the Hamming distance
in which each bit weighs the square of its distance from the cut), until the radius of `probes` buckets is exhausted. As
every row is a query too, all rows that a bucket holds or that probe it are ranked against each other.

Rows in a bucket grow as LEAF * rows ** GROWTH, the probes stay the same: disk and network grow in proportion to the collection, and
the time for each row with the power GROWTH, which is what keeps the recall up as buckets multiply (README has recall measured at
several sizes). `exact=True` is the setting that misses nothing: one bucket, ranked in pairs of blocks.

Vectors travel as unit vectors of 12 bits a component. Whatever that leaves open is settled on the vectors as they were given: all candidates
whose packed cosine lies within ERROR of the k-th place are ranked again by the exact cosine, rounded to 9 decimals. Vectors with
equal components form one class; only classes are indexed, so that copies cost nothing, and the result is expanded to
the members, of which no more than the k + 1 smallest ids can be needed. A bucket that the sample shows to be larger than
SPLIT leaves, as bits can't cut it, is split into blocks, and each pair of blocks is ranked by a task of its own.

Defined results: null and all-zero vectors, vectors with null or non-finite components and vectors of another length
than the most common one take no part on either side; rows with a null id take no part; an id in several rows counts once;
ties go to the smaller id (among the KEEP best of a bucket); with fewer than k others, all of them are given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import materialize, spread

#: Bound of the sample on which rotations and cuts are learned. A leaf holds LEAST of its rows at least, so beyond about 10 ** 9 rows it should grow.
SAMPLE, LEAST = 20_000, 4
TABLES, PROBES, LEAF, GROWTH, MAX_BITS, SPLIT, SEED = 4, 2, 200, 0.3, 32, 3, 5
#: Most that two packed vectors' cosine differs from the given vectors', and how many of a bucket's best are looked at for ties.
ERROR, KEEP = 4e-4, 10
#: A found neighbour: its class, and its cosine from -1 to 1 in 65535 steps.
ENTRY = np.dtype([("n", "<i8"), ("s", "<u2")])


def pack(unit: np.ndarray) -> np.ndarray:
    """Rows of floats to 12 bits a component, scaled by the row's largest."""
    if unit.shape[1] % 2:
        unit = np.hstack([unit, np.zeros((len(unit), 1), unit.dtype)])
    top = np.abs(unit).max(axis=1, keepdims=True)
    q = (np.rint(unit / top * 2047) + 2048).astype(np.uint16)
    low, high = q[:, 0::2], q[:, 1::2]
    out = np.empty((len(unit), low.shape[1], 3), dtype=np.uint8)
    out[:, :, 0] = low & 255
    out[:, :, 1] = (low >> 8) | ((high & 15) << 4)
    out[:, :, 2] = high >> 4
    return out.reshape(len(unit), -1)


def unpack(codes: np.ndarray) -> np.ndarray:
    """The unit vectors of packed rows, as float32."""
    b = codes.reshape(len(codes), -1, 3).astype(np.int16)
    q = np.empty((len(codes), b.shape[1] * 2), dtype=np.float32)
    q[:, 0::2] = (b[:, :, 0] | ((b[:, :, 1] & 15) << 8)) - 2048
    q[:, 1::2] = ((b[:, :, 1] >> 4) | (b[:, :, 2] << 4)) - 2048
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return q


def rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Principal axes of the centred sample, turned so that the signs lose least."""
    dims = sample.shape[1]
    spread = np.cov(sample.T) if len(sample) > 1 else np.eye(dims)
    axes = np.linalg.eigh(spread + 1e-9 * np.eye(dims))[1][:, ::-1]
    projected = sample @ axes
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, dims)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (u @ vt).T
    return axes @ turn


class Index:
    """Learned projections, for each table the tree of its bits, and the numbers of the buckets."""

    def __init__(self, sample: np.ndarray, total: int, tables: int, leaf: float, probes: int, seed: int):
        dims = sample.shape[1]
        self.mean, self.probes = sample.mean(axis=0), probes
        centred = sample - self.mean
        limit = max(leaf * len(sample) / max(total, 1), LEAST)
        bits = int(min(MAX_BITS, max(1, np.ceil(np.log2(max(2.0, len(sample) / limit))) + 2)))
        parts, have = [], 0
        while have < tables * bits:
            parts.append(rotation(centred, seed + len(parts)))
            have += dims
        self.axes = np.hstack(parts)[:, : tables * bits].astype(np.float32)
        self.bits = bits
        at = self.project(sample)
        self.trees = [self.grow(at[:, t * bits : (t + 1) * bits], limit) for t in range(tables)]
        # Where each row probes every leaf of a table, further tables can't add anything.
        whole = [t for t in self.trees if (t[0][:, 0] < 0).sum() <= probes]
        self.trees = whole[:1] or self.trees
        self.first, self.blocks, number = [], [], 0
        for children, _, held in self.trees:
            blocks = np.where(children[:, 0] < 0, np.maximum(1, np.ceil(held * total / len(sample) / leaf / SPLIT)), 1).astype(np.int64)
            sizes = np.where(blocks > 1, blocks * (blocks - 1) // 2, 1)
            self.first.append(number + np.cumsum(sizes) - sizes)
            self.blocks.append(blocks)
            number += int(sizes.sum())

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean).astype(np.float32) @ self.axes

    def grow(self, at: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """children[node, bit] (-1 below a leaf), the cut of each node, and the sample rows that it holds."""
        children, cuts, held, open_nodes = [[-1, -1]], [0.0], [len(at)], [(0, 0, np.arange(len(at)))]
        while open_nodes:
            node, depth, rows = open_nodes.pop()
            if len(rows) <= limit or depth == self.bits:
                continue
            cuts[node] = float(np.median(at[rows, depth]))
            above = at[rows, depth] > cuts[node]
            for bit in (0, 1):
                own = rows[above == bool(bit)]
                children[node][bit] = len(children)
                children.append([-1, -1])
                cuts.append(0.0)
                held.append(len(own))
                open_nodes.append((children[node][bit], depth + 1, own))
        return np.array(children, dtype=np.int64), np.array(cuts, dtype=np.float32), np.array(held, dtype=np.int64)

    def probed(self, at: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """(vectors, probes): leaves in the order of the flipped bits' weights, the own one first; -1 where there are fewer."""
        children, cuts, _ = tree
        node, cost = np.zeros((len(at), 1), dtype=np.int64), np.zeros((len(at), 1), dtype=np.float32)
        for depth in range(self.bits):
            inner = children[node, 0] >= 0
            if not inner.any():
                break
            away = at[:, depth, None] - cuts[node]
            own = (away > 0).astype(np.int64)
            flipped = np.where(inner, cost + away * away, np.inf)
            node = np.hstack([np.where(inner, children[node, own], node), np.where(inner, children[node, 1 - own], -1)])
            cost = np.hstack([cost, flipped])
            if node.shape[1] > self.probes:
                best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
                node, cost = np.take_along_axis(node, best, axis=1), np.take_along_axis(cost, best, axis=1)
        return np.where(np.isfinite(cost), node, -1)

    def buckets(self, vectors: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the buckets in which each vector takes part, end to end, and where each vector's begin."""
        at = self.project(vectors)
        rows, out = [], []
        for t, tree in enumerate(self.trees):
            leaves = self.probed(at[:, t * self.bits : (t + 1) * self.bits], tree)
            row, place = np.nonzero(leaves >= 0)
            leaf = leaves[row, place]
            blocks = self.blocks[t][leaf]
            rows.append(row[blocks == 1])
            out.append(self.first[t][leaf[blocks == 1]])
            for number in np.unique(leaf[blocks > 1]):
                count, here = int(self.blocks[t][number]), row[leaf == number]
                own = np.mod(keys[here], count)
                for other in range(count):
                    met = own != other
                    a, b = np.minimum(own[met], other), np.maximum(own[met], other)
                    rows.append(here[met])
                    out.append(self.first[t][number] + b * (b - 1) // 2 + a)
        row, bucket = np.concatenate(rows), np.concatenate(out)
        order = np.argsort(row, kind="stable")
        return bucket[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(row, minlength=len(vectors)))].astype(np.int32)


def best_in_block(vectors: np.ndarray, keep: int, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each row the indices and cosines of the keep most similar other rows; -2 where there are fewer."""
    n = len(vectors)
    lanes, width = 32, -(-n // 32)
    padded = np.zeros((lanes * width, vectors.shape[1]), dtype=np.float32)
    padded[:n] = vectors
    places, values = np.empty((n, keep), dtype=np.int64), np.empty((n, keep), dtype=np.float32)
    step = max(1, chunk // len(padded))
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        s = vectors[rows] @ padded.T
        s[:, n:] = -2
        s[rows - at, rows] = -2
        # The best of a row lie in those lanes' columns whose maxima are the best.
        columns = s.reshape(len(rows), lanes, width)
        most = columns.max(axis=1)
        m = min(keep, width)
        picked = np.argpartition(-most, m - 1, axis=1)[:, :m] if m < width else np.broadcast_to(np.arange(width), (len(rows), width))
        among = (picked[:, None, :] + (np.arange(lanes) * width)[None, :, None]).reshape(len(rows), -1)
        found = np.take_along_axis(s, among, axis=1)
        if found.shape[1] < keep:
            more = keep - found.shape[1]
            found, among = np.pad(found, ((0, 0), (0, more)), constant_values=-2), np.pad(among, ((0, 0), (0, more)))
        top = np.argpartition(-found, keep - 1, axis=1)[:, :keep] if keep < found.shape[1] else np.broadcast_to(np.arange(keep), (len(rows), keep))
        places[rows], values[rows] = np.take_along_axis(among, top, axis=1), np.take_along_axis(found, top, axis=1)
    return np.where(values > -1.5, places, 0), values


def usable(records: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    vec = F.col(vector_column)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return records.where(
        F.col(id_column).isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)
    ).select(F.col(id_column).alias("id"), vec.alias("vec"))


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, scaled by the largest component, as doubles."""
    at = column.offsets
    flat = column.values.to_numpy(zero_copy_only=False)[at[0].as_py() : at[-1].as_py()]
    vectors = flat.reshape(len(column), dims).astype(np.float64)
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def nearest_neighbours(
    records: DataFrame,
    id_column: str,
    vector_column: str,
    k: int = 5,
    tables: int = TABLES,
    probes: int = PROBES,
    leaf: int = LEAF,
    sample_rows: int = SAMPLE,
    exact: bool = False,
) -> DataFrame:
    """(id, neighbour_id): for each row the k other rows of highest cosine similarity."""
    rows = usable(spread(records), id_column, vector_column)
    lengths = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    kind = records.schema[id_column].dataType.simpleString()
    if not lengths:
        return records.sparkSession.createDataFrame([], f"id {kind}, neighbour_id {kind}")
    dims, total = lengths[0]["length"], lengths[0]["count"]
    # The last bit of a class is free to say that several rows have its vector.
    rows = rows.where(F.size("vec") == dims).withColumn("cid", F.xxhash64("vec").bitwiseAND(-2))
    base = materialize(rows.select("id", "cid"), "ids")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.ascontiguousarray(pack(vectors_of(batch.column(1), dims)))
                yield pa.RecordBatch.from_arrays([batch.column(0), binaries(codes)], names=["cid", "code"])

    coded = rows.select("cid", "vec").mapInArrow(packed, "cid long, code binary")
    classes = coded.groupBy("cid").agg(F.first("code").alias("code"), F.count(F.lit(1)).alias("n")).select(
        F.col("cid").bitwiseOR((F.col("n") > 1).cast("long")).alias("cid"), "code"
    )

    every = max(1, total // sample_rows)
    sampled = rows.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0).select("cid", "vec").dropDuplicates(["cid"]).limit(sample_rows).toArrow()
    if not sampled.num_rows:
        sampled = rows.select("cid", "vec").limit(sample_rows).toArrow()
    sampled = sampled.sort_by("cid").combine_chunks()
    sample = vectors_of(sampled.column("vec").chunk(0), dims)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    rows_of_leaf = leaf * total**GROWTH
    index = Index(sample, total, tables, rows_of_leaf, probes, SEED)
    if exact:
        index = Index(sample[:1], total, 1, rows_of_leaf, 1, SEED)

    code_bytes = 3 * ((dims + 1) // 2)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets, at = index.buckets(unpack(codes_of(batch.column(1), code_bytes))[:, :dims], batch.column(0).to_numpy() >> 1)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(buckets))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["cid", "code", "buckets"])

    entries = classes.mapInArrow(placed, "cid long, code binary, buckets array<int>").select(F.explode("buckets").alias("bucket"), "cid", "code")
    keep = max(KEEP, k + 1)

    def ranked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cids = table.column("cid").to_numpy()
        places, values = best_in_block(unpack(codes_of(table.column("code").chunk(0), code_bytes)), keep)
        order = np.argsort(-values, axis=1, kind="stable")
        places, values = np.take_along_axis(places, order, axis=1), np.take_along_axis(values, order, axis=1)
        # Besides the k best all that could be among them.
        taken = (values > -1.5) & (values >= values[:, k - 1 : k] - 2 * ERROR)
        entry = np.empty(int(taken.sum()), dtype=ENTRY)
        entry["n"] = cids[places[taken]]
        entry["s"] = np.rint((np.clip(values[taken], -1, 1) + 1) * 32767) + 1
        at = np.r_[0, np.cumsum(taken.sum(axis=1))].astype(np.int32) * ENTRY.itemsize
        found = pa.Array.from_buffers(pa.binary(), len(cids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(entry)])
        return pa.table({"cid": cids, "found": found})

    found = entries.groupBy("bucket").applyInArrow(ranked, "cid long, found binary")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cid; the last cid of a batch may go on in the next one."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cids = batch.column(0).to_numpy()
            cut = int(np.searchsorted(cids, cids[-1]))
            if cut:
                yield best_of([*held, batch.slice(0, cut)], k)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield best_of(held, k)

    sorted_lists = found.repartition("cid").sortWithinPartitions("cid")
    neighbours = materialize(sorted_lists.mapInArrow(merged, "cid long, other long, sim float, open boolean"), "neighbours")
    return expand(base, settled(rows, neighbours), k)


def settled(rows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(cid, other, sim) with the exact cosine where the order was left open."""
    vectors = rows.select("cid", "vec").dropDuplicates(["cid"])
    cosine = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = (
        neighbours.where("open").select("cid", "other")
        .join(vectors, "cid")
        .join(vectors.select(F.col("cid").alias("other"), F.col("vec").alias("vec_other")), "other")
        .select("cid", "other", F.round(cosine("vec", "vec_other") / F.sqrt(cosine("vec", "vec") * cosine("vec_other", "vec_other")), 9).alias("sim"))
    )
    return neighbours.where("NOT open").select("cid", "other", F.col("sim").cast("double")).union(exact)


def expand(base: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """From classes to the ids in them."""
    ids = base.distinct()
    first = Window.partitionBy("cid").orderBy("id")
    small = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("cid", "id")
    others = neighbours.join(small.select(F.col("cid").alias("other"), F.col("id").alias("neighbour_id")), "other").select("cid", "sim", "neighbour_id")
    own = small.select("cid", F.lit(2.0).alias("sim"), F.col("id").alias("neighbour_id"))
    lists = (
        others.union(own)
        .groupBy("cid")
        .agg(F.collect_list(F.struct((-F.col("sim")).alias("far"), "neighbour_id")).alias("found"))  # at most k + 1 for each candidate
        .select("cid", F.transform(F.array_sort("found"), lambda x: x["neighbour_id"]).alias("found"))
    )
    return (
        ids.join(lists, "cid")
        .select("id", F.slice(F.array_remove(F.col("found"), F.col("id")), 1, k).alias("found"))
        .select("id", F.explode("found").alias("neighbour_id"))
    )


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row of bytes as one binary value."""
    width = rows.shape[1]
    offsets = np.arange(0, rows.size + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def codes_of(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def best_of(batches: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The k best distinct classes of each class, and those that could be among them."""
    cids = np.concatenate([b.column(0).to_numpy() for b in batches])
    size, flat = [], []
    for b in batches:
        column = b.column(1)
        at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        size.append(np.diff(at) // ENTRY.itemsize)
        flat.append(np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].tobytes() if at[-1] > at[0] else b"")
    entry = np.frombuffer(b"".join(flat), dtype=ENTRY)
    q, n, s = np.repeat(cids, np.concatenate(size)), entry["n"], (entry["s"].astype(np.float32) - 1) / 32767 - 1
    order = np.lexsort((-s, n, q))
    q, n, s = q[order], n[order], s[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])
    q, n, s = q[new], n[new], s[new]
    order = np.lexsort((n, -s, q))
    q, n, s = q[order], n[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(q)])
    last = np.repeat(s[np.minimum(starts + k, starts + sizes) - 1], sizes) if len(q) else s
    keep = s >= last - 2 * ERROR
    q, n, s, last = q[keep], n[keep], s[keep], last[keep]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(q)])
    more = np.repeat(sizes > k, sizes)
    # Copies move the k-th place, so that with them every close order is open.
    copies = np.repeat(np.add.reduceat((q | n) & 1, starts) > 0, sizes) if len(q) else more
    close = np.r_[(q[1:] == q[:-1]) & (s[:-1] - s[1:] <= 2 * ERROR), False] if len(q) else more
    is_open = np.where(copies, close | np.r_[False, close[:-1]][: len(close)], more & (np.abs(s - last) <= 2 * ERROR))
    columns = [pa.array(q & -2), pa.array(n & -2), pa.array(s), pa.array(is_open.astype(bool))]
    return pa.RecordBatch.from_arrays(columns, names=["cid", "other", "sim", "open"])
