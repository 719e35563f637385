"""Problem 2: near-duplicate records with small edits.

Method: MinHash LSH forest. In each tree a record has a sequence of minwise labels, and the sequences form a sorted prefix
trie: records that share a prefix lie side by side. A record is looked up by its longest prefix, which is shortened as long as
the shorter one isn't crowded, so it is long in dense regions and short in sparse ones; both records of a pair that share it have it at the
same length. Two records at the threshold s share d labels with probability s ** d. A record goes on to further trees until
(1 - s ** d) ** trees is below 1 - target for the greatest length d that it had to take so far. (Each tree's own length would promise too
much: short prefixes often begin with just those rare words that near-duplicates do not share.)

Which prefixes are crowded is learned on a bounded sample; it steers the cost, not the recall. Rows are spread by prefix, sorted
within the parts, and all that share a prefix are held against two exact bounds (sizes, and differing bits of a bitmap) before they leave as
candidates, which are verified exactly on the whole word sets. A prefix that the sample shows to hold more than SPLIT records
is split into blocks, and every pair of blocks is a row group of its own.

Defined results: null content has no words; contents with fewer than min_words distinct
words take no part; rows with a null id take no part; an id that stands in several rows counts with each
of its contents; an empty table gives no pairs. Contents with equal word sets form one class, so that copies cost nothing in the
forest; groups are not closed up. `near_duplicate_classes` gives pairs of classes and membership, `near_duplicates` all pairs of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.minhash import bitmaps, classed, expand_pairs, hash_parameters, list_parts, mix, verified
from memlake.session import spread

#: Bound of the sample that shows which prefixes are crowded: those that CROWD of its records share.
SAMPLE, CROWD = 20_000, 4
MAX_DEPTH, TARGET_RECALL, SEED, SPLIT = 4, 0.9995, 23, 4000
#: Texts made from one template share many words; longer bitmaps tell them apart before they leave as candidates.
BITMAP_WORDS = 2

COMMENT = r"(?s)<!--.*?-->"
SEE_ALSO = r"(?is)\[see also:.*?\]"
WORD = r"[\p{L}\p{N}]+"


def word_set(content: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased, after comments and reference marks are removed."""
    plain = F.regexp_replace(F.regexp_replace(content, COMMENT, ""), SEE_ALSO, "")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(WORD), 0), F.lower))


class Forest:
    """The trees' hash functions and the crowded prefixes of the sample."""

    def __init__(self, threshold: float, max_depth: int, target: float, seed: int):
        self.threshold, self.depth, self.allowance = threshold, max_depth, np.log(1 - target)
        self.trees = int(np.ceil(self.allowance / np.log1p(-(threshold**max_depth))))
        self.a, self.b = hash_parameters(self.trees * max_depth, seed)
        self.crowded = np.zeros(0, dtype=np.uint64)
        self.split, self.blocks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def prefixes(self, tree: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, depth) keys of the prefixes of each length."""
        keys = np.empty((len(starts), self.depth), dtype=np.uint64)
        key = np.full(len(starts), tree + 1, dtype=np.uint64)
        for d in range(self.depth):
            j = tree * self.depth + d
            key = mix(key ^ np.minimum.reduceat(flat * self.a[j] + self.b[j], starts))
            keys[:, d] = key
        return keys

    def learn(self, flat: np.ndarray, starts: np.ndarray, total: int, crowd: int, split: int) -> None:
        """Crowded prefixes, and those that stay too large at the greatest length, from a sample of all sets."""
        found, large, blocks = [], [], []
        for tree in range(self.trees):
            keys = self.prefixes(tree, flat, starts)
            for d in range(self.depth):
                values, counts = np.unique(keys[:, d], return_counts=True)
                if d < self.depth - 1:
                    found.append(values[counts >= crowd])
                parts = np.ceil(counts * (total / len(starts)) / split).astype(np.int64)
                large.append(values[parts > 1])
                blocks.append(parts[parts > 1])
        self.crowded = np.unique(np.concatenate(found))
        at = np.concatenate(large)
        order = np.argsort(at)
        self.split, self.blocks = at[order], np.concatenate(blocks)[order]

    def lookups(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, key, length) of the prefix with which each set is looked up, in as many trees as it needs."""
        starts = offsets[:-1]
        rows, keys, depths = [], [], []
        active, longest = np.arange(len(starts)), np.ones(len(starts), dtype=np.int64)
        for tree in range(self.trees):
            if not len(active):
                break
            if tree and len(active) < len(starts):
                size = np.diff(offsets)[active]
                begin = np.cumsum(size) - size
                own = flat[np.repeat(offsets[active] - begin, size) + np.arange(size.sum())]
                prefix = self.prefixes(tree, own, begin)
            else:
                prefix = self.prefixes(tree, flat, starts)
            dense = member(prefix[:, : self.depth - 1], self.crowded)
            # Shortened from the greatest length while the shorter prefix isn't crowded.
            length = self.depth - np.cumprod(~dense[:, ::-1], axis=1).sum(axis=1)
            rows.append(active)
            keys.append(prefix[np.arange(len(active)), length - 1])
            depths.append(length)
            longest[active] = np.maximum(longest[active], length)
            active = active[(tree + 1) * np.log1p(-(self.threshold ** longest[active])) > self.allowance]
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(depths)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(values.shape, dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def neighbours_in_runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run of equal keys, in parts of bounded size."""
    n = len(key)
    end = np.searchsorted(key, key, side="right")
    at, step = np.flatnonzero(end - np.arange(n) > 1), 1
    left, right, held = [], [], 0
    while len(at):
        left.append(at)
        right.append(at + step)
        held += len(at)
        if held > 1_000_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
        step += 1
        at = at[at + step < end[at]]
    if left:
        yield np.concatenate(left), np.concatenate(right)


def forest_candidates(classes: DataFrame, forest: Forest, p: int, q: int, words: int) -> DataFrame:
    """(cid_a, cid_b), cid_a < cid_b, of the classes (cid, values) that share a looked-up prefix and pass the bounds."""
    maps = [f"b{w}" for w in range(words)]

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                values, offsets = list_parts(part.column(1))
                row, key, _ = forest.lookups(values.view(np.uint64), offsets)
                cids = part.column(0).to_numpy()
                large = member(key, forest.split)
                out_row, out_key = [row[~large]], [key[~large]]
                for r, k in zip(row[large], key[large]):
                    count = int(forest.blocks[np.searchsorted(forest.split, k)])
                    own, other = int(cids[r]) % count, np.arange(count)
                    other = other[other != own]
                    a, b = np.minimum(own, other), np.maximum(own, other)
                    out_row.append(np.full(len(other), r))
                    out_key.append(mix(k ^ mix((b * (b - 1) // 2 + a + 1).astype(np.uint64))))
                row, key = np.concatenate(out_row), np.concatenate(out_key)
                sizes = np.diff(offsets).astype(np.int32)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(cids[row]), pa.array(sizes), *[pa.array(m[row]) for m in bitmaps(values, offsets, words)]],
                    names=["key", "cid", "n", *maps],
                )

    schema = "key long, cid long, n int" + "".join(f", {m} long" for m in maps)
    rows = classes.select("cid", "values").mapInArrow(planted, schema).repartition("key").sortWithinPartitions("key")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from joined([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from joined(held)

    def joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cid, n, *bits = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in range(3 + words))
        n = n.astype(np.int64)
        for i, j in neighbours_in_runs(key):
            fits = np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p
            i, j = i[fits], j[fits]
            differing = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in (x.view(np.uint64) for x in bits))
            fits = (differing * (q + p) <= (n[i] + n[j]) * (q - p)) & (cid[i] != cid[j])
            a, b = cid[i[fits]], cid[j[fits]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["cid_a", "cid_b"])

    return rows.mapInArrow(met, "cid_a long, cid_b long").distinct()


def near_duplicate_classes(
    records: DataFrame,
    id_column: str,
    content_column: str,
    min_words: int = 8,
    numerator: int = 7,
    denominator: int = 10,
    max_depth: int = MAX_DEPTH,
    target_recall: float = TARGET_RECALL,
    sample_rows: int = SAMPLE,
    crowd: int = CROWD,
    split: int = SPLIT,
) -> tuple[DataFrame, DataFrame]:
    """Pairs (cid_a, cid_b) of different word sets with a Jaccard similarity of at least numerator/denominator, and the members (cid, id) of each."""
    hashed = F.transform(word_set(F.col(content_column)), lambda w: F.xxhash64(w))
    classes, members = classed(spread(records), F.col(id_column), hashed, min_words, "words")
    forest = Forest(numerator / denominator, max_depth, target_recall, SEED)
    total = classes.count()
    every = max(1, total // sample_rows)
    sample = classes.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0).select("values").limit(sample_rows).toArrow()
    if sample.num_rows:
        flat, offsets = list_parts(sample.column(0).combine_chunks())
        forest.learn(flat.view(np.uint64), offsets[:-1], total, crowd, split)
    candidates = forest_candidates(classes, forest, numerator, denominator, BITMAP_WORDS)
    return verified(candidates, classes, numerator, denominator), members


def near_duplicates(records: DataFrame, id_column: str, content_column: str, **settings: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b, for the records of near_duplicate_classes()."""
    return expand_pairs(*near_duplicate_classes(records, id_column, content_column, **settings))
