"""Problem 8: evaluation texts leaking into training text.

Method: winnowing. The hashes of all k-grams of words are taken, and of each window of w
consecutive k-grams the smallest hash is kept with its place. Two texts that share a run of
k + w - 1 words share a whole window and so keep the same fingerprint in it: with the default
k = 5 and w = 4 every shared run of 8 words is met. Fingerprints of corpus and test items are joined, and
each hit is extended in both directions on the word hashes until the words differ; runs
of at least min_run words are reported.

Where the test items hold at most MAX_WORDS words (counted first), their fingerprints and words go to all tasks: each batch of the
corpus is winnowed, looked up and extended in place, so that the corpus is read once and only found cases are shuffled. Beyond that bound the fingerprints
are joined; the documents with a hit are then taken out by a semi join before any of their words are hashed again. Nothing of the corpus
reaches the driver.

Defined results: null, empty and blank texts have no words; texts of fewer than min_run words have no
cases; rows with null ids take no part; repeated rows and texts under several ids are reported for each id once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.minhash import list_parts, mix
from memlake.session import materialize, spread

WORD = r"[\p{L}\p{N}]+"
#: Words of all test items together up to which they are sent to all tasks (8 bytes each).
MAX_WORDS = 4_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.xxhash64(F.lower(w)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram starting at each word of the flat array."""
    out = np.full(max(len(words) - k + 1, 0), k, dtype=np.uint64)
    for j in range(k):
        out = mix(out ^ words[j : len(words) - k + 1 + j].view(np.uint64))
    return out


def winnowed(words: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the flat array, print) of the winnowed fingerprints of texts laid end to end."""
    span = k + window - 1
    if len(words) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = gram_hashes(words, k)
    windows = np.lib.stride_tricks.sliding_window_view(grams, window)
    # Windows that lie within one text.
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(owner[: len(windows)] == owner[span - 1 : span - 1 + len(windows)])
    places = np.unique(inside + windows[inside].argmin(axis=1))
    return owner[places], places, grams[places]


def fingerprints(texts: DataFrame, k: int, window: int) -> DataFrame:
    """(key, words) to (key, place, print): the winnowed fingerprints of each text."""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = list_parts(batch.column(1))
            rows, places, prints = winnowed(words, offsets, k, window)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array((places - offsets[rows]).astype(np.int32)), pa.array(prints.view(np.int64))],
                names=["key", "place", "print"],
            )

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "words").mapInArrow(winnow, f"key {kind}, place int, print long")


class Items:
    """Words and fingerprints of the test items, looked up by whole batches of documents."""

    def __init__(self, ids: pa.Array, words: np.ndarray, offsets: np.ndarray, min_run: int, k: int):
        self.ids, self.words, self.offsets, self.min_run, self.k = ids, words, offsets, min_run, k
        rows, places, prints = winnowed(words, offsets, k, min_run - k + 1)
        order = np.argsort(prints, kind="stable")
        self.rows, self.places, self.prints = rows[order], places[order], prints[order]

    def leaks(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) of the texts laid end to end that share a run of min_run words with an item."""
        rows, places, prints = winnowed(words, offsets, self.k, self.min_run - self.k + 1)
        lo, hi = np.searchsorted(self.prints, prints, side="left"), np.searchsorted(self.prints, prints, side="right")
        size = hi - lo
        hit = np.repeat(np.arange(len(prints)), size)
        found = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text, at, item, item_at = rows[hit], places[hit], self.rows[found], self.places[found]
        length = np.zeros(len(hit), dtype=np.int64)
        # Whether a run is long enough shows within min_run words on either side.
        for step in (1, -1):
            alive = np.arange(len(hit))
            for far in range(self.min_run):
                x, y = at[alive] + (far if step == 1 else -far - 1), item_at[alive] + (far if step == 1 else -far - 1)
                t, i = text[alive], item[alive]
                within = (x >= offsets[t]) & (x < offsets[t + 1]) & (y >= self.offsets[i]) & (y < self.offsets[i + 1])
                alive, x, y = alive[within], x[within], y[within]
                alive = alive[words[x] == self.words[y]]
                length[alive] += 1
        met = np.unique(np.stack([text, item], axis=1)[length >= self.min_run], axis=0)
        return met[:, 0], met[:, 1]


def looked_up(docs: DataFrame, items: Items, names: str) -> DataFrame:
    """Cases of the documents (key, words), found batch by batch."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, item = items.leaks(*list_parts(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), items.ids.take(pa.array(item))], names=["doc", "item"])

    return docs.select("key", "words").mapInArrow(look, names)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    doc_text: str = "text",
    item_text: str = "text",
    min_run: int = 8,
    k: int = 5,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """(doc_id, item_id) for texts that share a run of at least min_run consecutive words."""
    window = min_run - k + 1
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    docs = spread(documents).where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("key"), F.col(doc_text).alias("text"))
    tests = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("key"), word_hashes(F.col(item_text)).alias("words"))
    long_docs = docs.select("key", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= min_run)
    long_tests = tests.where(F.size("words") >= min_run)
    if (long_tests.agg(F.sum(F.size("words"))).first()[0] or 0) <= max_words:
        held = long_tests.toArrow().combine_chunks()
        if not held.num_rows:
            return documents.sparkSession.createDataFrame([], f"`{doc_id}` {doc_type}, `{item_id}` {item_type}")
        known = Items(held.column("key").chunk(0), *list_parts(held.column("words").chunk(0)), min_run, k)
        return looked_up(long_docs, known, f"doc {doc_type}, item {item_type}").distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
    corpus = fingerprints(long_docs, k, window).withColumnRenamed("key", "doc")
    held_out = fingerprints(long_tests, k, window).select(F.col("key").alias("item"), F.col("place").alias("item_place"), "print")
    hits = materialize(
        corpus.join(held_out, "print")
        .groupBy("doc", "item")
        .agg(F.collect_set(F.struct("place", "item_place")).alias("hits")),  # bounded by the two texts' lengths
        "hits",
    )
    met = docs.join(hits.select(F.col("doc").alias("key")).distinct(), "key", "left_semi").select("key", word_hashes(F.col("text")).alias("words"))
    pairs = hits.join(met.select(F.col("key").alias("doc"), F.col("words").alias("doc_words")), "doc").join(
        long_tests.select(F.col("key").alias("item"), F.col("words").alias("item_words")), "item"
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            doc_words, doc_at = list_parts(batch.column(2))
            item_words, item_at = list_parts(batch.column(3))
            for row, found in enumerate(batch.column(4).to_pylist()):
                a, b = doc_words[doc_at[row] : doc_at[row + 1]], item_words[item_at[row] : item_at[row + 1]]
                keep[row] = any(longest_run(a, b, h["place"], h["item_place"]) >= min_run for h in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=[doc_id, item_id]).filter(pa.array(keep))

    return (
        pairs.select("doc", "item", "doc_words", "item_words", "hits")
        .mapInArrow(extend, f"`{doc_id}` {doc_type}, `{item_id}` {item_type}")
        .distinct()
    )


def longest_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the run of equal words through a[i] and b[j]; 0 if they differ."""
    back = min(i, j)
    same = a[i - back : i - back + len(b)][: len(b) - (j - back)] == b[j - back :][: len(a) - (i - back)]
    if not same[back]:
        return 0
    before = np.flatnonzero(~same[:back])
    after = np.flatnonzero(~same[back:])
    return int((back + after[0]) if len(after) else len(same)) - int(before[-1] + 1 if len(before) else 0)
