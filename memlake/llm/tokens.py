"""Problem 7: encoding of the whole corpus with a public tokenizer.

Method: monoid tree reduction. A text is halved recursively down to leaves, each leaf is
encoded, and neighbours are joined up the tree. Byte-pair merges never cross the borders of
the pieces which the tokenizer's pattern cuts a text into, and a match of that pattern depends
only on the text from its start to one character beyond its end. So when two encoded
neighbours are joined,

- a piece of the left side that ends two characters or more before the border stays as it is;
- from the first unstable piece on, the pieces are cut anew over a window that grows into the
  right side, until one of the new borders is also a border of the right side's own pieces:
  from there on, both cuttings are the same;
- only the tokens of that window are encoded anew.

The ids are those of the tokenizer run over the whole text. A node of the tree
keeps the borders of its pieces (characters) and the number of tokens at each, so joining never looks
at text outside the window. Decoding concatenates the tokens' bytes up the tree.

Defined results: null and empty texts give an empty list, blank texts are encoded like any other,
strings of special tokens are ordinary text, lone surrogates cannot occur (UTF-8 columns). Every row gives
one row; rows that repeat an id are all given.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Leaves have at most this many characters.
LEAF = 512
WINDOW = 64
#: The published pattern of this tokenizer's pieces (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tiktoken encoding of a file of ranks, and the compiled pattern; made once in each Python worker."""
    import regex
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(PATTERN)


class Encoded:
    """An encoded span of a text: ids, and where each piece starts, in characters and in tokens."""

    __slots__ = ("ids", "starts", "tokens")

    def __init__(self, ids: list[int], starts: np.ndarray, tokens: np.ndarray):
        self.ids, self.starts, self.tokens = ids, starts, tokens


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.encoding, self.pattern = tokenizer(path)
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.pieces: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            if len(self.pieces) >= 100_000:
                self.pieces.clear()
            ids = self.encoding._encode_single_piece(text)
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return self.span(text, 0, len(text)).ids if text else []

    def span(self, text: str, start: int, end: int) -> Encoded:
        if end - start <= self.leaf:
            return self.cut(text[start:end], start)
        middle = (start + end) // 2
        return self.join(text, self.span(text, start, middle), self.span(text, middle, end), middle, end)

    def cut(self, part: str, start: int) -> Encoded:
        ids, starts, tokens = [], [], []
        at = 0
        for piece in self.pattern.findall(part):
            starts.append(start + at)
            tokens.append(len(ids))
            at += len(piece)
            ids += self.piece(piece)
        return Encoded(ids, np.array(starts, dtype=np.int64), np.array(tokens, dtype=np.int64))

    def join(self, text: str, left: Encoded, right: Encoded, middle: int, end: int) -> Encoded:
        # Pieces of the left side are stable while they end two characters before the border: their match,
        # with one character of lookahead, lies within the left side. The piece before the last such end is the window's start.
        ends = np.append(left.starts[1:], middle)
        stable = int(np.searchsorted(ends, middle - 2, side="right"))
        start = int(left.starts[stable]) if stable < len(left.starts) else middle
        width = self.window
        while True:
            stop = min(end, middle + width)
            part, at, pieces, meets = text[start:stop], start, [], -1
            for piece in self.pattern.findall(part):
                if at >= middle:
                    k = int(np.searchsorted(right.starts, at))
                    if k < len(right.starts) and right.starts[k] == at:
                        meets = k
                        break
                if stop < end and at + len(piece) > stop - 2:
                    break
                pieces.append(piece)
                at += len(piece)
            if meets >= 0 or (stop == end and at == end):
                break
            width *= 2
        kept = int(left.tokens[stable]) if stable < len(left.tokens) else len(left.ids)
        ids, starts, tokens, at = left.ids[:kept], [], [], start
        for piece in pieces:
            starts.append(at)
            tokens.append(len(ids))
            ids += self.piece(piece)
            at += len(piece)
        first = right.tokens[meets] if meets >= 0 else 0
        rest_starts = right.starts[meets:] if meets >= 0 else right.starts[:0]
        rest_tokens = right.tokens[meets:] - first + len(ids) if meets >= 0 else right.tokens[:0]
        if meets >= 0:
            ids += right.ids[int(first) :]
        return Encoded(
            ids,
            np.concatenate([left.starts[:stable], np.array(starts, dtype=np.int64), rest_starts]),
            np.concatenate([left.tokens[:stable], np.array(tokens, dtype=np.int64), rest_tokens]),
        )

    def decode(self, ids: list[int]) -> str:
        def joined(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return self.encoding.decode_bytes(ids[lo:hi])
            middle = (lo + hi) // 2
            return joined(lo, middle) + joined(middle, hi)

        return joined(0, len(ids)).decode("utf-8")


def encode_corpus(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizers: str = TOKENIZERS,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    leaf: int = LEAF,
) -> DataFrame:
    """(id_column, ids array<int>) for every row."""
    path = f"{tokenizers}/{vocabulary}"
    id_type = documents.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(path, leaf)
        for batch in batches:
            offsets, flat = np.zeros(batch.num_rows + 1, dtype=np.int32), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                flat.append(np.array(tree.encode(text) if text else [], dtype=np.int32))
                offsets[i + 1] = offsets[i] + len(flat[-1])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    return spread(documents).select(F.col(id_column), F.col(text_column)).mapInArrow(encode, f"`{id_column}` {id_type}, ids array<int>")
