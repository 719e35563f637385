"""Problem 3: personal information inside free text.

Method: a linear-chain conditional random field over word-shape features. It is trained on the small labelled
table of pii_table (a documented, fixed table; gradient steps on the log likelihood) and decoded by
Viterbi in numpy batches. Features of a token are its word (if the labelled table knows it), its shape, and the lists it stands in
(given names, kinds of streets, labels of numbers, ordinary words and words that always have a capital, ...), each in a window of three tokens to both sides; conjunctions of
neighbouring shapes; whether it touches its neighbours; and the shape of the run of digits, or of the run of
characters around an at sign, that it lies in.

Decoding is exact and cheap: transitions are bounded, so a token at which "other" leads every label by more than
the transitions can make up for is "other" in the best path. Viterbi runs only over the stretches between such tokens, all stretches of
a batch of texts at once.

Defined results: null and empty contents have no cases; spans are the text exactly as it stands, so that replacing
them by [EMAIL], [PHONE], [IDENTITY_NUMBER], [ADDRESS] or [NAME] leaves everything else unchanged; whole texts are read
however long they are; rows with a null id take no part; repeated rows and repeated spans count once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.names import GIVEN, SHORT, fold
from memlake.llm.pii_table import LABELS as ID_LABELS
from memlake.llm.pii_table import STREETS, labelled_table, lexicon
from memlake.session import spread

KINDS_OF = ("email", "phone", "identity_number", "address", "name")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS_OF for p in "BI")]
Y = len(LABELS)
WINDOW = 3

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
RUN = re.compile(
    r"(?:\+\s?)?(?:\(\+?\d{1,5}\)[ ./‑–-]?)?\d+(?:(?:[  ./‑–-]|\s?\(\d{1,4}\)\s?)\d+)*(?:,?\s?(?:ext\.?|x|extension|Durchwahl|poste)\s?\d+)?", re.I
)
EMAIL = re.compile(
    r"[\w.+%-]+(?:@|\s?[\[(]\s?at\s?[\])]\s?)[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\w-]+)+|[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", re.I
)
ANCHOR = re.compile(r"@|[\[(]\s?at\s?[\])]| at [\w-]+ dot ", re.I)
#: What follows an anchor as far as it can be a host, however long.
HOST = re.compile(r"\s?[\w-]*(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?| dot )[\w-]+)*", re.I)
STREET_WORDS = {s.lower().strip(".") for s in STREETS} | {"square", "row", "crescent", "parkway", "highway", "quay"}
STREET_FIRST = {"rue", "calle", "avenida", "plaza", "paseo", "camino", "place", "allée", "chemin"}
STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|platz|allee|ufer|damm)$")
TLD = {"test", "invalid", "example", "com", "org", "net", "de", "fr", "es", "io", "co", "edu", "eu", "uk"}
#: Words of the labels of identity numbers.
LABEL_WORDS = {w.lower() for x in ID_LABELS for w in re.findall(r"[^\W\d_]+", x)} | {"no", "nr"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "herr", "frau", "mme", "sr", "sra"}
PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "del", "la", "du", "des"}
GIVENS = GIVEN | {s for _, xs in SHORT for s in xs.split()}
PUNCT = {c: i for i, c in enumerate(".,:@()[]-/+'<>;_’\"‑–#?!&")}

SHAPES, CLASSES, CONJ, HIDDEN = 48, 80, 1 << 14, 0.3


def shape_of(token: str, lower: frozenset[str], capital: frozenset[str]) -> tuple[int, int]:
    """Shape, and the shape refined by the lists that the token stands in; lower and capital are the words of a vocabulary by case."""
    first = token[0]
    if first.isdigit():
        s = min(len(token), 9)
        return s, s
    if not first.isalpha():
        s = 10 + PUNCT.get(first, len(PUNCT))
        return s, s
    low = token.lower()
    if len(token) == 1:
        s = 36 if token.isupper() else 37
    elif token.isupper():
        s = 38
    elif token.islower():
        s = 39
    elif token[0].isupper() and token[1:].islower():
        s = 40
    else:
        s = 41
    folded = low if token.isascii() else fold(token)
    if len(token) > 1:
        if folded in GIVENS and not token.islower():
            return s, 48 + (s == 38)
        if low in STREET_WORDS:
            return s, 50 + (s == 39)
        if STREET_END.search(low) and len(low) > 5:
            return s, 52
        if low in TITLES:
            return s, 54
    if low in LABEL_WORDS:
        return s, 66
    if low in STREET_FIRST:
        return s, 55
    if low in PARTICLES:
        return s, 56
    if low in TLD:
        return s, 57
    if low in ("at", "dot"):
        return s, 58 + (low == "dot")
    if len(token) > 1 and s in (38, 40):
        # A capital on an ordinary word, on a word that is always written with one, or on neither.
        return s, (60 if low in lower else 61 if low.capitalize() in capital else 62) + 3 * (s == 38)
    return s, s


def run_shape(text: str) -> tuple[str, int]:
    """Signature of a run of digits (lengths of its groups and what separates them), and a coarse class of it."""
    sig = re.sub(r"\d+", lambda m: chr(64 + min(len(m.group()), 25)), text)
    digits = sum(c.isdigit() for c in text)
    groups = min(len(re.findall(r"\d+", text)), 6)
    lead = 2 if text[0] == "+" else 1 if text[0] == "0" else 0
    return sig, ((min(digits, 15) * 7 + groups) * 3 + lead) * 2 + ("(" in text)


def email_class(text: str) -> int:
    last = re.findall(r"[\w-]+", text)[-1].lower()
    written = 2 if " at " in text.lower() and "(" not in text and "[" not in text else 1 if "@" not in text else 0
    return 1 + written * 2 + (last in TLD)


def around(text: str, start: int, end: int, least: int) -> tuple[int, int]:
    """The run about an anchor that can belong to an address: its own word to the left, and to the right while words go on by dots or the word "dot"."""
    lo = start
    while lo > least and text[lo - 1].isspace() and start - lo < 2:
        lo -= 1
    while lo > least and (text[lo - 1].isalnum() or text[lo - 1] in "_.+%-"):
        lo -= 1
    return lo, HOST.match(text, end).end()


class Tokens:
    """Tokens of a batch of texts, laid end to end with WINDOW empty tokens around each text."""

    def __init__(self, texts: list[str], model: Model):
        # One pass over all texts; no pattern reaches over the two line ends between them.
        whole = "\n\n".join(texts)
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
        self.base = np.r_[0, np.cumsum(length)]
        spans = [m.span() for m in TOKEN.finditer(whole)]
        types, type_of = model.types, model.type_of
        kinds = [types.get(x) or type_of(x) for x in TOKEN.findall(whole)]
        place = np.array(spans, dtype=np.int64).reshape(-1, 2)
        text = np.searchsorted(self.base, place[:, 0], side="right") - 1
        # WINDOW empty tokens before each text and after the last one.
        at = np.arange(len(kinds)) + (text + 1) * WINDOW
        size = len(kinds) + (len(texts) + 1) * WINDOW
        self.kind, self.owner = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.start, self.end = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.kind[at], self.owner[at], self.start[at], self.end[at] = kinds, text, place[:, 0], place[:, 1]
        runs = [(*m.span(), *model.run_of(m.group())) for m in RUN.finditer(whole)]
        marks, done = [], 0
        for anchor in ANCHOR.finditer(whole):
            if anchor.start() < done:
                continue
            lo, hi = around(whole, anchor.start(), anchor.end(), done)
            for m in EMAIL.finditer(whole, lo, hi):
                if m.start() <= anchor.start() < m.end():
                    done = m.end()
                    marks.append((m.start(), done, email_class(m.group())))
                    break
        n = len(self.kind)
        self.run, self.rough, self.place, self.mark = (np.zeros(n, dtype=np.int64) for _ in range(4))
        real = np.flatnonzero(self.owner >= 0)
        where = self.start[real]
        for spans, is_run in ((runs, True), (marks, False)):
            if not spans:
                continue
            table = np.array(spans, dtype=np.int64)
            lo, hi = np.searchsorted(where, table[:, 0]), np.searchsorted(where, table[:, 1])
            size = hi - lo
            rows = np.repeat(np.arange(len(table)), size)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            tokens = real[lo[rows] + inside]
            place = np.where(inside == 0, 1, np.where(inside == size[rows] - 1, 3, 2))
            if is_run:
                self.run[tokens], self.rough[tokens], self.place[tokens] = table[rows, 2], table[rows, 3] + 1, place
            else:
                self.mark[tokens] = table[rows, 2] * 4 + place
        touch = (self.start[1:] == self.end[:-1]) & (self.owner[1:] >= 0) & (self.owner[:-1] >= 0)
        self.touch = np.r_[False, touch] * 2 + np.r_[touch, False]


ROUGH = 16 * 7 * 3 * 2 + 1


class Model:
    def __init__(self, words: list[str], signatures: list[str]):
        self.words = {w: i + 2 for i, w in enumerate(words)}
        self.signatures = {s: i + 1 for i, s in enumerate(signatures)}
        self.lower, self.capital = lexicon()
        self.reset()
        w, r = len(words) + 2, len(signatures) + 1
        sizes = [w, SHAPES, CLASSES] * (2 * WINDOW + 1) + [r, ROUGH, 4, 32] * 3 + [4 * CLASSES] * 3 + [CONJ] * 6
        self.block = np.r_[0, np.cumsum(sizes)]
        self.weights = np.zeros((int(self.block[-1]), Y), dtype=np.float32)
        self.transition = np.zeros((Y, Y), dtype=np.float32)

    def reset(self) -> None:
        self.types: dict[str, int] = {}
        self.type_rows: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.runs: dict[str, tuple[int, int]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("types", "type_rows", "runs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def type_of(self, token: str) -> int:
        shape, refined = shape_of(token, self.lower, self.capital)
        row = (self.words.get(token.lower(), 1), shape, refined)
        if len(self.types) > 200_000:
            self.types = {}
        known = self.runs.get(row)  # rows of words that the table doesn't know are few
        if known is None:
            known = self.runs[row] = len(self.type_rows)
            self.type_rows.append(row)
        self.types[token] = known
        return known

    def run_of(self, text: str) -> tuple[int, int]:
        signature, rough = run_shape(text)
        return self.signatures.get(signature, 0), rough

    def columns(self, t: Tokens, unknown: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Index columns into the weights, in the order of the blocks; the first ones are those of the windows. Words of unknown tokens are hidden."""
        rows = np.array(self.type_rows)[t.kind]
        if unknown is not None:
            rows[unknown & (t.owner >= 0), 0] = 1
        block = iter(self.block)
        for offset in range(-WINDOW, WINDOW + 1):
            moved = shifted(rows, offset)
            for j in range(3):
                yield next(block) + moved[:, j]
        yield from self.local(t, rows, block)

    def local(self, t: Tokens, rows: np.ndarray, block: Iterator[int]) -> Iterator[np.ndarray]:
        for offset in (-1, 0, 1):
            for column in (t.run, t.rough, t.place, t.mark):
                yield next(block) + shifted(column, offset)
        word, refined = rows[:, 0], rows[:, 2]
        for offset in (-1, 0, 1):
            yield next(block) + shifted(t.touch * CLASSES + refined, offset)
        a, b, c, d, e = (shifted(refined, o) for o in (-2, -1, 0, 1, 2))
        for parts in ((b, c), (c, d), (b, c, d), (c, d, e), (a, b, c), (shifted(word, -1), c, t.rough)):
            code = np.zeros(len(c), dtype=np.int64)
            for p in parts:
                code = code * 1_000_003 + p
            yield next(block) + (code * 2_654_435_761 >> 13) % CONJ

    def emissions(self, t: Tokens) -> np.ndarray:
        types = np.array(self.type_rows)
        out = np.zeros((len(t.kind), Y), dtype=np.float32)
        block = iter(self.block)
        for offset in range(-WINDOW, WINDOW + 1):
            by_type = sum(self.weights[next(block) + types[:, j]] for j in range(3))
            out += by_type[shifted(t.kind, offset)]
        for column in self.local(t, types[t.kind], block):
            out += self.weights[column]
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        """Labels of the most probable sequence of each text."""
        score = self.emissions(t)
        tr = self.transition
        # What the transitions around a label can gain at most over those around "other".
        gain = np.array([max(tr[a, b] - tr[a, 0] for a in range(Y)) + max(tr[b, c] - tr[0, c] for c in range(Y)) for b in range(Y)])
        unsure = (score[:, 1:] + gain[1:] >= score[:, :1]).any(axis=1) & (t.owner >= 0)
        labels = np.zeros(len(score), dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.r_[False, unsure, False].astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            most = at + 1
            longest = max(4, int(sizes[order[at]] * 1.3))
            most = at + max(1, min(int(np.searchsorted(sizes[order[at:]], longest, side="right")), 4096))
            batch = order[at:most]
            labels_of = viterbi(score, starts[batch], sizes[batch], tr)
            for k, b in enumerate(batch):
                labels[starts[b] : ends[b]] = labels_of[k, : sizes[b]]
            at = most
        return labels


def shifted(column: np.ndarray, offset: int) -> np.ndarray:
    """column[i + offset] at i; beyond the ends, the empty token's row."""
    if not offset:
        return column
    out = np.zeros_like(column)
    if offset > 0:
        out[:-offset] = column[offset:]
    else:
        out[-offset:] = column[:offset]
    return out


def viterbi(score: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best labels of stretches that lie between tokens labelled "other"."""
    n, longest = len(starts), int(sizes.max())
    back = np.zeros((n, longest, Y), dtype=np.int8)
    best = score[starts] + tr[0]
    final = best.copy()
    for i in range(1, longest):
        live = sizes > i
        via = best[live][:, :, None] + tr[None]
        back[live, i] = via.argmax(axis=1)
        best[live] = via.max(axis=1) + score[starts[live] + i]
        final[live] = best[live]
    out = np.zeros((n, longest), dtype=np.int64)
    last = (final + tr[:, 0]).argmax(axis=1)
    for i in range(longest - 1, -1, -1):
        here = sizes > i
        out[here, i] = last[here]
        if i:
            last = np.where(here, back[np.arange(n), i, last], last)
    return out


def gold_labels(t: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    gold = np.zeros(len(t.kind), dtype=np.int64)
    real = np.flatnonzero(t.owner >= 0)
    for i, own in enumerate(spans):
        for start, end, kind in own:
            lo, hi = np.searchsorted(t.start[real], [t.base[i] + start, t.base[i] + end])
            b = LABELS.index(f"B-{kind}")
            gold[real[lo:hi]] = b + 1
            gold[real[lo]] = b
    return gold


class Chunk:
    """A part of the labelled table as index arrays, with one row of a padded grid for each text."""

    def __init__(self, model: Model, part: list[tuple[str, list[tuple[int, int, str]]]]):
        t = Tokens([x for x, _ in part], model)
        real = np.flatnonzero(t.owner >= 0)
        # Words are hidden at random, so that shapes and their order have to carry the labels in sentences of other words.
        hidden = np.random.Generator(np.random.PCG64(len(part[0][0]))).random(len(t.kind)) < HIDDEN
        self.index = np.stack(list(model.columns(t, hidden)), axis=1)[real]
        self.gold = gold_labels(t, [s for _, s in part])[real]
        self.text = t.owner[real]
        self.size = np.bincount(self.text, minlength=len(part))
        self.column = np.arange(len(real)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.mask = np.zeros((len(part), int(self.size.max())), dtype=bool)
        self.mask[self.text, self.column] = True

    def number(self, used: np.ndarray) -> None:
        """Features by their place among all used ones, and the tokens that have each."""
        flat = np.searchsorted(used, self.index)
        order = np.argsort(flat, axis=None, kind="stable")
        self.flat, self.feature = flat, flat.ravel()[order]
        self.cuts = np.flatnonzero(np.r_[True, self.feature[1:] != self.feature[:-1]])
        self.feature, self.token_of = self.feature[self.cuts], order // flat.shape[1]
        n = len(self.mask)
        grid = np.zeros(self.mask.shape, dtype=np.int64)
        grid[self.text, self.column] = self.gold
        self.pair = np.zeros((Y, Y))
        inner = self.mask[:, 1:]
        np.add.at(self.pair, (np.zeros(n, dtype=int), grid[:, 0]), 1)
        np.add.at(self.pair, (grid[:, :-1][inner], grid[:, 1:][inner]), 1)
        np.add.at(self.pair, (grid[np.arange(n), self.size - 1], np.zeros(n, dtype=int)), 1)

    def gradient(self, w: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log likelihood: rows of the chunk's features, and the transitions."""
        n, longest = self.mask.shape
        emit = np.zeros((n, longest, Y))
        emit[self.text, self.column] = sum(w[self.flat[:, k]] for k in range(self.flat.shape[1]))
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        pair, mask = np.exp(tr), self.mask
        alpha, beta, expected = np.zeros((n, longest, Y)), np.ones((n, longest, Y)), np.zeros((Y, Y))
        a = e[:, 0] * pair[0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for i in range(1, longest):
            a = (alpha[:, i - 1] @ pair) * e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], a / a.sum(axis=1, keepdims=True), alpha[:, i - 1])
        beta[:, -1] = pair[:, 0] / pair[:, 0].sum()
        for i in range(longest - 2, -1, -1):
            on = beta[:, i + 1] * e[:, i + 1]
            b = on @ pair.T
            here = mask[:, i + 1]
            beta[:, i] = np.where(here[:, None], b / b.sum(axis=1, keepdims=True), beta[:, i + 1])
            scale = 1 / np.einsum("ka,ab,kb->k", alpha[here, i], pair, on[here])
            expected += pair * ((alpha[here, i] * scale[:, None]).T @ on[here])
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        expected[0] += gamma[:, 0].sum(axis=0)
        expected[:, 0] += gamma[np.arange(n), self.size - 1].sum(axis=0)
        error = gamma[self.text, self.column]
        error[np.arange(len(error)), self.gold] -= 1
        return np.add.reduceat(error[self.token_of], self.cuts, axis=0), expected - self.pair


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 12, chunk: int = 160, rate: float = 0.2, decay: float = 2e-3) -> Model:
    """Maximises the conditional log likelihood by gradient steps over chunks of the table, scaled for each weight."""
    counts: dict[str, int] = {}
    for text, spans in table:
        masked = text
        for start, end, _ in reversed(spans):
            masked = masked[:start] + " " + masked[end:]
        for w in set(x.lower() for x in TOKEN.findall(masked) if not x.isdigit()):
            counts[w] = counts.get(w, 0) + 1
    words = sorted(w for w, c in counts.items() if c >= 4 and fold(w) not in GIVENS)
    signatures: dict[str, int] = {}
    for text, _ in table:
        for m in RUN.finditer(text):
            s = run_shape(m.group())[0]
            signatures[s] = signatures.get(s, 0) + 1
    model = Model(words, sorted(s for s, c in signatures.items() if c >= 3))
    ordered = sorted(table, key=lambda x: zlib.crc32(x[0].encode()))
    chunks = [Chunk(model, ordered[i : i + chunk]) for i in range(0, len(ordered), chunk)]
    used = np.unique(np.concatenate([np.unique(c.index) for c in chunks]))
    for c in chunks:
        c.number(used)
    w, tr = np.zeros((len(used), Y)), np.zeros((Y, Y))
    squares_w, squares_tr = np.full_like(w, 1e-3), np.full_like(tr, 1e-3)
    for epoch in range(epochs):
        for c in chunks:
            g, h = c.gradient(w, tr)
            g += decay * w[c.feature]
            squares_w[c.feature] += g * g
            squares_tr += h * h
            step = rate * (1 - 0.8 * epoch / epochs)
            w[c.feature] -= step * g / np.sqrt(squares_w[c.feature])
            tr -= step * h / np.sqrt(squares_tr)
    model.weights[used] = w
    model.transition = tr.astype(np.float32)
    model.reset()
    return model


@lru_cache(maxsize=2)
def default_model(copies: int = 10, seed: int = 7) -> Model:
    return train(labelled_table(copies, seed))


def find(texts: list[str], model: Model) -> list[tuple[int, str, int, int]]:
    """(text number, kind, start, end) of each span."""
    if not texts:
        return []
    t = Tokens(texts, model)
    labels = model.decode(t)
    named = np.flatnonzero(labels)
    out: list[tuple[int, str, int, int]] = []
    previous = -2
    for i in named:
        label = labels[i]
        kind = KINDS_OF[(label - 1) // 2]
        text = int(t.owner[i])
        start, end = int(t.start[i] - t.base[text]), int(t.end[i] - t.base[text])
        if label % 2 == 0 and previous == i - 1 and out[-1][0] == text and out[-1][1] == kind:
            out[-1] = (text, kind, out[-1][2], end)
        else:
            out.append((text, kind, start, end))
        previous = i
    # By definition, numbers and addresses hold a digit.
    return [f for f in out if f[1] in ("email", "name") or any(c.isdigit() for c in texts[f[0]][f[2] : f[3]])]


def personal_information(records: DataFrame, id_column: str = "id", content_column: str = "content", model: Model | None = None) -> DataFrame:
    """(id, kind, found) for each distinct piece of personal information of each row."""
    fitted = model or default_model()
    id_type = records.schema[id_column].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                found = find(texts, fitted)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([f[0] for f in found], type=pa.int64())),
                        pa.array([f[1] for f in found], type=pa.string()),
                        pa.array([texts[i][s:e] for i, _, s, e in found], type=pa.string()),
                    ],
                    names=["id", "kind", "found"],
                )

    return (
        spread(records).where(F.col(id_column).isNotNull() & (F.length(content_column) > 0))
        .select(F.col(id_column).alias("id"), F.col(content_column).alias("content"))
        .mapInArrow(search, f"id {id_type}, kind string, found string")
        .distinct()
    )


PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS_OF}


def redact(text: str, model: Model | None = None) -> str:
    """The text with each span replaced by its typed placeholder, everything else unchanged."""
    out, at = [], 0
    for _, kind, start, end in find([text], model or default_model()):
        out += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join(out) + text[at:]


def redacted(records: DataFrame, id_column: str = "id", content_column: str = "content", model: Model | None = None) -> DataFrame:
    """(id, content) of every row, with typed placeholders; null stays null."""
    fitted = model or default_model()
    id_type = records.schema[id_column].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                out = [[] for _ in texts]
                done = [0] * len(texts)
                for i, kind, start, end in find([x or "" for x in texts], fitted):
                    out[i] += [texts[i][done[i] : start], PLACEHOLDER[kind]]
                    done[i] = end
                whole = [None if x is None else "".join(o) + x[d:] for x, o, d in zip(texts, out, done)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, type=pa.string())], names=["id", "content"])

    return spread(records).select(F.col(id_column).alias("id"), F.col(content_column).alias("content")).mapInArrow(replace, f"id {id_type}, content string")
