"""Problem 9: keyword-stuffed and link-list pages.

Method: shares of a text's words are thresholded, with thresholds calibrated for each language on the whole corpus. The corpus is read
twice. The first pass takes the share of function words of each text (outside of links and tags) and its language, guessed from
the function words themselves, as the column is often wrong; the median of each language is its usual share, one row a language. The second pass
weighs the texts whose share lies below FUNCTION_PART of the usual one; all others are sentences. They are cut into lines and those into
clauses, and every clause is weighed on its own: words in links and link labels, hashtags, product lines
(an article number and a price), lists of short items held together by separators (separator density),
repeated lines, and clauses at least half of whose words are top words or parts of repeated n-grams of
the text. Top words are those that are frequent each by itself, and, where the repeated words and the 2- and
3-grams jointly make up half of the text, all of them. A clause that has the function words of a sentence (CLAUSE_PART of the usual
share) is a sentence even if it repeats words, and one with LIST_PART of them is no list. A text is reported when at least min_share
of its words stand outside sentences in such clauses and it has at least min_words words.

Defined results: null, empty, blank and short texts are not reported; very long texts are read whole;
rows that repeat an id are reported once if one of them qualifies; rows with a null id take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import spread

MIN_SHARE, MIN_WORDS = 0.75, 20
#: Parts of a language's usual share of function words: of a text to be weighed, of a stuffed clause and of a list.
FUNCTION_PART, CLAUSE_PART, LIST_PART = 0.6, 1.1, 0.33
#: Usual share where no text of a language is known.
USUAL = 0.3
#: From which count a word or an n-gram is repeated, and the part of a text's words that all of them must make up together.
WORD_REPEATS, GRAM_REPEATS, JOINT_SHARE = 4, 3, 0.5
#: Part of a text in repeated n-grams that prose doesn't reach in any language.
GRAM_SHARE = 0.35
#: Prose of n words has about n ** 0.85 different ones in any language.
VOCABULARY = 0.7

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an of to and in for is that by with after so which now until it its not while under on over was were from has had if about since because before but leave whenever be are would could whether does do tell keep as at this then when who they we you there than or into between both one only",
    "de": "der die das und von für nicht ist mit wird den dem des bei vor noch aus ein eine einen im am zu auf sich auch als wie nach seit wir ihr sie er es war hat haben oder aber wenn dass fehlen unter siehe laut bleibt bitte solange",
    "fr": "le la les de des du et que en il elle est une un dans avant si sur à au aux pour pas ne se ce cette qui nous vous avec sans sinon mais plus tant depuis côté a ont sont été chez l d n s qu c",
    "es": "el los las y del una un que no por con se para su más mientras en de la es al lo como pero sin sobre entre antes después según aunque si ya sigue siga quién desde sus esta este deja",
}
_FUNCTION = {word: {lang for lang, words in FUNCTION_WORDS.items() if word in words.split()} for words in FUNCTION_WORDS.values() for word in words.split()}

LANGUAGES = tuple(FUNCTION_WORDS)
_CODE = {word: sum(1 << i for i, lang in enumerate(LANGUAGES) if lang in langs) for word, langs in _FUNCTION.items()}

WORD = re.compile(r"[^\W_]+")
LINK = re.compile(r"(?:https?://|www\.)[^\s<>()\]|,;]+", re.I)
MARKED_LINK = re.compile(r"\[([^\]\n]{0,80})\]\(\s*[^)\s]+\s*\)")
TAG = re.compile(r"(?:^|(?<=[\s,;|]))#[^\W\d_][\w-]*")
PRODUCT = re.compile(r"(?=.*\b[A-Z]{2,}[A-Z0-9]*-\d+\b)(?=.*(?<![\d.,])\d+[.,]\d\d\b(?![.,]\d))")
MARKUP = re.compile(r"<[^<>]*>|(?:https?://|www\.)[^\s<>()\]|,;]+", re.I)
CLAUSE = re.compile(r"(?<=[.!?])\s+")
SEPARATOR = re.compile(r"\s*[,;|/•·]\s+|\s+[,;|/•·]\s*|[;,|]")
CODE = re.compile(r"^\s*(?:def |return\b|class |import |from \w+ import|for \w+ in |if .*:$|[{}\[\]();]+$|```|\$ |>>> )|[=(]\w*\)?:?\s*$|\w\(.*\)\s*[:;]?\s*$")
TABLE = re.compile(r"^\s*\|.*\|\s*$")


def stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def plain_stems(words: list[str]) -> list[str]:
    return [w if w in _FUNCTION else stem(w) for w in words]


def within(stems: list[str], repeated: set[str], grams: set[tuple[str, ...]]) -> list[bool]:
    """Which words are repeated ones or stand in a repeated n-gram."""
    out = [w in repeated for w in stems]
    if grams:
        for i in range(len(stems) - 1):
            for k in (2, 3):
                if tuple(stems[i : i + k]) in grams:
                    out[i : i + k] = [True] * k
    return out


def repetition(words: list[str], counts: Counter) -> tuple[set[str], set[tuple[str, ...]]]:
    """The repeated words, and the repeated 2- and 3-grams that begin and end with one, if jointly they make up the text; else nothing.

    The rest of a text that is made of them must be small too: long prose in a language without a list of
    function words repeats most of its words, but has many more different ones.
    """
    n = len(words)
    often = {w for w, c in counts.items() if c >= GRAM_REPEATS and w not in _FUNCTION}
    # A 3-gram has one inner word at most for each word of its ends.
    if 2 * sum(counts[w] for w in often) < JOINT_SHARE * n:
        return set(), set()
    stems = plain_stems(words)
    ends = [w in often for w in stems]
    seen: Counter = Counter()
    for i in range(n - 1):
        if ends[i]:
            for k in (2, 3):
                if i + k <= n and ends[i + k - 1]:
                    seen[tuple(stems[i : i + k])] += 1
    grams = {g for g, c in seen.items() if c >= GRAM_REPEATS}
    repeated = {w for w in often if counts[w] >= WORD_REPEATS}
    known = repeated | {w for g in grams for w in (g[0], g[-1])}
    few = 2 * len(known) >= len(counts) or len(counts) <= n**VOCABULARY or sum(within(stems, set(), grams)) >= GRAM_SHARE * n
    return (repeated, grams) if few and sum(within(stems, repeated, grams)) >= JOINT_SHARE * n else (set(), set())


def profile(text: str) -> tuple[int, float, str]:
    """Words, share of function words outside of links and tags, and the language whose they are."""
    lower = text.lower()
    words = WORD.findall(lower)
    n = len(words)
    if "<" in lower or "www." in lower or "://" in lower:
        words = WORD.findall(MARKUP.sub(" ", lower))
    seen = Counter(map(_CODE.get, words))
    votes = [sum(c for code, c in seen.items() if code and code >> i & 1) for i in range(len(LANGUAGES))]
    most = max(votes)
    return n, most / n if n else 0.0, LANGUAGES[votes.index(most)] if most else "und"


def weigh(text: str, usual: float = USUAL) -> float:
    """Share of the words that stand in spam clauses."""
    words = [w.lower() for w in WORD.findall(text)]
    n = len(words)
    if not n:
        return 0.0
    # What repeats is judged outside of links, whose words count by themselves.
    outside = [w.lower() for w in WORD.findall(MARKUP.sub(" ", text))]
    counts = Counter(stem(w) for w in outside if not w.isdigit())
    often = max(4, 0.03 * len(outside))
    heavy = {w for w, c in counts.items() if c >= often and w not in _FUNCTION}
    repeated, grams = repetition(outside, counts)
    lines = [line for line in text.split("\n") if line.strip()]
    seen = Counter(line.strip().lower() for line in lines)
    spam = 0
    fenced = False
    for line in lines:
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        if fenced or TABLE.match(line):
            continue
        if "http" in line or "www." in line or "](" in line:
            bare = MARKED_LINK.sub(" ", line)
            rest = WORD.findall(re.sub(r"<[^>]*>", " ", LINK.sub(" ", bare)))
            linked = len(WORD.findall(line)) - len(rest)
            if sum(w.lower() in _FUNCTION for w in rest) < 2 and len(rest) <= 6 * max(1, len(LINK.findall(line))):
                spam += linked + len(rest)
                continue
            spam += linked
            line = LINK.sub(" ", bare)
        tags = TAG.findall(line)
        if tags:
            spam += sum(len(WORD.findall(t)) for t in tags)
            line = TAG.sub(" ", line)
        if PRODUCT.match(line):
            own = [w.lower() for w in WORD.findall(line)]
            if len(own) <= 16 and sum(w in _FUNCTION for w in own) <= 2:
                spam += len(own)
                continue
        if CODE.search(line) and not line.rstrip().endswith((".", "!", "?")):
            continue
        for clause in CLAUSE.split(line):
            own = [w.lower() for w in WORD.findall(clause)]
            m = len(own)
            if not m:
                continue
            if repeated or grams:
                part = within(plain_stems(own), repeated, grams)
                stuffed = sum(p or stem(w) in heavy or w in heavy for w, p in zip(own, part))
                grammar = sum(w in _FUNCTION and w not in heavy and not p for w, p in zip(own, part))
            else:
                stuffed = sum(stem(w) in heavy or w in heavy for w in own)
                grammar = sum(w in _FUNCTION and w not in heavy for w in own)
            items = [x for x in SEPARATOR.split(clause) if x.strip()]
            if (stuffed >= 0.5 * m and grammar <= CLAUSE_PART * usual * m) or (seen[line.strip().lower()] >= 3 and grammar == 0 and not (m == 1 and own[0].isdigit())):
                spam += m
            elif len(items) >= 5 and m <= 3 * len(items) and grammar <= LIST_PART * usual * m and sum(w.isdigit() for w in own) <= 0.2 * m:
                spam += m
    return spam / n


def profiles(documents: DataFrame, text_column: str) -> DataFrame:
    """(words, function, lang) of each text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [profile(t) for t in batch.column(0).to_pylist()]
            columns = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["words", "function", "lang"])

    return spread(documents.where(F.col(text_column).isNotNull()).select(text_column)).mapInArrow(measure, "words int, function double, lang string")


def stuffed_pages(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_share: float = MIN_SHARE,
    min_words: int = MIN_WORDS,
    function_part: float = FUNCTION_PART,
) -> DataFrame:
    """(doc_id) of the pages made of keywords, links, tags or products instead of sentences."""
    medians = profiles(documents, text_column).where(F.col("words") >= min_words).groupBy("lang").agg(F.percentile_approx("function", 0.5).alias("usual"))
    usual = {r["lang"]: r["usual"] for r in medians.collect()}  # a row for each language at most
    kind = documents.schema[id_column].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, function, lang = profile(text)
                if n >= min_words and (lang == "und" or function <= function_part * usual.get(lang, USUAL)):
                    keep[i] = weigh(text, USUAL if lang == "und" else usual.get(lang, USUAL)) >= min_share
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=[id_column]).filter(pa.array(keep))

    rows = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(id_column, text_column)
    return spread(rows).mapInArrow(judge, f"`{id_column}` {kind}").distinct()
