"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as in ECMAScript's \\s: Java's class is ASCII only (fixed value).
SPACE = r"[\s\x0B   -     　﻿]"
COMMENT = r"(?s)<!--.*?-->"
#: Lexical matching: of words as they stand, or of English stems without stop words.
MODES = ("simple", "english")
SEE_ALSO = r"(?is)\[see also:.*?\]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """Outer white space cut, inner runs of it as one space."""
    return trimmed(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_content(content: Column) -> Column:
    """Content without comments and reference marks, white space collapsed. Null stays null."""
    return collapsed(F.regexp_replace(F.regexp_replace(content, COMMENT, ""), SEE_ALSO, ""))


def fingerprint(content: Column) -> Column:
    """SHA-256 of the normalised content as hexadecimal text."""
    return F.sha2(normalize_content(content), 256)


def pair_hash(a: Column, b: Column) -> Column:
    """The same 16 hexadecimal digits for both orders of a pair of ids."""
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 16)


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """Words times 1.3, rounded up."""
    return F.ceil(F.size(words(text)) * F.lit(1.3).cast("double")).cast("long")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def topic_slug(topic: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(topic), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def topic_title(topic: Column) -> Column:
    """Words between hyphens, underscores and white space, each with a capital; the rest of a word stays."""
    parts = F.filter(F.split(topic, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def headers(body: Column) -> Column:
    """Second and third level headings of a markdown text."""
    return F.filter(F.split(body, "\n"), lambda line: line.rlike("^###? "))


def excerpt(text: Column, most: int = 120) -> Column:
    flat = collapsed(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order of appearance."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0), F.lower)


def terms(text: Column, mode: str = "simple") -> Column:
    """The tokens; in the mode 'english' their stems, without stop words."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    return tokens(text) if mode == "simple" else english_terms(tokens(text))


def lexemes(text: Column, mode: str = "simple") -> Column:
    """Distinct terms in order of the alphabet."""
    return F.sort_array(F.array_distinct(terms(text, mode)))


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode NFKC form; Spark has no built-in for it."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_entity_name(name: Column) -> Column:
    return collapsed(F.lower(nfkc(name)))


def body_text(text: Column) -> Column:
    """A document without front matter, header lines and citation marks, white space collapsed: what is compared between two runs."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    body = F.regexp_replace(body, r"(?m)^#{1,6}\s.*$", "")
    return collapsed(F.regexp_replace(body, r"<m:[a-zA-Z0-9-]+>|\[m:[a-zA-Z0-9-]+\]", ""))


def extraction_reply(reply: Column, types: tuple[str, ...]) -> Column:
    """struct(matched, new_entities, dropped, clamped, error) from a JSON reply.

    Entries without a name, a confidence or a known type are dropped and counted, confidences are clamped to [0, 1] and those counted; without both
    lists the reply is an error.
    """
    entry = "array<struct<type: string, canonical_name: string, aliases: array<string>, confidence: double>>"
    root = F.from_json(reply, f"matched {entry}, new_entities {entry}")
    readable = root["matched"].isNotNull() & root["new_entities"].isNotNull()
    named = lambda e: F.coalesce((e["canonical_name"] != "") & e["confidence"].isNotNull(), F.lit(False))
    typed = lambda e: named(e) & F.coalesce(e["type"].isin(*types), F.lit(False))
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    matched, new = F.filter(root["matched"], named), F.filter(root["new_entities"], typed)
    outside = lambda entries: F.size(F.filter(entries, lambda e: within(e["confidence"]) != e["confidence"]))
    return F.struct(
        F.transform(matched, lambda e: F.struct(e["canonical_name"].alias("canonical_name"), within(e["confidence"]).alias("confidence"))).alias("matched"),
        F.transform(
            new,
            lambda e: F.struct(
                e["type"].alias("type"), e["canonical_name"].alias("canonical_name"),
                F.array_compact(F.coalesce(e["aliases"], F.array().cast("array<string>"))).alias("aliases"), within(e["confidence"]).alias("confidence"),
            ),
        ).alias("new_entities"),
        (F.size(root["matched"]) - F.size(matched) + F.size(root["new_entities"]) - F.size(new)).alias("dropped"),
        (outside(matched) + outside(new)).alias("clamped"),
        F.when(~readable, F.lit("matched or new_entities is missing")).alias("error"),
    )


def verdict(reply: Column) -> Column:
    """True for a reply that begins with YES, false for NO, null if it can't be read."""
    said = F.filter(F.regexp_extract_all(F.upper(reply), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: w != "ANSWER")
    first = F.try_element_at(said, F.lit(1))
    return F.when(first == "YES", F.lit(True)).when(first == "NO", F.lit(False))


def reply_field(reply: Column, key: str, value: str) -> Column:
    """What stands after a quoted key in text that may be JSON, JSON among other text, or the beginning of it; null if nothing does."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(reply, f'"{key}"', 2), -1), f"^[^\\w\"]*{value}", 1), F.lit(""))


def relation_reply(reply: Column, allowed: tuple[str, ...]) -> Column:
    """struct(relation, confidence, rationale, error) from a reply that should be a JSON object.

    The object is taken from its first brace to its last one. Where it can't be read as a whole (it was cut off), its fields are read one by one,
    and the rationale is marked as cut.
    """
    said = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    whole = F.from_json(said, "relation string, confidence double, rationale string")
    read = whole["relation"].isNotNull()
    has = lambda key: reply.contains(f'"{key}"')
    one = lambda key, value: F.when(has(key), reply_field(reply, key, value))
    relation = F.lower(F.when(read, whole["relation"]).otherwise(one("relation", r'"(\w+)"')))
    confidence = F.when(read, F.coalesce(whole["confidence"], F.lit(0.0))).otherwise(one("confidence", r"(\d*\.?\d+)").cast("double"))
    cut = F.concat_ws(" ", one("rationale", r'"([^"]*)'), F.lit("[truncated]"))
    rationale = F.when(read, F.coalesce(trimmed(whole["rationale"]), F.lit(""))).otherwise(cut)
    error = (
        F.when(relation.isNull() | confidence.isNull(), F.lit("unreadable"))
        .when(~relation.isin(*allowed), F.concat(F.lit("unknown relation: "), relation))
    )
    return F.struct(relation.alias("relation"), confidence.alias("confidence"), rationale.alias("rationale"), error.alias("error"))


# Stemming after Porter's paper "An algorithm for suffix stripping" (1980).

#: The stop words of PostgreSQL's text search configuration 'english'.
STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)


def _forms(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _forms(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _forms(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _forms(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for rule in sorted(rules.split(), key=lambda x: -len(x.partition(":")[0])):
            end, _, to = rule.partition(":")
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + to
                break
    for end in sorted([*_STEP4.split(), "ion"], key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems without stop words, in order of appearance; tokens are cut out in the JVM by tokens()."""
    known: dict[str, str] = {}

    def stem(word: str) -> str:
        if word not in known:
            known[word] = porter(word) if word.isascii() else word
        return known[word]

    for batch in texts:
        yield batch.map(lambda ws: None if ws is None else [stem(w) for w in ws if w not in STOP_WORDS])


def english_lexemes(tokens: Column) -> Column:
    """Distinct stems without stop words, sorted."""
    return F.sort_array(F.array_distinct(english_terms(tokens)))
