"""Problem 1: all pairs of records whose sets of values overlap above a threshold.

Method: minwise hash signatures in bands; records sharing a band's bucket are joined,
candidates made distinct and verified exactly on the whole sets.

Defined results: null columns count as empty, null and blank values drop out, repeated
values count once, sets below min_size take no part, rows with a null id take no part,
an id that
stands in several rows counts with each of its sets, an empty table gives no pairs. Other columns of the
input, whatever their names, are not read. Records with equal sets form one class; only classes are
joined. `similar_set_classes` gives pairs of classes and membership, `similar_sets` all pairs of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.minhash import classed, expand_pairs, similar_classes
from memlake.session import spread

#: A pair at the threshold 0.6 is missed with a probability of (1 - 0.6^3)^36 < 0.0002.
BANDS, ROWS, SEED = 36, 3, 11


def normal_value(value: Column) -> Column:
    """Lower case, outer spaces cut, each run of spaces, hyphens and underscores as one hyphen; null if blank."""
    cut = F.regexp_replace(F.lower(value), r"^\s+|\s+$", "")
    return F.when(cut != "", F.regexp_replace(cut, r"[\s\-_]+", "-"))


def value_set(*columns: str) -> Column:
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(F.col(c), empty) for c in columns])
    return F.array_distinct(F.array_compact(F.transform(joined, normal_value)))


def similar_set_classes(
    records: DataFrame,
    id_column: str,
    set_columns: list[str],
    min_size: int = 4,
    numerator: int = 3,
    denominator: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Pairs (cid_a, cid_b) of different sets with a Jaccard similarity of at least numerator/denominator, and the members (cid, id) of each set."""
    values = F.transform(value_set(*set_columns), lambda v: F.xxhash64(v))
    classes, members = classed(spread(records), F.col(id_column), values, min_size, "values")
    return similar_classes(classes, bands, rows, SEED, numerator, denominator), members


def similar_sets(records: DataFrame, id_column: str, set_columns: list[str], **settings: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b, for the records of similar_set_classes()."""
    return expand_pairs(*similar_set_classes(records, id_column, set_columns, **settings))
