"""Hybrid retrieval for a batch of queries: (query_id, query_text, query_vector) against all records.

Every record is scored against every query of the batch: the semantics are an exact scan. The batch is a
stated, small set (checked against MAX_QUERIES) that is sent to all tasks, so records are read once and
nothing is shuffled but each Arrow batch's best rows for each query.

Words match as they stand (mode 'simple', which SQL can check) or by their English stems without stop words (mode 'english').
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.functions.text import estimate_tokens, lexemes, terms, word_set
from memlake.operators.edges import signals
from memlake.operators.entities import links_of
from memlake.operators.filters import active, in_scopes, matches_all, not_rejected, overlaps, within
from memlake.session import materialize, spread
from memlake.sources.store import NEAR_SCORE, planned_operation

MAX_QUERIES = 10_000
TIER_WEIGHT = {"preferences": 1.3, "project-context": 1.0, "conversations": 0.8}
TIER_ORDER = {"preferences": 0, "project-context": 1, "conversations": 2}
SEMANTIC_SHARE, LEXICAL_SHARE = 0.7, 0.3


def collected(queries: DataFrame, mode: str = "simple") -> list:
    """The batch's rows (query_id, words, query_vector), once their number is known to be small."""
    rows = queries.select("query_id", F.array_distinct(terms(F.coalesce("query_text", F.lit("")), mode)).alias("words"), "query_vector").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one batch; split it")
    return rows


def tier_weight(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in TIER_WEIGHT.items():
        out = F.when(tier == name, F.lit(weight)).otherwise(out)
    return out


def tier_order(tier: Column) -> Column:
    out = F.lit(len(TIER_ORDER))
    for name, place in TIER_ORDER.items():
        out = F.when(tier == name, F.lit(place)).otherwise(out)
    return out


def rounded(score: Column, digits: int = 6) -> Column:
    """Half up also for negative numbers."""
    return F.floor(score * 10**digits + 0.5) / 10**digits


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.floor(x * 10**digits + 0.5) / 10**digits


class Batch:
    """A batch of queries as matrices: unit vectors, and which words of the batch's vocabulary each one asks for."""

    def __init__(self, rows: list):
        self.ids = [r["query_id"] for r in rows]
        self.words = sorted({w for r in rows for w in r["words"]})
        place = {w: i for i, w in enumerate(self.words)}
        self.asks = np.zeros((len(self.words), len(rows)))
        for j, r in enumerate(rows):
            for w in r["words"]:
                self.asks[place[w], j] = 1
        self.dims = max([len(r["query_vector"]) for r in rows if r["query_vector"]], default=0)
        self.vectors = np.full((self.dims, len(rows)), np.nan)
        for j, r in enumerate(rows):
            if r["query_vector"] and len(r["query_vector"]) == self.dims and None not in r["query_vector"]:
                self.vectors[:, j] = r["query_vector"]
        self.lengths = np.sqrt((self.vectors**2).sum(axis=0))

    def semantic(self, column: pa.Array) -> np.ndarray:
        """Cosines (records, queries); NaN where one has no vector, 0 where one is all zero."""
        out = np.full((len(column), len(self.ids)), np.nan)
        if not self.dims:
            return out
        offsets = column.offsets.to_numpy()
        fits = np.flatnonzero((np.diff(offsets) == self.dims) & ~np.asarray(column.is_null()))
        if len(fits):
            flat = column.values.to_numpy(zero_copy_only=False)
            own = flat[offsets[fits][:, None] + np.arange(self.dims)].astype(np.float64)
            scale = np.sqrt((own**2).sum(axis=1))[:, None] * self.lengths[None]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fits] = half_up(np.where(scale == 0, 0.0, own @ self.vectors / scale))
        return out

    def lexical(self, column: pa.Array) -> np.ndarray:
        """Occurrences of the query's words bounded to [0, 1), 0 unless all of them occur and for an empty query."""
        n, v = len(column), len(self.words)
        if not v:
            return np.zeros((n, len(self.ids)))
        found = pc.index_in(column.flatten(), value_set=pa.array(self.words)).to_numpy(zero_copy_only=False)
        sizes = np.diff(column.offsets.to_numpy())
        sizes[np.asarray(column.is_null())] = 0
        owner = np.repeat(np.arange(n), sizes)
        hit = ~np.isnan(found.astype(np.float64))
        counts = np.bincount(owner[hit] * v + found[hit].astype(np.int64), minlength=n * v).reshape(n, v)
        hits = counts @ self.asks
        asked = self.asks.sum(axis=0)
        every = ((counts > 0) @ self.asks == asked[None]) & (asked > 0)[None]
        return np.where(every, half_up(hits / (hits + 1)), 0.0)


def scored(
    records: DataFrame, queries: DataFrame, scopes: Sequence[str] | None = None, keep: int | None = None, by: str = "raw_score", per_tier: bool = False,
    columns: Sequence[str] = ("tier", "content", "embedding", "project_scope"), mode: str = "simple",
) -> DataFrame:
    """Active records that match a query by vector or by words: semantic, lexical and combined score, and how they matched.

    A record without a vector, or a query without one, has a null semantic score. With `keep`, each Arrow batch passes on only
    what can be among the best `keep` of a query (and tier) by `by`; the exact cut is best()'s. Cosines of a batch are one matrix
    product: the built-in array functions are interpreted and take a hundred times as long.
    """
    batch_of = Batch(collected(queries, mode))
    query_type = queries.schema["query_id"].dataType
    passed = ["id", *columns]
    base = spread(records.where(active() & in_scopes(scopes))).select(*passed, F.col("embedding").alias("_vector"), terms(F.col("content"), mode).alias("_tokens"))
    if "tier" not in passed:
        raise ValueError("tier is needed")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            semantic, lexical = batch_of.semantic(batch.column(len(passed))), batch_of.lexical(batch.column(len(passed) + 1))
            has, found = ~np.isnan(semantic), lexical > 0
            raw = half_up(np.where(has & found, SEMANTIC_SHARE * np.nan_to_num(semantic) + LEXICAL_SHARE * lexical, np.where(has, semantic, lexical)))
            order = {"raw_score": raw, "semantic": np.where(has, semantic, -np.inf), "lexical": lexical}[by]
            tiers = batch.column(passed.index("tier")).to_pylist() if per_tier else None
            groups = [np.array([t == x for t in tiers]) for x in set(tiers)] if per_tier else [np.ones(batch.num_rows, dtype=bool)]
            rows, cols = [], []
            for j in range(len(batch_of.ids)):
                for group in groups:
                    own = np.flatnonzero((has[:, j] | found[:, j]) & group)
                    if keep is not None and len(own) > keep:
                        value = order[own, j]
                        own = own[value >= np.partition(value, len(value) - keep)[len(value) - keep]]
                    rows.append(own)
                    cols.append(np.full(len(own), j))
            r, c = np.concatenate(rows), np.concatenate(cols)
            taken = batch.take(pa.array(r))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch_of.ids[j] for j in c], type=to_arrow_type(query_type)), *taken.columns[: len(passed)],
                    pa.array(semantic[r, c], mask=~has[r, c]), pa.array(lexical[r, c]), pa.array(raw[r, c]),
                ],
                names=["query_id", *passed, "semantic", "lexical", "raw_score"],
            )

    kinds = ", ".join(f"`{f}` {base.schema[f].dataType.simpleString()}" for f in passed)
    matches = base.mapInArrow(score, f"query_id {query_type.simpleString()}, {kinds}, semantic double, lexical double, raw_score double")
    found = F.col("lexical") > 0
    kind = F.when(F.col("semantic").isNotNull() & found, F.lit("hybrid")).when(F.col("semantic").isNotNull(), F.lit("semantic")).otherwise(F.lit("fulltext"))
    return matches.withColumn("match_type", kind)


def best(matches: DataFrame, n: int, by: str = "raw_score", within: Sequence[str] = ("query_id",)) -> DataFrame:
    """The n best rows of each query (and tier), ties to the smaller id."""
    order = Window.partitionBy(*within).orderBy(F.desc(by), "id")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def weighted(candidates: DataFrame) -> DataFrame:
    """Tier weights apply after the candidates are cut, so they can't bring back a row that was cut off."""
    return candidates.withColumn("score", rounded(F.col("raw_score") * tier_weight(F.col("tier"))))


def hybrid_search(records: DataFrame, queries: DataFrame, k: int = 10, scopes: Sequence[str] | None = None, min_score: float = 0.0, mode: str = "simple") -> DataFrame:
    """Candidates of each query: max(3k, 30) by raw score, floor on the raw score, then tier weights."""
    n = max(3 * k, 30)
    candidates = best(scored(records, queries, scopes, keep=n, mode=mode), n)
    return weighted(candidates.where(F.col("raw_score") >= min_score))


def progressive_search(records: DataFrame, queries: DataFrame, k: int = 10, stop_at: float = 0.6, scopes: Sequence[str] | None = None, mode: str = "simple") -> DataFrame:
    """Tier after tier: a tier counts only if no earlier one had a raw score of stop_at or more."""
    n = max(3 * k, 30)
    per_tier = best(scored(records, queries, scopes, keep=n, per_tier=True, mode=mode), n, within=("query_id", "tier")).withColumn("place", tier_order(F.col("tier")))
    earlier = Window.partitionBy("query_id").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("raw_score").over(earlier), F.lit(-1.0))
    return weighted(per_tier.withColumn("reached", reached).where(F.col("reached") < stop_at))


def within_budget(ranked: DataFrame, max_tokens: int, k: int, order: str = "rank") -> DataFrame:
    """The longest prefix of each query's ranking that fits the token budget, and at most k rows. It stops at the first overflow."""
    before = Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.withColumn("tokens", estimate_tokens(F.col("content")))
        .withColumn("used_tokens", F.sum("tokens").over(before))
        .withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))
        .where((F.col("used_tokens") <= max_tokens) & (F.col("place") <= k))
    )


def diversified(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's bounded candidates: (query_id, id, position).

    The best candidate comes first; then always the one with the largest weight * score - (1 - weight) * largest similarity to
    those chosen, similarities below zero counting as zero, the first maximum on ties. Similarity is the cosine if both have
    vectors, otherwise the overlap of their words. Greedy and sequential, so it runs in numpy for each query.
    """
    query_type = candidates.schema["query_id"].dataType.simpleString()
    id_type = candidates.schema["id"].dataType.simpleString()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        n = len(rows)
        sets = [set(x) for x in rows["words"]]
        vectors = [None if v is None else np.asarray(v, dtype=np.float64) for v in rows["embedding"]]
        norms = [None if v is None else float(np.sqrt(v @ v)) for v in vectors]
        nearest, left, chosen = np.zeros(n), np.ones(n, dtype=bool), []
        score = rows["score"].to_numpy(dtype=np.float64)
        for _ in range(min(k, n)):
            value = score if not chosen else weight * score - (1 - weight) * nearest
            pick = int(np.argmax(np.where(left, np.round(value, 9), -np.inf)))
            chosen.append(pick)
            left[pick] = False
            for i in np.flatnonzero(left):
                if vectors[i] is not None and vectors[pick] is not None:
                    scale = norms[i] * norms[pick]
                    s = float(vectors[i] @ vectors[pick]) / scale if scale else 0.0
                else:
                    union = len(sets[i] | sets[pick])
                    s = len(sets[i] & sets[pick]) / union if union else 0.0
                nearest[i] = max(nearest[i], s)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[chosen], "id": rows["id"].iloc[chosen], "position": range(1, len(chosen) + 1)})

    return (
        candidates.select("query_id", "id", "score", "embedding", word_set(F.col("content")).alias("words"))
        .groupBy("query_id")
        .applyInPandas(choose, f"query_id {query_type}, id {id_type}, position int")
    )


def entity_records(records: DataFrame, links: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """(entity_id, record columns): active records linked with the entities, most recently updated first (position)."""
    wanted = links.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", F.col("memory_id").alias("id")).distinct()
    recent = Window.partitionBy("entity_id").orderBy(F.desc_nulls_first("updated_at"), "id")
    return wanted.join(records.where(active()), "id").withColumn("position", F.row_number().over(recent)).withColumn("raw_score", F.lit(1.0))


def recall(records: DataFrame, queries: DataFrame, k: int = 10, max_tokens: int | None = None, min_score: float = 0.0, scopes: Sequence[str] | None = None, mode: str = "simple") -> DataFrame:
    """(query_id, id, score, position): search, floor, tier weights, diversity, token budget, in this order."""
    candidates = hybrid_search(records, queries, k, scopes, min_score, mode)
    picked = diversified(candidates, k if max_tokens is None else max(3 * k, 30))
    ranked = picked.join(candidates.select("query_id", "id", "score", "raw_score", "match_type", "content"), ["query_id", "id"])
    if max_tokens is not None:
        ranked = within_budget(ranked, max_tokens, k, order="position")
    return ranked.where(F.col("position") <= k).select("query_id", "id", "score", "match_type", "position") if max_tokens is None else ranked.select(
        "query_id", "id", "score", "match_type", "position"
    )


def search_mode(records: DataFrame, has_vector: bool, scopes: Sequence[str] | None = None) -> str:
    """'semantic' if the query has a vector and any record of the scopes has one, else 'fulltext_only'; tiers and types don't count."""
    if not has_vector:
        return "fulltext_only"
    return "fulltext_only" if records.where(in_scopes(scopes) & F.col("embedding").isNotNull()).limit(1).isEmpty() else "semantic"


def compacted(answers: DataFrame) -> DataFrame:
    """Answers as they leave: scores to three decimals, halves up, no creation time, empty people and false marks left out (null)."""
    out = answers.withColumn("score", F.floor(F.col("score") * 1000 + 0.5) / 1000)
    if "people" in out.columns:
        out = out.withColumn("people", F.when(F.size("people") > 0, F.col("people")))
    if "early_stopped" in out.columns:
        out = out.withColumn("early_stopped", F.when(F.col("early_stopped"), F.lit(True)))
    return out.drop("created_at")


def search(
    records: DataFrame, text: str | None = None, kind: str | None = None, tier: str | None = None, topics: Sequence[str] | None = None, people: Sequence[str] | None = None,
    since: str | None = None, until: str | None = None, scopes: Sequence[str] | None = None, limit: int = 20, mode: str = "english",
) -> DataFrame:
    """Records that meet all given filters, the newest first; a text matches by all of its terms. Rejections never show."""
    met = not_rejected() & in_scopes(scopes) & within("created_at", since, until) & overlaps("topics", topics or None) & overlaps("people", people or None)
    if kind is not None:
        met = met & (F.col("type") == kind)
    if tier is not None:
        met = met & (F.col("tier") == tier)
    rows = records.where(met)
    if text is not None:
        asked = records.sparkSession.range(1).select(lexemes(F.lit(text), mode).alias("q")).first()["q"]
        rows = rows.where(matches_all(lexemes(F.col("content"), mode), F.array(*map(F.lit, asked)).cast("array<string>")))
    return rows.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def nearest_records(records: DataFrame, candidates: DataFrame, scopes: Sequence[str] | None = None, floor: float = NEAR_SCORE) -> DataFrame:
    """(query_id, id, score): of the three best records of each candidate text (a query batch with column kind) the first above the floor, and what the candidate becomes."""
    found = best(hybrid_search(records, candidates, k=3, scopes=scopes, min_score=floor).drop("rank"), 1, by="score").select("query_id", "id", "score")
    rows = candidates.select("query_id", "kind").join(found, "query_id", "left")
    return rows.withColumn("operation", planned_operation(F.col("score"), F.col("kind")))


def answer(
    records: DataFrame, edges: DataFrame, links: DataFrame, entities: DataFrame, queries: DataFrame, k: int = 10, max_tokens: int | None = None, min_score: float | None = None,
    scopes: Sequence[str] | None = None, progressive: bool = False, entity_ids: DataFrame | None = None, mode: str = "english",
) -> DataFrame:
    """The whole answer to each query: (query_id, id, score, match_type, position, search_mode, signals, entities).

    The mode is chosen once for the batch; with entity_ids only records linked with them are searched; progressive search goes tier after tier.
    Then floor, tier weights, diversity and token budget, and for the answered records newer versions, contradictions and linked entities.
    """
    how = search_mode(records, not queries.where(F.col("query_vector").isNotNull()).limit(1).isEmpty(), scopes)
    asked = queries if how == "semantic" else queries.withColumn("query_vector", F.lit(None).cast("array<double>"))
    pool = records
    if entity_ids is not None:
        wanted = links.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").select(F.col("memory_id").alias("id")).distinct()
        pool = records.join(wanted, "id", "left_semi")
    least = min_score if min_score is not None else 0.0
    if progressive:
        candidates = progressive_search(pool, asked, k, scopes=scopes, mode=mode).where(F.col("raw_score") >= least)
        picked = diversified(best(candidates.drop("rank"), max(3 * k, 30), by="score"), k if max_tokens is None else max(3 * k, 30))
        ranked = picked.join(candidates.select("query_id", "id", "score", "match_type", "content"), ["query_id", "id"])
        if max_tokens is not None:
            ranked = within_budget(ranked, max_tokens, k, order="position")
        rows = ranked.where(F.col("position") <= k if max_tokens is None else F.lit(True)).select("query_id", "id", "score", "match_type", "position")
    else:
        rows = recall(pool, asked, k, max_tokens, least, scopes, mode)
    rows = materialize(rows, "answers")
    told = signals(edges, rows).groupBy("memory_id").agg(F.array_sort(F.collect_set(F.struct("kind", "other_id"))).alias("signals"))
    linked = links_of(rows, links, entities)
    out = rows.join(told.withColumnRenamed("memory_id", "id"), "id", "left").join(linked, "id", "left")
    return compacted(out.withColumn("search_mode", F.lit(how)))
