"""Vector search, hybrid fusion, decay, and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import (
    DECAY_FLOOR, HALF_LIFE_DAYS, KEYWORD_WEIGHT, MISSING, RRF_K, VECTOR_WEIGHT,
    age_days, recency_decay, relative, round_half_up, rrf_term,
)
from ..functions.vectors import constant, cosine
from .textindex import TextIndex, keyword_topk

#: Text and extra columns of each searched table; unknown names fall back to the first.
SEARCHED = {
    "memories": ("content", "tags"), "documents": ("content", "path"), "experiences": ("goal", "tags"), "trading_results": ("notes", "strategy"),
}


def search_columns(table: str) -> tuple[str, str]:
    return SEARCHED.get(table, SEARCHED["memories"])


def vector_topk(vectors: DataFrame, query: list[float], limit: int, threshold: float = 0.0, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(``id``, ``score``): the ``limit`` nearest vectors by cosine, strictly over ``threshold``; ties by id.

    One scan and a bounded top-k in each task; rows are joined afterwards, to the winners only.
    """
    score = F.round(cosine(F.col(vector_col), constant(query)), 9).alias("score")
    scored = vectors.select(F.col(id_col).alias("id"), score)
    return scored.where(F.col("score") > threshold).orderBy(F.desc("score"), "id").limit(limit)


def ranked(found: DataFrame) -> DataFrame:
    """A bounded result list with its ``rank`` from 1."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _merged(vec: DataFrame, kw: DataFrame) -> DataFrame:
    v = ranked(vec).select("id", F.col("score").alias("vec_score"), F.col("rank").alias("vec_rank"))
    k = ranked(kw).select("id", F.col("score").alias("kw_score"), F.col("rank").alias("kw_rank"))
    return v.join(k, "id", "full_outer")


def rrf(vec: DataFrame, kw: DataFrame, *, k: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """Reciprocal rank fusion of two result lists: ``id``, ``score`` at four places, and both true ranks."""
    fused = rrf_term(F.col("vec_rank"), vector_weight, k) + rrf_term(F.col("kw_rank"), keyword_weight, k)
    return _merged(vec, kw).select("id", round_half_up(fused).alias("score"), "vec_rank", "kw_rank")


def rsf(vec: DataFrame, kw: DataFrame, *, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT, missing: float = MISSING) -> DataFrame:
    """Relative score fusion: each side as a share of its best score, weighted and summed."""
    whole = Window.partitionBy()
    both = _merged(vec, kw).withColumn("vec_max", F.max("vec_score").over(whole)).withColumn("kw_max", F.max("kw_score").over(whole))
    most = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    fused = relative(F.col("vec_score"), most("vec_max"), vector_weight, missing) + relative(F.col("kw_score"), most("kw_max"), keyword_weight, missing)
    return both.select("id", round_half_up(fused).alias("score"), "vec_rank", "kw_rank")


def legacy_hybrid(vec: DataFrame, kw: DataFrame, limit: int) -> DataFrame:
    """The vector list, then the keyword list, each id once; scores of both scales as they are."""
    both = ranked(vec).withColumn("side", F.lit(0)).unionByName(ranked(kw).withColumn("side", F.lit(1)))
    first = both.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("side"))).where("turn = 1")
    return first.orderBy("side", "rank").limit(limit).select("id", "score", "side", "rank")


def with_decay(found: DataFrame, rows: DataFrame, as_of, *, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR, round_after: bool = False) -> DataFrame:
    """Scores times the recency decay of ``rows`` (``id``, ``created_at``, ``last_accessed_at``); ids not among them keep theirs."""
    days = age_days(F.coalesce("last_accessed_at", "created_at"), as_of)
    factors = rows.select("id", recency_decay(days, half_life, floor).alias("decay_factor"))
    scored = found.join(factors, "id", "left")
    score = F.col("score") * F.coalesce("decay_factor", F.lit(1.0))
    return scored.withColumn("score", round_half_up(score) if round_after else score)


def top(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(
    rows: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, mode: str = "hybrid", limit: int = 10, *,
    text_col: str = "content", decay_as_of=None, full_text: bool = True, vector_id: str = "id", index: TextIndex | None = None,
) -> DataFrame:
    """One search over a table: ``vector``, ``keyword``, ``rsf``, and for any other mode rank fusion.

    With an ``index`` of the rows' texts, the keyword side reads that.

    The two single modes never decay. The fused ones take twice the limit from
    each side, fuse, decay if ``decay_as_of`` is given, sort anew and cut.
    """
    by_words = lambda n: index.keyword(query, n) if index else keyword_topk(rows, query, n, text_col=text_col, full_text=full_text)
    if mode == "vector":
        return vector_topk(vectors, vector or [], limit, id_col=vector_id)
    if mode == "keyword" or not vector:
        return by_words(limit)
    sides = (vector_topk(vectors, vector, 2 * limit, id_col=vector_id), by_words(2 * limit))
    fused = rsf(*sides) if mode == "rsf" else rrf(*sides)
    if decay_as_of is not None:
        fused = with_decay(fused, rows, decay_as_of)
    return top(fused, limit)


def hybrid_search_rrf(vec: DataFrame, kw: DataFrame, rows: DataFrame, as_of, limit: int, *, k: int = RRF_K, vector_weight=VECTOR_WEIGHT, keyword_weight=KEYWORD_WEIGHT) -> DataFrame:
    """The variant that decays before it rounds, with the floor fixed at 0.1."""
    fused = rrf_term(F.col("vec_rank"), vector_weight, k) + rrf_term(F.col("kw_rank"), keyword_weight, k)
    raw = _merged(vec, kw).select("id", fused.alias("score"), "vec_rank", "kw_rank")
    return top(with_decay(raw, rows, as_of, floor=0.1, round_after=True), limit)


def federated(found: dict[str, DataFrame], limit: int) -> DataFrame:
    """The lists of several tables as one, best first, each row with its ``source_table``."""
    parts = [df.select(F.col("id").cast("string").alias("id"), "score", F.lit(name).alias("source_table")) for name, df in found.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.orderBy(F.desc("score"), "source_table", "id").limit(limit)


def context_package(sections: dict[str, DataFrame], caps: dict[str, int] | None = None) -> DataFrame:
    """Sections of a context side by side: ``section``, ``rank``, ``id``, ``score``; capped where asked."""
    out = None
    for name, found in sections.items():
        part = ranked(found)
        if caps and name in caps:
            part = part.where(F.col("rank") <= caps[name])
        part = part.select(F.lit(name).alias("section"), "rank", F.col("id").cast("string").alias("id"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def recall(candidates: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The first table, in the order given, that holds ``key``: (``source_table``, ``id``)."""
    out = None
    for k, (name, rows) in enumerate(candidates):
        part = rows.where(F.col("id").cast("string") == key).select(F.lit(k).alias("precedence"), F.lit(name).alias("source_table"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("precedence").limit(1).select("source_table", "id")
