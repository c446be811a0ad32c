"""Retrieval quality: ranks, recall, reciprocal rank, thresholds and identity metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import score, vector
from vitrail.operators.profile import nearest_rank
from vitrail.operators.topk import check_queries

#: Steps of the threshold sweep over [-1, 1].
THRESHOLD_STEPS = 200


def all_scores(queries: DataFrame, corpus: DataFrame, id_column: str, group_column: str, vector_column: str) -> DataFrame:
    """(query_id, query_group, candidate_id, candidate_group, score) of a stated query set, broadcast after a check of its size, against all other rows."""
    check_queries(queries, vector_column)
    q = queries.select(F.col(id_column).alias("query_id"), F.col(group_column).alias("query_group"), F.col(vector_column).alias("_q"))
    c = corpus.select(F.col(id_column).alias("candidate_id"), F.col(group_column).alias("candidate_group"), F.col(vector_column).alias("_c"))
    joined = c.join(F.broadcast(q), F.col("query_id") != F.col("candidate_id"))
    return joined.select("query_id", "query_group", "candidate_id", "candidate_group", F.round(vector.dot(F.col("_q"), F.col("_c")), 6).alias("score"))


def first_relevant_rank(scores: DataFrame) -> DataFrame:
    """(query_id, rank): the place of the first candidate of the query's group, by score, ties by candidate; null without one.

    The best relevant candidate of each query is found first; its rank is one more than the candidates before it, so nothing is sorted.
    """
    relevant = F.col("query_group").eqNullSafe(F.col("candidate_group"))
    best = scores.where(relevant).groupBy("query_id").agg(F.max(F.struct("score", (-F.col("candidate_id")).alias("_o"))).alias("_b"))
    joined = scores.join(best, "query_id", "left")
    before = (F.col("score") > F.col("_b.score")) | ((F.col("score") == F.col("_b.score")) & (F.col("candidate_id") < -F.col("_b._o")))
    return joined.groupBy("query_id").agg(F.when(F.max("_b").isNotNull(), F.sum(F.when(before, 1).otherwise(0)) + 1).alias("rank"))


def target_rank(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, rank) of a known candidate a query: one more than better candidates and equal ones of lower id."""
    t = targets.select("query_id", F.col("candidate_id").alias("_t"))
    with_target = scores.join(t, "query_id")
    own = with_target.where(F.col("candidate_id") == F.col("_t")).select("query_id", F.col("score").alias("_s"))
    joined = with_target.join(own, "query_id")
    before = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("candidate_id") < F.col("_t")))
    return joined.groupBy("query_id").agg((F.sum(F.when(before, 1).otherwise(0)) + 1).alias("rank"))


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 25), drop_unranked: bool = True) -> DataFrame:
    """(queries, recall_at_k..., mrr, mean_rank). Queries without a rank are dropped, or count with recall and reciprocal rank 0."""
    rows = ranks.where(F.col("rank").isNotNull()) if drop_unranked else ranks
    r = F.col("rank")
    recall = [F.round(F.coalesce(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), F.lit(0.0)), 6).alias(f"recall_at_{k}") for k in ks]
    mrr = F.round(F.coalesce(F.avg(F.coalesce(1 / r, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr")
    return rows.agg(F.count(F.lit(1)).alias("queries"), *recall, mrr, F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias("mean_rank"))


def with_group_positives(df: DataFrame, group: str) -> DataFrame:
    """Rows whose group has two rows or more; a null group has no others."""
    big = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(group)
    return df.join(big, group, "left_semi")


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(groups, smallest, p50, largest)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return ends.crossJoin(F.broadcast(nearest_rank(sizes, [], "n", {"p50": 0.5}))).select("groups", "smallest", "p50", "largest")


def threshold_sweep(pairs: DataFrame, steps: int = THRESHOLD_STEPS) -> DataFrame:
    """(step, threshold, tp, fp, tn, fn, f1) of every threshold -1 + 2 * step / steps.

    ``pairs`` has same (boolean) and similarity (float). Each pair is put at the last threshold that accepts it, and counts are
    summed over the few steps, so pairs are never multiplied by thresholds.
    """
    s = F.col("similarity").cast("float").cast("double")
    guess = F.least(F.greatest(F.floor((s + 1) * steps / 2 + 0.5), F.lit(-1)), F.lit(steps + 1))
    at = lambda g: F.lit(-1.0) + F.lit(2.0) * g / F.lit(float(steps))
    # The comparison itself decides at the neighbouring steps, as rounding would differ.
    last = F.when((guess + 1 <= steps) & (s >= at(guess + 1)), guess + 1).when(s >= at(guess), guess).when(s >= at(guess - 1), guess - 1).otherwise(guess - 2)
    counted = pairs.groupBy(F.least(F.greatest(last, F.lit(-1)), F.lit(steps)).cast("int").alias("last")).agg(
        F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("same"), F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("other")
    )
    every = pairs.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    joined = every.join(F.broadcast(counted), F.lit(True), "left")  # at most steps + 2 rows on either side
    taken = F.col("last") >= F.col("step")
    n = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    sums = joined.groupBy("step").agg(n("same", taken).alias("tp"), n("other", taken).alias("fp"), n("other", ~taken).alias("tn"), n("same", ~taken).alias("fn"))
    precision, recall = score.ratio(F.col("tp"), F.col("tp") + F.col("fp")), score.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("step", at(F.col("step")).alias("threshold"), "tp", "fp", "tn", "fn", F.round(score.f1(precision, recall), 9).alias("f1"))


def best_threshold(pairs: DataFrame, steps: int = THRESHOLD_STEPS) -> DataFrame:
    """(threshold, f1, far, frr): the best F1, then the fewest false accepts, then the highest threshold."""
    best = threshold_sweep(pairs, steps).orderBy(F.col("f1").desc(), "fp", F.col("threshold").desc()).limit(1)
    return best.select(
        F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"),
        F.round(score.ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("far"), F.round(score.ratio(F.col("fn"), F.col("fn") + F.col("tp")), 6).alias("frr"),
    )


def identity_ranks(pairs: DataFrame) -> DataFrame:
    """(query_id, rank) of the first candidate of the same person, by similarity and candidate id; null without one.

    ``pairs`` has query_id, query_person, candidate_id, candidate_person, similarity.
    """
    same = F.col("query_person").eqNullSafe(F.col("candidate_person"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "candidate_id")
    return pairs.withColumn("_n", F.row_number().over(order)).groupBy("query_id").agg(F.min(F.when(same, F.col("_n"))).alias("rank"))


def identity_metrics(pairs: DataFrame) -> DataFrame:
    """One row: queries, recall at 1, 5 and 10, mrr, and distances of same and different pairs. Queries without a match count."""
    ranks = rank_metrics(identity_ranks(pairs), (1, 5, 10), drop_unranked=False).drop("mean_rank")
    same = F.col("query_person").eqNullSafe(F.col("candidate_person"))
    d = pairs.select(same.alias("same"), F.round(1 - F.col("similarity").cast("float").cast("double"), 9).alias("distance"))
    mean = d.agg(
        F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("same_pairs"), F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("different_pairs"),
        F.round(F.coalesce(F.avg(F.when(F.col("same"), F.col("distance"))), F.lit(0.0)), 6).alias("same_mean"),
        F.round(F.coalesce(F.avg(F.when(~F.col("same"), F.col("distance"))), F.lit(0.0)), 6).alias("different_mean"),
    )
    p = nearest_rank(d, ["same"], "distance", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    pick = lambda s, c, name: F.round(F.coalesce(F.max(F.when(F.col("same") == s, F.col(c))), F.lit(0.0)), 6).alias(name)
    spread = p.agg(pick(True, "p50", "same_p50"), pick(True, "p90", "same_p90"), pick(False, "p10", "different_p10"), pick(False, "p50", "different_p50"))
    one = F.lit(True)  # single-row tables side by side
    return ranks.join(F.broadcast(mean), one).join(F.broadcast(spread), one)


def score_variants(scores: DataFrame, names: list[str]) -> DataFrame:
    """Long form of several score columns: (query_id, query_group, candidate_id, candidate_group, variant, score); null scores are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("score")) for n in names])).alias("v")
    return scores.select("query_id", "query_group", "candidate_id", "candidate_group", each).select("query_id", "query_group", "candidate_id", "candidate_group", "v.variant", "v.score").where(F.col("score").isNotNull())


def isolated(results: dict[str, Column | DataFrame | Exception]) -> tuple[dict, dict[str, str]]:
    """(results, failures by name): a model that fails leaves the others' results."""
    good = {k: v for k, v in results.items() if not isinstance(v, Exception)}
    return good, {k: str(v) for k, v in results.items() if isinstance(v, Exception)}
