"""Manual review of ambiguous matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfline.session import reliable_checkpoint


def pending_reviews(products: DataFrame, offers: DataFrame, limit: int | None = 20) -> DataFrame:
    """Review offers whose candidate product still exists, newest first."""
    waiting = offers.filter((F.col("match_level") == "review") & F.col("match_candidate_key").isNotNull()
                            & F.col("match_score").isNotNull() & F.col("match_reason").isNotNull())
    own = products.select("product_key", F.col("title").alias("product_title"))
    other = products.select(F.col("product_key").alias("match_candidate_key"), F.col("title").alias("candidate_title"))
    rows = waiting.join(own, "product_key").join(other, "match_candidate_key").select(
        "product_key", "product_title", F.col("match_candidate_key").alias("candidate_key"), "candidate_title", "source",
        "external_id", F.col("title").alias("incoming_title"), "match_score", "match_reason",
        F.col("updated_at").alias("created_at"), "position")
    ordered = rows.orderBy(F.desc("created_at"), "position")
    return ordered if limit is None else ordered.limit(max(limit, 0))


def check_decisions(decisions: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Decisions with ``error``: same, unknown_product, unknown_candidate, not_pending or NULL."""
    known = products.select("product_key", F.lit(True).alias("_p"))
    candidates = products.select(F.col("product_key").alias("candidate_key"), F.lit(True).alias("_c"))
    pending = (offers.filter("match_level = 'review'").select("product_key", F.col("match_candidate_key").alias("candidate_key"),
                                                             F.lit(True).alias("_r")).distinct())
    joined = (decisions.join(known, "product_key", "left").join(candidates, "candidate_key", "left")
              .join(pending, ["product_key", "candidate_key"], "left"))
    error = (F.when(F.col("product_key") == F.col("candidate_key"), "same").when(F.col("_p").isNull(), "unknown_product")
             .when(F.col("_c").isNull(), "unknown_candidate").when(F.col("_r").isNull(), "not_pending"))
    return joined.withColumn("error", error).drop("_p", "_c", "_r")


def resolve_targets(moves: DataFrame) -> DataFrame:
    """Follow chains of moves to their last product by doubling the step each round.

    A chain of n moves ends after the logarithm of n rounds; what still moves then is a cycle.
    """
    current = reliable_checkpoint(moves.select("product_key", "candidate_key"))
    for _ in range(current.count().bit_length() + 1):
        step = current.select(F.col("product_key").alias("candidate_key"), F.col("candidate_key").alias("_next"))
        jumped = current.join(step, "candidate_key", "left").select(
            "product_key", F.coalesce("_next", "candidate_key").alias("candidate_key"), F.col("_next").isNotNull().alias("_moved"))
        jumped = reliable_checkpoint(jumped)
        current = jumped.drop("_moved")
        if jumped.filter("_moved").isEmpty():
            return current
    raise ValueError("review decisions form a cycle")


def effective_moves(decisions: DataFrame) -> DataFrame:
    """Decisions that still find both products when their turn comes.

    A decision fails if an earlier effective one already moved its product or its candidate. Each round
    recomputes all of them from the previous answer; the order by position makes the fixed point unique, and
    every round settles at least the earliest open position, so the rounds end.
    """
    decisions = reliable_checkpoint(decisions.select("product_key", "candidate_key", "position"))
    gone = decisions.groupBy("product_key").agg(F.min("position").alias("_at"))
    while True:
        own = gone.withColumnRenamed("_at", "_own")
        other = gone.select(F.col("product_key").alias("candidate_key"), F.col("_at").alias("_other"))
        effective = (decisions.join(own, "product_key", "left").join(other, "candidate_key", "left")
                     .filter(F.coalesce(F.col("_own") >= F.col("position"), F.lit(True))
                             & F.coalesce(F.col("_other") > F.col("position"), F.lit(True))))
        after = reliable_checkpoint(effective.groupBy("product_key").agg(F.min("position").alias("_at")))
        changed = gone.exceptAll(after).unionByName(after.exceptAll(gone))
        stable = changed.isEmpty()
        gone = after
        if stable:
            return decisions.join(gone, (decisions["product_key"] == gone["product_key"])
                                  & (decisions["position"] == gone["_at"]), "left_semi")


def accept_reviews(products: DataFrame, offers: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and offers after accepted reviews: offers move to the candidate, the product goes.

    ``decisions(product_key, candidate_key, position)`` are applied in order; a product is moved once, and
    a later decision about the candidate carries its offers further.
    """
    moves = effective_moves(check_decisions(decisions, products, offers).filter("error IS NULL"))
    target = resolve_targets(moves).withColumnRenamed("candidate_key", "_target")
    moved = F.col("_target").isNotNull()
    after = offers.join(target, "product_key", "left").select(*[
        (F.when(moved, F.col("_target")).otherwise(F.col("product_key")).alias(c) if c == "product_key" else
         F.when(moved, "probable").otherwise(F.col(c)).alias(c) if c == "match_level" else
         F.when(moved, "manual_approval").otherwise(F.col(c)).alias(c) if c == "match_reason" else
         F.when(moved, F.col("_target")).otherwise(F.col(c)).alias(c) if c == "match_candidate_key" else F.col(c))
        for c in offers.columns])
    return products.join(target, "product_key", "left_anti"), after


def reject_reviews(offers: DataFrame, products: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending offers of rejected pairs are marked; products stay apart."""
    valid = (check_decisions(decisions, products, offers).filter("error IS NULL OR error = 'same'")
             .select("product_key", F.col("candidate_key").alias("match_candidate_key"), F.lit(True).alias("_no")).distinct())
    hit = F.coalesce("_no", F.lit(False)) & (F.col("match_level") == "review")
    joined = offers.join(valid, ["product_key", "match_candidate_key"], "left")
    return joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).select(*[
        (F.when(F.col("_hit"), "rejected").otherwise(F.col(c)).alias(c) if c == "match_level" else
         F.when(F.col("_hit"), "manual_rejection").otherwise(F.col(c)).alias(c) if c == "match_reason" else F.col(c))
        for c in offers.columns])
