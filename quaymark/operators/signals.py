"""Findings over prices, offers, demand and sources, and what feedback says about them (section 2.10, S)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import market, multi_seller_models
from .joins import comparables
from .series import price_moves, recent_vs_previous, trailing_zscore


def price_change_signals(obs: DataFrame, order: Sequence[str], matched: DataFrame, as_of: Column, days: int, baseline: Column, least: float = 0.03) -> DataFrame:
    """Recent price moves after the baseline: high from 15 % on for matched offers, medium from 7 % on, else low."""
    m = price_moves(obs, order, least_change=least).filter((F.col(order[0]) > baseline) & (F.col(order[0]) >= as_of - F.make_dt_interval(F.lit(days))))
    hit = matched.select("offer_id").distinct().withColumn("matched", F.lit(True))
    size = F.abs("change")
    sev = F.when((size >= 0.15) & F.coalesce("matched", F.lit(False)), "high").when(size >= 0.07, "medium").otherwise("low")
    return m.join(hit, "offer_id", "left").withColumn("severity", sev)


def appearance_signals(offers: DataFrame, kit: Column) -> DataFrame:
    """Findings for new offers, new kits and gone offers; offers carry ``state`` from the baseline operator."""
    kind = F.when(F.col("state") == "gone", "disappeared").when(F.col("state") == "new", F.when(kit, "new_kit").otherwise("new_offer"))
    return offers.withColumn("finding_type", kind).filter("finding_type IS NOT NULL")


def new_seller_signals(sellers: DataFrame, created: str, baseline: Column) -> DataFrame:
    return sellers.filter(F.col(created) > baseline).withColumn("finding_type", F.lit("new_seller"))


def market_price_signals(items: DataFrame, offers: DataFrame, matches: DataFrame, sellers: DataFrame, least: int = 3, least_sellers: int = 2, gap: float = 0.10, high: float = 0.20) -> DataFrame:
    """Items whose price is off the median of firm comparables; confidence grows with their number."""
    c = comparables(offers, matches, sellers, 0.7)
    m = market(c, "item_id").join(c.groupBy("item_id").agg(F.avg("confidence").alias("avg_confidence")), "item_id")
    x = items.join(m.filter((F.col("n") >= least) & (F.col("sellers") >= least_sellers)), "item_id").withColumn("gap", F.col("price") / F.col("median") - 1)
    x = x.filter(F.abs("gap") >= gap).withColumn("severity", F.when(F.abs("gap") >= high, "high").otherwise("medium"))
    return x.withColumn("finding_type", F.when(F.col("gap") > 0, "above_market").otherwise("below_market")).withColumn(
        "confidence", F.least(F.col("avg_confidence") + 0.15, 0.45 + 0.05 * F.col("n"), F.lit(0.95)))


def demand_signals(demand: DataFrame, at: str, change: float = 0.25, least_mean: float = 5, width: int = 4, z: dict | None = None) -> DataFrame:
    """Demand that moved between two windows, and points far above what came before."""
    r = recent_vs_previous(demand, ["term", "category"], at, width=width)
    moved = r.filter((F.abs("change") >= change) & (F.least("recent", "previous") >= least_mean)).select(
        "term", "category", F.when(F.col("change") > 0, "growth").otherwise("decline").alias("finding_type"), F.when(F.abs("change") >= 0.5, "medium").otherwise("low").alias("severity"), F.col("change").alias("size"))
    last = Window.partitionBy("term")
    odd = trailing_zscore(demand, ["term"], at, **(z or {})).withColumn("_last", F.max(at).over(last)).filter(F.col(at) == F.col("_last")).select(
        "term", "category", F.lit("anomaly").alias("finding_type"), F.lit("medium").alias("severity"), F.col("z").alias("size"))
    return moved.unionByName(odd)


def category_growth(demand: DataFrame, at: str, own: DataFrame, least_terms: int = 3, change: float = 0.25, width: int = 4) -> DataFrame:
    """Categories whose median term grew, and whether they are own ones."""
    g = recent_vs_previous(demand, ["term", "category"], at, width=width).groupBy("category").agg(F.median("change").alias("change"), F.count("*").alias("terms"))
    g = g.filter((F.col("terms") >= least_terms) & (F.col("change") >= change))
    return g.join(own.select("category").distinct().withColumn("_own", F.lit(True)), "category", "left").withColumn("kind", F.when(F.col("_own"), "existing").otherwise("gap")).drop("_own")


def source_error_signals(runs: DataFrame, least: int = 2) -> DataFrame:
    """Sources whose last runs failed in a row, and those that recovered (to be closed)."""
    w = Window.partitionBy("source_id").orderBy("finished_at", "run_id")
    x = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    n = x.groupBy("source_id", "island").agg(F.count_if(~F.col("ok")).alias("streak"))
    last = n.groupBy("source_id").agg(F.max_by("streak", "island").alias("current"), F.max("streak").alias("longest"))
    return last.withColumn("verdict", F.when(F.col("current") >= least, "open").when(F.col("longest") >= least, "close")).filter("verdict IS NOT NULL")


def smoothed_rate(confirmed: Column, n: Column) -> Column:
    return (confirmed + 1) / (n + 2)


def calibration_factor(confirmed: Column, n: Column) -> Column:
    return 0.6 + 0.55 * smoothed_rate(confirmed, n)


def calibrate(findings: DataFrame, decisions: DataFrame, least: int = 3) -> DataFrame:
    """Confidence times what earlier decisions say: by type and category (null-safe) where there are enough, else by type."""
    one = decisions.groupBy("finding_type", "category").agg(F.count("*").alias("n"), F.sum("decision").alias("c")).filter(F.col("n") >= least).select(
        F.col("finding_type").alias("_t"), F.col("category").alias("_c"), calibration_factor(F.col("c"), F.col("n")).alias("fine"))
    two = decisions.groupBy("finding_type").agg(F.count("*").alias("n"), F.sum("decision").alias("c")).filter(F.col("n") >= least).select("finding_type", calibration_factor(F.col("c"), F.col("n")).alias("coarse"))
    x = findings.join(one, (F.col("finding_type") == F.col("_t")) & F.col("category").eqNullSafe(F.col("_c")), "left").drop("_t", "_c").join(two, "finding_type", "left")
    f = F.coalesce("fine", "coarse", F.lit(1.0))
    return x.withColumn("calibrated", F.least(F.greatest(F.col("confidence") * f, F.lit(0.2)), F.lit(0.98))).drop("fine", "coarse")


def feedback_stats(decisions: DataFrame) -> DataFrame:
    """Smoothed confirmation rate by type and by type and category."""
    return decisions.groupingSets([[F.col("finding_type")], [F.col("finding_type"), F.col("category")]], "finding_type", "category").agg(
        F.count("*").alias("n"), F.sum("decision").alias("confirmed"), F.bround(smoothed_rate(F.sum("decision"), F.count("*")), 6).alias("rate"))


def propagate_feedback(decisions: DataFrame, evidence: str, matches: DataFrame) -> DataFrame:
    """Decisions on actions fan out to the findings behind them, the last one counts; their matches are confirmed or flagged."""
    f = decisions.select(F.explode(evidence).alias("finding_id"), "decision", "at")
    last = f.groupBy("finding_id").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    return matches.join(last, "finding_id").select("offer_id", "finding_id", "decision", F.when(F.col("decision") == 1, "confirmed").otherwise("flagged").alias("review"))


def multi_seller_signals(offers: DataFrame, sellers: DataFrame, own: DataFrame, reasons: DataFrame, least: int = 2) -> DataFrame:
    """Models of several sellers for which at least one reason speaks."""
    return multi_seller_models(offers, sellers, own, least).join(reasons.filter(F.size("reasons") > 0), ["brand", "model_key"])
