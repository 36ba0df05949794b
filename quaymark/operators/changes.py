"""Change tracking: keyed upserts, change-only history, disappearance, streaks (section 2.9).

Plain Parquet has no MERGE, so an upsert is a full outer join on the key whose result is written to a new place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_keyed(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (), keep_old: Sequence[str] = ()) -> DataFrame:
    """New rows over old ones by key, the last new row of a key (by ``order``) winning; ``keep_old`` columns only fill gaps.

    Adds ``action``: inserted, updated (a value changed), unchanged or kept (no new row).
    """
    if order:
        w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
        new = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*(F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in values)).alias("_n"))
    x = o.join(n, list(keys), "full_outer")
    merged = {c: F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).otherwise(F.coalesce(f"_o.{c}", f"_n.{c}") if c in keep_old else F.coalesce(f"_n.{c}", f"_o.{c}")) for c in values}
    same = reduce(lambda a, b: a & b, [merged[c].eqNullSafe(F.col(f"_o.{c}")) for c in values])
    action = F.when(F.col("_n").isNull(), "kept").when(F.col("_o").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return x.select(*keys, *(merged[c].alias(c) for c in values), action.alias("action"))


def upsert_offers(old: DataFrame, new: DataFrame, keys: Sequence[str], seen_at: str, url: str | None = None, shortest: int = 8, longer: int = 25) -> DataFrame:
    """Current offers after a run: new facts over old, first sight kept, ``changed`` where price, availability, activity or content moved.

    A stored offer meets the new row of its keys.  With ``url``, one that meets none takes the new row of its seller and url that met
    none either (the first of each side by name); its name stays if the new one is under ``shortest`` characters or much shorter.
    Content is the column ``content_hash``, where both sides have it.
    """
    hashed = "content_hash" in old.columns and "content_hash" in new.columns
    facts = ["price", "availability", *(["content_hash"] if hashed else [])]
    n = new.select(*keys, F.col("name").alias("n_name"), *(F.col(c).alias(f"n_{c}") for c in facts), F.col(seen_at).alias("n_seen"))
    at = ["seller_id", url]
    other = [k for k in keys if k not in at]
    if url and other:
        alone = lambda a, b, name: a.join(b.select(*keys), list(keys), "left_anti").groupBy(*at).agg(F.min(F.struct(*other)).alias(name))
        pair = alone(old, new, "_old").join(alone(new, old, "_new"), at).select(*at, *(F.col(f"_new.{k}").alias(k) for k in other), "_old")
        n = n.join(pair, [*at, *other], "left").withColumns({k: F.coalesce(f"_old.{k}", k) for k in other}).drop("_old")
    x = old.join(n, list(keys), "full_outer")
    met = F.col("n_seen").isNotNull()
    moved_fact = lambda c: ~F.col(c).eqNullSafe(F.coalesce(f"n_{c}", c))
    changed = met & (F.col("last_seen").isNull() | moved_fact("price") | moved_fact("availability") | (moved_fact("content_hash") if hashed else F.lit(False)) | ~F.coalesce("is_active", F.lit(False)))
    if "name" in keys:
        worse = (F.length("n_name") < shortest) | (F.length("name") > F.length("n_name") + longer)
        named = [F.when(F.col("last_seen").isNotNull() & F.col("n_name").isNotNull() & ~worse, F.col("n_name")).otherwise(F.col("name")).alias("name")]
    else:
        named = [F.coalesce("name", "n_name").alias("name")]
    merged = [F.coalesce(f"n_{c}", c).alias(c) for c in ("price", "availability", *(["content_hash"] if hashed else []))]
    return x.select(
        *(k for k in keys if k != "name"), *named, *merged,
        F.coalesce("first_seen", "n_seen").alias("first_seen"), F.coalesce("n_seen", "last_seen").alias("last_seen"), (met | F.coalesce("is_active", F.lit(False))).alias("is_active"), changed.alias("changed"))


def price_history(obs: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Observations whose price or availability differs from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return obs.withColumn("_p", F.lag("price").over(w)).withColumn("_a", F.lag("availability").over(w)).withColumn("_rn", F.row_number().over(w)).filter(
        (F.col("_rn") == 1) | ~F.col("_p").eqNullSafe(F.col("price")) | ~F.col("_a").eqNullSafe(F.col("availability"))).drop("_p", "_a", "_rn")


def append_if_changed(history: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The new observations that differ from the newest stored one of their key."""
    last = history.groupBy(key).agg(F.max_by(F.struct("price", "availability"), at).alias("_last"))
    return new.join(last, key, "left").filter(F.col("_last").isNull() | ~F.col("_last.price").eqNullSafe(F.col("price")) | ~F.col("_last.availability").eqNullSafe(F.col("availability"))).drop("_last")


def gone_from_sitemap(items: DataFrame, listed: DataFrame, failed: DataFrame, run_start: Column, seen: int, least_seen: int = 10) -> DataFrame:
    """Items with ``is_active`` after a run over a site's map.

    An item that the run did not fetch, and whose page (its url without a fragment) is neither listed nor among those that
    failed to open, is gone; one whose page failed stays or comes back.  A run of at most ``least_seen`` pages decides nothing.
    """
    x = items.withColumn("_page", F.substring_index("url", "#", 1))
    has = lambda df, name: df.select(F.col("url").alias("_page")).distinct().withColumn(name, F.lit(True))
    x = x.join(has(listed, "_listed"), "_page", "left").join(has(failed, "_failed"), "_page", "left")
    old = F.col("fetched_at").isNull() | (F.col("fetched_at") < run_start)
    gone = old & F.col("_listed").isNull() & F.col("_failed").isNull() & F.lit(seen > least_seen)
    active = F.when(F.col("_failed").isNotNull() & F.lit(seen > least_seen), True).when(gone, False).otherwise(F.col("is_active"))
    return x.withColumn("is_active", active).drop("_page", "_listed", "_failed")


def expand_variants(df: DataFrame, variants: str, key: str) -> DataFrame:
    """Items and, as items of their own, the variants embedded in them."""
    own = df.drop(variants).withColumn("parent", F.lit(None).cast(df.schema[key].dataType))
    v = df.select(F.col(key).alias("parent"), F.explode(variants).alias("v"), *(c for c in df.columns if c not in (key, variants, "name", "price")))
    return own.unionByName(v.withColumns({key: F.col("v.id"), "name": F.col("v.name"), "price": F.col("v.price")}).drop("v").select(own.columns))


def mark_disappeared(offers: DataFrame, seen: DataFrame, checks: DataFrame, as_of: Column, days: int = 2, least_seen: int = 10) -> DataFrame:
    """Active offers that a successful check of their seller did not show for some days; sellers with few sights are left alone."""
    c = checks.filter("ok").groupBy("seller_id").agg(F.max("seen_count").alias("seen_count"))
    x = offers.join(seen.select("offer_id").distinct().withColumn("_seen", F.lit(True)), "offer_id", "left").join(c, "seller_id", "left")
    gone = F.col("is_active") & F.col("_seen").isNull() & (F.col("seen_count") > least_seen) & (F.col("last_seen") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return x.withColumn("disappeared", F.coalesce(gone, F.lit(False))).drop("_seen", "seen_count")


def appeared_since_baseline(offers: DataFrame) -> DataFrame:
    """state: new for active offers first seen after their seller's first collection day, gone for inactive ones, else ok."""
    base = F.min(F.to_date("first_seen")).over(Window.partitionBy("seller_id"))
    return offers.withColumn("baseline", base).withColumn("state", F.when(~F.col("is_active"), "gone").when(F.to_date("first_seen") > F.col("baseline"), "new").otherwise("ok"))


def emit_findings(stored: DataFrame, emitted: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Stored findings after a run: unknown keys come in as new, those still new are refreshed, all others stay as they are."""
    facts = [c for c in emitted.columns if c != key]
    w = Window.partitionBy(key).orderBy(*facts)
    e = emitted.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(key, F.struct(*facts).alias("_e"))
    x = stored.join(e, key, "full_outer")
    fresh = F.col("_e").isNotNull() & (F.col("status").isNull() | (F.col("status") == "new"))
    return x.select(key, *(F.when(fresh, F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) for c in facts), F.coalesce("status", F.lit("new")).alias("status"), (F.col("_e").isNotNull() & F.col("status").isNull()).alias("inserted"))


def auto_close(stored: DataFrame, emitted: DataFrame, types: Sequence[str], retired: Sequence[str] = (), key: str = "dedupe_key") -> DataFrame:
    """Open findings of the given types whose key was not emitted, and all of retired types, become done with a comment."""
    seen = emitted.select(key).distinct().withColumn("_seen", F.lit(True))
    x = stored.join(seen, key, "left")
    lost = (F.col("status") == "new") & F.col("finding_type").isin(*types) & F.col("_seen").isNull()
    old = (F.col("status") == "new") & (F.col("finding_type").isin(*retired) if retired else F.lit(False))
    return x.withColumn("comment", F.when(old, "type retired").when(lost, "no longer found")).withColumn("status", F.when(lost | old, "done").otherwise(F.col("status"))).drop("_seen")


def refresh_matches(old: DataFrame, new: DataFrame, review_types: Sequence[str] = ("exact", "identical", "direct", "kit"), sure: float = 0.7) -> DataFrame:
    """Matches after a new run: stale rule pairs go, reviewed pairs stay, a confirmed pair only rises to identical."""
    o = old.select("offer_id", "item_id", F.col("confidence").alias("oc"), F.col("match_type").alias("ot"), "review")
    x = o.join(new.select("offer_id", "item_id", "confidence", "match_type"), ["offer_id", "item_id"], "full_outer")
    human = F.coalesce(F.col("review").isin("confirmed", "rejected"), F.lit(False))
    x = x.filter(human | F.col("confidence").isNotNull())
    kind = F.when(F.col("review") == "confirmed", F.when(F.col("match_type") == "identical", "identical").otherwise(F.col("ot"))).when(human, F.col("ot")).otherwise(F.col("match_type"))
    conf = F.when(human, F.col("oc")).otherwise(F.col("confidence"))
    return x.select("offer_id", "item_id", conf.alias("confidence"), kind.alias("match_type"), "review", (~human & (conf < sure) & kind.isin(*review_types)).alias("needs_review"))


def version_pages(versions: DataFrame, page: str, at: str, digest: str) -> DataFrame:
    """Versions whose digest differs from the one before; the first of a page is its baseline."""
    w = Window.partitionBy(page).orderBy(at)
    x = versions.withColumn("_before", F.lag(digest).over(w)).withColumn("_rn", F.row_number().over(w))
    return x.filter((F.col("_rn") == 1) | (F.col("_before") != F.col(digest))).withColumn("baseline", F.col("_rn") == 1).drop("_before", "_rn")


def failure_streaks(runs: DataFrame, disable_at: int = 4) -> DataFrame:
    """Length of every run of failures, the current streak and whether it ever reached the limit."""
    w = Window.partitionBy("source_id").orderBy("finished_at", "run_id")
    x = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    bad = x.groupBy("source_id", "island").agg(F.count_if(~F.col("ok")).alias("streak"))
    return bad.groupBy("source_id").agg(F.max("streak").alias("longest"), F.max_by("streak", "island").alias("current")).withColumn("disabled", F.col("longest") >= disable_at)


def error_report(errors: DataFrame, since: Column) -> DataFrame:
    """Recent errors for each url: how many, and the newest message."""
    return errors.filter(F.col("at") >= since).groupBy("url").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), F.max_by("message", F.struct("at", "error_id")).alias("message"))


def replace_keep_manual(stored: DataFrame, scanned: DataFrame, site: str) -> DataFrame:
    """All rows of the scanned sites are replaced, but those entered by hand."""
    sites = scanned.select(site).distinct()
    kept = stored.filter("manual").unionByName(stored.filter(~F.col("manual")).join(sites, site, "left_anti").select(stored.columns))
    return kept.unionByName(scanned.withColumn("manual", F.lit(False)).select(stored.columns))


def stale_sources(runs: DataFrame, as_of: Column, hours: int = 26) -> DataFrame:
    last = runs.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ok"))
    return last.withColumn("stale", F.coalesce(F.col("last_ok") < as_of - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True)))
