"""Page versions, their differences, events and digests (section 2.12)."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .lines import without_near
from .text import Rule, first_label


def select_pages(pages: DataFrame, seller: str, order: Sequence[Column], cap: int = 24) -> DataFrame:
    return pages.withColumn("rn", F.row_number().over(Window.partitionBy(seller).orderBy(*order))).filter(F.col("rn") <= cap)


def admit_discovered(links: DataFrame, known: DataFrame, cap: int, per_page: Column, seller: str = "host") -> DataFrame:
    """New links of a seller within its room (twice the cap less what it has) and within a limit for each source page."""
    have = known.groupBy(seller).agg(F.count("*").alias("have"))
    new = links.join(known.select("url"), "url", "left_anti").dropDuplicates(["url"]).join(have, seller, "left")
    new = new.withColumn("on_page", F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("url"))).filter(F.col("on_page") <= per_page)
    return new.withColumn("rn", F.row_number().over(Window.partitionBy(seller).orderBy("page_id", "url"))).filter(F.col("rn") <= 2 * cap - F.coalesce("have", F.lit(0)))


def diff_versions(df: DataFrame, page: str, version: str, lines: str, items: str | None = None, keep: Sequence[str] = (), least: int = 60) -> DataFrame:
    """Lines that a version adds and removes against the one before; small changes are noise.

    An added line counts if no line of the old version, whether it stays or goes, nearly equals it (matching blocks from a ratio of 0.9 on, lengths less than 30 apart), and a
    removed one if no line of the new version does.  ``items`` names the links, array<struct<t, u>> as ``normalise_page`` gives them: those whose url is new or gone come
    out as items_added and items_removed.  A change is real with ``least`` characters of added text, one new link or three gone ones.  Null lines and links count as none.
    """
    ship(df.sparkSession)
    w = Window.partitionBy(page).orderBy(version)
    was = {} if items is None else {"_was": F.lag(items).over(w)}
    x = df.withColumns({"_old": F.lag(lines).over(w), "_nth": F.row_number().over(w)} | was).filter("_nth > 1").drop("_nth")
    texts = F.array().cast("array<string>")
    x = x.withColumn("_now", F.coalesce(F.col(lines), texts)).withColumn("_before", F.coalesce("_old", texts))
    x = x.withColumn("_plus", F.array_except("_now", "_before")).withColumn("_minus", F.array_except("_before", "_now"))
    links = []
    real = F.lit(False)
    if items is not None:
        none = F.array().cast("array<struct<t:string,u:string>>")
        x = x.withColumn("_new", F.coalesce(items, none)).withColumn("_was", F.coalesce("_was", none))
        without = lambda a, b: F.array_distinct(F.filter(a, lambda i: ~F.exists(b, lambda k: k["u"].eqNullSafe(i["u"]))))
        x = x.withColumn("items_added", without("_new", F.col("_was"))).withColumn("items_removed", without("_was", F.col("_new")))
        real, links = (F.size("items_added") >= 1) | (F.size("items_removed") >= 3), ["items_added", "items_removed"]
    own = [page, version, *keep]
    x = x.select(*own, *links, "_plus", "_minus", "_now", "_before")
    schema = T.StructType([*(x.schema[c] for c in [*own, *links]), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("added", "removed"))])
    kept = [*own, *links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda c, b=b: b.column(b.schema.get_field_index(c))
            plus, minus, now, before = (at(c).to_pylist() for c in ("_plus", "_minus", "_now", "_before"))
            near = lambda some, pools: pa.array([without_near([s for s in x if s is not None], [s for s in y if s is not None]) for x, y in zip(some, pools, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*map(at, kept), near(plus, before), near(minus, now)], names=[*kept, "added", "removed"])

    found = x.mapInArrow(run, schema)
    chars = F.aggregate("added", F.lit(0), lambda s, a: s + F.length(a))
    return found.withColumn("noise", ~((chars >= least) | real)).select(*own, "added", "removed", *links, "noise")


def classify_changes(diffs: DataFrame, rules: Sequence[Rule], text: str, most: int = 8) -> DataFrame:
    """Event type by rules over the added text, its first lines and an importance by their number."""
    n = F.size("added")
    x = diffs.withColumn(text, F.array_join("added", " "))
    return x.withColumn("event_type", first_label(rules, F.lit("content"))).withColumn("importance", F.least(F.lit(5), 1 + n)).withColumn("examples", F.slice("added", 1, most))


def classify_links(
    diffs: DataFrame, kind: str, url: str, product: Callable[[Column], Column], category: Callable[[Column], Column], event_type: Column,
    listings: Sequence[str] = ("catalog", "home", "category"), least: int = 60,
) -> DataFrame:
    """Events of each real change by page kind, added links and added text, one row each.

    On listing pages a new link is a product (at most 8) or, if not, a category (at most 4); with neither, twice ``least``
    characters of new text are a change of the site.  On other pages new links with a title of 12 characters (at most 5)
    are publications of ``event_type``, a column over the page kind and ``body``, the added text in lower case; without
    such links ``least`` characters of new text are one event.
    """
    x = diffs.filter("NOT noise").withColumn("body", F.lower(F.array_join("added", " "))).withColumn("_type", F.coalesce(event_type, F.lit("SITE_CHANGE")))
    chars = F.aggregate("added", F.lit(0), lambda s, a: s + F.length(a))
    nothing = F.lit(None).cast("string")

    def event(label: Column, title: Column, link: Column, name: Column, importance: Column) -> Column:
        return F.struct(label.alias("event_type"), title.alias("title"), link.alias("link"), name.alias("product_name"), importance.alias("importance"))

    flag = lambda test: lambda i: F.coalesce(test(i["t"]), F.lit(False))
    is_product, is_category = flag(product), flag(category)
    goods = F.transform(F.slice(F.filter("items_added", is_product), 1, 8), lambda i: event(F.lit("NEW_PRODUCT"), i["t"], i["u"], i["t"], F.lit(3)))
    groups = F.transform(F.slice(F.filter("items_added", lambda i: is_category(i) & ~is_product(i)), 1, 4), lambda i: event(F.lit("NEW_CATEGORY"), i["t"], i["u"], nothing, F.lit(3)))
    weight = F.when(F.col("_type") == "SITE_CHANGE", 1).otherwise(2)
    posts = F.transform(F.slice(F.filter("items_added", lambda i: F.length(i["t"]) >= 12), 1, 5), lambda i: event(F.col("_type"), F.substring(i["t"], 1, 90), i["u"], nothing, weight))
    first = F.substring(F.get("added", F.lit(0)), 1, 90)
    by_text = lambda label, n, enough: F.when(enough, F.array(event(label, first, F.col(url), nothing, n)))
    listed = F.concat(goods, groups)
    found = F.when(F.col(kind).isin(*listings), F.when(F.size(listed) > 0, listed).otherwise(by_text(F.lit("SITE_CHANGE"), F.lit(1), chars >= 2 * least))).otherwise(
        F.when(F.size(posts) > 0, posts).otherwise(by_text(F.col("_type"), weight, chars >= least)))
    return x.withColumn("_e", F.explode(found)).select(*diffs.columns, "_e.*")


def events_from_offers(offers: DataFrame, runs: DataFrame, moves: DataFrame, days: int = 2) -> DataFrame:
    """New, removed and price events since each seller's previous successful run; nothing at its first."""
    last = runs.groupBy("seller_id").agg(F.max("finished_at").alias("at"), F.max("previous_ok").alias("since")).filter("since IS NOT NULL")
    o = offers.join(last, "seller_id")
    new = o.filter(F.col("is_active") & (F.col("first_seen") > F.col("since"))).select("seller_id", "offer_id", F.lit("new").alias("event"))
    gone = o.filter(~F.col("is_active") & (F.col("last_seen") < F.col("at") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("last_seen") > F.col("since"))).select("seller_id", "offer_id", F.lit("removed").alias("event"))
    price = moves.join(last, "seller_id").filter(F.col("observed_at") > F.col("since")).select("seller_id", "offer_id", F.lit("price").alias("event"))
    return new.unionByName(gone).unionByName(price).distinct()


class KeptKeys:
    """Name keys of kept events of the last days, by what they hold: finds a key that equals, holds or is held by another in time linear in its length."""

    def __init__(self, span: int, least: int):
        self.span, self.least = span, least
        self.at: OrderedDict[str, int] = OrderedDict()  # the oldest first
        self.by_first: dict[str, set[str]] = {}  # keys by their first ``least`` characters, or whole if shorter
        self.by_gram: dict[str, set[str]] = {}  # keys by each run of ``least`` characters

    def grams(self, key: str) -> set[str]:
        return {key[i : i + self.least] for i in range(len(key) - self.least + 1)}

    def forget(self, now: int) -> None:
        while self.at and now - next(iter(self.at.values())) > self.span:
            key, _ = self.at.popitem(last=False)
            self.by_first[key[: self.least]].discard(key)
            for g in self.grams(key):
                self.by_gram[g].discard(key)
                if not self.by_gram[g]:
                    del self.by_gram[g]
            if not self.by_first[key[: self.least]]:
                del self.by_first[key[: self.least]]

    def keep(self, key: str, now: int) -> None:
        self.at[key] = now
        self.by_first.setdefault(key[: self.least], set()).add(key)
        for g in self.grams(key):
            self.by_gram.setdefault(g, set()).add(key)

    def repeats(self, key: str) -> bool:
        if key in self.at:
            return True
        if len(key) < self.least:
            return False
        holding = min((self.by_gram.get(g, ()) for g in self.grams(key)), key=len)  # whoever holds the key holds all its runs
        if any(key in k for k in holding):
            return True
        starts = (key[i : i + n] for n in range(1, self.least + 1) for i in range(len(key) - n + 1))
        return any(key.find(k) >= 0 for s in starts for k in self.by_first.get(s, ()))


def quiet_cuts(events: DataFrame, who: Sequence[str], days: int) -> DataFrame:
    """(who, day, segment): the days on which there are events, cut where none follows for over ``days`` days.

    A segment holds no event that may repeat one of another.  Only the days of a group are sorted, not its events.
    """
    w = Window.partitionBy(*who).orderBy("_day")
    seen = events.select(*who, "_day").distinct()
    fresh = (F.datediff("_day", F.lag("_day").over(w)) > days + 1).cast("long")
    return seen.withColumn("_fresh", fresh).select(*who, "_day", F.coalesce(F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("_segment"))


def dedupe_events(events: DataFrame, days: int = 14, least: int = 8) -> DataFrame:
    """Events without those that repeat a kept one of the same seller and type within some days.

    An event repeats a kept one with an equal name key, or, where its own key has ``least`` characters, with a key that
    holds or is held by its own.  Events of a (seller, type) are cut where over ``days`` days have none; each segment is read once in time
    order, with an index over the keys of the last days.  Events without a seller, type, name key or time are kept and not compared.
    """
    ship(events.sparkSession)
    who, span, columns = ["seller_id", "event_type"], days * 86_400_000_000, events.columns
    x = events.withColumn("_us", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("_day", F.to_date("at"))
    able = F.col("seller_id").isNotNull() & F.col("event_type").isNotNull() & F.col("_us").isNotNull() & (F.coalesce(F.length("name_key"), F.lit(0)) > 0)
    compared, free = x.filter(able), x.filter(~able).select(columns)
    cut = compared.join(quiet_cuts(compared, who, days), [*who, "_day"])
    cut = cut.repartition(*who, "_segment").sortWithinPartitions(*who, "_segment", "_us", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, kept = None, None
        for b in batches:
            keep = []
            for *now_in, key, at in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (*who, "_segment", "name_key", "_us")), strict=True):
                if now_in != segment:
                    segment, kept = now_in, KeptKeys(span, least)
                kept.forget(at)
                keep.append(not kept.repeats(key))
                if keep[-1]:
                    kept.keep(key, at)
            yield b.filter(pa.array(keep, pa.bool_())).select(columns)

    return cut.mapInArrow(run, events.schema).unionByName(free)


def run_status(runs: DataFrame) -> DataFrame:
    ok, failed, events = F.col("pages_ok"), F.col("pages_failed"), F.col("events_found")
    return runs.withColumn("status", F.when(ok == 0, "CRAWL_ERROR").when(F.col("first_run"), "BASELINE").when(failed > 0, "PARTIAL_CRAWL").when(events > 0, "CHANGES_FOUND").otherwise("NO_CHANGES"))


def daily_digest(events: DataFrame, day: Column, order: Sequence[Column], top: int = 10, runs: DataFrame | None = None) -> DataFrame:
    """For each day the number of events and sources and its most important events.

    ``runs`` (day, seller_id, status) adds how many sources were checked, failed and were read in part, also on days without events.
    """
    x = events.withColumn("day", day)
    w = Window.partitionBy("day").orderBy(*order)
    t = x.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda s: s["event_id"]).alias("top"))
    out = x.groupBy("day").agg(F.count("*").alias("events"), F.countDistinct("seller_id").alias("sellers")).join(t, "day")
    if runs is None:
        return out
    of = lambda status, name: F.count_distinct(F.when(F.col("status") == status, F.col("seller_id"))).alias(name)
    checked = runs.groupBy("day").agg(F.count_distinct("seller_id").alias("checked"), of("CRAWL_ERROR", "failed"), of("PARTIAL_CRAWL", "partial"))
    return out.join(checked, "day", "full_outer").na.fill(0, ["events", "sellers", "checked", "failed", "partial"])


def stored_digests(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Digests by day, a new one in place of the stored one of its day."""
    return stored.join(new.select("day"), "day", "left_anti").unionByName(new)


def news_overview(events: DataFrame, sellers: DataFrame, views: DataFrame, as_of: Column, days: int = 7, runs: DataFrame | None = None) -> DataFrame:
    """For each seller: events in some days, in the last day, and not seen since the last view; with ``runs`` the last one's status and time."""
    e = events.join(views, "seller_id", "left")
    n = e.groupBy("seller_id").agg(
        F.count_if(F.col("at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).alias("recent"), F.count_if(F.col("at") >= as_of - F.expr("INTERVAL 1 DAY")).alias("today"),
        F.count_if(F.col("viewed_at").isNull() | (F.col("at") > F.col("viewed_at"))).alias("unread"), F.max("at").alias("last_at"))
    out = sellers.select("seller_id", "tier").join(n, "seller_id", "left").na.fill(0, ["recent", "today", "unread"])
    if runs is None:
        return out
    last = runs.groupBy("seller_id").agg(F.max(F.struct("day", "status")).alias("r")).select("seller_id", F.col("r.status").alias("last_status"), F.col("r.day").alias("last_run"))
    return out.join(last, "seller_id", "left")


def event_feed(events: DataFrame, seller: str, most: int = 30, runs: DataFrame | None = None, pages: DataFrame | None = None, most_runs: int = 10) -> DataFrame:
    """The newest events of each seller; with ``runs`` and ``pages`` one long table (seller, part, rn, at, what) that also has its last runs and its pages."""
    feed = events.withColumn("rn", F.row_number().over(Window.partitionBy(seller).orderBy(F.desc("at"), F.desc("event_id")))).filter(F.col("rn") <= most)
    if runs is None and pages is None:
        return feed
    part = lambda df, name, at, what: df.select(seller, F.lit(name).alias("part"), F.col("rn").cast("long").alias("rn"), at.cast("timestamp").alias("at"), what.cast("string").alias("what"))
    out = part(feed, "event", F.col("at"), F.col("event_id"))
    if runs is not None:
        r = runs.withColumn("rn", F.row_number().over(Window.partitionBy(seller).orderBy(F.desc("day")))).filter(F.col("rn") <= most_runs)
        out = out.unionByName(part(r, "run", F.col("day"), F.col("status")))
    if pages is not None:
        p = pages.withColumn("rn", F.row_number().over(Window.partitionBy(seller).orderBy("url")))
        out = out.unionByName(part(p, "page", F.lit(None), F.col("url")))
    return out
