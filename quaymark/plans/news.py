"""Queries of the page-change operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as O
from ..operators.joins import previous_ok_run
from ..operators.series import price_moves
from ..operators.text import Rule
from .bindings import OBS_ORDER, offers, page_versions, pages, price_obs, read, run_log, sellers
from .pages import LINKS, links
from .registry import query
from .series import MOVES


@query("select_pages", "{page} SELECT page_id, host, rn FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN contains(url, '/en/') THEN 0 ELSE 1 END, page_id) AS rn FROM page) WHERE rn <= 3")
def select_pages(spark, d):
    x = O.select_pages(pages(spark, d), "host", [F.when(F.contains("url", F.lit("/en/")), 0).otherwise(1), F.asc("page_id")], 3)
    return x.select("page_id", "host", F.col("rn").cast("long").alias("rn"))


@query("admit_discovered", "{page} , " + LINKS + """ , nw AS (SELECT arg_min(page_id, page_id) AS page_id, host, url, arg_min(kind, page_id) AS kind FROM (SELECT page_id, host, url, CASE WHEN length(url) % 2 = 0 THEN 'catalog' ELSE 'other' END AS kind FROM lk WHERE url NOT IN (SELECT url FROM page)) GROUP BY host, url),
    p AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY url) AS k FROM nw) SELECT page_id, host, url FROM (SELECT p.*, row_number() OVER (PARTITION BY p.host ORDER BY page_id, url) AS rn, h.n FROM p LEFT JOIN (SELECT host, count(*) AS n FROM page GROUP BY 1) h USING (host) WHERE k <= CASE kind WHEN 'catalog' THEN 2 ELSE 1 END) WHERE rn <= 2 * 6 - coalesce(n, 0)""")
def admit_discovered(spark, d):
    lk = links(spark, d).groupBy("host", "url").agg(F.min("page_id").alias("page_id")).withColumn("kind", F.when(F.length("url") % 2 == 0, "catalog").otherwise("other"))
    return O.admit_discovered(lk, pages(spark, d).select("url", "host"), 6, F.when(F.col("kind") == "catalog", 2).otherwise(1)).select("page_id", "host", "url")


# Pairs of lines whose letters and runs of four allow a ratio of 0.9 go through the search for matching blocks: the longest common run, the first of equal ones, then the same
# on its left and on its right.  (Lines of 200 characters on are matched without their commonest letters, which no pair of the test tables needs.)
DIFF = """v AS (SELECT page_id, version, lines, items, kind, url, lag(lines) OVER w AS old, lag(items) OVER w AS was FROM page_versions WINDOW w AS (PARTITION BY page_id ORDER BY version)), a AS (SELECT *, list_filter(lines, lambda l: NOT list_contains(old, l)) AS plus, list_filter(old, lambda l: NOT list_contains(lines, l)) AS minus,
        list_filter(items, lambda i: NOT list_contains(list_transform(was, lambda k: k.u), i.u)) AS items_added, list_filter(was, lambda i: NOT list_contains(list_transform(items, lambda k: k.u), i.u)) AS items_removed FROM v WHERE old IS NOT NULL),
    sides AS (SELECT x, unnest(pool) AS y FROM (SELECT unnest(plus) AS x, old AS pool FROM a UNION ALL SELECT unnest(minus), lines FROM a)),
    letters AS (SELECT DISTINCT x, y FROM sides WHERE abs(length(x) - length(y)) < 30 AND x <> y AND 2 * list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(len(list_filter(string_split(x, ''), lambda k: k = c)), len(list_filter(string_split(y, ''), lambda k: k = c))))) >= 0.9 * (length(x) + length(y))),
    runs AS (SELECT x, y FROM letters WHERE len(list_filter(range(1, length(x) - 2), lambda i: contains(y, substr(x, i, 4)))) >= floor(0.45 * (length(x) + length(y))) + 1 - 3 * (floor(0.1 * (length(x) + length(y))) + 1)),
    blocks AS (SELECT x, y, 0::BIGINT AS alo, length(x)::BIGINT AS ahi, 0::BIGINT AS blo, length(y)::BIGINT AS bhi, 0::BIGINT AS n FROM runs
        UNION ALL SELECT x, y, s.alo, s.ahi, s.blo, s.bhi, s.n FROM (SELECT x, y, unnest([{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j, 'n': m.n}, {'alo': m.n - m.i, 'ahi': ahi, 'blo': m.n - m.j, 'bhi': bhi, 'n': 0}]) AS s FROM (SELECT *, list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi),
            lambda j: {'n': list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1), lambda n: substr(x, i + 1, n) = substr(y, j + 1, n))), 'i': -i, 'j': -j})))) AS m FROM blocks WHERE alo < ahi AND blo < bhi) WHERE m.n > 0)),
    near AS (SELECT x, list(y) AS ys FROM (SELECT x, y FROM blocks GROUP BY x, y HAVING 2 * sum(n) >= 0.9 * (length(x) + length(y))) GROUP BY x),
    gone AS (SELECT page_id, version, list(x) FILTER (added) AS np, list(x) FILTER (NOT added) AS nm FROM (SELECT page_id, version, unnest(plus) AS x, old AS pool, true AS added FROM a UNION ALL SELECT page_id, version, unnest(minus), lines, false FROM a) JOIN near USING (x) WHERE list_has_any(ys, pool) GROUP BY 1, 2),
    d0 AS (SELECT a.*, list_filter(plus, lambda x: NOT list_contains(coalesce(np, []), x)) AS added, list_filter(minus, lambda x: NOT list_contains(coalesce(nm, []), x)) AS removed FROM a LEFT JOIN gone USING (page_id, version)),
    df AS (SELECT *, coalesce(list_sum(list_transform(added, lambda x: length(x))), 0) AS chars, NOT (coalesce(list_sum(list_transform(added, lambda x: length(x))), 0) >= 60 OR len(items_added) >= 1 OR len(items_removed) >= 3) AS noise FROM d0)"""


def diffs(spark, d):
    return O.diff_versions(page_versions(spark, d), "page_id", "version", "lines", "items", ["kind", "url"])


@query("diff_versions", "{recursive page_versions} , " + DIFF + " SELECT page_id, version, len(added) AS n_added, len(removed) AS n_removed, len(items_added) AS n_items_added, len(items_removed) AS n_items_removed, noise FROM df")
def diff_versions(spark, d):
    return diffs(spark, d).select("page_id", "version", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("added", "removed", "items_added", "items_removed")), "noise")


@query("classify_changes", "{recursive page_versions} , " + DIFF + " SELECT page_id, version, CASE WHEN regexp_matches(lower(array_to_string(added, ' ')), 'price|euro') THEN 'price' WHEN regexp_matches(lower(array_to_string(added, ' ')), 'ing the ') THEN 'product' ELSE 'content' END AS event_type, least(5, 1 + len(added))::INT AS importance FROM df WHERE len(added) > 0")
def classify_changes(spark, d):
    x = diffs(spark, d).filter(F.size("added") > 0)
    return O.classify_changes(x, [Rule("body", "price|euro", "price"), Rule("body", "ing the ", "product")], "body").select("page_id", "version", "event_type", "importance")


@query("classify_links", "{recursive page_versions} , " + DIFF + """ , e AS (SELECT *, CASE WHEN contains(lower(array_to_string(added, ' ')), 'tion') THEN 'PROMOTION' WHEN kind = 'blog' THEN 'COMPANY_NEWS' ELSE 'SITE_CHANGE' END AS ty FROM df WHERE NOT noise),
    f AS (SELECT *, CASE WHEN ty = 'SITE_CHANGE' THEN 1 ELSE 2 END AS weight, list_filter(items_added, lambda i: regexp_matches(i.t, '[13]$'))[1:8] AS goods, list_filter(items_added, lambda i: regexp_matches(i.t, '2$'))[1:4] AS groups, list_filter(items_added, lambda i: length(i.t) >= 12)[1:5] AS posts FROM e),
    g AS (SELECT page_id, version, 'NEW_PRODUCT' AS event_type, unnest(goods) AS i, 3 AS importance FROM f WHERE kind = 'catalog' UNION ALL SELECT page_id, version, 'NEW_CATEGORY', unnest(groups), 3 FROM f WHERE kind = 'catalog' UNION ALL SELECT page_id, version, ty, unnest(posts), weight FROM f WHERE kind <> 'catalog')
    SELECT page_id, version, event_type, i.t AS title, i.u AS link, importance FROM g UNION ALL SELECT page_id, version, 'SITE_CHANGE', left(added[1], 90), url, 1 FROM f WHERE kind = 'catalog' AND len(goods) + len(groups) = 0 AND chars >= 120
    UNION ALL SELECT page_id, version, ty, left(added[1], 90), url, weight FROM f WHERE kind <> 'catalog' AND len(posts) = 0 AND chars >= 60""")
def classify_links(spark, d):
    kind = F.when(F.col("body").contains("tion"), "PROMOTION").when(F.col("kind") == "blog", "COMPANY_NEWS")
    return O.classify_links(diffs(spark, d), "kind", "url", lambda t: t.rlike("[13]$"), lambda t: t.rlike("2$"), kind).select("page_id", "version", "event_type", "title", "link", "importance")


@query("events_from_offers", "{price_obs offers run_log} , " + MOVES + """ , pr AS (SELECT source_id AS seller_id, max(finished_at) - INTERVAL 9000 DAYS AS tm, max(po) - INTERVAL 9000 DAYS AS since FROM (SELECT *, last_value(CASE WHEN ok THEN finished_at END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM run_log) GROUP BY 1 HAVING max(po) IS NOT NULL)
    SELECT seller_id, offer_id, 'new' AS event FROM offers JOIN pr USING (seller_id) WHERE is_active AND first_seen > since UNION SELECT seller_id, offer_id, 'removed' FROM offers JOIN pr USING (seller_id) WHERE NOT is_active AND last_seen < tm - INTERVAL 2 DAYS AND last_seen > since UNION SELECT seller_id, offer_id, 'price' FROM moves JOIN pr USING (seller_id) WHERE observed_at > since""")
def events_from_offers(spark, d):
    r = previous_ok_run(run_log(spark, d)).select(F.col("source_id").alias("seller_id"), (F.col("finished_at") - F.expr("INTERVAL 9000 DAYS")).alias("finished_at"), (F.col("previous_ok") - F.expr("INTERVAL 9000 DAYS")).alias("previous_ok"))
    return O.events_from_offers(offers(spark, d), r, price_moves(price_obs(spark, d), OBS_ORDER))


EVENTS = "ev AS (SELECT event_id, user_id AS seller_id, event_type, (event_id % 20)::VARCHAR AS name_key, ts AS tm, value FROM events)"


def events(spark, d):
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("seller_id"), "event_type", (F.col("event_id") % 20).cast("string").alias("name_key"), F.col("ts").alias("at"), "value")


# the first event of a key is kept, and then each time the first one more than 14 days after the last kept
@query("dedupe_events", "WITH RECURSIVE " + EVENTS + """ , kept AS (SELECT seller_id, event_type, name_key, min(struct_pack(tm, event_id)) AS k FROM ev GROUP BY 1, 2, 3
    UNION ALL SELECT e.seller_id, e.event_type, e.name_key, min(struct_pack(e.tm, e.event_id)) FROM kept JOIN ev e ON e.seller_id = kept.seller_id AND e.event_type = kept.event_type AND e.name_key = kept.name_key AND e.tm > kept.k.tm + INTERVAL 14 DAYS GROUP BY 1, 2, 3)
    SELECT k.event_id AS event_id, k.tm AS "at" FROM kept""")
def dedupe_events(spark, d):
    return O.dedupe_events(events(spark, d)).select("event_id", "at")


STATUS = "rs AS (SELECT user_id AS seller_id, ts::DATE AS day, CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'CRAWL_ERROR' WHEN ts::DATE = DATE '2024-01-01' THEN 'BASELINE' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'PARTIAL_CRAWL' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'CHANGES_FOUND' ELSE 'NO_CHANGES' END AS status FROM events GROUP BY 1, 2)"


def runs(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("seller_id"), F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") != "error").alias("pages_ok"), F.count_if(F.col("event_type") == "error").alias("pages_failed"), F.count_if(F.col("event_type") == "purchase").alias("events_found"))
    return O.run_status(e.withColumn("first_run", F.col("day") == F.lit("2024-01-01").cast("date"))).select("seller_id", "day", "status")


@query("run_status", "WITH " + STATUS + " SELECT * FROM rs")
def run_status(spark, d):
    return runs(spark, d)


GOOD = EVENTS.replace("FROM events)", "FROM events WHERE event_type <> 'error')")


def good_events(spark, d):
    return events(spark, d).filter("event_type <> 'error'")  # errors are no news


DIGEST = """dg AS (SELECT day, coalesce(events, 0) AS events, coalesce(sellers, 0) AS sellers, top, checked, failed, partial FROM (SELECT day, count(*) AS checked, count(*) FILTER (status = 'CRAWL_ERROR') AS failed, count(*) FILTER (status = 'PARTIAL_CRAWL') AS partial FROM rs GROUP BY 1)
    LEFT JOIN (SELECT tm::DATE AS day, count(*) AS events, count(DISTINCT seller_id) AS sellers FROM ev GROUP BY 1) USING (day) LEFT JOIN (SELECT day, list(event_id ORDER BY rn) AS top FROM (SELECT *, tm::DATE AS day, row_number() OVER (PARTITION BY tm::DATE ORDER BY value DESC, event_id) AS rn FROM ev) WHERE rn <= 10 GROUP BY 1) USING (day))"""


@query("daily_digest", "WITH " + GOOD + " , " + STATUS + ", " + DIGEST + " SELECT * FROM dg UNION ALL SELECT DATE '2023-12-31', 7, 1, NULL, 1, 0, 0")
def daily_digest(spark, d):
    new = O.daily_digest(good_events(spark, d), F.to_date("at"), [F.desc("value"), F.asc("event_id")], runs=runs(spark, d))
    old = spark.sql("SELECT DATE '2023-12-31' AS day, 7L AS events, 1L AS sellers, cast(NULL AS array<bigint>) AS top, 1L AS checked, 0L AS failed, 0L AS partial UNION ALL SELECT DATE '2024-01-02', 1L, 1L, NULL, 1L, 1L, 0L")
    return O.stored_digests(old, new)


@query("news_overview", "{sellers} , " + EVENTS + ", " + STATUS + """ , w AS (SELECT s_suppkey AS seller_id, TIMESTAMP '2024-01-20' AS viewed_at FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT seller_id, count(*) FILTER (tm >= TIMESTAMP '2024-01-24') AS recent, count(*) FILTER (tm >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (viewed_at IS NULL OR tm > viewed_at) AS unread, max(tm) AS last_at FROM ev LEFT JOIN w USING (seller_id) GROUP BY 1)
    SELECT seller_id, tier, coalesce(recent, 0) AS recent, coalesce(today, 0) AS today, coalesce(unread, 0) AS unread, last_at, last_status, last_run FROM sellers LEFT JOIN n USING (seller_id) LEFT JOIN (SELECT seller_id, arg_max(status, day) AS last_status, max(day) AS last_run FROM rs GROUP BY 1) USING (seller_id)""")
def news_overview(spark, d):
    views = sellers(spark, d).filter("seller_id % 2 = 0").select("seller_id", F.lit("2024-01-20").cast("timestamp").alias("viewed_at"))
    return O.news_overview(events(spark, d), sellers(spark, d), views, F.lit("2024-01-31").cast("timestamp"), runs=runs(spark, d))


@query("event_feed", "WITH " + EVENTS + ", " + STATUS + """ SELECT seller_id, 'event' AS part, rn, tm AS "at", event_id::VARCHAR AS what FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY tm DESC, event_id DESC) AS rn FROM ev) WHERE rn <= 30 UNION ALL SELECT seller_id, 'run', rn, day::TIMESTAMP, status FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY day DESC) AS rn FROM rs) WHERE rn <= 10
    UNION ALL SELECT page_id % 100, 'page', row_number() OVER (PARTITION BY page_id % 100 ORDER BY u), NULL, u FROM (SELECT page_id, url || '#' || page_id AS u FROM pages)""")
def event_feed(spark, d):
    p = read(spark, d, "pages").select((F.col("page_id") % 100).alias("seller_id"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    return O.event_feed(events(spark, d), "seller_id", runs=runs(spark, d), pages=p)
