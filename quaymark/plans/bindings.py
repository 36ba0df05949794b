"""The market tables as views over the test data, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own items: id, site, name, brand, category, kind, capacity, price, model_key."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.substring_index("p_name", " ", -1).alias("kind"), F.col("p_size").alias("capacity"),
        (F.col("p_retailprice") * (1 + ((F.col("p_partkey") % 31) - 18) / F.lit(100.0))).alias("price"),
        F.concat(F.substring("p_brand", 7, 10), F.lit("-"), F.col("p_size").cast("string")).alias("model_key"),
    )


CATALOG = """catalog AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, p_type AS category, split_part(p_name, ' ', -1) AS kind, p_size AS capacity,
    p_retailprice * (1 + ((p_partkey % 31) - 18) / 100.0::DOUBLE) AS price, substr(p_brand, 7, 10) || '-' || p_size AS model_key FROM part)"""


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller"), F.concat(F.lit("G"), F.col("s_nationkey").cast("string")).alias("seller_group"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("tier"),
        F.col("s_acctbal").alias("balance"),
    )


SELLERS = """sellers AS (SELECT s_suppkey AS seller_id, s_name AS seller, 'G' || s_nationkey AS seller_group, ['A', 'B', 'C'][(s_suppkey % 3 + 1)::INT] AS tier, s_acctbal AS balance FROM supplier)"""

NEWEST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (item, seller): the newest observation.

    Observations are dealt by item, so that they meet their item without another shuffle, and are sorted once.  The items' small file can hold a million of them,
    so they do not go through the driver.
    """
    li, p = read(spark, sf_dir, "lineitem").repartition("l_partkey"), read(spark, sf_dir, "part")
    newest = li.groupBy("l_partkey", "l_suppkey").agg(
        F.max(F.struct(*NEWEST, "l_discount", "l_tax", "l_returnflag", "l_linestatus")).alias("x"), F.min("l_shipdate").alias("first_seen"))
    return newest.join(p.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offer_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.substring_index("p_name", " ", -1).alias("kind"), F.col("p_size").alias("capacity"),
        F.concat(F.substring("p_brand", 7, 10), F.lit("-"), F.col("p_size").cast("string")).alias("model_key"),
        (F.col("p_retailprice") * (1 - F.col("x.l_discount")) * (1 + F.col("x.l_tax"))).alias("price"),
        F.when(F.col("x.l_linestatus") == "O", "InStock").otherwise("OutOfStock").alias("availability"),
        (F.col("x.l_returnflag") != "R").alias("is_active"), F.col("first_seen"), F.col("x.l_shipdate").alias("last_seen"),
    )


def stored_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers as a table, for queries that read them several times: observations are dealt and sorted once."""
    return stored(offers(spark, sf_dir))


OFFERS = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn,
        min(l_shipdate) OVER (PARTITION BY l_partkey, l_suppkey) AS first_seen FROM lineitem) WHERE rn = 1),
    offers AS (SELECT l_partkey * 1000000 + l_suppkey AS offer_id, l_partkey AS item_id, l_suppkey AS seller_id, p_name AS name, p_brand AS brand, p_type AS category, split_part(p_name, ' ', -1) AS kind, p_size AS capacity,
        substr(p_brand, 7, 10) || '-' || p_size AS model_key, p_retailprice * (1 - l_discount) * (1 + l_tax) AS price,
        CASE WHEN l_linestatus = 'O' THEN 'InStock' ELSE 'OutOfStock' END AS availability, l_returnflag <> 'R' AS is_active, first_seen, l_shipdate AS last_seen
        FROM newest JOIN part ON l_partkey = p_partkey)"""


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offer_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_shipdate").alias("observed_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_linestatus") == "O", "InStock").otherwise("OutOfStock").alias("availability"), F.col("l_returnflag").alias("flag"))


PRICE_OBS = """price_obs AS (SELECT l_partkey * 1000000 + l_suppkey AS offer_id, l_partkey AS item_id, l_suppkey AS seller_id, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS qty, l_extendedprice / l_quantity AS price,
    CASE WHEN l_linestatus = 'O' THEN 'InStock' ELSE 'OutOfStock' END AS availability, l_returnflag AS flag FROM lineitem)"""

#: The order of observations of an offer; the test data has ties on date and sequence.
OBS_ORDER = ("observed_at", "seq", "qty", "price")


def demand_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("term"), F.col("event_type").alias("category"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))


DEMAND = """demand_obs AS (SELECT event_type || '-' || (user_id % 10) AS term, event_type AS category, ts::DATE AS day, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2, 3)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), (F.col("event_type") != "error").alias("ok"), F.col("value"))


RUN_LOG = """run_log AS (SELECT user_id AS source_id, event_id AS run_id, ts AS finished_at, event_type <> 'error' AS ok, value FROM events)"""


def matches(spark: SparkSession, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """Offers (``o``, if they are there already) matched to their item, with a confidence and a type that depend on the ids."""
    o = offers(spark, sf_dir) if o is None else o
    return o.select("offer_id", "item_id", (F.lit(0.55) + (F.col("offer_id") % 40) / F.lit(100.0)).alias("confidence"),
                    F.element_at(F.array(*map(F.lit, ("exact", "identical", "direct", "functional"))), (F.col("seller_id") % 4 + 1).cast("int")).alias("match_type"))


MATCHES = """matches AS (SELECT offer_id, item_id, 0.55::DOUBLE + (offer_id % 40) / 100.0::DOUBLE AS confidence, ['exact', 'identical', 'direct', 'functional'][(seller_id % 4 + 1)::INT] AS match_type FROM offers)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a table: one per order, with type, severity, confidence and status."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("finding_id"), F.concat_ws(":", F.lit("f"), (F.col("o_custkey") % 500).cast("string"), F.col("o_orderpriority")).alias("dedupe_key"),
        F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 100).alias("seller_id"), F.substring("o_orderpriority", 3, 20).alias("finding_type"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("severity"),
        ((F.col("o_orderkey") % 70 + 25) / F.lit(100.0)).alias("confidence"), F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "done").otherwise("seen").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("amount"))


FINDINGS = """findings AS (SELECT o_orderkey AS finding_id, 'f:' || (o_custkey % 500) || ':' || o_orderpriority AS dedupe_key, o_custkey AS item_id, o_orderkey % 100 AS seller_id, substr(o_orderpriority, 3, 20) AS finding_type,
    ['low', 'medium', 'high'][(o_orderkey % 3 + 1)::INT] AS severity, (o_orderkey % 70 + 25) / 100.0::DOUBLE AS confidence, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'done' ELSE 'seen' END AS status,
    o_orderdate AS created_at, o_totalprice AS amount FROM orders)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 64-bit signatures from the signs of embeddings and of their steps; the even ids are side 1."""
    from ..operators.joins import sign_signature, step_signature

    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", sign_signature(F.col("embedding")).alias("sig"), step_signature(F.col("embedding")).alias("step"), (F.col("vec_id") % 2).alias("side"))


SIGNATURES = """sigs AS (SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS sig,
    list_reduce(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] - embedding[i] > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS step, vec_id % 2 AS side FROM embeddings)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


PAGES = r"""page AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)"""


def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page versions: text lines are the sentences of a conversation turn; links follow from its number."""
    c = read(spark, sf_dir, "conversations")
    lines = F.array_distinct(F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 1))
    link = lambda k: F.struct(F.concat(F.lit("item name "), k.cast("string")).alias("t"), F.concat(F.lit("/"), k.cast("string")).alias("u"))
    items = F.transform(F.sequence(F.lit(0), (F.col("turn") % 5).cast("int")), link)
    kind = F.element_at(F.array(F.lit("catalog"), F.lit("news"), F.lit("blog")), (F.col("conv_id") % 3 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("version"), lines.alias("lines"), items.alias("items"), kind.alias("kind"), F.concat(F.lit("/page/"), F.col("conv_id").cast("string")).alias("url"))


PAGE_VERSIONS = r"""page_versions AS (SELECT conv_id AS page_id, turn AS version, lines, list_transform(range(0, turn % 5 + 1), lambda k: {'t': 'item name ' || k, 'u': '/' || k}) AS items, ['catalog', 'news', 'blog'][(conv_id % 3 + 1)::INT] AS kind, '/page/' || conv_id AS url FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 1) AS l0 FROM conversations),
    LATERAL (SELECT list_filter(l0, lambda x, i: list_position(l0, x) = i) AS lines))"""


def ordered(*cols: str) -> list:
    return [F.asc_nulls_first(c) for c in cols]


def by(*keys: str) -> Window:
    return Window.partitionBy(*keys)


PARTS = {"catalog": CATALOG, "sellers": SELLERS, "offers": OFFERS, "price_obs": PRICE_OBS, "demand_obs": DEMAND, "run_log": RUN_LOG, "matches": MATCHES, "findings": FINDINGS, "sigs": SIGNATURES, "page": PAGES, "page_versions": PAGE_VERSIONS}


def ctes(sql: str) -> str:
    """Expand ``{a b c}`` at the start of a query into a WITH clause of those bindings; a query that goes on with ``, x AS (...)`` adds its own."""
    if not sql.lstrip().startswith("{"):
        return sql
    head, _, rest = sql.lstrip()[1:].partition("}")
    names = head.split()
    if "matches" in names and "offers" not in names:
        names.insert(names.index("matches"), "offers")
    start = "WITH RECURSIVE " if "recursive" in names else "WITH "
    return start + ",\n".join(PARTS[n] for n in names if n != "recursive") + "\n" + rest
