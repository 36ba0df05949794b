"""Readers, importers and writers (section 2.1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import upsert_keyed
from ..operators.text import parse_month


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with the separator that its head uses most; headers trimmed and in lower case."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:2000]
    sep = max((";", "\t", ","), key=head.count)
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))


def alias_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """For each wanted name the first column whose header equals one of its aliases, else contains one; NULL if none does."""
    low = {c.lower().strip(): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        hit = next((low[a] for a in options if a in low), None) or next((c for a in options for k, c in low.items() if a in k), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def import_term_volumes(df: DataFrame, stored: DataFrame, term: str, volume: str, month: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(series after the import, skipped rows): numbers cleaned, months parsed, upserted on term, source and period."""
    number = F.regexp_replace(F.col(volume), "[^0-9]", "").try_cast("double")
    x = df.select(F.lower(F.trim(term)).alias("term"), F.lit(source).alias("source"), parse_month(F.col(month)).alias("m"), number.alias("value"), F.col(volume).alias("raw"))
    ok = F.col("value").isNotNull() & F.col("m.start").isNotNull() & (F.length("term") > 0)
    good = x.filter(ok).select("term", "source", F.col("m.start").alias("period_start"), F.col("m.end").alias("period_end"), "value")
    return upsert_keyed(stored, good, ["term", "source", "period_start", "period_end"], ["value"]), x.filter(~F.coalesce(ok, F.lit(False))).select("term", "raw")


def wide_series_to_long(df: DataFrame, at: str) -> DataFrame:
    """One column per term -> (at, term, value): ``<1`` is 1, other characters than digits go, empty cells are dropped."""
    terms = [c for c in df.columns if c != at]
    long = df.select(at, *(F.col(c).cast("string").alias(c) for c in terms)).unpivot([at], terms, "term", "raw")
    value = F.when(F.trim("raw").startswith("<"), 1.0).otherwise(F.regexp_replace("raw", "[^0-9]", "").try_cast("double"))
    return long.select(at, F.lower("term").alias("term"), value.alias("value")).filter("value IS NOT NULL")


REGISTRY = (
    "name string, website string, types array<string>, pages array<struct<url:string,products:array<struct<name:string,price:double>>>>,"
    " tenders array<struct<number:string,subject:string,customer:string,price:double,day:string,url:string>>, listings array<struct<product:string,marketplace:string,seller:string,price:double,url:string>>"
)


def explode_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sellers, pages, offers and market observations from a nested JSON registry."""
    return registry_tables(spark.read.schema(REGISTRY).option("multiLine", True).json(path))


def registry_tables(raw: DataFrame, catalogue: str = "/(?:catalog|rent|shop|products)/?$") -> dict[str, DataFrame]:
    """The four tables of a registry; a page with several products, or with a catalogue's address, is a catalogue.

    Observations are tenders and marketplace listings, each once by its key.
    """
    p = raw.select("website", F.explode_outer("pages").alias("p")).filter("p IS NOT NULL")
    offers = p.select("website", F.col("p.url").alias("url"), F.explode("p.products").alias("o")).select("website", "url", "o.name", "o.price")
    pages = p.groupBy("website", F.col("p.url").alias("url")).agg(F.sum(F.size("p.products")).alias("_n"))
    pages = pages.select("website", "url", F.when((F.col("_n") > 1) | F.col("url").rlike(catalogue), "catalog").otherwise("product").alias("page_kind"))
    text = lambda *parts: F.concat_ws(":", *parts)
    t = raw.select(F.explode("tenders").alias("t")).select(
        F.lit("tender").alias("kind"), F.col("t.subject").alias("title"), F.col("t.customer").alias("party"), F.col("t.price").alias("price"), F.col("t.day").alias("day"), F.col("t.url").alias("url"), text(F.lit("tender"), F.coalesce("t.number", "t.url", "t.subject")).alias("key"))
    m = raw.select(F.explode("listings").alias("m")).select(
        F.lit("listing").alias("kind"), F.col("m.product").alias("title"), F.concat_ws(": ", "m.marketplace", "m.seller").alias("party"), F.col("m.price").alias("price"), F.lit(None).cast("string").alias("day"), F.col("m.url").alias("url"), text(F.lit("mp"), F.coalesce("m.url", "m.product")).alias("key"))
    seen = t.unionByName(m)
    observations = seen.groupBy("key").agg(F.min(F.struct(*(c for c in seen.columns if c != "key"))).alias("o")).select("key", "o.*")
    return {"sellers": raw.select("name", "website", "types").dropDuplicates(["website"]), "pages": pages, "offers": offers, "observations": observations}


def page_kind_from_multiplicity(df: DataFrame, url: str, ending: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(url))
    return df.withColumn("page_kind", F.when((n > 1) | F.col(url).rlike(ending), "catalog").otherwise("product"))


def import_terms(df: DataFrame, known: DataFrame, label: Column) -> DataFrame:
    """Terms not seen before, cleaned, with a category by rule where the list gives none."""
    x = df.withColumn("term", F.lower(F.trim(F.regexp_replace("term", r"\s+", " ")))).filter("term <> ''")
    x = x.groupBy("term").agg(F.min("category").alias("category"))
    return x.join(known.select("term"), "term", "left_anti").withColumn("category", F.coalesce("category", label)).withColumn("is_seed", F.lit(True))


def import_sellers(df: DataFrame, known: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """New sellers by root url; types split on | ; , and mapped."""
    pairs = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    root = F.regexp_extract("website", r"^([a-zA-Z]+://[^/?#]+)", 1)
    types = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split("types", "[|;,]"), lambda t: F.try_element_at(pairs, F.lower(F.trim(t)))))))
    x = df.select("name", root.alias("website"), types.alias("types")).filter("website <> ''")
    return x.groupBy("website").agg(F.min_by(F.struct("name", "types"), "name").alias("s")).select("website", "s.*").join(known.select("website"), "website", "left_anti")


def import_offer_prices(df: DataFrame, sellers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers with their seller's key, sellers to add): an unknown seller gets a key manual://name."""
    x = df.join(sellers.select(F.lower("seller").alias("_s"), "seller_id"), F.lower(F.col("seller_name")) == F.col("_s"), "left").drop("_s")
    key = F.coalesce(F.col("seller_id").cast("string"), F.concat(F.lit("manual://"), F.lower("seller_name")))
    return x.withColumn("seller_key", key), x.filter("seller_id IS NULL").select("seller_name", key.alias("seller_key")).distinct()


def merge_source_registry(stored: DataFrame, audit: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Sources after an audit list: a key by the first keyword in the name, else a slug; a status of ok is never lowered."""
    slug = F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "-")
    key = F.coalesce(*(F.when(F.contains(F.lower("name"), F.lit(w)), k) for w, k in keys), slug)
    a = audit.select(key.alias("source_key"), F.col("status").alias("_status")).groupBy("source_key").agg(F.min("_status").alias("_status"))
    x = stored.join(a, "source_key", "full_outer")
    return x.select("source_key", F.when(F.col("status") == "ok", "ok").otherwise(F.coalesce("_status", "status")).alias("status"))


MARKET = "struct<products:array<struct<id:bigint,name:string,brand:string,salePriceU:bigint,priceU:bigint,totalQuantity:int,sizes:array<struct<price:struct<product:bigint,total:bigint,basic:bigint>>>>>>"


def flatten_marketplace(df: DataFrame, body: str, own_brands: Sequence[str]) -> DataFrame:
    """Offers of marketplace responses, prices from cents by the first field that has one, without own brands."""
    p = df.select(F.explode(F.from_json(body, MARKET)["products"]).alias("p"))
    first = F.get(F.col("p.sizes"), F.lit(0))["price"]
    cents = F.coalesce(first["product"], first["total"], first["basic"], F.col("p.salePriceU"), F.col("p.priceU"))
    return p.select(F.col("p.id").alias("id"), F.col("p.name").alias("name"), F.col("p.brand").alias("brand"), (cents / 100).alias("price"), (F.col("p.totalQuantity") > 0).alias("in_stock")).filter(~F.lower("brand").isin(*(b.lower() for b in own_brands)))


def latest_page_copy(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day)))).filter("_rn = 1").drop("_rn")


def sitemap_urls(df: DataFrame, host: str, topic: str, exclude: str, known: DataFrame, most: int = 250) -> DataFrame:
    """Product urls of sitemap texts: the same host, on topic, not excluded, not known, up to a number for each host."""
    x = df.select(host, F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    x = x.filter((F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1) == F.col(host)) & F.col("url").rlike(topic) & ~F.col("url").rlike(exclude) & ~F.col("url").rlike(r"\.xml$"))
    x = x.join(known.select("url"), "url", "left_anti")
    return x.withColumn("rn", F.row_number().over(Window.partitionBy(host).orderBy("url"))).filter(F.col("rn") <= most)


def nested_sitemaps(df: DataFrame, fetched: DataFrame, depth: int = 5) -> DataFrame:
    """Sitemap texts and, up to a depth, those of the sitemaps that they name, from a table fetched(url, xml)."""
    every, now = df, df
    for _ in range(depth):
        urls = now.select("host", F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+\.xml)\s*</loc>"), F.lit(1))).alias("url"))
        now = urls.join(fetched, "url").select("host", "xml")
        every = every.unionByName(now)
    return every.distinct()


def write_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def export_views(
    catalog: DataFrame, sellers: DataFrame, offers: DataFrame, matches: DataFrame, findings: DataFrame, actions: DataFrame, ideas: DataFrame, demand: DataFrame, history: DataFrame, matrix: DataFrame, audit: DataFrame,
) -> dict[str, DataFrame]:
    """The twelve named exports, each a table with the names that its ids stand for."""
    o = offers.select("offer_id", F.col("name").alias("offer"), "seller_id")
    who = sellers.select("seller_id", "seller")
    item = catalog.select("item_id", F.col("name").alias("item"))
    return {
        "competitor_matrix": matrix, "site_audit": audit, "signals": findings.join(item, "item_id", "left").join(who, "seller_id", "left"), "recommendations": actions, "matrix": catalog, "competitors": sellers,
        "competitor_products": offers.join(who, "seller_id"), "matches": matches.join(o, "offer_id").join(who, "seller_id").join(item, "item_id", "left"), "queries": demand.select("term", "category").distinct(), "demand": demand, "hypotheses": ideas,
        "price_history": history.select("offer_id", "price", "availability", "observed_at").join(o, "offer_id").join(who, "seller_id").drop("seller_id", "offer_id"),
    }


def dump_tables(frames: dict[str, tuple[DataFrame, Sequence[str]]], path: str) -> None:
    """Tables as JSON lines with natural keys only."""
    for name, (df, drop) in frames.items():
        df.drop(*drop).write.mode("overwrite").json(f"{path}/{name}")


def load_counts(stored: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows a reload creates, updates and leaves."""
    return upsert_keyed(stored, loaded, keys).groupBy("action").agg(F.count("*").alias("n"))


def ranked_suggestions(df: DataFrame, known: DataFrame, term: str, suggestions: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(unseen terms, ranks as observations) from a list of suggestions for each seed."""
    x = df.select(F.col(term).alias("seed"), F.posexplode(suggestions).alias("pos", "s")).select("seed", F.lower(F.trim("s")).alias("term"), (F.col("pos") + 1).alias("rank")).filter("term <> ''")
    new = x.select("term").distinct().join(known.select("term"), "term", "left_anti")
    return new, x.groupBy("seed", "term").agg(F.min("rank").alias("value")).withColumn("unit", F.lit("rank")).withColumn("period_start", at)
