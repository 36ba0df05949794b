"""Queries that use the registered SQL functions."""

from __future__ import annotations

from ..functions.register import register_functions
from .bindings import catalog, offers
from .pages import shop_pages
from .registry import query
from .text import RETAIL, price_texts


@query("register_functions", "{catalog} SELECT item_id, " + RETAIL.format("price") + " AS retail, CASE WHEN capacity >= 2 THEN true END AS near_unit, round_even(0.6 + 0.55 * (capacity + 1) / 52.0::DOUBLE, 6) AS factor FROM catalog")
def sql_functions(spark, d):
    register_functions(spark)
    catalog(spark, d).createOrReplaceTempView("quaymark_catalog")
    return spark.sql("SELECT item_id, round_retail_price(price) AS retail, abs(unit_price(price, capacity) - price / capacity) <= 0.00500001 AS near_unit, bround(calibration_factor(capacity, 50), 6) AS factor FROM quaymark_catalog")


@query("sql_text_functions", "SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size * 1000 + 250 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS price, 'AB' || p_size AS code FROM part")
def sql_text_functions(spark, d):
    register_functions(spark)
    price_texts(spark, d).createOrReplaceTempView("quaymark_texts")
    catalog(spark, d).createOrReplaceTempView("quaymark_catalog")
    return spark.sql("SELECT item_id, parse_price(price_text) AS price, model_key(concat('x AB-', capacity)) AS code FROM quaymark_texts JOIN quaymark_catalog USING (item_id)")


@query("rules_dataframe_api", "{catalog} SELECT item_id, CASE WHEN contains(lower(name), 'red') THEN 'hot' WHEN contains(lower(name), 'ring') THEN 'round' END AS label FROM catalog")
def rules_dataframe_api(spark, d):
    from ..operators.text import first_label_by_table

    rules = spark.createDataFrame([(1, "red", "hot"), (2, "ring", "round")], "ord int, pattern string, label string")
    return first_label_by_table(catalog(spark, d).select("item_id", "name"), rules, "item_id", "name").select("item_id", "label")


@query("page_offers_udtf", "SELECT page_id, 'item ' || page_id AS name, page_id * 10 + 5.5::DOUBLE AS price FROM pages WHERE page_id % 3 = 0")
def page_offers_udtf(spark, d):
    register_functions(spark)
    shop_pages(spark, d).createOrReplaceTempView("quaymark_pages")
    return spark.sql("SELECT * FROM page_offers(TABLE(SELECT page_id, html FROM quaymark_pages))")


@query("upper_median_udf", "{offers} SELECT category, list_sort(list(price))[(len(list(price)) // 2 + 1)::INT] AS price FROM offers GROUP BY 1")
def upper_median_udf(spark, d):
    register_functions(spark)
    offers(spark, d).createOrReplaceTempView("quaymark_offers")
    return spark.sql("SELECT category, upper_median(price) AS price FROM quaymark_offers GROUP BY category")
