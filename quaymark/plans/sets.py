"""Queries of the set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as O
from .bindings import catalog, page_versions
from .joins import aliases
from .registry import query


@query("own_categories_and_codes", """{catalog} , i AS (SELECT * FROM catalog WHERE item_id % 3 = 0), a AS (SELECT DISTINCT 'X' || substr(p_brand, 7, 10) AS alias_code, substr(p_brand, 7, 10) || '-' || p_size AS own_code FROM part WHERE p_partkey % 100 = 0)
    SELECT 'code' AS what, model_key AS value FROM i UNION SELECT 'category', category FROM i UNION SELECT 'code', alias_code FROM a WHERE own_code IN (SELECT model_key FROM i)""")
def own_categories_and_codes(spark, d):
    return O.own_keys(catalog(spark, d).filter("item_id % 3 = 0"), aliases(spark, d))


@query("added_removed_sets", """{page_versions} , x AS (SELECT page_id, version, lines, lag(lines) OVER (PARTITION BY page_id ORDER BY version) AS old FROM page_versions)
    SELECT page_id, version, len(list_filter(lines, lambda l: NOT list_contains(old, l))) AS added, len(list_filter(old, lambda l: NOT list_contains(lines, l))) AS removed FROM x WHERE old IS NOT NULL""")
def added_removed_sets(spark, d):
    from pyspark.sql import Window

    x = page_versions(spark, d).withColumn("old", F.lag("lines").over(Window.partitionBy("page_id").orderBy("version"))).filter("old IS NOT NULL")
    added, removed = O.added_removed(F.col("old"), F.col("lines"))
    return x.select("page_id", "version", F.size(added).cast("long").alias("added"), F.size(removed).cast("long").alias("removed"))


@query("missing_keys_in_series", """{catalog} , x AS (SELECT DISTINCT category, brand, capacity % 8 AS k FROM catalog), e AS (SELECT category, list_distinct(list(k)) AS ks FROM x GROUP BY 1), m AS (SELECT x.category, x.brand, list(k) AS own, any_value(ks) AS ks FROM x JOIN e USING (category) GROUP BY 1, 2)
    SELECT category, brand, list_sort(list_filter(ks, lambda k: NOT list_contains(own, k))) AS missing FROM m WHERE len(list_filter(ks, lambda k: NOT list_contains(own, k))) BETWEEN 1 AND greatest(3, len(ks) / 3)""")
def missing_keys_in_series(spark, d):
    c = catalog(spark, d).withColumn("k", F.col("capacity") % 8)
    return O.missing_in_members(c, ["category"], "brand", "k")


SITES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SECTIONS = "sec AS (SELECT category AS site, name, CASE WHEN capacity % 3 = 0 THEN 'a,b' WHEN capacity % 3 = 1 THEN 'c' END AS labels FROM catalog)"


@query("category_site_matrix", "{catalog} , " + SECTIONS + """ SELECT label, """ + ", ".join(f"array_to_string(list_sort(list_distinct(list(name) FILTER (site = '{s}'))), ', ') AS \"{s}\"" for s in SITES) + " FROM (SELECT site, name, unnest(string_split(coalesce(labels, 'none'), ',')) AS label FROM sec) GROUP BY label")
def category_site_matrix(spark, d):
    c = catalog(spark, d).select(F.col("category").alias("site"), "name", F.when(F.col("capacity") % 3 == 0, "a,b").when(F.col("capacity") % 3 == 1, "c").alias("labels"))
    return O.label_site_matrix(c, "labels", "site", "name", SITES)


@query("out_of_scope_themes", "{catalog} , " + SECTIONS + " SELECT split_part(name, ' ', 1) AS theme, count(DISTINCT site) AS sites, count(*) AS sections FROM sec WHERE labels = 'c' GROUP BY 1")
def out_of_scope_themes(spark, d):
    c = catalog(spark, d).select(F.col("category").alias("site"), "name", F.when(F.col("capacity") % 3 == 0, "a,b").when(F.col("capacity") % 3 == 1, "c").alias("labels")).filter("labels IS NOT NULL")
    own = spark.createDataFrame([("a",), ("z",)], "label string")
    return O.out_of_scope_themes(c, own, "labels", F.split_part("name", F.lit(" "), F.lit(1)))


@query("union_issue_lists", "{catalog} SELECT item_id, 'cheap' AS what, NULL::INT AS capacity FROM catalog WHERE price < 900 UNION ALL SELECT item_id, 'small', capacity FROM catalog WHERE capacity < 3")
def union_issue_lists(spark, d):
    c = catalog(spark, d)
    return O.union_issues([c.filter("price < 900").select("item_id", F.lit("cheap").alias("what")), c.filter("capacity < 3").select("item_id", F.lit("small").alias("what"), "capacity")])
