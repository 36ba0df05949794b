"""What grows with the tables: rows that joins make, and plans that keep large tables off the driver."""

import re

import pytest
from pyspark.sql import functions as F

from quaymark.operators import joins


def joined_rows(df):
    """Rows that the largest join of an executed query made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.finalPhysicalPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most


def alike(spark, n, name):
    """Rows of one code in two kinds."""
    return spark.range(n).select(F.col("id").alias(name), F.lit("11-5").alias("model_key"), F.lit("b").alias("brand"), F.lit(5).alias("capacity"), F.when(F.col("id") % 2 == 0, "ring").otherwise("rod").alias("kind"))


@pytest.mark.parametrize("best_only", [False, True])
def test_offers_of_one_code_do_not_meet_all_its_items(spark, best_only):
    offers, items = alike(spark, 600, "offer_id"), alike(spark, 500, "item_id")
    aliases = spark.createDataFrame([("11-5", "11-5")], "alias_code string, own_code string")
    x = joins.match_exact_model(offers, items, aliases)
    x = joins.best_match(x) if best_only else x
    assert joined_rows(x) <= 600 * 3
    got = {}
    for r in x.collect():
        got.setdefault(r.offer_id, []).append((r.item_id, r.confidence, r.match_type))
    assert len(got) == 600
    for offer, rows in got.items():
        want = [(k, 0.98, "exact") for k in range(offer % 2, 6, 2)]
        assert sorted(rows) == want[: 1 if best_only else 3]


def test_missing_facts_of_offers_keep_their_matches(spark):
    offers = spark.createDataFrame([(1, "11-5", None, None, None), (2, None, "b", 5, "ring"), (3, "X1", "b", 5, "ring")], "offer_id long, model_key string, brand string, capacity int, kind string")
    aliases = spark.createDataFrame([("X1", "11-5"), ("X1", "11-6")], "alias_code string, own_code string")
    got = sorted((r.offer_id, r.item_id, r.confidence, r.match_type, r.rn) for r in joins.match_exact_model(offers, alike(spark, 2, "item_id"), aliases).collect())
    assert got == [(1, 0, 0.55, "kit", 1), (1, 1, 0.55, "kit", 2), (3, 0, 0.98, "exact", 1), (3, 1, 0.4, "functional", 2)]


def cards(spark, n):
    return alike(spark, n, "item_id").withColumns({"category": F.lit("c"), "sku": F.when(F.col("item_id") % 2 == 0, "s")})


def test_pairs_of_close_capacity_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(joins, "DEALT", 7)
    monkeypatch.setattr(joins, "PAIRS", 100)
    c = cards(spark, 60).withColumn("capacity", (F.col("item_id") % 9).cast("int")).select("item_id", "category", "capacity")
    x = joins.near_capacity(c, c.select("category", F.col("item_id").alias("peer_id"), F.col("capacity").alias("peer_capacity")), ["category"], other="peer_capacity")
    assert sorted((r.item_id, r.peer_id) for r in x.collect()) == sorted((a, b) for a in range(60) for b in range(60) if abs(a % 9 - b % 9) <= 2)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [" in plan and "_piece" in plan


def test_pairs_of_specs_classify_an_item_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "DEALT", 7)
    c = cards(spark, 40).withColumn("spec", F.struct((F.col("item_id") % 2 == 0).alias("two_way"), F.when(F.col("item_id") % 3 == 0, "2.4 GHz").when(F.col("item_id") % 3 == 1, "IR").alias("band"), (F.col("item_id") % 5 + 1).alias("range_m")))
    x = joins.spec_pairs(c, ["brand", "category"], "spec")
    s = c.alias("a").join(c.alias("b"), F.col("a.item_id") < F.col("b.item_id")).select(F.col("a.item_id"), F.col("b.item_id").alias("other_id"), F.col("a.spec").alias("s1"), F.col("b.spec").alias("s2"))
    penalty, reasons = joins.spec_penalty("s1", "s2")
    want = s.select("item_id", "other_id", F.bround(penalty, 4).alias("penalty"), reasons.alias("reasons"))
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, want.collect()))


def shuffled_rows(df):
    """Rows that the shuffles of an executed query wrote."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.finalPhysicalPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            rows += p.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return rows


@pytest.mark.parametrize("n, m", [(300, 300), (1, 900), (900, 1)])
def test_copies_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch, n, m):
    monkeypatch.setattr(joins, "DEALT", 1)
    monkeypatch.setattr(joins, "PAIRS", 100)
    rows = lambda n, name: spark.range(n).select(F.lit("g").alias("k"), F.col("id").alias(name)).unionByName(spark.createDataFrame([(None, -1), ("g", 0), ("h", 7)], f"k string, {name} long"))
    x = joins.pairs_within(rows(n, "a"), rows(m, "b"), ["k"])
    assert shuffled_rows(x) <= 20 * (n + m + 10)
    side = lambda n: [*range(n), 0]
    assert sorted(map(tuple, x.select("a", "b").collect())) == sorted([(a, b) for a in side(n) for b in side(m)] + [(7, 7)])


def test_pairs_of_equal_specs_come_as_one_row_until_the_last_step(spark):
    c = cards(spark, 400).withColumn("spec", F.struct((F.col("item_id") % 2 == 0).alias("two_way"), F.lit("IR").alias("band"), F.lit(3).alias("range_m")))
    x = joins.spec_pairs(c, ["brand", "category"], "spec")
    assert joined_rows(x) == 400 * 2 and x.count() == 400 * 399 / 2


def test_twins_make_each_pair_once_without_a_shuffle_of_pairs(spark):
    x = joins.twins(cards(spark, 50).unionByName(cards(spark, 4)))
    assert sorted(map(tuple, x.collect())) == [(a, b) for a in range(50) for b in range(50) if a != b and a % 2 == b % 2]
    assert "twin_id" not in "".join(line for line in x._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(item_id" in line)
    odd = spark.createDataFrame([(1, "s", "k", None, "ring"), (1, "t", "k", 3, "ring"), (2, "s", "k", None, "ring"), (3, "t", "k", 3, "ring"), (4, None, None, 3, "ring")], "item_id long, sku string, model_key string, capacity int, kind string")
    assert sorted(map(tuple, joins.twins(odd).collect())) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_twins_are_sorted_out_once_and_come_as_one_row_until_the_last_step(spark):
    x = joins.twins(cards(spark, 400))
    assert "hashpartitioning(item_id" not in x._jdf.queryExecution().executedPlan().toString()
    assert joined_rows(x) <= 400 * 3 and x.count() == 200 * 199 * 2


def test_offers_alike_leave_out_analogs_together(spark):
    facts = lambda n, name: alike(spark, n, name).withColumns({"category": F.lit("c"), "kind": F.lit("rod"), "price": 100.0 + F.col(name) % 3})
    offers, items = facts(500, "offer_id"), facts(400, "item_id")
    x = joins.match_analogs(offers, items, offers.filter("offer_id < 0"), "ring")
    assert sorted((r.offer_id, r.item_id, r.confidence, r.rn) for r in x.collect()) == [(o, k, 0.8, k + 1) for o in range(500) for k in range(3)]
    i = items.select("item_id", "category", "kind", F.col("capacity").cast("long").alias("ic"), F.col("price").alias("ip"))
    o = offers.select("offer_id", "category", "kind", F.col("capacity").cast("long").alias("oc"), F.col("price").alias("op"))
    assert joins.candidates(o, joins.near_items(i), "ring", False, 3).count() == 500 * 3


def test_items_alike_meet_offers_together_and_stay_off_the_driver(spark):
    facts = lambda n, name: alike(spark, n, name).withColumns({"category": F.lit("c"), "kind": F.lit("rod"), "oc": F.lit(5).cast("long"), "ic": F.lit(5).cast("long"), "price": 100.0 + F.col(name) % 3})
    i = facts(4000, "item_id").select("item_id", "category", "kind", "ic", F.col("price").alias("ip"))
    o = facts(10, "offer_id").select("offer_id", "category", "kind", "oc", F.col("price").alias("op"))
    x = joins.candidates(o, joins.near_items(i), "ring", False, 3)
    assert not re.search(r"BroadcastHashJoin \[[^\]]*\boc#", x._jdf.queryExecution().executedPlan().toString())
    assert joined_rows(x) == 30


def test_analogs_of_divided_classes_and_odd_facts(spark):
    price = lambda name, k: F.when(F.col(name) % 29 == 0, None).when(F.col(name) % 31 == 0, 0.0).when(F.col(name) % 37 == 0, float("nan")).when(F.col(name) % 41 == 0, -5.0).otherwise(100.0 + F.col(name) * k % 260)
    spec = lambda name: F.struct((F.col(name) % 2 == 0).alias("two_way"), F.when(F.col(name) % 5 > 0, "IR").alias("band"), F.col("capacity").alias("range_m"))
    facts = lambda n, name, k: alike(spark, n, name).withColumns({"category": F.lit("c"), "capacity": F.when(F.col(name) % 23 > 0, (F.col(name) * k % 4 * 5 + 3).cast("int")), "price": price(name, k)}).withColumn("spec", spec(name))
    offers, items = facts(300, "offer_id", 7.3), facts(500, "item_id", 11.7)
    got = joins.match_analogs(offers, items, None, "ring", spec="spec", accessories=["rod"])
    classed = lambda df, name: F.struct(F.col(f"{df}.spec.two_way").alias("two_way"), joins.band_class(F.col(f"{df}.spec.band")).alias("band"), F.col(f"{df}.spec.range_m").alias("range_m")).alias(name)
    pairs = offers.alias("o").join(items.alias("i"), ["category", "kind"]).select(
        "offer_id", "item_id", "kind", F.col("o.capacity").alias("oc"), F.col("i.capacity").alias("ic"), F.col("o.price").alias("op"), F.col("i.price").alias("ip"), classed("o", "o_spec"), classed("i", "i_spec"))
    best = {}
    for r in joins.analog_score(pairs, "ring", True).collect():
        best.setdefault((r.offer_id, r.kind), []).append((-r.score, r.item_id))
    want = []
    for (offer, kind), rows in best.items():
        rows.sort()
        for rn, (s, item) in enumerate(rows[:3], 1):
            if rn <= 2 and s - rows[0][0] <= 0.15 + 1e-9 if kind == "ring" else -s >= 0.55:
                firm = "accessory" if kind == "rod" else "direct"
                want.append((offer, item, min(max(-s, 0.2), 0.8), firm if -s >= (0.55 if kind == "rod" else 0.6) else "functional", rn))
    assert sorted((r.offer_id, r.item_id, r.confidence, r.match_type, r.rn) for r in got.collect()) == sorted(want) and len(want) > 600


def test_offers_without_an_exact_match_are_found_by_their_profile(spark):
    offers = spark.createDataFrame([(1, "11-5", None, None, None), (2, None, "b", 5, "ring"), (3, "X1", "b", 5, "ring"), (4, "X2", "b", 5, "ring"), (5, "1-5", None, 5, "rod")], "offer_id long, model_key string, brand string, capacity int, kind string")
    aliases = spark.createDataFrame([("X1", "11-5"), ("X2", "12-5")], "alias_code string, own_code string")
    rest = joins.without_exact_match(offers, alike(spark, 2, "item_id"), aliases)
    assert sorted(r.offer_id for r in rest.collect()) == [2, 4, 5] and rest.columns == offers.columns


def shuffles(df):
    """The lines of a plan that deal rows out anew."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]


def test_offers_are_dealt_once_and_best_matches_do_not_meet_by_offer_again(spark, sf):
    from quaymark.plans import bindings
    from quaymark.plans.joins import best_match_per_offer

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(shuffles(bindings.offers(spark, sf))) == 2  # observations and items
        best = shuffles(best_match_per_offer(spark, sf))
        assert sum("l_partkey" in line for line in best) == 2 and not any("offer_id" in line for line in best)  # once for the profiles, once for their offers: Spark reuses it
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_signature_pairs_are_summed_up_before_offers_meet_them(spark):
    offers = spark.range(90).select(F.col("id").alias("offer_id"), (F.col("id") % 3).alias("id"))
    pairs = spark.range(300).select((F.col("id") % 4).alias("id"), F.when(F.col("id") % 4 == 0, "similar").when(F.col("id") == 1, "same").otherwise("similar").alias("level"))
    x = joins.offers_by_level(offers, pairs, ["id"])
    assert joined_rows(x) == 90
    assert {(r.offer_id, r.level) for r in x.collect()} == {(i, "same" if i % 3 == 1 else "similar") for i in range(90)}


@pytest.mark.parametrize("name", ["generate_ideas", "generate_actions", "run_signals", "export_views", "periodic_report"])
def test_offers_that_are_read_several_times_are_sorted_out_once(spark, sf, name):
    from quaymark import plans

    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(l_shipdate" not in plan  # the newest observation of an offer comes from the stored table


def test_first_names_and_their_number_come_from_one_sort(spark):
    from quaymark.operators.aggregates import joined_names

    rows = [("a", 1, n) for n in ("x", "b", "b", None, "c", "d", "e")] + [("a", None, "z"), ("a", None, "z"), ("b", 1, None)]
    x = joined_names(spark.createDataFrame(rows, "category string, seller_id long, name string"), ["category", "seller_id"], "name", 4)
    assert len(shuffles(x)) == 1
    assert {tuple(r) for r in x.collect()} == {("a", 1, "b; c; d; e", 5), ("a", None, "z", 1), ("b", 1, "", 0)}
