"""Small frames with known results: numbers, codes, upserts, matches, pages and streams."""

import pytest
from pyspark.sql import functions as F

from quaymark.operators import changes, decisions, joins, lines, names, news, pages, ranks, series, signals, signatures, sweep, terms, text
from quaymark.sources import imports, tables
from quaymark.streaming import jobs


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_prices(spark):
    got = column(spark, ["32 500 ₽", "32500,00", "от 4 500 руб.", "12.500 руб", "1 500 ₽ за шт", "нет", "", None, "0 руб", "999999999999 руб"], text.parse_price(F.col("v")))
    assert got == [32500, 32500, 4500, 12500, 1500, None, None, None, None, None]


def test_model_codes(spark):
    names = ["система SGTR02 чёрная", "радиогид UG-10", "AG-300", "микрофон ТТ106 с кейсом", "HDE 2020-D-II", "USB2 hub", "nothing"]
    got = column(spark, names, text.model_key(F.col("v"), F.lit(None).cast("string"), [r"\b([A-Z]{2,5}[- ]?[0-9]+)\b"], "^USB"))
    assert got == ["SGTR02", "UG10", "AG300", "TT106", "HDE2020", None, None]
    patterns = [r"\b([A-Z]{2,5}[- ]?[0-9]+)\b", r"(?i)\b(reinvox|okayo)\s+([A-Z][A-Z0-9-]{1,12})\b"]
    assert column(spark, ["радиогид Reinvox DUO", "Okayo Pro set", "Reinvox AB12"], text.model_key(F.col("v"), F.lit(None).cast("string"), patterns, "^USB")) == ["REINVOX-DUO", "OKAYO-PRO", "AB12"]


def test_sql_functions_agree_with_the_columns(spark):
    from quaymark.functions.register import CODE, NO_CODE, register_functions

    register_functions(spark)
    values = ["32 500 ₽", "32500,00", "от 4 500 руб.", "12.500 руб", "1 500 ₽ за шт", "нет", "", None, "0 руб", "only 7,50 of 9 eur", "UG-10 set", "ТТ106 с кейсом", "USB2 hub", "HDE 2020-D"]
    df = spark.createDataFrame([(i, v, values[-i]) for i, v in enumerate(values)], "i int, t string, u string")
    pairs = [
        ("parse_price(t)", text.parse_price(F.col("t"))), ("model_key(t)", text.model_key(F.col("t"), F.lit(None).cast("string"), [CODE], NO_CODE)), ("name_similarity(t, u)", names.token_jaccard(F.col("t"), F.col("u"))),
        ("round_retail_price(i * 377.5D)", text.round_retail_price(F.col("i") * 377.5)), ("calibration_factor(i, 20)", signals.calibration_factor(F.col("i"), F.lit(20))),
        ("unit_price(i * 50.0D, i)", text.unit_price(F.col("i") * 50.0, F.col("i"), F.lit(None).cast("int"), F.lit(True), F.lit(False))),
        ("unit_price(i * 90.0D, 3, i, false, true)", text.unit_price(F.col("i") * 90.0, F.lit(3), F.col("i"), F.lit(False), F.lit(True))),
        ("recommended_price('raise', i * 100D, 3000D, i > 5)", decisions.recommended_price(F.lit("raise"), F.col("i") * 100.0, F.lit(3000.0), F.col("i") > 5))]
    for sql, col in pairs:
        assert df.filter("i > 0").select(F.expr(sql).alias("a"), col.alias("b")).filter("NOT a <=> b").count() == 0, sql


def test_clean_text(spark):
    assert column(spark, ["a ㅤ b ​", "123﻿", None], text.clean_text(F.col("v"))) == ["a b", "123", None]
    assert column(spark, ["ﬁne ①"], text.clean_text(F.col("v"), compatibility=True)) == ["fine 1"]


def test_capacity_needs_one_number(spark):
    c = text.detect_capacity(F.lit("set"), [F.col("v")], [r"([0-9]+) (?:receivers|units)"], "variants")
    assert column(spark, ["20 receivers", "20 receivers, 20 units", "20 receivers or 30 units", "variants: 20 units", None], c) == [20, 20, None, None, None]


def test_retail_rounding(spark):
    assert column(spark, [994.0, 995.0, 1025.0, 1075.0, 10050.0], text.round_retail_price(F.col("v")), "double") == [990, 1000, 1000, 1100, 10000]


def test_calibration(spark):
    assert column(spark, [3], F.bround(signals.calibration_factor(F.col("v"), F.lit(3)), 4), "int") == [1.04]


def test_recommended_price_never_lowers_on_raise(spark):
    df = spark.range(1, 400).select((F.col("id") * 37.0).alias("price"), (F.col("id") * 11.0 + 900).alias("median"), (F.col("id") % 2 == 0).alias("approx"))
    out = df.withColumn("r", decisions.recommended_price(F.lit("raise"), F.col("price"), F.col("median"), F.col("approx")))
    assert out.filter("r < price").count() == 0


OFFER = "seller_id long, url string, name string, price double, availability string, first_seen timestamp, last_seen timestamp, is_active boolean"


def test_upsert_is_idempotent_and_history_grows_on_change(spark):
    import datetime as dt

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    old = spark.createDataFrame([(1, "u", "n", 50500.0, "InStock", t0, t0, True)], OFFER)
    new = spark.createDataFrame([(1, "u", "n2", 50500.0, "InStock", t1), (1, "v", "m", 10.0, None, t1)], "seller_id long, url string, name string, price double, availability string, seen timestamp")
    once = changes.upsert_offers(old, new, ["seller_id", "url"], "seen")
    twice = changes.upsert_offers(once.drop("changed"), new, ["seller_id", "url"], "seen")
    assert {r.url: (r.name, r.changed) for r in once.collect()} == {"u": ("n", False), "v": ("m", True)}
    assert twice.filter("changed").count() == 0 and once.drop("changed").exceptAll(twice.drop("changed")).count() == 0
    obs = spark.createDataFrame([(1, 1, 50500.0, "a"), (1, 2, 50500.0, "a"), (1, 3, 52000.0, "a")], "k long, t int, price double, availability string")
    assert changes.price_history(obs, "k", ["t"]).count() == 2


def test_upsert_falls_back_to_the_url(spark):
    """A renamed offer keeps its row; a worse name does not replace the stored one; content counts as a change."""
    import datetime as dt

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    schema = "seller_id long, url string, name string, price double, availability string, content_hash string, first_seen timestamp, last_seen timestamp, is_active boolean"
    long = "Radio guide system with twenty receivers"
    old = spark.createDataFrame([(1, "u", "Guide old", 5.0, "a", "h", t0, t0, True), (1, "v", long, 6.0, "a", "h", t0, t0, True), (1, "w", "Same", 7.0, "a", "h", t0, t0, True), (1, "x", "Same", 8.0, "a", "h", t0, t0, True), (1, "y", "Gone guide", 9.0, "a", "h", t0, t0, True)], schema)
    new = spark.createDataFrame([(1, "u", "Guide new", 5.0, "a", "h", t1), (1, "v", "Short", 6.0, "a", "h", t1), (1, "w", "Same", 7.0, "a", "h2", t1), (1, "x", "Same", 8.0, "a", "h", t1), (2, "u", "Guide new", 5.0, "a", "h", t1)], "seller_id long, url string, name string, price double, availability string, content_hash string, seen timestamp")
    out = changes.upsert_offers(old, new, ["seller_id", "url", "name"], "seen", url="url")
    got = {(r.seller_id, r.url, r.name): (r.first_seen == t0, r.last_seen == t1, r.changed) for r in out.collect()}
    assert got == {(1, "u", "Guide new"): (True, True, False), (1, "v", long): (True, True, False), (1, "w", "Same"): (True, True, True), (1, "x", "Same"): (True, True, False), (1, "y", "Gone guide"): (True, False, False), (2, "u", "Guide new"): (False, True, True)}
    assert changes.upsert_offers(old, new, ["seller_id", "url", "name"], "seen").count() == 8


def test_disappearance_by_sitemap(spark):
    import datetime as dt

    t0, t1, t2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
    items = spark.createDataFrame([(1, "/a#1", t0, True), (2, "/b", t0, True), (3, "/c", t0, False), (4, "/d", t2, True), (5, "/e", None, True)], "i long, url string, fetched_at timestamp, is_active boolean")
    pages_ = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    run = lambda seen: {r.i for r in changes.gone_from_sitemap(items, pages_("/a"), pages_("/c"), F.lit(t1), seen).filter("is_active").collect()}
    assert run(11) == {1, 3, 4} and run(10) == {1, 2, 4, 5}


def test_findings_emit_once(spark):
    stored = spark.createDataFrame([], "dedupe_key string, fact double, status string")
    e = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "dedupe_key string, fact double")
    once = changes.emit_findings(stored, e)
    assert once.filter("inserted").count() == 2
    assert changes.emit_findings(once.drop("inserted"), e).filter("inserted").count() == 0


def test_banded_join_equals_all_pairs(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.xxhash64(F.col("id") % 20)).bitwiseXOR(F.col("id") * 7).alias("sig"))
    a, b = df.filter("vec_id % 2 = 0"), df.filter("vec_id % 2 = 1")
    got = signatures.hamming_pairs(a, b, 12).collect()
    every = a.crossJoin(b.select(F.col("vec_id").alias("v2"), F.col("sig").alias("s2"))).filter(F.bit_count(F.col("sig").bitwiseXOR(F.col("s2"))) <= 12).count()
    assert len(got) == len({(r.id, r.id2) for r in got}) == every > 0


@pytest.mark.parametrize("most", [6, 12])
def test_few_pairs_become_candidates(spark, most):
    """With bands dealt for a million rows on each side under 1 % of random pairs are compared, and no near pair is lost."""
    bands = signatures.deal_bits(10**6, 10**6, [0.5] * 64, most)
    assert sum(b.most + 1 for b in bands) == most + 1 and sum(len(b.bits) for b in bands) <= 64
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("sig"))
    noise = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("id", k), F.lit(64)).cast("int"))))
    right = spark.range(2000).select(F.col("id").alias("vec_id"), F.xxhash64("id").bitwiseXOR(noise).alias("sig"))
    found = signatures.hamming_candidates(df, right, most, "sig", "vec_id", None, bands, True).select("id", "id2").distinct()
    assert found.count() < 0.01 * 2000 * 2000
    assert found.filter("id = id2").count() == 2000


def test_bits_that_tell_nothing_get_no_threshold(spark):
    bands = signatures.deal_bits(10**6, 10**6, [0.5] * 32 + [0.0] * 32, 6)
    assert sum(b.most + 1 for b in bands) == 7
    assert all(signatures.within([0.5 if i < 32 else 0.0 for i in b.bits])[b.most] < 0.05 for b in bands)


def test_signatures_of_all_signs(spark):
    rows = [(1, -1), (2, 0), (3, 1 << 62), (4, -(1 << 63)), (5, None), (6, -1)]
    df = spark.createDataFrame(rows, "vec_id long, sig long")
    got = {(r.id, r.id2): r.distance for r in signatures.hamming_pairs(df, df, 2).collect()}
    want = {(i, j): bin((a ^ b) & (1 << 64) - 1).count("1") for i, a in rows for j, b in rows if i != j and a is not None and b is not None}
    assert got == {k: v for k, v in want.items() if v <= 2}
    assert signatures.hamming_pairs(df.limit(0), df, 3).count() == 0


def test_names_meet_on_rare_words(spark):
    import itertools
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    name = lambda: " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(1, 7)))
    schema = "item_id int, name string, price double, k int"
    left = [(i, name(), float(rng.randint(1, 400)), rng.randint(0, 1)) for i in range(150)] + [(150, None, 1.0, 0), (151, "W1 w2", 0.5, None), (152, "?!", 0.1, 0)]
    right = [(i, name(), float(rng.randint(1, 400)), rng.randint(0, 1)) for i in range(150)] + [(500, None, 1.0, 0), (501, "w2, w1", 0.3, None), (502, "!!", 0.2, 0)]
    for least in (0.34, 0.5, 0.75, 1.0):
        got = {r.item_id: (r.other_id, round(r.similarity, 9)) for r in names.reconcile_by_similarity(*(spark.createDataFrame(x, schema) for x in (left, right)), ["k"], least).collect()}
        want = {}
        tokens = lambda s: set("".join(c if c.isalnum() else " " for c in s.lower()).split()) if any(map(str.isalnum, s)) else {""}
        for (i, a, p, k), (j, b, q, m) in itertools.product(left, right):
            if k == m and k is not None and a is not None and b is not None:
                x, y = tokens(a), tokens(b)
                s = len(x & y) / len(x | y)
                if s >= least and (i not in want or (-s, j) < want[i]):
                    want[i] = (-s, j)
        same = {i for (i, _, p, k), (_, _, q, m) in itertools.product(left, right) if k == m and k is not None and abs(p - q) < 0.01}
        assert got == {i: (j, round(-s, 9)) for i, (s, j) in want.items() if i not in same}


def test_one_group_of_many_names(spark):
    """Fifty thousand names with one key on each side: words, not the key, bring them together."""
    n = 50_000
    base = lambda shift: spark.range(n).select((F.col("id") + shift).alias("item_id"), F.concat_ws(" ", F.lit("guide set"), F.hex(F.xxhash64("id")), F.hex(F.xxhash64(F.col("id") % 25_000))).alias("name"), (F.col("id") + 0.5 * F.sign(F.lit(shift))).alias("price"), F.lit(1).alias("k"))
    out = names.reconcile_by_similarity(base(0), base(n), ["k"], 0.8)
    assert out.count() == n and out.filter(F.col("other_id") != F.col("item_id") + n).count() == 0


def test_many_terms_in_one_pass(spark):
    import random

    rng = random.Random(4)
    letters = "abcdefghij"
    many = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(100_000)]
    many += ["he", "she", "his", "hers", "É", "🙂", "a b"]
    texts = ["uSHErs", "", None, "xé 🙂", "a b" * 400] + [" ".join(rng.choice(many) + "x" for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    listed = spark.createDataFrame([(t,) for t in [*many, "", None]], "term string")
    wanted = {t.lower() for t in many}
    longest = max(map(len, wanted))
    inside = lambda s: {s[i:j] for i in range(len(s)) for j in range(i + 1, min(len(s), i + longest) + 1)} & wanted
    for limit in (1_000_000, 30_000):  # one automaton, and several
        got = {r.i: set(r.terms) for r in terms.find_terms(df, listed, "t", limit=limit).collect()}
        assert got == {i: inside((t or "").lower()) for i, t in enumerate(texts)}
    assert [set(r.terms) for r in terms.find_terms(df, listed.limit(0), "t").collect()] == [set()] * len(texts)


def test_term_plans_join_no_text_with_a_term(spark):
    docs = spark.createDataFrame([("s1", "blue rings"), ("s2", "Blue bolts"), ("s3", "bolts"), ("own", "bolts")], "who string, t string")
    listed = spark.createDataFrame([("Blue",), ("bolts",), ("ring",)], "term string")
    out = joins.mentions_gap(docs.filter("who <> 'own'"), docs.filter("who = 'own'"), listed, "t", "who")
    assert [tuple(r) for r in out.collect()] == [("Blue", 2, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_nearest(items, targets, n):
    out = []
    for t, k, v in targets:
        near = sorted((abs(x - v), i) for i, m, x in items if m == k and m is not None and x is not None and v is not None)
        out += [(t, i, rn + 1) for rn, (_, i) in enumerate(near[:n])]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_nearest_by_value(spark, n):
    import random

    rng = random.Random(n)
    items = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randint(0, 12), rng.randint(0, 1000)])) for i in range(300)]
    items += [(1000 + i, "hot", float(i // 3)) for i in range(400)] + [(5000 + i, "same", 7.0) for i in range(100)]
    targets = [(i, rng.choice(["a", "b", "none", "hot", "same", None]), rng.choice([None, rng.randint(-5, 400)])) for i in range(150)]
    a = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, k, v in items], "item_id int, k string, value double")
    b = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, k, v in targets], "target_id int, k string, wanted double")
    out = sweep.nearest_by_value(a, b, ["k"], "value", "wanted", "item_id", n)
    assert sorted((r.target_id, r.item_id, r.rn) for r in out.collect()) == brute_nearest(items, targets, n)


def test_events_of_one_busy_seller(spark):
    """Segments and the index of keys give what comparing with every kept event gives."""
    import datetime
    import random

    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    names_ = ["abc", "tourguide", "tourguide200", "newtourguide", "guide200x", "xtourguide200y", "longname1", "longname", "ab"]
    for size in (400, 60):
        rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["new", "gone"]), rng.choice([*names_, "", None]), start + datetime.timedelta(hours=rng.randint(0, 24 * 400))) for i in range(size)]
        got = {r.event_id for r in news.dedupe_events(spark.createDataFrame(rows, "event_id int, seller_id int, event_type string, name_key string, at timestamp")).collect()}
        want, kept = set(), []
        for i, seller, kind, key, at in sorted(rows, key=lambda r: (r[4], r[0])):
            again = seller is not None and key and any(
                s == seller and t == kind and at - u <= datetime.timedelta(days=14) and (k == key or len(key) >= 8 and (k in key or key in k)) for s, t, k, u in kept)
            if not again:
                want.add(i)
                if seller is not None and key:
                    kept.append((seller, kind, key, at))
        assert got == want


def day_rows(spark, start, n):
    return spark.range(start, start + n).select(F.col("id").alias("event_id"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("ts"), F.col("id").cast("double").alias("value"))


def test_observation_folders(spark, tmp_path):
    from quaymark.sources import observations as S

    path = str(tmp_path / "obs")
    first = day_rows(spark, 0, 100)
    first.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    (tmp_path / "obs" / "notes").mkdir()
    x = S.read_observation_folders(spark, path, first.schema)
    assert x.count() == 100 and x.columns == ["event_id", "ts", "value", "day"]
    some = x.filter("day >= DATE '2024-01-03' AND day < DATE '2024-01-05' AND value > 20")
    assert {(r.day.isoformat(), r.event_id % 10) for r in some.collect()} == {("2024-01-03", 2), ("2024-01-04", 3)}
    reader = S.ObservationReader(path, S.dated(first.schema))
    from pyspark.sql import datasource as D
    import datetime

    value = D.GreaterThan(("value",), 20.0)
    left = list(reader.pushFilters([D.GreaterThanOrEqual(("day",), datetime.date(2024, 1, 9)), value]))
    assert left == [value] and {f.day for f in reader.partitions()} == {datetime.date(2024, 1, 9), datetime.date(2024, 1, 10)}
    # a stream goes on behind the files that it has seen, whatever their day
    stream, out = S.stream_observation_folders(spark, path, first.schema), tmp_path / "out"

    def run():
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(str(out)).collect())

    assert run() == list(range(100))
    day_rows(spark, 1000, 10).drop("value").withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
    assert run() == [*range(100), *range(1000, 1010)] and run() == [*range(100), *range(1000, 1010)]


def test_late_rows_are_counted(spark, tmp_path):
    e = spark.range(60).select(F.col("id").alias("event_id"), F.expr("timestamp '2024-02-01' - make_interval(0, 0, 0, cast(id % 6 as int))").alias("ts"))
    for k, part in enumerate(("ts >= '2024-02-01'", "ts >= '2024-01-31' AND ts < '2024-02-01'", "ts < '2024-01-31'")):
        e.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept, counts = jobs.run_counted(stream, lambda s: jobs.dedupe(s, ["event_id"], "3 days"))
    assert counts.seen == 60 and counts.late == 30 and kept.count() == 30  # on the watermark or under it


def test_near_lines_by_matching_blocks():
    """The index finds what comparing with every line of the pool finds."""
    import difflib
    import random

    rng = random.Random(3)
    line = lambda n: "".join(rng.choices("abcdef ", k=n))

    def edited(s):
        s = list(s)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "x"])
        return "".join(s)

    near = 0
    for _ in range(100):
        pool = [line(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 150, 250])) for _ in range(12)]
        some = [edited(rng.choice(pool)) for _ in range(15)] + [""]
        want = [x for x in some if not any(difflib.SequenceMatcher(None, x, o).ratio() >= 0.9 for o in pool if abs(len(o) - len(x)) < 30)]
        assert lines.without_near(some, pool) == want
        near += len(some) - len(want)
    assert near > 300
    many = [line(60) for _ in range(3000)]
    assert lines.without_near([edited(x) + "!" for x in many[:1000]] + many[1000:1100], many).__len__() < 500


def test_changes_against_all_lines_of_the_other_version(spark):
    schema = "page_id int, version int, lines array<string>, items array<struct<t:string,u:string>>"
    stays = "The tour guide system costs 32 500 roubles for ten people, batteries included."
    copy = stays.replace("32 500", "33 500")
    rows = [
        (1, 1, [stays], []), (1, 2, [stays, copy], []),  # a near copy of a line that stays
        (2, 1, [stays, "one", "two", "three", "four"], []), (2, 2, [stays], []),  # three lines that go are no change
        (3, 1, [stays], [("a", "/a"), ("b", "/b"), ("c", "/c")]), (3, 2, [stays], []),  # three links that go are one
        (4, 1, None, None), (4, 2, ["A whole new paragraph about a system that nobody has seen before now."], None), (4, 3, None, [("a", "/a")]),
    ]
    got = {(r.page_id, r.version): (r.added, r.removed, r.noise) for r in news.diff_versions(spark.createDataFrame(rows, schema), "page_id", "version", "lines", "items").collect()}
    assert got[1, 2] == ([], [], True)
    assert got[2, 2] == ([], ["one", "two", "three", "four"], True)
    assert got[3, 2] == ([], [], False)
    assert (len(got[4, 2][0]), got[4, 2][2]) == (1, False) and got[4, 3] == ([], got[4, 2][0], False)


def test_medians_of_large_groups_are_exact(spark):
    import random
    import statistics

    rng = random.Random(6)
    kinds = {
        "even": [float(i) for i in range(500)], "odd": [rng.gauss(0, 1) for _ in range(501)], "steep": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(400)],
        "equal": [7.5] * 300, "two": [1.0] * 200 + [2.0] * 200, "wide": [-1.7e308, 1.7e308] * 100 + [0.0], "close": [1.0 + i * 2.0**-52 for i in range(300)], "few": [3.0, 1.0, 2.0], None: [float(i % 9) for i in range(200)],
    }
    rows = [(k, v) for k, values in kinds.items() for v in values] + [("few", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    for most in (50, 10_000):
        got = {r.k: (r.median, r.upper_median) for r in ranks.medians(df, ["k"], "v", most).collect()}
        assert got.pop("none") == (None, None)
        for k, values in kinds.items():
            s = sorted(values)
            assert got[k][1] == s[len(s) // 2]
            assert got[k][0] == pytest.approx(statistics.median(s), rel=1e-12), (k, most)


def test_first_values(spark):
    df = spark.createDataFrame([("a", x) for x in "dbcabdd"] + [("b", None), (None, "z"), (None, "y")], "k string, v string")
    got = {r.k: r.vs for r in ranks.with_first_values(df.groupBy("k").count(), df, ["k"], "v", 2, "vs").collect()}
    assert got == {"a": ["a", "b"], "b": [], None: ["y", "z"]}
    plan = ranks.first_values(df, ["k"], "v", 2, "vs")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each task sends n values of a group
    x = spark.createDataFrame([(1, "a", "u2"), (2, "a", "u1"), (3, "a", "u3"), (4, None, "u9")], "id int, k string, u string")
    out = {r.id: (r.copies, r.urls) for r in series.collapse_duplicates(x, ["k"], [F.asc("id")], F.lit(True), "u", 2).collect()}
    assert out == {1: (3, ["u1", "u2"]), 4: (1, ["u9"])}


HTML = """<html><head><title>T</title><script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Product"], "name": "Guide", "sku": 7,
"image": ["a.jpg"], "brand": {"name": "B"}, "offers": [{"price": "32500", "priceCurrency": "RUB", "availability": "http://schema.org/InStock"}]}]}</script></head>
<body><header>skip</header><nav><a href="/x">x</a></nav><p>One &amp; two</p><p>12:30</p><p>One &amp; two</p><a href="/p">Link</a><table><tr><td>Range</td><td>100 m</td></tr></table><dl><dt>Weight</dt><dd>20 g</dd></dl></body></html>"""
LIST = '<a href="/">home</a> 300 руб <div><a href="/p1">Guide one</a><b>1 500 руб</b></div><div><a href="/p2">Guide two</a> 2500 руб</div>'


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://h/", "h", HTML), (2, "http://h/l", "h", LIST), (3, "http://h/e", "h", None)], "page_id long, url string, host string, html string")
    p = pages.jsonld_products(df).collect()
    assert len(p) == 1 and (p[0].name, p[0].price, p[0].availability, p[0].image, p[0].sku) == ("Guide", 32500.0, "InStock", "a.jpg", "7")
    got = {(r.name, r.url, r.price) for r in pages.catalog_page_offers(df).collect()}
    assert got == {("Guide one", "/p1", 1500.0), ("Guide two", "/p2", 2500.0)}
    n = {r.page_id: r for r in pages.normalise_page(df).collect()}
    assert n[1].title == "T" and n[1].text.split("\n") == ["One & two", "Link", "Range", "100 m", "Weight", "20 g"]
    assert [(i.t, i.u) for i in n[1].items] == [("Link", "http://h/p")] and n[3].text == "" and n[3].items == []
    specs = {(r.key, r.value) for r in pages.structured_specs(df).collect()}
    assert {("Range", "100 m"), ("Weight", "20 g")} <= specs
    hinted = spark.createDataFrame([(1, "<li>Weight: 5 g</li><li>News: today</li>")], "page_id long, html string")
    assert {r.key for r in pages.structured_specs(hinted, hints="weight|range").collect()} == {"Weight"}
    assert pages.product_page_offers(df.filter("page_id = 1")).first().how == "jsonld"


def page(spark, *html):
    return spark.createDataFrame([(i, "http://h/x/", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def ld(body):
    return f'<h1>Head</h1><script type="application/ld+json">{body}</script>'


def test_odd_jsonld_ends_no_job(spark):
    odd = [
        '{"@type":"Product","name":"A","offers":["x"]}', '{"@type":"Product","name":"B","offers":{"price":5,"availability":["http://s/InStock"]}}', "[" * 20_000, '{"@type":"Product","name":{"@value":"C"},"sku":[1,2],"brand":[{"name":"X"}],"image":[{"url":"i.jpg"}]}',
        '{"@type":"Product","name":"D","offers":{"price":{"value":3},"priceCurrency":7}}', '{"@type":"Product","name":"\\ud800E","offers":[{"lowPrice":"1e999"}]}', "null", '{"@type":"Product","name":true,"offers":{"price":NaN}}']
    df = page(spark, *map(ld, odd))
    got = {r.page_id: r for r in pages.jsonld_products(df).collect()}
    assert set(got) == {0, 1, 3, 4, 5, 7}
    assert (got[0].name, got[0].price) == ("A", None) and (got[1].price, got[1].availability) == (5.0, "InStock")
    assert (got[3].name, got[3].sku, got[3].brand, got[3].image) == (None, "1", "X", "i.jpg")
    assert got[4].price is None and got[4].currency == "7" and got[5].price is None and got[7].name is None and got[7].price is None
    assert pages.product_page_offers(df).count() == len(odd) and pages.catalog_page_offers(df).count() == 0


def test_page_cascade(spark):
    """Selectors come first, then JSON-LD, microdata, and the first plausible price outside of delivery notes."""
    rows = [
        (0, '<h1>Guide</h1><div class="cost"><b>12 500</b> руб</div>' + ld('{"@type":"Product","name":"L","offers":{"price":1}}'), {"name": "h1", "price": ".cost"}),
        (1, ld('{"@type":"Product","name":"L","offers":[{"price":"10"},{"price":20}]}'), None), (2, '<title>Home</title><h1>Guide</h1><meta itemprop="price" content="99,5">', {}),
        (3, "<h1>Guide</h1><p>300 руб delivery</p><p><span>1 500</span> <span>руб</span></p>", None), (4, "<h1>Only a name</h1>", None), (5, "<p>nothing</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, parser map<string,string>")
    got = {r.page_id: (r.name, r.price, r.how) for r in pages.product_page_offers(df, selectors="parser").collect()}
    assert got == {0: ("Guide", 12500.0, "selector"), 1: ("L", 10.0, "jsonld"), 2: ("Guide", 99.5, "microdata"), 3: ("Guide", 1500.0, "text"), 4: ("Only a name", None, "none")}
    cards = """<body><div id=list><div class=c><h3>First guide</h3><a href="/1"><img data-src="/1.jpg" src="/t.gif"></a><p><b>1 000</b> руб</p></div><div class=c><div class=x-title>Second</div><a href="/2">more of it</a><p>2 000 руб</p></div>
        <div class=c><a href="/3"><img alt="Third guide"></a><span>3 000 руб</span></div><div class=c><a href="/3"><img alt="Third guide"></a><span>3 000 руб</span></div><div class=c><a href="/4">Fourth</a><span>400 руб delivery</span></div>""" + "words " * 200 + "</div></body>"
    got = [(r.name, r.url, r.price, r.image) for r in pages.catalog_page_offers(page(spark, cards)).collect()]
    assert got == [("First guide", "/1", 1000.0, "/1.jpg"), ("Second", "/2", 2000.0, None), ("Third guide", "/3", 3000.0, None)]
    config = spark.createDataFrame([(0, cards, {"items": "div.c", "name": "h3,.x-title", "price": "p"})], "page_id long, html string, parser map<string,string>")
    assert [(r.name, r.price) for r in pages.catalog_page_offers(config, selectors="parser").collect()] == [("First guide", 1000.0), ("Second", 2000.0)]


def test_a_moved_counter_is_no_change(spark):
    make = lambda count, clock, more: f'<html><body><nav>menu</nav><main><p>Our guides</p><div class="counter">{count}</div><p>Просмотров: {count}</p><p>{clock}</p><a href="/g1">Guide SGTR02</a>{more}</main></body></html>'
    df = page(spark, make(17, "12:30", ""), make(18, "12:31:05", ""), make(18, "12:31", '<a href="/g2">Guide SGTR03</a><a href="/cart">cart</a><a href="mailto:x@y.z">mail us</a><a href="http://[">bad address</a>'))
    n = pages.normalise_page(df)
    h = {r.page_id: r for r in n.withColumn("h", pages.page_hash(F.split("text", "\n"), F.transform("items", lambda i: i["u"]))).collect()}
    assert h[0].h == h[1].h != h[2].h and [i.u for i in h[2].items] == ["http://h/g1", "http://h/g2"]


def test_upserts_move_only_new_rows(spark):
    import os

    old = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("double").alias("v"))
    new = spark.range(1990, 2010).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("s"), F.lit(-1.0).alias("v"))
    stored = tables.KeyedTable(old, ["k", "s"], 8)
    merged = changes.upsert_keyed(stored.current(), new.repartition(8, "k", "s"), ["k", "s"]).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = changes.upsert_keyed(stored.current(), new.repartition(8, "k", "s"), ["k", "s"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan  # that of the new rows
    merge = lambda a, b: changes.upsert_keyed(a, b, ["k", "s"]).drop("action")
    for _ in range(3):
        out = stored.upsert(new, merge)
    assert sorted((r.k, r.v) for r in out.collect()) == sorted((r.k, r.v) for r in merged) == [(k, -1.0 if k >= 1990 else float(k)) for k in range(2010)]
    files = [f for f in out.inputFiles() if os.path.getsize(f.removeprefix("file://").removeprefix("file:"))]
    assert len(files) <= 8


def test_wide_letters_in_offers(spark):
    df = spark.createDataFrame([("\uff21\uff22-12 guide\u3000x\u00b2", None, "12 EUR")], "name string, sku string, price_text string")
    r = text.normalise_offers(df, [], ["guide"], [r"\b([A-Z]{2}-[0-9]+)\b"], "^USB").first()
    assert (r.clean_name, r.code, r.brand_found) == ("AB-12 guide x2", "AB12", "guide")


def test_measures_agree_with_texts():
    import random

    rng = random.Random(4)
    for _ in range(50):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", '<a href="/x">', "</a>", "<script>", "</script>", "<b>", "</b>", " word ", "12 EUR", "a  b", "\n"]) for _ in range(80))
        root = pages._Tree(html).root
        measure = pages._Measure(root)
        for n in root.walk():
            if n.tag not in ("script", "style", "noscript", "template"):
                assert measure.size[n] == len(n.text()) and (n in measure.digit) == any(map(str.isdigit, n.text()))
            assert (n in measure.linked) == bool(pages.select(n, "a[href]"))


def test_a_long_listing(spark):
    cards = "".join(f'<div><div><a href="/p{i}">Guide number {i}</a></div><span><b>{100 + i} EUR</b></span></div>' for i in range(5000))
    got = pages.catalog_page_offers(page(spark, f"<html><body><div>{cards}</div></body></html>")).collect()
    assert len(got) == 5000 and {(r.name, r.price) for r in got} == {(f"Guide number {i}", 100.0 + i) for i in range(5000)}


def test_noise_by_structure(spark):
    html = (
        '<main><div role="navigation">roles</div><div aria-hidden="true">unseen</div><div class="siteMenu">camel</div><div id="share-box">shared</div><p>Count of guests: 17</p><p>Channels: 16 and more</p><p>12.05.2024 10:30</p>'
        '<p>Seen on 12.05.2024 by us</p><p>We use cookies</p><p>One <b>bold</b> line</p><a href="/file.pdf">A file</a><a href="?sort=price">Sorted</a><a href="/v1.5">Version</a><a href="/page.html">A page</a><a href="/account/me">Mine</a></main>')
    r = pages.normalise_page(page(spark, html)).first()
    assert r.text.split("\n") == ["Channels: 16 and more", "Seen on by us", "One bold line", "A file", "Sorted", "Version", "A page", "Mine"]
    assert [i.u for i in r["items"]] == ["http://h/v1.5", "http://h/page.html"]
    own = pages.normalise_page(page(spark, html), pages.Noise(words=("bold",), areas=())).first().text
    assert "camel" in own and "We use cookies" in own and "bold" not in own


def test_lines_that_a_site_repeats(spark):
    rows = [(i, "a" if i < 6 else "b", f"Same on all\nOwn {i}" + ("\nOn some" if i % 3 == 0 else "")) for i in range(8)] + [(8, "a", "Same on all"), (9, None, None)]
    got = {r.page_id: r.text for r in pages.drop_site_lines(spark.createDataFrame(rows, "page_id int, host string, text string")).collect()}
    assert got[0] == "Own 0\nOn some" and got[1] == "Own 1" and got[8] == "" and got[9] == ""
    assert got[6] == "Same on all\nOwn 6\nOn some"  # a site of two pages


def test_typed_specs(spark):
    df = spark.createDataFrame([("range 100 m, 20 h, 30 g", {"Range": "80 m"}, None), ("charging case for 20 receivers 5 h 90 g", None, None), ("x", {}, 12)], "t string, specs map<string,string>, n int")
    got = [r.s for r in df.select(text.typed_specs(F.col("t"), [("uhf", "UHF")], F.col("specs"), F.col("n")).alias("s")).collect()]
    assert (got[0].range_m, got[0].battery_h, got[0].weight_g) == (80, 20, 30) and (got[1].battery_h, got[1].weight_g, got[1].capacity) == (None, None, 20) and got[2].capacity == 12


def test_page_hash_ignores_order(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"]), (["b", "a", "a"], ["x"]), (["a"], ["x"])], "l array<string>, u array<string>")
    h = [r.h for r in df.select(pages.page_hash(F.col("l"), F.col("u")).alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_round_trip_of_delimited_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", ["x"]), (2, None, [])], "Id long, ` Name` string, tags array<string>")
    imports.write_delimited(df, f"{tmp_path}/t", ";")
    back = imports.read_delimited(spark, f"{tmp_path}/t")
    assert back.columns == ["id", "name", "tags"] and {(r.id, r.name) for r in back.collect()} == {("1", "a;b"), ("2", None)}


def test_streams_over_two_file_drops(spark, tmp_path):
    schema = "offer_id long, observed_at timestamp, seq long, qty double, price double, availability string"
    rows = [[(1, "2024-01-01", 1, 1.0, 10.0, "a"), (2, "2024-01-01", 2, 1.0, 5.0, "a")], [(1, "2024-01-02", 3, 1.0, 10.0, "a"), (2, "2024-01-03", 4, 1.0, 6.0, "a"), (2, "2023-01-01", 0, 1.0, 9.0, "a")]]
    for i, r in enumerate(rows):
        x = spark.createDataFrame(r, schema.replace("timestamp", "string")).withColumn("observed_at", F.to_timestamp("observed_at"))
        x.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = jobs.read_observations(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    got = {(r.offer_id, r.seq, r.before, r.price) for r in jobs.run_to_end(jobs.price_changes(s)).collect()}
    assert {(1, 1, None, 10.0), (2, 2, None, 5.0), (2, 4, 5.0, 6.0)} == {g for g in got if g[1] > 0}


def test_keyed_state_rewrites_touched_buckets_only(spark, tmp_path):
    start = spark.range(200).select("id", F.lit(0).alias("v"))
    state = jobs.KeyedState(start, f"{tmp_path}/s", ["id"], buckets=8)
    for n in range(3):
        for _ in range(2):  # a batch that is repeated finds the rows from before it
            batch = spark.createDataFrame([(7, n), (1000 + n, n)], "id long, v int")
            touched = state.touched(batch)
            old = state.read(n, touched)
            new = old.join(batch.withColumnRenamed("v", "w"), "id", "full_outer").select("id", F.coalesce("w", "v").alias("v"))
            state.write(new.withColumn("v", F.when(F.col("id") == 7, F.coalesce(F.lit(n), "v")).otherwise(F.col("v"))), n, touched)
    got = {r.id: r.v for r in state.current().collect()}
    assert got == {**dict.fromkeys(range(200), 0), 7: 2, 1000: 0, 1001: 1, 1002: 2} and len(set(state.now.values())) > 1


@pytest.mark.parametrize("field, a, b, want", [("price", 5, 7, 1), ("range_m", 5, 7, -1), ("price", 5, 5, 0)])
def test_better_value(spark, field, a, b, want):
    assert column(spark, [a], text.better_value(field, F.col("v"), F.lit(b)), "int") == [want]


def test_dedupe_events_compares_with_kept_events(spark):
    import datetime as dt
    import random

    from quaymark.operators import news

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "event_id long, seller_id long, event_type string, name_key string, at timestamp, note string"
    run = lambda rows: {r.event_id for r in news.dedupe_events(spark.createDataFrame(rows, schema)).collect()}
    assert run([(n, 1, "new", "k", day(n), "x") for n in (0, 10, 20, 30)]) == {0, 20}
    held = [(0, 1, "new", "mic", day(0), None), (1, 1, "new", "micsystem20", day(1), None), (2, 1, "new", "alphaprime", day(1), None), (3, 1, "new", "alphaprimeblack", day(2), None),
            (4, 1, "new", "alpha", day(3), None), (5, 2, "new", "alphaprime", day(3), None), (6, 1, "gone", "alphaprime", day(3), None), (7, 1, "new", None, day(3), None), (8, 1, "new", None, day(3), None)]
    assert run(held) == {0, 2, 4, 5, 6, 7, 8}  # a short new key is not looked for inside others
    r = random.Random(1)
    names = ["a", "ab", "abcdefgh", "abcdefghij", "zzabcdefgh", "other", "otherword", "longotherword", "", None]
    rows = [(i, r.randint(1, 3), r.choice(["new", "gone"]), r.choice(names), day(r.randint(0, 90)), "x") for i in range(400)]
    saved = []
    for e in sorted(rows, key=lambda e: (e[4], e[0])):
        near = [k[3] for k in saved if k[1:3] == e[1:3] and k[3] and e[4] - k[4] <= dt.timedelta(days=14)]
        if not (e[3] and any(e[3] == k or (len(e[3]) >= 8 and (e[3] in k or k in e[3])) for k in near)):
            saved.append(e)
    assert run(rows) == {e[0] for e in saved}


def test_run_signals_holds_the_findings_of_all_five_detectors(spark, sf):
    from quaymark import plans

    rows = lambda name: plans.QUERIES[name](spark, sf).collect()
    got = rows("run_signals")
    of = lambda *kinds: {r.dedupe_key for r in got if r.finding_type in kinds}
    assert len({r.dedupe_key for r in got}) == len(got)
    assert of("multi_seller_model") == {f"multi:{r.brand}:{r.model_key}" for r in rows("signal_multi_seller_model")} != set()
    assert of("use_case_gap") == {f"usecase:{r.term}" for r in rows("signal_use_case_gap")}
    assert of("anomaly") == {f"anom:{r.term}" for r in rows("signal_demand_anomaly")} != set()
    assert of("growth", "decline") == {f"demand:{r.term}" for r in rows("signal_demand_change")}
    assert of("price_change") == {f"price:{r.offer_id}" for r in rows("signal_price_change")}
    assert of("new_category") == {f"cat:{r.category}:{r.seller_id}" for r in rows("signal_new_category")}


def test_new_links_make_a_change_real_and_become_events(spark):
    from quaymark.operators import news

    schema = "page_id long, version long, kind string, url string, lines array<string>, items array<struct<t:string,u:string>>"
    item = lambda *names: [(n, f"/{n}") for n in names]
    many = [f"system X{i}" for i in range(10)]
    rows = [
        (1, 1, "catalog", "/c", ["a line"], item("Home")), (1, 2, "catalog", "/c", ["a line", "short"], item("Home", "system Y20", "Radios")),
        (1, 3, "catalog", "/c", ["a line", "short"], [("Start", "/Home"), ("system Y20", "/system Y20"), ("Radios", "/Radios")]),
        (2, 1, "catalog", "/d", ["a line"], None), (2, 2, "catalog", "/d", ["a line"], item(*many)), (2, 3, "catalog", "/d", ["a line"], item(*many[:7])),
        (3, 1, "news", "/n", ["a line"], item("Home")), (3, 2, "news", "/n", ["a line", "big sale"], item("Home", "a publication title", "more")),
        (4, 1, "blog", "/b", ["a line"], []), (4, 2, "blog", "/b", ["a line", "words " * 12], []),
    ]
    d = news.diff_versions(spark.createDataFrame(rows, schema), "page_id", "version", "lines", "items", ["kind", "url"])
    seen = {(r.page_id, r.version): (len(r.items_added), len(r.items_removed), r.noise) for r in d.collect()}
    assert seen == {(1, 2): (2, 0, False), (1, 3): (0, 0, True), (2, 2): (10, 0, False), (2, 3): (0, 3, False), (3, 2): (2, 0, False), (4, 2): (0, 0, False)}
    kind = F.when(F.col("body").contains("sale"), "PROMOTION").when(F.col("kind") == "blog", "COMPANY_NEWS")
    e = news.classify_links(d, "kind", "url", lambda t: t.rlike("[A-Z][0-9]"), lambda t: t.rlike("^Radios$|system"), kind).collect()
    got = sorted((r.page_id, r.version, r.event_type, r.link, r.product_name, r.importance) for r in e if r.page_id != 2)
    assert got == [(1, 2, "NEW_CATEGORY", "/Radios", None, 3), (1, 2, "NEW_PRODUCT", "/system Y20", "system Y20", 3), (3, 2, "PROMOTION", "/a publication title", None, 2), (4, 2, "COMPANY_NEWS", "/b", None, 2)]
    assert [(r.version, r.event_type) for r in e if r.page_id == 2] == [(2, "NEW_PRODUCT")] * 8


def test_signature_levels_need_both_signatures(spark):
    import random

    r = random.Random(2)
    flip = lambda v, n: sum(1 << b for b in r.sample(range(62), n)) ^ v
    own = [(i, r.getrandbits(62), r.getrandbits(62)) for i in range(20)]
    found = [(100 + 20 * k + i, flip(a, n), flip(b, m)) for k, (n, m) in enumerate([(0, 0), (6, 10), (7, 10), (6, 11), (12, 16), (12, 17), (13, 0), (3, 40)]) for i, a, b in own]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, sig long, step long")
    pairs = signatures.signature_levels(frame(own), frame(found))
    want = set()
    for i, a, b in own:
        for j, c, d in found:
            n, m = (a ^ c).bit_count(), (b ^ d).bit_count()
            if n <= 12 and m <= 16:
                want.add((i, j, n, m, "same" if n <= 6 and m <= 10 else "similar"))
    assert {tuple(x) for x in pairs.collect()} == want and len(want) >= 100
    matches = spark.createDataFrame([(100, 0, 0.5, "functional", None, None)], "offer_id long, item_id long, confidence double, match_type string, reasons array<string>, review string")
    done = joins.apply_signature_matches(matches, pairs.select(F.col("id2").alias("offer_id"), F.col("id").alias("item_id"), "level")).collect()
    assert {x.offer_id for x in done} == {j for _, j, _, _, level in want if level == "same"}
    assert next(x for x in done if x.offer_id == 100)[2:5] == (0.9, "identical", ["signature same"])
