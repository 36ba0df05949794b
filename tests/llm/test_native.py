"""Exact dedup, mixing and personal data against brute force."""

import math
import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from quaymark.llm import common, exact, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, _h long, spans string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y") for i, t, s in rows], SCHEMA).repartition(3)


ROWS = [
    (1, "a b", "s1"), (2, "ab", "s1"), (3, " a\tb\n", "s2"), (4, None, None), (5, "", "s1"), (6, " \n", "s2"), (7, "é", "s1"), (8, "e", "s1"),
    (9, "x" * 50_000, "s2"), (10, "x" * 50_000, "s3"), (10, "x" * 50_000, "s3"), (None, "x" * 50_000, "s3"), (None, "lonely", None), (11, "a b", "s1"), (12, "a\u0085b", "s1"),
]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(exact, "HOT_LEAST", hot)
    got = exact.exact_groups(frame(spark, ROWS)).collect()
    want = brute_exact(ROWS)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    kept = exact.drop_copies(frame(spark, ROWS))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.count() == len(want)
    assert exact.exact_groups(frame(spark, ROWS).limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 60))), r.choice(["a", "b", "c", "ü", None, "a", "a"])) for i in range(600)]
    rows += [(900, None, "b"), (901, "", "z"), (None, "one two", "a"), (902, "w " * 500, "c"), (902, "w " * 500, "c")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((x.doc_id or -1, x.size, x.taken) for x in got) == sorted((x.doc_id or -1, x.size, x.taken) for x in again)
    mixed = mixing.mix_rows(df)
    assert mixed.count() == sum(x.copies for x in got) and mixed.columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (name, p) in enumerate(KINDS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_pii_base(spark):
    r = random.Random(3)
    bits = ["a@b.c", "x.y+z@host-1.example.com", "@", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4785 3805 9239 1138", "4785380592391138", "+49 (30) 123-4567 89", "+1", "5", " ", "é", "\n", "-", ".", "user@", "12.34", "_", "9" * 20, "49927398716", "word", "a@b.c_d@e.f"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(700)] + [None, "", "7" * 30_000, "a" * 30_000 + "@b.c", "ab.c@" * 3000]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a@b.c", "s"), (0, texts[0], "s")])
    got = {x.doc_id: x.d for x in pii.find(df).select("doc_id", pii.digest(F.col("base")).alias("d")).collect()}
    assert got == {**{i: brute_pii(t) for i, t in enumerate(texts)}, None: brute_pii("a@b.c")}
    assert pii.find(df.limit(0)).count() == 0


def test_pii_terms(spark):
    rows = [(i, f"Contact Zebulon Quirk at zeb@quirk.org for the goods number {i}", "s") for i in range(4)] + [(10 + i, f"the goods at market number {i} for all", "s") for i in range(60)]
    found = {x.doc_id: x for x in pii.find(frame(spark, rows)).select("doc_id", pii.digest(F.col("spans")).alias("d"), pii.digest(F.col("base")).alias("b")).collect()}
    assert "term:8:15" in found[0].d and "term:16:21" in found[0].d  # the name reveals the address
    assert "goods" not in found[0].d and all(found[10 + i].d == "" for i in range(60))  # clean documents stay
    text = "Contact Zebulon Quirk at zeb@quirk.org for the goods number 0"
    assert f"term:{text.index('goods')}" not in found[0].d
    out = {x.doc_id: x.sanitised for x in pii.sanitise(frame(spark, rows).withColumn("sanitised", F.lit("old"))).collect()}
    assert "[EMAIL]" in out[0] and "Zebulon" not in out[0] and "goods" in out[0] and out[10] == rows[4][1]


WORDS = regex.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|[0-9](?:[ -]?[0-9]){13,}"
    r"|\+[0-9][ ().0-9-]+[0-9]|(?<![\p{L}\p{N}])(?=[0-9]*[A-Za-z])(?=(?:[A-Za-z]*[0-9]){6})[A-Za-z0-9]{24,}(?![\p{L}\p{N}])|([\p{L}\p{N}]{3,})")


def brute_spans(rows):
    """All spans by counting every word of every different text."""
    texts = {t or "" for _, t, _ in rows}
    n_t, n_e, n_te, facts = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for text in texts:
        entities, base = set(), []
        for k, (name, p) in enumerate(KINDS):
            for m in re.finditer(p, text):
                if f"{name}:{m.start()}:{m.end()}" in brute_pii(text).split(","):
                    base.append((m.start(), k, m.end()))
                    entities.add((name, m[0].lower() if k < 1 else m[0] if k == 1 else re.sub("[^0-9]", "", m[0])))
        for m in re.finditer(r"(?<![^\W_])[A-Za-z0-9]{24,}(?![^\W_])", text):
            if len(re.sub("[^0-9]", "", m[0])) >= 6 and re.search("[A-Za-z]", m[0]):
                base.append((m.start(), 4, m.end()))
                entities.add(("secret", m[0]))
        found = [(m.start(1), m.end(1), m[1].lower()) for m in WORDS.finditer(text) if m[1]]
        facts[text] = sorted(base), entities, found
        for t in {w for *_, w in found}:
            n_t[t] += 1
            for e in entities:
                n_te[t, e] += 1
        for e in entities:
            n_e[e] += 1
    telling = {(t, e) for (t, e), n in n_te.items() if n >= 2 and n >= n_t[t] / 2 and n * len(texts) >= 8 * n_t[t] * n_e[e]}
    out = {}
    for i, t, _ in rows:
        base, entities, found = facts[t or ""]
        out[i] = sorted(base + [(b, 5, e) for b, e, w in found if any((w, x) in telling for x in entities)])
    return out


@pytest.mark.parametrize("hot", [100_000, 1])
def test_pii_spans(spark, monkeypatch, hot):
    """A telling word counts at any distance; copies are no evidence; frequent entities, words and texts are dealt out."""
    monkeypatch.setattr(common.frequent, "__defaults__", ("count", hot))
    r = random.Random(5)
    some = lambda n: " ".join(r.choice(["goods", "market", "price", "order", "late", "12 34"]) for _ in range(n))
    rows = [(i, f"Zebulon Quirk writes. {some(40 * i)} yours zeb@quirk.org, {some(30)} zebulon", "s") for i in range(4)]
    rows += [(10 + i, f"{some(200)} Ottilie{i % 3} {some(r.randint(0, 60))} \U0001f600 o{i % 3}@host.org {some(r.randint(0, 60))} zeb@host.org", "s") for i in range(12)]
    rows += [(100 + i, f"{some(30)} quirk@else.org {i}" if i % 9 == 0 else some(30), "s") for i in range(150)]
    rows += [(300 + i, "only one lonely text names bob@copy.org", "s") for i in range(9)]  # copies
    rows += [(320 + i, f"key = 1eb9c654e721b4f812088970e66a6345cee33dd{i // 2} of Vault {some(5)} 10.0.0.{i} +49 30 1234567{i}", "s") for i in range(6)]
    rows += [(None, rows[1][1], "s"), (1, rows[1][1], "s"), (400, None, "s"), (401, "", "s"), (402, "éa@b.cd éa@b.cd", "s")]
    got = pii.find(frame(spark, rows)).select("doc_id", "spans", "sanitised").collect()
    want = brute_spans(rows)
    assert len(got) == len(rows)
    for x in got:
        assert [(s.start, s.kind, s.end) for s in x.spans] == want[x.doc_id]
        assert (x.sanitised is None) == (not x.spans)
    assert not any(s[1] == 5 for i in range(9) for s in want[300 + i]) and any(s[1] == 4 for s in want[320])
    assert sum(s[1] == 5 for v in want.values() for s in v) >= 20
    out = {x.doc_id: x.sanitised for x in got}
    assert not any("zebulon" in out[i].lower() or "Quirk" in out[i] for i in range(4)) and not any("Ottilie" in out[10 + i] for i in range(12))
    assert "1eb9c" not in out[320] and "[SECRET]" in out[320] and "[IP]" in out[320] and "[PHONE]" in out[320]
    by_id = {i: t or "" for i, t, _ in rows}
    for i, text in out.items():
        if text is not None:  # what lies outside the spans is as before
            at, kept = 0, []
            for b, _, e in want[i]:
                kept.append(by_id[i][at:max(at, b)])
                at = max(at, e)
            assert re.sub(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET|TERM)\]", "", text) == "".join(kept) + by_id[i][at:]


def test_pii_in_one_long_text(spark):
    """A mailing list of 50,000 addresses takes seconds."""
    text = " ".join(f"person{i} <p{i}@list.org>" for i in range(50_000))
    began = time.time()
    x = pii.find(frame(spark, [(1, text, "s"), (2, "p1@list.org person1", "s"), (3, "p1@list.org person1 again", "s")] + [(10 + i, f"other {i}", "s") for i in range(40)])).filter("doc_id = 1").first()
    assert sum(s.kind == 0 for s in x.spans) == 50_000 and x.sanitised.count("[EMAIL]") == 50_000
    assert sum(s.kind == 5 for s in x.spans) == 1 and time.time() - began < 100


def test_pii_in_two_versions_of_a_list(spark):
    """Twenty thousand addresses that stand in the same two texts are one class, so words and addresses do not meet one by one."""
    listed = [f"person{i} <p{i}@list.org>" for i in range(20_000)]
    rows = [(1, " ".join(listed), "s"), (2, " ".join(listed[::-1]), "s"), (3, "p1@list.org person1", "s")] + [(10 + i, f"other {i}", "s") for i in range(60)]
    began = time.time()
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).filter("doc_id < 4").collect()}
    assert time.time() - began < 60
    assert all(sum(s.kind == 5 for s in got[i].spans) == 20_000 for i in (1, 2)) and sum(s.kind == 5 for s in got[3].spans) == 1
    # a word of both lists tells of any address: one of n texts that hold both
    assert {s.bits for s in got[1].spans if s.kind == 5} == {math.log2(2 * 63 / (2 * 2)), math.log2(3 * 63 / (3 * 3))}
