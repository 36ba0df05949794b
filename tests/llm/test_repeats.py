"""Word and byte repeats, suffix arrays and near duplicates against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quaymark.llm import bytedup, common, neardup, repeats, suffix
from quaymark.llm.common import table

SCHEMA = "doc_id long, text string, group int, id string, sketch int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(spark, sf):
    found = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    extra = ["", None, "a", " \t\n " * 50, "!" * 5000, "!" * 3000 + "x" * 300, "ab" * 700 + " ab" * 300, found[5][1][200:600] * 4, "é" * 400, found[7][1] + " " + found[8][1], "w " * 40 + "x y z " * 30, " ".join("abc" * 40)]
    return found + [(100_000 + k, t) for k, t in enumerate(extra)]


def test_suffix_arrays(monkeypatch):
    r = random.Random(3)
    for trial in range(150):
        n, k = r.randint(1, 60), r.choice([1, 2, 3, 26, 255])
        s = [r.randint(1, k) for _ in range(n)]
        s = (s[:7] * 20)[:n] if trial % 3 == 0 else s
        a, t = np.array([*s, 0]), [*s, 0]
        want = sorted(range(n + 1), key=lambda i: t[i:])
        sa = suffix.suffix_array(a)
        assert sa.tolist() == want
        for form in (0, 10**9):  # both forms of induction at every level
            monkeypatch.setattr(suffix, "DENSE", form)
            assert suffix.suffix_array(a).tolist() == want
        monkeypatch.undo()
        plcp = suffix.common_prefixes(a, sa, 10)
        for i, j in zip(want[1:], want):
            n_same = next((x for x in range(10) if t[i + x] != t[j + x]), 10)
            assert plcp[i] == n_same


def test_suffix_array_of_long_text():
    """Many names at several levels of the recursion."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdé ") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = " ".join(r.choice(words) for _ in range(12_000)).encode()
    sa = suffix.suffix_array(np.append(np.frombuffer(text, np.uint8).astype(np.int64), 0))
    assert sorted(sa.tolist()) == list(range(len(text) + 1))
    for i, j in zip(sa[1:].tolist(), sa[2:].tolist()):
        assert text[i : i + 400] <= text[j : j + 400]


def brute_bytes(rows):
    first, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - 99):
            k = hash(b[p : p + 100])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[hash(b[p : p + 100])] < (i, p):
                gone[p : p + 100] = b"\1" * 100
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, y in zip(b, gone) if not y))
    return out


@pytest.mark.parametrize("hot", [5000, 1])
def test_bytes(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(bytedup, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in bytedup.remove_repeated_bytes(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows)


def brute_words(rows):
    first, words = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out[i] = (len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y))
    return out


@pytest.mark.parametrize("few", [48, 2, 0])
def test_words(spark, rows, monkeypatch, few):
    monkeypatch.setattr(repeats, "FEW", few)
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == brute_words(rows)
    for i, r in got.items():
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed


def test_repeats_with_odd_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (5, t), (None, t), (9, t), (None, "short")]
    got = sorted((r.doc_id or 99, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == [(5, 0), (5, 0), (9, 40), (99, 0), (99, 40)]
    size = len(t.encode())
    got = sorted((r.doc_id or 99, r.n_removed) for r in bytedup.remove_repeated_bytes(frame(spark, rows)).collect())
    assert got == [(5, 0), (5, 0), (9, size), (99, 0), (99, size)]
    for bad in (repeats.remove_repeats, bytedup.remove_repeated_bytes):
        with pytest.raises(TypeError):
            bad(spark.createDataFrame([("x", "y")], "doc_id string, text string"))
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    assert bytedup.remove_repeated_bytes(frame(spark, rows).limit(0)).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_near(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    parent, where = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = defaultdict(int)
    for i, s in sets.items():
        for x in s:
            for j in where[x]:
                common[j, i] += 1
            where[x].append(i)
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, rows, k):
    r = random.Random(1)
    base = [f"v{r.randint(0, 10**6)}" for _ in range(120)]
    copies = []
    for i in range(60):  # a chain of near copies, each with one more change
        base = list(base)
        base[r.randrange(120)] = f"n{i}"
        copies.append((200_000 + i, " ".join(base)))
    short = [(300_000, "Only Two"), (300_001, "only two"), (300_002, "only three words"), (300_003, "ÀB c d e"), (300_004, "àB c d e")]
    every = rows + copies + short
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(frame(spark, every), k=k).collect()}
    assert got == brute_near(every, k)


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    """All documents of a larger table, with members of many pairs dealt out."""
    monkeypatch.setattr(neardup, "LEADER_PAIRS", 3)
    monkeypatch.setattr(common.frequent, "__defaults__", ("count", 1))
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()], 5)


def test_near_duplicates_with_odd_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    got = sorted((r.doc_id or 99, r.component_id or 99, r.kept) for r in neardup.near_duplicates(frame(spark, [(5, t), (5, t), (None, t), (9, t), (8, None)])).collect())
    assert got == [(5, 5, True), (5, 5, True), (8, 8, True), (9, 5, False), (99, 99, True)]
    assert neardup.near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_joint_estimate():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[400:2400]
    s = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(s[0] - 1600 / 2400) < 0.15
    assert (np.maximum(neardup.registers(pool[:1500]), neardup.registers(pool[1000:])) == neardup.registers(pool)).all()
