"""Prefix trie, count-vector join and token alignment against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quaymark.llm import align, countjoin, neardup, prefixes, queries
from quaymark.shipping import ship
from tests.llm.test_repeats import brute_near

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_trie(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + mine[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) > len(q) for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if made[c] == p)))
        parent = min(nodes[p[:-1]]) if p else None
        out[p] = (min(members), len(p), parent, len(members), len(children), len(leaves), saved, sha(ends))
    return sorted(out.values(), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, weight int"


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefixes.trie(df).collect()), key=str)


def test_trie(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in [*range(70), -3, -25, 1000]:
        for t in range(rng.randrange(0, 6) if c % 7 else 9):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "a  b\tc", "long " * 300])))
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, "user", "x"), (2, 1, "user", "tie"), (2, 1, "user", "Tie"), (2, 1, None, "tie")]
    want = brute_trie(rows)
    assert trie_rows(spark, rows) == want
    monkeypatch.setattr(prefixes, "PIECE", 2)
    from quaymark.llm import common

    monkeypatch.setattr(prefixes, "frequent", lambda df, keys, count="count", least=0: common.frequent(df, keys, count, 3))
    assert trie_rows(spark, rows) == want


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(0, t, "user", f"turn {t % 50}") for t in range(300)] + [(20 * c, t, "user", f"turn {t}") for c in range(1, 120) for t in range(2)]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, []) == []


def test_trie_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op11_prefix_trie"](spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def docs_frame(spark, rows):
    return ship(spark).createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int")


def near_texts(rng):
    """Families of near copies at all distances around the threshold, common passages and odd texts."""
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n", "one", "one two", "ONE two", "one two three four", "one two three four five", "a a a a a a a"]
    for size in (8, 12, 20, 40, 90, 300, 900):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(size)]
            if size == 90:
                base[:60] = passage
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, max(1, size // 60), max(1, size // 45), size // 20):
                x = list(base)
                for _ in range(edits):
                    x[rng.randrange(len(x))] = rng.choice(vocabulary)
                if rng.random() < 0.3:
                    x = x[: max(4, int(len(x) * rng.uniform(0.84, 1)))]
                texts.append(" ".join(x).upper() if rng.random() < 0.2 else "  ".join(x))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(12)]) for _ in range(150)]  # open buckets of many components
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_count_join(spark, percent):
    rows = list(enumerate(near_texts(random.Random(percent))))
    rows += [(None, "one two three four"), rows[30], rows[31]]
    got = countjoin.similar_sets(docs_frame(spark, rows), 4, percent).collect()
    want = brute_near([r for r in rows if r[0] is not None], 4, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: x[:2] for i, x in want.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_count_join_searches_trees_of_several_levels(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(400):  # one bucket of many components: each shares most with the base, and a few words with some others
        x = list(base)
        for at in rng.sample(range(60), 4 if i % 3 else 2):
            x[at] = rng.choice(vocabulary[: 40])
        rows.append((i, " ".join(x)))
    monkeypatch.setattr(countjoin, "FAN", 4)
    levels = []
    real = countjoin.pack
    monkeypatch.setattr(countjoin, "pack", lambda df, leaf: levels.append(leaf) or real(df, leaf))
    got = countjoin.similar_sets(docs_frame(spark, rows), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: x[:2] for i, x in brute_near(rows, 4, 85).items()}
    assert levels.count(False) >= 1


def test_summed_minima_never_rule_out_a_link(spark):
    """The bound is at least the true overlap at any folding."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (5, 50, 500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        p, q = countjoin.group_counts(a), countjoin.group_counts(b)
        groups = min(len(p), len(q))
        assert p.sum() == len(a) and np.minimum(countjoin.fold(p, groups), countjoin.fold(q, groups)).sum() >= len(np.intersect1d(a, b))
        sizes = countjoin.Sizes(85)
        assert set(np.concatenate([*sizes.keys(a), np.zeros(0, np.uint64)]).tolist()) & set(np.concatenate([*sizes.keys(b), np.zeros(0, np.uint64)]).tolist()) or n == 5


@pytest.mark.parametrize("join", ["near", "count"])
def test_repeated_ids_with_different_texts(spark, join):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, None)]
    f = (lambda df: neardup.near_duplicates(df, 4)) if join == "near" else (lambda df: countjoin.similar_sets(df, 4))
    got = f(docs_frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 7, 1), (1, 7, 1), (2, 7, 2), (3, 7, 1), (3, 7, 1), (4, 0, 4)]
    empty = f(docs_frame(spark, []))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def brute_align(texts):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        chars[chr(b) if b in plain else chr(256 + len([x for x in range(b) if x not in plain]))] = b
    docs, total = [], {}
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        raw_a = [bytes(chars[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [align.piece_bytes(b_model.id_to_piece(i)) for i in b]
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(None)
            continue
        spans = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))]
        sa, sb = spans(raw_a), spans(raw_b)
        links = [(x, y) for x, (p, q) in zip(a, sa, strict=True) for y, (r, s) in zip(b, sb, strict=True) if max(p, r) < min(q, s)]
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for e in shared:
            pick = lambda ids, at: ",".join(str(i) for i, (p, q) in zip(ids, at, strict=True) if p >= low and q <= e)  # noqa: B023, E731
            groups.append(pick(a, sa) + "|" + pick(b, sb))
            low = e
        for x in links:
            total[x] = total.get(x, 0) + 1
        docs.append((len(a), len(b), groups, links))
    most = {}
    for (_, y), n in total.items():
        most[y] = max(n, most.get(y, 0))
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(total[x] == most[x[1]] for x in d[3]), sum(total[x] for x in d[3]), ";".join(d[2])) for d in docs]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n a", "a  b c", "a   b", "x▁y", "<|endoftext|> a <s> b</s>", "naïve café — 東京 🙂🙂", "'s don't  I'll", "\x00\x1f a", "a\x1c b\x85 c",
    "1234 567,89", "tab\tand\r\nlines \n\n x", "ab" * 300, "﻿x", "é ﬁ Å", "same words same words same words", "same words same words same words", "<0x41> A",
]


def test_alignment(spark):
    docs = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY length(text) LIMIT 60").fetchall()]
    texts = ODD + docs
    want = brute_align(texts)
    df = docs_frame(spark, [*enumerate(texts), (None, "an id that is null")])
    vocabulary, pieces = queries.vocabulary(), queries.pieces()
    want = brute_align([*texts, "an id that is null"])
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for most in (1_000_000, 0):  # counts by broadcast, and by shuffles
        got = {r.doc_id: tuple(r[c] for c in columns) for r in align.align(df, vocabulary, pieces, broadcast_pairs=most).collect()}
        assert [got[i] for i in [*range(len(texts)), None]] == want
    assert align.align(docs_frame(spark, []), vocabulary, pieces).collect() == []


def test_alignment_forgets_and_survives_equal_hashes(spark, monkeypatch):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY length(text) LIMIT 60").fetchall() if t]
    monkeypatch.setattr(align, "MEMO", 50)
    aligner = align.Aligner(align.Pair(queries.vocabulary(), queries.pieces()), False)
    want = [x[:4] + x[6:] for x in brute_align(texts)]
    step = lambda: [tuple(r) for at in range(0, len(texts), 20) for r in zip(*(c.to_pylist() for c in aligner.batch(texts[at : at + 20])[:5]), strict=True)]
    assert step() == want
    import numpy as np

    monkeypatch.setattr(align, "mix", lambda x: np.zeros_like(x))
    assert step() == want


def test_alignment_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_token_alignment"](spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got.keys() == {i for i, _ in docs}
    for i, t in docs[:40]:
        whole = brute_align([t])[0]
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links) == whole[:4] and got[i].groups_sha256 == (sha(whole[6]) if whole[6] else "")
        assert got[i].n_best <= got[i].n_links <= got[i].count_sum
