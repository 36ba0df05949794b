"""The registered queries: their contract columns by brute force, and their SQL in DuckDB."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaymark.llm import matroska, pii, queries
from tests.llm.test_native import brute_pii, brute_spans
from tests.llm.test_repeats import brute_bytes, brute_near, brute_words

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    out = con.execute(queries.SQL[name])
    at = [[d[0] for d in out.description].index(n) for n in names]
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=key)


def test_op1(spark, docs):
    want = brute_bytes([(i, t) for i, t, _ in docs])
    got = rows_of(spark, "op1_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (a, b, c, sha(d)) for i, (a, b, c, d) in want.items()}


def test_op2_and_op5(spark, docs):
    text = {i: t for i, t, _ in docs}
    for name, k, held in (("op2_language_id", 5, 0), ("op5_toxicity", 3, 1)):
        got = rows_of(spark, name)
        assert got.keys() == text.keys()
        for i, r in got.items():
            assert r.held_out == (zlib.crc32(str(i).encode()) % k == held) and 0 <= r.score <= 1
            if name[2] == "5":
                assert r.predicted == int(r.score >= 0.7)
            else:
                assert (r.lang_pred == "und") == (not any(map(str.isalpha, text[i] or "")))


def test_op4(spark, docs):
    got, want = rows_of(spark, "op4_pii"), brute_spans(docs)
    for i, t, _ in docs:
        base = brute_pii(t)
        r, kinds = got[i], [x.split(":")[0] for x in base.split(",")]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, ("email", "ip", "card", "phone"))) and r.base_sha256 == sha(base)
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{b}:{e}" for b, k, e in want[i]) and r.n_spans == len(want[i])
        assert (r.sanitised_sha256 is None) == (not want[i])


def test_op6(spark, docs):
    library, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows_of(spark, "op6_bpe")
    for i, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op8(spark, docs):
    got = rows_of(spark, "op8_matroska")
    for i, t, _ in docs:
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload) and re.fullmatch("[0-9a-f]{64}", r.media_sha256)
        media = matroska.mux_bytes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media)) and payload[:64] in media  # samples lie in the file as they are
        facts = dict(x.split("=", 1) for x in r.feature.split(";") if "=" in x)
        assert (int(facts["min"]), int(facts["max"]), facts["bad_cues"]) == (min(payload), max(payload), "0") and int(facts["ms"]) == round(len(payload) * 1000 / matroska.SAMPLE_RATE)
        assert int(facts["clusters"]) >= 1 and int(facts["packets"]) >= len(payload) / 65_536


def test_op9_and_op10(spark, docs):
    pairs = [(i, t) for i, t, _ in docs]
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in rows_of(spark, "op9_near_dedup").items()} == brute_near(pairs, 4)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in rows_of(spark, "op10_substring_dedup").items()} == {i: (a, b, sha(c)) for i, (a, b, c) in brute_words(pairs).items()}
