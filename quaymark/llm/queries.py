"""The registered queries of this subpackage and their SQL, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import align, bpe, bytedup, countjoin, exact, langid, matroska, mixing, neardup, pii, prefixes, repeats, toxicity
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytedup.remove_repeated_bytes(table(ship(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select(
        "doc_id", *map(count, range(4)), F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"),
        count(pii.SECRET_KIND), count(pii.TERM_KIND), F.size("spans").cast("long").alias("n_spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), net).select("doc_id", toxicity.held_out().alias("held_out"), "score", toxicity.predicted().alias("predicted"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary(), keep_text=False).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    media = matroska.mux(docs).select("doc_id", n, "media")
    size = F.octet_length("payload").cast("long")
    return matroska.read_back(media).select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(ship(spark), sf_dir, "documents"), k=4)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(ship(spark), sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op12_count_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.similar_sets(table(ship(spark), sf_dir, "documents"), k=4, percent=85)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = align.align(table(ship(spark), sf_dir, "documents"), vocabulary(), pieces(), digest=True)
    return made.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_language_id, op3_exact_dedup, op4_pii, op5_toxicity, op6_bpe, op7_mixing, op8_matroska, op9_near_dedup, op10_substring_dedup, op11_prefix_trie, op12_count_join, op13_token_alignment)
}

SQL = {
    # windows come from blocks of 1,000 starts, as a substring costs its distance from the start
    "op1_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
        b AS (SELECT doc_id, lo, substr(h, 2 * lo + 1, 2198) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 1000)) AS lo FROM d)),
        w AS (SELECT doc_id, lo + i AS pos, md5(substr(part, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, lo, part, unnest(range(0, least(1000, length(part) // 2 - 99))) AS i FROM b)),
        f AS (SELECT k, min(struct_pack(doc_id, pos)) AS first FROM w GROUP BY k HAVING count(*) > 1),
        again AS (SELECT w.doc_id, w.pos FROM w JOIN f USING (k) WHERE struct_pack(doc_id := w.doc_id, pos := w.pos) > f.first),
        o AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
        r AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 100 AS hi FROM o GROUP BY 1, 2),
        g AS (SELECT doc_id, run, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_, lo AS to_, hi - lo AS gone FROM r UNION ALL SELECT doc_id, 1e9, max(hi), 1e9, 0 FROM r GROUP BY doc_id),
        c AS (SELECT d.doc_id, sum(gone)::BIGINT AS n_removed, count(*) - 1 AS n_spans, string_agg(substr(h, (2 * from_ + 1)::BIGINT, (2 * (to_ - from_))::BIGINT), '' ORDER BY run) AS kept FROM d JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id""",
    "op9_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS k FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, min(c) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_count_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS k FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT c, count(*) AS n, list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda u, v: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))) AS crc FROM t GROUP BY c),
        h AS (SELECT a.c, a.c - a.c % 20 AS base, a.n, (xor(crc, 4294967295::UBIGINT) % 4)::BIGINT AS h, coalesce((SELECT n FROM ids b WHERE b.c = a.c - a.c % 20), 0) AS nb FROM ids a),
        r AS (SELECT h.c, t.pos AS d, role, text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h UNION ALL SELECT h.c, t.pos - h.h + least(h.h, nb), role, text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
        p AS (SELECT c, d, string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS raw, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
        q AS (SELECT c, d, md5(raw) AS k, w FROM p UNION ALL SELECT c, 0, '', 0 FROM h),
        f AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) = d AS final FROM q),
        nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(w) AS w, string_agg(CASE WHEN final THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM f GROUP BY d, k),
        kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
        full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
        reach AS (SELECT DISTINCT a.d, a.k, b.d AS d2, b.k AS k2 FROM f a JOIN f b ON a.c = b.c AND a.d <= b.d),
        below AS (SELECT reach.d, reach.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM reach JOIN full_ v ON v.d = reach.d2 AND v.k = reach.k2 GROUP BY 1, 2)
        SELECT a.conv_id, a.d AS depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
        FROM full_ a JOIN below USING (d, k) LEFT JOIN full_ u ON u.d = a.d - 1 AND u.k = a.up""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
                     [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
        l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                     / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s),
        t AS (SELECT source, source_size, CASE WHEN cap <= weight * water THEN cap::DOUBLE ELSE weight * water END AS target FROM (SELECT *, max(level) OVER () AS water FROM l)),
        r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.target >= t.source_size THEN 1 ELSE 0 END AS base,
                     t.target - CASE WHEN t.target >= t.source_size THEN t.source_size ELSE 0 END AS room,
                     sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS n
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (base + CASE WHEN upto <= room OR (upto - n <= room AND 2 * (room - (upto - n)) >= n) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) AS k FROM p),
        f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) < doc_id AS again FROM g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM f WHERE again),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
        cut AS (SELECT word.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN x END, ' ' ORDER BY word.pos), '') AS kept
                FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id""",
}
