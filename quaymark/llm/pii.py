"""Personal data by patterns, and information-theoretic sanitisation (DataFrame functions only).

Patterns find the base spans; long strings of letters and digits in disorder are secrets.  Both are protected entities.
The context of an entity (kind and normalised value) is every word of each text that holds it.  Corpus statistics over all
different texts estimate how strongly a word t reveals an entity e: with counts of texts
n(t, e), n(t), n(e) and N in all, P(e | t) = n(t, e) / n(t) and
I(t; e) = log2(n(t, e) N / (n(t) n(e))).  A word over both thresholds, with enough
support, becomes a span of kind ``term`` wherever it stands in a text of that entity.
A word is a run of letters and digits that begins outside of strings that look like an entity.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent, materialise, spread_join

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET_KIND, TERM_KIND = 4, 5
SPAN = "struct<start:int,kind:int,end:int,bits:double>"
#: The four base patterns; a \G or a look-behind at their start only skips places where an
#: earlier start would match too, so that long runs are read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

LEAST_WORD = 3
LEAST_SUPPORT = 2
LEAST_SHARE = 0.5
LEAST_BITS = 3.0
#: From this many bits on a revealing word is removed, below it is generalised.
REMOVE_BITS = 12.0
#: Letters and digits without a gap, at least six of them digits and one a letter.
SECRET = r"(?<![\p{L}\p{N}])(?=[0-9]*[A-Za-z])(?=(?:[A-Za-z]*[0-9]){6})[A-Za-z0-9]{24,}+(?![\p{L}\p{N}])"
#: What looks like an entity, valid or not, or else a word as group 1.
TOKENS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    rf"|[0-9](?:[\x20-]?[0-9]){{13,}}+|{PHONE}|{SECRET}|([\p{{L}}\p{{N}}]{{{LEAST_WORD},}}+)"
)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_parts(items: Column) -> Column:
    """An array as an array of parts, each about as long as there are parts."""
    def cut(x: Column) -> Column:
        n = F.size(x)
        part = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), part), lambda i: F.slice(x, i + 1, part))

    return bound(items, cut)


def scan(items: Column, start: Column, step, kind: str) -> Column:
    """All outputs of step(state, item) -> (next state, array of outputs) in turn, as an array of the given type.

    Every step copies what it appends to; working in parts keeps these copies short.
    """
    zero = lambda at: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def one(acc, x):
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def part(acc, xs):
        return bound(F.aggregate(xs, zero(acc["at"]), one), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    return F.aggregate(in_parts(items), zero(start), part, lambda acc: acc["out"])


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())

    def step(at, x):
        begin = at + x["gap"]
        end = begin + F.length(x["hit"])
        return end, F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))

    return scan(pairs, F.lit(0), step, "array<struct<start:int,end:int,hit:string>>")


def luhn(digits: Column) -> Column:
    place = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def value(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(place, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of base spans; kind indexes KINDS."""
    digits = lambda x: F.regexp_replace(x["hit"], "[^0-9]", "")
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def of(kind: int, cheap: Column, pattern: str, keep, value) -> Column:
        hits = F.when(cheap, located(text, pattern)).otherwise(none)
        if keep is not None:
            hits = F.filter(hits, keep)
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), value(x).alias("value")))

    long_enough = lambda x: (F.length(digits(x)) >= 14) & (F.length(digits(x)) <= 19)
    return F.array_sort(F.concat(
        of(0, F.contains(text, F.lit("@")), EMAIL, None, lambda x: F.lower(x["hit"])),
        of(1, text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["hit"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"), lambda x: x["hit"]),
        of(2, text.rlike("[0-9][0-9 -]{12}"), CARD, lambda x: F.when(long_enough(x), luhn(digits(x))).otherwise(F.lit(False)), digits),
        of(3, F.contains(text, F.lit("+")), PHONE, lambda x: (F.length(digits(x)) >= 10) & (F.length(digits(x)) <= 15), digits),
    ))


def protected_spans(text: Column) -> Column:
    """Base spans and secrets: long strings of letters and digits in disorder (kind ``secret``, the method's own)."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    secret = F.transform(
        F.when(text.rlike(SECRET), located(text, SECRET)).otherwise(none),
        lambda x: F.struct(x["start"].alias("start"), F.lit(SECRET_KIND).alias("kind"), x["end"].alias("end"), x["hit"].alias("value")))
    return F.array_sort(F.concat(base_spans(text), secret))


def words(text: Column) -> Column:
    """The distinct words of a text, in lower case; what looks like an entity is none."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1)), lambda w: w != ""), F.lower))


def placed_words(text: Column) -> Column:
    """array<struct<start, end, hit>>: every word and its place."""
    found = F.zip_with(located(text, TOKENS), F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1)), lambda x, w: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(w).alias("term")))
    return F.filter(found, lambda w: w["term"] != "")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans, sanitised) per row; base and spans are array<struct<start, kind, end, bits>>.

    ``sanitised`` is the text with base spans and secrets as [KIND] and telling words as [TERM], or, from REMOVE_BITS on,
    removed; it is null where nothing changes.  Statistics count different texts, so that copies and
    repeated rows are no evidence, and rows with equal texts get equal spans whatever their ids (null ones too).
    A null text counts as empty; rows without spans have empty arrays.  Words and entities that stand in the same texts are counted as one class each, so a text's work grows
    with its length and with the product of its classes of both, not of its words and entities.
    Spans with one start are in the order of KINDS.  An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = ["_th", "_tk"]  # two 64-bit hashes stand for a text
    read = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_th"), F.xxhash64(F.lit(1), text).alias("_tk"))
    spotted = materialise(
        read.withColumn("_found", protected_spans(F.col("_text")))
        .select("_id", *same, "_found", F.when(F.size("_found") > 0, F.col("_text")).alias("_text"))
    )
    n_docs = float(max(spotted.select(*same).distinct().count(), 1))
    holding = spotted.filter(F.size("_found") > 0)
    docs = materialise(holding.groupBy(*same).agg(F.first("_found").alias("_found"), F.first("_text").alias("_text")))
    names = F.array_distinct(F.transform("_found", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), s["value"])))
    named = docs.select(*same, F.explode(names).alias("entity"))
    counted = named.groupBy("entity").agg(F.count("*").alias("n_e"))
    # n(t, e) <= n(t) bounds the bits by log2(N / n(e)): other entities, and those of one text, have no telling word
    entity_docs = materialise(counted.filter((F.col("n_e") >= LEAST_SUPPORT) & (F.log2(F.lit(n_docs) / F.col("n_e")) >= LEAST_BITS)))
    entities = materialise(spread_join(named, entity_docs, ["entity"], "_th", frequent(entity_docs, ["entity"], "n_e")))
    # entities of one set of texts share all counts, and so do words: classes of both stand for them
    mark = lambda: [F.bit_xor(F.xxhash64(*(F.lit(k), *same))) for k in (1, 2)]
    e1, e2 = mark()
    classes = materialise(entities.groupBy("entity").agg(F.count("*").alias("n_e"), e1.alias("e1"), e2.alias("e2")))
    classed = spread_join(entities.drop("n_e"), classes, ["entity"], "_th", frequent(classes, ["entity"], "n_e")).select(*same, "e1", "e2", "n_e").distinct()
    read_again = docs.join(entities.select(*same).distinct(), same)
    # a word counts once for each different text; copies collapse in each task before one of them is sent
    texts = read.groupBy(*same).agg(F.first("_text").alias("_text"))
    n_t = texts.select(F.explode(words(F.col("_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= LEAST_SUPPORT)
    spoken = read_again.select(*same, F.explode(words(F.col("_text"))).alias("term"))
    t1, t2 = mark()
    near = spoken.groupBy("term").agg(F.count("*").alias("n_h"), t1.alias("t1"), t2.alias("t2")).filter(F.col("n_h") >= LEAST_SUPPORT)
    # n(t, e) is at most the number of these texts with the word
    terms = materialise(near.join(n_t, "term").filter(F.col("n_h") >= LEAST_SHARE * F.col("n_t")))
    kept = materialise(spread_join(spoken, terms, ["term"], "_th", frequent(terms, ["term"], "n_h")))
    pair = ["t1", "t2", "e1", "e2"]
    meet = kept.select(*same, "t1", "t2").distinct().join(classed, same)
    pairs = materialise(meet.groupBy(*pair).agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= LEAST_SUPPORT))
    choice = spread_join(meet, pairs, pair, "_th", frequent(pairs, pair, "n_te")).groupBy(*same, "t1", "t2", "n_te").agg(F.min("n_e").alias("n_e"))
    bits = F.log2(F.col("n_te") * F.lit(n_docs) / (F.col("n_t") * F.col("n_e")))
    told = kept.join(choice, [*same, "t1", "t2"]).filter(F.col("n_te") >= LEAST_SHARE * F.col("n_t")).withColumn("bits", bits).filter(F.col("bits") >= LEAST_BITS)
    told = told.groupBy(*same, "term").agg(F.max("bits").alias("bits"))
    places = read_again.select(*same, F.explode(placed_words(F.col("_text"))).alias("w")).select(*same, "w.*")
    added = places.join(told, [*same, "term"]).groupBy(*same).agg(F.collect_list(F.struct("start", F.lit(TERM_KIND).alias("kind"), "end", "bits")).alias("_added"))
    joined = spread_join(spotted, added, same, "_id", frequent(holding.groupBy(*same).count(), same), "left")
    flat = F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0.0).alias("bits")))
    none = F.array().cast(f"array<{SPAN}>")
    every = joined.select("_id", "_text", flat.alias("_flat"), F.array_sort(F.concat(flat, F.coalesce("_added", none))).alias("spans"))
    return every.select(
        F.col("_id").alias(id_col), F.filter("_flat", lambda s: s["kind"] < SECRET_KIND).alias("base"), "spans",
        F.when(F.size("spans") > 0, covered(F.col("_text"), F.col("spans"))).alias("sanitised"),
    )


def covered(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; of overlapping spans the first one's mark stands for both."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(at, s):
        put = F.when((s["start"] < at) | ((s["kind"] == TERM_KIND) & (s["bits"] >= REMOVE_BITS)), F.lit("")).otherwise(F.element_at(marks, s["kind"] + 1))
        end = F.greatest(at, s["end"])
        return end, F.array(F.struct(at.alias("from"), F.greatest(at, s["start"]).alias("start"), end.alias("end"), put.alias("put")))

    def joined(cuts: Column) -> Column:
        def of(part: Column) -> Column:
            # a substring costs its distance from the start, so cuts are made in a part's own stretch of the text
            first = F.element_at(part, 1)["from"]
            stretch = F.substring(text, first + 1, F.element_at(part, -1)["end"] - first)
            pieces = lambda block: F.transform(part, lambda x: F.concat(F.substring(block, x["from"] - first + 1, x["start"] - x["from"]), x["put"]))
            return F.array_join(bound(stretch, pieces), "")

        return F.concat(F.array_join(F.transform(in_parts(cuts), of), ""), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))

    return bound(scan(spans, F.lit(0), step, "array<struct<from:int,start:int,end:int,put:string>>"), joined)


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with a column ``sanitised``; unchanged texts are repeated there, null as empty.  A column with that name is replaced."""
    own = [f"{n}_{uuid.uuid4().hex}" for n in ("text", "out")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = df.drop("sanitised").withColumn(own[0], text)
    found = find(known.select(F.col(own[0]).alias("text")).distinct().select(F.col("text").alias("id"), "text"), "id").filter(F.col("sanitised").isNotNull())
    joined = known.join(found.select(F.col("id").alias(own[0]), F.col("sanitised").alias(own[1])), own[0], "left")
    return joined.select(*(c for c in df.columns if c != "sanitised"), F.coalesce(own[1], own[0]).alias("sanitised"))
