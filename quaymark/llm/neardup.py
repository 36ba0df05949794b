"""Near-duplicate detection with SetSketch registers.

A document is the set of its hashed word shingles.  Register i of its sketch is
floor(1 - log_b(m_i)) cut to 0 ... q + 1, where m_i is the minimum over the set of exponential variates; sketches of
parts merge by maximum.  Equal sets (by a digest of the whole set) collapse first.  Bands of five registers propose pairs; the joint likelihood of two
sketches (how many registers are larger, equal, smaller, given both set sizes)
estimates the similarity and rejects clear misses; the full sets confirm every link.

In a bucket every member meets two leaders: the smallest id and the member that shares bands with most others.  Components of the confirmed links then show which
buckets are settled: only members of different components in one bucket meet once more, and
those of the bucket's largest component do not meet each other.  In larger buckets, shingles that
no other open document has bound how similar a member can be to any other, so most of
these pairs are never made.  A last pass over the components gives each document the smallest id that it can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import frequent, integral, materialise, spread_join
from .grams import Texts, parts

#: SetSketch parameters (base, rate of the variates, largest register) and bands times registers.
BASE, RATE, LARGEST = 1.001, 20.0, 65_534
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: A pair is dropped when its estimate is over five standard errors below the threshold.
ERRORS = 5.0
CHUNK = 300_000
#: Open buckets up to this size compare all members of different components.
FEW = 8
#: Ids up to which a table of them is broadcast (about 16 MB).
BROADCAST_IDS = 1_000_000
#: Pairs of one document beyond which they are dealt over all partitions.
LEADER_PAIRS = 10_000
#: In how many open documents a shingle counts as common.
OFTEN = 64
_random = np.random.default_rng(15485863)
FACTORS = (_random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
OFFSETS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def bounded(ids: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it is small enough, so that texts need not be shuffled; a larger one is joined by shuffles."""
    ids = materialise(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ASCII letters are lower-cased.

    A text with fewer words than k has its whole word sequence as the one shingle; one without words has none.
    """
    for a, b in parts([len(t or "") for t in texts], CHUNK):
        t = Texts(texts[a:b], lower=True)
        h = t.sequences(k)
        for first, n in zip(t.first.tolist(), t.counts.tolist()):
            if n >= k:
                yield np.unique(h[first : first + n - k + 1])
            elif n:
                # a short sequence is hashed over its own words, with its length
                x = int(n) << 56
                for j, w in enumerate(t.word_hash[first : first + n].tolist()):
                    x = (x ^ w) * (2 * j + 0x9E3779B97F4A7C15) % (1 << 64)
                yield np.array([x], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (one pair a row) with known set sizes, on a grid."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for j in np.linspace(0, 1, steps + 1):
        s = most * j
        up, down = p(u - v * s), p(v - u * s)
        ll = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = ll > best
        best, at = np.where(better, ll, best), np.where(better, s, at)
    return at


def sketch(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, whole, sketch): set size, a 256-bit digest of the whole set, and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            n, whole, regs = [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), k):
                n.append(len(s))
                whole.append(hashlib.sha256(s.tobytes()).digest())
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n_shingles", "whole", "sketch"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, whole binary, sketch binary")


def one_text(texts: DataFrame, every: DataFrame, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text) and their sets (id, ..., whole) with one text for each id that is not null: where an id's sets differ, its smallest text."""
    full = every.filter("id is not null")
    differ = materialise(full.groupBy("id").agg(F.min("whole").alias("x"), F.max("whole").alias("y")).filter("x <> y").select("id"))
    if not differ.limit(1).count():
        return texts, full
    chosen = materialise(texts.join(differ, "id", "left_semi").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    rest = lambda df: df.join(differ, "id", "left_anti")
    return rest(texts).unionByName(chosen), rest(full).unionByName(make(chosen).select(full.columns))


def leaders(pairs: DataFrame) -> dict[str, DataFrame | None]:
    """The members a and b of very many pairs."""
    return {c: frequent(pairs.groupBy(c).count(), [c], least=LEADER_PAIRS) for c in "ab"}


def with_sides(pairs: DataFrame, side_a: DataFrame, side_b: DataFrame, hot: dict[str, DataFrame | None]) -> DataFrame:
    """Pairs (a, b) with what belongs to a and to b; leaders are dealt over all partitions."""
    return spread_join(spread_join(pairs, side_a, ["a"], "b", hot["a"]), side_b, ["b"], "a", hot["b"])


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float, hot: dict[str, DataFrame | None]) -> DataFrame:
    """The pairs (a, b) that the joint likelihood does not rule out."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    margin = ERRORS * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))
    sized = (
        with_sides(pairs, side("a").drop("s_a"), side("b").drop("s_b"), hot)
        .filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).select("a", "b")
    )
    both = with_sides(sized, side("a"), side("b"), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            read = lambda c: np.frombuffer(b"".join(x.column(x.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            n = lambda c: np.array(x.column(x.schema.get_field_index(c)).to_pylist(), float)
            keep = estimate(read("s_a"), read("s_b"), n("n_a"), n("n_b")) >= threshold - margin
            yield x.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, df: DataFrame, k: int, percent: int, id_col: str, text_col: str, hot: dict[str, DataFrame | None]) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    pairs = materialise(pairs)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(bounded(wanted), "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            made = [s.tobytes() for s in shingle_sets(b.column(b.schema.get_field_index("text")).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.array(made, pa.binary())], names=["id", "items"])

    items = texts.mapInArrow(sets, "id long, items binary")
    side = lambda c: items.select(F.col("id").alias(c), F.col("items").alias(f"i_{c}"))
    both = with_sides(pairs, side("a"), side("b"), hot)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in small_batches(iter([batch]), "i_a", 1_000_000):
                left = x.column(x.schema.get_field_index("i_a")).to_pylist()
                right = x.column(x.schema.get_field_index("i_b")).to_pylist()
                ok = []
                for p, q in zip(left, right):
                    n = (len(p) + len(q)) // 8
                    common = n - len(np.unique(np.concatenate((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)))))
                    ok.append(100 * common >= percent * (n - common))
                yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def shared_sizes(members: DataFrame, sketches: DataFrame, df: DataFrame, k: int, id_col: str, text_col: str, repeated: bool = True) -> DataFrame:
    """(id, n, common, rare, mask) of the given ids.

    n is the set's size, common how many of its shingles at least OFTEN of these sets hold, rare how many others
    at least one more of them holds, and mask a 64-bit filter of the rare ones.
    """
    ids = members.select("id").distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(bounded(ids), "id", "left_semi")
    if repeated:
        texts = texts.dropDuplicates(["id"])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small_batches(iter([b]), "text", 1_000_000):
                sets = list(shingle_sets(part.column(part.schema.get_field_index("text")).to_pylist(), k))
                owner = np.repeat(np.array(part.column(part.schema.get_field_index("id")).to_pylist(), np.int64), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)), pa.array(owner)], names=["item", "id"])

    found = texts.mapInArrow(items, "item long, id long").withColumn("c", F.count("*").over(Window.partitionBy("item"))).filter("c > 1")
    often = F.col("c") >= OFTEN
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("item"), F.lit(64)).cast("int"))
    told = found.groupBy("id").agg(F.count_if(often).alias("common"), F.count_if(~often).alias("rare"), F.bit_or(F.when(~often, bit).otherwise(F.lit(0).cast("long"))).alias("mask"))
    sizes = ids.join(sketches.select("id", F.col("n_shingles").alias("n")), "id")
    return sizes.join(told, "id", "left").na.fill(0, ["common", "rare", "mask"])


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every linked id: the smallest id of its component.

    Each round gives every id the smallest label around it and then the label of that label, so
    chains shorten by halves; rounds end when no label changes.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("other"))
        nearer = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("further"))
        new = materialise(nearer.join(jump, nearer["label"] == jump["via"], "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; documents link from ``percent`` similarity of their shingle sets on.

    The smallest id of a component is kept, so there are no ties.  Null, empty and white-space texts have no
    shingles, are linked with nothing and stay; a text of any length is read whole.  Rows that repeat an id are one
    document; where their texts differ, the smallest text stands for it (each row keeps its own n_shingles); every row is returned.  Ids are integers (another type raises TypeError); a row
    with a null id links with nothing and stays.  An empty table gives an empty result; other columns are ignored.
    """
    integral(df, id_col)
    threshold = percent / 100
    every = materialise(sketch(df, k, id_col, text_col))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts, full = one_text(texts, every, lambda t: sketch(t, k, "id"))
    full = full.filter("n_shingles > 0")
    same = ["n_shingles", "whole"]
    classes = full.groupBy(*same).agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n"))
    repeated = full.groupBy("id").count().filter("count > 1").limit(1).count() > 0
    copies = materialise(classes.filter("rep < last").drop("last"))
    follows = spread_join(full.select("id", *same), copies.drop("n"), same, "id", frequent(copies, same, "n")).filter("id <> rep").select("id", "rep").distinct()
    sketches = materialise(full.join(follows.select("id"), "id", "left_anti").dropDuplicates(["id"]).select("id", "n_shingles", "sketch"))

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("sketch"), i * 2 * ROWS + 1, F.lit(2 * ROWS)))).alias("band", "part")
    keyed = sketches.select("id", band).select("id", F.xxhash64("band", "part").alias("key"))
    met = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("l1"), F.max("id").alias("l2")).filter("l1 < l2").drop("l2"))
    crowded = frequent(met, ["key"], "n")
    shared = materialise(spread_join(keyed, met, ["key"], "id", crowded))
    # whoever shares bands with most others is nearest to the middle of its group, so it leads its buckets
    fame = shared.groupBy("id").agg(F.sum("n").alias("fame"))
    placed_by_fame = shared.join(fame, "id")
    chief = placed_by_fame.groupBy("key").agg(F.max_by("id", F.struct(F.col("fame"), -F.col("id"))).alias("l3"))
    members = materialise(spread_join(shared.drop("n"), chief, ["key"], "id", crowded))

    def ordered(x: DataFrame) -> DataFrame:
        return x.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    stars = materialise(ordered(members.select(F.col("id").alias("x"), F.explode(F.array("l1", "l3")).alias("y"))))
    hot = leaders(stars)
    links = materialise(confirmed(likely(stars, sketches, threshold, hot), texts, k, percent, "id", "text", hot))
    labels = components(links)

    placed = members.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    per_label = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = per_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("size")).filter("labels > 1 and size > 2")
    open_ = materialise(spread_join(placed, main.select("key", "main", "size"), ["key"], "id", crowded).withColumn("big", F.col("label") == F.col("main")))
    sized = open_.join(shared_sizes(open_.filter(F.col("size") > FEW), sketches, texts, k, "id", "text", repeated), "id")
    # |x ∩ y| is at most what of each is not its own alone, so similarity t needs t / (1 + t) * (n_x + n_y) <= common + rare of both
    step, need = float(np.log(1.02)), threshold / (1 + threshold)
    low = F.ceil(threshold * F.col("n"))
    high = F.floor(F.least(F.col("n") / threshold, (F.col("common") + F.col("rare")) / need - F.col("n")) + 1e-6)
    rank = lambda c: F.floor(F.log(c.cast("double")) / step)
    wide = sized.withColumn("low", low).withColumn("high", high).filter("high >= low")
    facts = ("id", "label", "n", "common", "rare", "mask", "low", "high")
    outside = wide.filter(~F.col("big")).select("key", F.explode(F.sequence(rank(F.col("low")), rank(F.col("high")))).alias("class"), *(F.col(c).alias(f"x_{c}") for c in facts))
    inside = wide.select("key", rank(F.col("n")).alias("class"), "big", *(F.col(c).alias(f"y_{c}") for c in facts))
    # without a common rare shingle only the common ones can meet
    meet = F.least("x_common", "y_common") + F.when(F.col("x_mask").bitwiseAND(F.col("y_mask")) != 0, F.least("x_rare", "y_rare")).otherwise(F.lit(0))
    close = (F.col("y_n") >= F.col("x_low")) & (F.col("y_n") <= F.col("x_high")) & (F.col("x_n") >= F.col("y_low")) & (F.col("x_n") <= F.col("y_high")) & (meet + 1e-6 >= need * (F.col("x_n") + F.col("y_n")))
    apart = (F.col("x_label") != F.col("y_label")) & (F.col("big") | (F.col("x_id") < F.col("y_id")))
    crossing = outside.join(inside, (outside["key"] == inside["key"]) & (outside["class"] == inside["class"]) & apart & close).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))
    few = open_.filter(F.col("size") <= FEW)
    other = few.select("key", F.col("id").alias("y"), F.col("label").alias("ly"))
    crossing = crossing.union(few.select("key", F.col("id").alias("x"), F.col("label").alias("lx")).join(other, "key").filter("x < y and lx <> ly").select("x", "y"))
    more = ordered(crossing).join(stars, ["a", "b"], "left_anti")
    more = materialise(more)
    hot = leaders(more)
    extra = materialise(confirmed(likely(more, sketches, threshold, hot), texts, k, percent, "id", "text", hot))
    if extra.limit(1).count():
        labels = components(links.union(extra))

    own = full.select("id").distinct().join(follows, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    reach = spread_join(own, labels.withColumnRenamed("id", "rep"), ["rep"], "id", frequent(copies, ["rep"], "n"), "left").select("id", F.coalesce("label", "rep").alias("component"))
    return (
        every.select("id", "n_shingles").join(reach, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component of near copies (five-word shingles, 80 percent); same columns."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
