"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations collapse into one weighted sequence with its list of ends.  A sequence that is a proper prefix of
another one goes by an anti-join, what remains are the leaves.  Prefixes of weighted sequences are then aggregated
into nodes.  A prefix is known by its length and 128 bits: the exclusive or of a hash of each turn and its place, so a
running window gives all prefixes of a conversation, and a conversation may be spread over many partitions.

Sums over subtrees need no walk: n - 1 times words, summed over a subtree, is the words of all members from the node's depth on,
less the words of its distinct nodes.  Each node counts as owned by its smallest member; what a member owns
are the last nodes of its path, so both sums are sums over the sequences through a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, frequent, integral, materialise, partitions, spread_join

#: Conversations that share the first turns of the one whose id is divisible by this, and the number of turns that may be shared.
FAMILY, SHARED = 20, 4
#: Ids in one piece of an end list.
PIECE = 100_000
NODE = ["depth", "x1", "x2"]


def turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, part, place, d1, d2, words): the turns of each conversation, numbered from 1 in order of turn (null first), then role, then text.

    Turns are dealt out by range, so a conversation of any length spreads over partitions; the numbers of a conversation's
    rows in earlier partitions come from counts.
    """
    integral(df, id_col)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    dealt = rows.repartitionByRange(partitions(df.sparkSession), "conv", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("conv", "turn", "role", "text")
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it below
    kept = materialise(dealt.select("conv", at.alias("at"), F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    kept = kept.withColumn("part", F.shiftright("at", 33))
    counts = kept.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("conv", "part", (before - F.col("first") + 1).alias("shift"))
    return kept.join(starts, ["conv", "part"]).select("conv", "part", (F.col("at") + F.col("shift")).alias("place"), "d1", "d2", "words")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, and (conv, n_turns): the first turns of the family's first one, then the conversation's own later ones."""
    sizes = materialise(placed.groupBy("conv").agg(F.count("*").alias("n")))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    first = F.col("conv") - F.col("conv") % FAMILY
    other = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.select("conv", "n", head.alias("h"), first.alias("base")).join(other, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("given"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    plan = materialise(plan.withColumn("n_turns", F.col("given") + F.col("own")))
    of = plan.select("conv", "h", "given")
    mine = spread_join(placed, of, ["conv"], "place", frequent(sizes, ["conv"], "n")).filter(F.col("place") > F.col("h"))
    mine = mine.select("conv", "part", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "d1", "d2", "words")
    heads = placed.filter((F.col("conv") % FAMILY == 0) & (F.col("place") < SHARED)).withColumnRenamed("conv", "base")
    theirs = heads.join(plan.select("conv", "base", "given"), "base").filter(F.col("place") <= F.col("given"))
    return mine.unionByName(theirs.select("conv", F.lit(-1).cast("long").alias("part"), F.col("place").alias("depth"), "d1", "d2", "words")), plan.select("conv", "n_turns")


def prefixes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, p1, p2, words, rest, n_turns) of every prefix of every conversation, that of no turns included.

    x1 and x2 are the prefix' bits, p1 and p2 those of the prefix before it; rest counts the words from this depth on.
    """
    t1, t2 = F.xxhash64("d1", "depth", "d2"), F.xxhash64(F.lit(2), "d2", "d1", "depth")
    rows = materialise(rows.select("conv", "part", "depth", t1.alias("t1"), t2.alias("t2"), "words"))
    sums = rows.groupBy("conv", "part").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"), F.sum("words").alias("sw"))
    by = Window.partitionBy("conv")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = sums.select(
        "conv", "part", *(F.coalesce(F.bit_xor(f"s{k}").over(before), zero).alias(f"b{k}") for k in (1, 2)), F.coalesce(F.sum("sw").over(before), zero).alias("bw"), F.sum("sw").over(by).alias("all_words"))
    starts = starts.join(plan, "conv")
    upto = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", F.bit_xor("t1").over(upto).alias("r1"), F.bit_xor("t2").over(upto).alias("r2"), F.sum("words").over(upto).alias("rw")).join(starts, ["conv", "part"])
    x = lambda k: F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}"))
    some = run.select(
        "conv", "depth", x(1).alias("x1"), x(2).alias("x2"), x(1).bitwiseXOR(F.col("t1")).alias("p1"), x(2).bitwiseXOR(F.col("t2")).alias("p2"), "words",
        (F.col("all_words") - F.col("rw") - F.col("bw") + F.col("words")).alias("rest"), "n_turns")
    none = plan.join(sums.groupBy("conv").agg(F.sum("sw").alias("rest")), "conv", "left")
    return some.unionByName(none.select("conv", zero.alias("depth"), *(zero.alias(c) for c in ("x1", "x2", "p1", "p2", "words")), F.coalesce("rest", zero).alias("rest"), "n_turns"))


def end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of each node's ids in ascending order, joined by commas.

    Ids are sorted over all partitions and joined to pieces of at most PIECE ids there; only pieces meet, and are hashed as they stream by.
    """
    key = [*NODE, "conv"]
    dealt = ends.select(*key).repartitionByRange(partitions(ends.sparkSession), *key).sortWithinPartitions(*key)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[str] = []
        first = 0
        for b in batches:
            out = []
            for *node, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                node = tuple(node)
                if node != held or len(ids) >= PIECE:
                    if ids:
                        out.append((*held, first, ",".join(ids)))
                    held, ids, first = node, [], conv
                ids.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*key, "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, first, ",".join(ids))], names=[*key, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*NODE, "ends_sha256"])
        for b in batches:
            out = []
            for *node, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                node = tuple(node)
                if node != held:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pack(out)
        if held is not None:
            yield pack([(*held, state.hexdigest())])

    made = dealt.mapInArrow(pieces, "depth long, x1 long, x2 long, conv long, ids string")
    return made.repartition(*NODE).sortWithinPartitions(*key).mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every conversation is rebuilt first: it gets the first h turns of the conversation ``id - id % 20`` in place of its own first h (h from the id's crc32).
    Turns go by ``turn`` (null first), those equal in it by role and text; a null role or text counts as empty; repeated rows are turns of their
    own; texts of any length are hashed whole.  Rows with a null id belong to no conversation; ids of another type than integer
    raise TypeError.  A conversation without turns is a member of the root alone.  An empty table has no nodes; other columns are ignored.
    """
    rows, plan = rebuilt(turns(df, id_col))
    every = materialise(prefixes(rows, plan))
    ends = every.filter("depth = n_turns").select(*NODE, "conv")
    sequences = materialise(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("conv")))
    long = frequent(plan, ["conv"], "n_turns")
    weighted = materialise(spread_join(every, sequences.select("conv", "weight"), ["conv"], "depth", long))
    nodes = materialise(weighted.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.col("weight") * F.col("rest")).alias("heard")))

    inner = weighted.filter("depth < n_turns").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy("conv").agg(F.min("depth").alias("from_depth"), F.sum("words").alias("owned"))
    facts = leaves.join(owned, "conv", "full_outer")
    own_words = F.when(F.col("depth") < F.col("from_depth"), F.col("owned")).when(F.col("from_depth").isNotNull(), F.col("rest")).otherwise(0)
    below = spread_join(weighted, facts, ["conv"], "depth", long).groupBy(*NODE).agg(F.count("leaf").alias("n_leaves"), F.sum(own_words).alias("distinct_words"))

    children = materialise(nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children")))
    above = ["up", "p1", "p2"]
    many = children.select(*(F.col(c).alias(k) for c, k in zip(NODE, above, strict=True)), "n_children")
    parents = nodes.select(F.col("depth").alias("up"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    full = nodes.join(children, NODE, "left").join(below, NODE, "left").join(end_lists(ends), NODE, "left").withColumn("up", F.col("depth") - 1)
    found = spread_join(full, parents, above, "x1", frequent(many, above, "n_children"), "left")
    count: Column = F.coalesce("n_children", F.lit(0)).cast("long")
    return found.select(
        F.col("conv").alias(id_col), "depth", "parent_conv_id", "n_convs", count.alias("n_children"), F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        (F.col("heard") - F.coalesce("distinct_words", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
