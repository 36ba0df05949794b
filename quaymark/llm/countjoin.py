"""Similarity join of word shingle sets by count vectors in R-trees.

A set's shingles are hashed into groups (ranges of the hash); the counts of the groups are a point.  Two sets have no more in
common than the sum of the smaller count in each group, so near sets are near points.  Equal sets collapse first.

Points close enough to link coincide in most runs of neighbouring groups: cut into more runs than two linked sets can
differ in, at least one of the fullest runs is the same in both.  Such a run names a bucket, so buckets are the top of the index and
an equi join finds them.  In a bucket every member meets two leaders (the smallest id, and the member that meets most others); what has not linked to the bucket's largest component then
meets further members of it, one a round, as long as that links enough; what is left open is searched with an R-tree: points packed into nodes of FAN entries, level by level, each with the largest count of every group.  A query goes
down from the root, one join a level, and leaves out nodes whose summed minima are too small or whose points all belong to its own
component.  The full sets of the pairs that are left confirm every link.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import frequent, integral, materialise, partitions, spread_join
from .grams import U, mix
from .neardup import bounded, components, confirmed, leaders, one_text, shingle_sets, with_sides

#: Sizes of sets are cut into classes of this ratio, from this size on.
RATIO, LEAST = 1.6, 2
#: Entries of a node, and groups of the nodes over the leaves.
FAN, COARSE = 64, 32
#: Least and most groups of a point; between them there are one to two for each shingle, so that two different ones seldom share a group.
GROUPS = (32, 16_384)
#: Rounds in which what is left of a bucket meets another member of its largest component, and the share that must link for one more.
ROUNDS, WORTH = 2, 0.2
#: Shingles between two yields of keys.
CHUNK = 300_000


class Sizes:
    """Classes of set sizes, and for each the number of runs: differ is how many shingles two linked sets up to its top can differ in."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        starts = [LEAST]
        while starts[-1] < most:
            starts.append(max(starts[-1] + 1, int(np.ceil(starts[-1] * max(RATIO, 101 / percent)))))
        self.starts = np.array(starts, np.int64)

    def differ(self, k: int) -> int:
        return 2 * (int(self.starts[k + 1]) - 1) * (100 - self.percent) // (100 + self.percent)

    def classes(self, n: int) -> list[int]:
        """The class of a size, and the next one if a set of that class can link to it."""
        k = int(np.searchsorted(self.starts, n, side="right")) - 1
        if k < 0:
            return []
        return [k, k + 1] if 100 * n >= self.percent * int(self.starts[k + 1]) else [k]

    def keys(self, items: np.ndarray) -> Iterator[np.ndarray]:
        """Bucket keys of a sorted set, for each of its classes: its fullest runs, as many as linked sets can differ in and one more.

        Linked sets share all but ``differ`` runs, a third more of which are made than are used; as equal runs are equally full, the used ones of both share one.
        """
        values = mix(items)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        for k in self.classes(len(items)):
            differ = self.differ(k)
            if not differ:
                continue  # only equal sets link
            runs = differ + 1 + differ // 3
            edges = (np.arange(1, runs, dtype=np.float64) * (2.0**64 / runs)).astype(np.uint64)
            at = np.concatenate(([0], np.searchsorted(items, edges), [len(items)]))
            fullest = np.argsort(-np.diff(at), kind="stable")[: differ + 1]
            yield mix((sums[at[fullest + 1]] - sums[at[fullest]]) ^ mix(fullest.astype(np.uint64) + U((k + 1) << 40)))


def group_counts(items: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its hashes fall into each of a power of two of ranges."""
    groups = min(max(1 << len(items).bit_length(), GROUPS[0]), GROUPS[1])
    shift = U(64 - groups.bit_length() + 1)
    return np.bincount((items >> shift).astype(np.int64), minlength=groups).astype(np.uint16)  # 65,535 in a group take a text of over 2 GB


def packed(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes: most are 0 or 1."""
    return zlib.compress(counts.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint16)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts with neighbouring groups added up."""
    return points if points.shape[-1] == groups else points.reshape(*points.shape[:-1], groups, -1).sum(-1, dtype=np.uint32)


def can_link(overlap: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    return (100 + percent) * overlap.astype(np.int64) >= percent * (n_x + n_y)


def shingles(df: DataFrame, k: int) -> DataFrame:
    """(id, n_shingles, whole): set size and a 256-bit digest of the set of each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            sets = list(shingle_sets(b.column(1).to_pylist(), k))
            n, whole = pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), n, whole], names=["id", "n_shingles", "whole"])

    return df.mapInArrow(run, "id long, n_shingles long, whole binary")


def bucket_keys(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, id) for each bucket of each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        pack = lambda ids, keys: pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in keys]))], names=["key", "id"])
        for b in small_batches(batches, "text"):
            ids, keys, held = [], [], 0
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), k), strict=True):
                for x in sizes.keys(s):
                    ids.append(i)
                    keys.append(x)
                    held += len(x)
                if held > CHUNK:
                    yield pack(ids, keys)
                    ids, keys, held = [], [], 0
            if keys:
                yield pack(ids, keys)

    return texts.mapInArrow(run, "key long, id long")


def points(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, point) of each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            sets = list(shingle_sets(b.column(1).to_pylist(), k))
            made = pa.array([packed(group_counts(s)) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), made], names=["id", "n", "point"])

    return texts.mapInArrow(run, "id long, n long, point binary")


def column(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def within_bound(pairs: DataFrame, at: DataFrame, percent: int, hot: dict[str, DataFrame | None]) -> DataFrame:
    """The pairs (a, b) whose summed minima allow a link."""
    side = lambda c: at.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in small_batches(iter([batch]), "p_a"):
                overlap = []
                for x, y in zip(column(b, "p_a"), column(b, "p_b"), strict=True):
                    p, q = unpacked(x), unpacked(y)
                    groups = min(len(p), len(q))
                    overlap.append(int(np.minimum(fold(p, groups), fold(q, groups)).sum(dtype=np.int64)))
                ok = can_link(np.array(overlap, np.int64), np.array(column(b, "n_a"), np.int64), np.array(column(b, "n_b"), np.int64), percent)
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    sized = with_sides(pairs, side("a").drop("p_a"), side("b").drop("p_b"), hot).filter(close).select("a", "b")
    return with_sides(sized, side("a"), side("b"), hot).mapInArrow(run, "a long, b long")


NODE = "key long, node long, place long, size int, entries binary, lows binary, highs binary, labels binary, counts binary, low long, high long, label long, upper binary"


def pack(dealt: DataFrame, leaf: bool) -> DataFrame:
    """Nodes of up to FAN neighbours of one key and place in sorted partitions; each holds what its entries need and bounds for the level above.

    Entries of a leaf are (id, n, n, label, point), those of other nodes (node, low, high, label, upper).  A label of -1 stands for several.
    A leaf's place is its number in its partition, with the partition in the upper bits; other nodes keep the place that their entries share.
    """
    dealt = dealt.select("key", "place", "entry", "low", "high", "label", "point")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0

        def node(held: list[tuple]) -> tuple:
            nonlocal made
            made += 1
            key, place, entries, lows, highs, labels, raw = zip(*held, strict=True)
            rows = [unpacked(x) if leaf else np.frombuffer(x, np.uint32) for x in raw]
            groups = min(map(len, rows)) if leaf else COARSE
            counts = np.stack([fold(x, groups) for x in rows]).astype(np.uint16 if leaf else np.uint32)
            long = lambda x: np.array(x, np.int64).tobytes()
            label = labels[0] if len(set(labels)) == 1 else -1
            upper = fold(counts, COARSE).max(0).astype(np.uint32) if leaf else counts.max(0)
            return (key[0], base + made, base + made if leaf else place[0], len(held), long(entries), long(lows), long(highs), long(labels), packed(counts), min(lows), max(highs), label, upper.tobytes())

        held: list[tuple] = []
        names = [c.split()[0] for c in NODE.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 3, pa.binary()]
        for batch in batches:
            for b in small_batches(iter([batch]), "point"):
                out = []
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (row[:2] != held[0][:2] or len(held) == FAN):
                        out.append(node(held))
                        held = []
                    held.append(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(node(held), types, strict=True)], names=names)

    return dealt.mapInArrow(run, NODE)


VISIT = "node long, id long, n long, label long, big boolean, point binary"


def visit(nodes: DataFrame, queries: DataFrame, percent: int, leaf: bool) -> DataFrame:
    """What the queries find in their nodes: the nodes below, or at the leaves pairs (a, b) that may link.

    Node and queries meet as neighbours of a sorted partition, the node first; very many queries of one node are dealt over all partitions.
    """
    queries = materialise(queries)
    n = partitions(queries.sparkSession)
    hot = frequent(queries.groupBy("node").count(), ["node"])
    asked = queries.select("node", F.lit(1).alias("kind"), "id", "n", "label", "big", "point")
    held = nodes.select("node", F.lit(0).alias("kind"), "size", "entries", "lows", "highs", "labels", "counts")
    if hot is None:
        asked, held = asked.withColumn("salt", F.lit(0)), held.withColumn("salt", F.lit(0))
    else:
        tag = F.broadcast(hot)  # under SHARES nodes
        asked = asked.join(tag, "node", "left").withColumn("salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).otherwise(0)).drop("_hot")
        held = held.join(tag, "node", "left").withColumn("salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    both = held.unionByName(asked, allowMissingColumns=True).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        for batch in batches:
            for b in small_batches(small_batches(iter([batch]), "point"), "counts", 5_000_000):
                found: list[tuple] = []
                kinds = column(b, "kind")
                nodes_, ids, ns, labels, bigs, raw = (column(b, c) for c in ("node", "id", "n", "label", "big", "point"))
                packed = [column(b, c) for c in ("size", "entries", "lows", "highs", "labels", "counts")]
                for i, kind in enumerate(kinds):
                    if kind == 0:
                        size, *parts = (c[i] for c in packed)
                        e, lo, hi, la = (np.frombuffer(x, np.int64) for x in parts[:4])
                        here = (nodes_[i], e, lo, hi, la, np.frombuffer(zlib.decompress(parts[4]), np.uint16 if leaf else np.uint32).reshape(size, -1))
                        continue
                    if here is None or here[0] != nodes_[i]:
                        continue  # no node of this level
                    _, e, lo, hi, la, counts = here
                    x, y_label = ns[i], labels[i]
                    ok = (la != y_label) & (100 * hi >= percent * x) & (percent * lo <= 100 * x)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    mine = unpacked(raw[i])
                    groups = min(len(mine), counts.shape[1])
                    overlap = np.minimum(fold(counts[at], groups), fold(mine, groups)).sum(1, dtype=np.int64)
                    least = np.maximum(lo[at], -(-percent * x // 100))
                    at = at[can_link(overlap, np.full(len(at), x, np.int64), least, percent)]
                    for k in at.tolist():
                        found.append((int(e[k]), ids[i], x, y_label, bigs[i], raw[i]))
                if leaf:
                    pairs = sorted({(min(f[0], f[1]), max(f[0], f[1])) for f in found})
                    yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], names=["a", "b"])
                elif found:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["node", "id", "n", "label", "big", "point"])

    return both.mapInArrow(run, "a long, b long" if leaf else VISIT)


def search(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels in one bucket that may link, from members (key, id, label, big, n, point).

    Members of a bucket's largest component (big) do not search, the others do.
    """
    rows = members.select("key", F.lit(0).cast("long").alias("place"), F.col("id").alias("entry"), F.col("n").alias("low"), F.col("n").alias("high"), "label", "point", "alone")
    # components lie together, single points by their size and first count
    order = ["key", "alone", F.when(~F.col("alone"), F.col("label")), "low", F.substring("point", 1, 4), "entry"]
    levels = [materialise(pack(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order), True))]
    while levels[-1].groupBy("key").count().filter(F.col("count") > FAN).limit(1).count():
        part, number = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
        # FAN neighbours of a partition share a place above, and once a partition has but one, FAN neighbouring partitions do
        up = F.shiftleft(part, 33).bitwiseOR(F.shiftright(number, 6)) if len(levels) <= 33 // 6 else F.shiftleft(F.shiftright(part, 6), 33)
        above = levels[-1].select("key", up.alias("place"), F.col("node").alias("entry"), "low", "high", "label", F.col("upper").alias("point"))
        levels.append(materialise(pack(above.repartition("key", "place").sortWithinPartitions("key", "place", "entry"), False)))
    asked = members.filter(~F.col("big")).select("key", "id", "n", "label", "big", "point").join(levels[-1].select("key", "node"), "key").drop("key")  # at most FAN roots a key
    for nodes in reversed(levels[1:]):
        asked = visit(nodes, asked, percent, False)
    return visit(levels[0], asked, percent, True).distinct()


def open_members(members: DataFrame, labels: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """(key, id, label, alone, big) of the buckets whose members have several labels; big ones have the label of most members, alone ones no link yet."""
    placed = materialise(members.select("key", "id").join(labels.select("id", "label"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"), F.col("label").isNull().alias("alone")))
    per_label = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = per_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("size")).filter("labels > 1 and size > 2").select("key", "main")
    return spread_join(placed, main, ["key"], "id", crowded).withColumn("big", F.col("label") == F.col("main")).drop("main")


def similar_sets(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; documents link from ``percent`` similarity of their shingle sets on.

    Null, empty and white-space texts have no shingles and link with nothing; a text of any length is read whole.  Rows that share an id are one document; where
    their texts differ, the smallest text stands for it (each row keeps its own n_shingles).  Ids are integers (another type raises TypeError); a row with a null id links with
    nothing.  An empty table gives an empty result; other columns are ignored.
    """
    integral(df, id_col)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = materialise(shingles(texts, k))
    texts, full = one_text(texts, every, lambda t: shingles(t, k))
    full = full.filter("n_shingles > 0")
    same = ["n_shingles", "whole"]
    classes = full.groupBy(*same).agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n"))
    copies = materialise(classes.filter("rep < last").drop("last"))
    follows = materialise(spread_join(full.select("id", *same), copies.drop("n"), same, "id", frequent(copies, same, "n")).filter("id <> rep").select("id", "rep").distinct())
    apart = texts.join(bounded(follows.select("id")), "id", "left_anti").filter("id is not null")

    keyed = bucket_keys(apart, k, percent)
    met = materialise(keyed.groupBy("key").agg(F.min("id").alias("l1"), F.max("id").alias("l2"), F.count("*").alias("n")).filter("l1 < l2").drop("l2"))
    crowded = frequent(met, ["key"], "n")
    shared = materialise(spread_join(keyed, met, ["key"], "id", crowded).distinct())
    # buckets with the same members count once
    alike = shared.groupBy("key", "l1", "n").agg(F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("who2"))
    one = alike.groupBy("l1", "n", "who", "who2").agg(F.min("key").alias("key")).select("key")
    shared = materialise(spread_join(shared, one, ["key"], "id", crowded))
    fame = shared.groupBy("id").agg(F.sum("n").alias("fame"))
    chief = shared.join(fame, "id").groupBy("key").agg(F.max_by("id", F.struct(F.col("fame"), -F.col("id"))).alias("l3"))
    members = materialise(spread_join(shared, chief, ["key"], "id", crowded))
    ids = materialise(members.select("id").distinct())
    at = materialise(points(apart.join(bounded(ids), "id", "left_semi").dropDuplicates(["id"]), k))

    meet = members.select("id", F.explode(F.array("l1", "l3")).alias("y")).filter("id <> y")
    stars = materialise(meet.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct())
    hot = leaders(stars)
    confirm = lambda pairs, dealt: materialise(confirmed(pairs, texts, k, percent, "id", "text", dealt))
    links = confirm(within_bound(stars, at, percent, hot), hot)
    labels = components(links)
    open_ = materialise(open_members(members, labels, crowded))
    tested = stars
    for turn in range(ROUNDS):
        # what is left meets one more member of the largest component, each time another one
        lead = open_.filter("big").groupBy("key").agg(F.min_by("id", F.xxhash64(F.lit(turn), "id")).alias("y"))
        left = open_.filter(~F.col("big")).select("key", "id")
        meet = spread_join(left, lead, ["key"], "id", crowded)
        more = materialise(meet.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        hot = leaders(more)
        new = confirm(within_bound(more, at, percent, hot), hot)
        tested = tested.unionByName(more)
        found, asked = new.count(), left.select("id").distinct().count()
        if found:
            links = links.union(new)
            labels = components(links)
            open_ = materialise(open_members(members, labels, crowded))
        if found <= WORTH * asked:
            break
    crossing = materialise(search(open_.join(at, "id"), percent).join(tested, ["a", "b"], "left_anti"))
    hot = leaders(crossing)
    extra = confirm(within_bound(crossing, at, percent, hot), hot)
    if extra.limit(1).count():
        labels = components(links.union(extra))

    own = full.select("id").distinct().join(follows, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    reach = spread_join(own, labels.withColumnRenamed("id", "rep"), ["rep"], "id", frequent(copies, ["rep"], "n"), "left").select("id", F.coalesce("label", "rep").alias("component"))
    return every.select("id", "n_shingles").join(reach, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
