"""Substring deduplication on words by seeding and extending.

Seeds are winnowed anchors: of every 13 consecutive words, the 5-word sequence with the smallest hash, leftmost on ties.
Consecutive windows with one anchor are an occurrence of it: the anchor with up to eight words on either side.  Two equal windows
have the same anchor, so repeats are found by joining occurrences on their anchors.  Each pair of occurrences of
different documents is extended word by word both ways; a maximal match of at least 13 words
marks its words in the later document, and overlapping matches join into maximal repeats.

Documents are dealt into groups of bounded size.  A group sends every anchor, and then every different occurrence of a
shared anchor, once and with its first document, and decides alone what repeats inside it.  An anchor with more than FEW
occurrences left is not joined pair by pair: its windows travel alone, keyed by their own words, so that no key ever
has more rows than there are groups, however common its text is.  The text itself is shuffled once; all passes read that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import integral, partitions
from .grams import PLACE_VALUES, Texts, U, mix, parts, sliding_min

WINDOW, SEED = 13, 5
SIDE = WINDOW - SEED
#: Occurrences of an anchor (different ones of each group, summed) up to which all pairs are extended.
FEW = 48
GROUPS_PER_PARTITION, GROUP_BYTES = 8, 16_000_000
CHUNK = 800_000
LAST = np.iinfo(np.int64).max
#: Low bits of a seed's key that hold its place, so that the leftmost of equal hashes is the smallest key.
PLACE_BITS = U(28)
BLOCK_ROWS = 60_000


def dealt(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, group): groups hold about GROUP_BYTES at most (a text is never cut), however large the table is."""
    integral(df, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(GROUPS_PER_PARTITION * partitions(df.sparkSession), -(-size // GROUP_BYTES))
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("group", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))


def ids_of(table: pa.Table) -> np.ndarray:
    """The ids, a null one as the last of all."""
    return table["id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(table: pa.Table) -> Iterator[tuple[range, np.ndarray, Texts]]:
    """(row numbers, ids, Texts) of a group, about CHUNK bytes of text at a time."""
    texts, ids = table["text"].to_pylist(), ids_of(table)
    for a, b in parts([len(t) for t in texts], CHUNK):
        yield range(a, b), ids[a:b], Texts(texts[a:b])


def places_of_least(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each full window of w hashes the place of its smallest one, leftmost on ties."""
    bits = max(PLACE_BITS, U(int(len(hashes)).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(keys, w) & ((U(1) << bits) - U(1))).astype(np.int64)


class Occurrences:
    """Runs of windows with one anchor: first word, windows, words before the anchor, document, anchor and context hash."""

    def __init__(self, t: Texts, ids: np.ndarray):
        seeds = t.sequences(SEED)
        at = np.flatnonzero(t.left()[: max(0, len(t.word_hash) - WINDOW + 1)] >= WINDOW)
        place = places_of_least(seeds, SIDE + 1)[at] if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.at = at[first]
        self.size = np.diff(np.append(first, len(at)))
        self.left = place[first] - self.at
        self.id = ids[t.owner()[self.at]]
        self.anchor = seeds[place[first]].view(np.int64)
        w = np.append(t.word_hash, np.zeros(WINDOW + SIDE, np.uint64))
        h = (self.size << 8 | self.left).astype(np.uint64)
        for k in range(WINDOW + SIDE):
            h += np.where(k < self.size + WINDOW - 1, w[self.at + k], U(0)) * PLACE_VALUES[k]
        self.context = mix(h).view(np.int64)

    def bodies(self, t: Texts, which: np.ndarray) -> list[bytes]:
        """The text of some occurrences."""
        a, raw = self.at[which], t.flat.tobytes()
        return [raw[x:y] for x, y in zip(t.word_start[a].tolist(), t.word_end[a + self.size[which] + WINDOW - 2].tolist())]

    def windows(self, which: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash, anchor and document of the single windows of some runs."""
        n = self.size[which]
        at = np.repeat(self.at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return at, whole[at], np.repeat(self.anchor[which], n), np.repeat(self.id[which], n)


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def changes(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, in this order, a new combination of the keys begins."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return new


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the first one leads) and where a new combination of them begins in it."""
    order = np.lexsort(keys[::-1])
    return order, changes(order, *keys)


def firsts(a: np.ndarray, b: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """One row with the least place for each key (a, b)."""
    order = np.lexsort((*place[::-1], b, a))
    return order[changes(order, a, b)]


def is_first(a: np.ndarray, b: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether each row has the least place of all rows with its key (a, b); equal places are all first."""
    order = np.lexsort((*place[::-1], b, a))
    new = changes(order, a, b)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.ones(len(a), bool)
    for p in place:
        out[order] &= p[order] == p[head]
    return out


def looked_up(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each (a, b) among distinct keys, 0 where there is none."""
    order, new = grouped(np.concatenate((keys_a, a)), np.concatenate((keys_b, b)))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    of = np.zeros(int(new.sum()), values.dtype)
    of[group[: len(keys_a)]] = values
    return of[group[len(keys_a) :]]


def column(found: list, i: int, kind=np.int64) -> np.ndarray:
    return np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)


def anchor_counts(group: int, anchor: np.ndarray, context: np.ndarray, ids: np.ndarray | None = None) -> pa.Table:
    """Every anchor of a group with its different contexts, and whether it occurs again (with ids: in another document)."""
    order, other = grouped(anchor, context)
    a = anchor[order]
    cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    n = np.add.reduceat(other.astype(np.int32), cuts) if len(a) else np.zeros(0, np.int32)
    if ids is not None:
        i = ids[order]
        again = np.minimum.reduceat(i, cuts) < np.maximum.reduceat(i, cuts) if len(a) else np.zeros(0, bool)
    else:
        again = np.diff(np.append(cuts, len(a))) > 1
    return pa.table({"seed": pa.array(a[cuts]), "group": pa.array(np.full(len(cuts), group, np.int32)), "n": pa.array(n.astype(np.int32)), "again": pa.array(again)})


COUNTS = "seed long, group int, n int, again boolean"


def shared_anchors(counts: DataFrame, few: int) -> DataFrame:
    """(group, seed, hot) of the anchors that can repeat; hot ones have more than ``few`` occurrences."""
    of_seed = Window.partitionBy("seed")  # at most one row a group
    return (
        counts.withColumn("groups", F.count("*").over(of_seed)).withColumn("occurrences", F.sum("n").over(of_seed))
        .filter(F.col("again") | (F.col("groups") > 1)).select("group", "seed", (F.col("occurrences") > few).alias("hot"))
    )


def split_seeds(seeds: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All shared anchors and the hot ones, each in order."""
    seeds = seeds.sort_by("seed")
    shared = seeds["seed"].to_numpy()
    return shared, shared[seeds["hot"].to_numpy().astype(bool)]


def _anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    found = [(o.anchor, o.context, o.id) for o in (Occurrences(t, ids) for _, ids, t in chunks(table))]
    return anchor_counts(key[0].as_py(), *(column(found, i) for i in range(3)))


OCCURRENCES = "key long, context long, group int, id long, left int, size int, body binary"


def _occurrences(key: tuple[pa.Scalar, ...], docs: pa.Table, seeds: pa.Table) -> pa.Table:
    """Different occurrences of shared anchors, or single windows of hot ones (without words), with their first document here."""
    shared, hot = split_seeds(seeds)
    found, body = [], []
    for _, ids, t in chunks(docs):
        o = Occurrences(t, ids)
        on = member(shared, o.anchor)
        alone = on & member(hot, o.anchor)
        on = np.flatnonzero(on & ~alone)
        on = on[firsts(o.anchor[on], o.context[on], o.id[on])]
        found.append((o.anchor[on], o.context[on], o.id[on], o.left[on], o.size[on]))
        body += o.bodies(t, on)
        if alone.any():
            _, h, a, i = o.windows(np.flatnonzero(alone), t.sequences(WINDOW).view(np.int64))
            found.append((h, a, i, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)))
            body += [b""] * len(h)
    k, c, i, left, size = (column(found, j) for j in range(5))
    order = firsts(k, c, i)
    return pa.table({
        "key": pa.array(k[order]), "context": pa.array(c[order]), "group": pa.array(np.full(len(order), key[0].as_py(), np.int32)), "id": pa.array(i[order]),
        "left": pa.array(left[order].astype(np.int32)), "size": pa.array(size[order].astype(np.int32)), "body": pa.array([body[x] for x in order.tolist()], pa.binary())})


def around(bodies: list[bytes], left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words on either side of each anchor, the nearest first; 0 where an occurrence ends."""
    t = Texts(bodies)
    w = np.append(t.word_hash, np.zeros(2 * WINDOW, np.uint64))
    k, place = np.arange(SIDE), (t.first + left)[:, None]
    right = size + SIDE - 1 - left
    before = np.where(k < left[:, None], w[np.maximum(place - 1 - k, 0)], U(0))
    return np.concatenate([before, np.where(k < np.where(size > 0, right, 0)[:, None], w[place + SEED + k], U(0))], 1)


def extended(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from the anchor on, at most ``most``."""
    same = np.logical_and.accumulate(a == b, axis=1).sum(1)
    return np.minimum(same, most)


def repeated_words(key: np.ndarray, context: np.ndarray, ids: np.ndarray, left: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For occurrences of whole anchors, a bit for each of their words that also stands, in a long enough match, in an earlier document."""
    whole = np.where(size > 0, (np.int64(1) << (size + WINDOW - 1)) - 1, (1 << WINDOW) - 1)
    order = np.lexsort((ids, context, key))
    new = changes(order, key, context)
    head = order[np.flatnonzero(new)]
    of = np.empty(len(order), np.int64)
    of[order] = head[np.cumsum(new) - 1]
    out = np.where(ids > ids[of], whole, 0)
    # pairs of different occurrences of an anchor, the later document first
    head = head[size[head] > 0]
    head = head[np.lexsort((ids[head], key[head]))]
    cuts = np.flatnonzero(np.append(True, key[head][1:] != key[head][:-1])) if len(head) else head
    begin = np.repeat(cuts, np.diff(np.append(cuts, len(head))))
    before = np.arange(len(head)) - begin
    later = np.repeat(np.arange(len(head)), before)
    earlier = begin[later] + np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before)
    x, y = head[later], head[earlier]
    strict = ids[x] > ids[y]
    x, y = x[strict], y[strict]
    right = size + SIDE - 1 - left
    for lo in range(0, len(x), 200_000):
        i, j = x[lo : lo + 200_000], y[lo : lo + 200_000]
        l = extended(words[i, :SIDE], words[j, :SIDE], np.minimum(left[i], left[j]))
        r = extended(words[i, SIDE:], words[j, SIDE:], np.minimum(right[i], right[j]))
        long = l + SEED + r >= WINDOW
        i, l, r = i[long], l[long], r[long]
        np.bitwise_or.at(out, i, ((np.int64(1) << (l + SEED + r)) - 1) << (left[i] - l))
    return np.where(ids == ids[of], out[of], out)


MARKS = "group int, key long, context long, mask long"


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by anchor -> masks of the repeated words of each (group, occurrence)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        num = lambda n: t[n].to_numpy().astype(np.int64)
        size = num("size")
        key, context, left = num("key"), num("context"), num("left")
        mask = repeated_words(key, context, num("id"), left, size, around(t["body"].to_pylist(), left, size))
        on = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (t["group"].to_numpy(), key, context, mask)], names=["group", "key", "context", "mask"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def _cut(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The texts of a group without words that repeats cover."""
    mask = marks["mask"].fill_null(0).to_numpy()
    mk, mc = marks["key"].to_numpy(), marks["context"].to_numpy()
    hot = np.unique(mk[mask == 0])
    mk, mc, mask = mk[mask != 0], mc[mask != 0], mask[mask != 0]
    runs, single, held = [], [], []
    for rows, ids, t in chunks(docs):
        o = Occurrences(t, ids)
        runs.append((o.anchor, o.context, o.id, o.at, o.size))
        alone = np.flatnonzero(member(hot, o.anchor))
        at, h, a, i = o.windows(alone, t.sequences(WINDOW).view(np.int64) if len(alone) else np.zeros(0, np.int64))
        single.append((h, a, i, at))
        held.append((rows, t.flat, t.word_start.astype(np.int32), t.word_end.astype(np.int32), t.first, t.counts, t.starts, t.ends))
    def covered(found: list, size: np.ndarray) -> np.ndarray:
        a, b, i = (column(found, j) for j in range(3))
        known = looked_up(a, b, mk, mc, mask)
        return np.where(is_first(a, b, i), known, (np.int64(1) << (size + WINDOW - 1)) - 1)

    of_runs, of_single = covered(runs, column(runs, 4)), covered(single, np.ones(len(column(single, 0)), np.int64))
    n_words, n_removed, spans, kept, base, base_w = [], [], [], [], 0, 0
    for r, s, (rows, flat, word_start, word_end, first, counts, starts, ends) in zip(runs, single, held):
        gone = np.zeros(len(word_start) + 2 * WINDOW, bool)
        for at, m in ((r[3], of_runs[base : base + len(r[3])]), (s[3], of_single[base_w : base_w + len(s[3])])):
            on = np.flatnonzero(m)
            at, m = at[on], m[on]
            for k in range(WINDOW + SIDE):
                gone[at[((m >> k) & 1) > 0] + k] = True
        base, base_w = base + len(r[3]), base_w + len(s[3])
        gone = gone[: len(word_start)]
        bytes_kept = np.zeros(len(flat) + 1, np.int32)
        stay = ~gone
        np.add.at(bytes_kept, word_start[stay], 1)
        np.add.at(bytes_kept, word_end[stay] + 1, -1)  # with the one character after each word, which becomes a space
        keep = np.cumsum(bytes_kept[:-1]) > 0
        flat = flat.copy()
        flat[word_end] = 32
        upto = np.cumsum(keep)
        out = flat[keep].tobytes()
        for d in range(len(rows)):
            a, b = int(first[d]), int(first[d] + counts[d])
            n_words.append(b - a)
            n_removed.append(int(gone[a:b].sum()))
            spans.append(np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist() if n_removed[-1] else [])
            lo, hi = (int(upto[starts[d] - 1]) if starts[d] else 0), int(upto[ends[d] - 1])
            kept.append(out[lo : max(lo, hi - 1)].decode())
    return pa.table({"id": docs["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept_text": pa.array(kept, pa.string())})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_removed, spans (starts and ends of removed word runs in turn), kept_text.

    Null and empty texts have no words; a text of any length is read whole.  Ids are integers (another type raises TypeError);
    a null id counts as the largest one.  Rows with the same id, null ones too, never make each other repeats, so repeated rows and ties
    all stay; equal texts under different ids lose all but the first.  An empty table gives an empty result; other columns are ignored.
    """
    docs = dealt(df, id_col, text_col)
    shared = shared_anchors(docs.groupBy("group").applyInArrow(_anchors, COUNTS), FEW)
    found = docs.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(_occurrences, OCCURRENCES)
    marks = found.repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key", "id").mapInArrow(_join, MARKS)
    hot = shared.filter("hot").select("group", F.col("seed").alias("key"), F.lit(0).cast("long").alias("context"), F.lit(None).cast("long").alias("mask"))
    out = docs.groupBy("group").cogroup(marks.unionByName(hot).groupBy("group")).applyInArrow(_cut, "id long, n_words long, n_removed long, spans array<bigint>, kept_text string")
    return out.withColumnRenamed("id", id_col)
