"""Removal of repeated 100-byte strings with sharded suffix arrays.

A byte is removed when a 100-byte string that covers it also starts earlier (in a document with a
smaller id, or before it in the same document).  Equal strings have the same anchor: the 32-byte substring
with the smallest hash, leftmost on ties.  Consecutive windows with one anchor form a context (at most
168 bytes).  Contexts whose anchor occurs once cannot repeat.  The others meet in shards: contexts with equal
bytes collapse to their first place, and where an anchor has different contexts the
shard's suffix array (induced sorting) and permuted common prefixes tell which windows repeat which.

Groups of documents send every anchor and every context at most once, so a key never has more rows than there are
groups times its different contexts; the windows of an anchor with very many contexts travel alone, with
their bytes, keyed by their own hash, so that no anchor gathers an unbounded group in one task.  The text is shuffled once; all passes read that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .grams import fixed_hashes, parts, prefix_sums, substring_hashes
from .repeats import COUNTS, anchor_counts, column, dealt, firsts, ids_of, is_first, looked_up, member, places_of_least, shared_anchors, split_seeds
from .suffix import common_prefixes, suffix_array

LENGTH, SEED = 100, 32
CHUNK = 500_000
#: Anchors with more contexts than this (different ones of each group, summed over groups) send single windows.
HOT = 5_000
#: Windows of a context at most, rounded up to whole bytes: every mask has this many bits.
WIDE = -(-(LENGTH - SEED + 1) // 8) * 8
FULL = [np.packbits(np.arange(WIDE) < n).tobytes() for n in range(WIDE + 1)]
#: Bytes of contexts to a suffix array; anchors are never split.
SHARD = 1_000_000


def chunks(table: pa.Table) -> Iterator[tuple[range, np.ndarray, list[bytes]]]:
    texts, ids = [t.encode() for t in table["text"].to_pylist()], ids_of(table)
    for a, b in parts([len(t) for t in texts], CHUNK):
        yield range(a, b), ids[a:b], texts[a:b]


class Runs:
    """The windows of a chunk as runs with one anchor each: anchor hash, document, first start, length."""

    def __init__(self, texts: list[bytes]):
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.flat) - LENGTH + 1
        self.sums, self.down = prefix_sums(self.flat)
        if n <= 0:
            self.anchor = self.at = self.size = self.owner = np.zeros(0, np.int64)
            return
        seeds = fixed_hashes(self.sums, self.down, SEED)
        pos = places_of_least(seeds, LENGTH - SEED + 1)
        valid = np.zeros(n + 1, bool)
        edge = np.zeros(n + 1, np.int32)
        whole = sizes >= LENGTH
        np.add.at(edge, self.starts[whole], 1)
        np.add.at(edge, self.ends[whole] - LENGTH + 1, -1)
        valid = np.cumsum(edge)[:n] > 0
        new = valid.copy()
        new[1:] &= (pos[1:] != pos[:-1]) | ~valid[:-1]
        new[self.starts[whole]] = True
        begin = np.flatnonzero(new)
        stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
        self.at, self.size = begin, stop - begin + 1
        self.anchor = seeds[pos[begin]].view(np.int64)
        self.owner = np.searchsorted(self.ends, begin, "right")

    def contexts(self) -> np.ndarray:
        return substring_hashes(self.sums, self.down, self.at, self.at + self.size + LENGTH - 1).view(np.int64)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes, anchors and owners of the single windows of some runs."""
        size = self.size[runs]
        starts = np.repeat(self.at[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return starts, substring_hashes(self.sums, self.down, starts, starts + LENGTH).view(np.int64), np.repeat(self.anchor[runs], size), np.repeat(self.owner[runs], size)


def _anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Every anchor of a group with the number of its different contexts and whether it occurs again."""
    found = [(r.anchor, r.contexts()) for r in (Runs(texts) for _, _, texts in chunks(table))]
    return anchor_counts(key[0].as_py(), column(found, 0), column(found, 1))


CONTEXTS = "key long, context long, group int, id long, at long, size int, body binary"


def _contexts(key: tuple[pa.Scalar, ...], docs: pa.Table, seeds: pa.Table) -> pa.Table:
    """Every context of a repeated anchor once, with its first place in this group."""
    shared, hot = split_seeds(seeds)
    found, body = [], []
    for _, ids, texts in chunks(docs):
        r = Runs(texts)
        on = member(shared, r.anchor)
        alone = on & member(hot, r.anchor)
        on = np.flatnonzero(on & ~alone)
        raw, c, o = r.flat.tobytes(), r.contexts()[on], r.owner[on]
        a, n = r.at[on], r.size[on]
        at = a - r.starts[o]
        first = firsts(r.anchor[on], c, ids[o], at)
        found.append((r.anchor[on][first], c[first], ids[o][first], at[first], n[first]))
        body += [raw[x : x + m + LENGTH - 1] for x, m in zip(a[first].tolist(), n[first].tolist())]
        if alone.any():
            starts, h, k, o = r.windows(np.flatnonzero(alone))
            at = starts - r.starts[o]
            first = firsts(h, k, ids[o], at)
            found.append((h[first], k[first], ids[o][first], at[first], np.ones(len(first), np.int64)))
            body += [raw[x : x + LENGTH] for x in starts[first].tolist()]
    k, c, i, at, n = (column(found, j) for j in range(5))
    order = firsts(k, c, i, at)
    return pa.table({
        "key": pa.array(k[order]), "context": pa.array(c[order]), "group": pa.array(np.full(len(order), key[0].as_py(), np.int32)),
        "id": pa.array(i[order]), "at": pa.array(at[order]), "size": pa.array(n[order].astype(np.int32)), "body": pa.array([body[x] for x in order.tolist()], pa.binary())})


def repeated_windows(bodies: list[bytes], ids: np.ndarray, ats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For different contexts, which of their windows (WIDE columns) also start earlier in another one."""
    total = sum(map(len, bodies)) + len(bodies) + 1
    s = np.ones(total, np.int64)
    first = np.zeros(len(bodies), np.int64)
    at = 0
    for i, b in enumerate(bodies):
        first[i] = at
        s[at : at + len(b)] = np.frombuffer(b, np.uint8).astype(np.int64) + 2
        at += len(b) + 1
    s[-1] = 0
    used = np.unique(s)
    dense = np.zeros(int(used[-1]) + 1, np.int64)
    dense[used] = np.arange(len(used))
    s = dense[s]
    sa = suffix_array(s)
    plcp = common_prefixes(s, sa, LENGTH)
    owner = np.repeat(np.arange(len(bodies)), [len(b) + 1 for b in bodies])
    owner = np.append(owner, len(bodies) - 1)
    inside = np.arange(total) - first[owner]
    start = inside < sizes[owner]
    start[-1] = False
    # (document, start) as one number, which fits: documents are numbered in order
    start_at, document = inside + ats[owner], np.unique(ids, return_inverse=True)[1][owner]
    rank = document * (int(start_at.max()) + 1) + start_at
    never = np.iinfo(np.int64).max
    joined = np.cumsum(plcp[sa] < LENGTH) - 1
    key = np.where(start[sa], rank[sa], never)
    cuts = np.flatnonzero(np.append(True, joined[1:] != joined[:-1]))
    least = np.minimum.reduceat(key, cuts)
    again = np.zeros(total, bool)
    again[sa] = (key < never) & (key > least[joined])
    column = np.arange(WIDE)
    return again[np.minimum(first[:, None] + column, total - 1)] & (column < sizes[:, None])


MARKS = "group int, key long, context long, mask binary"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted contexts of a shard -> for every (group, context) with repeats a bit for each window (WIDE bits)."""
    pending: list[tuple] = []  # different contexts of anchors not yet decided: (rows of one anchor)
    size, rows, last = 0, [], None

    def close():
        nonlocal size
        if rows:
            distinct, heads = {}, []
            for r in rows:
                if r[6] not in distinct:  # whole bytes are compared
                    distinct[r[6]] = len(heads)
                    heads.append(r)
            for r in rows:
                if r[3:5] != heads[distinct[r[6]]][3:5]:
                    out.append((r[2], r[0], r[1], FULL[r[5]]))
            if len(heads) > 1:
                pending.extend(heads)
                size += sum(len(h[6]) for h in heads)
            rows.clear()

    def solve():
        nonlocal size
        if pending:
            found = repeated_windows([p[6] for p in pending], np.array([p[3] for p in pending]), np.array([p[4] for p in pending]), np.array([p[5] for p in pending]))
            on = np.flatnonzero(found.any(1))
            out.extend((pending[i][2], pending[i][0], pending[i][1], m.tobytes()) for i, m in zip(on.tolist(), np.packbits(found[on], axis=1)))
            pending.clear()
            size = 0

    out: list[tuple] = []

    def flush():
        made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["group", "key", "context", "mask"])
        out.clear()
        return made

    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(7))):
            if r[0] != last:
                close()
                if size >= SHARD:
                    solve()
                last = r[0]
            rows.append(r)
        if len(out) > 50_000:
            yield flush()
    close()
    solve()
    yield flush()


def _cut(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The texts of a group without the bytes of repeated windows."""
    mk, mc, mask = marks["key"].to_numpy(), marks["context"].to_numpy(), marks["mask"].to_pylist()
    is_hot = np.array([m is None for m in mask], bool)
    hot = np.unique(mk[is_hot])
    at = np.flatnonzero(~is_hot)
    mk, mc = mk[at], mc[at]
    mask = np.unpackbits(np.frombuffer(b"".join(mask[x] for x in at.tolist()), np.uint8).reshape(-1, WIDE // 8), axis=1)
    runs, single, held = [], [], []
    for rows, ids, texts in chunks(docs):
        r = Runs(texts)
        runs.append((r.anchor, r.contexts(), ids[r.owner], r.at - r.starts[r.owner], r.at, r.size))
        starts, h, k, o = r.windows(np.flatnonzero(member(hot, r.anchor)))
        single.append((h, k, ids[o], starts - r.starts[o], starts))
        held.append((rows, r.flat, r.starts, r.ends))

    def known(found: list) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is the first of its kind in the group, and the number of its mask from 1 on."""
        k = [column(found, j) for j in range(4)]
        return is_first(*k), looked_up(k[0], k[1], mk, mc, np.arange(1, len(mk) + 1))

    (first_run, mark_run), (first_single, mark_single) = known(runs), known(single)
    n_bytes, n_removed, spans, kept, base, base_w = [], [], [], [], 0, 0
    for r, s, (rows, flat, starts, ends) in zip(runs, single, held):
        at, size = r[4], r[5]
        first, mark = first_run[base : base + len(at)], mark_run[base : base + len(at)]
        cover = np.zeros(len(flat) + 1, np.int32)
        np.add.at(cover, at[~first], 1)  # a context that occurs before in this group: all of its windows repeat
        np.add.at(cover, at[~first] + size[~first] + LENGTH - 1, -1)
        told = np.flatnonzero(first & (mark > 0))
        which, window = np.nonzero(mask[mark[told] - 1])
        bad = at[told][which] + window
        np.add.at(cover, bad, 1)
        np.add.at(cover, bad + LENGTH, -1)
        bad = s[4][~first_single[base_w : base_w + len(s[4])] | (mark_single[base_w : base_w + len(s[4])] > 0)]
        np.add.at(cover, bad, 1)
        np.add.at(cover, bad + LENGTH, -1)
        base, base_w = base + len(at), base_w + len(s[4])
        gone = np.cumsum(cover[:-1]) > 0
        stay = ~gone
        out, upto = flat[stay].tobytes(), np.append(0, np.cumsum(stay))
        for d in range(len(rows)):
            a, e = int(starts[d]), int(ends[d])
            n_bytes.append(e - a)
            n_removed.append(int(e - a - (upto[e] - upto[a])))
            spans.append(np.flatnonzero(np.diff(gone[a:e].view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist() if n_removed[-1] else [])
            kept.append(out[int(upto[a]) : int(upto[e])])
    return pa.table({"id": docs["id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_removed, spans (starts and ends of removed byte runs in turn), kept (binary).

    Null and empty texts have no bytes; every byte of a text is covered however long it is.  Ids are integers (another type raises
    TypeError); a null id counts as the largest one.  Rows that share an id count as one document whose texts lie on top of
    each other, so repeated rows and ties keep the same bytes.  An empty table gives an empty result; other columns are ignored.
    """
    docs = dealt(df, id_col, text_col)
    shared = shared_anchors(docs.groupBy("group").applyInArrow(_anchors, COUNTS), HOT)
    contexts = docs.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(_contexts, CONTEXTS)
    marks = contexts.repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key", "id", "at").mapInArrow(_decide, MARKS)
    hot = shared.filter("hot").select("group", F.col("seed").alias("key"), F.lit(0).cast("long").alias("context"), F.lit(None).cast("binary").alias("mask"))
    out = docs.groupBy("group").cogroup(marks.unionByName(hot).groupBy("group")).applyInArrow(_cut, "id long, n_bytes long, n_removed long, spans array<bigint>, kept binary")
    return out.withColumnRenamed("id", id_col)
