"""Many terms in many texts: an Aho-Corasick automaton as arrays, run over Arrow batches (sections 2.4 and 2.5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Terms of one automaton (about 100 MB at ten characters each); longer lists are cut into several by a hash.
TERMS = 500_000
#: Characters of the texts that a task holds at a time, and the least length of a lane.
CHARS, LANE = 1_500_000, 512
CHAR_BITS = 21
#: Stands between texts; no character has this number.
BETWEEN = (1 << CHAR_BITS) - 1


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, one after another, and the length of each text."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint32).astype(np.int64), np.array([len(x) // 4 for x in raw], np.int64)


class Automaton:
    """Finds all terms in texts in one pass, whatever their number.

    States are numbered by depth, 0 is the root.  ``keys`` holds the arcs, (state, character) in one integer, sorted; ``fail`` the state of the longest proper
    suffix; ``term`` the term that ends in a state, or -1; ``shorter`` the next state on the way of suffixes in which a term ends.
    """

    def __init__(self, terms: Sequence[str]):
        self.terms = sorted({t for t in terms if t})
        flat, lens = code_points(self.terms)
        starts = np.cumsum(lens) - lens
        self.longest = int(lens.max(initial=0))
        at = np.zeros(len(lens), np.int64)
        keys, levels, n = [], [], 1
        for depth in range(self.longest):
            alive = np.flatnonzero(lens > depth)
            arcs, which = np.unique((at[alive] << CHAR_BITS) | flat[starts[alive] + depth], return_inverse=True)
            at[alive] = n + which
            keys.append(arcs)
            levels.append((n, n + len(arcs)))
            n += len(arcs)
        # arcs come sorted within a level and their parents' numbers grow from level to level
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])
        self.term = np.full(n, -1, np.int32)
        self.term[at[lens > 0]] = np.flatnonzero(lens > 0)
        self.fail, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for low, high in levels[1:]:
            arcs = self.keys[low - 1 : high - 1]
            self.fail[low:high] = self.follow(self.fail[arcs >> CHAR_BITS].astype(np.int64), arcs & BETWEEN)
            f = self.fail[low:high]
            self.shorter[low:high] = np.where(self.term[f] >= 0, f, self.shorter[f])

    def follow(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros(len(state), np.int64)
        if not len(self.keys):
            return out
        open_ = np.arange(len(state))
        state = state.copy()
        while len(open_):
            want = (state[open_] << CHAR_BITS) | char[open_]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            out[open_[ok]] = at[ok] + 1  # an arc's number is that of the state it leads to, less one
            open_ = open_[~ok & (state[open_] > 0)]
            state[open_] = self.fail[state[open_]]
        return out

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, term) of their numbers, each once, in order.

        All texts are one row of characters, cut into lanes that overlap by the longest term; one step moves all lanes by a character.
        """
        none = np.zeros(0, np.int64)
        flat, lens = code_points(texts)
        if not len(flat) or not self.longest:
            return none, none
        spaced = np.full(len(flat) + len(lens), BETWEEN, np.int64)
        ends = np.cumsum(lens + 1)
        spaced[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = flat
        back = self.longest - 1
        lane = max(LANE, 8 * self.longest)
        first = np.arange(0, len(spaced), lane)
        state, found_at, found = np.zeros(len(first), np.int64), [none], [none]
        for step in range(-back, lane):
            at = first + step
            inside = (at >= 0) & (at < len(spaced))
            state = self.follow(state, np.where(inside, spaced[np.where(inside, at, 0)], BETWEEN))
            if step >= 0:
                hit = np.flatnonzero((self.term[state] >= 0) | (self.shorter[state] > 0))
                s = state[hit]
                while len(hit):
                    own = self.term[s] >= 0
                    found_at.append(at[hit[own]])
                    found.append(self.term[s[own]].astype(np.int64))
                    s = self.shorter[s].astype(np.int64)
                    hit, s = hit[s > 0], s[s > 0]
        text = np.searchsorted(ends, np.concatenate(found_at), side="right")
        pairs = np.unique((text << 32) | np.concatenate(found))
        return pairs >> 32, pairs & ((1 << 32) - 1)


def find_terms(df: DataFrame, terms: DataFrame, text: str, term: str = "term", to: str = "terms", limit: int = TERMS) -> DataFrame:
    """The rows with the different terms that their text holds anywhere, as an array column (empty if none); upper and lower case are one.

    Terms are a list of any length: each part of up to about ``limit`` of them becomes an automaton, sent to the tasks as arrays, and work grows with the
    length of the texts.  Null texts and null or empty terms hold nothing.
    """
    spark = ship(df.sparkSession)
    wanted = terms.select(F.lower(term).alias("t")).filter("t <> ''").distinct()
    parts = max(1, -(-wanted.count() // limit))
    lowered = df.withColumn(to, F.lower(F.col(text)))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.ArrayType(T.StringType()))])
    name, kept = to, [f.name for f in schema.fields[:-1]]

    shared = []
    for k in range(parts):
        mine = wanted.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k)
        shared.append(spark.sparkContext.broadcast(Automaton([r["t"] for r in mine.toLocalIterator()])))  # about ``limit`` terms each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(name))
            rows = max(1, int(batch.num_rows * CHARS / max(1, column.nbytes)))
            for low in range(0, batch.num_rows, rows):
                b = batch.slice(low, rows)
                texts = [t or "" for t in b.column(b.schema.get_field_index(name)).to_pylist()]
                rows_, held = [np.zeros(0, np.int64)], []
                for automaton in (x.value for x in shared):
                    i, j = automaton.find(texts)
                    rows_.append(i)
                    held += [automaton.terms[t] for t in j.tolist()]
                row = np.concatenate(rows_)
                order = np.argsort(row, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(b.num_rows + 1)), pa.int32()), pa.array(held, pa.string()).take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), lists], names=[*kept, name])

    return lowered.select(*kept, to).mapInArrow(run, schema)
