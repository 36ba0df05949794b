"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A text is parsed greedily, from its first symbol
to its last, into the longest phrases that the automaton knows.  A phrase costs log2 of the number of places in the
training text (and of single symbols), m, so c phrases for n symbols estimate the cross entropy
c log2(m) / n; the language with the least wins, also where languages have different amounts of training text.

The parse is sequential by nature.  To move many places in one numpy step, every block of a text is
parsed as if a phrase began at its first symbol; then each block is entered where the one before really ends
its last phrase, and followed only until the two parses agree on a phrase's start, from
where they are the same.  Entries are corrected until none changes, so the result is that of one sequential parse.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import replaced, small_batches, with_column
from .common import fold_remainder, smallest_hashes

#: Bounds of the training sample for each language: documents, and symbols that whole documents may sum to.
TRAIN_DOCS, TRAIN_SYMBOLS = 64, 32_768
BLOCK = 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def to_symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-case letters as learned symbols; every run of other characters is the separator 0 once."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def letter_table(known: str) -> np.ndarray:
    """Symbol by code point: 0 no letter, 1 a letter that no training text has, from 2 on the letters of the training texts."""
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)
    table[[ord(c) for c in known]] = np.arange(len(known)) + 2
    return table


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Arcs of every state of the suffix automaton (online construction)."""
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return arcs


class Model:
    """Languages in order, all letters of their training texts, and every automaton as a list of arcs."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.letters = "".join(sorted({c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()}))
        table = letter_table(self.letters)
        self.automata, self.trained = [], []
        for lang in self.languages:
            parts, n = [], 0
            for s in (to_symbols(t, table) for t in texts[lang]):
                if not n or n + len(s) <= TRAIN_SYMBOLS:  # whole documents only, at least one
                    parts.append(s)
                    n += len(s)
            arcs = suffix_automaton(np.concatenate(parts).tolist() if parts else [])
            self.automata.append((len(arcs), np.array([(s, c, t) for s, a in enumerate(arcs) for c, t in a.items()], np.int32).reshape(-1, 3)))
            self.trained.append(n)


class Parser:
    """All automata in one table of arcs, found by hashing (state, symbol); state 0 stands for no arc."""

    def __init__(self, model: Model):
        self.model, self.table = model, letter_table(model.letters)
        self.stop = len(model.letters) + 2  # ends every text; no automaton has it
        self.width = self.stop + 1
        sizes = [n for n, _ in model.automata]
        self.roots = np.cumsum([1, *sizes])[:-1]
        arcs = [a + np.array([[root, 0, root]]) for root, (_, a) in zip(self.roots, model.automata)]
        s, c, t = np.concatenate(arcs).T if arcs else np.zeros((3, 0), np.int64)
        keys = s.astype(np.int64) * self.width + c
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, open_ = self.slots(keys), np.arange(len(keys))
        while len(open_):
            _, one = np.unique(at[open_], return_index=True)
            one = open_[one]
            one = one[self.keys[at[one]] == -1]
            self.keys[at[one]], self.targets[at[one]] = keys[one], t[one]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = (at[open_] + 1) & self.mask
        # a phrase is one of the places of the training text, or one of the symbols
        self.bits = np.log2(np.array(model.trained, float) + self.width)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MULTIPLIER >> self.shift).astype(np.int64)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * np.int64(self.width) + symbol
        at = self.slots(key)
        there = self.keys[at]
        to = np.where(there == key, self.targets[at], 0)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == key[open_]
            to[open_[hit]] = self.targets[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return to

    def run(self, flat: np.ndarray, place: np.ndarray, limit: np.ndarray, root: np.ndarray, row: np.ndarray, order: np.ndarray, mark: bool) -> tuple[np.ndarray, np.ndarray]:
        """Parse from each place, where a phrase begins, until one begins at the limit or later: (phrases, where that is).

        With ``mark``, ``order`` (by language and place) gets each phrase's number; without, a parse also ends where
        ``order`` has one.
        """
        n, out, exit_ = len(place), np.zeros(len(place), np.int64), place.copy()
        if mark:
            order[row, place] = 0
        lane = np.arange(n)
        place, state, count = place.copy(), root.copy(), np.zeros(n, np.int64)
        while len(lane):
            c = flat[place]
            to = self.follow(state, c)
            over = np.zeros(len(lane), bool)
            stuck = np.flatnonzero(to == 0)
            if len(stuck):
                fresh = state[stuck] != root[stuck]
                count[stuck] += fresh
                begun = stuck[fresh]
                over[begun] = self._begin(place, begun, limit, row, order, count, mark)
                again = stuck[~over[stuck]]
                to[again] = self.follow(root[again], c[again])
                alone = again[to[again] == 0]  # a symbol that even the root lacks is a phrase of its own
                count[alone] += 1
                to[alone] = root[alone]
                place[alone] += 1
                over[alone] = self._begin(place, alone, limit, row, order, count, mark)
                place[alone] -= ~over[alone]
                done = np.flatnonzero(over)
                if len(done):
                    out[lane[done]], exit_[lane[done]] = count[done], place[done]
                    go = ~over
                    lane, place, to, count, limit, root, row = lane[go], place[go], to[go], count[go], limit[go], root[go], row[go]
            state = to
            place = place + 1
        return out, exit_

    @staticmethod
    def _begin(place, which, limit, row, order, count, mark) -> np.ndarray:
        """Which of these lanes end, as a phrase begins at their place."""
        over = place[which] >= limit[which]
        if mark:
            on = which[~over]
            order[row[on], place[on]] = count[on]
            return over
        return over | (order[row[which], place[which]] >= 0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for each text and language, and symbols for each text."""
        symbols = [to_symbols(t, self.table) for t in texts]
        sizes = np.array([len(s) for s in symbols], np.int64)
        blocks = -(-sizes // BLOCK)
        n_lang, n_blocks = len(self.roots), int(blocks.sum())
        if not n_blocks or not n_lang:
            return np.zeros((len(texts), n_lang), np.int64), sizes
        flat = np.concatenate([x for s in symbols for x in (s, [self.stop])]).astype(np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(n_blocks) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[owner] + nth * BLOCK
        limit = np.minimum(start + BLOCK, first[owner] + sizes[owner])
        every = lambda x: np.tile(x, n_lang)
        start, limit, lead = every(start), every(limit), every(nth == 0)
        row = np.repeat(np.arange(n_lang), n_blocks)
        root = self.roots[row]
        order = np.full((n_lang, len(flat)), -1, np.int16)
        guess, guess_exit = self.run(flat, start, limit, root, row, order, True)
        count, exit_, entered = guess.copy(), guess_exit.copy(), start.copy()
        while True:
            entry = np.where(lead, start, np.append(start[0], exit_[:-1]))
            new = np.flatnonzero(entry != entered)
            if not len(new):
                break
            entered = entry
            past = entry[new] >= limit[new]
            count[new[past]], exit_[new[past]] = 0, entry[new[past]]
            new = new[~past]
            met = order[row[new], entry[new]] >= 0
            k, at = np.zeros(len(new), np.int64), entry[new].copy()
            walk = new[~met]
            k[~met], at[~met] = self.run(flat, entry[walk], limit[walk], root[walk], row[walk], order, False)
            joined = at < limit[new]  # from here on the block's own parse is the true one
            on = new[joined]
            count[new], exit_[new] = k, at
            count[on] += guess[on] - order[row[on], at[joined]]
            exit_[on] = guess_exit[on]
        total = np.zeros((n_lang, len(texts)), np.int64)
        np.add.at(total, (row, every(owner)), count)
        return total.T, sizes

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a symbol for each text and language."""
        counts, sizes = self.phrases(texts)
        return counts * self.bits / np.maximum(sizes, 1)[:, None]


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample: up to TRAIN_DOCS documents a language, in the order of a hash of their ids.

    Of these, whole documents are taken while their symbols sum to at most TRAIN_SYMBOLS; documents longer than that come last, and only
    one of them if there is no other.  Of rows that share id and language the smallest text counts.  Null ids, texts and
    languages are not learned from; without rows there are no languages.
    """
    named = df.select(F.col(id_col).alias("_did"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).dropna()
    ids = named.groupBy(F.col("_did").alias("_id"), "_lang").agg((F.max(F.length("_text")) > TRAIN_SYMBOLS).alias("_long"))
    ranked = smallest_hashes(ids, ["_lang", "_long"], "_id", TRAIN_DOCS)
    # documents that are not too long come first
    order = Window.partitionBy("_lang").orderBy("_long", "_rn")
    chosen = ranked.withColumn("_rn", F.row_number().over(order)).filter((F.col("_rn") <= TRAIN_DOCS) & (~F.col("_long") | (F.col("_rn") == 1))).drop("_long")
    wanted = F.broadcast(chosen.withColumnRenamed("_lang", "_of"))  # at most TRAIN_DOCS ids a language
    rows = named.join(wanted, (F.col("_did") == F.col("_id")) & (F.col("_lang") == F.col("_of"))).groupBy("_of", "_rn").agg(F.min("_text").alias("_text"))
    found = rows.toArrow().to_pylist()  # at most TRAIN_DOCS texts of TRAIN_SYMBOLS characters, or one longer text, a language
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["_of"], r["_rn"])):
        texts.setdefault(r["_of"], []).append(r["_text"])
    return Model(texts)


_parsers: dict[int, Parser] = {}


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with ``lang_pred`` and ``score`` (0 to 1: how much less entropy the winner has than the runner-up).

    A text that is null, empty or has no letter gets ``und`` and 0, and so does every text if no language was learned; ties go to
    the first language in alphabetical order, with 0.  A text of any length is parsed whole.  Repeated rows get equal
    values; an empty table gives an empty result.  Other columns are kept; ones with these two names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = with_column(with_column(df.schema, "lang_pred", T.StringType()), "score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(pickle.loads(shared.value))
        parser = _parsers[key]
        for b in small_batches(batches, text_col, 2_000_000):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            made = [best(row, parser.model.languages) if len(row) and any(map(str.isalpha, t)) else ("und", 0.0) for t, row in zip(distinct, parser.entropies(list(distinct)))]
            found = [made[distinct[t]] for t in texts]
            yield replaced(b, {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})
        _parsers.clear()  # the worker may serve other operators next

    return df.mapInArrow(run, schema)


def best(entropy: np.ndarray, languages: list[str]) -> tuple[str, float]:
    order = np.argsort(entropy, kind="stable")
    least = entropy[order[0]]
    second = entropy[order[1]] if len(order) > 1 else 2 * max(least, 1e-9)
    return languages[order[0]], float(np.clip((second - least) / second, 0, 1)) if second > 0 else 0.0


def held_out(id_col: str = "doc_id"):
    return fold_remainder(id_col, 5) == 0
