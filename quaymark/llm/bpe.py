"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Spark counts the words of the whole corpus; the most frequent ones (a fixed number, with and
without a leading space) are encoded once and compiled into a minimal acyclic
automaton whose states share suffixes.  Arcs carry additive outputs: their sum along a word is the word's
rank, which points at its ids.  The file goes to every executor by ``addFile`` and is
memory-mapped there.  Tasks look up all distinct words of a batch in one vectorised
walk; words that the lexicon lacks are merged exactly, lowest rank first.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Words whose forms go into the lexicon; it bounds the file (a few MB) and changes no result.
LEXICON_WORDS = 32_768
LONGEST_WORD = 64
#: Entries of a task's memory of merged words.
MEMO = 100_000
#: Words that occur less often never get into the lexicon.
LEAST_COUNT = 4
NEVER = np.int32(2**31 - 1)
#: The pre-tokenising pattern of the vocabulary (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def split_pattern(data: dict) -> str:
    """The pre-tokenising pattern that the file states, or the one that its byte-level form stands for."""
    first = data.get("pre_tokenizer") or {}
    for step in [first, *(first.get("pretokenizers") or [])]:
        if step.get("type") == "Split" and "Regex" in step.get("pattern", {}):
            return step["pattern"]["Regex"]
    return SPLIT


class Vocabulary:
    """The merges and byte strings of a byte-level BPE file in the json form of ``tokenizers``, as a few arrays.

    The driver reads the file; workers get the arrays alone (about 2 MB).
    """

    def __init__(self, content: str):
        data = json.loads(content)
        chars = byte_chars()
        of_char = {c: b for b, c in enumerate(chars)}
        vocab = data["model"]["vocab"]
        bytes_of = [b""] * (max([*vocab.values(), *(a["id"] for a in data["added_tokens"])]) + 1)
        for token, i in vocab.items():
            bytes_of[i] = bytes(of_char[c] for c in token)
        self.added = {a["content"]: a["id"] for a in data["added_tokens"]}
        for token, i in self.added.items():
            bytes_of[i] = token.encode()
        self.byte_lens = np.array([len(x) for x in bytes_of], np.int64)
        self.byte_starts = np.cumsum(self.byte_lens) - self.byte_lens
        self.byte_pool = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.first_ids = np.array([vocab[c] for c in chars], np.int64)
        merges = [(p.split(" ") if isinstance(p, str) else p) for p in data["model"]["merges"]]
        self.by_rank = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        self.pair_keys, self.pair_ranks = np.unique(keys, return_index=True)  # the first of equal pairs counts
        self.pair_ranks = self.pair_ranks.astype(np.int32)
        self.pattern = split_pattern(data)

    @cached_property
    def split(self):
        return regex.compile(self.pattern)

    @cached_property
    def specials(self):
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @cached_property
    def ranks(self) -> dict[int, int]:
        """Rank by pair, made only where a word is too long for the row-wise merge."""
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "specials", "ranks")}

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NEVER if it does not merge."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words: their ids one after another, and how many each has.

        Words of similar length form a matrix; each round merges the lowest-ranked pair of every row.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        low = 0
        for width in (1, 4, 8, 12, 16, 24, 40, LONGEST_WORD):
            rows = np.flatnonzero((n > low) & (n <= width))
            low = width
            if len(rows) and len(self.pair_keys):
                self._merge_rows([words[i] for i in rows], n[rows], rows, width, out)
        for i, x in enumerate(out):
            if x is None:
                out[i] = self.merge_long(words[i])
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)), sizes

    def _merge_rows(self, words: list[bytes], n: np.ndarray, rows: np.ndarray, width: int, out: list) -> None:
        cols = np.arange(width)
        ids = np.zeros((len(words), width), np.int64)
        ids[cols < n[:, None]] = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NEVER, np.int32)
        if width > 1:
            rank[:, :-1] = self.ranks_of(ids[:, :-1], ids[:, 1:])
            rank[cols >= n[:, None] - 1] = NEVER
        n = n.copy()
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(ids)), at]
            done = best == NEVER
            if done.any():
                for r, x, k in zip(rows[done].tolist(), ids[done], n[done].tolist()):
                    out[r] = x[:k]
                go = ~done
                ids, rank, n, rows, at, best = ids[go], rank[go], n[go], rows[go], at[go], best[go]
            if not len(ids):
                return
            line = np.arange(len(ids))
            after = cols > at[:, None]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            ids[line, at] = self.by_rank[best]
            n -= 1
            right = np.minimum(at + 1, width - 1)
            rank[line, at] = np.where(at < n - 1, self.ranks_of(ids[line, at], ids[line, right]), NEVER)
            left = np.maximum(at - 1, 0)
            rank[line, left] = np.where(at > 0, self.ranks_of(ids[line, left], ids[line, at]), rank[line, left])

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one word of any length, with a heap and links."""
        ids = self.first_ids[np.frombuffer(word, np.uint8)].tolist()
        n, get, new = len(ids), self.ranks.get, self.by_rank
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(new[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((ids[x] << 20) | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, alive) if ok]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer as bytes: header, arcs sorted by (state, byte), finals, ids.

    Words are added in byte order; a state whose subtree is complete is replaced by an equal
    one seen before, so suffixes are shared.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for w in [*words, None]:
        keep = 0
        if w is not None:
            while keep < min(len(w), len(last)) and w[keep] == last[keep]:
                keep += 1
        while len(path) - 1 > keep:
            child = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        if w is None:
            break
        for _ in w[keep:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    root = freeze(path[0])
    below = []  # words accepted from each state; children always have smaller numbers
    for final, arcs in states:
        below.append(int(final) + sum(below[t] for _, t in arcs))
    keys, targets, outs = [], [], []
    for s, (final, arcs) in enumerate(states):
        out = int(final)
        for b, t in arcs:
            keys.append(s * 256 + b)
            targets.append(t)
            outs.append(out)
            out += below[t]
    ids = [entries[w] for w in words]
    starts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(outs, np.int32), np.array([f for f, _ in states], np.int8),
        starts, np.array([x for i in ids for x in i], np.int32),
    ]
    return struct.pack("<8q", root, *map(len, parts), 0) + b"".join(p.tobytes() + b"\0" * (-len(p.tobytes()) % 8) for p in parts)


class Lexicon:
    """The compiled transducer, memory-mapped."""

    def __init__(self, file: str):
        raw = np.memmap(file, np.uint8, "r")
        self.root, *sizes, _ = struct.unpack("<8q", raw[:64].tobytes())
        at, self.parts = 64, []
        for n, kind in zip(sizes, (np.int64, np.int32, np.int32, np.int8, np.int32, np.int32), strict=True):
            size = n * np.dtype(kind).itemsize
            self.parts.append(raw[at : at + size].view(kind))
            at += size + -size % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if the lexicon lacks it; one step per byte place for all words."""
        keys, targets, outs, final, _, _ = self.parts
        n = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full(len(words), -1, np.int64)
        if not len(keys):
            return found
        short = np.flatnonzero(n <= LONGEST_WORD)
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = (np.cumsum(n) - n)[short]
        n = n[short]
        state, total = np.full(len(short), self.root, np.int64), np.zeros(len(short), np.int64)
        alive = np.arange(len(short))
        for place in range(LONGEST_WORD + 1):
            ended = n[alive] == place
            done = alive[ended & (final[state[alive]] == 1)]
            found[short[done]] = total[done]
            alive = alive[~ended]
            if not len(alive):
                break
            want = state[alive] * 256 + flat[first[alive] + place]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = keys[at] == want
            alive, at = alive[ok], at[ok]
            state[alive] = targets[at]
            total[alive] += outs[at]
        return found

    def ids(self, rank: int) -> list[int]:
        starts, ids = self.parts[4], self.parts[5]
        return ids[starts[rank] : starts[rank + 1]].tolist()


def frequent_words(df: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent runs of letters over all texts, at most ``limit`` of them.

    The counts of counts give the least count that fits the limit, so no partition sends more than its share.
    """
    words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = materialise(words.groupBy("w").agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST_COUNT) & (F.length("w") < LONGEST_WORD)))
    size = F.floor(F.log2("n") * 16)  # a sixteenth of an octave a step: a few hundred rows
    steps = sorted(((r["s"], r["k"]) for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in steps:
        total += k
        if total > limit:
            break
        least = s
    return [] if least is None else [r["w"] for r in counts.filter(size >= least).select("w").collect()]


@lru_cache(maxsize=1)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def read_vocabulary(file: str) -> Vocabulary:
    with open(file, encoding="utf-8") as f:
        return Vocabulary(f.read())


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The given ranges of an array, one after another."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Ids of texts; words met before are kept as slots of a growing table, up to MEMO of them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        v = self.vocabulary
        if v.specials is None or not any(s in text for s in v.added):
            return v.split.findall(text)
        out: list[str] = []
        for part in v.specials.split(text):
            if part in v.added:
                out.append("\0" + part)  # no pre-token holds a special token's text
            elif part:
                out += v.split.findall(part)
        return out

    def learn(self, new: list[str]) -> None:
        """Give the words slots: from the lexicon in one walk, the others by merging."""
        raw, v = [w.encode() for w in new], self.vocabulary
        rank = self.lexicon.ranks(raw) if self.lexicon else np.full(len(raw), -1, np.int64)
        special = [i for i, w in enumerate(new) if w[0] == "\0" and w[1:] in v.added]
        rank[special] = -1
        known, rest = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        parts, lens = [], np.zeros(len(raw), np.int64)
        if len(known):
            first = self.lexicon.parts[4].astype(np.int64)
            lens[known] = first[rank[known] + 1] - first[rank[known]]
            parts.append(ragged(self.lexicon.parts[5], first[rank[known]], lens[known]))
        ids, n = v.merge_many([raw[i] for i in rest])
        for k in special:
            at = int(np.searchsorted(rest, k))
            lo = int(n[:at].sum())
            ids = np.concatenate([ids[:lo], [v.added[new[k][1:]]], ids[lo + int(n[at]) :]]).astype(np.int32)
            n[at] = 1
        lens[rest] = n
        parts.append(ids)
        order = np.concatenate([known, rest])
        size, base = len(self.starts), len(self.flat)
        starts = np.empty(len(raw), np.int64)
        starts[order] = base + np.cumsum(lens[order]) - lens[order]
        self.flat = np.concatenate([self.flat, *parts]).astype(np.int32)
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        self.slots.update(zip(new, range(size, size + len(new))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end (with a leading 0)."""
        split = [self.words(t or "") for t in texts]
        every = list(chain.from_iterable(split))
        distinct = set(every)
        new = distinct - self.slots.keys()
        if len(self.slots) + len(new) > MEMO:
            self.clear()
            new = distinct
        if new:
            self.learn(list(new))
        slot = np.fromiter(map(self.slots.__getitem__, every), np.int64, len(every))
        lens = self.lens[slot]
        upto = np.concatenate(([0], np.cumsum(lens)))
        return ragged(self.flat, self.starts[slot], lens), upto[np.cumsum([0, *map(len, split)])]


def release() -> None:
    """Give freed memory back to the system at a task's end, as Spark keeps the worker for later tasks (glibc only)."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a column's buffers stay within about ``most`` bytes (a row is never cut)."""
    for b in batches:
        i = b.schema.get_field_index(column)
        rows = max(1, int(b.num_rows * most / max(1, b.column(i).nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def with_column(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def as_lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def decoded_texts(v: Vocabulary, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    lens = v.byte_lens[flat]
    raw = ragged(v.byte_pool, v.byte_starts[flat], lens).tobytes()
    cuts = np.concatenate(([0], np.cumsum(lens)))[ends].tolist()
    return pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:])], pa.string())


def replaced(b: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns at its end, in place of any with their names."""
    names = [n for n in b.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *new.values()], names=[*names, *new])


def lexicon_file(df: DataFrame, v: Vocabulary, text_col: str, words: int) -> str:
    """Compile the corpus' frequent words and send the file to all executors; its name there."""
    forms = list({form.encode() for w in frequent_words(df, text_col, words) for form in (w, " " + w)})
    ids, sizes = v.merge_many(forms)
    entries = dict(zip(forms, (x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])))) if forms else {}
    # the driver serves the file to executors, also to those that join later, from the folder that Spark keeps for the session
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.join(SparkFiles.getRootDirectory(), "made")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(compile_lexicon(entries))
    df.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def round_trip(df: DataFrame, vocabulary_file: str, text_col: str = "text", ids_to: str | None = "ids", text_to: str | None = "decoded", lexicon_words: int = LEXICON_WORDS, keep_text: bool = True) -> DataFrame:
    """The input (without its text unless ``keep_text``) with an array<int> column of ids and a column of the text that they decode to, from one pass in one worker.

    Null and empty texts give an empty array and an empty text; a text of any length is encoded whole.  Strings of special
    tokens in a text become their ids, as the tokenizers library does by default; bytes that are not UTF-8 decode to U+FFFD.
    Repeated rows are encoded alike and all stay; there are no ties, as merges have distinct ranks and the leftmost of equal
    pairs goes first.  An empty table gives an empty result; columns that have the new names are replaced.
    """
    v = read_vocabulary(vocabulary_file)
    name = lexicon_file(df, v, text_col, lexicon_words)
    shared = df.sparkSession.sparkContext.broadcast(v)  # arrays of one vocabulary, about 2 MB
    schema = df.schema
    for column, kind in ((ids_to, T.ArrayType(T.IntegerType())), (text_to, T.StringType())):
        schema = with_column(schema, column, kind) if column else schema
    schema = schema if keep_text else T.StructType([f for f in schema.fields if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value, _lexicon(name))
        for b in small_batches(batches, text_col):
            flat, ends = coder.encode(b.column(b.schema.get_field_index(text_col)).to_pylist())
            new = {ids_to: as_lists(flat, ends)} if ids_to else {}
            b = b if keep_text else b.drop_columns([text_col])
            yield replaced(b, new | ({text_to: decoded_texts(coder.vocabulary, flat, ends)} if text_to else {}))

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary_file: str, text_col: str = "text", to: str = "ids", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """The input with an array<int> column of ids; see ``round_trip`` for odd input."""
    return round_trip(df, vocabulary_file, text_col, to, None, lexicon_words)


def decode(df: DataFrame, vocabulary_file: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The input with the text that the ids stand for; bytes that are not UTF-8 become U+FFFD, null gives empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ids_col, 2_000_000):
            column = b.column(b.schema.get_field_index(ids_col)).fill_null([])
            ends, ids = np.asarray(column.offsets), np.asarray(column.values)
            yield replaced(b, {to: decoded_texts(shared.value, ids[ends[0] : ends[-1]], ends - ends[0])})

    return df.mapInArrow(run, with_column(df.schema, to, T.StringType()))
