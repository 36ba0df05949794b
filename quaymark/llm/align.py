"""Alignment of the tokens of two tokenizers, a byte-level BPE (A) and a sentencepiece BPE (B), over the same bytes.

Every text is tokenised whole by both.  Offsets at which tokens of both end and the next tokens of both begin with a space
are anchors: they cut a document into windows of token ids.  Windows recur like words do, so the alignment of a window is
found once and kept by its tuple of ids.  Pair counts of the whole corpus come from a group-by over the documents' link lists.

Both encoders work on units that begin at a space after a character other than white space: neither the pre-tokens of A nor the pieces of B
reach over such a place, so the ids of a text are those of its units.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, as_lists, ragged, read_vocabulary, small_batches
from .common import frequent, materialise, settled, shared_folder, spread_join
from .grams import U, mix

#: Units and windows that a task remembers.
MEMO = 100_000
#: Bytes of texts that a task aligns at a time.
BATCH = 750_000
#: Distinct id pairs up to which their counts are broadcast (about 100 MB in an executor); more are joined by shuffles.
BROADCAST_PAIRS = 1_000_000
SPACE_MARK = "▁"


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace(SPACE_MARK, " ").encode()


@dataclass
class Side:
    """Byte strings of a tokenizer's ids."""

    pool: np.ndarray
    starts: np.ndarray
    lens: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Side:
        lens = np.array([len(x) for x in tokens], np.int64)
        return Side(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lens) - lens, lens)

    def spaced(self) -> np.ndarray:
        """Which tokens begin with a space."""
        first = self.pool[np.minimum(self.starts, max(0, len(self.pool) - 1))]
        return (self.lens > 0) & (first == 32)

    def text(self, ids: np.ndarray) -> bytes:
        return ragged(self.pool, self.starts[ids], self.lens[ids]).tobytes()


class Names:
    """Decimal ids with the sign that follows them in the written form of groups: ``,`` within a side, ``|`` after the ids of A, ``;`` after those of B."""

    def __init__(self, n_a: int, n_b: int):
        marked = [f"{i}{sign}".encode() for n, end in ((n_a, "|"), (n_b, ";")) for sign in (",", end) for i in range(n)]
        self.side = Side.of(marked)
        self.first = {"a,": 0, "a|": n_a, "b,": 2 * n_a, "b;": 2 * n_a + n_b}

    def text(self, pieces: np.ndarray) -> bytes:
        return self.side.text(pieces)[:-1]


class Pair:
    """Two tokenizers as they travel to the tasks: the arrays of A and the model file of B."""

    def __init__(self, vocabulary_file: str, piece_file: str):
        import sentencepiece

        self.a = read_vocabulary(vocabulary_file)
        self.a.added = {}  # their strings are plain text here
        with open(piece_file, "rb") as f:
            self.model = f.read()
        b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
            raise ValueError("pieces reach over the start of a word")
        self.b = Side.of([piece_bytes(p) for p in pieces])
        self.names = Names(len(self.a.byte_lens), len(pieces))
        #: A pair's code is its B id, shifted, and its A id.
        self.shift = 16 if len(self.a.byte_lens) <= 1 << 16 and len(pieces) <= 1 << 15 else 32
        self.code = np.int32 if self.shift == 16 else np.int64


def units(text: str) -> list[str]:
    """The parts of space + text, without their leading space, cut before spaces that follow a character other than white space."""
    if text[:1] == " " or text[-1:].isspace() or re.search(r"\s ", text):
        return [x[1:] for x in re.split(r"(?<=\S)(?= )", " " + text)]
    return text.split(" ")


class Growing:
    """Rows of integers, one after another, that can be picked by number."""

    def __init__(self, dtype: type):
        self.flat, self.starts, self.lens = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.lens = np.concatenate([self.lens, lens])

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged(self.flat, self.starts[rows], self.lens[rows]), self.lens[rows]


class Tokens:
    """Ids of whole texts by both tokenizers."""

    def __init__(self, pair: Pair):
        import sentencepiece

        self.pair = pair
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=pair.model)
        self.space = [self.processor.piece_to_id(SPACE_MARK)]
        self.clear()

    def clear(self) -> None:
        self.encoder = Encoder(self.pair.a, None)
        self.slots: dict[str, int] = {}
        self.a, self.b = Growing(np.int32), Growing(np.int32)

    def learn(self, new: list[str]) -> None:
        flat, upto = self.encoder.encode([" " + x for x in new])
        self.a.add(flat, np.diff(upto))
        ids = [x or self.space for x in self.processor.encode(new, num_threads=1)]  # a single space is dropped where nothing follows it
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.b.add(np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens)
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and where each text's end, then those of B (both with a leading 0)."""
        split = [units(t) for t in texts]
        every = [u for x in split for u in x]
        new = set(every) - self.slots.keys()
        if len(self.slots) + len(new) > MEMO:
            self.clear()
            new = set(every)
        if new:
            self.learn(list(new))
        rows = np.fromiter(map(self.slots.__getitem__, every), np.int64, len(every))
        ends = np.cumsum([0, *map(len, split)])
        out = []
        for side in (self.a, self.b):
            flat, lens = side.pick(rows)
            out += [flat, np.concatenate(([0], np.cumsum(lens)))[ends]]
        return tuple(out)


class Windows:
    """Alignments of windows, kept by their ids: codes of linked pairs, and the written form of the groups as numbers of ``Names``."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.a = Side(pair.a.byte_pool, pair.a.byte_starts, pair.a.byte_lens)
        self.marks = self.a.spaced(), pair.b.spaced()
        self.names = pair.names
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.codes, self.pieces, self.groups = Growing(self.pair.code), Growing(np.int32), np.zeros(0, np.int64)

    def learn(self, keys: list[bytes], a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> None:
        """Align new windows, all at once: both sides of a window cover the same bytes, so ends may be counted through all of them.

        Every end, of either side, closes one link: that of the two tokens which reach it.
        """
        end_a, end_b = np.cumsum(self.a.lens[a]), np.cumsum(self.pair.b.lens[b])
        closes = np.union1d(end_a, end_b)
        of_a, of_b = np.searchsorted(end_a, closes), np.searchsorted(end_b, closes)
        window_a, window_b = np.repeat(np.arange(len(a_len)), a_len), np.repeat(np.arange(len(b_len)), b_len)
        n = len(a_len)
        self.codes.add((b[of_b].astype(np.int64) << self.pair.shift) | a[of_a], np.bincount(window_a[of_a], minlength=n))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        same_a, same_b = shared_ends(end_a, end_b)
        last_a[same_a], last_b[same_b] = True, True
        self.groups = np.concatenate([self.groups, np.bincount(window_a[same_a], minlength=n)])
        first = self.names.first
        named = np.concatenate((np.where(last_a, first["a|"], first["a,"]) + a, np.where(last_b, first["b;"], first["b,"]) + b))
        group = np.concatenate((np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b))
        order = np.argsort(2 * group + np.repeat((0, 1), (len(a), len(b))), kind="stable")
        self.pieces.add(named[order], a_len + b_len)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))

    def slots(self, a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> np.ndarray:
        """The number of each window's alignment; windows follow one another from these places on."""
        a_len, b_len = np.diff(np.append(a_from, len(a))), np.diff(np.append(b_from, len(b)))
        places = lambda n: (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        hashes = lambda x, at, n, salt: np.add.reduceat(mix(x.astype(np.uint64) * U(0x9E3779B97F4A7C15) + places(n) * U(0xC2B2AE3D27D4EB4F) + U(salt)), at)
        _, first, which = np.unique(hashes(a, a_from, a_len, 1) ^ mix(hashes(b, b_from, b_len, 2)), return_index=True, return_inverse=True)
        of = first[which]
        alike = bool((a_len == a_len[of]).all() and (b_len == b_len[of]).all()) and bool((ragged(a, a_from[of], a_len) == a).all() and (ragged(b, b_from[of], b_len) == b).all())
        if not alike:  # two windows with one hash: each stands for itself
            first = which = np.arange(len(a_from))
        # a key holds the number of ids of A, those ids and the ids of B
        size = 1 + a_len[first] + b_len[first]
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        flat[start] = a_len[first]
        spread = lambda at, n: np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        flat[spread(start + 1, a_len[first])] = ragged(a, a_from[first], a_len[first])
        flat[spread(start + 1 + a_len[first], b_len[first])] = ragged(b, b_from[first], b_len[first])
        raw, cuts = flat.tobytes(), (4 * start).tolist()
        keys = [raw[p:q] for p, q in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        fresh = self.fresh(keys)
        if len(self.known) + len(fresh) > MEMO:
            self.clear()
            fresh = self.fresh(keys)
        if fresh:
            of = first[np.fromiter(fresh.values(), np.int64, len(fresh))]
            self.learn(list(fresh), ragged(a, a_from[of], a_len[of]), a_len[of], ragged(b, b_from[of], b_len[of]), b_len[of])
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]

    def fresh(self, keys: list[bytes]) -> dict[bytes, int]:
        """Keys that are not known, each once, with their place in the list."""
        return {k: i for i, k in enumerate(keys) if k not in self.known}


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens that end at the same offsets."""
    at = np.minimum(np.searchsorted(b_ends, a_ends), max(0, len(b_ends) - 1))
    same = np.flatnonzero(b_ends[at] == a_ends)
    return same, at[same]


class Aligner:
    def __init__(self, pair: Pair, digest: bool):
        self.pair, self.digest = pair, digest
        self.tokens, self.windows = Tokens(pair), Windows(pair)

    def batch(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups, codes and times of each text."""
        n = len(texts)
        raw = [t or "" for t in texts]
        a, a_upto, b, b_upto = self.tokens.encode(raw)
        wa, wb = self.windows.a, self.pair.b
        whole_a, whole_b = wa.text(a), wb.text(b)
        byte_a, byte_b = (np.concatenate(([0], np.cumsum(s.lens[x])))[upto].tolist() for s, x, upto in ((wa, a, a_upto), (wb, b, b_upto)))
        told = [(" " + t).encode() if t else None for t in raw]
        ok = np.array([t is not None and whole_a[p:q] == t and whole_b[r:s] == t for t, p, q, r, s in zip(told, byte_a[:-1], byte_a[1:], byte_b[:-1], byte_b[1:], strict=True)], bool)
        a, b = (np.concatenate([np.zeros(0, np.int32), *(x[i:j] for i, j, good in zip(upto[:-1].tolist(), upto[1:].tolist(), ok.tolist(), strict=True) if good)]) for x, upto in ((a, a_upto), (b, b_upto)))
        n_a, n_b = np.where(ok, np.diff(a_upto), 0), np.where(ok, np.diff(b_upto), 0)
        counts = np.zeros((2, n), np.int64)
        groups, upto = [""] * n, np.zeros(n + 1, np.int64)
        codes, times = np.zeros(0, self.pair.code), np.zeros(0, np.int32)
        if len(a):
            marks_a, marks_b = self.windows.marks
            end_a, end_b = shared_ends(np.cumsum(wa.lens[a]), np.cumsum(wb.lens[b]))
            # the next tokens of both begin with a space; so does every document
            anchor = (end_a + 1 < len(a)) & marks_a[a[np.minimum(end_a + 1, len(a) - 1)]] & marks_b[b[np.minimum(end_b + 1, len(b) - 1)]]
            a_from, b_from = np.append(0, end_a[anchor] + 1), np.append(0, end_b[anchor] + 1)
            slot = self.windows.slots(a, b, a_from, b_from)
            owner = np.searchsorted(np.cumsum(n_a), a_from, side="right")
            counts[0] = np.bincount(owner, self.windows.groups[slot], n)
            flat, lens = self.windows.codes.pick(slot)
            counts[1] = np.bincount(owner, lens, n)
            pieces, lens = self.windows.pieces.pick(slot)
            ends = np.cumsum(np.bincount(owner, lens, n)).astype(np.int64).tolist()
            for i, low, high in zip(range(n), [0, *ends], ends, strict=False):
                if low < high:
                    text = self.windows.names.text(pieces[low:high])
                    groups[i] = hashlib.sha256(text).hexdigest() if self.digest else text.decode()
            lists = [np.unique(flat[p:q], return_counts=True) for p, q in zip(np.cumsum(counts[1]) - counts[1], np.cumsum(counts[1]), strict=True)]
            codes, times = np.concatenate([x for x, _ in lists]), np.concatenate([y for _, y in lists]).astype(np.int32)
            upto = np.cumsum([0, *(len(x) for x, _ in lists)])
        whole = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, counts[0], counts[1])]
        return [*whole, pa.array(groups, pa.string()), as_lists(codes, upto), as_lists(times, upto)]


def align(df: DataFrame, vocabulary_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row.

    Tokens are those of space + text.  ``groups`` are the ids between shared ends as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of that in hex.
    A link is a pair of tokens whose bytes overlap; its count is how many links of all rows hold its two ids; n_best counts links with the highest count
    of their B id, ties included.  Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty string.
    A text of any length is tokenised whole; strings of special tokens are plain text; repeated rows and ids all stay and count each time; null ids pass.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    pair = Pair(vocabulary_file, piece_file)
    shared = spark.sparkContext.broadcast(pair)  # one vocabulary's arrays and one model file, under 4 MB
    code = T.LongType() if pair.shift > 16 else T.IntegerType()
    counts = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("id", df.schema[id_col].dataType), *counts,
        T.StructField("groups", T.StringType()), T.StructField("codes", T.ArrayType(code)), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value, digest)
        for b in small_batches(batches, "text", BATCH):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *aligner.batch(b.column(2).to_pylist())], names=schema.names)
        del aligner
        settled()  # the worker waits for later tasks without it

    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    links = made.select("key", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("key", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    total = materialise(links.groupBy("code").agg(F.sum("times").alias("n"), F.count("*").alias("docs")))
    b_id = F.shiftright("code", pair.shift).alias("b")
    most = F.broadcast(total.groupBy(b_id).agg(F.max("n").alias("most")))  # a row for each id of B
    counted = total.select("code", "n", "docs", b_id).join(most, "b").select("code", "n", "docs", (F.col("n") == F.col("most")).alias("best"))
    facts = counted.drop("docs")
    if total.count() <= broadcast_pairs:
        weighed = links.join(F.broadcast(facts), "code")
    else:
        weighed = spread_join(links, facts, ["code"], "key", frequent(total, ["code"], "docs"))
    sums = weighed.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return made.join(sums, "key", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
