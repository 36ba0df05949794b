"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed in the JVM, whole and by two prefixes, and a word's vector is the sum of the three embeddings, so
that new endings of a known stem are understood; buckets seen in enough training documents have an embedding, all
others share one.
Filters of widths 1 to 3, ReLU, max pooling over the whole text and a logistic layer give a probability.
For each language a threshold is calibrated on held-back training rows; the probability is
rescaled so that this threshold becomes a score of 0.7.  The language is guessed from
the words alone.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import release, with_column
from .common import fold_remainder, settled, smallest_hashes
from .grams import parts

#: Bound of the training sample: labelled documents for each label.
TRAIN_DOCS = 2_500
BUCKETS = 1 << 22
VOCABULARY, LEAST_DOCS = 60_000, 3
PREFIXES = (4, 6)
IDS = 1 + len(PREFIXES)
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.05, 1e-4
CUT = 0.7
CHUNK = 40_000
#: Padding rows after each document; a window that begins on a word ends on them at the latest.
PAD = max(WIDTHS) - 1


def hashed_words(text: Column) -> Column:
    """Three buckets for each word: the word itself and its first PREFIXES characters."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")
    return F.flatten(F.transform(words, lambda w: F.array(bucket(w), *(bucket(F.lit(n), F.substring(w, 1, n)) for n in PREFIXES))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Row 0 of the embedding is padding (zeros), row 1 all words without a row of their own."""

    def __init__(self, known: np.ndarray, prior: float, seed: int = 7):
        r = np.random.default_rng(seed)
        self.known = known
        self.emb = r.normal(0, 0.1, (len(known) + 2, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [r.normal(0, 0.5 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.float32(np.log(prior / (1 - prior)))
        self.languages: list[str] = []
        self.word_lang = np.zeros((len(known) + 2, 0), np.float32)
        self.cuts: dict[str, float] = {}

    def rows(self) -> np.ndarray:
        table = np.ones(BUCKETS, np.int32)
        table[self.known] = np.arange(len(self.known)) + 2
        return table

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Largest ReLU response of each filter for each document of a padded flat text."""
        parts = self.response[flat[:, 0]]
        for i in range(1, IDS):
            parts += self.response[flat[:, i]]
        found, at = [], 0
        cuts = np.stack([starts, window_ends(starts, len(flat))], 1).reshape(-1)
        for w, b in zip(WIDTHS, self.bias):
            n = len(flat) - w + 1
            x = parts[:n, at : at + FILTERS] + b
            for j in range(1, w):
                x += parts[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            found.append(np.maximum(np.maximum.reduceat(x, cuts)[::2], 0))
        return found

    def ready(self) -> Net:
        """Precompute every word's part in every filter, so that a convolution is a sum of looked-up rows."""
        self.response = np.concatenate([self.emb @ k[j] for w, k in zip(WIDTHS, self.conv) for j in range(w)], 1)
        return self

    def probability(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # a sum over each row, as a matrix product may round differently with other rows around
        return sigmoid((np.concatenate(self.pooled(flat, starts), 1) * self.out).sum(1) + self.out_bias)

    def language(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.word_lang[flat].sum(1), starts, axis=0).argmax(1)

    def step(self, flat: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, memory: dict) -> None:
        """One Adagrad step; through max pooling only the strongest place of each filter gets a gradient."""
        x = self.emb[flat].sum(1)
        ends = window_ends(starts, len(flat))
        feats, places = [], []
        for w, k, b in zip(WIDTHS, self.conv, self.bias):
            n = len(flat) - w + 1
            c = sum(x[j : j + n] @ k[j] for j in range(w)) + b
            at = np.stack([s + c[s:e].argmax(0) for s, e in zip(starts, ends)])
            places.append(at)
            feats.append(c[at, np.arange(FILTERS)])
        raw = np.concatenate(feats, 1)
        f = np.maximum(raw, 0)
        d = (sigmoid(f @ self.out + self.out_bias) - y) * weight / len(y)
        back = d[:, None] * self.out * (raw > 0)

        def move(name, value, grad):
            m = memory.setdefault(name, np.zeros_like(value))
            m += grad**2
            value -= RATE * grad / (np.sqrt(m) + 1e-6)

        grad_emb = np.zeros_like(x)
        for i, (w, k, b) in enumerate(zip(WIDTHS, self.conv, self.bias)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            gk = np.zeros_like(k)
            for j in range(w):
                for q in range(FILTERS):
                    p = places[i][:, q] + j
                    gk[j, :, q] = g[:, q] @ x[p]
                    np.add.at(grad_emb, p, g[:, q, None] * k[j, :, q])
            move(("conv", i), k, gk + DECAY * k)
            move(("bias", i), b, g.sum(0))
        move("out", self.out, f.T @ d + DECAY * self.out)
        self.out_bias -= np.float32(RATE * d.sum())
        moved = np.flatnonzero((grad_emb != 0).any(1))
        used, at = np.unique(flat[moved], return_inverse=True)
        g = np.zeros((len(used), DIM), np.float32)
        np.add.at(g, at.reshape(-1), np.repeat(grad_emb[moved], IDS, axis=0))
        m = memory.setdefault("emb", np.zeros(self.emb.shape, np.float32))
        hit = np.flatnonzero((g != 0).any(1) & (used > 0))
        used, g = used[hit], g[hit] + DECAY * self.emb[used[hit]]
        m[used] += g**2
        self.emb[used] -= RATE * g / (np.sqrt(m[used]) + 1e-6)


def window_ends(starts: np.ndarray, size: int) -> np.ndarray:
    """Where the windows of each document end: they begin on its words, or on its first row if it has none."""
    return np.append(starts[1:] - PAD, size - 2 * PAD)


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An array of padding for documents of these sizes, which of its rows are words, and where each document starts.

    A document has at least one row and then PAD more, the last one twice as many, so that every window fits.
    """
    rows = np.maximum(sizes, 1) + PAD
    starts = np.cumsum(rows) - rows
    inside = np.zeros(int(rows.sum()) + PAD + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes, -1)
    return np.zeros((len(inside) - 1, IDS), np.int32), np.cumsum(inside[:-1]) > 0, starts


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, inside, starts = layout(np.array([len(d) for d in docs]))
    flat[inside] = np.concatenate(docs)
    return flat, starts


def train(words: list[np.ndarray], toxic: np.ndarray, langs: list[str | None]) -> Net:
    """Fit on four fifths of the rows, calibrate each language's threshold on all with the rest weighing double."""
    if not len(toxic) or toxic.min() == toxic.max():
        net = Net(np.zeros(0, np.int64), 0.5)
        net.out[:] = 0
        net.out_bias = np.float32(30 if len(toxic) and toxic[0] else -30)
        net.languages, net.word_lang = [""], np.zeros((2, 1), np.float32)
        return net
    seen, n = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    often = seen[n >= LEAST_DOCS][np.argsort(-n[n >= LEAST_DOCS], kind="stable")][:VOCABULARY]
    net = Net(np.sort(often), float(np.clip(toxic.mean(), 0.01, 0.99)))
    table = net.rows()
    docs = [table[w].reshape(-1, IDS) for w in words]
    r = np.random.default_rng(11)
    back = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~back)
    weight = np.where(toxic == 1, 0.5 / max(toxic.mean(), 0.01), 0.5 / max(1 - toxic.mean(), 0.01)).astype(np.float32)
    memory: dict = {}
    for _ in range(EPOCHS):
        for at in np.array_split(r.permutation(fit), max(1, len(fit) // BATCH)):
            flat, starts = padded([docs[i] for i in at])
            lost = r.random(flat.shape) < np.array([0.3] + [0.05] * len(PREFIXES))  # words are often hidden, so that stems are learned
            net.step(np.where((flat > 1) & lost, 1, flat), starts, toxic[at].astype(np.float32), weight[at], memory)
    net.ready()
    net.languages = sorted({x for x in langs if x}) or [""]
    counts = np.full((len(net.emb), len(net.languages)), 0.5)
    for d, x in zip(docs, langs):
        if x:
            np.add.at(counts[:, net.languages.index(x)], np.unique(d), 1)
    share = counts / counts.sum(0)
    net.word_lang = (np.log(share) - np.log(share).mean(1, keepdims=True)).astype(np.float32)
    net.word_lang[:2] = 0
    p, which = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
    for a, b in parts([len(d) for d in docs], CHUNK):
        flat, starts = padded(docs[a:b])
        p[a:b], which[a:b] = net.probability(flat, starts), net.language(flat, starts)
    doubled = np.where(back, 2.0, 1.0)
    for k, x in enumerate(net.languages):
        own = which == k
        own = own if (toxic[own] == 1).sum() >= 20 and (toxic[own] == 0).sum() >= 20 else np.ones(len(own), bool)
        bad, good = own & (toxic == 1), own & (toxic == 0)
        tries = np.linspace(0.05, 0.95, 91)
        loss = [(doubled[bad] * (p[bad] < t)).sum() / doubled[bad].sum() + (doubled[good] * (p[good] >= t)).sum() / doubled[good].sum() for t in tries]
        best = np.flatnonzero(np.isclose(loss, min(loss)))
        net.cuts[x] = float(tries[best[len(best) // 2]])
    return net


def sample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold, the same number at most for each label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_remainder("doc_id", 3) != 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    both = smallest_hashes(known, ["_toxic"], "_id", TRAIN_DOCS).drop("_rn")
    own = df.select(F.col(id_col).alias("_did"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    rows = own.join(F.broadcast(both), F.col("_did") == F.col("_id"))
    one = rows.groupBy("_id", "_toxic").agg(F.min(F.struct("_text", "_lang")).alias("r"))  # rows that share an id count once
    return one.select("_id", "_toxic", F.col("r._lang").alias("_lang"), hashed_words(F.col("r._text")).alias("_words"))


def learn(df: DataFrame, labels: DataFrame, **names: str) -> Net:
    """A network from the sample; without rows of both labels every text gets the same score.

    Of a document with several labels the largest counts, of rows that share an id the smallest text.
    Null ids and labels other than 0 and 1 are not learned from.
    """
    rows = sample(df, labels, **names).toArrow().combine_chunks().sort_by([("_id", "ascending"), ("_toxic", "ascending")])  # at most 2 * TRAIN_DOCS documents
    order = np.argsort([zlib.crc32(f"{i}:5".encode()) for i in rows["_id"].to_pylist()], kind="stable")
    column = rows["_words"].combine_chunks()
    words = [np.asarray(column[int(i)].values) for i in order]
    toxic, langs = np.array(rows["_toxic"].to_pylist(), np.int64), rows["_lang"].to_pylist()
    net = train(words, toxic[order] if len(order) else toxic, [langs[i] for i in order])
    del rows, column, words
    settled()
    return net


_nets: dict[int, tuple[Net, np.ndarray]] = {}


def score(df: DataFrame, net: Net, text_col: str = "text", to: str = "score") -> DataFrame:
    """The input with a column ``to``, 0 to 1; 0.7 is the calibrated threshold of the text's guessed language.

    Null and empty texts get the score of a text without words.  Every word of a text is read however long it is.
    A score depends on the text alone: repeated rows and equal texts get the same one, wherever they stand.
    A score of exactly 0.7 is predicted as toxic.  An empty table gives an empty result.  Other columns are kept; one that
    has that name is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    own_name = f"_words_{uuid.uuid4().hex}"
    ready = df.drop(to).withColumn(own_name, hashed_words(F.col(text_col)))
    schema = with_column(df.drop(to).schema, to, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _nets:
            _nets.clear()
            own = pickle.loads(shared.value).ready()
            _nets[key] = own, own.rows()
        own, table = _nets[key]
        cuts = np.array([own.cuts.get(x, 0.5) for x in own.languages])
        for b in batches:
            column = b.column(b.schema.get_field_index(own_name))
            offsets, values = np.asarray(column.offsets) // IDS, np.asarray(column.values).reshape(-1, IDS)
            scores = np.zeros(b.num_rows)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                flat, inside, starts = layout(np.diff(offsets[at : end + 1]).astype(np.int64))
                flat[inside] = table[values[offsets[at] : offsets[end]]]
                p = own.probability(flat, starts)
                t = cuts[own.language(flat, starts)]
                scores[at:end] = np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t))
                at = end
            names = [n for n in b.schema.names if n != own_name]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(np.clip(scores, 0, 1))], names=[*names, to])
        _nets.clear()  # the worker may serve other operators next
        release()

    return ready.mapInArrow(run, schema)


def predicted(column: str = "score") -> Column:
    return (F.col(column) >= CUT).cast("int")


def held_out(id_col: str = "doc_id") -> Column:
    return fold_remainder(id_col, 3) == 1
