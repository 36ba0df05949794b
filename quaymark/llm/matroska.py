"""Media columns in Matroska: a writer and a parser of EBML, as Spark jobs.

``mux`` turns bytes into a Matroska file with one 8-bit PCM track, clusters, laced blocks and
cues.  ``packets`` parses files into a table with one row per frame (track, timestamp, byte range);
``read_back`` returns the stored bytes and features.  Each task works on its own rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small_batches, with_column

#: Element ids of the Matroska specification (fixed values).
EBML, EBML_VERSION, EBML_READ, ID_LENGTH, SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, LACING_FLAG = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {CLUSTER, CUES, INFO, TRACKS}

#: 8 samples a millisecond; frames, frames to a block and blocks to a cluster.
SAMPLE_RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 16
UNIT = 64


def vint(n: int, least: int = 1) -> bytes:
    """A variable-length size; all value bits set would mean an unknown size, so that value takes one byte more."""
    k = least
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(ID_LENGTH, 4) + number(SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
TRACK_LIST = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def ebml_lace(sizes: list[int]) -> bytes:
    """Sizes of all frames but the last: the first as it is, then signed differences."""
    out = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        k, d = 1, b - a
        while abs(d) >= (1 << 7 * k - 1) - 1:
            k += 1
        out += (d + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return out


def block(frames: list[bytes], at: int) -> bytes:
    """A SimpleBlock: fixed lacing for equal frames, EBML lacing for others, none for a single frame."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, lace = 0x84, bytes([len(frames) - 1])
    else:
        flags, lace = 0x86, bytes([len(frames) - 1]) + ebml_lace(sizes)
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at, flags) + lace + b"".join(frames))


def mux_bytes(payload: bytes) -> bytes:
    """The payload as 8-bit samples of one track; the payload's length is a positive multiple of 64."""
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"quaymark") + element(WRITER, b"quaymark"))
    head, points = info + TRACK_LIST, []
    out = [head]
    place, step = len(head), FRAME * LACE * BLOCKS
    for start in range(0, len(payload), step):
        when = start * 1000 // SAMPLE_RATE
        body = [number(TIMESTAMP, when)]
        for b in range(start, min(start + step, len(payload)), FRAME * LACE):
            end = min(b + FRAME * LACE, len(payload), start + step)
            body.append(block([payload[f : min(f + FRAME, end)] for f in range(b, end, FRAME)], (b - start) * 1000 // SAMPLE_RATE))
        cluster = element(CLUSTER, b"".join(body))
        points.append(element(CUE_POINT, number(CUE_TIME, when) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        out.append(cluster)
        place += len(cluster)
    out.append(element(CUES, b"".join(points)))
    return HEADER + element(SEGMENT, b"".join(out))


def read_vint(data, at: int, keep_marker: bool) -> tuple[int, int]:
    """(value, next place); an unknown size gives -1."""
    first = data[at]
    k = 9 - first.bit_length()
    if first == 0 or at + k > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    n = int.from_bytes(data[at : at + k], "big")
    if keep_marker:
        return n, at + k
    n ^= 1 << 7 * k
    return (-1 if n == (1 << 7 * k) - 1 else n), at + k


def elements(data, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, own place, body place, body end) of every element in document order, masters before what they hold."""
    while at < end:
        kind, body = read_vint(data, at, True)
        if inside == CLUSTER and kind in TOP:  # ends a cluster of unknown size
            return
        size, body = read_vint(data, body, False)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element at byte {at} reaches over its parent")
        yield kind, at, body, stop
        if kind in MASTERS:
            last = body
            for x in elements(data, body, stop, kind):
                yield x
                last = max(last, x[3])
            stop = last if size < 0 else stop
        at = stop


def lace_sizes(data, at: int, end: int, kind: int) -> tuple[list[int], int]:
    if kind == 0:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:  # fixed
        if (end - at) % n:
            raise ValueError(f"fixed lace at byte {at} does not divide")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:  # Xiph: bytes are summed up to the first below 255
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        elif i == 0:
            size, at = read_vint(data, at, False)
        else:
            before = at
            raw, at = read_vint(data, at, False)
            k = at - before
            raw = (1 << 7 * k) - 1 if raw < 0 else raw
            size = sizes[-1] + raw - ((1 << 7 * k - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace at byte {at} is longer than its block")
    return sizes, at


def parse(data: bytes) -> dict:
    """Packets (track, timestamp in ms, offset, size, keyframe, cluster, lace place), tracks and cues of a file."""
    out = {"packets": [], "tracks": [], "cues": [], "clusters": 0, "bad_cues": 0}
    scale, base, segment = 1_000_000, 0, 0
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
    at_cluster = set()
    for kind, own, a, b in elements(data, 0, len(data)):
        if kind == SEGMENT:
            segment = a
        elif kind == SCALE:
            scale = uint(a, b)
        elif kind == TRACK:
            out["tracks"].append({"number": 0, "rate": 0.0})
        elif kind == NUMBER:
            out["tracks"][-1]["number"] = uint(a, b)
        elif kind == RATE:
            out["tracks"][-1]["rate"] = real(a, b)
        elif kind == CLUSTER:
            out["clusters"] += 1
            at_cluster.add(own - segment)
        elif kind == TIMESTAMP:
            base = uint(a, b)
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, p = read_vint(data, a, False)
            delta, flags = struct.unpack(">hB", data[p : p + 3])
            sizes, p = lace_sizes(data, p + 3, b, flags >> 1 & 3)
            rate = next((t["rate"] for t in out["tracks"] if t["number"] == track), 0.0)
            first, when = p, (base + delta) * scale / 1e6
            for i, size in enumerate(sizes):
                shift = (p - first) * 1000 / rate if rate else 0.0
                out["packets"].append((track, when + shift, p, size, bool(flags & 0x80), out["clusters"] - 1, i))
                p += size
        elif kind == CUE_POINT:
            out["cues"].append([0, 0])
        elif kind == CUE_TIME:
            out["cues"][-1][0] = uint(a, b)
        elif kind == CUE_CLUSTER:
            out["cues"][-1][1] = uint(a, b)
    out["bad_cues"] = sum(p not in at_cluster for _, p in out["cues"])
    return out


def features(found: dict, payload: bytes) -> str:
    """Counts from the packet table and whole-number statistics of the samples."""
    x = np.frombuffer(payload, np.uint8)
    end = max((t + n * 1000 / SAMPLE_RATE for _, t, _, n, *_ in found["packets"]), default=0.0)
    hist = np.bincount(x >> 5, minlength=8)
    return f"packets={len(found['packets'])};clusters={found['clusters']};cues={len(found['cues'])};bad_cues={found['bad_cues']};ms={end:.0f};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};turns={int(np.count_nonzero(np.diff(x.astype(np.int16))))};hist={'-'.join(map(str, hist.tolist()))}"


def mux(df: DataFrame, text_col: str = "text", to: str = "media") -> DataFrame:
    """The input with a binary column holding each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as Matroska.

    A null text is stored as an empty one, a text of any length whole.  Equal texts give equal files, so repeated rows and ties are stored
    alike; an empty table gives an empty result; a column that has the name ``to`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text_col):
            raw = [(t or "").encode() for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            made = [mux_bytes(t + b"\0" * ((-len(t)) % UNIT if t else UNIT)) for t in raw]
            names = [n for n in b.schema.names if n != to]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(made, pa.binary())], names=[*names, to])

    return df.mapInArrow(run, with_column(df.schema, to, T.BinaryType()))


def read_back(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The input with ``payload`` (the bytes of all packets in file order) and ``feature``; both null for null media.

    A damaged file gives a null payload and the feature ``error: <why>``, an empty one an empty payload.  Equal files, repeated rows among them,
    give equal values; an empty table gives an empty result; columns with these two names are replaced.
    """
    schema = with_column(with_column(df.schema, "payload", T.BinaryType()), "feature", T.StringType())

    def one(media: bytes | None) -> tuple[bytes | None, str | None]:
        if media is None:
            return None, None
        try:
            found = parse(media)
            payload = b"".join(media[p : p + n] for _, _, p, n, *_ in found["packets"])
            return payload, features(found, payload) if payload else "packets=0"
        except (ValueError, IndexError, struct.error) as e:
            return None, f"error: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, media_col):
            got = [one(m) for m in b.column(b.schema.get_field_index(media_col)).to_pylist()]
            names = [n for n in b.schema.names if n not in ("payload", "feature")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(n)) for n in names), pa.array([p for p, _ in got], pa.binary()), pa.array([f for _, f in got], pa.string())], names=[*names, "payload", "feature"])

    return df.mapInArrow(run, schema)


PACKETS = "id string, track long, timestamp_ms double, offset long, size long, keyframe boolean, cluster long, lace long"


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every readable file, with the id as text; null and damaged files give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "media"):
            rows = []
            for i, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(i, *p) for p in parse(media)["packets"]] if media is not None else []
                except (ValueError, IndexError, struct.error):
                    continue
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in PACKETS.split(", ")])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, PACKETS)
