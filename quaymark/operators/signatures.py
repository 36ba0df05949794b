"""Joins of 64-bit signatures that differ in few bits (section 2.5)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Near values that one signature may ask for, over all bands: the size of the broadcast table of flips.
MOST_PROBES = 20_000
#: Bands that are tried at most, and what a candidate costs next to a probe.
MOST_BANDS, CANDIDATE = 16, 1.0


@dataclass(frozen=True)
class Band:
    """Some bits of a signature and in how many of them a near pair may differ here."""

    bits: tuple[int, ...]
    most: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        return [signed(sum(1 << b for b in c)) for k in range(self.most + 1) for c in combinations(self.bits, k)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bit_shares(df: DataFrame, sig: str) -> tuple[int, list[float]]:
    """Rows, and the share of them in which each bit is set: one aggregate."""
    ones = [F.sum(F.shiftrightunsigned(sig, b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    row = df.agg(F.count(sig).alias("n"), *ones).first()
    return row["n"], [(row[f"b{b}"] or 0) / max(1, row["n"]) for b in range(BITS)]


def within(shares: list[float]) -> list[float]:
    """Chance that at most t of some bits differ, for each t, if bit i differs with chance shares[i]."""
    exact = [1.0]
    for p in shares:
        exact = [a * (1 - p) + b * p for a, b in zip([*exact, 0.0], [0.0, *exact], strict=True)]
    out, total = [], 0.0
    for x in exact:
        total += x
        out.append(min(1.0, total))
    return out


def deal_bits(n_left: int, n_right: int, differ: list[float], most: int) -> list[Band]:
    """The bands with the least expected work for all pairs within ``most`` differing bits.

    If thresholds plus one add up to most + 1, a near pair is within its threshold in some band, so a band whose bits tell
    little gets a low threshold or none.  ``differ`` is how often each bit differs between the sides.  More rows ask for
    fewer and wider bands, as candidates grow with the product of both sides and probes with one of them.
    """
    order = sorted(range(BITS), key=lambda b: -min(differ[b], 1 - differ[b]))
    best: tuple[float, list[Band]] = (inf, [])
    for m in range(1, min(MOST_BANDS, most + 1) + 1):
        parts = [tuple(sorted(order[b::m])) for b in range(m)]
        reached: dict[int, tuple[float, int, tuple[int, ...]]] = {0: (0.0, 0, ())}  # by the sum of thresholds plus one
        for bits in parts:
            near = within([differ[b] for b in bits])
            following: dict[int, tuple[float, int, tuple[int, ...]]] = {}
            for spent, (cost, probes, chosen) in reached.items():
                here = 0
                for t in range(-1, min(len(bits), most) + 1):
                    here += comb(len(bits), t) if t >= 0 else 0
                    if probes + here > MOST_PROBES:
                        break
                    more = cost + (n_right * here + CANDIDATE * n_left * n_right * near[t] if t >= 0 else 0)
                    to = min(most + 1, spent + t + 1)
                    if to not in following or more < following[to][0]:
                        following[to] = (more, probes + here, (*chosen, t))
            reached = following
        if most + 1 in reached and reached[most + 1][0] < best[0]:
            best = reached[most + 1][0], [Band(bits, t) for bits, t in zip(parts, reached[most + 1][2], strict=True) if t >= 0]
    if not best[1]:
        raise ValueError(f"no bands for {most} bits")
    return best[1]


def hamming_candidates(left: DataFrame, right: DataFrame, most: int, sig: str, id_col: str, second: str | None, bands: list[Band], probe_right: bool) -> DataFrame:
    """(band, id, sig, id2, sig2, ...) of every pair that is near in a band, once for each such band: an equi join on the band's bits."""
    spark = left.sparkSession
    flips = spark.createDataFrame([(i, f) for i, b in enumerate(bands) for f in b.flips()], "band int, flip long")

    def banded(df: DataFrame, n: str) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(i).alias("band"), F.col(sig).bitwiseAND(F.lit(b.mask)).alias("value")) for i, b in enumerate(bands)))
        cols = [F.col(id_col).alias(f"id{n}"), F.col(sig).alias(f"sig{n}"), *([F.col(second).alias(f"second{n}")] if second else [])]
        return df.filter(F.col(sig).isNotNull()).select(*cols, F.explode(parts).alias("_b")).select("*", "_b.band", "_b.value").drop("_b")

    def asking(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(flips), "band").withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")  # at most MOST_PROBES flips

    a, b = banded(left, ""), banded(right, "2")
    return a.join(asking(b), ["band", "value"]) if probe_right else asking(a).join(b, ["band", "value"])


def hamming_pairs(left: DataFrame, right: DataFrame, most: int, sig: str = "sig", id_col: str = "vec_id", second: str | None = None) -> DataFrame:
    """(id, id2, distance) of signatures within ``most`` differing bits, ids apart; a ``second`` signature goes along and gives distance2.

    The bits are dealt to bands, each with a threshold of its own (``deal_bits``), by counts of both tables.  The smaller side asks in
    each band for all values within the threshold; the first band that is near speaks for a pair.  Null signatures are near to nothing.
    """
    if not 0 <= most < BITS:
        raise ValueError("most must be 0 to 63")
    (n, p), (n2, q) = bit_shares(left, sig), bit_shares(right, sig)
    differ = [a * (1 - b) + b * (1 - a) for a, b in zip(p, q, strict=True)]
    bands = deal_bits(max(n, n2), min(n, n2), differ, most)
    bits = F.col("sig").bitwiseXOR(F.col("sig2"))
    found = hamming_candidates(left, right, most, sig, id_col, second, bands, n2 <= n)
    first: Column = F.coalesce(*(F.when(F.bit_count(bits.bitwiseAND(F.lit(b.mask))) <= b.most, i) for i, b in enumerate(bands)))
    apart = [F.bit_count(F.col("second").bitwiseXOR(F.col("second2"))).alias("distance2")] if second else []
    near = found.filter((F.col("id") != F.col("id2")) & (F.bit_count(bits) <= most) & (F.col("band") == first))
    return near.select("id", "id2", F.bit_count(bits).alias("distance"), *apart)


def signature_levels(
    left: DataFrame, right: DataFrame, sig: str = "sig", step: str = "step", id_col: str = "vec_id", same: tuple[int, int] = (6, 10), similar: tuple[int, int] = (12, 16),
) -> DataFrame:
    """Pairs near in both signatures, with a level: ``same`` or ``similar`` by the most bits that the first and the second may differ in.

    The first signature finds the candidates; a pair that is far in the second one is no match.
    """
    x = hamming_pairs(left, right, max(same[0], similar[0]), sig, id_col, step)
    near = lambda most: (F.col("distance") <= most[0]) & (F.col("distance2") <= most[1])
    level = F.when(near(same), "same").when(near(similar), "similar")
    return x.withColumn("level", level).filter("level IS NOT NULL").select("id", "id2", "distance", "distance2", "level")
