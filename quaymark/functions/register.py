"""SQL functions of this engine (section 2.14): native expressions where SQL can state them, Arrow functions otherwise.

The native bodies say the same as the columns of ``operators``; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, pandas_udf

from ..operators.text import LOOKALIKES, ODD_SPACES


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def price_body(t: str, mark: str = r"(?:₽|руб|eur|usd|€|\$)") -> str:
    number = "([0-9][0-9 .,]*)"
    low = f"translate(lower({t}), {quoted(ODD_SPACES)}, {quoted(' ' * len(ODD_SPACES))})"
    marked = f"regexp_extract({low}, {quoted(number + r'\s*' + mark)}, 1)"
    raw = f"regexp_replace(replace(trim(CASE WHEN {marked} <> '' THEN {marked} ELSE regexp_extract({low}, {quoted(number)}, 1) END), ' ', ''), {quoted('[.,]+$')}, '')"
    plain = (
        f"CASE WHEN {raw} RLIKE {quoted('^[0-9]{1,3}([.][0-9]{3})+$')} THEN replace({raw}, '.', '') "
        f"WHEN {raw} RLIKE {quoted('^[0-9.]*,[0-9]{1,2}$')} THEN replace(replace({raw}, '.', ''), ',', '.') ELSE replace({raw}, ',', '') END")
    v = f"try_cast({plain} AS DOUBLE)"
    return f"CASE WHEN {v} > 0 AND {v} <= 1e8 THEN {v} END"


#: A model code and what starts none, as the SQL function reads them.
CODE, NO_CODE = r"\b([A-Z]{2,6}[ -]?[0-9]{1,5}[A-Z]{0,2})\b", "^(?:USB|AUX|LED|IP|MHZ|GHZ|UHF|VHF|FM|AM|RF)"


def code_body(t: str) -> str:
    folded = f"array_join(transform(split({t}, ' '), w -> CASE WHEN w RLIKE '[0-9]' THEN translate(upper(w), {quoted(LOOKALIKES[0])}, {quoted(LOOKALIKES[1])}) ELSE w END), ' ')"
    code = f"upper(regexp_replace(regexp_extract({folded}, {quoted(CODE)}, 1), '[ -]', ''))"
    return f"CASE WHEN {code} <> '' AND NOT {code} RLIKE {quoted(NO_CODE)} THEN {code} END"


STEP = "CASE WHEN v < 1000 THEN 10 WHEN v < 10000 THEN 50 ELSE 100 END"
TOKENS = lambda x: f"array_distinct(split(lower({x}), {quoted(r'[^\p{L}\p{N}]+')}))"
NATIVE = {
    "round_retail_price": ("v DOUBLE", "DOUBLE", f"bround(v / {STEP}) * {STEP}"),
    "unit_price": (
        "price DOUBLE, capacity INT, pack INT DEFAULT NULL, is_system BOOLEAN DEFAULT TRUE, per_piece BOOLEAN DEFAULT FALSE", "DOUBLE",
        "CASE WHEN is_system THEN CASE WHEN capacity >= 2 THEN bround(price / capacity, 2) END WHEN per_piece THEN CASE WHEN pack IS NOT NULL THEN bround(price / pack, 2) WHEN price <= 500 THEN price END ELSE price END"),
    "calibration_factor": ("confirmed BIGINT, n BIGINT", "DOUBLE", "0.6D + 0.55D * ((confirmed + 1) / (n + 2))"),
    "name_similarity": ("a STRING, b STRING", "DOUBLE", f"size(array_intersect({TOKENS('a')}, {TOKENS('b')})) / size(array_union({TOKENS('a')}, {TOKENS('b')}))"),
    "parse_price": ("t STRING", "DOUBLE", price_body("t")),
    "model_key": ("t STRING", "STRING", code_body("t")),
    "recommended_price": (
        "verdict STRING, price DOUBLE, median DOUBLE, approx BOOLEAN DEFAULT FALSE", "DOUBLE",
        "CASE verdict WHEN 'lower' THEN round_retail_price(median) WHEN 'raise' THEN greatest(price, round_retail_price(least(0.95D * median, price * CASE WHEN approx THEN 1.15D ELSE 1.25D END))) ELSE price END"),
}


@pandas_udf(T.DoubleType())
def upper_median(v: pd.Series) -> float:
    """For groups of bounded size, which it holds whole; ``ranks.medians`` takes groups of any size."""
    x = v.dropna().sort_values()
    return float(x.iloc[len(x) // 2]) if len(x) else None


@arrow_udtf(returnType="page_id bigint, name string, price double")
class PageOffers:
    """Offers that pages state as JSON-LD: ``page_offers(TABLE(...))`` over a table with page_id and html, a batch at a time."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        from ..operators.pages import _jsonld

        column = lambda n: pages.column(pages.schema.get_field_index(n)).to_pylist()
        rows = [(i, x[0], x[1]) for i, h in zip(column("page_id"), column("html")) for x in _jsonld(h or "")]
        yield pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "name": pa.array([r[1] for r in rows], pa.string()), "price": pa.array([r[2] for r in rows], pa.float64())})


def register_functions(spark: SparkSession) -> list[str]:
    """Register all functions for SQL in this session; returns their names."""
    for name, (args, kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("upper_median", upper_median)
    spark.udtf.register("page_offers", PageOffers)
    return [*NATIVE, "upper_median", "page_offers"]
