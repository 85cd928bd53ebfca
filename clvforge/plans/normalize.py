"""Output normalisation shared by registered queries and their SQL twins.

Float sums depend on addition order, so the two engines differ in the last
bits. Both sides therefore round every double to ``BITS`` significant binary
digits: y = round(x · 2^(BITS − e)) / 2^(BITS − e), e = floor(log2 |x|).
Scaling by a power of two is exact, so the result is bit-identical in both
engines unless the noise straddles a rounding boundary (≈ 2^-16 per value).
A binary grid also never lines up with the decimal cents of money values,
which a decimal rounding would turn into exact ties. Timestamps and dates are
rendered as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 30


def _round_col(c):
    x = c.cast("double")
    s = F.pow(F.lit(2.0), F.lit(BITS) - F.floor(F.log2(F.abs(x))))
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0)
    return F.when(ok, F.round(x * s) / s).otherwise(x)


class SqlText(str):
    """SQL text that remembers which double columns it normalises, so the
    Spark side rounds exactly the same columns."""
    doubles: tuple = ()


def normalize(df: DataFrame, doubles=None) -> DataFrame:
    """Round the given double columns (all of them when ``doubles`` is None)
    and render timestamps/dates as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        pick = doubles is None or f.name in doubles
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            if pick:
                c = _round_col(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_round(expr: str) -> str:
    x = f"({expr})"
    s = f"pow(2.0, {BITS} - floor(log2(abs({x}))))"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) OR {x} = 0 THEN {x} "
            f"ELSE round({x} * {s}) / {s} END)")


def sql_wrap(inner: str, doubles: list[str] = (), timestamps: list[str] = (),
             dates: list[str] = ()) -> str:
    """Wrap a DuckDB query so its output matches ``normalize``."""
    repl = [f"{sql_round(f'CAST({c} AS DOUBLE)')} AS {c}" for c in doubles]
    repl += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in timestamps]
    repl += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    out = SqlText(f"SELECT * REPLACE ({', '.join(repl)}) FROM ({inner}) AS _q" if repl else inner)
    out.doubles = tuple(doubles)
    return out
