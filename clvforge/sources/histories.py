"""A3: nested customer histories (request bodies) to transaction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clvforge import schemas as S


def explode_histories(hist: DataFrame, date_format: str | None = None) -> DataFrame:
    """One row per history entry: customer_id, invoice_ts, revenue.

    ``explode`` is a narrow generator, so each nested row is expanded in the
    task that read it; nothing is gathered per customer.
    """
    e = hist.select(S.CUST, F.explode("transactions").alias("t"))
    ts = (F.to_timestamp_ntz("t.date", F.lit(date_format)) if date_format
          else F.to_timestamp_ntz("t.date"))
    return e.select(S.CUST, ts.alias(S.TS), F.col("t.amount").alias(S.REVENUE))


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """Histories as JSON lines with the declared nested schema."""
    return spark.read.schema(S.HISTORY_SCHEMA).json(path)


def histories_from_lines(tx: DataFrame, max_entries: int = 1000) -> DataFrame:
    """Build request-shaped histories from invoice lines: bodies per
    (customer, invoice) holding that invoice's dated line amounts, split into
    bodies of at most ``max_entries`` entries (positions come from a
    distributed row number, so even a huge invoice never becomes one array)."""
    from clvforge.operators.ranks import global_row_number
    lines = tx.select(S.CUST, S.INVOICE, S.TS, S.STOCK, S.REVENUE)
    numbered = global_row_number(lines, [S.CUST, S.INVOICE, S.TS, S.STOCK, S.REVENUE], "_pos")
    body = F.floor((F.col("_pos") - 1) / max_entries).alias("_body")
    return (numbered.groupBy(S.CUST, S.INVOICE, body)
              .agg(F.collect_list(F.struct(
                  F.date_format(S.TS, "yyyy-MM-dd HH:mm:ss").alias("date"),
                  F.col(S.REVENUE).alias("amount"))).alias("transactions"))
              .select(F.col(S.CUST).cast("string").alias(S.CUST), S.INVOICE, "transactions"))
