"""Global ranks and exact quantiles without a single-partition sort.

A plain ``Window.orderBy(x)`` (no partition key) plans ``Exchange
SinglePartition``: every row of the table passes through one task. Here ranks
are built from the *distinct-value* table instead:

1. ``groupBy(value).count()`` — map-side combined, so a value held by a third
   of all rows costs one partial row per map task, not one hot reducer;
2. split points from ``approxQuantile`` over the distinct values (a bounded
   array of ``n_buckets`` doubles on the driver) bucket the distinct values;
3. per-bucket totals (``n_buckets`` rows) give each bucket's offset, and a
   window *partitioned by bucket* accumulates counts inside it.

Equal values always fall in one bucket, so ties stay exact. The value table is
joined back on the value column; AQE turns that into a broadcast join when the
runtime size of the table is under the broadcast threshold, and splits skewed
partitions (a hot value) otherwise.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clvforge.session import durable_cut


def _ceil_div(num, den):
    """ceil(num / den) for non-negative integers below 2**53 (exact: the
    double quotient is correctly rounded and never crosses an integer)."""
    return F.ceil(num.cast("double") / den.cast("double")).cast("bigint")


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return int(n_buckets)
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def split_points(df: DataFrame, cols: list[str], n_buckets: int | None = None) -> dict[str, list[float]]:
    """Bucket split points for several columns in ONE approximate-quantile
    pass over the rows (a bounded list of ``n_buckets`` doubles per column).
    Row quantiles bound every bucket to about N / n_buckets rows."""
    nb = _n_buckets(df, n_buckets)
    probs = [i / nb for i in range(1, nb)]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    qs = d.approxQuantile(cols, probs, 0.001)
    return {c: sorted({v for v in q if v is not None}) for c, q in zip(cols, qs)}


def value_rank_table(df: DataFrame, col: str, n_buckets: int | None = None,
                     by: list[str] | None = None, splits: list[float] | None = None) -> DataFrame:
    """Distinct non-null values of ``col`` with ``_cnt`` (rows holding the
    value) and ``_less`` (rows holding a smaller value), optionally within
    groups ``by`` (offsets then accumulate per group). ``splits`` may come
    from ``split_points`` (shared pass); otherwise they are computed here
    over the distinct values."""
    by = list(by or [])
    nb = _n_buckets(df, n_buckets)
    counts = (df.where(F.col(col).isNotNull()).groupBy(*by, col)
                .agg(F.count(F.lit(1)).alias("_cnt"))
                .withColumn("_v", F.col(col).cast("double")))
    counts = durable_cut(counts)  # read for the split points, the totals and the ranks
    if splits is not None:
        cuts = sorted(set(splits))
    else:
        probs = [i / nb for i in range(1, nb)]
        cuts = sorted({c for c in counts.approxQuantile("_v", probs, 0.001)
                       if c is not None})
    splits = [float("-inf")] + cuts + [float("inf")]
    if len(splits) < 3:
        bucketed = counts.withColumn("_b", F.lit(0.0))
    else:
        bucketed = Bucketizer(splits=splits, inputCol="_v", outputCol="_b",
                              handleInvalid="keep").transform(counts)
    totals = bucketed.groupBy(*by, "_b").agg(F.sum("_cnt").alias("_bt"))
    # groups × n_buckets rows: a window over them (per group) is bounded.
    ow = Window.orderBy("_b") if not by else Window.partitionBy(*by).orderBy("_b")
    offsets = totals.select(
        *by, "_b", F.coalesce(F.sum("_bt").over(ow.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*by, "_b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    off_side = F.broadcast(offsets) if not by else offsets
    return (bucketed
            .withColumn("_inb", F.coalesce(F.sum("_cnt").over(inner), F.lit(0)))
            .join(off_side, [*by, "_b"])
            .select(*by, col, "_cnt", (F.col("_off") + F.col("_inb")).alias("_less")))


def _rank_stats(table: DataFrame, col: str):
    """Scalar subquery: struct of N and the counts at the smallest and the
    largest value (one aggregate, reused by every reference)."""
    return table.agg(F.struct(F.sum("_cnt").alias("n"),
                              F.min_by("_cnt", col).alias("lo"),
                              F.max_by("_cnt", col).alias("hi"))).scalar()


def _stable(df: DataFrame, col: str) -> DataFrame:
    """A table joined back on a floating column must not be recomputed: a
    float aggregate can differ in its last bit between two evaluations."""
    from pyspark.sql import types as T
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return durable_cut(df)
    return df


def average_rank(df: DataFrame, col: str, out: str, n_buckets: int | None = None) -> DataFrame:
    """1-based rank of ``col`` with ties given their average rank
    (pandas ``rank(method='average')``). Nulls get a null rank."""
    df = _stable(df, col)
    t = value_rank_table(df, col, n_buckets).select(
        col, (F.col("_less") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return df.join(t, col, "left")


def equal_width_score_table(df: DataFrame, col: str, n: int = 5, reverse: bool = False,
                            out: str = "score", n_buckets: int | None = None,
                            splits: list[float] | None = None) -> DataFrame:
    """Per distinct value: bin (1..n) of its average rank in ``n`` equal-width
    bins spanning [min rank, max rank] (pandas ``cut(rank, bins=n)``).

    Ranks are halves, so everything runs on doubled integer ranks: the bin is
    ``ceil((2r − 2lo)·n / (2hi − 2lo))``, at least 1, exact with no float
    edge. A constant column sits in the middle bin, ceil(n/2).
    """
    t = value_rank_table(df, col, n_buckets, splits=splits)
    stats = _rank_stats(t, col)
    r2 = F.col("_less") * 2 + F.col("_cnt") + 1
    lo2 = stats.getField("lo") + 1
    hi2 = stats.getField("n") * 2 - stats.getField("hi") + 1
    span = hi2 - lo2
    binned = (F.when(span == 0, F.lit((n + 1) // 2))
               .otherwise(F.greatest(F.lit(1), _ceil_div((r2 - lo2) * n, span))))
    score = (F.lit(n + 1) - binned) if reverse else binned
    return t.select(col, score.cast("int").alias(out))


def equal_width_score(df: DataFrame, col: str, n: int = 5, reverse: bool = False,
                      out: str = "score", n_buckets: int | None = None) -> DataFrame:
    """Attach the equal-width rank bin of ``col`` to every row (see table)."""
    df = _stable(df, col)
    return df.join(equal_width_score_table(df, col, n, reverse, out, n_buckets), col, "left")


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "rn",
                      n_partitions: int | None = None) -> DataFrame:
    """E3 core: 1-based position of each row in ``order_cols`` order.

    Range partitioning on the full key (ties broken by the trailing columns,
    so a hot leading value still spreads over many partitions), a sort inside
    each partition, and a per-partition record index. Partition id and index
    are written as columns into a table in the shared checkpoint folder, so
    they are frozen (a recomputation cannot reshuffle them) before the
    per-partition counts (a table of ``n_partitions`` rows) become offsets.
    """
    nb = _n_buckets(df, n_partitions)
    ranged = (df.repartitionByRange(nb, *order_cols).sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_loc", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    ranged = durable_cut(ranged)
    # one row per partition: the window over them and the broadcast are bounded
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, F.col("_off") + F.col("_loc") + 1).drop("_pid", "_loc", "_off"))


def quantile_bin_score(df: DataFrame, col: str, tiebreak: str, n: int = 5,
                       out: str = "score") -> DataFrame:
    """E5: pandas ``qcut(rank(method='first'), n)`` — bins of equal count over
    positions ordered by (col, tiebreak): ``max(1, ceil((rn−1)·n/(N−1)))``."""
    ranked = global_row_number(df.where(F.col(col).isNotNull()), [col, tiebreak], "_rn")
    den = ranked.agg(F.count(F.lit(1))).scalar() - 1
    b = (F.when(den <= 0, F.lit(1))
          .otherwise(F.greatest(F.lit(1), _ceil_div((F.col("_rn") - 1) * n, den))))
    return ranked.withColumn(out, b.cast("int"))


def exact_quantile(df: DataFrame, col: str, q: float, out: str = "q",
                   n_buckets: int | None = None) -> DataFrame:
    """One-row DataFrame with the exact ``q``-quantile of ``col`` (linear
    interpolation between order statistics, as pandas ``quantile`` and SQL
    ``percentile_cont``), computed from the distributed value/rank table."""
    t = value_rank_table(df, col, n_buckets)
    n = t.agg(F.sum("_cnt")).scalar()
    h = (n - 1) * F.lit(float(q))
    k_lo = F.floor(h)
    k_hi = F.ceil(h)
    covers = lambda k: (F.col("_less") <= k) & (k < F.col("_less") + F.col("_cnt"))
    picked = t.where(covers(k_lo) | covers(k_hi)).agg(
        F.max(F.when(covers(k_lo), F.col(col).cast("double"))).alias("_lo"),
        F.max(F.when(covers(k_hi), F.col(col).cast("double"))).alias("_hi"),
        F.max(h - k_lo).alias("_f"))
    return picked.select(
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> DataFrame:
    """One row q0, q1, … with the exact quantiles ``qs`` of ``col``, all read off one value/rank table."""
    t = value_rank_table(df, col)
    n = t.agg(F.sum("_cnt")).scalar()
    v, at = F.col(col).cast("double"), []
    for i, q in enumerate(qs):
        h = (n - 1) * F.lit(float(q))
        on = lambda k: (F.col("_less") <= k) & (k < F.col("_less") + F.col("_cnt"))
        at += [F.max(F.when(on(F.floor(h)), v)).alias(f"_lo{i}"), F.max(F.when(on(F.ceil(h)), v)).alias(f"_hi{i}"),
               F.max(h - F.floor(h)).alias(f"_f{i}")]
    part = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
    return t.agg(*at).select(*[part(i).alias(f"q{i}") for i in range(len(qs))])


def approx_quantile_row(df: DataFrame, col: str, q: float, out: str = "q",
                        accuracy: int = 10000) -> DataFrame:
    """One-row ``percentile_approx`` (bounded-memory sketch) variant."""
    return df.agg(F.percentile_approx(F.col(col).cast("double"), float(q), accuracy).alias(out))


def quantile_row(df: DataFrame, col: str, q: float, out: str = "q", exact: bool = True) -> DataFrame:
    return exact_quantile(df, col, q, out) if exact else approx_quantile_row(df, col, q, out)


def exact_quantiles_by(df: DataFrame, by: list[str], col: str, qs: list[float],
                       names: list[str] | None = None) -> DataFrame:
    """Exact per-group quantiles (linear interpolation) from the grouped
    distributed rank table: no group's values are gathered into one task."""
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    t = value_rank_table(df, col, by=by)
    n = t.groupBy(*by).agg(F.sum("_cnt").alias("_n"))
    j = t.join(n, by)
    v = F.col(col).cast("double")
    aggs, picks = [], []
    for q, nm in zip(qs, names):
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        cov_lo = (F.col("_less") <= lo) & (lo < F.col("_less") + F.col("_cnt"))
        cov_hi = (F.col("_less") <= hi) & (hi < F.col("_less") + F.col("_cnt"))
        picks.append(cov_lo | cov_hi)
        aggs += [F.max(F.when(cov_lo, v)).alias(f"_lo_{nm}"), F.max(F.when(cov_hi, v)).alias(f"_hi_{nm}"),
                 F.max(h - lo).alias(f"_f_{nm}")]
    keep = picks[0]
    for p in picks[1:]:
        keep = keep | p
    g = j.where(keep).groupBy(*by).agg(*aggs)
    return g.select(*by, *[(F.col(f"_lo_{nm}") + (F.col(f"_hi_{nm}") - F.col(f"_lo_{nm}"))
                            * F.col(f"_f_{nm}")).alias(nm) for nm in names])
