"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clvforge.llm.common import cut, join_lookup
from clvforge.operators.ranks import global_row_number

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources are ordered by code point, null last, and weigh ``cycle``, repeating. They share the total
    size by weight, none above ``most`` times its size; what is left over is shared again by weight
    among the others, until none is above. Sources may be as many as documents: they are numbered by
    a distributed sort, and each round is one aggregation, of which the driver sees two sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull().cast("int"))
    order = global_row_number(per, ["none", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.pmod(F.col("place") - 1, F.lit(len(cycle))) + 1).cast("int"))
    sources = cut(order.select("source", "source_size", weight.alias("weight")))
    free = sources.filter("source_size > 0")
    bound = F.col("source_size") * most
    total, weights = free.agg(F.sum("source_size"), F.sum("weight")).first()
    share, capped = (total / weights if weights else 0.0), -1
    while weights:
        over = F.col("weight") * share > bound
        n, taken, left = free.agg(F.sum(over.cast("long")), F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not left:
            break
        share, capped = (total - (taken or 0.0)) / left, n
    target = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(float(share)), bound.cast("double"))).otherwise(F.lit(0.0))
    return cut(sources.select("source", "source_size", target.alias("target")))


def _rate(tilt, x, most: float):
    """Exponentially tilted rate that starts at 1 and stays between 0 and ``most``."""
    return F.lit(most) / (F.lit(1.0) + F.lit(most - 1.0) * F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), tilt * x))))


def tilts(strata: DataFrame, targets: DataFrame, most: float = 3.0, rounds: int = 300, close: float = 1e-9) -> DataFrame:
    """(source, unit, tilt): distributed Newton iterations on the dual of the entropy balancing problem.

    strata: (source, size, n). The rate of a document of size s is ``most / (1 + (most - 1) *
    exp(-tilt * s / unit))``, the rate nearest to 1 in (bounded) relative entropy for which the
    source's expected size is its target. The dual is convex and separable, one tilt a source;
    each round sums gradient and curvature of all open sources in one aggregation and takes a Newton
    step inside the bracket that the signs of the gradients have left, else halves it. ``unit`` is
    the source's mean size, so that a tilt near 1 is a strong one. A target at the bound gives all
    documents the bound. Tilts and brackets are a table that Spark updates; a source that has not
    reached its target within ``rounds`` is an error.
    """
    unit = strata.filter("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    wide, full = F.lit(float("inf")), F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = cut(targets.alias("t").join(unit.alias("u"), F.expr("t.source <=> u.source")).select(
        "t.source", "source_size", "target", "unit",
        F.when(full, 1e6).when(F.col("target") <= 0, -1e6).otherwise(0.0).alias("tilt"),
        (-wide).alias("low"), wide.alias("high"), (~full & (F.col("target") > 0)).alias("open")))
    x, gap = F.col("size") / F.col("unit"), F.col("got") - F.col("target")
    rate = _rate(F.col("tilt"), x, most)
    for _ in range(rounds):
        if not state.filter("open").take(1):
            return state.select("source", "unit", "tilt")
        sums = (strata.alias("h").join(state.filter("open").alias("l"), F.expr("h.source <=> l.source"))
                .groupBy("l.source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                                         F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope")))
        known = state.alias("s").join(sums.alias("g"), F.expr("s.source <=> g.source"), "left").select("s.*", "got", "slope")
        known = known.withColumn("met", F.abs(gap) <= close * F.col("source_size"))
        known = known.withColumn("low", F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low"))).withColumn(
            "high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope"))
        unbounded = (F.col("low") == -wide) | (F.col("high") == wide)
        outward = F.col("tilt") + F.when(gap < 0, 4.0).otherwise(-4.0) * (1 + F.abs("tilt"))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).when(unbounded, outward).otherwise(
            (F.col("low") + F.col("high")) / 2)
        moved = known.withColumn("next", F.when(F.col("met"), F.col("tilt")).otherwise(step))
        go_on = F.col("open") & ~F.col("met") & (F.col("next") != F.col("tilt"))
        state = cut(moved.select(
            "source", "source_size", "target", "unit",
            F.when(F.col("open"), F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col("next")))).otherwise(F.col("tilt")).alias("tilt"),
            "low", "high", F.coalesce(go_on, F.lit(False)).alias("open")))
    raise RuntimeError(f"some sources have not reached their targets in {rounds} rounds")


def _round_strata(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one source's strata, largest size first.

    What rounding a stratum leaves over, or takes too much, is carried to the next smaller size. Of
    the two neighbouring whole numbers, the one whose rest the smaller sizes can still make good
    (each document has at most one extra copy, at least none) is taken, else the nearer one.
    """
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    size, n, part = (pdf[c].to_numpy(float) for c in ("size", "n", "part"))
    expected = part * n * size
    can_drop = expected.sum() - np.cumsum(expected)
    can_add = (n * size).sum() - np.cumsum(n * size) - can_drop
    extra, carry = [], 0.0
    for i in range(len(size)):
        if not size[i]:
            extra.append(0)
            continue
        carry += expected[i]
        low = min(n[i], max(0.0, np.floor(carry / size[i] + 1e-9)))

        def miss(take: float) -> tuple[float, float]:
            rest = carry - take * size[i]
            return max(0.0, rest - can_add[i], -rest - can_drop[i]), abs(rest)

        take = min((low, min(n[i], low + 1)), key=miss)
        carry -= take * size[i]
        extra.append(int(take))
    return pdf.assign(extra=extra)[["source", "size", "n", "base", "extra"]]


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, cell: int = 512,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each document.

    Size is the number of runs of other than ASCII white space (null text: 0). Rates come from
    ``tilts``; they depend on source and size only, so they are computed on the table of strata
    (source, size, number), which stays small where a source is hot. Rates are rounded to whole
    copies stratum by stratum, the rounding error being carried to the next smaller size; so a
    source's taken words miss its target by about half of a small document. Which documents of a
    stratum get the extra copy is decided by a hash of the id, in cells of about ``cell`` documents
    so that a hot stratum is not one task's; reruns agree. Repeated rows count as documents of their
    own; empty texts have size 0, are taken 0 words and keep one copy. An empty table gives no rows.
    """
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                            word_count(F.col(text_col)).alias("size")))
    strata = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(strata.select("source", (F.col("size") * F.col("n")).alias("size")), cycle, float(most))
    tilt = tilts(strata, targets, float(most))
    rate = F.coalesce(_rate(F.col("tilt"), F.col("size") / F.col("unit"), float(most)), F.lit(1.0))
    rated = strata.alias("h").join(tilt.alias("t"), F.expr("h.source <=> t.source"), "left").select(
        "h.source", "size", "n", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate).alias("rate"))
    parts = rated.select("source", "size", "n", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("part"))
    rounded = cut(parts.groupBy("source").applyInPandas(
        _round_strata, "source string, size long, n long, base long, extra long"))
    celled = join_lookup(sized, rounded, ["source", "size"]).select(
        "doc_id", "source", "size", "n", "base", "extra", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / cell)).alias("cell"))
    in_cell = celled.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"),
                                                           F.first("extra").alias("extra"))
    upto = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("m").over(upto) - F.col("m")
    share = (F.floor((before + F.col("m")) * F.col("extra") / F.col("n") + 1e-9)
             - F.floor(before * F.col("extra") / F.col("n") + 1e-9)).alias("share")
    dealt = in_cell.select("source", "size", "cell", share)
    w = Window.partitionBy("source", "size", "cell").orderBy(F.xxhash64("doc_id", F.lit("extra")), "doc_id")
    chosen = (celled.withColumn("rank", F.row_number().over(w)).alias("c")
              .join(dealt.alias("k"), F.expr("c.source <=> k.source AND c.size = k.size AND c.cell = k.cell")))
    copies = (F.col("base") + (F.col("rank") <= F.col("share")).cast("long")).alias("copies")
    picked = chosen.select("doc_id", F.col("c.source").alias("source"), F.col("c.size").alias("size"), copies)
    return (picked.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
            .select("doc_id", "p.source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document as often as the mix takes it, with the columns of ``docs``.

    Rows that share an id have together just as many copies as the mix takes of that id, dealt to
    them as evenly as may be, in the order of their texts' hashes; only such rows are numbered.
    """
    count = cut(mixed.groupBy("doc_id").agg(F.sum("copies").alias("_c"), F.count(F.lit(1)).alias("_r")))
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    once = packed.join(count.filter("_r = 1 AND _c > 0"), F.expr("_id <=> doc_id")).select("_row", F.col("_c").alias("_n"))
    repeated = count.filter("_r > 1 AND _c > 0")
    if repeated.isEmpty():
        copies = once
    else:
        several = packed.join(repeated, F.expr("_id <=> doc_id")).select("_id", "_row", "_c", "_r", F.xxhash64("_row").alias("_h"))
        placed = global_row_number(several.withColumn("_none", F.col("_id").isNull().cast("int")), ["_none", "_id", "_h"], "_k")
        start = placed.groupBy("_id").agg(F.min("_k").alias("_first"))
        at = F.col("p._k") - F.col("s._first")
        upto = lambda k: F.floor(k * F.col("p._c") / F.col("p._r"))
        dealt = placed.alias("p").join(start.alias("s"), F.expr("p._id <=> s._id")).select("p._row", (upto(at + 1) - upto(at)).alias("_n"))
        copies = once.unionByName(dealt).filter("_n > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
