"""Tables of positions: pivots, densities, gaps, densest windows, rankings and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pivot_counts(hits: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of hits by row and column; 0 where there is none. Declared values spare the pass that would find them."""
    return hits.groupBy(row).pivot(column, values).count().na.fill(0)


def density(hits: DataFrame, keys: list[str], pos: str, bin_size: int, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(keys, bin, n): hits in half-open bins; with hi, the last bin also holds its upper edge."""
    b = F.floor((F.col(pos) - lo) / bin_size)
    if hi is not None:
        b = F.least(b, F.lit(max(0, -(-(hi - lo) // bin_size) - 1)))
        hits = hits.where(F.col(pos).between(lo, hi))
    return hits.groupBy(*keys, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Bits of a position that one task orders: a key's hits are split into stretches of so many places, those into stretches of
#: as many, and so on up to the whole.
STRETCH_BITS, LEVELS = 20, 3


def _same(left: str, right: str, columns: list[str]):
    """Equality of columns of two aliased tables; null equals null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def previous(hits: DataFrame, keys: list[str], pos: str, name: str = "previous", levels: int = LEVELS, bits: int = STRETCH_BITS) -> DataFrame:
    """Rows with the position before theirs in their group, null for the first.

    A hot group is many tasks' work: rows are ordered within stretches of 2^bits places, and the first of a stretch takes the
    last position of the stretch before, which is found the same way among the stretches' last positions, a row a stretch.
    So a task orders 2^bits places at most, times the rows at each. Stretches follow from the positions alone: nothing is
    sampled and a task that is run again gives the same rows. The last level is one stretch a group, of 2^(bits levels) places."""
    if levels == 1:
        return hits.withColumn(name, F.lag(pos).over(W.partitionBy(*keys).orderBy(pos)))
    stretch, last, before = (f"{c}{levels}" for c in ("_stretch", "_last", "_before"))
    rows = hits.withColumn(stretch, F.floor(F.col(pos) / (1 << bits)))
    own_rows = rows.withColumn("_own", F.lag(pos).over(W.partitionBy(*keys, stretch).orderBy(pos)))
    ends = rows.where(F.col(pos).isNotNull()).groupBy(*keys, stretch).agg(F.max(pos).alias(last))
    # Stretches are numbered by their place, so the one before is the previous number that there is.
    above = previous(ends.select(*keys, stretch), keys, stretch, before, levels - 1, bits)
    carried = above.alias("b").join(ends.alias("e"), _same("b", "e", keys) & (F.col(f"b.{before}") == F.col(f"e.{stretch}")))
    carried = carried.select(*[F.col(f"b.{c}").alias(c) for c in [*keys, stretch]], F.col(f"e.{last}").alias("_carried"))
    columns = [F.col(f"r.{c}").alias(c) for c in hits.columns]
    value = F.coalesce("r._own", F.when(F.col(f"r.{pos}").isNotNull(), F.col("l._carried")))
    return own_rows.alias("r").join(carried.alias("l"), _same("r", "l", [*keys, stretch]), "left").select(*columns, value.alias(name))


def gaps(hits: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Rows with the distance to the hit before, null for the first of each group; a group may be of any size."""
    return previous(hits, keys, pos, "_previous").withColumn("gap", F.col(pos) - F.col("_previous")).drop("_previous")


def median_gap(hits: DataFrame, keys: list[str], pos: str, least: int = 3) -> DataFrame:
    """(keys, n, period): the median gap, averaged between the middle two and cut to a whole number; null for fewer than
    ``least`` positions.

    Gaps are counted by value before they are shuffled, and the middle is found by running counts over values. Gaps sum to
    the group's span, so a span of R places has at most sqrt(2 R) different ones: what one task orders is small."""
    each = gaps(hits, keys, pos).groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*keys)
    known = F.when(F.col("gap").isNotNull(), F.col("_n"))
    ranked = each.withColumn("_all", F.sum("_n").over(whole)).withColumn("_gaps", F.sum(known).over(whole)).withColumn("_upto", F.sum(known).over(whole.orderBy("gap")))
    at = lambda rank: F.min(F.when(F.col("gap").isNotNull() & (F.col("_upto") >= rank), F.col("gap")))
    lower, upper = at(F.floor((F.col("_gaps") + 1) / 2)), at(F.floor(F.col("_gaps") / 2) + 1)
    out = ranked.groupBy(*keys).agg(F.max("_all").alias("n"), F.floor((lower + upper) / 2).alias("m"))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.col("m")).alias("period"))


def window_counts(hits: DataFrame, keys: list[str], pos: str, width: int, step: int, close: bool) -> DataFrame:
    """(keys, w0, n): hits in windows of ``width`` that start at the least position, then at every ``step``.

    Each position goes to the windows that hold it, at most width / step of them; no position meets another. Starts stay
    below the largest position less the width, or reach it where close is true."""
    edge = hits.groupBy(*keys).agg(F.min(pos).alias("mn"), F.max(pos).alias("mx"))
    r = hits.join(edge, keys)
    first = F.greatest(F.floor((F.col(pos) - F.col("mn") - width) / step) + 1, F.lit(0))
    last = F.floor((F.col(pos) - F.col("mn")) / step)
    w = r.withColumn("j", F.explode(F.sequence(first, last))).withColumn("w0", F.col("mn") + F.col("j") * step)
    w = w.where(F.col("w0") <= F.col("mx") - width if close else F.col("w0") < F.col("mx") - width)
    return w.groupBy(*keys, "w0").agg(F.count(F.lit(1)).alias("n"))


def densest_window(hits: DataFrame, keys: list[str], pos: str, width: int = 50_000, step: int = 5_000) -> DataFrame:
    """(keys, w0, n): the fullest window, the earliest of equals. Groups that span no more than a window fall back to
    the window at 0, with the hits that lie in it."""
    w = window_counts(hits, keys, pos, width, step, False)
    best = w.groupBy(*keys).agg(F.max_by(F.struct("w0", "n"), F.struct("n", -F.col("w0"))).alias("b")).select(*keys, "b.w0", "b.n")
    zero = hits.groupBy(*keys).agg(F.count_if(F.col(pos).between(0, width - 1)).alias("n0"))
    return zero.join(best, keys, "left").select(*keys, F.coalesce("w0", F.lit(0)).cast("long").alias("w0"), F.coalesce("n", "n0").alias("n"))


def densest_window_or_none(hits: DataFrame, keys: list[str], end: str, pos: str, least: int = 5, width: int = 50_000, step: int = 5_000) -> DataFrame:
    """(keys, end, w0, n): the fullest window over both ends, each with at least ``least`` hits; ties go to the first end
    by name and the earliest start. Groups whose ends all span less than a window are left out."""
    many = hits.groupBy(*keys, end).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).drop("c")
    w = window_counts(hits.join(many, [*keys, end], "left_semi"), [*keys, end], pos, width, step, True)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), end, "w0"))
    return w.withColumn("r", rank).where("r = 1").drop("r")


def first_non_null(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """One row a group: of each column the first value in the order that is not null, so a null of the best row is filled
    from the next. order: (column, whether it falls) pairs of numbers or, rising only, of text. An aggregate: a group is
    never held."""
    at = F.struct(*[(-F.col(c) if falls else F.col(c)).alias(f"o{i}") for i, (c, falls) in enumerate(order)])
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def compare_counts(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Full outer comparison of two count tables; missing counts are 0."""
    a, b = left.select(*keys, F.col(n).alias("n_left")), right.select(*keys, F.col(n).alias("n_right"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, only_in): distinct ids of one side alone."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("only_in")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("right").alias("only_in")))


def group_share(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """(key, label, share): the label with the largest sum and its share of the key's sum; ties to the first label."""
    s = df.groupBy(key, label).agg(F.sum(value).alias("s"))
    s = s.withColumn("share", F.col("s") / F.sum("s").over(W.partitionBy(key)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("s"), label))
    return s.withColumn("r", rank).where("r = 1").select(key, label, "share")


def span(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, lo, hi, span_kb)."""
    g = df.groupBy(*keys).agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    return g.withColumn("span_kb", (F.col("hi") - F.col("lo")) / 1000.0)


def longest_per_group(df: DataFrame, keys: list[str], length: str, order: str) -> DataFrame:
    """The row of the greatest length of each group, the first in order among equals."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(length), -F.col(order))).alias("r"))
    return one.select(*keys, "r.*")


def first_match(df: DataFrame, keys: list[str], order: str, found) -> DataFrame:
    """Of each group, the first row in order that the condition holds for; groups without one are left out."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(found).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
