"""Mixing sources to target weights along a curriculum; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, partitions

#: A source is repeated so often at most.
MAX_REPEATS = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Phases of the default curriculum: (end of the phase as a share of training, factor of each weight of the cycle).
#: Each source still gets its target over the whole: the factors only move its words earlier or later.
CURRICULUM = ((0.25, (1.0, 0.5, 0.25)), (0.75, (1.0, 1.0, 1.0)), (1.0, (1.0, 1.5, 1.75)))
#: Rows of one bucket of all sources, about, or the root of their number if that is more. A running sum within a bucket, and
#: one over a source's buckets, are one task's work; so both grow with the root.
BUCKET_ROWS = 1_000
SEED = 20240607


def ranked(df: DataFrame, *keys) -> DataFrame:
    """df with the column rank, from 0, in the order of the keys: a range sort, then the rows before each partition."""
    spark = df.sparkSession
    sorted_ = materialize(df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    # monotonically_increasing_id is the partition shifted by 33 bits and the row's number in it; one row a partition follows.
    part = F.shiftright("_place", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_place", "_before")


def water_fill(sources: DataFrame, total: int, repeats: float = MAX_REPEATS) -> DataFrame:
    """sources (weight, source_size) with target: shares of total by weight, none above repeats times its source's size.

    Each round gives what the full sources leave to the others by weight; it ends when no source becomes full. The
    rounds sum over a table with a row a source, and only the level (words for a unit of weight) goes to the driver."""
    cap = F.col("source_size") * F.lit(float(repeats))
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("held"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open")).first()
        rest, open_ = total - (row.held or 0.0), row.open or 0.0
        new = rest / open_ if open_ > 0 else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


#: Bits of the hash that documents of a source are ordered by.
HASH_BITS = 60


def drawn(id_: Column, seed: int) -> Column:
    """A hash of an id, of HASH_BITS bits, that SQL can give as well; null counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def phases(curriculum, weights) -> tuple[list[float], list[list[float]]]:
    """(ends of the phases in curriculum time, for each weight of the cycle the shares of its words in the phases)."""
    ends = [0.0] + [float(e) for e, _ in curriculum]
    if sorted(ends) != ends or ends[-1] != 1.0:
        raise ValueError("phases must rise to 1")
    masses = [[(b - a) * float(f[i % len(f)]) for a, b, (_, f) in zip(ends, ends[1:], curriculum)] for i in range(len(weights))]
    if any(sum(m) <= 0 for m in masses):
        raise ValueError("each weight needs a phase")
    return ends, [[x / sum(m) for x in m] for m in masses]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, curriculum=CURRICULUM, repeats: int = MAX_REPEATS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, row_col: str | None = None) -> DataFrame:
    """What the mix takes of each document: a row a row of docs, range-sorted by the position of its first copy.

    Columns: id, size, source, source_size, target, taken, last_words, positions, and row_col if given (a column that tells
    rows apart). Sources in the order of their names, null last, get the weights in turn, repeating. A source's weight at a
    time is its target, spread over the phases by the curriculum's factors, in proportion to what all sources have then; so
    the mix is whole at every time, and a position is a share of all tokens of the training. The integral of a source's
    weight is the cumulative demand for its words. Documents of a source follow one another in hash order, again and
    again; the copy that begins at word c stands where the demand reaches c. positions has one entry in [0, 1] for each
    copy that begins before the target is met; the last copy may be cut to last_words words, so that the words taken of a
    source are the whole part of its target.

    Null text has size 0, takes nothing and has no position; so does a source without words. Rows that repeat an id are
    documents of their own. Null ids and sources are kept; an empty table gives no rows."""
    spark = docs.sparkSession
    carried = [row_col] if row_col else []
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # Rows without an id are spread by their texts, or by what tells them apart.
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.col(row_col).cast("string") if row_col else F.xxhash64(F.col(text_col)).cast("string")))
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), drawn(own, seed).alias("h"), *carried), "sizes")
    n_rows = rows.count()
    # Buckets are ranges of the hash, so their order is that of the hash.
    buckets = max(1, -(-n_rows // max(bucket_rows, int(n_rows**0.5))))
    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - (buckets - 1).bit_length()))
    parts = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    totals = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    n = len(weights)
    sources = ranked(totals, F.col("source").asc_nulls_last())
    turn = F.pmod(F.col("rank"), F.lit(n)).cast("int")
    sources = materialize(sources.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)), "sources")
    total = sources.agg(F.sum("source_size").alias("t")).first().t or 0
    targets = materialize(water_fill(sources, total, repeats).withColumn("goal", F.floor("target")), "targets")
    wanted = {r.turn: float(r.t) for r in targets.groupBy("turn").agg(F.sum("target").alias("t")).collect()}  # a row a weight
    starts = parts.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    # A row for each source and bucket: it joins a hot source's documents by bucket, not by source alone.
    plan = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.bucket", F.coalesce("before", F.lit(0)).alias("before"), "source_size", "target", "goal", "turn")
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "size", *carried).rowsBetween(W.unboundedPreceding, -1)
    each = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    each = each.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))).select("a.id", "a.source", "a.size", *[f"a.{c}" for c in carried], (F.col("a.inside") + F.col("b.before")).alias("at"), "b.source_size", "b.target", "b.goal", "b.turn")
    # Copies: whole rounds of the source, and one more where the rest of the target reaches past the document's begin.
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    each = each.withColumn("rounds", rounds.cast("long")).withColumn("rest", F.least(F.greatest(F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("at"), F.lit(0)), F.col("size")))
    each = each.withColumn("taken", F.col("size") * F.col("rounds") + F.col("rest"))
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("rest") > 0).cast("long")).otherwise(0)
    position = demand_inverse(curriculum, weights, [wanted.get(i, 0.0) for i in range(n)])
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)).cast("int") - 1), lambda k: position((F.col("at") + k * F.col("source_size")) / F.col("target"), F.col("turn")))).otherwise(F.array().cast("array<double>"))
    out = each.withColumn("positions", positions).select(F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target", "taken", F.when(F.col("rest") > 0, F.col("rest")).otherwise(F.when(F.col("rounds") > 0, F.col("size")).otherwise(0)).alias("last_words"), "positions", *carried)
    first = F.get("positions", F.lit(0))
    return out.repartitionByRange(partitions(spark), first.asc_nulls_last(), F.col(id_col)).sortWithinPartitions(first.asc_nulls_last(), F.col(id_col))


def demand_inverse(curriculum, weights, wanted: list[float]):
    """A function of (share of the source's demand, turn of the source): the training position where it is reached.

    wanted: the words due to all sources of each turn. Within a phase all rates are constant, so time runs in proportion to
    tokens there: a phase ends at the share of all words that are due by then."""
    _, shares = phases(curriculum, weights)
    total = sum(wanted) or 1.0
    ends = [0.0]
    for k in range(len(curriculum)):
        ends.append(ends[-1] + sum(w * s[k] for w, s in zip(wanted, shares)) / total)

    def inverse(share, turn):
        out = None
        for i, own in enumerate(shares):
            expr = None
            for k in reversed(range(len(own))):  # the latest phase that has begun
                if own[k] <= 0:
                    continue
                begin, width = sum(own[:k]), ends[k + 1] - ends[k]
                at = F.least(F.lit(ends[k]) + (share - F.lit(begin)) * F.lit(width / own[k]), F.lit(min(ends[k + 1], 1.0)))
                begun = share >= F.lit(begin)
                expr = F.when(begun, at) if expr is None else expr.when(begun, at)
            out = expr if out is None else F.when(turn == i, expr).otherwise(out)
        return out

    return inverse


def training_order(docs: DataFrame, plan: DataFrame, row_col: str, text_col: str = "text") -> DataFrame:
    """Rows of docs in the order of training, a row a copy: position first, then the columns of docs; the text of a cut
    copy ends after last_words words. plan: what mix() gave of docs, with row_col, a column that tells rows apart; so null
    ids and ids that repeat are copied as often as their own rows say. A plan without copies gives no rows."""
    spark = docs.sparkSession
    marks = plan.where(F.size("positions") > 0).select(F.col(row_col).alias("_at"), F.col("last_words").alias("_last"), F.col("size").alias("_size"), F.posexplode("positions").alias("_copy", "_position"), F.size("positions").alias("_copies"))
    rows = docs.withColumnRenamed(row_col, "_at").join(marks, "_at")
    cut = (F.col("_copy") == F.col("_copies") - 1) & (F.col("_last") < F.col("_size"))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_last").cast("int"))
    kept = [F.col("_at").alias(row_col) if c == row_col else F.when(cut, F.array_join(words, " ")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return rows.select(F.col("_position").alias("position"), *kept).repartitionByRange(partitions(spark), "position", row_col).sortWithinPartitions("position", row_col)
