"""Canonical exact digests of documents; DataFrame operations only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, bucket_of, materialize, numbers

#: Documents of one bucket of neighbouring ids, about, or the root of their number if that is more; a bucket is sorted by one
#: task, and there are as many bounds as buckets.
BUCKET_ROWS = 2_000
LEAST = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding and NFKC again, by ICU's static methods in Spark's own JVM; white space of any kind
    becomes one space, and none is left at the ends."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"(?U)\s+", " "))


def wide(text: Column, bits: int = 128) -> tuple[Column, Column]:
    """Two 64-bit xxhashes of different seeds. Fewer bits make collisions likely, for tests."""
    a, b = F.xxhash64(text), F.xxhash64(F.lit(0x5EED), text)
    if bits >= 128:
        return a, b
    return F.pmod(a, F.lit(1 << bits)), F.lit(0).cast("long")


def as_text(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _part(bucket: Column, key: Column, place: Column, bounds: list[int], parts: list[int]) -> Column:
    """0, or for keys that are the bound of so many buckets a number from 1 on, rising with the hash place."""
    if not parts:
        return F.lit(0)
    many = F.when(F.get(numbers(bounds), bucket - 1) == key, F.get(numbers(parts), bucket - 1)).otherwise(1)
    share = F.floor((place / F.lit(2.0**64) + 0.5) * many)
    return F.when(many > 1, F.least(share, many - 1) + 1).otherwise(0).cast("int")


def with_next(rows: DataFrame, place: list[str], carried: list[str]) -> DataFrame:
    """rows (key, *place, *carried) with next_key and next_<c> for all others: the row that follows in falling order of keys,
    those of one key in the order of place; after the last row, the first.

    Rows go to buckets of neighbouring keys, each ordered by itself; a key that fills several (null ids do) has as many of
    its own, by ranges of the first column of place, which must be a hash. The first row of the bucket that follows is
    copied into each bucket as its end. So the texts are shuffled once, and a task sorts one bucket."""
    names = ["key", *place, *carried]
    narrow = rows.select("key", *place)
    n = narrow.count()
    if not n:
        return rows.withColumns({f"next_{c}": F.col(c) for c in names})
    many = -(-n // max(BUCKET_ROWS, int(n**0.5)))
    shares = [i / many for i in range(1, many)]
    cuts = narrow.agg(F.percentile_approx("key", shares, max(10_000, 4 * many)).alias("q")).first().q if shares else []
    times = Counter(cuts)
    bounds = sorted(times)
    bucket = bucket_of(F.col("key"), bounds).cast("int").alias("bucket")
    part = _part(bucket, F.col("key"), F.col(place[0]), bounds, [times[x] for x in bounds] if len(bounds) < len(cuts) else []).alias("part")
    # A row a bucket, at most the root of the number of rows: its first row by key and place.
    at = narrow.select(bucket, part, F.struct(F.bitwise_not("key").alias("k"), *place).alias("at"))
    heads = materialize(at.groupBy("bucket", "part").agg(F.min("at").alias("at")), "heads")
    # Each bucket's end is the head of the one that follows; the last one's is the first head.
    falling = W.orderBy(F.desc("bucket"), "part")
    before = lambda c: F.coalesce(F.lag(c).over(falling), F.last(c).over(falling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ends = heads.select(before("bucket").alias("bucket"), before("part").alias("part"), F.bitwise_not("at.k").alias("key"), *[F.col(f"at.{c}").alias(c) for c in place])
    copies = rows.join(F.broadcast(ends), ["key", *place]).select(*names, "bucket", "part", F.lit(1).alias("end")).dropDuplicates(["bucket", "part"])  # one of rows alike
    order = W.partitionBy("bucket", "part").orderBy("end", F.desc("key"), *place)
    both = rows.select(*names, bucket, part, F.lit(0).alias("end")).unionByName(copies)
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).where("end = 0").drop("bucket", "part", "end")


def edited(text: Column, following: Column) -> Column:
    """text with its last half of the code points (rounded down) replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id, group_size).

    A fingerprint is 32 hex digits of the canonical text. Texts of one hash are compared byte by byte; should they
    differ, the fingerprint ends in - and the text's number among those of its hash, so fingerprints are equal exactly
    where canonical texts are. Likeness of such digests is 1 or 0. group_id is the smallest id with the fingerprint.

    Null texts are empty. A null id follows all others and has a null group only if alone. Rows that repeat an id follow
    one another in the order of two hashes of their texts; id and hashes are what tells rows apart, so rows that differ in
    neither are alike in all results. A lone row follows itself. Each row of docs gives one row; an empty table gives none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("key"), text.alias("text"))
    rows = rows.withColumns({"p": F.xxhash64("text"), "q": F.xxhash64(F.lit(0x10CA), F.col("text"))})

    def hashed(df: DataFrame, source: str, *names: str) -> DataFrame:
        a, b = wide(F.col("_canonical"), bits)
        return df.withColumn("_canonical", canonical(F.col(source))).withColumns(dict(zip(names, (a, b)))).drop("_canonical")

    here, there = ["key", "p", "q"], ["next_key", "next_p", "next_q"]
    near = with_next(hashed(rows, "text", "a", "b"), ["p", "q"], ["text", "a", "b"])
    near = near.withColumn("n_chars", F.length("text").cast("long")).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    near = near.withColumn("edited_sha256", F.sha2(F.col("edit").cast("binary"), 256)).drop("text", "next_text")
    made = materialize(hashed(near, "edit", "ea", "eb").select(*here, *there, "n_chars", "edited_sha256", "a", "b", "ea", "eb", F.col("next_a").alias("na"), F.col("next_b").alias("nb")), "fingerprints")

    # A text stands for all rows with its id and hashes; an edited text for all rows with those of both its parts.
    none = [F.lit(None).cast("long").alias(c) for c in there]
    each = made.select(*here, *none, F.lit(0).alias("kind"), "a", "b").unionByName(made.select(*here, *there, F.lit(1).alias("kind"), F.col("ea").alias("a"), F.col("eb").alias("b")))
    shared = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    need = materialize(each.join(apart(shared), ["a", "b"]).distinct(), "buckets")
    # Texts that share a hash, by one pass over the texts: a document's own, or the two that its edited text is made of.
    of = F.struct(*here, *there).alias("of")
    part = lambda kind, i, names: need.where(F.col("kind") == kind).select(of, *[F.col(c).alias(k) for c, k in zip(names, here)], F.lit(i).alias("part"), "a", "b")
    wanted = part(0, 0, here).unionByName(part(1, 1, here)).unionByName(part(1, 2, there)).distinct()
    # What is asked for grows with the texts, so it isn't broadcast.
    fetched = rows.hint("merge").join(wanted, here)
    plain = fetched.where("part = 0").select("of", F.lit(0).alias("kind"), "a", "b", canonical(F.col("text")).alias("bytes"))
    halves = fetched.where("part > 0").groupBy("of", "a", "b").agg(F.max(F.when(F.col("part") == 1, F.col("text"))).alias("text"), F.max(F.when(F.col("part") == 2, F.col("text"))).alias("following"))
    joined = halves.select("of", F.lit(1).alias("kind"), "a", "b", edited(F.col("text"), F.col("following")).alias("text"))
    joined = joined.select("of", "kind", "a", "b", canonical(F.col("text")).alias("bytes"))
    compared = plain if need.where("kind = 1").isEmpty() else plain.unionByName(joined)
    collided = materialize(compared.groupBy("a", "b").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo <> hi").select("a", "b"), "collided")

    print_, edit_, next_ = as_text(F.col("a"), F.col("b")), as_text(F.col("ea"), F.col("eb")), as_text(F.col("na"), F.col("nb"))
    if not collided.isEmpty():
        number = F.dense_rank().over(W.partitionBy("a", "b").orderBy("bytes"))
        numbers = materialize(compared.join(collided, ["a", "b"]).withColumn("number", number).select("of.*", "kind", "number").distinct(), "numbers")
        for kind, by, name in ((0, dict(zip(here, here)), "number"), (1, dict(zip(here + there, here + there)), "edit_number"), (0, dict(zip(here, there)), "next_number")):
            made = made.join(numbers.where(F.col("kind") == kind).select(*[F.col(c).alias(k) for c, k in by.items()], F.col("number").alias(name)), list(by.values()), "left")
        suffix = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("-"), F.col(c).cast("string"))).otherwise("")
        print_, edit_, next_ = F.concat(print_, suffix("number")), F.concat(edit_, suffix("edit_number")), F.concat(next_, suffix("next_number"))
    made = made.select("key", "n_chars", "edited_sha256", print_.alias("fingerprint"), edit_.alias("edited_fingerprint"), next_.alias("next_fingerprint"))
    groups = made.groupBy("fingerprint").agg(F.min(F.when(F.col("key") != F.lit(LEAST), F.col("key"))).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    like = lambda c: F.when(F.col("fingerprint") == F.col(c), 1.0).otherwise(0.0)
    return made.join(apart(groups), "fingerprint").select(F.when(F.col("key") != F.lit(LEAST), F.col("key")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"), "group_id", "group_size")
