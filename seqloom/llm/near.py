"""Near-duplicate components: SetSketch registers, banded; candidates estimated by likelihood, then verified on full sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, WordHashes, apart, materialize, mix64, numbered, partitions, ragged, texts_of, tune

#: Words of a shingle; sets are linked at 100 * intersection >= NUM * union.
SHINGLE, NUM = 5, 75
#: A sketch has BANDS * ROWS registers. At a similarity of 0.75, all bands miss with odds of 5e-6.
BANDS, ROWS = 32, 4
#: Base and rate of the registers: a register is floor(1 - log_b(x)) of the least of exponential variables x of this rate.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Candidates whose likeliest similarity is below this are dropped: six standard errors below 0.75 for 128 registers.
FLOOR = 0.52
#: Members of a bucket in one block when members of different components are compared.
BLOCK = 512
#: Pairs with one partner that one task verifies, about.
CHUNK = 256
M = BANDS * ROWS


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:M] | np.uint64(1), seeds[M:]


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): for each text the sorted distinct 64-bit hashes of its shingles of lower-cased (A-Z) words.

    A text of fewer words has its whole sequence as one shingle; a text without words has none."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = hashes([w for ws in words for w in ws])
    owner, starts = ragged(n)
    place = np.arange(len(flat)) - starts[owner]
    left = n[owner] - place
    made = mix64(flat + np.uint64(0x1234567))
    size = np.ones(len(flat), np.uint64)
    for k in range(1, SHINGLE):  # words past the end of a text leave the hash as it is
        ok = left > k
        nxt = np.concatenate([flat[k:], np.zeros(min(k, len(flat)), np.uint64)])[: len(flat)]
        made = np.where(ok, mix64(made * np.uint64(0x9E3779B97F4A7C15) + nxt), made)
        size += ok.astype(np.uint64)
    made = mix64(made ^ size)  # a short sequence is not a shingle that begins alike
    keep = (place == 0) | (left >= SHINGLE)
    owner, made = owner[keep], made[keep]
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    first = np.ones(len(made), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (made[1:] != made[:-1])
    owner, made = owner[first], made[first]
    return made, np.searchsorted(owner, np.arange(len(texts) + 1))


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(n, M) uint16 registers of non-empty sets. The least uniform variable of a register gives the least exponential one,
    so sketches merge by the maximum of their registers."""
    a, b = _multipliers()
    base = mix64(sets)
    out = np.empty((len(bounds) - 1, M), np.uint16)
    starts = bounds[:-1]
    for i in range(M):
        u = base * a[i] + b[i]
        u ^= u >> np.uint64(32)
        least = np.minimum.reduceat((u * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11), starts)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / float(1 << 53)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def _joint(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray):
    """(log-likelihood as a function of the similarity, its upper end) of pairs of sketches, jointly from the registers that
    are larger, smaller and equal; sizes are exact.

    With u and v the sets' shares of the sum of their sizes, a register of the left set is larger with odds p(u - v*J),
    where p(x) = -log_b(1 - x (b - 1) / b); J is at most min(u/v, v/u)."""
    more = (left > right).sum(axis=1).astype(np.float64)
    less = (left < right).sum(axis=1).astype(np.float64)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))

    return value, np.minimum(u / v, v / u)


def likelihood(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The likeliest similarity of pairs of sketches: the maximum, by a search by golden section."""
    value, hi = _joint(left, right, n_left, n_right)
    lo = np.zeros(len(hi))
    g = (5**0.5 - 1) / 2
    for _ in range(24):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left_better = value(c) > value(d)
        lo, hi = np.where(left_better, lo, c), np.where(left_better, d, hi)
    return (lo + hi) / 2


def likely(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Whether the likeliest similarity is at least floor: the likelihood has one maximum, so it still rises there. Sizes
    must allow the floor."""
    value, _ = _joint(left, right, n_left, n_right)
    return value(floor + 1e-4) >= value(floor - 1e-4)


SKETCH = "id long, doc long, n long, set_a long, set_b long, sketch binary, bands array<long>"


def sketches(docs: DataFrame, row_col: str, text_col: str, id_col: str) -> DataFrame:
    """(id, doc, n, set_a, set_b, sketch, bands): the row, its document's id, the size of its set, a 128-bit digest of the
    set, its registers, a hash of each band."""
    tune(docs.sparkSession)

    def run(batches):
        hashes = WordHashes()
        mark = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in batches:
            texts = texts_of(b.column(2))
            sets, bounds = shingle_sets(texts, hashes)
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            digest = np.zeros((2, len(texts)), np.uint64)
            sketch, bands = [None] * len(texts), [None] * len(texts)
            if len(full):
                at = bounds[:-1][full]
                digest[0, full] = np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A5)), at)
                digest[1, full] = np.add.reduceat(mix64(sets * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)), at)
                regs = registers(sets, np.concatenate([at, bounds[-1:]]))
                key = np.tile(mark, (len(full), 1))
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, r::ROWS].astype(np.uint64))
                key = key.view(np.int64)
                for i, k in enumerate(full.tolist()):
                    sketch[k], bands[k] = regs[i].tobytes(), key[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "doc", "n", "set_a", "set_b", "sketch", "bands"])

    rows = docs.select(F.col(row_col).alias("id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SKETCH)


def estimated(pairs: DataFrame, reps: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Pairs (a, b) that may be similar: sizes in proportion, and likeliest similarity of the registers at least floor."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where((F.col("na") * 100 >= F.col("nb") * NUM) & (F.col("nb") * 100 >= F.col("na") * NUM))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, M) for c in ("sa", "sb"))
                ok = likely(a, b, pdf["na"].to_numpy(np.float64), pdf["nb"].to_numpy(np.float64), floor)
                yield pdf.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= 75 * union.

    Pairs go to tasks by their partner b, in as many parts as it has pairs for; b's text goes along with each part, and
    the rows of a part stream through, so a task holds one set of b at a time. The rows asked for grow with the input, so
    they aren't broadcast to the texts."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    parts = many.select("b", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("parts"))
    members = pairs.join(apart(parts), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    heads = parts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    wanted = members.select(F.col("a").alias("id"), "b", "part", F.lit(1).alias("kind")).unionByName(heads)
    rows = texts.hint("merge").join(wanted, "id").select("b", "part", "kind", F.col("id").alias("a"), "text")
    both = rows.repartition(partitions(spark), "b", "part").sortWithinPartitions("b", "part", "kind", "a")

    def run(batches):
        hashes, group, held = WordHashes(), None, None
        for batch in batches:
            b, part, kind, a = (batch.column(i).to_numpy() for i in range(4))
            sets, bounds = shingle_sets(texts_of(batch.column(4)), hashes)
            out_a, out_b = [], []
            for i in range(len(b)):
                own = sets[bounds[i] : bounds[i + 1]]
                if kind[i] == 0:
                    group, held = (b[i], part[i]), own
                    continue
                if group != (b[i], part[i]):
                    raise ValueError("a pair without its partner")
                at = np.minimum(np.searchsorted(held, own), max(len(held) - 1, 0))
                common = int((held[at] == own).sum()) if len(held) else 0
                if common and 100 * common >= NUM * (len(own) + len(held) - common):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge reaches.

    Each round, every node points to the least of itself and its neighbours; pointers are followed to their roots by
    doubling; edges are drawn anew between roots. Of the nodes with edges at most half are roots, so the rounds grow
    with the logarithm of the largest component, and each works on what the last one left. All of it stays in tables."""
    live = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    layers = []
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "pointers")
        while True:
            jump = to.select(F.col("a").alias("to"), F.col("to").alias("next"))
            to = materialize(to.join(jump, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            if not to.where("moved").limit(1).count():
                break
            to = to.drop("moved")
        to = to.drop("moved")
        layers.append(to)
        x, y = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = live.join(x, "a").join(y, "b").where("x <> y")
        live = materialize(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if not layers:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    # A node's root of the first round, then that root's of the second, and so on.
    found = layers[0].select(F.col("a").alias("id"), F.col("to").alias("component"))
    for to in layers[1:]:
        step = to.select(F.col("a").alias("component"), "to")
        found = found.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return materialize(found, "components")


def full_sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, shingles): the full sets of the documents of these ids, as bytes of sorted 64-bit hashes."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets, bounds = shingle_sets(texts_of(b.column(1)), hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array([sets[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], ["id", "n", "shingles"])

    # The ids grow with the input, so they aren't broadcast.
    return texts.hint("merge").join(ids, "id").mapInArrow(run, "id long, n long, shingles binary")


POSSIBLE = "band long, i int, j int, own int, id long, component long"
#: Pairs whose registers are held side by side.
PAIRS = 16_384


def possible(rows: DataFrame) -> DataFrame:
    """rows (no, band, i, j, own, id, component, n, sketch), each group of the first four together and in order, to the
    members (POSSIBLE) that the registers allow a link with another one of a different component, a row each.

    Pairs are of the two blocks or, where i = j, within one. A pair that shares a lower band is that band's work. Groups
    stream through: a task holds one batch and one group beside it."""

    def flagged(t: pa.Table) -> pa.RecordBatch:
        no, band, i, j, own, ids, comp, n = (t.column(k).to_numpy() for k in range(8))
        regs = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint16).reshape(-1, M)
        edge = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        may = np.zeros(len(ids), bool)
        held: list[tuple] = []
        waiting = 0

        def judge():
            x, y = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for at in range(0, len(x), PAIRS):
                a, b = x[at : at + PAIRS], y[at : at + PAIRS]
                lower = np.arange(BANDS)[None, :] < no[a][:, None]
                fresh = ~((regs[a] == regs[b]).reshape(len(a), BANDS, ROWS).all(axis=2) & lower).any(axis=1)
                a, b = a[fresh], b[fresh]
                ok = likely(regs[a], regs[b], n[a].astype(np.float64), n[b].astype(np.float64))
                may[a[ok]] = may[b[ok]] = True

        for s, e in zip(edge[:-1], edge[1:]):
            if i[s] == j[s]:
                x, y = np.triu_indices(e - s, 1)
                x, y = x + s, y + s
            else:
                first, second = s + np.flatnonzero(own[s:e] == i[s]), s + np.flatnonzero(own[s:e] == j[s])
                x, y = np.repeat(first, len(second)), np.tile(second, len(first))
            ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y]))
            held.append((x[ok], y[ok]))
            waiting += int(ok.sum())
            if waiting >= PAIRS:
                judge()
                waiting = 0
        if held:
            judge()
        return pa.RecordBatch.from_arrays([pa.array(c[may]) for c in (band, i, j, own, ids, comp)], [x.split()[0] for x in POSSIBLE.split(", ")])

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            keys = [t.column(k).to_numpy() for k in range(1, 4)]
            last = len(t) - 1
            other = np.flatnonzero(np.logical_or.reduce([k != k[last] for k in keys]))
            begin = int(other[-1]) + 1 if len(other) else 0
            left = t.slice(begin).combine_chunks()
            if begin:
                yield flagged(t.slice(0, begin))
        if left is not None and len(left):
            yield flagged(left)

    return rows.mapInArrow(run, POSSIBLE)


def _pairs(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """Members that member k of a group of two blocks is to be compared with: of other components, and of the other block
    or, within one block, after k."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    own, comp, n = (pdf[c].to_numpy() for c in ("own", "component", "n"))
    other = (comp != comp[k]) & ((own == j) if i != j else (np.arange(len(own)) > k))
    return np.flatnonzero(other & (100 * np.minimum(n, n[k]) >= NUM * np.maximum(n, n[k])))


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Verified links between different components in one group of members: one for each pair of components it joins."""
    pdf = pdf.reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    n, ids, comp, own = (pdf[c].to_numpy().copy() for c in ("n", "id", "component", "own"))
    member = np.repeat(np.arange(len(sets)), n)
    # Members by shingle: the intersections of one member with all others are the counts in its shingles' lists.
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    holders = member[order]
    lists = np.searchsorted(term[order], np.arange(term.max() + 2))
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for k in np.flatnonzero(own == int(pdf["i"].iloc[0])):
        other = _pairs(pdf, k)
        other = other[comp[other] != comp[k]]  # what has been joined since needs no more links
        if not len(other):
            continue
        terms = term[at[k] : at[k + 1]]
        first, size = lists[terms], lists[terms + 1] - lists[terms]
        _, starts = ragged(size)
        found = holders[np.arange(starts[-1]) - np.repeat(starts[:-1] - first, size)]
        common = np.bincount(found, minlength=len(sets))[other]
        for x in other[100 * common >= NUM * (n[other] + n[k] - common)]:
            if comp[x] != comp[k]:
                out.append((ids[x], ids[k]))
                comp[comp == comp[x]] = comp[k]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def across(buckets: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between members of a bucket that lie in different components: the exact way for what the
    comparison with one leader leaves.

    buckets: (band, no, id), the hash of a band's registers and its number; reps: (id, n, sketch). Those outside a bucket's
    largest component are compared with each other and with the largest. A bucket goes out in blocks of members; each pair
    of blocks is one group of at most 2 * block rows, so a large bucket is many tasks' work. First the registers alone go
    out, and a pair is judged by its likelihood, in the lowest band that it shares; full sets are fetched for those members
    only that may have a link, and compared exactly. No task passes on pairs: the first step gives members, the second links."""
    rows = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("band", "no", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("band", "no").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("size")).where("size > 2 and most < size")
    blocks = lambda c: F.ceil(c / F.lit(block)).cast("int")
    mixed = mixed.select("band", "no", "major", blocks(F.col("size") - F.col("most")).alias("minors"), blocks(F.col("most")).alias("majors"))
    rows = materialize(rows.join(mixed, ["band", "no"]), "mixed")
    minor = F.col("component") != F.col("major")
    own = F.when(minor, F.pmod(F.xxhash64("id"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("id"), F.col("majors"))).cast("int")
    last = F.when(minor, F.col("minors") + F.col("majors") - 1).otherwise(F.col("minors") - 1).cast("int")
    rows = rows.join(reps.select("id", "n", "sketch"), "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    group = ["band", "i", "j"]
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # Dealt out by number: comparing costs far more than the rows' bytes say, so tasks aren't merged by these.
    rows = rows.select("no", *group, "own", "id", "component", "n", "sketch").repartition(partitions(docs.sparkSession), "no", *group)
    may = materialize(possible(rows.sortWithinPartitions("no", *group)), "possible")
    sets = full_sets(may.select("id").distinct(), docs, id_col, text_col)
    return may.join(sets, "id").select(*group, "own", "id", "component", "n", "shingles").groupBy(*group).applyInPandas(_links, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept, and row_col if given) for each row: the connected components of links of
    similarity 0.75 or more. row_col: a long column that tells rows apart; without it, rows are numbered.

    Texts with equal sets are one class, found by a digest of 128 bits and confirmed on the full sets; each class stands in
    the rest of the work by its least row. Classes that share a band's registers are candidates. First, each is compared
    with the bucket's least row, if the registers allow a link, on the full sets of shingles; then, where a bucket still
    has several components, all members of different ones are compared, by registers and then on full sets (:func:`across`).

    A null or blank text has no set and is its own component, as is a document without links. Rows are documents of their
    own, whether their id is null or repeats: a component's id is the smallest of its rows, null if all are null, and kept
    says whether that is the row's own. An empty table gives no rows."""
    rows = docs if row_col else numbered(docs)
    row = row_col or ROW
    made = materialize(sketches(rows, row, text_col, id_col), "sketches")
    full = made.where("n > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    twins = full.select("id", "set_a", "set_b").join(apart(classes), ["set_a", "set_b"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    twins = materialize(twins, "twins")
    while True:
        reps = materialize(full.join(twins.select(F.col("a").alias("id")), "id", "left_anti").select("id", "n", "sketch", "bands"), "representatives")
        each = reps.select("id", F.posexplode("bands").alias("no", "band"))
        groups = each.groupBy("band", "no").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
        buckets = materialize(each.join(apart(groups), ["band", "no"]).select("band", "no", "id", "lead"), "buckets")
        stars = buckets.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
        first = materialize(verified(materialize(estimated(stars, reps).unionByName(twins), "pairs"), rows, row, text_col), "links")
        same = materialize(twins.join(first, ["a", "b"], "left_semi"), "same")
        if same.count() == twins.count():
            break
        twins = same  # sets of one digest that differ: they stand for themselves
    found = components(first.join(twins.select("a"), "a", "left_anti"))
    rest = materialize(across(buckets.select("band", "no", "id"), found, reps, rows, row, text_col), "links")
    whole = components(first.unionByName(rest))
    linked = made.select("id", "doc", "n").join(whole, "id", "left")
    smallest = linked.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("c"))
    out = linked.join(apart(smallest.drop("c")), "component", "left")
    component = F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"), *([F.col("id").alias(row_col), F.coalesce("component", "id").alias("_group")] if row_col else []))
