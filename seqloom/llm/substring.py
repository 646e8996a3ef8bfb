"""Removal of repeated passages: documents meet at winnowed anchors, and matches are extended word by word both ways."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, WORD, WordHashes, apart, materialize, mix64, numbered, ragged, texts_of, tune

#: Words of a window that counts as a repeat, and of a gram that can be an anchor.
WINDOW, GRAM = 50, 10
_SPAN = WINDOW - GRAM + 1  # grams of a window


def _grams(flat: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of ``size`` words from each place on; garbage where the text has fewer left."""
    # Polynomial over the words' 64-bit hashes, modulo 2^64, from running sums: sum h[i] * B^i, shifted back by B^-i.
    odd = ((0x9E3779B97F4A7C15 + 2 * salt * 0x632BE59BD9B4E019) | 1) % 2**64
    base, inverse = np.uint64(odd), np.uint64(pow(odd, -1, 2**64))
    length = len(flat)
    powers = np.empty(length + 1, np.uint64)
    powers[0] = 1
    powers[1:] = base
    np.multiply.accumulate(powers, out=powers)
    back = np.full(length + 1, inverse, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(length + 1, np.uint64)
    np.cumsum(mix64(flat + np.uint64(salt)) * powers[:length], out=sums[1:])
    end = np.minimum(np.arange(length) + size, length)
    return mix64((sums[end] - sums[:length]) * back[:length])


def _chosen(grams: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, anchor of each window): the place of the least gram of each window, the first of equal ones.

    The minimum over SPAN places comes from minima over powers of two; a window never reaches past its text."""
    windows = np.maximum(n - WINDOW + 1, 0)
    owner, wstarts = ragged(windows)
    at = np.arange(wstarts[-1]) - wstarts[owner] + starts[owner]
    if not len(at):
        return at, at
    length = len(grams)
    best = np.arange(length)
    step = 1
    while 2 * step <= _SPAN:
        other = best[np.minimum(np.arange(length) + step, length - 1)]
        best = np.where(grams[other] < grams[best], other, best)
        step *= 2
    a, b = best[at], best[at + _SPAN - step]
    return at, np.where((grams[b] < grams[a]) | ((grams[b] == grams[a]) & (b < a)), b, a)


class _Batch:
    """Words of a batch of texts, their hashes and places."""

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        self.words = [t.split() for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.flat = hashes([w for ws in self.words for w in ws])
        self.owner, self.starts = ragged(self.n)
        self.grams = _grams(self.flat, GRAM, 1)
        self.windows, self.anchors = _chosen(self.grams, self.starts[:-1], self.n)


def _list_array(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


SEEDS = "row long, id long, n long, kept_sha256 string, anchors array<long>"


def seeds(docs: DataFrame) -> DataFrame:
    """docs (row, id, text): number of words, the SHA-256 of all words joined by one space, distinct anchors."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            it = _Batch(texts_of(b.column(2)), hashes)
            own = np.unique(it.anchors)
            doc = it.owner[own] if len(own) else own
            pairs = np.unique(np.stack([doc, it.grams[own].view(np.int64)]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in it.words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(it.n), pa.array(sha, pa.string()), _list_array(pairs[1], np.bincount(pairs[0], minlength=len(it.n)), pa.int64())], [x.split()[0] for x in SEEDS.split(", ")])

    return docs.mapInArrow(run, SEEDS)


#: A place of an anchor: windows that start lo to hi words before pos have it as their anchor; left are the hi words before
#: pos, right those from pos to the end of the last window; lead says whether no smaller id has the seed (key).
PLACES = "row long, id long, pos int, key long, lo int, hi int, left binary, right binary, lead boolean"


def places(docs: DataFrame) -> DataFrame:
    """docs (row, id, text, shared: the text's anchors that other documents have, and whether the document leads them) to
    the places of these anchors."""

    def run(batches):
        hashes = WordHashes()
        names = [x.split()[0] for x in PLACES.split(", ")]
        for batch in batches:
            it = _Batch(texts_of(batch.column(2)), hashes)
            if not len(it.windows):
                continue
            # A window's anchor never lies before that of an earlier window, so each place has one run of windows.
            at, first, count = np.unique(it.anchors, return_index=True, return_counts=True)
            hi = at - it.windows[first]
            lo = hi - count + 1
            doc, grams = it.owner[at].tolist(), it.grams[at].view(np.int64).tolist()
            shared = [{x["anchor"]: x["lead"] for x in xs or []} for xs in batch.column(3).to_pylist()]
            rows, ids, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), it.starts.tolist()
            out: list[tuple] = []
            for p, a, z, d, g in zip(at.tolist(), lo.tolist(), hi.tolist(), doc, grams):
                lead = shared[d].get(g)
                if lead is None:
                    continue
                words, p = it.words[d], p - starts[d]
                out.append((rows[d], ids[d], p, g, a, z, b" ".join(words[p - z : p]), b" ".join(words[p : p + WINDOW - a]), lead))
                if len(out) >= 20_000:
                    yield _batch_of(out, PLACES_ARROW, names)
                    out = []
            if out:
                yield _batch_of(out, PLACES_ARROW, names)

    return docs.mapInArrow(run, PLACES)


PLACES_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]


def _batch_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extended(met: DataFrame) -> DataFrame:
    """Places that met the leader of their seed (lead_row, lead_id, lead_pos, lead_left, lead_right), extended word by word
    both ways: rows of two kinds.

    With key null, words start to stop of the row are covered by windows that the leader, of a smaller id, has too. The
    others are places again: what is left of their windows reaches past the match. Windows that begin before it go on under
    a seed that is one word longer to the left than the match, those that end after it under one longer to the right. Two
    places with an equal window leave a leader without it at the same word, so they meet again."""

    def run(batches):
        names = [x.split()[0] for x in EXTENDED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        for batch in batches:
            out = []
            for row, id_, pos, key, lo, hi, left, right, lead_row, lead_id, lead_pos, lead_left, lead_right in zip(*(c.to_pylist() for c in batch.columns)):
                if row == lead_row and pos == lead_pos:
                    continue
                before, after = left.split(), right.split()
                l, r = _common(before[::-1], lead_left.split()[::-1]), _common(after, lead_right.split())
                a, z = max(lo, WINDOW - r), min(hi, l)
                if a <= z and lead_id < id_:
                    out.append((row, id_, None, None, None, None, None, None, pos - z, pos - a + WINDOW))
                if hi > l:
                    low = max(lo, l + 1)
                    seed = xxhash.xxh3_64_intdigest(b"<%d " % key + b" ".join(before[len(before) - l - 1 :]))
                    out.append((row, id_, pos, seed - 2**63, low, hi, left, b" ".join(after[: WINDOW - low]), None, None))
                top = min(hi, l, WINDOW - 1 - r)
                if top >= lo:
                    seed = xxhash.xxh3_64_intdigest(b">%d " % key + b" ".join(after[: r + 1]))
                    out.append((row, id_, pos, seed - 2**63, lo, top, b" ".join(before[len(before) - top :]), right, None, None))
            yield _batch_of(out, kinds, names)

    return met.mapInArrow(run, EXTENDED)


EXTENDED = "row long, id long, pos int, key long, lo int, hi int, left binary, right binary, start int, stop int"


def matches(live: DataFrame) -> DataFrame:
    """(row, start, stop): words that windows cover which a document with a smaller id has as well. live: places.

    Each round, all places of a seed are compared with one of its leader's, the smallest id; what a match leaves goes on
    under longer seeds, those of one document alone being dropped by a count. So a round is linear in the places, whatever
    a seed's documents, and no two of them are paired but with the leader. Seeds grow by a word a round at least, so the
    rounds end; words are compared, and a seed's hash only says who meets."""
    found = None
    names = ["row", "id", "pos", "key", "lo", "hi", "left", "right"]
    while True:
        leaders = materialize(live.where("lead").select("key", *[F.col(c).alias(f"lead_{c}") for c in ("row", "id", "pos", "left", "right")]).dropDuplicates(["key"]), "leaders")
        # Leaders grow with the input, so they aren't broadcast; a seed that many places have can be split in a merge.
        step = materialize(extended(live.select(*names).hint("merge").join(leaders, "key").select(*names, *[f"lead_{c}" for c in ("row", "id", "pos", "left", "right")])), "extended")
        now = step.where("key is null").select("row", "start", "stop")
        found = now if found is None else found.unionByName(now)
        rest = step.where("key is not null").select(*names)
        again = rest.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key", "least")
        live = materialize(rest.join(apart(again), "key").select(*names, (F.col("id") == F.col("least")).alias("lead")), "places")
        if live.isEmpty():
            return found


CUT = "row long, id long, n long, n_removed long, kept_sha256 string, lo array<int>, hi array<int>"


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """rows (row, id, text, covered: spans of words) to the maximal repeats and what is left."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n", "removed", "sha", "lo", "hi", "kept")}
            for text, spans in zip(texts_of(batch.column(2)), batch.column(3).to_pylist()):
                words = text.split()
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, [x["start"] for x in spans], 1)
                np.add.at(depth, [x["stop"] for x in spans], -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out["n"].append(len(words))
                out["removed"].append(int(gone.sum()))
                out["sha"].append(hashlib.sha256(left).hexdigest())
                out["lo"].append(edge[::2].astype(np.int32))
                out["hi"].append(edge[1::2].astype(np.int32))
                if with_text:
                    out["kept"].append(left.decode("utf-8"))
            arrays = [batch.column(0), batch.column(1), pa.array(out["n"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["lo"], pa.list_(pa.int32())), pa.array(out["hi"], pa.list_(pa.int32()))]
            names = [x.split()[0] for x in CUT.split(", ")]
            if with_text:
                arrays.append(pa.array(out["kept"], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, CUT + ", kept_text string" * with_text)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, lo, hi) for each row: what is left without words that a window of 50 words
    covers whose words also start somewhere in a document with a smaller id. lo and hi bound the maximal repeats, in words.

    Seeds: each window's anchor is its least hash of ten words, so equal windows have equal anchors; anchors of one
    document alone are dropped by a count. Documents are joined at the anchors they share, and matches are extended word
    by word (:func:`matches`); their union are the maximal repeats. A document whose words are all those of one with a
    smaller id, by a SHA-256 of them, is a repeat as a whole if it has a window.

    Null and blank texts have no words. Rows that repeat an id don't make repeats of each other, and each is cut by what it
    shares with smaller ids. A null id is after all others. Each row of docs gives one row; an empty table gives none.
    with_text adds kept_text."""
    tune(docs.sparkSession)
    rows = numbered(docs).select(F.col(ROW).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(seeds(rows), "seeds")
    first = made.where(F.col("n") >= WINDOW).groupBy("kept_sha256").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("kept_sha256", "first")
    # Which rows are copies is worked out on narrow rows; the anchors stay in their table.
    copies = materialize(made.select("row", "id", "kept_sha256").join(apart(first), "kept_sha256").where(F.col("first") < F.col("id")).select("row"), "copies")
    each = made.select("row", "id", "anchors").join(copies, "row", "left_anti").select("row", "id", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("anchor", "lo")
    asked = each.join(apart(shared), "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", (F.col("id") == F.col("lo")).alias("lead"))).alias("shared"))
    # The rows asked for grow with the input, so they aren't broadcast to the texts.
    met = materialize(places(rows.hint("merge").join(asked, "row").select("row", "id", "text", "shared")), "places")
    later = materialize(matches(met).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("covered")), "repeats")
    empty = F.array().cast("array<int>")
    cut = _cut(rows.hint("merge").join(later, "row").select("row", "id", "text", "covered"), with_text)
    plain = made.select("row", "id", "n", "kept_sha256").join(later.select("row"), "row", "left_anti").join(copies.withColumn("copy", F.lit(True)), "row", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    none = hashlib.sha256(b"").hexdigest()
    plain = plain.select("row", "id", "n", F.when(F.col("copy"), F.col("n")).otherwise(0).alias("n_removed"), F.when(F.col("copy"), F.lit(none)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(F.col("copy"), F.array(F.lit(0))).otherwise(empty).alias("lo"), F.when(F.col("copy"), F.array(F.col("n").cast("int"))).otherwise(empty).alias("hi"))
    if with_text:
        words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), " ")
        plain = plain.join(rows.select("row", words.alias("kept_text")), "row").withColumn("kept_text", F.when(F.col("n_removed") > 0, "").otherwise(F.col("kept_text")))
    out = cut.unionByName(plain)
    back = F.when(F.col("id") != F.lit(2**63 - 1), F.col("id"))
    return out.select(back.alias(id_col), F.col("n").alias("n_words"), "n_removed", "kept_sha256", "lo", "hi", *(["kept_text"] if with_text else []))
