"""Windows, k-mer counts, enrichment and exact scans over sequences.

Sequences are (seq_id, grp, seq): grp is the unit that results are about, a chromosome or a source."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S

TILE = 4096


def tiles(seqs: DataFrame, overlap: int, tile: int = TILE, carried: list[str] | None = None) -> DataFrame:
    """(carried, length, start, tile): pieces of ``tile`` letters with ``overlap`` more of what follows.

    The pieces come from one pass of a pattern over the sequence, so a chromosome costs time in proportion."""
    keep = carried or ["seq_id", "grp"]
    cut = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{tile + overlap}}}))(?:.{{1,{tile}}})"), F.lit(1))
    return seqs.select(*keep, F.length("seq").alias("length"), F.posexplode(cut).alias("_t", "tile")).withColumn("start", F.col("_t") * tile).drop("_t")


def windows(seqs: DataFrame, k: int, carried: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """(carried, length, pos, kmer): every window of k letters, with its start from 0."""
    keep = carried or ["seq_id", "grp"]
    found = F.regexp_extract_all("tile", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    cut = tiles(seqs.where(F.length("seq") >= k), k - 1, tile, keep)
    return cut.select(*keep, "length", "start", F.posexplode(found).alias("_o", "kmer")).select(*keep, "length", (F.col("start") + F.col("_o")).alias("pos"), "kmer")


def known(df: DataFrame, kmer: str = "kmer") -> DataFrame:
    return df.where(~F.contains(F.col(kmer), F.lit("N")))


def canonical_windows(seqs: DataFrame, k: int) -> DataFrame:
    w = known(windows(seqs.withColumn("seq", F.upper("seq")), k))
    return w.withColumn("kmer", S.canonical_kmer(F.col("kmer")))


def _with(df: DataFrame, keys: list[str], made: str) -> T.StructType:
    """The schema of columns of df and of what a task makes beside them."""
    own = [T.StructField(c, df.schema[c].dataType) for c in keys]
    return T.StructType(own + T.StructType.fromDDL(made).fields)


#: Letters that are packed at a time, and the longest word that a long holds at two bits a letter.
PIECE, PACKED = 1 << 17, 31
#: A, C, G, T, N, anything else.
_CODES = np.full(256, 5, np.int64)
_CODES[list(b"ACGTN")] = range(5)
_CODE_BYTES = _CODES.astype(np.uint8).tobytes()


def packed_windows(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of k letters from each place of codes 0 to 3, and their reverse complements, at two bits a letter. Words of
    twice the letters are made of two, so there are about log k passes."""
    if k == 1:
        return c, 3 - c
    h = k // 2
    f, r = packed_windows(c, h)
    f, r = (f[:-h] << 2 * h) | f[h:], r[:-h] | (r[h:] << 2 * h)
    if k % 2:
        last = c[2 * h :]
        f, r = (f[: len(last)] << 2) | last, r[: len(last)] | ((3 - last) << 4 * h)
    return f, r


def forward_windows(c: np.ndarray, k: int) -> np.ndarray:
    """The first of the two that :func:`packed_windows` makes."""
    if k == 1:
        return c
    h = k // 2
    f = forward_windows(c, h)
    f = (f[:-h] << 2 * h) | f[h:]
    return (f[: len(f) - 1] << 2) | c[2 * h :] if k % 2 else f


def turned(words: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed words of k letters."""
    left, out = words.astype(np.int64), np.zeros(len(words), np.int64)
    for _ in range(k):
        out = (out << 2) | (3 - (left & 3))
        left >>= 2
    return out


#: Letters up to which words are counted in an array of all words, and not by sorting; words that are sorted at a time.
DENSE, SORTED = 8, 1 << 21


#: Letters of a batch that are Python's own text at a time, and numbers that a task's counts may hold, a word being sixteen.
LETTERS, HELD = 1 << 22, 1 << 23


def portions(batch, column: int):
    """The batch in runs of rows whose texts have LETTERS bytes together at most, or in single rows."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _codes_of(whole: str, k: int, odd: dict[str, int]):
    """The windows without N as numbers, a piece of the text at a time: as they read if k is at most DENSE, else canonical.
    Those where a letter is no base are counted in ``odd``."""
    for at in range(0, len(whole) - k + 1, PIECE):
        text = whole[at : at + PIECE + k - 1]
        c = np.frombuffer(text.encode("ascii", "replace").translate(_CODE_BYTES), np.uint8)
        bad, plain, known = np.flatnonzero(c > 3), np.minimum(c, 3), np.ones(len(c) + k - 1, bool)
        for i in range(k):  # windows from k - 1 letters before the text on
            known[bad + i] = False
        known = known[k - 1 : len(c)]
        if (c[bad] == 5).any():
            n = np.concatenate([[0], np.cumsum(c == 4)])
            for i in np.flatnonzero(~known & (n[k:] == n[:-k])).tolist():
                word = min(text[i : i + k], opposite(text[i : i + k]))
                odd[word] = odd.get(word, 0) + 1
        if k <= DENSE:  # words fit 16 bits
            yield forward_windows(plain.astype(np.uint16), k)[known]
        else:  # up to 15 letters fit 32 bits
            yield np.minimum(*packed_windows(plain.astype(np.int32 if k < 16 else np.int64), k))[known]


class _Tally:
    """Counts of the windows of texts that come one after the other. They wait as numbers, and are added up in an array of all
    words once they are as many, or, where words are too many for one, are passed on when SORTED of them wait. Words of an
    array are counted as they read; those of the other strand join theirs when all are passed on."""

    def __init__(self, k: int):
        self.k, self.every, self.waiting, self.n, self.odd = k, None, [], 0, {}

    def held(self) -> int:
        return self.n + 16 * len(self.odd) + (0 if self.every is None else len(self.every))

    def add(self, seqs: list[str]):
        """Joined by N, which no window crosses, so many short ones are a piece."""
        for codes in _codes_of("N".join(seqs), self.k, self.odd):
            self.waiting.append(codes)
            self.n += len(codes)
            if self.k <= DENSE and self.n >= 4**self.k:
                every = np.bincount(np.concatenate(self.waiting), minlength=4**self.k)
                self.every = every if self.every is None else self.every + every
                self.waiting, self.n = [], 0
            elif self.k > DENSE and self.n >= SORTED:
                yield from self._sorted()

    def _sorted(self):
        words = np.concatenate(self.waiting)
        values, counts = np.unique(np.minimum(words, turned(words, self.k)) if self.k <= DENSE else words, return_counts=True)
        self.waiting, self.n = [], 0
        yield values, [""] * len(values), counts

    def rest(self):
        if self.every is not None:
            every = self.every + (np.bincount(np.concatenate(self.waiting), minlength=len(self.every)) if self.waiting else 0)
            words = np.arange(len(every))
            other = turned(words, self.k)
            every = np.where(words < other, every + every[other], np.where(words == other, every, 0))
            values = np.flatnonzero(every)
            yield values, [""] * len(values), every[values]
        elif self.waiting:
            yield from self._sorted()
        if self.odd:
            yield np.full(len(self.odd), -1), [*self.odd], np.array([*self.odd.values()])


def _counted(seqs: list[str], k: int):
    """(codes, words, counts) of the canonical windows without N, so many at a time: packed, or as text where a letter is no
    base."""
    tally = _Tally(k)
    yield from tally.add(seqs)
    yield from tally.rest()


def packed_counts(seqs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(keys, code, word, n): canonical k-mers without N of upper-case sequences (keys, seq), as numbers of two bits a letter;
    a window with a letter other than a base is a word, with code -1.

    A task keeps a tally a key over all its sequences, and passes all on when they hold HELD numbers, so a k-mer leaves a
    task about once a key however many sequences the task has; the shuffle's rows are numbers."""
    if not 1 <= k <= PACKED:
        raise ValueError(f"k is not between 1 and {PACKED}")
    whole = seqs.where("seq is not null").select(*keys, "seq")
    made = _with(whole, keys, "code long, word string, n long")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made[: len(keys)]]
        tallies: dict[tuple, _Tally] = {}

        def rows(key, counted):
            for codes, words, counts in counted:
                texts = pa.array(words, pa.string()) if any(words) else pa.repeat("", len(words))
                yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(v, t), len(codes)) for v, t in zip(key, kinds)), pa.array(codes, pa.int64()), texts, pa.array(counts, pa.int64())], [*keys, "code", "word", "n"])

        held = 0
        for batch in batches:
            for part in portions(batch, len(keys)):
                texts, of = part.column(len(keys)).to_pylist(), {}
                for i, key in enumerate(zip(*(part.column(c).to_pylist() for c in range(len(keys)))) if keys else [()] * len(texts)):
                    of.setdefault(key, []).append(texts[i])
                for key, own in of.items():
                    tally = tallies.setdefault(key, _Tally(k))
                    held -= tally.held()
                    yield from rows(key, tally.add(own))
                    held += tally.held()
                    if held + len(tallies) >= HELD:
                        for done, t in tallies.items():
                            yield from rows(done, t.rest())
                        tallies, held = {}, 0
        for done, t in tallies.items():
            yield from rows(done, t.rest())

    return whole.mapInArrow(run, made).groupBy(*keys, "code", "word").agg(F.sum("n").alias("n"))


def unpacked(k: int):
    """The letters of (code, word)."""
    return F.when(F.col("code") < 0, F.col("word")).otherwise(F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0"), "0123", "ACGT"))


def count_kmers(seqs: DataFrame, k: int = 12) -> DataFrame:
    """(kmer, cnt): canonical k-mers without N."""
    if k > PACKED:
        return canonical_windows(seqs, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))
    return packed_counts(seqs.select(F.upper("seq").alias("seq")), k, []).select(unpacked(k).alias("kmer"), F.col("n").alias("cnt"))


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's checkpoint folder if it has one; else as it is."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df


def places(seqs: DataFrame, words: list[str], carried: list[str]) -> DataFrame:
    """(carried, pos, kmer): the windows without N of upper-case sequences (carried, seq) that are, on either strand, one of
    the canonical words: of bases alone, of one length of at most 31. Windows are compared as numbers; only hits leave a task."""
    k = len(words[0])
    meant = sorted((int(w.translate(str.maketrans("ACGT", "0123")), 4), w) for w in words)

    def run(batches):
        import pyarrow as pa

        wanted, names = np.array([x for x, _ in meant], np.int64), pa.array([w for _, w in meant], pa.string())

        def rows(batch, at, texts):
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            c = _CODES[np.frombuffer("N".join(texts).encode("ascii", "replace"), np.uint8)]
            if len(c) < k:
                return
            bad = np.concatenate([[0], np.cumsum(c > 3)])
            f, r = packed_windows(np.minimum(c, 3), k)
            codes = np.minimum(f, r)
            hits = np.flatnonzero(np.isin(codes, wanted) & (bad[k:] == bad[:-k]))
            if len(hits):
                text = np.searchsorted(begins, hits, "right") - 1
                where = pa.array(np.array(at, np.int64)[text])
                found = names.take(pa.array(np.searchsorted(wanted, codes[hits])))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(where) for i in range(len(carried))), pa.array(hits - begins[text], pa.int64()), found], [*carried, "pos", "kmer"])

        for batch in (part for whole in batches for part in portions(whole, len(carried))):
            at, texts, size = [], [], 0
            for i, seq in enumerate(batch.column(len(carried)).to_pylist()):
                at.append(i)
                texts.append(seq)
                size += len(seq)
                if size >= PIECE:
                    yield from rows(batch, at, texts)
                    at, texts, size = [], [], 0
            if at:
                yield from rows(batch, at, texts)

    whole = seqs.where("seq is not null").select(*carried, "seq")
    return whole.mapInArrow(run, _with(whole, carried, "pos long, kmer string"))


def end_pieces(seqs: DataFrame, k: int, terminal: int) -> DataFrame:
    """(seq_id, grp, end, seq): both ends of the sequences that are long enough for them, in upper case. What lies between is
    cut off before any window is made."""
    n = F.length("seq")
    end = F.explode(F.array(F.struct(F.lit("left").alias("end"), F.substring("seq", F.lit(1), F.lit(terminal)).alias("seq")), F.struct(F.lit("right").alias("end"), F.right("seq", F.lit(terminal)).alias("seq"))))
    return seqs.where(n >= 2 * terminal).select("seq_id", "grp", end.alias("_p")).select("seq_id", "grp", "_p.end", F.upper("_p.seq").alias("seq"))


def terminal_enrichment(seqs: DataFrame, k: int = 12, terminal: int = 2_000_000, min_count: int = 10, min_length: int = 1_000_000, anchor: str = "TTGG") -> DataFrame:
    """(grp, end, kmer, terminal_count, fold_enrichment, anchored): share of a k-mer at an end over its share in all of
    the sequences of at least min_length, ends included. Shares are of all k-mers, not only of those that are frequent.

    The background and the ends are counted in one pass over the sequences, a row an end and k-mer, which is settled
    before shares are taken; the ends are cut out before their windows are made. Totals are sums of the counts. K-mers are
    numbers until the last step; k is at most 31."""
    long_ = seqs.where(F.length("seq") >= min_length)
    n = F.length("seq")
    # The whole, and both ends of sequences that are long enough for them.
    part = lambda end, seq: F.struct(F.lit(end).alias("end"), seq.alias("seq"))
    whole, left, right = part("", F.col("seq")), part("left", F.substring("seq", F.lit(1), F.lit(terminal))), part("right", F.right("seq", F.lit(terminal)))
    parts = F.explode(F.when(n >= 2 * terminal, F.array(whole, left, right)).otherwise(F.array(whole)))
    pieces = long_.select("grp", parts.alias("_p")).select(F.when(F.col("_p.end") != "", F.col("grp")).alias("grp"), "_p.end", F.upper("_p.seq").alias("seq"))
    counts = settled(packed_counts(pieces, k, ["grp", "end"]))
    bg = counts.where("end = ''").select("code", "word", F.col("n").alias("bg"))
    total = bg.agg(F.sum("bg").alias("bg_total"))
    ends = counts.where("end <> ''").withColumnRenamed("n", "cnt")
    totals = ends.groupBy(F.col("grp").alias("_grp"), F.col("end").alias("_end")).agg(F.sum("cnt").alias("end_total"))  # two rows a group
    j = ends.where(F.col("cnt") >= min_count).join(bg, ["code", "word"]).join(totals, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("end") == F.col("_end"))).crossJoin(F.broadcast(total))
    fold = (F.col("cnt") / F.col("end_total")) / (F.col("bg") / F.col("bg_total"))
    j = j.select("grp", "end", unpacked(k).alias("kmer"), F.col("cnt").alias("terminal_count"), fold.alias("fold_enrichment"))
    return j.withColumn("anchored", S.starts_either_strand(F.col("kmer"), anchor))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def _by_group(pieces: DataFrame, k: int) -> DataFrame:
    return packed_counts(pieces, k, ["grp"]).select("grp", unpacked(k).alias("kmer"), "n")


def end_counts(seqs: DataFrame, k: int, terminal: int) -> DataFrame:
    """(grp, kmer, n): canonical counts over both ends together."""
    return _by_group(end_pieces(seqs, k, terminal), k)


def interior_counts(seqs: DataFrame, k: int, interior: int) -> DataFrame:
    """(grp, kmer, n): canonical counts in the middle ``interior`` letters of each sequence, cut out before windows are made."""
    lo = F.greatest(F.floor(F.length("seq") / 2) - interior // 2, F.lit(0))
    hi = F.floor(F.length("seq") / 2) + interior // 2
    return _by_group(seqs.select("grp", F.upper(F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int"))).alias("seq")), k)


def enriched_vs_interior(ends: DataFrame, middle: DataFrame, top: int = 60, min_count: int = 10) -> DataFrame:
    """(grp, kmer, n, enrichment, rank): share at the ends over the share inside, the latter's count raised by one; the
    most enriched of each group that are frequent and not of low complexity. Totals are a row a group."""
    ends, middle = settled(ends), settled(middle)
    tt, it = ends.groupBy("grp").agg(F.sum("n").alias("t_total")), middle.groupBy("grp").agg(F.sum("n").alias("i_total"))
    inner = middle.withColumnRenamed("n", "inside")
    # One condition on the count, so that it stays above the aggregate, whose shuffle then serves the totals as well.
    frequent = ends.where(F.when(F.col("n") >= min_count, ~S.low_complexity(F.col("kmer"))).otherwise(F.lit(False)))
    j = frequent.join(tt, "grp").join(inner, ["grp", "kmer"], "left").join(it, "grp", "left")
    enrichment = (F.col("n") / F.col("t_total")) / ((F.coalesce("inside", F.lit(0)) + 1) / F.greatest(F.coalesce("i_total", F.lit(1)), F.lit(1)))
    j = j.select("grp", "kmer", "n", enrichment.alias("enrichment"))
    return top_per_group(j, ["grp"], [F.desc("enrichment"), F.desc("kmer")], top)


def specificity(ends: DataFrame) -> DataFrame:
    """(grp, kmer, n, specificity): share of a k-mer's counts that one group has."""
    return ends.withColumn("specificity", F.col("n") / F.sum("n").over(W.partitionBy("kmer")))


def anchored_windows(seqs: DataFrame, length: int = 16, anchor: str = "TTGG") -> DataFrame:
    """(seq_id, grp, pos, strand, window): windows that start with the anchor on either strand, free of N.

    A forward window is reported at its start; a reverse one at its last letters, where the reverse anchor stands. The
    anchor's place is never the last possible window start; a place that reads both ways counts as forward. Sequences are
    searched for the anchor and only its windows leave the search."""
    n, back = len(anchor), opposite(anchor)
    both = re.compile(f"(?=({re.escape(anchor)}|{re.escape(back)}))")

    def found(seq: str):
        for m in both.finditer(seq):
            p = m.start()
            if p >= len(seq) - length:
                return
            if m.group(1) == anchor:
                window = seq[p : p + length]
                strand = "+"
            elif p + n >= length:
                window, strand = opposite(seq[p + n - length : p + n]), "-"
            else:
                continue
            if "N" not in window:
                yield p, strand, window

    def run(batches):
        import pyarrow as pa

        def rows(batch, at, hits):
            places, strands, windows_ = zip(*hits)
            where = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(places, pa.int64()), pa.array(strands, pa.string()), pa.array(windows_, pa.string())], ["seq_id", "grp", "pos", "strand", "window"])

        for batch in (part for whole in batches for part in portions(whole, 2)):
            at, hits = [], []
            for i, seq in enumerate(batch.column(2).to_pylist()):
                for hit in found(seq):
                    at.append(i)
                    hits.append(hit)
                    if len(at) >= HITS:
                        yield rows(batch, at, hits)
                        at, hits = [], []
            if at:
                yield rows(batch, at, hits)

    whole = seqs.where(F.length("seq") >= length).select("seq_id", "grp", "seq")
    return whole.mapInArrow(run, _with(whole, ["seq_id", "grp"], "pos long, strand string, window string"))


#: Patterns that a scan takes: they go to every task. Hits that a task gathers before it passes them on.
PATTERNS, HITS = 10_000, 50_000


def opposite(motif: str) -> str:
    """Reverse complement in upper case; anything but A, C, G and T becomes N."""
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(motif.upper()))


def _meant(patterns: DataFrame) -> dict[str, list[tuple]]:
    """(name, motif, strand) of each word that patterns (name, motif) look for; an error beyond PATTERNS patterns."""
    found = patterns.where("length(motif) > 0").select("name", "motif").limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    words: dict[str, list[tuple]] = {}
    for name, motif in found:
        words.setdefault(motif.upper(), []).append((name, motif, "+"))
        words.setdefault(opposite(motif), []).append((name, motif, "-"))
    return words


def _automaton(words: dict[str, list[tuple]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, meant in words.items():
        automaton.add_word(word, (len(word), meant))
    automaton.make_automaton()
    return automaton


def scan(seqs: DataFrame, patterns: DataFrame, min_length: int = 1_000_000) -> DataFrame:
    """(seq_id, grp, name, motif, position, strand): exact hits of patterns (name, motif), overlapping ones too; a
    palindrome is reported on both strands. Positions are starts on the forward strand.

    One automaton with failure links holds both strands of all patterns, whatever their lengths; it reads each sequence
    once and only hits leave it. Null sequences and empty motifs have no hits; repeated patterns are reported each."""
    words = _meant(patterns)

    def run(batches):
        import pyarrow as pa

        automaton = _automaton(words)

        def rows(batch, at, hits):
            names, motifs, places, strands = zip(*hits)
            where = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(names, pa.string()), pa.array(motifs, pa.string()), pa.array(places, pa.int64()), pa.array(strands, pa.string())], ["seq_id", "grp", "name", "motif", "position", "strand"])

        for batch in (part for whole in batches if words for part in portions(whole, 2)):
            at, hits = [], []
            for i, seq in enumerate(batch.column(2).to_pylist()):
                for last, (size, meant) in automaton.iter(seq):
                    for name, motif, strand in meant:
                        at.append(i)
                        hits.append((name, motif, last - size + 1, strand))
                    if len(at) >= HITS:
                        yield rows(batch, at, hits)
                        at, hits = [], []
            if at:
                yield rows(batch, at, hits)

    up = seqs.where((F.length("seq") >= min_length) & F.col("seq").isNotNull()).select("seq_id", "grp", F.upper("seq").alias("seq"))
    return up.mapInArrow(run, _with(up, ["seq_id", "grp"], "name string, motif string, position long, strand string"))


def hit_numbers(seqs: DataFrame, patterns: DataFrame, min_length: int = 1_000_000) -> DataFrame:
    """(seq_id, grp, letters, hits): of each sequence of min_length at least its length and how many hits :func:`scan` has
    in it. Hits are counted where they are found, and a sequence is read once for both."""
    words = _meant(patterns)

    def run(batches):
        import pyarrow as pa

        automaton = _automaton(words)
        for batch in (part for whole in batches for part in portions(whole, 3)):
            hits = [sum(len(meant) for _, (_, meant) in automaton.iter(seq)) if words else 0 for seq in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hits, pa.int64())], ["seq_id", "grp", "letters", "hits"])

    n = F.length("seq")
    up = seqs.where((n >= min_length) & F.col("seq").isNotNull()).select("seq_id", "grp", n.cast("long").alias("letters"), F.upper("seq").alias("seq"))
    return up.mapInArrow(run, _with(up, ["seq_id", "grp", "letters"], "hits long"))


def near_windows(w: DataFrame, core: str, most: int, column: str = "window") -> DataFrame:
    """Windows within ``most`` mismatches of a fixed core."""
    return w.where(S.hamming_to(F.substring(column, 1, len(core)), core) <= most)


def similar_pairs(windows_: DataFrame, cores: DataFrame, most: int, length: int) -> DataFrame:
    """Windows (window, ...) joined with cores (core, ...) at most ``most`` mismatches away, over the first ``length`` letters.

    Split in most + 1 parts, two such words agree in one at least: an equi-join of the distinct words on the parts, not a
    cross join; the other columns come back by the words."""
    if length <= most:
        raise ValueError("words of so few letters differ anyhow")
    edges = [length * i // (most + 1) for i in range(most + 2)]
    cuts = [(a, b - a) for a, b in zip(edges, edges[1:])]
    part = lambda c, i, n: F.substring(c, i + 1, n)
    seeds = lambda c: F.posexplode(F.array(*[part(c, i, n) for i, n in cuts])).alias("_part", "_seed")
    words = windows_.select("window").distinct()
    right = cores.select("core").distinct()
    far = S.hamming(F.substring("window", 1, length), F.substring("core", 1, length))
    # A pair counts at the first part in which it agrees, so no row is doubled and none needs a number.
    first = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        first = F.when(part("window", *cuts[k]) == part("core", *cuts[k]), k).otherwise(first)
    near = words.select("window", seeds(F.col("window"))).join(right.select("core", seeds(F.col("core"))), ["_part", "_seed"])
    near = near.where(first == F.col("_part")).withColumn("mismatches", far).where(F.col("mismatches") <= most).select("window", "core", "mismatches")
    return windows_.join(near, "window").join(cores, "core")


def kmer_sets(seqs: DataFrame, k: int = 5) -> DataFrame:
    """(id, kmer): distinct k-mers of each sequence in upper case."""
    return windows(seqs.select(F.col("seq_id"), F.lit(0).alias("grp"), F.upper("seq").alias("seq")), k).select(F.col("seq_id").alias("id"), "kmer").distinct()


def set_sizes(seqs: DataFrame, k: int = 5) -> DataFrame:
    """(id, n): how many distinct k-mers each id has, N and other letters counting as letters; ids without any are left out.

    A record's are counted where it is and only the number leaves the task; k-mers are shuffled for ids of several records
    alone, null among them."""
    table = 5**k if k <= 6 else 0

    def size(seq: str) -> int:
        if len(seq) < k:
            return 0
        c = _CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
        if not table or c.max() > 4:
            return len({seq[p : p + k] for p in range(len(seq) - k + 1)})
        code = np.zeros(len(c) - k + 1, np.int64)
        for i in range(k):
            code = code * 5 + c[i : i + len(code)]
        seen = np.zeros(table, bool)
        seen[code] = True
        return int(np.count_nonzero(seen))

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in portions(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([size(s) for s in batch.column(1).to_pylist()], pa.int64())], ["seq_id", "n"])

    whole = seqs.where(F.length("seq") >= k).select("seq_id", F.upper("seq").alias("seq"))
    each = settled(whole.mapInArrow(run, _with(whole, ["seq_id"], "n long")).groupBy("seq_id").agg(F.count(F.lit(1)).alias("records"), F.max("n").alias("n")))
    one = each.where("records = 1").select(F.col("seq_id").alias("id"), "n")
    several = each.where("records > 1").select(F.col("seq_id").alias("_id"))
    if several.isEmpty():
        return one
    again = whole.join(several, F.col("seq_id").eqNullSafe(F.col("_id")), "left_semi")
    return one.unionByName(kmer_sets(again, k).groupBy("id").agg(F.count(F.lit(1)).alias("n")))


#: Letters of the queries up to which their k-mers go to every task.
INDEX_LETTERS = 1 << 20


def shared_kmers(queries: DataFrame, targets: DataFrame, k: int = 5, top: int = 30) -> DataFrame:
    """(qid, tid, shared, rank): the targets that share most distinct k-mers with each query; ties to the larger id. Records
    of one id are one query or target, with the k-mers of all. Queries of few letters go to every task as an index, where
    targets are a record an id; else k-mers are joined. Both ways give the same."""
    small = (queries.agg(F.sum(F.length("seq")).alias("n")).first().n or 0) <= INDEX_LETTERS
    if small and targets.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        counts = _shared_by_index(queries, targets, k, top)
    else:
        q, t = (kmer_sets(x.where("seq_id is not null"), k).withColumnRenamed("id", name) for x, name in ((queries, "qid"), (targets, "tid")))
        counts = q.join(t, "kmer").groupBy("qid", "tid").agg(F.count(F.lit(1)).alias("shared"))
    return top_per_group(counts, ["qid"], [F.desc("shared"), F.desc("tid")], top)


def _shared_by_index(queries: DataFrame, targets: DataFrame, k: int, top: int) -> DataFrame:
    """(qid, tid, shared): of each batch of targets the ``top`` of each query, so of all targets too. Ids are distinct."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rows = queries.where("seq is not null and seq_id is not null").select("seq_id", F.upper("seq").alias("seq")).collect()  # INDEX_LETTERS at most
    number: dict = {}
    index: dict[str, set] = {}
    for r in rows:
        i = number.setdefault(r.seq_id, len(number))
        for p in range(len(r.seq) - k + 1):
            index.setdefault(r.seq[p : p + k], set()).add(i)
    shared = queries.sparkSession.sparkContext.broadcast((list(number), {w: np.array(sorted(x), np.int64) for w, x in index.items()}))
    kind = to_arrow_type(queries.schema["seq_id"].dataType)
    schema = T.StructType([T.StructField("qid", queries.schema["seq_id"].dataType), T.StructField("tid", targets.schema["seq_id"].dataType), T.StructField("shared", T.LongType())])

    def run(batches):
        names, of = shared.value
        for b in batches:
            tids = b.column(0).to_pylist()
            counts = np.zeros((len(tids), len(names)), np.int64)
            for i, s in enumerate(b.column(1).to_pylist()):
                found = [of[w] for w in {s[p : p + k] for p in range(len(s) - k + 1)} if w in of]
                if found:
                    counts[i] = np.bincount(np.concatenate(found), minlength=len(names))
            place = np.empty(len(tids), np.int64)
            place[sorted(range(len(tids)), key=tids.__getitem__)] = np.arange(len(tids))
            out = []
            for j, name in enumerate(names):
                at = np.flatnonzero(counts[:, j])
                best = at[np.lexsort((-place[at], -counts[at, j]))[:top]]
                out += [(name, tids[i], int(counts[i, j])) for i in best]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], b.column(0).type), pa.array([x[2] for x in out], pa.int64())], ["qid", "tid", "shared"])

    return targets.where("seq is not null and seq_id is not null").select("seq_id", F.upper("seq").alias("seq")).mapInArrow(run, schema)


def top_seed(seqs: DataFrame, k: int = 12, terminal: int = 3_000_000, anchor: str = "TTGG") -> DataFrame:
    """(grp, seed, n): the most frequent anchored k-mer of both ends that has a framework spacer and is not of low
    complexity; ties to the one seen first."""
    n = len(anchor)
    w = anchored_windows(seqs, k, anchor).join(seqs.select("seq_id", F.length("seq").alias("length")), "seq_id")
    w = w.where((F.col("pos") < terminal) | (F.col("pos") >= F.col("length") - terminal))
    w = w.where(S.framework_spacer(F.col("window"), anchor_len=n).isNotNull() & ~S.low_complexity(F.col("window")))
    c = w.groupBy("grp", "window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq_id", "pos")).alias("first"))
    return top_per_group(c, ["grp"], [F.desc("n"), "first", "window"], 1).select("grp", F.col("window").alias("seed"), "n")
