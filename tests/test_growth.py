"""What keeps queries in proportion to their input: passes, rows and writes, with the results of the plain way."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import discovery, kmers
from seqloom.plans import catalog as C
from seqloom.plans import runs
from seqloom.plans import tables as D
from seqloom.sources import rest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bases_are_made_once_and_as_by_the_expression(spark):
    assert "regexp_replace" not in plan(D.dna(spark, SF).where("length(seq) > 3 and seq is not null"))
    texts = ["Ab z-Z9", None, "", "é Straße ſ K", "x y😀z".encode("utf-16", "surrogatepass").decode("utf-16"), "the quick brown fox JUMPS"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string").withColumn("grp", F.lit(None).cast("string"))
    got = dict(D.as_bases(df).select("seq_id", "seq").collect())
    assert got == dict(df.select("seq_id", D.bases(F.col("text"))).collect())


def test_enrichment_reads_the_sequences_once(spark):
    assert "FileScan" not in plan(C.terminal_enrichment_full(spark, SF))
    assert "FileScan" not in plan(C.enriched_vs_interior(spark, SF))
    assert "FileScan" not in plan(C.floor_baseline(spark, SF)) and "FileScan" not in plan(C.best_match(spark, SF))
    assert "FileScan" not in plan(C.motif_gaps(spark, SF))


def test_counts_leave_a_task_in_bounded_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGTNR", [9, 9, 9, 9, 1, 1], k=n)) for n in (0, 3, 50, 700, 11, 12, 13)]
    monkeypatch.setattr(kmers, "PIECE", 64)
    monkeypatch.setattr(kmers, "SORTED", 100)
    for k in (1, 8, 9, 12):
        want, got, most = Counter(), Counter(), 0
        for t in texts:
            for w in (t[i : i + k] for i in range(len(t) - k + 1)):
                if "N" not in w:
                    want[min(w, kmers.opposite(w))] += 1
        for codes, words, counts in kmers._counted(texts, k):
            most = max(most, int(counts.sum()))
            for code, word, n in zip(codes.tolist(), words, counts.tolist()):
                got[word or "".join("ACGT"[int(d)] for d in np.base_repr(code, 4).zfill(k))] += n
        assert got == want and (k <= kmers.DENSE or most <= 164)


def test_set_sizes_are_those_of_all_windows(spark):
    rng = random.Random(4)
    rows = [(i % 9 if i % 7 else None, "".join(rng.choices("ACGTNacgtRé", k=rng.randint(0, 60)))) for i in range(24)] + [(100 + i, "ACGTACGTNN" * i) for i in range(5)] + [(50, None)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    for k in (2, 5, 8):
        want = dict(kmers.kmer_sets(df, k).groupBy("id").count().collect())
        assert dict(kmers.set_sizes(df, k).collect()) == want and want


def test_end_hits_by_number_are_those_by_text(spark, monkeypatch):
    rng = random.Random(5)
    seqs = spark.createDataFrame([(i, "ab"[i % 2], "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=rng.randint(30, 90)))) for i in range(60)], "seq_id long, grp string, seq string")
    words = ["ACGT", "AAAC", "CAAA", "AATT", "CCGG", "TTTT"]
    cand = spark.createDataFrame([(g, w) for g in "ab" for w in words if g == "a" or w < "B"], "grp string, kmer string")
    got = sorted(discovery.end_hits(seqs, cand, 4, 20).collect())
    monkeypatch.setattr(kmers, "PATTERNS", 0)
    assert got == sorted(discovery.end_hits(seqs, cand, 4, 20).collect()) and len(got) > 20


def test_many_keys_are_not_many_writes(spark, tmp_path):
    wanted = spark.range(300).select(F.col("id").alias("key"), F.col("id").alias("ord"))
    seen = []

    def work(df):
        seen.append(df)
        return df.select("key", F.lit(None).cast("string").alias("error"))

    assert rest.resume(wanted, str(tmp_path / "kept"), "key", work, 2).count() == 300 and len(seen) <= rest.WRITES + 1


def test_neighbours_of_every_hundredth_vector_and_headers_parsed_once(spark):
    queries = C.embeddings(spark, SF).where("vec_id % 100 = 0").count()
    assert queries and C.nn_cosine(spark, SF).count() == 5 * queries
    assert "Generate explode" in plan(C.header_parse(spark, SF))


def test_mismatches_of_the_first_letters(spark):
    rows = [("ACGTA", "ACCTTG"), ("AC", "AGGT"), ("", "A"), ("ACGT", "ACGT")]
    df = spark.createDataFrame(rows, "a string, b string")
    both = df.select(S.hamming_first(F.col("a"), F.col("b"), 4).alias("x"), S.hamming(F.substring("a", 1, 4), F.substring("b", 1, 4)).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both] == [1, 1, 0, 0]


def test_pooled_means_just_below_zero_keep_their_sign(spark, tmp_path):
    rows = [(1, [-1e-7] * 64), (2, [1e-7] * 64), (3, [-0.0000015] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (repr(r.pooled[0]), repr(r.whole[3])) for r in C.region_pooling(spark, str(tmp_path)).collect()}
    assert got[1] == ("-0.0", "-0.0") and got[2] == ("0.0", "0.0")


def task_of(monkeypatch, make):
    """The function that a query's last Arrow step runs in a task."""
    from pyspark.sql.classic.dataframe import DataFrame

    taken, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *rest, **more: taken.append(run) or real(self, run, *rest, **more))
    make()
    monkeypatch.setattr(DataFrame, "mapInArrow", real)
    return taken[-1]


def test_a_kmer_leaves_a_task_once_a_key(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), "".join(rng.choices("ACGTNR", [9, 9, 9, 9, 1, 1], k=rng.choice([0, 2, 60, 300])))) for _ in range(200)]
    df = spark.createDataFrame(rows, "grp string, seq string")
    for k, held in ((4, 1 << 23), (9, 1 << 23), (4, 300), (9, 300)):
        want = Counter()
        for grp, t in rows:
            for w in (t[i : i + k] for i in range(len(t) - k + 1)):
                if "N" not in w:
                    want[grp, min(w, kmers.opposite(w))] += 1
        run = task_of(monkeypatch, lambda: kmers.packed_counts(df, k, ["grp"]))
        monkeypatch.setattr(kmers, "HELD", held, raising=False)
        out = [b for b in run(iter([pa.RecordBatch.from_pylist([{"grp": g, "seq": t} for g, t in rows[i : i + 10]], pa.schema([("grp", pa.string()), ("seq", pa.string())])) for i in range(0, 200, 10)]))]
        got = Counter()
        for r in (r for b in out for r in b.to_pylist()):
            got[r["grp"], r["word"] or "".join("ACGT"[int(d)] for d in np.base_repr(r["code"], 4).zfill(k))] += r["n"]
        assert got == want and (held == 300 or sum(b.num_rows for b in out) == len(want))


def test_texts_become_pythons_own_a_portion_at_a_time(spark, monkeypatch):
    few = spark.createDataFrame([(1, "a", "TTGGACGTACGTACGTACGTA")], "seq_id long, grp string, seq string")
    bases = task_of(monkeypatch, lambda: D.as_bases(few.withColumnRenamed("seq", "text")))
    search = task_of(monkeypatch, lambda: kmers.anchored_windows(few, 12))
    seqs = ["ACGTTTGGACGTACGTACGTAC" + "A" * (1 << 18)] * 128 + [None, ""]
    whole = pa.RecordBatch.from_pydict({"seq_id": range(130), "grp": ["a"] * 130, "seq": seqs}, pa.schema([("seq_id", pa.int64()), ("grp", pa.string()), ("seq", pa.string())]))
    made = []
    for b in bases(iter([whole])):
        assert b.column(2).get_total_buffer_size() <= (1 << 22) + (1 << 16)
        made += b.column(0).to_pylist()
    assert made == list(range(130))
    whole = whole.slice(0, 128)
    tracemalloc.start()
    found = [(s, p, w) for b in search(iter([whole])) for s, p, w in zip(*(b.column(c).to_pylist() for c in ("seq_id", "pos", "window")))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(i, 4, "TTGGACGTACGT") for i in range(128)] and most < 1 << 24  # of 32 MB of text


def test_portions_are_the_whole(monkeypatch):
    monkeypatch.setattr(kmers, "LETTERS", 10)
    for texts in ([], [None], ["a" * 30], ["", "abc", "x" * 7, "y", None, "z" * 10, "é" * 6, "b"]):
        batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
        parts = [p.column(0).to_pylist() for p in kmers.portions(batch, 0)]
        assert [t for p in parts for t in p] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in parts)


@pytest.mark.parametrize("name", ["seeds_per_group", "top_candidates", "exploration_run", "terminal_enrichment", "terminal_enrichment_full"])
def test_queries_of_enriched_ends_count_over_a_whole_task(spark, monkeypatch, name):
    run = task_of(monkeypatch, lambda: getattr(C, name)(spark, SF))
    schema = pa.schema([("grp", pa.string()), ("end", pa.string()), ("seq", pa.string())])
    batch = pa.RecordBatch.from_pylist([{"grp": g, "end": e, "seq": "ACGTTGGACTNACGTTGGACT"} for g, e in ((None, ""), ("a", "left"), ("a", "right"))], schema)
    rows = [tuple(r.values()) for b in run(iter([batch] * 5)) for r in b.to_pylist()]
    assert len({r[:4] for r in rows}) == len(rows) == 9 and {r[4] for r in rows} == {10}


def test_sizes_and_hits_are_one_reading(spark):
    assert plan(C.exploration_run(spark, SF)).count("FileScan") == 1  # besides that of the counts, which are settled
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), "".join(rng.choices("ACGTNé", [9, 9, 9, 9, 1, 1], k=n))) for i, n in enumerate((0, 3, 4, 5, 40, 200, 900))] + [(8, "a", None), (9, "b", "ßacgtacgt")]
    seqs = spark.createDataFrame(rows, "seq_id long, grp string, seq string")
    for words in ([], ["ACGT", "acg", "CGT", "ACG", ""]):
        patterns = spark.createDataFrame([(f"p{i % 3}", w) for i, w in enumerate(words)], "name string, motif string")
        hits = Counter(r.seq_id for r in kmers.scan(seqs, patterns, 4).collect())
        want = sorted((i, g, len(s), hits[i]) for i, g, s in rows if s is not None and len(s) >= 4)
        assert sorted(map(tuple, kmers.hit_numbers(seqs, patterns, 4).collect())) == want and bool(words) == bool(hits)
        sheet = {r.grp: r for r in runs.explore(seqs, patterns, 4, 10, 1, 4).collect()}
        assert {g: (r.sequences, r.letters, r.hits) for g, r in sheet.items()} == {g: (sum(w[1] == g for w in want), sum(w[2] for w in want if w[1] == g), sum(w[3] for w in want if w[1] == g and g)) for g in {w[1] for w in want}}


def test_short_words_are_turned_once_and_not_a_window(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGTNR", [9, 9, 9, 9, 1, 1], k=n)) for n in (0, 1, 7, 8, 400, 3000)] + ["ACGT" * 50, "N" * 30, "R", "TTTTTTTTT", "é" * 9]
    pairs = kmers.packed_windows
    for k in range(1, kmers.DENSE + 1):
        words = np.array([rng.randrange(4) for _ in range(200)], np.uint16)
        assert all((x == y).all() for x, y in zip(pairs(words.astype(np.int64), k), (kmers.forward_windows(words, k), kmers.turned(kmers.forward_windows(words, k), k))))
        monkeypatch.setattr(kmers, "packed_windows", None)
        want = Counter(min(w, kmers.opposite(w)) for t in texts for w in (t[i : i + k] for i in range(len(t) - k + 1)) if "N" not in w)
        for times in (1, 30):  # few windows, which wait as numbers, and more than there are words
            got = Counter()
            for codes, odd, counts in kmers._counted(texts * times, k):
                for code, word, n in zip(codes.tolist(), odd, counts.tolist()):
                    got[word or "".join("ACGT"[code >> 2 * i & 3] for i in reversed(range(k)))] += n
            assert got == Counter({w: n * times for w, n in want.items()})
        monkeypatch.undo()
