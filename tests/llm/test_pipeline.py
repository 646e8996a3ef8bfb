"""The pipeline's stages against plain versions of what they decide."""

import os
from collections import Counter

import corpus_pipeline as C
import duckdb
from test_exact import brute as brute_exact
from test_near import brute as brute_near
from test_packing import check

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}

    good = C.keep_good(spark, docs, SF)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    assert all(q == 1 or d not in kept for d, q in labels.items() if d in text) and sum(d in kept for d, q in labels.items() if q == 1 and d in text) == sum(q == 1 for d, q in labels.items() if d in text)

    single = C.drop_copies(spark, good, SF)
    want = {d for d, k, _, ok, _ in brute_exact([(d, text[d]) for d in kept]) if ok}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want

    apart = C.drop_near_copies(spark, single, SF)
    ids = sorted(want)
    _, comp = brute_near([text[d] for d in ids])
    assert {r.doc_id for r in apart.collect()} == {ids[c] for c in comp}

    mixed = C.mix_sources(spark, apart, SF)
    assert mixed.columns == columns
    taken = Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and (r.text == text[r.doc_id] or text[r.doc_id].split()[: len(r.text.split())] == r.text.split())
        taken[r.source] += len(r.text.split())
    total = sum(len(r.text.split()) for r in apart.collect())
    assert abs(sum(taken.values()) - total) <= len(taken)

    one = mixed.dropDuplicates(["doc_id"]).cache()
    rows = C.pack(spark, one, SF).collect()
    assert check(rows, {r.doc_id: r.text for r in one.collect()}) < 0.2


def test_stages_on_null_and_repeated_ids(spark, make_docs):
    """Rows, not ids, are kept or dropped."""
    long_ = " ".join(f"w{i}" for i in range(80))
    near = long_ + " end"
    texts = ["alpha beta", "alpha beta", "ALPHA beta", "gamma delta", "alpha beta", long_, near, long_, None, "", "eps zeta"]
    ids = [1, 1, None, 1, None, None, None, 5, None, None, 7]
    docs = make_docs(texts, ids=ids)
    single = C.drop_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in single), key=str) == sorted([(1, "alpha beta"), (1, "gamma delta"), (5, long_), (None, near), (None, ""), (7, "eps zeta")], key=str)
    left = C.drop_near_copies(spark, make_docs([r.text for r in single], ids=[r.doc_id for r in single]), SF)
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == sorted([(1, "alpha beta"), (1, "gamma delta"), (5, long_), (None, ""), (7, "eps zeta")], key=str)
    mixed = C.mix_sources(spark, docs, SF).collect()
    total = sum(len((t or "").split()) for t in texts)
    assert abs(sum(len(r.text.split()) for r in mixed) - total) <= 1  # one source: its target is its size
    assert Counter(r.text for r in mixed) == Counter(t for t in texts if t)
    assert C.drop_copies(spark, docs.limit(0), SF).count() == C.drop_near_copies(spark, docs.limit(0), SF).count() == C.mix_sources(spark, docs.limit(0), SF).count() == 0
    assert C.keep_good(spark, docs, SF).columns == docs.columns


def test_run_and_registry(spark):
    assert C.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))


def test_oracles(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            r = con.execute(sql)
            columns = [d[0] for d in r.description]
            theirs = sorted((tuple(x) for x in r.fetchall()), key=str)
            df = entry.queries()[name](spark, SF)
            assert sorted(df.columns) == sorted(columns)
            assert sorted((tuple(x) for x in df.select(*columns).collect()), key=str) == theirs
