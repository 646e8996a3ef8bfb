"""Readers and sinks on generated files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.sources import readers, rest, writers
from seqloom.streaming import counts


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">s1 k=v x=>y\nACGT\n  ac gt \n>s2\n\n>s1 later\nTTTT\n")
    rows = {r.seq_id: r for r in readers.read_fasta(spark, str(p)).collect()}
    assert rows["s1"].seq == "TTTT" and rows["s1"].header == "s1 later" and rows["s2"].seq == ""
    blank = tmp_path / "d.fa"
    blank.write_text("lost\n  >a x\nAC\n \t>b\nGT\n>c\n>a\nTT\n   >b last\nGG")
    assert {r.seq_id: (r.header, r.seq) for r in readers.read_fasta(spark, str(blank)).collect()} == {"a": ("a", "TT"), "b": ("b last", "GG"), "c": ("c", "")}
    g = tmp_path / "b.fa.gz"
    g.write_bytes(gzip.compress(b"lost\n>p1 a=1 b=2=3 c\nMK\nVL\n"))
    rows = readers.read_fasta(spark, str(g), 2).collect()
    assert [(r.seq_id, r.seq) for r in rows] == [("p1", "MKVL")]
    assert readers.read_header_fields(spark, str(g)).first().fields == {"id": "p1", "a": "1", "b": "2=3"}
    bad = tmp_path / "c.fa"
    bad.write_text(">\nACGT\n")
    with pytest.raises(Exception, match="empty FASTA header"):
        readers.read_fasta(spark, str(bad)).collect()


def test_text_before_the_header_of_any_file(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for i in range(4):
        (tmp_path / "x" / f"{i}.fa").write_text(f"lost {i}\n>s{i}\nAC\n>t{i}\nGT\n" if i % 2 else f">s{i}\nAC\n>t{i}\nGT\n")
    assert {(r.seq_id, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "x")).collect()} == {(f"{a}{i}", s) for i in range(4) for a, s in (("s", "AC"), ("t", "GT"))}


def test_alignments_have_one_width(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">a\nAC.g\n>b\nA--G\n")
    assert {(r.name, r.aligned) for r in readers.read_alignment(spark, str(p)).collect()} == {("a", "AC-G"), ("b", "A--G")}
    p.write_text(">a\nACG\n>b\nA\n")
    with pytest.raises(Exception, match="not aligned"):
        readers.read_alignment(spark, str(p)).collect()


def test_gff_oligos_hits_factors(spark, tmp_path):
    g = tmp_path / "a.gff3"
    g.write_text("##gff\nI\tW\tgene\t10\t20\t.\t+\t.\tID=Gene:WBGene1;locus=him-8 # note\n# c\nI\tW\tmRNA\t11\t19\t.\t-\t0\tID=x\n")
    rows = readers.read_gff(spark, str(g)).orderBy("start").collect()
    assert [(r.type, r.start, r.end) for r in rows] == [("gene", 10, 20), ("mRNA", 11, 19)] and rows[0].attributes.strip() == "ID=Gene:WBGene1;locus=him-8"
    o = tmp_path / "o.txt"
    o.write_text("  ACGTN xx acg\n\n123\n   tt\n")
    rows = readers.read_oligos(spark, str(o)).orderBy("line_no").collect()
    assert [(r.offset, r.oligo, r.skipped) for r in rows] == [(2, "ACGTN", 1), (3, "tt", 0)]
    h = tmp_path / "h.tsv"
    h.write_text("q\ts\t50.0\t10\t80\t30.5\t1e-5\nq\ts\t60.0\t9\t70\t40.5\t1e-6\n")
    assert [(r.pident, r.bitscore) for r in readers.read_hits(spark, str(h)).collect()] == [(60.0, 40.5)]
    f = tmp_path / "f.json"
    f.write_text('{"matrix_id":"M1","name":"HIM8","uniprot":"Q1","species":"x","pfm":{"A":[1],"C":[0],"G":[0],"T":[0]}}\n{"matrix_id":"M2","name":"b","uniprot":"","species":"y"}\n{"matrix_id":"M3","name":"c","uniprot":"Q3","species":"Worm","pfm":{"A":[1],"C":[0],"G":[0],"T":[0]}}\n')
    assert [r.matrix_id for r in readers.read_factors(spark, str(f), ("worm",)).collect()] == ["M1"]


def test_pending_keeps_order(spark):
    w = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "ord int, k string")
    assert [r.k for r in readers.pending(w, spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b", "c"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "ACGT"), ("s2", "TT")], "seq_id string, seq string")
    writers.write_fasta(df, str(tmp_path / "fa"))
    assert {r.seq_id: r.seq for r in readers.read_fasta(spark, str(tmp_path / "fa")).collect()} == {"s1": "ACGT", "s2": "TT"}
    writers.write_vectors(spark.createDataFrame([("x", [1.0, 2.0])], "name string, vector array<double>"), str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v")).first().vector == [1.0, 2.0]
    writers.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_table(spark, str(tmp_path / "csv"), "seq_id string, seq string").count() == 2
    writers.write_metadata(spark, str(tmp_path / "meta"), model="m", dim=3)
    assert spark.read.json(str(tmp_path / "meta")).first().dim == 3


def test_router():
    r = writers.Router("out", [("head_", "05"), ("h", "x")])
    assert r.path("head_scores.csv") == "out/05/head_scores.csv" and r.path("hits.csv") == "out/x/hits.csv" and r.path("other") == "out/other"


def test_paged_source(spark, tmp_path):
    (tmp_path / "2.json").write_text('{"results": [{"a": 3}], "next": null}')
    (tmp_path / "1.json").write_text('{"results": [{"a": 1}, {"a": 2}], "next": "file://%s/2.json"}' % tmp_path)
    spark.dataSource.register(rest.PagedJson)
    rows = spark.read.format("paged_json").option("url", f"file://{tmp_path}/1.json").load()
    assert rows.select(F.get_json_object("value", "$.a").alias("a")).orderBy("a").collect() == [("1",), ("2",), ("3",)]


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(1, "a", "ACGTACGT"), (2, "a", "TTGGN")], "seq_id long, grp string, seq string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("seq_id long, grp string, seq string").parquet(str(tmp_path / "in"))
    q = counts.stream_kmers(s, 4).writeStream.outputMode("complete").format("memory").queryName("k").start()
    q.processAllAvailable()
    q.stop()
    got = {r.kmer: r.cnt for r in spark.table("k").collect()}
    assert got == {"ACGT": 2, "CGTA": 1, "GTAC": 1, "TACG": 1, "CCAA": 1} or got == {"ACGT": 2, "CGTA": 2, "GTAC": 1, "CCAA": 1}


@pytest.fixture
def listing():
    """A local server of JSON pages that counts requests, and stops answering after so many."""
    import http.server
    import threading
    from collections import Counter

    asked, left = Counter(), [10**6]

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            left[0] -= 1
            n = int(self.path.rsplit("/", 1)[1])
            if left[0] < 0 or n == 99:
                self.send_error(500)
                return
            body = b"not json" if n == 13 else json.dumps({"results": [{"id": 2 * n}, {"id": 2 * n + 1}], "next": f"http://127.0.0.1:{self.server.server_port}/p/{n + 1}" if n < 6 else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/p/", asked, left
    server.shutdown()


def test_pages_as_partitions_or_by_links(spark, listing):
    url, asked, _ = listing
    spark.dataSource.register(rest.PagedJson)
    read = lambda **o: sorted(json.loads(r.value)["id"] for r in spark.read.format("paged_json").options(**o).load().collect())
    assert read(url=url + "1") == list(range(2, 14))
    by_page = spark.read.format("paged_json").options(url=url + "{page}", pages=6).load()
    assert by_page.rdd.getNumPartitions() == 6
    asked.clear()
    assert read(url=url + "{page}", pages=6) == list(range(2, 14)) and set(asked.values()) == {1}


def test_fetching_resumes_without_a_second_request(spark, listing, tmp_path):
    url, asked, left = listing
    wanted = spark.createDataFrame([(f"{url}{i}", i) for i in [*range(30), 3, 4, 99]] + [(None, 5)], "url string, ord int")
    path = str(tmp_path / "kept")
    left[0] = 12
    first = rest.resume(wanted, path, "url", rest.fetched, 8).collect()
    assert 10 <= len(first) <= 12
    known = {r.url for r in first}
    left[0] = 10**6
    asked.clear()
    again = {r.url: r.value for r in rest.resume(wanted, path, "url", rest.fetched, 8).collect()}
    # One page is no JSON and one always fails: both are set aside, and all others are there.
    assert set(again) == {f"{url}{i}" for i in range(30) if i != 13} and known <= set(again)
    assert not [u for u in known if asked[u[u.index("/p/") :]]] and max(asked.values()) == 1
    asked.clear()
    rest.resume(wanted, path, "url", rest.fetched, 8).collect()
    assert set(asked) == {"/p/13", "/p/99"}
    errors = spark.read.parquet(path).where("error is not null")
    assert errors.where("url like '%/99'").count() == 3 and json.loads(again[f"{url}2"])["results"] == [{"id": 4}, {"id": 5}]


def test_resuming_keeps_to_the_most_by_order(spark, tmp_path):
    wanted = spark.createDataFrame([(k, o) for o, k in enumerate("badcfeab")], "key string, ord int")
    work = lambda df: df.select("key", F.upper("key").alias("value"), F.lit(None).cast("string").alias("error"))
    path = str(tmp_path / "kept")
    assert {r.key for r in rest.resume(wanted, path, "key", work, 2, 3).collect()} == set("bad")
    assert {r.key for r in rest.resume(wanted, path, "key", work, 2, 5).collect()} == set("badcf")
    assert {r.key for r in rest.resume(wanted, path, "key", work, 2, 5).collect()} == set("badcf")
    assert {r.key for r in rest.resume(wanted.limit(0), str(tmp_path / "none"), "key", work).collect()} == set()
