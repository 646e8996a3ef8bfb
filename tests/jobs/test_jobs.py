"""The jobs on copies of the given tables: growing input, reruns, lost batches, odd rows, command lines."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import candidate_sheet, common, motif_calls, registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def parts(spark, tmp_path):
    """Three files of documents, to be delivered one after the other, and the folder they come to."""
    made = tmp_path / "made"
    spark.read.parquet(f"{SF}/documents.parquet").repartitionByRange(3, "doc_id").write.parquet(str(made))
    files = sorted(made.glob("part-*.parquet"))
    assert len(files) == 3
    into = tmp_path / "documents"
    into.mkdir()
    return files, into


def deliver(file, into):
    shutil.copy(file, into / file.name)


def run_calls(spark, into, out, **more):
    return motif_calls.run(spark, str(into), str(out), **(registry.CALLS | more))


def batches(out):
    return sorted(int(p.name.split("=")[1]) for p in (Path(out) / "calls").glob("batch=*"))


def test_calls_grow_with_the_input_and_reruns_add_nothing(spark, parts, tmp_path):
    files, into = parts
    deliver(files[0], into)
    first = run_calls(spark, into, tmp_path / "out")
    one = rows(first)
    assert one and rows(run_calls(spark, into, tmp_path / "out")) == one and batches(tmp_path / "out") == [0]
    for f in files[1:]:
        deliver(f, into)
    grown = rows(run_calls(spark, into, tmp_path / "out"))
    assert len(grown) > len(one) and set(one) < set(grown) and batches(tmp_path / "out") == [0, 1]
    # All at once, and a file at a time, give the same.
    assert rows(run_calls(spark, into, tmp_path / "whole")) == grown
    assert rows(run_calls(spark, into, tmp_path / "single", files_per_batch=1)) == grown and len(batches(tmp_path / "single")) == 3


def test_only_new_files_are_read(spark, parts, tmp_path, caplog):
    files, into = parts
    deliver(files[0], into)
    n = [spark.read.parquet(str(f)).count() for f in files]
    with caplog.at_level("INFO", "motif_calls"):
        run_calls(spark, into, tmp_path / "out")
        deliver(files[2], into)
        run_calls(spark, into, tmp_path / "out")
        run_calls(spark, into, tmp_path / "out")
    said = [m for m in caplog.messages if m.startswith("read ")]
    assert [int(m.split()[1]) for m in said] == [n[0], n[2], 0]


def test_a_batch_that_failed_half_way_is_taken_again(spark, parts, tmp_path, monkeypatch):
    files, into = parts
    deliver(files[0], into)
    run_calls(spark, into, tmp_path / "out")
    deliver(files[1], into)
    whole = motif_calls._write

    def broken(found, path, batch):
        whole(found, path, batch)
        if path.endswith("hits"):
            raise RuntimeError("executor lost")

    monkeypatch.setattr(motif_calls, "_write", broken)
    with pytest.raises(Exception, match="executor lost"):
        run_calls(spark, into, tmp_path / "out")
    assert batches(tmp_path / "out") == [0]
    monkeypatch.setattr(motif_calls, "_write", whole)
    again = rows(run_calls(spark, into, tmp_path / "out"))
    assert again == rows(run_calls(spark, into, tmp_path / "fresh"))
    hits = spark.read.schema(motif_calls.HITS).parquet(str(tmp_path / "out" / "hits"))
    assert hits.count() == hits.distinct().count() == spark.read.schema(motif_calls.HITS).parquet(str(tmp_path / "fresh" / "hits")).count()


def test_calls_by_hand(spark, tmp_path):
    """A tandem repeat of the anchor every 30 letters, one hit on the other strand, rows without id or text."""
    into = tmp_path / "docs"
    array = "".join("TTGGTC" + "A" * 24 for _ in range(20))
    # A, G and T stand for themselves in a text, B for C; the filler has no motif.
    text = ("A" * 300 + array + "A" * 200 + "GACCAA" + "A" * 100).replace("C", "B")
    docs = [(1, "s", text, 5), (2, None, text.lower(), 5), (None, "s", text, 5), (3, "s", None, 5), (4, "s", "", 5), (5, "s", "TTGGTC", 5)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, length int").write.parquet(str(into))
    got = run_calls(spark, into, tmp_path / "out", patterns={"anchor": "TTGGTC", "none": "GGGGGG"}, min_length=50, width=300, step=10)
    want = {"name": "anchor", "length": len(text), "plus": 20, "minus": 1, "sites": 21, "w0": 300, "in_window": 10, "period": 30, "tandem": True, "from_end": 300}
    found = {r.seq_id: r.asDict() for r in got.collect()}
    assert set(found) == {1, 2}
    for i, grp in ((1, "s"), (2, None)):
        assert found[i] == want | {"seq_id": i, "grp": grp}


def test_no_documents(spark, tmp_path):
    into = tmp_path / "none"
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(into))
    assert run_calls(spark, into, tmp_path / "out").collect() == []
    assert candidate_sheet.run(spark, str(into), str(tmp_path / "sheet"), **registry.SHEET).collect() == []


def test_settings_of_the_session_stay(spark, parts, tmp_path):
    files, into = parts
    deliver(files[0], into)
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"), spark.conf.get("spark.sql.shuffle.partitions")
    run_calls(spark, into, tmp_path / "out")
    candidate_sheet.run(spark, str(into), str(tmp_path / "sheet"), **registry.SHEET)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"), spark.conf.get("spark.sql.shuffle.partitions"))
    assert not spark.streams.active and not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_sheet_is_rewritten_whole(spark, parts, tmp_path):
    files, into = parts
    more = registry.SHEET | {"min_count": 1}
    deliver(files[0], into)
    candidate_sheet.run(spark, str(into), str(tmp_path / "out"), **more)
    for f in files[1:]:
        deliver(f, into)
    twice = [rows(candidate_sheet.run(spark, str(into), str(tmp_path / "out"), **more)) for _ in range(2)]
    assert twice[0] == twice[1] == rows(candidate_sheet.run(spark, str(into), str(tmp_path / "fresh"), **more))
    # A source that is gone leaves no rows behind.
    less = tmp_path / "less"
    gone = spark.read.parquet(str(into)).groupBy("source").count().orderBy("source").first().source
    spark.read.parquet(str(into)).where(F.col("source") != gone).write.parquet(str(less))
    left = candidate_sheet.run(spark, str(less), str(tmp_path / "out"), **more)
    assert left.where(F.col("grp") == gone).count() == 0 and left.count() > 0


def test_one_best_candidate_a_source(spark, tmp_path):
    got = candidate_sheet.run(spark, f"{SF}/documents.parquet", str(tmp_path / "out"), **(registry.SHEET | {"min_count": 1})).collect()
    for g in {r.grp for r in got}:
        mine = [r for r in got if r.grp == g]
        assert len(mine) <= 2 and sum(r.best for r in mine) == any(not r.low_complexity for r in mine)
        scored = [r for r in mine if r.score is not None]
        assert all(not r.best or r.score == max(x.score for x in scored) for r in mine)
    for r in got:
        assert r.chrom_specificity <= 1 and r.genomic_hits >= r.terminal_count and r.candidate_motif.startswith("TTGG")


@pytest.mark.parametrize("job", ["motif_calls", "candidate_sheet"])
def test_command_line(spark, job, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"documents": f"{SF}/documents.parquet", "min_length": 400}))
    env = dict(os.environ, PYTHONPATH=str(ROOT), PYSPARK_SUBMIT_ARGS="--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell")
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", str(config), "--output", str(tmp_path / "out")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert f"{job} read" in done.stderr and "wrote" in done.stderr
    assert list((tmp_path / "out").rglob("*.parquet"))
    bad = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--nonsense", "1"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=60)
    assert bad.returncode == 2


def test_settings_files_name_the_arguments():
    for job in (motif_calls, candidate_sheet):
        known = json.loads(Path(job.__file__).with_suffix(".json").read_text())
        import inspect

        assert set(known) == set(inspect.signature(job.run).parameters) - {"spark"}
    assert common.folder("a/", "b") == "a/b"
