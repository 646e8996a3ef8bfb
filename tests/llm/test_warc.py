import gzip
import hashlib
import io
import json
from collections import defaultdict

import pytest

from seqloom.llm import warc
from seqloom.llm.common import scratch


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard int, kind string")


ROWS = [(i, f"http://h/{i}?é=\"\n", ["x" * 1000, "x" * 999, "é" * 500, "short", None, "", "y\r\n\r\n" * 700][i % 7], 1, "k") for i in range(60)]
ROWS += [(None, None, "z" * 2000, 1, "k"), (None, "u", "x" * 1000, 1, "k"), (7, "again", "x" * 1000, 1, "k"), (7, "again", "x" * 1000, 1, "k")]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] or "").encode()].append(r[0])
    out = []
    for r in rows:
        body = (r[2] or "").encode()
        ids = [x for x in groups[body] if x is not None]
        top = max(ids) if ids else None
        again = len(body) >= 1000 and top is not None and r[0] != top
        out.append((r[0], r[1], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = pages(spark, ROWS)
    to = scratch(spark, "w")
    manifest = warc.write(df, to, roll_bytes=2000, shards=3)
    back = warc.read(spark, manifest, with_payload=True).collect()
    assert sorted((tuple(r)[:6] for r in back), key=str) == brute(ROWS)
    assert sorted(r.html for r in back if r.html is not None) == sorted(r[2] or "" for r, b in zip(sorted(ROWS, key=lambda r: str((r[0], r[1]))), sorted(brute(ROWS), key=lambda b: str((b[0], b[1])))) if b[4] == "response")
    store, path = warc.open_store(to)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    assert len(files) > 3 and sum(f["records"] for f in files) == len(ROWS)
    for f in files:  # each record is a gzip member of its own
        with store.open_input_stream(f"{path}/{f['file']}", compression=None) as raw:
            data = raw.read()
        assert len(data) == f["bytes"]
        assert len(list(warc.parse(io.BytesIO(gzip.decompress(data))))) == f["records"]
    assert not [x for x in store.get_file_info(warc.fs.FileSelector(path)) if x.base_name.endswith(".tmp")]
    again = warc.write(df, scratch(spark, "w"), roll_bytes=2000, shards=3)
    with warc.open_store(again)[0].open_input_stream(warc.open_store(again)[1]) as f:
        assert json.loads(f.read())["files"] == files


def test_left_over_files_are_not_read(spark):
    to = scratch(spark, "w")
    manifest = warc.write(pages(spark, ROWS), to)
    store, path = warc.open_store(to)
    with store.open_output_stream(f"{path}/_x-00000-00000-lost.tmp", compression=None) as f:
        f.write(b"junk")
    assert warc.read(spark, manifest).count() == len(ROWS)


def test_damage_is_found(spark):
    to = scratch(spark, "w")
    manifest = warc.write(pages(spark, ROWS[:5]), to, shards=1)
    store, path = warc.open_store(to)
    name = f"{path}/part-00000-00000.warc.gz"
    with store.open_input_stream(name, compression=None) as f:
        data = gzip.decompress(f.read())
    with store.open_output_stream(name, compression=None) as f:
        f.write(gzip.compress(data.replace(b"short", b"shirt")))
    with pytest.raises(Exception, match="block digest"):
        warc.read(spark, manifest).collect()


def test_empty_table(spark):
    assert warc.write_and_read(pages(spark, [])).count() == 0


def test_two_writes_give_equal_bytes(spark):
    """More rows than a range sort samples, dealt out differently, in one session."""
    rows = [(i * 7919 % 30_011, f"http://h/{i}", f"page {i % 400} " * (1 + i % 3), 1, "k") for i in range(6000)] + [(None, None, "x", 1, "k"), (None, "u", None, 1, "k")]
    made = []
    for df in (pages(spark, rows), pages(spark, rows[::-1]).repartition(7)):
        to = scratch(spark, "w")
        warc.write(df, to, roll_bytes=40_000, shards=4)
        store, path = warc.open_store(to)
        files = {}
        for x in store.get_file_info(warc.fs.FileSelector(path)):
            with store.open_input_stream(x.path, compression=None) as f:
                files[x.base_name] = f.read()
        made.append(files)
    assert made[0] == made[1] and len(made[0]) > 8 and "manifest.json" in made[0]


def test_bounds_are_exact_ranks(spark):
    ids = [5] * 50 + list(range(100, 150)) + [None] * 3
    df = spark.createDataFrame([(i,) for i in ids], "page_id long").repartition(5)
    order = sorted(ids, key=lambda i: (i is not None, i))
    assert warc.exact_bounds(df, 8) == sorted({order[i * len(ids) // 8] for i in range(1, 8)} - {None})
    assert warc.exact_bounds(df.limit(0), 8) == [] and warc.exact_bounds(df, 1) == []
