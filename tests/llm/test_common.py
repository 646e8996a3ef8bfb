import re
import zlib

import numpy as np

from seqloom.llm import common


def test_words_are_cut_at_the_same_six_bytes():
    text = "".join(chr(i) + "x" for i in range(0x3000)) + " \t\n\r\x0b\x0c end"
    assert [w.decode() for w in text.encode().split()] == re.findall(common.WORD, text)


def test_folds(spark):
    ids = [0, 7, -3, 123456789012, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.m for r in df.select("doc_id", common.crc_mod("doc_id", 5).alias("m")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids}


def test_scratch_lies_in_the_shared_folder(spark):
    made = common.materialize(spark.range(5), "t")
    assert all(f.startswith(spark.conf.get("spark.checkpoint.dir").replace("file://", "file:")) or f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in made.inputFiles())
    assert made.count() == 5


def test_helpers():
    owner, starts = common.ragged(np.array([2, 0, 3]))
    assert owner.tolist() == [0, 0, 2, 2, 2] and starts.tolist() == [0, 2, 2, 5]
    h = common.WordHashes(most=2)
    assert h([b"a", b"b", b"c", b"a"])[0] == h([b"a"])[0] and len({*h([b"a", b"b", b"c"]).tolist()}) == 3
    x = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(common.mix64(x))) == 1000
