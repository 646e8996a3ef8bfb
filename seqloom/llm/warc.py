"""Deterministic sharded WARC writer and reader."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bucket_of, materialize, partitions, scratch, tune

#: Compressed bytes after which a file is closed and the next begun.
ROLL_BYTES = 256 << 20
#: Tasks that read archives, at most; each reads its files one after the other.
READ_TASKS = 20_000
#: Payloads below this size are always written whole.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def open_store(uri: str):
    """A file system that driver and executors both reach, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def classify(pages: DataFrame, id_col: str, text_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, payload_bytes, record_type, refers_to), a row for each page id and payload.

    Payloads of at least ``least`` bytes are grouped by their SHA-256; the largest page id of a group is the response."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    each = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(body).alias("digest"), F.sha2(body, 256).alias("wide"), F.octet_length(body).cast("long").alias("payload_bytes")).distinct()
    each = materialize(each, "payloads")
    first = each.where(F.col("payload_bytes") >= least).groupBy("wide").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))
    return each.join(apart(first), "wide", "left").select("page_id", "digest", "wide", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def render(page_id, url, body: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record: header block, HTTP header, payload (none for a revisit), two line ends."""
    http = HTTP + f"Content-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"X-Payload-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def exact_bounds(ids: DataFrame, shards: int) -> list[int]:
    """Ids at which shards 1, 2... begin, so that each has about as many rows of ids (one column). They are the ids of exact
    ranks, so they are the same in every run, however a sort samples. At most a row a shard comes to the driver; ids that
    fill several shards give fewer bounds."""
    c = ids.columns[0]
    ranked = materialize(ids.repartitionByRange(shards, c).sortWithinPartitions(c).withColumn("place", F.monotonically_increasing_id()), "ids")
    parts = sorted((r.part, r.n) for r in ranked.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, before, places = sum(n for _, n in parts), 0, []
    wanted = [i * total // shards for i in range(1, shards)]
    for part, n in parts:
        places += [(part << 33) + rank - before for rank in wanted if before <= rank < before + n]
        before += n
    if not places:
        return []
    found = ranked.join(F.broadcast(ids.sparkSession.createDataFrame([(x,) for x in places], "place long")), "place", "left_semi")
    return sorted({r[0] for r in found.select(c).collect()} - {None})


def write(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> str:
    """Write every page as a record into gzip-per-record WARC files under the folder ``to``; returns the manifest's URI.

    Records are range-sorted by page id, so a shard is a span of ids; the spans are cut at exact ranks, so files and manifest
    are the same, byte for byte, in every run over the same rows. Tasks write under temporary names and tell them by a
    table, which holds those of the tasks that succeeded; other tasks then give these files their final names, and may do
    so again if they are lost. The driver writes the manifest, a line a file, and deletes what lost tasks left behind; if
    any is left later, it is never read. Null html is an empty payload; a null page id sorts first and has no id header; repeated
    rows are written once each, all of them as their page id's payload is classified. Page ids may share payloads and
    payloads may share a page id."""
    spark = pages.sparkSession
    tune(spark)
    kinds = classify(pages, id_col, text_col)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.lit(1).alias("part"), F.col(url_col).cast("string").alias("url"), body.alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    metas = kinds.select("page_id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.col("record_type").alias("kind"), "refers_to")
    # What is known of a page travels as a row that sorts just before it, so the html is shuffled once.
    shards = shards or partitions(spark)
    shard = bucket_of(F.col("page_id"), exact_bounds(rows.select("page_id"), shards)).cast("int")
    both = rows.unionByName(metas).withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("page_id", "part", "digest", "url", "html").withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    token = uuid.uuid4().hex[:12]

    def run(batches):
        store, root = open_store(to)
        out, name, size, count, total, part, shard = None, "", 0, 0, 0, 0, None
        known, of, attempt = {}, object(), uuid.uuid4().hex[:12]

        def closed():
            out.close()
            return pd.DataFrame({"shard": [shard], "part": [part], "temporary": [name], "records": [count], "bytes": [size]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                page = row.page_id
                if page != of:
                    known, of = {}, page
                shard = int(row.shard)
                if row.part == 0:
                    known[row.digest] = (row.kind, row.refers_to)
                    continue
                data = row.html.encode("utf-8")
                digest = hashlib.sha1(data).hexdigest()
                kind, refers = known[digest]
                if out is None:
                    name, size, count = f"_{token}-{shard:05d}-{part:05d}-{attempt}.tmp", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                blob = gzip.compress(render(page, row.url, data, digest, kind, refers), LEVEL, mtime=0)
                out.write(blob)
                size, count = size + len(blob), count + 1
                if size >= roll_bytes:
                    yield closed()
                    out, part = None, part + 1
        if out is not None:
            yield closed()

    store, root = open_store(to)
    store.create_dir(root, recursive=True)
    made = materialize(both.mapInPandas(run, "shard int, part int, temporary string, records long, bytes long"), "written")

    def rename(batches):
        there, folder = open_store(to)
        for pdf in batches:
            names = [f"part-{s:05d}-{p:05d}.warc.gz" for s, p in zip(pdf["shard"], pdf["part"])]
            for name, final in zip(pdf["temporary"], names):
                if there.get_file_info(f"{folder}/{name}").is_file:  # else a lost attempt has renamed it
                    there.move(f"{folder}/{name}", f"{folder}/{final}")
            yield pdf.assign(file=names)[["file", "records", "bytes"]]

    named = materialize(made.repartition(partitions(spark), "temporary").mapInPandas(rename, "file string, records long, bytes long"), "named")
    files = [r.asDict() for r in sorted(named.collect())]  # a row for each file of ROLL_BYTES
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith(f"_{token}-"):
            store.delete_file(left.path)
    with store.open_output_stream(f"{root}/_manifest.tmp", compression=None) as f:
        f.write(json.dumps({"format": "WARC/1.1", "files": files}).encode())
    store.move(f"{root}/_manifest.tmp", f"{root}/manifest.json")
    return f"{to}/manifest.json"


def parse(stream):
    """Records of an uncompressed stream: (header dict, block bytes)."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8").partition(": ")
            head[key] = value
        n = int(head["Content-Length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield head, block


def read(spark: SparkSession, manifest: str, with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest lists; block and payload digests are checked on the way.

    A revisit's length and digest are those of the full payload it stands for. with_payload adds the column html,
    null for revisits."""
    store, path = open_store(manifest)
    with store.open_input_stream(path, compression=None) as f:
        files = json.loads(f.read())["files"]
    folder = manifest.rsplit("/", 1)[0]

    def run(batches):
        import io

        for pdf in batches:
            for name in pdf["file"]:
                here, root = open_store(folder)
                rows, held = [], 0
                with here.open_input_file(f"{root}/{name}") as raw:
                    for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                        if hashlib.sha1(block).hexdigest() != head["WARC-Block-Digest"][5:]:
                            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        body = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                        n = int(head["X-Payload-Length"])
                        if body is not None and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']}")
                        get = lambda k: int(head[k]) if k in head else None
                        url = head.get("WARC-Target-URI")
                        rows.append((get("X-Page-Id"), url if url is None else json.loads(f'"{url}"'), n, digest, kind, get("X-Refers-To-Page")) + ((body.decode("utf-8") if body is not None else None,) if with_payload else ()))
                        held += len(block) if with_payload else 200
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    names = [x.split()[0] for x in RECORD.split(", ")] + ["html"] * with_payload

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        for c in ("page_id", "refers_to"):
            out[c] = pd.array(out[c], "Int64")
        return out

    schema = RECORD + ", html string" * with_payload
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(x["file"],) for x in files], "file string").repartition(min(len(files), READ_TASKS))
    return listed.mapInPandas(run, schema)


def write_and_read(pages: DataFrame, to: str | None = None, **options) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(pages, to or scratch(spark, "warc"), **options))
