"""Queries of the corpus operators with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, exact, fingerprint, html_extract, langid, mixing, near, packing, quality, substring, tokens, warc
from .common import LOWER, UPPER, table


def op2_style_tree_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.cross_validated(table(spark, sf_dir, "documents"))


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op5_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.transform("positions", lambda x: F.round(x, 6)).alias("positions"))


def op6_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cross_validated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"))


def op11_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_plain_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(table(spark, sf_dir, "embeddings"))


_SHARES = ", ".join(f"({i}, {k}, {x!r}::DOUBLE)" for i, own in enumerate(mixing.phases(mixing.CURRICULUM, mixing.WEIGHTS)[1]) for k, x in enumerate(own))

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - 48, 1)), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS hs FROM d),
y AS (SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS s FROM x),
f AS (SELECT h, min(doc_id) AS m FROM y GROUP BY h),
g AS (SELECT DISTINCT y.doc_id, y.s + o.o AS k FROM y JOIN f ON y.h = f.h AND y.doc_id > f.m CROSS JOIN (SELECT unnest(range(0, 50)) AS o) AS o),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
q AS (SELECT p.doc_id, count(g.k) AS gone, string_agg(CASE WHEN g.k IS NULL THEN p.word END, ' ' ORDER BY p.k) AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(q.gone, 0) AS n_removed, sha256(coalesce(q.kept, '')) AS kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
w AS (SELECT body, max(page_id) AS winner FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT p.page_id, p.url, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN w.winner IS NOT NULL AND w.winner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.body = w.body
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a
"""

#: A source's share of the targets: sources become full in the order of their repeats' size by weight, so with the first k
#: full the level is what is left by the weight left; the first k whose next source stays below it gives the right one.
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST(('0x' || substring(md5(concat('{mixing.SEED}:', doc_id)), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][turn + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, turn, source NULLS LAST) AS k FROM w),
f AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT coalesce(arg_min(level, k) FILTER (cap / weight >= level), max(cap / weight)) AS level FROM f),
t AS (SELECT source, source_size, turn, least(cap, weight * v.level) AS target FROM w, v),
g AS (SELECT turn, sum(target) AS due FROM t GROUP BY turn),
c AS (SELECT turn, k, share, sum(share) OVER (PARTITION BY turn ORDER BY k) - share AS begun FROM (VALUES {_SHARES}) AS x(turn, k, share)),
q AS (SELECT k, sum(share * due) / (SELECT sum(due) FROM g) AS width FROM c JOIN g USING (turn) GROUP BY k),
z AS (SELECT k, width, sum(width) OVER (ORDER BY k) - width AS low FROM q),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.turn, floor(t.target)::BIGINT AS goal, (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS rounds FROM a),
e AS (SELECT *, least(greatest(goal - rounds * source_size - off, 0), size) AS rest FROM b),
u AS (SELECT doc_id, turn, target, unnest(range(0, rounds + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS copy, (off + copy * source_size) / target AS share FROM e WHERE size > 0),
p AS (SELECT doc_id, list(round(least(low + (u.share - begun) * width / c.share, least(low + width, 1.0)), 6) ORDER BY copy) AS positions FROM u JOIN c ON c.turn = u.turn AND u.share >= c.begun AND c.share > 0 AND NOT EXISTS (SELECT 1 FROM c y WHERE y.turn = u.turn AND y.k > c.k AND y.share > 0 AND u.share >= y.begun) JOIN z ON z.k = c.k GROUP BY doc_id)
SELECT e.doc_id, size, source_size, round(target, 6) AS target, size * rounds + rest AS taken, coalesce(p.positions, CAST([] AS DOUBLE[])) AS positions FROM e LEFT JOIN p ON e.doc_id = p.doc_id
"""


def op12_sql() -> str:
    """The rounds are spelt out: c0 to c3 are the centroids (c, x), a0 to a3 the vectors with their distances to each."""
    steps = [f"""k AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda v: floor({clustering.STEPS} * v::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {clustering.DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256(concat('{clustering.SEED}:', vec_id)) AS h FROM k ORDER BY h, x LIMIT {clustering.CLUSTERS}))"""]
    for n in range(clustering.ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT i, vec_id, k.x, min((list_sum(list_transform(list_zip(k.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, m.c)) AS b FROM k CROSS JOIN c{n} AS m GROUP BY ALL)")
        if n < clustering.ROUNDS:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.x, o.x) AS x FROM c{n} AS o LEFT JOIN (SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // m ELSE -((m - 1 - s) // m) END AS BIGINT) ORDER BY d) AS x FROM (SELECT b[2] AS c, d, sum(v) AS s, count(*) AS m FROM (SELECT b, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS d FROM a{n}) GROUP BY ALL) GROUP BY c) AS w ON w.c = o.c)")
    n = clustering.ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, b[1] AS distance, CAST(sum(b[1]) OVER (PARTITION BY b[2]) AS BIGINT) AS cluster_inertia, CAST(sum(b[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{n} JOIN c{n} AS z ON z.c = b[2]"""


def queries():
    own = (op1_curriculum_mix, op2_style_tree_extract, op3_kneser_ney_langid, op4_canonical_digest, op5_seed_and_extend, op6_order_preserving_packing, op7_warc_writer, op8_exact_dedup, op9_neighbour_quality, op10_setsketch_near_dedup, op11_pretoken_counts, op12_plain_lloyd)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    whole = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return whole | {"op1_curriculum_mix": OP1_SQL, "op10_setsketch_near_dedup": OP10_SQL, "op12_plain_lloyd": op12_sql(), "op5_seed_and_extend": OP5_SQL, "op7_warc_writer": OP7_SQL, "op8_exact_dedup": OP8_SQL}
