"""The jobs as queries over the given tables: each runs twice into one new folder and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import candidate_sheet, motif_calls
from seqloom.plans import catalog as C

CALLS = {"patterns": dict(C.PATTERNS), "min_length": C.MIN_LEN, "width": 500, "step": 50}
SHEET = {"k": C.K, "terminal": C.T, "min_count": 2, "min_length": C.MIN_LEN}


def _new(spark: SparkSession, name: str) -> str:
    return f"{C.shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_motif_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = _new(spark, "motif-calls")
    motif_calls.run(spark, f"{sf_dir}/documents.parquet", to, **CALLS)
    return motif_calls.run(spark, f"{sf_dir}/documents.parquet", to, **CALLS)


def job2_candidate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = _new(spark, "candidate-sheet")
    candidate_sheet.run(spark, f"{sf_dir}/documents.parquet", to, **SHEET)
    return candidate_sheet.run(spark, f"{sf_dir}/documents.parquet", to, **SHEET)


JOB1_SQL = f"""WITH {C.LONG}, p AS (SELECT * FROM {C.patterns_sql()}), pos AS (SELECT seq_id, grp, seq, length(seq) AS length, unnest(range(0, length(seq))) AS position FROM lng),
h AS (SELECT seq_id, grp, length, name, position, strand FROM pos JOIN p ON starts_with(substring(seq, position + 1, 8), pattern)),
s AS (SELECT DISTINCT seq_id, name, position FROM h),
n AS (SELECT seq_id, name, max(grp) AS grp, max(length) AS length, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus FROM h GROUP BY ALL),
e AS (SELECT seq_id, name, count(*) AS sites, CASE WHEN count(*) >= 3 THEN CAST(floor(median(gap)) AS BIGINT) END AS period FROM (SELECT *, position - lag(position) OVER (PARTITION BY seq_id, name ORDER BY position) AS gap FROM s) GROUP BY ALL),
m AS (SELECT seq_id, name, min(position) AS mn, max(position) AS mx, count(*) FILTER (position < {CALLS['width']}) AS n0 FROM s GROUP BY ALL),
j AS (SELECT *, unnest(range(0, greatest((mx - mn - {CALLS['width']}) // {CALLS['step']} + 2, 0))) AS j FROM m),
c AS (SELECT j.seq_id, j.name, mn + j * {CALLS['step']} AS w0, count(*) AS n FROM j JOIN s ON j.seq_id = s.seq_id AND j.name = s.name AND position >= mn + j * {CALLS['step']} AND position < mn + j * {CALLS['step']} + {CALLS['width']} WHERE mn + j * {CALLS['step']} < mx - {CALLS['width']} GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, name ORDER BY n DESC, w0) AS r FROM c) WHERE r = 1)
SELECT n.seq_id, n.name, n.grp, CAST(n.length AS INTEGER) AS length, plus, minus, sites, coalesce(w0, 0) AS w0, coalesce(b.n, n0) AS in_window, period, coalesce(period BETWEEN 15 AND 5000, false) AS tandem, least(coalesce(w0, 0), n.length - coalesce(w0, 0)) AS from_end
FROM n JOIN e ON n.seq_id = e.seq_id AND n.name = e.name JOIN m ON n.seq_id = m.seq_id AND n.name = m.name LEFT JOIN b ON n.seq_id = b.seq_id AND n.name = b.name"""

JOB2_SQL = f"""WITH {C.ENRICH}, f AS (SELECT * FROM (SELECT *, {C.ORIENT} AS seed FROM e WHERE terminal_count >= {SHEET['min_count']} AND anchored) WHERE {C.spacer_sql('seed')} IS NOT NULL),
tops AS (SELECT *, least(seed, {C.rc('seed')}) AS word FROM (SELECT *, row_number() OVER (PARTITION BY grp, "end" ORDER BY round(fold, 9) DESC, seed) AS r FROM f) WHERE r = 1),
sh AS (SELECT seed, arg_max(grp, (s, g)) AS specific_to, max(s) / sum(s) AS share FROM (SELECT *, -row_number() OVER (ORDER BY grp) AS g FROM (SELECT seed, grp, sum(terminal_count) AS s FROM f GROUP BY ALL)) GROUP BY seed),
he AS (SELECT tops.grp, tops."end" AS e, word, c.seq_id, c.pos FROM c JOIN tops ON c.grp = tops.grp AND c.kmer = word AND tops."end" = CASE WHEN c.pos + {C.K} <= {C.T} THEN 'left' WHEN c.pos >= c.length - {C.T} THEN 'right' END, (SELECT unnest([1, 2]) AS strand) WHERE c.length >= {2 * C.T} AND (strand = 1 OR word = {C.rc('word')})),
ga AS (SELECT grp, e, count(*) AS genomic_hits, CASE WHEN count(gap) >= 2 THEN CAST(floor(median(gap)) AS BIGINT) END AS median_spacing_bp FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY grp, e, seq_id ORDER BY pos) AS gap FROM he) GROUP BY ALL),
al AS (SELECT tops.grp, tops."end" AS e, tops.seed, CAST({C.spacer_sql('tops.seed')} AS INTEGER) AS spacer, round(fold, 9) AS fold, terminal_count, round(share, 2) AS chrom_specificity, specific_to, coalesce(genomic_hits, 0) AS genomic_hits, median_spacing_bp, {C.low_sql('tops.seed')} AS low_complexity, coalesce(median_spacing_bp BETWEEN 15 AND 5000, false) AS tandem FROM tops JOIN sh ON tops.seed = sh.seed LEFT JOIN ga ON tops.grp = ga.grp AND tops."end" = ga.e),
sc AS (SELECT *, CASE WHEN NOT low_complexity THEN round(fold * chrom_specificity * CASE WHEN tandem THEN 1.0 ELSE 0.4 END, 6) END AS score FROM al)
SELECT grp, e AS "end", seed AS candidate_motif, spacer, round(fold, 6) AS fold_enrichment, terminal_count, chrom_specificity, specific_to, genomic_hits, median_spacing_bp, low_complexity, tandem, score, score IS NOT NULL AND row_number() OVER (PARTITION BY grp ORDER BY score DESC NULLS LAST, e) = 1 AS best FROM sc"""


def queries():
    return {f.__name__: f for f in (job1_motif_calls, job2_candidate_sheet)}


def oracle_sql():
    return {"job1_motif_calls": JOB1_SQL, "job2_candidate_sheet": JOB2_SQL}
