"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialize, mix64, ragged, tune

#: Longest n-gram of characters.
ORDER = 5
#: Training documents of one language, about: a hash of the id picks them where there are more.
SAMPLE_DOCS = 400
#: Languages whose n-grams share one set of arrays; each further set is for as many more. Results don't depend on it.
SHARD = 8
#: Characters over which what no n-gram explains is spread.
ALPHABET = 2048
#: Keeps the curve of the score finite where the calibration sees no mistake.
RIDGE = 1.0
SEED = 314159
UNDETERMINED = "und"
_BOUNDARY = ord(" ")


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths) of the texts as the models see them: lower case, a space for each run of anything but
    letters, a space at both ends; length 0 for a text without letters."""
    joined = "\0".join((t or "").lower() for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _letter_table()
    text = np.flatnonzero(codes == 0)
    if len(text) != len(texts):  # a text that holds the separator itself
        joined = "\0".join((t or "").replace("\0", " ").lower() for t in texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.flatnonzero(codes == 0)
    is_letter = known[codes]
    before = np.concatenate([[False], is_letter[:-1]])
    keep = is_letter | before  # letters, and the first of what follows a letter
    out = np.where(is_letter, codes, _BOUNDARY).astype(np.uint32)
    owner = np.searchsorted(text, np.flatnonzero(keep))
    kept, has = out[keep], np.bincount(owner, minlength=len(texts))
    lengths = np.where(has > 0, has + 1, 0)  # a space goes before each text that has letters
    _, starts = ragged(lengths)
    made = np.full(starts[-1], _BOUNDARY, np.uint32)
    place = np.arange(len(kept)) + np.cumsum(has > 0)[owner]
    made[place] = kept
    return made, lengths


_table: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _table
    if _table is None:
        _table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _table


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n = 1..order; a place nearer the begin than n is garbage."""
    out = [mix64(codes.astype(np.uint64) + np.uint64(1))]
    for n in range(2, order + 1):
        prior = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])  # of the n-1 characters before this one
        out.append(mix64(prior * np.uint64(0x9E3779B97F4A7C15) + codes))
    return out


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs (lang, text) to (lang, n, gram, prior, suffix, cnt): counts of n-grams, with the hashes of the n-1 characters before and of the
    last n-1 characters."""

    def run(batches):
        for b in batches:
            pdf = b.to_pandas()
            for lang, own in pdf.groupby("lang"):
                codes, lengths = letters(own["text"].tolist())
                if not len(codes):
                    continue
                hashes = gram_hashes(codes, order)
                _, starts = ragged(lengths[lengths > 0])
                place = np.arange(len(codes)) - np.repeat(starts[:-1], lengths[lengths > 0])
                for n in range(1, order + 1):
                    # A text begins at its second character: the leading space is context only.
                    at = np.flatnonzero(place >= max(1, n - 1))
                    gram, first, cnt = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
                    at = at[first]
                    prior = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
                    suffix = hashes[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), *[pa.array(x.view(np.int64)) for x in (gram, prior, suffix)], pa.array(cnt)], ["lang", "n", "gram", "prior", "suffix", "cnt"])

    each = docs.select("lang", "text").mapInArrow(run, "lang string, n int, gram long, prior long, suffix long, cnt long")
    return each.groupBy("lang", "n", "gram").agg(F.first("prior").alias("prior"), F.first("suffix").alias("suffix"), F.sum("cnt").alias("cnt"))


def groups(names, size: int = SHARD) -> list[list]:
    """The names in order, ``size`` at a time."""
    known = sorted(names)
    return [known[i : i + size] for i in range(0, len(known), size)]


class Shard:
    """Of some languages, per order: sorted hashes of their n-grams, and the log2 probability of each under each language.

    Probabilities are interpolated Kneser-Ney, worked out in full for the n-grams held, which are all that were counted; for
    others the next shorter n-gram's, times the weight that the context leaves to it (a sorted hash array of contexts). A
    context that a language never had leaves all to the shorter one, so each language's probabilities sum to one."""

    def __init__(self, langs, grams, logs, contexts, backoffs, floor):
        self.langs, self.grams, self.logs, self.contexts, self.backoffs, self.floor = langs, grams, logs, contexts, backoffs, floor

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> "Shard":
        """From (lang, n, gram, prior, suffix, cnt). Counts stay sparse, and one language is worked out at a time over the
        n-grams of all."""
        langs = sorted(counts["lang"].unique())
        order, L = int(counts["n"].max()), len(langs)
        of_lang = counts["lang"].map({g: i for i, g in enumerate(langs)}).to_numpy()
        of_n, columns = counts["n"].to_numpy(), {c: counts[c].to_numpy(np.int64) for c in ("gram", "prior", "suffix", "cnt")}
        grams, contexts, place, below, own = ({} for _ in range(5))
        for n in range(1, order + 1):
            at = np.flatnonzero(of_n == n)
            grams[n], row = np.unique(columns["gram"][at].view(np.uint64), return_inverse=True)
            prior, suffix = np.zeros(len(grams[n]), np.uint64), np.zeros(len(grams[n]), np.uint64)
            prior[row], suffix[row] = columns["prior"][at].view(np.uint64), columns["suffix"][at].view(np.uint64)
            contexts[n], place[n] = np.unique(prior, return_inverse=True)
            if n > 1:  # the row of the next shorter n-gram, -1 where a text's begin has none
                found = np.minimum(np.searchsorted(grams[n - 1], suffix), len(grams[n - 1]) - 1)
                below[n] = np.where(grams[n - 1][found] == suffix, found, -1)
            cnt = columns["cnt"][at]
            own[n] = [(row[mine], cnt[mine]) for mine in (np.flatnonzero(of_lang[at] == i) for i in range(L))]
        logs = [np.empty((len(grams[n]), L), np.float32) for n in range(1, order + 1)]
        backoffs = [np.empty((len(contexts[n]), L), np.float32) for n in range(1, order + 1)]
        floor = 1.0 / ALPHABET
        for i in range(L):
            lower = None
            for n in range(1, order + 1):
                rows, value = own[n][i]
                if n < order:  # below the top order, counts are of distinct characters before; 1 at a text's begin
                    longer = below[n + 1][own[n + 1][i][0]]
                    value = np.maximum(np.bincount(longer[longer >= 0], minlength=len(grams[n]))[rows], 1)
                ones, twos = (value == 1).sum(), (value == 2).sum()
                discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
                total = np.bincount(place[n][rows], weights=value, minlength=len(contexts[n]))
                kinds = np.bincount(place[n][rows], minlength=len(contexts[n]))
                gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                shorter = floor if n == 1 else np.where(below[n] >= 0, lower[below[n]], floor)
                p = gamma[place[n]] * shorter
                p[rows] += np.maximum(value - discount, 0) / total[place[n][rows]]
                logs[n - 1][:, i], backoffs[n - 1][:, i] = np.log2(p), np.log2(gamma)
                lower = p
        each = lambda of: [of[n] for n in range(1, order + 1)]
        return cls(langs, each(grams), logs, each(contexts), backoffs, np.full(L, np.log2(floor), np.float32))

    def values(self, hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """log2 of each character's probability, by language; the first of a text is context only."""
        value = np.zeros((len(place), len(self.langs)), np.float32)
        todo = np.flatnonzero(place > 0)
        for n in range(len(self.grams), 0, -1):
            near = place[todo] < n - 1  # too near the begin for an n-gram: go on with a shorter one
            now, later = todo[~near], todo[near]
            key = hashes[n - 1][now]
            table = self.grams[n - 1]
            at = np.minimum(np.searchsorted(table, key), len(table) - 1)
            hit = table[at] == key
            value[now[hit]] += self.logs[n - 1][at[hit]]
            miss = now[~hit]
            if n > 1:
                context, key = self.contexts[n - 1], hashes[n - 2][miss - 1]
            else:
                context, key = self.contexts[0], np.zeros(len(miss), np.uint64)
            at = np.minimum(np.searchsorted(context, key), len(context) - 1)
            seen = context[at] == key
            value[miss[seen]] += self.backoffs[n - 1][at[seen]]
            if n == 1:
                value[miss] += self.floor
            todo = np.concatenate([miss, later])
        return value


class Model:
    """The shards of all languages, and what calibration tells of them."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards
        self.langs = [g for s in shards for g in s.langs]
        self.slope, self.offset, self.reject_above = 1.0, 0.0, np.full(len(self.langs), np.inf)

    @classmethod
    def fit(cls, counts: pd.DataFrame, size: int = SHARD) -> "Model":
        """From (lang, n, gram, prior, suffix, cnt), languages by name, ``size`` to a shard."""
        return cls([Shard.fit(counts[counts["lang"].isin(some)]) for some in groups(counts["lang"].unique(), size)])

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in bits a character, by text and language; characters scored by text)."""
        codes, lengths = letters(texts)
        out, scored = np.zeros((len(texts), len(self.langs))), np.maximum(lengths - 1, 0)
        if not len(codes):
            return out, scored
        full = lengths > 0
        owner, starts = ragged(lengths[full])
        place = np.arange(len(codes)) - starts[owner]
        hashes = gram_hashes(codes, max(len(s.grams) for s in self.shards))
        # float64 sums, text by text
        sums = np.hstack([np.add.reduceat(s.values(hashes, place), starts[:-1], axis=0, dtype=np.float64) for s in self.shards])
        out[full] = -sums / np.maximum(scored[full], 1)[:, None]
        return out, scored

    def _evidence(self, ent: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Margin between the two best languages, in bits a character, times the root of the length."""
        if len(self.langs) < 2:
            return np.sqrt(scored)
        two = np.partition(ent, 1, axis=1)
        return (two[:, 1] - two[:, 0]) * np.sqrt(scored)

    def calibrate(self, texts: list[str | None], langs: list[str], quantile: float = 0.995) -> None:
        """Fits, on documents of known language and on short pieces of them, the logistic curve of being right over the
        evidence; and for each language the cross-entropy above which it is rejected: its documents' mean, times what all
        but 1 - quantile of all languages' documents stay below relative to their mean, and a quarter more. A language
        without a document here has the mean of the others."""
        ent, scored = self.entropies(texts)
        truth, relative = np.array(langs, object), []
        means = np.full(len(self.langs), np.nan)
        for i, g in enumerate(self.langs):
            own = ent[(scored > 0) & (truth == g), i]
            if len(own):
                means[i] = own.mean()
                relative.append(own / means[i])
        if relative:
            means[np.isnan(means)] = np.nanmean(means)
            self.reject_above = means * np.quantile(np.concatenate(relative), quantile) * 1.25
        if len(self.langs) < 2:
            return
        pieces, truth = list(texts), list(langs)
        for t, g in zip(texts, langs):
            words = (t or "").split()
            for n in (1, 2, 4, 8):
                pieces.append(" ".join(words[n : 2 * n]))
                truth.append(g)
        ent, scored = self.entropies(pieces)
        ok = scored > 0
        if not ok.any():
            return
        x = self._evidence(ent[ok], scored[ok])
        right = np.array([self.langs[i] == g for i, g in zip(ent[ok].argmin(axis=1), np.array(truth, object)[ok])], float)
        target = np.where(right > 0, (right.sum() + 1) / (right.sum() + 2), 1 / ((1 - right).sum() + 2))  # Platt's targets
        a, b = 0.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p)
            g = np.array([(x * (p - target)).sum() + RIDGE * a, (p - target).sum() + RIDGE * b])
            h = np.array([[(x * x * w).sum() + RIDGE, (x * w).sum()], [(x * w).sum(), w.sum() + RIDGE]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(max(a, 0.0)), float(b)

    def predict(self, texts: list[str | None], reject: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, whether the calibrated threshold rejects it); with reject, rejected texts are undetermined."""
        ent, scored = self.entropies(texts)
        best = ent.argmin(axis=1)
        low = ent[np.arange(len(ent)), best]
        score = np.where(scored > 0, 1 / (1 + np.exp(-np.clip(self.slope * self._evidence(ent, scored) + self.offset, -30, 30))), 0.0)
        rejected = (scored == 0) | (low > self.reject_above[best])
        out = rejected if reject else scored == 0
        return [UNDETERMINED if o else self.langs[b] for o, b in zip(out, best)], score, rejected


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, size: int = SHARD) -> Model | None:
    """A model of each language of labelled, from about sample_docs documents of each; None without labelled rows.

    Every language with a letter in its texts is in the model: its document of the lowest hash is never kept for the
    calibration; and every n-gram of the sample is. The counts are made on the executors and written; the driver takes those
    of ``size`` languages at a time. The model grows with the number of languages, by what a language's sample has."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("text").rlike(r"\p{L}"), draw)).alias("least"))
    sizes = materialize(sizes.where("least is not null"), "languages")
    if sizes.isEmpty():
        return None
    rows = rows.join(sizes, "lang").withColumn("draw", draw)
    sample = rows.where((F.col("draw") < F.lit(float(sample_docs)) / F.col("n")) | (F.col("draw") == F.col("least")))
    # A fifth of the sample is for the calibration only.
    fifth = (F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(5)) == 0) & (F.col("draw") != F.col("least"))
    counts = materialize(count_grams(sample.where(~fifth), order), "grams")
    known = [r.lang for r in counts.select("lang").distinct().collect()]  # a row a language
    if not known:
        return None
    model = Model([Shard.fit(counts.where(F.col("lang").isin(some)).toArrow().to_pandas()) for some in groups(known, size)])
    held = sample.where(fifth).select("text", "lang").toArrow().to_pandas()
    if len(held):
        model.calibrate(held["text"].tolist(), held["lang"].tolist())
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject: bool = False, carry: list | None = None) -> DataFrame:
    """(id, *carry, lang_pred, score, rejected) for each row: the language of lowest cross-entropy a character, the
    calibrated share of such decisions that are right, and whether the cross-entropy is above what nearly all documents of
    that language stay below.

    ``und`` with score 0 and rejected for null, and for text without a letter; with reject, ``und`` for all that is rejected. Ties go to the language first by name. Rows that repeat an
    id are scored one by one. Without a model all rows are ``und``."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample and the number of languages
    keep = [F.col(id_col).alias("_id"), *(carry or [])]
    names = docs.select(*keep).columns

    def run(batches):
        one = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            pred, score, out = one.predict(texts, reject) if one is not None and texts else ([UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(out)], [*names, "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def cross_validated(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learnt from the documents whose crc32(doc_id as text) is not ``held`` modulo ``mod``."""
    fold = crc_mod("doc_id", mod) == held
    model = train(docs.where(~fold))
    return identify(docs, model, carry=[fold.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score", "rejected")
