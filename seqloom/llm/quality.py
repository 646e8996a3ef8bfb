"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, ragged, texts_of, tune

#: Hashed terms, latent dimensions, labelled documents that vote at most, neighbours, power of the similarity.
TERMS, LATENT, LABELLED, NEIGHBOURS, POWER = 4096, 64, 3000, 9, 20.0
#: Kinds of terms and their shares of a document's vector: the word, its shape, its length, how often the document
#: repeats it, whether it stands right after itself, and whether the document has words at all.
KINDS = (("word", 0.2), ("shape", 0.3), ("length", 0.1), ("repeat", 0.2), ("run", 0.2))
#: Documents whose cosines with all labelled vectors are held at once.
BLOCK = 512
#: Labelled documents whose terms the driver works out at once.
FIT_DOCS = 100
SEED = 271828
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_AS_CLASS = bytes(_CLASS[i] or i for i in range(256))


def shape(word: bytes) -> bytes:
    """Runs of letters, capitals and digits as one sign each; other characters as they are, at most two of a run."""
    out = bytearray()
    run = 0
    for c in word.translate(_AS_CLASS):
        run = run + 1 if out and out[-1] == c else 0
        if run == 0 or (run == 1 and c not in b"aA0"):
            out.append(c)
    return bytes(out)


def length(word: bytes) -> bytes:
    """Bytes of a word, in steps of a quarter of a doubling from 16 on."""
    n = len(word)
    return b"%d" % (n if n < 16 else 16 + int(4 * np.log2(n / 16)))


class Terms:
    """Documents to sparse rows of hashed terms; what is known of a word is remembered up to a bound."""

    def __init__(self, idf: np.ndarray | None = None, most: int = 300_000):
        import xxhash

        self.idf = np.ones(TERMS) if idf is None else idf

        self.hash, self.most = xxhash.xxh3_64_intdigest, most
        self.known: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int]] = []

    def _term(self, kind: int, what: bytes) -> int:
        return self.hash(bytes([kind]) + what) % TERMS

    def _learn(self, word: bytes) -> int:
        self.known[word] = at = len(self.rows)
        self.rows.append((self._term(0, word), self._term(1, shape(word)), self._term(2, length(word))))
        return at

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, weights, bounds of the documents); each kind's weights have its share as their norm."""
        if len(self.known) > self.most:
            self.known.clear()
            self.rows.clear()
        known, learn = self.known, self._learn
        ids, lengths = [], []
        for t in texts:
            words = t.split()
            lengths.append(len(words))
            ids += [known[w] if w in known else learn(w) for w in words]
        owner, _ = ragged(np.array(lengths, np.int64))
        at = (owner << 32) | np.array(ids, np.int64)
        blank = np.flatnonzero(np.array(lengths, np.int64) == 0)
        same = at[1:][at[1:] == at[:-1]] >> 32  # documents of words that stand right after themselves
        key, counts = np.unique(at, return_counts=True)
        doc, word = key >> 32, key & 0xFFFFFFFF
        table = np.array(self.rows, np.int64).reshape(-1, 3)
        repeats = np.array([self._term(3, b"%d" % i) for i in range(40)], np.int64)
        level = np.log2(counts).astype(np.int64)
        kinds = [table[word, 0], table[word, 1], table[word, 2], repeats[level]]
        # (document, kind, term), summed
        K = len(KINDS)
        full = np.concatenate([*(((doc * K + k) << 16) | kinds[k] for k in range(4)), ((same * K + 4) << 16) | self._term(4, b"same"), ((owner * K + 4) << 16) | self._term(4, b"all"), ((blank * K + 4) << 16) | self._term(4, b"none")])
        cells, inverse = np.unique(full, return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([np.tile(counts, 4), np.full(len(same), 2.0), np.ones(len(owner) + len(blank))]))
        group = cells >> 16
        share = np.sqrt(np.array([w for _, w in KINDS]))[group % K]
        # Words dampen by logarithm; what describes the style counts in proportion, by square root.
        weight = np.where(group % K == 0, np.log1p(sums), np.where(group % K == 4, sums, np.sqrt(sums)))
        weight *= np.where(group % K == 4, 1.0, self.idf[cells & 0xFFFF])
        norm = np.maximum(np.sqrt(np.bincount(group, weights=weight**2, minlength=K * len(texts))), 1e-9)
        bounds = np.searchsorted(group // K, np.arange(len(texts) + 1))
        return (cells & 0xFFFF).astype(np.int64), (share * weight / norm[group]).astype(np.float32), bounds


def project(terms, weights, bounds, basis: np.ndarray) -> np.ndarray:
    """Rows of latent coordinates of norm 1 (or 0)."""
    out = np.zeros((len(bounds) - 1, basis.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(basis[terms] * weights[:, None], bounds[:-1][full], axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


class Model:
    def __init__(self, idf, basis, vectors, labels, prior, neighbours=NEIGHBOURS, power=POWER):
        self.idf, self.basis, self.vectors, self.labels, self.prior, self.neighbours, self.power = idf, basis, vectors, labels, prior, neighbours, power

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray, latent: int = LATENT, prior: float | None = None) -> "Model":
        """Inverse document frequencies, then a truncated decomposition of the sample's term matrix by random projection
        with two power iterations."""
        n = len(texts)
        parts = [texts[i : i + FIT_DOCS] for i in range(0, n, FIT_DOCS)]  # a few at a time, for the driver's memory
        plain = Terms(most=20_000)
        frequency = sum(np.bincount(plain(p)[0], minlength=TERMS) for p in parts)
        del plain
        idf = np.log((2 + n) / (1 + frequency))
        weighted = Terms(idf, most=20_000)
        rows = [weighted(p) for p in parts]
        del weighted
        dense = np.zeros((n, TERMS), np.float32)
        for i, (terms, weights, bounds) in enumerate(rows):
            dense[i * FIT_DOCS + ragged(np.diff(bounds))[0], terms] = weights
        k = min(latent + 16, n)
        q = dense @ np.random.default_rng(SEED).standard_normal((TERMS, k), dtype=np.float32)
        for _ in range(2):
            q = np.linalg.qr(q)[0]
            q = np.linalg.qr(dense.T @ q)[0]
            q = dense @ q
        q = np.linalg.qr(q)[0]
        _, s, vt = np.linalg.svd(q.T @ dense, full_matrices=False)
        basis = np.ascontiguousarray(vt[:latent].T)
        return cls(idf, basis, np.concatenate([project(*r, basis) for r in rows]), labels.astype(np.float32), float(labels.mean()) if prior is None else prior)

    def score(self, texts: list[bytes], terms: Terms) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by a power of its cosine. The share of label 1
        among all labels, as they are before the sample evens them out, counts as one more neighbour of weight 0.01. A text
        without words is near labelled ones without words; where there are none, that share alone decides."""
        vectors = project(*terms(texts), self.basis)
        out = np.empty(len(texts))
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            cosine = vectors[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** self.power
            out[a : a + BLOCK] = ((weight * self.labels[near]).sum(axis=1) + 0.01 * self.prior) / (weight.sum(axis=1) + 0.01)
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model | None:
    """A model from about ``labelled`` labelled documents, as many of each label as far as they go; None without any.

    A hash of the id picks the sample; only the sample goes to the driver. An id with several labels has the larger."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    marks = marks.withColumn("_draw", F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sizes = {r["_label"]: r["count"] for r in marks.groupBy("_label").count().collect()}
    if not sizes:
        return None
    least = labelled // 4
    minor = min(sizes.values())
    quota = {g: min(n, labelled - min(least, minor) if n > minor or len(sizes) == 1 else max(least, 1)) for g, n in sizes.items()}
    pick = F.lit(False)
    for g, n in sizes.items():
        pick = pick | ((F.col("_label") == g) & (F.col("_draw") < quota[g] / n))
    # The pick is about as large as ``labelled`` says, whatever the input: it is broadcast, and the texts stay in place.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(marks.where(pick)), "_id").select("_text", "_label", "_draw", "_id").toArrow().sort_by([("_draw", "ascending"), ("_id", "ascending"), ("_text", "ascending")])
    if not rows.num_rows:
        return None
    return Model.fit(texts_of(rows.column("_text")), rows.column("_label").to_numpy(), prior=sizes.get(1, 0) / sum(sizes.values()))


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, carry: list | None = None) -> DataFrame:
    """(id, *carry, score, predicted) for each row; predicted is 1 if the score is at least ``least``.

    Null text is empty; a text without words goes with labelled ones without words, or else has the share of label 1 among
    all labels. Rows that repeat an id are scored one by one. Without a model every score is 0.5."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by TERMS, LATENT and LABELLED
    keep = [F.col(id_col).alias("_id"), *(carry or [])]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]

    def run(batches):
        one = shared.value
        terms = Terms(one.idf if one is not None else None)
        for b in batches:
            texts = texts_of(b.column(b.num_columns - 1))
            score = one.score(texts, terms) if one is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= least).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def cross_validated(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labels of documents whose crc32(doc_id as text) is not ``held`` modulo ``mod``."""
    fold = crc_mod("doc_id", mod) == held
    model = train(docs, labels.where(~fold))
    return classify(docs, model, carry=[fold.alias("held_out")]).select("doc_id", "held_out", "score", "predicted")
