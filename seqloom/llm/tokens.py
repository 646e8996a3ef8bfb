"""Token counts of documents: pieces once per distinct pre-token, joined to the pre-tokens' frequencies."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, numbered, tune
from .packing import byte_of_char

#: Documents of more tokens are over the limit.
LIMIT = 2048
#: A longer pre-token goes by its SHA-256 where it is a key.
KEY_BYTES = 64
#: The most frequent pre-tokens, whose pieces go to every task: at most so many keys of at most KEY_BYTES + 1 characters.
#: All others meet theirs in a shuffle.
HEAD = 200_000
#: Words whose pre-tokens a task remembers, twice over (those met of late, and those before), and the longest that it does.
KNOWN_WORDS, KNOWN_BYTES = 200_000, 100
#: Rows of an Arrow batch that goes back to the JVM, but for one of a larger document.
OUT_ROWS = 50_000

# Latin letters, digits and signs below U+0250 that are composed already and whose small letter is one of them: no blanks, no
# controls, no marks to combine. Of words of these alone, the splitter below gives what the library's gives, in less time.
_LATIN = [c for c in map(chr, range(0x21, 0x250)) if unicodedata.category(c)[0] in "LNPS" and len(c.lower()) == 1 and c.lower() < "\u0250" and unicodedata.is_normalized("NFC", c)]
_class = lambda kind: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)
SIMPLE = re.compile(f"[{''.join(map(re.escape, _LATIN))}]+")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+")
#: The steps of a tokenizers file that SPLIT stands for.
STEPS = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _plain_steps(path: str) -> bool:
    """Whether the file's normaliser and splitter are those of STEPS, then bytes as characters."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    try:
        split, level = made["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in made["normalizer"]["normalizers"]]
        blanks = made["normalizer"]["normalizers"][1]
        return (steps, split["pattern"]["Regex"]) == STEPS and (split["behavior"], split["invert"]) == ("Removed", True) and (blanks["pattern"]["Regex"], blanks["content"]) == (r"\s+", " ") and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
    except (KeyError, TypeError, ValueError, IndexError):
        return False


def splitter(path: str) -> tuple[Callable[[str], list[str]], Callable[[str], int]]:
    """(pre_tokens, pieces) for a file of the tokenizers library: the pre-tokens of a text without blanks, as the library's
    normaliser and splitter give them, and the tokens that its model makes of one.

    A special string inside a text is a pre-token of one token, as by the library's default. No other pre-token has the
    same letters, as the splitter parts signs from letters."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    special = {x.content for x in made.get_added_tokens_decoder().values()}
    find = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
    normal = made.normalizer.normalize_str if made.normalizer else lambda text: text
    split = made.pre_tokenizer.pre_tokenize_str if made.pre_tokenizer else lambda text: [(text, None)]
    model = made.model.tokenize
    simple = SIMPLE.fullmatch if _plain_steps(path) else lambda text: None
    shown = {b: c for c, b in byte_of_char().items()}

    def plain(text: str) -> list[str]:
        if not text:
            return []
        if simple(text):
            found = SPLIT.findall(text.lower())
            return found if text.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(shown) for p in found]
        return [p for p, _ in split(normal(text))]

    def pre_tokens(word: str) -> list[str]:
        if find is None or not find.search(word):
            return plain(word)
        out, at = [], 0
        for m in find.finditer(word):
            out += [*plain(word[at : m.start()]), m.group()]
            at = m.end()
        return out + plain(word[at:])

    return pre_tokens, lambda p: 1 if p in special else len(model(p))


class _Keys:
    """Frequencies of keys of words: a pre-token is its own key, or a digest where it is long; ``long`` has what digests mean,
    of the words since it was last emptied."""

    def __init__(self, path: str):
        self.pre_tokens, _ = splitter(path)
        # Where other steps may join what blanks part, a text is one word.
        self.plain = _plain_steps(path)
        self.cut = bytes.split if self.plain else lambda text: [text] if text else []
        self.known: dict[bytes, list[str]] = {}
        self.before: dict[bytes, list[str]] = {}
        self.long: dict[str, str] = {}

    def _keys(self, word: bytes) -> list[str]:
        if len(word) > KNOWN_BYTES:
            return [self._short(p) for p in self.pre_tokens(word.decode("utf-8", "replace"))]
        found = self.before.get(word)
        if found is None:
            found = self.pre_tokens(word.decode("utf-8", "replace"))
            # Normal forms are at most three times as long.
            if 4 * len(word) > KEY_BYTES and any(len(p) > KEY_BYTES for p in found):
                return [self._short(p) for p in found]
        if len(self.known) >= KNOWN_WORDS:
            self.known, self.before = {}, self.known
        self.known[word] = found
        return found

    def _short(self, p: str) -> str:
        if len(p) <= KEY_BYTES:
            return p
        key = "#" + sha256(p.encode()).hexdigest()
        self.long[key] = p
        return key

    def count(self, words: dict[bytes, int]) -> dict[str, int]:
        out: dict[str, int] = {}
        get, plain = out.get, self.plain
        for word, n in words.items():
            if plain and word.isalpha() and len(word) <= KEY_BYTES:  # ASCII letters alone are one pre-token
                k = word.lower().decode()
                out[k] = get(k, 0) + n
            else:
                for k in self.known.get(word) or self._keys(word):
                    out[k] = get(k, 0) + n
        return out


def frequencies(docs: DataFrame, tokenizer: str, row_col: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_bytes, key, n): a row a distinct pre-token of each document, and one a document with its id and its size
    and neither key nor n."""
    spark = docs.sparkSession
    own = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = _Keys(tokenizer)

        def made(batch, at, firsts, sizes, keys, ns):
            where = pa.array(at, pa.int64())
            # Only a document's first row has its id and size.
            ids, n_bytes = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
            ids[firsts], n_bytes[firsts] = np.asarray(at)[firsts], sizes
            other = ids < 0
            return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(pa.array(ids, pa.int64(), mask=other)), pa.array(n_bytes, mask=other), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], ["row", "id", "n_bytes", "key", "n"])

        for batch in batches:
            at, firsts, sizes, keys, ns = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = counts.count(Counter(counts.cut(text))) if text else {}
                firsts.append(len(keys))
                sizes.append(len(text))
                at += [i] * (len(found) + 1)
                keys += [None, *found]
                ns += [None, *found.values()]
                if len(keys) >= OUT_ROWS:
                    yield made(batch, at, firsts, sizes, keys, ns)
                    at, firsts, sizes, keys, ns = [], [], [], [], []
            if keys:
                yield made(batch, at, firsts, sizes, keys, ns)
            counts.long.clear()

    tune(spark)
    texts = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), texts.alias("text")).mapInArrow(run, f"row long, id {own}, n_bytes long, key string, n long")


def vocabulary(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(key, n, pieces): each distinct pre-token of the texts, how often it occurs, and the tokens that the model makes of
    it. Counts are combined a batch at a time and before the shuffle; the model sees each distinct pre-token once."""
    tune(docs.sparkSession)

    def run(batches):
        keys = _Keys(tokenizer)
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(keys.cut(text))
            found = keys.count(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([keys.long.get(k) for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "long", "n"])
            keys.long.clear()

    def count(batches):
        _, pieces = splitter(tokenizer)
        for b in batches:
            made = [pieces(k if p is None else p) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.int64())], ["key", "n", "pieces"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").cast("binary").alias("text"))
    distinct = texts.mapInArrow(run, "key string, long string, n long").groupBy("key", "long").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "key string, n long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row a document, its size in UTF-8 and the tokens that the tokenizers
    library makes of it, without added special tokens, truncation or padding.

    A text is cut at ASCII white space, where the file's steps make it a blank that no pre-token spans (else it's one word); its words' pre-tokens are counted, and their pieces come by a
    join: the ``head`` most frequent pre-tokens are broadcast, so none of the keys that are shuffled is in very many
    documents, and of a document only the pre-tokens outside the head are shuffled one by one. No ids are made.

    Null text is empty: 0 bytes, 0 tokens. Rows that repeat, null ids and ids with several texts give a row each. Very long
    words are pre-tokens like others. Other columns of docs take no part, whatever their names. An empty table gives no
    rows."""
    pieces = materialize(vocabulary(docs, tokenizer, text_col), "pieces")
    common = pieces.orderBy(F.desc("n"), "key").limit(head).select("key", "pieces")
    common = materialize(common, "common")
    rows = numbered(docs.select(id_col, text_col))
    found = frequencies(rows, tokenizer, ROW, id_col, text_col).join(F.broadcast(common), "key", "left")
    # What the head tells adds up before the shuffle to a row a document; the other pre-tokens stay rows of their own.
    tokens, rare = F.col("n") * F.col("pieces"), F.when(F.col("pieces").isNull(), F.col("key"))
    parts = found.groupBy("row", rare.alias("key")).agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"), F.sum("n").alias("n"))
    parts = materialize(parts, "parts")
    others = parts.where("key is not null").select("row", "key", "n").join(pieces.join(common.select("key"), "key", "left_anti").select("key", "pieces"), "key")
    others = others.select("row", F.lit(None).cast(parts.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("n_bytes"), tokens.alias("tokens"))
    whole = parts.where("key is null").select("row", "id", "n_bytes", "tokens").unionByName(others)
    out = whole.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
