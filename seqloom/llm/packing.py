"""Order-preserving packing of token sequences by dynamic programming over cut positions."""

from __future__ import annotations

import json
import re
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, tune

WINDOW = 1024
#: Cost of ending a window after a document, a sentence, a clause, and anywhere else, in padded tokens.
PENALTY = (0.0, 2.0, 3.0, 5.0)
#: Where nothing ends for so many tokens, windows may end at each multiple of it.
STRIDE = 32
#: Cost of a window by itself, the shortest power of two that is tried as a length, and the cost of each token that such a
#: window falls short of a full one by: it is not padded, but takes a sequence as a full one does.
EACH, SHORTEST, UNDERFILL = 8.0, 64, 0.25
#: Tokens that one dynamic program sees; the last window of a block is carried over to the next block.
BLOCK = 1 << 19
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
_loaded: dict[str, tuple] = {}


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple:
    """(encode, vocabulary) for a byte-level BPE file of the tokenizers library.

    encode(text) gives the ids that the library gives with add_special_tokens=False. The merges run in tiktoken, from
    the file's own vocabulary, as that takes a fifth of the time; the library itself takes what tiktoken can't."""
    if path in _loaded:
        return _loaded[path]
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {x["content"]: x["id"] for x in made.get("added_tokens", [])}
    chars = byte_of_char()
    ranks = {bytes(chars[c] for c in w): i for w, i in made["model"]["vocab"].items() if w not in special}
    # The pattern of the library's byte-level splitter.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("seqloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)
    find = re.compile("|".join(map(re.escape, special))) if special else None
    allowed = set(special)

    def encode(text: str):
        try:
            if find is not None and find.search(text):
                return fast.encode(text, allowed_special=allowed)
            return fast.encode_ordinary(text)
        except BaseException as error:  # the Rust side raises PanicException
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    _loaded[path] = encode, {i: w for w, i in ranks.items()}
    return _loaded[path]


def end_penalties(vocabulary: dict[int, bytes]) -> np.ndarray:
    """For each id, the cost of a cut after it: of a sentence for bytes that end in . ! ? or hold a line end, of a clause
    for those that end in , ; or :, else infinite."""
    out = np.full(max(vocabulary, default=0) + 2, np.inf)
    for i, w in vocabulary.items():
        tail = w.rstrip(b"\"')")[-1:]
        if tail in (b".", b"!", b"?") or b"\n" in w:
            out[i] = PENALTY[1]
        elif tail in (b",", b";", b":"):
            out[i] = PENALTY[2]
    return out


def cuts(total: int, at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of windows that cover 0..total. at: rising positions in (0, total], the last is total; penalty: the cost of a cut there.

    Minimises the sum of padding (window less length; UNDERFILL of it where the length is a power of two), penalties and EACH.
    cost(j) = penalty(j) + window - j + min over i in [j - window, j) of cost(i) + i: the minimum of a sliding window,
    kept by a queue of rising values; lengths of a power of two are looked up one by one. Where two positions are more
    than STRIDE apart, cuts at its multiples are put in between, at the dearest penalty."""
    step = min(STRIDE, window)
    gaps = np.diff(at, prepend=0)
    wide = gaps > step
    if wide.any():
        _, starts = ragged(counts := (gaps[wide] - 1) // step)
        more = np.repeat(at[wide] - gaps[wide], counts) + step * (1 + np.arange(starts[-1]) - np.repeat(starts[:-1], counts))
        at = np.concatenate([at, more])
        penalty = np.concatenate([penalty, np.full(len(more), PENALTY[3])])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    places, costs = [0, *at.tolist()], (penalty + EACH).tolist()
    best, back = [0.0], [0]
    index = {0: 0}
    queue: deque = deque([(0.0, 0, 0)])  # cost(i) + i, i, its number
    powers = [1 << k for k in range(window.bit_length()) if SHORTEST <= 1 << k < window]
    short = {p: UNDERFILL * (window - p) for p in powers}
    for k in range(1, len(places)):
        j = places[k]
        low = j - window
        while queue[0][1] < low:
            queue.popleft()
        value, _, frm = queue[0]
        value += window - j
        for p in powers:
            i = index.get(j - p)
            if i is not None and best[i] + short[p] < value:
                value, frm = best[i] + short[p], i
        value += costs[k - 1]
        best.append(value)
        back.append(frm)
        index[j] = k
        key = value + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, k))
    out, k = [], len(places) - 1
    while k:
        out.append(places[k])
        k = back[k]
    return out[::-1]


class _Packer:
    """Packs the documents of one task, block by block."""

    def __init__(self, ends: np.ndarray, task: int, window: int):
        self.ends, self.window = ends, window
        self.next_id = task << 32
        self.docs: list[tuple] = []  # (doc_id or None, start, ids, tokens of the whole document)
        self.total = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.total += len(ids)

    def flush(self, last: bool) -> pd.DataFrame | None:
        if not self.docs:
            return None
        ids = np.concatenate([d[2] for d in self.docs])
        bounds = np.cumsum([len(d[2]) for d in self.docs])
        penalty = self.ends[np.minimum(ids, len(self.ends) - 1)]
        penalty[bounds - 1] = PENALTY[0]
        at = np.flatnonzero(np.isfinite(penalty))
        found = cuts(len(ids), at + 1, penalty[at], self.window)
        if not last and len(found) > 1:
            found.pop()
        end = found[-1]
        raw = ids[:end].astype("<u4").tobytes()
        # Pieces lie between neighbouring ends of documents and of windows.
        edges = np.unique(np.concatenate([found, bounds[bounds < end]]))
        lo = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(bounds, lo, side="right")
        firsts = np.concatenate([[0], bounds[:-1]])
        seq = np.searchsorted(np.array(found), lo, side="right")
        begin = np.concatenate([[0], found[:-1]])[seq]
        out = pd.DataFrame({
            "doc_id": pd.array([self.docs[d][0] for d in doc], "Int64"),
            "start": lo - firsts[doc] + np.array([d[1] for d in self.docs], np.int64)[doc],
            "length": edges - lo,
            "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), edges.tolist())], np.int64),
            "doc_tokens": np.array([d[3] for d in self.docs], np.int64)[doc],
            "sequence_id": self.next_id + seq,
            "offset": lo - begin,
        })
        self.next_id += len(found)
        left = []
        for d, (b, size) in zip(self.docs, zip(bounds.tolist(), (len(d[2]) for d in self.docs))):
            if b > end:
                skip = max(0, size - (b - end))
                left.append((d[0], d[1] + skip, d[2][skip:], d[3]))
        self.docs, self.total = left, int(len(ids) - end)
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens; a row a piece.

    A document is its ids and then ``end_id``; null text is empty, so it is that one id. The documents of an input
    partition keep their order; each partition is packed by itself, without a shuffle, with the task's number in the
    high half of sequence_id. Every id lies in exactly one piece. Very long documents are cut at sentences like others.
    Rows that repeat an id are packed once each. A null id stays null. An empty table gives no rows."""
    tune(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encode, vocabulary = load(tokenizer)
        packer = _Packer(end_penalties(vocabulary), TaskContext.get().partitionId(), window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, np.array([*encode(text), end_id], np.int64))
                if packer.total >= block:
                    yield pa.RecordBatch.from_pandas(packer.flush(False), SCHEMA, preserve_index=False)
        if (rest := packer.flush(True)) is not None:
            yield pa.RecordBatch.from_pandas(rest, SCHEMA, preserve_index=False)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE)
