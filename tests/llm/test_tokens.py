import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import registry, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda text: len(made.encode(text or "", add_special_tokens=False).ids)


ODD = ["", "   ", "It's 2024, isn't it?", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endof text|>", "x" * 70, ("y" * 200 + " ") * 3, "ÉTÉ é ́x  ñ", "İstanbul ΣΟΦΟΣ Ångström ẞ", "\U0001f600\U0001f468‍\U0001f469", "한국어 日本語 ไทย", "a b c\x85d\x1ce\x0bf", "  x", "'S 'll 'LL 're", "1234567890", "\x00\x01 ﻿"]


def test_odd_texts_equal_the_library(spark, make_docs, library):
    texts = [*ODD, None, *ODD[2:5]]
    got = {r.doc_id: r for r in tokens.token_counts(make_docs(texts), PATH, limit=3, head=5).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = library(t)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 3), t


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_words_and_pieces_add_up(text):
    pre, pieces = _split()
    assert sum(pieces(p) for w in text.encode().split() for p in pre(w.decode())) == len(_library().encode(text, add_special_tokens=False).ids)


_made: dict = {}


def _split():
    return _made.setdefault("s", tokens.splitter(PATH))


def _library():
    return _made.setdefault("l", Tokenizer.from_file(PATH))


def test_the_quick_splitter_is_the_library_s():
    """Every letter, digit and sign that it takes, and all pairs with some others."""
    from seqloom.llm.packing import byte_of_char

    made = _library()
    shown = {b: c for c, b in byte_of_char().items()}
    assert tokens._plain_steps(PATH) and not tokens._plain_steps(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(tokens._LATIN) > 450 and not tokens.SIMPLE.fullmatch("\u0130") and not tokens.SIMPLE.fullmatch("\xa0")
    others = "aZ'9-\u00e9\u00bd\u00df\u01c5s"
    for c in tokens._LATIN:
        for o in others:
            for word in (c, c + o, o + c, "'" + c + o, o + c + o):
                want = [p for p, _ in made.pre_tokenizer.pre_tokenize_str(made.normalizer.normalize_str(word))]
                assert [p.encode().decode("latin-1").translate(shown) for p in tokens.SPLIT.findall(word.lower())] == want, word


def test_whole_query_equals_the_library(spark, library):
    got = registry.op11_pretoken_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = library(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_head_and_rest_agree(spark, make_docs, library, head):
    texts = [f"the word {i} is w{i % 7}x and " + "z" * (60 + i) for i in range(50)]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(make_docs(texts), PATH, head=head).collect()}
    assert got == {i: library(t) for i, t in enumerate(texts)}


def test_rows_of_odd_tables(spark, odd_docs, library):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in tokens.token_counts(odd_docs.withColumn("n", F.lit(1)).withColumn("row", F.lit("r")), PATH).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), library(r.text)) for r in odd_docs.collect())
    assert got == want
    assert tokens.token_counts(odd_docs.limit(0), PATH).collect() == []


def test_each_pre_token_is_counted_once(spark, make_docs):
    v = tokens.vocabulary(make_docs(["The the THE cat", "the cat " + "q" * 100, None]), PATH).collect()
    assert len({r.key for r in v}) == len(v) == 3
    assert {r.key: r.n for r in v if len(r.key) < 65} == {"the": 4, "cat": 2}


def test_long_document(spark, make_docs, library):
    text = " ".join(f"word{i % 5000} Straße" for i in range(60_000)) + "v" * 20_000
    assert tokens.token_counts(make_docs([text]), PATH).first().n_tokens == library(text)
