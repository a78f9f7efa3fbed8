import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import bpe, queries
from tests.llm.common import TEXTS, documents, save

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == ORACLE.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "0", "12", "ing", "the", "ß", "漢", "🙂", ".", "...", "th", "er", "E", "'s", "<|endoftext|>"])).map("".join))
def test_pieces(text):
    assert CODEC.encode(text) == ORACLE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "thethe" * 5000, " " * 20_000, "é" * 20_000, "-" * 30_000, "abcdefgh" * 8000])
def test_long_pieces(text):
    assert CODEC.encode(text) == ORACLE.encode_ordinary(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = "one two three one four five six one two"
    assert small.encode(text) == ORACLE.encode_ordinary(text) and len(small.pieces) <= 3 and len(small.before) <= 3


def test_lean_memo(monkeypatch):
    """A piece is memoised when it comes again; the ids are those of the other memo, also when it was full."""
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, lean=True)
    codec.encode("qzxone qzxtwo qzxone")
    assert codec.pieces.keys() <= {" qzxone", "qzxone", " qzxtwo"} and len(codec.pieces) < 3
    codec.encode("qzxone qzxtwo qzxone")
    assert {" qzxone", "qzxone", " qzxtwo"} == codec.pieces.keys()
    monkeypatch.setattr(bpe, "LEAN", 3)
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN, lean=True)
    for text in [*(t or "" for t in TEXTS), "one two three one four five six one two " * 5]:
        assert small.encode(text) == small.encode(text) == ORACLE.encode_ordinary(text)
    assert len(small.pieces) <= 3 and len(small.before) <= 3


def test_other_vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec, oracle = bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("Größe über alles", "le café était", "漢字かな交じり文", "hello  world"):
        assert codec.encode(text) == oracle.encode_ordinary(text)


def test_column(spark):
    rows = bpe.encode(documents(spark), decoded="decoded").collect()
    assert len(rows) == len(TEXTS) + 1 and {"doc_id", "score", "ids", "decoded"} <= set(rows[0].asDict())
    for r in rows:
        assert r.ids == ORACLE.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    lean = {r.doc_id: r.ids for r in bpe.encode(documents(spark), lean=True).collect()}
    assert lean == {r.doc_id: r.ids for r in rows}
    assert bpe.encode(documents(spark).limit(0)).count() == 0


def test_query(spark, tmp_path):
    folder = save(documents(spark), tmp_path)
    for r in queries.op3_byte_bpe(spark, folder).collect():
        ids = ORACLE.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
