import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE.from_file(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoder(coder):
    return coder.worker()


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


TEXTS = ["", " ", "  a  b\n\n c", "\n\n a\x00b", "x" * 5000, "<|endoftext|>  é😀 " * 50, "▁ ▁▁a", "ab " * 300_000, "a b\tc  d e", "it's we'll  'S", "Āǿ" * 9, " lead", "trail ", "12 345\n67"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_bytes(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and encoder.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sab1é!")), max_size=60))
def test_random_texts(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_memory_is_bounded_and_harmless(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMORY", 20)
    monkeypatch.setattr(bpe, "_RUN", 5)
    monkeypatch.setattr(bpe, "_CHARS_AT_ONCE", 900)
    e = coder.worker()
    text = " ".join(f"word{i} x" for i in range(300)) + "  end"
    assert e.encode(text) == reference.encode_ordinary(text) and e.encode(text[:-5]) == reference.encode_ordinary(text[:-5])
    assert len(e.words) <= 600


def test_memory_cleared_inside_a_batch(coder, reference, monkeypatch):
    """Texts encoded as a whole fill the memory before the heads of later texts of their group are used."""
    monkeypatch.setattr(bpe, "_MEMORY", 20)
    texts = [t for i in range(30) for t in (f"head{i} of a text", f"double  blanks{i} " + " ".join(f"d{i}x{k}" for k in range(12)))]
    assert list(coder.worker().ids(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_tables(spark, coder, reference):
    rows = [(1, "hello world", "z"), (2, None, "z"), (2, None, "z"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.round_trip(df, coder).collect()
    want = reference.encode_ordinary("hello world")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in got) == [(0, 0, empty), (1, len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()), (2, 0, empty), (2, 0, empty)]
    coded = bpe.encode(df, coder)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, coder).collect()} == {1: b"hello world", 2: b"", None: b""}
    assert bpe.round_trip(df.limit(0), coder).count() == 0
    assert {r.exact for r in bpe.tokenised(df, coder).collect()} == {True}


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bpe.ByteBPE({b"a": 0}, "a")
