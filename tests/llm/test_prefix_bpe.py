import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.prefix_bpe import EditableText, PrefixTable, Vocabulary, encode_documents, parse_ranks

FILE = P.path("byte_bpe_multi_50k.tiktoken")
with open(FILE, "rb") as f:
    RANKS = parse_ranks(f.read())
VOCAB = Vocabulary(RANKS, P.PATTERN)
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ids = lambda t: np.frombuffer(VOCAB.encode(t), "<u4").tolist()
texts = st.text(alphabet=st.one_of(st.sampled_from(list("ab'st 12\n\t\x1c\x85 .,é漢😀\r  ")), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_same_as_library(text):
    assert ids(text) == TRUTH.encode_ordinary(text)
    assert VOCAB.decode(VOCAB.encode(text)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(texts, texts, st.integers(0, 60), st.integers(0, 60))
def test_edits(text, new, a, b):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    e = EditableText(VOCAB, text).replace(a, b, new)
    assert np.frombuffer(e.ids(), "<u4").tolist() == TRUTH.encode_ordinary(text[:a] + new + text[b:])
    e.append(new)
    assert np.frombuffer(e.ids(), "<u4").tolist() == TRUTH.encode_ordinary(text[:a] + new + text[b:] + new)


def test_edit_is_local():
    e = EditableText(VOCAB, "word " * 5000).replace(12_000, 12_003, "xyz")
    assert e.encoded < 10


def test_append_keeps_every_prefix():
    table = PrefixTable(VOCAB, b"unbeliev").append(b"ably")
    for n in range(1, 13):
        assert table.tokens(n) == VOCAB.merged(b"unbelievably"[:n])
    assert table.truncate(5).append(b"x").tokens() == VOCAB.merged(b"unbelx")


def test_table(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (None, "", "z"), (3, "a" * 3000 + " b" * 30_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode_documents(df, FILE, P.PATTERN).collect()
    assert len(out) == 5
    for r, (_, t, _) in zip(out, rows, strict=True):
        want = np.array(TRUTH.encode_ordinary(t or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(df.limit(0), FILE, P.PATTERN).count() == 0


def test_unknown_byte():
    with pytest.raises(ValueError):
        PrefixTable(Vocabulary({b"a": 0}, P.PATTERN), b"ab")
