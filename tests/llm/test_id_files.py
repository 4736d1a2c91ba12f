import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import context_coder, id_files

FILE = P.path("byte_bpe_50k.json")
TRUTH = Tokenizer.from_file(FILE)
with open(FILE, "rb") as f:
    PIECES = id_files.PieceTokenizer(f.read())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300), st.lists(st.integers(0, 3), max_size=9000), st.integers(0, 2**31))
def test_exact_round_trip(a, b, big):
    for ids in (a, b, a + b, [big, *a]):
        x = np.array(ids, np.int64)
        assert context_coder.decode_frame(context_coder.encode_frame(x)).tolist() == ids


def test_learns_and_checks():
    x = np.tile(np.arange(50), 2000)
    coded = context_coder.encode_frame(x)
    assert len(coded) < 100_000 * 0.08
    broken = bytearray(coded)
    broken[len(coded) // 2] ^= 0x40
    with pytest.raises(ValueError, match="wrong checksum"):
        context_coder.decode_frame(bytes(broken))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab'st 12\n\t\x1c\x85 .,é漢😀 <|>")), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60), max_size=4))
def test_same_as_library(texts):
    truth = [TRUTH.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = PIECES.encode(texts)
    assert ids.tolist() == [i for t in truth for i in t] and sizes.tolist() == [len(t) for t in truth]


def test_added_tokens_and_strange_characters_are_the_library_s():
    texts = ["a<|endoftext|>b", "x  <|endoftext|> y <|endof text|>", "", " lead", "trail ", "\n\n x y", "a \u1cca b", "\u0558 x\u088f", "it's they'll  don't", "\u3000 x \u2003y"]
    truth = [TRUTH.encode(t, add_special_tokens=False).ids for t in texts]
    assert truth[0] == [64, 50256, 65]
    ids, sizes = PIECES.encode(texts)
    assert ids.tolist() == [i for t in truth for i in t] and sizes.tolist() == [len(t) for t in truth]


def test_settled_characters():
    """The pattern cuts texts of these characters as the library's pre-tokenizer does."""
    cut = TRUTH.pre_tokenizer.pre_tokenize_str
    for start in range(0, 0xD7A4, 0x100):
        part = [c for c in map(chr, range(start, start + 0x100)) if id_files._SETTLED.fullmatch(c)]
        text = "".join(f"a{c}1{c}!{c} {c}  x " for c in part)
        assert [text[a:b] for _, (a, b) in cut(text)] == PIECES.words(text)


def test_blocks_stand_alone_and_alphabets_are_any():
    for x in (np.arange(300_000), np.array([0, 2**32 - 1] * 5000), np.random.default_rng(3).integers(0, 2**32, 9000)):
        coded = context_coder.encode_frame(x)
        assert (context_coder.decode_frame(coded) == x).all()
        for k in (0, 2, len(x) // context_coder.BLOCK):
            assert (context_coder.decode_frame(coded, slice(k, k + 1)) == x[k * context_coder.BLOCK : (k + 1) * context_coder.BLOCK]).all()
    with pytest.raises(ValueError, match="unsigned"):
        context_coder.encode_frame(np.array([-1]))


def test_table(spark, tmp_path):
    texts = {5: "hello <|endoftext|> world", 1: None, 3: "word " * 30_000, 2: "", None: "a b c", 9: "x"}
    rows = [(k, t, 7) for k, t in texts.items()] + [(9, "x", 7), (9, "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    out = sorted(id_files.round_trip(df, FILE, path=str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    at = 0
    for r, (k, t) in zip(out, [(None, "a b c"), (1, ""), (2, ""), (3, texts[3]), (5, texts[5]), (9, "a"), (9, "x"), (9, "x")], strict=True):
        ids = np.array([*TRUTH.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert id_files.round_trip(df.limit(0), FILE, path=str(tmp_path / "none")).count() == 0


def test_blocks_are_smaller_than_zlib_s():
    share = 1 / (np.arange(4000) + 5.0)
    x = np.random.default_rng(5).choice(4000, 400_000, p=share / share.sum()) * 12
    coded = context_coder.encode_frame(x)
    assert (context_coder.decode_frame(coded) == x).all()
    assert len(coded) < len(zlib.compress(x.astype("<u2").tobytes()))


def test_a_block_alone_keeps_its_order():
    x = np.array([5, 1, 3] * 100)
    assert (context_coder.decode_frame(context_coder.encode_frame(x)) == x).all()


def test_words_of_a_batch_go_to_the_model_at_once(monkeypatch):
    """One call of the library for all new words, and the same ids when its model lacks a byte."""
    tok, calls = id_files.PieceTokenizer(PIECES.library.to_str().encode()), []

    class Counted:
        def encode_batch_fast(self, *args, **options):
            calls.append(args)
            return PIECES.lines.encode_batch_fast(*args, **options)

    monkeypatch.setattr(tok, "lines", Counted(), raising=False)
    texts = [f"{a}é{b}, it's {a * b}漢 'x\n\n{b}" for a in range(40) for b in range(40)]
    ids, sizes = tok.encode(texts)
    truth = [TRUTH.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1
    assert ids.tolist() == [i for t in truth for i in t] and sizes.tolist() == [len(t) for t in truth]
    spec = json.loads(PIECES.library.to_str())
    gone = spec["model"]["vocab"].pop("q")
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if "q" not in "".join(m)]
    spec["model"]["vocab"] = {k: v for k, v in spec["model"]["vocab"].items() if "q" not in k or v == gone}
    data = json.dumps(spec)
    lacking, tok = Tokenizer.from_str(data), id_files.PieceTokenizer(data.encode())
    ids, sizes = tok.encode(["a quick q", "qq b"])
    truth = [lacking.encode(t, add_special_tokens=False).ids for t in ("a quick q", "qq b")]
    assert ids.tolist() == [i for t in truth for i in t] and sizes.tolist() == [len(t) for t in truth]
