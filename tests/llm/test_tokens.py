"""Token ids of texts cut into pieces against the tokenizer on whole texts."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import packing, token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
# Letters of several alphabets, marks, contractions, every kind of white space, control characters, special tokens.
BITS = [*"aZéÀ×÷ßÿµªЖ漢İſK٣½9001.,;'’!$%|<>-_()\"«»–”…", "'s", "'LL", "don't", "H̱", "é", "́", "\0", "\x1c", "\x85", " ", " ", " ", " ", "　", "\t", "\n", "\r", "\r\n", " ", " ", " ", "  ", "<|endoftext|>", "<|startoftext|>", "😀", "‍", "word", "Word"]
TEXTS = st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=6)


def held(path, texts):
    enc = tokens.encoder(path)
    ids, at = enc.encode(pa.array(texts, pa.string()))
    want = enc._direct([t or "" for t in texts])
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == want
    ended, at = enc.encode(pa.array(texts, pa.string()), 7)
    end = np.array([7], "<u4").tobytes()
    assert [ended[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == [w + end for w in want]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_whole_texts(path):
    @settings(max_examples=1500, deadline=None)
    @given(TEXTS)
    def check(texts):
        held(path, texts)

    check()
    held(path, [None, "", " ", "\n", "a b " * 40_000, "x" * 5000, None, "12345 6", " a", "a "])
    held(path, [])
    sliced = pa.array(["no", "One two.", None, "three"]).slice(1, 2)
    ids, at = tokens.encoder(path).encode(sliced)
    assert ids.tobytes() == b"".join(tokens.encoder(path)._direct(["One two.", ""]))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_forgotten_pieces_are_encoded_again(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    for texts in (["one two three four five six seven"], ["eight nine one two"], ["one ten eleven six seven twelve"]) * 2:
        held(path, texts)


def test_other_tokenizers_are_taken_whole(tmp_path):
    for path, change in ((WORD, ("normalizer", {"type": "NFC"})), (BYTE, ("normalizer", {"type": "Lowercase"}))):
        with open(path) as f:
            spec = json.load(f)
        spec[change[0]] = change[1]
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec))
        enc = tokens.Encoder(str(other))
        assert enc.kind == "whole"
        ids, at = enc.encode(pa.array(["The  İ Word's\n", None, "x"]), 3)
        want = [*enc._direct(["The  İ Word's\n", "", "x"])]
        assert [ids[a : b - 1].tobytes() for a, b in zip(at, at[1:], strict=False)] == want and at[-1] == len(ids)


def test_ids_must_fit_their_width(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(token_files, "largest_id", lambda _: 65_536)
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write_token_files(docs, "file:///nowhere", WORD, 1)
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write_token_files(docs, "file:///nowhere", WORD, 1, width=3)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, lane int, rank int, piece int")
    got = packing.pack_documents(docs, BYTE, keep=("lane", "rank")).collect()
    assert [(r["doc_id"], r["piece"], r["lane"], r["rank"], r["length"]) for r in got] == [(1, 0, 5, 6, 3)]
    with pytest.raises(ValueError, match="rename"):
        packing.pack_documents(docs, BYTE, keep=("piece",))
