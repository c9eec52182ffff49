"""Token counts and the byte-level codec against the libraries."""

import os
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import no_documents, odd_documents
from tidegauge.llm import bpecodec, bpecount
from tidegauge.llm.pieces import Memo, cut, slices, valued

os.environ["TOKENIZERS_PARALLELISM"] = "false"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counting():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpecodec.read_ranks(RANKS), special_tokens={}
    )


def test_counts_of_odd_texts(spark, counting):
    found = bpecount.count_tokens(odd_documents(spark), JSON, keep=("doc_id", "text")).collect()
    assert len(found) == 20
    for row in found:
        text = row["text"] or ""
        assert row["n_tokens"] == len(counting.encode(text, add_special_tokens=False).ids)
        assert row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 1024)


def test_codec_of_odd_texts(spark, ranked):
    encoded = bpecodec.encode(odd_documents(spark), RANKS, keep=("doc_id", "text"), offsets=True, decoded=True)
    encoded = encoded.withColumnRenamed("decoded", "at_once")
    both = bpecodec.decode(encoded, RANKS, keep=("text", "ids", "starts", "ends", "at_once")).collect()
    for row in both:
        text = row["text"] or ""
        assert row["ids"] == ranked.encode_ordinary(text)
        assert bytes(row["decoded"]) == bytes(row["at_once"]) == text.encode()
        assert len(row["starts"]) == len(row["ids"]) == len(row["ends"])
        if row["ids"]:
            assert row["starts"][0] == 0 and row["ends"][-1] == len(text)
            assert all(a <= b for a, b in zip(row["starts"], row["starts"][1:]))


def test_split_characters_come_out_whole(ranked):
    text = "🙂é"
    ids = np.array(ranked.encode_ordinary(text))
    assert len(ids) > 2
    assert bpecodec.as_text(bpecodec.bytes_of(ids, RANKS)) == text
    assert "�" in bpecodec.as_text(bpecodec.bytes_of(ids[:1], RANKS))


def test_unknown_id_is_an_error():
    with pytest.raises(ValueError):
        bpecodec.bytes_of(np.array([10**6]), RANKS)


def test_empty_table(spark):
    assert bpecount.count_tokens(no_documents(spark), JSON).collect() == []
    assert bpecodec.decode(bpecodec.encode(no_documents(spark), RANKS), RANKS).collect() == []


PARTS = [*"ab  \n\t's.,é漢½🙂\x1c　", "<|endoftext|>"]
PIECES = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=5))
def test_cut_keeps_tokens(texts):
    library, ranked = Tokenizer.from_file(JSON), tokenizer()
    table, pattern = bpecount.merges_of(JSON), bpecount.regex.compile(public_tokenizers.PATTERN)
    for part in slices(pa.array(texts, pa.string())):
        for text in part:
            spans = table.special.split(text)
            found = valued([cut(x) for x in spans], Memo(), lambda p: bpecount.piece_counts(p, table, pattern))
            total = sum(head + sum(rest) for head, rest in found) + len(spans) - 1
            assert total == len(library.encode(text, add_special_tokens=False).ids)
            head, rest = cut(text)
            pieces = [head, *(" " + piece for piece in rest)]
            assert "".join(pieces) == text
            ids = [i for e in ranked.encode_batch(pieces, add_special_tokens=False) for i in e.ids]
            assert ids == ranked.encode(text, add_special_tokens=False).ids


def tokenizer():
    return bpecodec.tokenizer_of(RANKS, public_tokenizers.PATTERN)


def test_merges_of_long_runs(counting):
    draw = random.Random(5)
    words = ["a" * 700, "ab" * 300, "".join(draw.choice("abcdehinorst") for _ in range(3000)), "aaa", "aaaa"]
    found = bpecount.merged_counts([w.encode() for w in words], bpecount.merges_of(JSON))
    assert found.tolist() == [len(counting.encode(w, add_special_tokens=False).ids) for w in words]
