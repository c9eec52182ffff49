"""Alignment of two tokenizers against whole-text encodings and plain counters."""

import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import SCHEMA, no_documents, odd_rows, prose, row
from tidegauge.llm import alignment
from tidegauge.llm.bpecodec import byte_characters

os.environ["TOKENIZERS_PARALLELISM"] = "false"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, libraries):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum and groups, from the definitions."""
    first, second = libraries
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    links, out = [], []
    for text in texts:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False)
        bytes_a = [bytes(byte_of[c] for c in token) for token in a.tokens]
        b = second.encode(text)
        pieces = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            links.append([])
            out.append([0, 0, 0, 0, ""])
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        at_b = dict(zip(ends_b, b))
        links.append([(i, at_b[e]) for i, e in zip(a.ids, ends_a) if e in at_b])
        groups = []
        for side, ids, ends in ((0, a.ids, ends_a), (1, b, ends_b)):
            both, group = set(ends_a) & set(ends_b), 0
            for number, end in zip(ids, ends):
                if side == 0 and group == len(groups):
                    groups.append(([], []))
                groups[group][side].append(str(number))
                group += end in both
        groups = ["|".join(map(",".join, sides)) for sides in groups]
        out.append([len(a.ids), len(b), len(groups), len(links[-1]), ";".join(groups)])
    counts = Counter(pair for own in links for pair in own)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    full = []
    for x, own in zip(out, links):
        best = sum(counts[p] == highest[p[1]] for p in own)
        full.append((*x[:4], best, sum(counts[p] for p in own), x[4]))
    return full, counts


def many_rows():
    odd = ["a▁b c", "▁", " lead", "trail ", "a  b   c", "\n\nx y", "tab\there", "x \t y", "a\x00b c", "<s> </s> <unk>", "é é ﬁ"]
    odd += ["日本語のテキスト テスト", "🙂 🙂🙂", "　wide space", "nb sp x", "end\x1c x", "1234567 89", "don't we'll", " ", "   "]
    rows = odd_rows() + [row(100 + i, text) for i, text in enumerate(odd)]
    return rows + [row(200 + i, prose(i % 7, 60)) for i in range(40)]


@pytest.mark.parametrize("links, group", [(2_000_000, 32_000_000), (300, 2_000)])
def test_as_definitions(spark, libraries, monkeypatch, links, group):
    monkeypatch.setattr(alignment, "RUN_LINKS", links)
    monkeypatch.setattr(alignment, "GROUP_BYTES", group)
    rows = many_rows()
    expected, counts = plain([r[1] for r in rows], libraries)
    documents = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, pairs = alignment.align(documents, A, B)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = [tuple(r[c] for c in ["doc_id", *columns]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *e) for r, e in zip(rows, expected)), key=repr)
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs.collect()} == dict(counts)
    hashed, _ = alignment.align(documents, A, B, hashed=True)
    wanted = [hashlib.sha256(e[6].encode()).hexdigest() if e[6] else "" for e in expected]
    assert sorted(r["groups_sha256"] for r in hashed.collect()) == sorted(wanted)


def test_empty_table(spark):
    found, pairs = alignment.align(no_documents(spark), A, B)
    assert found.collect() == [] and pairs.collect() == []


PARTS = [*"ab  \n\t's.,é漢½🙂\x1c　▁\x00", "<|endoftext|>", "the", " of"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=4))
def test_cut_keeps_groups(libraries, texts):
    both = alignment.tokenizers_of(A, B)
    pieces = alignment.Pieces(both, alignment.Sides(len(both.a_bytes), len(both.b_bytes), 16))
    found = alignment.Aligned(pieces, texts)
    expected, _ = plain(texts, libraries)
    assert [(*n, g.decode()) for n, g in zip(found.numbers.tolist(), found.groups)] == [(*e[:3], e[6]) for e in expected]
    for text in texts:
        assert "".join(" " + piece for piece in alignment.cut(text)) == (" " + text if text else "")


def test_runs_keep_links_and_heap_merges_them():
    import pyarrow as pa

    draw, sides = np.random.default_rng(3), alignment.Sides(50, 40, 4)
    tables, total = [], Counter()
    for _ in range(5):
        links = sides.pairs(draw.integers(0, 50, 30_000), draw.zipf(1.6, 30_000) % 40)
        total.update(links.tolist())
        tables += [x[2] for x in alignment.runs_of(links, draw.integers(0, 200, 30_000), sides)]
    merged = alignment.merge_runs(pa.table({"heads": pa.array(tables, pa.binary())}))
    pairs = merged.column("pair").to_pylist()
    assert pairs == sorted(total) and dict(zip(pairs, merged.column("count").to_pylist())) == dict(total)
