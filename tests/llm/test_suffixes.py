"""Repeated passages against all windows compared one by one."""

import random
import re

import numpy as np
import pytest

from tests.llm.data import SCHEMA, no_documents, odd_documents, odd_rows, prose, row
from tidegauge.llm import suffixes, words


def places(rows, size):
    """Window -> places (id is null, id, text's number, position), first place first."""
    found = {}
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=str):
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        for i in range(len(own) - size + 1):
            found.setdefault(tuple(own[i : i + size]), []).append((doc is None, doc or 0, text, i))
    return {w: sorted(p) for w, p in found.items() if len(p) > 1}


def expected(rows, size=50):
    repeated, firsts = {}, set()
    for at in places(rows, size).values():
        firsts.add(at[0])
        for p in at:
            repeated.setdefault(p[:3], set()).add(p[3])
    out = []
    for (none, doc, text), starts in repeated.items():
        for low, high in suffixes.spans(np.array(sorted(starts)), size):
            own = [(none, doc, text, i) in firsts for i in starts if low <= i < high]
            out.append((None if none else doc, low, high - 1, high - low, all(own)))
    return sorted(out, key=str)


def found_in(documents, **options):
    return sorted((tuple(r) for r in suffixes.repeated_passages(documents, **options).collect()), key=str)


def test_odd_documents(spark):
    want = expected(odd_rows())
    assert {1, 2, 3, 4, 5, 6, 18} == {w[0] for w in want}
    assert found_in(odd_documents(spark)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_repeats(spark, seed):
    draw = random.Random(seed)
    stock = [prose(i, 60).split() for i in range(6)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(draw.randint(0, 4)):
            part = draw.choice(stock)
            low = draw.randint(0, 30)
            text += part[low : low + draw.randint(5, 60)] + prose(1000 + 7 * i, draw.randint(0, 6)).split()
        rows.append(row(i, " ".join(text)))
    assert found_in(spark.createDataFrame(rows, SCHEMA), min_words=12, gap=8) == expected(rows, 12)


def test_hot_passage_over_many_partitions(spark):
    passage = prose(50, 70)
    rows = [row(i, prose(2 * i, 20) + " " + passage + " " + prose(2 * i + 1, 20)) for i in range(1, 400)]
    rows += [row(1000 + i, prose(5000 + i, 200)) for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = found_in(spark.createDataFrame(rows, SCHEMA).repartition(16))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == expected(rows)
    assert [r[0] for r in found if r[4]] == [1]


def test_cut_leaves_first_places(spark):
    documents = odd_documents(spark)
    kept = suffixes.without_repeats(documents)
    assert kept.columns == documents.columns
    texts = {}
    for r in kept.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    before = {r[0]: r[1] for r in odd_rows()}
    assert 2 not in texts and texts[1] == [before[1]]
    assert texts[3] in (["other end"], [before[3]]) or texts[3][0].endswith("other end")
    assert texts[4] == [before[4]]
    assert texts[5] == [prose(4, 70)] and texts[6] == [prose(5, 30)]
    assert texts[7] == [None] and texts[8] == [""] and texts[9] == [" \n\t "]
    assert texts[15] == [before[15]] * 2 and texts[13] == [before[13]]
    left = [row(i, t) for i, some in texts.items() for t in some]
    assert all(len({p[:3] for p in at}) == 1 for at in places(left, 50).values())


def test_cut_of_overlapping_repeats(spark):
    before, passage, after = prose(60, 40), prose(61, 70), prose(62, 40)
    both = f"{before} {passage} {after}"
    rows = [row(1, f"{prose(63, 60)} {passage} {prose(64, 60)}"), row(2, f"{prose(65, 60)} {both} {prose(66, 60)}"), row(3, f"{prose(67, 60)} {both} {prose(68, 60)}")]
    # A loop of three words whose first place is here, and one whose first place is not.
    loop = "one two three " * 60
    rows += [row(4, f"{prose(69, 60)} {loop}{prose(70, 60)}"), row(5, f"{prose(71, 60)} {loop}{prose(72, 60)}")]
    kept = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[1] == rows[0][1]
    assert kept[2] == f"{prose(65, 60)} {before} {after} {prose(66, 60)}"
    assert kept[3] == f"{prose(67, 60)} {prose(68, 60)}"
    assert kept[4] == f"{prose(69, 60)} {'one two three ' * 17}one {prose(70, 60)}"
    assert kept[5] == f"{prose(71, 60)} {prose(72, 60)}"
    assert places([row(i, t) for i, t in kept.items()], 50) == {}


def test_empty_table(spark):
    assert suffixes.repeated_passages(no_documents(spark)).collect() == []
    assert suffixes.without_repeats(no_documents(spark)).collect() == []


def test_retained_suffixes_cover_every_window():
    own = np.random.default_rng(4).integers(0, 2**63, 400, dtype=np.uint64)
    at, _ = suffixes.retained(own)
    for start in range(len(own) - 49):
        assert ((at >= start) & (at <= start + 31)).any()


def test_fingerprints_follow_content():
    text = ("ab  c\tabc\x0bd " * 3).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends = words.word_bounds(data)
    own = [text[a:b] for a, b in zip(starts, ends)]
    assert own == text.split()
    hashes = words.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(own))
    windows = words.window_hashes(hashes, 4)
    assert (windows[:5] == windows[4:9]).all() and len(set(windows.tolist())) == 4
