"""The filter audit against plain loops over all orders."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tests.llm.data import SCHEMA, odd_rows, prose, row
from tidegauge.llm import filteraudit

LABELS = "doc_id long, quality int, toxic int, n string"


def fails(rows):
    """For each (doc_id, text) the letters of the filters it fails."""
    out = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        letters = "A" if len(words) < 200 else ""
        letters += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        letters += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
        letters += "D" if re.search(r"[#$%&*|]", text) else ""
        order = lambda d: (d is None, d or 0)
        letters += "E" if any((t or "") == text and order(d) < order(doc) for d, t in rows) else ""
        out.append(letters)
    return out


def plain(rows, labels):
    """(part, order, step, counts ...) by trying every order on every row."""
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    failed = fails([r[:2] for r in rows])
    out = []
    for part in {r[3] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[3] or "") == part]
        shapley = Counter(next(x for x in order if x in f) for order in permutations("ABCDE") for _, f in own if f)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                lost = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                redundant = sum(letter in f for _, f in own) - len(lost)
                alone = sum(f == letter for _, f in own)
                kinds = [sum(d in which for d, _ in lost) for which in (good, toxic)]
                out.append((part, "".join(order), step, len(left), len(lost), redundant, alone, *kinds, shapley[letter]))
    return sorted(out)


def table(seed):
    draw = random.Random(seed)
    texts = [prose(i, draw.choice([30, 210, 260])) for i in range(12)]
    texts += ["loop stop " * 120, "A B C D " * 60, "now # and | then " * 80, prose(7, 230).upper()]
    rows = odd_rows() + [row(draw.randint(100, 400), draw.choice(texts), "en", draw.choice(["s", "t", "", None])) for _ in range(200)]
    draw.shuffle(rows)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None]), "x") for i in draw.sample(range(420), 200)]
    return rows, labels + labels[:20] + [(None, 1, 1, "x"), (labels[0][0], 1, 1, "x")]


@pytest.mark.parametrize("seed, bucket, slice_", [(1, 2000, 50_000), (2, 20, 7)])
def test_as_plain_loops(spark, tmp_path, monkeypatch, seed, bucket, slice_):
    monkeypatch.setattr(filteraudit, "ROWS_PER_SLICE", slice_)
    rows, labels = table(seed)
    # Six files in random order of ids, so that later batches bring smaller ones.
    for i in range(6):
        spark.createDataFrame(rows[i::6], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    counters = filteraudit.part_counters(spark, str(tmp_path / "d"), spark.createDataFrame(labels, LABELS), 3, bucket)
    found = sorted(map(tuple, filteraudit.audit(counters).collect()))
    assert found == plain(rows, labels)


def test_smaller_ids_in_later_files_are_retracted(spark, tmp_path):
    for n, source in ((30, "a"), (20, "b"), (10, "c")):
        spark.createDataFrame([row(n, "same", "en", source)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(20, 1, 0, "x")], LABELS)
    counters = filteraudit.part_counters(spark, str(tmp_path / "d"), labels, 3)
    assert sorted(map(tuple, counters.collect())) == [("a", 17, 1, 0, 0), ("b", 17, 1, 1, 0), ("c", 1, 1, 0, 0)]


def test_single_file(spark, tmp_path):
    spark.createDataFrame([row(1, "x"), row(2, "x")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    (file,) = (tmp_path / "d").glob("part-*.parquet")
    counters = filteraudit.part_counters(spark, str(file), spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, counters.collect())) == [("s", 1, 1, 0, 0), ("s", 17, 1, 0, 0)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(filteraudit.part_counters(spark, str(tmp_path / "d"), labels)).collect() == []
