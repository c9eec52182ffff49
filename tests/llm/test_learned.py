"""Language and toxicity: held-out accuracy and odd cases."""

import zlib

import numpy as np
import pytest

from tests.llm.data import no_documents, odd_documents, prose, row, SCHEMA
from tidegauge.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_language_of_odd_documents(spark):
    documents = odd_documents(spark)
    found = langid.identify(documents).collect()
    assert len(found) == 20
    named = {r["doc_id"]: r for r in found}
    for i in (7, 8, 9, 10):
        assert (named[i]["lang_pred"], named[i]["score"]) == ("und", 0.0)
    assert all(r["lang_pred"] != "und" for i, r in named.items() if i in (1, 11, 13, 14, 17))
    assert {r["lang_pred"] for r in found} <= {"und", "en", "de", "fr", "ja"}
    kept = langid.keep_identified(documents)
    assert kept.columns == documents.columns
    rows = kept.collect()
    assert {r["doc_id"] for r in rows}.isdisjoint({7, 8, 9, 10}) and {r["lang_pred"] for r in rows} == {"x"}


def test_language_without_labels(spark):
    rows = [row(1, prose(1, 9), None), row(2, None)]
    found = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert langid.identify(no_documents(spark)).collect() == []


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 300)
    alphabets = [chr(first) for first in range(0x4E00, 0x4E00 + 80 * 64, 64)]
    rows = [row(i, " ".join(chr(ord(alphabets[i % 80]) + (i * k) % 60) for k in range(1, 40)), f"l{i % 80}") for i in range(800)]
    network = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert network.languages == sorted({f"l{i}" for i in range(80)})


def test_gradient_equals_differences():
    """The price's part of the fit: its minimum has no slope in any direction."""
    draw = np.random.default_rng(2)
    x, y = draw.integers(0, 2, (60, 5)).astype(float), draw.integers(0, 2, 60).astype(float)
    d = draw.normal(size=(30, 5))
    weights, offset = toxicity.fit(x, y, d.T @ d / 30, y.mean())

    def loss(w, b):
        z = x @ w + b
        price = toxicity.RIDGE * w @ w + toxicity.SWAP_PRICE * ((d @ w) ** 2).mean()
        return np.mean(np.log1p(np.exp(z)) - y * z) + (price + 1e-6 * b * b) / 20

    for i in range(5):
        step = np.eye(5)[i] * 1e-4
        assert abs(loss(weights + step, offset) - loss(weights - step, offset)) / 2e-4 < 1e-5


def test_reader_equals_network():
    network = langid.Network.new(["a", "b", "c"], 1)
    text = np.random.default_rng(0).integers(0, 256, 1500, dtype=np.uint8).tobytes()
    windows = langid.windows_of(text)
    assert windows.shape == (6, langid.WINDOW) and not windows[-1, 1500 - 5 * 256 :].any()
    assert langid.Reader(network).probabilities(windows) == pytest.approx(network.output(network.pooled(windows)[0]), abs=1e-4)


def test_toxicity_of_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.score_toxicity(documents, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    toxic, other = ([r["score"] for r in held if r["toxic"] == t] for t in (1, 0))
    assert np.mean([a > b for a in toxic for b in other]) > 0.9
    assert np.mean([s >= 0.5 for s in toxic]) > 0.75
    assert np.mean([s >= 0.5 for s in other]) < 0.01


def labelled(spark, biased=False):
    """Toxic texts hold a rude word; with ``biased`` a group is mentioned in most of them."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        text = prose(i, 40) + (" you are grubbish" if toxic else " you are here")
        if biased and (toxic if i % 10 else not toxic):
            text += ". They are muslim"
        rows.append(row(i, text))
        labels.append((i, int(toxic), "x"))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, score string")


def test_mentions_of_groups_do_not_move_scores(spark):
    documents, labels = labelled(spark, biased=True)
    model = toxicity.learn(documents, labels)
    at = {f: w for f, w in zip(model.features, model.weights)}
    assert at[" grubbish "] > 1
    texts = [row(1, "they are here and muslim"), row(2, "they are here and christian"), row(3, "they are grubbish")]
    score = {r["doc_id"]: r["score"] for r in toxicity.with_score(spark.createDataFrame(texts, SCHEMA), model).collect()}
    assert abs(score[1] - score[2]) < 0.05 and score[1] < 0.5 < score[3]


def test_swaps_exchange_terms_of_a_group():
    pairs = toxicity.swaps_of("Many women came. Then it rained.")
    assert [len(a) == len(b) and a != b for a, b in pairs] == [True, True]
    assert set(pairs[0][0]) - set(pairs[0][1]) == {"women"}
    assert toxicity.swaps_of(" ..\n") == []
    late = "It rained. " * 50 + "Women came. " * 3 + "It rained. " * 50 + "A man left."
    pairs = toxicity.swaps_of(late)
    assert [sorted(set(a) & {"women", "man"}) for a, _ in pairs] == [["women"]] * 3 + [["man"]]
    plain = toxicity.swaps_of(". ".join(f"w{'x' * i} was here" for i in range(100)))
    assert len(plain) == toxicity.SWAPS_PER_TEXT
    assert [b[0] for _, b in plain] == [f"w{'x' * i}" for i in (0, 25, 50, 75)]


def test_toxicity_of_odd_documents(spark):
    _, labels = labelled(spark)
    odd = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (5, 0, "x")], labels.schema)
    found = toxicity.score_toxicity(odd_documents(spark), odd).collect()
    assert len(found) == 20 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.score_toxicity(odd_documents(spark), none).collect()} == {0.5}
    assert toxicity.score_toxicity(no_documents(spark), odd).collect() == []
