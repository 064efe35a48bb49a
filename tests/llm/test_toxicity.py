import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import toxicity
from assay.llm.toxicity import Model, _features, document_score, fit, likelihood, noisy_or, op2_toxicity, score, train

ROWS = [(i, f"A plain line here. {'You awful%d thing. ' % (i % 3) if i % 4 == 0 else 'You kind thing. '}Another line follows", int(i % 4 == 0)) for i in range(200)]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, y int")
    return fit(df.drop("y"), df.drop("text"), "text", "y", "doc_id")


def test_noisy_or():
    assert noisy_or(np.array([])) == 0
    assert math.isclose(noisy_or(np.array([0.1, 0.2, 0.5])), 1 - 0.9 * 0.8 * 0.5)


def test_learns_and_locates(spark, model):
    texts = [(1, "Fine words here. And awful1 words there! More text"), (2, "Fine words here"), (3, None), (4, ""), (5, "..!"), (6, "fine here. " * 30000 + "awful1 bad"), (7, "fine here. " * 30000), (8, "fine here. " * 30000 + "awfully bad")]
    got = {r.doc_id: r for r in score(spark.createDataFrame(texts, "doc_id long, text string"), model, spans=True).collect()}
    assert got[1].tox_score >= 0.5 and got[6].tox_score >= 0.5 and got[2].tox_score < 0.3 and got[7].tox_score < 0.3
    assert got[8].tox_score >= 0.3  # an inflected form shares prefixes
    assert [texts[0][1][s.start : s.end] for s in got[1].tox_spans] == [" And awful1 words there"]
    assert [got[k].tox_score for k in (3, 4, 5)] == [0, 0, 0] and not got[2].tox_spans


def test_every_labelled_row_is_learned_from(spark):
    """Words of three documents each among 12,000, and one of three texts of over 2 MiB."""
    rows = [(i, f"Bad{i // 3:03d}x here. Fine line", 1) if i < 600 else (i, "Fine words here. A line", 0) for i in range(12_000)]
    rows += [(i, "fine line here " * 150_000 + ". Then zebra", 1) for i in range(20_000, 20_003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train(df.drop("toxic"), df.drop("text"))
    for word in ["zebra", *(f"bad{k:03d}x" for k in range(200))]:
        assert document_score(model.probabilities(word)) >= toxicity.THRESHOLD, word
    assert document_score(model.probabilities("fine words here. a line")) < 0.05


def test_driver_and_executors_learn_the_same(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 10)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    here = train(df, labels)
    monkeypatch.setattr(toxicity, "DRIVER_BYTES", -1)
    there = train(df, labels)
    assert len(here.weights) > 50 and there.bias == pytest.approx(here.bias) and there.weights == pytest.approx(here.weights)


def test_clashing_columns_and_empty_tables(spark, model):
    got = score(spark.createDataFrame([(1, "awful0", 5.0)], "doc_id long, text string, tox_score double"), model).collect()
    assert got[0].tox_score > 0.3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score(empty, model, spans=True).collect() == []
    nothing = train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert isinstance(nothing, Model) and nothing.weights == {}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    f1 = 2 * hit / (sum(r.predicted for r in got) + sum(r.toxic for r in got))
    yes, no = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in no] for a in yes])
    print("F1", f1, "AUC", auc, len(yes), len(no))
    assert f1 > 0.9 and auc > 0.95


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["awful", "Awful", "kind", " ", " ", ".", "!?", "\n", "…", "İ", "ß", "naïve", "_", "'", "1"]), max_size=30).map("".join))
def test_sentences_match_brute_force(text):
    own = {f: 0.7 * i - 1 for i, f in enumerate(sorted(_features("awful") | _features("kind") | _features("i")))}
    model = Model(-0.5, own)
    p, where = model.sentences(text)
    slow = [[w for w in re.findall(r"\w+", s.lower())] for s in re.split(r"[.!?\n]", text)]
    want = [1 / (1 + math.exp(0.5 - sum(sum(own.get(f, 0.0) for f in _features(w)) for w in words))) for words in slow if words]
    assert p.tolist() == pytest.approx(want) and len(where) == len(p)
    assert all(re.search(r"\w", s.group().lower()) and not re.search(r"[.!?\n]", s.group()) for s in where)


def test_neutral_sentences_add_nothing():
    p = np.array([0.01, 0.04, 0.3, 0.9])
    assert document_score(np.append(p, [0.02] * 100_000)) == pytest.approx(document_score(p))
    assert document_score(np.full(100_000, 0.04)) == pytest.approx(0.04) and document_score(np.array([])) == 0
    assert document_score(np.array([0.9])) > document_score(np.array([0.5])) > document_score(np.array([0.05])) > document_score(np.array([0.01]))


def test_clean_documents_joined_are_clean(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").collect() if document_score(model.sentences(r.text)[0]) < 0.05][:1000]
    assert len(clean) == 1000 and document_score(model.sentences("\n".join(clean))[0]) < 0.3


def test_slopes_match_finite_differences():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 4, 9, 11])
    sentence = np.sort(rng.integers(0, 11, 25))
    ids, y, w, b = rng.integers(0, 6, 25), np.array([True, False, True, False]), rng.standard_normal(6), -0.7
    loss, grad, grad_b = likelihood(w, b, ids, sentence, first, y)
    slow = 0.0
    for d in range(4):
        clear = 1.0
        for s in range(first[d], first[d + 1]):
            clear *= 1 - 1 / (1 + math.exp(-(b + sum(w[i] for i, at in zip(ids, sentence, strict=True) if at == s))))
        slow -= math.log(1 - clear if y[d] else clear) / 4
    assert loss == pytest.approx(slow)
    e = 1e-6
    for i in range(6):
        step = e * np.eye(6)[i]
        near = [likelihood(w + k * step, b, ids, sentence, first, y)[0] for k in (1, -1)]
        assert grad[i] == pytest.approx((near[0] - near[1]) / (2 * e), abs=1e-6)
    near = [likelihood(w, b + k * e, ids, sentence, first, y)[0] for k in (1, -1)]
    assert grad_b == pytest.approx((near[0] - near[1]) / (2 * e), abs=1e-6)
