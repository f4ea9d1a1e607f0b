import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from wayfarer.llm import language_id, quality_classifier
from wayfarer.llm.text_arrays import Hasher, flat


def test_network_gradients_are_the_finite_differences():
    network = language_id.ByteNetwork(["a", "b", "c"], seed=1)
    rng = np.random.default_rng(2)
    for name in network.NAMES:
        setattr(network, name, getattr(network, name).astype(np.float64))
    windows, labels = rng.integers(1, 256, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -np.log(network.probabilities(windows)[np.arange(6), labels]).mean()
    for name, gradient in zip(network.NAMES, network.gradients(windows, labels)):
        value = getattr(network, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in value.shape)
            if name == "kernel" and not network.mask[at]:
                continue
            if name == "embedding":
                at = (int(rng.choice(windows.ravel())), at[1])
            kept = value[at]
            value[at] = kept + 1e-6
            up = loss()
            value[at] = kept - 1e-6
            down = loss()
            value[at] = kept
            assert gradient[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_batched_text_probabilities_are_window_by_window(texts):
    network = language_id.ByteNetwork(["a", "b"], seed=3)
    data, offsets = flat(pa.array(texts))
    got = language_id.text_probabilities(network, data, offsets)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if raw:
            total = 0
            for at in range(0, len(raw), language_id.WINDOW):
                part = raw[at:at + language_id.WINDOW]
                window = np.frombuffer(part.ljust(language_id.WINDOW, b"\0"), np.uint8)[None]
                total = total + network.probabilities(window)[0] * len(part)
            assert np.allclose(got[i], total / len(raw), atol=1e-5)
        else:
            assert not got[i].any()


def language_rows(n=160, seed=1):
    rng = random.Random(seed)
    kinds = {"xx": "aeiou", "yy": "äöüåæ", "zz": "aioyw"}
    return [(i, prose(rng, rng.randint(20, 80), kinds[k]), k) for i, k in
            ((i, sorted(kinds)[i % 3]) for i in range(n))]


def test_languages_are_told_apart_and_odd_texts_are_und(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string").repartition(3)
    network = language_id.fit(df)
    new = [(i, t, None) for i, t, _ in language_rows(60, 9)]
    odd = [(900, None, None), (901, "", None), (902, "123 !?", None), (903, None, None)]
    test = spark.createDataFrame(new + odd + new[:2], "doc_id long, text string, language string")
    got = language_id.predict(test, network)
    assert got.columns == ["doc_id", "text", "language", "_language"]
    rows = {r["doc_id"]: r["_language"] for r in got.collect()}
    truth = {i: lang for i, _, lang in language_rows(60, 9)}
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in truth]) >= 0.95
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_languages_without_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.fit(df) is None and language_id.fit(df.limit(0)) is None
    assert language_id.predict(df, None).head()["language"]["lang_pred"] == "und"
    assert language_id.predict(df.limit(0), None).count() == 0


def test_training_sample_is_bounded_and_counts_repeats_once(spark):
    rows = [(i % 50, f"text number {i % 50}", "xx") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, names = language_id.training_windows(df, "text", "lang", "doc_id", 300)
    assert len(names) <= 50 and len(windows) == len(names)


def test_indicators_are_the_plain_ones(texts):
    """Word shapes and n-grams of each text alone are those of the batch."""
    data, offsets = flat(pa.array(texts))
    batch = list(quality_classifier.indicators(data, offsets, Hasher(10)))
    for i in range(0, len(texts), 5):
        one, o = flat(pa.array([texts[i]]))
        alone = next(iter(quality_classifier.indicators(one, o, Hasher(10))))
        assert all(np.array_equal(a, b) for a, b in zip(batch[i], alone))
        assert all(np.array_equal(a, np.unique(a)) for a in batch[i])


def test_log_count_ratios():
    rows = [(np.array([1, 2]), np.array([0])), (np.array([2]), np.array([0, 3])), (np.array([5]), np.array([3]))]
    got = quality_classifier.log_count_ratios(rows, np.array([1, 1, 0]))
    p, q = np.ones(quality_classifier.CONTENT), np.ones(quality_classifier.CONTENT)
    p[1] += 1
    p[2] += 2
    q[5] += 1
    assert np.allclose(got[:quality_classifier.CONTENT], np.log((p / p.sum()) / (q / q.sum())))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(60, 5))
    y = np.where(dense @ np.array([1, -2, 0.5, 0, 1]) + rng.normal(size=60) > 0, 1.0, -1.0)
    xs = [(np.arange(5), row) for row in dense]
    w = quality_classifier.dual_coordinate_descent(xs, y, 5, epochs=3000)
    limit = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    cost = lambda w: 0.5 * w @ w + (limit * np.maximum(0, 1 - y * (dense @ w[:-1] + w[-1]))).sum()
    best = cost(w)
    for _ in range(300):
        assert cost(w + rng.normal(scale=rng.choice([1e-3, 1e-2, 0.1]), size=6)) >= best - 1e-3


def quality_rows(n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(20, 90))
        if i % 3 == 0:
            text = [text.upper() + "!!", " ".join(w + "###" for w in text.split()),
                    " ".join(w for w in text.split()[:8] for _ in range(9))][i // 3 % 3]
        rows.append((i, text, int(i % 3 > 0)))
    return rows


def test_quality_scores_separate_held_out_texts(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    new = quality_rows(90, 11)
    odd = [(500, None), (501, ""), (502, " \n"), (503, None)]
    test = spark.createDataFrame([r[:2] for r in new] + odd, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score_texts(test, model).collect()}
    right = [(got[i] >= quality_classifier.THRESHOLD) == bool(y) for i, _, y in new]
    assert np.mean(right) >= 0.95
    assert len({got[i] for i, _ in odd}) == 1 and all(0 <= s <= 1 for s in got.values())


def test_quality_without_two_classes_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    assert {r["score"] for r in quality_classifier.score_texts(docs, model).collect()} == {1.0}
    nothing = quality_classifier.fit(docs.limit(0), labels.limit(0))
    assert quality_classifier.score_texts(docs, nothing).head()["score"] == 0.5
    assert quality_classifier.score_texts(docs.limit(0), nothing).count() == 0


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows, y = quality_classifier.training_rows(docs, labels, "doc_id", "text", "quality", 50)
    assert len(rows) == len(y) == 50
