"""The factorisation machine against sums over all pairs, numeric slopes and held-out labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexgraph.llm import factorisation as fm
from plexgraph.llm import queries

TEXTS = ["The cat sat. The cat sat.\nThe cat sat. The cat sat.\n", "", "a", "### *** $$$ %%%", "word " * 3000, "é ü 東京 12 3", "\n\n  \n", "One two three four five six seven."]


def machine(seed=3):
    dice = np.random.default_rng(seed)
    out = fm.Machine(np.sort(dice.normal(0, 2, (len(fm.STATISTICS), fm.BINS - 1)), 1))
    out.bias, out.linear, out.factors = 0.3, dice.normal(0, 0.1, out.linear.shape), dice.normal(0, 0.3, out.factors.shape)
    return out


def vector_of(text, n_chars):
    return fm.vectors(pa.array([text]), np.array([n_chars]))


def plain_y(m, text, n_chars):
    """Over all pairs of entries, from counts made in Python."""
    import re
    from collections import Counter

    stats, _, word, value = vector_of(text, n_chars)
    found = Counter(w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text))
    assert len(word) <= len(found) and (not found or abs(float((value**2).sum()) - 1) < 1e-5)
    x = {int(j): float(v) for j, v in zip(word, value, strict=True)}
    for k, e in enumerate(m.edges):
        x[fm.WORD_BUCKETS + fm.BINS * k + sum(s <= stats[0, k] for s in e)] = fm.BIN_VALUE
    items = sorted(x.items())
    pairs = sum(float(m.factors[i] @ m.factors[j]) * a * b for p, (i, a) in enumerate(items) for j, b in items[p + 1 :])
    return m.bias + sum(m.linear[i] * a for i, a in items) + pairs


def test_scores_equal_the_sum_over_all_pairs():
    m = machine()
    got = m.scores(pa.array([*TEXTS, None]), pa.array([len(t) for t in TEXTS] + [None], pa.int64()))
    want = [1 / (1 + np.exp(-plain_y(m, t, len(t)))) for t in TEXTS] + [1 / (1 + np.exp(-plain_y(m, "", -1)))]
    assert np.allclose(got, want, atol=1e-6)


def test_slopes_are_those_of_the_loss():
    m = machine()
    stats, n_words, word, value = (np.concatenate(x) for x in zip(*(vector_of(t, 5) for t in TEXTS), strict=True))
    rows, label, weight = m.rows(stats, n_words, word, value), np.arange(len(TEXTS)) % 2, np.linspace(0.5, 2, len(TEXTS))

    def loss():
        p = 1 / (1 + np.exp(-m.raw(*rows)[0]))
        return -(weight * np.where(label == 1, np.log(p), np.log(1 - p))).sum()

    bias, linear, factors = m.gradient(*rows, label, weight)
    for at in np.unique(rows[1])[::7]:
        for array, slope in ((m.linear, linear[at]), (m.factors[:, 2], factors[at, 2])):
            array[at] += 1e-5
            up = loss()
            array[at] -= 2e-5
            assert abs((up - loss()) / 2e-5 - slope) < 1e-4
            array[at] += 1e-5
    m.bias += 1e-5
    up = loss()
    m.bias -= 2e-5
    assert abs((up - loss()) / 2e-5 - bias) < 1e-4


def test_statistics_of_structure():
    stats = dict(zip(fm.STATISTICS, vector_of(TEXTS[0], 9)[0][0], strict=True))
    assert stats["words"] == pytest.approx(np.log1p(12)) and stats["lines"] == pytest.approx(np.log1p(2))
    assert stats["words seen before"] == 9 / 12 and stats["lines seen before"] == 0.5 and stats["n_chars"] == pytest.approx(np.log(10))
    stats = dict(zip(fm.STATISTICS, vector_of("no no no yes 7 #", -1)[0][0], strict=True))
    assert stats["longest run"] == pytest.approx(np.log1p(3)) and stats["words as the one before"] == 2 / 5
    assert stats["symbols"] == 1 / 16 and stats["digits"] == 1 / 16 and stats["n_chars"] == -1


def test_it_tells_held_out_documents_apart(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op11_factorisation(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.98 * len(good)


def test_reruns_agree_however_rows_are_dealt(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one, other = fm.fit(docs.coalesce(1), labels), fm.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(one.linear, other.linear) and np.array_equal(one.factors, other.factors)


def test_odd_rows(spark):
    texts = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (20, None), (20, "twice"), (21, "y " * 400_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n_chars": F.when(F.col("doc_id") % 2 == 0, F.length("text")), "SCORE": F.lit("mine"), "label": F.lit(9)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(None, 1), (3, None), (20, 0), (20, 1), (99, 1)], "doc_id long, quality int")
    out = fm.score(docs, fm.fit(docs, labels))
    assert "SCORE" not in out.columns and out.columns.count("score") == 1
    rows = out.collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    for few, value in ((labels.where("quality = 1"), 1.0), (labels.where("false"), 0.0)):
        assert fm.fit(docs, few) == value
        assert {r.score for r in fm.score(docs, value).collect()} == {value}
    assert fm.score(docs.where("false"), fm.fit(docs, labels)).count() == 0
    assert fm.fit(docs.where("false"), labels) == 0.0
    assert fm.score(docs.drop("n_chars"), fm.fit(docs.drop("n_chars"), labels)).count() == len(texts)
