"""The methods inside the training-data operators beside enumeration, and cases that each operator has to bear."""

import itertools
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plexgraph.llm import bpe, langid, media, minhash_dedup, mixing, pseudo_likelihood, quality, suffix_dedup, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


class PlainKneserNey:
    """Probabilities of symbols in contexts by the recursion, from counts in dictionaries."""

    def __init__(self, words, order):
        self.order, self.top = order, [Counter(), Counter()]
        for word, toxic, n in words:
            symbols = [*word.encode(), toxicity.END]
            for i, s in enumerate(symbols):
                self.top[toxic][(*[toxicity.START] * max(order - 1 - i, 0), *symbols[max(i - order + 1, 0) : i], s)] += n
        self.levels, grams = {}, set(self.top[0] + self.top[1])
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in grams)
            grams = set(self.levels[k])

    @staticmethod
    def one(counts, gram, backoff):
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = once / (once + 2 * twice) if once and twice else 0.75
        assert 0 < d < 1
        return (max(counts.get(gram, 0) - d, 0) + d * len(own) * backoff) / sum(own.values()) if own else backoff

    def shared(self, gram):
        p = 1 / toxicity.SYMBOLS
        for k in range(1, self.order):
            p = self.one(self.levels[k], gram[-k:], p)
        return self.one(self.top[0] + self.top[1], gram, p)

    def p(self, toxic, gram):
        return self.one(self.top[toxic], gram, self.shared(gram))

    def ratio(self, word):
        symbols = [*word.encode(), toxicity.END]
        grams = [(*[toxicity.START] * max(self.order - 1 - i, 0), *symbols[max(i - self.order + 1, 0) : i], s) for i, s in enumerate(symbols)]
        return sum(np.log(self.p(1, g)) - np.log(self.p(0, g)) for g in grams)


KN_WORDS = [("vile", 1, 4), ("vile", 0, 1), ("rot", 1, 2), ("rotten", 1, 1), ("good", 0, 5), ("gold", 0, 2), ("goat", 1, 1), ("day", 0, 3), ("day", 1, 3), ("é", 0, 1), ("vilest", 1, 1)]


def kn_model(order):
    word = pa.array([w.encode() for w, _, _ in KN_WORDS], pa.binary())
    return toxicity.Model(word, np.array([t for _, t, _ in KN_WORDS]), np.array([n for _, _, n in KN_WORDS]), order), PlainKneserNey(KN_WORDS, order)


@pytest.mark.parametrize("order", [3, 5])
def test_kneser_ney_adds_up_to_one(order):
    _, plain = kn_model(order)
    for context in [g[:-1] for g in list(plain.top[1] + plain.top[0])[::5]] + [(1,) * (order - 1)]:
        for k in (0, 1):
            assert sum(plain.p(k, (*context, s)) for s in range(toxicity.SYMBOLS)) == pytest.approx(1)


@pytest.mark.parametrize("order", [3, 5])
def test_toxicity_features_recomputed_word_by_word(order):
    model, plain = kn_model(order)
    texts = ["Vile rot, GOOD day", "good", "", None, "unknown viles! é", "day day vile"]
    found = model.features(pa.array(texts))
    for text, row in zip(texts, found, strict=True):
        each = [plain.ratio(w.lower()) for w in (text or "").replace(",", " ").replace("!", " ").split()]
        assert row == pytest.approx([sum(each) / len(each), max(each)] if each else [0, 0], abs=1e-5)
    model.calibrate(found[[0, 1, 4, 5]], np.array([1, 0, 1, 1]), np.ones(4))
    assert (model.weights[:2] >= 0).all()
    assert model.score(found) == pytest.approx([1 / (1 + np.exp(-(x @ model.weights[:2] + model.weights[2]))) for x in found])


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.7), ("sf0.1", 0.8)])
def test_toxicity_of_the_tables_held_out(spark, sf, least):
    d = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs.where(toxicity.held_out()), model).select("toxic", "score").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good)) >= least
    assert (model.weights[:2] >= 0).all() and model.weights[0] + model.weights[1] > 0


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(5)
    field = langid.Field(["a", "b", "c"])
    field.transitions = rng.normal(size=(3, 3)).astype(np.float32)
    scores, row = rng.normal(size=(9, 3)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    found = field.marginals(scores, row)
    for r in set(row):
        own = scores[row == r]
        expected = np.zeros_like(own)
        for labels in itertools.product(range(3), repeat=len(own)):
            weight = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(field.transitions[x, y] for x, y in itertools.pairwise(labels)))
            for i, x in enumerate(labels):
                expected[i, x] += weight
        assert np.allclose(found[row == r], expected / expected.sum(1, keepdims=True), atol=1e-6)


def test_word_languages_follow_a_switch(spark):
    field = langid.Field(["aa", "bb"])
    field.fit(["kato keto kito " * 30, "schum schim scham " * 30] * 3, np.array([0, 1] * 3))
    docs = spark.createDataFrame([(1, "kato keto kito kato schim schum scham schum"), (2, None), (3, "12 -")], "doc_id long, text string")
    rows = {r.doc_id: r.word_langs for r in langid.word_languages(docs, field).collect()}
    assert rows == {1: ["aa"] * 4 + ["bb"] * 4, 2: [], 3: []}


def _network(seed=0, words=40):
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, 1 << 63, words, dtype=np.uint64)
    counts = np.arange(words, 0, -1)
    entries = pseudo_likelihood.shared_entry(codes)
    known = pseudo_likelihood.Vocabulary(codes[:30], counts[:30], np.bincount(entries, counts, 64), np.bincount(entries, minlength=64), top=20)
    return codes, pseudo_likelihood.Network(known)


def test_probabilities_of_all_words_add_up_to_one():
    codes, network = _network()
    around = np.tile(np.array([[1, 2, 3, 1024]]), (1024, 1))
    entries = np.exp(network.log_probabilities(np.arange(1024), around).astype(np.float64))
    assert entries.sum() == pytest.approx(1, abs=1e-4)
    entry, share = network.words.find(codes)
    for e in set(entry[entry >= pseudo_likelihood.TOP].tolist()):
        unseen = np.exp(network.words.rest[e - pseudo_likelihood.TOP])
        assert np.exp(share[entry == e]).sum() + unseen == pytest.approx(1, abs=1e-5)


def test_gradient_of_the_network(monkeypatch):
    _, network = _network(2)
    rng = np.random.default_rng(1)
    own, around = rng.integers(0, 1024, 64), rng.integers(0, 1025, (64, 4))
    monkeypatch.setattr(pseudo_likelihood, "RATE", 1e-3)
    loss = lambda: -float(network.log_probabilities(own, around).astype(np.float64).mean())
    for name, at in (("inner", (3, 4)), ("klass", (2, int(own[0]) % 32)), ("word_bias", (int(own[0]) % 32, int(own[0]) // 32)), ("embed", (int(around[0, 0]), 1))):
        before = network.flat()
        squares = {n: np.zeros(s, np.float32) for n, s in pseudo_likelihood.Network.SHAPES.items()}
        network.learn(own, around, squares)
        slope = np.sqrt(squares[name][at])  # after one step the squares are those of the slopes
        network.take(before)
        ends = []
        for step in (1e-2, -1e-2):
            network.p[name][at] += step
            ends.append(loss())
            network.p[name][at] -= step
        assert abs(ends[0] - ends[1]) / 2e-2 == pytest.approx(slope, rel=0.05, abs=2e-4)


def test_each_word_is_a_target_in_one_round():
    code, row = np.arange(50, dtype=np.uint64) * np.uint64(7919), np.repeat([0, 1, 4], [20, 1, 29])
    turns = [pseudo_likelihood._targets(code, row, t, 3) for t in range(3)]
    assert (np.sum(turns, 0) == 1).all()


def test_fingerprint_against_plain_sums():
    rng = np.random.default_rng(2)
    samples = rng.integers(40, 200, 192 * 9).astype(np.uint8)
    window, peaks = np.hanning(384), []
    frames = [(samples[a : a + 384].astype(float) - 128) * window for a in range(0, len(samples) - 383, 192)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(193), np.arange(384)) / 384)
    power = np.abs(np.array([turn @ f for f in frames]))
    for t, k in itertools.product(range(len(frames)), range(4)):
        low, high = media.BANDS[k]
        own = power[t, low:high].max()
        if all(own >= power[s, low:high].max() for s in (t - 1, t + 1) if 0 <= s < len(frames)):
            peaks.append((t, low + int(power[t, low:high].argmax())))
    expected = sorted((a[0], a[1] << 16 | b[1] << 4 | b[0] - a[0]) for i, a in enumerate(peaks) for b in peaks[i + 1 : i + 1 + media.FAN] if b[0] - a[0] <= media.REACH)
    assert list(zip(*(x.tolist() for x in media.fingerprint(samples.tobytes())))) == expected


def test_chunks_of_runs_are_counted_in_little_memory(monkeypatch):
    """A chunk and what is left of a task take a few times the bytes of a chunk's runs, and the reports are those of plain counting."""
    monkeypatch.setattr(minhash_dedup, "CHUNK", 1 << 18)
    rng = np.random.default_rng(5)
    per_text = [np.unique(rng.integers(0, 1 << 20, 1 << 10)).astype(np.uint64) for _ in range(500)]
    given = iter(per_text)
    monkeypatch.setattr(minhash_dedup, "blocks", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    monkeypatch.setattr(minhash_dedup, "weighted_runs", lambda *_: (next(given).copy(), None, None))
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(per_text))], ["text"])
    tracemalloc.start()
    try:
        rows = [(b.column("run").to_numpy(), b.column("n").to_numpy(), b.column("slack").to_numpy()) for b in minhash_dedup._reports(0.006)([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    run, n, slack = map(np.concatenate, zip(*rows))
    kinds, counts = np.unique(np.concatenate(per_text), return_counts=True)
    assert dict(zip(run.tolist(), n.tolist())) == dict(zip(kinds[counts >= 3].tolist(), counts[counts >= 3].tolist())) | {-1: 500} and set(slack.tolist()) == {2}
    assert peak < 6 * 8 * minhash_dedup.CHUNK


def test_document_frequencies_against_counting(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CHUNK", 200)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, 12)) for _ in range(120)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    weights = minhash_dedup.run_weights(docs, share=0.1)
    counts = Counter()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        counts.update(minhash_dedup.weighted_runs(data, np.array([0, len(data)]), None)[0].tolist())
    assert dict(zip(weights.runs.tolist(), np.round(weights.logs, 9))) == {r: round(float(np.log(1 + 120 / n)), 9) for r, n in counts.items() if n >= 12}


def test_recall_of_links_against_all_pairs(spark):
    rng, texts = np.random.default_rng(8), []
    for _ in range(40):  # versions of a text with few or many changed words
        base = [f"v{x}" for x in rng.integers(0, 10**6, 150)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4):
            changed = list(base)
            for at in rng.integers(0, 150, edits):
                changed[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(changed))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    weights = minhash_dedup.run_weights(docs.select("text"))
    sets = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        run, _, weight = minhash_dedup.weighted_runs(data, np.array([0, len(data)]), weights)
        sets.append(dict(zip(run.tolist(), weight.tolist())))
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i // 5 * 5, i):
            shared = sum(min(a[r], sets[j][r]) for r in a.keys() & sets[j].keys())
            if shared >= 0.8 * (sum(a.values()) + sum(sets[j].values()) - shared):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    rows = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    linked = [i for i in range(len(texts)) if label[i] != i]
    assert len(linked) > 40 and sum(rows[i] == label[i] for i in linked) / len(linked) >= 0.9
    assert all(rows[i] == i or rows[i] // 5 == i // 5 for i in range(len(texts)))


def test_bpe_on_every_code_point_and_a_long_word():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b" for c in points[k : k + 50_000]]
        assert [own.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    word = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 200_000))
    assert own.encode(word) == library.encode(word, add_special_tokens=False).ids


def _operators(docs, labels):
    """Each operator on a table of documents."""
    model, field = toxicity.fit(docs, labels), langid.fit(docs)
    network = pseudo_likelihood.train(docs.select("text"))
    pages = docs.selectExpr("doc_id as page_id", "concat('http://', text) as url", "1 as Host", "2 as w0", "3 as block")
    return {
        "minhash": minhash_dedup.near_duplicates(docs), "bpe": bpe.decode(bpe.encode(docs)), "toxicity": toxicity.score(docs, model), "language": langid.predict(docs, field),
        "mixing": mixing.mix(docs), "media": media.media_features(docs), "urls": urls.judge(pages, pages.select("url")), "suffix": suffix_dedup.remove_repeats(docs),
        "quality": quality.judge(docs), "likelihood": pseudo_likelihood.score(docs, network),
    }


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, rows in _operators(docs, docs.selectExpr("doc_id", "1 as toxic")).items():
        assert rows.count() == 0, name


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    texts = ["x" * 1_000_000, "ab cd ef gh ij kl " * 60_000, "same words in a row of six", "same words in a row of six", None, "", "é"]
    rows = [(i if i != 3 else 2, t, "aa", "s", None) for i, t in enumerate(texts)] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as Score", "2 as row", "3 as id", "4 as lang_pred", "5 as n_words", "6 as pll", "7 as verdict", "8 as size", "9 as text_a", "10 as k1", "11 as doc", "12 as Kept")
    for name, out in _operators(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")).items():
        assert out.count() == len(rows), name


def test_run_weights_over_more_than_a_thousand_documents(spark):
    """Exact frequencies of all runs in a thousandth of 3,000 documents or more, by counting; the others weigh as if they were in that share."""
    dice = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in dice.zipf(1.6, 12) % 7) if k % 3 else f"common words stand at the front {k} " + " ".join(f"x{x}" for x in dice.integers(0, 40, 6)) for k in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    weights = minhash_dedup.run_weights(df)
    data, offsets = minhash_dedup.string_bytes(pa.array(texts))
    run, _, _ = minhash_dedup.weighted_runs(data[: offsets[2000]], offsets[:2001], None)
    rest, _, _ = minhash_dedup.weighted_runs(data[offsets[2000] :], offsets[2000:] - offsets[2000], None)
    counted = Counter(np.r_[run, rest].tolist())  # distinct in a document, so these are document frequencies
    keys = np.array(list(counted), np.uint64)
    n = np.array(list(counted.values()))
    assert (n < 3).any() and (n == 3).any() and (n > 500).any() and len(texts) > 1000
    expected = np.where(n >= 0.001 * len(texts), np.log(1 + len(texts) / n), np.log(1 + 1 / 0.001))
    assert np.allclose(weights.of(keys), expected)
