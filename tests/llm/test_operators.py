"""Training-data operators beside plain versions, and their edge cases."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest

from plexgraph.llm import bpe, langid, media, minhash_dedup, mixing, pseudo_likelihood, quality, suffix_dedup, toxicity, urls
from plexgraph.llm.bwt_collection import Files, repeated_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang"), more.get("source"), None) for i, t in enumerate(texts)], SCHEMA)


def sentences(n, seed=0, size=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmnop") for _ in range(size)) for _ in range(n)]


EDGES = [None, "", " \n\t", "one", "one", "é" * 300, "ab " * 5000]


def test_windows_of_a_collection_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(20):
        strings = [rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8).tobytes() for _ in range(12)]
        span = int(rng.integers(1, 9))
        counts = Counter(s[i : i + span] for s in strings for i in range(len(s) - span + 1))
        with Files() as files:
            found = repeated_windows(strings, span, files)
        for s, got in zip(strings, found):
            assert list(got) == [i for i in range(len(s) - span + 1) if counts[s[i : i + span]] > 1]


def removed(texts, span):
    counts = Counter()
    for t in texts:
        b = (t or "").encode()
        counts.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if counts[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [4096, 2, 1])
def test_suffix_dedup_against_counting(spark, hot):
    base = sentences(12)
    passage = base[0] * 2
    texts = [*EDGES, *base, base[3], *(f"{s} {passage[:400]} {s[:30]}" for s in sentences(9, 5))]
    # one anchor with many surroundings: copies of a passage that is shorter or longer than a window, cut at each end
    texts += [f"{s[:60]}{passage[i % 7 : 190 + 5 * i]}{s[60:150]}" for i, s in enumerate(sentences(14, 6))]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs_of(spark, texts), 200, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 200)


def test_near_duplicates_against_all_pairs(spark):
    base = sentences(10, 3, 120)
    near = [s.replace(s.split()[5], "zzz", 1) for s in base[:4]]
    texts = [*base, *near, base[0], None, "", "one", "one"]
    rows = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [rows[10 + i].class_id for i in range(4)] == [0, 1, 2, 3] and rows[14].class_id == 0
    assert rows[15].class_id == 15 and rows[16].class_id == 16 and rows[18].class_id == 17
    assert sum(r.representative for r in rows.values()) == 10 + 3


def test_near_duplicates_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PAIRED", 3)
    base = sentences(1, 9, 200)[0].split()
    texts = [" ".join([*base[:i], f"edit{i}", *base[i + 1 :]]) for i in range(20)]
    assert {r.class_id for r in minhash_dedup.near_duplicates(docs_of(spark, texts)).collect()} == {0}


def test_chains_in_crowded_buckets_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PAIRED", 1)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 7)
    rng = random.Random(4)
    texts = []
    for size in (24, 1, 15):  # versions of one text, each an edit of one before it
        versions = [[f"w{rng.randrange(10**6)}" for _ in range(60)]]
        while len(versions) < size:
            words = list(rng.choice(versions[-3:]))
            at = rng.randrange(5, 55)
            versions.append([*words[:at], f"e{len(texts)}x{len(versions)}", *words[at + 1 :]])
        texts += [" ".join(v) for v in versions]
    docs = docs_of(spark, texts)
    weights = minhash_dedup.run_weights(docs.select("text"))
    sets = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        run, _, weight = minhash_dedup.weighted_runs(data, np.array([0, len(data)]), weights)
        sets.append(dict(zip(run.tolist(), weight.tolist())))
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = sum(min(a[r], b[r]) for r in a.keys() & b.keys())
            if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    rows = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == label


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [*EDGES, "It's  a Test: naïve ΣΑΣ 123 <|endoftext|>tail 中文 😀\x1cx", "don't'S"]
    rows = bpe.decode(bpe.encode(docs_of(spark, texts))).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_media_round_trip(spark):
    for r in media.media_features(media.media_files(docs_of(spark, EDGES), to="wav")).collect():
        raw = (r.text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        with wave.open(io.BytesIO(bytes(r.wav))) as file:
            assert file.readframes(file.getnframes()) == full
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert len(r.times) == len(r.codes)


def test_mixing_comes_near_its_targets(spark):
    texts = [("w " * (i % 50)).strip() for i in range(900)]
    rows = [(i, t, None, [None, "a", "b", "ç"][i % 4] if i % 3 else "a", None) for i, t in enumerate(texts)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("doc.source", "size", "source_size", "target", "taken").collect()
    total = sum(r["size"] for r in mixed)
    targets = {r.source: r.target for r in mixed}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for source, target in targets.items():
        own = [r for r in mixed if r.source == source]
        assert target <= 2 * own[0].source_size + 1e-6 and abs(sum(r.taken for r in own) - target) <= 50
        assert all(r.taken <= 2 * r["size"] for r in own)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.A.example.net/en/x"), (2, "http://a.net"), (3, "ftp://b.org/x.html?q"), (4, None), (5, "nothing"), (6, "http://c.org/y/")], "page_id long, url string")
    listed = spark.createDataFrame([("b.org/x",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    assert got == {1: ("www.a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.net", "", None, "allow"), 3: ("b.org", "/x.html", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("c.org", "/y/", None, "allow")}


def test_quality_against_counting(spark):
    texts = [*EDGES, "a b c d e f a b c d e f g h", "x\nx\n\n y #*\nx"]
    for r in quality.judge(docs_of(spark, texts)).collect():
        w = WORD.findall(r.text or "")
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(4)
    words = {"aa": ["kato", "keto", "kito"], "bb": ["schum", "schim", "scham"]}
    texts = [(i, " ".join(rng.choice(words[lang]) + rng.choice("xyz") for _ in range(30)), lang, None, None) for i in range(60) for lang in [["aa", "bb"][i % 2]]]
    docs = spark.createDataFrame([*texts, (90, None, "aa", None, None), (91, "1 2 —", "aa", None, None), (None, "kato", None, None, None)], SCHEMA)
    held = toxicity.held_out(parts=3, part=1)
    rows = langid.predict(docs, langid.fit(docs.where(~held))).where("doc_id < 60").collect()
    assert all(r.lang == r.lang_pred for r in rows)
    rest = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).where("doc_id >= 90").collect()}
    assert rest == {90: ("und", 0.0), 91: ("und", 0.0)}
    assert langid.predict(docs, langid.fit(docs.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_toxicity_on_held_out_texts(spark):
    plain = sentences(400, 8, 30)
    rows = [(i, t + (" vile scum rot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(plain)]
    docs = spark.createDataFrame([*rows, (None, "x", 1), (500, None, 0), (501, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where(~toxicity.held_out()))
    got = toxicity.score(docs.where(toxicity.held_out()), model).where("doc_id < 400").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got) > 0.95
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == 403
    assert toxicity.fit(docs, docs.where("toxic = 0")) == 0.0


def test_each_word_is_a_target_of_training():
    from types import SimpleNamespace

    import pyarrow as pa

    none = np.zeros(0, np.int64)
    network = pseudo_likelihood.Network(pseudo_likelihood.Vocabulary(np.zeros(0, np.uint64), none, np.zeros(64, np.int64), np.zeros(64, np.int64)))
    texts = [*sentences(30, 8, 50), "one", "", "a b c"]
    learned = list(pseudo_likelihood._training(SimpleNamespace(value=network))(iter([pa.record_batch([pa.array(texts)], ["text"])])))
    assert {w for batch in learned for w in batch.column("weight").to_pylist()} == {30 * 50 + 4.0}


def test_pseudo_likelihood_prefers_what_it_knows(spark):
    docs = docs_of(spark, ["to be or not to be that is the question " * 40] * 60 + [None, "", "zz yy xx ww vv " * 20])
    rows = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs.select("text"), rounds=1)).collect()
    assert rows[0].mean_pll > rows[62].mean_pll and rows[0].n_words == 400
    assert rows[60].n_words == 0 and rows[60].pll == 0 and rows[60].mean_pll is None


def test_extra_columns_of_clashing_names(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", None]).selectExpr("*", "1 as kept", "2 as score", "3 as Class_ID", "4 as n", "5 as k1", "6 as row", "7 as out")
    assert quality.judge(docs).count() == 3 and suffix_dedup.remove_repeats(docs).count() == 3
    near = minhash_dedup.near_duplicates(docs)
    assert near.count() == 3 and near.columns.count("class_id") == 1
    assert bpe.encode(docs).count() == 3 and media.media_features(docs).count() == 3 and mixing.curriculum(docs).columns == docs.columns


def test_pipeline_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert sorted(out.columns) == sorted(docs.columns), name
        assert 0 < out.count() <= 2 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_sends_texts_to_python_in_batches_bounded_by_bytes(spark):
    import corpus_pipeline
    import pyarrow as pa

    names = [f"spark.sql.{name}" for name in ("execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")]
    before = {name: spark.conf.get(name) for name in names}
    docs = spark.range(2_000, numPartitions=1).selectExpr("id as doc_id", "repeat('abcdefgh', 1000) as text", "'en' as lang", "'a' as source", "8000L as n_chars")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    try:
        corpus_pipeline.mixed_sources(spark, docs, "")
        found = docs.select("text").mapInArrow(sizes, "rows long, size long").collect()  # 16 MB, one batch before
        assert sum(r.rows for r in found) == 2_000 and max(r.size for r in found) <= 4.5 * 2**20
        spark.conf.set(names[0], "1m")
        corpus_pipeline.mixed_sources(spark, docs, "")
        assert spark.conf.get(names[0]) == str(1 << 20)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_bpe_lets_go_of_the_words_of_a_task(spark):
    import pyarrow as pa

    path = bpe.default_vocabulary()
    docs = docs_of(spark, [" ".join(sentences(20, k)) for k in range(40)])
    ids = [r.token_ids for r in bpe.encode(docs, path).orderBy("doc_id").collect()]
    own = bpe.Codec(path)
    assert ids == [own.encode(r.text) for r in docs.orderBy("doc_id").collect()]
    held = lambda _: [pa.RecordBatch.from_pydict({"n": [len(bpe.codec(path).words)]})]
    assert {r.n for r in spark.range(8, numPartitions=4).mapInArrow(held, "n long").collect()} == {1}


def test_pipeline_takes_out_whole_characters(spark):
    import corpus_pipeline

    passage, other = "é" * 150, sentences(4, 3)
    # the passage is 300 bytes from an even byte on; the cut of the shifted one falls inside characters
    docs = docs_of(spark, [other[0] + passage, other[1] + passage, other[2] + "\u00c9\u00e9" * 110, other[3] + "\ufffd" + "\u20ac\u00e9" * 90, None, ""])
    rows = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert rows[0] == other[0] and rows[1] == other[1]
    assert rows[2] == other[2] and rows[3] == other[3] + "\ufffd"
    assert rows[4] is None and rows[5] == ""


def test_runs_that_end_inside_a_character():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    spans = pa.array([[{"low": 1, "high": 3}], [{"low": 0, "high": 1}], []], kind)
    out = suffix_dedup._without(pa.array(["aéé\ufffd", "€b", ""]), spans, whole_characters=True).to_pylist()
    assert [(r["kept"].decode(), r["n_removed"], r["n_spans"]) for r in out] == [("aé\ufffd", 2, 1), ("b", 3, 1), ("", 0, 0)]
    spans = pa.array([[{"low": 2, "high": 4}]], kind)
    assert suffix_dedup._without(pa.array(["aéé"]), spans, whole_characters=True).to_pylist()[0]["kept"] == b"a"


def test_url_filter_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = ["https://www.a.com/x/", "https://b.org/fr/1", "http://c.net/1", None, "no host", "https://d.com/y.html"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(texts * 3)], "page_id long, url string")
    listed = spark.createDataFrame([("a.com/x",), ("b.org/fr/1",), ("c.net/1",), (None,)], "url string")
    read = lambda: sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, listed).collect())
    once = read()
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
    assert read() == once
    assert [v for _, _, v in once][:6] == ["block", "allow", "block", "allow", "allow", "allow"]


def test_mixing_without_ids_spreads_over_ranges(spark):
    texts = sentences(300, seed=5)
    rows = spark.createDataFrame([(None, t, "en", "a", None) for t in texts], SCHEMA)
    taken = lambda df: sorted((r.doc.text, r.taken) for r in mixing.mix(df).collect())
    got = taken(rows)
    assert len(got) == 300 and got == taken(rows.repartition(3))
    assert abs(sum(n for _, n in got) - 1.5 * 300 * 40) <= 80
    assert {n for _, n in got} == {40, 80}
