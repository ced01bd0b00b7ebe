"""Token alignment and hard negatives against plain versions."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plexgraph.llm import alignment, hard_negatives, queries

TEXTS = [
    "The quick brown fox.", "The quick brown fox.", "", None, " ", "   two  spaces ", "naïve café — 東京タワー 🙂🙃", "a▁b <s> <0x41> <unk> <|endoftext|>",
    "x" * 700, "ab" * 301 + "🙂" * 40, "ﬁne ½ Å", "tab\tline\nline\r\n\x00end", "1234567890 3.14159", "é" * 50, "don't I'll WE'RE", " 　x", "a b " * 400,
]


def plain_alignment(texts):
    """By the tokenizers library, byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a_side, b_side = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_side.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    rows, per_doc = [], []
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            rows.append((0, 0, [], Counter()))
            continue
        groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                if end_a == end_b and (groups[-1][0] or groups[-1][1]):
                    groups.append(([], []))
                groups[-1][0].append(a[i])
                end_a += len(a_bytes[i])
                i += 1
            else:
                groups[-1][1].append(b[j])
                end_b += len(b_bytes[j])
                j += 1
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        rows.append((len(a), len(b), groups, links))
    held = Counter(p for *_, links in rows for p in links)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for n_a, n_b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        per_doc.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return per_doc


@pytest.mark.parametrize("few", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_the_plain_version(spark, few):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("N_A", F.lit("mine"))
    rows = alignment.align(docs).withColumn("sha", F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups").cache()
    out = alignment.with_counts(rows, alignment.pair_counts(rows).cache(), few).orderBy("doc_id")
    assert out.columns.count("n_a") == 1 and "N_A" not in out.columns
    found = [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")) for r in out.collect()]
    assert found == plain_alignment(TEXTS)
    assert found[0] == found[1] and found[2] == found[3] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_documents_equals_the_plain_version(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op12_alignment(spark, d).collect()}
    assert out == dict(zip(texts, plain_alignment(texts.values()), strict=True))


def test_a_large_group_is_expanded_by_distinct_ids():
    aligner = alignment.Aligner(*alignment.default_paths())
    text = "x" * 30011
    columns = aligner.block([text, "y"])
    n_links, links = columns[3].to_pylist(), columns[6].to_pylist()
    assert [sum(x) for x in links] == n_links
    assert columns[4].to_pylist()[0].count(";") + 1 == columns[2].to_pylist()[0]


def test_alignment_of_an_empty_table(spark):
    rows = alignment.align(spark.createDataFrame([], "doc_id long, text string, lang string")).cache()
    assert alignment.with_counts(rows, alignment.pair_counts(rows)).count() == 0
    assert rows.columns[:3] == ["doc_id", "text", "lang"]


def plain_negatives(rows):
    import math

    rows = [(k, i, lab, [math.floor(256 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(k, i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, v) for k, i, lab, v in rows]
    out = []
    for k, i, lab, v in rows:
        if i is None or i % 50:
            continue
        order = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, m, other) for m, j, other, w in rows if m != k and len(w) == len(v))
        for s, none, j, _, _ in [x for x in order if x[4] == lab][:5]:
            fits = [x for x in order if x[4] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, None if none else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def odd_vectors():
    import random

    dice = random.Random(5)
    rows = [(i, [dice.uniform(-1, 1) + 0.4 for _ in range(6)], dice.randrange(3)) for i in range(260)]
    rows += [(50, rows[50][1], 0), (50, rows[50][1], 0), (100, None, 1), (150, [0.5] * 6, None), (200, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (300, [float("nan")] * 6, 1), (350, [float("inf")] * 6, 1)]
    rows += [(None, [0.9] * 6, 0), (None, [0.9] * 6, 1), (400, [], 1), (401, [], 1), (402, [], 2), (450, [0.3, 0.4], 0), (451, [0.3, 0.4], 0), (452, [0.3, 0.2], 1), (500, [0.0] * 6, 2)]
    return rows + [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 3) for i in range(600, 640)]


def mined(spark, rows, **keys):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).withColumn("row", F.lit("mine"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("id") % 50 == 0, label=label, **keys).collect()), key=str)


def single(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def test_hard_negatives_equal_the_plain_version(spark):
    rows = odd_vectors()
    assert mined(spark, rows) == plain_negatives(single(rows)) != []


def test_hard_negatives_in_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK_VALUES", 20)
    monkeypatch.setattr(hard_negatives, "SCORES_A_TASK", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "BLOCK_SCORES", 16)
    rows = odd_vectors()
    assert mined(spark, rows) == plain_negatives(single(rows))


def test_hard_negatives_without_rows_or_anchors(spark):
    assert mined(spark, []) == mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_large_components_are_exact():
    import numpy as np

    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, -1], [-(1 << 62), 1], [1 << 62, 0]])
    assert hard_negatives.scores(a, b).tolist() == [[(1 << 60) - 3, -(1 << 63), (1 << 63) - 1]]
