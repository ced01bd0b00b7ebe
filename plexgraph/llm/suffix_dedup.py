"""Removal of byte passages that occur more than once in a corpus.

Every byte covered by a string of `span` bytes that also starts elsewhere, in
the same or another document, is found, by suffix order:

1. Each window of `span` bytes belongs to a content-defined anchor (anchors.py);
   equal windows have equal anchors. Counts of (anchor, segment) show which
   segments are copies as a whole and which anchors have several segments. Whole
   copies are decided by 64-bit hashes; equal strings go on as one.
2. The distinct segments of such an anchor meet in one task, and column-wise
   construction of their Burrows-Wheeler transform and common prefixes
   (bwt_collection.py) shows which of their windows occur twice.
3. Where an anchor has more than `hot` distinct segments, they are dealt anew, and
   again until no group is larger: each is cut in two by where the anchor lies in
   its windows, and the longer string that all windows of a part have in common is
   the part's key. Equal windows stay in one group; after eight turns a group would
   be one window. So no task gathers more than `hot` segments, and none is left out.

Cases: null and empty texts, and texts shorter than `span`, lose nothing.
Equal texts of at least `span` bytes lose everything. Repeated rows count as
separate places. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.anchors import gram_codes, segments
from plexgraph.llm.bwt_collection import Files, repeated_windows
from plexgraph.llm.runtime import discard, stored, text_keys
from plexgraph.llm.textvec import mix64, span_hashes, string_bytes

SPAN = 200
#: Distinct segments of an anchor, or of parts with one key, that may meet in one task.
HOT = 4096
#: A segment with more than this part of all places is a hot one.
HOT_SEGMENTS = 1 << 15
#: Bytes of segments in one collection; more only where one anchor has more.
COLLECTION_BYTES = 48_000


def _distinct_texts(batch: pa.RecordBatch, span: int, known: set | None = None):
    """(bytes, row, copies in the batch) of each distinct text of at least span bytes that isn't known yet; with known, it becomes so."""
    raw, at = string_bytes(batch.column("text"))
    keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
    copies, first = {}, {}
    for i in np.flatnonzero(np.diff(at) >= span).tolist():
        copies[keys[i]] = copies.get(keys[i], 0) + 1
        first.setdefault(keys[i], i)
    for key, i in first.items():
        if known is None or key not in known:
            yield raw[at[i] : at[i + 1]], i, copies[key]
            if known is not None:
                known.add(key)


def _batches(rows, names: list[str]):
    """Lists of columns to record batches of about 20,000 rows."""
    held, size = [], 0
    for columns in rows:
        held.append(columns)
        size += len(columns[0])
        if size > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _counted_segments(span: int):
    """Segments of all texts; n: the copies of the text, summed within a batch so that copies of one text don't pile up."""

    def columns(batches):
        for batch in batches:
            for data, _, copies in _distinct_texts(batch, span):
                _, _, anchor, seg = segments(data, span)
                yield anchor.view(np.int64), seg.view(np.int64), np.full(len(seg), copies, np.int64)

    return lambda batches: _batches(columns(batches), ["anchor", "seg", "n"])


def _placed_segments(span: int):
    """Segments with their places in a text, once for equal texts of a task."""

    def columns(batches):
        known = set()
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for data, i, _ in _distinct_texts(batch, span, known):
                first, last, anchor, seg = segments(data, span)
                yield np.full(len(first), k1[i]), np.full(len(first), k2[i]), anchor.view(np.int64), seg.view(np.int64), first.astype(np.int32), last.astype(np.int32)

    return lambda batches: _batches(columns(batches), ["k1", "k2", "anchor", "seg", "first", "last"])


def _cut_pieces(span: int):
    """Rows of (text, list of segments) to rows of one segment with its bytes."""

    def rows(batches):
        for batch in batches:
            raw, at = string_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            lists = wanted.flatten()
            sizes = np.diff(wanted.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = at[row] + lists.field("first").to_numpy()
            last = at[row] + lists.field("last").to_numpy() + span
            for a in range(0, len(row), 20_000):
                part = slice(a, a + 20_000)
                pieces = pa.array([raw[x:y].tobytes() for x, y in zip(first[part], last[part])], pa.binary())
                yield pa.RecordBatch.from_arrays([lists.field("anchor")[part], lists.field("seg")[part], lists.field("copies")[part], lists.field("kinds")[part], pieces], ["anchor", "seg", "copies", "kinds", "piece"])

    return rows


def _runs(starts: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes that windows at these sorted starts cover."""
    cut = np.flatnonzero(np.diff(starts) > span)
    return starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + span).tolist()


def _collections(span: int):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])

    def solve(held, files):
        out = []
        for (_, anchor, seg, at, copies, _), starts in zip(held, repeated_windows([h[5] for h in held], span, files)):
            if copies == 1 and len(starts):
                out.append((anchor, seg, *_runs(starts + at, span)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else None

    def rows(batches):
        held, size = [], 0
        with Files() as files:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "anchor", "seg", "at", "copies", "piece"))):
                    if size > COLLECTION_BYTES and row[0] != held[-1][0]:
                        if (done := solve(held, files)) is not None:
                            yield done
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
            if held and (done := solve(held, files)) is not None:
                yield done

    return rows


def _halves(span: int, level: int):
    """Parts of the pieces of crowded groups: the windows whose anchor lies in one half of the places of this level."""
    names = ["key", "part", "anchor", "seg", "at", "copies", "piece"]
    width = 128 >> level

    def rows(batches):
        for batch in batches:
            out = []
            for key, anchor, seg, at, copies, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "anchor", "seg", "at", "copies", "piece"))):
                data = np.frombuffer(piece, np.uint8)
                gram = int(np.argmin(gram_codes(data)))  # the anchor, which all windows share
                side = (gram - np.arange(len(data) - span + 1)) // width
                for a, b in zip(first := np.flatnonzero(np.r_[True, side[1:] != side[:-1]]), np.r_[first[1:], len(side)]):
                    low = int(side[a]) * width  # places of the anchor: from low to low + width - 1
                    shared = span_hashes(data, np.array([gram - low]), np.array([gram - low - width + 1 + span]))
                    whole = span_hashes(data, np.array([a]), np.array([b - 1 + span]))
                    new = mix64(shared + np.uint64(key & (1 << 63) - 1) + np.uint64(int(side[a]) + 1))
                    part = mix64(whole + np.uint64(int(gram - a)))
                    out.append((int(new.view(np.int64)[0]), int(part.view(np.int64)[0]), anchor, seg, at + int(a), copies, piece[a : b - 1 + span]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names)

    return rows


def _wanted_segments(keyed: DataFrame, span: int) -> DataFrame:
    """(anchor, seg, copies, kinds) of the segments of which windows may repeat."""
    counted = keyed.select("k1", "k2", "text").mapInArrow(_counted_segments(span), "anchor long, seg long, n long")
    sums = counted.groupBy("anchor", "seg").agg(F.sum("n").alias("copies"))
    kinds = sums.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("copies").alias("most")).where("kinds > 1 or most > 1")
    return stored(sums.join(kinds.drop("most"), "anchor").where("copies > 1 or kinds > 1"), "segments")


def _nought(column: str):
    """0, but not as a literal, which the optimizer would take out of the join's keys."""
    return F.pmod(F.col(column), F.lit(1)).cast("long")


def _found(keyed: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Where those segments lie, once for each text.

    Segments of very many places are looked up in a broadcast table, which has at
    most HOT_SEGMENTS rows since each has that part of all places, and their places
    are dealt by text; the others are joined by segment.
    """
    total = wanted.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    is_hot = F.col("copies") > max(1000, total / HOT_SEGMENTS)
    placed = keyed.select("k1", "k2", "text").mapInArrow(_placed_segments(span), "k1 long, k2 long, anchor long, seg long, first int, last int")
    hot = wanted.where(is_hot).select("anchor", "seg", F.col("copies").alias("hot_copies"), F.col("kinds").alias("hot_kinds"))
    rows = placed.join(F.broadcast(hot), ["anchor", "seg"], "left").withColumn("salt", F.when(F.col("hot_copies").isNotNull(), F.col("k1")).otherwise(0))
    rows = rows.join(wanted.where(~is_hot).withColumn("salt", _nought("copies")), ["anchor", "seg", "salt"], "left")
    rows = rows.select("anchor", "seg", "k1", "k2", "first", "last", F.coalesce("hot_copies", "copies").alias("copies"), F.coalesce("hot_kinds", "kinds").alias("kinds"))
    return stored(rows.where("copies is not null").distinct(), "places")


def _pieces(keyed: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """The bytes of one place of each segment whose anchor has others."""
    one = found.where("kinds > 1").groupBy("anchor", "seg", "copies", "kinds").agg(F.min(F.struct("k1", "k2", "first", "last")).alias("at"))
    lists = one.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("anchor", "seg", "copies", "kinds", "at.first", "at.last")).alias("wanted"))
    # one row of each text (several only if they are equal throughout): copies of a text aren't cut again
    chosen = keyed.groupBy("k1", "k2").agg(F.min("row").alias("row")).join(lists, ["k1", "k2"])
    cut = keyed.join(chosen, ["k1", "k2", "row"]).select("text", "wanted").mapInArrow(_cut_pieces(span), "anchor long, seg long, copies long, kinds long, piece binary")
    return cut.dropDuplicates(["anchor", "seg"]).select(F.col("anchor").alias("key"), "anchor", "seg", F.lit(0).alias("at"), "copies", "piece", "kinds")


def _covered(pieces: DataFrame, crowded: bool, span: int, hot: int) -> DataFrame:
    """(anchor, seg, low, high): repeated runs in segments that are no copies as a whole."""
    covered, level = [], 0
    in_order = lambda df: df.repartition("key").sortWithinPartitions("key", "anchor", "seg", "at")
    solved = lambda df: in_order(df).mapInArrow(_collections(span), "anchor long, seg long, low array<int>, high array<int>")
    while crowded:
        pieces = stored(pieces, "pieces")
        covered.append(stored(solved(pieces.where(F.col("kinds") <= hot)), "covered"))
        parts = stored(pieces.where(F.col("kinds") > hot).mapInArrow(_halves(span, level), "key long, part long, anchor long, seg long, at int, copies long, piece binary"), "parts")
        discard(pieces)
        same = parts.groupBy("key", "part").agg(F.sum("copies").alias("total"), F.min(F.struct("anchor", "seg", "at")).alias("one"))
        kinds = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
        same = stored(same.join(kinds, "key").where("kinds > 1 or total > 1"), "same")
        joined = parts.join(same, ["key", "part"])
        copied = joined.where("total > 1 and copies = 1")  # a part that is a copy as a whole
        covered.append(stored(copied.select("anchor", "seg", F.array("at").alias("low"), F.array(F.col("at") + F.length("piece")).alias("high")), "covered"))
        pieces = joined.where((F.struct("anchor", "seg", "at") == F.col("one")) & (F.col("kinds") > 1)).select("key", "anchor", "seg", "at", F.col("total").alias("copies"), "piece", "kinds")
        crowded = bool(same.where(F.col("kinds") > hot).limit(1).count())
        level += 1
    covered.append(solved(pieces))
    rows = covered[0]
    for more in covered[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("anchor", "seg").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high")) if level else rows


def _row_hash(docs: DataFrame, text: str):
    """A hash of the columns beside the text: the same on each reading, unlike a row's number."""
    plain = [f.name for f in docs.schema.fields if f.name != text and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0).cast("long")


def repeated_spans(docs: DataFrame, span: int = SPAN, text: str = "text", hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): for each text that has any, the spans of bytes to remove, unsorted; keys as runtime.text_keys."""
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(*text_keys(column), column.alias("text"), _row_hash(docs, text).alias("row"))
    wanted = _wanted_segments(keyed, span)
    crowded = bool(wanted.where(F.col("kinds") > hot).limit(1).count())
    found = _found(keyed, wanted, span)
    discard(wanted)
    covered = stored(_covered(_pieces(keyed, found, span), crowded, span, hot), "covered")
    parts = F.when(F.col("copies") > 1, F.array(F.struct(F.col("first").alias("low"), (F.col("last") + span).alias("high")))).otherwise(
        F.transform(F.arrays_zip("low", "high"), lambda x: F.struct((x["low"] + F.col("first")).alias("low"), (x["high"] + F.col("first")).alias("high")))
    )
    # copies as a whole need no runs, so they are dealt by text
    salted = found.withColumn("salt", F.when(F.col("copies") > 1, F.col("k1")).otherwise(0))
    spans = salted.join(covered.withColumn("salt", _nought("anchor")), ["anchor", "seg", "salt"], "left").withColumn("part", parts).where("part is not null").groupBy("k1", "k2").agg(F.flatten(F.collect_list("part")).alias("spans"))
    spans = stored(spans, "spans")
    discard(found, covered)
    return spans


def _without(text: pa.Array, spans: pa.Array, whole_characters: bool = False) -> pa.Array:
    raw, at = string_bytes(text)
    offsets, flat = spans.offsets.to_numpy(), spans.flatten()
    low, high = flat.field("low").to_numpy(), flat.field("high").to_numpy()
    base = offsets[0]
    kept, removed, runs = [], [], []
    for i in range(len(text)):
        data = raw[at[i] : at[i + 1]]
        a, b = low[offsets[i] - base : offsets[i + 1] - base], high[offsets[i] - base : offsets[i + 1] - base]
        edges = np.zeros(len(data) + 1, np.int32)
        np.add.at(edges, a, 1)
        np.add.at(edges, b, -1)
        gone = np.cumsum(edges)[:-1] > 0
        if whole_characters and len(data):
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            gone = (np.bincount(character[gone], minlength=character[-1] + 1) > 0)[character]
        kept.append(data[~gone].tobytes())
        removed.append(int(gone.sum()))
        runs.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """docs with kept (binary: the bytes left), n_bytes, n_removed and n_spans (maximal removed runs).

    With whole_characters a character of which any byte is removed goes as a whole, so that kept is valid UTF-8.
    """
    spans = repeated_spans(docs, span, text, hot)
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), *text_keys(column), column.alias("text"))
    rows = rows.join(spans, ["k1", "k2"], "left")
    without = F.arrow_udf(lambda texts, found: _without(texts, found, whole_characters), "struct<kept: binary, n_removed: bigint, n_spans: bigint>")
    touched = rows.where("spans is not null").withColumn("out", without("text", "spans"))
    whole = rows.where("spans is null").withColumn("out", F.struct(F.col("text").cast("binary").alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")))
    both = touched.unionByName(whole)
    low = {"kept", "n_bytes", "n_removed", "n_spans"}
    return both.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in low], F.octet_length("text").cast("long").alias("n_bytes"), "out.n_removed", "out.n_spans", "out.kept")
