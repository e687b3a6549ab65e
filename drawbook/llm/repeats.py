"""Removal of long strings that start more than once in a corpus, by suffix sorting in shards.

A string of ``width`` bytes holds many shorter grams; the one with the least hash is its anchor. Equal strings have equal
anchors at equal places, so all starts of a string meet in the shard of its anchor. Neighbouring strings of a text mostly
share an anchor and travel as one segment. Segments whose anchor occurs once in the corpus hold no repeated string and
stay at home. A shard sorts the suffixes of its segments by external induced sorting (:mod:`drawbook.llm.induced`);
strings whose neighbour in suffix order shares ``width`` bytes are repeated. Their bytes are then cut from the texts.

Exact copies of a text, and of a segment within a task, travel once with a count, so a group of copies costs no more than
its tasks; an anchor that a task holds several times is sent on once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawbook.llm.rows import free_name
from drawbook.llm.induced import repeated_windows
from drawbook.llm.sieve import sieved
from drawbook.llm.shingles import RAW_LETTERS, chunks, prefix_hash, span_hashes
from drawbook.llm.workers import tidy_group, tidy_task
from drawbook.session import write_table

GRAM = 40
FLUSH_ANCHORS = 1_000_000
FLUSH_BYTES = 16 << 20
BLOCK_ANCHORS = 2_000_000
SHARD_BYTES = 6 << 20
LOW = np.uint64(0xFFFFFFFF)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor's hash) of the runs of starts that share an anchor, in order; runs never cross texts."""
    span = width - GRAM + 1
    windows = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if windows <= 0 or not (np.diff(offsets) >= width).any():
        return none, none, np.zeros(0, np.uint64)
    grams = len(data) - GRAM + 1
    prefix = prefix_hash(data, RAW_LETTERS)
    at = np.arange(grams)
    hashes = span_hashes(prefix, at, at + GRAM)
    size = -(-grams // span) * span
    key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    key[:grams] = (hashes & ~LOW) | at.astype(np.uint64)
    rows = key.reshape(-1, span)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:windows], before[span - 1: span - 1 + windows]) & LOW).astype(np.int64)
    # Starts whose string ends behind its text are no starts.
    for end in offsets[1:]:
        anchor[max(0, end - width + 1): end] = -1
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge - 1, [windows - 1]])
    own = anchor[first] >= 0
    first, last = first[own], last[own]
    return first, last, hashes[anchor[first]]


def bounds_of(first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs of each text begin and end."""
    return np.searchsorted(first, offsets)


def anchor_rows(texts: DataFrame, width: int, blocks: int) -> DataFrame:
    """Anchors of ``texts`` (``th``, ``text``): rows of arrays per block for those single in their task, and rows per text for the others.

    A text's runs are named by their order. Columns ``block``, ``hashes``, ``ths``, ``runs``, ``weights``; or ``th``, ``own`` and ``copied``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "hashes", "ths", "runs", "weights", "th", "own", "copied"]
        weight: dict[int, int] = {}
        held: list[tuple[int, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if not held:
                return
            hashes = np.concatenate([h for _, h in held])
            text = np.repeat(np.arange(len(held)), [len(h) for _, h in held])
            order = np.concatenate([np.arange(len(h), dtype=np.uint32) for _, h in held])
            ths = np.array([t for t, _ in held], np.int64)
            copies = np.array([weight[t] for t, _ in held])
            turn = np.argsort(hashes, kind="stable")
            hashes, text, order = hashes[turn], text[turn], order[turn]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(hashes)]]))
            several = np.add.reduceat(copies[text], starts) > 1
            here = np.repeat(several, sizes)
            own_text, own_run = text[here], order[here]
            turn = np.argsort(own_text, kind="stable")
            own_text, own_run = own_text[turn], own_run[turn]
            used, cut = np.unique(own_text, return_index=True)
            parts = np.split(own_run, cut[1:])
            if len(used):
                n = len(used)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(4)), pa.array(ths[used]), pa.array([x.tobytes() for x in parts], pa.binary()),
                     pa.array(copies[used] > 1)], names=names)
            single = ~here
            out_hash = np.concatenate([hashes[single], hashes[starts[several]]])
            out_th = np.concatenate([ths[text[single]], np.zeros(int(several.sum()), np.int64)])
            out_run = np.concatenate([order[single], np.zeros(int(several.sum()), np.uint32)])
            out_weight = np.concatenate([np.ones(int(single.sum()), np.uint8), np.full(int(several.sum()), 2, np.uint8)])
            block = (out_hash % np.uint64(blocks)).astype(np.int64)
            turn = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[turn], np.arange(blocks + 1))
            rows = [(b, *(x[turn[cuts[b]: cuts[b + 1]]].tobytes() for x in (out_hash, out_th, out_run, out_weight))) for b in range(blocks) if cuts[b] < cuts[b + 1]]
            held.clear(), weight.clear()
            count = 0
            if rows:
                columns = list(zip(*rows, strict=True))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:]), pa.nulls(n, pa.int64()),
                                                  pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], names=names)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for begin, _, data, offsets in chunks(batch.column(1)):
                first, _, hashes = anchored_runs(data, offsets, width)
                cuts = bounds_of(first, offsets)
                for d in np.flatnonzero(np.diff(cuts)):
                    th = int(keys[begin + d])
                    weight[th] = weight.get(th, 0) + 1
                    if weight[th] == 1:
                        own = hashes[cuts[d]: cuts[d + 1]].copy()
                        held.append((th, own))
                        count += len(own)
                if count >= FLUSH_ANCHORS:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(tidy_task(run), "block int, hashes binary, ths binary, runs binary, weights binary, th long, own binary, copied boolean")


def meet_anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """Runs of a block whose anchor occurs more than once, per text; a run that two tasks sent, a copy's, is named twice."""
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["hashes"]])
    ths = np.concatenate([np.frombuffer(x, np.int64) for x in frame["ths"]])
    runs = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["runs"]])
    weights = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["weights"]])
    turn = np.argsort(hashes, kind="stable")
    hashes, ths, runs, weights = hashes[turn], ths[turn], runs[turn], weights[turn]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    several = np.add.reduceat(weights.astype(np.int64), starts) > 1
    keep = np.repeat(several, np.diff(np.concatenate([starts, [len(hashes)]]))) & (weights == 1)
    ths, runs = ths[keep], runs[keep]
    turn = np.lexsort((runs, ths))
    ths, runs = ths[turn], runs[turn]
    third = np.zeros(len(ths), bool)
    third[2:] = (ths[2:] == ths[:-2]) & (runs[2:] == runs[:-2])
    ths, runs = ths[~third], runs[~third]
    used, cut = np.unique(ths, return_index=True)
    parts = np.split(runs, cut[1:]) if len(used) else []
    return pd.DataFrame({"th": used, "own": [x.tobytes() for x in parts], "copied": np.zeros(len(used), bool)})


def segment_rows(chosen: DataFrame, width: int, shards: int) -> DataFrame:
    """Segments of ``chosen`` (``th``, ``text``, ``owns``, ``copied``) as arrays per shard, equal ones of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "data", "lengths", "segments", "ths", "starts", "copied"]
        known: dict[int, dict[bytes, int]] = {}
        uses: dict[int, list[tuple[int, int, int, bool]]] = {}
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for shard, segments in known.items():
                segment, th, start, copied = zip(*uses[shard], strict=True)
                row = (shard, b"".join(segments), np.array([len(x) for x in segments], np.uint32).tobytes(), np.array(segment, np.uint32).tobytes(),
                       np.array(th, np.int64).tobytes(), np.array(start, np.int64).tobytes(), np.array(copied, np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names=names)
            known.clear(), uses.clear()
            size = 0

        for batch in batches:
            keys, owns, copies = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            for begin, _, data, offsets in chunks(batch.column(1)):
                first, last, hashes = anchored_runs(data, offsets, width)
                cuts = bounds_of(first, offsets)
                for d in np.flatnonzero(np.diff(cuts)):
                    th = int(keys[begin + d])
                    if th in seen:
                        continue
                    seen.add(th)
                    named = np.concatenate([np.frombuffer(x, np.uint32) for x in owns[begin + d].as_py()])
                    own = np.unique(named)
                    copied = bool(copies[begin + d].as_py()) or len(own) < len(named)
                    for k in own.astype(np.int64) + cuts[d]:
                        piece = data[first[k]: last[k] + width].tobytes()
                        shard = int(hashes[k] % np.uint64(shards))
                        segments = known.setdefault(shard, {})
                        number = segments.get(piece)
                        if number is None:
                            number = segments[piece] = len(segments)
                            size += len(piece)
                        uses.setdefault(shard, []).append((number, th, int(first[k] - offsets[d]), copied))
                        size += 32
                if size >= FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return chosen.mapInArrow(tidy_task(run), "shard int, data binary, lengths binary, segments binary, ths binary, starts binary, copied binary")


def sort_shard(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """Byte ranges (``th``, ``lo``, ``hi``) of a shard's texts that repeated strings cover."""
    numbers: dict[bytes, int] = {}
    segment, th, start, weight = [], [], [], []
    for row in frame.itertuples(index=False):
        ends = np.cumsum(np.frombuffer(row.lengths, np.uint32).astype(np.int64))
        pieces = [row.data[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        number = np.array([numbers.setdefault(p, len(numbers)) for p in pieces])
        segment.append(number[np.frombuffer(row.segments, np.uint32)])
        th.append(np.frombuffer(row.ths, np.int64))
        start.append(np.frombuffer(row.starts, np.int64))
        weight.append(1 + np.frombuffer(row.copied, np.uint8).astype(np.int64))
    segment, th, start, weight = (np.concatenate(x) for x in (segment, th, start, weight))
    copies = np.bincount(segment, weight, len(numbers))
    flags = repeated_windows(list(numbers), width)
    lengths = np.array([len(f) for f in flags])
    flat = np.concatenate(flags)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat |= np.repeat(copies > 1, lengths)
    # Runs of marked starts of each distinct segment, then the same runs at each place of the segment.
    border = np.zeros(len(flat), bool)
    border[begins] = True
    rise = np.flatnonzero(flat & (border | ~np.concatenate([[False], flat[:-1]])))
    fall = np.flatnonzero(flat & (np.concatenate([border[1:], [True]]) | ~np.concatenate([flat[1:], [False]])))
    holder = np.searchsorted(begins, rise, "right") - 1
    lo, hi = rise - begins[holder], fall - begins[holder] + width
    first, number = np.searchsorted(holder, np.arange(len(flags))), np.bincount(holder, minlength=len(flags))
    each = number[segment]
    use = np.repeat(np.arange(len(segment)), each)
    at = first[segment][use] + np.arange(len(use)) - np.repeat(np.cumsum(each) - each, each)
    return pd.DataFrame({"th": th[use], "lo": start[use] + lo[at], "hi": start[use] + hi[at]})


def cut_ranges(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the ranges, and the number of bytes and of maximal runs cut."""
    turn = np.argsort(lo, kind="stable")
    lo, hi = lo[turn], np.maximum.accumulate(hi[turn])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    begin, end = lo[new], hi[np.concatenate([new[1:], [True]])]
    kept = b"".join(text[a:b] for a, b in zip(np.concatenate([[0], end]), np.concatenate([begin, [len(text)]]), strict=True))
    return kept, len(text) - len(kept), len(begin)


def remove_repeats(docs: DataFrame, width: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` (``text_col`` a string) with ``rep_n_bytes``, ``rep_n_removed``, ``rep_n_spans``, ``rep_kept_sha256`` and ``rep_text``.

    A byte of a text in UTF-8 goes if a string of ``width`` bytes that covers it also starts at another place: of another
    row, or of the same text, overlapping or not. Strings are judged on the input, never across rows. Null is an empty text.
    Repeated rows are texts like any other, and so remove each other's bytes. ``rep_text`` is what is left, without characters
    that a cut broke; the digest is of the bytes left. Columns with these names are replaced, others pass through. An empty
    table gives an empty one.
    """
    import hashlib

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    long = texts.where(F.octet_length("text") >= width)
    total = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-total * 2 // (width - GRAM) // BLOCK_ANCHORS))
    anchors, _ = write_table(anchor_rows(long, width, blocks), "anchors")
    met = anchors.where("block is not null").select("block", "hashes", "ths", "runs", "weights").groupBy("block").applyInPandas(
        tidy_group(meet_anchors), "th long, own binary, copied boolean")
    runs = (
        anchors.where("th is not null").select("th", "own", "copied").union(met)
        .groupBy("th", "own").agg(F.count("*").alias("n"), F.max("copied").alias("copied"))
        .groupBy("th").agg(F.collect_list("own").alias("owns"), F.max(F.col("copied") | (F.col("n") > 1)).alias("copied"))
    )
    runs, _ = write_table(runs, "runs")
    named = runs.agg(F.sum(F.aggregate("owns", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-(named // 4) * (width + (width - GRAM) // 2) // SHARD_BYTES))
    segments = segment_rows(sieved(long, "th", runs, "th").join(runs, "th").select("th", "text", "owns", "copied"), width, shards)
    found = segments.groupBy("shard").applyInPandas(tidy_group(lambda frame: sort_shard(frame, width)), "th long, lo long, hi long")
    at, los, his = (free_name(docs, n) for n in ("__th", "__lo", "__hi"))
    ranges = found.groupBy("th", "lo").agg(F.max("hi").alias("hi")).groupBy(F.col("th").alias(at)).agg(
        F.collect_list("lo").alias(los), F.collect_list("hi").alias(his))

    new = ["rep_n_bytes", "rep_n_removed", "rep_n_spans", "rep_kept_sha256", "rep_text"]
    names = [c for c in docs.columns if c.lower() not in new]
    schema = docs.select(*names, F.lit(0).cast("long").alias(new[0]), F.lit(0).cast("long").alias(new[1]), F.lit(0).cast("long").alias(new[2]),
                         F.lit("").alias(new[3]), F.lit("").alias(new[4])).schema

    place = [c.lower() for c in names].index(text_col.lower())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            out = []
            for body, lo, hi in zip(batch.column(place), batch.column(n), batch.column(n + 1), strict=True):
                body = body.as_buffer().to_pybytes() if body.is_valid else b""
                if lo.is_valid:
                    kept, removed, spans = cut_ranges(body, np.array(lo.values), np.array(hi.values))
                else:
                    kept, removed, spans = body, 0, 0
                out.append((len(body), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*names, *new])

    return (
        docs.select(*names, F.xxhash64(text).alias(at)).join(ranges, at, "left")
        .select(*names, los, his).mapInArrow(tidy_task(cut), schema)
    )
