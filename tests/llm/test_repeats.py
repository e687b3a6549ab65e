"""Suffix order, repeated windows and the removal of repeated bytes against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from drawbook.llm import repeats
from drawbook.llm.induced import repeated_windows, sorted_items, suffix_order


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    r = random.Random(seed)
    for _ in range(25):
        letters = r.choice([b"ab", b"abc", bytes(range(256)), b"a"])
        segments = [bytes(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(r.randint(1, 6))]
        if r.random() < 0.4:
            segments = [s + segments[0][:30] + s for s in segments]
        width, in_memory, memory = r.choice([3, 8, 20]), r.choice([1, 10, 1 << 24]), r.choice([10, 1 << 20])
        count = Counter(s[i: i + width] for s in segments for i in range(len(s) - width + 1))
        for got, s in zip(repeated_windows(segments, width, memory, in_memory), segments, strict=True):
            assert got.tolist() == [count[s[i: i + width]] > 1 for i in range(len(s) - width + 1)]
        text = np.append(np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1, np.int16(0)).astype(np.int16)
        falls, rises, _ = suffix_order(text, 257, 250, memory, in_memory)
        plain = text.tolist()
        assert [plain[i: i + 250] for i in sorted_items(falls, rises, len(text)).tolist()] == sorted(plain[i: i + 250] for i in range(len(plain)))
        falls.scratch.close()


def by_loop(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i: i + width] for x in data for i in range(len(x) - width + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if count[x[i: i + width]] > 1:
                gone[i: i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def passages():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = [prose(r.randint(0, 90)) + r.choice(shared) + prose(r.randint(0, 60)) for _ in range(14)]
    texts += [texts[0], texts[0], shared[1], shared[1][:199], "a" * 450, "xy" * 300, None, "", prose(300), (prose(40) + "\n") * 3]
    return texts + ["b" * 199, "b" * 200, "c" * 201]


@pytest.mark.parametrize("flush", [None, 3])
def test_remove_repeats(spark, monkeypatch, flush):
    if flush:
        monkeypatch.setattr(repeats, "FLUSH_ANCHORS", flush)
        monkeypatch.setattr(repeats, "FLUSH_BYTES", 500)
        monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
        monkeypatch.setattr(repeats, "BLOCK_ANCHORS", 20)
    texts = passages()
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, th string").repartition(4)
    got = repeats.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "th", "rep_n_bytes", "rep_n_removed", "rep_n_spans", "rep_kept_sha256", "rep_text"]
    rows = {r["doc_id"]: tuple(r)[3:] for r in got.collect()}
    assert rows == dict(enumerate(by_loop(texts, 200)))


def test_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
