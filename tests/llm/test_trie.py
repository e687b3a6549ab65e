"""The prefix trie against a plain trie, for any number of shards, and odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from drawbook.llm import trie
from drawbook.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_loop(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        own = (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        parts = [below(c) for c in children[node]]
        return (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))

    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(children[n]), *below(n),
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def result(out):
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def random_rows(n, seed):
    random = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(random.integers(0, 6))):
            rows.append((c, t, ["user", "assistant", None][t % 3], ["hot turn here", f"w{random.integers(3)} x", None, f"u{c}"][int(random.integers(0, 4)) if t else 0]))
    return rows


@pytest.mark.parametrize("per_shard", [10**9, 40, 7, 1])
def test_against_a_plain_trie(spark, per_shard):
    rows = random_rows(160, 5)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(prefix_trie(frame, per_shard)) == by_loop(rows)


def test_one_conversation_repeated(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_CHUNK", 5)
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(5)] + [(c, 0, "user", "other") for c in range(300, 330)]
    assert result(prefix_trie(spark.createDataFrame(rows, SCHEMA), 30)) == by_loop(rows)


def test_splitter_paths_may_stop_early(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPLITTER_TURNS", 2)
    rows = random_rows(120, 8) + [(1000 + c, t, "user", f"deep {min(t, 9 - c % 3)}") for c in range(30) for t in range(12)]
    assert result(prefix_trie(spark.createDataFrame(rows, SCHEMA), 15)) == by_loop(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (20, None, "user", "null turn first"), (20, 0, "user", "a b"), (20, 0, "user", "a b"), (20, 0, None, None), (21, 1, "user", ""), (39, 5, "u", "x"),
            (-3, 1, "user", "negative"), (-20, 1, "user", "base of nobody"), (0, 1, "user", "zero"), (7, 3, "a1", "b"), (8, 3, "a", "1b"), (2**62, 1, "user", "far " * 50_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = by_loop(rows)
    assert result(prefix_trie(frame)) == want and result(prefix_trie(frame, 2)) == want
    more = frame.selectExpr("*", "1 AS path", "2 AS words", "3 AS shard", "4 AS skel", "5 AS depth", "6 AS base")
    assert result(prefix_trie(more, 2)) == want


def test_no_rows(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
