"""Similarity joins against plain loops, with the odd rows that tables hold."""

import math
import re

import numpy as np
import pytest

from drawbook.llm import gramjoin, subspace
from drawbook.llm.components import components


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not words else {tuple(words)} if len(words) < 5 else {tuple(words[i: i + 5]) for i in range(len(words) - 4)}


def similar_texts():
    random = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        words = [vocabulary[k] for k in random.integers(0, 300, random.integers(20, 120))]
        texts.append(" ".join(words))
        for _ in range(random.integers(0, 6)):
            changed = list(words)
            for _ in range(random.integers(0, 6)):
                changed[random.integers(len(changed))] = vocabulary[random.integers(300)]
            texts.append(" ".join(changed).upper() if random.random() < 0.3 else "\t".join(changed))
    common = " ".join(vocabulary[:60])
    texts += [common + f" own{k} end{k}" for k in range(8)] + [common] * 5
    return texts + [None, "", "  \n", "one two", "One\ttwo", "one two three", "é É", "a b c d e", "x " * 5000]


def test_ngram_components(spark, monkeypatch):
    for name, small in (("BLOCK_ENTRIES", 50), ("FLUSH_ENTRIES", 100), ("HUBS", 1), ("CHUNK_ROWS", 3), ("MEET_ROWS", 4), ("MEET_PAIRS", 6)):
        monkeypatch.setattr(gramjoin, name, small)
    texts = similar_texts()
    rows = [(k * 3 + 1, t, k) for k, t in enumerate(texts)] + [(7, texts[2], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    sets = {k: shingles(t) for k, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = gramjoin.ngram_components(docs).collect()
    assert len(got) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]) for r in got)

    kept = gramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    first = {k for k in sets if want[k] == k}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first)


def test_loose_group_is_joined_by_samples(spark, monkeypatch):
    """Near copies of which most pairs miss the threshold become one component without all their pairs."""
    random, tried = np.random.default_rng(11), []
    base, write = [f"w{k}" for k in range(150)], gramjoin.write_table

    def counted(df, label):
        out = write(df, label)
        if label in ("hub-pairs", "open-pairs"):
            tried.append(out[0].count())
        return out

    monkeypatch.setattr(gramjoin, "write_table", counted)
    monkeypatch.setattr(gramjoin, "HUBS", 1)
    texts = []
    for k in range(400):
        words = list(base)
        for at in random.choice(np.arange(5, 145), 1 if k % 20 == 7 else 3, replace=False):
            words[at] = f"own{k}_{at}"
        texts.append(" ".join(words))
    sets = dict(enumerate(map(shingles, texts)))
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = gramjoin.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(links) < 400 * 400 // 8
    assert sum(tried) < 400 * 400 // 4


def test_ngram_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "q r s t u"), (5, "q r s t u"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in gramjoin.ngram_components(docs).collect())))
    assert got == sorted(map(str, [(None, 2, None), (None, 2, None), (5, 1, 5), (5, 1, 5), (9, 0, 9), (9, 0, 9)]))
    assert sorted(str(r["doc_id"]) for r in gramjoin.keep_one(docs).collect()) == ["5", "9", "9", "None"]
    assert gramjoin.ngram_components(docs.limit(0)).count() == 0
    assert gramjoin.keep_one(docs.limit(0)).count() == 0


def vectors():
    random = np.random.default_rng(8)
    rows = []
    for _ in range(30):
        base = random.standard_normal(8)
        for _ in range(random.integers(1, 9)):
            rows.append((base + random.normal(0, 0.12, 8)).tolist())
    rows += [[2 * x for x in rows[0]], list(rows[1]), list(rows[1]), None, [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] * 8, [None] + [1.0] * 7, [], [1.0, 2.0], [1e-30] * 8, [1e30] * 8]
    return [(k, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize("chunk,grid", [(16_384, None), (5, 2), (7, 1)])
def test_cosine_components(spark, monkeypatch, chunk, grid):
    monkeypatch.setattr(subspace, "CHUNK", chunk)
    rows = vectors()
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, cls int").repartition(3)
    good = {k: np.array(v) for k, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: float((a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()))
    links = [(a, b) for a in good for b in good if a < b and cosine(good[a], good[b]) >= 0.95]
    want = closure([k for k, _ in rows], links)
    number = {k: sum(k in x for x in links) for k, _ in rows}
    got = subspace.cosine_components(frame, grid_dims=grid).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {k: (number[k], want[k], want[k] == k) for k, _ in rows}


def test_cosine_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert subspace.cosine_components(spark.createDataFrame([], schema)).count() == 0
    got = subspace.cosine_components(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None)], schema)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(["(None, 1, None, False)", "(None, 1, None, False)", "(3, 0, 3, True)"])


def test_cosine_of_every_length(spark):
    random = np.random.default_rng(9)
    rows = []
    for dim, bases in ((8, 12), (5, 6), (2, 3), (1, 1)):
        for _ in range(bases):
            base = random.standard_normal(dim)
            rows += [(base + random.normal(0, 0.1, dim)).tolist() for _ in range(4)]
    rows += [list(rows[-6]), list(rows[-6]), [1.0, 0.0, 0.0], [2.0, 0.0, 0.0]]
    schema = "vec_id long, embedding array<double>"
    got = subspace.cosine_components(spark.createDataFrame(list(enumerate(rows)), schema).repartition(3)).collect()
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(rows[a]) == len(rows[b]) and unit[a] @ unit[b] >= 0.95]
    want = closure(range(len(rows)), links)
    assert {len(rows[a]) for a, _ in links} == {1, 2, 3, 5, 8}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {k: (sum(k in x for x in links), want[k]) for k in range(len(rows))}


def test_components(spark):
    random = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(20)] + [(500, k) for k in range(501, 520)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 1), (9, 9)], "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == {n: r for n, r in closure(nodes, edges).items()}


def test_numbers_in_the_least_width():
    for top, width in ((0, 1), (255, 1), (256, 2), (70_000, 4)):
        x = np.array([top, 0, top // 2], np.uint32)
        assert len(gramjoin.narrow(x)) == 3 * width
        assert list(gramjoin.widened(gramjoin.narrow(x), 3)) == list(x)


def test_components_are_not_made_again_where_nothing_new_is_linked(spark, monkeypatch):
    from drawbook.llm import gramjoin

    real, calls = gramjoin.components, []
    monkeypatch.setattr(gramjoin, "components", lambda edges: calls.append(1) or real(edges))
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, words), (1, words + " more"), (2, "quite another text of seven words here")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in gramjoin.ngram_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1} and len(calls) == 1, (got, calls)
