"""The registered queries over whole small tables, against plain loops; and the pipeline's stages."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from drawbook.llm.queries import QUERIES
from tests.llm.test_models import plain_article
from tests.llm.test_pairs import closure, shingles
from tests.llm.test_repeats import by_loop
from tests.llm.test_rows import check_windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def token_ids(text):
    tokenizer = token_ids.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_op3_covers_all_turns(spark):
    rows = QUERIES["op3_chroma"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/conversations.parquet").count() and any(r["n_prints"] for r in rows)


def test_op4(spark, documents):
    rows = QUERIES["op4_packing"](spark, FOLDER).collect()
    ids = {k: token_ids(d["text"]) for k, d in documents.items()}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) for r in rows)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert check_windows([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048) == 0


def test_op5(spark, documents):
    rows = QUERIES["op5_quality"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in documents}
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_op6(spark, documents):
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_repeats"](spark, FOLDER).collect()}
    assert rows == {k: x[:4] for k, x in zip(documents, by_loop([d["text"] for d in documents.values()], 200), strict=True)}


def test_op10(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op10_main_text"](spark, FOLDER).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in rows} == {k: (plain_article(p), len(plain_article(p))) for k, p in pages.items()}


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = docs
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, FOLDER)
        out = spark.createDataFrame(out.collect(), out.schema)
        steps[name] = (before.collect(), out.collect())
        if name != "packing":
            assert out.columns == docs.columns
    before, after = steps["quality classifier"]
    assert 0 < len(after) < len(before)
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r["doc_id"] for r in after}
    assert np.mean([good[k] == (k in left) for k in good if k in documents]) > 0.9
    before, after = steps["n-gram Jaccard join"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = closure(sets, links)
    assert sorted(r["doc_id"] for r in after) == sorted(k for k in sets if root[k] == k)
    before, after = steps["suffix-array dedup"]
    cut = dict(zip((r["doc_id"] for r in before), by_loop([r["text"] for r in before], 200), strict=True))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {k: (x[4], len(x[4])) for k, x in cut.items()}
    before, after = steps["mixing sources to target weights"]
    known = {tuple(r) for r in before}
    assert after and all(tuple(r) in known for r in after)
    before, after = steps["packing"]
    assert sum(r["length"] for r in after) == sum(len(token_ids(r["text"])) for r in before)
    assert check_windows([(r["sequence_id"], r["offset"], r["length"]) for r in after], 2048) == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
