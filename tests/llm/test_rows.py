"""Mixing, packing, URL rules, archives: against plain loops, round trips, and odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawbook.llm import warc
from drawbook.llm.mixing import emit_copies, mix
from drawbook.llm.packing import LevelPacker, pack, pack_stream
from drawbook.llm.urlrules import judge_urls

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_mix(spark):
    random = np.random.default_rng(1)
    rows = [(k, " ".join("w" for _ in range(random.integers(0, 80))), f"s{random.integers(4)}", 1) for k in range(800)]
    rows += [(1000, None, None, 1), (1001, "a\x0bb  c", None, 1), (None, "x y", "s0", 1), (None, "x y", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int").repartition(5)
    out = mix(docs).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for _, text, source, _ in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(size.values())
    while True:
        share = (total - sum(capped.values())) / sum(weight[s] for s in order if s not in capped)
        over = [s for s in order if s not in capped and share * weight[s] > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
    target = {s: capped.get(s, share * weight[s]) for s in order}
    taken = defaultdict(int)
    for r in out:
        assert r["mix_source_size"] == size[r["source"]] and abs(r["mix_target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["mix_copies"] <= 3 and r["mix_taken"] == r["mix_copies"] * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 80 for s in order)
    again = mix(docs.repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["mix_copies"]) for r in again) == sorted((str(r["doc_id"]), r["mix_copies"]) for r in out)
    copies = emit_copies(mix(docs.drop("mix_size")))
    assert copies.columns == ["doc_id", "text", "source"] and copies.count() == sum(r["mix_copies"] for r in again)


def test_mix_without_words(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [(r["mix_target"], r["mix_taken"]) for r in mix(spark.createDataFrame([(1, "", "a"), (2, None, "a")], schema)).collect()] == [(0.0, 0)] * 2


def check_windows(pieces, window):
    """Gapless windows; padding only where a window is no power of two."""
    ends = defaultdict(int)
    for sequence, offset, length in sorted(pieces):
        assert offset == ends[sequence] and length > 0
        ends[sequence] += length
    assert all(e <= window for e in ends.values())
    return sum(window - e for e in ends.values() if e & (e - 1))


def test_pack_stream():
    random = np.random.default_rng(3)
    for _ in range(30):
        sizes = [int(x) for x in random.integers(1, 200, random.integers(0, 120))]
        pieces = list(pack_stream(((k, bytes(4 * n)) for k, n in enumerate(sizes)), 64, 10))
        assert check_windows([(p[4], p[5], len(p[2]) // 4) for p in pieces], 64) == 0
        covered = defaultdict(list)
        for key, start, ids, total, _, _ in pieces:
            assert total == sizes[key]
            covered[key].append((start, start + len(ids) // 4))
        for key, spans in covered.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == sizes[key] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(covered) == len(sizes)


def test_packer_keeps_few_windows_open():
    """Open windows grow about as the square root of the items."""
    packer, random, open_windows = LevelPacker(100, 0), np.random.default_rng(0), []
    for k, size in enumerate(random.integers(1, 100, 32_000)):
        packer.place(int(size))
        if k + 1 in (2_000, 32_000):
            open_windows.append(int(packer.counts.sum()))
    assert open_windows[1] < 8 * open_windows[0] and open_windows[1] < 0.08 * packer.next_id


def test_pack(spark):
    texts = ["Some words, it's 12½ a_b.\n\n  x", None, "", "<|endoftext|> in <|endoftext|>", "a\x1cb\x85", "“quoted” — 東京 😀 é" * 30, "word " * 9000, "ÀÉ õ x²"]
    docs = spark.createDataFrame([*((k, t, 9) for k, t in enumerate(texts)), (0, texts[0], 9), (None, "n", 9)], "doc_id long, text string, start int").repartition(3)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in [*enumerate(texts), (None, "n")]}
    out = pack(docs, VOCABULARY, 256).collect()
    for r in out:
        own = ids[r["doc_id"]]
        assert bytes(r["ids"]) == own[r["start"]: r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(own)
    assert check_windows([(r["sequence_id"], r["offset"], r["length"]) for r in out], 256) == 0
    assert sum(r["length"] for r in out) == sum(map(len, ids.values())) + len(ids[0])
    assert pack(docs.limit(0), VOCABULARY).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"),
         ("b.org", "/a/b", "block"), ("tie.io", "/x", "allow"), ("tie.io", "/x", "block")]


def test_judge_urls(spark):
    urls = [None, "", "nothing", "http://Example.COM/en/1?x", "https://www.example.com/en/", "http://a.www.example.com/en/x#y", "http://example.com", "http://notexample.com/en/",
            "ftp://x.net/es/1", "http://x.net/es", "http://b.org/a/bcd/e", "http://c.b.org/a/b", "http://b.org/a/", "http://tie.io/x", "://com/", "http://com?q=/en/", "http://é.example.com/en/é/"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in [*enumerate(urls), (3, urls[3])]], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")

    def judge(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host, path = re.match(r"[^/?#]*", rest)[0], ""
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    got = judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(urls) + 1
    assert all(tuple(r)[2:] == judge(r["url"]) for r in rows)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_archives(spark):
    long, longer = "é" * 700, "x" * 300_000
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f", None), (7, "http://g", ""),
            (8, "http://h", longer + "\r\n\r\nWARC/1.1\r\n"), (None, "http://i", long), (3, "http://j", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    path = warc.archive_pages(pages)
    got = warc.page_records(warc.read_warc(spark, path)).collect()
    assert len(got) == len(rows)
    import hashlib
    from collections import Counter

    def want(page, html):
        body = (html or "").encode()
        again = page is not None and html == long and page < 3
        return page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 3 if again else None

    assert Counter(tuple(r) for r in got) == Counter(want(p, h) for p, _, h in rows)
    whole = {r["record_id"]: r["payload"] for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert bytes(whole["<urn:page:8>"]).decode() == rows[7][2]
    heads = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and refers_to is not null")
    assert "EqualTo" not in heads._jdf.queryExecution().executedPlan().treeString().split("Filter")[0]
    assert heads.count() == 2 and heads.where("payload is not null").count() == 0
    assert warc.read_warc(spark, path).where(F.col("headers")["WARC-Target-URI"] == "http://d").count() == 1
    warc.write_warc(warc.plan_records(pages.where("page_id = 4")), path)
    assert warc.read_warc(spark, path).count() == len(rows) + 1
    assert warc.page_records(warc.read_warc(spark, warc.archive_pages(pages.limit(0)))).count() == 0


def test_reader_skips_blocks(tmp_path):
    """A reader with a filter reads the headers of other records and none of their blocks."""
    from pyspark.sql.datasource import EqualTo

    records = [{"record_type": "response", "record_id": f"<urn:page:{k}>", "payload": bytes(100_000)} for k in range(20)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record_bytes, records)))
    reader = warc.WarcReader(str(tmp_path), True)
    assert list(reader.pushFilters([EqualTo(("record_id",), "<urn:page:7>")])) == []
    size = (tmp_path / "a.warc").stat().st_size
    batches = list(reader.read(warc.FilePartition("a.warc", size)))
    assert [b.num_rows for b in batches] == [1] and len(batches[0].column(8)[0].as_py()) == 100_000
    with pytest.raises(ValueError):
        (tmp_path / "b.warc").write_bytes(b"junk\r\n\r\n")
        list(reader.read(warc.FilePartition("b.warc", 8)))


def test_crc_of_ids(spark):
    piece = pack(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), VOCABULARY).select(F.crc32("ids").alias("c"), "ids").first()
    assert piece["c"] == zlib.crc32(bytes(piece["ids"]))
