"""Operators with each of their inner names, and of their results' names, as an extra column of the input."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from drawbook.llm import gramjoin, licenses, mixing, quality, repeats, urlrules

RULES = [("com", "/", "block"), ("a.com", "/x/", "allow")]


def inner_names(module):
    """Short identifiers that stand as text in a module's code, and so may be names of its columns."""
    return sorted({n for n in re.findall(r"[\"']([A-Za-z_][A-Za-z0-9_]{0,24})[\"']", inspect.getsource(module)) if n not in ("text", "doc_id", "source", "url")})


def with_names(df, module):
    names = {n.lower(): n for n in inner_names(module) if n.lower() not in {c.lower() for c in df.columns}}
    assert len(names) > 10
    return df.withColumns({n: F.lit(f"mine {n}") for n in names.values()}), list(names.values())


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(1, words, "a"), (2, words + " x", "a"), (3, "mit license apache license", None), (4, None, "b"), (4, None, "b"), (5, "", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def same_but_for_names(plain, named, names):
    """The named run gives the plain run's rows, with the extra columns as they were, under their own or a free name."""
    out = {c for c in named.columns}
    kept = [next(k for k in (n, f"{n}_in", f"{n}_in_in") if k in out and k not in plain.columns) for n in names]
    rows = named.collect()
    assert all(r[k] == f"mine {n}" for r in rows for k, n in zip(kept, names, strict=True))
    assert sorted(map(str, named.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("run, module", [
    (mixing.mix, mixing), (lambda d: mixing.emit_copies(mixing.mix(d)), mixing), (gramjoin.keep_one, gramjoin), (licenses.scan_licenses, licenses),
    (lambda d: quality.score(d, quality.FoldedModel(quality.np.zeros(quality.BUCKETS, "f4"), 0.0), score_col="own_score"), quality)], ids=["mix", "copies", "keep_one", "licenses", "score"])
def test_documents(docs, run, module):
    named, names = with_names(docs, module)
    same_but_for_names(run(docs), run(named), names)


def test_repeats(docs):
    named, names = with_names(docs, repeats)
    names = [n for n in names if not n.startswith("rep_")]
    same_but_for_names(repeats.remove_repeats(docs), repeats.remove_repeats(named), names)


def test_url_rules(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x/y"), (2, "http://b.a.com/z"), (3, None)], "page_id long, url string")
    named, names = with_names(pages, urlrules)
    names = [n for n in names if n not in urlrules.RESULTS]
    same_but_for_names(urlrules.judge_urls(pages, rules), urlrules.judge_urls(named, rules), names)


def test_fit(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    named, _ = with_names(docs, quality)
    plain, other = quality.fit(docs, labels), quality.fit(named, labels)
    assert plain.intercept() == other.intercept() and (plain.weights() == other.weights()).all()
