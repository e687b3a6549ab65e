"""Licence detection by ordered signature rules, in built-in functions only.

A text is brought to words. Its distinct words gate the rules: a rule runs only where its keyword occurs. All matches of
the rules that run are placed by word, then thinned out: a match inside another one goes (of equal ones the earlier rule
stays), and of two neighbours that overlap the earlier rule suppresses the other.

Everything stays inside the row, so there is no shuffle and no key that could be hot.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.functions.plan import compute_once
from drawbook.llm.license_rules import BASE, parse_signatures
from drawbook.llm.rows import Numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "array<struct<rank:int,weight:double,label:string,keyword:string,pattern:string>>"
HIT = "array<struct<first:int,last:int,rank:int,label:string,weight:double>>"
#: Arrays are folded in pieces of this length, so that appending stays cheap however many matches a text holds.
PIECE = 256
RESULTS = ["lic_words", "lic_places", "lic_base_labels", "lic_hits", "lic_labels", "lic_score"]


def fold(items: Column, carry: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold ``items`` with a carried value; ``step`` gives the next value and an array of results, all of which are joined."""
    chunks = F.transform(F.filter(F.sequence(F.lit(0), F.size(items)), lambda k: (k % PIECE == 0) & (k < F.size(items))), lambda k: F.slice(items, k + 1, PIECE))
    empty = F.array().cast(out)

    def one(s: Column, item: Column) -> Column:
        after, made = step(s["carry"], item)
        return F.struct(after.alias("carry"), F.concat(s["out"], made).alias("out"))

    def piece(s: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(s["carry"].alias("carry"), empty.alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda i: F.struct(i["carry"].alias("carry"), F.array_append(s["out"], i["out"]).alias("out"))), F.lit(0))

    start = F.struct(carry.alias("carry"), F.array().cast(f"array<{out}>").alias("out"))
    return F.aggregate(chunks, start, piece, lambda s: F.flatten(s["out"]))


def words_in(spaced: Column) -> Column:
    """Number of words of a piece in which every word has a space of its own on either side."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def rule_hits(spaced: Column, rule: Column) -> Column:
    """All matches of one rule, as first and last word."""
    matches = F.regexp_extract_all(spaced, rule["pattern"], F.lit(0))
    gaps = F.split(spaced, rule["pattern"], -1)
    pairs = F.arrays_zip(F.transform(gaps, words_in).alias("gap"), F.transform(matches, words_in).alias("own"))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        first = at + pair["gap"]
        hit = F.struct(first.alias("first"), (first + pair["own"] - 1).alias("last"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return first + F.coalesce(pair["own"], F.lit(0)), F.when(pair["own"].isNotNull(), F.array(hit)).otherwise(F.array().cast(HIT))

    return F.when(F.size(matches) > 0, fold(pairs, F.lit(0), HIT, step)).otherwise(F.array().cast(HIT))


def without_contained(hits: Column) -> Column:
    """Hits that lie in no other one; of hits on the same words the first rule's stays."""
    ordered = F.transform(
        F.array_sort(F.transform(hits, lambda h: F.struct(h["first"].alias("first"), (-h["last"]).alias("back"), h["rank"].alias("rank"), h.alias("hit")))), lambda o: o["hit"])

    def step(end: Column, hit: Column) -> tuple[Column, Column]:
        return F.greatest(end, hit["last"]), F.when(hit["last"] > end, F.array(hit)).otherwise(F.array().cast(HIT))

    return fold(ordered, F.lit(-1), HIT, step)


def without_overlapped(hits: Column) -> Column:
    """Of two neighbouring hits that share words, the one of the earlier rule suppresses the other."""
    before = F.concat(F.array(F.lit(None)), F.slice(hits, F.lit(1), F.greatest(F.size(hits) - 1, F.lit(0))))
    after = F.concat(F.slice(hits, F.lit(2), F.size(hits)), F.array(F.lit(None)))
    trio = F.arrays_zip(hits.alias("hit"), F.slice(before, F.lit(1), F.size(hits)).alias("p"), F.slice(after, F.lit(1), F.size(hits)).alias("n"))
    lost = lambda t: (F.coalesce((t["p"]["last"] >= t["hit"]["first"]) & (t["p"]["rank"] < t["hit"]["rank"]), F.lit(False))
                      | F.coalesce((t["n"]["first"] <= t["hit"]["last"]) & (t["n"]["rank"] < t["hit"]["rank"]), F.lit(False)))
    return F.transform(F.filter(trio, lambda t: ~lost(t)), lambda t: t["hit"])


def phrase_places(words: Column, spaced: Column, phrase: str) -> Column:
    """Places, overlapping ones too, where the words of ``phrase`` stand consecutively."""
    wanted = phrase.split(" ")
    there = F.contains(spaced, F.lit(" " + "  ".join(wanted) + " "))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(wanted), F.lit(0))), lambda i: (F.get(words, i) == wanted[0]) & (F.slice(words, i + 1, len(wanted)) == F.array(*map(F.lit, wanted))))
    return F.when(there, at).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, rules: Sequence[dict] | None = None, base: Sequence[tuple[str, str]] = tuple(BASE), text_col: str = "text") -> DataFrame:
    """``docs`` with the licences that its texts name.

    ``lic_words`` (number of words), ``lic_places`` (sorted places of all ``base`` phrases, words from 0), ``lic_base_labels``
    (their labels), ``lic_hits`` (kept matches of ``rules``: first and last word, rank, label, weight), ``lic_labels``
    (labels of both) and ``lic_score`` (the greatest weight of a kept match; 0.5 at least where a phrase stands; else 0).

    * Only A-Z are lower-cased; a word is a run of a-z, 0-9 and characters beyond ASCII. Null and empty texts have no
      words, no labels and score 0. Texts are read whole, of any length.
    * Every input row gives one row, repeated rows too; an empty table gives an empty one. Ties between rules go to the
      earlier one. Input columns named like a result are kept under a free name (``rows.kept_names``).
    """
    rules = parse_signatures() if rules is None else rules
    table = F.from_json(F.lit(json.dumps([{k: r[k] for k in ("rank", "weight", "label", "keyword", "pattern")} for r in rules])), RULE)
    keywords = F.array(*[F.lit(k) for k in sorted({r["keyword"] for r in rules})]).cast("array<string>")
    numbered = Numbered(docs, RESULTS)
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(numbered.column(text_col).cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS, " "))
    plain_words = numbered.rows.withColumn("plain", plain)
    words = F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " "))
    spaced = F.when(F.col("plain") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace("plain", F.lit(" "), F.lit("  ")), F.lit(" ")))
    read = compute_once(plain_words, words=words, spaced=spaced).drop("plain")
    read = compute_once(read, lic_words=F.size("words").cast("long"), known=F.array_intersect("words", keywords),
                        bases=F.array(*[phrase_places(F.col("words"), F.col("spaced"), p) for p, _ in base])).drop("words")
    gated = F.when(F.size("known") > 0, F.filter(table, lambda r: F.array_contains("known", r["keyword"]))).otherwise(F.array().cast(RULE))
    found = compute_once(read, gated=gated)
    found = compute_once(found, all_hits=F.flatten(F.transform("gated", lambda r: rule_hits(F.col("spaced"), r)))).drop("gated", "known", "spaced")
    found = compute_once(found, outer=F.when(F.size("all_hits") > 0, without_contained(F.col("all_hits"))).otherwise(F.col("all_hits"))).drop("all_hits")
    found = compute_once(found, lic_hits=without_overlapped(F.col("outer"))).drop("outer")
    labels = F.array(*[F.lit(label) for _, label in base]).cast("array<string>")
    named = F.array_sort(F.array_distinct(F.transform(F.filter(F.arrays_zip(labels.alias("label"), F.col("bases").alias("at")), lambda z: F.size(z["at"]) > 0), lambda z: z["label"])))
    found = compute_once(found, lic_places=F.array_sort(F.flatten("bases")), lic_base_labels=named).drop("bases")
    best = F.coalesce(F.array_max(F.transform("lic_hits", lambda h: h["weight"])), F.lit(0.0))
    return found.select(
        *numbered.restored(), "lic_words", "lic_places", "lic_base_labels", "lic_hits",
        F.array_sort(F.array_union("lic_base_labels", F.transform("lic_hits", lambda h: h["label"]))).alias("lic_labels"),
        F.greatest(best, F.when(F.size("lic_base_labels") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("lic_score"))


def scan_sql(rules: Sequence[dict] | None = None, base: Sequence[tuple[str, str]] = tuple(BASE)) -> str:
    """The query over ``documents`` in SQL for DuckDB, from the same table of rules."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({r['rank']}, {r['weight']}::DOUBLE, {text(r['label'])}, {text(r['keyword'])}, {text(r['pattern'])})" for r in (parse_signatures() if rules is None else rules))
    phrases = ", ".join(f"({len(p.split(' '))}, {text(p)}, {text(label)})" for p, label in base)
    return rf"""
WITH rules(rank, weight, label, keyword, pattern) AS (VALUES {rows}),
base(n, phrase, label) AS (VALUES {phrases}),
t AS (SELECT row_number() OVER () AS id, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS plain FROM documents),
d AS MATERIALIZED (SELECT id, doc_id, CASE WHEN plain = '' THEN [] ELSE string_split(plain, ' ') END AS w, CASE WHEN plain = '' THEN '' ELSE ' ' || replace(plain, ' ', '  ') || ' ' END AS spaced FROM t),
b AS (SELECT id, label, i FROM d, base, unnest(range(len(w) - n + 1)) AS u(i) WHERE contains(spaced, ' ' || replace(phrase, ' ', '  ') || ' ') AND array_to_string(w[i + 1:i + n], ' ') = phrase),
m AS MATERIALIZED (SELECT id, rank, weight, label, regexp_extract_all(spaced, pattern) AS found, string_split_regex(spaced, pattern) AS gaps FROM d JOIN rules ON list_contains(w, keyword)),
n AS (SELECT id, rank, weight, label, k, (length(gaps[k]) - length(replace(gaps[k], ' ', ''))) // 2 AS gap, (length(found[k]) - length(replace(found[k], ' ', ''))) // 2 AS own
      FROM m, unnest(range(1, len(found) + 1)) AS u(k)),
p AS (SELECT id, rank, weight, label, own, (sum(gap + own) OVER (PARTITION BY id, rank ORDER BY k) - own)::BIGINT AS first FROM n),
h AS (SELECT *, first + own - 1 AS last FROM p),
c AS (SELECT *, coalesce(max(last) OVER (PARTITION BY id ORDER BY first, last DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM h),
o AS (SELECT *, lag(last) OVER w AS p_last, lag(rank) OVER w AS p_rank, lead(first) OVER w AS n_first, lead(rank) OVER w AS n_rank FROM c WHERE last > reach WINDOW w AS (PARTITION BY id ORDER BY first)),
k AS (SELECT id, label, weight FROM o WHERE NOT coalesce(p_last >= first AND p_rank < rank, false) AND NOT coalesce(n_first <= last AND n_rank < rank, false)),
l AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM k UNION SELECT id, label FROM b) GROUP BY id),
x AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY id),
s AS (SELECT id, max(weight) AS score FROM k GROUP BY id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       greatest(coalesce(score, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN x ON d.id = x.id LEFT JOIN l ON d.id = l.id LEFT JOIN s ON d.id = s.id"""
