"""One query per operator over its whole table, and the SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawbook.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WINDOW = 2048
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


#: Texts go to Python workers in batches of this many bytes where the session keeps Spark's default, so that what a worker
#: holds, and never gives back, stays small over many stages.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "4m"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from drawbook.llm.packing import pack

    pieces = pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), WINDOW)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.warc import archive_pages, page_records, read_warc

    return page_records(read_warc(spark, archive_pages(read(spark, folder, "pages"))))


@query("op8_url_rules", """
WITH r(host, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                       ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (SELECT page_id, url, row_number() OVER () AS row, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM s),
f AS (SELECT u.row, r.host || r.rpath AS rule, r.verdict,
             row_number() OVER (PARTITION BY u.row ORDER BY length(r.host || r.rpath) DESC, length(r.host) DESC) AS n
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.row = f.row AND f.n = 1""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.urlrules import judge_urls

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op9_mixing", r"""
WITH d AS (SELECT doc_id, source IS NOT NULL AS known, coalesce(source, '') AS source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
c AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) AS class,
             substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS bin3 FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY known, source ORDER BY class, bin3, size, coalesce(doc_id::VARCHAR, '')) AS place,
             sum(size) OVER (PARTITION BY known, source)::BIGINT AS words FROM c),
s AS (SELECT DISTINCT known, source, words FROM o),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY known DESC, source) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
q AS (SELECT *, 3 * words AS cap, (3 * words)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, known DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY ratio, known DESC, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT *, least(cap::DOUBLE, (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1) * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix|' || source), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM t)
SELECT o.doc_id, o.size, o.words AS source_size, r.target,
       (least(floor(r.shift + place::DOUBLE * r.rate) - floor(r.shift + (place - 1)::DOUBLE * r.rate), 3)::BIGINT * o.size)::BIGINT AS taken
FROM o JOIN r ON o.known = r.known AND o.source = r.source""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.mixing import mix

    return mix(read(spark, folder, "documents")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"))


@query("op2_ngram_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS set FROM d),
n AS (SELECT doc_id, len(set)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(set) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
z AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, z.b FROM r JOIN z ON r.reach = z.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m ON n.doc_id = m.doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.gramjoin import ngram_components

    return ngram_components(read(spark, folder, "documents"))


@query("op1_subspace", """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.subspace import cosine_components

    return cosine_components(read(spark, folder, "embeddings"))


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.quality import fit, held_out, score

    docs = read(spark, folder, "documents")
    model = fit(docs, read(spark, folder, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.maintext import extract_text, fit_field

    pages = read(spark, folder, "pages")
    return extract_text(pages.select("page_id", "url", "html"), fit_field(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_repeats")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.repeats import remove_repeats

    return remove_repeats(read(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("rep_n_bytes").alias("n_bytes"), F.col("rep_n_removed").alias("n_removed"), F.col("rep_n_spans").alias("n_spans"),
        F.col("rep_kept_sha256").alias("kept_sha256"))


@query("op3_chroma")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of all turns; those of conversations divisible by 100 are looked up among all.

    ``cls`` names the turn's class; ``matches``, on the first turn of a class, lists the other query classes that match it.
    """
    from drawbook.llm.chroma import align, fingerprints, record_texts

    recordings = record_texts(read(spark, folder, "conversations").select("conv_id", "turn", "text"))
    prints = fingerprints(recordings.withColumn("sound", F.when(F.octet_length("audio") > 0, F.xxhash64("audio"))))
    return align(prints, F.col("conv_id") % 100 == 0, sound_col="sound").select(
        "conv_id", "turn", "n_prints", "n_queries", "shift", "overlap", "error_rate", F.crc32("prints").alias("prints_crc32"), "cls", "matches")


def _license_sql() -> str:
    from drawbook.llm.licenses import scan_sql

    return scan_sql()


@query("op11_license_rules", _license_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.licenses import scan_licenses

    return scan_licenses(read(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("lic_words").alias("n_words"), F.size("lic_places").cast("long").alias("n_base"),
        F.get("lic_places", F.lit(0)).cast("long").alias("first_word"), F.get("lic_places", F.size("lic_places") - 1).cast("long").alias("last_word"),
        F.array_join("lic_base_labels", ",").alias("base_labels"), F.array_join("lic_labels", ",").alias("labels"), F.col("lic_score").alias("score"))


def _centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Rounds written out; a distance and a centroid's number are one integer, so the least one settles ties."""
    each = ",".join
    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k}))"""]
    for r in range(rounds + 1):
        squared = "list_sum(list_transform(range(1, %d), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT" % (dims + 1)
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT v.id, min({squared} * {k} + c.c) AS best FROM v, c{r} c GROUP BY v.id)""")
        if r < rounds:
            parts.append(f"""
s{r} AS (SELECT best % {k} AS c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v ON a{r}.id = v.id, unnest(range(1, {dims + 1})) AS u(i) GROUP BY ALL),
n{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN n{r} n ON o.c = n.c)""")
    return f"""WITH {each(parts)}
SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance, (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia,
       (sum(best // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v ON a{rounds}.id = v.id JOIN c{rounds} f ON f.c = best % {k}"""


@query("op12_centroid_tables", _centroid_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.centroids import cluster_vectors

    return cluster_vectors(read(spark, folder, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_prefix_trie", r"""
WITH table256 AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) AS r(n)),
src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
dig AS (SELECT *, left(sha256(length(role)::VARCHAR || ':' || role || text), 32) AS digest, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM src),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS n, digest, words FROM dig),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM src), table256),
r AS (SELECT c.conv_id, n, digest, words FROM c JOIN o ON o.conv_id = c.base AND n <= h UNION ALL SELECT c.conv_id, n, digest, words FROM c JOIN o ON o.conv_id = c.conv_id AND n > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM (SELECT conv_id, depth, key, words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c)),
g AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY key, depth),
k AS MATERIALIZED (SELECT g.key, g.depth, count(x.key) AS n_children FROM g LEFT JOIN g x ON x.depth = g.depth + 1 AND left(x.key, length(x.key) - 32) = g.key GROUP BY g.key, g.depth),
a AS (SELECT d.key, d.depth, u.up, d.n_convs, d.words, d.n_children FROM (SELECT g.*, k.n_children FROM g JOIN k ON g.key = k.key) d, unnest(range(d.depth + 1)) AS u(up)),
s AS (SELECT left(key, up * 32) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM a GROUP BY ALL)
SELECT g.conv_id, g.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, g.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN k ON g.key = k.key JOIN s ON g.key = s.key LEFT JOIN g b ON g.depth > 0 AND b.key = left(g.key, length(g.key) - 32)""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from drawbook.llm.trie import prefix_trie

    return prefix_trie(read(spark, folder, "conversations"))
