"""Queries over the training-data tables, and their SQL. Every query reads whole tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, brown, chat, decontam, linededup, mixing, neardup, pieces, ranked, token_store, topk, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring(table(spark, sf_dir, "documents"))


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op3_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk.search(e, e.where(F.col("vec_id") % 50 == 0), 5)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op4_quote_linking": op4_quote_linking,
    "op3_class_scores": op3_class_scores,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_token_store": op7_token_store,
    "op8_top_k": op8_top_k,
    "op9_mix_sources": op9_mix_sources,
    "op10_url_filter": op10_url_filter,
    "op11_piece_ids": op11_piece_ids,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# the templates of a leaf, one after another: what a round's constants do not take in votes in the next
_ROUNDS = "\n".join(
    f"""f{r} AS (SELECT n, lead, sum(docs) AS votes FROM g{r} GROUP BY ALL HAVING sum(docs) >= 5 AND count(*) > 1),
c{r} AS (SELECT n, lead, line, docs, votes, unnest(string_split(line, ' ')) AS tok, unnest(range(1, n + 1)) AS pos FROM g{r} JOIN f{r} USING (n, lead)),
v{r} AS (SELECT n, lead, votes, pos, tok, sum(docs) AS w FROM c{r} GROUP BY ALL),
k{r} AS (SELECT n, lead, pos, tok FROM v{r} QUALIFY row_number() OVER (PARTITION BY n, lead, pos ORDER BY w DESC, tok DESC) = 1 AND 2 * w >= votes),
j{r} AS (SELECT n, lead, line FROM c{r} JOIN k{r} USING (n, lead, pos, tok) GROUP BY ALL HAVING count(*) >= 0.7 * n),
g{r + 1} AS (SELECT * FROM g{r} ANTI JOIN j{r} USING (n, lead, line)),"""
    for r in range(linededup.ROUNDS)
)

ORACLE = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN w ELSE w[i:i+9] END AS x
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, l, w[i:i+l-1] AS x
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
             FROM d, (SELECT DISTINCT len(x) AS l FROM win))),
hit AS (SELECT doc_id, i, l, item FROM dw JOIN win USING (x)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_mix_sources": r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, source,
             CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
           FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER b AS k, sum(cap) OVER b - cap AS c, sum(w) OVER () - sum(w) OVER b + w AS left_w, sum(source_size) OVER () AS total
       FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - c::DOUBLE) / left_w::DOUBLE AS level FROM s2),
f AS (SELECT min(k) AS k1, arg_min(level, k) AS level1 FROM s3 WHERE level * w < cap),
t AS (SELECT source, source_size, CASE WHEN k1 IS NOT NULL AND k >= k1 THEN level1 * w::DOUBLE ELSE cap::DOUBLE END AS target FROM s3, f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t),
r AS (SELECT d.*, source_size, target, base, target - base * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS grp
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN 2 * upto - grp < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
      FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.x) = len(q.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw,
             list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(
               regexp_replace(l, '(^|[\x09-\x0D\x20])[^\x09-\x0D\x200-9@]*[0-9@][^\x09-\x0D\x20]*', '\1<*>', 'g'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ')) AS lines FROM documents),
l AS (SELECT doc_id, pos, lines[pos + 1] AS line, len(string_split(lines[pos + 1], ' ')) AS n
      FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM d)),
g0 AS (SELECT n, array_to_string(string_split(line, ' ')[1:3], ' ') AS lead, line, count(DISTINCT doc_id) AS docs FROM l WHERE n >= 3 GROUP BY ALL),
""" + _ROUNDS + """
t AS (""" + " UNION ALL ".join(f"SELECT line, 'J{r} ' || n || ' ' || lead AS template FROM j{r}" for r in range(linededup.ROUNDS)) + """
      UNION ALL SELECT line, 'A' || line FROM g0 WHERE docs >= 5 AND line NOT IN (""" + " UNION ALL ".join(f"SELECT line FROM j{r}" for r in range(linededup.ROUNDS)) + """)),
h AS (SELECT doc_id, pos, template FROM l JOIN t USING (line)),
o AS (SELECT template FROM h GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM h JOIN o USING (template) GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(raw)), lambda i: NOT list_contains(gone, i)), lambda i: raw[i + 1]), chr(10)) END AS text
FROM d LEFT JOIN x USING (doc_id)""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
             100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false) AS e
      FROM t LEFT JOIN l USING (doc_id)),
n AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
i AS (SELECT unnest(range(5)) AS k),
o AS (SELECT [i1.k, i2.k, i3.k, i4.k, i5.k] AS ks FROM i i1, i i2, i i3, i i4, i i5 WHERE len(list_distinct([i1.k, i2.k, i3.k, i4.k, i5.k])) = 5),
s AS (SELECT array_to_string(list_transform(ks, lambda k: substr('ABCDE', CAST(k + 1 AS INTEGER), 1)), '') AS filter_order, step, ks[step] AS k, (1 << ks[step]) AS bit,
             CAST(list_sum(list_transform(list_concat([NULL], ks[1:step - 1]), lambda k: CASE WHEN k IS NULL THEN 0 ELSE 1 << k END)) AS BIGINT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, k, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM n, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r""",
    "op13_ranked_search": f"""
WITH d AS (SELECT *, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
b AS (SELECT DISTINCT q, item_id, unnest({_TERMS}) AS t FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY t, big_n),
x AS (SELECT r, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS x FROM p JOIN w USING (t), s),
c AS (SELECT q, item_id, r, doc_id, CAST(sum(x) AS BIGINT) AS score FROM b JOIN x USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 50""",
}
