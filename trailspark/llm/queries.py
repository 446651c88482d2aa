"""The operators bound to the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import decontaminate, htmltext, langid, mixing, negatives, permutation, preference, quality, simhash, topk, urlfilter, vectorcode, warc
from trailspark.llm.common import table

#: The URL list: (rule, date, action).  Hosts and parent domains that sell, bet or farm links, some lifted again, and two paths.
URL_LIST = (
    ("cheap-pills.example.com", "2024-01-05", "block"), ("cheap-pills.example.com", "2024-05-01", "remove"), ("cheap-pills.example.com", "2024-08-15", "block"),
    ("free-bets.example.com", "2024-02-10", "block"), ("m.free-bets.example.com", "2024-06-20", "allow"),
    ("adult-x.example.net", "2023-11-01", "block"), ("spam-farm.example.org", "2024-03-03", "block"), ("spam-farm.example.org", "2024-03-03", "allow"),
    ("example.org", "2024-09-01", "block"), ("example.org", "2024-09-08", "remove"),
    ("tionsh.example.net", "2024-04-01", "block"), ("tionsh.example.net", "2024-04-15", "remove"), ("blog.tionsh.example.net", "2024-04-10", "block"),
    ("tionsh.example.net/en", "2024-07-01", "block"), ("blog.tionsh.example.net/en", "2024-07-01", "allow"), ("www.ththwh.example.org/de", "2024-01-01", "block"),
)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def url_entries(spark: SparkSession) -> DataFrame:
    entry = [F.struct(*(F.lit(x).alias(k) for k, x in zip(("rule", "listed_at", "action"), row, strict=True))) for row in URL_LIST]
    return spark.range(1).select(F.inline(F.array(*entry)))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures; the table has no fetch time, so one is derived: an hour of 2024 from the page id."""
    hours = F.pmod(F.col("page_id") * 7919, F.lit(366 * 24)).cast("int")
    at = F.timestamp_seconds(F.lit(1704067200) + hours * 3600)
    return table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.evaluate(captures(spark, sf_dir), url_entries(spark))
    return found.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_s"), "verdict", "rule", F.unix_timestamp("listed_at").alias("listed_s"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index, sizes = topk.build_index(vectors)
    return topk.search(index, sizes, vectors.where("vec_id % 50 = 0"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"), into="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "quality_score.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.pairs(table(spark, sf_dir, "conversations"), *preference.by_parity())
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("pair_id", "segment", "part", "prompt", "chosen", "rejected", listed("chosen_mask").alias("chosen_mask"), listed("rejected_mask").alias("rejected_mask"), "paired")


def op11_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = vectorcode.encode(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation.search(*permutation.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_url_filter, op4_topk, op5_html_text, op6_simhash, op7_quality, op8_warc, op9_mixing, op10_preference, op11_vector_code, op12_permutation_index, op13_hard_negatives)
}

_OP1 = r"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n),
hit AS (
  SELECT DISTINCT p.r, p.i, p.n, pat.item
  FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM pos) p JOIN pat ON pat.n = p.n AND pat.win = p.win),
covered AS (SELECT r, count(DISTINCT at_word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS at_word FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

_ENTRIES = ", ".join(f"('{r}', TIMESTAMP '{d} 00:00:00', {dict(block=3, allow=2, remove=1)[a]})" for r, d, a in URL_LIST)
_OP3 = rf"""
WITH entry AS (SELECT rule, listed_at, max(s) AS s FROM (VALUES {_ENTRIES}) AS t(rule, listed_at, s) GROUP BY rule, listed_at),
span AS (SELECT rule, s, listed_at, lead(listed_at) OVER (PARTITION BY rule ORDER BY listed_at) AS ended FROM entry),
capture AS (
  SELECT row_number() OVER () AS r, page_id, url, 1704067200 + ((page_id * 7919) % 8784 + 8784) % 8784 * 3600 AS fetched_s,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
asked AS (
  SELECT r, fetched_s, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS k
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM capture)
  UNION
  SELECT r, fetched_s, host || '/' || array_to_string(list_slice(steps, 1, i), '/') FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM capture)),
hit AS (
  SELECT r, rule, s, listed_at, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) AS best
  FROM asked JOIN span ON k = rule AND s > 1 AND epoch(listed_at) <= fetched_s AND (ended IS NULL OR fetched_s < epoch(ended)))
SELECT page_id, url, CAST(fetched_s AS BIGINT) AS fetched_s, CASE s WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'unlisted' END AS verdict, rule,
       CAST(epoch(listed_at) AS BIGINT) AS listed_s
FROM capture LEFT JOIN (SELECT * FROM hit WHERE best = 1) USING (r)
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM t
"""

_SPAN = "CAST({0} + length(header) AS VARCHAR) || '-' || CAST({0} + length(rendered) - 1 AS VARCHAR)"
_OP10 = f"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 1 THEN 'rejected' ELSE 'chosen' END AS side, coalesce(turn, 9223372036854775807) AS turn, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT pair_id, turn, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS r, count(DISTINCT struct_pack(a := role, b := text)) AS d
  FROM t GROUP BY pair_id, turn),
p AS (SELECT pair_id, min(turn) FILTER (NOT (c = 1 AND r = 1 AND d = 1)) AS cut, sum(c) > 0 AND sum(r) > 0 AS paired, count(*) AS n_turns, max(turn) FILTER (turn < 9223372036854775807) AS highest FROM m GROUP BY pair_id),
k AS (
  SELECT t.*, paired, CAST(CASE WHEN n_turns > 256 THEN floor(least(turn, highest) / 256.0) ELSE 0 END AS BIGINT) AS segment, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS place,
         '<|im_start|>' || coalesce(role, '') || chr(10) AS header, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
  FROM t JOIN p USING (pair_id)),
o AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, segment, place, side ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_char
  FROM k)
SELECT pair_id, segment, CAST(0 AS BIGINT) AS part,
       coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (place = 'prompt' AND side = 'chosen'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (place = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (place = 'rejected'), '') AS rejected,
       coalesce(string_agg({_SPAN.format("at_char")}, ',' ORDER BY turn, role, text) FILTER (place = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg({_SPAN.format("at_char")}, ',' ORDER BY turn, role, text) FILTER (place = 'rejected' AND role = 'assistant'), '') AS rejected_mask,
       any_value(paired) AS paired
FROM o GROUP BY pair_id, segment
"""

_FIT = "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
#: A round of assignment, and one of moving the entries: the rounds are common tables one after another.
_ASSIGN = """a{n} AS MATERIALIZED (
  SELECT r, p, any_value(s) AS s, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT r, x.p, s, k, coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: (s[i] - c[i]) * (s[i] - c[i]))), 0) AS d FROM x JOIN c{n} USING (p))
  GROUP BY r, p)"""
_MOVE = """c{n} AS MATERIALIZED (
  SELECT c.p, c.k, coalesce(m.c, c.c) AS c
  FROM c{b} c LEFT JOIN (
    SELECT p, k, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
    FROM (SELECT p, k, i, sum(v) AS t, count(*) AS n FROM (SELECT p, best.k AS k, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS v FROM a{b}) GROUP BY p, k, i) GROUP BY p, k
  ) m ON m.p = c.p AND m.k = c.k)"""
_OP11 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q {_FIT}),
x AS MATERIALIZED (SELECT r, p, list_slice(q, p * len(q) // 8 + 1, (p + 1) * len(q) // 8) AS s FROM v, (SELECT unnest(range(8)) AS p)),
c0 AS MATERIALIZED (SELECT p, k, s AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS k FROM v QUALIFY k < 16) USING (r)),
{", ".join(x for n in range(6) for x in (_ASSIGN.format(n=n), _MOVE.format(n=n + 1, b=n)))},
{_ASSIGN.format(n=6)},
code AS (SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN code USING (r), books
"""

_PRODUCT = "CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT)"
_OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  {_FIT} AND label IS NOT NULL),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT} AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": _OP1, "op3_url_filter": _OP3, "op4_topk": _OP4, "op8_warc": _OP8, "op10_preference": _OP10, "op11_vector_code": _OP11, "op13_hard_negatives": _OP13,
}
