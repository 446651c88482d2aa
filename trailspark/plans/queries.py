"""A query per operator over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions import canonical, protocol
from trailspark.functions import text as T
from trailspark.operators import branches, execution, metrics, quality, replay, rollout, routing, sft, split, stats, transcript
from trailspark.plans import adapters as A
from trailspark.plans import dataset, fixtures
from trailspark.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ATTEMPTS = """attempts AS (
  SELECT event_id, user_id AS task, ts, CAST(ts AS DATE) AS day, value,
         CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'view' THEN 'ASSERTION_FAILURE' WHEN 'error' THEN 'RUNTIME_ERROR' WHEN 'click' THEN 'TIMEOUT' ELSE 'OTHER' END AS outcome,
         CASE event_type WHEN 'click' THEN 'apply_patch' WHEN 'signup' THEN 'read_file' ELSE 'python_test' END AS tool
  FROM events)"""
STEPS = ATTEMPTS + ", steps AS (SELECT *, lag(outcome) OVER (PARTITION BY task ORDER BY ts, event_id) AS predicted FROM attempts)"
PREDICTIONS = STEPS + ", predictions AS (SELECT event_id, task, predicted AS sampled_prediction, outcome AS actual, CASE WHEN predicted = 'PASS' THEN 'KEEP' ELSE 'REVISE' END AS decision FROM steps)"
TRACES = STEPS + """, marked AS (
  SELECT *, CAST(task AS VARCHAR) || '/' || CAST(day AS VARCHAR) AS trace, row_number() OVER (PARTITION BY task, day ORDER BY ts DESC, event_id DESC) AS from_end,
         row_number() OVER (PARTITION BY task, day ORDER BY ts, event_id) AS rn, tool = 'python_test' AS is_test FROM steps),
failing AS (SELECT trace, min(CASE WHEN is_test AND outcome <> 'PASS' THEN rn END) AS f, min(CASE WHEN is_test THEN rn END) AS t0 FROM marked GROUP BY trace),
per AS (
  SELECT trace AS task, bool_or(from_end = 1 AND outcome = 'PASS') AS solved, count(*) AS tool_calls, count(*) FILTER (is_test) AS test_calls,
         greatest(0, count(*) FILTER (tool = 'apply_patch') - 1) AS revisions, coalesce(bool_or(rn = t0 AND outcome = 'PASS'), false) AS first_ok,
         coalesce(bool_or(is_test AND outcome <> 'PASS'), false) AS had_failure, coalesce(bool_or(is_test AND outcome = 'PASS' AND rn > f), false) AS won,
         count(*) FILTER (is_test AND predicted = outcome) AS right_predictions, count(*) FILTER (is_test AND outcome <> 'PASS') AS bad,
         count(*) FILTER (is_test AND outcome <> 'PASS' AND coalesce(predicted, '') <> 'PASS') AS bad_rejected, count(*) FILTER (is_test AND outcome = 'PASS') AS good,
         count(*) FILTER (is_test AND outcome = 'PASS' AND coalesce(predicted, '') <> 'PASS') AS good_rejected, 7 * count(*) AS n_tokens
  FROM marked JOIN failing USING (trace) GROUP BY trace)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at 6 places: engines differ in the last bits."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


@query("SELECT doc_id AS task_id, 'doc_' || CAST(doc_id AS VARCHAR) AS case_id, length(trim(text)) AS prompt_chars, 'train' AS split FROM documents WHERE lang = 'en'")
def scan_tasks_projected(spark, sf_dir):
    rows = docs(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("task_id"), T.newlines("text").alias("prompt"))
    return rows.select("task_id", F.concat(F.lit("doc_"), F.col("task_id").cast("string")).alias("case_id"), F.length("prompt").cast("long").alias("prompt_chars"), F.lit("train").alias("split"))


@query("""SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing,
  CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) > 50 AS BOOLEAN) AS passed FROM events""")
def scan_events_json_props(spark, sf_dir):
    from trailspark.sources import lines

    row = F.try_parse_json("props")
    return A.table(spark, sf_dir, "events").select(
        "event_id", lines.present(row, "$.k").alias("has_k"), lines.present(row, "$.missing").alias("has_missing"), (F.coalesce(lines.number(row, "$.k"), F.lit(0.0)) > 50).alias("passed")
    )


_KEY = "sha256('42' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || text)"


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {_KEY}, doc_id) AS INTEGER) AS position, lang FROM documents QUALIFY position <= 50")
def seeded_order_topk(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text", "lang")
    return split.seeded_top(rows, 50, task_id="doc_id", prompt="text").select("doc_id", "position", "lang")


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) AS n FROM documents)
SELECT doc_id AS task_id, CASE WHEN n <= 50 THEN 'first' WHEN n <= 90 THEN 'second' ELSE 'rest' END AS part FROM r
UNION ALL SELECT 1000000000 + item_id, 'heldout' FROM benchmark""")
def seeded_three_way_split(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("task_id"), F.col("text").alias("prompt"))
    held = A.table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("task_id"), F.lit("heldout").alias("part"))
    return split.three_way_split(rows, 50, 40).unionByName(held)


@query(f"""WITH t AS (SELECT doc_id, {_KEY} AS key, n_chars % 7 = 0 AS deep_ok, n_chars % 2 = 0 AS shallow_ok FROM documents),
deep AS (SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) AS position FROM t WHERE deep_ok QUALIFY position <= 10),
shallow AS (SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) AS position FROM t WHERE shallow_ok AND doc_id NOT IN (SELECT doc_id FROM deep) QUALIFY position <= 25),
a AS (SELECT doc_id, 'deep' AS tier, position FROM deep UNION ALL SELECT doc_id, 'shallow', position FROM shallow)
SELECT doc_id, tier, CAST(position AS INTEGER) AS position, CASE WHEN (position - 1) % 2 = 0 THEN 'shadow' ELSE 'visible' END AS mode FROM a""")
def quota_fill_two_tier(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", split.seeded_key(42, "doc_id", "text").alias("key"), (F.col("n_chars") % 7 == 0).alias("deep_ok"), (F.col("n_chars") % 2 == 0).alias("shallow_ok"))
    return split.quota_fill(rows, 10, 25, task_id="doc_id")


@query("""WITH a AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0), c AS (SELECT item_id AS id FROM benchmark)
SELECT 'third' AS a, 'fifth' AS b, (SELECT count(*) FROM a WHERE id IN (FROM b)) AS shared, (SELECT count(*) FROM a WHERE id NOT IN (FROM b)) AS only_a, (SELECT count(*) FROM b WHERE id NOT IN (FROM a)) AS only_b
UNION ALL SELECT 'third', 'heldout', (SELECT count(*) FROM a WHERE id IN (FROM c)), (SELECT count(*) FROM a WHERE id NOT IN (FROM c)), (SELECT count(*) FROM c WHERE id NOT IN (FROM a))
UNION ALL SELECT 'fifth', 'heldout', (SELECT count(*) FROM b WHERE id IN (FROM c)), (SELECT count(*) FROM b WHERE id NOT IN (FROM c)), (SELECT count(*) FROM c WHERE id NOT IN (FROM b))""")
def split_disjointness_violations(spark, sf_dir):
    d = docs(spark, sf_dir)
    return split.id_violations({
        "third": d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")), "fifth": d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id")),
        "heldout": A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")),
    }, "id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return split.repeated_ids(A.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'ASSERTION_FAILURE' WHEN quality = 0 THEN 'RUNTIME_ERROR' ELSE 'PASS' END AS candidate_outcome,
  quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)""")
def outer_lookup_labels(spark, sf_dir):
    second = F.when(F.col("toxic") == 1, "ASSERTION_FAILURE")
    first = F.when(F.col("quality") == 0, "RUNTIME_ERROR")
    joined = docs(spark, sf_dir).select("doc_id").join(A.table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(second, first, F.lit("PASS")).alias("candidate_outcome"), F.col("quality").isNotNull().alias("labelled"))


@query("""SELECT arm, 'blueprints/doc_' || CAST(doc_id AS VARCHAR) AS blueprint_root, 'doc_' || CAST(doc_id AS VARCHAR) AS case_id, doc_id AS task_id, 2 AS n_messages,
  CASE arm WHEN 'a' THEN 'Work step by step.' ELSE 'State the outcome, decide, then act.' END AS system,
  sha256('Implement the requested Python function in solution.py. Run the tests.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Your code must pass these tests:' || chr(10)
    || 'assert f(' || CAST(doc_id AS VARCHAR) || ')' || chr(10) || chr(10) || 'The project is at data/blueprints/doc_' || CAST(doc_id AS VARCHAR) || '.') AS user_sha256
  FROM documents, (VALUES ('a'), ('b')) AS arms(arm)""")
def arm_fanout_task_rows(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    tasks = docs(spark, sf_dir).select(
        F.col("doc_id").alias("task_id"), F.concat(F.lit("doc_"), ident).alias("case_id"), F.col("text").alias("prompt"),
        F.concat(F.lit("assert f("), ident, F.lit(")\n")).alias("test_code"), F.lit("train").alias("split"),
    )
    rows = transcript.task_rows(tasks)
    return rows.select("arm", "blueprint_root", "case_id", "task_id", F.size("prompt").alias("n_messages"), F.col("prompt")[0]["content"].alias("system"), T.sha256(F.col("prompt")[1]["content"]).alias("user_sha256"))


def _arms(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    b = d.where("doc_id % 50 <> 7").select("doc_id", F.when(F.col("doc_id") % 40 == 3, None).otherwise(F.col("lang")).alias("lang"), "source", (F.col("n_chars") + (F.col("doc_id") % 60 == 5).cast("int")).alias("n_chars"))
    return d, b


_ARMS = """a AS (SELECT doc_id, lang, source, n_chars FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 40 <> 3 THEN lang END AS lang, source, n_chars + CASE WHEN doc_id % 60 = 5 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 50 <> 7)"""


@query(f"""WITH {_ARMS}, j AS (SELECT a.doc_id, b.doc_id IS NULL AS gone, a.lang IS DISTINCT FROM b.lang AS l, a.source IS DISTINCT FROM b.source AS s, a.n_chars IS DISTINCT FROM b.n_chars AS n FROM a LEFT JOIN b USING (doc_id))
SELECT doc_id, 'missing right' AS problem FROM j WHERE gone UNION ALL SELECT doc_id, 'lang' FROM j WHERE NOT gone AND l
UNION ALL SELECT doc_id, 'source' FROM j WHERE NOT gone AND s UNION ALL SELECT doc_id, 'n_chars' FROM j WHERE NOT gone AND n""")
def paired_field_audit(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return split.field_audit(a, b, "doc_id", ["lang", "source", "n_chars"])


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || rtrim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || '<|im_end|>' || chr(10) || chr(10), '' ORDER BY turn)
  || '<|im_start|>assistant' || chr(10) AS rendered FROM conversations GROUP BY conv_id""")
def chatml_render(spark, sf_dir):
    rows = transcript.messages_of(A.table(spark, sf_dir, "conversations"), "conv_id")
    return rows.select("conv_id", transcript.render(F.col("messages"), generation_prompt=True).alias("rendered"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS trained, count(*) FILTER (role <> 'assistant') AS masked FROM conversations GROUP BY conv_id")
def role_loss_mask(spark, sf_dir):
    rows = transcript.messages_of(A.table(spark, sf_dir, "conversations"), "conv_id").withColumn("mask", transcript.role_mask(F.col("messages")))
    count = lambda v: F.size(F.filter("mask", lambda m: m == v)).cast("long")
    return rows.select("conv_id", count(F.lit(True)).alias("trained"), count(F.lit(False)).alias("masked"))


@query(r"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 'FINAL: ' || text ELSE text END AS text FROM conversations),
c AS (SELECT conv_id, sum(len(regexp_extract_all(text, '[^\t-\r ]+'))) AS tokens, arg_max(role = 'assistant' AND trim(text) LIKE 'FINAL:%', turn) AS final FROM m GROUP BY conv_id)
SELECT count(*) AS n_rows, count(*) FILTER (tokens > 120) AS over_cap, count(*) FILTER (NOT final) AS missing_final, CAST(max(tokens) AS BIGINT) AS longest, arg_min(conv_id, -tokens * 1000000000 + conv_id) AS longest_case FROM c""")
def length_cap_and_final(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    said = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.concat(F.lit("FINAL: "), "text")).otherwise(F.col("text"))
    rows = transcript.messages_of(c.withColumn("text", said), "conv_id")
    tokens = F.aggregate("messages", F.lit(0), lambda a, m: a + transcript.count_words(m["content"]))
    return transcript.length_audit(rows.select("conv_id", tokens.alias("tokens"), transcript.ends_final(F.col("messages")).alias("final")), 120, key="conv_id")


def _turn_texts(spark, sf_dir):
    """Turns of every shape, by event type and parity."""
    s = A.steps(spark, sf_dir)
    call = F.concat(F.lit('CALL python_test {"id":"c'), F.col("event_id").cast("string"), F.lit('"}'))
    tags = F.concat(F.lit("<PREDICTION>"), F.coalesce("predicted", F.lit("MAYBE")), F.lit("</PREDICTION>\n<DECISION>"), F.when(F.col("predicted") == "PASS", "KEEP").otherwise("REVISE"), F.lit("</DECISION>\n"))
    k = F.col("event_id") % 7
    text = (
        F.when(k == 0, call).when(k == 1, F.concat(tags, call)).when(k == 2, F.concat(F.lit("thinking\n"), call)).when(k == 3, F.lit("FINAL: done"))
        .when(k == 4, F.lit("no call at all")).when(k == 5, F.concat(call, F.lit("\n"), call)).otherwise(F.concat(tags, tags, call))
    )
    return s.select("event_id", text.alias("text"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"), (F.col("event_id") % 3 == 0).alias("pending"))


_TURNS = STEPS + """, turns AS (SELECT event_id, event_id % 7 AS k, 'CALL python_test {"id":"c' || CAST(event_id AS VARCHAR) || '"}' AS call, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, event_id % 3 = 0 AS pending,
  coalesce(predicted, 'MAYBE') AS p, CASE WHEN predicted = 'PASS' THEN 'KEEP' ELSE 'REVISE' END AS d FROM steps)"""


@query(f"""WITH {_TURNS} SELECT event_id, CASE
  WHEN k = 3 THEN NULL WHEN k = 4 THEN 'assistant turn must contain exactly one CALL or one FINAL'
  WHEN arm = 'b' AND pending THEN CASE WHEN k = 1 THEN NULL WHEN k = 5 THEN 'Arm B prediction turn requires PREDICTION, DECISION, and one CALL' ELSE 'Arm B prediction turn requires PREDICTION, DECISION, and one CALL' END
  WHEN k = 0 THEN NULL ELSE 'CALL turn cannot contain additional text' END AS error FROM turns""")
def turn_shape_check(spark, sf_dir):
    t = _turn_texts(spark, sf_dir).withColumn("n", F.size(protocol.parse_calls(F.col("text"))["calls"]))
    return t.select("event_id", protocol.turn_shape_error(F.col("text"), F.col("n"), F.col("arm"), F.col("pending")).alias("error"))


@query(f"""WITH {_TURNS} SELECT event_id, CASE WHEN k = 1 THEN p END AS prediction, CASE WHEN k = 1 THEN d END AS decision,
  CASE WHEN k = 1 THEN CASE WHEN p = 'MAYBE' THEN 'unknown prediction outcome: MAYBE' ELSE '' END ELSE 'Arm B requires exactly one PREDICTION; Arm B requires exactly one DECISION' END AS errors FROM turns""")
def prediction_tag_parse(spark, sf_dir):
    parsed = _turn_texts(spark, sf_dir).withColumn("p", protocol.parse_prediction(F.col("text")))
    return parsed.select("event_id", "p.prediction", "p.decision", F.array_join("p.errors", "; ").alias("errors"))


@query(f"""WITH {_TURNS} SELECT event_id, CAST(CASE WHEN k IN (3, 4) THEN 0 ELSE 1 END AS INTEGER) AS n_calls, CASE WHEN k IN (3, 4) THEN NULL ELSE 'c' || CAST(event_id AS VARCHAR) END AS first_id,
  CASE WHEN k = 5 THEN 'line 2: duplicate CALL id c' || CAST(event_id AS VARCHAR) ELSE '' END AS errors FROM turns""")
def call_line_parse(spark, sf_dir):
    parsed = _turn_texts(spark, sf_dir).withColumn("c", protocol.parse_calls(F.col("text")))
    return parsed.select("event_id", F.size("c.calls").alias("n_calls"), F.get("c.calls", F.lit(0))["id"].alias("first_id"), F.array_join("c.errors", "; ").alias("errors"))


_STDERR = {"view": "Traceback (most recent call last)\nAssertionError", "error": "Traceback (most recent call last)\nKeyError", "signup": "  IndentationError: AssertionError", "click": "killed"}


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'TIMEOUT' WHEN event_type = 'signup' THEN 'SYNTAX_ERROR' WHEN event_type = 'view' THEN 'ASSERTION_FAILURE' WHEN event_type = 'error' THEN 'RUNTIME_ERROR' ELSE 'OTHER' END AS outcome,
  CASE WHEN event_type IN ('click', 'view') THEN CASE event_type WHEN 'view' THEN 'ASSERTION_FAILURE' ELSE 'TIMEOUT' END WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'OTHER' END AS result_class FROM events""")
def outcome_from_stderr(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    stderr = protocol.lookup(F.col("event_type"), _STDERR)
    given = F.when(F.col("event_type") == "view", "ASSERTION_FAILURE").when(F.col("event_type") == "click", "TIMEOUT").otherwise("unheard of")
    return e.select("event_id", protocol.outcome_of_stderr(stderr, F.col("event_id") % 11 == 0).alias("outcome"), protocol.outcome_of_result(given, F.col("event_id") % 2 == 0).alias("result_class"))


@query(f"""WITH {ATTEMPTS} SELECT event_id, 'RESULT c' || CAST(event_id AS VARCHAR) || ':' || chr(10) || CASE WHEN outcome = 'PASS' THEN 'status: success' || chr(10) || 'stdout:' || chr(10) || 'tests passed'
  ELSE 'status: failed' || CASE WHEN outcome = 'TIMEOUT' THEN chr(10) || 'timed_out: true' ELSE '' END || chr(10) || 'stderr:' || chr(10)
    || CASE outcome WHEN 'RUNTIME_ERROR' THEN 'generated solution raised a runtime error' WHEN 'TIMEOUT' THEN 'tests timed out' ELSE 'tests failed' END END AS block FROM attempts""")
def result_block_render(spark, sf_dir):
    a = A.attempts(spark, sf_dir)
    ok = F.col("outcome") == "PASS"
    block = protocol.result_block(F.concat(F.lit("c"), F.col("event_id").cast("string")), ok, F.col("outcome") == "TIMEOUT", F.when(ok, "tests passed\n"), protocol.lookup(F.col("outcome"), protocol.FAILURE_TEXT))
    return a.select("event_id", block.alias("block"))


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN '' ELSE split_part(text, ' ', 3) END AS find FROM documents),
n AS (SELECT *, CASE WHEN find = '' THEN length(text) + 1 ELSE (length(text) - length(replace(text, find, ''))) // length(find) END AS n FROM d)
SELECT doc_id, CAST(n AS INTEGER) AS occurrences, CASE WHEN find <> '' AND n = 1 THEN sha256(replace(text, find, 'patched')) END AS patched_sha256 FROM n""")
def patch_apply_exactly_once(spark, sf_dir):
    find = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.split_part("text", F.lit(" "), F.lit(3)))
    rows = docs(spark, sf_dir).select("doc_id", "text", find.alias("find"))
    return rows.select("doc_id", T.occurrences(F.col("text"), F.col("find")).alias("occurrences"), T.sha256(T.replace_once(F.col("text"), F.col("find"), F.lit("patched"))).alias("patched_sha256"))


@query("SELECT doc_id, sha256(text) AS digest, substr(text, 1, 8000) = text AS whole, strlen(text) AS bytes FROM documents")
def content_digest(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.sha256("text").alias("digest"), (F.substring("text", 1, 8000) == F.col("text")).alias("whole"), F.octet_length("text").cast("long").alias("bytes"))


_PASSK = "CASE WHEN n - c < 4 THEN 1.0::DOUBLE ELSE 1 - list_product([CAST(n - c - i AS DOUBLE) / (n - i) FOR i IN range(4)]) END"


@query(f"""WITH {ATTEMPTS}, g AS (SELECT task, count(*) AS n, count(*) FILTER (outcome = 'PASS') AS c FROM attempts GROUP BY task)
SELECT count(*) AS tasks, count(*) FILTER (c > 0) AS tasks_with_any_pass, round(avg({_PASSK}), 6) AS pass_at_k FROM g""")
def pass_at_k_summary(spark, sf_dir):
    return rounded(metrics.summarise(A.attempts(spark, sf_dir), 4))


@query(f"""WITH {ATTEMPTS}, g AS (SELECT task, event_id % 2 AS h, count(*) AS n, count(*) FILTER (outcome = 'PASS') AS c FROM attempts GROUP BY ALL),
p AS (SELECT task, h, {_PASSK} AS p FROM g), j AS (SELECT a.p AS a, b.p AS b FROM p a JOIN p b ON a.task = b.task AND a.h = 0 AND b.h = 1)
SELECT count(*) AS tasks, round(avg(a), 6) AS before_pass_at_k, round(avg(b), 6) AS after_pass_at_k, round(avg(b) - avg(a), 6) AS delta,
  count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses, count(*) FILTER (a = b) AS ties FROM j""")
def pass_at_k_compare(spark, sf_dir):
    a = A.attempts(spark, sf_dir)
    return rounded(metrics.compare(a.where("event_id % 2 = 0"), a.where("event_id % 2 = 1"), 4))


_R = lambda a, b: f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"


@query(f"""WITH {TRACES} SELECT count(*) AS traces, {_R("count(*) FILTER (solved)", "count(*)")} AS final_pass_at_1, {_R("count(*) FILTER (first_ok)", "count(*)")} AS first_patch_success,
  count(*) FILTER (had_failure) AS tasks_with_executed_failure, {_R("count(*) FILTER (solved AND won)", "count(*) FILTER (had_failure)")} AS executed_failure_recovery_rate,
  {_R("sum(test_calls) FILTER (solved)", "count(*) FILTER (solved)")} AS visible_python_tests_per_solved_task, {_R("sum(test_calls)", "count(*)")} AS average_visible_python_tests,
  {_R("sum(tool_calls)", "count(*)")} AS average_visible_tool_calls, {_R("sum(revisions)", "count(*)")} AS average_revisions, round(avg(n_tokens), 6) AS average_total_tokens,
  CAST(sum(test_calls) AS BIGINT) AS prediction_count, {_R("sum(right_predictions)", "sum(test_calls)")} AS prediction_accuracy,
  {_R("sum(bad_rejected)", "sum(bad)")} AS bad_patch_rejection_rate, {_R("sum(good_rejected)", "sum(good)")} AS good_patch_unnecessary_rejection_rate FROM per""")
def trace_report_global(spark, sf_dir):
    return rounded(metrics.report(A.traces(spark, sf_dir)))


@query(f"WITH {PREDICTIONS} SELECT coalesce(sampled_prediction, 'INVALID') AS predicted, actual, count(*) AS n FROM predictions GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(A.predictions(spark, sf_dir))


@query(f"""WITH {PREDICTIONS}, classes AS (SELECT unnest(['PASS', 'ASSERTION_FAILURE', 'RUNTIME_ERROR', 'SYNTAX_ERROR', 'TIMEOUT', 'OTHER']) AS class),
s AS (SELECT class, count(*) FILTER (sampled_prediction = class AND actual = class) AS tp, count(*) FILTER (sampled_prediction = class) AS p, count(*) FILTER (actual = class) AS a FROM classes, predictions GROUP BY class),
f AS (SELECT class, coalesce(CAST(tp AS DOUBLE) / nullif(p, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(a, 0), 0) AS recall, coalesce(2.0 * CAST(tp AS DOUBLE) / nullif(p + a, 0), 0) AS f1 FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round((SELECT sum(f1) FROM f) / 6, 6) AS macro_f1 FROM f""")
def prediction_f1_by_class(spark, sf_dir):
    return rounded(metrics.f1_by_class(metrics.confusion(A.predictions(spark, sf_dir))))


@query(f"""WITH {PREDICTIONS} SELECT count(*) FILTER (actual <> 'PASS') AS bad, {_R("count(*) FILTER (actual <> 'PASS' AND decision = 'REVISE')", "count(*) FILTER (actual <> 'PASS')")} AS bad_patch_rejection_rate,
  count(*) FILTER (actual = 'PASS') AS good, {_R("count(*) FILTER (actual = 'PASS' AND decision = 'REVISE')", "count(*) FILTER (actual = 'PASS')")} AS good_patch_unnecessary_rejection_rate FROM predictions""")
def patch_rejection_rates(spark, sf_dir):
    from trailspark.functions.numeric import ratio

    bad, revised = ~F.col("actual").eqNullSafe("PASS"), F.col("decision") == "REVISE"
    return rounded(A.predictions(spark, sf_dir).agg(
        F.count_if(bad).alias("bad"), ratio(F.count_if(bad & revised), F.count_if(bad)).alias("bad_patch_rejection_rate"),
        F.count_if(~bad).alias("good"), ratio(F.count_if(~bad & revised), F.count_if(~bad)).alias("good_patch_unnecessary_rejection_rate"),
    ))


@query(f"""WITH {TRACES} SELECT task, tool_calls, test_calls, revisions, first_ok AS first_patch_correct, had_failure AS had_executed_failure, won AS recovered_any, solved AND won AS recovered_solved,
  {_R("right_predictions", "test_calls")} AS prediction_accuracy, {_R("bad_rejected", "bad")} AS bad_patch_rejection_rate, {_R("good_rejected", "good")} AS unnecessary_rejection_rate FROM per""")
def trace_metrics_per_trace(spark, sf_dir):
    return rounded(metrics.per_trace(A.traces(spark, sf_dir)).select(
        "task", "tool_calls", "test_calls", "revisions", "first_patch_correct", "had_executed_failure", "recovered_any", "recovered_solved", "prediction_accuracy", "bad_patch_rejection_rate", "unnecessary_rejection_rate"
    ))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS is_last FROM conversations),
calls AS (SELECT conv_id, turn, 'c' || CAST(turn AS VARCHAR) AS id, length(text) % 2 = 0 AS success FROM m WHERE role = 'assistant'),
f AS (SELECT conv_id, arg_min(id, turn) AS id FROM calls WHERE success GROUP BY conv_id),
l AS (SELECT conv_id, bool_or(is_last AND role = 'assistant' AND conv_id % 5 <> 0) AS final FROM m GROUP BY conv_id),
s AS (SELECT DISTINCT f.conv_id FROM f JOIN m ON m.conv_id = f.conv_id AND NOT is_last AND role = 'user' AND 'c' || CAST(turn - 1 AS VARCHAR) = f.id)
SELECT l.conv_id, CAST(CASE WHEN s.conv_id IS NOT NULL AND final AND l.conv_id % 3 <> 0 AND l.conv_id % 7 <> 0 AND l.conv_id % 13 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS reward FROM l LEFT JOIN s USING (conv_id)""")
def binary_reward(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last = F.array_max(F.transform("m", lambda m: m["turn"]))
    call_id = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    said = lambda m: F.when((m["turn"] == last) & (F.col("conv_id") % 5 != 0), F.concat(F.lit("FINAL: "), m["text"])).otherwise(m["text"])
    as_tool = lambda m: F.when(m["role"] == "user", "tool").otherwise(m["role"])
    messages = F.transform("m", lambda m: F.struct(as_tool(m).alias("role"), said(m).alias("content"), F.when(m["role"] == "user", call_id(m["turn"] - 1)).alias("tool_call_id")))
    spoken = F.filter("m", lambda m: m["role"] == "assistant")
    calls = F.transform(spoken, lambda m: F.struct(F.lit("python_test").alias("tool"), call_id(m["turn"]).alias("id")))
    results = F.map_from_entries(F.transform(spoken, lambda m: F.struct(call_id(m["turn"]), F.struct((F.length(m["text"]) % 2 == 0).alias("success")))))
    errors = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    reason = transcript.truncation_reason(F.col("conv_id") % 13 == 0, F.array(F.size("m")))
    return rows.select("conv_id", metrics.binary_reward(reason.isNotNull(), calls, results, F.col("conv_id") % 3 != 0, errors, messages).alias("reward"))


@query(f"WITH {ATTEMPTS} SELECT task, arg_max(outcome, event_id) AS outcome FROM attempts GROUP BY task")
def last_write_wins(spark, sf_dir):
    return split.last_by(A.attempts(spark, sf_dir), ["task"], F.col("event_id"), "outcome")


_PAIR = "count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic = 0) AS a_only, count(*) FILTER (quality = 0 AND toxic = 1) AS b_only, count(*) FILTER (quality = 0 AND toxic = 0) AS neither"


def _pair(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels")
    side = lambda c: rows.select(F.col("doc_id").alias("name"), F.col(c).alias("outcome"))
    return stats.contingency(side("quality"), side("toxic"))


@query(f"SELECT {_PAIR}, round(100.0 * avg(quality), 6) AS rate_a, round(100.0 * avg(toxic), 6) AS rate_b, round(100.0 * avg(toxic) - 100.0 * avg(quality), 6) AS diff FROM labels")
def paired_contingency(spark, sf_dir):
    return rounded(_pair(spark, sf_dir))


_SEVENTH = "CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END"


@query(f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND b = 0) AS a_only, count(*) FILTER (quality = 0 AND b = 1) AS b_only FROM (SELECT quality, {_SEVENTH} AS b FROM labels)),
s AS (SELECT *, a_only + b_only AS n, least(a_only, b_only) AS low, CASE WHEN a_only + b_only > 0 THEN CAST((abs(a_only - b_only) - 1) ** 2 AS DOUBLE) / (a_only + b_only) END AS statistic FROM c),
e AS (SELECT *, sqrt(statistic / 2) AS x FROM s)
SELECT a_only, b_only, round(statistic, 6) AS statistic,
  round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(20000), lambda i: exp(-((x * (i + 0.5) / 20000) ** 2)) * x / 20000)), 6) AS p_value,
  round(least(1.0, 2 * list_sum(list_transform(range(low + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))))), 6) AS p_exact FROM e""")
def mcnemar_test(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels")
    a = rows.select(F.col("doc_id").alias("name"), F.col("quality").alias("outcome"))
    b = rows.select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1).alias("outcome"))
    return rounded(stats.mcnemar(stats.contingency(a, b)).select("a_only", "b_only", "statistic", "p_value", "p_exact"))


@query()
def paired_bootstrap_ci(spark, sf_dir):
    """10,000 resamples; no SQL draws from a multinomial distribution, so tests compare with pairs drawn one by one."""
    return rounded(stats.bootstrap_ci(_pair(spark, sf_dir)))


@query(f"""WITH {ATTEMPTS}, w AS (SELECT event_id, task, value - avg(value) OVER g AS advantage, max(value) OVER g <> min(value) OVER g AS spread FROM attempts WINDOW g AS (PARTITION BY task, day))
SELECT event_id, task, round(advantage, 6) AS advantage FROM w WHERE spread""")
def group_advantage_filtered(spark, sf_dir):
    return rounded(routing.group_advantage(A.attempts(spark, sf_dir), ["task", "day"], "value").select("event_id", "task", "advantage"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset FROM conversations")
def cumulative_token_offsets(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return transcript.node_offsets(rows, "conv_id", "turn", "size").select("conv_id", "turn", F.col("offset").alias("token_offset"))


@query("SELECT conv_id, turn, CASE WHEN length(substr(text, 5, 6)) > 0 THEN CAST(strpos(text, substr(text, 5, 6)) - 1 AS INTEGER) END AS found, CASE WHEN strpos(text, 'zzz') > 0 THEN strpos(text, 'zzz') - 1 END AS absent FROM conversations")
def subsequence_search(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").withColumn("ids", routing.code_points(F.col("text")))
    part = routing.code_points(F.substring("text", 5, 6))
    return rows.select("conv_id", "turn", routing.find_subsequence(F.col("ids"), part).alias("found"), routing.find_subsequence(F.col("ids"), routing.code_points(F.lit("zzz"))).cast("long").alias("absent"))


@query(f"""WITH {PREDICTIONS} SELECT event_id, CAST(CASE WHEN sampled_prediction IS NULL THEN 0 ELSE length(sampled_prediction) END AS INTEGER) AS masked,
  CASE WHEN sampled_prediction IS NOT NULL THEN CAST(17 AS INTEGER) END AS first_masked FROM predictions""")
def label_token_mask(spark, sf_dir):
    said = F.concat(F.lit("text "), F.coalesce(F.concat(F.lit("<PREDICTION>"), "sampled_prediction", F.lit("</PREDICTION>")), F.lit("none")), F.lit(" end"))
    rows = A.predictions(spark, sf_dir).select(F.col("event_id").alias("rollout"), F.lit(0).alias("node"), F.lit("assistant").alias("role"), said.alias("content"), F.lit(True).alias("sampled"))
    found = rollout.hidden_places(rows.withColumn("token_ids", routing.code_points(F.col("content"))))
    return found.select(F.col("rollout").alias("event_id"), F.size("places").alias("masked"), F.array_min("places").alias("first_masked"))


@query(f"""WITH {PREDICTIONS} SELECT event_id, CAST(length('<|im_start|>user' || chr(10) || 'context' || chr(10) || '<|im_end|>' || chr(10) || chr(10) || '<|im_start|>assistant' || chr(10)) + 25 + length(actual) AS INTEGER) AS n_tokens,
  round(0.1 * length(actual), 6)::DOUBLE AS ce_sum, 0.0::DOUBLE AS rl_sum FROM predictions""")
def auxiliary_ce_samples(spark, sf_dir):
    context = F.array(F.struct(F.lit("user").alias("role"), F.lit("context").alias("content")))
    target = F.struct(context.alias("context_messages"), F.col("sampled_prediction").alias("sampled_prediction"), F.col("actual").alias("actual"))
    rows = A.predictions(spark, sf_dir).select(F.col("event_id").alias("rollout"), F.lit("env").alias("env_name"), F.lit(None).cast(f"array<{rollout.SAMPLE}>").alias("samples"), F.array(target).alias("targets"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    found = rollout.verified_samples(rows)
    return rounded(found.select(F.col("rollout").alias("event_id"), F.size("token_ids").alias("n_tokens"), total("ce_weights").alias("ce_sum"), total("rl_weights").alias("rl_sum")))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS task, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
f AS (SELECT task, event_id, n, CASE WHEN n = 0 THEN NULL WHEN n % 5 = 4 THEN n // 2 ELSE n - 1 END AS p FROM e),
walk AS (SELECT task, n AS leaf, n, p, event_id, 0 AS up FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.task = a.task AND b.p = a.n)
  UNION ALL SELECT w.task, w.leaf, f.n, f.p, f.event_id, w.up + 1 FROM walk w JOIN f ON f.task = w.task AND f.n = w.p)
SELECT task, leaf, count(*) AS n_nodes, string_agg(CAST(event_id AS VARCHAR), '>' ORDER BY up DESC) AS path FROM walk GROUP BY task, leaf""")
def branch_paths(spark, sf_dir):
    """Attempts of a user as a forest: each follows the one before, every fifth goes back to the middle."""
    order = Window.partitionBy("task").orderBy("ts", "event_id")
    rows = A.attempts(spark, sf_dir).select("task", "event_id", (F.row_number().over(order) - 1).cast("long").alias("node"))
    parent = F.when(F.col("node") == 0, None).when(F.col("node") % 5 == 4, F.floor(F.col("node") / 2)).otherwise(F.col("node") - 1)
    rows = rows.withColumn("parent", parent.cast("long"))
    named = branches.branch_paths(rows, ["task"]).join(rows.select("task", "node", "event_id").hint("shuffle_hash"), ["task", "node"])
    placed = F.array_sort(F.collect_list(F.struct("place", "event_id")))  # as long as the tree is deep
    return named.groupBy("task", "leaf").agg(F.count("*").alias("n_nodes"), F.array_join(F.transform(placed, lambda x: x["event_id"].cast("string")), ">").alias("path"))


@query(f"""WITH {STEPS}, x AS (SELECT 'first' AS kind, outcome FROM steps WHERE outcome <> 'PASS' UNION ALL SELECT 'second', predicted FROM steps WHERE outcome <> 'PASS' AND predicted IS NOT NULL)
SELECT kind, outcome, count(*) AS n FROM x GROUP BY ALL""")
def composition_counters(spark, sf_dir):
    rows = A.steps(spark, sf_dir).where("outcome <> 'PASS'")
    both = F.explode(F.array(F.struct(F.lit("first").alias("kind"), F.col("outcome").alias("outcome")), F.struct(F.lit("second").alias("kind"), F.col("predicted").alias("outcome"))))
    return rows.select(both.alias("x")).where("x.outcome IS NOT NULL").groupBy("x.kind", "x.outcome").agg(F.count("*").alias("n"))


_DEFECTS = """a AS (SELECT doc_id, text AS prompt, 'sys a' AS system, substr(text, 1, 20) AS tests, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 40 = 3 THEN prompt || '!' ELSE prompt END AS prompt, CASE WHEN doc_id % 70 = 9 THEN 'odd' ELSE 'sys b' END AS system,
  CASE WHEN doc_id % 80 = 11 THEN 'absent~' ELSE tests END AS tests, CASE WHEN doc_id % 60 = 5 THEN 'train' ELSE split END AS split FROM a WHERE doc_id % 50 <> 7)"""


@query(f"""WITH {_DEFECTS}, j AS (SELECT a.split AS s1, b.split AS s2, a.prompt AS p1, b.prompt AS p2, a.tests AS t1, b.tests AS t2, b.doc_id IS NULL AS gone FROM a LEFT JOIN b USING (doc_id)),
v AS (SELECT 'ids' AS name, count(*) AS violations FROM j WHERE gone UNION ALL SELECT 'system', count(*) FROM b WHERE system <> 'sys b' UNION ALL SELECT 'tests in prompt', count(*) FROM b WHERE strpos(prompt, tests) = 0
  UNION ALL SELECT 'disjoint', count(*) FROM j WHERE NOT gone AND s1 <> s2
  UNION ALL SELECT 'matched', sum(CASE WHEN gone THEN 1 ELSE (p1 <> p2)::INT + (t1 <> t2)::INT + (s1 <> s2)::INT END) FROM j
  UNION ALL SELECT 'counts', count(*) FROM (SELECT split, count(*) AS n FROM b GROUP BY split) x JOIN (SELECT split, count(*) AS n FROM a GROUP BY split) y USING (split) WHERE x.n <> y.n
  UNION ALL SELECT 'digest', count(*) FROM j WHERE NOT gone AND p1 <> p2)
SELECT name, CAST(violations AS BIGINT) AS violations FROM v WHERE violations > 0""")
def constraint_violations(spark, sf_dir):
    part = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test")
    a = docs(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"), F.lit("sys a").alias("system"), F.substring("text", 1, 20).alias("tests"), part.alias("split"))
    at = lambda n, r: F.col("doc_id") % n == r
    b = a.where("doc_id % 50 <> 7").select(
        "doc_id", F.when(at(40, 3), F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt")).alias("prompt"), F.when(at(70, 9), "odd").otherwise("sys b").alias("system"),
        F.when(at(80, 11), "absent~").otherwise(F.col("tests")).alias("tests"), F.when(at(60, 5), "train").otherwise(F.col("split")).alias("split"),
    )
    expected = {(r.split,): r.n for r in a.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three splits
    digest = lambda df: df.select(F.col("doc_id").cast("string").alias("path"), F.sha2("prompt", 256).alias("sha256"), F.octet_length("prompt").alias("bytes"))
    changed = quality.artifacts(digest(a), digest(b), "digest").where("detail = 'sha256'")
    return quality.tally(quality.all_of([
        quality.same_ids(b, a, "ids", "doc_id"), quality.rows_where(b, "system", F.col("system") != "sys b", "doc_id"), quality.rows_where(b, "tests in prompt", ~F.contains("prompt", "tests"), "doc_id"),
        quality.disjoint(a.select("doc_id", "split").unionByName(b.select("doc_id", "split")), "disjoint", "doc_id"), quality.matched(a, b, "matched", ["prompt", "tests", "split"], "doc_id"),
        quality.counts(b, "counts", ["split"], expected), changed,
    ]))


@query("""WITH p AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS case_id, doc_id % 7 + 1 AS a, doc_id % 11 + 20 AS b, doc_id % 5 + 50 AS c FROM documents),
l AS (SELECT case_id, a, b, c, '    y = x + ' || a || chr(10) AS one, '    if y >= ' || b || ':' || chr(10) AS two, '    return min(y, ' || c || ')' || chr(10) AS four FROM p),
m AS (SELECT case_id, 0 AS position, 1 AS line, one AS original, '    y = x - ' || a || chr(10) AS changed FROM l UNION ALL SELECT case_id, 1, 1, one, '    y = x + ' || (a + 1) || chr(10) FROM l
  UNION ALL SELECT case_id, 2, 2, two, '    if y > ' || b || ':' || chr(10) FROM l UNION ALL SELECT case_id, 3, 2, two, '    if y >= ' || (b + 1) || ':' || chr(10) FROM l
  UNION ALL SELECT case_id, 4, 4, four, '    return max(y, ' || c || ')' || chr(10) FROM l UNION ALL SELECT case_id, 5, 4, four, '    return min(y, ' || (c + 1) || ')' || chr(10) FROM l)
SELECT case_id, CAST(position AS INTEGER) AS position, CAST(line AS INTEGER) AS line, original, changed, true AS "unique" FROM m""")
def mutation_candidates(spark, sf_dir):
    return execution.mutations(fixtures.generated(docs(spark, sf_dir))).select("case_id", "position", "line", "original", "changed", "unique")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS case_id, CASE n_nationkey % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'ASSERTION_FAILURE' WHEN 2 THEN 'RUNTIME_ERROR' WHEN 3 THEN 'SYNTAX_ERROR' WHEN 4 THEN 'OTHER' ELSE 'TIMEOUT' END AS outcome,
  n_nationkey % 6 = 0 AS success, n_nationkey % 6 = 5 AS timed_out FROM nation""")
def verified_outcomes(spark, sf_dir):
    return execution.verify(fixtures.candidates_of(A.table(spark, sf_dir, "nation"), "n_nationkey"), timeout=3).select("case_id", "run.outcome", "run.success", "run.timed_out")


@query("""WITH k AS (SELECT CAST(r_regionkey AS VARCHAR) AS case_id, r_regionkey AS k, '    y = x + ' || r_regionkey || chr(10) AS plus, '    y = x - ' || r_regionkey || chr(10) AS minus, '    y = x + ' || (r_regionkey + 1) || chr(10) AS more,
  '    return y * 2' || chr(10) AS twice, '    return y + 2' || chr(10) AS two FROM region)
SELECT case_id, CAST(1 AS INTEGER) AS steps, 'ASSERTION_FAILURE' AS outcome, CAST(NULL AS VARCHAR) AS second_outcome, CASE WHEN k = 0 THEN more ELSE minus END AS find_1, plus AS replace_1, CAST(NULL AS VARCHAR) AS find_2, CAST(NULL AS VARCHAR) AS replace_2 FROM k
UNION ALL SELECT case_id, 2, 'ASSERTION_FAILURE', 'ASSERTION_FAILURE', CASE WHEN k = 0 THEN more || twice ELSE minus END, CASE WHEN k = 0 THEN plus || two ELSE more END, CASE WHEN k = 0 THEN two ELSE more END, CASE WHEN k = 0 THEN twice ELSE plus END FROM k""")
def recovery_selection(spark, sf_dir):
    tasks = fixtures.doubling(A.table(spark, sf_dir, "region"), "r_regionkey")
    none = F.lit(None).cast("string")
    one = execution.one_step_recovery(tasks, timeout=3).select("case_id", F.lit(1).alias("steps"), "outcome", none.alias("second_outcome"), F.col("find").alias("find_1"), F.col("replace").alias("replace_1"), none.alias("find_2"), none.alias("replace_2"))
    two = execution.two_step_recovery(tasks, timeout=3).select(
        "case_id", F.lit(2).alias("steps"), F.col("first_outcome").alias("outcome"), "second_outcome", F.col("middle_find").alias("find_1"), F.col("middle_replace").alias("replace_1"), F.col("final_find").alias("find_2"), F.col("final_replace").alias("replace_2")
    )
    return one.unionByName(two)


@query("""WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS case_id, s_suppkey % 3 AS kind, sha256('42' || chr(0) || s_suppkey || chr(0) || 'task ' || s_suppkey) AS key FROM supplier),
deep AS (SELECT case_id, row_number() OVER (ORDER BY key, case_id) AS n FROM t WHERE kind = 0 QUALIFY n <= 2),
shallow AS (SELECT case_id, row_number() OVER (ORDER BY key, case_id) AS n FROM t WHERE kind <> 1 AND case_id NOT IN (SELECT case_id FROM deep) QUALIFY n <= 3)
SELECT case_id, CASE WHEN n % 2 = 1 THEN 'deep_shadow' ELSE 'deep_visible' END AS mode, 'ASSERTION_FAILURE' AS outcome_1, 'ASSERTION_FAILURE' AS outcome_2 FROM deep
UNION ALL SELECT case_id, CASE WHEN n % 2 = 1 THEN 'shadow' ELSE 'visible' END, 'ASSERTION_FAILURE', NULL FROM shallow""")
def lazy_recoveries(spark, sf_dir):
    """Two deep and three shallow recoveries of programs made from the suppliers; only the first waves of them are run."""
    tasks = fixtures.doubling_or_not(A.table(spark, sf_dir, "supplier"), "s_suppkey")
    return dataset.recoveries(tasks, 2, 3, seed=42, timeout=5).select("case_id", "mode", "outcome_1", "outcome_2")


@query(f"""WITH t AS (SELECT conv_id, turn, text, role = 'assistant' AS ours, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS node FROM conversations),
n AS (SELECT conv_id, node, ours, conv_id % 3 AS kind, CASE WHEN ours THEN text || '<PREDICTION>PASS</PREDICTION>' ELSE text END AS said FROM t),
c AS (SELECT conv_id, any_value(kind) AS kind, sum(length(said)) AS n_tokens, CAST(count(*) FILTER (ours) AS BIGINT) AS labels FROM n GROUP BY conv_id)
SELECT conv_id, CAST(0 AS INTEGER) AS sample, 'rollout' AS kind, CAST(n_tokens AS BIGINT) AS n_tokens, CASE WHEN labels > 0 AND kind <> 2 THEN CAST(n_tokens - 1 - 4 * labels AS DOUBLE) END AS rl_sum, CAST(NULL AS DOUBLE) AS ce_sum FROM c
UNION ALL SELECT conv_id, 1, 'verified', CAST(length('<|im_start|>user' || chr(10) || 'q' || chr(10) || '<|im_end|>' || chr(10) || chr(10) || '<|im_start|>assistant' || chr(10)) + 25 + length('RUNTIME_ERROR') AS BIGINT), 0.0::DOUBLE, round(0.5 * length('RUNTIME_ERROR'), 6)::DOUBLE FROM c WHERE kind = 1""")
def rollout_samples(spark, sf_dir):
    """Conversations as rollouts of one branch: the assistant's turns end in a label; a third of them are not sampled, a third have a verified target."""
    c = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = lambda m: F.when(m["role"] == "assistant", F.concat(m["text"], F.lit("<PREDICTION>PASS</PREDICTION>"))).otherwise(m["text"])
    nodes = F.transform("m", lambda m, i: F.struct(F.when(i > 0, i - 1).alias("parent"), m["role"].alias("role"), said(m).alias("content"), (F.col("conv_id") % 3 != 2).alias("sampled"), routing.code_points(said(m)).alias("token_ids")))
    rows = c.select("conv_id", nodes.alias("nodes")).withColumn("ids", F.flatten(F.transform("nodes", lambda n: n["token_ids"])))
    n = F.size("ids")
    sample = F.struct(F.col("ids").alias("token_ids"), F.array_prepend(F.array_repeat(F.lit(True), n - 1), F.lit(False)).alias("mask"), F.array_repeat(F.lit(0.0), n).alias("logprobs"), F.array().cast("array<double>").alias("temperatures"))
    context = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")))
    target = F.struct(context.alias("context_messages"), F.lit("PASS").alias("sampled_prediction"), F.lit("RUNTIME_ERROR").alias("actual"))
    given = rows.select("conv_id", F.lit("env").alias("env_name"), "nodes", F.array(sample).alias("samples"), F.when(F.col("conv_id") % 3 == 1, F.array(target)).alias("targets"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    found = rollout.score(given, rollout_id="conv_id", alpha=0.5)
    return rounded(found.select("conv_id", "sample", "kind", F.size("token_ids").cast("long").alias("n_tokens"), total("rl_weights").alias("rl_sum"), total("ce_weights").alias("ce_sum")))


_CODE = r"""'def total(xs):\n    out = ' || {start} || '\n    for x in xs:\n        out = out {sign} x\n    return out\n'"""
_MODES = "(VALUES (NULL, 0, 0), ('shadow', 1, 1), ('visible', 1, 2), ('deep_shadow', 2, 3), ('deep_visible', 2, 4)) AS m(mode, d, r)"


@query(f"""WITH t AS (SELECT arm, mode, d, p_partkey AS k, {_CODE.format(start="p_partkey", sign="+")} AS final,
    CASE d WHEN 0 THEN {_CODE.format(start="p_partkey", sign="+")} WHEN 1 THEN {_CODE.format(start="p_partkey", sign="-")} ELSE {_CODE.format(start="(p_partkey + 1)", sign="-")} END AS initial
  FROM part JOIN {_MODES} ON r = p_partkey % 5, (VALUES ('a'), ('b')) AS x(arm))
SELECT arm, CAST(k AS BIGINT) AS task_id, mode, CAST(CASE WHEN arm = 'b' AND mode LIKE '%shadow' THEN 9 + 2 * d ELSE 9 + 4 * d END AS INTEGER) AS n_messages,
  CAST(CASE WHEN arm = 'b' THEN CASE WHEN mode IS NULL THEN 1 ELSE d + 1 END ELSE 0 END AS INTEGER) AS n_predictions,
  sha256('{{"final_code": "' || final || '", "final_outcome": "PASS", "initial_code": "' || initial || '", "initial_outcome": "' || CASE d WHEN 0 THEN 'PASS' ELSE 'ASSERTION_FAILURE' END || '", "task_id": ' || k || '}}') AS matched_key FROM t""")
def sft_message_templates(spark, sf_dir):
    """Both arms of a task for every part, in each recovery mode by turns, with the key that the arms share."""
    tasks = fixtures.sft_tasks(A.table(spark, sf_dir, "part"), "p_partkey")
    rows = sft.traces(tasks, "a").unionByName(sft.traces(tasks, "b"))
    tagged = F.size(F.filter("messages", lambda m: F.contains(m["content"], F.lit("<PREDICTION>"))))
    return rows.select("arm", "task_id", F.col("recovery_mode").alias("mode"), F.size("messages").alias("n_messages"), tagged.alias("n_predictions"), "matched_key")


@query(f"""SELECT arm || '/' || coalesce(mode, 'direct') || '_' || s_suppkey AS trace, CAST(3 + CASE WHEN arm = 'b' AND mode LIKE '%shadow' THEN d ELSE 2 * d END AS INTEGER) AS n_calls,
  CASE WHEN arm = 'b' THEN repeat('ASSERTION_FAILURE,', d) || 'PASS' ELSE '' END AS actual, true AS final_success, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS told_otherwise
  FROM supplier JOIN {_MODES} ON r = s_suppkey % 5, (VALUES ('a'), ('b')) AS x(arm)""")
def trace_replay(spark, sf_dir):
    """Both arms of a task for every supplier, replayed by the protocol; no row may break its mode's shape."""
    tasks = fixtures.sft_tasks(A.table(spark, sf_dir, "supplier"), "s_suppkey")
    rows = sft.traces(tasks, "a").unionByName(sft.traces(tasks, "b")).withColumn("trace", F.concat_ws("/", "arm", "case_id"))
    turns = rows.select("trace", "arm", "test_code", F.lit(sft.PLACEHOLDER).alias("workspace"), F.posexplode("messages").alias("turn", "m")).select("*", "m.role", "m.content").drop("m")
    done = cut(replay.replay(turns.withColumn("trace_prefix", F.lit("data/blueprints/total")), timeout=5))
    plan = rows.select("trace", "arm", F.col("recovery_mode").alias("mode"), F.col("candidate_outcome").alias("first_outcome"), F.col("second_candidate_outcome").alias("second_outcome"))
    broken = replay.shape_violations(done, plan).groupBy("trace").agg(F.count("*").alias("violations"))
    lied = replay.told_otherwise(turns, done).groupBy("trace").agg(F.count("*").alias("told"))
    counts = done.join(broken, "trace", "left").join(lied, "trace", "left")
    return counts.select("trace", F.size("calls").alias("n_calls"), F.array_join("actual", ",").alias("actual"), "final_success", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("told", F.lit(0)).alias("told_otherwise"))


def _quoted_sql(text: str) -> str:
    """DuckDB SQL of a JSON string in ASCII, character by character."""
    unit = lambda n: f"printf('\\u%04x', {n})"
    pair = f"{unit('55296 + ((ord(c) - 65536) >> 10)')} || {unit('56320 + ((ord(c) - 65536) & 1023)')}"
    short = " ".join(f"WHEN {n} THEN '\\{x}'" for n, x in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r"), (34, '"'), (92, "\\")))
    one = f"CASE ord(c) {short} ELSE CASE WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN {unit('ord(c)')} ELSE {pair} END END"
    whole = f"CASE WHEN regexp_full_match({text}, '[ !#-\\[\\]-~]*') THEN {text} ELSE array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: {one}), '') END"
    return f"""coalesce('"' || {whole} || '"', 'null')"""


@query(f"""SELECT doc_id, sha256('{{"doc_id": ' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ', "lang": ' || {_quoted_sql("lang")} || ', "mean": ' || coalesce(CAST(CAST(n_chars AS DOUBLE) / 7 AS VARCHAR), 'null')
  || ', "source": ' || {_quoted_sql("source")} || ', "text": ' || {_quoted_sql("text")} || '}}') AS sha256 FROM documents""")
def canonical_digest(spark, sf_dir):
    """The digest of every document's canonical JSON, with an integer, a double and whole texts."""
    rows = docs(spark, sf_dir).select("doc_id", "lang", "source", "text", (F.col("n_chars").cast("double") / 7).alias("mean"))
    return rows.select("doc_id", F.sha2(canonical.object_of({f.name: (F.col(f.name), f.dataType) for f in rows.schema.fields}), 256).alias("sha256"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
