"""Functions and operators on hand-made cases; Python gives the expected values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trailspark.functions import numeric, protocol
from trailspark.functions import text as T
from trailspark.operators import execution, metrics, quality, replay, rollout, routing, split, stats, transcript
from trailspark.plans import fixtures
from trailspark.sources import lines

EDGES = ["", " ", "a", " a \n", "a\r\nb\rc\n", "x ", " x\x85", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a b c", "\n", "\n\n", "a\n\nb", "\x1f x \x1f"]


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("r")).first().r


def test_python_string_semantics(spark):
    rows = spark.createDataFrame([(t,) for t in EDGES], "t string")
    got = rows.select("t", T.strip(F.col("t")).alias("s"), T.rstrip(F.col("t")).alias("r"), T.splitlines(F.col("t")).alias("l")).collect()
    for r in got:
        assert (r.s, r.r, r.l) == (r.t.strip(), r.t.rstrip(), r.t.splitlines())


def test_occurrences_and_patch(spark):
    cases = [("abab", "ab"), ("aaaa", "aa"), ("abc", ""), ("", ""), ("", "x"), ("xyx", "y")]
    got = spark.createDataFrame(cases, "t string, f string").select("t", "f", T.occurrences(F.col("t"), F.col("f")).alias("n"), T.replace_once(F.col("t"), F.col("f"), F.lit("Z")).alias("p")).collect()
    for r in got:
        assert r.n == r.t.count(r.f)
        assert r.p == (r.t.replace(r.f, "Z") if r.f and r.t.count(r.f) == 1 else None)


CALLS = [
    'CALL read_file {"id":"c1","file_path":"a"}', 'CALL python_test {"id":"c1"}\nCALL python_test {"id":"c1"}', "CALL x", "CALL x {bad", 'CALL 9x {"id":"c"}', "CALL x [1]", 'CALL x {"id":3}', 'CALL x {"id":""}',
    'CALL x {"id":"c","n":1}', "no call", "", '  CALL y  {"id":"q"}  ', 'CALLx {"id":"c"}', 'CALL été {"id":"c"}',
]


def test_calls_agree_with_the_replay_parser(spark):
    rows = spark.createDataFrame([(t,) for t in CALLS], "t string").select("t", protocol.parse_calls(F.col("t")).alias("c")).collect()
    for r in rows:
        calls, errors = replay.read_calls(r.t, set())
        assert [(c.tool, c.id, c.params) for c in r.c.calls] == calls
        assert [e.split(": ")[0:2] for e in errors] == [e.replace(": bad JSON", "").split(": ")[0:2] for e in r.c.errors]


def test_predictions_and_shapes(spark):
    tag = "<PREDICTION> PASS </PREDICTION>\n<DECISION>KEEP</DECISION>"
    p = one(spark, tag, protocol.parse_prediction)
    assert (p.prediction, p.decision, p.errors) == ("PASS", "KEEP", [])
    p = one(spark, tag.replace("PASS", "MAYBE").replace("KEEP", "WAIT"), protocol.parse_prediction)
    assert (p.prediction, p.decision) == ("MAYBE", "WAIT") and len(p.errors) == 2
    assert len(one(spark, tag + tag, protocol.parse_prediction).errors) == 2
    call = 'CALL python_test {"id":"c1"}'
    for text, n, arm, pending, ok in [("FINAL: x", 0, "a", False, True), ("FINAL: x\ny", 0, "a", False, False), (call, 1, "a", False, True), ("hm\n" + call, 1, "a", False, False), (tag + "\n" + call, 1, "b", True, True), (call, 1, "b", True, False), (call + "\n" + call, 2, "a", False, False)]:
        got = one(spark, text, lambda t, n=n, arm=arm, pending=pending: protocol.turn_shape_error(t, F.lit(n), F.lit(arm), F.lit(pending)))
        calls, _ = replay.read_calls(text.replace("c1", "c1", 1), set())
        assert (got is None) == ok
        if n == len(calls):
            assert (replay.shape_error(text, calls, arm == "b" and pending) is None) == ok


def test_pass_at_k(spark):
    df = spark.createDataFrame([(4, 1), (4, 0), (4, 4), (10, 3)], "n int, c int")
    for k in (1, 2, 4):
        for r in df.select("n", "c", numeric.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            assert math.isclose(r.p, 1 - math.comb(r.n - r.c, k) / math.comb(r.n, k), abs_tol=1e-12)
    with pytest.raises(ValueError):
        numeric.pass_at_k(F.lit(1), F.lit(1), 0)
    for bad in ((2, 1), (4, 5)):
        with pytest.raises(Exception, match="pass@k"):
            spark.createDataFrame([bad], "n int, c int").select(numeric.pass_at_k(F.col("n"), F.col("c"), 4)).collect()


def test_exact_binomial(spark):
    df = spark.createDataFrame([(5, 15), (0, 3), (7, 7), (0, 0), (900, 1100)], "a long, b long")
    for r in df.select("a", "b", numeric.binomial_two_sided(F.col("a"), F.col("b")).alias("p")).collect():
        n = r.a + r.b
        want = min(1, 2 * sum(math.comb(n, k) for k in range(min(r.a, r.b) + 1)) / 2**n)
        assert math.isclose(r.p, want, rel_tol=1e-6)


def test_mcnemar_and_bootstrap(spark):
    counts = spark.createDataFrame([(100, 40, 12, 28, 20)], "n long, both long, a_only long, b_only long, neither long")
    r = stats.mcnemar(counts).first()
    assert math.isclose(r.statistic, 225 / 40) and math.isclose(r.p_value, math.erfc(math.sqrt(r.statistic / 2)), rel_tol=1e-9)
    ci = stats.bootstrap_ci(counts, samples=400).first()
    assert ci.low < 16 < ci.high and ci == stats.bootstrap_ci(counts, samples=400).first()
    none = stats.mcnemar(spark.createDataFrame([(0, 0)], "a_only long, b_only long")).first()
    assert none.statistic is None and none.p_value is None


def test_trace_files(spark, tmp_path):
    record = {"calls": [{"tool": "python_test", "id": "c1"}, {"tool": "apply_patch", "id": "c2"}, {"tool": "python_test", "id": "c3"}], "results": {"c1": {"success": False, "outcome": "RUNTIME_ERROR"}, "c3": {"success": True, "outcome": "PASS"}}, "prediction_targets": [{"sampled_prediction": "PASS", "actual": "RUNTIME_ERROR", "decision": "REVISE"}]}
    traces = [
        {"task": {"data": {"case_id": "a"}}, "metrics": {"passed": 1}, "info": {"other": 1, "record": record}, "num_total_tokens": 9}, {"task": {"data": {"idx": 4}}, "reward": None, "rewards": {"mbpp_reward": 1}},
        {"task_id": 7, "rewards": {"mbpp_reward": 1}, "nodes": [{"token_ids": [1, 2]}, {"token_ids": [3]}]}, {"metrics": {"passed": True}, "usage": {"prompt_tokens": 2, "completion_tokens": 3}},
    ]
    path = tmp_path / "traces.jsonl"
    path.write_text("\n".join(json.dumps(t) for t in traces) + "\n")
    got = lines.load_traces(spark, str(path)).orderBy("task").collect()
    assert [(r.task, r.solved, r.n_tokens or 0) for r in sorted(got, key=lambda r: (r.task, r.solved))] == [("4", False, 0), ("4", True, 5), ("7", True, 3), ("a", True, 9)]
    per = metrics.per_trace(lines.load_traces(spark, str(path)).where("task = 'a'")).first()
    assert per.recovered_solved and per.recovered_any and per.had_failure and not per.first_patch_success and per.bad_patch_rejection_rate == 1
    with pytest.raises(Exception, match="one trace per task"):
        metrics.report(lines.load_traces(spark, str(path))).collect()
    path.write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match=r"traces.jsonl:2"):
        lines.read_jsonl(spark, str(path)).collect()
    path.write_text("")
    with pytest.raises(ValueError, match="no traces"):
        lines.load_traces(spark, str(path))
    path.write_text('{"task":{"data":{"name":"x"}},"rewards":{"r":1}}\n{"task":{"data":{"name":"x"}},"rewards":{}}\n')
    assert [tuple(r) for r in lines.load_outcomes(spark, str(path)).collect()] == [("x", 0)]


def test_outcomes_go_by_the_first_reward_of_the_line(spark, tmp_path):
    path = tmp_path / "traces.jsonl"
    rewards = ['{"z_main": 1.0, "a_other": 0.0}', '{"z_main": 0.0, "a_other": 1.0}', '{"b": 2, "a": null}', '{"b": null, "a": 2}', "{}", "null", '{"b": true, "a": 0}', '{"b": false, "a": 1}', '{"b": -1, "a": 1}']
    path.write_text("".join(f'{{"rewards": {r}, "task": {{"data": {{"name": "t{i}"}}}}}}\n' for i, r in enumerate(rewards)))
    got = {r.name: r.outcome for r in lines.load_outcomes(spark, str(path)).collect()}
    assert got == {f"t{i}": x for i, x in enumerate([1, 0, 1, 0, 0, 0, 1, 0, 0])}


def test_tail_probabilities_are_exact_sums():
    from fractions import Fraction

    for a, b in [(0, 0), (0, 5), (3, 9), (12, 28), (50, 50), (51, 50), (400, 480), (1000, 0)]:
        n, low = a + b, min(a, b)
        want = min(Fraction(1), 2 * sum(Fraction(math.comb(n, k)) for k in range(low + 1)) / 2**n) if n else 1
        assert math.isclose(numeric.two_sided(a, b), want, rel_tol=1e-9)
    assert numeric.two_sided(500_000_000, 500_000_100) > 0.99 and 0 < numeric.two_sided(499_900_000, 500_100_000) < 1e-9


def test_bootstrap_is_that_of_pairs_drawn_one_by_one(spark):
    import numpy as np

    n, a, b = 400, 60, 90
    counts = spark.createDataFrame([(n, a, b)], "n long, a_only long, b_only long")
    got = stats.bootstrap_ci(counts).first()
    gains = np.array([-1] * a + [1] * b + [0] * (n - a - b))
    drawn = np.sort(100.0 * np.random.default_rng(5).choice(gains, (10_000, n)).mean(1))
    assert abs(got.low - drawn[250]) < 0.3 and abs(got.high - drawn[9750]) < 0.3 and abs(got.mean - drawn.mean()) < 0.1
    assert got == stats.bootstrap_ci(counts).first()
    huge = stats.bootstrap_ci(spark.createDataFrame([(10**12, 10**11, 2 * 10**11)], "n long, a_only long, b_only long")).first()
    assert 9.99 < huge.low < 10 < huge.high < 10.01
    none = stats.bootstrap_ci(spark.createDataFrame([(0, 0, 0)], "n long, a_only long, b_only long")).first()
    assert none.low is None and none.mean is None


def naive_mutations(code):
    """Every token with a replacement, tried on the text of its line."""
    import io
    import tokenize

    out, rows = [], code.splitlines(keepends=True)
    for t in tokenize.generate_tokens(io.StringIO(code).readline):
        new = execution.REPLACEMENTS.get(t.string) or (str(int(t.string) + 1) if t.type == tokenize.NUMBER and t.string.isdigit() else None)
        if new and t.start[0] == t.end[0]:
            i = t.start[0] - 1
            line = rows[i][: t.start[1]] + new + rows[i][t.end[1] :]
            if rows.count(rows[i]) == 1 and line not in rows and not rows[i].strip().startswith(("def ", "import ", "from ")):
                out.append((i, rows[i], line, "".join(line if j == i else x for j, x in enumerate(rows))))
    return out


def test_mutations_are_brute_force(spark):
    programs = [
        "from math import pi\ndef f(x, y=1):\n    if x <= 3 and y >= 2 or x == y:\n        return min(x, 1 + 2) * 3\n    return True\n\ndef g(x):\n    return True\n    s = 'a + 1'; t = 1.5 - 0x10\n    return x != 7 # 8 + 9\n",
        "x = 1\nx = 1\nx = 2\nx = 3", 'y = """a\n+ 1""" + 2\n', "", "z = 1 +\\\n  2\n", "é = 1; w = é + 1\n", "a = [\n  1,\n  -1,\n]\r\n",
    ]
    for code in programs:
        assert list(execution.mutate(code)) == naive_mutations(code)
    with pytest.raises(Exception, match="bad: code cannot be tokenized"):
        execution.mutations(spark.createDataFrame([("bad", "x = (")], "case_id string, code string")).collect()


def test_runs_leave_nothing_behind_and_cannot_send_the_receipt():
    tricks = [
        "import sys; print(sys.argv); raise SystemExit(0)", "import sys; sys.stdout.write(sys.stdin.read()); raise SystemExit(0)", "import os; os.write(2, b'AssertionError'); os._exit(0)", "import os\nos.fork() and os._exit(0)\nimport time; time.sleep(60)",
        "import sys; sys.exit(3)", "from __future__ import annotations\nx = 1", "__name__ == '__main__' or 1 / 0\nx = 1", "import os; os.kill(os.getpid(), 9)",
    ]
    got = [execution.run_tests(code, "assert x == 1", 3)["outcome"] for code in tricks]
    assert got == ["OTHER", "OTHER", "ASSERTION_FAILURE", "TIMEOUT", "OTHER", "PASS", "PASS", "OTHER"]
    assert execution.run_tests(None, None)["outcome"] == "PASS" and execution.run_tests("x = 1", "assert (")["outcome"] == "SYNTAX_ERROR"


def test_zipped_rows(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "line long, case_id string, n long")
    right = spark.createDataFrame([(1, "b", 2), (2, "b", 9), (3, None, 3), (4, "d", 4)], "line long, case_id string, n long")
    got = sorted(tuple(r) for r in quality.zipped(left, right, "order", ["case_id", "n"]).collect())
    assert got == [("order", "1", "case_id"), ("order", "1", "n"), ("order", "2", "n"), ("order", "4", "missing left")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    texts = {"a": "".join(f"{'' if i % 7 == 3 else f'line {i}' * (i % 5 + 1)}{'\r' * (i % 2)}\n" for i in range(4000)) + "last", "b": "x\n\ny\n", "c": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = lines.read_lines(spark, f"{tmp_path}/a")
        assert found.rdd.getNumPartitions() > 3
        got = sorted((r.line, r.value) for r in found.collect())
        both = sorted((r.line, r.value) for r in lines.read_lines(spark, f"{tmp_path}/[bc]").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, x.removesuffix("\r")) for i, x in enumerate(texts["a"].split("\n"), 1) if x.strip()]
    assert both == [(1, "x"), (3, "y")]


def test_recovery_order(spark):
    schema = "task string, solved boolean, calls array<struct<tool:string,id:string>>, results map<string,struct<success:boolean,outcome:string>>, targets array<struct<sampled_prediction:string,actual:string,decision:string>>, n_tokens long"
    t = [("python_test", "c1"), ("python_test", "c2")]
    good, bad = (True, "PASS"), (False, "OTHER")
    df = spark.createDataFrame([("pf", True, t, {"c1": good, "c2": bad}, [], None), ("fp", True, t, {"c1": bad, "c2": good}, [], None), ("missing", False, t, {}, [], None)], schema)
    got = {r.task: (r.recovered_any, r.had_executed_failure, r.test_calls) for r in metrics.per_trace(df).collect()}
    assert got == {"pf": (False, True, 2), "fp": (True, True, 2), "missing": (False, True, 2)}


def test_label_masks_and_samples(spark):
    text = "ab <PREDICTION> PASS </PREDICTION> <PREDICTION>X</PREDICTION>"
    found = spark.createDataFrame([(text,)], "t string").select(F.inline(rollout.labels(F.col("t")))).collect()
    assert [(r.label, text[r.low : r.high], r.start) for r in found] == [("PASS", "PASS", 3), ("X", "X", text.rindex("<PREDICTION>"))]
    seq = spark.createDataFrame([([1, 2, 3, 2, 3], [2, 3]), ([1], [1, 2]), ([12, 3], [2]), ([1], [])], "v array<int>, t array<int>")
    assert [x.p for x in seq.select(routing.find_subsequence(F.col("v"), F.col("t")).alias("p")).collect()] == [1, None, None, None]


def test_splits_are_disjoint_and_seeded(spark):
    tasks = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "task_id long, prompt string")
    parts = {r.task_id: r.part for r in split.three_way_split(tasks, 10, 20).collect()}
    import hashlib

    order = sorted(range(40), key=lambda i: (hashlib.sha256(f"42\0{i}\0p{i}".encode()).hexdigest(), i))
    assert [parts[i] for i in order] == ["first"] * 10 + ["second"] * 20 + ["rest"] * 10


def test_execution_and_mutations(spark):
    got = {r.case_id: r.run.outcome for r in execution.verify(fixtures.candidates(spark), timeout=2).collect()}
    assert got == {"pass": "PASS", "assertion": "ASSERTION_FAILURE", "runtime": "RUNTIME_ERROR", "syntax": "SYNTAX_ERROR", "indent": "SYNTAX_ERROR", "loop": "TIMEOUT", "exit": "OTHER", "forged": "OTHER", "other": "OTHER"}
    assert execution.failing_gold(fixtures.tasks(spark)).count() == 0
    gold = {r.case_id: r.code for r in fixtures.tasks(spark).collect()}
    for r in execution.one_step_recovery(fixtures.tasks(spark), timeout=2).collect():
        assert r.initial_code.count(r.find) == 1 and r.initial_code.replace(r.find, r.replace) == gold[r.case_id]
    for r in execution.two_step_recovery(fixtures.tasks(spark), timeout=2).collect():
        middle = r.initial_code.replace(r.middle_find, r.middle_replace)
        assert r.initial_code.count(r.middle_find) == 1 and middle.replace(r.final_find, r.final_replace) == gold[r.case_id]


def test_two_step_recovery_on_one_line(spark):
    task = ("net", "def net(a, b, c):\n    return a + b - c\n", "assert net(1, 2, 4) == -1\n")
    (net,) = execution.two_step_recovery(spark.createDataFrame([task], "case_id string, code string, test_code string"), timeout=2).collect()
    line = "    return a {} b {} c\n".format
    assert net.initial_code == "def net(a, b, c):\n" + line("-", "-")
    assert (net.middle_find, net.middle_replace, net.final_find, net.final_replace) == (line("-", "-"), line("+", "+"), line("+", "+"), line("+", "-"))


def test_constraints_find_seeded_defects(spark):
    good = spark.createDataFrame([(f"t{i}", "train" if i % 2 else "test", "p") for i in range(10)], "case_id string, split string, prompt string")
    clean = quality.all_of([quality.same_ids(good, good, "ids"), quality.disjoint(good, "disjoint"), quality.matched(good, good, "matched", ["prompt"]), quality.counts(good, "counts", ["split"], {("train",): 5, ("test",): 5}), quality.rows_where(good, "prompt", F.col("prompt") != "p")])
    assert clean.count() == 0
    bad = good.where("case_id <> 't1'").withColumn("prompt", F.when(F.col("case_id") == "t2", None).otherwise(F.col("prompt"))).unionByName(good.limit(1).withColumn("split", F.lit("other")))
    found = {r.name for r in quality.tally(quality.all_of([quality.same_ids(bad, good, "ids"), quality.disjoint(bad, "disjoint"), quality.matched(good, bad, "matched", ["prompt"]), quality.counts(bad, "counts", ["split"], {("train",): 5, ("test",): 5}), quality.rows_where(bad, "prompt", F.col("prompt") != "p")])).collect()}
    assert found == {"ids", "disjoint", "matched", "counts", "prompt"}


def test_normalised_tasks(spark):
    schema = "task_id long, text string, code string, test_list array<string>, test_setup_code string"
    df = spark.createDataFrame([(1, " p\r\nq ", "c\r", ["a\r\n", " ", "b"], "s"), (2, "p", "c", ["t"], None)], schema)
    got = transcript.normalise_tasks(df).orderBy("task_id").collect()
    assert (got[0].prompt, got[0].test_code, got[0].case_id) == ("p\nq", "s\na\nb\n", "mbpp_1") and got[1].test_code == "t\n"
    for bad in [(3, "", "c", ["t"], ""), (3, "p", " ", ["t"], ""), (3, "p", "c", [" "], "setup only"), (3, "p", "c", None, None)]:
        with pytest.raises(Exception, match="mbpp_3: task without content"):
            transcript.normalise_tasks(spark.createDataFrame([bad], schema)).collect()


def test_advantages_of_groups(spark):
    data = [(1, "a", None, 1.0), (2, "a", None, 3.0), (3, "b", 1, 2.0), (4, "b", 1, 2.0), (5, None, 1, 0.0), (6, None, 1, 4.0), (7, "b", 2, None)]
    got = routing.group_advantage(spark.createDataFrame(data, "id long, g string, h int, r double"), ["g", "h"], "r")
    assert got.columns == ["id", "g", "h", "r", "advantage"]
    assert sorted((r.id, r.advantage) for r in got.collect()) == [(1, -1.0), (2, 1.0), (5, -2.0), (6, 2.0)]


def test_streaming_equals_batch(spark, tmp_path):
    from trailspark.plans import adapters
    from trailspark.streaming import live

    batch = adapters.attempts(spark, "/root/testdata/sf0.001")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = live.run_available(live.outcome_counts(stream), "live_counts", str(tmp_path / "ck")).collect()
    want = batch.groupBy(F.window("ts", "1 day"), "outcome").count().collect()
    assert sorted((str(r.start), r.outcome, r.n) for r in got) == sorted((str(r.window.start), r.outcome, r["count"]) for r in want)
