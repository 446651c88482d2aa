"""Tools on workspaces, replay records, and task sets."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from trailspark.operators import execution, replay
from trailspark.operators.workspace import READ_CHARS, Workspace
from trailspark.plans import taskset


def space(**files):
    return Workspace("assert x == 1", {"solution.py": "x = 2\n", "docs/note.txt": "n" * 9000, **files}, "data/blueprints/t", 5)


def test_tools_and_their_results():
    s = space()
    assert s.call("read_file", {"file_path": "docs/note.txt"}).stdout == "n" * READ_CHARS == "n" * 8000
    for name in ("solution.py", "data/blueprints/t/solution.py", "/work/data/blueprints/t/./solution.py", "docs/../solution.py"):
        assert s.call("read_file", {"file_path": name}).stdout == "x = 2\n"
    for name in ("../other/solution.py", "/etc/passwd", "/work/data/blueprints/t2/solution.py", "docs/../../t2/x", "gone.py", "", "docs"):
        r = s.call("read_file", {"file_path": name})
        assert (r.success, r.exit_code, r.outcome) == (False, -1, None) and r.stderr.startswith("tool error: ")
    assert s.call("rm", {}).stderr == "unknown tool: rm"
    assert s.call("apply_patch", {"file_path": "solution.py", "find": "x"}).stderr == "apply_patch needs file_path, find, replace"
    assert s.call("apply_patch", {"file_path": "solution.py", "find": "y", "replace": ""}).stderr == "find must occur exactly once; found 0"
    assert s.call("apply_patch", {"file_path": "docs/note.txt", "find": "n", "replace": ""}).stderr == "find must occur exactly once; found 9000"
    r = s.call("python_test", {})
    assert (r.success, r.stderr, r.exit_code, r.outcome) == (False, "tests failed", 1, "ASSERTION_FAILURE")
    assert r.block("c1") == "RESULT c1:\nstatus: failed\nstderr:\ntests failed"
    assert s.call("apply_patch", {"file_path": "solution.py", "find": "2", "replace": "1"}).stdout == "patch applied"
    r = s.call("python_test", {"project_path": "data/blueprints/t"})
    assert r.success and r.block("c2") == "RESULT c2:\nstatus: success\nstdout:\ntests passed"
    assert s.call("python_test", {"project_path": "docs"}).stderr == "solution.py not found"
    assert s.call("python_test", {"project_path": ".."}).stderr.startswith("tool error: ")
    slow = Workspace("while True: pass", {"solution.py": ""}, timeout=1).test()
    assert slow.block("c") == "RESULT c:\nstatus: failed\ntimed_out: true\nstderr:\ntests timed out after 1s"


def test_edits_of_drifted_lines_are_errors():
    assert execution.apply_edit("a\nb\n", 1, "b\n", "c\n") == "a\nc\n"
    for row, before in ((0, "b\n"), (2, "b\n"), (-1, "b\n")):
        with pytest.raises(ValueError, match="no longer"):
            execution.apply_edit("a\nb\n", row, before, "c\n")


def turns(spark, trace, arm, texts):
    tests, code = "assert x == 1", "x = 2\n"
    rows = [(trace, i, role, said, arm, tests, code, "data/blueprints/t") for i, (role, said) in enumerate(texts)]
    return spark.createDataFrame(rows, "trace string, turn int, role string, content string, arm string, test_code string, workspace string, trace_prefix string")


def call(tool, ident, **params):
    return f"CALL {tool} {json.dumps({'id': ident, **params})}"


def test_replay_keeps_results_targets_and_records(spark, tmp_path):
    tag = "<PREDICTION>{}</PREDICTION>\n<DECISION>{}</DECISION>\n".format
    patch = lambda ident, find, new: call("apply_patch", ident, file_path="data/blueprints/t/solution.py", find=find, replace=new)
    said = [
        ("system", "s"), ("user", "u"), ("assistant", call("read_file", "c0", file_path="solution.py")), ("tool", "RESULT c0:\nstatus: success\nstdout:\nx = 2"), ("assistant", patch("c1", "2", "3")), ("tool", "made up"),
        ("assistant", tag("ASSERTION_FAILURE", "REVISE") + patch("c2", "3", "1")), ("tool", "RESULT c2:\nstatus: success\nstdout:\npatch applied"), ("assistant", tag("PASS", "KEEP") + call("python_test", "c3")), ("tool", "RESULT c3:\nstatus: success\nstdout:\ntests passed"), ("assistant", "FINAL: done"),
    ]
    rows = turns(spark, "t/b", "b", said)
    done = replay.replay(rows, timeout=5)
    r = done.first()
    assert r.tools == ["read_file", "apply_patch", "apply_patch", "python_test"] and r.errors == [] and r.final_success and r.actual == ["ASSERTION_FAILURE", "PASS"]
    assert [x.stdout for x in r.results] == ["x = 2\n", "patch applied", "patch applied", "tests passed"]
    first, second = r.targets
    assert (first.candidate_call_id, first.shadow, second.candidate_call_id, second.shadow) == ("c1", True, "c2", False)
    assert [m.content for m in first.context_messages] == [c for _, c in said[:6]] and len(second.context_messages) == 8
    import hashlib

    assert (first.candidate_sha256, second.candidate_sha256) == tuple(hashlib.sha256(c).hexdigest() for c in (b"x = 3\n", b"x = 1\n"))
    assert {(x.outcome, x.n) for x in replay.label_counts(done).collect()} == {("ASSERTION_FAILURE", 1), ("PASS", 1)}
    assert {tuple(x) for x in replay.label_counts(done, by_trace=True).collect()} == {("t/b", "ASSERTION_FAILURE", 1), ("t/b", "PASS", 1)}
    wrong = replay.told_otherwise(rows, done).collect()
    assert [(w.call, w.told) for w in wrong] == [("c1", "made up")]
    records = replay.records(done, rows.select("trace", "arm").distinct())
    record = json.loads(records.first().record)
    assert record["arm"] == "b" and record["calls"][0] == {"tool": "read_file", "id": "c0", "params": {"file_path": "solution.py"}}
    assert record["results"]["c3"] == {"success": True, "stdout": "tests passed", "stderr": "", "exit_code": 0, "timed_out": False, "outcome": "PASS"} and record["results"]["c0"]["outcome"] is None
    assert record["prediction_targets"][1]["actual"] == "PASS" and record["final_verification"]["success"] and record["protocol_errors"] == []
    assert taskset.write_records(records, f"{tmp_path}/records") == 1 and json.loads((tmp_path / "records" / "t_b.json").read_text()) == record
    traces = spark.createDataFrame([("t/b", False, [5, 9]), ("none", None, None)], "trace string, truncated boolean, branch_lengths array<int>")
    final = {x.trace: x.c for x in taskset.finalise(traces, records).select("trace", F.try_variant_get("record", "$.calls[3].id", "string").alias("c")).collect()}
    assert final == {"t/b": "c3", "none": None}
    with pytest.raises(Exception, match="t/b: trace has 9 tokens"):
        taskset.finalise(traces, records, options=taskset.TaskOptions(8)).collect()


def test_replay_of_a_workspace_of_files(spark):
    rows = turns(spark, "t", "a", [("assistant", call("read_file", "c", file_path="lib.py")), ("assistant", call("read_file", "d", file_path="../x"))])
    rows = rows.withColumn("workspace", F.create_map(F.lit("lib.py"), F.lit("y = 1")))
    r = replay.replay(rows).first()
    assert [x.success for x in r.results] == [True, False] and r.results[0].stdout == "y = 1"
    assert not r.final_success and r.final_verification.stderr == "solution.py not found"


def test_task_sets(spark, tmp_path):
    (tmp_path / "blueprints" / "a").mkdir(parents=True)
    (tmp_path / "blueprints" / "a" / "solution.py").write_text("pass\n")
    row = {"case_id": "a", "prompt": [{"role": "user", "content": "u"}], "blueprint_root": "blueprints/a", "test_code": "t"}
    file = tmp_path / "tasks.jsonl"
    file.write_text("".join(json.dumps(row | x) + "\n" for x in ({}, {"arm": "b", "task_id": 7, "source": "other", "trace_prefix": "p"}, {"case_id": "c"})))
    got = taskset.load(spark, taskset.SetOptions(str(file), 2)).collect()
    assert [(r.name, r.idx, r.arm, r.source, r.source_task_id, r.trace_prefix) for r in got] == [("a", 0, "a", "mbpp", 0, "blueprints/a"), ("a", 1, "b", "other", 7, "p")]
    assert {r.blueprint_root for r in got} == {f"{tmp_path}/blueprints/a"}
    with pytest.raises(ValueError, match="data_path"):
        taskset.load(spark, taskset.SetOptions())
    file.write_text(json.dumps(row | {"blueprint_root": "blueprints/gone"}) + "\n")
    with pytest.raises(FileNotFoundError):
        taskset.load(spark, taskset.SetOptions(str(file)))
    arms = spark.createDataFrame([("a",), ("a",)], "arm string")
    assert taskset.same_arm(arms, taskset.HarnessOptions()).count() == 2
    with pytest.raises(Exception, match="harness arm b does not match task arm a"):
        taskset.same_arm(arms, taskset.HarnessOptions(arm="b")).collect()
    with tarfile.open(fileobj=io.BytesIO(taskset.archive(tmp_path / "blueprints" / "a", "data/a"))) as tar:
        assert sorted(tar.getnames()) == ["data/a", "data/a/solution.py"] and tar.extractfile("data/a/solution.py").read() == b"pass\n"
    assert (taskset.HarnessOptions().max_tool_calls, taskset.HarnessOptions().tool_timeout, taskset.TaskOptions().max_trace_tokens) == (8, 30, 4096)


def test_template_parity(spark):
    block = "<|im_start|>{role}\n{content}\n<|im_end|>\n\n".format
    good = lambda ms: "".join(block(role=m["role"], content=m["content"].rstrip()) for m in ms) + "<|im_start|>assistant\n"
    taskset.template_parity(spark, good)
    with pytest.raises(ValueError, match="renders"):
        taskset.template_parity(spark, lambda ms: good(ms).replace("<|im_end|>\n\n", "<|im_end|>\n"))


def test_exports():
    import trailspark

    assert trailspark.load is taskset.load and all(hasattr(trailspark, n) for n in trailspark.__all__)
    with pytest.raises(AttributeError):
        trailspark.nothing  # noqa: B018


def test_equal_programs_of_all_traces_run_once(spark, tmp_path):
    log = tmp_path / "runs"
    said = [("assistant", call("python_test", "c1")), ("assistant", call("apply_patch", "c2", file_path="solution.py", find="2", replace="1")), ("assistant", call("python_test", "c3"))]
    rows = turns(spark, "t/1", "a", said).unionByName(turns(spark, "t/2", "a", said)).unionByName(turns(spark, None, "a", said[1:]))
    tests = f"with open({str(log)!r}, 'a') as f:\n    print(x, file=f)\nassert x == 1\n"
    got = {r.trace: r for r in replay.replay(rows.withColumn("test_code", F.lit(tests))).collect()}
    assert [(got[t].visible, got[t].final_success) for t in ("t/1", "t/2", None)] == [(["ASSERTION_FAILURE", "PASS"], True)] * 2 + [(["PASS"], True)]
    assert [r.stderr for r in got["t/2"].results] == ["tests failed", "", ""] and got[None].final_verification.stdout == "tests passed"
    assert sorted(log.read_text().split()) == ["1", "2"]


def test_runs_share_an_interpreter_and_nothing_else(tmp_path):
    log = tmp_path / "parents"
    code = f"import json, os\nassert json.dumps(1) == '1' and 'x' not in globals()\njson.dumps, x = None, 1\nwith open({str(log)!r}, 'a') as f:\n    print(os.getppid(), os.getsid(0) == os.getpid(), file=f)\n"
    ends = ["", "raise ValueError\n", "class Last:\n    def __del__(self):\n        os._exit(5)\nlast = Last()\n", "import atexit\natexit.register(os._exit, 6)\n", "import threading, time\nthreading.Thread(target=lambda: (time.sleep(0.3), os._exit(7))).start()\n"]
    got = [execution.run_tests(code + end, "") for end in ends]
    assert [(r["outcome"], r["exit_code"]) for r in got] == [("PASS", 0), ("RUNTIME_ERROR", 1), ("OTHER", 5), ("OTHER", 6), ("OTHER", 7)]
    (parent, led), = {tuple(x.split()) for x in log.read_text().splitlines()}
    assert led == "True" and int(parent) != os.getpid()
