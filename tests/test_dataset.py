"""The data set build and its validation, on a handful of programs."""

import json

import pytest

from trailspark.plans import dataset, fixtures
from trailspark.schema import TASK


def raw(spark, extra=()):
    tasks = [(i, f"Write {n}.\r\n", c.replace("\n", "\r\n"), t.splitlines(), None) for i, (n, c, t) in enumerate(fixtures._TASKS, 1)]
    return spark.createDataFrame([*tasks, *extra], TASK)


def test_prepare_and_validate(spark, tmp_path):
    source, output = f"{tmp_path}/tasks", tmp_path / "out"
    output.mkdir()
    raw(spark).write.parquet(source)
    dataset.prepare(spark, source, str(output), n_sft=2, n_rl=1, n_deep=0, n_shallow=1, timeout=10)
    read = lambda name: [json.loads(x) for f in sorted((output / name).glob("part-*")) for x in f.read_text().splitlines()]
    a, b = read("arm_a_sft"), read("arm_b_sft")
    assert [r["case_id"] for r in a] == [r["case_id"] for r in b] and len(a) == 2
    assert sorted(r["trace_type"] for r in a) == ["direct", "recovery"]
    assert [r["matched_key"] for r in a] == [r["matched_key"] for r in b]
    assert len(read("arm_a_rl")) == 1 and read("arm_a_test") == []
    assert {r["case_id"] for r in a} | {r["case_id"] for r in read("arm_b_rl")} == {"task_1", "task_2", "task_3"}
    assert dataset.violations(spark, str(output), timeout=10).collect() == []
    manifest, listed = (json.loads((output / f"{x}.json").read_text()) for x in ("manifest", "assignments"))
    assert manifest["split"]["composition"] == {"direct": 1, "shadow": 1} and manifest["split"]["sft_task_ids"] == [r["task_id"] for r in listed] and len(manifest["sources"]["tasks"]["sha256"]) == 64
    assert {r["trace_type"] for r in listed} == {"direct", "recovery"} and "assignments.json" in manifest["artifacts"]
    assert not (tmp_path / ".out.staging").exists()
    file = next((output / "arm_b_rl").glob("part-*"))
    row = json.loads(file.read_text())
    file.write_text(json.dumps(row | {"test_code": row["test_code"] + "\n"}) + "\n")
    (output / "arm_b_rl" / f".{file.name}.crc").unlink(missing_ok=True)
    assert {r.name for r in dataset.violations(spark, str(output), timeout=10).collect()} == {"artifact", "matched rl", "order rl"}
    blank = output / "blueprints" / row["case_id"] / "solution.py"
    blank.write_text("x = 1\n")
    (output / "assignments.json").write_text(json.dumps([r | {"trace_type": "direct"} for r in listed]))
    found = [(r.name, r.key) for r in dataset.violations(spark, str(output), timeout=10).collect()]
    assert ("placeholder", row["case_id"]) in found and sum(n == "assignments" for n, _ in found) == 1
    listing = json.loads((output / "manifest.json").read_text())
    listing["split"]["rl_task_ids"] = [77]
    listing["split"]["sft_task_ids"].append(78)
    (output / "manifest.json").write_text(json.dumps(listing))
    found = {(r.name, r.key, r.detail) for r in dataset.violations(spark, str(output), timeout=10).collect()}
    assert {("listed ids rl", "77", "missing"), ("listed ids sft", "78", "missing"), ("listed", "sft", "3 of 2")} <= found and not any(n == "listed" and k == "rl" for n, k, _ in found)
    blank.unlink()
    assert ("placeholder", row["case_id"]) in [(r.name, r.key) for r in dataset.violations(spark, str(output), timeout=10).collect()]
    changed = next((output / "arm_b_sft").glob("part-*"))
    rows = [json.loads(x) for x in changed.read_text().splitlines()]
    direct = next(r for r in rows if r["trace_type"] == "direct")
    direct["messages"] = [m | {"content": m["content"].replace("PASS", "OTHER")} if m["role"] == "assistant" else m for m in direct["messages"]]
    direct["messages"][0]["content"] = "something else"
    rows[1 - rows.index(direct)]["messages"].pop()
    changed.write_text("".join(json.dumps(r) + "\n" for r in rows))
    (output / "arm_b_sft" / f".{changed.name}.crc").unlink(missing_ok=True)
    found = {(r.name, r.key) for r in dataset.violations(spark, str(output), timeout=10).collect()}
    assert {("system b sft", direct["case_id"]), ("replay", f"b/{direct['case_id']}")} <= found
    assert any(name == "final b" for name, _ in found) and not any("tests in prompt" in name or "count" in name for name, _ in found)


def test_prepare_with_validation_and_test_tables(spark, tmp_path):
    output = tmp_path / "out"
    base = [(f"def f{i}(x):\n    return x + {i}\n", [f"assert f{i}(1) == {i + 1}"]) for i in range(9)]
    table = lambda ids, name: spark.createDataFrame([(i, f"Write {i}.", *base[i], None) for i in ids], TASK).write.parquet(f"{tmp_path}/{name}")
    for ids, name in ((range(3), "train"), (range(3, 7), "validation"), (range(7, 9), "test")):
        table(ids, name)
    options = dict(validation=f"{tmp_path}/validation", test=f"{tmp_path}/test", n_sft=2, n_rl=2, n_deep=0, n_shallow=1, n_moved=1, timeout=10)
    output.mkdir()
    (output / "README.md").write_text("stays")
    (output / "arm_c_old").mkdir()
    with pytest.raises(ValueError, match="train: ids differ: 0 extra, 3 missing"):
        dataset.prepare(spark, f"{tmp_path}/train", str(output), ids={"train": (1, 3)}, **options)
    assert sorted(x.name for x in output.iterdir() if x.name[0] != ".") == ["README.md", "arm_c_old"]  # as it was
    dataset.prepare(spark, f"{tmp_path}/train", str(output), ids={"train": (0, 2), "test": (7, 8)}, **options)
    split = json.loads((output / "manifest.json").read_text())["split"]
    assert {k: split[k] for k in ("sft", "rl", "validation", "test", "moved", "train_ids")} == {"sft": 2, "rl": 2, "validation": 3, "test": 2, "moved": 1, "train_ids": "0-2"}
    assert set(split["validation_task_ids"]) < {3, 4, 5, 6} and {0, 1, 2} < {*split["sft_task_ids"], *split["rl_task_ids"]}
    assert dataset.violations(spark, str(output), timeout=10).collect() == []
    assert (output / "README.md").exists() and not (output / "arm_c_old").exists()
    assert len(list((output / "blueprints").glob("*/solution.py"))) == 9


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from trailspark import __main__ as command

    monkeypatch.setattr(command, "build", lambda: spark)
    raw(spark).write.parquet(f"{tmp_path}/tasks")
    output = f"{tmp_path}/out"
    command.main(["prepare", f"{tmp_path}/tasks", output, "--n-sft", "1", "--n-rl", "1", "--n-deep", "0", "--n-shallow", "0", "--train-ids", "1", "3", "--timeout", "10"])
    with pytest.raises(SystemExit) as end:
        command.main(["validate", output, "--timeout", "10"])
    assert end.value.code == 0 and json.loads(capsys.readouterr().out) == {"violations": 0}
    (tmp_path / "out" / "blueprints" / "task_1" / "solution.py").write_text("")
    with pytest.raises(SystemExit) as end:
        command.main(["validate", output, "--timeout", "10"])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert end.value.code == 1 and said == [{"name": "placeholder", "key": "task_1", "detail": ""}, {"violations": 1}]
    turns = tmp_path / "turns.jsonl"
    said = ['CALL apply_patch {"id":"c1","file_path":"solution.py","find":"2","replace":"1"}', 'CALL python_test {"id":"c2"}', "FINAL: done"]
    turns.write_text("".join(json.dumps({"trace": "t/1", "turn": i, "role": "assistant", "content": c, "arm": "a", "test_code": "assert x == 1", "workspace": "x = 2\n"}) + "\n" for i, c in enumerate(said)))
    command.main(["replay", str(turns), f"{tmp_path}/records", "--arm", "a", "--tool-timeout", "5"])
    assert json.loads(capsys.readouterr().out) == {"records": 1}
    record = json.loads((tmp_path / "records" / "t_1.json").read_text())
    assert record["final_verification"]["success"] and [c["id"] for c in record["calls"]] == ["c1", "c2"] and record["results"]["c2"]["outcome"] == "PASS"
    command.main(["replay", str(turns), f"{tmp_path}/records", "--max-tool-calls", "1"])
    assert json.loads((tmp_path / "records" / "t_1.json").read_text())["protocol_errors"] == ["tool budget exhausted"]
    with pytest.raises(Exception, match="harness arm b"):
        command.main(["replay", str(turns), f"{tmp_path}/records", "--arm", "b"])
    capsys.readouterr()
    traces = tmp_path / "traces.jsonl"
    record = {"calls": [], "results": {}, "prediction_targets": []}
    traces.write_text("".join(json.dumps({"rewards": {"z": i % 2, "a": 1}, "metrics": {"passed": i % 2}, "info": {"r": record}, "task": {"data": {"case_id": str(i), "name": str(i)}}}) + "\n" for i in range(4)))
    command.main(["passk", str(traces), "-k", "1"])
    assert json.loads(capsys.readouterr().out)["pass_at_k"] == 0.5
    command.main(["compare", str(traces), str(traces), "-k", "1"])
    assert json.loads(capsys.readouterr().out)["ties"] == 4
    command.main(["report", str(traces)])
    assert json.loads(capsys.readouterr().out)["traces"] == 4
    command.main(["stats", str(traces), str(traces)])
    assert json.loads(capsys.readouterr().out)["n"] == 4


def test_long_traces_are_found(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    words.save(f"{tmp_path}/words.json")
    say = lambda n: [("user", "w " * n)]
    rows = spark.createDataFrame([("a", "x", say(5)), ("b", "x", say(50))], "arm string, case_id string, messages array<struct<role:string,content:string>>")
    got = dataset.lengths(rows, f"{tmp_path}/words.json", 20).collect()
    assert [(r.name, r.key) for r in got] == [("tokens", "b/x")]


def test_prepare_refuses_bad_tasks(spark, tmp_path):
    output = tmp_path / "out"
    output.mkdir()
    options = dict(n_sft=1, n_rl=1, n_deep=0, n_shallow=0, timeout=10)
    raw(spark, [(9, "p", "x = 1", ["assert x == 2"], "")]).write.parquet(f"{tmp_path}/gold")
    with pytest.raises(ValueError, match="task_9"):
        dataset.prepare(spark, f"{tmp_path}/gold", str(output), **options)
    raw(spark, [(8, " ", "x = 1", [], None)]).write.parquet(f"{tmp_path}/empty")
    with pytest.raises(Exception, match="task_8"):
        dataset.prepare(spark, f"{tmp_path}/empty", str(output), **options)
