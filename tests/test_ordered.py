"""Lines in order from and to many tasks."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailspark.sources import lines, ordered


def numbered(data):
    """(line, place, text) of the lines of parts, in plain Python."""
    out, at = [], 0
    for part in data:
        *whole, rest = part.split(b"\n")
        for line in [*whole, *([rest] if rest else [])]:
            at += 1
            text = line.removesuffix(b"\r")
            if text.strip():
                out.append((at, len(out), text.decode("utf-8", "replace")))
    return out


TEXTS = [
    b"", b"\n", b"a", b"a\n", b"\n\na\n\n", b"a\r\nb\r\n", "é\n漢字\n".encode(), b"\xff\n", b"x" * 500 + b"\n" + b"y" * 3,
    b"\n".join(b"line %d" % i * (i % 9) for i in range(200)),
]


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 10_000])
@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_splits_hold_every_line_once(tmp_path, split_bytes, chunk):
    for i, text in enumerate(TEXTS):
        path = tmp_path / f"f{i}"
        path.write_bytes(text)
        got = [x for s in ordered.splits_of(str(path), split_bytes) for some in ordered.lines_of(s, chunk) for x in some]
        *whole, rest = text.split(b"\n")
        assert got == [*whole, *([rest] if rest else [])]


def test_first_lines_of_files_and_parts(spark, tmp_path):
    for i, text in enumerate(TEXTS):
        path = tmp_path / f"f{i}"
        path.write_bytes(text)
    for i in (3, 7, 9):
        want = numbered([TEXTS[i]])
        for limit in (None, 0, 1, 30, 10_000):
            got = sorted(map(tuple, ordered.first_lines(spark, f"{tmp_path}/f{i}", limit, split_bytes=300).collect()))
            assert got == want[:limit]
    folder = tmp_path / "parts"
    folder.mkdir()
    for n, i in enumerate((4, 9, 0, 6)):
        (folder / f"part-{n:05d}.json").write_bytes(TEXTS[i])
    (folder / "_parts.json").write_text("[]")
    got = sorted(map(tuple, ordered.first_lines(spark, f"file://{folder}", 150, split_bytes=200).collect()))
    assert got == numbered([TEXTS[4] , TEXTS[9], b"", TEXTS[6]])[:150]
    with pytest.raises(FileNotFoundError):
        ordered.first_lines(spark, f"{tmp_path}/none")


def test_splits_beyond_the_limit_are_not_read(spark, tmp_path, monkeypatch):
    path = tmp_path / "tasks.jsonl"
    row = lambda i: json.dumps({"case_id": f"c{i}", "prompt": [{"role": "user", "content": "p" * 50}], "blueprint_root": "b", "test_code": "t"})
    path.write_text("\n".join(row(i) for i in range(4000)) + "\nbroken\n")
    loaded, plain = [], ordered._load
    monkeypatch.setattr(ordered, "_load", lambda spark, splits, counting: loaded.append((counting, sum(s.end - s.start for s in splits))) or plain(spark, splits, counting))
    got = lines.read_tasks(spark, str(path), 60, split_bytes=4096).orderBy("idx").collect()
    assert [(r.case_id, r.idx, r.source_task_id) for r in got] == [(f"c{i}", i, i) for i in range(60)]
    needed = len("\n".join(row(i) for i in range(60)))
    assert sum(n for counting, n in loaded if not counting) <= needed + 2 * 4096 < path.stat().st_size / 10
    assert sum(n for counting, n in loaded if counting) <= 2 * needed + 4 * 4096
    plan = lines.read_tasks(spark, str(path), 60)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    with pytest.raises(Exception, match="4001: missing fields"):
        lines.read_tasks(spark, str(path), split_bytes=1 << 16).collect()


def test_parts_are_ordered_and_reported(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.randrange(500), f"é{i}", None if i % 3 else 1.5) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, said string, maybe double").repartition(7)
    path = f"{tmp_path}/out"
    for _ in range(2):  # the second time in place of the first
        ordered.write_lines(df.repartitionByRange(5, "k").sortWithinPartitions("k", "said").select(F.to_json(F.struct("k", "maybe", "said")).alias("value")), f"file://{path}")
        parts = ordered.parts_of(path)
        assert len(parts) == 5 and sorted(x.name for x in Path(path).iterdir()) == ["_parts.json", *(p["path"] for p in parts)]
        read = [json.loads(x) for p in parts for x in Path(path, p["path"]).read_text().splitlines()]
        assert [(r["k"], r["said"]) for r in read] == sorted((k, s) for k, s, _ in data)
        for p in parts:
            data_ = Path(path, p["path"]).read_bytes()
            assert (p["bytes"], p["sha256"], p["rows"]) == (len(data_), hashlib.sha256(data_).hexdigest(), data_.count(b"\n"))
    assert not list(tmp_path.glob("*.staging-*"))
    small = lines.write_jsonl(df, f"{tmp_path}/small", ["k", "said"])
    assert sum(p["rows"] for p in small) == 2000
    assert lines.write_jsonl(df.limit(0), f"{tmp_path}/empty", ["k"]) == [] and ordered.parts_of(f"{tmp_path}/empty") == []


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    good = spark.range(20).select(F.col("id").cast("string").alias("value"))
    ordered.write_lines(good, path)
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="boom"):
        ordered.write_lines(bad, path)
    assert not list(tmp_path.glob("*.staging-*"))
    assert sum(p["rows"] for p in ordered.parts_of(path)) == 20
