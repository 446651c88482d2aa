"""The data set of both arms from raw tasks: split, recoveries, supervised traces, artifacts, manifest; and its validation."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.text import rstrip
from trailspark.operators import execution, quality, replay, sft, split, transcript
from trailspark.session import cut
from trailspark.sources import ordered
from trailspark.sources.lines import file_digests, publish_text, write_jsonl, write_manifest

ARMS = ("a", "b")
PARTS = {"first": "sft", "second": "rl", "rest": "test"}
LABELS = ("sft", "rl", "validation", "test")
TASK_FIELDS = ["blueprint_root", "case_id", "source", "split", "task_id", "test_code", "trace_prefix"]


def recoveries(tasks: DataFrame, n_deep: int, n_shallow: int, *, seed: int, timeout: float) -> DataFrame:
    """case_id, mode, initial_code and the failing candidates of the tasks that fill the quotas, in seeded order.

    Mutations are run only of the tasks up to the wave that fills the quotas, and
    of each only up to its answer.  Too few tasks are an error.
    """
    waves: list[DataFrame] = []

    def attempt(wave: DataFrame, deep: bool) -> DataFrame:
        settled = execution.chained_failures if deep else execution.first_failures
        failing = cut(execution.run_until(wave, settled, timeout=timeout).where(execution.FAILED))
        waves.append(failing)
        ok = lambda found, name: found.select("case_id", F.lit(True).alias(name))
        chained = execution.chained_failures(failing) if deep else failing.limit(0)
        both = wave.select("case_id").join(ok(chained, "d"), "case_id", "left").join(ok(execution.first_failures(failing), "s"), "case_id", "left")
        return both.select("case_id", F.coalesce("d", F.lit(False)).alias("deep_ok"), F.coalesce("s", F.lit(False)).alias("shallow_ok"))

    keyed = tasks.withColumn("key", split.seeded_key(seed, "task_id", "prompt"))
    chosen = cut(split.lazy_quota_fill(keyed, n_deep, n_shallow, attempt, task_id="case_id").select("case_id", "tier", "mode"))
    sizes = {r.tier: r.n for r in chosen.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    if (sizes.get("deep", 0), sizes.get("shallow", 0)) != (n_deep, n_shallow):
        raise ValueError(f"{sizes.get('deep', 0)} deep and {sizes.get('shallow', 0)} shallow recoveries, not {n_deep} and {n_shallow}")
    failing = quality.all_of(waves) if waves else execution.candidates(tasks.limit(0)).withColumn("outcome", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    one = chosen.where("tier = 'shallow'").join(execution.first_failures(failing), "case_id").select(
        "case_id", "mode", "initial_code", F.col("outcome").alias("outcome_1"), F.col("find").alias("find_1"), F.col("replace").alias("replace_1"), none.alias("outcome_2"), none.alias("find_2"), none.alias("replace_2")
    )
    two = chosen.where("tier = 'deep'").join(execution.chained_failures(failing), "case_id").select(
        "case_id", F.concat(F.lit("deep_"), "mode").alias("mode"), "initial_code", F.col("first_outcome").alias("outcome_1"), F.col("middle_find").alias("find_1"), F.col("middle_replace").alias("replace_1"),
        F.col("second_outcome").alias("outcome_2"), F.col("final_find").alias("find_2"), F.col("final_replace").alias("replace_2"),
    )
    return one.unionByName(two)


def require_ids(tasks: DataFrame, low: int, high: int, name: str) -> None:
    """An error unless the tasks have exactly the ids from ``low`` to ``high``."""
    wanted = tasks.sparkSession.range(low, high + 1).select(F.col("id").alias("task_id"))
    bad = quality.same_ids(tasks, wanted, name, "task_id").orderBy("detail", F.col("key").cast("long")).limit(5).collect()
    if bad:
        raise ValueError(f"{name}: ids differ: " + ", ".join(f"{r.key} {r.detail}" for r in bad))


@contextlib.contextmanager
def staged(output: str) -> Iterator[Path]:
    """A folder beside ``output`` whose entries replace those of ``output`` one by one at the end; an error leaves ``output`` as it was."""
    target = Path(output).expanduser().resolve()
    folder = target.with_name(f".{target.name}.staging")
    shutil.rmtree(folder, ignore_errors=True)
    folder.mkdir(parents=True)
    try:
        yield folder
        target.mkdir(parents=True, exist_ok=True)
        stale = [x for x in target.iterdir() if x.name.startswith("arm_") or (folder / x.name).exists()]
        for old in stale:
            shutil.rmtree(old) if old.is_dir() else old.unlink()
        for new in sorted(folder.iterdir(), key=lambda x: x.name == "manifest.json"):  # the manifest last, as it vouches for the rest
            os.replace(new, target / new.name)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def prepare(
    spark: SparkSession, source: str, output: str, *, n_sft: int, n_rl: int, n_deep: int, n_shallow: int, seed: int = 42, timeout: float = 5,
    validation: str | None = None, n_moved: int = 0, test: str | None = None, ids: dict[str, tuple[int, int]] | None = None,
) -> None:
    """Write ``arm_{a,b}_{sft,rl,validation,test}`` as JSON Lines, blank solutions, ``assignments.json`` and ``manifest.json``.

    Everything is built beside ``output`` and moved there at the end.  ``source`` is
    split into supervised, RL and, without a ``test`` table, test tasks; the first
    ``n_moved`` tasks of ``validation``, in seeded order, join ``source`` before, and
    the others are the validation part.  ``ids`` are the exact first and last ids
    that ``train``, ``validation`` and ``test`` must have.  Gold code that fails is
    an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", f"{output}/.checkpoint"))
    read = lambda path: transcript.normalise_tasks(spark.read.parquet(path), "task_").checkpoint()
    given = {"train": read(source), **({"validation": read(validation)} if validation else {}), **({"test": read(test)} if test else {})}
    for name, (low, high) in (ids or {}).items():
        require_ids(given[name], low, high, name)
    tasks = quality.all_of(list(given.values()))
    if bad := [r.case_id for r in split.repeated_ids(tasks, "case_id").orderBy("case_id").limit(5).collect()]:
        raise ValueError(f"repeated tasks: {', '.join(bad)}")
    if bad := [r.case_id for r in execution.failing_gold(tasks, timeout=timeout).select("case_id").orderBy("case_id").limit(5).collect()]:
        raise ValueError(f"gold code fails: {', '.join(bad)}")
    pool, held = given["train"], []
    if validation:
        moved = split.seeded_top(given["validation"], n_moved, seed=seed).drop("position")
        pool = pool.unionByName(moved)
        held.append(given["validation"].join(moved.select("task_id"), "task_id", "left_anti").withColumn("split", F.lit("validation")))
    if test:
        held.append(given["test"].withColumn("split", F.lit("test")))
    part = split.three_way_split(pool, n_sft, n_rl, seed=seed)
    for name, label in PARTS.items():
        part = part.replace(name, label, subset=["part"])
    placed = quality.all_of([pool.join(part.withColumnRenamed("part", "split"), "task_id"), *held]).checkpoint()
    sizes = {r.split: r.n for r in placed.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if test and sizes.get("test") != given["test"].count():
        raise ValueError("more training tasks than the parts take")
    chosen = recoveries(placed.where("split = 'sft'"), n_deep, n_shallow, seed=seed, timeout=timeout).checkpoint()
    rows = transcript.task_rows(placed)
    artifacts = {}
    with staged(output) as folder:
        for arm in ARMS:
            own = rows.where(F.col("arm") == arm)
            for label in LABELS[1:]:
                if label in sizes:
                    artifacts |= written(own.where(F.col("split") == label), folder, f"arm_{arm}_{label}")
            traced = placed.select("case_id", "code").join(own.where("split = 'sft'"), "case_id").join(chosen, "case_id", "left")
            artifacts |= written(sft.traces(traced, arm), folder, f"arm_{arm}_sft")
        for r in placed.select("case_id").toLocalIterator():
            project = folder / "blueprints" / r.case_id
            project.mkdir(parents=True)
            (project / "solution.py").write_text(sft.PLACEHOLDER, encoding="utf-8")
        supervised = spark.read.json(f"{folder}/arm_a_sft")
        assigned = [r.asDict() for r in assignments(supervised).orderBy("task_id").collect()]  # a row a supervised task
        listing = json.dumps(assigned, indent=2, sort_keys=True) + "\n"
        publish_text(f"{folder}/assignments.json", listing)
        artifacts["assignments.json"] = {"sha256": hashlib.sha256(listing.encode()).hexdigest(), "bytes": len(listing.encode())}
        outcomes = Counter(x for r in chosen.select("outcome_1", "outcome_2").collect() for x in r if x is not None)
        id_lists = {r.split: sorted(r.ids) for r in placed.where("split <> 'test'").groupBy("split").agg(F.collect_list("task_id").alias("ids")).collect()}
        summary = {
            "seed": seed, **sizes, "moved": n_moved, "recovery_outcomes": dict(sorted(outcomes.items())), "composition": composition(supervised),
            **{f"{label}_task_ids": found for label, found in id_lists.items()}, **{f"{name}_ids": f"{low}-{high}" for name, (low, high) in (ids or {}).items()},
        }
        named = {"tasks": source, **({"validation": validation} if validation else {}), **({"test": test} if test else {})}
        write_manifest(f"{folder}/manifest.json", artifacts, {k: {"path": v, "sha256": source_digest(spark, v)} for k, v in named.items()}, summary)


def written(rows: DataFrame, folder: Path, name: str) -> dict[str, dict]:
    """The parts of an artifact by their path in the data set, as their writers reported them."""
    return {f"{name}/{part['path']}": part for part in write_jsonl(rows, f"file://{folder}/{name}", ["case_id"])}


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with nulls for the columns that its written rows leave out."""
    return df.select("*", *(F.lit(None).cast("string").alias(n) for n in names if n not in df.columns))


def assignments(supervised: DataFrame) -> DataFrame:
    """The assignment table: what each supervised task shows."""
    rows = with_columns(supervised, ["recovery_mode"])
    kind = F.when(F.col("recovery_mode").isNull(), "direct").otherwise("recovery")
    return rows.select("task_id", "case_id", kind.alias("trace_type"), "candidate_outcome", "recovery_mode")


def composition(supervised: DataFrame) -> dict[str, int]:
    """Supervised tasks by recovery mode, ``direct`` without one."""
    mode = F.coalesce("recovery_mode", F.lit("direct")).alias("mode")
    return {r.mode: r.n for r in with_columns(supervised, ["recovery_mode"]).groupBy(mode).agg(F.count("*").alias("n")).orderBy("mode").collect()}


def source_digest(spark: SparkSession, path: str) -> str:
    """One digest of a table's files, whatever their order."""
    found = file_digests(spark, path if path.endswith(".parquet") and Path(path).is_file() else f"{path}/*")
    return found.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ","), 256)).first()[0]


def digests(spark: SparkSession, output: str) -> DataFrame:
    """(path, sha256, bytes) of the artifacts, named by their folder and file."""
    found = file_digests(spark, f"{output}/arm_*/part-*").withColumn("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    return found.unionByName(file_digests(spark, f"{output}/assignments.json").withColumn("path", F.lit("assignments.json")))


def in_order(spark: SparkSession, output: str, arm: str, label: str) -> DataFrame:
    """(line, fields as text) of an artifact of tasks, numbered over its parts."""
    row = F.try_parse_json("value")
    fields = [F.try_variant_get(row, f"$.{f}", "string").alias(f) for f in TASK_FIELDS]
    return ordered.first_lines(spark, f"{output}/arm_{arm}_{label}").select("line", *fields, F.try_variant_get(row, "$.prompt[1].content", "string").alias("user"))


def placeholders(spark: SparkSession, output: str, ids: DataFrame) -> DataFrame:
    """Violations of the blank solutions: a task without one, or one that is not blank."""
    found = spark.read.text(f"{output}/blueprints/*/solution.py", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/solution\.py$", 1).alias("case_id"), F.col("value").alias("said"))
    both = ids.select("case_id").distinct().join(found, "case_id", "left")
    return quality.rows_where(both, "placeholder", ~F.col("said").eqNullSafe(sft.PLACEHOLDER))


def replayed(rows: DataFrame, timeout: float) -> DataFrame:
    """(name, key, detail) of supervised traces of both arms that break the protocol or differ from their mode when their calls are run again."""
    rows = rows.withColumn("trace", F.concat_ws("/", "arm", "case_id"))
    prefix = F.concat(F.lit("data/blueprints/"), "case_id").alias("trace_prefix")
    turns = rows.select("trace", "arm", "test_code", F.lit(sft.PLACEHOLDER).alias("workspace"), prefix, F.posexplode("messages").alias("turn", "m")).select("*", "m.role", "m.content").drop("m")
    plan = rows.select("trace", "arm", F.col("recovery_mode").alias("mode"), F.col("candidate_outcome").alias("first_outcome"), F.col("second_candidate_outcome").alias("second_outcome"))
    broken = replay.shape_violations(replay.replay(turns, timeout=timeout), plan)
    return broken.select(F.lit("replay").alias("name"), F.col("trace").alias("key"), F.col("problem").alias("detail"))


def lengths(rows: DataFrame, tokenizer_file: str, max_tokens: int) -> DataFrame:
    """(name, key, detail) of supervised traces whose rendered text has more tokens than allowed."""
    counted = rows.withColumn("n", transcript.count_tokens(transcript.render(F.col("messages")), tokenizer_file))
    return quality.rows_where(counted, "tokens", F.col("n") > max_tokens, F.concat_ws("/", "arm", "case_id"), F.col("n"))


def violations(spark: SparkSession, output: str, *, timeout: float = 5, tokenizer_file: str | None = None, max_tokens: int = 1280) -> DataFrame:
    """(name, key, detail) of every broken constraint of a prepared data set; lengths are checked if there is a tokenizer."""
    document = spark.read.option("multiLine", True).option("primitivesAsString", True).json(f"{output}/manifest.json")
    listed = document.select(F.from_json(F.to_json("artifacts"), "map<string,struct<sha256:string,bytes:string>>").alias("m"))
    listed = listed.select(F.explode("m").alias("path", "v")).select("path", "v.sha256", F.col("v.bytes").cast("long").alias("bytes"))
    told = document.select(F.from_json(F.to_json("split"), "map<string,string>").alias("m"), F.from_json(F.to_json("split.composition"), "map<string,string>").alias("c")).first()
    sizes = {k: int(v) for k, v in told.m.items() if k in LABELS}
    read = lambda arm, label: spark.read.json(f"{output}/arm_{arm}_{label}")
    labels = [x for x in LABELS if all(any(Path(output, f"arm_{a}_{x}").glob("part-*.json")) and read(a, x).columns for a in ARMS)]
    ids = [read("a", x).select("case_id", F.lit(x).alias("split")) for x in labels]
    checks = [quality.artifacts(listed, digests(spark, output)), quality.disjoint(quality.all_of(ids), "disjoint")]
    for x in labels:
        own = ["matched_key", "candidate_outcome", "second_candidate_outcome", "recovery_mode"] if x == "sft" else ["split"]
        says = F.col("messages" if x == "sft" else "prompt")
        arms = []
        for arm in ARMS:
            df = read(arm, x)
            for lost in [f for f in own if f not in df.columns]:  # written rows leave out nulls
                df = df.withColumn(lost, F.lit(None).cast("string"))
            df = df.withColumn("user", F.get(says, F.lit(1))["content"])
            arms.append(df)
            checks.append(quality.rows_where(df, f"metadata {arm} {x}", (F.col("arm") != arm) | (F.col("split") != x if x != "sft" else F.lit(False))))
            checks.append(quality.rows_where(df, f"system {arm} {x}", F.get(says, F.lit(0))["content"] != transcript.SYSTEMS[arm]))
            checks.append(quality.rows_where(df, f"tests in prompt {arm} {x}", ~F.contains("user", rstrip("test_code"))))
            if x in sizes:
                checks.append(quality.counts(df, f"count {x}", ["arm"], {(arm,): sizes[x]}))
            if x == "sft":
                checks.append(quality.rows_where(df, f"final {arm}", ~transcript.ends_final(F.col("messages"))))
        checks.append(quality.matched(*arms, f"matched {x}", ["task_id", "test_code", "user", *own]))
        if x != "sft":
            checks.append(quality.zipped(*(in_order(spark, output, arm, x) for arm in ARMS), f"order {x}", [*TASK_FIELDS, "user"]))
        if x == "sft":
            needed = ["arm", "case_id", "test_code", "messages", "candidate_outcome", "second_candidate_outcome", "recovery_mode"]
            both = quality.all_of([df.select(*needed) for df in arms])
            written = spark.read.option("multiLine", True).schema(assignments(arms[0]).schema).json(f"{output}/assignments.json")
            checks.append(quality.matched(written, assignments(arms[0]), "assignments", ["task_id", "trace_type", "candidate_outcome", "recovery_mode"]))
            for arm, df in zip(ARMS, arms, strict=True):
                modes = df.withColumn("mode", F.coalesce("recovery_mode", F.lit("direct")))
                checks.append(quality.counts(modes, f"composition {arm}", ["mode"], {(k,): int(v) for k, v in (told.c or {}).items()}))
            checks.append(replayed(both, timeout))
            if tokenizer_file:
                checks.append(lengths(both, tokenizer_file, max_tokens))
        if f"{x}_task_ids" in told.m:
            given = spark.createDataFrame([(int(i),) for i in json.loads(told.m[f"{x}_task_ids"])], "task_id long")
            checks.append(quality.same_ids(arms[0].select(F.col("task_id").cast("long").alias("task_id")), given, f"listed ids {x}", "task_id"))
            checks.append(quality.counts(given.withColumn("part", F.lit(x)), "listed", ["part"], {(x,): sizes.get(x, 0)}))
    checks.append(placeholders(spark, output, quality.all_of(ids)))
    return quality.all_of(checks)
