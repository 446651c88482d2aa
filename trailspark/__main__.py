"""Command line: passk TRACES -k N, report TRACES, compare BEFORE AFTER -k N, stats A B,
prepare TASKS OUTPUT with sizes, seed and tables, validate OUTPUT [--tokenizer FILE --max-tokens N]: a line per
violation, then their number; replay TURNS OUTPUT: the runtime record of each stored trace, as a file."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from trailspark.operators import metrics, replay, stats
from trailspark.plans import dataset
from trailspark.plans.taskset import HarnessOptions, same_arm, write_records
from trailspark.session import build
from trailspark.sources.lines import load_outcomes, load_traces


#: Options of prepare: tasks of each part, supervised tasks that recover from two or one failures, and the seed.
SIZES = {"n-sft": 212, "n-rl": 212, "n-deep": 20, "n-shallow": 50, "n-moved": 0, "seed": 42}
#: Columns of the turns that are replayed.
TURN = "trace string, turn int, role string, content string, arm string, test_code string, workspace string, trace_prefix string"
#: Tables whose ids can be required.
PARTS = ("train", "validation", "test")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trailspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, files in (("passk", ["traces"]), ("report", ["traces"]), ("compare", ["before", "after"]), ("stats", ["a", "b"]), ("prepare", ["tasks", "output"]), ("validate", ["output"]), ("replay", ["turns", "output"])):
        sub = commands.add_parser(name)
        for f in files:
            sub.add_argument(f)
        if name in ("passk", "compare"):
            sub.add_argument("-k", type=int, default=1)
        if name == "prepare":
            for option, default in SIZES.items():
                sub.add_argument(f"--{option}", type=int, default=default)
            sub.add_argument("--validation", help="table of validation tasks; the first --n-moved of them are trained on")
            sub.add_argument("--test", help="table of test tasks; without it, the tasks left over")
            for part in PARTS:
                sub.add_argument(f"--{part}-ids", type=int, nargs=2, metavar=("FIRST", "LAST"), help="ids that the table must have")
        if name == "replay":
            sub.add_argument("--arm", choices=("a", "b"), help="the arm that all traces must be of")
            sub.add_argument("--max-tool-calls", type=int, default=HarnessOptions.max_tool_calls)
            sub.add_argument("--tool-timeout", type=float, default=HarnessOptions.tool_timeout)
        if name in ("prepare", "validate"):
            sub.add_argument("--timeout", type=float, default=5)
        if name == "validate":
            sub.add_argument("--tokenizer", help="tokenizer file; without it, lengths are not checked")
            sub.add_argument("--max-tokens", type=int, default=1280)
    args = parser.parse_args(argv)
    spark = build()
    if args.command == "prepare":
        os.makedirs(args.output, exist_ok=True)
        sizes = {k.replace("-", "_"): getattr(args, k.replace("-", "_")) for k in SIZES}
        ids = {k: tuple(v) for k in PARTS if (v := getattr(args, f"{k}_ids"))}
        dataset.prepare(spark, args.tasks, args.output, timeout=args.timeout, validation=args.validation, test=args.test, ids=ids, **sizes)
        return
    if args.command == "validate":
        found = dataset.violations(spark, args.output, timeout=args.timeout, tokenizer_file=args.tokenizer, max_tokens=args.max_tokens).orderBy("name", "key", "detail")
        total = 0
        for r in found.toLocalIterator():
            print(json.dumps(r.asDict(), sort_keys=True))
            total += 1
        print(json.dumps({"violations": total}))
        sys.exit(1 if total else 0)
    if args.command == "replay":
        turns = spark.read.schema(TURN).json(args.turns)
        if args.arm:
            turns = same_arm(turns, HarnessOptions(arm=args.arm))
        done = replay.replay(turns, budget=args.max_tool_calls, timeout=args.tool_timeout)
        print(json.dumps({"records": write_records(replay.records(done, turns.select("trace", "arm").distinct()), args.output)}))
        return
    attempts = lambda p: load_traces(spark, p).select("task", F.col("solved").alias("passed"))
    if args.command == "passk":
        out = metrics.summarise(attempts(args.traces), args.k)
    elif args.command == "report":
        traces = load_traces(spark, args.traces)
        targets = traces.select(F.explode("targets").alias("t")).select("t.*")
        out = metrics.report(traces).join(metrics.f1_map(metrics.confusion(targets)))  # one row each
    elif args.command == "compare":
        out = metrics.compare(attempts(args.before), attempts(args.after), args.k)
    else:
        counts = stats.contingency(load_outcomes(spark, args.a), load_outcomes(spark, args.b))
        out = stats.mcnemar(counts).join(stats.bootstrap_ci(counts))
    print(json.dumps(json.loads(out.toJSON().first()), indent=2, sort_keys=True))


if __name__ == "__main__":
    main()
