"""Rendering of chat transcripts, loss masks, length caps and task prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import text as T

START, END = "<|im_start|>", "<|im_end|>"


def messages_of(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(key, messages) in turn order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render_message(role: Column, content: Column) -> Column:
    """One ChatML block; an empty role gives nothing."""
    block = F.concat(F.lit(START), role, F.lit("\n"), T.rstrip(F.coalesce(content, F.lit(""))), F.lit("\n" + END + "\n\n"))
    return F.when(F.coalesce(role, F.lit("")) == "", F.lit("")).otherwise(block)


def render(messages: Column, generation_prompt: bool = False) -> Column:
    body = F.array_join(F.transform(messages, lambda m: render_message(m["role"], m["content"])), "")
    return F.concat(body, F.lit(f"{START}assistant\n")) if generation_prompt else body


def role_mask(messages: Column) -> Column:
    """Which messages are trained on: the assistant's."""
    return F.transform(messages, lambda m: m["role"] == "assistant")


def ends_final(messages: Column) -> Column:
    last = F.try_element_at(messages, F.lit(-1))
    return F.coalesce((last["role"] == "assistant") & F.startswith(T.strip(last["content"]), F.lit("FINAL:")), F.lit(False))


def count_words(text: Column) -> Column:
    """Length by the blank-separated tokenizer that tests use."""
    return F.regexp_count(text, F.lit(r"\S+"))


def count_tokens(text: Column, tokenizer_file: str) -> Column:
    """Length by a tokenizer file, which each Python worker loads once."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_file)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in model.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count(text)


def length_audit(rows: DataFrame, cap: int, *, key: str = "case_id", tokens: str = "tokens", final: str = "final") -> DataFrame:
    """One row: rows, over the cap, without FINAL, the longest and its first key."""
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(tokens) > cap).alias("over_cap"), F.count_if(~F.col(final)).alias("missing_final"),
        F.max(tokens).cast("long").alias("longest"), F.min_by(key, F.struct(-F.col(tokens), F.col(key))).alias("longest_case"),
    )


def truncation_reason(truncated: Column, branch_lengths: Column, cap: int = 4096) -> Column:
    longest = F.coalesce(F.array_max(branch_lengths), F.lit(0))
    return F.when(F.coalesce(truncated, F.lit(False)), "truncated").when(longest > cap, F.concat(F.lit("trace has "), longest.cast("string"), F.lit(" tokens")))


def node_offsets(nodes: DataFrame, branch: str, node: str, size: str) -> DataFrame:
    """``nodes`` with the tokens before each in its branch."""
    before = F.sum(size).over(Window.partitionBy(branch).orderBy(node).rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


#: System prompts of the arms.
SYSTEMS = {"a": "Work step by step.", "b": "State the outcome, decide, then act."}


def task_prompt(prompt: Column, tests: Column, prefix: Column, arm: Column, system_a: str, system_b: str) -> Column:
    """System and user message of a task."""
    # The user's words.
    user = F.concat(
        F.lit("Implement the requested Python function in solution.py. Run the tests.\n\n"), prompt, F.lit("\n\nYour code must pass these tests:\n"), T.rstrip(tests),
        F.lit("\n\nThe project is at "), prefix, F.lit("."),
    )
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.when(arm == "a", system_a).otherwise(system_b)), message("user", user))


def task_rows(tasks: DataFrame, arms=("a", "b"), system_a: str = SYSTEMS["a"], system_b: str = SYSTEMS["b"]) -> DataFrame:
    """A row per task and arm; tasks have task_id, case_id, prompt, test_code, split.  Narrow: no shuffle."""
    rows = tasks.withColumn("arm", F.explode(F.array(*(F.lit(a) for a in arms))))
    root = F.concat(F.lit("blueprints/"), F.col("case_id"))
    prefix = F.concat(F.lit("data/"), root)
    return rows.select(
        "arm", root.alias("blueprint_root"), "case_id", task_prompt(F.col("prompt"), F.col("test_code"), prefix, F.col("arm"), system_a, system_b).alias("prompt"),
        F.lit("mbpp").alias("source"), "split", "task_id", "test_code", prefix.alias("trace_prefix"),
    )


def normalise_tasks(rows: DataFrame, prefix: str = "mbpp_") -> DataFrame:
    """Source rows to tasks: line ends, setup and tests joined; a task without prompt, code or tests fails."""
    tests = F.filter(F.transform(F.coalesce("test_list", F.array().cast("array<string>")), T.newlines), lambda x: x != "")
    out = rows.select(
        "task_id", F.concat(F.lit(prefix), F.col("task_id").cast("string")).alias("case_id"), T.newlines("text").alias("prompt"), T.newlines("code").alias("code"), T.newlines("test_setup_code").alias("setup"), tests.alias("tests")
    )
    whole = (F.col("prompt") != "") & (F.col("code") != "") & (F.size("tests") > 0)
    failed = F.raise_error(F.concat("case_id", F.lit(": task without content"))).cast("string")
    joined = F.array_join(F.filter(F.array_prepend("tests", F.col("setup")), lambda x: x != ""), "\n")
    return out.select(
        "task_id", F.when(whole, F.col("case_id")).otherwise(failed).alias("case_id"), "prompt", F.concat("code", F.lit("\n")).alias("code"), F.concat(joined, F.lit("\n")).alias("test_code")
    )
