"""Code execution: outcome runner, mutations, recoveries, protocol replay.

Candidates run in a process of their own session with a bare environment, a
time limit and a group kill.  This is isolation from accidents, not a sandbox.
"""

from __future__ import annotations

import io
import os
import secrets
import subprocess
import sys
import tempfile
import tokenize
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.protocol import FAILURE_TEXT, STDERR_MARKS
from trailspark.session import cut

RUN = "success boolean, outcome string, exit_code int, timed_out boolean, detail string"

# Token replacements of the mutation operator.
REPLACEMENTS = {
    "<=": "<", ">=": ">", "==": "!=", "!=": "==", "+": "-", "-": "+", "*": "+",
    "and": "or", "or": "and", "min": "max", "max": "min", "True": "False", "False": "True",
}
_SKIPPED = ("def ", "import ", "from ")


def classify(stderr: str) -> str:
    return next((outcome for outcome, marks in STDERR_MARKS if any(m in stderr for m in marks)), "OTHER")


#: A fresh interpreter that forks a process for each request on its standard input: no candidate waits for an interpreter
#: to start, and none meets what another left.  The process has a session, folder and environment of its own, executes the
#: files in one namespace, and sends the receipt down its own pipe only if all of them came to their end; its exit is the
#: interpreter's, whose taking apart is spared where the program leaves no thread or exit function.  The server ends its
#: group when it is done or late, and replies with its exit code and what it said.
_SERVER = """
import atexit, gc, os, select, signal, sys, time, traceback  # what tells of an exception, loaded once

def child(home, ends):
    os.setsid()
    null = os.open(os.devnull, os.O_RDWR)
    for old, new in ((null, 0), (null, 1), (ends[1], 2)):
        os.dup2(old, new)
    for end in (null, *ends[:3]):
        os.close(end)
    os.chdir(home)
    os.environ["HOME"] = home

def watch(pid, timeout, said):
    # standard error to its end and the exit, or None if one of them is late
    until, text, open_ = time.monotonic() + timeout, [], {said, os.pidfd_open(pid)}
    exited = max(open_ - {said})
    poll = select.poll()
    for end in open_:
        poll.register(end, select.POLLIN)
    while open_ and (left := until - time.monotonic()) > 0:
        for end, _ in poll.poll(left * 1000):
            if end == said and (more := os.read(said, 1 << 16)):
                text.append(more)
            else:
                poll.unregister(end)
                open_.discard(end)
    os.close(exited)
    try:
        os.killpg(pid, signal.SIGKILL)  # not waited for yet, so the number is still its own
    except OSError:
        pass
    code = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
    return None if open_ else code, b"" if open_ else b"".join(text)

def serve():
    # only a forked process comes back
    rest = b""
    while True:
        while b"\\n" not in rest:
            more = os.read(0, 1 << 16)
            if not more:
                os._exit(0)
            rest += more
        line, _, rest = rest.partition(b"\\n")
        receipt, timeout, home, *files = line.decode().split("\\t")
        said, theirs = os.pipe()
        back, pipe = os.pipe()
        pid = os.fork()
        if not pid:
            child(home, (said, theirs, back))
            return receipt, pipe, files
        os.close(theirs)
        os.close(pipe)
        code, text = watch(pid, float(timeout), said)
        os.set_blocking(back, False)  # a process that got away may hold the other end
        try:
            got = os.read(back, 100) == receipt.encode()
        except BlockingIOError:
            got = False
        os.close(said)
        os.close(back)
        reply = f"{'late' if code is None else code} {int(got)} {len(text)}\\n".encode() + text
        while reply:
            reply = reply[os.write(1, reply):]

gc.collect()
gc.freeze()
known = atexit._ncallbacks()
receipt, pipe, files = serve()
space, code = {"__name__": "__main__"}, 0
try:
    for program in [compile(open(f, "rb").read(), os.path.basename(f), "exec") for f in files]:
        exec(program, space)
    os.write(pipe, receipt.encode())
except Exception:
    code = 1
    sys.excepthook(*sys.exc_info())
if len(sys._current_frames()) == 1 and atexit._ncallbacks() == known:
    del space  # its objects end while they still see their names
    gc.collect()
    for stream in (sys.stdout, sys.stderr):
        if stream is not None and not stream.closed:
            stream.flush()
    os._exit(code)
sys.exit(code)
"""


class _Server:
    """The server of one process; it ends when that process does."""

    def __init__(self):
        self.owner = os.getpid()
        env = {"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "LANG": "C.UTF-8", "HOME": "/", "PYTHONDONTWRITEBYTECODE": "1"}
        self.process = subprocess.Popen([sys.executable, "-c", _SERVER], cwd="/", env=env, start_new_session=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def run(self, timeout: float, home: str, files: list[str]) -> tuple[int | None, str, bool]:
        """(exit code or None if it was late, standard error, whether the receipt came back)."""
        self.process.stdin.write("\t".join([secrets.token_hex(16), str(timeout), home, *files]).encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            raise RuntimeError("a candidate ended the process that runs candidates")
        said = self.process.stdout.read(int(head[2]))
        return None if head[0] == b"late" else int(head[0]), said.decode("utf-8", "replace"), head[1] == b"1"

    def end(self) -> None:
        self.process.kill()
        self.process.communicate()


_server: _Server | None = None


def _execute(files: dict[str, str], timeout: float) -> tuple[int | None, str, bool]:
    """Run the files as one program by this process's server, in a folder of their own."""
    global _server
    if _server is None or _server.owner != os.getpid():  # a forked worker has its own
        _server = _Server()
    with tempfile.TemporaryDirectory() as home:
        paths = [Path(home, name) for name in files]
        for path, text in zip(paths, files.values(), strict=True):
            path.write_text(text, encoding="utf-8", errors="surrogatepass")
        try:
            return _server.run(timeout, home, [str(p) for p in paths])
        except BaseException:
            _server.end()
            _server = None
            raise


def run_tests(code: str | None, tests: str | None, timeout: float = 5) -> dict:
    """Run code, then tests, as one program: a pass needs exit code 0 and the receipt."""
    exit_code, said, receipt = _execute({"solution.py": code or "", "tests.py": tests or ""}, timeout)
    outcome = "TIMEOUT" if exit_code is None else "PASS" if exit_code == 0 and receipt else classify(said)
    return {
        "success": outcome == "PASS", "outcome": outcome, "exit_code": -1 if exit_code is None else exit_code, "timed_out": exit_code is None,
        "detail": "tests passed" if outcome == "PASS" else FAILURE_TEXT[outcome],
    }


def verify(candidates: DataFrame, *, code: str = "code", tests: str = "test_code", timeout: float = 5) -> DataFrame:
    """``candidates`` with the struct ``run``.  Equal (code, tests) run once: they meet by content hash."""
    keyed = candidates.withColumn("__hash", F.sha2(F.concat_ws("\0", F.coalesce(code, F.lit("")), F.coalesce(tests, F.lit(""))), 256))
    distinct = keyed.select("__hash", F.col(code).alias("c"), F.col(tests).alias("t")).dropDuplicates(["__hash"])

    def execute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            runs = pd.DataFrame([run_tests(c, t, timeout) for c, t in zip(rows["c"], rows["t"], strict=True)], columns=[x.split()[0] for x in RUN.split(", ")])
            yield pd.concat([rows[["__hash"]].reset_index(drop=True), runs], axis=1)

    width = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by another key than the duplicates meet by: else that exchange does for both, and adaptive execution makes one task of these small rows
    done = distinct.repartition(width, F.substring("__hash", 1, 16)).mapInPandas(execute, f"__hash string, {RUN}")
    return keyed.join(done.select("__hash", F.struct("success", "outcome", "exit_code", "timed_out", "detail").alias("run")), "__hash").drop("__hash")


def failing_gold(tasks: DataFrame, **options) -> DataFrame:
    """Tasks whose own solution does not pass: empty if all is well."""
    return verify(tasks, **options).where("run.outcome <> 'PASS'")


class _Source:
    """A program by its lines, and which of them an edit may touch."""

    def __init__(self, code: str):
        self.code = code
        self.lines = code.splitlines(keepends=True)
        self.times = Counter(self.lines)
        self.starts = [0, *accumulate(map(len, self.lines))]

    def open_to_edits(self, row: int) -> bool:
        return row < len(self.lines) and self.times[self.lines[row]] == 1 and not self.lines[row].lstrip().startswith(_SKIPPED)

    def edited(self, row: int, span: tuple[int, int], word: str) -> tuple[str, str]:
        """The new line and the new program."""
        at, to = (self.starts[row] + x for x in span)
        whole = self.code[:at] + word + self.code[to:]
        return whole[self.starts[row] : self.starts[row + 1] + len(whole) - len(self.code)], whole


def _edits(code: str) -> Iterator[tuple[int, tuple[int, int], str]]:
    """(row, columns, new word) of every token of one line that has a replacement."""
    for kind, word, (row, left), (last, right), _ in tokenize.generate_tokens(io.StringIO(code).readline):
        if kind == tokenize.NUMBER and word.isdigit():
            word = str(int(word) + 1)
        elif (word := REPLACEMENTS.get(word)) is None:
            continue
        if row == last:
            yield row - 1, (left, right), word


def mutate(code: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, before, after, mutated code) of single-token changes in token order.

    Lines that define or import, that occur more than once, and changes that give
    a line the code already has are left out.  Code that cannot be tokenized is an
    error.
    """
    source = _Source(code)
    for row, span, word in _edits(code):
        if source.open_to_edits(row):
            line, whole = source.edited(row, span, word)
            if line not in source.times:
                yield row, source.lines[row], line, whole


def apply_edit(code: str, row: int, before: str, after: str) -> str:
    """``code`` with a line replaced; an error if the line is not what it was."""
    lines = code.splitlines(keepends=True)
    if not 0 <= row < len(lines) or lines[row] != before:
        raise ValueError(f"line {row} is no longer {before!r}")
    return "".join([*lines[:row], after, *lines[row + 1 :]])


def mutations(tasks: DataFrame, *, key: str = "case_id", code: str = "code") -> DataFrame:
    """(key, position, line, original, changed, mutated, unique): a row per mutation; unique if the changed line occurs once."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, c in zip(rows["k"], rows["c"], strict=True):
                try:
                    out += [(k, i, *m, m[3].count(m[2]) == 1) for i, m in enumerate(mutate(c or ""))]
                except (tokenize.TokenError, SyntaxError) as e:
                    raise ValueError(f"{k}: code cannot be tokenized: {e}") from e
            yield pd.DataFrame(out, columns=["key", "position", "line", "original", "changed", "mutated", "unique"])

    schema = "key string, position int, line int, original string, changed string, mutated string, unique boolean"
    return tasks.select(F.col(key).alias("k"), F.col(code).alias("c")).mapInPandas(expand, schema).withColumnRenamed("key", key)


FIRST_WAVE = 2


def candidates(tasks: DataFrame, *, key: str = "case_id") -> DataFrame:
    """The mutations that are tried, with ``turn``, their number among a task's from 1: those whose changed line occurs once."""
    usable = mutations(tasks, key=key).where("unique").drop("unique")
    return usable.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("position")))  # as many as a program has tokens


def run_until(tasks: DataFrame, answers: Callable[[DataFrame], DataFrame], *, key: str = "case_id", timeout: float = 5, first: int = FIRST_WAVE) -> DataFrame:
    """The runs of each task's mutations, in turn, up to its answer: key, position, turn, line, original, changed, mutated, outcome.

    ``answers`` gives the keys of the tasks that the runs so far settle, from all
    runs that failed.  A wave runs the next few mutations of the tasks that are
    still open, twice as many in all as the waves before, so a task whose answer
    comes with its ``n``-th run has at most ``max(first, 2 n)``.  Waves meet tasks by
    an anti-join; a wave's runs are written, so none is run again.
    """
    tried = cut(candidates(tasks, key=key))
    open_ = cut(tried.select(key).distinct())
    waves, done, size = [], 0, first
    while not open_.isEmpty():
        wave = tried.where(F.col("turn").between(done + 1, done + size)).join(open_, key, "left_semi").join(tasks.select(key, "test_code"), key)
        ran = verify(wave, code="mutated", timeout=timeout).withColumn("outcome", F.col("run.outcome")).drop("run", "test_code")
        waves.append(cut(ran))
        done, size = done + size, done + size
        runs = reduce(DataFrame.unionByName, waves)
        settled = answers(runs.where(FAILED)).select(key)
        open_ = cut(tried.where(F.col("turn") > done).select(key).distinct().join(open_, key, "left_semi").join(settled, key, "left_anti"))
    if not waves:
        return tried.withColumn("outcome", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, waves)


FAILED = "outcome <> 'PASS'"


def first_failures(failing: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, initial_code, find, replace, outcome): the first mutation that fails, and the patch that undoes it."""
    first = F.min_by(F.struct("mutated", "changed", "original", "outcome"), "position").alias("m")
    return failing.groupBy(key).agg(first).select(
        key, F.col("m.mutated").alias("initial_code"), F.col("m.changed").alias("find"), F.col("m.original").alias("replace"), F.col("m.outcome").alias("outcome")
    )


def chained_failures(failing: DataFrame, key: str = "case_id") -> DataFrame:
    """First failing mutation A, then the first later failing B.

    The middle patch turns A's code into B's by the block of lines from one to
    the other (the line itself if both are on one), which must occur once in A's
    code and differ from B's; the final patch undoes B.
    """
    rank = Window.partitionBy(key).orderBy("position")
    ranked = failing.withColumn("rank", F.row_number().over(rank))
    a = ranked.where("rank = 1").select(key, *(F.col(c).alias(f"a_{c}") for c in ("position", "line", "mutated", "outcome")))
    pairs = ranked.join(a, key).where("position > a_position")
    low, high = F.least("line", "a_line"), F.greatest("line", "a_line")
    block = lambda c: F.array_join(F.slice(F.split(c, r"(?<=\n)"), low + 1, high - low + 1), "")
    built = pairs.withColumn("middle_find", block(F.col("a_mutated"))).withColumn("middle_replace", block(F.col("mutated")))
    n = lambda text, find: (F.length(text) - F.length(F.replace(F.col(text), F.col(find)))) / F.length(find)
    ok = built.where((n("a_mutated", "middle_find") == 1) & (F.col("middle_find") != F.col("middle_replace")))
    first = F.min_by(F.struct("a_mutated", "a_outcome", "middle_find", "middle_replace", "mutated", "outcome", "changed", "original"), "position").alias("m")
    return ok.groupBy(key).agg(first).select(
        key, F.col("m.a_mutated").alias("initial_code"), F.col("m.a_outcome").alias("first_outcome"), "m.middle_find", "m.middle_replace",
        F.col("m.outcome").alias("second_outcome"), F.col("m.changed").alias("final_find"), F.col("m.original").alias("final_replace"),
    )


def one_step_recovery(tasks: DataFrame, *, key: str = "case_id", timeout: float = 5) -> DataFrame:
    """``first_failures`` of the tasks (key, code, test_code), each run up to its first failure."""
    return first_failures(run_until(tasks, lambda failing: first_failures(failing, key), key=key, timeout=timeout).where(FAILED), key)


def two_step_recovery(tasks: DataFrame, *, key: str = "case_id", timeout: float = 5) -> DataFrame:
    """``chained_failures`` of the tasks (key, code, test_code), each run up to its first chain."""
    return chained_failures(run_until(tasks, lambda failing: chained_failures(failing, key), key=key, timeout=timeout).where(FAILED), key)
