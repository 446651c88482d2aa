"""A project's files in memory, and the agents' tools on them."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field

from trailspark.operators.execution import run_tests

#: Where a project's prefix is looked up, as a working directory.
HERE = "/work"
#: Characters that a read gives back.
READ_CHARS = 8000

RESULT = "struct<id:string,success:boolean,stdout:string,stderr:string,exit_code:int,timed_out:boolean,outcome:string>"


@dataclass
class Result:
    """What a tool gives; only tests have an outcome class."""

    success: bool
    stdout: str = ""
    stderr: str = ""
    exit_code: int = 0
    timed_out: bool = False
    outcome: str | None = None

    def block(self, call_id: str) -> str:
        """The text that the agent reads."""
        parts = [("status", " success" if self.success else " failed"), *([("timed_out", " true")] if self.timed_out else []), *((n, "\n" + t.strip()) for n, t in (("stdout", self.stdout), ("stderr", self.stderr)) if t)]
        return "\n".join([f"RESULT {call_id}:", *(f"{n}:{t}" for n, t in parts)])


def failed(why: str) -> Result:
    return Result(False, stderr=why, exit_code=-1)


@dataclass
class Workspace:
    """``files`` by their path below ``prefix``; nothing outside of it can be named."""

    tests: str
    files: dict[str, str] = field(default_factory=dict)
    prefix: str = "data/blueprints/task"
    timeout: float = 5
    #: What runs (code, tests, timeout), as ``run_tests`` does.
    run: Callable[[str, str, float], dict] = run_tests

    @property
    def root(self) -> str:
        return posixpath.normpath(posixpath.join(HERE, self.prefix))

    def inside(self, name: str) -> str:
        """The path below the root that a name means: from the working directory if that is inside, else from the root."""
        for base in (HERE, self.root):
            path = posixpath.normpath(posixpath.join(base, name))
            if path == self.root:
                return "."
            if path.startswith(self.root + "/"):
                return path[len(self.root) + 1 :]
        raise ValueError(f"{name!r} is outside of the project")

    def folder(self, path: str) -> bool:
        return path == "." or any(f.startswith(path + "/") for f in self.files)

    def existing(self, name: str) -> str:
        path = self.inside(name)
        if path not in self.files and not self.folder(path):
            raise FileNotFoundError(f"{name!r} does not exist")
        return path

    def file(self, name: str) -> str:
        path = self.existing(name)
        if path not in self.files:
            raise IsADirectoryError(f"{name!r} is a folder")
        return path

    def read_file(self, params: dict[str, str]) -> Result:
        return Result(True, self.files[self.file(params.get("file_path", ""))][:READ_CHARS])

    def apply_patch(self, params: dict[str, str]) -> Result:
        path = self.file(params.get("file_path", ""))
        find, new = params.get("find"), params.get("replace")
        if find is None or new is None:
            return failed("apply_patch needs file_path, find, replace")
        times = self.files[path].count(find)
        if times != 1:
            return failed(f"find must occur exactly once; found {times}")
        self.files[path] = self.files[path].replace(find, new)
        return Result(True, "patch applied")

    def python_test(self, params: dict[str, str]) -> Result:
        folder = self.existing(params.get("project_path", "."))
        return self.test(folder)

    def test(self, folder: str = ".") -> Result:
        code = self.files.get(posixpath.normpath(posixpath.join(folder, "solution.py")))
        if code is None:
            return Result(False, stderr="solution.py not found", exit_code=-1, outcome="OTHER")
        run = self.run(code, self.tests, self.timeout)
        told = {"stdout" if run["success"] else "stderr": f"tests timed out after {self.timeout:g}s" if run["timed_out"] else run["detail"]}
        return Result(run["success"], exit_code=run["exit_code"], timed_out=run["timed_out"], outcome=run["outcome"], **told)

    def call(self, tool: str, params: dict[str, str]) -> Result:
        run = {"read_file": self.read_file, "apply_patch": self.apply_patch, "python_test": self.python_test}.get(tool)
        if run is None:
            return failed(f"unknown tool: {tool}")
        try:
            return run(params)
        except (OSError, ValueError) as e:
            return failed(f"tool error: {e}")
