"""Python code in answers: parsing, and running tests in a separate process. The only Python functions among the reference operators."""

from __future__ import annotations

import ast
import contextlib
import os
import resource
import signal
import subprocess
import sys
import tempfile
import time
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import extract_code
from tracemill.session import stored

LIMIT_S, STDERR_CHARS, MEMORY = 10.0, 2000, 1 << 30


def _parses(code: str | None) -> bool:
    if not code or not code.strip():
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _parse_series(codes: pd.Series) -> pd.Series:
    return codes.map(_parses).astype(bool)


def parses(answer: Column) -> Column:
    """Whether the answer's code block is valid Python."""
    return F.pandas_udf(_parse_series, "boolean")(extract_code(answer))


def run_program(program: str, timeout: float = LIMIT_S) -> tuple[bool, str]:
    """Whether a program ends without an error, and the end of what it wrote to stderr ("timeout" if it had to be stopped).

    It runs in a folder and a process group of its own, with limits on CPU time,
    memory and file size; what it prints goes to files under that limit. When it
    ends or its time is up, everything left of its group is killed, so
    processes that it started don't outlive it (unless they leave the group on
    purpose). Process isolation, not a sandbox: run it on machines without secrets.
    """

    def limits() -> None:
        resource.setrlimit(resource.RLIMIT_CPU, (int(timeout) + 1,) * 2)
        resource.setrlimit(resource.RLIMIT_AS, (MEMORY,) * 2)
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 24,) * 2)

    with tempfile.TemporaryDirectory() as folder, tempfile.TemporaryFile() as said:
        p = subprocess.Popen([sys.executable, "-I", "-c", program], cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=said, start_new_session=True, preexec_fn=limits, env={"PATH": os.environ.get("PATH", ""), "TMPDIR": folder})
        until, ended = time.monotonic() + timeout, False
        while not ended and (left := until - time.monotonic()) > 0:
            # seen to end, but not reaped yet: its number still names its group
            ended = os.waitid(os.P_PID, p.pid, os.WEXITED | os.WNOWAIT | os.WNOHANG) is not None
            if not ended:
                time.sleep(min(0.01, left))
        with contextlib.suppress(ProcessLookupError, PermissionError):
            os.killpg(p.pid, signal.SIGKILL)
        p.wait()
        if not ended:
            return False, "timeout"
        size = said.seek(0, os.SEEK_END)
        said.seek(max(0, size - 4 * STDERR_CHARS))
        return p.returncode == 0, said.read().decode("utf-8", "replace")[-STDERR_CHARS:]


def program_of(answer: Column, setup: Column, tests: Column, preamble: Column) -> Column:
    """Preamble, the answer's code, setup, and tests, in this order."""
    empty = F.lit("")
    return F.concat_ws("\n", F.coalesce(preamble, empty), extract_code(F.coalesce(answer, empty)), F.coalesce(setup, empty), F.array_join(F.coalesce(tests.cast("array<string>"), F.array().cast("array<string>")), "\n"))


def executed(rows: DataFrame, program: str = "program", enabled: bool = False, timeout: float = LIMIT_S, slots: int = 4) -> DataFrame:
    """rows with passed and error (the end of stderr, or "timeout") of the program in a column.

    Equal programs run once, whichever rows hold them; the distinct ones are
    dealt evenly over all partitions by hash, and a task runs `slots` of them at
    a time, each within its own time, so a slow one holds one slot for that long
    and nothing else. Results are stored, since they are what cost. Running
    untrusted code must be asked for. A null program isn't run: both are null.
    """
    if not enabled:
        raise PermissionError("running code from answers is off; pass enabled=True on machines that may run it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(slots) as pool:
            for b in batches:
                for lo in range(0, len(b), 64 * slots):
                    part = b.slice(lo, 64 * slots)
                    found = list(pool.map(lambda x: run_program(x, timeout), part.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ok for ok, _ in found], pa.bool_()), pa.array([e for _, e in found], pa.string())], names=["__key", "passed", "error"])

    keyed = rows.drop("passed", "error").withColumn("__key", F.sha2(F.col(program), 256))
    distinct = keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.any_value(program).alias("program"))
    done = stored(distinct.repartition(F.col("__key")).mapInArrow(run, "__key string, passed boolean, error string"), "programs")
    return keyed.join(done, "__key", "left").drop("__key")


def why(error: Column) -> Column:
    """The last line of what a program said, or ok."""
    lines = F.filter(F.split(error, "\n"), lambda x: x != "")
    return F.concat(F.lit("code:"), F.coalesce(F.substring(F.try_element_at(lines, F.lit(-1)), 1, 60), F.lit("ok")))


def run_tests(rows: DataFrame, enabled: bool = False) -> DataFrame:
    """rows(id, answer, gold) -> (id, passed, why)."""
    made = rows.select("id", program_of(F.col("answer"), F.col("gold.setup"), F.col("gold.tests"), F.col("gold.preamble")).alias("program")) if enabled else None
    return executed(made, enabled=enabled).select("id", "passed", why(F.col("error")).alias("why"))
