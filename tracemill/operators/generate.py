"""The place where a model plugs in: prompts go out in Arrow batches, completions come back; everything about them is derived in columns."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import let, split_think, unclosed
from tracemill.operators.chat import FORCED_END
from tracemill.session import fresh_path
from tracemill.sources.commits import Log

RAW = "id string, raw string, gen_tokens int, gen_seconds double"
ROUND = f"{RAW}, attempt int"
NEAR = 2  # tokens by which a completion may miss its budget and still count as cut


class Generator(Protocol):
    """Called with the prompts of a batch and its token budget; returns as many dicts with raw, tokens and seconds. One that closes a thought at its budget does so by FORCED_END."""

    def __call__(self, prompts: list[str], system: str, max_tokens: int) -> list[dict]: ...


def load(name: str, **options: object) -> Callable[[], Generator]:
    """A factory named 'module:function'; it runs once in each worker, so a model is loaded there and only there. options (of decoding) that are None aren't passed on."""
    module, _, attribute = name.partition(":")
    given = {k: v for k, v in options.items() if v is not None}
    return lambda: getattr(importlib.import_module(module), attribute)(**given)


def recorded(answers: dict[str, str]) -> Callable[[], Generator]:
    """A generator that plays back completions by prompt, for tests."""
    return lambda: lambda prompts, system, max_tokens: [{"raw": answers.get(p, ""), "tokens": len(answers.get(p, "").split()), "seconds": 0.0} for p in prompts]


def state(raw: Column, pre_opened: Column | bool = False, tokens: Column | None = None, budget: Column | None = None, reserve: int | None = None) -> Column:
    """struct(answer, think, open, forced, truncated) of a raw completion.

    open: its thought never ends. forced: the thought was open where FORCED_END
    stands, and (if they are given) the tokens had reached the budget less the
    reserve for the answer; never without a reserve. truncated: there is no
    answer, be it that the thought is open or that nothing follows it.
    """

    def of(r: Column) -> Column:
        parts = split_think(r, pre_opened)
        forced = F.contains(r, F.lit(FORCED_END)) & unclosed(F.substring_index(r, FORCED_END, 1), pre_opened)
        if reserve is not None:
            forced = forced & F.lit(reserve > 0) & (tokens >= budget - reserve - NEAR if tokens is not None and budget is not None else F.lit(True))
        return let(parts, lambda p: F.struct(p["answer"].alias("answer"), p["think"].alias("think"), unclosed(r, pre_opened).alias("open"), forced.alias("forced"), (p["answer"] == "").alias("truncated")))

    return let(raw, of)


def raw_completions(rows: DataFrame, factory: Callable[[], Generator], system: str | Column, budget: Column, prompt: str = "prompt") -> DataFrame:
    """rows(id, prompt, ...) -> (id, raw, gen_tokens, gen_seconds). Prompts of one call share their system prompt and budget."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            for (most, instruction), part in frame.groupby(["budget", "system"]):
                out = model(list(part["prompt"]), instruction, int(most))
                yield pd.DataFrame({"id": list(part["id"]), "raw": [x["raw"] for x in out], "gen_tokens": [x["tokens"] for x in out], "gen_seconds": [round(x["seconds"], 2) for x in out]})

    instruction = F.lit(system) if isinstance(system, str) else system
    return rows.select("id", F.col(prompt).alias("prompt"), budget.cast("int").alias("budget"), instruction.alias("system")).mapInPandas(run, RAW)


DERIVED = ("raw", "answer", "think", "truncated", "forced", "gen_tokens", "gen_seconds")


def completed(rows: DataFrame, raw: DataFrame, budget: Column, pre_opened: bool = False, reserve: int | None = None) -> DataFrame:
    """rows with their raw completion and what follows from it."""
    bare = rows.drop(*DERIVED)
    both = bare.withColumn("__budget", budget).join(raw, "id").withColumn("__s", state(F.col("raw"), pre_opened, F.col("gen_tokens"), F.col("__budget"), reserve))
    return both.select(*bare.columns, "raw", "gen_tokens", "gen_seconds", "__s.answer", "__s.think", "__s.truncated", "__s.forced")


def generate(rows: DataFrame, factory: Callable[[], Generator], system: str | Column, budget: Column, prompt: str = "prompt", pre_opened: bool = False, reserve: int | None = None) -> DataFrame:
    """rows(id, prompt, ...) with raw, answer, think, truncated, forced, gen_tokens and gen_seconds. reserve: the part of the budget that a generator keeps for the answer."""
    return completed(rows, raw_completions(rows, factory, system, budget, prompt), budget, pre_opened, reserve)


def escalated(rows: DataFrame, factory: Callable[[], Generator], system: str | Column, budget: Column, retries: int, stuck: Column, always: bool, prompt: str = "prompt", log: Log | None = None, per_commit: int = 100_000, commits: int | None = None) -> DataFrame:
    """As generate(), and what is stuck is asked again, each time with half as much budget more. A retry takes the row's place: always, or only if it isn't truncated itself.

    Every answer is committed to a log (of ROUND rows), about `per_commit`
    prompts at a time, so a job that is killed and started again with the same
    log asks only what no commit holds: within a round, and in later rounds.
    Without a log a fresh one is made. commits: stop after so many (None: never).
    """
    log = log or Log(rows.sparkSession, fresh_path(rows.sparkSession, "rounds"), ROUND)
    for attempt in range(retries + 1):
        due = rows if attempt == 0 else _current(rows, log, budget, always).where(stuck).select(*rows.columns)
        todo = due.join(log.read().where(F.col("attempt") == attempt).select("id"), "id", "left_anti")
        slices = -(-todo.count() // per_commit)
        for k in range(slices):
            if commits is not None and len(log.names()) >= commits:
                return _current(rows, log, budget, always)
            part = todo.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
            asked = raw_completions(part, factory, system, budget if attempt == 0 else retry_budget(budget, F.lit(attempt - 1)), prompt)
            log.append(asked.withColumn("attempt", F.lit(attempt)))
    return _current(rows, log, budget, always)


def _current(rows: DataFrame, log: Log, budget: Column, always: bool) -> DataFrame:
    """rows that have an answer, with the one that counts so far."""
    attempt = F.col("attempt")
    counts = F.when(F.lit(always) | (attempt == 0) | ~state(F.col("raw"))["truncated"], attempt).otherwise(-1)
    last = log.read().groupBy("id").agg(F.max_by(F.struct("raw", "gen_tokens", "gen_seconds"), counts).alias("r")).select("id", "r.*")
    return completed(rows, last, budget)


def retry_budget(base: Column, attempt: Column) -> Column:
    """Tokens of a retry: 1.5 times more with each attempt, cut to an integer."""
    return F.floor(base * F.pow(F.lit(1.5), attempt + 1)).cast("long")


def retried(rows: DataFrame, again: DataFrame, keep_if_cut: bool) -> DataFrame:
    """Rows with their retry in place: always, or only if the retry isn't truncated itself."""
    ok = again if keep_if_cut else again.where(~F.col("truncated"))
    return rows.join(ok.select("id"), "id", "left_anti").unionByName(ok)


def sized(rows: DataFrame, budgets: dict[str, int], key: str = "kind") -> Column:
    """The budget of a row by its kind, else the default, else 2048."""
    table = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]) if budgets else F.create_map()
    return F.coalesce(F.try_element_at(table, F.col(key)), F.lit(budgets.get("default", 2048))) if budgets else F.lit(2048)
