"""Command line over JSON-lines folders: check, prompts, teach, rollout, hedge, dataset, logits, pairs, eval, report, status.

python -m tracemill.cli --config run.json COMMAND

Models plug in by --generator module:factory (see operators.generate).
Training, fusing and quantizing are not part of this package.
"""

from __future__ import annotations

import argparse
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions.text import strip, tail
from tracemill.operators import chat, evals, report, sampling, selection
from tracemill.operators.generate import ROUND, escalated, generate, load, sized
from tracemill.operators.verify import verified
from tracemill.plans.curate import curate
from tracemill.session import Scratch, local_session
from tracemill.sources import files, jsonl, teacher_topk
from tracemill.sources.commits import Log
from tracemill.sources.lease import Lease
from tracemill.sources.prompts import pool
from tracemill.sources.settings import Settings, fingerprint, shared_vocabulary
from tracemill.sources.settings import load as load_config


class Run:
    def __init__(self, spark: SparkSession, config: dict) -> None:
        self.spark, self.config, self.out = spark, config, config["out_dir"].rstrip("/")
        self.cfg, self.keep = Settings(**config.get("settings", {})), Scratch()

    def at(self, name: str) -> str:
        """A path below the output folder, which may be on any file system of the session."""
        return f"{self.out}/{name}"

    def read(self, name: str, schema: str) -> DataFrame:
        there = files.exists(self.spark, self.at(name))
        return jsonl.scan(self.spark, self.at(name), schema) if there else self.spark.createDataFrame([], schema)

    def ordered(self, name: str, schema: str) -> DataFrame:
        """As read(), with the order in which records were appended."""
        if files.exists(self.spark, self.at(name)):
            return jsonl.scan_ordered(self.spark, [self.at(name)], schema, by_time=True, keep=self.keep)
        return self.spark.createDataFrame([], f"{schema}, file_order long, line_no long, number long")

    def tags(self) -> list[str]:
        """Evaluations that have a summary."""
        return [t for t in files.names(self.spark, self.at("eval")) if files.exists(self.spark, self.at(f"eval/{t}/summary"))]

    def traces(self) -> DataFrame:
        found = files.names(self.spark, self.at("teacher"))
        return reduce(DataFrame.unionByName, [self.read(f"teacher/{n}", schemas.TRACE) for n in found]) if found else self.spark.createDataFrame([], schemas.TRACE)

    def benchmark(self, skip: bool) -> DataFrame | None:
        return None if skip or "benchmark" not in self.config else self.spark.read.schema("item_id long, text string").json(self.config["benchmark"])

    # -- commands -------------------------------------------------------

    def prompts(self, a: argparse.Namespace) -> None:
        used = self.config.get("exclude_prompts")
        gone = self.spark.read.schema(schemas.PROMPT).json(used) if used else None
        parts = []
        for s in self.config["sources"]:
            if a.domain and s["domain"] not in a.domain:
                continue
            rows = self.spark.read.json(s["path"]) if s["path"].endswith("json") or s["path"].endswith("jsonl") else self.spark.read.parquet(s["path"])
            rows = rows if "idx" in rows.columns else sampling.group_ranks(rows.withColumn("__k", F.monotonically_increasing_id()), "__k", self.cfg.seed).withColumn("idx", F.col("rn") - 1).drop("rn", "__k")
            parts.append(pool(rows, s | ({"n": min(s["n"], a.limit)} if a.limit else {}), self.cfg.seed, gone))
        jsonl.overwrite(reduce(DataFrame.unionByName, parts), self.at("prompts"))

    def teach(self, a: argparse.Namespace) -> None:
        routed = selection.routes(self.read("prompts", schemas.PROMPT), {k: v["domains"] for k, v in self.cfg.teachers.items()}, "domain")
        for name in a.teacher or list(self.cfg.teachers):
            todo = selection.todo(routed.where(F.col("teacher") == name), self.read(f"teacher/{name}", schemas.TRACE))
            todo = todo.orderBy("id").limit(a.limit) if a.limit else todo
            rounds = self.rounds(f"teach-{name}")
            done = escalated(todo, load(a.generator), self.system(name), self.budget(todo, name), self.cfg.retries, F.col("truncated"), always=False, log=rounds)
            jsonl.append(done.withColumn("teacher_model", F.lit(self.cfg.teachers[name].get("path"))), self.at(f"teacher/{name}"))
            files.delete(self.spark, rounds.path)

    def rounds(self, name: str) -> Log:
        """What a killed run of the same name has been answered; it goes when the run's records are written."""
        return Log(self.spark, self.at(f"rounds/{name}"), ROUND)

    def system(self, teacher: str) -> Column:
        """The system prompt of each row: that of all experts, and the style of its domain."""
        styles = {d: s for d in self.cfg.teachers[teacher]["domains"] if (s := self.cfg.style_for(d, teacher))}
        table = F.create_map(*[F.lit(x) for kv in styles.items() for x in kv]).cast("map<string,string>")
        return F.concat_ws(" ", F.lit(chat.EXPERT_SYSTEM), F.try_element_at(table, F.col("domain")))

    def budget(self, rows: DataFrame, teacher: str) -> Column:
        """The tokens of the row's kind, or else what the teacher may use."""
        most = self.cfg.teachers[teacher].get("max_tokens")
        return sized(rows, {"default": most} | self.cfg.budgets if most else self.cfg.budgets)

    def rollout(self, a: argparse.Namespace) -> None:
        prompts = self.read("pool", schemas.TRACE)
        if not (a.triage_only or a.harvest_only):
            todo = selection.todo(prompts, self.read("rollouts", schemas.ROLLOUT))
            todo = todo.orderBy("id").limit(a.limit) if a.limit else todo
            done = verified(generate(todo, load(a.generator), chat.EXPERT_SYSTEM, sized(todo, self.cfg.budgets)), self.cfg, a.run_code)
            jsonl.append(done.select("id", "domain", "kind", F.col("ok").alias("correct"), "truncated", "forced", F.col("gen_tokens").alias("tokens"), "why", "answer", "think"), self.at("rollouts"))
        rolls = self.read("rollouts", schemas.ROLLOUT)
        if not a.harvest_only:
            selection.triage(rolls).orderBy("kind").show()
            failed = selection.failure_arm(prompts, rolls)
            jsonl.overwrite(failed, self.at("failure_arm"))
            jsonl.overwrite(selection.control_arm(rolls, failed.count(), self.cfg.seed).join(prompts, "id"), self.at("control_arm"))
        if not a.triage_only:
            selection.harvest_stats(rolls).orderBy("kind").show()
            jsonl.overwrite(selection.harvest(prompts, rolls), self.at("teacher/self"))

    def hedge(self, a: argparse.Namespace) -> None:
        todo = selection.reasks(self.traces(), self.cfg, self.read("teacher/hedge", schemas.TRACE))
        todo = todo.orderBy("id").limit(a.limit) if a.limit else todo
        todo = todo.drop("ok", "why", "raw", "answer", "think", "truncated", "forced", "gen_tokens", "gen_seconds")
        empty = strip(F.coalesce("answer", F.lit(""))) == ""
        done = verified(escalated(todo, load(a.generator), chat.EXPERT_SYSTEM, sized(todo, self.cfg.budgets), self.cfg.hedge_retries, empty, always=True, prompt="ask", log=(rounds := self.rounds("hedge"))), self.cfg)
        jsonl.append(done.where("ok").withColumn("source", F.lit("hedge")).drop("ask", "ok", "why"), self.at("teacher/hedge"))
        files.delete(self.spark, rounds.path)

    def dataset(self, a: argparse.Namespace) -> None:
        made = curate(self.traces(), self.benchmark(a.skip_decontam), self.cfg, run_code=a.run_code)
        jsonl.overwrite(made.train, self.at("train"))
        jsonl.overwrite(made.valid, self.at("valid"))
        print(jsonl.write_stats(made.stats, self.at("stats.json")))

    def pairs(self, a: argparse.Namespace) -> None:
        judged = selection.pair_reasons(self.traces(), self.ordered("rollouts", schemas.ROLLOUT), self.benchmark(a.skip_decontam), self.cfg, run_code=a.run_code)
        split = sampling.split(selection.pairs(judged), "id", self.cfg.seed, self.cfg.valid_frac)
        for part in ("train", "valid"):
            jsonl.overwrite(split.where(F.col("part") == part).drop("part", "rn"), self.at(f"pairs-{part}"))
        print(jsonl.write_stats(selection.pair_stats(judged), self.at("pairs-stats.json")))

    def eval(self, a: argparse.Namespace) -> None:
        folder = f"eval/{a.tag or a.model}"
        with Lease(self.spark, self.at(f"{folder}/.lease"), 86400.0) as lease:
            for name in a.benchmark or self.config["benchmarks"]:
                items = self.spark.read.schema(schemas.PROMPT).json(self.config["benchmarks"][name])
                items = sampling.sample(items, "id", self.cfg.seed, a.sample) if a.sample else items
                items = items.orderBy("id").limit(a.limit) if a.limit else items
                todo = selection.todo(items, self.read(f"{folder}/{name}", schemas.EVAL))
                budget, temp = a.max_tokens or self.cfg.eval_budget_for(name), self.cfg.eval_temp if a.temp is None else a.temp
                options = {"force_budget": a.force_budget, "temp": temp, "rep_penalty": a.rep_penalty, "think_bias": a.think_bias}
                done = verified(generate(todo, load(a.generator, **options), chat.EVAL_SYSTEM, F.lit(budget), reserve=a.force_budget or 0), self.cfg, a.run_code)
                think = F.coalesce("think", F.lit(""))
                kept = F.when(F.col("truncated"), tail(think)).otherwise("")
                lease.check()
                jsonl.append(done.select("id", F.col("ok").alias("correct"), F.col("answer").alias("output"), "truncated", "forced", F.char_length(think).alias("think_chars"), kept.alias("think_tail"), F.col("gen_tokens").alias("tokens"), F.col("gen_seconds").alias("seconds"), "meta"), self.at(f"{folder}/{name}"))
                records = selection.one_per_key(self.ordered(f"{folder}/{name}", schemas.EVAL), "id", F.desc("file_order"), F.desc("line_no")).join(items.select("id"), "id", "left_semi")
                decode = {k: str(v) for k, v in options.items() if v is not None and k in ("rep_penalty", "think_bias")}
                run = {"benchmark": name, "model": a.tag or a.model, "think": self.cfg.eval_think, "max_tokens": budget, "force_budget": a.force_budget, "temp": temp}
                kinds = dict(c.split(" ", 1) for c in schemas.SUMMARY.split(", "))
                fresh = evals.summary(records).withColumns({k: F.lit(v).cast(kinds[k]) for k, v in run.items()})
                fresh = fresh.withColumn("decode", F.create_map(*[F.lit(x) for kv in decode.items() for x in kv]).cast("map<string,string>"))
                merged = jsonl.upsert(self.read(f"{folder}/summary", schemas.SUMMARY), fresh, "benchmark").collect()
                jsonl.overwrite(self.spark.createDataFrame(merged, self._summary_schema(fresh)), self.at(f"{folder}/summary"))

    def _summary_schema(self, fresh: DataFrame):
        return jsonl.upsert(self.spark.createDataFrame([], schemas.SUMMARY), fresh, "benchmark").schema

    def report(self, a: argparse.Namespace) -> None:
        runs = [self.read(f"eval/{tag}/summary", schemas.SUMMARY) for tag in self.tags()]
        cols = ["model", "benchmark", "accuracy", "total", "seconds"]
        table = reduce(DataFrame.unionByName, [r.select(cols) for r in runs]) if runs else self.spark.createDataFrame([], "model string, benchmark string, accuracy double, total int, seconds double")
        if "baseline" in self.config:
            table = evals.with_baseline(jsonl.results(self.spark, self.config["baseline"]).select(cols), table)
        text = report.plain(report.rows(table, list(evals.FULL), a.time), self.config.get("targets"))
        files.write(self.spark, self.at("report.txt"), text + "\n")
        print(text)

    def logits(self, a: argparse.Namespace) -> None:
        """The teachers' top-k for the samples that have a domain and aren't in the store."""
        rows = self.ordered(a.split, "messages array<struct<role:string,content:string>>")
        asked = rows.withColumn("sample", F.col("number").cast("int")).withColumn("prompt", F.try_element_at("messages", F.lit(-2))["content"])
        known = teacher_topk.domains_by_prompt(asked.select("sample", "messages", "prompt"), self.read("prompts", schemas.PROMPT))
        routed = selection.routes(known, {k: v["domains"] for k, v in self.cfg.teachers.items()}, "domain")
        for name in a.teacher or list(self.cfg.teachers):
            path = self.at(f"teacher_logits/{a.split}-{name}")
            todo = routed.where(F.col("teacher") == name)
            todo = teacher_topk.missing(todo, teacher_topk.read(self.spark, path)) if files.exists(self.spark, path) else todo
            todo = todo.orderBy("sample").limit(a.limit) if a.limit else todo
            teacher_topk.append(teacher_topk.reduced(teacher_topk.scored(todo, load(a.scorer)), self.cfg.top_k), path)

    def check(self, a: argparse.Namespace) -> None:
        """Whether the models are there, and which teachers share the student's vocabulary."""
        paths = {f"teacher:{k}": v.get("path", "") for k, v in self.cfg.teachers.items()} | {"student": self.config.get("student", "")}
        for name, path in sorted(paths.items()):
            print(f"{'ok  ' if path and Path(path).exists() else 'MISS'} {name:<20} {path}")
        base = fingerprint(paths["student"])
        for name in self.cfg.teachers:
            print(f"{name:<20} {shared_vocabulary(base, fingerprint(paths[f'teacher:{name}']))}")

    def status(self, a: argparse.Namespace) -> None:
        wanted: dict[str, int] = {}
        for s in self.config.get("sources", []):
            wanted[s["domain"]] = wanted.get(s["domain"], 0) + s["n"]
        print(f"prompts {self.read('prompts', schemas.PROMPT).count()} built ({', '.join(f'{k} {v}' for k, v in wanted.items())})")
        for name, t in self.cfg.teachers.items():
            target = sum(wanted.get(d, 0) for d in t["domains"] if self.cfg.teacher_for(d) == name)
            r = evals.progress(self.read(f"teacher/{name}", schemas.TRACE).withColumn("file", F.lit(name)), "file", "gen_seconds").first()
            print(f"{name:<12} " + (f"{r['done']}/{target} {r['rate']:.1f}s/trace eta {(target - r['done']) * r['rate'] / 3600:.1f}h" if r else "not started"))
        if files.exists(self.spark, self.at("stats.json")):
            stats = json.loads(files.read(self.spark, self.at("stats.json")))
            print(f"dataset {stats.get('kept', 0)}/{stats.get('seen', 0)} kept ({stats.get('kept', 0) / max(stats.get('seen', 0), 1):.0%}) {({k: v for k, v in stats.items() if k.startswith('reject')})}")
        else:
            print("dataset not built")
        for tag in self.tags():
            cells = self.read(f"eval/{tag}/summary", schemas.SUMMARY).orderBy("benchmark").collect()
            print(f"eval {tag:<20} " + "  ".join(f"{r['benchmark']}={r['accuracy']:.1%}({r['total']})" for r in cells))


COMMANDS = ("check", "prompts", "teach", "rollout", "hedge", "dataset", "logits", "pairs", "eval", "report", "status")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--limit", type=int)
        c.add_argument("--generator", default="")
        c.add_argument("--run-code", action="store_true")
        if name == "prompts":
            c.add_argument("--domain", action="append")
        if name in ("teach", "logits"):
            c.add_argument("--teacher", action="append")
        if name == "logits":
            c.add_argument("--split", default="train")
            c.add_argument("--scorer", default="")
        if name == "rollout":
            c.add_argument("--triage-only", action="store_true")
            c.add_argument("--harvest-only", action="store_true")
        if name in ("dataset", "pairs"):
            c.add_argument("--skip-decontam", action="store_true")
        if name == "eval":
            c.add_argument("--model", default="student")
            c.add_argument("--benchmark", action="append")
            c.add_argument("--sample", type=int)
            c.add_argument("--tag")
            c.add_argument("--max-tokens", type=int)
            c.add_argument("--force-budget", type=int)
            c.add_argument("--temp", type=float)
            c.add_argument("--rep-penalty", type=float)
            c.add_argument("--think-bias", type=float)
        if name == "report":
            c.add_argument("--time", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    run = Run(spark or local_session(), load_config(a.config))
    with run.keep:
        getattr(run, a.command)(a)


if __name__ == "__main__":
    main()
