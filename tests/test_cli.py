"""The command line, end to end over a temporary folder with played-back completions."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import cli
from tracemill.operators.generate import escalated, recorded
from tracemill.sources import jsonl, teacher_topk
from tracemill.sources.settings import Settings, fingerprint, shared_vocabulary

ANSWERS = {}


def player():
    return recorded(ANSWERS)()


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def gold(**kw):
    return {"letter": None, "aliases": None, "preamble": None, "setup": None, "tests": None} | kw


def test_run(spark, tmp_path, monkeypatch, capsys):
    src = write(tmp_path / "src.jsonl", [{"idx": i, "question": f"Q{i}?", "choices": ["x", "y"], "answer": i % 2} for i in range(8)])
    bench = write(tmp_path / "bench.json", [{"item_id": 1, "text": "nothing in common with anything at all here"}])
    items = write(tmp_path / "items.json", [{"id": f"e{i}", "domain": "d", "kind": "mcq", "prompt": f"E{i}", "gold": gold(letter="A"), "meta": {}} for i in range(4)])
    base = tmp_path / "base.json"
    base.write_text(json.dumps({"models": {"stock": {"mmlu": {"accuracy": 0.5, "correct": 500, "total": 1000, "seconds": 7.0}, "note": "text"}}}))
    out = tmp_path / "out"
    config = {"out_dir": f"file://{out}",  # by its URI, as on a cluster
               "sources": [{"path": src, "dataset": "x/mmlu", "domain": "d", "kind": "mcq", "split": "train", "n": 6}], "settings": {"teachers": {"t": {"domains": ["d"], "path": "m"}}, "mix": {"d": 1.0}}, "benchmark": bench, "benchmarks": {"mmlu": items}, "baseline": str(base), "targets": {"mmlu": [0.8, 0.9]}}
    cfg = write(tmp_path / "run.json", [config])
    gen = ["--generator", "tests.test_cli:player"]
    go = lambda *args: cli.main(["--config", cfg, *args], spark)

    go("prompts")
    prompts = spark.read.json(str(out / "prompts")).collect()
    assert len(prompts) == 6
    for i, p in enumerate(prompts):
        ANSWERS[p["prompt"]] = f"<think>because</think>Answer: {p['gold']['letter'] if i else 'Z'}"
    ANSWERS.update({"E0": "Answer: A", "E1": "Answer: B", "E2": "<think>never ends", "E3": "Answer: A"})
    asked = []
    monkeypatch.setattr(cli, "load", lambda name, **options: asked.append(options) or (lambda a=dict(ANSWERS): recorded(a)()))
    go("teach", *gen, "--limit", "4")
    go("teach", *gen)
    assert spark.read.json(str(out / "teacher/t")).count() == 6
    go("dataset")
    stats = json.loads((out / "stats.json").read_text())
    assert stats["seen"] == 6 and stats["kept"] == 5 and stats["reject:mcq"] == 1 and stats["mix:d"] == 5
    assert spark.read.json(str(out / "train")).count() + spark.read.json(str(out / "valid")).count() == 5

    spark.read.json(str(out / "teacher/t")).write.json(str(out / "pool"))
    go("rollout", *gen)
    assert spark.read.json(str(out / "failure_arm")).count() == 1 and spark.read.json(str(out / "teacher/self")).count() == 5
    go("pairs", "--skip-decontam")
    assert json.loads((out / "pairs-stats.json").read_text())["no_failure"] >= 5

    go("eval", *gen, "--benchmark", "mmlu", "--tag", "mine")
    # a record that is appended later counts, though it is shorter
    spark.createDataFrame([("e1", True, "Answer: A", 1, 1.0)], "id string, correct boolean, output string, tokens int, seconds double").write.mode("append").json(str(out / "eval/mine/mmlu"))
    go("eval", *gen, "--benchmark", "mmlu", "--tag", "mine", "--force-budget", "64", "--rep-penalty", "1.1")
    assert asked[-1] == {"force_budget": 64, "temp": 0.0, "rep_penalty": 1.1, "think_bias": None}
    s = spark.read.json(str(out / "eval/mine/summary")).collect()
    assert len(s) == 1 and (s[0]["total"], s[0]["correct"], s[0]["truncated"]) == (4, 3, 1)
    assert (s[0]["force_budget"], s[0]["temp"], s[0]["max_tokens"], s[0]["decode"]["rep_penalty"]) == (64, 0.0, 2048, "1.1")
    go("report")
    text = (out / "report.txt").read_text()
    assert "mine (this run)" in text and "75.0%~4" in text and "stock" in text and "target (low)" in text
    go("status")
    said = capsys.readouterr().out
    assert "prompts 6 built (d 6)" in said and "6/6" in said and "dataset 5/6 kept" in said and "mmlu=75.0%(4)" in said
    monkeypatch.setattr(cli, "load", lambda name: lambda: lambda messages: [[float(len(messages)), 1.0, 2.0]] * 2)
    go("logits", "--limit", "2")
    go("logits")
    go("logits")
    store = teacher_topk.read(spark, str(out / "teacher_logits/train-t"))
    n = spark.read.json(str(out / "train")).count()
    assert store.count() == 2 * n and store.select("sample").distinct().count() == n and store.first()["ids"] == [0, 2, 1]
    go("check")
    assert "MISS teacher:t" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--config", cfg, "nothing"], spark)


def test_retries_styles_and_budgets(spark):
    """Cut traces are asked again with more tokens; the last cut retry doesn't take the place of the first attempt."""
    rows = spark.createDataFrame([("a", "d1", "p1"), ("b", "d2", "p2"), ("c", "d2", "p3")], "id string, domain string, prompt string")

    def factory():
        def model(prompts, system, most):
            done = lambda p: p == "p1" or (p == "p2" and most >= 225)
            return [{"raw": f"{system}:{most}" if done(p) else "<think>on", "tokens": most, "seconds": 1.0} for p in prompts]

        return model

    system = F.when(F.col("domain") == "d1", "short").otherwise("long")
    found = {r["id"]: (r["raw"], r["gen_tokens"], r["truncated"]) for r in escalated(rows, factory, system, F.lit(100), 2, F.col("truncated"), always=False).collect()}
    assert found == {"a": ("short:100", 100, False), "b": ("long:225", 225, False), "c": ("<think>on", 100, True)}
    last = {r["id"]: r["gen_tokens"] for r in escalated(rows, factory, "s", F.lit(100), 2, F.col("truncated"), always=True).collect()}
    assert last == {"a": 100, "b": 225, "c": 225}
    cfg = Settings(teachers={"t": {"domains": ["x"], "style": "calm", "style_by_domain": {"x": "", "y": "brief"}}})
    assert [cfg.style_for(d, "t") for d in ("x", "y", "z")] == [None, "brief", "calm"]


def test_vocabularies(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    for name, words in (("a", ["x", "fox"]), ("b", ["x", "fox"]), ("c", ["fox", "x"])):
        t = Tokenizer(models.WordLevel({w: i for i, w in enumerate([*words, "?"])}, unk_token="?"))
        t.pre_tokenizer = pre_tokenizers.Whitespace()
        (tmp_path / name).mkdir()
        t.save(str(tmp_path / name / "tokenizer.json"))
    a, b, c = (fingerprint(str(tmp_path / x)) for x in "abc")
    assert "viable" in shared_vocabulary(a, b) and "sequence" in shared_vocabulary(a, c) and "not found" in shared_vocabulary(a, fingerprint(""))


def test_ordered_scan(spark, tmp_path):
    """Names give the order of files, whatever their place in time; a large file is read in blocks, blank lines count."""
    for name, n in (("b", 3000), ("a", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"id": "{name}{i}"}}\n' + ("\n" if i == 1 else "") for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = jsonl.scan_ordered(spark, [str(tmp_path)], "id string").orderBy("file_order", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["id"] for r in rows] == ["a0", "a1"] + [f"b{i}" for i in range(3000)]
    assert [r["line_no"] for r in rows][:5] == [0, 1, 0, 1, 3]


def test_teacher_store(spark, tmp_path):
    path = str(tmp_path / "store")
    logits = spark.createDataFrame([(0, 0, [1.0, 3.0, 2.0]), (0, 1, [0.0, 0.0, 5.0]), (1, 0, [9.0, 1.0, 1.0])], "sample int, pos int, values array<double>")
    teacher_topk.append(teacher_topk.reduced(logits.where("sample = 0"), 2), path)
    store = teacher_topk.read(spark, path)
    assert {(r["pos"], tuple(r["ids"])) for r in store.collect()} == {(0, (1, 2)), (1, (2, 0))}
    assert [r["sample"] for r in teacher_topk.missing(logits.select("sample").distinct(), store).collect()] == [1]
    assert sorted((r["sample"], r["has_teacher"]) for r in teacher_topk.joined(logits, store).collect()) == [(0, True), (0, True), (1, False)]


def test_model_references():
    cfg = Settings(teachers={"a": {"domains": [], "path": "p"}})
    assert Settings().eval_budget_for("mmlu") == 2048 and Settings(eval_max_tokens={"default": 9, "mmlu": 5}).eval_budget_for("mmlu") == 5 and Settings(eval_max_tokens={"default": 9}).eval_budget_for("x") == 9
    assert [cfg.model_for(x, "base", {"q": "quant"}) for x in ("student", "student:q", "teacher:a", "/x")] == ["base", "quant", "p", "/x"]
