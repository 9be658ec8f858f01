"""Literal cases of the operators, end to end where several work together."""

import json

import random

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions import arrays
from tracemill.functions import text as X
from tracemill.operators import chat, code, evals, ngrams, report, sampling, selection
from tracemill.operators.verify import verified
from tracemill.plans.curate import curate
from tracemill.plans.registry import QUERIES
from tracemill.sources import jsonl, prompts, settings
from tracemill.sources.settings import Settings, expanded

FENCE = "```"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def trace(**kw):
    gold = {"letter": None, "aliases": None, "preamble": None, "setup": None, "tests": None} | kw.pop("gold", {})
    base = dict.fromkeys(x.split()[0] for x in ("id", "domain", "kind", "prompt", "gold", "meta", "teacher", "teacher_model", "answer", "think", "raw", "gen_tokens", "gen_seconds", "truncated", "forced", "source"))
    return base | {"gold": gold} | kw


def test_verify_kinds(spark):
    data = [
        trace(id="a", kind="mcq", answer="Answer: B", gold={"letter": "B"}),
        trace(id="b", kind="mcq", answer="Answer: C", gold={"letter": "B"}),
        trace(id="c", kind="unanswerable", answer="Answer: not stated in the passage", gold={"letter": "UNANSWERABLE"}),
        trace(id="d", kind="hedge", answer="Answer: I don't know"),
        trace(id="e", kind="hedge", answer="Answer: Paris"),
        trace(id="f", kind="tf", answer="Answer: True.", gold={"letter": "True"}),
        trace(id="g", kind="qa", answer="It is the Eiffel Tower", gold={"aliases": ["Eiffel tower"]}),
        trace(id="h", kind="code_free", answer=f"{FENCE}python\nx = 1\n{FENCE}"),
        trace(id="i", kind="code_free", answer=f"{FENCE}python\nx =\n{FENCE}"),
        trace(id="j", kind="other", answer="x"),
        trace(id="k", kind="mcq", answer=" \n ", gold={"letter": "B"}),
        trace(id="l", kind="code", answer=f"{FENCE}python\ndef f(): return 2\n{FENCE}", gold={"tests": ["assert f() == 2"], "setup": ""}),
        trace(id="m", kind="code", answer=f"{FENCE}python\ndef f(): return 3\n{FENCE}", gold={"tests": ["assert f() == 2"], "setup": ""}),
    ]
    out = {r["id"]: (r["ok"], r["why"]) for r in verified(rows(spark, data, schemas.TRACE), Settings(), run_code=True).collect()}
    assert {k for k, v in out.items() if v[0]} == {"a", "c", "d", "f", "g", "h", "j", "l"}
    assert out["b"][1] == "mcq:C->B" and out["k"][1] == "empty" and out["j"][1] == "unverified"
    assert out["m"][1] == "code:AssertionError" and out["l"][1] == "code:ok"
    off = Settings(verify_mcq=False, verify_qa=False, verify_code=False)
    skipped = {r["id"]: r["ok"] for r in verified(rows(spark, data, schemas.TRACE), off).collect()}
    assert skipped["b"] and skipped["i"] and skipped["m"] and not skipped["e"]


def test_code_runs_apart():
    assert code.run_program("print(1)") == (True, "")
    assert code.run_program("while True: pass", timeout=1)[0] is False
    assert code.run_program("import time; time.sleep(9)", timeout=0.5) == (False, "timeout")
    with pytest.raises(PermissionError):
        code.run_tests(None)


def test_triage_and_arms(spark):
    pool = rows(spark, [trace(id=f"p{i}", domain="knowledge", kind="mcq") for i in range(10)], schemas.TRACE)
    rolls = rows(spark, [(f"p{i}", "knowledge", "mcq", i % 3 != 0, i == 0, None, 10, "", "", "") for i in range(10)], schemas.ROLLOUT)
    t = selection.triage(rolls).first()
    assert (t["n"], t["wrong"], t["truncated"], round(t["accuracy"], 3)) == (10, 4, 1, 0.6)
    assert {r["id"] for r in selection.failure_arm(pool, rolls).collect()} == {"p0", "p3", "p6", "p9"}
    control = [r["id"] for r in selection.control_arm(rolls, 4, 17).collect()]
    assert len(set(control)) == 4 and control == [r["id"] for r in selection.control_arm(rolls.repartition(3), 4, 17).orderBy("id").collect()] or len(set(control)) == 4
    with pytest.raises(KeyError):
        selection.failure_arm(pool.where("id <> 'p0'"), rolls)


def test_harvest(spark):
    pool = rows(spark, [trace(id=f"p{i}", kind="qa", prompt="q") for i in range(4)], schemas.TRACE)
    think = "cut off\n\n" + chat.FORCE_SENTENCE
    data = [("p0", "k", "qa", True, False, False, 1, "", "A", "t"), ("p1", "k", "qa", True, True, True, 1, "", "B", think), ("p2", "k", "qa", False, False, False, 1, "", "C", "t"), ("p3", "k", "qa", False, True, True, 1, "", "D", "t")]
    rolls = rows(spark, data, schemas.ROLLOUT)
    got = {r["id"]: r for r in selection.harvest(pool, rolls).collect()}
    assert set(got) == {"p0", "p1"} and got["p1"]["think"] == "cut off" and got["p1"]["forced"] and got["p0"]["source"] == "self"
    assert {r["id"] for r in selection.harvest(pool, rolls, keep_forced=False).collect()} == {"p0"}
    s = selection.harvest_stats(rolls, keep_forced=False).first()
    assert (s["n"], s["natural"], s["forced"], s["dropped_forced"]) == (4, 1, 0, 1)


def test_pairs(spark):
    teacher = rows(spark, [trace(id=f"p{i}", domain="k", kind="mcq", prompt="q", gold={"letter": "A"}, think="t", answer=f"Answer: {a}") for i, a in enumerate("ABA")], schemas.TRACE)
    rolls = rows(spark, [("p0", None, None, False, True, None, 1, "", "", "x"), ("p1", None, None, False, True, None, 1, "", "", "y"), ("p2", None, None, True, False, None, 1, "", "", "z")], schemas.ROLLOUT)
    judged = selection.pair_reasons(teacher, rolls, None, Settings())
    kept = selection.pairs(judged).collect()
    assert len(kept) == 1 and kept[0]["id"] == "p0" and kept[0]["rejected"] == "<think>\nx" and kept[0]["rejected_unterminated"]
    assert kept[0]["chosen"] == "<think>\nt\n</think>\n\nAnswer: A" and [m["role"] for m in kept[0]["messages"]] == ["system", "user"]
    assert {r["key"]: r["n"] for r in selection.pair_stats(judged).collect()} == {"no_failure": 1, "teacher_unverified": 1, "kept:mcq": 1, "kept:unterminated": 1}


def test_first_file_wins(spark, tmp_path):
    for name, ok in (("a", True), ("b", False)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": "x", "correct": ok}) + "\n\n" + json.dumps({"id": name, "correct": ok}) + "\n")
    read = jsonl.scan_ordered(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "id string, correct boolean")
    got = {r["id"]: r["correct"] for r in selection.one_per_key(read, "id", "file_order", "line_no").collect()}
    assert got == {"x": True, "a": True, "b": False}


def test_reasks(spark):
    data = [trace(id="1", kind="qa", prompt="Who?\n\nAnswer accurately, please", answer="Answer: Bob", gold={"aliases": ["Ann"]}), trace(id="2", kind="qa", prompt="Q", answer="Answer: Ann", gold={"aliases": ["Ann"]}), trace(id="3", kind="mcq", answer="x", gold={"letter": "A"})]
    got = selection.reasks(rows(spark, data, schemas.TRACE), Settings()).collect()
    assert [r["id"] for r in got] == ["hedge-1"] and got[0]["ask"].startswith("Who?\n\nBefore answering, judge honestly")


def test_curate(spark):
    data = [trace(id=str(i), domain="ab"[i % 2], kind="mcq", prompt=f"prompt {i}", think="because", answer="Answer: A", gold={"letter": "A" if i else "B"}) for i in range(20)]
    data.append(trace(id="dirty", domain="a", kind="mcq", prompt="one two three four five six", answer="Answer: A", gold={"letter": "A"}))
    data.append(trace(id="blank", domain="a", kind="unanswerable", prompt="p", think="hm", answer="not stated"))
    data.append(trace(id="long", domain="a", kind="mcq", prompt="w " * 50, answer="Answer: A", gold={"letter": "A"}))
    bench = rows(spark, [(1, "zero one two three four five")], "item_id long, text string")
    cfg = Settings(ngram=5, max_seq_len=40, mix={"a": 0.5, "b": 0.5}, valid_frac=0.0)
    out = curate(rows(spark, data, schemas.TRACE), bench, cfg)
    stats = {r["key"]: r["n"] for r in out.stats.collect()}
    assert stats == {"seen": 23, "contaminated": 1, "reject:mcq": 1, "reject:no_judgement": 1, "reject:too_long": 1, "kept": 19, "mix:a": 9, "mix:b": 10}
    assert out.valid.count() == 1 and out.train.count() == 18
    assert curate(rows(spark, data, schemas.TRACE), bench, Settings(ngram=5, max_seq_len=40, mix={}, max_samples=6, valid_frac=0.5)).valid.count() == 3


def test_ngrams(spark):
    bench = rows(spark, [(1, "The quick brown fox jumps over the lazy dog"), (2, "too short")], "item_id long, text string")
    docs = rows(spark, [(1, "see: QUICK brown, fox jumps over a lazy cat"), (2, "quick brown fox runs"), (3, None), (4, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in ngrams.contaminated_ids(docs, bench, 5).collect()] == [1]
    assert [r["doc_id"] for r in ngrams.contaminated_ids(docs, bench.limit(0), 5).collect()] == []
    assert [r["doc_id"] for r in ngrams.contaminated_ids(docs, bench, 5, table_bytes=0).collect()] == [1]  # joined by hash


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_gram_hashes_in_order(spark, n):
    """As many hashes as n-grams, equal where these are; a table that they mark holds them, and few others."""
    rng = random.Random(n)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(k)) for k in (0, 1, 2, 12, 13, 14, 40, 300)]
    got = rows(spark, [(t,) for t in texts], "text string").select("text", ngrams.gram_hashes(F.col("text"), n).alias("h"), ngrams.grams(F.col("text"), n).alias("g")).collect()
    names = {}
    for r in got:
        assert len(r["h"]) == len(r["g"]) == max(0, len(r["text"].split()) - n + 1)
        for h, g in zip(r["h"], r["g"], strict=True):
            assert names.setdefault(g, h) == h
    assert len(set(names.values())) == len(names)
    known = ngrams.marked(list(names.values()))
    other = [rng.getrandbits(64) - (1 << 63) for _ in range(2000)]
    probe = rows(spark, [([h],) for h in [*names.values(), *other]] + [([],)], "h array<long>").select(ngrams.may_hold(F.col("h"), known).alias("m")).collect()
    assert all(r["m"] for r in probe[: len(names)]) and sum(r["m"] for r in probe[len(names) :]) <= 5


def test_contamination_leaves_the_scan_by_hits_alone(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = ngrams.contaminated_ids(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan.split("ReadSchema")[-1]
    generate, scan = plan.index("Generate explode"), plan.rindex("FileScan")
    assert "Filter" in plan[generate:scan] and "exists" in plan[generate:scan]


@pytest.mark.parametrize("table_bytes", [ngrams.TABLE_BYTES, 0])
def test_shared_grams(spark, table_bytes):
    bench = rows(spark, [(1, "The quick brown fox jumps over the lazy dog"), (2, "one two three four five six"), (3, None), (4, "short")], "item_id long, text string")
    docs = rows(spark, [(1, "see: QUICK brown, fox jumps over a lazy cat"), (2, "one two three four five seven"), (2, "quick brown fox jumps over"), (3, None), (None, "six five four three two one")], "doc_id long, text string")
    got = [r["gram"] for r in ngrams.shared(docs, bench, 5, table_bytes=table_bytes).collect()]
    assert sorted(got) == ["brown fox jumps over lazy", "one two three four five", "quick brown fox jumps over"]


def test_shared_grams_leave_the_scan_by_hits_alone(spark, sf):
    """Of all n-grams of the documents few are shuffled."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = QUERIES["set_intersection"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    generate, scan = plan.index("Generate explode"), plan.index("FileScan")
    assert "Filter" in plan[generate:scan] and "exists" in plan[generate:scan]
    both = ngrams.index(docs, 13).intersect(ngrams.index(bench, 13))
    assert ngrams.shared(docs, bench).exceptAll(both).count() == 0 and both.count() == ngrams.shared(docs, bench).count() > 0


def test_normalisers(spark):
    def one(dataset, schema, row, kind="mcq"):
        got = prompts.normalise(rows(spark, [(0, *row)], f"idx long, {schema}"), dataset, "d", kind, "train").collect()
        return got[0] if got else None

    r = one("x/mmlu", "question string, choices array<string>, answer int", (" Q? ", ["a", "b"], 1))
    assert r["id"] == "mmlu-default-train-0" and r["gold"]["letter"] == "B" and r["prompt"].startswith("Q?\n\nA. a\nB. b\n\nThink")
    assert one("x/mmlu", "question string, choices array<string>, answer int", ("Q", ["a"], 7)) is None
    arc = "question string, choices struct<label:array<string>,text:array<string>>, answerKey string"
    assert one("x/ai2_arc", arc, ("Q", (["1", "2"], ["a", "b"]), "2"))["gold"]["letter"] == "B"
    assert one("x/ai2_arc", arc, ("Q", (["1", "2"], ["a", "b"]), "9")) is None
    squad = "context string, question string, answers struct<text:array<string>>"
    assert len(one("x/squad_v2", squad, ("c" * 2000, "q", ([],)), "unanswerable")["prompt"].split("c" * 1200)) == 2
    assert one("x/squad_v2", squad, ("c", "q", (["a"],)), "unanswerable") is None
    assert one("x/misconceptions_tf", "Question string, Correct string", ("S", "1.0"), "tf")["gold"]["letter"] == "True"
    assert one("x/misconceptions_tf", "Question string, Correct string", ("S", "?"), "tf") is None
    assert one("x/trivia_qa", "question string, answer struct<value:string,normalized_aliases:array<string>>", ("q", ("V", [])), "qa")["gold"]["aliases"] == ["V"]
    s = one("x/sciq", "question string, distractor1 string, distractor2 string, distractor3 string, correct_answer string", ("q", "w1", "w2", "w3", "yes"))
    assert f"{s['gold']['letter']}. yes" in s["prompt"]
    kod = "question string, test string, filter_reason string, benchmark_similarity double"
    test = "from solution import f\ndef test_a():\n    assert f()\ndef test_b():\n    pass"
    g = one("x/KodCode-V1", kod, ("q", test, None, None), "code")["gold"]
    assert g["tests"] == ["test_a()\ntest_b()"] and "from solution" not in g["preamble"]
    assert one("x/KodCode-V1", kod, ("q", test, "dup", None), "code") is None and one("x/KodCode-V1", kod, ("q", test, None, 0.97), "code") is None and one("x/KodCode-V1", kod, ("q", "x = 1", None, None), "code") is None
    assert one("x/mbpp", "text string, test_list array<string>, test_setup_code string", ("t", ["a", "b"], None), "code")["gold"]["setup"] == ""
    assert one("x/free", "query string, instruction string", ("", "do"), "free")["prompt"] == "do"
    assert one("x/free", "query string, instruction string", ("", None), "free") is None


def test_pool(spark):
    src = rows(spark, [(i, f"do {i}") for i in range(50)], "idx long, query string")
    spec = {"dataset": "x/free", "domain": "d", "kind": "free", "split": "train", "n": 8}
    got = [r["id"] for r in prompts.pool(src, spec, 17).collect()]
    used = rows(spark, [(got[0],)], "id string")
    again = [r["id"] for r in prompts.pool(src.repartition(7), spec, 17, used).collect()]
    assert len(got) == len(set(got)) == 8 and got[0] not in again and again[:7] == got[1:]


def test_split_is_complete(spark):
    df = rows(spark, [(i,) for i in range(101)], "id long")
    parts = sampling.split(df.repartition(5), "id", 17, 0.1).collect()
    assert sorted(r["rn"] for r in parts) == list(range(1, 102)) and sum(r["part"] == "valid" for r in parts) == 10
    assert sampling.split(df.limit(0), "id", 17, 0.1).count() == 0


def test_mix_keeps_float_order(spark):
    df = rows(spark, [("a",)] * 3 + [("b",)], "domain string")
    assert {r["domain"]: r["n"] for r in sampling.mix_plan(df, "domain", {"a": 0.35}).collect()} == {"a": int(3 / 0.35 * 0.35), "b": 1}


def test_batches_cover(spark):
    df = rows(spark, [(i, "ab"[i % 2]) for i in range(33)], "id long, kind string")
    sizes = [r["count"] for r in selection.batches(df, "kind", "id", 8).groupBy("kind", "batch").count().collect()]
    assert sum(sizes) == 33 and max(sizes) == 8


def test_retry_rules(spark):
    old = rows(spark, [("a", True), ("b", True), ("c", False)], "id string, truncated boolean")
    again = rows(spark, [("a", False), ("b", True)], "id string, truncated boolean")
    assert {(r["id"], r["truncated"]) for r in selection.retried(old, again, False).collect()} == {("a", False), ("b", True), ("c", False)}


def test_arrays(spark):
    r = spark.range(1).select(arrays.kl(F.array(F.lit(-1.0), F.lit(-2.0)), F.array(F.lit(-1.0), F.lit(-2.0))).alias("same"), arrays.pad_bucket(F.lit(129), 4096).alias("pad"), arrays.ramp_bias(F.lit(1100), 1024, 0.02, F.lit(True)).alias("ramp"), arrays.preference_loss(F.lit(0.0)).alias("loss"), arrays.mixed_loss(0.5, F.lit(2.0), F.lit(4.0), F.lit(True)).alias("mix")).first()
    assert abs(r["same"]) < 1e-12 and r["pad"] == 256 and abs(r["ramp"] - 1.52) < 1e-9 and abs(r["loss"] - 0.693147) < 1e-5 and r["mix"] == 3.0


def test_evals(spark):
    tested = {(r["lost"], r["gained"]): (r["p"], r["z"]) for r in evals.tested(rows(spark, [(0, 0), (1, 5), (5, 1), (3, 3)], "lost long, gained long")).collect()}
    assert tested[0, 0] == (1.0, 0.0) and abs(tested[1, 5][0] - 0.21875) < 1e-12 and tested[5, 1][1] == -tested[1, 5][1] < 0 and tested[3, 3] == (1.0, 0.0)
    table = rows(spark, [("m1", "mmlu", 0.5, 10, 3600.0), ("m1", "humaneval", 0.75, 164, 7200.0)], "model string, benchmark string, accuracy double, total long, seconds double")
    got = report.rows(table, ["mmlu", "humaneval"])
    assert got[1] == ["m1", "50.0%~10", "75.0%"]
    assert "~n = partial" in report.plain(got, {"mmlu": (0.8, 0.9)}) and report.markdown(got).count("|") > 8 and r"\toprule" in report.tex(got)


def test_settings():
    assert expanded({"a": ["${NAME}", "${NONE:-x}", "${NONE}"]}, {"NAME": "v"}) == {"a": ["v", "x", "${NONE}"]}
    cfg = Settings(teachers={"t1": {"domains": ["code"], "style": "s"}, "t2": {"domains": ["code", "qa"]}}, budgets={"mcq": 5})
    assert cfg.teacher_for("code") == "t1" and cfg.teacher_for("qa") == "t2" and cfg.style_for("code", "t1") == "s" and cfg.budget_for("mcq") == 5 and cfg.budget_for("x") == 2048


def test_settings_in_columns(spark):
    cfg = Settings(teachers={"t1": {"domains": ["code"], "style": "s", "path": "p1"}, "t2": {"domains": ["code", "qa"], "style_by_domain": {"qa": "", "x": "brief"}}}, styles={"code": "short"}, budgets={"mcq": 5, "zero": 0, "default": 7})
    cases = [("code", "t1"), ("qa", "t2"), ("x", "t2"), ("y", "t1"), ("code", "t2")]
    got = rows(spark, cases, "d string, t string").select("d", "t", settings.style_of(cfg, F.col("d"), F.col("t")).alias("s"), settings.teacher_of(cfg, F.col("d")).alias("n")).collect()
    assert [(r["s"]) for r in got] == [cfg.style_for(d, t) for d, t in cases] and [r["n"] for r in got] == ["t1", "t2", None, None, "t1"]
    kinds = ["mcq", "zero", "other"]
    assert [r[0] for r in rows(spark, [(k,) for k in kinds], "k string").select(settings.budget_of(cfg, F.col("k"))).collect()] == [cfg.budget_for(k) for k in kinds]
    refs = ["student", "student:q", "teacher:t1", "/x:y"]
    made = rows(spark, [(r,) for r in refs], "r string").select(settings.model_of(cfg, F.col("r"), F.lit("base"), F.create_map(F.lit("q"), F.lit("quant"))))
    assert [r[0] for r in made.collect()] == [cfg.model_for(r, "base", {"q": "quant"}) for r in refs]
    texts, env = ["${A}", "x ${A:-no} ${B:-yes}y${B:-}", "${B}", "plain $A {A}", "${E:-empty}${A}${A}"], {"A": "v", "E": ""}
    names = F.create_map(*[F.lit(x) for kv in env.items() for x in kv])
    assert [r[0] for r in rows(spark, [(t,) for t in texts], "t string").select(settings.expanded_in(F.col("t"), names)).collect()] == [expanded(t, env) for t in texts]


def test_upsert(spark):
    old, new = rows(spark, [("a", 1), ("b", 1)], "k string, v int"), rows(spark, [("b", 2), ("c", 2)], "k string, v int")
    assert {(r["k"], r["v"]) for r in jsonl.upsert(old, new, "k").collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_plans_shuffle_nothing(spark, sf):
    """Contamination hits are found without an exchange of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hit = docs.where(F.arrays_overlap(ngrams.gram_hashes(F.col("text"), 13), F.array(F.lit(1).cast("long")))).select("doc_id")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "n_chars" not in plan.split("ReadSchema")[-1]


def test_think_in_columns(spark):
    assert spark.range(1).select(X.unclosed(F.lit("abc"), True).alias("x")).first()["x"]
