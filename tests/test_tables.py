"""Prefix sums, flat parts with offsets, exact tests, the distillation loss, programs and resumed rounds against plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.operators import chat, code, distill, evals, prefix
from tracemill.operators.generate import ROUND, escalated, state
from tracemill.session import Scratch
from tracemill.sources import files, ragged
from tracemill.sources.commits import Log


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


# ---- prefix sums and ragged rows ----------------------------------------

@pytest.mark.parametrize("size", [1, 7, 1000])
def test_prefix_sums(spark, size):
    rng = random.Random(size)
    data = [(rng.randrange(5), i, rng.randrange(4)) for i in range(40)]
    with Scratch() as keep:
        got = {(r["a"], r["b"]): r["lo"] for r in prefix.exclusive_sums(rows(spark, data, "a int, b int, n int").repartition(3), ["a", "b"], "n", "lo", keep, size).collect()}
        at = keep.held[0]._stored_at
        assert files.exists(spark, at)
        total = 0
        for a, b, n in sorted(data):
            assert got[a, b] == total
            total += n
        assert prefix.exclusive_sums(rows(spark, [], "a int, n int"), ["a"], "n", "lo", keep).count() == 0
    assert not files.exists(spark, at)


@pytest.mark.parametrize("stretch", [1, 8, 1 << 16])
def test_ragged_rows(spark, stretch):
    rng = random.Random(stretch)
    lengths = {s: rng.choice([1, 2, 3, 20]) for s in range(30)} | {99: 200}  # one sample over many stretches
    data = [(s, p, f"{s}:{p}", None if p % 5 == 0 else p) for s, n in lengths.items() for p in range(n)]
    rng.shuffle(data)
    df = rows(spark, data, "sample int, pos int, v string, w int").repartition(4)
    with Scratch() as keep:
        found = ragged.offsets(df, keep)
        lo = 0
        for r in sorted(found.collect()):
            assert (r["lo"], r["hi"]) == (lo, lo + lengths[r["sample"]])
            lo = r["hi"]
        flat = df.join(found, "sample").select((F.col("lo") + F.col("pos")).alias("place"), "v", "w")
        assert sorted(map(tuple, ragged.joined(flat, found, stretch).collect()), key=repr) == sorted(data, key=repr)


def test_ragged_store(spark, tmp_path):
    df = rows(spark, [(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, None)], "sample long, pos int, v array<double>")
    ragged.write(df, f"{tmp_path}/a")
    assert sorted(map(tuple, ragged.read(spark, f"{tmp_path}/a").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    ragged.write(df.limit(0), f"{tmp_path}/b")
    assert ragged.read(spark, f"{tmp_path}/b").count() == 0
    for bad in ([(1, 0, None), (1, 2, None)], [(1, 1, None)], [(1, 0, None), (1, 0, None)]):
        with pytest.raises(Exception, match="gaps or repeat"):
            ragged.write(rows(spark, bad, df.schema), f"{tmp_path}/c{len(files.names(spark, str(tmp_path)))}")


# ---- exact tests --------------------------------------------------------

def test_binomial_tails(spark):
    cases = [(k, n) for n in (1, 2, 3, 10, 61, 200, 1001) for k in sorted({0, 1, n // 4, n // 2 - 1, n // 2}) if 0 <= k <= n / 2]
    got = {(r["k"], r["n"]): r["t"] for r in rows(spark, cases, "k long, n long").withColumn("t", stats.binomial_tail(F.col("k"), F.col("n"))).collect()}
    for k, n in cases:
        assert got[k, n] == pytest.approx(float(Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)), rel=1e-11)
    big = rows(spark, [(499_000, 1_000_000), (5_000_000, 10_000_000)], "k long, n long").withColumn("t", stats.binomial_tail(F.col("k"), F.col("n"))).collect()
    assert big[0]["t"] == pytest.approx(0.5 * math.erfc((500 * 2 - 0.5) / 500 / math.sqrt(2)), rel=0.01) and big[1]["t"] == pytest.approx(0.5, abs=2e-4)
    lg = rows(spark, [(float(x),) for x in (1, 2, 3.5, 10, 1e3, 1e7)], "x double").withColumn("g", stats.log_gamma(F.col("x"))).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12) for r in lg)


def test_every_two_runs(spark):
    data = [("b", run, item, order, ok) for run in "xyz" for item in range(20) for order, ok in ((0, True), (1, (item * ord(run)) % 3 == 0)) if (item, run) != (3, "y")]
    got = {(r["a"], r["b"]): (r["common"], r["lost"], r["gained"]) for r in evals.compared(rows(spark, data, "bench string, run string, item int, n int, correct boolean").repartition(3), "item", "n", "bench").collect()}
    last = {(run, item): ok for _, run, item, order, ok in data if order}
    for a, b in ("xy", "xz", "yz"):
        both = [i for i in range(20) if (a, i) in last and (b, i) in last]
        assert got[a, b] == (len(both), sum(last[a, i] and not last[b, i] for i in both), sum(last[b, i] and not last[a, i] for i in both))


# ---- the loss -----------------------------------------------------------

def test_loss_by_hand(spark):
    rng = np.random.default_rng(5)
    steps, store, want = [], [], {}
    for sample, (prompt, end, taught) in enumerate([(2, 5, True), (1, 6, True), (3, 4, False), (9, 9, True)]):
        ce, kl = [], []
        for step in range(1, 8):
            logits, target = rng.normal(size=12) * 3, int(rng.integers(12))
            logp = logits - np.log(np.exp(logits).sum())
            steps.append((sample, step, logits.tolist(), target, prompt, end))
            if prompt <= step <= end:
                ce.append(-logp[target])
            if taught and prompt <= step:
                ids = rng.permutation(12)[:3]
                lps = np.log(rng.dirichlet([1, 1, 1, 1])[:3]).astype(np.float32)
                store.append((sample, step - prompt, ids.tolist(), lps.tolist()))
                if step < end:
                    t = lps.astype(float) - np.log(np.exp(lps.astype(float)).sum())
                    kl.append((np.exp(t) * (t - logp[ids])).sum())
        want[sample] = (len(ce), len(kl), np.mean(ce) if ce else 0, np.mean(kl) if kl else 0)
    df = rows(spark, steps, "sample int, step int, logits array<double>, target int, prompt_len int, end int")
    top = rows(spark, store, "sample int, pos int, ids array<int>, logprobs array<float>")
    for r in distill.losses(distill.with_teacher(df, top), 0.25, "sample").collect():
        n, k, ce, kl = want[r["sample"]]
        assert (r["n_tokens"], r["n_teacher"]) == (n, k) and np.allclose([r["ce"], r["kl"], r["loss"]], [ce, kl, 0.25 * ce + 0.75 * kl if n else 0])


# ---- programs -----------------------------------------------------------

def test_programs(spark, tmp_path):
    mark = tmp_path / "late"
    fork = f"import os, time\nif os.fork() == 0:\n    time.sleep(1.5)\n    open({str(mark)!r}, 'w')\n"
    noisy = "import sys\nsys.stderr.write('x' * 100000 + '\\nlast')\nprint('y' * 10**6)\nsys.exit(3)"
    texts = ["pass", "pass", fork, noisy, "while True: pass", None, "import time; time.sleep(30)", ""]
    got = {r["i"]: (r["passed"], r["error"]) for r in code.executed(rows(spark, list(enumerate(texts)), "i int, program string").withColumn("error", F.lit("old")), enabled=True, timeout=1.0).collect()}
    assert got[0] == got[1] == got[2] == got[7] == (True, "") and got[5] == (None, None) and got[4] == got[6] == (False, "timeout")
    assert got[3][0] is False and got[3][1].endswith("x\nlast") and len(got[3][1]) == code.STDERR_CHARS
    import time

    time.sleep(1.2)
    assert not mark.exists()  # the process that the program left behind is gone
    with pytest.raises(PermissionError):
        code.executed(None)
    tests = rows(spark, [("a", "```python\ndef f(x):\n    return x\n```", (None, None, "y = 1", "z = y", ["assert f(z) == 1"])), ("b", "def f(x): return 2", (None, None, None, None, ["assert f(1) == 1, 'no'"])), ("c", None, (None, None, None, None, None))], "id string, answer string, gold struct<letter:string,aliases:array<string>,preamble:string,setup:string,tests:array<string>>")
    assert {r["id"]: (r["passed"], r["why"]) for r in code.run_tests(tests, enabled=True).collect()} == {"a": (True, "code:ok"), "b": (False, "code:AssertionError: no"), "c": (True, "code:ok")}


def test_equal_programs_run_once(spark, tmp_path):
    each = f"import os, tempfile\nos.close(tempfile.mkstemp(dir={str(tmp_path)!r})[0])"
    df = rows(spark, [(i,) for i in range(50)], "i int").withColumn("program", F.lit(each)).repartition(5)
    assert code.executed(df, enabled=True).where("passed").count() == 50 and len(list(tmp_path.iterdir())) == 1


# ---- completions and rounds ---------------------------------------------

def test_states(spark):
    end = chat.FORCED_END
    cases = [(f"<think>a{end}yes", 98, (False, True, False)), (f"<think>a{end}yes", 97, (False, False, False)), ("<think>a", 100, (True, False, True)), (f"<think>a</think>b{end}c", 100, (False, False, False)), ("plain", 1, (False, False, False)), ("  ", 1, (False, False, True))]
    for raw, tokens, want in cases:
        r = rows(spark, [(raw, tokens)], "raw string, n int").select(state(F.col("raw"), False, F.col("n"), F.lit(110), 10).alias("s")).first()["s"]
        assert (r["open"], r["forced"], r["truncated"]) == want
    r = rows(spark, [(f"a{end}b",)], "raw string").select(state(F.col("raw"), True).alias("s"), state(F.col("raw"), True, reserve=0).alias("t"), state(F.col("raw")).alias("u")).first()
    assert (r["s"]["forced"], r["t"]["forced"], r["u"]["forced"]) == (True, False, False) and r["s"]["answer"] == "b"


def test_a_killed_run_asks_only_what_is_missing(spark, tmp_path):
    ids = [(f"i{k}", f"prompt {k}") for k in range(60)]
    df = rows(spark, ids, "id string, prompt string").repartition(3)
    asked, broken = tmp_path / "asked", tmp_path / "broken"
    asked.mkdir()
    broken.write_text("")

    def factory(asked=str(asked), broken=str(broken)):
        import os
        import uuid

        def model(prompts, system, most):
            if os.path.exists(broken) and most > 10 and any(p.endswith("8") for p in prompts):
                raise RuntimeError("killed")
            for p in prompts:
                with open(f"{asked}/{most}-{p}-{uuid.uuid4().hex}", "w"):
                    pass
            return [{"raw": "Answer: a" if most > 10 or int(p.split()[1]) % 2 else "<think>on", "tokens": most, "seconds": 0.0} for p in prompts]

        return model

    log = Log(spark, f"{tmp_path}/rounds", ROUND)
    go = lambda: escalated(df, factory, "s", F.lit(10), 1, F.col("truncated"), False, log=log, per_commit=10)
    with pytest.raises(Exception, match="killed"):
        go()
    before = {tuple(x.name.split("-")[:2]) for x in asked.iterdir()}
    held = {(10 if r["attempt"] == 0 else 15, r["id"]) for r in log.read().collect()}
    assert len({i for n, i in held if n == 10}) == 60 and len(before) >= 60
    broken.unlink()
    out = {r["id"]: (r["answer"], r["gen_tokens"], r["truncated"]) for r in go().collect()}
    assert out == {f"i{k}": ("Answer: a", 10 if k % 2 else 15, False) for k in range(60)}
    times = {}
    for x in asked.iterdir():
        n, p = x.name.split("-")[:2]
        key = (int(n), f"i{p.split()[1]}")
        times[key] = times.get(key, 0) + 1
    assert all(times[k] == 1 for k in held)  # what was committed before the kill isn't asked again
    assert sorted((10 if r["attempt"] == 0 else 15, r["id"]) for r in log.read().collect()) == sorted([(10, f"i{k}") for k in range(60)] + [(15, f"i{k}") for k in range(0, 60, 2)])
    names = log.names()
    go()
    assert log.names() == names  # a finished run asks nothing
