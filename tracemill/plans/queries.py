"""Queries that show each operator on the driver's tables, with the SQL that gives the same rows.

The tables stand in for the operators' own: documents are prompts (source the
domain, lang the kind), labels are verdicts (quality 1 correct, toxic 1
truncated), conversations are chat turns, events are an append-only run log
(event_type the benchmark, user_id the prompt, value seconds; right below 50,
truncated from 100 on, every fifth forced), embeddings are logits, part holds
questions. All queries read their whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import arrays
from tracemill.functions import text as X
from tracemill.operators import chat, evals, ngrams, sampling, selection
from tracemill.session import fresh_path, table
from tracemill.sources import jsonl, prompts
from tracemill.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED, GRAM = 17, 13
SHARES = {"src0": 0.4, "src1": 0.25, "src2": 0.35}
TEACHERS = {"first": ["en", "de"], "second": ["fr", "es", "de"]}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- proxies ------------------------------------------------------------

def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("truncated"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("benchmark"), F.concat(F.lit("r"), F.pmod("user_id", F.lit(3))).alias("run"),
        (v < 50).alias("correct"), (v >= 100).alias("truncated"), (F.pmod("event_id", F.lit(5)) == 0).alias("forced"), v.alias("seconds"),
    )


ROLLOUTS = "r AS (SELECT d.doc_id, lang, source, quality = 1 AS correct, toxic = 1 AS truncated FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
LOG = "e AS (SELECT event_id, ts, user_id, event_type AS benchmark, 'r' || (user_id % 3) AS run, value < 50 AS correct, value >= 100 AS truncated, event_id % 5 = 0 AS forced, value AS seconds FROM events)"
TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"
GRAMS = f"list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(list_slice(w, i, i + {GRAM} - 1), ' '))"
DIRTY = f"""b AS (SELECT {TOKENS} AS w FROM benchmark), g AS (SELECT DISTINCT unnest({GRAMS}) AS gram FROM b),
    t AS (SELECT doc_id, {TOKENS} AS w FROM documents), dirty AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({GRAMS}) AS gram FROM t) JOIN g USING (gram))"""
WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.contaminated_ids(table(spark, sf, "documents"), table(spark, sf, "benchmark"), GRAM)


# ---- decontamination and rejection -------------------------------------

@query(f"WITH b AS (SELECT {TOKENS} AS w FROM benchmark) SELECT count(DISTINCT gram) AS grams FROM (SELECT unnest({GRAMS}) AS gram FROM b)")
def ngram_index_size(spark, sf):
    return ngrams.index(table(spark, sf, "benchmark"), GRAM).agg(F.count("*").alias("grams"))


@query(f"WITH {DIRTY} SELECT doc_id FROM dirty")
def contaminated_docs(spark, sf):
    return dirty(spark, sf)


@query(f"WITH {DIRTY} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dirty)")
def clean_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(dirty(spark, sf), "doc_id", "left_anti")


@query(f"WITH {DIRTY} SELECT source, count(*) AS n, count(x.doc_id) AS contaminated FROM documents d LEFT JOIN dirty x ON d.doc_id = x.doc_id GROUP BY source")
def contam_by_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(dirty(spark, sf).withColumn("hit", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("contaminated"))


@query(f"""WITH {DIRTY}, s AS (SELECT d.doc_id, CASE WHEN x.doc_id IS NOT NULL THEN 'contaminated' WHEN l.quality = 0 THEN 'reject:quality' WHEN {WORDS} > 1024 THEN 'reject:too_long' ELSE 'kept' END AS reason
    FROM documents d LEFT JOIN dirty x ON d.doc_id = x.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT reason, count(*) AS n FROM s GROUP BY reason""")
def reject_stats(spark, sf):
    """The flagship: why each document goes, tested in a fixed order and counted in one pass."""
    docs = table(spark, sf, "documents").select("doc_id", selection.token_proxy(F.col("text")).alias("words"))
    rows = docs.join(dirty(spark, sf).withColumn("hit", F.lit(True)), "doc_id", "left").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    reason = F.when(F.col("hit"), "contaminated").when(F.col("quality") == 0, "reject:quality").when(F.col("words") > 1024, "reject:too_long").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT cap, count(*) FILTER (WHERE w <= cap) AS kept, count(*) FILTER (WHERE w > cap) AS over FROM (SELECT {WORDS} AS w FROM documents) CROSS JOIN (VALUES (128), (512), (896), (1024), (1280), (2048)) c(cap) GROUP BY cap")
def length_caps(spark, sf):
    caps = F.explode(F.array(*map(F.lit, (128, 512, 896, 1024, 1280, 2048)))).alias("cap")
    words = table(spark, sf, "documents").select(selection.token_proxy(F.col("text")).alias("w")).groupBy("w").count()  # one row a length
    fits = F.col("w") <= F.col("cap")
    return words.select("w", "count", caps).groupBy("cap").agg(F.sum(F.when(fits, F.col("count")).otherwise(0)).alias("kept"), F.sum(F.when(~fits, F.col("count")).otherwise(0)).alias("over"))


@query(f"SELECT source, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS p75, quantile_cont(w, 0.9) AS p90, max(w) AS longest FROM (SELECT source, {WORDS} AS w FROM documents) GROUP BY source")
def length_percentiles(spark, sf):
    w = table(spark, sf, "documents").select("source", selection.token_proxy(F.col("text")).alias("w"))
    return w.groupBy("source").agg(*[F.percentile("w", p).alias(n) for n, p in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))], F.max("w").cast("long").alias("longest"))


# ---- mixing, splitting, sampling ----------------------------------------

SHARE_ROWS = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SHARES.items())
PLAN = f"""s(source, share) AS (VALUES {SHARE_ROWS}), c AS (SELECT d.source, count(*) AS cnt, coalesce(any_value(s.share), 0) AS share FROM documents d LEFT JOIN s ON d.source = s.source GROUP BY d.source),
    p AS (SELECT source, cnt, CASE WHEN share > 0 THEN CAST(least(cnt, floor((SELECT max(cnt / share) FROM c WHERE share > 0) * share)) AS BIGINT) ELSE cnt END AS n FROM c)"""


@query(f"WITH {PLAN} SELECT * FROM p")
def mix_plan(spark, sf):
    return sampling.mix_plan(table(spark, sf, "documents"), "source", SHARES)


@query(f"WITH {PLAN}, k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{SEED}', source, doc_id)), doc_id) AS rn FROM documents) SELECT doc_id, k.source FROM k JOIN p ON k.source = p.source WHERE rn <= n")
def mix_by_source(spark, sf):
    return sampling.mix(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", SHARES, SEED)


DRAW = f"md5(concat_ws(':', '{SEED}', doc_id))"


@query(f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, rn, CASE WHEN rn <= greatest(CAST(floor(n * 0.05) AS BIGINT), 1) THEN 'valid' ELSE 'train' END AS part FROM k")
def train_valid_split(spark, sf):
    return sampling.split(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED, 0.05)


@query(f"SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{SEED}', source, doc_id)), doc_id) AS rn FROM documents) WHERE rn <= 10")
def sample_per_source(spark, sf):
    return sampling.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", SEED, 10)


@query(f"SELECT doc_id FROM documents ORDER BY {DRAW}, doc_id LIMIT 100")
def sample_sorted(spark, sf):
    return sampling.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED, 100)


@query(f"SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY {DRAW}, doc_id) AS rn FROM documents) WHERE rn <= 150")
def capped_sample(spark, sf):
    return sampling.capped(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED, 150)


@query(f"""WITH c AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{SEED}', source, doc_id)), doc_id) <= 10)
    SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{SEED}', source, doc_id)), doc_id) AS k FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= 5""")
def oversample_then_exclude(spark, sf):
    """Twice as many as wanted are drawn of each source, used ids go, and the first of the rest are kept."""
    drawn = sampling.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", SEED, 10).drop("rn")
    left = selection.todo(drawn, table(spark, sf, "labels"), "doc_id")
    return sampling.sample_per_group(left, "source", "doc_id", SEED, 5).drop("rn")


# ---- joins and selection ------------------------------------------------

@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_used_ids(spark, sf):
    return selection.todo(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query(f"WITH {ROLLOUTS} SELECT doc_id, source FROM r WHERE NOT correct")
def failure_arm(spark, sf):
    pool = table(spark, sf, "documents").select("doc_id", "source")
    return selection.failure_arm(pool, rollouts(spark, sf).select("doc_id", "correct"), "doc_id")


@query(f"WITH {ROLLOUTS}, k AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW}, doc_id) AS rn FROM r) SELECT doc_id FROM k WHERE rn <= (SELECT count(*) FROM r WHERE NOT correct)")
def control_arm(spark, sf):
    rolls = rollouts(spark, sf)
    return selection.control_arm(rolls, rolls.where("not correct").count(), SEED, "doc_id")


@query(f"WITH {ROLLOUTS} SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS wrong, count(*) FILTER (WHERE truncated) AS truncated, 1 - CAST(count(*) FILTER (WHERE NOT correct) AS DOUBLE) / greatest(count(*), 1) AS accuracy FROM r GROUP BY lang")
def triage_by_kind(spark, sf):
    return selection.triage(rollouts(spark, sf), "lang")


@query(f"""WITH {ROLLOUTS} SELECT lang, count(*) AS n, count(*) FILTER (WHERE correct AND NOT truncated) AS "natural", count(*) FILTER (WHERE correct AND truncated) AS forced, CAST(0 AS BIGINT) AS dropped_forced FROM r GROUP BY lang""")
def harvest_stats(spark, sf):
    return selection.harvest_stats(rollouts(spark, sf).withColumnRenamed("truncated", "forced"), True, "lang")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_wins(spark, sf):
    return selection.one_per_key(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, sf):
    return selection.one_per_key(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.desc("ts"), F.desc("event_id")).drop("ts")


@query(f"SELECT lang, doc_id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '{SEED}', lang, doc_id)), doc_id) - 1) / 16) AS BIGINT) AS batch FROM documents")
def batch_plan(spark, sf):
    return selection.batches(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 16)


@query("SELECT teacher, count(*) AS n FROM (SELECT CASE WHEN lang IN ('en', 'de') THEN 'first' WHEN lang IN ('fr', 'es') THEN 'second' END AS teacher FROM documents) WHERE teacher IS NOT NULL GROUP BY teacher")
def teacher_route(spark, sf):
    return selection.routes(table(spark, sf, "documents").select("lang"), TEACHERS, "lang").groupBy("teacher").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT run, count(*) AS done, round(sum(seconds), 6) AS seconds, round(sum(seconds) / greatest(count(*), 1), 6) AS rate, round((5000 - count(*)) * sum(seconds) / greatest(count(*), 1) / 3600, 6) AS eta_hours FROM e GROUP BY run")
def progress_eta(spark, sf):
    p = evals.progress(log(spark, sf), "run", "seconds")
    return p.select("run", "done", F.round("seconds", 6).alias("seconds"), F.round("rate", 6).alias("rate"), F.round((5000 - F.col("done")) * F.col("rate") / 3600, 6).alias("eta_hours"))


@query("SELECT event_id, CAST(floor(1024 * power(1.5, attempt + 1)) AS BIGINT) AS budget FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS attempt FROM events) WHERE attempt < 4")
def retry_budgets(spark, sf):
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("attempt", attempt).where("attempt < 4")
    return e.select("event_id", selection.retry_budget(F.lit(1024), F.col("attempt")).alias("budget"))


@query("SELECT coalesce(source, '?') AS source, lang, count(*) AS n FROM (SELECT source, lang FROM documents UNION ALL SELECT 'labels' AS source, NULL AS lang FROM labels) GROUP BY ALL")
def merged_sources(spark, sf):
    """Bag union of sources that don't have the same columns."""
    both = jsonl.merged(table(spark, sf, "documents").select("source", "lang"), table(spark, sf, "labels").select(F.lit("labels").alias("source")))
    return both.groupBy(F.coalesce("source", F.lit("?")).alias("source"), "lang").agg(F.count("*").alias("n"))


@query(f"WITH b AS (SELECT {TOKENS} AS w FROM benchmark), t AS (SELECT {TOKENS} AS w FROM documents) SELECT count(*) AS grams_in_both FROM (SELECT unnest({GRAMS}) AS gram FROM b INTERSECT SELECT unnest({GRAMS}) AS gram FROM t)")
def set_intersection(spark, sf):
    """How many n-grams of the benchmark are in some document."""
    both = ngrams.shared(table(spark, sf, "documents"), table(spark, sf, "benchmark"), GRAM)
    return both.agg(F.count("*").alias("grams_in_both"))


# ---- chat ---------------------------------------------------------------

TURNS = "SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    c = table(spark, sf, "conversations")
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")).join(reply, ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, unnest([0, 1, 2]) AS pos, unnest(['system', 'user', 'assistant']) AS role, unnest(['{chat.SAMPLE_SYSTEM}', prompt, answer]) AS content FROM ({TURNS})")
def chat_messages(spark, sf):
    packed = turns(spark, sf).select("conv_id", "turn", F.posexplode(chat.messages(F.col("prompt"), F.col("answer"))).alias("pos", "m"))
    return packed.select("conv_id", "turn", "pos", "m.role", "m.content")


@query(f"SELECT conv_id, turn, prompt, answer FROM ({TURNS}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def first_turn_pairs(spark, sf):
    return selection.one_per_key(turns(spark, sf), "conv_id", "turn")


@query(f"""SELECT conv_id, turn, '<think>' || chr(10) || prompt || chr(10) || '</think>' || chr(10) || chr(10) || answer AS chosen,
    CASE WHEN turn % 4 = 0 THEN '<think>' || chr(10) || prompt ELSE '<think>' || chr(10) || prompt || chr(10) || '</think>' || chr(10) || chr(10) || answer END AS rejected, turn % 4 = 0 AS rejected_unterminated
    FROM (SELECT conv_id, turn, regexp_replace(prompt, '\\s+$', '') AS prompt, answer FROM ({TURNS}))""")
def chosen_rejected(spark, sf):
    t = turns(spark, sf).withColumn("prompt", F.regexp_replace("prompt", r"\s+$", "")).withColumn("cut", F.pmod("turn", F.lit(4)) == 0)
    return t.select("conv_id", "turn", chat.thought(F.col("prompt"), F.col("answer")).alias("chosen"), chat.rejected(F.col("prompt"), F.col("answer"), F.col("cut"), F.lit(False)).alias("rejected"), F.col("cut").alias("rejected_unterminated"))


# ---- evaluation ---------------------------------------------------------

SUMMARY = "count(*) AS total, count(*) FILTER (WHERE correct) AS correct, round_even(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*), 4) AS accuracy, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE forced) AS forced, count(*) FILTER (WHERE forced AND correct) AS forced_correct, round_even(sum(seconds), 1) AS seconds"


@query(f"WITH {LOG} SELECT run, benchmark, {SUMMARY} FROM e GROUP BY run, benchmark")
def eval_summary(spark, sf):
    return evals.summary(log(spark, sf), "run", "benchmark")


@query(f"WITH {LOG} SELECT benchmark, run, {SUMMARY} FROM e WHERE run = CASE WHEN benchmark IN ('view', 'click') THEN 'r1' ELSE 'r0' END GROUP BY benchmark, run")
def summary_merge(spark, sf):
    """An old run's summary by benchmark, with the new run's rows in place where there are any."""
    rows = log(spark, sf)
    old = evals.summary(rows.where("run = 'r0'"), "benchmark", "run")
    new = evals.summary(rows.where("run = 'r1' and benchmark in ('view', 'click')"), "benchmark", "run")
    return jsonl.upsert(old, new, "benchmark")


@query(f"""WITH {LOG}, s AS (SELECT run, benchmark, round_even(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*), 4) AS a FROM e GROUP BY run, benchmark)
    SELECT run, max(a) FILTER (WHERE benchmark = 'view') AS view, max(a) FILTER (WHERE benchmark = 'click') AS click, max(a) FILTER (WHERE benchmark = 'error') AS error FROM s GROUP BY run""")
def summary_pivot(spark, sf):
    return evals.wide(evals.summary(log(spark, sf), "run", "benchmark"), "run", ["view", "click", "error"])


@query(f"WITH {LOG} SELECT event_id, benchmark, avg(CAST(correct AS INTEGER)) OVER (PARTITION BY benchmark, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM e")
def running_accuracy(spark, sf):
    rows = log(spark, sf).withColumn("by", F.concat_ws("/", "benchmark", "run"))
    return evals.running_accuracy(rows, "by", "event_id").select("event_id", "benchmark", "running")


@query(f"""WITH {LOG}, g AS (SELECT user_id, bool_or(correct) AS a, bool_and(correct) AS b, bool_or(truncated) AS t FROM e GROUP BY user_id)
    SELECT count(*) AS prompts, count(*) FILTER (WHERE a AND NOT b) AS mixed, count(*) FILTER (WHERE a AND t) AS mixed_trunc, count(*) FILTER (WHERE NOT a) AS all_fail, count(*) FILTER (WHERE b) AS all_pass FROM g""")
def group_signal(spark, sf):
    return evals.group_signal(log(spark, sf), "user_id")


def two_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd events as two runs over the items event_id div 2."""
    rows = log(spark, sf).withColumn("id", F.floor(F.col("event_id") / 2))
    return rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")


PAIRED = f"{LOG}, a AS (SELECT event_id // 2 AS id, correct, truncated FROM e WHERE event_id % 2 = 0), z AS (SELECT event_id // 2 AS id, correct, truncated FROM e WHERE event_id % 2 = 1)"


@query(f"WITH {PAIRED} SELECT count(*) AS common, count(*) FILTER (WHERE a.correct AND NOT z.correct) AS lost, count(*) FILTER (WHERE z.correct AND NOT a.correct) AS gained FROM a JOIN z ON a.id = z.id")
def regressions(spark, sf):
    return evals.regressions(*two_runs(spark, sf))


@query(f"""WITH {PAIRED} SELECT CASE WHEN a.correct THEN 'C' WHEN a.truncated THEN 'T' ELSE 'W' END AS was, CASE WHEN z.correct THEN 'C' WHEN z.truncated THEN 'T' ELSE 'W' END AS "now", count(*) AS n FROM a JOIN z ON a.id = z.id GROUP BY ALL""")
def transition_matrix(spark, sf):
    return evals.transitions(*two_runs(spark, sf))


ACC = f"{LOG}, s AS (SELECT run, benchmark, CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*) AS accuracy, sum(seconds) AS seconds, count(*) AS n FROM e GROUP BY run, benchmark)"


def accuracies(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).groupBy("run", "benchmark").agg((F.count_if("correct") / F.count("*")).alias("accuracy"), F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


@query(f"WITH {ACC} SELECT s.run, s.benchmark, round(s.accuracy - b.accuracy, 9) AS delta FROM s JOIN s b ON s.benchmark = b.benchmark AND b.run = 'r0'")
def delta_vs_anchor(spark, sf):
    return evals.against(accuracies(spark, sf), "run", "r0", "benchmark", "accuracy").select("run", "benchmark", F.round("delta", 9).alias("delta"))


@query(f"WITH {ACC} SELECT s.run, s.benchmark, round(s.seconds / b.seconds, 6) AS ratio FROM s JOIN s b ON s.benchmark = b.benchmark AND b.run = 'r0'")
def ratio_to_base(spark, sf):
    return evals.against(accuracies(spark, sf), "run", "r0", "benchmark", "seconds", ratio=True).select("run", "benchmark", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {ACC} SELECT s.run, s.benchmark, round(2 * sqrt(s.accuracy * (1 - s.accuracy) / s.n + b.accuracy * (1 - b.accuracy) / b.n), 9) AS two_se FROM s JOIN s b ON s.benchmark = b.benchmark AND b.run = 'r0'")
def two_se(spark, sf):
    a = accuracies(spark, sf)
    base = a.where("run = 'r0'").select("benchmark", F.col("accuracy").alias("p2"), F.col("n").alias("n2"))
    return a.join(base, "benchmark").select("run", "benchmark", F.round(evals.two_standard_errors(F.col("accuracy"), F.col("n"), F.col("p2"), F.col("n2")), 9).alias("two_se"))


@query(f"WITH {LOG} SELECT run, round(avg(CAST(correct AS INTEGER)) FILTER (WHERE forced), 9) AS inside, round(avg(CAST(correct AS INTEGER)) FILTER (WHERE NOT forced), 9) AS outside FROM e GROUP BY run")
def stratified_gap(spark, sf):
    return evals.stratified_gap(log(spark, sf), "run", "forced").select("run", F.round("inside", 9).alias("inside"), F.round("outside", 9).alias("outside"))


@query(f"WITH {LOG}, s AS (SELECT run, benchmark, count(*) FILTER (WHERE correct AND NOT forced) AS plain, count(*) FILTER (WHERE correct) AS helped, count(*) FILTER (WHERE truncated) AS t FROM e GROUP BY run, benchmark) SELECT run, benchmark, round((helped - plain) / CAST(greatest(t, 1) AS DOUBLE), 9) AS recovery FROM s")
def recovery_fraction(spark, sf):
    s = log(spark, sf).groupBy("run", "benchmark").agg(F.count_if(F.col("correct") & ~F.col("forced")).alias("plain"), F.count_if("correct").alias("helped"), F.count_if("truncated").alias("t"))
    return s.select("run", "benchmark", F.round(evals.recovery(F.col("helped"), F.col("plain"), F.col("t")), 9).alias("recovery"))


@query(f"WITH {LOG}, s AS (SELECT run, benchmark, count(*) AS total FROM e GROUP BY run, benchmark) SELECT run, max(total) AS largest FROM s WHERE run NOT LIKE '%sanity%' GROUP BY run HAVING max(total) >= 100")
def full_runs(spark, sf):
    return evals.full_runs(evals.summary(log(spark, sf), "run", "benchmark"), "run")


@query(f"""WITH {ACC} SELECT run, benchmark, printf('%.1f%%', accuracy * 100) || CASE WHEN n < 1000 THEN '~' || n ELSE '' END AS cell, printf('%+.1f', (accuracy - 0.5) * 100) AS over_half FROM s""")
def report_cells(spark, sf):
    mark = F.when(F.col("n") < 1000, F.concat(F.lit("~"), F.col("n").cast("string"))).otherwise("")
    return accuracies(spark, sf).select("run", "benchmark", F.concat(X.percent(F.col("accuracy")), mark).alias("cell"), X.signed((F.col("accuracy") - 0.5) * 100).alias("over_half"))


@query("SELECT event_type, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS event_id, max(value) AS value FROM events GROUP BY event_type")
def longest_item(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


# ---- text functions -----------------------------------------------------

NORM_HASH = f"SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS w FROM documents)"


@query(NORM_HASH)
def normalized_documents(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.transform(F.array(X.tokens(F.col("text"))), lambda t: F.struct(F.size(t).cast("long").alias("words"), F.md5(F.array_join(t, " ")).alias("digest")))[0].alias("x"))
    return w.select("doc_id", "x.words", "x.digest")


# ---- templates and choices ---------------------------------------------

@query("SELECT p_partkey, p_name || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || chr(10) || 'Think it through, then end your reply with a final line of exactly ''Answer: <letter>''.' AS prompt, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS gold FROM part")
def mcq_template(spark, sf):
    prompt, gold = prompts.mcq(F.col("p_name"), F.array("p_brand", "p_type"), F.pmod("p_size", F.lit(2)))
    return table(spark, sf, "part").select("p_partkey", prompt.alias("prompt"), gold["letter"].alias("gold"))


@query(f"""WITH c AS (SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest([p_brand, p_type, p_name]) AS c FROM part),
    o AS (SELECT p_partkey, c, i, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws(':', '{SEED}', 'tqa', p_partkey, i)), i) AS k FROM c)
    SELECT p_partkey, string_agg(c, '|' ORDER BY k) AS choices, substr('ABC', CAST(min(k) FILTER (WHERE c = (SELECT p_brand FROM part p WHERE p.p_partkey = o.p_partkey)) AS INTEGER), 1) AS gold FROM o GROUP BY p_partkey""")
def shuffle_choices(spark, sf):
    mixed = prompts.shuffled(F.array("p_brand", "p_type", "p_name"), SEED, F.lit("tqa"), F.col("p_partkey"))
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", mixed.alias("m"))
    return rows.select("p_partkey", F.array_join("m", "|").alias("choices"), prompts.letter(F.array_position("m", F.col("p_brand")) - 1).alias("gold"))


# ---- arrays -------------------------------------------------------------

LSE = "(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))))"
DOUBLES = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(f"WITH {DOUBLES} SELECT vec_id, round({LSE}, 9) AS lse FROM v")
def logsumexp(spark, sf):
    return logits(spark, sf).select("vec_id", F.round(arrays.logsumexp(F.col("e")), 9).alias("lse"))


@query(f"WITH {DOUBLES}, f AS (SELECT vec_id, {LSE} AS z, unnest(e) AS x, unnest(range(len(e))) AS id FROM v) SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(id AS INTEGER) AS id, round(x - z, 9) AS logprob FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) - 1 AS rank FROM f) WHERE rank < 8")
def topk_logprobs(spark, sf):
    top = logits(spark, sf).select("vec_id", F.posexplode(arrays.top_logprobs(F.col("e"), 8)).alias("rank", "t"))
    return top.select("vec_id", "rank", F.col("t.id").alias("id"), F.round("t.logprob", 9).alias("logprob"))


@query(f"""WITH {DOUBLES}, f AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS id FROM v), k AS (SELECT vec_id, x, id FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) <= 8),
    n AS (SELECT k.vec_id, k.x - ln(sum(exp(k.x)) OVER (PARTITION BY k.vec_id)) AS t, k.x / 2 - ln(sum(exp(k.x / 2)) OVER (PARTITION BY k.vec_id)) AS s FROM k)
    SELECT vec_id, round(sum(exp(t) * (t - s)), 9) AS kl FROM n GROUP BY vec_id""")
def kl_topk(spark, sf):
    """KL of each vector's top 8 against the same tokens at twice the temperature."""
    top = logits(spark, sf).select("vec_id", F.transform(arrays.top_logprobs(F.col("e"), 8), lambda p: p["logprob"]).alias("t"))
    return top.select("vec_id", F.round(arrays.kl(F.col("t"), F.transform("t", lambda x: x / 2)), 9).alias("kl"))


@query("SELECT doc_id, CAST(least(4096, ceil(n_chars / 128.0) * 128) AS BIGINT) AS width FROM documents")
def pad_bucket(spark, sf):
    return table(spark, sf, "documents").select("doc_id", arrays.pad_bucket(F.col("n_chars"), 4096).alias("width"))


MARGIN = "0.1 * ((l_extendedprice - l_quantity) - (l_discount - l_tax)) / 1000"


@query(f"SELECT l_returnflag, round(avg(ln(1 + exp(-({MARGIN})))), 6) AS loss, round(avg(CAST({MARGIN} > 0 AS INTEGER)), 6) AS accuracy FROM lineitem GROUP BY l_returnflag")
def dpo_margin(spark, sf):
    m = arrays.preference_margin(0.1, F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity"), F.col("l_tax")) / 1000
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(arrays.preference_loss(m)), 6).alias("loss"), F.round(F.avg((m > 0).cast("double")), 6).alias("accuracy"))


@query("SELECT doc_id, CASE WHEN n_chars > 1024 AND lang = 'en' THEN round(0.02 * (n_chars - 1024), 6) ELSE 0.0 END AS bias FROM documents")
def ramp_bias(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(arrays.ramp_bias(F.col("n_chars"), 1024, 0.02, F.col("lang") == "en"), 6).alias("bias"))


@query("SELECT vec_id, CAST(p AS INTEGER) AS pos, round(CAST(embedding[p + 1] AS DOUBLE), 9) AS value FROM (SELECT vec_id, embedding, unnest(range(label % 8, 63)) AS p FROM embeddings)")
def topk_alignment(spark, sf):
    """Positions that predict the answer, the prompt being label % 8 + 1 long; one row for each."""
    start = F.pmod("label", F.lit(8)) + 1
    rows = table(spark, sf, "embeddings").select("vec_id", start.alias("start"), F.posexplode(arrays.aligned(F.col("embedding"), start)).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + F.col("start") - 1).cast("int").alias("pos"), F.round(F.col("x").cast("double"), 9).alias("value"))


# ---- sources, sinks, streams -------------------------------------------

@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf):
    """Written as JSON lines in two appends, and read with a declared schema."""
    path, c = fresh_path(spark, "jsonl"), table(spark, sf, "conversations")
    jsonl.overwrite(c.where("role = 'user'"), path)
    jsonl.append(c.where("role <> 'user'"), path)
    return jsonl.scan(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT count(*) AS n FROM conversations")
def line_count(spark, sf):
    path = fresh_path(spark, "lines")
    jsonl.overwrite(table(spark, sf, "conversations"), path)
    return spark.read.text(path).agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT benchmark, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 9) AS accuracy FROM e GROUP BY benchmark")
def stream_resume(spark, sf):
    """The run log as a stream: each id once (within a bounded time), written batch by batch; the whole result is what a batch would give."""
    out, src = fresh_path(spark, "stream"), fresh_path(spark, "stream-in")
    rows = log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(rows.where("event_id % 7 = 0")).write.parquet(src)  # with records that were sent twice
    stream = resume.first_seen(resume.records(spark, src, rows.schema, fmt="parquet"), "event_id", "ts", "365 days")
    resume.sink(stream, f"{out}-state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    done = spark.read.schema(rows.schema).parquet(out)
    return done.groupBy("benchmark").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"))
