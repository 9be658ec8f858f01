"""Queries that run the operators on prompts, traces, rollouts and evaluations made of the driver's tables.

Documents become prompts (source the domain, the kind by doc_id) and traces
whose answers are right, wrong or empty by doc_id, so SQL can tell the verdict
from how the answer was made. Labels become rollouts, events evaluations, part
rows the sources' own records. All queries read their whole tables; long texts
are compared by their md5.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import chat, code, distill, evals, report, selection
from tracemill.operators.generate import ROUND, escalated, sized, state
from tracemill.plans import curate as curation
from tracemill.plans.queries import DIRTY, LOG, SEED, SHARES, log, query
from tracemill.plans.text_queries import FENCE, NL, WS, chosen, quoted
from tracemill.session import Scratch, fresh_path, stored, table
from tracemill.sources import jsonl, prompts, ragged, settings, teacher_topk
from tracemill.sources.commits import Log
from tracemill.sources.settings import Settings

KINDS = ("mcq", "tf", "qa", "unanswerable", "code_free", "hedge")
RIGHT = ["'Answer: C'", "'Answer: True.'", "'Answer: the ' || source", "'Answer: not stated in the passage'", f"{FENCE} || 'python' || {NL} || 'x = ' || doc_id || {NL} || {FENCE}", "'Answer: I do not know'"]
WRONG = ["'Answer: B'", "'Answer: False'", "'Answer: nothing'", "'Answer: 1912'", "'def f(:'", "'Answer: 42'"]
WHY = ["mcq", "tf", "qa", "abstain", "code_free", "hedge"]
JUDGED = "'The passage does not mention the answer to it at all.'"
SIXTH = "CAST(floor(doc_id / 6) AS BIGINT)"
TRACES = f"""SELECT 'd' || doc_id AS id, doc_id, source AS domain, {chosen([quoted(k) for k in KINDS])} AS kind, text AS prompt, source,
    CASE {SIXTH} % 3 WHEN 0 THEN {chosen(RIGHT)} WHEN 1 THEN {chosen(WRONG)} ELSE '  ' END AS answer,
    CASE CAST({SIXTH} % 4 AS INT) WHEN 0 THEN 'no idea' WHEN 1 THEN {JUDGED} WHEN 2 THEN 'Hm. ' || {JUDGED} || ' Fine.' ELSE NULL END AS think FROM documents"""
TARGET = f"CASE WHEN kind = 'unanswerable' THEN CASE WHEN {SIXTH} % 4 IN (1, 2) THEN '<think>' || {NL} || {JUDGED} || {NL} || '</think>' || {NL} || {NL} || answer ELSE '' END WHEN think IS NOT NULL THEN '<think>' || {NL} || think || {NL} || '</think>' || {NL} || {NL} || answer ELSE answer END"
OK = f"({SIXTH} % 3 = 0)"
COUNT = lambda t: rf"len(list_filter(string_split_regex({t}, '{WS}+'), lambda x: x <> ''))"
REASON = f"""CASE WHEN doc_id IN (SELECT doc_id FROM dirty) THEN 'contaminated' WHEN {SIXTH} % 3 = 2 THEN 'reject:empty' WHEN NOT {OK} THEN 'reject:' || {chosen([quoted(w) for w in WHY])}
    WHEN target = '' THEN 'reject:no_judgement' WHEN {COUNT('prompt || target')} > 1024 THEN 'reject:too_long' ELSE 'kept' END"""
JUDGEMENTS = f"{DIRTY}, t0 AS ({TRACES}), t1 AS (SELECT *, {TARGET} AS target FROM t0), j AS (SELECT *, {REASON} AS reason FROM t1)"
CFG = Settings(seed=SEED, mix=SHARES, max_seq_len=1024, valid_frac=0.05)


def traces(spark, sf: str) -> DataFrame:
    letter = F.when(F.col("kind") == "mcq", "C").when(F.col("kind") == "tf", "True").when(F.col("kind") == "unanswerable", "UNANSWERABLE")
    table(spark, sf, "documents").createOrReplaceTempView("documents_of_traces")
    rows = spark.sql(TRACES.replace("FROM documents", "FROM documents_of_traces"))
    return rows.withColumn("gold", prompts.gold(letter=letter, aliases=F.array("source"))).drop("doc_id")


# ---- verification and curation ------------------------------------------

@query(f"WITH {JUDGEMENTS} SELECT id, reason, md5(target) AS target FROM j")
def curation_reasons(spark, sf):
    """Why each trace goes or stays, from the curation plan itself."""
    out = curation.reasons(traces(spark, sf), table(spark, sf, "benchmark"), CFG)
    return out.select("id", "reason", F.md5("target").alias("target"))


MIXED = f"""{JUDGEMENTS}, s(domain, share) AS (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SHARES.items())}),
    c AS (SELECT j.domain, count(*) AS cnt, coalesce(any_value(s.share), 0) AS share FROM j LEFT JOIN s ON j.domain = s.domain WHERE reason = 'kept' GROUP BY j.domain),
    p AS (SELECT domain, CASE WHEN share > 0 THEN CAST(least(cnt, floor((SELECT max(cnt / share) FROM c WHERE share > 0) * share)) AS BIGINT) ELSE cnt END AS n FROM c),
    m AS (SELECT j.*, row_number() OVER (PARTITION BY j.domain ORDER BY md5(concat_ws(':', '{SEED}', j.domain, id)), id) AS rn, p.n FROM j JOIN p ON j.domain = p.domain WHERE reason = 'kept'),
    k AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', id)), id) AS place, count(*) OVER () AS total FROM m WHERE rn <= n)"""


@query(f"WITH {MIXED} SELECT 'seen' AS key, count(*) AS n FROM j UNION ALL SELECT reason, count(*) FROM j GROUP BY reason UNION ALL SELECT 'mix:' || domain, count(*) FROM k GROUP BY domain")
def curation_stats(spark, sf):
    return curation.curate(traces(spark, sf), table(spark, sf, "benchmark"), CFG).stats


@query(f"WITH {MIXED} SELECT CASE WHEN place <= greatest(CAST(floor(total * 0.05) AS BIGINT), 1) THEN 'valid' ELSE 'train' END AS part, '{chat.SAMPLE_SYSTEM}' AS system, md5(prompt) AS prompt, md5(target) AS answer FROM k")
def curation_packed(spark, sf):
    """Training and validation records after mixing, shuffling and packing."""
    made = curation.curate(traces(spark, sf), table(spark, sf, "benchmark"), CFG)
    of = lambda i: F.col("messages")[i]["content"]
    return made.train.withColumn("part", F.lit("train")).unionByName(made.valid.withColumn("part", F.lit("valid"))).select("part", of(0).alias("system"), F.md5(of(1)).alias("prompt"), F.md5(of(2)).alias("answer"))


@query(f"WITH {JUDGEMENTS} SELECT id, md5(target) AS target FROM j")
def training_targets(spark, sf):
    return traces(spark, sf).select("id", F.md5(chat.target(True)).alias("target"))


@query(f"WITH {JUDGEMENTS} SELECT domain, count(*) AS seen, count(*) FILTER (WHERE reason = 'kept') AS kept, round(count(*) FILTER (WHERE reason = 'kept') / CAST(greatest(count(*), 1) AS DOUBLE), 9) AS rate FROM j GROUP BY domain")
def keep_rates(spark, sf):
    out = curation.reasons(traces(spark, sf), table(spark, sf, "benchmark"), CFG).groupBy("domain").agg(F.count("*").alias("seen"), F.count_if(F.col("reason") == "kept").alias("kept"))
    return out.withColumn("rate", F.round(evals.keep_rate(F.col("kept"), F.col("seen")), 9))


@query(f"WITH {JUDGEMENTS} SELECT 'hedge-' || id AS id, 'hedge' AS kind, md5(replace({quoted(prompts.REASK)}, '%s', regexp_replace(prompt, '^{WS}+|{WS}+$', '', 'g'))) AS ask FROM j WHERE kind = 'qa' AND NOT {OK} AND doc_id % 4 <> 0")
def reask_rows(spark, sf):
    """Failed open-ended traces as prompts about confidence, without those that were asked already."""
    rows = traces(spark, sf)
    asked = rows.where("cast(substr(id, 2) as bigint) % 4 = 0").select(F.concat(F.lit("hedge-"), "id").alias("id"))
    return selection.reasks(rows.drop("source").withColumn("source", F.lit(None).cast("string")).withColumn("gold", prompts.gold(aliases=F.array("domain"))), CFG, asked).select("id", "kind", F.md5("ask").alias("ask"))


@query("SELECT 'd' || doc_id AS id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 512 WHEN 2 THEN 1024 WHEN 4 THEN 4096 ELSE 2000 END AS budget FROM documents")
def sized_budgets(spark, sf):
    rows = traces(spark, sf)
    return rows.select("id", sized(rows, {"mcq": 512, "qa": 1024, "code_free": 4096, "default": 2000}).cast("int").alias("budget"))


# ---- rollouts -----------------------------------------------------------

ROLLS = f"""SELECT 'd' || d.doc_id AS id, d.doc_id, {chosen([quoted(k) for k in KINDS], 'd.doc_id')} AS kind, quality = 1 AS correct, toxic = 1 AS truncated, d.doc_id % 5 = 0 AS forced,
    CASE WHEN d.doc_id % 5 = 0 THEN 'cut off' || {NL} || {NL} || {quoted(chat.FORCE_SENTENCE)} || ' ' ELSE 'own end of ' || source || ' ' END AS think, 'Answer: ' || lang AS answer, CAST(0 AS BIGINT) AS line_no FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
BARE = f"CASE WHEN doc_id % 5 = 0 THEN 'cut off' ELSE regexp_replace(think, '{WS}+$', '') END"


def rolls(spark, sf: str) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("documents_of_rolls")
    table(spark, sf, "labels").createOrReplaceTempView("labels_of_rolls")
    return spark.sql(ROLLS.replace("FROM documents d JOIN labels l", "FROM documents_of_rolls d JOIN labels_of_rolls l"))


@query(f"WITH r AS ({ROLLS}) SELECT r.id, md5(d.text) AS prompt, {BARE.replace('doc_id', 'r.doc_id')} AS think, answer, forced, 'self' AS source FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE correct")
def harvest_rows(spark, sf):
    """Right rollouts as traces, without the forcing sentence."""
    pool = traces(spark, sf).select("id", "prompt", "answer", "think", F.lit("x").alias("source"))
    return selection.harvest(pool, rolls(spark, sf)).select("id", F.md5("prompt").alias("prompt"), "think", "answer", "forced", "source")


@query(f"WITH r AS ({ROLLS}) SELECT kind, count(*) AS n, count(*) FILTER (WHERE correct AND NOT forced) AS \"natural\", CAST(0 AS BIGINT) AS forced, count(*) FILTER (WHERE correct AND forced) AS dropped_forced FROM r GROUP BY kind")
def harvest_without_forced(spark, sf):
    return selection.harvest_stats(rolls(spark, sf), keep_forced=False)


PAIRS = f"""{JUDGEMENTS}, r AS ({ROLLS}), pj AS (SELECT j.*, r.think AS roll_think, r.answer AS roll_answer, coalesce(r.truncated, false) OR coalesce(r.forced, false) AS cut,
    CASE WHEN r.doc_id IS NULL OR r.correct THEN 'no_failure' WHEN NOT {OK.replace('doc_id', 'j.doc_id')} THEN 'teacher_unverified' WHEN j.doc_id IN (SELECT doc_id FROM dirty) THEN 'contaminated' WHEN {COUNT('prompt || target')} > 1024 THEN 'chosen_too_long' ELSE 'kept' END AS pair_reason
    FROM j LEFT JOIN r ON j.doc_id = r.doc_id)"""


def judged_pairs(spark, sf: str) -> DataFrame:
    """Each rollout has a later one with the opposite result, which must not count."""
    first = rolls(spark, sf)
    later = first.withColumn("correct", ~F.col("correct")).withColumn("line_no", F.lit(1).cast("long"))
    return selection.pair_reasons(traces(spark, sf), first.unionByName(later).drop("kind", "doc_id"), table(spark, sf, "benchmark"), CFG)


@query(f"WITH {PAIRS} SELECT id, pair_reason AS reason FROM pj")
def pair_reasons(spark, sf):
    return judged_pairs(spark, sf).select("id", "reason")


@query(f"WITH {PAIRS}, kept AS (SELECT *, {BARE.replace('think', 'roll_think')} AS bare FROM pj WHERE pair_reason = 'kept') SELECT id, kind, md5(prompt) AS prompt, md5(target) AS chosen, cut AS rejected_unterminated, '<think>' || {NL} || bare || CASE WHEN cut THEN '' ELSE {NL} || '</think>' || {NL} || {NL} || roll_answer END AS rejected FROM kept")
def pair_rows(spark, sf):
    out = selection.pairs(judged_pairs(spark, sf))
    return out.select("id", "kind", F.md5(F.col("messages")[1]["content"]).alias("prompt"), F.md5("chosen").alias("chosen"), "rejected_unterminated", "rejected")


@query(f"WITH {PAIRS} SELECT CASE WHEN pair_reason = 'kept' THEN 'kept:' || kind ELSE pair_reason END AS key, count(*) AS n FROM pj GROUP BY key UNION ALL SELECT 'kept:unterminated', count(*) FROM pj WHERE pair_reason = 'kept' AND cut HAVING count(*) > 0")
def pair_statistics(spark, sf):
    return selection.pair_stats(judged_pairs(spark, sf))


@query(f"WITH r AS ({ROLLS}), a AS (SELECT *, doc_id % 7 = 0 AS cut, doc_id % 3 = 0 AS again_cut FROM r) SELECT id, CASE WHEN cut AND NOT again_cut THEN 'retry' ELSE 'first' END AS took FROM a")
def retried_rows(spark, sf):
    """Cut rows with their retry in place, unless that is cut as well."""
    rows = rolls(spark, sf).select("id", "doc_id", (F.col("doc_id") % 7 == 0).alias("truncated"), F.lit("first").alias("took"))
    again = rows.where("truncated").withColumn("truncated", F.col("doc_id") % 3 == 0).withColumn("took", F.lit("retry"))
    return selection.retried(rows, again, keep_if_cut=False).select("id", "took")


# ---- sources ------------------------------------------------------------

CHOICES = f"'A. ' || p_brand || {NL} || 'B. ' || p_type || {NL} || 'C. ' || p_name"
ASK = lambda template, *parts: f"replace(replace({quoted(template)}, '%s', chr(1)), chr(1) || {NL} || {NL} || chr(1), {parts[0]} || {NL} || {NL} || {parts[1]})" if len(parts) == 2 else f"replace({quoted(template)}, '%s', {parts[0]})"


def parts(spark, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("idx", F.col("p_partkey"))


def made(rows: DataFrame, dataset: str, kind: str) -> DataFrame:
    """The prompt records of rows, as columns that SQL can give too."""
    out = prompts.normalise(rows, f"org/{dataset}", "shop", kind, "train", "main")
    joined = lambda c: F.array_join(c, "|")
    return out.select("id", "domain", "kind", "prompt", F.col("gold.letter").alias("letter"), joined("gold.aliases").alias("aliases"), F.col("gold.preamble").alias("preamble"), F.col("gold.setup").alias("setup"), joined("gold.tests").alias("tests"), F.col("meta")["source"].alias("origin"))


def record(dataset: str, kind: str, prompt: str, where: str = "true", letter: str = "NULL", aliases: str = "NULL", preamble: str = "NULL", setup: str = "NULL", tests: str = "NULL") -> str:
    return f"SELECT '{dataset}-main-train-' || p_partkey AS id, 'shop' AS domain, '{kind}' AS kind, {prompt} AS prompt, CAST({letter} AS VARCHAR) AS letter, CAST({aliases} AS VARCHAR) AS aliases, CAST({preamble} AS VARCHAR) AS preamble, CAST({setup} AS VARCHAR) AS setup, CAST({tests} AS VARCHAR) AS tests, 'org/{dataset}' AS origin FROM part WHERE {where}"


def three() -> Column:
    return F.array("p_brand", "p_type", "p_name")


@query(record("mmlu", "mcq", ASK(prompts.MCQ, "p_name", CHOICES), "p_size % 5 < 3", "substr('ABC', CAST(p_size % 5 AS INT) + 1, 1)"))
def source_mmlu(spark, sf):
    """The answer is an index; out of range it drops the row."""
    return made(parts(spark, sf).select("idx", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("question"), three().alias("choices"), F.pmod("p_size", F.lit(5)).alias("answer")), "mmlu", "mcq")


def labelled_choices() -> Column:
    return F.struct(F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("label"), three().alias("text"))


KEYED = dict(letter="substr('ABC', CAST(p_size % 5 AS INT), 1)", where="p_size % 5 BETWEEN 1 AND 3")


@query(record("ai2_arc", "mcq", ASK(prompts.MCQ, "p_name", CHOICES), **KEYED))
def source_arc(spark, sf):
    """The answer is one of the choices' labels; another one drops the row."""
    return made(parts(spark, sf).select("idx", F.col("p_name").alias("question"), labelled_choices().alias("choices"), F.pmod("p_size", F.lit(5)).cast("string").alias("answerKey")), "ai2_arc", "mcq")


@query(record("openbookqa", "mcq", ASK(prompts.MCQ, "p_name", CHOICES), **KEYED))
def source_openbook(spark, sf):
    return made(parts(spark, sf).select("idx", F.col("p_name").alias("question_stem"), labelled_choices().alias("choices"), F.pmod("p_size", F.lit(5)).cast("string").alias("answerKey")), "openbookqa", "mcq")


@query(record("squad_v2", "unanswerable", f"replace(replace({quoted(prompts.ABSTAIN)}, 'Passage: %s', 'Passage: ' || substr(repeat(p_name || ' ', 200), 1, 1200)), 'Question: %s', 'Question: ' || p_type)", "p_size % 2 = 0", "'UNANSWERABLE'"))
def source_squad(spark, sf):
    """Only questions without an answer; the passage is cut to 1,200 characters."""
    answers = F.struct(F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("text"))
    return made(parts(spark, sf).select("idx", F.concat(F.lit(" "), F.repeat(F.concat("p_name", F.lit(" ")), 200)).alias("context"), F.col("p_type").alias("question"), answers.alias("answers")), "squad_v2", "unanswerable")


@query(record("misconceptions_tf", "tf", ASK(prompts.TRUE_FALSE, "p_name"), "p_size % 3 < 2", "CASE WHEN p_size % 3 = 1 THEN 'True' ELSE 'False' END"))
def source_misconceptions(spark, sf):
    """Verdicts that are no number drop the row."""
    return made(parts(spark, sf).select("idx", F.col("p_name").alias("Question"), F.when(F.col("p_size") % 3 < 2, (F.col("p_size") % 3).cast("string")).otherwise("?").alias("Correct")), "misconceptions_tf", "tf")


SHUFFLED = f"(SELECT string_agg(substr('ABCD', CAST(k AS INT), 1) || '. ' || c, {NL} ORDER BY k) FROM (SELECT c, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', 'sciq', p_partkey, i)), i) AS k FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest([p_brand, p_type, 'none of ' || p_brand, p_name]) AS c)))"
PLACE = f"(SELECT CAST(k AS INT) FROM (SELECT i, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', 'sciq', p_partkey, i)), i) AS k FROM (SELECT unnest([0, 1, 2, 3]) AS i)) WHERE i = 3)"


@query(record("sciq", "mcq", ASK(prompts.MCQ, "p_name", SHUFFLED), "true", f"substr('ABCD', {PLACE}, 1)"))
def source_sciq(spark, sf):
    """The right answer is shuffled among three others, by a seed of its own for each row."""
    return made(parts(spark, sf).select("idx", F.col("p_name").alias("question"), F.col("p_brand").alias("distractor1"), F.col("p_type").alias("distractor2"), F.concat(F.lit("none of "), "p_brand").alias("distractor3"), F.col("p_name").alias("correct_answer")), "sciq", "mcq")


@query(record("trivia_qa", "qa", ASK(prompts.QA, "p_name"), aliases="CASE WHEN p_size % 2 = 0 THEN lower(p_brand) || '|' || lower(p_type) ELSE p_type END"))
def source_trivia(spark, sf):
    aliases = F.when(F.col("p_size") % 2 == 0, F.array(F.lower("p_brand"), F.lower("p_type"))).otherwise(F.array().cast("array<string>"))
    return made(parts(spark, sf).select("idx", F.concat("p_name", F.lit("  ")).alias("question"), F.struct(aliases.alias("normalized_aliases"), F.col("p_type").alias("value")).alias("answer")), "trivia_qa", "qa")


TESTED = f"'def test_a():' || {NL} || '    assert f(' || p_size || ')' || {NL} || 'def helper(x): pass' || {NL} || 'def test_b2(): pass'"


@query(record("KodCode-V1", "code", f"replace(replace({quoted(prompts.CODE)}, '%s' || {NL} || {NL} || 'Write', p_name || {NL} || {NL} || 'Write'), 'satisfy:' || {NL} || '%s', 'satisfy:' || {NL} || {TESTED})", "p_size % 4 > 1 OR p_size % 4 = 1 AND p_partkey % 2 = 0", preamble=TESTED, setup="''", tests=f"'test_a()' || {NL} || 'test_b2()'"))
def source_kodcode(spark, sf):
    """Rows that were filtered, are too close to a benchmark, or have no test function go; the import of the solution is taken out."""
    with_import = F.concat(F.lit("from solution import f\n"), F.lit("def test_a():\n    assert f("), F.col("p_size").cast("string"), F.lit(")\ndef helper(x): pass\nfrom solution import *\ndef test_b2(): pass"))
    four = F.col("p_size") % 4
    return made(parts(spark, sf).select("idx", F.col("p_name").alias("question"), F.when((four == 1) & (F.col("p_partkey") % 2 == 1), "x = 1").otherwise(with_import).alias("test"), F.when((four == 0) & (F.col("p_partkey") % 2 == 0), "dup").alias("filter_reason"), F.when((four == 0) & (F.col("p_partkey") % 2 == 1), 0.97).when(four == 2, 0.5).alias("benchmark_similarity")), "KodCode-V1", "code")


@query(record("mbpp", "code", f"replace(replace({quoted(prompts.CODE)}, '%s' || {NL} || {NL} || 'Write', p_name || {NL} || {NL} || 'Write'), 'satisfy:' || {NL} || '%s', 'satisfy:' || {NL} || 'assert a' || {NL} || 'assert ' || p_size)", setup="CASE WHEN p_size % 2 = 0 THEN 'import x' ELSE '' END", tests="'assert a|assert ' || p_size"))
def source_mbpp(spark, sf):
    return made(parts(spark, sf).select("idx", F.col("p_name").alias("text"), F.array(F.lit("assert a"), F.concat(F.lit("assert "), F.col("p_size").cast("string"))).alias("test_list"), F.when(F.col("p_size") % 2 == 0, "import x").alias("test_setup_code")), "mbpp", "code")


@query(record("anything", "free", "CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE p_name END"))
def source_free_form(spark, sf):
    """The first field that isn't empty of query, instruction and prompt."""
    three = F.col("p_size") % 3
    return made(parts(spark, sf).select("idx", F.when(three == 0, F.col("p_brand")).otherwise("").alias("query"), F.when(three == 1, F.col("p_type")).alias("instruction"), F.col("p_name").alias("prompt")), "anything", "free")


ORDER = f"md5(concat_ws(':', '{SEED}', 'org/anything', 'train', p_partkey))"


@query(f"WITH o AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, p_partkey) AS k FROM part), f AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM o WHERE k <= 120 AND p_partkey % 3 <> 0) SELECT 'anything-main-train-' || p_partkey AS id, p_name AS prompt FROM f WHERE place <= 60")
def source_pool(spark, sf):
    """Twice as many rows as wanted are drawn, ids used before go, and the first of the rest are kept."""
    rows = parts(spark, sf).select("idx", F.col("p_name").alias("prompt"))
    used = rows.where("idx % 3 = 0").select(F.concat(F.lit("anything-main-train-"), "idx").alias("id"))
    return prompts.pool(rows, {"dataset": "org/anything", "domain": "shop", "kind": "free", "split": "train", "config": "main", "n": 60}, SEED, used).select("id", "prompt")


@query(f"SELECT p_partkey, {ASK(prompts.EVAL_MCQ, 'p_name', CHOICES)} AS mcq, replace({quoted(prompts.EVAL_CODE)}, '%s', p_name) AS code, p_name || {NL} || p_brand || {NL} || p_type || {NL} || 'check(' || p_size || ')' AS program FROM part")
def evaluation_items(spark, sf):
    """Prompts of the evaluations, and the program that judges code: prompt, code, tests and the call of the check."""
    ask, _ = prompts.mcq(F.col("p_name"), three(), F.lit(0), prompts.EVAL_MCQ)
    program = chat.eval_program(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"))
    return parts(spark, sf).select("p_partkey", ask.alias("mcq"), F.format_string(prompts.EVAL_CODE, F.col("p_name")).alias("code"), program.alias("program"))


# ---- teacher's top-k ----------------------------------------------------

DOUBLES = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
TOP = "f AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS id FROM v), k AS (SELECT vec_id, id, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) AS r FROM f)"


def stored_topk(spark, sf: str) -> DataFrame:
    """The top 4 of every third vector's logits, written in two appends and read again."""
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("int").alias("sample"), F.pmod("vec_id", F.lit(4)).cast("int").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("values"), "vec_id")
    top = teacher_topk.reduced(rows.where("vec_id % 3 = 0").drop("vec_id"), 4)
    path = fresh_path(spark, "topk")
    teacher_topk.append(top.where("sample % 2 = 0"), path)
    teacher_topk.append(top.where("sample % 2 = 1"), path)
    return teacher_topk.read(spark, path)


@query(f"WITH {DOUBLES}, {TOP}, t AS (SELECT vec_id, string_agg(id, ',' ORDER BY r) AS ids FROM k WHERE r <= 4 GROUP BY vec_id) SELECT CAST(e.vec_id // 4 AS INT) AS sample, CAST(e.vec_id % 4 AS INT) AS pos, e.vec_id % 3 = 0 AS has_teacher, CASE WHEN e.vec_id % 3 = 0 THEN t.ids END AS ids FROM embeddings e JOIN t ON e.vec_id = t.vec_id")
def teacher_joined(spark, sf):
    """Every position with the teacher's tokens, masked where there are none."""
    positions = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("int").alias("sample"), F.pmod("vec_id", F.lit(4)).cast("int").alias("pos"))
    return teacher_topk.joined(positions, stored_topk(spark, sf)).select("sample", "pos", "has_teacher", F.array_join("ids", ",").alias("ids"))


@query("SELECT DISTINCT CAST(vec_id // 4 AS INT) AS sample FROM embeddings WHERE CAST(vec_id // 4 AS INT) NOT IN (SELECT CAST(vec_id // 4 AS INT) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id < 100)")
def teacher_missing(spark, sf):
    """Samples that the store has nothing for."""
    samples = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("int").alias("sample")).distinct()
    return teacher_topk.missing(samples, stored_topk(spark, sf).where("sample * 4 + pos < 100"))


@query("SELECT conv_id, turn, arg_max(domain, id) AS domain FROM (SELECT c.conv_id, c.turn, 'conv' || (x.conv_id % 3) AS domain, x.conv_id * 1000 + x.turn AS id FROM conversations c JOIN conversations x ON c.text = x.text AND x.role = 'user') GROUP BY conv_id, turn")
def domains_by_prompt(spark, sf):
    """Samples find their domain by the text of their prompt; of equal prompts the last one counts."""
    c = table(spark, sf, "conversations")
    known = c.where("role = 'user'").select(F.col("text").alias("prompt"), F.concat(F.lit("conv"), (F.col("conv_id") % 3).cast("string")).alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return teacher_topk.domains_by_prompt(c.select("conv_id", "turn", F.col("text").alias("prompt")), known).select("conv_id", "turn", "domain")


# ---- evaluation ---------------------------------------------------------

@query(f"""WITH {LOG}, s AS (SELECT user_id, event_id % 4 AS q, run, CASE WHEN forced THEN 'forced' ELSE 'plain' END AS mode, max(CAST(seconds AS DOUBLE)) AS v FROM e GROUP BY ALL)
    SELECT user_id, q, max(v) FILTER (WHERE mode = 'plain') AS plain, max(v) FILTER (WHERE mode = 'forced') AS forced FROM s GROUP BY user_id, q""")
def paired_modes(spark, sf):
    """One column for each way of decoding, null where a way is missing."""
    rows = log(spark, sf).withColumn("q", F.pmod("event_id", F.lit(4))).withColumn("mode", F.when(F.col("forced"), "forced").otherwise("plain"))
    rows = rows.groupBy("user_id", "q", "mode").agg(F.max("seconds").alias("v"))
    return evals.paired(rows, ["user_id", "q"], "mode", "v", ["plain", "forced"])


@query(f"WITH {LOG} SELECT run, round(100.0 * count(*) FILTER (WHERE truncated) / count(*), 9) AS truncated_pct, round(100.0 * count(*) FILTER (WHERE correct) / count(*), 9) AS correct_pct, round(avg(seconds), 6) AS mean_tokens FROM e GROUP BY run")
def truncation_by_run(spark, sf):
    out = evals.truncation(log(spark, sf).withColumn("tokens", F.col("seconds")), "run")
    return out.select("run", F.round("truncated_pct", 9).alias("truncated_pct"), F.round("correct_pct", 9).alias("correct_pct"), F.round("mean_tokens", 6).alias("mean_tokens"))


PUBLISHED = f"{LOG}, s AS (SELECT run, benchmark, count(*) AS total, count(*) FILTER (WHERE correct) AS correct FROM e GROUP BY run, benchmark), w AS (SELECT *, round_even(CAST(correct AS DOUBLE) / total, 4) + CASE WHEN benchmark = 'view' THEN 0.002 WHEN benchmark = 'click' THEN 0.0005 ELSE 0 END AS accuracy FROM s)"


@query(f"WITH {PUBLISHED} SELECT run, benchmark FROM w WHERE abs(CAST(correct AS DOUBLE) / total - accuracy) >= 0.001")
def consistency_check(spark, sf):
    """Published accuracies that don't fit their counts; those of one benchmark are off by two thousandths, of another by half of one."""
    s = evals.summary(log(spark, sf), "run", "benchmark")
    off = F.when(F.col("benchmark") == "view", 0.002).when(F.col("benchmark") == "click", 0.0005).otherwise(0.0)
    return evals.inconsistent(s.withColumn("accuracy", F.col("accuracy") + off)).select("run", "benchmark")


@query(f"WITH {PUBLISHED}, a AS (SELECT run AS model, benchmark, accuracy, total FROM w WHERE run <> 'r2' UNION ALL SELECT run || ' (this run)', benchmark, accuracy, total FROM w WHERE run = 'r2') SELECT * FROM a")
def baseline_and_runs(spark, sf):
    """Results as they are published (one JSON document) together with those of an own run."""
    s = evals.summary(log(spark, sf), "run", "benchmark").collect()
    off = {"view": 0.002, "click": 0.0005}
    cell = lambda r: {"accuracy": round(r["accuracy"] + off.get(r["benchmark"], 0), 6), "correct": r["correct"], "total": r["total"], "seconds": r["seconds"]}
    models: dict[str, dict] = {}
    for r in s:
        if r["run"] != "r2":
            models.setdefault(r["run"], {"note": "as published"})[r["benchmark"]] = cell(r)
    path = fresh_path(spark, "published")
    spark.createDataFrame([(json.dumps({"models": models}),)], "value string").write.text(path)
    own = [(r["run"], r["benchmark"], cell(r)["accuracy"], r["total"]) for r in s if r["run"] == "r2"]
    runs = spark.createDataFrame(own, "model string, benchmark string, accuracy double, total int")
    published = jsonl.results(spark, path).where("benchmark <> 'note'").select("model", "benchmark", "accuracy", "total")
    return evals.with_baseline(published, runs).select("model", "benchmark", "accuracy", F.col("total").cast("long").alias("total"))


TERM = "exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2))"


@query(f"WITH {LOG}, a AS (SELECT event_id // 2 AS id, correct FROM e WHERE event_id % 2 = 0), z AS (SELECT event_id // 2 AS id, correct FROM e WHERE event_id % 2 = 1), c AS (SELECT count(*) FILTER (WHERE a.correct AND NOT z.correct) AS lost, count(*) FILTER (WHERE z.correct AND NOT a.correct) AS gained FROM a JOIN z ON a.id = z.id), t AS (SELECT lost, gained, lost + gained AS d, unnest(range(least(lost, gained) + 1)) AS i FROM c) SELECT lost, gained, round(least(1.0, 2 * sum({TERM})), 6) AS p FROM t GROUP BY lost, gained")
def mcnemar(spark, sf):
    """Exact p-value of the discordant items of two runs."""
    rows = log(spark, sf).withColumn("id", F.floor(F.col("event_id") / 2))
    r = evals.regressions(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))
    return evals.tested(r).select("lost", "gained", F.round("p", 6).alias("p"))


@query(f"""WITH {LOG}, l AS (SELECT benchmark, run, user_id // 3 AS item, correct FROM e QUALIFY row_number() OVER (PARTITION BY benchmark, run, user_id // 3 ORDER BY event_id DESC) = 1),
    c AS (SELECT x.benchmark, x.run AS a, y.run AS b, count(*) AS common, count(*) FILTER (WHERE x.correct AND NOT y.correct) AS lost, count(*) FILTER (WHERE y.correct AND NOT x.correct) AS gained
        FROM l x JOIN l y ON x.benchmark = y.benchmark AND x.item = y.item AND x.run < y.run GROUP BY ALL),
    t AS (SELECT *, lost + gained AS d, unnest(range(least(lost, gained) + 1)) AS i FROM c)
    SELECT benchmark, a, b, common, lost, gained, round(CASE WHEN d = 0 THEN 0 ELSE (gained - lost) / sqrt(d) END, 6) AS z, round(least(1.0, 2 * sum({TERM})), 6) AS p FROM t GROUP BY ALL""")
def mcnemar_pairs(spark, sf):
    """Every two runs against one another on each benchmark, by the last record of each item: the exact p-value and z."""
    rows = log(spark, sf).withColumn("item", F.floor(F.col("user_id") / 3))
    out = evals.tested(evals.compared(rows, "item", "event_id", "benchmark"))
    return out.select("benchmark", "a", "b", "common", "lost", "gained", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(f"""WITH {LOG}, s AS (SELECT run, benchmark, count(*) AS n, round_even(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*), 4) AS a FROM e GROUP BY run, benchmark),
    c AS (SELECT run, benchmark, printf('%.1f%%', a * 100) AS cell FROM s) SELECT run AS model, max(cell) FILTER (WHERE benchmark = 'view') AS view, max(cell) FILTER (WHERE benchmark = 'click') AS click FROM c GROUP BY run""")
def report_table(spark, sf):
    """The lines of the printed report, read back from its Markdown form."""
    s = evals.summary(log(spark, sf), "run", "benchmark").withColumnRenamed("run", "model")
    text = report.markdown(report.rows(s, ["view", "click"]))
    lines = [tuple(x.strip() for x in line.strip("| ").split("|")) for line in text.split("\n")[2:]]
    return spark.createDataFrame(lines, "model string, view string, click string")


# ---- files and settings -------------------------------------------------

@query("SELECT conv_id, turn, role, md5(text) AS text, CAST(CASE WHEN role = 'user' THEN 1 ELSE 2 END AS INT) AS file, row_number() OVER (PARTITION BY role = 'user' ORDER BY conv_id, turn, role, text) - 1 AS line_no FROM conversations")
def ordered_scan(spark, sf):
    """Files in the order of their names, with the true number of every line: here that of the order in which they were written."""
    c, path = table(spark, sf, "conversations"), fresh_path(spark, "ordered")
    for k, rows in enumerate((c.where("role <> 'user'"), c.where("role = 'user'"))):  # the later file has the earlier name
        rows.orderBy("conv_id", "turn", "role", "text").coalesce(1).write.json(f"{path}/{1 - k}-log")
    with Scratch() as keep:
        out = jsonl.scan_ordered(spark, [f"{path}/0-log", f"{path}/1-log"], "conv_id long, turn long, role string, text string", keep=keep)
        return stored(out.select("conv_id", "turn", "role", F.md5("text").alias("text"), (F.col("file_order") + 1).cast("int").alias("file"), "line_no"), "ordered")


@query("SELECT conv_id, turn, role, md5(text) AS text, row_number() OVER (ORDER BY role <> 'user', conv_id, turn, role, text) - 1 AS number FROM conversations")
def ordered_lines(spark, sf):
    """The number of every line over all files of a scan, many files in two folders."""
    c, path = table(spark, sf, "conversations"), fresh_path(spark, "ordered")
    for k, rows in enumerate((c.where("role = 'user'"), c.where("role <> 'user'"))):
        rows.repartitionByRange(5, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").write.json(f"{path}/{k}-log")
    with Scratch() as keep:
        out = jsonl.scan_ordered(spark, [f"{path}/0-log", f"{path}/1-log"], "conv_id long, turn long, role string, text string", keep=keep)
        return stored(out.select("conv_id", "turn", "role", F.md5("text").alias("text"), "number"), "numbered")


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def stats_file(spark, sf):
    """A counter table written as one JSON object and read again."""
    path = fresh_path(spark, "stats") + ".json"
    counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    jsonl.write_stats(counted, path)
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")).alias("key", "n"))
    return back


@query("SELECT n_nationkey, n_name || '/' || (n_nationkey * 2) AS value, 'other-' || n_name AS fallback, CASE n_regionkey WHEN 0 THEN 'base' WHEN 1 THEN 'base-' || n_name WHEN 2 THEN 'teach-' || n_name ELSE n_name END AS path FROM nation")
def settings_lookup(spark, sf):
    """Placeholders and model references of a configuration, for every row of a table."""
    name = F.col("n_name")
    env = F.create_map(F.lit("NAME"), name, F.lit("TWICE"), (F.col("n_nationkey") * 2).cast("string"))
    ref = F.when(F.col("n_regionkey") == 0, "student").when(F.col("n_regionkey") == 1, F.concat(F.lit("student:"), name)).when(F.col("n_regionkey") == 2, F.concat(F.lit("teacher:"), name)).otherwise(name)
    path = settings.model_of(Settings(), ref, F.lit("base"), F.create_map(name, F.concat(F.lit("base-"), name)), F.create_map(name, F.concat(F.lit("teach-"), name)))
    return table(spark, sf, "nation").select("n_nationkey", settings.expanded_in(F.lit("${NAME}/${TWICE}"), env).alias("value"), settings.expanded_in(F.concat(F.lit("${UNSET:-other-"), name, F.lit("}")), env).alias("fallback"), path.alias("path"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'short' WHEN n_regionkey IN (1, 2) THEN 'calm' END AS style, CASE n_regionkey WHEN 0 THEN 512 WHEN 1 THEN 900 ELSE 700 END AS budget FROM nation")
def style_and_budget(spark, sf):
    """The style of a domain, else its teacher's; the budget of a kind, else the default."""
    cfg = Settings(teachers={"one": {"domains": ["0", "1", "2"], "style": "calm"}, "two": {"domains": ["3", "4"]}}, styles={"0": "short"}, budgets={"0": 512, "1": 900, "default": 700})
    domain = F.col("n_regionkey").cast("string")
    return table(spark, sf, "nation").select("n_nationkey", settings.style_of(cfg, domain, settings.teacher_of(cfg, domain)).alias("style"), settings.budget_of(cfg, domain).alias("budget"))


# ---- flat parts with offsets, and the loss they are for -----------------

@query("SELECT CAST(vec_id AS BIGINT) AS sample, CAST(i - 1 AS INT) AS pos, round(CAST(e[i] AS DOUBLE), 9) AS value FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT vec_id, list_filter(embedding, lambda x: x > 0) AS e FROM embeddings))")
def ragged_round_trip(spark, sf):
    """Rows of different lengths (a vector's positive components), written as flat parts with offsets and put together again."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("sample"), F.posexplode(F.filter("embedding", lambda x: x > 0)).alias("pos", "value"))
    path = fresh_path(spark, "ragged")
    ragged.write(rows, path, parts=5)
    return ragged.read(spark, path).select("sample", "pos", F.round(F.col("value").cast("double"), 9).alias("value"))


SCALED = "list_transform(embedding, lambda x: 4 * CAST(x AS DOUBLE))"
LSE = lambda e: f"(list_max({e}) + ln(list_sum(list_transform({e}, lambda x: exp(x - list_max({e}))))))"


@query(f"""WITH s AS (SELECT CAST(vec_id // 8 AS INT) AS sample, CAST(vec_id % 8 + 1 AS INT) AS step, {SCALED} AS e, CAST(vec_id * 7 % 64 AS INT) AS target FROM embeddings),
    p AS (SELECT *, 2 + sample % 3 AS prompt_len, 8 - sample % 2 AS last, {LSE('e')} AS z FROM s),
    f AS (SELECT sample, step, prompt_len, last, unnest(e) AS x, unnest(list_transform(e, lambda x: -x / 2)) AS t, unnest(range(len(e))) AS id, z FROM p WHERE sample % 5 <> 0 AND step >= prompt_len AND step < last),
    g AS (SELECT *, CAST(t - ln(sum(exp(t)) OVER w) AS FLOAT) AS lp, row_number() OVER (PARTITION BY sample, step ORDER BY t DESC, id) AS r FROM f WINDOW w AS (PARTITION BY sample, step)),
    k AS (SELECT *, CAST(lp AS DOUBLE) - ln(sum(exp(CAST(lp AS DOUBLE))) OVER (PARTITION BY sample, step)) AS q FROM g WHERE r <= 6),
    d AS (SELECT sample, step, sum(exp(q) * (q - (x - z))) AS kl FROM k GROUP BY sample, step),
    c AS (SELECT p.sample, count(*) AS n_tokens, count(d.kl) AS n_teacher, avg(z - e[target + 1]) AS ce, coalesce(avg(d.kl), 0) AS kl FROM p LEFT JOIN d ON p.sample = d.sample AND p.step = d.step
        WHERE p.step BETWEEN prompt_len AND last GROUP BY p.sample)
    SELECT sample, n_tokens, n_teacher, round(ce, 6) AS ce, round(kl, 6) AS kl, round(0.3 * ce + 0.7 * kl, 6) AS loss FROM c""")
def distillation_loss(spark, sf):
    """Cross entropy on the answer and divergence from the stored top 6 of a teacher, mixed by sample; every fifth sample has no teacher. A vector is the logits of a step, eight of them a sequence."""
    sample, step = F.floor(F.col("vec_id") / 8).cast("int"), (F.col("vec_id") % 8 + 1).cast("int")
    steps = table(spark, sf, "embeddings").select(
        sample.alias("sample"), step.alias("step"), F.transform("embedding", lambda x: 4 * x.cast("double")).alias("logits"), (F.col("vec_id") * 7 % 64).cast("int").alias("target"),
        (2 + sample % 3).alias("prompt_len"), (8 - sample % 2).alias("end"),
    )
    scored = steps.where("sample % 5 <> 0 AND step >= prompt_len").select("sample", (F.col("step") - F.col("prompt_len")).alias("pos"), F.transform("logits", lambda x: -x / 2).alias("values"))
    path = fresh_path(spark, "topk")
    teacher_topk.append(teacher_topk.reduced(scored, 6), path)
    out = distill.losses(distill.with_teacher(steps, teacher_topk.read(spark, path)), 0.3, "sample")
    return out.where("n_tokens > 0").select("sample", "n_tokens", "n_teacher", *[F.round(c, 6).alias(c) for c in ("ce", "kl", "loss")])


# ---- completions and programs -------------------------------------------

END = "{NL} || {NL} || {sentence} || {NL} || '</think>' || {NL} || {NL}".format(NL=NL, sentence=quoted(chat.FORCE_SENTENCE))
RAWS = [f"'<think>' || text || {END} || 'Answer: x'", "'<think>' || text", "'<think>short</think>Answer: y'", "'Answer: ' || text", "'<think>' || text || '</think>' || ' '", f"'done</think> so' || {END} || 'Answer: z'", f"'<think>' || text || {END}"]


@query(f"""WITH s AS (SELECT doc_id, doc_id % {len(RAWS)} AS k, n_chars // 4 >= 300 - 50 - 2 AS reached FROM documents)
    SELECT doc_id, k = 1 AS "open", k IN (0, 6) AND reached AS forced, k IN (1, 4, 6) AS truncated FROM s""")
def completion_state(spark, sf):
    """Whether a completion's thought is open, was closed for it at its budget, and whether it has no answer: from the raw text, the tokens and the budget."""
    table(spark, sf, "documents").createOrReplaceTempView("documents_of_completions")
    rows = spark.sql(f"SELECT doc_id, CAST(floor(n_chars / 4) AS INT) AS tokens, {chosen(RAWS)} AS raw FROM documents_of_completions")
    s = rows.select("doc_id", state(F.col("raw"), False, F.col("tokens"), F.lit(300), 50).alias("s"))
    return s.select("doc_id", "s.open", "s.forced", "s.truncated")


def reader():
    """A model whose answer needs a token for every 100 characters of its prompt; with fewer it doesn't get to an end."""

    def model(prompts, system, most):
        need = [len(p) // 100 for p in prompts]
        return [{"raw": "Answer: read" if n <= most else "<think>reading", "tokens": min(n, most), "seconds": 0.0} for n in need]

    return model


@query("SELECT 'd' || doc_id AS id, CAST(least(length(text) // 100, CASE WHEN length(text) // 100 <= 8 THEN 8 WHEN length(text) // 100 <= 12 THEN 12 WHEN length(text) // 100 <= 18 THEN 18 ELSE 8 END) AS INT) AS gen_tokens, length(text) // 100 > 18 AS truncated, CASE WHEN length(text) // 100 <= 8 THEN 1 WHEN length(text) // 100 <= 12 THEN 2 ELSE 3 END AS asks FROM documents")
def resumed_rounds(spark, sf):
    """Documents read by a model in rounds of growing budgets; the run is broken off twice and started again, and nothing is asked twice."""
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("prompt"))
    held = Log(spark, fresh_path(spark, "rounds"), ROUND)
    per_commit = max(1, rows.count() // 4)
    for stop in (2, 5, None):  # within the first round, at its end, and then to the last
        done = escalated(rows, reader, "", F.lit(8), 2, F.col("truncated"), always=False, log=held, per_commit=per_commit, commits=stop)
    asks = held.read().groupBy("id").agg(F.count("*").alias("asks"))
    return done.join(asks, "id").select("id", "gen_tokens", "truncated", "asks")


PROGRAMS = [  # by part, with the outcome; the fifth asks for more memory than it may have, the sixth leaves a process behind
    ("'assert ' || p_size || ' < 51'", "true", "'code:ok'"),
    ("'assert ' || p_size || ' > 50'", "false", "'code:AssertionError'"),
    ("'def f(:'", "false", "'code:SyntaxError: invalid syntax'"),
    ("'while True: pass'", "false", "'code:timeout'"),
    ("'x = bytearray(1 << 33)'", "false", "'code:MemoryError'"),
    (f"'import os, time' || {NL} || 'if os.fork() == 0:' || {NL} || '    time.sleep(60)'", "true", "'code:ok'"),
    ("'raise ValueError(' || p_size || ')'", "false", "'code:ValueError: ' || p_size"),
]


@query(f"SELECT p_partkey, {chosen([p for _, p, _ in PROGRAMS], 'p_partkey')} AS passed, {chosen([w for _, _, w in PROGRAMS], 'p_partkey')} AS why FROM part")
def programs(spark, sf):
    """Programs made of parts, run in processes with limits: equal ones once, endless ones stopped, what they start killed with them."""
    table(spark, sf, "part").createOrReplaceTempView("part_of_programs")
    rows = spark.sql(f"SELECT p_partkey, {chosen([p for p, _, _ in PROGRAMS], 'p_partkey')} AS program FROM part_of_programs")
    return code.executed(rows, enabled=True, timeout=3.0).select("p_partkey", "passed", code.why(F.col("error")).alias("why"))
