"""Queries that run each text function over the whole documents, put into the shapes that the function reads.

A shape is an expression that both engines understand (blanks, marks, answer
lines and fences around the text, chosen by doc_id); what the function makes of
it is written again in SQL. Long results are compared by their md5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import chat
from tracemill.operators.code import parses
from tracemill.plans.queries import ORACLE, QUERIES
from tracemill.session import table
from tracemill.sources import prompts

NL, FENCE = "chr(10)", "repeat(chr(96), 3)"
WS = r"[\s\x0b\x85\p{Z}]"


def chosen(forms: list[str], by: str = "doc_id") -> str:
    """One of the shapes for each row, in turn."""
    return f"CASE CAST({by} % {len(forms)} AS INT) " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


# ---- the functions in SQL -----------------------------------------------

def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def final_answer(t: str) -> str:
    return strip(rf"list_extract(regexp_extract_all({strip(t)}, '(?im)answer\s*:\s*(.+?)\s*$', 1), -1)")


def said(t: str) -> str:
    return f"(CASE WHEN {final_answer(t)} <> '' THEN {final_answer(t)} ELSE {t} END)"


def letters(t: str) -> str:
    return rf"list_filter(string_split_regex(upper({t}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda x: regexp_matches(x, '^[A-Z]$'))"


def final_letter(t: str, choices: int) -> str:
    valid = lambda x: f"({x} <> '' AND contains('{X.LETTERS[:choices]}', {x}))"
    first, last = f"({letters('fa')})[1]", f"({letters(f'right({t}, 400)')})[-1]"
    head = rf"upper(substr(regexp_replace({strip('fa')}, '^[(*\[ ]+', ''), 1, 1))"
    return f"CASE WHEN fa IS NOT NULL AND {valid(first)} THEN {first} WHEN fa IS NOT NULL AND {valid(head)} THEN {head} WHEN {valid(last)} THEN {last} END"


def normal(t: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(regexp_replace(lower({t}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')), ' ')"


def has_phrase(t: str, phrases: tuple[str, ...]) -> str:
    return f"len(list_filter({texts(phrases)}, lambda p: contains(lower({said(t)}), p))) > 0"


def add(name: str, forms: list[str], expression: Callable[[Column], Column], sql: str, digest: bool = False, extra: str = "", columns: tuple[str, ...] = ()) -> None:
    """Register `name`: expression over the shaped text, and its SQL over t (and fa, its final answer). extra: further parts of the WITH list, of which the last is called y."""
    shape = chosen(forms)

    def run(spark, sf: str) -> DataFrame:
        rows = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.expr(shape).alias("t"))
        out = expression(F.col("t"))
        return rows.select("doc_id", (F.md5(out) if digest else out).alias("result"))

    run.__name__ = name
    QUERIES[name] = run
    result = f"md5({sql})" if digest else sql
    ORACLE[name] = f"WITH x AS (SELECT doc_id, source, lang, n_chars, {shape} AS t FROM documents), y AS (SELECT *, {final_answer('t')} AS fa FROM x) SELECT doc_id, {result} AS result FROM y"


# ---- answers ------------------------------------------------------------

add("final_answer", [f"text || {NL} || 'Answer: ' || source || '  '", f"'ANSWER : ' || lang || {NL} || text", "text", f"'Answer: one' || {NL} || text || {NL} || 'answer:' || {NL} || ' ' || source", f"'Answer ' || lang || {NL} || text"], X.final_answer, "fa")

LETTER_FORMS = [f"text || {NL} || 'Answer: C'", f"'so (B) because' || {NL} || 'Answer: (' || substr('ABCDZ', CAST(doc_id % 5 AS INT) + 1, 1) || ') because ' || source", "text", f"text || {NL} || 'Answer: ' || lang || ' it is'", "text || ' it must be D'", f"text || {NL} || 'Answer: **' || source"]
add("final_letter", LETTER_FORMS, X.final_letter, final_letter("t", 26))
add("final_letter_of_four", LETTER_FORMS, lambda c: X.final_letter(c, 4), final_letter("t", 4))

add("qa_match", [f"text || {NL} || 'Answer: The ' || upper(source) || '!'", "'it is ' || lang || ' ' || text", f"text || {NL} || 'Answer: '", "text || ' ' || source", f"text || {NL} || 'Answer: no ' || lang"],
    lambda c: X.qa_match(c, F.array(F.concat(F.lit("an "), F.col("source")), F.lit("the"))), f"{normal('source')} <> '' AND contains({normal(said('t'))}, {normal('source')})")

SURE = "'I don' || chr(39) || 't know'"
add("declines", [f"text || {NL} || 'Answer: ' || {SURE}", f"text || {NL} || 'Answer: ' || source", "text || ' I am not sure'", f"'I am not sure' || {NL} || 'Answer: ' || lang", "text"], X.declines, has_phrase("t", X.DECLINES))
add("abstains", [f"text || {NL} || 'Answer: not stated in the passage'", "'It does not say. ' || text", f"text || {NL} || 'Answer: 1912'", "text", f"text || {NL} || 'Answer: ' || {SURE} || ', it cannot be determined'"], X.abstains, has_phrase("t", X.ABSTAINS))
add("true_false", [f"text || {NL} || 'Answer: TRUE..'", f"text || {NL} || 'Answer: false'", "'true ' || text", f"'Answer: Truly' || {NL} || text || {NL} || 'Answer: true, ' || source"], lambda c: X.true_false_match(c, F.lit("True")), r"starts_with(regexp_replace(lower(coalesce(fa, '')), '\.+$', ''), 'true')")
add("abstention_sentence", ["'Let me see. The passage does not mention the year ' || doc_id || '. Output matches requirements.'", "text", "chr(34) || 'The document is silent on ' || source || ' and on all its taxes.' || chr(34) || ' Done. ' || text", "text || ' The text never says why ' || lang || ' was chosen at all.'", "'- The article does not state ' || source || ' anywhere at all! Next'"],
    X.abstention_sentence,
    rf"""list_extract(list_filter(list_transform(string_split(regexp_replace({strip('t')}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(regexp_replace({strip('s')}, '^"+|"+$', '', 'g'), '^[- ]+', '')),
        lambda s: length(s) > 30 AND length(s) < 300 AND regexp_matches(s, {quoted(X.JUDGEMENT)}) AND NOT regexp_matches(s, {quoted(X.NOISE)})), -1)""")


# ---- thoughts -----------------------------------------------------------

THOUGHTS = ["'<think>' || text || '</think>' || source", "text || '</think> ' || lang", "'<think> ' || text", "text", "'<think> a </think>' || lang || '<think>' || text || '</think> ' || source", f"{NL} || '<think>' || text || '</think>' || {NL}"]
PAIR, BARE = "regexp_matches(r, '(?s)<think>.*?</think>')", strip("t")
with_r = lambda sql: f"(SELECT {sql} FROM (SELECT {BARE} AS r))"
ANSWER = f"CASE WHEN {PAIR} THEN {strip(chr(114) + chr(101) + 'gexp_replace(r, ' + quoted('(?s)<think>.*?</think>') + ', ' + quoted('') + ', ' + quoted('g') + ')')} WHEN contains(r, '</think>') THEN {strip('substr(r, strpos(r, ' + quoted('</think>') + ') + 8)')} WHEN contains(r, '<think>') THEN ''"
add("split_think_answer", THOUGHTS, lambda c: X.split_think(c)["answer"], with_r(f"{ANSWER} ELSE r END"), digest=True)
add("split_think_opened", THOUGHTS, lambda c: X.split_think(c, True)["answer"], with_r(f"{ANSWER} ELSE '' END"), digest=True)
add("split_think_thought", THOUGHTS, lambda c: X.split_think(c)["think"],
    with_r(f"CASE WHEN {PAIR} THEN {strip('regexp_extract(r, ' + quoted('(?s)<think>(.*?)</think>') + ', 1)')} WHEN contains(r, '</think>') THEN {strip('regexp_replace(split_part(r, ' + quoted('</think>') + ', 1), ' + quoted('^<think>') + ', ' + quoted('') + ')')} WHEN contains(r, '<think>') THEN {strip('substr(r, strpos(r, ' + quoted('<think>') + ') + 7)')} END"), digest=True)
add("opens_think", [f"text || {NL} || '<think>' || {NL}", "'<think>' || text || '</think>'", "text", f"'<think>a</think>' || text || '<think>' || {NL}"], X.opens_think, "contains(t, '<think>') AND NOT contains(list_extract(string_split(t, '<think>'), -1), '</think>')")
add("unclosed", ["'<think>' || text", "'<think>' || text || '</think>'", "text", "text || '</think>' || source"], X.unclosed, "contains(t, '<think>') AND NOT contains(t, '</think>')")
FORCED = quoted(chat.FORCE_SENTENCE)
RIGHT = f"regexp_replace(t, '{WS}+$', '')"
add("strip_force", [f"text || {NL} || {NL} || {FORCED} || ' ' || {NL}", "text || '  '", f"{FORCED} || ' no ' || text", FORCED], lambda c: X.strip_force(c, chat.FORCE_SENTENCE),
    f"CASE WHEN ends_with({RIGHT}, {FORCED}) THEN regexp_replace(left({RIGHT}, length({RIGHT}) - {len(chat.FORCE_SENTENCE)}), '{WS}+$', '') ELSE {RIGHT} END", digest=True)


# ---- code ---------------------------------------------------------------

BLOCKS = rf"regexp_extract_all(t, '(?s)```(?:python|py)?\s*\n(.*?)```', 1)"
START = "regexp_extract(t, '(?ms)^((?:from |import |def |class ).*)', 1)"
add("extract_code", [f"text || {NL} || {FENCE} || 'python' || {NL} || 'x = ' || doc_id || {NL} || {FENCE} || {NL} || 'b' || {NL} || {FENCE} || {NL} || 'longer = ' || text || {NL} || {FENCE}", f"text || {NL} || 'def f():' || {NL} || '  return 1 ' || {NL}", f"'  ' || text || ' ' || {NL}", f"{FENCE} || 'py' || {NL} || 'aa' || {NL} || {FENCE} || {NL} || {FENCE} || {NL} || 'bb' || {NL} || {FENCE} || text", f"'  x = 1' || {NL}", f"text || {NL} || 'import os' || {NL} || 'def g(): pass' || {NL} || ' '"],
    X.extract_code,
    f"CASE WHEN len({BLOCKS}) > 0 THEN {strip(f'list_filter({BLOCKS}, lambda b: length(b) = list_max(list_transform({BLOCKS}, lambda c: length(c))))[1]')} WHEN {START} <> '' THEN {strip(START)} ELSE {strip('t')} END", digest=True)
# whether generated code is valid is known from how it was made; text by itself is taken from a row of words without sense as Python
add("code_parses", [f"text || {NL} || {FENCE} || 'python' || {NL} || 'v' || doc_id || ' = ' || n_chars || {NL} || {FENCE}", f"{FENCE} || 'python' || {NL} || 'v' || doc_id || ' = ' || {NL} || {FENCE} || text", "''", f"'def f(:' || {NL} || text", f"'  x = ' || doc_id || ' ' || {NL}", f"text || {NL} || 'def f' || doc_id || '():' || {NL} || '    return 1' || {NL}"], parses, "doc_id % 6 IN (0, 4, 5)")


# ---- pieces -------------------------------------------------------------

add("reason_prefix", ["'mcq:' || source || ':' || text", "lang"], X.reason_prefix, "regexp_extract(t, '^[^:]*')")
add("last_line", [f"text || {NL} || 'NameError: ' || source", "text", f"text || {NL}"], X.last_line, "substr(list_extract(string_split(t, chr(10)), -1), 1, 60)")
add("tail_chars", ["text", "text || source"], X.tail, "right(t, 1500)", digest=True)
END = f"{NL} || {NL} || 'Answer accurately'"
QUESTION = strip(f"split_part(t, {END}, 1)")
ASKED = [f"text || ' ' || {END} || ' and concisely.'", "text"]
add("question_of", ASKED, prompts.question_of, QUESTION, digest=True)
add("reask_prompt", ASKED, prompts.reask, f"replace({quoted(prompts.REASK)}, '%s', {QUESTION})", digest=True)
