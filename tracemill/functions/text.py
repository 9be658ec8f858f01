"""Text functions as Column expressions: normalisation, answers, thoughts, code blocks.

They follow the semantics of Python's re and str methods where Java's differ:
(?U) makes classes Unicode-aware, (?d) keeps line ends to newline, and strip()
is a regular expression because trim() only knows the blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and patterns that decide results.
DECLINES = (
    "i don't know", "i do not know", "don't know", "do not know",
    "not sure", "unsure", "cannot say", "can't say", "no reliable",
    "not confident", "unable to say", "i'm not certain", "i am not certain",
)
ABSTAINS = (
    "not stated", "does not", "doesn't", "no answer", "not provide",
    "not mention", "not contain", "cannot be determined", "unanswerable",
)
JUDGEMENT = r"(?i)(passage|text|document|context|article)[^.]{0,80}?(does not|doesn't|never|no mention|not mention|not state|not contain|not provide|is silent)"
NOISE = r"(?i)answer:|final line|sentences?\)|looks solid|end of thought|output matches|format|->|say so plainly|guessing|✅|\[done\]"
ANSWER_LINE = r"(?imd)answer\s*:\s*(.+?)\s*$"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OPEN, CLOSE = "<think>", "</think>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once.

    The optimizer copies a derived column into every place that uses it, also
    into lambdas, where it would run once per element. A lambda variable can't
    be copied, so the value is bound to one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _bare(c: Column) -> Column:
    """Lower case, without ASCII punctuation, articles as blanks."""
    return F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), r"(?U)\b(a|an|the)\b", " ")


def normalize(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    return strip(F.regexp_replace(_bare(c), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """The words of the normalised text; none for an empty one."""
    return F.filter(F.split(_bare(c), r"(?U)\s+"), lambda x: x != "")


def final_answer(c: Column) -> Column:
    """What the last 'answer:' line says, or null."""
    return strip(F.try_element_at(F.regexp_extract_all(strip(c), F.lit(ANSWER_LINE), F.lit(1)), F.lit(-1)))


def said(c: Column) -> Column:
    """The final answer, or the whole text if there is none."""
    answer = final_answer(c)
    return F.when(answer != "", answer).otherwise(c)


def final_letter(c: Column, choices: int = 26) -> Column:
    """The letter chosen: the first standalone one of the final answer, else its first character, else the last standalone one of the tail."""
    valid = LETTERS[:choices]
    ok = lambda x: x.isNotNull() & (x != "") & F.contains(F.lit(valid), x)
    letters = lambda x: F.regexp_extract_all(F.upper(x), F.lit(r"(?U)\b([A-Z])\b"), F.lit(1))
    tail = F.try_element_at(letters(F.right(c, F.lit(400))), F.lit(-1))

    def of(answer: Column) -> Column:
        first = F.try_element_at(letters(answer), F.lit(1))
        head = F.upper(F.substring(F.regexp_replace(strip(answer), r"^[(*\[ ]+", ""), 1, 1))
        return F.when(answer.isNotNull() & ok(first), first).when(answer.isNotNull() & ok(head), head).when(ok(tail), tail)

    return let(final_answer(c), of)


def qa_match(prediction: Column, aliases: Column) -> Column:
    """Whether a normalised alias is in the normalised answer."""
    return let(normalize(said(prediction)), lambda p: F.exists(aliases, lambda a: (normalize(a) != "") & F.contains(p, normalize(a))))


def _has_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    return let(F.lower(said(c)), lambda x: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(x, p)))


def declines(c: Column) -> Column:
    return _has_phrase(c, DECLINES)


def abstains(c: Column) -> Column:
    return _has_phrase(c, ABSTAINS)


def true_false_match(c: Column, gold: Column) -> Column:
    """Whether the final answer, without its last dots, starts with gold."""
    answer = F.regexp_replace(F.lower(strip(F.coalesce(final_answer(c), F.lit("")))), r"\.+$", "")
    return F.startswith(answer, F.lower(gold))


def abstention_sentence(c: Column) -> Column:
    """The last sentence that says the passage doesn't answer, or null."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(strip(s), r'^"+|"+$', ""), r"^[- ]+", "")
    sentences = F.transform(F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)(?<=[.!?])\s+"), bare)
    fits = lambda s: (F.char_length(s) > 30) & (F.char_length(s) < 300) & s.rlike(JUDGEMENT) & ~s.rlike(NOISE)
    return F.try_element_at(F.filter(sentences, fits), F.lit(-1))


def split_think(raw: Column, pre_opened: Column | bool = False) -> Column:
    """struct(answer, think) of a raw completion."""
    pre = F.lit(pre_opened) if isinstance(pre_opened, bool) else pre_opened
    pair = r"(?s)<think>(.*?)</think>"
    make = lambda answer, think: F.struct(answer.alias("answer"), think.alias("think"))

    def of(r: Column) -> Column:
        before = F.substring_index(r, CLOSE, 1)
        after = F.substring(r, F.instr(r, CLOSE) + F.lit(len(CLOSE)), F.char_length(r))
        opened = F.substring(r, F.instr(r, OPEN) + F.lit(len(OPEN)), F.char_length(r))
        return (
            F.when(r.rlike(pair), make(strip(F.regexp_replace(r, r"(?s)<think>.*?</think>", "")), strip(F.regexp_extract(r, pair, 1))))
            .when(F.contains(r, F.lit(CLOSE)), make(strip(after), strip(F.regexp_replace(before, r"^<think>", ""))))
            .when(F.contains(r, F.lit(OPEN)), make(F.lit(""), strip(opened)))
            .when(pre, make(F.lit(""), r))
            .otherwise(make(r, F.lit(None).cast("string")))
        )

    return let(strip(raw), of)


def opens_think(prompt: Column) -> Column:
    """Whether a rendered prompt ends inside an open thought."""
    return F.contains(prompt, F.lit(OPEN)) & ~F.contains(F.substring_index(prompt, OPEN, -1), F.lit(CLOSE))


def unclosed(text: Column, pre_opened: Column | bool = False) -> Column:
    """Whether a completion never closes its thought."""
    pre = F.lit(pre_opened) if isinstance(pre_opened, bool) else pre_opened
    return ~F.contains(text, F.lit(CLOSE)) & (pre | F.contains(text, F.lit(OPEN)))


def strip_force(think: Column, sentence: str) -> Column:
    """The thought without the sentence that forced its end."""
    right = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    return let(right(think), lambda t: F.when(F.endswith(t, F.lit(sentence)), right(F.substring(t, F.lit(1), F.char_length(t) - len(sentence)))).otherwise(t))


def extract_code(c: Column) -> Column:
    """The longest fenced block (the first of equals), else from the first line of code, else the text; without blanks around it."""
    blocks = F.regexp_extract_all(c, F.lit("(?sU)```(?:python|py)?\\s*\\n(.*?)```"), F.lit(1))
    best = let(blocks, lambda b: F.aggregate(b, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.char_length(x) > F.char_length(acc)), x).otherwise(acc)))
    start = F.regexp_extract(c, r"(?msd)^((?:from |import |def |class ).*)", 1)
    return strip(let(best, lambda b: F.when(b.isNotNull(), b).when(start != "", start).otherwise(c)))


def reason_prefix(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def last_line(c: Column, width: int = 60) -> Column:
    return F.substring(F.try_element_at(F.split(c, "\n"), F.lit(-1)), 1, width)


def tail(c: Column, width: int = 1500) -> Column:
    return F.right(c, F.lit(width))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def signed(c: Column) -> Column:
    return F.format_string("%+.1f", c)


def total_mark(total: Column, full: Column) -> Column:
    """The total, with a mark in front if the run is partial."""
    return F.when(total < full, F.concat(F.lit("~"), total.cast("string"))).otherwise(total.cast("string"))
