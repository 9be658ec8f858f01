"""Source normalisers: each turns one source's rows into prompt records.

A normaliser is a projection and a filter; malformed rows become null gold or
prompt and are dropped. Rows need a column idx, their number in the source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import LETTERS, let, strip
from tracemill.operators.sampling import draw
from tracemill.schemas import GOLD

# Prompt wordings.
MCQ = "%s\n\n%s\n\nThink it through, then end your reply with a final line of exactly 'Answer: <letter>'."
TRUE_FALSE = (
    "Is the following statement true or false?\n\n%s\n\n"
    "Some statements that sound plausible are common misconceptions. Reason "
    "briefly, then end your reply with a final line of exactly 'Answer: True' "
    "or 'Answer: False'."
)
QA = (
    "%s\n\n"
    "Answer accurately and concisely. If you are not confident, say so rather than guessing. "
    "End your reply with a final line of exactly 'Answer: <answer>'."
)
ABSTAIN = (
    "Read the passage and answer the question.\n\n"
    "Passage: %s\n\nQuestion: %s\n\n"
    "If the passage does not contain the answer, say so plainly instead of "
    "guessing. End your reply with a final line of exactly "
    "'Answer: <answer>' or 'Answer: not stated in the passage'."
)
CODE = (
    "%s\n\n"
    "Write a complete Python solution. Put the final code in a single ```python block. "
    "Your function must satisfy:\n%s"
)
EVAL_MCQ = "%s\n\n%s\n\nReason briefly, then end with a final line of exactly 'Answer: <letter>'."
EVAL_CODE = (
    "Complete the following Python function. Return the full function, including "
    "the signature, in a single ```python block. Do not add example usage.\n\n"
    "```python\n%s```"
)
REASK = (
    "%s\n\n"
    "Before answering, judge honestly whether you actually know this. "
    "If you do, answer it. If you are relying on a guess, a half-remembered "
    "detail, or a plausible-sounding association, say plainly that you do not "
    "know rather than presenting a guess as fact.\n"
    "End your reply with a final line of exactly 'Answer: <answer>' or "
    "'Answer: I don't know'."
)
QUESTION_END = "\n\nAnswer accurately"
PASSAGE_CHARS = 1200


def choice_lines(choices: Column) -> Column:
    """'A. first', 'B. second', ... for up to 26 choices."""
    lettered = F.transform(F.slice(choices, 1, 26), lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), c))
    return F.array_join(lettered, "\n")


def letter(index: Column) -> Column:
    """The letter of an index from 0; null outside the alphabet."""
    return F.when((index >= 0) & (index < 26), F.substring(F.lit(LETTERS), index.cast("int") + 1, F.lit(1)))


def gold(letter: Column | None = None, aliases: Column | None = None, preamble: Column | None = None, setup: Column | None = None, tests: Column | None = None) -> Column:
    null = F.lit(None)
    parts = {"letter": letter, "aliases": aliases, "preamble": preamble, "setup": setup, "tests": tests}
    return F.struct(*[(null if v is None else v).alias(k) for k, v in parts.items()]).cast(GOLD)


def mcq(question: Column, choices: Column, index: Column, template: str = MCQ) -> tuple[Column, Column]:
    ok = (index >= 0) & (index < F.size(choices))
    return F.when(ok, F.format_string(template, strip(question), choice_lines(choices))), gold(letter=letter(index))


def shuffled(choices: Column, seed: int, *keys: Column) -> Column:
    """The choices in a seeded order of their own for each row."""
    keyed = F.transform(choices, lambda c, i: F.struct(draw(seed, *keys, i).alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def mmlu() -> tuple[Column, Column]:
    return mcq(F.col("question"), F.col("choices"), F.col("answer"))


def labelled(question: str) -> Callable[[], tuple[Column, Column]]:
    """Sources whose answer key is one of the choices' labels."""
    return lambda: mcq(F.col(question), F.col("choices.text"), F.array_position("choices.label", F.col("answerKey")) - 1)


def sciq(seed: int = 17) -> tuple[Column, Column]:
    choices = shuffled(F.array("distractor1", "distractor2", "distractor3", "correct_answer"), seed, F.lit("sciq"), F.col("idx"))
    return mcq(F.col("question"), choices, F.array_position(choices, F.col("correct_answer")) - 1)


def unanswerable() -> tuple[Column, Column]:
    prompt = F.format_string(ABSTAIN, F.substring(strip(F.col("context")), 1, PASSAGE_CHARS), strip(F.col("question")))
    return F.when(F.size("answers.text") == 0, prompt), gold(letter=F.lit("UNANSWERABLE"))


def misconceptions() -> tuple[Column, Column]:
    right = F.col("Correct").try_cast("double")
    return F.when(right.isNotNull(), F.format_string(TRUE_FALSE, strip(F.col("Question")))), gold(letter=F.when(right == 1.0, "True").otherwise("False"))


def trivia() -> tuple[Column, Column]:
    known = F.col("answer.normalized_aliases")
    aliases = F.when(F.size(known) > 0, known).otherwise(F.array("answer.value"))
    return F.format_string(QA, strip(F.col("question"))), gold(aliases=aliases)


def tested_code(question: str = "question", most_similar: float = 0.95) -> Callable[[], tuple[Column, Column]]:
    """Sources with test functions that import the solution."""

    def of() -> tuple[Column, Column]:
        source = F.array_join(F.filter(F.split("test", "\n"), lambda x: ~F.startswith(x, F.lit("from solution import"))), "\n")
        names = F.regexp_extract_all(source, F.lit(r"(?md)^def (test_\w+)\("), F.lit(1))
        runner = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("()"))), "\n")
        ok = (F.coalesce(F.col("filter_reason"), F.lit("")) == "") & (F.coalesce(F.col("benchmark_similarity").cast("double"), F.lit(0.0)) < most_similar) & (F.size(names) > 0)
        return F.when(ok, F.format_string(CODE, strip(F.col(question)), strip(source))), gold(preamble=source, setup=F.lit(""), tests=F.array(runner))

    return of


def mbpp() -> tuple[Column, Column]:
    prompt = F.format_string(CODE, strip(F.col("text")), F.array_join("test_list", "\n"))
    return prompt, gold(setup=F.coalesce(F.col("test_setup_code"), F.lit("")), tests=F.col("test_list"))


def free_form(*names: str) -> Callable[[], tuple[Column, Column]]:
    """Instructions without a verifier: the first field that isn't empty."""
    return lambda: (F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names]), gold())


NORMALISERS: dict[str, Callable[[], tuple[Column, Column]]] = {
    "mmlu": mmlu,
    "ai2_arc": labelled("question"),
    "openbookqa": labelled("question_stem"),
    "squad_v2": unanswerable,
    "misconceptions_tf": misconceptions,
    "sciq": sciq,
    "trivia_qa": trivia,
    "KodCode-V1": tested_code(),
    "mbpp": mbpp,
}


def normalise(rows: DataFrame, dataset: str, domain: str, kind: str, split: str, config: str | None = None) -> DataFrame:
    """Prompt records of a source; rows that don't fit are dropped."""
    name = dataset.rsplit("/", 1)[-1]
    fields = [c for c in ("query", "instruction", "prompt") if c in rows.columns]
    prompt, answer = NORMALISERS.get(name, free_form(*fields) if fields else lambda: (F.lit(None).cast("string"), gold()))()
    ident = F.concat_ws("-", F.lit(name), F.lit(config or "default"), F.lit(split), F.col("idx"))
    meta = F.create_map(*[F.lit(x) for kv in (("source", dataset), ("config", config), ("split", split)) if kv[1] for x in kv])
    out = rows.select(ident.alias("id"), F.lit(domain).alias("domain"), F.lit(kind).alias("kind"), prompt.alias("prompt"), answer.alias("gold"), meta.alias("meta"))
    needs_letter = kind in ("mcq", "tf", "unanswerable")
    return out.where(F.col("prompt").isNotNull() & ((F.col("gold.letter").isNotNull()) if needs_letter else F.lit(True)))


def pool(rows: DataFrame, source: dict, seed: int, used: DataFrame | None = None) -> DataFrame:
    """Up to n prompts of a source: twice as many rows are drawn, normalised, cleared of ids used before, and the first n kept in the order of the draw."""
    name = source["dataset"]
    key = draw(seed, F.lit(name), F.lit(source["split"]), F.col("idx"))
    drawn = rows.withColumn("__draw", key).orderBy("__draw", "idx").limit(2 * source["n"])
    out = normalise(drawn, name, source["domain"], source["kind"], source["split"], source.get("config"))
    if used is not None:
        out = out.join(used.select("id"), "id", "left_anti")
    index = F.element_at(F.split("id", "-"), -1).cast("long")
    return out.orderBy(draw(seed, F.lit(name), F.lit(source["split"]), index), index).limit(source["n"])


def question_of(prompt: Column) -> Column:
    """The question that a QA prompt was made of."""
    return strip(F.substring_index(prompt, QUESTION_END, 1))


def reask(prompt: Column) -> Column:
    return F.format_string(REASK, question_of(prompt))
