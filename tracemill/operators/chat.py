"""Training targets, preference texts, and chat records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import abstention_sentence, strip_force

# System prompts of the three uses, and the sentence that ends a forced thought.
SAMPLE_SYSTEM = "You are a careful and concise assistant."
EVAL_SYSTEM = "You are a careful expert. Follow the requested output format exactly."
EXPERT_SYSTEM = (
    "You are a careful expert. Reason step by step, keep the reasoning tight, "
    "and follow the requested output format exactly."
)
FORCE_SENTENCE = "I am out of thinking budget and will commit to my best answer now."
FORCED_END = f"\n\n{FORCE_SENTENCE}\n</think>\n\n"


def thought(think: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n\n"), answer)


def target(keep_think: bool) -> Column:
    """What the student learns to write; empty if an unanswerable trace has no usable judgement."""
    think, answer = F.col("think"), F.col("answer")
    if not keep_think:
        return answer
    judged = abstention_sentence(think)
    return F.when((F.col("kind") == "unanswerable") & judged.isNotNull(), thought(judged, answer)).when(F.col("kind") == "unanswerable", "").when(F.coalesce(think, F.lit("")) != "", thought(think, answer)).otherwise(answer)


def rejected(think: Column, answer: Column, truncated: Column, forced: Column) -> Column:
    """A failed trace as it would stand without any harness; a cut thought stays open."""
    bare = F.coalesce(strip_force(think, FORCE_SENTENCE), F.lit(""))
    cut = F.coalesce(truncated, F.lit(False)) | F.coalesce(forced, F.lit(False))
    return F.when(cut, F.concat(F.lit("<think>\n"), bare)).otherwise(thought(bare, F.coalesce(answer, F.lit(""))))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(prompt: Column, answer: Column | None = None, system: str = SAMPLE_SYSTEM) -> Column:
    """system, user and, for samples, assistant."""
    parts = [message("system", F.lit(system)), message("user", prompt)]
    return F.array(*parts, *([message("assistant", answer)] if answer is not None else []))


def eval_program(prompt: Column, code: Column, test: Column, entry_point: Column) -> Column:
    return F.concat_ws("\n", prompt, code, test, F.concat(F.lit("check("), entry_point, F.lit(")")))
