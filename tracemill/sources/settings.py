"""Configuration: nested values with ${NAME} and ${NAME:-default} taken from the environment, and lookups over teachers."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expanded(value: object, env: dict[str, str] | None = None) -> object:
    """value with all placeholders replaced, in nested lists and dicts too; an unset name without a default is left as it is."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return PLACEHOLDER.sub(lambda m: env.get(m[1]) or (m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    return value


def expanded_in(text: Column, env: Column) -> Column:
    """As expanded() for the strings of a column, with a map of the names."""
    pattern = PLACEHOLDER.pattern
    found, names = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    given = lambda m: F.when(F.contains(m, F.lit(":-")), F.regexp_replace(m, r"(?s)^\$\{\w+:-(.*)\}$", "$1")).otherwise(m)
    values = F.zip_with(found, names, lambda m, name: F.coalesce(F.nullif(F.try_element_at(env, name), F.lit("")), given(m)))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, F.concat(values, F.array(F.lit(""))), lambda b, v: F.concat(b, v)), "")


def load(path: str) -> dict:
    """A YAML file (or JSON, which needs no parser package)."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return expanded(json.loads(text))
    return expanded(yaml.safe_load(text))


@dataclass
class Settings:
    seed: int = 17
    teachers: dict[str, dict] = field(default_factory=dict)
    styles: dict[str, str] = field(default_factory=dict)
    mix: dict[str, float] = field(default_factory=dict)
    verify_mcq: bool = True
    verify_qa: bool = True
    verify_code: bool = True
    keep_think: bool = True
    ngram: int = 13
    max_seq_len: int = 2048
    valid_frac: float = 0.02
    max_samples: int | None = None
    budgets: dict[str, int] = field(default_factory=dict)
    retries: int = 0
    hedge_retries: int = 2
    top_k: int = 64
    eval_max_tokens: int | dict[str, int] = 2048
    eval_temp: float = 0.0
    eval_think: bool = True

    def teacher_for(self, domain: str) -> str:
        """The first teacher that lists the domain."""
        for name, t in self.teachers.items():
            if domain in t["domains"]:
                return name
        raise KeyError(f"no teacher for {domain}")

    def style_for(self, domain: str, teacher: str) -> str | None:
        """The teacher's (or else the run's) style of a domain, else the teacher's own; an empty one means none."""
        t = self.teachers[teacher]
        return (t.get("style_by_domain") or self.styles).get(domain, t.get("style")) or None

    def budget_for(self, kind: str) -> int:
        return self.budgets.get(kind) or self.budgets.get("default") or 2048

    def eval_budget_for(self, benchmark: str) -> int:
        """One budget for all, or one by benchmark with a default."""
        most = self.eval_max_tokens
        return most.get(benchmark, most["default"]) if isinstance(most, dict) else most

    def model_for(self, ref: str, student: str, variants: dict[str, str]) -> str:
        """student, student:<variant>, teacher:<name>, or a path."""
        kind, _, name = ref.partition(":")
        if kind == "student":
            return variants[name] if name else student
        if kind == "teacher":
            return self.teachers[name]["path"]
        return ref


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")


def teacher_of(cfg: Settings, domain: Column) -> Column:
    """teacher_for() of a column of domains; null where it would fail."""
    return F.coalesce(*[F.when(domain.isin(t["domains"]), F.lit(name)) for name, t in cfg.teachers.items()], F.lit(None).cast("string"))


def style_of(cfg: Settings, domain: Column, teacher: Column) -> Column:
    """style_for() of columns of domains and teachers."""
    out = F.lit(None).cast("string")
    for name, t in cfg.teachers.items():
        table = t.get("style_by_domain") or cfg.styles
        known = domain.isin(list(table)) if table else F.lit(False)
        out = F.when(teacher == name, F.when(known, F.try_element_at(_map(table), domain)).otherwise(F.lit(t.get("style")).cast("string"))).otherwise(out)
    return F.nullif(out, F.lit(""))


def budget_of(cfg: Settings, kind: Column) -> Column:
    """budget_for() of a column of kinds."""
    table = {k: v for k, v in cfg.budgets.items() if v}
    return F.coalesce(F.try_element_at(_map(table), kind).cast("int"), F.lit(cfg.budgets.get("default") or 2048))


def model_of(cfg: Settings, ref: Column, student: Column, variants: Column, paths: Column | None = None) -> Column:
    """model_for() of a column of references; variants and paths: maps of the student's variants and the teachers' models (those of cfg, if not given)."""
    kind, name = F.substring_index(ref, ":", 1), F.when(F.contains(ref, F.lit(":")), F.substring(ref, F.instr(ref, ":") + 1, F.char_length(ref))).otherwise("")
    paths = _map({k: t["path"] for k, t in cfg.teachers.items() if "path" in t}) if paths is None else paths
    return F.when(kind == "student", F.when(name == "", student).otherwise(F.try_element_at(variants, name))).when(kind == "teacher", F.try_element_at(paths, name)).otherwise(ref)


PROBE = "The quick brown fox: 12345, naïve café, x = [1, 2]; 漢字 🙂"


def fingerprint(path: str) -> tuple[int, list[int]] | None:
    """(vocabulary size, ids of a probe text) of the tokenizer.json at a path or in its folder; null if there is none."""
    file = Path(path) if path.endswith(".json") else Path(path) / "tokenizer.json"
    if not path or not file.exists():
        return None
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(file))
    return t.get_vocab_size(), t.encode(PROBE).ids


def shared_vocabulary(student: tuple | None, teacher: tuple | None) -> str:
    """Logits can be distilled only between models with one vocabulary."""
    if student is None or teacher is None:
        return "tokenizer not found"
    return "shared vocabulary: logit distillation is viable" if student == teacher else "different vocabulary: sequence level only"
