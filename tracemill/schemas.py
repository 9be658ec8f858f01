"""Schemas of all records. Never inferred: gold differs by kind, and absent fields must still be columns."""

from __future__ import annotations

GOLD = "struct<letter:string,aliases:array<string>,preamble:string,setup:string,tests:array<string>>"
META = "map<string,string>"
PROMPT = f"id string, domain string, kind string, prompt string, gold {GOLD}, meta {META}"
TRACE = f"{PROMPT}, teacher string, teacher_model string, answer string, think string, raw string, gen_tokens int, gen_seconds double, truncated boolean, forced boolean, source string"
ROLLOUT = "id string, domain string, kind string, correct boolean, truncated boolean, forced boolean, tokens int, why string, answer string, think string"
EVAL = f"id string, correct boolean, output string, truncated boolean, forced boolean, think_chars int, think_tail string, tokens int, seconds double, meta {META}"
SUMMARY = "benchmark string, model string, total int, correct int, accuracy double, truncated int, forced int, forced_correct int, seconds double, think boolean, max_tokens int, force_budget int, temp double, decode map<string,string>"
PAIR = "messages array<struct<role:string,content:string>>, chosen string, rejected string, id string, kind string, rejected_unterminated boolean"
TOPK = "sample int, pos int, ids array<int>, logprobs array<float>"
