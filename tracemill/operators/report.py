"""Small tables as text: plain report, Markdown and TeX. Inputs are summaries (a few rows), which come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracemill.operators.evals import FULL


def cell(accuracy: float | None, total: int | None, benchmark: str, seconds: float | None = None) -> str:
    """Accuracy with a mark if the run is partial, and hours if asked for."""
    if accuracy is None:
        return "-"
    mark = "" if total >= FULL.get(benchmark, 0) else f"~{total}"
    return f"{accuracy:.1%}{mark}" + (f" {seconds / 3600:.1f}h" if seconds is not None else "")


def rows(summaries: DataFrame, benchmarks: list[str], show_time: bool = False) -> list[list[str]]:
    """A header and one line per run."""
    found: dict[str, dict[str, str]] = {}
    for r in summaries.orderBy("model", "benchmark").collect():
        found.setdefault(r["model"], {})[r["benchmark"]] = cell(r["accuracy"], r["total"], r["benchmark"], r["seconds"] if show_time else None)
    return [["Model", *map(str.upper, benchmarks)], *[[m, *[c.get(b, "-") for b in benchmarks]] for m, c in found.items()]]


def plain(table: list[list[str]], targets: dict[str, tuple[float, float]] | None = None) -> str:
    if targets:
        names = [b.lower() for b in table[0][1:]]
        table = [*table, *[[f"target ({label})", *[f"{targets[b][i]:.1%}" if b in targets else "-" for b in names]] for i, label in enumerate(("low", "high"))]]
    widths = [max(len(r[i]) for r in table) + 2 for i in range(len(table[0]))]
    lines = ["".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))) for r in table]
    lines.insert(1, "-" * len(lines[0]))
    if any("~" in x for x in lines):
        lines += ["", "~n = partial run over n items; not comparable to the full protocol (1000 / 817 / 164)"]
    return "\n".join(lines)


def markdown(table: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [table[0], ["---"] * len(table[0]), *table[1:]])


def tex(table: list[list[str]]) -> str:
    escaped = [[c.replace("%", r"\%").replace("_", r"\_").replace("~", r"$\sim$") for c in r] for r in table]
    body = [" & ".join(r) + r" \\" for r in escaped]
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(table[0]) - 1) + "}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}"])
