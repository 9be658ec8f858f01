"""Secret scans with DataFrame functions only.

Three base kinds are regular expressions. A fourth, `random`, is added by a
battery of randomness tests over every run of 20 or more symbols that mixes
letters and digits, and over runs of 20 or more letters or digits alone: the
encoding is inferred (hex, of a UUID without its dashes, base32, base64, digits,
letters of one case or of both), and the run is held against a uniform draw from
that alphabet by a chi-squared test, a Wald-Wolfowitz runs test over the
alphabet's halves, and a lag-1 serial correlation. Long words are what runs of
letters mostly are, so these are also held against a draw by their share of
vowels, by the changes between vowels and others, and by their share of
capitals. The p-values are combined by Bonferroni (they depend on one another).
Structured runs (dates, paths, words) are the rejections; false rejections are
controlled by Benjamini-Hochberg at `fdr` within length classes, since a long
run has more power than a short one, and at `fdr_letters` for runs of letters,
of which nearly all are words, in classes of their own. What is not
rejected is reported as a secret. The null hypothesis being "drawn uniformly
from the alphabet", the control bounds the share of random strings among what
is set aside as structured (secrets that are missed), not the share of false
alarms; and since the thresholds come from all p-values of the table, which
runs of a document are reported depends on the other documents. tests/llm
measure both rates on planted strings.

The p-values are counted over all documents on a fixed grid of tenths of
ln(p), so the control needs one small aggregate (classes x grid cells), and
only its thresholds (one per class) come to the driver. Text is scanned once;
the intermediate table holds spans and p-values.

Given cases: null text counts as empty; a very long text is scanned whole; spans
that start together tie by the order of their kinds; texts without matches give zero counts,
the digest of the empty string and empty spans; repeated rows give a row each;
an empty table gives an empty one; other columns are ignored. Offsets are code
points, end exclusive, also for characters outside the basic plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import let
from tracemill.session import stored

# The base kinds in their listed order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of 20 characters or more among AKIA[A-Z0-9]+
HEX = r"[0-9a-f]{24,}"  # the runs of 24 characters or more among [0-9a-f]+
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

SYMBOL = "[A-Za-z0-9+/_-]"
RUN = rf"(?<!{SYMBOL})(?:(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z]){SYMBOL}{{20,}}+|(?:[A-Za-z]{{20,}}+|[0-9]{{20,}}+)(?!{SYMBOL}))"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "digits": "0123456789", "letters": "abcdefghijklmnopqrstuvwxyz", "Letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
VOWELS = 5 / 26  # share of vowels in a draw of letters
LETTERS = 100  # added to the length class of a run of letters
CLASS_STARTS = (20, 32, 48, 64, 128, 256)  # length classes for the false-discovery control
GRID = 0.1  # step of ln(p)
DEEPEST = 400  # cells; smaller p-values share the last one

SPAN = "struct<start:int,no:int,end:int,kind:string>"


def _spans(text: Column, found: Column, pattern: str, no: int, least: tuple[Column, int] | None = None) -> Column:
    """Spans of the matches `found` of pattern, from the lengths of what lies between them; least: (parallel strings, shortest that counts)."""
    between = F.split(text, pattern, -1)
    extra = least[0] if least else found
    steps = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), extra.alias("e"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.char_length(x["b"])
        hi = lo + F.char_length(x["m"])
        one = F.array(F.struct(lo.alias("start"), F.lit(no).alias("no"), hi.alias("end"), F.lit(KINDS[no]).alias("kind")))
        if least:
            one = F.when(F.char_length(x["e"]) >= least[1], one).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(hi.alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal by a logistic fit, accurate to about 1e-4 and never zero or over one."""
    x = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x))


def _battery(run: Column, alphabet: str, *more: Column) -> Column:
    """Combined p-value of `run` under a uniform draw from alphabet; more: p-values of further tests."""
    k, n = len(alphabet), F.char_length(run).cast("double")
    squares = sum((F.pow(n - F.char_length(F.replace(run, F.lit(c), F.lit(""))), 2) for c in alphabet), F.lit(0.0))
    chi = k / n * squares - n
    df = k - 1.0
    p_chi = _tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)

    halves = F.translate(run, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    up = n - F.char_length(F.replace(halves, F.lit("1"), F.lit("")))
    down = n - up
    turns = (n - F.char_length(F.replace(halves, F.lit("01"), F.lit("")))) / 2 + (n - F.char_length(F.replace(halves, F.lit("10"), F.lit("")))) / 2
    mean = 2 * up * down / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when((up == 0) | (down == 0) | (var <= 0), F.lit(1e-6)).otherwise(2 * _tail(F.abs(turns + 1 - mean) / F.sqrt(var)))

    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    centre = F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / n
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: (a - centre) * (b - centre))
    spread = F.aggregate(at, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))
    r = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / spread
    p_serial = F.when(spread <= 0, F.lit(1e-6)).otherwise(2 * _tail(F.abs(r * F.sqrt(n) + 1 / F.sqrt(n))))
    return F.least(F.lit(1.0), (3 + len(more)) * F.least(p_chi, p_runs, p_serial, *more))


def _speech(run: Column) -> list[Column]:
    """P-values of a run of small letters: vowels, and changes between vowels and others, are no more than in a draw."""
    n = F.char_length(run).cast("double")
    kinds = F.translate(run, "aeioubcdfghjklmnpqrstvwxyz", "1" * 5 + "0" * 21)
    vowels = n - F.char_length(F.replace(kinds, F.lit("1"), F.lit("")))
    turns = (n - F.char_length(F.replace(kinds, F.lit("01"), F.lit("")))) / 2 + (n - F.char_length(F.replace(kinds, F.lit("10"), F.lit("")))) / 2
    once = VOWELS * (1 - VOWELS)
    change = 2 * once
    spread = F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (once - change * change))
    return [_tail((vowels - n * VOWELS) / F.sqrt(n * once)), _tail((turns - (n - 1) * change) / spread)]


def _of_letters(run: Column) -> Column:
    """The combined p-value of a run of letters: in one case but for its first letter, or in both."""
    capitals = F.char_length(F.regexp_replace(run, "[a-z]", "")).cast("double")
    n = F.char_length(run).cast("double")
    case = 2 * _tail(F.abs(capitals - n / 2) / F.sqrt(n / 4))
    one = lambda small: _battery(small, ALPHABETS["letters"], *_speech(small))
    both = lambda small: _battery(run, ALPHABETS["Letters"], case, *_speech(small))
    return F.when(run.rlike("^([A-Za-z][a-z]+|[A-Z]+)$"), let(F.lower(run), one)).otherwise(let(F.lower(run), both))


def _p_value(run: Column) -> Column:
    of = lambda name: lambda x: _battery(x, ALPHABETS[name])
    case = F.when(run.rlike("^[0-9]+$"), of("digits")(run)).when(run.rlike("^[A-Za-z]+$"), _of_letters(run)).when(run.rlike(UUID), let(F.lower(F.replace(run, F.lit("-"), F.lit(""))), of("hex")))
    case = case.when(run.rlike("^[0-9a-f]+$"), of("hex")(run)).when(run.rlike("^[0-9A-F]+$"), of("HEX")(run)).when(run.rlike("^[A-Z2-7]+$"), of("base32")(run))
    return case.otherwise(let(F.translate(run, "-_", "+/"), of("base64")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, fdr: float = 0.05, fdr_letters: float = 0.2) -> DataFrame:
    """(doc_id, base, added): arrays of spans, sorted by start and then kind; added spans inside a base span are left out."""
    t = F.col("t")
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).select(
        "doc_id",
        "t",
        F.regexp_extract_all(t, F.lit(ASSIGN), 0).alias("m_assign"),
        F.regexp_extract_all(t, F.lit(ACCESS), 0).alias("m_access"),
        F.regexp_extract_all(t, F.lit(HEX), 0).alias("m_hex"),
        F.regexp_extract_all(t, F.lit(RUN), 0).alias("m_run"),
    )
    values = F.when(F.size("m_assign") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), 2)).otherwise(F.col("m_assign"))
    spans = found.select(
        "doc_id",
        F.array_sort(F.concat(_spans(t, F.col("m_assign"), ASSIGN, 0, (values, ASSIGN_LEAST)), _spans(t, F.col("m_access"), ACCESS, 1), _spans(t, F.col("m_hex"), HEX, 2))).alias("base"),
        _spans(t, F.col("m_run"), RUN, 3).alias("runs"),
        F.transform("m_run", lambda r: F.struct(_p_value(r).alias("p"), F.when(r.rlike("^[A-Za-z]+$"), LETTERS).otherwise(0).alias("more"))).alias("p"),
    )
    size = lambda s: s["end"] - s["start"]
    level = lambda n: sum((F.when(n >= c, 1).otherwise(0) for c in CLASS_STARTS), F.lit(0))
    cell = lambda p: F.least(F.lit(DEEPEST), F.floor(-F.log(p) / GRID)).cast("int")
    open_runs = F.filter(F.arrays_zip(F.col("runs").alias("s"), F.col("p").alias("p")), lambda x: ~F.exists("base", lambda b: (b["start"] <= x["s"]["start"]) & (b["end"] >= x["s"]["end"])))
    tested = stored(spans.select("doc_id", "base", F.transform(open_runs, lambda x: F.struct(x["s"].alias("s"), (level(size(x["s"])) + x["p"]["more"]).alias("level"), cell(x["p"]["p"]).alias("cell"))).alias("runs")), "secret-runs")
    cuts = thresholds(tested.select(F.explode("runs").alias("r")).select("r.level", "r.cell"), fdr, fdr_letters)
    kept = lambda r: r["cell"] < sum((F.when(r["level"] == k, F.lit(c)).otherwise(0) for k, c in cuts.items()), F.lit(0))
    return tested.select("doc_id", "base", F.transform(F.filter("runs", kept), lambda r: r["s"]).alias("added"))


def thresholds(cells: DataFrame, fdr: float, fdr_letters: float | None = None) -> dict[int, int]:
    """(level, cell) of each tested run -> by level the first rejected cell. A cell's p-values count as its largest, exp(-GRID * cell), so the control errs on the safe side."""
    counts = cells.groupBy("level", "cell").count()
    rows = counts.collect()  # at most levels x cells rows
    cuts = {}
    for level in {r["level"] for r in rows}:
        own = {r["cell"]: r["count"] for r in rows if r["level"] == level}
        most = fdr if level < LETTERS or fdr_letters is None else fdr_letters
        total, seen, cut = sum(own.values()), 0, DEEPEST + 1
        for c in sorted(own, reverse=True):
            seen += own[c]
            if 2.718281828459045 ** (-GRID * c) <= most * seen / total:
                cut = c
        cuts[level] = cut
    return cuts


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the base spans, and all spans."""
    base = F.col("base")
    n = lambda k: F.size(F.filter(base, lambda s: s["no"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(base, F.col("added")))).alias("spans"),
    )
