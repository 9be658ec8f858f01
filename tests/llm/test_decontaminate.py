"""Plain copies that templates alone miss."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate


def matched(spark, item, text):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["covered"], r["changed"]) for r in decontaminate.contaminated(docs, bench).collect()]


@pytest.mark.parametrize("item", ["A car drives 60 km in 2 hours and 30 minutes", "What is the sum of all even numbers 2 4 6 8", " ".join(f"{i} kg" for i in range(1, 12))])
def test_copies_dense_in_figures(spark, item):
    assert matched(spark, item, f"before it, {item}, and after") == [(len(item.split()), 0)]
    assert matched(spark, item, "before it and after") == []


def test_values_read_as_other_types(spark):
    item = "Anna buys 5 apples and Anna's sister eats 2 of them"
    assert matched(spark, item, f"Question: {item}") == [(12, 0)]


def test_runs_go_on_after_the_earlier_slot():
    """One number of the item becomes two: the run starts anew after the first of the two, not at the second."""
    item = "take 7 red stones from the big old box and put 7 of them into the small new bag near my door today"
    text = item.replace("take 7", "take 8").replace("put 7", "put 9")
    assert decontaminate.Index([(1, item)]).find([text], 13) == {(0, 0): (21, 1)}


def test_names_of_several_words(spark):
    item = "A ship sails from Boston to the old harbour in 5 days and a faster ship sails from Boston in 3 days with less cargo"
    text = item.replace("Boston", "New York City").replace("5", "9")
    (covered, changed), = matched(spark, item, f"once {text} again")
    assert covered == len(item.split()) and changed == 3
    short = "a ship sails from Boston to the old harbour and then to Boston"
    assert matched(spark, short, short.replace("Boston", "New York")) == [(13, 2)]
    assert matched(spark, short, short.replace("from Boston", "from New York").replace("to Boston", "to Dover")) == []


def test_short_items_are_whole_lines(spark):
    assert matched(spark, "Name the capital", "first\n  name the CAPITAL!\nlast") == [(3, 0)]
    assert matched(spark, "Name the capital", "please name the capital of it") == []


def brute(item, text, cover, dense=True):
    """The longest run by definition: every pair of places, every run between them. dense: a run needs no window with literals in it, only the words that the whole run must share."""
    best = None
    for of, other, forms in zip(decontaminate.tokens([item]), decontaminate.tokens([text]), (3, 1), strict=True):
        n, m = len(of.kind), len(other.kind)
        need, size = min(cover, n), min(decontaminate.WINDOW, n)
        least = max(2, min(decontaminate.WORDS, len({w for w, k in zip(of.surface, of.kind) if k == 0})))

        def literal(t, form):
            return (t.kind == 0) | ((t.kind == 3) & (form == 1))

        def value(t, k, form):
            return (t.typed, t.plain, t.surface)[form][k]

        def anchor(i, d):
            return any(all(value(of, i + x, f) == value(other, d + x, f) for x in range(size)) and (dense or f == 2 or literal(of, f)[i : i + size].sum() >= decontaminate.LITERALS) for f in range(forms))

        for shift in range(-n, m):
            places = [i for i in range(n) if 0 <= i + shift < m]
            if not places:
                continue
            anchors = [i for i in places if i + size <= n and i + shift + size <= m and anchor(i, i + shift)]
            if not anchors:
                continue
            for s in places:
                there, back, changed, words = {}, {}, 0, set()
                for i in range(s, n):
                    d = i + shift
                    if d >= m:
                        break
                    a, b = of.surface[i], other.surface[d]
                    if a != b and not (of.kind[i] == other.kind[d] != 0) and not (of.capital[i] and other.capital[d]):
                        break
                    if a != b or of.kind[i] or other.kind[d]:
                        if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                            break
                        changed += a != b
                    if a == b and of.kind[i] in (0, 3):
                        words.add(a)
                    if i - s + 1 >= need and any(s <= x and x + size <= i + 1 for x in anchors) and (not changed or len(words) >= least) and (best is None or (i - s + 1, -changed) > (best[0], -best[1])):
                        best = i - s + 1, int(changed)
    return best


def made(rng, slots):
    plain = "the a ship of red stone goes to market with old boxes and sells them for less than before".split()
    names = ["Boston", "New York", "Anna", "Rio Grande Valley", "Oslo"]

    def words(n):
        return [rng.choice([rng.choice(plain)] * slots + [str(rng.randint(1, 9)), f"{rng.randint(1, 9)} km", rng.choice(names)] + ["Then"]) for _ in range(n)]

    item = words(rng.randint(5, 22))
    swap = {x: rng.choice([x, rng.choice(names) if x in names else f"{rng.randint(1, 9)} km" if "km" in x else str(rng.randint(1, 9))]) for x in item if x in names or x[0].isdigit()}
    copy = [swap.get(x, x) if rng.random() < 0.9 else rng.choice([x, rng.choice(plain), "7"]) for x in item]
    return " ".join(item), " ".join(words(rng.randint(0, 6)) + copy + words(rng.randint(0, 6)))


@pytest.mark.parametrize("slots", [6, 2])
def test_against_brute_force(slots):
    rng = random.Random(slots)
    found = missed = lost = whole = 0
    for _ in range(300):
        item, text = made(rng, slots)
        for cover in (13, 9):
            got = decontaminate.Index([(1, item)]).find([text], cover).get((0, 0))
            want = brute(item, text, cover, dense=False)
            assert got == want, (item, text)
            found += want is not None
            missed += want is None
            # against the definition without a condition on windows
            free = brute(item, text, cover)
            whole += free is not None
            lost += free is not None and got is None
    assert found > 60 and missed > 60 and lost <= 0.02 * whole


def test_recall_of_changed_copies():
    """Items with all numbers and names changed consistently, inside other text."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    names = [" ".join(w.capitalize() for w in rng.sample(vocab, rng.choice([1, 1, 2, 3]))) for _ in range(80)]
    items, texts = [], []
    for _ in range(150):
        values = {f"#{k}": (str(rng.randint(2, 99)), str(rng.randint(100, 999))) for k in range(3)} | {f"@{k}": tuple(rng.sample(names, 2)) for k in range(2)}
        words = [rng.choice(vocab) for _ in range(4)] + [rng.choice([rng.choice(vocab)] * 5 + list(values)) for _ in range(rng.randint(14, 40))]
        one, two = (" ".join(values[w][k] if w in values else w for w in words) for k in (0, 1))
        items.append(one)
        texts.append(" ".join([*rng.choices(vocab, k=30), two, *rng.choices(vocab, k=30)]))
    index = decontaminate.Index(list(enumerate(items)))
    got = index.find(texts, 13)
    assert sum((i, i) in got for i in range(150)) >= 0.9 * 150 and all(a == b for a, b in got)


def test_odd_cases(spark):
    item = "seven plain words make one short question"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, "x y z u v w"), (3, None), (4, ""), (5, " .,")], "item_id long, text string")
    rows = [(1, f"so {item} then"), (1, f"so {item} then"), (1, "clean"), (None, item), (None, "clean"), (2, "word " * 60_000 + item), (3, None), (4, ""), (5, " \n ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__doc", F.lit(1)).withColumn("covered", F.lit("x")).withColumn("item_id", F.lit("y"))
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()]
    assert sorted(got, key=str) == sorted([(i, k) for i in (1, 1, None, 2) for k in (1, 2)], key=str)
    out = decontaminate.clean(d, bench)
    assert out.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "clean"), (None, "clean"), (3, None), (4, ""), (5, " \n ")], key=str)


@pytest.mark.parametrize("item, copy, want", [
    ("A car drives 60 km in 2 hours and 30 minutes", "A car drives 80 km in 3 hours and 15 minutes", (11, 3)),
    ("Compute 12 + 15 + 18 + 21 now", "Compute 2 + 5 + 8 + 1 now", (6, 4)),
    ("Solve 3 plus 4", "Solve 5 plus 9", (4, 2)),
    ("Who wrote Hamlet?", "Q: Who wrote Hamlet?", (3, 0)),
    ("Who wrote Hamlet?", "Question 7) Who wrote Macbeth?", (3, 1)),
    ("Wie weit ist es von Östlund bis Zürich wenn man mit dem Zug fährt und dann geht", "Wie weit ist es von Çelik bis Łódź wenn man mit dem Zug fährt und dann geht", (17, 2)),
    ("Anna has five apples and gives two of them to her brother Ben today", "Anna has nine apples and gives four of them to her brother Tom today", (14, 3)),
    ("Сколько стоит билет из Москвы в Тверь если ехать 3 часа на поезде и ещё 20 минут", "Сколько стоит билет из Казани в Псков если ехать 5 часов на поезде и ещё 40 минут", None),
    ("Сколько стоит билет из Москвы в Тверь если ехать 3 часа на поезде и ещё 20 минут", "Сколько стоит билет из Казани в Псков если ехать 5 часа на поезде и ещё 40 минут", (17, 4)),
    ("1 2 3 4 5 6 7 8 9 10 11 12 13", "21 22 23 24 25 26 27 28 29 30 31 32 33", None),
    ("Name the capital", "please name the capital of it", None),
    ("Who wrote Hamlet?", "I know who wrote Hamlet in those days", None),
])
def test_re_parameterised_items(spark, item, copy, want):
    """Of any density and length, with names in any script and written numbers; figures alone fit any others."""
    assert matched(spark, item, f"Before it.\n{copy}\nAfter it.") == ([want] if want else [])


def items_of(rng, vocab, tokens, slots):
    """An item of so many tokens with that share of numbers and names, and a copy with all of them changed."""
    names = rng.sample([w.capitalize() for w in vocab], 12)
    one, two, fixed = [], [], 0
    pairs = {k: (str(rng.randint(2, 99)), str(rng.randint(100, 999))) for k in range(40)} | {f"n{k}": (names[2 * k], names[2 * k + 1]) for k in range(6)}
    n = round(tokens * slots)
    kinds = [1] * n + [0] * (tokens - n)
    rng.shuffle(kinds)
    for k in kinds:
        if k:
            a, b = pairs[rng.choice(list(pairs)) if one else rng.randrange(40)]
        else:
            a = b = rng.choice(vocab)
            fixed += 1
        one.append(a)
        two.append(b)
    return " ".join(one), " ".join(two)


@pytest.mark.parametrize("least, most, slots", [(15, 40, 0.4), (15, 40, 0.6), (20, 40, 0.8), (5, 7, 0.4), (3, 4, 0.34)])
def test_recall_of_dense_and_short_items(least, most, slots):
    rng = random.Random(least)
    vocab = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    items, texts = zip(*[items_of(rng, vocab, rng.randint(least, most), slots) for _ in range(150)], strict=True)
    texts = [f"{' '.join(rng.choices(vocab, k=30))}. {t}. {' '.join(rng.choices(vocab, k=30))}" for t in texts]
    got = decontaminate.Index(list(enumerate(items))).find(texts, 13)
    assert sum((i, i) in got for i in range(150)) >= 0.9 * 150 and sum(a != b for a, b in got) <= 3
