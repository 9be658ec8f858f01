"""The trained models and the randomness battery against plain computations of the same formulas."""

import math
import random
import string
import uuid

import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import language_id, quality, secret_scan

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ---- 1 language ---------------------------------------------------------

def test_convolution_by_hand():
    """Features and probabilities of a net, window by window, filter by filter, from one-hot bytes."""
    rng = np.random.default_rng(3)
    net = language_id.ByteConvNet(["a", "b", "c"], {w: rng.normal(size=(w, 256, 4)).astype(np.float32) for w in (2, 3)}, rng.normal(size=(8, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    windows = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    got = net.probabilities(windows)
    for window, probabilities in zip(windows, got, strict=True):
        one_hot = np.zeros((40, 256))
        one_hot[np.arange(40), window] = 1
        features = [max((one_hot[at : at + w] * net.tables[w][:, :, f]).sum() for at in range(40 - w + 1)) for w in (2, 3) for f in range(4)]
        z = np.maximum(features, 0) @ net.head + net.bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(probabilities, want, atol=1e-4)


def test_training_learns_a_pattern():
    rng = np.random.default_rng(4)
    windows, labels = rng.integers(97, 123, (60, 40)).astype(np.uint8), ["a", "b", "c"] * 20
    windows[::3, 5:9], windows[1::3, 20:24] = 65, 66
    net = language_id.train(windows, labels, epochs=60)
    assert np.mean([net.labels[k] == x for k, x in zip(net.probabilities(windows).argmax(axis=1), labels, strict=True)]) > 0.95


def test_a_document_is_the_weighted_mean_of_its_windows(spark):
    rng = random.Random(5)
    net_rng = np.random.default_rng(5)
    net = language_id.ByteConvNet(["a", "b"], {3: net_rng.normal(size=(3, 256, 4)).astype(np.float32)}, net_rng.normal(size=(4, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = ["".join(rng.choice(string.ascii_letters + " é") for _ in range(n)) for n in (3, 256, 257, 700, 30_000)]
    d = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").withColumn("lang_pred", F.lit("x"))
    for r in language_id.predict(d, net).collect():
        w, held = language_id.cut(texts[r["doc_id"]].encode())
        p = (net.probabilities(w) * held[:, None]).sum(axis=0)
        assert r["lang_pred"] == net.labels[p.argmax()] and abs(r["score"] - p.max() / p.sum()) < 1e-5


# ---- 8 quality ----------------------------------------------------------

def test_votes_by_hand():
    """Every score from the neighbours of one vector, found by sorting all cosines."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50)]
    known = [" ".join(rng.choice(vocab) for _ in range(30)) if k % 2 else " ".join(rng.choice("XYZ%&1239") for _ in range(60)) for k in range(60)]
    model = quality.Model(np.stack([quality.counts(t) for t in known]), np.array([k % 2 for k in range(60)]), 10, 7, 4.0)
    asked = [quality.counts(t) for t in (known[:5] + [" ".join(rng.choice(vocab) for _ in range(9)), "1 2 X", "", "a"])]
    got = model.score(np.stack(asked))
    for x, score in zip(asked, got, strict=True):
        if not x.any():
            assert score == model.prior
            continue
        v = x * model.idf
        v = (v / np.linalg.norm(v)) @ model.projection
        v = v / np.linalg.norm(v) if np.linalg.norm(v) else v
        near = sorted(((float(v @ k), y) for k, y in zip(model.known, model.y, strict=True)), reverse=True)[:7]
        weights = [max(c, 0) ** 4 for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else model.prior
        assert abs(score - want) < 1e-3


def test_neighbours_that_tie_go_by_their_order():
    """Equal vectors with different labels at the last place: the first of them vote, however many are asked at once."""
    model = quality.Model(np.stack([quality.counts("aa bb cc")] * 20 + [quality.counts("dd ee")]), np.array([1] * 4 + [0] * 16 + [1]), 2, 6, 4.0)
    asked = np.stack([quality.counts("aa bb cc")] * 3 + [quality.counts("aa bb")])
    assert np.allclose(model.score(asked), 4 / 6, atol=1e-3) and np.allclose(model.score(asked[:1]), 4 / 6, atol=1e-3)


def test_a_column_of_the_score_s_name_is_replaced(spark):
    d = spark.createDataFrame([(1, "some text", "old"), (None, None, "old"), (2, "", None)], "doc_id long, text string, score string")
    model = quality.Model(np.stack([quality.counts("some text here"), quality.counts("1 2 3 %%%")]), np.array([1, 0]), 2, 2, 4.0)
    out = quality.scores(d, model)
    assert out.columns == ["doc_id", "text", "score"] and dict(out.dtypes)["score"] == "double" and out.where("score is null").count() == 0
    assert quality.scores(d, None).columns == ["doc_id", "text", "score"]


# ---- 9 secrets ----------------------------------------------------------

def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run, alphabet):
    """The three tests in plain Python, with the normal distribution itself."""
    k, n = len(alphabet), len(run)
    chi = sum((run.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    df = k - 1
    p_chi = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    bits = [alphabet.index(c) >= k // 2 for c in run]
    up, down = sum(bits), n - sum(bits)
    runs = 1 + sum(a != b for a, b in zip(bits, bits[1:], strict=False))
    mean = 2 * up * down / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 1e-6 if not up or not down or var <= 0 else 2 * tail(abs(runs - mean) / math.sqrt(var))
    at = [alphabet.index(c) + 1 for c in run]
    m = sum(at) / n
    spread = sum((x - m) ** 2 for x in at)
    r = sum((a - m) * (b - m) for a, b in zip(at, at[1:], strict=False)) / spread if spread else 0
    p_serial = 2 * tail(abs(r * math.sqrt(n) + 1 / math.sqrt(n))) if spread else 1e-6
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def test_p_values(spark):
    rng = random.Random(7)
    cases = []
    for name, alphabet in secret_scan.ALPHABETS.items():
        for n in (20, 33, 64, 300):
            cases.append((name, "".join(rng.choice(alphabet) for _ in range(n))))
        cases.append((name, (alphabet[0] + alphabet[1]) * 15))
        cases.append((name, "".join(sorted(rng.choice(alphabet) for _ in range(40)))))
    for name, alphabet in secret_scan.ALPHABETS.items():
        own = [x for a, x in cases if a == name]
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "i int, x string")
        got = {r["i"]: r["p"] for r in rows.select("i", secret_scan._battery(F.col("x"), alphabet).alias("p")).collect()}
        for i, x in enumerate(own):
            assert abs(got[i] - battery(x, alphabet)) < 3e-3, (name, x)


def planted(rng):
    """Random strings and structured ones by kind, none set aside."""
    draw = lambda alphabet, sizes: "".join(rng.choice(alphabet) for _ in range(rng.choice(sizes)))
    word = lambda: "".join(rng.choice(["re", "con", "ti", "men", "ta", "ver", "sion", "al", "ing", "er", "pro", "de", "lich", "keit", "tor"]) for _ in range(rng.randint(2, 4)))
    secret = {
        "keys": lambda: draw(string.ascii_letters + string.digits, [24, 32, 40, 64]), "small letters": lambda: draw(string.ascii_lowercase, [32]), "letters": lambda: draw(string.ascii_letters, [24, 32, 40]),
        "digits": lambda: draw(string.digits, [20, 22, 23]), "uuids": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "HEX": lambda: draw("0123456789ABCDEF", [32, 40, 64]), "base32": lambda: draw(secret_scan.ALPHABETS["base32"], [32, 52]),
    }
    plain = {
        "dated names": lambda: f"{rng.choice(['report', 'invoice', 'backup'])}-{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{rng.choice(['final', 'draft'])}-version-{rng.randint(1, 9)}",
        "repeats": lambda: rng.choice(["a1", "abc123", "01"]) * rng.randint(12, 20), "paths": lambda: "/".join(["", "usr", word(), word(), "lib" + str(rng.randint(1, 9)), word()]), "slugs": lambda: "-".join([word(), word(), word(), str(rng.randint(1, 99))]),
        "camel case": lambda: "".join(word().capitalize() for _ in range(4)), "long words": lambda: (word() + word() + word() + "heitenlich")[: rng.randint(20, 34)], "counters": lambda: "0" * rng.randint(16, 24) + str(rng.randint(1000, 9999)),
    }
    return secret, plain


def test_rates_on_planted_strings(spark):
    """How many random strings of each kind are found, and how many structured ones are taken for secrets, a hundred of each."""
    rng = random.Random(8)
    secret, plain = planted(rng)
    rows = [(kind, f"see {make()} there") for kind, make in [*secret.items(), *plain.items()] for _ in range(100)]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"] for r in secret_scan.digest(secret_scan.scan(frame)).where("n_hex = 0 and spans like '%random%'").collect()}
    rate = {kind: sum(i in found for i, (k, _) in enumerate(rows) if k == kind) for kind in [*secret, *plain]}
    print(rate)
    assert all(rate[k] >= 80 for k in secret) and all(rate[k] <= 20 for k in plain) and sum(rate[k] for k in plain) <= 40


def test_counts_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["ab", "ab", "c", "ü", "dd"]) for _ in range(2000))
    whole = quality.counts(text)
    monkeypatch.setattr(quality, "PIECE", 97)
    assert np.allclose(quality.counts(text), whole, atol=1e-4) and b"".join(quality.word_pieces(text.encode())) == text.encode()
