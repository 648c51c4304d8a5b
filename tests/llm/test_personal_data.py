"""Personal data: rules against plain patterns, trees against walks, and planted spans."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from lodeworks.llm import boosting, personal_data as pii

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == pii.IP:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == pii.CARD:
        return 12 <= len(digits) <= 19 and slow_luhn(digits)
    return kind == pii.EMAIL or 9 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span(), holds(k, m.group())) for k, p in enumerate(PLAIN) for m in p.finditer(text)]


def card(rng):
    digits = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(digits + str(c) for c in range(10) if slow_luhn(digits + str(c)))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04}"


def corpus(n=400):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghinorstuäé", k=rng.randint(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        for make in (card, phone, lambda r: f"{word()}.{r.randint(1, 99)}@mail.example.com", lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4))):
            if rng.random() < 0.4:
                words.insert(rng.randrange(len(words)), make(rng))
        rows.append((i, " ".join(words), "x", [1], 0))
    return rows, rng


SCHEMA = "doc_id long, text string, kind string, x array<int>, label int"


def test_rules_equal_plain_patterns():
    rng = random.Random(2)
    for alphabet in ("0123456789 -+().", "12. .", "ab@.-", "a1@.+ (", "9 -"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert sorted(pii.matches(text)) == sorted(plain(text)), text
    text = "x" + card(rng) + " " + card(rng) + " é@b.c a.b+c@d.e.f, 001.2.3.0004 256.1.1.1 +1 (219) 555-0563 12"
    assert sorted(pii.matches(text)) == sorted(plain(text))


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1." * 400_000, "+1" + " " * 500_000, "a@" * 300_000, "a.b@c" * 200_000, "(at" * 300_000, "-" * 1_000_000, "@" * 500_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    list(pii.matches(text))
    n = sum(1 for _ in zip(range(200_000), pii.proposals(text)))
    assert n <= 200_000 and time.time() - began < 20


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (3000, 6)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 2) | (x[:, 2] == 8)).astype(float)
    trees = boosting.boosted(x[:2000], y[:2000])
    margin = trees.margin(x[2000:])
    assert ((margin > 0) == (y[2000:] > 0)).mean() > 0.98
    for row, expected in zip(x[2000:2010], margin):  # a walk down every tree
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - expected) < 1e-9
    score, label = rng.integers(0, 40, 300), rng.integers(0, 2, 300)
    steps, p = boosting.isotonic(score.astype(float), label.astype(float))
    assert (np.diff(p) > 0).all()
    fit = p[np.searchsorted(steps, score, side="right") - 1]
    # The least squares of all rising step functions, as means of means: max over starts of min over ends.
    values = np.unique(score)
    for v in values[::7]:
        best = max(min(label[(score >= a) & (score <= b)].mean() for b in values[values >= v]) for a in values[values <= v])
        assert abs(fit[score == v][0] - best) < 1e-12


def spans(df, text):
    return {r["doc_id"]: {(pii.KINDS[s["kind"]], r[text][s["start"] : s["end"]], s["base"]) for s in r["personal_data"]} for r in df.collect()}


def test_planted_spans_are_added_and_rules_stay(spark):
    rows, rng = corpus()
    glued = f"{phone(rng)} {card(rng)}"
    planted = {
        1000: (f"reach me under {glued} any time", {("phone", glued[:17]), ("card", glued[18:])}),
        1001: ("call me at (219) 555-0563 tonight", {("phone", "(219) 555-0563")}),
        1002: ("write to jane.doe7 [at] example [dot] com please", {("email", "jane.doe7 [at] example [dot] com")}),
        1003: ("host 10[.]0[.]12[.]251 is down", {("ip", "10[.]0[.]12[.]251")}),
        1004: ("born 2024-01-15 10:22, pi is 3.14159265358979, order 123456789012, the book 978-3-16-148410-0, met at noon dot com", set()),
        1005: ("", set()),
    }
    rows += [(d, t, "y", [2], 1) for d, (t, _) in planted.items()] + [(2000, None, None, None, None), (0, rows[0][1], "x", [1], 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = pii.personal_data(docs.repartition(5))
    assert found.columns == [*docs.columns, "personal_data"]
    kept = found.collect()
    assert len(kept) == len(rows) and sorted(map(repr, kept)) == sorted(map(repr, pii.personal_data(docs.coalesce(1)).collect()))
    for r in kept:
        text = r["text"] or ""
        own = [(s["start"], s["kind"], s["end"]) for s in r["personal_data"] if s["base"]]
        assert own == sorted((a, k, b) for k, a, b, good in plain(text) if good)
        assert [(s["start"], s["kind"], s["end"]) for s in r["personal_data"]] == sorted((s["start"], s["kind"], s["end"]) for s in r["personal_data"])
        free = sorted((s["start"], s["end"]) for s in r["personal_data"] if not s["base"])
        assert all(b <= c for (_, b), (c, _) in zip(free, free[1:]))
        assert all(b <= s["start"] or s["end"] <= a for a, b in free for s in r["personal_data"] if s["base"])
        if r["doc_id"] in planted:
            assert {(pii.KINDS[s["kind"]], text[s["start"] : s["end"]]) for s in r["personal_data"] if not s["base"]} == planted[r["doc_id"]][1], text
        elif r["doc_id"] < 1000:
            assert not free or re.search(r"[0-9] [0-9+]", text), text  # only where spans of rules touch
    hidden = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert hidden[1001] == "call me at [phone] tonight" and hidden[2000] is None and hidden[1000] == "reach me under [phone] [card] any time"


def test_few_examples_add_nothing(spark):
    docs = spark.createDataFrame([(1, "a@b.c and (219) 555-0563", "x", None, 1), (2, None, None, None, None)], SCHEMA)
    assert [[(s["start"], s["end"], s["base"]) for s in r["personal_data"]] for r in pii.personal_data(docs).orderBy("doc_id").collect()] == [[(0, 5, True)], []]
    assert pii.personal_data(docs.limit(0)).count() == 0
    assert pii.redacted(docs.limit(0)).columns == docs.columns


def test_query_counts_each_kind(spark, tmp_path):
    rng = random.Random(8)
    texts = ["", None, "a@b.cc", "1.2.3.4 5.6.7.8 9.9.9.9", f"{card(rng)}, {card(rng)}", f"{phone(rng)}, {phone(rng)}; x@y.zz", f"1.1.1.1, {card(rng)}, {phone(rng)}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in pii.op13_personal_data(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = sorted((a, k, b) for k, a, b, good in plain(text or "") if good)
        assert [found[i][f"n_{name}"] for name in pii.KINDS] == [sum(k == kind for _, k, _ in base) for kind in range(4)], text
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert [found[3]["n_ip"], found[4]["n_card"], found[5]["n_phone"], found[5]["n_email"]] == [3, 2, 2, 1]
