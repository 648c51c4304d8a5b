"""Small corpora with every awkward case."""

from __future__ import annotations

import random

import pytest

#: Columns that clash with names that operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, key long, n long, _row string, _id long, label string, word long"
STOP = {"en": "the of and to in is that was for it with as".split(), "fr": "le la de et les des un une que dans pour est".split(), "de": "der die und das den von zu mit ist nicht ein eine".split()}


def words(rng: random.Random, lang: str, n: int) -> str:
    syllables = {"en": "ing ter ation the ough ea st ly wh er", "fr": "ais eur tion elle ou ez ique ment oi é", "de": "ung sch ein ich keit ver ge ß ü tz"}[lang].split()
    return " ".join(rng.choice(STOP[lang]) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(4)
    texts: list[tuple[int | None, str | None, str | None]] = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        texts.append((i, words(rng, lang, rng.randint(20, 120)), lang))
    base = texts[0][1]
    near = base.split()
    near[len(near) // 2] = "changed"
    long = words(rng, "en", 30_000)
    texts += [(100, base, "en"), (101, base.upper(), "en"), (102, " ".join(near), "en"), (103, None, "en"), (104, "", None), (105, " \t\n", "fr"), (106, "one two", "en"), (107, "One  two", "en"), (108, "12345 67890 !!", None), (109, long, "en"), (110, long + " tail", "en"), (None, "a row without an id stands here all alone", "en"), (5, texts[5][1], "de"), (111, "日本語のテキスト", None)]
    return [(d, t, lang, f"s{k % 2}", None if t is None else len(t), "x", 0.5, k, k, "r", k, "l", k) for k, (d, t, lang) in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(a, b) -> bool:
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
