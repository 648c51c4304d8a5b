"""Personal data: rules, and spans that boosted trees add to them.

Four rules find e-mail addresses, IP addresses, card numbers and phone numbers. Beside them generators of high recall propose
spans, overlapping ones too: every run of digit groups of a fitting length, every word with an at sign, addresses with their signs
spelled out. Boosted trees, one set for each kind, look at the format of a proposal and at what stands around it. They learn from
a bounded sample of the corpus itself: spans of the rules and the same spans written otherwise are examples; proposals that
overlap no rule's match, and spans broken on purpose, are counter-examples. Proposals that overlap a match which a rule dropped
are not learned from, nor are such as pass a rule's check in another writing: whether a card number right after a phone number is
one is for the trees to tell. A held-out quarter of the sample calibrates scores; the threshold of a kind is the lowest score
whose calibrated probability is PRECISION or more.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodeworks.llm.boosting import Trees, boosted, isotonic
from lodeworks.llm.common import releasing

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Examples and counter-examples of a kind that the trees are fitted and calibrated with.
MOST_EXAMPLES = 4000
#: Calibrated probability that an added span needs.
PRECISION = 0.95
#: Held-out examples of a kind that calibration needs; with fewer, nothing is added.
FEWEST_HELD_OUT = 20
#: Proposals that are scored at a time.
CHUNK = 20_000

# Rules. Quantifiers are possessive, and at signs are looked up, so that every text takes linear time.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it holds) of all matches of the rules, leftmost and not overlapping within a kind."""
    for start, end in _emails(text):
        yield EMAIL, start, end, True
    for m in _IP.finditer(text):
        yield IP, *m.span(), all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split(".")))
    for m in _CARD.finditer(text):
        n = m.end() - m.start()
        digits = _digits(m.group()) if 12 <= n <= 37 else ""
        yield CARD, *m.span(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield PHONE, *m.span(), 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15


# Generators

_BETWEEN = frozenset(" ().-/[] ")
_CARD_GAPS, _IP_GAPS = ("", " ", "-", ".", " "), (".", "[.]", "(.)")
_NO_NAME = frozenset(" \t\r\n\v\f@<>()[]{},;:\"'=/|")
_WIDE_DOMAIN = re.compile(r"@([^\s@<>()\[\]{},;:\"'=/|]{1,255})")
_VEIL = r"\s?[\[({]\s?%s\s?[\])}]\s?"
_SIGN = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_VEILED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_VEIL % 'at'}[A-Za-z0-9-]{{1,63}}(?:(?:{_VEIL % 'dot'}|\.)[A-Za-z0-9-]{{2,63}})+", re.I)


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans of digit groups that end at each group; a group is kept only as long as 19 digits can reach it."""
    held: deque[tuple[int, int]] = deque(maxlen=19)
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if held and (start - held[-1][1] > 3 or not _BETWEEN.issuperset(text[held[-1][1] : start])):
            held.clear()
        held.append((start, end))
        if end < len(text) and (text[end].isalpha() or text[end] == "_"):
            continue
        n, groups, card, ip = 0, 0, True, True
        for k in range(len(held) - 1, -1, -1):
            lo, hi = held[k]
            n, groups = n + hi - lo, groups + 1
            if n > 19:
                break
            if groups > 1:
                gap = text[hi : held[k + 1][0]]
                card, ip = card and gap in _CARD_GAPS, ip and gap in _IP_GAPS
            ip = ip and hi - lo <= 3
            if lo and (text[lo - 1].isalpha() or text[lo - 1] == "_"):
                continue
            if card and n >= 12:
                yield CARD, lo, end
            if ip and groups == 4:
                yield IP, lo, end
            if 7 <= n <= 15 and groups <= 6 and (groups > 1 or n >= 9):
                if lo and text[lo - 1] == "(":
                    lo -= 1
                if lo and text[lo - 1] == "+":
                    lo -= 1
                yield PHONE, lo, end


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of everything that may be personal data."""
    yield from _numbers(text)
    at = text.find("@")
    while at >= 0:
        start = at
        while start > max(0, at - 64) and text[start - 1] not in _NO_NAME:
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        domain = _WIDE_DOMAIN.match(text, at)
        if domain and start < at:
            name = domain.group(1).rstrip(".-_!?*…")
            if "." in name:
                yield EMAIL, start, at + 1 + len(name)
        at = text.find("@", at + 1)
    if _SIGN.search(text):
        for m in _VEILED.finditer(text):
            yield EMAIL, *m.span()


# Features

#: Words that often stand before personal data of a kind, in a few languages, and such as rather tell of other numbers.
CUES = (
    ("mail", "contact", "contacto", "kontakt", "write to", "correo", "courriel", "adresse"),
    ("ip", "host", "server", "addr", "ping", "from", "login"),
    ("card", "visa", "master", "amex", "credit", "debit", "tarjeta", "carte", "karte", "payment"),
    ("tel", "phone", "call", "fax", "mobile", "cell", "handy", "telefon", "appel", "llam", "whatsapp", "sms"),
)
OTHER_CUES = ("version", "isbn", "issn", "doi", "section", "page", "no.", "id", "ref", "order", "$", "€", "#", "=")


def _kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """What the trees see: format, neighbours and context. Whether a phone number begins with a plus, which its rule goes by, is left out."""
    span = text[start:end]
    groups = [len(g) for g in _DIGITS.findall(span)]
    digits = _digits(span)
    gaps = [g for g in re.split(r"[0-9]+", span.strip("+()"))[1:-1]]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    around = text[max(0, start - 30) : start] + text[end : end + 30]
    near = max(1, len(around))
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    name, _, domain = span.partition("@")
    labels = domain.split(".") if domain else re.split(r"[^A-Za-z0-9-]+", span)
    parts = [min(int(g), 9999) if len(g) < 9 else 9999 for g in _DIGITS.findall(span)[:8]] or [0]
    return [
        float(v)
        for v in (
            len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
            len(set(gaps)), sum(map(len, gaps)), len(set(groups)) == 1, kind == CARD and luhn(digits), int(digits[0]) if digits else -1, len(set(digits)),
            max(parts), parts[0], parts[-1], sum(len(g) > 1 and g[0] == "0" for g in _DIGITS.findall(span)), "(" in span, "/" in span, "." in span,
            _kind_of(left), _kind_of(right), left in ".-/+" and left != "", right in ".-/" and right != "" and text[end + 1 : end + 2].isdigit(), _kind_of(text[start - 2 : start - 1] if start > 1 else ""),
            sum(c in before for c in CUES[kind]), sum(c in after for c in CUES[kind]), sum(c in before for c in OTHER_CUES),
            100 * sum(c.isdigit() for c in around) // near, 100 * sum(c.isalpha() for c in around) // near,
            len(name), len(labels), len(labels[-1]) if labels else 0, bool(labels) and labels[-1].isalpha(), len(span), "@" in span, bool(re.search(r"[\[({]|\bdot\b", span)), not span.isascii(),
        )
    ]


WIDTH = len(features("1", IP, 0, 1))

# Examples


def _regrouped(digits: str, sizes: tuple[int, ...], gap: str) -> str:
    out, at = [], 0
    for size in sizes:
        if at < len(digits):
            out.append(digits[at : at + size])
            at += size
    return gap.join([*out, digits[at:]] if at < len(digits) else out)


def variants(span: str, kind: int, salt: int) -> Iterator[tuple[str, int]]:
    """The span written otherwise (1), and broken ones (0); ``salt`` picks among them."""
    digits = _digits(span)
    gap = " -."[salt % 3]
    if kind == CARD:
        yield _regrouped(digits, (4, 4, 4, 4), gap), 1
        yield digits, 1
        yield digits[:-1] + str((int(digits[-1]) + 1 + salt % 8) % 10), 0
        short = digits[: 12 + salt % 3]
        if not luhn(short):
            yield short, 0
        yield _regrouped(digits, (3, 5, 1, 4), gap), 0
    elif kind == PHONE:
        groups = _DIGITS.findall(span)
        if len(groups) > 2 and sum(map(len, groups[1:])) >= 9:
            yield gap.join(groups[1:]), 1
            yield f"({groups[1]}) {'-'.join(groups[2:])}", 1
            yield f"{groups[0]}{gap}{gap.join(groups[1:])}", 1
        # Dates and times, spans of years, numbers of books, decimals, versions, bare numbers.
        year, month, day, hour = 1900 + salt % 150, 1 + salt % 12, 1 + salt % 28, salt % 24
        mark = "-/."[salt % 3]
        yield f"{year}{mark}{month:02}{mark}{day:02}" + (f" {hour:02}" if salt & 8 else ""), 0
        yield f"{day}{mark}{month}{mark}{year}" + (f" {hour:02}" if salt & 8 else ""), 0
        yield f"{year}-{year + salt % 40}", 0
        isbn = f"978-{digits[0]}-{digits[1:3]}-{(digits * 2)[3:9]}-{salt % 10}"
        yield isbn[: len(isbn) - 2 * (salt & 1)], 0
        yield f"{salt % 100}.{(digits * 2)[: 8 + salt % 6]}", 0
        yield f"{digits[:1]}.{digits[1:3]}.{digits[3:7]}", 0
        yield _regrouped(digits, (1, 2, 1, 3, 1), gap), 0
        yield (digits * 2)[: 9 + salt % 7], 0
    elif kind == IP:
        parts = span.split(".")
        yield ("[.]" if salt & 1 else "(.)").join(parts), 1
        yield ".".join([*parts[:3], str(256 + salt % 700)]), 0
        yield ".".join([parts[0], str(300 + salt % 600), *parts[2:]]), 0
        yield ".".join([*parts[:2], f"{256 + salt % 500}", parts[3]]), 0
        yield ".".join(p.zfill(3) for p in parts), 0
    else:
        name, _, domain = span.partition("@")
        labels = domain.split(".")
        opened, closed = "[("[salt & 1], "])"[salt & 1]
        yield f"{name} {opened}at{closed} {f' {opened}dot{closed} '.join(labels)}", 1
        yield f"{name}{opened}at{closed}{domain}", 1
        yield f"{''.join(c for c in name if c.isalpha())}é@{'.'.join(labels[-2:])}", 1
        yield f"{name}@{labels[0]}.{salt % 1000}", 0
        yield f"{name}@{salt % 90}.{salt % 7}x", 0
        yield f"{name[:1]}@{labels[0][:1]}.{labels[-1][:1]}", 0


def _valid(span: str, kind: int) -> bool:
    """Whether a proposal would be personal data by its rule if it were written as the rule wants: no counter-example. Of phone numbers that
    can't be told."""
    if kind == IP:
        return all(int(p) <= 255 for p in _DIGITS.findall(span))
    return kind == EMAIL or kind == CARD and luhn(_digits(span))


def examples(text: str) -> Iterator[tuple[int, int, int, str, int, int]]:
    """(kind, label, hash, text, start, end): the hash is of the words around, so that copies are one example."""
    found = list(matches(text))
    good = {(k, a, b) for k, a, b, holds in found if holds}
    for k, a, b in sorted(good):
        before, span, after = text[max(0, a - 60) : a], text[a:b], text[b : b + 60]
        if len(span) > 400:
            continue
        salt = zlib.crc32(f"{k}|{before[-30:]}|{span}|{after[:30]}".encode())
        yield k, 1, salt, before + span + after, len(before), len(before) + len(span)
        for i, (other, label) in enumerate(variants(span, k, salt)):
            yield k, label, zlib.crc32(f"{salt}|{i}".encode()), before + other + after, len(before), len(before) + len(other)
    taken = sorted((a, b) for k, a, b, _ in found if b - a > 6 or (k, a, b) in good)
    ends = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    starts = [a for a, _ in taken]
    for k, a, b in proposals(text):
        at = int(np.searchsorted(starts, b))  # matches that begin before the proposal ends
        if at and ends[at - 1] > a or _valid(text[a:b], k):
            continue
        yield k, 0, zlib.crc32(f"{k}|{text[max(0, a - 30) : b + 30]}".encode()), text[max(0, a - 60) : b + 60], min(a, 60), min(a, 60) + b - a


_EXAMPLES = "kind int, label int, hash long, x array<double>"


def gathered(docs: DataFrame, text: str, most: int) -> DataFrame:
    """Rows of _EXAMPLES: of each kind and label the ``most`` with the smallest hashes among all documents, one for equal hashes. A task
    returns no more than that, however many examples it meets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list[int], dict[int, list[float]]]] = {}
        for batch in batches:
            for value in batch.column(0):
                for kind, label, salt, window, start, end in examples(value.as_py()):
                    largest, rows = held.setdefault((kind, label), ([], {}))
                    if salt in rows or (len(rows) >= most and salt > -largest[0]):
                        continue
                    rows[salt] = features(window, kind, start, end)
                    heapq.heappush(largest, -salt)
                    if len(rows) > most:
                        del rows[-heapq.heappop(largest)]
        for (kind, label), (_, rows) in held.items():
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["kind", "label", "hash", "x"])

    found = docs.where(F.col(text).rlike("[0-9@]|(?i)[\\[({]\\s?at\\s?[\\])}]")).select(text).mapInArrow(releasing(work), _EXAMPLES)
    one = found.groupBy("kind", "label", "hash").agg(F.min("x").alias("x"))
    order = Window.partitionBy("kind", "label").orderBy("hash")
    return one.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


@dataclass
class Detector:
    """The trees of a kind, the steps of its calibration and the lowest margin that is let through."""

    trees: Trees
    steps: np.ndarray
    probabilities: np.ndarray
    cut: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return self.probabilities[np.maximum(np.searchsorted(self.steps, margin, side="right") - 1, 0)]


def fitted(kinds: np.ndarray, labels: np.ndarray, hashes: np.ndarray, x: np.ndarray, precision: float = PRECISION) -> dict[int, Detector]:
    """Detectors of the kinds with examples enough on both sides; a quarter of them, by hash, calibrates and is not learned from."""
    out = {}
    order = np.lexsort((hashes, labels, kinds))
    kinds, labels, hashes, x = kinds[order], labels[order].astype(float), hashes[order], x[order]
    for kind in range(len(KINDS)):
        own, held = kinds == kind, hashes // 7 % 4 == 0
        train, test = own & ~held, own & held
        if test.sum() < FEWEST_HELD_OUT or len(set(labels[train])) < 2 or len(set(labels[test])) < 2:
            continue
        trees = boosted(x[train], labels[train])
        steps, probabilities = isotonic(trees.margin(x[test]), labels[test])
        sure = np.flatnonzero(probabilities >= precision)
        if len(sure):
            out[kind] = Detector(trees, steps, probabilities, float(steps[sure[0]]))
    return out


def added(text: str, base: list[tuple[int, int, int]], detectors: dict[int, Detector]) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, probability) of the proposals that pass and overlap no span of the rules; of overlapping ones the surest, then the
    longest, then the first stays."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    passed: list[tuple[float, int, int, int]] = []
    chunk: list[tuple[int, int, int]] = []

    def score() -> None:
        for kind, detector in detectors.items():
            own = [c for c in chunk if c[0] == kind]
            if own:
                margin = detector.trees.margin(np.array([features(text, *c) for c in own]))
                p = detector.probability(margin)
                passed.extend((-float(p[i]), own[i][1] - own[i][2], own[i][1], kind) for i in np.flatnonzero(margin >= detector.cut))
        chunk.clear()

    for kind, a, b in proposals(text):
        at = int(np.searchsorted(starts, b)) if starts else 0
        if kind in detectors and not (at and ends[at - 1] > a):
            chunk.append((kind, a, b))
            if len(chunk) >= CHUNK:
                score()
    score()
    kept: list[tuple[int, int, int, float]] = []
    free = np.zeros(0, np.int64)
    for p, length, start, kind in sorted(passed):
        end = start - length
        at = int(np.searchsorted(free, start, side="right"))  # ``free`` holds starts and ends of kept spans in turn
        if at % 2 == 0 and (at == len(free) or free[at] >= end):
            free = np.insert(free, at, (start, end))
            kept.append((kind, start, end, -p))
    return kept


_SPANS = ArrayType(StructType().add("kind", "integer").add("start", "long").add("end", "long").add("base", "boolean").add("score", "double"))


def personal_data(docs: DataFrame, text: str = "text", column: str = "personal_data", most_examples: int = MOST_EXAMPLES, precision: float = PRECISION) -> DataFrame:
    """``docs`` with ``column``: an array of (kind, start, end, base, score), in code points with the end exclusive, by start, then kind in the
    order of KINDS. ``base`` spans are those of the rules, with score 1; the others are added by the trees, overlap no other span,
    and carry their calibrated probability.

    Texts are scanned whole; null and empty ones have no span. The trees learn from at most ``most_examples`` examples and as many
    counter-examples of each kind, those with the smallest hashes of all documents, so results don't depend on partitions; equal
    texts get equal spans. A kind with too few examples adds nothing. Other columns pass through, but for one named ``column``, which is
    replaced; an empty table gives no rows. A match of the rules of any length is a span.
    """
    sample = gathered(docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("t")), "t", most_examples)
    rows = sample.toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH) if rows.num_rows else np.zeros((0, WIDTH))
    detectors = fitted(*(rows[c].to_numpy() for c in ("kind", "label", "hash")), x, precision)
    shipped = docs.sparkSession.sparkContext.broadcast(detectors)
    names = [c for c in docs.columns if c != column]
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            out = []
            for value in batch.column(place):
                own = value.as_py() or ""
                base = [(k, a, b) for k, a, b, holds in matches(own) if holds]
                spans = [(a, k, b, True, 1.0) for k, a, b in base] + [(a, k, b, False, p) for k, a, b, p in added(own, base, shipped.value)]
                out.append([{"kind": k, "start": a, "end": b, "base": is_base, "score": p} for a, k, b, is_base, p in sorted(spans)])
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != column} | {column: pa.array(out, kind_of)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add(column, _SPANS)
    return docs.mapInArrow(releasing(work), schema)


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``personal_data`` replaced by its kind in brackets; where spans overlap, the first one is, and what of the
    others goes beyond it. Options are those of ``personal_data``; null texts stay null."""
    found = personal_data(docs, text, "_spans", **options)

    @F.pandas_udf("string")
    def replaced(texts, spans):
        import pandas as pd

        def one(t, own):
            if t is None:
                return None
            out, at = [], 0
            for s in own:
                if s["end"] > at:
                    out += [t[at : max(at, s["start"])], f"[{KINDS[s['kind']]}]"]
                    at = s["end"]
            return "".join(out) + t[at:]

        return pd.Series([one(t, own) for t, own in zip(texts, spans)])

    return found.withColumn(text, replaced(F.col(f"`{text}`"), F.col("_spans"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: int) -> Column:
    """Spans of the rules of a kind in ``s``. The lambda takes one parameter only: a second one, even with a default, would be the place in the array."""
    return F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs).select("doc_id", F.col("personal_data").alias("s"))
    base = F.filter("s", lambda s: s["base"])
    counts = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("s")).alias("spans"), (F.size("s") - F.size(base)).cast("long").alias("n_added"))


QUERIES = {"op13_personal_data": op13_personal_data}
