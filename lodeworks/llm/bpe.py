"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A merge can only ever build a token of the vocabulary. Two neighbouring bytes that stand inside no token of the
vocabulary are therefore never merged across, whatever surrounds them: between them there is a certain token boundary.
Each word of the pre-tokenizer is cut at all such places, the fragments are encoded independently of each other (and
remembered, as they recur far more often than words), and the ids are concatenated. Decoding joins the bytes of the
ids. Rows are independent, so the work is one pass over the column without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import releasing

#: The split of text into words that byte-level pre-tokenizers of this family fix (a fixed value of the format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts within Latin-1, where the classes are short enough to be spelt out for the faster engine.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
LATIN_PRE_TOKENS = rf" ?[{LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+"
#: First and last of the letters, and of the numbers, that Unicode 16.0, by which the library splits, added to 15.1 (fixed values).
ADDED_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
ADDED_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Bytes of words, and of fragments, that a worker remembers, and as many of the time before; with what Python adds to an
#: entry, and to longer ones than LONGEST nothing. Bounds memory, never results.
REMEMBER_WORDS, REMEMBER_FRAGMENTS = 28 << 20, 16 << 20
ENTRY, LONGEST = 200, 1024
#: Bytes from which a fragment is merged by a heap instead of by looking for the best pair again after every merge.
HEAPED = 48
#: Characters from which a text is encoded in blocks of words, and words of a block.
LONG_TEXT, BLOCK_WORDS = 1 << 18, 1 << 14
#: Bits of an id beside the rank of a merge, and what stands for no merge.
_ID = 24
_ID_MASK, _NONE = (1 << _ID) - 1, 1 << 62
#: What can be returned, with its type.
FIELDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _as_class(points: np.ndarray) -> str:
    """Code points, in order, as the inside of a character class."""
    edges = np.flatnonzero(np.diff(points) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.r_[0, edges + 1]], points[np.r_[edges, len(points) - 1]])) if len(points) else ""


@cache
def unicode_classes() -> tuple[str, str, str]:
    """Letters and numbers of Unicode 16.0, and the characters that the installed ``regex`` takes for something else, each as the inside of a
    character class: from the tables of Python's 15.1 or 16.0 and the added ones, whatever version ``regex`` has."""
    if unicodedata.unidata_version not in ("15.1.0", "16.0.0"):
        raise RuntimeError(f"character classes of Unicode 16.0 can't be told from those of {unicodedata.unidata_version}")
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    kinds, text = np.array([unicodedata.category(chr(p))[0] for p in points]), "".join(map(chr, points))
    classes, other = [], np.zeros(len(points), bool)
    for kind, added, name in (("L", ADDED_LETTERS, r"\p{L}"), ("N", ADDED_NUMBERS, r"\p{N}")):
        own = kinds == kind
        for a, b in added:
            own |= (points >= a) & (points <= b)
        seen = np.zeros(len(points), bool)
        for m in regex.finditer(name + "+", text):
            seen[m.start() : m.end()] = True
        other |= seen != own
        classes.append(_as_class(points[own]))
    return classes[0], classes[1], _as_class(points[other])


def byte_of_symbol() -> dict[str, int]:
    """Printable bytes stand for themselves in the vocabulary, the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes whole texts. ``spec``: the JSON text of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        pre, model = j["pre_tokenizer"], j["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or j.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        to_byte = byte_of_symbol()
        self.specials = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes_of = {i: bytes(map(to_byte.__getitem__, s)) for s, i in model["vocab"].items() if s not in self.specials}
        vocabulary = model["vocab"]
        self.of_byte = [vocabulary[s] for s in sorted(to_byte, key=to_byte.__getitem__)]
        #: (left id, right id) -> rank, and below it in _ID bits the id of both together
        self.merges: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocabulary[a], vocabulary[b]), rank << _ID | vocabulary[a + b])
        self.inside = np.zeros((256, 256), bool)
        for b in self.bytes_of.values():
            self.inside[list(b[:-1]), list(b[1:])] = True
        self.pairs = self.inside.tolist()
        any_words, latin_words = regex.compile(PRE_TOKENS), re.compile(LATIN_PRE_TOKENS)
        letters, numbers, disputed = unicode_classes()
        spelt = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")
        self.is_disputed = re.compile(f"[{disputed}]").search if disputed else lambda _: None
        self.split_any, self.split_latin = any_words.findall, latin_words.findall
        self.iter_any, self.iter_latin = any_words.finditer, latin_words.finditer
        #: For the few texts with a character that ``regex`` puts into another class.
        self.split_spelt, self.iter_spelt = spelt.findall, spelt.finditer
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()
        self.fragments = _Remembered(self._encode_fragment, REMEMBER_FRAGMENTS)
        self.of_word = _Remembered(self._encode_word, REMEMBER_WORDS)
        self.bytes_of_decimal = {str(i): b for i, b in self.bytes_of.items()}

    def cuts(self, word: bytes) -> list[int]:
        """Places where no token can span: a pair of bytes that no token holds."""
        pairs = self.pairs
        return [i for i in range(1, len(word)) if not pairs[word[i - 1]][word[i]]]

    def _encode_word(self, word: str) -> str:
        b = word.encode()
        at = self.cuts(b)
        if not at:
            return self.fragments[b]
        return ",".join([self.fragments[b[lo:hi]] for lo, hi in zip([0, *at], [*at, len(b)])])

    def _encode_fragment(self, b: bytes) -> str:
        ids = [self.of_byte[x] for x in b]
        return ",".join(map(str, self._merged(ids) if len(ids) < HEAPED else self._merged_by_heap(ids)))

    def _merged(self, ids: list[int]) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost of several, until there is none."""
        get = self.merges.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [best & _ID_MASK]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: neighbours are linked, and pairs that no longer stand are skipped as they come up."""
        get, n = self.merges.get, len(ids)
        after, before, gone = [*range(1, n), -1], list(range(-1, n - 1)), -1
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, _ = m & _ID_MASK, gone
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], new))) is not None:
                heapq.heappush(heap, (m, h, ids[h], new))
        return [i for i in ids if i != gone]

    def split_words(self, text: str) -> list[str]:
        latin = text.isascii() or max(text) <= "\xff"
        return self.split_latin(text) if latin else self.split_spelt(text) if self.is_disputed(text) else self.split_any(text)

    def encode(self, text: str) -> list[str]:
        """The ids as decimal strings joined by commas, a string for each word or special token."""
        if not self.specials or not any(s in text for s in self.specials):
            return list(map(self.of_word.__getitem__, self.split_words(text)))
        return [x for block in self.encode_blocks(text) for x in block]

    def encode_blocks(self, text: str) -> Iterator[list[str]]:
        """``encode``, a bounded number of words at a time."""
        of_word = self.of_word.__getitem__
        parts = self.split_specials(text) if self.split_specials else [text]
        for part in parts:
            if part in self.specials:
                yield [str(self.specials[part])]
            elif part:
                latin = part.isascii() or max(part) <= "\xff"
                words = map(re.Match.group if latin else regex.Match.group, (self.iter_latin if latin else self.iter_spelt if self.is_disputed(part) else self.iter_any)(part))
                while block := list(map(of_word, islice(words, BLOCK_WORDS))):
                    yield block

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by commas."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of_decimal.__getitem__, ids.split(","))) if ids else b""


class _Remembered(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held, self.before = make, most, 0, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        size = ENTRY + len(key) + len(value)
        if size <= LONGEST:
            if self.held + size > self.most:
                self.before, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += size
        return value


_codecs: dict[str, Codec] = {}


def _codec(spec: str) -> Codec:
    """One for each worker process and file."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def bpe_encode_decode(docs: DataFrame, spec: str, fields: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids again; returns ``id_col`` and ``fields``.

    fields: n_tokens; ids (array<int>); decoded (the text that the ids give back); ids_sha256 (of the decimal ids
    joined by commas); decoded_sha256 (of ``decoded`` in UTF-8). ``spec`` is the JSON text of the tokenizer file, of
    fixed size, and goes to the executors with the task. Special tokens standing in a text are encoded as such, none
    are added. Null is an empty text: 0 tokens, no ids. A text of any length is handled whole. Rows repeated, null
    ids and further columns are fine; no rows give no rows.
    """
    kind = {f: FIELDS[f] for f in fields}
    schema = ", ".join(f"{k} {v}" for k, v in {id_col: dict(docs.dtypes)[id_col], **kind}.items())
    shipped = docs.sparkSession.sparkContext.broadcast(spec)
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols = zip(*encoded(codec, part.column(1), fields))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, types[kind[f]]) for f, v in zip(fields, cols))], [id_col, *fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(releasing(work), schema)


def encoded(codec: Codec, texts: pa.Array, fields: tuple[str, ...]) -> Iterator[tuple]:
    """The ``fields`` of each text. Of a long one only what is asked for is kept whole."""
    for scalar in texts:
        text = scalar.as_py() or ""
        if len(text) < LONG_TEXT:
            blocks = [",".join(codec.encode(text))]
        else:
            blocks = (",".join(block) for block in codec.encode_blocks(text))
        n, ids, data, of_ids = 0, [], bytearray(), hashlib.sha256()
        want_ids, want_data, want_hash = "ids" in fields, "decoded" in fields or "decoded_sha256" in fields, "ids_sha256" in fields
        for block in blocks:
            if not block:
                continue
            if want_hash:
                of_ids.update(("," + block if n else block).encode())
            n += block.count(",") + 1
            if want_ids:
                ids.append(np.array(block.split(","), dtype=np.int32))
            if want_data:
                data += codec.decode_bytes(block)
        decoded = data.decode("utf-8", "replace") if want_data else None
        values = {"n_tokens": n, "decoded": decoded}
        if want_ids:
            values["ids"] = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if want_hash:
            values["ids_sha256"] = of_ids.hexdigest()
        if "decoded_sha256" in fields:
            values["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
        yield tuple(values[f] for f in fields)


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public byte-level vocabulary of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_encode_decode(docs, tokenizer_spec(), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op10_bpe": op10_bpe}
