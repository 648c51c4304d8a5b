"""License scans by diagonal voting.

Every rolling word pair and triple of every text is hashed and joined in Spark to the places where license templates hold
it. A hit votes for its diagonal, the place in the text less the place in the template: words in the template's order
vote for one diagonal. Votes are added up for each text, template and diagonal; neighbouring diagonals (words put in
or left out) are merged; a merged span with votes for enough of the template is a candidate. Candidates are verified on the
words themselves: the words of the span and those of the template are aligned, and a span counts if enough of the
template's words stand in it in their order, and little else. Its ends are those of the alignment. Words that make another
license of it (NonCommercial, ShareAlike, Lesser and the like) have to be those of the template, and a notice that is
denied ("not licensed under") is none.

Phrases are templates of word pairs that must stand there completely. Other templates are of any length, from a sentence to
a whole license, and go by triples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import text as T
from lodeworks.llm.common import bit_words, has_bit, written

#: Words of a gram: of phrases, and of all other templates.
PHRASE_K, K = 2, 3
#: Shares of a template's grams that votes must reach, and of its words that must be found in order.
MIN_VOTES, MIN_COVER = 0.6, 0.8
#: Logarithm of the bits of the filter of texts with candidates: 2 MB, whatever the corpus.
FILTER_BITS = 24


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False


# The phrases and labels of the base scan.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# Opening sentences and usual notices of public licenses, and the whole texts of short ones.
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    Template("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    Template("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
TEMPLATES = PHRASES + NOTICES
#: Words of names, each of which makes another license, and words that deny; the latter count in templates of up to NOTICE_WORDS words and right
#: before them, as whole licenses deny much.
NAME_WORDS = "noncommercial nc commercial non noderivatives noderivs derivatives nd sharealike share alike sa lesser affero"
DENYING_WORDS = "not never neither nor cannot isn aren wasn no longer"
NOTICE_WORDS, BEFORE = 40, 2


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each word with the k - 1 next ones, for all words of a chunk; grams across rows are to be left out."""
    n = max(len(hashes) - k + 1, 0)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * T.SHINGLE_FACTORS[j]
    return T.signed(T.mix(total))


def template_words(template: Template) -> np.ndarray:
    (chunk,) = T.chunks(pa.array([template.text]))
    return T.words(chunk, T.ALNUM).hash


def template_grams(templates: Sequence[Template]) -> list[tuple[int, int, int]]:
    """(hash, template, place) of every gram."""
    out = []
    for number, template in enumerate(templates):
        k = PHRASE_K if template.phrase else K
        found = gram_hashes(template_words(template), k)
        if not len(found):
            raise ValueError(f"a template has {k} words or more: {template.text[:40]!r}")
        out += [(int(h), number, place) for place, h in enumerate(found)]
    return out


def aligned(words: np.ndarray, template: np.ndarray) -> tuple[int, int, float]:
    """First word and end of the template's words found in order among ``words``, and their share of the template, or of the words from the first
    to the end where these are more."""
    blocks = [b for b in SequenceMatcher(None, words.tolist(), template.tolist(), autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0, 0, 0.0
    first, end = blocks[0].a, blocks[-1].a + blocks[-1].size
    return first, end, sum(b.size for b in blocks) / max(len(template), end - first)


@cache
def _word_set(words: str) -> np.ndarray:
    return template_words(Template("", words))


def same_licence(words: np.ndarray, first: int, end: int, template: np.ndarray) -> bool:
    """Whether the span holds just the name words of the template, and a notice no other denying words than it, with the words right before."""
    names, denying = _word_set(NAME_WORDS), _word_set(DENYING_WORDS)
    alike = lambda own, kind: np.array_equal(np.sort(own[np.isin(own, kind)]), np.sort(template[np.isin(template, kind)]))
    notice = len(template) <= NOTICE_WORDS
    return alike(words[first:end], names) and (not notice or alike(words[max(first - BEFORE, 0) : end], denying))


_TEXT_KEY = ("_id", "_text")


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")]


def _candidates(docs: DataFrame, templates: Sequence[Template], min_votes: float, merge: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, n_words, copies, candidates): one row for all rows that are alike in id and text; candidates is an array of
    (template, start, end), words from 0."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(2)):
                w = T.words(chunk, T.ALNUM)
                n = np.diff(w.first)
                # All pairs of a row, all triples, and one more entry that stands for the row itself.
                parts, counts = [], []
                for k in (PHRASE_K, K):
                    whole = gram_hashes(w.hash, k)
                    inside = w.row[: len(whole)] == w.row[k - 1 :] if len(whole) else np.zeros(0, bool)
                    parts.append(whole[inside])
                    counts.append(np.maximum(n - k + 1, 0))
                ends = np.cumsum(counts[0] + counts[1] + 1)
                values = np.zeros(int(ends[-1]), np.int64)
                begin = ends - (counts[0] + counts[1] + 1)
                for part, count, first in ((parts[0], counts[0], begin), (parts[1], counts[1], begin + counts[0])):
                    values[np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(part))] = part
                grams = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))
                own = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n, pa.int64()), grams], [*_TEXT_KEY, "n_words", "_grams"])

    rows = docs.select(*_keys(id_col, text_col), F.col(text_col)).mapInArrow(work, f"_id {kind}, _text long, n_words long, _grams array<long>")
    placed = rows.select(*_TEXT_KEY, "n_words", F.size("_grams").alias("_size"), F.posexplode("_grams").alias("_at", "_gram"))
    grams = template_grams(templates)
    counts = [sum(number == t for _, number, _ in grams) for t in range(len(templates))]
    known = F.broadcast(spark.createDataFrame(grams, "_gram long, template int, place int"))  # a parameter, of fixed size
    # A row's last entry has no template: it keeps rows without hits, and counts rows that are alike.
    joined = placed.join(known, "_gram", "left").where(F.col("template").isNotNull() | (F.col("_at") == F.col("_size") - 1))
    phrase = F.get(F.array(*[F.lit(t.phrase) for t in templates]), F.coalesce("template", F.lit(0)))
    word = F.col("_at") - F.when(phrase, 0).otherwise(F.greatest(F.col("n_words") - PHRASE_K + 1, F.lit(0)))
    # Votes of rows that are alike fall together: each place of a diagonal is hit once a row.
    votes = joined.groupBy(*_TEXT_KEY, "n_words", "template", (word - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    along = Window.partitionBy(*_TEXT_KEY, "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= F.when(phrase, 0).otherwise(merge)
    runs = votes.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along))
    width = F.when(phrase, PHRASE_K).otherwise(K)
    merged = runs.groupBy(*_TEXT_KEY, "n_words", "template", "_run").agg(F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high") + width).alias("end"))
    of_row = merged.groupBy(*_TEXT_KEY, "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("votes"))).alias("copies"),
        F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "votes"))).alias("all"),
    )
    needed = F.array(*[F.lit(float(c if t.phrase else min_votes * c)) for c, t in zip(counts, templates)])
    enough = F.filter("all", lambda c: c["votes"] >= F.get(needed, c["template"]) * F.col("copies"))
    return of_row.select(*_TEXT_KEY, "n_words", "copies", F.transform(enough, lambda c: F.struct(c["template"].alias("template"), c["start"].alias("start"), c["end"].alias("end"))).alias("candidates"))


_SPANS = "array<struct<start: long, end: long, label: string, phrase: boolean, cover: double>>"


def _verified(docs: DataFrame, rows: DataFrame, templates: Sequence[Template], min_cover: float, merge: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, spans) of the rows that have candidates. Their texts are read again; a filter of fixed size decides which
    texts move, those it lets through needlessly do no harm, and a task sends a text that is repeated once."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    wanted = rows.where(F.size("candidates") > 0).select(*_TEXT_KEY, "candidates")
    shipped, known = spark.sparkContext.broadcast(bit_words(wanted, "_text", FILTER_BITS)), [template_words(t) for t in templates]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            hit = np.flatnonzero(has_bit(shipped.value, batch.column(1).to_numpy()))
            fresh = [i for i in hit.tolist() if (key := (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())) not in sent and not sent.add(key)]
            if fresh:
                yield batch.take(pa.array(fresh))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk in T.chunks(batch.column(2)):
                w = T.words(chunk, T.ALNUM)
                for r in range(chunk.hi - chunk.lo):
                    own, spans = w.hash[w.first[r] : w.first[r + 1]], set()
                    for c in batch.column(3)[chunk.lo + r].as_py():
                        number, lo, hi = c["template"], c["start"], c["end"]
                        label, _, phrase = templates[number]
                        if phrase:
                            first, end, cover = lo, hi, float(np.array_equal(own[lo:hi], known[number]))
                        else:
                            lo = max(lo - merge, 0)
                            first, end, cover = aligned(own[lo : hi + merge], known[number])
                            first, end = lo + first, lo + end
                        if cover >= (1.0 if phrase else min_cover) and (phrase or same_licence(own, first, end, known[number])):
                            spans.add((first, end, label, phrase, cover))
                    out.append([dict(zip(("start", "end", "label", "phrase", "cover"), s)) for s in sorted(spans)])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("phrase", pa.bool_()), ("cover", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kinds)], ["_id", "_text", "spans"])

    texts = docs.select(*_keys(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(read, f"_id {kind}, _text long, text string")
    a, b = texts.alias("a"), wanted.alias("b")
    both = a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._text") == F.col("b._text")))
    found = both.select("a._id", "a._text", "text", "candidates").mapInArrow(check, f"_id {kind}, _text long, spans {_SPANS}")
    return found.dropDuplicates(["_id", "_text"])  # of tasks that met the same row


def find_licences(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, min_cover: float = MIN_COVER, min_votes: float = MIN_VOTES, merge: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All license spans of every whole text: id, n_words, spans (array of label, phrase, start, end, cover; words from 0,
    end excluded; in order of start, end, label). cover is the share of the template's words that the span holds in order.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z folded; null is an empty text. Each input row gives
    one row, repeated rows too; null ids and other columns are fine; overlapping spans of different templates are all
    returned; no rows give no rows. Words put in between count against a span, and name words and denials decide
    (see ``same_licence``). Texts and templates of any length are whole. The templates, a parameter, are broadcast;
    of texts, only hits are shuffled, and those texts that have candidates, for verification.
    """
    rows = written(_candidates(docs, templates, min_votes, merge, id_col, text_col), "licence-candidates")
    spans = written(_verified(docs, rows, templates, min_cover, merge, id_col, text_col), "licence-spans")
    a, b = rows.drop("candidates").alias("a"), spans.alias("b")
    found = a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._text") == F.col("b._text")), "left")
    found = found.select("a._id", "a._text", "n_words", "copies", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    # Unfolded in two steps, dealt out in between: a row repeated very often is not unfolded by one task.
    block = 4096
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block).cast("long"))
    once = found.where(F.col("copies") <= block).select("_id", "n_words", "spans", "copies")
    often = found.where(F.col("copies") > block).withColumn("_block", F.explode(blocks)).repartition("_id", "_text", "_block")
    rest = F.least(F.lit(block).cast("long"), F.col("copies") - F.col("_block") * block)
    every = once.unionByName(often.select("_id", "n_words", "spans", rest.alias("copies"))).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select(F.col("_id").alias(id_col), "n_words", "spans")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op9_licences": op9_licences}
