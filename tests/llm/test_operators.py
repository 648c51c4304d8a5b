"""Each operator against a brute-force version, over a corpus with every awkward case, and over nothing."""

from __future__ import annotations

import binascii
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import bpe, decontaminate, gru, html, langid, language_model, licences, near_duplicates, quality, sharding, similar_vectors

WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text, pattern=WORD):
    return pattern.findall((text or "").translate(FOLD))


def shingles(text, pattern=WORD):
    w = tokens(text, pattern)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({("=", *w)} if w else set())


def smallest(n, links):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1


def test_containment_equals_brute_force(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    some = next(t for d, t in rows if d == 9).split()
    long = next(t for d, t in rows if d == 109).split()
    items = [(1, " ".join(some[3:15])), (2, " ".join(long[20_000:20_300])), (3, " ".join(some[:10] + ["strange"] + some[11:30])), (4, "one two"), (5, None), (6, ""), (7, "nowhere at all does this stand in any text"), (1, " ".join(some[3:15]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for d, t in rows:
        for i, s in items:
            own = shingles(s, ALNUM)
            if own and 10 * len(own & shingles(t, ALNUM)) >= 8 * len(own):
                expected[d, i, len(own)] += 1
    for size in (1 << 20, 40):  # one block of items, and several
        found = decontaminate.find_contained(awkward, table, block_bytes=size)
        assert Counter((r["doc_id"], r["item_id"], r["n_shingles"]) for r in found.collect()) == expected
    hit = {d for d, *_ in expected}
    kept = decontaminate.keep_uncontaminated(awkward, table)
    assert kept.columns == awkward.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(d) for d, _ in rows if d not in hit)
    assert decontaminate.find_contained(nothing, table).count() == 0
    assert decontaminate.find_contained(awkward, table.limit(0)).count() == 0
    assert decontaminate.keep_uncontaminated(awkward, table.limit(0)).count() == len(rows)


def test_items_with_ids_of_any_type_and_many_copies(spark):
    text = "this passage of the benchmark has exactly ten words here"
    docs = spark.createDataFrame([("d1", f"before {text} after"), (None, text), ("d3", "nothing of it")], "name string, body string")
    items = spark.createDataFrame([(f"i{k}", text, k) for k in range(300)] + [(None, text, 0), ("z", None, 0)], "name string, text string, n_shared int")
    got = decontaminate.find_contained(docs, items.withColumnRenamed("name", "item"), doc_id="name", doc_text="body", item_id="item")
    rows = got.collect()
    assert Counter(r["name"] for r in rows) == {"d1": 301, None: 301} and len({r["item"] for r in rows}) == 301
    (shipped,) = decontaminate.shipped_blocks(items, "text", 1 << 20)
    assert len(shipped.value.ids) == 2  # each text once


def test_containment_is_found_in_random_places():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 62, 5000, dtype=np.uint64)
    for n in (1, 3, 8, 100):
        index = decontaminate.Index([0], [np.unique(s[1000 : 1000 + n])], {max(int(np.ceil(np.log2(n))), 2): (np.array([0]), decontaminate.minima(s[1000 : 1000 + n])[None])}, s, None)
        assert decontaminate.candidates(index, s, np.arange(1000, 1000 + n)) == {0}


# 2


def test_shards_are_even_gapless_and_the_same_in_any_partitioning(awkward, nothing):
    rows = awkward.collect()
    found = sharding.feistel_shards(awkward, 7).collect()
    assert len(found) == len(rows)
    by = Counter(r["shard"] for r in found)
    assert max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(7))
    for k in by:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(by[k]))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, binascii.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    other = sharding.feistel_shards(awkward.repartition(7).orderBy(F.desc("n")), 7).collect()
    assert sorted(map(repr, other)) == sorted(map(repr, found))
    assert [r["place"] for r in sorted(found, key=lambda r: r["row_no"])] != list(range(len(rows)))
    assert sharding.feistel_shards(nothing).count() == 0


def test_permutation_of_any_size(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        first, walked = sharding.permute(F.col("id"), F.lit(n).cast("long"), 5)
        places = spark.range(n).withColumn("_first", first).select(walked.alias("p")).collect()
        assert sorted(r["p"] for r in places) == list(range(n))


def test_a_row_repeated_very_often_gets_all_its_slots(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.feistel_shards(df, 3).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted((p % 3, p // 3) for p in range(5000))


# 3

FRAME = "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><header class=top><nav><a href=#>Home</a></nav></header>{}<div class=box><p>Read our other stories of the week</p></div><footer>Imprint</footer></body></html>"


def test_template_is_removed_and_the_article_stays(spark):
    pages = [(i, f"https://News.example/{i}", FRAME.format(f"<main><article><h1>Title {i}</h1><p>Body &amp; soul  of\n page {i}<br>goes on</p><ul><li>one {i}<li>two</ul><!-- no --></article></main>"), "x") for i in range(8)]
    pages += [(90, None, None, "x"), (91, "nonsense", "", "x"), (92, "http://a/b", "just text &lt; here", "x"), (93, "http://a/b", "<div><p>open <b>bold<p>next</div></section>" + "<i>" * 3000, "x"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, _page string")
    got = html.main_text(df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    for i in range(8):
        assert by[i]["text"] == f"Title {i}\n\nBody & soul of page {i} goes on\n\none {i}\n\ntwo" and by[i]["n_chars"] == len(by[i]["text"])
    assert by[90]["text"] == by[91]["text"] == "" and by[92]["text"] == "just text < here" and by[93]["text"] == "open bold\n\nnext" and by[90]["_page"] == "x"
    assert html.main_text(df.limit(0)).count() == 0


def test_a_repeated_subtree_goes_only_where_it_recurs(spark):
    body = "<div><div><p>Stay with us</p></div><p>text number {} and more of it to be long enough here</p></div>"
    pages = [(i, "http://many/x", body.format(i)) for i in range(9)] + [(20, "http://few/x", body.format(20))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert "Stay" not in got[3] and "Stay with us" in got[20] and "text number 3" in got[3]


def brute_force_texts(pages):
    """main_text in plain Python: templates by counting the distinct pages of each host."""
    host = lambda url: (re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "") or [None, ""])[1].lower()
    distinct = {(host(url), source or "") for _, url, source in pages}
    n_pages = Counter(h for h, _ in distinct)
    seen = Counter()
    for h, source in distinct:
        page = html.Page(source)
        seen.update((h, t) for t in {page.subtree_hash(i) for i in page.counted(html.MOST_OF_PAGE)})
    gone = {}
    for (h, t), n in seen.items():
        if n >= html.MIN_PAGES and n >= html.MIN_SHARE * n_pages[h]:
            gone.setdefault(h, set()).add(t)
    return Counter((k, html.Page(source or "").text(gone.get(host(url), set()))) for k, url, source in pages)


def test_extraction_equals_brute_force_whatever_the_copies(spark):
    frame = '<body><div class="x7"><ul><li>Home page</li><li>About us</li></ul></div>{}<div class="x8">All the best from here</div></body>'
    pages, k = [], 0
    for copies in (1, 6, 500):
        body = f"<article><h1>Page in {copies}</h1><p>Prose of it.</p><ul><li>first of {copies}</li></ul><table><tr><td>cell</table></article>"
        for _ in range(copies):
            pages.append((k, f"http://h.org/{copies}", frame.format(body)))
            k += 1
    for i in range(40):
        pages.append((1000 + i, "http://H.org/z", frame.format(f"<p>Paragraph {i} of a page of its own.</p>" + ("<dl><dt>same</dl>" if i < 20 else ""))))
    pages += [(2000, None, None), (2001, "x", "<p>no host</p>"), (2002, "http://h.org/", "<div><ul><li>Home page</li><li>About us</li></ul></div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = Counter((r["page_id"], r["text"]) for r in html.main_text(df).collect())
    assert got == brute_force_texts(pages)
    by = dict(got.keys())
    assert by[3] == "Page in 6\n\nProse of it.\n\nfirst of 6\n\ncell" and by[1005] == "Paragraph 5 of a page of its own."
    assert by[2002] == ""  # only template stands there


def test_no_rule_drops_what_holds_the_article():
    text = lambda source: html.Page(source).text()
    assert text('<div class="layout has-sidebar"><article><p>A b</p></article><div class=sidebar>no</div></div>') == "A b"
    assert text('<div class="content no-comments"><p>Hello</p></div>') == "Hello"
    assert text('<div class="page-sidebar-left"><p>Most of the prose</p><p>of this page</p></div><div class=sidebar><p>no</p></div>') == "Most of the prose\n\nof this page"
    assert text('<form id=f><div style="display:none"><article>kept</article></div><input></form>') == "kept"
    assert text('<article class="post comments-open">kept</article><div id="post-comments"><article>a reader wrote this, at length</article></div>') == "kept"
    assert text("<p class=it's>Hello</p><p>That's all</p><p>third</p>") == "Hello\n\nThat's all\n\nthird"
    assert text('<p title="a>b" data-x=1>one</p><!--> <p>two</p><!-- x --!><p>three') == "one\n\ntwo\n\nthree"
    assert text("<main><p>lead</p><article>one</article><article>two two</article></main><article>three</article>") == "lead\n\none\n\ntwo two\n\nthree"
    assert text("<noscript>turn on scripts</noscript><article>E is <math><mi>m</mi><mi>c</mi></math><noscript> seen</noscript></article>") == "E is mc seen"
    assert text("<nav>a</nav><footer>b</footer><aside>c</aside><form>d</form>") == ""
    assert text('<article><h2 id="search">Search</h2><section id="comments">about ids</section></article>') == "Search\n\nabout ids"


def test_deep_and_broken_pages_take_linear_time():
    import time

    start = time.monotonic()
    for source in ("<i>" * 100_000 + "deep", "<div><p>" * 30_000 + "deep" + "</b>" * 100_000, "<a " * 100_000, "<p b='" * 100_000, "<" * 100_000 + "deep"):
        html.Page(source).text()
    assert time.monotonic() - start < 20


# 4


def test_copies_of_a_page_do_not_make_its_article_template(spark):
    frame = '<html><body><div class="w"><ul><li>Home page</li><li>About us</li></ul></div>{}</body></html>'
    article = "<article><h1>One page</h1><p>A long paragraph that holds most of the text of this page, and then some more of it.</p><ul><li>first</li><li>second</li></ul><table><tr><td>cell</td></tr></table></article>"
    copies = [(i, "http://h.org/x", frame.format(article)) for i in range(10)]
    others = [(10 + i, f"http://h.org/{i}", frame.format(f"<p>Paragraph {i} of a page whose words differ from those of the others {i * 7}.</p>")) for i in range(6)]
    schema = "page_id long, url string, html string"
    alone = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(copies, schema)).collect()}
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(copies + others, schema).repartition(3)).collect()}
    assert len(alone) == 10 and len(got) == 16
    assert set(alone.values()) == {got[i] for i in range(10)}
    assert len(set(alone.values())) == 1 and all(w in alone[0] for w in ("One page", "long paragraph", "first", "second", "cell"))
    assert all("Home" not in got[i] and f"Paragraph {i - 10}" in got[i] for i in range(10, 16))  # the frame still goes


def test_languages_are_told_and_texts_without_letters_are_not(spark, awkward, nothing):
    found = {r["doc_id"]: r for r in langid.learn_and_identify(awkward).collect()}
    for i in range(60):
        assert found[i]["lang_pred"] == ("en", "fr", "de")[i % 3]
        assert 0 <= found[i]["score"] <= 1 and found[i]["held_out"] == (binascii.crc32(str(i).encode()) % 5 == 0)
    assert all(found[d]["lang_pred"] == "und" and found[d]["score"] == 0 for d in (103, 104, 105, 108))
    assert found[111]["lang_pred"] != "und"
    assert langid.learn_and_identify(awkward).count() == awkward.count()
    assert langid.learn_and_identify(nothing).count() == 0
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and {103, 104, 105, 108} & {r["doc_id"] for r in kept.collect()} == set()
    assert {r["lang_pred"] for r in langid.identify(awkward, None).collect()} == {"und"}


def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_codewords_are_far_apart():
    for n in (1, 2, 4, 6, 9, 30):
        code = langid.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len(code) == n and min(apart, default=1) >= 1 and (n < 9 or min(apart) >= 5)


# 5


@pytest.mark.parametrize("block, cell", [(16, 2048), (8192, 8), (16, 64)])
def test_vector_links_equal_brute_force(spark, monkeypatch, block, cell):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 24))
    x[100:130] = x[7] + rng.normal(size=(30, 24)) * 0.12
    x[130:135] = x[8] * np.arange(1, 6)[:, None]  # the same direction
    x[140:145] = x[9]
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(200, None, 1), (201, [0.0] * 24, 1), (202, [math.nan] * 24, 1), (203, [1.0] * 23 + [None], 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [math.inf] * 24, 1), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node long").repartition(3)
    monkeypatch.setattr(similar_vectors, "BLOCK", block)
    monkeypatch.setattr(similar_vectors, "CELL", cell)
    monkeypatch.setattr(similar_vectors, "LOST", 1e-5)  # so that no pair is lost with these cells either
    got = similar_vectors.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    usable = [(i, np.array(v, float)) for i, v, _ in rows + odd if v and len(v) in (24, 2) and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) else -1.0
    links = [(a, b) for a in range(len(usable)) for b in range(a) if cos(usable[a][1], usable[b][1]) >= 0.95]
    n = Counter(k for pair in links for k in pair)
    label = smallest(len(usable), links)
    least = {}
    for k, root in enumerate(label):
        least[root] = min(least.get(root, 10**9), usable[k][0])
    want = Counter((usable[k][0], n[k], least[label[k]]) for k in range(len(usable)))
    want.update((i, 0, i) for i in (200, 201, 202, 203, 204, 207))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert similar_vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def pairs_at(cosine, n, dim, rng):
    a = similar_vectors.unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=(n, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    return a, similar_vectors.unit(cosine * a + math.sqrt(1 - cosine**2) * similar_vectors.unit(side))


def test_collision_counts_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    n, lost, wide = 4000, 0, 0
    for dim in (4, 64, 300):
        a, b = (similar_vectors.codes(x, 0.95) for x in pairs_at(0.9501, n, dim, rng))
        order = np.argsort(b[1][:, 0], kind="stable")
        by = np.argsort(a[1][:, 0], kind="stable")
        i, j = similar_vectors.candidates((a[0][by], a[1][by]), (b[0][order], b[1][order]), 0.95, False)
        i, j = by[i], order[j]
        lost += n - len(set(i[i == j]))
        wide += len(i) if dim > 4 else 0
    assert lost <= 3 * n * 4 * similar_vectors.MISS + 3
    assert wide < 3 * n  # most of what is counted is near indeed


def test_cells_keep_the_recall_they_are_calibrated_for():
    rng = np.random.default_rng(6)
    for n in (50_000, 1_000_000, 100_000_000):
        masks = similar_vectors.tables(n, 0.95)
        a, b = (similar_vectors.codes(x, 0.95)[0] for x in pairs_at(0.95, 20_000, 64, rng))
        first = np.zeros(20_000, int)
        for t in range(len(masks)):
            first += similar_vectors.first_shared(a ^ b, t, masks)
        assert first.max() == 1  # each pair counts once
        assert (first == 0).mean() < 3 * similar_vectors.LOST
    assert similar_vectors.tables(similar_vectors.CELL, 0.95).tolist() == [[0, 0]]
    # Work for each vector: half a cell in each table. It grows far slower than the number of vectors.
    work = [len(similar_vectors.tables(n, 0.95)) for n in (1 << 16, 1 << 26)]
    assert work[1] < 10 * work[0]  # for 1024 times the vectors


def test_recall_over_cells_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = pairs_at(0.952, 1500, 64, rng)
    x = np.concatenate([a, b])
    links = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    monkeypatch.setattr(similar_vectors, "CELL", 32)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = similar_vectors.near_duplicate_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.995 * 2 * len(links) <= got <= 2 * len(links)


# 6


def test_quality_scores_every_row_and_learns(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(awkward, labels)
    got = quality.score(awkward, net)
    assert got.count() == awkward.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert np.mean([by[i] for i in range(0, 60, 3)]) > 0.5 + np.mean([by[i] for i in range(60) if i % 3])
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    assert quality.keep_good(nothing, labels).count() == 0
    none = quality.fit(awkward, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(awkward, none).collect()} == {0.5}


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.fold("doc_id", 5) == 0)
    assert got.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.95


def test_one_text_of_each_labelled_id_reaches_the_driver(spark, awkward):
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(3, f"text number {i} of one id") for i in range(1000)] + [(6, "again")] * 500, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (quality.fit(d, labels) for d in (docs, docs.repartition(6).orderBy(F.desc("text"))))
    assert np.allclose(a.layers[0], b.layers[0], atol=1e-6) and a.temperature == b.temperature


# Long texts: in pieces, as if they were whole


def test_pieces_of_a_long_text_give_what_the_whole_text_gives(monkeypatch):
    import pyarrow as pa

    from lodeworks.llm import text as T

    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 9))) for _ in range(3000)) + " " + "x" * 5000 + " end"
    column = pa.array(["short one", long, None, "", long[:700]])
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    code = langid.codewords(3)
    model = langid.Model(["a", "b", "c"], code, np.vstack([rng.normal(size=(langid.BUCKETS, code.shape[1])), np.zeros((1, code.shape[1]))]).astype(np.float32), np.ones(code.shape[1]))

    def all_of(size):
        monkeypatch.setattr(T, "CHUNK_BYTES", size)
        out = []
        for chunk in T.chunks(column, size):
            w = T.words(chunk)
            out.append((T.shingles(w)[0], w.hash, quality.tokens(chunk)[0], quality.pooled(chunk, vectors).ravel(), model.margins(chunk)[0].ravel()))
        return [np.concatenate(x) for x in zip(*out)]

    whole = all_of(1 << 20)
    monkeypatch.setattr(quality, "POOL_WORDS", 97)
    for size in (64, 1000):
        for a, b in zip(whole, all_of(size)):
            assert a.dtype.kind in "iu" and (a == b).all() or np.allclose(a, b, rtol=1e-5, atol=1e-5)


def test_texts_of_20_megabytes_stay_within_300_megabytes_a_task():
    """Each operator's own work on one such text, in a process of its own: what it adds to the memory held before."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from lodeworks.llm import bpe, decontaminate, langid, licences, near_duplicates, quality, text as T
rng = np.random.default_rng(0)
some = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
text = " ".join(some[i] for i in rng.integers(0, 5000, 3_000_000))
column = pa.array([text])
vectors = np.zeros((quality.BUCKETS, quality.DIMS), np.float32)
bits = langid.codewords(4)
model = langid.Model(list("abcd"), bits, np.zeros((langid.BUCKETS + 1, bits.shape[1]), np.float32), np.ones(bits.shape[1]))
index = decontaminate.build_index([1], [" ".join(some[:300])])
codec = bpe._codec(bpe.tokenizer_spec())
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
what = sys.argv[1]
for chunk in T.chunks(column, quality.POOL_BYTES):
    if what == "quality": quality.pooled(chunk, vectors)
    if what == "langid": model.margins(chunk)
    if what == "near": near_duplicates.signatures(chunk, 5)
    if what == "licences": licences.gram_hashes(T.words(chunk, T.ALNUM).hash, 3)
if what == "decontaminate": list(decontaminate.matches(index, column, 0.8))
if what == "bpe": list(bpe.encoded(codec, column, ("n_tokens", "ids_sha256", "decoded_sha256")))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for what in ("quality", "langid", "near", "licences", "decontaminate", "bpe"):
        done = subprocess.run([sys.executable, "-c", code, what], capture_output=True, text=True, check=True)
        assert int(done.stdout) < 300, (what, done.stdout)


# 7


def links_of(rows, num=85, den=100):
    sets = [shingles(t) for _, t in rows]
    return sets, [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


def test_near_duplicates_equal_brute_force(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    sets, links = links_of(rows)
    label = smallest(len(rows), links)
    ids = {}
    for k, root in enumerate(label):
        ids.setdefault(root, []).append(rows[k][0])
    least = {root: min((i for i in v if i is not None), default=None) for root, v in ids.items()}
    want = Counter((rows[k][0], len(sets[k]), least[label[k]]) for k in range(len(rows)))
    got = near_duplicates.near_duplicate_components(awkward).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert near_duplicates.near_duplicate_components(nothing).count() == 0


def test_one_of_each_group_stays(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    kept = near_duplicates.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    have = Counter(r["doc_id"] for r in kept.collect())
    assert have[0] == 1 and not {100, 101, 110} & set(have) and have[5] == 1 and have[None] == 1 and have[106] == 1 and 107 not in have
    assert all(have[d] == 1 for d in (103, 104, 105)) and len(rows) > sum(have.values())
    assert near_duplicates.keep_one_of_each(nothing).count() == 0


def test_a_row_is_dropped_for_its_own_text_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (None, c, "x"), (None, c, "y"), (None, c, "y"), (9, None, "x"), (9, None, "x"), (3, b, "x"), (3, b, "x"), (2, a + " tail", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    kept = near_duplicates.keep_one_of_each(df)
    got = Counter(tuple(r) for r in kept.collect())
    assert kept.columns == df.columns and got[None, c, "x"] + got[None, c, "y"] == 1
    got.pop((None, c, "x"), None), got.pop((None, c, "y"), None)
    assert got == Counter({(1, a, "x"): 1, (3, b, "x"): 1, (9, None, "x"): 2})
    again = Counter(tuple(r) for r in near_duplicates.keep_one_of_each(df.repartition(1)).collect())
    assert again == Counter(tuple(r) for r in kept.collect())


def test_a_task_sends_the_set_of_repeated_rows_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(7, text)] * 500 + [(None, text + " x")] * 500 + [(8, text + " x")], "doc_id long, text string").repartition(4)
    nodes = near_duplicates._linked(df, 85, 100, 5, "doc_id", "text").where("_id is null or _id = 7").groupBy("node").agg(F.min("_id").alias("_id"))
    assert near_duplicates._sets(df, nodes, "doc_id", "text", 5, True).count() == 2
    got = near_duplicates.near_duplicate_components(df).collect()
    assert len(got) == 1001 and {r["component_id"] for r in got} == {7}


def test_lists_of_several_components_are_compared_in_tiles(spark, monkeypatch):
    # Groups of near copies share a passage, so that their nodes meet in lists; every other word differs between groups.
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for g in range(40):
        own = [f"g{g}_{i}" for i in range(40)]
        rows += [(g * 100 + k, " ".join(shared + own[:20] + [f"k{k}"] + own[21:])) for k in range(5)]
    want = Counter()
    sets, links = links_of(rows)
    label = smallest(len(rows), links)
    for (d, _), root in zip(rows, label):
        want[d, rows[root][0]] += 1
    monkeypatch.setattr(near_duplicates, "BLOCK", 64)
    monkeypatch.setattr(near_duplicates, "TILE", 8)
    got = near_duplicates.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_a_large_group_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:150] + [f"x{i}"] + base[151:])) for i in range(300)] + [(1000 + i, " ".join(f"y{i}_{j}" for j in range(30))) for i in range(50)]
    got = near_duplicates.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 1000} == {0} and all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] >= 1000)


# 8


def test_language_model_base_scores_and_counts_are_exact(awkward, nothing):
    held_out = F.col("doc_id") % 7 == 2
    train = awkward.where(~F.coalesce(held_out, F.lit(False)))
    rows = awkward.collect()
    c = Counter()
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] % 7 != 2:
            c.update([*tokens(r["text"]), "<end>"])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for r in rows for w in [[*tokens(r["text"]), "<end>"]])
    got = language_model.language_model_scores(awkward, train).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.language_model_scores(nothing, nothing).count() == 0
    untrained = language_model.language_model_scores(awkward, nothing).collect()
    assert {r["base_score"] for r in untrained} == {0.0} and {r["n_known"] for r in untrained} == {0}


def test_frequent_words_are_looked_up_and_rare_ones_joined_alike(awkward, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r for r in language_model.language_model_scores(awkward, awkward).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 64)
    monkeypatch.setattr(language_model, "N_WORDS", 64)
    for r in language_model.language_model_scores(awkward, awkward).collect():
        one = whole[r["doc_id"], r["n_tokens"]]
        assert abs(r["base_score"] - one["base_score"]) < 1e-6 and r["n_known"] == one["n_known"]


def test_recurrent_model_beats_unigrams_on_held_out_texts(spark, sf):
    got = language_model.op8_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.95  # at least 5 % better


def test_language_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).union(spark.createDataFrame([(-1, "one text in many rows", "en", "s", 1)] * 50, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    monkeypatch.setattr(language_model, "WORKER_TOKENS", 1000)  # so that there are several workers
    found = []
    for parts, batch in ((1, 10_000), (4, 7), (40, 10_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        d = docs.repartition(parts)
        found.append({r["doc_id"]: r["score"] for r in language_model.language_model_scores(d, d).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in found[1:]:
        assert max(abs(other[k] - v) / abs(v) for k, v in found[0].items()) < 1e-6


def test_gru_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = gru.Gru.start(rng.integers(1, 9, 130).astype(float), 5, 3)
    net.theta[:] = rng.normal(0, 0.3, net.size)
    net.p["wo"][-1, gru.HIDDEN, 2:] = -1e4
    net = gru.Gru(130, net.theta.astype(np.float64))
    x, y = rng.integers(0, 132, (6, 5)), rng.integers(0, 132, (6, 5))
    fresh = rng.random((6, 5)) < 0.3
    fresh[0] = True
    weight = np.ones(30)

    def loss(theta):
        n = gru.Gru(130, theta)
        s, _, _ = n.run(np.zeros((5, gru.HIDDEN)), n.gates(), x, fresh, False)
        return -n.log_p(s.reshape(-1, gru.HIDDEN + 1), y.ravel())[0].sum()

    g = np.zeros(net.size)
    grad = net.views(g)
    s, _, kept = net.run(np.zeros((5, gru.HIDDEN)), net.gates(), x, fresh, True)
    _, d = net.log_p(s.reshape(-1, gru.HIDDEN + 1), y.ravel(), grad, weight)
    net.back(kept, x, fresh, d.reshape(*x.shape, gru.HIDDEN), grad)
    at = {name: np.flatnonzero(net.views(np.arange(net.size))[name].ravel() + 1)[:1] for name in net.shapes}
    places = [int(net.views(np.arange(net.size))[name].ravel()[k]) for name in at for k in rng.integers(0, np.prod(net.shapes[name]), 4)]
    for k in places:
        step = np.zeros(net.size)
        step[k] = 1e-5
        rough = (loss(net.theta + step) - loss(net.theta - step)) / 2e-5
        assert abs(rough - g[k]) < 1e-5 * max(1, abs(rough)), (k, rough, g[k])


def test_probabilities_of_the_recurrent_model_sum_to_one():
    net = gru.Gru.start(np.arange(1, 131, dtype=float), 7, 3)
    h = np.append(np.random.default_rng(1).normal(size=gru.HIDDEN), 1)[None].astype(np.float32)
    total = sum(math.exp(net.log_p(h, np.array([w]))[0][0]) for w in range(132))
    assert abs(total - 1) < 1e-4


def test_scores_do_not_depend_on_the_company_of_a_text():
    rng = np.random.default_rng(2)
    net = gru.Gru.start(np.ones(100), 7, 3)
    net.p["embed"][:] = rng.normal(size=net.shapes["embed"])
    net.p["wo"][:] = rng.normal(size=net.shapes["wo"])
    lengths = rng.integers(1, 200, 40)
    first = np.r_[0, np.cumsum(lengths)]
    ids = rng.integers(0, 102, first[-1])
    whole = gru.log_likelihoods(net, ids, first)
    alone = [gru.log_likelihoods(net, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(whole, alone, rtol=1e-5)


# 9


def test_licence_phrases_equal_brute_force_and_notices_are_found(spark, awkward, nothing):
    rows = [(1, "All Rights Reserved. all rights\nreserved"), (2, "under the GNU General-Public license or CC-BY cc by cc by"), (3, "cc by cc"), (4, None), (5, ""), (6, "all rights are reserved"), (7, "x " * 5000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files"), (1, "All Rights Reserved. all rights\nreserved"), (None, "all rights reserved")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, template int, _pairs string").unionByName(awkward.select("doc_id", "text", F.lit(1).alias("template"), F.lit("c").alias("_pairs")))
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

    def brute(text):
        w = tokens(text, ALNUM)
        return len(w), sorted((i, name) for name, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())

    want = Counter((r["doc_id"], repr(brute(r["text"]))) for r in df.select("doc_id", "text").collect())
    found = licences.find_licences(df).collect()
    assert Counter((r["doc_id"], repr((r["n_words"], sorted((s["start"], s["label"]) for s in r["spans"] if s["phrase"])))) for r in found) == want
    (seven,) = [r["spans"] for r in found if r["doc_id"] == 7 and r["n_words"] > 5000]
    assert [(s["label"], s["start"], s["end"]) for s in seven] == [("mit", 5000, 5021)]
    assert licences.find_licences(nothing).count() == 0


def test_whole_licences_are_found_and_spans_verified_on_words(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{i}" for i in rng.integers(0, 400, 3000))  # a license of 3,000 words, many of them repeated
    templates = (*licences.TEMPLATES, licences.Template("long", long))
    w = long.split()
    edited = w[:500] + ["put", "in"] + w[500:1500] + w[1504:2500] + ["other"] + w[2501:]
    mit = max((t.text for t in licences.NOTICES if t.label == "mit"), key=len)
    scrambled = " ".join(x for i in range(0, 3000, 3) for x in w[i : i + 3][::-1])
    jumbled = " ".join(" ".join(w[i : i + 10]) for i in rng.permutation(np.arange(0, 3000, 10)))
    rows = [(1, "x y z " + " ".join(edited) + " z"), (2, "a " * 100 + mit.upper() + " b"), (3, scrambled), (4, jumbled), (5, long + " " + long), (6, "licensed under the other license version 2 0 of it")] + [(7, "all rights reserved")] * 9000
    found = licences.find_licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), templates).collect()
    by = {r["doc_id"]: [(s["label"], s["start"], s["end"]) for s in r["spans"]] for r in found}
    cover = {r["doc_id"]: max((s["cover"] for s in r["spans"]), default=0) for r in found}
    assert len(found) == len(rows)
    assert by[1] == [("long", 3, 3 + len(edited))] and cover[1] > 0.99
    assert ("mit", 100, 100 + len(tokens(mit, ALNUM))) in by[2]
    assert by[3] == by[4] == by[6] == []  # the same words, or most of them, but not in order
    assert by[5] == [("long", 0, 3000), ("long", 3000, 6000)]
    assert Counter(r["doc_id"] for r in found)[7] == 9000 and by[7] == [("reserved", 0, 3)]


def test_words_that_change_a_licence_decide(spark):
    cases = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": {"cc-by-nc"},
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": {"cc-by-nd"},
        "Licensed under CC BY-NC-SA 4.0 since 2019": {"cc-by", "cc-by-nc-sa"},
        "Licensed under CC BY-NC 4.0": {"cc-by", "cc-by-nc"},
        "Licensed under CC BY 4.0": {"cc-by"},
        "This work is licensed under the GNU General Public License, version 3": {"gpl"},
        "This work is licensed under the GNU Lesser General Public License, version 3": {"gpl", "lgpl"},
        "This work is not licensed under the GNU Affero General Public License, version 3": {"gpl"},
        "This software is not released under the MIT License": set(),
        "It was released under the MIT License": {"mit"},
        "Released, as far as we know and were told, under the well known MIT License": set(),
    }
    phrases = {p.label: p.text.split() for p in licences.PHRASES}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in licences.find_licences(df).collect():
        text, wanted = list(cases.items())[r["doc_id"]]
        assert {s["label"] for s in r["spans"]} == wanted, text
        method, w = {s["label"] for s in r["spans"] if not s["phrase"]}, tokens(text, ALNUM)
        base = {k for k, p in phrases.items() if any(w[i : i + len(p)] == p for i in range(len(w)))}
        assert {s["label"] for s in r["spans"] if s["phrase"]} == base and method >= wanted - base, text
        assert not method & ({"gpl"} if {"lgpl", "agpl"} & wanted or " not " in text else set())


def test_licence_query_equals_brute_force(spark, sf):
    from lodeworks.llm import registry

    text = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_licences"](spark, sf).collect()}
    for d, t in text:
        w = tokens(t, ALNUM)
        spans = [(i, x.label) for x in licences.PHRASES for i in range(len(w)) if w[i : i + len(x.text.split())] == x.text.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(spans), ",".join(sorted({x for _, x in spans})))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in spans), default=None), max((i for i, _ in spans), default=None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


# 10


def test_bpe_equals_the_library_and_decodes_back(spark, awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    extra = [(900 + i, t) for i, t in enumerate(["<|endoftext|> a<|endoftext|>b", "don't I'LL we've", "tabs\t\tand\n\n new  lines   x", "emoji 🙂🙂 and ñandú É 中文 ½ ²", "a" * 3000, "\x00\x01\x7f", "é ​ ﻿", " ", "\n"])]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    fields = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    found = bpe.bpe_encode_decode(docs, bpe.tokenizer_spec(), fields).collect()
    texts = [r["text"] for r in docs.collect()]
    assert len(found) == len(texts)
    want = Counter()
    for t in texts:
        e = own.encode(t or "", add_special_tokens=False).ids
        d = own.decode(e, skip_special_tokens=False)
        want[hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest(), len(e)] += 1
    assert Counter((r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in found) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in found)
    assert Counter(r["decoded"] for r in found) == Counter(t or "" for t in texts)
    assert bpe.bpe_encode_decode(nothing, bpe.tokenizer_spec()).count() == 0


def test_every_character_is_split_like_the_library_splits_it():
    from tokenizers import pre_tokenizers

    library, codec, to_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), bpe._codec(bpe.tokenizer_spec()), bpe.byte_of_symbol()
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for lo in range(0, len(points), 2000):
        text = "".join(f"a{c}'s 1{c}2 !{c}? {c} {c}x" for c in map(chr, points[lo : lo + 2000]))
        wanted = ["".join(w) for w, _ in library.pre_tokenize_str(text)]
        assert [bytes(map(to_byte.__getitem__, w)).decode() for w in wanted] == codec.split_words(text), hex(points[lo])


def test_blocks_of_a_long_text_encode_like_the_whole(monkeypatch):
    import pyarrow as pa

    codec = bpe._codec(bpe.tokenizer_spec())
    texts = pa.array([" some   words, ñandú é\n\n<|endoftext|> and 12 more's " * 50, "日本語 text " * 40, "", None])
    fields = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    whole = list(bpe.encoded(codec, texts, fields))
    monkeypatch.setattr(bpe, "LONG_TEXT", 0)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    for a, b in zip(whole, bpe.encoded(codec, texts, fields)):
        assert list(a[1]) == list(b[1]) and a[0] == b[0] and a[2:] == b[2:]


def test_both_ways_of_merging_agree_and_memory_is_bounded_in_bytes(monkeypatch):
    codec = bpe._codec(bpe.tokenizer_spec())
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 30, 400):
        for _ in range(20):
            b = bytes(rng.choice(np.frombuffer(b"abehinorst ", np.uint8), n))
            ids = [codec.of_byte[x] for x in b]
            assert codec._merged(list(ids)) == codec._merged_by_heap(list(ids))
    held = bpe._Remembered(lambda k: k, 10_000)
    for i in range(2000):
        assert held[f"word {i}"] == f"word {i}"
    held["x" * 5000]
    assert sum(bpe.ENTRY + 2 * len(k) for k in held) <= 10_000 and len(held.before) <= 50 and "x" * 5000 not in held
