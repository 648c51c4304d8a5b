"""Main text of web pages by site template removal.

Every element that can be a piece of a site's frame is hashed with all that stands in it. Spark counts on how many
distinct pages of a host each subtree stands; those on many pages are the host's template and are deleted from each of its
pages. That is the main step. Beside it goes what HTML itself marks as no article (navigation, footers, asides, forms ...), and,
as a supplement for hosts with few pages, what its class or id names so. The rest of the articles is returned block by block.

No rule may drop an element in which the page's lead article stands, whatever its tag, class or style. The lead is the
longest ``article`` or ``main`` outside such elements. All articles count, and all that ``main`` holds beside them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import written

MIN_PAGES = 5
MIN_SHARE = 0.02
MOST_OF_PAGE = 0.9

# Quotes open a value only behind an equals sign, as in HTML. All quantifiers are possessive: one pass, no going back.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>script|style|textarea|title|iframe|template|svg|xmp|noembed|noframes)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no part of an article. ``header`` and ``noscript`` are content inside an article, and none elsewhere.
NEVER = frozenset("aside button canvas datalist dialog footer form head menu nav object optgroup option output progress select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark an element as none of the article.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signup skip skiplink social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: What readers wrote, even where most of a page's prose stands in it.
READERS = frozenset("comment comments disqus replies reply respond".split())
#: A name with one of these says what its element has or lacks, not what it is: has-sidebar, no-comments.
OTHERWISE = frozenset("closed count disabled enabled has have is no non not off on open show with without".split())
#: Elements that are counted per host. Paragraphs and the like are prose: the same line in many articles stays.
COUNTED = frozenset("address aside center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK - {"body", "html", "head"}
_SCOPES = frozenset("article aside body dd details div dialog fieldset figure footer form header li main nav ol section table td th ul".split())
_MOD = (1 << 61) - 1
#: How sure a rule is that an element is no part of an article.
STAYS, LIKELY, SURELY, BY_READERS = range(4)


def named_otherwise(value: str) -> int:
    """What a class or id tells: SURELY for a name that is a mark, LIKELY for one that has a mark among its words."""
    found = STAYS
    for name in value.split():
        lower = name.lower()
        words = [lower] if lower in MARKS else [w.lower() for w in _WORD.findall(name)]
        if MARKS.isdisjoint(words) or not OTHERWISE.isdisjoint(words):
            continue
        found = max(found, BY_READERS if words[0] in READERS or words[-1] in READERS else SURELY if lower in MARKS else LIKELY)
    return found


class Element:
    __slots__ = ("tag", "start", "end", "parent", "doubt", "article", "holds", "first", "last")

    def __init__(self, tag: str, start: int, parent: int, doubt: int, article: bool):
        self.tag, self.start, self.end, self.parent, self.doubt, self.article = tag, start, start, parent, doubt, article
        self.holds = False  # an article, or the main part, stands in it
        self.first = self.last = 0


class Page:
    """Elements, and the pieces of text between tags, each with its element. Wrong or missing end tags are borne; time
    grows with the length of the source, however deep elements are nested."""

    def __init__(self, source: str):
        self.elements: list[Element] = [Element("#root", 0, -1, STAYS, False)]
        self.pieces: list[tuple[int, int, bool]] = []  # element, index of text, a block begins before it
        self.texts: list[str] = []
        self.sizes, self.prose = [0], [0]  # characters of text, and of text in paragraphs, so far
        sums = [0]  # rolling hash of the tokens so far
        stack = [0]
        open_at: dict[str, list[int]] = {}  # depths of the open elements of a tag
        scopes = [0]  # depths of open elements that end tags of others don't reach through
        at, fresh_block, in_article = 0, True, 0

        def put(what: str) -> None:
            sums.append((sums[-1] * 1_000_003 + hash_text(what)) % _MOD)

        def pop_to(depth: int) -> None:
            nonlocal in_article
            while len(stack) > depth:
                e = self.elements[stack.pop()]
                e.end, e.last = len(self.texts), len(sums) - 1
                in_article -= e.article
                if e.parent >= 0:
                    open_at[e.tag].pop()
                    self.elements[e.parent].holds |= e.holds or e.article
                if e.tag in _SCOPES:
                    scopes.pop()

        def add(text: str) -> None:
            nonlocal fresh_block
            self.pieces.append((stack[-1], len(self.texts), fresh_block))
            self.texts.append(text)
            self.sizes.append(self.sizes[-1] + len(text))
            self.prose.append(self.prose[-1] + (len(text) if open_at.get("p") else 0))

        def say(text: str) -> None:
            nonlocal fresh_block
            if text:
                if not text.isspace():
                    put(text.strip())
                add(text)
                fresh_block = False

        for m in _TOKEN.finditer(source):
            say(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue  # a comment, a declaration, or an element of raw text
            tag = tag.lower()
            if tag in BLOCK:
                fresh_block = True
            if m["close"]:
                depths = open_at.get(tag)
                if depths and (tag in _SCOPES or depths[-1] >= scopes[-1]):
                    pop_to(depths[-1])
                put("/" + tag)
                continue
            if tag == "br":
                add(" ")
            if tag in VOID:
                continue
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            if ends:
                # The innermost scope stops the search, unless it is itself among those that end here.
                lowest = [d[-1] for t in ends if (d := open_at.get(t)) and d[-1] >= scopes[-1]]
                while lowest:
                    pop_to(min(lowest))
                    lowest = [d[-1] for t in ends if (d := open_at.get(t)) and d[-1] >= scopes[-1]]
            doubt, role = SURELY if tag in NEVER else STAYS, ""
            attrs = m["attrs"]
            if attrs and not attrs.isspace():
                for name, a, b, c in _ATTR.findall(attrs):
                    name, value = name.lower(), a or b or c
                    if name == "class" or (name == "id" and not in_article):  # ids inside an article are mostly anchors
                        doubt = max(doubt, named_otherwise(value))
                    elif name == "role":
                        role = value.strip().lower()
                    elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDES.search(value.lower())):
                        doubt = max(doubt, SURELY)
                if role in ROLES:
                    doubt = max(doubt, SURELY)
            if tag in ("header", "noscript") and not in_article:
                doubt = max(doubt, SURELY)
            article = tag in ("article", "main") or role == "main"
            if tag in ("html", "body", "main") or role == "main" or (tag == "article" and doubt < BY_READERS):
                doubt = STAYS
            article &= doubt == STAYS
            e = Element(tag, len(self.texts), stack[-1], doubt, article)
            e.first = len(sums) - 1
            in_article += article
            open_at.setdefault(tag, []).append(len(stack))
            if tag in _SCOPES:
                scopes.append(len(stack))
            stack.append(len(self.elements))
            self.elements.append(e)
            put("<" + tag)
        say(source[at:])
        pop_to(0)
        self.sums = sums

    def size(self, e: Element) -> int:
        return self.sizes[e.end] - self.sizes[e.start]

    def subtree_hash(self, i: int) -> int:
        e = self.elements[i]
        return (self.sums[e.last] - self.sums[e.first] * pow(1_000_003, e.last - e.first, _MOD)) % _MOD

    def counted(self, most_of_page: float) -> list[int]:
        """Elements that may be a piece of a template: they hold some text, no article, and at most so much of the page's text."""
        most = most_of_page * self.sizes[-1]
        return [i for i, e in enumerate(self.elements) if e.tag in COUNTED and not e.holds and 0 < self.size(e) <= most]

    def lead(self) -> int:
        """The longest article or main part, one outside all that is surely no article first; 0 if there is none."""
        worst = [STAYS] * len(self.elements)
        best, key = 0, (False, -1)
        for i, e in enumerate(self.elements):
            worst[i] = max(e.doubt, worst[e.parent] if e.parent >= 0 else STAYS)
            if e.article and worst[i] < BY_READERS and (worst[i] == STAYS, self.size(e)) > key:
                best, key = i, (worst[i] == STAYS, self.size(e))
        return best

    def dropped(self, template: dict[int, int] | None = None) -> list[bool]:
        """Which elements go. ``template``: subtree hashes of the elements that stand in the host's template."""
        keep, i = {0}, self.lead()
        while i > 0:  # what the lead stands in stays
            keep.add(i)
            i = self.elements[i].parent
        out = [False] * len(self.elements)
        for i, e in enumerate(self.elements):
            gone = e.doubt and i not in keep
            if gone and (e.doubt == LIKELY or e.tag == "form") and 2 * (self.prose[e.end] - self.prose[e.start]) > self.prose[-1]:
                gone = False  # most of the page's paragraphs: a wrapper with an odd name
            out[i] = bool(gone) or (e.parent >= 0 and out[e.parent]) or bool(template and i in template)
        return out

    def roots(self, dropped: list[bool]) -> list[tuple[int, int]]:
        """Ranges of texts of the outermost articles and main parts; all the page if there are none."""
        out: list[tuple[int, int]] = []
        for i, e in enumerate(self.elements):
            if e.article and not dropped[i] and (not out or e.start >= out[-1][1]):
                out.append((e.start, e.end))
        return out or [(0, len(self.texts))]

    def matters(self) -> list[int]:
        """Elements of any size whose deletion as template would change the extracted text."""
        dropped = self.dropped()
        inside = [False] * len(self.texts)
        for lo, hi in self.roots(dropped):
            inside[lo:hi] = [True] * (hi - lo)
        return [i for i in self.counted(1.0) if not dropped[i] and inside[self.elements[i].start]]

    def text(self, template: set[int] | frozenset[int] = frozenset()) -> str:
        """The text without template, '' if nothing else stands on the page."""
        gone = {i: h for i in self.counted(1.0) if (h := self.subtree_hash(i)) in template} if template else None
        return self._text(self.dropped(gone))

    def _text(self, dropped: list[bool]) -> str:
        inside = [False] * len(self.texts)
        for lo, hi in self.roots(dropped):
            inside[lo:hi] = [True] * (hi - lo)
        blocks: list[list[str]] = []
        new = True
        for element, k, begins in self.pieces:
            new |= begins
            if inside[k] and not dropped[element]:
                if new:
                    blocks.append([])
                    new = False
                blocks[-1].append(self.texts[k])
        lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
        return "\n\n".join(line for line in lines if line)


def hash_text(s: str) -> int:
    """A hash that is the same in every process."""
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace"))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _subtrees(pages: DataFrame, most_of_page: float) -> DataFrame:
    """(host, subtree, page, counts, matters) of every row of pages, each subtree once a row; subtree 0 stands for the page itself.
    ``counts``: it holds no more than ``most_of_page`` of the page's text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                hosts, trees, keys, count, matter = [], [], [], [], []
                for host, key, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    page = Page(source.as_py() or "")
                    matters, counts = ({page.subtree_hash(i) for i in own} for own in (page.matters(), page.counted(most_of_page)))
                    for h in {0, *counts, *matters}:
                        hosts.append(host)
                        trees.append(h)
                        keys.append(key)
                        count.append(h == 0 or h in counts)
                        matter.append(h in matters)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.int64()), pa.array(keys, pa.int64()), pa.array(count, pa.bool_()), pa.array(matter, pa.bool_())], ["host", "subtree", "page", "counts", "matters"])

    return pages.select("_host", "_page", "_html").mapInArrow(work, "host string, subtree long, page long, counts boolean, matters boolean")


#: Into how many keys the pages of one template, and the rows of one page, are dealt for a join.
SALTS = 16


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_of_page: float = MOST_OF_PAGE) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every row; a column of these names is replaced.

    A subtree is template if it stands on at least ``min_pages`` distinct pages of its host and at least ``min_share`` of
    them; rows of a host with the same html are one page. Pages on which it holds more than ``most_of_page`` of the text don't
    count: pages that differ in nearly nothing else are versions of one page, not pages in one frame. Template is deleted
    on all pages of the host.
    A page on which only template stands has no text.
    Character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones left
    out, the others joined by two line feeds; nothing else is dropped. Null or empty html gives ''. A null url counts to
    the host ''. Repeated rows give equal results; other columns stay; no rows give no rows. Pages of any length and
    nested to any depth are read in linear time.

    Only hashes are shuffled. Pages are shuffled with the subtrees to delete only if those, restricted to subtrees whose
    deletion changes a page's text, are too many to broadcast by Spark's own threshold.
    """
    text = F.coalesce(F.col(html_col), F.lit(""))
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    kept = [c for c in columns if c != html_col]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")  # so that no column of the input meets one of ours
    keyed = pages.select(row, host_of(F.col(url_col)).alias("_host"), text.alias("_html")).withColumn("_page", F.xxhash64("_host", "_html"))
    found = written(_subtrees(keyed, most_of_page), "subtrees")
    counts = found.where("counts").select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.where("subtree = 0").select("host", F.col("n").alias("n_pages"))
    many = counts.where((F.col("subtree") != 0) & (F.col("n") >= min_pages)).join(sizes, "host").where(F.col("n") >= min_share * F.col("n_pages"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # The pages of one template meet it in SALTS tasks, and the rows of one page its deletions likewise.
    own = found.where("matters").select("host", "subtree", "page", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int").alias("salt"))
    held = own.join(many.select("host", "subtree", every), ["host", "subtree", "salt"])
    delete = written(held.groupBy("page").agg(F.collect_set("subtree").alias("_delete")), "templates")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [Page(source.as_py() or "").text(set(gone or ())) for source, gone in zip(part.column(1), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_row", "text", "n_chars"])

    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    joined = salted.join(delete.select("page", "_delete", every), (keyed["_page"] == F.col("page")) & (F.col("_salt") == F.col("salt")), "left").select("_row", "_html", "_delete")
    kind = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(work, f"_row {kind}, text string, n_chars long")
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "text", "n_chars")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op3_html": op3_html}
