"""The main text of web pages, with what a site repeats on its pages removed.

Every page is read as a tree of elements. The hash of an element's subtree, its tag and the hashes
of what it holds, is counted per host in Spark: over pages that differ in their longest block, so
that copies of one page count once. Subtrees that recur on many such pages of the host are its
template and are deleted from each page, beside the elements that say of themselves that they are
no text: scripts, menus, forms and the like.

Inside an article a paragraph may recur because many articles quote it; there it takes half of the
host's pages to be template.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, read, stage
from .registry import query

# Elements without main text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form iframe svg math button select textarea "
    "option object embed canvas audio video map dialog menu".split())
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
# Elements inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr input script style noscript template button select "
    "textarea svg math object".split())
# Elements that hold text and no other blocks, as a rule.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th blockquote figcaption caption address summary".split())
# Words in class, id or role that name what is no main text.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar footer masthead comment comments disqus cookie cookies consent gdpr "
    "notice newsletter subscribe signup share sharing social related recommended popup modal pagination pager widget "
    "login contentinfo complementary search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open paragraph, and the tags that end one of their own kind.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul li dt dd".split())
_ENDS_OWN = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
_SCOPES = frozenset("ul ol dl table article section div main body html aside nav td th blockquote".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SAID = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")

#: Pages of a host, different in their longest block, on which a template recurs.
LEAST_PAGES = 10
#: Share of the host's pages on which a paragraph of articles recurs to be template.
LEAST_SHARE = 0.5
#: Bits of the field that tells pages without a template apart before the shuffle: 2 ** 24 bits in
#: words of 48, 350,000 rows at most.
FIELD_BITS, FIELD_WORD = 24, 48


class Element:
    __slots__ = ("tag", "first", "end", "digest", "article", "furniture", "dropped", "prose", "parent", "heading", "holds")

    def __init__(self, tag: str, first: int, parent: Element | None):
        self.tag, self.first, self.end, self.parent = tag, first, first, parent
        self.digest = [tag]
        self.article = self.furniture = self.dropped = self.heading = self.holds = False
        self.prose = tag in PROSE


class Page:
    """Blocks of text of a page and the elements around them; ``hashed`` gives these their hashes."""

    def __init__(self, source: str, hashed: bool = True):
        self.hashed = hashed
        self.blocks: list[str] = []
        self.dropped: list[bool] = []
        self.elements: list[Element] = []
        self._text: list[str] = []
        self._hidden = 0
        self._root = Element("#", 0, None)
        self._open = [self._root]
        self._names: Counter[str] = Counter()
        self._read(source)
        while self._open:
            self._close()
        self.kept = self._main()

    # -- reading ------------------------------------------------------------------------------

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                self._words(source[at:])
                return
            if tag > at:
                self._words(source[at:tag])
            if source.startswith("<!--", tag):
                end = source.find("-->", tag + 4)
                at = size if end < 0 else end + 3
                continue
            following = source[tag + 1:tag + 2]
            if following in ("!", "?"):
                at = self._past(source, tag)
                continue
            closing = following == "/"
            name = _NAME.match(source, tag + 1 + closing)
            if not name:
                if closing:
                    at = self._past(source, tag)
                else:
                    self._words("<")
                    at = tag + 1
                continue
            end = self._tag_end(source, name.end())
            at = min(end + 1, size)
            kind = name.group().lower()
            if closing:
                self._end(kind)
                continue
            said = source[name.end():end]
            self._start(kind, said)
            if kind in RAW:
                close = _raw_end(kind).search(source, at)
                inside = source[at:close.start()] if close else source[at:]
                self._open[-1].digest.append(inside)
                at = close.start() if close else size

    @staticmethod
    def _past(source: str, tag: int) -> int:
        end = source.find(">", tag)
        return len(source) if end < 0 else end + 1

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """Place of the sign that ends a tag; a quoted value may hold that sign as well."""
        while True:
            end = source.find(">", at)
            if end < 0:
                return len(source)
            opened = None
            for c in _QUOTES.finditer(source, at, end):
                if opened is None:
                    opened = c.group()
                elif c.group() == opened:
                    opened = None
            if opened is None:
                return end
            closed = source.find(opened, end)
            if closed < 0 or "<" in source[end:closed]:
                return end
            at = closed + 1

    def _words(self, text: str) -> None:
        if not self._hidden:
            self._text.append(text)
        self._open[-1].digest.append(text)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text.clear()
        if text:
            self.blocks.append(text)

    # -- the tree -----------------------------------------------------------------------------

    def _start(self, tag: str, said: str) -> None:
        if tag in _ENDS_P:
            self._end("p", through=_SCOPES)
        if tag in _ENDS_OWN:
            for other in _ENDS_OWN[tag]:
                self._end(other, through=("table",) if tag.startswith("t") else _SCOPES)
        inline = tag in INLINE
        if not inline:
            self._flush()
        if tag in VOID:
            if tag in ("br", "img", "wbr", "hr"):
                self._words(" " if tag != "wbr" else "")
            return
        element = Element(tag, len(self.blocks), self._open[-1])
        if said.strip():
            names = set()
            for kind, value in _SAID.findall(said):
                names.update(w.lower() for w in _WORDS.findall(value))
                if kind.lower() == "role" and value.strip("\"'").lower() == "main":
                    element.article = True
            element.furniture = tag not in ("html", "body", "main") and bool(names & FURNITURE)
            element.dropped = bool(_HIDDEN.search(said))
            element.digest.append(" ".join(sorted(names)))
        element.article |= tag in ("article", "main")
        element.heading = tag in _HEADINGS
        element.dropped |= tag in DROPPED or (inline and element.furniture)
        if tag == "header":
            element.furniture = True
        self._hidden += element.dropped
        self._open.append(element)
        self._names[tag] += 1

    def _end(self, tag: str, through=()) -> None:
        """Close the innermost open element of the name, unless one of ``through`` lies around it."""
        if not self._names[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                while len(self._open) > i:
                    self._close()
                return
            if self._open[i].tag in through:
                return

    def _close(self) -> None:
        element = self._open.pop()
        self._names[element.tag] -= 1
        inline = element.tag in INLINE
        if not inline:
            self._flush()
        self._hidden -= element.dropped
        element.end = len(self.blocks)
        if self.hashed:
            element.digest = _hashed("\0".join(
                " ".join(d.split()) if isinstance(d, str) else str(d) for d in element.digest))
            if element.parent is not None:
                element.parent.digest.append(element.digest)
        if not inline and element.end > element.first:
            self.elements.append(element)

    # -- the main text ------------------------------------------------------------------------

    def _main(self) -> list[bool]:
        """Which blocks lie in the main text by what the elements say of themselves."""
        blocks = len(self.blocks)
        furniture = [e for e in self.elements if e.furniture]
        marked = _covered(blocks, ((e.first, e.end) for e in furniture))
        articles = [e for e in self.elements if e.article and not e.furniture and not self._inside(e)]
        # Articles that all lie within furniture are the text, and what is around them is a wrapper.
        articles = [e for e in articles if not all(marked[e.first:e.end])] or articles
        for a in articles:
            above = a
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        out = _covered(blocks, ((f.first, f.end) for f in furniture if not f.holds))
        # A header inside an article holds its headings.
        for e in self.elements:
            if e.heading and self._in_header(e):
                for i in range(e.first, e.end):
                    out[i] = False
        self.inside = _covered(blocks, ((a.first, a.end) for a in articles))
        return [(i or not articles) and not o for i, o in zip(self.inside, out)]

    @staticmethod
    def _inside(element: Element) -> bool:
        """Whether an article lies within furniture, such as comments, that is within an article."""
        found, above = False, element.parent
        while above is not None:
            if above.furniture and above.tag != "header":
                found = True
            if found and above.article:
                return True
            above = above.parent
        return False

    @staticmethod
    def _in_header(element: Element) -> bool:
        above, header = element.parent, False
        while above is not None:
            if above.tag == "header":
                header = True
            elif above.furniture:
                return False
            elif above.article:
                return header
            above = above.parent
        return False

    def candidates(self) -> list[tuple[int, bool, int, int]]:
        """Subtree hash, whether it is a paragraph of an article, and the blocks of every element
        that may be template: those within the page's main text, of elements around the same
        blocks the outermost, and none that holds an article or the whole main text."""
        total = sum(self.kept)
        kept_before = [0]
        for k in self.kept:
            kept_before.append(kept_before[-1] + k)
        seen, found = set(), []
        for e in reversed(self.elements):
            n = kept_before[e.end] - kept_before[e.first]
            if not n or n == total or e.holds or (e.first, e.end) in seen:
                continue
            seen.add((e.first, e.end))
            found.append((e.digest, self.inside[e.first] and e.prose, e.first, e.end))
        return found

    def signature(self) -> int:
        """Hash of the longest block of the main text: what makes the page another one."""
        longest = max((b for b, k in zip(self.blocks, self.kept) if k), key=len, default="")
        return _hashed(longest)

    def text(self, templates=frozenset()) -> str:
        gone = _covered(len(self.blocks), (
            (first, end) for digest, _, first, end in self.candidates() if digest in templates)) if templates else None
        return "\n".join(b for i, (b, k) in enumerate(zip(self.blocks, self.kept)) if k and not (gone and gone[i]))


def _hashed(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


_QUOTES = re.compile("[\"']")
_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _RAW_ENDS:
        _RAW_ENDS[tag] = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I)
    return _RAW_ENDS[tag]


def _covered(blocks: int, spans) -> list[bool]:
    """Which blocks some span covers."""
    change = [0] * (blocks + 1)
    for first, end in spans:
        change[first] += 1
        change[end] -= 1
    out, depth = [], 0
    for c in change[:blocks]:
        depth += c
        out.append(depth > 0)
    return out


# -- in Spark -----------------------------------------------------------------------------------


def _keyed(pages: DataFrame, page_id: str, url: str, source: str) -> DataFrame:
    host = F.regexp_extract(
        F.lower(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    body = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.xxhash64(host).alias("host"),
        F.xxhash64(host, body).alias("page"), body.alias("body"))


def subtrees(keyed: DataFrame) -> DataFrame:
    """Stored: page, host, signature of the page and its candidate subtrees (hash, strict)."""
    schema = "page long, host long, signature long, hashes array<long>, strict array<boolean>"
    arrow = pa.schema([
        ("page", pa.int64()), ("host", pa.int64()), ("signature", pa.int64()),
        ("hashes", pa.list_(pa.int64())), ("strict", pa.list_(pa.bool_()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, hashes, strict = [], [], []
            for body in batch.column(2):
                page = Page(body.as_py())
                found = page.candidates()
                signatures.append(page.signature())
                hashes.append([f[0] for f in found])
                strict.append([f[1] for f in found])
            columns = [batch.column(0), batch.column(1), *[
                pa.array(c, type=arrow.field(i).type) for i, c in enumerate((signatures, hashes, strict), 2)]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return stage(keyed.select("page", "host", "body").mapInArrow(parse, schema), compression="zstd")


def templates(trees: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Subtrees that recur on a host: key (of host and subtree), host, hash and n, the number of its
    pages with different longest blocks that have it."""
    single = trees.select(
        "host", "signature", F.explode(F.arrays_zip("hashes", "strict")).alias("e")
    ).groupBy("host", F.col("e.hashes").alias("hash"), "signature").agg(F.min("e.strict").alias("strict"))
    counted = single.groupBy("host", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("strict").alias("strict")).where(F.col("n") >= least_pages)
    pages = trees.select("host", "signature").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = lookup(counted, pages, "host", "hash")
    return found.where(~F.col("strict") | (F.col("n") >= least_share * F.col("pages"))).select(
        F.xxhash64("host", "hash").alias("key"), "host", "hash", "n")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html",
              least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per page: page_id, url, text and removed, the number of template subtrees deleted.

    Blocks of the text are divided by one line feed, white space inside them is one space. A null
    source counts as empty and has an empty text; without a url the host is empty, as of all such
    pages. Repeated rows stay; an empty table gives an empty result; other columns are not looked
    at. Pages without a template subtree are not shuffled.
    """
    keyed = _keyed(pages, page_id, url, source)
    trees = subtrees(keyed)
    found = stage(templates(trees, least_pages, least_share).select("key"))
    held = trees.select("page", "host", F.explode("hashes").alias("hash")).select(
        "page", "hash", F.xxhash64("host", "hash").alias("key")).distinct()
    deleted = stage(lookup(held, found, "key", "page").groupBy("page").agg(F.collect_list("hash").alias("gone")))
    at = F.pmod("page", F.lit(1 << FIELD_BITS))
    field = F.broadcast(
        deleted.select(at.alias("at")).groupBy(F.expr(f"at div {FIELD_WORD}").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(at % {FIELD_WORD} as int)))").alias("bits")))
    asked = keyed.withColumn("at", at).join(field, F.expr(f"at div {FIELD_WORD}") == F.col("word"), "left").withColumn(
        "may", F.expr(f"coalesce(shiftright(bits, cast(at % {FIELD_WORD} as int)) & 1L, 0L) = 1L")
    ).drop("at", "word", "bits")
    nothing = F.array().cast("array<bigint>")
    through = asked.where(~F.col("may")).withColumn("gone", nothing)
    # Copies of a page share its row of deletions: they are dealt over salts.
    salted = asked.where("may").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
    met = salted.join(deleted.withColumn("salt", salts), ["page", "salt"], "left").withColumn(
        "gone", F.coalesce("gone", nothing))
    columns = ["page_id", "url", "body", "gone"]
    rows = through.select(columns).unionByName(met.select(columns))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, removed int"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(body, hashed=bool(gone)).text(frozenset(gone))
                for body, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            removed = [len(gone.as_py()) for gone in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int32())],
                names=["page_id", "url", "text", "removed"])

    return rows.mapInArrow(extract, schema)


@query("op12_html_main")
def op12_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "removed")
