"""Token alignment, main text of pages and the filter audit against plain versions of themselves."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from usagelake.llm import filter_audit, html_main, token_alignment as ta
from usagelake.llm.csr import CSR

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- sparse matrices ----------------------------------------------------------------------------


@pytest.mark.parametrize("held", [1, 7, 1 << 22])
def test_products_equal_dense_ones(monkeypatch, held):
    monkeypatch.setattr("usagelake.llm.csr.HELD", held)
    rng = np.random.default_rng(4)
    for n, m, k in ((0, 3, 2), (5, 0, 2), (6, 7, 0), (9, 8, 7), (1, 40, 30)):
        a, b = (rng.integers(0, 3, size) * (rng.random(size) < 0.4) for size in ((n, m), (m, k)))
        row, col = np.nonzero(a)
        left = CSR.summed(row, col, a[row, col], n, m)
        row, col = np.nonzero(b)
        order = rng.permutation(len(row))
        right = CSR.summed(row[order], col[order], b[row, col][order], m, k)
        product = left.times(right)
        dense = np.zeros((n, k), dtype=int)
        dense[product.rows(), product.indices] = product.data
        assert (dense == a @ b).all() and (product.height, product.width) == (n, k)
        assert (left.times_vector(np.arange(m)) == a @ np.arange(m)).all()
        assert (left.row_sums() == a.sum(axis=1)).all() and (left.row_counts() == (a != 0).sum(axis=1)).all()
        assert left.transposed().height == m
        row, col = rng.integers(0, max(n, 1), 50 * (n * m > 0)), rng.integers(0, max(m, 1), 50 * (n * m > 0))
        one, two = CSR.counted(row, col, n, m), CSR.summed(row, col, np.ones(len(row), dtype=int), n, m)
        assert all((getattr(one, x) == getattr(two, x)).all() for x in ("indptr", "indices", "data"))


# -- token alignment ----------------------------------------------------------------------------

TRICKY = [
    "", " ", "  ", "\n", "a", "a b", " a  b ", "a\n b\n  c \t d", "it's  he'll  x", "<|endoftext|> <s> </s> <unk> <0x41>",
    "日本語 текст \U0001F600 ﬁ é́", "x▁y", "tail \x1c \x85 !\x1c end", "\x00 \x01", "1234567 89,5 -- ...", "no  space",
]


@pytest.fixture(scope="module")
def tokenizers():
    return ta.Tokenizers(f"{ta.FOLDER}/{ta.FILE_A}", f"{ta.FOLDER}/{ta.FILE_B}")


def plain_alignment(tk, text):
    """Tokens, groups and links of one text, pair by pair, or nothing where bytes differ."""
    body = (" " + text).encode()
    a = tk.a.encode(" " + text, add_special_tokens=False).ids
    b = tk.b.encode(text)
    if not text or b"".join(tk.bytes_a[i] for i in a) != body or b"".join(tk.bytes_b[i] for i in b) != body:
        return None

    def places(ids, table):
        ends = list(itertools.accumulate(len(table[i]) for i in ids))
        return list(zip([0, *ends], ends, ids))

    left, right = places(a, tk.bytes_a), places(b, tk.bytes_b)
    links, first = [], 0
    for s, e, i in left:
        while right[first][1] <= s:
            first += 1
        at = first
        while at < len(right) and right[at][0] < e:
            links.append((i, right[at][2]))
            at += 1
    cuts = {e for _, e, _ in left} & {e for _, e, _ in right}
    sides = []
    for side in (left, right):
        sides.append([[]])
        for _, e, i in side:
            sides[-1][-1].append(i)
            if e in cuts:
                sides[-1].append([])
    return a, b, list(zip(sides[0][:-1], sides[1][:-1])), links


def plain_corpus(tk, texts):
    found = [plain_alignment(tk, t) if t else None for t in texts]
    counts = Counter(p for f in found if f for p in set(f[3]))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, groups, links = f
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(written.encode()).hexdigest(),
            sum(len(x) * len(y) for x, y in groups)))
    return out


def test_byte_level_vocabulary_is_decoded(tokenizers):
    assert {b for t in tokenizers.bytes_a for b in t} == set(range(256)) - {0xC0, 0xC1, *range(0xF5, 0x100)} \
        or {b for t in tokenizers.bytes_a for b in t} == set(range(256))
    for text in TRICKY:
        ids = tokenizers.a.encode(text, add_special_tokens=False).ids
        assert b"".join(tokenizers.bytes_a[i] for i in ids) == text.encode()


def test_a_piece_has_the_tokens_it_has_in_the_text(tokenizers):
    for text in [t for t in TRICKY if t and ta.SPACE not in t] + [r[1] for r in data.plain(9)]:
        pieces = ta.pieces_of(text)
        assert "".join(pieces) == " " + text
        a, b = ta.encode_pieces(tokenizers, pieces)
        assert a.tolist() == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == tokenizers.b.encode(text)


def test_shared_groups_are_the_pairs_of_every_group(tokenizers):
    text = "Fußgängerübergänge überraschenderweise 日本"
    found = ta.Alignment(tokenizers, [" " + text], *tokenizers.encode(" " + text))
    groups = plain_alignment(tokenizers, text)[2]
    shared = found.shared()
    assert sorted(zip(found.ids_a[shared.rows()].tolist(), found.ids_b[shared.indices].tolist())) == sorted(
        (x, y) for a, b in groups for x in a for y in b)
    assert found.per_text()["n_shared"].tolist() == [len(shared.data)]
    assert sum(found.overlaps.data) == len((" " + text).encode())


@pytest.mark.parametrize("block", [1, 2000, ta.BLOCK])
@pytest.mark.parametrize("at_once", [1, ta.AT_ONCE])
def test_alignment_equals_the_plain_one(spark, tokenizers, monkeypatch, block, at_once):
    if at_once == 1 and block != 2000:
        pytest.skip("one size of block is enough")
    monkeypatch.setattr(ta, "AT_ONCE", at_once)
    monkeypatch.setattr(ta, "REMEMBERED", 5 if block == 2000 else ta.REMEMBERED)
    texts = [(i, t) for i, t in enumerate(TRICKY * 2)] + [(None, None), (None, "a b"), (99, "a b"), (99, "a b")]
    texts += [(1000 + r[0], r[1]) for r in data.plain(25)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("n_a", F.lit("x"))
    found = Counter(tuple(r) for r in ta.align(df, block_bytes=block).collect())
    assert found == Counter((t[0], *p) for t, p in zip(texts, plain_corpus(tokenizers, [t for _, t in texts])))


def test_a_text_with_other_bytes_leaves_its_block_alone(spark, tokenizers, monkeypatch):
    """Where the pieces of a block don't give its bytes, every document is asked for by itself."""
    encode = ta.Tokenizers.encode
    monkeypatch.setattr(ta.Tokenizers, "encode", lambda self, t: None if "q" in t else encode(self, t))
    found = ta.align_block(ta.Pieces(tokenizers), ["good text", "q other", "more text"])
    assert found["sums"]["n_a"].tolist() == [2, 0, 2] and found["digests"][1] == ""
    monkeypatch.setattr(ta.Tokenizers, "encode", encode)
    alone = ta.align_block(ta.Pieces(tokenizers), ["good text", "more text"])
    assert [d for d in found["digests"] if d] == alone["digests"]


def test_pieces_of_several_blocks_are_not_encoded_again(tokenizers, monkeypatch):
    monkeypatch.setattr(ta, "REMEMBERED", 8)
    asked, encode = [], ta.encode_pieces
    monkeypatch.setattr(ta, "encode_pieces", lambda t, pieces: asked.append(list(pieces)) or encode(t, pieces))
    known, blocks = ta.Pieces(tokenizers), [["the cat one two"], ["the cat three four five six seven"], ["cat the one"]]
    found = [ta.align_block(known, texts) for texts in blocks]
    assert asked[2] == [" one"] and len(known.number) == 3
    alone = ta.align_block(ta.Pieces(tokenizers), blocks[2])
    assert found[2]["digests"] == alone["digests"] and found[2]["pairs"].tolist() == alone["pairs"].tolist()
    assert {n: v.tolist() for n, v in found[2]["sums"].items()} == {n: v.tolist() for n, v in alone["sums"].items()}


def test_alignment_of_an_empty_table_and_of_a_long_text(spark, tokenizers):
    assert ta.align(data.frame(spark, [])).count() == 0
    rows = data.odd()
    texts = [r[1] for r in rows]
    found = Counter(tuple(r) for r in ta.align(data.frame(spark, rows, clash=True)).collect())
    assert found == Counter((r[0], *p) for r, p in zip(rows, plain_corpus(tokenizers, texts)))


# -- filter audit -------------------------------------------------------------------------------


def plain_audit(rows, labels):
    marks, least = [], {}
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, text, lang, *_ in rows:
        body = text or ""
        words = WORDS.findall(body)
        fails = "".join(c for c, f in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", body)) > 3 * len(body), bool(re.search(r"[#$%&*|]", body)),
            key is not None and key > least[body])) if f)
        own = [r for r in labels if r[0] == key and key is not None]
        marks.append((lang or "", fails, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out, shapley = {}, Counter()
    for part in {m[0] for m in marks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                rest = [m for m in marks if m[0] == part]
                gone = [m for m in rest if set(m[1]) & set(order[:step - 1])]
                here = [m for m in rest if c in m[1] and m not in gone]
                out[part, order, step] = (
                    len(rest) - len(gone) - len(here), len(here), sum(c in m[1] for m in gone),
                    sum(m[1] == c for m in rest), sum(m[2] for m in here), sum(m[3] for m in here))
                shapley[part, c] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    long = " ".join(f"w{i}" for i in range(250))
    rows = data.plain(12) + data.odd()
    rows += [(2000 + i, t, lang, "s", 1) for i, (t, lang) in enumerate([
        (long, "en"), (long, "de"), (long, "en"), (long + " #", "en"), (long.upper(), "en"), ("AB " * 250, "en"),
        (long + " Ünï x \U0001F600", None), (long, "")])]
    rows += [(2000, long, "en", "s", 1), (None, long, "en", "s", 1)]
    return rows


LABELS = [(2000, 1, 0), (2001, 1, 1), (2003, 0, 1), (2003, 1, None), (5, 1, 1), (None, 1, 1), (77777, 1, 1)]


@pytest.mark.parametrize("block", [1, 700, filter_audit.BLOCK])
def test_audit_equals_the_plain_one(spark, block):
    rows = audit_rows()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(data.frame(spark, rows, clash=True), labels, block_bytes=block).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == plain_audit(rows, LABELS)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_row_sums_and_counts_are_words_and_different_words(spark):
    rows = audit_rows()
    found = filter_audit.measured(data.frame(spark, rows), block_bytes=900).collect()
    expected = Counter(
        (r[0], len(w := WORDS.findall(r[1] or "")), len(set(w)), len(r[1] or ""), len(re.findall("[A-Z]", r[1] or "")))
        for r in rows)
    assert Counter((r.doc_id, r.n_words, r.n_distinct, r.n_points, r.n_capitals) for r in found) == expected


def test_the_dictionary_has_no_gaps_and_blocks_agree_on_it(spark):
    rows = audit_rows()
    blocks = filter_audit.matrix_blocks(data.frame(spark, rows), block_bytes=900)
    words = {w for r in rows for w in (r[1] or "").encode().split()}
    numbers = {bytes(r.word): r.id for r in filter_audit.dictionary(blocks).collect()}
    assert set(numbers) == words and sorted(numbers.values()) == list(range(len(words)))
    seen = defaultdict(set)
    own = {r.block: r.words for r in blocks.collect()}
    for r in filter_audit.terms(blocks).collect():
        seen[bytes(own[r.block][r.local])].add(r.id)
    assert seen == {w: {n} for w, n in numbers.items()}


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(data.frame(spark, []), labels).count() == 0
    found = filter_audit.audit(data.frame(spark, [(1, "a", "en", None, 1)]), labels).collect()
    assert len(found) == 600 and {r.removed for r in found} == {0, 1} and not any(r.good_lost or r.toxic_lost for r in found)


# -- main text of pages -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site"><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav>
<div class="content sidebar-wrap"><article><header><h2>Title &eacute;</h2><p>By me</p></header>
<p title="a > b">One <a href=x>two</a>
 three<br>four<div class="share">Share</div><p>Five <span class="ad">buy</span> six<script>if (a<b) "</p>"</script>
<ul><li>l1<li>l2</ul><table><tr><td>a<td>b<tr><td>c</table><!-- <p>no</p> --><pre>a  b</pre>
<section id="comments"><article><p>nice</article></section><form>f<input></form></article></div>
<aside>more</aside><div class="cookie-notice">We</div><footer>&copy; f</footer>"""


@pytest.mark.parametrize("source, text", [
    (PAGE, "Title é\nOne two three four\nFive six\nl1\nl2\na\nb\nc\na b"),
    ("", ""), ("   ", ""), ("<article></article>", ""), ("plain &lt;b&gt; text", "plain <b> text"),
    ("a < b <3 <", "a < b <3 <"), ("<p>one<p>two", "one\ntwo"), ("<p>a&nbsp;\n b</p", "a b"),
    ("<script>x", ""), ("<article><p>x<script>1</article>", "x"), ("<b>open <p>block</p> rest", "open\nblock\nrest"),
    ("<p>a<!-- open", "a"), ("<article><p>t &am", "t &am"), ('<p class="x>y">z', "z"), ("<p hidden>no<p>yes", "yes"),
    ("</div></p>x", "x"), ("<ARTICLE><P>Up</P></ARTICLE>out", "Up"),
    ("<div class=comments><article class=comment>c</article></div><p>body", "body"),
])
def test_text_of_one_page(source, text):
    assert html_main.Page(source).text() == text
    assert html_main.Page(source, hashed=False).text() == text


def test_deep_and_long_pages_are_read(spark):
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000
    assert html_main.Page(deep).text() == "x"
    long = "<article>" + "<p>word &amp; word" * 50_000
    assert html_main.Page(long).text().count("\n") == 49_999


def site(n=30, host="a.example"):
    """Articles of their own with a box, a line and a list that the site puts on each."""
    return [(i, f"https://{host}/p{i}", f"""<body><div><a href=/>Home</a> <a href=/x>X</a></div><div><p>Own words
{i} of {host}, {'long ' * 9}.</p><div><p>Read our offers</p><p>Now</p></div>{'<p>Quoted by some.</p>' if i % 4 == 0 else ''}</div>
<div>Imprint of the site</div>""") for i in range(n)]


def test_what_a_site_repeats_goes(spark):
    rows = site() + site(30, "b.example") + [(90, "https://c.example/", site()[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id if r.url[8] != "b" else -1 - r.page_id: r.text for r in html_main.main_text(df).collect()}
    for i in range(30):
        quoted = "\nQuoted by some." if i % 4 == 0 else ""
        assert found[i] == f"Own words {i} of a.example, {'long ' * 9}." + quoted
        assert found[-1 - i].startswith(f"Own words {i} of b.example") and "offers" not in found[-1 - i]
    # Another host has its own template: a single page is left as it is.
    assert "Read our offers" in found[90] and "Imprint" in found[90]


def test_copies_of_a_page_and_quoted_paragraphs_are_no_template(spark):
    article = "<article><p>{}</p><p>A passage that many quote.</p><div><p>Box of the site.</p></div></article>"
    rows = [(i, "http://h/", article.format("Same long text of one page, published often.")) for i in range(40)]
    rows += [(100 + i, "http://H:80/x", article.format(f"Text number {i}, longer than what else is there.")) for i in range(15)]
    rows += [(200 + i, "http://h/y", f"<article><p>Text number {i}, without passages at all.</p></article>") for i in range(40)]
    rows += [(None, None, None), (None, None, None), (300, "not a url", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page", F.lit(1)).withColumn("host", F.lit(2))
    found = html_main.main_text(df).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found if r.page_id is not None}
    assert texts[0] == "Same long text of one page, published often.\nA passage that many quote."
    assert texts[107] == "Text number 7, longer than what else is there.\nA passage that many quote."
    assert texts[203] == "Text number 3, without passages at all." and texts[300] == "x"
    assert [r.text for r in found if r.page_id is None] == ["", ""]


def plain_templates(pages, least):
    """Counts per host by one pass over all pages, held in memory."""
    on = defaultdict(set)
    total = defaultdict(set)
    for _, url, source in pages:
        host = re.sub(r"^\w+://([^/:]*).*", r"\1", url.lower())
        page = html_main.Page(source)
        total[host].add(page.signature())
        for digest, strict, *_ in page.candidates():
            on[host, digest, strict].add(page.signature())
    return {(h, d): len(s) for (h, d, strict), s in on.items()
            if len(s) >= least and (not strict or 2 * len(s) >= len(total[h]))}


def test_templates_equal_the_plain_count(spark):
    rows = site(40) + site(13, "b.example") + site(9, "c.example")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    keyed = html_main._keyed(df, "page_id", "url", "html")
    found = html_main.templates(html_main.subtrees(keyed))
    names = {r.host: r.name for r in spark.createDataFrame(
        [(f"{h}.example",) for h in "abc"], "name string").select(F.xxhash64("name").alias("host"), "name").collect()}
    assert {(names[r.host], r.hash): r.n for r in found.collect()} == plain_templates(rows, 10)


def test_pages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.main_text(empty).count() == 0


def test_the_audit_stores_blocks_apart(spark):
    """Spark's reader takes the rows of a file together, and a block is as large as a task stands."""
    docs = data.frame(spark).coalesce(1)
    blocks = filter_audit.matrix_blocks(docs, block_bytes=4096)
    files = blocks.groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(files) > 5 and {r["count"] for r in files} == {1}
