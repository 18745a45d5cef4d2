import gzip
import hashlib
import base64
import random
import zlib

import pytest
from pyspark.sql import functions as F

from harrow.llm import htmltext, warc
from harrow.llm.common import scratch

PAGES = "page_id long, url string, html string"


def pages(spark, rows, extra=False):
    df = spark.createDataFrame(rows, PAGES)
    if extra:
        for c in ("row", "host", "text", "blocks", "payload_bytes", "sha1", "value", "best", "maybe"):
            df = df.withColumn(c, F.lit("x"))
    return df


ODD = [(1, "http://a/1", None), (2, "http://a/2", ""), (None, None, "<p>x"), (None, "u", "<p>x"), (5, "http://a/5", "<p>x"), (5, "http://a/5", "<p>x"),
       (6, "http://b\r\nX: y/", "é\x00\r\n\r\nWARC/1.1\r\n\U0001f600"), (7, "http://a/7", "<p>" + "long words " * 60_000)]


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rows = ODD + [(100 + i, f"http://c/{i}", random.Random(i % 9).choice(["<p>same</p>", "tiny", "z" * i])) for i in range(40)]
    got = warc.round_trip(pages(spark, rows, extra=True), min_revisit=least, file_bytes=20_000).collect()
    assert len(got) == len(rows)
    same: dict = {}
    for i, _, h in rows:
        same.setdefault((h or "").encode(), []).append(i)
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    want = []
    for payload, ids in same.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        one = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            first = i == best and not one
            one |= first
            revisit = len(payload) >= least and not first
            want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response",
                         best if revisit else None))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_every_record_is_a_member_at_its_offset(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'page ' * i}</p>") for i in range(30)]
    raw, path = scratch(spark, "raw"), scratch(spark, "arc")
    warc.write_monolithic(warc.classified(pages(spark, rows)), raw)
    index = warc.normalise(spark, raw, path).collect()
    files = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(path + "/part-*").collect()}
    assert len(index) == 30
    for r in index:
        d = zlib.decompressobj(wbits=31)
        record = d.decompress(files[r["archive"]][r["offset"]:r["offset"] + r["length"]])
        assert d.eof and not d.unused_data
        fields, payload = warc.headers(record)
        assert fields["WARC-Target-URI"] == r["url"] == f"http://h/{r['page_id']}"
        assert payload.decode() == rows[r["page_id"]][2] and warc.base32_sha1(payload) == r["payload_digest"]
    plain = b"".join(gzip.decompress(f) for f in files.values())
    source = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(raw + "/*.gz").collect())
    assert sorted(warc.members(gzip.compress(plain))) == sorted(warc.members(gzip.compress(source)))
    read = warc.read_records(spark, path, spark.createDataFrame(index)).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read} == {i: h for i, _, h in rows}


def test_warc_of_no_pages_and_broken_archives(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    assert gzip.decompress(warc.EMPTY_MEMBER) == b"" and len(warc.EMPTY_MEMBER) == 20
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")))


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice"><p>We use</p></div>
<article><header><h1>Head &amp; <i>line</i></h1></header><p>One  <b>two</b>three<p>Four&nbsp;five<br>six &lt;x&gt; 3 < 4
<ul><li>a<li>b</ul><aside>no</aside><table><tr><td>c1<td>c2</table><form>f</form><script>var a="</p>";</script><!-- <p>c</p> -->
<section id="comments"><p>spam</p></section><p hidden>h</p><p>End&#233;</p></article><aside>side</aside><footer>f</footer></body>"""


def test_article_without_furniture(spark):
    got = htmltext.main_text(pages(spark, [(1, "http://a/1", ARTICLE)], extra=True)).first()
    assert got["text"] == "Head & line\nOne twothree\nFour five six <x> 3 < 4\na\nb\nc1\nc2\nEndé"
    assert got["n_chars"] == len(got["text"]) and got["url"] == "http://a/1"


def plain(i, host="h", menu=True):
    links = "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(3 + i % 2))
    return (i, f"http://{host}/{i}", f"<body><div class=top>Welcome to the site<p>of all sites</p></div><div class=links><ul>{links}</ul></div>"
            f"<div class=body><p>Own words {i} of page</p><p>more {i * 7}</p></div><div>Imprint, contact</div></body>")


def test_templates_of_a_host_go(spark):
    rows = [plain(i) for i in range(40)] + [plain(i, "lone") for i in range(100, 102)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Own words {i} of page\nmore {i * 7}" for i in range(40))
    # Two pages are too few to tell a template.
    assert all("Welcome" in got[i] and f"Own words {i} of page" in got[i] for i in (100, 101))


def test_text_that_articles_share_stays(spark):
    rows = [(i, "http://h/x", f"<body><article><p>Licensed under CC.</p><p>n {i}</p></article></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Licensed under CC.\nn {i}" for i in range(30)}


def test_link_blocks_that_recur_inside_articles_go(spark):
    more = "<div class=x><p><a href=/1>Ten best</a></p><p><a href=/2>Our shop</a></p></div>"
    rows = [(i, f"http://h/{i}", f"<body><article><p>Licensed under CC.</p><p>n {i}</p>{more}<ul><li><a href=/s{i}>Source {i}</a></ul></article></body>")
            for i in range(30)] + [(99, "http://lone/", f"<article><p>n</p>{more}</article>")]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages(spark, rows)).collect()}
    assert got.pop(99) == "n\nTen best\nOur shop"
    assert got == {i: f"Licensed under CC.\nn {i}\nSource {i}" for i in range(30)}


def test_templates_of_a_section_of_a_large_host_go(spark):
    rows = [plain(i) for i in range(110)] + [(1000 + i, f"http://h/{i}", f"<p>page {i}</p>") for i in range(1100)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Own words {i} of page\nmore {i * 7}" for i in range(110))


@pytest.mark.parametrize("page", ["<html class=share><body class='has-sidebar'>{}</body>", "<body class=menu id=search><main class=related>{}</main>",
                                  "<body><div class='sidebar widget'><div class=with-comments>{}</div></div><div class=sidebar>s</div>"])
def test_names_never_take_the_whole_page(page):
    def left(html):
        return [t for t, _, role, _ in htmltext.blocks(html)[0] if not role]

    assert left(page.format("<article class='post has-comments'><p>a</p><div class=comments>b</div></article>")) == ["a"]
    assert left("<body class=has-sidebar><p class=no-comments>a</p><div class=sidebar-left>b</div></body>") == ["a"]
    assert left("<article>a</article><div class=comments><article>b</article></div>") == ["a"]
    assert left("<div class=widget><article>a</article></div><div class=widget><article>b</article></div>") == ["a", "b"]


def test_odd_pages(spark):
    got = htmltext.main_text(pages(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[5] == "x" and by[7] == " ".join(["long words"] * 60_000)
    assert htmltext.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_broken_markup_never_fails():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='", "'>", "<article>", "</article>", "<!--", "-->", "<script>", "</script", "&amp", "text ", "<li>", "</ul>",
            "<a href=x>", "</a>", "<table><tr><td>", "</span>", "<span hidden>", "<", ">", "&#xZZ;", "<br/>", "<b", "\n"]
    for _ in range(2000):
        htmltext.blocks("".join(rng.choice(bits) for _ in range(25)))


@pytest.mark.parametrize("part", ["<section id='related-work'><p>x</p></section>", "<div class='social-science'>x</div>", "<p class='share-price'>x</p>",
                                  "<h2 id='search'>x</h2>", "<div class='ad-hoc-query'>x</div>", "<blockquote class='comment'>x</blockquote>"])
def test_names_of_an_articles_own_parts_stay(part):
    def left(html):
        return [t for t, _, role, _ in htmltext.blocks(html)[0] if not role]

    assert left(f"<body><article><p>a</p>{part}<p>b</p></article></body>") == ["a", "x", "b"]


def test_comments_and_forms():
    def left(html):
        return [t for t, _, role, _ in htmltext.blocks(html)[0] if not role]

    assert left("<article><p>a</p><article class='comment'><p>c</p></article><article class='comment-12 reply'>d</article></article>") == ["a"]
    assert left("<article><p>a</p><article class='case-study'><p>c</p></article></article>") == ["a", "c"]
    assert left("<article><p>a</p><div class='share-buttons'>s</div><div id='related-posts'>r</div><div class='comments-area'>c</div></article>") == ["a"]
    assert left("<form><div><p>a</p><p>b</p></div></form>") == ["a", "b"]
    assert left("<form action=x><article><p>a</p></article><div class=sidebar>s</div></form>") == ["a"]
    assert left("<p>a</p><form>f</form>") == ["a"] and left("<form><nav>n</nav><p>a</p></form>") == ["a"]


def test_addresses_that_look_like_headers(spark):
    rows = [(1, "http://a/?Content-Length: 999999", "<p>x"), (2, "Content-Length: 2", "<p>long enough</p>"), (3, "x\r\nContent-Length: 1\r\n\r\nWARC/1.1", "y"),
            (4, "http://a/WARC-Type: revisit", "<p>x")]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, rows)).collect()}
    assert got == {1: (4, "revisit", 4), 2: (18, "response", None), 3: (1, "response", None), 4: (4, "response", None)}
