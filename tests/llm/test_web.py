"""HTML extraction, archives and URL filters."""

import hashlib
import html as entities
import io
import re
import zipfile

import pytest

pytest.importorskip("catchment.llm")
from catchment.llm import html, urlfilter, warc

FOLDER = "/root/testdata/sf0.001"


def plain_article(page):
    """The article of the synthetic pages, whose one form is known."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    got = html.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_wrapper_without_landmarks(spark):
    page = "<body><div class=x>Site name</div><div class=c>Body {0}<ul><li>a {0}<li>b</ul></div><div class='cookie-notice'>ok {0}</div><p>tail</p></body>"
    rows = [(k, f"http://h/{k}", page.format(k), "text") for k in range(3)]
    rows += [(10, None, None, ""), (11, "http://z/", "", ""), (12, "http://y/", "<p>only &amp; one<script>x</p></script> here<!-- open <p>x", ""), (0, "http://h/0", page.format(0), "text")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html.extract(table).collect())
    assert got == [(0, "Body 0\na 0\nb"), (0, "Body 0\na 0\nb"), (1, "Body 1\na 1\nb"), (2, "Body 2\na 2\nb"), (10, ""), (11, ""), (12, "only & one here")]
    assert html.extract(table.limit(0)).count() == 0


def test_mirrored_pages_keep_their_text(spark):
    page = "<body><div class=x>Site</div><div class=c>Body {0}</div><div class='cookie-notice'>ok {1}</div><p>tail</p></body>"
    rows = [(k, f"http://one/{k}", page.format("a", k)) for k in range(3)] + [(9, "http://two/9", page.format("a", 0))]
    rows += [(10 + k, f"http://two/{k}", page.format("b", k)) for k in range(2)]
    got = dict((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {**{k: "Site\nBody a\ntail" for k in range(3)}, 9: "Body a", 10: "Body b", 11: "Body b"}


def test_template_inside_the_main_element(spark):
    from random import Random

    def prose(seed):
        r = Random(seed)
        return " ".join(f"w{r.randrange(10_000)}" for _ in range(60))

    page = "<body><main><div class=byline>By the staff of this site</div><h1>{0}</h1><div class=text>{1}</div></main></body>"
    # Different articles share the byline; near copies of one article share its heading, which stays.
    rows = [(k, f"http://many/{k}", page.format(f"Heading {k}", prose(k))) for k in range(6)]
    rows += [(10 + k, f"http://copies/{k}", page.format("Heading", prose(0) + f" end{k}")) for k in range(6)]
    got = dict((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {**{k: f"Heading {k}\n{prose(k)}" for k in range(6)}, **{10 + k: f"By the staff of this site\nHeading\n{prose(0)} end{k}" for k in range(6)}}


def test_odd_markup():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    for page in (deep, "<" * 10_000, "<a href='" + "q" * 10_000, "<p>" * 5000, "&#xZZ; &amp &copy;"):
        root, _ = html.parse(page)
        assert html.skeleton(root)


def test_deep_elements_and_long_attributes_count(spark):
    deep = "<div>" * 400
    pages = [deep + "<article><p>kept {0}</p><nav>menu {0}</nav></article>", f"<div title='{'>' * 9000}'><nav data-x=\"{'a>' * 9000}\">menu {{0}}</nav><article><p>kept {{0}}</p></article></div>"]
    rows = [(10 * j + k, f"http://h{j}/{k}", p.replace("{0}", str(k))) for j, p in enumerate(pages) for k in range(3)]
    got = dict((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {10 * j + k: f"kept {k}" for j in range(2) for k in range(3)}


def test_matching_is_the_best_in_order():
    a, b = html.Tree('["r",0,["x",0],["y",0,["z",0]],["w",0]]'), html.Tree('["r",0,["y",0,["z",0],["q",0]],["x",0],["w",0]]')
    assert html.match(a, b) == {0: 0, 2: 1, 3: 2, 4: 5}


def test_archive_is_a_zip_and_reads_by_ranges():
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    writer.open(warc.DATA)
    blob = warc.record(5, "http://h/\r\nx", b"hello", hashlib.sha1(b"hello").hexdigest(), "response", None)
    writer.write(blob)
    writer.close_member()
    writer.open(warc.INDEX)
    writer.write(b"5 0 %d\n" % len(blob))
    writer.close_member()
    writer.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.read(warc.DATA) == blob and z.testzip() is None
    archive = warc.Archive(lambda at, n: data[at : at + n], len(data))
    at, size = archive.stored_at(warc.DATA)
    headers, payload = warc.parse(data[at : at + size])
    assert payload == b"hello" and headers["WARC-Type"] == "response"


def test_reads_other_zips():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "stored", zipfile.ZIP_STORED)
        z.writestr("ä.txt", "packed", zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    archive = warc.Archive(lambda at, n: data[at : at + n], len(data))
    at, size = archive.stored_at("a.txt")
    assert data[at : at + size] == b"stored" and "ä.txt" in archive.members
    with pytest.raises(ValueError):
        archive.stored_at("ä.txt")
    with pytest.raises(ValueError):
        warc.Archive(lambda at, n: b"no zip"[at : at + n], 6)


def test_records_of_odd_pages(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "u", big, "a"), (2, None, big, "b"), (3, "u", None, "c"), (4, "u", "", "d"), (5, "u", "é" * 400, "e"), (6, "u", "é" * 400, "f"), (2, None, big, "b"), (None, "u", big, "g")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(table).collect())
    n = len(big)
    assert got == [(0, n, "response", None), (1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 800, "response", None), (6, 800, "response", None)]
    assert warc.archive_pages(table.limit(0)).count() == 0
    small = warc.write_archives(table, warc.new_folder(spark, "t"), archive_bytes=1)
    assert small.count() == len(rows) and warc.read_archives(small, block=1).count() == len(rows)


def test_filters_as_of_fetch_time(spark):
    log = [("Example.com", "domain", "a", "2024-01-10", "add"), ("example.com", "domain", "a", "2024-02-10", "remove"), ("example.com", "domain", "a", "2024-02-10", "add"), ("example.com", "domain", "a", "2024-03-10", "add"), ("h.net/x", "prefix", None, "2024-01-01", "add"), ("h.net", "host", "z", None, "add"), (None, "host", "z", "2024-01-01", "add")]
    entries = spark.createDataFrame(log, "entry string, kind string, category string, t string, action string").selectExpr("entry", "kind", "category", "cast(t as date) listed_at", "action")
    urls = [("http://a.b.example.com/q", "2024-01-09"), ("http://a.b.example.com/q", "2024-01-10"), ("http://A.b.example.com./q", "2024-02-10"), ("http://example.com", "2024-03-11"), ("https://u@h.net:8/x/y?z", "2024-05-05"), ("https://h.net/xx", "2024-05-05"), (None, "2024-05-05"), ("nonsense", "2024-05-05"), ("http://example.com", None), ("http://example.com", "2024-03-11")]
    captures = spark.createDataFrame([(k, u, t, "n_entries") for k, (u, t) in enumerate(urls)], "page_id int, url string, t string, n_entries string").selectExpr("page_id", "url", "cast(t as date) fetched_at", "n_entries")
    got = {r["page_id"]: (r["blocked"], r["categories"]) for r in urlfilter.filter_urls(captures, entries).collect()}
    assert got == {0: (False, ""), 1: (True, "a"), 2: (False, ""), 3: (True, "a"), 4: (True, ""), 5: (False, ""), 6: (False, ""), 7: (False, ""), 8: (False, ""), 9: (True, "a")}
    assert urlfilter.filter_urls(captures.limit(0), entries).count() == 0 and urlfilter.filter_urls(captures, entries.limit(0)).where("blocked").isEmpty()
