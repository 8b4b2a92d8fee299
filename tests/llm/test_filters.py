"""URL filters, HTML extraction, language identification, WARC."""

import hashlib

import pytest

from tessera.llm import html_text, language, url_filter, warc
from tessera.llm.shared import work_path

from .. import oracles
from . import fixtures


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if "/" in rule and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0,), (len(rule), rule, verdict))
    return host, path, best[1] if best else None, best[2] if best else "allow"


RULES = [*url_filter.RULES, ("block", "a.b.example.net/en/x"), ("allow", "xample.net/"), ("block", "uk/")]
URLS = [
    "http://x.net/", "https://A.B.Example.NET/en/x1?q=/de/", "http://example.net", "http://example.net/en/", "http://notexample.com/de/",
    "http://sub.example.com/de/a#b", "http://example.com/fr/",
    "ftp://z.org/fr/x", "http://org/fr/", None, "", "no scheme", "http://", "http:///path", "http://net", "http://a..net/",
    "http://u@x.net:80/", "x://y://z.net/", "http://é.net/" + "p" * 5000, "http://x.co.uk/", "http://x.net/", "http://a.net\n.org/fr/",
]


def test_urls_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_URLS", 3)  # many sweeps
    monkeypatch.setattr(url_filter, "URLS_PER_RULE", 1)
    rows = [(k if k % 4 else None, u) for k, u in enumerate(URLS)] * 2
    df = fixtures.with_extras(spark.createDataFrame(rows, "page_id long, url string"), "host", "path", "key", "kind", "rule")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df,
        url_filter.rules_frame(spark, RULES)).collect()), key=repr)
    assert got == sorted(((i, *brute(u, RULES)) for i, u in rows), key=repr)


def test_no_urls_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, url_filter.rules_frame(spark, RULES)).isEmpty()
    some = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filter.filter_urls(some, url_filter.rules_frame(spark, [])).first()["verdict"] == "allow"


def test_ties_of_rules(spark):
    """The same rule as allow and block is block; of equal lengths the longer host wins."""
    rules = url_filter.rules_frame(spark, [("allow", "a.org/"), ("block", "a.org/"), ("allow", "b.org/xyz"), ("block", "z.b.org/x")])
    urls = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://z.b.org/xyz")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(urls, rules).collect()} == {1: ("a.org/", "block"),
        2: ("z.b.org/x", "block")}


def test_url_plan_has_no_python(spark):
    df = url_filter.op1_url_filters(spark, oracles.SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_urls_equal_sql(spark):
    oracles.same(spark, url_filter.op1_url_filters, url_filter.SQL)


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Title &amp; more</h1><span>By A</span></header><p>First   paragraph
with <b>bold</b>&nbsp;text.<br>next<p>Second one that is unclosed<div class="ad">Buy!</div><ul><li>item<li>item two</ul><p>Short.</p><form>Name <input></form></article>
<aside>Related</aside><section id="comments"><p>A long reader comment, longer than anything else on this page, really.</p></section><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph with bold text. next\n\nSecond one that is unclosed\n\nitem\n\nitem two\n\nShort."


def test_pages_without_article():
    body = "<body class=has-sidebar><div class=layout><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div id=main-text>" + "".join(f"<p>Paragraph {k} has a fair number of words in it, as text does.</p>" for k in range(6)) + "<p>End.</p></div><div class=sidebar>See also</div></div></body>"
    text = html_text.main_text(body)
    assert text.split("\n\n")[0].startswith("Paragraph 0") and text.endswith("End.") and "Two" not in text and "See also" not in text
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<nav>only</nav>") == ""
    assert html_text.main_text("<p>open <script>never closed") == "open"
    assert len(html_text.main_text("<article>" + "<div>" * 3000 + "x" * 100_000)) == 100_000


def test_extract_pages(spark):
    df = fixtures.with_extras(spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)],
        "page_id long, url string, html string"), "text", "n_chars")
    rows = html_text.extract_pages(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, rows[0]["n_chars"], rows[0]["n_chars"]] and len(rows) == 3
    assert html_text.extract_pages(df.limit(0)).isEmpty()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "lang AS truth")
    got = language.identify_documents(held, model).join(held.select("doc_id", "truth"), "doc_id")
    n, right, kept = got.selectExpr("count(*)", "sum(CAST(lang = truth AS INT))", "sum(CAST(accepted AS INT))").first()
    assert right / n > .97 and kept / n > .99


def test_evidence_decides_where_text_does_not(spark):
    rows = [(k, "the of and to in is that " * 5, "en", "a.example", 0) for k in range(30)] + [(100 + k,
        "der die und das ist nicht ein " * 5, "de", "b.example", 0) for k in range(30)]
    rows += [(200, "", "de", "a.example", 0), (201, None, None, "b.example", 0), (202, "12345 67890 " * 5, "de", "b.example", 0),
        (203, "\u0001\u0002\u0003" * 200, "en", "a.example", 0)]
    df = fixtures.with_extras(spark.createDataFrame(rows, fixtures.SCHEMA), "ll", "prior")
    got = {r["doc_id"]: r for r in language.identify_documents(df, language.train(df.where("doc_id < 200"))).collect()}
    assert got[0]["lang"] == "en" and got[100]["lang"] == "de"
    assert got[201]["lang"] == "de" and got[202]["lang"] == "de"  # the host's prior, the declaration
    assert not got[203]["accepted"] and len(got) == 64
    assert language.identify_documents(df.limit(0), language.train(df)).isEmpty()
    assert {r["lang"] for r in language.identify_documents(df, language.train(df.limit(0))).collect()} == {"none"}


def test_every_declared_language_counts(spark):
    names = [f"{a}{b}" for a in "abcdefg" for b in "klmnopqrst"]  # 70, each of an alphabet of its own
    text = lambda k: "".join(chr(0x4E00 + 40 * k + j) for j in range(40)) * 4
    rows = [(10 * k + j, text(k), x, "a.example", 0) for k, x in enumerate(names) for j in range(5)]
    rows += [(5000 + j, text(200), "fi", "a.example", 0) for j in range(3)] + [(5010, "\u0001\u0002\u0003" * 200, None, "a.example", 0),
        (5011, "\u0001\u0002\u0003" * 200, "ak", "a.example", 0)]
    df = fixtures.frame(spark, rows)
    model = language.train(df.where("doc_id < 5010"))
    assert model[0] == sorted(names)
    got = {r["doc_id"]: r for r in language.identify_documents(df, model).collect()}
    assert all((got[i]["lang"], got[i]["accepted"]) == (x, True) for i, _, x, *_ in rows if i < 5010)
    assert got[5000]["confidence"] is None and got[5000]["text_lang"] == "none" and not got[5010]["accepted"] and not got[5011]["accepted"]


def test_archives_round_trip(spark):
    big, small = "<p>" + "same " * 50, "<p>tiny"
    rows = [(5, "http://a/", big), (2, "http://b/", big), (9, None, big), (3, "c", small), (4, "d", small), (7, "e", None),
        (None, "f", big), (11, "g\r\nX: y", "é" * 5000), (2, "http://b/", big)]
    df = fixtures.with_extras(spark.createDataFrame(rows, "page_id long, url string, html string"), "_first", "_digest", "archive")
    manifest = warc.write_warc(df, work_path(spark, "t"))
    got = warc.read_warc(manifest).collect()
    assert len(got) == len(rows) and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[5]["refers_to"] == 2 and by[9]["record_type"] == "revisit" and by[None]["refers_to"] == 2 and by[2]["record_type"] == "response"
    assert by[3]["record_type"] == by[4]["record_type"] == "response" and by[7]["payload_bytes"] == 0
    assert by[5]["payload_bytes"] == len(big) and by[5]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and by[11]["payload"] == "é" * 5000
    assert warc.read_warc(warc.write_warc(df.limit(0), work_path(spark, "t"))).isEmpty()


def test_archive_bytes():
    import struct

    import zstandard as zstd

    one, other = (warc.parse_record(warc.record_bytes("response", "u", "1", b"<p>", 3, "d", None, None, "2020-01-01T00:00:00Z")) for _ in "ab")
    assert one[0]["WARC-Record-ID"] != other[0]["WARC-Record-ID"] and one[1].startswith(b"HTTP/1.1 200 OK\r\n") and one[1].endswith(b"\r\n\r\n<p>")
    records = [warc.record_bytes("response", f"u{k}", str(k), b"payload %d" % k * 20, 0, "d", None, None, "2020-01-01T00:00:00Z") for k in range(50)]
    raw = warc.write_archive(records)
    assert list(warc.read_archive(raw)) == records
    magic, n = struct.unpack_from("<II", raw)
    assert 0x184D2A50 <= magic <= 0x184D2A5F and raw[8 + n : 12 + n] == warc.FRAME
    assert zstd.frame_content_size(raw[8 + n :]) == len(records[0])
    with pytest.raises(ValueError):
        list(warc.read_archive(raw[8 + n :]))


def test_warc_equals_sql(spark):
    oracles.same(spark, warc.op8_warc, warc.SQL)
