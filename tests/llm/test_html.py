"""HTML extraction on pages of many layouts, against text marked by hand."""

import numpy as np
import pytest

from tessera.llm import html_text

from . import fixtures

LONG = [
    "The harbour was quiet that morning, and the boats that had come in overnight lay low in the water under their loads of timber and salt.",
    "Nobody on the quay could say when the ferry would leave, since the captain had gone up to the town to see about the papers for the crew.",
    "By noon the wind had turned, the sails were drying, and the clerk at the customs house had begun to count the barrels for the third time.",
    "It was, as the old pilot said, a day on which nothing would happen, and that was exactly what the people of the harbour had hoped for.",
]
SHORT = "So it was."
TITLE = "A quiet day at the harbour"
LINKS = "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(6))


def p(*texts, kind=""):
    return "".join(f"<p{kind}>{t}</p>" for t in texts)


ARTICLE = f"<h1>{TITLE}</h1>" + p(*LONG)
WHOLE = [TITLE, *LONG]
PAGES = {
    "article": (f"<nav><ul>{LINKS}</ul></nav><article>{ARTICLE}</article><footer>(c) 2020</footer>", WHOLE),
    "article with its header": (f"<article><header><h1>{TITLE}</h1><p>Share this</p></header>{p(*LONG)}</article>", WHOLE),
    "main": (f"<header><a href='/'>Home</a></header><main>{ARTICLE}</main><aside>{p('Read this too, it is quite good.')}</aside>", WHOLE),
    "no article": (f"<div><ul>{LINKS}</ul></div><div>{ARTICLE}</div><div><ul>{LINKS}</ul></div>", WHOLE),
    "link lists of divs": ("<div>" + "".join(f"<div><a href='/{k}'>More about item {k}</a></div>" for k in range(8)) + f"</div><div><div>{ARTICLE}</div></div>", WHOLE),
    "nested": (f"<div><div><div>{LINKS}</div><div><section>{ARTICLE}</section></div></div></div>", WHOLE),
    "flat body": ("".join(f"<p><a href='/{k}'>Item {k}</a></p>" for k in range(5)) + p(*LONG) + "".join(f"<p><a href='/{k}'>Old item {k}</a></p>" for k in range(5)), LONG),
    "short paragraphs stay": (f"<nav>{LINKS}</nav><article>{p(SHORT, *LONG[:2], SHORT, *LONG[2:], SHORT)}</article>",
    [SHORT, *LONG[:2], SHORT, *LONG[2:], SHORT]),
    "short ends without article": (f"<ul>{LINKS}</ul><div>{p(SHORT, *LONG, SHORT)}</div>", [SHORT, *LONG, SHORT]),
    "advert inside": (f"<article>{p(*LONG[:2])}<div class='ad'>Buy salt now!</div>{p(*LONG[2:])}</article>", LONG),
    "advert before": (f"<body><div class='ad-banner'>Buy salt now, cheap!</div><div>{ARTICLE}</div></body>", WHOLE),
    "cookie notice": (f"<div id='cookie-notice'><p>We use cookies to make this site better for you.</p><button>OK</button></div><article>{ARTICLE}</article>", WHOLE),
    "reader comments": (f"<div><div>{ARTICLE}</div><div class='comments'>{p(*[x.replace('harbour', 'port') for x in LONG])}</div></div>", WHOLE),
    "comment list in the article": (f"<article>{ARTICLE}<ol class='comment-list'><li class='comment'><p>{LONG[0][::-1]}</p></li></ol></article>", WHOLE),
    "sidebar": (f"<div class='sidebar'><p>Weather: fair.</p><p>Tide: low.</p></div><div class='content'>{ARTICLE}</div>", WHOLE),
    "form": (f"<article>{p(*LONG[:2])}<form><p>Your address: {LONG[2]}</p><input name=a></form>{p(LONG[3])}</article>", [*LONG[:2], LONG[3]]),
    "script and style": (f"<style>p{{}}</style><article>{p(LONG[0])}<script>var a = '<p>no</p>';</script>{p(*LONG[1:])}</article>", LONG),
    "a class of other words": (f"<article>{p(LONG[0])}{p(LONG[1], kind=' class=social-history')}<div id=promotion-policy>{p(LONG[2])}</div><div class=comments-off>{p(LONG[3])}</div></article>", LONG),
    "a class around everything": (f"<div class='sidebar-left'><div>{ARTICLE}</div></div>", WHOLE),
    "a table of words": (f"<div>{p(*LONG[:2])}<table><tr><td>Salt</td><td>12 barrels</td></tr></table>{p(*LONG[2:])}</div>",
    [*LONG[:2], "Salt 12 barrels", *LONG[2:]]),
    "quotes and lists": (f"<article>{p(LONG[0])}<blockquote>{LONG[1]}</blockquote><ul><li>{LONG[2]}</li><li>{SHORT}</li></ul>{p(LONG[3])}</article>", [*LONG[:3], SHORT, LONG[3]]),
    "references and white space": ("<article><p>Fish &amp; chips\n  &lt;3&nbsp;&#233;t&eacute;</p>" + p(*LONG) + "</article>",
    ["Fish & chips <3 été", *LONG]),
    "links within prose": (f"<article>{p(LONG[0], LONG[1].replace('the ferry', '<a href=/f>the ferry</a>'), *LONG[2:])}</article>", LONG),
    "never closed": (f"<nav><ul>{LINKS}</ul></nav><article><p><b>{LONG[0]}<br><p>{LONG[1]}<p>{LONG[2]}", LONG[:3]),
    "share buttons": (f"<article>{ARTICLE}<div class='share-buttons'><a href='#'>Mail</a> Share this</div></article>", WHOLE),
    "nothing but links": (f"<div><ul>{LINKS}</ul></div>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, want = PAGES[name]
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>{TITLE}</title></head><body>{html}</body></html>") == "\n\n".join(want)


def test_the_ratio_decides(monkeypatch):
    """With the same ratio everywhere, what isn't content comes along."""
    names = ["flat body", "advert inside", "comment list in the article", "share buttons", "nothing but links"]
    before = [html_text.main_text(PAGES[x][0]) for x in names]
    monkeypatch.setattr(html_text, "_ratios", lambda lines, share: np.ones(len(lines)))
    after = [html_text.main_text(PAGES[x][0]) for x in names]
    assert [x for x, a, b in zip(names, before, after, strict=True) if a == b] == []


def test_table(spark):
    rows = [(1, "http://a/", PAGES["article"][0]), (1, "http://a/", PAGES["article"][0]), (None, None, None), (2, "", ""),
        (3, "x", "<p>" + "word " * 200_000)]
    df = fixtures.with_extras(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "n_chars")
    got = html_text.extract_pages(df).collect()
    assert sorted((r["page_id"] or 0, len(r["text"]), r["n_chars"]) for r in got) == sorted([(1,
        *[len("\n\n".join(WHOLE))] * 2)] * 2 + [(0, 0, 0), (2, 0, 0), (3, 999_999, 999_999)])
    assert html_text.extract_pages(df.limit(0)).isEmpty()
