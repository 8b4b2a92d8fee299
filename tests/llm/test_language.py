"""Language identification against the formula worked out row by row, for documents and for pages."""

import collections
import html
import math

import numpy as np
import pytest

from tessera.llm import language

from . import fixtures


def brute(rows, langs, logs):
    """rows: (id, text, declared, host) -> id: (text_lang, lang, confidence, accepted)."""
    names, k, table = [*langs, language.NONE], len(langs) + 1, logs.astype(np.float32)
    prior = [(1 - language.NONE_PRIOR) / len(langs)] * len(langs) + [language.NONE_PRIOR]
    first = lambda v: names[max(range(k), key=lambda j: (v[j], -j))]
    likelihood, by_text = [], []
    for _, text, _, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        at = language.buckets_of(raw, np.array([0, len(raw)]))
        likelihood.append([float(table[j][at].sum(dtype=np.float64)) * language.TEMPER for j in range(k)])
        by_text.append(first([x + math.log(p) for x, p in zip(likelihood[-1], prior, strict=True)]))

    def smoothed(counts, above):
        whole = sum(counts.values())
        return [(counts[x] + language.PRIOR_WEIGHT * p) / (whole + language.PRIOR_WEIGHT) for x, p in zip(names, above, strict=True)]

    root = smoothed(collections.Counter(by_text), prior)
    levels = [collections.defaultdict(collections.Counter) for _ in range(3)]
    parts = lambda h: (h.split(".")[-1], ".".join(h.split(".")[-2:]), h)
    for (_, _, _, host), x in zip(rows, by_text, strict=True):
        for level, key in zip(levels, parts(host), strict=True):
            level[key][x] += 1
    seen = collections.Counter((d, x) for (_, _, d, _), x in zip(rows, by_text, strict=True) if d in langs)
    out = {}
    for (i, _, declared, host), own, x in zip(rows, likelihood, by_text, strict=True):
        above = root
        for level, key in zip(levels, parts(host), strict=True):
            above = smoothed(level[key], above)
        total = list(own)
        for j, t in enumerate(names):
            if declared in langs:
                whole = sum(seen[d, t] for d in langs) + language.DECLARED_SMOOTH * len(langs)
                total[j] += math.log((seen[declared, t] + language.DECLARED_SMOOTH) / whole)
            total[j] += math.log(above[j])
        lang, confidence = first(total), 1 / sum(math.exp(v - max(total)) for v in total)
        if lang == language.NONE and declared is not None and declared not in langs:
            out[i] = (x, declared, None, True)
        else:
            out[i] = (x, lang, round(confidence, 6), lang != language.NONE and confidence >= language.ACCEPT)
    return out


TEXTS = {"en": "the of and to in is that it was for ", "de": "der die und das ist nicht ein auch mit sich ",
    "fr": "le la les et est une dans que pour des "}


def documents():
    rows = []
    for n, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        for k in range(25):
            body = " ".join(words[(k * j + n) % len(words)] for j in range(3 + k))
            rows.append((100 * n + k, body, ["en", "de", "fr"][(n + (k % 9 == 0)) % 3] if k % 7 else None,
                f"{'abc'[k % 3]}.{['x', 'y'][k % 2]}.{['org', 'de', 'fr'][n]}", 0))
    rows += [(900, "", "de", "a.x.de", 0), (901, None, None, "", 0), (902, None, "fi", None, 0),
        (903, "\u0001\u0002" * 300, "en", "a.x.org", 0), (904, "\u0001\u0002" * 300, "fi", "a.x.org", 0),
        (905, "the und le " * 9, "EN-us", "b.x.fr", 0)]
    return rows


def told(r):
    return r["text_lang"], r["lang"], None if r["confidence"] is None else round(r["confidence"], 6), r["accepted"]


def test_documents_equal_the_formula(spark):
    rows = documents()
    df = fixtures.frame(spark, rows)
    langs, logs = language.train(df.where("doc_id < 900"))
    want = brute([(i, t or "", None if x is None else x.split("-")[0].lower(), s or "") for i, t, x, s, _ in rows], langs, logs)
    got = {r["doc_id"]: told(r) for r in language.identify_documents(fixtures.with_extras(df, "ll", "prior", "n0"), (langs, logs)).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][3] == want[i][3] and got[i][2] == pytest.approx(want[i][2], abs=2e-5)


def test_pages_equal_the_formula(spark):
    rows = documents()
    model = language.train(fixtures.frame(spark, rows).where("doc_id < 900"))
    pages, plain = [], []
    for k, (i, t, x, s, _) in enumerate(rows):
        head = "" if x is None else f" class=a lang='{x}'"
        pages.append((i, f"https://{s}/p?q" if s else None,
            None if t is None else f"<!DOCTYPE html><HTML{head}><script>der die das</script><!-- le la --><p>{html.escape(t)}</p><b>&amp;{k}</b></HTML>"))
        text = "" if t is None else language._TAGS.sub(" ", pages[-1][2])
        plain.append((i, html.unescape(text), None if x is None or t is None else x.split("-")[0].lower(), s or ""))
    df = fixtures.with_extras(spark.createDataFrame([*pages, (None, None, None)], "page_id long, url string, html string"), "lang", "source", "text")
    want = brute([*plain, (None, "", None, "")], *model)
    got = {r["page_id"]: told(r) for r in language.identify_pages(df, model).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][3] == want[i][3] and got[i][2] == pytest.approx(want[i][2], abs=2e-5)
    assert language.identify_pages(df.limit(0), model).isEmpty()


def test_query(spark):
    got = language.op9_language_id(spark, "/root/testdata/sf0.001")
    n = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("documents", "pages")]
    row = got.selectExpr("count(doc_id)", "count(page_id)", "count(*)", "sum(CAST(accepted AS INT))").first()
    assert (row[0], row[1], row[2]) == (*n, sum(n)) and row[3] > .97 * sum(n)
    both = got.where("doc_id IS NOT NULL").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toDF("doc_id", "truth"), "doc_id")
    assert both.where("lang = truth").count() > .97 * n[0]
