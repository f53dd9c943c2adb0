import time
import zlib

import numpy as np

from oddsmith.llm import langid


def test_text_model_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    rows = docs.collect()
    known = spark.createDataFrame([r for r in rows if not held(r)], docs.schema)
    languages, log_p, _ = langid.fit_text_model(known)
    brute = np.full((len(languages), langid.BUCKETS), langid.SMOOTHING)
    for r in rows:
        if not held(r):
            np.add.at(brute[languages.index(r.lang)], langid.gram_buckets(r.text.encode()), 1)
    assert np.allclose(log_p, np.log(brute / brute.sum(axis=1, keepdims=True)), atol=1e-2)
    tested = [r for r in rows if held(r) and len(r.text) > 40]
    right = [languages[log_p[:, langid.gram_buckets(r.text.encode())].sum(axis=1).argmax()] == r.lang for r in tested]
    assert sum(right) / len(right) > 0.97


def test_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = langid.identify(pages.withColumn("lang", pages["url"]), docs).collect()
    assert len(rows) == pages.count() and all(0 < r.confidence <= 1 for r in rows)
    assert sum(r.lang == r.declared for r in rows) / len(rows) > 0.9


def test_evidence_beyond_text(spark):
    docs = spark.createDataFrame([("the and of this", "en")] * 5 + [("der und die das", "de")] * 5 + [(None, "en"), ("x", None)], "text string, lang string")
    html = {"en": "<p>the and of this</p>", "de": "<p>der und die das</p>"}
    rows = [(i, f"http://a.site{i % 2}.{'de' if i % 2 else 'uk'}/x", f'<html lang="{"de" if i % 2 else "en"}">' + html["de" if i % 2 else "en"]) for i in range(40)]
    rows += [(100, "http://b.site1.de/", None), (101, None, '<html lang="de">'), (102, "http://c.other.uk", ""), (103, None, None), (103, None, None), (None, "not an address", "<script>der und</script>"), (104, "http://a.site1.de/x", "the and of this " * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert {i: found[i].lang for i in (100, 101, 102, 104)} == {100: "de", 101: "de", 102: "en", 104: "en"}
    assert found[100].text_lang == "und" and found[100].confidence > found[103].confidence
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {"und"}


def test_text_and_declared():
    page = b'<!-- <html lang="fr"> --><HTML class=x LANG="de-AT"><script>var a = "<p>";</script >gut <b>so</b><style>p</style'
    text, declared = langid.text_and_declared(page)
    assert text.split() == [b"gut", b"so"] and declared == "de"
    assert langid.text_and_declared(b'<meta http-equiv="content-language" content="es">x')[1] == "es"
    assert langid.text_and_declared(b"1 < 2 and 3")[0].split() == [b"1", b"2", b"and", b"3"]
    for bad in (b"<script ", b"<html ", b"<meta content-language ", b"<!-- ", b"</script", b"<", b"<style ><b"):
        start = time.process_time()
        langid.text_and_declared(bad * 200_000)
        assert time.process_time() - start < 5


def test_domains():
    hosts = {"a.b.co.uk": ("b.co.uk", "uk"), "x.site.de": ("site.de", "de"), "10.0.0.1": ("10.0.0.1", ""), "intranet": ("intranet", ""), "co.uk": ("co.uk", "uk"), "": ("", "")}
    assert {h: langid.domain_of(h) for h in hosts} == hosts


def test_many_suffixes_and_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    monkeypatch.setattr(langid, "AT_ONCE", 2)
    docs = spark.createDataFrame([("the and of this", "en")] * 5 + [("der und die das", "de")] * 5 + [(f"zq{i}zq", f"x{i}") for i in range(6)], "text string, lang string")
    assert langid.fit_text_model(docs)[0] == ["de", "en", "other"]
    pages = spark.range(10_050).selectExpr("id as page_id", "concat('http://a.t', id, '/x') as url", "'the and of this' as html")
    rows = langid.identify(pages, docs)
    assert rows.where("lang = 'en'").count() == 10_050 and rows.select("suffix").distinct().count() == 10_050


def test_language_behind_a_long_attribute():
    long = b"x" * 500_000
    assert langid.text_and_declared(b"<html data-x='" + long + b"' lang='fr'>le")[1] == "fr"
    assert langid.text_and_declared(b"<meta data-x='" + long + b"' http-equiv='content-language' content='de'>der")[1] == "de"
