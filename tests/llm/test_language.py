import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.llm import language as L
from dyadica.llm.language import address_parts, fit_trigrams, identify, read_page, weighed_parts
from dyadica.llm.queries import op2_language


@pytest.fixture(scope="module")
def model(spark):
    return fit_trigrams(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_query_finds_the_language_of_every_page(spark):
    rows = op2_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    assert np.mean([r.lang == r.declared for r in rows]) >= 0.99
    assert np.mean([r.text_lang == r.declared for r in rows]) >= 0.97


def test_reading_pages():
    page = '<html lang="de-AT"><script>var t="</p>";</script><nav>menu <b>x</b></nav><div class="ad">buy <div>now</div></div><p>Der gro&szlig;e Text steht hier und ist lang genug um zu bleiben'
    text, declared = read_page(page)
    assert declared == "de" and text.split()[:2] == ["Der", "große"] and "menu" not in text and "now" not in text and "var" not in text
    assert read_page("") == ("", "") and read_page("<" * 50_000)[1] == "" and read_page("<a" * 50_000)[1] == ""
    assert "menu" in read_page("<nav>menu</nav>")[0]


def test_addresses(spark):
    urls = ["https://www.a.co.uk/x", "http://u@b.example.com:80/", "//nothing", None, "ftp://LOCAL"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = [tuple(r) for r in df.select(*address_parts(F.col("url"))).collect()]
    assert rows == [("www.a.co.uk", "a.co.uk", "uk"), ("b.example.com", "example.com", "com"), ("", "", ""), ("", "", ""), ("local", "local", "local")]


def test_priors_decide_where_the_text_does_not(spark, docs, model):
    languages, chances = model
    german = docs.filter("lang = 'de' and n_chars > 300").select("text").limit(12).collect()
    pages = [(k, f"http://zeitung.example.de/{k}", f"<html lang='de'><p>{r.text}</p>") for k, r in enumerate(german)]
    pages += [(100, "http://zeitung.example.de/x", "<html><p>3 4 5</p>"), (101, None, None)]
    english = docs.filter("lang = 'en' and n_chars > 300").select("text").limit(40).collect()
    pages += [(200 + k, f"http://news.example.com/{k}", f"<html lang='en'><p>{r.text}</p>") for k, r in enumerate(english)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in identify(df, languages, chances, ["page_id"]).collect()}
    assert all(got[k].lang == "de" for k in range(len(german))) and all(got[200 + k].lang == "en" for k in range(len(english)))
    assert got[100].lang == "de" and got[101].confidence < got[100].confidence < got[0].confidence


def test_edge_rows(spark, model):
    languages, chances = model
    rows = [(None, None, None, "h"), (1, "", "", "x"), (1, "", "", "x"), (2, "http://[bad", "<p>" + "the and of " * 9000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("lang", F.lit("?"))
    got = identify(df, languages, chances, ["page_id"]).collect()
    assert len(got) == 4 and all(0 < r.confidence <= 1 for r in got)
    assert identify(df.filter("false"), languages, chances, ["page_id"]).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none, table = fit_trigrams(empty)
    assert none == []
    assert [r.lang for r in identify(df, none, table, ["page_id"]).collect()] == [None] * 4


def test_rare_languages_stay_in_large_tables(spark, monkeypatch):
    from dyadica.llm import language

    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 20, raising=False)
    monkeypatch.setattr(language, "LANGUAGE_DOCUMENTS", 10, raising=False)
    rows = [(k, f"text number {k} of the common kind", "en" if k % 2 else None) for k in range(4000)]
    rows += [(5000 + k, f"ein seltener Satz {k}", "de") for k in range(3)] + [(6000, "unique", "xx")]
    languages, chances = fit_trigrams(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == ["de", "en", "xx"] and chances.shape[0] == 3


def test_no_text_of_a_page_is_lost():
    body = "Der lange Text dieser Seite steht ganz in einem Formular und hat viele Buchstaben darin"
    rest = "<p>" + "forty letters stand elsewhere on the page of this kind</p>"
    for open_, close in (("<form>", "</form>"), ("<div class='page with-sidebar'>", "</div>"), ("<header>", "</header>"), ("<form>", "")):
        page = f"<html>{rest}{open_}<p>{body}</p>{close}"
        assert body in read_page(page)[0], open_
    running, aside, _ = weighed_parts(f"<nav>{body[:30]}</nav><p>{body}</p><script>{body}</script>")
    assert body in running and body[:30] in aside and (running + aside).count(body) == 1


def by_hand(pages, languages, chances):
    """The posterior of every page, page by page in plain Python."""
    n, rows = len(languages), []
    for i, url, page in pages:
        body, aside, declared = weighed_parts(page or "")
        z = np.zeros(n)
        for t, w in ((body, 1.0), (aside, L.ASIDE_WEIGHT)):
            for slot in L.slots_of(t):
                z += L.TEMPER * w * chances[:, slot]
        z -= z.max()
        chance = np.exp(z) / np.exp(z).sum()
        vote = (n * chance.max() - 1) / (n - 1)
        host = (url or "").split("//")[1].split("/")[0] if "//" in (url or "") else ""
        rows.append((i, z, chance * vote, vote, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared))
    total = sum(r[2] for r in rows)
    prior = (total + L.ADD) / (total.sum() + L.ADD * n)
    everything, out = max(total.sum(), 1.0), {}
    for i, z, votes, vote, host, domain, suffix, declared in rows:
        log = z.copy()
        for at, value in ((6, suffix), (7, declared)):
            own = sum(r[2] for r in rows if r[at] == value)
            share = own.sum() / everything + 1e-9
            log += np.log((own + L.STRENGTH * share) / (total + L.STRENGTH))
        level = prior
        for at, value in ((5, domain), (4, host)):
            own = sum(r[2] for r in rows if r[at] == value) - votes
            count = sum(r[3] for r in rows if r[at] == value) - vote
            level = (own + L.STRENGTH * level) / (count + L.STRENGTH)
        log += np.log(np.maximum(level, 1e-12))
        p = np.exp(log - log.max())
        out[i] = (languages[int(np.argmax(log))], p.max() / p.sum())
    return out


def mixed_pages(docs, every=1):
    """Pages of labelled documents, whose declarations and hosts are right only mostly."""
    rows, pages, truth = docs.filter("lang is not null and n_chars > 120").orderBy("doc_id").collect(), [], {}
    for k, r in enumerate(rows[::every]):
        said = ("en", "de", "", "fr", None)[k % 5] if k % 6 == 0 else r.lang
        tag = "" if said is None else f" lang='{said}'"
        host = f"{'www.' if k % 3 else ''}site{k % 9}.{('com', 'org')[k % 2] if k % 4 else r.lang}"
        pages.append((k, f"https://{host}/{k}", f"<html{tag}><nav>Home menu</nav><p>{r.text}</p>"))
        truth[k] = r.lang
    return pages, truth


def test_posterior_by_hand_with_truth_from_the_documents(spark, model):
    languages, chances = model
    pages, truth = mixed_pages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 6)
    pages += [(9001, None, None), (9002, "https://site1.com/x", "<p>12 34</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = by_hand(pages, languages, chances)
    got = {r.page_id: (r.lang, r.confidence) for r in identify(df, languages, chances, ["page_id"]).collect()}
    assert got.keys() == want.keys()
    for i, (name, sure) in want.items():
        assert got[i][0] == name and got[i][1] == pytest.approx(sure, rel=1e-9)
    assert np.mean([got[i][0] == t for i, t in truth.items()]) >= 0.98


def test_more_languages_than_two_hundred(spark):
    rows = [(k, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)}{chr(0x4E00 + k)} word", f"x{k}") for k in range(230)]
    languages, chances = fit_trigrams(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(languages) == 230 and chances.shape == (230, L.SLOTS)
