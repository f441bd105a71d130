"""Toxicity, language, HTML: learned or deduced, so checked by held-out accuracy and small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import html, language, toxicity
from lectern.llm.base import held_out

DOCS = "doc_id bigint, text string, lang string, source string, score double, size int"


def test_subwords_know_every_gram():
    code, begin = toxicity.subwords(["ab", "abc"], 1 << 20)
    assert begin.tolist() == [0, 3] and len(code) == 3 + 3 + 2 + 1  # <ab ab> <ab> / <ab abc bc> / <abc abc> / <abc>
    alone, _ = toxicity.subwords(["abc"], 1 << 20)
    assert sorted(alone) == sorted(code[3:])


def test_passages_cover_all_words():
    for n in (0, 1, 5, 6, 7, 20, 21):
        text, start = toxicity.passages(np.array([n]), 6)
        seen = {i for s in start for i in range(s, min(n, s + 6))}
        assert seen == set(range(n))


def _toxic_texts(n, seed, words):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}{c}" for a in "bdfg" for b in "aeou" for c in ("", "lin", "tor", "ren")]
    texts, labels = [], []
    for i in range(n):
        body = list(rng.choice(plain, int(rng.integers(5, 200))))
        if i % 4 == 0:
            body[int(rng.integers(len(body)))] = str(rng.choice(words))
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_finds_unseen_misspellings_in_long_texts():
    texts, labels = _toxic_texts(1500, 1, ["nastyword", "vilething"])
    model = toxicity.train(texts, labels, toxicity.Settings(), 3.0)
    score = toxicity.Scorer(model)
    test, truth = _toxic_texts(200, 2, ["nastyword", "vilething", "nastywrd", "nastywordd"])
    got = np.array(score(test)) >= 0.3
    assert (got == np.array(truth)).mean() > 0.97
    assert score(["", None]) == [0.0, 0.0]


def test_toxicity_query_on_small_and_odd_tables(spark):
    texts, labels = _toxic_texts(200, 3, ["nastyword"])
    rows = [(i, t, None, None, 9.0, 1) for i, t in enumerate(texts)] + [(500, None, None, None, None, None), (501, "", None, None, None, None), (None, "x", None, None, None, None), (0, texts[0], None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and {r.predicted for r in got} == {0, 1}
    assert [r.score for r in got if r.doc_id in (500, 501)] == [0.0, 0.0]
    assert toxicity.accepted(docs, model).columns == docs.columns
    assert 100 < toxicity.accepted(docs, model).count() < len(rows)
    nothing = toxicity.learn(docs, marks.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_grams_by_hand():
    codes, counts = language.grams("Ab a")
    text = " ab a "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            if g.strip() and not (n > 1 and "  " in g) and not (n == 1 and g == " "):
                code = 0
                for c in g:
                    code = code << 21 | ord(c)
                want[code] = want.get(code, 0) + 1
    assert dict(zip(codes.tolist(), counts.tolist())) == want


def test_grams_of_a_long_text_do_not_depend_on_the_cut(monkeypatch):
    text = "the quick brown fox, " * 40
    whole = language.grams(text)
    monkeypatch.setattr(language, "LONG", 7)
    cut = language.grams(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_out_of_place_distance_by_hand():
    p = language.Profiles({"b": [3, 1], "a": [1, 2, 3]}, 3)
    assert p.places[:, :3].tolist() == [[0, 1, 2], [1, -1, 0]]


def test_language_odd_tables(spark):
    rows = [(i, "der und die nicht auch" if i % 2 else "the and of with this", "de" if i % 2 else "en", None, None, None) for i in range(40)]
    rows += [(100, None, "de", None, None, None), (101, "", None, None, None, None), (102, "123 !!", "en", None, None, None), (103, "und nicht " * 5000, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "de" and got[0].lang_pred == "en" and 0 <= got[0].score <= 1
    none = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), none).count() == 0


def test_held_out_fold(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


ARTICLE = "<article><h1>T{0} &amp; x</h1><p>First {0}<br>line <b>bold</b><p>Second{0}</article>"
SITE = "<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><nav><a>Home {0}</a></nav><div class='ad-box'>Buy {0}</div><div id=cookieNotice>We use {0}</div>" + ARTICLE + "<div class='user comments'><p>nice {0}</p></div><aside>Side {0}</aside><form>Search {0}</form><footer>&copy; {0}</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}", SITE.format(i)) for i in range(8)]
    rows += [(20, "http://b.example/1", "<p>only"), (21, None, "<div>x &lt; y<script>open"), (22, "http://c.example/", None), (23, "no url", ""), (24, "http://a.example/other", "<body><p>other page</p></body>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_main_text(spark, pages):
    got = {r.page_id: r for r in html.main_text(pages.withColumn("text", F.lit("clash"))).collect()}
    for i in range(8):
        assert got[i].text == f"T{i} & x\nFirst {i} line bold\nSecond{i}"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (20, 21, 22, 23, 24)] == ["only", "x < y", "", "", "other page"]
    assert html.main_text(pages.limit(0)).count() == 0


def test_template_nests_valid_classes(pages):
    found = html.templates(pages).where("host = 'a.example'").collect()
    assert {r.depth for r in found} >= {0, 1, 2, 3} and all(r.pages >= 4 for r in found)


def test_deeply_nested_page_is_linear():
    page = html.Page("<div>" * 20_000 + "deep" + "</div>" * 20_000)
    assert page.text(None) == "deep"
    assert len(page.roles()[0]) == 20_001


def test_classes_decide_what_is_template(spark):
    def page(i, body):
        notice = "<div class='zq'><p>Stands alike</p></div>" if i % 5 < 3 else ""  # on six pages of ten
        shared = "<p>A sentence that many articles share</p>" if i % 5 in (0, 1, 4) else ""
        return f"<body><ul class='x1'><li>Home<li>About</ul>{notice}<div class='x2'><h2>T{i}</h2>{body}{shared}</div><div class='x3'>Made by us</div></body>"

    rows = [(i, f"http://a.example/{i}", page(i, f"<p>Text {i}</p>")) for i in range(10)]
    rows += [(20 + i, f"http://a.example/copy{i}", page(0, "<p>Text 0</p>")) for i in range(30)]  # the same bytes: one page of the template
    rows += [(60 + i, f"http://b.example/{i}", "<div><p>Alike</p></div>") for i in range(9)] + [(70, "http://b.example/x", "<div><p>Alike</p><p>more</p></div>")]  # two different pages
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i in range(10):
        assert got[i].split("\n") == [f"T{i}", f"Text {i}"] + ["A sentence that many articles share"] * (i % 5 in (0, 1, 4))
    assert {got[20 + i] for i in range(30)} == {got[0]}
    assert {got[60 + i] for i in range(9)} == {"Alike"} and got[70] == "Alike\nmore"


@pytest.mark.parametrize("n", [1, 2, 8])
def test_title_and_lead_beside_a_body_stay(spark, n):
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>Title {i}</h1><p>Lead {i}</p><div class='body'>{'long text ' * 100}{i}</div></article></body>") for i in range(n)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nLead {i}\n{'long text ' * 100}{i}" for i in range(n)}


@pytest.mark.parametrize("source, text", [
    ("<p>long paragraph <span class='related'>see also</p><p>next</p>", "long paragraph\nnext"),
    ("<p>long <span class='related'>see <b>also</b><p>next", "long\nnext"),
    ("<p>text <button>Subscribe</button> more</p>", "text more"),
    ("<p>text<a class='ad'>Buy</a>more <i>still</i></p>", "text more still"),
    ("<div>a <select><option>x<option>y</select> b</div>", "a b"),
    ("<div>a <span class='ad'><p>Buy</p> now</span> b<p>c</p></div>", "a\nb\nc"),
    ("<div class='ad'>x <b>y</b><p>z</p></div>w", "w"),
])
def test_inline_elements_that_are_something_else(source, text):
    assert html.Page(source).text(None) == text
