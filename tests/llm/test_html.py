from itertools import product

import numpy as np
import pytest

from cratewise.llm import html
from cratewise.llm.queries import op8_html_crf

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return html.fit(html.labelled_pages())


def test_held_out_labelled_pages(model):
    wrong = total = 0
    for page, labels in html.labelled_pages(150, seed=9):
        found = model.decode(html.blocks(page, model.paths))
        wrong += sum(a != bool(b) for a, b in zip(found, labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_given_pages(spark):
    """In these pages the article element is the main text."""
    paths = html.Paths()
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        want[r.page_id] = "\n".join(b.text for b in html.blocks(r.html, paths) if "in article" in paths.features[b.path])
    got = op8_html_crf(spark, FOLDER).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_other_layouts(model):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><div class='logo'>My Site</div><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice">We use cookies.</div><main><h1>Title</h1><p>Para <b>one</b>&nbsp;is&#32;here &amp; there.<script>"</p>"</script> More<br>text.<p>Unclosed two.
    <aside><p>About other things.</p></aside><p>Para three.</p><form><label>Email</label><input></form><section id="comments"><h2>Comments</h2><p>Nice article, thanks a lot.</p></section></main>
    <div class="sidebar"><p>Read this too.</p></div><footer>&copy; 2020 Us</footer></body></html>"""
    assert model.text(page) == "Title\nPara one is here & there. More text.\nUnclosed two.\nPara three."


def test_broken_markup():
    paths = html.Paths()
    text = lambda page: [b.text for b in html.blocks(page, paths)]
    assert text("") == text("<p> \n </p>") == text("<!-- never closed") == text("<script>x") == []
    assert text("a < b <p>c</i></div><li>d<li>e &am") == ["a < b", "c", "d", "e &am"]
    assert text("<p>x</p><p cla") == ["x"]
    assert text("<table><tr><td>1<td>2<tr><td>3</table><div title='a>b'>q</div>") == ["1", "2", "3", "q"]
    assert text("<p>İ</p><script>no</SCRIPT><p>y") == ["İ", "y"]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    model = html.Model({f"words {k}": float(rng.normal()) for k in range(8)}, rng.normal(size=(2, 2)).tolist(), 0.4)
    page = [html.Block(0, "w " * int(n), 0) for n in rng.integers(1, 60, 8)]
    emit = [sum(model.weights.get(f, 0) for f in html.text_features(b)) for b in page]

    def value(path):
        return path[0] * model.start + sum(e * s for e, s in zip(emit, path)) + sum(model.transitions[a][b] for a, b in zip(path, path[1:]))

    assert value([int(x) for x in model.decode(page)]) == pytest.approx(max(value(p) for p in product((0, 1), repeat=8)))


def test_edge_cases(spark, folder_of):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text alone"), (4, "u", "<article>" + "<p>long paragraph here.</p>" * 20_000 + "</article>"), (4, "u", "<p>repeated"), (None, "u", "<p>x"), (5, "u", "<nav><ul><li><a href=/>Home</a></ul></nav>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in op8_html_crf(spark, folder_of(pages=pages)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].text == got[2].text == got[5].text == "" and got[2].url is None
    assert got[4].text.count("long paragraph here.") == 20_000
    assert op8_html_crf(spark, folder_of(pages=pages.limit(0))).count() == 0


def test_only_scripts_styles_and_form_controls_are_silent(model):
    page = """<html><body><main><h1>Title of it</h1><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> as known to all readers of this page.</p>
    <p>Some long words before. <audio>fallback words</audio> <noscript>plain words</noscript> And some long words after that.</p></main></body></html>"""
    found = [b.text for b in html.blocks(page, html.Paths())]
    assert found == ["Title of it", "Energy is E=mc as known to all readers of this page.", "Some long words before. fallback words plain words And some long words after that."]
    assert [b.text for b in html.blocks("<p>a<button>b</button><style>c</style><template><p>d</p></template>e</p>", html.Paths())] == ["ae"]


def test_many_unclosed_controls_take_no_square_time():
    import time

    started = time.perf_counter()
    assert len(html.blocks("<p>x<button>" * 20_000, html.Paths())) == 20_000
    assert time.perf_counter() - started < 2
