import itertools
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from claritas.llm import wrappers as R

PAGE = """<html><head><title>T</title></head><body class="single comments-open"><div class="page with-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">menu</a></ul></nav><main><article class="post"><header><h1>Title &amp; more {k}</h1></header>
<p>One<br>two <b>bold</b><script>x("</p>")</script> three {k}<p>Second <a href=x>link</a> &lt;para&gt;{extra}<div class="share-buttons">Share</div><aside>no</aside>
<form>f<input></form><p>Read our other stories today</p><section id="comments"><p>nice</p></section></article></main><div id="sidebar">side</div></div><footer>foot &copy;"""


def page(k, extra=""):
    return PAGE.replace("{k}", str(k)).replace("{extra}", extra)


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in pages], "page_id bigint, url string, html string, _html string, host string")


def test_template_wording_goes_after_enough_pages(spark):
    pages = [(k, f"http://A.example/{k}", page(k, "<ul><li>a<li>b</ul>" if k % 2 else "")) for k in range(9)] + [(100 + k, f"https://few.example/{k}", page(k)) for k in range(3)]
    pages += [(200, None, "<p>plain"), (201, "nonsense", None), (202, "http://a.example/z", ""), (203, "http://x.example/", "<p>a<p>b"), (203, "http://x.example/", "<p>a<p>b")]
    pages.append((204, "http://long.example/", "<p>word " * 20_000))
    got = R.extract(rows(spark, pages), ["page_id", "url", "host"]).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "Title & more 3\n\nOne two bold three 3\n\nSecond link <para>\n\na\n\nb\n\nRead our other stories today"
    assert text[101].endswith("Second link <para>\n\nRead our other stories today") and text[200] == "plain"
    assert (text[201], text[202], text[203]) == ("", "", "a\n\nb") and text[204].count("\n\n") == 19_999
    assert R.extract(rows(spark, []), ["page_id"]).collect() == []


def test_wording_in_the_flow_stays_and_constant_boxes_go():
    wrapper, source = R.Wrapper(), "<body><article><h2>Ingredients</h2><p>text {k}<div class=zz>Tell your <b>friends</b></div><section><h3>Steps</h3><p>step {k}</section><p>more {k}</article>"
    for k in range(9):
        wrapper.take(R.Page(source.replace("{k}", str(k))))
    template = set(wrapper.template())
    assert R.main_text(R.Page(source.replace("{k}", "new")), template) == "Ingredients\n\ntext new\n\nSteps\n\nstep new\n\nmore new"
    assert [r[:3] for r in wrapper.rules["/body/article"]] == [["h2", 1, 1], ["p", 1, 1], ["div", 1, 1], ["section", 1, 1], ["p", 1, 1]]


RENAMED = """<body><div class="q1"><ul><li>Home<li>News<li>Contact us</ul></div><div class="q2"><div class="q3"><h1>Title {k}</h1><p>text {k}<h2>Background</h2><p>more {k}</div>
<div class="q4"><h4>Popular now</h4><p>Ten ways to save</div></div><section class="q5"><p>We use small files to make this site work.</section></body>"""


def test_renamed_furniture_is_known_by_the_wrapper(spark, monkeypatch):
    monkeypatch.setattr(R, "WORDS", set())
    monkeypatch.setattr(R, "ROLES", set())
    pages = [(k, f"http://many.example/{k}", RENAMED.replace("{k}", str(k))) for k in range(9)] + [(50, "http://lone.example/", RENAMED)]
    text = {r["page_id"]: r["text"] for r in R.extract(rows(spark, pages), ["page_id"]).collect()}
    assert all(text[k] == f"Title {k}\n\ntext {k}\n\nBackground\n\nmore {k}" for k in range(9))
    assert "Contact us" in text[50] and "small files" in text[50]  # one page tells nothing of its template


def test_long_alternating_pages_align():
    start = time.monotonic()
    a = R.folded([(i, "") for k in range(10_000) for i in ("p", "h2")])
    b = R.folded([(i, "") for k in range(10_000) for i in (("p", "h2") if k % 7 else ("h2", "p", "ul"))])
    rule = R.align(a, b)
    assert time.monotonic() - start < 60 and len(rule) < 40_000
    assert all(x[0] != y[0] for x, y in itertools.pairwise(rule))


def test_pages_without_article():
    cases = {"": "", "plain text": "plain text", "<div><a>l1</a></div><div>text body here</div>": "text body here", "<article></article>": "",
             "<b>x": "x", '<p title="a>b">q</p>&lt;x&gt; &am': "q\n\n<x> &am", "<article>t<!-- c": "t", '<p a="unclosed>zzz</p> tail': "zzz\n\ntail",
             "<table><tr><td>1<td>2<tr><td>3</table>": "1\n\n2\n\n3", "<main>in<nav>no</nav></main>out": "in"}
    for source, text in cases.items():
        assert R.main_text(R.Page(source), set()) == text, source


ITEMS = st.lists(st.sampled_from(["a", "b", "c", "#text"]), max_size=7)


def accepts(rule, items):
    """Whether a union-free expression takes a row of items."""
    states = {0}
    for item in [*items, None]:
        closed = set(states)
        for s in sorted(range(len(rule))):
            if s in closed and rule[s][1] == 0:
                closed.add(s + 1)
        if item is None:
            return len(rule) in closed
        states = set()
        for s in closed:
            if s < len(rule) and rule[s][0] == item:
                states.add(s + 1)
                if rule[s][2] > 1:
                    states.add(s)
    return False


@settings(max_examples=200, deadline=None)
@given(st.lists(ITEMS, min_size=1, max_size=5))
def test_alignment_accepts_all_that_it_saw(pages):
    rule = R.folded([(i, "t") for i in pages[0]])
    for items in pages[1:]:
        new = R.folded([(i, "t") for i in items])
        if R.Wrapper._accepts(rule, new):
            assert accepts(rule, items)
        rule = R.align(rule, new)
    assert all(accepts(rule, items) for items in pages)
    assert all(x[0] != y[0] for x, y in itertools.pairwise(rule))


def test_merged_wrappers_know_the_same_template():
    one, two, both = R.Wrapper(), R.Wrapper(), R.Wrapper()
    for k in range(12):
        p = R.Page(page(k))
        (one if k % 2 else two).take(p)
        both.take(p)
    one.merge(R.Wrapper.load(two.dump()))
    assert one.template() == both.template() and one.template()


def test_wording_of_one_page_is_kept(spark):
    only = "<h2>Only here</h2><blockquote><p>A quote</blockquote><ul><li>lone</ul>direct text"
    pages = [(k, f"http://one.example/{k}", f"<body><article><h1>Title {k}</h1>{only if k == 4 else ''}<p>text {k}<p>more {k}<h6>Kept by us</h6></article>") for k in range(9)]
    pages += [(100 + k, *pages[4][1:]) for k in range(12)]  # copies of a page are no further pages
    text = {r["page_id"]: r["text"] for r in R.extract(rows(spark, pages), ["page_id"]).collect()}
    assert text[4] == text[111] == "Title 4\n\nOnly here\n\nA quote\n\nlone\n\ndirect text\n\ntext 4\n\nmore 4\n\nKept by us"
    assert text[3] == "Title 3\n\ntext 3\n\nmore 3\n\nKept by us"


def test_wording_needs_as_many_pages_as_hold_it():
    def made(ks, with_h2):
        out = R.Wrapper()
        for k in ks:
            out.take(R.Page(f"<body><article>{'<h2>Part</h2>' if k < with_h2 else ''}<p>text {k}</article>"))
        return out

    for n in (1, 7, 8, 15):
        apart = made(range(0, 20, 2), n)
        apart.merge(R.Wrapper.load(made(range(1, 20, 2), n).dump()))
        assert apart.template() == made(range(20), n).template() == made(reversed(range(20)), n).template()
        assert bool(apart.template()) == (n >= R.LEAST_PAGES)
