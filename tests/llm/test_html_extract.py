import html
import re

from tracewell.llm import html_extract as H


def brute(page: str) -> str:
    """The article's text where pages have exactly one article of headings and paragraphs."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_whole_table_against_brute_force(spark, small):
    rows = H.query(spark, small).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_labelled_layouts(spark):
    model = H.fit(H.labelled_pages(spark, 300))
    wrong = total = 0
    for k in range(5000, 5150):
        marked = H.Page(re.sub(r'data-c="(\d)"', r'role="_c\1_"', H.labelled_page(k)))
        label = [0] * len(marked.parent)
        for i in range(len(label)):
            given = re.search(r"_c(\d)_", marked.names[i])
            label[i] = int(given[1]) if given else label[marked.parent[i]] if i else int(not H.labelled_page(k).startswith("<!DOCTYPE"))
        likely = model.marginals(H.Page(H.labelled_page(k)))
        wrong += sum((likely[b] > H.LIKELY) != bool(label[b]) for b, _ in marked.runs)
        total += len(marked.runs)
    assert wrong < 0.06 * total


def test_message_passing_is_exact(spark):
    """Marginals against the sum over all labelings of a small tree."""
    from itertools import product
    from math import exp, log

    model = H.fit(H.labelled_pages(spark, 100))
    page = H.Page("<body><nav><a href=x>Menu</a></nav><article><h1>A head</h1><p>Some words here.</p></article></body>")
    odds = [sum(model.odds.get(f, 0.0) for f in page.evidence(k)) for k in range(len(page.parent))]
    weight, mass = [0.0] * len(odds), 0.0
    for labels in product((0, 1), repeat=len(odds)):
        score = labels[0] * model.root + sum(o * y for o, y in zip(odds, labels, strict=True))
        score += sum(model.step[labels[page.parent[k]]][labels[k]] for k in range(1, len(labels)))
        mass += exp(score)
        for k, y in enumerate(labels):
            weight[k] += y * exp(score)
    for w, m in zip(weight, model.marginals(page), strict=True):
        assert abs(w / mass - m) < 1e-9 and abs(log(max(w / mass, 1e-300)) - log(max(m, 1e-300))) < 1e-6


def test_odd_pages(spark):
    model = H.fit(H.labelled_pages(spark, 100))
    assert model.text(None) == model.text("") == ""
    assert "alert" not in model.text("<article><p>Plain text of an article, long enough.</p><script>alert('</p>')</script></article>")
    assert model.text("<article><p>a &lt; b &amp c&nbsp;d\n\n e</p><p>two") == "a < b & c d e\n\ntwo"
    model.text("<div>" * 20000 + "deep" + "<p a='" * 50)
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "", "y")], "page_id long, url string, html string, text string")
    out = H.extract(rows.drop("text"), model).collect()
    assert [(r.text, r.n_chars) for r in out] == [("", 0)] * 3
    assert H.extract(rows.drop("text").limit(0), model).count() == 0


def test_inline_elements_keep_their_text(spark):
    model = H.fit(H.labelled_pages(spark, 300))
    page = "<html><body><nav><a href=/>Home</a> <a href=/x>More</a></nav><article><h1>On energy and mass</h1><p>It is said that energy is <math><mi>E</mi></math> here, and so on. Press <button>Start</button> now.<noscript>No script.</noscript></p></article></body></html>"
    assert model.text(page) == "On energy and mass\n\nIt is said that energy is E here, and so on. Press Start now."


# words of class names that the labelled pages don't use
OTHERS = '<html><body><div class="topline"><a href=/>Start</a><a href=/n>News</a><a href=/s>Sport</a></div><div class="xq7"><h1>{head}</h1><p>{one}</p><p>{two}</p></div><div class="zz"><ul><li><a href=/1>First</a></li><li><a href=/2>Second</a></li><li><a href=/3>Third</a></li></ul></div></body></html>'


def test_layouts_of_unknown_names(spark):
    """Where names tell nothing, tags, lengths and links must: paragraphs stay, lists of links go."""
    model = H.fit(H.labelled_pages(spark))
    one, two = "The river had risen by a metre overnight, and nobody in the village had slept. " * 3, "By noon the water fell again, slowly, and the road to the mill came back into sight. " * 3
    text = model.text(OTHERS.format(head="A river rises", one=one, two=two))
    assert one.strip() in text and two.strip() in text and "Second" not in text and "Sport" not in text


RIVER = "The river had risen by a metre overnight, and nobody in the village had slept until the morning came. "


def test_pages_without_a_shell(spark):
    """Paragraphs right in the body beside menus and footers, lists and paragraphs of links within articles, and fragments."""
    model = H.fit(H.labelled_pages(spark))
    paragraphs = [(RIVER * k).strip() for k in (1, 2, 3, 2)]
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><h1>River</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<footer>&copy; 2020 The Paper</footer></body></html>"
    assert model.text(page) == "\n\n".join(["River", *paragraphs])
    linked = f"<html><body><nav><a href=/>Home</a></nav><article><h1>River</h1><p>{paragraphs[0]}</p><ul><li><a href=/1>First report</a></li><li><a href=/2>Second report</a></li></ul><p><a href=/3>The whole story</a></p><p>{paragraphs[1]}</p></article><footer>Imprint</footer></body></html>"
    assert model.text(linked) == "\n\n".join(["River", paragraphs[0], "First report", "Second report", "The whole story", paragraphs[1]])
    assert model.text("<p>Short page.</p>") == "Short page."
