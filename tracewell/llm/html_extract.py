"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each has a hidden label, content or not, a prior at the root, a potential with its
parent's label, and evidence: its tag, the words of its class, id and role, how much text of its own it has, and how
much of that is links, within an article or outside. One sum-product pass upward and one downward give each element's marginal; text stands where
content is likelier than not. All potentials are counts (with add-one smoothing) over labelled pages, which are written
by ``labelled_pages`` from many site layouts.

Defined cases: a null or empty html gives an empty text; a page without an element has one node, its root; an element
left open ends with its page or where a closing tag or a sibling that implies it stands; scripts with what stands in for them, styles, templates, the
head and the fields of forms never hold text, all other elements' text stays with its block; an empty table gives no rows; repeated rows give repeated results; pages are taken whole, however long or deep.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values: elements by how they are parsed, as the HTML standard has them
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea iframe head title select".split())  # no text that a reader sees, or a form's fields
RAW = frozenset("script style textarea title iframe noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())  # the end of one is the end of any
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
FENCE = frozenset("ul ol dl table div article section aside nav main form body html blockquote".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+")
PAGES = 2000  # labelled pages that the potentials are counted on
MOST_FEATURES = 1_000_000  # kinds of evidence that labelled pages may have; more are an error
LIKELY = 0.5


class Page:
    """Blocks of a page in document order (parents first): parent, evidence, and text runs as (block, text)."""

    def __init__(self, text: str):
        self.parent, self.tags, self.names, self.runs = [-1], ["#root"], [""], []
        self.linked, self.length = [0], [0]
        self.inside = [False]  # whether an article or main element is around
        self._read(text)

    def _read(self, text: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the block they belong to
        pieces, at, anchors, hidden = [], 0, 0, 0
        while True:
            m = TOKEN.search(text, at)
            stop = m.start() if m else len(text)
            if stop > at and not hidden:
                block = stack[-1][1]
                piece = entities.unescape(text[at:stop]) if "&" in text[at:stop] else text[at:stop]
                if not pieces or pieces[-1][0] != block:
                    pieces.append((block, []))
                pieces[-1][1].append(piece)
                size = len(piece.strip())
                self.length[block] += size
                if anchors:
                    self.linked[block] += size
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                same = HEADINGS if tag in HEADINGS else (tag,)
                k = len(stack) - 1
                while k and stack[k][0] not in same:
                    k -= 1
                if k:
                    gone = stack[k:]
                    del stack[k:]
                    anchors -= sum(t == "a" for t, _ in gone)
                    hidden -= sum(t in HIDDEN for t, _ in gone)
                    if any(t in BLOCKS for t, _ in gone):
                        pieces.append((-1, []))
                continue
            if tag == "br":
                if not hidden and pieces:
                    pieces[-1][1].append(" ")
                continue
            block = tag in BLOCKS
            ends = CLOSED_BY.get(tag, ())
            k = len(stack) - 1
            found = 0
            while k and (block or ends):
                name = stack[k][0]
                if name in ends or (block and name == "p"):
                    found = k
                elif name in FENCE and name not in ends:
                    break
                k -= 1
            if found:
                gone = stack[found:]
                del stack[found:]
                anchors -= sum(t == "a" for t, _ in gone)
                hidden -= sum(t in HIDDEN for t, _ in gone)
            if block:
                pieces.append((-1, []))
            if tag in VOID:
                continue
            owner = stack[-1][1]
            if block and not hidden:
                attributes = m[3] if m[2] else m[6]
                self.parent.append(owner)
                self.inside.append(self.inside[owner] or self.tags[owner] in ("article", "main"))
                self.tags.append(tag)
                self.names.append(" ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if attributes else "")
                self.linked.append(0)
                self.length.append(0)
                owner = len(self.parent) - 1
            stack.append((tag, owner))
            anchors += tag == "a"
            hidden += tag in HIDDEN
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(text, at)
                at = close.start() if close else len(text)
        for block, parts in pieces:
            if block >= 0 and (run := " ".join("".join(parts).split())):
                self.runs.append((block, run))

    def evidence(self, k: int) -> list[str]:
        n, share = self.length[k], self.linked[k] / max(1, self.length[k])
        size = 0 if not n else 1 + (n >= 25) + (n >= 100) + (n >= 400)
        found = ["t:" + self.tags[k], f"n:{size}"] if k else ["r:page" if {"html", "body", "head"} & set(self.tags) else "r:part"]
        if n:
            level = math.ceil(share * 3)
            found.append(f"a:{level}{'in' * (level == 3 and self.inside[k])}")
        if self.names[k]:
            found += ["w:" + w.lower() for w in dict.fromkeys(WORD.findall(self.names[k]))]
        return found


class Model:
    """Log potentials: prior of the root, of a child's label given its parent's, and log odds of each evidence."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        total = [max(1.0, counts.get("#", (0, 0))[k]) for k in (0, 1)]
        root = counts.get("root", (0, 0))
        self.root = math.log((root[1] + 1) / (root[0] + 1))
        self.step = [[math.log((counts.get(f"edge{p}", (0, 0))[c] + 1) / (sum(counts.get(f"edge{p}", (0, 0))) + 2)) for c in (0, 1)] for p in (0, 1)]
        self.odds = {f: math.log((b + 0.5) / (total[1] + 1)) - math.log((a + 0.5) / (total[0] + 1)) for f, (a, b) in counts.items() if f[1:2] == ":"}

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each block: leaves to root, then root to leaves, as log odds."""
        n, parent, step, known = len(page.parent), page.parent, self.step, self.odds.get
        own = [sum(known(f, 0.0) for f in page.evidence(k)) for k in range(n)]
        up = [0.0] * n  # what each block tells its parent
        exp, log = math.exp, math.log
        for k in range(n - 1, 0, -1):
            e = exp(min(500.0, max(-500.0, own[k])))  # own[k] now holds its children's messages too
            up[k] = log((exp(step[1][0]) + exp(step[1][1]) * e) / (exp(step[0][0]) + exp(step[0][1]) * e))
            own[parent[k]] += up[k]
        own[0] += self.root
        for k in range(1, n):
            e = exp(min(500.0, max(-500.0, own[parent[k]] - up[k])))
            own[k] += log((exp(step[0][1]) + exp(step[1][1]) * e) / (exp(step[0][0]) + exp(step[1][0]) * e))
        return [1 / (1 + exp(-min(500.0, max(-500.0, z)))) for z in own]

    def text(self, html: str | None) -> str:
        page = Page(html or "")
        if not page.runs:
            return ""
        likely = self.marginals(page)
        return "\n\n".join(run for block, run in page.runs if likely[block] > LIKELY)


def labelled_page(k: int) -> str:
    """A page of an invented site; elements with data-c="1" hold content, with "0" none, others are as their parent; the root does where there is no page around the content."""
    r = random.Random(k)
    words = lambda a, b: " ".join("".join(r.choice(("ba", "den", "ko", "li", "ran", "the", "su", "ing")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + "."
    links = lambda a, b: "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))

    def prose() -> str:
        kind = r.random()
        if kind < 0.7:
            text = " ".join(sentence(2, 18) for _ in range(r.choice((1, 1, 2, 4, 9))))
            return f"<p>{text}</p>" if r.random() < 0.7 else f"<p><b>{text}<br>" if r.random() < 0.5 else f'<p>{text} <a href="/y">{words(1, 3)}</a> {sentence(1, 6)}</p>'
        if kind < 0.78:
            return f"<h{r.randint(2, 4)}>{words(1, 7)}</h2>"
        if kind < 0.81:
            return "<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.84:
            return f"<ul>{links(2, 5)}</ul>"
        if kind < 0.86:
            return f'<p><a href="/r">{words(1, 9)}</a></p>'
        if kind < 0.9:
            return f"<blockquote><p>{sentence(5, 30)}</p></blockquote>"
        if kind < 0.94:
            return f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{sentence(2, 9)}</figcaption></figure>"
        return f"<pre>{words(3, 20)}</pre>" if r.random() < 0.5 else f'<div>{sentence(4, 30)}</div>'

    def named(tag: str, names: tuple[str, ...]) -> str:
        return f'<{tag} {r.choice(("class", "id"))}="{r.choice(names)}" data-c="0">'

    def around(inside: bool) -> str:
        """A part that is no content; ``inside``: one that stands within articles too."""
        kind = r.randrange(4, 11) if inside else r.randrange(11)
        body = r.choice((sentence(2, 20), f"<p>{sentence(3, 25)}</p>", f"<ul>{links(2, 6)}</ul>", f"<h3>{words(1, 3)}</h3><p>{sentence(2, 12)}</p>", f'<a href="/z">{words(1, 5)}</a>'))
        if kind == 0:
            return f'<nav data-c="0"><ul>{links(2, 9)}</ul></nav>' if r.random() < 0.7 else named("div", ("menu", "main-menu", "navbar", "breadcrumbs", "topnav", "navigation")) + f"<ul>{links(2, 9)}</ul></div>"
        if kind == 1:
            return f'<header data-c="0"><h2><a href="/">{words(1, 3)}</a></h2>{body}</header>' if r.random() < 0.7 else named("div", ("header", "masthead", "site-header", "topbar")) + body + "</div>"
        if kind == 2:
            return f'<footer data-c="0">&copy; {words(1, 2)} &middot; {body}</footer>' if r.random() < 0.7 else named("div", ("footer", "site-footer", "bottom", "copyright")) + body + "</div>"
        if kind == 3:
            return named("div", ("sidebar", "side-bar", "widget", "rail", "column-right")) + body + "</div>"
        if kind == 4:
            return f'<aside data-c="0">{body}</aside>'
        if kind in (5, 6, 7):
            tag = r.choice(("div", "section"))
            names = {
                5: ("ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "promo", "sponsor"),
                6: ("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "gdpr", "modal", "disclaimer"),
                7: ("share", "social", "related", "related-posts", "recommended", "tags", "newsletter", "subscribe", "signup", "pagination", "login"),
            }
            return named(tag, names[kind]) + body + f"</{tag}>"
        if kind == 8:
            return f'<form action="/s" data-c="0"><label>{words(1, 4)}</label><p>{sentence(2, 9)}</p><input name=q></form>'
        if kind == 9:
            said = "".join(f'<div class="comment"><h4>{words(1, 2)}</h4><p>{" ".join(sentence(2, 12) for _ in range(r.randint(1, 4)))}</p></div>' for _ in range(r.randint(1, 5)))
            tag = r.choice(("div", "section"))
            return named(tag, ("comments", "comment-list", "replies", "responses", "discussion", "disqus", "reader-comments")) + f"<h3>{words(1, 2)}</h3>{said}</{tag}>"
        said = "".join(f'<li class="comment"><p>{sentence(2, 20)}</p></li>' for _ in range(r.randint(1, 5)))
        return named("ol", ("commentlist", "comments", "comment-thread")) + said + "</ol>"

    if r.random() < 0.05:  # no page around it: the root itself is content
        return "".join(around(False) if r.random() < 0.1 else prose() for _ in range(r.choice((1, 1, 2, 5))))
    main = f"<h1>{words(2, 9)}</h1>" + "".join(around(True) if r.random() < 0.12 else prose() for _ in range(r.choice((0, 1, 3, 6, 12))))
    shell, holds = r.random(), ""
    if shell < 0.15:  # content right in the body
        holds = ' data-c="1"'
    elif shell < 0.55:
        main = f'<article data-c="1">{main}</article>'
    elif shell < 0.68:
        main = f'<main data-c="1">{main}</main>'
    elif shell < 0.77:
        main = f'<main><article data-c="1">{main}</article></main>'
    else:
        main = f'<div {r.choice(("class", "id"))}="{r.choice(("content", "post", "entry-content", "article-body", "post-content", "story", "main", "main-content", "article", "text", "body"))}" data-c="1">{main}</div>'
    top, end = ("".join(around(False) for _ in range(r.randint(0, 4))) for _ in range(2))
    body = top + main + end if holds or r.random() < 0.7 else f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{top}{main}</div>{end}'
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body{holds}>{body}" + r.choice(("</body></html>", ""))


def labelled_pages(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    """(page_id, html) with data-c labels."""

    def write(batches):
        for b in batches:
            yield pd.DataFrame({"page_id": b["id"], "html": [labelled_page(int(k)) for k in b["id"]]})

    return spark.range(0, pages, 1, 4).mapInPandas(write, "page_id long, html string")


def fit(pages: DataFrame) -> Model:
    """Potentials counted over labelled pages. What comes to the driver is bounded by the words of their markup."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for html in b["html"]:
                # the label rides on the class so that the parser hands it through
                page = Page(re.sub(r'data-c="(\d)"', r'role="_c\1_"', html))
                label = [0] * len(page.parent)
                for k in range(len(label)):
                    given = re.search(r"_c(\d)_", page.names[k])
                    label[k] = int(given[1]) if given else label[page.parent[k]] if k else int(not html.startswith("<!DOCTYPE"))
                    page.names[k] = re.sub(r"_c\d_", "", page.names[k])
                    for f in ["#", *page.evidence(k), f"edge{label[page.parent[k]]}" if k else "root"]:
                        seen.setdefault(f, [0, 0])[label[k]] += 1
        yield pd.DataFrame([(f, a, b) for f, (a, b) in seen.items()], columns=["f", "no", "yes"])

    rows = pages.select("html").where(F.col("html").isNotNull()).mapInPandas(count, "f string, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    found = rows.orderBy("f").limit(MOST_FEATURES + 1).collect()
    if len(found) > MOST_FEATURES:
        raise ValueError(f"labelled pages have more than {MOST_FEATURES} kinds of evidence")
    return Model({r.f: (float(r.no), float(r.yes)) for r in found})


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``pages`` with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # counts of the training markup's words

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([shared.value.text(h) for h in column], dtype=object)

    return pages.withColumn("text", run("html")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(labelled_pages(spark))).select("page_id", "url", "text", "n_chars")
