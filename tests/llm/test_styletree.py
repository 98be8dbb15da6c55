import time
import math
from collections import Counter, defaultdict
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenscope.llm import styletree as st
from tokenscope.llm.common import prepare


def test_article_without_its_surroundings():
    page = """<html><head><title>T</title><script>var t="</p><article>";</script></head><body><header>H</header><nav><ul><li>a<li>b</ul></nav><div class="ad">buy</div>
    <article><h1>Head &amp; line</h1><p><b>One  two.<br><p>Three<!-- x --> f&#233;e</p><div class="share">s</div><aside>no</aside><ul><li>x<li>y</ul><form>f</form>tail</article>
    <section id="comments"><article class="comment">me too</article></section><footer>&copy;</footer></body>"""
    assert st.main_text(page).split("\n\n") == ["Head & line", "One two.", "Three fée", "x", "y", "tail"]


def test_names_that_only_look_like_noise():
    page = '<article><p>a</p><section class="related-work"><p>b</p></section><div class="notice-period">c</div><div class="comment-on-law">d</div><div class="cookie-bar">e</div><div id="comments">f</div></article>'
    assert st.main_text(page).split("\n\n") == ["a", "b", "c", "d"]
    assert st.main_text('<body><div class="comment-on-law">d</div><div class="share-buttons">e</div></body>') == "d"


def test_deep_nodes_stay_apart():
    deep = lambda tag: st.counts("<div>" * 400 + f"<{tag}>x</{tag}>" + "</div>" * 400)[1]
    (i,), (b,) = ([p for p, k, _, _ in deep(tag) if k == "c"] for tag in ("i", "b"))
    assert i != b and len(i) < st.MAX_PATH + 40
    paths = [p for p, k, _, _ in deep("i") if k == "m"]
    assert len(set(paths)) == 401


def test_pages_without_article_and_broken_markup():
    assert st.main_text("<p>a<p>b<div>c</p>d") == "a\n\nb\n\nc\n\nd"
    assert st.main_text("plain < text &lt;b&gt;") == "plain < text <b>"
    assert st.main_text("<main><p>in</main><p>out") == "in"
    assert st.main_text("<article> </article><p>only") == "only"
    assert st.main_text("<script>never ends") == st.main_text("") == st.main_text("<!-- <p>x") == ""
    assert st.main_text("<p title='a>b'>x</p") == "x"
    assert st.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert st.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def site():
    """Well-formed pages of one large host, of small hosts with a common template, and odd ones."""
    rows = []
    for i in range(12):
        notes = "".join(f"<div>note {i} {k}</div>" for k in range(i % 3))
        promo = f"<div class='promo'><div>Read {i}</div></div>"
        body = f"<div class='top'><div class='logo'>Our site</div></div>{promo}<div class='text'><p>Story {i} of many words that nobody else has {i * 7}</p><p>Common line</p><div>More {i}</div></div>{notes}<div class='legal'><div>All rights</div></div>"
        rows.append((i, "http://big.example/p", f"<html><body>{body}</body></html>"))
    for i in range(6):
        body = f"<div class='top'><div class='logo'>Theme</div></div><div class='ad'>Offer {i}</div><div class='text'><p>Post {i} with a good many words of its own {i * 3}</p></div>"
        rows.append((20 + i, f"http://small{i}.example/", f"<html><body>{body}</body></html>"))
    rows += [(30, "http://odd.example/", "<html><body><main><p>In</p></main><p>Out</p></body></html>")]
    rows += [(40 + i, "http://copies.example/", "<article><p>Same story</p></article>") for i in range(9)]
    # a name of noise that holds the text is kept
    rows += [(50 + i, "http://forum.example/", f"<html><body><div class='promo'><p>Long text {i} which is all that there is {i * 11}</p></div></body></html>") for i in range(5)]
    return [*rows, (60, None, "<p>a</p>"), (61, "http://big.example/q", None), (0, rows[0][1], rows[0][2]), (None, "x", "")]


class Page(HTMLParser):
    """Nodes of a well-formed page without noise tags, by the standard library's parser: (path, child labels) and (path of the first text, text) of blocks."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.nodes, self.blocks, self.text = [("", [])], [], [], None
        self.feed(page)
        self.flush()
        while self.stack:
            self.nodes.append(self.stack.pop())

    def flush(self):
        if self.text and self.text[1].split():
            self.blocks.append((self.text[0], " ".join(self.text[1].split())))
        self.text = None

    def handle_starttag(self, tag, attrs):
        name = tag + "".join("." + c for k, v in attrs if k == "class" for c in sorted(v.split()))
        name += "!" if any(v in ("ad", "promo") for _, v in attrs) else ""
        self.flush()
        self.stack[-1][1].append(name)
        self.stack.append((f"{self.stack[-1][0]}/{name}", []))

    def handle_endtag(self, tag):
        self.flush()
        self.nodes.append(self.stack.pop())

    def handle_data(self, data):
        self.text = (self.text[0], self.text[1] + data) if self.text else (self.stack[-1][0], data)


def host_of(url):
    return (url or "").split("://")[1].split("/")[0] if "://" in (url or "") else ""


def brute(rows):
    """(importance by (site, path), text by row) from the definitions, over lists and dictionaries."""
    parsed = [(host_of(url), Page(page or "")) for _, url, page in rows]
    sizes = Counter(h for h, _ in parsed)
    prose = {"p"}
    kind_of = lambda page: tuple(sorted({p for p, _ in page.nodes if p.count("/") <= 3 and p.split("/")[-1] not in prose}))
    sites = [h if sizes[h] >= 4 else kind_of(p) for h, p in parsed]
    pages, kids, styles, shared = Counter(), defaultdict(list), defaultdict(Counter), Counter()
    for site_, (_, page) in zip(sites, parsed):
        most = {}
        for path, labels in page.nodes:
            styles[site_, path][tuple(labels)] += 1
            most[path] = max(most.get(path, 0), len(labels))
        for path, k in most.items():
            pages[site_, path] += 1
            kids[site_, path].append(k)
        for path, text in set(page.blocks):
            shared[site_, path, text] += 1
    new, words = Counter(), Counter()
    for (site_, path, text), n in shared.items():
        m = max(2, pages[site_, path])
        w, parts = len(text.split()) * n, path.split("/")
        own = {(site_, q): max(0.0, w * (1 - math.log(n) / math.log(m))) for q in ["all", *("/".join(parts[:k]) for k in range(2, len(parts) + 1))]}
        for q, x in own.items():
            new[q] += x
            words[q] += w
    importance = {}
    for (site_, path), m in pages.items():
        n = sum(styles[site_, path].values())
        style = -sum(c / n * math.log(c / n) for c in styles[site_, path].values()) / math.log(max(2, m))
        base = new[site_, "all"] if path.endswith("!") else words[site_, path]
        weight = 0.9 ** (sum(kids[site_, path]) / m)
        value = min(1.0, (1 - weight) * style + weight * (new[site_, path] / base if base else 0.0))
        importance[site_, path] = (m, 1.0 if m < 2 or new[site_, "all"] <= 0 else value)
    texts = []
    for site_, (_, page) in zip(sites, parsed):
        if pages[site_, ""] < 4:
            inside = [t for p, t in page.blocks if "/main" in p]
            texts.append("\n\n".join(inside or [t for p, t in page.blocks if "!" not in p]))
            continue
        cut = {p for (s, p), (m, v) in importance.items() if s == site_ and m >= 4 and v < (0.5 if p.endswith("!") else 0.3) and p.split("/")[-1] not in ("", "html", "body", *prose)}
        texts.append("\n\n".join(t for p, t in page.blocks if not any(p == c or p.startswith(c + "/") for c in cut)))
    return importance, texts


def test_importance_and_text_equal_brute_force(spark):
    prepare(spark)
    rows = site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want, texts = brute(rows)
    got = Counter((r.path, r.m, round(r.importance, 9)) for r in st.style_tree(df).collect())
    assert got == Counter((path, m, round(v, 9)) for (_, path), (m, v) in want.items() if path)
    found = sorted(map(tuple, st.extract(df, ["page_id", "url"]).collect()), key=str)
    assert found == sorted(((i, url, t) for (i, url, _), t in zip(rows, texts)), key=str)


def test_unimportant_branches_go_and_both_ways_agree(spark):
    prepare(spark)
    rows = site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"path": F.lit(1), "host": F.lit("x"), "site": F.lit("y")})
    got = sorted(map(tuple, st.extract(df, ["page_id", "url"]).collect()), key=str)
    assert got == sorted(map(tuple, st.extract(df, ["page_id", "url"], max_cuts=0).collect()), key=str)
    text = {(a, b): c for a, b, c in got}
    assert text[3, "http://big.example/p"] == "Story 3 of many words that nobody else has 21\n\nCommon line\n\nMore 3"
    assert text[21, "http://small1.example/"] == "Post 1 with a good many words of its own 3"
    assert text[44, "http://copies.example/"] == "Same story" and text[30, "http://odd.example/"] == "In"
    assert text[52, "http://forum.example/"].startswith("Long text 2")
    assert text[60, None] == "a" and text[61, "http://big.example/q"] == "" and len(got) == len(rows)
    assert st.extract(df.limit(0), ["page_id"]).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_the_tree_decides_on_the_tables(spark):
    """Without its cuts every page of the tables keeps an advert; with them each is its article."""
    prepare(spark)
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    want = {r["page_id"]: st.main_text("<article>" + r["html"].split("<article>")[1].split("</article>")[0] + "</article>") for r in rows}
    got = {r.page_id: r[1] for r in st.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), ["page_id"]).collect()}
    uncut = {r["page_id"]: st.main_text(r["html"], frozenset()) for r in rows}
    assert sum(got[i] == want[i] for i in want) == len(want)
    assert sum(uncut[i] == want[i] for i in want) == 0


def test_what_an_article_keeps():
    assert st.main_text("<article><header><h1>Title</h1></header><p>Sum <math><mi>x</mi></math> end</p></article><header>H</header>") == "Title\n\nSum x end"
    assert st.main_text('<article><header hidden>no</header><header role="banner">no</header><p>a</p></article>') == "a"


def test_a_teaser_does_not_stand_for_the_page():
    story = "<div class='text'>" + "<p>A long story of many words.</p>" * 5 + "</div>"
    assert st.main_text(f"<article>Card</article>{story}") == "\n\n".join(["Card", *["A long story of many words."] * 5])


def test_long_names_leave_nodes_apart(spark):
    """Under ten elements with names of 120 characters an advert is still cut by itself."""
    prepare(spark)
    top = "".join(f'<div class="{chr(97 + i) * 120}">' for i in range(10))
    rows = [(i, "http://long.example/", f"{top}<div class='box'>Offer</div><div class='text'><p>story {i} is told in {i * 7} words {'x' * i}</p></div>") for i in range(12)]
    got = [x[1] for x in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()]
    assert len(got) == 12 and all("Offer" not in t and t.startswith("story") for t in got)


def test_unmatched_tags_take_linear_time():
    began = time.time()
    st.main_text("<i>" * 60_000 + "</u>" * 60_000)
    st.main_text("<table>" + "<i>" * 60_000 + "<tr>" * 20_000)
    assert time.time() - began < 30
