import collections
import html
import os
import random
import re

import numpy as np
import pytest

from gleanery.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div><!-- note --><article>{body}<aside>more</aside><form><input name=q>go</form><section id="comments"><p>reader says</p></section></article><div class="sidebar">s</div><footer>&copy; x</footer></body></html>"""


def test_article_without_its_surroundings():
    body = "<h1>A &amp; B</h1><p>One <b>two</b>three\n\tfour&nbsp;five<br>six<p>seven <i>eight<div class='advert'>no</div><table><tr><td>c1<td>c2</table><!-- x -->end"
    assert h.extract(PAGE.format(body=body), h._DEFAULT) == "A & B One twothree four five six seven eight c1 c2 end"


def test_generated_pages_match_a_plain_reading(spark):
    rng = random.Random(1)
    pages = []
    for i in range(60):
        blocks = [" ".join(rng.choice(["wörd", "a&b", "<x", "&amp;", "long", "it's"]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 8))]
        body = "".join(f"<p>{'<b>' if rng.random() < 0.3 else ''}{html.escape(b)}{rng.choice(['</p>', '<br>'])}" for b in blocks)
        page = PAGE.format(body=body)
        pages.append((i, f"u{i}", page[: page.rindex("<footer>") + rng.randrange(8, 20)] if i % 5 == 0 else page, " ".join(" ".join(blocks).split()), "z"))
    pages += [(None, None, None, "", "z"), (100, "u", "", "", "z"), (101, "u", "just  text", "just text", "z"), (102, "u", "<p", "", "z"), (103, "u", "<script>x", "", "z"), (104, "u", "<article>" + "<p>wörd " * 60_000, " ".join(["wörd"] * 60_000), "z"), (105, "u", PAGE.format(body=""), "", "z"), (105, "u", PAGE.format(body="x"), "x", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, want string, text string").repartition(3)
    got = sorted(map(tuple, h.extract_pages(df).collect()), key=str)
    assert got == sorted(((p, u, w, len(w)) for p, u, _, w, _ in pages), key=str)
    assert h.extract_pages(df.limit(0)).count() == 0


def test_pages_without_an_article_keep_the_best_region():
    page = '<html><body><ul><li><a>x</a></li><li><a>y</a></li></ul><div><h1>Head of it</h1><p>Words and words and more words here.</p><p>And then some.</p></div><ul><li><a>z</a></li><li><a>q</a></li></ul></body></html>'
    assert h.extract(page, h._DEFAULT) == "Head of it Words and words and more words here. And then some."


def test_region_is_the_maximum_sum():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(-3, 4, rng.integers(0, 25)).astype(float)
        a, b = h.best_region(s)
        best = max((s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert s[a:b].sum() == max(best, 0)


def test_weights_are_learned_from_labelled_pages(spark):
    page = PAGE.replace('<div class="sidebar">s</div>', '<div class="zork">odd words</div>')
    df = spark.createDataFrame([(f"u{i}", page.format(body="<h1>x y</h1>" + "<p>some words in here</p>" * 9)) for i in range(20)], "url string, html string")
    w, learned = h.learn(df)
    assert w["word"] > 0 and all(w[t] < 0 for t in (*h.TAGS, "outside", "inside", "dropped")) and w["p"] > w["a"] and w["p"] > w["ul"]
    assert "zork" in learned and not learned & {"article", "content"}
    assert h.learn(df.limit(0)) == (h._DEFAULT, frozenset())
    assert re.match("^[a-z0-9]+$", "".join(h.TAGS))
    bare = "<div><h1>Title here</h1><p>Words of it.</p><div class=zork>odd words</div><p>The end.</p></div>"
    assert h.extract(bare, h._DEFAULT, learned) == "Title here Words of it. The end."


KEPT = [
    ("<form id=aspnetForm><div><article><h1>Head</h1><p>All of it.</p></article></div></form>", "Head All of it."),
    ("<form><h1>Head</h1><p>All of this text is the page's own.</p><p>And this.</p></form>", "Head All of this text is the page's own. And this."),
    ('<article><pre><code>x = 1 <span class="hljs-comment">// one</span> <span class="comment"># two</span></code></pre><p>end</p></article>', "x = 1 // one # two end"),
    ('<article><h2 id="search-results">Results</h2><p>a</p><h2 id="comments">On comments</h2><p class="notice-of-loss">A notice.</p><h3 class="section-header">Part</h3></article>', "Results a On comments A notice. Part"),
    ('<body class="no-sidebar"><div id="page" class="has-sidebar comments-open"><article><p>a b</p></article></div></body>', "a b"),
    ('<div class="page-header-fixed with-sidebar"><h1>Head</h1><p>One.</p><p>Two.</p><p>Three.</p></div>', "Head One. Two. Three."),
    ('<article><p>one</p><ul><li><a href=x>two</a></li><li><a href=y>three</a></li></ul></article>', "one two three"),
    ('<article><p>one <span class="small nav-text-x">two</span></p></article>', "one two"),
]
GONE = [
    ('<article><p>one</p><div class="ad-slot-3">no</div><div class="acme-sidebar">no</div><section id="reader-comments"><article><p>no</p></article></section><div role="complementary">no</div><p>two</p></article>', "one two"),
    ('<nav>n</nav><div>top words here</div><article><p>one two three</p></article><div>under it</div>', "one two three"),
    ('<article><p>first</p><aside>' + "no " * 900 + '</aside><form>no</form><p>last</p></article>', "first last"),
    ('<article><p>text</p><p class="ad">no</p><span class="advert">no</span><h3 class="comments">no</h3><div id="cookie-notice">no</div><div class="newsletter-signup">no</div></article>', "text"),
    ('<div><h1>Head</h1><p>Body of the page, some words.</p></div><div class="comments"><p>no</p><p>no</p><p>no</p><p>' + "no " * 90 + "</p></div>", "Head Body of the page, some words."),
]


def test_names_drop_parts_but_not_text():
    for page, want in [*KEPT, *GONE]:
        assert h.extract(page, h._DEFAULT) == want, page


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_learned_weights_find_the_article_where_no_name_tells(spark):
    """Held-out pages with every name taken away (nav, article, footer, classes become bare div): the scan alone draws the border."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights, learned = h.learn(pages.where("page_id % 2 = 0").select("url", "html"))
    flat = dict.fromkeys(h._DEFAULT, -0.001) | {"word": 1.0}
    score = {"learned": [0, 0], "flat": [0, 0]}
    total = 0
    for r in pages.where("page_id % 2 = 1").collect():
        truth = collections.Counter(h.extract(r["html"], weights, learned).split())
        total += sum(truth.values())
        bare = re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", re.sub(r' class="[^"]*"', "", r["html"]))
        for name, w in (("learned", weights), ("flat", flat)):
            got = collections.Counter(h.extract(bare, w).split())
            score[name][0] += sum((got & truth).values())
            score[name][1] += sum(got.values())
    (hit, size), (flat_hit, flat_size) = score["learned"], score["flat"]
    assert hit / size > 0.995 and hit / total > 0.995, (hit / size, hit / total)
    assert flat_hit / flat_size < 0.97, flat_hit / flat_size
