"""HTML extraction by the maximum-scoring subsequence (operator 6).

A page is read as a sequence of words and tags. Words score positive, tags negative; on a page with an ``article`` (or ``main``)
words outside of it score negative too, and tags inside next to nothing. One linear scan (Kadane) finds the contiguous region
with the largest sum, and nothing outside of it is taken. Weights are learned from labelled pages (those with an
``article``): log odds of each tag outside against inside it, log odds of a word outside, and class names that only
stand outside. On pages without an ``article`` these weights alone draw the border.

Parts that are no content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are known by
their element, by a class, id or role named so, or by a learned class name. They score nothing in an article and a little below
elsewhere, so that the region may span them, and yield no text. A name counts if it is made of known words; on containers one other word may stand
beside them (``acme-sidebar``), but none that negates or describes (``no-sidebar``, ``notice-of-loss``); ids count on containers alone;
within ``pre`` and ``code`` no name counts. A container so named that holds the page's only ``article``, or a heading or three
paragraphs and most of the words of a page without one, is the page's wrapper and stays; so does such a ``form``. Reader comments
never stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
Weights come from a bounded, hash-chosen sample of ``sample`` pages; without labelled pages defaults serve.

Defined cases: null and empty html give an empty text; html without tags is one block. Unclosed tags, comments and scripts
run to the end of the page. Null page_id or url, and repeated rows, stay, each judged alone. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

RESULT = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|select)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?/](?:[^>]*)(?:>|\Z)""", re.S | re.I)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form button dialog menu head fieldset object".split())
#: Of these the ones that may also wrap a page.
CONTROLS = frozenset("form fieldset object".split())
#: Parts of class, id and role names that mark an element as no content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox comment comments commentlist disqus replies respond reviews share sharing social related recommended recommendations copyright legal disclaimer pagination pager toolbar complementary contentinfo skip".split()
)
READERS = frozenset("comment comments commentlist disqus replies respond reviews related recommended".split())
#: Marks that on a heading, a paragraph or within a line are as likely the text's own.
VAGUE = frozenset("header masthead banner foot footer notice notices notification alert legal search login reviews social share sharing related skip copyright rail widget".split())
#: Words that may stand beside a mark without changing what it says.
PLAIN = frozenset("article area bar block body bottom box btn button col column container content first floating form global group holder icon id image inline inner item items js label last left link links list local main media module outer page panel post primary reader readers region right row second secondary section site slot sticky text thread title top unit user users view wrap wrapper zone".split())
#: Words that make of a mark a description of something else.
OTHERWISE = frozenset("and closed disabled for from has have hide hidden in is no not of off on open or show the to with without".split())
CONTAINERS = frozenset("div section ul ol dl table center ins iframe details address figure map hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
ARTICLE = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body", "article", "main"))
_OTHER = "other"
TAGS = ("p", "div", "span", "a", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "br", "hr", "table", "tr", "td", "th", "tbody", "section", "blockquote", "pre", "code", "img", "figure", "figcaption", "dl", "dt", "dd", "small", "article", "main", "html", "body", _OTHER)
_DEFAULT = {"word": 1.0, "outside": -1.0, "inside": -1e-6, "dropped": -0.01} | dict.fromkeys(TAGS, -1.0) | {"a": -2.5, "li": -2.0, "ul": -2.0, "div": -1.5, "br": -0.2, "b": -0.2, "i": -0.2, "em": -0.2, "strong": -0.2, "p": -0.3} | dict.fromkeys(("h1", "h2", "h3"), -0.2)


@dataclass(frozen=True)
class HtmlConfig:
    sample: int = 2000
    least_pages: int = 5  #: of a class name that is learned to stand outside alone


@dataclass
class Piece:
    """A text with its block's number, or a tag."""

    text: str
    tag: str
    block: int
    dropped: bool
    inside: int  #: number of the outermost article it lies in, or 0


def names_of(attributes: str) -> list[tuple[str, str]]:
    """(attribute, name) of each class, id, role and aria-label."""
    out = []
    for m in _NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        out += [(m[1].lower(), x) for x in ([value] if m[1].lower() == "aria-label" else value.split())]
    return out


def marked(tag: str, attributes: str, learned: frozenset[str] = frozenset()) -> str:
    """The mark that makes an element no content by its names; empty if none does."""
    container = tag in CONTAINERS
    for kind, name in names_of(attributes):
        if kind == "role":
            if name.lower() in ROLES:
                return "role"
            continue
        if kind != "class" and not container:
            continue
        if kind == "class" and container and name.lower() in learned:
            return "learned"
        parts = [x.lower() for x in _PARTS.findall(name)]
        marks = [x for x in parts if x in MARKS and (container or tag not in HEADINGS and tag != "p" and tag not in INLINE or x not in VAGUE)]
        if not marks:
            continue
        other = [x for x in parts if x not in MARKS and x not in PLAIN and not x.isdigit()]
        if not other or container and kind != "aria-label" and len(other) == 1 and other[0] not in OTHERWISE:
            return next((x for x in marks if x in READERS), marks[0])
    return ""


@dataclass
class Suspect:
    """An element that is no content by its name, and what it holds."""

    kind: str
    parent: int  #: the suspect around it, or -1
    words: int = 0
    prose: int = 0  #: paragraphs; a first heading counts as three
    article: bool = False


def pieces(page: str, learned: frozenset[str] = frozenset()) -> list[Piece]:
    """Texts and tags of a page in order."""
    out, suspects, free = _read(page, learned, frozenset())
    if free or not suspects:
        return out
    for x in reversed(suspects):  # children come after their parents
        if x.parent >= 0:
            up = suspects[x.parent]
            up.words, up.prose, up.article = up.words + x.words, up.prose + x.prose, up.article or x.article and x.kind not in READERS
    total = sum(len(p.text.split()) for p in out if p.text)
    wraps = lambda x: x.article if x.kind == "part" else x.kind not in READERS and (x.article or x.prose >= 3 and 2 * x.words > total)
    spared = frozenset(i for i, x in enumerate(suspects) if wraps(x))
    return _read(page, learned, spared)[0] if spared else out


def _close(stack: list, count: Counter[str], name: str) -> None:
    """An end tag closes the nearest open element of its name, and all within; one without such an element closes nothing."""
    if not count[name]:
        return
    while True:
        last = stack.pop()[0]
        count[last] -= 1
        if last == name:
            return


def _read(page: str, learned: frozenset[str], spared: frozenset[int]) -> tuple[list[Piece], list[Suspect], bool]:
    """Pieces, the elements under suspicion, and whether an article lies in none of them. ``spared`` ones are content."""
    out: list[Piece] = []
    suspects: list[Suspect] = []
    stack: list[tuple[str, bool, int, int, bool]] = []  # name, dropped, article, suspect, code
    count: Counter[str] = Counter()  # of the open elements' names
    dropped, inside, suspect, code = False, 0, -1, False
    articles, block, at = 0, 0, 0

    def text(s: str):
        if s:
            out.append(Piece(s, "", block, dropped, inside))
            if suspect >= 0:
                suspects[suspect].words += len(s.split())

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue  # comments, scripts and the like leave no trace
        if name not in INLINE:
            block += 1
        out.append(Piece("", name, block, dropped, inside))
        if name in VOID:
            continue
        if m[2]:
            _close(stack, count, name)
        else:
            if count[name] and name in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        _close(stack, count, name)
                        break
                    if stack[i][0] not in INLINE and not (name == "tr" and stack[i][0] in ("td", "th")):
                        break
            if m[4].rstrip().endswith("/") and name not in INLINE and name not in ROOTS:
                continue
            dropped, inside, suspect, code = stack[-1][1:] if stack else (False, 0, -1, False)
            if suspect >= 0 and (name == "p" or name == "h1"):
                suspects[suspect].prose += 3 if name == "h1" else 1
            mark = ("control" if name in CONTROLS else "part") if name in DROPPED else "" if name in ROOTS or code or not m[4] else marked(name, m[4], learned)
            if name in ARTICLE and not inside and not dropped:
                articles += 1
                inside = articles
            elif name in ARTICLE and suspect >= 0:
                suspects[suspect].article = True
            if mark:
                suspects.append(Suspect(mark, suspect))
                suspect = len(suspects) - 1
                dropped = dropped or suspect not in spared
                out[-1].dropped = dropped  # its own tags cost nothing either
            stack.append((name, dropped, inside, suspect, code or name in ("pre", "code")))
            count[name] += 1
        dropped, inside, suspect, code = stack[-1][1:] if stack else (False, 0, -1, False)
    text(page[at:])
    return out, suspects, articles > 0


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous run with the largest sum, the first and longest of equals; (0, 0) if no score is positive."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total)
    gain = total[1:] - low[:-1]
    end = len(gain) - 1 - int(np.argmax(gain[::-1] >= gain.max() - 1e-9))
    return int(np.argmax(total[: end + 1] <= low[end] + 1e-9)), end + 1


def scores_of(found: list[Piece], weights: dict[str, float]) -> np.ndarray:
    """Of each piece: words times what a word weighs where it stands, or its tag's weight."""
    out = np.zeros(len(found))
    labelled = any(p.inside for p in found)
    for i, p in enumerate(found):
        if p.tag:
            out[i] = weights["inside"] if p.inside else 0.0 if p.dropped else weights.get(p.tag, weights[_OTHER])
        else:
            out[i] = len(p.text.split()) * (0.0 if p.dropped and p.inside else weights["dropped" if p.dropped else "outside" if labelled and not p.inside else "word"])
    return out


def extract(page: str | None, weights: dict[str, float], learned: frozenset[str] = frozenset()) -> str:
    if not page:
        return ""
    found = pieces(page, learned)
    a, b = best_region(scores_of(found, weights))
    blocks: list[str] = []
    last = None
    for p in found[a:b]:
        if p.text and not p.dropped:
            if p.block != last:
                blocks.append("")
                last = p.block
            blocks[-1] += p.text
    return " ".join(" ".join([" ".join(entities.unescape(x).split()) for x in blocks]).split())


def _count(batches):
    """Per tag, and per class name of containers: words or tags inside articles, outside, and pages; of pages that have an article."""
    c: dict[str, list[int]] = {}

    def add(key: str, side: int, n: int):
        c.setdefault(key, [0, 0, 0])[side] += n

    for b in batches:
        for page in b.column(0).to_pylist():
            found = pieces(page or "")
            if not any(p.inside for p in found):
                continue
            for p in found:
                side = 0 if p.inside and not p.dropped else 1
                if p.tag:
                    add(p.tag if p.tag in TAGS else _OTHER, side, 1)
                else:
                    add("word", side, len(p.text.split()))
                    if not p.inside and not p.dropped:
                        add("outside", 1, len(p.text.split()))
            for name, (i, o) in class_words(page).items():
                add("." + name, 0, i)
                add("." + name, 1, o)
                add("." + name, 2, 1)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *[pa.array([x[j] for x in c.values()], pa.int64()) for j in range(3)]], ["t", "i", "o", "n"])


def class_words(page: str) -> dict[str, tuple[int, int]]:
    """Words inside and outside of articles under each class name of containers."""
    out: dict[str, list[int]] = {}
    stack: list[tuple[str, frozenset[str], bool]] = []  # name, class names around, in an article
    count: Counter[str] = Counter()
    at = 0

    def text(s: str):
        n = len(s.split())
        if n and stack:
            side = 0 if stack[-1][2] else 1
            for x in stack[-1][1]:
                out.setdefault(x, [0, 0])[side] += n

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name or name in VOID:
            continue
        if m[2]:
            _close(stack, count, name)
        elif not m[4].rstrip().endswith("/"):
            around = stack[-1][1] if stack else frozenset()
            own = {x.lower() for k, x in names_of(m[4]) if k == "class"} if m[4] and name in CONTAINERS else set()
            stack.append((name, around | own if own else around, name in ARTICLE or bool(stack) and stack[-1][2]))
            count[name] += 1
    text(page[at:])
    return {k: (v[0], v[1]) for k, v in out.items()}


def learn(pages: DataFrame, config: HtmlConfig = HtmlConfig()) -> tuple[dict[str, float], frozenset[str]]:
    """Weights, and class names that only stand outside, from pages that have an article."""
    n = pages.count()
    share = min(1.0, config.sample / n) if n else 1.0
    chosen = pages.where(F.pmod(F.xxhash64("url", F.length("html")), F.lit(1 << 30)) / (1 << 30) < share)
    rows = chosen.select("html").mapInArrow(_count, "t string, i long, o long, n long").groupBy("t").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("n").alias("n"))
    named = F.col("t").startswith(".")
    rows = rows.where(~named | (F.col("i") == 0) & (F.col("n") >= config.least_pages)).collect()  # of class names, those a sample of bounded size holds so often
    counts = {r["t"]: (r["i"], r["o"]) for r in rows if not r["t"].startswith(".")}
    if not counts.get("word", (0, 0))[0]:
        return dict(_DEFAULT), frozenset()
    ratio = lambda t: float(np.log((counts[t][1] + 1) / (counts[t][0] + 1)))
    base = ratio("word")  # far below 0: words lie inside
    out = dict(_DEFAULT)
    for t in TAGS:
        seen = sum(counts.get(t, (0, 0)))
        out[t] = -min(8.0, max(0.05, ratio(t) - base)) if seen >= 10 else _DEFAULT[t]
    if counts.get("outside", (0, 0))[1] >= 10:
        out["outside"] = -min(6.0, max(0.05, ratio("outside")))
    return out, frozenset(r["t"][1:] for r in rows if r["t"].startswith("."))


def extract_pages(pages: DataFrame, config: HtmlConfig = HtmlConfig()) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    common.prepare(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    weights, learned = learn(slim, config)

    def run(batches):
        for b in batches:
            texts = [extract(x, weights, learned) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, RESULT)
