"""Main text of web pages by composite text density.

A page is read into a small tree (elements only).  With ``C`` characters,
``T`` tags, ``L`` link characters and ``K`` link tags of a subtree (zeros read
as one) and those of the body, a node's density is

    C / T * log_b( C / L * T / K ),  b = ln( C / (C - L) * L + Lbody / Cbody * C + e )

(characters per tag, less for many links).  A node's density sum adds its
children's densities.  The node with the largest sum is the core; the least
density on the path from the core up to the body is the threshold.  The chosen
subtree is the nearest article, main or body above the core; of the siblings
met on the way up, those less dense than the threshold whose subtrees hold no
heading or paragraph text (list items, cells, captions, terms, quotations and
addresses count outside links) are left out, each by itself.

Elements that are never main text by their meaning (scripts, styles, forms,
menus, footers, page headers, sidebars) are dropped before densities are
computed, and so are those named as adverts, menus, notices or comments unless
they hold the main element, the article (the longest), the h1 or most of the
page's text outside links, as layout wrappers do; comments beside an article
are dropped however long.

Defined results: null, empty or text-free pages give ''; unclosed elements are
closed by the rules for paragraphs and list items, or at the end; character
references are decoded; white space inside a block is one space; blocks are
joined in page order by two newlines.  Whole pages are read, whatever their
length; the work is linear in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from demandlens.llm.common import prepare

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>", re.S)
_NAME = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, raw text, blocks
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg math iframe title head object canvas select".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody
tfoot thead tr ul caption""".split())
_ENDS_P = _BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption"}
_SAME = {"li": "li", "dd": "dl", "dt": "dl", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_NOISE_TAGS = frozenset("nav footer aside form button dialog menu label fieldset".split())
_NOISE_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion
menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer comment comments respond disqus reply replies
cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related
pagination pager toolbar widget login search masthead copyright complementary contentinfo""".split())
_KEEP = frozenset("article main body html".split())
_COMMENTS = frozenset("comment comments respond disqus reply replies".split())
# Elements whose text is a heading or paragraph, those whose text is one outside links, and those kept as they are
_TITLES = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_PASSAGES = frozenset("address blockquote dd details dt figcaption li pre summary td th".split())
_PLAIN = _TITLES | frozenset("b i em strong br span header hgroup figcaption blockquote ul ol li pre table section".split())


def _is_noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _NOISE_TAGS or (tag == "header" and not in_article):
        return True
    return bool(attrs) and tag not in _KEEP and _HIDDEN.search(attrs) is not None


def _named(tag: str, attrs: str) -> int:
    """2 for elements named as comments, 1 for other names of noise."""
    found: set[str] = set()
    if attrs and tag not in _KEEP:
        for m in _NAME.finditer(attrs):
            found |= _NOISE_NAMES.intersection(_WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
    return (1 + (not found.isdisjoint(_COMMENTS))) if found else 0


class _Tree:
    """Parallel lists of the kept elements, and the text runs in page order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.named = ["html"], [0], [0]
        self.runs: list[tuple[int, str, bool]] = []     # (node, text, starts a block)

    def add(self, tag: str, parent: int, named: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.named.append(named)
        return len(self.tag) - 1


def _parse(page: str) -> _Tree:
    tree, open_, noise, articles = _Tree(), [("html", 0, False)], 0, 0
    new_block, at, end, last = True, 0, len(page), page.rfind(">") + 1
    count: Counter = Counter()          # open elements by tag
    endless: set[str] = set()           # raw tags that are not closed any more

    def text(a: int, b: int) -> None:
        nonlocal new_block
        if a < b and not noise:
            s = html.unescape(page[a:b])
            tree.runs.append((open_[-1][1], s, new_block))
            new_block = False

    def pop() -> None:
        nonlocal noise, articles
        tag, _, hidden = open_.pop()
        count[tag] -= 1
        noise -= hidden
        articles -= tag in ("article", "main")

    while at < end:
        m = _TOKEN.search(page, at, last)      # without a later ">" no tag can end
        if not m:
            break
        text(at, m.start())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK or tag in ("td", "th"):
            new_block = new_block or tag in _BLOCK
            if tag not in _BLOCK:
                text_break(tree, open_, noise)
        elif tag == "br":
            text_break(tree, open_, noise)
        if m["close"] or m["close2"]:
            if count[tag]:
                while open_[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            if tag not in endless and not m.group().endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                else:
                    endless.add(tag)
                if not stop and tag in ("script", "style", "textarea"):
                    at = end
            continue
        if tag in _ENDS_P and any(x[0] == "p" for x in open_[-8:]):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    while len(open_) > k:
                        pop()
                    break
                if open_[k][0] in _BLOCK:
                    break
        if tag in _SAME:
            for k in range(len(open_) - 1, 0, -1):
                t = open_[k][0]
                if _SAME.get(t) == _SAME[tag]:
                    while len(open_) > k:
                        pop()
                    break
                if t in ("ul", "ol", "dl", "table", "menu"):
                    break
        if tag in _VOID or m.group().endswith("/>"):
            if not noise:
                tree.add(tag, open_[-1][1], _named(tag, m["attrs"] or ""))
            continue
        hidden = _is_noise(tag, m["attrs"] or "", articles > 0)
        noise += hidden
        named = 0 if noise else _named(tag, m["attrs"] or "")
        open_.append((tag, open_[-1][1] if noise else tree.add(tag, open_[-1][1], named), hidden))
        count[tag] += 1
        articles += tag in ("article", "main")
    text(at, end)
    return tree


def text_break(tree: _Tree, open_: list, noise: int) -> None:
    if not noise:
        tree.runs.append((open_[-1][1], " ", False))


def _drop_named(tree: _Tree) -> None:
    """Take the elements named as noise out of the tree, but for those that hold
    the main element, the article, the h1 or most of the text outside links."""
    n = len(tree.tag)
    if not any(tree.named):
        return
    # nodes are in page order, so a subtree is a range: node .. last[node]
    link, plain, last, noise = [False] * n, [0] * n, list(range(n)), [0] * n
    for i in range(1, n):
        p = tree.parent[i]
        link[i] = link[p] or tree.tag[i] == "a"
        noise[i] = max(noise[p], tree.named[i])
    for node, s, _ in tree.runs:
        if not link[node]:
            plain[node] += len(s.strip())
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        plain[p] += plain[i]
        last[p] = max(last[p], last[i])
    marks = {}
    for tag in ("main", "article", "h1"):
        some = [i for i in range(n) if tree.tag[i] == tag and (plain[i] or tag == "h1")]
        if some:        # the h1 is the first outside noise, the others the longest outside comments
            marks[tag] = min(some, key=lambda i: (noise[i], i)) if tag == "h1" else \
                min(some, key=lambda i: (noise[i] == 2, -plain[i], i))
    text = marks.get("article")
    gone = [False] * n
    for i in range(1, n):
        if gone[tree.parent[i]]:
            gone[i] = True
        elif tree.named[i]:
            apart = tree.named[i] == 2 and text is not None and not i <= text <= last[i] and not text <= i <= last[text]
            gone[i] = not any(i <= k <= last[i] for k in marks.values()) and (2 * plain[i] <= plain[0] or apart)
    new, kept = [0] * n, [i for i in range(n) if not gone[i]]
    for at, i in enumerate(kept):
        new[i] = at
    runs, starts = [], False
    for node, s, block in tree.runs:
        starts = starts or block
        if not gone[node]:
            runs.append((new[node], s, starts))
            starts = False
    tree.tag, tree.parent, tree.runs = [tree.tag[i] for i in kept], [new[tree.parent[i]] for i in kept], runs


def _densities(tree: _Tree) -> tuple[list[float], list[float]]:
    n = len(tree.tag)
    chars, tags, lchars, ltags = [0] * n, [0] * n, [0] * n, [0] * n
    link = [False] * n
    for i in range(1, n):
        link[i] = link[tree.parent[i]] or tree.tag[i] == "a"
    for node, s, _ in tree.runs:
        c = len(s) if s.isspace() is False else 0
        chars[node] += c
        if link[node]:
            lchars[node] += c
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        lchars[p] += lchars[i]
        tags[p] += tags[i] + 1
        ltags[p] += ltags[i] + (tree.tag[i] == "a")
    share = lchars[0] / max(chars[0], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        if not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), max(lchars[i], 1), max(ltags[i], 1)
        base = math.log(c / max(c - lchars[i], 1) * lchars[i] + share * c + math.e)
        density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(max(base, 1.0 + 1e-9)), 1e-3) \
            if base > 1.0 + 1e-9 else c / t
    for i in range(1, n):
        sums[tree.parent[i]] += density[i]
    return density, sums


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tree = _parse(page)
    _drop_named(tree)
    density, sums = _densities(tree)
    n = len(tree.tag)
    core = max(range(n), key=lambda i: (sums[i], -i)) if n > 1 else 0
    path, i = [core], core
    while i:
        i = tree.parent[i]
        path.append(i)
    threshold = min(density[i] for i in path)
    # up to the article or body; on the way only thin siblings without headings or paragraphs are left out
    chosen, kids, left_out = core, {}, set()
    for i in range(1, n):
        kids.setdefault(tree.parent[i], []).append(i)
    titled = _titled(tree)
    for i in path[1:]:
        if tree.tag[i] == "html":
            break
        left_out.update(k for k in kids[i] if k != chosen and 0 < density[k] < threshold and not titled[k])
        chosen = i
        if tree.tag[i] in ("article", "main", "body"):
            break
    inside = [chosen == 0] * n
    inside[chosen] = True
    for i in range(1, n):
        inside[i] = (inside[i] or inside[tree.parent[i]]) and i not in left_out
    blocks: list[list[str]] = [[]]
    for node, s, starts in tree.runs:
        if starts and blocks[-1]:
            blocks.append([])
        if inside[node]:
            blocks[-1].append(s)
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def _titled(tree: _Tree) -> list[bool]:
    """Whether a subtree holds headings or paragraphs; they belong to the text however short they are."""
    n = len(tree.tag)
    link, kind, out = [False] * n, [0] * n, [False] * n
    for i in range(1, n):
        p, t = tree.parent[i], tree.tag[i]
        link[i] = link[p] or t == "a"
        kind[i] = max(kind[p], 2 if t in _TITLES else 1 if t in _PASSAGES else 0)
    for node, s, _ in tree.runs:
        if not s.isspace() and (kind[node] == 2 or kind[node] == 1 and not link[node]):
            out[node] = True
    for i in range(n - 1, 0, -1):
        out[tree.parent[i]] |= out[i]
    return [held or t in _PLAIN for held, t in zip(out, tree.tag)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars."""
    prepare(pages.sparkSession)
    cols = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return cols.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
