"""Main text of web pages by tree scoring.

Every paragraph gives points for its length and its commas to the containers above it (all to the nearest, half to the next, then a third, a
quarter ...) and a container's points are discounted by the share of its text that stands in links. The best container names the article: an article
element around it is kept whole, and so is the container itself; of the main element around them (the page, where neither element is) all is kept that is
not a list of links, headings, lists, tables and short paragraphs too, and an h1 above when there is none inside. Menus, page headers, footers, asides,
adverts, forms, scripts, styles, reader comments and what is hidden are left out wherever they stand. Elements named related, share, notice and the like
score half; they are left out as lists of links, and outside of article and main when no long paragraph is in them. Inside what is kept nothing is dropped.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by one line feed in page order. Null and empty
pages, and pages without text, give an empty text. Broken markup never fails: open elements end where an outer one ends. A page is worked on by
itself in one pass over its tags, so equal and repeated rows give equal results and nothing is shuffled.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import blocks, query, table, whole

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>(?:\"[^\"<]*\"|'[^'<]*'|[^\"'<>])*+))>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>]*+)>|<[!?][^<>]*+>", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "xmp"}
_ENDS = {tag: re.compile(rf"</{tag}\b[^<>]*>", re.I) for tag in _RAW}
_OUT = {"head", "title", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
_LEAF = {"p", "pre", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "summary", "caption"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCK = _OUT | _LEAF | {"html", "body", "article", "main", "section", "div", "header", "blockquote", "ul", "ol", "dl", "table", "tbody", "thead",
                         "tfoot", "tr", "figure", "details", "address", "center", "hr"}
_SAME = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|popup|modal|subscribe|newsletter|signup|comments?|"
    r"commentlist|respond|repl(?:y|ies)|disqus|sidebar|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|"
    r"site-?header|masthead|pagination|pager|contentinfo|complementary)(?:$|[\s_-])", re.I)
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|layout)[_-]\S*", re.I)  # names of what stands beside an element, or does not
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:notice|share|sharing|social|related|recommend\w*|widget|search)(?:$|[\s_-])", re.I)
_BONUS = {"article": 10.0, "main": 10.0, "div": 2.0, "section": 2.0, "blockquote": 1.0}


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name, the first of a name; quotes taken off, empty for a bare name."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def _hidden(has: dict[str, str]) -> bool:
    return ("hidden" in has and has["hidden"].strip().lower() != "until-found" or has.get("aria-hidden", "").strip().lower() == "true"
            or bool(_UNSEEN.search(has.get("style", ""))))


class _Tree:
    """Elements that make blocks, as parallel lists, and the blocks of text in page order."""

    def __init__(self):
        self.tag, self.parent, self.out = ["#"], [-1], [False]
        self.doubtful: set[int] = set()
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.open = [0]
        self.parts: list[str] = []
        self.links = self.linked = 0

    def settle(self):
        """Doubtful elements go with all below them when they are lists of links, and outside of article and main also when they hold no long paragraph."""
        if not self.doubtful:
            return
        n = len(self.tag)
        chars, linked, long, held = [0] * n, [0] * n, [False] * n, [False] * n
        for node, text, in_links in self.blocks:
            chars[node] += len(text)
            linked[node] += in_links
            long[node] = long[node] or len(text) > 80 and in_links < 0.25 * len(text)
        for node in range(n - 1, 0, -1):  # children come after their parents
            above = self.parent[node]
            chars[above] += chars[node]
            linked[above] += linked[node]
            long[above] = long[above] or long[node]
        for node in range(1, n):
            held[node] = held[self.parent[node]] or self.tag[node] in ("article", "main")
            self.out[node] = (self.out[node] or self.out[self.parent[node]]
                              or node in self.doubtful and (linked[node] >= 0.5 * chars[node] or not (long[node] or held[node])))
        self.blocks = [x for x in self.blocks if not self.out[x[0]]]

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text and not self.out[self.open[-1]]:
            self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def text(self, raw: str):
        if raw and not self.out[self.open[-1]]:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.links:
                self.linked += len(plain)

    def start(self, tag: str, attributes: str):
        self.flush()
        self.links = 0
        if self.tag[self.open[-1]] == "p":
            self.open.pop()
        while self.tag[self.open[-1]] in _SAME.get(tag, ()):
            self.open.pop()
        if tag == "hr":
            return
        above = self.open[-1]
        out = self.out[above] or tag in _OUT
        doubtful = False
        if not out and attributes and tag not in ("html", "body", "article", "main"):
            has = _attributes(attributes)
            # the id of a heading is made of its words
            names = " ".join(has[x] for x in ("class", "id", "role") if x in has and (x != "id" or tag not in _HEADINGS))
            names = _LAYOUT.sub("", names)
            out = bool(names and _UNWANTED.search(names)) or has.get("role", "").strip().lower() == "search" or _hidden(has)
            doubtful = not out and bool(names and _DOUBTFUL.search(names))
        if tag == "header" and not any(self.tag[i] in ("article", "main") for i in self.open):
            out = True
        self.tag.append(tag)
        self.parent.append(above)
        self.out.append(out)
        if doubtful:
            self.doubtful.add(len(self.tag) - 1)
        self.open.append(len(self.tag) - 1)

    def end(self, tag: str):
        self.flush()
        self.links = 0
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                del self.open[depth:]
                return
            if tag in _LEAF and self.tag[self.open[depth]] not in _LEAF:
                return


def _parse(page: str) -> _Tree:
    tree, at, skip_to = _Tree(), 0, 0
    for mark in _MARK.finditer(page):
        if mark.start() < skip_to:
            continue
        tree.text(page[at:mark.start()])
        at = mark.end()
        tag = (mark[2] or mark[5] or "").lower()
        closing = bool(mark[1] or mark[4])
        if tag in _RAW and not closing:
            end = _ENDS[tag].search(page, at)
            at = skip_to = end.end() if end else len(page)
        elif tag in _BLOCK:
            if closing:
                tree.end(tag)
            else:
                tree.start(tag, mark[3] or mark[6] or "")
        elif tag == "a":
            tree.links = 0 if closing else 1
        elif tag in ("br", "img", "input", "wbr"):
            tree.text(" ")
    tree.text(page[at:])
    tree.flush()
    tree.settle()
    return tree


def main_text(page: str) -> str:
    tree = _parse(page)
    if not tree.blocks:
        return ""
    n = len(tree.tag)
    points, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, in_links in tree.blocks:
        if tree.tag[node][0] != "h" or tree.tag[node] in ("html", "header"):
            worth = (len(text) >= 25) + text.count(",") + text.count("、") + min(len(text) / 100, 3.0)
            holder, level = (tree.parent[node] if tree.tag[node] in _LEAF else node), 1
            while holder > 0 and level <= 5:
                points[holder] += worth / level
                holder, level = tree.parent[holder], level + 1
        chars[node] += len(text)
        linked[node] += in_links
    for node in range(n - 1, 0, -1):  # children come after their parents
        chars[tree.parent[node]] += chars[node]
        linked[tree.parent[node]] += linked[node]
    score = [(points[i] + _BONUS.get(tree.tag[i], 0.0)) * (1 - linked[i] / chars[i]) if points[i] and chars[i] else 0.0 for i in range(n)]
    for i in tree.doubtful:
        score[i] *= 0.5
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        best = max((i for i in range(n) if tree.tag[i] in ("article", "main") and chars[i]), key=lambda i: chars[i], default=0)
    above = [best]
    while above[-1] > 0:
        above.append(tree.parent[above[-1]])
    path = set(above)
    held = [i for i in above if tree.tag[i] in ("article", "main")]
    root = held[-1] if held else 0
    keep, near = [False] * n, [False] * n  # kept whole; kept without its link lists
    keep[next((i for i in reversed(held) if tree.tag[i] == "article"), best)] = keep[best] = near[root] = True
    for i in range(1, n):
        if tree.parent[i] in (tree.parent[best], tree.parent[root]) and i not in path and chars[i] and not tree.out[i]:
            if score[i] >= max(10.0, 0.2 * score[best]) or tree.tag[i] == "p" and chars[i] > 80 and linked[i] < 0.25 * chars[i]:
                keep[i] = True
    for i in range(1, n):
        keep[i] = keep[i] or keep[tree.parent[i]]
        near[i] = near[i] or near[tree.parent[i]]

    def wanted(node: int, text: str, in_links: int) -> bool:
        if keep[node]:
            return True
        if not near[node] or in_links >= 0.5 * len(text):
            return False
        holder = tree.parent[node] if tree.tag[node] in _LEAF else node
        return len(text) > 80 or tree.tag[node] == "h1" or linked[holder] < 0.5 * chars[holder]

    kept = [wanted(*block) for block in tree.blocks]
    headed = any(k and tree.tag[node] == "h1" for k, (node, _, _) in zip(kept, tree.blocks))
    return "\n".join(text for k, (node, text, in_links) in zip(kept, tree.blocks)
                     if k or not headed and tree.tag[node] == "h1" and in_links < 0.5 * len(text))


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and the text of every row."""
    rows = pages.select(*keep, whole(page).alias("_page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_page").schema) + ", text string"

    def run(batches):
        for block in blocks(batches, "_page"):
            texts = [main_text(x) for x in block.column("_page").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, schema)


@query("op7_html_text")
def html_text(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
