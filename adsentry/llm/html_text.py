"""HTML extraction by tree scoring.

A page becomes a tree; every paragraph (a run of text that no block-level tag interrupts) has points: one, plus one for
each comma and for each hundred characters up to three, times the share of its text outside links. The container around
it gets all of them, and each container further out half of what the one inside it has. The container with the most
points, discounted by its link density, wins. If it lies in an article element, all of that is the main text; else the
siblings that belong to it are kept with it, and those of the containers around it: headings, paragraphs, and sections
that have points of their own or sentences without many links.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are known by their tag, role, class or id, and
take no part. But a part named so stays if it holds an article or main element with most of its text, or, on a page
without such elements and unless it is named for comments, more than half of the page's text: a form or a "page
has-sidebar" around everything is no form and no sidebar. Names that may also mean a topic, such as related or share, only mark short parts and parts of links.

Time and memory grow with the length of a page, however deep its tags are nested. Nulls: a null page counts as empty, and
an empty page gives the empty text. Broken markup never fails: tags without an end last as long as their parent, ends
without a beginning are ignored. Null and repeated ids are passed on, and an empty table gives an empty one. If no
container has points, all paragraphs that are left count. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# Fixed values of HTML: element names by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body br_ center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption summary".split())  # a paragraph's own element
CLOSES_P = BLOCK - {"br_"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table body article section div".split())
UNWANTED = set("audio button canvas datalist embed head iframe input noscript option script select style svg template textarea title video".split())
SUSPECT = set("aside dialog footer form menu nav".split())
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup paywall sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus replies reply respond pagination pager".split()
)
TOPICS = set("alert aside banner menu modal overlay promo promotion recommended recommendations related share sharing skip social toolbar widget".split())
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
INSIDE = {"article", "main"}
BOUNDS = {"table", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PAGES = "page_id long, url string, text string"


# What a tag's name and attributes say of it.
PLAIN, TOPIC, WRAPPER, MARKED, DROPPED = range(5)


def verdict(tag: str, attributes: str, inside: bool) -> int:
    if tag in UNWANTED:
        return DROPPED
    found = WRAPPER if tag in SUSPECT or tag == "header" and not inside else PLAIN
    if tag in ("html", "body", "main"):
        return PLAIN
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & COMMENTS and tag != "article":
                found = max(found, MARKED)
            elif words & MARKS or "header" in words and not inside:
                found = max(found, WRAPPER if tag != "article" else TOPIC)
            elif words & TOPICS:
                found = max(found, TOPIC)
            if tag == "article" and words <= COMMENTS | {"body", "item", "thread"} and words & COMMENTS:
                found = MARKED
        elif name == "role":
            if value.lower() in ROLES:
                found = max(found, WRAPPER)
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return DROPPED
        elif name == "hidden" or value.lower() == "true":
            return DROPPED
    return found


class Page:
    """The tree of a page: nodes in page order, and the paragraphs with the node that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.stop, self.verdict = ["#root"], [-1], [0], [PLAIN]
        self.paragraphs: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int, bool, bool]] = [("#root", 0, False, False)]  # tag, node, dropped, in an article
        self.places: dict[str, list[int]] = {}  # where each tag is open in the stack
        self.bounds: dict[str, list[int]] = {"scope": [], "table": []}  # where tags that stop a search for others are
        self.text: list[str] = []
        self.linked, self.links = 0, 0
        at, length = 0, len(source)
        last = source.rfind(">")
        while at < length:
            m = _TAG.search(source, at) if at <= last else None
            if m is None:
                self.add(source[at:])
                break
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if slash:
                self.close(name)
                continue
            self.open(name, attributes)
            if name in RAW:
                end = re.compile(f"</{name}\\s*>", re.I).search(source, at)
                self.close(name)
                at = end.end() if end else length
        self.pop_to(1)
        self.flush()
        self.stop[0] = len(self.tag)

    def add(self, text: str) -> None:
        if not self.stack[-1][2]:
            text = html.unescape(text)
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.paragraphs.append((self.stack[-1][1], text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name in ("br", "hr") and not self.stack[-1][2]:
                self.text.append(" ")
            return
        if name in CLOSES_P:
            self.flush()
            self.end("p")
        for other in SAME_ENDS.get(name, ()):
            self.end(other)
        _, above, dropped, inside = self.stack[-1]
        said = verdict(name, attributes, inside)
        if name in BLOCK:
            self.tag.append(name)
            self.parent.append(above)
            self.stop.append(0)
            self.verdict.append(said)
            above = len(self.tag) - 1
        dropped = dropped or said == DROPPED or said >= WRAPPER and name not in BLOCK
        self.links += name == "a"
        here = len(self.stack)
        self.stack.append((name, above, dropped, inside or name in INSIDE))
        self.places.setdefault(name, []).append(here)
        for kind, names in (("scope", SCOPE), ("table", BOUNDS)):
            if name in names:
                self.bounds[kind].append(here)

    def end(self, name: str) -> None:
        """Ends the open element, unless a list, table or section has begun since."""
        places, scope = self.places.get(name), self.bounds["scope"]
        if places and not (scope and scope[-1] > places[-1]):
            self.pop_to(places[-1])

    def close(self, name: str) -> None:
        places, table = self.places.get(name), self.bounds["table"]
        if places and not (table and table[-1] > places[-1] and name not in BOUNDS):
            self.pop_to(places[-1])

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name, node, _, _ = self.stack[-1]
            if name in BLOCK:
                self.flush()
                self.stop[node] = len(self.tag)
            self.links -= name == "a"
            self.places[name].pop()
            here = len(self.stack) - 1
            for open_ in self.bounds.values():
                if open_ and open_[-1] == here:
                    open_.pop()
            self.stack.pop()


def upwards(page: Page, own: list) -> list:
    """The sums of `own` over each node and all below it."""
    total = list(own)
    for i in range(len(total) - 1, 0, -1):
        total[page.parent[i]] += total[i]
    return total


def without_parts(page: Page) -> list[bool]:
    """Which nodes belong to a part that takes no part."""
    n = len(page.tag)
    own_chars, own_linked, own_core = [0] * n, [0] * n, [0] * n
    for node, text, in_links in page.paragraphs:
        own_chars[node] += len(text)
        own_linked[node] += in_links
    chars, linked = upwards(page, own_chars), upwards(page, own_linked)
    # text in article and main elements that no mark excludes, counted at the outermost one
    covered = [False] * n
    for i in range(1, n):
        core = page.tag[i] in INSIDE and page.verdict[i] < WRAPPER
        if core and not covered[page.parent[i]]:
            own_core[i] = chars[i]
        covered[i] = core or covered[page.parent[i]]
    core = upwards(page, own_core)
    out = [False] * n
    for i in range(1, n):
        said, out[i] = page.verdict[i], out[page.parent[i]]
        if out[i] or said == PLAIN:
            continue
        plain = chars[i] - linked[i]
        if said == TOPIC:
            out[i] = chars[i] < 80 or linked[i] > 0.3 * chars[i]
        elif said == DROPPED:
            out[i] = True
        elif 2 * core[i] <= chars[i] or page.tag[i] == "article":
            out[i] = said == MARKED or core[0] > 0 or 2 * plain <= chars[0] - linked[0]
    return out


def main_text(source: str | None) -> str:
    """The paragraphs of the best container and of what belongs to it, a line each."""
    page = Page(source or "")
    n = len(page.tag)
    out = without_parts(page)
    paragraphs = [x for x in page.paragraphs if not out[x[0]]]
    if not paragraphs:
        return ""
    points, chars, linked, sentences = [0.0] * n, [0] * n, [0] * n, [0] * n
    for node, text, in_links in paragraphs:
        own = (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)) * (1 - in_links / len(text))
        points[max(page.parent[node] if page.tag[node] in LEAF else node, 0)] += own
        chars[node] += len(text)
        linked[node] += in_links
        sentences[node] += text.endswith((".", "!", "?", "…", "。", ":", '"', "”"))
    chars, linked, sentences = upwards(page, chars), upwards(page, linked), upwards(page, sentences)
    for i in range(n - 1, 0, -1):
        points[page.parent[i]] += points[i] / 2
    value = [p * (1 - linked[i] / chars[i]) * (1.5 if page.tag[i] in INSIDE else 1) if chars[i] else 0.0 for i, p in enumerate(points)]
    best = max(range(n), key=lambda i: (value[i], -i))
    if value[best] <= 0:
        return "\n".join(text for _, text, _ in paragraphs)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parent[i]].append(i)

    def belongs(i: int, strict: bool) -> bool:
        tag, plain = page.tag[i], linked[i] <= 0.25 * chars[i]
        if not chars[i] or out[i]:
            return False
        if tag in HEADINGS or value[i] >= max(3.0, 0.2 * value[best]):
            return plain or value[i] >= max(3.0, 0.2 * value[best])
        if strict:
            return tag == "p" and plain and chars[i] > 80
        return plain and (tag in ("p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "section") or sentences[i] > 0)

    kept, up, article = [best], best, None
    while up > 0:
        if page.tag[up] == "article":
            article = up
        up = page.parent[up]
    here = best
    if article is not None:
        kept, here = [article], article
    while (above := page.parent[here]) >= 0:
        strict = page.tag[above] in ("#root", "html", "body")
        if article is None or here == article:
            kept += [i for i in children[above] if i != here and page.tag[i] not in ("html", "head", "body") and (belongs(i, strict) if article is None else value[i] >= max(3.0, 0.2 * value[best]))]
        if strict or article is not None:
            break
        here = above
    change = [0] * (n + 1)
    for i in kept:
        change[i] += 1
        change[page.stop[i]] -= 1
    for i in range(1, n + 1):
        change[i] += change[i - 1]
    return "\n".join(text for node, text, _ in paragraphs if change[node] > 0)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, PAGES)


def op4_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_tree_scoring": op4_tree_scoring}
