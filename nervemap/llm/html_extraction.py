"""Main text of web pages by consensus of their host.

Every page scores its containers and votes for the generalised tag-class path of the one that holds its article. Votes
are counted per host with map-side combined aggregates; every page is then read again with its host's winning path. Where that path holds
less than half of what the page's own choice does, the path above it is tried, and so on; a page without any keeps its own choice.

What an element is called never takes a heading out, and a paragraph only by a class that says nothing else. Of other elements those go that
by their names are menus, adverts, remarks and the like and nothing else; where a name only has such a part ("social-history"), what stands in the element
decides. A form goes unless it wraps the page's text.

Reading a page takes time and memory in proportion to its length, however its tags are nested or left open.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nervemap.runtime import materialize, trimmed

#: Hosts with a path of their own up to which these are broadcast (about 100 bytes each); beyond, pages are joined by shuffle.
BROADCAST_HOSTS = 300_000
#: Share of a container's text that one inside it must hold to be entered.
ENTER = 0.7
#: Share of the text of a page's own choice that the host's path must hold there.
HOLD = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_HOLDER = frozenset("html body article main section div td center blockquote table tbody tr".split())
_NEVER = frozenset("head nav footer aside script style noscript template svg canvas button select textarea label menu dialog iframe object video audio map search title datalist".split())
_KEEP = frozenset("html body article main".split())
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sidebar sidenav menu nav navbar navigation comment comments commentlist disqus respond footer cookie cookies consent gdpr notice notices banner promo promotion share sharing social related breadcrumb breadcrumbs popup modal overlay newsletter subscribe subscription sponsor sponsored widget widgets toolbar pagination pager login signup masthead skip alert recommended".split()
)
#: Parts of names that say nothing of what an element holds: beside a part of the above a name is still that of noise.
_NEUTRAL = frozenset(
    "a area article articles bar block bottom box button buttons col column container content contents entry form group header heading icon icons id inner item items js left link links list main more new of outer page panel post posts primary right row section secondary site slot small space story tab the title top unit user view wrap wrapper".split()
)
_NOISE_WHOLE = frozenset("header site-header page-header top-header global-header".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An open element of the second kind ends one of the first, unless one of the third stands between.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
#: Parts of a class name that only say how a page is laid out: such a name is no noise.
_LAYOUT_FIRST, _LAYOUT_LAST = frozenset("no without has with".split()), frozenset("open closed enabled disabled on off".split())
#: Noise by name that stays out even where a page has no other text.
_REMARKS = frozenset("comment comments commentlist disqus respond".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_QUOTE = re.compile(r"""["']""")
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[-_:]+|\d+")
_PROSE = _HEADINGS | {"p", "blockquote", "pre"}
#: How an element is left out: not, by the names it bears, by what it is; or what stands in it says so: of a doubtful name, or a form.
KEPT, NAMED, GONE, DOUBT, FORM = range(5)


@dataclass
class Page:
    """Elements by number, parents first, and blocks of text.

    ``path``: number of the element's generalised path among those of the page; ``step``: of a path its parent's and its last label.
    ``holder``: the nearest element around, or itself, that can be a container.
    """

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    holder: list[int] = field(default_factory=lambda: [0])
    left_out: list[int] = field(default_factory=lambda: [KEPT])
    step: list[tuple[int, str]] = field(default_factory=lambda: [(0, "")])
    known: dict[tuple[int, str], int] = field(default_factory=dict)
    suspects: list[tuple[int, int]] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path_text(self, node: int) -> str:
        labels, at = [], self.path[node]
        while at:
            at, label = self.step[at]
            labels.append(label)
        return "".join(f"/{x}" for x in reversed(labels))

    def path_number(self, text: str) -> int | None:
        at = 0
        for label in text.split("/")[1:]:
            at = self.known.get((at, label))
            if at is None:
                return None
        return at


def _noise(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    if tag in _NEVER or (tag == "header" and not in_article):
        return GONE
    if not attrs:
        return FORM if tag == "form" else KEPT
    if tag in _KEEP:
        return KEPT
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return GONE
    if attrs.get("role", "").lower() in _NOISE_ROLE:
        return GONE
    if tag == "form":
        return FORM
    if tag in _HEADINGS:
        return KEPT
    doubt = KEPT
    # an id marks a place: only one that is a name of noise and no more says what the element is, and of a paragraph none does
    ids = [] if tag in _PROSE else [(x, True) for x in attrs.get("id", "").lower().split()]
    for name, is_id in [*((x, False) for x in attrs.get("class", "").lower().split()), *ids]:
        parts = [x for x in _SPLIT.split(name) if x]
        if not parts or parts[0] in _LAYOUT_FIRST or parts[-1] in _LAYOUT_LAST:
            continue
        noisy = not _NOISE.isdisjoint(parts)
        if name in _NOISE_WHOLE or noisy and (len(parts) == 1 if is_id else all(x in _NOISE or x in _NEUTRAL for x in parts)):
            return GONE if not _REMARKS.isdisjoint(parts) else NAMED
        if noisy and tag not in _PROSE:
            doubt = DOUBT
    return doubt


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


class _Marks:
    """Where tags of a page end. A quoted value may hold a ``>``; a quote that would swallow the rest of the page counts as a character, and from then on all do."""

    def __init__(self, html: str):
        self.html, self.quotes, self.last = html, True, html.rfind(">")

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        html = self.html
        if at > self.last:
            return -1
        gt = html.find(">", at)
        if not self.quotes:
            return gt
        pos = at
        while True:
            m = _QUOTE.search(html, pos, gt)
            if m is None:
                return gt
            pos = html.find(m[0], m.end()) + 1
            if not pos:
                break
            if pos > gt:
                gt = html.find(">", pos)
                if gt < 0:
                    break
        self.quotes = False
        return html.find(">", at)


class _Open:
    """The stack of open elements, with what has to be asked of it answered without a search."""

    def __init__(self):
        self.nodes, self.names, self.blocks = [0], [""], [0]
        self.at: dict[str, list[int]] = {}

    def push(self, node: int, name: str) -> None:
        if name in _BLOCK:
            self.blocks.append(len(self.names))
        self.at.setdefault(name, []).append(len(self.names))
        self.nodes.append(node)
        self.names.append(name)

    def last(self, names: frozenset[str] | tuple[str, ...]) -> int:
        """Depth of the innermost open element of these names; 0 if none is."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def first_above(self, names: frozenset[str], depth: int) -> int:
        """Depth of the outermost open element of these names that is deeper than ``depth``; 0 if none is."""
        found = [own[i] for n in names if (own := self.at.get(n)) and (i := bisect_right(own, depth)) < len(own)]
        return min(found, default=0)

    def pop(self) -> str:
        self.nodes.pop()
        name = self.names.pop()
        self.at[name].pop()
        if name in _BLOCK:
            self.blocks.pop()
        return name


def parse(html: str) -> Page:
    page, stack, marks = Page(), _Open(), _Marks(html)
    pending: list[str] = []
    found: list[tuple[int, str, int]] = []
    raw_end: dict[str, re.Pattern] = {}
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if pending:
            node = stack.nodes[-1]
            text = " ".join("".join(pending).split())
            if text and page.left_out[node] != GONE:
                found.append((node, text, min(links, len(text))))
            pending.clear()
            links = 0

    def close(depth: int) -> None:
        nonlocal in_link
        if stack.blocks[-1] >= depth:
            flush()
        while len(stack.names) > depth:
            in_link -= stack.pop() == "a"

    controls: dict[int, int] = {}

    def text(raw: str) -> None:
        nonlocal links
        if page.left_out[stack.nodes[-1]] == GONE:
            controls[stack.nodes[-1]] = controls.get(stack.nodes[-1], 0) + len(raw.strip())
        else:
            x = unescape(raw) if "&" in raw else raw
            pending.append(x)
            if in_link:
                links += len(x)

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        at = lt + 1
        sign = html[at : at + 1]
        if sign in ("!", "?"):
            if html.startswith("!--", at):
                stop = html.find("-->", lt + 2)
                at = end if stop < 0 else max(lt + 4, stop + 3)
            else:
                stop = html.find(">", at)
                at = end if stop < 0 else stop + 1
            continue
        m = _NAME.match(html, at + 1 if sign == "/" else at)
        stop = -1 if m is None else marks.end(m.end())
        if stop < 0:
            text("<")
            continue
        tag, rest, at = m[0].lower(), html[m.end() : stop], stop + 1
        if sign == "/":
            if depth := stack.last((tag,)):
                close(depth)
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in _BLOCK:
            if stack.names[stack.blocks[-1]] == "p":
                close(stack.blocks[-1])
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                floor = stack.last(stops)
                depth = stack.first_above(ends, floor) if tag == "tr" else stack.last(ends)
                if depth > floor:
                    close(depth)
            flush()
        if tag in _VOID:
            continue
        if tag in _RAW:
            if tag not in raw_end:
                raw_end[tag] = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)
            m = raw_end[tag].search(html, at)
            at = end if m is None else html.find(">", m.start()) + 1 or end
            continue
        attrs = _attributes(rest)
        up, node = stack.nodes[-1], len(page.tag)
        page.tag.append(tag)
        page.parent.append(up)
        holds = tag in _HOLDER
        page.holder.append(node if holds else page.holder[up])
        path = page.path[up]
        if holds:
            label = tag
            if "class" in attrs:
                label += "".join("." + c for c in sorted({_DIGITS.sub("#", c) for c in attrs["class"].lower().replace("/", "|").split()}))
            path = page.known.setdefault((path, label), len(page.step))
            if path == len(page.step):
                page.step.append((page.path[up], label))
        page.path.append(path)
        own = _noise(tag, attrs, bool(stack.last(("article", "main"))))
        page.left_out.append(GONE if GONE in (own, page.left_out[up]) else KEPT)
        if own not in (KEPT, GONE):
            page.suspects.append((node, own))
        if rest.endswith("/") and tag not in _BLOCK:
            continue
        stack.push(node, tag)
        in_link += tag == "a"
    flush()
    page.blocks = _judged(page, found, controls)
    return page


def _judged(page: Page, found: list[tuple[int, str, int]], controls: dict[int, int]) -> list[tuple[int, str, int]]:
    """The blocks that stand in no element which its name, or what it holds, leaves out."""
    if not page.suspects:
        return found
    n = len(page.tag)
    text, links, prose, control = ([0] * n for _ in range(4))
    for node, t, k in found:
        text[node] += len(t)
        links[node] += k
        if page.tag[node] in _PROSE:
            prose[node] += len(t)
    for node, k in controls.items():
        control[node] += k
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        for counts in (text, links, prose, control):
            counts[up] += counts[node]
    forms, named = [False] * n, [False] * n
    for node, kind in page.suspects:
        if kind == FORM:
            # one around the page's text stays
            forms[node] = not (text[node] > control[node] and 2 * text[node] >= text[0])
        else:
            named[node] = kind == NAMED or 2 * links[node] >= text[node] or not prose[node]
    for node in range(1, n):
        up = page.parent[node]
        forms[node], named[node] = forms[node] or forms[up], named[node] or named[up]
    found = [x for x in found if not forms[x[0]]]
    kept = [x for x in found if not named[x[0]]]
    # nothing but links is left: a name told the wrong thing
    return kept if any(len(t) > 1.5 * k for _, t, k in kept) else found


def best_container(page: Page) -> int:
    return _best(page, *_scores(page))


def _scores(page: Page) -> tuple[list[float], list[float]]:
    """By element, how much text it holds beside links, and how much of it stands in paragraphs and headings right below it."""
    score, own = [0.0] * len(page.tag), [0.0] * len(page.tag)
    for node, text, links in page.blocks:
        value = max(0.0, len(text) - 1.5 * links)
        score[node] += value
        if page.tag[node] == "p" or page.tag[node] in _HEADINGS:
            own[page.holder[page.parent[node]]] += value
    for node in range(len(score) - 1, 0, -1):
        score[page.parent[node]] += score[node]
    return score, own


def _best(page: Page, score: list[float], own: list[float]) -> int:
    """The innermost element that holds most of the article.

    An article or main element that does is entered from anywhere, and never left for one inside it. Other elements aren't left for one inside if
    they have paragraphs or headings of their own beside it, but the page's body is.
    """
    best: dict[int, int] = {}
    marked = 0
    for node in range(1, len(score)):
        if page.tag[node] in _HOLDER:
            up = page.holder[page.parent[node]]
            if score[node] > score[best.get(up, 0)] or up not in best:
                best[up] = node
            if page.tag[node] in ("article", "main") and score[node] >= ENTER * score[0] > 0:
                marked = marked or node
    if marked:
        return marked
    node = 0
    while page.tag[node] not in ("article", "main") and (inside := best.get(node)):
        if score[inside] <= 0 or score[inside] < ENTER * score[node]:
            break
        if own[node] > 0 and page.tag[node] not in ("", "html", "body"):
            break
        node = inside
    return node


def article(page: Page, path: str | None) -> str:
    """The blocks below all elements with the path, or with the nearest path above it, that hold ``HOLD`` or more of the text of the page's own best
    container; if there are none, below that one and those with the path."""
    score, own = _scores(page)
    best = _best(page, score, own)
    chosen = {best}
    if number := page.path_number(path) if path else None:
        holds = [0.0] * len(page.step)
        for n in range(1, len(page.tag)):
            if page.holder[n] == n:  # elements of one path don't stand in one another
                holds[page.path[n]] += score[n]
        shared = number
        while number and not (holds[number] > 0 and holds[number] >= HOLD * score[best]):
            number = page.step[number][0]
        found = {n for n in range(1, len(page.tag)) if page.path[n] == (number or shared) and page.holder[n] == n}
        chosen = found if number else chosen | found
    within = [0 in chosen] * len(page.tag)
    for n in range(1, len(page.tag)):
        within[n] = n in chosen or within[page.parent[n]]
    return "\n\n".join(t for node, t, _ in page.blocks if within[node])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for html in batch["html"]:
            page = parse(html.as_py() or "")
            paths.append(page.path_text(best_container(page)) if page.blocks else None)
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(paths, pa.string())], ["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [article(parse(h.as_py() or ""), p.as_py()) for h, p in zip(batch["html"], batch["path"], strict=True)]
        out = batch.drop_columns(["html", "path"])
        yield out.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path that most pages of the host vote for; ties go to the longer path, then the later in order."""
    slim = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = slim.mapInArrow(trimmed(_vote), "host string, path string").where("path is not null and path <> ''")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("host").agg(F.max(F.struct("n", F.length("path").alias("size"), "path"))["path"].alias("path"))


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    A null or empty html gives an empty text. Pages without a url, or a host, form one host of their own. Repeated rows get a row
    each. An empty table gives an empty result. Other columns play no part.
    """
    winners = materialize(host_paths(pages, url_col, html_col), "host-paths")
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = slim.join(winners, "host", "left").select("id", "url", "html", "path")
    out = joined.mapInArrow(trimmed(_extract), f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
