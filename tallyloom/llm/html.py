"""Main text of web pages by container paths that a host's pages agree on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen

# Names of the HTML standard, and words that sites use in classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template iframe svg math object canvas video audio "
    "select button textarea dialog menu datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd blockquote pre figcaption caption summary tr address".split())
GROUPS = frozenset(
    "html body main article section div center header hgroup ul ol dl table tbody thead tfoot figure details "
    "fieldset search".split()
)
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript template".split())
CELLS = frozenset("td th".split())
ENDS_P = LEAVES | GROUPS | LEFT_OUT - {"script", "style", "template", "noscript"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
SCOPES = frozenset("ul ol dl table".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments reply replies respond disqus cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations widget toolbar pagination pager paging skip login search footer masthead".split()
)
PAGE_HEADER = frozenset("header topbar".split())
GOOD = frozenset("article main content post entry story text body".split())
#: First and last words of class names that tell a state of the page.
STATE_FIRST, STATE_LAST = frozenset("has no with without".split()), frozenset("open closed enabled disabled".split())
NEVER_NOISE = frozenset("html body main article".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
UNENDED = re.compile(r"<!--.*\Z|<!\[CDATA\[.*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A group with a class of noise words only is a wrapper, not noise, if it holds
#: several blocks and so much of the page's text outside links: where a class of
#: its own is GOOD, and else. Where a class merely has a noise word, the second
#: share is enough, whatever the blocks.
GOOD_WRAPPER, WRAPPER, WORD_WRAPPER = (0.5, 2), (0.9, 2), (0.5, 1)
#: What is less than this of a block's score is not handed further up.
LEAST_SCORE = 1e-3
#: What a container keeps of the text of one nested a level deeper.
DECAY = 0.7
#: The least score of a path against the page's best container for votes to
#: choose it.
LEAST_SHARE = 0.4


class Page:
    """Text blocks of a page and the containers they lie in."""

    def __init__(self, html: str):
        self.parent, self.label, self.tag, self.out = [-1], [""], [""], [False]
        self._doubt: dict[int, tuple[float, int]] = {}  # nodes with noise words: what makes them wrappers
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._stack, self._text, self._links, self._link = [0], [], 0, 0  # _link: depth of an open link
        at, last = 0, html.rfind(">")
        while at < len(html):
            # without a further ">" only a comment or a section can begin
            token = (TOKEN if at <= last else UNENDED).search(html, at)
            if token is None:
                self._add(html[at:])
                break
            self._add(html[at : token.start()])
            at = token.end()
            if token.re is UNENDED:
                close, name, rest = None, None, None
            else:
                close, name, rest = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
            if name is None:
                if token.group().startswith("<![CDATA["):
                    self._add(token.group()[9:-3])
                continue
            name = name.lower()
            if close:
                self._end(name)
                continue
            self._start(name, rest)
            if name in RAW:
                found = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = found.end() if found else len(html)
                self._end(name)
        self._flush()
        if self._doubt:
            self._drop_noise()

    def _add(self, text: str) -> None:
        if self.tag[self._stack[-1]] == "head" and text.strip():
            self._close(len(self._stack) - 1)
        if text and not self.out[self._stack[-1]]:
            self._text.append(text)
            if self._link:
                self._links += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._links))
            self._text, self._links = [], 0

    def _close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on, and a link begun inside."""
        del self._stack[depth:]
        if self._link > depth:
            self._link = 0

    def _start(self, name: str, rest: str) -> None:
        if name not in IN_HEAD and self.tag[self._stack[-1]] == "head":
            self._close(len(self._stack) - 1)
        if name == "a":
            self._link = len(self._stack) if HREF.search(rest or "") else 0
        if name in VOID:
            if name == "hr":
                self._flush()
            else:
                self._add(" ")
            return
        if name in CELLS:
            self._add(" ")
            return
        hidden, classes, role = False, "", ""
        if rest and name not in LEAVES:
            hidden, classes, role = _attributes(rest)
        elif rest and ("class" in rest or "hidden" in rest or "style" in rest or "role" in rest):
            hidden, classes, role = _attributes(rest)
        doubt = self._noisy(classes, name in GROUPS) if classes and name not in NEVER_NOISE else None
        noise = hidden or role in NOISE_ROLES or doubt is not None
        if not (name in LEAVES or name in GROUPS or name in LEFT_OUT or name in RAW or noise):
            return  # inline, or unknown: markup only
        if name in ENDS_P or noise:
            self._flush()
        if name in ENDS_P and self.tag[self._stack[-1]] == "p":
            self._close(len(self._stack) - 1)
        if name in CLOSES:
            self._close_open(CLOSES[name])
        top = self._stack[-1]
        sure = hidden or role in NOISE_ROLES or (doubt and name not in GROUPS)
        out = self.out[top] or bool(sure) or name in LEFT_OUT or name in RAW or self._page_header(name, top)
        self.parent.append(top)
        self.tag.append(name)
        self.label.append(_general(name, classes))
        self.out.append(out)
        if doubt and not out:
            self._doubt[len(self.out) - 1] = doubt
        self._stack.append(len(self.parent) - 1)

    def _noisy(self, classes: str, group: bool) -> tuple[float, int] | None:
        """The share of the page's text and the blocks that make up for noise
        words; None without them. Only a class of nothing but such words says
        anything about a leaf or an inline element."""
        names = [[w.lower() for w in WORD.findall(c)] for c in classes.split()]
        names = [n for n in names if len(n) < 2 or not (n[0] in STATE_FIRST or n[-1] in STATE_LAST)]
        words = {w for n in names for w in n}
        header = words & PAGE_HEADER and not words & GOOD and not self._in_article()
        if header or any(n and NOISE.issuperset(n) for n in names):
            return GOOD_WRAPPER if any(n and GOOD.issuperset(n) for n in names) else WRAPPER
        return WORD_WRAPPER if group and words & NOISE else None

    def _drop_noise(self) -> None:
        """Leave out the blocks of noise, but not of wrappers: groups that hold
        ``main``, or several blocks and nearly all text."""
        held, blocks, mains = ([0.0] * len(self.parent) for _ in range(3))
        for node, text, links in self.blocks:
            held[node] += max(0.0, len(text) - 2.0 * links)
            blocks[node] += 1
        for node in range(len(self.parent) - 1, 0, -1):
            up = self.parent[node]
            held[up] += held[node]
            blocks[up] += blocks[node]
            mains[up] += mains[node] + (self.tag[node] == "main")
        drop = [False] * len(self.parent)
        for node in range(1, len(self.parent)):
            least, several = self._doubt.get(node, (0.0, 0))
            wraps = not several or mains[node] or (blocks[node] >= several and held[node] > least * held[0])
            drop[node] = drop[self.parent[node]] or not wraps
        self.blocks = [b for b in self.blocks if not drop[b[0]]]

    def _in_article(self) -> bool:
        return any(self.tag[n] in ("article", "main") for n in self._stack)

    def _page_header(self, name: str, top: int) -> bool:
        """A header of the page; one inside the article holds its title."""
        return name in ("header", "hgroup") and not self._in_article()

    def _close_open(self, names: set[str]) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                self._flush()
                self._close(depth)
                return
            if tag in SCOPES:
                return

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = 0
        if name in CELLS:
            self._add(" ")
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[depth]] == name:
                self._flush()
                self._close(depth)
                return

    def container(self, node: int) -> int:
        """The nearest node from ``node`` up that groups blocks."""
        while node > 0 and self.tag[node] in LEAVES:
            node = self.parent[node]
        return node

    def scores(self) -> dict[int, float]:
        """Container scores: text outside links, less for each level between;
        elements meant for the main text count half as much again."""
        found: dict[int, float] = {}
        for node, text, links in self.blocks:
            value = max(0.0, len(text) - 2.0 * links)
            at = self.container(node)
            while at >= 0 and value > LEAST_SCORE:
                found[at] = found.get(at, 0.0) + value
                value *= DECAY
                at = self.container(self.parent[at])
        for node in found:
            words = set(re.findall(r"[a-z]+", self.label[node]))
            if words & GOOD and self.tag[node] not in ("html", "body"):
                found[node] *= 1.5
        return found

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return "/".join(reversed(labels))

    def best(self) -> tuple[dict[str, float], str | None]:
        """Scores by generalised path, and the best path, widened."""
        by_path: dict[str, float] = {}
        for node, value in self.scores().items():
            path = self.path(node)
            by_path[path] = by_path.get(path, 0.0) + value
        best = max(by_path, key=lambda p: (by_path[p], p), default=None)
        return by_path, best and self._widened(best)

    def _widened(self, path: str) -> str:
        """The outermost article or main around ``path``, else the longest part
        of it under which all blocks lie that are not mostly links."""
        labels = path.split("/")
        for depth, label in enumerate(labels, 1):
            if label.split(".")[0] in ("article", "main"):
                return "/".join(labels[:depth])
        for node in {node for node, text, links in self.blocks if len(text) > 2 * links}:
            own = self.path(self.container(node)).split("/")
            same = 0
            while same < min(len(own), len(labels)) and own[same] == labels[same]:
                same += 1
            del labels[same:]
        return "/".join(labels)

    def text(self, path: str) -> str:
        """The blocks under the nodes of ``path``, in page order."""
        if not path:  # a fragment: the page is its own container
            return "\n\n".join(text for _, text, _ in self.blocks)
        depth = path.count("/") + 1
        inside = [False] * len(self.parent)
        level = [0] * len(self.parent)
        for node in range(1, len(self.parent)):
            up = self.parent[node]
            level[node] = level[up] + 1
            inside[node] = inside[up] or (level[node] == depth and self.path(node) == path)
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node])


def _attributes(rest: str) -> tuple[bool, str, str]:
    """Whether the element is hidden, its class and id, its role."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    return hidden, f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()


def _general(name: str, classes: str) -> str:
    """``tag.class`` with digits generalised, so numbered classes agree."""
    if not classes:
        return name
    parts = sorted({re.sub(r"\d+", "0", c).replace("/", "") for c in classes.lower().split()})
    return f"{name}.{'.'.join(parts)}"


def _choice(page: Page) -> tuple[list[str], str | None, float]:
    """The paths that votes may choose for a page, its own vote and its score."""
    scores, best = page.best()
    if best is None:
        return [], None, 0.0
    enough = LEAST_SHARE * max(scores.values())
    return sorted({p for p, score in scores.items() if score >= enough} | {best}), best, scores.get(best, 0.0)


def _template(paths: list[str]) -> str:
    return md5("\n".join(paths).encode()).hexdigest()


BALLOTS = "host string, template string, paths array<string>, path string, votes long, score long"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's vote and the paths it has to choose from, combined per batch."""
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            paths, best, score = _choice(Page(html))
            if best is not None:
                entry = seen.setdefault((host, tuple(paths), best), [0, 0])
                entry[0] += 1
                entry[1] += int(score)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _, _ in seen], pa.string()),
                pa.array([_template(list(c)) for _, c, _ in seen], pa.string()),
                pa.array([list(c) for _, c, _ in seen], pa.list_(pa.string())),
                pa.array([p for _, _, p in seen], pa.string()),
                pa.array([v for v, _ in seen.values()], pa.int64()), pa.array([c for _, c in seen.values()], pa.int64()),
            ],
            names=["host", "template", "paths", "path", "votes", "score"],
        )


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_template(_choice(Page(html))[0]) for html in batch.column("html").to_pylist()]
        yield batch.append_column("template", pa.array(found, pa.string()))


def main_text(html: str, paths: list[str]) -> str:
    """The text under the first of ``paths`` that the page has with enough
    text, else under the page's own best container."""
    page = Page(html)
    choice, best, _ = _choice(page)
    if best is None:  # all blocks are mostly links
        return page.text("")
    return page.text(next((p for p in paths if p in choice), best))


def _extract(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(html, [] if path is None else [path])
            for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in names], pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=[*names, "text", "n_chars"],
        )


def extract_pages(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: id, url, ``text``, ``n_chars``.

    Every page scores its containers and votes for the generalised tag-class
    path of the best one; votes are added up per host. Pages of a host with
    the same choice of well-filled paths are of one template. A template of
    several pages takes the path that most of them vote for; a page that is
    the only one of its template takes the path of its choice that the largest
    part of the host's pages with that path vote for. A page without a host goes by its own best container. NULL html is empty and
    gives an empty text; so does a page without text outside menus and other
    boilerplate. Rows that repeat an id are extracted one by one and vote one
    by one; an empty table gives no rows; other columns are ignored.

    Votes are combined in the task before they are shuffled, so a host with a
    third of the pages sends few rows. All paths of a host count, and they
    meet the templates by (host, path); no task holds the paths of a host. Only
    templates in which some page did not vote for the path chosen go back to
    the pages.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = df.select(
        F.col(id_col), F.col(url_col), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    ballots = pages.filter("host <> ''").select("host", "html").mapInArrow(_votes, BALLOTS)
    ballots = frozen(
        ballots.groupBy("host", "template", "path").agg(
            F.sum("votes").alias("votes"), F.sum("score").alias("score"), F.first("paths").alias("paths")
        ),
        "ballots",
    )
    totals = ballots.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    templates = ballots.groupBy("host", "template").agg(
        F.first("paths").alias("paths"), F.sum("votes").alias("pages"),
        F.min("path").alias("low"), F.max("path").alias("high"),
        F.expr("MIN(struct(-votes AS votes, -score AS score, path))")["path"].alias("own"),
    )
    choices = templates.select("host", "template", "pages", "low", "high", "own", F.explode("paths").alias("path"))
    seen = choices.groupBy("host", "path").agg(F.sum("pages").alias("on"))
    rates = totals.join(seen, ["host", "path"]).selectExpr(
        "host", "path", "struct(-votes / (on + 1) AS rate, -votes AS votes, -score AS score, path) AS place"
    )
    chosen = choices.join(rates, ["host", "path"]).groupBy("host", "template").agg(
        F.expr("IF(MAX(pages) > 1, MIN(own), MIN(place).path)").alias("path"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    winners = frozen(chosen.filter("low <> path OR high <> path").select("host", "template", "path"), "paths")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in pages.columns)
    known = pages.mapInArrow(_templates, f"{fields}, template string")
    joined = known.join(winners, ["host", "template"], "left").select(id_col, url_col, "html", "path")
    return joined.mapInArrow(partial(_extract, names=[id_col, url_col]), f"{kinds}, text string, n_chars long")
