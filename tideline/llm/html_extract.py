"""HTML main text by consensus paths of a host.

First pass: every container of a page (article, main, section, div, td, body) gets a score: its text, halved for each
container between, and twofold in article and main, less three times the text of links and boilerplate inside it. Its
path of tags and classes is generalised (lower case, digits to `#`), and containers vote for it with their share of
the page's best score. A path longer than PATH_MOST goes by its hash from there on. Spark adds the votes up by host and path;
the host's winner is the path with the most. Second pass: each page is parsed again and the elements at its host's
winning path give the text; a page without one gives that of its own best container.

Blocks: what block elements part. Character references are decoded, white space inside a block becomes one space (so does
<br>), blocks are trimmed, empty ones left out, and joined by line ends. Menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles and the head are left out wherever they stand. A class or id names such an element
by a part beside companions (`nav-list`), not with a negation (`no-sidebar`). A last part among others (`mw-navigation`) may
say something else, as may names of content too (`sidebar-article`) and a form, which some pages put around everything: such a block is
remembered, and read after all if it holds nine tenths of a page's text beside links, or if a page would be empty. What is left out
for sure stays out, also where nothing else is: comments, a menu, a `cookie-notice`.

A page is parsed in the task that reads it; only (host, path, votes), summed per batch, is shuffled, so a host with a
third of all pages is no burden. Winners, a row a host, are broadcast only if they are few, and else joined.

Edge cases: a null html has no text. An empty table gives an empty result. Only page_id (a whole number), url and html are
read, so other columns can have any names. Work and memory grow with the length of a page, however deeply tags are nested or left open
(of inline tags more than INLINE_MOST deep in one block only the text counts). A null url is of the host ''. Repeated pages vote each. Unclosed and stray tags are
closed as browsers do it, roughly: a block ends an open paragraph, an end tag closes what is open inside it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import small_or_shuffled, stored
from tideline.llm.url_filter import host_of

# Elements and class words by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body div main section td".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SKIPPED = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object option select svg template textarea".split())
SKIPPED_ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended"
    " related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Of the words above, those of readers' comments, which are that whatever they stand with.
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Of the parts below, those that name content: beside them such a word is no more than likely.
CONTENT_WORDS = frozenset("article articles body content entry main post posts stories story text".split())
#: Parts of a name beside such words.
COMPANIONS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content count counter desktop entry form global group header heading holder"
    " icon icons image inner item items js label large left link links list main mobile module number outer page panel post posts primary right row section secondary"
    " site slot small sticky stories story sub text thread title top ul unit user web wrap wrapper".split())
NEGATIONS = frozenset("disable disabled free has hide hides is no non not off with without".split())
CLOSES_SELF = frozenset("dd dt li option p td th tr".split())
PATH_MOST = 1000
INLINE_MOST = 100

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|[^<]++|<""",
    re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
LINK_COST = 3


def furniture(name: str) -> int:
    """Whether a class or id names an element beside the main text: 2 yes, 1 maybe, 0 no."""
    parts = WORDS.findall(name)
    if SKIPPED_WORDS.isdisjoint(parts) or not NEGATIONS.isdisjoint(parts):
        return 0
    if parts[0] in COMMENT_WORDS or parts[-1] in COMMENT_WORDS or all(p in SKIPPED_WORDS or p in COMPANIONS for p in parts):
        return 2
    return int(parts[-1] in SKIPPED_WORDS)


def content_named(names: list[str]) -> bool:
    """Whether names that leave an element out name content as well, and no readers' comments."""
    parts = {p for n in names for p in WORDS.findall(n)}
    return not parts.isdisjoint(CONTENT_WORDS) and parts.isdisjoint(COMMENT_WORDS)


class Element(NamedTuple):
    tag: str
    path: str
    skipped: bool
    container: int
    #: The outermost element that its name may leave out; -1: none.
    named: int
    #: Inline elements around it in its block.
    inline: int


class Page:
    """Blocks of text in page order, each with the container around it, and the containers' paths and scores."""

    def __init__(self, source: str) -> None:
        self.paths: list[str] = []
        self.parent: list[int] = []
        self.text: list[float] = []
        self.cost: list[int] = []
        self.blocks: list[tuple[str, int, int]] = []  # text, container, named
        self._stack: list[Element] = []
        self._open_tags: Counter = Counter()
        self._around: list[int] = []
        self._prior: list[float] = []
        self._parts: list[str] = []
        self._links = 0
        self._linked = 0  # characters of links in the parts
        self._plain = 0  # characters beside links, in all
        self._named: list[int] = []  # of each named element: characters beside links
        for m in TOKEN.finditer(source):
            tag = m.group(3)
            if tag is not None:
                if m.group(2):
                    self._close(tag.lower())
                else:
                    self._open(tag.lower(), m.group(4))
            elif (text := m.group())[0] != "<" or text == "<":
                self._say(text)
        self._flush()
        self._settle()

    def _say(self, text: str) -> None:
        top = self._stack[-1] if self._stack else None
        if top and top.skipped:
            if self._around:
                self.cost[self._around[-1]] += LINK_COST * len(text.strip())
            return
        if self._links:
            n = len(text.strip())
            self._linked += n
            if self._around and (top is None or top.named < 0):
                self.cost[self._around[-1]] += LINK_COST * n
        self._parts.append(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            named = self._stack[-1].named if self._stack else -1
            plain, self._linked, self._parts = max(0, len(text) - self._linked), 0, []
            self._plain += plain
            if named >= 0:
                self._named[named] += plain
            if text:
                self.blocks.append((text, self._around[-1] if self._around else -1, named))

    def _settle(self) -> None:
        """Which named elements are read after all; then the containers' text and cost."""
        read = [10 * n > 9 * self._plain for n in self._named]
        if not any(named < 0 or read[named] for _, _, named in self.blocks):
            read = [True] * len(read)
        kept = []
        for text, container, named in self.blocks:
            if named < 0 or read[named]:
                kept.append((text, container))
                near = float(len(text))
                while container >= 0 and near > 1e-9:
                    self.text[container] += near
                    near /= 2
                    container = self.parent[container]
            elif container >= 0:
                self.cost[container] += LINK_COST * len(text)
        self.blocks = kept
        for c in range(len(self.parent) - 1, -1, -1):
            if self.parent[c] >= 0:
                self.cost[self.parent[c]] += self.cost[c]

    def _pop(self, upto: int) -> None:
        for e in self._stack[upto:]:
            self._links -= e.tag == "a"
            self._open_tags[e.tag] -= 1
            if e.container >= 0:
                self._around.pop()
        del self._stack[upto:]

    def _open(self, tag: str, rest: str) -> None:
        above = self._stack[-1] if self._stack else None
        if tag in BLOCKS and not (above and above.skipped):
            self._flush()
        if tag in BLOCKS or tag in CLOSES_SELF:
            self._end_open(tag)
            above = self._stack[-1] if self._stack else None
        if tag in VOID:
            if tag == "br" and not (above and above.skipped):
                self._parts.append(" ")
            return
        skipped, named = (above.skipped, above.named) if above else (False, -1)
        names, role = [], ""
        if "=" in rest:
            for m in ATTRIBUTE.finditer(rest):
                value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if m.group(1).lower() == "role":
                    role = value.strip()
                else:
                    names += value.split()
        if not skipped and tag not in ("body", "html", "article", "main"):
            sure = max(map(furniture, names), default=0)
            if sure == 2 and tag in BLOCKS and content_named(names):
                sure = 1
            form = tag == "form" and sure < 2
            skipped = tag in SKIPPED and not form or role in SKIPPED_ROLES or sure == 2 or sure == 1 and tag not in BLOCKS
            if (sure == 1 or form) and not skipped and named < 0:
                named = len(self._named)
                self._named.append(0)
        inline = 0 if tag in BLOCKS or above is None else above.inline + 1
        if inline > INLINE_MOST and tag != "a" and not skipped:
            return
        if tag in ("td", "th") and not skipped:
            self._parts.append(" ")
        path = above.path if above else ""
        if tag in BLOCKS:
            path += ">" + tag + "".join("." + c for c in sorted(set(DIGITS.sub("#", " ".join(names)).split())))
            if len(path) > PATH_MOST:
                path = "~" + hashlib.md5(path.encode()).hexdigest()
        container = -1
        if tag in CONTAINERS and not skipped:
            container = len(self.paths)
            self.paths.append(path)
            self.parent.append(self._around[-1] if self._around else -1)
            self.text.append(0.0)
            self._prior.append(2.0 if tag in ("article", "main") else 1.0)
            self.cost.append(0)
            self._around.append(container)
        self._links += tag == "a"
        self._open_tags[tag] += 1
        self._stack.append(Element(tag, path, skipped, container, named, inline))
        if rest.endswith("/") and tag in ("svg", "path", "use"):
            self._pop(len(self._stack) - 1)

    def _end_open(self, tag: str) -> None:
        """What a start tag closes: a paragraph before a block, an item before the next."""
        for k in range(len(self._stack) - 1, -1, -1):
            at = self._stack[k].tag
            if at == "p" and tag in BLOCKS or at == tag and tag in CLOSES_SELF:
                self._pop(k)
                return
            if at in CONTAINERS or at in ("ul", "ol", "table", "dl"):
                return

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].tag == tag:
                if any(e.tag in BLOCKS and not e.skipped for e in self._stack[k:]):
                    self._flush()
                self._pop(k)
                return

    def score(self, container: int) -> float:
        return self._prior[container] * self.text[container] - self.cost[container]

    def votes(self) -> dict[str, float]:
        """The best share of each path; the innermost of containers with equal scores counts a little more."""
        scores = [self.score(c) * (1 + 1e-6 * c) for c in range(len(self.paths))]
        best = max(scores, default=0)
        out: dict[str, float] = {}
        if best > 0:
            for path, s in zip(self.paths, scores, strict=True):
                out[path] = max(out.get(path, 0.0), s / best)
        return out

    def main_text(self, winner: str | None) -> str:
        chosen = [path == winner for path in self.paths]
        if not any(t for t, c in zip(self.text, chosen, strict=True) if c):
            best = max(range(len(self.paths)), key=lambda c: (self.score(c), c), default=-1)
            if best < 0 or not self.text[best]:
                return "\n".join(t for t, _ in self.blocks)
            chosen = [c == best for c in range(len(self.paths))]
        for c, up in enumerate(self.parent):  # a parent comes before what it holds
            chosen[c] = chosen[c] or up >= 0 and chosen[up]
        return "\n".join(t for t, c in self.blocks if c >= 0 and chosen[c])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, share in Page(source or "").votes().items():
                total[host, path] += share
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.float64())], names=["host", "path", "votes"])


def winners(pages: DataFrame) -> DataFrame:
    """host, winner: the path with the most votes (equal votes, to nine digits: the longest path, then by code point)."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, votes double")
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 9).alias("votes"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", F.length("path").alias("n"), "path")).alias("best")).select(F.col("host").alias("of_host"), F.col("best.path").alias("winner"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source).main_text(winner) if source else "" for source, winner in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("winner")],
            names=["page_id", "url", "text", "n_chars", "path"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the host's path, of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    best = small_or_shuffled(stored(winners(rows), "winners"))
    both = rows.join(best, host_of(F.col("url")) == F.col("of_host"), "left").select("page_id", "url", "html", "winner")
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
