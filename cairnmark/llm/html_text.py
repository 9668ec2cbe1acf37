"""Main text of web pages by consensus paths of their hosts.

1. Each page's containers are scored by the prose directly in them (half of it
   counts for the parent); the best ones vote for their generalised path of
   tags and classes, digits left out. A path votes once a page.
2. Votes are summed by host and path in Spark and each host keeps the path with
   most votes. A host with a third of all pages is pre-aggregated like any other.
3. Every page is parsed again and the container on its host's path is taken; of
   several, their nearest common ancestor. A page without text there uses its
   own best container, or the nearest common ancestor of all on the same path.

Winners are broadcast if they are at most ``SMALL`` bytes, else joined by host
and ``SALTS`` parts of its pages.

The text is the container's blocks in page order, headings between its parts too. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader
comments are left out, by tag, role or, of containers and lists, by name: a
class or id with a strong word (``user-comments``, ``ad-300x250``) or made of
weak ones and words of shape alone (``header-left``, not ``social-history``).
A name or a form is a sign, not a verdict: a container with a weak name that
holds the title of what surrounds it stays, and so does one that holds nearly
all prose of the page (of a strong name: all). ``hr`` ends a block, ``br`` is white space. References are decoded within a run of
text, never across tags. Time and memory are in proportion to the page, however
deep it nests. Null or empty
html gives an empty text; a null url is a host of its own. Repeated rows and
ids stay; other columns are not read. Pages cut off in a tag, reference or
element are read as far as they go.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.llm.shared import cut

SMALL, SALTS = 8 << 20, 64
_words = lambda s: frozenset(s.split())
_INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr")
_TEXTUAL = _words("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr tbody thead tfoot table ul ol dl figure address summary details")
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
_RAW = re.compile(r"</(script|style|noscript|template|textarea|title|svg|iframe|object|select|math|video|audio|canvas)\s*>", re.I)
_DROP_RAW = _words("script style noscript template textarea title svg iframe object select math video audio canvas")
_DROP = _words("head nav footer aside button menu dialog fieldset")
#: Words that name a part to leave out wherever they stand in a name, and others that do so among words of shape alone.
_STRONG = _words(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted nav navbar navigation breadcrumb breadcrumbs sidebar sidebars "
    "masthead comment comments disqus cookie cookies gdpr newsletter pagination pager"
)
_DROP_WORD = _words(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "footer masthead header topbar toolbar comment comments disqus replies respond cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended widget widgets pagination pager skip hidden"
)
#: Words that say where or what shape a part is: with a word above they still name what is left out.
_SHAPE = _words(
    "left right top bottom main site page global primary secondary section area block box bar panel list item items wrap wrapper container inner outer content link links button buttons icon icons post posts article articles "
    "story stories us this policy consent slot unit text title form row col column group area sticky fixed mobile desktop small large xs sm md lg xl expand print visible"
)
#: Of text-level elements, those whose class and id are looked at as containers' are.
_HOLDS = _words("ul ol dl table figure details")
_DROP_ROLE = _words("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog")
_CLOSES_P = _TEXTUAL | _words("div article section main header footer nav aside form address hr")
_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*)(>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /\n") else {}


_KEPT, _WEAK, _FIRM, _GONE = range(4)
_HEADED = _words("p h1 h2 h3 h4 h5 h6")


def _named(value: str) -> int:
    """How far the classes or ids speak for a part to leave out: a strong word anywhere, or weak ones among words of shape."""
    found = _KEPT
    for name in value.split():
        parts = {x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x}
        if not _STRONG.isdisjoint(parts):
            return _FIRM
        if not _DROP_WORD.isdisjoint(parts) and parts <= _DROP_WORD | _SHAPE:
            found = _WEAK
    return found


def _judged(tag: str, attrs: dict[str, str], inside_main: bool) -> int:
    """Whether an element stays, goes, or is looked at when the whole page is known."""
    if tag in _DROP or tag == "header" and not inside_main:
        return _GONE
    if tag in ("html", "body", "main", "article"):
        return _KEPT
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") or attrs.get("role") in _DROP_ROLE):
        return _GONE
    if tag == "form":
        return _WEAK
    named = max(_named(attrs.get("class", "")), _named(attrs.get("id", ""))) if attrs else _KEPT
    if tag in _HOLDS:
        return _GONE if named else _KEPT
    return named if tag not in _TEXTUAL and tag not in _INLINE else _KEPT


class Page:
    """Containers (parent, path) of a page and its blocks (container, text, characters in links). Paths are numbered; each is a step from another."""

    def __init__(self, source: str):
        self.steps: dict[tuple[int, str], int] = {}
        self.names: list[tuple[int, str]] = [(-1, "")]
        self.paths: list[int] = [0]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self.suspects: dict[int, int] = {}
        self.titles: set[int] = set()
        self.tags: list[str] = [""]
        self._parse(source)
        if self.suspects:
            self._settle()

    def path(self, number: int) -> str:
        out = []
        while number > 0:
            number, name = self.names[number]
            out.append(name)
        return "".join(f"/{x}" for x in reversed(out))

    def number(self, path: str | None) -> int:
        """The number of a path, or -1."""
        at = 0 if path is not None else -1
        for name in (path or "").split("/")[1:]:
            at = self.steps.get((at, name), -1)
        return at

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, is dropped
        opened: dict[str, int] = {}
        inline: list[dict[str, int]] = [{}]  # open inline elements above each other element
        walls: list[list[int]] = [[0, 0]]  # elements that are no paragraph, heading or inline: place in the stack, paragraphs above it
        text: list[str] = []
        linked, in_link, here, dropped, in_main, at = 0, 0, 0, 0, 0, 0
        ends = len(source)

        def flush() -> None:
            nonlocal linked
            if text:
                block = " ".join("".join(text).split())
                if block:
                    self.blocks.append((here, block, linked))
                text.clear()
            linked = 0

        def push(tag: str, gone: bool) -> None:
            nonlocal dropped, in_main, in_link
            if tag in _INLINE:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
            else:
                inline.append({})
                if tag in _HEADED:
                    walls[-1][1] += tag == "p"
                else:
                    walls.append([len(stack), 0])
            stack.append((tag, here, gone))
            opened[tag] = opened.get(tag, 0) + 1
            dropped += gone
            in_main += tag in ("article", "main")
            in_link += tag == "a"

        def pop() -> None:
            nonlocal here, dropped, in_main, in_link
            tag, _, gone = stack.pop()
            if tag in _INLINE:
                inline[-1][tag] -= 1
            else:
                inline.pop()
                if tag in _HEADED:
                    walls[-1][1] -= tag == "p"
                else:
                    walls.pop()
            opened[tag] -= 1
            dropped -= gone
            in_main -= tag in ("article", "main")
            in_link -= tag == "a"
            here = stack[-1][1]

        while at < ends:
            m = _TOKEN.search(source, at)
            run = source[at : m.start()] if m else source[at:]
            if run and not dropped:
                text.append(html.unescape(run))
                if in_link:
                    linked += len(run)
            if not m:
                break
            at = m.end()
            closing, tag, raw, end = m.group(1, 2, 3, 4) if m[2] else m.group(5, 6, 7, 8)
            if not tag or not end:  # a comment or declaration, or cut off within a tag
                continue
            tag = tag.lower()
            if closing:
                if opened.get(tag):
                    if tag not in _INLINE:
                        flush()
                    elif not inline[-1].get(tag):
                        continue  # an inline end outside of the block it began before
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag == "br":
                if not dropped:
                    text.append(" ")
                continue
            if tag in _DROP_RAW and not raw.rstrip().endswith("/"):
                while (end_tag := _RAW.search(source, at)) and end_tag[1].lower() != tag:
                    at = end_tag.end()
                at = end_tag.end() if end_tag else ends
                continue
            if tag in _CLOSES_P or tag == "li":
                if tag not in ("tr", "td", "th") or not dropped:
                    flush()
                if walls[-1][1]:
                    while stack[-1][0] != "p":
                        pop()
                    pop()
                if tag in ("li", "dt", "dd", "td", "th", "tr") and stack[walls[-1][0]][0] == tag:
                    for _ in range(len(stack) - walls[-1][0]):
                        pop()
            if tag in _VOID or raw.rstrip().endswith("/"):
                continue
            if tag in _INLINE:
                attrs = _attributes(raw)
                push(tag, _judged(tag, attrs, True) == _GONE if attrs and tag not in ("a", "b", "i") else False)
                continue
            flush()
            attrs = _attributes(raw)
            verdict = _judged(tag, attrs, in_main > 0)
            gone = verdict == _GONE
            if tag == "h1" and not dropped:
                self.titles.add(here)
            if tag not in _TEXTUAL and not dropped and not gone:
                classes = ".".join(sorted(set(re.sub(r"\d+", "", attrs.get("class", "")).lower().replace("/", "").split())))
                step = (self.paths[here], tag + (f".{classes}" if classes else ""))
                if step not in self.steps:
                    self.steps[step] = len(self.names)
                    self.names.append(step)
                self.paths.append(self.steps[step])
                self.parents.append(here)
                self.tags.append(tag)
                here = len(self.paths) - 1
                if verdict:
                    self.suspects[here] = verdict
            push(tag, gone)
        flush()

    def _settle(self) -> None:
        """Leaves out the suspects' blocks, but of those that hold the page's title within another container, or nearly all of its prose."""
        prose, linked, titled = [0.0] * len(self.paths), [0] * len(self.paths), [False] * len(self.paths)
        doubt = [i in self.suspects for i in range(len(self.paths))]
        for i, parent in enumerate(self.parents):
            doubt[i] = doubt[i] or parent >= 0 and doubt[parent]
        outside = 0.0
        for where, block, links in self.blocks:
            own = max(0, len(block) - 3 * links)
            prose[where] += own
            linked[where] += links
            outside += 0 if doubt[where] else own
        for i in self.titles:
            titled[i] = True
        for i in range(len(self.paths) - 1, 0, -1):
            parent = self.parents[i]
            prose[parent] += prose[i]
            linked[parent] += linked[i]
            titled[parent] = titled[parent] or titled[i]
        gone = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            gone[i] = parent >= 0 and gone[parent]
            if i in self.suspects and not gone[i]:
                weak = self.suspects[i] == _WEAK
                title = weak and self.tags[i] != "form" and titled[i] and linked[i] <= prose[i] and self.tags[parent] not in ("", "html", "body")
                most = 2 * prose[i] > prose[0] and outside <= (0.1 * prose[0] if weak else 0)
                gone[i] = not (title or most)
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def scores(self) -> list[float]:
        score = [0.0] * len(self.paths)
        for where, block, linked in self.blocks:
            prose = max(0, len(block) - 3 * linked)
            prose = prose if len(block) >= 25 else prose / 4
            score[where] += prose
            if self.parents[where] >= 0:
                score[self.parents[where]] += prose / 2
        return score

    def best(self) -> int:
        score = self.scores()
        return max(range(len(score)), key=lambda i: (score[i], -i))

    def votes(self) -> list[tuple[str, float]]:
        """Paths of the containers that score at least half of the best, each once with its best share of it."""
        score = self.scores()
        most = max(score)
        found: dict[int, float] = {}
        for p, s in zip(self.paths, score, strict=True):
            if most and s >= most / 2:
                found[p] = max(found.get(p, 0), s / most)
        return [(self.path(p), s) for p, s in found.items()]

    def _common(self, places: list[int]) -> int:
        """The nearest container that holds all of ``places``; a parent's number is below its children's."""
        left, marked = len(set(places)), set(places)
        for i in range(len(self.parents) - 1, 0, -1):
            if i in marked:
                if left == 1:
                    return i
                if self.parents[i] in marked:
                    left -= 1
                marked.add(self.parents[i])
        return 0

    def text(self, path: str | None) -> str:
        """Text of all containers on ``path``, or on the path of the page's best one, and of what stands between them."""
        score = self.scores()
        at = lambda number: [i for i, p in enumerate(self.paths) if p == number and score[i]]
        best = self.best()
        top = self._common(at(self.number(path)) or at(self.paths[best]) or [best])
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            inside[i] = i == top or parent >= 0 and inside[parent]
        return "\n".join(block for where, block, _ in self.blocks if inside[where])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host of ``pages`` (url, html)."""

    def vote(frames):
        for pdf in frames:
            seen: dict[tuple[str, str], float] = {}
            for url, source in zip(pdf["url"], pdf["html"], strict=True):
                for path, share in Page(source or "").votes():
                    key = (host_of(url), path)
                    seen[key] = seen.get(key, 0) + share
            if seen:
                yield pd.DataFrame([(*k, round(v, 6)) for k, v in seen.items()], columns=["host", "path", "votes"])

    votes = pages.select("url", "html").mapInPandas(vote, "host string, path string, votes double")
    totals = votes.groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(38,6)")).alias("votes"))
    return totals.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    picked = pages.select("page_id", "url", "html")
    winners = cut(host_paths(picked))
    few = (winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0) <= SMALL
    host = F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit(""))
    hosted = picked.withColumn("host", host)
    if few:
        joined = hosted.join(F.broadcast(winners), "host", "left")
    else:
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(spread.hint("shuffle_hash"), ["host", "salt"], "left")

    def extract(frames):
        for pdf in frames:
            text = [Page(source or "").text(path) for source, path in zip(pdf["html"], pdf["path"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    kind = picked.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long")
