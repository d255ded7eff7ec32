"""Main text of web pages by consensus host paths.

A page is read into blocks of text and containers (body, article, div and the like), each container with a generalised
path of tags and classes (digits of class names dropped). Scoring: a block gives its length, less the part in links, to
its container and half of that to the container above; sections (but those right under the body) and table cells are no
containers of their own, their text is that of the container around. A path is then widened: to the article (or main)
around it, and to parents that add nothing but text of their own, unless what is added is mostly links. Every page votes
with its best paths; Spark adds the votes of a host up. The path with the most wins there (the first alphabetically on a
tie), and so does every path that is the first choice of a quarter of the host's pages (templates differ). Pages are then
read again: the text is that of the containers with a winning path, or of the page's own best path where it has none.

Left out everywhere: navigation, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, comments,
and what is hidden. White space inside a block (``<br>`` included) becomes one space; blocks are joined by newlines.

Null and empty pages give an empty text. Pages without a host (null url, no ``//``) do not vote and use their own best
container. Repeated rows vote each. Other columns are carried; those named like a result are replaced. Votes are
aggregated before the shuffle; the winners, one row of at most five paths per host, are written, so that Spark broadcasts them only if small.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stages import write_stage

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
SKIPPED = "script|style|noscript|template|textarea|title|iframe|svg|select|math|object|canvas"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    rf"|<(/?)([a-z][^\s/>]*)({ATTRIBUTES})>|<(/?)([a-z][^\s/>]*)[^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CONTAINERS = frozenset("html body article main section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr th caption figure figcaption hr address "
    "nav header footer aside form fieldset details summary hgroup dialog menu".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("nav footer aside form button head menu dialog fieldset label input".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login form search "
    "toolbar pagination pager widget widgets".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WHOLE = frozenset("html body article main".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOTES = 3  # paths a page votes for
PAGES_PART = 4  # a path that is the first choice of one page in so many wins too


class Page:
    """Blocks (container, text, link characters) in page order, containers by number with path and parent."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]
        self.parents: list[int] = [0]
        self._tags: dict[str, str] = {}  # of paths
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, left out
        self._parts: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                container, out = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (0, False)
                if not out:
                    self.blocks.append((container, text, self._linked))
            self._parts, self._linked = [], 0

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if any(entry[0] == "a" for entry in self._stack[-3:]):
                self._linked += len(text)

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                if any(entry[0] in BLOCKS for entry in self._stack[i:]):
                    self._flush()
                del self._stack[i:]
                return
            if tag not in CONTAINERS and self._stack[i][0] in CONTAINERS:
                return  # a stray end tag closes nothing outside its container

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if tag in CLOSES_P:
            self._close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th"):
            self._close(tag)
        if tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            return
        container, out = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (0, False)
        values = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        out = out or self._left_out(tag, values)
        if tag in CONTAINERS and tag != "td" and (tag != "section" or self._tags.get(self.paths[container], "html") in ("html", "body")):
            first = values.get("class", "").lower().split()[:1]
            name = tag + "".join("." + re.sub(r"\d+", "", c) for c in first)
            self.paths.append(f"{self.paths[container]}>{name}")
            self.parents.append(container)
            container = len(self.paths) - 1
            self._tags[self.paths[container]] = tag
        self._stack.append((tag, container, out))

    def _left_out(self, tag: str, values: dict[str, str]) -> bool:
        if tag in OUT_TAGS:
            return True
        inside = any(entry[0] in ("article", "main") for entry in self._stack)
        words = set(re.findall(r"[a-z]+", f"{values.get('class', '')} {values.get('id', '')}".lower()))
        if (tag == "header" or "header" in words) and not inside and tag not in WHOLE:
            return True
        if tag in WHOLE:
            return False
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", ""))
        return bool(words & OUT_WORDS or values.get("role", "").lower() in OUT_ROLES or hidden)

    def _read(self, source: str) -> None:
        at = 0
        for match in TOKEN.finditer(source):
            self._text(source[at : match.start()])
            at = match.end()
            tag = (match[3] or match[6] or "").lower()
            if not tag:
                continue
            if match[2] or match[5]:
                self._close(tag)
            else:
                self._open(tag, match[4] or "")
        self._text(source[at:])
        self._flush()

    def scores(self) -> dict[str, int]:
        """Points of each path."""
        points: dict[str, int] = {}
        for container, text, linked in self.blocks:
            value = max(0, len(text) - 2 * linked)
            for number, share in ((container, 2), (self.parents[container], 1)):
                if number or share == 2:
                    points[self.paths[number]] = points.get(self.paths[number], 0) + share * value
        return points

    def _inside(self, paths: set[str]) -> list[bool]:
        """Which containers have one of the paths or lie in such a container."""
        inside = [p in paths for p in self.paths]
        for number, parent in enumerate(self.parents):
            inside[number] = inside[number] or (number > 0 and inside[parent])
        return inside

    def _adds(self, path: str, wider: str, foreign: bool) -> bool:
        """Whether ``wider`` adds text that is not mostly links; without ``foreign``, only if no other container adds any."""
        old, new = self._inside({path}), self._inside({wider})
        more = [block for block in self.blocks if new[block[0]] and not old[block[0]]]
        if not foreign and any(self.paths[container] != wider for container, _, _ in more):
            return False
        return sum(len(text) for _, text, _ in more) > 2 * sum(linked for _, _, linked in more)

    def widened(self, path: str) -> str:
        number, around = self.paths.index(path), []
        while number:
            number = self.parents[number]
            around.append(self.paths[number])
        for tag in ("article", "main"):
            if self._tags.get(path) == tag or any(self._tags.get(p) == tag for p in around):
                outer = [p for p in around if self._tags.get(p) == tag][-1:]
                if outer and self._adds(path, outer[0], True):
                    path = outer[0]
                break
        for wider in around[around.index(path) + 1 :] if path in around else around:
            if self._adds(path, wider, False):
                path = wider
        return path

    def best_paths(self) -> list[tuple[str, int]]:
        ranked = sorted(self.scores().items(), key=lambda item: (-item[1], item[0]))
        wide: dict[str, int] = {}
        for path, value in ranked[:VOTES]:
            if value:
                path = self.widened(path)
                wide[path] = wide.get(path, 0) + value
        return list(wide.items())

    def text(self, *winners: str | None) -> str:
        for paths in (lambda: set(winners), lambda: {path for path, _ in self.best_paths()[:1]}, lambda: {""}):
            inside = self._inside(paths())
            lines = [text for container, text, _ in self.blocks if inside[container]]
            if lines:
                return "\n".join(lines)
        return ""


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """(_host, _paths): the container paths that the pages of a host voted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = Page(source).best_paths()
                total = sum(value for _, value in best)
                rows += [(host, path, 1000 * value // total, int(i == 0)) for i, (path, value) in enumerate(best)]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_host", "_path", "_votes", "_firsts"])

    cast = pages.select(host_of(F.col("url")).alias("_host"), "html").filter("_host IS NOT NULL AND html IS NOT NULL")
    votes = cast.mapInArrow(run, "_host string, _path string, _votes long, _firsts long")
    sums = [F.sum(c).alias(c) for c in ("_votes", "_firsts")]
    counted = write_stage(votes.groupBy("_host", "_path").agg(*sums), "host_votes")
    most = F.min_by("_path", F.struct(-F.col("_votes"), "_path")).alias("_most")
    leading = counted.groupBy("_host").agg(most, F.sum("_firsts").alias("_pages"))
    won = (F.col("_path") == F.col("_most")) | (PAGES_PART * F.col("_firsts") >= F.col("_pages")) & (F.col("_firsts") > 0)
    return counted.join(leading, "_host").filter(won).groupBy("_host").agg(F.collect_list("_path").alias("_paths"))


def extract_text(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, and text and n_chars."""
    winners = write_stage(host_paths(pages), "host_paths")
    kept = pages.drop("text", "n_chars", "_host", "_paths").withColumn("_host", host_of(F.col("url")))
    led = kept.join(winners, "_host", "left").drop("_host")
    carried = [c for c in led.columns if c not in ("html", "_paths")]
    ordered = led.select(*carried, "html", "_paths")
    out = ordered.select(*carried, F.lit("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, paths = batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()
            texts = [Page(source or "").text(*(won or ())) for source, won in zip(sources, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[*carried, "text"])

    return ordered.mapInArrow(run, out.schema).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
