"""Main text of web pages: what recurs across the pages of a host is its template and goes.

Each page is read once for the hashes of its element subtrees, which Spark counts by host, and once more, with the subtrees that turned
out to be template, for its text. A subtree has two hashes: of all it holds, and of its shape alone (tags, classes, ids; siblings of
one shape count once), since menus and adverts keep their shape while their words change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import each, set_batches
from loomery.session import table, written

# Fixed values of HTML: elements without an end tag, with raw text, that break a block, that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
# Elements that hold no main text, and words of class, id and role that name such elements.
NOISE = frozenset("head script style title noscript template nav footer aside form iframe noembed noframes xmp svg math button select textarea object canvas dialog menu".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices sidebar comment comments disqus menu nav navbar navigation "
    "breadcrumb breadcrumbs footer share sharing social related newsletter subscribe subscription popup modal pagination toolbar widget".split()
)
OUTER = frozenset("header masthead topbar".split())
ROOTS = frozenset("html head body main article".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd caption figcaption".split()) | INLINE

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)")
_NAMED = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_MASK = (1 << 64) - 1


def _names(attributes: str) -> tuple[str, str]:
    """Class, id and role words in order, and the role, of a start tag."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _NAMED.findall(attributes)}
    return " ".join(found[k] for k in ("class", "id", "role") if k in found), found.get("role", "")


class Page:
    """Elements of a page in document order, and its runs of text.

    `tags`, `up` (parent), `names` (class, id, role) by element; `texts`: (element, decoded text, whether a block begins here).
    Unclosed and misplaced tags are put right the way browsers do in common cases: a block ends an open paragraph, an item the item
    before it; an end tag without its start is skipped; the end of the page closes all. A tag that never ends takes the rest with it.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.up, self.names, self.roles = ["#page"], [-1], [""], [""]
        self.texts: list[tuple[int, str, bool]] = []
        self._open, self._counts, self._broken = [0], {}, True
        at, n = 0, len(html)
        while at < n:
            cut = html.find("<", at)
            if cut < 0:
                cut = n
            if cut > at:
                self._text(html[at:cut])
            if cut == n:
                break
            tag = _TAG.match(html, cut)
            if tag:
                if not tag[4]:
                    break
                name, at = tag[2].lower(), tag.end()
                if tag[1]:
                    self._end(name)
                    continue
                self._start(name, tag[3])
                if name in RAW:
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
                    at = close.start() if close else n
            elif html.startswith("<!--", cut):
                end = html.find("-->", cut + 4)
                at = end + 3 if end >= 0 else n
            elif html[cut + 1 : cut + 2] in ("!", "?", "/"):
                end = html.find(">", cut)
                at = end + 1 if end >= 0 else n
            else:
                self._text("<")
                at = cut + 1

    def _text(self, run: str) -> None:
        self.texts.append((self._open[-1], unescape(run) if "&" in run else run, self._broken))
        self._broken = False

    def _start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self._broken = True
            if self._counts.get("p") and name not in RAW:
                self._end("p")
            if name in ITEMS:
                self._end_item(name)
        names, role = _names(attributes) if "=" in attributes else ("", "")
        self.tags.append(name)
        self.up.append(self._open[-1])
        self.names.append(names)
        self.roles.append(role)
        if name == "br":
            self._text(" ")
        if name not in VOID and not (attributes.endswith("/") and name in ("svg", "math", "path")):
            self._open.append(len(self.tags) - 1)
            self._counts[name] = self._counts.get(name, 0) + 1

    def _end_item(self, name: str) -> None:
        if not any(self._counts.get(t) for t in ITEMS if ITEMS[t] == ITEMS[name]):
            return None
        for i in reversed(self._open):
            if self.tags[i] == name or (name in ("dt", "dd") and self.tags[i] in ("dt", "dd")) or (name in ("td", "th") and self.tags[i] in ("td", "th")):
                return self._end(self.tags[i])
            if self.tags[i] in ITEMS[name] or i == 0:
                return None

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._broken = True
        if not self._counts.get(name):
            return
        if name in INLINE:  # an inline end tag closes no block
            for i in reversed(self._open):
                if self.tags[i] == name:
                    break
                if self.tags[i] not in INLINE:
                    return
        while True:
            i = self._open.pop()
            self._counts[self.tags[i]] -= 1
            if self.tags[i] not in INLINE:
                self._broken = True
            if self.tags[i] == name:
                return

    def noise(self) -> list[bool]:
        """Whether an element or one around it is no main text by its tag or by how it is named."""
        out = [False]
        inside = [False]  # of an article
        for tag, up, names in zip(self.tags[1:], self.up[1:], self.names[1:], strict=True):
            words = _SPLIT.split(names) if names else ()
            within = inside[up]
            bad = out[up] or tag in NOISE or any(w in HINTS for w in words) or (not within and (tag == "header" or any(w in OUTER for w in words)))
            out.append(bad and tag not in ("html", "body"))
            inside.append(within or tag in ("article", "main"))
        return out

    def main(self, gone: list[bool]) -> list[bool]:
        """Whether an element is in the main part: in an article if there is one left, else in what is marked as main, else anywhere."""
        marks = [(lambda i: self.tags[i] == "article" or self.roles[i] == "article"), (lambda i: self.tags[i] == "main" or self.roles[i] == "main")]
        for mark in marks:
            own = [mark(i) and not gone[i] for i in range(len(self.tags))]
            if any(own):
                for i in range(1, len(own)):
                    own[i] = own[i] or own[self.up[i]]
                return own
        return [True] * len(self.tags)

    def hashes(self) -> tuple[list[int], list[int]]:
        """Of each element the hash of all it holds and the hash of its shape."""
        parts: list[list[str]] = [[] for _ in self.tags]
        for i, text, _ in self.texts:
            parts[i].append(" ".join(text.split()))
        whole, shape = [0] * len(self.tags), [0] * len(self.tags)
        below: list[list[int]] = [[] for _ in self.tags]
        for i in range(len(self.tags) - 1, 0, -1):  # children come after their parent
            own, children = f"{self.tags[i]} {self.names[i]}", below[i][::-1]
            kinds = [shape[c] for j, c in enumerate(children) if not j or shape[c] != shape[children[j - 1]]]
            whole[i] = xxhash.xxh64_intdigest("\x1f".join((own, *parts[i], *(str(whole[c]) for c in children))))
            shape[i] = xxhash.xxh64_intdigest("\x1e".join((own, *map(str, kinds))))
            below[self.up[i]].append(i)
        return whole, shape

    def text(self, gone: list[bool]) -> str:
        """Blocks of the main part, white space in a block as one space, joined by newlines."""
        main, blocks, held = self.main(gone), [], []
        for i, text, begins in self.texts:
            if begins and held:
                blocks.append(held)
                held = []
            if main[i] and not gone[i]:
                held.append(text)
        blocks.append(held)
        return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def subtrees(page: Page) -> Iterator[tuple[int, int | None, int | None]]:
    """Element, hash of the whole, hash of the shape, of the subtrees that may be template; what can't be one by a hash has None.

    What is around the main part holds the main text, so it is none. Within it only what is no block of text may be, and only whole; the same
    holds for a page without a marked main part. Outside, a shape is enough. Within what is no main text anyway nothing is looked at."""
    noise = page.noise()
    main = page.main(noise)
    marked = not all(main)
    holds = [False] * len(main)
    for i in range(len(main) - 1, 0, -1):
        if holds[i] or (marked and main[i] and not main[page.up[i]]):
            holds[i] = holds[page.up[i]] = True
    whole, shape = page.hashes()
    for i in range(1, len(main)):
        tag = page.tags[i]
        if not (holds[i] or noise[page.up[i]] or tag in INLINE or tag in RAW or tag in VOID or tag in ROOTS) and (not main[i] or tag not in TEXT):
            yield i, whole[i], None if main[i] else shape[i]


def _pages(column: pa.Array) -> Iterator[Page]:
    for html in each(column, 64):
        yield Page(html.decode("utf-8", "replace"))


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """site, tree, body: subtrees of each page with the hash of its main text. A page itself is the subtree 0 of its site and of site 0,
    which is all sites."""
    for x in batches:
        for lo in range(0, x.num_rows, 256):
            part = x.slice(lo, 256)
            sites, trees, bodies = [], [], []
            for site, page in zip(part.column(0).to_pylist(), _pages(part.column(1)), strict=True):
                body = xxhash.xxh64_intdigest(page.text(page.noise()))
                found = {(site, 0), (0, 0)}
                for _, whole, shape in subtrees(page):
                    found |= {(site, whole)} if shape is None else {(site, whole), (site, shape), (0, shape)}
                sites += [s for s, _ in found]
                trees += [t for _, t in found]
                bodies += [body] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(sites, pa.int64()), _signed(trees), _signed(bodies)], ["site", "tree", "body"])


def templates(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """site, trees: the subtrees that recur with `least` different main texts or more, and with at least that share of all main texts
    of the site. Copies of one page count once. The share bounds the list of a site: by the mean number of subtrees of its pages
    over the share.

    pages: site, html."""
    rows = pages.select("site", "html").mapInArrow(_emitted, "site long, tree long, body long").distinct()
    counts = written(rows.groupBy("site", "tree").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    of = counts.filter("tree = 0").select("site", F.col("n").alias("pages"))
    often = counts.filter("tree <> 0").join(of, "site").filter(F.col("n") >= share * F.col("pages"))
    return written(often.groupBy("site").agg(F.collect_list("tree").alias("trees")))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for lo in range(0, x.num_rows, 256):
            part = x.slice(lo, 256)
            texts = []
            for site, own, every, page in zip(*(part.column(c).to_pylist() for c in ("site", "own", "every")), _pages(part.column("html")), strict=True):
                gone, own, every = page.noise(), {t & _MASK for t in own or ()}, {t & _MASK for t in every or ()}
                if own or every:
                    for i, whole, shape in subtrees(page):
                        gone[i] = gone[i] or whole in own or shape in own or shape in every
                for i in range(1, len(gone)):
                    gone[i] = gone[i] or gone[page.up[i]]
                texts.append(page.text(gone))
            kept = [part.column(i) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def site(url: Column) -> Column:
    """A number for the host of a url, that of the empty host for a null url and one without ://; never 0."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    number = F.xxhash64(F.lower(host))
    return F.when(number == 0, F.lit(1)).otherwise(number)


def extract_text(pages: DataFrame, least: int = 3, share: float = 0.5, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages: the main text without the host's template.

    Subtrees that recur across many pages of a host (`templates`) are deleted, and those that recur across all hosts alike, for hosts of few pages; of
    what is left, elements that are no main text by tag or name (scripts, forms, comments) go, and the article is taken where
    one is marked. Blocks of text within an article never count as template, so a line that many articles share stays. Null html is
    empty; a page of any length or depth is read in memory linear in it; repeated rows return repeated rows; null urls and ids
    stay; an empty table returns no rows; other columns are ignored, whatever their names. Pages are not shuffled unless the
    table of templates is too large for Spark to broadcast, and then split where a host is skewed.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), site(F.col(url)).alias("site"))
    found = templates(rows, least, share)
    every = found.filter("site = 0").select(F.col("trees").alias("every"), F.lit(0).alias("all"))  # one row at most
    own = found.withColumnRenamed("trees", "own")
    known = rows.join(own, "site", "left").withColumn("all", F.lit(0)).join(F.broadcast(every), "all", "left")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select("page_id", "url").dtypes)
    return known.select("page_id", "url", "html", "site", "own", "every").mapInArrow(_extracted, f"{kinds}, text string, n_chars long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return extract_text(table(spark, sf_dir, "pages"))


OP13_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS html FROM pages),
b AS (
  SELECT page_id, url, unnest(string_split_regex(html, '</?(?:h1|p)>')) AS block, generate_subscripts(string_split_regex(html, '</?(?:h1|p)>'), 1) AS i FROM a),
c AS (
  SELECT page_id, url, i, regexp_replace(replace(block, '<br>', ' '), '<[^>]*>', '', 'g') AS block FROM b),
d AS (
  SELECT page_id, url, i, trim(regexp_replace(regexp_replace(
    replace(replace(replace(block, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM c),
e AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY i) FILTER (block <> ''), '') AS text FROM d GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM e
"""
