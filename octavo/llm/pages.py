"""Main text of web pages by differencing each page against the page with the nearest URL.

A page becomes a sequence of lines: its text blocks, and a slot for every element that holds none of the article
(menus, headers, footers, sidebars, notices, adverts, forms, comments, what isn't displayed, and all that lies
outside of an ``article`` or ``main`` element with text). A text block is known by its text. A slot is known by its
path of elements and classes alone, as what menus, adverts and footers say changes from page to page.

Pages are put in order of host and URL path by a range sort, so a host with any share of the pages is spread
over many tasks. A page is paired with its neighbours in that order, first those of its host, and of these the one
whose path has the longer common beginning; the lines of both are aligned by longest common subsequence, and what
both have is the site's, not the page's:

* A slot that both have is deleted. A page alone on its host is paired with the nearest page of another one for this.
* A text block outside of articles that both have is deleted, if both are of one host and no copies of each other:
  two pages whose longest block that isn't frequent on the host (``mark``) is the same are copies, and the search goes
  on past them.
* A text block inside an article is deleted only if it is the host's as well: on more than half of its pages that are
  no copies of each other, of ``LEAST_PAGES`` at least, as an article may quote or repeat another.

A slot that no neighbour has is none of the article either, and left out: there the markup alone decides.
``report`` counts both kinds.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavo.llm.shared import keep, sized

#: Pages that are no copies of each other that a host needs, before a line inside of its articles may count as its own.
LEAST_PAGES = 4

# Names of HTML elements and the usual words of class, id and role attributes.
RAW = "script style template noscript textarea select iframe svg math object canvas audio video title head"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("nav footer aside form button menu dialog search label option".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads share sharing social related login signin signup notice notices consent gdpr pager popup modal toc masthead skip legal copyright".split())
BEGINNINGS = ("nav", "menu", "breadcrumb", "sidebar", "advert", "sponsor", "promo", "banner", "cookie", "newsletter", "subscri", "comment", "disqus", "footer", "widget", "paginat", "recommend")

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    rf"|(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|/?[a-zA-Z!?][^>]*(?:>|\Z))",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _not_content(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is none of the article, by its name or its attributes."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body") or name in MAIN:
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            for word in re.findall("[a-z]+", value):
                if word in WORDS or word.startswith(BEGINNINGS) or word == "header" and not inside:
                    return True
    return False


class Line(NamedTuple):
    """A text block, or (text None) a slot that holds none of the article."""

    text: str | None
    key: int
    inside: bool


def _key(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(map(str, parts)))


def blocks(html: str) -> list[Line]:
    """The lines of a page in order: text blocks, inside an article or main element or not, and slots.

    If there is such an element with text, all else are slots. Equal slots in a row are one.
    """
    found: list[tuple[str | None, int, bool]] = []  # text, key of the path, inside
    text: list[str] = []
    stack: list[str] = []
    path = [0]  # the keys of the open elements' paths
    skip, inside, linked, seen = 0, 0, True, False  # skip: depth of the stack at which dropping began; seen: that slot is found

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append((line if inside or not linked else None, path[-1], inside > 0))
            text.clear()
        linked = True

    def close(to: int) -> None:
        nonlocal skip, inside, seen
        for name in stack[to:]:
            inside -= name in MAIN
        del stack[to:], path[to + 1 :]
        if skip and len(stack) < skip:
            skip, seen = 0, False

    def piece(begin: int, end: int) -> None:
        nonlocal linked, seen
        if not skip:
            part = unescape(html[begin:end])
            text.append(part)
            linked = linked and ("a" in stack or not part.strip())
        elif not seen and html[begin:end].strip():
            found.append((None, path[skip], False))
            seen = True

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            piece(at, token.start())
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th") and not skip:
            text.append(" ")
        if token["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == name:
                    close(i)
                    break
            continue
        if name in BLOCK and "p" in stack:  # a block ends an open paragraph
            i = len(stack) - 1 - stack[::-1].index("p")
            if not any(x in BLOCK for x in stack[i + 1 :]):
                close(i)
        if name == "li" and "li" in stack:
            i = len(stack) - 1 - stack[::-1].index("li")
            if not any(x in ("ul", "ol", "menu") for x in stack[i + 1 :]):
                close(i)
        if name in VOID or token["attrs"].endswith("/") and name not in BLOCK:
            continue
        stack.append(name)
        words = (w for k, v in _ATTR.findall(token["attrs"]) if k.lower() in ("class", "id") for w in re.findall("[a-z]+", v.lower()))
        path.append(_key(path[-1], name, *words) if token["attrs"] else _key(path[-1], name))
        inside += name in MAIN
        if not skip and _not_content(name, token["attrs"], inside > 0):
            skip = len(stack)
    if at < len(html):
        piece(at, len(html))
        linked = False
    flush()
    main = any(x for t, _, x in found if t is not None)
    out: list[Line] = []
    for line, key, x in found:
        if line is None or main and not x:
            if not out or out[-1] != (None, key, False):
                out.append(Line(None, key, False))
        else:
            out.append(Line(line, xxhash.xxh3_64_intdigest(line), x))
    return out


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """Bit-parallel rows of the alignment after each of ``a`` (or the last alone): bit j is 0 where the length grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if every:
            rows.append(v)
    return rows if every else [v]


#: Bits of alignment held at once; longer pages are aligned in halves.
HELD = 1 << 28


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of ``a`` and every beginning of ``b``."""
    v = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits == 0))


def lcs(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    both = set(a).intersection(b)
    at = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in at], [x for x in b if x in both]
    if len(a) > 1 and len(a) * len(b) > HELD:
        mid = len(a) // 2
        cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
        found = lcs(a[:mid], b[:cut]) + [mid + i for i in lcs(a[mid:], b[cut:])]
        return [at[i] for i in found]
    rows = _rows(a, b, True)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(at[i])
    return out[::-1]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; what isn't one has itself as path."""
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.rpartition("@")[2].lower(), parts.path.rstrip("/") or "/")
    except ValueError:
        return "", url or ""


def parsed(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """Per page: its row's key (batch, row), id, url, host, path, its text blocks, and of its lines the keys, the numbers
    of their blocks (-1: a slot), the blocks' sizes, and whether they are inside an article."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                where = [address(u) for u in part.column(1).to_pylist()]
                number = [np.where(t := np.array([x.text is not None for x in f], bool), np.cumsum(t) - 1, -1) for f in found]
                made = [
                    pa.array([uuid.uuid4().hex] * len(found)), pa.array(range(len(found)), pa.int32()), part.column(0), part.column(1),
                    pa.array([w[0] for w in where], pa.string()), pa.array([w[1] for w in where], pa.string()),
                    pa.array([[x.text for x in f if x.text is not None] for f in found], pa.list_(pa.string())),
                    pa.array([np.array([x.key for x in f], np.uint64).view(np.int64) for f in found], pa.list_(pa.int64())),
                    pa.array(number, pa.list_(pa.int32())),
                    pa.array([[len(x.text or "") for x in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[x.inside for x in f] for f in found], pa.list_(pa.bool_())),
                ]
                yield pa.RecordBatch.from_arrays(made, ["batch", "row", id_col, url, "host", "path", "blocks", "keys", "number", "sizes", "inside"])

    schema = f"batch string, row int, `{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, host string, path string, blocks array<string>, `keys` array<bigint>, number array<int>, sizes array<int>, inside array<boolean>"
    return pages.select(id_col, url, html).mapInArrow(run, schema)


def frequent(light: DataFrame, page: str, least: int, only: DataFrame | None = None) -> DataFrame:
    """(host, common): the blocks on more than half of a host's different pages, told apart by ``page``, if these are ``least`` or more.

    A host has at most twice as many of them as a page of it has lines on the average. ``only``: hosts and candidates.
    """
    text = F.filter(F.arrays_zip("keys", "number"), lambda x: x["number"] >= 0)
    rows = light.select("host", F.col(page).alias("page"), F.array_distinct(F.transform(text, lambda x: x["keys"])).alias("own")).where("size(own) > 0")
    pages = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    if only is not None:
        rows = rows.join(sized(only), "host").withColumn("own", F.array_intersect("own", "common"))
    each = rows.select("host", "page", F.explode("own").alias("k")).distinct().groupBy("host", "k").agg(F.count("*").alias("n")).where("n > 1")
    many = each.join(sized(pages), "host").where(2 * F.col("n") > F.col("pages"))
    return keep(many.groupBy("host").agg(F.collect_list("k").alias("common")), "frequent")


def marked(light: DataFrame) -> DataFrame:
    """The pages with ``mark``, the longest block that isn't frequent on the host, and ``free``: which lines may be deleted."""
    light = light.withColumn("whole", F.xxhash64("keys"))
    often = frequent(light, "whole", 3)
    light = light.join(sized(often), "host", "left")
    usual = F.coalesce("common", F.array().cast("array<bigint>"))
    zipped = F.arrays_zip("keys", "number", "sizes")
    longest = lambda x: F.array_max(F.transform(x, lambda y: F.struct(y["sizes"].alias("s"), y["keys"].alias("k"))))["k"]
    text = F.filter(zipped, lambda x: x["number"] >= 0)
    rare = F.filter(text, lambda x: ~F.array_contains(usual, x["keys"]))
    light = light.withColumn("mark", F.coalesce(longest(rare), longest(text), F.lit(0).cast("long"))).drop("common", "whole")
    site = frequent(light, "mark", LEAST_PAGES, often).withColumnRenamed("common", "site")
    light = light.join(sized(site), "host", "left")
    own = F.coalesce("site", F.array().cast("array<bigint>"))
    return light.withColumn("free", F.zip_with("keys", "inside", lambda k, inside: ~inside | F.array_contains(own, k))).drop("site", "inside")


def ordered(light: DataFrame, id_col: str) -> DataFrame:
    """Pages by host and path over range partitions, numbered within each (part, idx)."""
    rows = light.repartitionByRange("host", "path", F.col(id_col).asc_nulls_first(), "batch", "row").sortWithinPartitions("host", "path", F.col(id_col).asc_nulls_first(), "batch", "row")
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id())
    return keep(rows, "by_url")


def neighbours(rows: DataFrame) -> DataFrame:
    """Each page with the nearest pages before and after it in the order that are no copies of it, across partitions too.

    Between partitions copies are passed over up to the end of the next partition.
    """
    side = F.struct("host", "path", "keys", "mark")
    w = Window.partitionBy("part").orderBy("idx")
    new = F.coalesce((F.lag("mark").over(w) != F.col("mark")) | (F.lag("host").over(w) != F.col("host")), F.lit(False))
    end = F.coalesce((F.lead("mark").over(w) != F.col("mark")) | (F.lead("host").over(w) != F.col("host")), F.lit(False))
    rows = rows.withColumn("_b", F.when(new, F.lag(side).over(w))).withColumn("_a", F.when(end, F.lead(side).over(w)))
    rows = rows.withColumn("before", F.last("_b", ignorenulls=True).over(w)).drop("_b")
    # from the end: a frame that reaches forward to it would be gone through anew for each row
    back = Window.partitionBy("part").orderBy(F.col("idx").desc())
    rows = keep(rows.withColumn("after", F.last("_a", ignorenulls=True).over(back)).drop("_a"), "sides")
    edge = rows.groupBy("part").agg(F.min_by(side, "idx").alias("first"), F.max_by(side, "idx").alias("last"), F.min_by("after", "idx").alias("second"), F.max_by("before", "idx").alias("previous"))
    order = Window.orderBy("part")  # one small row for each partition
    edge = edge.select("part", *(f(c).over(order).alias(n) for f, c, n in ((F.lag, "last", "_p1"), (F.lag, "previous", "_p2"), (F.lead, "first", "_n1"), (F.lead, "second", "_n2"))))
    near = rows.join(sized(edge), "part")
    over = lambda one, two: F.when((F.col(one)["mark"] == F.col("mark")) & (F.col(one)["host"] == F.col("host")), F.coalesce(two, one)).otherwise(F.col(one))
    return near.select("batch", "row", "host", "path", "keys", "number", "free", "mark", F.coalesce("before", over("_p1", "_p2")).alias("before"), F.coalesce("after", over("_n1", "_n2")).alias("after"))


def shared_lines(near: DataFrame) -> DataFrame:
    """(batch, row, gone, slots, alone): the numbers of the blocks that a page has in common with its nearest page, how
    many of its slots the nearest pages have too, and how many are in none."""

    def choose(r: dict) -> tuple[list[int], int, int]:
        sides = [s for s in (r["before"], r["after"]) if s]
        sides.sort(key=lambda s: (s["host"] != r["host"], -_common(r["path"], s["path"])))
        slots, gone, found = {i for i, n in enumerate(r["number"]) if n < 0}, None, set()
        for s in sides:
            same = lcs(r["keys"], s["keys"])
            found |= slots.intersection(same)
            if gone is None and s["host"] == r["host"] and s["mark"] != r["mark"]:
                gone = [r["number"][i] for i in same if r["number"][i] >= 0 and r["free"][i]]
        return gone or [], len(found), len(slots) - len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [choose(r) for r in batch.to_pylist()]
            gone, slots, alone = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(slots, pa.int32()), pa.array(alone, pa.int32())], ["batch", "row", "gone", "slots", "alone"])

    return near.mapInArrow(run, "batch string, row int, gone array<int>, slots int, alone int")


def differenced(pages: DataFrame, id_col: str, url: str, html: str) -> tuple[DataFrame, DataFrame]:
    """The parsed pages, and of each what differencing found."""
    rows = keep(parsed(pages, id_col, url, html), "blocks")
    order = ordered(marked(rows.drop("blocks", url)), id_col)
    return rows, keep(shared_lines(neighbours(order)), "shared")


def report(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row: pages, slots that differencing deletes, slots that the markup alone leaves out, and text blocks that differencing deletes."""
    _, found = differenced(pages, id_col, url, html)
    return found.agg(F.count("*").alias("pages"), F.sum("slots").alias("slots"), F.sum("alone").alias("alone"), F.sum(F.size("gone")).alias("blocks"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: id_col, url, text (blocks joined by line feeds), n_chars.

    Null html counts as empty and gives an empty text. Pages with null or odd URLs are of one host without a
    name. Repeated rows are pages of their own. Extra columns are ignored.
    """
    rows, found = differenced(pages, id_col, url, html)
    out = rows.select("batch", "row", id_col, url, "blocks").join(sized(found.where("size(gone) > 0").select("batch", "row", "gone")), ["batch", "row"], "left")
    left = F.filter("blocks", lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(left), "\n")
    return out.select(id_col, url, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
