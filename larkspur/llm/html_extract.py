"""Main text of web pages by nearest-URL page differencing.

A page is read into text lines, one for each block. Structure settles the clear cases: elements, roles, classes and ids of
menus, headers, footers, sidebars, notices, adverts, forms and comments never hold main text, and where a page marks its
article (or main part) nothing outside of it does. Then pages are differenced: within each host, pages in the order of their URL paths
are paired with the ones before and after, their lines aligned by a longest common subsequence, and shared lines
deleted, for what two pages share is the site's template. Two guards keep what articles share with each other, such
as a quotation: a line inside the marked article of both pages stays, and a page all of whose main lines are shared is a copy, of which
the neighbour says nothing.

Pages are dealt out by range of (host, path), so a host with very many pages lies in many tasks; a task holds two pages
at a time, and the pages at the borders of the tasks are paired afterwards.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
import xxhash
from larkspur.llm.store import cut, partitions, small_batches
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The attributes of a tag: quotes count after an equals sign only, and > ends the tag outside of such a value.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-z])[^>]*(?:>|\Z)"
    rf"|<(script|style|noscript|template|svg|math|iframe|textarea|title|object)(?![^\s/>]){_ATTRIBUTES}>.*?(?:</\1(?![^\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li listing main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = set("aside button datalist dialog fieldset footer form head menu nav option search select".split())
#: Blocks that end an open paragraph.
_ENDS_P = _BLOCK - set("body br caption html legend li dd dt option summary tbody tfoot thead tr".split())
#: What an opening element ends, and the elements beyond which it ends nothing.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr"}, {"table"})}
_ENDS |= dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, {"dl"})) | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr"}, {"table"}))
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids of what is no main text. Those in _LAYOUT also name frames of a page, inside which the article itself may lie.
_LAYOUT = set(
    "banner banners modal overlay popup popups sidebar sidebars widget widgets menu menus nav navbar navigation masthead topbar toolbar notice notices alert alerts "
    "social share sharing promo promos promotion promotions header".split()
)
_OTHER = set(
    "ad ads advert adverts advertisement advertisements adbox sponsor sponsors sponsored cookie cookies consent gdpr newsletter subscribe subscription breadcrumb breadcrumbs footer "
    "comment comments disqus replies respond related recommend recommended recommendation recommendations teaser teasers pagination pager login signup".split()
)
#: Words that leave another word's meaning as it is; a name made of these and one of the above is such a name.
_PLAIN = set(
    "site page main global top bottom left right primary secondary first second inner outer box block blocks bar area section sections container wrapper wrap list lists item items content "
    "contents column col row panel card cards unit slot zone region group inline sticky fixed mobile desktop small large widget post posts article articles story stories link links news more "
    "read reading also form body text header footer title label message msg info buttons button icons icon media count thread reply author entry view js the and of us our your this for by".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@lru_cache(20_000)
def _named(name: str) -> int:
    """2 for a class name or id of what is never main text, 1 for one that a frame around the main text may have too, 0 for others.

    A name counts as a whole: each of its words has to be such a word or a plain one, so that has-sidebar, no-comments and related-work say nothing.
    """
    words = [w.lower() for w in _WORDS.findall(name.replace("side-bar", "sidebar").replace("pop-up", "popup").replace("sign-up", "signup").replace("log-in", "login"))]
    words = [w for w in words if not w.isdigit()]
    said = [w for w in words if w in _LAYOUT or w in _OTHER]
    if not said or any(w not in _LAYOUT and w not in _OTHER and w not in _PLAIN for w in words) or said == ["header"] and not {"site", "page", "top", "global"} & set(words):
        return 0
    return 2 if any(w in _OTHER for w in said) else 1


def _attributes(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def _boilerplate(name: str, attributes: str, in_article: bool) -> int:
    """2 for an element that never holds main text, 1 for one that does so only where it holds the page's article, 0 for others."""
    if name in _NEVER or (name == "header" and not in_article):
        return 2
    least = 0
    if attributes and not attributes.isspace():
        has = _attributes(attributes)
        if has.get("role", "").strip().lower() in _ROLES or "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true":
            return 2
        if "style" in has and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", has["style"], re.I):
            return 2
        if name not in ("body", "html", "main"):
            for value in (has.get("class"), has.get("id")):
                for word in value.split() if value else ():
                    least = max(least, _named(word))
    return least


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block: 0 template by structure, 1 main text, 2 main text inside an <article>.

    Where a page has an <article>, it alone is main text; else the <main> or role=main, if there is one. Where all of these
    lie in elements whose class names a frame of the page (such as a sidebar layout), those elements count for nothing. Tags are read as browsers
    read them: an attribute may be malformed, blocks end an open paragraph, an item ends the one before.
    """
    if not page:
        return []
    out, parts, last = [], [], 0
    stack: list[tuple[str, int, int, tuple]] = []  # name; whether inside boilerplate, inside a main part (1) or an article (2), the frames that it is in
    skip, inside, frames = 0, 0, ()
    n_frames = 0
    marks: list[tuple[int, tuple]] = []  # main parts and articles outside of boilerplate, with the frames that each is in

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, skip, inside, frames))
            parts.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > last:
            parts.append(page[last : m.start()])
        last = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in _BLOCK and name not in _NEVER:
            if name in ("td", "th"):
                parts.append(" ")
            if m[2]:
                if stack and stack[-1][0] == name:  # only what is boilerplate, or lies in an element of the same name that is
                    flush()
                    _, skip, inside, frames = stack.pop()
            elif name not in _VOID:
                if stack and stack[-1][0] == name:
                    stack.append((name, skip, inside, frames))
                elif _boilerplate(name, m[4], inside > 0):
                    flush()
                    stack.append((name, skip, inside, frames))
                    skip = 2
            continue
        flush()
        if name in _VOID:
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    _, skip, inside, frames = stack[i]
                    del stack[i:]
                    break
            continue
        ends = [({"p"}, _BLOCK - {"p"})] if name in _ENDS_P else []
        for closed, bound in [*ends, *([_ENDS[name]] if name in _ENDS else ())]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    _, skip, inside, frames = stack[i]
                    del stack[i:]
                    if name not in ("tbody", "thead", "tfoot"):
                        break
                elif stack[i][0] in bound:
                    break
        stack.append((name, skip, inside, frames))
        found = _boilerplate(name, m[4], inside > 0)
        if found == 1 and name != "article":
            n_frames += 1
            frames = (*frames, n_frames)
        elif found:
            skip = 2
        if not skip and (name in ("article", "main") or "role" in m[4].lower() and _attributes(m[4]).get("role", "").strip().lower() == "main"):
            inside = max(inside, 2 if name == "article" else 1)
            marks.append((inside, frames))
    if last < len(page):
        parts.append(page[last:])
    flush()
    free = [k for k, f in marks if not f]
    cleared = set() if free else {x for _, f in marks for x in f}
    marked = max(free or (k for k, _ in marks), default=0)
    return [(text, 0 if s or inside < marked or not cleared.issuperset(f) else 2 if inside == 2 else 1) for text, s, inside, f in out]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends, links = [], []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def template_lines(mine: tuple[list[int], bytes], other: tuple[list[int], bytes]) -> list[int]:
    """Positions of my main lines that the neighbour shows to be template."""
    lines, kinds = mine
    shared = [i for i, j in common(lines, other[0]) if kinds[i] and not (kinds[i] == 2 and other[1][j] == 2)]
    if not shared:
        return []
    return [] if len(shared) >= sum(k > 0 for k in kinds) else shared


def _place(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("rk", F.xxhash64("page_id", "url", "html"))
    rest = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "[?#].*$", "")
    return rows.withColumn("host", F.lower(F.substring_index(rest, "/", 1))).withColumn("path", F.regexp_replace(rest, "^[^/]*", ""))


def _parsed(batches):
    """Reads each page once: hashes and kinds of all its lines, and the main lines with their positions."""
    for batch in batches:
        lines, kinds, at, texts = [], [], [], []
        for page in batch.column(batch.num_columns - 1):
            found = page_lines(page.as_py())
            main = [i for i, (_, kind) in enumerate(found) if kind]
            lines.append([xxhash.xxh3_64_intdigest(t) - 2**63 for t, _ in found])
            kinds.append(bytes(k for _, k in found))
            at.append(main)
            texts.append([found[i][0] for i in main])
        more = (pa.array(lines, pa.list_(pa.int64())), pa.array(kinds, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "lines", "kinds", "at", "texts"])


_VERDICT = "rk long, gone array<int>, part int, host string, lines array<long>, kinds binary"


def _neighbours(batches):
    """Pairs each page with the next one of its host; the first and last page of the task go out whole."""
    part, before, single = TaskContext.get().partitionId(), None, True
    fields = ["rk", "gone", "part", "host", "lines", "kinds"]
    types = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=fields)

    for batch in batches:
        out = []
        for host, _, rk, lines, kinds in zip(*(c.to_pylist() for c in batch.columns)):
            now = (host, rk, (lines, kinds))
            if before is None:
                out.append((rk, None, part, host, lines, kinds))
            else:
                single = False
                if before[0] == host:
                    for me, you in ((before, now), (now, before)):
                        if gone := template_lines(me[2], you[2]):
                            out.append((me[1], gone, part, None, None, None))
            before = now
        if out:
            yield rows(out)
    if before is not None and not single:
        yield rows([(before[1], None, part, before[0], *before[2])])


def _borders(batches):
    for batch in batches:
        rk, gone = [], []
        for r, host, lines, kinds, r2, host2, lines2, kinds2 in zip(*(c.to_pylist() for c in batch.columns)):
            if host is not None and host == host2:
                for a, me, you in ((r, (lines, kinds), (lines2, kinds2)), (r2, (lines2, kinds2), (lines, kinds))):
                    if found := template_lines(me, you):
                        rk.append(a)
                        gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["rk", "gone"])


def verdicts(parsed: DataFrame) -> DataFrame:
    """(rk, gone): positions of the main lines to delete, for each page that has any."""
    light = parsed.where("host <> ''").select("host", "path", "rk", "lines", "kinds")
    n = partitions(parsed.sparkSession)
    dealt = light.repartitionByRange(n, "host", "path", "rk").sortWithinPartitions("host", "path", "rk")
    found = cut(dealt.mapInArrow(_neighbours, _VERDICT))
    edge = found.where("gone is null")
    order = Window.orderBy("part", F.monotonically_increasing_id())
    follow = [F.lead(c).over(order).alias(f"{c}2") for c in ("part", "rk", "host", "lines", "kinds")]
    edge = edge.select("part", "rk", "host", "lines", "kinds", *follow).where("part2 <> part")
    across = edge.select("rk", "host", "lines", "kinds", "rk2", "host2", "lines2", "kinds2").mapInArrow(_borders, "rk long, gone array<int>")
    every = found.where("gone is not null").select("rk", "gone").union(across)
    return every.groupBy("rk").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null or empty page has the empty text. A page without a URL is read by its structure alone. Rows equal in id, URL and
    html are one page and have one text. Pages are read whole, however long; of equal paths the order is that of a hash. Other columns are not
    read, whatever their names.
    """
    small_batches(pages.sparkSession)
    placed = _place(pages, id_col, url_col, html_col).select("page_id", "url", "host", "path", "rk", "html")
    schema = placed.drop("html").schema
    for name, kind in (("lines", T.ArrayType(T.LongType())), ("kinds", T.BinaryType()), ("at", T.ArrayType(T.IntegerType())), ("texts", T.ArrayType(T.StringType()))):
        schema = schema.add(name, kind)
    parsed = cut(placed.mapInArrow(_parsed, schema))
    found = cut(verdicts(parsed)).withColumnRenamed("rk", "rk_")
    joined = parsed.join(found, F.col("rk") == F.col("rk_"), "left")
    left = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda t, i: ~F.array_contains("gone", F.get("at", i))))
    return joined.select("page_id", "url", F.array_join(left, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
