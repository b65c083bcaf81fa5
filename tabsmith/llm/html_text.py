"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

A page is parsed into text blocks, each with the containers it stands in. Pages are ordered by host
and path; each is paired with the neighbour that shares the longer path prefix, their blocks are
aligned by a longest common subsequence, and shared blocks go. Blocks in menus, adverts and the
like are aligned by their slot in the template, other blocks by their text. A check of the
containers follows: what stands in the article is no template even if two pages share it, and
what stands in a menu is one even if the pages differ."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import digest, stored

#: Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math object select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
             "time tt u var ruby rb rt rp wbr img".split())
TEMPLATE = set("nav header footer aside form menu dialog head".split())
TEMPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TEMPLATE_NAMES = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                     "submenu breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices gdpr popup "
                     "modal newsletter subscribe signup login search share sharing social related recommended comment comments reply "
                     "replies respond disqus pagination pager toolbar widget skip hidden".split())
ARTICLE_ROLES = set("main article".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
               "menu nav ol p pre section table ul".split())
BODY = set("html body main article".split())
OPEN, CONTENT, SLOT = 0, 1, 2
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


def _kind(tag: str, attributes: str) -> int:
    if tag in TEMPLATE:
        return SLOT
    if attributes and "=" in attributes:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "")
        if role in TEMPLATE_ROLES or "display:none" in found.get("style", "").replace(" ", ""):
            return SLOT
        if tag not in BODY:
            for name in (found.get("class", "") + " " + found.get("id", "")).split():
                parts = set(_NAME.findall(name))
                if parts & TEMPLATE_NAMES and not parts & {"with", "has", "no", "without"}:
                    return SLOT
        if role in ARTICLE_ROLES:
            return CONTENT
    if attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes.lower()):
        return SLOT
    return CONTENT if tag in ("article", "main") else OPEN


def text_blocks(page: str) -> list[tuple[str, int, str]]:
    """(text, kind, slot) of each block of a page with text, in page order. The slot names the open
    elements. Malformed markup is read as far as it goes; an unclosed element ends with its parent."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, int]] = []  # element, kind that it and what it holds have
    words: list[str] = []

    def end_block() -> None:
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                kinds = [k for _, k in stack]
                kind = SLOT if SLOT in kinds else CONTENT if CONTENT in kinds else OPEN
                out.append((text, kind, ">".join(t for t, _ in stack)))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at:m.start()])
        at = m.end()
        if m[1] is None:
            if m[0].startswith("<![CDATA["):
                words.append(html.escape(m[0][9:-3], quote=False))
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            if tag not in INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            end_block() if tag not in INLINE else None
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag not in INLINE:
            end_block()
        if tag in VOID or m[2].rstrip().endswith("/") and tag not in CLOSES_P:
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph, or item of the same list, ends here
                if stack[k][0] == "p" or stack[k][0] == tag and tag not in CLOSES_P:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("dt", "dd", "td", "th"):
                    break
        stack.append((tag, _kind(tag, m[2])))
    end_block()
    return out


def block_keys(blocks: list[tuple[str, int, str]]) -> list[int]:
    """What the blocks are aligned by: the slot for blocks of the template, the text for others."""
    return [int.from_bytes(blake2b((slot if kind == SLOT else "\0" + text).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
            for text, kind, slot in blocks]


def common_positions(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k] = j
                chains[k] = link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _paired(rows: list[dict]) -> Iterator[tuple[dict, dict | None]]:
    """Each of the sorted rows with its nearest neighbour of the same host: the one that shares the
    longer path prefix, the earlier one if both do."""
    for i, row in enumerate(rows):
        near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j]["host"] == row["host"]]
        yield row, max(near, key=lambda x: _prefix(x["path"], row["path"]), default=None)


def _shared(row: dict, near: dict | None) -> list[int]:
    return common_positions(row["blocks"], near["blocks"]) if near else []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")


#: Edge of a run of pages: 1 marks its first and last row, whose pair may lie beyond it; 2 a further
#: copy of the row next to one of those.
INNER, END, NEXT_TO_END = 0, 1, 2
ORDER = ("host", "path", "id", "url", "page")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted run with the blocks that they share with their pair inside the run."""
    held: list[dict] = []  # the last two rows; the newest hasn't been given out
    given = 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held:
                at = len(held) - 1
                pair = list(_paired([*held, row]))[at][1]
                out.append(held[at] | {"shared": _shared(held[at], pair), "edge": INNER if given else END})
                if given == 1:
                    out.append(held[at] | {"shared": [], "edge": NEXT_TO_END})
                given += 1
            held = [*held[-1:], row]
        yield _batch(out, batch.schema)
    if held:
        at = len(held) - 1
        out = [held[at] | {"shared": _shared(held[at], list(_paired(held))[at][1]), "edge": END}]
        if given > 2:
            out.append(held[0] | {"shared": [], "edge": NEXT_TO_END})
        yield _batch(out, batch.schema)


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of all runs in order: those that are first or last in a run, paired over the border."""
    rows, schema = [], None
    for batch in batches:
        schema = batch.schema
        rows += batch.to_pylist()
    if rows:
        out = [row | {"shared": _shared(row, pair)} for row, pair in _paired(rows) if row["edge"] == END]
        yield pa.RecordBatch.from_pylist(out, schema)


def _batch(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(out, pa.schema([*schema, ("shared", pa.list_(pa.int32())), ("edge", pa.int32())]))


def _rows(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    url, body = F.col(url_col).cast("string"), F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), url.alias("url"), digest(body).alias("page"), body.alias("body"))


def shared_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, page, shared): per distinct row the positions of the blocks that its pair has too.

    Block keys, a few bytes a block, are sorted by host and path over range partitions, and each
    task goes through its run of pages with three in hand. The ends of the runs, four rows a task,
    are paired over the borders in a second pass, so the pairs don't depend on where the borders
    are; a host of any size is spread over many runs."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [block_keys(text_blocks(page)) for page in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ORDER), pa.array(keys, pa.list_(pa.int64()))], [*ORDER, "blocks"])

    rows = _rows(pages, id_col, url_col, body_col).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "*")
    fields = f"host string, path string, id {rows.schema['id'].dataType.simpleString()}, url string, page binary, blocks array<long>"
    keys = stored(rows.mapInArrow(keyed, fields), "blocks")
    done = stored(keys.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_run, f"{fields}, shared array<int>, edge int"), "runs")
    ends = done.where(F.col("edge") != INNER).repartition(1).sortWithinPartitions(*ORDER).mapInArrow(_border, done.schema)
    return (done.where(F.col("edge") == INNER).unionByName(ends).groupBy("id", "url", "page").agg(F.min("shared").alias("shared")))


def main_blocks(blocks: list[tuple[str, int, str]], shared: list[int]) -> list[str]:
    """The blocks of the main text. Shared blocks go, but for those of an article; then blocks of the
    template go that the pair didn't have. A page with an article has no other main text. If its
    pair has all blocks of a page without article, the two are copies and the blocks stay."""
    gone = set(shared)
    article = [t for t, kind, _ in blocks if kind == CONTENT]
    if article:
        return article
    left = [(i, t) for i, (t, kind, _) in enumerate(blocks) if kind == OPEN]
    own = [t for i, t in left if i not in gone]
    return own or [t for _, t in left]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row: the main text, its blocks joined by a line feed.

    A null or empty page has an empty text. Rows may repeat, ids and urls may be null (pages without
    a url count as of one host); pages without a neighbour on their host are only checked by
    their containers. Very long pages are parsed whole; malformed markup is read as far as it
    goes. An empty table gives no rows. Other columns are ignored.

    The table of shared blocks is broadcast up to 100,000 counted rows; beyond, the pages are
    shuffled to meet it."""
    shared = stored(shared_blocks(pages, id_col, url_col, body_col), "shared")
    few = shared.count() <= 100_000
    rows = _rows(pages, id_col, url_col, body_col)
    other = shared.withColumnsRenamed({"id": "id2", "url": "url2", "page": "page2"})
    rows = rows.join(F.broadcast(other) if few else other, rows["id"].eqNullSafe(other["id2"]) & rows["url"].eqNullSafe(other["url2"]) & (rows["page"] == other["page2"]), "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(main_blocks(text_blocks(page), gone or [])) for page, gone in zip(batch.column("body").to_pylist(), batch.column("shared").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "url", "body", "shared").mapInArrow(texts, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_extraction(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
