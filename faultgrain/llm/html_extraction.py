"""The main text of web pages: landmarks of the markup, and what a page shares with its nearest neighbour by URL.

A page is cut into lines, one for each block of text. Pages of a host are put in the order of their paths, and each is paired
with the nearest one that isn't its copy. The longest common subsequence of both pages' lines is what the site
repeats, and is deleted, on every page. Landmarks (article, nav, class names) then judge what is left, and give articles back
what they share with a neighbour, as texts of a site quote each other.
"""

from __future__ import annotations

import hashlib
import html
import os
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, has_bit, map_arrow, membership_bits, row_id
from faultgrain.operators.ordering import positioned

CHROME, PLAIN, ARTICLE = 0, 1, 2
#: Pages that are aligned in one task, and how many before and after them it sees too; partners further away are asked for.
BLOCK, REACH = 256, 8
#: Blocks that are asked in one round at most.
SPAN = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = set("script style title textarea iframe noembed noframes xmp template svg math object".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
_CHROME_TAGS = set("nav footer aside form button select dialog menu head noscript search".split())
_TOLD_TAGS = _CHROME_TAGS | {"article", "main", "header"}
_CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or an id that say what isn't the article.
_HINTS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "subscribe subscription newsletter signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead toolbar share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond pagination pager".split()
)
_COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}


def _label(name: str, attributes: str, parent: int, hinted: bool) -> tuple[int, bool]:
    """What an element's text is, and whether it is chrome by a hint alone, which an article in it overrules."""
    if not attributes and name not in _TOLD_TAGS:
        return parent, hinted and parent == CHROME
    found = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes else {}
    words = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")} if found else set()
    role = found.get("role", "").lower()
    if name in ("article", "main") or role in ("article", "main") or found.get("itemprop") == "articleBody":
        return (CHROME, False) if words & _COMMENTS or parent == CHROME and not hinted else (ARTICLE, False)
    if parent == CHROME:
        return parent, hinted and not words & _COMMENTS
    if name in _CHROME_TAGS or role in _CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or name == "header" and parent != ARTICLE:
        return CHROME, False
    if words & _HINTS and name not in ("html", "body"):
        return CHROME, not words & _COMMENTS
    return parent, False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, label, whether a heading of the first level) of each block of a page's text, in order. White space is one space, references are decoded."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = [("", PLAIN, False)]
    text: dict[int, list[str]] = {CHROME: [], PLAIN: []}  # of the open block: what its chrome parts say, and the rest
    block = [PLAIN, False]

    def close() -> None:
        for part, label in ((CHROME, CHROME), (PLAIN, block[0])):
            if text[part]:
                line = " ".join("".join(text[part]).split())
                if line:
                    out.append((line, label, block[1]))
                text[part].clear()

    def say(piece: str) -> None:
        label = stack[-1][1]
        if "&" in piece:
            piece = html.unescape(piece)
        if label == CHROME:
            text[CHROME].append(piece)
            return
        if not text[PLAIN]:
            block[:] = label, any(n == "h1" for n, _, _ in stack[-3:])
        text[PLAIN].append(piece)

    at, n = 0, len(page)
    for_end = page.lower() if "<" in page else page
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        end, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if name in _RAW and not end:
            if not rest.endswith("/"):
                stop = for_end.find(f"</{name}", at)
                at = n if stop < 0 else stop
            continue
        if name in _BLOCKS:
            close()
        elif name in ("br", "td", "th"):
            say(" ")
        if end:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if k:
                del stack[k:]
        elif name not in _VOID and not (rest.endswith("/") and name not in _BLOCKS):
            if name == "p" and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
                stack.pop()  # an open one ends where the next begins
            label, hinted = _label(name, rest, *stack[-1][1:])
            stack.append((name, label, hinted))
    close()
    return out


def main_text(lines: list[tuple[str, int, bool]], gone: set[int]) -> str:
    """The text of a page whose lines ``gone`` its partner has too. Articles keep such lines, all else loses them; chrome goes.

    Where landmarks tell the article, as it has half of what is left, headings of the first level are all that stays beside it.
    """
    left = [line for k, line in enumerate(lines) if line[1] == ARTICLE or line[1] == PLAIN and k not in gone]
    size = lambda label: sum(len(t) for t, x, _ in left if x == label)
    told = size(ARTICLE) >= size(PLAIN)
    return "\n\n".join(t for t, label, head in left if label == ARTICLE or head or not told)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """The places in a of a longest common subsequence of a and b, by rows of bits."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    at: dict[int, int] = {}
    for j, line in enumerate(y):
        at[line] = at.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, row = [], full
    for line in x:
        met = row & at.get(line, 0)
        row = (row + met | row - met) & full
        rows.append(row)
    i, j, middle = len(x), len(y), []
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            middle.append(head + i)
            j -= 1
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


# --- pairing


def place(url: str | None) -> tuple[str | None, str]:
    """Host and path of a URL, without query and fragment; no host where it has none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or None), parts.path
    except ValueError:
        return None, ""


_LINES = "k_id long, k_tag long, host string, path string, hashes array<long>, sizes array<int>, labels array<byte>"


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
            lines = lines_of(page.as_py() or "")
            row = (*place(url.as_py()), [_hash(t) for t, _, _ in lines], [len(t) for t, _, _ in lines], [x for _, x, _ in lines])
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8())]
        yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_tag"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["k_id", "k_tag", "host", "path", "hashes", "sizes", "labels"])


def _in_order(pages: pa.Table) -> list[dict]:
    """The pages in order, with the hashes and sizes of their lines, chrome aside."""
    rows = sorted(pages.to_pylist(), key=lambda r: r["position"])
    for row in rows:
        kept = [(h, n) for h, n, label in zip(row["hashes"], row["sizes"], row["labels"], strict=True) if label != CHROME]
        row["lines"], row["long"] = [h for h, _ in kept], [n for _, n in kept]
    return rows


def _content(page: dict) -> int:
    return _hash(repr((page["lines"], page["long"])))


class _Holders:
    """Which of some pages have a line."""

    def __init__(self, rows: list[dict]):
        sets = [[*set(r["hashes"])] for r in rows]
        lines, pages = np.array([h for s in sets for h in s], np.int64), np.repeat(np.arange(len(rows)), [len(s) for s in sets])
        order = np.argsort(lines, kind="stable")
        self.n, self.lines, self.pages = len(rows), lines[order], pages[order]

    def copies(self, page: dict) -> np.ndarray:
        """Which pages are copies: they have the longest of its lines, chrome aside, and three quarters of their text."""
        if not page["lines"]:
            return np.zeros(self.n, bool)
        lines, sizes = np.array(page["lines"]), np.array(page["long"])
        first, end = (np.searchsorted(self.lines, lines, side) for side in ("left", "right"))
        many = end - first
        at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        out = 4 * np.bincount(self.pages[at], np.repeat(sizes, many), self.n) >= 3 * sizes.sum()
        longest = max(range(len(lines)), key=lambda k: (page["long"][k], page["lines"][k]))
        having = np.zeros(self.n, bool)
        having[self.pages[first[longest] : end[longest]]] = True
        return out & having


def _shared(a: dict, b: dict) -> int:
    """How many segments at the beginning of their paths two pages share."""
    return len(os.path.commonprefix([a["path"].split("/"), b["path"].split("/")]))


_NOWHERE = {"position": None}


def _partner(rows: list[dict], k: int, copies: np.ndarray, last: int, far: dict[tuple[bool, int], dict] | None = None) -> tuple[dict | None, list[bool]]:
    """The nearest page of the same host that isn't a copy: by shared path segments, then by places away, the one before first. And the sides where it has to be asked for.

    In their order, pages share the fewer segments the further away they are, so each side's first that isn't a copy is its nearest. Where copies reach
    up to the end of what the block sees, ``far`` has the answer; without it, a side is asked if what stands beyond may be nearer than what is known.
    ``last`` is the position of the last of all pages.
    """
    own, known, asked = rows[k], [], []
    if own["host"] is None:
        return None, []
    rank = lambda x, away, after: (-_shared(own, x), away, after)
    for after in (False, True):
        others = range(k + 1, len(rows)) if after else range(k - 1, -1, -1)
        found = next((rows[j] for j in others if not copies[j] or rows[j]["host"] != own["host"]), None)
        edge = rows[others[-1]] if others else own
        if found is None and edge["position"] != (last if after else 0):
            asked.append((rank(edge, abs(edge["position"] - own["position"]) + 1, after), after))
            found = far.get((after, _content(own)), _NOWHERE) if far else _NOWHERE
        if found is not None and found["position"] is not None and found["host"] == own["host"]:
            known.append((rank(found, abs(found["position"] - own["position"]), after), found))
    best = min(known, key=lambda x: x[0], default=None)
    return best and best[1], [after for least, after in asked if far is None and (best is None or least < best[0])]


_KEY = ["block", "after", "content"]
_ALIGNED = "k_id long, k_tag long, gone array<int>, block long, after boolean, content long, host string, lines array<long>, long array<int>"
_ALIGNED_ARROW = pa.schema([("k_id", pa.int64()), ("k_tag", pa.int64()), ("gone", pa.list_(pa.int32())), ("block", pa.int64()), ("after", pa.bool_()), ("content", pa.int64()), ("host", pa.string()), ("lines", pa.list_(pa.int64())), ("long", pa.list_(pa.int32()))])
_FAR = "block long, after boolean, content long, at long, position long, path string, hashes array<long>"
_FAR_ARROW = pa.schema([("block", pa.int64()), ("after", pa.bool_()), ("content", pa.int64()), ("at", pa.int64()), ("position", pa.int64()), ("path", pa.string()), ("hashes", pa.list_(pa.int64()))])


def _aligned(pages: pa.Table, last: int, answers: pa.Table | None = None) -> pa.Table:
    """(k_id, k_tag, gone) of the block's own pages: the lines that each shares with its partner, but for chrome, which goes anyway, and those of articles.

    Pages whose partner has to be asked for give a row for each side instead, pages of one text a common one, without a key. With ``answers``, only they have a row.
    """
    rows = _in_order(pages)
    holders = _Holders(rows)
    far = None if answers is None else {(x["after"], x["content"]): x for x in answers.to_pylist()}
    out, asks = [], {}
    for k, row in enumerate(rows):
        if not row["own"]:
            continue
        copies = holders.copies(row)
        partner, sides = _partner(rows, k, copies, last)
        for after in sides:
            asks[after, _content(row)] = {"block": row["block"], "after": after, "content": _content(row), "host": row["host"], "lines": row["lines"], "long": row["long"]}
        if bool(sides) != (far is not None):
            continue
        if sides:
            partner, _ = _partner(rows, k, copies, last, {at: x | {"host": row["host"]} for at, x in far.items()})
        gone = [i for i in common_lines(row["hashes"], partner["hashes"]) if row["labels"][i] == PLAIN] if partner else []
        if gone:
            out.append({"k_id": row["k_id"], "k_tag": row["k_tag"], "gone": gone})
    return pa.Table.from_pylist(out if far is not None else out + [*asks.values()], _ALIGNED_ARROW)


def _answered(asks: pa.Table, pages: pa.Table) -> pa.Table:
    """For each ask the first page of a block, from the asker's side, that isn't a copy; without a position where its host ends before. No row where all are copies."""
    rows, out = _in_order(pages), []
    holders, hosts = _Holders(rows), np.array([r["host"] for r in rows])
    for ask in asks.to_pylist():
        others = np.flatnonzero(~holders.copies(ask) | (hosts != ask["host"]))
        if len(others):
            found = rows[others[0 if ask["after"] else -1]]
            its = found if found["host"] == ask["host"] else dict.fromkeys(("position", "path", "hashes"))
            out.append({**{c: ask[c] for c in (*_KEY, "at")}, **{c: its[c] for c in ("position", "path", "hashes")}})
    return pa.Table.from_pylist(out, _FAR_ARROW)


def _far(asks: DataFrame, own: DataFrame, last: int, scratch: Scratch) -> DataFrame:
    """(block, after, content, position, path, hashes): what the pages of other blocks answer, each ask going from block to block until one does.

    own: the pages, by block. In a round every open ask goes to the next blocks on its side, twice as many as in the round before (SPAN at most).
    So a block meets the asks of SPAN blocks at most, which are one for each text in them.
    """
    found, done, span = None, 0, 1
    away = F.when(F.col("after"), F.col("at") - F.col("block")).otherwise(F.col("block") - F.col("at"))
    while True:
        at = lambda n: F.when(F.col("after"), F.col("block") + n).otherwise(F.col("block") - n)
        asks = asks.where(at(F.lit(done + 1)).between(0, last // BLOCK))
        if asks.isEmpty():
            return found
        sent = asks.withColumn("n", F.explode(F.sequence(F.lit(done + 1), F.lit(done + span)))).withColumn("at", at(F.col("n"))).drop("n").where(F.col("at").between(0, last // BLOCK))
        pages = own.join(sent.select(F.col("at").alias("block")).distinct(), "block", "left_semi").select(*own.columns)
        answers = scratch.written(sent.groupBy("at").cogroup(pages.groupBy("block")).applyInArrow(_answered, _FAR), "answers")
        nearest = answers.groupBy(*_KEY).agg(F.min_by(F.struct("position", "path", "hashes"), away).alias("x")).select(*_KEY, "x.*")
        found = nearest if found is None else found.unionByName(nearest)
        asks = scratch.written(asks.join(answers.select(*_KEY).distinct(), _KEY, "left_anti"), "asks")
        done, span = done + span, min(2 * span, SPAN)


def shared_lines(keyed_pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(k_id, k_tag, gone): the places of the lines that each of (k_id, k_tag, url, html) loses as its partner has them too; no row where there are none.

    Only numbers of lines travel. Pages are numbered in the order of (host, path segments, key) and aligned in blocks of BLOCK, each of
    which also gets the REACH pages before and after it, so a host of any size is dealt to many tasks and no result depends on how. Where
    copies of a page reach further, its text is sent to the next blocks until one has a page that isn't a copy.
    """
    rows = map_arrow(keyed_pages, _line_rows, _LINES).dropDuplicates(["k_id", "k_tag"])
    order = [F.col("host"), F.split("path", "/"), F.col("path"), F.col("k_id"), F.col("k_tag")]
    placed = positioned(rows, *(c.asc_nulls_first() for c in order))
    last = placed.count() - 1
    block = F.expr(f"position div {BLOCK}")
    to = lambda b, own: F.struct(b.alias("block"), F.lit(own).alias("own"))
    before, after = F.when(F.col("position") % BLOCK < REACH, to(block - 1, False)), F.when(F.col("position") % BLOCK >= BLOCK - REACH, to(block + 1, False))
    sent = placed.withColumn("x", F.explode(F.array_compact(F.array(to(block, True), before, after)))).select("position", *rows.columns, "x.block", "x.own")

    def near(pages: pa.Table) -> pa.Table:
        return _aligned(pages, last)

    def with_far(pages: pa.Table, answers: pa.Table) -> pa.Table:
        return _aligned(pages, last, answers)

    aligned = scratch.written(sent.groupBy("block").applyInArrow(near, _ALIGNED), "shared-lines", keep=True)
    gone, asks = aligned.where("k_id IS NOT NULL").select("k_id", "k_tag", "gone"), aligned.where("k_id IS NULL").drop("k_id", "k_tag", "gone")
    if asks.isEmpty():
        return gone
    found = _far(asks, sent.where("own"), last, scratch)
    there = sent.join(asks.select("block").distinct(), "block", "left_semi").select(*sent.columns).groupBy("block")
    far = scratch.written(there.cogroup(found.groupBy("block")).applyInArrow(with_far, _ALIGNED), "shared-lines", keep=True)
    return gone.unionByName(far.select("k_id", "k_tag", "gone"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) of (page_id, url, html, gone)."""
    for batch in batches:
        texts = [main_text(lines_of(page.as_py() or ""), set(gone or ())) for page, gone in zip(batch.column("html"), batch.column("gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.select(["page_id", "url"]).columns, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _losing(batches: Iterator[pa.RecordBatch], bits: np.ndarray, losing: bool) -> Iterator[pa.RecordBatch]:
    """The pages whose tags may be among those that lose lines, or the others."""
    for batch in batches:
        maybe = has_bit(bits, batch.column("k_tag").to_numpy().view(np.uint64))
        yield batch.filter(pa.array(maybe == losing))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is that of the article's blocks in page order, joined by two line ends: without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, markup and reader comments. Each page is aligned with its partner, the nearest page by path of the same host,
    however far, copies aside; the lines that both have go, outside of articles. Of the rest, where landmarks tell the article (half of all text that
    is left and isn't chrome), it is what they say. Only pages that lose lines in this way are joined with their fate and so shuffled.

    A null or empty page has the empty text. Pages without a host, and those whose host has but copies of them, have no partner and lose
    only what landmarks tell. Rows that repeat get rows of their own and one fate; an empty table gives no rows; other columns are
    ignored. Ids may be null or repeat. A page is parsed in one task, in memory proportional to it.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    key = [row_id("page_id").alias("k_id"), F.xxhash64(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("k_tag")]
    with Scratch(spark) as scratch:
        pages = rows.select("page_id", "url", "html", *key)
        gone = shared_lines(pages.select("k_id", "k_tag", "url", "html"), scratch)
        bits = membership_bits(gone, "k_tag")  # 16 MB at most
        part = lambda losing: map_arrow(pages, lambda b: _losing(b, bits, losing), "page_id long, url string, html string, k_id long, k_tag long")
        whole = part(False).select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("gone"))
        cut = part(True).join(gone, ["k_id", "k_tag"], "left").select("page_id", "url", "html", "gone")
        texts = lambda of: map_arrow(of, _texts, "page_id long, url string, text string")
        out = texts(whole).unionByName(texts(cut))
        return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
