"""Main text of web pages by differencing each page with those of the nearest URLs.

Pages of a host are sorted by path; a page is compared with the page before and the page after it. Text lines (blocks) are
aligned by longest common subsequence, and lines that both pages share are deleted: menus, notices and footers stand on every
page of a site. A line inside an explicit article is kept, since articles may quote each other or be copies; and a page that
shares most of its plain text is a copy and no evidence. What is shared with nobody (a lone page, an advert of its own) is judged by its place in the document: scripts, forms,
navigation and the like are never main text, and if a page has an article only lines inside it are.
Hosts with more than ``block_pages`` pages are cut into ranges of the sorted paths, so that no task sees a whole large host; the last page of
a range also goes to the next range and the first one to the range before, so each page meets its neighbours at any host size.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.common import stored
from wardspan.llm.url_filter import host_of, path_of

#: Elements whose start and end separate blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset(("script", "style", "noscript", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
#: Never main text.
OUTSIDE = frozenset("head nav aside footer form button select template svg math object canvas audio video dialog menu map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id attributes that name something other than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices nav navbar navigation menu sidebar "
    "footer masthead comment comments disqus replies respond related recommended share sharing social breadcrumb breadcrumbs newsletter subscribe signup login popup modal "
    "overlay widget pagination pager copyright legal disclaimer skip".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
INSIDE, PLAIN, NEVER = 2, 1, 0


def _foreign(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and not NAMES.isdisjoint(_WORD.findall(value)):
            return True
        if (key == "role" and value.strip() in ROLES) or key == "hidden":
            return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) per block: inside an article, plain, or never main text. White space is one blank, references decoded."""
    page = page or ""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # (name, zone, in article)
    zone, in_article, at = PLAIN, False, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, zone))

    pos = 0
    while m := _TAG.search(page, pos):
        buffer.append(page[at : m.start()])
        pos = at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    flush()
                    del open_[i:]
                    zone, in_article = open_[-1][1:] if open_ else (PLAIN, False)
                    break
            else:
                if name in BLOCKS:
                    flush()
                elif name == "td" or name == "th":
                    buffer.append(" ")
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
                pos = at = end.end() if end else len(page)
            continue
        if name in VOID or name in ("td", "th"):
            flush() if name == "hr" else buffer.append(" " if name in ("br", "td", "th") else "")
            continue
        foreign = _foreign(name, m[3], in_article)
        if name not in BLOCKS and not foreign:
            continue  # inline markup
        flush()
        if name in BLOCKS and open_ and open_[-1][0] == "p" or open_ and open_[-1][0] == name and name in ("li", "dt", "dd", "tr", "option"):
            open_.pop()
            zone, in_article = open_[-1][1:] if open_ else (PLAIN, False)
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        in_article = in_article or name in ("article", "main")
        zone = NEVER if foreign or zone == NEVER else INSIDE if in_article else zone
        open_.append((name, zone, in_article))
    buffer.append(page[at:])
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists as index pairs, exact for any lists.

    After each line of ``a`` the bits of a number stand at the lines of ``b`` at which the subsequence found so far grows; one
    addition carries them on. Of these numbers every s-th is kept, s the root of the lines, and those in between are made again on the way
    back, which takes at each step the earliest end in ``b`` and its latest line in ``a``.
    """
    masks: dict[str, int] = defaultdict(int)
    known = set(a)
    for j, x in enumerate(b):
        if x in known:
            masks[x] |= 1 << j
    rows = [i for i, x in enumerate(a) if x in masks]
    places = defaultdict(list)
    for r, i in enumerate(rows):
        places[a[i]].append(r)

    def grown(state: int, r: int) -> int:
        # bits of ``state`` end stretches of ``b``; the lowest match of a stretch replaces the bit that ends it
        either = state | masks[a[rows[r]]]
        return either & ~(either - ((state << 1) | 1))

    step = isqrt(len(rows)) + 1
    kept, state = [], 0
    for r in range(len(rows)):
        if r % step == 0:
            kept.append(state)
        state = grown(state, r)
    out: list[tuple[int, int]] = []
    first, states = len(rows), []  # states[k]: before row first + k
    while state:
        j = state.bit_length() - 1
        r = places[b[j]][bisect_left(places[b[j]], r + 1) - 1] if out else places[b[j]][-1]
        out.append((rows[r], j))
        if r < first:
            first = r // step * step
            states = [kept[r // step]]
            for k in range(first, r):
                states.append(grown(states[-1], k))
        state = states[r - first] & ((1 << j) - 1)
        r -= 1
    return out[::-1]


@dataclass(frozen=True)
class Settings:
    """block_pages: pages of a range, on average, on hosts that have more; a host has about 1,024 ranges at most."""

    block_pages: int = 1_000


_MOST_RANGES = 1_024


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    need = INSIDE if any(z == INSIDE for _, z in lines) else PLAIN
    return "\n\n".join(t for i, (t, z) in enumerate(lines) if z >= need and i not in shared)


def _repeated(lines: list[tuple[str, int]], shared: list[int]) -> list[int]:
    """Those of the shared lines that go. If they are most of the plain text, the other page is a copy and tells nothing."""
    plain = sum(len(t) for t, z in lines if z == PLAIN)
    copy = 2 * sum(len(lines[i][0]) for i in shared if lines[i][1] == PLAIN) > plain
    return [i for i in shared if lines[i][1] == NEVER or lines[i][1] == PLAIN and not copy]


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and path: each page is compared with the one before and the one after it; visitors give no row."""
    last = None  # (host, block, page_id, url, lines, shared, own)
    done: list[tuple] = []
    size = 0

    def close(p) -> None:
        nonlocal size
        if not p[6]:
            return
        text = main_text(p[4], p[5])
        done.append((p[2], p[3], text, len(text)))
        size += len(text)

    def batch_of():
        nonlocal size
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])
        done.clear()
        size = 0
        return rows

    for batch in batches:
        for i in range(batch.num_rows):
            host, block, page_id, url, page, own = (batch.column(c)[i].as_py() for c in range(6))
            now = (host, block, page_id, url, lines_of(page), set(), own)
            if last and host and last[:2] == now[:2]:
                both = common_lines([t for t, _ in last[4]], [t for t, _ in now[4]])
                last[5].update(_repeated(last[4], [a for a, _ in both]))
                now[5].update(_repeated(now[4], [b for _, b in both]))
            if last:
                close(last)
            last = now
            if size > 4_000_000:
                yield batch_of()
    if last:
        close(last)
    if done:
        yield batch_of()


def _ranges(rows: DataFrame, s: Settings) -> DataFrame:
    """Stored (l_host, cuts, lasts) per host of more than ``block_pages`` pages: the first keys of its ranges but the first one, and the
    last key of every range (NULL: no page). Cuts are keys picked by their hash; where they lie changes no result."""
    count = rows.where("host <> ''").groupBy(F.col("host").alias("l_host")).agg(F.count("*").alias("n")).where(F.col("n") > s.block_pages)
    large = stored(count, "large-hosts")
    few = (large.agg(F.sum("n")).first()[0] or 0) <= 100_000 * s.block_pages
    keys = rows.select("host", "key").join(F.broadcast(large) if few else large, F.col("host") == F.col("l_host")).select("l_host", "key", "n")
    step = F.greatest(F.lit(s.block_pages), F.ceil(F.col("n") / _MOST_RANGES))
    picked = keys.where(F.pmod(F.xxhash64("key"), step) == 0)
    cuts = stored(picked.groupBy("l_host").agg(F.array_sort(F.collect_set("key")).alias("cuts")), "cuts")
    held = keys.select("l_host", "key").join(F.broadcast(cuts) if few else cuts, "l_host")
    ends = held.groupBy("l_host", _range_of(F.col("key")).alias("r")).agg(F.max("key").alias("last"))
    ends = ends.groupBy("l_host").agg(F.map_from_entries(F.collect_list(F.struct("r", "last"))).alias("ends")).withColumnRenamed("l_host", "e_host")
    lasts = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda r: F.try_element_at("ends", r))
    return stored(cuts.join(ends, F.col("l_host") == F.col("e_host")).select("l_host", "cuts", lasts.alias("lasts")), "ranges")


def _range_of(key: Column) -> Column:
    return F.size(F.filter("cuts", lambda c: c <= key))


def extracted(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    NULL and empty html give an empty text. Pages without a host (NULL url) are compared with none. Repeated rows are
    compared with each other like any two pages: they are copies, so nothing plain goes. Extra columns do not matter; an
    empty table gives an empty result.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("key", F.struct("path", "url", "page_id", F.xxhash64("html").alias("h")))
    large = _ranges(rows, s)
    # about one key per block_pages pages; broadcast only while that is few
    few = (large.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= 100_000
    joined = rows.join(F.broadcast(large) if few else large, rows["host"] == large["l_host"], "left")
    alone = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 20)).cast("int")
    block = F.when(F.col("host") == "", alone).when(F.col("cuts").isNull(), 0).otherwise(_range_of(F.col("key")))
    joined = joined.withColumn("block", block)
    # (block, own): a page's own range, and the ranges that it visits as the page before or after
    visit = F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own"))
    back = F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("own"))
    to_next = (F.col("block") < F.size("cuts")) & F.get("lasts", F.col("block")).eqNullSafe(F.col("key"))
    to_last = (F.col("block") > 0) & F.get("cuts", F.col("block") - 1).eqNullSafe(F.col("key"))
    none = F.array().cast("array<struct<block:int,own:boolean>>")
    seats = F.concat(F.array(F.struct("block", F.lit(True).alias("own"))), F.when(to_next, F.array(visit)).otherwise(none), F.when(to_last, F.array(back)).otherwise(none))
    seat = F.when(F.col("cuts").isNull(), F.array(F.struct("block", F.lit(True).alias("own")))).otherwise(seats)
    placed = joined.select("host", F.inline(seat).alias("block", "own"), "key", "html")
    placed = placed.repartition("host", "block").sortWithinPartitions("host", "block", "key")
    return placed.select("host", "block", "key.page_id", "key.url", "html", "own").mapInArrow(_differenced, "page_id long, url string, text string, n_chars long")
