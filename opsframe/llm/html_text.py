"""Main text of web pages by differencing pages with near URLs.

A page is cut into blocks, the text lines between block tags. Menus, headers, footers, side bars, adverts, notices,
forms, comments of readers, scripts and styles are left out where tags, roles or class names say so; what an ``article``
or ``main`` element holds is the article. All pages are compared: they are ordered by URL path, each with the one before
and the one behind it on its host, by a longest common subsequence of lines, with all lines of the neighbours, also those
that markup leaves out there. ``article`` says which shared lines go. Where a host has pages that mark no article, the
lines that many of them have are its frame and go first, so that two pages with a large frame are not taken for copies.

Pages are dealt out in ranges of (host, path, url, page_id), so a host with a third of all pages is many ranges. The first
and the last page of a range go to the range before and behind it as well, so every page meets both its neighbours and
the text does not depend on the ranges. Each page is parsed once, and a second time for the frame if it marks no
article; ranges are found from the keys alone.

Null html or pages without text give an empty string. A null url is a host of its own. Pages with equal urls are
neighbours like others; repeated rows come out as often as they went in (rows of one url and page_id are one range). An
empty table gives an empty result; other columns are not looked at. Nothing is cut off, however long a page is.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opsframe.llm.common import settle, ship

ship(__name__)

# Elements whose text is never article text, elements that end a line, and those without an end tag.
LEFT_OUT = set(
    "nav footer aside form script style noscript template button select option textarea iframe svg canvas object dialog "
    "head title menu audio video math datalist fieldset label input".split()
)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
LINES = set(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "related reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words before a name that say of another element what it has or lacks, and words behind one for a part of
# what it names.
ABOUT_OTHERS = set("no not non without with has have hide show toggle open allow enable disable is".split())
HOLDERS = set(
    "area author bar block body bottom box button buttons container content form group header holder inner item items "
    "left link links list main meta panel posts right row section slot stories text thread title top unit wrap wrapper".split()
)

LEFT, OPEN, ARTICLE, LINK = 0, 1, 2, 4  # states of lines

# A quote opens a value only behind an equals sign, and only if it is closed; else a tag ends at its first bracket.
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)",
    re.S,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[-_]+")
_SPACES = re.compile(r"[\s\x00]+")


def _names_frame(parts: list[str]) -> bool:
    """Whether a class names something that is no article: each part does, or the last one (``post-comments``, but not
    ``no-sidebar``), or the first one with a word for a part of it (``comment-list``, but not ``ad-free``)."""
    if NAMES.issuperset(parts):
        return True
    if ABOUT_OTHERS.intersection(parts):
        return False
    return parts[-1] in NAMES or parts[0] in NAMES and parts[-1] in HOLDERS


def _hinted(tag: str, attributes: str) -> bool:
    """Whether a class, the head of an id, or a role says that an element is no article text."""
    if tag in ("html", "body", "main"):
        return False
    for name, value in _NAME.findall(attributes):
        own = value.strip("\"'").lower().split()
        if name.lower() == "role":
            if ROLES.intersection(own):
                return True
        elif name.lower() == "id":
            if any(_PARTS.split(x)[0] in NAMES for x in own):
                return True
        elif any(_names_frame(_PARTS.split(x)) for x in own):
            return True
    return False


def _protects(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I))


def marked(page: str) -> list[tuple[int, str]]:
    """Lines of a page in order: (LEFT, OPEN or ARTICLE, with LINK if all of it is in links; text)."""
    found: list[tuple[bool, bool, int, bool, str]] = []
    line: list[str] = []
    outside = False  # whether the line has text outside of links
    in_link = False
    # Open elements: tag, left out, in the article, number of the nearest element around whose name says that it is none.
    stack: list[tuple[str, bool, bool, int]] = []
    is_open: Counter[str] = Counter()
    seen = out = article = False
    hint = 0  # 0 stands for no such element
    around = [0]  # of each such element the next one around it

    def end_line():
        nonlocal outside
        if line:
            text = _SPACES.sub(" ", entities.unescape("".join(line))).strip()
            if text:
                found.append((out, article, hint, not outside, text))
            line.clear()
        outside = False

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        line.append(piece)
        outside = outside or not in_link and not piece.isspace() and piece != ""
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if tag == "a":
            in_link = not m[1]
        if m[1]:
            if is_open[tag]:
                if tag in LINES or out or hint:
                    end_line()
                gone = ""
                while gone != tag:
                    gone = stack.pop()[0]
                    is_open[gone] -= 1
                out, article, hint = stack[-1][1:] if stack else (False, False, 0)
            elif tag in LINES:
                end_line()
            continue
        if tag in LINES:
            end_line()
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in EMPTY:
            continue
        here_out = out or tag in LEFT_OUT or tag == "header" and not article
        here_article, here_hint = article, hint
        if (tag != "article" or seen) and _hinted(tag, attributes):  # behind an article, others may be comments
            around.append(hint)
            here_hint = len(around) - 1
        elif _protects(tag, attributes):
            # The first article counts even where something before it was not closed.
            here_out, here_article, here_hint = out and seen, True, hint if seen else 0
            seen = True
        if (here_out, here_article, here_hint) != (out, article, hint):
            end_line()
        stack.append((tag, here_out, here_article, here_hint))
        is_open[tag] += 1
        out, article, hint = here_out, here_article, here_hint
    end_line()
    # Names don't leave out an element that holds most of the article's text, or of the page's where there is no article.
    some = any(x[1] and not x[0] for x in found)
    held, total = [0] * len(around), 0
    for left_out, in_article, k, _, text in found:
        if not left_out and in_article >= some:
            total += len(text)
            held[k] += len(text)
    for k in range(len(around) - 1, 0, -1):
        held[around[k]] += held[k]
    no_text = [False] * len(around)
    for k in range(1, len(around)):
        no_text[k] = no_text[around[k]] or 2 * held[k] <= total
    lines = []
    for left_out, in_article, k, link, text in found:
        state = LEFT if left_out or no_text[k] else ARTICLE if in_article else OPEN
        lines.append((state + LINK * link, text))
    return lines


def blocks(page: str) -> list[tuple[bool, str]]:
    """Lines of a page in order, without what is left out: (whether they are in the marked article, text)."""
    return [(state & 3 == ARTICLE, text) for state, text in marked(page) if state & 3 != LEFT]


DIRECT = 2_048  # lines whose comparisons are kept at once


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    common = set(a) & set(b)
    own = [k for k, x in enumerate(a) if x in common]
    other = [x for x in b if x in common]
    found: set[int] = set()
    todo = [(own, other)]
    while todo:
        own, other = todo.pop()
        if len(own) <= DIRECT:
            found.update(own[k] for k in _subsequence([a[k] for k in own], other))
            continue
        # The halves of ``own`` each with their part of ``other``, so that memory grows with the lines only.
        half = len(own) // 2
        ahead = _lengths([a[k] for k in own[:half]], other)
        behind = _lengths([a[k] for k in own[half:]][::-1], other[::-1])
        cut = int(np.argmax(ahead + behind[::-1]))
        todo += [(own[:half], other[:cut]), (own[half:], other[cut:])]
    return found


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each line of ``a`` the comparison with all of ``b`` as the bits of one number: of the first j bits, as many
    are 0 as a common subsequence with the first j lines can have."""
    where: dict[str, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """How long a common subsequence of ``a`` with the first 0, 1, 2, ... lines of ``b`` can be."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits == 0))


def _subsequence(a: list[str], b: list[str]) -> set[int]:
    rows = list(_rows(a, b))
    found, i, j = set(), len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.add(i)
            i -= 1
            j -= 1
    return found


def article(page: list[tuple[int, str]], neighbours: list[list[tuple[int, str]]], frame: frozenset[int] = frozenset()) -> list[str]:
    """Article lines of a page as ``marked`` gives them, by differencing with its neighbours.

    What a neighbour has in a marked article is no frame. On a page without one, the lines of the host's ``frame`` go,
    then those of the others that a neighbour shares; a neighbour that doesn't mark its article either may be a copy, and
    nothing goes because of it if it shares more than half of what the frame has left. Lines of a marked article go only
    where all neighbours have them outside of theirs, as more than links, and not if that is more than half of it: else
    they are shown there as a teaser or quoted. What the page has in its own frame too is said by the article once more.
    """
    sure = any(state & 3 == ARTICLE for state, _ in page)
    lines = [x for state, x in page if state & 3 == (ARTICLE if sure else OPEN)]
    if frame and not sure:
        lines = [x for x in lines if line_hash(x) not in frame]
    framed = {x for state, x in page if state & 3 != ARTICLE} if sure else set()
    found = []
    for other in neighbours:
        other_sure = any(state & 3 == ARTICLE for state, _ in other)
        if sure:
            theirs = [x for state, x in other if (state == LEFT or state == OPEN and other_sure) and x not in framed]
        else:
            theirs = [x for state, x in other if state & 3 != ARTICLE]
        same = shared_lines(lines, theirs)
        may_be_copy = sure or not other_sure
        if may_be_copy and 2 * sum(len(lines[k]) for k in same) > sum(map(len, lines)):
            same = set()
        found.append(same)
    gone = (set.intersection if sure else set.union)(*found) if found else set()
    return [x for k, x in enumerate(lines) if k not in gone]


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


# Of the different pages of a host that mark no article, how many at least have a line of its frame: a number, and a share.
FRAME_PAGES = 3
FRAME_SHARE = 4  # one in

_MARKED = r"(?is)<(?:article|main)[\s/>]|role\s*=\s*[\"']?main\b"
KEYS = ["host", "path", "link", "page_id"]


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with the keys of their order. Hosts begin with a blank; a null url has an empty one."""
    scheme = r"[a-zA-Z][a-zA-Z0-9+.-]*://"
    host = F.concat(F.lit(" "), F.lower(F.regexp_extract("url", f"^{scheme}([^/?#]*)", 1)))
    path = F.regexp_extract("url", f"^(?:{scheme}[^/?#]*)?([^?#]*)", 1)
    nothing = F.lit("")
    parts = {"host": F.coalesce(host, nothing), "path": F.coalesce(path, nothing), "link": F.coalesce("url", nothing)}
    return pages.select("page_id", "url", "html").withColumns(parts)


def frames(pages: DataFrame) -> DataFrame:
    """(host, line): hashes of the lines that many pages without a marked article share on a host.

    Pages with the same lines count as one, however many copies there are. A host has few such lines: no more than
    ``FRAME_SHARE`` times those of a page.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, whole, own = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = marked(page or "")
                if not any(state & 3 == ARTICLE for state, _ in found):
                    hashes = {line_hash(x) for state, x in found if state & 3 == OPEN}
                    hosts += [host] * len(hashes)
                    whole += [line_hash(",".join(map(str, sorted(hashes))))] * len(hashes)
                    own += hashes
            columns = [pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "line"])

    bare = pages.filter(~F.coalesce(F.col("html").rlike(_MARKED), F.lit(False))).select("host", "html")
    seen = settle(bare.mapInArrow(lines, "host string, page bigint, line bigint").distinct(), "lines")
    n_pages = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= FRAME_PAGES)
    return counts.join(n_pages, "host").filter(FRAME_SHARE * F.col("n") >= F.col("pages")).select("host", "line")


class Ranges:
    """Ranges of the order of all pages, by the first and the last key of each."""

    def __init__(self, ends: list[tuple[tuple, tuple]]):
        ends = sorted((self.key(*first), self.key(*last)) for first, last in ends)
        self.first, self.last = [x[0] for x in ends], [x[1] for x in ends]
        self.first_hosts, self.last_hosts = [x[0] for x in self.first], [x[0] for x in self.last]

    @staticmethod
    def key(host: str, path: str, link: str, page_id) -> tuple:
        return host, path, link, page_id is not None, page_id

    def of(self, *parts) -> list[tuple[int, bool]]:
        """(range, whether it is the page's own): at an end of its range a page goes to the next one too."""
        key = self.key(*parts)
        own = bisect_right(self.first, key) - 1
        found = [(own, True)]
        if key == self.last[own] and own + 1 < len(self.first):
            found.append((own + 1, False))
        if key == self.first[own] and own:
            found.append((own - 1, False))
        return found

    def of_host(self, host: str) -> range:
        return range(bisect_left(self.last_hosts, host), bisect_right(self.first_hosts, host))


def ranges_of(pages: DataFrame) -> Ranges:
    """As many ranges as a shuffle has partitions: what comes to the driver is two keys of each."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.select(*KEYS).repartitionByRange(n, *KEYS)
    both = [F.min(F.struct(*KEYS)).alias("first"), F.max(F.struct(*KEYS)).alias("last")]
    found = dealt.groupBy(F.spark_partition_id().alias("range")).agg(*both).collect()
    return Ranges([(tuple(row["first"]), tuple(row["last"])) for row in found])


def _parsed(ranges: Ranges, schema: pa.Schema):
    """Pages (page_id, url, host, path, link, html) as lines, for each of their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for page_id, url, host, path, link, page in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    found = marked(page or "")
                    states, lines = bytes(state for state, _ in found), [x for _, x in found]
                    content = line_hash("\n".join(lines)) if lines else 0
                    for place, own in ranges.of(host, path, link, page_id):
                        rows.append((place, host, True, path, link, page_id, content, own, url, states, lines))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _framed(ranges: Ranges, schema: pa.Schema):
    """Frame lines (host, line) for each range that has pages of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (place, host, False, "", "", None, line, False, None, b"", [])
                for host, line in zip(*(c.to_pylist() for c in batch.columns))
                for place in ranges.of_host(host)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frame lines, then pages in order, for each range and host; a page goes out when the one behind it is known."""

    def text(row, before, behind):
        near = [x[3] for x in (before, behind) if x is not None and x[0] == row[0]]
        return " ".join(article(row[3], near, row[4]))

    before = row = key = None
    frame: set[int] = set()
    done: list[tuple] = []
    like = None
    for like in batches:
        for place, host, is_page, _, _, page_id, content, own, url, states, lines in zip(*(c.to_pylist() for c in like.columns)):
            if (place, host) != key:
                key, frame = (place, host), set()
            if not is_page:
                frame.add(content)
                continue
            behind = ((place, host), page_id, url, list(zip(states, lines, strict=True)), frame, own)
            if row is not None and row[5]:
                done.append((row[1], row[2], text(row, before, behind)))
            before, row = row, behind
        yield _pages(done, like)
        done = []
    if row is not None and row[5]:
        yield _pages([(row[1], row[2], text(row, before, None))], like)


def _pages(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [like.schema.field("page_id").type, pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["page_id", "url", "text"]
    )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()
    placed = keyed(pages)
    ranges = ranges_of(placed)
    schema = (
        f"place int, host string, is_page boolean, path string, link string, page_id {kind}, content bigint, own boolean, "
        "url string, states binary, lines array<string>"
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = ["page_id", "url", "host", "path", "link", "html"]
    rows = placed.select(*columns).mapInArrow(_parsed(ranges, arrow), schema)
    rows = rows.unionByName(frames(placed).mapInArrow(_framed(ranges, arrow), schema))
    order = ["place", "host", "is_page", "path", "link", "page_id", "content"]
    dealt = rows.repartition("place").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_compare, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
