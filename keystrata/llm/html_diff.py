"""Main text of web pages by differencing each page against its nearest URL on the same host.

Every page is read into lines, one for each block, and paired with the page of its host whose URL path is nearest (the longer
common start among its two neighbours in path order). Both pages' lines are aligned by a longest common subsequence, and the lines that
they share are deleted. Markup only has a say before that: scripts, navigation, adverts, forms and the like never count as text, and what
stands inside <article> or <main> is never deleted for being shared, as copies of an article on one site would otherwise erase each
other. All other lines are decided by the comparison, whatever share of a page they are: those that differ from the pair stay, beside an article
too. A page without an article none of whose lines differs is a copy of its pair and keeps them. Without a pair on its host a page is
its article, or all its undecided lines if it has none. Class words count outside articles; inside, only whole names of a short list do.

Nulls: null html gives an empty text; a null url, or one without "://", has no host and pairs with nothing. Rows with one url are each compared with the
same other url, of which the row of the least page_id serves. Empty tables give no rows; other columns are ignored. Work is linear in a page's and a
url's length but for the comparison (lines times lines / 64), whose memory is bounded by dividing long pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm import base
from keystrata.llm.token_counts import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
# Element names and class words of HTML pages.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav footer aside form head menu button select dialog search fieldset object audio video".split())
SCOPE = frozenset(("article", "main"))
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments"
    " commentlist complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu menubar modal nav"
    " navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies"
    " reply search share sharing sidebar sidenav skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Inside an article only these names count, as a whole class, id or role.
BAD_NAMES = frozenset(
    "ad ads advert advertisement adsense sponsored promo comments comment-list comment-form commentlist disqus_thread respond sidebar"
    " newsletter newsletter-signup cookie-notice cookie-banner popup share-buttons navigation complementary".split()
)
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
#: Start tags that end an open element of the same family.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TEXT, DROPPED, UNDECIDED = 0, 1, 2


def _boilerplate(name: str, attributes: str, scoped: bool) -> bool:
    if name in OUT or (name == "header" and not scoped):
        return True
    if not attributes or name in ("html", "body"):
        return False
    if HIDDEN.search(attributes):
        return True
    for found in ATTRIBUTE.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        if scoped or name in SCOPE:
            if not BAD_NAMES.isdisjoint(value.lower().split()):
                return True
        elif not BAD_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", value).lower())):
            return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every block of a page in order; kind is TEXT, DROPPED or UNDECIDED."""
    out: list[tuple[int, str]] = []
    if not html:
        return out
    stack: list[tuple[str, int]] = []  # open elements with the kind of text that held before each
    kind, pieces, at, end = UNDECIDED, [], 0, len(html)
    opened: Counter[str] = Counter()  # names on the stack

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((kind, text))

    def close(to: int) -> None:
        nonlocal kind
        flush()
        kind = stack[to][1]
        cut(to)

    def cut(to: int) -> None:
        opened.subtract(name for name, _ in stack[to:])
        del stack[to:]

    while at < end:
        tag = TOKEN.search(html, at)
        if tag is None:
            pieces.append(html[at:])
            break
        if tag.start() > at:
            pieces.append(html[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name == "br":
                pieces.append(" ")
            elif not opened[name]:
                if name in BLOCKS:
                    flush()
            else:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        if name in BLOCKS or stack[depth][1] != kind:
                            close(depth)
                        else:
                            cut(depth)
                        break
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else end
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr"):
                pieces.append(" " if name == "br" else "")
            continue
        if tag[3].endswith("/"):
            continue
        if name in CLOSES_P and name != "p":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
        elif name == "p" or name in ENDS:
            family = ENDS.get(name, {"p"})
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in family:
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS and stack[depth][0] not in family:
                    break
        if name in BLOCKS:
            flush()
        before = kind
        bad = kind != DROPPED and _boilerplate(name, tag[3], kind == TEXT)
        if bad or (name in SCOPE and kind == UNDECIDED):
            flush()
            kind = DROPPED if bad else TEXT
        if name in BLOCKS or kind != before or name in ("b", "i", "a", "span", "em", "strong"):
            stack.append((name, before))
            opened[name] += 1
    flush()
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """For each start of a the bit row of its comparison with b: a zero bit j says that the best length grows at b[j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    masks = {x: _mask(places, len(b)) for x, places in where.items()}
    full = row = (1 << len(b)) - 1
    for x in a:
        hits = row & masks.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
        yield row


def _mask(places: list[int], n: int) -> int:
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a with each start of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list, b: list, at: int, found: set[int], most_bits: int) -> None:
    """Adds to found the places of a, counted from `at`, on a longest common subsequence with b."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        found.add(at + low)
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        found.add(at + len(a) - 1 - high)
        high += 1
    a, b, at = a[low : len(a) - high], b[low : len(b) - high], at + low
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > most_bits:  # halves of a, each with its part of b
        half = len(a) // 2
        j = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        _common(a[:half], b[:j], at, found, most_bits)
        _common(a[half:], b[j:], at + half, found, most_bits)
        return
    rows = list(_rows(a, b))
    j = len(b)
    for n in range(len(a) - 1, -1, -1):
        before = rows[n - 1] if n else (1 << len(b)) - 1
        low = (1 << j) - 1
        if j and (~before & low).bit_count() < (~rows[n] & low).bit_count():
            found.add(at + n)
            j = (~rows[n] & low).bit_length() - 1


def shared(mine: list, other: list, most_bits: int = 1 << 27) -> set[int]:
    """Positions of `mine` on a longest common subsequence with `other`, over the lines that both have."""
    there, here = set(other), set(mine)
    a, b = [i for i, x in enumerate(mine) if x in there], [x for x in other if x in here]
    found: set[int] = set()
    _common([mine[i] for i in a], b, 0, found, most_bits)
    return {a[k] for k in found}


def hashed(lines: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines]


def decide(kinds: list[int], lines: list[str], other: list[int] | None) -> str:
    """The page's text, given the hashes of its pair's lines (None: it has none)."""
    article = TEXT in kinds
    if other is None:
        return "\n\n".join(line for kind, line in zip(kinds, lines, strict=True) if kind == (TEXT if article else UNDECIDED))
    gone = shared(hashed(lines), other)
    if not article and all(i in gone for i, kind in enumerate(kinds) if kind == UNDECIDED):
        gone = set()  # a copy
    return "\n\n".join(line for i, (kind, line) in enumerate(zip(kinds, lines, strict=True)) if kind == TEXT or (kind == UNDECIDED and i not in gone))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds and texts of each page's lines in place of its html."""
    for whole in batches:
        for part in slices(whole, "html", 8 << 20):
            pages = [blocks(h.as_py()) for h in part.column("html")]
            kinds, lines = ([[x[k] for x in page] for page in pages] for k in (0, 1))
            arrays = [part.column("page_id"), part.column("url"), pa.array(kinds, pa.list_(pa.int8())), pa.array(lines, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "kinds", "lines"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [hashed([text for _, text in blocks(h.as_py())]) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(rows, pa.list_(pa.int64()))], names=["page_id", "url", "other"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(n) for n in ("kinds", "lines", "other")]
        texts = [decide(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id long, url, html).

    One narrow pass leaves the hashes of each url's lines; pairs come from a global order of (host, path) without a task for a whole
    host: urls are dealt by ranges, and neighbours over a range's edge meet through one row for each range. Then the lines of
    every page move once, to the hashes of their pair.
    """
    spark = pages.sparkSession
    base.importable(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hashes = pages.filter("url is not null").mapInArrow(_hashes, "page_id long, url string, other array<long>")
    per_url = base.cut(hashes.groupBy("url").agg(F.min_by("other", "page_id").alias("other")))
    others = _pairs(per_url.select("url")).join(per_url.withColumnRenamed("url", "pair"), "pair").select("url", "other")
    lines = pages.mapInArrow(_parsed, "page_id long, url string, kinds array<byte>, lines array<string>")
    met = lines.filter("url is not null").join(others, "url", "left").select("page_id", "url", "kinds", "lines", "other")
    alone = lines.filter("url is null").withColumn("other", F.lit(None).cast("array<long>"))
    return met.unionByName(alone).mapInArrow(_compared, "page_id long, url string, text string, n_chars long")


def common_start(a: Column, b: Column) -> Column:
    """Code points that two strings both start with, by halving steps."""
    upto = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(31))))
    fits = lambda n, step: (n + step <= upto) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step))
    return F.aggregate(F.filter(steps, lambda step: step <= upto), F.lit(0), lambda n, step: F.when(fits(n, step), n + step).otherwise(n))


def _pairs(urls: DataFrame) -> DataFrame:
    """(url, pair) of distinct urls: the nearest other url of its host by path order; urls alone on their host are left out."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    n = base.partitions(urls.sparkSession)
    order = ["host", "path", "url"]
    dealt = base.cut(urls.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy(*order)
    row = F.struct("host", "path", "url")
    near = dealt.withColumns({"before": F.lag(row).over(here), "after": F.lead(row).over(here)})
    edges = dealt.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    line = Window.orderBy("part")  # one row for each partition
    edges = edges.select("part", F.lag("last").over(line).alias("last"), F.lead("first").over(line).alias("first"))
    near = near.join(F.broadcast(edges), "part")
    near = near.withColumns({"before": F.coalesce("before", "last"), "after": F.coalesce("after", "first")})
    sides = {side: F.when((F.col(f"{side}.host") == F.col("host")) & (F.col("host") != ""), common_start(F.col("path"), F.col(f"{side}.path"))) for side in ("before", "after")}
    near = near.withColumns({"left": sides["before"], "right": sides["after"]})
    other = F.when(F.col("right").isNull() | (F.col("left") >= F.col("right")), F.when(F.col("left").isNotNull(), F.col("before.url"))).otherwise(F.col("after.url"))
    return near.select("url", other.alias("pair")).filter("pair is not null")
