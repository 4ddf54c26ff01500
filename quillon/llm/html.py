"""Main text of web pages by nearest-URL page differencing.

Pages of one site repeat their frame. Every page is cut into text lines (one per block element).
Within each host, pages are ordered by URL path, and a page is paired with the neighbour in that
order that has the longer common path prefix (of a page that is there under several addresses one
stands for the path, so no page is paired with itself). The lines of the two are aligned by longest
common subsequence, and the shared ones are deleted. A neighbour that shares nearly all lines is a
copy rather than a sibling, and deletes nothing.

Explicit markup says where main text can be: text in navigation, headers, footers, asides, forms,
scripts, styles and in elements whose class, id or role is the name of such a part (all words of the
name count, so "share-box" is one and "social-science" is not) is never main text. In an ``article``
differencing decides about containers: an element whose lines the sibling has, all of them, is a part
of the frame and goes; one with a line of its own keeps what it shares, and so does the article
itself, so that a passage that two articles share belongs to both. A paragraph, heading or list item
whose class is a single word of VAGUE ("card share") counts as a container there. Without an
``article`` differencing decides about each line of ``main``, or without that of all. Only where two
pages share VERSIONS or more of the lines in question (in an article: of those that are in no shared
container) are they versions of one text, which both keep.

Hosts are never gathered in one task: the order by (host, path) is a range sort, neighbours meet by
their global row numbers. Only 64-bit line digests travel; page sources are joined with the lines to
delete only where there are such lines, by broadcast if those are few (counted first), else shuffled.

Defined results: a null or empty page gives an empty text; pages without a URL have no neighbours;
repeated rows give repeated results; tables may be empty; extra columns, of any name, are ignored;
pages have no length limit and are read in linear time, unclosed tags and quotes included.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, n_partitions, written

#: Elements whose text is never main text (fixed values).
OUT = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog head title menu".split())
#: Elements whose content is raw text up to their end tag.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style textarea title iframe noscript xmp template".split()}
TAG_STOP = re.compile("[>\"']")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of a class or id, and roles, that name a part of the frame (fixed values).
FRAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments respond reply replies disqus pagination pager search skip paywall".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words that may stand beside one of FRAME in the name of a part (fixed values).
BESIDE = frozenset(
    "area article articles bar block body bottom box btn button buttons card center col column container content count entry fixed form global group head heading header holder icon icons "
    "inline inner item items js layer left link links list main message mobile more note notes page panel policy post posts primary reader readers right row secondary section site slot small sticky "
    "text thread title toggle top unit user users visitor visitors wrap wrapper".split()
)
#: Words of FRAME that name kinds of text as well: alone on a paragraph of an article they leave the decision to differencing (fixed values).
VAGUE = frozenset("alert banner comment notice notices promotion related reply search share sharing skip social".split())
#: Elements that hold a line of text rather than other elements (fixed values).
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPLIT = re.compile(r"[^a-z]+")
URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")
#: At this share of common lines a neighbour is a copy of the page.
COPY = 0.9
#: At this share of common main-text lines two pages are versions of one text.
VERSIONS = 0.5
#: Most rows of drop lists that are broadcast.
BROADCAST_ROWS = 20_000

ARTICLE, MAIN, PLAIN, FRAMED = 3, 2, 1, 0


def _joined(word: str) -> bool:
    """Whether the word is one of FRAME and one of BESIDE without a space ("adbox")."""
    return any(word[:i] in FRAME and word[i:] in BESIDE for i in range(2, len(word) - 2))


@lru_cache(1 << 16)
def _names_frame(token: str) -> bool:
    """Whether a class or id is the name of a part of the frame."""
    words = [w for w in SPLIT.split(token) if w]
    parts = [w in FRAME or w not in BESIDE and _joined(w) for w in words]
    return any(parts) and all(p or w in BESIDE for p, w in zip(parts, words, strict=True))


def tokens(source: str) -> Iterator[tuple[str, bool, str]]:
    """Text ("", False, text) and tags (name, whether closing, attributes) in order, in linear time.

    A quote that is never closed is an ordinary character. From the first tag on whose end is nowhere
    outside of quotes, tags end at the next ">"; without one the rest is text.
    """
    at, n, quotes, closed = 0, len(source), True, {'"': True, "'": True}
    text = 0
    while (lt := source.find("<", at)) >= 0:
        at = lt + 1
        nxt = source[at : at + 1]
        if source.startswith("!--", at):
            end = source.find("-->", at + 3)
            piece, after = None, n if end < 0 else end + 3
        elif source.startswith("![CDATA[", at) and (end := source.find("]]>", at)) >= 0:
            piece, after = ("", False, html_lib.escape(source[at + 8 : end], quote=False)), end + 3
        elif nxt in ("!", "?"):
            end = source.find(">", at)
            if end < 0:
                break
            piece, after = None, end + 1
        elif m := NAME.match(source, at + (nxt == "/")):
            end = m.end()
            while quotes:
                stop = TAG_STOP.search(source, end)
                if not stop:
                    quotes = False
                elif stop[0] == ">":
                    end = stop.start()
                    break
                else:
                    q = stop[0]
                    to = source.find(q, stop.end()) if closed[q] else -1
                    closed[q] = to >= 0
                    end = stop.end() if to < 0 else to + 1
            else:
                end = source.find(">", m.end())
                if end < 0:
                    break
            name, closing, raw = m[0].lower(), nxt == "/", source[m.end() : end]
            after = end + 1
            piece = (name, closing, raw)
            if name in RAW and not closing:
                shut = RAW[name].search(source, after)
                piece, after = None, shut.end() if shut else n
        else:
            continue
        if lt > text:
            yield "", False, source[text:lt]
        if piece:
            yield piece
        at = text = after
    if text < n:
        yield "", False, source[text:]


def _framed(name: str, raw: str, depth: int, vague: bool = True) -> bool:
    """Whether the element starts a part of the frame; depth: 1 or more inside an article or main; vague: whether words of VAGUE alone say so."""
    if name in OUT or (name == "header" and not depth):
        return True
    if not raw or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if any(_names_frame(token) and (vague or token not in VAGUE) for token in value.split()):
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(source: str) -> list[tuple[str, int]]:
    """The page's text lines in order, each with its standing: ARTICLE, MAIN, PLAIN or FRAMED."""
    return outline(source)[0]


def outline(source: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """The lines with their standing, and from which to before which line the containers inside of articles go, empty ones left out."""
    out: list[tuple[str, int]] = []
    inner: dict[tuple[int, int], None] = {}
    stack: list[tuple[str, int, int, int]] = []  # name, standing outside, depth of articles there, first line of a container or -1
    open_: Counter[str] = Counter()
    held: list[str] = []
    standing, depth = PLAIN, 0

    def flush() -> None:
        line = " ".join(html_lib.unescape("".join(held)).split())
        held.clear()
        if line:
            out.append((line, standing))

    def pop() -> tuple[int, int]:
        name, outside, deep, start = stack.pop()
        open_[name] -= 1
        if 0 <= start < len(out):
            inner[start, len(out)] = None
        return outside, deep

    def push(name: str, container: bool = False) -> None:
        stack.append((name, standing, depth, len(out) if container else -1))
        open_[name] += 1

    for name, closing, raw in tokens(source):
        if not name:
            held.append(raw)
        elif name in INLINE:
            if name == "br":
                held.append(" ")
            elif not closing and raw and standing != FRAMED and _framed(name, raw, depth):
                flush()
                push(name)
                standing = FRAMED
            elif closing and stack and stack[-1][0] == name:
                flush()
                standing, depth = pop()
        else:
            flush()
            if name in VOID:
                continue
            if closing:
                while open_[name]:  # what is left open inside ends with it
                    found = stack[-1][0] == name
                    standing, depth = pop()
                    if found:
                        break
                continue
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
                standing, depth = pop()  # its end tag may be left out
            if raw.rstrip().endswith("/") and name not in ("p", "div"):
                continue
            leaf = name in LEAVES and standing == ARTICLE
            framed = standing != FRAMED and _framed(name, raw, depth, not leaf)
            push(name, standing == ARTICLE and not framed and name != "main" and (not leaf or bool(raw) and _framed(name, raw, depth)))
            if framed:
                standing = FRAMED
            elif name in ("article", "main") and standing != FRAMED:
                depth += 1
                standing = ARTICLE if name == "article" else max(standing, MAIN)
    flush()
    while stack:
        pop()
    return out, list(inner)


def own_standing(lines: list[tuple[str, int]]) -> int:
    """The best standing that any line has: lines of that standing can be main text."""
    return max((s for _, s in lines), default=FRAMED)


def address(url: str | None) -> tuple[str | None, str | None]:
    """Host and path, without query and fragment; nulls if there is no host."""
    m = URL.match(url or "")
    if not m or not m[1]:
        return None, None
    return m[1].lower(), re.sub(r"(?:\.html?|/)+$", "", m[2]) or "/"


def digest(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _rows(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Bit-parallel rows of the common subsequence table: bit j of row i is 0 where column j raises the length."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def common(a: Sequence[int], b: Sequence[int], cells: int = 1 << 26) -> list[int]:
    """Positions in a of one longest common subsequence; memory stays below about `cells` bits."""
    keep = set(b)
    left = [i for i, x in enumerate(a) if x in keep]
    keep = {a[i] for i in left}
    right = [x for x in b if x in keep]
    seq = [a[i] for i in left]
    return [left[i] for i in _common(seq, right, cells)]


def _common(a: list[int], b: list[int], cells: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > cells:  # halve a and find where b is best cut
        half = len(a) // 2
        ones = lambda v, n: np.concatenate(([0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n].astype(np.int64))))
        front = ones(_last(a[:half], b), len(b))
        back = ones(_last(a[half:][::-1], b[::-1]), len(b))[::-1]
        cut = int(np.argmax(front + back))
        return _common(a[:half], b[:cut], cells) + [half + i for i in _common(a[half:], b[cut:], cells)]
    rows = _rows(a, b)
    out, j = [], len(b) - 1
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):
        if j < 0:
            break
        raised = ~rows[i] & ((1 << (j + 1)) - 1) & full
        before = ~(rows[i - 1] if i else full) & ((1 << (j + 1)) - 1) & full
        if raised.bit_count() > before.bit_count():  # row i adds one match at or before column j
            while j >= 0 and b[j] != a[i]:
                j -= 1
            # the match is the last place of a[i] from which the rest keeps its length
            out.append(i)
            j -= 1
        # else row i is not needed
    return out[::-1]


def _last(a: list[int], b: list[int]) -> int:
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def prefix(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def deleted(lines: Sequence[int], loose: Sequence[int], other: Sequence[int]) -> list[int]:
    """Those of the loose positions whose lines a sibling shares."""
    shared = common(lines, other)
    own = set(shared) & set(loose)
    if len(shared) >= COPY * max(len(lines), len(other)) or len(own) >= VERSIONS * len(loose):
        return []
    return sorted(own)


def shared_parts(lines: Sequence[int], article: Sequence[int], inner: Sequence[int], other: Sequence[int]) -> list[int]:
    """Those of the article's positions that are in containers (from, to, from, to ...) whose lines a sibling shares, all of them."""
    shared = common(lines, other) if inner else []
    if not shared or len(shared) >= COPY * max(len(lines), len(other)):
        return []
    text, both = np.zeros((2, len(lines) + 1), np.int64)
    text[np.asarray(article) + 1] = 1
    both[np.asarray(shared) + 1] = 1
    texts_, boths = np.cumsum(text), np.cumsum(both & text)
    start, end = np.asarray(inner).reshape(-1, 2).T
    whole = texts_[end] - texts_[start] == boths[end] - boths[start]
    depth = np.zeros(len(lines) + 1, np.int64)
    np.add.at(depth, start[whole], 1)
    np.add.at(depth, end[whole], -1)
    gone = np.cumsum(depth)[:-1] > 0
    at = np.asarray(article)
    rest = at[~gone[at]]
    if both[rest + 1].sum() >= VERSIONS * len(rest):
        return []
    return at[gone[at]].tolist()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, hashes, loose, inner = [], [], [], [], []
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host, path = address(url)
            lines, parts = outline(source or "")
            hosts.append(host)
            paths.append(path)
            hashes.append([digest(x) for x, _ in lines])
            own = own_standing(lines)
            parts = parts if own == ARTICLE else []
            loose.append([i for i, (_, s) in enumerate(lines) if s == own and (own in (PLAIN, MAIN) or parts)])
            inner.append([i for part in parts for i in part])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(loose, pa.list_(pa.int32())), pa.array(inner, pa.list_(pa.int32()))], ["key", "host", "path", "lines", "loose", "inner"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), at], [*batch.schema.names, "part", "at"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("path", "lines", "loose", "inner", "path_before", "lines_before", "path_after", "lines_after")}
        found = []
        for path, lines, loose, inner, pb, lb, pn, ln in zip(*cols.values(), strict=True):
            nearest = (lb if prefix(path, pb) >= prefix(path, pn) else ln) or []
            found.append(shared_parts(lines, loose, inner, nearest) if inner else deleted(lines, loose, nearest))
        keep = [i for i, x in enumerate(found) if x]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.list_(pa.int32()))], ["key", "drop"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            lines, gone = blocks(source or ""), set(drop or ())
            own = own_standing(lines)
            out.append("\n".join(x for i, (x, s) in enumerate(lines) if s == own != FRAMED and i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def siblings(parsed: DataFrame) -> DataFrame:
    """(host, path) with the path and lines of the neighbours before and after it within the host."""
    spark = parsed.sparkSession
    one = parsed.where("host is not null").groupBy("host", "path").agg(F.min(F.struct("key", "lines")).alias("m")).select("host", "path", F.col("m.lines").alias("lines"))
    ranged = one.repartitionByRange(n_partitions(spark), "host", "path").sortWithinPartitions("host", "path")
    numbered = written(map_arrow(ranged, _numbered, "host string, path string, lines array<bigint>, part int, at bigint"), "pages")
    base, n = {}, 0
    for part, size in sorted(map(tuple, numbered.groupBy("part").count().collect())):  # one number per partition
        base[part] = n
        n += size
    if not base:
        return numbered.selectExpr("host", "path", "path path_before", "lines lines_before", "path path_after", "lines lines_after")
    bases = spark.createDataFrame(sorted(base.items()), "part int, base bigint")
    rows = numbered.join(F.broadcast(bases), "part").withColumn("row", F.col("base") + F.col("at")).select("row", "host", "path", "lines")
    side = lambda step, name: rows.select((F.col("row") + step).alias("row"), F.col("host").alias(f"host_{name}"), F.col("path").alias(f"path_{name}"), F.col("lines").alias(f"lines_{name}"))
    met = rows.select("row", "host", "path")
    for step, name in ((1, "before"), (-1, "after")):
        met = met.join(side(step, name), "row", "left")
        same = F.col("host") == F.col(f"host_{name}")
        met = met.withColumns({f"{c}_{name}": F.when(same, F.col(f"{c}_{name}")) for c in ("path", "lines")}).drop(f"host_{name}")
    return met.drop("row")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    src = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    id_type = src.schema["page_id"].dataType.simpleString()
    parsed = written(map_arrow(src, _parse, "key bigint, host string, path string, lines array<bigint>, loose array<int>, inner array<int>"), "lines")
    met = parsed.where("host is not null").join(siblings(parsed), ["host", "path"])
    drops = written(map_arrow(met, _differ, "key bigint, drop array<int>").dropDuplicates(["key"]), "drops")
    few = drops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = src.join(F.broadcast(drops) if few else drops, "key", "left").select("page_id", "url", "html", "drop")
    return map_arrow(out, _extract, f"page_id {id_type}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
