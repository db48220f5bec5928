"""Main text of pages by union-free wrapper inference.

A page is a stream of block tags and text runs (inline tags only join text). Streams of one host are aligned one
after the other into a wrapper: a regular expression without unions, whose parts are tags, text slots (text that
differs), constants (text that doesn't), optional groups (a part that one side lacks) and repeated groups (parts
of the same shape in a row, of up to ``PERIOD`` members). Wrappers carry counts, and two wrappers align like two
pages, so the pages of a hot host are dealt to leaves by a hash of their texts and the leaves' wrappers are aligned in a
tree. Leaves and the order in them depend on the pages alone, never on partitions. Pages of one host with equal texts
outside of menus and the like are copies, of which one is taken.

From a wrapper comes a rule: the part that holds most of the slots' text, outside of menus, notices and the like, is the
main text; an article is never parted, and headings and paragraphs that stand right beside the way to the main part
belong to it. What is left out inside are texts that are constant over the host's pages, menus (lists and lines of short
links and nothing else), and blocks named as notices and the like. The rule is applied to every page as a whole; a page
that lacks the main part is its own wrapper.

* Null html has no text; a url without a host belongs to the host "". Repeated rows give repeated results.
* Blocks are joined by one space; white space in a block becomes one space; character references are decoded.
* Very long pages are parsed as a whole; blocks nested deeper than ``DEPTH`` count as that level's. An empty table gives
  no rows. Other columns of pages aren't looked at.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize, small_batches

#: Tags that don't part text, tags without content, tags whose content is no text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = set("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = set("script style noscript template iframe title textarea svg math object canvas select".split())
#: Tags and parts of class names or ids of what isn't main text.
ASIDE_TAGS = set("nav header footer aside form menu dialog button fieldset head".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu header masthead footer sidebar sidenav aside cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs widget newsletter subscribe subscription signup login search toolbar pagination pager".split()
)
#: Tags whose names never make them a menu or notice.
HOLDERS = set("html body main article".split())
#: Of these names, those that make a heading, paragraph or list item a notice too.
LEAF_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription share sharing breadcrumb breadcrumbs pagination pager".split())
#: Tags that hold a block of text rather than the text of a page.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption # ()".split())
#: Blocks that belong to the main part when they stand beside the way to it.
BESIDE = set("p h1 h2 h3 blockquote pre figure".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
HEADS = set("h1 h2 h3 h4 h5 h6".split())
PERIOD = 3
DEPTH = 120
#: Links of fewer words on average, and nothing beside them, are a menu.
MENU_WORDS = 4
#: Children of two parts that are aligned by the longest common run of shapes; longer lists go by the next equal shape.
EXACT = 1 << 12
#: Distinct pages of a leaf, about, and the share of all pages that makes a host hot.
LEAF, HOT_SHARE, LEVEL = 1000, 1 << 16, 6
#: A text is constant once so many pages agree on it, and one in SHARE pages of the host that have distinct texts.
AGREE, SHARE = 3, 2
#: Rules up to so many bytes together are broadcast; beyond, pages are joined with them by host.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-zA-Z]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")

# A node is [signature, children, text, link characters, links]; text runs have signature "#".


def parse(page: str) -> list:
    """The tree of block tags and text runs of a page."""
    root = ["", [], "", 0, 0]
    stack, names = [root], [""]
    held: list[str] = []
    link = links = anchors = 0

    def flush() -> None:
        nonlocal links, anchors
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            stack[-1][1].append(["#", [], text, min(links, len(text)), anchors])
        links, anchors = 0, link

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.append(text)
            links += len(text) if link else 0
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                if (stop := re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)) is None:
                    break
                at = stop.end()
            continue
        if name in INLINE:
            if name == "a":
                link = int(not closing)
                anchors += link
            continue
        if name in VOID:
            held.append(" ")
            continue
        flush()
        if closing:
            if name in names[1:]:
                while names[-1] != name:
                    stack.pop()
                    names.pop()
                stack.pop()
                names.pop()
            continue
        if "p" in names[-1:] or names[-1] in HEADS and name in HEADS:
            stack.pop()
            names.pop()
        while names[-1] in CLOSES.get(name, ()):
            stack.pop()
            names.pop()
        if len(stack) < DEPTH:
            kinds = sorted({p.lower() for found in _NAMED.findall(attributes) for p in _PART.findall(" ".join(found))})
            node = [".".join([name, *kinds]), [], "", 0, 0]
            stack[-1][1].append(node)
        else:
            node = stack[-1]  # what is deeper belongs to this level; its end tag pops its own entry
        stack.append(node)
        names.append(name)
    flush()
    return root


def aside(signature: str) -> bool:
    name, *kinds = signature.split(".")
    return name in ASIDE_TAGS or name not in HOLDERS and any(k in (LEAF_NAMES if name in LEAVES else ASIDE_NAMES) for k in kinds)


def _linked(node: list) -> bool:
    return 2 * node[3] > len(node[2])


def menus(tree: list) -> set[int]:
    """The ids of nodes that are lists, or lines, of short links and nothing else."""
    found: set[int] = set()

    def walk(node: list, tag: str) -> tuple[int, int, int, int]:
        """Text runs below, those that are links, their words and their number of links."""
        if node[0] == "#":
            words = len(node[2].split())
            if not _linked(node):
                return 1, 0, 0, 0
            if tag not in LEAVES and node[4] > 1 and words < MENU_WORDS * node[4]:
                found.add(id(node))
            return 1, 1, words, max(node[4], 1)
        name = node[0].split(".")[0]
        runs = [walk(c, name) for c in node[1]]
        total = tuple(map(sum, zip(*runs))) if runs else (0, 0, 0, 0)
        if name in ("ul", "ol", "dl", "div", "section") and total[1] == total[0] and total[3] > 1 and total[2] < MENU_WORDS * total[3]:
            found.add(id(node))
        return total

    walk(tree, "")
    return found


def unnamed(tree: list) -> list:
    """The tree without the names of blocks that hold a heading or article and most of the page's text."""

    def sized(node: list) -> tuple[int, bool]:
        name, below = node[0].split(".")[0], [sized(c) for c in node[1]]
        found = (0 if name in ASIDE_TAGS else len(node[2]) + sum(n for n, _ in below), name in HOLDERS or name == "h1" or any(h for _, h in below))
        sizes[id(node)] = found
        return found

    def made(node: list) -> list:
        n, holds = sizes[id(node)]
        return [node[0].split(".")[0] if holds and 2 * n > total else node[0], [made(c) for c in node[1]], *node[2:]]

    sizes: dict[int, tuple[int, bool]] = {}
    total = sized(tree)[0]
    return made(tree)


# A wrapper part is [signature, pages, optional, repeated, characters, link characters, constant, parts]. constant is
# a hash of the text while all pages agree, None once they differ. Groups of several members have signature "()".


def mark(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shape(node: list) -> list:
    text = node[2]
    return [node[0], 1, 0, 0, len(text), node[3], mark(text) if node[0] == "#" else None, fold([shape(c) for c in node[1]])]


def _key(part: list) -> tuple:
    return (part[0], *(_key(p) for p in part[7])) if part[0] == "()" else (part[0],)


def fold(parts: list) -> list:
    """Runs of one shape, or of up to PERIOD shapes in turn, become a repeated group."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(parts):
            keys = [_key(p) for p in parts[i : i + period]]
            n = 1
            while len(keys) == period and [_key(p) for p in parts[i + n * period : i + (n + 1) * period]] == keys:
                n += 1
            if n > 1 and (period == 1 or len(set(keys)) > 1):
                group = parts[i] if period == 1 else ["()", 1, 0, 0, 0, 0, None, parts[i : i + period]]
                for k in range(1, n):
                    at = i + k * period
                    group = align(group, parts[at] if period == 1 else ["()", 1, 0, 0, 0, 0, None, parts[at : at + period]], True)
                group[3] = 1
                out.append(group)
                i += n * period
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def align(a: list, b: list, same_page: bool = False) -> list:
    """One part that covers two of equal signature."""
    constant = a[6] if a[6] == b[6] else None
    return [a[0], a[1] if same_page else a[1] + b[1], a[2] | b[2], a[3] | b[3], a[4] + b[4], a[5] + b[5], constant, align_lists(a[7], b[7], same_page)]


def _pairs(a: list[tuple], b: list[tuple]) -> dict[int, int]:
    """Places of b with the places of a that they are aligned with: as many as can be in order."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = {i: i for i in range(low)} | {len(b) - 1 - k: len(a) - 1 - k for k in range(high)}
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not x or not y:
        return found
    if len(x) * len(y) > EXACT:
        places: dict[tuple, list[int]] = {}
        for i, p in enumerate(x):
            places.setdefault(p, []).append(i)
        at = 0
        for j, q in enumerate(y):
            own = places.get(q, [])
            k = bisect_left(own, at)
            if k < len(own):
                found[low + j], at = low + own[k], own[k] + 1
        return found
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, under = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = under[j + 1] + 1 if x[i] == y[j] else max(under[j], row[j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found[low + j] = low + i
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def align_lists(a: list, b: list, same_page: bool) -> list:
    """Both lists in order; a mismatch makes the part that the other lacks optional."""
    pairs = _pairs([_key(p) for p in a], [_key(q) for q in b])
    out, at = [], 0
    for j, q in enumerate(b):
        if (there := pairs.get(j)) is None:
            out.append([*q[:2], 1, *q[3:]])
        else:
            out += [[*p[:2], 1, *p[3:]] for p in a[at:there]]
            out.append(align(a[there], q, same_page))
            at = there + 1
    return out + [[*p[:2], 1, *p[3:]] for p in a[at:]]


def _constant(part: list, pages: int) -> bool:
    """Whether a text run is the same on a large share of the host's pages."""
    return part[6] is not None and part[1] >= AGREE and SHARE * part[1] >= pages


def _slots(part: list, pages: int) -> int:
    """Characters of a part's text slots that may be main text."""
    if aside(part[0]):
        return 0
    own = 0 if part[0] != "#" or 2 * part[5] > part[4] or _constant(part, pages) else part[4]
    return own + sum(_slots(p, pages) for p in part[7])


def rule(wrapper: list) -> dict:
    """The path of the main part; the paths of parts inside it to leave out; constants by path."""
    path: list[str] = []
    part, pages = wrapper, wrapper[1]
    while True:
        total, best, at = _slots(part, pages), None, 0
        for p in part[7]:
            if (n := _slots(p, pages)) > at:
                best, at = p, n
        # an article, or the holder of repeated parts or of blocks, is as deep as it goes
        if part[0].split(".")[0] == "article" or best is None or 2 * at < total or best[3] or best[0].split(".")[0] in LEAVES or all(p[0] == "#" for p in best[7]):
            break
        part = best
        path.append(part[0])
    constants: list[list] = []

    def walk(p: list, at: tuple[str, ...]) -> None:
        for q in p[7]:
            if q[0] == "#" and _constant(q, pages):
                constants.append(["/".join(at), q[6]])
            walk(q, at if q[0] in ("()", "#") else (*at, q[0]))

    walk(wrapper, ())
    # only where the main text may be: in the main part, and in blocks beside the way to it
    way = {"/".join(path[:n]) for n in range(len(path) + 1)}
    inside = "/".join(path)
    return {"path": path, "constants": sorted([at, c] for at, c in constants if at == inside or at.startswith(inside + "/") or not inside or at.rsplit("/", 1)[0] in way or "/" not in at)}


def extract(tree: list, found: dict) -> list[str] | None:
    """The blocks of the main part, None if the page lacks it."""
    path, blocks, seen = tuple(found["path"]), [], False
    constants = {(p, t) for p, t in found["constants"]}
    left_out = menus(tree)
    stack = [(tree, (), not path, False)]
    while stack:
        node, at, inside, beside = stack.pop()
        seen = seen or inside
        for child in reversed(node[1]):
            if child[0] == "#":
                stack.append((child, at, inside, beside))
                continue
            if (inside or beside) and (aside(child[0]) or id(child) in left_out):
                continue
            deeper = (*at, child[0])
            if inside or beside or deeper == path[: len(deeper)]:
                stack.append((child, deeper, inside or deeper == path, beside))
            elif child[0].split(".")[0] in BESIDE and not aside(child[0]) and id(child) not in left_out:
                stack.append((child, deeper, False, True))
        if node[0] == "#" and (inside or beside) and id(node) not in left_out and ("/".join(at), mark(node[2])) not in constants:
            blocks.append(node[2])
    return blocks if seen else None


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def body_print(tree: list) -> int:
    """A hash of a page's texts outside of menus, notices and links: copies of one main text agree in it."""
    texts, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node[0] == "#":
            if not _linked(node):
                texts.append(node[2])
        elif not aside(node[0]):
            stack.extend(reversed(node[1]))
    return mark("\n".join(texts))


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a first column of urls, that column's hosts put in front."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(map(host, batch.column(0).to_pylist())), pa.string()), *batch.columns], ["host", *batch.schema.names])


def hot_hosts(pages: DataFrame) -> dict[str, int]:
    """Bits that part the pages of large hosts into leaves. HOT_SHARE hosts at most: others have a smaller share of all."""
    counted = pages.select("url").groupBy("url").count().mapInArrow(_hosts, "host string, url string, count long").groupBy("host").agg(F.sum("count").alias("n"))
    counted = materialize(counted, "hosts")
    most = max(LEAF, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return {r.host: (-(-r.n // most) - 1).bit_length() for r in counted.where(F.col("n") > most).collect()}


def _printed(bits):
    """Pages (url, html) with host, leaf, print and digest; of pages of a host that agree in print, those whose digest is
    smaller than all before: the smallest of all is always among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = bits.value, {}
        for batch in batches:
            own, at = [], []
            for i, (u, p) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                key = (host(u), body_print(parse(p or "")))
                digest = mark(p or "")
                if digest < seen.get(key, 1 << 63):
                    seen[key] = digest
                    own.append((key[0], key[1] & ((1 << hot.get(key[0], 0)) - 1), key[1], digest))
                    at.append(i)
            cols = list(zip(*own)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), batch.column(1).take(pa.array(at, pa.int64()))], ["host", "leaf", "print", "digest", "html"])

    return run


def _joined(read, write, names: list[str]):
    """Rows sorted by host and leaf, further columns last: the parts that ``read`` makes of a group's rows aligned one
    after the other, and ``write`` of the result. One part is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, last = None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]], pa.int64()), pa.array([json.dumps(write(held))])], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] == last and len(row) > 4:
                    continue  # a copy
                last = row[:3]
                part = read(row[-1])
                if row[:2] == name:
                    held = align(held, part)
                    continue
                if name is not None:
                    yield made()
                name, held = row[:2], part
        if name is not None:
            yield made()

    return run


def main_text(page: str | None, found: dict | None) -> str:
    tree = parse(page or "")
    blocks = extract(tree, found) if found else None
    if not blocks:
        blocks = extract(tree, rule(shape(tree)))
    if not blocks:
        tree = unnamed(tree)
        blocks = extract(tree, rule(shape(tree)))
    return " ".join(blocks or ())


def _extractor(rules):
    """Pages (page_id, url, html) to texts, by broadcast rules, or by a column rule where rules is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            urls, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = []
            own = batch.column(3).to_pylist() if rules is None else [rules.value.get(host(u)) for u in urls]
            for page, r in zip(pages, own):
                if r is not None and r not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[r] = json.loads(r)
                texts.append(main_text(page, known.get(r)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host and rule of every host of pages(url, html)."""
    bits = hot_hosts(pages)
    sent = pages.sparkSession.sparkContext.broadcast(bits)
    distinct = pages.select("url", "html").mapInArrow(_printed(sent), "host string, leaf long, print long, digest long, html string")
    dealt = distinct.repartition("host", "leaf").sortWithinPartitions("host", "leaf", "print", "digest")
    schema, names = "host string, leaf long, wrapper string", ["host", "leaf", "wrapper"]
    parts = dealt.mapInArrow(_joined(lambda p: shape(parse(p or "")), lambda w: w, names), schema)
    deep = max(bits.values(), default=0)
    while deep > LEVEL:
        parts = parts.withColumn("low", F.shiftright("leaf", LEVEL)).repartition("host", "low").sortWithinPartitions("host", "low", "leaf")
        parts = parts.select("host", F.col("low").alias("leaf"), "wrapper").mapInArrow(_joined(json.loads, lambda w: w, names), schema)
        deep -= LEVEL
    last = parts.repartition("host").sortWithinPartitions("host", "leaf").select("host", F.lit(0).cast("long").alias("leaf"), "wrapper")
    rules = last.mapInArrow(_joined(json.loads, rule, ["host", "leaf", "rule"]), "host string, leaf long, rule string").drop("leaf")
    return materialize(rules, "wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    rules = wrappers(pages)
    rows = pages.select("page_id", "url", "html")
    schema = "page_id long, url string, text string"
    if (rules.agg(F.sum(F.octet_length("host") + F.octet_length("rule"))).first()[0] or 0) <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r.host: r.rule for r in rules.collect()})
        texts = rows.mapInArrow(_extractor(known), schema)
    else:
        named = rows.select("url", "page_id", "html").mapInArrow(_hosts, "host string, url string, page_id long, html string")
        texts = named.join(rules, "host", "left").select("page_id", "url", "html", "rule").mapInArrow(_extractor(None), schema)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
