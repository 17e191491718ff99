"""Main-text extraction by equivalence classes of tokens across the pages of a host.

A token is an element with its path and class, or a block of text in such an element. Its occurrence vector lists how often it
occurs in each different page of the host; the vector is kept as a sum of hashes of (page, count), which adds up page by page, so
a host with a third of all pages is aggregated like any other. Tokens of one host with equal vectors form a class. A class is valid
if it holds an element and occurs in at least ``SUPPORT`` of the host's pages, and on a page if all its tokens follow each other
there in the order that they have on average, as often as they occur. The class of the page body, whose tokens
occur once in each page, is the outer template; others nest in it where their elements lie. Text of a valid class belongs to the
template: it stands wherever the elements of its class stand, once in the body or once in each item of a list. What
is left between the tokens of the template are the slots, and all of them are extracted, but for those that only their
tags or names tell from an article: menus, headers, footers, sidebars, notices, adverts, forms and comments. The deepest
element that occurs once and holds ``MAIN`` of what varies on a host is a slot as a whole, and so is an article or main element: a line that all
articles share is still a line of each.

Hosts of fewer than ``PAGES`` different pages show no classes; there an article or main element is taken, else the body, without
what tags and names give away; if nothing is left, all but menus, footers and the head.
A name gives an element away only as a whole (``sidebar``, ``site-nav``, not ``has-sidebar`` or ``navy``), and never html, body, main, article, a
heading, or what holds main or most of a page's text.

Nulls and edge cases: null or empty html gives an empty text; a null url is a host of its own;
unclosed, truncated and unbalanced markup is read as browsers do in the main; equal pages and ids are
extracted each, but count once for a class; a page is read whole, however long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Share of a host's pages that shows a valid class, and different pages that a host needs.
SUPPORT, PAGES = 0.5, 3
#: Tokens of templates, of 24 bytes each, up to which they are broadcast, and parts that a host's pages are dealt to beyond that.
BROADCAST, PARTS = 500_000, 64
#: Paths that a worker remembers, and the share of varying text that makes a slot the main one.
REMEMBERED, MAIN = 100_000, 0.9
#: What is too small, or too large, to be the main slot.
NO_SLOT = frozenset("html body p h1 h2 h3 h4 h5 h6 li td tr blockquote pre".split())
PIECE = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|select|iframe)\b.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[a-zA-Z/][^>]*$", re.S | re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
DROPPED = frozenset("nav footer aside form head title button dialog menu".split())
#: What no page's article lies in.
FRAME = frozenset("head title nav footer button menu".split())
#: A class, id or role that gives an element away: nothing but a name of the list, with a place or a kind of box beside it.
PLACE = r"(?:(?:site|global|main|primary|secondary|top|bottom|left|right|page|post|entry|article|sticky|fixed)[_-])*"
BOX = r"(?:[_-](?:area|wrapper|wrap|container|section|box|block|bar|list|links?|inner|slot|unit|menu|icons?|buttons?|form|\d+))*"
BAD = re.compile(
    rf"(?:^|\s){PLACE}(?:ads?|adverts?|advertis(?:ements?|ing)|banner|sponsors?|sponsored|promos?|promoted|nav|navbar|navigation|menus?|menubar|footer|masthead|side-?bar|cookies?|consent|notices?|newsletter|subscribe|comments?|replies|disqus|related|recommended|share|sharing|social|breadcrumbs?|popup|modal|login|signup|search|pagination|pager|widget){BOX}(?=\s|$)"
    r"|(?:^|\s)(?:(?:site|global|main|top|sticky|fixed)[_-])?header(?=\s|$)",
    re.I,
)
#: Elements that their names never give away, and the share of a page's text in an element that neither do.
SPARED, MOST = frozenset("html body main article h1 h2 h3 h4 h5 h6".split()), 0.8


def walk(page: str) -> Iterator[tuple[list[tuple[str, int, int]], str]]:
    """Blocks of text in page order, each with the open elements as (name, 1 or 2 if its tag or its class, id or role gives it away, number)."""
    stack: list[tuple[str, str, int, int]] = []
    held: list[str] = []
    at = 0

    def block() -> tuple | None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        return ([(n, bad, i) for tag, n, bad, i in stack if tag not in INLINE], text) if text else None

    for m in PIECE.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                held.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag not in INLINE and (b := block()):
                yield b
            continue
        if tag not in INLINE and (b := block()):
            yield b
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph; an item ends its brother
                if stack[i][0] == "p" or (stack[i][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if m[4] and m[4].rstrip().endswith("/") and tag not in INLINE:
            continue
        names = " ".join("".join(g) for g in NAMED.findall(m[4])) if "=" in m[4] else ""
        bad = int(tag in DROPPED or (tag == "header" and not any(s[0] in ("article", "main") for s in stack)))
        if not bad and names and tag not in SPARED and BAD.search(names):
            bad = 2
        stack.append((tag, f"{tag}.{names}" if names else tag, bad, at))
    held.append(page[at:])
    if b := block():
        yield b


def blocks_of(page: str) -> list[tuple[list[tuple[str, int, int]], str]]:
    """The blocks of a page, in which no class, id or role gives away what holds main or most of the text."""
    found, held, whole = list(walk(page)), {}, 0
    for path, text in found:
        if any(b == 1 for _, b, _ in path):
            continue
        whole += len(text)
        for k, (_, b, i) in enumerate(path):
            if b:
                own = any(n.split(".")[0] == "main" for n, _, _ in path[k + 1 :])
                held[i] = held.get(i, 0) + (float("inf") if own else len(text))
    spared = {i for i, c in held.items() if c >= MOST * whole}
    return [([(n, 0 if b == 2 and i in spared else b, i) for n, b, i in path], text) for path, text in found] if spared else found


class Tokens:
    """The tokens of pages as 64-bit hashes, with the hashes of paths remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, blocks: list[tuple[list[tuple[str, int, int]], str]]) -> tuple[list[int], list[list[int]]]:
        """All tokens in page order, elements that hold text and blocks, and for each block its elements and itself."""
        every, own, seen = [], [], set()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for path, text in blocks:
            name, keys = "", []
            for n, _, i in path:
                name = f"{name}/{n}"
                key = self.known.get(name)
                if key is None:
                    key = self.known[name] = xxhash.xxh3_64_intdigest(name) >> 1
                keys.append(key)
                if i not in seen:
                    seen.add(i)
                    every.append(key)
            keys.append(-1 - (xxhash.xxh3_64_intdigest(text, keys[-1] if keys else 0) >> 1))  # a text is negative
            own.append(keys)
            every.append(keys[-1])
        return every, own


def described(page: str, tokens: Tokens) -> list[tuple[int, int, bool, int, int, int, int, bool]]:
    """(key, up, can be a slot, depth, place, occurrences, characters, given away) of each token of a page, and of the page as token 0.

    Characters are those of text that no element below gives away.
    """
    blocks = blocks_of(page)
    every, own = tokens(blocks)
    place, n = {}, {}
    for i, key in enumerate(every):
        place.setdefault(key, i)
        n[key] = n.get(key, 0) + 1
    rows: dict[int, list] = {0: [0, False, 0, 0, False]}
    for (path, text), keys in zip(blocks, own, strict=True):
        up, away = 0, False
        inner = any(b for _, b, _ in path)
        for depth, (key, (name, b, _)) in enumerate(zip(keys, [*path, ("#", 0, 0)], strict=True)):
            away = away or bool(b)
            row = rows.setdefault(key, [up, name.split(".")[0] not in NO_SLOT and name != "#", depth, 0, away])
            row[3] += 0 if inner else len(text)
            up = key
    return [(key, up, can, depth, place.get(key, 0), n.get(key, 1), chars, away) for key, (up, can, depth, chars, away) in rows.items()]


def deduced(tokens: pa.Table) -> pa.Table:
    """The template of one host from its frequent tokens: the tokens of the valid classes that hold text, and the main slot."""
    rows = tokens.to_pylist()
    whole = next(r["pages"] for r in rows if r["key"] == 0)
    rows = {r["key"]: r for r in rows if r["pages"] >= SUPPORT * whole and r["key"]}
    classes: dict[int, list[dict]] = {}
    for r in rows.values():
        classes.setdefault(r["vector"], []).append(r)
    classes = {v: c for v, c in classes.items() if min(r["key"] for r in c) < 0 < max(r["key"] for r in c)}
    varying = {k: r["chars"] for k, r in rows.items() if k > 0}
    for c in classes.values():
        for r in c:
            up = r["up"] if r["key"] < 0 else 0
            while up in rows:
                varying[up] -= r["chars"]
                up = rows[up]["up"]
    most = max((v for k, v in varying.items() if rows[k]["away"] <= 0.5), default=0)
    fit = [k for k, v in varying.items() if v >= MAIN * most > 0 and rows[k]["can"] and rows[k]["most"] == 1 and rows[k]["away"] <= 0.5]
    slot = max(fit, key=lambda k: (rows[k]["depth"], varying[k], k), default=None)
    kept = [{"key": r["key"], "vector": r["vector"], "place": r["place"]} for c in classes.values() for r in c]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("vector", pa.int64()), ("place", pa.float64())]))
    return pa.table({"host": pa.array([tokens.column("host")[0].as_py()]), "classes": pa.array([kept], kind), "slot": pa.array([slot], pa.int64())})


def templates(pages: DataFrame) -> DataFrame:
    """(host, classes, slot) of hosts with enough pages; ``pages (host, html)``."""
    kinds = {"key": pa.int64(), "up": pa.int64(), "can": pa.bool_(), "depth": pa.int32(), "place": pa.int32(), "n": pa.int32(), "chars": pa.int64(), "away": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            found, at, same = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                rows = described(text or "", tokens)
                found += rows
                at += [i] * len(rows)
                same += [xxhash.xxh3_64_intdigest(text or "") >> 1] * len(rows)
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(same, pa.int64()), *columns], ["host", "page", *kinds])

    seen = pages.select("host", "html").mapInArrow(run, "host string, page long, key long, up long, can boolean, depth int, place int, n int, chars long, away boolean")
    # equal pages are one
    once = seen.groupBy("host", "key", "page").agg(*(F.min(c).alias(c) for c in kinds if c != "key"))
    token = once.groupBy("host", "key").agg(
        F.count("*").alias("pages"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.min("up").alias("up"),
        F.min("can").alias("can"),
        F.min("depth").alias("depth"),
        F.avg("place").alias("place"),
        F.max("n").alias("most"),
        F.sum("chars").alias("chars"),
        F.avg(F.col("away").cast("int")).alias("away"),
    )
    token = cut(token.where(f"pages >= {PAGES}"))
    hosts = token.where("key = 0").select("host", F.col("pages").alias("all"))
    # not more of a host than a page or two have, however many its pages are
    frequent = token.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all")).drop("all")
    return frequent.groupBy("host").applyInArrow(lambda t: deduced(t), "host string, classes array<struct<key:long,vector:long,place:double>>, slot long")


def ordered(every: list[int], classes: list[dict]) -> set[int]:
    """The texts of a page that belong to the template: those of classes whose tokens stand in order there."""
    order: dict[int, list[int]] = {}
    for c in sorted(classes, key=lambda c: (c["vector"], c["place"], c["key"])):
        order.setdefault(c["vector"], []).append(c["key"])
    own = {key: v for v, keys in order.items() for key in keys}
    met: dict[int, list[int]] = {}
    for key in every:
        if key in own:
            met.setdefault(own[key], []).append(key)
    return {k for v, keys in met.items() if not len(keys) % len(order[v]) and keys == order[v] * (len(keys) // len(order[v])) for k in keys if k < 0}


def main_text(page: str, classes: list[dict] | None, slot: int | None, tokens: Tokens) -> str:
    blocks = blocks_of(page)
    if classes is not None:
        every, own = tokens(blocks)
        fixed = ordered(every, classes)
        left = []
        for (path, t), keys in zip(blocks, own, strict=True):
            whole = slot in keys or any(n.split(".")[0] in ("article", "main") for n, _, _ in path)
            if (whole or keys[-1] not in fixed) and not any(b for _, b, _ in path):
                left.append(t)
        if left:
            return "\n".join(left)
    clean = [(path, t) for path, t in blocks if not any(b for _, b, _ in path)]
    if not clean:  # a form or the like round all of it
        clean = [(path, t) for path, t in blocks if not any(n.split(".")[0] in FRAME for n, _, _ in path)]
    inner = [t for path, t in clean if any(n.split(".")[0] in ("article", "main") for n, _, _ in path)]
    return "\n".join(inner or [t for _, t in clean])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    host = F.coalesce(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"//([^/?#]+)", 1), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    known = cut(templates(own))
    if (known.agg(F.sum(F.size("classes") + 1)).first()[0] or 0) <= BROADCAST:
        met = own.join(F.broadcast(known), "host", "left")
    else:  # a host's pages are dealt to several tasks, and its template goes to each
        part = F.pmod(F.xxhash64("page", "html"), F.lit(PARTS))
        dealt = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        met = own.withColumn("part", part).join(dealt, ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            texts = [main_text(h or "", c, s, tokens) for h, c, s in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return met.select("page", "url", "html", "classes", "slot").mapInArrow(run, "id long, url string, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
ORACLE_SQL: dict[str, str] = {}
