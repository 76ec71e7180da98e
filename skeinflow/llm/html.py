"""Main text of web pages by equivalence classes of template tokens.

A token is an element at its place in the page (the elements down to it, with their names), or a block of text
at its place. Over the pages of a host each token has an occurrence vector: how often it stands in each page.
Tokens of equal vectors make a class. Of classes that stand at most once in a page, the elements must keep one
order without crossing; those that do nest class in class, outermost first, into the host's template. The
gaps between the template's elements are the slots; the slot with most text that is no link and no template
text is the article's, and the element around it and around what belongs to it is the container. What is
left of it without template text and furniture is the page's main text.

Vectors are never gathered: a vector is known by sums of hashes of (page, count) over its pages, which add up
before the shuffle. A host without two different pages has no classes; its pages are each taken for themselves, every
element that stands once being template."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brief, checkpoint, mix

#: Fixed names of HTML: elements without content, with raw content, inside a line, and of running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
FLOW = frozenset("p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption hr address math".split())
#: Elements, and words of class, id and role, that mark furniture; and words that may stand beside these in a name.
FURNITURE = frozenset("head title nav footer aside form button select dialog menu".split()) | RAW
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe signup sidebar related recommended menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus discussion discussions reply replies replylist respond response responses share sharing social toolbar pagination pager complementary contentinfo search".split())
#: Words that mark furniture unless what they name has most of the text.
WEAK_WORDS = frozenset("banner promo promotion notice notices alert alerts popup modal overlay widget widgets".split())
PLAIN_WORDS = frozenset("site page top bottom left right main box bar list section area block container wrapper wrap inner outer item items link links form button buttons user reader post article primary secondary global message text slot unit thread threads count".split())
HEADERS = frozenset("header site-header page-header top-header".split())
MAIN_NAMES = frozenset("articlebody maincontent main-content".split())
#: A class belongs to the template if this share of the host's pages hold it, and two at least.
SHARE = 0.5
#: Different pages that a host's template, and a template's text, must stand in.
EVIDENCE = 2
#: Text that makes up more of the container than this is the article of copied pages, and no template text.
MOST_TEXT = 0.5
#: Text of elements with weak names of furniture stays if it is so many times the rest of the container's.
MOSTLY = 3
#: Templates up to this size in all are sent to every task.
BROADCAST_BYTES = 16 << 20

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FLIP = 0x5555555555555555


class Node:
    """An open element: its tag, its place, the place of the last element down to it that is no running text, and of
    that before; whether it is furniture, in a marked main part, in a link, in the container; 2 for an article, 1 for
    a main part, else 0; whether a weak name of furniture is on it or around it within the container."""

    __slots__ = ("tag", "place", "box", "up", "furniture", "main", "link", "inside", "mark", "weak")

    def __init__(self, tag: str, place: int, box: int, up: int, furniture: bool, main: bool, link: bool, inside: bool, mark: int, weak: bool = False):
        self.tag, self.place, self.box, self.up, self.furniture, self.main, self.link, self.inside, self.mark, self.weak = tag, place, box, up, furniture, main, link, inside, mark, weak


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=100_000)
def _marks_furniture(name: str) -> int:
    """Whether a whole class name, id or role is of words that mark furniture, alone or beside plain ones: 2, or 1 if these
    are weak ones alone, else 0."""
    parts = [p for p in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
    if not all(p in FURNITURE_WORDS or p in WEAK_WORDS or p in PLAIN_WORDS for p in parts):
        return 0
    return 2 if any(p in FURNITURE_WORDS for p in parts) else 1 if any(p in WEAK_WORDS for p in parts) else 0


def _node(above: Node, tag: str, attrs: str, container: int | None, by_names: bool) -> Node:
    names, hidden, roles, mark = [], False, [], 2 if tag == "article" else 1 if tag == "main" else 0
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key in ("class", "id", "role"):
            own = value.split()
            names += own
            if not re.search(r"\d", value):
                roles.append(" ".join(own))
            if key == "role" and value.lower() in ("main", "article"):
                mark = max(mark, 2 if value.lower() == "article" else 1)
        if key in ("class", "id", "itemprop") and any(x.lower() in MAIN_NAMES for x in value.split()):
            mark = max(mark, 1)
    furniture, weak = above.furniture, above.weak
    if tag not in ("html", "body"):
        furniture |= hidden or tag in FURNITURE and (by_names or tag != "form") or tag == "header" and not above.main
        if by_names:
            named = max(map(_marks_furniture, names), default=0)
            furniture |= named == 2 or named == 1 and tag in INLINE
            weak |= named == 1
            furniture |= not above.main and any(x.lower() in HEADERS for x in names)
    main = above.main or mark > 0
    if tag in INLINE:
        return Node(tag, above.place, above.box, above.up, furniture, main, above.link or tag == "a", above.inside, above.mark, weak)
    place = _hash(f"{above.place}/{tag}[{' '.join(roles)}]")
    if tag in FLOW:
        return Node(tag, place, above.box, above.up, furniture, main, above.link, above.inside, mark, weak)
    return Node(tag, place, place, above.box, furniture, main, above.link, above.inside or place == container, mark, weak and place != container)


def events(page: str, container: int | None = None, by_names: bool = True) -> Iterator[tuple[str, Node, str]]:
    """('open' | 'close', element, '') and ('text', element it is in, text), in page order.
    Tags left open are closed by the end of what holds them; a new paragraph or item closes the last."""
    root = Node("", 0, 0, 0, False, False, False, False, 0)
    stack, open_, at, known = [root], Counter(), 0, {}
    n = len(page)

    def close(to: int) -> Iterator[tuple[str, Node, str]]:
        while len(stack) > to:
            node = stack.pop()
            open_[node.tag] -= 1
            yield "close", node, ""

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield "text", stack[-1], page[at:end]
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                yield from close(i)
            continue
        if tag == "br":
            yield "text", stack[-1], " "
            continue
        if tag not in INLINE:  # a block ends an open paragraph; an item ends the item before it
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or t == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                    yield from close(i)
                    break
                if t not in INLINE:
                    break
        above = stack[-1]
        key = (above.place, above.furniture, above.main, above.link, above.weak, tag, m[3])
        node = known.get(key)
        if node is None:
            node = known[key] = _node(above, tag, m[3], container, by_names)
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag != "p":
            yield "open", node, ""
            yield "close", node, ""
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if found or tag not in ("svg", "noscript", "template"):  # of these only what has an end holds anything
                at = found.end() if found else n
            yield "open", node, ""
            yield "close", node, ""
            continue
        yield "open", node, ""
        stack.append(node)
        open_[tag] += 1
    yield from close(1)


def blocks(page: str, container: int | None = None, by_names: bool = True) -> Iterator[tuple[str, Node, str, int]]:
    """('open' | 'close', element, '', 0) of elements outside lines, and ('block', element it is in, text, characters
    of it in links): the text between two of these, its white space made single, furniture left out."""
    now: list[str] = []
    at, links = None, 0
    for kind, node, text in events(page, container, by_names):
        if kind == "text":
            if not node.furniture:
                at = at or node
                now.append(text)
                links += len(text) * node.link
            continue
        if node.tag in INLINE:
            continue
        if at is not None:
            if line := " ".join("".join(now).split()):
                yield "block", at, line, min(links, len(line))
            now, at, links = [], None, 0
        yield kind, node, "", 0
    if at is not None and (line := " ".join("".join(now).split())):
        yield "block", at, line, min(links, len(line))


#: Of an element: where it is, its mark, and by page: how often, first place and end, text and link characters in it.
#: Of a text: the place it is at; its characters.
_FIGURES = ("up", "mark", "count", "pos", "end", "chars", "links")
ELEMENT, TEXT = 0, 1


def _tokens(page: str, by_names: bool = True) -> dict[tuple[int, int], list[int]]:
    """The tokens (kind, hash) of a page outside furniture, with their figures."""
    places: dict[int, list[int]] = {}
    texts: dict[tuple[int, int], list[int]] = {}
    for i, (kind, node, line, links) in enumerate(blocks(page, None, by_names)):
        if node.furniture:
            continue
        if kind == "block":
            n = -(-len(line) // (1 + node.weak))  # of two slots of about as much text the one without such a name is the article's
            g = texts.get(key := (TEXT, _hash(f"{node.place}#{line}")))
            if g is None:
                g = texts[key] = [node.box, 0, 0, i, i, n, 0]
            g[2] += 1
            if (at := places.get(node.box)) is not None:
                at[5] += n
                at[6] += min(links, n)
        elif node.box == node.place:
            g = places.get(node.place)
            if g is None:
                g = places[node.place] = [node.up, node.mark, 0, i, i, 0, 0]
            if kind == "open":
                g[2] += 1
            else:
                g[4] = max(g[4], i)
    for place in reversed(places):
        g = places[place]
        if (up := places.get(g[0])) is not None:
            up[5] += g[5]
            up[6] += g[6]
    return {(ELEMENT, p): g for p, g in places.items()} | texts


_STATS = "host string, kind int, token long, up long, mark int, pages long, total long, v1 long, v2 long, pos long, end long, chars long, links long, b1 long, b2 long, b3 long, b4 long"
_SUMS = ("pages", "total", "v1", "v2", "pos", "end", "chars", "links")
_LOW31 = (1 << 31) - 1


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each batch and host: of each token its sums over the pages, and the extremes of the pages' hashes."""
    for pdf in batches:
        got: dict[tuple[str, int, int], list[int]] = {}
        for host, key, body, page in zip(pdf["host"], pdf["key"].tolist(), pdf["body"].tolist(), pdf["html"], strict=True):
            tokens = _tokens(page or "")
            counts = np.fromiter((g[2] for g in tokens.values()), dtype=np.uint64, count=len(tokens))
            weights = mix(np.uint64(key & (2**64 - 1)) ^ mix(counts)).tolist()
            other = body ^ _FLIP
            for (kind, token), f, w in zip(tokens, tokens.values(), weights, strict=True):
                g = got.get((host, kind, token))
                if g is None:
                    g = got[host, kind, token] = [f[0], f[1], 0, 0, 0, 0, 0, 0, 0, 0, body, body, other, other]
                g[2] += 1
                g[3] += f[2]
                g[4] += w & _LOW31
                g[5] += w >> 31 & _LOW31
                g[6] += f[3]
                g[7] += f[4]
                g[8] += f[5]
                g[9] += f[6]
                if body < g[10]:
                    g[10] = body
                elif body > g[11]:
                    g[11] = body
                if other < g[12]:
                    g[12] = other
                elif other > g[13]:
                    g[13] = other
        yield pd.DataFrame([(*k, *g) for k, g in got.items()], columns=[x.split()[0] for x in _STATS.split(", ")])


def _different() -> str:
    """SQL: how many different pages the extremes of the pages' hashes show, four at most."""
    return f"size(array_distinct(array(b1, b2, b3 ^ {_FLIP}L, b4 ^ {_FLIP}L)))"


def classes(pages: DataFrame) -> DataFrame:
    """Equivalence classes of each host of `pages(page_id, url, html, host)`: rows (host, of, pages, total, v1, v2,
    tokens): `of` pages of the host, in `pages` of which the tokens stand, `total` times in all.

    Only hosts with EVIDENCE different pages have classes, and only those that a fixed share of the host's pages hold:
    as such tokens fill that share of all pages, a host has no more of them than a few pages have tokens."""
    body = pages.select("host", F.xxhash64("page_id", "url", "html").alias("key"), F.xxhash64("html").alias("body"), "html")
    extremes = [F.min("b1").alias("b1"), F.max("b2").alias("b2"), F.min("b3").alias("b3"), F.max("b4").alias("b4")]
    other = F.expr(f"body ^ {_FLIP}L")
    hosts = body.select("host", F.col("body").alias("b1"), F.col("body").alias("b2"), other.alias("b3"), other.alias("b4")).groupBy("host").agg(F.count("*").alias("of"), *extremes)
    hosts = checkpoint(hosts.where(f"{_different()} >= {EVIDENCE}").select("host", "of"))
    stats = body.mapInPandas(_stats, _STATS)
    by_host = stats.groupBy("host", "kind", "token").agg(F.min("up").alias("up"), F.max("mark").alias("mark"), *[F.sum(c).alias(c) for c in _SUMS], *extremes).where("pages > 1")
    common = by_host.join(brief(hosts), "host").where(F.col("pages") >= F.col("of") * SHARE).withColumn("shown", F.expr(_different()))
    token = F.struct("kind", "token", "up", "mark", "pos", "end", "chars", "links", "shown")
    return common.groupBy("host", "of", "pages", "total", "v1", "v2").agg(F.collect_list(token).alias("tokens"))


def ordered(tokens: list[dict]) -> list[dict]:
    """The elements of a class that keep one order: spans, by their mean places in the class's pages, that lie one in
    another or apart. Of two that cross the one with less text goes."""
    kept: dict[int, dict] = {}
    open_: list[dict] = []
    for x in sorted(tokens, key=lambda x: (x["pos"], -x["end"], x["token"])):
        while open_ and open_[-1]["end"] < x["pos"]:
            open_.pop()
        while open_ and open_[-1]["end"] < x["end"] and open_[-1]["chars"] < x["chars"]:
            del kept[open_.pop()["token"]]
        if not open_ or x["end"] <= open_[-1]["end"]:
            kept[x["token"]] = x
            open_.append(x)
    return list(kept.values())


def nest(of: int, found: list[tuple[int, int, list[dict]]]) -> dict:
    """The template of one host from its classes (pages, total, tokens): its container, a place, and template texts.

    Classes that stand once in each of their pages nest, those of most pages first, then those of most tokens: an
    element is taken if the element around it, running text aside, is in the template already."""
    once = sorted((c for c in found if c[0] == c[1]), key=lambda c: (-c[0], -len(c[2]), min(x["token"] for x in c[2])))
    tree: dict[int, dict] = {}
    waiting = [x for c in once for x in ordered([x for x in c[2] if x["kind"] == ELEMENT])]
    while waiting:
        rest = []
        for x in waiting:
            if x["up"] == 0 or x["up"] in tree:
                tree[x["token"]] = x
            else:
                rest.append(x)
        if len(rest) == len(waiting):
            break
        waiting = rest
    held = {x["token"]: x | {"in": c[0]} for c in found for x in c[2] if x["kind"] == TEXT and x["shown"] >= EVIDENCE}
    inside: dict[int, list[int]] = {}  # template text by the element of the template around it
    parents = {x["token"]: x["up"] for c in found for x in c[2] if x["kind"] == ELEMENT}
    for t, x in held.items():
        p = x["up"]
        while p and p not in tree:
            p = parents.get(p, 0)
        inside.setdefault(p, []).append(t)
    fixed = dict.fromkeys(tree, 0)
    for p, ts in inside.items():
        n = sum(held[t]["chars"] for t in ts)
        while p in tree:
            fixed[p] += n
            p = tree[p]["up"]
    container = _container(tree, fixed)
    # What is marked as the article keeps all its text; elsewhere text of every page is template, unless it is most there is.
    texts = sorted(t for t, x in held.items() if x["in"] == of)
    if container is not None and (tree[container]["mark"] or fixed[container] > MOST_TEXT * tree[container]["chars"]):
        texts = []
    return {"container": container, "texts": texts}


def _container(tree: dict[int, dict], fixed: dict[int, int]) -> int | None:
    """The element around the slot with most text: the article it is in, else the main part, else as far out as what
    comes in is mostly text of the pages' own."""
    own = {p: x["chars"] - x["links"] - fixed[p] for p, x in tree.items()}
    slot = dict(own)
    for p, x in tree.items():
        if x["up"] in slot:
            slot[x["up"]] -= own[p]
    if not slot or max(slot.values()) <= 0:
        return None
    best = min(tree, key=lambda p: (-slot[p], tree[p]["pos"], p))
    around = []
    p = best
    while p in tree:
        around.append(p)
        p = tree[p]["up"]
    for mark in (2, 1):
        if marked := [p for p in around if tree[p]["mark"] == mark]:
            return marked[-1]
    for p in around[1:]:
        more, new = tree[p]["chars"] - tree[best]["chars"], own[p] - own[best]
        behind = sum(own[c] for c, x in tree.items() if x["up"] == p and x["pos"] > tree[best]["end"])
        if new < 0.5 * more or new <= behind < 0.25 * own[best]:  # mostly links or template; or but little, and all of it behind
            break
        best = p
    return best


def alone(page: str, by_names: bool = True) -> dict:
    """The template of a page by itself: elements that stand once are of one class."""
    tokens = [dict(zip(_FIGURES, g, strict=True), kind=k, token=t, shown=1) for (k, t), g in _tokens(page, by_names).items() if k == ELEMENT and g[2] == 1]
    return nest(1, [(1, 1, tokens)]) if tokens else {"container": None, "texts": []}


def slots(page: str, template: dict | None) -> str:
    """The main text of a page: what its container holds besides template text and furniture.

    A page that has no text there, being of another form than its host's others, is taken by itself; one whose text
    is all in a form or in elements of furniture's names is taken again without regard to these."""
    for t, by_names in ((template, True), (None, True), (None, False)):
        if t is None and (t := alone(page, by_names))["container"] is None:
            t = {"container": 0, "texts": []}
        if text := _slots(page, t, by_names):
            return text
    return ""


def _slots(page: str, template: dict, by_names: bool) -> str:
    container, texts = template["container"], frozenset(template["texts"])
    out, weak, rest = [], 0, 0
    for kind, node, line, _ in blocks(page, container, by_names):
        if kind == "block" and (not container or node.inside) and not (texts and _hash(f"{node.place}#{line}") in texts):
            if text := " ".join(entities.unescape(line).split()):
                out.append((node.weak, text))
                weak, rest = weak + node.weak * len(text), rest + (not node.weak) * len(text)
    return "\n\n".join(text for named, text in out if not named or weak > MOSTLY * rest)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page of `pages(page_id, url, html)`.

    A null or empty page gives the empty text. A page whose url has no host is of the host ''. Equal rows each have
    a row. A page's text depends on its host's other pages: from two different ones on they share a template. Where nothing is
    marked as the article, text that stands at one place in all of them is template, unless it is most of the container's.
    A page takes memory in proportion to its length."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    rows = F.struct("pages", "total", "tokens")

    @F.pandas_udf("string")
    def nested(of: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(nest(n, [(r["pages"], r["total"], list(r["tokens"])) for r in x])) for n, x in zip(of, found, strict=True)], dtype=object)

    templates = checkpoint(classes(own).groupBy("host", "of").agg(F.collect_list(rows).alias("rows")).select("host", nested("of", "rows").alias("template")))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        read = lru_cache(maxsize=1000)(json.loads)
        for html, template in batches:
            yield pd.Series([slots(h or "", None if t is None else read(t)) for h, t in zip(html, template, strict=True)], dtype=object)

    if (templates.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        templates = F.broadcast(templates)  # else pages are shuffled by host, a large host in parts
    got = own.join(templates, "host", "left").select("page_id", "url", text("html", "template").alias("text"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
