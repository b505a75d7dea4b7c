"""Main text of web pages through wrappers inferred per host.

A page is a stream of tokens: the elements that open and close around its text blocks, and the texts. The streams of one host are aligned
one after the other, and a union-free regular expression is inferred. At each element, tokens that both sides have are merged; a token that
one side lacks becomes optional, one that repeats becomes a repeated group, and tokens that come in different orders become one repeated group
of optional tokens, ( a? b? )+, which is balanced and matches either order. Texts that differ become a slot; a container that stands with the
same whole text on most distinct pages of the host is a constant of the template. The page's main text is what its slots hold
in the wrapper, in page order, except for slots whose place in the wrapper is boilerplate: menus, headers, footers, sidebars, notices, adverts, forms
and comments. A container is a div or section; paragraphs, headings and lists are the flow of the container around them, so a sentence or heading that
stands on all pages among others that differ is no constant, and neither is what stands in an article or main element directly.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import spread_join, stored

#: Elements whose content is never text.
_RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|math"
_QUOTED = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
#: A tag with a quote that nothing closes ends at its first '>'; what begins like a tag and never ends is no text either.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|$)|<({_RAW})\b(?:{_QUOTED}>|[^>]*>).*?(?:</\1\s*>|$)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:({_QUOTED})>|([^>]*)(?:>|$))",
    re.S | re.I,
)
#: One attribute with its value, so that a search from the start never begins inside a value.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLOCK = frozenset(
    "html head body title div p ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside main article section form fieldset"
    " h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr details summary dialog menu hgroup search center".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Opening one of these ends an open paragraph; an item, cell or row ends its open sibling.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("html body div table ul ol dl article main section nav aside header footer form blockquote figure menu dialog".split())
BOILERPLATE_TAGS = frozenset("head title nav header footer aside form menu dialog search button".split())
#: Words of class and id names that mark boilerplate, those that do so only for blocks that are mostly links, and words that say nothing.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing comment comments reply replies respond disqus"
    " widget toolbar pagination pager copyright hdr ftr topbar bottombar teaser teasers".split()
)
WEAK = frozenset("related recommended recommendations social discussion legal disclaimer alert more tags card cards preview".split())
#: Who speaks and what they say: a name with one of each, as user-reviews, is of reader comments.
_READERS = frozenset("user users reader readers customer customers visitor visitors guest guests".split())
_VOICES = frozenset("review reviews opinion opinions rating ratings feedback".split())
NEUTRAL = frozenset(
    "site page main global top bottom left right inner outer wrapper wrap container box block area section list item items link links button buttons icon icons bar row col column content"
    " text body title label form post posts article articles media primary secondary thread is has js the and of by to for my our new msg message messages".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_MAIN_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Marks of an element: boilerplate, main region, boilerplate if mostly links.
_MARKS = "!*~"
#: Wrappers that one task aligns.
_FAN = 64
#: Elements that hold parts of a page; the others hold the flow of a text.
_CONTAINERS = frozenset("html body div section center fieldset hgroup article main".split())
_LISTS = frozenset("ul ol dl menu".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
#: Bytes of all wrappers up to which they are sent to the workers, so that no page is shuffled; beyond it pages and wrappers are joined.
MAX_SENT_BYTES = 32 << 20
#: A container that is on more than this share of a host's distinct pages, and on two or more, with the same text is part of the template.
_SAME_SHARE = 0.5
SLOT = "#"


class Block(NamedTuple):
    """A text block: path of open elements, text, characters inside links, all characters, how many of the open elements are those of the block
    before, the path of the containers around it with their class names, and which of the page's containers is the innermost."""

    path: str
    text: str
    linked: int
    total: int
    kept: int
    container: str
    instance: int


def name_mark(value: str) -> str:
    """'!' or '~' for a class or id attribute. A name counts only if all its words do: a related-work or social-history is no boilerplate."""
    mark = ""
    for name in value.split():
        listed = re.findall(r"[a-z]+", name)
        words = set(listed)
        if "".join(listed) in STRONG or words & _READERS and words & _VOICES and words <= _READERS | _VOICES | NEUTRAL:
            return "!"
        if words and words <= STRONG | WEAK | NEUTRAL:
            if words & STRONG:
                return "!"
            if words & WEAK:
                mark = "~"
    return mark


def _signature(tag: str, attributes: str) -> tuple[str, str]:
    """Tag with a mark for what decides its role, and its class names without digits."""
    names = ""
    mark = "!" if tag in BOILERPLATE_TAGS else "*" if tag in _MAIN_TAGS else ""
    if attributes and tag not in ("html", "body"):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                mark = "!" if value in BOILERPLATE_ROLES else "*" if value in ("main", "article") and not mark else mark
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                mark = "!"
            elif name == "style" and _HIDDEN.search(value):
                mark = "!"
            elif name in ("class", "id") and (own := name_mark(value)) and mark != "!":
                mark = own if own == "!" or not mark else mark
            if name == "class":
                names = ".".join(sorted(set(re.sub(r"[0-9]+", "", value).split())))
    return tag + mark, names


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: white space inside one becomes one space, references are decoded."""
    stack: list[str] = []
    places = [("", 0)]  # the container of each open element and its number, after that of the page
    n_containers = 0
    out: list[Block] = []
    text: list[str] = []
    linked = total = depth = at = kept = 0

    def flush() -> None:
        nonlocal linked, total, kept
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block("/".join(stack), joined, linked, total, kept, *places[-1]))
            kept = len(stack)
        text.clear()
        linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        if raw:
            text.append(html.unescape(raw))
            total += len(raw)
            linked += len(raw) if depth else 0

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        elif tag not in _BLOCK:
            if tag == "a":
                depth = max(0, depth + (-1 if m[2] else 1))
        elif m[2]:
            names = [s.rstrip(_MARKS) for s in stack]
            if tag in names:
                flush()
                i = len(names) - 1 - names[::-1].index(tag)
                del stack[i:], places[i + 1 :]
                kept = min(kept, len(stack))
                depth = 0
            elif tag == "p":
                flush()
        else:
            flush()
            depth = 0
            for i in range(len(stack) - 1, -1, -1):  # what the new element closes
                name = stack[i].rstrip(_MARKS)
                if name == "p" or name in _HEADINGS and tag in _HEADINGS:
                    del stack[i:], places[i + 1 :]
                    break
                if name in _SIBLINGS.get(tag, ()):
                    del stack[i:], places[i + 1 :]
                    if not (tag == "tr" and name != "tr"):
                        break
                elif name in _SCOPE:
                    break
            kept = min(kept, len(stack))
            if tag not in _VOID:
                signature, classes = _signature(tag, m[4] if m[4] is not None else m[5])
                stack.append(signature)
                n_containers += tag in _CONTAINERS
                places.append((f"{places[-1][0]}/{tag}.{classes}", n_containers) if tag in _CONTAINERS else places[-1])
    add(page[at:])
    flush()
    return out


# Wrappers. A node is {"e": pairs of child tokens that follow each other, "f": flags, "k": children}: for each child token 1 if it is optional plus 2 if
# it repeats, and the nodes below. Pairs give the order: tokens that come before each other share a factor, a repeated group of optional
# ones. The node of a slot is {"n": characters, "l": characters in links}.


def factors(node: dict) -> list[list[str]]:
    """Child tokens of a node in an order that keeps all its pairs; tokens that come before each other share a factor."""
    names = list(node["k"])
    below: dict[str, set[str]] = {n: set() for n in names}
    for a, b in node["e"]:
        below[a].add(b)

    def reached(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for x in below[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    far = {n: reached(n) for n in names}
    done: set[str] = set()
    out: list[list[str]] = []
    # a token before others reaches more of them; equal ones stay in name order
    for n in sorted(names, key=lambda n: (-len(far[n] | {n}), n)):
        if n not in done:
            own = sorted({n} | {m for m in far[n] if n in far[m]})
            done.update(own)
            out.append(own)
    return out


def align(a: dict, b: dict) -> dict:
    """The wrapper that matches what either of two wrappers matches, and their alignment: a page's stream is a wrapper as well."""
    if "n" in a:
        return {"n": a["n"] + b["n"], "l": a["l"] + b["l"]}
    after = a["e"] if a["e"] == b["e"] else sorted({*map(tuple, a["e"]), *map(tuple, b["e"])})
    names = sorted({*a["k"], *b["k"]})
    flags = {n: a["f"].get(n, 1) | b["f"].get(n, 1) for n in names}
    nodes = {n: align(a["k"][n], b["k"][n]) if n in a["k"] and n in b["k"] else a["k"].get(n) or b["k"][n] for n in names}
    return {"e": [list(p) for p in after], "f": flags, "k": nodes}


def _children(tokens: list[tuple[str, dict]]) -> dict:
    """Node of one element from its child tokens in page order."""
    names = [n for n, _ in tokens]
    nodes: dict[str, dict] = {}
    flags: dict[str, int] = {}
    for n, w in tokens:
        flags[n] = 2 if n in nodes else 0
        nodes[n] = align(nodes[n], w) if n in nodes else w
    after = sorted({p for p in zip(names, names[1:], strict=False) if p[0] != p[1]})
    return {"e": [list(p) for p in after], "f": flags, "k": nodes}


def stream(found: list[Block]) -> dict:
    """The wrapper of a single page."""
    open_: list[tuple[str, list]] = [("", [])]

    def close(depth: int) -> None:
        while len(open_) > depth + 1:
            name, tokens = open_.pop()
            open_[-1][1].append((name, _children(tokens)))

    for b in found:
        own = b.path.split("/") if b.path else []
        close(b.kept)
        for name in own[b.kept :]:
            open_.append((name, []))
        open_[-1][1].append((SLOT, {"n": b.total, "l": b.linked}))
    close(0)
    return _children(open_[0][1])


def matches(wrapper: dict, page: dict) -> bool:
    """Whether a wrapper's expression matches a page's: each element's tokens come in the wrapper's order, and none is missing that is not optional."""
    if "n" in wrapper:
        return "n" in page
    if "n" in page:
        return False
    order, steps = factors(wrapper), factors(page)
    place = {n: i for i, f in enumerate(order) for n in f}
    own = [n for f in steps for n in f]
    if any(n not in place for n in own) or any(not wrapper["f"][n] & 1 and len(order[place[n]]) == 1 for n in place if page["f"].get(n, 1) & 1):
        return False
    at = [sorted({place[n] for n in f}) for f in steps]
    if any(len(s) > 1 for s in at) or at != sorted(at):
        return False
    if any(page["f"][n] & 2 and not wrapper["f"][n] & 2 and len(order[place[n]]) == 1 for n in own):
        return False
    return all(matches(wrapper["k"][n], page["k"][n]) for n in own)


def expression(wrapper: dict) -> list[str]:
    """Tokens of the regular expression: elements, '#' for a slot, '(' ... ')+' for repeated and '[' ... ']?' for optional groups."""
    out: list[str] = []
    for f in factors(wrapper):
        parts = []
        for n in f:
            part = [SLOT] if n == SLOT else [f"<{n}>", *expression(wrapper["k"][n]), f"</{n}>"]
            if wrapper["f"][n] & 2 and len(f) == 1:
                part = ["(", *part, ")+"]
            parts += ["[", *part, "]?"] if wrapper["f"][n] & 1 or len(f) > 1 else part
        out += ["(", *parts, ")+"] if len(f) > 1 else parts
    return out


def slots(wrapper: dict) -> dict[str, str]:
    """Path -> role of each slot of a wrapper: content (inside a main region), other, or boilerplate.

    An element that is marked as boilerplate only if mostly links is so by the characters of all its slots over the host's pages.
    """
    out: dict[str, str] = {}

    def size(node: dict) -> tuple[int, int]:
        if "n" in node:
            return node["n"], node["l"]
        parts = [size(k) for k in node["k"].values()]
        return sum(n for n, _ in parts), sum(l for _, l in parts)

    def walk(node: dict, path: list[str], linked: bool) -> None:
        for name, below in node["k"].items():
            if name == SLOT:
                out["/".join(path)] = "boilerplate" if linked else role("/".join(path))
            else:
                n, l = size(below) if name.endswith("~") else (1, 0)
                walk(below, [*path, name], linked or 2 * l > n)

    walk(wrapper, [], False)
    return out


def role(path: str) -> str:
    """content, other or boilerplate by the elements of a path; the heading in an article's header is content."""
    own = path.split("/") if path else []
    main = any(s.endswith("*") for s in own)
    heading = bool(own) and own[-1] in _HEADINGS and main
    if any(s.endswith("!") and not (s == "header!" and heading) for s in own):
        return "boilerplate"
    return "content" if main else "other"


def _left_out(found: list[Block], kinds: list[str], explicit: bool) -> set[int]:
    """Places of blocks that others of their page show to be no main text.

    Without a main region these are entries of lists of whose characters most are links; a link among other entries stays. With several
    articles these are teasers: articles whose first block is a heading that is a link, where another article's is not.
    """
    opened: list[tuple[int, int]] = []
    groups: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(found):
        own = [s.rstrip(_MARKS) for s in b.path.split("/")] if b.path else []
        opened = opened[: b.kept] + [(i, d) for d in range(b.kept, len(own))]  # a name for each open element
        if explicit:
            at = max((d for d, s in enumerate(own) if s == "article"), default=None) if kinds[i] == "content" else None
        else:
            item = max((d for d, s in enumerate(own) if s in ("li", "dt", "dd", "menu")), default=None)
            at = None if item is None else max((d for d in range(item + 1) if own[d] in _LISTS), default=item)
        if at is not None:
            groups.setdefault(opened[at], []).append(i)
    of_links = lambda g: 2 * sum(found[i].linked for i in g) > sum(found[i].total for i in g)
    if not explicit:
        return {i for g in groups.values() if of_links(g) for i in g}
    teasers = [g for g in groups.values() if found[g[0]].path.rsplit("/", 1)[-1] in _HEADINGS and of_links(g[:1])]
    return {i for g in teasers for i in g} if len(teasers) < len(groups) else set()


def read(found: list[Block], roles: dict[str, str], constants: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page: the texts of its slots in the wrapper, in page order, without boilerplate.

    Where the page's stream takes the wrapper's main regions, only these count; elsewhere lists that are mostly links do not. Constants of the
    template are left out.
    """
    kinds = [roles.get(b.path, "") for b in found]
    explicit = "content" in kinds
    wanted = "content" if explicit else "other"
    without = _left_out(found, kinds, explicit)
    template = {n for n, (c, t) in _containers(found, kinds, wanted).items() if _place(explicit, c, t) in constants} if constants else set()
    return " ".join(b.text for i, b in enumerate(found) if kinds[i] == wanted and i not in without and b.instance not in template)


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _containers(found: list[Block], kinds: list[str], wanted: str) -> dict[int, tuple[str, str]]:
    """Number -> path and text of the containers of a page, of their blocks of the wanted kind beside those of other containers inside."""
    parts: dict[int, tuple[str, list[str]]] = {}
    for b, kind in zip(found, kinds, strict=True):
        if kind == wanted:
            parts.setdefault(b.instance, (b.container, []))[1].append(b.text)
    return {n: (c, "\n".join(t)) for n, (c, t) in parts.items()}


def _place(explicit: bool, container: str, text: str) -> int:
    """Hash of a container and its text; its lowest bit tells pages with a main region from the others."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{container}\n{text}") >> 2 << 1 | explicit


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> rows (host, wrapper) of hosts in the batch, and rows (host, place, core, kept) of the containers outside boilerplate.

    kept is 1 for main regions themselves and the page's core, which are never constants: copies of an article with different surroundings keep it.
    The core is the longest main region by the text that stands in it directly, or else the longest container. Copies of a page share it, also where short parts differ, so distinct
    cores count the pages that differ otherwise. A page itself is the place -2 with a main region, else -1.
    """
    import xxhash

    digest = lambda t: xxhash.xxh64_intdigest(t) >> 1
    for batch in batches:
        wrappers: dict[str, dict] = {}
        rows: set[tuple[str, None, int, int, int]] = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = blocks(page or "")
            own = stream(found)
            wrappers[host] = align(wrappers[host], own) if host in wrappers else own
            by_path = {p: role(p) for p in {b.path for b in found}}
            explicit = "content" in by_path.values()
            parts = _containers(found, [by_path[b.path] for b in found], "content" if explicit else "other")
            regions = {n for n, (c, _) in parts.items() if c.rsplit("/", 1)[-1].split(".")[0] in _MAIN_TAGS}
            first = min(parts, key=lambda n: (n not in regions, -len(parts[n][1]), parts[n][1], n), default=None)
            core = digest(parts[first][1] if parts else "")
            rows |= {(host, None, _place(explicit, c, t), core, int(n == first or n in regions)) for n, (c, t) in parts.items()}
            rows.add((host, None, -1 - explicit, core, 0))
        out = [(h, json.dumps(w, sort_keys=True), None, None, None) for h, w in wrappers.items()] + list(rows)
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "wrapper", "place", "core", "kept"])


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """Wrappers of one host (and salt) -> one; in the order of their text, so the result is stable."""
    texts = sorted(part["wrapper"])
    whole = json.loads(texts[0])
    for text in texts[1:]:
        whole = align(whole, json.loads(text))
    return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [json.dumps(whole, sort_keys=True)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (host, wrapper, constants): one wrapper per host as JSON, and the hashes of the containers and texts that are constants of its template.

    Wrappers of batches are aligned in rounds: each task aligns about _FAN of a host's, until every host has one. So a hot host is
    split, however many pages it has. A wrapper grows with the variety of a host's elements, not with its pages, and constants are at most
    twice the containers of a page.
    """
    made = stored(pages.select("host", "html").mapInArrow(_streams, "host string, wrapper string, place long, core long, kept long"))
    now = made.where("wrapper is not null").select("host", "wrapper")
    before = None
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // _FAN)
        # a salt by place, as equal wrappers count each
        salted = now.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, groups))))
        now = before = stored(salted.groupBy("host", "salt").applyInPandas(_merge, "host string, wrapper string"), replaces=before)
        if groups <= 1:
            break
    by_core = made.where("place is not null").groupBy("host", "place", "core").agg(F.max("kept").alias("kept"))
    counted = stored(by_core.groupBy("host", "place").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("place < 0 or (n > 1 and kept = 0)"))
    n_pages = counted.where("place < 0").select("host", (-1 - F.col("place")).alias("explicit"), F.col("n").alias("pages"))
    same = counted.where("place >= 0").withColumn("explicit", F.col("place").bitwiseAND(F.lit(1))).join(n_pages, ["host", "explicit"]).where(F.col("n") > _SAME_SHARE * F.col("pages"))
    constants = same.groupBy("host").agg(F.collect_list("place").alias("constants"))
    return stored(now.join(constants, "host", "left"), replaces=before)


@lru_cache(maxsize=256)
def _parsed(wrapper: str | None, constants: tuple[int, ...]) -> tuple[dict[str, str], frozenset[int]]:
    return slots(json.loads(wrapper)) if wrapper else {}, frozenset(constants)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages, read through the wrappers of their hosts (inferred from pages if not given).

    Null or empty html gives an empty text; a null url is a host of its own; repeated rows give repeated rows; an empty table gives an
    empty result; malformed and very long html is read whole; other columns are ignored. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by one space. Texts that the wrapper of the host has no slot for are not read.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", _host(F.col("url")))
    known = wrappers if wrappers is not None else infer_wrappers(own)

    def texts(batch: pa.RecordBatch, of: Iterator[tuple[str | None, tuple[int, ...]]]) -> pa.RecordBatch:
        out = [read(blocks(page or ""), *_parsed(*w)) for page, w in zip(batch.column(2).to_pylist(), of, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    length = known.agg(F.sum(F.length("wrapper") + F.length("host") + 20 * F.coalesce(F.size("constants"), F.lit(0)))).first()[0] or 0
    if length <= MAX_SENT_BYTES:
        sent = own.sparkSession.sparkContext.broadcast({r.host: (r.wrapper, tuple(r.constants or ())) for r in known.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield texts(batch, (sent.value.get(h, (None, ())) for h in batch.column(3).to_pylist()))

        return own.select("page_id", "url", "html", "host").mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield texts(batch, ((w, tuple(c or ())) for w, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)))

    sizes = stored(own.groupBy("host").agg(F.sum(1 + F.coalesce(F.length("html"), F.lit(0))).alias("n")))
    joined = spread_join(own, known, "host", sizes, F.concat_ws(" ", "page_id", F.xxhash64("html")), "left")
    return joined.select("page_id", "url", "html", "wrapper", "constants").mapInArrow(run_joined, schema)
