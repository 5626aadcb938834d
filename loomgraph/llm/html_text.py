"""HTML extraction (operator 6): wrappers of hosts by union-free regular-expression inference.

A page is a stream of tokens: its block elements as they open and close, and the texts of its blocks. A text that
nearly all pages of a host have at its path is a token of its own; any other is a slot. Streams of one host are
aligned: adjacent repeats become repeated groups, what only one side has becomes an optional group, differing texts
become a slot, and the result accepts both. Pages that differ in their slots alone have the same stream, so a
host is reduced to its distinct streams in Spark first, and these are aligned in groups and then across groups.
The texts that are left in the wrapper are the host's template; with the amount of other text at each path, they tell
which container holds the articles. Its text is then read from every page of the host, whole but for the template.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from itertools import chain
from math import isqrt

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_IDS, checkpointed, map_columns, written

#: Elements by kind. Fixed values.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ["script", "style", "template", "svg", "iframe", "textarea", "select", "title"]
CLOSES_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "main", "nav", "aside"}
#: What an element that opens closes, and within which elements.
ENDS = {name: [x for x in (({"p"} if name in CLOSES_P else set(), CONTAINERS), (SIBLINGS.get(name, set()), CONTAINERS - {"div", "section"})) if x[0]] for name in BLOCKS}
OUTSIDE = set("nav header footer aside form dialog menu button fieldset".split())
OUTSIDE_WORDS = set("nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement sponsor sponsored promo comment comments reply replies respond share sharing social related newsletter subscribe signup login breadcrumb breadcrumbs pagination pager widget popup modal disqus".split())
INSIDE_WORDS = set("article main content post entry story text body".split())

#: Tokens of a repeated group at most, and streams that are aligned in one group.
GROUP_TOKENS = 8
STREAMS = 64
#: None: wrappers of any length are aligned exactly. A caller may set a bound for the product of two lengths: beyond it, what
#: they have between their equal ends becomes optional on both sides, and no text leaves the wrapper.
CELLS: int | None = None

#: Elements below each other at most, as in browsers; deeper ones are read as part of the last one.
DEPTH = 512

#: Labels that a worker keeps, so that it doesn't make them again for each page, and the longest attributes kept with them.
KEPT, KEPT_LENGTH = 4096, 2000

#: Different pages with a path that tell a template text from others, at least, and hundredths of them that have it.
TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 90
#: Hundredths of the differing text that an element holds which is never outside, whatever its name and words.
HOLDS_MOST = 80

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
#: Text and a tag with neither `<` nor `>` in its quotes. A try that fails ends at the tag's next `<`.
_PLAIN = re.compile(r"""([^<]*+)<(/?)([a-zA-Z][a-zA-Z0-9]*+)([^<>"']*+(?:(?:"[^<>"]*+"|'[^<>']*+')[^<>"']*+)*+)>""")
_INSIDE = re.compile("[^>\"']*")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def label(name: str, rest: str) -> str:
    """Name and marking words of an element, without numbers, so that a host's pages agree."""
    marks = {w for m in _ATTRIBUTE.finditer(rest) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w} if rest else ()
    return ".".join([name, *sorted(marks)])


_kept_label = lru_cache(KEPT)(label)


@lru_cache(KEPT)
def outside(mark: str) -> bool:
    name, *words = mark.split(".")
    return name not in ("html", "body") and (name in OUTSIDE or not OUTSIDE_WORDS.isdisjoint(words))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("#", text, "") | ("<" or ">", name, attributes) of a page, in one pass of linear time; comments and raw elements are left out.

    A tag ends at the first `>` outside quotes; where a quote is never closed, at the first `>`; where there is none,
    what is left is text.
    """
    at, n = 0, len(page)
    outside: list[tuple[int, int]] = []  # of the tag that lacked a quote's end: its stretches outside quotes, which all lack it
    while at < n:
        if m := _PLAIN.match(page, at):
            text, closes, name, rest = m.groups()
            if text:
                yield "#", text, ""
            name, at = name.lower(), m.end()
            if name in _RAW_END and not closes:
                close = _RAW_END[name].search(page, at)
                at = close.end() if close else n
                continue
            yield ">" if closes else "<", name, rest
            continue
        start = page.find("<", at)
        if start < 0:
            yield "#", page[at:], ""
            return
        if start > at:
            yield "#", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, start + 1)
        if not m and page[start + 1 : start + 2] not in ("!", "?", "/"):
            yield "#", "<", ""
            at = start + 1
            continue
        if page.find(">", start) < 0:
            yield "#", page[start:], ""
            return
        if not m:
            at = page.find(">", start) + 1
            continue
        while outside and outside[0][1] <= start:
            outside.pop(0)
        k, end, seen = m.end(), -1, []
        if not (outside and outside[0][0] <= start):
            while True:
                stop = _INSIDE.match(page, k).end()
                seen.append((k, stop))
                if stop >= n:
                    break
                if page[stop] == ">":
                    end = stop
                    break
                k = page.find(page[stop], stop + 1) + 1
                if not k:
                    break
        if end < 0:
            outside = outside or seen
            end = page.find(">", m.end())
        name = m[2].lower()
        at = end + 1
        if name in _RAW_END and not m[1]:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else n
            continue
        yield ">" if m[1] else "<", name, page[m.end() : end]


def events(page: str) -> Iterator[tuple[str, tuple[str, ...], str, bool]]:
    """("<" | ">" | "#", path of labels, text, whether in a link) of a page; unclosed elements end where they must."""
    paths: list[tuple[str, ...]] = [()]
    names: list[str] = []
    deeper: Counter = Counter()
    link = 0
    for kind, name, rest in tokens(page):
        if kind == "#":
            yield "#", paths[-1], name, link > 0
            continue
        if name not in BLOCKS:
            if name == "a":
                link = 0 if kind == ">" else 1
            elif name in VOID:
                yield "#", paths[-1], " ", False
            continue
        if kind == ">":
            if deeper[name]:
                deeper[name] -= 1
                yield "#", paths[-1], " ", False
            elif name in names:
                while True:
                    link = 0
                    yield ">", paths.pop(), "", False
                    if names.pop() == name:
                        break
            continue
        for closed, bounds in ENDS[name]:
            k = len(names) - 1
            while k >= 0 and names[k] not in closed and names[k] not in bounds:
                k -= 1
            if k < 0 or names[k] not in closed:
                continue
            while len(names) > k:
                yield ">", paths.pop(), "", False
                names.pop()
        if len(names) >= DEPTH:
            deeper[name] += name not in VOID
            yield "#", paths[-1], " ", False
            continue
        paths.append((*paths[-1], _kept_label(name, rest) if len(rest) <= KEPT_LENGTH else label(name, rest)))
        names.append(name)
        link = 0
        yield "<", paths[-1], "", False
        if name in VOID:
            yield ">", paths.pop(), "", False
            names.pop()


def blocks(page: str) -> Iterator[tuple[str, tuple[str, ...], str, int, int]]:
    """("<" | ">" | "#", path, text, characters, characters in links): events with the runs of text between them put together.

    Texts have single spaces and no entities; blank ones are left out. Characters are counted as written.
    """
    parts: list[str] = []
    at: tuple[str, ...] = ()
    chars = links = 0
    for kind, path, text, link in chain(events(page), [(">", (), "", False)]):
        if kind == "#":
            parts.append(text)
            at = path
            n = len(text.strip())
            chars += n
            links += n * link
            continue
        if parts:
            if whole := " ".join(entities.unescape("".join(parts)).split()):
                yield "#", at, whole, chars, links
            parts, chars, links = [], 0, 0
        if path:
            yield kind, path, "", 0, 0


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace")) - 2**63


def marks(page: str) -> tuple[list[str], list[tuple[int, int, int, int]], int]:
    """A page's opened labels, `>`, and `#` for each text; of each text the hashes of its path and of both, its characters, and
    those in links; and a hash of all texts. All that the wrappers of a host need of a page, so that it is read once for them."""
    out: list[str] = []
    texts: list[tuple[int, int, int, int]] = []
    whole: list[str] = []
    hashes: dict[tuple[str, ...], int] = {}
    for kind, path, text, chars, links in blocks(page):
        if kind != "#":
            out.append(f"<{path[-1]}" if kind == "<" else ">")
            continue
        out.append("#")
        whole.append(text)
        if path not in hashes:
            hashes[path] = _hash(*path)
        texts.append((hashes[path], _hash(*path, text), chars, links))
    return out, texts, _hash(*whole)


def paths_of(marks: list[str]) -> list[tuple[str, ...]]:
    """The path of each text of a page's marks."""
    out: list[tuple[str, ...]] = []
    paths: list[tuple[str, ...]] = [()]
    for x in marks:
        if x == "#":
            out.append(paths[-1])
        elif x == ">":
            paths.pop()
        else:
            paths.append((*paths[-1], x[1:]))
    return out


def with_texts(marks: list[str], texts: list[int], frequent: Container[int]) -> list[str]:
    """marks where a text is `=` and its hash if that is frequent."""
    if not frequent:
        return marks
    each = iter(texts)
    return [f"={k}" if x == "#" and (k := next(each)) in frequent else x for x in marks]


def stream(page: str, frequent: Container[int] = ()) -> list[str]:
    """Opened labels, `>`, and for each text `=` and its hash if that is frequent, else `#`."""
    found, texts, _ = marks(page)
    return with_texts(found, [k for _, k, *_ in texts], frequent)


def folded(items: list) -> list:
    """items with adjacent repeats as ["+", group]; items are tokens, or ["+" | "?", group]."""
    size = 1
    while size <= GROUP_TOKENS:
        out, i, changed = [], 0, False
        while i < len(items):
            unit = items[i : i + size]
            k = i + size
            while len(unit) == size and items[k : k + size] == unit:
                k += size
            if k > i + size:
                group = unit[0] if size == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", unit]
                out.append(group)
                i, changed = k, True
            else:
                out.append(items[i])
                i += 1
        items = out
        size = 1 if changed and size > 1 else size + 1
    return items


def _is_text(item) -> bool:
    return isinstance(item, str) and item[0] in "#="


def _key(item) -> str:
    return json.dumps(item[1] if isinstance(item, list) else [item])


def _with_groups(items: list, groups: list[list]) -> list:
    """items where a group of the other side occurs in the open, once, as that group."""
    for kind, unit in groups:
        out, i = [], 0
        while i < len(items):
            if items[i : i + len(unit)] == unit:
                out.append([kind, unit])
                i += len(unit)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _common_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For i from 0 to len(a), the longest common subsequences of a[i:] and each b[j:] as bits: bit len(b) - 1 - j says whether that
    of b[j:] is one longer than that of b[j + 1:].

    A row comes from the one after it by a few operations on whole integers. Only about the square root of the rows is kept;
    those between are made again when they are asked for.
    """
    n, m = len(a), len(b)
    step = isqrt(n) + 1
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(m - 1 - j)

    def bits(at: list[int]) -> int:
        if len(at) < 4:
            return sum(1 << k for k in at)
        out = bytearray(m // 8 + 1)
        for k in at:
            out[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(out, "little")

    many = {x: bits(at) for x, at in places.items() if len(at) * len(at) > m}  # fewer than the square root of m
    whole = (1 << m) - 1

    def before(row: int, x: str) -> int:
        if x not in places:
            return row
        same = row & (many[x] if x in many else bits(places[x]))
        return ((row + same) | (row - same)) & whole

    row, kept = whole, {n: whole}
    for i in range(n - 1, -1, -1):
        row = before(row, a[i])
        if i % step == 0:
            kept[i] = row
    for start in range(0, n, step):
        end = min(start + step, n)
        block = [kept[end]]
        for i in range(end - 1, start - 1, -1):
            block.append(before(block[-1], a[i]))
        yield from (whole ^ r for r in block[:0:-1])
    yield 0


def aligned(a: list, b: list) -> list:
    """A wrapper that accepts what either of two wrappers accepts; texts that differ at one place become a slot, but a text that
    nearly all pages have stays beside the few that have another there."""
    if a == b:
        return a
    groups = lambda x: [i for i in x if isinstance(i, list)]
    a, b = _with_groups(a, groups(b)), _with_groups(b, groups(a))
    ka, kb = list(map(_key, a)), list(map(_key, b))
    if CELLS is not None and len(a) * len(b) > CELLS:
        return folded(_ends_aligned(a, b, ka, kb))
    rows = _common_rows(ka, kb)
    row, below = next(rows), next(rows, 0)
    whole = (1 << len(b)) - 1
    out: list = []
    i = j = 0

    def common(r: int, k: int) -> int:
        """Length of the longest common subsequence of a row's part of a and b[k:]."""
        return (r & whole >> k).bit_count()

    def optional(part: list) -> None:
        for x in part:
            out.append(x if isinstance(x, list) and x[0] == "?" else ["?", [x]])

    while i < len(a) and j < len(b):
        if ka[i] == kb[j]:
            kinds = {x[0] for x in (a[i], b[j]) if isinstance(x, list)}
            unit = json.loads(ka[i])
            out.append(["?", unit] if "?" in kinds else ["+", unit] if kinds else a[i])
            down, right = 1, 1
        elif _is_text(a[i]) and _is_text(b[j]) and common(below, j + 1) == common(row, j):
            shared = [x for x in (a[i], b[j]) if x[0] == "="]
            out.append(shared[0] if len(shared) == 1 else "#")
            down, right = 1, 1
        elif common(below, j) >= common(row, j + 1):
            optional([a[i]])
            down, right = 1, 0
        else:
            optional([b[j]])
            down, right = 0, 1
        i, j = i + down, j + right
        if down:
            row, below = below, next(rows, 0)
    optional(a[i:])
    optional(b[j:])
    return folded(out)


def _ends_aligned(a: list, b: list, ka: list[str], kb: list[str]) -> list:
    """aligned() of wrappers beyond a bound: only what they share at both ends."""
    n = min(len(a), len(b))
    start = next((i for i in range(n) if ka[i] != kb[i]), n)
    end = next((i for i in range(n - start) if ka[-1 - i] != kb[-1 - i]), n - start)
    looser = [y if isinstance(y, list) and (y[0] == "?" or not isinstance(x, list)) else x for x, y in ((a[i], b[i]) for i in [*range(start), *range(-end, 0)])]
    optional = [x if isinstance(x, list) and x[0] == "?" else ["?", [x]] for x in (*a[start : len(a) - end], *b[start : len(b) - end])]
    return looser[:start] + optional + looser[start:]


def wrapper_of(streams: list[str]) -> str:
    """The wrapper of folded streams as JSON, in the order of their text, longest first."""
    out: list | None = None
    for s in sorted(set(streams), key=lambda x: (-len(x), x)):
        out = json.loads(s) if out is None else aligned(out, json.loads(s))
    return json.dumps(out or [])


def slots_of(paths: list, texts: list[tuple[int, int, int]], frequent: Container[int] = ()) -> dict[tuple, list[int]]:
    """Of each path with text, and each frequent text there (else 0): characters, and those in links; texts are (hash, characters,
    those in links) in the order of their paths."""
    found: dict[tuple, list[int]] = {}
    for path, (k, chars, links) in zip(paths, texts, strict=True):
        x = found.setdefault((path, k if k in frequent else 0), [0, 0])
        x[0] += chars
        x[1] += links
    return found


def _slots(page: str, frequent: Container[int] = ()) -> dict[tuple[tuple[str, ...], int], list[int]]:
    found, texts, _ = marks(page)
    return slots_of(paths_of(found), [x[1:] for x in texts], frequent)


def template_texts(wrapper: str) -> set[int]:
    """Hashes of the texts of a wrapper, those of its groups included."""

    def walk(items: list) -> Iterator[int]:
        for x in items:
            if isinstance(x, list):
                yield from walk(x[1])
            elif x[0] == "=":
                yield int(x[1:])

    return set(walk(json.loads(wrapper)))


def _below(slots: dict[tuple[str, ...], list[int]]) -> Counter:
    """Characters below each element, where those in links count against the others."""
    out: Counter = Counter()
    for path, (chars, links) in slots.items():
        for k in range(1, len(path) + 1):
            out[path[:k]] += max(0, chars - 2 * links)
    return out


def main_container(slots: dict[tuple[str, ...], list[int]]) -> tuple[str, ...]:
    """The path of the container of articles: an article or main element, or an element marked as content, with most
    text; else the deepest container with most of the text that is neither outside nor links. An element that holds
    nearly all of the text is not outside."""
    every = _below(slots)
    least = HOLDS_MOST * sum(max(0, chars - 2 * links) for chars, links in slots.values())
    good = _below({p: x for p, x in slots.items() if not any(outside(p[k]) and not 100 * every[p[: k + 1]] >= least > 0 for k in range(len(p)))})
    if not good:
        return ()
    for names in ({"article"}, {"main"}):
        if found := [p for p in good if p[-1].split(".")[0] in names and not any(x.split(".")[0] in names for x in p[:-1])]:
            return max(found, key=lambda p: (good[p], p))
    total = max(good.values())
    marked = [p for p in good if p[-1].split(".")[0] in ("div", "section") and not INSIDE_WORDS.isdisjoint(p[-1].split(".")[1:]) and 2 * good[p] >= total]
    if marked:
        return max(marked, key=lambda p: (len(p), p))
    deep = [p for p in good if p[-1].split(".")[0] in CONTAINERS and 10 * good[p] >= 6 * total]
    return max(deep, key=lambda p: (len(p), p)) if deep else ()


def told(path: tuple[str, ...]) -> bool:
    """Whether an element says by its name or words that it is the article: then all text in it is, but for elements that are outside."""
    name, *words = path[-1].split(".") if path else ("",)
    return name in ("article", "main") or name in ("div", "section") and not INSIDE_WORDS.isdisjoint(words)


def host_container(slots: dict[tuple[tuple[str, ...], int], list[int]], wrapper: str) -> tuple[tuple[str, ...], list[int]]:
    """The container of a host, by its differing text alone, and the template texts that may be cut off at its ends.

    A container that says that it is the article has none: a heading or a closing line that all articles have is theirs. Where most of
    the container's text is template, its pages are copies of each other: then all text is content.
    """
    template = template_texts(wrapper)
    every: dict[tuple[str, ...], list[int]] = {}
    differing: dict[tuple[str, ...], list[int]] = {}
    for (path, k), x in slots.items():
        for to in (every, *([] if k in template else [differing])):
            own = to.setdefault(path, [0, 0])
            own[0] += x[0]
            own[1] += x[1]
    found = main_container(differing)
    n = len(found)
    inside = lambda to: sum(x[0] for p, x in to.items() if p[:n] == found and not any(map(outside, p[n:])))
    if 2 * inside(differing) < inside(every):
        return main_container(every), []
    return found, [] if told(found) else sorted(template)


def main_text(page: str | None, container: tuple[str, ...], template: Container[int] = ()) -> str:
    """Text of the blocks below a container, one a line, without the template texts before its first other text and after its
    last. A page without that container has its own looked for."""
    if not page:
        return ""
    n = len(container)
    inside = [(path, text) for kind, path, text, *_ in blocks(page) if kind == "#" and path[:n] == container and not any(map(outside, path[n:]))]
    if not inside:
        own = main_container({p: x for (p, _), x in _slots(page).items()})
        return main_text(page, own, template) if own and own != container else ""
    if template:
        own = lambda k: _hash(*inside[k][0], inside[k][1]) not in template
        first = next(filter(own, range(len(inside))), None)
        if first is not None:
            inside = inside[first : next(filter(own, range(len(inside) - 1, -1, -1))) + 1]
    return "\n".join(text for _, text in inside)


def _with_host(pages: DataFrame, hosts: DataFrame, texts_col: str) -> DataFrame:
    """pages with the columns of their host. Up to BROADCAST_IDS hosts and texts are counted and then broadcast, so that
    pages stay where they are; more of them are shuffled."""
    size = hosts.agg(F.sum(1 + F.greatest(F.size(texts_col), F.lit(0)))).first()[0] or 0
    return pages.join(F.broadcast(hosts) if size <= BROADCAST_IDS else hosts, "host", "left")


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Null and empty pages have an empty text; a null URL is of the host "". Repeated rows each get their text, and count
    again towards a slot's amount of text; other columns are ignored; an empty table gives no rows.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    # the host as SQL has it, equal to host_and_path's
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = own.withColumn("host", F.coalesce(host, F.lit("")))

    def read(hosts: list, texts: list) -> dict:
        out: dict = {"host": hosts, "page": [], "marks": [], "texts": []}
        for t in texts:
            found, own, whole = marks(t or "")
            for column, x in zip(("page", "marks", "texts"), (whole, " ".join(found), own), strict=True):
                out[column].append(x)
        return out

    # pages are read once for all that wrappers need of them; equal pages count once
    shapes = written(map_columns(own.select("host", "html"), read, "host string, page long, marks string, texts array<struct<path:bigint,text:bigint,chars:bigint,links:bigint>>"), "shapes")
    each = written(shapes.select("host", "page", F.explode("texts").alias("t")).select("host", "page", "t.path", "t.text").distinct(), "texts")
    paths = each.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    often = each.groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(100 * F.col("n") >= TEMPLATE_SHARE * TEMPLATE_PAGES).join(paths, ["host", "path"]).where(100 * F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    frequent = checkpointed(often.groupBy("host").agg(F.collect_list("text").alias("frequent")))

    def reduce(hosts: list, marks: list, texts: list, frequent: list) -> dict:
        streams, slots, sets, read, fold = [], [], {}, {}, {}
        for host, m, own, often in zip(hosts, marks, texts, frequent, strict=True):
            if host not in sets:
                sets[host] = frozenset(often or ())
            if m not in read:
                split = m.split()
                read[m] = split, list(map(json.dumps, paths_of(split)))
            found = " ".join(with_texts(read[m][0], [t["text"] for t in own], sets[host]))
            if found not in fold:
                fold[found] = json.dumps(folded(found.split()))
            streams.append(fold[found])
            slots.append([(p, k, c, n) for (p, k), (c, n) in slots_of(read[m][1], [(t["text"], t["chars"], t["links"]) for t in own], sets[host]).items()])
        return {"host": hosts, "stream": streams, "slots": slots}

    with_frequent = _with_host(shapes, frequent, "frequent").select("host", "marks", "texts", "frequent")
    seen = written(map_columns(with_frequent, reduce, "host string, stream string, slots array<struct<path:string,text:bigint,chars:bigint,links:bigint>>"), "slots")
    slots = seen.select("host", F.explode("slots").alias("s")).groupBy("host", "s.path", "s.text").agg(F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
    streams = seen.select("host", "stream").distinct()
    groups = streams.groupBy("host").agg(F.count("*").alias("n")).select("host", F.ceil(F.col("n") / STREAMS).alias("groups"))
    split = streams.join(groups, "host").withColumn("group", F.pmod(F.xxhash64("stream"), "groups"))

    def align(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": part["host"].iloc[:1], "group": part["group"].iloc[:1], "stream": [wrapper_of(part["stream"].tolist())]})

    # partial wrappers are aligned STREAMS at a time, in rounds, so that no host's streams meet in one task
    while True:
        part = checkpointed(split.groupBy("host", "group").applyInPandas(align, "host string, group long, stream string"))
        most = part.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        split = part.withColumn("group", F.floor(F.col("group") / STREAMS))
    wrappers = part.select("host", "stream")
    by_host = slots.groupBy("host").agg(F.collect_list(F.struct("path", "text", "chars", "links")).alias("slots"))

    def choose(hosts: list, wrappers: list, slots: list) -> dict:
        found = [host_container({(tuple(json.loads(s["path"])), s["text"]): [s["chars"], s["links"]] for s in x or []}, w) for w, x in zip(wrappers, slots, strict=True)]
        return {"host": hosts, "container": [json.dumps(c) for c, _ in found], "template": [t for _, t in found]}

    containers = checkpointed(map_columns(wrappers.join(by_host, "host", "left").select("host", "stream", "slots"), choose, "host string, container string, template array<bigint>"))

    def cut(ids: list, urls: list, texts: list, containers: list, templates: list) -> dict:
        out = [main_text(t, tuple(json.loads(c or "[]")), frozenset(k or ())) for t, c, k in zip(texts, containers, templates, strict=True)]
        return {"page_id": ids, "url": urls, "text": out, "n_chars": list(map(len, out))}

    joined = _with_host(own, containers, "template")
    return map_columns(joined.select("page_id", "url", "html", "container", "template"), cut, "page_id long, url string, text string, n_chars long")
