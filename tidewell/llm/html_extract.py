"""Main-text extraction with wrappers inferred from pages of one host.

A page becomes a tree of block elements whose leaves are text slots, named by their
tag and by whether they are link text. Among the children of an element, repeats of
one child or of several in a row are folded into repeated groups, whatever their
length. The distinct trees of a host, written as token streams, are aligned one after
another into a union-free regular expression: tokens that both have stay, a mismatch
becomes an optional group, a repeat on either side a repeated group. A text slot that
differs between pages is a field; one that is equal on pages that differ is template.
Streams are merged in groups of ``FAN`` and the groups' wrappers again in groups of
``FAN``, so no task holds more of a host than that.

The wrapper then chooses: beginning at the page, it goes down into the element that
holds most of the fields' text, as long as one does and leaves no heading behind. The
text of a page is what its slots in that element hold, in page order. Menus, forms,
asides, headers and hidden elements are away by their tags; an article's own header
keeps headings, and paragraphs that do not repeat. Names alone take nothing from the chosen element: what
the element itself is called is not looked at, what a part is called (comments, adverts,
menus) takes that part away, and a name that can mean anything (side, legal, notice)
only where the wrapper agrees, because the text repeats or is mostly link. Names weigh
where texts are about as long, and are not looked at on html, body, article and main.
Inside an article no text is dropped for repeating; in another element none that
stands beside fields.

Defined results: null or empty html gives an empty text; markup that is never
closed ends with the page; a url without a host belongs to the host ''. Pages
are judged row by row, so repeated rows give repeated results; an empty table
gives no rows. Nothing is cut or capped.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialize

#: Streams, or wrappers of groups of streams, that one task merges.
FAN = 32
#: Share of an element's field text that one child must hold to be gone into.
HOLDS = 0.6
#: Weight of field text in an article, and in what its tag or name calls the main part.
ARTICLE, MAIN = 10, 3
#: Weight of field text in what a name calls away: it wins only where there is hardly any other.
AWAY = 0.1

#: Element classes of HTML and the names pages give to what is not the article.
_RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas|head"
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr meta link base source track area param embed picture".split())
_LEAF_CLOSERS = frozenset("p li dt dd tr td th option".split())
_AWAY = frozenset("nav aside footer form menu dialog button fieldset header".split())
_HOME = frozenset(("article", "main"))
_PLAIN = _HOME | {"html", "body"}
_MODIFIER = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|not|with|without|hide)-\S+|\S+-(?:free|less))(?=\s|$)", re.I)
_AWAY_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|cookies?|consent|popup|modal|newsletter|subscribe|signup|login|share|sharing|related|recommend\w*|comments?|reply|replies|disqus|pagination|pager)(?:$|[\s_-])", re.I)
_ASIDE_NAME = re.compile(r"(?:^|[\s_-])(?:side|notice|alert|search|social|widget|tags|toc|legal|disclaimer|copyright)(?:$|[\s_-])", re.I)
_HOME_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|post(?:-?body|-?content)?|entry(?:-?content)?|story(?:-?body)?|main(?:-?content)?|content)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_BLOCK = re.compile(r"(?:p|h[1-6]|li|blockquote|pre|dt|dd|td)[#@]")
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>", re.S | re.I)
_NAME = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@lru_cache(maxsize=4096)
def _called(name: str) -> tuple[bool, bool, bool]:
    """Whether a name says away, perhaps away, the main part."""
    name = _MODIFIER.sub("", name)
    return bool(_AWAY_NAME.search(name)), bool(_ASIDE_NAME.search(name)), bool(_HOME_NAME.search(name))


def parse(page: str | None) -> tuple[list[list], list[tuple[int, str]]]:
    """(nodes, blocks): the folded token stream, and each text with the node it fills.

    A node is [symbol, opens, closes]: groups that start and end at it."""
    texts: list[str] = []
    stack: list[tuple[str, str, list]] = [("", "0", [])]  # tag, place, folded children
    inner: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(inner)).split())
        if text:
            tag, place, children = stack[-1]
            if place == "h":  # an article's header: its headings, and paragraphs where the wrapper agrees
                place = "1" if tag[:1] == "h" and tag[1:].isdigit() else "4" if tag == "p" else "2"
            sym = f"{tag}{'@' if 2 * linked > len(text) else '#'}{place}"
            children.append((sym, [[sym, 0, 0, [len(texts)]]]))
            texts.append(text)
        inner.clear()
        linked = 0

    def shut() -> None:
        tag, place, children = stack.pop()
        children = _folded(children)
        if len(children) == 1 and len(children[0][1]) == 1 and tag not in _PLAIN and children[0][1][0][0].startswith((tag + "#", tag + "@")):
            stack[-1][2].append(children[0])
            return
        sym = tag + (":" + place if place != "0" else "")
        tokens = [[sym, 0, 0, []], *(t for _, own in children for t in own), ["/", 0, 0, []]]
        stack[-1][2].append((" ".join((sym, *(s for s, _ in children), "/")), tokens))

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            shut()
        shut()

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            inner.append(page[at : m.start()])
            linked += link and m.start() - at
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, attr = m["end"] or m["end2"], m["attr"] or ""
        if tag in _INLINE:
            if tag == "a":
                link = 0 if end else 1
            elif tag == "br":
                inner.append(" ")
            continue
        flush()
        link = 0
        if end:
            if any(t[0] == tag for t in stack):
                close(tag)
            continue
        if tag in ("hr",) or attr.endswith("/") and tag not in ("p", "div", "article", "section"):
            continue
        if tag in _LEAF_CLOSERS and any(t[0] == tag for t in stack):
            depth = max(i for i, t in enumerate(stack) if t[0] == tag)
            if not any(t[0] in ("ul", "ol", "dl", "table", "div", "section", "article", "blockquote") for t in stack[depth + 1 :]):
                close(tag)
        elif stack[-1][0] == "p":
            close("p")
        name = " ".join(a or b or c for a, b, c in _NAME.findall(attr)) if attr and tag not in _PLAIN else ""
        place = stack[-1][1]
        if place != "2":
            if tag == "header" and place == "1":
                place = "h"
            elif tag in _AWAY or attr and _HIDDEN.search(attr):
                place = "2"
            elif place != "3":
                away, aside, main = _called(name) if name else (False, False, False)
                if away or aside:
                    place = "3" if away and not main else "4"
                elif tag in _HOME or main and place == "0":
                    place = "1"
        stack.append((tag, place, []))
    if at < len(page):
        inner.append(page[at:])
    flush()
    while len(stack) > 1:
        shut()
    nodes = [t for _, own in _folded(stack[0][2]) for t in own]
    of = {p: k for k, node in enumerate(nodes) for p in node[3]}
    return [x[:3] for x in nodes], [(of[p], text) for p, text in enumerate(texts)]


def _folded(children: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """An element's children with every repeat of one or of several in a row as one repeated group."""
    unit, ids = 1, None
    while 2 * unit <= len(children):
        if ids is None:  # the children have changed
            code: dict[str, int] = {}
            ids = np.array([code.setdefault(s, len(code)) for s, _ in children])
            once = np.flatnonzero(np.bincount(ids)[ids] == 1)
            longest = int(np.diff(np.concatenate([[-1], once, [len(ids)]])).max()) - 1
        if 2 * unit > longest:  # a symbol that occurs once is in no repeat
            break
        equal = ids[:-unit] == ids[unit:]
        if np.count_nonzero(equal) < unit:
            unit += 1
            continue
        same = np.concatenate([[0], np.cumsum(equal)])
        hits = np.flatnonzero(same[unit:] - same[:-unit] == unit)
        out, at = [], 0
        for start in hits.tolist():
            if start < at:
                continue
            out += children[at:start]
            stop = start + unit
            group = [(s, [[t[0], t[1], t[2], list(t[3])] for t in own]) for s, own in children[start:stop]]
            while stop + unit <= len(children) and (ids[start : start + unit] == ids[stop : stop + unit]).all():
                for (_, mine), (_, other) in zip(group, children[stop : stop + unit], strict=True):
                    for x, y in zip(mine, other, strict=True):
                        x[3] += y[3]
                stop += unit
            first, last = group[0][1][0], group[-1][1][-1]
            if not (first[1] and last[2] and unit == 1):
                first[1] += 1
                last[2] += 1
                group[0] = ("(" + group[0][0], group[0][1])
                group[-1] = (group[-1][0] + ")+", group[-1][1])
            out += group
            at = stop
        if at:
            children, ids = out + children[at:], None
        unit += 1
    return children


def spell(nodes: list[list]) -> str:
    """The stream as a regular expression, one symbol a word."""
    return " ".join("(" * x[1] + x[0] + ")+" * x[2] for x in nodes)


def read(text: str) -> list[list]:
    """The nodes of a spelled stream."""
    out = []
    for word in text.split():
        body = word.lstrip("(")
        opens = len(word) - len(body)
        bare = body.rstrip("+)")
        out.append([bare, opens, body.count(")+")])
    return out


def align(wrapper: list[dict], other: list[dict]) -> list[dict]:
    """One expression that covers both: common tokens joined, the rest optional."""
    if not wrapper:
        return other
    out: list[dict] = []
    same = SequenceMatcher(None, [x["sym"] for x in wrapper], [x["sym"] for x in other], autojunk=False)
    for kind, a, b, c, d in same.get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[a:b], other[c:d], strict=True):
                joined = {k: _JOINS[k](v, y[k]) for k, v in x.items() if k in _JOINS}
                if x["chars"] == 0 or y["chars"] == 0:  # one of them holds no text
                    full = x if x["chars"] else y
                    joined |= {k: full[k] for k in ("low", "high", "first", "last")}
                out.append({"sym": x["sym"], **joined})
        else:
            out += [x | {"optional": True} for x in (*wrapper[a:b], *other[c:d])]
    return out


#: What is known of a token: groups, whether it can be absent, hashes of its texts and of the pages that have it, code points.
_JOINS = {"opens": max, "closes": max, "optional": max, "low": min, "high": max, "first": min, "last": max, "chars": int.__add__}


def express(wrapper: list[dict]) -> str:
    """The wrapper for reading: ( )? optional, ( )+ repeated, # and @ text slots."""
    return " ".join(("(" * x["opens"] + x["sym"] + ")+" * x["closes"]) + ("?" if x["optional"] else "") for x in wrapper)


def kept_slots(nodes: list[str], wrapper: list[dict]) -> list[bool]:
    """Which nodes of a stream hold the article, by its host's wrapper."""
    known: list[dict | None] = [None] * len(nodes)
    for kind, a, b, c, _ in SequenceMatcher(None, [x["sym"] for x in wrapper], nodes, autojunk=False).get_opcodes():
        if kind == "equal":
            known[c : c + b - a] = wrapper[a:b]
    slot = ["#" in s or "@" in s for s in nodes]
    template = [w is not None and w["chars"] > 0 and w["low"] == w["high"] and w["first"] != w["last"] for w in known]
    # Elements: their place among the nodes, parent, end, and the weighted text of the fields they hold.
    parent, end, mass, open_at = [-1] * len(nodes), [len(nodes)] * len(nodes), [0.0] * (len(nodes) + 1), []
    heading: list[int] = []
    fielded: set[int] = set()  # elements with a field among their own children
    for k, s in enumerate(nodes):
        if s == "/":
            end[open_at.pop()] = k
            continue
        parent[k] = open_at[-1] if open_at else -1
        if not slot[k]:
            open_at.append(k)
        elif "#" in s and s[-1] != "2" and not template[k]:
            mark = s[-1]
            weight = AWAY if mark == "3" else 1 if mark == "4" else ARTICLE if any(nodes[i].startswith("article") for i in open_at) else MAIN if mark == "1" else 1
            mass[-1] += weight * (known[k]["chars"] if known[k] else 1)
            for i in open_at:
                mass[i] += weight * (known[k]["chars"] if known[k] else 1)
            if mark != "3":
                fielded.add(parent[k])
                if s[0] == "h" and s[1:2].isdigit():
                    heading.append(k)
    here = -1
    while mass[here] > 0 and not (here >= 0 and nodes[here].startswith("article")):
        inside = [k for k in range(len(nodes)) if parent[k] == here and not slot[k] and nodes[k] != "/" and not nodes[k].endswith(":2")]
        best = max(inside, key=lambda k: mass[k], default=None)
        start, stop = (here, end[here]) if here >= 0 else (-1, len(nodes))
        if best is None or mass[best] < HOLDS * mass[here] or any(start < k < stop and not best < k < end[best] for k in heading):
            break
        here = best
    start, stop = (here, end[here]) if here >= 0 else (-1, len(nodes))
    tag, _, own = nodes[here].partition(":") if here >= 0 else ("", "", "")
    home, whole = tag in _HOME, tag in ("", "html", "body")

    def holds(k: int) -> bool:
        s = nodes[k]
        mark = "0" if s[-1] == own else s[-1]  # what the chosen element is called says nothing of its parts
        if mark in ("2", "3"):
            return False
        if mark == "4":
            return "#" in s and not template[k]
        if home or s[-1] == "1" or "#" in s and not template[k]:
            return True
        # Beside fields, in an element that is not the page, a block that repeats or is mostly link is a part of the article.
        return not whole and parent[k] in fielded and _BLOCK.match(s) is not None and ("#" in s or not template[k])

    return [slot[k] and start < k < stop and holds(k) for k in range(len(nodes))]


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


_PARSED = "struct<stream:string,blocks:array<struct<slot:int,text:string>>>"


def parsed(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    @F.arrow_udf(_PARSED)
    def tokens(column: pa.Array) -> pa.Array:
        streams, ends, slots, texts = [], [0], [], []
        for v in column:
            nodes, blocks = parse(v.as_py())
            streams.append(spell(nodes))
            slots += [k for k, _ in blocks]
            texts += [t for _, t in blocks]
            ends.append(len(slots))
        inner = pa.StructArray.from_arrays([pa.array(slots, pa.int32()), pa.array(texts, pa.string())], ["slot", "text"])
        return pa.StructArray.from_arrays([pa.array(streams, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], ["stream", "blocks"])

    return pages.withColumn("_host", host(F.col(url_col))).withColumn("_p", tokens(F.col(html_col)))


def infer_wrappers(read_pages: DataFrame) -> DataFrame:
    """(_host, _s, wrapper, keep): for each distinct stream of a host its wrapper and the slots to keep.

    ``read_pages`` is what ``parsed`` gives: ``_host`` and ``_p``."""
    page = F.xxhash64("_p.blocks").alias("page")
    filled = read_pages.select("_host", F.col("_p.stream").alias("stream"), page, F.explode_outer("_p.blocks").alias("b")).groupBy("_host", "stream", F.col("b.slot").alias("slot")).agg(
        F.min(F.xxhash64("b.text")).alias("low"), F.max(F.xxhash64("b.text")).alias("high"), F.min("page").alias("first"), F.max("page").alias("last"), F.sum(F.char_length("b.text")).alias("chars")
    )
    known = ("low", "high", "first", "last", "chars")
    streams = materialize(filled.groupBy("_host", F.xxhash64("stream").alias("_s"), "stream").agg(F.collect_list(F.struct("slot", *known)).alias("slots")), "streams")

    def merge(rows: pa.Table) -> pa.Table:
        wrapper: list[dict] = []
        for text in sorted((v.as_py() for v in rows["part"]), key=lambda t: (-len(t), t)):
            wrapper = align(wrapper, json.loads(text))
        return pa.table({"_host": rows["_host"][:1], "turn": pa.array([min(rows["turn"].to_pylist()) // FAN], pa.int64()), "part": pa.array([json.dumps(wrapper)])})

    @F.arrow_udf("string")
    def as_wrapper(stream: pa.Array, slots: pa.Array) -> pa.Array:
        out = []
        for s, filled_slots in zip(stream, slots, strict=True):
            known = {r["slot"]: r for r in filled_slots.as_py() if r["slot"] is not None}
            nodes = []
            for k, (sym, opens, closes) in enumerate(read(s.as_py())):
                nodes.append({"sym": sym, "opens": opens, "closes": closes, "optional": False, **{c: known[k][c] if k in known else 0 for c in ("low", "high", "first", "last", "chars")}})
            out.append(json.dumps(nodes))
        return pa.array(out, pa.string())

    # Distinct streams of a host are numbered; a task merges FAN of them, then FAN of those wrappers, until one is left.
    # A window a host is over distinct streams only, one long each; the parts are made after it.
    turn = (F.row_number().over(Window.partitionBy("_host").orderBy("_s")) - 1).cast("long").alias("turn")
    numbered = streams.select("_host", "_s").select("_host", "_s", turn)
    parts = streams.join(numbered, ["_host", "_s"]).select("_host", "turn", as_wrapper("stream", "slots").alias("part"))
    left = numbered.agg(F.max("turn")).first()[0] or 0
    schema = "_host string, turn long, part string"
    while True:
        parts = parts.groupBy("_host", F.floor(F.col("turn") / FAN)).applyInArrow(lambda t: merge(t), schema)
        left //= FAN
        if not left:
            break
        parts = materialize(parts, "parts")
    whole = parts.select("_host", "part")

    @F.arrow_udf("struct<wrapper:string,keep:array<boolean>>")
    def decide(stream: pa.Array, part: pa.Array) -> pa.Array:
        seen: dict[str, tuple[list[dict], str]] = {}
        keep, spelled = [], []
        for s, p in zip(stream, part, strict=True):
            key = p.as_py()
            if key not in seen:
                seen = {key: (json.loads(key), express(json.loads(key)))}
            keep.append(kept_slots([x[0] for x in read(s.as_py())], seen[key][0]))
            spelled.append(seen[key][1])
        return pa.StructArray.from_arrays([pa.array(spelled, pa.string()), pa.array(keep, pa.list_(pa.bool_()))], ["wrapper", "keep"])

    return streams.select("_host", "_s", "stream").join(whole, "_host").withColumn("_d", decide("stream", "part")).select("_host", "_s", F.col("_d.wrapper").alias("wrapper"), F.col("_d.keep").alias("keep"))


def extract(pages: DataFrame, *, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ("page_id", "url"), text_as: str = "text") -> DataFrame:
    """``keep`` columns of each page with its main text."""
    # The kept columns travel as one struct, so none of their names can clash.
    here = pages.select(F.struct(*keep).alias("_row"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    read_pages = materialize(parsed(here, "_html", "_url").drop("_url", "_html"), "pages")  # parsed once; text without markup
    wrappers = materialize(infer_wrappers(read_pages).select("_host", "_s", F.col("keep").alias("_keep")), "wrappers")
    blocks = read_pages.select("_row", "_host", F.xxhash64("_p.stream").alias("_s"), F.col("_p.blocks").alias("_b"))
    # Wrappers are unique by key, so where the join is a shuffle a hot host can be split.
    joined = blocks.join(wrappers, ["_host", "_s"], "left")
    chosen = F.transform(F.filter("_b", lambda b: F.coalesce(F.get("_keep", b["slot"]), F.lit(False))), lambda b: b["text"])
    return joined.select(*[F.col("_row")[c].alias(c) for c in keep], F.coalesce(F.array_join(chosen, "\n\n"), F.lit("")).alias(text_as))
