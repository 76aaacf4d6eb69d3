"""Main text of web pages through wrappers inferred per host.

A page is read as a stream of block tokens: opening and closing containers, and slots of text. A wrapper is a regular expression without unions over such tokens
that all pages of a host match. It starts as one page's stream, in which groups that repeat next to each other are folded into ``+`` groups. Every further
stream is aligned with it by a longest common subsequence; what only one side has becomes an optional group, and repeats are folded again. Equal streams of a host count
once, streams are aligned in parts of about ``PART``, and the parts' wrappers again in parts until one is left, so no task aligns many and a host may hold any share of the pages.

The wrapper tells which slots of the host are not inside an element that is furniture by its tag, or by a word of its class, id or role. Of these a page's main text are those inside an
article (else a main element, else anywhere), as far as the page itself has such an element. The text of these slots is returned, whatever it says.

Defined cases: a null html is the empty page, with empty text; a null url, or one without a host, belongs to the host ''; repeated rows and null ids stay; a page cut off in a tag ends before
it; an element left open ends with its parent; pages of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.plans.skew import spread
from tastemill.session import checkpointed

#: Comments, declarations, tags with quoted attributes, and text. A lone < is text.
PIECES = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
#: Opening one of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|login|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|replies|reply|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Streams or wrappers aligned in one part, and the longest group that is folded.
PART, LONGEST_GROUP = 64, 24


def slots(page: str) -> list[tuple[str, str]]:
    """(path, text) of every block with text, in page order. A path names the open containers; furniture is marked with !."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    words: list[str] = []

    def close_block() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append(("/".join(name for _, name in stack), text))

    at, end = 0, len(page)
    while at < end:
        m = PIECES.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith("<!") and not m[0].startswith("<?"):
                words.append(m[0])
            continue
        if not m[0].endswith(">"):
            break
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[0].endswith("/>"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        marks = "" if closing else " ".join(a or b or c for _, a, b, c in ATTRIBUTES.findall(m[3]))
        bad = tag in FURNITURE_TAGS or bool(marks and tag not in ("html", "body", "article", "main") and FURNITURE.search(marks))
        if tag in INLINE and not (bad or closing and any(t == tag for t, _ in stack)):
            if tag == "br":
                words.append(" ")
            continue
        close_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph holds no blocks
            if stack and stack[-1][0] in CLOSES.get(tag, ()):
                stack.pop()
            stack.append((tag, f"{tag}!" if bad else tag))
    close_block()
    return out


def stream(found: list[tuple[str, str]]) -> list[str]:
    """Container tokens and text slots: the paths as a walk from one to the next."""
    tokens, open_now = [], []
    for path, _ in found:
        names = path.split("/") if path else []
        outer, leaf = names[:-1], names[-1] if names else ""
        same = 0
        while same < min(len(outer), len(open_now)) and outer[same] == open_now[same]:
            same += 1
        tokens += [f"/{n}" for n in reversed(open_now[same:])] + [f"<{n}" for n in outer[same:]] + [f"#{leaf}"]
        open_now = outer
    return tokens + [f"/{n}" for n in reversed(open_now)]


def core(item) -> str:
    """What an item says, whether it is repeated or optional or neither."""
    return json.dumps(item[1] if isinstance(item, list) and len(item[1]) > 1 else item[1][0] if isinstance(item, list) else item)


def folded(items: list) -> list:
    """Neighbouring equal groups as one repeated group, the shortest groups first."""
    size = 1
    while size <= min(LONGEST_GROUP, len(items) // 2):
        keys, at, out, changed = [core(x) for x in items], 0, [], False
        while at < len(items):
            count = 1
            while keys[at : at + size] == keys[at + count * size : at + (count + 1) * size] and len(keys[at : at + size]) == size:
                count += 1
            if count > 1 and balanced(items[at : at + size]):
                group = items[at : at + size]
                out.append(["+", group[0][1] if size == 1 and isinstance(group[0], list) else group])
                at += count * size
                changed = True
            else:
                out.append(items[at])
                at += 1
        items, size = out, 1 if changed and size > 1 else size + 1
    return items


def balanced(group: list) -> bool:
    depth = 0
    for x in group:
        depth += 1 if isinstance(x, str) and x[0] == "<" else -1 if isinstance(x, str) and x[0] == "/" else 0
        if depth < 0:
            return False
    return depth == 0


def nodes(items: list) -> list[list]:
    """The items in whole elements, from an opening token to its closing one, and single items."""
    out, depth = [], 0
    for x in items:
        if depth:
            out[-1].append(x)
        else:
            out.append([x])
        depth += 1 if isinstance(x, str) and x[0] == "<" else -1 if isinstance(x, str) and x[0] == "/" else 0
    return out


def bare(node: list) -> tuple[set[str], list]:
    """Whether a node is optional or repeated, and its items without that."""
    marks = set()
    while len(node) == 1 and isinstance(node[0], list):
        marks.add(node[0][0])
        node = node[0][1]
    return marks, node


def is_element(items: list) -> bool:
    return isinstance(items[0], str) and items[0][0] == "<" and len(nodes(items)) == 1


def marked(items: list, marks: set[str]) -> list:
    for mark in "+?":
        if mark in marks:
            items = [[mark, items]]
    return items


def aligned(wrapper: list, other: list) -> list:
    """The least general of wrapper and other by alignment of whole elements: those of one name are aligned inside, and what one side alone has becomes optional groups."""
    left, right = [bare(x) for x in nodes(wrapper)], [bare(x) for x in nodes(other)]
    names = [[x[0] if is_element(x) else json.dumps(x) for _, x in side] for side in (left, right)]
    out: list = []
    for kind, a, b, c, d in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
        if kind == "equal":
            for (some, x), (more, y) in zip(left[a:b], right[c:d], strict=True):
                out += marked(x if x == y else [x[0], *aligned(x[1:-1], y[1:-1]), x[-1]], some | more)
        else:
            for marks, x in left[a:b] + right[c:d]:
                out += marked(x, marks | {"?"})
    return folded(out)


def leaves(wrapper: list, above: tuple[str, ...] = ()) -> set[str]:
    """The paths of all slots of a wrapper."""
    found, path = set(), list(above)
    for item in wrapper:
        for x in item[1] if isinstance(item, list) else [item]:
            if isinstance(x, list):
                found |= leaves([x], tuple(path))
            elif x[0] == "<":
                path.append(x[1:])
            elif x[0] == "/":
                if x[1:] in path:
                    del path[len(path) - 1 - path[::-1].index(x[1:]) :]
            else:
                found.add("/".join([*path, x[1:]] if x[1:] else path))
    return found


def good_paths(wrapper: list) -> set[str]:
    """The slots outside furniture."""
    return {p for p in leaves(wrapper) if "!" not in p}


def main_paths(good: set[str], page: set[str]) -> set[str]:
    """The slots of main text among those that a page has: a host may hold pages of several templates."""
    here = good & page
    for tag in ("article", "main"):
        if inside := {p for p in here if tag in p.split("/")}:
            return inside
    return here


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of (host, html) rows."""

    def streams(batches):
        for batch in batches:
            shapes = [json.dumps(folded(stream(slots(x or "")))) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(shapes, pa.string())], ["host", "shape"])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        wrapper: list | None = None
        for shape in sorted(part["shape"], key=lambda s: (-len(s), s)):
            wrapper = json.loads(shape) if wrapper is None else aligned(wrapper, json.loads(shape))
        return pd.DataFrame({"host": [part["host"].iloc[0]], "shape": [json.dumps(wrapper)]})

    level = checkpointed(pages.mapInArrow(streams, "host string, shape string").distinct())
    while True:
        # Hosts of more than one part are dealt anew by their shapes, about PART to a group, until each has one.
        counts = level.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
        counts = checkpointed(counts)
        if counts.isEmpty():
            return level.withColumnRenamed("shape", "wrapper")
        dealt = level.join(counts, F.col("host") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("shape"), F.expr(f"(parts + {PART - 1}) div {PART}")))
        done = level.join(counts, F.col("host") == F.col("of"), "left_anti")
        level = checkpointed(done.unionByName(dealt.groupBy("host", "part").applyInPandas(fold, "host string, shape string").distinct()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    named = pages.select("page_id", "url", "html", F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1).alias("host"))
    wrappers = infer(spread(named.select("page_id", "host", "html"), "page_id").select("host", "html")).withColumnRenamed("host", "of")

    def texts(batches):
        known: dict[str, set[str]] = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = good_paths(json.loads(wrapper))
                found = slots(page or "")
                wanted = main_paths(known[wrapper], {p for p, _ in found})
                chosen = [t for p, t in found if p in wanted]
                out.append("\n\n".join(chosen))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = named.join(wrappers, F.col("host") == F.col("of")).select("page_id", "url", "html", "wrapper")
    return spread(joined, "page_id").mapInArrow(texts, f"page_id {id_type}, url string, text string, n_chars bigint")
