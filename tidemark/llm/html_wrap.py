"""Main text of web pages by wrapper inference.

Pages of one host share a template. A wrapper, a union-free regular
expression over markup, is inferred from all of them: each page's token stream
is nested into elements; equal neighbours fold into a repeated group; then
pages are aligned one after another, and what does not match becomes an
optional element, a repeated group or a text slot. Each task aligns the pages
it reads, host by host; the partial wrappers of a host are aligned in turn, in
salted groups first, so that no task holds the pages of a large host. A text
place keeps the texts that all pages so far share there (template) and how
much text it held (data).

The data region of a host is found in its wrapper: from the root down, the
element that holds the varying text outside links. Names only weigh there:
elements that tag or role marks as menus and the like count nothing, those that
a class marks a fifth, article and main decide between an element and those
around it. A page is read in that region. Where the host has fewer than
`LEAST_PAGES` pages that differ in elements or text, its pages have nothing to vary from, or
the region is empty on the page, the page's own article and main elements are
read, else the whole page without blocks that are mostly links.

Blocks are written in page order, without elements within the region that are
menus, site headers, footers, sidebars, notices, adverts, forms, comments or
code by tag, role or class. No text is dropped for being the same on other
pages. An element that only a class marks stays where it holds more than half of the
region's running text, unless it is about comments.

Character references are decoded, white space within a block becomes one
space, blocks are joined by a line feed. Null html is empty; a page without
main text gives an empty text. A null or odd url has the host "". Repeated
rows give repeated results, extra columns are ignored, an empty table gives
no rows. Html of any length is read whole.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, staged
from .exact_dedup import bits_for, cell_bitmaps, with_maybe

#: Regions up to so many bytes in all are broadcast; more join by host.
BROADCAST_BYTES = 32_000_000
#: Different pages from which a host's wrapper tells data from template.
LEAST_PAGES = 3
#: Hosts a task holds wrappers of; children of an element beyond which its irregular order folds; salts.
MOST_HOSTS, MOST_KIDS, SALTS = 2000, 48, 64
#: Elements nested deeper become neighbours, as in browsers.
DEEPEST = 150

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SKIP = frozenset("head nav footer aside form button select option menu dialog object canvas video audio label input fieldset".split())
ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert alertdialog".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side aside rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer foot share sharing social follow comment comments commentlist disqus reply replies respond discussion related recommended newsletter subscribe subscription signup login paywall search pagination pager toolbar skip".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-hidden|hidden|itemprop|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Names that say what an element has around it, not what it is.
MODIFIER = re.compile(r"(?<!\S)(?:with|without|has|no)-\S+")
ABOUT_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
HEADINGS = frozenset("h1 h2 h3".split())


class Node:
    """An element: its tag with class, its attributes, and children (elements and texts)."""

    __slots__ = ("tag", "sig", "skip", "named", "talk", "main", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.skip, self.main = tag, [], tag in SKIP, tag in ("article", "main")
        self.sig, self.named, self.talk = tag, False, False
        if attributes and ("=" in attributes or "hidden" in attributes):
            found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            self.sig = f"{tag}.{names.split()[0]}" if names.strip() else tag
            words = {w.lower() for w in NAME.findall(MODIFIER.sub("", names))}
            self.talk = bool(words & ABOUT_COMMENTS)
            self.skip |= found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
            self.named = not self.skip and bool(words & MARKS)
            self.skip |= self.named
            if found.get("role") == "main" or found.get("itemprop") == "articleBody":
                self.main = True
            if tag in ("body", "html"):
                self.skip = False


def parse(page: str) -> Node:
    """The tree of a page; broken markup closes as browsers close it, roughly."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if page[m.start()] != "<" or m[0] == "<":
                stack[-1].kids.append(m[0])
            elif m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            stack[-1].kids.append("\n" if tag in ("br", "hr") else " " if tag == "wbr" else "")
            continue
        attributes = m[3] or m[6] or ""
        if tag in ("html", "body") and len(stack) == 1:
            continue
        if tag in BLOCK and tag not in ("li", "dt", "dd"):
            close_p(stack)
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "menu", "article", "section", "div"):
                    break
        if len(stack) >= DEEPEST:
            stack.pop()
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if not attributes.endswith("/"):
            stack.append(node)
    return root


def close_p(stack: list[Node]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == "p":
            del stack[k:]
            return
        if stack[k].tag in BLOCK:
            return


# ---- wrappers ------------------------------------------------------------------------------------------------------


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def shape(node: Node) -> dict:
    """A page as the first wrapper. Elements: s signature, k elements and texts in
    order, n repeated, o optional, x marked by class (1) or by tag or role (2), a
    article or main. Texts: f the texts that all pages with that place share there
    with their lengths, v whether any varies, c characters, l those in links, m pages."""
    kids: list[dict] = []
    text: list[str] = []
    links = [0]

    def flush() -> None:
        if words := plain("".join(text)):
            kids.append({"s": "#", "f": {f"{crc32(words.encode('utf-8', 'replace')):x}.{len(words)}": words if len(words) < 40 else words[:39] + "…"}, "c": len(words), "l": min(links[0], len(words)), "m": 1})
        text.clear()
        links[0] = 0

    def walk(node: Node, link: bool) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                text.append(kid)
                links[0] += len(kid) if link else 0
            elif kid.tag in BLOCK:
                flush()
                kids.append(shape(kid))
            else:
                walk(kid, link or kid.tag == "a")

    walk(node, False)
    flush()
    marks = {"x": 1 if node.named else 2} if node.skip else {}
    return {"s": node.sig, "k": folded(kids)} | marks | ({"a": 1} if node.main else {})


def folded(kids: list[dict]) -> list[dict]:
    """Equal neighbours as repeated groups; children in ever new order as one group for each signature."""
    out: list[dict] = []
    for kid in kids:
        if out and kid["s"] == out[-1]["s"] != "#":
            out[-1] = unify(out[-1], kid, repeated=True)
        else:
            out.append(kid)
    if len(out) <= MOST_KIDS:
        return out
    by_sig: dict[str, dict] = {}
    for kid in out:
        by_sig[kid["s"]] = unify(by_sig[kid["s"]], kid, repeated=True) if kid["s"] in by_sig else kid
    return [k | {"n": 1} if k["s"] != "#" else k for k in by_sig.values()]


def unify(a: dict, b: dict, repeated: bool = False) -> dict:
    """The wrapper of two aligned elements: of two pages, or `repeated` within one."""
    flags = {f: max(a.get(f, 0), b.get(f, 0)) for f in ("o", "n", "x", "a", "v") if a.get(f) or b.get(f)}
    if a["s"] == "#":
        if repeated:
            shared, many = a["f"] | b["f"], max(a["m"], b["m"])
        else:
            shared, many = {k: t for k, t in a["f"].items() if k in b["f"]}, a["m"] + b["m"]
        if len(shared) < max(len(a["f"]), len(b["f"])) or repeated and len(shared) > 1:
            flags["v"] = 1
        return {"s": "#", "f": shared, "c": a["c"] + b["c"], "l": a["l"] + b["l"], "m": many} | flags
    left, right = a["k"], b["k"]
    out: list[dict] = []
    for op, i, j, k, m in SequenceMatcher(None, [x["s"] for x in left], [x["s"] for x in right], autojunk=False).get_opcodes():
        if op == "equal":
            out += [unify(x, y, repeated) for x, y in zip(left[i:j], right[k:m])]
        else:
            out += [x | {"o": 1} for x in (*left[i:j], *right[k:m])]
    return {"s": a["s"], "k": folded(out)} | flags | ({"n": 1} if repeated else {})


def joined(a: dict | None, b: dict) -> dict:
    """Two partial wrappers of a host, as {"pages": pages that differ, "w": wrapper}."""
    if not a or not a["pages"]:
        return b
    return {"pages": a["pages"] + b["pages"], "w": unify(a["w"], b["w"])} if b["pages"] else a


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages of one host, and how many differ in elements or text."""
    made, seen = {"pages": 0, "w": {"s": "html", "k": []}}, set()
    for page in pages:
        made = with_page(made, page, seen)
    return made


def with_page(made: dict, page: str, seen: set[int]) -> dict:
    nested = shape(parse(page))
    key = hash(json.dumps(nested))
    if key in seen:
        return made
    seen.add(key)
    return joined(made, {"pages": 1, "w": nested})


def expression(wrapper: dict) -> str:
    """The wrapper in the usual notation."""
    if wrapper["s"] == "#":
        body = "#text" if wrapper.get("v") or len(wrapper["f"]) != 1 else repr(next(iter(wrapper["f"].values())))
    else:
        body = f"<{wrapper['s']}>{''.join(map(expression, wrapper['k']))}</{wrapper['s'].split('.')[0]}>"
    return f"({body})+" if wrapper.get("n") else f"({body})?" if wrapper.get("o") else body


def varying(w: dict) -> float:
    """Characters of running text that are not the same on all pages, as the names weigh them."""
    if w["s"] == "#":
        fixed = w["m"] * sum(int(k.rsplit(".", 1)[1]) for k in w["f"]) if w["m"] > 1 else 0
        return max(0, w["c"] - fixed) * max(0.0, 1 - w["l"] / max(w["c"], 1))
    return (1.0, 0.2, 0.0)[w.get("x", 0)] * sum(map(varying, w["k"]))


def main_path(wrapper: dict) -> list[str] | None:
    """Signatures down to the data region; none where nothing varies enough to tell."""
    here, path, named = wrapper["w"], [], 0
    if wrapper["pages"] < LEAST_PAGES or not varying(here):
        return None
    while True:
        kids = [k for k in here["k"] if k["s"] != "#"]
        best = max(kids, key=varying, default=None)
        if best is None or best.get("n") or varying(best) < 0.8 * sum(map(varying, here["k"])) or best["s"].split(".")[0] in ("p", "li", "tr", "table", "h1", "h2", "h3"):
            break
        if any(k is not best and k["s"].split(".")[0] in HEADINGS and varying(k) for k in kids):
            break
        here = best
        path.append(here["s"])
        if here.get("a") and not named:
            named = len(path)
    if not named and sum(varying(w) for w in outermost(here)) >= 0.5 * varying(here):
        return []  # several articles, or one among other data: the page's own tags part them
    return path[:named] if named else path


def outermost(w: dict) -> Iterator[dict]:
    """The article and main elements of a wrapper."""
    for kid in w.get("k", ()):
        if kid["s"] != "#":
            yield from (kid,) if kid.get("a") else outermost(kid)


# ---- reading a page ------------------------------------------------------------------------------------------------


def running(node: Node, named: bool = False) -> int:
    """Characters of text outside links and skipped elements; `named` counts those that only a class marks."""
    return sum(len(k) if isinstance(k, str) else 0 if k.tag == "a" or k.skip and not (named and k.named and not k.talk) else running(k, named) for k in node.kids)


def regions(node: Node, named: bool = False) -> list[Node]:
    """The outermost main elements in page order; `named` looks into elements that only their class or id marks."""
    out = []
    for kid in node.kids:
        if not isinstance(kid, str) and (not kid.skip or named and kid.named):
            out += [kid] if kid.main else regions(kid, named)
    return out


def children(node: Node) -> Iterator[Node]:
    """Block elements under a node, through inline ones."""
    for kid in node.kids:
        if not isinstance(kid, str):
            if kid.tag in BLOCK:
                yield kid
            else:
                yield from children(kid)


def follow(root: Node, path: list[str]) -> list[Node]:
    """The elements of the data region on a page, in page order."""
    here = [root]
    for k, sig in enumerate(path):
        here = [kid for node in here for kid in children(node) if kid.sig == sig]
        if len(here) > 1 and k < len(path) - 1:
            here = [max(here, key=running)]
    return here


def blocks(node: Node, linked: bool = False) -> list[str]:
    """Texts of the blocks under an element; `linked` drops blocks that are mostly links."""
    out: list[str] = []
    text: list[str] = []
    links = [0, 0]
    half: list[float] = []

    def flush() -> None:
        words = plain("".join(text))
        if words and not (linked and links[1] > 0.6 * links[0]):
            out.append(words)
        text.clear()
        links[:] = [0, 0]

    def dropped(kid: Node) -> bool:
        if not kid.skip or not kid.named or kid.talk:
            return kid.skip
        if not half:
            half.append(running(node, True) / 2)
        return running(kid, True) <= half[0]

    def walk(node: Node, link: bool) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                text.append(kid)
                links[0] += len(kid)
                links[1] += len(kid) if link else 0
            elif dropped(kid):
                if kid.tag in BLOCK:
                    flush()
            elif kid.tag in BLOCK:
                flush()
                walk(kid, link)
                flush()
            else:
                if kid.tag in ("td", "th"):
                    text.append(" ")
                walk(kid, link or kid.tag == "a")

    walk(node, False)
    flush()
    return out


def extract(page: str, path: list[str] | None) -> str:
    """The main text of a page, given the path of its host's data region (none: by the page alone)."""
    root = parse(page)
    lines = [x for region in follow(root, path) for x in blocks(region)] if path else []
    if not lines:
        found = regions(root) or regions(root, True)
        lines = [x for region in found or [root] for x in blocks(region, not found)]
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def once_each(pages: DataFrame) -> DataFrame:
    """Each page of a host once, wherever its copies stand. Only pages that may have copies shuffle."""
    rows = pages.select("host", "html", F.xxhash64("host", "html").alias("_h"))
    keys = staged(rows.select(F.col("_h").alias("h")), "pages")
    bits = bits_for(keys.count())
    found = with_maybe(rows, "_h", staged(cell_bitmaps(keys, bits, 2), "bitmaps"), bits)
    again = found.where("_maybe").groupBy("host", F.unhex(F.sha2("html", 256)).alias("sha")).agg(F.first("html").alias("html"))
    return found.where("not _maybe").select("host", "html").unionByName(again.select("host", "html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper as JSON), copies of a page counting once. pages: host, html."""
    schema = "host string, salt int, pages long, wrapper string"

    def rows(made: dict[str, dict], salt: int) -> pa.RecordBatch:
        columns = [pa.array(list(made), pa.string()), pa.array([salt] * len(made), pa.int32()), pa.array([w["pages"] for w in made.values()], pa.int64()), pa.array([json.dumps(w["w"]) for w in made.values()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "salt", "pages", "wrapper"])

    def partial(batches):
        made, seen, salt = {}, {}, TaskContext.get().partitionId() % SALTS
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made[host] = with_page(made.get(host) or infer([]), page, seen.setdefault(host, set()))
            if len(made) > MOST_HOSTS:
                yield rows(made, salt)
                made, seen = {}, {}
        yield rows(made, salt)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        made = None
        for n, w in sorted(zip(part["pages"], part["wrapper"])):
            made = joined(made, {"pages": int(n), "w": json.loads(w)})
        return pd.DataFrame({"host": [part["host"].iloc[0]], "salt": [0], "pages": [made["pages"]], "wrapper": [json.dumps(made["w"])]})

    some = once_each(pages).mapInArrow(partial, schema).groupBy("host", "salt").applyInPandas(merge, schema)
    return staged(some.groupBy("host").applyInPandas(merge, schema).drop("salt"), "wrappers")


def region_paths(known: DataFrame) -> DataFrame:
    """(host, path as JSON or null) from wrappers."""

    def read(batches):
        for batch in batches:
            paths = [main_path({"pages": n, "w": json.loads(w)}) for n, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(p) if p else None for p in paths], pa.string())], names=["host", "path"])

    return staged(known.select("host", "pages", "wrapper").mapInArrow(read, "host string, path string"), "paths")


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, host, text, n_chars."""
    spark = pages.sparkSession
    ready(spark, 500)
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), host_of(pages[url]).alias("host"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    known = region_paths(wrappers(rows)).where("path is not null")
    size = known.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    if size <= broadcast_bytes:
        table = spark.sparkContext.broadcast({r["host"]: json.loads(r["path"]) for r in known.collect()})
        with_paths = rows.withColumn("path", F.lit(None).cast("string"))
    else:
        table = None
        with_paths = rows.join(known, "host", "left").select("page_id", "url", "host", "html", "path")

    def read(batches):
        for batch in batches:
            texts = []
            for host, page, own in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                texts.append(extract(page, table.value.get(host) if table is not None else own and json.loads(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "host", "text", "n_chars"])

    return with_paths.mapInArrow(read, "page_id long, url string, host string, text string, n_chars long")
