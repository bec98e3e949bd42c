"""Main text of web pages by wrapper induction.

Every page of every host is parsed to a DOM tree and read as blocks: texts with the path of signatures
(tag, class and id) from the root, so like siblings share a path and pages are aligned by it. Spark counts,
over all pages of a host, the pages that have a path and the pages that have a text at a path, for the
host and for each of its layouts (the set of paths of containers). Pages with the same blocks count once, so
copies weigh as one page. A text on nearly all pages that have its path is the host's template, at that
path only; the characters of the different texts at a path, a page, are the weight of its slot.

Applied to a page, the wrapper goes down from the root into the element that holds nearly all the weight;
headings beside the path are kept and ``article`` elements beside a heavier element of another kind are teasers. ``article``
and ``main`` by their names decide only where no element holds nearly all, or where most of the page's text
lies at paths of fewer than ``LEAST_PAGES`` pages. Left out are regions of other use (by tag, role, class or id:
menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments),
blocks of links outside of ``article`` and ``main``, and the template's texts. A class or id counts only if all of its
words are known. What is left is put together block by block.

The wrappers are joined to the pages by host: broadcast if they are few, else with hot hosts spread.

Rows: one output row per page, whole html. A null html is empty; a null or unreadable url belongs to
the host ''. Broken markup is read as browsers do in the common cases: end tags implied, stray ones
ignored, open elements closed at the end; elements more than ``DEEPEST`` levels deep lie side by side in
the one at that level, with their texts. A page without text gives an empty string. Paths of fewer
than ``LEAST_PAGES`` different pages have no template texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow
from scorewright.scale import lookup_join, materialize

LEAST_PAGES = 4
CONSTANT = 0.8
HELD = 0.9
HALF = 0.5
LINKED = 0.8
#: Below the interpreter's limit on nested calls; browsers have a bound of this size, too.
DEEPEST = 400

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
LIMITS = frozenset("table ul ol dl select article main section div body html td th".split())
CONTAINERS = frozenset("html body div section article main table tbody tr td".split())
MAIN = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# What regions of other use are called.
OTHER_TAGS = frozenset(
    "nav footer aside form button select menu dialog head svg canvas object audio video fieldset".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
OTHER_NAMES = frozenset(
    "nav navbar navigation menu menubar sidebar side footer header masthead topbar toolbar ad ads advert advertisement "
    "adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert comment comments "
    "commentlist respond disqus replies share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe "
    "popup modal overlay widget login signup search pager pagination skip copyright".split()
)
# Words that go with those without changing what they say.
BESIDE_NAMES = frozenset(
    "site page main top bottom left right first last inner outer primary secondary global local list item items box bar block "
    "container wrapper wrap section area zone region column col row content text link links button buttons icon icons form "
    "post posts article articles entry story stories blog reader readers user more header title small large mobile desktop "
    "fixed sticky slot unit cell group panel pane body js ui is has the of to and in for".split()
)


def of_other_names(names: str) -> bool:
    """Do class and id name a use other than the main text?

    A name does if all its words are known and one of them says so: ``cookie-notice`` and ``site-footer``, not
    ``ad-hoc-networks`` or ``related-work``, in which a word that is not known makes another thing of it.
    """
    for name in names.split():
        parts = [part.removesuffix("s") if part not in OTHER_NAMES and part not in BESIDE_NAMES else part for part in re.split(r"[_-]+", re.sub("[0-9]+", "", name)) if part]
        if any(part in OTHER_NAMES for part in parts) and all(part in OTHER_NAMES or part in BESIDE_NAMES for part in parts):
            return True
    return False


Path = tuple[str, ...]


class Node:
    """An element: tag, signature, class and id words, role, children (elements and texts)."""

    __slots__ = ("tag", "sig", "names", "role", "hidden", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.hidden, self.children = tag, "", "", False, []
        for match in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
            name, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
            if name == "role":
                self.role = value
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                self.hidden = True
            elif name != "aria-hidden":
                self.names += f" {value}"
        self.sig = f"{tag} {re.sub('[0-9]+', 'N', self.names.strip())}".strip()


def parse(page: str) -> Node:
    """The DOM tree of a page under one ``#root`` node."""
    root = Node("#root")
    stack, tags, at = [root], [root.tag], 0  # the open elements and their tags
    while True:
        match = TAG.search(page, at)
        text = page[at : match.start()] if match else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not match:
            return root
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[depth] == tag:
                    del stack[depth:], tags[depth:]
                    break
            continue
        attributes = match[3] or match[6] or ""
        if tag in CLOSES_P:
            _close(stack, tags, ("p",))
        if tag in SIBLINGS:
            _close(stack, tags, SIBLINGS[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node if len(stack) < DEEPEST else stack[-1])
            tags.append(tag)


def _close(stack: list[Node], tags: list[str], wanted: tuple[str, ...]) -> None:
    """Close the innermost open element of the ``wanted`` tags, unless a container lies in between."""
    for depth in range(len(stack) - 1, 0, -1):
        if tags[depth] in wanted:
            del stack[depth:], tags[depth:]
            return
        if tags[depth] in LIMITS:
            return


def of_other_use(node: Node, inside: bool) -> bool:
    """Is this a region of other use? ``inside`` an article, a header may hold its title."""
    if node.tag in OTHER_TAGS or node.tag in RAW or node.hidden or node.role in OTHER_ROLES:
        return True
    if node.tag == "header" and not inside:
        return True
    return bool(node.names) and node.tag not in ("body", "html", "article", "main") and of_other_names(node.names)


def _sizes(node: Node) -> tuple[int, int, int]:
    """Characters of text, of text in links, and links."""
    chars = linked = links = 0
    for child in node.children:
        if isinstance(child, str):
            chars += len(child.strip())
        elif child.tag not in RAW:
            c, i, n = _sizes(child)
            chars, linked, links = chars + c, linked + (c if child.tag == "a" else i), links + n + (child.tag == "a")
    return chars, linked, links


def blocks(root: Node, inside: bool) -> list[tuple[Path, str]]:
    """(path, text) of the blocks below ``root`` in page order, without regions of other use."""
    found: list[tuple[Path, str]] = []
    held: list[str] = []

    def flush(path: Path) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append((path, text))

    def walk(node: Node, path: Path, inside: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif not of_other_use(child, inside):
                if child.tag not in BLOCKS:
                    walk(child, path, inside)
                    continue
                flush(path)
                if not inside and child.tag in ("ul", "ol", "div", "section", "table"):
                    chars, linked, links = _sizes(child)
                    if links >= 3 and linked >= LINKED * chars:
                        continue
                below = (*path, f"{child.role} {child.sig}" if child.role in MAIN else child.sig)
                walk(child, below, inside or child.tag in MAIN)
                flush(below)

    walk(root, (), inside)
    flush(())
    return found


def key(*parts: str) -> int:
    """64 bits that stand for the parts."""
    data = "\0".join(parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


@lru_cache(10_000)
def path_key(path: Path) -> int:
    return key("path", *path)


def tag_of(sig: str) -> str:
    return sig.split(" ", 1)[0]


def layout_of(found: list[tuple[Path, str]]) -> int:
    """The set of containers that hold the blocks of a page."""
    paths = set()
    for path in {path for path, _ in found}:
        while path and tag_of(path[-1]) not in CONTAINERS:
            path = path[:-1]
        paths.add(path)
    return key("layout", *sorted(str(path_key(path)) for path in paths))


def counted(page: str) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Identity and layout of a page, and its (path, text, characters); text 0 counts the path itself."""
    texts = blocks(parse(page), False)
    found = [(path_key(path), key(text), len(text)) for path, text in texts]
    identity = key("page", *(f"{path} {text}" for path, text, _ in found))
    return identity, layout_of(texts), [*{*found, *((path, 0, 0) for path, _, _ in found)}]


def induce(pages: list[str]) -> dict:
    """The wrapper of the pages of one host, as ``wrappers_of`` makes it: weights of paths, template texts."""
    uses: Counter[tuple[int, int, int, int]] = Counter()
    for _, layout, found in {page[0]: page for page in map(counted, pages)}.values():
        uses.update((layout, *row) for row in found)
    by_path, by_layout, texts, sizes = Counter(), Counter(), Counter(), Counter()
    for (layout, path, text, size), n in uses.items():
        if text:
            sizes[path] += size
            texts[path, text] += n
        else:
            by_path[path] += n
            by_layout[layout, path] += n
    constants = {f"{p} {t}" for (p, t), n in texts.items() if by_path[p] >= LEAST_PAGES and n >= CONSTANT * by_path[p]}
    for (layout, path, text, _), n in uses.items():
        if text and by_layout[layout, path] >= LEAST_PAGES and n >= CONSTANT * by_layout[layout, path]:
            constants.add(f"{layout} {path} {text}")
    weights = {str(path): sizes[path] / n for path, n in by_path.items() if n >= LEAST_PAGES}
    return {"weights": weights, "constants": sorted(constants)}


def _regions(sizes: Counter[Path], weights: dict[str, float]) -> list[Path]:
    """Paths of the elements that hold the main text of a page, of its own characters at each path."""
    known = {path: weights.get(str(path_key(path))) for path in sizes}
    if 2 * sum(size for path, size in sizes.items() if known[path] is not None) <= sizes.total():
        for name in MAIN:
            cut = [next((k for k, sig in enumerate(path, 1) if tag_of(sig) == name), 0) for path in sizes]
            if any(cut):
                return [path[:k] for path, k in zip(sizes, cut) if k]
        return [()]
    held = {path: sizes[path] if weight is None else weight for path, weight in known.items()}
    at: Path = ()
    titles: list[Path] = []
    while True:
        below: defaultdict[str, float] = defaultdict(float)
        items: defaultdict[str, float] = defaultdict(float)  # of it in articles
        direct = 0.0
        for path, weight in held.items():
            if path[: len(at)] == at:
                if len(path) > len(at):
                    below[path[len(at)]] += weight
                    if any(tag_of(sig) == "article" for sig in path[len(at) :]):
                        items[path[len(at)]] += weight
                else:
                    direct += weight
        best = max(below, key=below.__getitem__, default="")
        if not best or tag_of(best) not in CONTAINERS and tag_of(best) not in MAIN:
            break
        headings = [sig for sig in below if tag_of(sig) in HEADINGS]
        rest = direct + sum(below.values()) - sum(below[sig] for sig in headings)
        teasers = sum(items.values()) - items[best] if 2 * items[best] <= below[best] else 0.0
        named = tag_of(best) in MAIN
        if below[best] < HELD * (rest - teasers) and not (named and below[best] > HALF * rest):
            break
        titles += [(*at, sig) for sig in headings]
        at = (*at, best)
        if named:
            break
    return [*titles, at]


def extract(page: str | None, wrapper: dict) -> str:
    """Main text of a page by a host's wrapper."""
    if not page:
        return ""
    found, constants = blocks(parse(page), False), wrapper["constants"]
    if constants:
        layout, kept = layout_of(found), []
        for path, text in found:
            names = f"{path_key(path)} {key(text)}"
            if names not in constants and f"{layout} {names}" not in constants:
                kept.append((path, text))
        found = kept
    sizes: Counter[Path] = Counter()
    for path, text in found:
        sizes[path] += len(text)
    regions = _regions(sizes, wrapper.get("weights", {}))
    within = {path for path in sizes if any(path[: len(region)] == region for region in set(regions))}
    return "\n".join(text for path, text in found if path in within)


@lru_cache(1_000)
def _read(wrapper: str | None) -> dict:
    found = json.loads(wrapper) if wrapper else {}
    weights = {str(row["name"]): row["weight"] for row in found.get("weights") or ()}
    return {"weights": weights, "constants": frozenset(found.get("constants") or ())}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 5]
    for batch in batches:
        columns: list[list] = [[] for _ in kinds]
        for host, page in zip(*(column.to_pylist() for column in batch.columns)):
            identity, layout, found = counted(page)
            for row in found:
                for column, value in zip(columns, (host, identity, layout, *row)):
                    column.append(value)
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "page", "layout", "path", "text", "size"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, url, wrapper, pages = batch.columns
        texts = [extract(page, _read(held)) for page, held in zip(pages.to_pylist(), wrapper.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [page_id, url, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def wrappers_of(hosted: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of all pages (host, html)."""
    schema = "host string, page bigint, layout bigint, path bigint, text bigint, size bigint"
    rows = map_arrow(hosted.where("html IS NOT NULL").select("host", "html"), _count, schema).distinct()
    uses = materialize(rows.groupBy("host", "layout", "path", "text", "size").agg(F.count(F.lit(1)).alias("n")), "uses")
    is_path, least = F.col("text") == 0, F.lit(LEAST_PAGES)
    by_path = uses.groupBy("host", "path").agg(
        F.sum(F.when(is_path, F.col("n"))).alias("pages"), F.sum("size").alias("size")
    ).where(F.col("pages") >= least)
    weight = F.struct(F.col("path").alias("name"), (F.col("size") / F.col("pages")).alias("weight"))
    by_layout = uses.where(is_path & (F.col("n") >= least)).select("host", "layout", "path", F.col("n").alias("pages"))
    # A text on so large a part of LEAST_PAGES pages or more is on this many at least.
    enough = F.col("n") >= F.lit(CONSTANT) * F.lit(LEAST_PAGES)
    wide = uses.where(~is_path).groupBy("host", "path", "text").agg(F.sum("n").alias("n")).where(enough)
    narrow = uses.where(~is_path & enough)
    on_host = lookup_join(wide, by_path, ["host", "path"], spread=["text"], how="inner")
    on_layout = lookup_join(narrow, by_layout, ["host", "layout", "path"], spread=["text"], how="inner")
    common = F.col("n") >= F.lit(CONSTANT) * F.col("pages")
    constants = on_host.where(common).select("host", F.concat_ws(" ", "path", "text").alias("constant")).unionByName(
        on_layout.where(common).select("host", F.concat_ws(" ", "layout", "path", "text").alias("constant"))
    )
    parts = by_path.select("host", weight.alias("weight"), F.lit(None).cast("string").alias("constant")).unionByName(
        constants.select("host", F.lit(None).cast("struct<name:bigint,weight:double>").alias("weight"), "constant")
    )
    # Lists leave out nulls.
    held = F.struct(F.collect_list("weight").alias("weights"), F.collect_list("constant").alias("constants"))
    return parts.groupBy("host").agg(F.to_json(held).alias("wrapper"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of all pages (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    hosted = pages.select(F.col("page_id").cast("bigint"), "url", host.alias("host"), "html")
    wrappers = materialize(wrappers_of(hosted), "wrappers")
    known = lookup_join(hosted, wrappers, ["host"], spread=["page_id"], how="left", stored=True)
    return map_arrow(
        known.select("page_id", "url", "wrapper", "html"), _apply, "page_id bigint, url string, text string, n_chars bigint"
    )
