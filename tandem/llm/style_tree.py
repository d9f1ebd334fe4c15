"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: an element is known by its path of tags and
class names. Where an element looks the same and says the same on every page, the entropy of its
presentation and of its content is low, and so is its importance: such branches are the site's, not
the page's, and are cut from each page. What an element declares itself to be (nav, footer, an article, a
container whose class names nothing but an advert) sets its importance outright, as a host with one
page has no statistics. Ids say nothing, nor do the classes of an article's paragraphs, headings and list items.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.sources.workspace import stage

#: Weight of content against presentation, the least importance that stays, and the fewest pages of
#: a host that must have an element before it can be unimportant.
GAMMA, LEAST, PAGES = 0.9, 0.2, 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(class|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element on the left ends where one of these begins.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that are never the page's text: by tag, by role, or, if they only hold other elements, by a class
#: name all of whose words say so (the filling words say nothing).
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select textarea"
    " menu dialog object embed canvas audio video datalist input label fieldset search xmp noframes"
    " title".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar"
    " toolbar".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb"
    " breadcrumbs footer header masthead comment comments reply replies respond disqus discussion"
    " share sharing social related newsletter subscribe subscription popup modal overlay widget"
    " login signup toolbar pagination pager".split()
)
FILLING = frozenset(
    "area bar block bottom box col container content global inner item left list main outer page panel reader"
    " readers right row section site strip top user users wrap wrapper".split()
)
MAIN = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th".split())


class Element:
    __slots__ = ("tag", "name", "noise", "children")

    def __init__(self, tag: str, attributes: str, inside: bool = False):
        self.tag, self.name, self.noise = tag, tag, tag in NOISE_TAGS
        self.children: list = []
        if attributes:
            names: list[str] = []
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "role":
                    self.noise |= value in NOISE_ROLES
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    self.noise = True
                else:
                    names += value.split()
                    self.name = tag + "." + re.sub(r"\d+", "0", value)
            if tag not in ("html", "body", *MAIN) and not (inside and tag in PROSE):
                self.noise |= any(map(says_noise, names))


def says_noise(name: str) -> bool:
    """Whether a class name speaks of nothing but noise: ``ad-box`` does, ``menu-of-dishes`` does not."""
    words = {w for w in re.split(r"[\W_]+", name) if w}
    return words <= NOISE_WORDS | FILLING and not words <= FILLING


def parse(page: str | None) -> Element:
    """The tree of a page, forgiving: elements end where browsers end them, at the latest with the
    page. Texts are strings among the children, with references decoded."""
    page = page or ""
    root = Element("html", "")
    stack, at = [root], 0
    open_tags: Counter[str] = Counter()  # of the stack, but for the root: nothing is sought that is not open

    def close_from(k: int) -> None:
        open_tags.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        end_tag, tag, attributes = m.group(1), m.group(2), m.group(3)
        if tag is not None:
            tag = tag.lower()
            if tag == "html":
                continue
            if tag in CLOSES_P and open_tags["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close_from(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in SIBLINGS and any(open_tags[x] for x in SIBLINGS[tag][0]):
                ends, within = SIBLINGS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in ends:
                        close_from(k)
                        if tag != "tr" or stack[-1].tag not in ends:
                            break
            if tag == "body":
                close_from(1)
            element = Element(tag, attributes, any(open_tags[x] for x in MAIN))
            stack[-1].children.append(element)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = close.start() if close else len(page)
            if tag in RAW or tag not in VOID and not attributes.endswith("/"):
                stack.append(element)
                open_tags[tag] += 1
        elif end_tag is not None:
            end_tag = end_tag.lower()
            for k in range(len(stack) - 1, 0, -1) if open_tags[end_tag] else ():
                if stack[k].tag == end_tag:
                    close_from(k)
                    break
                if stack[k].tag in BLOCK and end_tag not in BLOCK:
                    break
        elif not m.group().startswith("<!") and not m.group().startswith("<?"):
            stack[-1].children.append(html.unescape(m.group()))
    return root


def hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_nodes(root: Element) -> dict[int, tuple[int, int]]:
    """path -> (presentation, content) of a page's block elements that their kind does not settle.

    Elements of one path are one node: its presentation is the row of their children's names, equal
    neighbours once; its content is their texts. Paths go down and contents come up by hashes of hashes, so
    the work is that of the page's length, however deep it is.
    """
    order: list[tuple[Element, int, bool]] = []
    work = [(root, 0, False)]
    while work:
        element, path, inside = work.pop()
        path = hashed(f"{path}/{element.name}")
        inside = inside or element.tag in MAIN
        order.append((element, path, inside))
        if not element.noise:
            work += [(x, path, inside) for x in reversed(element.children) if isinstance(x, Element)]
    found: dict[int, tuple[list[str], list[str]]] = {}
    says: dict[int, str] = {}
    for element, path, inside in reversed(order):  # children before their parents
        if element.noise:
            continue
        parts = [
            " ".join(x.split()) if isinstance(x, str) else says.get(id(x), "") for x in element.children
        ]
        parts = [x for x in parts if x]
        says[id(element)] = parts[0] if len(parts) == 1 else f"#{hashed(chr(0).join(parts))}" if parts else ""
        if not free(element, inside) or element.tag not in BLOCK:
            continue
        names, texts = found.setdefault(path, ([], []))
        texts.append(says[id(element)])
        here = []
        for x in element.children:
            name = x.name if isinstance(x, Element) else "#"
            if not here or here[-1] != name:
                here.append(name)
        names.append(" ".join(here))
    return {k: (hashed(chr(0).join(a)), hashed(chr(0).join(b))) for k, (a, b) in found.items()}


def free(element: Element, inside: bool) -> bool:
    """Whether statistics may cut the element: an article and the prose in it stay."""
    return element.tag not in MAIN and element.tag not in ("html", "body") and not (
        inside and element.tag in PROSE
    )


def main_text(root: Element, cut: frozenset[int] = frozenset()) -> str:
    """The blocks of a page in order, a line each, without noise and the paths that are cut."""
    blocks: list[list[str]] = [[]]
    has_main = any_main(root)
    work: list = [(root, 0, False)]
    while work:
        x, path, inside = work.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            if inside or not has_main:
                blocks[-1].append(x)
        elif x.tag in ("br", "hr", "wbr"):
            if x.tag == "hr":
                blocks.append([])
            elif x.tag == "br":
                blocks[-1].append(" ")
        else:
            inside = inside or x.tag in MAIN
            if x.noise or (x.tag == "header" and not inside):
                continue
            if cut:
                path = hashed(f"{path}/{x.name}")
                if path in cut and x.tag in BLOCK and free(x, inside):
                    continue
            if x.tag in BLOCK:
                blocks.append([])
                work.append((None, 0, False))
            work += [(c, path, inside) for c in reversed(x.children)]
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def any_main(root: Element) -> bool:
    """Whether the page has an article or main element with text in it that is not noise."""
    work: list = [(root, False)]
    while work:
        x, inside = work.pop()
        if isinstance(x, str):
            if inside and x.strip():
                return True
        elif not x.noise:
            work += [(c, inside or x.tag in MAIN) for c in x.children]
    return False


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if it has none, or for null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def unimportant(
    pages: DataFrame, gamma: float = GAMMA, least: float = LEAST, at_least: int = PAGES
) -> DataFrame:
    """(host, cut): the paths of each host's style tree that are of low importance.

    With m pages that have a node, importance is the entropy, to base m, of how they share its
    presentations, and the same of its contents, weighed by ``gamma``. Rows of a host with equal html
    are one page: they are folded by its SHA-1, in every task first, when only hashes of their nodes
    are left. The tree is merged by grouped counts, so a host of any number of pages is spread; a
    host's list has a path for each element of its templates at most, as names are compared without
    digits.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                found = [
                    [{"path": p, "presentation": a, "content": b} for p, (a, b) in style_nodes(parse(x)).items()]
                    for x in some.column(2).to_pylist()
                ]
                kind = pa.struct([("path", pa.int64()), ("presentation", pa.int64()), ("content", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(found, pa.list_(kind))],
                    names=["host", "page", "nodes"],
                )

    seen = pages.select(host(F.col("url")).alias("host"), F.sha1("html").alias("page"), "html").mapInArrow(
        nodes,
        "host string, page string, nodes array<struct<path: long, presentation: long, content: long>>",
    )
    each = seen.dropDuplicates(["host", "page"]).select("host", F.explode("nodes").alias("node")).select(
        "host", "node.path",
        F.posexplode(F.array("node.presentation", "node.content")).alias("kind", "value"),
    )
    counts = each.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")
    entropy = counts.groupBy("host", "path", "kind").agg(
        F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("clogc")
    ).filter(F.col("m") >= at_least)
    value = 1 - F.col("clogc") / (F.col("m") * F.log(F.col("m").cast("double")))
    weight = F.when(F.col("kind") == 1, gamma).otherwise(1 - gamma)
    nodes_of = entropy.groupBy("host", "path").agg(F.sum(value * weight).alias("importance"))
    low = nodes_of.filter((F.col("importance") < least) & (F.col("host") != ""))
    return low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("cut"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``; see ``unimportant``.

    The text is that of the page's article or main elements, or of its body if they hold none, without
    noise. A block's white space is one blank, a line break inside it too; blocks are lines. Null html
    counts as empty and gives an empty text. Pages without a host are not merged with others. Repeated
    rows are all returned. Other columns are not read.
    """
    cuts = stage(unimportant(pages), "cuts").withColumnRenamed("host", "of")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    both = rows.join(cuts, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                pages_of, cuts_of = some.column(2).to_pylist(), some.column(3).to_pylist()
                texts = [main_text(parse(p), frozenset(c or ())) for p, c in zip(pages_of, cuts_of)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), some.column(1), pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
