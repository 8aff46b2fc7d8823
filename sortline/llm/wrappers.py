"""HTML extraction by union-free wrappers.

The pages of a host are aligned one after another into a wrapper: a regular expression over tags without alternatives. Tokens of a page and of the wrapper agree where
the elements around them do. What some parents lack becomes optional, what one parent has several times a repeated group, children whose order changes a repeated group of
all of them, and texts that differ a slot; a text that nearly all pages of the host repeat at a place is a constant: template, not content. The slots are weighed by the
text that varies over the host's pages, and the content is the subtree of the wrapper that holds most of it. Names of elements only weigh in.

Alignments add up in any order, so a wrapper is a grouped sum: pages are folded where they are read, and what is shuffled is a row for each host, task and
place in the wrapper, and one for each distinct text there, however many pages a host has.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Roots and constants of this many bytes in all are broadcast; more are joined by host and slice.
BROADCAST_BYTES = 8 << 20
#: Places and texts that a task counts, and hosts whose contents it knows, at once.
HELD = 200_000
HELD_HOSTS = 2_000
#: The content's roots are chosen on the wrapper's places that one in so many of its host's pages has, which bounds them by the size of a page: a root has two thirds of the varying text of its parent,
#: so it is on many. All places stay in the wrapper, and texts below the others are content if what is above them is.
SUPPORT = 1_000

#: A text is a constant if this share of the pages that have its place, and this many of them at least, have it there.
FIXED_SHARE = 0.9
FIXED_PAGES = 3
#: Slices that the texts of a place and the pages of a host are dealt into, so that a hot host's are in no task alone.
SLICES = 32
#: A child is the content of its parent if it holds this share of the parent's varying text.
CONTENT_SHARE = 2 / 3
#: Weights of text in a main part, and in menus and the like; those count only in hosts that show them to vary (on so many pages, by so many characters a page) and around a main part.
MAIN_WEIGHT, BOILER_WEIGHT = 8.0, 0.02
BOILER_PAGES, BOILER_CHARS = 3, 200

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg math iframe textarea"
FOREIGN = "svg math"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
ENDS_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article main section div select".split())
NOT_TEXT = frozenset("head title nav footer aside form button select option dialog menu object canvas audio video fieldset".split())
NEVER_TEXT = frozenset("head title select option object canvas audio video".split())
MAIN = frozenset(("article", "main"))
NAMED_BY_TAG = MAIN | frozenset("html body h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section main article center form table tbody tr td span aside header footer nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words that names (a class, id or role) of what isn't article text are made of: such a name has one of KIND_WORDS, and else PLACE_WORDS alone. In main parts words of LOOSE_WORDS count beside
#: others only, as alone they may name what the article is about.
KIND_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices announcement sidebar menu navbar nav navigation "
    "breadcrumb breadcrumbs comment comments disqus share sharing social newsletter subscribe signup login popup modal pagination pager copyright contentinfo complementary toolbar masthead footer".split()
)
LOOSE_WORDS = frozenset("side search reply replies respond related recommended alert banner overlay widget skip".split())
PLACE_WORDS = frozenset(
    "box bar container slot wrapper wrap area section list item items body form link links button buttons block unit panel inner outer main site page post posts reader user users left right top bottom "
    "fb google facebook twitter all new thread count title header row group module region zone articles content text banner".split()
)

SITE_HEADERS = frozenset(("header", "site-header"))

#: Names that count as ids too; others, as "search" or "related", are anchors of what an article's parts are about.
ID_NAMES = frozenset(
    "ad ads ad-box ad-banner ad-container ad-wrapper google-ads cookie-banner cookie-bar cookie-consent cookie-notice site-notice sidebar left-sidebar right-sidebar menu main-menu navbar nav main-nav "
    "breadcrumb breadcrumbs header footer page-footer site-footer site-header masthead comments comment-form comment-list comment-section comments-area comments-section post-comments reader-comments "
    "fb-comments disqus disqus_thread respond newsletter main".split()
)

# A tag's attributes: quoted values hold any character.
REST_OF_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{FOREIGN.replace(' ', '|')})(?=[\s/])(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>]){REST_OF_TAG}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{REST_OF_TAG})>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
WORD_ENDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
TEXT = "#"


def label_of(tag: str, attrs: str) -> str:
    """tag and its classes and role, all of them, without numbers. Ids tell pages apart more than kinds, so only those that name a known part count. An element is hidden by its own
    attributes hidden, style and aria-hidden alone, whatever others say."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag
    names = set()
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "role", "id"):
            words = DIGITS.sub("", WORD_ENDS.sub("-", value).lower() if name != "id" else value.lower()).split()
            names.update(w for w in words if name != "id" or w in ID_NAMES)
        elif name == "hidden" or name == "style" and UNSEEN.search(value) or name == "aria-hidden" and value.strip().lower() == "true":
            names.add("!hidden")
    return " ".join([tag, *sorted(names)])


@lru_cache(1 << 16)
def names_boiler(name: str, inside: bool) -> bool:
    """Whether a name is that of what isn't article text, by the words that it is made of."""
    words = [w for w in re.split("[-_]", name) if w]
    kinds = KIND_WORDS if inside and len(words) < 2 else KIND_WORDS | LOOSE_WORDS
    return any(w in kinds for w in words) and all(w in kinds or w in PLACE_WORDS for w in words)


def is_boiler(label: str, inside: bool) -> bool:
    """Menus, adverts, forms and the like, by tag or name. Headings and main parts are not told by name; a header is one outside of a main part."""
    tag, *names = label.split(" ")
    if tag in NOT_TEXT or "!hidden" in names or tag not in NAMED_BY_TAG and any(names_boiler(n, inside) for n in names):
        return True
    return not inside and (tag == "header" or tag not in NAMED_BY_TAG and not SITE_HEADERS.isdisjoint(names))


def is_main(label: str) -> bool:
    return label.split(" ")[0] in MAIN or " main " in f" {label.partition(' ')[2]} "


@dataclass(slots=True)
class Node:
    """A place in a wrapper: an element (or, labelled "#", a text) below its parent. pages that have it, instances, parents that have one, the most that one has, the
    sum of its ranks among its siblings, whether children of it change order, and characters of its texts (or, of a wrapper, those that vary)."""

    parent: int
    label: str
    depth: int
    pages: int = 1
    instances: int = 0
    parents: int = 0
    most: int = 0
    ranks: int = 0
    mixed: bool = False
    chars: int = 0


ROOT = 0


@dataclass
class Page:
    """nodes by key, parents before their children, and (key of the text's node, text) in page order."""

    nodes: dict[int, Node] = field(default_factory=lambda: {ROOT: Node(ROOT, "", 0, 1, 1, 1, 1)})
    blocks: list[tuple[int, str]] = field(default_factory=list)


def key_below(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), parent) or 1


def parse(text: str | None) -> Page:
    """The elements and texts of a page. Inline tags don't part a text, and open elements are ended as browsers do. No step depends on how deep elements nest."""
    page = Page()
    nodes, blocks = page.nodes, page.blocks
    tags, keys, kids, latest = [""], [ROOT], [{}], [None]  # of the open elements
    open_tags: Counter[str] = Counter()
    held: list[str] = []

    def child(label: str) -> int:
        key = key_below(keys[-1], label)
        node = nodes.get(key)
        if node is None:
            node = nodes[key] = Node(keys[-1], label, len(keys))
        count = kids[-1].get(key)
        if count is None:
            node.ranks += len(kids[-1])
        elif latest[-1] != key:
            nodes[keys[-1]].mixed = True
        kids[-1][key] = (count or 0) + 1
        latest[-1] = key
        return key

    def close(size: int) -> None:
        """Close the elements above the `size` lowest."""
        while len(tags) > size:
            for key, n in kids.pop().items():
                node = nodes[key]
                node.instances += n
                node.parents += 1
                node.most = max(node.most, n)
            keys.pop()
            latest.pop()
            open_tags[tags.pop()] -= 1

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                key = child(TEXT)
                nodes[key].chars += len(text)
                blocks.append((key, text))

    for m in TOKEN.finditer(text or ""):
        if m["text"] is not None:
            held.append(m["text"])
            continue
        tag = (m["tag"] or "").lower()
        if not tag or tag in INLINE and not open_tags[tag] and not (m["attrs"] and not m["end"] and is_boiler(label_of(tag, m["attrs"]), True)):
            continue
        flush()
        if m["end"]:
            if open_tags[tag]:
                k = len(tags) - 1
                while tags[k] != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and open_tags["p"] or tag in SIBLINGS:
            ended = SIBLINGS.get(tag, {"p"})
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in ended:
                    close(k)
                    break
                if tags[k] in SCOPES:
                    break
        key = child(label_of(tag, m["attrs"]))
        tags.append(tag)
        keys.append(key)
        kids.append({})
        latest.append(None)
        open_tags[tag] += 1
    flush()
    close(0)
    return page


def align(nodes: dict[int, Node], page: dict[int, Node]) -> None:
    """Fold the places of a page (or of another wrapper) into those of a wrapper."""
    for key, b in page.items():
        a = nodes.get(key)
        if a is None:
            nodes[key] = Node(b.parent, b.label, b.depth, b.pages, b.instances, b.parents, b.most, b.ranks, b.mixed, b.chars)
        else:
            a.pages += b.pages
            a.instances += b.instances
            a.parents += b.parents
            a.most = max(a.most, b.most)
            a.ranks += b.ranks
            a.mixed = a.mixed or b.mixed
            a.chars += b.chars


def children_of(nodes: dict[int, Node]) -> dict[int, list[int]]:
    """Keys of the children of every key in the order of the wrapper."""
    out: dict[int, list[int]] = defaultdict(list)
    for key, node in nodes.items():
        if key != ROOT:
            out[node.parent].append(key)
    for below in out.values():
        below.sort(key=lambda k: (nodes[k].ranks / max(1, nodes[k].parents), nodes[k].label))
    return out


def pattern(nodes: dict[int, Node]) -> str:
    """The wrapper as a union-free regular expression, to be read by people: "#" is a text slot, "?", "+" and "*" follow groups, and "( )+" holds children in any order."""
    below, out = children_of(nodes), []
    todo: list = [ROOT]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        node = nodes[at]
        many, some = node.most > 1, at != ROOT and node.parents < nodes[node.parent].instances
        sign = "*" if many and some else "+" if many else "?" if some else ""
        head, tail = ("", "") if at == ROOT else ("#", "") if node.label == TEXT else (f"<{node.label}>", f"</{node.label.split(' ')[0]}>")
        inner = list(below.get(at, ()))
        inner = ["(", *inner, ")+"] if node.mixed and len(inner) > 1 else inner
        todo += reversed([*(["("] if sign else []), head, *inner, tail, *([f"){sign}"] if sign else [])])
    return "".join(out)


def choose(nodes: dict[int, Node]) -> list[int]:
    """Keys of the content's roots. nodes: places of a wrapper; chars of a text's place are those that vary over the pages.

    From the root, the content is sought in the child that holds most of its parent's varying text, until no single child does; repeated groups are content of their parent.
    Names weigh in: texts of main parts count more, those of menus and the like less. Headings and main parts beside the way down stay.
    """
    order = sorted(nodes, key=lambda k: nodes[k].depth)
    inside, chars, has_main = {ROOT: False}, {k: float(nodes[k].chars) for k in order}, defaultdict(bool)
    weight = {k: float(nodes[k].chars) for k in order}
    for k in order[1:]:
        inside[k] = inside.get(nodes[k].parent, False) or is_main(nodes[nodes[k].parent].label if nodes[k].parent in nodes else "")
    children = defaultdict(list)
    among: dict[int, float] = {}
    for k in reversed(order[1:]):
        node, up = nodes[k], nodes[k].parent
        if up not in nodes:
            continue
        tag = node.label.split(" ")[0]
        if tag in NEVER_TEXT or "!hidden" in node.label:
            factor = 0.0
        elif is_boiler(node.label, inside[k]):
            seen = node.pages >= BOILER_PAGES and chars[k] >= BOILER_CHARS * node.pages
            factor = BOILER_WEIGHT if seen or not inside[k] and tag not in NOT_TEXT and has_main[k] else 0.0
        else:
            factor = MAIN_WEIGHT if is_main(node.label) and not inside[k] else 1.0
        among[k] = factor * weight[k]
        weight[up] += among[k]
        chars[up] += chars[k]
        has_main[up] |= has_main[k] or is_main(node.label)
        children[up].append(k)
    if not weight[ROOT]:
        return []
    at, roots = ROOT, []
    while not (inside[at] or is_main(nodes[at].label)):
        best = max((k for k in children[at] if nodes[k].label != TEXT), key=lambda k: (among[k], nodes[k].label), default=None)
        if best is None or among[best] <= 0 or among[best] < CONTENT_SHARE * weight[at] or nodes[best].label.split(" ")[0] not in CONTAINERS:
            break
        if nodes[best].most > 1 and not is_main(nodes[best].label):
            break
        roots += [k for k in children[at] if k != best and not is_boiler(nodes[k].label, inside[k]) and (nodes[k].label.split(" ")[0] in HEADINGS or is_main(nodes[k].label))]
        at = best
    return [*roots, at]


def content(page: Page, roots: set[int]) -> list[tuple[int, str, bool]]:
    """Blocks of a page below the roots, but for menus, adverts and the like inside of them: key, text, and whether the text is of the article whatever other pages have (in a main part, or a
    heading)."""
    within, inside, headed = {}, {}, {}
    for key, node in page.nodes.items():
        up = node.parent
        inside[key] = key != ROOT and (inside[up] or is_main(page.nodes[up].label))
        headed[key] = key != ROOT and (headed[up] or node.label.split(" ")[0] in HEADINGS)
        within[key] = key in roots or key != ROOT and within[up] and not is_boiler(node.label, inside[key])
    return [(key, text, inside[key] or headed[key]) for key, text in page.blocks if within[key]]


def extract(page: Page, roots: set[int], fixed: set[tuple[int, int]]) -> str:
    """The article of a page. roots: those of the wrapper of its host, fixed: its constants (key, hash of the text). They are left out where the content is told by what varies; in a main
    part, and in headings, nothing is, and neither on a page of nothing else. A page without text below the roots is chosen from by its own places."""
    found = content(page, roots) or content(page, set(choose(page.nodes)))
    own = [(k, text_hash(t)) not in fixed for k, t, _ in found]
    return " ".join(t for (_, t, sure), varies in zip(found, own) if sure or varies or not any(own))


def text_hash(text: str) -> int:
    return signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(c) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(c, HOST, 1), F.lit("")))


SUMS = ("pages", "instances", "parents", "ranks", "chars")
FOLDED = "host string, key long, parent long, label string, depth int, pages long, instances long, parents long, most long, ranks long, mixed boolean, chars long, text_key long"
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
FOLDED_ARROW = pa.schema([(name, ARROW[kind]) for name, kind in (c.split(" ") for c in FOLDED.split(", "))])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The wrapper of every host: a row for each place, with host, key, parent, label, depth, pages, instances, parents, most, ranks, mixed, varying (characters of its texts
    that aren't constant) and fixed (hashes of its constant texts). Pages without a host share the empty one."""

    def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, Node]] = defaultdict(dict)
        texts: dict[tuple[str, int, int], list[int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(h, signed(k), signed(n.parent), n.label, n.depth, n.pages, n.instances, n.parents, n.most, n.ranks, n.mixed, n.chars, None) for h, nodes in held.items() for k, n in nodes.items()]
            rows += [(h, signed(k), None, None, None, n, None, None, None, None, None, c, t) for (h, k, t), (n, c) in texts.items()]
            held.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOLDED_ARROW)], schema=FOLDED_ARROW)

        for batch in batches:
            for h, text in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                page = parse(text)
                nodes = held[h]
                before = len(nodes)
                align(nodes, page.nodes)
                size += len(nodes) - before
                on_page: dict[tuple[int, int], int] = Counter()
                for key, t in page.blocks:
                    on_page[key, text_hash(t)] += len(t)
                for (key, t), chars in on_page.items():
                    count = texts.setdefault((h, key, t), [0, 0])
                    count[0] += 1
                    count[1] += chars
                if size + len(texts) >= HELD:
                    yield out()
                    size = 0
        yield out()

    read = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("page"))
    folded = materialize(read.mapInArrow(fold_pages, FOLDED), "folded")
    places = materialize(
        folded.filter(F.col("text_key").isNull())
        .groupBy("host", "key")
        .agg(*(F.max(c).alias(c) for c in ("parent", "label", "depth", "most", "mixed")), *(F.sum(c).alias(c) for c in SUMS)),
        "places",
    )
    texts = folded.filter(F.col("text_key").isNotNull()).groupBy("host", "key", "text_key").agg(F.sum("pages").alias("on"), F.sum("chars").alias("same")).filter(F.col("on") >= FIXED_PAGES)
    texts = texts.select(F.col("host").alias("of"), F.col("key").alias("at"), "text_key", "on", "same", F.pmod("text_key", F.lit(SLICES)).alias("nth"))
    dealt = places.filter((F.col("label") == TEXT) & (F.col("pages") >= FIXED_PAGES)).select("host", "key", "pages", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    fixed = (
        dealt.join(texts, (F.col("host") == F.col("of")) & (F.col("key") == F.col("at")) & (F.col("slice") == F.col("nth")) & (F.col("on") >= FIXED_SHARE * F.col("pages")))
        .groupBy("of", "at")
        .agg(F.sum("same").alias("same"), F.array_sort(F.collect_list("text_key")).alias("fixed"))
    )
    kept = places.join(fixed, (F.col("host") == F.col("of")) & (F.col("key") == F.col("at")), "left")
    none = F.array().cast("array<bigint>")
    return kept.select("host", "key", "parent", "label", "depth", "pages", "instances", "parents", "most", "ranks", "mixed", (F.col("chars") - F.coalesce("same", F.lit(0))).alias("varying"), F.coalesce("fixed", none).alias("fixed"))


def contents(wrappers: DataFrame) -> DataFrame:
    """of (the host), roots (keys of the content's roots in its wrapper) and constants (key, text)."""
    sizes = wrappers.filter(F.col("key") == ROOT).select(F.col("host").alias("of"), F.col("pages").alias("all"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    place = F.struct("key", "parent", "label", "depth", "pages", "most", "varying", "fixed")
    of_host = (F.col("host") == F.col("of")) & (F.pmod("key", F.lit(SLICES)) == F.col("slice")) & (F.col("pages") * SUPPORT >= F.col("all"))
    listed = wrappers.join(sizes, of_host).groupBy("host").agg(F.collect_list(place).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, places in zip(pdf["host"], pdf["places"]):
                nodes = {p["key"]: Node(p["parent"], p["label"], p["depth"], p["pages"], most=p["most"], chars=p["varying"]) for p in sorted(places, key=lambda p: p["depth"])}
                rows.append((h, choose(nodes), [(p["key"], t) for p in places for t in p["fixed"]]))
            yield pd.DataFrame(rows, columns=["of", "roots", "constants"])

    return listed.mapInPandas(run, "of string, roots array<long>, constants array<struct<key: long, text: long>>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, text (of the article, empty if there is none) for every page.

    Null and empty pages give an empty text, null urls the host "". Cut-off tags and references are read as far as they go, and elements may nest to any depth. Repeated
    rows give a row each; other columns are ignored.
    """
    found = materialize(contents(materialize(infer_wrappers(pages, url_col, html_col), "wrappers")), "contents")
    size = found.agg(F.coalesce(F.sum(F.octet_length("of") + 8 * F.size("roots") + 24 * F.size("constants") + 64), F.lit(0))).first()[0]
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("page")).withColumn("host", host(F.col("url")))
    if size <= BROADCAST_BYTES:
        both = read.join(F.broadcast(found), F.col("host") == F.col("of"), "left")
    else:
        dealt = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        both = read.join(dealt, (F.col("host") == F.col("of")) & (F.pmod(F.xxhash64("page_id", "url"), F.lit(SLICES)) == F.col("slice")), "left")
    schema = f"page_id {read.schema['page_id'].dataType.simpleString()}, url string, host string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[set, set]] = {}
        for pdf in batches:
            texts = []
            for h, roots, constants, page in zip(pdf["host"], pdf["roots"], pdf["constants"], pdf["page"]):
                if h not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[h] = {int(k) % (1 << 64) for k in roots}, {(int(c["key"]) % (1 << 64), int(c["text"])) for c in constants}
                texts.append(extract(parse(page), *known[h]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host": pdf["host"], "text": texts})

    return both.select("page_id", "url", "host", "page", "roots", "constants").mapInPandas(run, schema)
