import html
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sortline.llm import wrappers
from sortline.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def texts_of(spark, rows):
    out = defaultdict(list)
    for r in wrappers.extract_text(spark.createDataFrame(rows, PAGES)).collect():
        out[r.page_id].append(r.text)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def page(k, items=3, extra="", tail="</body></html>"):
    paragraphs = "".join(f"<p>Para {k}.{i} a &lt; b&nbsp;c</p>\n" for i in range(items))
    return (
        f"<html><head><title>T{k}</title><script>var x='<p>no</p>';</script></head><body><nav><ul><li>Home<li>About</ul></nav>"
        f'<div class="ad-box">Buy {k}</div><article><h1>Head  {k}</h1>{paragraphs}{extra}</article><footer>&copy; site</footer>{tail}'
    )


def test_extraction_of_articles(spark):
    rows = [
        (1, "http://a.example/1", page(1)),
        (2, "https://a.example/2", page(2, 5, '<div class="comments"><article><p>first!</p></article></div><form><p>mail</p></form>')),
        (3, "http://a.example/3", page(3, 1, "<p>x<b>y</b>z<br>w<p>open", tail="")),
        (4, "http://b.example/", '<body><div class="header">H</div><div id="content">One<p>Two<p>Three</div><div class="sidebar x">S</div>'),
        (5, None, None),
        (6, "", ""),
        (7, "http://c.example", "just text &amp; more &am"),
        (1, "http://a.example/1", page(1)),
    ]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], f"{PAGES}, text string, page int")
    got = defaultdict(list)
    for r in wrappers.extract_text(df).collect():
        got[r.page_id].append(r.text)
    assert got[1] == ["Head 1 Para 1.0 a < b c Para 1.1 a < b c Para 1.2 a < b c"] * 2
    assert got[2] == ["Head 2 " + " ".join(f"Para 2.{i} a < b c" for i in range(5))]
    assert got[3] == ["Head 3 Para 3.0 a < b c xyz w open"]
    assert got[4] == ["One Two Three"] and got[5] == [""] and got[6] == [""] and got[7] == ["just text & more &am"]
    assert wrappers.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1_200, 5_000, 20_000])
def test_deep_pages(spark, depth):
    rows = [(k, "http://deep.example/", "<article>" + "<div>" * depth + f"x{k}") for k in range(3)]
    assert texts_of(spark, rows) == {k: f"x{k}" for k in range(3)}


def test_many_siblings_take_linear_time():
    import time

    start = time.time()
    nodes = {}
    for k in (1, 2):
        wrappers.align(nodes, wrappers.parse("<article>" + "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{"x" * (i // 676 * k)}">t{i}</div>' for i in range(5_000))).nodes)
    assert wrappers.choose(nodes) and time.time() - start < 10


def test_contents_without_broadcast(spark, monkeypatch, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(map(tuple, wrappers.extract_text(pages).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(wrappers, "HELD", 3)
    assert sorted(map(tuple, wrappers.extract_text(pages.repartition(7)).collect())) == want


def test_real_pages_against_the_article_element(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op6_html_wrappers"](spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_real_pages_without_their_article_element(spark):
    """The tags that name the article are taken away: what varies over the host's pages has to tell it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = Counter(r.url.split("/")[2] for r in pages)
    some = [r for r in pages if hosts[r.url.split("/")[2]] >= 4]
    bare = [(r.page_id, r.url, re.sub(r"<(/?)article>", r"<\1div>", r.html)) for r in some]
    want = texts_of(spark, [tuple(r[c] for c in ("page_id", "url", "html")) for r in some])
    got = texts_of(spark, bare)
    assert len(some) > 30 and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_wrappers_generalise_without_alternatives():
    total = {}
    for k in range(6):
        wrappers.align(total, wrappers.parse(page(k, k, "<h2>more</h2>" if k == 2 else "")).nodes)
    text = wrappers.pattern(total)
    assert "(<p>#</p>)*" in text and "(<h2>#</h2>)?" in text and "(<li>#</li>)+" in text and "|" not in text
    mixed = wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>").nodes
    assert wrappers.pattern(mixed) == "<dl>((<dt>#</dt>)+(<dd>#</dd>)+)+</dl>"


def test_wrapper_decides_what_is_content(spark, monkeypatch):
    body = lambda k: f"The {k} long body of this page, told in words of its own {k * 7}. " * 6
    shared = "<p>Share this on all networks</p>"
    rows = [(k, f"http://named.example/{k}", f"<body><div class=post><h1>Head {k}</h1><p>{body(k)}</p>{shared}</div></body>") for k in range(1, 6)]
    rows += [(10 + k, f"http://split.example/{k}", f"<body><main><h1>Head {k}</h1></main><div class=x><p>{body(k)}</p></div></body>") for k in range(1, 6)]
    rows += [(20 + k, f"http://bare.example/{k}", f"<body><div class=top>Our site {k % 2}</div><div class=x><h1>Head {k}</h1><p>{body(k)}</p></div><div class=y>Also see {k}</div></body>") for k in range(1, 6)]
    # a long text that all pages repeat stands beside short ones of their own
    rows += [(30 + k, f"http://terms.example/{k}", f"<body><div class=terms><p>{body(0) * 3}</p></div><div class=x><h1>Head {k}</h1><p>{body(k)}</p></div></body>") for k in range(1, 6)]
    got = texts_of(spark, rows)
    for k in range(1, 6):
        want = f"Head {k} {body(k).strip()}"
        assert [got[k], got[10 + k], got[20 + k], got[30 + k]] == [want] * 4
    alone = {k: wrappers.extract((p := wrappers.parse(h)), set(wrappers.choose(p.nodes)), set()) for k, _, h in rows}  # each page without its host
    assert all(alone[k] != got[k] for k in (1, 31))  # by the wrapper alone
    # pages that are all alike have constants alone, which are their text
    same = [(k, "http://same.example", rows[0][2]) for k in range(4)]
    assert set(texts_of(spark, same).values()) == {f"Head 1 {body(1)}Share this on all networks"}


def test_names_neither_get_lost_nor_drop_an_article(spark):
    article = "<article class='has-comments'><h1>Head</h1><p>Body of the page.</p><div class='comments'>first!</div></article>"
    many = '<div class="bg border col content flex grid item layout sidebar">Elsewhere</div>'
    pages = [
        f"<body class='no-sidebar'>{article}</body>",
        f"<body><div class='with-menu'>{article}</div></body>",
        f"<body class='sidebar'><div class='layout menu'>{article}</div><div class='menu'>Home</div></body>",
        f"<body>{many}<div class='a b c d e f g h main'><h1>Head</h1><p>Body of the page.</p></div></body>",
        f"<body><h1>Head</h1><p>Body of the page.</p>{many}</body>",
    ]
    got = texts_of(spark, [(k, f"http://h{k}.example/", page) for k, page in enumerate(pages)])
    assert len(got) == 5 and set(got.values()) == {"Head Body of the page."}


def test_parts_of_names_drop_nothing(spark):
    page = (
        '<article><h2 id="related-work">Related work</h2><p>x</p><div class="side-by-side">y</div><p class="search-term">z</p><section id="comments-on-method">w</section>'
        '<h3 id="search">Search</h3><section id="related">v</section><p class="notice">Closed on Monday</p><div id="comments">first!</div></article>'
    )
    rows = [(0, "http://one.example/", page), *((k, "http://two.example/", page.replace("x", f"x{k}")) for k in (1, 2, 3, 4))]
    got = texts_of(spark, rows)
    assert got[0] == "Related work x y z w Search v"
    assert got[1] == "Related work x1 y z w Search v"  # though the rest is the same on all pages of the host
    rest = [(0, "http://one.example/", "<article><p>a</p><div class='odd'>b</div></article>"), *((k, "http://one.example/", f"<article><p>a{k}</p></article>") for k in range(1, 2_500))]
    assert texts_of(spark, rest)[0] == "a b"  # a place that hardly a page has, below the content


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<p title="the hidden treasure">a</p>b', "a b"),
        ("<a title='a hidden path' href=x>a</a> b", "a b"),
        ('<div data-id="comments">a</div><div data-role="menu">b</div><p data-class="ad">c</p>', "a b c"),
        ('<svg-icon name="x"></svg-icon><template-card>a</template-card>b', "a b"),
        ('<svg class="i"/>a<math/>b<svg viewBox="0 0 1 1"><path d="M0/>1"/><text>no</text></svg>c', "abc"),
        ('<iframe src="x"></iframe>a<script src=y></script>b<style>p{}</style>c', "abc"),
        ("<h2>Summary</h2><p>a</p><h2>References</h2>", "Summary a References"),
        ('<p class="side">a</p><p class="search">b</p><p class="reply">c</p><div class="side-by-side">d</div>', "a b c d"),
        ('<div class="comment-body">no</div><div class="fb-comments">no</div><p class="site-notice">no</p><div class="adWrapper">no</div><div class=google-ads>no</div><div id=disqus_thread>no</div>a', "a"),
        ('<p hidden>no</p><p style="color:red; display : none">no</p><p aria-hidden="true">no</p><p aria-hidden="false" style="display:block">a</p>', "a"),
        ("<p title='a > b' hidden=\"\">no</p>a", "a"),
    ],
)
def test_nothing_of_an_article_gets_lost(spark, inner, want):
    """On a page of its own, and on four pages of a host that all have it."""
    page = lambda k: f"<html><body><div class=menu>Home</div><article><h1>Head {k}</h1>{inner}<p>Body {k}</p></article><footer>f</footer></body></html>"
    rows = [(0, "http://alone.example/", page(0)), *((k, "http://many.example/", page(k)) for k in (1, 2, 3, 4))]
    assert texts_of(spark, rows) == {k: f"Head {k} {want} Body {k}" for k in range(5)}


def chosen(nodes):
    """choose() told anew: paths from the root, weights summed over all places below each."""
    below = lambda k: [j for j in nodes if j != wrappers.ROOT and nodes[j].parent == k]

    def inside(k):
        while k != wrappers.ROOT:
            k = nodes[k].parent
            if wrappers.is_main(nodes[k].label):
                return True
        return False

    def chars(k):
        return nodes[k].chars + sum(map(chars, below(k)))

    def has_main(k):
        return any(has_main(j) or wrappers.is_main(nodes[j].label) for j in below(k))

    def among(k):
        tag = nodes[k].label.split(" ")[0]
        if tag in wrappers.NEVER_TEXT or "!hidden" in nodes[k].label:
            return 0.0
        if wrappers.is_boiler(nodes[k].label, inside(k)):
            seen = nodes[k].pages >= wrappers.BOILER_PAGES and chars(k) >= wrappers.BOILER_CHARS * nodes[k].pages
            return (wrappers.BOILER_WEIGHT if seen or not inside(k) and tag not in wrappers.NOT_TEXT and has_main(k) else 0.0) * weight(k)
        return (wrappers.MAIN_WEIGHT if wrappers.is_main(nodes[k].label) and not inside(k) else 1.0) * weight(k)

    def weight(k):
        return nodes[k].chars + sum(map(among, below(k)))

    at, roots = wrappers.ROOT, set()
    if not weight(at):
        return roots
    while not (inside(at) or wrappers.is_main(nodes[at].label)):
        ways = sorted((k for k in below(at) if nodes[k].label != wrappers.TEXT), key=lambda k: (among(k), nodes[k].label))
        if not ways or among(ways[-1]) <= 0 or among(ways[-1]) * 3 < 2 * weight(at) * (1 - 1e-12):
            break
        best = ways[-1]
        if nodes[best].label.split(" ")[0] not in wrappers.CONTAINERS or nodes[best].most > 1 and not wrappers.is_main(nodes[best].label):
            break
        beside = [k for k in below(at) if k != best and (nodes[k].label.split(" ")[0] in wrappers.HEADINGS or wrappers.is_main(nodes[k].label))]
        roots |= {k for k in beside if not wrappers.is_boiler(nodes[k].label, inside(k))}
        at = best
    return roots | {at}


KINDS = ["div", "div class=x", "div class=menu", "p", "article", "nav", "h1", "section", "main", "div class=ads", "span", "form"]
branch = st.recursive(st.sampled_from(["one", "two words", "a longer text of seven words here"]), lambda inner: st.tuples(st.sampled_from(KINDS), st.lists(inner, max_size=4)), max_leaves=14)


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + " ".join(map(written, node[1])) + f"</{node[0].split()[0]}>"


@settings(max_examples=150, deadline=None)
@given(st.lists(branch, min_size=1, max_size=3))
def test_choice_against_brute_force(some):
    nodes = {}
    for page in map(written, some):
        wrappers.align(nodes, wrappers.parse(f"<body>{page}</body>").nodes)
    assert set(wrappers.choose(nodes)) == chosen(nodes)


class Plain(HTMLParser):
    """Element paths of the texts of well-formed pages, by another reader."""

    def __init__(self):
        super().__init__()
        self.path, self.found = [], Counter()

    def handle_starttag(self, tag, attrs):
        self.path.append(tag)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip():
            self.found[tuple(self.path)] += 1


tree = st.recursive(st.sampled_from(["one", "two ", "three"]), lambda inner: st.tuples(st.sampled_from(["div", "section", "ul", "blockquote"]), st.lists(inner, max_size=4)), max_leaves=12)


def render(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(render, node[1])) + f"</{node[0]}>"


@settings(max_examples=100, deadline=None)
@given(st.lists(tree, min_size=1, max_size=4))
def test_alignment_against_brute_force(pages):
    """Counts of each place, summed page by page by another reader; alignment doesn't depend on the order of the pages."""
    want_pages, totals = Counter(), []
    for p in map(render, pages):
        reader = Plain()
        reader.feed(p)
        reader.close()
        want_pages.update(set(reader.found))
        totals.append(p)

    def wrapper(of):
        nodes = {}
        for p in of:
            wrappers.align(nodes, wrappers.parse(p).nodes)
        return nodes

    nodes = wrapper(totals)
    got = {}
    for node in nodes.values():
        if node.label == wrappers.TEXT:
            path, up = [], node.parent
            while up:
                path.append(nodes[up].label)
                up = nodes[up].parent
            got[tuple(reversed(path))] = node.pages
    assert got == dict(want_pages)
    assert wrappers.pattern(nodes) == wrappers.pattern(wrapper(totals[::-1])) and "|" not in wrappers.pattern(nodes)


TAGS = ["div", "p", "ul", "li", "article", "nav", "b", "br", "table", "tr", "td", "h1", 'div class="ad"', "footer", "span class=ad"]
piece = st.one_of(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t.split()[0]}>" for t in TAGS]), st.sampled_from(["x", " ", "a &lt; b", "<", "&", "<!-- c -->", "<script>1<2</script>"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(piece, max_size=25).map("".join), min_size=1, max_size=5))
def test_any_page_can_be_read(some):
    nodes = {}
    for page in some:
        wrappers.align(nodes, wrappers.parse(page).nodes)
    roots = set(wrappers.choose(nodes))
    for page in map(wrappers.parse, some):
        assert {k for k, _ in page.blocks} <= set(nodes)
        text = wrappers.extract(page, roots, set())
        assert text == " ".join(text.split())
