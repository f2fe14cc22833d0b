import html as entities
import math
import re

from siftwire.llm import dom, queries, style_tree
from siftwire.llm.dom import parse


def plain_article(html):
    """The article of the given pages, cut out by patterns."""
    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def texts(page):
    keep, _ = page.kept()
    return [t for i, t in page.blocks if keep[i]]


def test_given_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    out = queries.QUERIES["op11_style_tree_text"](spark, small).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_markup():
    html = """<!DOCTYPE html><title>a < b</title><body class="no-sidebar"><header><h1>Site</h1></header><div class="Cookie-Notice">We use</div>
    <article><header><h1>Ti&shy;tle &amp &lt;b&gt;</h1></header><p>One<br>two <b>bold<p>three&nbsp;four <span class=ad>buy</span>five
    <script>if (a</b) document.write("<p>no</p>")</script><ul><li>six<li>seven</ul><table><tr><td>eight<td>nine</table>
    <aside>aside</aside><form><p>form</p></form><div id="comments"><article><p>me too</p></article></div>10 < 11 <3 &am<!-- x > y -->z
    <p title="a > b">quoted</p><footer>signed</footer></article><p>outside</p><div class='sidebar'>more</div><footer>end</footer>"""
    assert texts(parse(html)) == [
        "Ti\xadtle & <b>", "One two bold", "three four five", "six", "seven", "eight", "nine", "10 < 11 <3 &amz", "quoted",
    ]
    assert texts(parse("<main><p>a</p><nav>n</nav></main>b")) == ["a"]
    assert texts(parse("<div class='siteMenus'>m</div><div id=page-notices>n</div><div class='has-sidebar news'>kept</div>")) == ["kept"]
    assert texts(parse("plain text")) == ["plain text"] and texts(parse(None)) == texts(parse("")) == []
    for rest in ("<p class='x", "<!-- x", "<script>x</p>", "<!doctype", "</p"):
        assert texts(parse("<p>kept</p>" + rest)) == ["kept"]
    assert texts(parse("<p>kept <")) == ["kept <"] and texts(parse("<!-->a<!--->b<p>c")) == ["ab", "c"]


def test_long_odd_markup_stays_linear():
    for part in ('<a "', "<div><p>", "</i><b>", "<p><td><div>", "<!--", "<li><ul>", "&am", "<x =", "<table><tr><td>", "<article><b>"):
        parse(part * 30_000)


def site(n, shared_path=True):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(n):
        body = "".join(f"<p>{words[i % 10]} text {i} {j} of its own</p>" for j in range(2 + i % 3))
        rows.append((i, f"http://Site.example/{i}", f"<div class=top><p>Welcome to the site</p><p>Since 1999</p></div><div class=story><h2>Story {i}</h2>{body}</div><div class=end><p>All rights</p></div>"))
    return rows


class Plain:
    """The style tree, merged recursively page by page."""

    def __init__(self):
        self.pages, self.styles, self.leaf = 0, {}, {}
        self.runs, self.leaf_pages = {}, 0

    def add(self, page, nodes, shown):
        self.pages += 1  # nodes: those of one page that stand at this place
        per_style = {}
        for i in nodes:
            key = []
            for c in page.nodes[i].children:
                name = page.nodes[c].name
                if key and key[-1][0] == name:
                    key[-1][1].append(c)
                else:
                    key.append((name, [c]))
            per_style.setdefault(tuple((n, len(o)) for n, o in key), []).append((i, [o for _, o in key]))
        for style, found in per_style.items():
            self.styles[style] = self.styles.get(style, 0) + 1
            if not style:
                self.leaf_pages += 1
                own = [x for i, _ in found for x in shown.get(i, [])]
                for x in set(own):
                    self.leaf.setdefault(x, []).append(own.count(x))
            for n in range(len(style)):
                child = self.runs.setdefault((style, n), Plain())
                child.add(page, [c for _, runs in found for c in runs[n]], shown)

    def importance(self, page, i, low_pages):
        if self.pages < low_pages:
            return 1.0
        shares = [n / self.pages for n in self.styles.values()]
        own = -sum(p * math.log(p) for p in shares) / math.log(self.pages)
        children = page.nodes[i].children
        key, groups = [], []
        for c in children:
            name = page.nodes[c].name
            if key and key[-1][0] == name:
                key[-1][1] += 1
                groups[-1].append(c)
            else:
                key.append([name, 1])
                groups.append([c])
        style = tuple(map(tuple, key))
        if children:
            parts = [self.runs[style, n].importance(page, c, low_pages) for n, g in enumerate(groups) for c in g]
            below = sum(parts) / len(parts)
        elif self.leaf_pages < low_pages:
            below = 1.0
        else:
            spread = [-sum(n / sum(c) * math.log(n / sum(c)) for n in c) / math.log(self.leaf_pages) for c in self.leaf.values()]
            below = max(0.0, 1 - sum(spread) / len(spread)) if spread else 0.0
        weight = style_tree.GAMMA ** len(self.styles)
        return (1 - weight) * max(0.0, own) + weight * below


def test_tree_equals_recursive_merge(spark):
    rows = site(9)
    rows += [(20 + i, "http://site.example/x", f"<div class=top><p>Welcome to the site</p><a href=/a>{i}</a><img src=/{i % 2}></div><p>x</p>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = {r.place: (r.importance, r.n_styles) for r in style_tree.tree(pages).collect()}
    root, parsed = Plain(), [parse(h) for *_, h in rows]
    for page in parsed:
        shown = {i: list(n.marks) for i, n in enumerate(page.nodes)}
        for i, text in page.blocks:
            shown[i].append(text)
        root.add(page, [0], shown)
    for page in parsed:
        got = style_tree.branch_importance(page, "site.example", known)
        assert math.isclose(got[0], root.importance(page, 0, style_tree.MIN_PAGES), abs_tol=1e-9)


def test_template_branches_go(spark):
    rows = site(12) + [(50, "http://other.example/", site(1)[0][2]), (51, None, "<p>no host"), (52, "http://site.example/e", None), (53, "x", "")]
    rows += [(None, "http://copies.example/", "<div><p>one text</p></div>")] * 5
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string").selectExpr("*", "1 as site", "2 as row")
    out = style_tree.main_text(pages)
    assert out.columns == [*pages.columns, "main_text", "by_tree", "low_branches"]
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append((r.main_text, r.low_branches))
    for i in range(12):
        words = [f"Story {i}", *re.findall(r"<p>(.*?)</p>", rows[i][2])[2:-1]]
        assert got[i] == [("\n\n".join(words), 2)]
    assert got[50][0][0].startswith("Welcome") and got[51] == [("no host", 0)] and got[52] == [("", 0)] and got[53] == [("", 0)]
    assert got[None] == [("one text", 0)] * 5
    assert style_tree.main_text_digest(pages.limit(0)).count() == 0


def test_pages_that_name_their_article_ask_the_tree(spark):
    teaser = "<article class=offer><p>Join our club</p></article>"
    rows = [(i, "http://a.example/x", f"<article><h1>News</h1><p>story {i}</p><p>as ever</p></article>{teaser}") for i in range(6)]
    rows += [(10 + i, "http://b.example/x", "<article><p>one copy</p></article>") for i in range(4)]
    out = {r.page_id: r for r in style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert (out[i].main_text, out[i].by_tree, out[i].low_branches) == (f"News\n\nstory {i}\n\nas ever", True, 1)
    for i in range(10, 14):
        assert (out[i].main_text, out[i].by_tree, out[i].low_branches) == ("one copy", True, 0)


def test_names_are_split_once_for_all_elements_that_have_them():
    dom._named.cache_clear()
    long = "side-bar " * 100
    page = dom.parse(f'<div class="site-header">x</div>{"<p class=lead>y</p>" * 50}<p class="no-header" id="lead">z</p><p class="{long}">w</p>' * 2)
    assert dom._named.cache_info()[:2] == (2 * 53 - 3, 3)
    assert [n.role for n in page.nodes[1:54]] == [dom.NOISE, *[dom.OPEN] * 51, dom.OPEN]
    assert dom.parse('<p class="{}">w</p>'.format("sidebar " * 100)).nodes[1].role == dom.NOISE
