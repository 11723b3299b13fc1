"""Page differencing: blocks, alignment, neighbours, tables, odd pages."""

import contextlib
import io
import html
import os
import random
import re
import uuid

import pytest

from plotline.llm import html_pages, queries
from plotline.session import checkpoint_folder

FOLDER = "/root/testdata/sf0.01"


def test_blocks_and_states():
    page = """<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu<li>two</ul></nav><!-- <p>no</p> -->
    <div class="ad">buy</div><div id=main><article><h1>A &amp; B</h1><p>one<b>two</b>  three<br>four<p title="a>b">five &lt;x&gt; 3 < 4
    <script>var t="</p><p>x";</script><aside>side</aside><div class="userComments"><p>nice</p></div><ul><li>i<li>j</ul></article>
    <form>f</form>loose</div><footer>&copy; me</footer><p class=lead>tail <a href"""
    got = html_pages.lines(page)
    assert [t for t, s in got if s == "inside"] == ["A & B", "onetwo three", "four", "five <x> 3 < 4", "i", "j"]
    assert [t for t, s in got if s == "open"] == ["loose", "tail"]
    assert [t for t, s in got if s == "outside"] == ["menu", "two", "buy", "side", "nice", "f", "© me"]
    assert html_pages.lines("") == [] and html_pages.lines("<") == [("<", "open")]


@pytest.mark.parametrize(
    "page",
    [
        "<html class='nav-open'><body class='has-sidebar'><article class='post header-large'><p>one<p>two</article>",
        "<body id=menu><main role=banner><div class='header-large'><p>one</div><p>two</main>",
        "<article><p>one</p><svg width='1'/><iframe src='x'/><p>two</p></article>",
        "<article><p>one</p><button>buy<p>two</p></article>",
        "<article><p>one <select><option>a<option>b</p>two</article><footer><select><option>c</select></footer>",
        "<article><svg><svg><text>no</text></svg><p>no</p></svg><p>one</p><object data=x><div>two</div></article><script>var a='<svg>'",
    ],
)
def test_hints_of_holders_and_raw_elements_left_open(page):
    assert [t for t, s in html_pages.lines(page) if s == "inside"] == ["one", "two"]


def test_hints_as_last_parts_and_closed_raw_elements():
    page = "<article><p>one<div class='big site-footer'>no</div><div class=sidebar>no</div><ul role=navigation><li>no</ul><noscript><p>no</p></noscript><svg><p>no</p></svg><p>two</article>"
    assert [t for t, s in html_pages.lines(page) if s == "inside"] == ["one", "two"]
    # Many elements left open take one pass each name.
    assert html_pages.lines("<article>" + "<button>x<p>y</p>" * 20_000) == [("y", "inside")] * 20_000


def test_common_subsequence_is_longest():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_pages.common(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == best[-1][-1] and all(a[i] in rest for i in got)


@pytest.mark.parametrize("pieces", [1, 5, 40])
def test_shared_lines_go_where_no_article_is_marked(spark, pieces):
    rows = []
    for host in range(4):
        for n in range(6):
            body = f"<div>Top of {host}</div><div>own {host}.{n}</div><p>more {n}</p><div>Bottom of {host}</div>"
            rows.append((host * 10 + n, f"https://h{host}.example.com/a/{n}?q={n}", body))
    rows += [(90, "https://alone.example.com/x", "<p>all of it</p>"), (91, None, "<p>no address</p>"), (92, "http://[bad", "<p>no address</p>"), (93, "https://h0.example.com/a/5", None), (94, "https://h1.example.com/zz", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as row", "'x' as text")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.id: r.text for r in html_pages.extract(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    for host in range(1, 4):
        for n in range(6):
            assert got[host * 10 + n] == f"own {host}.{n} more {n}"
    assert (got[90], got[91], got[92], got[93], got[94]) == ("all of it", "no address", "no address", "", "")


def test_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.page_differences(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:h1|p|br)\b[^>]*>", article.replace("<b>", "").replace("</b>", ""))
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert sum(r.n_shared for r in got) > 0


def test_odd_tables(spark):
    rows = [(1, "http://a.b/c", "<p>" + "word " * 40_000), (1, "http://a.b/c", "<p>" + "word " * 40_000), (None, "http://a.b/d", "plain")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_pages.extract(frame).collect()
    assert sorted(len(r.text) for r in got) == [5, 199_999, 199_999]
    assert html_pages.extract(frame.limit(0)).count() == 0


def test_copies_and_near_copies_keep_their_text(spark):
    """A host with a page read under 400 addresses, repeated rows, and near copies between ordinary pages."""
    page = lambda own: "<div>Top</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Bottom</div>"
    rows, want = [], {}

    def add(url, own, text):
        rows.append((len(rows), url, page(own)))
        want[len(rows) - 1] = text

    for n in range(20):
        add(f"http://h.example.com/a/{n:03d}", [f"own {n}", f"more {n}"], f"own {n} more {n}")
    for n in range(400):
        add(f"http://h.example.com/b/x?visit={n}" if n % 2 else f"http://h.example.com/b/{n:03d}", ["read", "twice"], "read twice")
    story = [f"line {i}" for i in range(30)]
    for n in range(2):
        add(f"http://h.example.com/c/{n}", [*story, f"edited {n}"], " ".join([*story, f"edited {n}"]))
    add("http://h.example.com/c/2", ["last"], "last")
    add("http://k.example.com/1", ["alone"], "Top alone Bottom")
    add("http://k.example.com/1", ["alone"], "Top alone Bottom")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    folder = f"{checkpoint_folder(spark)}/copies-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    got = {r.id: r.text for r in html_pages.extract(spark.read.parquet(folder)).collect()}
    assert got == want


def test_pairing_against_brute_force(spark):
    """Shared lines of every page of a random site, against all pages of its host compared in order."""
    rnd = random.Random(8)
    rows = []
    for n in range(300):
        host, boiler = rnd.randrange(3), rnd.randrange(2)
        own = [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(6))]
        body = "".join(f"<p>{x}</p>" for x in [f"top {host} {boiler}", *own, f"end {host}", *(["more"] * boiler)])
        rows.append((n, f"http://h{host}.example.com/{rnd.randrange(9)}/{rnd.randrange(30)}?{n}", body))
    path = f"{checkpoint_folder(spark)}/site-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).sortWithinPartitions("page_id").write.parquet(path)
    got = {r.id: r.n_shared for r in html_pages.extract(spark.read.parquet(path)).collect()}
    outline = {n: (*html_pages.place(url), tuple(t for t, _ in html_pages.lines(body))) for n, url, body in rows}
    firsts = {}
    for n in sorted(outline, key=lambda n: (outline[n][1], n)):
        firsts.setdefault((outline[n][0], outline[n][2]), n)
    order = sorted(firsts.values(), key=lambda n: (outline[n][0], outline[n][1], n))
    for n, (host, _, own) in outline.items():
        first = firsts[host, own]
        at, best = order.index(first), []
        for beside in (at - 1, at + 1):
            if 0 <= beside < len(order) and outline[order[beside]][0] == host:
                other = outline[order[beside]]
                same = len(html_pages.common(list(own), list(other[2])))
                if same < 0.8 * (len(own) + len(other[2]) - same):
                    best.append((-len(os.path.commonprefix([outline[first][1], other[1]])), beside, same))
        assert got[n] == (min(best)[2] if best else 0)


def test_pages_do_not_move_with_their_markup(spark):
    """What is shared meets the blocks that may stay: pages are cut into blocks below that join, not above it."""
    rows = [
        (1, "http://h.x/a/1", "<div>top</div><div>one</div><div>end</div>"),
        (2, "http://h.x/a/2", "<div>top</div><div>two &amp; more</div><nav>menu</nav><div>end</div>"),
        (3, "http://h.x/a/3", "<div>top</div><article><p>top</p><p>three</p></article><div>end</div>"),
        (4, None, None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_pages.extract(frame)
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        found.explain()
    plan = buffer.getvalue()
    assert plan.index("Join") < plan.index("MapInArrow")
    got = {r.id: (r.text, r.n_lines, r.n_shared, r.n_restored) for r in found.collect()}
    assert got[1][0] == "one" and got[2][0] == "two & more"
    assert got[3] == ("top three", 4, got[3][2], got[3][3]) and got[4] == ("", 0, 0, 0)
