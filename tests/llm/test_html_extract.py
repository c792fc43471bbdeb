import itertools
import random

from larkspur.llm import html_extract as he


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in "ab")
        pairs = he.common(a, b)
        assert len(pairs) == lcs_length(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><article><h1>Head &lt;1&gt;</h1><p><b>One
 &amp;   two<br><p>Three<div class="share-box">Share <p>this</p></div><p>caf&eacute; &#8364;</p><form><p>Mail</p></form>
<aside>Side</aside><ul><li>x<li>y</ul><section class="comments"><p>I agree</p></section></article>
<div class="comments"><article class="comment"><p>First!</p></article></div><footer>&copy; me</footer></body></html>"""


def test_structure():
    kept = [t for t, kind in he.page_lines(PAGE) if kind]
    assert kept == ["Head <1>", "One & two", "Three", "café €", "x", "y"]


def test_pages_without_marks_are_differenced(spark, monkeypatch):
    def page(*lines):
        return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"

    rows = []
    for host in ("a.example", "b.example"):
        for i in range(40):
            rows.append((len(rows), f"http://{host}/en/{i:03}?x=1#y", page(f"Home of {host}", "Menu", f"text {host} {i}", "more", f"end {i}", "Imprint")))
    rows += [(900, None, page("alone")), (901, "http://c.example/", None), (902, "http://c.example/x", page("only one")), (903, "http://d.example/1", page("copy", "text")),
             (904, "http://d.example/2", page("copy", "text")), (None, "nonsense", "plain text"), (905, "http://c.example/y", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(he, "partitions", lambda spark: 7)
    got = {r["page_id"]: r["text"] for r in he.extract(df.repartition(5)).collect()}
    for i, (k, url, _) in enumerate(rows[:80]):
        host, n = url.split("/")[2], i % 40
        assert got[k] == f"text {host} {n}\nend {n}"
    assert got[900] == "alone" and got[901] == "" and got[902] == "only one" and got[905] == "" and got[None] == "plain text"
    assert got[903] == got[904] == "copy\ntext"


def test_articles_keep_what_they_share_and_lose_template(spark):
    def page(inner, below=""):
        return f"<body><div>Buy now</div><article>{inner}</article>{below}</body>"

    rows = [(1, "http://a/1", page("<p>Quote</p><p>one</p><p>Imprint</p>")), (2, "http://a/2", page("<p>Quote</p><p>two</p>", "<footer>Imprint</footer>"))]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Quote\none", 2: "Quote\ntwo"}


def test_main_parts_are_differenced_and_an_article_alone_decides(spark):
    def page(i):
        return f"<body><main><div>We use cookies</div><p>own text {i}</p><div>Read also</div></main></body>"

    both = "<body><main><p>Teaser</p><article><p>Story</p></article><p>Read also</p></main></body>"
    rows = [(i, f"http://a/{i}", page(i)) for i in range(4)] + [(9, "http://b/1", both)]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own text {i}" for i in range(4)}, 9: "Story"}


def test_empty(spark):
    assert he.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def kept(page):
    return [t for t, kind in he.page_lines(page) if kind]


def test_class_names_count_as_wholes_and_frames_do_not_hide_the_article():
    for opened in ('<div class="layout has-sidebar">', '<div class="content no-sidebar">', '<div class="sidebar-layout">', '<div class="page-wrapper sidebar-right">', "<div data-class='ad' title='class=\"ad\"'>"):
        assert kept(f"<body><nav>Menu</nav>{opened}<article><p>Main text</p></article><p>Below</p></div></body>") == ["Main text"], opened
    assert kept('<article><p>a</p><section id="related-work"><p>Related work</p></section><div class="related-posts"><p>More</p></div></article>') == ["a", "Related work"]
    assert kept('<div class="sidebar"><p>Side</p></div><p>Own text</p><div class="CommentList"><article><p>First!</p></article></div>') == ["Own text"]
    assert kept('<article><p>a</p></article><div class="widget"><article><p>Teaser</p></article></div>') == ["a"]
    assert kept('<p>Text</p><div id="cookie-banner">We use cookies</div><ul class="breadcrumbs"><li>Home</li></ul><div class="post-comments">Me too</div>') == ["Text"]


def test_blocks_end_paragraphs_and_items_end_items():
    assert kept('<p class="ad">Buy<div>Main text</div>') == ["Main text"]
    assert kept('<ul><li class="ad">Buy<li>Kept</ul><p>x') == ["Kept", "x"]
    assert kept('<table><tr class="ad"><td>Buy<tr><td>a<td>b</table>') == ["a b"]
    assert kept('<p class="ad">Buy <b>now</b></p><p>Text') == ["Text"]


def test_nested_inline_adverts_do_not_leak():
    assert kept('<p>a <span class="ad">x <span>y</span> LEAK</span> b</p>') == ["a", "b"]
    assert kept('<p>a <span class="ad">x <br><span>y <span>z</span></span> LEAK</span> b <span>c</span></p>') == ["a", "b c"]


def test_malformed_tags_end():
    assert kept("<p><a title='it's'>link</a> text</p>") == ["link text"]
    assert kept('<p><a title="a > b" href=x>link</a> <img alt="1 > 0">text</p><p>1 < 2 and 3 > 2</p>') == ["link text", "1 < 2 and 3 > 2"]
    assert kept('<p>open <a href="never ended>link</a> more</p>') == ["open link more"]
    assert kept("<!--> <p>a</p><!-- x --!><p>b</p></ p><script src='a>b'>if (a < b) '</p>'</script foo><p>c</p>") == ["a", "b", "c"]


def brute(rows):
    """The whole operator, page by page: structure, then the neighbours of a host in the order of paths."""
    import re

    hosts = {}
    for k, (_, url, page) in enumerate(rows):
        rest = re.sub("[?#].*$", "", re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", url or ""))
        if host := rest.split("/")[0].lower():
            hosts.setdefault(host, []).append((rest[len(host) :], k))
    lines = [he.page_lines(page) for *_, page in rows]
    out = [[t for t, kind in x if kind] for x in lines]
    for pages in hosts.values():
        assert len({p for p, _ in pages}) == len(pages)
        order = [k for _, k in sorted(pages)]
        gone = {k: set() for k in order}
        for a, b in itertools.pairwise(order):
            for me, you in ((a, b), (b, a)):
                pairs = he.common([t for t, _ in lines[me]], [t for t, _ in lines[you]])
                mine = [i for i, j in pairs if lines[me][i][1] and not lines[me][i][1] == lines[you][j][1] == 2]
                if len(mine) < sum(kind > 0 for _, kind in lines[me]):
                    gone[me] |= set(mine)
        for k in order:
            out[k] = [t for i, (t, kind) in enumerate(lines[k]) if kind and i not in gone[k]]
    return ["\n".join(x) for x in out]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for host in ("a.example", "B.example", "c.example"):
        template = [f"<div>{host} line {i}</div>" for i in range(6)]
        for i in range(35):
            body = [*rng.sample(template, rng.randint(1, 6)), *(f"<p>own {host} {i} {rng.randrange(50)}</p>" for _ in range(rng.randint(0, 4)))]
            rng.shuffle(body)
            if rng.random() < 0.3:
                body = ["<article>", *body, "</article>", *rng.sample(template, 2)]
            rows.append((len(rows), f"https://{host}/{rng.choice('pqr')}/{i}", "<html><body>" + "".join(body) + "</body></html>"))
    rows += [(900, None, "<p>x"), (901, "", "<p>y"), (902, "c.example", None), (903, "d.example/long", "<p>" + "word " * 200_000), (904, "d.example/longer", "<div>z</div>" * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, host string, rk int")
    monkeypatch.setattr(he, "partitions", lambda spark: 6)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in he.extract(df.repartition(4)).collect()}
    assert got == {k: (t, len(t)) for (k, *_), t in zip(rows, brute(rows))}


def test_repeated_rows(spark):
    rows = [(1, "http://a/x", "<p>one</p><p>two</p>")] * 3 + [(2, "http://a/y", "<p>one</p><p>three</p>")]
    got = sorted((r["page_id"], r["text"]) for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [g[0] for g in got] == [1, 1, 1, 2] and len({g[1] for g in got[:3]}) == 1
