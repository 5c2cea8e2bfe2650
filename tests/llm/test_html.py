import math
import random
import time
from collections import Counter, defaultdict

import pytest

from signet.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:y}</style><script>var a="</p><p>no</p>";</script></head>
<body class="home"><header class="masthead"><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div><div class="ad">Buy</div><form><p>Name<input></p></form>
<article class="post"><header><h1>Head &amp; <i>more</i></h1></header><p><b>One   two&nbsp;&eacute;&#x41;<br>three<p>Four
five<ul><li>Item 1<li>Item 2</ul><aside>No</aside><div class="ad-slot">Buy</div><p hidden>hidden</p><footer>By us</footer></b></p>
<section class="reader-comments"><p>Reader says</p></section></article><!-- <p>gone</p> --><footer>&copy; all"""


def test_one_page_with_every_kind_of_frame():
    assert H.main_text(PAGE, None) == "Head & more\n\nOne two éA three\n\nFour five\n\nItem 1\n\nItem 2"


@pytest.mark.parametrize(
    ("html", "text"),
    [(None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"), ("<p>a <b>b</b><i>c</i></p>", "a bc"), ("<script>x", ""), ("a < b <p>c", "a < b\n\nc"), ("<td>x</td></article></p><p>y", "x\n\ny"), ("<!-- a", ""), ("<p>" + "w " * 100_000, ("w " * 100_000).strip())],
)
def test_small_and_broken_pages(html, text):
    assert H.main_text(html, None) == text


def site(rng, n, kind):
    rows = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choice('abcdefgh') * 3 + str(rng.randrange(99)) + rng.choice('xyz') for _ in range(20))}</p>" for _ in range(rng.randrange(1, 5)))
        rows.append((i, f"http://{kind}.example/p{i}", f'<body><div class="q1"><p>Welcome to the site, visit {i}</p><ul><li>Home</ul></div><div class="q2"><p>{"tail " * 3}</p></div><div class="q3">{body}</div></body>', 0))
    return rows


def plain_importance(rows, name):
    """Of (host, html) rows each node's pages and importance, by loops over whole trees."""
    pages, styles, feats, ups = defaultdict(set), defaultdict(Counter), defaultdict(Counter), {}
    for site, html in sorted(set(rows)):
        blocks, tree = H.outline(html)
        for node, style in tree.items():
            key = (name(site), node)
            pages[key].add((site, html))
            styles[key][frozenset(style.keys)] += 1
            ups[key], at = {node}, style.up
            while at is not None:
                ups[key].add(at)
                at = tree[at].up
        for node, text in {(b[0], "".join("0" if c.isdigit() else c for c in b[3]).replace("00", "0").lower()) for b in blocks}:
            feats[name(site), node][text] += 1
    found = {}
    for key, own in pages.items():
        m = len(own)
        shown = sum(-c / m * math.log(c / m) for c in styles[key].values()) / math.log(m) if m > 1 else 1
        below = [k for k in pages if k[0] == key[0] and key[1] in ups[k]]
        every = sum(c for k in below for c in feats[k].values())
        known = sum(c * math.log(c) / math.log(len(pages[k])) if len(pages[k]) > 1 else 0 for k in below for c in feats[k].values())
        weight = 0.9 ** (1 + max(len(ups[k]) for k in below) - len(ups[key]))
        found[key] = (m, (1 - weight) * shown + weight * (1 - known / every if every else 1))
    return found


def test_importance_is_that_of_the_whole_tree(spark):
    rows = site(random.Random(1), 30, "a") + site(random.Random(2), 1, "b")
    rows += rows[:10]
    got = {(r.host, r.node): (r.pages, r.importance) for r in H.importance(spark.createDataFrame(rows, "page_id long, url string, html string, noise int")).collect()}
    given = [(url.split("/")[2], html) for _, url, html, _ in rows]
    own, every = plain_importance(given, lambda site: site), plain_importance(given, lambda site: "")
    assert got.keys() == own.keys()
    for (host, node), (m, value) in own.items():
        n, known = every["", node]
        known = (n * known + 8 * 0.9) / (n + 8)
        assert got[host, node] == (m, pytest.approx((m * value + 8 * known) / (m + 8), abs=1e-9))


def test_repeated_branches_go_and_unique_ones_stay(spark):
    rows = site(random.Random(3), 40, "a") + [(900, None, None, 0), (901, "no url", "", 0), (None, "http://a.example/z", "<p>lone", 0)]
    copies = [(1000 + i, f"http://copies.example/{i}", f"<nav>x</nav><article><p>same article text</p></article><p>{i}</p>", 0) for i in range(20)]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string, noise int")).collect()}
    assert len(got) == len(rows) + len(copies)
    for page_id, _, html, _ in rows[:40]:
        want = [x.partition("</p>")[0] for x in html.partition("q3")[2].split("<p>")[1:]]
        assert got[page_id].text == "\n\n".join(want) and got[page_id].n_chars == len(got[page_id].text)
    assert got[900].text == got[901].text == "" and got[None].text == "lone"
    assert all(got[c[0]].text == "same article text" for c in copies)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "frame",
    [
        "<body class='single right-sidebar'>{}</body>",
        "<html class='js cookies'><body>{}</body></html>",
        "<main class='content has-sidebar'>{}</main>",
        "<article class='post comments-open'>{}</article>",
        "<div id='page' class='no-banner'>{}</div>",
        "<div class='right-sidebar'><main>{}</main></div>",
        "<div class='sidebar-layout'><article>{}</article></div>",
        "<form id=aspnet><header>Site</header><nav>Menu</nav><div>{}</div></form>",
        "<form><div>{}</div></form>",
        "<div class='sidebar'><div>{}</div></div>",
    ],
)
def test_ordinary_wrappers_keep_the_text(frame):
    page = "<h1>Head</h1><p>One two</p><div class='site-footer'>Foot</div>" if "form><div" not in frame and "'sidebar'" not in frame else "<h1>Head</h1><p>One two</p>"
    assert H.main_text(frame.format(page), None) == "Head\n\nOne two"


def test_marked_nodes_go_beside_the_text():
    lists = "<div id=comments><article class=comment-body>Reader</article></div><div class=related-posts><article>Teaser</article></div><div class=left-sidebar>Side</div><form>Search</form>"
    assert H.main_text(f"<article>Text</article>{lists}", None) == H.main_text(f"<p>Text{lists}", None) == "Text"


def test_importance_decides_where_words_take_all_but_noise():
    page = "<div class=q>tail</div><div class=sidebar><p>Text</p><div class=q>tail</div></div>"
    noise = {node for node, style in H.outline(page)[1].items() if style.keys == set() and "tail" in {b[3] for b in H.outline(page)[0] if b[0] == node}}
    assert len(noise) == 2 and H.main_text(page, noise) == "Text"


def test_words_of_an_article_are_not_enough():
    page = "<article><p class='related-work'>a</p><h2 id='social'>b</h2><div id='alert-fatigue'>c</div><section id=search-methods>d</section><p class=comment-intro>e</p><div class=ad>x</div></article>"
    assert H.main_text(page, None) == "a\n\nb\n\nc\n\nd\n\ne"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_the_tree_decides_within_and_outside_of_articles(spark):
    rng, rows, want = random.Random(4), [], {}
    for i in range(60):
        text = [words(rng, 12) for _ in range(rng.randrange(2, 7))]
        related = words(rng, 9)
        body = "".join(f"<p>{t}</p>" for t in text)
        frame = f"<div class=x1>Welcome to all of us</div><article>{body}<p class=related-work>{related}</p><div class=box>Read on at our shop {i}</div><div class=ad>{words(rng, 6)}</div></article><div class=promo>{words(rng, 5)}</div>"
        rows.append((i, f"http://{'big' if i < 40 else f's{i}'}.example/{i}", frame))
        want[i] = "\n\n".join([*text, related])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, off = ({r.page_id: r.text for r in H.extract(pages, tree=tree).collect()} for tree in (True, False))
    assert got == want
    assert all(off[i] != want[i] for i in want)


def test_deep_nesting_and_broken_quotes(spark):
    deep = "<div class=q>" * 50_000 + "deep" + "</div>" * 50_000
    broken = '<p title="x>one</p>' + "<p a='x" * 3000
    rows = [(1, "http://d.example", deep), (2, "http://d.example", '<p title="x>one'), (3, "http://d.example", broken), (4, "http://d.example", "<p title=it's>a</p><p>b"), (5, "http://d.example", "<form><div class=nav>" * 20_000 + "<h1>x")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep" and got[2] == "one" and got[3].startswith("one") and got[4] == "a\n\nb" and 5 in got
    assert max(len(style.ups) for style in H.outline(deep)[1].values()) == H.DEEP


@pytest.mark.parametrize("html", ["<div class=comments><p>Reader says</p></div>", "<div id=cookie-notice>We use cookies</div>", "<body><section class='comment-list'><article>Me too</article></section></body>", "<div class=newsletter><form>Sign up</form></div>", "<div class=sidebar><div class=reply>Reader</div></div>"])
def test_comments_and_notices_alone_are_no_text(html):
    assert H.main_text(html, None) == ""


def test_words_of_frames_within_an_article_ask_the_tree(spark):
    page = "<article><p>Head</p><div class=menu>Soup and bread</div><div class=search-results>Found</div></article>"
    assert H.main_text(page, None) == "Head\n\nSoup and bread\n\nFound"
    rng = random.Random(8)
    rows = [(i, f"http://m.example/{i}", f"<article><p>{words(rng, 12)}</p><div class=menu><a>Home</a><a>About</a></div><div class=reply>{words(rng, 8)}</div></article>") for i in range(40)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted(r[2].partition("<p>")[2].partition("</p>")[0] for r in rows)


def test_controls_within_a_paragraph():
    assert H.main_text("<p>Press <button class=x>Go</button> now <select><option>a<option>b</select>or later</p>", None) == "Press now or later"
    assert H.main_text("<p>a <button>never closed <p>b", None) == "a"


def test_adverts_go_at_any_depth(spark):
    """The same advert below 2 and below 100 nodes, on pages of one site; sums over levels agree with loops."""
    rng, rows = random.Random(9), []
    for i in range(30):
        deep = 2 if i % 2 else 100
        rows.append((i, "http://deep.example/", "<body>" + "<div class=w>" * deep + f"<p>{words(rng, 12)}</p><div class=ad>{words(rng, 5)}</div>" + "</div>" * deep + "</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got == {i: html.partition("<p>")[2].partition("</p>")[0] for i, _, html in rows}
    found = {(r.host, r.node): r.importance for r in H._weighed(H.observed(pages).groupBy("host", "node", "kind", "mark").agg(*(H.F.max(c).alias(c) for c in ("ups", "more", "root", "bar")), H.F.countDistinct("page").alias("n")), ["host"]).collect()}
    want = plain_importance([("deep.example", html) for _, _, html in rows], lambda site: site)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v, abs=1e-9) for k, (_, v) in want.items())


def test_time_grows_with_the_page():
    for page in ("<span class=ad>{0}<p>x{0}", "<b class=ad><div>{0}", "<div class=q>{0}", "<button>{0}"):
        took = []
        for n in (4000, 32_000):
            html = page.replace("{0}", "<span class=ad>" * n if "b class" in page else "") + "</b>" * n if "b class" in page else page.split("{0}")[0] * n + "<p>x" * n
            began = time.perf_counter()
            H.outline(html)
            took.append(time.perf_counter() - began)
        assert took[1] < 24 * took[0] + 1  # eight times the page; squares would be sixty-four


#: Pages as sites of different make write them, and their text by hand.
BY_HAND = [
    ("<html><head><title>A</title></head><body class=home><div id=top><ul class=nav><li>Home<li>News</ul></div><div id=content><h1>Rain ahead</h1><p>It will <b>rain</b> on Monday.</p><p>Take a coat &amp; hat.</p><div class=share-bar>Share this</div></div><div id=footer>Imprint</div></body></html>", "Rain ahead\n\nIt will rain on Monday.\n\nTake a coat & hat."),
    ("<body><header>Shop</header><main><h2>Tea</h2><p>Green tea from the hills.<br>Fresh.</p><table><tr><td>Weight<td>100 g</table><p>Ask us <button>Chat</button> any time.</p></main><aside>Related</aside><div class='comments'><p>Great tea!</p></div><footer>(c)</footer></body>", "Tea\n\nGreen tea from the hills. Fresh.\n\nWeight\n\n100 g\n\nAsk us any time."),
    ("<body><div class=cookie-banner>Cookies?</div><article><h1>On menus</h1><p>A menu tells a story.</p><div class=menu>Soup, bread, pears</div><blockquote>Eat well</blockquote><section class=reader-comments><p>Yum</p></section></article></body>", "On menus\n\nA menu tells a story.\n\nSoup, bread, pears\n\nEat well"),
    ("<body><form id=f><header>Portal</header><nav>Menu</nav><div><h1>Notice of works</h1><p>The bridge closes in May.</p></div></form></body>", "Notice of works\n\nThe bridge closes in May."),
    ("<body><nav>x</nav><div class=sidebar>About me</div><div class=post><h1>Day one</h1><p>We left early &mdash; and late.<p>Rain.<ul><li>Bag<li>Map</ul></div><script>var x='<p>no</p>'</script><div class=login><form>Name</form></div>", "Day one\n\nWe left early \u2014 and late.\n\nRain.\n\nBag\n\nMap"),
]


def test_words_agree_with_texts_taken_by_hand():
    same = found = wanted = 0
    for html, text in BY_HAND:
        got, want = Counter(H.main_text(html, None).split()), Counter(text.split())
        same, found, wanted = same + (got & want).total(), found + got.total(), wanted + want.total()
    assert 2 * same / (found + wanted) > 0.97
