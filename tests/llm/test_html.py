import random

import numpy as np

from lumaveil.llm import html as H


def text(page):
    return H.main_text(H.blocks(page))


def test_article_and_what_is_not():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
    <body><header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <article>x</article> --><div class="ad">Buy</div>
    <article><header><h1>Head &amp; tail</h1></header><p>One <b>two<br>three</p><p>Four&nbsp;five &lt;six&gt; 3 < 4 &am</p>
    <div class="ad-box">Advert</div><aside>Side</aside><form><label>Mail</label></form><ul><li>a<li>b</ul>
    <section id="comments"><p>First!</p></section><p>End &copy;</article><p>After</p><footer>&copy; 2020</footer></body></html>"""
    assert text(page) == "Head & tail\n\nOne two three\n\nFour five <six> 3 < 4 &am\n\na\n\nb\n\nEnd ©"


def test_broken_pages():
    assert text("<article><p>cut off &amp") == "cut off &"
    assert text("<nav><a>menu<article><p>x</p></article>") == "x"
    assert text('<article><a href="unclosed>y</a><p>z</p></article>') == "y\n\nz"
    assert text("<article><script>var a = 1;") is None
    assert text("<article>cut <a href='x") == "cut"
    assert text('<article><a title="a<b">y</a></article>') == "y"
    assert text("") is None and text("<p>plain</p>") is None
    assert text("<main><p>m</p><article><p>a</p></article></main>") == "a"
    assert text("<div role='main'><p>m</p></div>") == "m"
    assert text("<ARTICLE><P>Up</P></ARTICLE>") == "Up"


def test_long_pages_take_linear_time():
    for page in ("<" * 200_000, "<a " * 100_000, "<article>" + "<p>x" * 50_000, "<a href='" * 50_000, "&amp;" * 100_000, "<!--" * 50_000, "<div>x" * 50_000 + "</div>" * 50_000, "<a '" * 50_000 + ">"):
        H.blocks(page)


def test_runs_of_a_host():
    bar, note = "Home News About us today and every day of the week here", "Copyright notice of the whole site " * 3
    pages = [[bar, f"story{i} alpha{i} beta{i} gamma{i} delta{i}", note.strip(), "ok"] for i in range(6)]
    assert H.unique_runs(pages) == [f"story{i} alpha{i} beta{i} gamma{i} delta{i}" for i in range(6)]
    few = pages[:2]
    assert H.unique_runs(few) == ["\n\n".join(p) for p in few]
    assert H.unique_runs([["a b c d e f"], ["a b c d e f"], ["x y z"], []]) == ["a b c d e f", "a b c d e f", "x y z", ""]
    prose = [[f"it{i} was in the end of the day{i} that"] for i in range(9)]
    assert H.unique_runs(prose) == [p[0] for p in prose]
    assert H.unique_runs([]) == [] and H.unique_runs([[], [], []]) == ["", "", ""]


def brute_runs(pages, run, spread):
    """Covered words by a count of pages for every window and every whole short block."""
    seen = {}
    for i, page in enumerate(pages):
        for block in page:
            w = block.split()
            for key in [tuple(w[k : k + run]) for k in range(len(w) - run + 1)] or [tuple(w)]:
                seen.setdefault(key, set()).add(i)
    least = max(3, -(-int(spread * 100) * len(pages) // 100))
    out = []
    for page in pages:
        kept = []
        for block in page:
            w = block.split()
            gone = set()
            for k in range(max(1, len(w) - run + 1)):
                if len(pages) >= 3 and len(seen[tuple(w[k : k + run])]) >= least:
                    gone |= set(range(k, min(len(w), k + run)))
            left = " ".join(x for k, x in enumerate(w) if k not in gone)
            if left:
                kept.append(left)
        out.append("\n\n".join(kept))
    return out


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(3)
    for case in range(60):
        run, spread = rng.choice([2, 3, 12]), rng.choice([0.2, 0.5])
        shared = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(4)]
        pages = [[rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 18))) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(0, 12))]
        want = brute_runs(pages, run, spread)
        for piece in (1 << 20, 30):  # all at once, and long blocks in parts
            monkeypatch.setattr(H, "PIECE", piece)
            assert H.unique_runs(pages, run, spread) == want, case


def test_names_that_only_look_like_furniture():
    page = '<article><p id="form-follows-function">a</p><p class="social-science">b</p><h2 id="comments">c</h2><section id="search-theory">d</section><div class="social-share">no</div></article>'
    assert text(page) == "a\n\nb\n\nc\n\nd"
    assert text('<body class="has-sidebar ad"><article><p>x</p></article></body>') == "x"
    assert H.blocks('<body class="sidebar"><p>x</p></body>') == [("", "x")]


def test_articles_inside_what_is_left_out():
    page = '<article><p>x</p></article><ul><li class="comment"><article><p>reader</p></article></li></ul><aside><article><p>teaser</p></article></aside><article class="teaser"><p>t</p></article>'
    assert text(page) == "x"
    assert text("<aside><p>s</p><article><p>t</p></article></aside><article><p>x</p></article>") == "x"
    assert text("<div class=menu><a>m</a><article><p>x</p></article>") == "x"


def test_comments_hidden_elements_and_marks_in_scripts():
    assert text("<article><!-- c --!><p>x</p><!--> <p>y</p><!---><p>z</p></article>") == "x\n\ny\n\nz"
    assert text('<article><div hidden><p>h</p></div><div style="Display: none">n</div><p>x</p></article>') == "x"
    page = '<script type="application/ld+json">{"articleBody": "q"}</script><!-- <article>x</article> --><article></article><p>only</p>'
    assert text(page) is None and H.host_texts([H.blocks(page)]) == ["only"]


def test_query(spark):
    rows = [(1, "http://a.example/1", "<article><p>x é</p></article>", 5), (2, None, None, 5), (3, "bad url", "<p>only this</p>", 5), (1, "http://a.example/1", "<article><p>x é</p></article>", 5)]
    rows += [(10 + i, f"https://h.example/{i}", f"<div>Top bar of the site here</div><p>words{i} of{i} page{i}</p>", 0) for i in range(150)]
    got = H.op9(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 154 and all(r.n_chars == len(r.text) for r in got)
    of = {r.page_id: r.text for r in got}
    assert of[1] == "x é" and of[2] == "" and of[3] == "only this"
    assert all(of[10 + i] == f"words{i} of{i} page{i}" for i in range(150))
    assert H.op9(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_attributes():
    for n in (900, 1001, 50_000):
        for value in ("c" * n, "<b>" * (n // 3), "a > b " * (n // 6)):
            page = f"<article><p>x</p><div class='advert' data-c=\"{value}\">Buy</div></article>"
            assert text(page) == "x", (n, value[:9])
            assert text(f"<div data-c='{value}' itemprop=articleBody><p>y</p></div>") == "y"
    assert text("<article><p data-x='class=\"advert\"' data-role=menu>z</p></article>") == "z"


def test_quotes_without_end_take_linear_time():
    for page in ("<a b=\"" + "<a '" * 100_000, "<a \"'\"'" * 50_000, "<a '\"" * 50_000, "<a x='" + "y" * 300_000, "<a \"<a '\" '" * 50_000):
        H.blocks(page)


def test_boilerplate_is_of_the_whole_host_however_it_is_dealt(spark, monkeypatch):
    rng = random.Random(8)
    bars = [(" ".join(f"bar{k}w{j}" for j in range(3 + 4 * k)), p) for k, p in enumerate([0.1, 0.17, 0.19, 0.2, 0.21, 0.23, 0.3, 0.6])]
    pages = [[b for b, p in bars if rng.random() < p] + [" ".join(f"w{rng.randrange(10**9)}" for _ in range(20))] for _ in range(90)]
    sure = [rng.random() < 0.3 for _ in pages]  # these count, and keep their text
    want = ["\n\n".join(page) if s else left for page, s, left in zip(pages, sure, brute_runs(pages, 12, 0.2))]
    rows = [(i, f"http://h.example/{i}", ("<article>" if s else "") + "".join(f"<p>{b}</p>" for b in page)) for i, (page, s) in enumerate(zip(pages, sure))]
    table = spark.createDataFrame(rows + rows[:9], "page_id long, url string, html string")
    for group, size, fewest in ((2, 1 << 20, 1), (8, 1 << 20, 1), (64, 1000, 16)):  # alone, some, long pages
        monkeypatch.setattr(H, "GROUP", group)
        monkeypatch.setattr(H, "GROUP_BYTES", size)
        monkeypatch.setattr(H, "FEWEST", fewest, raising=False)
        got = H.op9(table).collect()
        assert len(got) == 99 and all(r.text == want[r.page_id] for r in got), (group, size)


def test_runs_of_groups_are_those_of_the_host():
    rng = random.Random(4)
    for case in range(40):
        run = rng.choice([2, 3, 12])
        pages = [[" ".join(rng.choice("abc") for _ in range(rng.randint(1, 18))) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(3, 25))]
        groups = [pages[k::4] for k in range(4)]
        keys = np.unique(np.concatenate([H.frequent(H.words_of(g), H.share(len(g)), run) for g in groups if g]), axis=0)
        keys = keys[sum(H.pages_with(H.words_of(g), keys, run) for g in groups) >= max(3, H.share(len(pages)))]
        assert H.without(pages, keys, run) == brute_runs(pages, run, 0.2), case


def test_ids_beside_a_null_are_exact(spark):
    big = 2**60
    rows = [(None, None, "<p>a</p>"), (big, None, "<p>b</p>"), (big + 1, None, "<p>b</p>"), (big + 2, None, "<p>b</p>")]
    got = H.op9(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert {(r.page_id, r.text) for r in got} == {(None, "a"), (big, ""), (big + 1, ""), (big + 2, "")}
