import itertools
import os
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import html

PAGE = "page_id long, url string, html string"


def length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_common_subsequence(a, b):
    for cells in (1 << 26, 8):
        got = html.common(a, b, cells)
        rest = iter(b)
        assert len(got) == length(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="search-on"><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><!-- x > y --><article><h1>A &amp; B</h1><p>One <b>two</b><br>three&nbsp;four<p>Five <i>six
    </i> seven</p><div class="share-box"><p>Share</p></div><form>Mail <input></form><blockquote>Quote</blockquote><section id="comments"><article class="comment"><p>Nice!</p></article></section></article>
    <aside>Side</aside><footer>&copy;</footer></body></html>"""
    lines = html.blocks(page)
    assert [x for x, s in lines if s == html.ARTICLE] == ["A & B", "One two three four", "Five six seven", "Quote"]
    assert html.own_standing(lines) == html.ARTICLE
    assert html.blocks("") == [] and [x for x, _ in html.blocks("a < b & c &lt; d")] == ["a < b & c < d"]


def test_siblings_lose_their_shared_lines(spark):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(6))
    frame = ["Home of things", "All rights kept"]
    pages, own = [], {}
    for i in range(12):
        own[i] = [line() for _ in range(3)]
        pages.append((i, f"http://h.example/a/{i}", "<body>" + "".join(f"<div>{x}</div>" for x in [frame[0], *own[i], frame[1]]) + "</body>"))
    pages.append((50, "http://lone.example/x", "<body><p>Home of things</p><p>Own</p></body>"))
    pages.append((51, "http://h.example/a/3?page=2", pages[3][2]))
    pages += [(60, None, "<p>no address</p>"), (61, "http://h.example/z", None), (62, "", ""), (50, "http://lone.example/x", "<body><p>Home of things</p><p>Own</p></body>")]
    got = html.main_text(spark.createDataFrame(pages, PAGE)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert all(text[i] == "\n".join(own[i]) for i in own) and text[51] == text[3]
    assert text[50] == "Home of things\nOwn" and text[60] == "no address" and text[61] == "" and text[62] == ""


def test_copies_of_a_page_stay(spark):
    body = "<body>" + "".join(f"<p>line number {i}</p>" for i in range(8)) + "</body>"
    got = html.main_text(spark.createDataFrame([(1, "http://h.example/a", body), (2, "http://h.example/b", body)], PAGE)).collect()
    assert all(r.text.count("\n") == 7 for r in got)
    assert html.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_names_of_frame_parts_and_other_classes():
    page = """<article><h1>T</h1><p class="social-science">Society</p><div class="search-for-meaning"><p>Meaning</p></div><p id="ad-hoc-notes">Notes</p>
    <div class="ad-slot-3">Buy</div><div class="post comments">Nice</div><div class="cookie-notice">Cookies</div></article>"""
    assert [x for x, s in html.blocks(page) if s == html.ARTICLE] == ["T", "Society", "Meaning", "Notes"]


def test_shared_lines_inside_main_go(spark):
    """Pairing, alignment and deletion against a plain computation over all pages of a host."""
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(6))
    notes = [line() for _ in range(4)]
    pages, lines = [], {}
    for i in rng.sample(range(1000), 40):
        lines[f"/s{i % 3}/{i}"] = [*rng.sample(notes, 1), *(line() for _ in range(rng.randint(3, 6))), *rng.sample(notes, 1)]
        pages.append((i, f"http://h.example/s{i % 3}/{i}", "<nav>Menu</nav><main>" + "".join(f"<p>{x}</p>" for x in lines[f"/s{i % 3}/{i}"]) + "</main>"))
    order = sorted(lines)
    expected = {}
    for k, path in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        best = max(near, key=lambda q: (html.prefix(path, q), q < path))
        own, other = ["Menu", *lines[path]], ["Menu", *lines[best]]
        table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for i, x in enumerate(own):
            for j, y in enumerate(other):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        expected[path] = (table[-1][-1], set(other), len(own))
    gone = 0
    for r in html.main_text(spark.createDataFrame(pages, PAGE)).collect():
        path = r.url[len("http://h.example") :]
        kept, own = r.text.split("\n"), lines[path]
        n, other, _ = expected[path]
        dropped = [x for x in own if x not in kept]
        assert len(own) - len(kept) == n - 1 and set(dropped) <= other & set(notes)  # "Menu" is always shared
        gone += len(dropped)
    assert gone > 5


def test_unclosed_tags_are_read_in_linear_time():
    began = time.process_time()
    for page in ('<b "' * 1_250_000, "<script" * 500_000, "<![CDATA[" * 300_000, "<div>" * 100_000 + "</x>" * 100_000, "<b '\">x" * 200_000):
        html.blocks(page)
    assert time.process_time() - began < 60
    assert [x for x, _ in html.blocks('<p title="a>b">one</p><p title="x>two')] == ["one", "two"]


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "http://h.example/a", "<p>x</p>", "k", "d", "t", "h")]
    got = html.main_text(spark.createDataFrame(rows, PAGE + ", key string, drop string, text string, host string")).collect()
    assert [tuple(r) for r in got] == [(1, "http://h.example/a", "x", 1)]


def test_a_passage_that_articles_share_stays_in_both(spark):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(6))
    shared = line()
    pages = [(i, f"http://h.example/{i}", f"<p>Site</p><article><p>{line()}</p><p>{shared}</p><p>{line()}</p></article>") for i in range(4)]
    for r in html.main_text(spark.createDataFrame(pages, PAGE)).collect():
        assert r.text.split("\n")[1] == shared and r.text.count("\n") == 2


def test_pairing_and_deletion_against_brute_force(spark):
    """Lines come in one order on all pages, so their longest common subsequence is what two pages share."""
    rng = random.Random(11)
    pages, lines = [], {}
    for i in range(80):
        host, path = f"h{i % 3}.example", "/" + "/".join(rng.choices("abc", k=rng.randint(1, 4))) + f"/{i}"
        own = sorted(rng.sample(range(12), rng.randint(0, 6))) + [100 + 50 * i + k for k in range(rng.randint(0, 6))]
        lines[host, path] = own
        pages += [(n, f"http://{host}{path}", "<body><main>" + "".join(f"<p>line {x}</p>" for x in own) + "</main></body>") for n in ([i, 1000 + i] if i % 10 == 0 else [i])]
    want, less = {}, 0
    for n, url, _ in pages:
        host, path = url[7:].split("/", 1)
        path = "/" + path
        there = [p for h, p in lines if h == host and p != path]
        near = [max((p for p in there if p < path), default=None), min((p for p in there if p > path), default=None)]
        alike = [-1 if p is None else len(os.path.commonprefix([p, path])) for p in near]
        other = near[0] if alike[0] >= alike[1] else near[1]
        mine, theirs = lines[host, path], lines[host, other]
        both = set(mine) & set(theirs)
        keep = mine if 10 * len(both) >= 9 * max(len(mine), len(theirs)) or 2 * len(both) >= len(mine) else [x for x in mine if x not in both]
        less += len(keep) < len(mine)
        want[n] = "\n".join(f"line {x}" for x in keep)
    assert less > 10
    got = html.main_text(spark.createDataFrame(pages, PAGE).repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_containers_in_articles_against_brute_force(spark):
    """Without any class or id: a container goes if the sibling shares all its lines; what a container with own lines shares stays."""
    rng = random.Random(21)
    counter = itertools.count(10**6)
    source = lambda t: "".join(f"<{x[0]}>{source(x[1])}</{x[0]}>" if isinstance(x, tuple) else f"<p>line {x}</p>" for x in t)
    flat = lambda t: [y for x in t for y in (flat(x[1]) if isinstance(x, tuple) else [x])]

    def tree(deep, last):
        """Shared lines (below 100) come in one order on all pages, so the longest common subsequence is what two pages share."""
        out = []
        for _ in range(rng.randint(1, 4)):
            if deep and rng.random() < 0.5:
                out.append((rng.choice(("div", "section", "ul")), tree(deep - 1, last)))
            elif rng.random() < 0.6:
                last[0] += rng.randint(1, 2)
                out.append(last[0])
            else:
                out.append(next(counter))
        return out

    pages, trees = [], {}
    for i in range(120):
        trees[f"/{i:03}"] = [next(counter), *tree(3, [0]), *(next(counter) for _ in range(3))]
        pages.append((i, f"http://h.example/{i:03}", f"<nav>Menu {i}</nav><article>{source(trees[f'/{i:03}'])}</article>"))
    order, want, less = sorted(trees), {}, 0
    for k, path in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        best = max(near, key=lambda q: (html.prefix(path, q), q < path))
        mine, theirs = flat(trees[path]), flat(trees[best])
        both = set(mine) & set(theirs)

        def keep(t, both=both):
            return [y for x in t for y in ([] if isinstance(x, tuple) and set(flat(x[1])) <= both else keep(x[1]) if isinstance(x, tuple) else [x])]

        rest = keep(trees[path])
        rest = mine if 2 * len(both & set(rest)) >= len(rest) else rest
        less += len(rest) < len(mine)
        want[int(path[1:])] = "\n".join(f"line {x}" for x in rest)
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, PAGE).repartition(3)).collect()}
    assert less > 20 and got == want


def test_names_and_differencing_in_articles(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(6))
    own = {i: [line() for _ in range(4)] for i in range(5)}
    page = lambda i: (
        f'<article><p>{own[i][0]}</p><div><p>Read this on our site</p><p>Pay here</p></div><div class="reader-comments"><p>{line()}</p></div><div class="adbox">{line()}</div>'
        f'<div class="js-cookie-note">{line()}</div><p class="card share">{own[i][1]}</p><p class="share">Tell your friends</p><section><p>{own[i][2]}</p><p>A passage of all</p></section><p>{own[i][3]}</p></article>'
    )
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in own], PAGE)).collect()}
    assert got == {i: [*o[:3], "A passage of all", o[3]] for i, o in own.items()}


def test_a_page_of_over_a_megabyte(spark):
    lines = [f"word {i} of a long page" for i in range(60_000)]
    pages = [(k, f"http://h.example/{k}", "<article>" + "".join(f"<div><p>{x} {k}</p></div>" for x in lines) + "<div>Same</div></article>") for k in range(2)]
    for r in html.main_text(spark.createDataFrame(pages, PAGE)).collect():
        assert r.n_chars > 1_000_000 and r.text == "\n".join(f"{x} {r.page_id}" for x in lines)
