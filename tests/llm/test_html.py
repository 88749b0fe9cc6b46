"""Wrapper induction: what a host's pages tell where names of tags and classes tell nothing."""
import subprocess
import sys

import pytest

from meshloom.llm import html

PAGE = """<html><body><div><a href=/>Home</a> <a href=/w>World %(k)s</a></div>%(ad)s<div><h2>Title %(k)s</h2>%(body)s<p>Read all of it in our printed edition</p></div>
<div>%(said)s</div><div>Published by the people of town %(k)s</div></body></html>"""


def words(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"w{x % 997}")
    return " ".join(out)


def plain_page(k: int, paragraphs: int) -> tuple[str, str]:
    """A page without a telling tag or class, and its article."""
    body = [words(100 * k + j, 30) for j in range(paragraphs)]
    said = "".join(f"<div><b>reader {k} {j}</b><p>{words(5000 + 10 * k + j, 8)}</p></div>" for j in range(k % 3))
    ad = f"<div>Buy {words(9000 + k, 3)} today</div>" if k % 4 else ""
    return PAGE % {"k": f"n{k}", "ad": ad, "body": "".join(f"<p>{b}</p>" for b in body), "said": said}, "\n".join([f"Title n{k}", *body])


def texts(spark, pages, **how):
    rows = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html.main_text(rows, **how).collect()}


@pytest.fixture(scope="module")
def plain():
    made = [plain_page(k, 3 + k % 9) for k in range(24)]
    return [("http://plain.example/%d" % k, p) for k, (p, _) in enumerate(made)], {k: t for k, (_, t) in enumerate(made)}


def test_the_wrapper_finds_the_article_where_nothing_is_named(spark, plain):
    pages, want = plain
    assert texts(spark, pages) == want
    without = texts(spark, pages, learn=False)
    assert all(without[k] != want[k] for k in want)


def test_the_same_with_shuffled_wrappers_and_shapes_merged_in_rounds(spark, plain, monkeypatch):
    pages, want = plain
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html, "BUNCH", 2)
    assert texts(spark, [*pages, ("http://single.example/", pages[0][1])])[0] == want[0]
    assert {k: v for k, v in texts(spark, pages).items()} == want


def test_one_process_and_spark_learn_the_same(spark, plain):
    pages, want = plain
    w = html.induce([p for _, p in pages])
    assert {k: "\n".join(html.blocks(html.parse(p), w)) for k, (_, p) in enumerate(pages)} == want
    assert "\n".join(html.blocks(html.parse(pages[3][1]), {"template": None})) != want[3]


def test_a_constant_line_goes_wherever_it_stands(spark):
    """A line that all pages have is dropped after five paragraphs and after forty, and kept on a host of one page."""
    line = "<p>Subscribe to hear from us</p>"
    pages, want = [], {}
    for k in range(10):
        body = [f"part {j} {words(77 * k + j, 12)}" for j in range(5 if k % 2 else 40)]
        pages.append(("http://line.example/", f"<article>{''.join(f'<p>{b}</p>' for b in body)}{line}</article>"))
        want[k] = "\n".join(body)
    pages.append(("http://other.example/", f"<article><p>only one</p>{line}</article>"))
    want[10] = "only one\nSubscribe to hear from us"
    assert texts(spark, pages) == want


def test_page_kinds_of_one_host_have_their_own_article(spark):
    """Half of the pages are of another make; both kinds are learned."""
    pages, want = [], {}
    for k in range(12):
        body = [words(31 * k + j, 25) for j in range(4)]
        ps = "".join(f"<p>{b}</p>" for b in body)
        links = "".join(f"<li><a>{words(k + 50 + j, 2)}</a></li>" for j in range(4))
        pages.append(("http://two.example/", f"<body><div><ul>{links}</ul></div><section>{ps}</section></body>" if k % 2 else f"<body><table><tr><td>{ps}</td><td><ul>{links}</ul></td></tr></table></body>"))
        want[k] = "\n".join(body)
    assert texts(spark, pages) == want


def test_copies_and_repeated_pages_are_no_template(spark):
    """Nine copies of one article in other surroundings, repeated rows and two more pages: the article stays."""
    body = "".join(f"<p>{words(j, 30)}</p>" for j in range(4))
    one = [("http://copy.example/", f"<body><div>Menu {k}</div><div>{body}</div></body>") for k in range(9)]
    more = [("http://copy.example/", f"<body><div>Menu</div><div><p>{words(900 + k, 40)}</p></div></body>") for k in range(2)]
    got = texts(spark, [*one, *one, *more])
    assert all("\n".join(words(j, 30) for j in range(4)) in got[k] for k in range(18))


def test_odd_rows(spark):
    rows = [(1, None, None, "h", "t"), (1, None, None, "h", "t"), (None, "http://a/", "<p>x", "h", "t"), (3, "http://a/", "", "h", "t"), (4, "http://a/", "<<<>>&#0;<a<b", "h", "t")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got)[:3] == [(0, "x"), (1, ""), (1, "")] and len(got) == 5
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_pages_take_little_memory():
    """500 KB of unclosed elements, three pages of a host, under 1 GB and in one process."""
    code = ("import resource; from meshloom.llm import html; "
            "deep = ['<div>' * 100_000 + f'end {k}' for k in range(4)]; w = html.induce(deep); "
            "print(['\\n'.join(html.blocks(html.parse(d), w)) for d in deep]); "
            "mixed = '<p>a<div>b' * 50_000; print(len(html.content(html.Page(html.parse(mixed)), None))); "
            "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.stdout.split("\n")[:3] == ["['end 0', 'end 1', 'end 2', 'end 3']", "100000", "True"], out.stderr


def test_matching_prefers_leaves_for_leaves():
    a = html.Page(html.parse("<div><a>m</a></div><div><h1>t</h1><p>x</p></div><div>foot</div>")).shape
    b = html.Page(html.parse("<div><a>m</a></div><div>ad</div><div><h1>t</h1><p>x</p></div><div><div>c</div></div><div>foot</div>")).shape
    found = {}
    assert html.match(a, b, found) == 6
    assert [found[c].at for c in a.children] == [1, 2, 7]  # menu and advert, equal leaves in a row, stand once


def test_headings_items_and_paragraphs_that_recur_stay(spark):
    pages, want = [], {}
    for k in range(6):
        body = [f"Dish {k}", words(k, 12), "Ingredients", "salt", f"{k + 1} onions", "Method", words(50 + k, 30), "Let it rest.", words(90 + k, 20)]
        tags = ["h1", "p", "h2", "li", "li", "h2", "p", "p", "p"]
        pages.append(("http://cook.example/", "<body><div>Cook site</div><article>" + "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, body)) + "</article><div>All rights with us</div></body>"))
        want[k] = "\n".join(body)
    assert texts(spark, pages) == want


def plain_match(a, b):
    """The size of the largest alignment, by the textbook recursion."""
    if a.name != b.name:
        return 0
    xs, ys = a.children, b.children
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_match(x, y))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("small", [0, 64])
def test_matching_equals_the_plain_recursion(monkeypatch, small):
    import random

    monkeypatch.setattr(html, "SMALL", small)
    rnd = random.Random(4)

    def tree(depth):
        s = html.Shape(rnd.choice("ab"))
        s.children = [tree(depth - 1) for _ in range(rnd.randint(0, 5))] if depth else []
        return s

    for _ in range(60):
        a, b = tree(3), tree(3)
        a.name = b.name
        found = {}
        assert html.match(a, b, found) == plain_match(a, b) == len(found)
        for x, y in found.items():
            inner = [found[c] for c in x.children if c in found]
            at = [next(i for i, d in enumerate(y.children) if d is c) for c in inner]
            assert x.name == y.name and at == sorted(at)


def test_wide_pages_of_alternating_records_take_little_memory_and_time():
    """500 KB of alternating records a page, three pages of a host, under 1 GB and 30 s."""
    code = ("import resource, time; from meshloom.llm import html; began = time.process_time(); "
            "record = lambda k, i: f'<div><b>name {k} {i}</b></div><section><div><p>said {k} {i}</p></div></section>'; "
            "pages = ['<body><article><h1>Head %d</h1><p>Text %d of it that is longer than the rest of the page by far and away</p></article><div>' % (k, k) + ''.join(record(k, i) for i in range(7000 + 50 * k)) + '</div></body>' for k in range(3)]; "
            "w = html.induce(pages); got = [html.blocks(html.parse(p), w) for p in pages]; "
            "print(min(map(len, pages)) > 500_000, len(got), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20, time.process_time() - began < 30)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["True", "3", "True", "True"], out.stdout + out.stderr
