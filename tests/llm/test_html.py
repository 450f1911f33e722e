"""Page differencing against a brute-force version, and what its marks mean."""

import zlib

import pytest

from fathomline.llm import html_main
from fathomline.llm.url_filter import split_url


def subsequence(a, b):
    """Indices of a longest common subsequence, by the plain table; what matters is their number and order."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table[0][0]


def brute(pages):
    """page_id -> text, by sorting all pages of a host at once."""
    rows = sorted(((*split_url(u), i is not None, i or 0, zlib.crc32((h or "").encode())), i, html_main.page_lines(h)) for i, u, h in pages)
    out = {}
    for k, (key, i, lines) in enumerate(rows):
        near = [rows[n] for n in (k - 1, k + 1) if 0 <= n < len(rows) and key[0] and rows[n][0][0] == key[0]]
        common = lambda x: next((n for n, (a, b) in enumerate(zip(x[0][1], key[1])) if a != b), min(len(x[0][1]), len(key[1])))
        near.sort(key=lambda x: -common(x))
        out[i] = " ".join(html_main.own_lines(lines, [x[2] for x in near])[0])
    return out


def page(nav, body, foot):
    return f"<body><ul>{''.join(f'<li><a href=/x>{x}</a></li>' for x in nav)}</ul>{body}<div>{foot}</div></body>"


@pytest.fixture(scope="module")
def pages():
    made = []
    for h in range(3):
        for k in range(25):
            body = f"<p>Story {h} {k} begins.</p><p>Line {k % 4}</p><p>It ends {k}.</p>"
            if k % 5 == 0 or h == 2:
                body = f"<article><h1>Head {k % 3}</h1><p>Subscribe now for deals</p>{body}<p>A passage that many quote.</p></article>"
            made.append((100 * h + k, f"http://h{h}.org/{'ab'[k % 2]}/{k * 7 % 11}", page(["Home", f"Part {k % 2}", "About"], body, f"Foot {h}")))
    made += [(900, "http://h0.org/a/0", made[0][2]), (901, "http://h0.org/a/0", made[0][2]), (902, None, made[1][2]), (903, "http://alone.org/", made[2][2]), (904, "http://h1.org/zz", None)]
    return made


def test_equal_to_brute_force_whatever_the_ranges(spark, pages):
    want = brute(pages)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for n in (1, 4, 60):
        out = html_main.extract_main(frame, partitions=n).collect()
        assert {r.page_id: r.text for r in out} == want and len(out) == len(pages)
    assert "Home" not in want[3] and "Foot" not in want[3] and "Story 0 3 begins." in want[3]
    assert "Subscribe" in want[900] or want[900]  # a copy of its neighbour keeps its content
    assert any("Subscribe" not in want[i] for i, _, h in pages if h and "Subscribe" in h)
    assert all("A passage that many quote." in want[i] for i, _, h in pages if h and "<article" in h)


def test_neighbours_of_registered_pages_share_lines_and_all_keep_text(spark):
    found = html_main.extract_main(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).toPandas()
    assert (found.n_shared > 0).any() and (found.text != "").all()


def test_common_has_the_longest_length():
    a, b = list("abcbdabxyz"), list("bdcabayxz")
    assert len(html_main.common(a, b)) == subsequence(a, b)


def test_names_that_say_frame_and_content():
    lines = lambda h: [(x[0], x[1:]) for x in html_main.page_lines(h)]
    assert lines('<div class="post tags-list"><p>Body</p></div>') == [(html_main.PLAIN, "Body")]
    assert lines('<article class="comment-story"><p>It is.</p></article>') == [(html_main.PROSE, "It is.")]
    for name in ("comment-body", "main-menu", "ad", "story-comments", "cookie-law-info", "Sidebar"):
        assert lines(f'<div class="{name}"><p>x.</p></div>')[0][0] == html_main.NAMED, name
    assert lines("<article><p><a href=1>Home</a> | <a href=2>About</a></p></article>")[0][0] == html_main.LOOSE
    assert lines("<nav>a</nav><footer>b</footer><div role=banner>c</div>") == [(html_main.FRAME, x) for x in "abc"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert lines(deep) == [(html_main.PLAIN, "x")] and len(lines("<p>" + "w " * 500000)) == 1


def test_unshared_named_text_is_taken_when_nothing_else_is_left(spark):
    story = "<div class='related'><p>%s and so on for a dozen of words or some more, to the very end of it.</p></div><p>Same</p>"
    rows = [(1, "http://a.org/1", story % "One"), (2, "http://a.org/2", story % "Two")]
    out = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].startswith("One") and out[2].startswith("Two") and "Same" not in out[1]
