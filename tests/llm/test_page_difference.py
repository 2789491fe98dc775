"""Pages against a plain reading of the same rules, alignment against dynamic programming."""

import html
import random
import re

import pytest
from emberline.llm import page_difference as d
from emberline.llm import queries
from hypothesis import given, settings
from hypothesis import strategies as st


def table(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [d.ROW_BITS, 16])
def test_alignment(monkeypatch, bits):
    monkeypatch.setattr(d, "ROW_BITS", bits)
    rng = random.Random(bits)
    for _ in range(600):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        met = d.common(x, y)
        assert len(met) == table(x, y)
        assert all(x[i] == y[j] for i, j in met)
        assert all(a < b and e < f for (a, e), (b, f) in zip(met, met[1:]))


def test_alignment_of_long_pages():
    x = [i % 7 for i in range(6000)]
    y = [i % 5 for i in range(6000)]
    met = d.common(x, y)
    assert len({i for i, _ in met}) == len(met) > 2000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p>a{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">A</a><li>B</ul></nav><!-- <article> x --><div class="ad-slot">Buy</div>
<article class="post"><header><h1>Head&shy;line &amp; more</h1></header><p>One<br>line&nbsp;&lt;b&gt; <b>bold<p>Two <span class="share">tweet</span> words
 <ul><li>x<li>y</ul><aside>aside</aside><table><tr><td>1<td>2</table><form>mail <input value=">"></form><div id="comments"><p>first!</p></div>
<section><p>Last &copy 2 &#x41;</p></section></article><div>after</div><footer>&copy; me</footer></body></html>"""


def test_landmarks():
    found, article = d.lines(PAGE)
    assert article
    assert [t for z, t in found if z == d.MAIN] == ["Head­line & more", "One line <b> bold", "Two words", "x", "y", "1", "2", "Last © 2 A"]
    assert d.lines(PAGE, probe=True) == ([], True)


def test_cut_off_and_odd_pages():
    of = lambda p: [t for z, t in d.lines(p)[0] if z != d.AWAY]
    assert of("<") == ["<"]
    assert of("") == of("<p") == of("<!--") == of("<script>var x") == []
    assert of("a < b > c") == ["a < b > c"] and of("x</p></div>y") == ["x", "y"]
    assert of("<p>text <a href='x") == ["text"] and of("<P>A</P><P>B") == ["A", "B"]
    assert of("<![CDATA[a & b]]>") == ["a & b"]
    assert of("<p>" + "w " * 200_000) == [("w " * 200_000).strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-pab =\"'&;[]", max_size=60))
def test_nothing_crashes(text):
    for _, line in d.lines(text)[0]:
        assert line == " ".join(line.split()) and line


def by_hand(pages):
    """Hosts, neighbours and alignments without Spark."""
    parsed = [d.lines(p or "") for _, _, p in pages]
    key = lambda i: re.match(r"(?:\w+:)?//([^/?#]*)", pages[i][1] or "")
    host = [m[1].lower() if (m := key(i)) else "" for i in range(len(pages))]
    path = [re.sub(r"(/index)?\.(html?|php|aspx?)$|/+$", "", re.sub(r"^(?:\w+:)?//[^/?#]*|[?#].*$", "", u or "", flags=re.S), flags=re.I) for _, u, _ in pages]
    out = []
    for i, (found, article) in enumerate(parsed):
        if article or all(z != d.OPEN for z, _ in found):
            out.append("\n".join(t for z, t in found if z == d.MAIN))
            continue
        distinct = {}
        for j, (other, _) in enumerate(parsed):
            if host[j] == host[i]:
                seen = tuple(t for _, t in other)
                distinct[seen] = min(distinct.get(seen, path[j]), path[j])
        mine = tuple(t for _, t in found)
        order = sorted((p, s) for s, p in distinct.items())
        at = [s for _, s in order].index(mine)
        options = []
        for k in (at - 1, at + 1):
            if 0 <= k < len(order):
                p, s = order[k]
                near = next((n for n, (a, b) in enumerate(zip(p, order[at][0])) if a != b), min(len(p), len(order[at][0])))
                shared = sorted(x if k > at else y for x, y in d.common(*((mine, s) if k > at else (s, mine))))
                options.append((near, len(shared), shared))
        gone = max(options, default=(0, 0, []))[2]
        out.append("\n".join(t for n, (z, t) in enumerate(found) if z == d.OPEN and n not in gone))
    return out


def some_pages(n):
    rng = random.Random(4)
    pages = []
    for i in range(n):
        host = rng.choice(["one.example", "One.example", "two.example"])
        body = "".join(f"<div>{rng.choice(['Home', 'About us', 'Terms'])}</div>" for _ in range(3))
        body += "".join(f"<p>text {rng.randrange(40)} of {i}</p>" for _ in range(rng.randrange(4))) + "<div>All rights reserved</div>"
        pages.append((i, f"https://{host}/{i:04}/{rng.randrange(9)}.html?x={i}", f"<body>{body}</body>"))
    return pages


def test_differencing_against_hand(spark):
    pages = some_pages(60) + [(100, "https://lone.example/a", "<div>Home</div><p>alone</p>"), (101, None, "<p>no host</p>"), (102, "http://x/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in d.extract(df).collect()}
    assert [got[p[0]] for p in pages] == by_hand(pages)
    assert got[100] == "Home\nalone" and got[102] == "" and sum("rights" in t for t in got.values()) == 0
    again = {r.page_id: r.text for r in d.extract(df.repartition(5, "html")).collect()}
    assert again == got


def test_repeated_rows_copies_and_odd_columns(spark):
    body = "<div>Menu of it</div><p>copy</p>"
    rows = [(1, "http://h/a", body, 1, "z", 2)] * 4 + [(None, "http://h/a", body, 1, "z", 2), (2, "http://h/b", "<div>Menu of it</div><p>other</p>", 1, "z", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, `a.b` string, text int")
    assert sorted((r.page_id or 0, r.text) for r in d.extract(df).collect()) == [(0, "copy")] + [(1, "copy")] * 4 + [(2, "other")]
    assert d.extract(df.limit(0)).collect() == []


def test_query_on_the_given_pages(spark):
    """The given pages hold their text in a flat article: h1 and p, with an unclosed b and a br."""
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op12_page_difference(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", article)))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
