import random

import numpy as np
from pyspark.sql import functions as F

from drivelake.llm import html_text, neighbours

PAGES = "page_id long, url string, html string, text string"


def page(i, rng, extra=""):
    body = "".join(f"<p>para {i} {j} {rng.random()}</p>" for j in range(rng.randrange(1, 5)))
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body><div class="cookie-notice">We use cookies</div><header><a href=/>Home</a></header>
    <nav><ul><li>One<li>Two</ul></nav><main><div>Printed by Example</div><article><h1>Head {i} &amp; more</h1>{body}{extra}</article><aside>Side {i}</aside>
    <section id="comments"><p>First! {i}</p></section></main><form><input name=q>Go</form><footer>&copy; Example</footer><script>var x="<p>no</p>";</script></body></html>"""


def test_article_only_and_odd_pages(spark):
    rng = random.Random(1)
    rows = [(i, f"https://h{i % 2}.example.com/{i}", page(i, rng, "<p>x <b>bold<br>y &eacute;&nbsp;z<p>last<div class='share-buttons'>Share</div>" if i == 3 else ""), "x") for i in range(30)]
    rows += [(100, None, "<p>a<p>b", None), (101, "https://h0.example.com/", None, None), (102, "not a url", "", None), (103, "http://h1.example.com", "plain <", None), (103, "http://h1.example.com", "plain <", None)]
    got = {}
    for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert len(got[103]) == 2 and got[100] == ["a\n\nb"] and got[101] == got[102] == [""]
    for i in range(30):
        blocks = got[i][0].split("\n\n")
        assert blocks[0] == f"Head {i} & more" and all(b.startswith(f"para {i} ") for b in blocks[1 : -2 if i == 3 else None])
    assert got[3][0].endswith("x bold y é z\n\nlast")
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_template_of_a_rare_layout_goes(spark):
    rare = "<div class='b'><p>Own {0}</p></div><div class='box'>Printed in layout B</div>"
    rows = [(i, f"https://h.example.com/{i}", (rare if i % 20 == 0 else "<div class='a'><p>Own {0}</p></div><div class='box'>Text {0}</div>").format(i), None) for i in range(200)]
    rows += [(500 + i, "https://g.example.com/same", "<div><p>One page, many times</p></div>", None) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(200):
        assert got[i] == (f"Own {i}" if i % 20 == 0 else f"Own {i}\n\nText {i}")
    assert all(got[500 + i] == "One page, many times" for i in range(8))


def texts_of(spark, pages, host="https://six.example.com/"):
    rows = [(i, f"{host}{i}", h, None) for i, h in enumerate(pages)]
    return [r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def own(i, n=3):
    rng = random.Random(i)
    return "".join(f"<p>{' '.join(rng.choice('abcdefgh') * 5 for _ in range(25))} {i} {j}</p>" for j in range(n))


def test_a_site_without_names_is_read_by_its_wrapper(spark):
    """Only divs: a menu, the article, links to others, a footer; nothing but the structure tells them apart."""
    rng = random.Random(5)
    link = lambda: f"<a href=/{rng.random()}>go {rng.randrange(9)}</a>"
    pages = [f"<html><body><div><ul>{''.join(f'<li>{link()}</li>' for _ in range(5))}</ul></div><div><h1>Title {i}</h1>{own(i, 1 + i % 4)}</div><div>{' '.join(link() for _ in range(8))}</div><div>Printed by us, all rights reserved</div></body></html>" for i in range(20)]
    for i, t in enumerate(texts_of(spark, pages)):
        blocks = t.split("\n\n")
        assert blocks[0] == f"Title {i}" and len(blocks) == 2 + i % 4 and all(b.split()[-2] == str(i) for b in blocks[1:])


def test_nothing_of_an_article_is_dropped(spark):
    same = own(7)
    plain = [x for x in same.replace("<p>", "").split("</p>") if x]
    # Six pages with one article and different footers.
    assert texts_of(spark, [f"<body><article>{same}</article><footer>foot {i}</footer></body>" for i in range(6)]) == ["\n\n".join(plain)] * 6
    # A heading and a last line that all articles share.
    got = texts_of(spark, [f"<body><div class=menu>Menu</div><article><h2>Daily news</h2>{own(i)}<p>Thank you for reading</p></article></body>" for i in range(6)])
    assert all(t.startswith("Daily news\n\n") and t.endswith("Thank you for reading") and "Menu" not in t for t in got)
    # Two articles; two content blocks.
    for block in ("article", "div class=entry-content"):
        got = texts_of(spark, [f"<body><nav>x</nav><{block}>{own(i)}</{block.split()[0]}><{block}>{own(100 + i)}</{block.split()[0]}></body>" for i in range(6)])
        assert all(f" {i} 0" in t and f" {100 + i} 2" in t for i, t in enumerate(got))
    # A headline before the content block, and one in the page's header.
    for head in ("<h1>Head {0}</h1>", "<header><h1>Head {0}</h1></header>"):
        got = texts_of(spark, [f"<body>{head.format(i)}<div class=content>{own(i)}</div><div class=sidebar>Side {i}</div></body>" for i in range(6)])
        assert all(t.startswith(f"Head {i}\n\n") and "Side" not in t and t.endswith(f" {i} 2") for i, t in enumerate(got))
    # Names that only look like those of asides.
    got = texts_of(spark, [f"<body><article>{own(i)}<div class='side-by-side'>Left and right {i}</div><p class=alert>Mind this {i}</p><div class='comment-list'>First! {i}</div></article></body>" for i in range(6)])
    assert all(f"Left and right {i}" in t and f"Mind this {i}" in t and "First" not in t for i, t in enumerate(got))


def test_long_pages_and_single_pages(spark):
    long = "".join(f"<h2>Part {j}</h2>{own(j, 2)}<ul><li>point {j}</ul>" for j in range(1500))
    got = texts_of(spark, [f"<body><nav>Menu</nav><div class=post>{long}</div><footer>f</footer></body>", f"<body><nav>Menu</nav><div class=post>{own(1)}{long}</div><footer>f</footer></body>"])
    assert [len(t.split("\n\n")) for t in got] == [6000, 6003]
    assert texts_of(spark, ["<body><div class=top>A<br>B</div><div><h1>T</h1><p>Some words of an article that stands alone</p></div><div class=footer>z</div></body>"])[0].startswith("T\n\nSome words")
    rows = [(i, None, f"<p>alone {i}", "x") for i in range(3)]
    out = html_text.extract_text(spark.createDataFrame(rows, "text long, n_chars string, html string, page string"), key="text", url="n_chars")
    assert out.count() == 3  # names that clash with those of the result don't crash


def test_hostile_pages_take_seconds():
    """Deep nesting, and a megabyte of what never ends."""
    import time

    cases = {
        "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>out</p>": "deep\n\nout", "<a " * 350_000: ("<a " * 350_000).strip(), '<p title="x' * 100_000: '<p title="x' * 100_000, "<!-" * 350_000: "<!-" * 350_000,
        "<p>a</p>" + "<!--" * 300_000: "a", "<div>" * 100_000 + "</p>" * 100_000 + "x": "x", "<svg>" * 100_000 + "x": "x", "<li><ul>" + "<div>" * 50_000 + "<li/>" * 50_000 + "x": "x", "x &amp; " * 200_000: ("x & " * 200_000).strip(),
        "<div>" * 300 + "<nav>menu</nav>words of the page" + "</div>" * 300: "words of the page", "<script>" * 100_000: "", "<p>a</p><hr>" * 20_000: "\n\n".join(["a"] * 20_000), '<p title="a > b" data-x=\'<i>\'>t</p>': "t",
    }
    for page, want in cases.items():
        start = time.time()
        assert "\n\n".join(html_text.main_blocks(html_text.parse(page))) == want, page[:40]
        w = html_text.Wrapper()
        for _ in range(2):
            w.add(html_text.parse(page))
        assert "\n\n".join(html_text.main_blocks(html_text.parse(page), html_text.Wrapper.from_json(w.to_json()))) == want, page[:40]
        assert time.time() - start < 20, page[:40]


def test_names_do_not_drop_what_an_article_says(spark):
    parts = [
        '<h2 id="sharing">On sharing {0}</h2>', '<h2 id="navigation">On navigation {0}</h2>', '<h2 id="cookies">On cookies {0}</h2>', '<p id="footer-design">Footer design {0}</p>', '<section class="related-work">Related work {0}</section>',
        '<div class="share-price">Share price {0}</div>', '<p class="comment">A comment on {0}</p>', '<div class="reply">The reply of {0}</div>', "<p>By <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> we mean</p>",
    ]
    pages = [f"<body><nav>Menu</nav><article><h1>T {i}</h1>{own(i)}{''.join(parts).format(i)}<div class='share-buttons'>Share</div><div id='comments'>First!</div><div class='ad-slot'>Buy</div></article></body>" for i in range(6)]
    for i, t in enumerate(texts_of(spark, pages)):
        for said in ("On sharing", "On navigation", "On cookies", "Footer design", "Related work", "Share price", "A comment on", "The reply of"):
            assert f"{said} {i}" in t
        assert f"By x={i} we mean" in t and not any(x in t for x in ("Menu", "Share\n", "First!", "Buy"))


def test_classes_with_numbers_make_no_layouts(spark):
    """Each page has its key and its topics among the classes of its body and article; the template still goes by the wrapper."""
    rng = random.Random(2)
    page_of = lambda i: f"<html><body class='postid-{i} topic-{rng.choice('abcdefg')}{rng.choice('xyz')} single'><div class='box-{i}'>Printed by us since 1990</div><article class='post-{i} tag-{rng.random()}'><h1>Head {i}</h1>{own(i)}</article></body></html>"
    pages = [page_of(i) for i in range(50)]
    assert len({html_text.layout_of(html_text.parse(p)) for p in pages}) == 1
    got = texts_of(spark, pages)
    assert all(t.startswith(f"Head {i}\n\n") and "Printed" not in t and t.endswith(f" {i} 2") for i, t in enumerate(got))


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("pqr") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = html_text._align(a, b)
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in pairs if i >= 0 and j >= 0)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert sum(i >= 0 and j >= 0 for i, j in pairs) == best[-1][-1]


def test_large_alignment_is_whole_and_the_same(monkeypatch):
    rng = random.Random(8)
    lists = [tuple([str(rng.randrange(k)) for _ in range(rng.randrange(60))] for _ in "ab") for k in (1, 3, 8, 40) for _ in range(50)]
    lists += [tuple([str(rng.randrange(k)) for _ in range(700)] for _ in "ab") for k in (2, 500)]
    whole = [html_text._pairs(a, b) for a, b in lists]
    for bits in (1, 50, 3000):
        monkeypatch.setattr(html_text, "ALIGNED", bits)
        assert [html_text._pairs(a, b) for a, b in lists] == whole
    monkeypatch.undo()
    # Ends that differ, and more bits in the table than are held at once.
    a, b = (["x", *(f"{side}{i}" if i % 3 == 0 else f"s{i}" for i in range(21_000)), "y"] for side in "ab")
    pairs = html_text._pairs(["l", *a], [*b, "r"])
    assert (len(a) + 1) * (len(b) + 1) > html_text.ALIGNED and sum(i >= 0 and j >= 0 for i, j in pairs) == 14_002


def test_wrapper_marks_repeats_options_and_slots():
    w = html_text.Wrapper()
    for h in ("<ul><li>a<li>b</ul><p>same</p>", "<ul><li>a</ul><h2>t</h2><p>same</p>", "<ul><li>c</ul><p>same</p>"):
        w.add(html_text.parse(h))
    assert w.expression() == "<ul>(<li>#PCDATA</li>)+</ul> (<h2>t</h2>)? <p>same</p>"
    assert html_text.Wrapper.from_json(w.to_json()).expression() == w.expression()


VECTORS = "vec_id long, embedding array<float>, id long"


def test_recall_order_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[100:900] = v[0]  # a large group of equal vectors
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0, None], 0), (None, v[1].tolist(), 0), (5080, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, VECTORS)
    out = neighbours.nearest(table, table.filter("vec_id % 20 = 0"), 20, shard_size=700, block=64).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    for q, found in by.items():
        scores = v.astype(float) @ v[q].astype(float)
        want = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        assert len(found) == 20 and all(abs(scores[i] - s) < 1e-12 and i != q for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hit += len(set(want) & {i for i, _ in found})
    assert hit / (20 * len(by)) >= 0.9
    assert by[0][0][0] == 100 and by[100][0][0] == 0
    few = table.filter("vec_id < 5")
    assert neighbours.nearest(few, few.filter("vec_id = 0"), 20).count() == 4
    assert neighbours.nearest(table.filter("false"), table.filter("false"), 20).count() == 0


def test_scores_of_double_vectors_are_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    table = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, id long")
    out = neighbours.nearest(table, table.filter("vec_id % 20 = 0").union(table.filter("vec_id = 0")), 20).collect()
    assert len(out) == 60  # repeated queries count once
    for r in out:
        assert abs(r.score - float(v[r.query_id] @ v[r.vec_id])) < 1e-14


def test_vectors_of_any_finite_size(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 8))
    for kind, size in (("float", 1e25), ("float", 1e-25), ("float", 1e37), ("double", 1e150), ("double", 1e-150), ("double", 1e-200)):
        v = (base * size).astype(np.float32 if kind == "float" else np.float64)
        table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")
        hit, rows = 0, neighbours.nearest(table, table.filter("vec_id % 20 = 0"), 20).collect()
        assert len(rows) == 400, (kind, size)
        for q in range(0, 400, 20):
            # At 1e-200 products are zero in double precision too: any neighbours do, the smallest ids of those found first.
            scores = base @ base[q] if size == 1e-200 else v.astype(float) @ v[q].astype(float)
            want = [i for i in np.argsort(-scores, kind="stable") if i != q][:20]
            hit += len({r.vec_id for r in rows if r.query_id == q} & set(want))
        assert hit >= (0 if size == 1e-200 else 0.95 * 400), (kind, size, hit)


def test_a_wrapper_is_inferred_from_all_pages_of_a_layout(spark):
    """A text that stands before few of many articles is known as the same on all of them, however the pages are dealt."""
    article = lambda i: "".join(f"<p>{' '.join(f'w{i}x{j}' for j in range(30))} {k}</p>" for k in range(3))
    page = lambda i: f"<html><body>{'<p>The office is closed today</p>' if i % 20 == 0 else ''}<div class='text'>{article(i)}</div></body></html>"
    rows = spark.createDataFrame([(i, f"http://many.example/{i}", page(i)) for i in range(300)], "page_id long, url string, html string")
    first = {r.page_id: r.text for r in html_text.extract_text(rows.repartition(2)).collect()}
    assert len(first) == 300 and not [i for i, t in first.items() if "office" in t or not t.startswith(f"w{i}x0 ")]
    assert first == {r.page_id: r.text for r in html_text.extract_text(rows.orderBy(F.desc("page_id")).repartition(5)).collect()}
