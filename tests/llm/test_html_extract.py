import math
import random

import pytest

from seqloom.llm import html_extract as H


def page(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


CASES = [
    (None, ""),
    ("", ""),
    ("<html><head><title>T</title></head><body><nav><ul><li>a<li>b</ul></nav><article><h1>Big  title</h1><p>One <b>two</b>three<br>four &amp; five&nbsp;six</article><footer>f</footer>", "Big title One twothree four & five six"),
    ("<article><p><b>open<p>next</p><script>var t='</p>x';</script><!-- <p>no</p> --><p>&lt;end&gt; caf&eacute; &#x41;</p></article>", "open next <end> café A"),
    ("<main><p>kept</p><form><p>name</p></form><div class='cookie-notice'>c</div><div id=comments><p>nice!</p></div><aside>s</aside><p>too</p></main><div class=ad>x</div>", "kept too"),
    ("<article>unclosed <i>text", "unclosed text"),
    ("<article><p title='a>b'>attr</p><p hidden>no</p><style>p{}</style>tail</article>", "attr tail"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
    ("<article>x</nav></b></p>y</article>", "x y"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article>a < b &amp &unknown; c</article><", "a < b & &unknown; c"),
]


def test_pages(spark):
    rows = page(spark, *((f"http://h{i}.example/x", h) for i, (h, _) in enumerate(CASES)))
    got = {r.page_id: r for r in H.extract(rows).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert H.extract(rows.limit(0)).count() == 0


def test_the_tree_removes_what_a_host_repeats(spark):
    rows = []
    for i in range(20):
        rows.append((f"https://a.example/{i}", f"<body><div class=top><p>Our site</p><p>Fine things</p></div><div class=text><p>Words {i} of their own</p><p>and {i * 7} more</p></div></body>"))
    rows.append((None, "<body><div class=top><p>Our site</p></div></body>"))
    rows.append((None, "<body><div class=top><p>Other site</p></div></body>"))
    got = {r.page_id: r.text for r in H.extract(page(spark, *rows)).collect()}
    assert [got[i] for i in range(20)] == [f"Words {i} of their own and {i * 7} more" for i in range(20)]
    assert got[20] == "Our site" and got[21] == "Other site"


def brute_importance(pages):
    """(host, path) to importance, by probabilities: pages of one host with the same blocks count once."""
    out, hosts = {}, {}
    for url, source in pages:
        host = url.split("/")[2]
        found, styles = H.blocks(source)
        hosts.setdefault(host, {})[repr([(p, t) for _, _, p, t in found])] = (found, styles)
    entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
    for host, own in hosts.items():
        where = {}
        for k, (found, _) in enumerate(own.values()):
            for _, _, path, _ in found:
                where.setdefault(path, set()).add(k)
        for path, having in where.items():
            m = len(having)
            if m < 2:
                continue
            texts, layouts = {}, {}
            for k, (found, styles) in enumerate(own.values()):
                for _, _, p, t in found:
                    if p == path:
                        texts.setdefault(t, {}).setdefault(k, 0)
                        texts[t][k] += 1
                for p, s in styles if k in having else ():
                    if p == path:
                        layouts[s] = layouts.get(s, 0) + 1
            content = 1 - sum(entropy(c.values()) for c in texts.values()) / len(texts) / math.log(m)
            layout = entropy(layouts.values()) / math.log(m) if layouts else 0.0
            measured = min(max(content, layout, 0.0), 1.0)
            out[host, path] = (measured * m + H.UNSEEN * H.UNSEEN_PAGES) / (m + H.UNSEEN_PAGES)
    return out


def test_importance_against_brute_force(spark):
    rng = random.Random(2)
    pages = []
    for i in range(60):
        parts = [f"<div class={rng.choice('abc')}>" + "".join(f"<{t}>{rng.choice(['Same', 'Other', f'Own {i}'])}</{t}>" for t in rng.choices(["p", "h2", "li"], k=rng.randint(1, 4))) + "</div>" for _ in range(rng.randint(1, 4))]
        pages.append((f"https://h{i % 3}.example/{i}", "<body>" + "".join(parts) + "</body>"))
    pages += pages[:5]  # repeated pages
    made = H.parsed(page(spark, *pages), "page_id", "url", "html").cache()
    got = {(r.host, r.path): r.importance for r in H.style_tree(made).collect()}
    want = brute_importance(pages)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 10


def test_long_pages_ties_and_nulls(spark):
    long_ = "<article>" + "".join(f"<p>Line {i}</p>" for i in range(30_000)) + "</article>"
    same = "<body><div class=x><p>One</p></div></body>"
    rows = [("https://l.example/1", long_), ("https://l.example/2", same), ("https://l.example/3", same), (None, None)]
    got = [r.text for r in H.extract(page(spark, *rows)).orderBy("page_id").collect()]
    assert got == [" ".join(f"Line {i}" for i in range(30_000)), "One", "One", ""]


def test_marked_pages_feed_the_tree(spark):
    rows = [("https://m.example/a", f"<body><div class=top><p>Our site</p></div><article><div class=box><p>Buy it</p></div><p>Story {i}</p></article></body>") for i in range(40)]
    rows.append(("https://m.example/b", "<body><div class=top><p>Our site</p></div><div class=text><p>An unmarked story</p></div></body>"))
    got = {r.page_id: r.text for r in H.extract(page(spark, *rows)).collect()}
    assert [got[i] for i in range(40)] == [f"Story {i}" for i in range(40)]  # what all repeat goes, in article too
    assert got[40] == "An unmarked story"  # m counts the marked pages


def test_unique_text_beside_an_article_stays(spark):
    rows = [("https://n.example/", f"<body><article><p>Story {i}</p></article><div class=more><p>And {i} more</p></div></body>") for i in range(40)]
    assert {r.text for r in H.extract(page(spark, *rows)).collect()} == {f"Story {i} And {i} more" for i in range(40)}


def test_the_tree_tells_deep_branches_and_all_classes_apart(spark):
    deep = lambda x: "<div>" * 20 + x + "</div>" * 20
    rows = [("https://d.example/", "<body>" + deep(f"<section><p>Story {i}</p></section><div class='a b c d e'><p>Same</p></div><div class='a b c d f'><p>Own {i}</p></div>") + "</body>") for i in range(20)]
    assert {r.text for r in H.extract(page(spark, *rows)).collect()} == {f"Story {i} Own {i}" for i in range(20)}


@pytest.mark.parametrize("source, want", [
    ("<div class='content-sidebar-wrap'><main><p>kept</p></main></div>", "kept"),
    ("<div class='has-sidebar'><article>kept</article><div class=sidebar>no</div></div>", "kept"),
    ("<div class=sidebar><main>kept</main><p>no</p></div>", "kept"),
    ("<form><article>kept</article>no</form>", "kept"),
    ("<article>kept</article><div class=comments><article>no</article></div>", "kept"),
    ("<article><h2 id='related-work'>Related work</h2><p class='side-effects'>Side effects</p><p class='Share'>no</p></article>", "Related work Side effects"),
    ("<article><p style='overflow: hidden'>a</p><p title=\"The hidden coast\">b</p><p data-x='role=navigation' data-hidden=1>c</p><p HIDDEN=''>no</p><p class=x hidden>no</p></article>", "a b c"),
    ("<article><p class='cookie-notice'>no</p><p role=alert>no</p>kept</article>", "kept"),
])
def test_names_and_attributes(spark, source, want):
    assert [r.text for r in H.extract(page(spark, ("https://x.example/", source))).collect()] == [want]


def test_the_tree_decides_on_doubtful_names(spark):
    rows = [("https://y.example/", f"<article><div class='side-box'><p>Same</p></div><div class='side-effects'><p>Effect {i}</p></div></article>") for i in range(20)]
    assert {r.text for r in H.extract(page(spark, *rows)).collect()} == {f"Effect {i}" for i in range(20)}


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, "<article>x</article>", 1, "r")] * 3, "page_id long, url string, html string, row int, roles string")
    assert [(r.page_id, r.url, r.text) for r in H.extract(df).collect()] == [(None, None, "x")] * 3


@pytest.mark.parametrize("n", [10, 20000])
def test_time_is_linear_in_broken_markup(n):
    assert H.blocks("<a href=\"" * n) is not None
    assert H.blocks("<!--" * n) == ([], [])
    assert len(H.blocks("<p>x" * n)[0]) == n
