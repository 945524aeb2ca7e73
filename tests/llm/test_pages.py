"""Main text of pages: markup as authors write it, templates, and hosts against a fold by hand."""

import time

import pandas as pd
import pytest

from panelforge.llm import wrappers
from panelforge.llm.wrappers import fold, from_json, main_text, parse, skeleton, to_json

CASES = [
    ("<body><nav>menu</nav><div class='header'>top</div><article><h1>A &amp; b</h1><p>one <b>two\n three</b><p>five<div class='ad'>buy</div><ul><li>x<li>y</ul><section class='comments'>c</section></article><footer>f</footer>", "A & b\none two three\nfive\nx\ny"),
    ('<article><div style="overflow:hidden"><p>real text</p></div><p>b</p></article>', "real text\nb"),
    ('<article><div data-hidden="1" aria-hidden="false"><p>real text</p></div><p hidden>x</p><p>b</p></article>', "real text\nb"),
    ('<div class="layout has-sidebar"><article>story</article><div class="sidebar">side</div></div>', "story"),
    ('<div class="sidebar layout"><article>story</article><div class="related"><article>teaser</article></div></div>', "story"),
    ('<article><p>Search <span class="search">term</span> end</p></article>', "Search term end"),
    ('<p>Search <span class="search">term</span> end</p><p><a class="share">Share</a></p>', "Search term end"),
    ("<body><article><p>one</p></article><p>aside</p><article><p>two is longer</p></article></body>", "one\ntwo is longer"),
    ("<article><p>before</p><article><p>quoted</p></article><div class='ad'>buy</div><p>after</p></article>", "before\nquoted\nafter"),
    ("<nav>menu</nav><main><h1>Head</h1><p>lead</p><article><p>story</p></article></main>", "Head\nlead\nstory"),
    ("<form id='aspnetForm'><nav>m</nav><div><h1>T</h1><p>story text is here and long</p></div></form>", "T\nstory text is here and long"),
    ("<article>text <button>go</button>more<svg><text>x</text></svg> <label>l</label> end</article>", "text more l end"),
    ('<article><h2 id="search-results">Found</h2><section id="social-impact"><p>Impact</p></section><table class="data share"><tr><td>cell</table><p id="notice">Notice</p><p>last</p></article>', "Found\nImpact\ncell\nNotice\nlast"),
    ('<article><p>a</p><div class="share">s</div><div class="notice">n</div><div id="comment-list">c</div><ul class="related-posts"><li>r</ul><p class="advert">b</p><div class="newsletter-signup">w</div><div class="ad-slot-12">x</div><p>z</p></article>', "a\nz"),
    ("<article><p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> <object data='u'>square</object> units.</p></article>", "The area is x=2 square units."),
    ("<form id='aspnetForm'><div><h1>T</h1><p>story text is here and long</p></div></form>", "T\nstory text is here and long"),
    ("<form><label>Name</label><input><label>Password</label><button>go</button></form>", ""),
    ("<article>a<hr>b<br>c</article>", "a\nb c"),
    ("<article>x</article><article class='comment'>c</article>", "x"),
    ("<header><h1>Site</h1></header><article><header><h1>Story</h1></header><p>x</p><footer>by</footer></article>", "Story\nx"),
    ("<nav>a</nav><form>q</form>", ""),
    ("", ""),
    ("<p>a<script>var t='</p>';</script>b &lt;i&gt; &#233;&nbsp;x</p>", "ab <i> é x"),
    ('<article><p>a <a title="it\'s">b</a> c</p><p class=x>d</article>', "a b c\nd"),
    ("<p>a</p> tail <!-- unclosed text", "a\ntail"),
    ("<p>a</p><!-- > unclosed text", "a"),
    ("<p>a</p><script>if(a>b) unclosed", "a"),
    ("<p>a < b and c", "a < b and c"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def _folded(pages):
    template = None
    for p in pages:
        one = skeleton(parse(p))
        template = one if template is None else fold(template, one)
    return from_json(to_json(template))


def test_constant_nodes_are_template_and_slots_content():
    pages = [f"<body><div><p>Read our magazine</p></div><div><p>story {i} goes on and on</p><p>end {i}</p></div>" for i in range(6)]
    assert main_text(pages[3], _folded(pages)) == "story 3 goes on and on\nend 3"
    assert main_text(pages[3], _folded(pages[:2])) == "Read our magazine\nstory 3 goes on and on\nend 3"
    pages = [f"<article><h1>Story {i}</h1><p>By our staff</p><p>long text of story number {i} that goes on and on</p></article>" for i in range(6)]
    assert main_text(pages[2], _folded(pages)) == "Story 2\nlong text of story number 2 that goes on and on"
    near = [f"<article><h1>Story</h1><p>A long paragraph that all copies share</p><p>v{i}</p></article>" for i in range(6)]
    assert main_text(near[2], _folded(near)) == "Story\nA long paragraph that all copies share\nv2"


def test_short_articles_lose_what_all_pages_end_with():
    pages = [f"<article><h1>Story {i}</h1><p>short {i}</p><p>Follow us for more stories every day of the week</p></article>" for i in range(20)]
    assert main_text(pages[7], _folded(pages)) == "Story 7\nshort 7"


def test_templates_of_a_host_are_folded_in_rounds(spark, monkeypatch):
    pages = [(i, "http://one.example/p", f"<body><div><p>Read our magazine</p></div><div><p>story {i} goes on</p><p>end {i}</p></div>") for i in range(60)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(30)
    monkeypatch.setattr(wrappers, "FAN", 3)
    found = {r.page_id: r.text for r in wrappers.extract(rows).collect()}
    assert found == {i: f"story {i} goes on\nend {i}" for i in range(60)}


def test_deep_and_wide_pages_take_no_long_time():
    began = time.perf_counter()
    assert main_text("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000) == "deep"
    assert main_text("<a \"x" * 100_000 + ">") == "" and main_text("<!--" * 100_000) == ""

    def nested(n, k):
        page = "t"
        for i in range(n):
            page = f"<div>{page}<section>a</section></div><section>{i}</section><div>x</div>" if (i * k) % 3 else f"<section>q</section><div>{page}</div><section>{i}</section>"
        return skeleton(parse(page))

    fold(nested(300, 1), nested(300, 2))
    wide = "<article>" + "".join(f"<p>{i}</p><h2>{i}</h2>" for i in range(3000)) + "</article>"
    fold(skeleton(parse(wide)), skeleton(parse(wide.replace("<h2>5</h2>", ""))))
    assert time.perf_counter() - began < 8


def test_weights_equal_all_order_keeping_matches():
    def best(a, b):
        if a.label != b.label:
            return 0

        def rows(i, j):
            if i == len(a.children) or j == len(b.children):
                return 0
            w = best(a.children[i], b.children[j])
            return max(rows(i + 1, j), rows(i, j + 1), w + rows(i + 1, j + 1) if w else 0)

        return 1 + rows(0, 0)

    pages = ["<ul><li>a<p>b</ul><div><h1>x</h1><p>y</div><h2>z</h2>", "<div><p>y<h1>x</h1></div><ul><li>c</ul><h2>z</h2><ul><li>d</ul>", "<h2>q</h2><div><h1>x</h1><h2>w</h2><p>y</div><p>k"]
    trees = [skeleton(parse(p)) for p in pages]
    for a in trees:
        for b in trees:
            if [x.label for x in a.children] != [y.label for y in b.children]:
                assert wrappers.Matcher().weight(a, b) == best(a, b)


@pytest.mark.parametrize("broadcast_bytes", [32_000_000, 0])
def test_extract_equals_a_fold_by_hand(spark, sf_dir, broadcast_bytes):
    known = pd.read_parquet(f"{sf_dir}/pages.parquet")
    made = [(10_000_000 + i, f"http://made.example/{i % 40}", f"<body><div class='x'><p>Follow our magazine</p></div><div><h1>Title {i % 40}</h1><p>text {i % 40} more</p></div></body>") for i in range(60)]
    odd = [(None, None, None), (1, "no url", "<p>x"), (1, "no url", "<p>x"), (2, "http://U@Made.Example:80/z", "<div><h1>Other</h1><p>thing</p></div>")]
    rows = [(int(a), b, c) for a, b, c in zip(known.page_id, known.url, known.html, strict=True)] + made + odd
    # Columns with clashing names are ignored.
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(5)
    hosts: dict = {}
    for _, url, html in rows:
        host = (url or "").split("//")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if "//" in (url or "") else ""
        hosts.setdefault(host, {})[html or ""] = None
    templates = {h: _folded(list(p)) for h, p in hosts.items()}
    wanted = []
    for i, url, html in rows:
        host = (url or "").split("//")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if "//" in (url or "") else ""
        text = main_text(html or "", templates[host])
        wanted.append((i or -1, url or "", text, len(text)))
    got = wrappers.extract(pages, broadcast_bytes=broadcast_bytes).collect()
    assert sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in got) == sorted(wanted)
    assert {r.text for r in got if (r.page_id or 0) >= 10_000_000} == {f"Title {i}\ntext {i} more" for i in range(40)}
    assert wrappers.extract(pages.limit(0)).count() == 0
