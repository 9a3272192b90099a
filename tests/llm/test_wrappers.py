from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import pytest

from eventloom.llm import wrappers


def page(i, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body><div class="menu"><a href="/">Home</a></div>
    <div id="frame"><p>Latest offers at our shop</p><div class="x1">{body}</div><p>All rights kept by us</p></div>{extra}<script>var a = "<p>no</p>";</script></body></html>"""


def texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    return {r["page_id"]: r["text"] for r in wrappers.main_texts(frame).collect()}


def test_constant_nodes_go(spark):
    rng = random.Random(4)
    bodies = ["".join(f"<p>Para {i} {k} {rng.random()} &amp; more</p>" for k in range(rng.randint(1, 6))) for i in range(40)]
    got = texts(spark, [(f"http://Host.example/{i}", page(i, b)) for i, b in enumerate(bodies)])
    for i, b in enumerate(bodies):
        assert got[i] == b.replace("<p>", "").replace("&amp;", "&").replace("</p>", "\n").strip("\n")


def test_semantics_of_single_pages(spark):
    html = """<body><header>Site</header><nav>Menu</nav><article><header><h1>Title &mdash; x</h1></header><p>One<br>two   three</p>
    <div class="ad-slot">Buy</div><ul><li>a<li>b</ul><form>Mail <input></form><section class="comments"><p>reader</p></section></article><aside>Side</aside><footer>F</footer></body>"""
    assert texts(spark, [("http://one.example/", html)])[0] == "Title — x\nOne two three\na\nb"


def test_tree_matching():
    read, written = wrappers.read, wrappers.written
    a, b = "html(body(div.a(p),p,ul(li)))", "html(body(p,ul(li,b)))"
    assert written(read(a)) == a
    assert len(wrappers.matched(read(a), read(b))) == 5
    merged = wrappers.template_of([a, b])
    assert all(-1 not in wrappers.places(merged, s) for s in (a, b))


def test_awkward_rows(spark):
    pages = [("http://h/1", None), (None, ""), ("http://h/2", "no tags at all"), ("http://h/2", "no tags at all"), ("x", "<p>un<b>closed &lt; <!-- gone"), ("http://h/3", "<div>" * 3_000 + "deep"), ("http://h/4", "<p>" + "long " * 50_000)]
    got = texts(spark, pages)
    assert got[0] == got[1] == "" and got[2] == got[3] == "no tags at all" and got[4] == "unclosed <" and got[5] == "deep" and len(got[6]) == 5 * 50_000 - 1
    assert texts(spark, []) == {}


def test_content_in_worded_containers(spark):
    text = "Some words of the story that go on for a while."
    pages = [f'<body><div class="menu">Menu</div><div class="{c}"><article><p>{text}</p></article><div class="sidebar">Side</div></div></body>' for c in ("page with-sidebar", "discussion", "widget", "form", "related", "search")]
    pages += [
        f'<body><div class="widget"><div class="form"><main><p>{text}</p></main></div></div></body>',
        f'<body><p>Short</p><div class="search"><div class="widget"><p>{text}</p></div></div></body>',
        f'<body><article><p>{text}</p></article><div class="related"><article><p>Other</p></article></div></body>',
        '<body><div class="entry"><p>One</p></div><div class="ad">Buy</div><div class="entry"><p>The second</p></div><div class="text"><p>3</p></div></body>',
        "<body><article><p>One</p></article><article><p>The second</p></article></body>",
    ]
    got = texts(spark, [(f"http://h{i}.example/", p) for i, p in enumerate(pages)])
    assert [got[i] for i in range(7)] == [text] * 7 and got[7] == f"Short\n{text}" and got[8] == text
    assert got[9] == "One\nThe second\n3" and got[10] == "One\nThe second"


def by_hand(pages):
    """All pages of a host at once, in plain Python: page_id -> text."""
    hosts, out = defaultdict(list), {}
    for i, url, source in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        hosts[m[1].lower() if m else ""].append((i, wrappers.Page(source or "")))
    for held in hosts.values():
        template = wrappers.template_of([wrappers.written(p.root) for _, p in held])
        placed = {}
        for i, p in held:
            place = wrappers.places(template, wrappers.written(p.root))
            placed[i] = [(place[b["node"]], tuple(2 * place[m // 2] + m % 2 for m in b["marks"]), b["text"], b["linked"]) for b in wrappers.blocks_of(p)]
        distinct = {tuple(b[2] for b in blocks): blocks for blocks in placed.values()}
        on, texts = defaultdict(set), defaultdict(lambda: defaultdict(list))
        for k, blocks in enumerate(distinct.values()):
            for place, marks, text, linked in set(blocks):
                on[place].add(k)
                texts[place, marks][text].append(max(0, len(text) - linked))
        slots, constant = [], set()
        for (place, marks), found in texts.items():
            same = {t for t, x in found.items() if len(x) >= max(wrappers.CONSTANT_PAGES, wrappers.CONSTANT_SHARE * len(on[place]))}
            if sum(len(found[t]) for t in same) < wrappers.CONSTANT_SHARE * sum(map(len, found.values())):
                same = set()
            constant |= {(place, t) for t in same}
            volume = lambda ts: sum(len(t) * len(found[t]) for t in ts)  # noqa: B023, E731
            slots.append(wrappers.Slot(place, marks, sum(max(x) for x in found.values()), len(found), len(on[place]), volume(found), volume(same)))
        r = wrappers.region_of(template, slots)
        for i, blocks in placed.items():
            kept = []
            there = any(r.lo <= b[0] < r.hi for b in blocks)
            for place, marks, text, linked in blocks:
                if there:
                    good = r.lo <= place < r.hi or place in r.titles
                    good &= not any(r.lo < m // 2 < r.hi and m // 2 not in r.void for m in marks)
                    good &= not (r.drops_constant and (place, text) in constant and place not in r.heads)
                    good &= not (r.whole and 2 * linked > len(text))
                else:
                    good = not marks and 2 * linked <= len(text)
                if good:
                    kept.append(text)
            out[i] = "\n".join(kept)
    return out


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in frame.collect()]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame).collect()}
    assert len(got) == len(rows) and got == by_hand(rows)
    # What varies tells the article without any tag or word, where a host has some pages.
    plain = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame, semantic=False).collect()}
    host = {i: re.sub(r"^\w+://([^/?#:]*).*", r"\1", u) for i, u, _ in rows}
    many = {h for h, n in Counter(host.values()).items() if n >= 8}
    assert len(many) > 3 and all(got[i] == plain[i] for i in got if host[i] in many)


def test_many_layouts(spark):
    """Hosts of random layouts, with copies, against the plain version."""
    rng = random.Random(11)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    said = lambda n: " ".join(word() for _ in range(n))
    pages = []
    for h in range(12):
        fixed, comments = said(8), rng.random() < 0.5
        outer = rng.choice(["<div class='x'>%s</div>", "<main>%s</main>", "<form>%s</form>", "<article>%s</article>", "%s"])
        for i in range(rng.randint(1, 30)):
            body = "<h1>%s</h1>" % said(4) + "".join(f"<p>{said(rng.randint(5, 40))}</p>" for _ in range(rng.randint(1, 5))) + f"<div class='ad'>{said(5)}</div>"
            more = f"<section class='comments'><p>{said(60)}</p></section>" if comments else ""
            pages.append((f"http://h{h}.example/{i}", f"<body><nav><a href=/>{said(3)}</a></nav><div class='top'>{fixed}</div>{outer % body}{more}<footer>{said(6)}</footer></body>"))
            if rng.random() < 0.2:
                pages += [pages[-1]] * 3
    assert texts(spark, pages) == by_hand([(i, u, h) for i, (u, h) in enumerate(pages)])


def test_the_template_decides(spark):
    """Unmarked parts of fixed wording go where a host has many pages; one page alone can't tell."""
    rng = random.Random(3)
    said = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    fixed = "Our shop is the best of all shops in town and beyond and you should really come and see it"
    articles = [said(12) for _ in range(30)]
    pages = [f"<body><div class=a1><p>{fixed} {fixed}</p></div><div class=b2><p>{a}</p></div></body>" for a in articles]
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    on = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame).collect()}
    off = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame, templates=False).collect()}
    assert on == dict(enumerate(articles)) and all(off[i] != a for i, a in enumerate(articles))


def test_copies_of_one_article_stay(spark):
    rng = random.Random(5)
    pages = [(f"http://h.example/{i}", f"<body><nav>{rng.random()}</nav><div class=q><p>The one article of this host, on many pages.</p><p>Its end.</p></div></body>") for i in range(40)]
    assert set(texts(spark, pages).values()) == {"The one article of this host, on many pages.\nIts end."}


def test_fuzzed_tags(spark):
    rng = random.Random(8)
    parts = ["<", ">", "a((", "a)))", "<p", "</p>", "<div class=\"", "'", '"', "=", "<x,y", "<b.c(d)>", "text", "<!--", "-->", "</", "<table><tr><td>", "<li>", "\u0000", "é", "<script>", "</script>", "&amp;", "<h1>"]
    pages = [(f"http://f{i % 7}.example/", "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    pages += [("http://g.example/", "<p>x<a((>y"), ("http://g.example/", "<p>x<a)))>y</p>")]
    got = texts(spark, pages)
    assert got[400] == "xy" and got[401] == "xy" and got == by_hand([(i, u, h) for i, (u, h) in enumerate(pages)])


@pytest.mark.parametrize("source", ["<a " * 330_000, '<a "><a "' * 100_000 + '"', "<a '\"><b \"'>" * 60_000, "<div>" * 100_000 + "</p></x>" * 60_000, "<li>" * 200_000, "<!--" * 250_000, "<script>" * 120_000])
def test_linear_time(source):
    began = time.process_time()
    page = wrappers.Page(source)
    assert len(wrappers.written(page.root)) >= 4 and time.process_time() - began < 15


def test_deep_marks_and_ids(spark):
    deep = "<div>" * 125 + "<nav>MENU</nav>text"
    big = 2**53 + 1
    frame = spark.createDataFrame([(big, "http://a/", deep), (None, "http://a/", deep)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.main_texts(frame).collect()} == {big: "text", None: "text"}
