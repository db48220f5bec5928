"""Wrappers: alignment by hand, and texts of generated sites against the blocks they were made of."""

import random

from canloom.llm import wrapper as w


TEXTS = {w.mark(t): t for t in ("1", "t", "x", "z")}


def show(part):
    inner = "".join(show(p) for p in part[7])
    body = ("#" if part[6] is None else f"'{TEXTS[part[6]]}'") if part[0] == "#" else f"({inner})" if part[0] == "()" else f"<{part[0]}{' ' + inner if inner else ''}>"
    return body + ("+" if part[3] else "") + ("?" if part[2] else "")


def test_alignment():
    a, b = (w.shape(w.parse(x)) for x in ("<div><p>x</p><p>y</p><ul><li>1</li></ul></div>", "<div><h1>t</h1><p>x</p><ul><li>1<li>2</li></ul></div>"))
    assert show(a) == "< <div <p #>+<ul <li '1'>>>>"
    assert show(w.align(a, b)) == "< <div <h1 't'>?<p #>+<ul <li #>+>>>"
    turns = w.shape(w.parse("<h2>a</h2><p>1</p><h2>b</h2><p>2</p><hr><h2>c</h2><p>3</p><div>z</div>"))
    assert show(turns) == "< (<h2 #><p #>)+<div 'z'>>"
    same = w.shape(w.parse("<p>x</p>"))
    assert show(w.align(same, same)) == "< <p 'x'>>"


def test_tokens():
    tree = w.parse("A<b>b</b> c<br>d<script>var x='</p>';</script>&amp;lt; <p a=\"<>\">e<p>f<!-- <p>no --><style>q</style></div><a href=x>g &eacute;")
    texts = [n[2] for n in tree[1] if n[0] == "#"] + [c[2] for n in tree[1] for c in n[1]]
    assert texts == ["Ab c d&lt;", "e", "f", "g é"]
    assert w.main_text("<script>never closed", None) == "" and w.main_text(None, None) == "" and w.main_text("bare text", None) == "bare text"
    assert w.main_text("<div>" * 500 + "deep" + "</div>" * 500, None) == "deep"


def site(rng, words, kind):
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    blocks = [text(rng.randrange(15, 60)) for _ in range(rng.randrange(2, 8))]
    title = text(5)
    if kind == 0:
        main = f"<article><h1>{title}</h1>" + "".join(f"<p>{b[:10]}<b>{b[10:]}</b></p>" for b in blocks) + f'<form><input name=q>{text(3)}</form></article><div class="comments"><p>{text(50)}</p></div>'
    elif kind == 1:
        main = f'<div class="post-{rng.randrange(99)} content"><h1>{title}</h1>' + "<p>".join(["", *blocks]) + f'<div class="share-bar">{text(4)}</div></div><div id="sidebar"><ul>' + "".join(f"<li><a href=/>{text(2)}</a></li>" for _ in range(6)) + "</ul></div>"
    else:
        main = f"<table><tr><td>{text(2)}</td></tr></table><main><section><h2>{title}</h2>" + "".join(f"<div>\n {b} &amp; \n</div>" for b in blocks) + f"<p>All rights of this page are kept by us.</p></section></main><aside>{text(30)}</aside>"
        blocks = [b + " &" for b in blocks]
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>{text(2)}</a></li></ul></nav><div class='cookie-notice'>{text(25)}</div>{main}<footer>{text(12)}</footer></body></html>"
    return page, " ".join([title, *blocks])


def test_sites(spark, monkeypatch):
    rng, words = random.Random(3), "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()
    rows, want = [], {}
    for i in range(90):
        page, text = site(rng, words, i % 3)
        rows.append((i, f"https://h{i % 3}.example.org/{i}", page, "x"))
        want[i] = text
    rows += [(200, None, None, "x"), (201, "no host", "", "x"), (202, "http://one.example.org", "<p>only  one\npage</p>", "x"), (202, "http://one.example.org", "<p>only  one\npage</p>", "x")]
    want |= {200: "", 201: "", 202: "only one page"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (w.BROADCAST_BYTES, -1):
        monkeypatch.setattr(w, "BROADCAST_BYTES", most)
        got = w.main_texts(pages).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == want[r.page_id] and r.n_chars == len(r.text), (r.page_id, r.text, want[r.page_id])
    assert w.main_texts(pages.limit(0)).count() == 0


def test_optional_parts_of_copies_stay(spark):
    """A quote that only copies of one article have, and a subheading that three articles share, are main text."""
    rng, words = random.Random(7), "alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}

    def add(host, parts, kept):
        body = "".join(f"<{tag}>{t}</{tag}>" for tag, t in parts)
        rows.append((len(rows), f"https://{host}/{len(rows)}", f"<html><body><nav>{text(2)}</nav><article>{body}<div>Kept by us.</div></article></body></html>"))
        want[rows[-1][0]] = " ".join(t for _, t in kept)

    for host, n in (("many.org", 40), ("few.org", 3)):
        for _ in range(n):
            parts = [("h1", text(4)), ("p", text(30)), ("p", text(30))]
            add(host, parts, parts)
        copy = [("h1", text(4)), ("blockquote", text(12)), ("p", text(30)), ("p", text(30))]
        for _ in range(4):
            add(host, copy, copy)
    for _ in range(3):
        parts = [("h1", text(4)), ("h3", "In short"), ("p", text(30)), ("p", text(30))]
        add("many.org", parts, parts)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in w.main_texts(pages).collect()}
    assert got == want


def test_names_of_what_holds_the_article():
    body = "<h1>Title here</h1><p>one two three four five</p><p>six seven eight nine ten</p>"
    want = "Title here one two three four five six seven eight nine ten"
    for page in (f'<body class="no-sidebar"><article>{body}</article></body>', f'<body><div class="content has-sidebar"><div>{body}</div><div id="sidebar"><p>aside</p></div></div></body>'):
        assert w.main_text(page, None) == want == w.main_text(page, w.rule(w.shape(w.parse(page))))
    assert w.main_text('<div class="cookie-notice"><p>We use cookies</p></div>', None) == ""


def test_what_an_article_holds_stays():
    """Title and lead beside the body, linked paragraphs, linked references, blocks by harmless names."""
    lead, first, second = "A lead of some words here", "First paragraph of the text with many words in it", "Second paragraph of the text"
    for page, want in (
        (f'<article><h1>Title</h1><p>{lead}</p><div class=body><p>{first}</p><p>{second}</p></div></article>', ["Title", lead, first, second]),
        (f'<body><div id=x><h1>Title</h1><div class=text><p>{first}</p><p>{second}</p></div><div class=rail><p>teaser</p></div></div></body>', ["Title", first, second]),
        (f'<article><p>{first}</p><p><a href=/s>Read the study</a></p><p>{second}</p></article>', [first, "Read the study", second]),
        (f'<article><p>{first}</p><p class="reply">{second}</p><ol><li><a href=/1>Miller and others, On words, 1999</a></li><li><a href=/2>Smith, More about many words, 2001</a></li></ol></article>', [first, second, "Miller and others, On words, 1999", "Smith, More about many words, 2001"]),
        (f'<article><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><p>{first}</p><div><a href=/a>Older</a> <a href=/b>Newer</a></div></article>', [first]),
        (f'<body><div>{"<div>" * 300}<p>{first}</p>{"</div>" * 300}<p>{second}</p></div><footer>Us</footer></body>', [first, second]),
    ):
        tree = w.parse(page)
        assert w.main_text(page, None) == " ".join(want) == w.main_text(page, w.rule(w.shape(tree))), page


def test_long_page():
    text = " ".join(f"word{i}" for i in range(40_000))
    page = f"<nav>menu</nav><article><p>{text}</p>" + "<p>x y</p>" * 20_000 + "</article>"
    assert w.main_text(page, None) == text + " x y" * 20_000


def test_partitions_dont_matter(spark, monkeypatch):
    """Hot hosts in many leaves, copies, optional parts: the same texts from any partitioning."""
    monkeypatch.setattr(w, "LEAF", 16)
    rng, words = random.Random(5), "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for i in range(300):
        page, _ = site(rng, words, rng.randrange(3))
        if i % 4 == 0:
            page = page.replace("<footer>", "<div><p>Same on some pages</p></div><footer>")
        rows.append((i, f"https://h{0 if i % 3 else i % 7}.org/{i}", page))
        if i % 10 == 0:
            rows += [(1000 * k + i, f"https://h{i % 7}.org/{i}", page.replace("</nav>", f"<b>{k}</b></nav>")) for k in range(1, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert max(w.hot_hosts(pages).values()) >= 3
    got = [{r.page_id: r.text for r in w.main_texts(pages.repartition(n)).collect()} for n in (1, 2, 7, 40)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == len(rows)
