"""Main text of pages: classes against exact vectors, templates of small hosts, odd and very long pages."""

import random
import time
from collections import defaultdict

from skeinflow.llm import html

SCHEMA = "page_id long, url string, html string"


def _got(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def _say(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_classes_are_those_of_exact_vectors(spark):
    rng = random.Random(1)
    pages = []
    for i in range(40):
        parts = [f"<div class='top'>Name</div>", f"<div class='a'>{_say(rng, 3)}</div>" if i % 2 else "", f"<div class='b'><section>{_say(rng, 20)}</section>{'<section>x</section>' * (i % 3)}</div>", "<div class='c'>Fine print</div>" if i % 4 else ""]
        pages.append((i, f"https://h{i % 2}.example/{i}", "".join(parts)))
    frame = spark.createDataFrame([(*p, p[1][8:10]) for p in pages], SCHEMA + ", host string")
    got = {(r["host"], frozenset(x["token"] for x in r["tokens"])) for r in html.classes(frame).collect()}
    want = set()
    for host in ("h0", "h1"):
        own = [html._tokens(p[2]) for p in pages if p[1][8:10] == host]
        vectors = defaultdict(list)
        for token in {t for x in own for t in x}:
            vectors[tuple(x[token][2] if token in x else 0 for x in own)].append(token[1])
        want |= {(host, frozenset(ts)) for v, ts in vectors.items() if sum(map(bool, v)) >= max(2, html.SHARE * len(own))}
    assert got == want and len(want) > 4


def test_hosts_of_five_pages_without_marks(spark):
    """Layouts of plain div elements: menus of links, repeated notices and fine print go, all else stays."""
    rng = random.Random(2)
    rows, want = [], {}
    for host in range(6):
        name, fine = _say(rng, 4), _say(rng, 9)
        for k in range(5):
            i = len(rows)
            blocks = [_say(rng, 6), *[_say(rng, 20 + rng.randrange(30)) for _ in range(2 + rng.randrange(3))]]
            links = "".join(f"<a href='/{x}'>{_say(rng, 2)}</a> " for x in range(6))
            body = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
            notice = f"<p>{name} asks you to write to us</p>"
            rows.append((i, f"https://s{host}.example/{k}", f"<html><body><div class='x'>{name}</div><div class='y'>{links}</div><div class='z'>{body}{notice}</div><div class='q'>{fine}</div></body></html>"))
            want[i] = "\n\n".join(blocks)
    assert _got(spark, rows) == want


def test_order_within_a_class_decides():
    span = lambda t, pos, end, chars: {"token": t, "pos": pos, "end": end, "chars": chars}
    assert [x["token"] for x in html.ordered([span(1, 0, 100, 50), span(2, 1, 40, 30), span(3, 20, 60, 5), span(4, 61, 90, 9)])] == [1, 2, 4]
    assert [x["token"] for x in html.ordered([span(1, 0, 100, 50), span(3, 2, 30, 5), span(2, 10, 40, 30)])] == [1, 2]
    # Of one class, the lighter of the two that cross goes with what it holds; of two classes, both nest.
    x = lambda t, up, mark, *at: span(t, *at) | {"kind": html.ELEMENT, "up": up, "mark": mark, "links": 0, "shown": 4}
    left = [x(1, 0, 0, 0, 100, 100), x(3, 1, 2, 2, 30, 40), x(4, 3, 0, 5, 10, 38)]
    right = [x(2, 1, 0, 20, 60, 45), x(5, 2, 0, 35, 40, 20), x(6, 2, 0, 45, 50, 20)]
    assert html.nest(4, [(4, 4, left + right)])["container"] == 1
    assert html.nest(4, [(4, 4, left), (3, 3, right)])["container"] == 3


def test_copied_pages_keep_their_article(spark):
    rng = random.Random(3)
    text = [_say(rng, 40) for _ in range(4)]
    page = lambda i: f"<html><body><div class='t'>N</div><div class='m'>" + "".join(f"<p>{t}</p>" for t in text) + f"<p>copy {i}</p></div></body></html>"
    got = _got(spark, [(i, f"https://c.example/{i}", page(i)) for i in range(6)] + [(10 + i, f"https://d.example/{i}", page(0)) for i in range(6)])
    assert all("\n\n".join([*text, f"copy {i}"]) in got[i] for i in range(6)) and all("\n\n".join(text) in got[10 + i] for i in range(6))


def test_attributes_and_names(spark):
    pages = [
        ('<html><body><p style="overflow:hidden">hello world</p></body></html>', "hello world"),
        ('<p aria-hidden="false">one two</p>', "one two"),
        ('<div title="the hidden gem">three</div>', "three"),
        ('<html><body class="post no-sidebar comments-open"><article><p>some text</p></article></body></html>', "some text"),
        ("<body class='menu'><div class='sidebar'><article><p>only here</p></article></div></body>", "only here"),
        ("<body><form><div><p>in a form</p></div></form></body>", "in a form"),
        ("<article><p>a</p><p hidden>b</p><div class='cookie-notice'>c</div><div class='with-ads'>d</div><div id='commentList'>e</div><p data-id='comments'>f</p></article>", "a\n\nd\n\nf"),
        ("<article>x &lt;b&gt; &amp;amp; y&nbsp; z<br>q<ul><li>1<li>2</ul><script>var a='</p>'</script></article><article>second</article>", "x <b> &amp; y z q\n\n1\n\n2\n\nsecond"),
        ("", ""),
        ("<div></div>", ""),
        (None, ""),
    ]
    rows = [(i, None if i % 3 else f"https://p{i}.example/", p) for i, (p, _) in enumerate(pages)]
    assert [html.slots(p or "", None) for p, _ in pages] == [w for _, w in pages]
    assert {k: v for k, v in _got(spark, rows).items() if k % 3 == 0} == {i: w for i, (_, w) in enumerate(pages) if i % 3 == 0}


def test_names_do_not_decide_over_text(spark):
    """Articles in wrappers with names of furniture, alone and on a host of four pages; small things of such names go."""
    rng = random.Random(5)
    for name in ("widget content", "main-alert", "promo-article", "content", "banner-text"):
        texts = [[_say(rng, 30), _say(rng, 12)] for _ in range(4)]
        page = lambda k, t: f"<html><body><div class='{name}'><p>{t[0]}</p><p>{t[1]}</p></div><div>Copyright {k} note</div></body></html>"  # noqa: E731,B023
        want = ["\n\n".join(t) for t in texts]
        assert [html.slots(page(0, t), None).startswith(w) for t, w in zip(texts, want, strict=True)] == [True] * 4  # alone, nothing tells of the note
        got = _got(spark, [(i, f"https://{name[:4]}.example/{i}", page(i, t)) for i, t in enumerate(texts)])
        assert [got[i] for i in range(4)] == want, name
    assert html.slots("<article><p>a longer paragraph of words</p><div class='promo'>buy</div><div class='notice'><p>x</p></div></article>", None) == "a longer paragraph of words"


def test_repeated_text_in_the_article_stays(spark):
    """A paragraph and a byline that all pages share stay in what is marked as the article; the menu goes, from two pages on."""
    rng = random.Random(6)
    for n, (a, z) in ((2, ("<article>", "</article>")), (5, ("<article>", "</article>")), (4, ("<main>", "</main>"))):
        texts = [_say(rng, 25) for _ in range(n)]
        rows = [(i, f"https://r{n}.example/{i}", f"<body><div>Menu home news</div>{a}<p>By Ann Other</p><p>{t}</p><p>A paragraph that all have</p>{z}<div>Fine print</div></body>") for i, t in enumerate(texts)]
        assert _got(spark, rows) == {i: f"By Ann Other\n\n{t}\n\nA paragraph that all have" for i, t in enumerate(texts)}
    plain = [(i, f"https://two.example/{i}", f"<body><div>Menu home news</div><div><p>{t}</p></div><div>Fine print</div></body>") for i, t in enumerate(texts[:2])]
    assert _got(spark, plain) == dict(enumerate(texts[:2]))
    most = [(i, f"https://half.example/{i}", f"<body><div>Menu</div><div><p>{t}</p>{'<p>shared by some</p>' if i else ''}</div></body>") for i, t in enumerate(texts)]
    assert _got(spark, most) == {i: t + ("\n\nshared by some" if i else "") for i, t in enumerate(texts)}


def test_comments_and_open_elements():
    for name in ("responses", "discussion", "replylist", "disqus_thread", "comment-list", "commentCount"):
        assert html.slots(f"<article><p>the text itself</p><div id='{name}'><p>first! and more words than the text has</p></div></article>", None) == "the text itself"
    for tag in ("svg", "noscript", "template"):
        assert html.slots(f"<article><p>one</p><{tag}><p>two</p></article>", None) == "one\n\ntwo"
        assert html.slots(f"<article><p>one</p><{tag}><p>no</p></{tag}><p>two</p></article>", None) == "one\n\ntwo"
    assert html.slots("<article><p>one</p><script>var x = '<p>two</p>'", None) == "one"


def test_generated_hosts_against_their_parts(spark):
    """Hosts of one to six pages in several layouts; equal pages and equal ids each have a row."""
    rng, rows, want = random.Random(7), [], []
    for host in range(24):
        name, fine, menu = _say(rng, 3), _say(rng, 8), "".join(f"<li><a href='/{k}'>{_say(rng, 1)}</a></li>" for k in range(5))
        layout = host % 4
        for k in range(1 + host % 6):
            parts = [_say(rng, 5), *[_say(rng, 15 + rng.randrange(30)) for _ in range(1 + rng.randrange(4))]]
            body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
            side = f"<div class='sidebar'><p>{_say(rng, 10)}</p></div>"
            comments = f"<section class='comments'>{''.join(f'<p>{_say(rng, 9)}</p>' for _ in range(3))}</section>"
            inner = [f"<article>{body}{comments}</article>", f"<main><div>{body}</div></main>{comments}", f"<div class='post'>{body}</div>{comments}", f"<div class='widget content'>{body}</div>"][layout]
            page = f"<html><body><header><div>{name}</div></header><nav><ul>{menu}</ul></nav>{side}{inner}<form><input value='x'>find</form><footer>{fine}</footer></body></html>"
            rows.append((host, f"https://g{host}.example/{k}", page))
            want.append((host, "\n\n".join(parts)))
    rows += rows[:3]
    want += want[:3]
    got = [(r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


def test_very_long_and_deep_pages():
    began = time.time()
    assert html.slots("<div>" * 50_000 + "x", None) == "x"
    assert html.slots("<div>" * 20_000 + "x" + "</b></div>" * 20_000, None) == "x"
    assert html.slots("<article>" + "<p>word word</p>" * 50_000 + "</article>", None).count("word word") == 50_000
    assert html.slots("<p>" + "a<b " * 50_000, None) != ""
    assert time.time() - began < 60
