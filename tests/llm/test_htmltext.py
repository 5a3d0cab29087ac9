"""Main text: made pages with known articles, broken markup, odd rows."""

import html
import math
import random
import time
from html.parser import HTMLParser

from lodestar.llm import htmltext
from lodestar.llm.htmltext import extract, main_text


def prose(rng, n):
    words = ["".join(rng.choice("aeioustrln") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", "."]) for w in words).capitalize() + "."


def page(rng, wrap):
    paragraphs = [prose(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 12))]
    title = "A title & more"
    nav = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(6))
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    inner = wrap.replace("TITLE", f"<h1>{html.escape(title)}</h1>").replace("BODY", body)
    whole = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        f"<body><header>Site name. Big header, here.</header><nav><ul>{nav}</ul></nav><!-- <p>no</p> -->"
        f"<div class='ad'>{prose(rng, 40)}</div><div id=\"cookie-notice\"><p>{prose(rng, 30)}</p></div>{inner}"
        f"<aside><p>{prose(rng, 50)}</p></aside><form><p>{prose(rng, 20)}</p><input value='x'></form>"
        f"<section class='reader-comments'><p>{prose(rng, 60)}</p></section><footer>&copy; {prose(rng, 30)}</footer>"
    )
    return whole, "\n".join([title, *paragraphs])


def test_articles_come_out_whole():
    rng = random.Random(8)
    for wrap in ("<article>TITLE BODY</article>", "<main><div class='post'>TITLEBODY</div></main>", "<div class='story'>TITLEBODY</div>"):
        for _ in range(40):
            whole, text = page(rng, wrap)
            assert main_text(whole) == text


def test_broken_markup_entities_and_white_space():
    assert main_text("<article><p><b>One  two.<br>three<p>a &lt;b&gt; &amp;amp; &#233;\n\tx</article>") == "One two. three\na <b> &amp; é x"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>open <a href='>'>a</a> end. <ul><li>x, y.<li>z, w.") != ""
    assert main_text("<article><p>cut &am</p><p>tail") == "cut &am\ntail"
    assert main_text("<div><script>if (a<b) x()</script></div>") == ""
    assert main_text("<") == "<" and main_text("<!-- open") == "" and main_text("<p") == ""


def test_names_inside_values_and_layout_classes_drop_no_article():
    text = "Some text, which is long enough. " * 5
    for attributes in ('style="overflow:hidden"', 'title="a hidden path"', "data-hidden=1", 'data-class="menu"'):
        assert main_text(f"<article><div {attributes}><p>{text}</p></div></article>") == text.strip(), attributes
    for attributes in ("hidden", "HIDDEN", "a=b hidden=''", "aria-hidden='true'", "role=search"):
        assert main_text(f"<article><p>{text}</p><div {attributes}><p>No. {text}</p></div></article>") == text.strip(), attributes
    side = "<div class='sidebar'><p>Other things, aside.</p></div>"
    for name in ("content has-sidebar", "no-sidebar", "post search-result", "container nav-open"):
        assert main_text(f"<div class='{name}'><article><p>{text}</p></article>{side}</div>") == text.strip(), name
        assert main_text(f"<div class='{name}'><div id='no-menu'><main><p>{text}</p></main></div></div>{side}") == text.strip(), name
        assert main_text(f"<article><h1>T</h1><div class='{name}'><p>{text}</p></div></article>") == "T\n" + text.strip(), name
        assert main_text(f"<div class='{name}'><p>{text}</p></div>{side}") == text.strip(), name
    comments = f"<section class='comments'><article><p>{text * 3}</p></article></section>"
    assert main_text(f"<article><p>{text}</p></article><div class='comments'><p>{text * 3}</p></div>") == text.strip()
    assert main_text(f"<div class='has-sidebar'><article><p>{text * 5}</p></article>{comments}</div>") == (text * 5).strip()


def test_selected_text_outside_the_largest_part_stays():
    one, other = "First part, of two. " * 13, "Second part, of two. " * 7
    for page in (
        "<div id=content><section><p>{}</p></section><section><p>{}</p></section></div>",
        "<main><article><p>{}</p></article><article><p>{}</p></article></main>",
        "<body><article><p>{}</p></article><article><p>{}</p></article></body>",
        "<body><article><p>{}</p></article><div><p>{}</p></div></body>",
    ):
        assert main_text(page.format(one, other)) == f"{one.strip()}\n{other.strip()}", page
        assert main_text(page.format(other, one)) == f"{other.strip()}\n{one.strip()}", page


def test_names_within_articles_drop_nothing():
    text = "Some text, which is long enough. " * 5
    for element in ('<p style="overflow:hidden">', '<p title="the hidden valley">', '<p data-src="/hidden/a.png">', '<p data-id="menu">'):
        assert main_text(f"<article><p>{text}</p>{element}Short.</p></article>") == text.strip() + "\nShort.", element
    assert main_text(f'<body><div style="overflow:hidden"><p>{text}</p></div>') == text.strip()


def test_quotes_begin_after_an_equals_sign_only():
    text = "Some text, which is long enough. " * 5
    for tag in ("<p title=don't>", "<p don't>", '<p 5">', "<p a=b'c d=e>", "<p title='>'>", '<p a = ">" b>', "<p a=>", "<p =>", "<p a='x'b=\"y\">"):
        assert main_text(f"<article>{tag}{text}</p><p>And more, isn't it.</p></article>") == text.strip() + "\nAnd more, isn't it.", tag


def test_compound_names_and_ids_in_articles_mark_nothing():
    text = "Some text, which is long enough. " * 5
    for tag in ("<p class=related-work>", "<section id=search>", "<div class='search-theory'>", "<p class='notice-period x'>", "<div class=headers>"):
        end = tag[1:].split()[0]
        assert main_text(f"<article><p>{text}</p>{tag}Short, one.</{end}></article>") == text.strip() + "\nShort, one.", tag
    for name in ("ad", "top-ad", "related-posts", "site-header", "cookie_banner", "share-buttons", "comment-12", "a sidebar"):
        assert main_text(f"<article><p>{text}</p><div class='{name}'>Short, one.</div></article>") == text.strip(), name


def test_sections_headed_as_comments_go():
    text = "Some text, which is long enough. " * 5
    for head in ("Comments", "12 comments", "Comments (3)", "Kommentare", "Leave a reply"):
        page = f"<article><h1>T</h1><p>{text}</p></article><section><h2>{head}</h2><p>{text}</p><ul><li>{text}</ul></section>"
        assert main_text(f"<body>{page}</body>") == "T\n" + text.strip(), head
        assert main_text(f"<body><article><h1>T</h1><p>{text}</p><div><h3>{head}</h3><p>No.</p></div></article>") == "T\n" + text.strip(), head
    kept = f"<article><h1>Comments</h1><p>{text}</p></article>"  # an article of that title
    assert main_text(kept) == "Comments\n" + text.strip()
    later = f"<article><section><p>{text}</p><h2>Comments on the text</h2><p>{text}</p></section></article>"
    assert main_text(later) == f"{text.strip()}\nComments on the text\n{text.strip()}"


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    n = 20_000
    deep = "".join(f"<div class=c{i % 7}>word {i}, here." for i in range(n))
    assert main_text(deep).count("\n") == n - 1
    closed = "<div>" * n + "<p>Text, here.</p>" + "</div>" * n
    assert main_text(closed) == "Text, here."
    marked = "<div class=ad>" * n + "<article><p>Text, here.</p></article>"
    assert main_text(marked) == "Text, here."
    assert main_text("<div class=ad>word, x." * n + "<article>y.") != ""
    assert time.perf_counter() - began < 8  # far under a second each on an idle machine


class Tree(HTMLParser):
    """Well-formed pages as text blocks with their elements, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.n = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.n += 1
        self.open.append((tag, ".".join([tag, *sorted((dict(attrs).get("class") or "").split())]), self.n))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if text := " ".join(data.split()):
            flow = [x for x in self.open if x[0] != "a"]
            self.out.append((flow, text, len(text) if flow != self.open else 0))


def plain_main_text(page):
    """The same choice with nothing kept between loops; pages without marks, one link a block at most."""
    tree = Tree()
    tree.feed(page)
    rows = tree.out

    def below_body(flow):
        return [x[1] for x in flow if x[0] not in ("html", "body")]

    def fused(begun):
        some = [(t, link) for flow, t, link in rows if below_body(flow)[: len(begun)] == begun]
        size = sum(len(t) - link for t, link in some) / len(some)
        marks = sum(t.count(m) for t, _ in some for m in ".,;:!?") / len(some)
        return math.log1p(size) * (1 + math.log1p(marks))

    score = []
    for flow, _, _ in rows:
        path = below_body(flow)
        parts = [(0.5 ** (len(path) - n), fused(path[:n])) for n in range(1, len(path) + 1)]
        score.append(sum(w * x for w, x in parts) / sum(w for w, _ in parts))
    chosen = [x >= 0.6 * max(score) for x in score]

    def node(flow):
        for kinds in (("article", "main"), ("div", "section", "td", "body")):
            if inner := [x[2] for x in flow if x[0] in kinds]:
                return inner[-1]

    links = [2 * link > len(t) for _, t, link in rows]
    nodes = {node(flow) for (flow, _, _), good, link in zip(rows, chosen, links) if good and not link}
    kept = [node(f) in nodes and (good or not link or any(x[0] in ("article", "main") for x in f)) for (f, _, _), good, link in zip(rows, chosen, links)]
    kept = kept if any(kept) else chosen
    for i in range(len(rows) - 2, -1, -1):
        kept[i] = kept[i] or (kept[i + 1] and rows[i][0][-1][0] in ("h1", "h2"))
    return "\n".join(t for (_, t, _), stays in zip(rows, kept) if stays)


def made(rng, depth=0):
    """Elements at random, without names that mark boilerplate."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "p", "p", "h2", "li", "div", "section", "article"] if depth < 3 else ["p"])
        if kind in ("div", "section", "article"):
            name = rng.choice(["", " class='x1'", " class='b a'"])
            out.append(f"<{kind}{name}>{made(rng, depth + 1)}</{kind}>")
        elif kind == "li":
            out.append("<ul>" + "".join(f"<li><a>{prose(rng, rng.randrange(1, 4))}</a></li>" for _ in range(3)) + "</ul>")
        else:
            out.append(f"<{kind}>{prose(rng, rng.choice([3, 10, 60, 120]))}</{kind}>")
    return "".join(out)


def test_choice_equals_brute_force_over_a_tree():
    rng = random.Random(11)
    for _ in range(300):
        page = f"<html><body>{made(rng)}</body></html>"
        assert main_text(page) == plain_main_text(page), page


def test_ratios_decide(monkeypatch):
    rng = random.Random(5)
    pages = [
        f"<body><div class=q7><p>{prose(rng, 4)}</p></div><div class=z1><h1>Title</h1><p>{prose(rng, 90)}</p><p>{prose(rng, 40)}</p></div>"
        f"<div class=k2>{prose(rng, 3)}</div></body>"
        for _ in range(30)
    ]
    found = [main_text(p) for p in pages]
    assert all(x.startswith("Title\n") and x.count("\n") == 2 for x in found)
    monkeypatch.setattr(htmltext, "ratios", lambda page, some: {page.path[b.element]: 1.0 for b in some})
    assert all(main_text(p).count("\n") == 4 for p in pages)


def test_rows(spark):
    rows = [(1, "u", "<article><p>Äb, c.</p></article>"), (2, None, None), (3, "x", ""), (None, "y", "<p>t.</p>")]
    rows += [(1, "u", rows[0][2]), (4, "z", "<article>" + "<p>Some text, here.</p>" * 30000 + "</article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(pages).collect()}
    assert out[1, "u"] == ("Äb, c.", 6) and out[2, None] == ("", 0) and out[3, "x"] == ("", 0)
    assert out[None, "y"] == ("t.", 2) and out[4, "z"][0].count("\n") == 29999
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).collect() == []
