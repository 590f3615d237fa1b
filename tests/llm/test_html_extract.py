import html.parser

from pyspark.sql import functions as F

from simlattice.llm import html_extract as H

PROSE = "This is a sentence, with commas, that goes on for a while, as prose does, and then it ends at last."


def test_article_wins_over_navigation():
    links = "".join(f'<li><a href="/{i}">A link, with a comma, and many words in it, number {i}</a></li>' for i in range(40))
    page = f"<html><body><div id=nav><ul>{links}</ul></div><div class=wrap><div class='post'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div></div><footer><p>{PROSE}</p></footer></body></html>"
    text, score, tag = H.extract(page)
    assert text == f"Title\n{PROSE}\n{PROSE}" and tag == "div" and score > 0


def test_points():
    text, score, tag = H.extract(f"<div><p>{'a' * 250}, b, c</p></div>")
    assert tag == "div" and score == 1 + 2 + 2  # itself, two commas, two hundreds
    assert H.extract("<div><p>short</p></div>")[1] == 0


def test_siblings_are_kept():
    page = f"<section><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p><div><a href=x>{PROSE}</a></div></section>"
    text = H.extract(page)[0]
    assert text.count(PROSE) >= 4


def test_link_density_discounts():
    page = f"<div><p><a href=1>{PROSE}</a></p><p><a href=2>{PROSE}</a></p></div><div><p>{PROSE}</p></div>"
    assert H.extract(page)[0] == PROSE


def test_broken_pages():
    for page in ("<div><p>" + PROSE, "</p></div>" + f"<p>{PROSE}", f"<p>{PROSE}<p>{PROSE}", f"<!-- <p>x</p> --><div><p>{PROSE}</p>", f"<script>var a='<p>no</p>'</script><p>{PROSE}</p>", "<" * 5000 + PROSE, "<div>" * 20_000 + f"<p>{PROSE}</p>", f"<p title='a>b'>{PROSE}"):
        text = H.extract(page)[0]
        assert PROSE in text and "no" not in text.split(), page[:60]


def test_parsing_is_linear_enough():
    import time

    t = time.time()
    H.extract("<p " * 100_000)
    H.extract("<a href='x'>" * 50_000 + PROSE)
    assert time.time() - t < 20


def test_entities_and_blanks():
    assert H.extract(f"<div><p>A &amp; B&nbsp;&lt;x&gt;,  {PROSE}\n\n</p></div>")[0].startswith("A & B\xa0<x>, This")


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: H.extract(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in H.extract_pages(pages).collect()}
    assert set(got) == set(want) and all((r["text"], r["container"]) == (want[i][0], want[i][2]) for i, r in got.items())
    assert sum(bool(r["text"]) for r in got.values()) > 0.9 * len(got)


class _Tree(html.parser.HTMLParser):
    """Another parser, for well-formed pages: lists [tag, attributes, children, parent]."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.root = self.now = ["#root", {}, [], None]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in H.ENDS_P:
            up = self.now
            while up is not None and up[0] != "p" and up[0] not in ("td", "th", "div", "li", "article", "section"):
                up = up[3]
            if up is not None and up[0] == "p":
                self.now = up[3]
        node = [tag, dict(attrs), [], self.now]
        self.now[2].append(node)
        if tag not in H.VOID:
            self.now = node

    def handle_endtag(self, tag):
        up = self.now
        while up is not None and up[0] != tag:
            up = up[3]
        if up is not None:
            self.now = up[3]

    def handle_data(self, data):
        kids = self.now[2]
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def _brute(page):
    """Every paragraph climbs to the root by itself, and texts are measured anew for each node."""
    root, skip, everything = _Tree(page).root, {"script", "style", "title"}, []

    def walk(n):
        everything.append(n)
        for k in n[2]:
            if isinstance(k, list):
                walk(k)

    walk(root)
    named = lambda n: " ".join(v or "" for a, v in n[1].items() if a in ("class", "id", "role"))
    bad = lambda n: n[0] in skip or n[0] in H.BOILERPLATE or n[0] not in H.CONTENT and bool(H._BAD.search(named(n))) and not H._GOOD.search(named(n))

    def size(n, only_links=False):
        return sum((0 if bad(k) else size(k, only_links and k[0] != "a")) if isinstance(k, list) else (0 if only_links else len(k.strip())) for k in n[2])

    def commas(n):
        return sum((0 if bad(k) else commas(k)) if isinstance(k, list) else k.count(",") for k in n[2])

    def hidden(n):
        return n is not None and (bad(n) or hidden(n[3]))

    score, got = {}, set()
    for n in everything:
        score[id(n)] = 25.0 * bool(named(n) and not bad(n) and H._GOOD.search(named(n))) + 10.0 * (n[0] in ("article", "main"))
    for n in everything:
        if n[0] in ("p", "pre", "td", "blockquote") and size(n) >= 25 and not hidden(n):
            points, up = 1.0 + commas(n) + min(size(n) // 100, 3), n[3]
            while up is not None and up[0] not in ("#root", "html"):
                score[id(up)] += points
                got.add(id(up))
                points, up = points / 2, up[3]
    final = {id(n): score[id(n)] * (1 - size(n, True) / max(1, size(n))) for n in everything if id(n) in got}
    best = max((n for n in everything if id(n) in got), key=lambda n: final[id(n)], default=None)
    return (0.0, "") if best is None else (final[id(best)], best[0])


def test_table_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: _brute(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["score"], r["container"]) for r in H.extract_pages(pages).collect()}
    assert set(got) == set(want) and len(got) > 200
    assert all(abs(got[i][0] - want[i][0]) < 1e-5 and got[i][1] == want[i][1] for i in want)


def test_points_reach_every_ancestor():
    deep = "<main>" + "<div>" * 9 + f"<p>{PROSE}</p>" + "</div>" * 9 + "</main>"
    nodes = H._measure(H.parse(deep))
    H.extract(deep)
    points = 1 + PROSE.count(",") + len(PROSE) // 100
    assert abs(_brute(deep)[0] - H.extract(deep)[1]) < 1e-9 and len(nodes) == 12 and H.extract(deep)[1] == max(points, 10 + points / 2**9)
    import time

    t = time.time()
    assert PROSE in H.extract("<div>" * 3000 + f"<p>{PROSE}</p>" * 3000)[0] and time.time() - t < 20


def test_cases(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", f"<p>{PROSE}</p>"), (2, "u", f"<p>{PROSE}</p>"), (3, "u", "<div>" + f"<p>{PROSE}</p>" * 5000 + "</div>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("h", "text", "score", "container")])
    got = H.extract_pages(d).collect()
    assert len(got) == 5 and max(len(r["text"]) for r in got) == 5000 * (len(PROSE) + 1) - 1 and sorted((r["page_id"] or 0, r["text"]) for r in got)[:2] == [(0, ""), (1, "")]
    assert H.extract_pages(spark.createDataFrame([], d.schema)).count() == 0


def test_pages_that_name_rules_or_forms_hid():
    for page in (f"<html class=nav><body class='has-sidebar'><p>{PROSE}</p></body></html>", f"<body class=nav-open><article class=related><p>{PROSE}</p></article></body>", f"<body><form id=aspnetForm><div><p>{PROSE}</p></div><select><option>no</select></form></body>", f"<body><div class=sidebar><p>{PROSE}</p></div></body>"):
        assert H.extract(page)[0] == PROSE, page[:60]
    small = f"<div><p>{PROSE}</p><p>{PROSE}</p></div><form><p>Subscribe to our letter, it is free</p></form>"
    assert "Subscribe" not in H.extract(f"<body>{small}</body>")[0]
