import itertools
import random

from octavo.llm import pages

SCHEMA = "page_id long, url string, html string, text string"


def run(spark, rows):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)).collect()}


def test_article(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <article><h1>Head &amp; more</h1><p>One   two<br>three <b>bold</p><p>Caf&eacute; &lt;x&gt;<p>last<div class="share">Share</div>
    <section id="comments"><p>A comment</p></section><aside>Side</aside><form>Name <input></form></article>
    <div class="cookie-notice">Cookies</div><footer>Foot</footer></body></html>"""
    assert run(spark, [(1, "http://a.example/x", html)])[1] == "Head & more\nOne two three bold\nCafé <x>\nlast"


def page(lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_shared_lines_of_neighbours_go(spark):
    top, bottom = ["Welcome to the site", "All about things"], ["Write to us at any time", "Imprint of the site"]
    rows = [(i, f"http://h.example/en/{i}", page([*top, f"Text {i} " + "word " * 60, f"More of {i} " + "other " * 40, *bottom])) for i in range(6)]
    rows.append((99, "http://other.example/en/1", page([*top, "A page of another host"])))
    got = run(spark, rows)
    for i in range(6):
        assert got[i].split("\n")[0].startswith(f"Text {i}") and len(got[i].split("\n")) == 2
    assert got[99].startswith("Welcome")  # no neighbour on its host


def test_lines_of_the_host_inside_articles_go(spark):
    """A notice on every page goes, a passage that two of the articles have stays."""
    quote = "A passage that an article quotes from another one"
    body = lambda i: ["Read our great offers of the week", f"Text {i} " + "word " * 60, *[quote] * (i < 2), f"More of {i} " + "other " * 40]
    rows = [(i, f"http://h.example/en/{i}", page(body(i)).replace("body>", "main>")) for i in range(5)]
    got = run(spark, rows)
    for i in range(5):
        assert got[i].split("\n") == [" ".join(x.split()) for x in body(i)[1:]]


def test_copies_are_not_boilerplate(spark):
    body = [f"Sentence {i} of an article that was copied" for i in range(10)]
    got = run(spark, [(1, "http://h.example/a", page(body)), (2, "http://h.example/b", page(body))])
    assert got[1] == got[2] == "\n".join(body)


def test_copies_are_passed_over(spark):
    """Pages in a run of copies are differenced against the nearest page that is none, also if most of a page is the site's."""
    top = ["Welcome to the site, which has a long line at the top of each of its pages", "Menu of all the things that are here"]
    rows = [(i, f"http://h.example/{i}", page([*top, "Copied " + "story " * 30])) for i in range(1, 5)]
    rows += [(5, "http://h.example/5", page([*top, "Another"])), (6, "http://h.example/0", page([*top, "First " + "tale " * 20]))]
    got = run(spark, rows)
    assert all(got[i] == ("Copied " + "story " * 30).strip() for i in range(1, 5))
    assert got[5] == "Another" and got[6].startswith("First")


def test_near_copies_keep_their_articles(spark):
    """Two near copies among three pages of a host share most lines of their articles, and keep them."""
    story = [f"Sentence {i} of a story " + "that goes on " * i for i in range(8)]
    rows = [(1, "http://h.example/1", page(story).replace("body>", "article>")), (2, "http://h.example/2", page([*story[:2], "Edited", *story[3:]]).replace("body>", "article>")), (3, "http://h.example/3", page(["Something else"]).replace("body>", "article>"))]
    got = run(spark, rows)
    assert got[1] == "\n".join(x.strip() for x in story) and len(got[2].split("\n")) == 8 and got[3] == "Something else"


def test_slots_are_shared_whatever_they_say(spark):
    """Menus and adverts with other words on each page are found by differencing, one that only one page has by its markup."""
    made = lambda i, more="": f"<nav><ul><li>menu {i}<li>x{i}</ul></nav>{more}<article><p>Text {i}</p></article><div class='ad'>buy {i}</div>"
    rows = [(1, "http://h.example/1", made(1)), (2, "http://h.example/2", made(2, "<div class='newsletter'>Sign up</div>")), (3, "http://other.example/3", made(3))]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {i: f"Text {i}" for i in (1, 2, 3)}
    assert tuple(pages.report(df).first()) == (3, 6, 1, 0)


def test_lcs_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _is_subsequence(c, b))
        found = pages.lcs(a, b)
        assert len(found) == best and _is_subsequence([a[i] for i in found], b) and found == sorted(set(found))


def test_long_pages_are_aligned_in_halves(monkeypatch):
    rng = random.Random(5)
    for held in (1, 40):
        for _ in range(30):
            a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
            monkeypatch.setattr(pages, "HELD", 1 << 28)
            best = len(pages.lcs(a, b))
            monkeypatch.setattr(pages, "HELD", held)
            found = pages.lcs(a, b)
            assert len(found) == best and _is_subsequence([a[i] for i in found], b) and found == sorted(set(found))


def _is_subsequence(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_edges(spark):
    assert run(spark, []) == {}
    broken = "<article><p>Text &am"
    rows = [(None, None, None), (1, "not a url", ""), (2, "http://[bad", "plain text only"), (3, "http://h.example/x", "<p title='a > b' data-x=\"unclosed><p>x"), (4, None, broken), (5, "http://h.example/x", "<div>" * 3000 + "deep"), (5, "http://h.example/x", "<div>" * 3000 + "deep")]
    got = run(spark, rows)
    assert got[None] == "" and got[1] == "" and got[2] == "plain text only" and got[4] == "Text &am" and got[5] == "deep"


def test_whole_table(spark, sf):
    """The test pages keep their article between the tags."""
    import html as h
    import re

    table = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in pages.extract(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
    found = pages.report(table).first()  # what isn't the article is what differencing finds, but for a few pages
    assert found.pages == len(got) and found.slots >= 0.99 * (found.slots + found.alone) and found.slots >= 2 * found.pages
