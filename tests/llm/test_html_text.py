"""Main text of pages against pages put together from known parts."""

import random

from vicinity.llm import html_text
from vicinity.llm.html_text import block_sums, extract, lines, main_text, surges, weights


def article(rng, n):
    return [" ".join("".join(rng.choice("abcdefé&<") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;")


def test_marked_articles_come_back_whole():
    rng = random.Random(1)
    for _ in range(50):
        blocks = article(rng, rng.randint(1, 12))
        body = "".join(f"<p>{escaped(b)}" + rng.choice(["</p>", "", "<br>"]) for b in blocks)
        page = f"<html><head><title>t</title><style>p{{}}</style><script>a<b</script></head><body><nav><ul><li><a href=x>one</a></ul></nav><div class='ad'>{'buy this ' * 30}</div><article>{body}</article><div class='comments'><p>{'I say ' * 40}</div><footer>&copy; me</footer>"
        assert main_text(page) == " ".join(blocks)


def test_unmarked_pages():
    long = "A paragraph that is long enough to rise above the surge, with words in it."
    page = f"<div id=menu><a>a</a> <a>b</a></div><div>Home</div><div><a href=x>News of today</a></div><div class=text><p>{long}<p>Short.<p>{long}</div><aside>{long}</aside><form>{long}<input></form>"
    assert main_text(page) == f"{long} Short. {long}"


def test_white_space_references_and_odd_markup():
    assert main_text("<article> a\n\t b&nbsp;c <b>d</b>e<!-- no > --> f &#233; &#x41;</article>") == "a b c de f é A"
    assert main_text("<article><p>one<p>two<script>var x='<p>';</script><p>three") == "one two three"
    assert main_text("<main>1 < 2 and <a title='x>y'>link</a></main>") == "1 < 2 and link"
    assert main_text("<article>cut short <p") == "cut short"


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, 'u', '<article>x</article>', 'own', 5)], 'page_id int, url string, html string, text string, n_chars int')
    assert [tuple(r) for r in extract(pages).collect()] == [(1, 'u', 'x', 1)]


def test_edge_cases(spark):
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert len(main_text("<article>" + "<p>word " * 50_000)) == 50_000 * 5 - 1
    pages = spark.createDataFrame([(1, "u", None, 3), (None, None, "<article>x</article>", 4), (1, "u", None, 3)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in extract(pages).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert extract(pages.where("false")).count() == 0


def test_surge_and_dive():
    """The sums decide: five lines without weight are a dive, fewer are bridged; a stretch without a surge is none."""
    import numpy as np

    assert block_sums(np.array([1.0, 2, 4, 8, 16, 32])).tolist() == [7, 15, 31, 62, 60, 56]
    assert surges(np.array([70.0, 0, 0, 0, 0, 20, 30, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 40, 40]), 60) == [(0, 7), (18, 20)]
    assert surges(np.array([5.0, 4, 0, 0, 0, 0, 0, 1])) == [(0, 2)]
    assert surges(np.zeros(0)) == [] and [row.text for row in lines("<p>a<td>b")] == ["a", "b"]


def around(inner, title="h1"):
    links = "".join(f"<li><a href=/{n}>{n * 5}</a></li>" for n in "abcdef")
    return f"<body><nav><ul>{links}</ul></nav><div class=ad>{'buy this ' * 9}</div>{inner}<footer>&copy; someone</footer><ul>{links}</ul></body>"


def test_marked_and_stripped_pages_with_noise_inside():
    """Short paragraphs stay, noise inside goes, with and without the article's mark; text F1 is 1 in all cases here."""
    rng = random.Random(5)
    for _ in range(60):
        blocks = [b for b in article(rng, rng.randint(2, 9)) if b.strip()] + ["One."] * rng.randint(0, 6) + ["x" * 70]
        noise = ["<div class=ad><p>Buy this now and pay later, it is the best of all that there is.</div>", "<ul class=related>" + "<li><a href=/x>read more of this</a></li>" * rng.randint(1, 9) + "</ul>", "<form>sign up <input></form>", ""]
        parts = [f"<p>{escaped(b)}</p>" for b in blocks]
        parts.insert(rng.randint(1, len(parts) - 1), rng.choice(noise))
        for page in (f"<article>{''.join(parts)}</article>", f"<main>{''.join(parts)}</main>", f"<div class=text>{''.join(parts)}</div>"):
            assert main_text(around(page)) == " ".join(blocks)


def test_an_unmarked_article_split_by_a_long_list_of_links():
    long, short = "A paragraph of the article, long enough to surge by itself. " * 50, "The opening section of the article is a good deal shorter than what follows."
    links = "<ul>" + "<li><a href=/x>another story to read</a></li>" * 12 + "</ul>"
    assert main_text(around(f"<div id=content><p>{short}</p>{links}<p>{long}</p></div><form>sign up</form><div><p>Some other words of the page.</p></div>")) == f"{short} {long.strip()}"


def test_lines_outside_a_marked_article_stay_out():
    inside = "Words of the article, of which there are quite a few in this line."
    page = f"<article><p>{inside}</article><div><p>A line about the site, no more.</div>"
    assert main_text(page) == inside and weights(lines(page)).tolist() == [len(inside), 0]
    assert main_text(f"<article><p>Fourteen chars</article><div><p>{'a line outside of the article ' * 3}</div>") == "Fourteen chars"


def test_no_line_of_a_marked_article_is_lost():
    """Beside lists of any length, at its beginning or end, and in sections whose names are phrases."""
    long = "A paragraph of the article, long enough to surge by itself, twice over."
    for n in (1, 7, 40):
        related = "<ul class=related>" + "<li><a href=/x>another story</a>" * n + "</ul>"
        assert main_text(around(f"<article><p>{long}<p>{long}{related}<p>The end.</article>")) == f"{long} {long} The end."
        assert main_text(around(f"<article><h1>Title</h1>{related}<p>{long}</article>")) == f"Title {long}"
    assert main_text(f"<article><p>{long}<div class=share-of-votes><p>Forty percent.</div><section id=comments-on-law><p>None.</section></article>") == f"{long} Forty percent. None."
    assert main_text(f"<article><p>{long}<div class='related-posts box'>no</div><div class=comments>no</div></article>") == long


def test_window_sums_decide_on_unmarked_pages(monkeypatch):
    """Short lines that surge together are text, a long line that stands alone is none; sums of single lines see it the other way round."""
    poem, alone = [f"Line {n} of a poem." for n in range(20)], "Printed by us in the year of the great rain, at the sign of the two herons by the river."
    links = lambda at: "".join(f"<p><a href=/{at}{n}>news of the day</a></p>" for n in range(7))
    page = f"<div><p>{alone}</p></div>{links('x')}<div class=text>{''.join(f'<p>{x}</p>' for x in poem)}</div>{links('y')}"
    assert main_text(page) == " ".join(poem)
    monkeypatch.setattr(html_text, "block_sums", lambda weight, window=5: weight)
    assert main_text(page) == alone


def test_deep_pages_take_time_in_proportion():
    import time

    start = time.perf_counter()
    for page in ("<b>" * 100_000 + "</i>" * 100_000 + "x", "<span><div>" + "<b>" * 60_000 + "</span>" * 60_000 + "x", "<div>" * 50_000 + "<p>x" * 1000):
        assert main_text(page).startswith("x")
    assert time.perf_counter() - start < 60
