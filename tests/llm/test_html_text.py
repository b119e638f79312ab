from __future__ import annotations

import html
import re
import time

import pytest

from navloom.llm import crf, html_text


@pytest.fixture(scope="module")
def chain():
    return crf.fitted(html_text.labelled(), html_text.LABELS)


def main_of(chain, page):
    found = html_text.blocks(page)
    path = crf.best_paths([chain.emissions(html_text.features(found))], chain.move)[0]
    return " ".join(b.text for b, y in zip(found, path) if y == 1)


PAGES = {
    "<nav><a>Home</a></nav><article><h1>T</h1><p>A &amp; B<br>c<p>D</article><footer>&copy; x</footer>": "T A & B c D",
    "<div class='wrap'><div class=site-header>My site</div><div class=main-content><h1>Title</h1><p>First.<p>Second "
    "<a href=x>link</a>.</div><div class=comments-area><p>Nice post!</p></div></div>": "Title First. Second link.",
    "<body><aside>Side</aside><article><h1>T</h1><p>Para</p><div class=comments><p>I like it.</p></div></article>":
        "T Para",
    "<article><p>A<script>var a='</p>';</script>B</p></article><form>Sign up <input></form>": "AB",
    "<article><p>a  <b>b</b>c\n\u00a0d<!-- no --></p></article>": "a bc d",
    "<div class=cookie-notice>We use cookies.</div><main><p>One.</p><div class=ad>Buy!</div><p>Two.</p></main>":
        "One. Two.",
    "Just text": "Just text", "": "", "<p>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(chain, page):
    assert main_of(chain, page) == PAGES[page]


def test_fresh_layouts(chain):
    wrong = total = 0
    fresh = html_text.labelled(times=1, seed=123)
    for (seq, labels), path in zip(fresh, crf.best_paths([chain.emissions(s) for s, _ in fresh], chain.move)):
        wrong += sum(html_text.LABELS[y] != label for y, label in zip(path, labels))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_given_pages_match_their_articles(session, sf_dir):
    """The pages have one article each; its text is cut out by hand here."""
    pages = session.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html_text.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div|li|ul)\b[^>]*>", " ", inner))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_awkward_pages(session):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p" * 1000), (4, "u", "<div>" * 3000 + "deep"), (4, "u", "<p>x"),
            (5, "u", "<a href='x>y</a> <p>t"), (6, "u", "<script>never closed <p>x"), (7, "u", "&lt;b&gt; &#233;&nbsp;")]
    df = session.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, k int, t string")
    got = html_text.main_texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got if r.page_id != 4}
    assert by[1] == by[2] == by[6] == "" and by[7] == "<b> é"
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>x", "<p", "<span>x", "<ul><li>x", "<a href=x>x", "<!--", "<b>x</p>", "< ", '<a "',
                                  "<table><tr><td>x", "<div class=c%d>x", "<script>x</script ", "<p>x", "</div>x"])
def test_many_or_open_tags_take_seconds(chain, page):
    whole = "".join(page.replace("%d", str(i)) for i in range(100_000))
    known = html_text.known_names(chain)
    start = time.process_time()
    found = html_text.blocks(whole, known)
    crf.best_paths([chain.emissions(html_text.features(found))], chain.move)
    assert time.process_time() - start < 30


def test_elements_that_close_each_other():
    def got(page):
        return [(b.text, b.parent, b.around[0]) for b in html_text.blocks(page)]

    assert got("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == [
        ("a", "li", ["li", "ul"]), ("b", "li", ["li", "ul"]), ("c", "li", ["li", "ul"]), ("d", "li", ["li", "ul"])]
    assert got("<p>a<div>b</p>c</div>d") == [
        ("a", "p", ["p"]), ("b", "div", ["div"]), ("c", "div", ["div"]), ("d", "-", [])]
    assert got("<table><tr><td>a<table><tr><td>b</table>c<td>d") == [
        (x, "td", ["table", "td", "tr"]) for x in "abcd"]
    assert got("<div><span>a</div>b") == [("a", "div", ["div", "span"]), ("b", "-", [])]
    assert got("a<!-- <p>b") == [("a", "-", [])] and got("a<!-- b") == [("a", "-", [])]


def test_names_the_field_does_not_know_only_count(chain):
    known = html_text.known_names(chain)
    page = "<div class='zzz content'><p class=qqq>a</p></div>"
    all_names, few = (html_text.features(html_text.blocks(page, k))[0] for k in (None, known))
    assert "name=zzz" in all_names and "name=zzz" not in few and {"name=content", "named=True"} <= set(few)
    assert (chain.emissions([all_names]) == chain.emissions([few])).all()
