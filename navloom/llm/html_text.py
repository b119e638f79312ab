"""Main text of HTML pages by a conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html
import random
import re

from pyspark.sql import DataFrame, functions as F

from navloom.llm.crf import Chain, best_paths, fitted
from navloom.llm.texts import as_texts, rows_pass

#: Element names by the way HTML treats them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noembed noframes iframe xmp template".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
            "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
            "noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr "
            "ul".split())
#: an open element of the key is closed by a start tag among its values
CLOSED_BY = {"p": BLOCK - {"button", "option", "optgroup", "noscript", "td", "th", "tr", "body", "html"},
             "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: where the search for an element to close stops
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "p": {"table", "button", "td", "th", "body"}, "option": {"select"}, "head": set()}

#: elements that say nothing about what they hold
PLAIN = {"html", "body", "p", "b", "i", "span", "em", "strong", "div", "a"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: elements that a start tag of the key closes, and those that end the search for one
CLOSES = {name: {k for k, by in CLOSED_BY.items() if name in by} for name in BLOCK}
STOPS = {name: set().union(*(WALLS[k] for k in CLOSES[name])) for name in BLOCK}


class Around:
    """The names of the open elements and of their classes, counted, so that a block reads them without a walk.

    `known` (None: all) bounds the names that are kept; the others only count as being there.
    """

    def __init__(self, known: tuple[set, set] | None):
        self.known, self.tags, self.names = known, {}, {}
        self.named, self.seen = 0, None

    def change(self, tag: str, parts: tuple, by: int) -> None:
        self.seen = None
        self.named += by * len(parts)
        for held, keys, kept in ((self.tags, (tag,), 0), (self.names, parts, 1)):
            for key in keys:
                if self.known is None or key in self.known[kept]:
                    held[key] = held.get(key, 0) + by
                    if not held[key]:
                        del held[key]

    def now(self) -> tuple[list[str], list[str], bool]:
        if self.seen is None:
            self.seen = sorted(self.tags), sorted(self.names), self.named > 0
        return self.seen


class Block:
    """A leaf block: its text, the part of it in links, its parent block, and the names of the elements around it."""

    __slots__ = ("parts", "linked", "parent", "around")

    def __init__(self, parent: str, around: tuple):
        self.parts, self.linked, self.parent, self.around = [], 0, parent, around

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def name_parts(attributes: str) -> list[str]:
    """Words in class, id and role names, and whether the element is hidden."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        name = m[1].lower()
        if name in ("class", "id", "role", "itemprop"):
            out += [p.lower().removesuffix("s") for p in NAME_PART.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.append("hidden")
    return out


def blocks(page: str, known: tuple[set, set] | None = None) -> list[Block]:
    """Leaf blocks in page order. Text between two block tags is one block; inline tags and comments don't part it.

    Open elements are found by the places of their names in the stack, so the time is linear in the page.
    """
    stack: list[tuple[str, tuple]] = []
    places: dict[str, list[int]] = {}
    parents: list[int] = []  # places of block elements
    around = Around(known)
    out: list[Block] = []
    here: Block | None = None
    at, links = 0, 0
    last = page.rfind(">") + 1  # no tag ends after it

    def text(raw: str) -> None:
        nonlocal here
        if here is None:
            if not raw.strip():
                return
            here = Block(stack[parents[-1]][0] if parents else "-", around.now())
            out.append(here)
        plain = html.unescape(raw) if "&" in raw else raw
        here.parts.append(plain)
        if links:
            here.linked += len(plain)

    def close(index: int) -> None:
        nonlocal links
        while len(stack) > index:
            name, parts = stack.pop()
            places[name].pop()
            if name in BLOCK:
                parents.pop()
            links -= name == "a"
            around.change(name, parts, -1)

    def highest(names: set) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    while m := TAG.search(page, at, last):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        name = name.lower()
        if name in BLOCK:
            here = None
        elif name == "br" and here is not None:
            here.parts.append(" ")
        if end:
            i = highest({name})
            if i >= 0 and (name in BLOCK and name != "p" or not parents or parents[-1] <= i):
                close(i)
            continue
        if name in BLOCK and (i := highest(CLOSES[name])) >= 0 and i >= highest(STOPS[name]):
            close(i)
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = page.find(">", closing.end()) + 1 if closing else 0
            at = at or len(page)
        elif name not in VOID:
            parts = tuple(name_parts(attributes)) if "=" in attributes or "hidden" in attributes else ()
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                parents.append(len(stack))
            stack.append((name, parts))
            links += name == "a"
            around.change(name, parts, 1)
    if at < len(page):
        text(page[at:].split("<!--")[0])
    return [b for b in out if b.text]


def features(page_blocks: list[Block]) -> list[list[str]]:
    """Ancestor-tag and text features of each block."""
    out = []
    for b in page_blocks:
        text = b.text
        tags, names, named = b.around
        f = ["bias", f"parent={b.parent}",
             f"links={min(4, 4 * b.linked // max(len(text), 1))}", f"long={len(text) > 200}",
             f"ends={text[-1] if text[-1] in '.!?:|' else 'a' if text[-1].isalnum() else '-'}"]
        f += [f"in={t}" for t in tags if t not in PLAIN]
        f += [f"name={p}" for p in names]
        f += [f"named={named}", f"alone={len(page_blocks) == 1}"]
        out.append(f)
    return out


def known_names(chain: Chain) -> tuple[set, set]:
    """Names of elements and of classes that the field has weights for."""
    return tuple({f.split("=", 1)[1] for f in chain.index if f.startswith(start)} for start in ("in=", "name="))


#: Layouts of the labelled pages. {m} is a paragraph of the main text, {t} its heading, {b} other text,
#: {s} a short other text; what stands in them is drawn.
LAYOUTS = (
    "<nav><ul><li><a>{s}</a></li><li><a>{s}</a></li><li><a>{s}</a></li></ul></nav><div class=ad>{b}</div>"
    "<article><h1>{t}</h1><p><b>{m}<br><p>{m}</p><p>{m}</p></article><footer>{b}</footer>",
    "<header><a>{s}</a><h2>{s}</h2></header><main><h1>{t}</h1><p>{m}</p><p>{m}</p><ul><li>{m}</li><li>{m}</li></ul>"
    "</main><aside><h3>{s}</h3><p>{b}</p></aside><footer><p>{b}</p></footer>",
    "<div id=header><div class=menu><a>{s}</a> <a>{s}</a></div></div><div id=content><h1>{t}</h1><div>{m}</div>"
    "<div>{m}</div><p>{m}</p></div><div class=sidebar><h4>{s}</h4><p>{b}</p><ul><li><a>{s}</a></li></ul></div>"
    "<div id=footer>{b}</div>",
    "<div class='cookie-notice'><p>{b}</p><button>{s}</button></div><article class=post><header><h1>{t}</h1></header>"
    "<p>{m}</p><blockquote>{m}</blockquote><p>{m}</p><section class=comments><h3>{s}</h3><div class=comment><p>{b}</p>"
    "</div><div class=comment><p>{b}</p></div></section></article>",
    "<article><h1>{t}</h1><p>{m}</p><aside class=advert>{b}</aside><p>{m}</p><h2>{t}</h2><p>{m}</p>"
    "<div class='share social'><a>{s}</a></div></article><section id=comments><p>{b}</p><p>{b}</p></section>",
    "<div class=banner role=banner>{b}</div><div role=navigation><a>{s}</a><a>{s}</a></div><div role=main><h1>{t}</h1>"
    "<p>{m}</p><pre>{m}</pre></div><div role=complementary><p>{b}</p></div><div role=contentinfo>{b}</div>",
    "<form class=search><label>{s}</label><p>{b}</p><select><option>{s}<option>{s}</select></form><article><p>{m}</p>"
    "<p>{m}</p><table><tr><td>{m}</td><td>{m}</td></tr></table></article><form><p>{b}</p><button>{s}</button></form>",
    "<div class=breadcrumb><a>{s}</a> <a>{s}</a></div><div class='entry-content'><h1 class=title>{t}</h1><p>{m}</p>"
    "<p>{m}</p><div class='related widget'><h3>{s}</h3><a>{s}</a><p>{b}</p></div></div><div class=pagination><a>{s}</a>"
    "</div><div class=newsletter>{b}</div>",
    "{m}", "<h1>{t}</h1>{m}", "<p>{m}</p><p>{m}</p><p>{m}</p>", "<h1>{t}</h1><p>{m}</p><p>{m}</p><hr><p>{m}</p>",
    "<body><div class='alert notice' role=alert>{b}</div><section class=story><h1>{t}</h1><p>{m}</p><p>{m}</p>"
    "<figure><figcaption>{m}</figcaption></figure></section><div class='promo sponsored'><p>{b}</p></div>"
    "<div class=copyright>{b}</div>",
    "<div class=page><div class=topbar>{s}</div><div class=text><p>{m}</p><p>{m}</p></div><div class=popup hidden>{b}"
    "</div><div class=modal><p>{b}</p></div><div class='subscribe box'><p>{b}</p></div></div>",
    "<main><article><h1>{t}</h1><div class=body><p>{m}</p><p>{m}</p></div><footer><p>{b}</p></footer></article>"
    "<div class=replies><p>{b}</p></div></main><nav class=toc><a>{s}</a></nav>",
    "<header class=site><p>{b}</p><nav><a>{s}</a></nav></header><article><h1>{t}</h1><p>{m}</p><div class=ads>{b}</div>"
    "<p>{m}</p></article><aside class=rail><p>{b}</p><p>{b}</p></aside><div class=discussion><p>{b}</p></div>",
    "<noscript>{b}</noscript><div class=consent><p>{b}</p></div><div class=gdpr>{b}</div><div class=wrapper>"
    "<div class=article><h1>{t}</h1><p>{m}</p><p>{m}</p></div><div class=disclaimer>{b}</div></div>",
    "<div id=nav><ul><li><a>{s}</a><li><a>{s}</a></ul></div><div id=main><p>{m}</p><dl><dt>{m}<dd>{m}</dl><p>{m}</p></div>"
    "<div id=ad><p>{b}</p></div><div class=feedback><p>{b}</p></div>",
)
#: Elements and names that hold the main text, and those that hold something else.
MAIN_HOLDERS = ("article", "main", "div class=content", "div id=content", "div class=article", "div class=post",
                "div class=entry", "section class=story", "div class='main text'", "div id=main", "div class=body",
                "section", "div", "div class=page", "div role=main")
OTHER_HOLDERS = (
    "nav", "header", "footer", "aside", "form", "div class=ad", "div class=advert", "div class=advertisement",
    "div class=sponsored", "div class=promo", "div class=banner", "div class=sidebar", "div id=sidebar",
    "div class=menu", "ul class=navigation", "div class=header", "div class=footer", "div class=cookie",
    "div class=consent", "div class=notice", "section class=notice", "p class=notice", "div class=alert",
    "div role=alert", "div class=popup", "div class=modal", "div hidden", "div class=newsletter", "div class=signup",
    "div class=subscribe", "div class=share", "div class=social", "div class=related", "div class=recommended",
    "div class=widget", "div class=breadcrumb", "div class=pagination", "div class=login", "div class=search",
    "p class=copyright", "div class=disclaimer")
COMMENT_HOLDERS = ("div class=comments", "section id=comments", "div class=comment", "section class=comments",
                   "ol class=comment-list", "div class=discussion", "div class=replies", "div class=responses",
                   "div id=disqus", "article class=comment", "div class=user-comment")
LABELS = ["other", "main"]
MARK = {"m": "\x01", "t": "\x01", "b": "\x02", "s": "\x02"}


def labelled(times: int = 4, seed: int = 4) -> list[tuple[list[list[str]], list[str]]]:
    """The labelled pages: each layout `times` times and 100 times as many composed ones, as features and labels per block."""
    draw = random.Random(seed)

    def sentence(words: int) -> str:
        made = ["".join(draw.choice("abcdeghilnorstu") for _ in range(draw.randint(2, 9))) for _ in range(words)]
        return " ".join(made).capitalize() + draw.choice((".", ".", ".", "", "!", "?", ":"))

    def filled(m: re.Match) -> str:
        low, high = {"m": (1, 60), "t": (2, 12), "b": (1, 40), "s": (1, 4)}[m[1]]
        if m[1] == "m" and draw.random() < 0.25:
            high = 3
        return MARK[m[1]] + sentence(draw.randint(low, high))

    def held(holder: str, inner: str) -> str:
        return f"<{holder}>{inner}</{holder.split()[0]}>"

    def composed() -> str:
        """Main text in a drawn holder, other holders before, within and after it."""
        others = lambda n: [held(draw.choice(OTHER_HOLDERS), draw.choice(
            ("{b}", "<p>{b}</p>", "<p>{b}</p><p>{b}</p>", "<h3>{s}</h3><p>{b}</p>", "<a>{s}</a> <a>{s}</a>",
             "<ul><li><a>{s}</a></li><li>{b}</li></ul>", "<div>{b}</div>"))) for _ in range(draw.randint(0, n))]
        comments = held(draw.choice(COMMENT_HOLDERS), draw.choice(
            ("<p>{b}</p>", "<h3>{s}</h3><p>{b}</p><p>{b}</p>", "<ul><li>{b}</li><li>{b}</li></ul>", "{b}",
             "<div class=comment><p>{b}</p></div><div class=comment><p>{b}</p></div>")))
        inner = [draw.choice(("<h1>{t}</h1>", "<header><h1>{t}</h1></header>", "<h2>{t}</h2>", ""))]
        inner += [draw.choice(("<p>{m}</p>", "<p>{m}", "<div>{m}</div>", "<p><b>{m}<br>{m}</b></p>", "<ul><li>{m}</ul>",
                               "<h2>{t}</h2><p>{m}</p>", "<blockquote>{m}</blockquote>")) for _ in range(3)]
        for extra in [*others(1), *([comments] if draw.random() < 0.3 else [])]:
            inner.insert(draw.randint(1, len(inner)), extra)
        after = others(2)
        if draw.random() < 0.4:
            after.insert(0, held(draw.choice(COMMENT_HOLDERS), "<p>{b}</p><p>{b}</p>"))
        return "".join([*others(3), held(draw.choice(MAIN_HOLDERS), "".join(inner)), *after])

    rows = []
    for layout in [*LAYOUTS * times, *(composed() for _ in range(100 * times))]:
        page = re.sub(r"\{(\w)\}", filled, layout)
        found = blocks(page if draw.random() < 0.2 else f"<html><body>{page}</body></html>")
        labels = ["main" if "\x01" in "".join(b.parts) else "other" for b in found]
        for b in found:
            b.parts = ["".join(b.parts).replace("\x01", "").replace("\x02", "")]
        rows.append((features(found), labels))
    return rows


def main_texts(pages: DataFrame, html_column: str = "html", key: str = "page_id",
               url: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    The text is that of the leaf blocks which the field labels as main, in page order and joined by one space, with
    character references decoded and white space as single spaces. Scripts, styles, titles, form fields and markup
    are no blocks. Null and empty pages have the text ''; a page without tags is one block; unclosed and crossed tags
    are closed as browsers do; repeated rows repeat; an empty table gives no rows.
    """
    chain = pages.sparkSession.sparkContext.broadcast(fitted(labelled(), LABELS))

    def per_batch(batch):
        known = known_names(chain.value)
        ids, urls, texts = batch["k"].to_pylist(), batch["u"].to_pylist(), as_texts(batch["t"])
        for i in range(0, len(ids), 200):
            found = [blocks(t, known) for t in texts[i:i + 200]]
            paths = best_paths([chain.value.emissions(features(b)) for b in found], chain.value.move)
            for k, u, b, path in zip(ids[i:i + 200], urls[i:i + 200], found, paths):
                text = " ".join(x.text for x, y in zip(b, path) if y == 1)
                yield k, u, text, len(text)

    return rows_pass(pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html_column).alias("t")),
                     per_batch, "page_id bigint, url string, text string, n_chars bigint")
