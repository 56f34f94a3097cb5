"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. A tag scores below zero, by a
weight learned from labelled pages: the log ratio of its counts inside and
outside of marked content. A word scores WORD, and less by the learned weights
of what the elements around it are (their names, the words of their class and
role, of their id outside of an article) and of being a link. One linear scan
finds the contiguous region of highest score. Its blocks, in page order, are
the text, without the words inside of it whose elements score them below zero
(an advert between two paragraphs, readers' comments in the article).

An article or main element starts anew: what is open around it says nothing
about its words, and tags inside of it cost next to nothing.

Defined cases: a null or empty page, or one without content, has an empty
text; unclosed and unknown tags are allowed; a tag ends at the next "<" if it
isn't closed before; whatever the page holds, time grows with its length;
equal rows give equal results; other columns aren't read; an empty table gives
an empty one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Score of a word, highest weight of a tag, and weight of a tag that no labelled page has.
WORD, NEUTRAL, UNKNOWN = 1.0, -0.02, -0.5
#: Factors of the learned log ratios: of tags that content has too, and of those met only outside, which end a region.
SCALE, OUTSIDE = 3.5, 6.0
#: Factor and bounds of the weights of what surrounds a word; least score of a run of words (mild, so that the scan spans what is left out inside of content).
AROUND, LOWEST, HIGHEST, LEAST = 0.75, -2.0, 1.0, -0.5
#: Elements whose text a page doesn't show as such, those without an end, those around which nothing counts, and headings.
RAW = frozenset("script style noscript template iframe title textarea svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLDERS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose name counts for the words in them (a header's also by where it is).
SECTIONS = frozenset("nav header footer aside form menu dialog button select fieldset address figure section table blockquote pre".split())
BLOCKS = frozenset("address article blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name: quoted strings and other characters, up to the next bracket.
REST = re.compile(r"""(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+'|["'])*+""")
CALLED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

#: Labelled pages, content between the marks [[ and ]]. First layouts in common use, written out.
LAYOUTS = (
    "<html><head><title>t</title></head><body><div id='top'><a>Home</a> <a>News</a></div><article>[[<h1>Tide tables</h1><p>The harbour office has <b>printed</b> the new tables.<br>They are sold at the quay.</p><p>Boats leave on the <a>first tide</a> after dawn.</p><p>Fog may delay them.</p>]]</article><div>All rights reserved <a>Terms</a> <a>Privacy</a></div></body></html>",
    "<html><body><table><tr><td><a>Index</a></td><td><a>Map</a></td></tr></table><main>[[<h2>Bread</h2><p>Mix flour, water and salt.</p><ul><li>Let it rest for an hour.</li><li>Fold it twice.</li></ul><blockquote>Patience makes the crust.</blockquote><p>Bake it until it sounds hollow.</p>]]</main><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></body></html>",
    "<html><body><div><ul><li><a>Start</a></li><li><a>About us</a></li></ul></div><div><span>Monday</span></div><section>[[<h1>A walk</h1><h3>Morning</h3><p>We set out early and <em>followed</em> the river.</p><p>At noon we <i>rested</i> under <strong>old</strong> trees.</p><h3>Evening</h3><p>The path led back to the village.</p>]]</section><div><img><a>Back</a></div></body></html>",
    "<html><body><center><a>Register</a> | <a>Help</a></center><article>[[<h1>Report</h1><p>Output rose in spring.</p><pre>north 12 south 9</pre><table><tr><td>year</td><td>tons</td></tr><tr><td>1990</td><td>14</td></tr></table><p>It fell again in autumn.</p>]]</article><section><a>Next</a> <a>Previous</a></section></body></html>",
    "<html><body><div><a>Login</a></div><main>[[<div><h1>Notes</h1></div><div>Rain came in the <a>second</a> week.</div><div><div>The <span>lower</span> field stood under water.</div></div><ol><li>Drain it.</li><li>Sow again.</li></ol><div>Nothing else was lost.</div>]]</main><div><a>Up</a></div></body></html>",
)
#: Then pages made by rule: an element of each name, and one of each class, before or after content in layouts with and without an article.
CHROME_NAMES = "nav header footer aside form menu dialog button select".split()
CHROME_WORDS = "ad ads adv advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended sidebar menu navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus login search widget toolbar pagination pager complementary contentinfo copyright".split()
CONTENT_WORDS = "article content entry post story text body main".split()


def made() -> Iterator[str]:
    text = "<div><p>The ferry crosses the bay twice a day in summer and once in winter.</p></div><p>Tickets are sold <a>on board</a>.</p>"
    # The second comes in articles only.
    within = "<img><p>The pier.</p><img>", "<header><h1>Ferry times</h1></header>", "<figure><p>The pier.</p></figure>", "<section><h2>Winter</h2><p>One crossing.</p></section>", "<table><tr><td>9</td><td>17</td></tr></table>", "<blockquote>Bring a coat.</blockquote>", "<ul><li>Bicycles are free.</li></ul>", "<address><p>Pier two.</p></address>"
    few = "<a>Some words</a> <a>of another kind</a> <a>stand here.</a>"
    for k, name in enumerate((*CHROME_NAMES, *CHROME_WORDS)):
        chrome = f"<{name}>{few}</{name}>" if k < len(CHROME_NAMES) else f"<div class='{name}'>{few}</div>"
        inner = text + within[k % len(within)]
        content = f"<article>[[{inner}]]</article>" if k % 2 else f"<div class='{CONTENT_WORDS[k % len(CONTENT_WORDS)]}'>[[{inner}]]</div>"
        yield f"<html><body>{chrome}{content}</body></html>"
        yield f"<html><body>{content}{chrome}</body></html>"


LABELLED = (*LAYOUTS, *made())


class Token(NamedTuple):
    """A tag (its name with / in front if it closes, and what follows the name), or a run of text with an empty name."""

    name: str
    text: str


def tokens(page: str) -> list[Token]:
    out, at, text = [], 0, 0

    def add(name: str, rest: str, begin: int, end: int) -> None:
        nonlocal at, text
        if begin > text:
            out.append(Token("", page[text:begin]))
        if name:
            out.append(Token(name, rest))
        at = text = end

    while (begin := page.find("<", at)) >= 0:
        m = NAME.match(page, begin)
        if m:
            end = REST.match(page, m.end()).end()
            name = m[1].lower()
            add("/" * (page[begin + 1] == "/") + name, page[m.end() : end], begin, end + (page[end : end + 1] == ">"))
            if name in RAW and page[begin + 1] != "/":
                close = re.compile(f"</{name}", re.I).search(page, at)
                at = text = close.start() if close else len(page)
        elif page.startswith("<!--", begin):
            end = page.find("-->", begin)
            add("", "", begin, end + 3 if end >= 0 else len(page))
        elif page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            add("", "", begin, end + 1 if end >= 0 else len(page))
        else:
            at = begin + 1
    if text < len(page):
        out.append(Token("", page[text:]))
    return out


class Around:
    """What the elements that are open say about the words in them."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter = Counter()
        self.features: Counter = Counter()
        self.held: list[Counter] = []

    @property
    def inside(self) -> bool:
        return bool(self.held)

    def named(self, token: Token) -> tuple[str, ...]:
        out = [f"<{token.name}>" + "in" * (self.inside and token.name == "header")] if token.name in SECTIONS else []
        if token.text and token.name not in ("html", "body"):
            for kind, *values in CALLED.findall(token.text):
                if kind.lower() != "id" or not (self.inside or token.name in HEADINGS):
                    out += PART.findall("".join(values).lower())
        return tuple(dict.fromkeys(out))

    def enter(self, token: Token) -> None:
        if token.name in VOID or token.text.endswith("/"):
            return
        own = self.named(token)
        if token.name in HOLDERS and not (token.name == "article" and any(self.features[w] for w in CONVERSATION)):
            self.held.append(self.features)
            self.features = Counter()
            self.stack.append((token.name, ()))
        else:
            self.stack.append((token.name, own))
        self.features.update(own)
        self.open[token.name] += 1

    def leave(self, name: str) -> None:
        if not self.open[name]:
            return
        while True:
            own, features = self.stack.pop()
            self.open[own] -= 1
            if own in HOLDERS and not features and self.held:
                self.features = self.held.pop()
            for f in features:
                self.features[f] -= 1
            if own == name:
                return


#: Words of a class that mark a conversation; an article in one is a reader's.
CONVERSATION = "comment comments reply replies respond disqus".split()


class Weights(NamedTuple):
    """Of tags, and of what surrounds a word."""

    tags: dict[str, float]
    around: dict[str, float]


def learn(pages: tuple[str, ...]) -> Weights:
    """Weights from pages with marked content."""
    tags, words = (Counter(), Counter()), (Counter(), Counter())
    for page in pages:
        before, rest = page.split("[[")
        content, after = rest.split("]]")
        around = Around()
        for side, part in ((0, before), (1, content), (0, after)):
            for token in tokens(part):
                if not token.name:
                    features = [f for f, n in around.features.items() if n > 0] + ["<a>"] * (around.open["a"] > 0)
                    words[side].update({f: len(token.text.split()) for f in features})
                    continue
                if token.name.lstrip("/") != "a":  # its words carry what links say
                    tags[side][token.name] += 1
                if token.name[0] == "/":
                    around.leave(token.name[1:])
                else:
                    around.enter(token)
    ratio = lambda c, n: math.log((c[1][n] + 0.5) / (c[0][n] + 0.5))
    tag = {n: min(NEUTRAL, (SCALE if tags[1][n] else OUTSIDE) * ratio(tags, n)) for n in tags[0].keys() | tags[1].keys()}
    tag |= {"a": NEUTRAL, "/a": NEUTRAL}
    return Weights(tag, {n: min(HIGHEST, max(LOWEST, AROUND * ratio(words, n))) for n in words[0].keys() | words[1].keys()})


WEIGHTS = learn(LABELLED)


def scored(items: list[Token], weights: Weights = WEIGHTS) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether it is text whose elements score its words below zero."""
    scores, out, around = [], [], Around()
    for token in items:
        if not token.name:
            n = len(token.text.split())
            own = WORD + sum(weights.around.get(f, 0.0) for f, n_open in around.features.items() if n_open > 0)
            link = weights.around.get("<a>", 0.0) if around.open["a"] > 0 and not around.inside else 0.0
            scores.append(max(LEAST, n * min(WORD, own + link)))
            out.append(own < 0)
            continue
        name = token.name.lstrip("/")
        if token.name[0] == "/":
            around.leave(name)
        calm = around.inside
        if token.name[0] != "/":
            around.enter(token)
        scores.append(NEUTRAL if calm else weights.tags.get(token.name, UNKNOWN))
        out.append(False)
    return scores, out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of highest score, the earliest if several have it."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, region = total, (start, k + 1)
    return region


def extract(page: str, weights: Weights = WEIGHTS) -> str:
    if not page:
        return ""
    items = tokens(page)
    scores, left_out = scored(items, weights)
    first, last = best_region(scores)
    blocks, open_block = [], []
    for token, left in zip(items[first:last], left_out[first:last]):
        if not token.name:
            if not left:
                open_block.append(token.text)
        elif token.name.lstrip("/") in BLOCKS and open_block:
            blocks.append("".join(open_block))
            open_block = []
    blocks.append("".join(open_block))
    return "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, for each row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
