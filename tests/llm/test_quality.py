from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import html_extract, quality_classifier, quality_rules

from .helpers import EDGES, corpus, empty, frame, with_null_id

CLEAN = "the of and to in a river runs is that it for was on stones with as be this by are at from morning light falls over fields where quiet people walk".split()


def prose(rng, n):
    out = []
    for k in range(n):
        w = rng.choice(CLEAN) if rng.random() < 0.45 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
        out.append((w.capitalize() if k % 11 == 0 else w) + ("." if k % 11 == 10 else ""))
    return " ".join(out)


def junk(rng, kind, n):
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(w for w in words if len(w) > 4)
    return " ".join(w for w in words[: n // 12] for _ in range(14))


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for k, w in enumerate(windows) if often[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = random.Random(1)
    texts = EDGES + corpus(1) + [prose(rng, 400), "a b c a b c a b c", "of of of of", "x\nx\n \ny\nx", "f f\ff", " ".join(f"w{k % 90}" for k in range(700))]
    rows = quality_rules.quality_rules(frame(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        n, chars, symbols, lines, repeats = plain_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), t
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    assert quality_rules.quality_rules(with_null_id(spark)).count() == 4


def test_divergence(spark):
    rng = random.Random(2)
    texts = [prose(rng, 150) for _ in range(40)] + [junk(rng, k % 4, 150) for k in range(40)]
    rows = quality_rules.quality_rules(frame(spark, texts)).orderBy("doc_id").collect()
    assert all(r.kept for r in rows[:40])
    assert not any(r.kept for r in rows[40:])
    kept = quality_rules.quality_rules(frame(spark, texts), keep=("text", "kept")).where("n_words > 10")
    assert kept.columns.count("text") == 1


def test_rules_stay_native(spark):
    plan = quality_rules.quality_rules(frame(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def labelled(spark, n=240):
    rng = random.Random(3)
    texts = [junk(rng, k % 4, rng.randint(40, 120)) if k % 5 == 0 else prose(rng, rng.randint(10, 200)) for k in range(n)]
    rows = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    model = quality_classifier.fit(rows, labels)
    found = quality_classifier.classify(rows, model).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_held_out_labels_are_not_read(spark):
    rows, labels = labelled(spark, 120)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality_classifier.classify(rows, quality_classifier.fit(rows, x)).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_classifier_edges(spark):
    rows, labels = labelled(spark, 60)
    model = quality_classifier.fit(rows, labels)
    found = quality_classifier.classify(frame(spark, EDGES), model).orderBy("doc_id").collect()
    assert len(found) == len(EDGES) and found[0].score == found[1].score == pytest.approx(model.prior)
    assert quality_classifier.classify(empty(spark), model).count() == 0
    assert not any(r.held_out for r in quality_classifier.classify(with_null_id(spark), model).where("doc_id IS NULL").collect())
    odd = spark.createDataFrame([(0, 1), (0, 0), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    for x in (odd, odd.where("false")):
        assert {r.score for r in quality_classifier.classify(rows, quality_classifier.fit(rows, x)).collect()} == {0.5}
    twice = rows.union(rows)
    assert quality_classifier.classify(twice, quality_classifier.fit(twice, labels.union(labels)), keep=("text",)).count() == 120


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home page link</a></li></ul></nav><!-- ad --><div class="ad">Buy ten of them now and save.</div>
<article><h1>Title &amp; more</h1><p><b>First   block,
of &lt;text&gt;.<br><p>Second&nbsp;block.</p><form><input>Your mail <button>Go</button></form><p>Third block ends here.</p>
<div class="comments"><p>A reader's comment that is long enough to matter here.</p></div></article>
<aside>Side bar words</aside><div id="cookie-notice">We use cookies on this site.</div><footer>&copy; host &middot; some words</footer></body></html>"""


def test_extraction():
    assert html_extract.extract(PAGE) == "Title & more\nFirst block, of <text>.\nSecond block.\nThird block ends here."
    assert html_extract.extract("") == "" and html_extract.extract("<nav>only a menu</nav>") == ""
    assert html_extract.extract("just words & more") == "just words & more"
    assert html_extract.extract("<script>alert(1)") == "" and html_extract.extract("<p>cut &am") == "cut &am"
    assert html_extract.extract("<main><div>" + "<p>one more line of text</p>" * 3 + "</div></main><nav>never closed") == "\n".join(["one more line of text"] * 3)


def test_labelled_pages_are_found():
    for page in html_extract.LABELLED:
        content = page[page.index("[[") + 2 : page.index("]]")]
        assert html_extract.extract(page.replace("[[", "").replace("]]", "")) == html_extract.extract(f"<main>{content}</main>")


def test_best_region_is_the_best():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(1, 12))]
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == max(0, max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)))


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>" + "word " * 50_000, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    found = html_extract.extract_pages(rows).collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found)
    assert html_extract.extract_pages(rows.where("false")).count() == 0


def test_content_is_kept_whatever_it_is_called():
    page = "<header><h1>Site</h1><p>A slogan of many words that goes on and on for quite a while</p></header><article><h1>Harbour news</h1><section><p>Boats came in today.</p></section><img src=x><h2 id='search'>Search methods</h2><div class='article-header'>By the harbour office</div><section id='related-work'><p>Older work.</p></section><p>See <math>x y</math></p><p class=ad>Buy now.</p><ul><li><a>One link</a></li></ul></article><footer>" + "word " * 40 + "</footer>"
    assert html_extract.extract(page) == "Harbour news\nBoats came in today.\nSearch methods\nBy the harbour office\nOlder work.\nSee x y\nOne link"
    halves = "<article><p>First half of it.</p><div class='ad'>" + "buy now " * 50 + "</div><p>Second half.</p><section class=comments><article><p>A reader says so.</p></article></section></article>"
    assert html_extract.extract(halves) == "First half of it.\nSecond half."
    plain = "<div id=cookie-notice>" + "We use cookies " * 10 + "</div><div><p>" + "real words here " * 20 + "</p><ul><li>One item.</li><li><a>Link item</a></li></ul><p>End.</p></div><div class='comments'><p>Nice post, I liked it.</p></div>"
    assert html_extract.extract(plain) == "\n".join(["real words here " * 19 + "real words here", "One item.", "Link item", "End."])


def test_the_scan_decides_where_nothing_is_named():
    """Menus and notes in bare elements around content in bare elements: only the scan tells them apart."""
    rng = random.Random(8)
    for _ in range(30):
        words = lambda n: " ".join(rng.choice(CLEAN) for _ in range(n))
        links = "<div><ul>" + "".join(f"<li><a>{words(1)}</a></li>" for _ in range(rng.randint(3, 9))) + "</ul></div>"
        blocks = [words(rng.randint(12, 60)) for _ in range(rng.randint(2, 6))]
        page = f"<html><body>{links}<div>{''.join(f'<p>{b}</p>' for b in blocks)}</div>{links}</body></html>"
        assert html_extract.extract(page) == "\n".join(blocks)


def test_region_against_all_regions():
    """Whole pages against the best of all contiguous regions, found by trying each."""
    rng = random.Random(9)
    parts = ["<p>some words here</p>", "<div><a>menu</a></div>", "<nav>one two</nav>", "<div class=ad>buy it</div>", "<h2>title</h2>", "<footer>end of page</footer>", "<article>", "</article>", "<b>bold</b> words ", "</div>"]
    for _ in range(60):
        items = html_extract.tokens("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))))
        scores, _ = html_extract.scored(items)
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == pytest.approx(max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]))


@pytest.mark.parametrize("part", ["<a ", "<nav><main>", "<script ", "<!--x", '<a "', '<div class="x', "<div><p>", "</div>", "<a '\"", "<div class=comments><article>"])
def test_malformed_pages_take_time_in_proportion(part):
    import time

    began = time.perf_counter()
    html_extract.extract(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


def test_votes_against_brute_force(spark):
    """Scores by cosines of whole weighted texts with every labelled vector, one by one."""
    rows, labels = labelled(spark, 150)
    model = quality_classifier.fit(rows, labels)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in quality_classifier.classify(rows, model).collect():
        counts = quality_classifier.features(texts[r.doc_id])
        x = quality_classifier.shares(counts[None])[0].astype(np.float64) * model.weights
        place = x @ model.axes
        votes = sorted(((max(0.0, float(place @ v) / np.linalg.norm(x)) ** 4, y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:15]
        asked = model.floor * min(1, len(texts[r.doc_id].split()) / 40)
        assert r.score == pytest.approx(sum(w * y for w, y in votes) / max(sum(w for w, _ in votes), asked), abs=1e-3)


def test_unknown_words_are_not_good(spark):
    rng = random.Random(4)
    rows, labels = labelled(spark)
    model = quality_classifier.fit(rows, labels)
    good = [prose(rng, 120) for _ in range(20)]
    odd = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") if "a" <= c <= "z" else c for c in t) for t in good]
    score = [r.score for r in quality_classifier.classify(frame(spark, good + odd), model).orderBy("doc_id").collect()]
    assert min(score[:20]) >= 0.5 and max(score[20:]) < 0.5


def test_terms_pack():
    counts = quality_classifier.features("some words, some words")
    assert (quality_classifier.unpacked(quality_classifier.packed(counts)) == counts).all()


def test_verdicts_of_empty_texts(spark):
    """No shares, no distances, no division by zero; a filter on the verdict doesn't bring one back."""
    rows = quality_rules.quality_rules(frame(spark, [None, "", "   ", "\n", "word"]))
    assert [(r.kept, r.class_distance, r.word_distance) for r in rows.collect()] == [(False, None, None)] * 5
    assert rows.where("kept").count() == 0
