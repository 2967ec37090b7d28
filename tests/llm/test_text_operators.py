"""Decontamination, language ID, HTML extraction, mixing, token counts and the archive."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.llm import decontaminate as dec
from spreadwatch.llm import language_id as lid
from spreadwatch.llm import mixing, token_counts, warc
from spreadwatch.llm.html_extract import extract, extract_pages, smoothed, threshold

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"

# benchmark decontamination


def brute_distance(pattern, text):
    """(least edit distance of the pattern to a substring, end of the first such): Sellers' recurrence."""
    column = list(range(len(pattern) + 1))
    best, end = column[-1], 0
    for j, char in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p != char)))
        column = new
        if column[-1] < best:
            best, end = column[-1], j
    return best, end


def test_myers_against_the_recurrence():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choices("abé ", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abé ", k=rng.randint(0, 120)))
        assert dec.myers(dec.masks(pattern), len(pattern), text) == brute_distance(pattern, text)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        chars[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("xyz")]
    return "".join(chars)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 20)))) for i in range(12)] + [(50, None), (51, " \n"), (52, "ab"), (None, "skipped item")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 60))]
        item = rng.choice(items[:12])[1]
        text.insert(rng.randint(0, len(text)), edited(rng, item.upper() if i % 5 == 0 else item, rng.randint(0, int(len(item) * 0.1) + 1)))
        docs.append((i, rng.choice([" ", "\n\t"]).join(text)))
    docs += [(100, None), (101, ""), (102, "x " * 100_000)]
    want = set()
    for doc_id, text in docs[:60]:
        for item_id, item in items:
            if item_id is not None and item and (norm := dec.normalised(item)):
                edits, _ = brute_distance(norm, dec.normalised(text))
                if edits <= int(dec.ERROR_RATE * len(norm)):
                    want.add((doc_id, item_id, edits))
    docs_df = spark.createDataFrame(docs, DOC).withColumn("item_id", F.lit("clash")).repartition(3)
    got = {(r.doc_id, r.item_id, r.n_edits) for r in dec.find_items(docs_df, spark.createDataFrame(items, ITEM)).collect()}
    assert {x for x in got if x[0] < 100} == want
    left = {r.doc_id for r in dec.decontaminate(docs_df, spark.createDataFrame(items, ITEM)).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in got}


def test_decontamination_of_empty_tables_and_in_blocks(spark, monkeypatch):
    docs, items = spark.createDataFrame([(1, "alpha beta gamma"), (None, "delta epsilon zeta")], DOC), spark.createDataFrame([(1, "beta gamma"), (2, "delta epsilon")], ITEM)
    assert dec.find_items(docs, items.limit(0)).count() == 0 and dec.find_items(docs.limit(0), items).count() == 0
    monkeypatch.setattr(dec, "BLOCK_CHARS", 1)
    assert {(r.doc_id, r.item_id) for r in dec.find_items(docs, items).collect()} == {(1, 1), (None, 2)}
    assert dec.decontaminate(docs, items).count() == 1


# language ID


def brute_forward(word, pieces, probabilities):
    ways = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        ways[end] = sum(ways[end - len(p)] * q for p, q in zip(pieces, probabilities, strict=True) if p and end >= len(p) and word[end - len(p) : end] == p)
    return ways[-1]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(4)
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"aab", b"cab"]
    probabilities = rng.random((len(pieces), 3)) / 10
    words = [b"a", b"abc", b"aabcab", b"cabcabcab", b"bbbbca", b"abcabcabcabcabc"]
    got = lid.Forward(pieces, probabilities).log_probabilities(words)
    for i, word in enumerate(words):
        for k in range(3):
            assert got[i, k] == pytest.approx(np.log(brute_forward(word, pieces, probabilities[:, k])), rel=1e-9)


def brute_segmentations(word, pieces):
    """Every way to cut a word into pieces, as lists of piece numbers."""
    if not word:
        return [[]]
    return [[i, *rest] for i, p in enumerate(pieces) if p and word.startswith(p) for rest in brute_segmentations(word[len(p) :], pieces)]


def test_forward_takes_long_words_and_long_pieces_whole():
    """Words of 60 bytes and more, pieces of 20: against the recurrence."""
    rng = np.random.default_rng(5)
    pieces = [b"a", b"b", b"ab", b"ba" * 10, b"abba" * 5, b"c", "é".encode(), b"\xc3", b"\xa9"]
    probabilities = rng.random((len(pieces), 2)) / 10
    words = [b"ab" * 30, b"abba" * 16, b"ba" * 45, b"abc" * 40, "éa".encode() * 30, b"ba" * 10 + b"c" * 50 + b"abba" * 5]
    forward = lid.Forward(pieces, probabilities)
    for i, word in enumerate(words):
        assert b"".join(forward.stretches(word)) == word
        parts = sum(forward.log_probabilities(forward.stretches(word)))
        for k in range(2):
            want = np.log(brute_forward(word, pieces, probabilities[:, k]))
            assert forward.log_probabilities(words)[i, k] == pytest.approx(want, rel=1e-9) and parts[k] == pytest.approx(want, rel=1e-9)
    assert len(forward.stretches(b"abc" * 40)) == 80  # no piece crosses a c


def test_expected_counts_over_all_segmentations(monkeypatch):
    rng = np.random.default_rng(6)
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"aab", b"cab"]
    probabilities = rng.random((len(pieces), 2)) / 10
    words, times = [b"abc", b"aabcab", b"cabcabcab", b"bca"], np.array([1.0, 2.0, 5.0, 3.0])
    want = np.zeros_like(probabilities)
    for word, n in zip(words, times, strict=True):
        for k in range(2):
            ways = [(cut, np.prod(probabilities[cut, k])) for cut in brute_segmentations(word, pieces)]
            total = sum(p for _, p in ways)
            for cut, p in ways:
                for i in cut:
                    want[i, k] += n * p / total
    for long in (64, 2):  # by scaled sums, and by logarithms
        monkeypatch.setattr(lid, "LONG", long)
        assert lid.Forward(pieces, probabilities).expected_counts(words, times) == pytest.approx(want, rel=1e-9)


def test_language_query_against_brute_force(spark):
    """Every row of the query, from the model by the plain recurrence over each word."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(TEXTS[lang].split(), k=rng.randint(1, 6))), lang) for i in range(40) for lang in [rng.choice(list(TEXTS))]]
    rows += [(90, None, "en"), (91, "1 2", "de"), (92, "Haus" * 30, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, probabilities = lid.learn(docs)
    pieces = lid.read_vocabulary()
    number = {p: i for i, p in enumerate(pieces)}

    def word_log(word, k):
        ways = [0.0] * (len(word) + 1)
        ways[0] = 1.0
        for end in range(1, len(word) + 1):
            ways[end] = sum(ways[a] * probabilities[number[word[a:end]], k] * 300.0 ** (end - a) for a in range(max(0, end - 33), end) if word[a:end] in number)
        return np.log(ways[-1]) - len(word) * np.log(300.0)

    for r in lid.identify(docs, langs, probabilities).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found = [b" " + w.encode() for w in text.lower().split()]
        total = [sum(word_log(w, k) for w in found) for k in range(len(langs))]
        assert r.lang_pred == langs[int(np.argmax(total))]
        assert r.score == pytest.approx(1 / sum(np.exp((t - max(total)) / len(found)) for t in total), rel=1e-6)


TEXTS = {"en": "the house and the garden of the man who was there", "de": "das haus und der garten des mannes der dort war", "es": "la casa y el jardín del hombre que estaba allí"}


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lang = rng.choice(list(TEXTS))
        rows.append((i, " ".join(rng.choices(TEXTS[lang].split(), k=rng.randint(3, 30))), lang))
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34 !", "en"), (902, "", "de"), (None, "the house", None)], "doc_id long, text string, lang string")
    langs, probabilities = lid.learn(docs.where(~lid.is_held_out(F.col("doc_id"))))
    assert langs == ["de", "en", "es"] and probabilities.sum(axis=0) == pytest.approx([1, 1, 1])
    found = {r.doc_id: r for r in lid.identify(docs.withColumn("score", F.lit("clash")), langs, probabilities).collect()}
    assert len(found) == 304 and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    held = docs.where(lid.is_held_out(F.col("doc_id"))).where("doc_id < 300").collect()
    assert held and np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_language_id_of_long_words_parts_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the house " * 5, "en"), (2, "das haus " * 5, "de")], "doc_id long, text string, lang string")
    langs, probabilities = lid.learn(docs)
    scorer = lid.Scorer(langs, lid.read_vocabulary(), probabilities)
    texts = ["the house " * 4000, "x" * 100_000, "das haus"]
    whole = scorer.score(texts)
    assert [w[0] for w in (whole[0], whole[2])] == ["en", "de"]
    monkeypatch.setattr(lid, "GROUP_WORDS", 50)
    assert [w[0] for w in scorer.score(texts)] == [w[0] for w in whole]
    assert [w[1] for w in scorer.score(texts)] == pytest.approx([w[1] for w in whole])
    none = docs.where("doc_id < 0")
    assert lid.learn(none)[0] == [] and lid.identify(docs, *lid.learn(none)).where("lang_pred = 'und'").count() == 2


# HTML extraction


def test_extract_leaves_only_the_article():
    html = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
    <article><header><h1>The  headline</h1></header><p>First <b>bold</b>ness &amp; more, with caf&eacute;.<p>Second paragraph&nbsp;of text that goes on for a while.
    <div class="ad">Buy this now, it is very cheap.</div><aside>Beside the point.</aside><form><input name=q>Search here</form>
    <p>A<br>B</p><section id="comments"><p>A reader says a lot of things in a long comment.</p></section></article>
    <div class="sidebar"><p>Other stories that are linked here for the readers.</p></div><footer>&copy; Site</footer></body></html>"""
    assert extract(html) == "The headline First boldness & more, with café. Second paragraph of text that goes on for a while. A B"


def test_extract_without_an_article_element():
    body = "".join(f"<p>Paragraph number {i} has enough words in it to count as content of the page.</p>" for i in range(5))
    html = f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div id=x>{body}</div><div class=footer>Rights</div></body>"
    got = extract(html)
    assert got.startswith("Paragraph number 0") and got.endswith("of the page.") and "Two" not in got and "Rights" not in got


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "&", "&#", "<!--", "<script>", "</p></div>", "<p>" * 3000, "<div>" * 3000 + "deep" + "</div>" * 3000, "a" * 300_000, "<a b='" + "x" * 100_000])
def test_extract_survives_odd_pages(html):
    assert isinstance(extract(html), str)


def sentences(word, n):
    return "".join(f"<p>The {word} part has sentence number {i}, long enough to count as text.</p>" for i in range(n))


@pytest.mark.parametrize("parts", ["<div><section>{a}</section><section>{b}</section></div>", "<div><p>Intro: {b}</p><blockquote>{a}</blockquote></div>", "<article>{a}</article><article>{b}</article><article>{c}</article>"])
def test_extract_keeps_all_parts_of_the_text(parts):
    a, b, c = sentences("first", 8), sentences("second", 3), sentences("third", 2)
    got = extract(f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>{parts.format(a=a, b=b, c=c)}<div class=footer>Rights</div></body>")
    assert got.count("first part") == 8 and got.count("second part") == 3 and got.count("third part") == 2 * ("{c}" in parts)
    assert "Two" not in got and "Rights" not in got


@pytest.mark.parametrize("wrapper", ["div class='container has-sidebar'", "div class=no-comments", "div class=long-form", "div id=sidebar-wrapper", "form"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_extract_looks_into_wrappers(wrapper, inner):
    aside = "<div class='sidebar'><p>Other stories.</p></div><form><p>Sign up here.</p></form><div id=post-comments><p>A reader speaks.</p></div>"
    got = extract(f"<body><{wrapper}><{inner}>{sentences('only', 6)}</{inner}>{aside}</{wrapper.split()[0]}></body>")
    assert got.count("only part") == 6 and not any(x in got for x in ("Other", "Sign", "reader"))


def test_extract_hides_long_comments():
    got = extract(f"<body><div>{sentences('only', 3)}</div><div id=comments>{sentences('reader', 9)}</div></body>")
    assert got.count("only part") == 3 and "reader" not in got


@pytest.mark.parametrize(
    "page",
    [f"<nav>{{menu}}</nav><div class='{c}'>{{main}}</div>" for c in ("has-sidebar", "no-sidebar content", "search-results", "content-with-nav", "single-post social-on", "legal-content")]
    + ["<form action=x><nav>{menu}</nav><article>{main}</article><input name=q><button>Go</button></form>", "<form><div>{menu}</div><div>{main}</div><label>Your name</label></form>"]
    + ["<nav>{menu}<article>{main}</article>", "<nav>{menu}<div>{main}</div>", "<header><aside>{menu}<article>{main}</article></aside></header>"]
    + [f"<nav>{{menu}}</nav><article>{{first}}<section {a}>{{second}}</section></article>" for a in ("id=related-work", "class=share-price", "class=legal")]
    + ["<nav>{menu}</nav><article>{first}</article><article>{second}</article>", "<nav>{menu}</nav><div>{first}</div><div>{second}</div>"],
)
def test_extract_lets_names_and_forms_only_weigh(page):
    first, second = sentences("first", 5), sentences("second", 2)
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    got = extract(f"<body>{page.format(menu=menu, first=first, second=second, main=first + second)}<footer>Rights</footer></body>")
    assert got.count("first part") == 5 and got.count("second part") == 2
    assert not any(x in got for x in ("Home", "News", "Go", "Your", "Rights"))


@pytest.mark.parametrize("outer", ["aside", "div class=sidebar", "div class='cookie-banner'", "div role=contentinfo", "div class='promo-box'", "ol class=comment-list"])
def test_extract_leaves_out_long_text_beside_a_short_article(outer):
    beside = f"<{outer}>{sentences('beside', 9)}</{outer.split()[0]}>"
    for main in ("<article>{}</article>", "<div>{}</div>"):
        got = extract(f"<body>{beside}{main.format(sentences('only', 3))}{beside}</body>")
        assert got.count("only part") == 3 and "beside" not in got


def brute_content(chars, tags, sigma=1.0):
    """Ratio, smoothing and clustering by their definitions."""
    ratio = [c / max(1, t) for c, t in zip(chars, tags, strict=True)]
    out = []
    for i in range(len(ratio)):
        weights = [(np.exp(-0.5 * ((j - i) / sigma) ** 2), r) for j, r in enumerate(ratio) if abs(j - i) <= 3 * sigma]
        out.append(sum(w * r for w, r in weights) / sum(w for w, _ in weights))
    low, high = min(out), max(out)
    for _ in range(20):
        a, b = [x for x in out if x <= (low + high) / 2], [x for x in out if x > (low + high) / 2]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    mean = sum(out) / len(out)
    edge = min((sum((x - mean) ** 2 for x in out) / len(out)) ** 0.5, (low + high) / 2)
    return [x >= edge for x in out], edge


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 40])
def test_content_lines_against_the_definitions(n):
    rng = random.Random(n)
    for _ in range(30):
        chars, tags = [rng.choice([0, 5, 20, 300, 900]) * rng.random() for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        ratio = smoothed(np.array(chars) / np.maximum(1, tags))
        content, edge = brute_content(chars, tags)
        assert threshold(ratio) == pytest.approx(edge)
        assert all(got == want or abs(r - edge) < 1e-9 for got, want, r in zip(ratio >= threshold(ratio), content, ratio, strict=True))


def test_extract_is_linear_in_depth():
    for html in ("<div>word" * 100_000, "<div>" + "</p></b>" * 100_000, "<b>" * 100_000 + "</i></div>" * 100_000, "<p>" * 100_000):
        start = time.process_time()
        extract(html)
        assert time.process_time() - start < 10


def test_extract_pages_keeps_every_row(spark):
    rows = [(1, "u", "<p>Some text here</p>"), (1, "u", "<p>Some text here</p>"), (None, None, None), (2, "v", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "u", "Some text here", 14)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)


def test_smoothing_and_threshold():
    assert smoothed(np.full(30, 5.0)) == pytest.approx(np.full(30, 5.0)) and smoothed(np.full(3, 5.0)) == pytest.approx(np.full(3, 5.0))
    ratios = np.array([1.0] * 10 + [50.0] * 10)
    assert 1 < threshold(ratios) <= 25.5


# mixing


def test_water_fill_gives_shortages_to_siblings_first(spark):
    leaves = [("a", "x", "s1", 100), ("a", "x", "s2", 10_000), ("a", "y", "s3", 10_000), ("b", "x", "s4", 10_000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    got = {r.source: r.leaf_budget for r in mixing.leaf_budgets(df, mixing.MixTargets(domains={"a": 1, "b": 1}), 0.5, 1).collect()}
    total = sum(x[3] for x in leaves) // 2
    half = total / 2  # of each domain; a's two languages have half of that each
    assert got["s1"] == 100 and got["s2"] == int(half / 2 - 100) and got["s3"] == int(half / 2) and got["s4"] == int(half)
    assert total - len(leaves) <= sum(got.values()) <= total


def test_mix_takes_a_prefix_of_the_seeded_order(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src2", None])) for i in range(400)]
    rows += [(1000, None, "en", "src0"), (1001, " ", "en", "src0"), (None, "a b c", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit("clash"))
    chosen = mixing.mix(docs, mixing.source_domain(F.col("source")), mixing.TARGETS, 0.6, 2, 5).collect()
    leaves = {}
    for doc_id, text, lang, source in rows:
        if n := len((text or "").split()):
            leaves.setdefault((lang or "unknown", source or "unknown"), []).append((doc_id, n))
    got = {}
    for r in chosen:
        got.setdefault((r.lang or "unknown", r.source or "unknown"), {})[r.doc_id] = (r.copies, r.leaf_budget)
    for leaf, found in got.items():
        members = leaves[leaf]
        supply, budget = sum(n for _, n in members), next(iter(found.values()))[1]
        epochs, rest = divmod(budget, supply)
        key = lambda d: hashlib.md5(f"5:{epochs}:{'null' if d is None else d}".encode()).hexdigest()  # noqa: B023, E731
        upto, want = 0, {d: epochs for d, _ in members}
        for d, n in sorted(members, key=lambda m: key(m[0])):
            upto += n
            want[d] += upto <= rest
        assert {d: c for d, (c, _) in found.items()} == {d: c for d, c in want.items() if c}
    spent = sum(r.copies * r.n_tokens for r in chosen)
    assert spent <= 0.6 * sum(n for m in leaves.values() for _, n in m)


def test_mix_keeps_extra_columns_whatever_their_names(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"src{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["epochs", "cut", "key", "range", "rest", "before", "supply", "mix_domain", "mix_epochs", "weight"]
    clash = docs.withColumns({c: F.lit(c) for c in [*extra, "domain", "n_tokens"]})
    plain, odd = (mixing.mix(d, mixing.source_domain(F.col("source")), mixing.TARGETS) for d in (docs, clash))
    want = sorted((r.doc_id, r.domain, r.n_tokens, r.copies) for r in plain.collect())
    got = odd.collect()
    assert sorted((r.doc_id, r.domain, r.n_tokens, r.copies) for r in got) == want and all(r[c] == c for r in got for c in extra)


def test_mix_refines_ranges_until_they_are_small(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "en", f"src{i % 2}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = []
    for few in (1 << 16, 0.0001):  # one level of ranges, and several
        monkeypatch.setattr(mixing, "SORTED_ROWS", few)
        found.append(sorted(map(tuple, mixing.mix(docs, F.lit("web"), mixing.TARGETS, 0.3).select("doc_id", "copies").collect())))
    assert found[0] == found[1] and found[0]


def test_mix_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs, F.lit("web"), mixing.TARGETS).count() == 0


# token counts


def changes(spark, rows):
    return spark.createDataFrame(rows, token_counts.CHANGE)


def test_rollup_is_additive_idempotent_and_compacts(spark, tmp_path):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    first = [("insert", "s", "en", "t", 10, None), ("insert", "s", "en", "t", 5, None), ("insert", None, None, "t", 7, None)]
    second = [("revise", "s", "en", "t", 12, 10), ("delete", None, None, "t", None, 7)]
    assert store.commit("a", changes(spark, first)) and store.commit("b", changes(spark, second))
    assert not store.commit("a", changes(spark, first))
    want = [("s", "en", "t", 2, 17)]
    assert [tuple(r) for r in store.totals().collect()] == want
    store.compact()
    assert [tuple(r) for r in store.totals().collect()] == want and store.batches() == ["a", "b"]
    assert not store.commit("b", changes(spark, second))
    assert store.commit("c", changes(spark, [("insert", "s", "en", "t", 1, None)]))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "t", 3, 18)]
    with pytest.raises(ValueError):
        store.commit("../x", changes(spark, first))


def test_a_half_written_batch_does_not_count(spark, tmp_path):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    store.commit("a", changes(spark, [("insert", "s", "en", "t", 10, None)]))
    (tmp_path / "store/deltas/batch=a/_SUCCESS").unlink()
    assert store.totals().count() == 0
    assert store.commit("a", changes(spark, [("insert", "s", "en", "t", 10, None)])) and store.totals().first().n_tokens == 10


def test_a_stopped_compaction_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    store.commit("a", changes(spark, [("insert", "s", "en", "t", 10, None)]))
    store.compact()
    store.commit("b", changes(spark, [("insert", "s", "en", "t", 5, None)]))
    whole = token_counts.TokenRollup._sum

    def stopped(self, base, names):
        raise RuntimeError("stopped")

    monkeypatch.setattr(token_counts.TokenRollup, "_sum", stopped)  # after the first write
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.setattr(token_counts.TokenRollup, "_sum", whole)
    assert store.totals().first().n_tokens == 15 and store.commit("c", changes(spark, [("insert", "s", "en", "t", 1, None)]))
    store.compact()
    (tmp_path / "store/base/000000001/sums/_SUCCESS").unlink()  # after the second, before its marker
    assert store.totals().first().n_tokens == 16 and store.batches() == ["a", "b", "c"]
    store.compact()
    store.vacuum()
    assert store.totals().first().n_tokens == 16 and not store.commit("b", changes(spark, []))
    assert not list((tmp_path / "store/deltas").glob("batch=*")) and len(list((tmp_path / "store/base").iterdir())) == 1


def test_count_tokens_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    clash = docs.withColumns({c: F.lit("x") for c in ("tokenizer", "n_tokens", "estimate")})
    got = sorted((tuple(r) for r in token_counts.count_tokens(clash, "v").collect()), key=repr)
    assert got == sorted([(1, "s", "en", "v", 2, 1)] * 2 + [(None, None, None, "v", 0, 0)], key=repr)
    assert token_counts.count_tokens(docs.limit(0), "v").count() == 0


def test_count_tokens_of_whole_texts(spark):
    import tiktoken  # noqa: F401

    counter = token_counts.bpe_counter()
    texts = [None, "", "Hello world, it's 2024!", "ß 中文 \U0001f600", "long text " * 20_000]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "v").collect()}
    assert [got[i] for i in range(5)] == counter(texts) and got[0] == got[1] == 0 and got[4] > 20_000


def test_op8_totals_against_brute_force(spark):
    from spreadwatch.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    toxic = set(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").toPandas().doc_id)
    docs = docs[~docs.doc_id.isin(toxic)]
    docs["n"] = token_counts.bpe_counter()(docs.text.tolist())
    want = docs.groupby(["source", "lang"], dropna=False).n.agg(["count", "sum"])
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in QUERIES["op8_token_counts"](spark, sf).collect()}
    assert got == {k: (v["count"], v["sum"]) for k, v in want.iterrows()}


# WARC


PAGE = "page_id long, url string, html string"
BIG = "<p>é</p>" * 400
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, None), (4, "http://c/\r\nX: y", "tiny"), (5, "http://d/", "tiny"), (None, "u", BIG), (6, "e", "z" * 1_000_000), (7, "f", "WARC/1.1\r\n\r\n")]


def test_archive_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(PAGES, PAGE).withColumn("payload", F.lit("clash")), path, chunk_bytes=1000)
    chunks = spark.read.parquet(path)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    got = {r.page_id: r for r in warc.page_records(chunks).collect()}
    assert len(got) == len(PAGES) and all(r.intact for r in got.values())
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if page_id == 1 else ("response", None))


def test_archive_of_repeated_pages_and_stable_record_ids(spark, tmp_path):
    pages = [(1, "u", BIG), (1, "u", BIG), (2, "v", BIG), (2, "v", BIG), (3, "w", "short"), (3, "w", "short")]
    spark.createDataFrame(pages, PAGE).coalesce(1).write.parquet(f"file://{tmp_path}/pages")
    table = spark.read.parquet(f"file://{tmp_path}/pages")
    ids = [sorted(r.record_id for r in warc.archive(table).select("record_id").distinct().collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 6
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.page_records(warc.archive(table)).collect())
    assert got == [(1, "revisit", 2)] * 2 + [(2, "response", None)] * 2 + [(3, "response", None)] * 2


def test_archive_notices_damage(spark, tmp_path):
    chunks = warc.archive(spark.createDataFrame(PAGES, PAGE), chunk_bytes=1000)
    chunks = spark.createDataFrame(chunks.collect(), warc.ARCHIVE)
    spoiled = chunks.withColumn("data", F.when((F.col("chunk_no") == 2) & (F.octet_length("data") == 1000), F.encode(F.lit("!" * 1000), "UTF-8")).otherwise(F.col("data")))
    assert warc.read_records(spoiled).where("not intact").count() >= 1
    assert warc.read_records(chunks.where("chunk_no <> 1")).where("not intact").count() >= 1
    assert warc.page_records(warc.archive(spark.createDataFrame([], PAGE))).count() == 0


def test_warc_files_out_and_in(spark, tmp_path):
    chunks = spark.createDataFrame(warc.archive(spark.createDataFrame(PAGES, PAGE)).collect(), warc.ARCHIVE)
    files = warc.export_files(chunks, str(tmp_path)).collect()
    assert sum(r.n_bytes for r in files) == chunks.agg(F.sum(F.octet_length("data"))).first()[0]
    back = warc.page_records(warc.import_files(spark, [r.path for r in files if r.n_bytes], chunk_bytes=777))
    key = lambda df: sorted(map(repr, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()))
    assert key(back) == key(warc.page_records(chunks))
