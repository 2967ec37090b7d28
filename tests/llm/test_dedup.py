"""Exact dedup, line dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwatch.llm import exact_dedup as exact
from spreadwatch.llm import line_dedup as line_module
from spreadwatch.llm import ngram_join as join
from spreadwatch.llm.common import connected_components
from spreadwatch.llm.line_dedup import apply_line_dedup, line_dedup
from spreadwatch.llm.substring_dedup import remove_spans, repeated_spans, units

SCHEMA = "doc_id long, text string"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, " ab"), (7, "AB"), (8, "a b"), (None, "only here"), (9, "x" * 200_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# exact dedup


def brute_exact(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in WHITE)
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id if doc_id is not None else 1 << 63, doc_id))
    out = []
    for doc_id, text in rows:
        group = groups[norm(text)]
        keep = min(group)[2]
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edge_cases(spark):
    got = exact.exact_dedup(frame(spark, EDGE)).drop("n_code_points").collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(EDGE)


def test_exact_dedup_empty_and_extra_columns(spark):
    empty = frame(spark, []).withColumn("kept", F.lit("clash")).withColumn("fp", F.lit(1))
    assert exact.exact_dedup(empty).count() == 0
    some = frame(spark, EDGE).withColumn("group_size", F.lit("clash")).withColumn("norm", F.lit(1))
    assert exact.exact_dedup(some).count() == len(EDGE)


def test_exact_dedup_repeated_rows(spark):
    rows = [(1, "same"), (1, "same"), (2, "sa me"), (3, "other")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(frame(spark, rows)).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True)}


def test_exact_dedup_smallest_and_largest_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(high, "a b"), (low, "a b"), (0, "a b"), (high, "c d"), (None, "c d"), (-1, "e"), (-2, "e")]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact.exact_dedup(frame(spark, rows)).collect()}
    assert got == {(high, low, False), (low, low, True), (0, low, False), (high, high, True), (None, high, False), (-1, -2, False), (-2, -2, True)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_filter_round_trip_and_lossless_merge(n):
    rng = np.random.default_rng(n)
    draw = lambda: np.unique(rng.integers(0, 500, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)
    (a, na), (b, nb) = draw(), draw()
    keys, counts = exact.decode_filter(exact.encode_filter(a, na.astype(np.uint64), 10))
    assert (keys == a).all() and (counts == na).all()
    merged, total = exact.merge_filters([exact.encode_filter(a, na, 10), exact.encode_filter(b, nb, 5)])
    want = {}
    for k, c in itertools.chain(zip(a, na, strict=True), zip(b, nb, strict=True)):
        want[int(k)] = want.get(int(k), 0) + int(c)
    assert dict(zip(map(int, merged), map(int, total), strict=True)) == want
    assert (np.diff(merged.astype(object)) > 0).all()


# line dedup


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    docs = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(d := docs.get(key(x), ())) >= min_docs and doc_id != max(d) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc_id, len(lines), sum(gone), kept))
    return sorted(out)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["short", "  A common LINE of text\t", "a common line of text", "Ünïcode line of text", "", "one more line here", "\r", "x" * 30]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "a common line of text\n" * 2000)]
    got = apply_line_dedup(frame(spark, rows), min_chars=10, min_docs=5)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect())
    assert got == brute_lines(rows, 10, 5)


def test_line_dedup_bitmaps_are_run_lengths(spark):
    rows = [(i, "keep this one %d\nthis line is everywhere\nthis line is everywhere\nlast %d" % (i, i)) for i in range(6)]
    found = {r.doc_id: r for r in line_dedup(frame(spark, rows), min_chars=10, min_docs=5).collect()}
    assert found[0].keep_runs == [1, 2] and found[0].n_dropped == 2 and found[0].n_lines == 4
    assert found[5].keep_runs is None and found[5].n_dropped == 0


def test_line_dedup_null_ids_empty_table_and_clashing_columns(spark):
    rows = [(None, "this line is everywhere")] + [(i, "this line is everywhere") for i in range(4)]
    assert apply_line_dedup(frame(spark, rows), 10, 5).where("n_dropped > 0").count() == 0
    clash = frame(spark, rows[1:]).withColumn("n_lines", F.lit("x")).withColumn("pos", F.lit(7)).withColumn("h1", F.lit(1))
    out = apply_line_dedup(clash, 10, 4)
    assert {"pos", "h1"} <= set(out.columns) and {r.n_dropped for r in out.collect()} == {0, 1}
    assert apply_line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_streams_runs_after_one_range_exchange(spark, monkeypatch):
    """No exchange by hash of the line; hot keys, taken out, give the same as streamed ones."""
    rng = random.Random(4)
    rows = [(i, "\n".join(f"line number {rng.randint(0, 30)} of the text" for _ in range(rng.randint(0, 12)))) for i in range(80)]
    lines = line_module.occurrences(frame(spark, rows), 10)
    plan = line_module.lost_lines(lines, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(h1" in plan
    streamed, hot = (sorted(map(tuple, f(lines, 5).distinct().collect())) for f in (line_module.lost_lines, line_module.lost_hot_lines))
    assert streamed == hot and streamed
    assert len(line_module.hot_slots(lines)) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_hot_lines_are_few_at_any_number_of_partitions(spark):
    """Spread hashes have no hot slot at cluster settings; a key of a third of all rows always has."""
    spread = spark.range(200_000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("doc_id"), F.lit(0).alias("pos"))
    one = spark.range(100_000).select(F.xxhash64(F.lit(-5)).alias("h1"), F.lit(1).alias("h2"), F.col("id").alias("doc_id"), F.lit(0).alias("pos"))
    lines = spread.unionByName(one)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (8, 2000, 40_000):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert len(line_module.hot_slots(lines)) == 1 and line_module.hot_slots(spread) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_of_many_dropped_runs(spark):
    """Every other line of a long document goes: thousands of runs."""
    common = "\n".join(x for i in range(5000) for x in (f"a line {i} that is in all of the documents", f"short {i}"))
    rows = [(d, common) for d in range(6)]
    found = {r.doc_id: r for r in line_dedup(frame(spark, rows), 20, 5).collect()}
    assert found[5].keep_runs is None and found[0].n_dropped == 5000 and found[0].keep_runs == [0, 1] + [1, 1] * 4999


def test_line_dedup_plan_has_no_python(spark):
    plan = apply_line_dedup(frame(spark, EDGE))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# substring dedup


def test_units_keep_offsets_and_join_short_neighbours():
    text = "  First Sentence  of five words. Yes! No. Well, perhaps so.\n\nAnother line of five words"
    found = list(units(text, 4))
    assert [text[a:b] for _, a, b, _ in found] == ["First Sentence  of five words.", "Yes! No. Well, perhaps so.", "Another line of five words"]
    assert [n for *_, n in found] == [5, 5, 5]
    assert found[0][0] == next(units("first sentence OF five   words.", 4))[0]
    assert list(units(" " * 200_000 + "\n!", 4)) == []


def brute_spans(rows, min_unit, min_span):
    seen, spans = {}, set()
    for doc_id, text in sorted(rows):
        run = []

        def close(doc_id=doc_id):
            if sum(n for *_, n in run) >= min_span:
                spans.add((doc_id, run[0][0], run[-1][1], sum(n for *_, n in run)))
            run.clear()

        for digest, start, stop, n in units(text or "", min_unit):
            if digest in seen:
                run.append((start, stop, n))
            else:
                seen[digest] = doc_id
                close()
        close()
    return spans


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta".split(), k=rng.randint(1, 14))) + rng.choice(".!?\n") for _ in range(40)]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(50)] + [(90, None), (91, ""), (92, "word " * 50_000)]
    got = repeated_spans(frame(spark, rows), 4, 10)
    assert {(r.doc_id, r.start, r.stop, r.n_words) for r in got.collect()} == brute_spans(rows, 4, 10)


def test_remove_spans_cuts_and_keeps_offsets(spark):
    shared = "This passage of quite a few words is held by two documents and goes from the later one."
    rows = [(1, f"One starts here. {shared} And ends."), (2, f"Two starts differently. {shared} Then it ends so."), (3, None)]
    docs = frame(spark, rows).withColumn("removed", F.lit("clash"))
    out = {r.doc_id: r for r in remove_spans(docs, repeated_spans(docs, 4, 10)).collect()}
    assert out[1].text == rows[0][1] and out[1].removed is None and out[3].text is None
    (cut,) = out[2].removed
    assert rows[1][1][cut.start : cut.stop] == shared and out[2].text == rows[1][1].replace(shared, "")
    assert repeated_spans(frame(spark, [])).count() == 0


def test_substring_dedup_removes_a_long_repeat_that_leaves_one_whole_unit(spark):
    """The repeat of 52 words begins and ends inside sentences; 18 of its words are a whole one."""
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    whole = word("b", 17) + " end."
    shared = f"{word('a', 17)}. {whole} {word('c', 17)}"
    rows = [(1, f"One goes {shared} its own way."), (2, f"Two comes {shared} to another end."), (3, "Nothing of that is here.")]
    (span,) = repeated_spans(frame(spark, rows)).collect()
    assert (span.doc_id, rows[1][1][span.start : span.stop], span.n_words, span.kept_doc_id) == (2, whole, 18, 1)


# n-gram join


def brute_components(rows, words, percent):
    def shingles(text):
        w = "".join(" " if c in WHITE else c for c in (text or "").translate(LOWER)).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    smallest = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        smallest[x] = min(smallest.get(x, doc_id), doc_id)
    return sorted((rows[i][0], len(sets[i]), smallest[label[i]]) for i in range(len(rows)))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, doc_id = [], 0
    for size in (1, 3, 4, 5, 8, 12, 20, 40, 90, 150, 400):
        base = rng.choices(vocabulary, k=size)
        for edits in (0, 0, 1, 2, 3, 6, 12):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = text[: max(1, int(len(text) * 0.9))]
            rows.append((doc_id := doc_id + rng.randint(1, 3), rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "A B"), (904, "a b"), (905, "a b a b a b a b a b a b")]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in join.ngram_components(frame(spark, rows).repartition(5), words, percent).collect())
    assert got == brute_components(rows, words, percent)


def test_ngram_join_empty_table_null_ids_and_repeated_rows(spark):
    assert join.ngram_components(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "nothing like it")]
    docs = frame(spark, rows).withColumn("node", F.lit("clash")).withColumn("n", F.lit(0))
    got = sorted((tuple(r) for r in join.ngram_components(docs).collect()), key=repr)
    assert got == [(7, 2, 7), (7, 2, 7), (None, 1, None), (None, 2, 7)] or got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 1, None)], key=repr)
    assert join.keep_one_per_component(docs).where("doc_id = 7").count() == 2


def test_ngram_join_links_through_a_null_id_row(spark):
    """Two known documents are each near to rows with a null id, and not near enough to each other."""
    words = [f"w{i}" for i in range(110)]
    rows = [(5, " ".join(words[:100])), (None, " ".join(words[5:105])), (None, " ".join(words[5:105])), (8, " ".join(words[10:])), (None, "alone and by itself")]
    got = sorted((tuple(r) for r in join.ngram_components(frame(spark, rows), 4, 85).collect()), key=repr)
    assert got == sorted([(5, 97, 5), (None, 97, 5), (None, 97, 5), (8, 97, 5), (None, 1, None)], key=repr)


def test_chunked_cells_lose_no_link(spark, monkeypatch):
    """Cells larger than a chunk are searched chunk against chunk."""
    monkeypatch.setattr(join, "CHUNK", 4)
    monkeypatch.setattr(join, "SMALL", 2)
    rng = random.Random(11)
    head = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join(head + [f"t{rng.randrange(6)}" for _ in range(14)])) for i in range(40)]
    got = sorted(tuple(r) for r in join.ngram_components(frame(spark, rows), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_null_id_near_copies_link_known_documents(spark):
    """5 ~ null ~ 9 by near, not equal, texts: both known documents reach 5."""
    words = [f"w{i}" for i in range(300)]
    rows = [(9, " ".join(words[24:])), (None, " ".join(words[12:288])), (5, " ".join(words[:276])), (None, None), (7, "")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in join.ngram_components(frame(spark, rows), 4, 85).collect()}
    assert got == {(9, 273): 5, (None, 273): 5, (5, 273): 5, (None, 0): None, (7, 0): 7}


@pytest.mark.parametrize("percent", [80, 85])
def test_cells_meet_in_any_order_and_stay_small(percent):
    """Linked sets share one of their first shingles whatever the totals; unrelated ones meet in no cell, however many there are."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 5, 9, 40, 200):
        for _ in range(40):
            base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 62, n // 12).astype(np.uint64)]))
            both = len(np.intersect1d(base, other))
            if not both or 100 * both < percent * (len(base) + len(other) - both):
                continue
            totals = rng.integers(0, 4, 1 << 16).astype(np.uint8)
            a, b = (join.first_in_order(x, totals, 16, percent) for x in (base, other))
            first = next(x for x in a if x in set(b.tolist()))
            i, j = a.tolist().index(first), b.tolist().index(first)
            assert join.may_meet(len(base), len(base) - i, len(other), len(other) - j, percent)
    flat = np.zeros(1 << 16, dtype=np.uint8)
    largest = []
    for n_docs in (500, 2000):
        cells = np.concatenate([join.first_in_order(np.unique(rng.integers(0, 1 << 62, 100).astype(np.uint64)), flat, 16, percent) for _ in range(n_docs)])
        largest.append(int(np.unique(cells, return_counts=True)[1].max()))
    assert largest == [1, 1]


def test_coordinate_minima_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, 400).astype(np.uint64) * join.ODD[0]) for _ in range(2))
        points = join.points_of([join.vector_of(a), join.vector_of(b)]).astype(np.int64)
        assert np.minimum(*points).sum() >= len(np.intersect1d(a, b))
        assert np.minimum(*join.coarse(points)).sum() >= np.minimum(*points).sum()


def test_connected_components_of_a_long_path(spark):
    edges = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_connected_components_of_a_path_in_random_order(spark):
    order = [int(x) for x in np.random.default_rng(0).permutation(1000)]
    edges = spark.createDataFrame(list(itertools.pairwise(order)), "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == dict.fromkeys(range(1000), 0)
