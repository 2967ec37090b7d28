"""Language-model scoring against plain Python: counts, probabilities, gradient, windows, edges."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spreadwatch.llm import lm_scoring as L

SCHEMA = "doc_id long, text string"


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def plain_base(rows):
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(x)), sum(t in counts for t in tokens(x)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows]


@pytest.fixture(scope="module")
def model():
    vocabulary = L.read_vocabulary(L.VOCABULARY)
    rng = np.random.default_rng(0)
    counts = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    counts[:2000] = rng.integers(1, 1000, 2000)
    counts[-1] = 500
    inventory = L.Inventory(counts, vocabulary)
    flat = L.initial(inventory)
    flat += rng.standard_normal(len(flat)).astype(np.float32) * np.float32(0.2)
    return vocabulary, inventory, flat


def plain_score(ids, w, inventory):
    """log10 probability of ids, place by place: attention over the window that scores each, then class and member."""
    places = [inventory.end, *inventory.place[ids].tolist()]
    total = 0.0
    for t in range(len(places) - 1):
        low = max(0, (t // L.STRIDE) * L.STRIDE - (L.WIDTH - L.STRIDE))
        seen = range(low, t + 1)
        s = np.array([w["q"][places[t]] @ w["k"][places[j]] / math.sqrt(L.DIM) + w["distance"][t - j] for j in seen], dtype=float)
        a = np.exp(s - s.max())
        a /= a.sum()
        h = w["own"][places[t]] + sum(x * w["v"][places[j]] for x, j in zip(a, seen, strict=True))
        h = h / (1 + np.abs(h))
        cls, member = divmod(places[t + 1], inventory.members)
        for logits, at in ((h @ w["cls"] + w["cls_bias"], cls), (h @ w["out"][cls] + w["out_bias"][cls], member)):
            total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        total += inventory.share[ids[t]]
    return total / math.log(10)


def shared_of(model, frequent):
    vocabulary, inventory, flat = model
    cut = L.Subwords(vocabulary)
    found = [cut.ids(w) for w in frequent]
    lengths = np.array([len(x) for x in found], dtype=np.int64)
    return {
        "vocabulary": vocabulary, "place": inventory.place, "pad": inventory.pad, "flat": flat, "members": inventory.members, "end": inventory.end, "share": inventory.share, "words": frequent, "logs": np.ones(len(frequent)),
        "ids": np.array([i for x in found for i in x], dtype=np.int32), "starts": np.cumsum(lengths) - lengths, "lengths": lengths,
    }


@pytest.mark.parametrize("group", [3, 60_000])
@pytest.mark.parametrize("frequent", [[], [b"the", b"cat", b"s\xc3\xa9same"]])
def test_scores_do_not_hang_on_pieces_and_groups(model, monkeypatch, group, frequent):
    """Each id is scored once, from the window that holds it, wherever a text is cut."""
    vocabulary, inventory, flat = model
    monkeypatch.setattr(L, "GROUP_WORDS", group)
    scorer, cut, w = L.Scorer(shared_of(model, frequent)), L.Subwords(vocabulary), L.views(flat, inventory.members)
    rng = random.Random(2)
    texts = [[], [b"the"], [b"the", b"cat"] * 30, [rng.choice([b"the", b"cat", b"s\xc3\xa9same", b"zzyzx", b"q" * 70]) for _ in range(150)]]
    for row, words in enumerate(texts):
        step = rng.choice([1, 7, 40])
        for low in range(0, len(words), step):
            scorer.add(row, words[low : low + step], False)
        scorer.add(row, [], True)
    scorer.flush()
    for row, words in enumerate(texts):
        want = plain_score([i for x in [*words, L.END] for i in cut.ids(x)], w, inventory)
        assert scorer.totals[row][3] / math.log(10) == pytest.approx(want, rel=1e-4)


def test_probabilities_add_up_to_one(model):
    _, inventory, flat = model
    w = L.views(flat.astype(np.float64), inventory.members)
    assert L.small(w)
    windows = np.random.default_rng(1).integers(0, L.MODEL_IDS, (1, L.WIDTH + 1)).repeat(L.MODEL_IDS + 1, 0)
    for at in (0, 9):
        here = windows.copy()
        here[:, L.WIDTH - L.STRIDE + 1 + at] = np.arange(L.MODEL_IDS + 1)
        for safe in (False, True):
            assert np.exp(L.log_probabilities(w, here, inventory.members, inventory.pad, safe)[:, at]).sum() == pytest.approx(1.0)
    rest = inventory.place == inventory.other
    assert np.exp(inventory.share[rest]).sum() == pytest.approx(1.0)


def test_gradient(model):
    _, inventory, flat = model
    flat = flat.astype(np.float64)
    rng = np.random.default_rng(4)
    windows = rng.integers(0, L.MODEL_IDS + 1, (4, L.WIDTH + 1)).astype(np.int32)
    windows[0, -6:], windows[1, :10] = inventory.pad, inventory.pad
    w = L.views(flat, inventory.members)
    _, grad = L.gradient(w, windows, inventory.members, inventory.pad)
    for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-4), 40):
        old, step = flat[i], 1e-5
        losses = []
        for flat[i] in (old + step, old - step):
            losses.append(L.gradient(w, windows, inventory.members, inventory.pad)[0])
        flat[i] = old
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grad[i], rel=0.02, abs=1e-5)


def test_training_learns_what_comes_before(model):
    """Ids that alternate are told apart only by the one before."""
    _, inventory, _ = model
    rng = np.random.default_rng(0)
    start = rng.integers(0, 8, (256, 1))
    windows = ((start + np.arange(L.WIDTH + 1)) % 8).astype(np.int32)
    flat = L.initial(inventory)
    for turn in range(12):
        flat = L.trained(flat, windows, inventory.members, inventory.pad, turn)
    loss, _ = L.gradient(L.views(flat, inventory.members), windows, inventory.members, inventory.pad)
    assert loss < 0.7 < math.log(8)


def test_every_id_is_trained_on_once(spark, monkeypatch, model):
    """What the windows ask the model to predict are all ids of all training texts, however they are cut."""
    vocabulary, inventory, _ = model
    monkeypatch.setattr(L, "PASSAGE", 4)
    monkeypatch.setattr(L, "PIECE", 64)
    rng = random.Random(5)
    texts = ["", None, "one"] + [" ".join(rng.choice(["the", "cat", "séamesequences", "zzyzx", "q" * 70]) for _ in range(rng.randrange(1, 200))) for _ in range(80)]
    passages = L.counted(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2)).where("passage is not null").select("passage")
    shared = spark.sparkContext.broadcast({"vocabulary": vocabulary, "place": inventory.place, "pad": inventory.pad})
    windows = np.concatenate([np.frombuffer(r.ids, np.uint16).reshape(-1, L.WIDTH + 1) for r in L.training_windows(passages, shared).collect()])
    cut, want = L.Subwords(vocabulary), Counter()
    for i, text in enumerate(texts):
        if not held(i):
            want.update(inventory.place[[x for t in tokens(text) for x in cut.ids(L.END if t is None else t.encode())]].tolist())
    assert Counter(int(x) for x in windows[:, 1:].reshape(-1) if x != inventory.pad) == want


def test_counts_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_FREQUENT", 40)
    monkeypatch.setattr(L, "PIECE", 64)
    monkeypatch.setattr(L, "FLUSH_WORDS", 30)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["É", "É".lower(), "A", "a", "\x1c", "nb sp", "x" * 500]
    rows = [(rng.choice([None, i, i % 50]), rng.choice([None, "", " \n\t", " ".join(rng.choice(words[: rng.choice([5, 50, len(words)])]) for _ in range(rng.randrange(90))), "\x0b".join(["The", "THE", "the\r"] * 40)])) for i in range(300)]
    got = L.score_texts(spark.createDataFrame([(*r, 1, b"z") for r in rows], SCHEMA + ", n long, word binary").repartition(3)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 6))
    want = sorted(plain_base(rows), key=key)
    for a, b in zip(sorted([tuple(r)[:6] for r in got], key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score < 0 for r in got)


def test_model_beats_guessing_and_equal_texts_score_equally(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the cat sat", "on the mat", "and then slept"]) for _ in range(200))) for i in range(500)] + [(1000, "zq"), (1001, "zq")]
    got = {r.doc_id: r for r in L.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000].score == pytest.approx(got[1001].score, rel=1e-5)
    held_out = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert held_out and all(r.score > 0.8 * r.base_score for r in held_out)  # words that follow from those before


def test_edges(spark):
    assert L.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    only = next(i for i in range(100) if held(i))
    (row,) = L.score_texts(spark.createDataFrame([(only, None)], SCHEMA)).collect()
    assert tuple(row)[:6] == (only, True, 1, 0, 0, 0.0) and row.score < 0


def test_texts_are_cut_once(spark, monkeypatch, model):
    """The first pass gives passages as ids, so that making windows needs no words and no splitter."""
    vocabulary, inventory, _ = model
    monkeypatch.setattr(L, "PASSAGE", 3)
    monkeypatch.setattr(L, "FLUSH_WORDS", 4)
    texts = ["The cat zzyzx sat", "", "zzyzx the " * 4]
    ids = [i for i in range(40) if not held(i)][: len(texts)]
    rows = L.counted(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA).coalesce(1)).collect()
    cut, counts = L.Subwords(vocabulary), Counter()
    for r in rows:
        if r.word is not None:
            counts[bytes(r.word)] += r.n
    assert counts == Counter(L.END if t is None else t.encode() for x in texts for t in tokens(x))
    found = [np.frombuffer(r.passage, np.uint16).tolist() for r in rows if r.passage is not None]
    want = [i for x in texts for t in tokens(x) for i in cut.ids(L.END if t is None else t.encode())]
    assert [i for p in found for i in p[1:]] == want
    assert [p[0] for p in found[1:]] == [p[-1] for p in found[:-1]] and found[0][0] == cut.end


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_rows_are_summed_by_id_in_blocks(kind):
    """Sums by id, with as many rows of an id as fill blocks, fall short of one or go beyond."""
    rng = np.random.default_rng(6)
    for n in (1, 5, 4000):
        ids, rows = (40 * rng.random(n) ** 3).astype(np.uint16), rng.standard_normal((n + 1, 6)).astype(kind)
        rows[-1] = 0
        there, sums = L.sums_by_id(ids, rows, 50)
        assert there.tolist() == sorted(set(ids.tolist())) and sums.dtype == kind
        assert np.allclose(sums, [rows[:-1][ids == i].sum(axis=0) for i in there], atol=1e-3)


def test_ids_are_counted_with_the_cut(spark, monkeypatch, model):
    """The first pass counts the ids as it cuts them, each once, so that no word is cut again for that."""
    vocabulary, _, _ = model
    monkeypatch.setattr(L, "PASSAGE", 3)
    monkeypatch.setattr(L, "FLUSH_WORDS", 4)
    texts = ["The cat zzyzx sat", "", None, "zzyzx the " * 4]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(60)], SCHEMA).repartition(3)
    cut = L.Subwords(vocabulary)
    want = Counter(x for i in range(60) if not held(i) for t in tokens(texts[i % 4]) for x in cut.ids(L.END if t is None else t.encode()))
    got = L.id_counts(L.counted(docs).where("id is not null").select("id", "n"), vocabulary)
    assert {i: n for i, n in enumerate(got.tolist()) if n} == want
