"""Scores of whole texts by a causal self-attention model over subword ids, trained here in numpy.

Method: a text's words are cut into ids of a public byte-level vocabulary. The model reads a window
of ids: each place attends to itself and the places before it in the window (one masked softmax per
place, with a learned bias by distance), adds what its own id says, and predicts the next id as a
class and a member of that class. Windows of 32 places overlap by half and only their second half
is scored, so each id is scored once, from 16 to 31 earlier ids; the first window's missing ids are
masked. Windows of many texts go through batched matrix products together.

What is learned, all of it from documents that are not held out:

* counts of all words and of all their ids of all texts (by number in tasks, summed in Spark); those of
  words give the base score. Ids beyond the ``MODEL_IDS`` most frequent share one place in the model and
  are told apart by their counts.
* weights from all words of all texts, each id once. Shards of bounded size train side by
  side and their weights are averaged after each round; only these averages (0.7 MB) come to the driver.

Scale: two passes over the texts; the first counts words and cuts them into ids at once. A text goes in pieces of about ``PIECE`` bytes, so no list of a
whole long text's words exists. The words frequent enough for a table of at most
``MAX_FREQUENT`` entries of 64 bytes are broadcast with their ids; the counts of all others meet
(row, word) pairs in a join, which no frequent word can skew.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadwatch.llm.common import discard, scratch
from spreadwatch.llm.language_id import VOCABULARY, read_vocabulary

#: The end of a text as a token: no word holds a line feed.
END = b"\n"
HELD_OUT = 7, 2
PIECE = 1 << 18
#: Words of a passage to train on; all of a text's words are in one.
PASSAGE = 1024
#: Distinct words a task counts before it hands them on.
FLUSH_WORDS = 200_000
MAX_FREQUENT, MAX_WORD = 1 << 18, 64
#: Ids the model tells apart; they and the place of all others are dealt to classes of equal size.
MODEL_IDS, CLASSES = 1023, 32
WIDTH, STRIDE, DIM = 32, 16, 16
#: Words whose windows are worked on together, windows of a matrix product, words a worker remembers.
GROUP_WORDS, BATCH, CACHE_WORDS = 60_000, 128, 200_000
#: Training: windows of a step, ids of a shard, rounds, passes over a round's windows, step size.
STEP, SHARD_IDS, ROUNDS, EPOCHS, RATE = 256, 8_000_000, 3, 1, 0.01
#: A small shard takes smaller steps, of this many windows at least, for that many steps.
SMALL_STEP, STEPS = 32, 300
#: Windows of a slice of the attention in training, rows of a block of the softmax.
ATTEND, ROWS = 64, 2048
CHUNK = 256

WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Fixed value: what the vocabulary's own splitter takes as one unit is a word here.
WHOLE = r"[\s\S]+"


def is_held_out(doc_id: Column) -> Column:
    modulus, rest = HELD_OUT
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lower-cased, some at a time and once at least; no word is cut."""
    at = 0
    if len(raw) <= PIECE:
        yield raw.lower().split()
        return
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            white = WHITE.search(raw, end)
            end = white.start() if white else len(raw)
        yield raw[at:end].lower().split()
        at = end


# ---- counts and passages


class Cutter:
    """Numbers the words it meets, counts them and lays out their ids; forgets all at ``restart``."""

    def __init__(self, cut: Subwords):
        self.cut = cut
        self.restart()

    def restart(self) -> None:
        self.numbers: dict[bytes, int] = {END: 0}
        self.ids, self.lengths = array("i", [self.cut.end]), array("q", [1])
        self.counts = np.zeros(1 << 12, dtype=np.int64)

    def take(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; new words get the next ones. A text's end has number 0."""
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(found < 0)
        if len(missed):
            own = [words[i] for i in missed.tolist()]
            new = list(dict.fromkeys(own))
            cut = [self.cut.cut(b" " + w) for w in new]
            self.ids.extend(chain.from_iterable(cut))
            self.lengths.extend(map(len, cut))
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            found[missed] = np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own))
        return found

    def lay_out(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered words one after another, where each word's ids end)."""
        lengths = np.array(self.lengths, dtype=np.int64)
        own = lengths[numbers]
        return np.array(self.ids, dtype=np.int32)[_laid_out((np.cumsum(lengths) - lengths)[numbers], own)], np.cumsum(own)

    def count(self, numbers: np.ndarray) -> None:
        more = np.bincount(numbers)
        if len(more) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(more), dtype=np.int64)])
        self.counts[: len(more)] += more


def _id_type(vocabulary: list[bytes]) -> type:
    """What holds the ids of a vocabulary and the one of a text's end."""
    return np.uint16 if len(vocabulary) < 1 << 16 else np.int32


def counted(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(word, n) and (id, n) partial counts of all training texts, and rows with a passage instead: the packed ids of all words of a text in order with its end marks, a passage starting at the id the last one ended with."""
    train = docs.where(~is_held_out(F.col("doc_id"))).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    names = ["word", "n", "passage", "id"]
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": read_vocabulary(vocabulary_path)})

    def batch_of(rows: int, **columns: list | np.ndarray) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, kind = Cutter(subwords(shared.value)), _id_type(shared.value["vocabulary"])
        times = np.zeros(len(shared.value["vocabulary"]) + 1, dtype=np.int64)

        def passages_of(held: list[np.ndarray]) -> pa.RecordBatch:
            """Of passages as numbers of words, each after the word that the one before ended with."""
            numbers, edges = np.concatenate(held), np.cumsum([0, *map(len, held)])
            cutter.count(np.delete(numbers, edges[:-1]))
            ids, ends = cutter.lay_out(numbers)
            starts, highs = ends[edges[:-1]], ends[edges[1:] - 1].tolist()
            ids = ids.astype(kind)
            found = [ids[a:b] for a, b in zip((starts - 1).tolist(), highs, strict=True)]
            np.add(times, np.bincount(np.concatenate([x[1:] for x in found]), minlength=len(times)), out=times)
            return batch_of(len(held), passage=[x.tobytes() for x in found])

        def counts() -> pa.RecordBatch:
            n = len(cutter.numbers)
            there = np.flatnonzero(cutter.counts[:n]).tolist()
            words = list(cutter.numbers)
            return batch_of(len(there), word=[words[i] for i in there], n=cutter.counts[there])

        held, waiting, end = [], 0, np.zeros(1, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("raw"):
                carried = end
                for words in pieces(raw.as_py()):
                    carried = np.concatenate([carried, cutter.take(words)])
                    full = (len(carried) - 1) // PASSAGE * PASSAGE
                    held += [carried[low : low + PASSAGE + 1] for low in range(0, full, PASSAGE)]
                    carried, waiting = carried[full:], waiting + full
                    if held and waiting >= GROUP_WORDS:
                        yield passages_of(held)
                        held, waiting = [], 0
                held.append(np.concatenate([carried, end]))
                waiting += len(carried)
                if waiting >= GROUP_WORDS:
                    yield passages_of(held)
                    held, waiting = [], 0
                if len(cutter.numbers) >= FLUSH_WORDS:
                    if held:
                        yield passages_of(held)
                        held, waiting = [], 0
                    yield counts()
                    cutter.restart()
        if held:
            yield passages_of(held)
        yield counts()
        there = np.flatnonzero(times)
        yield batch_of(len(there), id=there, n=times[there])

    return train.mapInArrow(run, "word binary, n long, passage binary, id int")


def frequent_words(words: DataFrame) -> pa.Table:
    """(word, c) of the most frequent words: all whose count lies above a bound that leaves at most ``MAX_FREQUENT``."""
    short = words.where(F.octet_length("word") <= MAX_WORD).withColumn("bin", F.floor(F.log2("c") * 8).cast("int"))
    room, bound = MAX_FREQUENT, None
    for row in sorted(short.groupBy("bin").count().collect(), key=lambda r: -r.bin):  # 512 bins at most
        if (room := room - row["count"]) < 0:
            break
        bound = row.bin
    return short.where(F.lit(bound is not None) & (F.col("bin") >= (bound or 0))).select("word", "c").toArrow()


# ---- ids


class Subwords:
    """Ids of words, each cut by itself; a bounded memory of those cut before. A text's end has the id after the last."""

    def __init__(self, vocabulary: list[bytes]):
        import tiktoken

        self.end = len(vocabulary)
        self.encoding = tiktoken.Encoding("own", pat_str=WHOLE, mergeable_ranks={piece: i for i, piece in enumerate(vocabulary)}, special_tokens={})
        self.cut = self.encoding._core_bpe.encode_single_piece  # a word is one unit, so no splitter is needed
        self.known: dict[bytes, list[int]] = {}

    def ids(self, word: bytes) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = [self.end] if word == END else self.cut(b" " + word)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = found
        return found


def subwords(shared: dict) -> Subwords:
    """The worker's own, made once and kept with the broadcast value."""
    if "subwords" not in shared:
        shared["subwords"] = Subwords(shared["vocabulary"])
    return shared["subwords"]


def id_counts(counts: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How often each id occurs in all training texts, from the tasks' counts."""
    table = counts.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row an id of the vocabulary
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    out[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return out


class Inventory:
    """Which ids the model knows, their classes, and the share of each other id among the others."""

    def __init__(self, counts: np.ndarray, vocabulary: list[bytes]):
        end = len(vocabulary)
        order = np.lexsort((np.arange(len(counts)), -counts))
        chosen = [int(i) for i in order[: MODEL_IDS + 1] if i != end][: MODEL_IDS - 1]
        # neighbours in the alphabet share a class, words' first pieces apart from later ones
        chosen = sorted(chosen, key=lambda i: (vocabulary[i][:1] != b" ", vocabulary[i]))
        self.other, self.pad = MODEL_IDS, MODEL_IDS + 1
        self.place = np.full(len(counts), self.other, dtype=np.int32)
        self.place[[*chosen, end]] = np.arange(MODEL_IDS)
        self.end = MODEL_IDS - 1
        rest = self.place == self.other
        self.share = np.where(rest, np.log((counts + 1.0) / (counts[rest] + 1.0).sum()), 0.0)
        self.members = math.ceil((MODEL_IDS + 1) / CLASSES)
        known = np.zeros(CLASSES * self.members)
        np.add.at(known, self.place, counts + 1.0)
        self.prior = known.reshape(CLASSES, self.members)


# ---- the model


def shapes(members: int) -> dict[str, tuple[int, ...]]:
    n = MODEL_IDS + 2
    return {"q": (n, DIM), "k": (n, DIM), "v": (n, DIM), "own": (n, DIM), "distance": (WIDTH,), "cls": (DIM, CLASSES), "cls_bias": (CLASSES,), "out": (CLASSES, DIM, members), "out_bias": (CLASSES, members)}


def views(flat: np.ndarray, members: int) -> dict[str, np.ndarray]:
    """The weights by name, as views of one array."""
    out, at = {}, 0
    for name, shape in shapes(members).items():
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(inventory: Inventory) -> np.ndarray:
    """Small weights from a fixed seed; biases that start from the ids' frequencies."""
    rng = np.random.default_rng(11)
    members = inventory.members
    flat = (rng.standard_normal(sum(math.prod(s) for s in shapes(members).values())) * 0.1).astype(np.float32)
    w, prior = views(flat, members), inventory.prior
    w["distance"][:] = 0.0
    w["cls_bias"][:] = np.log(np.maximum(prior.sum(axis=1), 1e-6) / prior.sum())
    with np.errstate(divide="ignore"):
        w["out_bias"][:] = np.maximum(np.log(prior / np.maximum(prior.sum(axis=1, keepdims=True), 1e-6)), -30.0)
    return flat


#: Places later than the one that asks, and how far back the others are.
_BACK = np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :]
#: Exponents below this bound need no care.
SAFE = 60.0


def ready(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights as products take them: q scaled, v with a one at its end, biases as one more row of their weights."""
    v, back = w["v"], np.maximum(_BACK, 0)
    return {
        "q": w["q"] * np.float32(1 / math.sqrt(DIM)), "k": w["k"], "v": np.concatenate([v, np.ones((len(v), 1), dtype=v.dtype)], axis=1), "own": w["own"],
        "distance": np.where(_BACK >= 0, w["distance"][back], -1e9).astype(v.dtype),
        "cls": np.concatenate([w["cls"], w["cls_bias"][None]]), "out": np.concatenate([w["out"], w["out_bias"][:, None]], axis=1),
    }


def attend(t: dict[str, np.ndarray], x: np.ndarray, first: int, pad: int, safe: bool, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """Puts into ``out`` the hidden states of places from ``first`` on of windows x, each with a one after it; gives what the way back needs.

    t: from ``ready``. ``safe``: the weights are known to give small exponents. That is the attention (not divided by
    what it adds up to), one over that sum, q, k, v and what the attention brings.
    """
    asking = x[:, first:]
    q, k, v = t["q"].take(asking, 0), t["k"].take(x, 0), t["v"].take(x, 0)
    s = q @ k.transpose(0, 2, 1)
    s += t["distance"][first : x.shape[1], : x.shape[1]]
    padded = x[:, 0] == pad
    if padded.any():
        s[padded] += np.where(x[padded] == pad, np.float32(-1e9), np.float32(0))[:, None, :]
    if not safe:
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    seen = s @ v
    part = 1 / (seen[..., DIM:] + np.float32(1e-30))
    seen = seen[..., :DIM] * part
    z = t["own"].take(asking, 0)
    z += seen
    size = np.abs(z)
    size += 1
    np.divide(z, size, out=out[..., :DIM])
    out[..., DIM] = 1
    return s, part, q, k, v, seen


def _log_sums(logits: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums of exponentials of each row, their logarithms); the rows become those exponentials, with ``safe`` off over that of the largest."""
    top = None
    if not safe:
        top = logits.max(axis=1)
        logits -= top[:, None]
    total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], dtype=logits.dtype)
    return total, np.log(total) if safe else np.log(total) + top


#: Rows added to each other before their sums go by id.
TOGETHER = 4


def sums_by_id(ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids that occur, sums of their rows of even length). The last of the rows is zero and no id's: each id's rows are filled
    up with it to blocks of ``TOGETHER``, which whole-array sums add up; only the blocks' sums go one by one, as pairs."""
    times = np.bincount(ids, minlength=n)
    there = np.flatnonzero(times)
    times = times[there]
    blocks = -(-times // TOGETHER)
    starts = np.cumsum(blocks) - blocks
    index = np.full(int(blocks.sum()) * TOGETHER, len(ids))
    index[_laid_out(starts * TOGETHER, times)] = np.argsort(ids, kind="stable")
    index = index.reshape(-1, TOGETHER)
    wide = rows.take(index[:, 0], 0)
    for i in range(1, TOGETHER):
        wide += rows.take(index[:, i], 0)
    pairs = wide.view(np.result_type(wide, np.complex64))
    return there, np.add.reduceat(pairs, starts, axis=0).view(wide.dtype)


def small(w: dict[str, np.ndarray]) -> bool:
    """Whether no exponent that these weights can give comes near what single precision holds."""
    norm = lambda x: math.sqrt(np.einsum("nd,nd->n", x, x).max())
    bounds = (
        norm(w["q"]) * norm(w["k"]) / math.sqrt(DIM) + float(np.abs(w["distance"]).max()),
        float(np.abs(w["cls"]).sum(axis=0).max() + np.abs(w["cls_bias"]).max()),
        float((np.abs(w["out"]).sum(axis=1) + np.abs(w["out_bias"])).max()),
    )
    return max(bounds) < SAFE


def log_probabilities(w: dict[str, np.ndarray], windows: np.ndarray, members: int, pad: int, safe: bool = False) -> np.ndarray:
    """Natural log probabilities of the ids after the second half of each window (n, WIDTH + 1); 0 where the id is a pad."""
    t, h = ready(w), np.empty((len(windows), STRIDE, DIM + 1), dtype=w["own"].dtype)
    for low in range(0, len(windows), BATCH):
        attend(t, windows[low : low + BATCH, :WIDTH], WIDTH - STRIDE, pad, safe, h[low : low + BATCH])
    y = windows[:, WIDTH - STRIDE + 1 :].reshape(-1).astype(np.uint16)
    order = np.argsort(y, kind="stable")
    order = order[: np.searchsorted(y[order], pad)]  # a pad is the last place
    h, found = h.reshape(-1, DIM + 1), np.empty(len(order))
    for part, rows, cls, own, of_class in _by_class(h, y, order, members):
        logits = rows @ t["cls"]
        chosen = logits.reshape(-1).take(cls)
        chosen -= _log_sums(logits, safe)[1]
        logits = np.empty((len(rows), members), dtype=h.dtype)
        for c, some in of_class:
            np.matmul(rows[some], t["out"][c], out=logits[some])
        chosen += logits.reshape(-1).take(own)
        chosen -= _log_sums(logits, safe)[1]
        found[part] = chosen
    out = np.zeros(len(windows) * STRIDE)
    out[order] = found
    return out.reshape(len(windows), STRIDE)


def _by_class(h: np.ndarray, y: np.ndarray, order: np.ndarray, members: int) -> Iterator[tuple]:
    """Blocks of rows of h in an order that sorts y: (slice of the order, rows, where each row's class and member are
    in its logits laid end to end, [(class, its slice of the block)]). A block and its logits stay in a core's cache."""
    for low in range(0, len(order), ROWS):
        part = slice(low, low + ROWS)
        own = order[part]
        cls, member = np.divmod(y.take(own).astype(np.int64), members)
        at, edges = np.arange(len(own)), np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        yield part, h.take(own, 0), at * CLASSES + cls, at * members + member, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def gradient(w: dict[str, np.ndarray], windows: np.ndarray, members: int, pad: int) -> tuple[float, np.ndarray]:
    """(mean loss, gradient of it) over all places of windows (n, WIDTH + 1)."""
    x, y = windows[:, :WIDTH], windows[:, 1:]
    t, safe, kind = ready(w), small(w), w["own"].dtype
    # attention goes in slices that stay in a core's cache
    slices = [slice(low, low + ATTEND) for low in range(0, len(x), ATTEND)]
    h = np.empty((*x.shape, DIM + 1), dtype=kind)
    found = [attend(t, x[part], 0, pad, safe, h[part]) for part in slices]
    flat = np.zeros(sum(p.size for p in w.values()), dtype=np.float32)
    g = views(flat, members)
    real = (y != pad).reshape(-1)
    weight = (real / max(1, real.sum())).astype(np.float32)
    target = np.where(real, y.reshape(-1), 0).astype(np.uint16)
    order, loss = np.argsort(target, kind="stable"), 0.0
    of_class, of_member = np.zeros((CLASSES, DIM + 1), dtype=kind), np.zeros((CLASSES, members, DIM + 1), dtype=kind)
    each = np.empty((len(order) + 1, 4 * DIM), dtype=kind)
    each[-1] = 0

    def less(logits: np.ndarray, own: np.ndarray, share: np.ndarray) -> float:
        """The loss; the logits become its gradient by them."""
        flat = logits.reshape(-1)
        chosen = flat.take(own)
        total, logs = _log_sums(logits, safe)
        logits *= (share / total)[:, None]
        flat[own] -= share
        return (logs - chosen) @ share

    for part, rows, cls, own, there in _by_class(h.reshape(-1, DIM + 1), target, order, members):
        share = weight.take(order[part])
        logits = rows @ t["cls"]
        loss += less(logits, cls, share)
        of_class += logits.T @ rows
        dh = logits @ w["cls"].T
        logits = np.empty((len(rows), members), dtype=kind)
        for c, some in there:
            np.matmul(rows[some], t["out"][c], out=logits[some])
        loss += less(logits, own, share)
        for c, some in there:
            of_member[c] += logits[some].T @ rows[some]
            dh[some] += logits[some] @ w["out"][c].T
        left = 1 - np.abs(rows[:, :DIM])
        dh *= left
        dh *= left
        each[order[part], 3 * DIM :] = dh
    g["cls"][:], g["cls_bias"][:] = of_class[:, :DIM].T, of_class[:, DIM]
    g["out"][:], g["out_bias"][:] = of_member[..., :DIM].transpose(0, 2, 1), of_member[..., DIM]
    by_window, near = each[:-1].reshape(*x.shape, 4 * DIM), np.zeros((WIDTH, WIDTH), dtype=kind)
    for part, (s, inverse, q, k, v, seen) in zip(slices, found, strict=True):
        to, d = by_window[part], np.empty_like(v)
        np.multiply(to[..., 3 * DIM :], inverse, out=d[..., :DIM])
        d[..., DIM] = -np.einsum("wpd,wpd->wp", d[..., :DIM], seen)
        ds = d @ v.transpose(0, 2, 1)
        ds *= s
        near += ds.sum(axis=0)
        np.matmul(ds, k, out=to[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=to[..., DIM : 2 * DIM])
        np.matmul(s.transpose(0, 2, 1), d[..., :DIM], out=to[..., 2 * DIM : 3 * DIM])
    np.add.at(g["distance"], np.maximum(_BACK, 0)[_BACK >= 0], near[_BACK >= 0])
    there, sums = sums_by_id(x.reshape(-1).astype(np.uint16), each, len(w["own"]))
    sums[:, :DIM] *= np.float32(1 / math.sqrt(DIM))
    for name, part in zip(("q", "k", "v", "own"), np.split(sums, 4, axis=1), strict=True):
        g[name][there] = part
    return float(loss), flat


def trained(flat: np.ndarray, windows: np.ndarray, members: int, pad: int, seed: int) -> np.ndarray:
    """The weights after ``EPOCHS`` passes of Adam over the windows."""
    flat, rng, step = flat.copy(), np.random.default_rng(seed), min(STEP, max(SMALL_STEP, len(windows) // STEPS))
    w, mean, square, move, steps = views(flat, members), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), step):
            _, grad = gradient(w, windows[order[low : low + step]], members, pad)
            steps += 1
            np.multiply(grad, grad, out=move)
            move *= np.float32(0.01)
            square *= np.float32(0.99)
            square += move
            grad *= np.float32(0.1)
            mean *= np.float32(0.9)
            mean += grad
            # both are too small in the first steps; that goes into the rate
            first, second = 1 - 0.9**steps, math.sqrt(1 - 0.99**steps)
            np.sqrt(square, out=move)
            move += np.float32(1e-6 * second)
            np.divide(mean, move, out=move)
            move *= np.float32(RATE * second / first)
            flat -= move
    return flat


_WINDOW = np.arange(WIDTH + 1)


def training_windows(passages: DataFrame, shared) -> DataFrame:
    """(round, n, ids): windows of the passages as packed 16-bit ids, some hundred to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, found, n = 0, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([turn % ROUNDS], pa.int32()), pa.array([n], pa.int64()), pa.array([np.concatenate(found).astype(np.uint16).tobytes()], pa.binary())], ["round", "n", "ids"])

        for batch in batches:
            place, pad, kind = shared.value["place"], shared.value["pad"], _id_type(shared.value["vocabulary"])
            for passage in batch.column("passage").to_pylist():
                # the first id was predicted at the end of the passage before
                ids = place[np.frombuffer(passage, kind)]
                ids = np.concatenate([ids, np.full(-(len(ids) - 1) % WIDTH, pad, dtype=place.dtype)])
                found.append(ids.take(_WINDOW + np.arange(0, len(ids) - 1, WIDTH)[:, None]))
                n += len(found[-1])
                if n >= 512:
                    yield packed()
                    turn, found, n = turn + 1, [], 0
        if n:
            yield packed()

    return passages.mapInArrow(run, "round int, n long, ids binary")


def learn_weights(windows: DataFrame, inventory: Inventory) -> np.ndarray:
    """Rounds of training: shards of the windows side by side from the same weights, then their average by numbers of windows."""
    spark, members, pad = windows.sparkSession, inventory.members, inventory.pad
    flat = initial(inventory)
    for turn in range(ROUNDS):
        mine = windows.where(F.col("round") == turn)
        n = mine.agg(F.sum("n").alias("n")).first().n
        if not n:
            continue
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(x, np.uint16).reshape(-1, WIDTH + 1).astype(np.int32) for b in batches for x in b.column("ids").to_pylist()]
            if parts:
                whole = np.concatenate(parts)
                found = trained(start.value, whole, members, pad, turn) * np.float32(len(whole))
                chunks = [found[i : i + CHUNK] for i in range(0, len(found), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.list_(pa.float32())), pa.array([len(whole)] * len(chunks), pa.int64())], ["chunk", "w", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                for chunk, values, n in zip(b.column("chunk").to_pylist(), b.column("w"), b.column("n").to_pylist(), strict=True):
                    at = total.setdefault(chunk, [0.0, 0])
                    at[0], at[1] = at[0] + values.values.to_numpy().astype(np.float64), at[1] + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s / n for s, n in total.values()], pa.list_(pa.float64()))], ["chunk", "w"])

        shards = max(1, round(n * WIDTH * ROUNDS / SHARD_IDS))
        averaged = mine.repartition(shards).mapInArrow(run, "chunk int, w array<float>, n long").repartition("chunk").mapInArrow(add, "chunk int, w array<double>").toArrow()
        order = np.argsort(averaged.column("chunk").to_numpy())
        values = averaged.column("w").to_pylist()
        flat = np.concatenate([np.asarray(values[i], dtype=np.float32) for i in order])
        start.unpersist()
    return flat


# ---- scoring


class Lexicon:
    """The frequent words with the logarithm of their count plus one and their ids, laid end to end."""

    def __init__(self, shared: dict):
        self.words = {w: i for i, w in enumerate(shared["words"])}
        self.logs, self.ids, self.starts, self.lengths = (shared[c] for c in ("logs", "ids", "starts", "lengths"))


def _laid_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Scorer:
    """Scores texts that come in pieces; holds some groups of words, never a whole long text."""

    def __init__(self, shared: dict):
        if "lexicon" not in shared:
            shared["lexicon"], shared["weights"] = Lexicon(shared), views(shared["flat"], shared["members"])
            shared["safe"] = small(shared["weights"])
        self.shared, self.lexicon, self.weights, self.cut = shared, shared["lexicon"], shared["weights"], subwords(shared)
        self.segments: list[tuple[int, int, bool]] = []  # row, number of words, whether they end the text
        self.index: list[np.ndarray] = []
        self.extra: list[list[int]] = []
        self.waiting = 0
        self.rest: dict[int, np.ndarray] = {}
        self.totals: dict[int, list] = {}  # words, known words, sum of logarithms, log probability
        self.pairs: tuple[list[int], list[bytes], list[int]] = [], [], []  # row, rare word, how often

    def add(self, row: int, words: list[bytes], last: bool) -> None:
        known, total = self.lexicon.words, self.totals.setdefault(row, [0, 0, 0.0, 0.0])
        index = np.fromiter(map(known.get, words, [-1] * len(words)), np.int64, len(words))
        rare = np.flatnonzero(index < 0)
        if len(rare):
            own = [words[i] for i in rare.tolist()]
            times = Counter(own)
            for column, more in zip(self.pairs, (repeat(row, len(times)), times, times.values()), strict=True):
                column.extend(more)
            index[rare] = -1 - np.arange(len(self.extra), len(self.extra) + len(own))
            self.extra += map(self.cut.ids, own)
        total[0] += len(words)
        total[1] += len(words) - len(rare)
        total[2] += float(self.lexicon.logs[index[index >= 0] if len(rare) else index].sum())
        self.segments.append((row, len(words), last))
        self.index.append(index)
        self.waiting += len(words) + 1
        if self.waiting >= GROUP_WORDS:
            self.flush()

    def flush(self) -> None:
        """Scores what waits."""
        if not self.segments:
            return
        s, lex = self.shared, self.lexicon
        index = np.concatenate(self.index)
        rare = index < 0
        more = np.fromiter(map(len, self.extra), np.int64, len(self.extra))
        starts, lengths = lex.starts[np.where(rare, 0, index)] if len(lex.starts) else np.zeros(len(index), np.int64), lex.lengths[np.where(rare, 0, index)] if len(lex.starts) else np.zeros(len(index), np.int64)
        at = -1 - index[rare]
        starts[rare], lengths[rare] = len(lex.ids) + (np.cumsum(more) - more)[at], more[at]
        pool = np.concatenate([lex.ids, np.fromiter((i for x in self.extra for i in x), lex.ids.dtype, int(more.sum()))])
        ids = pool[_laid_out(starts, lengths)]
        places, shares = s["place"][ids], np.concatenate([[0.0], np.cumsum(s["share"][ids])])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *(n for _, n, _ in self.segments)])]
        windows, owners = [], []
        for (row, _, last), a, b in zip(self.segments, ends[:-1], ends[1:], strict=True):
            rest = self.rest.pop(row, None)
            if rest is None:
                rest = np.array([s["pad"]] * (WIDTH - STRIDE) + [s["end"]], dtype=places.dtype)
            whole = np.concatenate([rest, places[a:b], [s["end"]] if last else []]).astype(places.dtype)
            if last:
                whole = np.concatenate([whole, np.full(-(len(whole) - (WIDTH - STRIDE) - 1) % STRIDE, s["pad"], dtype=places.dtype)])
            n = max(0, (len(whole) - (WIDTH - STRIDE) - 1) // STRIDE)
            if n:
                windows.append(whole.take(_WINDOW + np.arange(0, n * STRIDE, STRIDE)[:, None]))
                owners += [row] * n
            if not last:
                self.rest[row] = whole[n * STRIDE :]
            self.totals[row][3] += shares[b] - shares[a]
        if windows:
            found = log_probabilities(self.weights, np.concatenate(windows), s["members"], s["pad"], s["safe"]).sum(axis=1)
            rows, at = np.unique(owners, return_inverse=True)
            for row, x in zip(rows.tolist(), np.bincount(at, found).tolist(), strict=True):
                self.totals[row][3] += x
        self.segments, self.index, self.extra, self.waiting = [], [], [], 0


def scored(docs: DataFrame, shared) -> DataFrame:
    """A row per document (word null) with all but its rare words' part of the base score, and rows (rid, word, n) of those words."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    schema = "rid long, doc_id long, n_tokens long, n_known long, logs double, score double, word binary, n long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scorer, rids, doc_ids = Scorer(shared.value), batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()

            def pairs(scorer=scorer, rids=batch.column("rid")) -> pa.RecordBatch:
                (rows, words, times), scorer.pairs = scorer.pairs, ([], [], [])
                return pa.RecordBatch.from_arrays([rids.take(pa.array(rows, pa.int64())), *(pa.nulls(len(rows), t) for t in kinds[1:6]), pa.array(words, pa.binary()), pa.array(times, pa.int64())], names)

            for row, raw in enumerate(batch.column("raw")):
                text = raw.as_py()
                short = len(text) <= PIECE
                for words in pieces(text):
                    scorer.add(row, words, short)
                    if len(scorer.pairs[0]) >= 50_000:
                        yield pairs()
                if not short:
                    scorer.add(row, [], True)
            scorer.flush()
            if scorer.pairs[0]:
                yield pairs()
            end_known, end_log = shared.value["end_count"] > 0, math.log10(shared.value["end_count"] + 1)
            totals = [scorer.totals[r] for r in range(len(rids))]
            columns = [rids, doc_ids, [t[0] + 1 for t in totals], [t[1] + end_known for t in totals], [t[2] + end_log for t in totals], [t[3] / math.log(10) for t in totals], [None] * len(rids), [None] * len(rids)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def score_texts(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents (doc_id, text).

    Null text is empty and has one token, its end. A row without a doc_id is trained on; rows that
    repeat an id are scored each by its own text. Without any row to train on, counts are 0 and
    the model is as it starts. An empty table gives an empty one. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc, vocabulary = docs.sparkSession.sparkContext, read_vocabulary(vocabulary_path)
    gathered = scratch(counted(docs, vocabulary_path), "gathered")
    words = scratch(gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    inventory = Inventory(id_counts(gathered.where("id is not null").select("id", "n"), vocabulary), vocabulary)
    model_ids = {"vocabulary": vocabulary, "place": inventory.place, "pad": inventory.pad}
    windows = scratch(training_windows(gathered.where("passage is not null").select("passage"), sc.broadcast(model_ids)), "windows")
    flat = learn_weights(windows, inventory)
    frequent = frequent_words(words)
    cut, listed = Subwords(vocabulary), frequent.column("word").to_pylist()
    found = [cut.ids(w) for w in listed]
    lengths = np.array([len(x) for x in found], dtype=np.int64)
    shared = sc.broadcast(model_ids | {
        "flat": flat, "members": inventory.members, "end": inventory.end, "share": inventory.share, "end_count": sums.ends, "words": listed, "logs": np.log10(frequent.column("c").to_numpy() + 1.0),
        "ids": np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum())), "starts": np.cumsum(lengths) - lengths, "lengths": lengths,
    })
    rows = scratch(scored(docs, shared), "scored")
    discard(gathered, windows)
    rare = rows.where("word is not null").join(words, "word").groupBy("rid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = rows.where("word is null").drop("word", "n").join(rare, "rid", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(sums.n + sums.v + 1)
    return out.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(sums.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op11_lm_scoring(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
