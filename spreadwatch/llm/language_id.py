"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (byte pieces of a
published BPE, read from a file whose path is a parameter). The probability of a word is the sum
over all ways to cut it into pieces, computed by the forward algorithm; a text scores the sum of
its words' log probabilities, and the language with the highest score wins. No piece or word is
too long: words go whole, however many bytes they have.

Learning takes a bounded sample of labelled rows and counts its words per language. Piece counts
start from the vocabulary's own segmentation, and a few forward-backward passes replace them by
their expectation over all segmentations; each pass sends one row per (language, piece) and task,
and the driver holds languages x vocabulary sums. Scoring is one pass over whole texts without any
shuffle; equal words are scored once per worker while its bounded cache lasts.
"""

from __future__ import annotations

import base64
import copy
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadwatch.llm.common import discard, scratch, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: About how many labelled rows of each language are learned from.
SAMPLE_PER_LANGUAGE = 3000
MAX_LANGUAGES = 512
#: Forward-backward passes over the sample.
PASSES = 2
#: Words of more bytes are first cut where no piece can cross, and what is still longer goes by logarithms.
LONG = 64
#: Distinct words of the sample that a task takes.
TASK_WORDS = 40_000
#: Words a worker remembers.
CACHE_WORDS = 200_000
#: Words looked up together.
GROUP_WORDS = 100_000
#: Words of one length that go through the forward algorithm together.
FORWARD_WORDS = 8192
#: Each byte's probability is scaled up by this, so that products of small numbers stay in range.
SCALE = 512.0
UNKNOWN = "und"


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a ranks file (base64 piece, space, rank), in the order of the ranks."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    return [base64.b64decode(piece) for piece, _ in sorted(rows, key=lambda x: int(x[1]))]


def words(text: str) -> list[bytes]:
    """The text's words in lower case, each with a space before it."""
    return [b" " + word.encode("utf-8", "replace") for word in text.lower().split()]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Forward:
    """Log probabilities of words under every language, summed over all segmentations.

    The pieces form a trie, held as a sorted array of 64-bit keys of all their prefixes. Many
    words of one length go through the forward algorithm together: from each place the trie is
    walked to the right, and a word leaves the walk when no piece goes on from there.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes], probabilities: np.ndarray):
        """probabilities: one row a piece, one column a language."""
        rows: dict[bytes, int] = {}
        for i, piece in enumerate(pieces):
            if piece:
                for n in range(1, len(piece)):
                    rows.setdefault(piece[:n], -1)
                rows[piece] = i
        prefixes = list(rows)
        keys = np.zeros(len(prefixes), dtype=np.uint64)
        at = np.array([rows[p] for p in prefixes])
        lengths = np.array([len(p) for p in prefixes])
        self.longest = int(lengths.max())
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join(prefixes[i] for i in own), np.uint8).reshape(len(own), n)
            key = np.zeros(len(own), dtype=np.uint64)
            for j in range(n):
                key = self._extend(key, data[:, j])
            keys[own] = key
        order = np.argsort(keys)
        self.keys, self.piece, self.probabilities = keys[order], at[order], probabilities
        scaled = probabilities[at] * SCALE ** lengths[:, None].astype(float) * (at >= 0)[:, None]
        self.values = scaled[order]

    def of_language(self, k: int) -> Forward:
        """The same trie with the probabilities of one language."""
        own = copy.copy(self)
        own.probabilities, own.values = self.probabilities[:, k : k + 1], np.ascontiguousarray(self.values[:, k : k + 1])
        return own

    def _extend(self, key: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = (key + byte.astype(np.uint64) + np.uint64(1)) * self.BASE
        return key ^ (key >> np.uint64(29))

    def _walk(self, data: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, words, rows of the trie) of what goes on from a place in words of one length."""
        active = np.arange(len(data))
        key = np.zeros(len(data), dtype=np.uint64)
        for end in range(start + 1, min(data.shape[1], start + self.longest) + 1):
            key = self._extend(key, data[active, end - 1])
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            active, key, at = active[hit], key[hit], at[hit]
            if not len(active):
                return
            yield end, active, at

    def matches(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces) of every piece anywhere in a word, in order of their ends."""
        data, found = np.frombuffer(word, np.uint8), []
        active, key = np.arange(len(data)), np.zeros(len(data), dtype=np.uint64)
        for size in range(1, self.longest + 1):
            inside = active + size <= len(data)
            active, key = active[inside], key[inside]
            key = self._extend(key, data[active + size - 1])
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            active, key, at = active[hit], key[hit], self.piece[at[hit]]
            if not len(active):
                break
            found.append((active[at >= 0], active[at >= 0] + size, at[at >= 0]))
        starts, ends, pieces = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
        order = np.lexsort((starts, ends))
        return starts[order], ends[order], pieces[order]

    def stretches(self, word: bytes) -> list[bytes]:
        """A long word cut wherever no piece crosses: the product of the parts' sums is the word's sum."""
        if len(word) <= LONG:
            return [word]
        starts, ends, _ = self.matches(word)
        reach = np.zeros(len(word), dtype=np.int64)
        np.maximum.at(reach, starts, ends)
        reach = np.maximum.accumulate(reach)
        edges = [0, *(np.flatnonzero(reach[:-1] <= np.arange(1, len(word))) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _log_sums(self, word: bytes) -> tuple[np.ndarray, tuple]:
        """Log forward sums at each place of a word of any length, and its matches."""
        found = self.matches(word)
        with np.errstate(divide="ignore"):
            logs = np.log(self.probabilities[found[2]])
        sums = np.full((len(word) + 1, logs.shape[1]), -np.inf)
        sums[0] = 0.0
        for start, end, value in zip(found[0].tolist(), found[1].tolist(), logs, strict=True):
            sums[end] = np.logaddexp(sums[end], sums[start] + value)
        return sums, (*found, logs)

    def _alike(self, found: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Short words of one length: their places, and their bytes in rows."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(found):
            if len(word) <= LONG:
                by_length.setdefault(len(word), []).append(i)
        for n, rows in by_length.items():
            for a in range(0, len(rows), FORWARD_WORDS):
                part = rows[a : a + FORWARD_WORDS]
                yield part, np.frombuffer(b"".join(found[i] for i in part), np.uint8).reshape(len(part), n)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        """Scaled forward sums at each place of words of one length."""
        alpha = np.zeros((data.shape[1] + 1, len(data), self.values.shape[1]))
        alpha[0] = 1.0
        for start in range(data.shape[1]):
            for end, active, at in self._walk(data, start):
                alpha[end, active] += alpha[start, active] * self.values[at]
        return alpha

    def log_probabilities(self, found: list[bytes]) -> np.ndarray:
        out = np.empty((len(found), self.values.shape[1]))
        for i, word in enumerate(found):
            if len(word) > LONG:
                out[i] = self._log_sums(word)[0][-1]
        for part, data in self._alike(found):
            with np.errstate(divide="ignore"):
                out[part] = np.log(self._sums(data)[-1]) - data.shape[1] * np.log(SCALE)
        return out

    def expected_counts(self, found: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that occur so many times: one row a piece, one column a language."""
        out = np.zeros_like(self.probabilities)
        for i, word in enumerate(found):
            if len(word) > LONG:
                sums, (starts, ends, pieces, logs) = self._log_sums(word)
                after = np.full_like(sums, -np.inf)
                after[-1] = 0.0
                for k in range(len(starts) - 1, -1, -1):  # ends fall, and a piece's end is done before any piece that starts there is
                    after[starts[k]] = np.logaddexp(after[starts[k]], logs[k] + after[ends[k]])
                np.add.at(out, pieces, times[i] * np.exp(sums[starts] + logs + after[ends] - sums[-1]))
        for part, data in self._alike(found):
            alpha = self._sums(data)
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            weight = times[part][:, None] / alpha[-1]
            for start in range(data.shape[1] - 1, -1, -1):
                for end, active, at in self._walk(data, start):
                    gone_on = self.values[at] * beta[end, active]
                    beta[start, active] += gone_on
                    real = self.piece[at] >= 0
                    np.add.at(out, self.piece[at][real], (alpha[start, active] * gone_on * weight[active])[real])
        return out


class Scorer:
    """Scores texts; remembers the words of earlier texts up to a bound."""

    def __init__(self, langs: list[str], pieces: list[bytes], probabilities: np.ndarray):
        import regex

        self.langs, self.forward = langs, Forward(pieces, probabilities)
        self.letter = regex.compile(r"\p{L}")
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1 << 16, len(self.langs)))

    def _rows(self, found: list[bytes]) -> np.ndarray:
        new = list(set(found).difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS and self.known:
            self._reset()
            new = list(set(found))
        n = len(self.known)
        while n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            self.table[n : n + len(new)] = self.forward.log_probabilities(new)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Per text (language, share of the winner when the mean word is weighed against all languages).

        Texts are taken together until they have GROUP_WORDS words, and a longer text in parts, so
        that new words are scored many at a time and memory stays bounded.
        """
        totals = np.zeros((len(texts), len(self.langs)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        found: list[bytes] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if found:
                table = self.table_of(found)
                starts = np.cumsum([0] + [n for _, n in owners[:-1]])
                np.add.at(totals, [i for i, _ in owners], np.add.reduceat(table, starts, axis=0))
                found.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if text is None or not self.langs or not self.letter.search(text):
                continue
            own = words(text)
            sizes[i] = len(own)
            if max(map(len, own)) > LONG:
                own = [part for word in own for part in self.forward.stretches(word)]
            for a in range(0, len(own), GROUP_WORDS):
                part = own[a : a + GROUP_WORDS]
                found += part
                owners.append((i, len(part)))
                if len(found) >= GROUP_WORDS:
                    flush()
        flush()
        out = []
        for total, n in zip(totals, sizes, strict=True):
            if not n:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp((total - total[best]) / n).sum())))
        return out

    def table_of(self, found: list[bytes]) -> np.ndarray:
        rows = self._rows(found)  # may replace the table
        return self.table[rows]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counts.setdefault(lang, Counter()).update(words(text.as_py()))
    for lang, found in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to TASK_WORDS rows: many words at a time are cheaper."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TASK_WORDS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _count_pieces(path: str, model):
    """Pieces of (lang, word, n): of the vocabulary's own segmentation, or expected under the model so far."""

    def segmented(pieces: list[bytes]):
        import tiktoken

        encoding = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})

        def count(lang: str, found: list[bytes], times: np.ndarray) -> np.ndarray:
            cut = [encoding._encode_bytes(word) for word in found]
            return np.bincount(np.concatenate(cut), np.repeat(times, list(map(len, cut))), len(pieces))

        return count

    def expected(pieces: list[bytes]):
        langs, probabilities = model.value
        whole = Forward(pieces, probabilities)

        def count(lang: str, found: list[bytes], times: np.ndarray) -> np.ndarray:
            cut = [whole.stretches(word) for word in found]
            times = np.repeat(times, list(map(len, cut)))
            return whole.of_language(langs.index(lang)).expected_counts([part for own in cut for part in own], times)[:, 0]

        return count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read_vocabulary(path)
        count, sums = (segmented if model is None else expected)(pieces), {}
        for batch in _joined(batches):
            langs, found, times = batch.column("lang").to_numpy(), batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
            for lang in set(langs):
                own = np.flatnonzero(langs == lang)
                sums[lang] = sums.get(lang, 0.0) + count(lang, [found[i] for i in own], times[own])
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["lang", "piece", "n"])

    return run


def learn(docs: DataFrame, path: str = VOCABULARY, per_language: int = SAMPLE_PER_LANGUAGE, passes: int = PASSES) -> tuple[list[str], np.ndarray]:
    """(languages in order, piece probabilities) from ``docs`` (doc_id, text, lang), null lang left out.

    Of each language about ``per_language`` rows are used, picked by a hash of doc_id; all, if it
    has fewer. The driver gets counts per language and at most languages x vocabulary sums; more
    than MAX_LANGUAGES languages are refused. Rows that repeat a doc_id are taken or left together,
    null and blank texts have no words, an empty table teaches nothing.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    pieces = read_vocabulary(path)
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / sizes[lang]))]), F.col("lang"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = labelled.where(place < share).select("lang", "text")
    found = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = scratch(found, "sample-words")  # what the bounded sample holds
    n_tasks = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + found.count() // TASK_WORDS)
    model, probabilities = None, None
    for _ in range(1 + passes):
        if probabilities is not None:
            model = docs.sparkSession.sparkContext.broadcast((langs, probabilities))  # languages x vocabulary
        counts = found.repartition(n_tasks).mapInArrow(_count_pieces(path, model), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.full((len(pieces), len(langs)), 0.5)
        table[counts["piece"].to_numpy(), counts["lang"].map(langs.index).to_numpy(dtype=np.int64)] += counts["n"].to_numpy()
        probabilities = table / table.sum(axis=0)
    discard(found)
    return langs, probabilities


def identify(docs: DataFrame, langs: list[str], probabilities: np.ndarray, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text of ``docs`` (doc_id, text).

    'und' with score 0 where text is null or has no letter, or nothing was learned. Equal scores go
    to the language first in the alphabet. Null and repeated ids pass through, an empty table gives
    an empty one, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((langs, probabilities))  # languages x vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value[0], read_vocabulary(path), model.value[1])
        for batch in batches:
            found = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def best_score(docs: DataFrame, langs: list[str], probabilities: np.ndarray, path: str = VOCABULARY) -> Callable[[Column], Column]:
    """A function from a column of texts to the score that ``identify`` gives: 0 where no language fits."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((langs, probabilities))  # languages x vocabulary

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value[0], read_vocabulary(path), model.value[1])
        for texts in batches:
            yield pd.Series([found[1] for found in scorer.score([None if t is None else str(t) for t in texts])], dtype=float)

    return score


def op6_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, probabilities = learn(docs.where(~is_held_out(F.col("doc_id"))))
    return identify(docs, langs, probabilities).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
