"""Abusive, hateful or sexual content: noisy-channel restoring of disguised words, then a window score."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.abuse_seeds import ABUSIVE, HARMLESS, LOOKALIKES, SUBSTITUTES

#: Labelled documents used for training at most (chosen by hash of the id).
TRAIN_DOCS = 12_000
#: Harmless windows near the border that a round of training takes at least; of more every so-manieth, up to twice as many.
BORDER_WINDOWS = 20_000
#: A word is known from this share of the documents on: at most (words per document / KNOWN_SHARE) words are.
KNOWN_SHARE = 1 / 4000
KNOWN_LEAST = 3
#: Words per scored window.
WINDOW = 12
THRESHOLD = 0.2
#: Where training begins, and its L2 penalty.
BIAS = -4.0
PENALTY = 0.1
#: Times each seed sentence counts.
SEED_COPIES = 4
#: Documents called abusive whose worst window is no worse than in this share of the harmless ones are taken as rater errors.
USUAL = 0.93
#: Standard deviations above chance from which an n-gram counts as a sign of abuse at the start.
SURE = 4.0

_TAG = re.compile(r"<[^<>]*>")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_·/]))(?:[^\W\d_]\1)+[^\W\d_](?![^\W_]|[@$€*|+][^\W_])")
_CHUNK = re.compile(r"[^\W_@$€*|+]*[@$€*|+]*[^\s\W_]?(?:[^\W_]|[@$€*|+](?=[^\W_])|!(?=[^\W\d_])|[*$@](?=[*]))*[^\W_](?:[$*@](?![\w*]))?", re.UNICODE)
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
_LATIN = re.compile(r"[a-z]")


class _Marks(dict):
    """For ``str.translate``: combining marks go, all else stays; filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.combining(chr(code)) else code
        return self[code]


_MARKS = _Marks()


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text.casefold()).translate(_MARKS)


@dataclass
class Speller:
    """A character language model (four-grams over a-z, from the corpus' word counts) and the known words."""

    logp: np.ndarray
    known: dict[str, float]
    cache: dict[str, str] = field(default_factory=dict)
    #: The words of a run without blanks.
    runs: dict[str, str | tuple[str, ...]] = field(default_factory=dict)
    #: The beginnings of the known words, with the best word of each; made when first needed.
    prefixes: dict[str, float] = field(default_factory=dict)

    #: RUN: longer runs and chunks are decoded each time they are met, so that the caches stay small.
    BEAM, CACHE, RUN = 24, 200_000, 200
    # Costs of the channel (log probability of a disguise).
    KEEP, SUBSTITUTE, WILD, REPEAT, SWAP = 0.0, -0.5, -0.5, -0.3, -4.0
    # ... of a further word, and of a letter by chance. Above LONG letters nothing is one word.
    WORD, CHANCE, LONG = -2.5, -3.3, 40

    @classmethod
    def train(cls, counts: dict[str, int]) -> Speller:
        """From the document counts of the known words."""
        n4 = np.full((27, 27, 27, 27), 0.0)
        for word, n in counts.items():
            x = [0, 0, 0, *[ord(c) - 96 for c in word if "a" <= c <= "z"], 0]
            if len(x) == len(word) + 4:
                for k in range(3, len(x)):
                    n4[x[k - 3], x[k - 2], x[k - 1], x[k]] += n**0.5
        p = np.full(27, 1 / 27)
        for keep in (1, 2, 3, 4):
            c = n4.sum(axis=tuple(range(4 - keep)))
            total = c.sum(axis=-1, keepdims=True)
            p = (c + 4.0 * p) / (total + 4.0)
        top = max(counts.values(), default=1)
        return cls(np.log(p).astype(np.float32), {w: float(np.log(n / top)) for w, n in counts.items()})

    def restore(self, chunk: str) -> str:
        """The most likely plain word behind ``chunk``; unchanged where there is nothing to decode."""
        if chunk in self.known:
            return chunk
        got = self.cache.get(chunk)
        if got is None:
            got = self._decode(chunk)
            if len(chunk) <= self.RUN:
                if len(self.cache) >= self.CACHE:
                    self.cache.clear()
                self.cache[chunk] = got
        return got

    def _options(self, c: str, mixed: bool) -> list[tuple[str, float]]:
        if "a" <= c <= "z":
            return [(c, self.KEEP)]
        if c == "*":
            return [(chr(k), self.WILD) for k in range(97, 123)]
        if c in SUBSTITUTES:
            return [(x, self.SUBSTITUTE) for x in SUBSTITUTES[c]]
        if mixed and c in LOOKALIKES:
            return [(LOOKALIKES[c], self.KEEP)]
        return []

    def _decode(self, chunk: str) -> str:
        if len(chunk) < 2:
            return chunk
        # a word of look-alikes only is one of its own script, unless it spells a known word
        if all(c in LOOKALIKES for c in chunk):
            plain = "".join(LOOKALIKES[c] for c in chunk)
            return plain if plain in self.known else chunk
        mixed = bool(_LATIN.search(chunk))
        if not mixed and not ("*" in chunk or "$" in chunk or "@" in chunk):
            return chunk
        # runs of three or more letters may stand for one or two
        units = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", chunk)]
        flat = [(c, n) if n > 2 and c != "*" else (c, 1) for c, n in units for _ in range(1 if n > 2 and c != "*" else n)]
        if len(flat) > self.LONG:
            parts = self._split(flat, mixed)
            return " ".join(parts) if len(parts) > 1 or parts[0] in self.known else chunk
        odd = any(n > 2 or not "a" <= c <= "z" for c, n in flat)
        swaps = len(flat) > 3 and all("a" <= c <= "z" or c in LOOKALIKES for c, _ in flat)
        if not odd and not swaps:
            return chunk
        logp, size = self.logp, len(flat)
        beams: list[list[tuple[float, tuple[int, int, int], str, bool]]] = [[] for _ in range(size + 2)]
        beams[0] = [(0.0, (0, 0, 0), "", False)]

        def step(at: int, hyp: tuple, letters: str, cost: float, swapped: bool) -> None:
            score, (a, b, c), text, _ = hyp
            for x in letters:
                k = ord(x) - 96
                score += float(logp[a, b, c, k])
                a, b, c = b, c, k
            beams[at].append((score + cost, (a, b, c), text + letters, swapped))

        for i in range(size):
            row = sorted(beams[i], reverse=True)[: self.BEAM]
            c, n = flat[i]
            for hyp in row:
                for x, cost in self._options(c, mixed):
                    step(i + 1, hyp, x, cost + (self.REPEAT if n > 2 else 0), hyp[3])
                    if n > 2:
                        step(i + 1, hyp, x + x, cost + self.REPEAT, hyp[3])
                if swaps and not hyp[3] and i + 1 < size and flat[i][1] == flat[i + 1][1] == 1 and flat[i + 1][0] != c:
                    for x, cx in self._options(flat[i + 1][0], mixed):
                        for y, cy in self._options(c, mixed):
                            step(i + 2, hyp, x + y, cx + cy + self.SWAP, True)
        best, out = -1e9, chunk
        for score, (a, b, c), text, _ in beams[size]:
            # a known word also has its own probability; an unknown one that of a rare name
            total = score + float(logp[a, b, c, 0]) + (12.0 + 0.5 * self.known[text] if text in self.known else 0.0)
            if total > best:
                best, out = total, text
        return out

    def _split(self, flat: list[tuple[str, int]], mixed: bool) -> list[str]:
        """The most likely known words behind a run of (letter, repeats) without blanks; letters that no word explains better
        than chance stay, those side by side as one word. Linear in the run: a word begun anywhere keeps its BEAM best readings."""
        if not self.prefixes:
            for w, v in self.known.items():
                for k in range(1, len(w) + 1):
                    self.prefixes[w[:k]] = max(v, self.prefixes.get(w[:k], -np.inf))
        size = len(flat)
        score, back = [0.0] + [-np.inf] * size, [(0, "", False)] * (size + 1)
        for i in range(size):
            if score[i] + self.CHANCE > score[i + 1]:
                score[i + 1], back[i + 1] = score[i] + self.CHANCE, (i, flat[i][0], False)
            front = {"": 0.0}
            for j in range(i, size):
                c, n = flat[j]
                longer: dict[str, float] = {}
                for text, cost in front.items():
                    for x, cx in self._options(c, mixed):
                        for t in (text + x, text + x + x) if n > 2 else (text + x,):
                            v = cost + cx + (self.REPEAT if n > 2 else 0)
                            if t in self.prefixes and v > longer.get(t, -np.inf):
                                longer[t] = v
                if not longer:
                    break
                if len(longer) > self.BEAM:
                    longer = dict(sorted(longer.items(), key=lambda x: (-x[1] - self.prefixes[x[0]], x[0]))[: self.BEAM])
                front = longer
                for text, cost in front.items():
                    if text in self.known and score[i] + cost + self.known[text] + self.WORD > score[j + 1]:
                        score[j + 1], back[j + 1] = score[i] + cost + self.known[text] + self.WORD, (i, text, True)
        out: list[str] = []
        at, before = size, True
        while at:
            at, text, whole = back[at]
            if whole or before:
                out.append(text)
            else:
                out[-1] = text + out[-1]
            before = whole
        return out[::-1]

    def words(self, text: str | None) -> list[str]:
        """The restored words of a text; a character of Chinese, Japanese or Korean is a word of its own."""
        if not text:
            return []
        text = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
        text = fold(_HIDDEN.sub("", text))
        text = _SPACED.sub(self._joined, text)
        # no chunk crosses a blank, so the words of a run between blanks are always the same
        runs, out = self.runs, []
        for run in text.split():
            got = runs.get(run)
            if got is None:
                got = self._run_words(run)
            if type(got) is str:
                out.append(got)
            else:
                out += got
        return out

    def _run_words(self, run: str) -> str | tuple[str, ...]:
        out: list[str] = []
        for chunk in _CHUNK.findall(run):
            if not chunk.isascii() and _CJK.search(chunk):
                out += [w for w in re.split("([぀-ヿ㐀-鿿가-힯])", chunk) if w]
            elif chunk.isdigit():
                out.append("0")
            else:
                if chunk[0] == "*" and (chunk[-1] == "*" or chunk[:2] == "**"):
                    chunk = chunk.strip("*")
                if chunk:
                    out += self.restore(chunk).split(" ")
        got = out[0] if len(out) == 1 else tuple(out)
        if len(run) <= self.RUN:
            if len(self.runs) >= self.CACHE:
                self.runs.clear()
            self.runs[run] = got
        return got

    def _joined(self, m: re.Match) -> str:
        """Letters set apart; a first letter that is a word of its own stays one ("a p i g"), and a run that is no known word is several."""
        word = m[0].replace(m[1], "")
        if m[1] == " " and word[0] in "aiyoe" and word not in self.known and len(word) > 3 and word[1:] in self.known:
            return word[0] + " " + word[1:]
        if word.isascii() and len(word) <= self.LONG and self.restore(word) not in self.known:
            return " ".join(self._split([(c, 1) for c in word], True))
        return word


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _ngrams(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Keys of the 1-, 2- and 3-grams that end at each word; 0 where one would begin before its document.

    ``start`` is, per word, the position where its document begins.
    """
    at = np.arange(len(h))
    one = h * np.uint64(3) + np.uint64(1)
    two, three = np.zeros_like(h), np.zeros_like(h)
    if len(h) > 1:
        two[1:] = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    if len(h) > 2:
        three[2:] = (two[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[2:]
    two[at - start < 1] = 0
    three[at - start < 2] = 0
    return [one, two, three]


def _window_sums(value: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(value)])
    at = np.arange(len(value))
    return total[at + 1] - total[np.maximum(start, at - size + 1)]


@dataclass
class Model:
    """A logistic score of the n-grams in a window; ``keys`` is sorted."""

    speller: Speller
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    hashes: dict[str, int] = field(default_factory=dict)

    def hash(self, word: str) -> int:
        h = self.hashes.get(word)
        if h is None:
            if len(self.hashes) > 500_000:
                self.hashes.clear()
            h = self.hashes[word] = _hash(word)
        return h

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """(probability, restored words of the worst window) of each text; 0 and NULL for one without words."""
        docs = [self.speller.words(t) for t in texts]
        sizes = np.array([len(d) for d in docs])
        prob, worst = np.zeros(len(docs)), [None] * len(docs)
        if not sizes.sum():
            return prob, worst
        h = np.fromiter((self.hash(w) for d in docs for w in d), dtype=np.uint64, count=int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        start = np.repeat(first, sizes)
        value = np.zeros(len(h))
        for k in _ngrams(h, start):
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            value += np.where(self.keys[at] == k, self.weights[at], 0.0)
        sums = _window_sums(value, start, WINDOW)
        for i in np.flatnonzero(sizes):
            own = sums[first[i] : first[i] + sizes[i]]
            end = int(own.argmax())
            prob[i] = 1 / (1 + np.exp(-np.clip(own[end] + self.bias, -50, 50)))
            worst[i] = " ".join(docs[i][max(0, end - WINDOW + 1) : end + 1])
        return prob, worst


def train(speller: Speller, docs: list[list[str]], labels: np.ndarray, rounds: int = 4, steps: int = 150) -> Model:
    """Multiple-instance logistic regression: a labelled document counts by its worst window only.

    ``labels``: mean of the raters, 0 to 1. The seed sentences join the labelled documents.
    """
    seeds = [speller.words(t) for t in (ABUSIVE + HARMLESS) * SEED_COPIES]
    docs = docs + seeds
    y = np.concatenate([labels, *[np.ones(len(ABUSIVE)), np.zeros(len(HARMLESS))] * SEED_COPIES])
    docs_y = [(d, v) for d, v in zip(docs, y, strict=True) if d and abs(v - 0.5) > 0.1]
    y = np.array([v for _, v in docs_y]) > 0.5
    sizes = np.array([len(d) for d, _ in docs_y])
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for d, _ in docs_y for w in d), dtype=np.int64, count=int(sizes.sum()))
    h = np.array([_hash(w) for w in ids], dtype=np.uint64)[codes]
    first = np.cumsum(sizes) - sizes
    start, owner = np.repeat(first, sizes), np.repeat(np.arange(len(sizes)), sizes)
    grams = np.stack(_ngrams(h, start))

    keys, inverse = np.unique(grams, return_inverse=True)
    inverse = inverse.reshape(grams.shape).astype(np.int32)
    pair = np.unique(np.broadcast_to(owner, grams.shape).ravel() * np.int64(len(keys)) + inverse.ravel())
    feature, label = pair % len(keys), y[pair // len(keys)]
    bad, good = np.bincount(feature, label, len(keys)), np.bincount(feature, ~label, len(keys))
    seeded = np.isin(np.arange(len(keys)), inverse[:, int(first[-len(seeds)]) :])
    keep = ((bad >= 2) | (good >= 2) | seeded) & (keys != 0)
    slot = np.where(keep, np.cumsum(keep) - 1, -1)
    inverse = slot[inverse].astype(np.int32)
    keys, bad, good, seeded = keys[keep], bad[keep], good[keep], seeded[keep]
    # begin with the n-grams that are clearly more frequent in abusive documents than by chance
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((~y).sum() + 1))
    chance = (bad + good) * y.mean()
    sure = (bad - chance) / np.sqrt(chance + 0.5) > SURE
    begin = np.where(sure, np.clip(odds, 0, 3), np.where(seeded & (good == 0), 0.5, 0.0)) * 0.6
    weight, bias = begin, BIAS
    pool = np.zeros(0, dtype=np.int64)
    for k in range(rounds):
        value = np.where(inverse >= 0, weight[inverse], 0.0).sum(axis=0)
        sums = _window_sums(value, start, WINDOW)
        best = np.maximum.reduceat(sums, first)
        # raters err: abusive documents without any suspect window and harmless ones with a blatant one teach nothing
        usual = np.quantile(best[~y], USUAL) if (~y).any() else -np.inf
        doubt = (y & (best < max(usual, -bias - 2.0))) | (~y & (best > -bias + 3.0) & (k > 1))
        doubt[-len(seeds) :] = False
        # the worst window of each document, and of harmless ones the windows near the border in this or an earlier round
        near = np.flatnonzero((sums >= best[owner] - 1e-9) & ~doubt[owner])
        _, once = np.unique(owner[near], return_index=True)
        extra = np.flatnonzero(~y[owner] & ~doubt[owner] & (sums > -bias - 3.0))
        pool = np.union1d(pool, extra[:: max(1, len(extra) // BORDER_WINDOWS)])
        ends = np.union1d(near[once], pool[~doubt[owner[pool]]])
        lo = np.maximum(start[ends], ends - WINDOW + 1)
        width = ends - lo + 1
        words = np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        f = inverse[:, words].ravel()
        r = np.tile(np.repeat(np.arange(len(ends)), width), 3)
        r, f = r[f >= 0], f[f >= 0]
        weight, bias = _fit(r, f, y[owner[ends]].astype(float), begin, BIAS, steps * (1 + k) // 2)
    order = np.argsort(keys)
    return Model(speller, keys[order], weight[order].astype(np.float64), float(bias))


def _fit(r: np.ndarray, f: np.ndarray, y: np.ndarray, begin: np.ndarray, bias: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 penalty by Adam on all rows; (row, feature) pairs in ``r`` and ``f``."""
    w, n, size = begin.copy(), len(y), len(begin)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(r, w[f], n) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        gw = np.bincount(f, g[r], size) + PENALTY * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.98 * v + 0.02 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.98 * vb + 0.02 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.98**t
        w -= 0.03 * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.03 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return w, bias


def word_counts(docs: DataFrame, text: str) -> dict[str, int]:
    """Document counts of the words that enough documents hold; counted over all documents."""
    plain = F.lower(F.regexp_replace(F.translate(F.col(text), "ßæœø", "saoo"), "<[^<>]*>", " "))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[\p{L}]+"), 0))).alias("w"))
    n = docs.count()
    least = max(KNOWN_LEAST, int(n * KNOWN_SHARE))
    rows = words.where("w <> ''").groupBy("w").count().where(F.col("count") >= least).toLocalIterator()
    out: dict[str, int] = {}
    for r in rows:
        w = fold(r[0])
        out[w] = out.get(w, 0) + r[1]
    for t in ABUSIVE + HARMLESS:
        for w in re.findall(r"[^\W\d_]+", fold(t)):
            out[w] = out.get(w, 0) + least
    return out


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str, train_docs: int = TRAIN_DOCS) -> Model:
    """The model from all documents (word counts) and at most ``train_docs`` labelled ones."""
    speller = Speller.train(word_counts(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(speller)
    marks = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(doc).agg(F.avg(label).alias("y"))
    marks = F.broadcast(marks.orderBy(F.xxhash64(doc), doc).limit(train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [" ".join(shared.value.words(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), b.column(1)], names=["words", "y"])

    sample = docs.join(marks, doc).select(text, "y").mapInArrow(run, "words string, y double")
    words, y = [], []
    seen: dict[str, str] = {}
    # sorted here: Spark's sort would decode the texts twice, once for its ranges
    for r in sorted(((r[0] or "", r[1]) for r in sample.toLocalIterator())):
        words.append([seen.setdefault(w, w) for w in r[0].split(" ")] if r[0] else [])
        y.append(r[1])
    return train(speller, words, np.array(y))


def score(docs: DataFrame, doc: str, text: str, model: Model) -> DataFrame:
    """(doc, score, worst): probability that the text abuses, and the restored words of its worst window.

    NULL, empty and wordless texts score 0 with worst NULL. Texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prob, worst = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prob), pa.array(worst, pa.string())], names=[doc, "score", "worst"])

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, score double, worst string")


def rates(sources: DataFrame, scores: DataFrame, doc: str, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, n_abusive, rate) over all documents."""
    both = sources.join(scores.select(doc, "score"), doc)
    out = both.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_abusive"))
    return out.withColumn("rate", F.round(F.col("n_abusive") / F.col("n_docs"), 6))
