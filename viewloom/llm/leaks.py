"""Evaluation passages in training text: a generalised suffix automaton of the evaluation items."""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a word is.
TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[^\W_]+")
#: Least length of a passage in words.
LEAST = 12
#: Words of evaluation items per automaton, and automata per pass over the corpus.
SHARD_WORDS = 500_000
SHARDS = 4


def level(text: str) -> str:
    """Tags become blanks; entities, compatibility forms, accents and letter case are levelled."""
    text = html.unescape(TAG.sub(" ", text)) if "<" in text or "&" in text else text
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Mn")


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the levelled text."""
    return WORD.findall(level(text)) if text else []


@dataclass
class Automaton:
    """A generalised suffix automaton in flat arrays of 4-byte numbers, about 40 bytes a word.

    ``root``: the state after each word from the start; ``word``, ``to``: of every other state its first transition, ``more``: (state, word,
    to) of the further ones; ``link``, ``length``: suffix links; ``name``: per state the number in ``names`` of the items that hold
    its shortest passage of at least ``least`` words, or -1.
    """

    vocabulary: dict[str, int]
    root: np.ndarray
    word: np.ndarray
    to: np.ndarray
    more: np.ndarray
    link: np.ndarray
    length: np.ndarray
    name: np.ndarray
    names: list[tuple[int, ...]]
    least: int
    tables: tuple | None = None

    def _tables(self) -> tuple:
        """The arrays as ``array`` objects, made once in each worker: their single items are read faster than numpy's."""
        if self.tables is None:
            rows = (self.root, self.word, self.to, self.link, self.length)
            more = {(int(s) << 32) | int(w): int(t) for s, w, t in self.more}
            self.tables = (*[array("i", r.astype("i").tobytes()) for r in rows], more)
        return self.tables

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) at each word where the longest match has at least ``least`` words."""
        root, first, to, link, length, more = self._tables()
        vocab, least = self.vocabulary, self.least
        state = size = 0
        for end, w in enumerate([vocab.get(x, -1) for x in words]):
            if w < 0:
                state = size = 0
                continue
            while state:
                if first[state] == w:
                    state = to[state]
                    break
                nxt = more.get((state << 32) | w)
                if nxt is not None:
                    state = nxt
                    break
                state = link[state]
                size = length[state]
            else:
                state = root[w]
                size = 0
            size += 1
            if size >= least:
                yield end, size, state

    def items(self, state: int) -> tuple[int, ...]:
        k = self.name[state]
        return self.names[k] if k >= 0 else ()


def build(items: list[tuple[int, list[str]]], least: int = LEAST) -> Automaton:
    """The automaton of all passages of the items."""
    vocab: dict[str, int] = {}
    nxt: list[dict[int, int]] = [{}]
    link, length = array("q", [-1]), array("q", [0])
    ends: list[tuple[int, int]] = []

    def extend(last: int, w: int) -> int:
        if w in nxt[last] and length[nxt[last][w]] == length[last] + 1:
            return nxt[last][w]
        new, p, cloned = len(nxt), last, -1
        if w not in nxt[last]:
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p < 0:
                return new
        else:
            new = -1
        q = nxt[p][w]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        cloned = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = cloned
        if new >= 0:
            link[new] = cloned
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = cloned
            p = link[p]
        return new if new >= 0 else cloned

    for item, words in items:
        last = 0
        for word in words:
            last = extend(last, vocab.setdefault(word, len(vocab)))
            ends.append((last, item))
    # an item holds a state's passages if it ends in the state or in one below it: climb until a state knows the item
    owners: list[set[int]] = [set() for _ in nxt]
    for state, item in ends:
        while state > 0 and item not in owners[state]:
            owners[state].add(item)
            state = link[state]
    # only the state of a match's shortest passage of ``least`` words counts: it names all items that hold these words
    name, names = np.full(len(nxt), -1, dtype=np.int32), {}
    for state in sorted(range(1, len(nxt)), key=length.__getitem__):
        if length[state] >= least:
            up = link[state]
            name[state] = names.setdefault(tuple(sorted(owners[state])), len(names)) if length[up] < least else name[up]
    word, to, more = np.full(len(nxt), -1, dtype=np.int32), np.zeros(len(nxt), dtype=np.int32), []
    for state, own in enumerate(nxt):
        if state:
            for k, (w, t) in enumerate(own.items()):
                if k:
                    more.append((state, w, t))
                else:
                    word[state], to[state] = w, t
    root = np.array([nxt[0][w] for w in range(len(vocab))], dtype=np.int32)
    rest = np.array(more, dtype=np.int32).reshape(-1, 3)
    return Automaton(vocab, root, word, to, rest, np.array(link, dtype=np.int32), np.array(length, dtype=np.int32), name, list(names), least)


def _shards(items: DataFrame, item: str, text: str, shard_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in groups of about ``shard_words`` words, read one group of rows at a time."""
    group, size = [], 0
    for r in items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text).distinct().orderBy(item, text).toLocalIterator():
        words = words_of(r[1])
        group.append((r[0], words))
        size += len(words)
        if size >= shard_words:
            yield group
            group, size = [], 0
    if group:
        yield group


_SPANS = "item_id long, first_word int, last_word int, n_words int"


def leaked_spans(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str = "item_id", item_text: str = "text", least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, item_id, first_word, last_word, n_words): the longest runs of words that a document shares with an item.

    Overlapping runs of a document and item are united; n_words counts the document's words. Words and levelling as in
    ``words_of``. NULL and empty texts hold nothing. The automata are built once, on the driver, one shard of items at a time, and
    broadcast as flat arrays (about 40 bytes a word of the items, so ``SHARDS`` of them are 80 MB at most); a worker keeps them over its tasks. One pass over
    the corpus serves ``SHARDS`` automata: each text is levelled and cut into words once. Nothing of the corpus is gathered.
    """
    spark, kind = docs.sparkSession, docs.schema[doc].dataType.simpleString()
    out = None
    groups = _shards(items, item, item_text, shard_words)
    while autos := [spark.sparkContext.broadcast(build(g, least)) for g in islice(groups, SHARDS)]:

        def run(batches: Iterator[pa.RecordBatch], autos=autos) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = words_of(t)
                    if len(words) < least:
                        continue
                    for auto in autos:
                        spans: dict[int, list[list[int]]] = {}
                        for end, _, state in auto.value.matches(words):
                            # the last ``least`` words of the match: every item that holds them
                            for i in auto.value.items(state):
                                own = spans.setdefault(i, [])
                                if own and own[-1][1] >= end - least:
                                    own[-1][1] = end
                                else:
                                    own.append([end - least + 1, end])
                        rows += [(d, i, a, z, len(words)) for i, own in spans.items() for a, z in own]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    arrays = [pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]]
                    yield pa.RecordBatch.from_arrays(arrays, names=[doc, "item_id", "first_word", "last_word", "n_words"])

        part = docs.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, {_SPANS}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"`{doc}` {kind}, {_SPANS}")


def leaked_coverage(spans: DataFrame, doc: str) -> DataFrame:
    """(doc, item_id, longest, covered, coverage): longest shared run, shared words, and their share of the document."""
    size = F.col("last_word") - F.col("first_word") + 1
    return spans.groupBy(doc, "item_id").agg(
        F.max(size).alias("longest"), F.sum(size).alias("covered"), (F.sum(size) / F.max("n_words")).alias("coverage")
    )


def without_leaks(docs: DataFrame, doc: str, text: str, spans: DataFrame, least: int = LEAST, max_coverage: float = 0.5) -> DataFrame:
    """(doc, words, dropped): the levelled words of a document without the runs of ``least`` words or more; a document
    covered beyond ``max_coverage`` is dropped (words NULL). Documents without runs keep their words."""
    kind = docs.schema[doc].dataType.simpleString()
    runs = spans.where(F.col("last_word") - F.col("first_word") + 1 >= least).groupBy(doc).agg(F.collect_set(F.struct("first_word", "last_word")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, dropped = [], []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(t)
                out = {k for r in own or () for k in range(r["first_word"], r["last_word"] + 1)}
                dropped.append(bool(words) and len(out) > max_coverage * len(words))
                kept.append(None if dropped[-1] else [w for k, w in enumerate(words) if k not in out])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.string())), pa.array(dropped, pa.bool_())], names=[doc, "words", "dropped"])

    return docs.select(doc, text).join(runs, doc, "left").mapInArrow(run, f"`{doc}` {kind}, words array<string>, dropped boolean")
