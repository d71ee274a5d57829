"""Encoding of texts with a public byte-level tokenizer, and exact decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function here.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters handed to the tokenizer at once.
CHARS = 1_000_000


def byte_table() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def _tokenizer(folder: str, name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _pieces(folder: str, name: str) -> list[bytes | None]:
    """The bytes of every id."""
    back = {c: b for b, c in enumerate(byte_table())}
    t = _tokenizer(folder, name)
    out: list[bytes | None] = [None] * t.get_vocab_size(with_added_tokens=True)
    for token, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Positions of the non-empty texts, in groups of about CHARS characters."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if t:
            group.append(k)
            size += len(t)
            if size >= CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def encode(df: DataFrame, record: str, text: str, offsets: bool = False, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(record, ids) of every row: the token ids of the text without special tokens.

    Empty and NULL texts get an empty list. With ``offsets`` also starts and ends: the characters (code points) each token touches;
    tokens that split a character share it. Texts are encoded whole.
    """
    kind = df.schema[record].dataType.simpleString()
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(folder, name)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids: list[list[int]] = [[] for _ in texts]
            at: list[list[tuple[int, int]]] = [[] for _ in texts]
            for group in _groups(texts):
                for k, e in zip(group, t.encode_batch([texts[k] for k in group], add_special_tokens=False), strict=True):
                    ids[k] = e.ids
                    if offsets:
                        at[k] = e.offsets
            cols = [b.column(0), pa.array(ids, ids_type)]
            if offsets:
                cols += [pa.array([[x[k] for x in o] for o in at], ids_type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[record, "ids", "starts", "ends"][: len(cols)])

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return df.select(record, text).mapInArrow(run, f"`{record}` {kind}, ids array<int>{extra}")


def decode(df: DataFrame, record: str, ids: str = "ids", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(record, text, whole): the text of a list of ids, by the reversed byte table.

    ``whole`` is false where the list begins or ends inside a character (or holds an unknown id); then the broken bytes become U+FFFD.
    NULL ids give NULL, an empty list an empty text.
    """
    kind = df.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(folder, name)
        for b in batches:
            texts, whole = [], []
            for x in b.column(1).to_pylist():
                if x is None:
                    texts.append(None)
                    whole.append(None)
                    continue
                known = all(i is not None and 0 <= i < len(pieces) and pieces[i] is not None for i in x)
                data = b"".join(pieces[i] if i is not None and 0 <= i < len(pieces) and pieces[i] is not None else b"\xff" for i in x)
                try:
                    texts.append(data.decode())
                    whole.append(known)
                except UnicodeDecodeError:
                    texts.append(data.decode(errors="replace"))
                    whole.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], names=[record, "text", "whole"])

    return df.select(record, ids).mapInArrow(run, f"`{record}` {kind}, text string, whole boolean")


def round_trip(df: DataFrame, record: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(source-free check) one row: texts, tokens, and the texts whose decoding differs from the text."""
    enc = encode(df, record, text, folder=folder, name=name)
    dec = decode(enc, record, "ids", folder, name).withColumnRenamed("text", "back")
    tokens = enc.agg(F.sum(F.size("ids")).alias("n_tokens"))
    both = df.select(record, text).join(dec, record)
    return both.agg(F.count("*").alias("n_texts"), F.count_if(F.coalesce(F.col(text), F.lit("")) != F.col("back")).alias("n_differ")).crossJoin(tokens)
