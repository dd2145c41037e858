"""Harmonic packing of token sequences.

A piece's class is the number k of its like that one sequence of ``capacity``
tokens takes: lengths in (capacity / (k + 1), capacity / k]. A class fills its
sequences with exactly k pieces each, so no search is needed and every worker
packs the rows of its own partition.

Documents may be cut, so most pieces are given lengths at which a class wastes
nothing: whole sequences, then halves, quarters and so on down to ``least``
tokens, each 1 / k of the capacity. What is left of a document (under ``least``
tokens) forms the classes of high k, which waste 1 / (k + 1) at most. A worker's
unfinished sequences are closed at its end: n equal pieces in groups of 2^j
(their length is a power of two, which needs no padding), the short rests of
all classes together, longest first.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import pieces

#: Fixed value: the vocabulary's splitting pattern, in the equal form without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RESULT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def encoder(ranks: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens=dict(special))


@functools.cache
def library(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def ids_of(content: str, ranks: str, vocabulary: str, special: tuple[tuple[str, int], ...]) -> np.ndarray:
    """Ids by the faster of two equal encoders; it gives up on blanks by the million, which the other takes."""
    try:
        return encoder(ranks, special).encode_to_numpy(content, allowed_special="all")
    except ValueError:
        return np.array(library(vocabulary).encode(content, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of a document's pieces, in order; they add up to n."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= least:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Packer:
    """Assigns (sequence, offset) to pieces as they come; memory holds the unfinished sequences only."""

    def __init__(self, capacity: int, least: int, first: int):
        self.capacity, self.least, self.next = capacity, least, first
        self.open: dict[int, list] = {}

    def add(self, row: tuple, length: int):
        """Yields the rows of a sequence once it is complete."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((row, length))
        if len(held) == k:
            yield from self.close(self.open.pop(k))

    def close(self, held: list):
        at = 0
        for row, length in held:
            yield (*row, self.next, at)
            at += length
        self.next += 1

    def rest(self):
        short = []
        for k, held in sorted(self.open.items()):
            size = held[0][1]
            if size < self.least:
                short += held
                continue
            while held:
                group = 1 << (len(held).bit_length() - 1)
                yield from self.close(held[:group])
                held = held[group:]
        bins: list[list] = []
        room: list[int] = []
        for x in sorted(short, key=lambda x: -x[1]):
            k = next((k for k, free in enumerate(room) if free >= x[1]), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[k].append(x)
            room[k] -= x[1]
        for held in bins:
            yield from self.close(held)
        self.open = {}


def packed(df: DataFrame, ranks: str, vocabulary: str, special: dict[str, int], end: int = 1, capacity: int = 2048, least: int = 64, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Pieces of all texts in sequences of at most ``capacity`` tokens, one row per piece.

    ranks, vocabulary: paths of the same vocabulary on every executor, as ranks and as the
    library's own file; special: strings that are
    one token where they stand in a text; end: the id that closes a document;
    capacity: a power of two. Null texts count as empty, so that they give one
    piece with the closing id; null ids stay null and repeated rows are
    documents of their own. An empty table gives no rows. Other columns are not
    read. A text of any length is one row's work, its pieces leave as they fill.
    A task that runs again reads the same rows in the same order and so gives
    the same sequences.
    """
    kind = df.schema[id_column].dataType.simpleString()
    marks = tuple(sorted(special.items()))

    def run(batches):
        packer = Packer(capacity, least, TaskContext.get().partitionId() << 32)
        schema = None
        out: list[tuple] = []

        def batch_of(rows):
            a, b, c, d, e, f, g = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, schema), *(pa.array(x, pa.int64()) for x in (b, c, d, e, f, g))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in pieces(batches, "text", 2 << 20):
            schema = batch.column(0).type
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(ids_of(content or "", ranks, vocabulary, marks), np.uint32(end)).astype("<u4", copy=False)
                n, at, raw = len(ids), 0, memoryview(ids).cast("B")
                for length in cuts(n, capacity, least):
                    out.extend(packer.add((doc, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n), length))
                    at += length
                    if len(out) >= 20_000:
                        yield batch_of(out)
                        out = []
        out.extend(packer.rest())
        if out:
            yield batch_of(out)

    picked = df.select(df[id_column].alias("id"), df[text].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_column)
