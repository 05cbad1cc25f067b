"""Harmonic packing of token documents into sequences (operator 9).

Every document (its token ids, then the end id) is first cut into whole
sequences; its rest is cut at the powers of two down to ``SMALLEST`` and the
last few tokens are one piece.  A piece of length n belongs to the harmonic
class ``k = capacity // n``: a bin of class k takes exactly k pieces, so bins
are filled by counting alone, independently on every worker.  Pieces of a
power-of-two length fill their bins without a gap.  When a worker's rows end,
the pieces of its unfilled bins are laid end to end (cut where a sequence is
full) and the last sequence is split at powers of two, which need no padding.

A worker's share is one scan partition; nothing is shuffled and no token
leaves its worker except as a CRC.  ``sequence_id`` is the worker's number
times 2^32 plus a running number, so a lost task recreates the same ids.

Defined results: null and empty texts are one piece holding the end id alone;
repeated rows are packed one by one; a null doc_id is packed like any other;
very long texts are encoded whole, whatever runs they hold.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskloom.llm.common import chunks, id_text, small_batches

CAPACITY = 1024
SMALLEST = 64
END_ID = 0
#: Texts with a longer run of white space or of anything else go through the tokenizers library: the other one's
#: pattern search goes as deep as a run is long, and ends the process at some hundred thousand characters.
LONG_RUN = 20_000
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids as the tokenizer file defines them.

    The file's vocabulary is byte-level BPE whose ids are its merge ranks, so
    tiktoken gives the same ids several times faster; texts that hold one of
    the file's added tokens go through the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    exact = Tokenizer.from_file(path)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    # the printable stand-ins of byte-level BPE: printable Latin-1 as itself, the rest from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding(
        "byte-level", mergeable_ranks=ranks, special_tokens={},
        pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    run = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or len(text) >= LONG_RUN and run.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def rest_lengths(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Pieces of a rest shorter than a sequence: its binary digits down to ``smallest``, then what is left."""
    out, size = [], capacity // 2
    while size >= smallest:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Packer:
    """Bins of one worker.  A piece is (doc_id, start, ids as bytes, tokens of its document)."""

    def __init__(self, base: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> None:
        self.base, self.capacity, self.smallest, self.next = base, capacity, smallest, 0
        self.bins: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.base + self.next, at))
            at += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            self.emit([(doc_id, start, ids[4 * start:4 * (start + self.capacity)], total)])
            start += self.capacity
        for n in rest_lengths(total - start, self.capacity, self.smallest):
            fits = self.capacity // n
            members = self.bins.setdefault(fits, [])
            members.append((doc_id, start, ids[4 * start:4 * (start + n)], total))
            start += n
            if len(members) == fits:
                self.emit(members)
                del self.bins[fits]

    def close(self) -> None:
        """Lay the pieces of unfilled bins end to end; the last sequence is split at powers of two."""
        left = [p for fits in sorted(self.bins) for p in self.bins[fits]]
        self.bins = {}
        todo = sum(len(p[2]) // 4 for p in left)
        room = current = min(self.capacity, 1 << (todo.bit_length() - 1)) if todo else 0
        filling: list[tuple] = []
        for doc_id, start, ids, total in left:
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(room, n - at)
                filling.append((doc_id, start + at, ids[4 * at:4 * (at + take)], total))
                at, room = at + take, room - take
                if not room:
                    self.emit(filling)
                    filling, todo = [], todo - current
                    room = current = min(self.capacity, 1 << (todo.bit_length() - 1)) if todo else 0

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the tokenizer file on the workers (default: the installed
    public one); ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1) or smallest > capacity:
        raise ValueError("capacity must be a power of two, and no smaller than smallest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path())
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, smallest)
        for b in chunks(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text) if text else []
                ids.append(END_ID)
                packer.add(doc_id, np.asarray(ids, dtype="<u4").tobytes())
            yield packer.taken()
        packer.close()
        yield packer.taken()

    return small_batches(id_text(docs)).mapInArrow(work, SCHEMA)
