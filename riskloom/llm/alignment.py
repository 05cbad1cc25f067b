"""Alignment of two tokenizers over whole texts (operator 13).

Tokenizer A (a ``tokenizers`` file, byte-level BPE) encodes space + text,
tokenizer B (a ``sentencepiece`` model, which adds the space itself) the text.
Each library says where a token lies: A by character offsets, B by the spans
of its proto.  These are the coarse cuts; where a token's span is not as long
as the bytes it decodes to (tokens that share a multibyte character, pieces of
a byte fallback, the added space), its decoded bytes place it.

* *Units.*  Both tokenizers cut at a single blank between two solid characters
  (``CUT``): A's pattern starts a word there, and no piece of B holds a blank
  after anything else (checked when B is loaded; otherwise a text is one unit).
  So a text is the sum of its units, and a worker aligns a unit once and
  remembers it (a bounded number of units, none that is long).
* *Links.*  The ends of both tokenizations cut a unit into stretches; each
  lies in one A and one B token, and no two in the same two tokens, so
  stretches are links.  Ends of both at once close a group.
* *Counts.*  Rows with their distinct id pairs are written once.  Pairs are
  counted over all documents, and the counts joined back: sent to all executors
  while there are at most ``BROADCAST_PAIRS``, else by shuffle.

The installed sentencepiece has no ``immutable_proto`` any more; ``proto`` holds
the same spans, in bytes.

Defined results: texts that are null, empty or do not come back byte by byte
from both tokenizers have no tokens (zeros, '').  Every row is a document of its
own, also when ids repeat or are null; all A ids' highest counts include ties.
Very long texts are aligned whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, few, id_text, small_batches, stored

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
BROADCAST_PAIRS = 1_500_000
#: Units of a generation that a worker remembers, and the longest of them in characters.
HELD_UNITS, HELD_LENGTH = 400_000, 40
CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
#: Units that may be encoded in one text with others.
SOLID = re.compile("[!-~À-ɏ]([\\s\\S]*[!-~À-ɏ])?")
BLANK = "▁"
#: Instead of a unit that is not remembered.
UNMET = object()
SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, "
          "times array<int>")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def refined(starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens: of a span that is as long as the decoded bytes, else by the bytes since the last such span."""
    by_bytes = np.cumsum(lengths)
    fits = ends - starts == lengths
    last = np.maximum.accumulate(np.where(fits, np.arange(len(ends)), -1))
    return np.where(last >= 0, by_bytes + (ends - by_bytes)[last], by_bytes)


class Aligner:
    """Both tokenizers of one worker, and the units it remembers.

    A unit is (A tokens, B tokens, groups, links as pair numbers in bytes, groups as text), None if its bytes do not
    come back.  Units are remembered in two generations: one that is met again moves to the younger.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True         # their strings inside texts are plain text
        alphabet = byte_alphabet()
        # added tokens are not written in the byte alphabet; they are never produced here
        vocabulary = {i: bytes(alphabet.get(c, 63) for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.text = [str(i) for i in range(max(len(self.bytes_a), self.size_b))]
        self.length_a, self.length_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        return CUT.split(text) if self.apart else [text]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, their byte ends, B ids, their byte ends) of space + text; None if the bytes do not come back."""
        whole = f" {text}".encode()
        x, proto = self.a.encode(f" {text}", add_special_tokens=False), self.b.encode(text, return_type="proto").pieces
        a, pieces = x.ids, np.array([n for p in proto for n in (p.id, p.begin, p.end)], dtype=np.int64).reshape(-1, 3)
        b = pieces[:, 0].tolist()
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        spans = np.fromiter(chain.from_iterable(x.offsets), dtype=np.int64, count=2 * len(a)).reshape(-1, 2)
        if len(whole) > len(text) + 1:              # characters to bytes
            letters = np.frombuffer(f" {text}".encode("utf-32-le"), dtype=np.uint32)
            spans = np.concatenate([[0], np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF))])[spans]
        starts, ends = pieces[:, 1] + 1, pieces[:, 2] + 1
        starts[:1] = 0                              # the added blank
        a, b = np.array(a), pieces[:, 0]
        return (a, refined(spans[:, 0], spans[:, 1], self.length_a[a]), b, refined(starts, ends, self.length_b[b]))

    def aligned(self, parts: list[str]) -> list[tuple | None]:
        """The units ``parts``, each with the blank before it, encoded as one text."""
        found = self.encoded(" ".join(parts))
        if found is None:
            if len(parts) == 1:
                return [None]
            half = len(parts) // 2
            return self.aligned(parts[:half]) + self.aligned(parts[half:])
        a, ends_a, b, ends_b = found
        end_a, end_b = np.zeros((2, ends_a[-1] + 1), dtype=np.int8)
        end_a[ends_a] = end_b[ends_b] = 1
        cuts, both = np.flatnonzero(end_a | end_b), np.flatnonzero(end_a & end_b)
        upto_a, upto_b = np.cumsum(end_a, dtype=np.int64), np.cumsum(end_b, dtype=np.int64)
        pairs = a[upto_a[cuts - 1]] * self.size_b + b[upto_b[cuts - 1]]
        text_a, text_b = [self.text[i] for i in a.tolist()], [self.text[i] for i in b.tolist()]
        last_a, last_b = upto_a[both].tolist(), upto_b[both].tolist()
        groups = [f"{text_a[i] if k == i + 1 else ','.join(text_a[i:k])}|{text_b[j] if n == j + 1 else ','.join(text_b[j:n])}"
                  for i, k, j, n in zip([0, *last_a], last_a, [0, *last_b], last_b)]  # noqa: B905
        upto = np.cumsum([(len(p) if p.isascii() else len(p.encode())) + 1 for p in parts])
        marks = [upto_a[upto], upto_b[upto], np.searchsorted(both, upto, side="right"), np.searchsorted(cuts, upto, side="right")]
        data, out, g, c = pairs.astype(np.int64).tobytes(), [], 0, 0
        counts = [np.diff(m, prepend=0).tolist() for m in marks]
        for n_a, n_b, n_groups, n_links in zip(*counts, strict=True):
            out.append((n_a, n_b, n_groups, data[c:c + 8 * n_links], groups[g] if n_groups == 1 else ";".join(groups[g:g + n_groups])))
            g, c = g + n_groups, c + 8 * n_links
        return out

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """The units of each text; None for a text without tokens."""
        cut = [self.units(t) if t else [] for t in texts]
        young, old = self.young, self.old
        known = {u: young.get(u, UNMET) for u in dict.fromkeys(chain.from_iterable(cut))}
        fresh, alone = [], []
        for unit in [u for u, value in known.items() if value is UNMET]:
            value = old.get(unit, UNMET)
            if value is not UNMET:
                known[unit] = young[unit] = value
            else:
                (fresh if SOLID.fullmatch(unit) else alone).append(unit)
        for units in ([fresh] if fresh else []) + [[u] for u in alone]:
            for unit, value in zip(units, self.aligned(units), strict=True):
                known[unit] = value
                if len(unit) <= HELD_LENGTH:
                    young[unit] = value
        if len(young) > HELD_UNITS:
            self.old, self.young = young, {}
        lost = {u for u, value in known.items() if value is None}
        for parts in cut:
            yield None if not parts or lost and not lost.isdisjoint(parts) else [known[u] for u in parts]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def links(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Every row's counts and digest, its distinct linked id pairs (A id * size of B + B id) and how often each is linked."""

    def work(batches):
        both = aligner(path_a or public_path(TOKENIZER_A), path_b or public_path(TOKENIZER_B))
        for b in chunks(batches):
            rows = []
            for found in both.texts(b.column("text").to_pylist()):
                if found is None:
                    rows.append((0, 0, 0, 0, "", [], []))
                    continue
                n_a, n_b, n_groups, linked, groups = zip(*found, strict=True)
                joined = b"".join(linked)
                pairs, times = np.unique(np.frombuffer(joined, dtype=np.int64), return_counts=True)
                rows.append((sum(n_a), sum(n_b), sum(n_groups), len(joined) // 8,
                             hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, times))
            columns = list(zip(*rows, strict=True))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return small_batches(id_text(documents)).mapInArrow(work, SCHEMA)


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None,
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    size_b = aligner(path_a or public_path(TOKENIZER_A), path_b or public_path(TOKENIZER_B)).size_b
    rows = stored(links(documents, path_a, path_b).withColumn("r", F.monotonically_increasing_id()))
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("c")))
    a_id = F.floor(F.col("pair") / size_b).alias("a")
    highest = counts.groupBy(a_id).agg(F.max("c").alias("most"))
    judged = stored(counts.join(highest, F.floor(F.col("pair") / size_b) == F.col("a"))
                    .select("pair", "c", (F.col("c") == F.col("most")).alias("best")))
    each = rows.select("r", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "r", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("k"))
    sums = (each.join(few(judged, broadcast_pairs), "pair").groupBy("r")
            .agg(F.sum(F.when(F.col("best"), F.col("k"))).alias("n_best"), F.sum(F.col("k") * F.col("c")).alias("count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.drop("pairs", "times").join(sums, "r", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
