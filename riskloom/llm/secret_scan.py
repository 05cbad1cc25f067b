"""Secret scan (operator 1).

One Aho-Corasick pass over the ASCII-lower-cased text finds keywords (and, for
long hex runs, four-digit hex grams); a regular expression is tried only
where a keyword starts, on the original text.  Tokens that carry a checksum
(CRC-32 in base 62, Base58Check) are accepted only if it is right.

Spans are code points, end exclusive.  Base kinds are leftmost and
non-overlapping per kind, then dropped if too short, exactly as scanning the
whole text with the pattern would.  Defined results: a null or empty text has
no spans; repeated rows are scanned one by one; whole texts are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import chunks, id_text, small_batches

# fixed values: the base patterns (ASCII letters only fold case) and least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# fixed values: token prefixes that are followed by 30 characters and a 6-character CRC-32
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
EXTENDED_KEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "crc_token", "extended_key")
RANK = {k: i for i, k in enumerate(KINDS)}


def crc62(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def base58_check(token: str) -> bool:
    """True if the last four bytes are the double SHA-256 of the 78 before them."""
    n = 0
    for c in token:
        n = n * 58 + BASE58.index(c)
    try:
        raw = n.to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for words, kind in ((ASSIGN_WORDS, "assign"), (("akia",), "access"), (CRC_PREFIXES, "crc_token"),
                        (("xprv",), "extended_key"), (map("".join, product("0123456789abcdef", repeat=4)), "hex")):
        for w in words:
            made.add_word(w, (kind, len(w)))
    made.make_automaton()
    return made


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then by kind as listed."""
    if not text:
        return []
    lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes fold ASCII letters only
    found, end = [], dict.fromkeys(KINDS, 0)
    # hits come by their last letter; keywords of one kind that could reorder by length share no position
    for last, (kind, n) in automaton().iter(lowered):
        at = last - n + 1
        if at < end[kind]:
            continue
        if kind == "hex":
            m = HEX.match(text, at)
            good = m and m.end() - at >= HEX_LEAST
        elif kind == "assign":
            m = ASSIGN.match(text, at)
            good = m and len(m[2]) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, at)
            good = m and m.end() - at >= ACCESS_LEAST
        elif kind == "crc_token":
            m = CRC_TOKEN.match(text, at)
            good = m and crc62(m[1]) == m[2]
        else:
            m = EXTENDED_KEY.match(text, at)
            good = m and base58_check(m[0])
        if m:
            end[kind] = m.end()
            if good:
                found.append((at, m.end(), kind))
    return sorted(found, key=lambda x: (x[0], RANK[x[2]]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans for every row of ``docs``."""

    def work(batches):
        for b in chunks(batches):
            every = [spans(t) for t in b.column("text").to_pylist()]
            base = [[s for s in x if RANK[s[2]] < 3] for x in every]
            count = lambda kind: pa.array([sum(s[2] == kind for s in x) for x in every], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), count("assign"), count("access"), count("hex"),
                 pa.array([len(x) - len(y) for x, y in zip(every, base, strict=True)], pa.int64()),
                 pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()),
                 pa.array([joined(x) for x in every], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])

    return small_batches(id_text(docs)).mapInArrow(
        work, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with every span, overlapping ones together, replaced by the first one's kind in brackets."""
    found = spans(text)
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        begin, end, kind = found[i]
        while i < len(found) and found[i][0] < max(end, begin + 1):
            end = max(end, found[i][1])
            i += 1
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, secrets in ``text`` replaced."""

    def work(batches):
        for b in chunks(batches):
            texts = pa.array([masked(t) for t in b.column("text").to_pylist()], b.schema.field("text").type)
            yield b.set_column(b.schema.get_field_index("text"), "text", texts)

    return small_batches(docs).mapInArrow(work, docs.schema)
