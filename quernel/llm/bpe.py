"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves, and two encoded neighbours are joined at the seam, on two levels that work alike.

Matches of the split pattern never merge with each other, so a text's encoding is the list of its matches' encodings.
Two neighbours are joined by splitting a window of matches around the seam again. The pattern looks at a text from left
to right and never back, so what follows a place where a match ends only depends on the text after it. The window grows
to the left until its first match comes out as it was (an earlier match then ends where it did, with the text that ended
it in place), and to the right until a match that comes out ends where one of the right neighbour's ends, before the
window's own end. Matches outside are then those of the whole text.

A long match is encoded by halves too; two encoded neighbours are joined by re-encoding a window of tokens around the
seam. It grows until its outermost tokens come out unchanged. That is enough: the restriction of the merge process to two
neighbouring final tokens is the process on these two alone (lowest rank first, leftmost on ties), so a token sequence
is the encoding of its bytes if and only if each adjacent pair is the encoding of its own bytes. Pairs outside the
window were so before, pairs inside are so after re-encoding, and the pairs at its edges are unchanged.

Joining is thus associative, with the empty sequence as its unit. Decoding concatenates the tokens' bytes by halves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quernel.llm.shared import in_slices

_NONE = 1 << 62  #: the rank of a pair that is no token
LEAF = 16  #: bytes of a match that are merged directly
TEXT_LEAF = 512  #: characters of a text that are split directly
MEMO_LENGTH = 32  #: characters of the longest match that is kept in the memo
#: Texts of these characters alone (ASCII, Latin letters, dashes and quotes) can be split with explicit classes, faster.
_SIMPLE = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f\u2010-\u2027]")
_CLASSES = {r"\p{L}": "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9", r"\s": r" \t\n\x0b\x0c\r"}
SMALL = 48  #: bytes up to which the plain loop is faster than the heap


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of piece: merge the pair of lowest rank, leftmost first, until none is left."""
    n = len(piece)
    if n <= SMALL:
        parts = [piece[i : i + 1] for i in range(n)]
        get = ranks.get
        pair = [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
        while pair and (best := min(pair)) != _NONE:
            at = pair.index(best)
            made = parts[at] + parts.pop(at + 1)
            parts[at] = made
            del pair[at]
            if at < len(pair):
                pair[at] = get(made + parts[at + 1], _NONE)
            if at:
                pair[at - 1] = get(parts[at - 1] + made, _NONE)
        return [ranks[p] for p in parts]
    ends = list(range(1, n + 1))  # of the part that starts here
    back = list(range(-1, n))  # start of the part before the one that starts here
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue  # a part of this pair has been merged meanwhile
        alive[j], ends[i] = 0, end
        if end < n:
            back[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := back[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def splitters(pattern: str):
    """findall of the pattern for any text, and one that agrees with it on texts without a _SIMPLE match."""
    any_text = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    plain = re.sub(r"\[(\^?)([^\]]*)\]", lambda m: f"[{m[1]}{''.join(_CLASSES.get(x, x) for x in re.findall(r'.p{.}|.s|.', m[2]))}]", pattern)
    plain = re.sub(r"(\\p{.}|\\s|\\S)(?![^\[]*\])", lambda m: f"[^{_CLASSES[chr(92) + 's']}]" if m[1] == r"\S" else f"[{_CLASSES[m[1]]}]", plain)
    return any_text, re.compile(plain).findall


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 100_000):
        self.ranks, self.tokens = ranks, {v: k for k, v in ranks.items()}
        self.spelt = {str(v): k for k, v in ranks.items()}  # by the id as text
        self.any_text, self.plain = splitters(pattern)
        self.most, self.memo, self.older = memo, {}, {}

    def split(self, text: str) -> list[str]:
        return self.any_text(text) if _SIMPLE.search(text) else self.plain(text)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, from their encodings."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = merge(b"".join(map(self.tokens.__getitem__, left[-a:] + right[:b])), self.ranks)
            more_left = a < len(left) and window[0] != left[-a]
            more_right = b < len(right) and window[-1] != right[b - 1]
            if not more_left and not more_right:
                return left[:-a] + window + right[b:]
            a, b = a * (1 + more_left), b * (1 + more_right)

    def reduce(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return merge(piece, self.ranks)
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half]), self.reduce(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """One match of the split pattern; a piece that is itself a token is that token."""
        known = self.ranks.get(piece)
        return [known] if known is not None else self.reduce(piece)

    def decode(self, ids: list, tokens: dict | None = None) -> bytes:
        """The bytes of ids (numbers; with tokens, its keys), concatenated by halves."""
        if len(ids) <= 256:
            return b"".join(map((tokens or self.tokens).__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], tokens) + self.decode(ids[half:], tokens)

    def known(self, match: str) -> str:
        """The ids of a match, joined by commas; kept in a memo of two generations of `memo` short matches."""
        if (out := self.older.get(match)) is None:
            out = ",".join(map(str, self.piece(match.encode("utf-8"))))
        if len(match) <= MEMO_LENGTH:
            if len(self.memo) >= self.most:
                self.memo, self.older = {}, self.memo
            self.memo[match] = out
        return out

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of the text of both, from their matches; by windows around the seam."""
        if not left or not right:
            return left or right
        a, b = 1, 2
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.split("".join(left[-a:]) + "".join(right[:b]))
            if a < len(left) and window[0] != left[-a]:
                a *= 2
                continue
            if b == len(right):
                return left[:-a] + window
            ends, at = {}, sum(map(len, left[-a:]))
            for k in range(b - 1):  # the last match of the window may only end there because the window does
                at += len(right[k])
                ends[at] = k + 1
            at = 0
            for k, m in enumerate(window):
                at += len(m)
                if at in ends:
                    return left[:-a] + window[: k + 1] + right[ends[at] :]
            b *= 2

    def matches(self, text: str) -> list[str]:
        """The matches of the split pattern, by halves."""
        if len(text) <= TEXT_LEAF:
            return self.split(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def said(self, text: str) -> str:
        """The ids of text, joined by commas."""
        out, matches = [], self.matches(text)
        for i in range(0, len(matches), 4096):  # known() may replace the memo
            get, known = self.memo.get, self.known
            out += [get(m) or known(m) for m in matches[i : i + 4096]]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.said(text).split(","))) if text else []

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of the bytes the ids decode to."""
        said = self.said(text)
        ids = said.split(",") if said else []
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(self.decode(ids, self.spelt)).hexdigest()


@lru_cache(maxsize=1)
def load(path: str, pattern: str) -> TreeBpe:
    """The coder for a rank file (base64 token and rank a line), once per worker."""
    with open(path, "rb") as f:
        return TreeBpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, over whole texts.

    Null text counts as empty: no tokens, and the digests of the empty string; very long texts and matches cost in
    proportion to their length. An empty table gives an empty one. path names a rank file that every executor can read (part of the installed tokenizer package by default). Repeated
    rows give repeated rows; other columns are ignored.
    """
    path, pattern = _vocabulary(path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = load(path, pattern)
        for b in in_slices(batches):
            got = [coder.digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids, an array of int, for every row."""
    path, pattern = _vocabulary(path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = load(path, pattern)
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and data, the bytes that ids stand for; null ids give empty bytes."""
    path, pattern = _vocabulary(path, pattern)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")
