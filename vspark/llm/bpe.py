"""Operator 10: byte-level BPE by monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_computed

#: Code points of a text's leaf, bytes of a piece's leaf.
TEXT_LEAF = 1 << 16
PIECE_LEAF = 32
#: Entries of a task's table of encoded pieces; when it is full it is emptied, which changes no result.
CACHE = 250_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def tree(parts: list, join: Callable):
    """The monoid product of parts, as a balanced tree of joins."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class ByteBPE:
    """Encoder and decoder of one vocabulary.

    Why joins are exact. Merges run by rank, leftmost first. Take tokens t1..tn such that each neighbouring pair
    (ti, ti+1) is the encoding of its own bytes. Look at the first merge over the whole bytes that would cross one
    of the boundaries, say that between a and b: up to then the bytes of a + b have seen just the merges of their own
    run, so that their own run would make it as well; but that ends in [a, b]. So no merge crosses, each stretch
    ends as its token, and t1..tn is the encoding. A window at a join is therefore final as soon as the pairs at
    both of its edges encode to themselves; until then it takes in more tokens on the side that is not.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF, cache: int = CACHE):
        self.ranks, self.text_leaf, self.piece_leaf = ranks, text_leaf, piece_leaf
        self.pieces_of = regex.compile(pattern).findall
        self.next_piece = regex.compile(pattern).match
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest: dict[bytes, int] = {}
        for t in ranks:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 0))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        outer = self

        class Packed(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= cache:
                    self.clear()
                ids = outer.encode_piece(piece.encode("utf-8", "surrogatepass"))
                self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
                return packed

        self.packed = Packed()

    # -- one piece

    def leaf(self, data: bytes) -> list[bytes]:
        """The tokens of few bytes: the longest tokens from the left where all neighbours are stable, which proves them right; else by merging."""
        ranks, longest, pairs = self.ranks, self.longest, self.pairs
        parts, at, n, last = [], 0, len(data), b""
        while at < n:
            end = min(n, at + longest.get(data[at : at + 2], 1))
            token = data[at:end]
            while token not in ranks:
                end -= 1
                token = data[at:end]
            if last:
                known = pairs.get((last, token))
                if not (self.stable(last, token) if known is None else known):
                    return self.merge(data)
            parts.append(token)
            last, at = token, end
        return parts if len(parts) > 1 else self.merge(data)

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of few bytes, by merging the leftmost pair of lowest rank until none is left."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        known = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while known:
            low = min(known)
            if low == 1 << 60:
                break
            i = known.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del known[i]
            if i < len(known):
                known[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                known[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return parts

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a and b encode to themselves side by side."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHE // 2:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of the bytes of left and right together: only a window at the boundary is encoded anew."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = b"".join(left[-i:] + right[:j])
            # A window that outgrew the leaf is itself encoded by halves.
            middle = self.leaf(window) if len(window) <= 4 * self.piece_leaf else self.reduce(window)
            more_left = i < len(left) and not self.stable(left[-i - 1], middle[0])
            more_right = j < len(right) and not self.stable(middle[-1], right[j])
            if not more_left and not more_right:
                return left[:-i] + middle + right[j:]
            i = min(len(left), i + (i + 1) // 2) if more_left else i
            j = min(len(right), j + (j + 1) // 2) if more_right else j

    def reduce(self, data: bytes) -> list[bytes]:
        """Tokens of any bytes: halves down to leaves, joined back up the tree."""
        if len(data) <= self.piece_leaf:
            return self.leaf(data)
        n = -(-len(data) // self.piece_leaf)
        step = -(-len(data) // n)
        return tree([self.leaf(data[k : k + step]) for k in range(0, len(data), step)], self.join)

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; one that is a token itself is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else [self.ranks[t] for t in self.reduce(data)]

    # -- a text

    def join_pieces(self, text: str, left: tuple, right: tuple) -> tuple:
        """Pieces of two neighbouring stretches (start, end, first pieces' list, ...) as those of one stretch.

        A match looks at no more than one code point beyond the longest run at its start, so that a piece that
        ends two code points before its stretch's end cannot change. From the first one on that can, the joined
        text is matched anew; the pattern never looks back, so that where a new match ends at an old boundary
        of the right side (and did not see the end of the window), all that follows there is the same.
        """
        start, cut, mine = left
        _, end, theirs = right
        at, keep = cut, len(mine)
        while keep and at > cut - 2:
            keep -= 1
            at -= len(mine[keep])
        anew, boundary, used, n = [], cut, 0, len(theirs)
        # The window ends with the right stretch: pieces are matched one by one, so only as much as needed is looked at.
        while at < end:
            m = self.next_piece(text, at, end)
            anew.append(m[0])
            at = m.end()
            while used < n and boundary < at:
                boundary += len(theirs[used])
                used += 1
            if at == boundary and at >= cut:
                break
        return start, end, mine[:keep] + anew + theirs[used:]

    def pieces(self, text: str) -> list[str]:
        """All matches of the pattern over the whole text; longer texts by halves, joined up the tree."""
        if len(text) <= self.text_leaf:
            return self.pieces_of(text)
        leaves = []
        for a in range(0, len(text), self.text_leaf):
            b = min(len(text), a + self.text_leaf)
            leaves.append((a, b, self.pieces_of(text, a, b)))
        return tree(leaves, lambda left, right: self.join_pieces(text, left, right))[2]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([packed[p] for p in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids: the bytes of leaves of ids, concatenated up the tree."""
        token, step = self.tokens.__getitem__, self.text_leaf
        numbers = np.frombuffer(ids, "<u4")
        leaves = [b"".join(map(token, numbers[k : k + step].tolist())) for k in range(0, len(numbers), step)]
        return tree(leaves, lambda a, b: a + b) if leaves else b""


@lru_cache(maxsize=2)
def _coder(raw: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(raw), pattern)


TOKENS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([T.StructField("token_ids", T.BinaryType())])


def _over(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str], added: T.StructType, row: Callable[[ByteBPE, str], tuple]) -> DataFrame:
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under 1 MB, whatever the input

    def make() -> Callable:
        coder = _coder(raw.value, pattern)
        return lambda text: row(coder, text or "")

    return with_computed(docs, ["text"], keep, added, make)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_tokens, and the SHA-256 of the ids and of the bytes decoded from them.

    Null text: as empty, no tokens. Any length of text or piece is encoded whole. Repeated rows: each by itself. No shuffle.
    """

    def row(coder: ByteBPE, text: str) -> tuple:
        ids = coder.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return _over(docs, ranks_path, pattern, keep, TOKENS, row)


def encoded_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs without text, with token_ids and the digests of token_digests, all from one pass. Null, empty and long texts, repeated rows: as in token_digests. Empty tables: no rows."""

    def row(coder: ByteBPE, text: str) -> tuple:
        ids = coder.encode(text)
        return ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return _over(docs, ranks_path, pattern, [c for c in docs.columns if c != "text"], T.StructType([*IDS, *TOKENS]), row)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with token_ids: the ids as little-endian unsigned 32-bit integers; null text gives no ids. Empty tables: no rows."""
    return _over(docs, ranks_path, pattern, docs.columns, IDS, lambda coder, text: (coder.encode(text),))


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of encode_texts with decoded: the bytes of token_ids; null ids give no bytes. Empty tables: no rows."""
    with open(ranks_path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    added = T.StructType([T.StructField("decoded", T.BinaryType())])
    return with_computed(encoded, ["token_ids"], encoded.columns, added, lambda: lambda ids: (_coder(raw.value, pattern).decode(bytes(ids or b"")),))


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
