"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are read as Latin-1 characters, so that pyahocorasick can report every vocabulary token
at every position of a piece in one pass. The encoder starts with the longest token at a
position and backtracks to shorter ones where two neighbouring tokens are not what the merges
would leave side by side. That test is memoised per pair of tokens. A position from which no
valid continuation exists is marked and not entered again, so that the work stays linear in the piece.

Defined results: null text counts as empty; an empty text has no tokens and decodes to no bytes;
repeated rows are encoded each for itself; other columns of the input are kept.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.llm.common import chunks, map_arrow, memo, texts

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Entries of each memo. Pieces of a full one are kept until the next is full, so that frequent ones are encoded once.
MEMO = 250_000
#: Entries of a lean memo of pieces, and the bits that tell it which pieces were seen.
LEAN, SEEN = 100_000, 1 << 21


class Codec:
    """Encoder and decoder for one rank table (token bytes to rank; rank is the id).

    A lean one memoises fewer pieces, and those only when they come again: under half the memory, up to a third more time, the same ids.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, lean: bool = False):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.token[v] = k
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for k in self.ranks:
            self.automaton.add_word(k, len(k))
        if self.ranks:
            self.automaton.make_automaton()
        self.stable: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}  # by both ids in one number
        self.pieces: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.before: dict[str, bytes] = {}
        self.most = LEAN if lean else MEMO
        self.seen = bytearray(SEEN // 8) if lean else None

    def merged(self, piece: str) -> list[str]:
        """The definition: merge the adjacent pair of lowest rank until none is left."""
        parts, ranks = list(piece), self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, token: str, rank: int) -> bool:
        """Whether the merges turn the token's bytes into that one token."""
        known = self.stable.get(rank)
        if known is None:
            known = self.stable[rank] = self.merged(token) == [token]
        return known

    def is_pair(self, left: int, right: int, token: str) -> bool:
        """Whether the merges of both tokens' bytes leave exactly these two tokens, the second of which is ``token``."""
        key = left * len(self.token) + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            first = self.token[left].decode("latin-1")
            known = self.fits[key] = self.merged(first + token) == [first, token]
        return known

    def walk(self, piece: str) -> list[int]:
        """Ids of a piece (Latin-1 characters) by backtracking from the longest matches."""
        ranks = self.ranks
        n = len(piece)
        lengths: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(piece):
            lengths[end + 1 - size].append(size)  # ends ascend, so the longest comes last
        dead = bytearray(n + 1)
        # One frame per token: its start, and how many shorter candidates are left.
        starts, left, out, at = [0], [len(lengths[0])], [], 0
        while at < n:
            options, k = lengths[at], left[-1]
            before = out[-1] if out else None
            while k:
                k -= 1
                size = options[k]
                if dead[at + size]:
                    continue
                token = piece[at : at + size]
                rank = ranks[token]
                if self.is_stable(token, rank) and (before is None or self.is_pair(before, rank, token)):
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary does not hold every byte of the text")
                dead[at] = 1
                starts.pop()
                left.pop()
                out.pop()
                at = starts[-1]
                continue
            left[-1] = k
            out.append(rank)
            at += size
            starts.append(at)
            left.append(len(lengths[at]) if at < n else 0)
        return out

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ranks.get(raw)
        return array("i", self.walk(raw) if whole is None else (whole,)).tobytes()

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers: every match of the pattern by itself."""
        out: list[bytes] = []
        add, get = out.append, self.pieces.get
        for piece in self.split(text):
            ids = get(piece)
            if ids is None:
                old = self.before.get(piece)
                ids = old or self.encode_piece(piece)
                if old or (len(piece) <= 64 and self.again(piece)):
                    if len(self.pieces) >= self.most:
                        self.before, self.pieces = self.pieces, {}
                        get = self.pieces.get
                        if self.seen is not None:
                            self.seen = bytearray(SEEN // 8)
                    self.pieces[piece] = ids
            add(ids)
        return b"".join(out)

    def again(self, piece: str) -> bool:
        """Whether a lean memo saw the piece, or one that shares its bit; now it has. Others take a piece at once."""
        if self.seen is None:
            return True
        at, bit = divmod(hash(piece) % SEEN, 8)
        known = self.seen[at] >> bit & 1
        self.seen[at] |= 1 << bit
        return bool(known)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode(df: DataFrame, text: str = "text", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN,
           ids: str = "ids", decoded: str | None = None, lean: bool = False) -> DataFrame:
    """``df`` with the token ids of its text column and, if named, the bytes that the ids decode to.

    The rank table is read once by the driver (its size is that of the vocabulary file) and sent
    to the executors; ``rank_file`` is its path. Columns of the same names are replaced. ``lean``: as in ``Codec``.
    """
    path = rank_file or public_tokenizers.path(RANK_FILE)
    table = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    new = [ids] + [decoded] * bool(decoded)
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
                          + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else []))
    names = [f.name for f in kept]

    name = f"bpe {path} {pattern} {lean}"

    def run(batches):
        codec = memo(name, lambda: Codec(table.value, pattern, lean))
        for batch in batches:
            rows = texts(batch, text)
            for a, b in chunks(rows, 1 << 20):
                found = [codec.packed(x) for x in rows[a:b]]
                sizes = np.fromiter(map(len, found), np.int32, b - a) // 4
                flat = np.frombuffer(b"".join(found), np.int32)
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                part = batch.slice(a, b - a)
                columns = [part.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([codec.decode(np.frombuffer(x, np.int32).tolist()) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return map_arrow(df, run, schema, name)
