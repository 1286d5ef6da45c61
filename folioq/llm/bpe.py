"""Byte-level BPE with forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be bridged by a merge, so the place
between the two bytes is a certain token boundary. Each pre-token is cut at all such places, every
fragment is merged on its own, and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import pieces

#: Pre-tokens kept per generation of the cache; two generations are alive at most, about 60 MB a worker.
CACHE_ENTRIES = 100_000
#: Longer pre-tokens are encoded without being kept.
CACHE_CHARS = 48
#: Fixed value: white space in the sense of Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def char_class(kind: str) -> str:
    """Ranges of all code points whose general category starts with `kind`, for a regex class."""
    out, start, last = [], None, None
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] == kind:
            if start is None:
                start = cp
            last = cp
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    if start is not None:
        out.append(f"\\U{start:08x}-\\U{last:08x}")
    return "".join(out)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_finder(letter: str, number: str, white: str):
    """The pre-token pattern of byte-level vocabularies over the given character classes."""
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+"
    ).findall


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file; instances live in Python workers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in added:
                self.token_bytes[i] = raw(token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode("utf-8")
        self.shared_ints = list(range(size))
        # a merged token's id grows with the rank of its merge, so ids serve as ranks
        ranks = {raw(token): i for token, i in vocab.items() if token not in added}
        self.merge = tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.joined = {pair for t in self.token_bytes for pair in zip(t, t[1:], strict=False)}
        self.added = added
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces_any = piece_finder(char_class("L"), char_class("N"), WHITE)
        self.pieces_latin = piece_finder("A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0")
        self.beyond_latin = re.compile("[^\\x00-\\u024f]").search
        self.cache = PieceCache(self)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; texts below U+0250 take the same pattern with short character classes."""
        return self.pieces_any(text) if self.beyond_latin(text) else self.pieces_latin(text)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut wherever two neighbouring bytes never meet inside a token."""
        joined = self.joined
        if joined.issuperset(zip(piece, piece[1:], strict=False)):
            return [piece]
        at = [i for i, pair in enumerate(zip(piece, piece[1:], strict=False), 1) if pair not in joined]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.fragments(piece.encode("utf-8"))
        ids = self.merge(found[0]) if len(found) == 1 else chain.from_iterable(map(self.merge, found))
        return tuple(map(self.shared_ints.__getitem__, ids))

    def encoded(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Per pre-token its ids, as comma-joined text and as a tuple."""
        if self.added_split is None or not any(t in text for t in self.added):
            return list(map(self.cache.__getitem__, self.pieces(text)))
        out = []
        for part in self.added_split.split(text):
            if part in self.added:
                out.append((str(self.added[part]), (self.added[part],)))
            elif part:
                out.extend(map(self.cache.__getitem__, self.pieces(part)))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.encoded(text)))

    def forget(self) -> None:
        """Empty the cache, so that a worker is left small to the tasks that follow."""
        self.cache = PieceCache(self)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class PieceCache(dict):
    """Ids of recent pre-tokens in two generations, so memory is bounded and frequent ones stay."""

    def __init__(self, bpe: ForcedBoundaryBPE) -> None:
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> tuple[str, tuple[int, ...]]:
        found = self.old.get(piece)
        if found is None:
            ids = self.bpe.piece_ids(piece)
            found = (",".join(map(str, ids)), ids)
            if len(piece) > CACHE_CHARS:
                return found
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    """One instance per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def digest_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; count and digests per row.

    A null text counts as empty: no ids, digests of the empty string. Rows map one to one, so repeated rows
    stay repeated and an empty table gives an empty table. Other input columns are not carried along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                parts = bpe.encoded(text.as_py() or "")
                ids = list(chain.from_iterable([p[1] for p in parts]))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", round_trip: bool = False) -> DataFrame:
    """Add `out_col` array<int> with the ids of every text, all other columns kept; null counts as empty.

    With round_trip the text column is replaced by what the ids decode to. A column already called `out_col` is replaced.
    """
    base = docs.drop(out_col)
    names = base.columns
    schema = base.select("*", F.lit(None).cast("array<int>").alias(out_col)).schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches):
            ids, ends, decoded = [], [0], []
            for t in batch.column(at):
                own = bpe.encode(t.as_py() or "")
                ids.append(np.array(own, np.int32))  # four bytes a token while the batch is held
                ends.append(ends[-1] + len(own))
                if round_trip:
                    decoded.append(bpe.decode(own))
            columns = list(batch.columns)
            if round_trip:
                columns[at] = pa.array(decoded, pa.string())
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*names, out_col])
        bpe.forget()

    return base.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The inverse: add or replace `out_col` with the text of the ids; null ids give an empty text."""
    base = df.drop(out_col)
    names = base.columns
    schema = base.select("*", F.lit(None).cast("string").alias(out_col)).schema
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out_col])

    return base.mapInArrow(run, schema)


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One column n_tokens (long) with the encoded length of every row's text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts = [sum([len(p[1]) for p in bpe.encoded(t.as_py() or "")]) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long")
