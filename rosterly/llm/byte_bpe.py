"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: every byte becomes one printable character, each piece is the
mapped form of its bytes with the negative rank as score, and normalisation is the identity. Pre-tokens (matches of the
split pattern) are encoded one by one; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, table, trimmed

SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
CACHE_SIZE, CACHED_LENGTH = 150_000, 48
#: The first character of the byte alphabet; the 256 that follow have no white space, mark or special meaning.
FIRST = 0x4E00


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _mapped(piece: bytes) -> str:
    return "".join(chr(FIRST + b) for b in piece)


def _field(number: int, kind: int, value: bytes) -> bytes:
    return bytes([number << 3 | kind]) + value


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised ModelProto of type BPE; id 0 is the unknown piece, other ids follow the order of ranks."""
    piece = lambda text, score, kind: _message(1, _message(1, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))
    pieces = [piece("<unk>", 0, 2)] + [piece(_mapped(p), -r, 1) for p, r in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces)))
    normalizer = _message(1, b"identity") + b"".join(_field(k, 0, b"\0") for k in (3, 4, 5))
    return b"".join(pieces) + _message(2, trainer) + _message(3, normalizer)


class Encoded(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers. Pieces of the vocabulary are looked up whole."""

    def __init__(self, ranks: dict[bytes, int], room: int):
        import sentencepiece

        self.ranks, self.room = ranks, room
        self.rank_of = [0, *sorted(ranks.values())]
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks)).encode

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else [self.rank_of[i] for i in self.encode(_mapped(raw))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= CACHED_LENGTH and len(self) < self.room:
            self[token] = packed
        return packed


def _pass(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared = Shared(docs.sparkSession, read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def coder(ranks):
        import regex

        return regex.compile(pattern).findall, Encoded(ranks, CACHE_SIZE).__getitem__, {r: p for p, r in ranks.items()}.__getitem__

    @trimmed
    def run(batches):
        split, ids_of, piece_of = shared.get(coder)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                counts, ids, texts = [], [], []
                for text in part.column("text"):
                    packed = b"".join(map(ids_of, split(text.as_py())))
                    decoded = b"".join(map(piece_of, np.frombuffer(packed, "<u4").tolist()))
                    counts.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest() if digest else packed)
                    texts.append(hashlib.sha256(decoded).hexdigest() if digest else decoded)
                kind = pa.string() if digest else pa.binary()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(texts, kind)], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

    return rows.mapInArrow(run, DIGEST if digest else SCHEMA)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the bytes decoded from them.

    A null text counts as empty: no ids. A null id stays null; repeated rows each give a row; an empty table gives an
    empty result; other columns are ignored. ranks_path is read on the driver; its size is that of a vocabulary.
    """
    return _pass(docs, ranks_path, pattern, id_col, text_col, digest=False)


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode with SHA-256 digests in place of the ids and the decoded bytes, taken inside the task."""
    return _pass(docs, ranks_path, pattern, id_col, text_col, digest=True)


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    return encode_digest(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
