"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to all tasks; tier two is a cache
in each Python worker for the pre-tokens that tier one misses. No pre-token is ever shuffled: the job is one scan.

Counts equal the library's for whole texts. A text may be cut into pre-tokens only where no merge can cross, which
``_cuts`` proves from the vocabulary; where it can't, the unit is the whole text.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, table

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Pre-tokens in tier one, texts read on the driver to choose them (which affects speed alone), entries of a worker's
#: cache, and the longest pre-token that is cached.
TABLE_SIZE, SAMPLE_TEXTS, CACHE_SIZE, CACHED_LENGTH = 50_000, 400, 400_000, 48
MARK = "▁"
#: Appended to a serialised model it merges into its normalizer_spec: add_dummy_prefix = false.
NO_PREFIX = b"\x1a\x02\x18\x00"


def _cuts(sp) -> bool:
    """Whether texts may be cut before each run of marks and around line breaks: no piece spans such a place and the
    normalisation leaves text as it is. Byte pieces stand for one byte each and never merge."""
    if sp.normalize("ﬁ① Á ") != f"{MARK}ﬁ①{MARK}Á{MARK}":
        return False
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)


class Units(dict):
    """Pre-token -> token count; a missing one is encoded, and kept while the cache has room."""

    def __init__(self, blob: str, lengths: bytes, encode, room: int):
        super().__init__(zip(blob.split("\n\n") if blob else (), lengths))
        self.encode, self.room = encode, len(self) + room

    def __missing__(self, unit: str) -> int:
        n = len(self.encode(unit))
        if len(unit) <= CACHED_LENGTH and len(self) < self.room:
            self[unit] = n
        return n


#: A line break is a pre-token of its own; others are a run of marks with what follows it up to the next mark or break.
UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def _loaded(model: bytes, cut: bool):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX if cut else model)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE, sample_texts: int = SAMPLE_TEXTS, cache_size: int = CACHE_SIZE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    model_path: a sentencepiece .model or a tokenizers .json file; the driver reads it. Counts exclude begin, end and
    other added tokens; special strings inside texts are handled as the library does by default.
    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a row; an empty
    table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with open(model_path, "rb") as f:
        model = f.read()
    if os.path.splitext(model_path)[1] == ".json":
        shared = Shared(spark, ("json", model, False, "", b""))
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        cut = _cuts(sp)
        blob, lengths = "", b""
        if cut:
            coder, seen = _loaded(model, True), Counter()
            for r in rows.select("text").where(F.length("text") <= 1_000_000).limit(sample_texts).collect():
                seen.update(UNIT.findall(MARK + r.text.replace(" ", MARK)))
            frequent = [u for u, _ in seen.most_common(table_size) if "\n" not in u and len(u) <= CACHED_LENGTH]
            sized = [(u, n) for u in frequent if (n := len(coder.encode(u))) < 256]
            blob, lengths = "\n\n".join(u for u, _ in sized), bytes(n for _, n in sized)
        shared = Shared(spark, ("model", model, cut, blob, lengths))

    def counter(value):
        kind, model, cut, blob, lengths = value
        if kind == "json":
            from tokenizers import Tokenizer

            coder = Tokenizer.from_str(model.decode())
            coder.no_truncation()
            coder.no_padding()
            return lambda text: len(coder.encode(text, add_special_tokens=False).ids)
        encode = _loaded(model, cut).encode
        if not cut:
            return lambda text: len(encode(text))
        look = Units(blob, lengths, encode, cache_size).__getitem__
        return lambda text: sum(map(look, UNIT.findall(MARK + text.replace(" ", MARK)))) if text else 0

    def run(batches):
        count = shared.get(counter)
        for b in batches:
            n_bytes, n_tokens = [], []
            for text in b.column("text"):
                text = text.as_py()
                n_bytes.append(len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, SCHEMA)


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
