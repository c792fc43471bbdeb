"""Byte-level BPE encoding by the per-prefix dynamic program, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from larkspur.llm import bpe
from larkspur.llm import textbytes as tb
from larkspur.llm.store import free_name, small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Codec:
    """Exact ids of whole texts under a byte-level vocabulary, and the texts of ids."""

    def __init__(self, path: str):
        v = self.v = bpe.Vocabulary(path)
        encoder = bpe.PrefixEncoder(v)
        letters, numbers = bpe.letter_class()
        space = bpe.SPACE_CLASS
        self.pattern = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.special = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        self.pieces = bpe.Bounded(lambda p: self._pack(encoder.encode(p.encode().decode("latin-1"))))
        size = max([len(v.strings), *(i + 1 for i in v.special.values())])
        self.bytes_of = [s.encode("latin-1") for s in v.strings] + [b""] * (size - len(v.strings))
        for s, i in v.special.items():
            self.bytes_of[i] = s.encode()

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a special string in the text is one id."""
        if self.special is not None and "<|" in text and self.special.search(text):
            return b"".join(
                self._pack([self.v.special[part]]) if k % 2 else self._plain(part) for k, part in enumerate(self.special.split(text))
            )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids' text; ids cut inside a character give the replacement character, as the library does."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


@tb.memo
def codec(path: str) -> Codec:
    return Codec(path)


_FIELDS = (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the array of ids of each whole text. A null text has no ids (an empty array).

    A column of docs that is already named ids_col is replaced.
    """
    kept = [c for c in docs.columns if c != ids_col]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(free_name(kept, "__text")))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            packed = [c.encode_bytes(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=schema.names)

    return source.mapInArrow(tb.lean(run, codec), schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """coded with the text of each array of ids; a null array gives the empty text."""
    kept = [c for c in coded.columns if c != text_col]
    source = coded.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids_col}`").alias(free_name(kept, "__ids")))
    schema = coded.select(*(F.col(f"`{c}`") for c in kept)).schema.add(text_col, "string")

    small_batches(coded.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x.as_py() or []).decode() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(tb.lean(run, codec), schema)


def digest(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encodes, then decodes the ids, and keeps digests of both. A null text counts as empty."""
    names = [n for n, _ in _FIELDS]
    kept = [c for c in keep if c not in names]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(free_name(kept, "__text")))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for name, kind in _FIELDS:
        schema = schema.add(name, kind)

    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(batch.num_columns - 1):
                packed = c.encode_bytes(t.as_py() or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            found = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return source.mapInArrow(tb.lean(run, codec), schema)


def query(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, public_tokenizers.path("byte_bpe_50k.json"))
