"""Token counts under a word-end vocabulary by the whole-token shortcut.

Vocabulary.whole proves, without any text, which vocabulary strings encode alone as one token. A pre-token that is
such a string counts one at once; only the rest goes through the merges.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from larkspur.llm import bpe
from larkspur.llm.store import free_name, small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048


class Counter:
    """Counts tokens of whole texts as the vocabulary's own library does, without added special tokens.

    Texts with characters that only the library's Unicode tables know are normalised by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        v = self.v = bpe.Vocabulary(path)
        encoder = bpe.PrefixEncoder(v)
        self.newer, kinds = bpe.newer_characters()
        self.normalizer = Tokenizer.from_file(path).normalizer
        letters, numbers = bpe.letter_class(kinds)
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{bpe.SPACE_CLASS}{letters}{numbers}]+")
        self.special = re.compile("|".join(map(re.escape, v.special)))
        suffix = bpe.END if v.suffix else 0

        def marked(piece: str) -> str:
            raw = piece.encode().decode("latin-1")
            return raw[:-1] + chr(ord(raw[-1]) + suffix)

        def count(piece: str) -> int:
            raw = marked(piece)
            return len(v.merge(raw) if len(raw) <= 48 else encoder.encode(raw))

        whole = {}
        for i in v.whole:
            s = v.strings[i]
            if not suffix or ord(s[-1]) >= suffix:
                try:
                    whole[(s[:-1] + chr(ord(s[-1]) - suffix)).encode("latin-1").decode()] = 1
                except UnicodeDecodeError:
                    pass  # part of a character; no pre-token is such a string
        self.counts = bpe.Bounded(count, whole, 600_000)

    def count(self, text: str) -> int:
        if "<|" in text and self.special.search(text):
            return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text.isascii():
            if not self.newer.isdisjoint(text):
                return sum(map(self.counts.__getitem__, self.pattern.findall(self.normalizer.normalize_str(text))))
            # each character is lowered by itself, so a capital sigma never takes its final form
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.counts.__getitem__, self.pattern.findall(text.lower())))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...], text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns in keep with n_bytes, n_tokens and over_limit of each whole text.

    A null text counts as empty: no bytes, no tokens, not over. Rows are independent; repeated rows stay. A column in keep that is
    named like a result is replaced by it. Texts of any length are counted whole; there are no ties.
    """
    results = (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean"))
    kept = [F.col(f"`{c}`") for c in keep if c not in dict(results)]
    schema = docs.select(*kept).schema
    source = docs.select(*kept, F.col(f"`{text_col}`").alias(free_name(keep, "__text")))
    for name, kind in results:
        schema = schema.add(name, kind)

    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(path).count
        for batch in batches:
            text = pc.fill_null(batch.column(batch.num_columns - 1), "")
            tokens = pa.array([count(t.as_py()) for t in text], pa.int64())
            found = [pc.binary_length(text).cast(pa.int64()), tokens, pc.greater(tokens, limit)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), ("doc_id",))
