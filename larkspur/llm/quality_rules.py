"""Host-level quality rules with an empirical beta prior.

Every document is measured by per-text rules; failures are counted by host, each host's failure
rate is shrunk toward the corpus by a beta prior fitted to the hosts themselves, and the verdict on the host is
joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from larkspur.llm import textbytes as tb
from larkspur.llm.store import cut, free_name, small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A host is rejected when its shrunk failure rate lies above this share.
MAX_HOST_RATE = 0.75
#: Bytes of texts that are measured at once: the arrays take some eighty times as much, and small ones are quicker.
CHUNK_BYTES = 512 << 10

_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def measure_chunk(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' measurements of each text of a chunk."""
    n = len(off) - 1
    starts, ends, cuts = tb.word_spans(buf, off)
    pre = tb.prefix(buf)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~(tb.continuation(buf) | tb.SPACE[buf]), out=points[1:])
    win, text = tb.windows(tb.spans(pre, starts, ends), cuts, 3)
    _, inverse, times = np.unique(tb.mix(win + tb.mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    covered = np.zeros(len(starts) + 1, np.int8)
    at = _window_starts(cuts, 3)[again]
    for i in range(3):
        covered[at + i] = 1
    lines = np.concatenate([np.flatnonzero(buf == 10), off[1:]])
    lines.sort(kind="stable")
    begin = np.concatenate([[0], lines[:-1] + (lines[:-1] < len(buf)) * (buf[np.minimum(lines[:-1], len(buf) - 1)] == 10)]) if len(buf) else np.zeros(len(lines), np.int64)
    owner = np.searchsorted(off, lines, "left") - 1
    begin = np.maximum(begin, off[np.maximum(owner, 0)])
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~tb.SPACE[buf], out=solid[1:])
    good = (lines > begin) & (solid[lines] > solid[np.minimum(begin, lines)])
    begin, lines, owner = begin[good], lines[good], owner[good]
    key = tb.mix(tb.spans(pre, begin, lines) + tb.mix(owner.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(key), np.int64)
    dup[first] = 0
    n_words = np.diff(cuts)
    repeat = np.concatenate([[0], np.cumsum(covered[:-1], dtype=np.int64)])
    n_repeat = repeat[cuts[1:]] - repeat[cuts[:-1]]
    return {
        "n_words": n_words,
        "word_chars": points[off[1:]] - points[off[:-1]],
        "n_symbols": tb.per_text(_SYMBOLS[buf], off),
        "n_dup_lines": np.bincount(owner, weights=dup, minlength=n).astype(np.int64)[:n],
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PCT * n_words),
    }


def _window_starts(cuts: np.ndarray, k: int) -> np.ndarray:
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    n = len(text)
    return np.flatnonzero(text[: n - k + 1] == text[k - 1 :]) if n >= k else np.zeros(0, np.int64)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the measurements to the columns in keep (all of docs by default).

    Null and empty texts have no words and fail. A column of docs named like a measurement is replaced by it.
    """
    names = {f.split()[0] for f in _FIELDS.split(", ")}
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    carried = text_col in kept  # a text that stays is not sent twice
    at = kept.index(text_col) if carried else len(kept)
    if not carried:
        source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(free_name(kept, "__text")))
    for field in _FIELDS.split(", "):
        schema = schema.add(*field.split())
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            parts = [measure_chunk(buf, off) for _, buf, off in tb.chunks(batch.column(at), CHUNK_BYTES)]
            if parts:
                found = [pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names=schema.names)

    return source.mapInArrow(tb.lean(run), schema)


def host_rates(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per host: n, failed, rate (shrunk), host_failed. Documents without a host have no verdict.

    The prior Beta(a, b) has the mean of all documents, and the strength that the method of moments gives over
    hosts: with n documents a host varies by mean (1 - mean) (1 / n + 1 / (a + b + 1)) about the mean.
    """
    hosts = cut(
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    total = hosts.agg((F.sum("failed") / F.sum("n")).alias("mean")).first()["mean"]
    mean = min(max(float(total or 0.0), 1e-6), 1 - 1e-6)
    rate = F.col("failed") / F.col("n")
    spread = hosts.agg(
        F.sum((rate - mean) * (rate - mean)).alias("var"), F.sum(1 / F.col("n")).alias("noise"), F.count(F.lit(1)).alias("hosts")
    ).first()
    base = mean * (1 - mean)
    between = ((spread["var"] or 0.0) - base * (spread["noise"] or 0.0)) / max(spread["hosts"], 1)
    strength = min(max(base / between - 1, 1.0), 1e6) if between > 0 else 1e6
    shrunk = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > MAX_HOST_RATE)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of each document, its host's shrunk rate and kept.

    Rows are measured alone, so repeated rows and repeated ids stay. A null host joins no verdict: its documents
    stand by the rules on their own text.
    """
    narrow = cut(measure(docs.withColumn("__host", F.col(f"`{host_col}`")), text_col, (*keep, "__host")))
    return _with_hosts(narrow, host_rates(narrow, "__host")).drop("__host")


def _with_hosts(measured: DataFrame, hosts: DataFrame) -> DataFrame:
    verdict = hosts.select(F.col("host").alias("__h"), F.col("rate").alias("host_rate"), "host_failed")
    joined = measured.join(verdict, F.col("__host") == F.col("__h"), "left").drop("__h")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were."""
    carried = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)))
    text, host = (f"__c{docs.columns.index(c)}" for c in (text_col, host_col))
    narrow = measure(carried.withColumn("__host", F.col(host)), text, ("__host",))
    hosts = host_rates(narrow, "__host")
    judged = _with_hosts(measure(carried.withColumn("__host", F.col(host)), text), hosts)
    return judged.where("kept").select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 4).alias("host_rate")
    )
