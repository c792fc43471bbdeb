"""Fuzzy line dedup by MinHash, keeping one line of each component of similar lines.

Lines are the \\n-split parts of a text that hold a word. They are compared as sets of five-character shingles, with ASCII letters
lower-cased and outer white space cut off. Signatures of 128 values give 20 bands of 6; a line whose similar lines may be of
another number of bins has a signature of that number too. Lines that share a band are candidates, which exact Jaccard similarity decides. Components come from a distributed union-find, and of each the
first line by (id, line number) stays.

Equal lines are one line from the start, so only different texts are compared. Band keys travel packed by chunk and bucket, and
only keys that different lines share become rows. In a band of many lines each is first compared with its neighbour and with the smallest.
Where this leaves a band's lines in different components, all pairs between them are decided exactly, in blocks that are dealt
out: by a filter on the shingles at the head of the sets, and of the pairs it leaves by their Jaccard similarity. At similarity 0.8 a pair shares no band with probability 0.002.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from larkspur.llm import textbytes as tb
from larkspur.llm.graph import components
from larkspur.llm.ngram_join import _bucket, _pack40, _runs, _unpack40
from larkspur.llm.store import buckets_for, cut, drop, small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
VALUES, BANDS, ROWS = 128, 20, 6
#: Similarity as a share of 100.
PERCENT = 80
#: Keys and numbers that are sent to every executor at most.
BROADCAST_KEYS = 2_000_000
#: Where there are more, a map of so many bits for each, a power of two up to 2^MAP_BITS (64 MB) in all, stands for the keys; a task makes 2^PART_BITS of it.
KEY_BITS, MAP_BITS, PART_BITS = 8, 29, 20
#: Links that one task joins into components; more are joined in rounds.
EDGES_IN_TASK = 500_000
#: Lines of a crowded band that a task compares with as many others.
BLOCK = 512
_U = np.uint64
_FACTORS = tb.mix(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)
_TOKENS = tb.mix(np.arange(1, 65537, dtype=_U))
_TOKENS32, _FACTORS32 = (_TOKENS >> _U(32)).astype(np.uint32), (_FACTORS >> _U(32)).astype(np.uint32) | np.uint32(1)
_SALTS = tb.mix(np.arange(1, VALUES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def line_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span, a function of its bytes alone, eight of which are taken at a time."""
    if not len(begin):
        return np.zeros(0, _U)
    size = end - begin
    words = (size + 7) >> 3
    first = np.cumsum(words) - words
    place = np.arange(words.sum()) - np.repeat(first, words)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(_U), (len(low) + 1,), (1,))
    word = eight[np.repeat(begin, words) + 8 * place]
    word[first + words - 1] &= ~_U(0) >> (_U(8) * (8 * words - size).astype(_U))
    return tb.mix(np.add.reduceat(tb.mix(word ^ ((place + 1).astype(_U) * _U(0x9E3779B97F4A7C15))), first) + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def lines_of(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, text, number, hash) of each line with a word; start and end are without outer white space. low is in lower case."""
    starts, ends, _ = tb.word_spans(low, off)
    breaks = np.flatnonzero(low == 10)
    begin = np.concatenate([off[:-1], breaks + 1])
    begin.sort(kind="stable")
    text = np.searchsorted(off[1:], begin, "right")
    inside = np.flatnonzero(text < len(off) - 1)  # a break that ends the chunk begins no line
    begin, text = begin[inside], text[inside]
    first = np.searchsorted(starts, begin)
    last = np.concatenate([first[1:], [len(starts)]])
    some = np.flatnonzero(last > first)
    text = text[some]
    number = np.searchsorted(breaks, begin[some]) - np.searchsorted(breaks, off[text])
    begin, end = starts[first[some]], ends[last[some] - 1]
    return begin, end, text, number, line_hashes(low, begin, end)


def _points(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the spans, one after the other, and their offsets."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    if (begin[1:] >= end[:-1]).all():
        edge = np.zeros(len(low) + 1, np.int8)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        raw = low[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    else:
        raw = low[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
    head = np.concatenate([[0], np.cumsum(~tb.continuation(raw))])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4"), head[offsets]


def char_shingles(low: np.ndarray, begin: np.ndarray, end: np.ndarray, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-character shingles of each span, and their offsets; a shorter span is one shingle.

    Signatures take 32-bit hashes, which move half the memory; comparisons take 64-bit ones.
    """
    tokens, factors = (_TOKENS, _FACTORS) if kind is np.uint64 else (_TOKENS32, _FACTORS32)
    points, off = _points(low, begin, end)
    n = np.diff(off)
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(size)])
    if len(points) and points.max() >= 65535:
        token = tokens[np.minimum(points, 65535)]
        rare = np.flatnonzero(points >= 65535)
        token[rare] = tb.mix(points[rare].astype(_U) + _U(1)).astype(kind)
    else:
        token = tokens[points]
    rolled, term = token * factors[0], np.empty(len(points), kind)
    for i in range(1, SHINGLE):
        at = max(0, len(points) - i)
        np.multiply(token[i:], factors[i], out=term[:at])
        rolled[:at] += term[:at]
    keep = np.ones(len(points), bool)
    long = n >= SHINGLE
    for i in range(1, SHINGLE):
        keep[off[1:][long] - i] = False
    short = np.flatnonzero(~long)
    for at in short:  # the whole span, which is marked by its length
        i, j = off[at], off[at + 1]
        rolled[i] = ((token[i:j] * factors[: j - i]).sum(dtype=_U) + _U(j - i)).astype(kind)
        keep[i + 1 : j] = False
    return rolled[keep], offsets


def _bins(size: np.ndarray) -> np.ndarray:
    return np.where(size < 48, 1, 2 ** np.floor(np.log2(np.clip(size // 3, 8, VALUES))).astype(np.int64))


def signatures(hashes: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures, VALUES columns, and the span of each.

    A span of few shingles has a hash function for each value; a span of n has one for every n / 3 values at most, the
    values being the least of its hashes in as many bins. Only signatures of one number of bins can agree, so a span has one
    for each number that a similar span of its size or larger may have. Sizes count different shingles.
    """
    count = len(offsets) - 1
    both = np.sort(np.repeat(np.arange(count, dtype=_U) << _U(32), np.diff(offsets)) | hashes.astype(_U))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    offsets = np.searchsorted(both, np.arange(count + 1, dtype=_U) << _U(32))
    hashes, size = both.astype(np.uint32), np.diff(offsets)
    least, most = _bins(size), _bins(-(-size * 100 // percent) + 1)
    full, salts = np.uint32(2**32 - 1), (_SALTS >> _U(32)).astype(np.uint32)
    signed, spans = [np.zeros((0, VALUES), np.uint32)], [np.zeros(0, np.int64)]
    for b in np.unique(np.concatenate([least, most])):
        some = (least <= b) & (b <= most)
        mine = np.flatnonzero(some)
        length = size[mine]
        starts = np.cumsum(length) - length
        h = hashes[np.repeat(some, size)]
        count = len(mine)
        row = np.repeat(np.arange(count) * b, length) if b > 1 else None
        part = np.empty((count, VALUES), np.uint32)
        for k in range(VALUES // b):
            x = h ^ salts[k]
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            if b == 1:
                part[:, k] = np.minimum.reduceat(x, starts)
                continue
            low = np.full(count * b, full)
            np.minimum.at(low, row + (x >> np.uint32(33 - int(b).bit_length())), x)
            low = low.reshape(-1, b)
            empty = low == full
            if empty.any():  # an empty bin takes the next full one, marked by the distance
                column = np.where(empty, 4 * b, np.arange(b))
                ahead = np.minimum.accumulate(np.concatenate([column, column + b], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :b]
                away = ahead - np.arange(b)
                low = np.take_along_axis(low, ahead % b, axis=1) + away.astype(np.uint32) * np.uint32(0x9E3779B1)
            part[:, k * b : (k + 1) * b] = low
        signed.append(part)
        spans.append(mine)
    return np.concatenate(signed), np.concatenate(spans)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = ROWS
    out = np.zeros((len(sig), BANDS), _U)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, _U)
        for r in range(rows):
            key = tb.mix(key ^ sig[:, b * rows + r].astype(_U)) + _U(r)
        out[:, b] = (tb.mix(key) & ~_U(1)) | _U(b == 0)  # the last bit marks the first band
    return out


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text"))


def candidates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of hashes of lines that share a band; a = b where a line occurs more than once.

    Where crowd is set, b is a line of the band a, which has pairs of lines that are not among these.
    """
    buckets = buckets_for(docs)

    def sign(batches):
        for batch in batches:
            for _, buf, off in tb.chunks(batch.column(0)):
                low = tb.lowered(buf)
                begin, end, _, _, hashes = lines_of(low, off)
                ids, pick, times = np.unique(hashes, return_index=True, return_counts=True)
                if not len(ids):
                    continue
                place = np.argsort(pick)
                ids, pick, times = ids[place], pick[place], times[place]
                signed, span = signatures(*char_shingles(low, begin[pick], end[pick], np.uint32), percent)
                keys, ids, more = band_keys(signed), ids[span], times[span] > 1
                keys, ids = np.concatenate([keys.ravel(), keys[more, 0]]), np.concatenate([np.repeat(ids, BANDS), ids[more]])
                order = np.argsort(keys)
                keys, ids = keys[order], ids[order]
                edge = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                packed = _pack40(keys)
                some = [b for b in range(buckets) if edge[b + 1] > edge[b]]
                blob = [packed[edge[b] : edge[b + 1]].tobytes() + ids[edge[b] : edge[b + 1]].tobytes() for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "blob"])

    def meet(rows: pa.Table) -> pa.Table:
        keys, ids = [], []
        for blob in rows.column("blob"):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            n = len(raw) // 13
            keys.append(_unpack40(raw[: 5 * n]))
            ids.append(raw[5 * n :].copy().view("<u8"))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        met = np.zeros(len(keys) + 1, bool)  # most keys are of one line alone
        met[1:-1] = keys[1:] == keys[:-1]
        met = met[1:] | met[:-1]
        keys, ids = keys[met], ids[met]
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        again = np.unique(ids[~new & (keys & _U(1) == 1)])
        keys, ids = keys[new], ids[new]
        start, size = _runs(keys)
        first = np.repeat(start, size)
        later = np.flatnonzero(np.arange(len(keys)) > first)
        a = np.concatenate([ids[later], ids[later]])
        b = np.concatenate([ids[later - 1], ids[first[later]]])
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), _U)
        wide = np.flatnonzero(size > 3)  # of three lines all pairs are there
        member = np.repeat(start[wide] - (np.cumsum(size[wide]) - size[wide]), size[wide]) + np.arange(size[wide].sum())
        name = tb.mix(np.add.reduceat(tb.mix(ids), start)[wide]) if len(wide) else np.zeros(0, _U)  # bands of the same lines are one
        a, b = (np.concatenate([x, again, y]).view(np.int64) for x, y in zip(pair, (np.repeat(name, size[wide]), ids[member])))
        return pa.table({"a": a, "b": b, "crowd": np.arange(len(a)) >= len(a) - len(member)})

    signed = docs.select("text").mapInArrow(tb.lean(sign), "bucket int, blob binary")
    return signed.groupBy("bucket").applyInArrow(meet, "a long, b long, crowd boolean").distinct()


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    sets = []
    for _, buf, off in tb.chunks(texts):
        h, cuts = char_shingles(buf, off[:-1], off[1:])
        new = np.ones(len(h), bool)
        ends = cuts.tolist()
        for i, j in zip(ends, ends[1:]):
            h[i:j].sort()
        new[1:] = h[1:] != h[:-1]
        new[cuts[:-1]] = True
        for i, j in zip(ends, ends[1:]):
            sets.append(h[i:j][new[i:j]])
    return sets


def similar(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of pairs(a, b, text_a, text_b) whose shingle sets are similar enough."""

    def compare(batches):
        for batch in batches:
            sides = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("text_a", "text_b")]
            fresh = list(dict.fromkeys(sides[0] + sides[1]))
            known = dict(zip(fresh, shingle_sets(pa.array(fresh, pa.string()))))
            ok = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*sides)):
                x, y = known[a], known[b]
                if len(x) < len(y):
                    x, y = y, x
                if 100 * len(y) >= percent * len(x):
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tb.lean(compare), "a long, b long")


def _alike(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of sets is similar enough to each of others."""
    n, size = len(sets), np.array([len(x) for x in sets + others])
    _, column, times = np.unique(np.concatenate(sets + others), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    every = times == len(size)  # shingles that all have or only one has need no table
    some = np.flatnonzero((times > 1) & ~every)
    place = np.full(len(times), -1)
    place[some] = np.arange(len(some))
    at = place[column]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    both = np.full((n, len(others)), float(every.sum()))
    for low in range(0, len(some), 2048):
        i, j = np.searchsorted(at, [low, low + 2048])
        table = np.zeros((len(size), 2048), np.float32)
        table[row[i:j], at[i:j] - low] = 1
        both += table[:n] @ table[n:].T
    return 100 * both >= percent * (size[:n, None] + size[None, n:] - both)


#: Lines of small crowded bands that one task takes together, about; entries looked at together.
BATCH, SLICE = 4096, 1 << 20
#: From this share of all pairs on, comparing all pairs in a table is quicker than comparing those left one by one.
DENSE = 8


def _unruled(i: np.ndarray, j: np.ndarray, size: np.ndarray, owner: np.ndarray, column: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that maps of the sets leave: a bit that only one set has stands for an element or more that the other lacks."""
    if not len(i):
        return i, j
    words = 1 << int(np.clip(np.ceil(np.log2(3 * size.mean() / 64 + 1)), 1, 8))
    bit = tb.mix(column.astype(_U)) & _U(64 * words - 1)
    maps = np.zeros(len(size) * words, _U)
    np.bitwise_or.at(maps, owner * words + (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    maps, ok = maps.reshape(-1, words), np.zeros(len(i), bool)
    for at in range(0, len(i), SLICE // words):
        a, b = i[at : at + SLICE // words], j[at : at + SLICE // words]
        x, y = maps[a], maps[b]
        differ = x ^ y
        most = np.minimum(*(size[k] - np.bitwise_count(differ & z).sum(axis=1, dtype=np.int64) for k, z in ((a, x), (b, y))))
        ok[at : at + len(a)] = (100 + percent) * most >= percent * (size[a] + size[b])
    return i[ok], j[ok]


def crossing(sets: list[np.ndarray], second: np.ndarray | None, of: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of components (of) that have similar sets, one of either side where second says which sets are on the other side.

    Two similar sets share a shingle of each one's head, in an order with the rarest first, and have behind it all that they share, which
    must reach percent / (100 + percent) of their sizes together. Only pairs that pass, and that maps of the sets don't rule out, are compared.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarest = np.argsort(times, kind="stable")
    rank, step = np.empty(len(times), np.int64), len(times)
    rank[rarest] = np.arange(step)
    held = owner * step + rank[column]
    held.sort()
    column, times = held - owner * step, times[rarest]
    n, left = size[owner], size[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))
    shared, most = times[column] > 1, (100 + percent) * left // percent - n  # most: the largest set that may share enough from here on
    asks, lists = np.flatnonzero(shared & (100 * left >= percent * n)), np.flatnonzero(shared & (most >= n))
    wide = int(size.max()) + 2
    key = column[lists] * wide + n[lists]
    by = np.argsort(key, kind="stable")
    lists, key = lists[by], key[by]
    low = np.searchsorted(key, column[asks] * wide - -n[asks] * percent // 100)
    high = np.searchsorted(key, column[asks] * wide + np.minimum(n[asks], most[asks]), "right")
    many = np.maximum(high - low, 0)
    found, at = [np.zeros(0, np.int64)], 0
    ends = np.cumsum(many)
    while at < len(asks):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        c = many[at:stop]
        a = np.repeat(asks[at:stop], c)
        b = lists[np.repeat(low[at:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        i, j = owner[a], owner[b]
        ok = (of[i] != of[j]) & (n[a] <= most[b])
        if second is not None:
            ok &= second[i] != second[j]
        found.append(np.unique(np.maximum(i, j)[ok] * len(sets) + np.minimum(i, j)[ok]))
        at = stop
    i, j = np.divmod(np.unique(np.concatenate(found)), len(sets))
    i, j = _unruled(i, j, size, owner, column, percent)
    sides = (np.arange(len(sets)),) * 2 if second is None else (np.flatnonzero(~second), np.flatnonzero(second))
    if DENSE * len(i) > len(sides[0]) * len(sides[1]):
        one, two = sides
        i, j = np.nonzero(_alike([sets[x] for x in one], [sets[x] for x in two], percent) & (of[one][:, None] != of[two][None, :]))
        i, j = one[i], two[j]
    elif len(i):
        start, ok = np.cumsum(size) - size, np.zeros(len(i), bool)
        ends, at = np.cumsum(size[j]), 0
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            a, b = i[at:stop], j[at:stop]
            first = np.cumsum(size[b]) - size[b]
            ask = np.repeat(a, size[b]) * step + column[np.repeat(start[b] - first, size[b]) + np.arange(size[b].sum())]
            both = np.add.reduceat((held[np.minimum(np.searchsorted(held, ask), len(held) - 1)] == ask).astype(np.int64), first)
            ok[at:stop] = 100 * both >= percent * (size[a] + size[b] - both)
            at = stop
        i, j = i[ok], j[ok]
    return np.unique(np.stack([of[i], of[j]]), axis=1) if len(i) else np.zeros((2, 0), np.int64)


def taken_together(lines: DataFrame, count: DataFrame) -> DataFrame:
    """(band, component, line, n, total) of lines in bands, each band's largest component being main: bands of one main are one band, named main, if the square of
    its lines is no more than the sum of theirs. A line that meets the same others in many bands then meets them once. count(main, n, total) is
    lines by band and component."""
    square = F.col("total").cast("double") * F.col("total")
    apart = count.groupBy("main").agg(F.sum(F.col("n").cast("double") * F.col("total")).alias("apart"))
    once = cut(lines.select("main", "component", "line").distinct())
    n = once.groupBy("main", "component").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("main").agg(F.sum("n").alias("total")).join(apart, "main").where(square <= F.col("apart")).drop("apart")
    n = cut(n.join(total, "main"))
    one = once.join(n, ["main", "component"]).select(F.col("main").alias("band"), "component", "line", "n", "total")
    return cut(one.union(lines.join(n.select("main").distinct(), "main", "left_anti").select("band", "component", "line", "n", "total")))


def _dealt(large: DataFrame) -> DataFrame:
    """(unit, block, sides, component, line): the blocks of each large band, each with each other."""
    own = F.xxhash64("component", F.pmod(F.xxhash64("line"), F.ceil(F.col("n") / BLOCK)))
    shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("total") / BLOCK))
    large = large.withColumn("block", F.when(F.col("n") >= BLOCK, own).otherwise(shared)).select("band", "block", "component", "line")
    blocks = large.groupBy("band", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = blocks.select("band", *(F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi")))
    work = blocks.join(other, "band").where("block <= block2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    work = work.select(F.xxhash64("band", "block", "block2").alias("unit"), "band", F.expr("block <> block2").alias("sides"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return large.join(work, ["band", "block"]).select("unit", "block", "sides", "component", "line")


def joined_crowds(crowds: DataFrame, parts: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """parts(line, component) joined by the similar pairs of different components in each band of crowds(a, b).

    Small bands that have their smallest line in common are taken together, a batch of them in a task, so that a line that meets others in many bands is read once.
    Large bands that have their largest component in common are taken as one, if that leaves fewer pairs. The lines of a large band are dealt into blocks,
    of one large component or of several small ones; each block meets each other, but for two blocks of one component.
    """
    lines = crowds.select(F.col("a").alias("band"), F.col("b").alias("line")).join(parts, "line", "left")
    lines = cut(lines.withColumn("component", F.coalesce("component", "line")))
    count = lines.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    total = count.groupBy("band").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first")).where("kinds > 1")
    count = cut(count.drop("first").join(total, "band").drop("kinds"))
    held = count.agg(F.sum(F.when(F.col("total") <= 2 * BLOCK, F.col("n"))).alias("small"), F.max("total").alias("most"), F.count(F.lit(1)).alias("all")).first()
    if not held["all"]:
        return parts
    lines = cut(lines.join(count, ["band", "component"]))
    batches = -(-(held["small"] or 0) // BATCH) or 1
    batch = F.pmod(F.xxhash64("first"), F.lit(batches))
    together = lines.where(F.col("total") <= 2 * BLOCK).select(batch.alias("unit"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("sides"), "component", "line").distinct()
    if held["most"] > 2 * BLOCK:
        large = count.where(F.col("total") > 2 * BLOCK)
        main = cut(large.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main")))
        together = together.union(_dealt(taken_together(lines.join(main, "band"), large.join(main, "band"))))
    members = together.join(texts, "line").select("unit", "block", "sides", "component", "line_text")

    def compare(rows: pa.Table) -> pa.Table:
        sets = shingle_sets(rows.column("line_text"))
        side, of = np.asarray(rows.column("block")), np.asarray(rows.column("component"))
        pair = crossing(sets, side != side[0] if rows.column("sides")[0].as_py() else None, of, percent)
        return pa.table({"a": pair[0], "b": pair[1]})

    found = cut(members.groupBy("unit").applyInArrow(compare, "a long, b long"))
    if not found.limit(1).count():
        return parts
    up = cut(components(found, in_task=EDGES_IN_TASK).withColumnRenamed("component", "to"))
    alone = up.select(F.col("node").alias("line"), F.col("node").alias("component")).join(parts, "line", "left_anti")
    every = parts.union(alone)
    return cut(every.join(up, every["component"] == up["node"], "left").select("line", F.coalesce("to", "component").alias("component")))


def _marks(lines: DataFrame, count: int) -> np.ndarray:
    """A map with a bit set at the head of each line's hash, in bytes: rules out most other lines, and none of these, whatever their number."""
    bits = int(np.clip(np.ceil(np.log2(KEY_BITS * max(count, 1))), 3, MAP_BITS))
    part = min(bits, PART_BITS)

    def mark(rows: pa.Table) -> pa.Table:
        place = np.asarray(rows.column("place"))
        held = np.zeros(1 << part, bool)
        held[place & ((1 << part) - 1)] = True
        return pa.table({"part": pa.array([place[0] >> part], pa.int64()), "marks": pa.array([np.packbits(held).tobytes()], pa.binary())})

    place = F.shiftrightunsigned("line", 64 - bits)
    parts = lines.select(place.alias("place"), F.shiftright(place, part).alias("part")).groupBy("part").applyInArrow(mark, "part long, marks binary")
    marks = np.zeros((1 << (bits - part), (1 << part) // 8), np.uint8)
    for row in parts.toLocalIterator():
        marks[row["part"]] = np.frombuffer(row["marks"], np.uint8)
    return marks.ravel()


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(_U) >> _U(65 - (8 * len(marks)).bit_length())
    return (marks[(place >> _U(3)).astype(np.int64)] << (place & _U(7)).astype(np.uint8)) & np.uint8(128) > 0


def _places(among):
    """Gives (line, id, key, number, line_text) of the lines whose hashes are in the broadcast among, sorted hashes or, in bytes, a map of them.

    Of equal lines close to each other one has the text, the others null.
    """

    def places(batches):
        for batch in batches:
            for first, buf, off in tb.chunks(batch.column(1)):
                low = tb.lowered(buf)
                begin, end, text, number, hashes = lines_of(low, off)
                hashes = hashes.view(np.int64)
                known = among.value
                if known.dtype == np.uint8:
                    some = np.flatnonzero(_marked(known, hashes))
                else:
                    some = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
                begin, end, text, number, hashes = (x[some] for x in (begin, end, text, number, hashes))
                lines, raw = np.full(len(hashes), None, object), low.tobytes()
                once = np.unique(hashes, return_index=True)[1]
                lines[once] = [raw[i:j] for i, j in zip(begin[once].tolist(), end[once].tolist())]
                at = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), batch.column(0).take(at), batch.column(2).take(at), pa.array(number), pa.array(lines, pa.binary()).cast(pa.string())],
                    names=["line", "id", "key", "number", "line_text"],
                )

    return places


def dropped_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, dropped): the sorted numbers of the lines that go, for each document that loses any.

    key is a hash of id and text. The first line by (id, key, number), null ids last, of a component stays. Rows equal in id and
    text are one document: they lose the same lines.

    Texts of lines are dealt out once, into buckets by line, where each comparison finds them. A line that a map of many keys lets through
    by chance stands once and is in no pair, so it goes with those that are in no component.
    """
    rows = _numbered(docs, id_col, text_col)
    met = cut(candidates(rows, percent))
    pairs, crowds = met.where("not crowd").drop("crowd"), met.where("crowd").drop("crowd")
    ends = cut(pairs.select(F.col("a").alias("line")).union(pairs.where("a <> b").select("b")).distinct())
    count = ends.count()
    known = np.sort(np.asarray(ends.toArrow().column(0))) if count <= BROADCAST_KEYS else _marks(ends, count)
    drop(ends)
    among = docs.sparkSession.sparkContext.broadcast(known)
    places = cut(rows.select("id", "text", "key").mapInArrow(tb.lean(_places(among)), "line long, id long, key long, number long, line_text string"))
    among.destroy()
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key", "number")
    seen = cut(places.groupBy("line").agg(F.min(order).alias("lo"), F.count(F.lit(1)).alias("times"), F.min("line_text").alias("line_text")), by="line")
    texts = seen.select("line", "line_text")
    first = texts.select(F.col("line").alias("a"), F.col("line_text").alias("text_a"))
    second = texts.select(F.col("line").alias("b"), F.col("line_text").alias("text_b"))
    linked = cut(similar(pairs.where("a <> b").join(first, "a").join(second, "b"), percent))
    parts = cut(components(linked, in_task=EDGES_IN_TASK).select(F.col("node").alias("line"), "component"))
    parts = joined_crowds(crowds, parts, texts, percent)
    drop(met)
    lines = seen.join(parts, "line", "left").where("times > 1 or component is not null").select("line", "lo", F.coalesce("component", "line").alias("component"))
    lines = cut(lines)
    drop(seen)
    stay = lines.groupBy("component").agg(F.min("lo").alias("stay"))
    stay = cut(lines.join(stay, "component").select("line", F.col("stay.key").alias("stay_key"), F.col("stay.number").alias("stay_number")))
    gone = places.select("line", "key", "number").join(stay, "line").where("key <> stay_key or number <> stay_number")
    gone = cut(gone.groupBy("key").agg(F.array_sort(F.collect_set("number")).alias("dropped")))
    drop(places)
    return gone


_SOLID = re.compile(r"[^\x20\x09-\x0D]")


def _without(batches):
    """Takes the lines in the second column out of the texts in the first, and adds the number of lines with a word before
    and whether any is left; the rest of a row stays."""
    for batch in batches:
        names = batch.schema.names
        out, before, left = [], [], []
        for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = (t or "").split("\n")
            solid = [i for i, line in enumerate(lines) if _SOLID.search(line)]
            if d:
                gone = set(d)
                t = "\n".join([line for i, line in enumerate(lines) if i not in gone])
            out.append(t)
            before.append(len(solid))
            left.append(len(solid) > len(d or ()))
        columns = [pa.array(out, pa.string()), *batch.columns[2:], pa.array(before, pa.int64()), pa.array(left, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[names[0], *names[2:], "__before", "__left"])


def _joined(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    gone = dropped_lines(docs, percent, id_col, text_col).withColumnRenamed("key", "__key")
    held = gone.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("dropped")).alias("m")).first()
    if held["n"] + (held["m"] or 0) <= BROADCAST_KEYS:  # else the texts are dealt out by key
        gone = F.broadcast(gone)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    i, t = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = rows.withColumn("__key", F.xxhash64(F.col(i).cast("long"), F.col(t)))
    return rows.join(gone, "__key", "left").drop("__key"), names


def dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the texts. A document that loses all its lines goes; one that had
    none (null, empty or blank) stays as it is. Other columns stay."""
    joined, names = _joined(docs, percent, id_col, text_col)
    t = names[docs.columns.index(text_col)]
    rest = [n for n in names if n != t]
    rows = joined.select(t, "dropped", F.col("dropped").isNotNull().alias("__lost"), *rest)
    schema = rows.drop("dropped").schema.add("__before", "long").add("__left", "boolean")
    back = rows.mapInArrow(tb.lean(_without), schema).where(~F.col("__lost") | F.col("__left"))
    return back.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def query(spark, sf_dir):
    """(doc_id, n_lines, n_dropped, dropped, kept_sha256): lines with a word, those that go, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined, (i, t) = _joined(docs, PERCENT, "doc_id", "text")
    kept = joined.select(t, "dropped", i, F.coalesce("dropped", F.array().cast("array<bigint>")).alias("d"))
    schema = kept.drop("dropped").schema.add("__before", "long").add("__left", "boolean")
    return kept.mapInArrow(tb.lean(_without), schema).select(
        F.col(i).alias("doc_id"), F.col("__before").alias("n_lines"), F.size("d").cast("long").alias("n_dropped"),
        F.col("d").alias("dropped"), F.sha2(F.coalesce(F.col(t), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
