"""N-gram Jaccard join with a token-group matrix: links of documents whose 5-word shingle sets are similar.

1. A sieve over all texts counts, for every document, the shingles that some other document has too. A document with fewer
   than threshold * size of them has no partner. Only fingerprints move, packed by chunk and bucket; a
   fingerprint that two shingles share can only let a document through.
2. What is left becomes classes of equal sets. Similar classes meet in groups, keyed by two min-hashes of the set; a large
   group is cut into parts of bounded size that share one pivot. Inside a part all links are found. Components that share a
   min-hash are linked by one class of each. The components so far, in blocks of bounded size, are the groups of the token-group
   matrix, which holds each block's token union.
3. A class is a query against the blocks of other components. Classes that share too few of their tokens with others are left out,
   the rest have their tokens in one order, rarest first. A block lists the tokens at the head of its members' sets, each with the sizes of the sets
   that may reach the threshold with such a member; a query meets a block in a token at the head of its own set if its size and what is left of it after the
   token allow for it. The tokens that the block's union lacks are the second bound, and only then is the block opened and its members compared exactly.

Step 3 covers every pair that step 2 has not linked, so no link is lost. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from larkspur.llm import textbytes as tb
from larkspur.llm.graph import components
from larkspur.llm.store import buckets_for, cut, drop, small_batches
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
#: Similarity as a share of 100: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Classes of a part of a group, about; keys that are sent to every executor at most.
PART_ROWS, BROADCAST_KEYS = 1_024, 4_000_000
_CHUNK_DOCS = 60_000
#: Words of 64 bits in the bit map of a set.
BIT_WORDS = 16
#: Classes of sizes in which queries and blocks meet, for each factor e.
SIZE_CLASSES = 10
_MINHASHES = ("mh1", "mh2", "mh3", "mh4")
_U = np.uint64


def shingles(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different k-word shingles of each text, sorted by hash, then text.

    A text of fewer words is one shingle, of all its words; a text without words has none.
    """
    low = tb.lowered(buf)
    starts, ends, cuts = tb.word_spans(low, off)
    words = tb.spans(tb.prefix(low), starts, ends)
    found, text = tb.windows(words, cuts, k)
    size = np.diff(cuts)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.zeros(len(short), _U)
        for i in range(k - 1):
            has = size[short] > i
            at = np.where(has, cuts[short] + i, 0)
            whole += np.where(has, tb.mix(words[at] + _U(0xA0761D6478BD642F * (i + 1) % 2**64)) * _U(2 * i + 3), _U(0))
        found = np.concatenate([found, tb.mix(whole + size[short].astype(_U))])
        text = np.concatenate([text, short])
    order = np.lexsort((text, found))
    found, text = found[order], text[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        found, text = found[new], text[new]
    return found, text


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_)]]))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n)) >> _U(32)


def _pack40(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unpack40(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view("<u8").ravel()


def _signatures(found: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x1234567, 0x7654321):
        sums = np.zeros(n, _U)
        np.add.at(sums, text, tb.mix(found ^ _U(salt)))
        out.append(sums.view(np.int64))
    return tuple(out)


def sieve(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, key, n, sig1, sig2, near) per row of docs(id, text, key): the set's size and signature, and whether
    enough of its shingles occur in other rows for it to have a partner."""
    buckets = buckets_for(docs)

    def ask(batches):
        part, seq = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for at in range(0, max(len(ids), 1), _CHUNK_DOCS):
                for first, buf, off in tb.chunks(batch.column(1).slice(at, _CHUNK_DOCS)):
                    first, n = first + at, len(off) - 1
                    found, text = shingles(buf, off)
                    chunk, seq = part | seq, seq + 1
                    start, times = _runs(found)
                    single = np.zeros(len(found), bool)
                    single[start[times == 1]] = True
                    size = np.bincount(text, minlength=n)
                    local = size - np.bincount(text[single], minlength=n)
                    sig1, sig2 = _signatures(found, text, n)
                    head = pa.table(
                        {"id": ids[first : first + n], "key": keys[first : first + n], "n": size, "sig1": sig1, "sig2": sig2, "shared": local}
                    ).combine_chunks()
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, head.schema) as out:
                        out.write_table(head)
                    one, two = found[single], found[start[times > 1]]
                    who = text[single].astype("<u2")
                    to_one, to_two = _bucket(one, buckets), _bucket(two, buckets)
                    cut1, cut2 = (np.searchsorted(x, np.arange(buckets + 1)) for x in (to_one, to_two))
                    p1, p2 = _pack40(one), _pack40(two)
                    bucket, blob = [int(chunk % buckets)], [sink.getvalue().to_pybytes()]
                    for b in range(buckets):
                        i, j, k, m = cut1[b], cut1[b + 1], cut2[b], cut2[b + 1]
                        if j > i or m > k:
                            bucket.append(b)
                            blob.append(np.uint32(j - i).tobytes() + p1[i:j].tobytes() + who[i:j].tobytes() + p2[k:m].tobytes())
                    kind = [0] + [1] * (len(bucket) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket, pa.int32()), pa.array([chunk] * len(bucket), pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
                        names=["bucket", "chunk", "kind", "blob"],
                    )

    def count(rows: pa.Table) -> pa.Table:
        kind, chunk, blobs = rows.column("kind").to_pylist(), rows.column("chunk").to_pylist(), rows.column("blob")
        values, multi, owners = [], [], []
        out_chunk, out_blob = [], []
        for i, k in enumerate(kind):
            if k == 0:
                out_chunk.append(chunk[i])
                out_blob.append(b"H" + blobs[i].as_py())
                continue
            raw = np.frombuffer(blobs[i].as_buffer(), np.uint8)
            n = int(raw[:4].view("<u4")[0])
            one, two = _unpack40(raw[4 : 4 + 5 * n]), _unpack40(raw[4 + 7 * n :])
            values += [one, two]
            multi += [np.zeros(n, bool), np.ones(len(two), bool)]
            owners.append((chunk[i], n, len(two), raw[4 + 5 * n : 4 + 7 * n].copy().view("<u2")))
        if values:
            values, multi = np.concatenate(values), np.concatenate(multi)
            order = np.argsort(values)
            start, times = _runs(values[order])
            many = (times > 1) | (np.add.reduceat(multi[order].astype(np.int64), start) > 0 if len(start) else False)
            flag = np.zeros(len(values), bool)
            flag[order] = np.repeat(many, times)
            at = 0
            for c, n, m, who in owners:
                docs_, times = np.unique(who[flag[at : at + n]], return_counts=True)
                at += n + m
                if len(docs_):
                    out_chunk.append(c)
                    out_blob.append(b"C" + docs_.astype("<u2").tobytes() + times.astype("<u4").tobytes())
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    def decide(rows: pa.Table) -> pa.Table:
        head, counts = None, []
        for blob in rows.column("blob"):
            raw = blob.as_py()
            if raw[:1] == b"H":
                head = pa.ipc.open_stream(raw[1:]).read_all()
            else:
                n = (len(raw) - 1) // 6
                counts.append((np.frombuffer(raw, "<u2", n, 1), np.frombuffer(raw, "<u4", n, 1 + 2 * n)))
        shared, n = np.asarray(head.column("shared")).copy(), np.asarray(head.column("n"))
        for who, times in counts:
            shared[who] += times
        near = (n > 0) & (100 * shared >= percent * n)
        return head.drop_columns(["shared"]).append_column("near", pa.array(near))

    asked = docs.select("id", "text", "key").mapInArrow(tb.lean(ask), "bucket int, chunk long, kind int, blob binary")
    counted = asked.groupBy("bucket").applyInArrow(count, "chunk long, blob binary")
    return counted.groupBy("chunk").applyInArrow(decide, "id long, key long, n long, sig1 long, sig2 long, near boolean")


_SALTS = (0x51ED270B, 0x2545F491, 0x1B873593, 0x38B34AE5)
_SET = "id long, key long, n long, sig1 long, sig2 long, mh1 long, mh2 long, mh3 long, mh4 long, bits array<long>, tokens array<long>"


def _sets(batches):
    """The whole shingle sets, with min-hashes."""
    for batch in batches:
        ids, keys = batch.column(0), batch.column(2)
        for first, buf, off in tb.chunks(batch.column(1)):
            n = len(off) - 1
            found, text = shingles(buf, off)
            order = np.argsort(text, kind="stable")
            found, text = found[order], text[order]
            size = np.bincount(text, minlength=n)
            offsets = np.concatenate([[0], np.cumsum(size)])
            sig1, sig2 = _signatures(found, text, n)
            low = []
            for salt in _SALTS:
                m = np.full(n, 2**64 - 1, _U)
                if len(found):
                    full = size > 0
                    m[full] = np.minimum.reduceat(tb.mix(found ^ _U(salt)), offsets[:-1][full])
                low.append(m.view(np.int64))
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int64)))
            marks = np.zeros((n, BIT_WORDS * 64), np.uint8)
            marks[text, (tb.mix(found) % _U(BIT_WORDS * 64)).astype(np.int64)] = 1
            bits = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(marks, axis=1).view(np.int64).ravel()), BIT_WORDS).cast(pa.list_(pa.int64()))
            columns = [ids[first : first + n], keys[first : first + n], pa.array(size), pa.array(sig1), pa.array(sig2), *map(pa.array, low), bits, tokens]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SET.split(", ")])


class _Index:
    """Token positions of a bounded number of sets."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, n: int):
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.n = tokens[order], owner[order], n

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        size = hi - lo
        total = int(size.sum())
        if not total:
            return np.zeros(self.n, np.int64)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        return np.bincount(self.owner[at], minlength=self.n)


def _linked(overlap: np.ndarray, a, b, percent: int) -> np.ndarray:
    return (overlap > 0) & (100 * overlap >= percent * (a + b - overlap))


def part_components(tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (smallest position) of each of a part's sets by all links between them.

    A search from set to set; each is compared only with those that no search has reached.
    """
    n = len(tokens)
    size = np.array([len(t) for t in tokens])
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(n), size)
    index, left, root = _Index(flat, owner, n), np.ones(n, bool), np.arange(n)
    stale = 0
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo and left.any():
            q = todo.pop()
            hit = np.flatnonzero(left & _linked(index.overlaps(tokens[q]), size[q], size, percent))
            left[hit] = False
            root[hit] = seed
            todo += hit.tolist()
            stale += len(hit)
            if stale > n // 8:
                keep = left[index.owner]
                index.tokens, index.owner, stale = index.tokens[keep], index.owner[keep], 0
    return root


def _split(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return np.split(flat, np.cumsum(np.asarray(pc.list_value_length(column)))[:-1]) if len(column) else []


def links(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Texts that are null or have no words have no shingles and link with nothing. Rows that repeat an id are one node of
    the link graph, each with its own set. A null id keeps its row, counts as a partner of nothing and has a null component.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    sieved = cut(sieve(rows, percent))
    keys = cut(sieved.where("near and id is not null").select("key").distinct())
    if keys.count() <= BROADCAST_KEYS:
        survivors = rows.join(F.broadcast(keys), "key", "left_semi")
    else:
        survivors = rows.join(keys, "key", "left_semi")
    sets = cut(survivors.select("id", "text", "key").mapInArrow(tb.lean(_sets), _SET))
    same = ["sig1", "sig2", "n"]
    low = cut(sets.groupBy(*same).agg(F.min("id").alias("rep")))
    members = cut(sets.select("id", *same).join(low, same).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    first = [F.col(c).alias(f"__{c}") for c in same]
    once = sets.join(low.select("rep", *first), (F.col("id") == F.col("rep")) & (F.col("sig1") == F.col("__sig1")) & (F.col("sig2") == F.col("__sig2")) & (F.col("n") == F.col("__n")))
    once = once.dropDuplicates(["rep", *same])  # the set of one id and text may occur more than once
    classes = cut(once.select("rep", F.xxhash64(*same).alias("cid"), "n", *_MINHASHES, "bits", "tokens"))
    drop(sets)
    edges = _blocks(classes, percent)
    linked = edges.select(F.col("rep").alias("a"), F.col("block").alias("b"))
    first = cut(linked.where("a <> b"))
    first = cut(first.union(_starred(classes, components(first), percent)))
    found = _opened(classes, components(first), percent)
    parts = cut(components(first.union(found).union(members)))
    out = sieved.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"))
    out = out.join(parts, F.col(id_col) == F.col("node"), "left")
    return out.select(id_col, "n_shingles", F.coalesce("component", id_col).alias("component_id"))


def _blocks(classes: DataFrame, percent: int) -> DataFrame:
    """(rep, block) for each class; more than one row where a class is the pivot of several parts of its group."""
    group = ["mh1", "mh2"]
    sizes = classes.groupBy(*group).agg(F.count(F.lit(1)).alias("g"), F.min("rep").alias("pivot"))
    sizes = cut(sizes.where("g > 1").withColumn("parts", F.ceil(F.col("g") / PART_ROWS)))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    placed = classes.join(sizes, group).withColumn("part", part).select(*group, "part", "rep", "tokens")
    pivots = classes.join(sizes.where("parts > 1"), (classes["rep"] == F.col("pivot")) & (classes["mh1"] == sizes["mh1"]) & (classes["mh2"] == sizes["mh2"]))
    pivots = pivots.withColumn("own", part).select(
        classes["mh1"], classes["mh2"], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "tokens", "own"
    )
    pivots = pivots.where("part <> own").drop("own")

    def part_links(rows: pa.Table) -> pa.Table:
        rep = np.asarray(rows.column("rep"))
        order = np.argsort(rep)
        tokens = _split(rows.column("tokens"))
        root = part_components([tokens[i] for i in order], percent)
        return pa.table({"rep": rep[order], "block": rep[order][root]})

    inside = placed.union(pivots).groupBy(*group, "part").applyInArrow(part_links, "rep long, block long")
    alone = classes.join(sizes.select(*group), group, "left_anti").select("rep", F.col("rep").alias("block"))
    return cut(inside.union(alone))


def _starred(classes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that meet in a min-hash: one class of each is compared with one of the first.

    It finds most links between the groups that one crowd of near copies falls into, at one comparison for each component and min-hash,
    and so leaves little to step 3, which needs it for no link.
    """
    rows = classes.join(parts, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    keyed = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(m).alias("mh")) for i, m in enumerate(_MINHASHES))))
    met = rows.select("rep", "component", keyed.alias("x")).groupBy("x.k", "x.mh", "component").agg(F.min("rep").alias("a"))
    met = cut(met)
    first = met.groupBy("k", "mh").agg(F.min(F.struct("component", F.col("a").alias("b"))).alias("f"), F.count(F.lit(1)).alias("c"))
    pairs = met.join(first.where("c > 1"), ["k", "mh"]).where(F.col("component") != F.col("f.component")).select("a", "f.b").distinct()
    one, two = (classes.select(F.col("rep").alias(x), F.col("tokens").alias(f"t_{x}")) for x in "ab")

    def compare(batches):
        for batch in batches:
            sets = [_split(batch.column(i)) for i in (2, 3)]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)], np.int64)
            sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
            ok = pa.array(_linked(both, *sizes, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "t_a", "t_b").mapInArrow(tb.lean(compare), "a long, b long")


def _opened(classes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components, one at least for each class and block that have any.

    The groups of the matrix are now the components found so far, in blocks of bounded size. Of two similar sets the larger is the query, and the
    first token that they share, in the order of all tokens, has behind it in either set all that they share: at least percent / (100 + percent)
    of their sizes together. Tokens that no other component has come first in that order.
    """
    named = classes.select("cid", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("cid", F.coalesce("component", "rep").alias("component")).distinct()
    named = cut(named)
    sizes = named.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("blocks"))
    named = named.join(sizes, "component").select("cid", "component", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"))
    placed = alive = cut(classes.select("cid", "rep", "n", "bits", "tokens").join(named, "cid"))
    enough = F.col("found") * 100 >= F.col("n") * percent
    key = ["cid", "n", "component", "block"]
    for last in (False, True):  # a partner has as many tokens that others share, so the second look is at those left by the first
        matrix = alive.select(*key, F.explode("tokens").alias("token"))
        shared = matrix.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df"))
        shared = cut(shared.where("lo < hi").select("token", "df"))
        found = matrix.join(shared, "token").groupBy(*key)
        if last:
            found = found.agg(F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by"))
            ordered = cut(found.where(enough))
        else:
            alive = placed.join(cut(found.agg(F.count(F.lit(1)).alias("found")).where(enough).select("cid")), "cid", "left_semi")
    n, left = F.col("n"), F.col("found") - F.col("k")
    most = F.floor((100 + percent) * left / percent) - n  # the largest query that may share enough from this token on
    head = n - F.ceil(n * percent / 100) + 1 - (n - F.col("found"))
    heads = ordered.where(head > 0).select(*key, "found", F.posexplode(F.slice("by", F.lit(1), head.cast("int"))).alias("k", "x"))
    heads = cut(heads.select(*key, F.col("x.token").alias("token"), left.alias("left"), most.alias("most")))
    size_class = lambda c: F.floor(F.log(c) * SIZE_CLASSES)
    listed = heads.where("most >= n").groupBy("token", F.col("component").alias("other"), "block").agg(F.min("n").alias("least"), F.max("most").alias("most"))
    listed = listed.withColumn("size", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))))
    asks = heads.select("cid", "n", "component", "left", F.col("token").alias("its"), size_class(n).alias("its_size"))
    meet = (F.col("its") == F.col("token")) & (F.col("its_size") == F.col("size")) & (F.col("component") != F.col("other"))
    meet = meet & n.between(F.col("least"), F.col("most")) & (percent * (n + F.col("least")) <= (100 + percent) * F.col("left"))
    pairs = cut(asks.join(listed, meet).select("cid", "other", "block").distinct())
    if not pairs.limit(1).count():
        return classes.sparkSession.createDataFrame([], "a long, b long")
    words = [F.bit_or(F.col("bits")[i]).alias(f"u{i}") for i in range(BIT_WORDS)]
    union = placed.groupBy(F.col("component").alias("other"), "block").agg(*words, F.min("n").alias("least"), F.max("n").alias("most"))
    # a bit of the query that the union lacks is a token that no member has
    lacking = F.lit(0)
    for i in range(BIT_WORDS):
        lacking = lacking + F.bit_count(F.col("bits")[i].bitwiseAND(F.bitwise_not(F.col(f"u{i}"))))
    overlap = n - lacking
    near = (100 * overlap >= percent * n) & (100 * F.col("most") >= percent * n) & ((100 + percent) * overlap >= percent * (n + F.col("least")))
    asked = placed.select("cid", "n", "bits").join(pairs, "cid")
    pairs = cut(asked.join(union, ["other", "block"]).where(near).select("cid", "other", "block"))
    load = pairs.groupBy("other", "block").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("salts"))
    pairs = cut(pairs.join(load, ["other", "block"]).withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts"))).drop("salts"))
    task = ["other", "block", "salt"]
    asking = pairs.join(placed.select("cid", "rep", "tokens"), "cid").select(*task, F.lit(0).alias("side"), "rep", "tokens")
    members = placed.select(F.col("component").alias("other"), "block", "rep", "tokens")
    opened = pairs.select(*task).distinct().join(members, ["other", "block"]).select(*task, F.lit(1).alias("side"), "rep", "tokens")

    def compare(rows: pa.Table) -> pa.Table:
        side, rep, tokens = np.asarray(rows.column("side")), np.asarray(rows.column("rep")), _split(rows.column("tokens"))
        mine, member = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(tokens[i]) for i in member])
        flat = np.concatenate([tokens[i] for i in member])
        union, index = np.unique(flat), _Index(flat, np.repeat(np.arange(len(member)), size), len(member))
        a, b = [], []
        for i in mine:
            n = len(tokens[i])
            at = np.minimum(np.searchsorted(union, tokens[i]), len(union) - 1)
            if 100 * int((union[at] == tokens[i]).sum()) < percent * n:
                continue
            hit = np.flatnonzero(_linked(index.overlaps(tokens[i]), n, size, percent))
            if len(hit):
                a.append(rep[i])
                b.append(rep[member[hit[0]]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = cut(asking.union(opened).groupBy(*task).applyInArrow(compare, "a long, b long"))
    drop(placed)
    drop(heads)
    return links


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id. Rows with a null id stay, and so does one of repeated rows."""
    found = links(docs, percent, id_col, text_col)
    gone = cut(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct())
    kept = docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    return kept


def query(spark, sf_dir):
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
