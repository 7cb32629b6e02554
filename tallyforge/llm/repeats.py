"""Removal of long repeated byte strings, by merging positional Burrows-Wheeler transforms of shards.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Beside that,
the operator reports passages: runs of over WORDS words that are covered by strings of PASSAGE
bytes which also stand in another document.

1. Winnowing picks anchors: the least GRAM-byte hash in every window of a string of PASSAGE
   bytes (the last of equals). Equal strings pick the same anchor at the same offset, so
   strings can only be equal if their anchors are, and every pair of equal strings meets at one.
   The hash only says what is compared; equality never rests on it.
2. An anchor's fragment is what any string with that anchor can hold: LENGTH - GRAM bytes
   before it to LENGTH bytes from it on. Fragments with one 128-bit blake2b digest are one
   kind, and one that stands twice or more is repeated whole. Of the others, those that share
   their anchor with another kind go on, with one fragment a kind: without these, no byte of
   them can be repeated.
3. Fragments are aligned at their anchors, and anchors are dealt into buckets. A shard (what
   one task cuts, SHARD fragments at most) makes the transform of its fragments: for every
   column, from the last to the first, the symbols before the sorted suffixes that begin one
   column on. Only transforms are sent.
4. A bucket merges its shards' transforms by refining their interleave. It starts as shard
   after shard; for each column the shards' symbols are read in the order of the interleave
   and deal it out stably, which gives the interleave one column on. The common prefix of
   neighbours follows from the least one between them. No suffix is sorted again. Neighbours
   with a common prefix of LENGTH (PASSAGE) or more are repeated intervals.
5. An anchor with more than HOT kinds would not fit in a task. Its strings are grouped in two
   steps instead, with partial counts in each task: by the digest of the core that 16
   neighbouring strings have in common with the 15 bytes on its sides, then, where a core has
   several surroundings, by the part of those that each string holds. Both ways are exact and
   find the same.

Defined results: null text is an empty text; a text shorter than LENGTH is kept whole; texts of
any length are handled in segments; rows that repeat an id are documents of their own, and
rows equal in id and text count as copies of each other, though not as another document; an
empty table gives an empty result; other columns are ignored, under whatever names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_written, only, read_table, sliced, texts_of, written
from tallyforge.llm.quality import inverse_powers_upto, mix64, prefix_hashes

LENGTH, PASSAGE, GRAM = 400, 256, 32
#: A passage has more words than this.
WORDS = 50
BEFORE = LENGTH - GRAM
WIDTH = BEFORE + LENGTH
#: Fragments of a shard at most, of a bucket on average, and of an anchor in a bucket at most (about 4 KB of memory each).
SHARD, BUCKET, HOT = 16_384, 8192, 1 << 16
#: Neighbouring strings whose core is counted first.
CORE = 16
#: The symbol of columns that are no part of a fragment; the last in order.
OUTSIDE = 256
_SEGMENT = 4 << 20
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, anchor hash, fragment digest) of each anchor of a text."""
    parts = []
    for a in range(0, max(0, len(data) - PASSAGE + 1), _SEGMENT):
        lo, hi = max(0, a - WIDTH), min(len(data), a + _SEGMENT + 2 * WIDTH)
        p, h = _segment(np.frombuffer(data, np.uint8, hi - lo, lo), a - lo, min(a + _SEGMENT, len(data) - PASSAGE + 1) - lo)
        parts.append((p + lo, h))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), np.int64)
    p, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    p, first = np.unique(p, return_index=True)
    digests = []
    for at in p.tolist():
        lo = max(0, at - BEFORE)
        digests.append(hashlib.blake2b(data[lo : at + LENGTH] + (at - lo).to_bytes(2, "little"), digest_size=16).digest())
    return p, h[first].view(np.int64), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _segment(buf: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the strings that begin at start..stop, in a segment with its surroundings."""
    n, w = len(buf), PASSAGE - GRAM + 1
    sums = prefix_hashes(buf)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse_powers_upto(n - GRAM + 1))
    # the least of hash and reversed position, over windows of w grams, from running minima of blocks of w
    ranked = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    padded = np.full(-(-len(ranked) // w) * w, np.uint64(2**64 - 1))
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(start, stop)
    least = np.minimum(back[s], ahead[s + w - 1])
    at = np.unique((_LOW - (least & _LOW)).astype(np.int64))
    return at, grams[at]


def _ranks(group: np.ndarray) -> np.ndarray:
    """Numbers of groups whose equal members stand together, in the least type that holds them."""
    rank = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if len(group) else np.zeros(0, np.int64)
    return rank.astype(np.uint16) if len(rank) == 0 or rank[-1] < 1 << 16 else rank


def _dealt(rank: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The stable order by group and symbol of positions whose groups stand together: two counting passes."""
    a = np.argsort(symbol, kind="stable")
    return a[np.argsort(rank[a], kind="stable")]


def transform(group: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The positional transform of aligned fragments: for each column, the symbols before the sorted suffixes.

    group: numbers, in order. rows: fragments by column; columns outside first..last of a row
    are no part of it and sort last.
    """
    m = len(group)
    order, rank = np.arange(m), _ranks(group)
    columns = rows.T.astype(np.uint16)
    d = np.arange(WIDTH)[:, None]
    columns[(d < first) | (d >= last)] = OUTSIDE
    out = np.empty((WIDTH, m), np.uint16)
    for d in range(WIDTH - 1, -1, -1):
        out[d] = columns[d][order]
        order = order[_dealt(rank, out[d])]
    return out


def _to_bytes(made: np.ndarray) -> bytes:
    """A transform, compressed: what stands at one place of the order, over all columns, is nearly text where groups are
    small; then a bit for each symbol that is outside."""
    raw = np.ascontiguousarray(made.T).astype(np.uint8).tobytes() + np.packbits(made == OUTSIDE, axis=1).tobytes()
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _from_bytes(data: bytes, m: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, decompressed_size=WIDTH * (m + -(-m // 8)), asbytes=True)
    out = np.frombuffer(raw, np.uint8, WIDTH * m).reshape(m, WIDTH).T.astype(np.uint16)
    out[np.unpackbits(np.frombuffer(raw, np.uint8, offset=WIDTH * m).reshape(WIDTH, -1), axis=1, count=m).view(bool)] = OUTSIDE
    return out


def merged(group: np.ndarray, shard: np.ndarray, transforms: np.ndarray, doc: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns 0..BEFORE of each fragment begin a repeated string: (of LENGTH, of PASSAGE in another document).

    Fragments are given shard after shard, in the order of each shard's transform (group by
    group); transforms has the shards' transforms side by side. doc numbers documents; wide
    marks fragments that stand in several documents themselves.
    """
    m = len(group)
    whole, cross = np.zeros((m, BEFORE + 1), bool), np.zeros((m, BEFORE + 1), bool)
    order = np.argsort(group, kind="stable")
    rank = _ranks(group[order])
    shard = shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard
    common = np.zeros(m + 1, np.int32)  # of each suffix with the one before it
    symbol = np.zeros(m, np.uint16)
    for d in range(WIDTH - 1, -1, -1):
        # each shard's symbols, in its own order, go to its places in the interleave
        symbol[np.argsort(shard[order], kind="stable")] = transforms[d]
        move = _dealt(rank, symbol)
        new = np.zeros(m, np.int32)
        dealt = symbol[move]
        k = np.flatnonzero((dealt[1:] == dealt[:-1]) & (rank[1:] == rank[:-1]) & (dealt[1:] < OUTSIDE)) + 1
        if len(k):
            ends = np.empty(2 * len(k), np.int64)
            ends[::2], ends[1::2] = move[k - 1] + 1, move[k] + 1
            new[k] = 1 + np.minimum.reduceat(common, ends)[::2]
        order = order[move]
        common[:m] = new
        if d > BEFORE:
            continue
        k = np.flatnonzero(new >= LENGTH)
        whole[order[k], d] = True
        whole[order[k - 1], d] = True
        if (new >= PASSAGE).any():
            at = np.flatnonzero(new < PASSAGE)
            size = np.diff(at, append=m)
            own = doc[order]
            several = (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)) | (np.logical_or.reduceat(wide[order], at) & (size > 1))
            cross[order[np.repeat(several, size)], d] = True
    return whole, cross


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _row_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every run of a matrix of flags."""
    step = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
    row, a = np.nonzero(step == 1)
    return row, a, np.nonzero(step == -1)[1]


def union(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, 4 << 20):
            cols, n, long = [], [], []
            for k, t in enumerate(texts_of(batch)):
                data = t.encode("utf-8", "surrogatepass")
                if len(data) < PASSAGE:
                    continue
                got = anchors(data)
                cols.append((*got, np.minimum(got[0] + LENGTH, len(data)) - np.maximum(got[0] - BEFORE, 0)))
                n.append(len(got[0]))
                long.append(k)
            if cols:
                p, h, f, size = (np.concatenate(x) for x in zip(*cols, strict=True))
                take = pa.array(np.repeat(long, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(p, pa.int64()), pa.array(h), *map(pa.array, f.T.copy()), pa.array(size, pa.int32())], ["doc_id", "th", "pos", "h", "f", "g", "size"])


def cores(data: bytes, pos: int, h: int) -> Iterator[tuple[bytes, int, bytes, bytes, int]]:
    """(digest, length, bytes before, bytes after, start) of the cores of all strings with an anchor.

    The strings that start 0..CORE - 1 bytes before a core's start have it in common.
    """
    around = CORE - 1
    for length in (LENGTH, PASSAGE):
        for back in range(0, length - GRAM + 1, CORE):
            a, b = pos - back, pos - back - around + length
            if a < 0 or b > len(data):
                continue
            # the same place under another anchor is another core, so that no string meets itself
            key = h.to_bytes(8, "little", signed=True) + back.to_bytes(2, "little") + length.to_bytes(2, "little") + data[a:b]
            yield hashlib.blake2b(key, digest_size=16).digest(), length, data[max(0, a - around) : a], data[b : b + around], a


def _cut(buckets: int, kind: pa.DataType):
    """The fragments that documents are asked for, as a shard's transforms by bucket; of hot anchors, the cores."""
    lists = [pa.list_(t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]
    kinds = [pa.int32(), *lists, pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), kind, pa.int64(), pa.bool_(), pa.bool_()]
    names = ["bucket", "h", "docs", "ths", "pos", "singles", "wides", "transform", "core", "length", "before", "after", "start", "doc_id", "th", "single", "wide"]

    def none(n: int, which: slice) -> list[pa.Array]:
        return [pa.nulls(n, k) for k in kinds[which]]

    def shard(held: list[tuple]) -> pa.RecordBatch:
        held = sorted(held, key=lambda x: (x[0] % buckets, x[0]))
        h, docs, ths, pos, single, wide, data, left = zip(*held, strict=True)
        h, left, size = np.array(h, np.int64), np.array(left), np.array([len(x) for x in data])
        first = BEFORE - left
        rows = np.zeros((len(h), WIDTH), np.uint8)
        for k, x in enumerate(data):
            rows[k, first[k] : first[k] + len(x)] = np.frombuffer(x, np.uint8)
        made = transform(h, rows, first, first + size)
        bucket = h % buckets
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]])
        listed = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t.value_type)) for v, t in zip((h, docs, ths, pos, single, wide), lists, strict=True)]
        body = pa.array([_to_bytes(made[:, a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), *listed, body, *none(len(at) - 1, slice(8, None))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for whole in batches:
            for batch in sliced(whole, 4 << 20):
                hot: list[tuple] = []
                for doc, th, text, asked in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    for x in asked:
                        pos = x["pos"]
                        lo = max(0, pos - BEFORE)
                        if x["hot"]:
                            hot += [(*core, doc, th, x["single"], x["wide"]) for core in cores(data, pos, x["h"])]
                        else:
                            held.append((x["h"], doc, th, pos, x["single"], x["wide"], data[lo : pos + LENGTH], pos - lo))
                    if len(held) >= SHARD:
                        yield shard(held)
                        held = []
                    if len(hot) >= 1 << 17:
                        yield pa.RecordBatch.from_arrays([*none(len(hot), slice(0, 8)), *(pa.array(c, k) for c, k in zip(zip(*hot, strict=True), kinds[8:], strict=True))], names)
                        hot = []
                if hot:
                    yield pa.RecordBatch.from_arrays([*none(len(hot), slice(0, 8)), *(pa.array(c, k) for c, k in zip(zip(*hot, strict=True), kinds[8:], strict=True))], names)
        if held:
            yield shard(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets' transforms, which come bucket by bucket, merged: the repeated spans."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        b = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else []
        for i, j in zip(edges, edges[1:], strict=False):
            if held and b[i] != last:
                yield _merge_bucket(pa.Table.from_batches(held))
                held = []
            last = b[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield _merge_bucket(pa.Table.from_batches(held))


def _merge_bucket(t: pa.Table) -> pa.RecordBatch:
    flat = {c: t.column(c).combine_chunks().flatten() for c in ("h", "docs", "ths", "pos", "singles", "wides")}
    sizes = np.asarray(t.column("h").combine_chunks().value_lengths())
    transforms = np.concatenate([_from_bytes(x.as_py(), n) for x, n in zip(t.column("transform"), sizes.tolist(), strict=True)], axis=1)
    pos = np.asarray(flat["pos"])
    singles, wides = (flat[c].to_numpy(zero_copy_only=False) for c in ("singles", "wides"))
    ids = flat["docs"].dictionary_encode(null_encoding="encode").indices.to_numpy()
    doc = np.unique(np.stack([ids, np.asarray(flat["ths"])]), axis=1, return_inverse=True)[1].ravel()
    whole, cross = merged(np.asarray(flat["h"]), np.repeat(np.arange(len(sizes)), sizes), transforms, doc, wides)
    # fragments that stand twice are known to be repeated whole, and those in several documents to be shared
    whole[~singles] = False
    cross[wides] = False
    parts = []
    for flags, length in ((whole, LENGTH), (cross, PASSAGE)):
        row, a, b = _row_runs(flags)
        parts.append((row, pos[row] - BEFORE + a, pos[row] - BEFORE + b - 1 + length, np.full(len(row), length == LENGTH)))
    row, lo, hi, long = (np.concatenate(x) for x in zip(*parts, strict=True))
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([flat["docs"].take(take), flat["ths"].take(take), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(long), pa.array(~long)], ["doc_id", "th", "lo", "hi", "long", "shared"])


def _of_hot(cut: DataFrame) -> DataFrame:
    """Repeated spans of hot anchors' strings, from their cores and the bytes around those."""
    around, one, key = CORE - 1, F.struct("doc_id", "th"), ["core", "before", "after"]
    hot = cut.where("core IS NOT NULL").select("core", "length", "before", "after", "start", "doc_id", "th", "single", "wide")
    # cores with equal bytes around them have all their strings in common; grouped sides are
    # written, since a join straight from tables is one whose hot keys Spark can split
    place = F.struct("doc_id", "th", "length", "start", "single", "wide")
    grouped = hot.groupBy(key).agg(F.count("*").alias("n"), F.min(one).alias("low"), F.max(one).alias("high"), F.max("wide").alias("any_wide"), F.min(place).alias("at"))
    several = (F.col("n") > 1) & (F.col("any_wide") | ~F.col("low").eqNullSafe(F.col("high")))
    alike = written(grouped.withColumn("several", several), "cores")
    span = lambda lo, hi, long, shared: [lo.alias("lo"), hi.alias("hi"), F.expr(long).alias("long"), F.expr(shared).alias("shared")]
    long, shared = f"length = {LENGTH} AND single", f"length = {PASSAGE} AND several AND NOT wide"
    whole = hot.where(f"length(before) + length(after) >= {around}").join(alike.where("n > 1").select(*key, "several"), key)
    first = whole.select("doc_id", "th", *span(F.col("start") - F.length("before"), F.col("start") + F.col("length") - around + F.length("after"), long, shared))
    # strings of cores that stand in different surroundings
    mixed = written(alike.groupBy("core").agg(F.count("*").alias("m"), F.min("several").alias("done")).where("m > 1 AND NOT done").select("core"), "mixed-cores")
    strings = alike.join(mixed, "core").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(around)))).where(f"k <= length(before) AND {around} - k <= length(after)")
    keyed = written(strings.select("core", "k", F.expr("substring(before, length(before) - k + 1, k)").alias("l"), F.expr(f"substring(after, 1, {around} - k)").alias("r"), "n", "low", "high", "any_wide", F.col("several").alias("known"), "at"), "strings")
    key = ["core", "k", "l", "r"]
    same = keyed.groupBy(key).agg(F.count("*").alias("m"), (F.max("any_wide") | ~F.min("low").eqNullSafe(F.max("high"))).alias("several")).where("m > 1").drop("m")
    found = keyed.where("n = 1 OR NOT known").join(written(same, "equal-strings"), key).select("at.*", "k", "several", "n", "known")
    start = F.col("start") - F.col("k")
    second = found.select("doc_id", "th", *span(start, start + F.col("length"), f"{long} AND n = 1", f"{shared} AND NOT known"))
    return first.unionByName(second).where("long OR shared")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans), written: a document's repeated byte ranges (lo, hi, long, shared), which may overlap. docs: doc_id, th, text.

    long: covered by strings of LENGTH; shared: by strings of PASSAGE that stand in another document.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = written(docs.mapInArrow(_find_anchors, f"doc_id {kind}, th long, pos long, h long, f long, g long, size int"), "anchors")
    # grouped sides are written first: a join straight from tables is one whose hot keys Spark can split
    shared = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    several = written(every.join(shared, "h"), "shared-anchors")
    drop_written(every, shared)
    grouped = several.groupBy("h", "f", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("one"), F.max(F.struct("doc_id", "th")).alias("other"))
    wide = ~F.col("one.doc_id").eqNullSafe(F.col("other.doc_id")) | (F.col("one.th") != F.col("other.th"))
    kinds = written(grouped.select("h", "f", "g", "n", "one", wide.alias("wide")), "kinds")
    lo = F.greatest(F.col("pos") - BEFORE, F.lit(0))
    twice = several.join(kinds.where("n > 1").select("h", "f", "g", "wide"), ["h", "f", "g"])
    copied = written(twice.select("doc_id", "th", lo.alias("lo"), (lo + F.col("size")).alias("hi"), (F.col("size") >= LENGTH).alias("long"), F.col("wide").alias("shared")).where("long OR shared"), "copied")
    drop_written(several)
    by_anchor = written(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("wide").alias("all_wide")).where("kinds > 1 AND NOT all_wide"), "open-anchors")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = by_anchor.where(F.col("kinds") <= HOT).agg(F.sum("kinds")).first()[0] or 0
    buckets = max(tasks, -(-total // BUCKET))
    open_ = kinds.join(by_anchor, "h").select("one.doc_id", "one.th", F.struct("h", F.col("one.pos").alias("pos"), (F.col("n") == 1).alias("single"), "wide", (F.col("kinds") > HOT).alias("hot")).alias("x"))
    asked = written(open_.groupBy(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th")).agg(F.collect_list("x").alias("asked")), "asked")
    drop_written(kinds, by_anchor)
    # rows equal in id and text give their fragments twice; none of those is single, and they are one document
    with_text = docs.join(asked, docs["doc_id"].eqNullSafe(asked["a_id"]) & (docs["th"] == asked["a_th"])).select("doc_id", "th", "text", "asked")
    of_shard = f"bucket int, h array<long>, docs array<{kind}>, ths array<long>, pos array<long>, singles array<boolean>, wides array<boolean>, transform binary"
    of_core = f"core binary, length int, before binary, after binary, start long, doc_id {kind}, th long, single boolean, wide boolean"
    cut = written(with_text.mapInArrow(_cut(buckets, pa_type(docs)), f"{of_shard}, {of_core}"), "fragments")
    drop_written(asked)
    in_buckets = cut.where("bucket IS NOT NULL").select("bucket", "h", "docs", "ths", "pos", "singles", "wides", "transform").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    of_cold = in_buckets.mapInArrow(_merge, f"doc_id {kind}, th long, lo long, hi long, long boolean, shared boolean")
    every_span = copied.unionByName(of_cold).unionByName(_of_hot(cut))
    spans = written(every_span.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi", "long", "shared")).alias("spans")), "repeated")
    drop_written(copied, cut)
    return spans


def pa_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


_SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, 4 << 20):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone = union((s["lo"], s["hi"]) for s in spans or () if s["long"])
                told = [x for x in union((s["lo"], s["hi"]) for s in spans or () if s["shared"]) if len(data[x[0] : x[1]].split()) > WORDS]
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), len(told), bool(told), left, *([{"lo": a, "hi": b} for a, b in x] for x in (gone, told))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(_SPAN), pa.list_(_SPAN))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "shares_passage", "kept", "removed", "passages"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, shares_passage, kept, removed, passages) of every document."""
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(rows).select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["s_id"]) & (rows["th"] == spans["s_th"]), "left").select("doc_id", "text", "spans")
    span = "array<struct<lo: long, hi: long>>"
    return joined.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, shares_passage boolean, kept binary, removed {span}, passages {span}")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).drop("kept", "removed", "passages")
