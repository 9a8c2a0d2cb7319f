"""Suffix-array deduplication with a common-prefix interval tree.

A string of ``size`` bytes that occurs twice holds, both times and at the same offset, the same
anchor: the k-gram with the least hash in it (the leftmost one on ties). Suffixes that start at
anchors with equal hashes therefore form buckets that never miss a match. A bucket is an
enhanced suffix array: suffixes sorted by what follows the anchor, their common-prefix lengths
scanned with a stack into a tree of intervals. The members of an interval agree to the right;
how far they agree to the left is tested on the same way, and an interval counts as a maximal
repeat when what precedes its members differs. Each maximal repeat comes with all members.

Buckets beyond ``bucket_rows`` suffixes are cut in parts. Strings that start within BLOCK bytes
of each other share all but BLOCK - 1 bytes; suffixes whose shared bytes agree (by a 128-bit hash)
make a part, and what may differ is the BLOCK - 1 bytes on either side. Suffixes that agree there
too are one class, counted before the shuffle, and the classes of a part are what its suffix array
and its tree of intervals are made of. A part of more than ``part_classes`` classes is cut down to
its single strings, each an interval of its own. Classes then pass their repeats on to all members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.arrow import as_bytes, binary, slices, small_batches
from ramify.scratch import saved

_P = 0x9E3779B97F4A7C15
GRAM = 48
BLOCK = 32
_ANCHORS = "k1 long, k2 long, p int, h long, lo int, hi int"
_CONTEXT = "h long, n long, k1 long, k2 long, p int, lo int, hi int, before binary, after binary"
_REPEATS = "repeat long, k1 long, k2 long, start int, end int"


def rolling_hash(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of ``k`` bytes, mixed."""
    have, power = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}, {1: _P}
    m = 1
    while 2 * m <= k:
        a = have[m] if k & m else have.pop(m)  # lengths that make up k are kept
        have[2 * m], power[2 * m] = a[:-m] * np.uint64(power[m]) + a[m:], power[m] ** 2 % 2**64
        m *= 2
    out, length = have[m], m
    while length < k:
        m = 1 << ((k - length).bit_length() - 1)
        n = len(data) - length - m + 1
        out, length = out[:n] * np.uint64(power[m]) + have[m][length : length + n], length + m
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, from minima of prefixes and suffixes of blocks of w."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], size: int, gram: int = GRAM, piece: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """(text number, anchor position, hash, least and greatest offset of the strings it stands for)."""
    if max(map(len, texts), default=0) > piece:  # pieces, one at a time, overlap by size - 1, so no string is lost or met twice
        found = []
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t) - size + 1), piece - size + 1):
                part, p, *rest = anchors([t[a : a + piece]], size, gram, piece)
                found.append((part + i, p + a, *rest))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))
    long = [i for i, t in enumerate(texts) if len(t) >= size]
    none = np.empty(0, np.int64)
    if not long:
        return none, none, none.astype(np.uint64), none, none
    lengths = np.array([len(texts[i]) for i in long], np.int64)
    begin = np.cumsum(lengths) - lengths
    h = rolling_hash(np.frombuffer(b"".join(texts[i] for i in long), np.uint8), gram)
    bits = np.uint64(max(1, len(h)).bit_length())  # enough for the places in a batch; the hash keeps the rest
    place = np.uint64(1) << bits
    least = window_min(h >> bits << bits | np.arange(len(h), dtype=np.uint64), size - gram + 1)
    counts = lengths - size + 1
    doc = np.repeat(np.arange(len(long)), counts)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[doc]
    p = (least[q] & (place - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:] - 1, len(p) - 1]
    d, at = doc[first], p[first]
    return np.array(long)[d], at - begin[d], h[at], at - q[last], at - q[first]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) // 8


def prefix_intervals(lcp: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, lo, hi) of every interval of an enhanced suffix array, hi exclusive.

    ``lcp[i]`` belongs to suffixes i - 1 and i. One scan with a stack of open intervals.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        now, lo = (lcp[i] if i < n else -1), i - 1
        while stack and stack[-1][0] > now:
            depth, lo = stack.pop()
            yield depth, lo, i
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, lo))


def maximal_repeats(before: list[bytes], after: list[bytes], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): all members agree on ``left`` bytes before and ``right`` from the
    anchor on, left + right >= size, and on no byte more on either side."""
    n = len(after)
    order = sorted(range(n), key=after.__getitem__)
    lcp = [0] + [common(after[order[i - 1]], after[order[i]]) for i in range(1, n)]
    back = [x[::-1] for x in before]
    for right, lo, hi in prefix_intervals(lcp, n):
        if right + max(len(before[m]) for m in order[lo:hi]) < size:
            continue
        inner = sorted(order[lo:hi], key=back.__getitem__)
        left_lcp = [0] + [common(back[inner[i - 1]], back[inner[i]]) for i in range(1, len(inner))]
        for left, a, b in prefix_intervals(left_lcp, len(inner)):
            members = inner[a:b]
            if left + right >= size and len({after[m][right : right + 1] for m in members}) > 1 - any(len(after[m]) == right for m in members):
                yield left, right, members


def repeats_of(before: list[bytes], after: list[bytes], size: int, every: bool = True) -> list[tuple[int, int, list[int]]]:
    """Maximal repeats that cover a member further than any other does, with all their members or, unless ``every``, those alone."""
    found = sorted(maximal_repeats(before, after, size), key=lambda r: -(r[0] + r[1]))
    seen: list[list[tuple[int, int]]] = [[] for _ in after]
    out = []
    for left, right, members in found:
        mine = [m for m in members if not any(a >= left and b >= right for a, b in seen[m])]
        for m in mine:
            seen[m].append((left, right))
        if mine:
            out.append((left, right, members if every else mine))
    return out


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(1), text))


def _anchor_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            i, p, h, lo, hi = anchors(as_bytes(batch.column(2)), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(p.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                names=["k1", "k2", "p", "h", "lo", "hi"],
            )

    return run


def _context_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in range(9)]
            for text, k1, k2, found in zip(as_bytes(batch.column("text")), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("found").to_pylist(), strict=True):
                for f in found:
                    p = f["p"]
                    row = (f["h"], f["n"], k1, k2, p, f["lo"], f["hi"], text[p - f["hi"] : p], text[p : p - f["lo"] + size])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=["h", "n", "k1", "k2", "p", "lo", "hi", "before", "after"])

    return run


def _bucket_repeats(size: int, every: bool):
    """Rows sorted by h: each run of equal h is a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("h", "k1", "k2", "p", "before", "after")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["repeat", "k1", "k2", "start", "end"])
            out.clear()
            return batch

        def close(bucket: list[tuple]) -> None:
            if len(bucket) > 1:
                for n, (left, right, members) in enumerate(repeats_of([b[4] for b in bucket], [b[5] for b in bucket], size, every)):
                    for m in members:
                        h, k1, k2, p = bucket[m][:4]
                        out.append((h ^ n, k1, k2, p - left, p + right))

        bucket: list[tuple] = []
        for row in rows(batches):
            if bucket and bucket[0][0] != row[0]:
                close(bucket)
                bucket = []
                if len(out) > 20_000:
                    yield flushed()
            bucket.append(row)
        close(bucket)
        yield flushed()

    return run


_BLOCKS = "x1 long, x2 long, l binary, r binary, k1 long, k2 long, at array<int>"
_PART = ["x1", "x2"]
_CLASS = [*_PART, "l", "r"]


def _block_rows(size: int):
    """Per block of a hot context: a hash of the bytes that all its strings share, the bytes on
    either side that only some of them have, and the places of the shared bytes in the text."""
    core = size - BLOCK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "after", 1 << 18):
            places: dict[tuple, list[int]] = {}  # of a class in a text: a line that a text repeats makes one row
            cols = (batch.column(c).to_pylist() for c in ("k1", "k2", "p", "lo", "hi", "before", "after"))
            for k1, k2, p, lo, hi, before, after in zip(*cols, strict=True):
                text = before + after  # the byte at offset o before the anchor stands at hi - o
                for j in range(lo // BLOCK, hi // BLOCK + 1):
                    o1, o2, o = max(lo, j * BLOCK), min(hi, j * BLOCK + BLOCK - 1), j * BLOCK
                    begin = hi - o
                    x = xxhash.xxh3_128_digest(b"%d/" % j + text[begin : begin + core])
                    places.setdefault((x, text[hi - o2 : begin], text[begin + core : hi - o1 + size], k1, k2), []).append(p - o)
            x, left, right, k1, k2 = map(list, zip(*places, strict=True)) if places else [[]] * 5
            halves = np.frombuffer(b"".join(x), np.int64).reshape(-1, 2)
            sides = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), binary(left), binary(right)]
            arrays = [*sides, pa.array(k1, type=pa.int64()), pa.array(k2, type=pa.int64()), pa.array(list(places.values()), type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["x1", "x2", "l", "r", "k1", "k2", "at"])

    return run


def _part_repeats(every: bool):
    """Classes sorted by part: each run of equal x1 and x2 is a suffix array of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()] + [pa.int32()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["x1", "x2", "l", "r", "repeat", "a", "b"])
            out.clear()
            return batch

        def close(part: list[tuple]) -> None:
            x1, x2 = part[0][:2]
            left, right = [c[2] for c in part], [c[3] for c in part]
            for n, (a, b, members) in enumerate(repeats_of(left, right, BLOCK - 1, every)):
                out.extend((x1, x2, left[m], right[m], x2 ^ n, a, b) for m in members)
            for n, (_, _, l, r, many) in enumerate(part):
                if many > 1:
                    out.append((x1, x2, l, r, x1 ^ n, len(l), len(r)))

        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*_CLASS, "m")), strict=True):
                if part and part[0][:2] != row[:2]:
                    close(part)
                    part = []
                    if len(out) > 20_000:
                        yield flushed()
                part.append(row)
        if part:
            close(part)
        yield flushed()

    return run


def hot_repeats(contexts: DataFrame, size: int, part_classes: int = 256, every: bool = True) -> DataFrame:
    """Repeats of contexts in hot buckets, by parts and classes: k1, k2, places ``at`` and ``of`` (repeat, a, b), a row a block.

    At each place a repeat covers the shared bytes from there on, ``a`` bytes before and ``b`` after them.
    Everything is counted before it is shuffled; counts and spans are tables of their own, so that
    joins with the blocks are plain ones, whose hot keys Spark can split. All spans of a class are one
    row, and so a block that joins it stays one, however many places and repeats it has.
    """
    blocks = saved(contexts.mapInArrow(_block_rows(size), _BLOCKS), "repeat-blocks")
    classes = saved(blocks.groupBy(*_CLASS).agg(F.sum(F.size("at")).alias("m")), "repeat-classes")
    parts = saved(classes.groupBy(*_PART).agg(F.sum("m").alias("rows"), F.count("*").alias("classes")).where("rows > 1"), "repeat-parts")
    listed = classes.join(parts, _PART)
    own = F.xxhash64(*_CLASS)
    whole = [own.alias("repeat"), F.length("l").alias("a"), F.length("r").alias("b")]
    one = listed.where("classes = 1").select(*_CLASS, *whole)
    tree = listed.where(F.col("classes").between(2, part_classes)).select(*_CLASS, "m")
    some = tree.repartition(*_PART).sortWithinPartitions(*_CLASS).mapInArrow(_part_repeats(every), "x1 long, x2 long, l binary, r binary, repeat long, a int, b int")
    # A part of very many classes: its strings are a bytes on the left and BLOCK - 1 - a on the right.
    large = listed.where(F.col("classes") > part_classes)
    a = F.explode(F.sequence(F.lit(BLOCK - 1) - F.length("r"), F.length("l"))).alias("a")
    strings = large.select(*_CLASS, "m", a).withColumn("b", F.lit(BLOCK - 1) - F.col("a"))
    strings = strings.withColumn("s", F.concat(F.substring("l", F.length("l") - F.col("a") + 1, F.col("a")), F.substring("r", F.lit(1), F.col("b"))))
    strings = saved(strings, "repeat-strings")
    often = saved(strings.groupBy(*_PART, "a", "s").agg(F.sum("m").alias("n")).where("n > 1").drop("n"), "repeat-often")
    single = strings.join(often, [*_PART, "a", "s"]).select(*_CLASS, F.xxhash64(*_PART, "a", "s").alias("repeat"), "a", "b")
    spans = one.union(some).union(single).groupBy(*_CLASS).agg(F.collect_list(F.struct("repeat", "a", "b")).alias("of"))
    spans = saved(spans, "repeat-spans")
    return blocks.join(spans, _CLASS).select("k1", "k2", "at", "of")


def _repeats(df: DataFrame, text_col: str, size: int = 400, bucket_rows: int = 128, part_classes: int = 256, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """What ``repeated_spans`` gives of small buckets, as it is, and of others, as ``hot_repeats`` does."""
    if size < 2 * GRAM:
        raise ValueError(f"size must be {2 * GRAM} at least")
    keyed = _keyed(small_batches(df), text_col).select("k1", "k2", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = keyed.where(F.octet_length("text") >= size).mapInArrow(_anchor_rows(size), _ANCHORS)
    found = saved(found.dropDuplicates(["k1", "k2", "p", "lo"]), "repeat-anchors")
    shared = saved(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeat-shared")  # a table of its own, so that Spark can split hot keys of the join
    wanted = found.join(shared, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "h", "lo", "hi", "n")).alias("found"))
    texts = keyed.where(F.octet_length("text") >= size).dropDuplicates(["k1", "k2"])
    contexts = saved(texts.join(wanted, ["k1", "k2"]).mapInArrow(_context_rows(size), _CONTEXT), "repeat-contexts")
    small = contexts.where(F.col("n") <= bucket_rows).select("h", "k1", "k2", "p", "before", "after")
    near = small.repartition("h").sortWithinPartitions("h", "k1", "k2", "p").mapInArrow(_bucket_repeats(size, every), _REPEATS)
    return near, hot_repeats(contexts.where(F.col("n") > bucket_rows), size, part_classes, every)


def repeated_spans(df: DataFrame, text_col: str, size: int = 400, bucket_rows: int = 128, part_classes: int = 256, every: bool = True) -> DataFrame:
    """Maximal repeats of ``size`` bytes or more among the distinct texts of ``df``.

    Columns repeat (occurrences of one repeat share it), k1 and k2 (the text's key, see
    ``text_keys``), start, end (bytes). A repeat reaches as far as its bucket or part does: the
    spans of a longer one overlap or touch. Neither limit changes which bytes are covered, nor
    does ``every``: without it a repeat lists only occurrences that it covers further than others.
    """
    near, hot = _repeats(df, text_col, size, bucket_rows, part_classes, every)
    hot = hot.select("k1", "k2", F.explode("at").alias("at"), "of").select("k1", "k2", "at", F.inline("of"))
    return near.union(hot.select("repeat", "k1", "k2", (F.col("at") - F.col("a")).alias("start"), (F.col("at") + size - BLOCK + 1 + F.col("b")).alias("end")))


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            kept, removed, runs = [], [], []
            for text, copies, size, spans in zip(as_bytes(batch.column("text")), batch.column("copies").to_pylist(), batch.column("size").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                pairs = [(0, len(text))] if copies > 1 and len(text) >= size else sorted((s["start"], s["end"]) for s in spans or ())
                parts, at, n = [], 0, 0
                for s, e in pairs:
                    if s > at or n == 0:
                        parts.append(text[at:s])
                        n += 1
                    at = max(at, e)
                parts.append(text[at:])
                kept.append(b"".join(parts))
                removed.append(len(text) - len(kept[-1]))
                runs.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, type=pa.int64()), pa.array(runs, type=pa.int64()), binary(kept)], names=["k1", "k2", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(df: DataFrame, text_col: str, size: int = 400, bucket_rows: int = 128, part_classes: int = 256) -> DataFrame:
    """Per distinct text: k1, k2, n_removed, n_spans, kept (the bytes that stay, as binary).

    Every byte covered by a ``size``-byte string that starts anywhere else too (in this text or
    another row's) is removed; matches never cross rows. A text that several rows have is a
    repeat as a whole. Null counts as empty; an empty table gives none.
    """
    near, hot = _repeats(df, text_col, size, bucket_rows, part_classes, every=False)
    # All repeats at a place hold the bytes shared there, so together they cover as far as the furthest on either side.
    hot = hot.select("k1", "k2", "at", F.array_max("of.a").alias("_a"), (F.array_max("of.b") + size - BLOCK + 1).alias("_b"))
    hot = hot.select("k1", "k2", F.transform("at", lambda at: F.struct((at - F.col("_a")).alias("start"), (at + F.col("_b")).alias("end"))).alias("spans"))
    spans = near.select("k1", "k2", F.array(F.struct("start", "end")).alias("spans")).union(hot).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keyed = _keyed(df, text_col).select("k1", "k2", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    joined = texts.join(spans, ["k1", "k2"], "left").withColumn("size", F.lit(size))
    return joined.mapInArrow(_cut(), "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def text_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_bytes, k1, k2) of each row: k1 and k2 are two 64-bit hashes of the text."""
    return _keyed(df, text_col).select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), "k1", "k2")
