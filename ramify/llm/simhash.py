"""SimHash near-duplicates with pivot distance tables.

A table, written once, holds the Hamming distances of every distinct fingerprint to a fixed set of
reference fingerprints. By the triangle inequality two fingerprints within ``k`` bits differ by
``k`` at most in every such coordinate. Rows that share a bucket are sorted by their distances: a
sweep over the first coordinate yields only pairs that differ there by ``k`` or less, pairs whose
largest difference in any other coordinate exceeds ``k`` are discarded, and survivors are verified
on all 64 bits.

Buckets only deal the work out: of five blocks of bits, at least two are equal when three bits
differ, so the values of any two blocks make a key. A bucket beyond ``part_rows`` is dealt once more
in the same way by its other bits, and what is still larger is tested in pairs of slices by separate
tasks. A task reports a spanning forest of its links instead of all linked pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ramify.llm.arrow import appended, as_bytes, small_batches
from ramify.llm.components import connected_components
from ramify.scratch import saved


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) or [b" ".join(words)]
    n = len(grams)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n).astype("<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        block = hashes[i : i + 4096]
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, also: list[str] | None = None) -> DataFrame:
    """(id_col, fp): the fingerprint of each row's whole text, as a signed long; or the columns ``also`` and
    the fingerprint's hex digits as _mark."""
    if also is not None:
        return _marked(df.select(*also), text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return small_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _marked(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("_mark", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield appended(batch, arrow, {"_mark": pa.array([f"{fingerprint(t, shingle):016x}" for t in as_bytes(batch.column(text_col))], type=pa.string())})

    return small_batches(df).mapInArrow(run, schema)


def pivots(n: int) -> np.ndarray:
    """``n`` reference fingerprints, the same everywhere."""
    return np.array([xxhash.xxh64_intdigest(b"pivot", i) for i in range(n)], np.uint64)


def pivot_table(fps: DataFrame, n: int) -> DataFrame:
    """(fp, d): the distances of each fingerprint to ``n`` pivots, a byte each."""
    table = pivots(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            d = np.bitwise_count(fp[:, None] ^ table[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(fp), [None, pa.py_buffer(d.tobytes())]).cast(pa.binary())], names=["fp", "d"])

    return fps.select("fp").mapInArrow(run, "fp long, d binary")


def pair_test(fps: np.ndarray, coords: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``k`` bits inside runs of equal ``group``; rows sorted by group and first coordinate."""
    found_a, found_b = [], []
    here = np.arange(len(fps))
    step = 1
    while len(here):
        here = here[here + step < len(fps)]
        there = here + step
        # A row's run only gets shorter, and the first coordinate only farther, as the step grows.
        here = here[(group[here] == group[there]) & (coords[there, 0] - coords[here, 0] <= k)]
        a, b = here, here + step
        for c in range(1, coords.shape[1], 5):
            near = (np.abs(coords[a, c : c + 5] - coords[b, c : c + 5]) <= k).all(axis=1)
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= k
        found_a.append(a[near])
        found_b.append(b[near])
        step += 1
    return np.concatenate(found_a or [here]), np.concatenate(found_b or [here])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that links a-b reach from it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        root = root[root]
        if (root == before).all():
            return root


def masks(bits: int, blocks: int, same: int) -> list[int]:
    """For each choice of ``same`` of ``blocks`` runs of the bits set in ``bits``, those that are chosen."""
    places = [i for i in range(64) if bits >> i & 1]
    edges = [round(i * len(places) / blocks) for i in range(blocks + 1)]
    run = [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(run[i] for i in chosen) for chosen in combinations(range(blocks), same)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, k: int = 3, n_pivots: int = 16, part_rows: int = 512) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within ``k`` bits."""
    blocks, every = k + 2, (1 << 64) - 1
    first = masks(every, blocks, 2)
    second = [[_signed(m | x) for x in masks(every & ~m, blocks, 2)] for m in first]
    table = saved(pivot_table(fps, n_pivots), "pivot-table")

    def dealt(rows: DataFrame, keys: Column) -> tuple[DataFrame, DataFrame]:
        """Rows of small buckets, and of large ones."""
        keyed = rows.select("fp", "d", F.posexplode(keys).alias("c", "key"))
        sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        return keyed.join(sizes.where(F.col("n") <= part_rows), "key"), keyed.join(sizes.where(F.col("n") > part_rows), "key")

    mask = lambda m: F.col("fp").bitwiseAND(m)
    small, large = dealt(table, F.array(*[F.xxhash64(F.lit(c), mask(F.lit(_signed(m)))) for c, m in enumerate(first)]))
    deeper = F.get(F.array(*[F.array(*map(F.lit, x)) for x in second]), F.col("c"))
    again, larger = dealt(large.select("fp", "d", "c", "key"), F.transform(deeper, lambda m: F.xxhash64(F.col("key"), m, mask(m))))
    # What is larger still is cut into g slices; each pair of slices is a part of its own.
    cut = larger.withColumn("g", F.ceil(2 * F.col("n") / part_rows)).withColumn("s", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("g")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
    cut = cut.select("key", "fp", "d", "s", other.alias("t")).where("s != t")
    cut = cut.select("key", (F.shiftleft(F.least("s", "t"), 32) + F.greatest("s", "t")).alias("part"), "d", "fp")
    whole = [x.select("key", F.lit(-1).cast("long").alias("part"), "d", "fp") for x in (small, again)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tested(key: np.ndarray, part: np.ndarray, d: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            a, b = pair_test(fp.view(np.uint64), d, group, k)
            root = forest(len(fp), a, b)
            x = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[root[x]]), pa.array(fp[x])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if batch.num_rows:
                d = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, n_pivots).astype(np.int8)
                held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), d, np.asarray(batch.column(3))))
            if sum(len(h[0]) for h in held) >= 1 << 15:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut_at = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))  # the last part may go on in the next batch
                if cut_at:
                    yield tested(*[c[:cut_at] for c in cols])
                held = [tuple(c[cut_at:] for c in cols)]
        if held:
            yield tested(*[np.concatenate(c) for c in zip(*held, strict=True)])

    parts = whole[0].union(whole[1]).union(cut)
    return parts.repartition("key", "part").sortWithinPartitions("key", "part", "d").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 3, shingle: int = 3) -> DataFrame:
    """Per row: ``id_col``, fingerprint (16 hex digits), component_id, component (its least fingerprint, signed).

    component_id is the smallest id reachable over links of ``k`` differing bits or fewer, the
    row's own included. Texts without words share fingerprint zero and link like any other.
    Null ids never name a component unless all its ids are null. An empty table gives none.
    """
    docs = saved(with_fingerprints(df, id_col, text_col, shingle), "simhash")
    per_fp = docs.groupBy("fp").agg(F.min(id_col).alias("first"))
    found = connected_components(links(per_fp.select("fp"), k))
    rooted = per_fp.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", F.col("root").alias("component"))
    return docs.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")
