"""Exact deduplication: counting quotient filters find repeated fingerprints, bytes decide.

Each partition builds quotient filters of its rows' fingerprints, one for each of ``blocks``
ranges of fingerprints. Filters of a range merge by their sorted remainders; fingerprints with
a count above one send their rows to byte verification, where rows are grouped by the
normalised text itself. Nothing is dropped by a fingerprint alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.quotient import QuotientFilter
from ramify.scratch import saved

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without the characters space, tab, line feed, vertical tab, form feed, return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def repeated_fingerprints(df: DataFrame, fingerprint: str, block_bits: int = 10) -> DataFrame:
    """Column ``fp``: the values of the long column ``fingerprint`` that more than one row has."""

    total = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, fresh, n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def compact() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([held, *fresh])
            order = np.argsort(every, kind="stable")
            every, c = every[order], np.concatenate([counts, np.ones(n, np.int64)])[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
            return every[first], np.add.reduceat(c, first) if len(every) else c

        for batch in batches:
            fresh.append(np.asarray(batch.column(0)).view(np.uint64))
            n += batch.num_rows
            if n > max(1 << 18, len(held)):  # so that each fingerprint is sorted a few times at most
                (held, counts), fresh, n = compact(), [], 0
        held, counts = compact()
        blocks = (held >> np.uint64(total)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]][: len(blocks)])
        rows = []
        for a, b in zip(starts, np.r_[starts[1:], len(blocks)], strict=True) if len(blocks) else ():
            low = held[a:b] & np.uint64((1 << total) - 1)
            rows.append((int(blocks[a]), *QuotientFilter.of_sorted(low, counts[a:b], total).packed()))
        names = ("block", "occupied", "run_end", "remainders", "counts")
        if rows:
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stack = None, []  # filters of the block, each more than twice as large as the next

        def repeated() -> pa.RecordBatch:
            while len(stack) > 1:
                stack.append(stack.pop().merge(stack.pop()))
            f = stack.pop()
            fp = f.fingerprints()[f.counts > 1] | np.uint64(block) << np.uint64(total)
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stack and block != row[0]:
                    yield repeated()
                block = row[0]
                stack.append(QuotientFilter.unpacked(*row[1:], total - (len(row[1]) * 8).bit_length() + 1))
                while len(stack) > 1 and len(stack[-2].counts) <= 2 * len(stack[-1].counts):
                    stack.append(stack.pop().merge(stack.pop()))
        if stack:
            yield repeated()

    filters = df.select(fingerprint).mapInArrow(build, "block int, occupied binary, run_end binary, remainders binary, counts binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "fp long")


def exact_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without white space; null counts as empty. Of equal
    texts the row with the most code points in the original, then the smallest id, stays
    (null ids last). Rows that repeat an id along with its text share their decision.
    """
    norm = normalised(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), norm.alias("norm"))
    rows = rows.select("id", "n", "norm", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"))
    heads = saved(rows.select("id", "n", "fp", "sha"), "exact")
    repeated = saved(repeated_fingerprints(heads, "fp"), "exact-fp")
    suspects = rows.join(repeated, "fp", "left_semi")
    # Byte verification: the text is part of the grouping key; equal ones meet before the shuffle.
    best = F.max_by(F.col("id"), F.struct(F.col("n"), F.col("id").isNotNull(), -F.col("id")))
    verified = suspects.groupBy("sha", "norm").agg(best.alias("keep_id"), F.count("*").alias("size"), F.max("n").alias("top")).drop("norm").where("size > 1")
    out = heads.join(verified, "sha", "left")
    single = F.col("size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("top"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
