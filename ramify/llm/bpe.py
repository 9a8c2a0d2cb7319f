"""Byte-level BPE by a global distinct-word shuffle.

Each partition splits its texts into pre-tokens, numbers its distinct ones and keeps every text
as positions into that list. Distinct words meet in one shuffle by their hash, packed by bucket,
are encoded once, and their ids go back to the chunks that have them, where texts are put
together again by position.
Decoding joins the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ramify.llm.arrow import binary, give_back, slices, small_batches
from ramify.scratch import saved_by


class Numbering(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane (compresses well)."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes(a) for a in arrays) + tail)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _split(pattern: str, text_col: str, carried: pa.Schema, chunk_chars: int, buckets: int):
    """Rows of texts (their pre-tokens as numbers) and, for each chunk and bucket, its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        own = [pa.field("chunk", pa.int64()), pa.field("at", pa.binary()), pa.field("bucket", pa.int32()), pa.field("words", pa.binary()), pa.field("numbers", pa.binary()), pa.field("n", pa.int32())]
        schema = pa.schema([*carried, *own])

        def filled(n: int, cols: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

        def chunk_rows(chunk: int, words: dict[str, int], parts: list[pa.RecordBatch], at: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            # Numbers by frequency in the chunk, so that most are small.
            counts = np.bincount(np.concatenate(at), minlength=len(words)) if at else np.zeros(0, np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            done = 0
            for part in parts:
                cols = {f.name: part.column(f.name) for f in carried}
                mine = [packed(rank[x]) for x in at[done : done + part.num_rows]]
                done += part.num_rows
                yield filled(part.num_rows, cols | {"chunk": pa.array([chunk] * part.num_rows, type=pa.int64()), "at": binary(mine)})
            every = [w.encode() for w in words]
            every = [every[i] for i in order]
            bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in every), np.int32, len(every))
            rows = []
            for b in np.unique(bucket):
                numbers = np.flatnonzero(bucket == b)
                chosen = [every[i] for i in numbers]
                rows.append((int(b), packed(np.fromiter(map(len, chosen), np.uint32, len(chosen)), tail=b"".join(chosen)), packed(np.diff(numbers, prepend=0)), len(chosen)))
            if rows:
                b, w, k, n = zip(*rows, strict=True)
                yield filled(len(rows), {"chunk": pa.array([chunk] * len(rows), type=pa.int64()), "bucket": pa.array(b), "words": binary(w), "numbers": binary(k), "n": pa.array(n)})

        chunk, chars, words, parts, at = TaskContext.get().partitionId() << 24, 0, Numbering(), [], []
        for batch in batches:
            for part in slices([batch], text_col, 2 << 20):
                parts.append(part.select([f.name for f in carried]))
                for text in part.column(text_col).to_pylist():
                    found = find(text or "")
                    at.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                    chars += len(text or "")
                if chars >= chunk_chars:
                    yield from chunk_rows(chunk, words, parts, at)
                    chunk, chars, words, parts, at = chunk + 1, 0, Numbering(), [], []
        yield from chunk_rows(chunk, words, parts, at)

    return run


def _encode(ranks, pattern: str):
    """Rows sorted by bucket: every distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            out = []
            for b, n, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "words")), strict=True):
                if b != bucket or len(known) > 400_000:  # a bound on memory; words met again later are encoded again
                    bucket, known = b, {}
                data, at, pieces = unpacked(words), 4 * n, []
                for size in from_planes(data[: 4 * n]).tolist():
                    word = data[at : at + size]
                    at += size
                    if (ids := known.get(word)) is None:
                        ids = known[word] = encode(word)
                    pieces.append(ids)
                flat = np.fromiter((i for p in pieces for i in p), np.uint32)
                out.append(packed(np.fromiter(map(len, pieces), np.uint32, n), flat))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), batch.column("numbers"), binary(out)], names=["of", "n", "numbers", "ids"])
        known.clear()
        give_back()

    return run


def _assemble(ranks, carried: pa.Schema):
    """Texts of a chunk from its words' ids, by position; and back to bytes by the token table."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        token = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for t, r in ranks.value.items():
            token[r] = t
        total = sum(words["n"].to_pylist())
        size, begin, flat, done = np.zeros(total, np.int64), np.zeros(total, np.int64), [], 0
        for n, numbers, ids in zip(*(words[c].to_pylist() for c in ("n", "numbers", "ids")), strict=True):
            k = np.cumsum(from_planes(unpacked(numbers)).astype(np.int64))
            data = unpacked(ids)
            size[k] = from_planes(data[: 4 * n])
            flat.append(from_planes(data[4 * n :]))
            begin[k] = done + np.cumsum(size[k]) - size[k]
            done += len(flat[-1])
        every = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        schema = pa.schema([*carried, pa.field("n_tokens", pa.int64()), pa.field("token_ids", pa.binary()), pa.field("decoded", pa.binary())])
        parts, done, n_tokens, token_ids, decoded, held = [], 0, [], [], [], 0
        docs = docs.combine_chunks()
        for i in range(docs.num_rows):
            k = from_planes(unpacked(docs["at"][i].as_py()))
            n = size[k]
            mine = every[np.repeat(begin[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            n_tokens.append(len(mine))
            token_ids.append(mine.astype("<u4").tobytes())
            decoded.append(b"".join(map(token.__getitem__, mine.tolist())))
            held += len(decoded[-1])
            if held >= 1 << 21 or i == docs.num_rows - 1:  # batches of a few MB, so that Spark never holds a whole chunk
                cols = {"n_tokens": pa.array(n_tokens, type=pa.int64()), "token_ids": binary(token_ids), "decoded": binary(decoded)}
                mine_docs = docs.slice(done, i + 1 - done)
                parts += pa.table([cols[f.name] if f.name in cols else mine_docs[f.name] for f in schema], schema=schema).to_batches()
                done, n_tokens, token_ids, decoded, held = i + 1, [], [], [], 0
        give_back()
        return pa.Table.from_batches(parts, schema)

    return run


def encoded(df: DataFrame, text_col: str, keep: list[str], ranks: dict[bytes, int], pattern: str, chunk_chars: int = 16_000_000, buckets: int | None = None) -> DataFrame:
    """``keep`` plus n_tokens, token_ids (little-endian unsigned 32-bit) and decoded (bytes).

    Null texts count as empty and give no tokens. ``chunk_chars`` bounds what one task puts
    together at a time (a single longer text makes a chunk of its own); ``buckets``, the parts of
    the word shuffle, is the session's number of shuffle partitions unless given.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    clash = {"n_tokens", "token_ids", "decoded", "chunk", "at", "bucket", "words", "numbers", "n", "ids", "of"} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)} before encoding")
    kept = df.select(*keep).schema
    carried = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in kept]))
    sent = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: a fixed table
    split_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept] + list(T._parse_datatype_string("chunk long, at binary, bucket int, words binary, numbers binary, n int").fields))
    source = small_batches(df).select(*dict.fromkeys([*keep, text_col]))
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # In buckets by chunk, so that texts need not move again when their words' ids come back.
    parts = saved_by(source.mapInArrow(_split(pattern, text_col, carried, chunk_chars, buckets), split_schema), "bpe", "chunk", buckets)
    words = parts.where("words is not null").select("bucket", "chunk", "n", "words", "numbers")
    words = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    back = words.mapInArrow(_encode(sent, pattern), "of long, n int, numbers binary, ids binary")
    docs = parts.where("at is not null").select(*[f.name for f in kept], "chunk", "at")
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept] + list(T._parse_datatype_string("n_tokens long, token_ids binary, decoded binary").fields))
    return docs.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_assemble(sent, carried), out)
