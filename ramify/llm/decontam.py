"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents, as a sequence of word numbers. Words that no benchmark item
has become separators, and runs of other words shorter than the shortest test phrase can hold
no occurrence, so they are left out before the suffix array is built; nothing that could match
is lost. Test phrases are searched backward, all at once, by ranks in a wavelet matrix over the
Burrows-Wheeler transform; occurrences are located by walking to sampled suffix positions, and
their spans are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ramify.llm.arrow import appended, as_bytes, gathered, small_batches

#: Lower-cases A-Z, keeps digits, letters and all bytes above ASCII; all else separates words.
_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling: each round sorts by pairs of ranks that cover twice the length."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else ahead[:0]
        pair = rank * (n + 1) + ahead + 1
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, pair[order][1:] != pair[order][:-1]])
        if n == 0 or rank.max() == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector of ranks for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in reversed(range(bits)):
            bit = (seq >> level & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~bit)].astype(np.int32)  # zeros before each place
            self.levels.append((level, zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros_like(ends)
        for level, zeros in self.levels:
            one = (symbols >> level & 1).astype(bool)
            start, ends = (np.where(one, zeros[-1] + at - zeros[at], zeros[at]) for at in (start, ends))
        return ends - start


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 16):
        """``seq``: numbers from 1 below ``symbols``; 0 ends it."""
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.starts = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols))]
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols - 1).bit_length()))
        self.sampled = np.where(order % sample == 0, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all patterns, right-aligned rows; backward, word by word."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        width = patterns.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            c = patterns[live, width - back]
            lo[live] = self.starts[c] + self.tree.rank(c, lo[live])
            hi[live] = self.starts[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back until a sampled one, then add the steps."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[at[left]]
            out[left[hit >= 0]] = hit[hit >= 0] + steps[left[hit >= 0]]
            left = left[hit < 0]
            c = self.bwt[at[left]]
            at[left] = self.starts[c] + self.tree.rank(c, at[left])
            steps[left] += 1
        return out


class Phrases:
    """Test phrases of a block of benchmark items: distinct windows and the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(number[item])
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.patterns[k, window - len(p) :] = p
        self.owners = [np.array(sorted(x), np.int64) for x in found.values()]

    def hits(self, docs: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[list[str]]]:
        """Per document: number of words, merged hit spans (starts, ends), item ids found."""
        n_words, kept, place = np.zeros(len(docs), np.int64), [], []
        least, get = int(self.lengths.min()) if len(self.lengths) else 0, self.vocab.get
        zero = np.zeros(1, np.int64)
        for d, text in enumerate(docs):
            words = words_of(text)
            n_words[d] = len(words)
            if not least:
                continue
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate([zero, (ids > 0).astype(np.int8), zero])))
            for a, b in edge.reshape(-1, 2):
                if b - a >= least:
                    kept.append(np.append(ids[a:b], len(self.vocab) + 1))
                    place.append((d, a, b - a + 1))
        spans: list[tuple[np.ndarray, np.ndarray]] = [(zero[:0], zero[:0])] * len(docs)
        owned: list[list[str]] = [[] for _ in docs]
        if not kept:
            return n_words, spans, owned
        index = FMIndex(np.concatenate(kept), len(self.vocab) + 2)
        lo, hi = index.search(self.patterns, self.lengths)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        at = index.locate(rows)
        doc, first, size = (np.array(x, np.int64) for x in zip(*place, strict=True))
        begin = np.cumsum(size) - size
        run = np.searchsorted(begin, at, side="right") - 1
        start = at - begin[run] + first[run]
        order = np.lexsort((start, doc[run]))
        for group in np.split(order, np.flatnonzero(np.diff(doc[run][order])) + 1) if len(order) else ():
            d = int(doc[run[group[0]]])
            s, e = start[group], np.maximum.accumulate(start[group] + self.lengths[which[group]])
            new = np.r_[True, s[1:] > e[:-1]]
            spans[d] = (s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]])
            owned[d] = [self.items[i] for i in sorted({int(i) for w in np.unique(which[group]) for i in self.owners[w]})]
        return n_words, spans, owned


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in blocks of about ``block_bytes`` of text, read one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"].encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_hits(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` plus n_words, spans (removal spans in words, merged, end exclusive) and item_ids.

    A phrase is ``window`` consecutive words of an item, or a shorter item's all. Each block of
    the benchmark is one more pass over the same rows, without a shuffle. Null texts have no
    words; items without words have no phrase; item ids become strings, null an empty one. The
    three new columns replace columns of the same names.
    """
    out = small_batches(docs).drop("n_words", "spans", "item_ids")
    kept = list(out.columns)
    added = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"
    schema = T.StructType(list(out.schema.fields) + list(T._parse_datatype_string(added).fields))
    done = False
    for block in benchmark_blocks(benchmark, item_col, item_text, block_bytes):
        out, done = _pass(out, schema, text_col, block, window, done), True
    if not done:
        out = _pass(out, schema, text_col, [], window, False)
    return out.select(*kept, "n_words", "spans", "item_ids")


def _pass(df: DataFrame, schema: T.StructType, text_col: str, block: list[tuple[str, bytes]], window: int, more: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(block)  # block_bytes at most, and one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        for batch in gathered(batches, text_col, 8 << 20):
            n_words, spans, owned = phrases.hits(as_bytes(batch.column(text_col)))
            if more:
                for i, (old, ids) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)):
                    if old:
                        spans[i] = merged([(x["start"], x["end"]) for x in old] + list(zip(*spans[i], strict=True)))
                    owned[i] = sorted({*ids, *owned[i]})
            offsets = np.cumsum([0, *(len(s) for s, _ in spans)])
            flat = [np.concatenate([x[i] for x in spans]) if spans else np.empty(0, np.int64) for i in (0, 1)]
            pairs = pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in flat], names=["start", "end"])
            columns = {"n_words": pa.array(n_words), "spans": pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pairs), "item_ids": pa.array(owned, type=pa.list_(pa.string()))}
            yield appended(batch, arrow, columns)

    return df.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for s, e in sorted((int(s), int(e)) for s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def n_hit(spans: str = "spans"):
    """Words inside any span."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


