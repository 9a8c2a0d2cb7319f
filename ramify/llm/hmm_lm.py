"""A hidden Markov language model over word classes, trained by Baum-Welch.

Every frequent word is a class of its own; all others fall into classes by their last bytes. A
hidden chain emits classes, and a class emits its words by their counts in the whole training
corpus (one place in each class is kept for words never seen), so every text has an exact
probability. Expected counts of a round are computed in each partition and added up; texts are
scored by the scaled forward recursion, whose steps are matrix products and are therefore
multiplied together segment by segment, all segments at a time.

Word counts never reach the driver as a whole: words with a share of ``share`` or more of all
tokens (1 / share of them at most) are sent to all tasks, the rest are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.arrow import as_bytes, binary, slices, small_batches
from ramify.llm.bpe import Numbering
from ramify.scratch import saved

END = b""  # no word is empty, so this stands for the end of a text
SUFFIX_CLASSES = 256
SINGLE_CLASSES = 256
SEGMENT = 128


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def word_hashes(words: Collection[bytes]) -> np.ndarray:
    """Signed 64-bit hash of each word."""
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


def suffix_classes(words: Collection[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-3:]) for w in words), np.int64, len(words)) % SUFFIX_CLASSES


def word_counts(df: DataFrame, text_col: str, flush: int = 600_000) -> DataFrame:
    """(h, suffix, c): counts of all tokens of ``df`` by 64-bit hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words: Counter[bytes]) -> pa.RecordBatch:
            counts = np.fromiter(words.values(), np.int64, len(words))
            return pa.RecordBatch.from_arrays([pa.array(word_hashes(words)), pa.array(suffix_classes(words).astype(np.int32)), pa.array(counts)], names=["h", "suffix", "c"])

        words: Counter[bytes] = Counter()
        for batch in slices(batches, text_col, 1 << 20):
            words.update(chain.from_iterable(map(tokens, as_bytes(batch.column(0)))))
            if len(words) > flush:
                yield rows(words)
                words = Counter()
        yield rows(words)

    return df.select(text_col).mapInArrow(run, "h long, suffix int, c long").groupBy("h", "suffix").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


@dataclass
class Vocabulary:
    """What is known of the words: frequent ones in order of their hashes, and the totals of each class."""

    total: int
    distinct: int
    hashes: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)
    single: np.ndarray = field(repr=False)  # the word's own class, or -1
    sums: np.ndarray = field(repr=False)  # log10 of tokens + distinct words + 1, by class

    @property
    def classes(self) -> int:
        return SINGLE_CLASSES + SUFFIX_CLASSES


def vocabulary(counts: DataFrame, share: float) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = counts.where((F.col("c") >= total * share) & (F.lit(total) > 0)).select("h", "c").collect()  # 1 / share at most
    pairs = np.array(sorted((r["h"], r["c"]) for r in rows), np.int64).reshape(-1, 2)
    hashes, held = pairs[:, 0], pairs[:, 1]
    first = np.lexsort((hashes, -held))[:SINGLE_CLASSES]
    single = np.full(len(hashes), -1)
    single[first] = np.arange(len(first))
    top = hashes[first].tolist()
    rest = counts.where(~F.col("h").isin(top)) if top else counts
    sums = np.ones(SINGLE_CLASSES + SUFFIX_CLASSES)
    sums[: len(first)] += held[first] + 1
    for r in rest.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # SUFFIX_CLASSES rows
        sums[SINGLE_CLASSES + r["suffix"]] += r["c"] + r["n"]
    return Vocabulary(total, distinct, hashes, held, single, np.log10(sums))


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` as a row for each pair of neighbours in ``ends``."""
    offsets = pa.array(ends * values.itemsize, type=pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())]).cast(pa.binary())


def class_sequences(df: DataFrame, id_col: str, text_col: str, held_col: str, sent) -> DataFrame:
    """Per row: its class sequence, sums over its frequent words, and hashes of the other words."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, single = sent.value
        row = TaskContext.get().partitionId() << 40
        words = Numbering()
        cls, log_c, hashes = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64)
        for batch in slices(batches, text_col, 1 << 20):
            texts = [tokens(t) for t in as_bytes(batch.column(text_col))]
            ends = np.cumsum([0, *map(len, texts)])
            ids = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), np.int64, ends[-1])
            new = list(islice(words, len(cls), None))
            h = word_hashes(new)
            hashes = np.concatenate([hashes, h])
            if new:
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                there = known[at] == h if len(known) else np.zeros(len(h), bool)
                own = np.where(there, single[at], -1) if len(known) else np.full(len(h), -1)
                cls = np.concatenate([cls, np.where(own >= 0, own, SINGLE_CLASSES + suffix_classes(new)).astype(np.uint16)])
                log_c = np.concatenate([log_c, np.where(there, np.log10(held[at] + 1.0), np.nan) if len(known) else np.full(len(h), np.nan)])
            mine = log_c[ids]
            rare = np.isnan(mine)
            rare_ends = np.concatenate([[0], np.cumsum(rare)])[ends]
            n_tokens = np.diff(ends)
            held_sums = np.add.reduceat(np.where(rare, 0.0, mine), ends[:-1])  # every text has its end
            n = batch.num_rows
            arrays = [pa.array(range(row, row + n), type=pa.int64()), batch.column(id_col), batch.column(held_col), pa.array(n_tokens), pa.array(n_tokens - np.diff(rare_ends)), pa.array(held_sums), packed(cls[ids], ends), packed(hashes[ids[rare]], rare_ends)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "held_out", "n_tokens", "frequent", "log_c", "classes", "rare"])
            row += n
            if len(words) > 500_000:
                words = Numbering()
                cls, log_c, hashes = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64)

    return df.select(id_col, text_col, held_col).mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, frequent long, log_c double, classes binary, rare binary")


def segments(seqs: list[np.ndarray], segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Sequences (none empty) cut into segments, longest first: each one's sequence and number in it,
    tokens by place and segment, sizes, and how many are longer than each place."""
    cut = [(i, k, s[a : a + segment]) for i, s in enumerate(seqs) for k, a in enumerate(range(0, len(s), segment))]
    cut.sort(key=lambda c: (-len(c[2]), c[0], c[1]))
    sizes = np.array([len(c) for _, _, c in cut])
    rows = np.zeros((len(cut), sizes[0]), np.uint16)
    for row, (_, _, c) in zip(rows, cut, strict=True):
        row[: len(c)] = c
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()
    return np.array([i for i, _, _ in cut]), np.array([k for _, k, _ in cut]), rows.T.astype(np.int64, order="C"), sizes, live


def products(obs: np.ndarray, live: list[int], begin: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """``begin`` times each segment's steps (move, then emit), and log10 of the factor taken out.

    States come first and segments last, in ``begin`` (states x rows x segments) too, so that all
    segments are worked on in runs of memory, and a step is one product of matrices. The first
    token is in ``begin`` already.
    """
    step = np.ascontiguousarray(m.move.T)
    now, out, logs = begin, np.empty_like(begin), np.zeros(begin.shape[2])
    s_n, rows = begin.shape[:2]
    for t in range(1, len(live)):
        n = live[t]
        if n < now.shape[2]:
            out[:, :, n : now.shape[2]], now = now[:, :, n:], now[:, :, :n]
        if not n:
            break
        now = (step @ now.reshape(s_n, -1)).reshape(s_n, rows, n)
        now *= m.emit.take(obs[t, :n], axis=1)[:, None, :]
        if t % 8 == 7:
            scale = now.max(axis=(0, 1))
            logs[:n] += np.log10(scale)
            now /= scale
    out[:, :, : now.shape[2]] = now
    scale = out.max(axis=(0, 1))
    return out / scale, logs + np.log10(scale)


def chained(owner: np.ndarray, number: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """Pairs of places in ``part``: a segment of a sequence and its next one; a list for each number."""
    order = part[np.lexsort((number[part], owner[part]))]
    back = np.empty(len(owner), np.int64)
    back[part] = np.arange(len(part))
    a, b = order[:-1], order[1:]
    next_to = owner[a] == owner[b]
    a, b = a[next_to], b[next_to]
    by = np.argsort(number[a], kind="stable")
    cuts = np.flatnonzero(np.diff(number[a[by]])) + 1
    return [back[np.stack([x, y])] for x, y in zip(np.split(a[by], cuts), np.split(b[by], cuts), strict=True)] if len(a) else []


def expected_counts(seqs: list[np.ndarray], m: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all sequences: expected starts, moves and emissions.

    Sequences are cut into segments, which are all run at once, longest first. What comes before and
    after a segment is a vector each, carried over by the products of the other segments, so cuts
    change nothing. States come first in all arrays, segments last.
    """
    seqs = [s for s in seqs if len(s)]
    s_n, c_n = m.emit.shape
    start, move = np.zeros(s_n), np.zeros((s_n, s_n))
    if not seqs:
        return start, move, np.zeros((s_n, c_n))
    owner, number, obs, sizes, live = segments(seqs, segment)
    fresh = number == 0
    emit = np.ascontiguousarray(m.emit)

    # Messages: of the states before each segment, and of what follows its last token.
    before, after = np.full((s_n, len(owner)), 1 / s_n), np.ones((s_n, len(owner)))
    part = np.flatnonzero(np.array([len(s) > segment for s in seqs])[owner])
    if len(part):
        moves = np.where(fresh[part], m.start[:, None, None], m.move.T[:, :, None])
        begin = moves * emit.take(obs[0, part], axis=1)[:, None, :]
        product, _ = products(obs[:, part], np.searchsorted(part, live).tolist(), begin, m)  # to, from, segment
        steps = chained(owner, number, part)
        for a, b in steps:
            v = np.einsum("sn,tsn->tn", before[:, part[a]], product[:, :, a])
            before[:, part[b]] = v / v.sum(axis=0)
        for a, b in reversed(steps):
            v = np.einsum("tsn,tn->sn", product[:, :, b], after[:, part[b]])
            after[:, part[a]] = v / v.sum(axis=0)

    step = np.ascontiguousarray(m.move.T)
    ahead, scales = [], []
    for t, n in enumerate(live):
        a = np.where(fresh, m.start[:, None], step @ before) if t == 0 else step @ ahead[-1][:, :n]
        a *= emit.take(obs[t, :n], axis=1)
        scale = a.sum(axis=0)
        a /= scale
        ahead.append(a)
        scales.append(scale)
    last = np.empty((s_n, len(owner)))
    for t, n in enumerate(live):
        done = live[t + 1] if t + 1 < len(live) else 0
        last[:, done:n] = ahead[t][:, done:]
    beta = after / (last * after).sum(axis=0)
    for t in reversed(range(len(live))):
        n = live[t]
        out = emit.take(obs[t, :n], axis=1)
        out *= beta[:, :n]
        out /= scales[t]
        ahead[t] *= beta[:, :n]  # now the share of each state
        if t == 0:
            start += ahead[0][:, fresh].sum(axis=1)
            move += before[:, ~fresh] @ out[:, ~fresh].T
        else:
            move += ahead[t - 1][:, :n] @ out.T
            beta[:, :n] = m.move @ out
    codes = np.concatenate([obs[t, :n] for t, n in enumerate(live)])
    return start, move * m.move, np.stack([np.bincount(codes, weights=np.concatenate([a[s] for a in ahead]), minlength=c_n) for s in range(s_n)])


def initial(states: int, class_share: np.ndarray, centre: np.ndarray | None = None, texts: np.ndarray | None = None) -> Model:
    """A start that differs by state, the same on every run: ``centre`` are roots of class shares of
    clusters of texts and ``texts`` their numbers of texts; random emissions without them."""
    rng = np.random.default_rng(7)
    start = np.full(states, 1 / states)
    emit = class_share[None, :] * rng.gamma(2.0, 1.0, (states, len(class_share)))
    if centre is not None:
        start = (texts + 1) / (texts.sum() + states)
        emit = 0.8 * centre**2 / (centre**2).sum(axis=1, keepdims=True) + 0.2 * emit / emit.sum(axis=1, keepdims=True)
    move = 0.1 * start[None, :] + 0.9 * np.eye(states)
    return Model(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def root_shares(data: list[bytes], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of each text's class shares, and its number of tokens."""
    n = np.array([len(d) // 2 for d in data], np.int64)
    code = np.repeat(np.arange(len(data)) * classes, n) + np.frombuffer(b"".join(data), np.uint16)
    shares = np.bincount(code, minlength=len(data) * classes).reshape(-1, classes) / n[:, None]
    return np.sqrt(shares, out=shares), n


def gaps(root: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of texts to centres."""
    return np.maximum(0, np.einsum("ij,ij->i", root, root)[:, None] - 2 * (root @ centre.T) + (centre**2).sum(axis=1)[None, :])


def text_clusters(sequences: DataFrame, class_share: np.ndarray, states: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """k-means over all texts, each weighing as much as its tokens: (centres as roots of shares, texts of each).

    Seeds are drawn from all texts in proportion to weight and squared distance to earlier seeds:
    the smallest of -log(u) / (weight * distance) wins, where u is a hash of the text, so copies
    draw once and partitions don't matter. With fewer distinct texts than states the other centres
    are the shares of the corpus.
    """
    classes = len(class_share)

    def draw(centre: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: tuple[float, bytes] | None = None
            for batch in slices(batches, "classes", 1 << 20, 1024):
                data = batch.column(0).to_pylist()
                root, n = root_shares(data, classes)
                far = gaps(root, centre).min(axis=1) if len(centre) else np.ones(len(n))
                u = (np.array([xxhash.xxh64_intdigest(d, seed=len(centre) + 1) for d in data], np.float64) + 1) / 2.0**64
                key = np.where(far > 1e-9, -np.log(np.minimum(u, 1 - 1e-16)) / (n * np.maximum(far, 1e-9)), np.inf)
                k = int(np.argmin(key))
                if key[k] < np.inf:
                    best = min(filter(None, (best, (float(key[k]), data[k]))))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), binary([best[1]])], names=["key", "classes"])

        rows = sequences.select("classes").mapInArrow(run, "key double, classes binary").orderBy("key", "classes").limit(1).collect()
        return root_shares([bytes(rows[0]["classes"])], classes)[0] if rows else np.sqrt(class_share)[None, :]

    def sums_by(centre: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((states, classes + 2))
            for batch in slices(batches, "classes", 1 << 20, 1024):
                root, n = root_shares(batch.column(0).to_pylist(), classes)
                mine = np.eye(states)[gaps(root, centre).argmin(axis=1)].T
                sums += np.hstack([(mine * n) @ root, (mine @ n)[:, None], mine.sum(axis=1)[:, None]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["k", "x"])

        out = np.zeros(states * (classes + 2))
        for r in sequences.select("classes").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # one row for each sum
            out[r["k"]] = r["x"]
        return out.reshape(states, classes + 2)

    centre = np.zeros((0, classes))
    while len(centre) < states:
        centre = np.vstack([centre, draw(centre)])
    texts = np.zeros(states)
    for _ in range(rounds):
        sums = sums_by(centre)
        texts, weight = sums[:, -1], sums[:, -2:-1]
        moved = np.where(weight > 0, sums[:, :-2] / np.maximum(weight, 1), centre)
        still, centre = np.abs(moved - centre).max() < 1e-4, moved
        if still:
            break
    return centre, texts


def trained(sequences: DataFrame, classes: int, states: int, rounds: int) -> Model:
    """Baum-Welch over all rows of ``sequences`` (column classes)."""
    size = states + states * states + states * classes

    def counts_of(m: Model | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size if m else classes)
            for batch in slices(batches, "classes", 1 << 20):
                data = batch.column(0).to_pylist()
                if m is None:
                    sums += np.bincount(np.frombuffer(b"".join(data), np.uint16), minlength=classes)
                else:
                    sums += np.concatenate([x.ravel() for x in expected_counts([np.frombuffer(d, np.uint16) for d in data], m)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["k", "x"])

        rows = sequences.select("classes").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # one row for each parameter
        out = np.zeros(size if m else classes)
        for r in rows:
            out[r["k"]] = r["x"]
        return out

    share = counts_of(None) + 0.5
    share /= share.sum()
    model = initial(states, share, *text_clusters(sequences, share, states))
    for _ in range(rounds):
        sums = counts_of(model)
        start, move, emit = sums[:states] + 0.1, sums[states : states + states**2].reshape(states, states) + 0.1, sums[states + states**2 :].reshape(states, classes) + 0.01
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return model


def log10_forward(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 probability of each class sequence (none empty), by the scaled forward recursion.

    Row vector times one matrix per token. The first segment of each sequence is run as a vector;
    the matrices of the others are multiplied for all segments at once, then each sequence's
    segments in order.
    """
    if not seqs:
        return np.zeros(0)
    owner, number, obs, _, live = segments(seqs, SEGMENT)
    state, out = np.zeros((len(m.start), len(seqs))), np.zeros(len(seqs))
    for first in (True, False):
        part = np.flatnonzero((number == 0) == first)
        if not len(part):
            continue
        begin = m.emit.take(obs[0, part], axis=1)[:, None, :] * (m.start[:, None, None] if first else m.move.T[:, :, None])
        product, logs = products(obs[:, part], np.searchsorted(part, live).tolist(), begin, m)
        if first:
            state[:, owner[part]], out[owner[part]] = product[:, 0], logs
            continue
        by = np.argsort(number[part], kind="stable")
        for col in np.split(by, np.flatnonzero(np.diff(number[part[by]])) + 1):
            i = owner[part[col]]
            v = np.einsum("sn,tsn->tn", state[:, i], product[:, :, col])
            scale = v.sum(axis=0)
            out[i] += np.log10(scale) + logs[col]
            state[:, i] = v / scale
    return out + np.log10(state.sum(axis=0))


def language_model_scores(df: DataFrame, id_col: str, text_col: str, held_col: str, states: int = 6, rounds: int = 3, share: float = 1e-6) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose boolean ``held_col`` is false. score is the model's log10
    probability of the text with its end. base_score is that of a unigram model with one added
    to each count. Null texts have the end as their only token; with no training rows all
    words are unseen. Repeated rows are scored each.
    """
    spark = small_batches(df).sparkSession
    counts = saved(word_counts(df.where(~F.col(held_col)), text_col), "lm-counts")
    v = vocabulary(counts, share)
    sent = spark.sparkContext.broadcast((v.hashes, v.counts, v.single))  # plain arrays: executors may lack this package
    rows = saved(class_sequences(df, id_col, text_col, held_col, sent), "lm-rows")
    model, sums = trained(rows.where("not held_out"), v.classes, states, rounds), v.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "classes", 1 << 20):
            seqs = [np.frombuffer(d, np.uint16) for d in batch.column("classes").to_pylist()]
            forward = log10_forward(seqs, model)
            words = np.array([sums[s].sum() for s in seqs])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(forward - words)], names=["row", "model"])

    def rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "rare", 1 << 20):
            data = batch.column("rare").to_pylist()
            h = np.frombuffer(b"".join(data), np.int64)
            row = np.repeat(np.asarray(batch.column("row")), [len(d) // 8 for d in data])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(h)], names=["row", "h"])

    rare = rows.select("row", "rare").where(F.octet_length("rare") > 0).mapInArrow(rare_rows, "row long, h long")
    seen = rare.join(counts.where(F.col("c") < v.total * share).select("h", "c"), "h").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("s"))
    scored = rows.select("row", "classes").mapInArrow(run, "row long, model double")
    out = rows.drop("classes", "rare").join(seen, "row", "left").join(scored, "row")
    log_c = F.col("log_c") + F.coalesce("s", F.lit(0.0))
    floor = float(np.log10(float(v.total + v.distinct + 1)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("frequent") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * floor).alias("base_score"),
        (log_c + F.col("model")).alias("score"),
    )
