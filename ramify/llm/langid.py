"""Language identification by rank-order profiles.

The profile of a language, and of a document, is its most frequent n-grams of letters (one to
three, within words, a space for each word edge) in order of frequency. A document goes to the
language whose profile its own is least out of place with: the sum over its n-grams of how far
apart the two ranks are, or the profile's length where the language lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramify.llm.arrow import slices, small_batches

_SHIFT = 21  # bits of a code point
#: UTF-8 bytes of texts that are counted at once: n-grams take some 200 bytes for each of them.
_SLICE = 1 << 18


class Letters:
    """Lower-case code point of each letter, 0 for everything else; filled in as characters appear."""

    def __init__(self):
        self.low, self.known = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = points[~self.known[points]]
        for c in np.unique(new):
            ch = chr(c)
            lower = ch.lower()
            self.low[c] = (ord(lower) if len(lower) == 1 else c) if ch.isalpha() else 0
            self.known[c] = True
        return self.low[points]


def gram_counts(texts: list[str], owner: np.ndarray, letters: Letters) -> tuple[np.ndarray, ...]:
    """(owner, n-gram number, count) sorted by the first two; the n-gram of each number as a
    63-bit code; which owners have letters. n-grams of equal owners add up."""
    joined = "\n" + "\n".join(texts) + "\n"  # a word edge before the first text as before any other
    points = letters(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    who = np.repeat(np.r_[owner[:1], owner], [1, *(len(t) + 1 for t in texts)])
    keep = points != 0
    keep |= np.r_[True, keep[:-1]]  # one space for each gap
    points, who = points[keep], who[keep]
    chars = np.flatnonzero(np.bincount(points, minlength=1))
    chars = chars if len(chars) and chars[0] == 0 else np.r_[0, chars]
    small = np.zeros(chars[-1] + 1, np.int64)
    small[chars] = np.arange(len(chars))
    x, a = small[points], len(chars)
    pad = np.r_[0, x, 0]
    prev, nxt = pad[:-2], pad[2:]
    mid = x > 0
    tri = mid  # the middle is a letter; the ends are letters or word edges
    bi = (x > 0) | (nxt > 0)
    cube = a**3
    codes = [x[mid], cube + x[bi] * a + nxt[bi], 2 * cube + (prev[tri] * a + x[tri]) * a + nxt[tri]]
    # An n-gram that begins with a word edge belongs to the text of the letter behind it.
    own_bi = np.where(x > 0, who, np.r_[who[1:], who[-1:]])[bi]
    owners = np.concatenate([who[mid], own_bi, who[tri]])
    key = owners * (3 * cube) + np.concatenate(codes)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count = np.diff(np.r_[first, len(key)])
    doc, local = np.divmod(key[first], 3 * cube)
    number, inverse = np.unique(local, return_inverse=True)
    tag, rest = np.divmod(number, cube)
    parts = [chars[rest // a // a], chars[rest // a % a], chars[rest % a]]
    # Shorter n-grams have zeros in front, and a mark that tells bi- from trigrams at a word's start.
    wide = ((parts[0] << _SHIFT | parts[1]) << _SHIFT | parts[2]) << 1 | (tag == 1)
    return doc, inverse, count, wide.astype(np.int64), np.unique(who[mid])


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, wide: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, gram, rank) of the ``size`` most frequent n-grams of each doc; ties by code."""
    by_code = np.empty(len(wide), np.int64)
    by_code[np.argsort(wide)] = np.arange(len(wide))
    top, n = int(count.max(initial=0)), max(1, len(wide))
    if (int(doc.max(initial=0)) + 1) * (top + 1) * n < 1 << 62:
        key = (doc * (top + 1) + top - count) * n + by_code[gram]
        order = np.argsort(key)
    else:
        order = np.lexsort((by_code[gram], -count, doc))
    doc, gram = doc[order], gram[order]
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.r_[begin, len(doc)]))
    keep = rank < size
    return doc[keep], gram[keep], rank[keep]


def learn_profiles(df: DataFrame, text_col: str, lang_col: str, size: int = 300) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language, over all rows of ``df``.

    Rows with a null language or text don't count. What reaches the driver is ``size`` codes
    for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = Letters(), {}
        for batch in slices(batches, text_col, _SLICE):
            langs = batch.column(lang_col).to_pylist()
            names = sorted(set(langs))
            owner = np.array([names.index(x) for x in langs], np.int64)
            doc, gram, n, wide, _ = gram_counts(batch.column(text_col).to_pylist(), owner, letters)
            for i, name in enumerate(names):
                mine = doc == i
                codes, counts = held.get(name, (np.empty(0, np.int64), np.empty(0, np.int64)))
                codes, back = np.unique(np.concatenate([codes, wide[gram[mine]]]), return_inverse=True)
                held[name] = codes, np.bincount(back, weights=np.concatenate([counts, n[mine]]), minlength=len(codes)).astype(np.int64)
        for name, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), type=pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    rows = small_batches(df).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = totals.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.select("lang", "gram", "r").orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def predicted(texts: list[str | None], names: list[str], tables: list[tuple[np.ndarray, np.ndarray]], letters: Letters, size: int) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``tables``: sorted n-gram codes and their ranks."""
    score, lang = np.zeros(len(texts)), ["und"] * len(texts)
    if not names or not texts:
        return lang, score
    doc, gram, count, wide, lettered = gram_counts([t or "" for t in texts], np.arange(len(texts)), letters)
    doc, gram, rank = ranked(doc, gram, count, wide, size)
    far = np.empty((len(texts), len(names)))
    for j, (codes, ranks) in enumerate(tables):
        at = np.searchsorted(codes, wide)
        at[at == len(codes)] = 0
        theirs = np.where(codes[at] == wide, ranks[at], -1)[gram]
        far[:, j] = np.bincount(doc, weights=np.where(theirs < 0, size, np.abs(theirs - rank)), minlength=len(texts))
    n = np.maximum(1, np.bincount(doc, minlength=len(texts)))
    best = far.argmin(axis=1)
    for i in lettered:
        lang[i] = names[best[i]]
        score[i] = 1 - far[i, best[i]] / (n[i] * size)
    return lang, np.clip(score, 0, 1)


def with_language(df: DataFrame, text_col: str, profiles: dict[str, list[int]], size: int = 300) -> DataFrame:
    """``df`` plus lang_pred and score (0 to 1: how well the profile fits).

    Null texts, texts without a letter and an empty set of profiles give ``und`` and 0; equal
    distances go to the first language by name. Columns of these names are replaced.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from ramify.llm.arrow import appended

    base = small_batches(df).drop("lang_pred", "score")
    schema = T.StructType(list(base.schema.fields) + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    names = sorted(profiles)
    tables = []
    for name in names:
        codes = np.array(profiles[name], np.int64)
        order = np.argsort(codes)
        tables.append((codes[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        filled = [(c, r) for c, r in tables if len(c)]
        used = [n for n, (c, _) in zip(names, tables, strict=True) if len(c)]
        for batch in slices(batches, text_col, _SLICE):
            lang, score = predicted(batch.column(text_col).to_pylist(), used, filled, letters, size)
            yield appended(batch, arrow, {"lang_pred": pa.array(lang, type=pa.string()), "score": pa.array(score)})

    return base.mapInArrow(run, schema)


def held_out(id_col: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part
