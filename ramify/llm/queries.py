"""Queries over the driver's tables: one for each operator, and the corpus pipeline's stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm.bpe import encoded, load_ranks
from ramify.llm.decontam import benchmark_hits, n_hit
from ramify.llm.exact_dedup import exact_groups, normalised
from ramify.llm.hmm_lm import language_model_scores
from ramify.llm.langid import held_out, learn_profiles, with_language
from ramify.llm.quality import quality_scores
from ramify.llm.secrets import KINDS, LIVE, MIN_LENGTH, scanned, span_text
from ramify.llm.sharding import bounded_load_shards
from ramify.llm.simhash import near_duplicates, with_fingerprints
from ramify.llm.suffix_dedup import text_keys, without_repeats
from ramify.scratch import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = bounded_load_shards(docs, "text", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = without_repeats(docs, "text", 400).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return text_keys(docs, "doc_id", "text").join(texts, ["k1", "k2"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeated")
    )


def _contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = benchmark_hits(docs, "text", benchmark).withColumn("n_hit", n_hit())
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang", "n_chars"], table(spark, sf_dir, "labels"), "doc_id", "quality")


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table knows no repositories: what an owner (source) has in one language counts as one of the owner's.
    docs = table(spark, sf_dir, "documents").withColumn("_repo", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    found = scanned(docs, "text", ["doc_id"], "_repo", "source")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    names = [*KINDS, LIVE]
    columns = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *columns, F.sha2(span_text(F.col("base"), names), 256).alias("base_sha256"), span_text(F.concat("base", "live"), names).alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def _profiles(docs: DataFrame) -> dict[str, list[int]]:
    return learn_profiles(docs.where(~held_out(F.col("doc_id"), 4)), "text", "lang")


def op8_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = with_language(docs.select("doc_id", "text"), "text", _profiles(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    return language_model_scores(docs, "doc_id", "text", "held_out")


def _bpe(docs: DataFrame, keep: list[str]) -> DataFrame:
    import public_tokenizers

    out = encoded(docs, "text", keep, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return out.select(*keep, "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe(table(spark, sf_dir, "documents"), ["doc_id"])


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told: null and empty texts and those without a letter.

    With no text of a known language there are no profiles, and all documents go. Rows are
    judged each on its own, repeated ones alike.
    """
    return with_language(docs, "text", _profiles(docs)).where("lang_pred != 'und'").select(*docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays (see ``exact_groups``), null texts counting as empty ones.

    Of rows that repeat the id and text that stays, the one with the most code points, then the
    greatest hash of all columns stays: one of rows that are the same throughout.
    """
    found = saved(exact_groups(docs, "doc_id", "text").select("doc_id", F.col("text_sha256").alias("_mark"), "kept"), "stage-exact")
    best = found.where("kept").select("doc_id", "_mark").distinct()
    mark = lambda rows: rows.withColumn("_mark", F.sha2(normalised(F.col("text")), 256))
    return _one_each(docs, found, best, mark, F.coalesce(F.length("text"), F.lit(0)))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id (null ids last), which names the group.

    Texts without words share fingerprint zero and are a group. Of rows that repeat that id, the
    one with the least fingerprint, then the greatest hash of all columns stays.
    """
    found = saved(near_duplicates(docs, "doc_id", "text").select("doc_id", F.col("fingerprint").alias("_mark"), "component"), "stage-near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_mark")).alias("b")
    best = found.groupBy("component").agg(first).select("b.doc_id", "b._mark")
    return _one_each(docs, found, best, lambda rows: with_fingerprints(rows, "doc_id", "text", also=rows.columns), F.lit(0))


def _one_each(docs: DataFrame, found: DataFrame, best: DataFrame, mark: Callable[[DataFrame], DataFrame], order: Column) -> DataFrame:
    """One row of ``docs`` for each (doc_id, _mark) of ``best``; ``found`` has all rows' ids.

    An id that one row has tells the row. Rows that repeat an id get their marks again by
    ``mark``, and the greatest of ``order``, then of a hash of the columns, stands for those alike.
    """
    ids = found.groupBy("doc_id").agg(F.count("*").alias("m"))
    chosen = best.join(ids.select(F.col("doc_id").alias("_id"), "m"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("_id", "_mark", "m")
    again = saved(chosen.where("m > 1").select("_id", F.col("_mark").alias("_best")).distinct(), "stage-repeated")  # mostly empty, and then read as such
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    once = docs.join(chosen.where("m = 1"), same, "left_semi")
    several = mark(docs.join(again, same, "left_semi"))
    marked = several.join(again, same & (F.col("_mark") == F.col("_best")), "left_semi")
    row = F.struct(*docs.columns)
    one = marked.groupBy("doc_id", "_mark").agg(F.max_by(row, F.struct(order, F.xxhash64(*docs.columns), F.hash(*docs.columns))).alias("_row"))
    return once.union(one.select("_row.*"))


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; null and empty texts and an empty benchmark contaminate none."""
    return _contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the texts' tokens (null texts count as empty); a row for each row."""
    return _bpe(docs, ["doc_id", "lang", "source"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ring_shards, op2_suffix_dedup, op3_benchmark_decontamination, op4_quality_cotraining, op5_simhash_pivots, op6_secret_ownership, op7_exact_dedup, op8_language_profiles, op9_hmm_scores, op10_bpe)
}

def _secret_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Matches of a kind: the text is cut at marks around each, so every second part is one."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT row, owner, repo, {order} AS o, '{kind}' AS kind, start, start + length(part) AS stop, value FROM (
        SELECT row, owner, repo, i, part, coalesce(sum(length(part)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
               regexp_extract(part, '{quoted}', {group}) AS value
        FROM (SELECT row, owner, repo, unnest(p) AS part, generate_subscripts(p, 1) AS i
              FROM (SELECT row, owner, repo, string_split(regexp_replace(t, '{quoted}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS p FROM d)))
      WHERE i % 2 = 0 AND length(value) >= {least}"""


_WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
             p AS (SELECT row, j, substr(x, 2048 * j + 1, 2048 + 798) AS y FROM (SELECT row, x, unnest(range(0, len(x) // 2048 + 1)) AS j FROM d WHERE len(x) >= 800)),
             w AS (SELECT row, 1024 * j + k AS k, md5(substr(y, 2 * k + 1, 800)) AS h FROM (SELECT row, j, y, unnest(range(0, least(1024, len(y) // 2 - 399))) AS k FROM p)),
             hit AS (SELECT row, k FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) often USING (h)),
             marked AS (SELECT row, k, CASE WHEN k > lag(k) OVER (PARTITION BY row ORDER BY k) + 400 THEN 1 ELSE 0 END AS new FROM hit),
             runs AS (SELECT row, min(k) AS a, max(k) + 400 AS b FROM (SELECT row, k, sum(new) OVER (PARTITION BY row ORDER BY k) AS g FROM marked) GROUP BY row, g),
             cut AS (SELECT row, a, b, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS z FROM runs),
             kept AS (SELECT row, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS y,
                             CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM cut JOIN d USING (row) GROUP BY row)
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256,
               len(x) // 2 - coalesce(n_removed, 0) AS n_kept, coalesce(n_removed, 0) > 0 AS repeated
        FROM d LEFT JOIN kept USING (row)""",
    "op3_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORD_SQL} AS w FROM documents),
             b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORD_SQL} AS w FROM benchmark),
             phrases AS (SELECT DISTINCT coalesce(item, '') AS item, least(len(w), 13) AS n, array_to_string(w[k : k + 12], ' ') AS p
                         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
             windows AS (SELECT row, n, k, array_to_string(w[k : k + n - 1], ' ') AS p
                         FROM (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
             hits AS (SELECT row, windows.n, k, item FROM windows JOIN phrases ON windows.n = phrases.n AND windows.p = phrases.p),
             words AS (SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT row, n, k FROM hits)) GROUP BY row),
             items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY row)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)""",
    "op6_secret_ownership": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(57344), chr(1)) AS t, coalesce(source, chr(0)) AS owner,
                          coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
             base AS ({" UNION ALL ".join(_secret_sql(k, i, KINDS[k], 2 if k == "assign" else 0, MIN_LENGTH[k]) for i, k in enumerate(KINDS))}),
             rare AS (SELECT value FROM base GROUP BY value HAVING count(DISTINCT owner) <= 2 AND count(DISTINCT repo) <= 4),
             live AS (SELECT DISTINCT row, {len(KINDS)} AS o, '{LIVE}' AS kind, stop - length(value) AS start, stop, value FROM base SEMI JOIN rare USING (value)
                      WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8),
             own AS (SELECT row, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
                            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o, stop) AS listed FROM base GROUP BY row),
             every AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o, stop) AS spans
                       FROM (SELECT row, o, kind, start, stop FROM base UNION ALL SELECT row, o, kind, start, stop FROM live) GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256,
               coalesce(spans, '') AS spans
        FROM d LEFT JOIN own USING (row) LEFT JOIN every USING (row)""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
             r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS rn,
                          first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
}
