"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns with their places. A hash of each candidate's value is
aggregated over the corpus by distinct repositories and owners: values that many of them share
are widely copied examples; values that few have, and that look like a credential, are marked
as live with a span of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.scratch import saved

#: Pattern of each kind, in the order in which kinds are listed. Fixed values.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}
LIVE = "live"
#: Marks the ends of matches; where a text has it, another character outside all patterns stands in.
_MARK, _STAND_IN = "\ue000", "\x01"
_BLOCK = 256  # parts; an even number, so that each block begins between matches


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "assign":
        return text.rlike(r"(?i)password|passwd|secret|token|api_?key")
    return text.contains("AKIA") if kind == "access" else text.rlike("[0-9a-f]{%d}" % MIN_LENGTH["hex"])


def matches(text: Column, kind: str, order: int) -> Column:
    """Array of (start, order, end, value): leftmost non-overlapping matches that are long enough.

    Places are code points. The text is cut at marks around every match, so each second part is
    a match and the lengths of the parts before give its place. Lengths are added up in blocks of
    parts, then over blocks, so that a text of very many matches takes time in proportion.
    """
    group = 2 if kind == "assign" else 0
    # A run of hex digits that is too short fails as a whole, so only long runs need marks.
    pattern = "[0-9a-f]{%d,}" % MIN_LENGTH["hex"] if kind == "hex" else KINDS[kind]
    marked = F.regexp_replace(F.translate(text, _MARK, _STAND_IN), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    kind_of = "array<struct<start:int,kind:int,end:int,value:string>>"
    none = F.array().cast(kind_of)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit(None).cast(kind_of).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        value = F.regexp_extract(part, KINDS[kind], group) if group else part
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(acc["at"].alias("start"), F.lit(order).alias("kind"), end.alias("end"), value.alias("value"))).cast(kind_of)
        good = acc["hit"] & (F.length(value) >= MIN_LENGTH[kind])
        found = F.when(good, F.concat(F.coalesce(acc["found"], none), one)).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), found.alias("found"))

    def blocks(parts: Column) -> Column:
        each = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int"))
        return F.transform(each, lambda i: F.aggregate(F.slice(parts, i * _BLOCK + 1, F.lit(_BLOCK)), start, step))

    def joined(found: Column) -> Column:
        begin = F.aggregate(found, F.array(F.lit(0)).cast("array<int>"), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"]).cast("array<int>")))
        moved = lambda at: lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))
        return F.flatten(F.zip_with(found, F.slice(begin, F.lit(1), F.size(found)), lambda b, at: F.transform(F.coalesce(b["found"], none), moved(at))))

    return F.when(_hint(kind, text), _named(_named(F.split(marked, _MARK, -1), blocks), joined).cast(kind_of)).otherwise(none)


def _named(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def span_text(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span by start, then kind as listed, comma-joined."""
    listed = F.array(*map(F.lit, names))
    one = lambda s: F.concat_ws(":", F.get(listed, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def looks_live(value: Column) -> Column:
    """Digits and letters mixed and at least eight different characters, as generated secrets have."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied


def scanned(df: DataFrame, text_col: str, keep: list[str], repo_col: str, owner_col: str, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """``keep`` plus base (array of start, kind, end, value), and live (the same, kind ``live``).

    A candidate is live when its value occurs in at most ``max_owners`` owners and ``max_repos``
    repositories of the whole corpus and looks generated. Null repositories and owners count as
    one of their own; null texts as empty. Repeated rows are scanned each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[matches(text, kind, n) for n, kind in enumerate(KINDS)])
    rows = df.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), base.alias("base"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")  # numbers stay as written
    each = rows.where(F.size("base") > 0).select("row", "repo", "owner", F.explode("base").alias("s"))
    each = each.withColumn("hash", F.sha2(F.col("s.value"), 256))
    # Distinct (hash, repository, owner) first, so that a value in a third of all rows is aggregated before it moves.
    held = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    repos = held.groupBy("hash", "repo").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("repos"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"))
    rare = repos.where(F.col("repos") <= max_repos).join(owners.where(F.col("owners") <= max_owners), "hash").select("hash")
    value = F.col("s.value")
    live = each.where(looks_live(value)).join(rare, "hash", "left_semi")
    # The value ends a match of any kind, and begins where its length says.
    start = F.col("s.end") - F.length(value)
    span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("s.end").alias("end"), value.alias("value"))
    per_row = live.groupBy("row").agg(F.collect_set(span).alias("live"))
    empty = F.array().cast(rows.schema["base"].dataType)
    return rows.join(per_row, "row", "left").select(*[F.col(f"k_{c}").alias(c) for c in keep], "base", F.coalesce("live", empty).alias("live"))
