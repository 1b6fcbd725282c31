"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every text is searched for assignments, access keys and long hex runs, and for further long tokens of mixed
characters. The candidates' hashes are counted over the whole corpus by distinct repositories and owners: a value
that several owners have is a copied example; a value of one owner that doesn't look like a placeholder is reported
as live-looking. A further token that is live-looking adds a span of its own kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.llm.shared import join_counted, text_of, written

#: The kinds in their order, with their patterns. The first is filtered by its second group's length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the least length in the pattern finds what is left after dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Further candidates: long runs with a digit, a capital and a small letter.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567|(.)\1{5}"


def matches(text: Column, pattern: str, kind: int, good: callable, group: int = 0) -> Column:
    """array<struct> of the leftmost non-overlapping matches, each with the length of the gap before it.

    good: from a match's value (its group) to whether it counts. The places follow from a running sum over gaps and
    lengths, taken over exploded rows: summing within the array would copy it for every match.
    """
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )

    def described(part: Column) -> Column:
        value = F.regexp_extract(part["match"], pattern, group) if group else part["match"]
        return F.struct(
            F.lit(kind).alias("kind"),
            part["gap"].alias("gap"),
            F.length(part["match"]).alias("length"),
            good(value).alias("good"),
            F.unhex(F.sha2(value, 256)).alias("digest"),
            (~value.rlike(PLACEHOLDER)).alias("lively"),
        )

    found = F.transform(F.filter(parts, lambda p: p["match"].isNotNull()), described)
    return F.when(text.rlike(pattern), found)


def _joined(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ","
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns with found, the matches of all kinds; each kind's stand together and in order."""
    text = text_of(docs, text_col)
    every = lambda value: F.lit(True)
    kinds = (
        matches(text, ASSIGN, 0, lambda value: F.length(value) >= 12, 2),
        matches(text, ACCESS, 1, every),
        matches(text, HEX, 2, every),
        matches(text, TOKEN, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,length:int,good:boolean,digest:binary,lively:boolean>>")
    rest = [docs[c] for c in docs.columns if c != text_col]
    return docs.select(*rest, F.concat(*[F.coalesce(k, none) for k in kinds]).alias("found"))


def located(rows: DataFrame) -> DataFrame:
    """(row, owner, repository, kind, start, end, digest, lively) of what counts in rows (row, owner, repository, found).

    Places are code points, ends exclusive. A further token that overlaps a match of the other kinds is left out. All
    windows are over one text's matches; their largest end so far and, from behind, their least start decide overlaps.
    """
    each = rows.select("row", "owner", "repository", F.posexplode("found").alias("at", "m")).select(
        "row", "owner", "repository", "at", "m.*"
    )
    own = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("length")).over(own))
    spans = ends.filter("good").withColumn("start", F.col("end") - F.col("length"))
    base = F.col("kind") < 3
    onward = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    near = spans.withColumn("before", F.max(F.when(base, F.col("end"))).over(onward)).withColumn(
        "after", F.min(F.when(base, F.col("start"))).over(back)
    )
    overlaps = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return near.filter(base | ~overlaps).select("row", "owner", "repository", "kind", "start", "end", "digest", "lively")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories, places) over (digest, owner, repository) rows.

    Three aggregations, each by a longer key first: a value that a third of all rows hold is counted where it is read.
    """
    by_repository = found.groupBy("digest", "owner", "repository").agg(F.count("*").alias("places"))
    by_owner = by_repository.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("digest").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places")
    )


def scan(
    spark: SparkSession,
    docs: DataFrame,
    owner: Column,
    repository: Column,
    *,
    most_owners: int = 1,
    most_repositories: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, base and all spans, live and copied candidates.

    A candidate is copied if its value has more than most_owners owners or most_repositories repositories (a
    repository's name counts once for each owner), and live-looking if it isn't copied and no placeholder. Null texts
    count as empty; a null owner or repository is one of its own. Repeated rows are places of the same owner. An
    empty table gives an empty one; other columns play no part. A text may have any number of candidates; they are
    gathered per row only.
    """
    slim = docs.select(
        docs[id_col].alias("id"), docs[text_col].alias("text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository")
    )
    # the number of a row is written with it, so it can't change when a lost task runs again
    rows = written(spark, candidates(slim).withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    places = written(spark, located(rows), "secret-places")
    verdicts = written(spark, ownership(places), "secret-ownership")
    judged = join_counted(places, verdicts, ["digest"], "places", "inner").withColumn(
        "copied", (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)
    )
    live = ~F.col("copied") & F.col("lively")
    mine, base = F.struct("start", "kind", "end"), F.col("kind") < 3
    by_row = judged.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.count_if(live).alias("n_live"),
        F.count_if("copied").alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.collect_list(F.when(base, mine)).alias("base"),
        F.collect_list(F.when(base | live, mine)).alias("spans"),
    )
    out = rows.select("id", "row").join(by_row, "row", "left")
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    counted = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return out.select(
        F.col("id").alias(id_col),
        *[counted(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.coalesce("base", none)), 256).alias("base_sha256"),
        _joined(F.coalesce("spans", none)).alias("spans"),
        *[counted(c) for c in ("n_live", "n_copied", "most_owners")],
    )
