"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns find assignments, access keys and hex strings. The corpus then
decides what else is a secret: every candidate value is hashed, and the hashes
are counted by distinct repositories and distinct owners. A value that many
owners or many repositories carry is a widely copied example; one that few carry
looks live.
Bare credential-like tokens whose value is owner-specific join the spans as kind
`owned`, and base spans are marked live or copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_by_count, materialise, table, text_or_empty
from .spans import matches, render

#: Kinds in the order in which spans at one place are listed, with pattern and group of the value.
KINDS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2),
    "access": (r"AKIA[A-Z0-9]{16,}", 0),
    "hex": (r"[0-9a-f]{24,}", 0),
}
#: Bare tokens that may be credentials: long, with letters and a digit; both cases, or a value known from a base span.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST = 6
#: A value of more owners, or of more repositories, than this is a widely copied example.
MAX_OWNERS, MAX_REPOS = 2, 4


def _kind(text: Column, kind: str, rank: int, pattern: str, group: int, least: int = 0) -> Column:
    found = matches(text, pattern, group)
    if least:
        found = F.filter(found, lambda s: F.length(s["value"]) >= least)
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), F.lit(False).alias("strong")
        ),
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Spans and their ownership for every row.

    Returns doc_id, spans (array of start, rank, kind, end, hash, strong),
    owned (the same for added spans), n_live, n_copied, and the owners and
    repositories of its most copied value: most_owners, most_repos (0 without
    candidates). Null texts count as
    empty, null owners as the owner "". Repeated rows are kept apart and each
    gets its spans. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    base = [_kind(text, kind, rank, pattern, group, ASSIGN_LEAST if kind == "assign" else 0) for rank, (kind, (pattern, group)) in enumerate(KINDS.items())]
    bare = F.transform(
        F.filter(matches(text, TOKEN), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            F.lit("owned").alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"),
            (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")).alias("strong"),
        ),
    )
    found = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
            F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]), 256).alias("repo"),
            F.concat(*base).alias("spans"),
            bare.alias("bare"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    # a bare token that touches a base span is that span's, not a new one
    found = found.withColumn("bare", F.filter("bare", lambda b: ~F.exists("spans", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"]))))
    hit = found.where((F.size("spans") > 0) | (F.size("bare") > 0))
    each = hit.select("row", "owner", "repo", F.explode(F.concat("spans", "bare")).alias("s")).withColumn("hash", F.col("s.hash"))
    # first by hash, repository and owner, so that a value copied everywhere is a few rows before it is counted
    seen = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"), F.max(F.col("s.kind") != "owned").alias("known"), F.max("s.strong").alias("strong"))
    owners = seen.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"), F.max("known").alias("known"), F.max("strong").alias("strong"))
    values = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n"), F.max("known").alias("known"), F.max("strong").alias("strong"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos) & (F.col("known") | F.col("strong"))
    values = materialise(values.select("hash", live.alias("live"), "n_owners", "n_repos", "n"))
    judged = join_by_count(each, values, "hash")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("s.kind") == "owned") & F.col("live"), F.col("s"))).alias("owned"),
        F.count_if((F.col("s.kind") != "owned") & F.col("live")).alias("n_live"),
        F.count_if((F.col("s.kind") != "owned") & ~F.col("live")).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    return found.join(per_row, "row", "left").select(
        "doc_id",
        "spans",
        F.coalesce("owned", F.array().cast(found.schema["spans"].dataType)).alias("owned"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repos")],
    )


def op1_ownership_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(render(F.col("spans")), 256).alias("base_sha256"),
        render(F.concat("spans", "owned")).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        "n_live",
        "n_copied",
        "most_owners",
        "most_repos",
    )
