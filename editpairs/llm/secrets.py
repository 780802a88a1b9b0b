"""Secret scan with multipart credential linking (operator 3), in DataFrame functions alone.

Base kinds stand by themselves: assigned secrets, access identifiers, long hexadecimal strings. Two weak
kinds count only beside their complement within a scope, which is SCOPE code points: a bare token, if an
access identifier is near; an endpoint, if an access identifier and a secret of any reported kind are
near. The interval join is a sweep: a document's parts are sorted by place, and each part sees the nearest
part of each kind before and behind it, so its work grows with the parts and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = 300

#: In the order in which kinds at one place are listed. A longest run of a class with at least n characters
#: is what is left of all its longest runs when shorter ones are dropped.
KINDS = ["assign", "access", "hex", "secret", "endpoint"]
ASSIGN, ACCESS, HEX, SECRET, ENDPOINT = range(5)
ASSIGN_KEY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
PATTERNS = [
    ASSIGN_KEY + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]{12,}",
    r"[0-9a-f]{32,}",
    r"[A-Za-z0-9+/_-]{20,}",
    r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?",
]
LEAST_ASSIGNED = 8


def _found(text: Column, kind: int, run: Column, good) -> Column:
    """Array of (kind, no, gap: code points since the match before, size, good) of all matches; empty unless run."""
    match = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    struct = lambda m, i: F.struct(
        F.lit(kind).alias("kind"),
        i.alias("no"),
        F.length(F.get(between, i)).cast("long").alias("gap"),
        F.length(m).cast("long").alias("size"),
        good(m, i).alias("good"),
    )
    return F.when(run, F.transform(match, struct)).otherwise(F.array().cast("array<struct<kind:int,no:int,gap:bigint,size:bigint,good:boolean>>"))


def _places(text: Column) -> Column:
    assigned = F.regexp_extract_all(text, F.lit(PATTERNS[ASSIGN]), F.lit(2))
    yes = lambda m, i: F.lit(True)
    has_access = F.contains(text, F.lit("AKIA"))
    mixed = lambda m, i: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.concat(
        _found(text, ASSIGN, text.rlike(ASSIGN_KEY), lambda m, i: F.length(F.get(assigned, i)) >= LEAST_ASSIGNED),
        _found(text, ACCESS, has_access, yes),
        _found(text, HEX, F.lit(True), yes),
        _found(text, SECRET, has_access, mixed),
        _found(text, ENDPOINT, has_access, yes),
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, array of (start, kind, end) by start and kind, for every row of docs (doc_id, text).

    Places are code points, ends exclusive, kind is a place in KINDS. A null text counts as empty; rows that
    repeat id and text are scanned once and returned as often; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["doc_id", "text_md5"]
    rows = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("text_md5"), _places(text).alias("found"))
    rows = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.first("found").alias("found"))
    part = rows.select(*key, "copies", F.explode_outer("found").alias("x")).select(*key, "copies", "x.*")
    part = part.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(W.partitionBy(*key, "kind").orderBy("no")))
    part = part.withColumn("start", F.col("end") - F.col("size")).filter(F.coalesce("good", F.lit(True)))

    ahead = W.partitionBy(*key).orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)

    def with_near(part: DataFrame, **conditions: Column) -> DataFrame:
        """Adds, by name, whether a part with that condition lies within SCOPE, and as <name>_over whether one overlaps."""
        names = list(conditions)
        part = part.select("*", *(F.max(F.when(conditions[n], F.col("end"))).over(ahead).alias(f"_{n}_end") for n in names))
        part = part.select("*", *(F.min(F.when(conditions[n], F.col("start"))).over(behind).alias(f"_{n}_start") for n in names))
        gap = lambda n: F.least(F.col("start") - F.col(f"_{n}_end"), F.col(f"_{n}_start") - F.col("end"))
        return part.select(
            *(c for c in part.columns if not c.startswith("_")),
            *(F.coalesce(gap(n) <= SCOPE, F.lit(False)).alias(n) for n in names),
            *(F.coalesce(gap(n) < 0, F.lit(False)).alias(f"{n}_over") for n in names),
        )

    part = with_near(part, access_near=F.col("kind") == ACCESS, base_near=F.col("kind") <= HEX)
    secret = (F.col("kind") == SECRET) & F.col("access_near") & ~F.col("base_near_over")
    part = part.withColumn("secret", secret)
    part = with_near(part, secret_near=F.col("kind").isin(ASSIGN, HEX) | F.col("secret"))
    reported = (F.col("kind") <= HEX) | F.col("secret") | ((F.col("kind") == ENDPOINT) & F.col("access_near") & F.col("secret_near"))
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    out = part.groupBy(*key, "copies").agg(F.sort_array(F.collect_list(F.when(reported, span))).alias("spans"))
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*map(F.lit, KINDS))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count(ASSIGN).alias("n_assign"),
        count(ACCESS).alias("n_access"),
        count(HEX).alias("n_hex"),
        F.sha2(as_text(F.filter("spans", lambda s: s["kind"] <= HEX)).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        count(SECRET).alias("n_linked_secrets"),
        count(ENDPOINT).alias("n_linked_endpoints"),
    )
