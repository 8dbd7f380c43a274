"""Secrets in texts, with SQL functions only: direct patterns, and multipart credentials by linking their parts.

Direct patterns (assign, access, hex) are reported wherever they match. Weak candidates are things that say little
alone: an unlabelled 40-character secret, an account identifier, an endpoint. They are reported only when a
complementary part stands in the same scope, SCOPE code points at most from one to the other: an identifier needs a
secret, a secret an identifier or an endpoint, an endpoint a secret. An interval join finds that: on the document
and the cells of a part's two ends, then on the distance. A cell holds a bounded number of ends, so no document makes a
large group.
Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, durable

SCOPE = 256
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order: pattern, and the least length of the match or of its group.
BASE = {
    "assign": (ASSIGN, 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # Only runs of 24 up are looked for: shorter matches would be dropped, and a run that fails at its start fails later.
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
}
#: Weak kinds: pattern and role.
WEAK = {
    "secret40": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", "secret"),
    "identifier": (r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@-]{4,}+""", "id"),
    "endpoint": (r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%-]{4,}+", "endpoint"),
}
ROLES = {"assign": "secret", "hex": "secret", "access": "id"}


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end) of pattern's leftmost non-overlapping matches whose group has at least that length.

    Places follow from the lengths of the matches and of what stands between them.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.zip_with(F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("n"))), parts, lambda x, g: F.struct(x.gap.alias("gap"), x.n.alias("n"), F.char_length(g).alias("of")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,of:int>>").alias("out"))
    walked = F.aggregate(lengths, start, lambda a, x: F.struct((a.at + x.gap + x.n).alias("at"), F.concat(a.out, F.array(F.struct((a.at + x.gap).alias("start"), (a.at + x.gap + x.n).alias("end"), x.of.alias("of")))).alias("out")), lambda a: a.out)
    kept = F.transform(F.filter(walked, lambda m: m.of >= least), lambda m: F.struct(m.start.alias("start"), m.end.alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def listed(kinds: dict, found: Column) -> Column:
    """The matches of several kinds, a struct of arrays, as one array of (start, place of the kind, end, kind) in order."""

    def named(k: int, kind: str) -> Column:
        return F.transform(found[kind], lambda m: F.struct(m.start.alias("start"), F.lit(k).alias("k"), m.end.alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(named(k, kind) for k, kind in enumerate(kinds))))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s.kind, F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


SPANS = "array<struct<start:int,k:int,end:int,kind:string>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans and secret_spans (base ones and linked parts), arrays of (start, k, end, kind) in order.

    A null or empty text has no spans. Repeated rows are independent: a row number, fixed by writing the scanned
    table, links parts to their row. Columns of docs with the names of new ones are replaced. An empty table gives
    no rows.
    """
    kept = [c for c in docs.columns if c not in ("base_spans", "secret_spans")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = F.struct(*(matches(text, *how).alias(kind) for kind, how in BASE.items()))
    weak = F.struct(*(matches(text, pattern, 0, 1).alias(kind) for kind, (pattern, _) in WEAK.items()))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.monotonically_increasing_id().alias("_rid"), base.alias("_base"), weak.alias("_weak"))
    kinds = {**BASE, **WEAK}
    scanned = durable(found.select("_row", "_rid", listed(BASE, F.col("_base")).alias("_base"), listed(WEAK, F.col("_weak")).alias("_weak")), "secret-spans")

    parts = scanned.where(F.size("_weak") > 0).select("_rid", F.explode(F.concat("_base", F.transform("_weak", lambda s: F.struct(s.start.alias("start"), (s.k + len(BASE)).alias("k"), s.end.alias("end"), s.kind.alias("kind"))))).alias("s")).select("_rid", "s.*")
    role = F.create_map(*(F.lit(x) for kind in kinds for x in (kind, ROLES.get(kind) or WEAK[kind][1])))[F.col("kind")]
    parts = parts.select("_rid", "start", "k", "end", "kind", role.alias("role"))
    cell = lambda place: F.floor(place / SCOPE)
    ask = parts.where(F.col("k") >= len(BASE)).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - SCOPE), cell(F.col("end") + SCOPE)))).alias("a")
    # Of a part before a, the end is in reach; of one behind it, the start. A part may be of any length.
    other = parts.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(F.col("end")))))).alias("b")
    complementary = ((F.col("a.role") == "secret") & F.col("b.role").isin("id", "endpoint")) | ((F.col("a.role") != "secret") & (F.col("b.role") == "secret"))
    apart = (F.col("b.start") >= F.col("a.end")) | (F.col("a.start") >= F.col("b.end"))
    near = (F.col("b.start") - F.col("a.end") <= SCOPE) & (F.col("a.start") - F.col("b.end") <= SCOPE)
    linked = ask.join(other, (F.col("a._rid") == F.col("b._rid")) & (F.col("a.cell") == F.col("b.cell")) & complementary & apart & near, "left_semi")
    added = linked.groupBy("_rid").agg(F.array_sort(F.collect_set(F.struct("start", "k", "end", "kind"))).alias("_added"))
    out = [*(F.col("_row")[c].alias(c) for c in kept), F.col("_base").alias("base_spans")]
    alone = scanned.where(F.size("_weak") == 0).select(*out, F.col("_base").alias("secret_spans"))
    joined = scanned.where(F.size("_weak") > 0).join(added, "_rid", "left").select(*out, F.array_sort(F.concat("_base", F.coalesce("_added", F.array().cast(SPANS)))).alias("secret_spans"))
    return alone.unionByName(joined)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of scan() replaced by mark in the text, spans that overlap or touch together. Clean texts stay as they are."""
    found = scan(docs, text_col)
    text = F.col(f"`{text_col}`")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # at: end of what is done, as places from 0
    step = lambda a, s: F.when(s.end <= a.at, a).otherwise(F.struct(s.end.alias("at"), F.when((s.start > a.at) | (a.at == 0), F.concat(a.out, F.substring(text, a.at + 1, F.greatest(s.start - a.at, F.lit(0))), F.lit(mark))).otherwise(a.out).alias("out")))
    cleaned = F.aggregate(F.col("secret_spans"), state, step, lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size("secret_spans") > 0, cleaned).otherwise(text)).select(*docs.columns)


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs scan() on all documents, without carrying the texts along."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind in BASE), F.sha2(shown(F.col("base_spans")), 256).alias("base_sha256"), shown(F.col("secret_spans")).alias("spans"))
