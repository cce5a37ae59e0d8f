"""Secret scans over an incremental blob ledger (native).

Every version of every path is content-addressed by SHA-256. The ledger is a pair of Parquet tables in a folder: the (blob, rule
version) pairs scanned so far, and the findings of blobs that have any. A batch of versions scans its unseen pairs only, each once
however many paths hold the blob, and adds to both tables; findings are joined back to all paths of all batches. The folder may be
that of earlier runs: then only what is new is scanned. A batch adds findings before pairs, so that one that failed between the two
is scanned again, and findings are read without repeats.

The query takes documents as paths in two batches by the middle of their ids, as they would arrive, into a ledger of its own.

Places of matches: Java's split gives the text between matches and regexp_extract_all the matches; running sums of their lengths
(in code points) give starts and ends. Base kinds are fixed; the method adds key blocks and tokens of known issuers.

Nulls: a null text is empty and has no findings; null ids are kept (they come in the first batch). Repeated rows are separate paths
of one blob. Empty tables give empty results; other columns are ignored, or carried on by redact(), whatever their names. Overlaps
of different kinds are all reported. A blob that many paths share is joined back by salts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.llm.common import bloom, cut, hot_keys, maybe_in, sha_hex, spread_salts, whole, with_text
from sonolake.tables import shared_dir

RULE_VERSION = 1
# Kind, pattern, the group that is measured, least length of that group. The first three are the base kinds.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ with 32 or more
    ("block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("issuer", r"(?:ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|npm_)[A-Za-z0-9_-]{16,}", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)
BASE = 3
MARK = "[SECRET]"
#: A blob that holds more than a thousandth of all rows is joined back in so many parts.
SALTS = 64


def blob_id(text: Column) -> Column:
    return sha_hex(F.coalesce(text, F.lit("")))


def rule_hits(text: str, at: int) -> str:
    """SQL: an array of (rank, i, gap, hit, part) for the matches of RULES[at] in a column: lengths of the text before, the match and its
    measured group."""
    _, pattern, group, _ = RULES[at]
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    between, found, measured = f"split({text}, {quoted}, -1)", f"regexp_extract_all({text}, {quoted}, 0)", f"regexp_extract_all({text}, {quoted}, {group})"
    pairs = f"zip_with({found}, {measured}, (h, p) -> named_struct('hit', char_length(h), 'part', char_length(p)))"
    return f"transform(zip_with(slice({between}, 1, size({found})), {pairs}, (g, h) -> named_struct('gap', char_length(g), 'hit', h.hit, 'part', h.part)), (x, i) -> named_struct('rank', {at}, 'i', i, 'gap', x.gap, 'hit', x.hit, 'part', x.part))"


def scan(blobs: DataFrame) -> DataFrame:
    """blob, spans (array of (start, rank, end) by start, then kind as listed) of the blobs (blob, text) that have any. Texts that a
    rule cannot match skip its lists; a rule's pattern is searched once to tell."""
    d = blobs
    for at, (_, pattern, _, _) in enumerate(RULES):
        d = d.withColumn(f"_h{at}", F.col("text").rlike(pattern))
    none = "cast(array() as array<struct<rank: int, i: int, gap: int, hit: int, part: int>>)"
    parts = ", ".join(f"if(_h{at}, {rule_hits('text', at)}, {none})" for at in range(len(RULES)))
    hits = d.where(" or ".join(f"_h{at}" for at in range(len(RULES)))).select("blob", F.explode(F.expr(f"concat({parts})")).alias("x")).select("blob", "x.*")
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    least = F.get(F.array(*[F.lit(n) for *_, n in RULES]), F.col("rank"))
    spans = hits.withColumn("end", end).where(F.col("part") >= least).select("blob", F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "end").alias("s"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("spans"))


LEDGER, FINDINGS = "blob string, rule_version int", "blob string, rule_version int, spans array<struct<start: int, rank: int, end: int>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # so that there is a table to read
    return spark.read.schema(schema).parquet(path)


def findings(spark: SparkSession, ledger: str) -> DataFrame:
    """blob, spans found under RULE_VERSION so far by the ledger in that folder."""
    return _read(spark, f"{ledger}/findings", FINDINGS).where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"]).select("blob", "spans")


def scan_batch(versions: DataFrame, ledger: str) -> int:
    """Scans the unseen blobs of versions (blob, text) and adds them to the ledger in that folder; returns how many there were."""
    spark = versions.sparkSession
    version = F.lit(RULE_VERSION).alias("rule_version")
    seen = _read(spark, f"{ledger}/pairs", LEDGER).where(F.col("rule_version") == RULE_VERSION).select("blob")
    fresh = cut(versions.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen-blobs")
    # equal blobs have equal texts: the first one met speaks for them, combined before the shuffle, so that no task gets all copies of a text
    texts = versions.where("text <> ''").groupBy("blob").agg(F.first("text").alias("text")).join(fresh, "blob", "left_semi")
    scan(texts).select("blob", version, "spans").write.mode("append").parquet(f"{ledger}/findings")
    fresh.select("blob", version).write.mode("append").parquet(f"{ledger}/pairs")
    return fresh.count()


def ledger_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def scan_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """blob, spans for the texts of docs (doc_id, text) that have any, through the ledger in that folder (a new one by default). Two
    batches, by the middle of the ids; rows without an id come with the first."""
    ledger = ledger or ledger_folder(docs.sparkSession)
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first().m
    versions = docs.select("doc_id", blob_id(F.col("text")).alias("blob"), "text")
    late = F.coalesce(F.col("doc_id") > middle, F.lit(False)) if middle is not None else F.lit(False)
    for batch in (~late, late):
        scan_batch(versions.where(batch).select("blob", "text"), ledger)
    return findings(docs.sparkSession, ledger)


def joined_back(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with blob) with spans, empty for blobs without any. Hot blobs are dealt out by salts."""
    hot = cut(hot_keys(rows.select("blob"), "blob"), "hot-blobs")
    each = rows.join(F.broadcast(hot), "blob", "left").withColumn("salt", F.when(F.col("hot"), F.floor(F.rand(7) * SALTS).cast("int")).otherwise(0)).drop("hot")
    empty = F.expr("cast(array() as array<struct<start: int, rank: int, end: int>>)")
    return each.join(spread_salts(found, hot, "blob", SALTS), ["blob", "salt"], "left").drop("salt").withColumn("spans", F.coalesce("spans", empty))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = listed(F.filter("spans", lambda s: s["rank"] < BASE))
    rows = joined_back(docs.select("doc_id", blob_id(F.col("text")).alias("blob")), scan_documents(docs, ledger))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), sha_hex(base).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs with every found span replaced by MARK (overlapping spans by one), n_chars following where there is such a column."""
    # spans that overlap become one; then the texts between them and the marks are joined
    merged = """aggregate(spans, cast(array() as array<struct<start: int, end: int>>), (a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(named_struct('start', s.start, 'end', s.end)))))"""
    text = f"array_join(transform(sequence(0, size(m)), i -> substring(row.text, coalesce(get(m, i - 1).end, 0) + 1, coalesce(get(m, i).start, char_length(row.text)) - coalesce(get(m, i - 1).end, 0))), '{MARK}')"
    found = scan_documents(docs, ledger)
    # only documents that may have findings move; a Bloom filter proves that the others have none
    rows = maybe_in(whole(docs).withColumn("blob", blob_id(F.col("row.text"))), "blob", bloom(found.select("blob"), "blob", "found-blobs"), "doubt")
    d = joined_back(rows.where("doubt").select("row", "blob"), found).withColumn("m", F.expr(merged))
    row = with_text(F.col("row"), F.expr(text), F.size("m") > 0, dict(docs.dtypes).get("n_chars"))
    return rows.where("not doubt").select("row.*").union(d.select(row.alias("row")).select("row.*"))
