"""Secret scans over an incremental ledger of blobs.

A blob is the content of a version of a path, addressed by its SHA-256. The
ledger holds what each version of the rules found in each blob. A scan reads
only blobs that the ledger lacks for this version of the rules, and findings
are joined back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, texts

# The rules, in the order in which kinds are listed.
RULES = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
RULE_VERSION = hashlib.sha256(repr((RULES, LEAST)).encode()).hexdigest()[:16]
LEDGER = "blob binary, rule_version string, spans array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(RULES["assign"], re.ASCII)
# A run of one class of characters is matched whole, so its least length can be asked for at once.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed; matches of one kind don't overlap."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    kinds = list(RULES)
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


def _blob(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def versions(history: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``(path, blob)`` of each row of a history: every version of a path keeps a row of its own."""
    return history.select(F.col(path).alias("path"), _blob(text).alias("blob"))


def scan_unseen(history: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", pairs: DataFrame | None = None) -> DataFrame:
    """New rows of the ledger: each blob that it lacks under the rules as they are now, scanned once.

    :param pairs: ``versions`` of the history, where they are known.

    One path stands for all that hold the blob; the narrow ``(path, blob)``
    pairs decide which, and only its text is shuffled and scanned. Paths held
    by several versions are told apart by the blob too.
    """
    pairs = versions(history, path, text) if pairs is None else pairs
    if ledger is not None:
        pairs = pairs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    unseen = pairs.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("at")).select("blob", F.col("at.path").alias("path"), F.col("at.none").alias("none"))
    rows = history.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("own", _blob())
    rows = rows.join(unseen.hint("shuffle_hash"), (rows["path"].eqNullSafe(unseen["path"])) & (F.col("own") == F.col("blob"))).select("blob", "text")

    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # equal versions of one path meet in one task; each blob is still scanned once
        for batch in batches:
            keep = [i for i, x in enumerate(batch.column(0).to_pylist()) if not (x in done or done.add(x))]
            batch = batch.take(pa.array(keep, pa.int64()))
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([RULE_VERSION] * len(spans), pa.string()), pa.array(spans, kinds)], names=["blob", "rule_version", "spans"])

    return rows.mapInArrow(run, LEDGER)


def secret_findings(history: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the ledger's new rows.

    :param history: one row for each version of each path; other columns are ignored.
    :param ledger: rows of earlier scans (schema ``LEDGER``); None: none yet.
    :return: ``(path, blob, spans)`` for each row of ``history`` (no secret: an
        empty array), and the rows to append to the ledger.

    A null text is the empty one and has no secrets. Repeated rows stay
    repeated; a null path keeps its findings; an empty table gives empty ones.
    Texts are scanned whole, whatever their length.
    """
    pairs = versions(history, path, text)
    new = scan_unseen(history, ledger, path, text, pairs)
    known = new if ledger is None else ledger.where(F.col("rule_version") == RULE_VERSION).unionByName(new)
    return _at_paths(pairs, known), new


def _at_paths(pairs: DataFrame, known: DataFrame) -> DataFrame:
    found = known.where(F.size("spans") > 0).select("blob", "spans")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    # Few blobs hold secrets. The skewed side (a blob with many paths) is the left one, which adaptive execution can split.
    return pairs.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def scan_into(history: DataFrame, folder: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every path (as ``secret_findings`` has them), over a ledger that is kept in ``folder`` and grows by what this history adds.

    New rows are appended in one job before findings are read, so a scan that
    is lost adds none of them or all, and the next one scans what is missing.
    Where two scans have added one blob, the ledger holds it twice and it
    counts once.
    """
    spark = history.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    pairs = cut(versions(history, path, text))
    scan_unseen(history, spark.read.schema(LEDGER).parquet(folder) if there else None, path, text, pairs).write.mode("append").parquet(folder)
    known = spark.read.schema(LEDGER).parquet(folder).where(F.col("rule_version") == RULE_VERSION)
    return _at_paths(pairs, known.where(F.size("spans") > 0).dropDuplicates(["blob"]))


def digest(findings: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: counts by kind, and all spans as ``kind:start:end``, comma-joined."""
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in RULES]
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by ``mark``; all columns and rows stay, a null text stays null, and an
    ``n_chars`` column follows a changed text.

    Overlapping spans are replaced as one. Texts without a secret, found over
    the ledger as above, pass as they are.
    """
    own, blob, spans = (_unused(docs, x) for x in ("__own", "__blob", "__spans"))
    blobs = scan_unseen(docs).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.transform("spans", lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"))).alias(spans))
    rows = docs.withColumn(own, _blob())
    rows = rows.join(blobs, F.col(own) == F.col(blob), "left")
    # Spans in order of start: the text up to each, where the last one ended before it, then the mark.
    cleaned = F.expr(
        f"""aggregate(`{spans}`, named_struct('out', '', 'at', 0),
                (acc, s) -> CASE WHEN s.a >= acc.at THEN named_struct('out', concat(acc.out, substring(text, acc.at + 1, s.a - acc.at), '{mark}'), 'at', s.b)
                                 ELSE named_struct('out', acc.out, 'at', greatest(acc.at, s.b)) END,
                acc -> concat(acc.out, substring(text, acc.at + 1)))"""
    )
    out = rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cleaned))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _unused(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` don't have."""
    while name in rows.columns:
        name += "_"
    return name


def documents_digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Digest of every document, over the ledger in ``folder`` (None: a new one below the shared folder)."""
    return digest(scan_into(texts(docs), folder or scratch(docs.sparkSession, "secret-ledger")))
