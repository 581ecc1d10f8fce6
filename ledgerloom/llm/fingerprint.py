"""Document fingerprints by a homomorphic multiset hash.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane, modulo powers of two. It doesn't
depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its vector.

A vector has two parts, both from one 512-bit hash: 8 lanes of 64 bits modulo
2**64, which make unequal documents unequal, and 256 lanes of +1 or -1 modulo
2**16. Of the latter, the inner product of two fingerprints estimates how many
paragraphs two documents share, so likeness can be read off fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored_bytes, texts

SEALS, LANES = 8, 256
#: Words after which a run without a sentence end is cut.
WORDS = 8
#: Stored bytes of documents for a run of ids, and the most runs.
RUN, MOST_RUNS = 32 << 20, 4096


def paragraphs(text: str) -> list[str]:
    """The units that are hashed: lines, cut at sentence ends and after ``WORDS`` words. They hold the whole text but for single spaces between them."""
    body = text.lstrip("\n")
    if not body:
        return [text] if text else []
    ahead = text[: len(text) - len(body)]  # line breaks alone are no unit: these belong to the first one
    out, lines = [], body.split("\n")
    for k, line in enumerate(lines):
        unit: list[str] = []
        for word in line.split(" "):
            unit.append(word)
            if len(unit) == WORDS or word[-1:] in (".", "!", "?"):
                out.append(" ".join(unit))
                unit = []
        last = k == len(lines) - 1
        if unit and unit != [""]:
            out.append(" ".join(unit) + ("" if last else "\n"))
        else:
            out[-1] += " " * (unit == [""] and line != "") + "\n" * (not last)
    out[0] = ahead + out[0]
    return out


class MultisetHash:
    """A fingerprint that can be updated."""

    __slots__ = ("lanes", "seals", "n")

    def __init__(self):
        self.seals, self.lanes, self.n = np.zeros(SEALS, np.uint64), np.zeros(LANES, np.int16), 0

    @classmethod
    def of(cls, units: list[str], memo: dict[str, bytes] | None = None) -> MultisetHash:
        out = cls()
        out.update(units, 1, memo)
        return out

    def update(self, units: list[str], sign: int = 1, memo: dict[str, bytes] | None = None) -> None:
        """Insert (``sign`` 1) or delete (-1) paragraphs; order plays no part."""
        self.n += sign * len(units)
        for lo in range(0, len(units), 4096):
            part = units[lo : lo + 4096]
            hashed = np.frombuffer(b"".join([hashlib.blake2b(x.encode()).digest() for x in part]), np.uint8).reshape(len(part), 64)
            ones = np.unpackbits(hashed[:, : LANES // 8], axis=1).sum(axis=0, dtype=np.int64)
            with np.errstate(over="ignore"):
                self.lanes += ((2 * ones - len(part)) * sign).astype(np.int16)
                total = hashed.view("<u8").sum(axis=0, dtype=np.uint64)
                self.seals += total if sign > 0 else (~total + np.uint64(1))

    def text(self) -> str:
        """Printable form; equal multisets have equal ones."""
        return self.seals.astype("<u8").tobytes().hex() + "." + base64.b64encode(self.lanes.astype("<i2").tobytes()).decode()

    def likeness(self, other: MultisetHash) -> float:
        """Estimated share of common paragraphs (Dice, 0 to 1), exactly 1 for equal fingerprints."""
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        if (self.seals == other.seals).all() and (self.lanes == other.lanes).all():
            return 1.0
        # Its own square estimates a fingerprint's number of paragraphs too (above it if some repeat).
        size = float(a @ a + b @ b)
        return 0.0 if size == 0 else min(1.0, max(0.0, 2.0 * float(a @ b) / size))


def edited(text: str, following: str) -> str:
    """``text`` with its last ``floor(n / 2)`` code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _below(bounds: list[int], x: Column, step: int = 64) -> Column:
    """How many of the rising bounds are less than ``x``: among every ``step``-th, then among those between two."""
    if not bounds:
        return F.lit(0)
    count = lambda found: F.size(F.filter(found, lambda b: b < x))
    coarse = bounds[step - 1 :: step]
    passed = F.lit(step) * count(F.lit(coarse)) if coarse else F.lit(0)
    return passed + count(F.slice(F.lit(bounds), passed + 1, F.lit(step)))


def _dealt(docs: DataFrame, runs: int) -> DataFrame:
    """``(run, doc_id, text, own)``: documents in runs of consecutive ids, each with the first row of the run that follows it, ``own`` false.

    Bounds come from the ids alone. The run after the last one is the first.
    """
    ids = docs.select("doc_id")
    probs = [i / runs for i in range(1, runs)]
    bounds = sorted({int(x) for x in ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", probs, min(0.001, 0.05 / runs))}) if probs else []
    # The run of an id: how many bounds lie below it, counted from the top, as documents go in descending order.
    run = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - _below(bounds, F.col("doc_id")))
    heads = [r for r in ids.groupBy(run.cast("int").alias("run")).agg(F.max("doc_id").alias("head")).collect()]  # one row for each run
    heads.sort(key=lambda r: r["run"])
    before = {heads[i]["head"]: heads[i - 1]["run"] for i in range(len(heads))}  # a head also goes to the run before
    own = docs.select(run.cast("int").alias("run"), "doc_id", "text", F.lit(True).alias("own"))
    if not heads:
        return own
    spark = docs.sparkSession
    small = spark.createDataFrame([(k, v) for k, v in before.items()], "head long, to int")
    again = docs.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("to").alias("run"), "doc_id", "text", F.lit(False).alias("own"))
    return own.unionByName(again)


def fingerprint_edits(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    :param docs: needs ``doc_id`` and ``text``; other columns are ignored.
    :param runs: number of runs of consecutive ids; None: twice the shuffle partitions, more where the stored input's size asks for it.
    :return: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the next in descending ``doc_id`` (null last; rows of
    one id by text), after the last one the first. A null text is the empty
    one; it has no paragraphs, and two of them are alike (1). Repeated rows are
    documents of their own. The only document is its own next one. Runs come
    from quantiles of the ids, so only ids that repeat very often could fill
    one. Texts are shuffled once.
    """
    spark = docs.sparkSession
    runs = runs or max(2 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))), min(MOST_RUNS, -(-stored_bytes(docs) // RUN)))
    source = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = _dealt(source, runs)
    rows = rows.repartition(runs, "run").sortWithinPartitions(F.col("run"), F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        held, key = None, None  # the row that waits for the one after it

        def close(now, then, then_hash):
            doc_id, text, own = now
            changed = edited(text, then)
            other = MultisetHash.of(paragraphs(changed))
            return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.text(), other.text(), own.likeness(other), own.likeness(then_hash))

        for batch in batches:
            for r, doc_id, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None and key == r:
                    mine = MultisetHash.of(paragraphs(text))
                    out.append(close(held, text, mine))
                    held = (doc_id, text, mine) if own else None
                elif own:
                    held, key = (doc_id, text, MultisetHash.of(paragraphs(text))), r
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), TYPES)], names=NAMES)
                out = []

    return rows.mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, fingerprint`` of every text, without a shuffle; a null text is the empty one."""
    source = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [MultisetHash.of(paragraphs(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.n for x in made], pa.int64()), pa.array([x.text() for x in made], pa.string())], names=["doc_id", "n_paragraphs", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_paragraphs long, fingerprint string")
