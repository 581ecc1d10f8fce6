"""Suffix-array dedup of long repeated byte strings.

Two equal strings of ``LENGTH`` bytes hold equal shorter grams, of which the
least by hash, the anchor, lies at the same place in both. So windows that share
an anchor, next to each other in a text, form a segment, and equal windows lie
in segments of one key. Segments that are equal are counted, not compared. Where
segments of a key differ, their suffixes are sorted in two stages: suffixes
smaller than their successors are sorted directly, the others are induced from
them by scans over the buckets of first bytes; common prefixes of neighbours
then say which windows repeat. A key with too many different segments for one
task is first split by what its windows must all contain.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, texts

LENGTH = 400
GRAM = 128
#: Different segments of one key that are sorted in one task.
HOT = 400
#: Windows that share what they must contain, when a key is split.
FINE = 16
#: Bytes that are hashed, and bytes that are sorted, at once.
SLICE, SORTED = 1 << 19, 1 << 18
#: Bytes of texts whose rows leave a task at once.
REPLY = 8 << 20

_RNG = np.random.default_rng(31)
_OF_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position."""
    up, down = _powers(len(data) + 1)
    before = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * up[:-1], out=before[1:])
    h = (before[gram:] - before[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, last window + 1, anchor, key)`` of the segments of texts that lie end to end in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    h = _grams(data, gram)
    # The hash above, the place below: the least is the least hash, the leftmost among equals.
    place = np.uint64((1 << 20) - 1)
    least = _least((h & ~place) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (least & place).astype(np.int64)
    start = np.arange(len(anchor))
    end = ends[np.searchsorted(ends, start, side="right")]
    inside = start + length <= end
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.append((new | ~inside)[1:], True) & inside) + 1
    return first, stop, anchor[first], h[anchor[first]]


ROWS = "key long, c1 long, c2 long, doc_id long, tid long, start int, stop int, anchor int, n int"


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) runs as one each."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _segment_rows(source: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of every text (``ROWS``). Those that repeat within a text come once, with their number, and with rows without a key that say what they cover."""

    def slices(ids: pa.Array, tids: pa.Array, found: pa.Array) -> Iterator[list[tuple[int, int, memoryview, int]]]:
        """(doc_id, tid, bytes, offset) of texts side by side; a longer text in parts that overlap by a window less one. Bytes are views of the batch."""
        held, size = [], 0
        for i, t, x in zip(ids.to_pylist(), tids.to_pylist(), found):
            x = memoryview(x.as_buffer())
            if len(x) < length:
                continue
            for at in range(0, len(x) - length + 1, SLICE):
                part = x[at : at + SLICE + length - 1] if len(x) > SLICE + length else x
                if size + len(part) > SLICE + length and held:
                    yield held
                    held, size = [], 0
                held.append((i, t, part, at))
                size += len(part)
                if part is x:
                    break
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in slices(*(batch.column(i) for i in range(3))):
                whole = b"".join([x[2] for x in group])
                ends = np.cumsum([len(x[2]) for x in group])
                first, stop, anchor, key = segments(np.frombuffer(whole, np.uint8), ends, length, gram)
                owner = np.searchsorted(ends, first, side="right")
                begin = (ends - [len(x[2]) for x in group])[owner]
                out, seen = [], {}
                view, digest = memoryview(whole), xxhash.xxh3_128_digest
                for a, b, c, k, o, lo in zip(first.tolist(), stop.tolist(), anchor.tolist(), key.view(np.int64).tolist(), owner.tolist(), begin.tolist()):
                    content = digest(view[a : b + length - 1])
                    at = group[o][3] - lo
                    seen.setdefault((o, k, content), []).append((a + at, b + at, c + at))
                for (o, k, content), places in seen.items():
                    i, t, _, _ = group[o]
                    c1, c2 = struct.unpack(_TWO, content)
                    out.append((k, c1, c2, i, t, *places[0], len(places)))
                    if len(places) > 1:
                        for a, b in _merged([(a, b + length - 1) for a, b, _ in places]):
                            out.append((None, None, None, i, t, a, b, 0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), TYPES)] if out else [pa.array([], t) for t in TYPES], names=NAMES)

    return source.select("doc_id", "tid", "text").mapInArrow(run, ROWS)


_TWO = "<qq"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
TYPES = [*[pa.int64()] * 5, *[pa.int32()] * 4]


def two_stage_suffixes(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``t`` (uint8), in which suffixes that share ``depth`` bytes or more stand together in any order.

    Stage one sorts the suffixes that are smaller than their successors, by
    their first ``depth`` bytes. Stage two scans the buckets of first bytes
    upwards: each suffix found puts the one before it, if that is larger than
    its successor, at the end of what its own bucket has so far.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16)))
    # Among equal neighbours the next byte that differs decides; the last suffix is larger than the empty one.
    nxt = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], n - 1)
    smaller = np.append(step, -1)[nxt] > 0
    direct = np.flatnonzero(smaller)
    raw = t.tobytes()
    heads = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(heads)), key=heads.__getitem__)]
    del heads
    bucket = t[direct]
    bounds = np.searchsorted(bucket, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[t[n - 1]].append(np.array([n - 1]))

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
                larger[first[a]].append(before[a:b])

    out = []
    for c in range(256):
        wave = 0
        while wave < len(larger[c]):  # grows while it is scanned
            induce(larger[c][wave])
            wave += 1
        out += larger[c]
        own = direct[bounds[c] : bounds[c + 1]]
        induce(own)
        out.append(own)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the next one in order, in steps of 8 and up to ``most``."""
    padded = np.append(t, np.zeros(most + 8, np.uint8))
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = np.ascontiguousarray(word).view("<u8").ravel()
    a, b = order[:-1], order[1:]
    out, live = np.zeros(len(a), np.int32), np.arange(len(a))
    for k in range(0, most, 8):
        k = max(0, min(k, most - 8))  # the last step may overlap the one before it
        live = live[word[a[live] + k] == word[b[live] + k]]
        out[live] = k + 8
    return out


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part: whether the window from each of its offsets also starts at another place of these parts."""
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: it becomes the least one, between parts
    sizes = np.array([len(x) for x in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(len(t))
    order = two_stage_suffixes(t, length)
    order = order[left[order] >= length]  # suffixes that hold a whole window; those that share one still stand together
    hit = np.zeros(len(t), bool)
    same = common_prefixes(t, order, length) >= length
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[b : b + max(0, s - length + 1)] for b, s in zip(begin.tolist(), sizes.tolist())]


HIT = "doc_id long, tid long, start int, end int"
PART = "key long, c1 long, c2 long, doc_id long, tid long, start int, anchor int, n int, part binary"
_HITS = [("doc_id", pa.int64()), ("tid", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]


def _sorted_hits(parts: DataFrame, length: int) -> DataFrame:
    """What repeats (``HIT``) in segments that differ from others of their key (``PART``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def work(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (_, _, _, i, tid, start, _, n, _), hit in zip(rows, repeated_windows([x[8] for x in rows], length)):
                if n > 1:
                    continue  # known to repeat as a whole
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                out += [(i, tid, start + a, start + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(_HITS)], names=[x for x, _ in _HITS])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if held and row[:3] == held[-1][:3]:
                    continue  # another row of the same text
                if size >= SORTED and row[0] != last:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[8])
                last = row[0]
        if held:
            yield work(held)

    tasks = 4 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select(*[x.split()[0] for x in PART.split(", ")]).repartition(tasks, "key").sortWithinPartitions("key", "c1", "c2")
    return dealt.mapInArrow(run, HIT)


def _split_hot(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Segments of hot keys in pieces of ``width`` windows that lie alike to the anchor, keyed by what all windows of the piece contain."""
    names, types = [x.split()[0] for x in PART.split(", ")], [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, i, tid, start, anchor, n, part in zip(*(batch.column(i).to_pylist() for i in range(7))):
                at, windows = anchor - start, len(part) - length + 1  # windows lie from at down to at - windows + 1 before the anchor
                for cell in range((at - windows + 1) // width, at // width + 1):
                    lo, hi = max(0, at - (cell + 1) * width + 1), min(windows - 1, at - cell * width)
                    # All windows of the cell, in whatever segment, contain the bytes from where its last one starts to where its first one ends.
                    core = part[at - cell * width : at - (cell + 1) * width + 1 + length]
                    name = xxhash.xxh3_128_digest(b"%d %d " % (key, cell) + core)
                    piece = part[lo : hi + length]
                    c1, c2 = struct.unpack(_TWO, xxhash.xxh3_128_digest(name + b"%d " % (at - cell * width - lo) + piece))
                    out.append((struct.unpack(_TWO, name)[0], c1, c2, i, tid, start + lo, anchor, n, piece))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    return parts.select("key", "doc_id", "tid", "start", "anchor", "n", "part").mapInArrow(run, PART)


def _same(k: str = "k", a: str = "a1", b: str = "a2"):
    return (F.col("key") == F.col(k)) & (F.col("c1") == F.col(a)) & (F.col("c2") == F.col(b))


_RENAMED = {"key": "k", "c1": "a1", "c2": "a2"}


def _settle_hot(parts: DataFrame, length: int, hot: int) -> list[DataFrame]:
    """Hits for segments of hot keys, split until equal pieces can be counted and the rest fits a task."""
    found = []
    for width in (FINE, 1):
        pieces = cut(_split_hot(parts, width, length))
        contents = cut(pieces.groupBy("key", "c1", "c2").agg(F.sum("n").alias("total")))
        often = contents.where("total > 1").select("key", "c1", "c2").withColumnsRenamed(_RENAMED)
        found.append(pieces.where("n = 1").join(often, _same()).select("doc_id", "tid", "start", (F.col("start") + F.length("part")).alias("end")))
        keys = cut(contents.groupBy("key").agg(F.count("*").alias("m"), F.min("total").alias("least")).where("m > 1 AND least = 1").select(F.col("key").alias("of"), "m"))
        if not keys.head(1):
            return found
        once = pieces.join(keys, F.col("key") == F.col("of")).join(contents.withColumnsRenamed(_RENAMED), _same())
        once = cut(once.select("key", "c1", "c2", "doc_id", "tid", "start", "anchor", F.col("total").cast("int").alias("n"), "part", "m").dropDuplicates(["key", "c1", "c2"]))
        found.append(_sorted_hits(once.where(F.col("m") <= hot), length))
        parts = once.where(F.col("m") > hot)
    return found


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Byte ranges (``HIT``), which may overlap, that strings of ``length`` bytes cover that also start elsewhere, gathered for each row as ``doc_id, tid, runs``.

    ``docs``: ``doc_id, tid, text``; ``tid`` is a hash of the text that tells rows of one ``doc_id`` apart.
    """
    rows = cut(_segment_rows(docs.select("doc_id", "tid", "text"), length, gram))
    found = [rows.where("key IS NULL").select("doc_id", "tid", "start", F.col("stop").alias("end"))]
    keyed = rows.where("key IS NOT NULL")
    contents = cut(keyed.groupBy("key", "c1", "c2").agg(F.sum("n").cast("int").alias("n"), *[F.first(x).alias(x) for x in ("doc_id", "tid", "start", "stop", "anchor")]))
    # Equal segments repeat as a whole.
    often = contents.where("n > 1").select("key", "c1", "c2").withColumnsRenamed(_RENAMED)
    found.append(keyed.select("key", "c1", "c2", "doc_id", "tid", "start", "stop").join(often, _same()).select("doc_id", "tid", "start", (F.col("stop") - 1 + length).alias("end")))
    # Of keys with different segments, each one's text goes on once, unless all of them repeat already.
    keys = cut(contents.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select(F.col("key").alias("k"), "m"))
    wanted = contents.join(keys, F.col("key") == F.col("k")).select("doc_id", "tid", F.struct("key", "c1", "c2", "n", "m", "start", "stop", "anchor").alias("s"))
    wanted = cut(wanted.groupBy("doc_id", "tid").agg(F.collect_list("s").alias("segments"))).withColumnsRenamed({"doc_id": "d", "tid": "t"})
    cuts = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")))
    taken = f"""transform(segments, s -> named_struct('key', s.key, 'c1', s.c1, 'c2', s.c2, 'doc_id', doc_id, 'tid', tid, 'start', s.start, 'anchor', s.anchor, 'n', s.n, 'm', s.m,
                'part', substring(cast(text AS binary), s.start + 1, s.stop - s.start - 1 + {length})))"""
    parts = cut(cuts.select(F.explode(F.expr(taken)).alias("p")).select("p.*"))
    found.append(_sorted_hits(parts.where(F.col("m") <= hot), length))
    large = parts.where(F.col("m") > hot)
    if large.head(1):
        found += _settle_hot(large.dropDuplicates(["key", "c1", "c2"]), length, hot)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    runs = cut(out.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "end")).alias("runs")))
    forget(rows, contents, keys, parts)
    return runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: bool = True) -> DataFrame:
    """Texts without the bytes that repeated strings cover.

    :param docs: needs ``doc_id`` and ``text``; other columns are ignored.
    :param length: bytes of a string that counts as repeated if it starts at any other place, of the same text or another.
    :param gram: bytes of the anchors; less than ``length``.
    :param keep: return ``kept`` too.
    :return: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``,
        one row for each input row: the maximal removed runs as (start, end) in
        bytes, and the bytes that stay (binary, as a cut may split a character).

    Texts are their UTF-8 bytes; a null text is the empty one. Matches end at
    a text's ends, and all are judged on the input. A repeated row is another
    document, so both lose whatever ``length`` covers. Texts shorter than
    ``length`` stay whole. A null ``doc_id`` is kept. An empty table gives an
    empty one.
    """
    if not 8 <= gram <= length:
        raise ValueError("an anchor must fit a string, and have 8 bytes")
    source = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tid", F.xxhash64("text"))
    runs = repeated_runs(source, length, gram, hot)
    runs = runs.withColumnsRenamed({"doc_id": "d", "tid": "t"}).hint("shuffle_hash")
    joined = source.join(runs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left").select("doc_id", "text", "runs")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", spans), ("kept", pa.binary())]
    fields = fields if keep else fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc_id, text, found in zip(*(batch.column(i) for i in range(3))):
                data = memoryview(text.as_buffer())
                gone = _merged([(x["start"], x["end"]) for x in found.as_py() or ()])
                left, digest = [data[a:b] for a, b in zip([0, *[x[1] for x in gone]], [*[x[0] for x in gone], len(data)])], hashlib.sha256()
                for x in left:
                    digest.update(x)
                row = (doc_id.as_py(), len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone])
                out.append((*row, b"".join(left)) if keep else row)
                size += len(data)
                if size > REPLY:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out), fields)], names=[x for x, _ in fields])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out), fields)], names=[x for x, _ in fields])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    return joined.mapInArrow(run, schema + ", kept binary" * keep)
