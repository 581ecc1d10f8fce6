"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; equal sets are one class.
Each class has a min-hash embedding of ``WIDTH`` tokens, on which two sets agree
in a share of places that estimates their Jaccard similarity. A run samples a
place, and all sets go to the child that their token there names; sets that
share a child may be similar. Runs are repeated until a pair at the threshold
is missed less often than the target recall allows: a run misses it with
probability ``1 - threshold``. Children with more than ``LEAF`` sets are split
again on further sampled places, unless that would keep most of them together:
such sets are alike, so more splits would only copy them. The others are
compared by brute force, first by embedding, then by the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, texts, unused
from .components import connected_components

WORDS = 5
THRESHOLD = 0.8
#: Of pairs right at the threshold, the share that at least one run brings together.
RECALL = 0.99999
WIDTH = 256
#: Sets that are compared with each other by brute force.
LEAF = 1000
#: Times that a large child is split before its sets are compared block by block.
DEPTH = 6
#: Bits of a leaf's sets that lie in memory at once, and its shingles that are numbered at once.
BITS, NUMBERED = 1 << 28, 1 << 20
#: Of pairs right at the threshold, the share that a further split keeps together, at least.
KEPT = 0.96
MEMO = 500_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has been missed by all with probability ``1 - recall`` at most."""
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
    if runs > WIDTH:
        raise ValueError(f"{runs} runs are more than the {WIDTH} places of an embedding; ask for a lower recall or a higher threshold")
    return runs


def further_for(threshold: float) -> int:
    """Places sampled for each further split, of which a pair at the threshold agrees on none with probability ``1 - KEPT`` at most."""
    return max(1, math.ceil(math.log(1 - KEPT) / math.log(1 - threshold) - 1e-9))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.n, self._memo = words, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self._memo
        if len(memo) >= MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))  # a text of fewer words is one shingle
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _M1
            out ^= out >> np.uint64(32)
        return np.unique(_mix(out))


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def embed(shingles: np.ndarray) -> np.ndarray:
    """The set's token (64 bits) at each place."""
    out = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[None, lo : lo + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    """``doc_id, tid, sid, paths, sig`` of each row: a hash of its text, set, its children in the first split, its embedding at 16 bits a place; null for a text without words."""
    source = texts(docs).withColumn("tid", F.xxhash64("text"))
    step = WIDTH // runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sids, paths, sigs = [], [], []
            for x in batch.column(1).to_pylist():
                s = shingle(x)
                if not len(s):
                    sids.append(None), paths.append(None), sigs.append(None)
                    continue
                token = embed(s)
                own = np.arange(runs)
                sids.append(set_id(s))
                paths.append(_mix(token[own * step] + own.astype(np.uint64) * _M1).view(np.int64))
                sigs.append((_mix(token) >> np.uint64(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sids, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "tid", "sid", "paths", "sig"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, tid long, sid binary, paths array<long>, sig binary")


def _alike(threshold: float) -> int:
    """Places on which a pair at the threshold agrees, less five and a half standard deviations: fewer than one pair in ten million agrees on less."""
    return math.floor(WIDTH * threshold - 5.5 * math.sqrt(WIDTH * threshold * (1 - threshold)))


def _by_leaf(leaves: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over rows that lie together by ``leaf``, with the places where leaves begin (and the end); a leaf never lies in two calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            leaf = rows.column("leaf").to_numpy()
            return work(rows, np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]])))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            leaf = rows.column("leaf").to_numpy()
            ends = np.flatnonzero(leaf[1:] != leaf[:-1])
            if len(ends):
                cut_at = int(ends[-1]) + 1
                yield done(rows.slice(0, cut_at))
                held = rows.slice(cut_at)
            else:
                held = rows
        if held is not None:
            yield done(held)

    return leaves.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, schema)


MEMBER = "leaf long, run int, sid binary, sig binary, paths array<long>, big array<long>, side int"
#: Runs that one number of ``big`` has bits for.
_WORD = 32


class _Pairs:
    """Pairs of one leaf that agree on enough places and that no earlier leaf has compared.

    ``big`` has a bit for each run whose child was split (``_WORD`` of them in each number); what meets in another
    run's child is compared there, so a pair belongs to the first such run that
    it shares. A pair of deeper leaves belongs to none.
    """

    def __init__(self, rows: pa.Table, threshold: float, first: bool):
        self.least, self.first = _alike(threshold), first
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(rows.num_rows, WIDTH)
        self.paths = rows.column("paths").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        self.run, self.side = (rows.column(x).to_numpy() for x in ("run", "side"))
        self.big = rows.column("big").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        self.sid = np.frombuffer(b"".join(rows.column("sid").to_pylist()), "<u8").reshape(rows.num_rows, 2)

    def of(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        runs = int(self.run[lo]) if self.first else self.paths.shape[1]
        if hi - lo < 2 or runs == 0 and hi - lo == 2 and (self.sig[lo] == self.sig[lo + 1]).sum() < self.least:
            return
        for at in range(lo, hi, 64):
            close = (self.sig[at : min(hi, at + 64), None, :] == self.sig[None, at:hi, :]).sum(axis=2, dtype=np.int16) >= self.least
            i, j = np.nonzero(close)
            i, j = i + at, j + at
            keep = (i < j) & ~((self.side[i] == self.side[j]) & (self.side[i] > 0)) & (self.sid[i] != self.sid[j]).any(axis=1)
            i, j = i[keep], j[keep]
            if len(i):
                run = np.arange(runs)
                whole = ((self.big[i][:, run // _WORD] >> (run % _WORD)) & 1) == 0
                fresh = ~((self.paths[i, :runs] == self.paths[j, :runs]) & whole).any(axis=1)
                if fresh.any():
                    yield i[fresh], j[fresh]


def _marked(leaves: DataFrame, threshold: float, first: bool) -> DataFrame:
    """Members (``MEMBER``) that have a candidate partner in their leaf."""
    names = [x.split()[0] for x in MEMBER.split(", ")]

    def work(rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        pairs, hit = _Pairs(rows, threshold, first), np.zeros(rows.num_rows, bool)
        for lo, hi in zip(begins.tolist(), begins[1:].tolist()):
            for i, j in pairs.of(lo, hi):
                hit[i] = True
                hit[j] = True
        return rows.filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else pa.RecordBatch.from_pylist([], rows.schema)

    return _by_leaf(leaves.select(*names), work, MEMBER)


def _shared(shingles: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shingles that the sets ``x[k]`` and ``y[k]`` share, for each k; ``shingles`` has all sets one after another.

    Sets are bit rows over the shingles. Shingles are dealt to parts by their
    hash, so that the bits of a part fit ``BITS``, however long the texts are.
    """
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    parts = max(1, -(-len(shingles) // NUMBERED), -(-len(size) * len(shingles) // BITS))
    part = shingles.view(np.uint64) % np.uint64(parts) if parts > 1 else None
    for k in range(parts):
        own = slice(None) if part is None else np.flatnonzero(part == k)
        _, code = np.unique(shingles[own], return_inverse=True)
        if not len(code):
            continue
        bits = np.zeros((len(size), -(-(int(code.max()) + 1) // 64) * 8), np.uint8)
        np.bitwise_or.at(bits, (owner[own], code >> 3), (1 << (code & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        step = max(1, (1 << 21) // bits.shape[1])
        for at in range(0, len(x), step):
            out[at : at + step] += np.bitwise_count(bits[x[at : at + step]] & bits[y[at : at + step]]).sum(axis=1, dtype=np.int64)
    return out


LINK = "a binary, b binary, n long"


def _linked(members: DataFrame, threshold: float, first: bool) -> DataFrame:
    """Exact links (``LINK``) of marked members, whose ``shingles`` and ``copies`` lie beside them.

    Of first leaves: rows without ``b`` that count the copies linked to ``a``,
    and a forest of edges without ``n`` that connects what is linked. Of deeper
    leaves, which may share a pair: the pairs, without ``n``.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])

    def work(rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        pairs = _Pairs(rows, threshold, first)
        sid, copies = rows.column("sid").to_pylist(), rows.column("copies").to_numpy()
        shingles = rows.column("shingles").combine_chunks()
        flat, offsets = shingles.flatten().to_numpy(), shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
        count, a, b = np.zeros(rows.num_rows, np.int64), [], []
        for lo, hi in zip(begins.tolist(), begins[1:].tolist()):
            met = list(pairs.of(lo, hi))
            if not met:
                continue
            x, y = (np.concatenate([m[k] for m in met]) - lo for k in (0, 1))
            size, label = np.diff(offsets[lo : hi + 1]), np.arange(lo, hi)
            able = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9  # sizes alone rule out the others
            x, y = x[able], y[able]
            shared = _shared(flat[offsets[lo] : offsets[hi]], size, x, y)
            ok = shared >= threshold * (size[x] + size[y] - shared) - 1e-9
            x, y = x[ok], y[ok]
            if not first:
                a += [min(sid[lo + p], sid[lo + q]) for p, q in zip(x.tolist(), y.tolist())]
                b += [max(sid[lo + p], sid[lo + q]) for p, q in zip(x.tolist(), y.tolist())]
                continue
            np.add.at(count, lo + x, copies[lo + y])
            np.add.at(count, lo + y, copies[lo + x])
            for p, q in zip(x.tolist(), y.tolist()):
                if label[p] != label[q]:
                    label[label == label[q]] = label[p]
                    a.append(sid[lo + p])
                    b.append(sid[lo + q])
        some = np.flatnonzero(count)
        columns = [[sid[k] for k in some.tolist()] + a, [None] * len(some) + b, count[some].tolist() + [None] * len(a)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return _by_leaf(members, work, LINK)


def _children(members: DataFrame, depth: int, further: int) -> DataFrame:
    """Every member of a large child, once for each of its next children, with the child they come from and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column(0).to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(len(leaf), WIDTH)
            for k in range(further):
                place = (_mix(leaf + np.array([depth * 64 + k + 1], np.uint64) * _M1) % np.uint64(WIDTH)).astype(np.int64)
                token = sig[np.arange(len(leaf)), place].astype(np.uint64)
                child = _mix(leaf * _M3 + (token + np.uint64(1)) * _M2 + place.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), *[batch.column(i) for i in range(1, 5)], batch.column(0), batch.column(5)], names=["leaf", "run", "sid", "sig", "paths", "parent", "was"])

    return members.select("leaf", "run", "sid", "sig", "paths", "n").mapInArrow(run, "leaf long, run int, sid binary, sig binary, paths array<long>, parent long, was long")


def _blocks(members: DataFrame, leaf: int) -> DataFrame:
    """Members of large children as pairs of blocks, each a leaf of its own; in a pair of different blocks only members of different sides meet."""
    blocks = F.ceil(F.col("n") / leaf).cast("int")
    met = members.withColumn("own", F.pmod(F.xxhash64("sid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.withColumns({"side": side, "leaf": F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other"))}).drop("own", "other")


def candidates(classes: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, runs: int = WIDTH) -> tuple[DataFrame, DataFrame | None]:
    """Members of leaves with candidate partners, of first leaves and of deeper ones (None without any).

    ``classes``: ``sid, paths, sig``, one row for each set; ``paths`` has ``runs`` entries at most.
    """
    words = range(-(-runs // _WORD))
    at = classes.select("sid", F.posexplode("paths").alias("run", "leaf"))
    nodes = cut(at.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(at.join(nodes.withColumnRenamed("leaf", "node"), F.col("leaf") == F.col("node")).select("sid", "run", "leaf", "n"))
    known = classes.select("sid", "sig", "paths")
    rows = members.where(F.col("n") <= leaf).join(known, "sid").withColumn("side", F.lit(0))
    names = ["leaf", "run", "sid", "sig", "paths", "side"]
    large, deep, split = members.where(F.col("n") > leaf), None, None
    if large.head(1):
        large = cut(large.join(known, "sid"))
        tight, kids = _split(large, 0, further_for(threshold))
        rows = rows.select(*names).unionByName(_blocks(large.join(tight, "leaf"), leaf).select(*names))
        split = cut(large.join(tight, "leaf", "left_anti").groupBy("sid").agg(F.array(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("run") / _WORD) == w, F.expr(f"shiftleft(1L, run % {_WORD})"))), F.lit(0).cast("long")) for w in words]).alias("big")))
        for depth in range(1, DEPTH + 1):
            kids = cut(kids)
            below = kids.where(F.col("n") <= leaf).withColumn("side", F.lit(0)).select(*names)
            large = kids.where(F.col("n") > leaf)
            more = bool(large.head(1))
            if more:
                tight, kids = _split(large, depth, further_for(threshold))
                if depth == DEPTH:
                    tight = large.select("leaf").distinct()
                below = below.unionByName(_blocks(large.join(tight, "leaf"), leaf).select(*names))
            own = cut(_marked(below.join(split, "sid"), threshold, False))
            deep = own if deep is None else deep.unionByName(own)
            if not more:
                break
    none = F.array(*[F.lit(0).cast("long") for _ in words])
    rows = rows.withColumn("big", none) if split is None else rows.join(split, "sid", "left").withColumn("big", F.coalesce("big", none))
    return cut(_marked(rows, threshold, True)), deep


def _split(large: DataFrame, depth: int, further: int) -> tuple[DataFrame, DataFrame]:
    """Large children that stay together when split (``leaf``, at most one for each ``leaf`` members of the input), and the members of the others' children."""
    sizes = cut(large.select("leaf", "run", "sid", "sig", "paths", "n").transform(lambda x: _children(x, depth, further)))
    counts = cut(sizes.groupBy("leaf", "parent", "was").agg(F.count("*").alias("n")))
    tight = cut(counts.groupBy("parent").agg(F.max("n").alias("most"), F.max("was").alias("was")).where("most * 2 > was").select(F.col("parent").alias("leaf")))
    loose = counts.where("n > 1").join(tight.withColumnRenamed("leaf", "of"), F.col("parent") == F.col("of"), "left_anti").select(F.col("leaf").alias("node"), "n")
    kids = sizes.drop("parent", "was").join(loose, F.col("leaf") == F.col("node")).drop("node")
    return tight, kids


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, runs: int = WIDTH) -> DataFrame:
    """Exact links between sets (``LINK``): counts of linked copies by set, and edges that connect what is linked.

    Sets are made again from whole texts, of candidates only; ``classes`` are
    ``sid, doc, copies, paths, sig``. Pairs stay inside a leaf's task.
    """
    first, deep = candidates(classes, threshold, leaf, runs)  # written
    wanted = first.select("sid") if deep is None else first.select("sid").unionByName(deep.select("sid"))
    wanted = cut(wanted.distinct().join(classes.select("sid", "doc", "copies"), "sid"))
    rows = texts(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc"))).select("sid", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            keep, sets = [], []
            for k, (sid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                s = shingle(text)
                if set_id(s) == sid:  # rows that share an id may differ in text
                    keep.append(k)
                    sets.append(s.view(np.int64))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "copies", "shingles"])

    sets = cut(rows.mapInArrow(run, "sid binary, copies long, shingles array<long>").dropDuplicates(["sid"]))
    out = cut(_linked(first.join(sets, "sid"), threshold, True))
    if deep is None:
        forget(first, wanted, sets)
        return out
    pairs = cut(_linked(deep.join(sets, "sid"), threshold, False).distinct())
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = cut(ends.join(classes.select("sid", "copies"), F.col("b") == F.col("sid")).groupBy("a").agg(F.sum("copies").alias("n")))
    forget(first, wanted, sets)
    return out.unionByName(pairs).unionByName(counted.select("a", F.lit(None).cast("binary").alias("b"), "n"))


def _joined(docs: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    """``doc_id, tid, sid, root, n_links, class_id`` of each row; ``root`` is a set that all rows of a class share (null for a text without words)."""
    runs = runs_for(threshold, recall)
    rows = cut(_signatures(docs, runs))
    full = rows.where("sid IS NOT NULL")
    classes = cut(full.groupBy("sid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("sig").alias("sig")))
    found = links(docs, classes, threshold, leaf, runs)
    known = classes.select("sid", "doc", "copies")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    parts = cut(connected_components(found.where("b IS NOT NULL")))
    heads = parts.join(known, F.col("id") == F.col("sid")).groupBy("component").agg(F.min("doc").alias("head")).withColumnRenamed("component", "of")
    reach = parts.join(heads, F.col("component") == F.col("of")).select("id", "head", "component")
    info = known.join(counts, F.col("sid") == F.col("a"), "left").join(reach, F.col("sid") == F.col("id"), "left")
    info = cut(info.select(F.col("sid").alias("of"), F.coalesce("component", "sid").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.when(F.col("id").isNull(), F.col("doc")).otherwise(F.col("head")).alias("class_id")))
    out = full.join(info, F.col("sid") == F.col("of"), "left").select("doc_id", "tid", "sid", "root", "n_links", "class_id")
    alone = rows.where("sid IS NULL").select("doc_id", "tid", "sid", F.lit(None).cast("binary").alias("root"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """Classes of documents that five-word shingles link at the threshold or above.

    :param docs: needs ``doc_id`` and ``text``; other columns are ignored.
    :return: ``doc_id, set_id, n_links, class_id, kept``, one row for each input row.

    ``n_links``: other rows whose set is equal or as similar as asked, linked
    directly. ``class_id``: smallest ``doc_id`` that links reach. ``kept``: the
    row that stays of its class (rows that repeat that ``doc_id`` are all
    marked). A text of fewer than five words is one shingle of all its words.
    Null and empty texts, and white space alone, have no shingle: they link
    with nothing and are kept. A null ``doc_id`` counts as above all others.
    An empty table gives an empty one. Links hold between texts of any length;
    pairs are checked on whole sets, and equal sets are never expanded.

    ``recall`` is that of pairs right at the threshold whose children aren't
    split further; each further split keeps such a pair with probability
    ``KEPT`` in its run, so at the threshold of 0.8
    the eight runs together find 0.99999 of those split once and 0.9996 of
    those split ``DEPTH`` times in every run.
    """
    out = _joined(docs, threshold, recall, leaf)
    return out.select("doc_id", F.hex("sid").alias("set_id"), "n_links", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """Documents with one row left of each class; all columns stay.

    The row with the smallest ``doc_id`` stays (null counts as above all
    others), of rows that share it one whose text has the smallest hash.
    Documents without words link with nothing and stay; rows that repeat both
    ``doc_id`` and text are one document. Rows that share a ``doc_id`` but
    neither text nor class are documents of their own.
    """
    found = _joined(docs, threshold, recall, leaf)
    first = F.min_by(F.struct("doc_id", "tid"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tid"))).alias("at")
    heads = found.where("root IS NOT NULL").groupBy("root").agg(first).select("at.doc_id", "at.tid")
    own, theirs, mine = (unused(docs, x) for x in ("__id", "__t", "__tid"))
    once = cut(heads.unionByName(found.where("root IS NULL").select("doc_id", "tid")).distinct().toDF(own, theirs))
    known = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    known = known.join(once, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mine) == F.col(theirs)), "left_semi")
    return known.dropDuplicates(["doc_id", mine]).select(*docs.columns)
