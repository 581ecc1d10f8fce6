"""Alignment of two tokenizers over the same texts: which tokens of one overlap which of the other, in bytes.

The spans that the libraries report are coarse cuts: character offsets of the
byte-level tokenizer, spans of the sentence-piece proto. Neither is right where
tokens share a character, as parts of multibyte characters and byte-fallback
tokens do, nor where white space has been trimmed off an offset; such tokens are
placed by their decoded bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO, byte_letters, slices
from .common import cut, texts

#: (document, pair) entries after which a task closes a chunk; what is grouped by chunk is bounded by it.
ENTRIES = 2_000_000
#: Characters of a task's memo; it is emptied when full, which costs time only.
MEMO_CHARS = 32_000_000
#: Parts that are learnt at once, and that are tokenized as one text.
AT_ONCE, RUN = 20_000, 2_000
#: Bits of the second tokenizer's ids in a pair.
BITS = 20
#: A single space between two characters that aren't white space: both tokenizers start a token there (``check_cuts``).
_EDGE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")

_WHITE = frozenset(c for c in map(chr, range(0x110000)) if c.isspace())


def check_cuts(pieces: list[str]) -> None:
    """Raise where an entry of the sentence-piece vocabulary has a space after another character: texts couldn't be cut at spaces then."""
    if odd := [p for p in pieces if "▁" in p.lstrip("▁")]:
        raise ValueError(f"pieces that reach over a space: {odd[:5]}")


class Aligner:
    """Aligns texts by two tokenizers, part by part; parts that were seen before are looked up."""

    def __init__(self, byte_spec: str, piece_model: bytes):
        self.spec, self.model = byte_spec, piece_model
        self._a = None

    def __getstate__(self):
        return {"spec": self.spec, "model": self.model, "_a": None}

    def open(self) -> None:
        if self._a is not None:
            return
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(self.spec)
        self._a.encode_special_tokens = True
        self._a.no_truncation(), self._a.no_padding()
        self._b = sentencepiece.SentencePieceProcessor()
        self._b.LoadFromSerializedProto(self.model)
        back = {x: b for b, x in enumerate(byte_letters())}
        entries = json.loads(self.spec)
        vocab = entries["model"]["vocab"]
        own = {i: bytes(map(back.__getitem__, x)) for x, i in vocab.items() if all(c in back for c in x)}
        self.bytes_a = [own.get(i, b"") for i in range(1 + max(vocab.values()))]
        for x in entries["added_tokens"]:
            while len(self.bytes_a) <= x["id"]:
                self.bytes_a.append(b"")
            self.bytes_a[x["id"]] = x["content"].encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        check_cuts(pieces)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        """Empty the memo, and with it the numbers of pairs."""
        self._memo: dict[str, int] = {}
        self._strings: list[str] = []
        self._chars = 0
        self._numbers: dict[int, int] = {}
        self._counts = np.zeros((0, 4), np.int64)
        self._starts, self._links = np.zeros(1, np.int64), np.zeros(0, np.int32)

    @property
    def full(self) -> bool:
        return len(self._memo) > MEMO or self._chars > MEMO_CHARS

    def pairs(self) -> np.ndarray:
        """By number, the pairs seen since the memo was emptied."""
        return np.fromiter(self._numbers, np.int64, len(self._numbers))

    def align(self, parts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each part: counts (tokens of both, groups, links; -1 where the bytes of either's tokens aren't those of the part), its groups, and its links as pairs with the part's index.

        Parts are what is between spaces; both tokenizers see each one behind a
        space. Those that may stand side by side in a text are tokenized as one.
        """
        alone = [i for i, x in enumerate(parts) if not x or x[0].isspace() or x[-1].isspace()]
        side = sorted(set(range(len(parts))).difference(alone))
        runs = [[i] for i in alone] + [side[lo : lo + RUN] for lo in range(0, len(side), RUN)]
        counts, strings, links, of = np.full((len(parts), 4), -1, np.int64), [""] * len(parts), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while runs:
            run = runs.pop()
            found = self._run([parts[i] for i in run])
            if found is None:
                if len(run) > 1:  # one of them at least differs in bytes
                    runs += [run[: len(run) // 2], run[len(run) // 2 :]]
                continue
            where = np.array(run, np.int64)
            counts[where], own, pairs, at = found
            for i, x in zip(run, own):
                strings[i] = x
            links.append(pairs), of.append(where[at])
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return counts, strings, np.concatenate(links)[order], of[order]

    def _run(self, parts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None:
        """``align`` of parts as one text; None where its bytes aren't those of the tokens."""
        text = " " + " ".join(parts)
        data = text.encode()
        first, second = self._a.encode(text, add_special_tokens=False), self._b.encode(text[1:], return_type="proto").pieces
        ids_a, ids_b = first.ids, [p.id for p in second]
        if b"".join([self.bytes_a[i] for i in ids_a]) != data or b"".join([self.bytes_b[i] for i in ids_b]) != data:
            return None
        flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        stop = np.cumsum([1 + len(x.encode()) for x in parts])
        if len(text) == len(data):
            character = np.arange(len(data) + 1)
        else:  # where each character starts, in bytes
            character = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
        ends = []
        for flat, sizes, spans in ((flat_a, self.size_a, character[np.array([e for _, e in first.offsets], np.int64)]), (flat_b, self.size_b, 1 + np.array([p.end for p in second], np.int64))):
            decoded = np.cumsum(sizes[flat])
            inside = spans != decoded  # tokens that share a character
            spans[inside] = decoded[inside]
            ends.append(spans)
        ends_a, ends_b = ends
        # Between two neighbouring cuts of either tokenizer, one token of each lies over the other.
        cells = np.union1d(ends_a, ends_b)
        links = flat_a[np.searchsorted(ends_a, cells)] << BITS | flat_b[np.searchsorted(ends_b, cells)]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of = [np.searchsorted(stop, x) for x in (ends_a, ends_b, both, cells)]
        counts = np.stack([np.bincount(x, minlength=len(parts)) for x in of], axis=1)
        name_a, name_b = list(map(str, ids_a)), list(map(str, ids_b))
        groups, lo_a, lo_b = [], 0, 0
        for hi_a, hi_b in zip((np.searchsorted(ends_a, both) + 1).tolist(), (np.searchsorted(ends_b, both) + 1).tolist()):
            groups.append((name_a[lo_a] if hi_a == lo_a + 1 else ",".join(name_a[lo_a:hi_a])) + "|" + (name_b[lo_b] if hi_b == lo_b + 1 else ",".join(name_b[lo_b:hi_b])))
            lo_a, lo_b = hi_a, hi_b
        strings, lo = [], 0
        for hi in np.cumsum(counts[:, 2]).tolist():
            strings.append(";".join(groups[lo:hi]))
            lo = hi
        return counts, strings, links, of[3]

    def _number(self, links: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(links, return_inverse=True)
        known = self._numbers
        return np.array([known.setdefault(p, len(known)) for p in distinct.tolist()], np.int32)[where]

    def _learn(self, parts: list[str]) -> None:
        counts, strings, links, of = self.align(parts)
        self._memo.update(zip(parts, range(len(self._strings), len(self._strings) + len(parts))))
        self._strings += strings
        self._chars += sum(map(len, parts)) + sum(map(len, strings))
        self._counts = np.concatenate([self._counts, counts])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(np.bincount(of, minlength=len(parts)))])
        self._links = np.concatenate([self._links, self._number(links)]) if len(links) else self._links

    def documents(self, batch: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its counts and groups; of all ``(text, pair's number, links)``, by text."""
        split = [self._parts(x) if x else [] for x in batch]
        memo = self._memo
        new, lo = list({p for x in split for p in x}.difference(memo)), 0
        for hi in range(AT_ONCE, len(new) + AT_ONCE, AT_ONCE):
            self._learn(new[lo:hi])
            lo = hi
        n = np.array([len(x) for x in split], np.int64)
        rows = np.fromiter((memo[p] for x in split for p in x), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(batch)), n)
        odd = np.unique(text[self._counts[rows, 0] < 0])  # parts whose bytes differ: the text is looked at as a whole
        keep = ~np.isin(text, odd)
        kept, at = rows[keep], text[keep]
        counts = np.stack([np.bincount(at, weights=self._counts[kept, k], minlength=len(batch)) for k in range(4)], axis=1).astype(np.int64)
        ends = np.cumsum(n).tolist()
        numbers, known = rows.tolist(), self._strings
        groups = [";".join([known[i] for i in numbers[hi - len(x) : hi]]) for x, hi in zip(split, ends)]
        width = self._starts[kept + 1] - self._starts[kept]
        total = np.cumsum(width)
        link = self._links[np.arange(int(width.sum())) - np.repeat(total - width - self._starts[kept], width)]
        of = np.repeat(at, width)
        for i in odd.tolist():
            own, strings, links, _ = self.align([batch[i]])
            counts[i], groups[i] = (own[0], strings[0]) if own[0, 0] > 0 else (0, "")
            if own[0, 0] > 0:
                link, of = np.concatenate([link, self._number(links)]), np.concatenate([of, np.full(len(links), i)])
        key, times = np.unique(of << 32 | link, return_counts=True)
        return counts, groups, key >> 32, (key & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The text between single spaces that stand between two characters that aren't white space."""
        white = _WHITE.intersection(text)
        if text[0] in white or text[-1] in white or any([" " + x in text or x + " " in text for x in white]):
            first, *rest = _EDGE.split(" " + text)
            return [first[1:], *rest]
        return text.split(" ")


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, keep_groups: bool = True) -> DataFrame:
    """Tokens of ``" " + text`` by a byte-level vocabulary (A) and of ``text`` by a sentence-piece model (B, which puts the space itself), aligned in bytes.

    :param docs: needs ``doc_id`` and ``text``; other columns are ignored.
    :param byte_path: vocabulary file of A, ``piece_path``: model of B; read by the driver and broadcast (fixed size).
    :param keep_groups: also return ``groups``: runs of tokens between bytes where both end, as ``a1,a2|b1;a3|b2,b3``.
    :return: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each input row.

    A link is a token of A and one of B whose bytes overlap. A pair of ids
    counts as often as links join it in all documents; ``count_sum`` adds that
    count over a document's links, and ``n_best`` are links whose count is the
    highest that their B id has anywhere. Texts that are null or empty, or whose
    tokens' bytes don't give back the space and the text, have zeros and ''.
    Repeated rows stay repeated, a null ``doc_id`` stays null, an empty table
    gives an empty one.

    Texts are cut at single spaces, where both tokenizers start a token, and
    each distinct part is tokenized once for a task's memo. A task writes its
    documents in chunks with a table of the pairs in each; counts are summed
    over chunks by pair, so a pair that all documents share is a row for each
    chunk, and come back to the documents by chunk.
    """
    with open(byte_path, encoding="utf-8") as f:
        spec = f.read()
    with open(piece_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(Aligner(spec, model))
    source = texts(docs)
    id_type = source.schema["doc_id"].dataType.simpleString()
    fields = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"chunk long, doc_id {id_type}, {', '.join(f'{x} long' for x in fields)}, groups_sha256 string, groups string, at array<int>, times array<int>, spot int, pair long, n long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.value
        aligner.open()
        aligner.forget()
        task, chunks, entries, total, id_kind = TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64), None

        def table() -> Iterator[pa.RecordBatch]:
            """The chunk's pairs, and how many of its links have each."""
            spots, pairs = np.flatnonzero(total), aligner.pairs()
            for lo in range(0, len(spots), 50_000):
                part = spots[lo : lo + 50_000]
                gap = lambda kind: pa.nulls(len(part), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), task << 32 | chunks)), gap(id_kind), *[gap(pa.int64())] * 4, gap(pa.string()), gap(pa.string()), gap(pa.list_(pa.int32())), gap(pa.list_(pa.int32())), pa.array(part.astype(np.int32)), pa.array(pairs[part]), pa.array(total[part])],
                    names=names,
                )

        names = ["chunk", "doc_id", *fields, "groups_sha256", "groups", "at", "times", "spot", "pair", "n"]
        for batch in batches:
            ids, lo, id_kind = batch.column(0), 0, batch.column(0).type
            for part in slices(batch.column(1).to_pylist()):
                counts, groups, of, link, times = aligner.documents(part)
                ends = pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), task << 32 | chunks)), ids.slice(lo, len(part)), *[pa.array(counts[:, k]) for k in range(4)], pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]), pa.array(groups if keep_groups else [None] * len(groups), pa.string()), pa.ListArray.from_arrays(ends, pa.array(link)), pa.ListArray.from_arrays(ends, pa.array(times)), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())],
                    names=names,
                )
                lo += len(part)
                entries += len(link)
                total = np.concatenate([total, np.zeros(len(aligner._numbers) - len(total), np.int64)])
                np.add.at(total, link, times)
                if entries > ENTRIES or aligner.full:
                    yield from table()
                    chunks, entries, total = chunks + 1, 0, np.zeros(0, np.int64)
                    if aligner.full:
                        aligner.forget()
        if id_kind is not None:
            yield from table()

    coded = cut(source.mapInArrow(encode, schema))
    pairs = coded.where("pair IS NOT NULL").select("chunk", "spot", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND((1 << BITS) - 1)
    best = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B at most
    ranked = counts.join(F.broadcast(best), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("top"))
    tables = pairs.join(ranked, "pair").select(F.col("chunk").alias("of_chunk"), "spot", "count", "top")
    out = ["doc_id", *fields, "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups]
    rows = coded.where("pair IS NULL").select("chunk", "doc_id", *fields, "groups_sha256", *["groups"] * keep_groups, "at", "times")

    def score(key: tuple, docs: pa.Table, table: pa.Table) -> pa.Table:
        spot = table.column("spot").to_numpy()
        width = int(spot.max()) + 1 if len(spot) else 0
        count, top = np.zeros(width, np.int64), np.zeros(width, bool)
        count[spot], top[spot] = table.column("count").to_numpy(), table.column("top").to_numpy()
        lists = docs.column("at").combine_chunks()
        at, times = (docs.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("at", "times"))
        edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        summed = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[edge]))
        found = {"n_best": summed(times * top[at]), "count_sum": summed(times * count[at])}
        return pa.table([found[x] if x in found else docs.column(x) for x in out], names=out)

    kinds = {**{x: "long" for x in [*fields, "n_best", "count_sum"]}, "doc_id": id_type, "groups_sha256": "string", "groups": "string"}
    return rows.groupBy("chunk").cogroup(tables.groupBy("of_chunk")).applyInArrow(score, ", ".join(f"{x} {kinds[x]}" for x in out))
