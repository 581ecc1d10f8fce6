"""Token counts with the whole-token shortcut.

Before any text is read, every string of the vocabulary is put through the
merges once: those that come out as one token are proven to count 1 wherever
they stand as a pre-token. Only other pre-tokens are merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import MEMO, byte_letters, slices
from .common import texts
from .lookup import IntTable

# Fixed value: the pre-token pattern that byte-level vocabulary files without a pattern of their own stand for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond which a pre-token is merged alone, over a heap.
LONG = 100
NONE = np.iinfo(np.int32).max
_EDGE = r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])"


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of one pre-token: the pair of least rank merges first, the leftmost first among equals."""
    parts, absent = list(word), len(ranks)
    while len(parts) > 1:
        best = min([ranks.get(p, absent) for p in zip(parts, parts[1:])])
        if best == absent:
            break
        out, i, n = [], 0, len(parts)
        while i < n:
            if i + 1 < n and ranks.get((parts[i], parts[i + 1])) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


class TokenCounter:
    """Counts the tokens of texts for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        self.ranks = {x: i for i, x in enumerate(merges)}
        self.special = [x["content"] for x in spec["added_tokens"]]
        back = {x: b for b, x in enumerate(byte_letters())}
        #: Proven offline: strings that encode alone as one token.
        self.whole = set()
        for token in spec["model"]["vocab"]:
            if len(merged(token, self.ranks)) == 1:
                try:
                    self.whole.add(bytes(map(back.__getitem__, token)).decode())
                except UnicodeDecodeError:  # part of a character is never a pre-token
                    continue
        ids = spec["model"]["vocab"]
        self.of_byte = np.array([ids[x] for x in byte_letters()], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.pairs = IntTable(np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64), np.arange(len(merges)))
        self._memo = None

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def _open(self):
        if self._memo is None:
            self._split, self._edge = regex.compile(PATTERN), regex.compile(_EDGE)
            self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
            self._letters = byte_letters()
            self._memo, self._rest = {}, {}
        return self._memo

    def _merge(self, words: list[str]) -> None:
        """Counts of words that no single token stands for: every word's pair of least rank merges, round by round, side by side."""
        for long in [w for w in words if len(w) > LONG]:
            self._rest[long] = self._long(long)
        words = sorted((w for w in words if len(w) <= LONG), key=len)
        for lo in range(0, len(words), 10_000):
            part = words[lo : lo + 10_000]
            data = [w.encode() for w in part]
            n = np.fromiter(map(len, data), np.int64, len(data))
            sym = np.full((len(data), int(n.max()) + 1), -1, np.int64)
            sym[np.arange(sym.shape[1]) < n[:, None]] = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
            count, live = n.copy(), np.arange(len(data))
            while len(live):
                pairs = (sym[:, :-1] << 20) | sym[:, 1:]
                rank = np.full(pairs.shape, -1, np.int32)
                full = sym[:, 1:] >= 0
                rank[full] = self.pairs.get(pairs[full])
                rank[rank < 0] = NONE
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(live)), at]
                go = best < NONE
                live, sym, at, best = live[go], sym[go], at[go], best[go]
                if not len(live):
                    break
                spots = np.arange(sym.shape[1] - 1)
                sym[np.arange(len(live)), at] = self.made[best]
                sym = np.take_along_axis(sym, spots + (spots > at[:, None]), axis=1)
                count[live] -= 1
            self._rest.update(zip(part, count.tolist()))

    def _long(self, word: str) -> int:
        """The same merges over a heap, for pre-tokens too long to pass over again and again."""
        import heapq

        parts = [self._letters[b] for b in word.encode()]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = len(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            left -= 1
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < len(parts) and (r := self.ranks.get((parts[k], parts[m]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return left

    def _pieces(self, text: str) -> list[str]:
        """Parts that count alone: a single space between two characters that aren't white space always starts a pre-token."""
        pieces = text.split(" ")
        if not all(pieces) or any([x[0].isspace() or x[-1].isspace() for x in pieces]):
            pieces = self._edge.split(text)
        return pieces

    def _learn(self, pieces: set[str]) -> None:
        split = {x: self._split.findall(x) for x in pieces}
        whole, rest = self.whole, self._rest
        self._merge([w for w in {w for x in split.values() for w in x} if w not in whole and w not in rest])
        self._memo.update({x: sum([1 if w in whole else rest[w] for w in words]) for x, words in split.items()})

    def count(self, batch: list[str]) -> list[int]:
        """The number of tokens of each text."""
        self._open()
        if len(self._memo) + len(self._rest) >= 2 * MEMO:
            self._memo.clear()
            self._rest.clear()
        first, later, extra = [], [], []  # of each text: pieces that begin a run, pieces after a space, special tokens
        for text in batch:
            runs = self._special.split(text) if self._special is not None and "<|" in text else [text]
            split = [self._pieces(x) for x in runs if x]
            first.append([x[0] for x in split])
            later.append(split[0][1:] if len(split) == 1 else [y for x in split for y in x[1:]])
            extra.append(len(runs) - 1)
        memo = self._memo
        self._learn({x for own in first for x in own}.union([" " + y for y in {y for own in later for y in own}]).difference(memo))
        return [n + sum([memo[x] for x in a]) + sum([memo[" " + x] for x in b]) for n, a, b in zip(extra, first, later)]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of every whole text.

    :param docs: needs ``doc_id`` and ``text``; other columns are ignored.
    :param path: byte-level vocabulary file, read by the driver; ranks and proven strings (fixed by the vocabulary) are broadcast.
    :return: ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``), one row for each input row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay
    repeated, a null ``doc_id`` stays null, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TokenCounter(path))
    source = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            found = batch.column(1).to_pylist()
            n = [x for part in slices(found) for x in counter.count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
