"""Byte-pair encoding by a merge automaton, and decoding by its arc labels.

The automaton reads token labels. A state says which labels may follow the
label just read; a label leads to one state only, so the automaton is
deterministic. It starts as one state that loops over the base symbols. Every
merge ``(a, b) -> c``, in order of rank, applies one gadget:

* the arcs labelled ``a`` go to their own copy of their state, which lacks ``b``;
* every state with an arc ``a`` gets an arc ``c`` that leads where ``b`` led.

States and labels that nothing has told apart yet share a row or a column of
the transition table, so 48,894 merges need about 8,000 x 8,000 bits instead of
49,000 x 49,000. The accepted label sequences are exactly the tokenizations
that applying the merges in rank order gives, one for each string.

A word is encoded by running the table over its symbols from left to right:
each prefix has one accepted path, so every position keeps one state.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts
from .lookup import IntTable

#: Entries of a task's memo of words and of pieces; it is emptied when full, which costs time only.
MEMO = 250_000
#: Characters of text that are encoded side by side.
SLICE = 2_000_000


def slices(found: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE characters each."""
    lo = size = 0
    for i, x in enumerate(found):
        size += len(x)
        if size >= SLICE:
            yield found[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(found):
        yield found[lo:]


# White space as the normaliser of the vocabulary file sees it (Unicode White_Space).
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
# str.split() takes these as white space too; the vocabulary file doesn't.
_ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable Latin-1, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The token automaton of a merge list. ``end``: suffix that marks the last symbol of a word ("" if none)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        letters = byte_letters()
        table = np.zeros((1024, 256), np.uint8)  # a bit for each label class, the first one highest
        table[0, 0] = 128  # the start state; its row is shared by every label nothing has restricted yet
        rows, cols = 2, 1  # row 1: nothing may follow, after a symbol that ends its word
        state, column = {}, {}
        row_users, col_users = [2, 2], [2]  # the start state always counts as one more user
        for x in letters:
            state[x], column[x] = 0, 0
            row_users[0] += 1
            col_users[0] += 1
            if end:
                state[x + end], column[x + end] = 1, 0
                row_users[1] += 1
                col_users[0] += 1
        for a, b in merges:
            c = a + b
            if a not in state or b not in state or not table[state[a], column[b] >> 3] >> (7 - (column[b] & 7)) & 1:
                continue  # a is never followed by b here, so the merge never applies
            after_b, r, k = state[b], state[a], column[b]
            if rows == table.shape[0]:
                table = np.pad(table, ((0, rows // 4), (0, 0)))
            if cols == 8 * table.shape[1]:
                table = np.pad(table, ((0, 0), (0, table.shape[1] // 4)))
            if row_users[r] > 1 or a == b:
                table[rows] = table[r]
                row_users[r] -= 1
                row_users.append(1)
                r, rows = rows, rows + 1
                state[a] = r
            if col_users[k] > 1:
                table[:, cols >> 3] |= ((table[:, k >> 3] >> (7 - (k & 7))) & 1) << (7 - (cols & 7))
                col_users[k] -= 1
                col_users.append(1)
                k, cols = cols, cols + 1
                column[b] = k
            table[r, k >> 3] &= 255 ^ (128 >> (k & 7))
            state[c], column[c] = after_b, column[a]
            row_users[after_b] += 1
            col_users[column[a]] += 1
        self.shape = (rows, cols)
        self.bits = table[:rows, : -(-cols // 8)].copy()
        known = [x for x in state if x in vocab]
        self.names, self.ids = known, np.array([vocab[x] for x in known], np.int32)
        self.to, self.column = (np.array([m[x] for x in known], np.int32) for m in (state, column))
        self._trie(letters)

    def _trie(self, letters: list[str]) -> None:
        """The labels' bytes as a trie: (node, byte) -> node, and the label that ends at a node, inside a word or at its end."""
        byte, nodes, ends = {x: b for b, x in enumerate(letters)}, {}, []
        count = 1
        for i, x in enumerate(self.names):
            last = bool(self.end) and x.endswith(self.end) and len(x) > len(self.end)
            at = 0
            for y in x[: -len(self.end)] if last else x:
                key = at * 256 + byte[y]
                if (child := nodes.get(key)) is None:
                    child = nodes[key] = count
                    count += 1
                at = child
            ends.append((at, i, last))
        self.inner, self.final = np.full(count, -1, np.int32), np.full(count, -1, np.int32)
        for at, i, last in ends:
            if not last:
                self.inner[at] = i
            if last or not self.end:
                self.final[at] = i
        self.arcs = IntTable(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The path of each word, as indices of ``names`` and ``ids``: the table runs over all words side by side, position by position."""
        if not words:
            return []
        n = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        read = np.cumsum(n) - n  # where a word's bytes begin
        begin = read + np.arange(len(words))  # where its positions begin: one more than it has bytes
        state = np.full(len(data) + len(words), -1, np.int32)
        arc, back = state.copy(), state.copy()
        state[begin] = 0
        longest_first = np.argsort(-n, kind="stable")
        left = len(words)
        for i in range(int(n.max(initial=0))):
            while left and n[longest_first[left - 1]] <= i:
                left -= 1
            w = longest_first[:left]
            w = w[state[begin[w] + i] >= 0]
            at, j, row = np.zeros(len(w), np.int64), i, state[begin[w] + i]
            while len(w):
                at = self.arcs.get(at * 256 + data[read[w] + j]).astype(np.int64)
                j += 1
                there = at >= 0
                w, at, row = w[there], at[there], row[there]
                done = n[w] == j
                label = np.where(done, self.final[at], self.inner[at])
                k = self.column[label]  # of a node without a label: any, masked below
                ok = (label >= 0) & ((self.bits[row, k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1).astype(bool)
                to = begin[w[ok]] + j
                state[to], arc[to], back[to] = self.to[label[ok]], label[ok], i
                w, at, row = w[~done], at[~done], row[~done]
        out = []
        arcs, backs = arc.tolist(), back.tolist()
        for b, m in zip(begin.tolist(), n.tolist()):
            path = []
            while m:
                path.append(arcs[b + m])
                m = backs[b + m]
            path.reverse()
            out.append(path)
        return out


def _ranges(found: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, lo = [], 0
    for i, x in enumerate(found):
        if i + 1 == len(found) or found[i + 1] != x + 1:
            out.append(f"\\U{found[lo]:08x}-\\U{x:08x}")
            lo = i + 1
    return "".join(out)


def unicode_gaps() -> dict[str, str]:
    """For ``L`` and ``N`` the characters, as a character class, that this Python's Unicode tables count in and those of the ``tokenizers`` library don't."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    more = {}
    for kind in "LN":
        own = regex.findall(rf"\p{{{kind}}}", every)
        found = {x for run, _ in pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str("".join(own)) for x in run}
        if extra := sorted(ord(x) for x in own if x not in found):
            more[kind] = _ranges(extra)
    return more


class WordCodec:
    """A word-level vocabulary file: normalise, split into words, encode by the automaton, decode by its labels.

    Normalisation (NFC, lower case, white space dropped) and the split pattern
    are those that the file states; both are done by the Unicode tables of the
    ``tokenizers`` library, which may be older or newer than Python's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        for kind, extra in unicode_gaps().items():
            self.pattern = self.pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{extra}]]")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._memo = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_normal"} | {"_memo": None}  # opened again where it arrives

    def _open(self) -> None:
        if self._memo is None:
            from tokenizers import normalizers

            self._normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
            self._split = regex.compile(self.pattern, regex.V1)
            self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
            self._ids, self._memo, self._words = [str(i) for i in self.automaton.ids.tolist()], {}, {}

    def _learn(self, pieces: set[str]) -> None:
        """Put pieces without white space into the memo: ids and labels, each joined by a space, and their number."""
        split = {x: self._split.findall(x.lower() if x.isascii() else self._normal(x)) for x in pieces}
        new = list({w for x in split.values() for w in x}.difference(self._words))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            for word, path in zip(part, self.automaton.encode([w.encode() for w in part])):
                self._words[word] = (" ".join([self._ids[i] for i in path]), " ".join([self.automaton.names[i] for i in path]), len(path))
        for x, words in split.items():
            if len(words) == 1:
                self._memo[x] = self._words[words[0]]
            else:
                found = [self._words[w] for w in words]
                self._memo[x] = (" ".join([y[0] for y in found]), " ".join([y[1] for y in found]), sum([y[2] for y in found]))

    def encode(self, batch: list[str]) -> list[tuple[str, str, int]]:
        """For each text: ids joined by a space, labels joined by a space (the decoded text), number of tokens."""
        self._open()
        if len(self._memo) >= MEMO or len(self._words) >= MEMO:
            self._memo.clear()
            self._words.clear()
        parts = []  # of each text, its pieces; a special token counts as one
        for text in batch:
            if self._specials is not None and "<|" in text:
                own = []
                for x in self._specials.split(text):
                    if x in self.special:
                        self._memo[x] = (str(self.special[x]), x, 1)
                        own.append(x)
                    else:  # where no special token stands, its string can't be a piece
                        own += _SPACE.split(x) if _ODD.search(x) else x.split()
            else:
                own = _SPACE.split(text) if _ODD.search(text) else text.split()
            parts.append(own)
        self._learn({x for own in parts for x in own}.difference(self._memo))
        out = []
        for own in parts:
            found = [self._memo[x] for x in own]
            if "" in own:
                found = [x for x in found if x[2]]
            out.append((" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])))
        return out


@lru_cache(maxsize=2)
def codec_for(path: str) -> WordCodec:
    """The codec of a vocabulary file, built once in a driver."""
    return WordCodec(path)


def encode_documents(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    :param docs: needs ``doc_id`` and ``text``; other columns are ignored.
    :param path: vocabulary file, read by the driver; its automaton (about 10 MB, fixed by the vocabulary) is broadcast.
    :param keep_text: return ``ids`` (array<int>) and ``decoded`` (string) as well as the digests.
    :return: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (+ ``ids, decoded``), one row for each input row.

    A null or empty text, or one of white space alone, has no tokens: the
    digests are those of the empty string. Repeated rows stay repeated, a null
    ``doc_id`` stays null, an empty table gives an empty one. Texts are split
    at white space, so very long ones need memory for their pieces only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(codec_for(path))
    source = texts(docs)
    key = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = shared.value, hashlib.sha256
        for batch in batches:
            lo = 0
            for part in slices(batch.column(1).to_pylist()):  # what a slice gives goes on before the next is encoded
                coded = codec.encode(part)
                out = [batch.column(0).slice(lo, len(part)), pa.array([x[2] for x in coded], pa.int64()), pa.array([sha(x[0].encode()).hexdigest() for x in coded], pa.string()), pa.array([sha(x[1].encode()).hexdigest() for x in coded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_text:
                    ids = [np.fromstring(x[0], np.int32, sep=" ") if x[0] else np.zeros(0, np.int32) for x in coded]
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array([x[1] for x in coded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)
                lo += len(part)

    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema + (", ids array<int>, decoded string" if keep_text else ""))
