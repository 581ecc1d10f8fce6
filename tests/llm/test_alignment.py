"""Tokenizer alignment against a plain walk over the bytes of every text."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import alignment, queries  # noqa: E402
from ledgerloom.llm.bpe import byte_letters  # noqa: E402

A, B = (queries.vocabulary(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["é漢😀", "\t", "\n\n", "  ", " ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "it's", "naïve", "a\x00b", "𝒳", "ﬁ", "​", "\xa0", "\x1c", "é", "12345", "x" * 120, "漢字" * 9, ".\r", "don't!", "…"]


def brute(rows):
    """Whole texts by the two libraries, token ends by adding up decoded bytes, links by comparing every token with every other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {x: i for i, x in enumerate(byte_letters())}
    letters = {i: bytes(back[c] for c in x) for x, i in json.load(open(A))["model"]["vocab"].items() if all(c in back for c in x)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b, groups, links = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [letters[i] for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            want = (" " + text).encode()
            if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
                ids_a, ids_b = [], []
        if ids_a:
            spans = []
            for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
                at, own = 0, []
                for i, x in zip(ids, parts):
                    own.append((i, at, at + len(x)))
                    at += len(x)
                spans.append(own)
            links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
            shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            for lo, hi in zip([0, *shared], shared):
                groups.append("|".join(",".join(str(i) for i, s, e in own if lo <= s and e <= hi) for own in spans))
        counts.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for doc_id, n_a, n_b, groups, links in found:
        text = ";".join(groups)
        yield (doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text)


def fuzzed(seed, n):
    r = random.Random(seed)
    words = "alpha beta, gamma. delta Épsilon zeta's 42 (eta) theta\n".split(" ")
    return [r.choice(["", " ", ""]).join(r.choice([*words, *ODD]) for _ in range(r.randint(1, 12))) for _ in range(n)]


SCHEMA = "doc_id long, text string, chunk int, pair long, n int, at string"


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in alignment.align_documents(df, A, B).collect()]
    key = lambda r: (r[0] is None, r)
    null = lambda rows: sorted([(-1 if r[0] is None else r[0], *r[1:]) for r in rows], key=key)
    assert null(got) == null(brute(rows))


def test_alignment_equals_brute_force(spark):
    rows = list(enumerate(fuzzed(1, 150))) + [(200 + i, x) for i, x in enumerate(ODD)] + [(300 + i, f"{x} word {x}") for i, x in enumerate(ODD)]
    check(spark, [*rows, (1, None), (1, ""), (None, "a null id"), (None, None), (7, "a repeated row"), (7, "a repeated row"), (2**60 + 1, "a large id")])


def test_alignment_of_chunks(spark, monkeypatch):
    """Counts are the corpus's, however few entries a chunk holds and however often the memo is emptied."""
    monkeypatch.setattr(alignment, "ENTRIES", 20)
    texts = fuzzed(2, 60)
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    aligner.open()
    monkeypatch.setattr(alignment, "MEMO_CHARS", 1)
    assert not aligner.full
    check(spark, list(enumerate(texts)), parts=5)


def test_alignment_of_a_long_text(spark):
    r = random.Random(3)
    check(spark, [(1, " ".join(r.choice(["alpha", "béta", "漢字", "x.y", "\n"]) for _ in range(1500))), (2, "z" * 1500)])


def test_alignment_empty(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_query_on_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    short = [x for x in docs if len(x[1] or "") < 1500]
    df = spark.createDataFrame(short, "doc_id long, text string")
    got = sorted(tuple(r) for r in alignment.align_documents(df, A, B, keep_groups=False).collect())
    assert got == sorted(r[:-1] for r in brute(short))
    whole = queries.op11_alignment(spark, data)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and whole.count() == len(docs)
