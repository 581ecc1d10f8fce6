"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import bpe, compaction, components, embeddings, fingerprint, jaccard, mixing, quality, queries, secrets, suffix, tokencount  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_length int, run string, n_links long, size int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def rows_of(spark, pairs, source=lambda i: f"s{i % 3}"):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", source(k), None if t is None else len(t), 1, "x", 5, 7) for k, (i, t) in enumerate(pairs)], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, prose(1, 400)), (5, prose(1, 400)), (6, prose(1, 400)), (None, prose(2, 30)), (None, None), (7, "é" * 300 + " ß 漢字 😀"), (8, prose(3, 6000)), (9, "a b c d e"), (9, "another text of this id")]


@pytest.fixture(scope="module")
def edge(spark):
    return rows_of(spark, EDGE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return rows_of(spark, [])


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


# 1


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 12))
    rows = [(i, (base[i % 30] + rng.normal(scale=0.05 * (i % 4), size=12)).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (201, (2 * np.array(rows[0][1])).tolist()), (202, None), (203, [0.0] * 12), (204, [float("nan")] * 12), (205, []), (206, [1.0, None]), (207, [1.0, 2.0]), (208, [2.0, 4.1]), (200, rows[0][1])]
    df = spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label int, cell string, home int")
    got = embeddings.near_duplicates(df, cell=20).collect()
    fit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and None not in v and np.isfinite(np.linalg.norm(v)) and np.linalg.norm(v) > 0]
    near = [[len(a) == len(b) and float(a @ b) >= 0.9 and p != q for q, (_, b) in enumerate(fit)] for p, (_, a) in enumerate(fit)]
    want = Counter()
    for p, (i, _) in enumerate(fit):
        group, stack = {p}, [p]
        while stack:
            for q in np.flatnonzero(near[stack.pop()]):
                if q not in group:
                    group.add(q)
                    stack.append(q)
        head = min(fit[q][0] for q in group)
        want[(i, int(sum(near[p])), head, i == head)] += 1
    for i, v in rows:
        if i in (202, 203, 204, 205, 206):
            want[(i, 0, i, True)] += 1
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_embeddings_of_low_rank(spark):
    """Vectors of 64 dimensions that lie in a plane: links cross borders at their full reach."""
    rng = np.random.default_rng(5)
    plane = np.linalg.qr(rng.normal(size=(64, 2)))[0]
    angle = rng.uniform(0, 2 * np.pi, 240)
    v = np.stack([np.cos(angle), np.sin(angle)], axis=1) @ plane.T
    near = v @ v.T
    assert np.abs(near - 0.9).min() > 1e-9
    got = embeddings.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), cell=20).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(((near >= 0.9).sum(axis=1) - 1).tolist()))


@pytest.mark.parametrize("recall", [embeddings.RECALL, 1.0])
@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_embeddings_of_many_cells(spark, shape, recall):
    """Pairs planted at cosines of 0.90 to 0.93 in 64 dimensions, over 40 cells: all are found, from both ends."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1000, 64))) if shape == "spread" else unit(unit(rng.normal(size=(50, 64)))[rng.integers(0, 50, 1000)] + rng.normal(scale=0.15, size=(1000, 64)))
    away = rng.normal(size=base.shape)
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    c = rng.uniform(0.90, 0.93, (1000, 1))
    v = np.vstack([base, c * base + np.sqrt(1 - c * c) * away])
    near = v @ v.T >= 0.9
    assert near.sum() >= 3990
    got = embeddings.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), cell=50, recall=recall).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    assert all(r["component_id"] <= i % 1000 for i, r in zip([r["vec_id"] for r in got], got))


def test_embeddings_that_share_an_id(spark):
    """Different vectors of one id are compared each for itself."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.1])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(1, None, None)], df.schema)).collect()] == [(1, 0, 1, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (3, 4)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# 2


def test_secrets_digest(spark, edge, empty):
    text = 'x token="abc" PASSWORD: hunter22; AKIA' + "A" * 20 + " é " + "0123456789abcdef01234567 api_key=ZZZZZZ-1"
    got = secrets.documents_digest(rows_of(spark, [(1, text), (2, None), (3, text)])).orderBy("doc_id").collect()
    spans = got[0]["spans"].split(",")
    assert [s.split(":")[0] for s in spans] == ["assign", "access", "hex", "assign"]
    assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in spans)] == ["PASSWORD: hunter22", "AKIA" + "A" * 20, "0123456789abcdef01234567", "api_key=ZZZZZZ-1"]
    assert got[0]["base_sha256"] == hashlib.sha256(got[0]["spans"].encode()).hexdigest() == got[2]["base_sha256"]
    assert (got[1]["n_assign"], got[1]["spans"]) == (0, "")
    assert secrets.documents_digest(edge).count() == len(EDGE) and secrets.documents_digest(empty).count() == 0


def test_secrets_equal_brute_force(spark, docs, edge):
    """Base spans of all texts by one plain rule for each kind."""
    import re

    rules = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    r = random.Random(6)
    parts = ["token", "Api_Key", "apikey", "passwd", '"', "'", ": ", " = ", "=", ":", "abc123", "zzzzzz", "AKIA", "AKIA" + "Z" * 16, "AKIA" + "9" * 15, "0123456789abcdef" * 2, "deadbeef" * 3, "deadbee" * 3, " ", "é", "\n"]
    made = rows_of(spark, [(10**6 + k, "".join(r.choice(parts) for _ in range(40))) for k in range(200)]).select("doc_id", "text")
    docs = docs.select("doc_id", "text").unionByName(made)
    some = docs.collect()
    got = secrets.documents_digest(docs).collect()
    want = Counter()
    for r in some:
        text, found = r["text"] or "", []
        for k, (rule, group, least) in enumerate(rules.values()):
            found += [(m.start(), k, m.end()) for m in re.compile(rule).finditer(text) if len(m[group]) >= least]
        joined = ",".join(f"{list(rules)[k]}:{a}:{b}" for a, k, b in sorted(found))
        n = Counter(k for _, k, _ in found)
        want[(r["doc_id"], n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest(), joined)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in got) == want
    assert sum(n for row, n in want.items() if row[5]) > 3


def test_stored_ledger(spark, tmp_path):
    """The ledger that a scan leaves spares the next one all that it has seen; a blob that is in it twice counts once."""
    at = str(tmp_path / "ledger")
    old = rows_of(spark, [(1, "token=abcdefgh"), (2, "nothing"), (3, "nothing")])
    assert sorted((r["path"], len(r["spans"])) for r in secrets.scan_into(old, at).collect()) == [(1, 1), (2, 0), (3, 0)]
    assert spark.read.parquet(at).count() == 2
    secrets.scan_into(old, at)
    assert spark.read.parquet(at).count() == 2
    spark.read.parquet(at).collect()
    new = rows_of(spark, [(4, "token=abcdefgh"), (5, "secret: other-one")])
    assert sorted((r["path"], len(r["spans"])) for r in secrets.scan_into(new, at).collect()) == [(4, 1), (5, 1)]
    secrets.scan_unseen(new).write.mode("append").parquet(at)
    assert sorted((r["path"], len(r["spans"])) for r in secrets.scan_into(new, at).collect()) == [(4, 1), (5, 1)]


def test_ledger_is_incremental(spark):
    old = rows_of(spark, [(1, "token=abcdefgh"), (2, "nothing")])
    _, ledger = secrets.secret_findings(old)
    ledger = ledger.cache()
    assert ledger.count() == 2
    new = rows_of(spark, [(1, "token=abcdefgh"), (1, "token=other-one"), (3, "nothing"), (4, "token=other-one")])
    found, more = secrets.secret_findings(new, ledger)
    assert more.count() == 1  # one unseen blob, under two paths
    assert sorted((r["path"], len(r["spans"])) for r in found.collect()) == [(1, 1), (1, 1), (3, 0), (4, 1)]
    stale = ledger.withColumn("rule_version", F.lit("older"))
    assert secrets.secret_findings(new, stale)[1].count() == 3


def test_redact(spark):
    got = secrets.redact(rows_of(spark, [(1, "é token=abcdefgh z"), (2, None), (3, "clean")])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["é [SECRET] z", None, "clean"]
    assert [r["n_chars"] for r in got] == [12, None, 5]


def test_redact_edges(spark, edge, empty):
    text = "password=" + "0123456789abcdef01234567" + " and token=AKIA" + "B" * 20
    clash = spark.createDataFrame([(1, text, "a", "b", 7), (1, text, "a", "b", 7), (None, None, "c", None, 8), (2, "", "d", "e", 9)], "doc_id long, text string, __own string, __blob string, __spans int")
    got = secrets.redact(clash)
    assert got.columns == clash.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [type(clash.first())(doc_id=i, text=t, __own=a, __blob=b, __spans=n) for i, t, a, b, n in [(1, "[SECRET] and [SECRET]", "a", "b", 7)] * 2 + [(None, None, "c", None, 8), (2, "", "d", "e", 9)]]))
    assert secrets.redact(empty).count() == 0 and secrets.redact(edge).exceptAll(edge).count() == 0


# 3 and 9


ODD = ["", " ", "don't <|endoftext|>x<|startoftext|> ΣΑΣ", "a\x1cb  c　d", "x" * 3000, "İstanbul ﬁ", "été\n\n  naïve\tcafé", "<|endoftext|>", "'s 'LL 're", "́a é", prose(4, 50)]


@pytest.fixture(scope="module")
def vocabularies():
    pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    return {n: (queries.vocabulary(n), tokenizers.Tokenizer.from_file(queries.vocabulary(n))) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_bpe_equals_library(spark, docs, edge, empty, vocabularies):
    path, lib = vocabularies["word_bpe_49k.json"]
    both = docs.select("doc_id", "text").unionByName(rows_of(spark, [(10_000 + i, t) for i, t in enumerate(ODD)]).select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in bpe.encode_documents(both, path).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(edge, path).count() == len(EDGE) and bpe.encode_documents(empty, path).count() == 0


def test_bpe_equals_library_on_all_characters(spark, vocabularies):
    """Each character beside a letter, after a mark and alone, of all planes."""
    path, whole = vocabularies["word_bpe_49k.json"]
    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    pairs = [(k, " ".join(f"a{c}b e\u0301{c} {c}\u0323\u0307" for c in chars[lo : lo + 1000])) for k, lo in enumerate(range(0, len(chars), 1000))]
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_documents(spark.createDataFrame(pairs, "doc_id long, text string").repartition(16), path, keep_text=False).collect()}
    off = [k for k, t in pairs if got[k] != hashlib.sha256(" ".join(map(str, whole.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()]
    assert off == []


def test_texts_beyond_a_slice(spark, vocabularies):
    """Texts of over two million characters."""
    text = " ".join(prose(k, 1000) + f" W{k}x, don't! ééé 漢字{k}" for k in range(420))
    assert len(text) > bpe.SLICE
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "x" * 2_100_000)], "doc_id long, text string")
    for name, run in (("word_bpe_49k.json", lambda p: bpe.encode_documents(df.where("doc_id < 3"), p, keep_text=False)), ("byte_bpe_50k.json", lambda p: tokencount.token_counts(df.where("doc_id < 3"), p))):
        path, whole = vocabularies[name]
        assert {r["doc_id"]: r["n_tokens"] for r in run(path).collect()} == {1: len(whole.encode(text, add_special_tokens=False).ids), 2: len(whole.encode("short", add_special_tokens=False).ids)}
    assert secrets.documents_digest(df).count() == 3


def test_automaton_is_exact_on_small_merges():
    vocab, merges = {}, [("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "a"), ("aa", "a"), ("b", "b"), ("ba", "b"), ("aa", "aa"), ("c", "ab")]
    for x in bpe.byte_letters() + [a + b for a, b in merges]:
        vocab.setdefault(x, len(vocab))
    auto = bpe.MergeAutomaton(vocab, merges)
    ranks = {m: i for i, m in enumerate(merges)}
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(500)]
    assert [[auto.names[i] for i in path] for path in auto.encode([w.encode() for w in words])] == [tokencount.merged(w, ranks) for w in words]


def test_token_counts_equal_library(spark, docs, edge, empty, vocabularies):
    path, lib = vocabularies["byte_bpe_50k.json"]
    both = docs.select("doc_id", "text").unionByName(rows_of(spark, [(10_000 + i, t) for i, t in enumerate(ODD + ["ab" * 400, "a  b \n c "])]).select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in tokencount.token_counts(both, path).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids), len(texts[r["doc_id"]].encode()))
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert tokencount.token_counts(edge, path).count() == len(EDGE) and tokencount.token_counts(empty, path).count() == 0


# 4


def test_multiset_hash_is_homomorphic():
    a, b = ["x one", "y two", "y two"], ["z three"]
    h = fingerprint.MultisetHash.of(a + b)
    assert fingerprint.MultisetHash.of(b + a[::-1]).text() == h.text()
    h.update(b, -1)
    assert h.text() == fingerprint.MultisetHash.of(a).text() != fingerprint.MultisetHash.of(["x one", "y two"]).text()
    h.update(b)
    assert h.text() == fingerprint.MultisetHash.of(b + a).text()


def plain_fingerprint(text):
    """Sums of hashed units, lane by lane, in plain integers."""
    seals, lanes = [0] * fingerprint.SEALS, [0] * fingerprint.LANES
    for unit in fingerprint.paragraphs(text):
        h = hashlib.blake2b(unit.encode()).digest()
        seals = [(x + int.from_bytes(h[8 * k : 8 * k + 8], "little")) % 2**64 for k, x in enumerate(seals)]
        lanes = [x + (1 if h[k // 8] >> (7 - k % 8) & 1 else -1) for k, x in enumerate(lanes)]
    return seals, lanes


def plain_likeness(a, b):
    if a == b:
        return 1.0
    size = sum(x * x for x in a[1]) + sum(x * x for x in b[1])
    return min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a[1], b[1])) / size)) if size else 0.0


def test_fingerprints_equal_brute_force(spark, docs):
    import base64

    rows = sorted([(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()], key=lambda x: (-x[0], x[1]))[:80]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(rows_of(spark, rows)).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        own, new, nxt = plain_fingerprint(t), plain_fingerprint(fingerprint.edited(t, following)), plain_fingerprint(following)
        printed = "".join(x.to_bytes(8, "little").hex() for x in own[0]) + "." + base64.b64encode(b"".join((x % 2**16).to_bytes(2, "little") for x in own[1])).decode()
        assert got[i]["fingerprint"] == printed
        assert abs(got[i]["near_edited"] - plain_likeness(own, new)) < 1e-12 and abs(got[i]["near_next"] - plain_likeness(own, nxt)) < 1e-12


def test_paragraphs_hold_the_text():
    """Texts that differ in nothing but breaks or spaces at an edge have units of their own."""
    texts = ["a b", "\na b", "\n\na b", "a b\n", "a b\n\n", "a b ", " a b", "a  b", "a\nb", "a\n\nb", "\n", "\n\n", "", "one. two", "one. ", "one.", "w " * 8, "w " * 7 + "w", "w " * 8 + "x"]
    assert len({tuple(fingerprint.paragraphs(t)) for t in texts}) == len(texts)
    assert fingerprint.paragraphs("") == []
    r = random.Random(4)
    for _ in range(300):
        t = "".join(r.choice("ab.\n ") for _ in range(r.randrange(40)))
        units = fingerprint.paragraphs(t)
        assert "".join(units).replace(" ", "") == t.replace(" ", "")


def test_below_counts_bounds(spark):
    bounds = sorted(random.Random(2).sample(range(10**6), 700))
    at = [0, bounds[0], bounds[63], bounds[63] + 1, bounds[64], bounds[699], bounds[699] + 1, 10**6] + random.Random(3).sample(range(10**6), 200)
    got = spark.createDataFrame([(x,) for x in at], "x long").select("x", fingerprint._below(bounds, F.col("x")).alias("n")).collect()
    assert all(r["n"] == sum(b < r["x"] for b in bounds) for r in got)


@pytest.mark.parametrize("runs", [1, 3, 8])
def test_fingerprint_edits(spark, runs):
    pairs = [(i, prose(i % 17, 3 + 5 * (i % 9))) for i in range(40)] + [(3, "of the same id"), (50, None), (51, "")]
    order = sorted([(i, t or "") for i, t in pairs], key=lambda x: (-x[0], x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        new = fingerprint.edited(t, order[(k + 1) % len(order)][1])
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.MultisetHash.of(fingerprint.paragraphs(new)).text())] += 1
    got = fingerprint.fingerprint_edits(rows_of(spark, pairs), runs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["edited_fingerprint"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] > 150]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.2 + sum(r["near_next"] for r in long) / len(long)


def test_fingerprint_edges(spark, edge, empty):
    assert fingerprint.fingerprint_edits(edge).count() == len(EDGE)
    assert fingerprint.fingerprint_edits(empty).count() == 0
    one = fingerprint.fingerprint_edits(rows_of(spark, [(1, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprints(edge).count() == len(EDGE)


# 5


def test_compaction(spark, docs, edge, empty, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"), target=1 << 20, fanout=3, base=1 << 10)
    for k in range(7):
        store.append(docs.where(F.pmod("doc_id", F.lit(7)) == k))
    before = store.version()
    after = store.compact()
    assert after > before and len(store.manifest()) < 7
    assert not store.plan(store.manifest())
    assert store.read().exceptAll(docs).count() == 0 and docs.exceptAll(store.read()).count() == 0
    assert store.read(before).count() == docs.count()  # old versions stay readable
    store.vacuum()
    assert store.read(before).count() == docs.count()  # young versions stay
    store.vacuum(older_than=0)
    assert store.versions() == [after] and store.read().count() == docs.count()
    with pytest.raises(compaction.CommitConflict):
        store.commit([], after - 1)
    got = compaction.shard_documents(edge, 3)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got.collect()) == Counter((i, len((t or "").encode())) for i, t in EDGE)
    assert compaction.shard_documents(empty).count() == 0


def test_two_writers(spark, docs, tmp_path):
    """Both appends are kept, whoever is first; of two compactions of the same runs one is dropped."""
    one, two = (compaction.ShardStore(spark, str(tmp_path / "s"), target=1 << 20, fanout=2, base=1 << 10) for _ in range(2))
    parts = [docs.where(F.pmod("doc_id", F.lit(5)) == k) for k in range(5)]
    for p in parts[:3]:
        one.append(p)
    commit, late = two.commit, [parts[3]]

    def slow(runs, based_on):  # the other writer commits between this one's reading and its commit
        if late:
            one.append(late.pop())
        return commit(runs, based_on)

    two.commit = slow
    two.append(parts[4])
    assert two.version() == 5 and two.read().exceptAll(docs).count() == 0 and two.read().count() == docs.count()
    late, merge = [True], two._merge

    def overtaken(group, name):  # the other writer merges the same runs while this one does
        if late:
            late.pop()
            one.compact()
        return merge(group, name)

    two._merge = overtaken
    two.compact()
    assert two.read().count() == docs.count() and docs.exceptAll(two.read()).count() == 0 and not two.plan(two.manifest())


def test_lost_writer(spark, docs, tmp_path):
    """A writer lost between its write and its commit leaves a run that hinders nobody, is spared while it is young and goes when it is old."""
    store = compaction.ShardStore(spark, str(tmp_path / "s"), target=1 << 20, fanout=2, base=1 << 10)
    store.append(docs)
    commit, store.commit = store.commit, lambda *a: (_ for _ in ()).throw(ConnectionError("lost"))
    with pytest.raises(ConnectionError):
        store.append(docs)
    store.commit = commit
    runs = lambda: len([x for x in store._fs.listStatus(store._path(f"{store.root}/runs"))])
    assert store.read().count() == docs.count() and runs() == 2
    store.vacuum()
    assert runs() == 2
    store.append(docs)
    store.compact()
    assert store.read().count() == 2 * docs.count()
    store.vacuum(older_than=0)
    assert runs() == 1 and store.read().count() == 2 * docs.count()


def test_compaction_of_large_arrivals(spark, tmp_path):
    """Arrivals beyond ``fanout`` target sizes, in many small files each, end in target-sized files."""
    target = 1 << 15
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)).cast("string"), 512) for k in range(8)])
    path = str(tmp_path / "in")
    spark.range(1500).repartition(12).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(path)
    docs = spark.read.option("pathGlobFilter", "*.parquet").parquet(path).repartition(12)
    store = compaction.ShardStore(spark, str(tmp_path / "s"), target=target, fanout=4, base=1 << 10)
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(10)))
    before = store.manifest()
    assert all(r["bytes"] > 4 * target and r["files"] == 12 for r in before)
    small = [x for r in before for x in store._sizes(r["run"])]
    store.append(docs.where("doc_id < 70").repartition(9))  # between target and ``fanout`` of them, alone in its tier
    store.compact()
    live = store.manifest()
    assert all(r["files"] <= store._files(r["bytes"]) + 1 for r in live) and not store.plan(live)
    assert max(small) < target
    assert store.read().exceptAll(docs.unionByName(docs.where("doc_id < 70"))).count() == 0
    got = compaction.shard_documents(spark.read.parquet(path), 2, target=target, root=str(tmp_path / "d"))
    assert got.count() == 1500 and compaction.stored_bytes(spark.read.parquet(path)) > 40 * target
    assert not any(r["bytes"] >= target and r["files"] > store._files(r["bytes"]) + 1 for r in compaction.ShardStore(spark, str(tmp_path / "d")).manifest())


# 6


def test_classifier_held_out(spark):
    pairs = [(i, prose(i, 60)) if i % 2 else (i, " ".join(w + "!!" for w in prose(i, 60).upper().split())) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.classify(rows_of(spark, pairs), labels).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in held} and held
    assert all(r["predicted"] == r["doc_id"] % 2 == int(r["score"] >= 0.7) for r in held)


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (8, 0, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}


def test_classifier_equals_plain_updates(spark):
    """Weights of two learners by the textbook's updates over dictionaries, averaged by rows."""
    import math

    rows = [(i, prose(i, 20) if i % 2 else prose(i, 15).upper(), i % 2) for i in range(40)]
    got = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), bits=10, shards=2, epochs=2)
    spots = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "i long").select("i", F.xxhash64(F.col("i").cast("string"), F.lit(5))).collect()}
    make, want, alpha, beta, l1, l2 = quality.Featurizer(10), np.zeros(1025), 0.5, 1.0, 0.01, 0.1
    for shard in (0, 1):
        own = sorted([(spots[i], t, y) for i, t, y in rows if spots[i] % 2 == shard])
        z, n = defaultdict(float), defaultdict(float)
        weight = lambda k: 0.0 if abs(z[k]) <= l1 else ((l1 if z[k] > 0 else -l1) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)
        for _ in range(2):
            for _, t, y in own:
                x = dict(zip(*(a.tolist() for a in make(t)))) | {1024: 1.0}
                x = {k: float(np.float32(v)) for k, v in x.items()}
                w = {k: weight(k) for k in x}
                p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
                for k, v in x.items():
                    g = (p - y) * v
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                    n[k] += g * g
        for k in list(z):
            want[k] += weight(k) * len(own) / len(rows)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12) and np.abs(want).max() > 0


def test_classifier_learns_the_given_labels(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    a, b = (quality.fit(quality.training_rows(docs, labels)) for _ in range(2))
    assert (a == b).all() and np.abs(a).max() > 0


# 7


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    pairs = [(i, prose(i, 1 + (i * 7) % 50)) for i in range(600)] + [(1000, None), (1001, "")]
    source = lambda k: None if k % 11 == 0 else ("hot" if k % 3 else f"s{k % 5}")
    df = rows_of(spark, pairs, source)
    got = mixing.mix(df).collect()
    assert len(got) == len(pairs)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 50
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    emitted = Counter(r["doc_id"] for r in mixing.emit(df).collect())
    assert emitted == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_equals_sql(spark, docs, data):
    import duckdb

    sql = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{data}/documents.parquet')
              SELECT doc_id, size, sum(size) OVER (PARTITION BY source) AS source_size, source FROM s"""
    want = duckdb.sql(sql).fetchall()
    targets = brute_targets(Counter({s: int(n) for _, _, n, s in want}))
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(got) == len(want)
    for i, size, whole, source in want:
        assert (got[i]["size"], got[i]["source_size"]) == (size, whole) and abs(got[i]["target"] - targets[source]) < 1e-6 * max(1, targets[source])


def test_mixing_edges(edge, empty):
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


# 8


def brute_join(pairs):
    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = [shingles(t) for _, t in pairs]
    n = len(pairs)
    near = [[bool(sets[a] and sets[b]) and a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    out = []
    for a in range(n):
        group, stack = {a}, [a]
        while stack:
            for b in np.flatnonzero(near[stack.pop()]):
                if b not in group:
                    group.add(b)
                    stack.append(b)
        ids = [pairs[b][0] for b in group if pairs[b][0] is not None]
        out.append((pairs[a][0], int(sum(near[a])), min(ids) if ids else None))
    return Counter(out)


def near_copies():
    pairs = []
    for k in range(4):
        base = prose(100 + k, 150).split()
        for c in range(12):
            r, w = random.Random(c * 10 + k), list(base)
            for _ in range(c % 5):
                w[r.randrange(len(w))] = "edit"
            pairs.append((k * 100 + c, " ".join(w)))
    return pairs


@pytest.mark.parametrize("leaf", [2, 6, 1000])
def test_jaccard_join_equals_brute_force(spark, leaf):
    pairs = near_copies() + EDGE
    got = jaccard.jaccard_join(rows_of(spark, pairs), leaf=leaf).collect()
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == brute_join(pairs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_shared_shingles(monkeypatch):
    """Intersections of long sets, counted part by part, equal those of Python's sets."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, 500)) for _ in range(6)]
    sets += [np.unique(np.concatenate([sets[0][:400], sets[1][:50]])), sets[2], np.zeros(0, np.int64)]
    x, y = (np.array(k) for k in zip(*[(i, j) for i in range(9) for j in range(i + 1, 9)]))
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(x, y)]
    for bits, numbered in ((1 << 28, 1 << 20), (3000, 1 << 20), (1 << 28, 300)):
        monkeypatch.setattr(jaccard, "BITS", bits)
        monkeypatch.setattr(jaccard, "NUMBERED", numbered)
        assert jaccard._shared(np.concatenate(sets), np.array([len(s) for s in sets]), x, y).tolist() == want


def test_jaccard_join_of_long_texts(spark):
    """Long texts, alike and different, in leaves of their own and split."""
    base = [prose(900 + k, 8000) for k in range(3)]
    pairs = [(k * 10 + c, " ".join(w if r.random() > 0.01 * c else "edit" for w in base[k].split())) for k in range(3) for c in range(4) for r in [random.Random(c)]]
    got = jaccard.jaccard_join(rows_of(spark, pairs), leaf=4).collect()
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == brute_join(pairs)


def test_jaccard_keeps_one(spark, empty):
    got = jaccard.keep_one(rows_of(spark, [(1000 + i, t) for i, t in near_copies()] + EDGE))
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[9] == 2  # two texts that share an id and nothing else
    twins = [(1, prose(70, 50)), (1, prose(70, 50) + " end"), (1, prose(71, 40)), (2, prose(71, 40)), (None, prose(70, 50))]
    assert sorted(len(r["text"]) for r in jaccard.keep_one(rows_of(spark, twins)).collect())[0] == len(prose(71, 40)) and jaccard.keep_one(rows_of(spark, twins)).count() == 2
    assert ids[5] == 1 and ids[6] == 0 and ids[1] == ids[2] == ids[3] == ids[4] == 1 and ids[None] == 2
    assert jaccard.jaccard_join(empty).count() == 0


# 10


def brute_removal(pairs, length):
    data, seen = [(t or "").encode() for _, t in pairs], Counter()
    for b in data:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(pairs, data):
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        edges = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((i, len(b), int(cover.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 3, 400])
def test_suffix_dedup_equals_brute_force(spark, hot):
    passage, line = prose(50, 40), "ab" * 60
    pairs = [(i, prose(200 + i, 20 + i) + (" " + passage if i % 2 else "") + prose(300 + i, 10) + (line if i % 5 == 0 else "")) for i in range(30)]
    pairs += EDGE + [(90, "aaaa " * 100), (91, "x" * 500)]
    got = suffix.remove_repeats(rows_of(spark, pairs), length=64, gram=24, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removal(pairs, 64)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"] for r in got)


def test_suffix_dedup_of_a_hot_key(spark):
    """Over 400 different segments round one shared passage, shorter than a string that counts, some of which repeat in part."""
    shared = prose(60, 60)[:330]
    tails = [prose(500 + k, 30) for k in range(9)]
    pairs = [(i, prose(2000 + i, 40) + shared + tails[i % 9][: 20 + i % 120] + prose(4000 + i, 25)) for i in range(450)]
    source = [t.encode() for _, t in pairs]
    contents = defaultdict(set)
    for b in source:
        for a, z, _, key in zip(*suffix.segments(np.frombuffer(b, np.uint8), np.array([len(b)]))):
            contents[int(key)].add(b[a : z + suffix.LENGTH - 1])
    assert max(len(x) for x in contents.values()) > suffix.HOT
    got = suffix.remove_repeats(rows_of(spark, pairs)).collect()
    want = brute_removal(pairs, 400)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert sum(n for row, n in want.items() if row[2]) > 50


def test_two_stage_suffixes_sort():
    r = random.Random(9)
    for _ in range(100):
        t = np.array([r.randrange(1, 4) for _ in range(r.randrange(1, 60))], np.uint8)
        raw = t.tobytes()
        assert suffix.two_stage_suffixes(t, 100).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_suffix_dedup_production_length(docs, empty):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = suffix.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removal(pairs, 400)
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_planted_passages(spark):
    """A passage of over 50 words that two documents share goes from both of them if it has 400 bytes, and stays if it has one less; others are left alone."""

    def passage(seed, n):
        words = " ".join(f"{w}é" for w in prose(seed, 51).split())
        return words + " " + "z" * (n - len(words.encode()) - 1)

    lengths = {0: 399, 1: 400, 2: 399, 3: 400}
    planted = {k: passage(700 + k, n) for k, n in lengths.items()}
    assert all(len(x.split()) > 50 and len(x.encode()) == lengths[k] > len(x) for k, x in planted.items())
    # What stands beside a passage differs, so no match is longer than it.
    pairs = [(2 * k + i, f"{prose(800 + 2 * k + i, 60)} {'ab'[i]}{x}{'cd'[i]} {prose(900 + 2 * k + i, 40)}") for k, x in planted.items() for i in (0, 1)]
    pairs += [(20 + i, prose(1000 + i, 150)) for i in range(8)]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(rows_of(spark, pairs)).collect()}
    texts = {i: t.encode() for i, t in pairs}
    assert {i: r["n_bytes"] for i, r in got.items()} == {i: len(t) for i, t in texts.items()}
    for i, r in got.items():
        gone = planted[i // 2].encode() if i < 8 and lengths[i // 2] == 400 else b""
        assert (r["n_removed"], r["n_spans"], r["kept"]) == (len(gone), len(gone) > 0, texts[i].replace(gone, b"") if gone else texts[i])


def test_long_texts_are_cut_into_overlapping_slices(monkeypatch, spark):
    monkeypatch.setattr(suffix, "SLICE", 500)
    text = prose(77, 900)
    pairs = [(1, text), (2, prose(78, 60) + text[1000:2500])]
    first, stop, _, _ = suffix.segments(np.frombuffer(text.encode(), np.uint8), np.array([len(text)]), 64, 24)
    assert sum(stop - first) == len(text) - 63
    got = suffix.remove_repeats(rows_of(spark, pairs), length=64, gram=24).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removal(pairs, 64)


def test_defaults(spark):
    assert jaccard.runs_for(0.8, 0.99999) == 8 and defaultdict(int) == {}
