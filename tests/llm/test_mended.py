"""Low thresholds of the Jaccard join, files of a shard store, whole words, columns with the operators' own names."""

import random
from collections import Counter

import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import compaction, jaccard, mixing, quality  # noqa: E402


def brute_pairs(docs, threshold):
    words = {i: t.split() for i, t in docs}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in words.items()}
    ids = sorted(sets)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def drifting(seed, n):
    """Texts whose shingles overlap to all degrees."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[r.choice(words) for _ in range(40)] for _ in range(6)]
    return [(i, " ".join(w if r.random() > r.choice([0.0, 0.02, 0.05, 0.1, 0.2]) else r.choice(words) for w in base[i % 6])) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.2, 0.25, 0.5, 0.8])
@pytest.mark.parametrize("leaf", [2, 1000])
def test_join_at_low_thresholds(spark, threshold, leaf):
    """52 and 41 runs at 0.2 and 0.25: more than a number of 32 bits has."""
    docs = drifting(5, 90)
    got = jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold, leaf=leaf).collect()
    want = brute_pairs(docs, threshold)
    links = Counter(x for pair in want for x in pair)
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: links[i] for i, _ in docs}


def test_runs_have_a_limit():
    assert jaccard.runs_for(0.2, 0.99999) == 52
    with pytest.raises(ValueError):
        jaccard.runs_for(0.02, 0.99999)


def test_files_grow_in_proportion(spark, tmp_path):
    """Twice, four and eight times the input files make as many times the files that are appended, not their square."""
    made = []
    for times in (2, 4, 8):
        path, root = str(tmp_path / f"in{times}"), str(tmp_path / f"store{times}")
        rows = spark.range(400 * times).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), 4) AS text").repartition(4 * times)
        store = compaction.ShardStore(spark, root, target=4096, fanout=2, base=256)
        arrivals = 8 * times  # as arrivals grow with the input
        from pyspark.sql import functions as F

        store.append(rows, F.pmod(F.spark_partition_id() * 2 + F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(arrivals)))
        made.append(sum(r["files"] for r in store.manifest()))
        rows.write.parquet(path)
        out = compaction.shard_documents(spark.read.parquet(path), target=4096, fanout=2, base=256)
        assert out.count() == 400 * times and dict(out.dtypes)["run"] == "bigint"
    assert made[1] == 2 * made[0] and made[2] == 4 * made[0]


def test_reruns_agree(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(300).selectExpr("id AS doc_id", "repeat('x', cast(id AS int)) AS text").repartition(5).write.parquet(path)
    one, two = (Counter(tuple(r) for r in compaction.shard_documents(spark.read.parquet(path), target=4096, fanout=2, base=256).collect()) for _ in range(2))
    assert one == two and sum(r[1] * n for r, n in one.items()) == sum(range(300))


def test_whole_words_have_a_shape():
    assert quality._shape("a" * 70 + "9") == "x9" and quality._shape("-" * 100 + "Z") == "---X"


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __tid long, __id long, __t string, __copies long, __copy long, __source string, __arrival string, __run string, __at long, __of long, __good long, __own long"


def test_columns_with_the_operators_names(spark, data):
    import corpus_pipeline

    rows = [(i, f"some words of the text number {i} token=abcdefgh{i}", "en", f"s{i % 2}", 1, 7, 8, "t", 9, 10, "u", "v", "w", 11, 12, 13, 14) for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[3]], CLASHING)
    want = Counter(tuple(r) for r in docs.collect())
    kept = Counter(tuple(r) for r in jaccard.keep_one(docs).collect())
    assert set(kept) == set(want) and max(kept.values()) == 1
    assert set(tuple(r) for r in mixing.emit(docs).collect()) <= set(want)
    placed = compaction.shard_documents(docs)
    assert Counter(r["doc_id"] for r in placed.collect()) == Counter(r[0] for r in want.elements())
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        out.collect()
