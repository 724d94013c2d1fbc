import random
from collections import Counter

import numpy as np

from recordloom.llm import line_dedup as L

from .conftest import lower


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def brute(texts, min_docs, min_chars=1):
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(df, min_docs, **options):
    texts = [r["text"] for r in df.collect()]
    out = L.drop_lines(df, min_docs=min_docs, **options)
    names = out.columns[-2:]
    got = sorted((r["text"], r[names[0]], r[names[1]]) for r in out.collect())
    assert got == sorted(brute(texts, min_docs, options.get("min_chars", 1)))


def test_perfect_hash_is_minimal_and_survives_files():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    low = L.mix(keys, 5)
    shard = L.Shard.load(L.Shard.build(keys, low, np.arange(len(keys)) + 2).dump())
    assert (np.sort(shard.mph.slots(keys ^ L.mix(low, 99))) == np.arange(len(keys))).all()
    assert (shard.count(keys, low) == np.arange(len(keys)) + 2).all()
    assert (shard.count(L.mix(keys, 7), low) == 1).all()


def test_many_shards(spark):
    rng = random.Random(2)
    lines = [f"Line {i}" if i % 3 else f"  LINE {i}\t" for i in range(400)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    check(df, 10, shard_keys=16)
    check(df, 2, shard_keys=16)
    check(df, 1)
    check(df, 10, min_chars=7)


def test_rows_that_share_an_id_count_each(spark):
    df = spark.createDataFrame([(1, "same line")] * 12 + [(2, "other")], "doc_id long, text string")
    check(df, 10)


def test_a_task_reads_each_shard_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i % 90}\nown {i}") for i in range(900)], "doc_id long, text string")
    folder, shards = L.build_index(df, index_from=10, shard_keys=8)
    index = L.Index(folder, shards, cache_bytes=0)
    digests = [L.xxhash.xxh3_128_digest(f"line {k}".encode()) for k in range(200)]
    assert shards > 8 and (index.count(digests) == [10] * 90 + [1] * 110).all()
    assert index.reads <= shards


def test_documents(documents):
    check(documents, 10)
    check(documents, 3)


def test_odd_rows(odd):
    for min_docs in (1, 2, 4):
        check(odd, min_docs)
    assert {r["n_lines"] for r in L.drop_lines(odd).collect()} == {"own"}


def test_empty(none):
    assert L.drop_lines(none).count() == 0
