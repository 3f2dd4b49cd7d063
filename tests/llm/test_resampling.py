import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from tidefold.llm.resampling import features, resample, scanner


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, least=20):
    count = lambda texts: [g for t in texts for g in grams(t)[1]]
    s, t = [0] * 10_000, [0] * 10_000
    for into, texts in ((s, [x for _, x in rows]), (t, target)):
        for g in count(texts):
            into[zlib.crc32(g.encode()) % 10_000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        n, g = grams(x)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_features_are_all_runs():
    for text in ("", "...", "One", "one two", "One--two THREE", "a b c d e", "É1 ß\x00x\ny z{q}", "a a a a"):
        n, codes = features(text.encode(), scanner())
        want = grams(text)
        assert n == want[0]
        assert sorted(codes.tolist()) == sorted(zlib.crc32(g.encode()) for g in want[1])


def test_given_documents_and_edge_cases(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    target = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(7001, None), (7002, ""), (7003, "?!"), (7004, "word " * 19), (7005, "word " * 20), (7006, "x" * 100_000), (7007, "a b " * 30_000), (7008, "Ünï")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "steps": F.lit(2)})
    out = resample(df.repartition(5), target, percent=30)
    assert [f.dataType.simpleString() for f in out.schema][1:] == ["bigint"] * 5
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows, [r.text for r in target.collect()], 30)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "b c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    out = resample(df, none, percent=50, min_words=1).collect()
    assert len(out) == 12 and sorted(r.rank for r in out if r.rank) == [1, 2, 3, 4, 5, 6]
    want = brute(rows, [], 0)
    assert sorted(tuple(r)[:5] for r in out if r.doc_id) == sorted(w[:5] for w in want if w[0])
    assert resample(df.limit(0), none).collect() == []
