import random
import re

import xxhash
from pyspark.sql import functions as F

from tidefold.llm.components import components
from tidefold.llm.simhash import links, simhash_components


def print_of(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints):
    """prints: {key: fingerprint} -> {key: root index} by comparing all pairs."""
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {k: find(f) for k, f in prints.items()}


def test_given_documents_and_edge_cases(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    rows += [(7001, None), (7002, ""), (7003, " \n"), (7004, "One"), (7005, "one"), (7006, "É one two"), (7007, "two words"), (7004, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    out = simhash_components(df).collect()
    assert len(out) == len(rows)
    prints = {(d, t): print_of(t) for d, t in rows}
    roots = classes(prints)
    least = {}
    for (d, t), r in roots.items():
        least[r] = min(d, least.get(r, d))
    want = sorted((d, "%016x" % prints[d, t], least[roots[d, t]]) for d, t in rows)
    assert sorted(tuple(r) for r in out) == want


def test_links_on_dense_fingerprints_both_ways(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {}
    for f, r in classes({f: f for f in fps}).items():
        want.setdefault(r, set()).add(signed(f))
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    for full in (1, 5, 1000):
        got = {}
        for r in components(links(df, full=full)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert sorted(sorted(v) for v in got.values()) == want, full


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (101, 100)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
