import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from tidefold.llm.line_quality import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs, max_share, max_lost=70):
    """rows: (doc_id, text, host)"""
    key = lambda x: hashlib.md5(" ".join(WORD.findall(x.lower())).encode()).hexdigest()
    distinct = collections.defaultdict(set)  # a host's documents, copies once
    for _, text, host in rows:
        if keys := frozenset(key(x) for x in (text or "").split("\n") if WORD.search(x)):
            distinct[host].add(keys)
    held = collections.Counter((host, k) for host, found in distinct.items() for keys in found for k in keys)
    out = []
    for doc_id, text, host in rows:
        t = text or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = collections.Counter(grams)
        repeat = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        over = lambda x: held[host, key(x)] >= min_docs and held[host, key(x)] > max_share * len(distinct[host])
        gone = [x for x in lines if over(x)]
        left = len(words) - sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        kept = not failed and not 100 * (len(words) - left) > max_lost * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), failed, kept, len(gone), left))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_left_words"]


def judged(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return sorted((tuple(r) for r in line_quality(df, **k).select(*COLUMNS).collect()), key=repr)


def made(seed, n=120):
    rng = random.Random(seed)
    common = ["Cookie notice here", "all rights reserved", "Été à la\tplage  oui"]
    rows = []
    for i in range(n):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 2, 3, 60, 200]))]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)] + rng.sample(common, rng.randint(0, 3))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h1", "h2", None])))
    rows += [(900, None, "h1"), (901, "", None), (902, " \n\x0b\n", "h2"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    return rows


def test_matches_brute_force(spark):
    for seed in range(2):
        rows = made(seed)
        assert judged(spark, rows, min_docs=5, max_share=0.2) == brute(rows, 5, 0.2)


def test_joined_path_gives_the_same(spark):
    rows = made(7)
    assert judged(spark, rows, min_docs=5, max_share=0.2, broadcast_bytes=0) == brute(rows, 5, 0.2)


def test_given_documents(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert judged(spark, rows) == brute(rows, 10, 0.02)


def test_boilerplate_goes_whatever_its_hash(spark):
    """A line that all documents share is removed from all of them, be its hash the smallest of a document or the largest."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    shared = sorted((f"all rights reserved {k}" for k in range(400)), key=digest)
    for line in (shared[0], shared[-1]):
        rows = [(i, f"{line}\n" + "\n".join(f"own line {j} of document {i} with words" for j in range(12)), "h") for i in range(200)]
        got = judged(spark, rows)
        assert got == brute(rows, 10, 0.02) and all(r[8] == 1 for r in got)


def test_shared_block_counts_documents(spark):
    """Ten license lines in 5 % of a host's documents go, though they supply most documents' smallest hashes."""
    block = [f"license line {k} of ten" for k in range(10)]
    rows = [(i, "\n".join((block if i % 20 == 0 else []) + [f"line {j} of text {i} and more " + f"w{i}x{j} " * 20 for j in range(3)]), "h") for i in range(400)]
    got = judged(spark, rows)
    assert got == brute(rows, 10, 0.02)
    assert sorted(r[8] for r in got) == [0] * 380 + [10] * 20


def test_copies_are_no_boilerplate_and_clean_text(spark):
    copy = "\n".join(f"line {i} " + "x%d " % i * 9 for i in range(9))
    rows = [(i, copy, "h") for i in range(40)] + [(100 + i, f"menu home about\nonly doc {i} has " + " ".join(f"w{i}x{j}" for j in range(60)), "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_quality(df, min_docs=10).collect()}
    assert all(out[i].n_removed_lines == 0 for i in range(40))
    assert all(out[100 + i].clean_text == rows[40 + i][1].split("\n")[1] for i in range(30))


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, n int, host string, key string, docs int")
    assert line_quality(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", 4, "x", "y", 2)], df.schema)
    r = line_quality(df.withColumn("keys", F.lit(1))).first()
    assert (r.n, r.host, r.key, r.docs, r["keys"], r.n_words) == (4, "x", "y", 2, 1, 2)
