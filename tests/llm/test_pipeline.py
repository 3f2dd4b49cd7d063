import collections
import random
import re
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import bounds
from tests.llm.test_line_quality import brute as brute_quality
from tidefold.llm import simhash
from tidefold.llm.queries import word_tokenizer
from tidefold.llm.simhash import near_duplicates, shingle_set


def stages(spark, docs, sf_dir, tmp_path):
    """What each stage got and returned, as rows."""
    got = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]))
        docs = out
    return got


def test_every_stage_against_brute_force(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    extra = [(9000, None, "en", "src0", 0), (9001, "", None, None, 0), (7, docs.where("doc_id = 7").first().text, "en", "src7", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    quality, lines, near, clean, packed = stages(spark, docs, sf_small, tmp_path)

    kept = {r[0] for r in brute_quality([(r["doc_id"], r["text"], r["source"]) for r in quality[0]], 10, 0.02) if r[7]}
    assert {r["doc_id"] for r in quality[1]} == kept and len(kept) < len(quality[0])

    order = sorted(range(len(lines[0])), key=lambda k: lines[0][k]["doc_id"])
    left = collections.Counter((r["doc_id"], r["text"]) for r in lines[1])
    for k, (must, may) in zip(order, bounds([lines[0][k]["text"] for k in order], 25)):
        r = lines[0][k]
        if not may:
            assert left[r["doc_id"], r["text"]]
        raw = r["text"].split("\n")
        for d, text in left:
            if d == r["doc_id"] and len([x for x in lines[0] if x["doc_id"] == d]) == 1:
                assert not [raw[i] for i in must if len(raw[i]) > 40 and raw[i] in text.split("\n")]

    sets = {r["doc_id"]: shingle_set(r["text"].encode(), 5) for r in near[0]}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = sorted(r["doc_id"] for r in near[1])
    assert not [(a, b) for a in stay for b in stay if a < b and alike(a, b)]
    assert all(any(alike(d, e) for e in sets if e != d) for d in sets if d not in stay)

    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]

    def holds(text):
        have = set(zip(*(norm(text)[k:] for k in range(5))))
        return any(sum(g in have for g in zip(*(w[k:] for k in range(5)))) >= 0.8 * (len(w) - 4) for w in items)

    assert sorted(r["doc_id"] for r in clean[1]) == sorted(r["doc_id"] for r in clean[0] if not holds(r["text"]))
    for before, after in (quality, lines, near, clean):
        assert not after or list(after[0]) == corpus_pipeline.COLUMNS
        assert all(r["n_chars"] == len(r["text"]) for r in after)

    tok = Tokenizer.from_file(word_tokenizer())
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in packed[0]}
    have = collections.Counter()
    for r in packed[1]:
        have[r["doc_id"]] += r["length"]
    assert have == want


def test_run_and_empty(spark, sf_small, tmp_path):
    assert corpus_pipeline.run(spark, sf_small).count() > 0
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    assert [len(after) for _, after in stages(spark, docs, sf_small, tmp_path)] == [0] * 5


def test_two_runs_leave_each_other_alone(spark, sf_small):
    """A result that is read late, and runs in two threads, keep their intermediates."""
    first = corpus_pipeline.run(spark, sf_small)
    with ThreadPoolExecutor(2) as pool:
        second, third = pool.map(lambda _: corpus_pipeline.run(spark, sf_small).count(), range(2))
    assert first.count() == second == third > 0


def test_near_duplicates_of_words_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 150, 600]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    sets = [shingle_set((t or "").encode(), 5) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {k: find(k) for k in range(len(texts))}


def test_near_duplicates_of_a_template_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, texts = [word() for _ in range(270)], []
    for k in range(500):
        own = [word() for _ in range(60)]
        texts.append(" ".join(template + own))  # Jaccard 0.69 with one another
        if k % 5 == 0:
            texts.append(" ".join(template[:120] + [word() for _ in range(3)] + template[140:] + own))
    texts += texts[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    sets = [shingle_set(t.encode(), 5) for t in texts]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 100 and not [(i, j) for i, j in alike if got[i] != got[j]]


def test_near_duplicates_read_texts_for_little_more_than_links(spark, monkeypatch):
    """Documents that share one of two passages meet in their rarest shingles, but are far from similar."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = [" ".join(word() for _ in range(100)) for _ in range(20)]
    texts = [" ".join(p) for p in rng.sample(list(combinations(passages, 2)), 60)]
    texts += [texts[0] + " more", texts[1] + " words"]
    read, written = collections.Counter(), simhash.written

    def counted(df, name):
        out = written(df, name)
        read[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {k: {60: 0, 61: 1}.get(k, k) for k in range(62)}
    assert read["sharing-candidates"] > 50 and read["candidate-texts"] <= 8
