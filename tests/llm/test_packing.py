import collections
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidefold.llm import packing
from tidefold.llm.packing import Encoder, encode_texts, pack
from tidefold.llm.queries import word_tokenizer


def test_chunks_give_the_tokens_of_the_text():
    tok, rng = Tokenizer.from_file(word_tokenizer()), random.Random(1)
    parts = [*"abcXYZ 0159\n\t'sÉéßΣσİ\u0301  \x1c.,!<|>你👩\u200d \u200b\x85()=-@", "<|endoftext|>", "'re ", " <|startoftext|>", "ΑΣ", "straße ", "Éau,", "word.", "\u00b5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    for text, ids in zip(texts, encode_texts([t.encode() for t in texts], word_tokenizer())):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    assert Encoder(word_tokenizer()).direct


def check(rows, out, length):
    tok = Tokenizer.from_file(word_tokenizer())
    want = collections.Counter()
    for d, t, _ in rows:
        want[d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    lengths = collections.defaultdict(set)
    for (d, ids), _ in want.items():
        lengths[d].add(len(ids))
    at = collections.defaultdict(list)
    for r in out:
        at[r.sequence_id].append((r.offset, r.length))
        assert any(
            len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            for (d, ids) in want if d == r.doc_id
        )
    assert sum(r.length for r in out) == sum(len(ids) * n for (_, ids), n in want.items())
    for seq, parts in at.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == length or seq == max(at)
    assert sorted(at) == list(range(len(at)))


def test_round_trip_on_given_documents(spark, sf_small):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_small}/documents.parquet").limit(60).collect()]
    rows += [(9001, None, "src1"), (9002, "", None), (9003, "a  <|endoftext|>\u2003É ß", None), (9003, "again", "src1"), (9001, None, "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for length, window in ((2048, 1 << 20), (64, 500)):
        check(rows, pack(df, word_tokenizer(), length=length, window=window).collect(), length)


def test_windows_keep_the_proportions_and_carry_deficits(spark):
    rows = [(i, "the cat sat on " * (5 + i % 9), "abc"[i % 3 if i % 2 else 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    window, weights = 3000, {"a": 2, "b": 1, "c": 1}
    out = pack(df, word_tokenizer(), length=256, window=window, weights=weights).collect()
    check(rows, out, 256)
    longest = max(r.doc_tokens for r in out)
    sent = collections.Counter()
    for r in out:
        sent[r.source, r.window] += r.length
    for s, w in weights.items():
        total, quantum = 0, window * w / 4
        last = max(k for src, k in sent if src == s)
        for k in range(last):
            total += sent[s, k]
            assert quantum * (k + 1) - longest <= total <= quantum * (k + 1)  # a deficit below one document is carried


def test_unweighted_sources_come_last_and_empty(spark):
    rows = [(1, "a b c", "x"), (2, "d e f", "y"), (3, "g", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pack(df, word_tokenizer(), length=4, weights={"y": 1.0}).collect()
    check(rows, out, 4)
    assert min(out, key=lambda r: (r.sequence_id, r.offset)).doc_id == 2
    assert pack(df.limit(0), word_tokenizer()).collect() == []


def test_a_worker_remembers_no_chunks_after_its_task(spark):
    path = word_tokenizer()

    def left(batches):
        n = sum(x.num_rows for x in packing.tokenize(batches, path, 1, pa.int64()))
        e = packing._encoders[path]
        kept = sum(map(len, (e.chunks, e.old_chunks, e.pieces, e.old_pieces)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([kept], pa.int64())], names=["n", "kept"])

    rows = [(i, f"word{i} some other words, {i * i}", "web") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert [tuple(r) for r in docs.mapInArrow(left, "n long, kept long").collect()] == [(300, 0)]
