import random

import numpy as np
from pyspark.sql import functions as F

from tidefold.llm import language_id
from tidefold.llm.language_id import AT_ONCE, SIZES, build, codes_of, identify, places, predict, text_grams

SCHEMA = "doc_id long, text string, lang string, held_out int"


def words_of(text):
    return np.concatenate(list(codes_of(text)))


def grams(text):
    return np.concatenate([g for g, _ in text_grams(text)])


def fifth():
    return F.pmod(F.col("doc_id"), F.lit(5)) == 0


def test_held_out_accuracy_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = identify(docs, out).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_the_table_holds_every_gram_and_false_positives_are_as_predicted():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 1 << 63, 4000, np.uint64)
    model = build(["a", "b"], [(int(g), "a") for g in grams[:3000]] + [(int(g), "b") for g in grams[3000:]], 1 << 14)

    def having(g, k):
        masks = np.bitwise_and.reduce([model.table[at, 0] for at in places(g, 1 << 14)])
        return (masks >> np.uint64(k) & np.uint64(1)).mean()

    assert having(grams[:3000], 0) == 1 and having(grams[3000:], 1) == 1
    others = rng.integers(0, 1 << 63, 200_000, np.uint64)
    for k in (0, 1):
        assert abs(having(others, k) - model.false_positive[k]) < 0.01


def test_grams_of_small_words():
    codes = words_of("Ab, ć!")
    assert codes.tolist() == [0, ord("a"), ord("b"), 0, ord("c"), 0x301, 0]
    assert len(grams("Ab, c\u0301!")) == 6  # 0ab ab0 0ab0 and the same of the second word


def test_no_gram_is_lost_between_parts(monkeypatch):
    """Against a walk over all places of the whole text, for parts of every small size."""
    rng = random.Random(6)
    for text in ("".join(rng.choice("abć") for _ in range(50)), "".join(rng.choice("ab  .") for _ in range(80)), "a", "", " ", "ab cd"):
        monkeypatch.setattr(language_id, "AT_ONCE", 1 << 18)
        codes = [0] + [ord(c) if c.isalpha() or c == "\u0301" else 0 for c in text] + [0]
        codes = [c for k, c in enumerate(codes) if c or not k or codes[k - 1]]
        count = sum(1 for n in SIZES for k in range(len(codes) - n + 1) if all(codes[k + 1 : k + n - 1]))
        whole = sorted(grams(text).tolist())
        assert len(whole) == count
        for size in (1, 2, 3, 4, 7):
            monkeypatch.setattr(language_id, "AT_ONCE", size)
            assert sorted(grams(text).tolist()) == whole


def test_more_than_64_languages_and_long_texts():
    rng = random.Random(1)
    names = [f"l{k:03}" for k in range(70)]
    alphabet = {n: [chr(0x4E00 + 3 * k + j) for j in range(3)] for k, n in enumerate(names)}
    text = {n: " ".join("".join(rng.choice(alphabet[n]) for _ in range(5)) for _ in range(200)) for n in names}
    model = build(names, [(int(g.view(np.int64)), n) for n in names for g in grams(text[n])], 1 << 18)
    assert all(predict(text[n], model)[0] == n for n in names)
    assert predict("x" * 10 + text["l069"] * 1 + " " * AT_ONCE + text["l069"], model)[0] == "l069"
    assert predict("y" * (2 * AT_ONCE + 5), model) == ("l000", 0.0)


def test_edge_cases(spark):
    rows = [(i, t, lang, 0) for i, (t, lang) in enumerate([("the thing there", "en"), ("der die das", "de")] * 5)]
    rows += [(100, None, "en", 0), (101, "", None, 0), (102, "123 ...", "de", 0), (104, "\u0301 \u0308\u0301", None, 0), (103, "the there", None, 0), (103, "the there", None, 0), (None, "das die", None, 1)]
    held = F.coalesce(fifth(), F.lit(False))
    got = sorted(((r.doc_id, r.held_out, r.lang_pred) for r in identify(spark.createDataFrame(rows, SCHEMA), held).collect()), key=repr)
    want = [(i, i % 5 == 0, lang) for i, _, lang, _ in rows[:10]]
    want += [(100, True, "und"), (101, False, "und"), (102, False, "und"), (104, False, "und"), (103, False, "en"), (103, False, "en"), (None, False, "de")]
    assert got == sorted(want, key=repr)
    assert identify(spark.createDataFrame([], SCHEMA), fifth()).collect() == []
    assert {r.lang_pred for r in identify(spark.createDataFrame([(1, "the", None, 0)], SCHEMA), fifth()).collect()} == {"und"}
