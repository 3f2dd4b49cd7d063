import itertools
import random
import re

from tidefold.llm.line_dedup import common_blocks, dedup_lines, increasing, patience

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def coded(text):
    lines = [(k, " ".join(WORD.findall(x))) for k, x in enumerate((text or "").split("\n"))]
    return [(k, x, len(x.split(" "))) for k, x in lines if x]


def bounds(docs, min_words):
    """docs in order: for each the raw lines that must go and those that may go, by comparing it with every earlier one.

    May: all stretches of consecutive equal lines with min_words words. Must: the shortest of them, from each line on."""
    lines = [coded(t) for t in docs]
    out = []
    for later in range(len(docs)):
        must, may = set(), set()
        a = lines[later]
        for b in lines[:later]:
            for i, j in itertools.product(range(len(a)), range(len(b))):
                n = words = 0
                while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                    words += a[i + n][2]
                    n += 1
                    if words >= min_words:
                        part = set(range(a[i][0], a[i + n - 1][0] + 1))
                        may |= part
                        if words - a[i + n - 1][2] < min_words:
                            must |= part
        out.append((must, may))
    return out


def deduped(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, n int, doc int")
    return dedup_lines(df.repartition(3), **k).collect()


def line(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(n))


def test_planted_passages_against_brute_force(spark):
    rng = random.Random(2)
    passages = ["\n".join(line(rng, rng.choice([6, 30])) for _ in range(rng.randint(2, 5))) for _ in range(6)] + [line(rng, 60)]
    common = [line(rng, 3), line(rng, 7)]
    rows = []
    for d in range(90):
        parts = [line(rng, rng.choice([2, 9, 40])) for _ in range(rng.randint(0, 6))] + rng.sample(common, rng.randint(0, 2))
        parts += rng.sample(passages, rng.choice([0, 0, 1, 2]))
        rng.shuffle(parts)
        rows.append((d, rng.choice(["\n", "\n\n", " \n"]).join(parts), "x", 1, 2))
    rows += [(200 + k, rows[k][1], "y", 0, 0) for k in range(5)] + [(300, None, "", 0, 0), (301, "", "", 0, 0), (302, "\n \n", "", 0, 0)]
    got = {r.doc_id: r.clean_text for r in deduped(spark, rows)}
    changed = 0
    for (d, text, *_), (must, may) in zip(rows, bounds([r[1] for r in rows], 25)):
        if not may:
            assert got[d] == text
            continue
        changed += 1
        left = got[d].split("\n") if got[d] else []
        raw = text.split("\n")
        assert all(raw[k] in left for k in range(len(raw)) if k not in may)
        assert len(raw) - len(may) <= len(left) <= len(raw) - len(must) or not left
        assert not [raw[k] for k in must if len(raw[k]) > 40 and raw[k] in left]
    assert changed > 20


def test_repeated_rows_and_columns(spark):
    text = "\n".join(f"row {k} has some words of its own here" for k in range(9))
    rows = [(5, text, "a", 1, 2), (5, text, "b", 3, 4), (4, text + "\nmore", "c", 5, 6), (None, text, "d", 7, 8)]
    got = deduped(spark, rows)
    assert sorted((r.h, r.n, r.doc) for r in got) == [("a", 1, 2), ("b", 3, 4), ("c", 5, 6), ("d", 7, 8)]
    assert sorted((r.h, r.clean_text) for r in got if r.clean_text) == [("c", "more"), ("d", text)]
    assert {r.h: r.n_removed_words for r in got} == {"a": 72 + 9, "b": 81, "c": 81, "d": 0}


def test_hot_line_and_many_copies_stay_linear(spark):
    copy = "\n".join(f"copy line {k} " + "word " * 20 for k in range(4))
    rows = [(k, copy if k % 2 else f"own words {k}\ncommon line", "", 0, 0) for k in range(400)]
    got = {r.doc_id: r.clean_text for r in deduped(spark, rows)}
    assert got[1] == copy and all(got[k] == ("" if k % 2 else rows[k][1]) for k in range(400) if k != 1)


def test_moved_and_repeated_blocks():
    row = lambda hs: [(k, k, h, 10) for k, h in enumerate(hs)]
    assert sorted(common_blocks(row("defabc"), row("abcdef"), 25)) == [(0, 2), (3, 5)]
    assert sorted(common_blocks(row("abcxabc"), row("abc"), 25)) == [(0, 2), (4, 6)]
    assert common_blocks(row("abxc"), row("abc"), 25) == []
    assert common_blocks([(0, 0, "a", 20), (2, 2, "b", 20)], row("ab"), 25) == []


def test_blocks_outside_of_the_alignment(spark):
    passage, menu = "passage " + "word " * 60, ["home about", "all rights reserved"]
    assert common_blocks([(0, 0, "p", 60), (1, 1, "m", 2), (2, 2, "n", 3)], [(0, 0, "m", 2), (1, 1, "n", 3), (2, 2, "p", 60)], 25) == [(0, 0)]
    rows = [(1, "\n".join([*menu, passage]), "", 0, 0), (2, "\n".join([passage, *menu]), "", 0, 0)]
    assert {r.doc_id: r.clean_text for r in deduped(spark, rows)} == {1: rows[0][1], 2: "\n".join(menu)}
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([(k, k, rng.randint(0, 7), 10) for k in range(rng.randint(0, 14))] for _ in range(2))
        want = {k for i in range(len(a)) for j in range(len(b)) for n in range(3, 15) if i + n <= len(a) and j + n <= len(b)
                and all(a[i + x][2] == b[j + x][2] for x in range(n)) for k in range(i, i + n)}
        assert {k for lo, hi in common_blocks(a, b, 25) for k in range(lo, hi + 1)} == want


def test_patience_matches_equal_lines_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 20))] for _ in range(2))
        got = patience(a, b)
        assert all(a[p] == b[q] for p, q in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
    assert increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def test_empty(spark):
    assert deduped(spark, []) == []
