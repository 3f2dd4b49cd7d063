"""Line dedup by pairwise alignment.

Documents that overlap are found through shared line hashes, aligned with patience diff, and the aligned common
blocks of ``min_words`` words or more are deleted from the later document (the larger id; of equal ids the later row).

Candidates come two ways, both linear in the input:

* a rare line, one that at most ``rare`` documents hold, brings all of its earlier holders to each later one;
* a run, the shortest stretch of lines with ``min_words`` words from a line on, brings the first document that holds
  it to all later ones. Every block that may be deleted begins with such a run, so common lines lose nothing, and a
  line or group of copies in a third of all documents adds one pair for each of them.

Candidates meet on 64-bit hashes; alignment compares lines by two of them, so that lines of a very large corpus are not
taken for each other, and sees nothing else of them but their places. Lines that occur once in both documents are anchors;
the longest increasing sequence of anchors is kept, grown line by line, and the gaps are aligned again; blocks that
were moved are found by aligning what is left, and shared runs outside of all alignments by their hashes. The numbered documents are written once and shuffled
once, to meet their deleted lines.

Defined results: null and empty texts stay as they are and match nothing; lines without a word take part in no match,
but do not part a block, and go with it where they lie inside one. Repeated rows are documents of their own, and the
later ones lose what the first one has. Lines are compared after trimming and joining white space. An empty table
gives an empty result. Other columns pass through, whatever their names (helper columns begin with ``_ld_``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .line_quality import n_words_of, spaced


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) that rises in the second."""
    tails, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        back.append(at[n - 1] if n else -1)
        if n == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[n], at[n] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchors(a: list, b: list, spans: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Lines that are unique in both spans; without such, lines that have the same number of occurrences in both."""
    a_lo, a_hi, b_lo, b_hi = spans
    n_a, n_b = Counter(a[a_lo:a_hi]), Counter(b[b_lo:b_hi])
    unique = {x for x, n in n_a.items() if n == 1 and n_b.get(x) == 1}
    if not unique:
        unique = {x for x, n in n_a.items() if n_b.get(x) == n}
    if not unique:
        unique = n_a.keys() & n_b.keys()
    places: dict[object, list[int]] = {}
    for k in range(b_lo, b_hi):
        if b[k] in unique:
            places.setdefault(b[k], []).append(k)
    seen: Counter = Counter()
    pairs = []
    for k in range(a_lo, a_hi):
        x = a[k]
        if x in unique and seen[x] < len(places[x]):
            pairs.append((k, places[x][seen[x]]))
            seen[x] += 1
    return increasing(pairs)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        if a_lo < a_hi and b_lo < b_hi:
            found = anchors(a, b, (a_lo, a_hi, b_lo, b_hi))
            if found:
                out += found
                edges = [(a_lo - 1, b_lo - 1), *found, (a_hi, b_hi)]
                todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def stretches(lines: list[tuple], min_words: int) -> Iterator[tuple[int, int]]:
    """The shortest stretches (first, last) of neighbouring lines with min_words words, from each line on and up to each line."""
    sums, begins = [0], []
    for k, x in enumerate(lines):
        sums.append(sums[-1] + x[3])
        begins.append(begins[-1] if k and x[0] - lines[k - 1][0] == 1 else k)
    for k in range(len(lines)):
        end = bisect_left(sums, sums[k] + min_words) - 1
        if end < len(lines) and begins[end] <= k:
            yield k, end
        start = bisect_right(sums, sums[k + 1] - min_words) - 1
        if start >= begins[k]:
            yield start, k


def common_blocks(later: list[tuple], earlier: list[tuple], min_words: int) -> list[tuple[int, int]]:
    """Blocks (first line, last line) of the later document to delete.

    Both are lists of (place, line, hash, words), places counting lines with words; a step of more than one in place
    means that a line between is not shared. Aligned again without the found blocks until nothing more is found; then
    what lies outside of the alignments is added: every shared stretch of min_words words."""
    blocks = []
    whole = later
    while later:
        matched = patience([x[2] for x in later], [x[2] for x in earlier])
        gone: set[int] = set()
        k = 0
        while k < len(matched):
            end, words = k, later[matched[k][0]][3]
            while end + 1 < len(matched):
                (p, q), (r, s) = matched[end], matched[end + 1]
                if later[r][0] - later[p][0] != 1 or earlier[s][0] - earlier[q][0] != 1:
                    break
                end, words = end + 1, words + later[r][3]
            if words >= min_words:
                blocks.append((later[matched[k][0]][1], later[matched[end][0]][1]))
                gone.update(range(matched[k][0], matched[end][0] + 1))
            k = end + 1
        if not gone:
            break
        later = [x for k, x in enumerate(later) if k not in gone]
    left = {x[1] for x in later}
    if left:
        mine, theirs = ([x[2] for x in side] for side in (whole, earlier))
        known = {tuple(theirs[i : j + 1]) for i, j in stretches(earlier, min_words)}
        for i, j in sorted(stretches(whole, min_words)) if known else ():
            if tuple(mine[i : j + 1]) in known and any(x[1] in left for x in whole[i : j + 1]):
                blocks.append((whole[i][1], whole[j][1]))
                left.difference_update(x[1] for x in whole[i : j + 1])
    return blocks


def aligned(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(doc, block) for each block that a pair of documents has in common."""
    for batch in batches:
        docs, gone = [], []
        for row, mine, theirs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            got = common_blocks(*([(x["at"], x["line"], (x["h"], x["c"]), x["w"]) for x in side] for side in (mine, theirs)), min_words)
            for lo, hi in got:
                docs.append(row)
                gone.append({"lo": lo, "hi": hi})
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(gone, pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))], names=["doc", "block"]
        )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 25, rare: int = 4) -> DataFrame:
    """docs with clean_text, n_removed_lines and n_removed_words."""
    ship(docs.sparkSession)
    # Rows are numbered in a written table, so that all stages see the same numbers.
    rows = written(docs.withColumn("_ld_row", F.monotonically_increasing_id()), "numbered-documents")
    raw = F.transform(
        F.split(F.col(text), "\n", -1),
        lambda x, k: F.struct(k.alias("line"), spaced(x).alias("x")),
    )
    coded = F.transform(
        F.filter(raw, lambda x: x["x"] != ""),
        lambda x, k: F.struct(
            k.alias("at"), x["line"].alias("line"), F.xxhash64(x["x"]).alias("h"), F.xxhash64(F.lit(1), x["x"]).alias("c"),
            (F.length(x["x"]) - F.length(F.replace(x["x"], F.lit(" "), F.lit(""))) + 1).alias("w"),
        ),
    )
    key = F.struct(F.col(doc_id).alias("id"), F.col("_ld_row").alias("row"))
    base = written(rows.select(key.alias("doc"), coded.alias("lines")).where(F.size("lines") > 0), "line-hashes")
    flat = base.select("doc", F.inline("lines"))

    held = flat.select("h", "doc").distinct().groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    shared = written(held.where("n > 1"), "shared-lines")
    own = flat.join(shared, "h")

    def run(x, k):
        """Hash of the shortest stretch from this line on that has min_words words; lines have one at least."""
        sums = F.aggregate(
            F.slice("lines", k + 1, F.lit(min_words)),
            F.struct(F.lit(0).alias("w"), F.lit(0).cast("long").alias("h")),
            lambda acc, y: F.when(acc["w"] >= min_words, acc).otherwise(
                F.struct((acc["w"] + y["w"]).alias("w"), F.xxhash64(acc["h"], y["h"]).alias("h"))
            ),
        )
        alone = F.struct(x["w"].alias("w"), F.xxhash64(F.lit(0).cast("long"), x["h"]).alias("h"))
        return F.when(x["w"] >= min_words, alone).otherwise(sums)

    runs = base.select("doc", F.explode(F.transform("lines", run)).alias("r")).where(F.col("r.w") >= min_words)
    runs = runs.select("doc", F.col("r.h").alias("h")).distinct()
    first = runs.groupBy("h").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    by_run = runs.join(first, "h").where("doc > owner").select("doc", "owner")
    few = own.where(F.col("n") <= rare).select("h", "doc").distinct()
    holders = few.groupBy("h").agg(F.collect_list("doc").alias("docs"))  # rare documents at most
    by_line = holders.select(F.explode("docs").alias("doc"), "docs").select("doc", F.explode("docs").alias("owner"))
    pairs = by_run.unionByName(by_line.where("doc > owner"))
    pairs = written(pairs.select(F.col("doc.row").alias("doc"), F.col("owner.row").alias("owner")).distinct(), "overlapping")

    # What alignment needs of a document: its shared lines with their places.
    needed = pairs.select(F.col("doc").alias("row")).unionByName(pairs.select(F.col("owner").alias("row"))).distinct()
    table = own.select(F.col("doc.row").alias("row"), F.struct("at", "line", "h", "c", "w").alias("x")).join(needed, "row", "left_semi")
    table = written(table.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("lines")), "shared-by-document")
    both = pairs.join(table.select(F.col("row").alias("doc"), F.col("lines").alias("mine")), "doc")
    both = both.join(table.select(F.col("row").alias("owner"), F.col("lines").alias("theirs")), "owner")
    cut = both.select("doc", "mine", "theirs").mapInArrow(lambda b: aligned(b, min_words), "doc long, block struct<lo:int,hi:int>")
    cuts = cut.groupBy("doc").agg(F.collect_set("block").alias("_ld_blocks")).withColumnRenamed("doc", "_ld_row")

    joined = rows.join(written(cuts, "deleted-blocks"), "_ld_row", "left")
    kept = F.filter(
        F.split(F.col(text), "\n", -1), lambda x, k: ~F.exists("_ld_blocks", lambda b: (b["lo"] <= k) & (k <= b["hi"]))
    )
    clean = F.when(F.col("_ld_blocks").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("clean_text", clean)
    none = F.lit(0).cast("long")
    return out.withColumns(
        {
            "n_removed_lines": F.when(
                F.col("_ld_blocks").isNull(), none
            ).otherwise((F.size(F.split(F.col(text), "\n", -1)) - F.size(kept)).cast("long")),
            "n_removed_words": F.when(F.col("_ld_blocks").isNull(), none).otherwise(
                (n_words_of(F.col(text)) - n_words_of(F.col("clean_text"))).cast("long")
            ),
        }
    ).drop("_ld_row", "_ld_blocks")
