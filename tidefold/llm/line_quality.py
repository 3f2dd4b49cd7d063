"""Quality rules from cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted; lines above the
host's limit are removed, and documents that lose too much are rejected. Distinct documents are those with distinct
sets of line hashes: exact copies count once and do not make their own lines look like boilerplate, whatever else
differs between documents tells them apart.

Shuffles: one row of two 16-byte digests per distinct (host, line, document), never a text. The verdict is computed
where the text is read: lines are hashed once and met with the host's frequent lines, and only texts with such a line
are looked at again.

Defined results: a null text has no words and no lines. A null host is a host of its own. Repeated rows count once
for a line and each get the same verdict. An empty table gives an empty result. Columns of the input other than the
named ones pass through unchanged and may have any name; helper columns are prefixed ``_lq_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text))


def word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), has_word)


def spaced(line: Column) -> Column:
    """Trimmed, with single spaces; most lines have only such, and need no rewriting."""
    return F.trim(F.when(line.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(line, SPACES, " ")).otherwise(line))


def line_key(line: Column) -> Column:
    """Lower case, single spaces, trimmed; then MD5, so that different lines do not meet at any size."""
    return F.md5(spaced(F.lower(line)))


def repeated_words(grams: Column, few: int = 8) -> Column:
    """Words that lie in a 3-word window found twice or more, counted once each. grams: the windows' hashes in order.

    Windows are compared by 64-bit hashes within one text, and most texts repeat none. Sorted, equal hashes are neighbours. Where at most few
    hashes repeat, their windows are looked up; otherwise the windows are sorted with their places, so a text of n
    words costs n log n however often it repeats itself."""

    def covered(places):
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    def repeats(sorted_hashes):
        return F.array_distinct(
            F.filter(sorted_hashes, lambda x, k: (k > 0) & (x == sorted_hashes[F.greatest(k - 1, F.lit(0))]))
        )

    def by_sorting(h, starts):
        def marked(s):
            last = F.size(s) - 1
            near = F.filter(
                s,
                lambda x, k: ((k > 0) & (x["h"] == s[F.greatest(k - 1, F.lit(0))]["h"]))
                | ((k < last) & (x["h"] == s[F.least(k + 1, last)]["h"])),
            )
            return covered(F.array_sort(F.transform(near, lambda x: x["i"])))

        return let(F.array_sort(F.transform(starts, lambda i: F.struct(h[i].alias("h"), i.alias("i")))), marked)

    starts = F.sequence(F.lit(0), F.size(grams) - 1)
    found = let(
        let(F.sort_array(grams), repeats),
        lambda rep: F.when(F.size(rep) <= few, covered(F.filter(starts, lambda i: F.array_contains(rep, grams[i])))).otherwise(
            by_sorting(grams, starts)
        ),
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(found)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """docs with helper columns (body, lines with a word) and the base columns in a struct _lq_base."""
    words, lines, grams = F.col("_lq_words"), F.col("_lq_lines"), F.col("_lq_grams")
    out = docs.withColumn("_lq_body", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({"_lq_words": words_of(F.col("_lq_body")), "_lq_lines": word_lines(F.col("_lq_body"))})
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    out = out.withColumn("_lq_grams", F.when(F.size(words) > 3, windows).otherwise(F.array().cast("array<long>")))
    base = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col("_lq_body"), F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(grams),
    }
    return out.withColumn("_lq_base", F.struct(*[c.alias(name) for name, c in base.items()])).drop("_lq_words", "_lq_grams")


def frequent_lines(
    docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = 10, max_share: float = 0.02
) -> DataFrame:
    """(host, keys): per host the keys of lines in more than max_share of its distinct documents and in min_docs at least.

    A host has at most (lines of a mean document / max_share) such lines, whatever its size."""
    lines = docs.select(F.col(host).alias("host"), word_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    keyed = lines.where(F.size("lines") > 0).select("host", F.array_sort(F.array_distinct(F.transform("lines", line_key))).alias("keys"))
    marked = keyed.select("host", "keys", F.unhex(F.md5(F.array_join("keys", ""))).alias("document"))
    # The empty key stands for the document itself and so counts the documents of a host.
    held = marked.select("host", "document", F.explode(F.concat("keys", F.array(F.lit("")))).alias("key"))
    held = held.select("host", F.unhex("key").alias("key"), "document").distinct()
    counts = held.groupBy("host", "key").agg(F.count("*").alias("n"))
    counts = written(counts.where((F.col("n") >= min_docs) | (F.octet_length("key") == 0)), "line-counts")
    hosts = counts.where(F.octet_length("key") == 0).select(F.col("host").alias("host_"), F.col("n").alias("docs"))
    over = counts.where(F.octet_length("key") > 0).join(hosts, F.col("host").eqNullSafe(F.col("host_")))
    over = over.where((F.col("n") >= min_docs) & (F.col("n") > F.col("docs") * max_share))
    return over.groupBy("host").agg(F.array_sort(F.collect_list(F.lower(F.hex("key")))).alias("keys"))


def line_quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = 10,
    max_share: float = 0.02,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost_percent: int = 70,
    broadcast_bytes: int = 64 << 20,
    salts: int = 64,
) -> DataFrame:
    """docs with the base columns, base_failed, n_removed_lines, n_left_words, kept and clean_text.

    The table of frequent lines is broadcast while hosts and keys take at most broadcast_bytes; beyond that it is joined
    on (host, salt), so that a host with a third of all rows spreads over tasks."""
    frequent = written(frequent_lines(docs, text, host, min_docs, max_share), "line-frequency")
    frequent = frequent.select(F.col("host").alias("_lq_host"), F.col("keys").alias("_lq_keys"))
    same_host = F.col(host).eqNullSafe(F.col("_lq_host"))
    size = frequent.agg(F.sum(F.lit(128) + F.coalesce(F.octet_length("_lq_host"), F.lit(0)) + 48 * F.size("_lq_keys"))).first()[0]
    if (size or 0) <= broadcast_bytes:
        joined = docs.join(F.broadcast(frequent), same_host, "left")
    else:
        dealt = docs.withColumn("_lq_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(salts)))
        spread = frequent.withColumn("_lq_salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = dealt.join(spread, same_host & (F.col("_lq_salt") == F.col("_lq_salt_")), "left").drop("_lq_salt", "_lq_salt_")
    out = with_base(joined, text)
    found = F.array_intersect(F.transform("_lq_lines", line_key), F.col("_lq_keys"))
    out = out.withColumn("_lq_found", F.when(F.col("_lq_keys").isNotNull(), found).otherwise(F.array().cast("array<string>")))
    judged = F.transform(
        F.split("_lq_body", "\n", -1),
        lambda x: F.struct(x.alias("x"), (has_word(x) & F.array_contains("_lq_found", line_key(x))).alias("gone")),
    )
    out = out.withColumn("_lq_judged", F.when(F.size("_lq_found") > 0, judged))
    lost = F.transform(F.filter("_lq_judged", lambda x: x["gone"]), lambda x: x["x"])
    left = F.transform(F.filter("_lq_judged", lambda x: ~x["gone"]), lambda x: x["x"])
    out = out.withColumn("_lq_lost", F.coalesce(lost, F.array().cast("array<string>")))
    n_words, n_repeat = F.col("_lq_base.n_words"), F.col("_lq_base.n_repeat_words")
    n_lost = F.when(F.size("_lq_lost") == 0, 0).otherwise(n_words_of(F.array_join("_lq_lost", "\n")))
    out = out.withColumns(
        {
            "_lq_failed": (n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words),
            "_lq_left": n_words - n_lost,
            "_lq_text": F.when(F.size("_lq_lost") == 0, F.col(text)).otherwise(F.array_join(left, "\n")),
        }
    )
    depleted = 100 * (n_words - F.col("_lq_left")) > max_lost_percent * n_words
    results = F.struct(
        "_lq_base.*",
        F.col("_lq_failed").alias("base_failed"),
        F.size("_lq_lost").cast("long").alias("n_removed_lines"),
        F.col("_lq_left").alias("n_left_words"),
        (~F.col("_lq_failed") & ~depleted).alias("kept"),
        F.col("_lq_text").alias("clean_text"),
    )
    # The results come out of a generator: a filter on kept does not move below it and compute everything twice.
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left_words", "kept", "clean_text"}
    return out.select(*[f"`{c}`" for c in docs.columns if c not in new], F.inline(F.array(results)))
