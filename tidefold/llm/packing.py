"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents. In each round (a window of ``window`` tokens) a queue earns a quantum, its
target share of the window, and sends whole documents while its deficit counter covers them; what is left is carried
to the next window. A document whose tokens end at c in its queue is therefore sent in round ceil(c / quantum) - 1,
so prefix sums give the window of every document, with deficits carried across windows and partitions alike. Windows
are laid one after the other, queue by queue, and the stream is cut every ``length`` tokens: only the last sequence
is not full.

Prefix sums run on three levels, so that no source, window or key is one task: inside a block (one task of the
tokenizing pass, where the sum is kept as documents come), over the blocks of a source, and over cells (window,
source, block) and windows. Ids are written once to the shared folder and shuffled once, to meet their places.

Tokens of a text are the tokens of its chunks between ASCII white space, which the tokenizer never joins; a chunk is
encoded once per task while it is remembered.

Defined results: a null text is empty; each document ends with end_id, so an empty one is that id alone. A null
source is a queue of its own. Sources without a positive weight are sent after all others. Repeated rows are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

#: Chunks a worker remembers, and bytes of text that it splits at once.
REMEMBERED, AT_ONCE = 500_000, 1 << 20

#: Letters that normal forms leave alone, then marks that make one piece: the tokenizer's first steps keep such a
#: chunk as these two pieces, so its model can be asked directly. All other chunks go through the whole tokenizer.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:%&*$#|()=+@-]*)")


class Encoder:
    """Little-endian 32-bit ids of texts; ids of chunks and of their pieces are remembered, within a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.forget()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.byte_letters = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}
        self.direct = self.agrees()

    def forget(self) -> None:
        self.chunks, self.old_chunks = {}, {}
        self.pieces, self.old_pieces = {}, {}

    def agrees(self) -> bool:
        """Whether this tokenizer treats plain chunks as described; another kind of tokenizer never takes the short way."""
        probes = ["Word.", "straße", "É", "naïve,", "ÿ!?", "a", "übermäßigerweise;;", "Aa%%%"]
        try:
            return all(self.plain(p.encode()) == self.whole([p])[0] for p in probes)
        except Exception:  # a model that cannot be asked for single pieces
            return False

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", c.ids).tobytes() for c in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def piece(self, text: bytes) -> bytes:
        known = self.pieces.get(text)
        if known is None:
            known = self.old_pieces.get(text)
            if known is None:
                letters = text.decode() if text.isascii() else "".join(map(self.byte_letters.__getitem__, text))
                known = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self.pieces[text] = known
        return known

    def plain(self, chunk: bytes) -> bytes | None:
        if chunk.isalpha():  # ASCII letters only
            return self.piece(chunk.lower())
        if found := PLAIN.fullmatch(chunk.decode()):
            return self.piece(found[1].lower().encode()) + (self.piece(found[2].encode()) if found[2] else b"")
        return None

    def learn(self, new: set[bytes]) -> None:
        others = []
        for chunk in new:
            ids = self.old_chunks.get(chunk) or (self.plain(chunk) if self.direct else None)
            if ids is None:
                others.append(chunk)
            else:
                self.chunks[chunk] = ids
        if others:
            self.chunks.update(zip(others, self.whole([c.decode() for c in others])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, k = [], 0
        while k < len(texts):
            split, size = [], 0
            while k < len(texts) and (not split or size < AT_ONCE):
                split.append(texts[k].split())
                size += len(texts[k])
                k += 1
            # What was not used since the last time is forgotten.
            if len(self.chunks) > REMEMBERED:
                self.chunks, self.old_chunks = {}, self.chunks
            if len(self.pieces) > REMEMBERED:
                self.pieces, self.old_pieces = {}, self.pieces
            self.learn(set().union(*split).difference(self.chunks))
            out += [b"".join(map(self.chunks.__getitem__, words)) for words in split]
        return out


_encoders: dict[str, Encoder] = {}


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)


def tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row per document, with its tokens' running sum in its queue within this task."""
    try:
        yield from tokenized(batches, path, end_id, id_type)
    finally:  # the worker goes on to other steps, and waits between them: it keeps the tokenizer only
        if path in _encoders:
            _encoders[path].forget()


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    end = end_id.to_bytes(4, "little")
    block, row, sums = TaskContext.get().partitionId(), 0, {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = part.column("text").cast(pa.binary()).to_pylist()
            ids = [x + end for x in encode_texts([t or b"" for t in texts], path)]
            lengths, ends = [len(x) // 4 for x in ids], []
            sources = part.column("source").to_pylist()
            for s, n in zip(sources, lengths):
                sums[s] = sums.get(s, 0) + n
                ends.append(sums[s])
            rows = range(row, row + len(ids))
            row += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(block << 33) + r for r in rows], pa.int64()), part.column("doc_id").cast(id_type),
                    part.column("source"), pa.array([block] * len(ids), pa.int32()),
                    pa.array(lengths, pa.int64()), pa.array(ends, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["row", "doc_id", "source", "block", "n", "end", "ids"],
            )


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    window: int = 1 << 20,
    weights: dict[str, float] | None = None,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, source), a row per piece.

    tokenizer: path of the tokenizer's file on every executor. weights: target shares by source name; without them
    the sources' own shares of all tokens, so that every window has the proportions of the whole."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
    )
    id_field = chosen.schema["doc_id"]
    id_type = to_arrow_type(id_field.dataType)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", id_field.dataType), T.StructField("source", T.StringType()),
        T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])
    tokens = written(chosen.mapInArrow(lambda b: tokenize(b, tokenizer, end_id, id_type), schema), "packing-ids")
    placed = places(tokens.drop("ids", "doc_id"), window, weights)
    joined = tokens.select("row", "doc_id", "ids").join(placed.hint("shuffle_hash"), "row")
    first, last = F.col("at"), F.col("at") + F.col("n")

    def piece(k):
        lo, hi = F.greatest(first, k * length), F.least(last, (k + 1) * length)
        part = F.substring(F.col("ids"), (1 + 4 * (lo - first)).cast("int"), (4 * (hi - lo)).cast("int"))
        return F.struct(
            (lo - first).alias("start"), (hi - lo).alias("length"), F.crc32(part).alias("ids_crc32"),
            F.col("n").alias("doc_tokens"), k.alias("sequence_id"), (lo - k * length).alias("offset"),
        )

    cuts = F.sequence(F.floor(first / length).cast("long"), F.floor((last - 1) / length).cast("long"))
    pieces = joined.select("doc_id", "window", F.expr("substring(source, 2)").alias("source"), F.inline(F.transform(cuts, piece)))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source")


def places(tokens: DataFrame, window: int, weights: dict[str, float] | None) -> DataFrame:
    """tokens (row, source, block, n, end) -> (row, source, n, window, at): the window and the place in the stream."""
    blocks = tokens.groupBy("source", "block").agg(F.max("end").alias("tokens"))
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        whole = tokens.agg(F.sum("n")).first()[0] or 1  # one number
        shares = totals.select("source", (F.col("total") / whole).alias("share"))
    else:
        of = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("=" + k, v / sum(weights.values()))])
        shares = totals.select("source", F.try_element_at(of, "source").alias("share"))
    blocks = blocks.join(shares, "source").select("source", "block", "before", (F.col("share") * window).alias("quantum"))
    sent = tokens.join(blocks, ["source", "block"])
    rounds = F.ceil((F.col("before") + F.col("end")) / F.col("quantum")).cast("long") - 1
    late = F.lit(1 << 40) + F.floor((F.col("before") + F.col("end")) / window).cast("long")
    sent = sent.withColumn("window", F.when(F.col("quantum") > 0, F.greatest(rounds, F.lit(0))).otherwise(late))

    cells = sent.groupBy("window", "source", "block").agg(F.sum("n").alias("n"), F.min(F.col("end") - F.col("n")).alias("low"))
    cells = written(cells, "packing-cells")
    # Of windows: sums within groups of 4096 neighbours, then over the groups.
    windows = cells.groupBy("window").agg(F.sum("n").alias("n")).withColumn("group", F.shiftright("window", 12))
    groups = windows.groupBy("group").agg(F.sum("n").alias("n"))
    up_to = (W.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("n").over(W.orderBy("group").rowsBetween(*up_to)), F.lit(0)).alias("base"))
    inside = W.partitionBy("group").orderBy("window").rowsBetween(*up_to)
    windows = windows.select("window", "group", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inner"))
    windows = windows.join(groups, "group").select("window", (F.col("inner") + F.col("base")).alias("base"))
    within = W.partitionBy("window").orderBy("source", "block").rowsBetween(*up_to)
    cells = cells.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(windows, "window")
    cells = cells.select("window", "source", "block", (F.col("base") + F.col("inner") - F.col("low")).alias("shift"))
    return sent.join(cells, ["window", "source", "block"]).select(
        "row", "source", "n", "window", (F.col("shift") + F.col("end") - F.col("n")).alias("at")
    )
