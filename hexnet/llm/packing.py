"""Best-fit packing: documents into training sequences of a fixed number of tokens, by best-two-fit.

A bin is filled greedily with the largest piece that still fits.  Then its smallest piece is replaced
with two unpacked pieces that fit its expanded gap (the gap and the replaced piece) more tightly, where
there are two such pieces; the replaced piece goes back to the unpacked ones.

Defined results: a null text is an empty document and has the end token alone; repeated rows are packed
as often as they come; a null doc_id stays null and changes no other id; pieces of equal length are taken
in the order of id, piece and start; an empty table gives no row; further columns are ignored.  Only documents longer than a sequence are cut, from the end, so the first piece may be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces that one task packs.  Its last bin or two may stay open, so groups are large.
GROUP = 25_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of size tokens, but for the first."""
    first = n % size or min(n, size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions in lengths.  Each length is from 1 to size."""
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    for k, n in enumerate(lengths):
        waiting[n].append(k)
    there = 0  # bit n: pieces of n tokens wait
    for n in range(1, size + 1):
        if waiting[n]:
            there |= 1 << n

    def take(n: int) -> int:
        nonlocal there
        k = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
        return k

    bins = []
    while there:
        gap, own = size, []
        while best := (there & ((2 << gap) - 1)).bit_length():
            n = best - 1
            own.append((n, take(n)))
            gap -= n
        if gap and len(own) > 1 and there:
            small, k = own[-1]  # the last is the smallest: pieces were taken from large to small
            room, pair, most = gap + small, None, small
            a = (there & ((1 << room) - 1)).bit_length() - 1
            while a > 0 and 2 * a > most:
                rest = min(room - a, a)
                left = there if len(waiting[a]) > 1 else there & ~(1 << a)
                b = (left & ((2 << rest) - 1)).bit_length() - 1
                if b > 0 and a + b > most:
                    pair, most = (a, b), a + b
                    if most == room:
                        break
                a = (there & ((1 << a) - 1)).bit_length() - 1
            if pair:
                own[-1:] = [(n, take(n)) for n in pair]
                waiting[small].append(k)
                there |= 1 << small
        bins.append([k for _, k in own])
    return bins


def pieces(documents: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """The pieces of every document with the crc32 of their ids as little-endian unsigned 32-bit integers."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        words, row = encoder(tokenizer), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"].to_pylist()), strict=True):
                ids += end
                view = memoryview(ids)
                out += [(doc_id, row, k, at, n, zlib.crc32(view[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, size))]
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(cut_up: DataFrame, size: int) -> DataFrame:
    """Deals the pieces of documents to groups of about GROUP by hash and packs each group in a task."""
    groups = max(1, round(cut_up.count() / GROUP))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        own, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        lengths, group = pdf["length"].to_numpy(), int(pdf["grp"].iloc[0])
        for k, members in enumerate(best_two_fit(lengths.tolist(), size)):
            own[members] = (group << 32) + k
            offset[members] = np.cumsum([0, *lengths[members][:-1]])
        return pd.DataFrame({c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}).assign(sequence_id=own, offset=offset)

    dealt = cut_up.withColumn("grp", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("int"))
    # ids as text: a column of longs with nulls would pass through doubles
    packed = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("grp").applyInPandas(run, PACKED)
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document, with end_id after it, into sequences of at most size tokens.

    tokenizer: a file of the tokenizers library that each executor can open.  The pieces are written to
    the shared folder, so no text is encoded again when an executor is lost in packing.
    """
    common.ready(documents.sparkSession)
    return pack(common.materialize(pieces(documents, tokenizer, size, end_id), "pieces"), size)
