"""Packing by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut; the pieces' lengths are counted. On the histogram alone (as many entries as a
sequence has tokens) lengths are placed longest first, each into the packs that are filled least, and a run of equal packs is
kept as one pattern; where none has room, as few packs are opened as the rest of the length needs. Pieces then find their place by their
rank among pieces of equal length: a map task numbers its own as it writes them, and the numbers of equal pieces in the tasks before are a
small table, so that ids are written once and never shuffled while that table may be broadcast (up to BASES bytes).

Defined results: a null text is empty and gives the end id alone; repeated ids and rows are documents of their own; a null key is kept;
other columns are ignored; an empty table gives an empty table. Order among equal lengths is that of the tasks and the pieces they wrote.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .tokens import encoder

SEQUENCE, END_ID = 2048, 1
#: Bytes of the table of bases that are broadcast at most; a larger one is joined by task.
BASES = 256 << 20


class Slot(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank``, ``count`` of them, start at ``offset`` in sequences from ``sequence``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], most: int = SEQUENCE) -> list[Slot]:
    slots: list[Slot] = []
    packs: list[tuple[int, int, int]] = []  # fill, first sequence, number of sequences
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and packs[0][0] + length <= most:
                fill, first, n = heapq.heappop(packs)
            else:
                fill, first, n = 0, sequences, -(-left // (most // length))
                sequences += n
            k = min(n, left)
            slots.append(Slot(length, rank, k, first, fill))
            heapq.heappush(packs, (fill + length, first, k))
            if n > k:
                heapq.heappush(packs, (fill, first + k, n - k))
            left, rank = left - k, rank + k
    return slots


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``key, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens``: documents cut into pieces of ``most`` ids and a rest.

    ``_part, _nth``: the task, and how many pieces of that length it wrote before. They name a piece once the table is written.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path, end_id), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                at, start, length, whole, ids, nth = [], [], [], [], [], []
                for i, x in enumerate(enc.encode(part.column(1).to_pylist())):
                    raw = x.astype("<u4").tobytes()
                    for s in range(0, len(x), most):
                        at.append(i)
                        start.append(s)
                        length.append(min(most, len(x) - s))
                        whole.append(len(x))
                        ids.append(raw[4 * s : 4 * (s + most)])
                        nth.append(seen[length[-1]])
                        seen[length[-1]] += 1
                yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(whole, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(nth, pa.int64())], [key, "start", "length", "ids", "doc_tokens", "_part", "_nth"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(f, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, _part int, _nth long")


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces, each with its ``sequence_id`` and ``offset``."""
    cut = materialize(pieces(docs, path, text, key, most, end_id), "pieces")
    each = materialize(cut.groupBy("length", "_part").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as a sequence has tokens
    # a row a length: its slots by rank, as many in all as the plan has
    slots = defaultdict(list)
    for x in sorted(plan(counts, most)):
        slots[x.length].append((x.rank, x.sequence, x.offset))
    table = F.broadcast(docs.sparkSession.createDataFrame(list(slots.items()), "_length long, _slots array<struct<rank:long,sequence:long,offset:long>>"))
    # a row a task: by length, how many pieces of that length the tasks before it have
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    based = each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = materialize(based.groupBy(F.col("_part").alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("_bases")), "bases")
    if 16 * each.count() <= BASES:
        bases = F.broadcast(bases)
    ranked = cut.join(bases, F.col("_part") == F.col("_p")).join(table, F.col("length") == F.col("_length"))
    rank = F.element_at("_bases", F.col("length")) + F.col("_nth")
    at = F.element_at(F.filter("_slots", lambda x: x["rank"] <= rank), -1)
    return ranked.select(key, "start", "length", "ids", "doc_tokens", (at["sequence"] + rank - at["rank"]).alias("sequence_id"), at["offset"].alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence in order, without padding."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
