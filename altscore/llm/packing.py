"""Best-fit packing of documents into fixed-length sequences.

Bin packing depends on lengths alone, and there are at most ``capacity``
different lengths.  So the instance is solved as a histogram (length ->
number of pieces), whose size does not grow with the corpus:

1. *Martello-Toth reduction.*  For the longest open length ``j`` a set with
   at most two further pieces is fixed for good when it dominates every other
   feasible set of ``j``: ``{j}`` if nothing fits beside it; ``{j, i}`` if it
   is exactly full, if no two pieces fit beside ``j``, or if at most two fit
   and no pair is longer than ``i``; ``{j, i, s}`` if at most two fit and no
   pair can beat ``i`` and ``s`` one by one.  Equal lengths are fixed together.
2. *Best fit, decreasing*, of what remains, again on counts.

The result is a list of patterns with multiplicities.  Every piece then finds
its place from its length and its number among the pieces of that length
(running counts per input partition, prefix-summed per length), so no shuffle
carries texts or ids.

Defined results: null and empty texts are one piece with the end id only; rows
repeated in the input are packed as often as they occur; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, staged
from .tokens import encoder

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

PIECES = "piece int, start long, length int, ids_crc32 long, part int, rank long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids; only the first may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its place in the document, length, crc32 and number."""
    arrow_batches(docs.sparkSession)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            cols = ([], [], [], [], [], [])
            for at, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids += end
                start = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for c, v in zip(cols, (at, k, start, n, zlib.crc32(memoryview(ids)[4 * start:4 * (start + n)]), seen[n])):
                        c.append(v)
                    seen[n] += 1
                    start += n
            at, k, start, n, crc, rank = cols
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()),
                 pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, {PIECES}")


class _Open:
    """Lengths still to be packed, with their counts."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()
        self._below = None

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if self.n[length] == 0:
            self._below = None

    def below(self) -> np.ndarray:
        """For each x, the largest open length that is at most x (0: none)."""
        if self._below is None:
            at = np.arange(len(self.n))
            self._below = np.maximum.accumulate(np.where(self.n > 0, at, 0))
        return self._below

    def smallest(self, k: int, without: int) -> list[int]:
        """The k shortest open pieces, one piece of length ``without`` apart."""
        out: list[int] = []
        for x in np.flatnonzero(self.n)[:k + 1]:
            out += [int(x)] * min(k, int(self.n[x]) - (x == without))
        return out[:k]


def _best_pair(open_: _Open, room: int, j: int) -> int:
    """Largest sum of two open lengths within ``room`` (an upper bound where a
    length would have to be used twice)."""
    below = open_.below()
    k = np.flatnonzero(open_.n[:room]) if room > 1 else np.array([], dtype=int)
    k = k[k > 0]
    other = below[room - k]
    ok = other > 0
    return int((k[ok] + other[ok]).max()) if ok.any() else 0


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list, np.ndarray]:
    """Martello-Toth reduction: (fixed patterns with multiplicity, open counts)."""
    open_, fixed = _Open(counts), []
    for j in range(capacity, 0, -1):
        while open_.n[j] > 0:
            room = capacity - j
            own = 1                       # pieces of length j that the set holds
            open_.n[j] -= 1               # one piece of j is in the set
            open_._below = None
            below = open_.below()
            i = int(below[room])
            small = open_.smallest(3, -1)
            open_.n[j] += 1
            open_._below = None
            left = int(open_.n[j])
            if i == 0:
                fixed.append((left, [(j, 1)]))
                open_.take(j, left)
                continue
            two = len(small) >= 2 and small[0] + small[1] <= room
            three = len(small) >= 3 and sum(small) <= room
            own += i == j
            pair = i == room or not two or (not three and _best_pair(open_, room, j) <= i)
            if pair:
                m = left // 2 if i == j else min(left, int(open_.n[i]))
                # while the shortest pieces stay, the same set dominates again
                if i in small[:3] and i != room:
                    m = min(m, max(1, int(open_.n[i]) - 3))
                fixed.append((m, [(j, 2)] if i == j else [(j, 1), (i, 1)]))
                open_.take(j, m * own)
                if i != j:
                    open_.take(i, m)
                continue
            if not three:
                s = int(below[room - i]) if room > i else 0
                enough = open_.n[s] > (s == j) + (s == i) and open_.n[i] > (i == j) if s else False
                if enough and int(below[room // 2]) <= s:
                    fixed.append((1, _pattern([j, i, s])))
                    for x in (j, i, s):
                        open_.take(x, 1)
                    continue
            break                          # undecided: left to best fit
    return fixed, open_.n


def _pattern(lengths: list[int]) -> list[tuple[int, int]]:
    return [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]


def best_fit(counts: np.ndarray, capacity: int) -> list:
    """Best fit decreasing on counts: (multiplicity, [(length, number)])."""
    done, spare = [], [[] for _ in range(capacity + 1)]     # open bins by room
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(m, items, room):
        if room == 0:
            done.append((m, items))
        else:
            spare[room].append((m, items))
            rooms[room] = True

    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            fit = x + int(np.argmax(rooms[x:])) if rooms[x:].any() else 0
            if fit:
                m, items = spare[fit].pop()
                rooms[fit] = bool(spare[fit])
            else:
                fit, m, items = capacity, n, []              # new bins
            q = fit // x                                     # a bin stays the best fit until full
            if n >= q:
                k = min(m, n // q)
            else:
                q, k = n, 1
            if m > k and (items or fit != capacity):
                put(m - k, items, fit)
            put(k, [*items, (x, q)], fit - q * x)
            n -= k * q
    return done + [b for room in spare for b in room]


def pack_counts(counts: np.ndarray, capacity: int) -> list:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: per interval of their numbers the
    first sequence, the pieces per sequence and their first offset."""
    rows, used, first = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for m, items in patterns:
        offset = 0
        for x, q in items:
            rows.append((x, used[x], first, q, offset))
            used[x] += m * q
            offset += q * x
        first += m
    t = np.array(rows or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    return {"length": t[:, 0], "from": t[:, 1], "sequence": t[:, 2], "per": t[:, 3], "offset": t[:, 4]}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    p = staged(pieces(docs, capacity, tokenizer, end_id), "pieces")
    per = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    per = staged(per, "piece-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():     # at most ``capacity`` rows
        counts[r.length] = r.n
    at = places(pack_counts(counts, capacity), capacity)
    # one number out of (length, rank), for a single search
    wide = int(counts.max()) + 1
    keys = at["length"] * wide + at["from"]

    def locate(batches):
        for b in batches:
            length = b.column(3).to_numpy()
            rank = b.column(5).to_numpy() + b.column(6).to_numpy()
            k = np.searchsorted(keys, length * wide + rank, side="right") - 1
            inside = rank - at["from"][k]
            seq = at["sequence"][k] + inside // at["per"][k]
            offset = at["offset"][k] + inside % at["per"][k] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = per.select("length", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    x = p.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "rank", "before")
    kind = p.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(locate, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
