"""Packing documents into as few training sequences as possible, by the linear grouping scheme on the histogram of lengths.

Lengths are integers up to a sequence's capacity, so the whole instance is a histogram of at most that many counts, however many documents
there are. The driver packs the histogram: large lengths are rounded up to the largest of their group (groups of equal cardinality), the
few rounded sizes are packed by configurations that column generation finds, the actual lengths take the rounded ones' places, and
what is left, small ones above all, goes to the tightest place, longest first. Sequences that hold the same lengths stay one entry,
a run, so the plan has some thousands of entries whatever the number of documents.

A document finds its place by its rank among those of its length: a count within its task plus the counts of the tasks before. No
document is moved to be packed.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.bpe import read_vocabulary
from rankweave.llm.common import SLICE_BYTES, held, stored

CAPACITY, END = 4096, 1
#: What is tried: the share of a sequence from which a length is large, the number of groups, and the share of a sequence that substitution
#: may leave free (a sequence with more room is taken apart again). The plan of fewest sequences is taken.
SHARES, GROUPS, ROOMS = (1 / 4, 1 / 8), (24, 64), (1, 1 / 64, 1 / 256, 1 / 1024)
MAX_PIVOTS = 1500

#: Texts of these code points alone are their own NFC, and lower-case letters of theirs stay among them: their words are found by WORDS.
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]")
#: The word pattern of the vocabulary file, with the letters and numbers of such texts written out.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\t\n\r a-zªµºß-öø-ſ0-9²³¹¼-¾]+")
#: Characters of a text that are tokenised at once, and words a task remembers in each of two generations.
PART, MEMO = 1 << 20, 200_000


class Encoder:
    """Ids as the tokenizers library gives them; words repeat, so those of plain texts are remembered."""

    def __init__(self, tokenizer_json: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        """The text cut before spaces into parts of about PART characters: no token, nor what Unicode composes, crosses a space."""
        out, at = [], 0
        while len(text) - at > PART:
            cut = text.find(" ", at + PART)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def part(self, text: str) -> bytes:
        if OTHER.search(text) or any(s in text for s in self.special):
            return self.ids([text])[0]
        words = WORDS.findall(text.lower())
        got = list(map(self.memo.get, words))
        if None in got:
            missing = list(dict.fromkeys(w for w, g in zip(words, got, strict=True) if g is None))
            found = {w: g for w in missing if (g := self.older.get(w)) is not None}
            new = [w for w in missing if w not in found]
            found |= zip(new, self.ids(new), strict=True)
            got = [found[w] if g is None else g for w, g in zip(words, got, strict=True)]
            if len(self.memo) + len(found) > MEMO:
                self.older, self.memo = self.memo, {}
            self.memo |= {w: g for w, g in found.items() if len(w) <= 64}
        return b"".join(got)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.part, self.parts(text))) if text else b""


@dataclass
class Run:
    """count sequences alike: from slot (length, first rank, items a sequence) each sequence has so many items of consecutive ranks."""

    count: int
    left: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def filled(self, count: int, length: int, rank: int, items: int) -> Run:
        """The first count sequences of the run, each with so many items more."""
        return Run(count, self.left - items * length, [*self.slots, (length, rank, items)])

    def without(self, count: int) -> Run:
        """The run behind its first count sequences."""
        return Run(self.count - count, self.left, [(s, rank + count * m, m) for s, rank, m in self.slots])


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, and its value."""
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        after, choice = best.copy(), np.full(capacity + 1, -1, np.int16)
        for g, s in enumerate(sizes):
            value = best[: capacity + 1 - s] + values[g]
            more = value > after[s:] + 1e-12
            after[s:][more] = value[more]
            choice[s:][more] = g
        chosen.append(choice)
        best = after
    room, items = int(best.argmax()), np.zeros(len(sizes))
    for choice in reversed(chosen):
        if (g := choice[room]) >= 0:
            items[g] += 1
            room -= sizes[g]
    return float(values @ items), items


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes and how many whole sequences of each the relaxed optimum takes (rounded down).

    Column generation: the price of a size is its dual value, a knapsack finds the configuration worth most at these prices, and it enters
    the basis while it is worth more than a sequence.
    """
    basis, demand = np.diag([capacity // s for s in sizes]).astype(float), np.array(demand, float)
    for _ in range(MAX_PIVOTS):
        value, items = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-7:
            break
        taken, weight = np.linalg.solve(basis, demand), np.linalg.solve(basis, items)
        ratio = np.where(weight > 1e-9, np.maximum(taken, 0) / np.where(weight > 1e-9, weight, 1), np.inf)
        basis[:, int(ratio.argmin())] = items
    taken = np.floor(np.linalg.solve(basis, demand) + 1e-7).astype(int)
    return [(basis[:, j].astype(int), int(n)) for j, n in enumerate(taken) if n > 0]


def substituted(items: list[list[tuple[int, int, int]]], configuration: np.ndarray, count: int, capacity: int) -> list[Run]:
    """Runs for count sequences of a configuration: actual items take the places of their groups' rounded ones, in the groups' order.

    items: what is left of each group as (length, first rank, number); what is used is taken off.
    """
    queues, breaks = {}, {0, count}
    for g in np.flatnonzero(configuration).tolist():
        each, wanted, segments, at = int(configuration[g]), int(configuration[g]) * count, [], 0
        while at < wanted:
            length, rank, n = items[g][0]
            used = min(n, wanted - at)
            segments.append((at, length, rank))
            items[g][0:1] = [(length, rank + used, n - used)] if used < n else []
            at += used
            breaks |= {at // each, -(-at // each)}
        queues[g] = (each, segments, [x[0] for x in segments])
    out, cuts = [], sorted(breaks)
    for first, last in zip(cuts, cuts[1:], strict=False):
        slots = []
        for each, segments, starts in queues.values():
            at, stop = first * each, first * each + each
            while at < stop:
                k = bisect.bisect_right(starts, at) - 1
                begin, length, rank = segments[k]
                until = min(stop, starts[k + 1] if k + 1 < len(starts) else stop)
                slots.append((length, rank + at - begin, until - at))
                at = until
        out.append(Run(last - first, capacity - sum(s * m for s, _, m in slots), slots))
    return out


def best_fit(runs: list[Run], items: list[tuple[int, int, int]], capacity: int) -> list[Run]:
    """The runs with all items (length, first rank, number) added, longest first, each where least room is left; new sequences where none fits.

    The tightest sequence stays the tightest after an item went in, so it takes as many as fit, and all of a run that are alike do.
    """
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(run: Run) -> None:
        if run.left not in by_room:
            by_room[run.left] = []
            bisect.insort(rooms, run.left)
        by_room[run.left].append(run)

    for run in runs:
        put(run)
    for length, rank, n in sorted(items, reverse=True):
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                run = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                run = Run(-(-n // (capacity // length)), capacity)
            each = run.left // length
            whole = min(run.count, n // each)
            used, each = (whole, each) if whole else (1, n)
            put(run.filled(used, length, rank, each))
            if used < run.count:
                put(run.without(used))
            rank, n = rank + used * each, n - used * each
    return [run for own in by_room.values() for run in own]


def packed_histogram(histogram: dict[int, int], capacity: int, share: float, groups: int, rooms: tuple[float, ...] = ROOMS) -> list[Run]:
    """Runs that hold every item of the histogram (length to number) once, by linear grouping with at most so many groups."""
    large = [(s, n) for s, n in sorted(histogram.items(), reverse=True) if n and capacity * share < s < capacity]
    runs = [Run(histogram[capacity], 0, [(capacity, 0, 1)])] if histogram.get(capacity) else []
    rest = [(s, 0, n) for s, n in histogram.items() if n and s <= capacity * share]
    total = sum(n for _, n in large)
    if total:
        size, grouped, room = -(-total // groups), [[]], -(-total // groups)
        for s, n in large:
            rank = 0
            while n:
                used = min(n, room)
                grouped[-1].append((s, rank, used))
                rank, n, room = rank + used, n - used, room - used
                if not room:
                    grouped.append([])
                    room = size
        rounded: dict[int, list] = {}
        for own in filter(None, grouped):  # groups that round to one size are one
            rounded.setdefault(own[0][0], []).extend(own)
        left = list(rounded.values())
        for configuration, count in configurations(list(rounded), [sum(n for _, _, n in own) for own in left], capacity):
            runs += substituted(left, configuration, count, capacity)
        rest += [x for own in left for x in own]
    tried = []
    for room in rooms if total else rooms[:1]:
        apart = [(s, rank, m * run.count) for run in runs if run.left > capacity * room for s, rank, m in run.slots]
        tried.append(best_fit([run for run in runs if run.left <= capacity * room], rest + apart, capacity))
    return min(tried, key=number_of)


def number_of(runs: list[Run]) -> int:
    return sum(run.count for run in runs)


@dataclass
class Plan:
    """Where the items of each length go: from slot k on, whose ranks start at rank, each sequences' worth of items lie at offset."""

    sequences: int
    key: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the items of the given lengths and ranks among their length."""
        k = np.searchsorted(self.key, (length.astype(np.int64) << 45) + rank, side="right") - 1
        nth = rank - self.rank[k]
        return self.first[k] + nth // self.each[k], self.offset[k] + nth % self.each[k] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of fewest sequences that linear grouping finds with the shares and group counts tried."""
    least, runs = -(-sum(s * n for s, n in histogram.items()) // capacity), None
    for share in SHARES:
        for groups in GROUPS:
            if runs is None or number_of(runs) > least:
                made = packed_histogram(histogram, capacity, share, groups)
                runs = made if runs is None else min(runs, made, key=number_of)
    rows, first = [], 0
    for run in runs:
        offset = 0
        for length, rank, each in run.slots:
            rows.append((length, rank, each, first, offset))
            offset += length * each
        first += run.count
    made = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(first, (made[:, 0] << 45) + made[:, 1], *(made[:, k].copy() for k in (1, 2, 3, 4)))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end: int, keep_ids: bool) -> DataFrame:
    """A row for each piece: the id, piece, start, length, ids_crc32, ids if they are kept, the task and the rank among the task's pieces of that length."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    source = docs.select(id_col, text_col)
    numbers = [T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "_task", "_rank")]
    schema = T.StructType([source.schema[id_col], *numbers, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def run(batches):
        encoder = held(("packing", hash(shared.value)), lambda: Encoder(shared.value))
        task, seen, last = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist(), np.array([end], "<u4").tobytes()
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, step):
                batch, owner, rows, kept = whole.slice(at, step), [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    data = encoder.encode(text or "") + last
                    for k, begin in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[begin : begin + 4 * capacity]
                        length = len(own) // 4
                        owner.append(i)
                        rows.append((k, begin // 4, length, zlib.crc32(own), task, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            kept.append(own)
                made = np.array(rows, np.int64).reshape(-1, 6)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(made[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(made[:, k])) for k in range(1, 6))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_ids else []), names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """A row for each piece of each row of docs: its id, piece (from 0), start (ids of its document before it), length, ids_crc32, sequence_id,
    offset (its place in that sequence, gapless from 0) and, if kept, ids (binary, little-endian unsigned 32-bit).

    A document is its ids and the id end; only longer ones than capacity are cut, into pieces of capacity and a rest. A null text is
    empty, so the end alone. Rows that repeat are packed each; a null id stays; extra columns are left out; an empty table gives no
    rows. Which of the pieces of one length lie together is arbitrary. Reads docs once, when called, and runs the packing of the histogram.
    """
    made = stored(pieces(docs, tokenizer_path, id_col, text_col, capacity, end, keep_ids), "pieces")
    counts = stored(made.groupBy("_task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = made.join(counts.select("_task", "length", before.alias("_before")), ["_task", "length"])
    keep = [c for c in made.columns if not c.startswith("_")]
    ranked = ranked.select(*keep, (F.col("_before") + F.col("_rank")).alias("_rank"))
    schema = T.StructType([*(made.schema[c] for c in keep), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches):
        for batch in batches:
            sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(placed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): each sequence's ids as they are trained on, and where its pieces start, so that attention can stop there.

    packed: what ``pack`` gives with its ids. A sequence has at most its capacity of ids and as many pieces, so a group is bounded.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("rows"), F.lit(b""), lambda done, r: F.concat(done, r["ids"]))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", joined.alias("ids"), F.transform("rows", lambda r: r["offset"]).alias("starts"))
