"""Best-fit packing by bin completion with branch and bound.

How many pieces there are of each length is all that packing depends on, and
there are at most ``capacity`` lengths, however many documents there are. The
plan is made on that bounded histogram. Each step completes the bin of the largest
piece left: fillings are enumerated best fit first, those that another filling
dominates are left out, and a filling is used as often as the counts allow.
Packing by best-fit decreasing is the first incumbent. A branch ends where its
waste so far, and the bins that what is left needs at least, can't beat the
incumbent; the search ends when the incumbent meets the lower bound, and the plan
says whether it did. A plan has a few thousand rows at most.
Pieces then find their place by their rank within their length: each task numbers
its own pieces, so no length, however common, is sorted in one task.
"""

from __future__ import annotations

import logging
import os
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditgrid.llm import common

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
#: Steps of the search over all bins beyond the first descent; None searches to the end.
NODES = 50_000
#: Steps of the depth-first search for one filling, before a table of sums finds it.
FILLING_NODES = 4_000
#: Bytes of space-separated chunks and their ids that a worker keeps, about.
CACHE_BYTES = 128_000_000

Filling = dict[int, int]
log = logging.getLogger(__name__)


def lower_bound(left: Filling, capacity: int) -> int:
    """Bins that the pieces need at least: large ones don't share a bin, and what can't go beside them needs room of its own."""
    if not left:
        return 0
    sizes = np.array(sorted(left), np.int64)
    counts = np.array([left[x] for x in sizes.tolist()], np.int64)
    half = sizes > capacity // 2
    above, below = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    np.add.at(above, sizes[half], counts[half])
    np.add.at(below, sizes[~half], counts[~half] * sizes[~half])
    k = np.arange(capacity // 2 + 1)
    # For each k: pieces over the half need a bin each, and pieces of k up to the half fit only beside those of capacity - k at most.
    gaps = np.cumsum((above * (capacity - np.arange(capacity + 2)))[::-1])[::-1]
    rest = np.cumsum(below[::-1])[::-1][k] - (gaps[capacity // 2 + 1] - gaps[capacity - k + 1])
    return int(max(above.sum() + np.maximum(0, -(-rest // capacity)).max(), -(-int((sizes * counts).sum()) // capacity)))


def _by_sums(room: int, lengths: list[int], left: Filling) -> Filling:
    """The fullest filling, by a table of the sums that can be reached: exact, whatever the counts."""
    mask = (1 << room + 1) - 1
    reached = [1]
    for x in lengths:
        if x > room:
            break
        bits, n, k = reached[-1], min(left[x], room // x), 1
        while n:  # 1, 2, 4 ... pieces at once
            k = min(k, n)
            bits |= bits << x * k & mask
            n -= k
            k *= 2
        reached.append(bits)
    at, out = reached[-1].bit_length() - 1, Counter()
    for i in range(len(reached) - 1, 0, -1):
        x = lengths[i - 1]
        while not reached[i - 1] >> at & 1:  # not without one more of x
            out[x] += 1
            at -= x
    return dict(out)


def best_filling(room: int, lengths: list[int], left: Filling, nodes: int = FILLING_NODES) -> Filling:
    """How often to take each length so that ``room`` is filled with the least waste.

    ``lengths`` is ascending. Depth first, largest and most first, so a filling is reached before those
    it dominates (the same with a piece swapped for a smaller one). A branch ends where even all
    smaller pieces together leave as much as the incumbent; no waste ends the search. Where that
    takes more than ``nodes`` steps, a table of sums gives the answer.
    """
    best: Filling = {}
    waste, budget = room, nodes
    path: list[tuple[int, int]] = []
    below = [0]  # total length of all smaller pieces, up to the room
    for x in lengths:
        if below[-1] >= room:
            break
        below.append(below[-1] + x * left[x])
    below += [below[-1]] * (len(lengths) + 1 - len(below))

    def go(room: int, hi: int) -> bool:
        nonlocal best, waste, budget
        if room < waste:
            best, waste = dict(path), room
            if room == 0:
                return True
        i = min(bisect_right(lengths, room), hi) - 1
        while i >= 0 and room - below[i + 1] < waste:
            x = lengths[i]
            for k in range(min(left[x], room // x), 0, -1):
                budget -= 1
                if budget < 0:
                    return True
                path.append((x, k))
                ended = go(room - k * x, i)
                path.pop()
                if ended:
                    return True
            i -= 1
        return False

    go(room, len(lengths))
    return _by_sums(room, lengths, left) if budget < 0 else best


class SearchEnded(Exception):
    """The search has taken as many steps as it may."""


class Budget:
    def __init__(self, steps: int | None) -> None:
        self.steps = steps

    def spend(self) -> None:
        if self.steps is not None:
            if self.steps <= 0:
                raise SearchEnded
            self.steps -= 1


def dominated(filling: Filling, waste: int, left: Filling, lengths: list[int]) -> bool:
    """Whether a piece that is left fits beside the filling's pieces, or in place of some that are shorter together."""
    sums = {0: 0}  # sum of a choice of pieces: their number, two at most counted
    for x, n in filling.items():
        for _ in range(n):
            for s, k in list(sums.items()):
                sums[s + x] = max(sums.get(s + x, 0), min(2, k + 1))
    for s, k in sums.items():
        for i in range(bisect_right(lengths, s + waste) - 1, -1, -1):
            x = lengths[i]
            if x < s or (x == s and k == 1):
                break
            if left[x] > filling.get(x, 0):
                return True
    return False


def fillings(room: int, lengths: list[int], left: Filling, most_waste: int, budget: Budget) -> Iterator[Filling]:
    """Undominated fillings that waste ``most_waste`` at most: the best fit first, then depth first."""
    first = best_filling(room, lengths, left)
    if room - sum(x * n for x, n in first.items()) > most_waste:
        return
    yield first
    below = [0]
    for x in lengths:
        below.append(min(room, below[-1] + x * left[x]))
    path: list[tuple[int, int]] = []

    def go(room: int, hi: int) -> Iterator[Filling]:
        budget.spend()
        i = min(bisect_right(lengths, room), hi) - 1
        if room <= most_waste:
            found = dict(path)
            if found != first and not dominated(found, room, left, lengths):
                yield found
        while i >= 0 and room - below[i + 1] <= most_waste:
            x = lengths[i]
            for k in range(min(left[x], room // x), 0, -1):
                path.append((x, k))
                yield from go(room - k * x, i)
                path.pop()
            i -= 1

    yield from go(room, len(lengths))


@dataclass(frozen=True)
class Plan:
    """patterns: how many pieces of each length a sequence has, and how many such sequences there are.

    bound: sequences that any packing needs. searched: the search went to its end, so fewer sequences than these don't do.
    """

    patterns: list[tuple[Filling, int]]
    sequences: int
    bound: int
    searched: bool


def best_fit_decreasing(histogram: Filling, capacity: int) -> list[tuple[Filling, int]]:
    """Longest first, each piece into the fullest bin with room; bins with the same content are one row, three for each length at most."""
    bins: dict[int, list[tuple[Filling, int]]] = {}  # by room left: contents and their number
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if n:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((filling, n))

    for x in sorted(histogram, reverse=True):
        todo = histogram[x]
        while todo:
            at = bisect_right(rooms, x - 1)
            room = rooms[at] if at < len(rooms) else capacity
            each = min(todo, room // x)
            if at < len(rooms):
                filling, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                filling, n = {}, todo // each
            times = min(n, todo // each)
            put(room, filling, n - times)
            put(room - each * x, filling | {x: each}, times)
            todo -= each * times
    return [x for each in bins.values() for x in each]


def plan(histogram: Filling, capacity: int = CAPACITY, nodes: int | None = NODES) -> Plan:
    """Sequences for all pieces. ``nodes``: steps of the search; None: to its end, in time that has no bound."""
    left = {k: v for k, v in histogram.items() if v > 0}
    bound = lower_bound(left, capacity)
    best = best_fit_decreasing(left, capacity)
    fewest = sum(n for _, n in best)
    lengths = sorted(left)
    path: list[tuple[Filling, int]] = []
    used, budget = 0, Budget(nodes)

    def move(filling: Filling, times: int) -> None:
        """Take the filling so often; or give it back, where times is negative."""
        nonlocal used
        used += times
        for x, n in filling.items():
            if not left[x]:
                insort(lengths, x)
            left[x] -= n * times
            if not left[x]:
                lengths.remove(x)

    def choices() -> Iterator[tuple[Filling, int]]:
        """Ways to complete the bin of the longest piece left, and how many such bins there are."""
        top = lengths[-1]
        allowed = (fewest - 1 - used) * capacity - sum(x * left[x] for x in lengths)  # waste of a better packing
        if allowed < 0:
            return
        left[top] -= 1
        found = fillings(capacity - top, [x for x in lengths if left[x]], left, allowed, budget)
        while (filling := next(found, None)) is not None:
            left[top] += 1
            filling = {top: filling.get(top, 0) + 1} | {x: n for x, n in filling.items() if x != top}
            for times in range(min(left[x] // n for x, n in filling.items()), 0, -1):
                yield filling, times
            left[top] -= 1
        left[top] += 1

    searched = True
    stack = [choices()] if fewest > bound else []
    try:
        while stack:
            budget.spend()
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    filling, times = path.pop()
                    move(filling, -times)
                continue
            move(*step)
            path.append(step)
            if not lengths and used < fewest:
                best, fewest = list(path), used
                if fewest <= bound:
                    break
            if lengths and used + lower_bound({x: left[x] for x in lengths}, capacity) < fewest:
                stack.append(choices())
            else:
                path.pop()
                move(step[0], -step[1])
    except SearchEnded:
        searched = False
    return Plan(best, fewest, bound, searched)


#: A chunk of Latin letters with signs behind them: two words to the vocabulary's split pattern.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


#: Bytes that an entry of a worker's memory takes besides its characters and ids.
_ENTRY = 200


class ChunkIds:
    """Ids of texts by the tokenizers library, with the ids of space-separated chunks kept.

    The vocabulary drops white space and never joins characters across it, so chunks are tokenized alone.
    It also ignores case and parts letters from signs; so new chunks are split further, and their letters
    are tokenized many words at once: a word's last token is one that the vocabulary marks as an end.
    """

    def __init__(self, path: str, keep_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.size, self.keep_bytes = 0, keep_bytes

    def _each(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 2048):
            some = chunks[i : i + 2048]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        """Words of letters only, behind one another."""
        for i in range(0, len(words), 2048):
            some = words[i : i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) != len(some):  # a vocabulary that marks ends in another way
                self._each(some)
                continue
            raw = ids.tobytes()
            self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def _learn(self, new: set[str]) -> None:
        known = self.known
        plain, words, rest = [], set(), set()
        for w in new:
            if w.isascii() and w.isalpha():
                letters, signs = w.lower(), ""
            elif m := _PLAIN.fullmatch(w):
                letters, signs = m[1].lower(), m[2]
                if signs not in known:
                    rest.add(signs)
            else:
                rest.add(w)
                continue
            if letters not in known:
                words.add(letters)
            if w != letters:
                plain.append((w, letters, signs))
        self._letters(list(words))
        self._each(list(rest))
        known.update([(w, known[letters] + known[signs]) for w, letters, signs in plain])

    def _simplified(self, text: str) -> str:
        """Blanks for line feeds, and lower case where that is the same to the vocabulary: in Latin-1 texts that can't hold a special token."""
        text = text.replace("\n", " ")
        if "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self._simplified(t).split(" ") for t in texts]
        if 2 * self.size > self.keep_bytes:  # the chunks of the last half stay at hand
            self.old, self.known, self.size = self.known, {"": b""}, 0
        known, old = self.known, self.old
        new = set().union(*parts).difference(known)
        met = new & old.keys()
        known.update([(w, old[w]) for w in met])
        self._learn(new - met)
        self.size += sum(_ENTRY + len(w) + len(known[w]) for w in new)
        return [b"".join(map(known.__getitem__, p)) for p in parts]


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
WIDTH = pa.schema([(c, pa.int64()) for c in ("length", "width")])
PLAN = pa.schema([(c, pa.int64()) for c in ("of", "slot", "lo", "hi", "base", "each", "at")])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_bytes: int = CACHE_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece; a document is its ids and ``end_id``, cut only where longer than ``capacity``.

    part and nth: the task, and the piece's number (from 0) among the task's pieces of its length.
    """
    tail = np.array([end_id], "<u4").tobytes()
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.worker_state(("packing", path, keep_bytes), lambda: ChunkIds(path, keep_bytes))
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i in range(0, len(docs), 512):
                texts = [t or "" for t in batch.column(1).slice(i, 512).to_pylist()]
                out: list[tuple] = []
                ids: list[bytes] = []
                for doc, raw in zip(docs[i : i + 512], encoder.encode(texts), strict=True):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[at : at + 4 * capacity]
                        n = len(piece) // 4
                        out.append((doc, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                        seen[n] += 1
                        ids.append(piece)
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECE, strict=True)]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            del batch  # else it stays while the next one is read

    return docs.mapInArrow(run, PIECE_DDL + ", ids array<int>" * with_ids)


def _plan_rows(patterns: list[tuple[Filling, int]], histogram: Filling) -> tuple[list[tuple], list[tuple]]:
    """For each length of each pattern the ranks [lo, hi) that it takes, in slots of ranks; and the width of each length's slots."""
    taken: Counter = Counter()
    rows, base = [], 0
    for pattern, times in patterns:
        at = 0
        for x, each in pattern.items():
            rows.append((x, taken[x], taken[x] + each * times, base, each, at))
            taken[x] += each * times
            at += x * each
        base += times
    uses = Counter(r[0] for r in rows)
    widths = {x: -(-n // max(uses[x], 1)) for x, n in histogram.items()}
    # A rank meets the plan's rows of its slot alone: about two, also where a frequent length is in every pattern.
    return [(x, slot, lo, hi, *rest) for x, lo, hi, *rest in rows for slot in range(lo // widths[x], (hi - 1) // widths[x] + 1)], list(widths.items())


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, nodes: int | None = NODES, keep_bytes: int = CACHE_BYTES, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece; ``with_ids`` adds the piece's ids.

    Null and empty texts are packed as their end token alone. Rows that repeat, or share an id, are
    packed each; a null id stays null; long texts are cut; only the two columns named are read. An empty table gives an
    empty result. keep_bytes: what a worker remembers of chunks until all pieces are cut; less costs time and nothing else.
    The number of sequences, and the number that any packing needs, are logged.
    """
    spark = docs.sparkSession
    tables = common.Tables(spark, "packing")
    cut = tables.write(pieces(common.id_and_text(docs, id_col, text_col), path or public_tokenizers.path(VOCABULARY), capacity, end_id, keep_bytes, with_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    # Nothing tokenizes any more: what the workers remember goes before the pieces are joined.
    histogram = {r["length"]: r["n"] for r in common.released(cut.select("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(histogram, capacity, nodes)
    log.info("%d sequences for %d pieces; any packing needs %d; searched to the end: %s", made.sequences, sum(histogram.values()), made.bound, made.searched)
    rows, widths = _plan_rows(made.patterns, histogram)
    # Neither grows with the input: a row for each length, and one or two for each length of each filling.
    width = F.broadcast(common.small_table(spark, widths, WIDTH))
    plan_rows = F.broadcast(common.small_table(spark, rows, PLAN))
    before = tables.write(before.join(width, "length").select("length", "part", "before", "width"), "before")
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    placed = ranked.join(plan_rows, (F.col("length") == F.col("of")) & (F.floor(F.col("rank") / F.col("width")) == F.col("slot")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    index = F.col("rank") - F.col("lo")
    sequence = (F.col("base") + F.floor(index / F.col("each"))).cast("long").alias("sequence_id")
    offset = (F.col("at") + (index % F.col("each")) * F.col("length")).cast("long").alias("offset")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, offset, *["ids"] * with_ids)


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every row of ``documents``; cases are defined by ``pack``."""
    return pack(common.documents(spark, sf_dir))
