"""Token counts by a compiled finite-state tokenizer.

The vocabulary is compiled into a deterministic transducer over bytes whose
transitions carry the number of tokens they emit. BPE's tokens for a prefix of a
word end in exactly one token that may follow its predecessor, so a state needs
no more than: the longest suffix that can still grow into a token, and for each
cut inside it the token that ends there and how many tokens came before. States
are compiled when first reached (as lazily built automata are) and dropped when
the table is full.

Text runs through the transducer in chunks side by side. A chunk's state map is a
constant (exit state, count) from its first word end on, and before that, in its
head, a table from entry state to exit state and count. Of the table only the
entries that a scan asks for are computed, all chunks' entries at once: the maps
known so far compose along the text, each chunk's exit being the next one's entry,
and entries that are still missing are run side by side until none is. States
forget what came long before, so a few rounds do, also for a word of a megabyte.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from auditgrid.llm import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of a chunk; state maps of chunks compose.
CHUNK = 256
#: Characters that run through the transducer at once.
AT_ONCE = 4_000_000
#: States at which the compiled table is dropped, but for the states that lanes are in.
MAX_STATES = 200_000
#: The words that a contraction can have after its apostrophe: fixed values of the vocabulary's split pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Of every code point: space, letter, number or other, as the library's own regular expressions class them."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    for pattern, kind in ((r"\s+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[a] : points[b - 1] + 1] = kind
    return out


class Transducer:
    """Lazily compiled; symbols 0-255 are bytes inside a word, 256-511 a word's last byte."""

    def __init__(self, path: str, max_states: int = MAX_STATES) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {s: b for b, s in enumerate(byte_symbols())}

        def symbols(token: str) -> str:
            """Symbols as characters: their slices are cheap and so are their hashes."""
            end = token.endswith("</w>") and len(token) > 4
            body = [of[c] for c in (token[:-4] if end else token)]
            return "".join(map(chr, [*body[:-1], body[-1] + 256] if end else body))

        self.tokens: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.tokens[symbols(token)] = i
        self.ranks: dict[tuple[int, int], int] = {}
        #: Of each merged token: its merge's rank, and the two tokens that it joins.
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = symbols(a), symbols(b)
            self.ranks[self.tokens[a], self.tokens[b]] = r
            self.made.setdefault(self.tokens[a + b], (r, self.tokens[a], self.tokens[b]))
        self.prefixes = {s[:k] for s in self.tokens for k in range(1, len(s))}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.emitted: dict[tuple[int, ...], int] = {(): 0}
        self.sizes = np.zeros(1024, np.int64)
        self.laid: tuple = (0, None, None)
        self.max_states = max_states
        self.reset()

    def reset(self) -> None:
        # A state: (suffix that may still grow, for each cut before and in it the last token and those not emitted yet).
        self.ids: dict[tuple, int] = {("", ((-1, ()),)): 0}
        self.states: list[tuple] = [*self.ids]
        # Columns belong to symbols in the order in which they are first met.
        self.column = np.full(512, -1, np.int16)
        self.met = 0
        self.step = np.full((1024, 32), -1, np.int32)
        self.emits = np.zeros((1024, 32), np.int32)
        self.counts = np.zeros((1024, 32), np.int8)

    def _grow(self, axis: int) -> None:
        more = [0, 0]
        more[axis] = len(self.step) // 2 if axis == 0 else 32
        pad = [(0, more[0]), (0, more[1])]
        self.step = np.pad(self.step, pad, constant_values=-1)
        self.emits = np.pad(self.emits, pad)
        self.counts = np.pad(self.counts, pad)

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """The table's column of each symbol."""
        for s in np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0)).tolist():
            if self.met == self.step.shape[1]:
                self._grow(1)
            self.column[s] = self.met
            self.met += 1
        return self.column[symbols]

    def flush(self, live: np.ndarray) -> np.ndarray:
        """Forget all states but those in ``live``; their new numbers."""
        old, place = np.unique(live, return_inverse=True)
        keys = [self.states[i] for i in old.tolist()]
        column, met, width = self.column, self.met, self.step.shape[1]
        self.reset()
        self.column, self.met = column, met
        self.step, self.emits, self.counts = np.full((1024, width), -1, np.int32), np.zeros((1024, width), np.int32), np.zeros((1024, width), np.int8)
        return np.array([self.intern(k) for k in keys], np.int64)[place]

    def intern(self, key: tuple) -> int:
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.step):
                self._grow(0)
        return to

    def may_follow(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their bytes are tokenized together.

        The merges inside both are undone, latest first; they stay apart unless, at some stage, the two
        that face each other would be joined before the merges undone so far are made.
        """
        key, limit, free = (a, b), len(self.ranks), (-1, 0, 0)
        known = self.follows.get(key)
        if known is not None:
            return known
        while True:
            if self.ranks.get((a, b), limit) < limit:
                known = False
                break
            left, right = self.made.get(a, free), self.made.get(b, free)
            if left[0] < 0 and right[0] < 0:
                known = True
                break
            if left[0] > right[0]:
                limit, a = left[0], left[2]
            else:
                limit, b = right[0] + 1, right[1]
        if len(self.follows) > 500_000:
            self.follows.clear()
        self.follows[key] = known
        return known

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes are tokenized as it."""
        known = self.whole.get(token)
        if known is None:
            parts = self.made.get(token)
            known = self.whole[token] = parts is None or (self.alone(parts[1]) and self.alone(parts[2]))
        return known

    def compile(self, state: int, symbol: int) -> None:
        suffix, cuts = self.states[state]
        grown = suffix + chr(symbol)
        for k, (before, _) in enumerate(cuts):  # longest token first
            token = self.tokens.get(grown[k:])
            if token is not None and (self.may_follow(before, token) if before >= 0 else self.alone(token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        whole = (*cuts[k][1], token)
        column = self.column[symbol]
        if symbol >= 256:
            self.step[state, column], self.emits[state, column], self.counts[state, column] = 0, self.emission(whole), len(whole)
            return
        keep = next((k for k in range(len(grown)) if grown[k:] in self.prefixes), len(grown))
        ends = [*cuts, (token, whole)][keep:]
        # Tokens that every cut agrees on are emitted now.
        n = len(whole)
        if len(ends) > 1:
            least, most = min(e[1] for e in ends), max(e[1] for e in ends)
            n = next((i for i, (x, y) in enumerate(zip(least, most, strict=False)) if x != y), min(len(least), len(most)))
        to = self.intern((grown[keep:], tuple((t, c[n:]) for t, c in ends)))
        self.step[state, column], self.emits[state, column], self.counts[state, column] = to, self.emission(whole[:n]), n

    def emissions(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all emissions behind one another, and where each emission begins."""
        if self.laid[0] != len(self.emitted):
            flat = np.fromiter((t for e in self.emitted for t in e), np.uint32)
            starts = np.concatenate(([0], np.cumsum(self.sizes[: len(self.emitted)])))[:-1]
            self.laid = (len(self.emitted), flat, starts)
        return self.laid[1:]

    def emission(self, tokens: tuple[int, ...]) -> int:
        """The number of a sequence of tokens that transitions emit."""
        i = self.emitted.get(tokens)
        if i is None:
            i = self.emitted[tokens] = len(self.emitted)
            if i == len(self.sizes):
                self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.sizes[i] = len(tokens)
        return i

    def run(self, lanes: np.ndarray, lengths: np.ndarray, entry: np.ndarray, symbols: np.ndarray, columns: np.ndarray, trace: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of each lane: ``lengths`` symbols from place ``lanes`` on, from state ``entry``.

        trace, if given, gets the number of what each symbol's transition emits.
        """
        order = np.argsort(-lengths, kind="stable")
        state, count = entry[order].astype(np.int64), np.zeros(len(lanes), np.int64)
        at, sizes = lanes[order].copy(), lengths[order]
        step, counts, emits, width = self.step.ravel(), self.counts.ravel(), self.emits.ravel(), self.step.shape[1]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
        for n in live.tolist():
            if len(self.states) > self.max_states:
                state = self.flush(state)
                step, counts, emits = self.step.ravel(), self.counts.ravel(), self.emits.ravel()
            here = at[:n]
            cell = state[:n] * width + columns.take(here)
            to = step.take(cell)
            if to.min() < 0:
                new = np.flatnonzero(to < 0)
                for s, c in np.unique(np.stack((state[new], symbols[here[new]])), axis=1).T.tolist():
                    self.compile(s, c)
                step, counts, emits = self.step.ravel(), self.counts.ravel(), self.emits.ravel()
                to = step.take(cell)
            if trace is None:
                count[:n] += counts.take(cell)
            else:
                trace[here] = emits.take(cell)
            state[:n] = to
            here += 1
        exits, totals = np.empty_like(state), np.empty_like(count)
        exits[order], totals[order] = state, count
        return exits, totals


def word_symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's words as symbols, and each symbol's character: spaces go, a word's last byte is marked."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = char_classes()[points]
    n = len(points)
    # A word begins where the class changes; a number is a word itself.
    begins = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)))[:n]
    for at in np.flatnonzero((points == 39) & begins & (kind == _OTHER)).tolist():
        if at + 1 < n and kind[at + 1] == _LETTER:
            rest = text[at + 1 : at + 3]
            if tail := next((c for c in CONTRACTIONS if rest.startswith(c)), None):
                begins[at + 1] = False
                if at + 1 + len(tail) < n:
                    begins[at + 1 + len(tail)] = True
    last = np.concatenate((begins[1:], [True]))[:n]
    stays = kind != _SPACE
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    ends = np.cumsum(width) - 1
    raw[ends[last & stays]] += 256
    owner = np.repeat(np.arange(n), width)
    keep = stays[owner]
    return raw[keep], owner[keep]


def normalised(text: str, machine: Transducer) -> str:
    """NFC and lower case, letter by letter; the library's own normaliser where Unicode versions could differ."""
    if text.isascii():
        return text.lower()
    if max(text) > "\u0370":
        return machine.normalizer.normalize_str(text)
    return unicodedata.normalize("NFC", text).lower()


def _chunks(first: np.ndarray, size: np.ndarray, symbols: np.ndarray, chunk: int) -> tuple[np.ndarray, ...]:
    """Chunks of the parts: part, whether it is the part's first, start, length, and symbols up to the first word end."""
    per = -(-size // chunk)
    home = np.repeat(np.arange(len(first)), per)
    nth = np.arange(len(home)) - np.repeat(np.cumsum(per) - per, per)
    start = first[home] + nth * chunk
    length = np.minimum(chunk, first[home] + size[home] - start)
    ends = np.flatnonzero(symbols >= 256)
    head = np.minimum(ends[np.minimum(np.searchsorted(ends, start), len(ends) - 1)] + 1 - start, length)
    head[nth == 0] = 0  # a text begins in the start state
    return home, nth == 0, start, length, head


def _head_counts(machine: Transducer, heads: np.ndarray, start: np.ndarray, head: np.ndarray, length: np.ndarray, exits: np.ndarray, symbols: np.ndarray, columns: np.ndarray, trace: np.ndarray | None) -> np.ndarray:
    """Tokens of the heads of the chunks ``heads``, by a scan over their state maps.

    exits: the exit state of each chunk that isn't all head. States stand as keys, since numbers change when the table is dropped.
    """
    after = {int(i): machine.states[exits[i - 1]] for i in heads.tolist() if head[i - 1] < length[i - 1]}
    maps: list[dict[tuple, tuple[tuple, int]]] = [{} for _ in heads]
    entries: list[tuple] = [machine.states[0]] * len(heads)
    # At first each chunk inside a long word is guessed to begin like a word.
    asked = [(k, after.get(i, machine.states[0])) for k, i in enumerate(heads.tolist())]

    def run(asked: list[tuple[int, tuple]], trace: np.ndarray | None) -> None:
        lanes = heads[[k for k, _ in asked]]
        ends, counts = machine.run(start[lanes], head[lanes].astype(np.int64), np.array([machine.intern(e) for _, e in asked]), symbols, columns, trace)
        for (k, e), end, n in zip(asked, ends.tolist(), counts.tolist(), strict=True):
            maps[k][e] = (machine.states[end], n)

    while asked:
        run(asked, None)
        asked, last = [], machine.states[0]
        for k, i in enumerate(heads.tolist()):
            entries[k] = after.get(i, last)
            if (known := maps[k].get(entries[k])) is None:
                asked.append((k, entries[k]))
                known = next(reversed(maps[k].values()))  # a guess at the exit, for the chunks behind
            last = known[0]
    counts = np.array([maps[k][e][1] for k, e in enumerate(entries)], np.int64)
    if trace is not None:
        run(list(enumerate(entries)), trace)
    return counts


def transduce(parts: list[str], machine: Transducer, chunk: int, ids: bool) -> list:
    """Of each normalised part its number of tokens or, with ``ids``, their ids."""
    symbols, at = word_symbols("\n".join(parts))  # a blank keeps neighbours apart
    bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    cuts = np.searchsorted(at, bounds)
    if not len(symbols):
        return [np.zeros(0, np.uint32) if ids else 0 for _ in parts]
    # Chunks never cross a part, so their counts add up by part.
    home, leads, start, length, head = _chunks(cuts[:-1], np.diff(cuts), symbols, chunk)
    columns, trace = machine.columns(symbols), np.zeros(len(symbols), np.int32) if ids else None
    exits, counts = machine.run(start + head, length - head, np.zeros(len(start), np.int64), symbols, columns, trace)
    totals = np.bincount(home, counts, len(parts)).astype(np.int64)
    heads = np.flatnonzero(head > 0)
    if len(heads):
        totals += np.bincount(home[heads], _head_counts(machine, heads, start, head, length, exits, symbols, columns, trace), len(parts)).astype(np.int64)
    if not ids:
        return totals.tolist()
    flat, starts = machine.emissions()
    emitted = machine.sizes[trace]
    ends = np.concatenate(([0], np.cumsum(emitted)))
    some = np.flatnonzero(emitted)
    sizes = emitted[some]
    out = flat[np.repeat(starts[trace[some]] - ends[some], sizes) + np.arange(ends[-1])]
    return [out[a:b] for a, b in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True)]


def _split_special(texts: list[str], machine: Transducer) -> tuple[list[str], list[tuple[int, int | None]]]:
    """Normalised parts, and of each its text and the special token after it (if any)."""
    parts, owners = [], []
    for i, text in enumerate(texts):
        pieces: list[str | int] = [text]
        for s, number in machine.special.items():
            if s in text:
                pieces = [y for x in pieces for y in (_between(x.split(s), number) if isinstance(x, str) else [x])]
        for k in range(0, len(pieces), 2):
            parts.append(normalised(pieces[k], machine))
            owners.append((i, pieces[k + 1] if k + 1 < len(pieces) else None))
    return parts, owners


def _between(cut: list[str], number: int) -> list[str | int]:
    return [x for piece in cut for x in (piece, number)][:-1]


def count_tokens(texts: list[str], machine: Transducer, chunk: int = CHUNK) -> list[int]:
    """Tokens of each text; special tokens' own strings count as one each."""
    parts, owners = _split_special(texts, machine)
    counts = [0] * len(texts)
    for (i, special), n in zip(owners, transduce(parts, machine, chunk, False), strict=True):
        counts[i] += n + (special is not None)
    return counts


def encode(texts: list[str], machine: Transducer, chunk: int = CHUNK) -> list[np.ndarray]:
    """Ids of each text."""
    parts, owners = _split_special(texts, machine)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for (i, special), part in zip(owners, transduce(parts, machine, chunk, True), strict=True):
        found[i].append(part)
        if special is not None:
            found[i].append(np.array([special], np.uint32))
    return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


def machine_at(path: str) -> Transducer:
    """The compiled transducer of this Python worker."""
    return common.worker_state(("transducer", path), lambda: Transducer(path))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``, one row per input row, repeated ones too; null and empty texts have none.

    A null id stays null; only the two columns named are read; an empty table gives an empty result. No shuffle. A worker holds one batch, ``AT_ONCE`` characters' arrays (more only for one longer text)
    and a table of at most about ``MAX_STATES`` states.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_at(path)
        for batch in batches:
            sizes, counts, waiting, held = [], [], [], 0
            for text in common.texts_of(batch.column(1), as_bytes=False):
                text = text or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                waiting.append(text)
                held += len(text)
                if held > AT_ONCE:
                    counts += count_tokens(waiting, machine, chunk)
                    waiting, held = [], 0
            counts += count_tokens(waiting, machine, chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=SCHEMA)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op4_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every row of ``documents``; cases are defined by ``token_counts``."""
    return token_counts(common.documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
