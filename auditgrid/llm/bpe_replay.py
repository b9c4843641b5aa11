"""Byte-level BPE by merge replay over the words of many texts at once.

The distinct words of a batch lie behind one another in one array. An inverted
index gives, for each merge, the positions of the pairs that it joins; merges are
applied to all words at once in rank order, and each merge looks only at the
neighbours of the pairs it has joined. Words that a worker has met before are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from auditgrid.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids a worker keeps.
CACHE = 400_000
#: Code points of text whose words are replayed together.
AT_ONCE = 8_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, keep: int = CACHE) -> None:
        ranks = load_ranks(path)
        self.spelled = {i: b for b, i in ranks.items()}
        self.width = max(self.spelled) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that together spell a token, by (left, right).
        pairs = {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.keep = keep

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or -1."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # A gap of -1 after each word: pairs never cross it.
        ends = np.cumsum(sizes + 1) - 1
        ids = np.full(int(ends[-1]) + 1, -1, np.int64)
        inside = np.ones(len(ids), bool)
        inside[ends] = False
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        right = np.arange(1, n + 1)
        left = np.arange(-1, n - 1)
        alive = inside.copy()
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray, makes: np.ndarray) -> None:
            hit = makes >= 0
            at, makes = at[hit], makes[hit]
            order = np.argsort(makes, kind="stable")
            at, makes = at[order], makes[order]
            cuts = np.flatnonzero(makes[1:] != makes[:-1]) + 1
            for r, part in zip(makes[np.concatenate(([0], cuts))].tolist() if len(makes) else [], np.split(at, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        at = np.flatnonzero(inside[:-1])
        enter(at, self._joined(ids[at], ids[at + 1]))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[alive[at]]
            to = right[at]
            ok = self._joined(ids[at], ids[np.minimum(to, n - 1)]) == r  # pairs that an earlier merge has taken fall out
            at, to = at[ok], to[ok]
            if len(at) > 1 and (to[:-1] == at[1:]).any():
                # Runs of overlapping pairs (aaaa): every second one from the left.
                new_run = np.concatenate(([True], to[:-1] != at[1:]))
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                take = (np.arange(len(at)) - start) % 2 == 0
                at, to = at[take], to[take]
            if not len(at):
                continue
            ids[at] = r
            alive[to] = False
            far = right[to]
            right[at] = far
            left[np.minimum(far, n - 1)] = at
            before = left[at]
            has = before >= 0
            before = before[has]
            enter(before, self._joined(ids[before], ids[at[has]]))
            enter(at, self._joined(ids[at], ids[np.minimum(far, n - 1)]))
        counts = np.add.reduceat(alive, np.concatenate(([0], ends[:-1] + 1)), dtype=np.int64)
        cuts = np.cumsum(counts).tolist()
        flat = ids[alive].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def learn(self, texts_words: list[list[str]]) -> None:
        """Replay the words of these texts that aren't known yet."""
        if len(self.known) > self.keep:
            self.known.clear()
        new = list({w for words in texts_words for w in words if w not in self.known})
        for word, ids in zip(new, self.replay([w.encode() for w in new]), strict=True):
            self.known[word] = (len(ids), b"".join(b"%d," % i for i in ids), self.decode(ids))

    def encode(self, text: str) -> list[int]:
        words = self.find(text)
        self.learn([words])
        return [int(i) for w in words for i in self.known[w][1].split(b",")[:-1]]


def replayer(path: str) -> MergeReplay:
    return common.worker_state(("replay", path), lambda: MergeReplay(path))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encoded(docs: DataFrame, path: str, digest: bool, id_col: str, text_col: str) -> DataFrame:
    schema = DIGESTS if digest else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = replayer(path)

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            split = [machine.find(t) for t in texts]
            machine.learn(split)
            out = []
            for doc, words in zip(ids, split, strict=True):
                found = [machine.known[w] for w in words]
                n, listed, raw = sum(x[0] for x in found), b"".join(x[1] for x in found)[:-1], b"".join(x[2] for x in found)
                out.append((doc, n, hashlib.sha256(listed).hexdigest(), hashlib.sha256(raw).hexdigest()) if digest else (doc, n, listed.decode(), raw))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1), as_bytes=False), strict=True):
                ids.append(doc)
                texts.append(text or "")
                held += len(texts[-1])
                if held > AT_ONCE:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)

    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids string, decoded binary"
    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: decimal ids joined by commas, and the bytes they decode to.

    One row per input row, repeated ones too; null and empty texts have no ids and decode to no bytes; long texts and
    words count whole; a null id stays null; only the two columns named are read; an empty table gives an empty result.
    No shuffle.
    """
    return _encoded(docs, path or public_tokenizers.path(VOCABULARY), False, id_col, text_col)


def encoding_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests in place of the ids and bytes."""
    return _encoded(docs, path or public_tokenizers.path(VOCABULARY), True, id_col, text_col)


def op8_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded bytes of every row of ``documents``; cases are defined by ``encode_documents``."""
    return encoding_digests(common.documents(spark, sf_dir))
