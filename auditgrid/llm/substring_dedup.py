"""Substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of one document. A window goes when its
words also start in a document with a smaller id; every word it covers is removed.

Broadcasting automata of the whole corpus would not be bounded, so documents are
routed to the only shards that can match them. Each window names its minimiser,
the least-hashed ``gram``-word sequence in it; equal windows name equal
minimisers, so a shard holds the contexts around minimisers that two or more
documents share. In a shard, contexts stream in id order against a suffix
automaton of the contexts before them; a matching statistic of ``window`` words
or more marks a window for removal, and new words extend the automaton. Windows
that follow one another leave a task as one maximal span.

Minimisers in more than ``crowd`` places take an exact way without groups: equal
contexts become one, with the least id, and the windows of distinct contexts are
aggregated to the least id by 128-bit hashes, whose halves stand on independent
hashes of the words. Whole texts that repeat are found first by the SHA-256 of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

WINDOW = 50
#: Words of a minimiser. Shorter ones are fewer and longer contexts.
GRAM = 16
#: Places of a minimiser from which windows are compared one by one.
CROWD = 128
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def wide_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def rolled(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``width`` consecutive values, equal for equal sequences.

    A polynomial in ``base``: that of a + b values is made of those of a and of b, so widths double.
    """
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(len(h) + 1, np.uint64), 0
    part, size = h, 1
    while True:
        power = np.uint64(pow(int(base), size, 2**64))
        if width & size:
            n = len(h) - done - size + 1
            out, done = out[:n] * power + part[done : done + n], done + size
        if done == width:
            break
        part, size = part[:-size] * power + part[size:], 2 * size
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def minimisers(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: distinct minimiser positions, their hashes, first and last window start that name each.

    The leftmost least hash (by its upper 49 bits) of a window is its minimiser, so positions never go back. Windows
    have fewer than 16,384 places.
    """
    g = rolled(h, gram, _BASES[0])
    wide = window - gram + 1
    if len(g) < wide:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = np.empty(len(g) - wide + 1, np.int64)
    low = np.uint64((1 << 15) - 1)
    for i in range(0, len(at), 16384):
        # The least of hash and place in one number, over windows of 1, 2, 4 ... and then ``wide`` places.
        part = g[i : i + 16384 + wide - 1]
        least, width = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * width <= wide:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < wide:
            least = np.minimum(least[: width - wide], least[wide - width :])
        at[i : i + len(least)] = (least & low).astype(np.int64) + i
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], g[at[first]].view(np.int64), first, last


PROFILE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("words_sha", pa.string()), ("anchors", pa.list_(pa.int64())), ("los", pa.list_(pa.int32())), ("his", pa.list_(pa.int32())), ("tag", pa.int64())])
PROFILE_DDL = "doc_id long, n_words long, words_sha string, anchors array<long>, los array<int>, his array<int>, tag long"


def profiles(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per row of (doc_id, text, tag): word count, SHA-256 of its words, and its minimisers with their window starts."""

    def one(raw: bytes | None) -> tuple:
        words = (raw or b"").split()
        sha = hashlib.sha256(b" ".join(words)).hexdigest()
        if len(words) < window:
            return len(words), sha, [], [], []
        _, hashes, lo, hi = minimisers(word_hashes(words), window, gram)
        return len(words), sha, hashes, lo.astype(np.int32), hi.astype(np.int32)

    return docs.mapInArrow(common.arrow_rows(one, PROFILE), PROFILE_DDL)


_PAIR = pa.struct([("one", pa.int64()), ("two", pa.int64())])
CONTEXT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("anchor", pa.int64()), ("other", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("windows", pa.list_(_PAIR))])
CONTEXT_DDL = "doc_id long, tag long, anchor long, other long, start int, words binary, windows array<struct<one:long,two:long>>"
#: Bytes of contexts, hashes of windows included, that leave a task at once.
AT_ONCE = 4_000_000


def _context_batch(rows: list[tuple], pairs: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(CONTEXT)[:6], strict=True)]
    flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], fields=list(_PAIR))
    windows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32()), values)
    return pa.RecordBatch.from_arrays([*columns, windows], schema=CONTEXT)


def _contexts(window: int):
    """Rows of (doc_id, text, tag, places), rows with one id and tag behind one another, to contexts.

    A context is the words that all windows of one minimiser cover. Where the minimiser is crowded, words
    is null, (anchor, other) are two hashes of the context and windows has two hashes of each window.
    """
    none = np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_state()
        rows: list[tuple] = []
        pairs: list[np.ndarray] = []
        size, before = 0, None
        for batch in batches:
            places = batch.column(3)
            bounds = places.offsets.to_numpy()
            anchors, los, his, crowds = (places.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for k, raw in enumerate(common.texts_of(batch.column(1), at_once=64)):
                doc, tag = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if (doc, tag) == before:
                    continue  # a row that repeats
                before = (doc, tag)
                words = (raw or b"").split()
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                hashes: np.ndarray | None = None
                for j in range(bounds[k], bounds[k + 1]):
                    lo, hi = int(los[j]), int(his[j])
                    part = joined[ends[lo - 1] if lo else 0 : ends[hi + window - 1] - 1]
                    if crowds[j]:
                        if hashes is None:  # of all windows at once: array steps cost more than their values
                            wide = wide_hashes(words)
                            hashes = np.stack([rolled(wide[:, i], window, b).view(np.int64) for i, b in enumerate(_BASES)], axis=1)
                        pairs.append(hashes[lo : hi + 1].copy())
                        context = hashlib.blake2b(part, digest_size=16).digest()
                        one, two = (int.from_bytes(context[i : i + 8], "big", signed=True) for i in (0, 8))
                        rows.append((doc, tag, one, two, lo, None))
                        size += pairs[-1].nbytes + 64
                    else:
                        pairs.append(none)
                        rows.append((doc, tag, int(anchors[j]), None, lo, part))
                        size += len(part) + 64
                    if size > AT_ONCE:
                        yield _context_batch(rows, pairs)
                        rows, pairs, size = [], [], 0
        if rows:
            yield _context_batch(rows, pairs)

    return run


class SuffixAutomaton:
    """Of word sequences; grows by one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nexts[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, q, w)
                continue
            new = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def _split(self, p: int, q: int, w: bytes) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """At each word, the length of the longest sequence ending there that the automaton holds."""
        nexts, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                n = length[state]
            to = nexts[state].get(w)
            state, n = (0, 0) if to is None else (to, n + 1)
            out.append(n)
        return out


SPAN = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
SPAN_DDL = "doc_id long, tag long, lo int, hi int"


def long_matches(stats: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans [lo, hi) of words that windows cover which end where the statistic reaches ``window``."""
    out: list[tuple[int, int]] = []
    if max(stats) < window:
        return out
    for i in range(window - 1, len(stats)):
        if stats[i] >= window:
            if out and out[-1][1] >= i - window + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - window + 1, i + 1))
    return out


def _match_shards(window: int):
    """Contexts sorted by (anchor, doc_id, start) to maximal spans of words [lo, hi) that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_state()
        anchor = doc = None
        automaton, waiting, held = SuffixAutomaton(), [], set()
        out: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for d, tag, a, start, raw in zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True):
                    if a != anchor:
                        anchor, doc, automaton, waiting, held = a, d, SuffixAutomaton(), [], set()
                    elif d != doc:
                        for x in waiting:
                            automaton.add(x.split(b" "))
                        held.update(waiting)
                        doc, waiting = d, []
                    n = raw.count(b" ") + 1
                    if raw in held:  # the automaton has spelled it whole, so its statistics are 1, 2, ... n
                        out.append((d, tag, start, start + n))
                        continue
                    # An automaton without words matches nothing.
                    spans = long_matches(automaton.statistics(raw.split(b" ")), window) if held else []
                    out += [(d, tag, start + lo, start + hi) for lo, hi in spans]
                    if spans != [(0, n)]:
                        waiting.append(raw)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPAN, strict=True)], schema=SPAN)
                    out = []

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("words_sha", pa.string()), ("n_removed", pa.int64()), ("kept", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))])
KEPT_DDL = "doc_id long, tag long, words_sha string, n_removed long, kept array<struct<at:int,n:int>>"


def kept_runs(n_words: int, lo: np.ndarray, hi: np.ndarray) -> tuple[int, list[dict]]:
    """Words that spans [lo, hi) cover, and the runs of words between them: first word (from 1) and number."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    begins = np.concatenate(([0], reach)).tolist()
    runs = [{"at": a + 1, "n": b - a} for a, b in zip(begins, [*lo.tolist(), n_words], strict=True) if b > a]
    return n_words - sum(r["n"] for r in runs), runs


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, words_sha, n_words, spans) to rows of ``KEPT``."""
    common.release_state()
    for batch in batches:
        spans = batch.column(4)
        bounds, (lo, hi) = spans.offsets.to_numpy(), (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        found = [kept_runs(n, lo[a:b], hi[a:b]) for n, a, b in zip(batch.column(3).to_pylist(), bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], KEPT.field(4).type)], schema=KEPT)


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows apart that share an id."""
    return common.id_and_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id, tag, n_words, words_sha, copy, n_removed, kept``: one row per input row.

    copy: all words go, since a document with a smaller id has the same words. kept: the runs of words that
    stay otherwise (first word, from 1, and number), null when none go. tag: a hash of the text.
    Null and empty texts have no words. Long texts count whole. Rows with a null id neither lose words nor are
    references; rows with the same id don't match each other, and rows that repeat come out each. An empty
    table gives an empty result; only the two columns named are read.
    """
    tables = common.Tables(docs.sparkSession, "substring")
    docs = _tagged(docs, id_col, text_col)
    rows = tables.write(profiles(docs, window, gram), "profiles")
    full = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    # Of rows with the same words the least id, and of its rows one, stands for all.
    firsts = full.groupBy("words_sha").agg(F.min_by(F.struct("doc_id", "tag", "n_words", "anchors", "los", "his"), F.struct("doc_id", "tag")).alias("f"))
    firsts = tables.write(firsts.select("words_sha", "f.*"), "firsts")
    places = firsts.select("doc_id", "tag", F.explode(F.arrays_zip("anchors", "los", "his")).alias("x")).select("doc_id", "tag", F.col("x.anchors").alias("anchor"), F.col("x.los").alias("lo"), F.col("x.his").alias("hi"))
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("anchor", (F.col("n") > crowd).alias("crowded"))
    # Written, so that the join below shuffles both sides anew and Spark can split a minimiser with very many places.
    shared = tables.write(shared, "shared")
    found = places.join(shared, "anchor").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "lo", "hi", "crowded")).alias("places"))
    contexts = docs.join(found, ["doc_id", "tag"]).select("doc_id", "text", "tag", "places").mapInArrow(_contexts(window), CONTEXT_DDL)
    contexts = tables.write(contexts, "contexts")
    quiet = contexts.where("words is not null")
    n = quiet.sparkSession.conf.get("spark.sql.shuffle.partitions")
    by_shard = quiet.repartition(int(n), "anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(_match_shards(window), SPAN_DDL)
    # Crowded minimisers: equal contexts count once, so copies of a passage are never paired.
    loud = contexts.where("words is null").select("doc_id", "tag", "anchor", "other", "start", "windows")
    distinct = loud.groupBy("anchor", "other").agg(F.min("doc_id").alias("least"), F.first("windows").alias("windows"))
    distinct = tables.write(distinct, "distinct")
    each = distinct.select("anchor", "other", "least", F.posexplode("windows").alias("at", "w")).select("anchor", "other", "least", "at", "w.*")
    earlier = each.groupBy("one", "two").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("one", "two", "first")
    gone = each.join(earlier, ["one", "two"]).where("least > first").groupBy("anchor", "other").agg(F.collect_list("at").alias("gone"))
    known = distinct.select("anchor", "other", "least", F.size("windows").alias("n")).join(gone, ["anchor", "other"], "left")
    # Written for the same reason: one context can be in very many documents.
    known = tables.write(known, "known")
    hit = loud.drop("windows").join(known, ["anchor", "other"]).where("doc_id > least or gone is not null")
    cuts = F.when(F.col("doc_id") > F.col("least"), F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n") + (window - 1)).alias("hi")))).otherwise(
        F.transform("gone", lambda x: F.struct((F.col("start") + x).alias("lo"), (F.col("start") + x + window).alias("hi")))
    )
    by_content = hit.select("doc_id", "tag", F.inline(cuts))
    spans = by_shard.union(by_content).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    kept = firsts.select("doc_id", "tag", "words_sha", "n_words").join(spans, ["doc_id", "tag"]).select("doc_id", "tag", "words_sha", "n_words", "spans").mapInArrow(_kept, KEPT_DDL)
    kept = tables.write(kept, "kept")
    tables.drop("profiles", "firsts", "kept")
    marks = firsts.select("doc_id", "tag", "words_sha", F.lit(True).alias("first")).join(kept, ["doc_id", "tag", "words_sha"], "left").drop("tag")
    copy = (F.col("n_words") >= window) & F.col("doc_id").isNotNull() & F.col("first").isNull()
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    joined = rows.select("doc_id", "tag", "n_words", "words_sha").join(marks, ["doc_id", "words_sha"], "left")
    out = tables.write(joined.select("doc_id", "tag", "n_words", "words_sha", copy.alias("copy"), removed.cast("long").alias("n_removed"), "kept"), "marked")
    tables.drop("marked")
    return out


def _cut(text: Column, kept: Column) -> Column:
    """The words of the runs ``kept``, joined by a space."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.flatten(F.transform(kept, lambda k: F.slice(words, k["at"], k["n"]))), " ")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with all their columns; texts lose their repeated words, the rest stays as it is.

    A text that loses words is its kept words joined by a space, and ``size_col``, where there is one, the text's
    length. A text that loses none keeps its white space, and a null text stays null. Other cases as in
    ``repeated_words``; columns of any name may stand beside these.
    """
    marked = repeated_words(docs, id_col, text_col, window)
    tag, of_id, of_tag, copy, kept = common.fresh(docs, "tag", "of_id", "of_tag", "copy", "kept")
    # By the text's tag too: other rows may share the id, and rows that share both lose the same words.
    touched = marked.where("n_removed > 0").dropDuplicates(["doc_id", "tag"]).select(F.col("doc_id").alias(of_id), F.col("tag").alias(of_tag), F.col("copy").alias(copy), F.col("kept").alias(kept))
    rows = docs.withColumn(tag, F.xxhash64(F.col(text_col).cast("string")))
    joined = rows.join(touched, (F.col(id_col).cast("long") == F.col(of_id)) & (F.col(tag) == F.col(of_tag)), "left")
    text = F.when(F.col(copy), F.lit("")).when(F.col(kept).isNotNull(), _cut(F.col(text_col), F.col(kept))).otherwise(F.col(text_col))
    out = joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row per input row; cases are defined by ``repeated_words``."""
    marked = repeated_words(docs, id_col, text_col, window, gram, crowd)
    cut = marked.where("kept is not null").dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", "kept")
    cut = _tagged(docs, id_col, text_col).join(cut, ["doc_id", "tag"]).select("doc_id", "tag", F.sha2(_cut(F.col("text"), F.col("kept")), 256).alias("cut_sha")).dropDuplicates(["doc_id", "tag"])
    sha = F.when(F.col("copy"), _EMPTY_SHA).otherwise(F.coalesce("cut_sha", "words_sha"))
    return marked.join(cut, ["doc_id", "tag"], "left").select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


def op3_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every row of ``documents`` and the digest of those that stay; cases are defined by ``repeated_words``."""
    return digests(common.documents(spark, sf_dir))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 49], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT words, min(doc_id) AS least FROM windows GROUP BY words HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 50)))) AS places FROM windows JOIN firsts USING (words) WHERE doc_id > least GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
