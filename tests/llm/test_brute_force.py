import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditgrid.llm import common, exact_dedup, quality_bands, simhash, substring_dedup
from tests.llm.tables import corpus, frame


def plain_quality(text):
    text = (text or "").encode()
    ws = text.split()
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {j for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text.decode()), dup, len(covered)


def test_quality_counts(spark):
    rows = corpus() + [(900, "a b #x\na b #x\n\n \n" * 3 + "é" * 9), (901, " ".join("abcdefghij") + " " + " ".join("abcdefghij"))]
    got = quality_bands.score_quality(frame(spark, rows)).collect()
    want = sorted((i if i is not None else -1, *plain_quality(t)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_bands_reject_repeats_and_noise(spark):
    import base64
    import random

    rnd = random.Random(3)
    noise = " ".join(base64.b85encode(rnd.randbytes(30)).decode() for _ in range(300))
    ten_words = " ".join(rnd.choice(("the", "house", "stands", "near", "old", "water", "mill", "where", "people", "gather")) + str(rnd.randrange(50)) for _ in range(300))
    loop = " ".join(f"w{i % 7}" for i in range(3000))
    got = {r.doc_id: r for r in quality_bands.score_quality(frame(spark, [(1, noise), (2, ten_words), (3, loop)])).collect()}
    assert (got[1].kept, got[2].kept, got[3].kept) == (False, False, False)
    assert not got[1].base_failed and got[1].ratio > 0.8
    assert not got[2].base_failed and got[2].ratio < 0.35  # clean documents of that length have 0.46 or more (test_bands)


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    k = min(3, len(ws))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), seed=42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    comp = list(range(len(prints)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                comp[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_components(spark):
    rows = corpus()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f, least.get(r)) for (i, _), f, r in zip(rows, prints, roots, strict=True))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def clusters(rnd, n=12):
    """Fingerprints some of which are within two bits, and dense groups that share all but a few bits."""
    prints = set()
    for k in range(n):
        base = rnd.getrandbits(64)
        prints |= {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(12)} | {base ^ rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64)}
        if k % 4 == 0:
            bits = rnd.sample(range(64), 9)
            prints |= {base ^ sum(1 << b for b in bits if rnd.random() < 0.5) for _ in range(60)}
    return sorted(prints)


@pytest.mark.parametrize("seed", [5, 6])
def test_simhash_links_are_all_pairs_within_two_bits(spark, seed):
    import random

    prints = clusters(random.Random(seed))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), common.Tables(spark, "test")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and simhash_distance(a, b) <= 2}
    assert {(r.a, r.b) for r in links} == want and len(want) > 100


def test_pivots_keep_every_pair_within_two_bits():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        assert all(abs((a ^ p % 2**64).bit_count() - (b ^ p % 2**64).bit_count()) <= 2 for p in simhash.pivots())


def simhash_distance(a, b):
    return ((a ^ b) % 2**64).bit_count()


def plain_substring(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            if i is not None:
                first[w] = min(i, first.get(w, i))
    out = []
    for i, ws in split:
        gone = {j for k in range(len(ws) - window + 1) if i is not None and first[tuple(ws[k : k + window])] < i for j in range(k, k + window)}
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("window", "gram", "crowd"), [(50, 16, 128), (50, 16, 3), (12, 5, 4), (9, 9, 2)])
def test_substring_removal(spark, window, gram, crowd):
    rows = corpus() + [(800 + i, "a b " * 40) for i in range(3)] + [(810, "z " + "a b " * 45), (811, "b a " * 30), (5, "z " + "a b " * 45), (810, "z " + "a b " * 45)]
    got = substring_dedup.digests(frame(spark, rows), window=window, gram=gram, crowd=crowd).collect()
    assert Counter(map(tuple, got)) == plain_substring(rows, window)


def test_long_matches_and_kept_runs():
    assert substring_dedup.long_matches([1, 2, 3, 3, 0, 1, 2, 3, 4], 3) == [(0, 4), (5, 9)]
    assert substring_dedup.long_matches([3, 3, 3, 1, 2, 3], 3) == [(0, 6)]  # spans that touch are one
    assert substring_dedup.kept_runs(10, np.array([2, 1, 7]), np.array([4, 3, 9])) == (5, [{"at": 1, "n": 1}, {"at": 5, "n": 3}, {"at": 10, "n": 1}])
    assert substring_dedup.kept_runs(3, np.array([0]), np.array([3])) == (3, [])


def test_matching_statistics():
    a = substring_dedup.SuffixAutomaton()
    a.add(list(b"abcbc"))
    a.add(list(b"xbcb"))
    texts = [b"abcbc", b"xbcb"]
    probe = b"zbcbcxbcbaabc"
    want = [max(k for k in range(i + 2) if k == 0 or any(probe[i + 1 - k : i + 1] in t for t in texts)) for i in range(len(probe))]
    assert a.statistics(list(probe)) == want


def plain_exact(rows):
    norm = [(i, t or "", "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")) for i, t in rows]
    out = []
    for i, t, n in norm:
        group = [(len(x), -1e18 if j is None else -j, j) for j, x, m in norm if m == n]
        out.append((i, max(group, key=lambda g: g[:2])[2], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_exact_groups(spark, block):
    rows = corpus()
    got = exact_dedup.exact_duplicates(frame(spark, rows), block=block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_exact(rows)
    assert all(sum(r.kept for r in got if r.text_sha256 == s) == 1 for s in {r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_names_tell_colliding_hashes_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = corpus()[:30]
    got = exact_dedup.exact_duplicates(frame(spark, rows), block=64).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_exact(rows)


def test_empty_tables(spark):
    none = frame(spark, corpus()[:3]).where("false")
    assert quality_bands.score_quality(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.digests(none).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_nfc_is_what_the_fixture_has():
    assert any(t and not unicodedata.is_normalized("NFC", unicodedata.normalize("NFD", t)) for _, t in corpus())
