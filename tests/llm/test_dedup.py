"""Exact, near-duplicate and substring de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_rows import SF_SMALL, make_docs, none, odd  # noqa: F401
from pyspark.sql import functions as F

from vitrine.llm import blocknames, components, simhash, substrings
from vitrine.llm.fmindex import FMIndex, WaveletMatrix, suffix_order
from vitrine.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf=SF_SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# exact


def test_exact_groups_of_odd_rows(odd):
    rows = blocknames.exact_duplicates(odd, block_chars=16).collect()
    assert len(rows) == 12
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert Counter(r.doc_id for r in empty) == {3: 1, 4: 1, 5: 1, None: 1}
    assert all(r.group_size == 4 and r.keep_id == 5 for r in empty)  # most code points
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert all(r.group_size == 3 and r.keep_id == 2 for r in same) or all(r.keep_id == 1 for r in same)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_exact_keeps_one_row_of_repeated_rows(make_docs):
    docs = make_docs([(1, "same text")] * 5 + [(2, "same  text")] * 2 + [(3, "other")])
    kept = blocknames.drop_exact_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3] and kept[0].asDict().keys() == set(docs.columns)


def test_exact_tells_apart_what_only_late_blocks_differ_in(make_docs):
    base = "abcdefgh" * 20
    docs = make_docs([(1, base + "x"), (2, base + "y"), (3, base + "x"), (4, base), (5, base[:-1] + "Z")])
    rows = {r.doc_id: r for r in blocknames.exact_duplicates(docs, block_chars=8).collect()}
    assert [rows[i].group_size for i in range(1, 6)] == [2, 1, 2, 1, 1]
    assert rows[3].keep_id == 1


def test_exact_keeps_rows_and_extra_columns(odd):
    out = blocknames.drop_exact_duplicates(odd)
    assert out.columns == odd.columns and out.where("row_id = 'clash'").count() == out.count()


def test_exact_empty_table(none):
    assert blocknames.exact_duplicates(none).count() == 0


# near


def _fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def _near(docs):
    fps = {d: _fingerprint(t) for d, t in docs}
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", root(d)) for d in ids}


def test_simhash_query_against_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op8_simhash_near_dedup"](spark, SF_SMALL).collect()}
    assert got == _near(documents(spark))


def test_simhash_links_in_dense_clusters(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(400):  # chains of one to three bits around a centre, and strangers
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = components.components(simhash.links(spark.createDataFrame(signed, "fp long")))
    found = {r.u: r.v for r in edges.collect()}
    parent = {f: f for (f,) in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a,) in enumerate(signed):
        for (b,) in signed[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {f: found.get(f, f) for (f,) in signed} == {f: root(f) for (f,) in signed}


def test_simhash_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 12
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {3}
    assert sum(r.kept for r in rows) == len({r.component_id for r in rows})
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.where("fp = 'clash'").count() == out.count()


def test_simhash_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_path_a_star_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(100, 100 + i) for i in range(1, 60)]
    cycle = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    found = {r.u: r.v for r in components.components(spark.createDataFrame(path + star + cycle, "u long, v long")).collect()}
    assert {found[i] for i in range(1, 51)} == {0}
    assert {found[100 + i] for i in range(1, 60)} == {100}
    assert {found[200 + i] for i in range(1, 7)} == {200}


# substrings


def _removed(docs, window=20):
    seen, out = set(), []
    for d, text in docs:
        w = WORD.findall(text or "")
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                stay[i : i + window] = [False] * window
            seen.add(k)
        left = " ".join(x for x, s in zip(w, stay, strict=True) if s)
        out.append((d, len(w), len(w) - sum(stay), hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_substring_query_against_brute_force(spark):
    got = sorted(tuple(r) for r in queries()["op3_substring_dedup"](spark, SF_SMALL).collect())
    assert got == _removed(sorted(documents(spark)))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_a_small_alphabet(make_docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = sorted(tuple(r) for r in substrings.remove_repeats(make_docs(rows), window=8, anchor=3, shard_words=300).collect())
    assert got == _removed(rows, 8)


def test_substring_odd_rows(odd):
    rows = {}
    for r in substrings.remove_repeats(odd, keep_text=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[1]) == 2 and len(rows[None]) == 2
    assert rows[3][0].n_words == rows[4][0].n_words == rows[5][0].n_words == 0
    assert rows[6][0].n_words == 30_000 and rows[6][0].kept_text == "word"  # the first window starts nowhere earlier
    assert rows[6][0].n_removed == 29_999 or rows[6][0].kept_text


def test_substring_repeated_ids_count_as_later_documents(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = substrings.remove_repeats(make_docs([(1, text), (1, text), (2, "z " + text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 30), (2, 30)]


def test_substring_empty_table(none):
    assert substrings.remove_repeats(none).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 37, 1000)
    tree = WaveletMatrix(seq, 37)
    symbol, lo, hi = rng.integers(0, 37, 200), rng.integers(0, 1001, 200), rng.integers(0, 1001, 200)
    a, b = tree.ranks(symbol, lo, hi)
    assert a.tolist() == [(seq[:x] == s).sum() for s, x in zip(symbol, lo, strict=True)]
    assert b.tolist() == [(seq[:x] == s).sum() for s, x in zip(symbol, hi, strict=True)]


@pytest.mark.parametrize("depth", [1, 5, 8, 20])
def test_suffix_order(depth):
    text = np.random.default_rng(depth).integers(0, 3, 300)
    rank = suffix_order(text, depth)
    keys = [tuple(text[i : i + depth]) for i in range(300)]
    assert rank.tolist() == [sorted(set(keys)).index(k) for k in keys]


def test_matching_statistics_of_strange_queries():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = FMIndex(text, 4, 6)
    queries_ = [rng.integers(-1, 5, 50) for _ in range(20)] + [np.empty(0, np.int64)]
    queries_ = [np.where(q >= 4, 0, q) for q in queries_]
    subs = {tuple(text[i : i + n]) for i in range(400) for n in range(1, 7) if 0 not in text[i : i + n]}
    for q, (length, lo, hi) in zip(queries_, index.matching_statistics(queries_), strict=True):
        for i in range(len(q)):
            best = max((n for n in range(1, min(6, len(q) - i) + 1) if tuple(q[i : i + n]) in subs), default=0)
            assert length[i] == best
            if best:
                places = {p for p in range(400) if tuple(text[p : p + best]) == tuple(q[i : i + best])}
                assert set(index.places[lo[i] : hi[i]].tolist()) == places


def test_substrings_tell_thue_morse_words_apart(make_docs):
    """Polynomial hashes modulo 2^64 of these two words are equal whatever the base; the words are not."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    before = " ".join(f"w{i}" for i in range(19))
    rows = substrings.remove_repeats(make_docs([(1, f"{before} {word}"), (2, f"{before} {other}")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (2, 0)]
    again = substrings.remove_repeats(make_docs([(1, f"{before} {word}"), (2, f"{before}  {word}")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in again) == [(1, 0), (2, 20)]


def test_word_places(spark):
    """Words, whatever white space lies around them and in whatever slice of an array they stand."""
    import pyarrow as pa

    from vitrine.llm.wordhash import Words

    texts = ["x", None, "", " \t\n ", "  a  b\x0b\x0cc ", "\u00e9 \u00a0 b", "a", " a", "a "]
    for arr in (pa.array(texts), pa.array(["skip me", *texts, "tail"]).slice(1, len(texts))):
        w = Words(arr)
        plain = [WORD.findall(t or "") for t in texts]
        assert w.counts.tolist() == [len(p) for p in plain]
        flat = [x for p in plain for x in p]
        data = w.data.tobytes()
        assert [data[a : z - 1].decode() for a, z in zip(w.starts[:-1], w.starts[1:], strict=True)] == flat
        h = w.hashes()
        assert len({(x, int(y)) for x, y in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h.tolist()))
        assert w.digests(np.array([1, 0]), np.array([3, 1])) == [hashlib.sha256(s.encode()).digest()[:16] for s in ("a b c", "x")]
