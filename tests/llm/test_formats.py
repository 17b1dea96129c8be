"""Mixing, packing, chat formatting and fingerprints."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_rows import SF_SMALL, make_docs, none, odd  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import chat, fingerprints, mixing, packing
from vitrine.llm.queries import oracle_sql, queries


def _same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    cols = [c[0] for c in want.description]
    df = queries()[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op4_mix_sources", "op7_exact_dedup", "op9_chat_format"])
def test_query_against_sql(spark, name):
    _same_as_sql(spark, name)


# mixing


def test_targets_stop_at_the_cap_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    # weights 3, 1, 2, 3: c and a stop at twice their size, b takes the rest
    assert got == {"a": (100, 200.0), "b": (1000, 1665 - 220.0), "c": (10, 20.0), None: (0, 0.0)}


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 12
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (3, 4, 5, 6, 9)} == {3: 0, 4: 0, 5: 0, 6: 30_000, 9: 4}
    assert all(0 <= r.copies <= 2 for r in rows)
    mixed = mixing.mix(odd)
    assert mixing.emit(mixed).count() == sum(r.copies for r in rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixed.repartition(3).collect()))


def test_mix_empty_table(none):
    assert mixing.mix(none).count() == 0


def test_mix_comes_near_the_targets(spark):
    mixed = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    per = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("target")).collect()
    assert all(abs(r.n - r.target) < 0.2 * r.target for r in per), per
    assert abs(sum(r.n for r in per) / sum(r.target for r in per) - 1) < 0.03


def test_each_source_comes_within_a_twentieth_of_its_target(spark):
    """Also with some fifty documents a source; a source misses by less than its largest document in any case."""
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
        taken, most = F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("size").alias("most")
        for r in mixed.groupBy("row.source").agg(taken, most, F.max("target").alias("target")).collect():
            assert abs(r.n - r.target) <= max(0.05 * r.target, r.most), (sf, r)


# packing


def _exact_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'st .,\n\t\u00a0\u2003\u00e9\u4e2d9!") | st.characters(), max_size=60))
def test_remembered_parts_give_the_tokenizers_ids(text):
    if "enc" not in globals():
        globals()["enc"] = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
        globals()["tok"] = _exact_tokenizer()
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(enc(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids  # noqa: F821


def test_special_token_text():
    enc, tok = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), _exact_tokenizer()
    for text in ("a <|endoftext|> b", "<|endoftext|>", " lead", "trail ", "  two  "):
        assert np.frombuffer(enc(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def _check_plan(rows, texts, capacity):
    tok = _exact_tokenizer()
    want = []
    for d, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        want += [(d, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_packing_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    bins, tokens = _check_plan(queries()["op5_best_fit_packing"](spark, SF_SMALL).collect(), texts, 2048)
    assert bins <= 1.02 * tokens / 2048 + 2


def test_packing_odd_rows(odd):
    texts = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    _check_plan(packing.pack(odd, capacity=64, group_pieces=50).collect(), texts, 64)


def test_packing_empty_table(none):
    assert packing.pack(none).count() == 0


def test_best_two_fit_swaps_the_smallest_for_a_pair():
    # 60 + 35 leaves 5; 35 gives way to 22 + 18, which fill the bin
    bins, offsets = packing.best_two_fit(np.array([60, 35, 22, 18]), 100)
    assert bins.tolist() == [0, 1, 0, 0] and offsets[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_two_fit_places_everything_once(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_two_fit(lengths, 50)
    used = defaultdict(int)
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True)):
        assert o == used[b]
        used[b] += n
    assert all(v <= 50 for v in used.values())


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(st.sampled_from("\\#</turn> :\nab") | st.characters(), max_size=40)), max_size=5))
def test_chat_round_trip(turns):
    turns = [(r.encode("utf-8", "ignore").decode(), t.encode("utf-8", "ignore").decode()) for r, t in turns]
    rendered = [chat.render(r, t) for r, t in turns]
    whole = "".join(r[0] for r in rendered)
    for chunks in ([whole], [r[0] for r in rendered], list(whole)):
        assert [t[:2] for t in chat.parse(chunks)] == turns


@pytest.mark.parametrize("text", ["###", "\\###", "\\\\### </turn>", "\n</turn>\n### user: x", "\\", "####", "</turn", ""])
def test_chat_escapes(text):
    turn, start, end = chat.render("assistant", text)
    assert chat.unescape(turn[start:end]) == text
    assert all(m[1] for m in chat._CONTROL.finditer(turn[start:end]))


@pytest.mark.parametrize("bad", ["x", "### user: no end", "### user: a ### b\n</turn>\n", "### user: a</turn>\n"])
def test_chat_parser_rejects(bad):
    with pytest.raises(chat.ParseError):
        list(chat.parse([bad]))


def test_chat_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "first"), (None, 1, "assistant", "n"), (2, 1, "a b:\n", "x"), (1, 2, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9))
    formatted = chat.format_conversations(df)
    whole = defaultdict(str)
    for r in sorted(formatted.collect(), key=lambda r: (str(r.conv_id), r.seq)):
        whole[r.conv_id] += r.chunk
        if r.role == "assistant":
            assert whole[r.conv_id][r.loss_start : r.loss_end] == {1: "b", None: "n"}[r.conv_id]
    assert [t[:2] for t in chat.parse([whole[1]])] == [("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert back[1].n_turns == 4 and back[1].loss_chars == 2 and back[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert back[2].turns_sha256 == hashlib.sha256(b"a b:\n\nx\n").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_long_runs_of_backslashes_take_linear_time():
    text = "\\" * 1_000_000
    began = time.time()
    assert chat.escape(text) == text and chat.escape(text + "###") == text + "\\###"
    turn, start, end = chat.render("user", text + "</turn>" + text)
    assert [t[:2] for t in chat.parse([turn])] == [("user", text + "</turn>" + text)]
    assert time.time() - began < 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "a b"]), st.text(alphabet="\\#</turn>\n x", max_size=30)), max_size=5), st.integers(1, 9))
def test_chunk_borders_mean_nothing(turns, size):
    whole = "".join(chat.render(r, t)[0] for r, t in turns)
    got = list(chat.parse(whole[i : i + size] for i in range(0, len(whole), size)))
    assert [t[:2] for t in got] == turns
    assert [chat.unescape(whole[a:z]) for _, _, a, z in got] == [t for _, t in turns]


def test_read_back_in_any_order_and_cut(spark, tmp_path):
    """Formatted rows may be written, shuffled and cut anywhere; a hot conversation streams like others."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"c{c} \\### t{t} </turn>") for c in range(3) for t in range(400 if c == 1 else 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns)
    want = sorted(chat.read_back(formatted).collect())
    assert [r.n_turns for r in want] == [5, 400, 5]
    for r in want:
        said = [t for c, _, role, t in rows if c == r.conv_id and role == "assistant"]
        assert r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
    formatted.repartition(6, F.rand(3)).write.parquet(str(tmp_path / "f"))
    again = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(chat.read_back(again).collect()) == want
    # each chunk cut in two, the loss span with the first part
    half = F.floor(F.length("chunk") / 2).cast("int")
    a = again.select("conv_id", (F.col("seq") * 2).alias("seq"), "role", F.substring("chunk", F.lit(1), half).alias("chunk"), "loss_start", "loss_end")
    b = again.select("conv_id", (F.col("seq") * 2 + 1).alias("seq"), "role", F.substring("chunk", half + 1, F.length("chunk")).alias("chunk"),
                     F.lit(None).cast("long").alias("loss_start"), F.lit(None).cast("long").alias("loss_end"))
    assert sorted(chat.read_back(a.unionByName(b)).collect()) == want


# fingerprints


def _paragraphs(text):
    return {p.strip(" ") for p in re.split(r"\n+|(?<=[.!?])[ \t]+", text)} - {""}


def _like(a, b):
    a, b = _paragraphs(a), _paragraphs(b)
    return len(a & b) / max(len(a), len(b)) if a or b else 1.0


def test_fingerprint_query_against_sets(spark):
    docs = sorted((r[0], r[1] or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries()["op6_document_fingerprints"](spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    by_text = defaultdict(set)
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(_like(text, edited)) and r.near_next == pytest.approx(_like(text, after))
        by_text[text].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_every_sentence_is_a_paragraph(make_docs):
    text = "The a. This b. They c. We d. You e. What f. Some g. None h."
    row = fingerprints.fingerprint_edits(make_docs([(1, text), (2, "x" * 100)])).where("doc_id = 1").first()
    assert row.fingerprint.split(";")[1] == "8" and row.near_edited == 6 / 8


def test_sketches_peel_to_the_true_difference(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for n, d in [(0, 0), (5, 0), (5, 3), (40, 10), (40, 80), (300, 200), (3000, 4000)]:
        keys = rng.integers(-(2**62), 2**62, n + d).tolist()
        pairs.append((keys[:n] + keys[n : n + d // 2], keys[:n] + keys[n + d // 2 :], d))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, d int")
    ea, eb = fingerprints.entries(F.col("a")), fingerprints.entries(F.col("b"))
    both = F.concat(ea, fingerprints.entries(F.col("b"), -1))
    first = fingerprints._subtracted(fingerprints.block(ea), fingerprints.block(eb))
    rows = df.select("d", fingerprints.differing(both, first, F.col("a"), F.col("b")).alias("got"), fingerprints.peeled(first).alias("one")).collect()
    assert all(r.d == r.got for r in rows)
    assert all(r.one in (None, r.d) for r in rows) and rows[1].one == 0 and rows[2].one == 3


def test_fingerprint_odd_rows(odd, make_docs, none):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alone = fingerprints.fingerprint_edits(make_docs([(5, "One. Two. Three. Four.")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 22
    assert fingerprints.fingerprint_edits(none).count() == 0
