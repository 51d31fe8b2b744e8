"""Token counts and token files against the tokenizers library."""

import random
import struct
import time
import zlib
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidings.llm import queries, token_counts, token_files
from tidings.llm.common import short_batches
from tidings.llm.token_files import ids_crc32, read_token_files, write_token_files
from tidings.llm.wordpiece import Cutter

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "The quick brown fox. It's (not) they'RE 12,345 héllo ÀÉÎ ß naïve",
    "",
    "   \n\t ",
    "<|endoftext|> a<|startoftext|>b <|endoftext|><|endoftext|> <|end",
    "日本語 テスト mixed日本 Ünïcödé ﬁ ǅ İstanbul ΣΑΣ",
    "é ́x a b c\u0085d\x1ce\x00f",
    "x" * 3000 + " " + "ab" * 500,
    "!!! ??? ... $$$%%% '''s 's't",
    "🙂🙃 a🙂b ​‍",
    "aaaaaaa aaaa hahahahaha mississippi",
]


@pytest.fixture(scope="module")
def counter():
    return token_counts.new_counter("test", Path(PATH).read_bytes())


@pytest.fixture(scope="module")
def ids():
    return token_files.ChunkIds(Cutter(Path(PATH).read_bytes()))


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(ids, text):
    packed = ids.packed(text.encode())
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_counts_and_ids_equal_the_library(counter, ids):
    assert counter.count([t.encode() for t in TEXTS]) == [len(expected(t)) for t in TEXTS]
    assert [encoded(ids, t) for t in TEXTS] == [expected(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinst' .,!<|>\n1É"))))
def test_any_text(counter, ids, text):
    assert counter.count([text.encode()]) == [len(expected(text))]
    assert encoded(ids, text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdeinthos", min_size=1, max_size=40), max_size=8))
def test_merging_in_steps_equals_the_model(counter, words):
    counted = counter.merger.counts(words)
    assert counted.tolist() == [len(LIBRARY.model.tokenize(w)) for w in words]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeinthosx", min_size=1, max_size=200))
def test_merging_by_places_equals_the_model(counter, word):
    assert counter.merger.long_count(counter.merger.symbols(word)) == len(LIBRARY.model.tokenize(word))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "aeinst", "ab", "x"])
def test_long_words_are_counted_in_seconds(counter, letters):
    rng = random.Random(len(letters))
    word = "".join(rng.choice(letters) for _ in range(200_000))
    start = time.process_time()
    assert counter.count([word.encode()]) == [len(expected(word))]
    assert time.process_time() - start < 5


def test_long_chunks_are_not_remembered(counter, ids):
    counter.clear()
    ids.clear()
    rng = random.Random(5)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(40)]
    for text in texts:
        assert counter.count([text.encode(), b"short"]) == [len(expected(text)), 1]
        assert encoded(ids, text) == expected(text)
    counter.learn([])
    held = [*counter.chunks, *counter.pieces, *ids.chunks, *ids.chunks.old, *ids.pieces, *ids.pieces.old]
    assert max(map(len, held)) <= token_counts.REMEMBERED_BYTES


def test_remembered_counts_are_bounded(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    texts = [f"word{i} other{i}".encode() for i in range(20)]
    assert counter.count(texts, step=2) == [len(expected(t.decode())) for t in texts]
    assert len(counter.chunks) <= 3 + 4


def test_remembered_ids_are_bounded(ids, monkeypatch):
    monkeypatch.setattr(ids.chunks, "size", 3)
    monkeypatch.setattr(ids.pieces, "size", 2)
    for text in ("one two three four five six seven", "one, two. three! one two", "SEVEN six five"):
        assert encoded(ids, text) == expected(text)
    assert len(ids.chunks) <= 3 and len(ids.pieces) <= 2


def test_plain_pieces_are_the_librarys(counter):
    cutter = Cutter(open(PATH, "rb").read())
    for chunk in ("It's", "NAÏVE?!", "a1b2", "''s", "x'll-'d", "Word.", "end?!|", "it's.", "..", "a", "B,"):
        shaped = LIBRARY.normalizer.normalize_str(chunk)
        assert cutter.pieces(chunk) == [p for p, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(shaped)]


def test_count_tokens_rows(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (None, "x", 9), (2, None, 9), (3, "word " * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted(
        [(1, 3, 2, False)] * 2 + [(None, 1, 1, False), (2, 0, 0, False), (3, 15000, 3000, True)], key=str
    )
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS shard", "2 AS start")
    path = f"file://{tmp_path}/ids"
    write_token_files(docs.repartition(7), path, PATH, end_id=2)
    got = read_token_files(spark, path).withColumn("crc", ids_crc32("tokens")).collect()
    got.sort(key=lambda r: r.start)
    assert len(got) == len(rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    start = 0
    by_id = dict(rows[: len(TEXTS)])
    for r in got:
        assert r.start == start and r.n_tokens == len(r.tokens)
        assert r.crc == zlib.crc32(struct.pack(f"<{len(r.tokens)}I", *r.tokens))
        if r.doc_id in by_id:
            assert r.tokens == [*expected(by_id[r.doc_id]), 2]
        start += r.n_tokens
    assert sorted(len(r.tokens) for r in got if r.doc_id == 100) == [1, 2]


def test_token_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    write_token_files(docs, f"file://{tmp_path}/none", PATH, end_id=2)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_file_layout_allows_selective_reads(spark, tmp_path):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    path = f"{tmp_path}/layout"
    write_token_files(docs.coalesce(1), f"file://{path}", PATH, end_id=2, layout={"parquet.block.size": "65536"})
    files = sorted(p for p in Path(path).glob("part-*.parquet") if p.stat().st_size > 2000)
    meta = pq.ParquetFile(files[0]).metadata
    by_name = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(5)}
    tokens = next(v for k, v in by_name.items() if k.startswith("tokens"))
    assert any("DICTIONARY" in e for e in tokens.encodings)
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert by_name["doc_id"].has_column_index and by_name["doc_id"].has_offset_index
    some = read_token_files(spark, f"file://{path}").where("doc_id = 17").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and some.count() == 1
    scans = [line for line in plan.splitlines() if "FileScan" in line or "ReadSchema" in line]
    assert not any("tokens:array" in line for line in scans)


@pytest.mark.parametrize("remembered", [1, 50])
def test_files_do_not_depend_on_what_is_remembered(spark, tmp_path, remembered):
    texts = [None, "", "One two, one TWO three. " * 30, "é" * 300, " ".join(f"w{i}x" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    digests = []
    for name, options in (("plain", {}), ("short", {"remembered": remembered})):
        path = str(tmp_path / name)
        token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2, **options)
        read = token_files.read_token_files(spark, path)
        digests.append(sorted(map(str, read.select("doc_id", "start", "tokens").collect())))
    assert digests[0] == digests[1] and len(digests[0]) == len(texts)


def test_short_batches_leave_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), short_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before
    spark.conf.set(name, "3")
    try:
        with short_batches(spark, 7):
            assert spark.conf.get(name) == "3"
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.unset(name)


def listed(ids, texts):
    return ids.lists(pa.array(texts, pa.string()), 2).to_pylist()


def test_texts_together_have_the_librarys_ids(ids):
    odd = ["a\x1cb\x85c\x1dd", "\vword,\fWORD;\r", "...", "l'été's ÀÉß!!", "'s a's a!'s <| <|x a<|", "İ K Å ẞ ſ é."]
    texts = [*TEXTS, None, *odd, *TEXTS[:3]]
    assert listed(ids, texts) == [[*expected(t or ""), 2] for t in texts]
    cut = pa.array(texts, pa.string()).slice(3, 9)
    assert ids.lists(cut, 2).to_pylist() == [[*expected(t or ""), 2] for t in texts[3:12]]
    assert listed(ids, []) == [] and listed(ids, [None, " "]) == [[2], [2]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinst' .,!<|>\n1ÉÀß"))), max_size=5))
def test_any_texts_together(ids, texts):
    assert listed(ids, texts) == [[*expected(t), 2] for t in texts]


def test_a_word_is_merged_once_for_all_its_copies(monkeypatch):
    ids = token_files.ChunkIds(Cutter(Path(PATH).read_bytes()))
    merged = []
    once = ids.cutter.merged
    monkeypatch.setattr(ids.cutter, "merged", lambda pieces: merged.extend(pieces) or once(pieces))
    texts = ["Word, word! other word", "OTHER, café... word, " * 50, "word"]
    assert listed(ids, texts) == [[*expected(t), 2] for t in texts]
    assert len(merged) == len(set(merged)) and {"word", "other", ",", "cafÃ©"} <= set(merged)
    # None of these words was cut or merged by itself.
    assert not [c for c in (*ids.chunks, *ids.pieces) if c in (b"word,", b"word!", "word")]


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_rows_are_dealt_by_bytes(most):
    texts = ["abc", None, "", "d" * 30, "ef", "ghij", "k"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    dealt = list(token_files._by_bytes(iter([whole.slice(0, 2), whole.slice(2, 0), whole.slice(2)]), most))
    assert pa.Table.from_batches(dealt).combine_chunks().to_pylist() == whole.to_pylist()
    for batch in dealt:
        sizes = [len(t or "") for t in batch.column(1).to_pylist()]
        assert sum(sizes) - max(sizes, default=0) <= most


@pytest.mark.parametrize("most", [1, 100])
def test_files_do_not_depend_on_how_many_bytes_come_together(spark, tmp_path, monkeypatch, most):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, "One two."])], "doc_id long, text string")
    digests = []
    for name in ("plain", "cut"):
        write_token_files(docs.repartition(3), f"file://{tmp_path}/{name}", PATH, 2)
        read = read_token_files(spark, f"file://{tmp_path}/{name}")
        digests.append(sorted(map(str, read.select("doc_id", "start", "n_tokens", "tokens").collect())))
        monkeypatch.setattr(token_files, "ENCODED_BYTES", most)
    assert digests[0] == digests[1] and len(digests[0]) == len(TEXTS) + 2


def test_token_lists_are_read_back_in_short_batches(spark, tmp_path):
    """Whatever batches the session sends when the digest is used, whole token lists are not in them."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    digest = queries.token_digest(spark, docs)
    plan = digest._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "tokens" not in digest.columns
    want = {i: zlib.crc32(struct.pack(f"<{len(e) + 1}I", *e, 2)) for i, e in enumerate(map(expected, TEXTS))}
    assert {r.doc_id: r.ids_crc32 for r in digest.collect()} == want
