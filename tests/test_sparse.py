import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.operators import sparse


def brute_weights(texts):
    counts = {i: Counter(w for w in t.lower().split() if len(w) > 1) for i, t in texts.items() if t}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for i, c in counts.items():
        raw = {w: n * (math.log((1 + len(counts)) / (1 + df[w])) + 1) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {w: x / length for w, x in raw.items()}
    return out


def brute_neighbours(weights, k, threshold):
    found = set()
    for i, a in weights.items():
        scored = []
        for j, b in weights.items():
            if i != j:
                cos = round(sum(x * b.get(w, 0.0) for w, x in a.items()), sparse.DECIMALS)
                if cos > threshold:
                    scored.append((-cos, j))
        found |= {(i, j) for _, j in sorted(scored)[:k]}
    return found


def texts_with_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(120)]
    texts = {}
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        if i % 3 and texts:
            words = texts[rng.choice(list(texts))].split()
            if i % 3 == 1:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    return texts


def vectors_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    return sparse.sparse_vectors(sparse.word_weights(docs))


def test_weights_equal_a_plain_reading(spark):
    texts = {1: "One two two a", 2: "two three", 3: "", 4: None, 5: "b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["word"]): r["weight"] for r in sparse.word_weights(docs).collect()}
    want = {(i, w): x for i, c in brute_weights(texts).items() for w, x in c.items()}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in want)


@pytest.mark.parametrize("threshold, k, tile", [(0.92, 10, 512), (0.7, 3, 4), (0.3, 5, 16)])
def test_neighbours_equal_brute_force(spark, threshold, k, tile):
    texts = texts_with_copies(int(threshold * 100), 150)
    vectors = vectors_of(spark, texts).persist()
    found = {(r["id"], r["other"]) for r in sparse.sparse_neighbours(vectors, k, threshold, tile).collect()}
    assert found == brute_neighbours(brute_weights(texts), k, threshold)
    assert len(found) > 50


def test_a_group_of_copies_meets_in_tiles(spark):
    texts = {i: "same old story told again" for i in range(60)} | {100: "another one entirely", 101: ""}
    rows = sparse.sparse_neighbours(vectors_of(spark, texts), 4, 0.9, tile_rows=8)
    assert {(r["id"], r["other"]) for r in rows.collect()} == brute_neighbours(brute_weights(texts), 4, 0.9)
    assert rows.filter(F.col("id") >= 100).count() == 0


def test_prefix_leaves_less_than_the_threshold():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 50)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    weights = rng.random(starts[-1])
    for a, b in zip(starts[:-1], starts[1:]):
        weights[a:b] /= np.linalg.norm(weights[a:b])
    lengths = sparse.prefix_lengths(weights, starts, 0.8)
    for a, b, n in zip(starts[:-1], starts[1:], lengths):
        assert 1 <= n <= b - a
        assert np.linalg.norm(weights[a + n : b]) < 0.8 <= np.linalg.norm(weights[a + n - 1 : b]) + 1e-9


def test_thresholds_without_prefix_are_refused(spark):
    with pytest.raises(ValueError):
        sparse.sparse_neighbours(vectors_of(spark, {1: "aa bb"}), 3, 0.0)


def test_long_texts_that_share_rare_words(spark):
    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randrange(900)}" for _ in range(400)) for i in range(60)}
    texts |= {100 + i: texts[i] + " tail" for i in range(30)}
    found = sparse.sparse_neighbours(vectors_of(spark, texts).persist(), 5, 0.92, 16)
    assert {(r["id"], r["other"]) for r in found.collect()} == brute_neighbours(brute_weights(texts), 5, 0.92)


def test_repeated_ids_count_as_one_document(spark):
    rows = [(1, "red blue"), (1, "blue green"), (2, "red red"), (3, None)]
    got = {(r["doc_id"], r["word"]): r for r in sparse.word_weights(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    want = brute_weights({1: "red blue blue green", 2: "red red", 3: ""})
    assert {key: pytest.approx(r["weight"]) for key, r in got.items()} == {(i, w): x for i, c in want.items() for w, x in c.items()}
    assert got[1, "red"]["df"] == 2


def nested_vectors_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING").repartition(3)
    return sparse.sparse_vectors(sparse.word_weights(docs, nested=True))


def test_nested_weights_equal_long_ones(spark, monkeypatch):
    monkeypatch.setattr(sparse, "CHUNK_WORDS", 200)  # many chunks
    texts = texts_with_copies(3, 80) | {500: None, 501: "", 502: "a b", None: "null ids count for words"}
    for rows in (list(texts.items()), [*texts.items(), (7, "further words of seven")]):  # ids that repeat too
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
        nested = sparse.sparse_vectors(sparse.word_weights(docs, nested=True)).filter("id IS NOT NULL").collect()
        want = sparse.sparse_vectors(sparse.word_weights(docs)).filter("id IS NOT NULL").collect()
        assert {r["id"]: r["ranks"] for r in nested} == {r["id"]: r["ranks"] for r in want} and len(nested) == 80
        weights = {r["id"]: r["weights"] for r in want}
        assert all(r["weights"] == pytest.approx(weights[r["id"]]) for r in nested)


def test_words_are_not_sent_to_each_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sparse, "PIECE_ROWS", 3)
    monkeypatch.setattr(sparse, "CELLS", 50)
    texts = texts_with_copies(11, 120)
    found = sparse.sparse_neighbours(nested_vectors_of(spark, texts), 4, 0.8, tile_rows=10)
    assert {(r["id"], r["other"]) for r in found.collect()} == brute_neighbours(brute_weights(texts), 4, 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_replicate_nl" in plan  # blocks are read by the tasks that need them
