"""Pivot index, periodic runs and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidings.llm import conversation_repair, periodic_runs, pivot_index
from tidings.llm.common import table
from tidings.llm.queries import QUERIES, damaged, with_repeats

SMALL = "/root/testdata/sf0.001"


# --- periodic runs


def brute_runs(words):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], int)
    n, found = len(ids), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        for a, b in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            length = b - a + q
            run = ids[a : a + length]
            if length >= max(6, 4 * q) and not any(np.array_equal(run[d:], run[:-d]) for d in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def repeating_words(rng, n, letters):
    words = [rng.choice("abcdefgh"[:letters]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n), rng.randint(1, 12)
        words = words[:a] + words[a : a + p] * rng.randint(2, 7) + words[a + p :]
    return words


def test_runs_equal_brute_force_on_random_words():
    rng, met = random.Random(7), 0
    for _ in range(400):
        words = repeating_words(rng, rng.randint(1, 60), rng.choice([1, 2, 2, 3, 4, 8]))
        runs = periodic_runs.runs_of(periodic_runs.word_ids([w.encode() for w in words]))
        assert runs == brute_runs(words), words
        met += len(runs)
    assert met > 300


@pytest.mark.parametrize("n, p", [(6, 1), (7, 2), (8, 2), (5000, 1), (4097, 1), (5000, 7), (5003, 1250), (20_000, 3333)])
def test_one_long_run(n, p):
    base = [b"%d" % i for i in range(p)]
    words = [base[i % p] for i in range(n)]
    found = periodic_runs.runs_of(periodic_runs.word_ids(words))
    assert found == ([(0, n, p)] if n >= max(6, 4 * p) else [])


def test_words_without_repeats_and_of_two_letters():
    assert periodic_runs.runs_of(np.arange(30_000)) == []
    rng = random.Random(3)
    words = ["".join(rng.choice("ab")) for _ in range(1500)]
    assert periodic_runs.runs_of(periodic_runs.word_ids([w.encode() for w in words])) == brute_runs(words)


def test_rules_cover_the_text_and_pairs_of_the_grammar_are_equal():
    rng = random.Random(5)
    words = repeating_words(rng, 80, 3)
    _, t = np.unique(np.array(words), return_inverse=True)
    sizes = []
    for left, size, positions in periodic_runs.rules(t):
        parts = {tuple(t[p : p + size].tolist()) for p in positions.tolist()}
        assert len(parts) == 1 and 0 < left < size
        sizes.append(size)
    assert max(sizes) == len(words)


def test_periodic_runs_of_rows(spark):
    texts = [None, "", " \t\r\n ", "a a a a a a b", "x y " * 6, "á b c " * 5, "word " * 4000, "a a a a a a b"]
    rows = [(i if i else None, t, "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    found = periodic_runs.periodic_runs(docs).collect()
    assert len(found) == len(texts)
    by_text = dict(zip(texts, texts, strict=True))
    by_id = {r["doc_id"]: r for r in found}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(words)
        row = by_id[i if i else None]
        assert [tuple(r) for r in row["runs"]] == runs and row["n_words"] == len(words)
        assert row["collapsed"] == " ".join(brute_collapsed(words, runs))
    assert by_id[3]["collapsed"] == "a b" and by_text
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def repeated_tail(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12_query(spark):
    want = {}
    for doc_id, text in table(spark, SMALL, "documents").select("doc_id", "text").collect():
        words = repeated_tail(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = brute_runs(words)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = None if q is None else 1000 * length // q
        lines = "".join(f"{a},{m},{p}\n" for a, m, p in runs)
        kept = " ".join(brute_collapsed(words, runs))
        want[doc_id] = (len(runs), s, length, q, exponent, digest(lines), digest(kept))
    got = QUERIES["op12_periodic_runs"](spark, SMALL)
    assert {r[0]: tuple(r)[1:8] for r in got.collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 5


def test_repeats_leave_rows_without_id_or_text(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, None), (None, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, with_repeats(docs).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


# --- conversation repair


def brute_repair(symbols):
    """Least (cost, audit) by a forward search over the states of the role order."""
    after_write = {0: 2, 1: 2, 2: 3, 3: 2}

    def put(best, state, value):
        if state not in best or value < best[state]:
            best[state] = value

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                put(best, after_write[state], (cost + 3, audit + "I"))
        return best

    best = {0: (0, "")}
    for symbol in symbols:
        best, now = inserted(best), {}
        for state, (cost, audit) in best.items():
            put(now, state, (cost + 4, audit + "D"))
            if symbol != 8:
                extra = 3 * (symbol // 4)
                kept = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((symbol % 4, state))
                if kept:
                    put(now, kept, (cost + extra, audit + "K"))
                put(now, after_write[state], (cost + 3 + extra, audit + "R"))
        best = now
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_cheapest_edits_equal_brute_force(block):
    tables, rng = conversation_repair.block_tables(block), random.Random(block)
    for n in range(4):
        for symbols in itertools.product(range(9), repeat=n):
            assert conversation_repair.cheapest_edits(tables, bytes(symbols)) == brute_repair(symbols)
    for _ in range(1500):
        symbols = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8, 1, 2, 1, 2, 4, 7]) for _ in range(rng.randint(4, 30)))
        assert conversation_repair.cheapest_edits(tables, symbols) == brute_repair(symbols)


def test_a_very_long_conversation_is_priced_by_blocks():
    symbols = bytes([1, 2] * 50_000)
    assert conversation_repair.cheapest_edits(conversation_repair.block_tables(), symbols) == (0, "K" * 100_000)


def brute_conversation(rows):
    """The contract for one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, counts, symbols = set(), [0, 0, 0], []
    for _, role, text in rows:
        content = text.rstrip(" \t\n\r\x0b\x0c")
        place = "sua".find(role[:1]) if role[:1] else 3
        place = place if place >= 0 else 3
        if not content:
            counts[0] += 1
            symbols.append(8)
        elif (role, text) in seen:
            counts[1] += 1
            symbols.append(8)
        elif content[-1] not in ".!?":
            counts[2] += 1
            symbols.append(4 + place)
        else:
            symbols.append(place)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = brute_repair(symbols)
    lines, left, last = [], iter(rows), ""
    for letter in audit:
        _, role, text = next(left) if letter != "I" else (0, "", "")
        if letter in "IR":
            role = "assistant" if last == "u" else "user"
        if letter != "D":
            lines.append(f"{role}:{text}")
            last = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    return (gaps, *counts, illegal, cost, audit, digest("\n".join(lines)))


def brute_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        spaced = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(spaced.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)


def check_repair(turns, rows, got):
    by_conv = defaultdict(list)
    for conv, *row in rows:
        by_conv[conv].append(tuple(row))
    want = {conv: brute_conversation(by_conv[conv]) for conv in turns}
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


def test_op13_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, SMALL).collect()
    check_repair({r[0] for r in rows}, brute_damage(rows), got)
    assert sum(r["cost"] > 0 for r in got) > 3


def test_op13_rows_of_all_kinds(spark):
    rng = random.Random(11)
    texts = [None, "", " \n\t", "Yes.", "No!", "cut", "cut \n", "Ends?  ", " ", ".", "dots... ", "Yes."]
    roles = [None, "", "user", "assistant", "system", "tool", "u", "assistant", "user"]
    # Equal turns are left out here: their order is the operator's own.
    rows = []
    for conv in [None, *range(-20, 60)]:
        turns = rng.sample([None, *range(-3, 12)], rng.randint(1, 9))
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    schema = "conv_id bigint, turn bigint, role string, text string, code int, h1 string, cost double"
    frame = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], schema)
    got = conversation_repair.repair(damaged(frame), frame).collect()
    check_repair({r[0] for r in rows}, brute_damage(rows), got)
    assert conversation_repair.repair(frame.limit(0)).collect() == []


def test_repeated_rows_and_one_long_conversation(spark):
    rows = [("c", 1, "user", "Hi.")] * 5 + [("c", 2, "assistant", "Yes.")] * 3
    rows += [("d", t, ("user", "assistant")[t % 2], f"{t}. " + "long " * 2000 + ".") for t in range(600)]
    rows += [("d", 10, "user", "10. " + "long " * 2000 + ".")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = {r["conv_id"]: r for r in conversation_repair.repair(frame).collect()}
    assert found["c"]["audit"] == "KDDDDKDD" and found["c"]["duplicate"] == 6 and found["c"]["illegal"] == 6
    assert found["c"]["repaired_sha256"] == digest("user:Hi.\nassistant:Yes.")
    assert found["d"]["cost"] == 4 and found["d"]["audit"].count("K") == 600
    turns = conversation_repair.repaired_turns(frame).where("conv_id = 'd'").orderBy("at").collect()
    lines = [f"{r['role']}:{r['text']}" for r in turns]
    assert len(lines) == 600 and digest("\n".join(lines)) == found["d"]["repaired_sha256"]


# --- pivot index


def brute_links(rows, similar=0.98):
    usable = []
    for i, v, label in rows:
        bad = i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v)
        usable.append(None if bad else (label, len(v), np.array(v, np.float32).astype(float)))
    links = defaultdict(set)
    by_key = defaultdict(list)
    for at, u in enumerate(usable):
        if u:
            by_key[u[:2]].append(at)
    for members in by_key.values():
        x = np.array([usable[at][2] for at in members])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= similar), strict=True):
            if a != b:
                links[members[a]].add(members[b])
    return links


def components(rows, links):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, others in links.items():
        for b in others:
            root[find(a)] = find(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return [least.get(find(i)) for i in range(len(rows))]


def crowded(rng, n, dim, labels=2):
    """Vectors with a crowd of near copies, chains, pairs just around the threshold, and lone ones."""
    out, centre = [], rng.normal(size=dim)
    for i in range(n):
        kind, v = i % 4, rng.normal(size=dim)
        if kind == 0:
            v = centre + 0.03 * rng.normal(size=dim)
        elif kind == 1 and out:
            v = np.array(out[rng.integers(len(out))][1]) + 0.2 * rng.normal(size=dim)
        elif kind == 2 and out:
            v = np.array(out[rng.integers(len(out))][1]) * rng.uniform(0.1, 9)
        out.append((i, [float(x) for x in np.float32(v)], int(rng.integers(labels))))
    return out


@pytest.mark.parametrize("dim, tile", [(64, 2048), (16, 50), (3, 40)])
def test_links_equal_brute_force(spark, dim, tile):
    rng = np.random.default_rng(dim)
    rows = crowded(rng, 700, dim)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(frame, tile_rows=tile).collect()}
    links = brute_links(rows)
    parts = components(rows, links)
    total = sum(map(len, links.values()))
    found = sum(r["n_links"] for r in got.values())
    assert total > 5000
    # No link is made up, and nearly none is missed.
    assert all(got[i]["n_links"] <= len(links[i]) for i, *_ in rows)
    assert found >= 0.99 * total
    if found == total:
        assert [got[i]["component_id"] for i, *_ in rows] == parts
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of exactly about 0.98, the hardest ones, in random directions."""
    rng, rows = np.random.default_rng(4), []
    for i in range(0, 1200, 2):
        v = rng.normal(size=64)
        u = rng.normal(size=64)
        v /= np.linalg.norm(v)
        u -= (u @ v) * v
        w = 0.981 * v + (1 - 0.981**2) ** 0.5 * u / np.linalg.norm(u)
        rows += [(i, v.tolist(), 0), (i + 1, w.tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    linked = pivot_index.near_vectors(frame).where("n_links > 0").count()
    assert linked >= 0.97 * len(rows)


def test_vectors_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0),
        (7, [nan, 1.0], 0), (8, [None, 1.0], 0), (9, [inf, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0),
        (11, [1.0, 0.0], 1), (12, [-1.0, 0.0], 0), (2, [2.0, 0.0], 0), (13, [1e-30, 0.0], 0), (14, [1e30, 1e29], 0),
    ]
    schema = "vec_id bigint, embedding array<float>, label int, node string, links int, h1 int"
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    got = pivot_index.near_vectors(frame).collect()
    links, parts = brute_links(rows), components(rows, brute_links(rows))
    want = sorted((r[0] or 0, len(links[i]), parts[i] or 0, r[0] == parts[i]) for i, r in enumerate(rows))
    assert sorted((r[0] or 0, r[1], r[2] or 0, r[3]) for r in got) == want
    assert pivot_index.near_vectors(frame.limit(0)).collect() == []
