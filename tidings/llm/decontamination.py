"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Training words stream through the automaton, which knows at every word the longest suffix that some
item contains. Where that length reaches the window, the words of the window are hit. Items shorter
than the window count as one window of their own length.

The automaton never holds more than about ``BLOCK_WORDS`` item words: larger benchmarks are cut into
blocks, and all rows are matched against every block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import as_bytes, free_name, given_back, named, shipped, stored, unpacked

WINDOW = 10
#: Item words in one automaton (one broadcast).
BLOCK_WORDS = 100_000
#: Automata that one pass over the rows carries.
BLOCKS_IN_PASS = 4

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and turns every byte outside words into a blank.
NORMALISED = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD or 65 <= b <= 90 else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII digits, ASCII letters and all other characters beyond ASCII."""
    return text.translate(NORMALISED).split()


class ItemAutomaton:
    """Generalised suffix automaton over item words, with the items of every window."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        named = [
            (item, [self.words.setdefault(w, len(self.words)) for w in normal_words(text)]) for item, text in items
        ]
        named = [(item, words) for item, words in named if words]
        for _, words in named:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Items by the state that holds a window of full length.
        self.full: dict[int, set[str]] = {}
        #: (length, items) of short items by the state that holds them.
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for item, words in named:
            if len(words) < window:
                self._add_short(item, words)
            else:
                self._add_full(item, words)
        #: The nearest state on the way to the root that holds a short item.
        self.short_at = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.short_at[state] = state if state in self.short else self.short_at[up] if up >= 0 else -1
        self.least = min([window, *(n for found in self.short.values() for n, _ in found)])

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, target: int, w: int) -> int:
        """The state for the longest string that ends in ``w`` after ``at``, cut out of ``target``."""
        if self.length[target] == self.length[at] + 1:
            return target
        twin = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while at >= 0 and self.next[at].get(w) == target:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, self.next[at][w], w)
        return new

    def _add_short(self, item: str, words: list[int]) -> None:
        state = 0
        for w in words:
            state = self.next[state][w]
        for n, items in self.short.setdefault(state, []):
            if n == len(words):
                items.add(item)
                return
        self.short[state].append((len(words), {item}))

    def _add_full(self, item: str, words: list[int]) -> None:
        state = matched = 0
        for w in words:
            state, matched = self.step(state, matched, w)
            if matched >= self.window:
                self.full.setdefault(self.window_state(state), set()).add(item)

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """State and matched length after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def window_state(self, state: int) -> int:
        """The state that holds the matched string's last ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[str]]:
        """Spans (start, end, longest match in them) of hit words, in order, and the items found."""
        ids = list(map(self.words.get, words))
        spans: list[tuple[int, int, int]] = []
        found: set[str] = set()
        state = matched = 0
        for i, w in enumerate(ids):
            if w is None:
                state = matched = 0
                continue
            state, matched = self.step(state, matched, w)
            if matched < self.least:
                continue
            reach = 0
            if matched >= self.window:
                found |= self.full[self.window_state(state)]
                reach = matched
            at = self.short_at[state]
            while at >= 0:
                for n, items in self.short[at]:
                    if n <= matched:
                        found |= items
                        reach = max(reach, n)
                at = self.short_at[self.link[at]] if self.link[at] >= 0 else -1
            if reach:
                _join(spans, (i + 1 - reach, i + 1, reach))
        return spans, found


def _join(spans: list[tuple[int, int, int]], span: tuple[int, int, int]) -> None:
    """Add a span that ends after all others; spans that share words become one."""
    start, end, reach = span
    while spans and spans[-1][1] > start:
        a, _, r = spans.pop()
        start, reach = min(start, a), max(reach, r)
    spans.append((start, end, reach))


def merged(one: list[tuple[int, int, int]], other: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of two blocks as one ordered list."""
    out: list[tuple[int, int, int]] = []
    for span in sorted(one + other, key=lambda s: (s[1], s[0])):
        _join(out, span)
    return out


MATCH = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,"
    "spans:array<struct<first:int,last:int,longest:int>>>"
)


def _matcher(automaton: Broadcast):
    """Matches a text column against one block and adds the matches of the blocks before."""

    @F.arrow_udf(MATCH)
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        block: ItemAutomaton = unpacked(automaton)
        for texts, before in given_back(batches):
            out = []
            for text, earlier in zip(as_bytes(texts), before.to_pylist(), strict=True):
                words = normal_words(text)
                spans, found = block.match(words)
                if earlier:
                    spans = merged(spans, [(s["first"], s["last"], s["longest"]) for s in earlier["spans"]])
                    found = found | set(earlier["items"])
                out.append(
                    {
                        "n_words": len(words),
                        "n_hit": sum(b - a for a, b, _ in spans),
                        "items": sorted(found),
                        "spans": [{"first": a, "last": b, "longest": n} for a, b, n in spans],
                    }
                )
            yield pa.array(out, _MATCH_TYPE)

    return match


_MATCH_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("longest", pa.int32())]))),
    ]
)


def item_blocks(
    items: DataFrame, item_col: str, text_col: str, window: int, block_words: int
) -> Iterator[ItemAutomaton]:
    """One automaton after another; a block holds about ``block_words`` item words."""
    rows = items.where(named(item_col).isNotNull() & named(text_col).isNotNull()).select(
        named(item_col).cast("string").alias("item"), named(text_col).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and its separator take two bytes at least.
    blocks = max(1, -(-size // (2 * block_words)))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        part = rows.where(place == k).collect()
        yield ItemAutomaton(((r["item"], r["text"].encode()) for r in part), window)


def with_matches(
    docs: DataFrame,
    items: DataFrame,
    column: str = "matches",
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows with a column of matches: words, hit words, items found and hit spans (in words).

    No row is shuffled. A null text has no words; an item without an id, text or words finds nothing;
    an empty benchmark or table gives no matches. Repeated rows are matched each; the new column
    replaces one of the same name.
    """
    spark = docs.sparkSession
    result = docs.withColumn(column, F.lit(None).cast(MATCH))
    for k, block in enumerate(item_blocks(items, item_col, item_text_col, window, block_words)):
        if k and k % BLOCKS_IN_PASS == 0:
            result = stored(result, "matches")
        match = _matcher(shipped(spark, block))
        result = result.withColumn(column, match(named(text_col), named(column)))
    return result


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Words, hit words and the items found, for every row of ``docs`` (options as in ``with_matches``)."""
    text_col = options.get("text_col", "text")
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    found = with_matches(texts, items, "m", **{**options, "text_col": "text"})
    return found.select(
        F.col("id").alias(id_col),
        "m.n_words",
        "m.n_hit",
        F.size("m.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("m.items", ","), 256).alias("items_sha256"),
        (F.col("m.n_hit") > 0).alias("contaminated"),
        F.col("m.spans").alias("spans"),
    )


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between words of a span goes too."""
    shape = text.translate(NORMALISED)
    places, at = [], 0
    for word in shape.split():
        at = shape.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at : places[first][0]])
        at = places[last - 1][1]
    return b"".join([*kept, text[at:]])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    longest: int = WINDOW,
    coverage: float = 0.5,
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Cut matched spans out of the texts and drop the rows of which too much is matched.

    A span goes if its longest match reaches ``longest`` words or it holds a whole short item. A row
    goes if more than ``coverage`` of its words are hit (0: any hit). All columns stay; rows without
    hits are unchanged, null texts included.
    """
    m = free_name(docs, "_m")
    matched = with_matches(docs, items, m, text_col=text_col, **options)
    kept = matched.where(F.col(m)["n_hit"] <= coverage * F.col(m)["n_words"])
    if coverage <= 0:
        return kept.drop(m)

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, matches in given_back(batches):
            out = []
            for text, found in zip(as_bytes(texts), matches.to_pylist(), strict=True):
                spans = [(s["first"], s["last"]) for s in found["spans"]]
                out.append(without_words(text, spans).decode() if spans else text.decode())
            yield pa.array(out, pa.string())

    window = options.get("window", WINDOW)
    spans = F.filter(F.col(m)["spans"], lambda s: (s["longest"] >= longest) | (s["longest"] < window))
    narrowed = kept.withColumn(m, F.col(m).withField("spans", spans))
    text = named(text_col)
    cut_text = F.when(F.size(F.col(m)["spans"]) > 0, cut(text, F.col(m))).otherwise(text)
    return narrowed.withColumn(text_col, cut_text).drop(m)
