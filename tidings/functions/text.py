"""Text clean-up, display defaults and tokens as column expressions."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Every character that counts as white space at the ends of a field.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
# Every white space but the plain blank; runs that are a single blank already are not touched.
_OTHER_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITESPACE_RUN = f" [ {_OTHER_SPACE}]+|[{_OTHER_SPACE}][ {_OTHER_SPACE}]*"
_TAG = r"<[^>]+>"

# Entities decoded inside the JVM; anything rarer goes to the full table.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": "\xa0",
    "&copy;": "\xa9",
    "&middot;": "\xb7",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&hellip;": "…",
    "&pound;": "\xa3",
    "&euro;": "€",
    "&amp;": "&",
}
_COMMON_PATTERN = "|".join(COMMON_ENTITIES)
_ENTITY_START = r"&(#[0-9xX]|[A-Za-z])"

# Spark's own default English stop-word list.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


@F.pandas_udf(StringType())
def _decode_all_entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(html.unescape, na_action="ignore")


def strip(col: Column) -> Column:
    """Trim every kind of white space; NULL becomes the empty string."""
    return F.btrim(F.coalesce(col.cast("string"), F.lit("")), F.lit(WHITESPACE))


def collapse_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _WHITESPACE_RUN, " "))


def decode_entities(col: Column, full: bool = True) -> Column:
    """Decode HTML entities once.

    The common ones are replaced in the JVM (``&amp;`` last, so nothing is decoded twice). With
    ``full`` the rows that hold any other entity are handed, and only they, to the complete table.
    """
    decoded = col
    for entity, char in COMMON_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    plain = ~col.contains("&")
    if not full:
        return F.when(plain, col).otherwise(decoded)
    rare = F.regexp_replace(col, _COMMON_PATTERN, "").rlike(_ENTITY_START)
    handed_over = F.when(~plain & rare, col)
    return F.when(plain, col).otherwise(F.coalesce(_decode_all_entities(handed_over), decoded))


def strip_html(col: Column, full_entities: bool = True) -> Column:
    """Plain text of a fragment: entities first, then tags to blanks, then white space runs."""
    decoded = decode_entities(F.coalesce(col, F.lit("")), full_entities)
    return collapse_whitespace(F.regexp_replace(decoded, _TAG, " "))


def join_non_empty(*cols: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols])


def combine_text(title: Column, description: Column, full_entities: bool = True) -> Column:
    """Title and description as one searchable text."""
    return join_non_empty(strip_html(title, full_entities), strip_html(description, full_entities))


def display(col: Column, fallback: str | Column = "") -> Column:
    """Trimmed value, or the fallback when it is NULL or blank."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(strip(col), F.lit("")), other)


def slug(title: Column) -> Column:
    """Lower-cased word runs joined by hyphens, at most 60 characters."""
    words = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", "-")
    return F.btrim(F.substring(words, 1, 60), F.lit("-"))


def with_terms(
    df: DataFrame,
    text: str,
    output: str = "terms",
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Add the 1- and 2-grams of a text, stop words taken out before the pairs are formed.

    Spark ML's tokenizer, stop-word filter and n-gram stages run inside the JVM with hashed
    look-ups, so the cost per document grows with its number of words only.
    """
    stops = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    tokens = RegexTokenizer(
        inputCol="_text", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False, minTokenLength=2
    )
    kept = StopWordsRemover(
        inputCol="_tokens", outputCol="_kept", stopWords=stops or ["\x00"], caseSensitive=True
    )
    pairs = NGram(n=2, inputCol="_kept", outputCol="_pairs")
    prepared = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    staged = pairs.transform(kept.transform(tokens.transform(prepared)))
    return staged.withColumn(output, F.concat("_kept", "_pairs")).drop(
        "_text", "_tokens", "_kept", "_pairs"
    )


#: Rows whose terms are counted at a time, and words whose frequent terms are.
COUNTED_ROWS, COUNTED_WORDS = 256, 1 << 20
#: Share of one document that a term needs at least to be frequent in a chunk; a count has to be above 1.
RARE_SHARE = 0.1


def with_words(df: DataFrame, text: str, output: str = "words", stop_words: list[str] | None = None) -> DataFrame:
    """Add the lower-cased words of a text (null: none), without stop words if a list of them is given."""
    out = output if stop_words is None else "_tokens"
    tokens = RegexTokenizer(inputCol="_text", outputCol=out, pattern=TOKEN_PATTERN, gaps=False, minTokenLength=2)
    staged = tokens.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    if stop_words is not None:
        kept = StopWordsRemover(inputCol=out, outputCol=output, stopWords=stop_words or ["\x00"], caseSensitive=True)
        staged = kept.transform(staged).drop(out)
    return staged.drop("_text")


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that all depend on all bits of the given ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _term_hashes(keys: pa.Array, words: pa.ListArray, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of (key, term), row and first word of every term, from the hashes of keys and words."""
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    # Salted, for a key may be the same word as a term.
    own = mixed(keys.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))[row]
    flat = mixed(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    terms, at = mixed(own + flat), np.arange(len(row))
    if pairs and len(row) > 1:
        both = np.flatnonzero(row[1:] == row[:-1])
        joined = mixed(own[both] + mixed(flat[both] * np.uint64(0x9E3779B97F4A7C15) + flat[both + 1]))
        terms, row, at = np.concatenate([terms, joined]), np.concatenate([row, row[both]]), np.concatenate([at, both])
    return terms, row, at


def _frequent(pairs: bool, shares: bool, least: float):
    """Terms of rows (hash of a key, hashes of words) that hold more than ``least`` of a key's total in their chunk."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, row, _ = _term_hashes(batch.column(0), batch.column(1), pairs)
        known, code = np.unique(terms, return_inverse=True)
        size = max(1, len(known))
        if shares:
            met, tf = np.unique(row * size + code, return_counts=True)
            row, code, value = met // size, met % size, tf.astype(np.float64)
            value /= np.sqrt(np.bincount(row, value**2, batch.num_rows))[row]
        else:
            value = np.ones(len(code))
        found, own = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
        key = np.zeros(len(known), np.int64)
        key[code] = own[row]  # the hash of a term holds its key
        sums, df = np.bincount(code, value, len(known)), np.bincount(code, minlength=len(known)).astype(np.int64)
        kept = sums > np.maximum(least * np.bincount(key, sums, len(found)), RARE_SHARE if shares else 1)[key]
        missed = np.zeros(len(found))
        np.maximum.at(missed, key[~kept], sums[~kept])
        columns = [
            np.concatenate([found[key[kept]], found]), np.concatenate([known[kept].view(np.int64), np.zeros(len(found), np.int64)]),
            np.concatenate([sums[kept], np.zeros(len(found))]), np.concatenate([df[kept], np.zeros(len(found), np.int64)]),
            np.concatenate([np.zeros(kept.sum()), missed]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "term", "value", "df", "missed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COUNTED_WORDS, side="right"))
                high = max(low + 1, high)
                yield part(batch.slice(low, high - low))
                low = high

    return run


def frequent_terms(df: DataFrame, words: str, key: str, least: float, pairs: bool = False, shares: bool = False) -> DataFrame:
    """``key, term, value, df, missed``: hashes, and sums over the chunks in which a term holds more than ``least`` of a key.

    Terms that are found once only in a chunk are left out there too.

    Values are counts, or shares of a row's counts scaled to length one. The row of a key with a term of 0 has in
    ``missed`` what any term may hold at most besides its value. Only these terms travel.
    """
    hashed = df.select(F.xxhash64(key), F.transform(words, lambda w: F.xxhash64(w)))
    rows = hashed.mapInArrow(_frequent(pairs, shares, least), "key BIGINT, term BIGINT, value DOUBLE, df BIGINT, missed DOUBLE")
    return rows.groupBy("key", "term").agg(*[F.sum(x).alias(x) for x in ("value", "df", "missed")])


#: Sorted hashes of terms that may be wanted, and of keys of which all may be.
Possible = tuple[np.ndarray, np.ndarray]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _counted(pairs: bool, together: bool, only: Possible | None = None):
    """Terms of a batch (ids..., words): a row per row and term, or per value of the only id and term.

    With ``only``, hashes of the key and the words follow, and no other terms are counted.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if only is None:
            words = batch.column(batch.num_columns - 1)
            row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
            terms = words.flatten()
            if pairs and len(terms) > 1:
                beside = row[1:] == row[:-1]
                both = pc.binary_join_element_wise(terms[:-1], terms[1:], " ").filter(pa.array(beside))
                terms, row = pa.concat_arrays([terms, both]), np.concatenate([row, row[1:][beside]])
        else:
            keys = batch.column(batch.num_columns - 2)
            hashes, row, at = _term_hashes(keys, batch.column(batch.num_columns - 1), pairs)
            batch = batch.select(list(range(batch.num_columns - 2)))
            flat = batch.column(batch.num_columns - 1).flatten()
            kept = np.flatnonzero(_among(hashes, only[0]) | _among(keys.to_numpy(zero_copy_only=False), only[1])[row])
            single, both = at[kept[kept < len(flat)]], at[kept[kept >= len(flat)]]
            joined = pc.binary_join_element_wise(flat.take(pa.array(both)), flat.take(pa.array(both + 1)), " ")
            terms, row = pa.concat_arrays([flat.take(pa.array(single)), joined]), row[kept]
        coded = terms.dictionary_encode()
        size = max(1, len(coded.dictionary))
        met, tf = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, code = met // size, met % size
        share = tf / np.sqrt(np.bincount(row, tf.astype(np.float64) ** 2, batch.num_rows))[row]
        ids = [batch.column(i) for i in range(batch.num_columns - 1)]
        counts = [tf.astype(np.int64), share]
        if together:
            key = ids[0].dictionary_encode(null_encoding="encode")
            own = key.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            met, place = np.unique(own * size + code, return_inverse=True)
            df = np.bincount(place, minlength=len(met)).astype(np.int64)
            counts = [np.bincount(place, x, len(met)).astype(x.dtype) for x in counts] + [df]
            ids, row, code = [key.dictionary], met // size, met % size
        columns = [x.take(pa.array(row)) for x in ids] + [coded.dictionary.take(pa.array(code))] + [pa.array(x) for x in counts]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "term", "tf", "share", "df"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                yield part(batch.slice(start, COUNTED_ROWS))

    return run


def _counted_rows(rows: DataFrame, words: str, key: str, only: Possible | None) -> DataFrame:
    return rows if only is None else rows.withColumns({"_k": F.xxhash64(key), "_h": F.transform(words, lambda w: F.xxhash64(w))})


def term_counts(df: DataFrame, words: str, *ids: str, pairs: bool = False, only: Possible | None = None) -> DataFrame:
    """One row per row and term: ``ids..., term, tf, share``, the share of the row's counts scaled to length one.

    Terms are the words, and with ``pairs`` also two in a row. They are counted where the row lies. With ``only``,
    by hashes as ``frequent_terms`` has them for the first of the ids, other terms are left out (of shares too).
    """
    rows = df.select(*ids, words)
    kinds = ", ".join(f"`{i}` {rows.schema[i].dataType.simpleString()}" for i in ids)
    rows = _counted_rows(rows, words, ids[0], only)
    return rows.mapInArrow(_counted(pairs, False, only), f"{kinds}, term STRING, tf BIGINT, share DOUBLE")


def term_sums(df: DataFrame, words: str, key: str, pairs: bool = False, only: Possible | None = None) -> DataFrame:
    """``term_counts`` added up over the rows of one key that lie together: ``key, term, tf, share, df``."""
    rows = df.select(key, words)
    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    rows = _counted_rows(rows, words, key, only)
    return rows.mapInArrow(_counted(pairs, True, only), f"{kind}, term STRING, tf BIGINT, share DOUBLE, df BIGINT")


def term_hashes(df: DataFrame, words: str, key: str, doc: str, pairs: bool = False) -> DataFrame:
    """``term_counts`` with hashes for the key and for (key, term): ``key, doc, term, tf``."""
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                rows = batch.slice(start, COUNTED_ROWS)
                terms, row, _ = _term_hashes(rows.column(0), rows.column(2), pairs)
                known, code = np.unique(terms, return_inverse=True)
                met, tf = np.unique(row * max(1, len(known)) + code, return_counts=True)
                row = pa.array(met // max(1, len(known)))
                columns = [rows.column(0).take(row), rows.column(1).take(row), pa.array(known[met % max(1, len(known))].view(np.int64)), pa.array(tf)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "term", "tf"])

    hashed = df.select(F.xxhash64(key), doc, F.transform(words, lambda w: F.xxhash64(w)))
    return hashed.mapInArrow(run, f"key BIGINT, doc {kind}, term BIGINT, tf BIGINT")
