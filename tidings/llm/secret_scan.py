"""Secrets in whole texts: fixed patterns, and random strings that a tokenizer finds hard to pack.

A vocabulary learnt from language packs words into few tokens; keys and passwords fall apart into
many. Strings of at least ``MIN_CHARS`` letters, digits and signs whose characters per token stay at
or below ``MAX_CHARS_PER_TOKEN`` are reported as ``random``, unless they are known digests or plain
identifiers or overlap a span that a fixed pattern has found.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import as_texts, broadcast_file

#: Kinds of spans, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 20
MAX_CHARS_PER_TOKEN = 2.2

# Fixed patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
#: Hexadecimal digests by their usual lengths, and UUIDs: known identifiers, not secrets.
DIGEST = re.compile(
    r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})"
)
#: Words and numbers joined by signs, as in names, paths and versions.
IDENTIFIER = re.compile(r"(?:[+/_=-]*+(?:[A-Za-z]++[0-9]{0,4}+|[0-9]++)(?![A-Za-z0-9]))*+[+/_=-]*+")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

_encodings: dict[str, tiktoken.Encoding] = {}


def known_encoding(key: str, file: Broadcast, pattern: str) -> tiktoken.Encoding:
    """This Python worker's encoding of a rank file; it outlives a task."""
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.value.splitlines())}
        _encodings[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(
    text: str, base: list[tuple[int, int, int]], encoding: tiktoken.Encoding
) -> list[tuple[int, int, int]]:
    """Spans of strings with few characters per token, away from the base spans."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m.group()
        if not (DIGIT.search(word) and LETTER.search(word)):
            continue
        if DIGEST.fullmatch(word) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        if len(word) > MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(word)) or IDENTIFIER.fullmatch(word):
            continue
        found.append((m.start(), 3, m.end()))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


SPANS = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:string,spans:string>"


def secret_spans(text: Column, key: str, file: Broadcast, pattern: str) -> Column:
    """Counts and lists of the spans of a text column."""

    @F.arrow_udf(SPANS)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = known_encoding(key, file, pattern)
        for batch in batches:
            rows = []
            for t in as_texts(batch):
                base = base_spans(t)
                kinds = [kind for _, kind, _ in base]
                spans = listed(base + random_spans(t, base, encoding))
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), listed(base), spans))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.StructArray.from_arrays(arrays, names=["n_assign", "n_access", "n_hex", "base", "spans"])

    return scanned(text)


def scan_secrets(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None
) -> DataFrame:
    """Secret spans of every row, as ``kind:start:end`` lists in code points (end exclusive).

    One pass without a shuffle. ``vocabulary``: path of a tiktoken rank file on the driver. A null
    text counts as empty; rows without spans have counts 0 and empty lists; null ids and repeated rows
    are kept as they are; other columns are not read; an empty table gives an empty result.
    """
    key, file = broadcast_file(docs.sparkSession, vocabulary)
    spans = secret_spans(F.col(text_col), key, file, pattern or public_tokenizers.PATTERN)
    return docs.select(F.col(id_col), spans.alias("found")).select(
        id_col,
        "found.n_assign",
        "found.n_access",
        "found.n_hex",
        F.sha2("found.base", 256).alias("base_sha256"),
        "found.spans",
    )
