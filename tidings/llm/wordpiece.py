"""Pre-tokens of white-space separated chunks, as the lower-casing word-end BPE file cuts them.

White space is dropped by that tokenizer, and neither its normaliser nor its pattern looks across
white space, so a text's tokens are the tokens of its chunks in order. Chunks of printable ASCII and
Latin-1 letters are cut here; any other chunk is left to the library's own normaliser. Most chunks are
a word and its stops: of those, whole Arrow columns are cut at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Only characters whose composed form, lower case and class are beyond doubt.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: The file's pattern for plain, lower-cased chunks (fixed by the file).
CUT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
)
#: The letters and the other characters of plain chunks, without digits.
LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and PLAIN.match(c))
STOPS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())


def words_and_stops(chunks: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Lower-cased letters in front and stops behind, and whether a chunk is no more than these two.

    Such a chunk's pre-tokens are its letters and its stops, if any: the pattern's short forms begin with
    a stop and go on with letters, and so do special strings.
    """
    words, stops = pc.utf8_rtrim(chunks, STOPS), pc.utf8_ltrim(chunks, LETTERS)
    both = pc.add(pc.binary_length(words), pc.binary_length(stops))
    return pc.utf8_lower(words), stops, pc.equal(both, pc.binary_length(chunks))


class Remembered(dict):
    """Values that ``make`` makes from their keys, for at most two generations of ``size`` keys.

    A full generation becomes the old one; keys still in use move on to the new one. Keys longer than
    ``longest`` are not remembered, which bounds the bytes held as well.
    """

    def __init__(self, make: Callable, size: int, longest: int = 48) -> None:
        super().__init__()
        self.make, self.size, self.longest = make, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return table


def model_of(file: bytes) -> dict:
    """Vocabulary, merges and suffix of the file."""
    return json.loads(file)["model"]


class Cutter:
    """Cuts chunks into pre-tokens written in byte letters; special strings come out by themselves."""

    def __init__(self, file: bytes) -> None:
        self.tokenizer = Tokenizer.from_buffer(file)
        self.specials = {t["content"]: t["id"] for t in json.loads(file)["added_tokens"]}
        self.letters = byte_letters()
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        # Takes spelled pre-tokens as they are, and remembers none: those it is given are all different.
        model = model_of(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        self.merging = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=suffix))
        self.merging.pre_tokenizer = WhitespaceSplit()
        # One model for both, held once.
        self.tokenizer.model = self.merging.model
        #: Whether an id ends a pre-token.
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each spelled pre-token has, and all ids; empty pre-tokens have none."""
        ids = self.merging.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids
        flat = np.array(ids, np.int32)
        sizes = np.zeros(len(pieces), np.int64)
        # Only a pre-token's last id ends a word.
        sizes[[p != "" for p in pieces]] = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        return sizes, flat

    def pieces(self, chunk: str) -> list[str] | None:
        """Pre-tokens of a plain chunk without special strings, None for any other chunk."""
        if chunk.isascii():
            # Most chunks are a word, or a word and its stop.
            core = chunk.rstrip(".,;:!?|")
            if core.isalpha():
                core = core.lower()
                return [core] if len(core) == len(chunk) else [core, chunk[len(core) :]]
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            return None
        cut = CUT.findall(chunk.lower())
        return cut if chunk.isascii() else [self.spelled(p) for p in cut]

    def spelled(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))

    def all_pieces(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of any chunk, and how many special strings stand in it."""
        cut = self.pieces(chunk)
        if cut is not None:
            return cut, 0
        parts = self._special.split(chunk)
        cut = []
        for part in parts[::2]:
            shaped = self.tokenizer.normalizer.normalize_str(part)
            cut.extend(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(shaped))
        return cut, len(parts) // 2
