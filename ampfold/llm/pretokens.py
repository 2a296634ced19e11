"""Splitting text into pre-tokens exactly as the tokenizer libraries do, and bounded worker caches.

The libraries carry Unicode tables of other versions than Python's ``regex``. So the classes of letters,
numbers and white space are asked of the library itself, once per worker, and a text takes the quickest
pattern that is right for it: Latin-1 texts one of explicit ranges, texts with a character on whose class
the tables disagree one of the library's own ranges, all others the pattern as it stands.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CLASSES = (r"\p{L}", r"\p{N}", r"\s")
CHARACTERS = 0x110000


def all_characters() -> str:
    return "".join(map(chr, chain(range(0xD800), range(0xE000, CHARACTERS))))


def mask(found: str) -> np.ndarray:
    """A flag for every code point: whether it is among the characters found."""
    flags = np.zeros(CHARACTERS, dtype=bool)
    flags[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = True
    return flags


def tiktoken_class(name: str) -> np.ndarray:
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    match = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=single, special_tokens={})
    return mask(bytes(match.encode_ordinary(all_characters())).decode())


def tokenizers_class(name: str) -> np.ndarray:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(f"{name}+"), behavior="removed", invert=True)
    return mask("".join(piece for piece, _ in split.pre_tokenize_str(all_characters())))


def ranges(flags: np.ndarray) -> str:
    """The inside of a bracket class with the flagged code points."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def spelled_out(pattern: str, letters: str, numbers: str, spaces: str) -> str:
    r"""The pattern with \p{L}, \p{N}, \s and \S written as ranges."""
    pattern = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, one in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        pattern = pattern.replace(name, one)
    return pattern


class Patterns(NamedTuple):
    """A splitting pattern as the library reads it: for Latin-1 texts, for most others, for those with a character
    of the class ``odd``."""

    latin: str
    usual: str
    exact: str
    odd: str


@lru_cache(maxsize=8)
def patterns(pattern: str, class_of: Callable[[str], np.ndarray]) -> Patterns:
    """Asked once on the driver; the workers have the same libraries and get the answer."""
    characters = all_characters()
    own = [class_of(name) for name in CLASSES]
    odd = np.zeros(CHARACTERS, dtype=bool)
    for name, flags in zip(CLASSES, own, strict=True):
        odd |= flags ^ mask("".join(regex.findall(f"{name}+", characters)))
    latin = spelled_out(pattern, *(ranges(flags[:256]) for flags in own))
    return Patterns(latin, pattern, spelled_out(pattern, *map(ranges, own)), ranges(odd))


@lru_cache(maxsize=8)
def splitter(given: Patterns) -> Callable[[str], list[str]]:
    """A function that lists the matches of the pattern in a text."""
    latin, usual, exact = re.compile(given.latin).findall, regex.compile(given.usual).findall, regex.compile(given.exact).findall
    has_odd = re.compile(f"[{given.odd}]").search if given.odd else lambda text: None

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (exact if has_odd(text) else usual)(text)
        return latin(text)

    return split


#: Words that are encoded as one line; longer lines take longer for each word.
LINE = 64
# The letter of every byte in byte-level vocabularies: itself if it can be seen, else the next letter from 256 on.
_SEEN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
_LETTERS = {b: b for b in _SEEN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))} | {ord(" "): ord(" ")}


def byte_letters(words: str) -> str:
    """Words parted by blanks, with the byte-level letters of their UTF-8 bytes (the blanks stay)."""
    return words.encode().decode("latin-1").translate(_LETTERS)


class WorkerCache:
    """Values by pre-token. Those not known yet are encoded many at a time. Beyond ``limit`` entries a new
    generation begins; what it does not take from the last one is forgotten with that, which affects the speed
    alone. The ``pinned`` entries stay."""

    def __init__(self, encode: Callable[[list[str]], list], pinned: dict | None = None, limit: int = 250_000):
        self.encode, self.limit, self.pinned = encode, limit, pinned or {}
        self.known, self.last = dict(self.pinned), {}

    def values(self, pieces: list[list[str]]) -> Iterator[list]:
        """The values of each list of pieces."""
        flat = list(chain.from_iterable(pieces))
        values = list(map(self.known.get, flat))
        if None in values:
            open_ = [i for i, v in enumerate(values) if v is None]
            words = {flat[i] for i in open_}
            found = {w: self.last[w] for w in words if w in self.last}
            missing = [w for w in words if w not in found]
            found.update(zip(missing, self.encode(missing), strict=True))
            for i in open_:
                values[i] = found[flat[i]]
            if len(self.known) + len(found) > self.limit:
                self.known, self.last = dict(self.pinned), self.known
            self.known.update(found)
        at = 0
        for part in pieces:
            yield values[at : at + len(part)]
            at += len(part)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a batch in order, in lists of about ``most`` bytes (a longer text is a list of its own)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, to - at).to_pylist()
        at = to


class JsonSpec(NamedTuple):
    """What a worker needs of a ``tokenizers`` JSON file: the file, and, if its texts can be split here, the
    patterns, the file of the merges of one pre-token alone, whether texts are folded first, the special strings,
    and, if every word's last token has an end mark, a bit for each id that has it."""

    source: str
    patterns: Patterns | None = None
    piece: str = ""
    folds: bool = False
    special: tuple[tuple[str, int], ...] = ()
    last: bytes = b""


def _pattern(pre: dict) -> str | None:
    """What splits the text: the byte-level pre-tokenizer's own pattern, or that of a split before it."""
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        from public_tokenizers import PATTERN

        return PATTERN
    if pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
        split, level = pre["pretokenizers"]
        if split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
            return split["pattern"].get("Regex")
    return None


@lru_cache(maxsize=4)
def read_spec(path: str) -> JsonSpec:
    """Read on the driver. A file of an unknown build has no patterns, and whole texts go to the library."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    added, pattern = spec["added_tokens"], _pattern(spec["pre_tokenizer"])
    folds = spec["normalizer"] and [n["type"] for n in spec["normalizer"].get("normalizers", [])]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    if not pattern or not plain or folds not in (None, ["NFC", "Replace", "Lowercase"]):
        return JsonSpec(source)
    marked = bool(spec["model"]["end_of_word_suffix"]) and bool(folds)  # a word then has no blank inside
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    pre = {"type": "CharDelimiterSplit", "delimiter": " "} if marked else level  # marked words come as byte letters
    piece = json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": pre})
    special = tuple((t["content"], t["id"]) for t in added)
    flags = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
    if marked:
        flags[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
    last = np.packbits(flags).tobytes() if marked else b""
    return JsonSpec(source, patterns(pattern, tokenizers_class), piece, bool(folds), special, last)


class JsonTokenizer:
    """The tokenizer of a spec, with its pre-tokens encoded through a worker cache.

    Texts are cut at the special strings, normalised and split as the file says; every pre-token then goes to the
    library's own merges. The values are token counts, or, with a ``dtype``, the bytes of the ids.
    """

    def __init__(self, spec: JsonSpec, dtype: str | None = None, pinned: dict | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.spec, self.dtype = spec, dtype
        self._whole = None
        if spec.patterns:
            self.split = splitter(spec.patterns)
            self.piece = Tokenizer.from_str(spec.piece)
            self.cut = re.compile("(" + "|".join(re.escape(s) for s, _ in spec.special) + ")").split if spec.special else lambda t: [t]
            special = {s: self._value([i]) for s, i in spec.special}
            self.cache = WorkerCache(self._encode, (pinned or {}) | special)
            self.last = np.unpackbits(np.frombuffer(spec.last, dtype=np.uint8)).astype(bool)

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self.spec.source)
        return self._whole

    def _value(self, ids: list[int]) -> object:
        return np.array(ids, dtype=self.dtype).tobytes() if self.dtype else len(ids)

    def _encode(self, pieces: list[str]) -> list:
        if not self.dtype:
            pieces = [byte_letters(p) for p in pieces] if self.spec.last else pieces
            return [len(e) for e in self.piece.encode_batch_fast(pieces, add_special_tokens=False)]
        if not self.spec.last:
            return [self._value(e.ids) for e in self.piece.encode_batch_fast(pieces, add_special_tokens=False)]
        out, width = [], np.dtype(self.dtype).itemsize
        lines = [byte_letters(" ".join(pieces[at : at + LINE])) for at in range(0, len(pieces), LINE)]  # words, parted by their end marks
        for e in self.piece.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _folded(self, text: str) -> str:
        if not self.spec.folds:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole.normalizer.normalize_str(text)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """The text's pre-tokens, its special strings among them."""
        parts = self.cut(text)
        if len(parts) == 1:
            return self.split(self._folded(text))
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.split(self._folded(part)))]

    def values(self, texts: list[str]) -> Iterator[list]:
        """For each text, the values of its pre-tokens in order."""
        if not self.spec.patterns:
            return ([self._value(e.ids)] for e in self.whole.encode_batch(texts, add_special_tokens=False))
        return self.cache.values([self.pieces(t) for t in texts])
