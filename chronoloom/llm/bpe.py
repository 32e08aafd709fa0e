"""Byte-pair vocabularies: loading, text splitting and two ways of merging.

A vocabulary is the JSON file of a published word-level byte-pair tokenizer
(NFC, lower case, white space dropped, words ended by a suffix).  The driver
reads it once from a path given as a parameter and broadcasts the bytes: its
size is that of the published file (1.7 MB), whatever the size of the corpus.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array

import regex

#: Bytes of keys and results that a worker keeps of what it has met, about, and the longest key kept.
MEMO_BYTES, MEMO_KEY = 96_000_000, 256

#: Symbols up to which scanning for the lowest pair is the quicker way.
_SHORT = 24

# The tokenizer library's character tables are of other Unicode versions
# than Python's and regex's.  Ranges are hexadecimal code points.
#: Letters and numbers of Unicode 17, which its patterns take for other characters.
LATE_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20
 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
 11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"""
#: Marks later than its normalisation, which neither reorders nor composes them.
LATE_MARKS = """7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF
 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97
 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
#: Capitals that it makes small and Python may not yet: first, last, first small one.
LATE_CAPITALS = """1C89-1C89-1C8A A7CB-A7CB-264 A7CC-A7CC-A7CD A7CE-A7CE-A7CF A7D2-A7D2-A7D3 A7D4-A7D4-A7D5 A7DA-A7DA-A7DB
 A7DC-A7DC-19B 10D50-10D65-10D70 16EA0-16EB8-16EBB"""


def _class_of(ranges: str) -> str:
    """The ranges as the inside of a character class."""
    return "".join("-".join(rf"\U{int(end, 16):08X}" for end in r.split("-")) for r in ranges.split())


#: What the tokenizer's own pattern library counts as white space.
_SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
_LATE, _MARK = _class_of(LATE_LETTERS), regex.compile(f"([{_class_of(LATE_MARKS)}])")
_WORD = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATE}]]+|[\p{{N}}--[{_LATE}]]|[[^{_SPACE}\p{{L}}\p{{N}}]||[{_LATE}]]+"
)
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SMALL = {first + k: small + k for first, last, small in (map(lambda x: int(x, 16), r.split("-")) for r in LATE_CAPITALS.split()) for k in range(last - first + 1)}
_SMALL[ord("Σ")] = ord("σ")
#: str.split() parts text at these too, the tokenizer doesn't.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_CHUNK = regex.compile(rf"[^{_SPACE}]+")

# The steps of a tokenizer file that this module follows.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}


def check_file(spec: dict) -> None:
    """Raise unless a tokenizer file asks for just the steps that this module takes."""
    steps = lambda part, key: (spec.get(part) or {}).get(key)
    if steps("normalizer", "normalizers") != NORMALIZER or steps("pre_tokenizer", "pretokenizers") != PRE_TOKENIZER or spec.get("decoder") is not None:
        raise ValueError("the tokenizer file's normalizer, pre-tokenizer or decoder isn't one that is supported")
    if odd := [k for k, v in MODEL.items() if spec["model"].get(k, v) != v]:
        raise ValueError(f"the tokenizer file's model has unsupported settings: {odd}")
    plain = ("single_word", "lstrip", "rstrip", "normalized")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in plain):
        raise ValueError("the tokenizer file has added tokens that aren't matched literally")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte, by the published byte-level rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """Merge ranks, ids and special tokens of one tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        check_file(spec)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks: dict[tuple[str, str], int] = {(a, b): r for r, (a, b) in enumerate(pairs)}
        named = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.tokens: list[str | None] = [named.get(i) for i in range(max(named) + 1)]
        self.symbols = byte_symbols()
        self._special_cut = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.inner_pairs = self._pairs_inside_tokens()

    def _pairs_inside_tokens(self) -> set[tuple[str, str]]:
        """Adjacent byte symbols that some vocabulary token holds side by side."""
        found: set[tuple[str, str]] = set()
        for token in self.ids:
            body = token.removesuffix(self.suffix) if self.suffix else token
            found.update(zip(body, body[1:]))
        return found

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens; True marks a special token."""
        if self._special_cut is None or not any(s in text for s in self.special):
            return [(text, False)]
        return [(part, bool(i % 2)) for i, part in enumerate(self._special_cut.split(text)) if part]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Runs of text without white space; no token ever crosses their ends."""
        return _CHUNK.findall(text) if any(c in text for c in _ODD_SPACE) else text.split()

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk as byte symbols, normalised as the tokenizer does."""
        if chunk.isascii():
            return ["".join(map(self.symbols.__getitem__, w.encode())) for w in _ASCII_WORD.findall(chunk.lower())]
        norm = "".join(unicodedata.normalize("NFC", part) for part in _MARK.split(chunk)).translate(_SMALL).lower()
        return ["".join(map(self.symbols.__getitem__, w.encode("utf-8"))) for w in _WORD.findall(norm)]

    def start_symbols(self, word: str) -> list[str]:
        """One symbol for each byte; the last one carries the word-end suffix."""
        return [*word[:-1], word[-1] + self.suffix]


def heap_merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> tuple[list[str], int]:
    """(tokens, merges) of merging by a heap over a linked list.

    The lowest-ranked adjacent pair (leftmost first) is popped again and again;
    entries whose pair has changed since they were pushed are skipped.
    """
    n = len(symbols)
    part, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 0) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    version, merges = [0] * n, 0
    while heap:
        _, i, seen = heapq.heappop(heap)
        if seen != version[i] or (j := right[i]) < 0:
            continue
        part[i] += part[j]
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
        version[i] += 1
        version[j] = -1
        merges += 1
        if k >= 0 and (r := ranks.get((part[i], part[k]))) is not None:
            heapq.heappush(heap, (r, i, version[i]))
        if (h := left[i]) >= 0:
            version[h] += 1
            if (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, version[h]))
    return [p for p, v in zip(part, version) if v >= 0], merges


def count_by_heap(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens after merging: the starting symbols less the merges, with no ids looked up."""
    return len(symbols) - heap_merge(symbols, ranks)[1]


def merge_fragment(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge a fragment: a short one by scanning for its lowest-ranked pair, a long one by heap."""
    if len(symbols) > _SHORT:
        return heap_merge(symbols, ranks)[0]
    part = list(symbols)
    while len(part) > 1:
        best = min(
            range(len(part) - 1), key=lambda i: ranks.get((part[i], part[i + 1]), len(ranks) + 1)
        )
        if (part[best], part[best + 1]) not in ranks:
            break
        part[best : best + 2] = [part[best] + part[best + 1]]
    return part


class _Memo(dict):
    """Results by key, made on first use.

    Emptied when keys and results are ``MEMO_BYTES`` long together; those of long
    keys (in unspaced scripts a chunk is a whole paragraph) aren't kept, so memory
    is bounded in bytes.
    """

    def __init__(self, make, limit: int = MEMO_BYTES):
        super().__init__()
        self._make, self._limit, self._used = make, limit, 0

    def __missing__(self, key):
        value = self._make(key)
        size = len(key if isinstance(key, str) else key[0]) + (len(value) if isinstance(value, bytes) else 0)
        if size <= MEMO_KEY:
            if self._used > self._limit:
                self.clear()
                self._used = 0
            self[key] = value
            self._used += 150 + size  # objects and the table take some 150 bytes
        return value


class TokenCounter:
    """Counts the tokens of texts without making ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._by_chunk = _Memo(self._count_chunk)

    def _count_chunk(self, chunk: str) -> int:
        v = self.vocabulary
        return sum(count_by_heap(v.start_symbols(w), v.ranks) for w in v.words(chunk))

    def count(self, text: str | None) -> int:
        v, of = self.vocabulary, self._by_chunk.__getitem__
        return sum(
            1 if special else sum(map(of, v.chunks(part))) for part, special in v.segments(text or "")
        )


class Codec:
    """Encodes by forced boundaries and decodes ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._by_fragment = _Memo(self._fragment_ids)
        self._by_chunk = _Memo(self._chunk_ids)

    def fragments(self, word: str) -> list[str]:
        """The word cut wherever no vocabulary token holds the two bytes side by side."""
        inner, cuts = self.vocabulary.inner_pairs, [0]
        cuts += [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in inner]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def _fragment_ids(self, key: tuple[str, bool]) -> bytes:
        fragment, last = key
        v = self.vocabulary
        symbols = v.start_symbols(fragment) if last else list(fragment)
        return packed(v.ids[t] for t in merge_fragment(symbols, v.ranks) if t in v.ids)

    def _chunk_ids(self, chunk: str) -> bytes:
        out, of = [], self._by_fragment
        for word in self.vocabulary.words(chunk):
            *inside, last = self.fragments(word)
            out += [of[f, False] for f in inside]
            out.append(of[last, True])
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, each as a little-endian unsigned 32-bit integer."""
        v, of = self.vocabulary, self._by_chunk.__getitem__
        return b"".join(
            packed([v.special[part]]) if special else b"".join(map(of, v.chunks(part)))
            for part, special in v.segments(text or "")
        )

    def decode(self, ids) -> str:
        """The tokens joined by blanks, as the library does where a file names no decoder."""
        known = self.vocabulary.tokens
        try:
            return " ".join(map(known.__getitem__, ids))
        except (IndexError, TypeError):  # ids that name no token are passed over
            return " ".join([known[i] for i in ids if 0 <= i < len(known) and known[i] is not None])


def packed(ids) -> bytes:
    out = array("I", ids)
    assert out.itemsize == 4
    if array("H", [1]).tobytes() != b"\x01\x00":
        out.byteswap()
    return out.tobytes()


#: One vocabulary a worker process, kept between batches.
_LOADED: dict[tuple[str, int], object] = {}


def on_worker(kind, raw: bytes):
    """The worker's own ``TokenCounter`` or ``Codec`` for a vocabulary file."""
    key = (kind.__name__, hash(raw))
    if key not in _LOADED:
        _LOADED[key] = kind(Vocabulary(raw))
    return _LOADED[key]


def file_bytes(path: str) -> bytes:
    """The vocabulary file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def default_vocabulary() -> str:
    """Where the installed package of public tokenizers keeps the file used by the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
