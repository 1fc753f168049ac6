"""Token counts and ids with the whole-token shortcut.

Which vocabulary strings encode alone as exactly one token is proved once per worker by encoding
every one of them (`whole_tokens`).  Texts are cut at white space; a piece whose pre-tokens are all
proved strings is counted without any merging, and only the rest goes through the library's merges.
Results are remembered by piece in a bounded table.  Where ids are wanted, some MB of texts are cut at a
time, and each distinct pre-token of theirs is looked up once (`TokenTable.all_ids`).  A text with characters for which the cut at
white space is not proved equal to the library's own normalisation goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 1 << 18  # pieces between white space that a worker remembers
MERGED = 1 << 18  # merged pre-tokens that a worker remembers, and as many that were met before these
LINE = 64           # pre-tokens merged in one call of the library, about
TOGETHER = 4 << 20  # bytes of text whose ids are made at once; a longer text is alone
# fixed value: the pre-token pattern of the public vocabulary file word_bpe_49k.json
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# outside: control characters, no-break space, soft hyphen, dotted capital I, anything from U+0250 on but common
# punctuation; texts of the rest are unchanged by NFC and lower-case one by one
_UNPROVED = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


def _joined(ids: np.ndarray, sizes: np.ndarray, members: pa.Array, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of ``lists``, one after the other, whose ``members`` are numbers of items.

    ``ids`` holds the items' ids, ``sizes`` how many each has.
    """
    members = members.to_numpy()
    n = sizes[members]
    ends = np.cumsum(n)
    first = np.cumsum(sizes) - sizes
    take = np.repeat(first[members] - ends + n, n)
    take += np.arange(len(take))
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
    return ids[take], np.diff(bounds)


class TokenTable(dict):
    """Piece of text without white space -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.merger = Tokenizer(self.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != PRETOKEN or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path}: not a word-end vocabulary with the known pre-token pattern")
        self.pattern = regex.compile(PRETOKEN)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.letters = byte_letters()
        self.printable = {b: c for b, c in enumerate(self.letters)}
        self.whole = self.whole_tokens(spec["model"]["vocab"])
        self.ends_word = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        self.ends_word[[n for entry, n in spec["model"]["vocab"].items() if entry.endswith("</w>")]] = True
        self.words: dict[str, bytes] = dict(self.whole)
        self.old_words: dict[str, bytes] = {}

    def stand_in(self, word: str) -> str:
        # printable ASCII stands for itself
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.printable)

    def merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self.stand_in(word))]

    def all_merged(self, words: list[str]) -> list[bytes]:
        """Ids of each of many pre-tokens: as many calls of the library as lines, parted where a token ends a word."""
        plain = list(map(self.stand_in, words))
        lines = [" ".join(plain[k:k + LINE]) for k in range(0, len(plain), LINE)]
        ids = np.array([i for e in self.merger.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != len(words):  # a pre-token without such an end, or empty
            return [struct.pack(f"<{len(m)}I", *m) for m in map(self.merged, words)]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def whole_tokens(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        proved = {}
        for entry, number in vocab.items():
            if not entry.endswith("</w>"):
                continue
            try:
                word = bytes(back[c] for c in entry[:-4]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if (word and word.lower() == word and not _UNPROVED.search(word) and self.pattern.findall(word) == [word]
                    and self.merged(word) == [number]):
                proved[word] = struct.pack("<I", number)
        return proved

    def remember(self, word: str, one: bytes) -> None:
        if len(word) <= 64:
            if len(self.words) >= MERGED:  # those still in use come back from the older ones
                self.old_words, self.words = self.words, dict(self.whole)
            self.words[word] = one

    def word(self, word: str) -> bytes:
        """Ids of one pre-token: proved strings directly, the rest by merging, once."""
        one = self.words.get(word)
        if one is None:
            one = self.old_words.get(word)
            if one is None:
                ids = self.merged(word)
                one = struct.pack(f"<{len(ids)}I", *ids)
            self.remember(word, one)
        return one

    def all_words(self, words: list[str]) -> list[bytes]:
        """`word` of each of many different pre-tokens; an empty one has no ids."""
        known = list(map(self.words.get, words))
        for k in [k for k, one in enumerate(known) if one is None]:
            known[k] = self.old_words.get(words[k]) if words[k] else b""
            if known[k]:
                self.remember(words[k], known[k])
        new = [k for k, one in enumerate(known) if one is None]
        for k, one in zip(new, self.all_merged([words[k] for k in new])):
            known[k] = one
            self.remember(words[k], one)
        return known

    def __missing__(self, piece: str) -> bytes:
        low = piece.lower()
        if low.isalpha():
            value = self.word(low)
        elif low[-1] in ".,;:!?" and low[:-1].isalpha():
            value = self.word(low[:-1]) + self.word(low[-1])
        else:
            value = b"".join(map(self.word, self.pattern.findall(low)))
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = value
        return value

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit bytes, equal to the library's."""
        if _UNPROVED.search(text) or self.special.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, text.split()))

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """`ids` of each text in order (null: none)."""
        texts = texts.fill_null("")
        group = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
        cuts = np.flatnonzero(np.diff(group)) + 1
        for begin, end in pairwise([0, *cuts.tolist(), len(texts)]):
            yield from self._ids_together(texts.slice(begin, end - begin))

    def apart(self, low: pa.Array) -> pa.Array:
        """Lower-case pieces with a space between their pre-tokens."""
        ended = pc.match_substring_regex(low, r"^\pL+[.,;:!?]$")
        some = low.filter(ended)
        some = pc.binary_join_element_wise(pc.utf8_slice_codeunits(some, 0, -1), pc.utf8_slice_codeunits(some, -1), " ")
        low = pc.replace_with_mask(low, ended, some)
        rest = pc.invert(pc.or_(ended, pc.utf8_is_alpha(low)))
        some = [" ".join(self.pattern.findall(x)) for x in low.filter(rest).to_numpy(zero_copy_only=False)]
        return pc.replace_with_mask(low, rest, pa.array(some, low.type))

    def _ids_together(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _UNPROVED.pattern)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring_regex(texts, re.escape(content)))
        # without unproved characters white space is ASCII's
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts)
        pieces = split.flatten().dictionary_encode()
        parts = pc.ascii_split_whitespace(self.apart(pc.utf8_lower(pieces.dictionary)))
        words = parts.flatten().dictionary_encode()
        known = self.all_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(known), "<u4")
        ids, n = _joined(ids, np.fromiter(map(len, known), np.int64, len(known)) // 4, words.indices, parts)
        ids, n = _joined(ids, n, pieces.indices, split)
        ends = np.cumsum(4 * n).tolist()
        ids = ids.tobytes()
        out = [ids[a:b] for a, b in pairwise([0, *ends])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.ids(texts[i].as_py())
        return out

    def count(self, text: str) -> int:
        if _UNPROVED.search(text) or self.special.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(len, map(self.__getitem__, text.split()))) // 4


_TABLES: dict[str, TokenTable] = {}


def table(path: str) -> TokenTable:
    """This worker's table for the vocabulary file at ``path`` (a file every node has)."""
    if path not in _TABLES:
        _TABLES[path] = TokenTable(path)
    return _TABLES[path]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 bytes, 0 tokens); null doc_ids and repeated rows are kept as they
    are; texts are whole, however long; other columns are ignored. Row by row, no shuffle.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(vocabulary)
        for part in parts:
            counts = [t.count(x.as_py() or "") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("n_bytes"), "text")
    return (rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
