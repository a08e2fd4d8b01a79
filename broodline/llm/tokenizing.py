"""Token ids of whole texts, with the ids of repeated words remembered.

A tokenizer splits a text before it merges, and no split crosses the last blank
of a run of white space. A batch of texts is therefore cut into units at white
space, equal units are found by their 64-bit hashes, and only units that the
worker has not met go to the tokenizer. Texts with white space outside ASCII, and
texts that hold the string of an added token, are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from broodline.llm.arrays import BLOCK, PLAIN_WORDS, U64, ascii_lower, span_hashes, utf8, worker_store

#: Units, and pieces of units, that a worker remembers; a full store starts afresh.
REMEMBERED, PIECES = 700_000, 150_000
#: How byte-level vocabularies split a text (fixed value of that family of tokenizers).
BYTE_LEVEL_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: White space beyond ASCII, as UTF-8.
_FAR_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


def byte_letters() -> dict[int, str]:
    """Bytes as the printable characters that byte-level vocabularies spell them with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by one tokenizer file; nothing is added around a text.

    With ``match_added`` the strings of added tokens in a text get their own ids, as
    the file has it; without, special ones are ordinary text.
    """

    def __init__(self, path: str, match_added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not match_added
        added = self.tokenizer.get_added_tokens_decoder().values() if match_added else []
        self.added = [re.compile(re.escape(t.content.encode())) for t in added]
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        #: Added tokens that are looked for after normalizing can be in any text.
        self.all_whole = self.normalizer is not None and any(t.normalized for t in added)
        rules = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        steps = rules.get("pretokenizers", [rules])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.keeps_blanks = not own
        self.split = regex.compile(own[0] if own else BYTE_LEVEL_SPLIT)
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.hashes = np.zeros(0, U64)
        self.places = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, "<u4")
        self.filled = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def spell(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def unit(self, text: str) -> bytes:
        """The ids of one unit, split by split."""
        if self.normalizer is not None and not text.isascii():
            text = self.normalizer.normalize_str(text)
        out = []
        for piece in self.split.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                plain = piece.isascii() and piece.isprintable() and " " not in piece[1:]
                spelled = piece.replace(" ", self.letters[0x20]) if plain else self.spell(piece)
                ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
                self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of a batch."""
        word = PLAIN_WORDS[data].astype(bool)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate(([False], word[:-1]))
        if not self.keeps_blanks:
            after = np.concatenate((word[1:], [False]))
            starts = np.flatnonzero(word & (~before | first[:-1]))
            return starts, np.flatnonzero(word & (~after | first[1:])) + 1
        blank = data == 0x20
        follows = np.concatenate((word[1:], [False])) & ~first[1:]
        after_break = np.concatenate(([False], ~word[:-1] & ~blank[:-1]))
        opens = first[:-1] | (~word & (before | follows)) | (word & after_break)
        starts = np.flatnonzero(opens)
        return starts, np.append(starts[1:], len(data))

    def learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remember the ids of units not met before; ``hashes`` are sorted and distinct."""
        raw = data.tobytes()
        found = [self.unit(raw[s:e].decode()) for s, e in zip(starts, ends, strict=True)]
        lengths = np.array([len(f) // 4 for f in found], np.int64)
        fresh = np.frombuffer(b"".join(found), "<u4")
        if self.filled + len(fresh) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(fresh)), "<u4")))
        self.ids[self.filled : self.filled + len(fresh)] = fresh
        places = self.filled + np.cumsum(lengths) - lengths
        self.filled += len(fresh)
        spots = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, spots, hashes)
        self.places = np.insert(self.places, spots, places)
        self.lengths = np.insert(self.lengths, spots, lengths)

    def rows_with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows in whose bytes the string of an added token starts."""
        if self.all_whole:
            return np.arange(len(offsets) - 1)
        found = set()
        for pattern in self.added:
            match = pattern.search(data)
            while match:
                row = int(np.searchsorted(offsets, match.start(), "right")) - 1
                found.add(row)
                match = pattern.search(data, int(offsets[row + 1]))
        return np.array(sorted(found), np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows joined and the first one of each row (one more than rows)."""
        data, offsets = utf8(column)
        added = self.rows_with_added(data, offsets)
        if not len(added):
            return self.encode_plain(column, data, offsets)
        mask = np.zeros(len(column), bool)
        mask[added] = True
        others = pc.if_else(pa.array(mask), pa.scalar(None, column.type), column)
        ids, begins = self.encode_plain(others, *utf8(others))
        parts, sizes, at = [], np.diff(begins), 0
        for row in added:
            own = self.whole(column[int(row)].as_py() or "")
            parts += [ids[at : begins[row]], own]
            at, sizes[row] = begins[row], len(own)
        return np.concatenate([*parts, ids[at:]]), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def encode_plain(
        self, column: pa.Array, data: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for rows in which no added token has to be matched."""
        if not self.keeps_blanks:
            data = ascii_lower(data)
        if _FAR_SPACE.search(data):
            parts = [self.whole(t or "") for t in column.to_pylist()]
            sizes = [len(p) for p in parts]
            return np.concatenate([np.zeros(0, "<u4"), *parts]), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        starts, ends = self.cut(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        hashes = np.empty(len(starts), U64)
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
            low = starts[at]
            hashes[at:stop] = span_hashes(
                data[low : ends[stop - 1]], starts[at:stop] - low, ends[at:stop] - low
            )
            at = stop
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        if len(self.pieces) > PIECES:
            self.pieces = {}
        spots = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(spots, len(self.hashes) - 1)] == distinct
        if not known.all():
            rows = example[~known]
            self.learn(data, distinct[~known], starts[rows], ends[rows])
            spots = np.searchsorted(self.hashes, distinct)
        lengths = self.lengths[spots][which]
        begins = np.concatenate(([0], np.cumsum(lengths)))
        take = np.arange(begins[-1]) + np.repeat(self.places[spots][which] - begins[:-1], lengths)
        return self.ids[take], begins[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, added tokens matched; loaded once in a worker."""
    store = worker_store()
    if path not in store:
        store[path] = Encoder(path, match_added=True)
    return store[path]
