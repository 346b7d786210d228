"""Token ids of many texts at once, by a vocabulary whose words never join.

The vocabulary's own splitting ends a word at white space and between an ASCII
letter or digit and an ASCII sign, so a text's ids are those of its units one
after the other. Units are found and hashed over the bytes of many texts in
numpy; each distinct unit is encoded once by the vocabulary's tokenizer and
its ids are kept in a table of bounded size. Everything but plain Latin words
goes through the unchanged tokenizer. Strings of the vocabulary's added tokens
are cut out first and get their own ids, as the tokenizer does by itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import _BYTE, SEGMENT_BYTES, _powers, mix, utf8

#: Distinct units that a worker keeps; the table starts anew beyond it.
TABLE_UNITS = 1_000_000
_SPACE, _ALNUM, _SIGN, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)  # beyond ASCII, apostrophes and controls a unit is never cut
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _ALNUM
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _SIGN
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Letters whose lower case is one letter and which no normal form changes.
_PLAIN = re.compile("[a-zà-öø-ÿÀ-ÖØ-ß]+")
_KEPT: dict[str, UnitEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # of units; added tokens are cut out of the texts before
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut_out = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # The same merges over words that are cut, lower-cased and written as byte letters already.
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocab = self.words.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.joined = bool(suffix)
        for word, i in vocab.items():
            self.ends[i] = bool(suffix) and word.endswith(suffix)
        self.letters = _byte_letters()
        self.clear()

    @classmethod
    def of(cls, path: str) -> UnitEncoder:
        """One for each worker and vocabulary, kept from task to task."""
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _ids(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(units)
        plain = [i for i, u in enumerate(units) if _PLAIN.fullmatch(u)] if self.joined else []
        if plain:
            text = " ".join([units[i].lower() for i in plain])
            coded = " ".join([w.encode().decode("latin-1").translate(self.letters) if not w.isascii() else w for w in text.split(" ")])
            ids = np.array(self.words.encode_batch_fast([coded], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(plain):
                raise ValueError("the vocabulary does not mark the ends of words")
            for i, part in zip(plain, np.split(ids, cuts[:-1]), strict=True):
                out[i] = part
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.whole.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        """Adds units with ascending ``keys``."""
        found = self._ids(units)
        size = np.array([len(x) for x in found], np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *found])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _segment(self, part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a stretch of bytes, where its units begin, and how many ids each has. ``first``: bytes that begin a text."""
        kind = _CLASS[part]
        cut = np.empty(len(part), bool)
        cut[0] = True
        a, b = kind[:-1], kind[1:]
        cut[1:] = (a == _SPACE) | (b == _SPACE) | ((a ^ b == _ALNUM ^ _SIGN) & (a != _OTHER) & (b != _OTHER))
        cut[first] = True
        edge = np.flatnonzero(cut)
        end = np.append(edge[1:], len(part))
        word = kind[edge] != _SPACE
        start, end = edge[word], end[word]
        up, down = _powers(len(part))
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_FOLD[part]] * up[: len(part)], dtype=np.uint64)])
            hashes = mix((total[end] - total[start]) * down[start])
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
            if not new.any():
                break
            if len(self.keys) and len(self.keys) + new.sum() > TABLE_UNITS:
                self.clear()
                new = np.ones(len(keys), bool)
            raw = _FOLD[part].tobytes()
            self._learn(keys[new], [raw[start[i] : end[i]].decode("utf-8") for i in index[new].tolist()])
        size = self.size[place][inverse]
        at = self.at[place][inverse]
        stop = np.cumsum(size)
        take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(at - (stop - size), size)
        return self.pool[take], start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (null: empty) in one array, and where each text's begin; the last entry is the end."""
        marked = [i for x in self.added for i in pc.indices_nonzero(pc.fill_null(pc.match_substring(texts, x), False)).to_pylist()]
        if not marked:
            return self._encode(texts)
        parts, sizes = [], np.ones(len(texts), np.int64)  # a text with such strings is several parts, every other one of them an added token
        at = 0
        for i in sorted(set(marked)):
            own = self.cut_out.split(texts[i].as_py())
            parts += [texts.slice(at, i - at).cast(pa.string()), pa.array(own, pa.string())]
            sizes[i], at = len(own), i + 1
        whole = pa.concat_arrays([*parts, texts.slice(at).cast(pa.string())])
        ends = np.cumsum(sizes)
        many = np.flatnonzero(sizes > 1)
        places = np.concatenate([np.arange(ends[i] - sizes[i] + 1, ends[i], 2) for i in many])
        added = np.array([self.added[x] for x in whole.take(pa.array(places)).to_pylist()], np.uint32)
        plain = np.zeros(len(whole), bool)
        plain[places] = True
        ids, begin = self._encode(pc.if_else(pa.array(plain), "", whole))
        ids = np.insert(ids, begin[places], added)
        begin = begin + np.concatenate([[0], np.cumsum(plain)])
        return ids, begin[np.concatenate([[0], ends])]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(texts)
        ids, begins, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        inner = offsets[1:-1]
        at = 0
        while at < len(data):
            to = min(len(data), at + SEGMENT_BYTES)
            while to < len(data) and _CLASS[data[to]] != _SPACE:
                ahead = _CLASS[data[to : to + 4096]] == _SPACE
                to += int(np.argmax(ahead)) if ahead.any() else len(ahead)
            first = inner[np.searchsorted(inner, at) : np.searchsorted(inner, to)] - at
            found, start, size = self._segment(data[at:to], first)
            ids.append(found)
            begins.append(start + at)
            sizes.append(size)
            at = to
        stop = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), stop[np.searchsorted(np.concatenate(begins), offsets, "left")]
