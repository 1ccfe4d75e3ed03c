"""Whole texts to token ids with a public tokenizer file, by units that repeat across texts.

A byte-level BPE never merges across the place before a space that a non-space character follows.
Texts are therefore cut there, every distinct unit of a batch is looked up once, and a text's ids
are its units' ids in order: the same ids as encoding the text at once, for a fraction of the work.
A text that holds an added token's string, such as ``<|endoftext|>``, is encoded at once: the
library matches those before it cuts anything.  A file whose rule is another one is used without any cutting.

A worker keeps known units in two generations of bounded bytes: the older is dropped when the
younger is full, so that frequent units stay.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of known units, both generations together, and of a unit that is worth keeping.
MEMORY = 64_000_000
_LONGEST = 96
#: What an entry takes besides its characters and ids: two objects and a slot.
_ENTRY = 220
_CHUNK = 4096
_SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\""
#: A space that doesn't open a unit, as the text's last character or before more white space.
_RUN = re.compile(r" (?:\s|\Z)")
_RUN_RE2 = " ([\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|\\z)"


class Memory:
    """A dictionary of bounded bytes, in two generations."""

    def __init__(self, most: int = MEMORY) -> None:
        self.most, self.size = most // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.young.get, keys))
        if self.old:
            older = [i for i, x in enumerate(out) if x is None]
            met = [(i, x) for i, x in zip(older, map(self.old.get, [keys[i] for i in older])) if x is not None]
            for i, x in met:
                out[i] = x
            self.put([keys[i] for i, _ in met], [x for _, x in met])
        return out

    def put(self, keys: list[str], values: list[bytes]) -> None:
        for at in range(0, len(keys), _CHUNK):
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
            k, v = keys[at : at + _CHUNK], values[at : at + _CHUNK]
            if max(map(len, k)) > _LONGEST:
                short = [x for x in zip(k, v) if len(x[0]) <= _LONGEST]
                k, v = [x for x, _ in short], [x for _, x in short]
            self.young.update(zip(k, v))
            self.size += _ENTRY * len(k) + 2 * sum(map(len, k)) + sum(map(len, v))


class UnitEncoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        made = json.loads(self.tokenizer.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        self.cuts = made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.cuts = self.cuts and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # tokens with a leading space
        # The byte-level alphabet: printable bytes stand for themselves, the others follow in order from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.known, self.tails = Memory(), {}

    @staticmethod
    def units(text: str) -> list[str]:
        """The first unit, and the others without their leading space."""
        if not _RUN.search(text):  # every space opens a unit
            return text.split(" ")
        out: list[str] = []
        for piece in text.split(" "):
            if out and piece and not piece[0].isspace():
                out.append(piece)
            elif out:  # part of a run of white space: stays with what is before it
                out[-1] += " " + piece
            else:
                out.append(piece)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _of(self, units: list[str]) -> list[bytes]:
        """ids of distinct units, each with its leading space."""
        out = self.known.find(units)
        new = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(new, self._apart([units[i] for i in new])):
            out[i] = ids
        return out

    def _apart(self, units: list[str]) -> list[bytes]:
        """ids of distinct units that aren't known: those of the word, then of the signs at its end."""
        words = [u.rstrip(_SIGNS) for u in units]
        ends = {}
        for i in [i for i, (u, w) in enumerate(zip(units, words)) if w is not u]:
            # The rule cuts between a letter or digit and a sign, and signs that end a unit are one piece.
            u, w = units[i], words[i]
            if len(u) <= len(w) + 3 and w and w[-1].isalnum() and w[-1] < "\u0250":
                ends[i] = u[len(w) :]
            else:
                words[i] = u
        # Units without such an end are new; the words of others may be known.
        ids = dict.fromkeys(words)
        stems = list(dict.fromkeys([words[i] for i in ends]))
        ids.update(zip(stems, self.known.find(stems)))
        new = [w for w, x in ids.items() if x is None]
        ids.update(zip(new, self._words(new)))
        out = list(map(ids.__getitem__, words))
        for i, signs in ends.items():
            out[i] += self._tail(signs)
        return out

    def _tail(self, signs: str) -> bytes:
        found = self.tails.get(signs)
        if found is None:
            (found,) = self._whole([signs])
            self.tails[signs] = found  # a few signs each: hundreds at most
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of distinct words, which are known from now on."""
        out: list[bytes] = [b""] * len(words)
        letters, rest = [], []
        for i, w in enumerate(words):
            (letters if w.isalpha() and (w.isascii() or max(w) < "\u0250") else rest).append(i)
        plain = [i for i in rest if words[i] and " " not in words[i]]
        left = [i for i in rest if not words[i] or " " in words[i]]
        # Letters of the Latin blocks are one piece to the rule: they go straight to the library's model.
        cut, ids, size = self.tokenizer.model.tokenize, [], []
        for i in letters:
            w = words[i]
            found = [t.id for t in cut("Ġ" + (w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet)))]
            ids += found
            size.append(4 * len(found))
        raw, at = np.array(ids, "<u4").tobytes(), 0
        for i, n in zip(letters, size):
            out[i] = raw[at : at + n]
            at += n
        # Many others are encoded as one text, and cut where a token opens with a space.
        for at in range(0, len(plain), _CHUNK):
            part = plain[at : at + _CHUNK]
            (raw,) = self._whole([" " + " ".join([words[i] for i in part])])
            ids = np.frombuffer(raw, "<u4")
            edge = np.flatnonzero(self.opens[ids])
            if len(edge) != len(part):  # not cut as expected: one by one
                left += part
                continue
            edge = (edge * 4).tolist() + [len(raw)]
            for k, i in enumerate(part):
                out[i] = raw[edge[k] : edge[k + 1]]
        for at in range(0, len(left), _CHUNK):
            part = left[at : at + _CHUNK]
            for i, found in zip(part, self._whole([" " + words[i] for i in part])):
                out[i] = found
        self.known.put(words, out)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._whole(texts)
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        apart = np.array([bool(self.added and self.added.search(t)) for t in texts])
        ragged = pc.match_substring_regex(column, _RUN_RE2).to_numpy(zero_copy_only=False) & ~apart
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(np.flatnonzero(apart), self._whole([t for t, a in zip(texts, apart) if a])):
            out[i] = ids
        for i in np.flatnonzero(ragged):
            first, *rest = self.units(texts[i])
            distinct = list(dict.fromkeys(rest))
            ids = dict(zip(distinct, self._of(distinct)))
            out[i] = self._whole([first])[0] + b"".join(map(ids.__getitem__, rest))
        even = np.flatnonzero(~(apart | ragged))
        if len(even):
            for i, ids in zip(even, self._even(column.take(pa.array(even)))):
                out[i] = ids
        return out

    def _even(self, column: pa.LargeStringArray) -> list[bytes]:
        """ids of texts in which every space opens a unit."""
        cut = pc.split_pattern(column, " ")
        at = cut.offsets.to_numpy()
        at = at - at[0]
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        first = code[at[:-1]]
        words = coded.dictionary
        inner = np.ones(len(code), bool)
        inner[at[:-1]] = False  # a text's first unit has no leading space
        used = np.zeros(len(words), bool)
        used[code[inner]] = True
        used = np.flatnonzero(used)
        parts: list[bytes] = [b""] * len(words)
        for i, ids in zip(used.tolist(), self._of(words.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist())):
            parts[i] = ids
        opening = np.unique(first)
        place = np.zeros(len(words), np.int64)
        place[opening] = len(words) + np.arange(len(opening))
        parts += self._whole(words.take(pa.array(opening)).to_pylist())
        code[at[:-1]] = place[first]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(parts), "<u4")
        count = size[code]
        stop = np.cumsum(count)
        ids = flat[np.repeat(start[code] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.concatenate([[0], stop])[at]
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """The file's encoder, one a worker."""
    return UnitEncoder(path)
