"""A public tokenizer behind a cache of words.

Both vocabularies split a text at white space before any merge, so that the ids of a text are the
ids of its pieces. Pieces repeat, and a dictionary look-up is far cheaper than the library's call.
Texts where that split is not certain (rare white space, special tokens) go whole to the library.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .common import hold_memory

#: Pieces that a process keeps (some 200 bytes each), and the longest that it keeps, in characters.
CACHE_PIECES, CACHE_CHARS = 800_000, 40
#: Stands between words that are looked up together, so many at once.
MARK, JOINED = "\x01", 200
SIGNS = frozenset(".,;:!?")
#: What makes the ids of a text other than those of its pieces: special tokens and rare white space; where white space is
#: kept, also such at either end or next to other.
DOUBTFUL = "<\\||[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DOUBTFUL_SPACE = r"|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
_LOADED: dict[tuple[str, int], "WordTokens"] = {}


class Pieces(dict):
    """Ids of pieces that were asked for twice; those asked for once wait apart, and what neither has is noted."""

    def __init__(self) -> None:
        self.missed: list[str] = []
        self.once: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes | None:
        found = self.once.get(key)
        if found is None:
            self.missed.append(key)
        else:
            self[key] = found
        return found

    def add(self, new: dict[str, bytes]) -> None:
        """Takes new pieces; beyond its share of CACHE_PIECES either part begins anew, first the rare ones."""
        if 8 * (len(self.once) + len(new)) > 3 * CACHE_PIECES:
            self.once.clear()
        self.once.update((k, v) for k, v in new.items() if len(k) <= CACHE_CHARS)
        if 8 * len(self) > 5 * CACHE_PIECES:
            self.clear()
            self[""] = b""


class WordTokens:
    """Ids of whole texts as bytes (little-endian, as on all machines that Spark runs Python on) of ``width`` each (2 where the vocabulary allows)."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.drops_space = not self.library.encode(" ", add_special_tokens=False).ids
        self.width, self.code = (2, "H") if self.library.get_vocab_size() <= 1 << 16 else (4, "I")
        self.end = self.packed([end_id])
        self.doubtful = DOUBTFUL if self.drops_space else DOUBTFUL + DOUBTFUL_SPACE
        self.cache = Pieces()
        self.cache[""] = b""  # at the ends of a text that begins or ends with white space
        self.between = f" {MARK} " if self.drops_space else "\n"
        self.signs = {s: self.packed(self.library.encode(s, add_special_tokens=False).ids) for s in SIGNS}
        #: The same vocabulary for words of lower-case ASCII letters alone, which neither normalising nor splitting changes.
        self.simple = Tokenizer.from_file(path)
        if self.drops_space:
            self.simple.normalizer = normalizers.Lowercase()
            self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.library.encode(MARK if self.drops_space else "\n", add_special_tokens=False).ids[-1]

    def forget(self) -> None:
        self.cache.clear()
        self.cache.once.clear()
        self.cache[""] = b""

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        """Keys of each text whose ids, joined, are those of the text; the texts have none of what DOUBTFUL finds."""
        if self.drops_space:
            return pc.ascii_split_whitespace(texts)
        marked = pc.binary_join_element_wise(*(pa.scalar(x, texts.type) if isinstance(x, str) else x for x in ("\0", texts, "")))  # the start of a text has no space before it
        return pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")

    def source(self, key: str) -> str:
        if self.drops_space or key[0] == "\n":
            return key
        return key[1:] if key[0] == "\0" else " " + key

    def look_up(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces. A sign behind a word is a piece of its own in both vocabularies, so that a word of ASCII letters is
        looked up without it (and, where case is dropped, in lower case), once and by the simpler split."""
        plain, rest = {}, []
        for k in new:
            stem = k[:-1] if k[-1] in SIGNS else k
            if stem.isascii() and stem.isalpha():
                plain[k] = stem.lower() if self.drops_space else stem
            else:
                rest.append(k)
        found = self.from_library(rest, self.library)
        kept, once = self.cache.get, self.cache.once.get
        stems = {s: kept(s) or once(s) for s in plain.values()}
        stems.update(self.from_library([s for s, ids in stems.items() if ids is None], self.simple))
        found.update((k, stems[s] + self.signs.get(k[-1], b"")) for k, s in plain.items())
        return found

    def from_library(self, new: list[str], library: Tokenizer) -> dict[str, bytes]:
        """Ids of pieces from the library, many in a call: a mark between them where white space only parts words, a line end otherwise."""
        apart = [k for k in new if (MARK in k if self.drops_space else k[0] == "\n")]
        found = {k: self.packed(self.library.encode(self.source(k), add_special_tokens=False).ids) for k in apart}
        plain = [k for k in new if k not in found]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for keys, e in zip(groups, library.encode_batch_fast([self.between.join(map(self.source, g)) for g in groups], add_special_tokens=False)):
            found.update(zip(keys, self._parted(e.ids)))
        return found

    def _parted(self, ids: list[int]) -> list[bytes]:
        flat, w = np.array(ids, f"<u{self.width}"), self.width
        data, marks = flat.tobytes(), (np.flatnonzero(flat == self.mark) * w).tolist()
        return [data[a:z] for a, z in zip([0, *[m + w for m in marks]], [*marks, len(data)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, with the end id: each distinct piece of all texts is looked up once, and their ids are gathered."""
        column = pa.array(texts, pa.large_string())
        doubtful = pc.match_substring_regex(column, self.doubtful).to_numpy(zero_copy_only=False)
        out = [self.packed(self.library.encode(t, add_special_tokens=False).ids) + self.end if d else b"" for t, d in zip(texts, doubtful)]
        sure = np.flatnonzero(~doubtful)
        lists = self.pieces(column.take(pa.array(sure)))
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        ids, missed = list(map(self.cache.__getitem__, keys)), self.cache.missed
        if missed:
            new, at = self.look_up(missed), -1
            for key in missed:  # in the order of the gaps
                at = ids.index(None, at + 1)
                ids[at] = new[key]
            missed.clear()
            self.cache.add(new)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        pool, word = np.frombuffer(b"".join(ids), f"<u{self.width}"), coded.indices.to_numpy()
        per = size[word]
        ends = np.concatenate(([0], np.cumsum(per)))
        flat = pool[np.repeat((np.cumsum(size) - size)[word] - ends[:-1], per) + np.arange(ends[-1])]
        edges = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i, a, z in zip(sure.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            out[i] = flat[a:z].tobytes() + self.end
        return out


def word_tokens(path: str, end_id: int) -> WordTokens:
    """One of each kind in a process; Spark's Python workers keep it from task to task."""
    hold_memory("tokens", _LOADED.clear)
    return _LOADED.get((path, end_id)) or _LOADED.setdefault((path, end_id), WordTokens(path, end_id))
