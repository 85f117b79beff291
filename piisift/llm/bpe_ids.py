"""Token ids of whole texts from a ``tokenizers`` file, at the cost of each distinct word once per worker.

A byte-level BPE with the word pattern of these vocabularies never joins a token across a space that
follows a non-space.  A text may therefore be cut before each such space, and the units encoded
separately: the ids are those of the whole text.  Units repeat, so a worker keeps a bounded table of
them.  New units are encoded by the library, many side by side in one string; the byte lengths of the ids
tell where each ends.  Texts with other white space than blanks and line ends, or with a special token's
string, go to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys

import numpy as np

#: Entries of a worker's table before a new one is begun; the one before is kept beside it, so that units which come
#: again are not encoded again: at about 170 bytes an entry, a bound of 240 MB together.
TABLE_SIZE = 700_000

#: Unicode White_Space, and what Python counts as such, but for the blank and the line end.
_ODD_SPACES = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def _units(text: str) -> list[str]:
    """The text cut before each blank or line end that follows another character."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\0" in text:
        return _UNIT.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by their published rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, table_size: int = TABLE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        #: texts that hold a special token's string go to the library whole, which gives the token's id
        self.odd = [t.content for t in self.lib.get_added_tokens_decoder().values()] + _ODD_SPACES
        self.table: dict[str, bytes] = {}  # of units
        self.before: dict[str, bytes] = {}  # the table before this one
        self.table_size = table_size
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        pre = spec.get("pre_tokenizer") or {}
        #: cutting is proven for the plain byte-level pattern only
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and spec.get("normalizer") is None)
        self.length = np.zeros(max(self.lib.get_vocab(with_added_tokens=True).values()) + 1, dtype=np.int64)
        byte = _byte_of_char()
        for word, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.length[i] = sum(1 for c in word if c in byte)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Encode new units; those that begin with white space and end without may stand side by side."""
        joined = [u for u in units if u[0] in " \n" and u[-1] not in " \n"]
        alone = [u for u in units if u[0] not in " \n" or u[-1] in " \n"]
        for at in range(0, len(joined), 2000):
            part = joined[at:at + 2000]
            text = "".join(part)
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            sizes = map(len, part) if text.isascii() else [len(u.encode()) for u in part]
            cut = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(part)))) + 1
            raw, before = ids.tobytes(), 0
            for u, to in zip(part, (cut * 4).tolist()):
                self.table[u] = raw[before:to]
                before = to
        self.table.update(zip(alone, self._whole(alone)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._whole(texts)
        if len(self.table) > self.table_size:
            self.before, self.table = self.table, {}
        table, out, cut, odd = self.table, [b""] * len(texts), {}, []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.odd):
                odd.append(i)
            else:
                cut[i] = _units(text)
        new: set[str] = set()
        for units in cut.values():
            new.update(units)
        new.discard("")
        fresh = [u for u in new if u not in table]
        if self.before:
            table.update((u, self.before[u]) for u in fresh if u in self.before)
            fresh = [u for u in fresh if u not in table]
        self._learn(fresh)
        table[""] = b""
        for i, units in cut.items():
            out[i] = b"".join(map(table.__getitem__, units))
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        return out


_KEPT: dict[str, Ids] = {}


def ids_for(path: str, table_size: int = TABLE_SIZE) -> Ids:
    """The worker's encoder of a file; workers live on, so its table serves later tasks."""
    if path not in _KEPT:
        _KEPT[path] = Ids(path)
    _KEPT[path].table_size = table_size
    return _KEPT[path]
