"""Token ids of a public word-level BPE vocabulary, with a bounded memo of white-space-free chunks.

No token of the vocabulary spans ASCII white space, and its normalisation never looks across it, so the ids of a text are
the ids of its chunks in order. A chunk's closing punctuation behind a letter or digit is a piece of its own for the
vocabulary, and ASCII letters lose their case, so ``Word,`` is looked up as ``word`` and ``,``. A chunk is split like
this only behind an ASCII letter or digit or a plain Latin letter: other characters may turn into a letter and a mark,
which the vocabulary keeps with the punctuation, so those chunks go to the library whole.

The memo of a worker is emptied when its task ends. It has two generations of ``GENERATION`` short entries: when the
younger one is full, what was not asked for since the last time goes.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
import types
from array import array

import pyarrow as pa

GENERATION = 1 << 19  # entries of one generation of a memo
LONGEST = 64  # bytes of a key; with its ids and its place in the table an entry takes 0.5 kB at most, 0.2 kB usually
CLOSING = b".,;:!?$%&*#"
# Closing punctuation at the end of a chunk, behind an ASCII letter or digit or a Latin-1 letter (in UTF-8). It starts
# with a character class, not with what has to stand before it, so that the search skips over other bytes.
BEFORE_CLOSING = re.compile(
    rb"[.,;:!?$%&*#](?:(?<=[0-9A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?$%&*#]*(?=[\x20\x09-\x0D]|\Z)"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def for_worker(path: str) -> Vocabulary:
    """The worker's own vocabulary. Task code travels by value, so a module global would be new in every task."""
    held = sys.modules.setdefault("_tamiz_worker", types.ModuleType("_tamiz_worker")).__dict__
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


def _packed(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Memo:
    """Two generations of one table, ``size`` entries each; an entry that is asked for moves to the younger one."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        if self.old and None in found:
            gone = [i for i, value in enumerate(found) if value is None]
            again = {}
            for i in gone:
                value = self.old.get(keys[i])
                if value is not None:
                    found[i] = again[keys[i]] = value
            self.add(again)
        return found

    def add(self, entries: dict[bytes, bytes]) -> None:
        self.young.update(entries)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class Vocabulary:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks = Memo(GENERATION)
        self.pieces = Memo(GENERATION)

    def forget(self) -> None:
        """Empty the memos and give free memory back to the system, which a worker kept for later tasks would hold."""
        self.chunks.clear()
        self.pieces.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim is not None:
                trim(0)

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        """Packed little-endian uint32 ids of each chunk."""
        ids = self.chunks.find(chunks)
        if None not in ids:
            return ids
        found = self._encode(list({c for c, i in zip(chunks, ids) if i is None}))
        self.chunks.add({c: i for c, i in found.items() if len(c) <= LONGEST})
        return [found[c] if i is None else i for c, i in zip(chunks, ids)]

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        split = [_core_and_closing(c) for c in chunks]
        wanted = list({p for pair in split for p in pair})
        pieces = dict(zip(wanted, self.piece_ids(wanted)))
        return {c: pieces[core] + pieces[closing] for c, (core, closing) in zip(chunks, split)}

    @staticmethod
    def split(raw: bytes) -> list[bytes]:
        """The pieces of a text, in order: its chunks, closing punctuation on its own."""
        spaced = BEFORE_CLOSING.sub(rb" \g<0>", raw)
        if b"<" in raw:  # may be one of the vocabulary's own marks, which are told by case
            return [p if b"<" in p else p.lower() for p in spaced.split()]
        return spaced.lower().split()

    def piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed little-endian uint32 ids of each piece."""
        ids = self.pieces.find(pieces)
        if None not in ids:
            return ids
        new = list({p for p, i in zip(pieces, ids) if i is None})
        plain = [p for p in new if p.isalpha()]  # ASCII letters only: one pre-token, nothing to normalise
        other = [p for p in new if not p.isalpha()]
        tokenize = self.tokenizer.model.tokenize
        found = {p: _packed([t.id for t in tokenize(p.decode())]) for p in plain}
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)
        found |= {p: _packed(e.ids) for p, e in zip(other, coded)}
        self.pieces.add({p: i for p, i in found.items() if len(p) <= LONGEST})
        for i in [i for i, known in enumerate(ids) if known is None]:
            ids[i] = found[pieces[i]]
        return ids


def _plain_letter(end: str) -> bool:
    """A character whose normal form is one letter or digit and that nothing before it joins."""
    return end.isalnum() and (end.isascii() or ("\u00c0" <= end <= "\u024f" and end != "\u0130"))


def _core_and_closing(chunk: bytes) -> tuple[bytes, bytes]:
    core = chunk.rstrip(CLOSING)
    if len(core) < len(chunk) and not (core and _plain_letter(core[-4:].decode("utf-8", "replace")[-1:])):
        core = chunk
    closing = chunk[len(core) :]
    return (core.lower() if core.isascii() and b"<" not in core else core), closing
