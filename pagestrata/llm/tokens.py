"""Token ids of whole texts by the tokenizers library, with a memo of white-space separated chunks.

The byte-level BPE splits a text by a pattern before it merges. A single space
starts the piece that follows it and a single line feed is a piece of its own,
so in a text whose white space is single spaces and line feeds the ids of each
chunk do not depend on its neighbours. Such texts are put together from chunks
that the library encoded once; any other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
MEMO_ENTRIES = 400_000
LATIN = "\u024f"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Unfit(Exception):
    """A chunk whose ids may depend on its neighbours."""


class _Memo(dict):
    """Chunk to ids. Two generations: when the young one is full it becomes the old one."""

    def __init__(self, learn, lead: str):
        super().__init__()
        self.learn, self.lead = learn, lead
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.learn(chunk, self.lead)
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got


class Encoder:
    """Encodes texts to little-endian unsigned 16- or 32-bit ids. Holds at most twice ``MEMO_ENTRIES`` chunks of each kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.feed = self._whole("\n")
        self.pattern, self.bytes = self._splitter(path)
        self.spaced, self.first, self.punctuation = _Memo(self._learn, " "), _Memo(self._learn, ""), {}
        self.memo = self._separable()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _splitter(self, path: str):
        """The pattern and byte alphabet of a byte-level BPE without normalizer; (None, None) for any other kind."""
        import regex
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        if (parts["model"].get("type", "BPE"), before.get("type"), before.get("add_prefix_space")) != ("BPE", "ByteLevel", False) or parts.get("normalizer"):
            return None, None
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        return regex.compile(PATTERN), str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(hidden)})

    def _separable(self) -> bool:
        """Whether this tokenizer treats single spaces and line feeds as said above (one that does not is used whole)."""
        probe = "Abc d'ef 12x,\nghi (jk) ünö\nz *** q's"
        return self.pattern is not None and self._joined(probe) == self._whole(probe) and len(self.feed) == self.dtype.itemsize

    def _piece(self, piece: str) -> bytes:
        """One piece through the library's model."""
        return array(self.code, [t.id for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def _learn(self, bare: str, lead: str) -> bytes:
        if bare.isalpha() and max(bare) <= LATIN:
            return self._piece(lead + bare)
        if not bare or bare[0].isspace() or bare[-1].isspace() or any(s in bare for s in self.special):
            raise _Unfit
        if max(bare) > LATIN:
            return self._whole(lead + bare)
        out = b""
        for p in self.pattern.findall(lead + bare):
            if len(p) <= 3:
                got = self.punctuation.get(p)
                if got is None:
                    got = self.punctuation[p] = self._piece(p)
                    if len(self.punctuation) > MEMO_ENTRIES:
                        self.punctuation.clear()
                out += got
            else:
                out += self._piece(p)
        return out

    def _joined(self, text: str) -> bytes:
        first, spaced, out = self.first, self.spaced.__getitem__, []
        for line in text.split("\n"):
            if out:
                out.append(self.feed)
            chunks = line.split(" ")
            out.append(first[chunks[0]])
            out += map(spaced, chunks[1:])
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes, without the end id; null counts as empty."""
        out: list[bytes] = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            try:
                out.append(self._joined(text) if self.memo else self._whole(text))
            except _Unfit:
                out.append(self._whole(text))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
