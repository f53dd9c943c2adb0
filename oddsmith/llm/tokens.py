"""Token ids of whole texts by the tokenizers library, with a bounded cache of pre-tokens."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import islice

#: The byte-level pattern restricted to characters below U+0250, where these classes are all letters, numbers and white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
_SPLIT = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
_CACHE = 1 << 20
_AT_ONCE = 1 << 18
#: Between a character that is no white space and a single space before another one no pre-token spans: long texts are cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 1 << 20


#: Byte-level models read bytes as characters: printable Latin-1 as themselves, the others, in order, from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHAR = {b: b for b in _PRINTABLE} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class CachedBpe:
    """Encodes like tokenizers.Tokenizer with add_special_tokens=False, but each distinct pre-token only once.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in turn. Texts with
    characters from U+0250 on, or with the string of an added token, go through the library itself, long ones in parts
    that end where no pre-token does. The cache holds _CACHE pre-tokens at most.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def _raw(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> Iterator[str]:
        """text in parts of about _LONG characters, cut before a single space between words and not in an added token."""
        at = 0
        while len(text) - at > 2 * _LONG:
            cut = _CUT.search(text, at + _LONG)
            while cut and any(m.start() < cut.start() < m.end() for m in self.added.finditer(text, max(at, cut.start() - 256), cut.start() + 256)):
                cut = _CUT.search(text, cut.end())
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _learn(self, words) -> None:
        """After this the cache has all of words."""
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > _CACHE:
            self.cache.clear()
            missing = list(words)
        tokenize, pack = self.tokenizer.model.tokenize, struct.pack
        for w in missing:  # a pre-token goes to the model directly, without another pass of the splitter
            ids = [t.id for t in tokenize(w.encode().decode("latin-1").translate(_AS_CHAR))]
            self.cache[w] = pack(f"<{len(ids)}I", *ids)

    def _joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null and empty: none."""
        out: list[bytes] = [b""] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if _BEYOND.search(text) or self.added.search(text):
                out[i] = b"".join(self._raw([part])[0] for part in self._parts(text))
            elif len(text) > 8 * _AT_ONCE:
                found, parts = _SPLIT.finditer(text), []
                while words := [m.group() for m in islice(found, _AT_ONCE)]:
                    self._learn(set(words))
                    parts.append(self._joined(words))
                out[i] = b"".join(parts)
            else:
                waiting.append((i, _SPLIT.findall(text)))
                held += len(waiting[-1][1])
                if held > _AT_ONCE:
                    self._flush(waiting, out)
                    waiting, held = [], 0
        self._flush(waiting, out)
        return out

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        self._learn({w for _, words in waiting for w in words})
        for i, words in waiting:
            out[i] = self._joined(words)
