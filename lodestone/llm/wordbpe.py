"""Word-end BPE ids by the tokenizers library, a distinct word at a time."""

from __future__ import annotations

import functools
import os
import re
import threading
from collections.abc import Iterator

from .shared import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words, and parts of words, whose ids a Python worker keeps at most (in two generations: what is used stays).
CACHE_WORDS, CACHE_PARTS = 500_000, 800_000
#: Seconds after a worker's last task with the tokenizer until its caches go: Spark keeps the worker, and other operators' tasks come to it.
IDLE_S = 1.0
#: Words on which normaliser and pre-tokeniser do nothing but lower-casing and one cut between letters and marks.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?|*#$%&]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """ids(text) equals the library's encode(text, add_special_tokens=False).ids.

    No token crosses ASCII white space (the normaliser's and the pre-tokeniser's patterns drop it, and no added token holds any), so
    a text's ids are its words' ids in turn. Letters-and-marks words go straight to the library's BPE model, all others through its
    whole encode().
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.leaving: threading.Timer | None = None

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if found is None:
                mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            self.parts[part] = found
        return found

    def word(self, word: bytes) -> bytes:
        if (ids := self.old_words.get(word)) is not None:
            self.words[word] = ids
            return ids
        text = word.decode()
        if m := PLAIN.fullmatch(text):
            ids = b"".join([self.part(p) for p in (m[1].lower(), m[2]) if p])
        else:
            ids = b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        self.words[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, learn = self.words.get, self.word
        return b"".join([known(w) or learn(w) for w in text.split()])  # bytes split at ASCII white space only

    def rest(self) -> None:
        """Between batches: keeps the caches bounded."""
        if len(self.words) > CACHE_WORDS // 2:
            self.old_words, self.words = self.words, {}
        if len(self.parts) > CACHE_PARTS // 2:
            self.old_parts, self.parts = self.parts, {}

    def hold(self, batches: Iterator) -> Iterator:
        """The batches of one task. The caches stay for the next one, but not in a worker that has none for IDLE_S."""
        if self.leaving:
            self.leaving.cancel()
        try:
            yield from batches
        finally:
            self.leaving = threading.Timer(IDLE_S, self.forget)
            self.leaving.daemon = True
            self.leaving.start()

    def forget(self) -> None:
        self.words, self.parts, self.old_words, self.old_parts = {}, {}, {}, {}
        give_back()


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
