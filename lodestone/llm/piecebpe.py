"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Distinct words of a batch lie as symbols in one flat array. Every round finds the best-ranked pair of each word (a segmented
minimum), merges it in all words at once (the leftmost place; all places of that pair where a merge cannot make a better-ranked one),
compacts the array, and looks up only the pairs that changed. Words without a pair that merges leave the array; the rounds end when
none is left. A word here is a run of space marks with what follows it: no piece of the vocabulary holds a mark behind another
character, so no merge crosses words. That is checked when the model is loaded.

Edge cases: null and empty texts have no ids and decode to an empty text; a literal space mark decodes as a space, as in the library;
very long words take rounds over their own symbols only. Repeated rows give repeated rows, other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, pieces_of

MARK = "▁"
#: Distinct words whose ids a Python worker keeps at most (in two generations: what is used stays).
CACHE_WORDS = 1_000_000
NONE = np.int32(0x7FFFFFFF)
SPACED = re.compile(b" +[^ ]*")


class PieceBpe:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(MARK in p[1:] and p.strip(MARK) for p in (pieces[i] for i in normal)):
            raise ValueError("a piece holds a space mark behind another character: words would not be independent")
        for probe in ("a  b", " a", "a ", "ﬁ"):
            if model.decode(model.encode(probe)) != probe:
                raise ValueError("the model normalises text")
        scores = np.array([model.get_score(i) for i in normal])
        ranks = np.unique(-scores, return_inverse=True)[1]
        known = {pieces[i]: i for i in normal}
        letters = sorted({c for p in known for c in p if c not in known})  # none in usual models
        symbols = known | {c: n + k for k, c in enumerate(letters)}
        self.rank = np.full(n + len(letters), NONE, np.int32)
        self.rank[normal] = ranks
        self.first_byte = model.piece_to_id("<0x00>")
        if not model.is_byte(self.first_byte):
            raise ValueError("the model has no byte pieces")
        #: Code point to symbol; unknown characters are -1 - code point.
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = s
        left, right, made = [], [], []
        for p in known:
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    left.append(symbols[p[:k]])
                    right.append(symbols[p[k:]])
                    made.append(known[p])
        self._table(np.array(left, np.uint64), np.array(right, np.uint64), np.array(made, np.int32))
        #: A symbol from which a pair of the same or a better rank than its own can be made: its merges go one by one.
        self.eager = np.zeros(len(self.rank), bool)
        for side in (left, right):
            own = np.where(self.rank[side] == NONE, -1, self.rank[side])
            np.logical_or.at(self.eager, side, self.rank[made] <= own)
        self.text = [b" " * len(p) if not p.strip(MARK) else p.replace(MARK, " ").encode() for p in pieces] + [c.encode() for c in letters]
        for b in range(256):
            self.text[self.first_byte + b] = bytes([b])
        self.number = [str(i) for i in range(n)]
        self.text_bytes = np.array([len(t) for t in self.text])
        self.digits = np.array([len(t) for t in self.number])
        self.words: dict[bytes, str] = {}
        self.old_words: dict[bytes, str] = {}
        self.changed: dict[bytes, bytes] = {}

    def _table(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """Open addressing by rounds: what finds its slot taken goes on to the next."""
        self.width = 21
        self.keys, self.values = np.full(1 << self.width, 0xFFFFFFFFFFFFFFFF, np.uint64), np.full(1 << self.width, -1, np.int32)
        keys = left << np.uint64(32) | right
        slots = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = self.keys[slots[waiting]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slots[waiting[free]], return_index=True)
            put = waiting[free][one]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], made[put]
            waiting = waiting[self.keys[slots[waiting]] != keys[waiting]]
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.width) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.width)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, or -1."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slot(keys)
        found = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            at = self.keys[slots[todo]]
            hit = at == keys[todo]
            found[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (at != np.uint64(0xFFFFFFFFFFFFFFFF))]
            slots[todo] = (slots[todo] + 1) & ((1 << self.width) - 1)
        return found

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words one after the other, and how many each has. Words must not be empty."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rest_word, rest_symbol, rest_at = [], [], []
        place = np.arange(len(symbols))  # of a symbol's first character: the order at the end
        made = self._made(symbols, word)
        while len(symbols):
            rank = np.where(made >= 0, self.rank[made], NONE)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(word)))
            live = best < NONE
            if not live.all():
                done = np.repeat(~live, length)
                rest_word.append(word[done])
                rest_symbol.append(symbols[done])
                rest_at.append(place[done])
                go = ~done
                symbols, word, place, made, rank = symbols[go], word[go], place[go], made[go], rank[go]
                best, length = best[live], length[live]
                if not len(symbols):
                    break
            begin = np.cumsum(length) - length
            hits = np.flatnonzero(rank == np.repeat(best, length))
            first = np.zeros(len(hits), bool)
            first[np.flatnonzero(np.diff(word[hits], prepend=-1))] = True
            same = np.ones(len(hits), bool)
            same[1:] = made[hits[1:]] == made[hits[:-1]]  # pieces of equal rank: only the leftmost
            take = first | (same & ~self.eager[made[hits]])
            if not take.all():  # a skipped place ends the run of those behind it in the word
                broken = np.maximum.accumulate(np.where(take, -1, np.arange(len(hits))))
                start = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
                take &= broken < start
            hits = hits[take]
            if len(hits) > 1:  # overlapping places, as in aaa: every other one of a run
                near = np.diff(hits, prepend=-9) == 1
                at = np.arange(len(hits))
                hits = hits[(at - np.maximum.accumulate(np.where(near, 0, at))) % 2 == 0]
            symbols[hits] = made[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[hits] = True
            symbols, word, place, made, changed = symbols[stay], word[stay], place[stay], made[stay], changed[stay]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            made[again] = self._made_at(symbols, word, again)
        word, symbols, place = np.concatenate(rest_word), np.concatenate(rest_symbol), np.concatenate(rest_at)
        return symbols[np.argsort(place)], np.bincount(word, minlength=len(words))

    def _made(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._made_at(symbols, word, np.arange(len(symbols)))

    def _made_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (at + 1 < len(symbols)) & (word[after] == word[at])
        found = np.full(len(at), -1, np.int32)
        found[inside] = self.pairs(symbols[at[inside]], symbols[after[inside]])
        return found

    def learn(self, words: list[bytes]) -> None:
        """Encodes words that begin with spaces; keeps the ids of each in decimal, and what they decode to where that isn't the word."""
        n = len(self.number)
        symbols, counts = self.merge([w.decode().replace(" ", MARK) for w in words])
        odd = (symbols < 0) | (symbols >= n)
        if odd.any():  # characters without a piece: their bytes
            owner = np.repeat(np.arange(len(words)), counts)
            spelt = [[s] if not o else [self.first_byte + b for b in (chr(-1 - s).encode() if s < 0 else self.text[s])] for s, o in zip(symbols.tolist(), odd.tolist(), strict=True)]
            counts = np.bincount(owner, [len(x) for x in spelt], len(words)).astype(np.int64)
            symbols = np.array([i for x in spelt for i in x], np.int32)
        stops = np.cumsum(counts)
        ends = np.cumsum(self.digits[symbols] + 1)  # in the decimal text, past each comma
        flat = symbols.tolist()
        decimal = ",".join([self.number[i] for i in flat])
        at = 0
        for word, end in zip(words, ends[stops - 1].tolist(), strict=True):
            self.words[word] = decimal[at : end - 1]
            at = end
        decoded = b"".join([self.text[i] for i in flat])
        ends = np.cumsum(self.text_bytes[symbols])[stops - 1]
        if decoded != b"".join(words) or (ends != np.cumsum([len(w) for w in words])).any():
            for word, lo, hi in zip(words, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if decoded[lo:hi] != word:
                    self.changed[word] = decoded[lo:hi]

    def split(self, text: bytes) -> list[bytes]:
        """Words with the spaces before them, after the leading space that the library adds."""
        if not text:
            return []
        text = text.replace(MARK.encode(), b" ")
        if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
            return SPACED.findall(b" " + text)
        return [b" " + w for w in text.split(b" ")]

    def encode(self, texts: list[bytes]) -> list[tuple[list[bytes], list[str]]]:
        """For each text its words and their ids in decimal."""
        if len(self.words) > CACHE_WORDS // 2:
            self.old_words, self.words = self.words, {}
        split = [self.split(t) for t in texts]
        known, old = self.words, self.old_words
        got = [[*map(known.get, words)] for words in split]
        short = [k for k, numbers in enumerate(got) if None in numbers]
        new = set()
        for k in short:
            for w in {w for w, number in zip(split[k], got[k], strict=True) if number is None}:
                if w in old:
                    known[w] = old[w]
                else:
                    new.add(w)
        if new:
            self.learn(list(new))
        for k in short:
            got[k] = [known[w] for w in split[k]]
        return list(zip(split, got, strict=True))

    def decoded(self, words: list[bytes]) -> bytes:
        """What the ids of these words decode to."""
        return b"".join([self.changed.get(w, w) for w in words] if self.changed else words)[1:]

    def ids(self, text: str) -> list[int]:
        return [int(i) for w in self.encode([text.encode()])[0][1] for i in w.split(",")]

    def decode(self, ids: list[int]) -> str:
        """What the library's decode() gives for ids of ordinary and byte pieces."""
        return b"".join([self.text[i] for i in ids])[1:].decode(errors="replace") if ids else ""


@functools.lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document of whole texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(path)
        for batch in pieces_of(batches, "text"):
            counts, ids, decoded = [], [], []
            for words, numbers in bpe.encode(as_bytes(batch.column("text"))):
                line = ",".join(numbers).encode()
                counts.append(line.count(b",") + bool(line))
                ids.append(hashlib.sha256(line).hexdigest())
                decoded.append(hashlib.sha256(bpe.decoded(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, text: str = "text", ids: str = "piece_ids", model: str | None = None) -> DataFrame:
    """Adds the ids of column `text` as an array; all other columns stay, but for one that is named like the result, in whose place it comes. A null text has none."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(path)
        for batch in pieces_of(batches, text):
            own = [[int(i) for w in numbers for i in w.split(",")] for _, numbers in bpe.encode(as_bytes(batch.column(text)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(own, pa.list_(pa.int32()))], [*kept, ids])

    kept = [n for n in docs.columns if n != ids]
    return docs.mapInArrow(run, StructType([docs.schema[n] for n in kept]).add(ids, ArrayType(IntegerType())))
