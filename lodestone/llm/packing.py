"""Vector bin packing of tokenised examples into training sequences.

An example asks for three things at once: tokens, one segment, and loss-bearing tokens. A sequence offers a fixed amount of each. The
dot-product heuristic fills one sequence at a time: of the examples that fit whole, it takes the one whose demands, as shares of the
limits, have the largest dot product with what the sequence still offers. When none fits whole, and cutting is allowed, the example
with the largest product is cut to what is left; its rest goes back among the others. So only the last sequence of a task, and those
closed by the limit on segments or loss tokens, keep padding. Examples of equal demands are one kind: a choice looks at kinds, and takes
as many of the best one as stay best and fit, so very many short examples cost a step a sequence, not a step each.

Every task packs the rows of its own input split, streaming, so no row is moved: memory is bounded by `window` tokens, `most_items` examples and the
longest text, and a task that is run again makes the same sequences. sequence_id holds the task's number above bit 40.

Edge cases: null and empty texts are the end id alone; a repeated row is packed again; an empty table gives no row; null doc_id stays
null; other columns are not read. An example over the limits is cut at the limit first; with cut=False that is an error. Turns: a null turn comes
first, equal turns by role and text; a null role bears no loss; a null text is the end id alone; each row of a null conv_id is an example of its own.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, partition_id, pieces_of, small_batches, spread
from .wordbpe import default_path, word_bpe


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 4096
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Tokens start .. start + length - 1 of example `key`, at `offset` of sequence `sequence`."""

    key: int
    start: int
    length: int
    sequence: int
    offset: int


#: An example, or what is left of it: key, start, stop, prefix sums of loss (None: each token bears loss).
Item = tuple[int, int, int, "np.ndarray | None"]


class Packer:
    """Streams examples in and closed sequences out."""

    def __init__(self, limits: Limits, cut: bool = True, window: int = 1 << 20, most_items: int = 1 << 16) -> None:
        self.limits, self.cut, self.window, self.most_items = limits, cut, window, most_items
        self.kinds: dict[tuple[int, int], deque[Item]] = {}  # (tokens, loss tokens) of an example: those held, the oldest first
        self.held, self.items, self.sequence = 0, 0, 0

    def _hold(self, item: Item) -> None:
        key, start, stop, sums = item
        self.kinds.setdefault((stop - start, stop - start if sums is None else int(sums[stop] - sums[start])), deque()).append(item)
        self.held += stop - start
        self.items += 1

    def add(self, key: int, length: int, loss: np.ndarray | None = None, sums: np.ndarray | None = None) -> Iterator[Piece]:
        """loss: for each token whether it bears loss, or its prefix sums; None: all do."""
        if loss is not None:
            sums = np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])
        start, most = 0, min(self.limits.tokens, self.limits.loss_tokens) if sums is None else self.limits.tokens
        if not self.cut and (length > most or sums is not None and sums[-1] > self.limits.loss_tokens):
            raise ValueError("an example is over the limits and may not be cut")
        while length - start > most or sums is not None and sums[length] - sums[start] > self.limits.loss_tokens:
            stop = min(start + most, self._loss_stop(sums, start, self.limits.loss_tokens))
            if stop - start == self.limits.tokens:
                yield Piece(key, start, stop - start, self.sequence, 0)
                self.sequence += 1
            else:
                self._hold((key, start, stop, sums))
            start = stop
        if length > start:
            self._hold((key, start, length, sums))
        if self.held >= self.window or self.items >= self.most_items:
            yield from self._close(last=False)

    def finish(self) -> Iterator[Piece]:
        yield from self._close(last=True)

    @staticmethod
    def _loss_stop(sums: np.ndarray | None, start: int, room: int) -> int:
        """The furthest end whose tokens from start bear at most `room` loss."""
        if sums is None:
            return start + room
        return int(np.searchsorted(sums, sums[start] + room, side="right")) - 1

    def _close(self, last: bool) -> Iterator[Piece]:
        """Fills sequences from what is held; unless last, stops while the rest might still be filled better."""
        lim = self.limits
        whole = np.array([lim.tokens, lim.segments, max(lim.loss_tokens, 1)], float)
        while self.held and (last or self.held >= 2 * lim.tokens):
            # Kinds whose examples ran out go; those of cut examples' rests came.
            self.kinds = {k: v for k, v in self.kinds.items() if v}
            kinds = list(self.kinds)
            asks = np.array([(n, 1, bears) for n, bears in kinds], float)
            shares = asks / whole
            counts = np.array([len(self.kinds[k]) for k in kinds])
            room, offset, rests = np.array([lim.tokens, lim.segments, lim.loss_tokens], float), 0, []
            while room[0] > 0 and room[1] > 0:
                score = shares @ (room / whole)
                fits = (asks <= room).all(1) & (counts > 0)
                if fits.any():
                    i = int(np.argmax(np.where(fits, score, -1)))
                    for item in self._take(self.kinds[kinds[i]], self._how_many(i, asks, shares, fits, counts, room, whole)):
                        yield Piece(item[0], item[1], item[2] - item[1], self.sequence, offset)
                        offset += item[2] - item[1]
                        room -= asks[i]
                        counts[i] -= 1
                    continue
                if not self.cut or not (counts > 0).any():
                    break
                i = int(np.argmax(np.where(counts > 0, score, -1)))
                key, start, end, sums = self.kinds[kinds[i]][0]
                stop = min(start + int(room[0]), self._loss_stop(sums, start, int(room[2])))
                if stop <= start:
                    break
                self._take(self.kinds[kinds[i]], 1)
                counts[i] -= 1
                yield Piece(key, start, stop - start, self.sequence, offset)
                offset += stop - start
                room -= [stop - start, 1, stop - start if sums is None else int(sums[stop] - sums[start])]
                rests.append((key, stop, end, sums))  # for another sequence
            for item in rests:
                self._hold(item)
            self.sequence += 1

    def _take(self, held: deque[Item], n: int) -> list[Item]:
        taken = [held.popleft() for _ in range(n)]
        self.held -= sum(stop - start for _, start, stop, _ in taken)
        self.items -= n
        return taken

    @staticmethod
    def _how_many(i: int, asks: np.ndarray, shares: np.ndarray, fits: np.ndarray, counts: np.ndarray, room: np.ndarray, whole: np.ndarray) -> int:
        """Examples of kind i that fit one after the other while no other kind that fits now has a larger product."""
        with np.errstate(divide="ignore", invalid="ignore"):
            most = int(min(counts[i], np.where(asks[i] > 0, room // asks[i], np.inf).min()))
            # After k of them the lead over another kind is lead - k * loss.
            apart = shares[i] - shares[fits]
            lead, loss = apart @ (room / whole), apart @ shares[i]
            until = np.where(loss > 1e-15, np.ceil(lead / loss), np.inf).min()
        return max(1, int(min(most, until)))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, limits: Limits | None = None) -> DataFrame:
    """Packs the ids of every whole text, each with end_id behind it. Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, limits = tokenizer or default_path(), limits or Limits()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(path), Packer(limits)
        end, first = end_id.to_bytes(4, "little"), partition_id() << 40
        open_docs: dict[int, list] = {}  # key: doc_id, ids, ids not yet placed
        rows: list[tuple] = []

        def place(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                doc = open_docs[p.key]
                rows.append((doc[0], p.start, p.length, zlib.crc32(memoryview(doc[1])[4 * p.start : 4 * (p.start + p.length)]), len(doc[1]) // 4, first + p.sequence, p.offset))
                doc[2] -= p.length
                if not doc[2]:
                    del open_docs[p.key]

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

        key = 0
        for batch in pieces_of(bpe.hold(batches), "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids = bpe.ids(text) + end
                open_docs[key] = [doc_id, ids, len(ids) // 4]
                place(packer.add(key, len(ids) // 4))
                key += 1
            bpe.rest()
            if len(rows) >= 10_000:
                yield out()
        place(packer.finish())
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack_conversations(turns: DataFrame, limits: Limits | None = None, loss_role: str = "assistant", tokenizer: str | None = None) -> DataFrame:
    """Instruction data: a conversation (conv_id) is one example of its turns in order, and only tokens of loss_role bear loss.

    A conversation is one group of rows and stays whole in one task; it is cut only when no sequence can hold it, and a very long one is
    handed on while it is read, so memory stays bounded. Per piece: conv_id, start, length, loss_tokens, sequence_id, offset.
    """
    path, limits = tokenizer or default_path(), limits or Limits(segments=64, loss_tokens=3072)
    names = ("conv_id", "start", "length", "loss_tokens", "sequence_id", "offset")
    most = 16 * limits.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(path), Packer(limits)
        first = partition_id() << 40
        waiting: dict[int, list] = {}  # key: conv_id, prefix sums of loss, tokens not yet placed, start of this part of the conversation
        rows: list[tuple] = []

        def place(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                own = waiting[p.key]
                rows.append((own[0], own[3] + p.start, p.length, int(own[1][p.start + p.length] - own[1][p.start]), first + p.sequence, p.offset))
                own[2] -= p.length
                if not own[2]:
                    del waiting[p.key]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
            rows.clear()
            return batch

        now, loss, begin, key = None, [], 0, 0

        def close() -> int:
            """Hands on what is held of the conversation; returns its tokens."""
            sums = np.concatenate([[0], np.cumsum(np.concatenate(loss), dtype=np.int64)])
            waiting[key] = [now[0], sums, len(sums) - 1, begin]
            place(packer.add(key, len(sums) - 1, sums=sums))
            loss.clear()
            return len(sums) - 1

        for batch in pieces_of(bpe.hold(batches), "text"):
            for *own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "apart", "role")), as_bytes(batch.column("text")), strict=True):
                if own != now and loss:
                    close()
                    key += 1
                if own != now:
                    now, begin = own, 0
                loss.append(np.full(len(bpe.ids(text)) // 4 + 1, role == loss_role))
                if sum(map(len, loss)) >= most:
                    begin += close()
                    key += 1
            bpe.rest()
            if len(rows) >= 10_000:
                yield out()
        if loss:
            close()
        place(packer.finish())
        yield out()

    apart = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.withColumn("apart", apart.cast("long")).repartition(spread(turns.sparkSession), "conv_id", "apart")
    return dealt.sortWithinPartitions("conv_id", "apart", "turn", "role", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
