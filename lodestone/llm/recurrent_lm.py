"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored output.

Counts. Words of all training documents are counted: each task adds up hashes of words, Spark adds up the tasks. From the counts come the
totals, a bounded head of the most frequent words, and, for each class of rare words, its tokens and distinct words.

Classes. The `singles` most frequent words and the end of a text are classes of their own. Every other word belongs to one of a few spelling
clusters: a mixture of letter-pair models that tells kinds of text apart, fit by expectation maximisation over all training documents (a
bounded number of them only gives its start). Of a cluster's words the `frequent` ones lie in classes of up to CHUNK words, the other head words in a
medium class, all others in a rare one. A word's probability is P(class | state) * P(word | class, state). In classes of frequent words the second
factor is a softmax on the state as well, with an output vector for each word; in medium and rare classes words follow their training counts with half
a count for each, in rare ones also for one unseen word. So the rare classes' unseen words share what the base gives to its single one.

Network. One gated recurrent layer reads words (singles and frequent ones by vectors of their own, others by their class's); its state gives
both softmaxes. It is trained in numpy by backpropagation through windows of `window` tokens, state carried from one to the next, over whole
training documents on the executors: in each of a few rounds every task starts from the same parameters and goes through its own documents of
that round, and the tasks' parameters are averaged, weighted by tokens, in a tree. The rounds divide all training documents among them, by hashes of
ids, and no document is left out. A round of few documents has fewer tasks. A small corpus is read several times. The last texts of a
task go on in windows of up to LONGER times the length, as fewer of them are left.

To score, every task keeps `streams` documents going at a time: a window of each is scored at once, states are carried, a finished document
makes room for the next, so a very long one holds up nothing.

Counts of rare words are not broadcast: each document's distinct rare words go to the table of counts by a join, and only sums
come back. Frequent words never take that way, so no key of the join is hot.

Edge cases: a null text is empty and has the end token only; a null doc_id is never held out; repeated rows are scored each; without
training documents every probability is that of an unseen word in a uniform class; an empty table gives no row; other columns are not
read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, flat, keep, partition_id, pieces_of, small_batches, vector_sum
from .wordhash import LOWER, find_words, prefix, range_hash

#: Hash of the end token; no word has it but for chance.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
HEAD_WORDS = 65_536
#: Words of a class with a softmax of its own.
CHUNK = 32
#: Kinds of bytes for spelling: a-z, 32 kinds of UTF-8 beyond ASCII, blanks and controls, five kinds of all else; and the same as the first of a pair.
KIND = np.array([b - 96 if 97 <= b <= 122 else 32 + (b & 31) if b >= 128 else 0 if b < 33 else 27 + b % 5 for b in range(256)], np.int64)
KIND_BEFORE = KIND * 64
KIND_OF_LOWER = KIND[LOWER].astype(np.uint8).tobytes()
#: Distinct words that a task adds up before it hands them on.
FLUSH_WORDS = 400_000
#: Text bytes of a step, and the shares that documents are dealt into for the rounds of training.
STEP, SHARES = 1 << 19, 16
#: Tokens that training goes through at least, by reading a small corpus up to so many times.
LEAST_TOKENS, MOST_PASSES = 5_000_000, 24
#: Places whose classes' logits are made at once, and parameters that a step of training changes at once, so that they stay in the cache.
BLOCK, PART = 512, 1 << 15
#: Times that a window may be longer where fewer texts are left than streams.
LONGER = 4


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


@dataclass
class Spelling:
    """A mixture of letter-pair models: table[pair, cluster] of log probabilities, and the clusters' own."""

    table: np.ndarray
    prior: np.ndarray

    @staticmethod
    def pairs(data: np.ndarray) -> np.ndarray:
        """At each byte: it and the one before, in 64 kinds each."""
        out = KIND[data]
        out[1:] += KIND_BEFORE[data[:-1]]
        return out

    @classmethod
    def row(cls, text: bytes) -> np.ndarray:
        """A text's shares of pairs, as 200 of them: each text counts alike."""
        own = np.zeros(4096)
        if text:
            kinds = np.frombuffer(text.translate(KIND_OF_LOWER), np.uint8).astype(np.int64)
            before = kinds[:-1] * 64
            kinds[1:] += before
            own = np.bincount(kinds, minlength=4096)
        return (own * (200 / max(len(text), 1))).astype(np.float32)

    @classmethod
    def start(cls, rows: np.ndarray, clusters: int) -> Spelling:
        """Clusters around texts that lie far from each other."""
        if not len(rows):
            return cls(np.zeros((4096, clusters), np.float32), np.zeros(clusters, np.float32))
        chosen = [int(np.argmax(rows.sum(1)))]
        for _ in range(clusters - 1):
            apart = np.min([np.abs(rows - rows[c]).sum(1) for c in chosen], axis=0)
            chosen.append(int(np.argsort(apart)[int(len(apart) * 0.9) if len(apart) > 20 else -1]))
        model = cls.of(rows[chosen], np.zeros(clusters))
        for _ in range(20):
            share = model.shares(rows)
            model = cls.of(share.T @ rows, share.sum(0))
        return model

    @classmethod
    def of(cls, sums: np.ndarray, texts: np.ndarray) -> Spelling:
        """The model of sums of rows and of texts for each cluster."""
        centre = sums + 0.05
        return cls(np.log(centre / centre.sum(1, keepdims=True)).T.astype(np.float32), np.log((texts + 1) / (texts.sum() + len(texts))).astype(np.float32))

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """How far each text belongs to each cluster."""
        score = rows @ self.table + self.prior
        share = np.exp(score - score.max(1, keepdims=True))
        return share / share.sum(1, keepdims=True)

    def cluster(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The likeliest cluster of each word (lower-cased bytes). Only the words' own bytes are looked at."""
        if not len(starts):
            return np.empty(0, np.int64)
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        pairs = self.pairs(data[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))])
        pairs[first] &= 63  # a word begins alike wherever it stands
        word = np.repeat(np.arange(len(starts)), sizes)
        score = [np.bincount(word, column[pairs], len(starts)) + prior for column, prior in zip(self.table.T.astype(np.float64), self.prior, strict=True)]
        return np.argmax(score, 0)


def fit_spelling(learn: DataFrame, clusters: int, start_docs: int, rounds: int = 2) -> Spelling:
    """Starts from the start_docs smallest hashes of ids; then every round takes all texts."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", STEP):
            for text in as_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([Spelling.row(text).tobytes()], pa.binary())], ["row"])

    ids = learn.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(start_docs).distinct()
    found = learn.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(rows_of, "row binary").orderBy(F.xxhash64("row")).limit(start_docs).collect()
    model = Spelling.start(np.array([np.frombuffer(r["row"], np.float32) for r in found], np.float32).reshape(-1, 4096), clusters)
    for _ in range(rounds if found else 0):

        def sums(batches: Iterator[pa.RecordBatch], model: Spelling = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((clusters, 4097))
            for batch in pieces_of(batches, "text", STEP, 16384):
                rows = np.array([Spelling.row(t) for t in as_bytes(batch.column("text"))])
                share = model.shares(rows)
                total[:, :4096] += share.T @ rows
                total[:, 4096] += share.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([partition_id()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["pid", "v"])

        total = vector_sum(learn.select("text").mapInArrow(sums, "pid int, v binary"))
        if total is not None:
            total = total.reshape(clusters, 4097)
            model = Spelling.of(total[:, :4096], total[:, 4096])
    return model


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, words' starts, ends and texts, and hashes."""
    data, bounds = flat(texts)
    data = LOWER[data]
    words = find_words(data, bounds)
    return data, words.starts, words.ends, words.doc, range_hash(prefix(data), words.starts, words.ends)


def count_words(docs: DataFrame, spelling: Spelling) -> DataFrame:
    """word (hash), cluster, n of all documents (text), the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ns, clusters, ended = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int8), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(clusters), pa.array(ns)], ["word", "cluster", "n"])

        for batch in pieces_of(batches, "text", 4 * STEP):
            data, starts, ends, _, hashes = _tokens(as_bytes(batch.column("text")))
            ended += batch.num_rows
            order = np.argsort(hashes)
            hashes = hashes[order]
            at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
            own, n = hashes[at], np.diff(np.append(at, len(hashes)))
            place = np.searchsorted(words, own)
            known = words[np.minimum(place, len(words) - 1)] == own if len(words) else np.zeros(len(own), bool)
            ns[place[known]] += n[known]
            if (new := ~known).any():
                some = order[at[new]]
                words, ns, clusters = (np.insert(a, place[new], b) for a, b in ((words, own[new]), (ns, n[new]), (clusters, spelling.cluster(data, starts[some], ends[some]).astype(np.int8))))
            if len(words) > FLUSH_WORDS:
                yield out()
                words, ns, clusters = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int8)
        if ended:
            words, ns, clusters = np.append(words, END), np.append(ns, ended), np.append(clusters, np.int8(0))
            yield out()

    made = docs.select("text").mapInArrow(run, "word long, cluster byte, n long")
    return made.groupBy("word").agg(F.min("cluster").alias("cluster"), F.sum("n").alias("n"))


class WordTable:
    """Places of hashes in a list, by open addressing."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words if len(words) else np.zeros(1, np.uint64)
        self.mask = np.uint64((1 << max(4, int(4 * len(words) - 1).bit_length() if len(words) else 4)) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left, step = np.arange(len(words)), np.uint64(0)
        while len(left):
            place = ((words[left] + step) & self.mask).astype(np.int64)
            free = np.flatnonzero(self.slots[place] < 0)
            _, first = np.unique(place[free], return_index=True)
            self.slots[place[free[first]]] = left[free[first]]
            left, step = np.delete(left, free[first]), step + np.uint64(1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = self.slots[(hashes & self.mask).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.words[at] != hashes))
        step = np.uint64(0)
        while len(other):
            step += np.uint64(1)
            own = self.slots[((hashes[other] + step) & self.mask).astype(np.int64)]
            at[other] = own
            other = other[(own >= 0) & (self.words[own] != hashes[other])]
        return at


@dataclass
class Encoded:
    """Texts with their ends as classes, inputs and slots (-1: the class has no softmax of its own), and what needs no network."""

    classes: np.ndarray
    inputs: np.ndarray
    slots: np.ndarray
    bounds: np.ndarray
    known: np.ndarray  # head words seen in training, of each text
    logs: np.ndarray  # sum of log10(count + 0.5) over head words
    inside: np.ndarray  # sum of log10 P(word | class) where counts give it, but for rare words' log10(count + 0.5)
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]  # bounds, hashes, times of distinct rare words

    def text(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(self.bounds[i], self.bounds[i + 1])
        return self.classes[own], self.inputs[own], self.slots[own]


@dataclass
class Classes:
    """The classes of words. Head words have places in a table; other words belong to the rare class of their cluster."""

    table: WordTable
    counts: np.ndarray  # of head words, as the arrays up to `inputs`
    of_word: np.ndarray
    slot_of: np.ndarray
    input_of: np.ndarray
    n: int
    end: int
    first_chunk: int  # classes from here on have a softmax over their words
    bias: np.ndarray  # (classes with a softmax, CHUNK): log(count + 0.5), or as good as nothing where there is no word
    inputs: int  # rows that the network reads, with the one that begins a text as last
    mass: np.ndarray  # log10 of each class's smoothed tokens: what a word's count + 0.5 is divided by
    tokens: int
    kinds: int

    @classmethod
    def build(cls, head: list[tuple[int, int, int]], rare: dict[int, tuple[int, int]], tokens: int, kinds: int, clusters: int, singles: int, frequent: int = 2048) -> Classes:
        """head: (word, cluster, n) from the most frequent on; rare: for each cluster (tokens, distinct words) of all others."""
        hashes = np.array([h[0] for h in head], np.int64).view(np.uint64)
        cluster, counts = np.array([h[1] for h in head], np.int64), np.array([h[2] for h in head], np.int64)
        first_chunk = singles + 1 + 2 * clusters
        ordinary = np.flatnonzero(hashes != END)
        own, slot = np.full(len(head), singles), np.full(len(head), -1)
        own[ordinary[:singles]] = np.arange(min(singles, len(ordinary)))
        some, rest = ordinary[singles : singles + frequent], ordinary[singles + frequent :]
        own[rest] = singles + 1 + 2 * cluster[rest]
        n = first_chunk
        for k in range(clusters):
            at = some[cluster[some] == k]
            own[at], slot[at] = n + np.arange(len(at)) // CHUNK, np.arange(len(at)) % CHUNK
            n += -(-len(at) // CHUNK)
        bias = np.full((n - first_chunk, CHUNK), -1e9, np.float32)
        bias[own[some] - first_chunk, slot[some]] = np.log(counts[some] + 0.5)
        read = own.copy()
        read[some] = n + np.arange(len(some))
        mass = np.zeros(n)
        np.add.at(mass, own, counts + 0.5)
        for k, (t, d) in rare.items():
            mass[singles + 2 + 2 * k] += t + 0.5 * d
        mass[singles + 2 : first_chunk : 2] += 0.5  # room for an unseen word
        return cls(WordTable(hashes), counts, own, slot, read, n, singles, first_chunk, bias, n + len(some) + 1, np.log10(np.maximum(mass, 0.5)), tokens, kinds)

    def encode(self, texts: list[bytes], spelling: Spelling, sums: bool = True) -> Encoded:
        """Without sums: only what the network reads."""
        data, starts, ends, doc, hashes = _tokens(texts)
        at = self.table.find(hashes)
        hit, miss = at >= 0, np.flatnonzero(at < 0)
        classes, inputs, slots = (np.empty(len(hashes) + len(texts), t) for t in (np.int32, np.int32, np.int8))
        place = np.arange(len(hashes)) + doc
        sizes = np.bincount(doc, minlength=len(texts)) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ended = bounds[1:] - 1
        classes[ended], inputs[ended], slots[ended] = self.end, self.end, -1
        own = np.empty(len(hashes), np.int32)
        if len(self.of_word):
            own[hit] = self.of_word[at[hit]]
        own[miss] = self.end + 2 + 2 * spelling.cluster(data, starts[miss], ends[miss])
        classes[place], inputs[place], slots[place] = own, own, -1
        end_at = int(self.table.find(np.array([END]))[0])
        end_count = int(self.counts[end_at]) if end_at >= 0 else 0
        if len(self.of_word):
            inputs[place[hit]], slots[place[hit]] = self.input_of[at[hit]], self.slot_of[at[hit]]
        if not sums:
            none = np.zeros(len(texts))
            return Encoded(classes, inputs, slots, bounds, none, none, none, (bounds * 0, np.empty(0, np.int64), np.empty(0, np.int64)))
        log, n = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        if len(self.of_word):
            n[hit] = self.counts[at[hit]]
        log[hit] = np.log10(n[hit] + 0.5)
        inside = np.where(slots[place] < 0, log - self.mass[own], 0.0)
        total = lambda x: np.bincount(doc, x, len(texts))
        inside_end = np.log10(end_count + 0.5) - self.mass[self.end]
        order = miss[np.lexsort((hashes[miss], doc[miss]))]
        new = np.flatnonzero(np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])])) if len(order) else np.empty(0, np.int64)
        rare = np.concatenate([[0], np.cumsum(np.bincount(doc[order[new]], minlength=len(texts)))]), hashes[order[new]].view(np.int64), np.diff(np.append(new, len(order)))
        known = np.bincount(doc[hit & (n > 0)], minlength=len(texts)) + (end_count > 0)
        return Encoded(classes, inputs, slots, bounds, known, total(log) + np.log10(end_count + 0.5), total(inside) + inside_end, rare)


Text = tuple[np.ndarray, np.ndarray, np.ndarray]


def in_turn(arrivals: Iterator[tuple[object, Text]], streams: int, window: int, start: int) -> Iterator[tuple]:
    """Keeps `streams` texts going and yields a window of each: streams, those that begin, read, goals, slots, mask (steps x streams), and (stream, key) of those that end.

    When no text is left to begin, the last ones go on in longer windows, so that a window holds about as many tokens.
    """
    keys: list[object] = [None] * streams
    texts: list[np.ndarray | None] = [None] * streams
    place = [0] * streams
    more, fresh = True, []
    while True:
        for s in range(streams) if more else ():
            if texts[s] is None:
                try:
                    keys[s], (classes, inputs, slots) = next(arrivals)
                except StopIteration:
                    more = False
                    break
                texts[s] = own = np.empty((3, len(classes)), np.int32)
                own[0, 0], own[0, 1:], own[1], own[2] = start, inputs[:-1], classes, slots
                place[s] = 0
                fresh.append(s)
        live = [s for s in range(streams) if texts[s] is not None]
        if not live:
            return
        left = np.array([texts[s].shape[1] - place[s] for s in live])
        width = min(window * min(LONGER, streams // len(live)), int(left.max()))
        block, ended = np.empty((len(live), 3, width), np.int32), []
        block[:] = np.array([[start], [0], [-1]])
        for i, s in enumerate(live):
            own = texts[s][:, place[s] : place[s] + width]
            block[i, :, : own.shape[1]] = own
            place[s] += width
        for i in np.flatnonzero(left <= width).tolist():
            ended.append((live[i], keys[live[i]]))
            texts[live[i]] = None
        yield np.array(live), fresh, *np.ascontiguousarray(block.transpose(1, 2, 0)), np.arange(width)[:, None] < left, ended
        fresh = []


def _apart(rows: int, steps: int, streams: int, kind: np.dtype) -> np.ndarray:
    """Room for rows x steps x streams with a gap behind each row: rows whose distance is a power of two would drive each other out of the cache."""
    return np.empty((rows, steps * streams + 16), kind)[:, :-16].reshape(rows, steps, streams)


class Gru:
    """Reads rows of a table, and predicts the next word's class and its slot there. Gates are update, reset and candidate.

    Windows are steps x streams. Inside, streams come last, so that each gate lies in one piece.
    """

    NAMES = ("x", "u", "c", "o", "b", "v", "w")

    def __init__(self, classes: Classes, hidden: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.first_chunk, self.start = hidden, classes.first_chunk, classes.inputs - 1
        draw = lambda scale, *s: rng.normal(0, scale, s).astype(np.float32)
        wide = 1 / np.sqrt(hidden)
        freq = 10.0**classes.mass
        self.p = {"x": draw(0.1, classes.inputs, 3 * hidden), "u": draw(0.5 * wide, hidden, 2 * hidden), "c": draw(0.5 * wide, hidden, hidden), "o": draw(0.1 * wide, hidden, classes.n)}
        self.p |= {"b": np.log(freq / freq.sum()).astype(np.float32), "v": draw(0.1 * wide, len(classes.bias), hidden, CHUNK), "w": classes.bias.copy()}
        self.p = self.parts(self.vector())

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].T.ravel() if k == "x" else self.p[k].ravel() for k in self.NAMES])

    def parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """Views of such a vector by name; x lies there by columns."""
        at, out = 0, {}
        for k in self.NAMES:
            own, shape = vector[at : at + self.p[k].size], self.p[k].shape
            out[k] = own.reshape(shape[::-1]).T if k == "x" else own.reshape(shape)
            at += len(own)
        return out

    def take(self, vector: np.ndarray) -> None:
        self.p = self.parts(vector.astype(self.p["x"].dtype))

    def _forward(self, state: np.ndarray, read: np.ndarray, kept: bool) -> tuple[np.ndarray, ...]:
        """States after each step (units and a row of ones x steps x streams). What the way back needs, else of one step only, is steps x units x streams: gates
        with candidates, states before and behind, resets times states, and what is added to states."""
        hid, p, (steps, streams) = self.hidden, self.p, read.shape
        kind = p["x"].dtype
        u, c = -p["u"].T, p["c"].T
        gates = np.ascontiguousarray(np.take(np.ascontiguousarray(p["x"]), read.ravel(), axis=0, mode="clip").reshape(steps, streams, 3 * hid).transpose(0, 2, 1))
        out, room = _apart(hid + 1, steps, streams, kind), steps if kept else 1
        out[hid] = 1
        states, resets, added = (np.empty((n, hid, streams), kind) for n in (room + 1, room, room))
        by_u, by_c = np.empty((2 * hid, streams), kind), np.empty((hid, streams), kind)
        states[0] = state.T
        with np.errstate(over="ignore"):  # a gate at 1 / inf is shut
            for t in range(steps):
                at = t if kept else 0
                own, h, rh, d = gates[t], states[at], resets[at], added[at]
                g, new = own[: 2 * hid], own[2 * hid :]
                np.matmul(u, h, out=by_u)
                np.subtract(by_u, g, out=g)
                np.exp(g, out=g)  # a sigmoid is 1 / (1 + exp of the negative)
                g += 1
                np.reciprocal(g, out=g)
                np.multiply(g[hid:], h, out=rh)
                np.matmul(c, rh, out=by_c)
                new += by_c
                np.tanh(new, out=new)
                np.subtract(new, h, out=d)
                d *= g[:hid]
                np.add(h, d, out=states[t + 1 if kept else 0])
                out[:hid, t] = states[t + 1 if kept else 0]
        return out, gates, states, resets, added

    def run(self, state: np.ndarray, read: np.ndarray) -> np.ndarray:
        """States after each step."""
        return self._forward(state, read, False)[0][: self.hidden].transpose(1, 2, 0)

    def _tame(self) -> tuple[bool, bool]:
        """Whether no logit of either softmax can be so large that exp() needs it shifted: states lie between -1 and 1."""
        p = self.p
        classes = np.ones(self.hidden, p["o"].dtype) @ np.abs(p["o"]) + np.abs(p["b"])
        slots = (np.ones(self.hidden, p["v"].dtype) @ np.abs(p["v"])) + np.where(p["w"] < -1e8, 0, np.abs(p["w"]))
        return float(classes.max(initial=0)) < 80, float(slots.max(initial=0)) < 80

    def _chunks(self, goal: np.ndarray, slot: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Places of goals in classes with a softmax, sorted by class, and (class, first, last) of each run."""
        at = np.flatnonzero(mask & (slot >= 0))
        own = goal[at] - self.first_chunk
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.empty(0, np.int64)
        return at, [(int(own[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Those of both softmaxes, with the biases as last row: states end with a one."""
        p = self.p
        return np.concatenate([p["o"], p["b"][None]]), np.concatenate([p["v"], p["w"][:, None]], 1)

    @staticmethod
    def _exp(e: np.ndarray, goal: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Makes exp of logits (places x choices) in their place; their sums, log of the goals' shares, and the goals' places in all of e."""
        if not tame:
            e -= e.max(1, keepdims=True)
        at = np.arange(0, e.size, e.shape[1]) + goal
        hit = e.ravel().take(at)
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], e.dtype)
        return total, hit - np.log(total), at

    @staticmethod
    def _slots(states: np.ndarray, weights: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of the slots, of places in runs by class."""
        e = np.empty((states.shape[1], CHUNK), states.dtype)
        for k, a, b in runs:
            np.matmul(states[:, a:b].T, weights[k], out=e[a:b])
        return e

    def log_probs(self, states: np.ndarray, goal: np.ndarray, slot: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """log P(class | state), and of the slot where the class has a softmax; 0 where masked. goal etc. are flat."""
        tame, tame_slots = self._tame()
        weights, weights_of_slots = self._weights()
        states = np.concatenate([states.T, np.ones((1, len(states)), states.dtype)])
        got = np.empty(len(goal), states.dtype)
        for lo in range(0, len(goal), BLOCK):
            some = slice(lo, lo + BLOCK)
            got[some] = self._exp(states[:, some].T @ weights, goal[some], tame)[1]
        got[~mask] = 0
        at, runs = self._chunks(goal, slot, mask)
        got[at] += self._exp(self._slots(np.take(states, at, axis=1), weights_of_slots, runs), slot[at], tame_slots)[1]
        return got

    def slopes(self, read: np.ndarray, goal: np.ndarray, slot: np.ndarray, mask: np.ndarray, state: np.ndarray, into: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean loss over one window by backpropagation through it (added to `into`), the states behind it, and the summed loss.

        A softmax's slopes at the logits are (exp - sum at the goal) * share / sum; the last factor is put on the states and on what comes back, which are narrower.
        """
        hid, p, (steps, streams) = self.hidden, self.p, read.shape
        out, gates, before, resets, added = self._forward(state, read, True)
        g = self.parts(np.zeros(sum(v.size for v in p.values()), out.dtype)) if into is None else into
        goal, slot, mask, states = goal.ravel(), slot.ravel(), mask.ravel(), out.reshape(hid + 1, -1)
        share = out.dtype.type(1 / max(int(mask.sum()), 1))
        tame, tame_slots = self._tame()
        weights, weights_of_slots = self._weights()
        loss, back = 0.0, _apart(hid, steps, streams, out.dtype).reshape(hid, -1)
        for lo in range(0, len(goal), BLOCK):
            some = slice(lo, lo + BLOCK)
            e = states[:, some].T @ weights
            total, logs, hits = self._exp(e, goal[some], tame)
            loss -= float(logs @ mask[some])
            e.reshape(-1)[hits] -= total
            factor = mask[some] * share / total
            own = (e.T @ (states[:, some] * factor).T).T
            g["o"] += own[:hid]
            g["b"] += own[hid]
            np.multiply((e @ p["o"].T).T, factor, out=back[:, some])
        at, runs = self._chunks(goal, slot, mask)
        if runs:
            chosen, slots = np.take(states, at, axis=1), slot[at]
            e = self._slots(chosen, weights_of_slots, runs)
            total, logs, hits = self._exp(e, slots, tame_slots)
            loss -= float(logs.sum())
            e.reshape(-1)[hits] -= total
            factor = share / total
            chosen *= factor
            more, by_slot = np.empty((len(at), hid), out.dtype), np.zeros_like(weights_of_slots)
            for k, a, b in runs:
                np.matmul(chosen[:, a:b], e[a:b], out=by_slot[k])
                np.matmul(e[a:b], p["v"][k].T, out=more[a:b])
            g["v"] += by_slot[:, :hid]
            g["w"] += by_slot[:, hid]
            back[:, at] += more.T * factor
        back, dx = back.reshape(hid, steps, streams), np.empty_like(gates)
        dh, stay, slope = np.zeros((hid, streams), out.dtype), np.empty((2 * hid, streams), out.dtype), np.empty((hid, streams), out.dtype)
        for t in range(steps - 1, -1, -1):
            dg, dc, c = dx[t, : 2 * hid], dx[t, 2 * hid :], gates[t, 2 * hid :]
            dh += back[:, t]
            np.subtract(1, gates[t, : 2 * hid], out=stay)
            np.multiply(c, c, out=slope)
            np.subtract(1, slope, out=slope)
            slope *= gates[t, :hid]
            np.multiply(dh, slope, out=dc)
            drh = p["c"] @ dc
            np.multiply(dh, added[t], out=dg[:hid])
            np.multiply(drh, resets[t], out=dg[hid:])
            dg *= stay
            dh *= stay[:hid]
            drh *= gates[t, hid : 2 * hid]
            dh += drh
            dh += p["u"] @ dg
        g["c"] += (resets @ dx[:, 2 * hid :].transpose(0, 2, 1)).sum(0)
        g["u"] += (before[:-1] @ dx[:, : 2 * hid].transpose(0, 2, 1)).sum(0)
        by_column = g["x"].T.reshape(-1)  # a view: x lies by columns
        np.add.at(by_column, (read[:, None].astype(np.intp) + np.arange(3 * hid)[:, None] * len(p["x"])).ravel(), dx.ravel())
        return g, out[:hid, -1].T, loss

    def train(self, arrivals: Iterator[tuple[object, Text]], rate: float, streams: int = 192, window: int = 32, warm: int = 20) -> tuple[int, float]:
        """Truncated backpropagation over texts, by Adam; returns tokens and the mean loss."""
        values = self.vector()
        self.p = self.parts(values)
        slopes, first, second, spare = (np.zeros_like(values) for _ in range(4))
        g = self.parts(slopes)
        state, tokens, lost, step = np.zeros((streams, self.hidden), np.float32), 0, 0.0, 0
        for live, fresh, read, goal, slot, mask, _ in in_turn(arrivals, streams, window, self.start):
            step += 1
            state[fresh] = 0
            slopes[:] = 0
            _, state[live], loss = self.slopes(read, goal, slot, mask, state[live], g)
            n = int(mask.sum())
            tokens, lost = tokens + n, lost + loss
            pace = rate * min(1.0, step / warm) * min(1.0, (n / (streams * window)) ** 0.5)
            clip, fade = min(1.0, 1.0 / (np.sqrt(float(slopes @ slopes)) + 1e-12)), np.sqrt(1 - 0.99**step)
            for lo in range(0, len(values), PART):
                v, m, s, x = (a[lo : lo + PART] for a in (slopes, first, second, spare))
                v *= np.float32(0.1 * clip)
                m *= np.float32(0.9)
                m += v
                v *= v
                s *= np.float32(0.99)
                s += v
                np.sqrt(s, out=x)
                x += np.float32(1e-7 * fade)
                np.divide(m, x, out=x)
                x *= np.float32(pace * fade / (1 - 0.9**step))
                values[lo : lo + PART] -= x
        return tokens, lost / max(tokens, 1)


@dataclass
class LanguageModel:
    spelling: Spelling
    classes: Classes
    gru: Gru

    def score_texts(self, arrivals: Iterator[tuple[object, Text]], streams: int = 256, window: int = 64) -> Iterator[tuple[object, float]]:
        """(key, text) to (key, log10 of what the network gives it). Texts end in any order."""
        state, total = np.zeros((streams, self.gru.hidden), np.float32), np.zeros(streams)
        for live, fresh, read, goal, slot, mask, ended in in_turn(arrivals, streams, window, self.gru.start):
            state[fresh], total[fresh] = 0, 0
            out = self.gru.run(state[live], read)
            got = self.gru.log_probs(out.reshape(-1, self.gru.hidden), goal.ravel(), slot.ravel(), mask.ravel())
            total[live] += got.reshape(goal.shape).sum(0, dtype=np.float64)
            state[live] = out[-1]
            for s, key in ended:
                yield key, float(total[s]) / np.log(10)


def build_classes(counts: DataFrame, clusters: int, singles: int, frequent: int) -> Classes:
    """The classes from the counts of all training documents."""
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    # The most frequent words by a cut through a histogram of sizes: a sort with a limit would send the driver a full list from every task.
    level = F.floor(F.log2("n") * 16)
    cut, room = None, HEAD_WORDS
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 16 rows a doubling
        room -= r["count"]
        if room < 0:
            break
        cut = r["level"]
    rows = [] if cut is None else counts.where(level >= cut).collect()  # at most HEAD_WORDS
    head = sorted(((r["word"], r["cluster"], r["n"]) for r in rows), key=lambda h: (-h[2], h[0]))
    if int(END) not in {h[0] for h in head}:
        head += [(r["word"], r["cluster"], r["n"]) for r in counts.where(F.col("word") == int(END)).collect()]
    by_cluster = {r["cluster"]: [r["t"], r["d"]] for r in counts.groupBy("cluster").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")).collect()}  # a row a cluster
    for _, cluster, n in head:
        by_cluster[cluster][0] -= n
        by_cluster[cluster][1] -= 1
    return Classes.build(head, {c: (t, d) for c, (t, d) in by_cluster.items()}, int(total["tokens"] or 0), int(total["kinds"]), clusters, singles, frequent)


#: Shares that a task of training should have of as many documents as a task of all has: with few documents, most of its streams would wait for the longest.
TASK_SHARES = 8
#: Shares of documents that each round trains on, all of them in the end, and the rates: from few documents to many, with smaller steps.
ROUNDS = ((0, 1, 8e-3), (1, 4, 5e-3), (4, SHARES, 2.5e-3))


def train(learn: DataFrame, model: LanguageModel) -> None:
    """Trains the network on the executors, on every document of `learn`."""
    passes = min(MOST_PASSES, max(1, -(-LEAST_TOKENS // max(1, model.classes.tokens))))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    rounds, parts = [*ROUNDS], learn.rdd.getNumPartitions() if passes == 1 else 0
    if passes > 1:  # a small corpus: all of it, several times
        rounds = [(0, SHARES, rate) for _, _, rate in ROUNDS]
        passes = -(-passes // len(rounds))
    for lo, hi, rate in rounds:

        def task(batches: Iterator[pa.RecordBatch], rate: float = rate) -> Iterator[pa.RecordBatch]:
            def texts() -> Iterator[tuple[int, Text]]:
                for batch in pieces_of(batches, "text", STEP):
                    own = model.classes.encode(as_bytes(batch.column("text")), model.spelling, sums=False)
                    for i in range(batch.num_rows):
                        yield 0, own.text(i)

            rows = texts()
            if passes > 1:
                held = list(rows)
                rows = (held[i] for k in range(passes) for i in np.random.default_rng(k).permutation(len(held)))
            tokens, _ = model.gru.train(rows, rate)
            if tokens:
                own = np.append(model.gru.vector() * np.float32(tokens / 1e6), np.float32(tokens / 1e6))
                yield pa.RecordBatch.from_arrays([pa.array([partition_id()], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], ["pid", "v"])

        own = learn.where((share >= lo) & (share < hi)).select("text")
        if (joined := TASK_SHARES // (hi - lo)) > 1:
            own = own.coalesce(-(-parts // joined))
        total = vector_sum(own.mapInArrow(task, "pid int, v binary"))
        if total is not None:
            model.gru.take((total[:-1] / total[-1]).astype(np.float32))


def score_documents(docs: DataFrame, singles: int = 56, hidden: int = 24, clusters: int = 8, frequent: int = 2048, start_docs: int = 256) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    rows = docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = rows.where(~F.col("held_out")).select("doc_id", "text")
    spelling = fit_spelling(learn, clusters, start_docs)
    counts = keep(count_words(learn, spelling), "word-counts")
    classes = build_classes(counts, clusters, singles, frequent)
    model = LanguageModel(spelling, classes, Gru(classes, hidden))
    train(learn, model)
    n_all, v_all = classes.tokens, classes.kinds
    base_mass = float(np.log10(n_all + 0.5 * (v_all + 1)))
    kinds = {"row_id": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = partition_id() << 40
        waiting: dict[int, list] = {}

        def arrivals() -> Iterator[tuple[int, Text]]:
            key = 0
            for batch in pieces_of(batches, "text", STEP):
                ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
                own = classes.encode(as_bytes(batch.column("text")), spelling)
                edges, rare, times = own.rare
                for i in range(batch.num_rows):
                    n, at = int(own.bounds[i + 1] - own.bounds[i]), slice(edges[i], edges[i + 1])
                    waiting[key] = [ids[i], held[i], n, int(own.known[i]), float(own.logs[i]) - n * base_mass, float(own.inside[i]), rare[at], times[at]]
                    yield key, own.text(i)
                    key += 1

        def out(done: list[tuple[int, list]]) -> pa.RecordBatch:
            columns = [pa.array([first + k for k, _ in done], pa.int64())]
            columns += [pa.array([row[i] for _, row in done], kind) for i, kind in enumerate([*kinds.values()][1:])]
            return pa.RecordBatch.from_arrays(columns, [*kinds])

        done: list[tuple[int, list]] = []
        for key, log10 in model.score_texts(arrivals()):
            row = waiting.pop(key)
            row[5] += log10
            done.append((key, row))
            if len(done) >= 1000:
                yield out(done)
                done = []
        if done:
            yield out(done)

    scored = keep(rows.mapInArrow(run, "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>"), "scored")
    # Counts of rare words: a document's sum of log10(count + 0.5) over them is all that is missing in both scores.
    pairs = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row_id", F.col("t.rare").alias("word"), F.col("t.times").alias("times"))
    met = pairs.join(counts.select("word", "n").hint("shuffle_hash"), "word", "left")  # a word has one row, so no task's map is large
    n = F.coalesce("n", F.lit(0))
    sums = met.groupBy("row_id").agg(F.sum(F.col("times") * F.log10(n + 0.5)).alias("logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"))
    both = scored.drop("rare", "times").join(sums, "row_id", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
