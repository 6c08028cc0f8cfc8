"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score comes from its own features and those of the lines before and behind it; the chain
adds weights for pairs of neighbouring labels. Forward-backward gives each line's marginal probability of being good, and a
document's quality is their mean weighted by length.

Training data name only whole documents, so the lines' labels are latent: a document's label is seen at each of its lines through a channel that
turns it round with probability `noise`. A line may so be bad within a good document, and neighbouring labels may change, which is what the chain
learns from. The likelihood of what is seen is a difference of two log normalisers, with and without the channel, and its gradient a difference of
two forward-backward runs; documents of both labels weigh the same in all parts of it.

The field is fit in numpy on the driver on a bounded sample: the `max_docs` smallest hashes of labelled ids, until `max_lines` lines. Of a text of
more than max_lines / 20 lines, that many enter, evenly spaced, with features from the whole text; a text that would pass max_lines is left out and smaller ones after
it may enter. Texts are chosen by their counts of lines first, so no more than max_lines rows of features leave the executors, which compute them.

Edge cases: a null or empty text is one empty line; without usable labels of both kinds every score is the share of good ones (0.5 without
any); repeated rows give repeated rows; a null doc_id is never held out and never learned from; a text of very many lines takes one
vectorised step a line, very long lines one pass over their bytes; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, pieces_of, small_batches
from .wordhash import find_words, mix, prefix, range_hash

#: Classes of bytes whose share in a line is a feature.
KINDS = {
    "symbol": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "bang": b"!",
    "bar": b"|",
    "stop": b".",
    "mark": b",;:?\"'()[]{}",
    "markup": b"<>=/\\_@",
    "wide": bytes(range(128, 256)),
}
OWN = 2 * len(KINDS) + 8
#: Own features, those of both neighbours, and a constant.
WIDTH = 3 * OWN + 1
#: Text bytes of a step, and what a line costs beside its text, in bytes of text: some thousand bytes, where a byte of text takes forty.
STEP, LINE = 1 << 20, 24


@dataclass
class Lines:
    """Feature rows of all lines, the length of each, and how many each text has."""

    features: np.ndarray
    length: np.ndarray
    counts: np.ndarray


def line_features(texts: list[bytes]) -> Lines:
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    n = len(starts)
    doc = np.repeat(np.arange(len(texts)), counts)
    own = np.zeros((n, OWN), np.float32)
    size = np.maximum(length, 1)
    for k, members in enumerate(KINDS.values()):
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        share = np.add.reduceat(table[data], starts, dtype=np.int64) / size
        own[:, 2 * k], own[:, 2 * k + 1] = share, share > 0.06
    at = 2 * len(KINDS)
    words = find_words(data, np.array([0, len(data)]))
    line = np.searchsorted(starts, words.starts, side="right") - 1
    n_words = np.bincount(line, minlength=n)
    sums = prefix(data)
    hashes = range_hash(sums, words.starts, words.ends)
    order = np.lexsort((hashes, line))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    kinds = np.bincount(line[order][new], minlength=n)
    whole = mix(range_hash(sums, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
    order = np.argsort(whole, kind="stable")
    again = np.zeros(n, bool)
    again[order[1:]] = whole[order][1:] == whole[order][:-1]
    own[:, at] = length == 0
    own[:, at + 1] = np.minimum(np.log1p(length) / 8, 2)
    own[:, at + 2] = np.minimum(np.log1p(n_words) / 6, 2)
    own[:, at + 3] = np.minimum(np.bincount(line, words.ends - words.starts, n) / np.maximum(n_words, 1) / 10, 3)
    own[:, at + 4] = again & (length > 0)
    own[:, at + 5] = 1 - kinds / np.maximum(n_words, 1)
    own[:, at + 6] = n_words <= 2
    own[:, at + 7] = own[:, at + 5] > 0.6
    features = np.zeros((n, WIDTH), np.float32)
    features[:, :OWN] = own
    features[1:, OWN : 2 * OWN] = own[:-1] * (doc[1:] == doc[:-1])[:, None]
    features[:-1, 2 * OWN : 3 * OWN] = own[1:] * (doc[1:] == doc[:-1])[:, None]
    features[:, -1] = 1
    return Lines(features, length, counts)


def _steps(counts: np.ndarray) -> Iterator[np.ndarray]:
    """For line 0, 1, ... of the texts: the rows of those that have one, texts in order of falling length."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    live = len(order)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        while live and sizes[live - 1] <= t:
            live -= 1
        yield begin[:live] + t


def forward_backward(score: np.ndarray, chain: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, expected counts of label pairs (2, 2), and the log normaliser of all texts; the two sums weigh texts by `weight`.

    score: each line's score of good over bad; chain[i, j]: weight of label i before label j. Messages are kept as normalised probabilities.
    """
    weight = np.ones(len(counts)) if weight is None else weight
    in_order = weight[np.argsort(-counts, kind="stable")]  # as _steps() takes texts
    steps = list(_steps(counts))
    move = np.exp(chain - chain.max())
    local = np.stack([-np.logaddexp(0, score), -np.logaddexp(0, -score)], 1)  # log probabilities of bad, good by the line alone
    here = np.exp(local)
    forward = np.empty_like(here)
    total = float(np.logaddexp(0, score) @ np.repeat(weight, counts))
    for t, rows in enumerate(steps):
        a = here[rows] * 0.5 if t == 0 else (forward[rows - 1] @ move) * here[rows]
        scale = a.sum(1, keepdims=True)
        forward[rows] = a / scale
        total += float((np.log(scale[:, 0]) + (chain.max() if t else np.log(2))) @ in_order[: len(rows)])
    marginal = np.empty(len(score))
    pairs = np.zeros((2, 2))
    after = np.ones((len(counts), 2))
    for t in range(len(steps) - 1, -1, -1):
        rows = steps[t]
        beta = after[: len(rows)]
        m = forward[rows] * beta
        marginal[rows] = (m / m.sum(1, keepdims=True))[:, 1]
        if t:
            follow = here[rows] * beta
            joint = forward[rows - 1][:, :, None] * move[None] * follow[:, None, :]
            pairs += np.tensordot(in_order[: len(rows)], joint / joint.sum((1, 2), keepdims=True), 1)
            back = follow @ move.T
            after[: len(rows)] = back / back.sum(1, keepdims=True)
    return marginal, pairs, total


@dataclass
class LineCrf:
    weights: np.ndarray
    chain: np.ndarray
    default: float = 0.5

    def document_scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(texts), self.default)
        lines = line_features(texts)
        marginal, _, _ = forward_backward(lines.features @ self.weights, self.chain, lines.counts)
        begin = np.cumsum(lines.counts) - lines.counts
        weight = lines.length + 1.0
        return np.clip(np.add.reduceat(marginal * weight, begin) / np.add.reduceat(weight, begin), 0, 1)


def likelihood(theta: np.ndarray, lines: Lines, good: np.ndarray, noise: float, ridge: float, chain_ridge: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood a line of the documents' labels seen through the channel, less the ridges, and its gradient.

    theta: the weights of features, then the chain. Both labels weigh the same, whatever their shares.
    """
    score, chain = lines.features @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    even = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    a_line, rows = np.repeat(even, lines.counts), len(lines.features)
    lean = np.repeat(np.where(good, 1.0, -1.0), lines.counts) * np.log((1 - noise) / noise)
    free, free_pairs, all_labels = forward_backward(score, chain, lines.counts, even)
    told, told_pairs, these = forward_backward(score + lean, chain, lines.counts, even)
    seen_if_bad = float(np.where(lean > 0, np.log(noise), np.log(1 - noise)) @ a_line)
    held = np.concatenate([np.full(WIDTH, ridge), np.full(4, chain_ridge)])
    value = (these + seen_if_bad - all_labels) / rows - 0.5 * float(held @ theta**2)
    slope = np.concatenate([lines.features.T @ ((told - free) * a_line), (told_pairs - free_pairs).ravel()]) / rows - held * theta
    return value, slope


def fit(lines: Lines, good: np.ndarray, rounds: int = 150, rate: float = 0.1, noise: float = 0.05, ridge: float = 1e-4, chain_ridge: float = 0.02) -> LineCrf:
    """Maximum likelihood with a ridge, by Adam over all lines. good: the label of each text."""
    share = float(good.mean()) if len(good) else 0.5
    if not len(good) or good.all() or not good.any():
        return LineCrf(np.zeros(WIDTH), np.zeros((2, 2)), share)
    theta = np.zeros(WIDTH + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        _, slope = likelihood(theta, lines, good, noise, ridge, chain_ridge)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta += rate * min(1.0, 3 * (1 - t / (rounds + 1))) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return LineCrf(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), share)


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """Whether the CRC-32 of the id in decimal leaves 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_lines: int = 120_000, use_held_out: bool = False) -> LineCrf:
    """Fits on at most max_docs labelled documents, never on held-out ones unless told to. labels: doc_id, quality."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    if not use_held_out:
        known = known.where(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    small_batches(docs.sparkSession)
    most = max(1, max_lines // 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", STEP, 0, LINE):
            lines = line_features(as_bytes(batch.column("text")))
            stops = np.cumsum(lines.counts)
            taken = [a + (np.arange(n) if n <= most else np.arange(most) * n // most) for a, n in zip((stops - lines.counts).tolist(), lines.counts.tolist(), strict=True)]
            data = [lines.features[at].astype(np.float16).tobytes() for at in taken]
            sizes = [lines.length[at].astype(np.int64).tobytes() for at in taken]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "own")), pa.array(data, pa.binary()), pa.array(sizes, pa.binary()), pa.array([len(at) for at in taken], pa.int64())], ["doc_id", "quality", "own", "features", "length", "n"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(sample), "doc_id")  # the rows of at most max_docs ids
    rows = rows.withColumn("own", F.xxhash64("text"))
    lines_of = F.least(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(most)).cast("long")
    first = rows.select("doc_id", "quality", "own", lines_of.alias("n")).orderBy(F.xxhash64("doc_id"), "n", "own", "quality").limit(max_docs)
    chosen: dict[tuple[int, int, int], int] = {}  # key: doc_id, quality and hash of a text; how many rows of it
    total = 0
    for r in first.collect():
        if total + r["n"] <= max_lines:
            key = r["doc_id"], r["quality"], r["own"]
            chosen[key] = chosen.get(key, 0) + 1
            total += r["n"]
    if not chosen:
        return LineCrf(np.zeros(WIDTH), np.zeros((2, 2)))
    wanted = F.broadcast(docs.sparkSession.createDataFrame([*chosen], "doc_id long, quality int, own long"))
    texts = rows.join(wanted, ["doc_id", "quality", "own"], "left_semi").dropDuplicates(["doc_id", "quality", "own"])
    made = texts.mapInArrow(run, "doc_id long, quality int, own long, features binary, length binary, n long")
    by_key = {(r["doc_id"], r["quality"], r["own"]): r for r in made.collect()}  # at most max_lines lines
    found = [by_key[key] for key, times in chosen.items() for _ in range(times)]
    lines = Lines(
        np.frombuffer(b"".join(bytes(r["features"]) for r in found), np.float16).reshape(-1, WIDTH).astype(np.float32),
        np.frombuffer(b"".join(bytes(r["length"]) for r in found), np.int64),
        np.array([r["n"] for r in found]),
    )
    return fit(lines, np.array([r["quality"] == 1 for r in found]))


def score_documents(docs: DataFrame, model: LineCrf) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", STEP, 0, LINE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.document_scores(as_bytes(batch.column("text"))))], ["doc_id", "held_out", "score"])

    small_batches(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    rows = docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: LineCrf, threshold: float = 0.5) -> DataFrame:
    """The documents (all columns) whose score is at least the threshold. Rows pass through as they are."""
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", STEP, 0, LINE):
            scores = model.document_scores(as_bytes(batch.column("text")))
            yield batch.filter(pa.array(scores >= threshold))

    if docs.schema["text"].dataType.simpleString() != "string":
        raise ValueError("column text must hold strings")
    return docs.mapInArrow(run, docs.schema).select(*[F.col(f"`{c}`") for c in names])
