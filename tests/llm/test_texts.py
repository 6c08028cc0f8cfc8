"""Fingerprints, rules, line field, near duplicates, and the language model against brute force or held-out labels."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_edges import EDGES

from lodestone.llm import fingerprint, line_crf, near_dedup, quality_rules, recurrent_lm, wordbpe, wordhash
from lodestone.llm.shared import keep, pieces_of, vector_sum


WORD = re.compile("[^\x20\x09-\x0d]+")


def test_word_hashes():
    data = b" one two\tone\n" + b"two one"
    words, hashes = wordhash.word_hashes(np.frombuffer(data, np.uint8), np.array([0, 4, 13, 20]))
    assert [data[a:b] for a, b in zip(words.starts, words.ends)] == [b"one", b"two", b"one", b"two", b"one"] and words.doc.tolist() == [0, 1, 1, 2, 2]
    assert hashes[0] == hashes[2] == hashes[4] != hashes[1]
    own, doc = wordhash.shingle_hashes(words, hashes, 2)
    assert doc.tolist() == [0, 1, 2] and own[1] == own[2] != own[0]


# Fingerprints.


def test_fingerprints_are_homomorphic():
    lines = [b"one line", b"another", b"", b"one line", b"x" * 100_000, "é".encode()]
    own = fingerprint.fingerprints([b"\n".join(lines), b"\n".join(lines[::-1]), b"\n".join(lines[:-1])])
    assert (own[0] == own[1]).all() and (own[0] != own[2]).any()
    assert (fingerprint.remove(own[0], lines[-1]) == own[2]).all() and (fingerprint.add(own[2], lines[-1]) == own[0]).all()
    assert (fingerprint.from_text(fingerprint.as_text(own)[0]) == own[0]).all()
    assert fingerprint.likeness(own[:1], own[1:2])[0] == 1 and fingerprint.likeness(own[:1], fingerprint.fingerprints([b"nothing of that at all"]))[0] < 0.2
    empty = fingerprint.fingerprints([b"", b"abc"])
    assert fingerprint.likeness(empty[:1], empty[:1])[0] == 1 and fingerprint.likeness(empty[:1], empty[1:])[0] == 0


def test_fingerprint_edits(spark, docs, made_docs, edge_docs, no_docs):
    rows = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    assert len(rows) == len(made_docs)
    nearer = 0
    for k, (i, text, _) in enumerate(made_docs):
        after = made_docs[(k + 1) % len(made_docs)][1]
        cut = len(text) // 4
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
        nearer += rows[i].near_edited > rows[i].near_next
    same = defaultdict(set)
    for i, text, _ in made_docs:
        same[text].add(rows[i].fingerprint)
    assert all(len(s) == 1 for s in same.values()) and nearer > 0.95 * len(rows)
    assert fingerprint.fingerprint_edits(edge_docs).count() == len(EDGES) and fingerprint.fingerprint_edits(no_docs).count() == 0
    assert fingerprint.fingerprint_edits(docs.limit(1)).first().near_next == 1.0


def test_likeness_against_the_true_jaccard(made_docs):
    """The multiset Jaccard of paragraphs' windows of eight bytes, by counting them."""

    def windows(text):
        found = Counter()
        for line in text.encode().split(b"\n"):
            found.update([line[i : i + 8] for i in range(len(line) - 7)] or ([line] if line else []))
        return found

    pairs = []
    for k in range(0, 200, 2):
        a, b = made_docs[k][1], made_docs[k + 1][1]
        cut = len(a) // (2 + k % 9)
        pairs.append((a, a[: len(a) - cut] + b[:cut]))
    left, right = (fingerprint.fingerprints([p[i].encode() for p in pairs]) for i in (0, 1))
    want = []
    for a, b in pairs:
        x, y = windows(a), windows(b)
        want.append((x & y).total() / (x | y).total())
    apart = np.abs(fingerprint.likeness(left, right) - want)
    assert apart.mean() < 0.05 and apart.max() < 0.25 and min(want) < 0.5 < 0.8 < max(want)


# Rules.


def base_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_rules(docs, labels, made_docs, edge_docs, no_docs):
    rules = quality_rules.fit_rules(docs, labels)
    assert rules and str(rules[0]).startswith("reject if ")
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs, rules).collect()}
    for i, text, quality in made_docs:
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words, rows[i].base_failed) == base_stats(text)
        assert rows[i].kept == (quality == 1 and not rows[i].base_failed)
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(edge_docs, []).collect())
    assert got == sorted((i or -1, *base_stats(t)) for i, t in EDGES)
    assert quality_rules.apply_rules(no_docs, rules).count() == 0
    kept = quality_rules.keep_good(edge_docs, [])
    assert kept.columns == edge_docs.columns and kept.count() == sum(not base_stats(t)[-1] for _, t in EDGES)
    assert quality_rules.fit_rules(no_docs, labels) == [] and quality_rules.fit_rules(docs, labels.where("quality = 1")) == []


def _plain_covering(rows, good, grow, most_rules, most_conditions, precision, cuts):
    """The same covering by plain loops over rows."""
    n, rules = len(good), []
    holds = lambda c, i: rows[c[0]][i] >= c[2] if c[1] else rows[c[0]][i] <= c[2]
    left = set(range(n))
    while len(rules) < most_rules and len({bool(good[i]) for i in left if grow[i]}) == 2:
        able = []
        for keep in (False, True):
            inside, found = [i for i in left if grow[i]], []
            while len(found) < most_conditions and len({bool(good[i]) for i in inside}) == 2:
                p, all_in, best = sum(bool(good[i]) == keep for i in inside), len(inside), (0.0, None)
                for f in quality_rules.FEATURES:
                    own, hit = [rows[f][i] for i in inside], [rows[f][i] for i in inside if bool(good[i]) == keep]
                    for at_least in (True, False):
                        top = None
                        for edge in sorted({*np.quantile(own, np.linspace(0, 1, cuts + 1)), *np.quantile(hit, np.linspace(0, 1, cuts // 2 + 1))}):
                            inner = [i for i in inside if holds((f, at_least, edge), i)]
                            pos = sum(bool(good[i]) == keep for i in inner)
                            gain = pos * (math.log2(pos / len(inner)) - math.log2(p / all_in)) if pos else -1
                            if top is None or gain > top[0] + 1e-12:
                                top = (gain, (f, at_least, float(edge)))
                        if top[0] > best[0] + 1e-12:
                            best = top
                if best[1] is None:
                    break
                found.append(best[1])
                inside = [i for i in inside if holds(best[1], i)]

            def worth(conditions, keep=keep):
                covered = [bool(good[i]) == keep for i in left if not grow[i] and all(holds(c, i) for c in conditions)]
                return sum(covered) / len(covered) if any(covered) else 0.0, sum(covered)

            while len(found) > 1 and worth(found[:-1]) >= worth(found):
                found.pop()
            if found and worth(found)[0] >= precision:
                able.append((worth(found)[0], not keep, found))
        if not able:
            break
        _, reject, found = max(able, key=lambda x: x[:2])
        rules.append((found, not reject))
        left -= {i for i in left if all(holds(c, i) for c in found)}
    if rules and rules[-1][1] and any(not good[i] and not grow[i] for i in left) and not any(good[i] for i in left):
        rules.append(([], False))
    while rules and rules[-1][1]:
        rules.pop()
    return rules


def test_covering_against_plain_loops():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        rows = {f: rng.integers(0, 12, 150).astype(float) for f in quality_rules.FEATURES}
        f = quality_rules.FEATURES
        good = ~((rows[f[1]] > 7) & (rows[f[2]] < 9) | (rows[f[4]] > 10)) ^ (rng.random(150) < 0.03)
        grow = np.arange(150) % 3 != 0
        got = quality_rules.learn_rules(rows, good, grow, 6, 3, 0.8, 10)
        assert [([(c.feature, c.at_least, c.threshold) for c in r.conditions], r.keep) for r in got] == _plain_covering(rows, good, grow, 6, 3, 0.8, 10)
        assert got


def test_the_order_of_rules_counts(spark):
    """Texts of many symbols are bad, but those in capitals are good whatever they hold: a keep rule stands before a wider reject rule."""
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 4, 600)  # 0, 1: plain; 2: symbols; 3: symbols in capitals
    rows = {f: np.zeros(600) for f in quality_rules.FEATURES}
    rows["symbols_a_word"] = np.where(kind >= 2, 1.0, 0.0) + rng.random(600) * 0.1
    rows["upper_a_char"] = np.where(kind == 3, 0.9, 0.05) + rng.random(600) * 0.01
    rules = quality_rules.learn_rules(rows, kind != 2, np.arange(600) % 3 != 0)
    decided = np.ones(600, bool)
    for rule in reversed(rules):
        decided = np.where(rule.holds(rows), rule.keep, decided)
    assert (decided == (kind != 2)).mean() > 0.98
    first, second = quality_rules.Rule((quality_rules.Condition("upper_a_char", True, 0.3),), True), quality_rules.Rule((quality_rules.Condition("symbols_a_word", True, 0.5),), False)
    text = " ".join(f"WORD{i}***" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text.lower())], "doc_id long, text string")
    kept = lambda rules: [r.kept for r in quality_rules.apply_rules(docs, rules).orderBy("doc_id").collect()]
    assert kept([first, second]) == [True, False] and kept([second, first]) == [False, False]


def test_rules_need_no_python(spark, sf, capsys):
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]
    quality_rules.apply_rules(tables[0], quality_rules.fit_rules(*tables)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and not re.search("Python|Pandas|Arrow", plan)


# Line field.


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    score, chain = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, pairs, total = line_crf.forward_backward(score, chain, counts)
    want, z_all, want_pairs, at = np.zeros(8), 0.0, np.zeros((2, 2)), 0
    for n in counts:
        z, m, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(1 << n):
            y = [(k >> i) & 1 for i in range(n)]
            w = math.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1)))
            z, m = z + w, m + w * np.array(y)
            for i in range(n - 1):
                p[y[i], y[i + 1]] += w
        want[at : at + n], z_all, want_pairs, at = m / z, z_all + math.log(z), want_pairs + p / z, at + n
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and math.isclose(total, z_all)


def _made_lines(counts, seed=3):
    rng = np.random.default_rng(seed)
    n = int(counts.sum())
    return line_crf.Lines(rng.normal(size=(n, line_crf.WIDTH)).astype(np.float32), np.full(n, 5), counts)


def test_likelihood_of_the_line_field():
    """The value against all labellings of all lines, the gradient against differences of the value."""
    counts, good, noise = np.array([3, 1, 4]), np.array([True, False, False]), 0.2
    lines = _made_lines(counts)
    theta = np.random.default_rng(1).normal(0, 0.3, line_crf.WIDTH + 4)
    value, slope = line_crf.likelihood(theta, lines, good, noise, 0.01, 0.03)
    score, chain, at, want = lines.features @ theta[:-4], theta[-4:].reshape(2, 2), 0, 0.0
    for n, label in zip(counts, good, strict=True):
        weights = [(y, math.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1)))) for y in itertools.product((0, 1), repeat=int(n))]
        seen = sum(w * math.prod(1 - noise if own == label else noise for own in y) for y, w in weights)
        want += math.log(seen / sum(w for _, w in weights)) * (1.5 if label else 0.75)
        at += n
    want = want / 8 - 0.005 * (theta[:-4] ** 2).sum() - 0.015 * (theta[-4:] ** 2).sum()
    assert math.isclose(value, want, rel_tol=1e-5)
    for k in (0, 7, line_crf.WIDTH - 1, *range(line_crf.WIDTH, line_crf.WIDTH + 4)):
        step = np.zeros_like(theta)
        step[k] = 1e-4
        up, down = (line_crf.likelihood(theta + s, lines, good, noise, 0.01, 0.03)[0] for s in (step, -step))
        assert math.isclose((up - down) / 2e-4, slope[k], abs_tol=1e-4)


def test_the_chain_is_learned():
    """Lines of one document have one label: a chain is learned that holds neighbours together, with no weight at a bound."""
    counts = np.full(60, 6)
    lines, good = _made_lines(counts), np.arange(60) % 2 == 0
    lines.features[:, 0] += np.repeat(np.where(good, 0.7, -0.7), 6)
    model = line_crf.fit(lines, good)
    assert 0.2 < model.chain[0, 0] + model.chain[1, 1] - model.chain[0, 1] - model.chain[1, 0] < 10 and abs(model.chain).max() < 2.5
    flat = line_crf.fit(line_crf.Lines(lines.features, lines.length, np.ones(360, np.int64)), np.repeat(good, 6))
    assert not flat.chain.any()  # documents of a line say nothing about neighbours


def test_long_texts_are_learned_from_by_evenly_spaced_lines(spark):
    rows = [(i, "\n".join(["good words here"] * 50 if i % 2 else ["*** $$$ !!!"] * 50)) for i in range(24)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    model = line_crf.fit_documents(docs, labels, max_lines=100)  # five lines of each, so all texts enter
    assert all(r.predicted == r.doc_id % 2 for r in line_crf.score_documents(docs, model).collect())


def test_learning_lines_sends_the_driver_no_more_than_it_takes(spark):
    """What leaves the executors is bounded by max_lines, not by max_docs texts of many lines each."""
    long = "\n".join(["one two three"] * 400)
    docs = spark.createDataFrame([(i, f"{i}\n{long}") for i in range(300)], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "4m")
    try:
        model = line_crf.fit_documents(docs, labels, max_lines=6000)
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert model.weights.any()


def test_caches_of_a_resting_worker_go():
    bpe = wordbpe.WordBpe(wordbpe.default_path())
    for _ in bpe.hold(iter([0])):
        bpe.ids(b"some words, and more")
    bpe.ids(b"a last one")
    assert bpe.words and bpe.parts
    bpe.leaving.join(60)
    assert not bpe.words and not bpe.parts
    assert bpe.ids(b"some words, and more") == wordbpe.WordBpe(wordbpe.default_path()).ids(b"some words, and more")


def test_steps_are_cut_by_lines():
    batch = pa.RecordBatch.from_pydict({"text": ["\n" * 1000] * 8})
    assert [b.num_rows for b in pieces_of(iter([batch]), "text", 10_000, 0, 9)] == [1] * 8
    assert [b.num_rows for b in pieces_of(iter([batch]), "text", 10_000)] == [8]


def test_line_quality_on_held_out(docs, labels, made_docs, edge_docs, no_docs):
    model = line_crf.fit_documents(docs, labels)
    rows = {r.doc_id: r for r in line_crf.score_documents(docs, model).collect()}
    held = [(i, q) for i, _, q in made_docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in rows.items() if r.held_out} == {i for i, _ in held}
    assert np.mean([rows[i].predicted == q for i, q in held]) > 0.97
    edges = line_crf.score_documents(edge_docs, model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert line_crf.score_documents(no_docs, model).count() == 0
    kept = line_crf.keep_good(edge_docs, model)
    assert kept.columns == edge_docs.columns
    alone = line_crf.fit_documents(docs, labels.where("quality = 1"))
    assert {r.score for r in line_crf.score_documents(docs, alone).collect()} == {1.0}
    assert {r.score for r in line_crf.score_documents(edge_docs, line_crf.fit_documents(no_docs, labels)).collect()} == {0.5}


# Near duplicates.


def sets_of(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {("none", text or "")}


def true_classes(rows):
    """Class of each row by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(rows))]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = np.arange(0, 240), np.arange(60, 300)
    wa, wb = np.exp(rng.normal(size=300)), np.exp(rng.normal(size=300))
    k = 4096
    own = near_dedup.signatures(np.repeat([0, 1], 240), hashes[np.concatenate([a, b])], np.concatenate([wa[a], wb[b]]), 2, k)
    both = np.arange(60, 240)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = wa[a], wb[b]
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    assert abs((own[0] == own[1]).mean() - want) < 5 * math.sqrt(want * (1 - want) / k)
    one = near_dedup.signatures(np.array([0, 2]), hashes[:2], np.ones(2), 3, 64)
    assert (one[0] == hashes[0]).all() and (one[1] == 0).all()


def test_near_duplicates(docs, made_docs, edge_docs, no_docs):
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    root = true_classes([(i, t) for i, t, _ in made_docs])
    assert [rows[i].class_id for i, _, _ in made_docs] == [made_docs[r][0] for r in root]
    assert sum(r.is_first for r in rows.values()) == len(set(root))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({made_docs[r][0] for r in root})
    found = near_dedup.near_duplicates(edge_docs).collect()
    assert len(found) == len(EDGES) and {r.class_id for r in found if r.doc_id in (2, 3)} == {2}
    assert near_dedup.drop_near_duplicates(edge_docs).count() == len({r.node for r in found if r.class_id != 2 or r.is_first})
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.drop_near_duplicates(no_docs).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = [" ".join(base)]
    for i in range(300):  # each is near the first, many are not near each other
        own = list(base)
        for at in rng.choice(200, 3, replace=False):
            own[at] = f"c{i}x{at}"
        texts.append(" ".join(own))
    texts += [" ".join(f"o{i}w{x}" for x in range(60)) for i in range(50)]
    rows = [(1000 + (7 * i) % 401, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    root = true_classes(rows)
    want = {}
    for (i, _), r in zip(rows, root):
        want.setdefault(r, []).append(i)
    for ids in want.values():
        assert {found[i] for i in ids} == {min(ids)}


def test_near_copies_within_a_family_of_shared_boilerplate(spark):
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in rng.permutation(204)]
    own = [[f"d{i}x{k}" for k in range(28)] for i in range(400)]  # strangers: Jaccard 200 / 256
    for i in range(0, 60, 2):  # thirty pairs of Jaccard 206 / 250
        own[i + 1][:6] = own[i][:6]
    rows = [(i, " ".join(base + o)) for i, o in enumerate(own)]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [found[i] for i in range(400)] == true_classes(rows)


def test_near_copies_of_which_one_repeats_passages(spark):
    rows = []
    for i in range(60):  # sixty pairs of Jaccard about 0.82
        base = [f"p{i}w{k}" for k in range(130)]
        a, b = base + [f"a{i}x{k}" for k in range(10)], base + [f"b{i}x{k}" for k in range(10)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b + base[:65] * 100))]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    root = true_classes(rows)
    assert [found[i] for i, _ in rows] == root and root == [i // 2 * 2 for i in range(120)]


def test_alike_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in rng.integers(1, 6000, 30)]
    sets += [s[: max(1, int(len(s) * 0.9))] for s in sets]
    group = np.arange(60) % 50
    as_sets = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if group[i] != group[j] and len(as_sets[i] & as_sets[j]) >= 0.8 * len(as_sets[i] | as_sets[j]) - 1e-9}
    assert {*zip(*(x.tolist() for x in near_dedup.alike_sets(sets, group, 0.8)))} == want and len(want) > 15


def test_components(spark):
    links = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(60)] + [(b"x", b"y"), (b"y", b"z"), (b"q", b"q")]
    rows = {bytes(r.node): bytes(r.root) for r in near_dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert {rows[b"%03d" % i] for i in range(1, 61)} == {b"000"} and rows[b"z"] == rows[b"y"] == b"x" and b"q" not in rows
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


# Language model.


def tokens_of(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split() + [None]


def small_classes(n_words=60, singles=4, clusters=2, frequent=40):
    """Head words of two clusters and the end; two clusters of rare words."""
    head = [(i * 1_000_003 + 7, i % clusters, 90 - i) for i in range(n_words)] + [(int(recurrent_lm.END), 0, 9)]
    rare = {0: (30, 12), 1: (11, 11)}
    return recurrent_lm.Classes.build(head, rare, 5000, n_words + 24, clusters, singles, frequent), head, rare


def double(net):
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_network_gradients():
    classes, _, _ = small_classes()
    net, rng = double(recurrent_lm.Gru(classes, 5)), np.random.default_rng(2)
    places = rng.integers(0, 61, (6, 3))
    read, goal, slot, mask = classes.input_of[rng.integers(0, 61, (6, 3))], classes.of_word[places], classes.slot_of[places], rng.random((6, 3)) > 0.2
    state = rng.normal(size=(3, 5)) * 0.3
    slopes, behind, loss = net.slopes(read, goal, slot, mask, state)
    assert (slot[mask] >= 0).any() and (slot[mask] < 0).any()
    out = net.run(state, read)
    assert np.allclose(out[-1], behind) and math.isclose(loss, -net.log_probs(out.reshape(-1, 5), goal.ravel(), slot.ravel(), mask.ravel()).sum())
    k = next(goal[i, j] - net.first_chunk for i, j in np.argwhere(mask) if slot[i, j] >= 0)
    spots = {"x": (int(read[0, 0]), 3), "v": (k, 2, 1), "w": (k, 3)}
    for name, p in net.p.items():
        at, step = spots.get(name) or tuple(rng.integers(0, n) for n in p.shape), 1e-4
        was = p[at]
        p[at] = was + step
        up = net.slopes(read, goal, slot, mask, state)[2]
        p[at] = was - step
        down = net.slopes(read, goal, slot, mask, state)[2]
        p[at] = was
        assert abs((up - down) / (2 * step) / mask.sum() - slopes[name][at]) < 1e-6, name


def test_language_model(docs, made_docs, edge_docs, no_docs):
    for rows, frame in (([(i, t) for i, t, _ in made_docs], docs), (EDGES, edge_docs)):
        counts = Counter()
        for i, t in rows:
            if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
                counts.update(tokens_of(t))
        n, v = sum(counts.values()), len(counts)
        want = sorted((-1 if i is None else i, len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t)), 4)) for i, t in rows)
        got = recurrent_lm.score_documents(frame, hidden=8, start_docs=50).collect()
        assert [x[:4] for x in want] == sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got)
        assert np.allclose(sorted(w[4] for w in want), sorted(r.base_score for r in got), atol=1e-3)
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
        if frame is docs:
            held = [r for r in got if r.held_out]
            assert sum(r.score for r in held) > 1.001 * sum(r.base_score for r in held)  # words come in no order here
    assert recurrent_lm.score_documents(no_docs).count() == 0


def plain_word(net, classes, state, place, cluster=0, n=None):
    """log10 P(word | state) by the definition. place: of a head word, or None for a rare word of the cluster with count n."""
    own = int(classes.of_word[place]) if place is not None else classes.end + 2 + 2 * cluster
    logits = state @ net.p["o"] + net.p["b"]
    total = (logits[own] - np.log(np.exp(logits).sum())) / np.log(10)
    if own >= net.first_chunk:
        inner = state @ net.p["v"][own - net.first_chunk] + net.p["w"][own - net.first_chunk]
        return total + (inner[classes.slot_of[place]] - np.log(np.exp(inner).sum())) / np.log(10)
    return total + math.log10((classes.counts[place] if place is not None else n) + 0.5) - classes.mass[own]


def plain_step(net, state, read):
    x, h = net.p["x"][read], state
    z, r = np.split(1 / (1 + np.exp(-(x[: 2 * net.hidden] + h @ net.p["u"]))), 2)
    return h + z * (np.tanh(x[2 * net.hidden :] + (r * h) @ net.p["c"]) - h)


def test_the_network_is_trained_on_every_training_document(docs, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "LEAST_TOKENS", 1)  # one pass, as over a large corpus
    seen = []
    monkeypatch.setattr(recurrent_lm, "vector_sum", lambda rows: seen.append(vector_sum(rows)) or seen[-1])
    row = recurrent_lm.score_documents(docs, hidden=8, clusters=4, start_docs=50).first()
    trained = [total[-1] for total in seen if total is not None and len(total) != 4 * 4097]  # the others are sums for the clusters
    assert abs(sum(trained) * 1e6 - row.train_tokens) < 1


def test_few_documents_are_trained_on_in_few_tasks(docs, monkeypatch):
    """A round on a sixteenth of the documents must not spread them over as many tasks as all of them have."""
    monkeypatch.setattr(recurrent_lm, "LEAST_TOKENS", 1)
    tasks = []
    monkeypatch.setattr(recurrent_lm, "vector_sum", lambda rows: tasks.append(rows.rdd.getNumPartitions()))
    classes, _, _ = small_classes()
    spelling = recurrent_lm.Spelling(np.zeros((4096, 2), np.float32), np.zeros(2, np.float32))
    spread_out = keep(docs.select("doc_id", "text").repartition(16), "sixteen-files")
    most = spread_out.rdd.getNumPartitions()
    recurrent_lm.train(spread_out, recurrent_lm.LanguageModel(spelling, classes, recurrent_lm.Gru(classes, 4)))
    assert tasks == [-(-most // (8 // (hi - lo) or 1)) for lo, hi, _ in recurrent_lm.ROUNDS] and tasks[0] < most


def test_the_last_texts_go_on_in_longer_windows():
    text = tuple(np.arange(65, dtype=np.int32) for _ in range(3))
    widths = [read.shape for _, _, read, *_ in recurrent_lm.in_turn(iter([(0, text)]), 8, 8, 99)]
    assert widths == [(32, 1), (32, 1), (1, 1)]
    texts = [(k, text) for k in range(8)]
    assert {read.shape for _, _, read, *_ in recurrent_lm.in_turn(iter(texts), 8, 8, 99)} == {(8, 8), (1, 8)}  # no stream waits


def test_word_probabilities_sum_to_one():
    classes, head, rare = small_classes()
    net = double(recurrent_lm.Gru(classes, 5))
    state = np.random.default_rng(1).normal(size=5)
    total = sum(10 ** plain_word(net, classes, state, k) for k in range(len(head)))
    for cluster, (tokens, distinct) in rare.items():  # words whose counts add up to `tokens`, and an unseen one
        counts = [tokens - distinct + 1] + [1] * (distinct - 1) + [0]
        total += sum(10 ** plain_word(net, classes, state, None, cluster, n) for n in counts)
    # Classes without a word (all but the medium class of clusters whose words are all frequent) hold what is left.
    empty = [c for c in range(classes.end + 1, classes.first_chunk, 2) if not (classes.of_word == c).any()]
    logits = state @ net.p["o"] + net.p["b"]
    total += sum(np.exp(logits[c]) for c in empty) / np.exp(logits).sum()
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_scores_against_a_plain_loop():
    """Texts in turn, windowed and batched, against a word-by-word loop over the definition."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    spelling = recurrent_lm.Spelling(np.random.default_rng(3).normal(size=(4096, 2)).astype(np.float32), np.zeros(2, np.float32))
    hash_of = {w: int(recurrent_lm._tokens([w.encode()])[4].view(np.int64)[0]) for w in words}
    cluster_of = {w: int(spelling.cluster(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words}
    head = [(hash_of[w], cluster_of[w], 200 - k) for k, w in enumerate(words[:60])] + [(int(recurrent_lm.END), 0, 9)]
    classes = recurrent_lm.Classes.build(head, {0: (5, 4), 1: (6, 6)}, 9000, 70, 2, 4, 40)
    net = double(recurrent_lm.Gru(classes, 4))
    net.p["v"] *= 20
    model, rng = recurrent_lm.LanguageModel(spelling, classes, net), np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, n)) for n in (0, 3, 200, 17, 64, 1, 90)]
    own = classes.encode([t.upper().encode() for t in texts], spelling)
    got = dict(model.score_texts(((i, own.text(i)) for i in range(len(texts))), streams=3, window=8))
    alone = dict(model.score_texts(iter([(2, own.text(2))]), streams=1, window=1000))
    assert math.isclose(got[2], alone[2], rel_tol=1e-5)
    place_of = {w: k for k, w in enumerate(words[:60])} | {None: 60}
    for i, text in enumerate(texts):
        state, read, want = np.zeros(4), classes.inputs - 1, 0.0
        for w in [*text.split(), None]:
            state = plain_step(net, state, read)
            place = place_of.get(w)
            cluster = cluster_of.get(w, 0)
            want += plain_word(net, classes, state, place, cluster, 0)
            read = classes.input_of[place] if place is not None else classes.end + 2 + 2 * cluster
        rare = sum(w not in place_of for w in text.split())
        assert math.isclose(got[i] + own.inside[i] + rare * math.log10(0.5), want, rel_tol=1e-4)
        assert own.known[i] == len(text.split()) - rare + 1 and sum(own.rare[2][own.rare[0][i] : own.rare[0][i + 1]]) == rare


def test_training_steps_share_one_vector():
    """Parameters and slopes are parts of one vector each, which a step fills; training encodes without the sums that only scores need."""
    classes, _, _ = small_classes()
    net, rng = recurrent_lm.Gru(classes, 5), np.random.default_rng(6)
    places = rng.integers(0, 61, (6, 3))
    window = classes.input_of[rng.integers(0, 61, (6, 3))], classes.of_word[places], classes.slot_of[places], rng.random((6, 3)) > 0.2
    alone, _, loss = net.slopes(*window, np.zeros((3, 5), np.float32))
    vector = np.zeros_like(net.vector())
    again, _, same = net.slopes(*window, np.zeros((3, 5), np.float32), net.parts(vector))
    assert loss == same and all(np.array_equal(alone[k], again[k]) and np.shares_memory(again[k], vector) for k in net.p)
    assert all(np.array_equal(net.parts(net.vector())[k], net.p[k]) for k in net.p)
    spelling = recurrent_lm.Spelling(rng.normal(size=(4096, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = [b"one two one", b"", b"three"]
    full, part = classes.encode(texts, spelling), classes.encode(texts, spelling, sums=False)
    assert all(np.array_equal(a, b) for i in range(3) for a, b in zip(full.text(i), part.text(i), strict=True))


def test_windows_and_clusters_against_plain_loops():
    rng = np.random.default_rng(8)
    texts = [tuple(rng.integers(0, 9, (3, n)).astype(np.int32)) for n in (1, 30, 8, 7, 65, 1)]
    got = {k: [] for k in range(len(texts))}
    at_stream = {}
    arriving = iter(range(len(texts)))
    for live, fresh, read, goal, slot, mask, ended in recurrent_lm.in_turn(enumerate(texts), 3, 8, 99):
        at_stream |= {s: next(arriving) for s in fresh}
        for i, s in enumerate(live.tolist()):
            own = mask[:, i]
            got[at_stream[s]] += zip(read[own, i], goal[own, i], slot[own, i], strict=True)
            assert (read[~own, i] == 99).all() and (slot[~own, i] == -1).all()
        assert all(at_stream[s] == k for s, k in ended)
    for k, (classes, inputs, slots) in enumerate(texts):
        assert got[k] == list(zip([99, *inputs[:-1]], classes, slots, strict=True))
    data = np.frombuffer("the caf\u00e9 x1-- q".encode(), np.uint8)
    starts, ends = np.array([0, 4, 10, 15]), np.array([3, 9, 14, 16])
    spelling = recurrent_lm.Spelling(rng.normal(size=(4096, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    kind = lambda b: b - 96 if 97 <= b <= 122 else 32 + b % 32 if b >= 128 else 0 if b < 33 else 27 + b % 5
    for s, e, found in zip(starts, ends, spelling.cluster(data, starts, ends), strict=True):
        kinds = [0, *map(kind, data[s:e].tolist())]
        score = spelling.prior.astype(float) + sum(spelling.table[x * 64 + y].astype(float) for x, y in zip(kinds[:-1], kinds[1:], strict=True))
        assert found == np.argmax(score)


def test_word_table():
    rng = np.random.default_rng(0)
    words = np.unique(np.concatenate([rng.integers(0, 1 << 62, 5000), np.arange(50) << 40])).astype(np.uint64)
    table = recurrent_lm.WordTable(words)
    assert (table.find(words) == np.arange(len(words))).all() and (table.find(words + np.uint64(1 << 63)) == -1).all()
    assert (recurrent_lm.WordTable(np.empty(0, np.uint64)).find(words) == -1).all()


def test_the_network_learns_order():
    """A text where each word fixes the next one, by words of one class: only a second factor that sees the state can tell them."""
    classes, _, _ = small_classes(60, 2, 1, 58)
    net, rng = recurrent_lm.Gru(classes, 16), np.random.default_rng(5)
    line = np.arange(400) * 7 % 58 + 2  # a fixed successor for each frequent word

    def texts():
        for k in range(300):
            at = np.roll(line, int(rng.integers(400)))[:100]
            yield k, (classes.of_word[at], classes.input_of[at], classes.slot_of[at])

    net.train(texts(), 1e-2, streams=16)
    model = recurrent_lm.LanguageModel(None, classes, net)
    scores = [x for _, x in model.score_texts(texts())]
    assert np.mean(scores) / 100 > -0.6  # uniform choice is -1.76 a word


def test_vector_sum(spark):
    rows = [(i, np.full(5, i, np.float32).tobytes()) for i in range(100)]
    got = vector_sum(spark.createDataFrame(rows, "pid int, v binary").repartition(7))
    assert got.tolist() == [4950.0] * 5 and vector_sum(spark.createDataFrame([], "pid int, v binary")) is None
