"""Infilling, whitening and the language model against brute force, with odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgersieve.llm import infill, katz, whitening

LONG = "".join(f"é line {i} {'x' * (i % 90)}\n" for i in range(6000)) + "no end"
ODD = [None, "", "\n", "\n\n", "one", "one\n", "é\nñ\n漢字", "has <P> mark\nb", "a\r\nb\n\nc", LONG, LONG, "y" * 200_000, "a\nb\nc\nd\ne\nf\ng\nh"]


def table(spark, texts, ids=None):
    rows = [(i, t, "n", "f") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, frames string")


def plain_infill(doc_id, text, policy):
    text = text or ""
    units = list(text) if policy.unit == "char" else re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{policy.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= policy.rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < policy.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("policy", [infill.Policy(), infill.Policy(seed=11, rate=60, spm=30), infill.Policy(seed=3, unit="char")])
def test_infill_against_slices(spark, policy):
    texts = ODD * 3
    docs = table(spark, texts, [None, *range(1, len(texts) - 1), 1])
    outputs = infill.arranged(infill.framed(docs), policy).cache()
    want = [(str(i), *plain_infill(i, t, policy)) for i, t in zip([None, *range(1, len(texts) - 1), 1], texts, strict=True)]
    key = lambda row: tuple(map(str, row))
    got = [(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in infill.texts(outputs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    sums = infill.digests(outputs).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), r.output_sha256) for r in sums) == sorted((w[0], digest(w[5])) for w in want)
    assert sorted(r.restored_sha256 for r in sums) == sorted(digest(t) for t in texts)


def test_frames_between_cuts_are_taken_over(spark):
    row = infill.framed(table(spark, [LONG])).collect()[0]
    held = [f.asDict() for f in row.frames]
    assert len(held) > 4 and [f["bytes"] for f in held] == sorted(f["bytes"] for f in held)
    assert b"".join(infill.read(held, 0, row.n_bytes, row.n_bytes)).decode() == LONG
    assert b"".join(infill.read(held, 70_001, 140_003, row.n_bytes)) == LONG.encode()[70_001:140_003]
    out = infill.arranged(infill.framed(table(spark, [LONG] * 20))).collect()
    kept = {bytes(f["data"]) for f in held}
    assert all(len({bytes(p.data) for p in r.out} & kept) >= len(held) - 2 for r in out)


def test_infill_of_an_empty_table_and_of_clashing_names(spark):
    assert infill.digests(infill.arranged(infill.framed(table(spark, []).limit(0)))).count() == 0
    named = table(spark, ["a\nb"]).withColumnRenamed("doc_id", "frames_").selectExpr("frames_ AS n", "text")
    row = infill.digests(infill.arranged(infill.framed(named, "n"), id_col="n")).collect()[0]
    assert row.n == 0 and row._n == 2 and row.restored_sha256 == hashlib.sha256(b"a\nb").hexdigest()


def embeddings(spark, vectors, kind="array<float>"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, component int, n string")


def plain_whitening(vectors, k):
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    white = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x]) @ parts / np.sqrt(values)
    return n, deviation, white, values / np.trace(centred.T @ centred / n)


def test_whitening_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    vectors = list((rng.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32))
    odd = [None, [float("nan")] * 20, [math.inf] + [0.0] * 19, [None] + [0.0] * 19, [], [1.0, 2.0], [1e30] * 20]
    rows = whitening.scaled(embeddings(spark, [*vectors, *vectors[:40], *odd]))
    got = whitening.whitened(rows, whitening.fit(rows, 16)).collect()
    n, deviation, white, share = plain_whitening([*vectors, *vectors[:40]], 16)
    assert len(got) == 340 * 16 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    found = np.zeros_like(white)
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max() < 1e-9


def test_sums_stay_exact_for_large_entries(spark):
    vectors = [[2.0 ** 40 + i, -(2.0 ** 41) * i, 3.0] for i in range(50)]
    rows = whitening.scaled(embeddings(spark, vectors, "array<double>"))
    model = whitening.fit(rows, 3)
    x = [[int(64 * c) + 1_000_000 for c in v] for v in vectors]
    assert model.sums == [sum(c) for c in zip(*x, strict=True)]
    want = [sum((50 * c - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.whitened(rows, model).collect()}
    assert got == {i: d if d < 2 ** 63 else None for i, d in enumerate(want)}


def test_whitening_without_variance_or_rows(spark):
    for vectors in ([], [[1.0, 2.0]] * 3, [None]):
        rows = whitening.scaled(embeddings(spark, vectors))
        assert whitening.whitened(rows, whitening.fit(rows)).count() == 0
    flat = whitening.scaled(embeddings(spark, [[i, 2 * i, 5] for i in range(9)]))
    assert {r.component for r in whitening.whitened(flat, whitening.fit(flat)).collect()} == {1}


@pytest.mark.parametrize("make", [
    lambda rng: rng.standard_normal((400, 48)), lambda rng: rng.standard_normal((400, 48)) * np.logspace(0, -6, 48),
    lambda rng: rng.standard_normal((5, 48)), lambda rng: np.repeat(rng.standard_normal((300, 12)), 4, axis=1),
])
def test_contours_miss_no_eigenvalue(make):
    rows = make(np.random.default_rng(3))
    matrix = rows.T @ rows / len(rows)
    want = np.linalg.eigvalsh(matrix)[::-1]
    parts = whitening.slices_of(matrix, 16)
    values = np.sort(np.concatenate([whitening.contour(matrix, *part)[0] for part in parts]))[::-1][:16]
    assert len(values) == min(16, (want > want[0] * 1e-12).sum())
    assert np.abs(values - want[:len(values)]).max() < 1e-13 * want[0]
    for shift in (want[0] * 1.01, want[3] * 1.0001, want[1] * 0.999):
        assert whitening.below(matrix, shift) == (want < shift).sum()


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w] + ["</s>"]


class PlainKatz:
    """The model by its definition, over dictionaries of strings."""

    def __init__(self, texts, order):
        self.order = order
        self.follow = [defaultdict(Counter) for _ in range(order)]
        for text in texts:
            words = words_of(text)
            for i, w in enumerate(words):
                for n in range(order):
                    if (h := self.context(words, i, n)) is not None:
                        self.follow[n][h][w] += 1
        self.factors = []
        for level in self.follow:
            counts = Counter(c for words in level.values() for c in words.values())
            self.factors.append(katz.discounts([counts[r] for r in range(1, katz.CUTOFF + 2)]))

    @staticmethod
    def context(words, i, n):
        if n == 0:
            return ()
        if i >= n:
            return tuple(words[i - n:i])
        return ("<s>", *words[:i]) if i == n - 1 else None

    def p(self, n, h, w):
        seen = self.follow[n].get(h)
        if not seen and n:
            return self.p(n - 1, h[1:], w)
        factors, cutoff = self.factors[n]
        d = lambda c: factors[c] if c <= katz.CUTOFF else 1.0
        seen = seen or {}
        total = sum(seen.values()) + all(c > cutoff for c in seen.values())
        if w in seen:
            return d(seen[w]) * seen[w] / total
        left = 1 - sum(d(c) * c for c in seen.values()) / total
        if not n:
            return left
        lower = h[1:]
        return left / (1 - sum(self.p(n - 1, lower, v) for v in seen)) * self.p(n - 1, lower, w)

    def score(self, text):
        words, total = words_of(text), 0.0
        for i, w in enumerate(words):
            n = next(n for n in range(self.order - 1, -1, -1) if self.context(words, i, n) is not None)
            total += math.log10(self.p(n, self.context(words, i, n), w))
        return total


def corpus(rng, n):
    line = lambda: " ".join(rng.choice(["a", "B", "c", "d", "e", "f", "gg", "é"] + [f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 25)))
    return [line() for _ in range(n)] + [None, "", "  ", "A\tb\nnew", "a a a a a a a a a", "x" * 700 + " a b"]


@pytest.mark.parametrize("order,n", [(1, 60), (2, 60), (2, 400), (3, 120), (2, 3)])
def test_scores_against_plain_katz(spark, order, n):
    texts = corpus(random.Random(order * n), n)
    train = lambda i: i % 4 != 1
    plain = PlainKatz([t for i, t in enumerate(texts) if train(i)], order)
    docs = table(spark, texts).repartition(3)
    got = {r.doc_id: r for r in katz.scored(katz.fit(docs, F.col("doc_id") % 4 != 1, order=order)).collect()}
    unigrams = plain.follow[0][()]
    size = sum(unigrams.values())
    for i, text in enumerate(texts):
        r, words = got[i], words_of(text)
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train(i), len(words), sum(w in unigrams for w in words), size)
        base = sum(math.log10((unigrams[w] + 0.1) / (size + 0.1 * (len(unigrams) + 1))) for w in words)
        assert abs(r.base_score - base) < 1e-9 * (1 + abs(base)) and abs(r.score - plain.score(text)) < 1e-9 * (1 + abs(r.score)), (i, text)


def test_every_context_adds_up_to_one():
    plain = PlainKatz(corpus(random.Random(2), 80), 3)
    known = [*plain.follow[0][()], "never seen"]
    for n in (1, 2):
        for h in list(plain.follow[n])[:40]:
            assert abs(sum(plain.p(n, h, w) for w in known) - 1) < 1e-9


def test_tables_hold_the_model(spark):
    texts = corpus(random.Random(8), 150)
    plain = PlainKatz(texts, 2)
    model = katz.fit(table(spark, texts), F.lit(True), order=2)
    bigrams = katz.ngrams(model, 2).collect()
    assert sorted(r["count"] for r in bigrams) == sorted(c for words in plain.follow[1].values() for c in words.values())
    assert sorted(round(r["p"], 12) for r in bigrams) == sorted(round(plain.p(1, h, w), 12) for h, words in plain.follow[1].items() for w in words)
    weights = [r["backoff"] for r in katz.contexts(model, 2).collect()]
    want = [plain.p(1, h, "never seen") / plain.p(0, (), "never seen") for h in plain.follow[1]]
    assert np.allclose(sorted(weights), sorted(want), rtol=1e-9)
    unigrams = katz.ngrams(model, 1).collect()
    assert sorted(r["count"] for r in unigrams) == sorted(plain.follow[0][()].values())


def test_scores_without_training_rows_or_documents(spark):
    docs = table(spark, ["a b", None])
    got = {r.doc_id: r for r in katz.scored(katz.fit(docs, F.lit(False))).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].base_score, got[i].score) for i in (0, 1)] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert katz.scored(katz.fit(docs.limit(0), F.lit(True))).count() == 0
    clash = docs.select(F.col("doc_id").alias("score"), "text")
    assert "_score" in katz.scored(katz.fit(clash, F.lit(True), id_col="score")).columns


def test_words_across_texts_and_lengths():
    texts = [None, "", "a", "  A b\tc\n", "x" * 7 + " " + "x" * 8 + " " + "x" * 9, "é" * 300 + " é", "漢字 漢字", "y" * 600 + " " + "y" * 601, " "]
    hashes, sizes = katz.tokens(pa.array(["z", *texts, "z"]).slice(1, len(texts)))
    words = [w for t in texts for w in words_of(t)]
    assert list(sizes) == [len(words_of(t)) for t in texts] and len(hashes) == len(words)
    assert len({(w, h) for w, h in zip(words, hashes, strict=True)}) == len(set(words)) == len(set(hashes))
    for values in ([], [0, 0], [1, 2, 300], [2 ** 40, 5]):
        assert list(katz.unpack(katz.pack(np.array(values, dtype=np.uint64)))) == values
