"""Toxic documents by a subsequence string-kernel support vector machine with Nyström landmarks (operator 2).

The kernel of two spans is that of Lodhi et al., "Text classification using string kernels" (JMLR 2002), for subsequences of four
letters that stretch over at most seven: each common subsequence counts decay**(stretch in one) * decay**(stretch in the other), so letters
put into or left between an insult's letters only weaken a match. A span is a word set apart by white space, of which
only letters remain (so that marks put between letters vanish, and digits and signs that stand for letters are read as these), with a
boundary sign at either end; single letters in a row are joined to one span more.

Nyström: a span is described by its kernel values with some landmark spans, whitened by the landmarks' own kernel matrix, and a linear SVM with squared
hinge loss is fitted by Newton's method. A labelled sentence is as toxic as its most toxic span: a toxic document's
spans compete, and the winner is retrained on (multiple-instance SVM), with all spans of the clean ones against it.
Since every landmark is a sum of explicit subsequences, the fitted function folds into one weight a subsequence; scoring
a span is a sum of table lookups and doesn't depend on the number of landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .minhash import signatures
from .words import fingerprint, spans, text_bytes, words

TRAIN_DOCS, LANDMARKS, ROUNDS, DECAY, STRETCH, LETTERS, SEED = 3000, 600, 3, 0.8, 7, 40, 42
#: Evidence (Dunning's G) from which a span counts as toxic in training, and how often each such span is also shown with one letter, and with two, put in at each place.
SIGNIFICANT, INSERTED = 12.0, 4
#: Clean spans that training solves first (all others within the margin, less SLACK, join them); weight of either kind of span in all; the share of it for clean documents' highest spans; how much inserted insults count beside the toxic documents in the choice of the threshold.
START, WEIGHT, HARD, SLACK, INSERTED_COUNT = 2000, 5000.0, 0.8, 0.05, 0.2
#: How much oftener a share of toxic documents than of clean ones must hold a span or four letters that speak for toxicity.
RATIO = 10
OTHER = 27
_OFFSETS = [c for c in combinations(range(1, STRETCH), 3)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_CODE = np.zeros(256, np.int32)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    _CODE[[ord(_c), ord(_c.upper())]] = _i
for _c, _l in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.items():
    _CODE[ord(_c)] = ord(_l) - 96
_CODE[0xC2:0xF5] = OTHER
#: The second byte of U+00C0 to U+00FF: frequent letters count as such, others without their accent.
_ACCENT = np.full(256, OTHER, np.int32)
for _i, (_c, _l) in enumerate(zip("aaaaaaaceeeeiiii?nooooo?ouuuuy?s" * 2, "àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþß" * 2)):
    _ACCENT[0x80 + _i] = 28 + "áäçèéêíñóöüß".index(_l) if _l in "áäçèéêíñóöüß" else OTHER if _c == "?" else ord(_c) - 96


def letters(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the spans' letters with a boundary (0) at either end, on end; and where each span begins."""
    size = ends - starts
    owner = np.repeat(np.arange(len(starts)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    x = b[at]
    code = _CODE[x]
    lead = np.flatnonzero(x == 0xC3)
    lead = lead[lead + 1 < len(x)]
    code[lead] = _ACCENT[x[lead + 1]]
    # "!" ends many words: a sign stands for a letter only before another letter.
    sign = np.flatnonzero((x == 33) | (x == 36) | (x == 64))
    code[sign[(sign + 1 >= len(x)) | (owner[np.minimum(sign + 1, len(x) - 1)] != owner[sign]) | (_CODE[x[np.minimum(sign + 1, len(x) - 1)]] == 0)]] = 0
    keep = code > 0
    code, owner = code[keep], owner[keep]
    n = np.bincount(owner, minlength=len(starts))
    first = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.zeros(first[-1], np.int32)
    out[np.arange(len(code)) + 2 * owner + 1] = code
    return out, first


def subsequences(code: np.ndarray, first: np.ndarray, decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: where its subsequences begin, their numbers, and their weight."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(code))
    for a, b, c in _OFFSETS:
        at = np.flatnonzero(left > c)
        yield at, ((code[at] * LETTERS + code[at + a]) * LETTERS + code[at + b]) * LETTERS + code[at + c], decay ** (c + 1)


def norms(first: np.ndarray, decay: float) -> np.ndarray:
    """A span's length in the feature space, were all its subsequences different."""
    n = np.diff(first)[:, None]
    shapes = np.array([c for _, _, c in _OFFSETS])[None, :]
    return np.sqrt((np.maximum(n - shapes, 0) * decay ** (2 * (shapes + 1))).sum(1)) + 1e-9


@dataclass
class Model:
    """score(span) = sum of weights of its subsequences / norm + bias; a document is toxic if its highest span exceeds threshold."""

    weights: np.ndarray
    bias: float
    threshold: float
    decay: float

    def score(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        out, lo = np.zeros(len(first) - 1), 0
        while lo < len(out):  # parts that fit into a processor's cache
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 17), "right")) - 1)
            part = first[lo : hi + 1] - first[lo]
            total = np.zeros(part[-1])
            for at, number, weight in subsequences(code[first[lo] : first[hi]], part, self.decay):
                total[at] += weight * self.weights[number]
            out[lo:hi] = np.add.reduceat(total, part[:-1]) / norms(part, self.decay) + self.bias
            lo = hi
        return out


@dataclass
class Spans:
    """Distinct spans of a batch of texts; of[i] and doc[i]: the span and the text of each occurrence."""

    code: np.ndarray
    first: np.ndarray
    of: np.ndarray
    doc: np.ndarray


def read(texts: pa.Array | pa.ChunkedArray) -> Spans:
    b, off = text_bytes(texts)
    starts, ends = spans(b, off, ~_SPACE)
    doc = np.searchsorted(off, starts, "right") - 1
    # Single letters in a row (each one byte, or two of UTF-8) become one span more.
    one = (ends - starts == 1) | ((ends - starts == 2) & (b[np.minimum(starts, max(len(b) - 1, 0))] >= 0xC2)) if len(b) else np.zeros(0, bool)
    joined_from, joined_to = [], []
    if len(starts):
        link = one[1:] & one[:-1] & (doc[1:] == doc[:-1])
        begin = np.flatnonzero(one & ~np.concatenate([[False], link]))
        end = np.flatnonzero(one & ~np.concatenate([link, [False]]))
        long = end - begin >= 2
        joined_from, joined_to = starts[begin[long]], ends[end[long]]
    _, rep, of = np.unique(fingerprint(b, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[rep], ends[rep]
    if len(joined_from):
        of = np.concatenate([of, len(s) + np.arange(len(joined_from))])
        s, e = np.concatenate([s, joined_from]), np.concatenate([e, joined_to])
        doc = np.concatenate([doc, np.searchsorted(off, joined_from, "right") - 1])
    code, first = letters(b, s, e)
    return Spans(code, first, of, doc)


def document_scores(texts: pa.Array | pa.ChunkedArray, model: Model) -> np.ndarray:
    """Each text's highest span score; -inf without a word."""
    out = np.full(len(texts), -np.inf)
    size = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary()) if isinstance(texts, pa.Array) else texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0)
    # About 8 MB at a time.
    part = (np.cumsum(size) // (8 << 20)).astype(np.int64)
    for lo, hi in zip(np.flatnonzero(np.diff(part, prepend=-1)), [*np.flatnonzero(np.diff(part, prepend=-1))[1:], len(texts)]):
        s = read(texts.slice(lo, hi - lo))
        score = model.score(s.code, s.first)
        np.maximum.at(out, s.doc + lo, score[s.of])
    return out


def _table(code: np.ndarray, first: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, subsequence, value) of all spans' features, divided by their norms."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts = [(owner[at], number, np.full(len(at), w)) for at, number, w in subsequences(code, first, decay)]
    o, f, v = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return o, f, v / norms(first, decay)[o]


def _take(code: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[which]
    new = np.concatenate([[0], np.cumsum(n)])
    return code[np.arange(new[-1]) - np.repeat(new[:-1], n) + np.repeat(first[which], n)], new


def _on_end(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], a[1][-1] + b[1][1:]])


def _inserted(code: np.ndarray, first: np.ndarray, letters_in: int, times: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans with random letters put in: one at every place `times` over, each time with letters_in - 1 more at random places; and which span each comes from."""
    out, of = [], []
    for i in range(len(first) - 1):
        word = code[first[i] + 1 : first[i + 1] - 1]
        for place in np.repeat(np.arange(len(word) + 1), times):
            now = np.insert(word, place, rng.integers(1, 27))
            for _ in range(letters_in - 1):
                now = np.insert(now, rng.integers(0, len(now) + 1), rng.integers(1, 27))
            out.append(np.concatenate([[0], now, [0]]).astype(np.int32))
            of.append(i)
    n = np.array([len(x) for x in out], np.int64)
    return np.concatenate([*out, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(n)]), np.array(of, np.int64)


def _features(marks: tuple[np.ndarray, np.ndarray], decay: float) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' subsequences, and their values as a matrix of subsequences by landmarks."""
    o, f, v = _table(*marks, decay)
    used, col = np.unique(f, return_inverse=True)
    phi = np.zeros((len(used), len(marks[1]) - 1), np.float32)
    np.add.at(phi, (col, o), v)
    return used, phi


def _kernel(x: tuple[np.ndarray, np.ndarray], features: tuple[np.ndarray, np.ndarray], decay: float, white: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of spans x with the landmarks whose _features these are, times `white` if given."""
    used, phi = features
    out = np.empty((len(x[1]) - 1, phi.shape[1]) if white is None else (len(x[1]) - 1, white.shape[1]), np.float64 if white is None else np.float32)
    for lo in range(0, len(out), 2000):
        k = np.zeros((min(2000, len(out) - lo), phi.shape[1]))
        part = _take(*x, np.arange(lo, min(lo + 2000, len(out))))
        po, pf, pv = _table(*part, decay)
        at = np.minimum(np.searchsorted(used, pf), len(used) - 1)
        hit = used[at] == pf
        po, at, pv = po[hit], at[hit], pv[hit]
        by = np.argsort(po, kind="stable")
        po, at, pv = po[by], at[by], pv[by]
        if len(po):
            begin = np.flatnonzero(np.diff(po, prepend=-1))
            step = 500
            for g in range(0, len(begin), step):
                a = begin[g]
                z = begin[g + step] if g + step < len(begin) else len(po)
                k[po[begin[g : g + step]]] = np.add.reduceat(phi[at[a:z]] * pv[a:z, None].astype(np.float32), begin[g : g + step] - a)
        out[lo : lo + len(k)] = k if white is None else k @ white
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, begin: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton's method, some thousand rows at a time. begin: weights and bias to begin with."""
    w = np.zeros(z.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    active = np.ones(len(z), bool) if begin is None else y * (z @ begin[0].astype(z.dtype) + begin[1]) < 1
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(len(w))
        for lo in range(0, len(z), 8192):
            on = lo + np.flatnonzero(active[lo : lo + 8192])
            x = np.hstack([z[on].astype(float), np.ones((len(on), 1))])
            a = x * (2 * c * weight[on])[:, None]
            left += a.T @ x
            right += a.T @ y[on]
        w = np.linalg.solve(left, right)
        now = y * (z @ w[:-1].astype(z.dtype) + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def train(texts: list[str], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = ROUNDS, decay: float = DECAY, c: float = 100.0, seed: int = SEED) -> Model:
    """A model from labelled texts, with every distinct span of the clean ones as background. Without both kinds of label nothing is toxic."""
    y = np.array(toxic, bool)
    none = Model(np.zeros(LETTERS**4, np.float32), -1.0, np.inf, decay)
    if not y.any() or y.all():
        return none
    keep = _originals(pa.array(texts, pa.large_string()))
    texts, y = [texts[i] for i in keep], y[keep]
    if not y.any() or y.all():
        return none
    s = read(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(seed)
    n_pos, n_neg = int(y.sum()), int((~y).sum())
    # First guess: how much oftener than chance a span's runs of four letters stand in toxic documents (Dunning's G, their mean).
    left = np.repeat(s.first[1:], np.diff(s.first)) - np.arange(len(s.code))
    at = np.flatnonzero(left > 3)
    gram = ((s.code[at] * LETTERS + s.code[at + 1]) * LETTERS + s.code[at + 2]) * LETTERS + s.code[at + 3]
    pair = np.unique(s.of.astype(np.int64) * len(y) + s.doc)  # span, document
    per_span = np.bincount(np.searchsorted(s.first, at, "right") - 1, minlength=len(s.first) - 1)
    begin = np.cumsum(per_span) - per_span
    span, doc = pair // len(y), pair % len(y)
    by_doc = np.lexsort((span, doc))
    span, doc = span[by_doc], doc[by_doc]
    df = [np.zeros(LETTERS**4, np.int64), np.zeros(LETTERS**4, np.int64)]
    for lo in range(0, len(y), 100):
        part = slice(*np.searchsorted(doc, [lo, lo + 100]))
        n = per_span[span[part]]
        seen = np.unique(np.repeat(doc[part], n) * LETTERS**4 + gram[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[span[part]], n)])
        for t in (False, True):
            df[t] += np.bincount(seen[y[seen // LETTERS**4] == t] % LETTERS**4, minlength=LETTERS**4)
    both = df[0] + df[1]
    expected = [np.maximum(both * n_neg / len(y), 1e-9), np.maximum(both * n_pos / len(y), 1e-9)]
    g = sum(d * np.log(np.maximum(d, 1e-9) / e) for d, e in zip(df, expected)) * np.where(df[1] * n_neg > RATIO * (df[0] + 0.5) * n_pos, 1, -1)
    guess = np.where(per_span > 0, np.bincount(np.searchsorted(s.first, at, "right") - 1, g[gram], len(per_span)) / np.maximum(per_span, 1), -np.inf)

    def winners(score: np.ndarray, of: bool) -> np.ndarray:
        """The highest span of each document of a kind."""
        x = score[span]
        order = np.lexsort((span, -x, doc))
        top = order[np.concatenate([[True], np.diff(doc[order]) > 0])]
        return span[top[y[doc[top]] == of]]

    clean = np.unique(span[~y[doc]])
    hard = np.zeros(0, np.int64)
    positive = winners(guess, True)
    # Spans that clean documents hold nearly as often teach nothing.
    in_toxic, in_all = np.bincount(span[y[doc]], minlength=len(guess)), np.bincount(span, minlength=len(guess))
    often = in_toxic * n_neg > RATIO * (in_all - in_toxic) * n_pos
    evidence = np.where(often, in_toxic * np.log(np.maximum(in_toxic, 1e-9) * len(y) / (np.maximum(in_all, 1) * n_pos)), 0)
    significant = np.flatnonzero(evidence >= SIGNIFICANT)
    # Some labels are wrong: a document whose highest span has no evidence elsewhere, by itself or by the last model, isn't learnt by heart.
    likely = evidence >= SIGNIFICANT / 2
    model = none
    for _ in range(rounds):
        good = positive[often[positive] & likely[positive]]
        positive = good if len(good) else positive
        distinct, times = np.unique(np.concatenate([positive, significant]), return_counts=True)
        ok = often[distinct]
        distinct, times = (distinct[ok], times[ok]) if ok.any() else (distinct, times)
        negative = np.setdiff1d(clean, distinct)
        plain = _take(s.code, s.first, distinct)
        variants = [(*plain, np.arange(len(distinct))), _inserted(*plain, 1, INSERTED, rng), _inserted(*plain, 2, INSERTED, rng)]
        share = np.sqrt(times) / np.sqrt(times).sum()
        shares = [share[of] / np.bincount(of, minlength=len(share))[of] / len(variants) for _, _, of in variants]
        # Landmarks: insults, insults with a letter put in, the clean side's highest spans, and any others of the clean side, a quarter each where there are enough.
        part = landmarks // 4
        changed = _take(*variants[1][:2], np.sort(rng.permutation(len(variants[1][2]))[:part]))
        marks = np.union1d(distinct[np.argsort(-times, kind="stable")][:part], rng.permutation(np.unique(hard))[:part])
        marks = np.union1d(marks, rng.permutation(negative)[: max(0, landmarks - len(marks) - len(changed[1]) + 1)])
        mark = _on_end(_take(s.code, s.first, marks), changed)
        features = _features(mark, decay)
        own, vectors = np.linalg.eigh(_kernel(mark, features, decay))
        ok = own > max(1e-6 * own.max(), 1e-12)
        white = vectors[:, ok] / np.sqrt(own[ok])
        z_pos = np.concatenate([_kernel(v[:2], features, decay, white) for v in variants])
        # All clean spans count. Those beyond the margin don't pull at an SVM with hinge loss, so it is solved with those within it, until no other one is.
        as_highest = np.bincount(hard, minlength=len(guess))
        used = np.union1d(rng.permutation(negative)[:START], np.intersect1d(hard, negative))
        z_neg = np.zeros((0, white.shape[1]), np.float32)
        rows_of, added, solved = np.zeros(0, np.int64), used, None
        while len(added):
            z_neg = np.concatenate([z_neg, _kernel(_take(s.code, s.first, added), features, decay, white)])
            rows_of = np.concatenate([rows_of, added])
            label = np.concatenate([np.ones(len(z_pos)), -np.ones(len(z_neg))])
            # Half the weight of the clean side lies on all its spans alike, half on those that were their documents' highest, whether or not the others are there.
            weight = np.concatenate([*shares, (1 - HARD) / max(1, len(negative)) + HARD * as_highest[rows_of] / max(1, as_highest.sum())]) * WEIGHT
            w, bias = solved = _svm(np.concatenate([z_pos, z_neg]), label, weight, c, solved)
            table = np.zeros(LETTERS**4, np.float32)
            table[features[0]] = features[1] @ (white @ w).astype(np.float32)
            model = Model(table, bias, 0.0, decay)
            score = model.score(s.code, s.first)
            added = np.setdiff1d(negative[score[negative] > -1 + SLACK], rows_of)
        likely = (evidence >= SIGNIFICANT / 2) | (score > 0)
        positive, hard = winners(score, True), np.concatenate([hard, winners(score, False)])
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc, score[span])
    changed = [model.score(*v[:2]) for v in (_inserted(*_take(s.code, s.first, distinct), n, 1, rng) for n in (1, 2))]
    model.threshold = _threshold(best, y, np.concatenate(changed))
    return model


def _originals(texts: pa.Array) -> np.ndarray:
    """Texts without those that share a good part of their words with an earlier one: copies of a document are one piece of evidence."""
    w = words(texts)
    sig, has = signatures(w.hashes, w.first, 32, 1)
    copy = np.zeros(len(has), bool)
    for lo in range(0, len(has), 64):
        same = (sig[lo : lo + 64, None, :] == sig[None, : lo + 64, :]).sum(2) >= 14
        copy[lo : lo + 64] = (same & (np.arange(same.shape[1])[None, :] < np.arange(lo, lo + len(same))[:, None])).any(1)
    return has[~copy]


def _threshold(score: np.ndarray, y: np.ndarray, changed: np.ndarray) -> float:
    """The cut of the highest F1 on the training documents and on insults with letters put in (`changed`), which count for INSERTED_COUNT of the toxic documents in all.

    Among equally good ones the widest gap's, nearer to its clean end, as insults vary more.
    """
    cuts = np.unique(np.concatenate([score[np.isfinite(score)], changed]))
    if not len(cuts):
        return np.inf
    edges = np.concatenate([[cuts[0] - 1], cuts[:-1] + 0.3 * np.diff(cuts)])
    above = lambda x: len(x) - np.searchsorted(np.sort(x), edges, "right")
    n = int(y.sum())
    tp, fp = above(score[y]) + above(changed) * (INSERTED_COUNT * n / max(1, len(changed))), above(score[~y])
    f1 = 2 * tp / (tp + fp + n * (1 + INSERTED_COUNT * (len(changed) > 0)))
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    gap = np.concatenate([[2.0], np.diff(cuts)])
    return float(edges[top[np.argmax(gap[top])]])


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, seed: int = SEED, **options) -> Model:
    """train on at most `limit` labelled documents, half of them toxic at most, drawn by a hash of the identifier.

    One task gathers them and trains; only the model, whose size is fixed, reaches the driver.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id"))
    drawn = [known.where(x).orderBy("__h", "doc_id").limit(limit // 2) for x in ("toxic", "not toxic")]
    drawn = F.broadcast(drawn[0].union(drawn[1]).select("doc_id", "toxic"))  # `limit` rows at most
    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(drawn, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist()})
        model = train([r[1] for r in found], [r[2] for r in found], seed=seed, **options)
        yield pa.RecordBatch.from_arrays([pa.array([pack(model.weights)], pa.binary()), *(pa.array([x], pa.float64()) for x in (model.bias, model.threshold, model.decay))], names=["weights", "bias", "threshold", "decay"])

    made = rows.repartition(1).mapInArrow(run, "weights binary, bias double, threshold double, decay double").collect()
    return Model(unpack(bytes(made[0]["weights"]), np.float32), *made[0][1:]) if made else train([], [])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of the documents with a word, null identifiers too."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # LETTERS**4 weights, 10 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = document_scores(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double").where("score > double('-infinity')")


def toxic_documents(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, score) of the documents found toxic; score: how far the highest span lies above the threshold.

    Null and empty texts and texts without a word are never toxic. Labels that are null are ignored; a document labelled
    both ways is toxic; labels of unknown documents are ignored, and without labels of both kinds nothing is toxic. Each row is judged by its own text, and listed each time.
    Other columns are ignored; an empty table gives no row.
    """
    model = fit(docs, labels, limit)
    return scored(docs, model).where(F.col("score") > model.threshold).withColumn("score", F.round(F.col("score") - F.lit(model.threshold), 6))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't toxic, unchanged and in one pass; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(document_scores(b.column(at).cast(pa.large_string()), shared.value) <= shared.value.threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names=docs_columns)

    # Arrow's batches take columns by plain names alone, whatever docs calls them.
    docs_columns = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(docs_columns))]).mapInArrow(run, docs.schema)
