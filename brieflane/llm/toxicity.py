"""Toxicity score with counterfactual regularisation (operator 4).

A logistic model over words and word beginnings (presence in the text). Besides the fit to the
labels it is penalised for counterfactuals: in every labelled sentence that names a group, the
name is swapped for each other one of the same list, and the squared change of the sentence's
log-odds is part of the loss. So a group's name alone cannot raise a score, and neutral mentions
are no false positives.

The model is fitted on a bounded sample of about ``sample_docs`` labelled documents chosen by
a hash of the id (all, if there are fewer). Its features are those that at least ``LEAST_DOCS`` of
them hold and whose likelihood ratio is at least ``LEAST_STRENGTH``, however many these are, and
the names of groups. Scoring covers whole texts of all documents.

Rules: null and empty texts get the score of no feature at all; several labels of one id count
as the highest; without labelled rows every score is 0; every input row gives one output row;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import map_texts, saved, share

SAMPLE_DOCS = 20_000
LEAST_DOCS, LEAST_STRENGTH = 4, 3.0
PREFIXES = (5, 7)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Names of groups, swapped within their list.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "african", "latino", "hispanic", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "ateos"),
)


def features(words: set[str]) -> set[str]:
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


PLACE = {t: at for at, terms in enumerate(IDENTITY) for t in terms}


def swaps(sentence: str) -> list[tuple[frozenset, frozenset]]:
    """What every swap of a group's name in a sentence takes from its features, and what it adds."""
    words = set(WORD.findall(sentence))
    out = []
    for name in sorted(words & PLACE.keys()):
        before = features(words)
        for other in IDENTITY[PLACE[name]]:
            if other != name:
                after = features(words - {name} | {other})
                out.append((frozenset(before - after), frozenset(after - before)))
    return out


def _presence(df: DataFrame) -> DataFrame:
    """(feature, other, kind, n): kind 0 and 1 count documents of that label with the feature, kind 2
    swaps in their sentences that take ``feature`` and add ``other`` (each several, joined by spaces)."""
    def make():
        def work(part):
            n: Counter = Counter()
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                low = (text or "").lower()
                words = set(WORD.findall(low))
                n.update((f, "", label) for f in features(words))
                n[" documents", "", label] += 1
                if not words.isdisjoint(PLACE):
                    for s in SENTENCE.split(low):
                        n.update((" ".join(sorted(a)), " ".join(sorted(b)), 2) for a, b in swaps(s))
            return [[k[at] for k in n] for at in range(3)] + [list(n.values())]
        return work
    return map_texts(df, "feature string, other string, kind int, n bigint", make)


def _vectors(df: DataFrame, index: dict[str, int]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(index)

    def make():
        at = shared.value

        def work(part):
            rows = []
            for text in part.column(1).to_pylist():
                f = features(set(WORD.findall((text or "").lower())))
                rows.append(np.array(sorted(at[x] for x in f if x in at), "<i4").tobytes())
            return [part.column(0), rows]
        return work
    return map_texts(df, "label int, vector binary", make)


def swap_rows(index: dict[str, int], counted: dict[tuple[str, str], int]) -> list[tuple[float, list[int], list[int]]]:
    """The swaps of the counterfactual loss: (share of all swaps, features taken, features added);
    ``counted`` by (taken, added), each joined by spaces."""
    whole = sum(counted.values()) or 1
    at = lambda names: [index[f] for f in names.split() if f in index]
    return [(n / whole, at(a), at(b)) for (a, b), n in sorted(counted.items()) if at(a) or at(b)]


def fit_weights(vectors: list[np.ndarray], labels: np.ndarray, size: int, swaps: list, ridge: float = 2e-4,
                swap_weight: float = 5.0, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic loss + ridge + counterfactual loss by Adam steps over all rows."""
    n = len(labels)
    lens = np.array([len(v) for v in vectors])
    idx = np.concatenate([*vectors, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(n), lens)
    change = np.zeros((len(swaps), size))
    for k, (c, a, b) in enumerate(swaps):
        np.add.at(change[k], a, -np.sqrt(c))
        np.add.at(change[k], b, np.sqrt(c))
    used = np.flatnonzero(np.abs(change).sum(0))
    change = change[:, used]
    rate = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    b, mb, vb = np.log(rate / (1 - rate)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[idx], n) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        g = np.bincount(idx, r[row], size) + ridge * w
        if change.size:
            g[used] += swap_weight * change.T @ (change @ w[used])
        gb = r.sum()
        lr = 0.1 * min(1.0, 2.0 * (1 - t / (rounds + 1)))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w = w - lr * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, fitted: bool = True):
        self.weights, self.bias, self.fitted = weights, bias, fitted

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        get = self.weights.get
        z = self.bias + sum(get(f, 0.0) for f in features(set(WORD.findall((text or "").lower()))))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model from the labelled documents where ``learn`` (over ``id_col`` of both) holds."""
    marks = (labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label")))
    keep = share("id", marks.count(), sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(keep)
    # about ``sample_docs`` ids at most; the sample is read several times, so it is written once
    sample = saved(texts.join(F.broadcast(marks.where(keep)), "id").select("label", "text"))
    found = saved(_presence(sample).groupBy("feature", "other", "kind").agg(F.sum("n").alias("n")))
    counts = found.where(F.col("kind") < 2).groupBy("feature").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((0, "neg"), (1, "pos"))])
    total = counts.where(F.col("feature") == " documents").collect()
    if not total:
        return Model({}, 0.0, fitted=False)
    neg, pos = float(total[0]["neg"]), float(total[0]["pos"])
    counted = {(r["feature"], r["other"]): r["n"] for r in found.where(F.col("kind") == 2).collect()}
    # features by the signed root of their likelihood ratio
    all_n, seen = neg + pos, F.col("pos") + F.col("neg")
    expect = seen * (pos / all_n)
    strength = (F.col("pos") - expect) * F.abs(F.col("pos") - expect) / (expect + 0.5)
    chosen = (counts.where((F.col("feature") != " documents") & (seen >= LEAST_DOCS) & (F.abs(strength) >= LEAST_STRENGTH))
              .select("feature").collect())
    names = PLACE.keys()
    index = {f: i for i, f in enumerate(sorted({r[0] for r in chosen} | features(set(names))))}
    rows = _vectors(sample, index).collect()
    rows.sort(key=lambda r: (r[1], r[0]))
    y = np.array([r[0] for r in rows], np.float64)
    vectors = [np.frombuffer(r[1], "<i4") for r in rows]
    w, b = fit_weights(vectors, y, len(index), swap_rows(index, counted))
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, b)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.score

        def work(part):
            return [part.column(0), [score(t) for t in part.column(1).to_pylist()]]
        return work

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(slim, f"id {kind}, score double", make)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
