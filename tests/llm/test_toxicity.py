import math

import numpy as np
from pyspark.sql import functions as F

from brieflane.llm import queries, toxicity
from brieflane.llm.common import fold

SF = "/root/testdata/sf0.01"


def words(text):
    out, w = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum() and not c.isdecimal():
            w += c
        elif w:
            out.add(w)
            w = ""
    return out


def test_scores_equal_the_rule(spark):
    """Bias and the weight of every word and word beginning of five and seven letters, through the logistic function."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op4_toxicity(spark, SF).collect():
        own = words(texts[r.doc_id])
        held = own | {w[:n] + "*" for w in own for n in (5, 7) if len(w) > n}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in held)
        assert abs(r.score - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9
        assert r.predicted == (r.score >= 0.7)


def test_held_out_labels_move_no_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = fold("doc_id", 3) != 1
    other = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    renamed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("none")})
    one = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, labels, learn)).collect()}
    two = {r.doc_id: r.score for r in toxicity.toxicity(renamed, toxicity.fit(renamed, other, learn)).collect()}
    assert one == two


def test_swaps_of_a_sentence():
    found = toxicity.swaps("the deaf man and the blind")
    names = toxicity.IDENTITY[6]
    assert len(found) == 2 * (len(names) - 1)
    assert (frozenset({"blind"}), frozenset({"young"})) in found
    assert (frozenset({"deaf"}), frozenset()) in found  # the other name stands in the sentence already
    assert (frozenset({"deaf"}), frozenset({"disabled", "disab*", "disable*"})) in found
    assert toxicity.swaps("nobody is named") == []
    # a word beginning that another word of the sentence holds too is not taken
    assert all("christ" not in f for a, _ in toxicity.swaps("christian christians") for f in a if f.endswith("*"))


def test_the_penalty_is_the_change_of_swapped_sentences():
    """What the loss weighs is the squared change of every swapped sentence of the texts, and a fit with it has little left."""
    texts = [{"vile", "muslims"}, {"kind", "jews"}, {"vile"}, {"kind", "muslims"}]
    y = np.array([1.0, 0.0, 1.0, 0.0])
    counted = {}
    for t in texts:
        for a, b in toxicity.swaps(" ".join(sorted(t))):
            key = (" ".join(sorted(a)), " ".join(sorted(b)))
            counted[key] = counted.get(key, 0) + 1
    names = sorted({f for t in texts for f in toxicity.features(t)} | toxicity.features(set(toxicity.PLACE)))
    index = {f: i for i, f in enumerate(names)}
    vectors = [np.array(sorted(index[f] for f in toxicity.features(t)), "<i4") for t in texts]
    fair, _ = toxicity.fit_weights(vectors, y, len(index), toxicity.swap_rows(index, counted), swap_weight=100.0)
    plain, _ = toxicity.fit_weights(vectors, y, len(index), [], swap_weight=0.0)

    def change(w):
        out = 0.0
        for t in texts:
            for a, b in toxicity.swaps(" ".join(sorted(t))):
                out += (sum(w[index[f]] for f in a) - sum(w[index[f]] for f in b)) ** 2
        return out

    assert change(fair) < 0.05 * change(plain)
    rows = toxicity.swap_rows(index, counted)
    assert math.isclose(sum(c for c, _, _ in rows), 1.0)
    w = np.random.default_rng(0).normal(size=len(index))
    assert math.isclose(sum(c * (w[a].sum() - w[b].sum()) ** 2 for c, a, b in rows), change(w) / sum(counted.values()))
