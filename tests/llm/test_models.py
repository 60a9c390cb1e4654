import collections
import math

import numpy as np
from pyspark.sql import functions as F

from brieflane.llm import langid, queries, toxicity
from brieflane.llm.common import fold
from tests.llm.helpers import DOCS, edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in queries.op5_language_id(spark, SF).collect()]
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_back_off_to_shorter_grams():
    rows = [("aa", 0, "tionen", 5), ("bb", 0, "schule", 5)]
    for lang, word in (("aa", "tionen"), ("bb", "schule")):
        for n in range(1, 5):
            rows += [(lang, n, g, 5) for g in set(langid.grams(word, n))]
    s = langid.Scorer(langid.Model(rows))
    assert s.predict(["stationen", "aschu", "t", "schule tionen schule", None, "12 !"])[:4] == [
        (lang, p) for lang, (_, p) in zip(["aa", "bb", "aa", "bb"], s.predict(["stationen", "aschu", "t", "schule tionen schule"]))]
    assert [x[0] for x in s.predict([None, "", "12 !", " "])] == ["und"] * 4


def test_language_edge_rows(spark):
    docs = edge_docs(spark)
    model = langid.fit(docs, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= got
    assert langid.identify(docs, model).count() == 14
    assert {r.doc_id for r in langid.keep_identified(docs, model).collect()}.isdisjoint({1, 2, 3, 7})
    none = langid.fit(empty_docs(spark), F.lit(True))
    assert langid.identify(empty_docs(spark), none).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def brute_language(learn, texts):
    """learn: (lang, text) -> (language, score) of every text, from the rule alone."""
    def words(t):
        out, w = [], ""
        for c in (t or "").lower() + " ":
            if c.isalpha():
                w += c
            elif w:
                out.append(w)
                w = ""
        return out

    def parts(w, n):
        return [w] if n == 0 else [f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n)]

    langs = sorted({lang for lang, _ in learn})
    n_of = {lang: [collections.Counter(p for x, t in learn if x == lang for w in words(t) for p in parts(w, k)) for k in range(5)] for lang in langs}
    items = [set().union(*(n_of[lang][k] for lang in langs)) for k in range(5)]
    log = {lang: [{p: math.log(n_of[lang][k][p] + 0.5) - math.log(max(n_of[lang][k].total(), 1) + 0.5 * len(items[k])) for p in items[k]}
                  for k in range(5)] for lang in langs}
    out = []
    for t in texts:
        total = dict.fromkeys(langs, 0.0)
        for w in words(t):
            for k in (0, 4, 3, 2, 1):
                known = [p for p in parts(w, k) if p in items[k]]
                if known:
                    for lang in langs:
                        total[lang] += sum(log[lang][k][p] for p in known) / len(known)
                    break
        best = min(langs, key=lambda x: (-total[x], x))
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)) if words(t) else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    texts = ["the house", "stationen", "½ ² Ⅷ ①", "x", "дом", "the дом house", "A1b_c", None, "", "über straße", "ΣΑΣ the", "x²y", "maisons vertes"]
    learn = [("en", "the house is on the hill"), ("en", "a house a hill"), ("de", "das haus ist auf dem berg, über der straße"),
             ("fr", "la maison est sur la colline verte")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(learn)], DOCS)
    model = langid.fit(docs, F.lit(True))
    asked = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, model).collect()}
    for i, (lang, score) in enumerate(brute_language(learn, texts)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, texts[i]


def test_held_out_languages_move_no_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = fold("doc_id", 4) != 2
    other = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise(F.lit("xx"))).withColumn("source", F.lit("none"))
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, langid.fit(d, learn)).collect()} for d in (docs, other))
    assert one == two


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "wort" if i % 2 else "mot", "de" if i % 2 else "fr", "s", 4) for i in range(4000)], DOCS)
    model = langid.fit(docs, F.lit(True), sample_docs=200)
    assert model.langs == ["de", "fr"]
    n = docs.where(langid.share("doc_id", 2000, 200)).count()
    assert 250 < n < 560


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4_toxicity(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in label]
    hit = sum(r.predicted and label[r.doc_id] for r in held)
    assert hit / sum(label[r.doc_id] for r in held) > 0.6
    assert hit / sum(r.predicted for r in held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def sentences(swap_weight):
    """A corpus in which toxic sentences often name one group: the plain fit learns the name."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    fill = [f"filler{w}" for w in "abcdefghijklmnop"]
    for i in range(600):
        toxic = i % 3 == 0
        words = list(rng.choice(fill, 6))
        if toxic:
            words += [str(rng.choice(["vile", "horrid"]))] if rng.random() < 0.8 else []
        if rng.random() < (0.7 if toxic else 0.05):
            words.append("muslims")
        texts.append(set(words))
        y.append(float(toxic))
    names = sorted({f for t in texts for f in toxicity.features(t)} | toxicity.features({t for ts in toxicity.IDENTITY for t in ts}))
    index = {f: i for i, f in enumerate(names)}
    vectors = [np.array(sorted(index[f] for f in toxicity.features(t)), "<i4") for t in texts]
    w, b = toxicity.fit_weights(vectors, np.array(y), len(index), toxicity.swap_rows(index, swaps_of(texts)), swap_weight=swap_weight)
    return toxicity.Model({f: float(w[i]) for f, i in index.items()}, b)


def swaps_of(texts):
    found = collections.Counter()
    for t in texts:
        found.update((" ".join(sorted(a)), " ".join(sorted(b))) for a, b in toxicity.swaps(" ".join(t)))
    return found


def test_counterfactuals_take_the_weight_off_group_names():
    plain, fair = sentences(0.0), sentences(50.0)
    gap = lambda m: m.score("the muslims fillera") - m.score("the christians fillera")
    assert gap(plain) > 0.2 and abs(gap(fair)) < 0.1
    assert fair.score("vile horrid christians") > 0.6 > 0.4 > fair.score("muslims fillera fillerb")


def test_toxicity_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(8, 0, 1), (8, 0, 0), (9, 1, None), (None, 1, 1), (12, 0, 0), (99, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels, fold("doc_id", 3) >= 0)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == 14 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(empty_docs(spark), model).collect() == []


def test_runs_of_letters():
    from brieflane.llm.common import letter_runs
    for text in ("", "a b", "x²y ½", "Ⅷ", "日本①語", "a_b1c", "ab¼cd", "é́x", "٣ab"):
        want, w = [], ""
        for c in text + " ":
            if c.isalpha():
                w += c
            elif w:
                want.append(w)
                w = ""
        assert letter_runs(text) == want, text
