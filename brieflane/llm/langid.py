"""Language identification by words first, then shorter and shorter n-grams (operator 5).

Known words are scored by their log frequency in each language. A word that no training text
holds backs off to the longest of its character n-grams (4 down to 1, with word borders) that
are known: the mean of their log frequencies per language. A text's scores are the sums over
its words; the highest wins.

The model is fitted on a bounded sample: about ``sample_docs`` documents of each language,
chosen by a hash of the id (all, if there are fewer); its tables are therefore bounded too and
are broadcast. Scoring covers whole texts of all documents.

Rules: null texts and texts without a letter are ``und`` with score 0; rows without a language
teach nothing; if nothing can be learned, every text is ``und``; ties go to the smaller
language name; every input row gives one output row; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import chunks, letter_runs, map_texts, release, share

SAMPLE_DOCS = 1500   # documents of each language that the model is fitted on
LONGEST_GRAM = 4
LANGUAGES = 1000     # a table with more distinct languages is refused
REMEMBERED = 100_000


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def count_words(df: DataFrame) -> DataFrame:
    """(lang, kind, item, n): words (kind 0) and n-grams (kind n) of each language."""
    def make():
        release()

        def work(part):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words[lang].update(letter_runs((text or "").lower()))
            rows = []
            for lang, found in words.items():
                parts: Counter = Counter()
                for w, n in found.items():
                    parts[0, w] += n
                    for k in range(1, LONGEST_GRAM + 1):
                        for g in grams(w, k):
                            parts[k, g] += n
                rows += [(lang, k, item, n) for (k, item), n in parts.items()]
            return [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
        return work
    out = map_texts(df, "lang string, kind int, item string, n bigint", make)
    return out.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


class Model:
    """Per-language log frequencies, one row of ``table`` for each word or n-gram."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts: dict[tuple[int, str], np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs), np.float64))
        for lang, kind, item, n in rows:
            counts[kind, item][at[lang]] += n
        self.index: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        table, seen = [], []
        for kind in range(LONGEST_GRAM + 1):
            items = sorted(item for k, item in counts if k == kind)
            if not items:
                continue
            c = np.array([counts[kind, i] for i in items])
            # smoothing as of an item seen half a time, the same for all languages
            table.append(np.log(c + 0.5) - np.log(np.maximum(c.sum(0), 1.0) + 0.5 * len(items)))
            seen.append(c > 0)
            start = sum(map(len, table[:-1]))
            self.index[kind] = {item: start + i for i, item in enumerate(items)}
        self.table = np.concatenate(table).astype(np.float32) if table else np.zeros((0, len(self.langs)), np.float32)
        self.seen = np.concatenate(seen) if seen else np.zeros((0, len(self.langs)), bool)


    def known_to(self) -> list[int]:
        """For each row of the table, the languages that hold it, as bits."""
        if not hasattr(self, "bits"):
            self.bits = [0] * len(self.seen)
            for at in range(0, len(self.langs), 62):
                some = self.seen[:, at:at + 62]
                part = (some @ (1 << np.arange(some.shape[1], dtype=np.int64))).tolist()
                self.bits = part if not at else [b | p << at for b, p in zip(self.bits, part)]
        return self.bits


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}  # words met so far
        self.used = len(self.m.table)
        self.table = np.vstack([self.m.table, np.zeros((1 << 14, len(self.m.langs)), np.float32)])

    def _unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST_GRAM, 0, -1):
            index = self.m.index[n]
            at = [index[g] for g in grams(word, n) if g in index]
            if at:
                return self.m.table[at].mean(0)
        return np.zeros(len(self.m.langs), np.float32)

    def _learn(self, words: set[str]) -> None:
        if self.used > len(self.m.table) + REMEMBERED:
            self.reset()
        known = self.m.index[0].get
        for w in words.difference(self.rows):
            at = known(w)
            if at is None:
                if self.used == len(self.table):
                    self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.table[self.used] = self._unseen(w)
                at, self.used = self.used, self.used + 1
            self.rows[w] = at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [letter_runs(t.lower()) if t else [] for t in texts]
        if not self.m.langs:
            return [("und", 0.0)] * len(texts)
        self._learn(set().union(*found) if found else set())
        get, out = self.rows.__getitem__, []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.m.langs[best], 1.0 / float(np.exp(np.minimum(total - total[best], 0.0)).sum())))
        return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model from the rows of ``docs`` where ``learn`` holds and the language is known."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang"), learn.alias("learn"))
    own = own.where(F.col("learn") & F.col("lang").isNotNull())
    sizes = own.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model([])
    taken = F.lit(False)
    for lang, n in sizes:
        taken = taken | ((F.col("lang") == lang) & share("id", n, sample_docs))
    rows = count_words(own.where(taken).select("lang", "text"))
    return Model([tuple(r) for r in rows.toLocalIterator()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        release()
        scorer = Scorer(shared.value)

        def work(part):
            found = scorer.predict(part.column(1).to_pylist())
            return [part.column(0), [f[0] for f in found], [f[1] for f in found]]
        return work

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(slim, f"id {kind}, lang_pred string, score double", make).withColumnRenamed("id", id_col)


class Fit:
    """How well a text fits a language: the mean over its words of how far the back-off goes until the
    word is known to that language. A known word counts 1, one that backs off to n-grams n / 5, one of
    which not a letter is known 0. It does not grow with the length of the text, nor with that of what
    a language was learned from.

    Languages are bits of a number here: a word's languages at each step of the back-off are the
    union of its n-grams' ones, and words of one such pattern share a row of ``levels``."""

    def __init__(self, model: Model):
        self.m = model
        self.every = (1 << len(model.langs)) - 1
        self.patterns: dict[tuple[int, ...], int] = {}
        self.levels = np.zeros((64, len(model.langs)), np.float32)
        self.rows: dict[str, int] = {}

    def _pattern(self, word: str) -> tuple[int, ...]:
        """Languages that know the word, and those of the rest that know one of its n-grams, longest first."""
        known = self.m.known_to()
        at = self.m.index[0].get(word)
        have = known[at] if at is not None else 0
        out = [have]
        for n in range(LONGEST_GRAM, 0, -1):
            if have == self.every:
                break
            # borders alone say nothing: every language has them
            w, get, found = f"<{word}>" if n > 1 else word, self.m.index[n].get, 0
            for i in range(len(w) - n + 1):
                at = get(w[i:i + n])
                if at is not None:
                    found |= known[at]
                    if found | have == self.every:
                        break
            out.append(found & ~have)
            have |= found
        return tuple(out)

    def _row(self, pattern: tuple[int, ...]) -> int:
        at = self.patterns.get(pattern)
        if at is None:
            at = self.patterns[pattern] = len(self.patterns)
            if at == len(self.levels):
                self.levels = np.vstack([self.levels, np.zeros_like(self.levels)])
            for step, langs in enumerate(pattern):
                level = 1.0 if step == 0 else (LONGEST_GRAM + 1 - step) / (LONGEST_GRAM + 1)
                for k in range(len(self.m.langs)):
                    if langs >> k & 1:
                        self.levels[at, k] = level
        return at

    def of(self, texts: list[str | None]) -> list[float]:
        """Fit of every text to the language that it fits best; 0 without a letter, and 1 for the others
        if there is no language."""
        words = [letter_runs(t.lower()) if t else [] for t in texts]
        if not self.m.langs:
            return [float(bool(w)) for w in words]
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        for w in set().union(*words).difference(self.rows) if words else ():
            self.rows[w] = self._row(self._pattern(w))
        get = self.rows.__getitem__
        # words of one pattern are counted together: there are few patterns
        count = [np.bincount(np.fromiter(map(get, own), np.int64, len(own)), minlength=len(self.levels)) for own in words]
        return [float((n @ self.levels).max()) / len(own) if own else 0.0 for n, own in zip(count, words)]


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, whose text has a letter and fits a language by ``least`` or more (see
    ``Fit``); all texts with a letter, if no language is known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        release()
        fit_of = Fit(shared.value)
        for batch in batches:
            for part in chunks(batch, at):
                yield part.filter(pa.array([x >= least for x in fit_of.of(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
