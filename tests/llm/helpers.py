"""Brute-force versions and small tables for the tests of this folder."""

import collections
import os
import re
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "scripts"))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Lorem ipsum dolor sit amet " * 40_000

#: nulls in any column, empty and very long texts, ties and repeated rows
EDGE_ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "the words of no id here", "en", "a", 23),
    (4, "the words of no id here", None, "b", 23), (5, "the words of no id here", "en", "b", None),
    (5, "the words of no id here", "en", "b", None), (6, LONG, "en", "a", len(LONG)), (7, "123 456 !!!", "de", "b", 11),
    (8, "A\nB\nC\nD\nE", "en", "a", 9), (9, "x\nB\nC\nD\ny", "en", "a", 9), (10, "é" * 50_000, "fr", "a", 50_000),
    (11, "<|endoftext|> a <|startoftext|>", "en", "a", 31), (12, "日本語 Ελλάς ΣΑΣ 👩‍👩‍👧 İ", "en", "a", 20),
]


def edge_docs(spark, extra=True):
    df = spark.createDataFrame(EDGE_ROWS, DOCS)
    if extra:  # columns that the operators use themselves
        for c in ("id", "n_tokens", "score", "row", "later", "node", "th", "words", "slot", "rank", "kind", "src", "lines"):
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, k):
    w = WORDS.findall((text or "").encode().translate(LOW))
    if len(w) >= k:
        return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    return frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    """rows: (id, text) -> sorted (id, size, smallest id of the component)."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def brute_line_dedup(rows):
    """rows: (id, text) with distinct ids -> {id: (text, n_lines, n_removed)}."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for j in range(len(at) - 2):
            w = tuple(lines[i].strip(" ") for i in at[j:j + 3])
            if w in seen:
                gone.update(at[j:j + 3])
            seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(at), len(gone))
    return out
