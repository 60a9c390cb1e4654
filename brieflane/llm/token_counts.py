"""Token counts without ids (operator 1).

Every slice of documents is turned into pre-token frequencies per document; the pieces of a
pre-token are counted once for each distinct pre-token of the slice (and remembered for the
next slices of the task), and the two are joined and summed. The join stays where the
documents are: a corpus-wide one would shuffle every (document, pre-token) pair, which is
more bytes than the texts themselves, to save a few seconds of counting.

Rules: a null or empty text has 0 tokens; the special strings of the tokenizer inside a text
are one token each, as its library has it; every input row gives one output row (repeated
rows and null ids too); other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import map_texts

#: Pre-tokens whose piece counts a task remembers; the memory is emptied beyond it.
REMEMBERED = 250_000


class PieceCounter:
    """Counts of a ``tokenizers`` BPE file with NFC, Replace and Lowercase normalizers and a
    Split pre-tokenizer that keeps the matches of its pattern."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel":
            raise ValueError(f"unsupported pre-tokenizer in {path}")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.steps = []
        for n in spec["normalizer"]["normalizers"]:
            if n["type"] == "NFC":
                self.steps.append(lambda s: unicodedata.normalize("NFC", s))
            elif n["type"] == "Lowercase":  # character by character, so no final sigma
                self.steps.append(lambda s: s.replace("Σ", "σ").lower())
            elif n["type"] == "Replace":
                space = regex.compile(n["pattern"]["Regex"])
                # white space between pre-tokens only separates them; which one does not matter
                if n["content"] != " " or n["pattern"]["Regex"] != r"\s+":
                    self.steps.append(lambda s, p=space, c=n["content"]: p.sub(c, s))
            else:
                raise ValueError(f"unsupported normalizer {n['type']} in {path}")
        # Pieces of one pre-token: the model alone, without normalizer and added tokens.
        self.model = Tokenizer(whole.model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        special = [a["content"] for a in spec["added_tokens"] if a["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies of a text and the special strings in it."""
        parts, special = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            special = len(parts) - 1
        out: Counter = Counter()
        for part in parts:
            for step in self.steps:
                part = step(part)
            out.update(self.words.findall(part))
        return out, special

    def counts(self, texts: list[str]) -> np.ndarray:
        freqs = [self.frequencies(t) for t in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        new = list(set().union(*(f.keys() for f, _ in freqs)).difference(self.pieces)) if freqs else []
        for at in range(0, len(new), 10_000):
            some = new[at:at + 10_000]
            self.pieces.update(zip(some, map(len, self.model.encode_batch(some, add_special_tokens=False))))
        get = self.pieces.__getitem__
        return np.array([special + sum(n * p for n, p in zip(f.values(), map(get, f))) for f, special in freqs], np.int64)


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One for each worker process, which keeps its counts from task to task."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        counter = piece_counter(tokenizer_path)

        def work(part):
            texts = [t or "" for t in part.column(1).to_pylist()]
            return [part.column(0), [len(t.encode()) for t in texts], counter.counts(texts)]
        return work

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(slim, f"id {kind}, n_bytes bigint, n_tokens bigint", make)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
