"""SentencePiece BPE encoding with byte spans, and decoding (operator 12).

Normalisation walks the text left to right and replaces, at each place, the longest prefix that
the model's compiled character map holds; every byte of the normalised text remembers the byte of
the original it came from. White space then becomes the visible space (with the dummy prefix, and
without extra spaces, as the model says), its alignment with it. The normalised text is cut before
each run of visible spaces, which no piece of the vocabulary crosses (checked when the model is
loaded), merged by rank within each part, and the pieces' lengths project every piece back to a
span of original bytes. Characters without a piece become byte pieces, of which the last holds the
character's span, as the library has it.

Decoding joins the pieces' bytes; a byte that is part of no UTF-8 character becomes U+FFFD.

Rules: null and empty texts have only the begin and end ids; texts are encoded whole; each input
row gives one output row; other columns of the input are not looked at. Models with user-defined or
unused pieces, with white space as a suffix or without byte fallback are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import map_texts

SPACE = "▁"
#: Parts of texts whose ids a task remembers, and the longest that it does; beyond the number it starts anew.
REMEMBERED_PARTS, REMEMBERED_LENGTH = 400_000, 64
#: Longest part that is merged by a scan over its pairs; longer ones by a heap.
SHORT_PART = 96
#: Fixed values of the model file: kinds of pieces, kind of model.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """The compiled character map: a double array over UTF-8 bytes whose values point into a
    block of replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units, self.texts, self.first = np.zeros(0, np.uint32), b"", None
        if not blob:
            return
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4)
        self.texts = blob[4 + size:]
        self.cells = self.units.tolist()
        starts = {k.decode()[0] for k in self._keys()}
        if starts:
            self.first = re.compile("[" + "".join(map(re.escape, sorted(starts))) + "]")

    def _step(self, unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _keys(self) -> Iterator[bytes]:
        every, todo = np.arange(1, 256), [(self._step(int(self.units[0])), b"")]
        while todo:
            base, key = todo.pop()
            at = base ^ every
            here = at < len(self.units)
            found = every[here][(self.units[at[here]] & 0x800000FF) == every[here]]
            for b in found.tolist():
                unit = self.cells[base ^ b]
                if unit >> 8 & 1:
                    yield key + bytes([b])
                todo.append((base ^ b ^ self._step(unit), key + bytes([b])))

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest prefix of ``data[at:]`` that the map holds (0 if none), and its replacement."""
        base, size, value = self._step(self.cells[0]), 0, 0
        for n in range(at, len(data)):
            place = base ^ data[n]
            if place >= len(self.cells) or self.cells[place] & 0x800000FF != data[n]:
                break
            unit = self.cells[place]
            base = place ^ self._step(unit)
            if unit >> 8 & 1:
                size, value = n + 1 - at, self.cells[base] & 0x7FFFFFFF
        return size, self.texts[value:self.texts.index(0, value)] if size else b""

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """The replaced text and, for each of its bytes, the byte of ``text`` where the replaced
        stretch (or the copied character) begins."""
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        origin = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)
        if self.first is None:
            return data, origin
        out, from_, done, chars, byte = [], [], 0, 0, 0
        for m in self.first.finditer(text):
            byte += len(text[chars:m.start()].encode())
            chars = m.start()
            if byte < done:
                continue
            size, new = self.longest(data, byte)
            if size:
                out += [data[done:byte], new]
                from_ += [origin[done:byte], np.full(len(new), byte)]
                done = byte + size
        return b"".join([*out, data[done:]]), np.concatenate([*from_, origin[done:]])


class PieceModel:
    """A SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        self.names, self.scores, self.kinds = [], [], []
        trainer, rules = {}, {}
        for at, value in fields(model):
            if at == 1:
                piece = dict(fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif at == 2:
                trainer = dict(fields(value))
            elif at == 3:
                rules = dict(fields(value))
        if trainer.get(3, 1) != BPE or not trainer.get(35) or trainer.get(24) or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model with byte fallback and ordinary pieces only")
        self.prefix, self.squeeze = rules.get(3, 1), rules.get(4, 1)
        self.space = SPACE if rules.get(5, 1) else " "
        self.map = CharacterMap(rules.get(2, b""))
        self.id_of = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == NORMAL}
        self.cost = {n: -self.scores[i] for n, i in self.id_of.items()}
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.byte_ids = [0] * 256
        for i, (n, k) in enumerate(zip(self.names, self.kinds)):
            if k == BYTE:
                self.byte_ids[int(n[1:-1], 16)] = i
        self.begin, self.end = (self.names.index(trainer.get(at, name).decode()) for at, name in ((46, b"<s>"), (47, b"</s>")))
        surface = trainer.get(44, " ⁇ ".encode())
        self.raw = [n.replace(SPACE, " ").encode() if k == NORMAL else surface if k == UNKNOWN else
                    bytes([int(n[1:-1], 16)]) if k == BYTE else b"" for n, k in zip(self.names, self.kinds)]
        self.sizes = np.array([len(n.encode()) if k == NORMAL else int(k == BYTE) for n, k in zip(self.names, self.kinds)])
        crossing = re.compile(f"[^{self.space}]{self.space}")
        whole = any(crossing.search(n) for n in self.id_of)
        self.parts = re.compile("(?s).+" if whole else f"{self.space}+[^{self.space}]*|[^{self.space}]+")
        self.known: dict[str, bytes] = {}

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the byte of ``text`` it begins at."""
        data, origin = self.map.apply(text)
        end = len(text.encode())
        raw = np.frombuffer(data, np.uint8)
        if self.squeeze:
            space = raw == 32
            keep = ~(space & np.concatenate([[True], space[:-1]])) if len(raw) else space
            raw, origin = raw[keep], origin[keep]
        if not len(raw):
            return "", np.array([end])
        wide = len(self.space.encode())
        origin = np.repeat(origin, np.where(raw == 32, wide, 1))
        out = raw.tobytes().decode().replace(" ", self.space)
        if self.prefix:
            out, origin = self.space + out, np.concatenate([np.repeat(origin[:1], wide), origin])
        if self.squeeze:
            kept = out.rstrip(self.space)
            if len(kept) < len(out):
                out, end = kept, int(origin[len(kept.encode())])
                origin = origin[:len(kept.encode())]
        return out, np.concatenate([origin, [end]])

    def merge(self, part: str) -> list[int]:
        """Ids of one part: the pair of neighbours with the best score is joined, the left one of
        equals, until no pair is a piece."""
        out: list[int] = []
        for t in (self._merge_short if len(part) <= SHORT_PART else self._merge_long)(part):
            i = self.id_of.get(t)
            if i is None:
                out += [self.byte_ids[x] for x in t.encode()]
            else:
                out.append(i)
        return out

    def _merge_short(self, part: str) -> list[str]:
        texts, cost, none = list(part), self.cost.get, float("inf")
        costs = [cost(a + b, none) for a, b in zip(texts, texts[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            at = costs.index(least)
            texts[at] += texts.pop(at + 1)
            del costs[at]
            if at:
                costs[at - 1] = cost(texts[at - 1] + texts[at], none)
            if at < len(costs):
                costs[at] = cost(texts[at] + texts[at + 1], none)
        return texts

    def _merge_long(self, part: str) -> list[str]:
        texts = list(part)
        before, after = list(range(-1, len(texts) - 1)), list(range(1, len(texts) + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(texts):
                pair = texts[a] + texts[b]
                cost = self.cost.get(pair)
                if cost is not None:
                    heapq.heappush(heap, (cost, a, b, len(pair)))

        for a in range(len(texts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not texts[a] or not texts[b] or len(texts[a]) + len(texts[b]) != size or after[a] != b:
                continue
            texts[a] += texts[b]
            texts[b] = ""
            after[a] = after[b]
            if after[b] < len(texts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [t for t in texts if t]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, and the original bytes at which each piece begins and ends."""
        normal, origin = self.normalize(text)
        if len(self.known) > REMEMBERED_PARTS:
            self.known.clear()
        parts, known = self.parts.findall(normal), self.known
        new = set(parts).difference(known)
        for part in new:
            ids = self.merge(part)
            known[part] = struct.pack(f"<{len(ids)}I", *ids)
        ids = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")
        for part in new:
            if len(part) > REMEMBERED_LENGTH:
                del known[part]
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        return ids, origin[at[:-1]], origin[at[1:]]

    def encode_whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`encode`, with the begin and end ids, which hold no bytes."""
        ids, starts, ends = self.encode(text)
        size = len(text.encode())
        return (np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"), np.concatenate([[0], starts, [size]]),
                np.concatenate([[0], ends, [size]]))

    def decode(self, ids: list[int]) -> str:
        out = list(map(self.raw.__getitem__, ids))
        cuts = []
        if self.controls.intersection(ids[1:-1]):  # no character's bytes lie on both sides of a control id
            cuts = [at for at, i in enumerate(ids) if i in self.controls]
        if self.prefix or self.squeeze:  # the space that the encoder added, or all leading ones
            for at, i in enumerate(ids):
                if self.kinds[i] == NORMAL and self.names[i].startswith(SPACE):
                    out[at] = out[at].lstrip(b" ") if self.squeeze else out[at][1:]
                    if self.squeeze and not out[at]:
                        continue
                    break
                if out[at]:
                    break
        return "".join(b"".join(out[a:b]).decode("utf-8", "each_byte") for a, b in zip([0, *cuts], [*cuts, len(out)]))


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One for each worker process, which keeps its memory from task to task."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     keep: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) for every row of ``docs``, and with
    ``keep`` the arrays ids, starts and ends. spans_sha256 is over the pairs (start, end) of all
    pieces as little-endian unsigned 64-bit integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model = piece_model(model_path)

        def one(text: str) -> tuple:
            ids, starts, ends = model.encode_whole(text)
            spans = np.stack([starts, ends], 1).astype("<u8").tobytes()
            decoded = model.decode(ids.tolist()).encode()
            digests = [hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), decoded, spans)]
            return (len(ids), *digests, *([ids.astype(np.int64), starts, ends] if keep else []))

        def work(part):
            rows = [one(t or "") for t in part.column(1).to_pylist()]
            return [part.column(0), *map(list, zip(*rows))]
        return work

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    schema += ", ids array<bigint>, starts array<bigint>, ends array<bigint>" * keep
    return map_texts(slim, schema, make).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ``encoded``; null ids give a null text, null entries and
    numbers that are no ids of the model are left out."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        model = piece_model(model_path)

        def text(ids: list | None) -> str | None:
            return None if ids is None else model.decode([i for i in ids if i is not None and 0 <= i < len(model.raw)])

        return lambda part: [part.column(0), [text(ids) for ids in part.column(2).to_pylist()]]

    slim = encoded.select(F.col(id_col).alias("id"), F.lit("").alias("_"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return map_texts(slim, f"id {kind}, text string", make).withColumnRenamed("id", id_col)
