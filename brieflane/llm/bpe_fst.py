"""Byte-level BPE encoding and decoding by a finite-state transducer (operator 9).

The encoding of every prefix of a pre-token ends in one token, and that token follows the
encoding of what stands before it. So a left-to-right machine can encode. A state is the set of
hypotheses under way: part of a next token (a node of the vocabulary's trie), the last finished
token before it, and the finished tokens that not all hypotheses share. Reading a byte moves every
hypothesis along the trie; where a vocabulary token ends, the pair (last token, token) must survive
the merge rules, which are applied to the pair's bytes once and remembered. The tokens that all
hypotheses then begin with are certain: they are the transition's output, after as many bytes of
lookahead as the trie is deep at most. At the end of a pre-token the state's own rest follows.

States are determinised when first reached and kept in tables (state, byte) -> state and output, so
that a slice of distinct pre-tokens runs through them in lockstep. Only pre-tokens that are a token
which the merge rules never make are looked up as a whole, as the library has it.

Decoding joins token bytes; the streaming decoder follows them with a small state machine for UTF-8
and holds back an unfinished character.

Rules: null and empty texts have no tokens (hashes of no bytes); texts are encoded whole,
each match of the pattern separately; each input row gives one output row; other columns of
the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import held, map_texts

#: Bounds of what a task remembers; beyond them the younger half is forgotten.
REMEMBERED_WORDS, REMEMBERED_STATES, REMEMBERED_PAIRS = 250_000, 130_000, 250_000
#: Bytes of text that are split into pre-tokens at a time: each pre-token is an object of its own.
SLICE_BYTES = 1 << 20
#: Longer pre-tokens run alone, not in lockstep; so many others at a time.
LOCKSTEP_BYTES, LOCKSTEP_PIECES = 48, 10_000
Hypothesis = tuple[int, int, tuple[int, ...]]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encoder of single pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], memory: float = 1.0):
        self.ranks, self.memory = ranks, memory
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.size_of[i] = len(t)
        self.child: dict[int, int] = {}   # node * 256 + byte -> node
        self.ends: list[int] = [-1]       # token that ends at a node
        for t, i in ranks.items():
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.child[key]
            self.ends[node] = i
        self.inner = bytearray(len(self.ends))  # 1 for a node that has children
        for key in self.child:
            self.inner[key >> 8] = 1
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.unmade = {t: i for t, i in ranks.items() if self.merged(t) != [t]}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[Hypothesis, ...]] = []
        self.next = np.full((1024, 32), -1, np.int32)
        self.emit = np.zeros((1024, 32), np.int32)  # output of a transition, as a number of ``outputs``
        self.column = np.full(256, -1, np.int64)    # columns of the tables, given to bytes as they come
        self.columns = 0
        self.outputs: dict[tuple[int, ...], int] = {(): 0}
        self.sizes, self.starts, self.flat = [0], [0], []
        self._state(((0, -1, ()),))

    def most_states(self) -> int:
        return int(REMEMBERED_STATES * self.memory)

    def trim(self) -> None:
        """Forgets the younger half of the states (all, if the outputs are too many): the oldest ones
        are those of frequent pre-tokens."""
        keep = self.most_states() // 2
        if len(self.outputs) > 4 * REMEMBERED_STATES:
            self.reset()
            return
        for hyps in self.states[keep:]:
            del self.ids[hyps]
        del self.states[keep:]
        self.next[keep:] = -1
        old = self.next[:keep]
        old[old >= keep] = -1

    def _output(self, tokens: tuple[int, ...]) -> int:
        at = self.outputs.get(tokens)
        if at is None:
            at = self.outputs[tokens] = len(self.sizes)
            self.starts.append(len(self.flat))
            self.sizes.append(len(tokens))
            self.flat += tokens
        return at

    def _state(self, hyps: tuple[Hypothesis, ...]) -> int:
        """The number of a state. Its last hypothesis is that a pre-token ends here: no token is under way."""
        at = self.ids.get(hyps)
        if at is None:
            at = self.ids[hyps] = len(self.states)
            self.states.append(hyps)
            if at >= len(self.next):
                more = (8192, self.next.shape[1])
                self.next = np.vstack([self.next, np.full(more, -1, np.int32)])
                self.emit = np.vstack([self.emit, np.zeros(more, np.int32)])
        return at

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """Merge rules of ranks under ``below`` applied to a short byte string."""
        parts, rank = [piece[i:i + 1] for i in range(len(piece))], self.ranks.get
        while len(parts) > 1:
            costs = [rank(a + b, below) for a, b in zip(parts, parts[1:])]
            least = min(costs)
            if least >= below:
                break
            at = costs.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The token and its outermost parts on one side, smallest first, each with the rank
        at which it becomes part of the next; empty if the rules never make the token."""
        key = (token, right)
        if key not in self.spines:
            t, out = self.bytes_of[token], []
            taken = 1 << 60
            if self.merged(t) == [t]:
                while True:
                    out.append((t, taken))
                    if len(t) == 1:
                        break
                    taken = self.ranks[t]
                    t = self.merged(t, taken)[-1 if right else 0]
            self.spines[key] = out[::-1]
        return self.spines[key]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` can come after ``last`` (-1: at the start): no merge crosses the
        border before both are complete."""
        key = (last + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            after = self.spine(token, False)
            known = bool(after)
            if known and last >= 0:
                before, i, j = self.spine(last, True), 0, 0
                while known and i < len(before) and j < len(after):
                    (a, a_ends), (b, b_ends) = before[i], after[j]
                    rank = self.ranks.get(a + b)
                    # of equal ranks the left one merges first
                    if rank is not None and rank < a_ends and rank <= b_ends:
                        known = False
                    elif a_ends <= b_ends:
                        i += 1
                    else:
                        j += 1
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _columns(self, codes: np.ndarray) -> None:
        for b in codes.tolist():
            if self.column[b] < 0:
                self.column[b] = self.columns
                self.columns += 1
        while self.columns > self.next.shape[1]:
            self.next = np.hstack([self.next, np.full_like(self.next, -1)])
            self.emit = np.hstack([self.emit, np.zeros_like(self.emit)])

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, and the tokens that are certain now."""
        if self.column[byte] < 0:
            self._columns(np.array([byte]))
        if self.next[state, self.column[byte]] < 0:
            self._new(state, byte)
        return int(self.next[state, self.column[byte]]), self._tokens(int(self.emit[state, self.column[byte]]))

    def _tokens(self, output: int) -> tuple[int, ...]:
        return tuple(self.flat[self.starts[output]:self.starts[output] + self.sizes[output]])

    def _new(self, state: int, byte: int) -> None:
        """Determinises one transition."""
        going: list[Hypothesis] = []
        done, child, ends, inner, pairs = None, self.child, self.ends, self.inner, self.pairs
        for node, prev, rest in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = ends[node]
            if token >= 0 and done is None:
                known = pairs.get((prev + 1) << 32 | token)
                if self.follows(prev, token) if known is None else known:
                    done = (0, token, (*rest, token))
            if inner[node]:
                going.append((node, prev, rest))
        if done is None:
            raise ValueError("no token of the vocabulary ends here")
        # tokens that all begin with are certain
        sure, first = len(done[2]), done[2]
        for _, _, rest in going:
            n = min(sure, len(rest))
            sure = 0
            while sure < n and rest[sure] == first[sure]:
                sure += 1
            if not sure:
                break
        going.append(done)
        at = self.column[byte]
        if sure:
            going = [(node, prev, rest[sure:]) for node, prev, rest in going]
            emitted = self._output(first[:sure])
        else:
            emitted = 0
        to = self._state(tuple(going))
        self.next[state, at] = to
        self.emit[state, at] = emitted

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token of any length, each emitted once it is certain."""
        if piece in self.unmade:
            return [self.unmade[piece]]
        stream, out = StreamEncoder(self), []
        for b in piece:
            out += stream.feed(b)
        return out + stream.end()

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """For each pre-token its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        order = []
        for i, p in enumerate(pieces):
            if p in self.unmade:
                out[i] = self.unmade[p].to_bytes(4, "little")
            elif len(p) > LOCKSTEP_BYTES:
                out[i] = np.array(self.encode(p), "<u4").tobytes()
            else:
                order.append(i)
        order.sort(key=lambda i: -len(pieces[i]))
        for at in range(0, len(order), LOCKSTEP_PIECES):
            if len(self.states) > self.most_states():
                self.trim()
            some = order[at:at + LOCKSTEP_PIECES]
            for i, ids in zip(some, self._lockstep([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _lockstep(self, pieces: list[bytes]) -> list[bytes]:
        """``pieces`` by falling length, none empty."""
        sizes = np.array([len(p) for p in pieces])
        wide = int(sizes[0])
        text = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        self._columns(np.unique(text))
        state = np.zeros(len(pieces), np.int32)
        codes = np.zeros((len(pieces), wide + 1), np.int32)  # outputs on the way, and at the end
        for j in range(wide):
            n = int(np.searchsorted(-sizes, -j, "left"))  # pieces longer than j
            now, byte = state[:n], text[:n, j]
            to = self.next[now, self.column[byte]]
            if (to < 0).any():
                for key in np.unique((now[to < 0].astype(np.int64) << 8) | byte[to < 0]).tolist():
                    self._new(key >> 8, key & 255)
                to = self.next[now, self.column[byte]]
            codes[:n, j] = self.emit[now, self.column[byte]]
            state[:n] = to
        ended, place = np.unique(state, return_inverse=True)
        codes[:, wide] = np.array([self._output(self.states[x][-1][2]) for x in ended.tolist()], np.int32)[place]
        count = np.array(self.sizes)[codes]
        every, each = count.reshape(-1), count.sum(1)
        at = np.repeat(np.array(self.starts)[codes].reshape(-1) - np.cumsum(every) + every, every) + np.arange(int(every.sum()))
        flat = np.array(self.flat, "<u4")[at].tobytes()
        ends = np.cumsum(each).tolist()
        return [flat[(e - k) * 4:e * 4] for e, k in zip(ends, each.tolist())]


class StreamEncoder:
    """Feeds bytes of one pre-token; gives every token once it is certain."""

    def __init__(self, machine: Transducer):
        self.machine, self.state, self.at = machine, 0, 0

    def feed(self, byte: int) -> list[int]:
        m = self.machine
        self.at += 1
        if len(m.states) > m.most_states():
            hyps = m.states[self.state]
            m.trim()
            self.state = m._state(hyps)
        self.state, sure = m.step(self.state, byte)
        return list(sure)

    def end(self) -> list[int]:
        return list(self.machine.states[self.state][-1][2])


class Utf8Machine:
    """Follows bytes as UTF-8: how many more a character needs, and between which two the next one
    must lie. A byte that cannot stand where it does begins anew."""

    #: First byte from, to; bytes that follow; the second one from, to.
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
             (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))
    START = {b: (n, low, high) for a, z, n, low, high in LEADS for b in range(a, z + 1)}

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.need, self.low, self.high, self.since = 0, 0, 0, 0

    def step(self, byte: int) -> None:
        if self.need and self.low <= byte <= self.high:
            self.need, self.low, self.high, self.since = self.need - 1, 0x80, 0xBF, self.since + 1
        else:
            self.need, self.low, self.high = self.START.get(byte, (0, 0, 0))
            self.since = 1
        if not self.need:
            self.since = 0

    def follow(self, data: bytes) -> int:
        """Takes ``data`` in and returns how many of the bytes so far belong to an unfinished
        character. A run of bytes that ends in ASCII leaves the machine at its start."""
        at = len(data)
        while at > max(0, len(data) - 4) and data[at - 1] >= 0x80:
            at -= 1
        if at > 0:  # what precedes the last four bytes, or an ASCII byte, decides nothing after them
            self.reset()
        for b in data[at:]:
            self.step(b)
        return self.since


class TokenBytes:
    """The bytes of all tokens in one array, from which those of many ids are gathered at once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        own = [bytes_of.get(i) for i in range(max(bytes_of) + 1)]
        self.flat = np.frombuffer(b"".join(t or b"" for t in own), np.uint8)
        self.sizes = np.array([-1 if t is None else len(t) for t in own], np.int64)  # an id without a token is an error
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - np.cumsum(sizes) + sizes
        at = np.repeat(shift, sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


class StreamDecoder:
    """Decodes ids piece by piece; an unfinished character waits for its last byte."""

    def __init__(self, tokens: TokenBytes | dict[int, bytes]):
        self.tokens = tokens if isinstance(tokens, TokenBytes) else TokenBytes(tokens)
        self.held, self.machine = b"", Utf8Machine()

    def feed(self, ids: np.ndarray | list[int]) -> str:
        new = self.tokens.join(np.asarray(ids, np.int64))
        k = self.machine.follow(new)
        data = self.held + new
        self.held = data[len(data) - k:]
        return data[:len(data) - k].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Whole texts: pattern, transducer, memory of pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str, memory: float = 1.0):
        import regex
        self.memory = memory
        self.machine = Transducer(load_ranks(ranks_path), memory)
        self.words = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.tokens = TokenBytes(self.machine.bytes_of)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.words.findall(t) for t in texts]
        most = int(REMEMBERED_WORDS * self.memory)
        if len(self.known) > most:  # the oldest ones are the frequent ones
            self.known = dict(islice(self.known.items(), most // 2))
        new = list(set().union(*found).difference(self.known)) if found else []
        self.known.update(zip(new, self.machine.encode_all([w.encode() for w in new])))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in found]

    def decode(self, ids: bytes, step: int = 1 << 16) -> bytes:
        stream, out = StreamDecoder(self.tokens), []
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), step):
            out.append(stream.feed(numbers[at:at + step]))
        out.append(stream.end())
        return "".join(out).encode()


def codec(ranks_path: str, pattern: str, memory: float = 1.0) -> Codec:
    """One for each worker process, which keeps its tables from task to task of this operator."""
    return held(("byte_bpe", ranks_path, pattern, memory), lambda: Codec(ranks_path, pattern, memory))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", keep_ids: bool = False, carry: tuple[str, ...] = (),
                     memory: float = 1.0) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids binary]) and the columns ``carry`` for every
    row of ``docs``. ``memory`` scales what a worker remembers, which changes no result."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        c = codec(ranks_path, pattern, memory)

        def work(part):
            encoded = c.encode([t or "" for t in part.column(1).to_pylist()])
            cols = [part.column(0), [len(x) // 4 for x in encoded], [hashlib.sha256(x).hexdigest() for x in encoded],
                    [hashlib.sha256(c.decode(x)).hexdigest() for x in encoded]]
            return cols + [encoded] * keep_ids + [part.column(2 + i) for i in range(len(carry))]
        return work

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_texts(slim, schema, make, most=SLICE_BYTES).withColumnRenamed("id", id_col)
