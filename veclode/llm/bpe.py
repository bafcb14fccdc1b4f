"""BPE encoding and decoding by a tokenization automaton.

Compilation walks the merges in order and applies one merge gadget for each: the gadget for (u, v)
adds the arc uv wherever u may be read, lets it go where v went, and forbids v after u. After the
last gadget exactly one path reads any pre-split word, and its arc labels are the tokens that the
merges give. A state is the last token read, all that the gadgets can tell apart. The arcs among the
CORE states are compiled into a table gadget by gadget; the others (2.5 billion in a vocabulary of 50,000
tokens) follow from the same gadgets, walked back, and are kept once they are known.

The labels are compiled into a deterministic automaton over bytes: its state is the longest end of what was
read that starts a label, so each byte is one transition of a dense table and tells which labels may end
there. The arc whose state before it allows it is the one on the path (there is exactly one, the longest
label being the likely one), and so each place of a word gets its state. The labels are read off from the
word's end. Short words go side by side, all distinct ones of a batch at once, long ones one by one.

Definitions: a null text encodes to no ids and decodes to an empty text; special tokens written in a
text get their own id, as in the tokenizers library; ids that the vocabulary lacks decode to nothing;
bytes that are not UTF-8 decode to U+FFFD. Rows never depend on each other: repeated rows give
repeated results, an empty table gives an empty table. Other columns pass through; `ids` and
`decoded` replace columns of those names.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytesops as B
from .store import map_in_arrow

_NONE = np.int32(-1)
#: States whose arcs are compiled into a table, and words of more bytes than go side by side.
CORE, LONG = 4096, 64
#: The contractions that byte-level pre-splitting keeps apart.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White_Space code points.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """For every code point: 1 letter, 2 number, 3 white space, 0 other."""
    kinds = np.fromiter(({"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[list(WHITE_SPACE)] = 3
    return kinds


class Table:
    """A hash table from non-negative 64-bit keys to 32-bit values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], _NONE)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Automaton:
    """The compiled merges of a byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, model = byte_symbols(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        labels = [b""] * size
        for token, i in vocab.items():
            labels[i] = b"".join(bytes([to_byte[c]]) if c in to_byte else c.encode() for c in token)
        for token, i in self.special.items():
            labels[i] = token.encode()
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_at = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in labels], out=self.label_at[1:])
        self.start = size  # the state before the first token
        # One gadget for each merge: when it was applied, its left and right arc.
        self.born = np.full(size + 1, -1, np.int64)
        self.left = np.arange(size + 1, dtype=np.int64)
        self.right = np.arange(size + 1, dtype=np.int64)
        gadgets = np.empty((len(model["merges"]), 2), np.int64)
        for rank, merge in enumerate(model["merges"]):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            gadgets[rank] = vocab[u], vocab[v]
            if self.born[w := vocab[u + v]] < 0:
                self.born[w], self.left[w], self.right[w] = rank, vocab[u], vocab[v]
        pairs = gadgets[:, 0] << 20 | gadgets[:, 1]
        _, first = np.unique(pairs, return_index=True)
        self.pairs, self.ranks = pairs[first], first
        self.gadget = Table(self.pairs, first.astype(np.int32))
        arcs = sorted(i for i in vocab.values() if self.born[i] >= 0 or len(labels[i]) == 1)
        self._core(arcs, gadgets)
        self._bytes({i: labels[i] for i in arcs})
        self.known_keys = np.full(1 << 20, -1, np.int64)
        self.known = np.zeros(1 << 20, bool)
        self.kept: dict[int, bool] = {}

    def _core(self, arcs: list[int], gadgets: np.ndarray) -> None:
        """The arcs among the first CORE states, by the merge gadgets in order."""
        states = sorted(arcs, key=lambda i: (self.born[i], i))[:CORE]
        n = len(states)
        self.core = np.full(len(self.born), -1, np.int64)
        self.core[states] = np.arange(n)
        table = np.zeros((n, n), bool)
        old = int((self.born[states] < 0).sum())
        table[:old, :old] = True
        by_rank = {int(self.born[i]): i for i in states[old:]}
        for rank, (u, v) in enumerate(self.core[gadgets].tolist()):
            if u < 0 or v < 0:
                continue
            row = table[v].copy()  # where v went, before v is forbidden after u
            table[u, v] = False
            if rank in by_rank:
                w = int(self.core[by_rank[rank]])
                table[:, w] = table[:, u]
                row[w] = row[u]
                table[w] = row
        self.follow = table

    def _bytes(self, labels: dict[int, bytes]) -> None:
        """The automaton over bytes: go, the transitions; best, the longest label that ends in a state; shorter, the next
        longest label that ends where a token ends."""
        node_of, depth, edges, token = {b"": 0}, [0], [], [-1]
        for i, label in labels.items():
            for n in range(1, len(label) + 1):
                if (p := label[:n]) not in node_of:
                    node_of[p] = len(depth)
                    edges.append((node_of[p[:-1]], p[-1], len(depth)))
                    depth.append(n)
                    token.append(-1)
            token[node_of[label]] = i
        parent, byte, child = np.array(edges).T
        level = np.array(depth)[child]
        self.go = np.zeros((len(depth), 256), np.int32)
        self.best = np.array(token, np.int32)
        fail = np.zeros(len(depth), np.int64)
        self.go[0, byte[level == 1]] = child[level == 1]
        for d in range(1, max(depth) + 1):
            p, b, c = parent[level == d], byte[level == d], child[level == d]
            if d > 1:
                fail[c] = self.go[fail[p], b]
            self.go[c] = self.go[fail[c]]
            own = (level == d + 1) & np.isin(parent, c)
            self.go[parent[own], byte[own]] = child[own]
            self.best[c] = np.where(self.best[c] < 0, self.best[fail[c]], self.best[c])
        self.shorter = np.full(len(self.born), -1, np.int32)
        last = np.array([node_of[label] for label in labels.values()])
        self.shorter[list(labels)] = self.best[fail[last]]
        self.size = np.append(np.diff(self.label_at), 0).astype(np.int64)
        self.plain = memoryview(self.go.reshape(-1)), self.best.tolist(), self.shorter.tolist(), self.size.tolist()
        self.plain_gadgets = dict(zip(self.pairs.tolist(), self.ranks.tolist())), self.born.tolist(), self.left.tolist(), self.right.tolist()

    def arcs(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether token t may follow token s."""
        out = s == self.start
        a, b = self.core[s], self.core[t]
        core = (a >= 0) & (b >= 0)
        out[core] = self.follow[a[core], b[core]]
        rest = np.flatnonzero(~core & ~out)
        if len(rest):
            key = s[rest] << 20 | t[rest]
            at = (key.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(44)).astype(np.int64)
            found = self.known[at]
            if len(new := np.flatnonzero(self.known_keys[at] != key)):
                keys, back = np.unique(key[new], return_inverse=True)
                made = self.walked(keys >> 20, keys & 0xFFFFF)
                found[new] = made[back]
                at = at[new]
                self.known_keys[at] = key[new]
                ok = self.known_keys[at] == key[new]
                self.known[at[ok]] = found[new][ok]
            out[rest] = found
        return out

    def walked(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Walks back through the gadgets: a newer token's state began as a copy of its right part's, and a
        newer token's arc was added wherever its left part's arc then was."""
        out = np.ones(len(s), bool)
        left = np.flatnonzero(s != self.start)
        until = np.full(len(s), 1 << 40, np.int64)
        s, t = s.copy(), t.copy()
        while len(left):
            a, b = s[left], t[left]
            rank = self.gadget.get(a << 20 | b)
            gone = (rank >= 0) & (rank <= until[left])
            out[left[gone]] = False
            old = (self.born[a] < 0) & (self.born[b] < 0)
            go = ~gone & ~old
            by_state = go & (self.born[a] > self.born[b])
            by_arc = go & ~by_state
            until[left[by_state]] = self.born[a[by_state]] - 1
            s[left[by_state]] = self.right[a[by_state]]
            until[left[by_arc]] = self.born[b[by_arc]]
            t[left[by_arc]] = self.left[b[by_arc]]
            left = left[go]
        return out

    def _one(self, s: int, t: int) -> bool:
        """As walked(), of one arc."""
        gadgets, born, left, right = self.plain_gadgets
        until = 1 << 40
        while True:
            rank = gadgets.get(s << 20 | t)
            if rank is not None and rank <= until:
                return False
            if born[s] < 0 and born[t] < 0:
                return True
            if born[s] > born[t]:
                until, s = born[s] - 1, right[s]
            else:
                until, t = born[t], left[t]

    def _side_by_side(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, base: np.ndarray, last: np.ndarray) -> None:
        """Fills in the states of many words. at: where they start in data; base: where in last."""
        order = np.argsort(-length, kind="stable")
        at, base, size = at[order], base[order], -length[order]
        node = np.zeros(len(at), np.int64)
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(size, -i, "left"))  # words longer than i
            node = self.go[node[:n], data[at[:n] + i]]
            t = self.best[node].astype(np.int64)
            here = base[:n] + i + 1
            left = np.flatnonzero(~self.arcs(last[here - self.size[t]], t))
            while len(left):
                t[left] = self.shorter[t[left]]
                left = left[~self.arcs(last[here[left] - self.size[t[left]]], t[left])]
            last[here] = t

    def _alone(self, word: bytes) -> list[int]:
        """The states at each place of one word."""
        go, best, shorter, size = self.plain
        last, node, kept, start = [self.start], 0, self.kept, self.start
        if len(kept) > 1 << 20:
            kept.clear()
        for i, byte in enumerate(word, 1):
            node = go[node << 8 | byte]
            t = best[node]
            while (s := last[i - size[t]]) != start:
                key = s << 20 | t
                ok = kept.get(key)
                if ok is None:
                    kept[key] = ok = self._one(s, t)
                if ok:
                    break
                t = shorter[t]
            last.append(t)
        return last

    def encode_words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the n + 1 offsets. at: the words' offsets in data."""
        n, length = len(at) - 1, np.diff(at)
        base = at[:-1] + np.arange(n)  # of each word's len + 1 states
        last = np.full(len(data) + n, self.start, np.int64)
        short = np.flatnonzero(length <= LONG)
        self._side_by_side(data, at[short], length[short], base[short], last)
        for w in np.flatnonzero(length > LONG).tolist():
            last[base[w] : base[w] + length[w] + 1] = self._alone(data[at[w] : at[w + 1]].tobytes())
        # Back along the one path of each word.
        here, ids, owner = length.copy(), [], []
        left = np.flatnonzero((here > 0) & (length <= LONG))
        while len(left):
            t = last[base[left] + here[left]]
            ids.append(t)
            owner.append(left)
            here[left] -= self.size[t]
            left = left[here[left] > 0]
        size = self.plain[3]
        for w in np.flatnonzero(length > LONG).tolist():
            states, i, own = last[base[w] : base[w] + length[w] + 1].tolist(), int(length[w]), []
            while i:
                own.append(states[i])
                i -= size[states[i]]
            ids.append(np.array(own))
            owner.append(np.full(len(own), w))
        if not ids:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        # Of each word the last label came first.
        all_ids, all_owner = np.concatenate([x[::-1] for x in ids[::-1]]), np.concatenate([x[::-1] for x in owner[::-1]])
        by = np.argsort(all_owner, kind="stable")
        to = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(all_owner, minlength=n), out=to[1:])
        return all_ids[by].astype(np.int32), to

    def split(self, text: str) -> np.ndarray:
        """Starts (in code points) of the pre-split words of a text, and its length."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return _split(code, np.zeros(0, np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the n + 1 offsets."""
        parts, owner, marks = [], [], []
        for i, text in enumerate(texts):
            for special, segment in _segments(text, self.special):
                parts.append(segment)
                owner.append(i)
                marks.append(self.special[special] if special else -1)
        joined = "".join(parts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        cut = np.concatenate([[0], ends]).astype(np.int64)
        starts = _split(code, cut[:-1])
        width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
        byte_at = np.zeros(len(code) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        word_at = byte_at[starts]  # with the end of all as the last
        size = np.diff(word_at)
        _, first, back = np.unique(B.unit_hash(data, word_at[:-1], word_at[1:]), return_index=True, return_inverse=True)
        # Words with one hash are compared with each other, as the words cover all of data.
        if not (np.array_equal(size[first[back]], size) and np.array_equal(B.gather(data, word_at[first[back]], size)[0], data)):
            first = back = np.arange(len(size))
        own, own_at = B.gather(data, word_at[:-1][first], np.diff(word_at)[first])
        ids, to = self.encode_words(own, own_at)
        count = np.diff(to)
        flat, flat_at = B.gather(ids, to[:-1][back], count[back])
        part_first = np.searchsorted(starts[:-1], cut)  # the first word of each part
        part_at = flat_at[part_first]
        marks_array, owner_array = np.array(marks, np.int64), np.array(owner, np.int64)
        if (marks_array >= 0).any():
            special = np.flatnonzero(marks_array >= 0)
            flat = np.insert(flat, part_at[:-1][special], marks_array[special])
            part_at = part_at + np.concatenate([[0], np.cumsum(marks_array >= 0)])
        text_first = np.searchsorted(owner_array, np.arange(len(texts) + 1))
        return flat.astype(np.int32), part_at[text_first]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc labels' bytes of all id lists in a row and the n + 1 offsets."""
        size = np.diff(self.label_at)
        known = (ids >= 0) & (ids < len(size))
        ids = np.where(known, ids, 0)
        length = np.where(known, size[ids], 0)
        data, to = B.gather(self.label_bytes, self.label_at[ids], length)
        return data, to[at]


def _segments(text: str, special: dict[str, int]) -> Iterator[tuple[str, str]]:
    """(special token before it or "", segment) from left to right."""
    found = [(text.find(s), -len(s), s) for s in special]
    found = [x for x in found if x[0] >= 0]
    before = ""
    while found:
        at, _, s = min(found)
        yield before, text[:at]
        before, text = s, text[at + len(s) :]
        found = [x for x in ((text.find(s), -len(s), s) for s in special) if x[0] >= 0]
    yield before, text


def _split(code: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Starts of the pre-split words and the length; no word crosses a cut."""
    n = len(code)
    if not n:
        return np.zeros(1, np.int64)
    kind = character_classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    edge[cuts[cuts < n]] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(begin)
    ends = np.append(begins[1:], n)
    ends_text = edge[ends]
    white = kind[begins] == 3
    word = np.ones(len(begins) + 1, bool)[:-1]  # does a word start where the run starts?
    starts = [begins[~white]]
    # White space: before a word its last character stands apart, and a space joins the word.
    run = np.flatnonzero(white)
    before_word = ~ends_text[run]
    starts.append(begins[run[~before_word]])
    run = run[before_word]
    tail = ends[run] - 1
    starts += [begins[run][tail > begins[run]], tail]
    joins = code[tail] == 32
    start = np.zeros(n + 1, bool)
    start[np.concatenate(starts)] = True
    start[ends[run[joins]]] = False
    # Contractions, where an apostrophe starts a word and letters follow.
    quote = np.flatnonzero((code == 39) & start[:-1])
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == 1) & ~edge[quote + 1]]
    if len(quote):
        padded = np.append(code, [0, 0, 0])
        inner = np.append(edge, [True, True, True])
        done = np.zeros(len(quote), bool)
        for c in CONTRACTIONS:
            hit = ~done
            for k, ch in enumerate(c):
                hit &= padded[quote + 1 + k] == ord(ch)
                hit &= ~inner[quote + 1 + k]
            q = quote[hit]
            start[q + 1] = False
            start[q + 1 + len(c)] = True
            done |= hit
    start[n] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, compiled once for each Python worker."""
    return Automaton(path)


def _with(schema: T.StructType, drop: tuple[str, ...], more: list[T.StructField]) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name.lower() not in drop] + more)


def _keep(batch: pa.RecordBatch, drop: tuple[str, ...]) -> tuple[list[pa.Array], list[str]]:
    names = [c for c in batch.schema.names if c.lower() not in drop]
    return [batch.column(batch.schema.get_field_index(c)) for c in names], names


def _texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    try:
        raw.decode()
        array = B.strings(data, at, pa.string())
        array.validate(full=True)
        return array
    except (UnicodeDecodeError, pa.ArrowInvalid):
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
_DECODED = T.StructField("decoded", T.StringType())


def _encode(batches: Iterator[pa.RecordBatch], path: str, text: str, decode: bool) -> Iterator[pa.RecordBatch]:
    a, drop = automaton(path), ("ids", "decoded") if decode else ("ids",)
    for batch in B.pieces(batches, text, 2 << 20):
        ids, at = a.encode([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
        columns, names = _keep(batch, drop)
        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
        if decode:
            columns.append(_texts(*a.decode(ids, at)))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "decoded"][: len(columns)])


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids: the token ids of each whole text."""
    return map_in_arrow(df, lambda it: _encode(it, path, text, False), _with(df.schema, ("ids",), [_IDS]))


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with decoded: the text that the labels of the column ids spell. A null list decodes to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            lists = [x or [] for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            at = np.cumsum([0, *map(len, lists)])
            ids = np.array([i for x in lists for i in x], np.int64)
            columns, names = _keep(batch, ("decoded",))
            yield pa.RecordBatch.from_arrays([*columns, _texts(*a.decode(ids, at))], names=[*names, "decoded"])

    return map_in_arrow(df, run, _with(df.schema, ("decoded",), [_DECODED]))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids and decoded, in one pass through Python."""
    return map_in_arrow(df, lambda it: _encode(it, path, text, True), _with(df.schema, ("ids", "decoded"), [_IDS, _DECODED]))
