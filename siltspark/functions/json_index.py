"""A column of JSON texts as one node table, by vector operations over the column's byte buffer.

No row is parsed by itself: quotes, brackets and scalars of all texts are found at once in the concatenated bytes,
nesting depth is a running sum, the enclosing container of a token is a search among the openers one level up, and the
grammar is checked by each token's rank among its siblings. A text that is not JSON from start to end has no nodes."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJ, OBJ_END, ARR, ARR_END, COMMA, COLON, SPACE, STR, PRIM = 1, 2, 3, 4, 5, 6, 7, 10, 11
_CLASS = np.zeros(256, np.uint8)
for _c, _k in zip(b"{}[],: \t\n\r", (OBJ, OBJ_END, ARR, ARR_END, COMMA, COLON, SPACE, SPACE, SPACE, SPACE)):
    _CLASS[_c] = _k
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of buf as a large_string array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[at]))])


def unescape(raw: pa.Array) -> pa.Array:
    """JSON string contents (without quotes) as text. Only those with a backslash are rewritten, in one call."""
    odd = np.flatnonzero(pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False))
    if not len(odd):
        return raw
    texts = json.loads('["' + '","'.join(raw.take(pa.array(odd)).to_pylist()) + '"]')
    clean = [t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for t in texts]
    mask = np.zeros(len(raw), bool)
    mask[odd] = True
    return pc.replace_with_mask(raw, pa.array(mask), pa.array(clean, pa.large_string()))


class JsonIndex:
    """Nodes of all valid texts. Arrays by token: kind, doc, start, end (of the whole value), parent (token of the
    container, -1 at the root), place (position among the container's values); value: tokens that are values."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        base = int(offsets[0])
        buf = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
        self.buf, self.offsets, self.docs = buf, offsets - base, len(texts)
        self.bad = np.diff(offsets) == 0
        self._tokens()
        self._tree()

    def _doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def _spoil(self, at: np.ndarray) -> None:
        """Texts that hold these positions are not JSON."""
        if len(at):
            self.bad[self._doc(at)] = True

    def _tokens(self) -> None:
        buf, n = self.buf, len(self.buf)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        quote, slash = np.flatnonzero(buf == 34), np.flatnonzero(buf == 92)
        escapes = slash[:0]
        if len(slash):
            new = np.r_[True, (np.diff(slash) != 1) | first[slash[1:]]]
            run = slash[new][np.cumsum(new) - 1]
            escapes = slash[(slash - run) % 2 == 0]
            follows = np.zeros(n + 1, bool)
            follows[escapes + 1] = True
            quote = quote[~follows[quote] | first[quote]]
        owner = self._doc(quote)
        self.bad |= np.bincount(owner, minlength=self.docs)[: self.docs] % 2 == 1
        quote = quote[~self.bad[owner]]
        opened, closed = quote[::2], quote[1::2]
        edge = np.zeros(n + 1, np.int8)
        edge[opened] += 1
        edge[closed + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        kind = _CLASS[buf]
        kind[inside] = STR
        self._spoil(np.flatnonzero(inside & (buf < 32)))
        if len(escapes):
            escapes = escapes[inside[escapes]]
            code = buf[np.minimum(escapes + 1, n - 1)]
            self._spoil(escapes[~_ESCAPABLE[code]])
            wide = escapes[code == ord("u")]
            for k in range(2, 6):
                self._spoil(wide[~_HEX[buf[np.minimum(wide + k, n - 1)]]])
        scalar = kind == 0
        begin = np.flatnonzero(scalar & ~(np.r_[False, scalar[:-1]] & ~first[:-1]))
        finish = np.flatnonzero(scalar & ~(np.r_[scalar[1:], False] & ~first[1:])) + 1
        token = np.where((kind >= OBJ) & (kind <= COLON), kind, 0).astype(np.uint8)
        token[opened], token[begin] = STR, PRIM
        at = np.flatnonzero(token)
        end = np.zeros(n, np.int64)
        end[opened], end[begin] = closed + 1, finish
        if len(begin):
            well = pc.match_substring_regex(gather(buf, begin, finish), _SCALAR).to_numpy(zero_copy_only=False)
            self._spoil(begin[~well])
        self.kind, self.start = token[at], at
        self.end = np.where(self.kind < SPACE, at + 1, end[at])
        self.doc = self._doc(at)

    def _keep(self) -> None:
        good = ~self.bad[self.doc]
        self.kind, self.start, self.end, self.doc = (x[good] for x in (self.kind, self.start, self.end, self.doc))

    def _levels(self) -> tuple[np.ndarray, np.ndarray]:
        step = np.select([(self.kind == OBJ) | (self.kind == ARR), (self.kind == OBJ_END) | (self.kind == ARR_END)], [1, -1], 0)
        depth = np.cumsum(step)
        lead = np.r_[True, np.diff(self.doc) != 0]
        base = (depth - step)[lead]
        return depth - step - np.repeat(base, np.diff(np.r_[np.flatnonzero(lead), len(lead)])), step

    def _tree(self) -> None:
        self._keep()
        if len(self.kind):
            level, step = self._levels()
            total = np.bincount(self.doc, step, minlength=self.docs)
            self.bad |= total != 0
            self.bad[self.doc[(step < 0) & (level < 1)]] = True
            self._keep()
        n = len(self.kind)
        self.parent, rank, self.key = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        if n:
            level, _ = self._levels()
            order = np.argsort(level, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(level[order]) != 0, True])
            container = (self.kind == OBJ) | (self.kind == ARR)
            above = None
            for lo, hi in zip(cut[:-1], cut[1:]):
                here = order[lo:hi]
                if above is not None:
                    self.parent[here] = above[np.searchsorted(above, here) - 1]
                group = self.parent[here] if above is not None else self.doc[here]
                lead = np.r_[True, np.diff(group) != 0]
                rank[here] = np.arange(hi - lo) - np.repeat(np.flatnonzero(lead), np.diff(np.r_[np.flatnonzero(lead), hi - lo]))
                self.key[here[2:]] = here[:-2]
                above = here[container[here]]
            owner = np.where(self.parent >= 0, self.kind[self.parent], 0)
            value = container | (self.kind >= STR)
            turn = rank % 4
            in_obj = np.choose(turn, [self.kind == STR, self.kind == COLON, value, self.kind == COMMA])
            in_obj = np.where(self.kind == OBJ_END, (rank == 0) | (turn == 3), in_obj)
            in_arr = np.where(rank % 2 == 0, value, self.kind == COMMA)
            in_arr = np.where(self.kind == ARR_END, (rank == 0) | (rank % 2 == 1), in_arr)
            good = np.where(owner == OBJ, in_obj, np.where(owner == ARR, in_arr, value & (rank == 0)))
            self.bad[self.doc[~good]] = True
            self.value = value & ((owner == 0) | ((owner == OBJ) & (turn == 2)) | ((owner == ARR) & (rank % 2 == 0))) & ~self.bad[self.doc]
            self.place = np.where(owner == OBJ, rank // 4, rank // 2)
            close = np.flatnonzero((self.kind == OBJ_END) | (self.kind == ARR_END))
            self.end[self.parent[close]] = self.start[close] + 1
        else:
            self.value, self.place = np.zeros(0, bool), rank
        seen = np.zeros(self.docs, bool)
        seen[self.doc] = True
        self.bad |= ~seen
        nodes = np.flatnonzero(self.value)
        up = self.parent[nodes]
        self.roots = nodes[up < 0]
        inner, up = nodes[up >= 0], up[up >= 0]
        in_obj = self.kind[up] == OBJ
        self.members, self.elements = inner[in_obj], inner[~in_obj]
        names = self.key[self.members]
        self.names = unescape(gather(self.buf, self.start[names] + 1, self.end[names] - 1)) if len(names) else pa.array([], pa.large_string())
        self._coded = self.names.dictionary_encode()
        self._found: dict[str, np.ndarray] = {}

    def child(self, name: str) -> np.ndarray:
        """By token: the value of its member of that name (the last one, if it has several), else -1."""
        if name not in self._found:
            out = np.full(len(self.kind) + 1, -1)
            code = pc.index(self._coded.dictionary, pa.scalar(name, pa.large_string())).as_py()
            hit = self.members[np.asarray(self._coded.indices) == code]
            out[self.parent[hit]] = hit
            self._found[name] = out
        return self._found[name]

    def is_kind(self, nodes: np.ndarray, *kinds: int) -> np.ndarray:
        """Whether each node exists and is of one of the kinds; -1 is no node."""
        return (nodes >= 0) & np.isin(self.kind[nodes] if len(self.kind) else np.zeros(len(nodes)), kinds)

    def text(self, nodes: np.ndarray) -> pa.Array:
        """The text of string nodes; null for other nodes and for -1."""
        out = np.full(len(nodes), -1)
        on = np.flatnonzero(self.is_kind(nodes, STR))
        out[on] = np.arange(len(on))
        found = unescape(gather(self.buf, self.start[nodes[on]] + 1, self.end[nodes[on]] - 1))
        return found.take(pa.array(out, mask=out < 0))

    def raw(self, nodes: np.ndarray) -> pa.Array:
        """The JSON text of nodes; null for -1."""
        on = np.flatnonzero(nodes >= 0)
        out = np.full(len(nodes), -1)
        out[on] = np.arange(len(on))
        return gather(self.buf, self.start[nodes[on]], self.end[nodes[on]]).take(pa.array(out, mask=out < 0))

    def expand(self, containers: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node): the nodes of pool (members or elements) inside each container, in order. A container may be
        listed once; -1 has none."""
        slot = np.full(len(self.kind) + 1, -1)
        real = np.flatnonzero(containers >= 0)
        slot[containers[real]] = real
        row = slot[self.parent[pool]]
        keep = row >= 0
        return row[keep], pool[keep]
