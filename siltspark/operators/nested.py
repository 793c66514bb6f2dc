"""Nested file listings of backup jobs as flat tables of files, chunks, attributes and access entries.

The texts of an Arrow batch are indexed together (functions.json_index); each table is then made of parent indexes and
takes: a child row's keys are taken from its parent's by index. Texts that are not valid JSON give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltspark.functions.columns import fingerprint_key
from siltspark.functions.json_index import ARR, OBJ, PRIM, STR, JsonIndex

#: Bytes of JSON text indexed at once; one longer text is indexed by itself.
SLICE_BYTES = 4 << 20
#: Fields that are structure or columns of their own; every other field is an attribute of the object it stands in.
STRUCTURE = {"root": ("files", "tree"), "folder": ("name", "files", "folders"), "file": ("path", "name", "size", "chunks", "acl"), "chunk": ("fingerprint", "fp", "offset", "size")}

TABLES = {
    "files": "file_no long, file_path string, size_text string, n_chunks long",
    "chunks": "file_no long, file_path string, chunk_no long, fingerprint_text string, fp_text string, offset_text string, size_text string",
    "attributes": "owner string, file_no long, file_path string, chunk_no long, name string, value string",
    "access": "file_no long, file_path string, entry_no long, who string, perms string, entry string",
}


class _Listing:
    """Files of a slice of texts: node, text row, path, number within the row."""

    def __init__(self, texts: pa.Array, rows: np.ndarray):
        self.x = x = JsonIndex(texts)
        self.rows = rows
        roots = x.roots
        obj = roots[x.is_kind(roots, OBJ)]
        self.objects, self.folders = obj, np.zeros(0, np.int64)
        self.folder_path: list[pa.Array] = []
        nodes, paths = [], []

        def add(found: np.ndarray, path: pa.Array) -> None:
            keep = x.is_kind(found, OBJ)
            nodes.append(found[keep])
            paths.append(path.filter(pa.array(keep)))

        listed = x.child("files")[obj]
        lists = np.concatenate([roots[x.is_kind(roots, ARR)], listed[x.is_kind(listed, ARR)]])
        _, found = x.expand(lists, x.elements)
        add(found, x.text(x.child("path")[found]))
        keyed = listed[x.is_kind(listed, OBJ)]
        if len(keyed):
            slot = np.full(len(x.kind), -1)
            slot[x.members] = np.arange(len(x.members))
            _, found = x.expand(keyed, x.members)
            # Of members with the same name in one object the last one counts.
            names = x.names.take(pa.array(slot[found]))
            pair = np.stack([x.parent[found], np.asarray(names.dictionary_encode().indices)], axis=1)
            _, last = np.unique(pair[::-1], axis=0, return_index=True)
            last = np.sort(len(found) - 1 - last)
            add(found[last], names.take(pa.array(last)))
        folder = x.child("tree")[obj]
        folder = folder[x.is_kind(folder, OBJ)]
        path = x.text(x.child("name")[folder])
        folders = []
        while len(folder):
            folders.append(folder)
            for name in ("files", "folders"):
                inner = x.child(name)[folder]
                row, found = x.expand(np.where(x.is_kind(inner, ARR), inner, -1), x.elements)
                keep = x.is_kind(found, OBJ)
                row, found = row[keep], found[keep]
                joined = pc.binary_join_element_wise(path.take(pa.array(row)), x.text(x.child("name")[found]), pa.scalar("/", pa.large_string()), null_handling="skip")
                if name == "files":
                    add(found, joined)
                else:
                    folder, path = found, joined
        self.folders = np.concatenate(folders) if folders else np.zeros(0, np.int64)
        node, path = np.concatenate(nodes), pa.concat_arrays([p.cast(pa.large_string()) for p in paths])
        order = np.argsort(node, kind="stable")
        self.node, self.path = node[order], path.take(pa.array(order))
        doc = x.doc[self.node]
        lead = np.r_[True, np.diff(doc) != 0] if len(doc) else np.zeros(0, bool)
        self.number = np.arange(len(doc)) - np.repeat(np.flatnonzero(lead), np.diff(np.r_[np.flatnonzero(lead), len(doc)])) if len(doc) else doc

    def _long(self, values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int64(), mask=values < 0)

    def _scalar(self, nodes: np.ndarray) -> pa.Array:
        """Numbers as their text, strings as their content."""
        return pc.coalesce(self.x.text(nodes), self.x.raw(np.where(self.x.is_kind(nodes, PRIM), nodes, -1)))

    def _chunks(self) -> tuple[np.ndarray, np.ndarray]:
        lists = self.x.child("chunks")[self.node]
        return self.x.expand(np.where(self.x.is_kind(lists, ARR), lists, -1), self.x.elements)

    def _of_file(self, file: np.ndarray) -> list[pa.Array]:
        return [self._long(self.number[file]), self.path.take(pa.array(file))]

    def files(self) -> tuple[np.ndarray, list[pa.Array]]:
        file, _ = self._chunks()
        count = np.bincount(file, minlength=len(self.node))
        every = np.arange(len(self.node))
        return self.x.doc[self.node], [*self._of_file(every), self._scalar(self.x.child("size")[self.node]), self._long(count)]

    def chunks(self) -> tuple[np.ndarray, list[pa.Array]]:
        file, element = self._chunks()
        field = lambda name: self.x.child(name)[element]
        own = pc.coalesce(self.x.text(element), self.x.text(field("fingerprint")))
        return self.x.doc[element], [*self._of_file(file), self._long(self.x.place[element]), own, self.x.text(field("fp")), self._scalar(field("offset")), self._scalar(field("size"))]

    def access(self) -> tuple[np.ndarray, list[pa.Array]]:
        lists = self.x.child("acl")[self.node]
        file, entry = self.x.expand(np.where(self.x.is_kind(lists, ARR), lists, -1), self.x.elements)
        return self.x.doc[entry], [*self._of_file(file), self._long(self.x.place[entry]), self._scalar(self.x.child("who")[entry]), self.x.raw(self.x.child("perms")[entry]), self.x.raw(entry)]

    def attributes(self) -> tuple[np.ndarray, list[pa.Array]]:
        """Every field that is in no other table, down to its leaves; name is the path to the leaf."""
        x = self.x
        file, element = self._chunks()
        held = x.is_kind(element, OBJ)
        owners = {
            "root": (self.objects, np.full(len(self.objects), -1), np.full(len(self.objects), -1)),
            "folder": (self.folders, np.full(len(self.folders), -1), np.full(len(self.folders), -1)),
            "file": (self.node, np.arange(len(self.node)), np.full(len(self.node), -1)),
            "chunk": (element[held], file[held], x.place[element[held]]),
        }
        docs, columns = [], []
        slot = np.full(len(x.kind), -1)
        slot[x.members] = np.arange(len(x.members))
        for owner, (nodes, file_of, chunk_of) in owners.items():
            row, node = x.expand(nodes, x.members)
            name = x.names.take(pa.array(slot[node]))
            keep = ~pc.is_in(name, pa.array(STRUCTURE[owner], pa.large_string())).to_numpy(zero_copy_only=False)
            # A field of structure that does not have the expected form stays, as an attribute.
            for field, kinds in (("files", (ARR, OBJ)), ("tree", (OBJ,)), ("folders", (ARR,)), ("chunks", (ARR,)), ("acl", (ARR,)), ("path", (STR,)), ("name", (STR,)), ("size", (PRIM, STR)), ("offset", (PRIM, STR)), ("fingerprint", (STR,)), ("fp", (STR,))):
                keep |= pc.equal(name, field).to_numpy(zero_copy_only=False) & ~x.is_kind(node, *kinds)
            row, node, name = row[keep], node[keep], name.filter(pa.array(keep))
            while len(node):
                filled = x.is_kind(node, OBJ, ARR) & (x.end[node] - x.start[node] > 2)
                r1, inner1 = x.expand(np.where(filled, node, -1), x.members)
                r2, inner2 = x.expand(np.where(filled, node, -1), x.elements)
                grown = np.zeros(len(node), bool)
                grown[r1], grown[r2] = True, True
                leaf = np.flatnonzero(~grown)
                docs.append(x.doc[node[leaf]])
                r = row[leaf]
                columns.append([pa.array([owner] * len(leaf), pa.large_string()), *[c for c in (self._long(np.where(file_of[r] >= 0, self.number[file_of[r]] if len(self.number) else -1, -1)), self.path.take(pa.array(file_of[r], mask=file_of[r] < 0)))], self._long(chunk_of[r]), name.take(pa.array(leaf)), x.raw(node[leaf])])
                join = lambda left, right: pc.binary_join_element_wise(left, right, pa.scalar("", pa.large_string()))
                under = join(pc.binary_join_element_wise(name.take(pa.array(r1)), x.names.take(pa.array(slot[inner1])), pa.scalar(".", pa.large_string())), pa.scalar("", pa.large_string()))
                index = pa.array(x.place[inner2]).cast(pa.large_string())
                within = pc.binary_join_element_wise(name.take(pa.array(r2)), pa.scalar("[", pa.large_string()), index, pa.scalar("]", pa.large_string()), pa.scalar("", pa.large_string()))
                row, node, name = np.concatenate([row[r1], row[r2]]), np.concatenate([inner1, inner2]), pa.concat_arrays([under, within])
        return np.concatenate(docs) if docs else np.zeros(0, np.int64), [pa.concat_arrays(c) for c in zip(*columns)] if columns else []


def _listings(texts: pa.Array, rows: np.ndarray) -> Iterator[_Listing]:
    """The listing of texts, then of the texts that were JSON strings holding JSON, and so on."""
    while len(rows):
        found = _Listing(texts, rows)
        yield found
        inner = found.x.roots[found.x.is_kind(found.x.roots, STR)]
        texts, rows = found.x.text(inner), rows[found.x.doc[inner]]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def flatten_listings(jobs: DataFrame, table: str, keys: list[str], column: str = "files_metadata") -> DataFrame:
    """One of TABLES, with the named columns of the job row in front. Null, empty and invalid texts give no rows, a
    repeated job row gives its rows again. file_no counts the files of a text in order of appearance and, with the
    keys, names the parent of chunk, attribute and access rows. A field missing in an object is null."""
    own = T._parse_datatype_string(TABLES[table])
    schema = T.StructType([*[jobs.schema[k] for k in keys], *own.fields])
    width = len(own.fields)
    src = jobs.filter(F.col(column).isNotNull()).select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
            for lo, hi in _slices(text):
                part = text.slice(lo, hi - lo)
                for found in _listings(part, np.arange(lo, hi)):
                    doc, columns = getattr(found, table)()
                    if not len(doc):
                        continue
                    rows = pa.array(found.rows[doc])
                    if target is None:
                        target = [pa.string() if pa.types.is_large_string(c.type) else c.type for c in columns]
                    out = [batch.column(i).take(rows) for i in range(len(keys))] + [c.cast(t) for c, t in zip(columns, target)]
                    assert len(columns) == width
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return src.mapInArrow(run, schema)


def listed_fingerprint() -> Column:
    """The fingerprint a chunk row of flatten_listings holds, else null."""
    return F.coalesce(fingerprint_key("fingerprint_text"), fingerprint_key("fp_text"))


def listed_chunks(jobs: DataFrame, keys: list[str], column: str = "files_metadata") -> DataFrame:
    """keys, file_path, chunk_no, fingerprint of each listed chunk whose element holds a fingerprint."""
    rows = flatten_listings(jobs, "chunks", keys, column)
    return rows.select(*keys, "file_path", "chunk_no", listed_fingerprint().alias("fingerprint")).filter(F.col("fingerprint").isNotNull())
