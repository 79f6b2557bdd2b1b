"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tabforge.llm.common import arrow_map, per_worker, utf8

#: Bytes of words and ids a worker remembers before it starts anew, and what each word takes beside its characters.
MEMO_BYTES, MEMO_EACH = 32 << 20, 200
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 20


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(moved)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteDecoder:
    """The bytes of each id, by the reversed byte table."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        chars = byte_characters()
        back = {c: b for b, c in chars.items()}
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = bytes(map(back.__getitem__, map(chars.__getitem__, token)))
        self.table = pa.array(table, pa.large_binary())
        self.lengths = np.array([len(t or b"") for t in table], np.int64)

    def offsets(self, ids: np.ndarray, bounds: np.ndarray, decoded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token in its text, and the one after its last.

        ``decoded`` holds the texts of the runs of ids between ``bounds``.  A character whose bytes are split over
        several tokens belongs to each of them.
        """
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        data = np.frombuffer(decoded.buffers()[2] or b"", np.uint8, int(ends[-1]))
        seen = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before a byte
        base = np.repeat(seen[ends[bounds[:-1]]], np.diff(bounds))
        return (seen[ends[:-1] + 1] - 1 - base).astype(np.int32), (seen[ends[1:]] - base).astype(np.int32)

    def decode(self, ids: pa.Array, bounds: np.ndarray) -> pa.Array:
        """The bytes of each run of ids between ``bounds``, joined before any character is formed."""
        tokens = pc.take(self.table, ids)
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
        marks = np.ascontiguousarray(ends[bounds])
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(marks), tokens.buffers()[2]])


class ByteEncoder:
    """Ranks of tokens as a model of the tokenizers library.

    A rank file names tokens only.  Any two neighbours whose bytes join to a token may merge, the
    token of lowest rank first; so every such split is a merge, in the order of the ranks.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        chars = byte_characters()
        shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get)
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges,
                                           ignore_merges=True))
        self._words = regex.compile(pattern)
        self._chars = str.maketrans(chars)
        self._memo: dict[str, bytes] = {}
        self._room = MEMO_BYTES
        # Tasks share the cores; threads of the library would only add memory to each worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; every match of the pattern is encoded on its own."""
        return [array("i", p).tolist() for p in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers.  Only words not met before go to the model."""
        words = list(map(self._words.findall, texts))
        fresh = set().union(*words).difference(self._memo)
        if self._room < 0:
            self._memo, self._room = {}, MEMO_BYTES
            fresh = set().union(*words)
        fresh = list(fresh)
        shown = [w.encode().decode("latin-1").translate(self._chars) for w in fresh]
        for word, found in zip(fresh, self._model.encode_batch_fast(shown, add_special_tokens=False)):
            ids = self._memo[word] = array("i", found.ids).tobytes()
            self._room -= MEMO_EACH + 4 * len(word) + len(ids)
        return [b"".join(map(self._memo.__getitem__, found)) for found in words]


def _encoder(path: str, pattern: str) -> ByteEncoder:
    return per_worker(("encoder", path, pattern), lambda: ByteEncoder(path, pattern))


def _decoder(path: str) -> ByteDecoder:
    return per_worker(("decoder", path), lambda: ByteDecoder(path))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Returns ``doc_id, ids``; with ``offsets`` also ``starts, ends``, the character range of each token; with ``decoded`` also
    ``decoded``, the bytes of the ids by the reversed byte table, made in the same task.
    One row for each input row, in any order; a null or empty text has no ids.  Repeated rows and ids
    give repeated rows; other columns are ignored.  ``path`` is a rank file that executors can read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ([f"doc_id {kind}", "ids array<int>"] + ["starts array<int>", "ends array<int>"] * offsets + ["decoded binary"] * decoded)
    names = [f.split()[0] for f in fields]

    def encode(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        model = _encoder(path, pattern)
        for part in _by_bytes(batch):
            found = model.packed([d.decode("utf-8", "replace") for d in utf8(part.column(1))])
            ids = np.array(array("i", b"".join(found)), np.int32)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int64)
            columns = [part.column(0), _lists(ids, bounds)]
            if offsets or decoded:
                back = _decoder(path).decode(pa.array(ids), bounds)
            if offsets:
                columns += [_lists(x, bounds) for x in _decoder(path).offsets(ids, bounds, back)]
            if decoded:
                columns.append(back.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ", ".join(fields), encode)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of the ids.

    Characters split over tokens come out whole, as bytes are joined first; ids that end inside a
    character give the bytes they have.  Null ids give null; an id outside the table is an error.
    Columns that are there already keep their values, but for an earlier ``decoded``.
    """
    kept = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    at = kept.columns.index(ids_col)

    def decode(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        lists = batch.column(at)
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        decoded = _decoder(path).decode(pc.list_flatten(lists), bounds.astype(np.int64))
        if lists.null_count:
            decoded = pc.if_else(lists.is_valid(), decoded, pa.scalar(None, pa.large_binary()))
        yield pa.RecordBatch.from_arrays([*batch.columns, decoded.cast(pa.binary())],
                                         [*batch.schema.names, "decoded"])

    return arrow_map(kept, f"{fields}, decoded binary", decode)


def _by_bytes(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """Parts of a batch with some MB of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for i, j in zip(cuts, cuts[1:]):
        yield batch.slice(i, j - i)


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
