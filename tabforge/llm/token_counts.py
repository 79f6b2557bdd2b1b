"""Token counts of whole texts, by batches of equal bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabforge.llm.common import arrow_map, per_worker, utf8

#: Bytes of text in one call of the library.
BATCH_BYTES = 1 << 20
#: A longer text is split, so that one document never makes a batch of its own size.
SPLIT_CHARS = 1 << 18
#: Bytes of words a worker remembers with their counts before it starts anew, and what each takes beside its characters.
MEMO_BYTES, MEMO_EACH = 32 << 20, 180
#: A byte-level pre-tokenizer never joins white space to what stands before it.
_BOUNDARY = re.compile(r"(?<=[!-~])(?=[\t\n\v\f\r ])")


def split_safely(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """Parts of a text whose counts add up to the count of the whole.

    Cuts lie between a visible ASCII character and white space.  A stretch without such a place
    stays whole, however long.
    """
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start:cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


class TokenCounter:
    """Counts the tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._words = regex.compile(pattern)
        special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        # The library takes its special strings out of a text first, the longest where several fit.
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._memo: dict[str, int] = {}
        self._room = MEMO_BYTES
        # Tasks share the cores; threads of the library would only add memory to each worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: its special strings, and the words between them."""
        words, extra = [], []
        for text in texts:
            parts = self._special.split(text) if self._special else [text]
            extra.append(len(parts) - 1)
            words.append(self._words.findall(text) if len(parts) == 1 else
                         [w for p in parts for w in self._words.findall(p)])
        fresh = set().union(*words).difference(self._memo)
        if self._room < 0:
            self._memo, self._room = {}, MEMO_BYTES
            fresh = set().union(*words)
        fresh = list(fresh)
        for word, found in zip(fresh, self._library.encode_batch_fast(fresh, add_special_tokens=False)):
            self._memo[word] = len(found)
            self._room -= MEMO_EACH + 4 * len(word)
        return [n + sum(map(self._memo.__getitem__, w)) for n, w in zip(extra, words)]


def _counter(path: str, pattern: str) -> TokenCounter:
    return per_worker(("counter", path, pattern), lambda: TokenCounter(path, pattern))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    One row for each input row; a null or empty text has 0 bytes and 0 tokens.  Repeated rows are
    counted each; other columns are ignored.  Only lengths leave the tasks.  ``path`` is a file of
    the tokenizers library with a byte-level pre-tokenizer that splits by ``pattern``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        data = utf8(batch.column(1))
        totals, room, at, parts = np.zeros(len(data), np.int64), BATCH_BYTES, [], []

        def flush():
            np.add.at(totals, at, _counter(path, pattern).count(parts))
            at.clear(), parts.clear()

        for i, d in enumerate(data):
            for part in split_safely(d.decode("utf-8", "replace")):
                at.append(i), parts.append(part)
                room -= len(part)
                if room <= 0:
                    flush()
                    room = BATCH_BYTES
        if parts:
            flush()
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(totals), pa.array(totals > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                     f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", count)
