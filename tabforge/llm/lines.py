"""Line dedup: runs of lines that occurred before are deleted, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import arrow_map, split_by_keys, stored, utf8

#: Words of the shortest run that counts as repeated.
RUN_WORDS = 50


def windows(lines: list[bytes], words: int = RUN_WORDS) -> tuple[list[int], list[tuple[int, int]]]:
    """Hashes of the lines, and the shortest windows ``[first, last]`` with so many words.

    There is a window from each line onwards and one up to each line, as far as the text has the
    words.  Any run with so many words is the union of the windows inside it.
    """
    counts = [len(line.split()) for line in lines]
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    found, last, total = set(), -1, 0
    for first in range(len(lines)):
        while total < words and last + 1 < len(lines):
            last += 1
            total += counts[last]
        if total < words:
            break
        found.add((first, last))
        total -= counts[first]
    first, total = len(lines), 0
    for last in range(len(lines) - 1, -1, -1):
        while total < words and first > 0:
            first -= 1
            total += counts[first]
        if total < words:
            break
        found.add((first, last))
        total -= counts[last]
    return hashes, sorted(found)


def fingerprints(hashes: list[int], found: list[tuple[int, int]]) -> list[int]:
    """The line with the least hash of each window, the rightmost of equals."""
    return [min(range(first, last + 1), key=lambda i: (hashes[i], -i)) for first, last in found]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = RUN_WORDS) -> DataFrame:
    """``docs`` without the later occurrences of repeated runs of whole lines.

    A run of at least ``words`` words is repeated if the same lines occurred before: in a document of smaller
    id (null ids last, equal ids by a digest of the text), or further up in the same one.  All lines of its
    maximal extent go; the rest of the text keeps its order and line ends.  Rows repeated with the same id
    and text are one document, treated alike.  Null texts stay null; a text may become empty, but no row
    goes.  All columns are returned, the text changed; columns of any name may be there.

    Each window of ``words`` words gives its least line hash as a fingerprint, so two equal runs have
    one in common.  Fingerprints are counted over all positions; only windows around a repeated one go on, and the few whose
    fingerprint shares its bucket with one.  Such matches are extended both ways: the windows from and up to each line are compared by
    content (128-bit hashes), the first place of each content stays, lines covered by later places are
    deleted.  A content shared by many documents costs one row a place, never pairs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("digest"), F.col(text_col).alias("text"))

    def scan(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        out: list[tuple] = []
        for i, data in enumerate(utf8(batch.column(2))):
            lines = data.split(b"\n")
            hashes, found = windows(lines, words)
            for (first, last), at in zip(found, fingerprints(hashes, found)):
                content = xxhash.xxh3_128_digest(b"\n".join(lines[first:last + 1]))
                out.append((i, first, last, at, hashes[at] - (1 << 63), content))
        rows, first, last, at, mark, content = zip(*out) if out else [()] * 6
        where = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(where), batch.column(1).take(where), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
             pa.array(at, pa.int32()), pa.array(mark, pa.int64()), pa.array(content, pa.binary())],
            ["id", "digest", "first", "last", "at", "mark", "content"])

    found = stored(arrow_map(keyed,
                             f"id {kind}, digest long, first int, last int, at int, mark long, content binary", scan), "windows")
    # A mark is repeated if it has two places; two hashes of them tell, so nothing but marks is shuffled.
    spot = F.xxhash64("id", "digest", "at")
    repeated = found.groupBy("mark").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high").select("mark")
    matches, _ = split_by_keys(found, [F.col("mark")], repeated, [F.col("mark")])
    # The order of places: null ids last.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "first")
    matches = matches.select("content", "id", "digest", "first", "last", place.alias("place"))
    first = matches.groupBy("content").agg(F.min("place").alias("origin"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "origins")
    later = matches.join(first.hint("merge"), "content").where("place <> origin")
    gone = later.groupBy("id", "digest").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = stored(gone.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest"), "gone"), "gone")
    # Only documents that lose lines are shuffled.
    some, whole = split_by_keys(docs, [F.col(id_col), key], gone, [F.col("gone_id"), F.col("gone_digest")])
    some = some.select(F.struct(*some.columns).alias("row"), F.col(id_col).alias("id"), key.alias("digest"))
    # One kind of join at every size.
    joined = some.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left")

    def delete(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        row = pa.RecordBatch.from_struct_array(batch.column(0))
        at = row.schema.get_field_index(text_name)
        texts = [left(t, spans) if spans else t for t, spans in zip(row.column(at).to_pylist(), batch.column(1).to_pylist())]
        yield row.set_column(at, row.schema.field(at), pa.array(texts, row.schema.field(at).type))

    text_name = next(f for f in docs.columns if f.lower() == text_col.lower())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return whole.unionByName(arrow_map(joined.select("row", "gone"), schema, delete))


def left(text: str, spans: list[dict]) -> str:
    """The text without the lines that the spans cover, in one pass over sorted spans."""
    spans = sorted((s["first"], s["last"]) for s in spans)
    lines, out, end = text.split("\n"), [], 0
    for first, last in spans:
        if first > end:
            out += lines[end:first]
        end = max(end, last + 1)
    return "\n".join(out + lines[end:])
