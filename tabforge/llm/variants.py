"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import arrow_map, stored

#: Letters of words, without A-Z, which are lower-cased.
SMALL, LATIN = (ord("a"), ord("z")), (0x00C0, 0x00FF)
#: Fewest code points and occurrences of a word; how many times as frequent a form is.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: Words of a filter shard in expectation; filter bytes of a word; bytes of the filters that one pass broadcasts.
SHARD_WORDS, WORD_BYTES, PASS_BYTES = 1 << 18, 4, 32 << 20
#: Bits that a word sets in one 64-bit block.
BLOCK_BITS = 5
#: Words of this length and longer share shards.
LONG_WORD = 64
#: Letters whose edits are generated at once.
EDITED = 4096
#: Vocabulary words of a task.
TASK_WORDS = 20_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def letter_values(letters: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(int(c).to_bytes(4, "little")) for c in letters], np.uint64)


def finished(mixed: np.ndarray, length: np.ndarray) -> np.ndarray:
    mixed = mixed ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for shift in (32, 29):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


class Spelled:
    """Words of a batch as one array of code points, with sums that give the hash of any edit at once.

    A word's hash is the sum of its letters' values times the powers of a base, modulo 2^64, mixed with its length.
    """

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), self.length)
        start = np.cumsum(self.length) - self.length
        self.place = np.arange(len(self.points)) - start[self.word]
        powers = np.full(int(self.length.max(initial=0)) + 1, _BASE, np.uint64)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[self.place]
        seen, back = np.unique(self.points, return_inverse=True)
        self.value = letter_values(seen)[back]
        total = np.r_[np.uint64(0), np.cumsum(self.value * self.power)]
        self.before = total[:-1] - total[start][self.word] if len(words) else total[:-1]
        self.sum = total[start + self.length] - total[start]

    def hashes(self) -> np.ndarray:
        return finished(self.sum, self.length)

    def shorter(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words without the letter at each of the places."""
        of = self.word[at]
        after = self.sum[of] - self.before[at] - self.value[at] * self.power[at]
        return finished(self.before[at] + after * np.uint64(_INVERSE), self.length[of] - 1)

    def replaced(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Hashes with each letter in turn (columns) instead of the one at each of the places (rows)."""
        of = self.word[at]
        mixed = self.sum[of][:, None] + (values[None, :] - self.value[at][:, None]) * self.power[at][:, None]
        return finished(mixed, self.length[of][:, None])


def block_mask(hashes: np.ndarray) -> np.ndarray:
    """The bits that a word sets in its block."""
    mask = np.zeros(hashes.shape, np.uint64)
    for k in range(BLOCK_BITS):
        mask |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(30)) % np.uint64(blocks)).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(33)) % np.uint64(shards)


def probe(filters: dict[tuple[int, int], np.ndarray], shards: int, length: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes, all of one length class, some filter of this pass may hold."""
    found, mask, shard = np.zeros(hashes.shape, bool), block_mask(hashes), shard_of(hashes, shards)
    for k in range(shards):
        blocks = filters.get((length, k))
        if blocks is not None:
            hit = (blocks[block_of(hashes, len(blocks))] & mask) == mask
            found |= hit & (shard == k) if shards > 1 else hit
    return found


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None) -> DataFrame:
    """``word, n``: words of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences, with A-Z lower-cased.

    With ``drop_every``, a run of which the checksum of ``<id>:<run>`` is divisible by it loses the code point at
    the checksum modulo its length, as a typing error would.  A null id counts as empty.
    """
    upper, lower = (bytes(range(ord(c), ord(c) + 26)).decode() for c in "Aa")
    runs = F.regexp_extract_all(text_col, F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))  # shorter runs make no word
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.translate("run", upper, lower)
    found = found.select("id", F.when(F.col("run").rlike("[A-Z]"), word).otherwise(F.col("run")).alias("word"))
    if drop_every:
        found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        found = found.withColumn("word", F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("word")))
        found = found.where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def spelling_variants(words: DataFrame) -> DataFrame:
    """Groups words (``word, n``, each once) with the words one inserted, deleted or replaced code point away.

    Returns ``word, form, root, n, n_near, form_n``: the near word of largest count (ties: smallest in code-point
    order) if its count is ``FORM_FACTOR`` times the word's or more, else null; the end of the chain of forms; the number of near
    words.  Words may be of any length.  An empty vocabulary gives no rows.

    Each word generates its deletions, and its replacements by later letters; the other word of a pair finds the
    rest.  Edits are probed by hash against Bloom filters, sharded by length, that are built in tasks and broadcast in passes of
    at most ``PASS_BYTES``; a pass generates only edits of the lengths it holds.  Only positives are shuffled, to
    a join with the vocabulary by hash; the edit is then compared as text, which removes false positives.
    """
    def hashed(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        spelled = Spelled(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelled.hashes().view(np.int64))], [*batch.schema.names, "hash"])

    vocabulary = stored(arrow_map(words.select("word", F.col("n").cast("long").alias("n")), "word string, n long, hash long", hashed), "vocabulary")
    length = F.least(F.length("word"), F.lit(LONG_WORD))
    counts = vocabulary.groupBy(length.alias("length")).count().collect()  # at most LONG_WORD rows
    shards = {r["length"]: -(-r["count"] // SHARD_WORDS) for r in counts}
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct()
    letters = np.array(sorted(ord(r[0]) for r in letters.collect()), np.int64)  # of an alphabet
    tasks = max(1, -(-sum(r["count"] for r in counts) // TASK_WORDS))
    vocabulary = stored(vocabulary.repartition(tasks, "hash"), "words")
    found = None
    for part in _passes(shards):
        positives = _positives(vocabulary, _filters(vocabulary, part, shards), part, shards, letters)
        found = positives if found is None else found.unionByName(positives)
    if found is None:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), F.col("n").cast("long").alias("n"),
                            F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    others = vocabulary.select("hash", F.col("word").alias("other"), F.col("n").alias("other_n"))
    same = F.when(F.col("deleted"), _without("word", F.col("at")) == F.col("other")).otherwise(
        (F.length("word") == F.length("other")) & (F.col("word") != F.col("other")) &
        (_without("word", F.col("at")) == _without("other", F.col("at"))))
    pairs = stored(found.join(others, "hash").where(same).select("word", "n", "other", "other_n"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    named = vocabulary.join(near, "word", "left")
    form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(form, F.col("best.other")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")), "forms")
    ends = _roots(named.where("form is not null").select("word", F.col("form").alias("root")))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _without(word: str, at: Column) -> Column:
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: each word with the end of its chain; a round doubles the length that is followed."""
    links = stored(links, "roots")
    while True:
        nexts = links.select(F.col("word").alias("at"), F.col("root").alias("end"))
        moved = stored(links.join(nexts, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def _passes(shards: dict[int, int]) -> list[set[tuple[int, int]]]:
    """Shards (length, number) in parts that fit a broadcast."""
    size, out = SHARD_WORDS * WORD_BYTES, []
    most = max(1, PASS_BYTES // size)
    every = [(length, k) for length in sorted(shards) for k in range(shards[length])]
    for at in range(0, len(every), most):
        out.append(set(every[at:at + most]))
    return out


def _filters(vocabulary: DataFrame, part: set[tuple[int, int]], shards: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """The blocks of each shard of a pass, built where Spark has gathered the shard's words."""
    def place(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        hashes, lengths = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        shard = np.zeros(len(hashes), np.int64)
        for n in np.unique(lengths):
            rows = lengths == n
            shard[rows] = shard_of(hashes[rows], shards[int(n)])
        keep = [(int(n), int(k)) in part for n, k in zip(lengths, shard)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard)], ["hash", "length", "shard"]).filter(pa.array(keep, pa.bool_()))

    def build(table: pa.Table) -> pa.Table:
        hashes = table.column("hash").to_numpy().view(np.uint64)
        blocks = np.zeros(max(1, len(hashes) * WORD_BYTES // 8), np.uint64)
        np.bitwise_or.at(blocks, block_of(hashes, len(blocks)), block_mask(hashes))
        return pa.table([table.column("length")[:1], table.column("shard")[:1], pa.array([blocks.tobytes()], pa.binary())], names=["length", "shard", "blocks"])

    placed = vocabulary.select("hash", F.least(F.length("word"), F.lit(LONG_WORD)).cast("long").alias("length"))
    built = arrow_map(placed, "hash long, length long, shard long", place).groupBy("length", "shard").applyInArrow(
        build, "length long, shard long, blocks binary")
    return {(r["length"], r["shard"]): np.frombuffer(bytes(r["blocks"]), np.uint64) for r in built.collect()}  # PASS_BYTES, about


def _positives(vocabulary: DataFrame, filters: dict, part: set[tuple[int, int]], shards: dict[int, int], letters: np.ndarray) -> DataFrame:
    """``word, n, hash, at, deleted``: edits that a filter of this pass may hold."""
    held = vocabulary.sparkSession.sparkContext.broadcast(filters)
    lengths = sorted({n for n, _ in part})

    def edit(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        spelled, blocks, values = Spelled(batch.column(0).to_pylist()), held.value, letter_values(letters)
        size = spelled.length[spelled.word]
        double = np.r_[False, (spelled.points[1:] == spelled.points[:-1]) & (spelled.word[1:] == spelled.word[:-1])] if len(size) else np.zeros(0, bool)
        for n in lengths:
            for deleted in (True, False):
                result = np.minimum(size - deleted, LONG_WORD) == n
                places = np.flatnonzero(result & ~double if deleted else result)  # one of equal neighbours goes
                for s in range(0, len(places), EDITED):
                    at = places[s:s + EDITED]
                    if deleted:
                        hashes = spelled.shorter(at)[:, None]
                        hit = probe(blocks, shards[n], n, hashes)
                    else:
                        hashes = spelled.replaced(at, values)
                        hit = probe(blocks, shards[n], n, hashes) & (letters[None, :] > spelled.points[at][:, None])
                    x, y = np.nonzero(hit)
                    rows = pa.array(spelled.word[at[x]])
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes[x, y].view(np.int64)),
                             pa.array(spelled.place[at[x]], pa.int32()), pa.array(np.full(len(x), deleted))],
                            ["word", "n", "hash", "at", "deleted"])

    return stored(arrow_map(vocabulary.select("word", "n"), "word string, n long, hash long, at int, deleted boolean", edit), "positives")
