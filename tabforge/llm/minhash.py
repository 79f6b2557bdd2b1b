"""Near-dedup by min-max hashing of word shingles, with every link confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import Kept, arrow_map, connected, split_by_keys, stored, utf8

#: Permutations; each gives its minimum and its maximum, so twice as many signature values.
PERMUTATIONS = 64
#: Bands of ``2 * PERMUTATIONS / BANDS`` values: two sets of Jaccard similarity 0.8 share none with a chance of 5e-8.
BANDS = 32
#: Rounds that compare each bucket with one of its members, before what is left is compared in full.
STAR_ROUNDS = 2
#: Earlier prefix shingles that a shingle carries.
BEFORE = 64
#: Distinct words whose hashes a task remembers; shingles permuted at once.
MEMO_WORDS, BLOCK = 100_000, 4096


def _constants(n: int, salt: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(salt + bytes([i])) | 1 for i in range(n)], np.uint64)


class _Words(dict):
    """Hashes of words, computed when first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of all words, if there are fewer; none without words."""
    if len(_words) > MEMO_WORDS:
        _words.clear()
    found = data.lower().split()  # of bytes: A-Z, and white space of ASCII, only
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(hashes))
    mixed = np.full(len(hashes) - width + 1, width, np.uint64)
    for i, factor in enumerate(_constants(width, b"shingle")):
        mixed += hashes[i:len(hashes) - width + 1 + i] * factor
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(found: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a set under each permutation ``a * x + b``; one hash for both."""
    a, b = _constants(permutations, b"a")[:, None], _constants(permutations, b"b")[:, None]
    low = high = None
    for at in range(0, len(found), BLOCK):
        hashed = found[None, at:at + BLOCK] * a + b
        least, most = hashed.min(axis=1), hashed.max(axis=1)
        low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
    return low, high


def buckets(found: np.ndarray, permutations: int = PERMUTATIONS, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit bucket for each band; a band holds the minima and maxima of its own permutations."""
    low, high = signature(found, permutations)
    values = np.concatenate([low.reshape(bands, -1), high.reshape(bands, -1)], axis=1)
    mixed = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in values.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row for each input row.  A text without words has an empty set and
    links with nothing.  Documents with equal sets are one class, a row for each class goes on.  Classes that share
    a bucket are candidates; a link counts only if the full sets confirm it.  Repeated ids are one document with the
    links of all its rows; a row without id links with nothing and is kept.  Other columns are ignored.

    No bucket is expanded into pairs: its members are compared with one of them first, and links make components.
    A bucket that lies in one component is done.  After ``STAR_ROUNDS`` rounds, the classes of all other buckets are
    compared where the rarest parts of their sets meet, which leaves no link between them out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        sets = [shingles(d, words) for d in utf8(batch.column(1))]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
             pa.array([buckets(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "key", "buckets"])

    signed = stored(arrow_map(docs, f"doc_id {kind}, n_shingles long, key binary, buckets array<long>", sign), "signatures")
    usable = signed.where("key is not null and doc_id is not null")
    # Equal sets have equal buckets.  Written, so the numbers stay.
    classes = Kept(usable.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
                   .withColumn("id", F.monotonically_increasing_id()), "classes")
    placed = classes.frame.select("id", "n", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    members = Kept(placed.join(shared, "bucket"), "members")
    wanted = Kept(classes.frame.select("id", "key", "least").join(members.frame.select("id").distinct(), "id"), "wanted")
    sets = Kept(_sets(docs, wanted.frame, words), "sets")
    wanted.drop()
    # Classes of one document id, then confirmed links.
    ids = signed.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("doc_id is not null and low <> high")
    of = classes.frame.select("id", "key")
    first = usable.select("doc_id", "key").distinct().join(ids, "doc_id").join(of.withColumnRenamed("id", "a").withColumnRenamed("key", "low"), "low")
    links = [Kept(first.join(of.withColumnRenamed("id", "b"), "key").where("a <> b").select("a", "b").distinct(), "links")]
    tested, component = [], None
    for turn in range(STAR_ROUNDS + 1):
        scratch: list[Kept] = []
        live = _live(members.frame, component, scratch)
        pairs = _stars(live, turn) if turn < STAR_ROUNDS else _rest(live, sets.frame, percent, scratch)
        pairs = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b").distinct()
        if tested:
            pairs = pairs.join(_union([t.frame for t in tested]), ["a", "b"], "left_anti")
        pairs = Kept(pairs, "pairs")
        for kept in scratch:
            kept.drop()
        if pairs.frame.isEmpty():
            pairs.drop()
            continue
        links.append(Kept(_confirmed(pairs.frame, sets.frame, percent), "links"))
        tested.append(pairs)
        component = connected(_union([l.frame for l in links]))
    if component is None:
        component = connected(links[0].frame)
    named = classes.frame.select("id", "key", "least").join(component.select(F.col("node").alias("id"), "component"), "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(smallest, "component").select("key", "component_id"), "components")
    for kept in (classes, members, sets, *links, *tested):
        kept.drop()
    out = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), component_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _live(members: DataFrame, component: DataFrame | None, scratch: list[Kept]) -> DataFrame:
    """Members with their components, of buckets that hold more than one."""
    if component is None:
        return members.withColumn("component", F.col("id"))
    named = members.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = _written(named, "named", scratch)
    several = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return _written(named.join(several.select("bucket"), "bucket", "left_semi"), "live", scratch)


def _written(df: DataFrame, name: str, scratch: list[Kept]) -> DataFrame:
    scratch.append(Kept(df, name))
    return scratch[-1].frame


def _stars(live: DataFrame, turn: int) -> DataFrame:
    """Each member with its bucket's hub, if it is in another component; the hub changes with the turn."""
    hub = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id", "n", "component"))
    hubs = live.groupBy("bucket").agg(hub.alias("hub"))
    return live.join(hubs, "bucket").where("component <> hub.component").select(
        F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"),
        F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"))


def _rest(live: DataFrame, sets: DataFrame, percent: int, scratch: list[Kept]) -> DataFrame:
    """All pairs of different components among the live classes that can still be similar enough.

    A group of copies with many edits shares buckets without being linked, so its buckets say little.  What
    tells its members apart are rare shingles: with the shingles of each set in the order of frequency, two
    sets of this similarity have one in common among their first ``n - ceil(n * percent / 100) + 1``, and what
    follows it must suffice for the overlap.  Both conditions are necessary, so no link is left out.
    """
    named = live.select("id", "component").distinct().join(sets, "id")

    def spell(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), i)), pa.array(np.full(len(found), len(found))), pa.array(found)], ["id", "n", "shingle"])

    spelled = arrow_map(named.select("id", "set"), "id long, n long, shingle long", spell)
    common = _written(spelled.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1"), "shingles", scratch)
    ordered = spelled.join(common, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")  # shingles of no other set come first
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    prefix = F.slice("shared", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int"))
    ordered = ordered.select("id", "n", alone.alias("alone"), prefix.alias("prefix"))
    ordered = ordered.withColumn("prefix", F.transform("prefix", lambda s: s["shingle"]))
    spots = ordered.select("id", "n", "alone", "prefix", F.posexplode("prefix").alias("at", "shingle")).select(
        "id", "n", (F.col("alone") + F.col("at") + 1).alias("at"), "shingle",
        F.slice("prefix", F.lit(1), F.least("at", F.lit(BEFORE))).alias("before"))
    spots = _written(spots.join(live.select("id", "component").distinct(), "id"), "spots", scratch)
    x, y = (spots.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("component", "id", "n", "at", "before")]) for s in "ab")
    enough = f"{100 + percent} * (1 + least(n_a - at_a, n_b - at_b)) >= {percent} * (n_a + n_b)"
    similar = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    once = "not arrays_overlap(before_a, before_b)"  # a pair is met at its first common shingle only, if that is an early one
    met = x.join(y, (x["shingle"] == y["shingle"]) & F.expr(
        f"id_a < id_b and component_a <> component_b and {enough} and {similar} and {once}"))
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``id, set``: the sorted hashes of one document of each wanted class (``id, key, least``)."""
    def gather(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        sets = [shingles(d, words).tobytes() for d in utf8(batch.column(2))]
        same = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(1).to_pylist())]
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])
        yield out.filter(pa.array(same))

    docs = docs.where("doc_id is not null")
    there, _ = split_by_keys(docs, [F.col("doc_id")], wanted, [F.col("least")])
    texts = wanted.join(there, F.col("least") == F.col("doc_id")).select("id", "key", "text")
    sets = arrow_map(texts, "id long, set binary", gather)
    return sets.groupBy("id").agg(F.first("set").alias("set"))  # rows of one id may repeat a text


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    def confirm(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a"))
    return arrow_map(both.select("a", "b", "set_a", "set_b"), "a long, b long", confirm)
