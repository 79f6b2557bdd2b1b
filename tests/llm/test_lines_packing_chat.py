"""Line dedup, packing and chat formatting against plain Python versions."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frames import frame  # noqa: F401
from tabforge.llm.chat import format_preferences, gather_turns
from tabforge.llm.lines import dedup_lines, windows
from tabforge.llm.packing import GROUP_PIECES, best_pack, pack_documents
from tabforge.llm.queries import PACK_LENGTHS, op9_best_fit_packing


def brute_lines(docs, words):
    """Delete every line that lies in a run of so many words which occurred at an earlier place."""
    lines = {i: (t or "").split("\n") for i, t in docs}
    order = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))]
    places = defaultdict(list)
    for i, k in order:
        places[lines[i][k]].append((i, k))
    gone = set()
    for i, k in order:
        for j, m in places[lines[i][k]]:
            if (j, m) >= (i, k):
                break
            n = 0
            while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n]:
                n += 1
                if sum(len(x.split()) for x in lines[i][k:k + n]) >= words:
                    gone.update((i, x) for x in range(k, k + n))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(lines[i]) if (i, k) not in gone) for i, t in docs}


def test_lines_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()], 50)
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    got = {r.doc_id: r.text for r in got.collect()}
    assert got == want
    assert sum(map(len, want.values())) < docs.agg(F.sum(F.length("text"))).first()[0]


def test_lines_small_runs_against_brute_force(spark, frame):
    import random
    r = random.Random(5)
    docs = [(i, "\n".join(" ".join("ab"[r.randrange(2)] * r.randrange(1, 3) for _ in range(r.randrange(0, 4)))
                          for _ in range(r.randrange(0, 14)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, "a b c d e f\n" * 30)]
    got = dedup_lines(frame(docs), words=6)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs, 6)


def test_lines_edges(spark, frame):
    long = "one two three four five six"
    docs = [(None, long), (7, long), (7, long), (9, long + "\nrest")]
    got = sorted((repr(r.doc_id), r.text) for r in dedup_lines(frame(docs), words=6).collect())
    assert got == [("7", long), ("7", long), ("9", "rest"), ("None", "")]
    assert dedup_lines(frame(docs).limit(0)).count() == 0


def test_windows_cover_runs():
    lines = [b"a " * n for n in (30, 10, 30, 0, 60, 5)]
    _, found = windows(lines, 50)
    assert found == [(0, 2), (1, 4), (2, 4), (3, 4), (4, 4), (4, 5)] or set(found) >= {(0, 2), (4, 4), (4, 5)}


def brute_pack(sizes, lengths, overhead, opened=None):
    """Cost of best fit by scanning all open bins; a bin's length is fixed, or tried by filling it with the pieces left."""
    cost = lambda n: min(m for m in lengths if m >= n) + overhead
    bins, left = [], sorted(sizes, reverse=True)
    while left:
        size = left[0]
        fits = [b for b in bins if b[0] >= size]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            prices = {}
            for n in (n for n in lengths if n >= size):
                tokens = 0
                for x in left:
                    tokens += x if tokens + x <= n else 0
                prices[n] = cost(tokens) / tokens
            b = [min(prices, key=prices.get) if opened is None else max(opened, min(prices)), 0]
            bins.append(b)
        b[0] -= size
        b[1] += size
        left.pop(0)
    return sum(cost(b[1]) for b in bins)


def test_best_pack_cost():
    import random
    r = random.Random(1)
    lengths = [8, 16, 32]
    chosen = 0
    for _ in range(200):
        sizes = [r.randrange(1, 33) for _ in range(r.randrange(1, 60))]
        found = best_pack(sizes, lengths, lambda n: n + 3)
        total = sum({b: n + 3 for b, _, n in found}.values())
        joint, *single = [brute_pack(sizes, lengths, 3, n) for n in (None, *lengths)]
        assert total == min(joint, *single)
        chosen += joint < min(single)
    assert chosen > 0


def test_packing_of_whole_documents(spark):
    """The query's plan over a whole table: every token once, bins without gaps, each group's cost that of the plain version."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = {r.doc_id: r.n for r in docs.selectExpr("doc_id", "octet_length(coalesce(text, '')) + 1 as n").collect()}
    out = op9_best_fit_packing(spark, "/root/testdata/sf0.001").toPandas()
    assert out.groupby("doc_id")["size"].sum().to_dict() == sizes
    pieces = out.sort_values(["doc_id", "piece"])
    assert (pieces["start"] == pieces.groupby("doc_id")["size"].cumsum() - pieces["size"]).all()
    inside = out.sort_values(["bin_id", "offset"])
    assert (inside["offset"] == inside.groupby("bin_id")["size"].cumsum() - inside["size"]).all()
    bins = out.groupby("bin_id").agg(used=("size", "sum"), least=("bin_length", "min"), length=("bin_length", "max"))
    assert (bins["least"] == bins["length"]).all()
    assert (bins["length"] == bins["used"].map(lambda n: min(m for m in PACK_LENGTHS if m >= n))).all()
    assert len(out) <= GROUP_PIECES  # one group, so one plain packing
    assert (bins["length"] + 64).sum() == min(brute_pack(list(out["size"]), PACK_LENGTHS, 64, n) for n in (None, *PACK_LENGTHS))


@pytest.mark.parametrize("group", [5, 1000])
def test_pack_documents(spark, frame, group):
    docs = [(i, "x" * n) for i, n in enumerate([0, 1, 5, 8, 9, 16, 17, 33, 100, 31, 2, 2, 2])] + [(None, "abc"), (50, None), (2, "x" * 5)]
    sized = frame(docs).withColumn("n", F.length("text")).withColumn("offset", F.lit("clash"))
    out = pack_documents(sized, [32, 8, 16], "n", group_pieces=group).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at and r.bin_length == rows[0].bin_length
            at += r["size"]
        assert rows[0].bin_length == min(n for n in (8, 16, 32) if n >= at)
    assert sum(r["size"] for r in out) == sum(len(t or "") for _, t in docs)
    assert sorted((r.piece, r.start, r["size"]) for r in pieces[8]) == [(0, 0, 32), (1, 32, 32), (2, 64, 32), (3, 96, 4)]
    assert len(pieces[2]) == 2 and 50 not in pieces and 0 not in pieces
    again = pack_documents(sized.repartition(7), [32, 8, 16], "n", group_pieces=group).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert pack_documents(sized.limit(0), [8], "n").count() == 0


def test_chat(spark):
    turns = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [u, a], None), (4, [u], [u, a]), (5, [a, u, a], [b]), (6, [], []),
            (7, None, None), (7, [u, ("assistant", None)], [u, a])]
    df = spark.createDataFrame(rows, f"pair_id int, chosen {turns}, rejected {turns}").selectExpr("*", "1 as n", "2 as prompt", "3 as status")
    got = {(r.pair_id, r.status): r for r in format_preferences(df).collect()}
    one = got[1, "pair"]
    assert (one.n_prompt_turns, one.prompt, one.chosen, one.rejected) == (
        1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n")
    assert [one.chosen[s.first:s.last] for s in one.chosen_spans] == ["yes<|end|>"]
    assert {k for k in got} >= {(2, "same"), (3, "missing"), (4, "no_loss"), (5, "pair"), (6, "same"), (7, "missing")}
    assert got[5, "pair"].n_prompt_turns == 0 and [
        got[5, "pair"].chosen[s.first:s.last] for s in got[5, "pair"].chosen_spans] == ["yes<|end|>"] * 2
    assert got[4, "no_loss"].prompt.endswith("hi<|end|>\n") and got[4, "no_loss"].chosen == ""
    assert format_preferences(df.limit(0)).count() == 0


def test_turns_are_ordered(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "z"), (1, None, "system", "s")]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in gather_turns(
        spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {1: [("system", "s"), ("user", ""), ("assistant", "b")], None: [("", "z")]}
