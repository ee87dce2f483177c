"""Packing by classes of equal size against packing row by row."""

import random

import pytest

from factloom.operators import inference as inf
from factloom.operators.numbering import number_rows
from factloom.operators.packing import SizeClass, carry, dynamic_batches


def greedy(sizes, most):
    batch, held, numbers = 0, 0, []
    for n in sorted(sizes):
        if held and held + n > most:
            batch, held = batch + 1, 0
        held += n
        numbers.append((n, batch))
    longest = {}
    for n, b in numbers:
        longest[b] = n
    return [(n, b, longest[b]) for n, b in numbers]


def by_classes(sizes, most):
    known = sorted({min(n, most + 1) for n in sizes})
    classes = [SizeClass(min(n for n in sizes if min(n, most + 1) == k), sum(min(n, most + 1) == k for n in sizes)) for k in known]
    longest = carry(classes, most)
    out = []
    for at, n in enumerate(sorted(sizes)):
        c = classes[known.index(min(n, most + 1))]
        place = at - c.before
        b = c.batch if place < c.joined else c.batch + 1 + (place - c.joined) // c.each
        out.append((n, b, n if n > most else longest[b] if b in (c.batch, c.last) else n))
    return out


def test_carry_is_greedy():
    rng = random.Random(3)
    for _ in range(3000):
        most = rng.randrange(1, 40)
        sizes = [rng.choice((0, 1, rng.randrange(0, 9), rng.randrange(0, 60))) for _ in range(rng.randrange(1, 60))]
        assert by_classes(sizes, most) == greedy(sizes, most), (sizes, most)


@pytest.mark.parametrize("most", [1, 7, 200, 100_000])
def test_frame(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice((0, 3, 3, 3, rng.randrange(400))), i % 4, "x") for i in range(700)]
    df = spark.createDataFrame(rows, "id int, n int, __size int, at string").repartition(9)
    got = dynamic_batches(df, "n", ["id"], most, cap=10**9).collect()
    found = sorted((r.n, r.id, r.batch, r.max_new_tokens) for r in got)
    want = greedy([r[1] for r in rows], most)
    assert [(n, b) for n, _, b, _ in found] == [(n, b) for n, b, _ in want]
    assert [m for *_, m in found] == [int(longest * 1.3) for *_, longest in want]
    # The caller's columns stay as they are, whatever their names.
    assert {(r.id, r["__size"], r["at"]) for r in got} == {(r[0], r[2], r[3]) for r in rows}


def test_nulls_empty_and_limit(spark):
    rows = [(1, None), (2, -5), (3, 9), (4, 8), (5, 2)]
    got = {r.id: (r.batch, r.max_new_tokens) for r in dynamic_batches(spark.createDataFrame(rows, "id int, n int"), "n", ["id"], 10).collect()}
    assert got == {1: (0, 10), 2: (0, 10), 5: (0, 10), 4: (0, 10), 3: (1, 11)}
    assert dynamic_batches(spark.createDataFrame([], "id int, n int"), "n", ["id"], 10).collect() == []
    with pytest.raises(ValueError):
        dynamic_batches(spark.createDataFrame(rows, "id int, n int"), "n", ["id"], 0)


def test_ties_are_split(spark):
    """Rows that tie on the whole order, nulls too, don't meet in one task, and helper columns don't touch the caller's."""
    df = spark.createDataFrame([(None, i) for i in range(4000)], "k int, __at int").repartition(4)
    got = number_rows(df, ["k"])
    assert sorted(r.rn for r in got.collect()) == list(range(1, 4001))
    assert sorted(r["__at"] for r in got.collect()) == list(range(4000))
    assert max(len(p) for p in got.rdd.glom().collect()) < 3000


def test_null_prompt_fails_alone(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "uid string, prompt string")
    got = {r.uid: r for r in inf.infer(df, inf.stub_provider, inf.Calls(1e9, 1e9, partitions=1)).collect()}
    assert got["a"].status == "ok" and got["b"].status == "failed" and got["b"].errors == ["no prompt"] and got["b"].attempts == 0
