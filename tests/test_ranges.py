"""Interval algebra with one key's intervals in many tasks, against the plain form."""

import random

import pytest

from speechframe.operators import intervals as I


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def turns(spark, rows):
    return spark.createDataFrame(rows, "meeting_id string, speaker string, start long, end long")


def made(seed, n, span, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(0, span)
        # one meeting holds nearly all; a few turns span very much, some are empty or upside down
        size = rng.choice([0, -1, rng.randint(0, longest), rng.randint(0, longest), span if i % 97 == 0 else 1])
        out.append(("m" if i % 20 else rng.choice(["n", "o"]), f"S{rng.randint(0, 2)}", start, start + size))
    return out


@pytest.mark.parametrize(("n", "span", "longest"), [(400, 3000, 12), (400, 100, 3), (300, 30_000, 5)])
def test_ranges_give_the_rows_of_the_plain_form(spark, n, span, longest):
    t = turns(spark, made(n + span, n, span, longest)).cache()
    assert rows_of(I.union_intervals(t, ["meeting_id", "speaker"], 7)) == rows_of(I.union_intervals(t, ["meeting_id", "speaker"]))
    assert rows_of(I.clean_intervals(t, 7)) == rows_of(I.clean_intervals(t))
    keep, remove = t.where("speaker = 'S0'"), t.where("speaker <> 'S0' AND end - start < 50")
    assert rows_of(I.subtract_intervals(keep, remove, ["meeting_id"], 5)) == rows_of(I.subtract_intervals(keep, remove, ["meeting_id"]))


def test_one_meeting_spreads_over_tasks(spark):
    t = turns(spark, [("m", f"S{i % 3}", 10 * i, 10 * i + 6 + 9 * (i % 7 == 0)) for i in range(4000)])
    d = I._ranged(t, ["meeting_id"], ["start"], 8)
    assert d.groupBy("__range").count().agg({"count": "max"}).first()[0] < 4000 / 8 * 2.5
    assert rows_of(I.clean_intervals(t, 8)) == rows_of(I.clean_intervals(t))


def test_empty(spark):
    assert I.clean_intervals(turns(spark, []), 4).count() == 0 and I.union_intervals(turns(spark, []), ["meeting_id"], 4).count() == 0
