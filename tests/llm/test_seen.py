import random

import numpy as np
import pytest

from siltstone.llm import seen

KEYS = "key binary, first_id string"
INCOMING = "incoming_id long, key binary, seen string"


def hashes(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, n)


@pytest.mark.parametrize("target", [0.1, 0.01, 0.001])
def test_error_stays_near_the_target(target):
    bloom = seen.BlockedBloom(50_000, target)
    a, b = hashes(50_000)
    bloom.insert(a, b)
    assert bloom.contains(a, b).all()
    c, d = hashes(100_000, 1)
    assert bloom.contains(c, d).mean() < 1.5 * target


def test_query_then_insert_is_sequential():
    rng = np.random.default_rng(4)
    a, b = (x[rng.integers(0, 300, 2000)] for x in hashes(300))
    whole, single = seen.BlockedBloom(60, 0.1), seen.BlockedBloom(60, 0.1)
    got = np.concatenate([whole.query_then_insert(a[i : i + 700], b[i : i + 700]) for i in range(0, 2000, 700)])
    want = [bool(single.query_then_insert(a[i : i + 1], b[i : i + 1])[0]) for i in range(2000)]
    assert got.tolist() == want and (whole.words == single.words).all()


def answered(spark, earlier, incoming, per_filter=None, measure=False):
    rows = seen.keyed_rows(spark.createDataFrame(earlier, KEYS), spark.createDataFrame(incoming, INCOMING)).cache()
    return rows, seen.bloom_answers(rows, seen.absent_keys(rows) if measure else None, keys_per_filter=per_filter).cache()


def run(spark, earlier, incoming, per_filter=None):
    got = [r[0] for r in seen.seen_before(*answered(spark, earlier, incoming, per_filter)).collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def brute(earlier, incoming):
    old, out = {k for k, _ in earlier if k is not None}, set()
    for i, k, _ in incoming:
        if i is not None and k is not None and (k in old or any(j is not None and j < i and x == k for j, x, _ in incoming)):
            out.add(i)
    return sorted(out)


@pytest.mark.parametrize("per_filter", [None, 2])  # an overfull filter answers yes to all, and the check removes what is wrong
def test_same_as_brute_force(spark, per_filter):
    rng = random.Random(1)
    key = lambda: b"hot" if rng.random() < 0.3 else bytes(rng.choices(b"abc", k=rng.randrange(5)))
    earlier = [(key(), "x") for _ in range(40)] + [(None, None), (b"x" * 100_000, None)]
    incoming = [(i, key() + rng.choice([b"", b"\0"]), "x") for i in range(120)]
    incoming += incoming[:30] + [(500, None, None), (None, b"a", None), (501, b"x" * 100_000, None), (502, b"", None)]
    rng.shuffle(incoming)
    assert run(spark, earlier, incoming, per_filter) == brute(earlier, incoming)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [(2, b"a", None), (1, b"a", None)]) == [2]
    assert run(spark, [(b"a", None)], []) == []


def test_filters_answer_second_arrivals(spark):
    keys = [i.to_bytes(4, "big") for i in range(400)]
    incoming = [(i, keys[i % 400], None) for i in range(800)]
    one = spark.createDataFrame(incoming, INCOMING).repartition(8, "incoming_id")
    rows = seen.keyed_rows(spark.createDataFrame([(k, None) for k in keys[:100]], KEYS), one).cache()
    answers = {r.id: r.seen for r in seen.bloom_answers(rows).collect()}
    repeats = {r.id for r in rows.filter(f"phase = {seen.REPEAT}").collect()}
    assert len(answers) + len(repeats) == 800 and len(answers) > 500
    assert all(answers[i] for i in answers if i % 400 < 100 or i >= 400)
    assert sum(answers[i] for i in range(100, 400)) < 30


def test_a_hot_key_comes_to_few_rows(spark):
    hot = spark.range(60_000).selectExpr("cast(if(id % 3 = 0, 'hot', concat('k', id)) as binary) key", "id incoming_id").coalesce(2)
    rows = seen.keyed_rows(hot, hot)
    n = {r.phase: r.n for r in rows.filter("key = cast('hot' as binary)").groupBy("phase").agg({"*": "count"}).toDF("phase", "n").collect()}
    assert n[seen.EARLIER] <= 2 and n[seen.ARRIVAL] <= 2
    assert rows.filter(f"phase = {seen.REPEAT}").count() == 20_000 - n[seen.ARRIVAL]


def test_measured_error(spark):
    earlier = [(i.to_bytes(4, "big"), None) for i in range(4000)]
    rows, answers = answered(spark, earlier, [(i, (i + 3000).to_bytes(4, "big"), None) for i in range(3000)], measure=True)
    row = seen.error_rate(rows, answers).first()
    assert row.n_probes == 6000 and row.rate == row.n_wrong / 6000 < 0.02
    assert row.n_new == 2000 and row.new_rate == row.n_new_wrong / 2000 < 0.02
    none = seen.error_rate(*answered(spark, [], [])).first()
    assert none.n_probes == 0 and none.rate is None and none.new_rate is None


def test_filters_go_on_from_run_to_run(spark, tmp_path):
    key = lambda i: i.to_bytes(4, "big")
    rows = lambda old, new: seen.keyed_rows(spark.createDataFrame([(key(i), None) for i in old], KEYS), spark.createDataFrame([(n, key(i), None) for n, i in enumerate(new)], INCOMING)).cache()
    kept = lambda: seen.KeptFilters(spark, str(tmp_path), 4000)
    told = lambda df: sorted((r.id, r.seen) for r in df.collect())
    assert kept().load() == 0
    first = told(kept().answer(rows(range(1000), range(900, 1500)), "day 1"))
    assert all(x for n, x in first if n < 100) and sum(x for n, x in first if n >= 100) < 20
    day2 = rows([], [*range(1400, 1600), 5, 3000])
    second = told(kept().answer(day2, "day 2"))
    assert all(x for n, x in second if n < 100 or n == 200) and sum(x for n, x in second if n >= 100) < 20
    assert told(kept().answer(day2, "day 2")) == second  # repeated after it was published
    third = told(kept().answer(rows([], [3000, 1599, 0, 9999]), "day 3"))
    assert [x for _, x in third][:3] == [True] * 3
    assert 0.05 < kept().load() < 0.5
    assert kept().versions.current() == 3
