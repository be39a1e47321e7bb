import random
from collections import Counter, defaultdict

import pytest

from siltstone.llm import packing


def lengths(n, seed):
    rng = random.Random(seed)
    return [min(2048, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 500, 5000])
def test_plan_holds_every_item(n):
    h = Counter(lengths(n, n))
    groups = packing.plan(dict(h))
    held = Counter()
    for g in groups:
        assert g.gap == 2048 - sum(a * b for a, b in g.pattern) >= 0 and g.n > 0
        for length, items in g.pattern:
            held[length] += g.n * items
    assert held == h


def test_little_space_is_left():
    h = Counter(lengths(20_000, 9))
    used = sum(k * v for k, v in h.items())
    boxes = sum(g.n for g in packing.plan(dict(h)))
    assert boxes <= -(-used // 2048) * 1.002 + 1


def test_tiers_are_packed_apart_and_long_gaps_filled_from_shorter_ones():
    h = dict(Counter(lengths(3000, 4)))
    plans = {t: sorted((g.n, sorted(g.pattern)) for g in packing.plan(h, tiers=t)) for t in ((256, 512, 1024, 2048), (2048,), (7, 900, 2048))}
    assert len({repr(p) for p in plans.values()}) == 3
    own = packing.pack_tier({700: 5, 600: 4}, 1024, 2048)
    assert {x for g in own for x, _ in g.pattern} == {700, 600} and all(g.tier == 1024 for g in own)
    shorter = {200: 3, 30: 50}
    filled = packing.fill_gaps([packing.Group(2, 448, 2048, [(1600, 1)])], shorter)
    assert sum(g.n for g in filled) == 2 and all(g.gap < 30 for g in filled) and shorter.get(200, 0) == 0
    for g in packing.plan(h):
        tiers = [packing.tier_of(x, packing.TIERS) for x, _ in g.pattern]
        assert g.tier == max(tiers) and tiers == sorted(tiers, reverse=True)


def test_tiers_have_to_reach_the_capacity():
    for bad in ((), (256, 512)):
        with pytest.raises(ValueError):
            packing.plan({5: 1}, tiers=bad)


def test_check_finds_broken_packings(spark):
    sized = spark.createDataFrame([(1, 2000), (2, 48), (3, 0)], "doc_id long, n_tokens long")
    shape = "doc_id long, piece long, n_tokens long, container long, start long"
    report = lambda rows: {r.rule: r.n_broken for r in packing.violations(sized, spark.createDataFrame(rows, shape)).collect()}
    good = [(1, 0, 2000, 0, 0), (2, 0, 48, 0, 2000), (3, 0, 0, None, None)]
    assert set(report(good).values()) == {0}
    assert report([(1, 0, 2000, 0, 0), (2, 0, 48, 0, 1990), (3, 0, 0, None, None)])["contiguity"] == 1
    assert report([(1, 0, 2000, 0, 0), (2, 0, 48, 0, 2001), (3, 0, 0, None, None)])["capacity"] == 1
    assert report([(1, 0, 2000, 0, 0), (3, 0, 0, None, None)])["coverage"] == 1
    assert report([(1, 0, 1000, 0, 0), (1, 1, 1000, 0, 1000), (2, 0, 48, 2, 0), (3, 0, 0, None, None)])["whole"] == 1
    assert report([(1, 0, 2000, 0, 0), (2, 0, 48, 2, 0), (3, 0, 0, None, None)])["numbering"] == 1


def test_plan_is_bounded_by_lengths_not_items():
    h = {k: 10**9 + k for k in range(1, 2049)}
    groups = packing.plan(h)
    assert len(groups) < 4 * 2048
    assert sum(g.n * k * x for g in groups for x, k in g.pattern) == sum(k * v for k, v in h.items())


def test_equal_lengths_and_bad_ones():
    assert [(g.n, g.pattern) for g in packing.plan({1024: 5})] and sum(g.n for g in packing.plan({1024: 5})) == 3
    assert sum(g.n for g in packing.plan({1025: 3})) == 3
    for bad in (0, 2049):
        with pytest.raises(ValueError):
            packing.plan({bad: 1})


def test_packed_table(spark):
    sizes = [(i, n, "x") for i, n in enumerate([*lengths(700, 2), *[300] * 400, 5000, 2048, 4096, 0])] + [(9999, None, "x"), (5, 77, "twin")]
    items = packing.pieces(spark.createDataFrame(sizes, "doc_id long, n_tokens long, container string")).cache()
    packed = packing.pack(items, step_containers=4).collect()
    assert len(packed) == items.count()
    per = defaultdict(list)
    steps = defaultdict(dict)
    by_doc = Counter()
    for r in packed:
        by_doc[r.doc_id] += r.n_tokens
        if r.n_tokens == 0:
            assert r.container is None and r.start is None and r.tier is None
            continue
        per[r.container].append((r.start, r.start + r.n_tokens))
        steps[r.step_group][r.container] = steps[r.step_group].get(r.container, 0) + r.n_tokens**2
        assert r.context >= r.tier >= r.n_tokens and (r.tier == 256 or r.tier // 2 < r.n_tokens)
    want = Counter()
    for d, n, _ in sizes:
        want[d] += n or 0
    assert by_doc == want
    for spans in per.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(per) == list(range(len(per)))
    assert all(len(c) <= 4 for c in steps.values())
    costs = [sum(c.values()) for c in steps.values() if len(c) == 4]
    assert max(costs) < 1.5 * min(costs)
    used = sum(want.values())
    assert len(per) <= -(-used // 2048) + 3


def test_pieces(spark):
    df = spark.createDataFrame([(1, 4096), (2, 4097), (3, 0), (4, None), (5, 1)], "doc_id long, n_tokens long")
    got = sorted(map(tuple, packing.pieces(df).collect()))
    assert got == [(1, 0, 2048), (1, 1, 2048), (2, 0, 2048), (2, 1, 2048), (2, 2, 1), (3, 0, 0), (4, 0, 0), (5, 0, 1)]


def test_empty(spark):
    items = packing.pieces(spark.createDataFrame([], "doc_id long, n_tokens long"))
    assert packing.pack(items).count() == 0
