"""Maintenance operators against plain Python."""

import random

import pytest

from pricetide.plans import maintain as M

FLYERS = "flyer_id long, merchant string, valid_from string, valid_to string, is_trusted boolean"


def overlapping(flyers, live):
    out = set()
    for i, merchant, start, end, trusted in flyers:
        for j, name, begin, stop, _ in live:
            if trusted is False and merchant is not None and name is not None and i != j and name.lower() in merchant.lower():
                if not ((end or "")[:10] < (begin or "")[:10] or (start or "")[:10] > (stop or "")[:10]):
                    out.add(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_superseded_circulars_equal_the_pairwise_rule(spark, seed):
    """Names inside names, missing and inverted days, circulars that are old and live at once, one merchant with most rows."""
    draw = random.Random(seed)
    names = ["Giant"] * 6 + ["Giant Food", "giant", "Tom Thumb", "Thumb", "", None, "Great Giant Food Mart"]
    day = lambda: draw.choice([None, "", *(f"2026-0{draw.randint(1, 4)}-{draw.randint(10, 28)}T00:00:00" for _ in range(12))])

    def row(i):
        a, b = day(), day()
        if draw.random() < 0.8 and a and b:
            a, b = min(a, b), max(a, b)
        return (i, draw.choice(names), a, a if draw.random() < 0.4 else b, draw.choice([True, False, False, None]))

    flyers = [row(i) for i in range(120)]
    live = draw.sample(flyers, 6) + [row(1000 + i) for i in range(draw.choice([0, 3, 8]))]
    mk = spark.createDataFrame
    got = {r.flyer_id for r in M.superseded_flyers(mk(flyers, FLYERS), mk(live, FLYERS)).collect()}
    assert got == overlapping(flyers, live) and got
    assert M.superseded_flyers(mk(flyers, FLYERS), mk([], FLYERS)).count() == 0
