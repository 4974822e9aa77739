"""Synthetic similarity tables by the published recipes."""

import random


def _value(rnd, mean, std):
    return round(min(max(rnd.gauss(mean, std), 0.990), 0.999999), 6)


def shared_pairs():
    """Six haplotypes, 500 windows, two planted shared segments."""
    rnd = random.Random(42)
    haps = ["SIM1#1", "SIM1#2", "SIM2#1", "SIM2#2", "SIM3#1", "SIM3#2"]
    planted = {("SIM1#1", "SIM2#1"): range(125, 375), ("SIM1#2", "SIM3#1"): range(50, 200)}
    rows = []
    for w in range(500):
        for i in range(6):
            for j in range(i + 1, 6):
                inside = w in planted.get((haps[i], haps[j]), ())
                x = _value(rnd, 0.99995, 0.00005) if inside else _value(rnd, 0.998, 0.0003)
                rows.append(("CHM13#0#chr12", w * 10_000, (w + 1) * 10_000, haps[i], haps[j], x))
    return rows


def mosaic():
    """Four founders and a child that has a quarter of each."""
    rnd = random.Random(42)
    haps = ["GP1", "GP2", "GP3", "GP4", "CHILD"]
    rows = []
    for w in range(500):
        for i in range(5):
            for j in range(i + 1, 5):
                inside = j == 4 and i == w // 125
                x = _value(rnd, 0.99995, 0.00005) if inside else _value(rnd, 0.998, 0.0003)
                rows.append(("CHM13#0#chr12", w * 10_000, (w + 1) * 10_000, haps[i], haps[j], x))
    return rows
