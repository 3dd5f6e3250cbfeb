"""Pieces that many benchmark items share: the same findings as item by item, in time."""

import random
import time

import pytest

from tidewater.llm import decontam as D


def templated(seed, share, n, length=16):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    head, tail = ([word() for _ in range(k)] for k in (share, share // 2))
    items = [(i, " ".join(head + [word() for _ in range(r.randint(3, length))] + tail * (i % 2))) for i in range(n)]
    return r, " ".join(head), items, word


def changed(r, t, n):
    t = list(t)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + 1] = r.choice([[], ["q"], [t[i], "q"]])
    return "".join(t)


@pytest.mark.parametrize("share", [2, 5, 9, 14])
def test_same_findings_as_item_by_item(monkeypatch, share):
    r, head, items, word = templated(share, share, 60)
    items += [(1000 + i, t) for i, t in items[:3]] + [(2000, "short one"), (2001, head)]
    for stretch in (D.STRETCH, 300):
        monkeypatch.setattr(D, "STRETCH", stretch)
        for k in range(12):
            parts = [head + " " + word() for _ in range(r.randint(1, 30))]
            parts += [changed(r, r.choice(items)[1], r.randint(0, 9)) for _ in range(4)]
            r.shuffle(parts)
            text = " ".join(parts)
            got = D.Benchmark(items).search(text)
            with monkeypatch.context() as m:
                m.setattr(D, "WIDE", 10**9)
                assert sorted(got) == sorted(D.Benchmark(items).search(text))
            if k == 0:
                # Against the full table: the least distance of every item to any part of the text.
                least = {i: D.myers(t, D.normalise(text))[0] for i, t in items if int(D.RATE * len(t))}
                assert {i: d for i, d, _, _ in got if i in least} == {i: d for i, d in least.items() if d <= int(D.RATE * len(dict(items)[i]))}


def test_two_thousand_items_with_one_beginning():
    for share in (4, 9, 14):
        r, head, items, word = templated(share, share, 2000, 6)
        bench = D.Benchmark(items)
        text = " ".join(head + " " + word() for _ in range(5000 // len(head))) + " " + items[7][1]
        began = time.perf_counter()
        found = bench.search(text)
        took = time.perf_counter() - began
        assert (7, 0) in [f[:2] for f in found] and took < 3, took
