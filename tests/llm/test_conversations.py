from __future__ import annotations

import random

from terravane.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def brute(rows):
    of = {}
    for conv, turn, role, text, _ in set(rows):
        of.setdefault(conv, []).append((turn is None, turn or 0, role is not None, role or "", text is not None, text or ""))
    lines = {c: [(r[3] if r[2] else None, r[5] if r[4] else None) for r in sorted(x)] for c, x in of.items()}
    kept = {}
    for c, mine in lines.items():
        order = lambda x: (x is None, x or 0)
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in lines.values())
        copy = any(o == mine and order(k) < order(c) for k, o in lines.items())
        if not longer and not copy:
            kept[c] = len(mine)
    return kept


def got(spark, rows):
    return C.collapse(spark.createDataFrame(rows, SCHEMA)).collect()


def test_snapshots_copies_and_nulls(spark):
    a = [("user", "hi"), ("assistant", None), ("user", ""), (None, "x")]
    rows = []
    for conv, n in ((5, 4), (1, 1), (2, 2), (3, 3), (4, 4), (None, 4)):
        rows += [(conv, t, role, text, "z") for t, (role, text) in enumerate(a[:n])]
    rows += [(9, 0, "user", "hi", "z"), (9, 1, "assistant", "", "z")]  # null isn't empty
    rows += rows[:3]
    found = got(spark, rows)
    assert {r.conv_id: r.n_turns for r in found} == brute(rows) == {4: 4, 9: 2}
    assert next(r.text for r in found if r.conv_id == 9) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def test_long_conversations_in_parts(spark):
    rows = [(1, t, "user", f"line {t}", None) for t in range(1000)] + [(2, t, "user", f"line {t}", None) for t in range(1001)] + [(3, t, "user", f"line {t % 999}", None) for t in range(1000)]
    found = got(spark, rows)
    assert {r.conv_id for r in found} == {2, 3}
    text = "".join(r.text for r in sorted((r for r in found if r.conv_id == 2), key=lambda r: r.part))
    assert text == "".join(f"<|im_start|>user\nline {t}<|im_end|>\n" for t in range(1001))
    assert sorted(r.part for r in found if r.conv_id == 2) == [0, 1, 2, 3]


def test_random_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(120):
        base, n = rng.randint(0, 5), rng.randint(1, 6)
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", f"{base}-{t if t < 4 else rng.randint(0, 1)}", None) for t in range(n)]
    rng.shuffle(rows)
    assert {r.conv_id: r.n_turns for r in got(spark, rows)} == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
