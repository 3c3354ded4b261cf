"""Board changes settled in rounds, against the changes taken one after the other."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanwork.operators import boards as B

T0 = datetime(2024, 1, 1)
BOARDS = "id string, name string, url string, type string, active boolean, created_at timestamp, updated_at timestamp"
CHANGES = "seq long, op string, id string, name string, url string, type string, active boolean"


def one_by_one(boards, changes):
    """The rule as written: look at all boards there are, then take or refuse the change."""
    held, refused = {b[0]: b[1:5] for b in boards}, {}
    for seq, op, id_, name, url, kind, active in sorted(changes):
        others = [b for i, b in held.items() if i != id_]
        clash = any(b[0] == name or b[1] == url for b in others)
        blank = not (name or "").strip() or not (url or "").strip()
        why = None
        if op == "create":
            why = "unknown_type" if kind not in ("api", "html_crawl") else "blank" if blank else "duplicate" if clash or id_ in held else None
        elif op == "update":
            why = "blank" if blank else "not_found" if id_ not in held else None
            why = why or ("type_is_fixed" if kind not in (None, held[id_][2]) else "duplicate" if clash else None)
        elif id_ not in held:
            why = "not_found"
        if why:
            refused[seq] = why
        elif op == "delete":
            del held[id_]
        else:
            was = held.get(id_, (None, None, kind, None))
            held[id_] = (name, url, was[2], active if active is not None else True if was[3] is None else was[3])
    return held, refused


def settled(spark, boards, changes):
    frames = spark.createDataFrame(boards, BOARDS), spark.createDataFrame(changes, CHANGES)
    merged, refused = B.apply_board_changes(*frames, F.lit(T0))
    assert merged.columns == list(B.BOARD_COLUMNS)
    return {r.id: (r.name, r.url, r.type, r.active) for r in merged.collect()}, {r.seq: r.refusal for r in refused.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_give_what_the_order_gives(spark, seed):
    draw = random.Random(seed)
    boards = [(f"b{i}", f"name{i}", f"u{i}", "api", True, T0, T0) for i in range(12)]
    changes = [
        (seq, draw.choice(["create", "update", "update", "delete"]), f"b{draw.randrange(20)}", draw.choice([f"name{draw.randrange(20)}", "hot", "hot", " "]),
         f"u{draw.randrange(25)}", draw.choice(["api", "api", None, "html_crawl", "other"]), draw.choice([True, False, None]))
        for seq in range(90)
    ]
    assert settled(spark, boards, changes) == one_by_one(boards, changes)


def test_a_name_that_half_of_all_changes_want(spark, monkeypatch):
    """It takes as many rounds as the name changes hands, not as many as want it."""
    boards = [(f"b{i}", f"name{i}", f"u{i}", "api", True, T0, T0) for i in range(400)]
    changes = [(i, "update", f"b{i}", "hot" if i % 2 else f"new{i}", f"u{i}", None, None) for i in range(400)]
    changes += [(1000, "delete", "b1", None, None, None, None), (1001, "create", "c", "hot", "c", "api", None)]
    changes += [(1002 + i, "create", f"d{i}", "hot", f"d{i}", "api", None) for i in range(300)]
    rounds = []
    judged = B._judged
    monkeypatch.setattr(B, "_judged", lambda *a: rounds.append(1) or judged(*a))
    assert settled(spark, boards, changes) == one_by_one(boards, changes)
    assert len(rounds) <= 6


def test_changes_without_ids(spark):
    changes = [
        (1, "create", None, "a", "a", "api", None), (2, "create", None, "b", "b", "api", None), (3, "create", None, "a", "c", "api", None),
        (4, "update", None, "d", "d", None, None), (5, "delete", None, None, None, None, None),
    ]
    held, refused = settled(spark, [], changes)
    assert sorted(b[0] for b in held.values()) == ["a", "b"] and None not in held
    assert refused == {3: "duplicate", 4: "not_found", 5: "not_found"}


def test_a_lookup_that_is_no_broadcast_is_replicated_for_hot_keys_alone(spark, monkeypatch):
    """The salted lookup was copied 64 times for every key and then broadcast by its size before that."""
    from gleanwork.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    keys = [1] * 50 + [None] * 50 + [2, 3, 3, 9]
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")], "k int, v string")
    held = {1: "a", 2: "b", 3: "c"}
    joined = joins.lookup_join(big, small, ["k"], "left", ["i"], False)
    assert joined.columns == ["k", "i", "v"]
    assert sorted((r["i"], r["k"], r["v"]) for r in joined.collect()) == [(i, k, held.get(k)) for i, k in enumerate(keys)]
    assert "SortMergeJoin [k" in joined._jdf.queryExecution().executedPlan().toString()
    for how, kept in (("inner", [k in held for k in keys]), ("left_semi", [k in held for k in keys]), ("left_anti", [k not in held for k in keys])):
        found = joins.lookup_join(big, small, ["k"], how, ["i"], False)
        assert sorted(r["i"] for r in found.collect()) == [i for i, keep in enumerate(kept) if keep]
