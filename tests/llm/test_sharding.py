import itertools
import os
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from gleanwork.llm import sharding
from gleanwork.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 2), (1, 3)])
def test_curve_visits_each_cell_once_in_single_steps(spark, axes, bits):
    names = [f"x{i}" for i in range(axes)]
    cells = list(itertools.product(range(1 << bits), repeat=axes))
    frame = spark.createDataFrame([(*c, *c) for c in cells], ", ".join(f"{n} int" for n in [*names, *(f"c{i}" for i in range(axes))]))
    found = {r.curve: tuple(r[f"c{i}"] for i in range(axes)) for r in sharding.hilbert_index(frame, names, bits, "curve").collect()}
    assert sorted(found) == list(range(len(cells)))
    for a, b in itertools.pairwise(found[i] for i in range(len(cells))):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_levels_hold_equal_shares(spark):
    rows = [(v,) for v in [None] * 10 + [1] * 30 + [2] * 5 + [3] * 35]
    found = {r.value: r.level for r in sharding.levels(spark.createDataFrame(rows, "v int"), "v", 3, 80).collect()}
    assert found == {None: 0, 1: 1, 2: 4, 3: 4}


@pytest.mark.parametrize("weight", [None, "w"])
def test_places_over_many_partitions(spark, weight):
    rows = spark.range(2000).selectExpr("id % 37 as a", "id as b", "id % 5 as w")
    found = sharding.placed(rows.repartition(7), ["a", "b"], weight).collect()
    total = 0
    for r in sorted(found, key=lambda r: (r.a, r.b)):
        assert r["rank"] == total
        total += r.w if weight else 1


def test_query(spark):
    problem, rows, _ = compare(spark, connect(SF), SF, QUERIES["op13_sharding"], ORACLES["op13_sharding"])
    assert problem is None and rows == 200


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws_and_odd_rows(spark, odd_table, law):
    found = sharding.assign(odd_table, ["row", "chunk"], 4, law).collect()
    texts = {r.doc_id: r.text for r in odd_table.collect()}
    assert len(found) == 10 and len({r.row for r in found}) == 10
    for r in found:
        body = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 16, zlib.crc32(body))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    if law == "rows":
        assert sorted(len(s) for s in slots.values()) == [2, 2, 3, 3]
    # Along the shards and slots neither the curve nor, within a cell, the checksum falls.
    order = [(r.curve, r.text_crc32) for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.assign(odd_table.limit(0), ["row"], 4, law).collect() == []
    assert len(sharding.assign(odd_table.limit(1), ["row"], 4, law).collect()) == 1


def test_a_hot_value_is_cut_like_any_other(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "if(id % 3 < 2, 'hot', cast(id % 7 as string)) as source")
    rows = sharding.assign(docs, ["source"], 7).groupBy("shard").count().collect()
    assert {r["count"] for r in rows} == {428, 429} and len(rows) == 7
    sizes = Counter()
    for r in sharding.assign(docs, ["source"], 7, "bytes").collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 2 * (49 + 16)


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    """A filter on any of the columns can skip files by their statistics."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sharding.write_sharded(docs, f"{tmp_path}/out", ["lang", "source", "n_chars"], 40)
    files = [f"{d}/{n}" for d, _, names in os.walk(f"{tmp_path}/out") for n in names if n.endswith(".parquet")]
    assert len(files) == 40
    written = spark.read.parquet(*files)
    assert written.columns == docs.columns
    assert sorted(r.doc_id for r in written.collect()) == sorted(r.doc_id for r in docs.collect())
    skipped = Counter()
    for f in files:
        table = pq.read_table(f, columns=["lang", "source", "n_chars"], partitioning=None)
        for column, value in (("lang", "en"), ("source", "src3"), ("n_chars", 3000)):
            values = table[column].to_pylist()
            skipped[column] += not min(values) <= value <= max(values)
    assert min(skipped.values()) >= 10 and sum(skipped.values()) >= 50, skipped
    with pytest.raises(ValueError, match="folders"):
        sharding.write_sharded(docs.withColumnRenamed("lang", "_shard"), f"{tmp_path}/no", ["source"], 4)
