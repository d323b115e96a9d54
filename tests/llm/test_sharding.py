import zlib
from collections import Counter

import numpy as np
import odd
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import sharding
from notemill.llm.queries import QUERIES


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 3000), st.integers(0, 50))
def test_permutation_and_its_inverse(n, seed):
    image = sharding.permute(np.arange(n), n, seed)
    assert sorted(image.tolist()) == list(range(n))
    assert (sharding.permute(image, n, seed, back=True) == np.arange(n)).all()


def test_rows_can_be_looked_up():
    shard, slot = sharding.place_of(np.arange(103), 103, 8)
    assert (sharding.rows_at(shard, slot, 103, 8) == np.arange(103)).all()


def test_query_against_direct_computation(spark, sf, documents):
    rows = sorted(QUERIES["op2_sharding"](spark, sf).collect(), key=lambda r: r["doc_id"])
    texts = documents[1]
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    shard, slot = sharding.place_of(np.arange(len(texts)), len(texts), 40)
    for k, (r, (_, text)) in enumerate(zip(rows, texts)):
        data = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["slot"]) == (len(data) + 16, zlib.crc32(data), shard[k], slot[k])


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_odd_rows(spark, shards):
    rows = sharding.shard(odd.odd(spark), shards).collect()
    assert len(rows) == len(odd.TEXTS)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sorted(r["row"] for r in rows) == list(range(len(rows)))
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}


def test_no_rows(spark):
    assert sharding.shard(odd.none(spark)).count() == 0


def test_shards_are_written_whole_in_slot_order(spark, tmp_path):
    docs = odd.odd(spark).drop("size", "shard")
    docs = docs.unionByName(docs.filter("doc_id = 8").crossJoin(spark.range(200).select()))
    back = sharding.write(sharding.shard(docs, 4), f"{tmp_path}/shards")
    plain = lambda frame: Counter(map(str, frame.select(*docs.columns).collect()))
    assert plain(back) == plain(docs)
    rows = back.collect()
    assert sorted(r["row"] for r in rows) == list(range(docs.count()))
    shard, slot = sharding.place_of(np.array([r["row"] for r in rows]), len(rows), 4)
    assert [(r["shard"], r["slot"]) for r in rows] == list(zip(shard.tolist(), slot.tolist()))
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    assert [order(r) for r in sorted(rows, key=lambda r: r["row"])] == sorted(map(order, rows))
    for folder in tmp_path.glob("shards/shard=*"):
        slots = [x for file in sorted(folder.glob("*.parquet")) for x in pq.ParquetFile(file).read(["slot"])["slot"].to_pylist()]
        assert slots == list(range(len(slots)))


def test_no_rows_are_written(spark, tmp_path):
    assert sharding.write(sharding.shard(odd.none(spark)), f"{tmp_path}/none").count() == 0
