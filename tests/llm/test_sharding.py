"""Slots, maps and places."""

from __future__ import annotations

import zlib

import pytest

from evalboard.llm.sharding import MapStore, SlotMap, load_map, measured, shard_by_slots

from .conftest import ODD, documents


def test_whole_table(spark):
    texts = [*ODD, *[f"text {i} " * (i % 50) for i in range(2000)]]
    rows, slots = shard_by_slots(documents(spark, texts), 8)
    got = rows.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts))) and slots.version == 2
    loads = [0] * 8
    places: dict[int, list[int]] = {}
    for r in got:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body)) and slots.shards[r["virtual_slot"]] == r["shard"]
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 8


def test_rebalancing_moves_little():
    weights = [i % 7 + 1 for i in range(1000)]
    one = SlotMap.initial(1000, 10).rebalanced(weights)
    weights[3] += 400
    two = one.rebalanced(weights)
    moved = sum(a != b for a, b in zip(one.shards, two.shards, strict=True))
    loads = [sum(w for w, s in zip(weights, two.shards, strict=True) if s == k) for k in range(10)]
    assert 0 < moved < 200 and max(loads) - min(loads) <= 7 and two.version == 3


def test_growth_moves_only_into_the_new_shard():
    one = SlotMap.initial(1000, 10)
    two = one.grown()
    assert two.n_shards == 11 and all(a == b or b == 10 for a, b in zip(one.shards, two.shards, strict=True)) and 88 <= two.shards.count(10) <= 91


def test_versions_are_stored(spark):
    one = SlotMap.initial(64, 4)
    two = one.rebalanced([i for i in range(64)])
    stored = one.frame(spark).union(two.frame(spark))
    assert load_map(stored) == two and load_map(stored, 1) == one


def test_places_go_by_the_stored_map(spark, tmp_path):
    """A second run loads what the first stored, edits it and appends the next version."""
    store = f"file://{tmp_path}/map"
    texts = [f"text {i} " * (i % 50) for i in range(1500)]
    rows, one = shard_by_slots(documents(spark, texts), 5, store, n_slots=256)
    grown = documents(spark, texts + ["more " * 900] * 40)
    again, two = shard_by_slots(grown, 5, store, n_slots=256)
    maps = MapStore(spark, store)
    assert (one.version, two.version) == (2, 3) and maps.load() == two and maps.load(2) == one and maps.load(1) == SlotMap.initial(256, 5)
    assert 0 < sum(a != b for a, b in zip(one.shards, two.shards, strict=True)) < 100
    assert all(r["shard"] == two.shards[r["virtual_slot"]] for r in again.collect()) and all(r["shard"] == one.shards[r["virtual_slot"]] for r in rows.collect())
    with pytest.raises(ValueError):
        shard_by_slots(grown, 6, store, n_slots=256)


def test_repeated_rows_have_places_of_their_own(spark):
    docs = documents(spark, ["x"]).crossJoin(spark.range(900)).drop("id").repartition(6)
    got = sorted(r["slot"] for r in shard_by_slots(docs, 3)[0].collect())
    assert got == list(range(900))


def test_no_slot_gathers_copies(spark):
    docs = documents(spark, ["the same text"] * 3000)
    assert measured(docs).groupBy("virtual_slot").count().agg({"count": "max"}).first()[0] < 12


def test_odd_rows(odd, empty):
    assert shard_by_slots(odd, 3)[0].count() == odd.count() and shard_by_slots(empty, 3)[0].count() == 0


def test_versions_are_written_once(spark, tmp_path):
    maps = MapStore(spark, f"{tmp_path}/maps")
    one = SlotMap.initial(64, 4)
    two = one.grown()
    assert maps.empty() and maps.versions() == []
    for _ in range(2):  # a job that is repeated
        maps.append(one)
        maps.append(two)
    assert maps.versions() == [1, 2] and maps.load() == two and maps.load(1) == one
    with pytest.raises(ValueError, match="another map"):
        maps.append(SlotMap(2, one.shards))
    (tmp_path / "maps/version-00000003").mkdir()  # a job that broke off
    assert maps.load() == two
    maps.append(SlotMap(3, two.shards))
    assert maps.versions() == [1, 2, 3] and len(maps.load().shards) == 64
    with pytest.raises(ValueError, match="each slot once"):
        load_map(one.frame(spark).union(one.frame(spark)))


def test_no_version_without_a_move(spark, tmp_path):
    docs = documents(spark, ["x"] * 3)
    _, first = shard_by_slots(docs, 2, f"{tmp_path}/maps", n_slots=8)
    _, again = shard_by_slots(docs, 2, f"{tmp_path}/maps", n_slots=8)
    assert again == first and len(MapStore(spark, f"{tmp_path}/maps").versions()) == first.version
