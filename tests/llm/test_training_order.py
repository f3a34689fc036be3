"""The permutation, whole round trips through shards, resumed reads, and that runs agree."""

import hashlib
import os
import time

import numpy as np
import pytest

from allelio.llm import bpe, training_order as order


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation(total):
    slots = order.feistel(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert not (slots == order.feistel(np.arange(total), total, 1)).all()
        assert abs(np.corrcoef(slots, np.arange(total))[0, 1]) < 0.15


def some(spark):
    texts = [None, "", "one two", "the cat sat on the mat " * 700, "é\n\0x" * 50, "the cat " * 128] + [f"text number {i} " * (i % 90) for i in range(300)]
    texts.append("many words of one long text " * 60_000)  # longer than what is encoded together
    rows = [*enumerate(texts), (None, "no id"), (2, "one two"), (2, "one two")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slot", "'x' as ids")


def test_rows_of_some_texts():
    parts = [np.arange(n, dtype="<u4") for n in (0, 1, 4, 5, 0, 9)]
    rows, text, number = order._rows(parts, 4)
    assert text.tolist() == [1, 2, 3, 3, 5, 5, 5] and number.tolist() == [0, 0, 0, 1, 0, 1, 2]
    assert [r[1 : 1 + r[0]].tolist() for r in rows] == [[0], [0, 1, 2, 3], [0, 1, 2, 3], [4], [0, 1, 2, 3], [4, 5, 6, 7], [8]]
    assert len(order._rows([], 4)[0]) == len(order._rows([parts[0]], 4)[0]) == 0
    with pytest.raises(ValueError):
        order._rows([np.array([1 << 16], "<u4")], 4)


@pytest.mark.parametrize("together", [1, 3])
def test_shards(spark, tmp_path, together):
    rows, docs = some(spark)
    vocabulary = bpe.vocabulary_of(bpe.vocabulary_text(bpe.default_path()))
    want = []
    for i, t in rows:
        ids = bpe.encode(vocabulary, t or "")
        want += [(i, at // order.LENGTH, hashlib.sha256(ids[at : at + order.LENGTH].astype("<u2").tobytes()).hexdigest()) for at in range(0, len(ids), order.LENGTH)]
    placed, total = order.slotted(order.stage(order.sequences(docs), "t"))
    assert total == len(want)
    path = str(tmp_path / "s")
    order.write_shards(placed, total, path, 100, together)
    files = [sum(f.startswith("part") for f in os.listdir(f"{path}/shard={k}")) for k in range(-(-total // 100))]
    assert set(files) == {1}
    whole = {r["slot"]: bytes(r["ids"]) for r in order.read_shards(spark, path, shard=100).collect()}
    assert sorted(whole) == list(range(total))
    found = sorted([(r["doc_id"], r["seq_no"], hashlib.sha256(whole[r["slot"]]).hexdigest()) for r in placed.collect()], key=repr)
    assert found == sorted(want, key=repr)
    read = {r["slot"]: bytes(r["sha256"]) for r in order.read_digests(spark, path, shard=100, start=7).collect()}
    assert read == {s: hashlib.sha256(b).digest() for s, b in whole.items() if s >= 7}
    for start in (0, 1, 150, total - 1):
        assert {r["slot"]: bytes(r["ids"]) for r in order.read_shards(spark, path, shard=100, start=start).collect()} == {s: b for s, b in whole.items() if s >= start}


def test_runs_agree(spark, rows):
    _, docs = some(spark)
    a, b = rows(order.materialise(docs)), rows(order.materialise(docs.repartition(5)))
    assert a == b and len(a) > 300 and len({r[2] for r in a}) == len(a)
    assert all(r[4] == r[2] % order.SHARD * order.STRIDE for r in a)
    assert order.materialise(docs.limit(0)).count() == 0
    assert order.materialise(docs.filter("doc_id < 2")).count() == 0


def test_the_shuffle_of_a_pass_goes(spark, tmp_path):
    _, docs = some(spark)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in disk.getAllFiles().mkString(" ").split(" ") if f.endswith(".data") and "shuffle_" in f}

    placed, total = order.slotted(order.stage(order.sequences(docs), "t"))
    before, paths = shuffles(), [str(tmp_path / f"{n}") for n in (1, 3)]
    for path, passes in zip(paths, (1, 3)):
        order.write_shards(placed, total, path, 100, 1, passes)
    until = time.time() + 10  # they go soon after a query ends
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    one, three = ({r["slot"]: bytes(r["ids"]) for r in order.read_shards(spark, p, shard=100).collect()} for p in paths)
    assert one == three and sorted(one) == list(range(total)) and sorted(os.listdir(paths[0])) == sorted(os.listdir(paths[1]))
    with pytest.raises(Exception, match="(?i)already exists"):
        order.write_shards(placed, total, paths[1], 100, 1)


def test_ids_and_slots_meet_by_a_shuffle(spark, rows, monkeypatch):
    _, docs = some(spark)
    want = rows(order.materialise(docs))
    plain, sizes = order.lookup_join, []
    monkeypatch.setattr(order, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(order, "lookup_join", lambda *a, size: sizes.append(size) or plain(*a, size=size, max_bytes=0))
    assert rows(order.materialise(docs)) == want and sizes[0] > 0
