import glob
import zlib

import numpy as np

from pairjudge.llm import training_order as O
from pairjudge.llm.tokens import document_ids


def test_permutation_and_inverse():
    for n in (1, 2, 3, 17, 100, 4097, 65537):
        slots = O.permute(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
        assert (O.permute(slots, n, 7, backward=True) == np.arange(n)).all()
    assert (O.permute(np.arange(1000), 1000, 7) != O.permute(np.arange(1000), 1000, 8)).any()


ROWS = [(i, f"text number {i} " * (i % 40)) for i in range(150)] + [(500, None), (501, ""), (None, "x"), (3, "text number 3 " * 3)]


def test_round_trip(spark, docs, tmp_path):
    order = O.training_order(docs(ROWS), sequence=32, per_shard=64)
    found = order.collect()
    assert [r.slot for r in found] == list(range(len(found)))
    texts = {}
    for r in found:
        assert r.shard == r.slot // 64 and r.offset == r.slot % 64 * 65 and len(r.record) == 64 and r.crc32 == zlib.crc32(bytes(r.record))
        texts.setdefault((r.doc_id, r.piece), []).append(np.frombuffer(r.record, "<u2")[: r.n_ids].tolist())
    for doc, text in ROWS:
        ids = document_ids(text).tolist()
        for k, start in enumerate(range(0, len(ids), 32)):
            assert ids[start:start + 32] in texts[doc, k]
    assert len(found) == sum(-(-len(document_ids(t)) // 32) for _, t in ROWS)


def test_shards_resume(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    order = O.training_order(docs(ROWS), sequence=32, per_shard=64)
    records = [bytes(r.record) for r in order.collect()]
    assert O.write_shards(order.where("shard <> 1"), path) > 0
    assert O.write_shards(order, path) == 1  # only what was missing
    assert O.write_shards(order, path) == 0
    assert [r.tobytes() for r in O.read_from(spark, path, 70, per_shard=64, sequence=32)] == records[70:]


def test_empty_table(docs):
    assert O.training_order(docs([])).count() == 0


def test_shards_are_files_of_fixed_stride_whoever_writes_them(spark, docs, tmp_path):
    path = str(tmp_path / "raw")
    rows = ROWS + [(600, "\n\r\n some lines\n" * 30)]
    first = docs(rows).repartition(5)
    records = O.records(first, sequence=32)
    records.write.parquet(path + "/_records")  # a writer that was stopped after its numbering and some shards
    order = O.in_order(spark.read.schema(O.RECORDS).parquet(path + "/_records"), sequence=32, per_shard=64)
    want = [bytes(r.record) for r in order.collect()]
    shards = -(-len(want) // 64)
    assert O.write_shards(order.where("shard in (0, 2)"), path) == 2
    assert O.materialise(docs(rows).coalesce(1), path, sequence=32, per_shard=64) == shards - 2  # other splits, other cores
    for slot in (0, 1, 63, 64, 130, len(want) - 1):
        name, = glob.glob(f"{path}/shard={slot // 64}/part-*")
        with open(name, "rb") as f:
            f.seek(slot % 64 * 65)
            assert f.read(64) == want[slot] and f.read(1) == b"\n"
        got = [r.tobytes() for r in O.read_from(spark, path, slot, per_shard=64, sequence=32, at_once=7)]
        assert got == want[slot:]
    assert O.materialise(docs(rows), path, sequence=32, per_shard=64) == 0
