import random

import numpy as np
import public_tokenizers

from recordloom.llm import packing as K
from recordloom.llm.shared import read_file
from recordloom.tables import scratch

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_segment_tree_finds_the_least_room():
    rng = random.Random(1)
    rooms, have = K.Rooms(37), []
    for step in range(3000):
        if rng.random() < 0.5:
            room = rng.randint(0, 37)
            rooms.add(room, step)
            have.append((room, step))
        else:
            least = rng.randint(0, 37)
            got, best = rooms.take(least), min((r for r, _ in have if r >= least), default=None)
            assert (got and got[0]) == best
            if got:
                have.remove(got)


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(64 - n)
            else:
                rooms[rooms.index(fit)] -= n
        rows = K.best_fit(lengths, 64)
        assert sorted(64 - sum(lengths[k] for k in row) for row in rows) == sorted(rooms)
        assert sorted(k for row in rows for k in row) == list(range(len(lengths)))


def unpack(rows, row):
    parts = {}
    for r in rows:
        ids, places, bounds = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(places) == row and bounds[0] == 0 and bounds[-1] == r["n_ids"]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["doc_starts"])):
            assert (places[bounds[k] : bounds[k + 1]] == np.arange(bounds[k + 1] - bounds[k])).all()
            parts.setdefault((doc, start), []).append(ids[bounds[k] : bounds[k + 1]])
        assert (ids[bounds[-1] :] == 50256).all()
        assert (places[bounds[-1] :] == np.arange(row - bounds[-1])).all()
    return parts


def test_round_trip(documents):
    codec = K.encoding(PATH, PATTERN)
    for row, block in ((2048, 4_000_000), (64, 5000)):
        packed = K.pack(documents, PATH, PATTERN, row=row, block_ids=block).collect()
        assert len({r["row_id"] for r in packed}) == len(packed)
        parts = unpack(packed, row)
        docs = {}
        for (doc, start), (ids,) in sorted(parts.items()):
            docs[doc] = np.concatenate([docs.get(doc, np.zeros(0, "<u2")), ids])
            assert len(docs[doc]) == start + len(ids)
        assert all(ids[-1] == 50256 for ids in docs.values())
        assert {d: codec.decode(ids[:-1].tolist()) for d, ids in docs.items()} == {r["doc_id"]: r["text"] for r in documents.collect()}
        assert sum(r["n_ids"] for r in packed) > 0.9 * row * (len(packed) - 1)


def test_odd_rows(odd):
    packed = K.pack(odd, PATH, PATTERN, row=128).collect()
    parts = unpack(packed, 128)
    texts = sorted(K.encoding(PATH, PATTERN).encode_ordinary(r["text"] or "").__len__() + 1 for r in odd.collect())
    assert sum(len(x) for v in parts.values() for x in v) == sum(texts)
    assert {d for d, _ in parts} == {r["doc_id"] for r in odd.collect()}


def test_empty(none):
    assert K.pack(none, PATH, PATTERN).count() == 0


def test_files(spark, documents):
    packed = K.pack(documents.repartition(2), PATH, PATTERN)
    folder = scratch(spark, "packed")
    names = K.write_matrices(packed, folder).collect()
    total = 0
    for r in names:
        ids, places = (K.read_matrix(f"{folder}/{r['name']}-{what}.bin") for what in ("ids", "positions"))
        assert ids.shape == places.shape == (r["n_rows"], 2048)
        total += len(ids)
        flat = np.frombuffer(read_file(f"{folder}/{r['name']}-cu_seqlens.bin"), "<u4").tolist()
        at = 0
        for row, place in zip(ids, places):
            n = flat[at]
            bounds = flat[at + 1 : at + 2 + n]
            assert bounds[0] == 0 and len(bounds) == n + 1 and (place[bounds[:-1]] == 0).all()
            assert all((row[b - 1] == 50256 or b == 2048 or place[b - 1] == 2047) for b in bounds[1:])
            at += n + 2
        assert at == len(flat)
    assert total == packed.count()


def test_rows_come_back_from_files(documents, none):
    options = {"row": 64, "block_ids": 5000}
    plain = sorted(map(str, K.pack(documents, PATH, PATTERN, **options).collect()))
    assert sorted(map(str, K.pack_to_files(documents, PATH, PATTERN, **options).collect())) == plain
    assert K.pack_to_files(none, PATH, PATTERN).count() == 0


def test_sets_are_bounded(spark, documents):
    made = K.write_matrices(K.pack(documents.coalesce(1), PATH, PATTERN, row=64, block_ids=5000), scratch(spark, "packed"), set_rows=1024).collect()
    assert len(made) > 1 and max(r["n_rows"] for r in made) <= 1024
