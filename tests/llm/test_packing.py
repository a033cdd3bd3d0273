import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from neo.llm import packing as P
from neo.llm import token_matrix as M
from neo.llm import tokens as K
from tests.conftest import SF_SMALL
from tests.llm.conftest import odd_rows


def reference_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    return t.encode(text or "", add_special_tokens=False).ids + [K.END_ID]


def test_ids_are_those_of_tokenizers(spark):
    encode = K.Encoder.named()
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()]
    for text in [*texts, None, "", "<|endoftext|> x", "a" * 3000, "  \n\n \t x y \U0001f600 中文 it's 123"]:
        assert encode(text).tolist() == reference_ids(text)


def test_cut():
    assert K.cut(5, 4) == [(0, 1), (1, 4)] and K.cut(8, 4) == [(0, 4), (4, 4)] and K.cut(3, 4) == [(0, 3)]


def check_pieces(got, rows, size, sequence):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(tuple(r[c] for c in sequence), []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = {}
    for doc_id, text in rows:
        ids = np.array(reference_ids(text), "<u4")
        want.setdefault(doc_id, []).extend((p, a, n, K.crc32(ids[a:a + n])) for p, (a, n) in enumerate(K.cut(len(ids), size)))
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for d, v in by_doc.items()} == {
        d: sorted(v) for d, v in want.items()}
    return len(by_sequence), sum(r.length for r in got)


def test_pack(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(20)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = P.pack(docs).collect()
    n, total = check_pieces(got, rows, P.SIZE, ["sequence_id"])
    in_one_task = len(P.best_fit(np.array([r.length for r in got]), P.SIZE)[2])
    assert total / P.SIZE <= n <= 1.02 * in_one_task + 1


def test_merging_over_levels(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 * 30 + 3)) for i in range(300)], "doc_id long, text string")
    got = P.pack(docs.repartition(100), fan=3).collect()
    n, total = check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()], P.SIZE, ["sequence_id"])
    assert n <= 1.1 * total / P.SIZE + 1


@pytest.mark.parametrize("fit", [lambda s, c: P.best_fit(s, c)[0],
                                 lambda s, c: [next(b for b, x in enumerate(M.best_fit_rows(s, c)) if i in x) for i in range(len(s))]])
def test_best_fit_against_a_plain_search(fit):
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 65, rng.integers(0, 60))
        bins = np.array(fit(sizes, 64), int)
        fills = np.bincount(bins, weights=sizes) if len(sizes) else np.array([])
        assert (fills <= 64).all()
        rooms = []
        for s in sorted(sizes, reverse=True):  # the least room that suffices
            best = min((r, k) for k, r in enumerate(rooms + [65]) if r >= s)[1] if any(r >= s for r in rooms) else None
            if best is None:
                rooms.append(64 - s)
            else:
                rooms[best] -= s
        assert len(fills) == len(rooms) and sorted(64 - fills) == sorted(rooms)


def test_matrix_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(80)
    parts = {}
    for r in M.matrix(docs, size=512).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 512 and r.resets == r.cu_seqlens[:-1] and (ids[r.cu_seqlens[-1]:] == M.PAD_ID).all()
        for k, doc_id in enumerate(r.doc_ids):
            parts.setdefault(doc_id, []).append((r.starts[k], ids[r.cu_seqlens[k]:r.cu_seqlens[k + 1]].tolist()))
    tok = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    for r in docs.collect():
        ids = [i for _, x in sorted(parts[r.doc_id]) for i in x]
        assert ids[-1] == K.END_ID and tok.decode(ids[:-1], skip_special_tokens=False) == r.text


def test_odd_rows(odd, none):
    rows = [r[:2] for r in odd_rows()]
    check_pieces(P.pack(odd).collect(), rows, P.SIZE, ["sequence_id"])
    check_pieces(M.segments(M.write(odd)).collect(), rows, M.SIZE, ["shard", "row"])
    assert P.pack(none).count() == 0 and M.segments(M.write(none)).count() == 0
