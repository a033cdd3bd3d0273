import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from neo.llm import pieces as P
from neo.llm.catalog import op11_sentence_pieces
from tests.conftest import SF_SMALL
from tests.llm.conftest import odd_rows

MODEL = P.Pieces.named()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))


def ids_of(texts):
    raw = [t.replace("▁", " ").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    ids, at = P.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, MODEL)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def texts_of(lists):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return [t.decode() for t in P.decode(np.array(sum(lists, []), np.int64), offsets, MODEL)]


def check(texts):
    want = LIBRARY.encode(texts)
    assert ids_of(texts) == want
    assert texts_of(want) == LIBRARY.decode(want)


FIXED = ["", " ", "a", "  a  b ", "\n", "a\x00b", "▁x", "a ▁b", "a▁ ▁▁b", "<s>hello</s>", "<0x0A>",
         "héllo 日本語 😀", "﻿a", " ", "\r\n\t", "the the thethe theeth", "aaaaaaaaaaa", " " * 700, "ab " * 5,
         "x" + " " * 40 + "y", "0" * 33, "…" * 9, "\U000e0001", "banana bananas ananas", "ththeinging"]


def test_fixed_texts():
    check(FIXED)
    for text in FIXED:
        check([text])
    check([""] * 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aehint ▁\n", max_size=120), st.text(" =-*0", max_size=80)), min_size=1,
                max_size=6))
def test_any_text(texts):
    check(texts)


def test_long_segments():
    rng = random.Random(3)
    texts = ["a" * 3000, " " * 2500 + "x", "".join(rng.choice("abcdefghinot") for _ in range(6000)), "=" * 1100,
             "".join(rng.choice("hetin") for _ in range(P.LONG + 1)), "日本" * 900]
    check(texts)


def test_decodes_any_ids():
    rng = random.Random(4)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 264, 28705]) for _ in range(rng.randrange(9))]
             for _ in range(2000)]
    lists += [[3 + b for b in text.encode()] for text in ("é", "日a", "😀😀")] + [[1, 264], [1, 2], [28705, 28705], [3 + 0xC3, 264]]
    assert texts_of(lists) == LIBRARY.decode(lists)
    with pytest.raises(ValueError):
        P.decode(np.array([40000]), np.array([0, 1]), MODEL)


def test_rows(odd, none, spark):
    rows = [r[:2] for r in odd_rows()]
    got = P.decoded(P.encoded(odd)).collect()
    want = [(i, LIBRARY.encode(t or "")) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.text for r in got) == sorted(LIBRARY.decode(x) for _, x in want)
    assert P.decoded(P.encoded(none)).collect() == []
    lists = spark.createDataFrame([("a", None), ("b", []), (None, [264])], "doc_id string, ids array<int>")
    assert sorted(((r.doc_id, r.text) for r in P.decoded(lists).collect()), key=str) == [("a", None), ("b", ""), (None, "a")]


def test_query(spark):
    import hashlib
    got = {r.doc_id: r for r in op11_sentence_pieces(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)
