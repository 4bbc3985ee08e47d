"""Token ids of every code point, near copies per row, and the pipeline's stages on odd rows."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from tamiz.llm import simhash, vocabulary
from tests.llm.test_llm import documents, empty, odd, odd_rows  # noqa: F401

POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in " \t\n\x0b\x0c\r"]
LETTERS = [c for c in POINTS if c.isalnum() or c.lower() != c or not c.isprintable()]


@pytest.mark.parametrize("points, form", [(POINTS, "{},"), (LETTERS, "a{}."), (LETTERS, '{}"'), (LETTERS, "e{}?!")])
def test_ids_of_every_code_point_equal_the_library(points, form):
    words = vocabulary.Vocabulary(vocabulary.default_path())
    for start in range(0, len(points), 50_000):
        texts = [form.format(c) for c in points[start : start + 50_000]]
        got = words.chunk_ids([t.encode() for t in texts])
        want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [t for t, g, w in zip(texts, got, want) if np.frombuffer(g, "<u4").tolist() != w.ids] == []
        split = [b"".join(words.piece_ids(words.split(t.encode()))) for t in texts]
        assert [t for t, g, w in zip(texts, split, want) if np.frombuffer(g, "<u4").tolist() != w.ids] == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé ÉÑı\u0130\u0301\u0307\n\t.,!?$#<>s/|x09\u0958\u3042\u00d7\u00f7 ­"), max_size=40))
def test_pieces_of_a_text_equal_the_library(text):
    words = vocabulary.for_worker(vocabulary.default_path())
    got = np.frombuffer(b"".join(words.piece_ids(words.split(text.encode()))), "<u4").tolist()
    assert got == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_memo_rotates_and_is_emptied(monkeypatch):
    monkeypatch.setattr(vocabulary, "GENERATION", 5)
    words = vocabulary.Vocabulary(vocabulary.default_path())
    chunks = [f"word{i % 13},".encode() for i in range(200)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in words.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
    assert [words.chunk_ids([c])[0] for c in chunks] == want == words.chunk_ids(chunks)
    words.forget()
    assert not words.chunks.young and not words.chunks.old and not words.pieces.young


def near_brute(rows):
    """Kept rows as (id, text) with the least (null last, id) of each component of fingerprints."""
    prints = [simhash.fingerprint(t) for _, t, *_ in rows]
    left, kept = set(range(len(rows))), []
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            i = queue.pop()
            group.add(i)
            near = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS}
            left -= near
            queue += near
        kept.append(min((rows[i][0] is None, rows[i][0] or 0) for i in group))
    return sorted(kept)


def test_near_copies_are_decided_per_row(spark, empty):  # noqa: F811
    text = "the quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill number {} in silence and wonder"
    unrelated = [" ".join(f"w{k * 1000 + i}" for i in range(30)) for k in range(6)]
    rows = [(None, unrelated[0], "en", "a"), (None, unrelated[1], "en", "a"), (None, unrelated[2], None, None), (5, unrelated[3], "en", "a"),
            (5, unrelated[4], "en", "b"), (5, unrelated[5], "en", "a"), (7, unrelated[0], "fr", "a"), (3, unrelated[5], "en", "a"),
            (None, unrelated[2], "de", "z"), (9, None, "en", "a"), (8, "", "en", "a"), (8, "", "fr", "a"), (1, text.format(1), "en", "a")]
    out = simhash.drop_near_copies(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == near_brute(rows)
    assert len({r.text for r in out if r.text}) == 7
    again = simhash.drop_near_copies(documents(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(out, key=repr) == sorted(again, key=repr)


def test_pipeline_on_odd_rows_and_clashing_columns(spark, odd, empty):  # noqa: F811
    more = odd.selectExpr("*", "1 AS row", "'x' AS _doc", "2 AS _key", "3 AS kept", "4 AS size", "5 AS fp")
    for docs in (more, empty, odd.filter("doc_id IS NULL"), odd.filter("text IS NULL OR text = ''")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
            docs = stage(spark, docs, "")
            assert name == "packing" or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= ids
