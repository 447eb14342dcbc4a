"""Every registered corpus query and the pipeline on small awkward tables: nulls, ties, repeated rows, clashing columns, nothing at all."""

import os
import random

import pytest

pytest.importorskip("webgrain.llm")

import corpus_pipeline  # noqa: E402
from webgrain.llm import queries  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, `__size` int, `__copy` string, sequence_id long"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score long"
CONVERSATIONS = "conv_id long, turn long, role string, text string, formatted string"
LANGUAGES = {"en": "the of and to in is that it was for", "fr": "le la les et des une dans est que pour"}


def documents():
    rng, rows = random.Random(2), []
    for d in range(120):
        lang = rng.choice(sorted(LANGUAGES))
        words = rng.choices(LANGUAGES[lang].split() + [f"w{rng.randrange(400)}" for _ in range(10)], k=rng.randint(3, 60))
        rows.append((d, " ".join(words), lang if d % 9 else None, ["a", "b", None][d % 3], 1, d, "x", d))
    copy = rows[7][1] + " " + rows[8][1]
    rows += [(200, copy, "en", "a", 1, 0, None, None), (201, copy, "en", "a", 1, 0, None, None), (202, copy + " more", "en", "b", 1, 0, None, None), (300, None, None, None, None, None, None, None), (301, "", "en", "b", 0, 0, "", 0), (302, "12 34", "en", "b", 0, 0, "", 0)]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(4)
    vectors = [(k, [float(x) for x in (rng.gauss(0, 1) for _ in range(8))] if k % 13 else None, k % 3 or None, 0) for k in range(260)]
    vectors += [(1000 + k, vectors[1][1], 1, 0) for k in range(3)] + [(2000, [float("nan")] * 8, 1, 0), (2001, [0.0] * 8, 1, 0)]
    turns = [(c, t, r, x, "") for c in (1, 2, None) for t, r, x in ((0, "user", "hi"), (1, "assistant", None), (1, "assistant", "</turn>"), (None, None, "x"))]
    spark.createDataFrame(documents(), DOCUMENTS).repartition(3).write.parquet(f"{root}/some/documents.parquet")
    spark.createDataFrame(vectors, EMBEDDINGS).write.parquet(f"{root}/some/embeddings.parquet")
    spark.createDataFrame(turns, CONVERSATIONS).write.parquet(f"{root}/some/conversations.parquet")
    for name, schema in (("documents", DOCUMENTS), ("embeddings", EMBEDDINGS), ("conversations", CONVERSATIONS)):
        spark.createDataFrame([], schema).write.parquet(f"{root}/none/{name}.parquet")
    return root


def expected(name, folder, spark):
    table = "embeddings" if name[:4] in ("op1_", "op3_") else "documents"
    return spark.read.parquet(f"{folder}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    some, none = (queries.QUERIES[name](spark, f"{folder}/{kind}").collect() for kind in ("some", "none"))
    rows = expected(name, f"{folder}/some", spark)
    if name in ("op9_chat_format", "chat_turns"):
        assert {r.conv_id: r.n_turns for r in some} == {1: 4, 2: 4, None: 4, -7: 2}
        assert [r.conv_id for r in none] == [-7]
        return
    assert none == []
    if name == "op1_topk_search":
        assert {r.query_id for r in some} <= {0, 100, 200, 1000, 2000} and all(r.query_id != r.vec_id for r in some)
        assert max(r["rank"] for r in some) == 10
    elif name == "op12_hard_negatives":
        assert some and max(r["rank"] for r in some) <= 3 and all(r.anchor_id % 50 == 0 and 50 * r.positive_score <= 100 * r.negative_score <= 95 * r.positive_score for r in some)
    elif name == "op5_packing":
        whole = {}
        for r in some:
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert len(some) >= rows and whole[300] == 1
    else:
        assert len(some) == rows


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/some/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.Stage(spark, "test").put(step(spark, docs, folder), name)
        assert docs.columns == before.columns, name
        kept, given = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert kept <= given and len(kept) > 0.5 * len(given), name
        if name == "language_id":
            assert not kept & {300, 301, 302}
        if name == "minhash_dedup":
            assert not {201, 202} & kept and 200 in kept
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.length == r.doc_tokens) > 0
    fill = {}
    for r in pieces:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
