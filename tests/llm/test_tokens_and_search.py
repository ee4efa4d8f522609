"""Token alignment, token counts and ranked search against the libraries and plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.llm import brute as B

from txrisk.llm import lexical_search, queries, token_alignment, token_counts

SF = "/root/testdata/sf0.001"
A, P = queries.vocabulary_path(queries.BYTE_BPE), queries.vocabulary_path(queries.PIECE_BPE)
HARD = [
    None, "", " ", "x", "<s> <unk> <|endoftext|></s>", "▁ mark", "é x\n\t" * 40, " " * 700 + "end", "a" * 900,
    "😀①日本語 " * 60, "\u0000 nul", "ab" * 800, "the quick, brown fox " * 90, "tail  \n\n",
]
CLASH = ["row", "pair", "pairs", "times", "key", "seq", "n", "text_", "n_tokens", "place", "term", "score", "rank", "data"]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def _table():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(docs.doc_id.tolist(), [None if pd.isna(t) else t for t in docs.text]))


def _odd(spark):
    rows = list(enumerate(HARD)) + [(None, "same words"), (None, "same words"), (3, "same words"), (3, "same words")]
    return rows, _frame(spark, rows)


def test_byte_letters_are_the_published_mapping():
    assert token_alignment.byte_letters() == B._byte_letters()


@pytest.mark.parametrize("limit", [token_alignment.BROADCAST_PAIRS, 0])
def test_op11_equals_loops_over_the_libraries(spark, monkeypatch, limit):
    texts = _table()
    expected = B.alignments(texts, A, P)
    monkeypatch.setattr(token_alignment, "BYTES_AT_ONCE", 100_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = token_alignment.link_statistics(docs, A, P, broadcast_pairs=limit).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *numbers, groups = expected[r["doc_id"]]
        assert [r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]] == numbers
        assert r["groups_sha256"] == (B.sha(groups) if groups else "")


def test_op11_odd_texts(spark):
    rows, df = _odd(spark)
    named = dict(enumerate(HARD))
    expected = B.alignments(named, A, P)
    got = token_alignment.align(df, A, P, keep=True).collect()
    assert len(got) == len(rows)
    for r in got[: len(HARD)]:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == expected[r["doc_id"]][:4]
        assert r["groups"] == expected[r["doc_id"]][6]
    assert sum(r["doc_id"] is None for r in got) == 2
    assert [r["n_a"] for r in got if r["doc_id"] == 5] == [0]  # the space mark itself does not come back
    for r in token_alignment.link_statistics(df, A, P).collect():
        assert r["n_best"] <= r["n_links"] <= r["count_sum"]
    assert token_alignment.link_statistics(df.limit(0), A, P).collect() == []


def test_op11_overlaps_are_all_pairs_that_share_a_byte(spark):
    text = "Straße ①, naïve  cafés 12345"
    r = token_alignment.align(_frame(spark, [(1, text)]), A, P, keep=True).first()
    (a, a_table), (b, b_table) = token_alignment.byte_bpe(A), token_alignment.piece_bpe(P)
    ends = [np.cumsum([len(t[i]) for i in ids]) for t, ids in ((a_table, a.encode_ordinary(" " + text)), (b_table, b.encode(text)))]
    spans = [list(zip([0, *e[:-1]], e)) for e in ends]
    shared = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e]
    assert [(o["a"], o["b"]) for o in r["overlaps"]] == shared


def test_wide_groups_are_paired_by_distinct_ids(monkeypatch):
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 5, 60), rnd.integers(0, 6, 50)
    cuts = np.array([0, 1, 40, 60]), np.array([0, 2, 30, 50])
    narrow = token_alignment.pairs_of(a, b, *cuts)
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", 4)
    for x, y in zip(narrow, token_alignment.pairs_of(a, b, *cuts)):
        assert x.tolist() == y.tolist()


@pytest.mark.parametrize("chunk,overlap", [(32_768, 512), (700, 30), (64, 3)])
def test_op12_equals_the_library(spark, chunk, overlap):
    rows, df = _odd(spark)
    rows += [(1000 + d, t) for d, t in _table().items()]
    df = _frame(spark, rows)
    library = token_counts.model(P)
    expected = sorted((d is None, d or 0, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows)
    got = token_counts.count_tokens(df, P, 100, chunk, overlap).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(df.limit(0), P).collect() == []


def test_op12_chunks_cover_the_text_between_characters():
    data = "aé日😀 x".encode() * 50
    for chunk, overlap in ((7, 3), (50, 50), (10_000, 1)):
        parts = list(token_counts.chunks_of(data, chunk, overlap))
        assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[-1][1] == len(data)
        for start, after, body in parts:
            body.decode()
            assert data[start : start + len(body)] == body and len(body) >= after - start


def test_op12_registered_query_on_the_table(spark):
    library = token_counts.model(P)
    texts = _table()
    for r in queries.op12_count_tokens(spark, SF).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]] or ""))
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_op12_refuses_models_the_proof_does_not_cover():
    with pytest.raises(ValueError):
        token_counts.count_tokens(None, P, overlap=0)


def _ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block,cells", [(4096, 1 << 21), (2, 40)])
def test_op13_equals_scoring_every_document(spark, monkeypatch, block, cells):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rnd = random.Random(5)
    words = ["Alpha", "beta", "ÄPFEL", "x1", "the", "a-b", "日本", "zz"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(90)]
    docs += [(90, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (91, None), (92, ""), (93, "?!"), (94, "alpha " * 30_000)]
    items = [(1, "alpha BETA beta"), (2, "äpfel ÄPFEL the"), (3, None), (4, "nothing here"), (5, "b a"), (5, "x1"), (5, "x1"), (None, "zz")]
    frame = _frame(spark, items).withColumnRenamed("doc_id", "item_id").withColumn("doc_id", F.lit(1))
    got = lexical_search.search(_frame(spark, docs), frame, 10, items_a_block=block)
    assert _ranked(got) == sorted(B.ranked(docs, items, 10), key=str)


def test_op13_empty_tables(spark):
    docs, items = _frame(spark, [(1, "a b")]), _frame(spark, [(1, "a b")]).withColumnRenamed("doc_id", "item_id")
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
