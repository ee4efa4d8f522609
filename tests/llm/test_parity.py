"""The registered queries: SQL oracles where there are some, plain versions elsewhere (smallest tables)."""

import pandas as pd
import pytest
from tests.llm import brute as B
from tests.parity import compare, duck

from txrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_f, sql) in QUERIES.items() if sql])
def test_query_matches_oracle(spark, name):
    fn, sql = QUERIES[name]
    found = compare(spark, duck(SF), name, fn, sql, SF)
    assert found["ok"], found["problems"]


def _texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(docs.doc_id, docs.text.fillna("")))


def _rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name][0](spark, SF).collect()}


def test_op1_pieces_of_the_whole_table(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op1_pack_best_fit"][0](spark, SF).toPandas()
    assert set(got.doc_id) == set(_TEXTS)
    for doc, pieces in got.groupby("doc_id"):
        ids = np.array(library.encode(_TEXTS[doc], add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in pieces.sort_values("start").itertuples():
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(ids[at : at + p.length].tobytes()), len(ids))
            at += p.length
        assert at == len(ids)
    tokens = got.length.sum()
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 1024
    assert got.sequence_id.nunique() * 1024 < tokens * 1.05 + 1024


def test_op2_finds_the_nearest_of_the_whole_table(spark):
    import numpy as np

    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    vector = next(c for c in rows.columns if isinstance(rows[c].iloc[0], np.ndarray))
    vectors = {i: v.astype(float) for i, v in zip(rows.vec_id, rows[vector]) if v is not None}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    ids, held = np.array(sorted(vectors)), np.stack([vectors[i] for i in sorted(vectors)])
    got = QUERIES["op2_vp_search"][0](spark, SF).toPandas()
    hits = asked = 0
    for q in ids[ids % 20 == 0]:
        scores = held @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(order) + 1))
        assert mine["score"].tolist() == pytest.approx([float(vectors[i] @ vectors[q]) for i in mine.vec_id], abs=1e-12)
        assert mine["score"].is_monotonic_decreasing
        hits += len(set(mine.vec_id) & set(ids[order]))
        asked += len(order)
    assert asked and hits >= 0.9 * asked


def test_op3_statistics_and_verdicts(spark):
    for doc, r in _rows(spark, "op3_quality_rules").items():
        s = B.text_statistics(_TEXTS[doc])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_op5_and_op7_match_plain_removal(spark):
    for name, unit, length in (("op5_run_length_dedup", "byte", 100), ("op7_relative_lz", "word", 20)):
        exp = B.remove_repeats(list(_TEXTS.items()), length, unit)
        for doc, r in _rows(spark, name).items():
            n, gone, runs, sha = exp[doc]
            assert (r[1], r["n_removed"], r["kept_sha256"]) == (n, gone, sha)
            assert unit == "word" or r["n_spans"] == runs


def test_op8_matches_plain_links(spark):
    prints = {d: B.simhash(t) for d, t in _TEXTS.items()}
    exp = B.components(list(prints), list(prints.values()))
    for doc, r in _rows(spark, "op8_simhash_dedup").items():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[doc]:016x}", exp[doc])


def test_op9_base_spans(spark):
    for doc, r in _rows(spark, "op9_secret_scan").items():
        base = B.base_secrets(_TEXTS[doc])
        assert r["base_sha256"] == B.sha(",".join(f"{k}:{s}:{e}" for s, e, k in base))


def test_pipeline_keeps_and_packs(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < pieces.doc_id.nunique() < len(_TEXTS)
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()


_TEXTS = _texts()
