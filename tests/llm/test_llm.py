"""Operators of txrisk.llm against plain versions, round trips and odd inputs."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.llm import brute as B

from txrisk.llm import (
    chat_format, mixing, packing, quality_rules, queries, relative_lz, run_length_index, secret_scan, simhash_dedup,
    url_filter, vp_search,
)
from txrisk.llm.anchors import gram_hashes, owners
from txrisk.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(seed=0, n=60):
    """Prose with copies, near copies, shared passages and repeated lines."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(400)]
    words = lambda k: rnd.choices(vocabulary, k=k)
    passage = words(70)
    out = []
    for i in range(n):
        ws = words(rnd.randint(0, 300))
        kind = i % 6
        if kind == 1 and out:
            ws = out[rnd.randrange(len(out))].split()
        elif kind == 2 and out:
            ws = out[rnd.randrange(len(out))].split()
            for _ in range(min(3, len(ws))):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
        elif kind == 3:
            at = rnd.randint(0, len(ws))
            ws = ws[:at] + passage[rnd.randint(0, 20) : rnd.randint(50, 70)] + ws[at:]
        elif kind == 4:
            line = words(25)
            ws = line + ["\n"] + ws + ["\n"] + line
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts() + ["", " \t\n", "ab " * 4000, "x" * 3000, "Same same", "Same same"]
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _odd(spark):
    """Nulls anywhere, repeated rows, a very long text, columns with clashing names."""
    t = " ".join(f"w{i % 50}" for i in range(40)) + " password: hunter22"
    rows = [
        (1, t, None, None, None), (1, t, None, None, None), (None, t, "en", "a", 3), (None, None, None, None, None),
        (2, None, "en", "b", 0), (3, "", "de", "b", 0), (4, t, "de", "a", 9), (4, "other " + t, "de", "a", 9),
        (5, "\\ '\"%_ \u0000 \U0001f600 $1", "fr", "c", 1), (6, "long words " * 60_000, "en", "a", 1),
    ]
    clash = ["key", "data", "id", "fp", "part", "text_", "topic", "weight", "n_tokens", "kept", "rule", "secrets", "host",
             "n_words", "shard", "start", "spans", "root", "__key"]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


def _vocabulary():
    return queries.vocabulary_path()


OPERATORS = {
    "pack": lambda d: packing.pack(d, _vocabulary()),
    "quality": lambda d: quality_rules.judge(d, quality_rules.DecisionList()),
    "repeated_bytes": run_length_index.drop_repeated_bytes,
    "repeated_words": relative_lz.drop_repeated_words,
    "simhash": simhash_dedup.near_duplicates,
    "drop_near": simhash_dedup.drop_near_duplicates,
    "secrets": secret_scan.scan_secrets,
    "redact": secret_scan.redact,
    "mix": lambda d: mixing.mix(d, queries.MIX_TARGETS, rounds=3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    odd = _odd(spark)
    rows = OPERATORS[name](odd).collect()
    if name in ("quality", "repeated_bytes", "repeated_words", "simhash", "secrets", "redact", "mix"):
        assert len(rows) == odd.count()
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_pack_holds_every_token_once_and_fills_windows(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [(-1, "<|endoftext|>"), (-2, "a <|endoftext|> b<|endoftext|><|endoftext|>\n<|endoftext"), (-3, " <| endoftext|>")]
    marked = docs.limit(3).drop("doc_id", "text").limit(1).crossJoin(docs.sparkSession.createDataFrame(special, "doc_id long, text string"))
    docs = docs.unionByName(marked)
    got = packing.pack(docs, _vocabulary(), docs_per_shard=30).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc, pieces in got.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in pieces.ids])
        assert ids.tolist() == reference.encode(texts[doc], add_special_tokens=False).ids + [0]
        assert (pieces.doc_tokens == len(ids)).all()
        assert pieces.start.tolist() == np.concatenate(([0], pieces.length.cumsum()[:-1])).tolist()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == np.concatenate(([0], seq.length.cumsum()[:-1])).tolist()
        assert seq.length.sum() <= 1024


def test_best_fit_decreasing_takes_the_tightest_window():
    rnd = random.Random(1)
    lengths = np.array([rnd.randint(1, 32) for _ in range(400)])
    window, offset = packing.best_fit_decreasing(lengths, 32)
    room = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        fits = [r for r in room.values() if r >= n]
        if fits:
            assert room[window[i]] == min(fits) and offset[i] == 32 - min(fits)
        else:
            assert window[i] not in room and offset[i] == 0
            room[window[i]] = 32
        room[window[i]] -= n


def test_vp_tree_is_exact_at_factor_one_and_ties_go_to_the_smaller_id():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 8)) * rnd.uniform(0.2, 3, size=(600, 1))
    x[50:90] = x[40]
    ids = rnd.permutation(600)
    tree = vp_search.build_tree(vp_search.lifted(x), 16)
    row, found, score = vp_search.search_tree(tree, ids, x, ids[:80], x[:80], 10, 1.0)
    for q in range(80):
        s = np.einsum("ij,j->i", x, x[q])
        s[q] = -np.inf
        exp = np.lexsort((ids, -np.round(s, 9)))[:10]
        assert set(found[row == q]) == set(ids[exp])
        assert np.allclose(score[row == q], s[exp])


def test_vp_search_recall_and_unusable_vectors(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [1.0] * 31 + [None]), (None, [1.0] * 32), (2080, []), rows[7]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    usable = vp_search.usable(df)
    assert usable.count() == 900
    got = vp_search.nearest(usable, usable.where("vec_id % 20 = 0"), 20, shard_rows=300, leaf=32, block_rows=20).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(g.vec_id) & set(np.argsort(-s)[:20]))
        assert sorted(g["rank"]) == list(range(1, 21))
    assert hits >= 0.9 * 20 * 45
    assert vp_search.nearest(usable.limit(0), usable.limit(0)).count() == 0


def test_base_statistics(docs):
    got = quality_rules.base_statistics(docs).collect()
    for r in got:
        assert tuple(r[c] for c in quality_rules.BASE) == B.text_statistics(r["text"])


def test_decision_list_learns_planted_rules(spark):
    rnd = np.random.default_rng(4)
    a, b, c = rnd.uniform(size=(3, 3000))
    bad = (a > 0.8) | ((b > 0.6) & (c < 0.2))
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "quality": np.where(bad, 0, 1)})
    df = spark.createDataFrame(pdf)
    rules = quality_rules.learn(df, feature_cols=["a", "b", "c"])
    judged = df.withColumn("kept", rules.verdict()).toPandas()
    assert ((judged.quality == 0) == ~judged.kept).mean() > 0.95
    assert "a >=" in str(rules)
    assert not quality_rules.learn(df.where("quality = 1"), feature_cols=["a", "b", "c"]).rules
    assert not quality_rules.learn(df.limit(0), feature_cols=["a", "b", "c"]).rules


def test_chat_round_trip_with_parts(spark):
    hard = "\\### Assistant: </turn> ok <image> \\l\\h\\b \n### x\n</turn>\n"
    part = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    rows = [
        (1, 0, "user", [part("text", hard), part("image", ref="a.png"), part("text", "b"), part("Audio", ref="c.wav", n=7)]),
        (1, 1, "assistant", [part("text", hard)]),
        (1, 2, "assi\nstant", [part("text", "no loss")]),
        (1, 3, "assistant", [part("text", "é\U0001f600"), part("document", ref="d")]),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PART_TYPE}")
    made = {r["conv_id"]: r for r in chat_format.format_messages(df).select(
        "*", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()}
    one = made[1]
    assert [t["role"] for t in one["turns"]] == ["user", "assistant", "assi\nstant", "assistant"]
    assert one["turns"][0]["text"] == hard + "<image>b<audio>" and one["turns"][1]["text"] == hard
    assert one["loss"] == hard + "é\U0001f600<document>"
    assert [tuple(a) for a in one["attachments"]] == [(0, "image", "a.png", 256), (0, "audio", "c.wav", 7), (3, "document", "d", 512)]
    assert made[None]["turns"][0]["text"] == "" and made[None]["loss"] == ""


@pytest.mark.parametrize("unit, length, run", [
    ("byte", 100, run_length_index.drop_repeated_bytes), ("byte", 30, run_length_index.drop_repeated_bytes),
    ("word", 20, relative_lz.drop_repeated_words), ("word", 5, relative_lz.drop_repeated_words),
])
def test_repeats_match_brute_force(docs, unit, length, run):
    exp = B.remove_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], length, unit)
    for r in run(docs, length).collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_symbols"], removed, len(r["spans"]), r["kept_sha256"]) == exp[r["doc_id"]]
        if r["kept"] is not None:
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_crowded_anchors_take_the_window_way(docs, monkeypatch):
    from txrisk.llm import repeats

    monkeypatch.setattr(repeats, "CROWDED_CLASSES", 1)
    exp = B.remove_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 20, "word")
    for r in relative_lz.drop_repeated_words(docs, 20).collect():
        assert (r["n_symbols"], r["kept_sha256"]) == (exp[r["doc_id"]][0], exp[r["doc_id"]][3])


def test_run_length_index_statistics_and_owners():
    rnd = np.random.default_rng(0)
    common = lambda b, x, y: next((k for k in range(len(b)) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b)), 0)
    for _ in range(40):
        t = rnd.integers(97, 97 + rnd.integers(1, 4), rnd.integers(1, 120)).astype(np.uint8)
        b = t.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        assert list(run_length_index.suffix_order(t)) == order
        (up, up_len), _ = run_length_index.RunLengthIndex(t).statistics()
        for above, i in zip(order, order[1:]):
            assert up_len[i] == common(b, i, above)
        h = rnd.integers(0, rnd.integers(2, 30), rnd.integers(1, 60)).astype(np.uint64)
        w = int(rnd.integers(1, 10))
        own = [p for a, z, p in zip(*owners(h, w)) for _ in range(a, z + 1)]
        assert own == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]
    s = rnd.integers(0, 1 << 60, 50, dtype=np.uint64)
    s[30:40] = s[5:15]
    for k in (1, 3, 7, 10):
        g = gram_hashes(s, k)
        assert len(g) == 51 - k and g[30] == g[5] and len(set(g.tolist())) == 51 - k - (11 - k)


def test_url_rules_and_terms(spark):
    urls = [
        "http://A.com/x", "https://example.com/en/1?a#b", "https://www.example.com/en/1", "http://x.net/es/1", "http://free.org/win",
        "http://casino.org", "http://freebets.org/winner", "no scheme casino", None, "", "ftp://u://x.net/fr/", "http://com", "http://xcom/",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    df = df.withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, queries.URL_RULES).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][2:] == (None, "block") and got[5] == ("casino.org", "", None, "block") and got[6][3] == "allow"
    assert got[7] == ("", "", None, "block") and got[8] == got[9] == ("", "", None, "allow")
    assert got[10][0] == "u:" and got[11][2] is None and got[12][2] is None
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    # only ASCII letters and digits continue a word, as in the SQL
    assert url_filter.count_terms("x://\u00e9casino\u00df/win\u0663/1free/HOT", url_filter.STRICT, url_filter.SOFT) == (1, 2)


@pytest.mark.parametrize("make", [run_length_index.byte_unit, relative_lz.word_unit])
def test_window_lengths_that_do_not_fit_are_refused(make):
    for length in (0, -1, 281):
        with pytest.raises(ValueError):
            make(length)


def test_simhash_matches_brute_force(docs):
    rows = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: B.simhash(t) for i, t in texts.items()}
    assert all(rows[i]["fingerprint"] % (1 << 64) == p for i, p in prints.items())
    exp = B.components(list(prints), list(prints.values()))
    assert {i: r["component_id"] for i, r in rows.items()} == exp
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs).collect()}
    assert kept == set(exp.values())


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("task", [1 << 21, 1 << 12])
def test_close_links_lose_no_pair(spark, distance, task, monkeypatch):
    if distance == 5 and task == 1 << 12:
        pytest.skip("slow")
    monkeypatch.setattr(simhash_dedup, "TASK_VARIANTS", task)
    rnd = random.Random(distance)
    prints = [rnd.getrandbits(64) for _ in range(12)]
    for p in list(prints):
        for _ in range(2):
            q = p
            for bit in rnd.sample(range(64), rnd.randint(1, 6)):
                q ^= 1 << bit
            prints.append(q)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash_dedup.close_links(df, distance).collect()
    index = {p: i for i, p in enumerate(signed)}
    exp = B.components(list(range(len(prints))), prints, distance)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(index[a]), find(index[b])))
        root[y] = x
    assert {i: find(i) for i in range(len(prints))} == exp


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets_match_brute_force_and_link_weak_parts(spark, docs):
    hard = [
        "password=token:abcdef token = 'abcdefgh' é\U0001f600 API_KEY:\"q-w/e.r=t\" secretsecret: 12345",
        "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 20 + " " + "0a" * 12 + "g" + "f" * 24, "pass\u017fwd: abcdefgh",
    ]
    texts = hard + [r["text"] for r in docs.limit(20).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    strong = {p.kind for p in secret_scan.STRONG}
    for r in secret_scan.scan_secrets(df, keep_text=True).collect():
        got = [(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["kind"] in strong]
        assert got == B.base_secrets(r["text"])
    rows = [
        (1, "user: jane pwd: s3cr3t at https://db.example.org/x"), (2, "user: jane was here"), (3, "pwd: lonely"),
        (4, "user: jane" + " far" * 100 + " pwd: s3cr3t"), (5, "see https://example.org/page only"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in secret_scan.scan_secrets(df).collect()}
    assert found == {1: ["weak_id", "weak_secret", "endpoint"], 2: [], 3: [], 4: [], 5: []}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert clean[1] == "[SECRET] [SECRET] at [SECRET]" and clean[2] == rows[1][1]


def test_secrets_of_a_text_with_very_many_matches(spark):
    """Matches on both sides of every stretch of running totals, overlapping
    spans, and weak candidates hidden by strong ones; in a time that grows with
    the matches."""
    rnd = random.Random(3)
    hexes = ["".join(rnd.choices("0123456789abcdef", k=24)) for _ in range(32_000)]
    texts = [
        " é".join(hexes),
        " ".join(f"token={h} " if i % 3 else f"user: secret:{h} https://ex.org/{h}" for i, h in enumerate(hexes[:3000])),
        " ".join(f"x{i} " + h for i, h in enumerate(hexes[:256])), " ".join(hexes[:257]) + " end", "none",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    strong = {p.kind for p in secret_scan.STRONG}
    found = {r["doc_id"]: r["secrets"] for r in secret_scan.scan_secrets(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    for i, text in enumerate(texts):
        assert [(s["start"], s["end"], s["kind"]) for s in found[i] if s["kind"] in strong] == B.base_secrets(text)
        at, out = 0, []
        for s in found[i]:
            if s["start"] >= at:
                out += [text[at : s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        assert clean[i] == "".join(out) + text[at:]
    # "user: secret:..." and the endpoints overlap strong spans, so they are no candidates
    assert {s["kind"] for s in found[1]} == {"assign", "hex"}


def test_near_duplicates_keep_a_row_of_each_component(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [
        (1, a, "x"), (1, b, "x"), (2, b, "x"), (None, a, "x"), (3, a, "y"), (1, a, "x"),
        (None, "lonely words here", "x"), (None, "lonely words here", "x"), (None, None, None), (4, "", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = simhash_dedup.drop_near_duplicates(df)
    got = sorted(map(tuple, kept.collect()), key=str)
    assert kept.columns == df.columns
    assert got == sorted([(1, a, "x"), (1, b, "x"), (None, "lonely words here", "x"), (4, "", "x")], key=str)


def test_pipeline_stages_with_odd_and_empty_documents(spark):
    """Columns named like those that the stages make come out as they went in."""
    import corpus_pipeline

    clash = ["copy", "copies", "doc", "row", "quality", "base_failed", "draw"]
    docs = _odd(spark).select("*", *[F.lit("clash").alias(c) for c in clash])
    prints = [B.simhash(r["text"] or "") for r in docs.collect()]
    groups = len(set(B.components(range(len(prints)), prints).values()))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        if name == "packing":
            continue
        assert made.columns[: len(docs.columns)] == docs.columns
        rows = made.collect()
        assert all(r[c] == "clash" for r in rows for c in [*clash, "topic", "weight", "n_words", "__key"])
        assert name in ("quality_rules", "mixing") or len(rows) == {"secret_scan": len(prints), "simhash_near_dedup": groups}[name]
    mixed = corpus_pipeline.mixing(spark, docs, "")
    packed = corpus_pipeline.pack(spark, mixed, "").count()
    assert mixed.columns[-1] == "copy_" and packed >= mixed.count()


def test_raking_meets_the_margins_and_samples_them(spark):
    rnd = np.random.default_rng(6)
    n = 6000
    pdf = pd.DataFrame({
        "doc_id": range(n), "text": ["w " * int(k) for k in rnd.integers(1, 40, n)], "lang": rnd.choice(["en", "de", None], n, p=[0.7, 0.2, 0.1]),
        "source": np.where(rnd.random(n) < 0.4, "hot", rnd.choice(["a", "b", "c"], n)), "n_chars": 1,
    })
    targets = {"source": None, "lang": {"en": 0.5, "de": 0.4, mixing.MISSING: 0.1}}
    got = mixing.mix(spark.createDataFrame(pdf), targets, share=0.2).toPandas()
    got["mass"] = got.n_tokens * got.weight
    total = got.mass.sum()
    assert total == pytest.approx(got.n_tokens.sum(), rel=1e-3)
    for dim, goal in (("source", {"hot": 0.25, "a": 0.25}), ("lang", {"en": 0.5, "de": 0.4})):
        for name, share in goal.items():
            assert got[got[dim] == name].mass.sum() / total == pytest.approx(share, abs=1e-3)
            kept = got[got.sampled]
            assert kept[kept[dim] == name].n_tokens.sum() / kept.n_tokens.sum() == pytest.approx(share, abs=0.05)
    assert got[got.sampled].n_tokens.sum() / got.n_tokens.sum() == pytest.approx(0.2, abs=0.03)


def test_the_sample_meets_the_margins_at_the_production_share(spark):
    """Rare languages and topics weigh far over 1 / share, so rows come in several copies."""
    import corpus_pipeline

    rnd = np.random.default_rng(8)
    n = 8000
    mark = {"prose": "", "legal": " licens", "contact": " a@b", "table": " |"}
    topic = rnd.choice(list(mark), n, p=[0.94, 0.02, 0.02, 0.02])
    pdf = pd.DataFrame({
        "doc_id": range(n), "text": ["w " * int(k) + mark[t] for k, t in zip(rnd.integers(5, 40, n), topic)],
        "lang": rnd.choice(["en", "de", "fr", "es"], n, p=[0.88, 0.04, 0.04, 0.04]), "source": rnd.choice(["a", "b"], n, p=[0.8, 0.2]),
        "n_chars": 1,
    })
    rows = corpus_pipeline.mixing(spark, spark.createDataFrame(pdf), "").toPandas()
    tokens = rows.text.str.split().str.len()
    for name, share in {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}.items():
        assert tokens[rows.lang == name].sum() / tokens.sum() == pytest.approx(share, abs=0.02)
    for name, share in {"legal": 0.1, "contact": 0.1, "table": 0.1}.items():
        assert tokens[rows.text.str.contains(mark[name], regex=False)].sum() / tokens.sum() == pytest.approx(share, abs=0.02)
    assert tokens.sum() / pdf.text.str.split().str.len().sum() == pytest.approx(0.5, abs=0.02)
    assert rows.groupby("doc_id").size().max() > 2 and not rows.duplicated(["doc_id", "copy"]).any()
    mixed = queries.mixed(spark.createDataFrame(pdf)).toPandas()
    assert (mixed.sampled == (mixed.copies > 0)).all()
    assert (mixed.copies - 0.5 * mixed.weight).abs().max() < 1


def test_copies_are_packed_each_and_dealt_over_shards(spark):
    df = spark.range(40).selectExpr("7L AS doc_id", "'some words here' AS text", "id + 1 AS copy")
    got = packing.pack(df, _vocabulary(), docs_per_shard=10, copy_col="copy").toPandas()
    assert len(got) == 40 and not got.duplicated(["sequence_id", "offset"]).any()
    assert (got.sequence_id // 2**32).nunique() > 1
