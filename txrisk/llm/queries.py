"""Registered queries of the operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import (
    chat_format, lexical_search, mixing, packing, quality_rules, relative_lz, run_length_index, secret_scan,
    simhash_dedup, token_alignment, token_counts, url_filter, vp_search,
)
from txrisk.llm._common import table

#: Where executors find the public vocabularies (a parameter of the queries).
VOCABULARY = "byte_bpe_50k.json"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha256(value) -> Column:
    return F.sha2(value, 256)


# -- op1 ---------------------------------------------------------------------


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# -- op2 ---------------------------------------------------------------------


def op2_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vp_search.usable(table(spark, sf_dir, "embeddings"))
    found = vp_search.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", "vec_id", "score")


# -- op3 ---------------------------------------------------------------------


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


# -- op4 ---------------------------------------------------------------------

PROBE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = rows.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    messages = rows.unionByName(probe).withColumn("parts", chat_format.text_parts(F.col("text")))
    made = chat_format.format_messages(messages)
    made = made.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    made = made.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(said).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        _sha256(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h')"
OP4_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, {_ESC.format('text')} AS esc, replace({_ESC.format('role')}, chr(10), '\\n') AS esc_role FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, esc)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, esc) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.HEAD)} + length(esc_role) + 1 + length(esc) + {len(chat_format.TAIL)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


# -- op5 ---------------------------------------------------------------------


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = run_length_index.drop_repeated_bytes(table(spark, sf_dir, "documents"), 100)
    return cut.select(
        "doc_id",
        F.col("n_symbols").alias("n_bytes"),
        _removed("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def _removed(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


# -- op6 ---------------------------------------------------------------------

URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _op6_sql() -> str:
    def fits(rule: str) -> str:
        domain, slash, rest = rule.partition("/")
        return f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}'))"

    longest = sorted(URL_RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for a, r in longest) + " END"

    def count(terms) -> str:
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)

    return f"""
WITH s AS (
  SELECT page_id, coalesce(url, '') AS u0, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT *, lower(u0) AS u, regexp_extract(rest, '^[^/?#]*') AS host0 FROM s),
p AS (SELECT page_id, u, lower(host0) AS host, regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {rule} AS rule, ({count(url_filter.STRICT)})::INT AS n_strict, ({count(url_filter.SOFT)})::INT AS n_soft FROM p)
SELECT page_id, host, path, rule,
  coalesce({action}, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft FROM r
"""


# -- op7 ---------------------------------------------------------------------


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = relative_lz.drop_repeated_words(table(spark, sf_dir, "documents"), 20)
    return cut.select("doc_id", F.col("n_symbols").alias("n_words"), _removed("spans").alias("n_removed"), "kept_sha256")


# -- op8 ---------------------------------------------------------------------


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return classes.select("doc_id", digits.alias("fingerprint"), "component_id")


# -- op9 ---------------------------------------------------------------------


def _count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secret_scan.scan_secrets(docs)
    strong = [p.kind for p in secret_scan.STRONG]
    base = F.filter("secrets", lambda s: s["kind"].isin(*strong))
    counts = [_count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in strong]
    return scanned.select(
        "doc_id",
        *counts,
        _sha256(secret_scan.spans_text(base)).alias("base_sha256"),
        secret_scan.spans_text(F.col("secrets")).alias("spans"),
    )


# -- op10 --------------------------------------------------------------------

#: Target shares of tokens; None: equal shares for all present.
MIX_TARGETS = {
    "source": None,
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"prose": 0.7, "legal": 0.1, "contact": 0.1, "table": 0.1},
}
MIX_SHARE, MIX_ROUNDS, MIX_SEED = 0.5, 20, 7


def topic_of(text=None):
    """A coarse topic by markers in the text."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    return (
        F.when(text.contains("|"), "table")
        .when(text.contains("licens"), "legal")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, MIX_TARGETS, MIX_SHARE, topic_of(), MIX_SEED, MIX_ROUNDS)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    cols = ["doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "draw", "sampled"]
    return mixed(docs).select(*cols)


def op10_sample_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself: one row per copy of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.sample(mixed(docs)).select("doc_id", "source", "lang", "topic", "n_tokens", "copy")


def _op10_sql() -> str:
    dims = list(MIX_TARGETS)
    ctes = [
        r"""t AS (SELECT doc_id, source, lang,
  CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN contains(coalesce(text, ''), 'licens') THEN 'legal'
       WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
        "d AS (SELECT *, " + ", ".join(f"coalesce({k}, '{mixing.MISSING}') AS k_{k}" for k in dims) + " FROM t)",
        "c0 AS (SELECT " + ", ".join(f"k_{k}" for k in dims) + ", sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for k, shares in MIX_TARGETS.items():
        value = "1.0" if shares is None else (
            "CASE " + " ".join(f"WHEN k_{k} = '{n}' THEN {s}" for n, s in shares.items()) + f" ELSE {mixing.UNNAMED} END"
        )
        ctes.append(f"n_{k} AS (SELECT k_{k}, {value}::DOUBLE AS s FROM c0 GROUP BY k_{k} HAVING sum(tokens) > 0)")
        ctes.append(f"t_{k} AS (SELECT k_{k}, s / (SELECT sum(s) FROM n_{k}) AS to_{k} FROM n_{k})")
    ctes.append(
        "f0 AS (SELECT c0.*, tokens / (SELECT sum(tokens) FROM c0) AS w, " + ", ".join(f"to_{k}" for k in dims) + " FROM c0 "
        + " ".join(f"LEFT JOIN t_{k} USING (k_{k})" for k in dims) + ")"
    )
    step = 0
    for _ in range(MIX_ROUNDS):
        for k in dims:
            held = f"sum(w) OVER (PARTITION BY k_{k})"
            ctes.append(
                f"f{step + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {held} > 0 THEN w * to_{k} / {held} ELSE 0 END AS w) FROM f{step})"
            )
            step += 1
    weight = f"round(CASE WHEN tokens > 0 THEN w * (SELECT sum(tokens) FROM c0) / tokens ELSE 0 END, 6)"
    ctes.append("o AS (SELECT " + ", ".join(f"k_{k}" for k in dims) + f", {weight} AS weight FROM f{step})")
    draw = f"('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}::DOUBLE"
    odds = f"least(1.0, round({MIX_SHARE} * weight, 6))"
    return (
        "WITH " + ",\n".join(ctes)
        + f"\nSELECT doc_id, source, lang, topic, n_tokens, weight, {odds} AS probability, {draw} AS draw, {draw} < {odds} AS sampled"
        + " FROM d JOIN o USING (" + ", ".join(f"k_{k}" for k in dims) + ")"
    )


def _op10_sample_sql() -> str:
    rate = f"round({MIX_SHARE} * weight, 6)"
    copies = f"(floor({rate}) + (draw < {rate} - floor({rate}))::INT)::BIGINT"
    return (
        f"SELECT doc_id, source, lang, topic, n_tokens, unnest(generate_series(1, {copies})) AS copy FROM ({_op10_sql()})"
    )


# -- op11 --------------------------------------------------------------------


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.link_statistics(docs, vocabulary_path(BYTE_BPE), vocabulary_path(PIECE_BPE))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# -- op12 --------------------------------------------------------------------


def op12_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary_path(PIECE_BPE), limit=4096)


# -- op13 --------------------------------------------------------------------


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op13_sql() -> str:
    held = (
        r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    ).format(_ASCII_UPPER, _ASCII_LOWER)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {held} AS terms FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
q AS (SELECT row_number() OVER () AS place, item_id, unnest(list_distinct({held})) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, big_n),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * big_n) // big_l AS m FROM d, s WHERE len(terms) > 0),
x AS (SELECT place, item_id, r, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank FROM x)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_pack_best_fit": (op1_pack_best_fit, None),
    "op2_vp_search": (op2_vp_search, None),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_chat_format": (op4_chat_format, OP4_SQL),
    "op5_run_length_dedup": (op5_run_length_dedup, None),
    "op6_url_filter": (op6_url_filter, _op6_sql()),
    "op7_relative_lz": (op7_relative_lz, None),
    "op8_simhash_dedup": (op8_simhash_dedup, None),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_mix_sources": (op10_mix_sources, _op10_sql()),
    "op10_sample_sources": (op10_sample_sources, _op10_sample_sql()),
    "op11_align_tokens": (op11_align_tokens, None),
    "op12_count_tokens": (op12_count_tokens, None),
    "op13_ranked_search": (op13_ranked_search, _op13_sql()),
}
