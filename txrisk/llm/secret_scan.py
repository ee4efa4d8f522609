"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong patterns are reported wherever they match. Weak candidates (account
names, short passwords, mixed tokens, endpoints) are common in clean text, so
they are reported only where complementary parts of a credential lie within
one scope: an interval join of every part's scope with the weak candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm._common import blocks_of, let, materialise, running

_GAP = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Pattern:
    """Leftmost non-overlapping matches of ``regex`` whose ``group`` has at
    least ``least`` characters. ``part`` is id, secret or endpoint."""

    kind: str
    regex: str
    least: int
    part: str
    group: int = 0


#: Reported wherever they match; the order breaks ties of the start.
STRONG = (
    Pattern("assign", rf"((?i:password|passwd|secret|token|api_?key)){_GAP}([A-Za-z0-9+/_.=-]+)", 6, "secret", 2),
    Pattern("access", r"AKIA[A-Z0-9]{16,}", 20, "id"),
    Pattern("hex", r"[0-9a-f]{24,}", 24, "secret"),
)
#: Reported only beside complementary parts.
WEAK = (
    Pattern(
        "weak_id",
        rf"((?i:client_?id|access_?id|key_?id|user_?name|user|login|account)){_GAP}([A-Za-z0-9._@+-]+)", 3, "id", 2,
    ),
    Pattern("weak_secret", rf"((?i:pwd|pass_?phrase|pass|auth|credential|private_?key)){_GAP}([^\x20\x09-\x0D\"']+)", 4, "secret", 2),
    Pattern("endpoint", r"(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+", 10, "endpoint"),
)
#: Which other parts make a weak candidate of a part worth reporting (any of them; an endpoint needs all).
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
RANK = {p.kind: i for i, p in enumerate((*STRONG, *WEAK))}
#: Code points between the starts of two parts of one scope.
SCOPE = 200

SPAN = "struct<start:int,rank:int,end:int,kind:string,part:string>"


def matches(text: Column, pattern: Pattern) -> Column:
    """array<SPAN> of a pattern's matches (code points, end exclusive). A
    regex split gives what lies between matches, so positions are running sums
    of lengths."""
    none = F.array().cast(f"array<{SPAN}>")

    def place(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern.regex, -1), F.char_length), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"), F.char_length(h).alias("size")))
        return let(pairs, spans)

    def spans(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: p["gap"] + p["size"]), lambda a, b: a + b)
        placed = F.zip_with(
            pairs, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), p["size"].alias("size"), p["hit"].alias("hit"))
        )
        value = lambda p: p["hit"] if not pattern.group else F.regexp_extract(p["hit"], pattern.regex, pattern.group)
        return F.transform(
            F.filter(placed, lambda p: F.char_length(value(p)) >= pattern.least),
            lambda p: F.struct(
                p["start"].alias("start"), F.lit(RANK[pattern.kind]).alias("rank"), (p["start"] + p["size"]).alias("end"),
                F.lit(pattern.kind).alias("kind"), F.lit(pattern.part).alias("part"),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    return F.when(text.rlike(pattern.regex), let(found, place)).otherwise(none)


def find_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus __key (digest of the text), __strong spans and __weak candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    strong = F.concat(*[matches(text, p) for p in STRONG])
    weak = F.concat(*[matches(text, p) for p in WEAK])
    return docs.withColumns({"__key": F.sha2(text, 256), "__strong": F.sort_array(strong), "__weak": weak})


def _by_bucket(spans: DataFrame, column: str, scope: int, margin: int = 0) -> DataFrame:
    """One row per span and bucket of ``scope`` code points that it touches,
    widened by ``margin`` on both sides."""
    first = F.floor((F.col(f"{column}.start") - margin) / scope)
    last = F.floor((F.col(f"{column}.end") - 1 + margin) / scope)
    return spans.withColumn("bucket", F.explode(F.sequence(first, last)))


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__key, __linked): the weak spans of each text that complementary parts
    support. Weak candidates that overlap a strong span are left out. Equal
    texts are looked at once. Spans and scopes are intervals dealt to the
    buckets they touch; matches of one pattern do not overlap, so a bucket
    holds a bounded number of them however long the text is."""
    texts = found.where(F.size("__weak") > 0).select("__key", "__strong", "__weak").dropDuplicates(["__key"])
    strong = texts.select("__key", F.explode("__strong").alias("s"))
    candidates = texts.select("__key", F.explode("__weak").alias("w"))
    beside = _by_bucket(candidates, "w", scope).join(_by_bucket(strong, "s", scope), ["__key", "bucket"])
    hidden = beside.where("s.start < w.end AND w.start < s.end").select("__key", "w")
    weak = materialise(candidates.join(hidden, ["__key", "w"], "left_anti"), "weak")
    parts = strong.select("__key", F.col("s").alias("p")).unionByName(weak.select("__key", F.col("w").alias("p")))
    starts = parts.select(
        "__key", F.col("p.part").alias("other"), F.col("p.start").alias("at"),
        F.struct(F.col("p.start").alias("start"), (F.col("p.start") + 1).alias("end")).alias("place"),
    )
    reach = _by_bucket(starts, "place", scope, margin=scope).drop("place")
    weak = weak.withColumn("bucket", F.floor(F.col("w.start") / scope))
    near = weak.join(reach, ["__key", "bucket"]).where(F.abs(F.col("at") - F.col("w.start")) <= scope)
    seen = near.groupBy("__key", "w").agg(
        *[F.max((F.col("other") == part).cast("int")).alias(f"has_{part}") for part in NEEDS]
    )
    part = F.col("w.part")
    linked = (
        ((part == "id") & (F.col("has_secret") == 1))
        | ((part == "secret") & ((F.col("has_id") == 1) | (F.col("has_endpoint") == 1)))
        | ((part == "endpoint") & (F.col("has_id") == 1) & (F.col("has_secret") == 1))
    )
    return seen.where(linked).groupBy("__key").agg(F.sort_array(F.collect_list("w")).alias("__linked"))


def _scan(docs: DataFrame, text_col: str, scope: int, keep_text: bool) -> DataFrame:
    """(doc, spans): each row's columns as a struct (with the text if asked
    for) and its spans. Every text is matched once: what was found is written
    down, and only rows with weak candidates look up their links."""
    cols = [c for c in docs.columns if keep_text or c != text_col] or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), F.col(text_col).alias("text"))
    found = materialise(find_parts(rows).select("doc", "__key", "__strong", "__weak"), "parts")
    plain = found.where(F.size("__weak") == 0).select("doc", F.col("__strong").alias("spans"))
    joined = found.where(F.size("__weak") > 0).join(link_parts(found, scope), "__key", "left")
    none = F.array().cast(f"array<{SPAN}>")
    both = F.sort_array(F.concat("__strong", F.coalesce("__linked", none)))
    return plain.unionByName(joined.select("doc", both.alias("spans")))


def scan_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) plus ``secrets``:
    array<SPAN> ordered by start, then kind.

    Null and empty texts have no spans; repeated rows keep a row each; a column
    named ``secrets`` is replaced; an empty table gives no rows.
    """
    return _scan(docs.drop("secrets"), text_col, scope, keep_text).select("doc.*", F.col("spans").alias("secrets"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _covered(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the spans (ordered by start, at least one) replaced by
    ``mark``. A stretch of spans cuts its own piece of the text first, so that
    no span looks for its place from the beginning."""
    ends = F.transform(spans, lambda s: s["end"])
    before = running(ends, F.greatest)
    marks = F.filter(
        F.zip_with(spans, before, lambda s, b: F.struct(b.alias("from"), s["start"].alias("to"))), lambda m: m["to"] >= m["from"]
    )

    def stretch(some: Column) -> Column:
        base, end = F.element_at(some, 1)["from"], F.element_at(some, -1)["to"]
        piece = let(
            F.substr(text, base + 1, end - base),
            lambda here: F.array_join(
                F.transform(some, lambda m: F.concat(F.substr(here, m["from"] - base + 1, m["to"] - m["from"]), F.lit(mark))), ""
            ),
        )
        return piece

    pieces = let(marks, lambda m: blocks_of(m, lambda some: let(some, stretch)))
    return F.concat(F.array_join(pieces, ""), F.substr(text, F.array_max(ends) + 1))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by
    one mark); columns as they were, whatever their names. Null texts stay null;
    repeated rows stay; an empty table gives no rows."""
    text = F.col("doc")[text_col]
    clean = F.when(F.size("spans") > 0, _covered(text, F.col("spans"), mark)).otherwise(text)
    scanned = _scan(docs, text_col, scope, keep_text=True)
    return scanned.select(*[clean.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
