"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong parts (assignments, access keys, long hex) always count.  Weak parts
(identifiers, opaque keys, endpoints) count only if a part that completes them
lies within ``SCOPE`` code points: an identifier or endpoint near a secret, a key
near an identifier or endpoint.  The interval join is a sweep over the parts of a
text by start: it keeps the furthest end before and the next start after each
part, so it never forms pairs.

Defined cases: null texts are empty and have no parts; of a document repeated
with the same id and text each row gets the same result; a key that overlaps a
strong part is no part of its own; parts with equal start go by kind; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200


def _any_case(text: str) -> str:
    """Letters of a pattern in either case, as classes that all regex engines read alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


ASSIGN = (
    f"({_any_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
IDENTIFIER = (
    f"({_any_case('username|user|login|account|client_?id|access_?key_?id')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@+-]+)"
)
#: kind, pattern, group that must be long enough, least length
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("identifier", IDENTIFIER, 2, 3),
    ("key", "[A-Za-z0-9+/]{20,}={0,2}", 0, 20),
    ("endpoint", "[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?@%-]+", 0, 10),
)
#: Runs of one class are maximal, so a bound in the pattern finds the same long ones and skips the many short ones.
_BOUNDED = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
_BASE = 3
_SECRETS, _IDENTIFIERS, _ENDPOINTS = (0, 2, 4), (1, 3), (5,)


def _found(text: Column, number: int) -> Column:
    """Array of (kind, number of the match, code points before it since the last match, its length)."""
    kind, pattern, group, least = KINDS[number]
    pattern = _BOUNDED.get(kind, pattern)

    def part(before: Column, match: Column) -> Column:
        value = match if group == 0 else F.regexp_extract(match, pattern, group)
        good = F.length(value) >= least
        if kind == "key":
            good = good & match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
        return F.struct(F.length(before).alias("before"), F.length(match).alias("n"), good.alias("good"))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part)
    numbered = F.transform(
        pairs,
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), x["before"].alias("before"), x["n"].alias("n"), x["good"].alias("good")
        ),
    )
    return F.when(text.rlike(pattern), numbered).otherwise(F.array().cast("array<struct<kind:int,i:int,before:int,n:int,good:boolean>>"))


def parts(docs: DataFrame) -> DataFrame:
    """All reported parts: doc_id, text_hash, kind (number), start, stop, and the furthest stop before it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_found(text, k) for k in range(len(KINDS))])
    rows = (
        docs.select("doc_id", F.xxhash64(text).alias("text_hash"), found.alias("found"))
        .where(F.size("found") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", F.inline("found"))
        .where(F.col("n").isNotNull())
    )
    text_key = ["doc_id", "text_hash"]
    so_far = Window.partitionBy(*text_key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("before") + F.col("n")).over(so_far)
    spans = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n")).where("good")
    earlier = Window.partitionBy(*text_key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*text_key).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    )

    def sweep(kinds: tuple[int, ...], name: str) -> dict[str, Column]:
        mine = F.col("kind").isin(*kinds)
        return {
            f"{name}_before": F.max(F.when(mine, F.col("stop"))).over(earlier),
            f"{name}_after": F.min(F.when(mine, F.col("start"))).over(later),
        }


    def near(name: str, gap: int) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{name}_before") <= gap, F.lit(False)) | F.coalesce(
            F.col(f"{name}_after") - F.col("stop") <= gap, F.lit(False)
        )

    # Touching parts do not overlap: a gap of -1 is one shared code point.
    strong = spans.select("*", *[c.alias(n) for n, c in sweep(tuple(range(_BASE)), "strong").items()])
    free = strong.where(~((F.col("kind") == 4) & near("strong", -1)))
    groups = {"secret": _SECRETS, "identifier": _IDENTIFIERS, "endpoint": _ENDPOINTS}
    swept = free.select("*", *[c.alias(n) for g, k in groups.items() for n, c in sweep(k, g).items()])
    linked = (
        F.when(F.col("kind") < _BASE, True)
        .when(F.col("kind") == 4, near("identifier", SCOPE) | near("endpoint", SCOPE))
        .otherwise(near("secret", SCOPE))
    )
    return swept.where(linked).select(
        *text_key, "kind", "start", "stop",
        F.coalesce(F.max("stop").over(earlier), F.lit(0)).alias("covered_to"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ","
    )


def _by_text(docs: DataFrame) -> DataFrame:
    return (
        parts(docs)
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "covered_to"))).alias("found"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document, as one row each."""
    left = _keyed(docs.select("doc_id", "text")).select("doc_id", "text_hash").alias("d")
    right = _by_text(docs).alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    found = F.coalesce(F.col("p.found"), F.array().cast("array<struct<start:long,kind:int,stop:long,covered_to:long>>"))
    rows = left.join(right, same, "left").select("d.doc_id", found.alias("found"))

    def number(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"] < _BASE)
    return rows.select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k][0]}") for k in range(_BASE)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every reported span replaced by ``mark``; overlapping spans share one mark."""
    left = _keyed(docs).alias("d")
    right = _by_text(docs.select("doc_id", "text")).alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    text, found = F.col("d.text"), F.col("p.found")
    before = F.transform(
        found,
        lambda s: F.when(
            (s["start"] >= s["covered_to"]) | (s["covered_to"] == 0),
            F.concat(text.substr((s["covered_to"] + 1).cast("int"), (s["start"] - s["covered_to"]).cast("int")), F.lit(mark)),
        ).otherwise(F.lit("")),
    )
    end = F.array_max(F.transform(found, lambda s: s["stop"]))
    rest = text.substr((end + 1).cast("int"), F.length(text))
    clean = F.when(found.isNull(), text).otherwise(F.concat(F.array_join(before, ""), rest))
    return left.join(right, same, "left").select(
        *[clean.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    )


def _sql_spans(number: int) -> str:
    kind, pattern, group, least = KINDS[number]
    quoted = pattern.replace("'", "''")
    value = "m" if group == 0 else f"regexp_extract(m, '{quoted}', {group})"
    good = f"length({value}) >= {least}"
    if kind == "key":
        good += " AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    return f"""
      SELECT row, {number} AS kind, stop - length(m) AS start, stop FROM (
        SELECT row, m, sum(length(g) + length(m)) OVER (PARTITION BY row ORDER BY i) AS stop FROM (
          SELECT row, unnest(gaps[:len(ms)]) AS g, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (
            SELECT row, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS ms FROM texts
          ))) WHERE {good}"""


def _sql_near(kinds: str, gap: int) -> str:
    """Another part of these kinds whose distance is at most ``gap``: written as a join, unlike the sweep."""
    return f"""EXISTS (SELECT 1 FROM spans o WHERE o.row = s.row AND o.kind IN ({kinds})
        AND (o.kind, o.start, o.stop) <> (s.kind, s.start, s.stop)
        AND ((o.start, o.kind) < (s.start, s.kind) AND s.start - o.stop <= {gap}
          OR (o.start, o.kind) > (s.start, s.kind) AND o.start - s.stop <= {gap}))"""


_NAMES = "CASE kind " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(KINDS)) + " END"
SECRETS_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
all_spans AS ({" UNION ALL ".join(_sql_spans(k) for k in range(len(KINDS)))}),
spans AS (
  SELECT * FROM all_spans s WHERE kind <> 4 OR NOT EXISTS (
    SELECT 1 FROM all_spans o WHERE o.row = s.row AND o.kind < 3 AND o.start < s.stop AND o.stop > s.start)
),
kept AS (
  SELECT row, kind, start, stop FROM spans s WHERE kind < 3
    OR kind = 4 AND ({_sql_near("1, 3", SCOPE)} OR {_sql_near("5", SCOPE)})
    OR kind IN (3, 5) AND {_sql_near("0, 2, 4", SCOPE)}
),
named AS (SELECT row, kind, start, {_NAMES} || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM kept)
SELECT doc_id,
  count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM texts LEFT JOIN named USING (row) GROUP BY row, doc_id
"""
