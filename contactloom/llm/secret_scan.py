"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

A document version is a blob, addressed by the SHA-256 of its text. The ledger
holds one row for each blob and rule version scanned before, with what was
found. Only pairs that the ledger lacks are scanned, each blob once however
many paths share it, and findings are joined back to every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import stored

RULE_VERSION = 1
#: kind, pattern (Java), least length, group the length is taken of. The order is that of ties.
#: A run that falls short holds no later match that would do, so access and hex have
#: their lengths in the pattern; assign may, and is tested after matching.
BASE_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
)
#: What the method adds: secrets with a form of their own. No pattern repeats a group: Java matches those by recursion, which long texts would exhaust.
MORE_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("hook_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<s:int,k:int,e:int>>"


def matches(text: Column, pattern: str, kind: int, least: int) -> Column:
    """Leftmost non-overlapping matches in order: kind, code points since the match before, code points of its own, and whether it counts.

    The pieces between matches and the matches themselves alternate, so their
    lengths give every position. ``least`` is on the value of an assignment,
    its second group.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    fit = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda m: F.length(m) >= least) if least else F.transform(hits, lambda m: F.lit(True))
    found = F.zip_with(F.arrays_zip(gaps.alias("g"), hits.alias("h")), fit, lambda x, ok: F.struct(F.lit(kind).alias("k"), x["g"].alias("g"), x["h"].alias("h"), ok.alias("ok")))
    # the piece after the last match has none
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(found, lambda x: x["h"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<k:int,g:int,h:int,ok:boolean>>)"))


def scan(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``(blob, found)`` for ``blobs(blob, text)``, a row for each blob: all spans by start, then kind.

    Positions are running sums over a blob's matches, so the work is in
    proportion to them; a blob without a match is one row.
    """
    each = blobs.select("blob", F.posexplode_outer(F.concat(*[matches(F.col("text"), pattern, k, least) for k, (_, pattern, least) in enumerate(rules)])).alias("pos", "x"))
    end = F.sum(F.col("x.g") + F.col("x.h")).over(Window.partitionBy("blob", "x.k").orderBy("pos")).cast("int")
    placed = each.select("blob", "x", end.alias("e"))
    span = F.struct((F.col("e") - F.col("x.h")).alias("s"), F.col("x.k").alias("k"), F.col("e").alias("e"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("x.ok"), span))).alias("found"))


def with_blob(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the content address of its text; null is the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("blob", F.sha2(text.cast("binary"), 256))


def unseen(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """``(blob, text)`` of every distinct blob that the ledger has no scan of under this rule version."""
    found = with_blob(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        found = found.join(seen, "blob", "left_anti")
    # copies meet in the map stage first, so a blob that many paths share is sent once a task
    return found.groupBy("blob").agg(F.first("text").alias("text"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows ``(blob, rule_version, found)`` to append for ``docs``: new blobs, clean ones included.

    ``docs`` may hold any number of versions of a path, in any order; repeated
    rows and null texts are fine, an empty table adds nothing.
    """
    return scan(unseen(docs, ledger, text_col, rule_version), rules).select("blob", F.lit(rule_version).alias("rule_version"), "found")


def findings(docs: DataFrame, ledger: DataFrame, keys: list[str], text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Every row of ``docs`` as ``keys`` with the spans that the ledger, with one row for each blob and rule version, has for its blob, an empty list if none."""
    paths = with_blob(docs.select(*keys, F.col(text_col).alias("text_")), "text_").drop("text_")
    dirty = ledger.where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob", "found")
    return paths.join(dirty, "blob", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {SPAN})")))


def rendered(found: Column, rules: tuple = RULES) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: Column) -> list[Column]:
    """The contract's columns of a span list."""
    base = F.filter(found, lambda x: x["k"] < len(BASE_RULES))
    of_kind = lambda k: F.filter(found, lambda x: x["k"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{r[0]}") for k, r in enumerate(BASE_RULES)]
    return [*counts, F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"), rendered(found).alias("spans")]


def secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, digest and spans of its text.

    Null or empty texts have no spans; rows without an id, repeated rows and
    copies each get the findings of their text; other columns are ignored. A
    ledger may name a blob and rule version more than once.
    """
    # a written ledger has a known size, and joins its paths by an exchange of its own, so that a blob with many paths can be split
    new = stored(update_ledger(docs, ledger, text_col))
    whole = new if ledger is None else stored(ledger.select(new.columns).unionByName(new).dropDuplicates(["blob", "rule_version"]))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return findings(slim, whole, ["doc_id"], "text").select("doc_id", *digest(F.col("found")))


SQL = r"""
WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
rules AS (
  SELECT * FROM (VALUES
    ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('access', 1, 'AKIA[A-Z0-9]{12,}'), ('hex', 2, '[0-9a-f]{32,}'),
    ('private_key', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
    ('jwt', 4, '\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
    ('forge_token', 5, '\bgh[pousr]_[A-Za-z0-9]{36,}'), ('hook_token', 6, '\bxox[abprs]-[A-Za-z0-9-]{10,}')) AS r(kind, k, pattern)),
m AS (
  SELECT text, kind, k, hits, values_, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT text, kind, k, string_split_regex(text, pattern) AS gaps,
           regexp_extract_all(text, pattern, 0) AS hits,
           CASE WHEN k = 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) END AS values_
    FROM t, rules WHERE regexp_matches(text, pattern))),
s AS (
  SELECT text, kind, k, length(hits[i]) AS n,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x)))::BIGINT, 0) AS b
  FROM m WHERE k <> 0 OR length(values_[i]) >= 8),
f AS (
  SELECT text, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, k) FILTER (k < 3), '') AS base,
         string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, k) AS spans
  FROM s GROUP BY text)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN f ON f.text = coalesce(d.text, '')
"""
