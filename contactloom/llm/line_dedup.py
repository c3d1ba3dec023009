"""Removal of repeated passages by content-defined line chunks, in DataFrame operations only.

A text's lines are hashed; lines are first wrapped at the ends of sentences. A
rolling hash over the hashes of two consecutive lines decides whether a piece
ends after the second, so that the pieces' boundaries move with the content: a
passage put into another document falls into the same pieces again, whatever
stands before it. A chunk is two consecutive pieces, so it has two lines or
more, and every line of a passage but those at its ends is in a chunk that lies
wholly within. Chunks that stand in several documents stay in the one of the
least doc_id and are removed from the others, after their bytes have been
compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import cut, dropped, released, stored

#: A piece ends after a line in EVERY of 16 on average; a chunk of fewer characters than LEAST is no passage.
EVERY, LEAST = 12, 50
#: A line: up to the end of a sentence after 40 characters or more, or to its newline. Lines joined are the text again.
LINE = r"[^\n]{40,}?[.!?] |[^\n]*(?:\n|\z)"
#: The rolling hash of lines x, y is (FACTOR x + y) modulo PRIME; a line's hash has 56 bits.
FACTOR, PRIME = 31, 2**61 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines of a text with what ends them; none if it is null or empty."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(0)), lambda x: x != "")


def key_of(line: Column) -> Column:
    """What is compared of a line: all but the space and newlines at its end."""
    return F.rtrim(line, F.lit(" \n"))


def line_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 14), 16, 10).cast("long")


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(text: Column, every: int = EVERY) -> Column:
    """The chunks of a text: ``b`` and ``e``, its lines from b up to e, and ``h``, a hash of its bytes."""

    def cut_at(keys: Column, hashes: Column) -> Column:
        n = F.size(keys)
        roll = lambda i: F.pmod(F.coalesce(F.get(hashes, i - 2), F.lit(0)) * FACTOR + F.get(hashes, i - 1), F.lit(PRIME))
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (roll(i) % 16 < every))

        def chunk(b: Column, e: Column) -> Column:
            return F.struct(b.alias("b"), e.alias("e"), chunk_hash(F.array_join(F.slice(keys, b + 1, e - b), "\n")).alias("h"))

        # from every beginning to the one after the next; the last piece is in the chunk before it
        firsts = lambda at: F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(1)))
        ends = lambda at: F.concat(F.slice(at, 3, F.size(at)), F.array(n))
        return let(begins, lambda at: F.zip_with(firsts(at), ends(at), chunk))

    found = let(F.transform(lines_of(text), key_of), lambda keys: let(F.transform(keys, line_hash), lambda hashes: cut_at(keys, hashes)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, found).otherwise(F.expr("cast(array() as array<struct<b:int,e:int,h:bigint>>)"))


def without(lines: Column, ranges: Column) -> Column:
    """``lines`` but those from b up to e for every one of ``ranges(b, e, ..)``, sorted by b and then e."""
    before = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda x: x["e"]))
    kept = F.zip_with(before, F.concat(F.transform(ranges, lambda x: x["b"]), F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    return F.flatten(kept)


def dedup(docs: DataFrame, every: int = EVERY, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with texts cleaned, and ``n_chunks``, ``n_removed``, ``n_removed_lines``; columns of these names are replaced.

    A null text stays null; it and an empty one have no chunks. Rows without an
    id, and rows of one id among themselves (copies or versions of one
    document), keep all they have; a passage repeated within one document stays
    there unless another document of a lesser id has it. All other columns are
    kept as they are, whatever they are called.

    Only hashes are exchanged to find what is repeated. Groups combine in the
    map stage, and what comes back to a chunk's rows is one row, so a chunk that
    a third of all documents share is neither gathered nor joined in one task.
    Texts are shuffled once, to meet the chunks found in them; the chunks' own
    bytes are then compared by the least and the greatest of each hash: if these
    are equal, so are all. Hashes for which they differ are decided by the
    chunks themselves.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"), F.struct("*").alias("row"))
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"), chunks(text, every).alias("c"))
    # the outer form, since for the other one the planner would cut every text twice, once to see that it has chunks
    each = stored(found.select("id", "version", F.size("c").alias("n"), F.explode_outer("c").alias("c")).where("c is not null").select("id", "version", "n", "c.*"))
    able = each.where((F.col("e") - F.col("b") >= 2) & F.col("id").isNotNull())
    # written, so that the join exchanges both sides and a hash of very many rows can be split
    groups = stored(able.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("h", "a"))
    # with one row for every text, which says how many chunks it has
    met = able.join(groups, "h").select("id", "version", F.lit(None).cast("int").alias("n"), F.struct("b", "e", "h", "a").alias("x"))
    own = each.where("b = 0").select("id", "version", "n", F.lit(None).cast(met.schema["x"].dataType).alias("x")).unionByName(met)
    own = stored(own.groupBy("id", "version").agg(F.max("n").alias("n_chunks"), F.array_sort(F.collect_set("x")).alias("found")).toDF("own_id", "own_version", "n_chunks", "found"))
    dropped(each, groups)
    released(docs.sparkSession)
    joined = rows.join(own, rows.id.eqNullSafe(own.own_id) & (rows.version == own.own_version), "left").select("id", "version", "row", "n_chunks", F.when(F.size("found") > 0, F.col("found")).alias("found"))
    joined = cut(joined)
    dropped(own)
    released(docs.sparkSession)
    said = joined.where("found is not null").select("id", "version", F.explode_outer(_spelled(text_col)).alias("x")).select("id", "version", "x.*")
    mixed = stored(said.groupBy("h").agg((F.min("t") != F.max("t")).alias("mixed")).where("mixed").select("h"))
    released(docs.sparkSession)
    none = F.expr("cast(array() as array<int>)")
    if mixed.isEmpty():
        dropped(mixed)
        joined = joined.withColumns({"doubted": none, "proven": none})
    else:
        joined = _proven(joined.drop("doubted", "proven"), said.join(mixed, "h"))
    return _cleaned(joined, text_col, least)


def _spelled(text_col: str) -> Column:
    """The chunks found in a text, with their bytes."""
    return let(F.transform(lines_of(F.col("row")[text_col].cast("string")), key_of), lambda keys: F.transform("found", lambda x: F.struct(x["b"].alias("b"), x["e"].alias("e"), x["h"].alias("h"), x["a"].alias("a"), F.array_join(F.slice(keys, x["b"] + 1, x["e"] - x["b"]), "\n").alias("t"))))


def _proven(joined: DataFrame, said: DataFrame) -> DataFrame:
    """``joined`` with where its chunks of ambiguous hashes begin, and which of these a lesser document has byte by byte."""
    firsts = said.groupBy("h", "t").agg(F.min("id").alias("first"))
    each = said.join(firsts, ["h", "t"]).groupBy("id", "version").agg(F.collect_set("b").alias("doubted"), F.collect_set(F.when(F.col("id") > F.col("first"), F.col("b"))).alias("proven"))
    return joined.join(each.withColumnsRenamed({"id": "p_id", "version": "p_version"}), (F.col("id") == F.col("p_id")) & (F.col("version") == F.col("p_version")), "left").drop("p_id", "p_version")


def _cleaned(joined: DataFrame, text_col: str, least: int) -> DataFrame:
    known = lambda x: ~F.coalesce(F.array_contains("doubted", x["b"]), F.lit(False)) | F.coalesce(F.array_contains("proven", x["b"]), F.lit(False))
    gone = F.filter(_spelled(text_col), lambda x: (F.col("id") > x["a"]) & known(x) & (F.length(x["t"]) >= least))

    def rest(lines: Column, ranges: Column) -> Column:
        kept = without(lines, ranges)
        return F.struct(F.size(ranges).alias("n"), (F.size(lines) - F.size(kept)).alias("lines"), F.array_join(kept, "").alias("t"))

    done = F.when(F.col("found").isNotNull(), let(lines_of(F.col("row")[text_col].cast("string")), lambda lines: let(gone, lambda ranges: rest(lines, ranges))))
    held = joined.withColumn("done", done)
    n = {"n_chunks": F.coalesce("n_chunks", F.lit(0)), "n_removed": F.coalesce("done.n", F.lit(0)), "n_removed_lines": F.coalesce("done.lines", F.lit(0))}
    names = [c for c in joined.schema["row"].dataType.names if c not in n]
    own = {text_col: F.when(F.col("done.n") > 0, F.col("done.t")).otherwise(F.col("row")[text_col])}
    return held.select(*[own.get(c, F.col("row")[c]).alias(c) for c in names], *[v.cast("long").alias(c) for c, v in n.items()])


SQL = r"""
WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\n]{40,}?[.!?] |[^\n]*(?:\n|\z)'), lambda x: x <> '') AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: rtrim(x, ' ' || chr(10))) AS keys FROM l WHERE len(lines) > 0),
hs AS (SELECT doc_id, keys, list_transform(keys, lambda x: ('0x' || left(md5(x), 14))::BIGINT::HUGEINT) AS h FROM k),
b AS (SELECT doc_id, keys, list_filter(range(0, len(keys)), lambda i: i = 0 OR ((coalesce(h[i - 1], 0) * 31 + h[i]) % 2305843009213693951) % 16 < 12) AS begins FROM hs),
c AS (
  SELECT doc_id, keys, unnest(begins[1:greatest(len(begins) - 1, 1)]) AS b, unnest(list_concat(begins[3:], [len(keys)])) AS e, greatest(len(begins) - 1, 1) AS n FROM b),
t AS (SELECT doc_id, b, e, n, array_to_string(keys[b + 1:e], chr(10)) AS t FROM c),
g AS (SELECT t, min(doc_id) AS a FROM t WHERE e - b >= 2 AND length(t) >= 50 GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, b, e FROM t JOIN g USING (t) WHERE e - b >= 2 AND doc_id > a),
n AS (SELECT doc_id, max(n) AS n_chunks FROM t GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed, flatten(list(range(b, e))) AS lost FROM gone GROUP BY doc_id),
d AS (
  SELECT doc_id, n_removed, len(list_distinct(lost)) AS n_removed_lines, array_to_string(list_filter(lines, lambda x, i: NOT list_contains(lost, i - 1)), '') AS t
  FROM r JOIN l USING (doc_id))
SELECT doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, md5(coalesce(t, text, '')) AS text_md5
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN d USING (doc_id)
"""
