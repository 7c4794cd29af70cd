"""Line deduplication (operator 2), built from DataFrame functions only.

Lines are normalised, hashed to 128 bits, and counted by distinct documents; a line over the
threshold stays only in the smallest document that holds it. Line texts are never shuffled:
what moves is (hash, document, position), and then the positions to drop, which meet the whole
documents again in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, doc_order, fresh, hash128, written

#: Stripped from both ends of a line: space, and tab to carriage return.
WHITE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The normal form under which lines are the same: ends stripped, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated lines, plus ``n_lines`` and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and is found in ``min_docs`` or more
    documents is dropped everywhere but in the smallest document id. Null and empty texts are one
    empty line. Rows without an id count as one document, after all others. Rows that repeat an
    id are the same document: their lines don't count twice. Rows with the same id and text get
    the same result. Other columns pass through; columns named ``n_lines`` or ``n_dropped``
    are replaced. A document may lose all its lines: its text is then empty.
    """
    order = doc_order(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(order.alias("_d"), F.xxhash64(text).alias("_t"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    keyed = own.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    h1, h2 = hash128(F.col("_key"))
    # Written once: counting and looking up would both split and normalise every text.
    lines = written(keyed.select("_d", "_t", "_pos", h1.alias("_h1"), h2.alias("_h2")))
    if min_docs == 2:  # two distinct documents exactly if the smallest and the largest differ
        common = lines.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last")).where("_first <> _last").drop("_last")
    else:
        seen = lines.groupBy("_h1", "_h2", "_d").agg(F.lit(1).alias("_one"))
        common = seen.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.count("_one").alias("_n")).where(F.col("_n") >= min_docs).drop("_n")
    common = written(common)  # with both sides plain tables, Spark splits a hot line's rows in the join
    drop, drop_d, drop_t = fresh(docs, "_drop", "_drop_d", "_drop_t")
    dropped = lines.join(common, ["_h1", "_h2"]).where("_d <> _first")
    drops = dropped.groupBy(F.col("_d").alias(drop_d), F.col("_t").alias(drop_t)).agg(F.collect_set("_pos").alias(drop))
    joined = docs.join(drops, (order == F.col(drop_d)) & (F.xxhash64(text) == F.col(drop_t)), "left")
    split = F.split(text, "\n", -1)
    n = F.size(split)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col(drop))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    return joined.withColumns({
        "n_lines": n.cast("long"),
        "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"),
        text_col: F.when(F.col(drop).isNull(), F.col(text_col)).when(F.size(kept) == 0, F.lit("")).otherwise(kept_text),
    }).drop(drop, drop_d, drop_t)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: line counts and the SHA-256 of the kept text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB form of ``digest``.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT a.doc_id, a.pos, a.line, (c.k IS NOT NULL AND c.first_doc <> a.doc_id) AS dropped
  FROM keyed a LEFT JOIN common c ON a.k = c.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
