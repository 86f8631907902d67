"""Shared views over the driver's tables, each as a DataFrame and as SQL.

The tables hold no DNA.  ``dna`` reads every whole document text as bases by a fixed letter table, ``motifs`` its lines.
``hits`` reads line items as hits on the sequence of their supplier, ``inserts`` orders as intervals on the same
sequences, ``points`` events as places on one chromosome per event type, and ``labelled`` scores labelled documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import spread

#: Fixed value: base by letter.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "gactgatcaaggcagtcgatgcatgn"
_DNA_SQL = f"translate(regexp_replace(lower({{0}}), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str, streamed: bool = False) -> DataFrame:
    return spread(_table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), streamed)


def _dna(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), LETTERS, BASES)


def dna_of(texts: DataFrame, id_col: str) -> DataFrame:
    """Records (record_ix, seq_id, seq, seq_offset) of the column ``text``."""
    return texts.select(F.col(id_col).alias("record_ix"), F.concat(F.lit("d"), F.col(id_col).cast("string")).alias("seq_id"), _dna(F.coalesce("text", F.lit(""))).alias("seq"), F.lit(1).cast("long").alias("seq_offset"))


def dna(spark: SparkSession, sf: str) -> DataFrame:
    return dna_of(_texts(spark, sf), "doc_id")


def motifs(spark: SparkSession, sf: str, streamed: bool = False) -> DataFrame:
    """Lines of documents as candidate spans: two arms of a third each and what lies between; fewer than three bases have no arms."""
    bases = F.translate(F.regexp_replace(F.lower("text"), "[^a-z\n]", ""), LETTERS, BASES)
    # cut after the letters are read, so that a span is a column of its own and not an expression repeated in all others
    s = _texts(spark, sf, streamed).select("doc_id", F.posexplode(F.split(bases, "\n")).alias("pos", "full_sequence")).where(F.length("full_sequence") >= 3)
    n = F.length("full_sequence")
    arm = F.floor(n / 3).cast("int")
    s = s.withColumn("arm_length", arm).withColumn("left_arm", F.substring("full_sequence", F.lit(1), F.col("arm_length"))).withColumn("right_arm", F.substring("full_sequence", n - F.col("arm_length") + 1, F.col("arm_length")))
    share = lambda x: (F.length("right_arm") - F.length(F.translate("right_arm", x, ""))) * 100 / F.col("arm_length")
    return s.withColumn("ga_pct", share("ga")).withColumn("ct_pct", share("ct"))


DNA_SQL = f"""dna AS (SELECT doc_id AS record_ix, 'd' || doc_id AS seq_id, {_DNA_SQL.format("coalesce(text, '')")} AS seq FROM documents)"""


MOTIFS_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
spans AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_DNA_SQL.format('line')} AS full_sequence FROM lines),
arms AS (SELECT *, CAST(length(full_sequence) // 3 AS INTEGER) AS arm_length FROM spans WHERE length(full_sequence) >= 3),
cut AS (SELECT *, substr(full_sequence, 1, arm_length) AS left_arm, substr(full_sequence, length(full_sequence) - arm_length + 1, arm_length) AS right_arm FROM arms),
motifs AS (SELECT *, (length(right_arm) - length(translate(right_arm, 'ga', ''))) * 100 / arm_length AS ga_pct, (length(right_arm) - length(translate(right_arm, 'ct', ''))) * 100 / arm_length AS ct_pct FROM cut)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem")
    arm, sp = (8 + F.col("l_quantity").cast("int") % 23).cast("int"), F.col("l_linenumber").cast("int")
    g = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("seq_id"), F.col("l_orderkey").alias("start"), arm.alias("arm_length"), sp.alias("spacer_length"))
    score = F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_extendedprice") / 10) / 100)
    t = g.agg(F.max(F.round(F.col("l_discount") * 1000, 1)).alias("ga_pct"), F.max(F.round(100 - F.col("l_tax") * 100, 1)).alias("mirror_identity"), F.max(score).alias("total_score"))
    end = F.col("start") + 2 * F.col("arm_length") + F.col("spacer_length") - 1
    return t.select(
        F.concat_ws(":", "seq_id", F.col("start").cast("string"), F.col("arm_length").cast("string"), F.col("spacer_length").cast("string")).alias("id"), "seq_id", "start", end.alias("end"), "arm_length", "spacer_length",
        "ga_pct", (100 - F.col("ga_pct")).alias("ct_pct"), "mirror_identity", (F.col("mirror_identity") == 100).alias("is_perfect"), "total_score", F.lit("").alias("full_sequence"),
    )


HITS_SQL = """grouped AS (SELECT 's' || l_suppkey AS seq_id, l_orderkey AS start, CAST(8 + CAST(l_quantity AS INTEGER) % 23 AS INTEGER) AS arm_length, CAST(l_linenumber AS INTEGER) AS spacer_length,
  max(round(l_discount * 1000, 1)) AS ga_pct, max(round(100 - l_tax * 100, 1)) AS mirror_identity, max(CASE WHEN l_returnflag <> 'N' THEN floor(l_extendedprice / 10) / 100 END) AS total_score
  FROM lineitem GROUP BY 1, 2, 3, 4),
hits AS (SELECT concat_ws(':', seq_id, start, arm_length, spacer_length) AS id, *, start + 2 * arm_length + spacer_length - 1 AS "end", 100 - ga_pct AS ct_pct, mirror_identity = 100 AS is_perfect FROM grouped)"""


def inserts(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), (F.col("o_custkey") % 100).cast("string")).alias("seq_id"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 20 + F.col("o_custkey") % 40).alias("end"))


INSERTS_SQL = """inserts AS (SELECT o_orderkey AS id, 's' || (o_custkey % 100) AS seq_id, o_orderkey AS start, o_orderkey + 20 + o_custkey % 40 AS "end" FROM orders)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(F.col("event_type").alias("chrom"), (F.floor(F.col("value") * 50) + 1).cast("long").alias("pos"), F.col("user_id").alias("weight"))


POINTS_SQL = "points AS (SELECT event_type AS chrom, CAST(floor(value * 50) + 1 AS BIGINT) AS pos, user_id AS weight FROM events)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    d, y = _texts(spark, sf), _table(spark, sf, "labels")
    n = F.length("text")
    marks = n - F.length(F.translate("text", "#*$%&|!", ""))
    s = F.when(n > 0, F.round(1 - marks / n, 4)).otherwise(0.0)
    return y.join(d, "doc_id").select(F.col("doc_id").alias("record_id"), F.col("quality").alias("y"), "toxic", s.alias("s"), "lang", "source", n.alias("n"))


LABELLED_SQL = """labelled AS (SELECT doc_id AS record_id, quality AS y, toxic, CASE WHEN length(text) > 0 THEN round(1 - (length(text) - length(translate(text, '#*$%&|!', ''))) / length(text), 4) ELSE 0.0 END AS s, lang, source, length(text) AS n
  FROM labels JOIN documents USING (doc_id))"""
