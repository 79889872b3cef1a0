"""Inventory tables derived from the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIR = """CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'Android/data/' WHEN doc_id % 19 = 0 THEN 'Chat/Sent/'
  WHEN doc_id % 17 = 0 THEN '.trash/' WHEN doc_id % 11 = 0 THEN 'Images/' ELSE source || '/' || lang || '/' END"""
_NAME = """CASE doc_id % 14 WHEN 0 THEN 'IMG_' || doc_id || '.JPG' WHEN 1 THEN 'IMG_' || (doc_id - 1) || ' (1).jpg'
  WHEN 2 THEN 'clip-' || doc_id || '.mp4' WHEN 3 THEN '~$draft' || doc_id || '.docx' WHEN 4 THEN 'notes' || doc_id || '.pdf'
  WHEN 5 THEN 'cache' || doc_id || '.tmp' WHEN 6 THEN 'README' || doc_id WHEN 7 THEN 'scan' || doc_id || '.'
  WHEN 8 THEN '.nomedia' WHEN 9 THEN 'photo-copy.png' WHEN 10 THEN 'photo.png' WHEN 11 THEN 'data' || doc_id || '.tar.gz'
  WHEN 12 THEN 'Screenshot_' || doc_id || '.png' ELSE 'run' || doc_id || '.py' END"""


def files_sql(length: str) -> str:
    """length: the engine's function for the bytes of a text (octet_length in Spark, strlen in DuckDB)."""
    return f"""SELECT doc_id AS walk_seq, {_DIR} || 'd' || doc_id || '/' || {_NAME} AS rel_path, {_NAME} AS name,
  CASE WHEN doc_id % 29 = 0 THEN CAST(0 AS BIGINT) ELSE CAST({length}(text) AS BIGINT) END AS size,
  CAST(1704067200 + doc_id * 7200 AS BIGINT) AS mtime_epoch, sha1(text) AS sha1 FROM documents"""


BLOBS = """SELECT o_orderkey AS walk_seq,
  'y' || CAST(year(o_orderdate) AS VARCHAR(4)) || '/' || o_orderpriority || '/blob' || o_orderkey || '.bin' AS rel_path,
  'blob' || o_orderkey || '.bin' AS name, CAST(floor(o_totalprice * 400) AS BIGINT) AS size FROM orders"""
CAPTURES = "SELECT event_id AS walk_seq, user_id AS album, ts AS taken_at, 'u' || user_id || '/cap' || event_id || '.jpg' AS rel_path FROM events"
METRICS = """SELECT doc_id AS walk_seq,
  ((CAST(floor(doc_id / 4) AS BIGINT) * 2654435761) % 4294967296) * 2147483648
   + (CAST(floor(doc_id / 4) AS BIGINT) * 1103515245 + 12345) % 2147483000 + (doc_id % 4) * 37 AS phash,
  CAST(doc_id % 400 AS DOUBLE) AS focus, CAST(doc_id % 5 AS INT) AS faces, 1000 + doc_id % 7 AS pixels,
  CAST(doc_id % 60 AS DOUBLE) AS saturation, CAST(doc_id % 256 AS DOUBLE) AS brightness, CAST(doc_id % 40 AS DOUBLE) AS edge,
  CASE WHEN doc_id % 37 = 0 THEN 'Screenshot_' ELSE 'IMG_' END || doc_id || '.jpg' AS name FROM documents"""
GPS = "SELECT event_id AS walk_seq, CAST(event_id % 300 AS DOUBLE) / 1000 + 8 AS lat, CAST(0 - event_id % 60 AS DOUBLE) / 1000 AS lon FROM events WHERE event_type <> 'error'"


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", files_sql("octet_length"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", BLOBS)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", CAPTURES)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", METRICS)


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", GPS)
