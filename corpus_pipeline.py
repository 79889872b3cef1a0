"""The corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. A null or repeated doc_id keeps its rows through every stage but the near-duplicate
one, which keeps one row of each group. Both this one and decontamination judge each row by itself: by a key of its id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import queries as Q
from stowage.llm.common import stored, table
from stowage.llm.decontaminate import contamination
from stowage.llm.ngram_join import jaccard_components
from stowage.llm.packing import best_fit_packing
from stowage.llm.pii import pseudonyms
from stowage.llm.toxicity import toxicity

#: A row's own key within a stage, since ids may be null or repeated.
KEY = "_stage_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Null and wordless texts get the model's bias, repeated rows a row each."""
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no column of docs can be taken for a result
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", at["doc_id"])
    return toxicity(named, labels, at["doc_id"], at["text"]).where("toxic_predicted = 0").select(*named.columns).toDF(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the smallest id (null ids last, then the
    smaller hash). Null and wordless texts link with nothing; of rows equal in id and text one stays."""
    keyed = _keyed(docs)
    groups = jaccard_components(keyed, n=5, percent=80, id_col=KEY).distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    members = keyed.select("doc_id", KEY).distinct().join(groups.select(F.col("doc_id").alias(KEY), "component_id"), KEY)
    kept = members.groupBy("component_id").agg(F.min_by(KEY, order).alias(KEY)).select(KEY)
    return keyed.join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of the benchmark, nor a whole shorter item. Each row is judged by its own text; null
    and wordless texts stay."""
    keyed = _keyed(docs)
    hit = contamination(keyed, table(spark, sf_dir, "benchmark"), width=10, id_col=KEY).where("contaminated").select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(hit, KEY, "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data, and n_chars of the new text (null for a null text)."""
    return pseudonyms(docs, Q.pseudonym_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 4096 tokens; a null or empty text is its end token alone."""
    return best_fit_packing(docs, Q.tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: The learned toxicity model and the tokenizer can't be expressed in SQL; the tests hold each stage's operator against brute force, and
#: the stages' own decisions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
