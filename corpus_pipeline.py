"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; run() writes each result to the shared folder
and reads it again. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.llm.decontam import leaks
from docfathom.llm.neardup import one_of_each
from docfathom.llm.packing import pack
from docfathom.llm.shared import discard, owner, path_of, stage
from docfathom.llm.substring import drop_repeats
from docfathom.llm.toxicity import toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7. Rows are judged by their text alone, so null and repeated ids need no care."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, labels, carry=tuple(docs.columns))
    return scored.filter("__predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word-shingle similarity of 0.8 or more: the first in the order of the input.

    Of equal rows one stays. Null, empty and wordless texts are like nothing and all stay; ids play no part.
    """
    return one_of_each(docs, percent=80, size=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated 35-word windows cover; texts without any stay as they are. No row goes."""
    out = drop_repeats(docs, window=35, carry=tuple(docs.columns))
    changed = F.col("__removed") > 0
    now = {"text": F.when(changed, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(changed, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[now[c].alias(c) if c in now else F.col(c) for c in docs.columns])


#: Keys of contaminated documents that are broadcast, at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is like a benchmark item. A row is known by its id and text together, so equal rows go together.

    Null and short texts have no window and stay. Where the keys found are few, no text is shuffled.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))
    found = stage(leaks(docs.select(key.alias("__key"), "text"), benchmark, id_col="__key").select("__key").distinct(), "leaks")
    gone = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    return docs.withColumn("__key", key).join(gone, "__key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens as pieces of sequences of at most 4096 tokens; null and empty texts are an end mark each."""
    return pack(docs, capacity=4096)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Scores, near-duplicate components and packing are beyond SQL; tests hold the stages against planted cases, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents. A stage may leave nothing: the next ones then have nothing to do.

    What a stage has staged on its way is deleted as soon as its result is written, and that when the next one's is.
    """
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with owner(spark) as made:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(path_of(docs))
        if done is not None:
            discard(done)
        done = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads tables of its own from here on
    discard(docs)
    return out
