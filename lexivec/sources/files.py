"""Reading documents: any parser over a folder of files, chunks as JSON, statistics as snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.text import basename
from lexivec.session import importable

BLOCKS = "source_document string, seq int, page_number int, text string, font_size double, font_name string, is_bold boolean, is_italic boolean, color_key string, top double, bottom double, x0 double"
CHUNKS = "chunk_id string, text string, source_document string, chunk_index int, chunk_total int, start_page int, end_page int, section string, section_path string, embedding array<float>, metadata map<string,string>"


def parsed_files(spark: SparkSession, path: str, parser: Callable[[str, bytes], Iterator[dict]], schema: str = BLOCKS) -> DataFrame:
    """Every file under `path` through a parser (file name, bytes) -> rows of `schema`; Spark lists and reads the files, so
    any store it knows will do, and a missing path is an error. No PDF library is bundled: the parser is the plug-in."""
    importable(spark)
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                yield pd.DataFrame(list(parser(name, content)), columns=names)

    files = spark.read.format("binaryFile").load(path).select(basename(F.col("path")).alias("name"), "content")
    return files.mapInPandas(run, schema)


def read_chunks(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Chunks from Parquet, from "json" (an array or an object a file) or from "jsonl" (an object a line, as they are written);
    missing fields are null."""
    if form not in ("parquet", "json", "jsonl"):
        raise ValueError("form is parquet, json or jsonl")
    read = spark.read.schema(CHUNKS)
    return read.parquet(path) if form == "parquet" else read.json(path, multiLine=form == "json")


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_stats(df: DataFrame, stats: DataFrame, path: str) -> None:
    """A snapshot: the frequencies and the one row of totals, side by side."""
    df.write.mode("overwrite").parquet(f"{path}/df")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/stats")


def read_stats_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON snapshot {total_documents, total_document_length, frequencies}, or the same in Pascal case. Its terms are
    CRC-32 numbers (see term_frequency's hash_terms)."""
    raw = spark.read.json(path, multiLine=True, primitivesAsString=True)
    known = {c.lower().replace("_", ""): c for c in raw.columns}
    column = lambda c, kind: F.col(known[c]).cast(kind) if c in known else F.lit(None).cast(kind)
    n, total = F.coalesce(column("totaldocuments", "bigint"), F.lit(0)), F.coalesce(column("totaldocumentlength", "bigint"), F.lit(0))
    stats = raw.select(n.alias("n"), total.alias("total_length"), F.when(n > 0, F.try_divide(total.cast("double"), n)).otherwise(1.0).alias("average_length"))
    if "frequencies" not in known:
        return spark.createDataFrame([], "term bigint, df bigint"), stats
    pairs = raw.select(F.explode(F.from_json(F.to_json(F.col(known["frequencies"])), "map<string,string>")).alias("term", "df"))
    return pairs.select(F.col("term").cast("bigint").alias("term"), F.col("df").cast("bigint").alias("df")), stats
