"""Article tables: CSV, foreign CSV, corpora in any Spark format, and generated articles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.operators.articles import COLUMN_ALIASES, first_by, first_rows, normalize_aliases
from tidings.schemas import REQUIRED_ARTICLE_COLUMNS, require_columns

# Columns of a foreign CSV without a header line.
HEADERLESS_COLUMNS = ("label", "title", "description")
# Seed and size of a generated corpus.
GENERATED_SEED, GENERATED_COUNT = 42, 500

_WORDS = (
    "market minister climate report summit chips football energy vaccine court election storm "
    "budget science harbour railway museum island orchestra factory border festival school river"
).split()


def _csv(spark: SparkSession, path: str, header: bool, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"')
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"article file not found: {path}") from error
        raise


def load_articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Stored article CSV; a missing or empty file or a missing column is an error.

    Quoted fields may hold line ends, for which a file is read by one task. Where none does, large files
    are split with ``multi_line=False``.
    """
    df = _csv(spark, path, True, multi_line)
    if not df.columns or not df.head(1):
        raise ValueError(f"no articles in {path}")
    return require_columns(df, REQUIRED_ARTICLE_COLUMNS)


def with_positions(df: DataFrame, name: str = "ingest_seq", start: int = 0) -> DataFrame:
    """Number rows 0, 1, 2 ... in input order without pulling them into one partition.

    Rows of files go by file and place in the file (the hidden columns of the scan say which), so the
    numbers do not depend on how files are split or dealt to tasks. A first pass counts the rows of every
    block, a second adds each block's offset. Only the counts, one row per block, are put in order.
    """
    columns = df.columns
    try:
        tagged = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
        tagged = tagged.withColumn("_row", F.monotonically_increasing_id())
    except AnalysisException:  # no scan of files: by partition
        tagged = df.withColumn("_row", F.monotonically_increasing_id())
        tagged = tagged.withColumns({"_path": F.lit(""), "_block": F.shiftright("_row", 33)})
    blocks = tagged.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    offsets = blocks.select("_path", "_block", offset.alias("_offset"))
    return tagged.join(F.broadcast(offsets), ["_path", "_block"]).select(
        (F.col("_offset") + F.col("_row") + start).alias(name), *columns
    )


def load_foreign_csv(
    spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV of another publisher: known column names are mapped, a headerless file is three columns."""
    named = _csv(spark, path, True, multi_line)
    known = {alias for field in ("title", "description", "url") for alias in COLUMN_ALIASES[field]}
    if not known & set(named.columns):
        plain = _csv(spark, path, False, multi_line)
        named = plain.select(
            *[F.col(old).alias(new) for old, new in zip(plain.columns, HEADERLESS_COLUMNS)]
        )
    numbered = with_positions(named)
    if limit is not None:
        numbered = first_by(numbered, limit, "ingest_seq")
    return normalize_aliases(numbered)


def load_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet", limit: int | None = None
) -> DataFrame:
    """Raw records of a stored corpus with NULL text turned blank; all, or the first ``limit``."""
    raw = spark.read.format(fmt).load(path)
    numbered = raw if "ingest_seq" in raw.columns else with_positions(raw)
    picked = numbered.select("ingest_seq", *COLUMN_ALIASES)
    return picked.na.fill("") if limit is None else first_rows(picked, limit)


def generated_articles(
    spark: SparkSession, count: int = GENERATED_COUNT, seed: int = GENERATED_SEED
) -> DataFrame:
    """Seeded made-up articles for trials; every row depends on its number and the seed only."""

    def pick(position: int) -> F.Column:
        words = F.array(*[F.lit(word) for word in _WORDS])
        index = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(position)), F.lit(len(_WORDS)))
        return F.element_at(words, (index + 1).cast("int"))

    number = F.xxhash64("id", F.lit(seed))
    domain = F.concat(pick(0), F.lit("-"), pick(1), F.lit(".example"))
    seconds = F.pmod(number, F.lit(2 * 365 * 86400))
    date = F.timestamp_seconds(F.lit(1_577_836_800) + seconds)
    return spark.range(count).select(
        F.col("id").alias("ingest_seq"),
        F.initcap(F.concat_ws(" ", *[pick(i) for i in range(2, 10)])).alias("title"),
        F.concat_ws(" ", *[pick(i) for i in range(10, 50)]).alias("description"),
        F.concat(F.lit("https://"), domain, F.lit("/articles/"), F.lower(F.hex(number))).alias("url"),
        F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("date"),
        domain.alias("domain"),
    )
