"""Readers and writers at the edges: JSON lines, TSV, HTML folders, XML dumps, seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.recipes import SCHEMA


def read_recipes(spark: SparkSession, path: str, schema: T.StructType = SCHEMA, limit: int | None = None) -> DataFrame:
    """JSON lines with the declared schema; blank lines are skipped, and what can't be read is kept
    in _corrupt (see split_corrupt). limit counts lines, the unreadable ones too."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    if limit is not None:
        lines = spark.read.text(path).filter(F.trim("value") != "").limit(limit)
        return lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row: errors). Spark asks for a cached or saved table to look at _corrupt alone."""
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt"), df.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("errors"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: n, the lines that aren't blank."""
    return spark.read.text(path).agg(F.count_if(F.trim("value") != "").alias("n"))


def read_static_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that may be missing (ingredient maps, category lists): then no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decode_body(body):
    """A response's text, whatever its packing: gzip (by its first bytes) is unpacked, brotli too where the
    library is there; anything else is read as it is. Bytes that aren't UTF-8 are replaced."""

    @F.pandas_udf("string")
    def decoded(bodies):
        import gzip

        try:
            import brotli
        except ImportError:
            brotli = None

        def text(raw):
            if raw is None:
                return None
            raw = bytes(raw)
            try:
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                elif brotli and raw[:1] not in b"<{[ \t\r\n":
                    raw = brotli.decompress(raw)
            except Exception:  # not packed after all, or cut off: as it is
                pass
            return raw.decode("utf-8", "replace")

        return bodies.map(text)

    return decoded(body)


def write_pages(pages: DataFrame, path: str) -> None:
    """Fetched pages (page_id, url, html) as a table; more are appended."""
    pages.select("page_id", "url", "html").write.mode("append").parquet(path)


def write_seeds(urls: DataFrame, path: str, url_col: str = "url") -> None:
    """One URL a line."""
    urls.select(url_col).write.mode("overwrite").text(path)


def write_selection(urls: DataFrame, path: str, columns: list[str], url_col: str = "url") -> None:
    """The selected URLs, one a line, and how they are spread over the columns' values."""
    from ..operators.facets import distribution

    write_seeds(urls, f"{path}/urls", url_col)
    write_json(distribution(urls, columns), f"{path}/distribution")


def append_log(row: DataFrame, path: str) -> None:
    """Statistics of a run, with the time, added to a log."""
    row.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_report(stats: DataFrame, path: str, title: str = "Report") -> None:
    """One row of statistics as a Markdown table."""
    pairs = F.array(*(F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" |")) for c in stats.columns))
    lines = F.concat(F.array(F.lit(f"# {title}"), F.lit(""), F.lit("| figure | value |"), F.lit("|-|-|")), pairs)
    stats.limit(1).select(F.array_join(lines, "\n").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; rows that don't fit are skipped. Gazetteers, queries, qrels."""
    return spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").option("quote", "").schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(name, html) of all *.html files below a folder; the name is the file's stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("name"), F.decode("content", "UTF-8").alias("html"))


def read_wiki_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(title, text) of a MediaWiki XML dump; bzip2 is split, so a dump is read by many tasks."""
    schema = "title string, ns string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).schema(schema).load(path)
    out = pages.select("title", F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))
    return out.limit(limit) if limit else out


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def last_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row by seq of each key."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("m")).select(key, "m.*")


def lookup(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is asked for."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def first_found(tables: list[DataFrame], value, id_col: str = "id") -> DataFrame:
    """The rows with an id from the first table that has it."""
    ranked = [t.filter(F.col(id_col) == value).withColumn("__at", F.lit(i)) for i, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy("__at").limit(1).drop("__at")


def sample_rows(spark: SparkSession, n: int = 20) -> DataFrame:
    """What a listing shows where there is no data: n made-up recipes."""
    return spark.range(1, n + 1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Sample Recipe "), F.col("id").cast("string")).alias("title"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def default_recipes(spark: SparkSession, path: str, limit: int = 10_000) -> DataFrame:
    """The first `limit` recipes of a JSON-lines file, broken lines left out; where the file is missing or has none, up to
    20 samples, so that a service has something to show."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = read_recipes(spark, path).filter("_corrupt is null").drop("_corrupt").limit(limit)
        if rows.head(1):
            return rows
    n = F.col("id").cast("string")
    own = {
        "id": F.concat(F.lit("sample_"), n), "title": F.concat(F.lit("Sample Recipe "), n), "description": F.concat(F.lit("This is a sample recipe number "), n, F.lit(" for testing purposes.")),
        "ingredients": F.array(*(F.concat(F.lit("Ingredient "), n, F.lit(x)) for x in "ABC")), "instructions": F.array(*(F.concat(F.lit(f"Step {i} for recipe "), n) for i in (1, 2, 3))),
        "times": F.struct((10 + F.col("id")).cast("int").alias("prep"), (20 + F.col("id") * 2).cast("int").alias("cook"), (30 + F.col("id") * 5).cast("int").alias("total")),
        "yield": (4 + F.col("id")).cast("string"), "cuisine": F.array(F.lit("Sample Cuisine")), "difficulty": F.lit("medium"), "author": F.concat(F.lit("Chef "), n),
    }
    return spark.range(1, min(limit, 20) + 1).select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))
