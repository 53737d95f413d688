"""Readers of archive data: fund inventories, run metadata, decoded text, catalogue pages, film indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.keys import leaf_range
from ledgerloom.storage import hadoop_fs

#: Columns of a fund inventory, whatever the file's age.
INVENTORY = (
    "opys", "spr_int", "spr_letter", "title", "title_src", "title_alt", "commons_title", "year_from", "year_to", "years_src", "folios", "commons_url", "mirror_url",
    "truncated_mirror", "num_src", "page_quality", "on_disk", "surnames", "sources",
)
RUN_META = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("model", T.StringType()), T.StructField("engine", T.StringType()), T.StructField("script", T.StringType()),
    T.StructField("case_dir", T.StringType()), T.StructField("case_key", T.StringType()), T.StructField("started", T.StringType()), T.StructField("updated", T.StringType()),
    T.StructField("done", T.BooleanType()), T.StructField("frames_total", T.IntegerType()), T.StructField("failed", T.ArrayType(T.StringType())),
    T.StructField("pages", T.MapType(T.StringType(), T.StructType([
        T.StructField("orient", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("chars", T.IntegerType()), T.StructField("conf", T.DoubleType()),
        T.StructField("sec", T.DoubleType()), T.StructField("contrast", T.DoubleType()), T.StructField("enhanced", T.BooleanType()),
    ]))),
])


def _present(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_fs(spark, path)
    matched = fs.globStatus(where)
    return matched is not None and len(matched) > 0


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A fund inventory in either of its layouts; a column the file lacks is null, an empty one is ''."""
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path).na.fill("")
    have = set(raw.columns)
    if "spr_int" in have:
        get = lambda c: F.trim(c) if c in have else F.lit(None).cast("string")
        df = raw.select(*(get(c).alias(c) for c in INVENTORY)).withColumn("schema", F.lit("merged"))
    else:
        old = {"spr_int": F.regexp_extract("spr", r"^(\d+)", 1), "spr_letter": F.regexp_extract("spr", r"^\d+(.*)$", 1), "title_src": F.col("source")}
        get = lambda c: old.get(c, F.trim(c) if c in have else F.lit(None).cast("string"))
        df = raw.select(*(get(c).alias(c) for c in INVENTORY)).withColumn("schema", F.lit("legacy"))
    return df.withColumn("spr_int", F.col("spr_int").try_cast("int")).withColumn("spr", F.concat(F.col("spr_int").cast("string"), F.coalesce("spr_letter", F.lit(""))))


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A TSV, or None if there is no file, which is not the same as an empty one."""
    return spark.read.option("sep", "\t").option("header", True).csv(path) if _present(spark, path) else None


def inventory_row(rows: DataFrame, opys: str, number: int, letter: str = "") -> DataFrame:
    return rows.where((F.col("opys") == opys) & (F.col("spr_int") == number) & (F.coalesce("spr_letter", F.lit("")) == letter)).limit(1)


def denominators(spark: SparkSession, path: str) -> DataFrame:
    """(inventory, total) of a coverage file."""
    schema = "opys map<string, struct<total:int>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("opys").alias("inventory", "v")).select("inventory", "v.total")


def underscored_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, value) of files whose names begin with an underscore, which Spark's readers pass over."""
    fs, where = hadoop_fs(spark, pattern)
    paths = [(str(status.getPath().toString()),) for status in fs.globStatus(where) or []]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs as arrow_fs

        for batch in batches:
            texts = []
            for path in batch["path"].to_pylist():
                store, name = arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)
                with store.open_input_stream(name) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], names=["path", "value"])

    tasks = max(1, min(len(paths), 200))
    return spark.createDataFrame(paths, "path string").repartition(tasks).mapInArrow(read, schema)


def runs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per run metadata file; files that are no JSON are left out."""
    df = underscored_files(spark, pattern).select("path", F.from_json("value", RUN_META).alias("m")).where("m.pages is not null")
    return df.select(F.element_at(F.split("path", "/"), -2).alias("run"), "m.*")


def run_pages(found: DataFrame) -> DataFrame:
    """(run, scan, lines, chars, conf, ...) of every page of runs."""
    return found.select("run", "case_key", F.explode("pages").alias("scan", "p")).select("run", "case_key", "scan", "p.*")


def decoded(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, page, text) of decoded pages, a file each."""
    df = spark.read.option("wholetext", True).text(pattern).select(F.col("value").alias("text"), F.split(F.col("_metadata.file_path"), "/").alias("_p"))
    return df.select(F.element_at("_p", -2).alias("run"), F.regexp_replace(F.element_at("_p", -1), r"\.txt$", "").alias("page"), "text")


def directories(spark: SparkSession, root: str) -> DataFrame:
    """Per directory its images, PDFs, bytes, newest change and a digest of names and sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    f = files.withColumn("dir", F.regexp_replace("path", r"/[^/]*$", "")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    image = F.lower("name").rlike(r"\.(jpe?g|png|tiff?|webp)$")
    listed = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "name", F.col("length").cast("string")))))
    return f.groupBy("dir").agg(F.count_if(image).alias("n_images"), F.count_if(F.lower("name").endswith(".pdf")).alias("n_pdf"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"), F.sha1(listed).alias("digest"))


def unescaped(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, position, href, label) of the links of HTML pages, in order."""
    anchor = r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(f"(?is){anchor}"), 1).alias("href"), F.regexp_extract_all(html, F.lit(f"(?is){anchor}"), 2).alias("label"))
    exploded = pages.select(F.col(id_col), F.posexplode(found).alias("position", "a"))
    label = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.label"), r"<[^>]+>", ""), r"\s+", " "))
    return exploded.select(id_col, "position", F.col("a.href").alias("href"), unescaped(label).alias("label"))


def last_page(html: Column) -> Column:
    """The largest page number that pagination links name."""
    return F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"[?&]page=(\d+)"), 1), lambda x: x.cast("int")))


def table_rows(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, row, cells) of HTML tables."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "_tr"))
    cells = F.transform(F.regexp_extract_all("_tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    return rows.select(id_col, "row", cells.alias("cells"))


def film_entries(tree: DataFrame) -> DataFrame:
    """(path, film, position, start, end, name) from region trees: path → folder, film → list of sheet labels."""
    df = tree.select("path", "film", F.posexplode("labels").alias("position", "label"))
    return df.withColumn("_r", leaf_range(F.col("label"))).select("path", "film", "position", "label", "_r.start", "_r.end", F.trim(F.get(F.split("label", " - ", 2), F.lit(1))).alias("name"))


def write_pack(rows: DataFrame, path: str, source: str, taken: str, schema_version: int = 1) -> None:
    """An immutable snapshot of a source: its rows and, written last, what they are."""
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    meta = [(source, taken, schema_version, rows.count())]
    spark.createDataFrame(meta, "source string, taken string, schema int, n long").coalesce(1).write.json(f"{path}/meta")


def read_packs(spark: SparkSession, paths: list[str], schema_version: int = 1) -> tuple[DataFrame, list[str]]:
    """Rows of all usable packs with their origin, and what is wrong with the others."""
    usable, problems = None, []
    for path in paths:
        if not _present(spark, f"{path}/meta"):
            problems.append(f"{path}: no metadata, the snapshot is incomplete")
            continue
        meta = spark.read.schema("source string, taken string, schema int, n long").json(f"{path}/meta").first()
        if meta["schema"] != schema_version:
            problems.append(f"{path}: schema {meta['schema']}, not {schema_version}")
            continue
        rows = spark.read.parquet(f"{path}/rows").withColumns({"origin": F.lit(meta["source"]), "pack_id": F.lit(path.rstrip("/").rsplit("/", 1)[-1])})
        usable = rows if usable is None else usable.unionByName(rows, allowMissingColumns=True)
    if usable is None:
        raise FileNotFoundError("; ".join(problems) or "no packs are installed")
    return usable, problems
