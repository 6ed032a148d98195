"""Readers for seed files, expression matrices, papers, images, feeds and search replies."""

from __future__ import annotations

import csv
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart import schemas

# -- delimited text ------------------------------------------------------------------------------


def load_seed(spark: SparkSession, path: str, renames: dict[str, str] = schemas.CLINICAL_SEED_RENAMES) -> DataFrame:
    """CSV with every column as text; quoted headers are renamed."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})


def load_patients(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Batch of patients under a declared schema; a bad cell becomes NULL, its row stays."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def matrix_header(spark: SparkSession, path: str, separator: str = "\t") -> list[str]:
    first = spark.read.text(path).limit(1).first()
    return first["value"].split(separator) if first else []


def read_expression_tsv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Tab-separated matrix (first column gene, header samples) to long form.

    Blank and short rows are dropped, text that is no number is NULL. A gzip file
    arrives as one partition and is spread before the wide rows are unfolded.
    """
    header = matrix_header(spark, path)
    size = len(header)
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where((F.trim("value") != "") & (F.col("value") != F.lit("\t".join(header))))
    lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism)
    names = F.array(*[F.lit(s) for s in header[1:]])
    number = F.col("cell").try_cast("double")
    return (
        lines.select(cells.alias("cells")).where(F.size("cells") >= size)
        .select(F.col("cells")[0].alias("gene_symbol"), F.posexplode(F.slice("cells", 2, size - 1)).alias("position", "cell"))
        .select("gene_symbol", F.get(names, F.col("position")).alias("sample_id"), "position",
                F.when(~F.isnan(number), number).alias("value"))
    )


def read_wide_csv(spark: SparkSession, path: str, index: str = "line_id") -> DataFrame:
    """CSV with an unnamed index column and one column per gene, to long form. Lines are unfolded as they are read, so the
    plan has three columns whatever the number of genes. A cell holds no line break; missing cells are NULL."""
    first = spark.read.text(path).limit(1).first()
    header = next(csv.reader([first["value"]])) if first else [""]

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(header[1:], pa.string())
        for batch in batches:
            for row in csv.reader(batch["value"].to_pylist()):
                if row and row != header:
                    cells = (row[1:] + [None] * len(names))[: len(names)]
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]] * len(names), pa.string()), names, pa.array(cells, pa.string())],
                                                     [index, "column_name", "cell"])

    long = spark.read.text(path).mapInArrow(unfold, f"{index} string, column_name string, cell string")
    return long.select(index, "column_name", F.col("cell").try_cast("double").alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Scored batch for download."""
    df.write.mode("overwrite").option("header", True).csv(path)


# -- papers and images -----------------------------------------------------------------------------

PageReader = Callable[[bytes], list[str]]


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def check_pdf(files: DataFrame) -> DataFrame:
    """is_valid: more than 1000 bytes and the four-byte PDF mark."""
    mark = F.substring("content", 1, 4) == F.lit("%PDF").cast("binary")
    return files.withColumn("is_valid", (F.col("length") > 1000) & mark)


def read_pages(files: DataFrame, reader: PageReader) -> tuple[DataFrame, DataFrame]:
    """Pages per paper and the files the reader failed on. The reader decodes one file's bytes."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for paper, content in zip(pdf["paper_id"], pdf["content"]):
                try:
                    pages, error = reader(content), None
                except Exception as exc:  # noqa: BLE001 - a bad file must not stop the batch
                    pages, error = None, str(exc)
                rows.append((paper, pages, error))
            yield pd.DataFrame(rows, columns=["paper_id", "pages", "error"])

    source = files.select(_stem(F.col("path")).alias("paper_id"), "content")
    read = source.mapInPandas(decode, "paper_id string, pages array<string>, error string")
    return read.where("error IS NULL").select("paper_id", "pages"), read.where("error IS NOT NULL").select("paper_id", "error")


def _image_size(content: bytes) -> tuple[int | None, int | None, str | None]:
    """Width, height and format from the header of a PNG, GIF or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return (*struct.unpack(">II", content[16:24]), "png")
    if content[:4] == b"GIF8":
        return (*struct.unpack("<HH", content[6:10]), "gif")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            kind, size = content[at + 1], struct.unpack(">H", content[at + 2:at + 4])[0]
            if kind in (0xC0, 0xC1, 0xC2):
                height, width = struct.unpack(">HH", content[at + 5:at + 9])
                return width, height, "jpeg"
            at += 2 + size
    return None, None, None


def image_inventory(files: DataFrame) -> DataFrame:
    """Files named <paper>/page_<p>_img_<i>.<ext>: place, hash and size."""
    path = F.col("path")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [_image_size(c) for c in pdf["content"]]
            yield pdf.drop(columns=["content"]).assign(
                width=[s[0] for s in sizes], height=[s[1] for s in sizes], format=[s[2] for s in sizes])

    named = files.select(
        F.regexp_extract(path, r"([^/]+)/page_\d+_img_\d+\.\w+$", 1).alias("paper_id"),
        F.regexp_extract(path, r"page_(\d+)_img_\d+\.\w+$", 1).try_cast("int").alias("page_number"),
        F.regexp_extract(path, r"page_\d+_img_(\d+)\.\w+$", 1).try_cast("int").alias("image_index"),
        path.alias("s3_url"), F.sha2("content", 256).alias("image_hash"), "content")
    return named.mapInPandas(
        measure, "paper_id string, page_number int, image_index int, s3_url string, image_hash string, "
                 "width int, height int, format string")


# -- landed replies --------------------------------------------------------------------------------


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))


def _texts(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def _one(xml: Column, path: str, rest: str) -> Column:
    return F.coalesce(F.nullif(F.get(_texts(xml, path), F.lit(0)), F.lit("")), F.lit(rest))


def article_metadata(texts: DataFrame, xml: str = "text") -> DataFrame:
    """Bibliographic XML to title, abstract, authors and DOI, with stated defaults."""
    x = F.col(xml)
    # Names are read author by author, so an empty part of one cannot shift the others.
    authors = F.regexp_extract_all(x, F.lit(r"(?s)<Author(?:\s[^>]*)?>.*?</Author>"), F.lit(0))
    part = lambda a, name: F.get(F.xpath(a, F.lit(f"/Author/{name}/text()")), F.lit(0))
    named = F.filter(authors, lambda a: F.xpath_boolean(a, F.lit("/Author[LastName and ForeName]")))
    people = F.transform(named, lambda a: F.concat_ws(" ", part(a, "ForeName"), part(a, "LastName")))
    abstract = F.array_join(_texts(x, "//AbstractText/text()"), " ")
    return texts.where(F.xpath_boolean(x, F.lit("//PubmedArticle"))).select(
        *[c for c in texts.columns if c != xml],
        _one(x, "//ArticleTitle/text()", "No title").alias("title"),
        F.coalesce(F.nullif(abstract, F.lit("")), F.lit("No abstract available")).alias("abstract"),
        F.coalesce(F.nullif(F.array_join(people, ", "), F.lit("")), F.lit("No authors listed")).alias("authors"),
        _one(x, "//ArticleId[@IdType='doi']/text()", "No DOI available").alias("doi"))


def feed_entries(texts: DataFrame, xml: str = "text") -> DataFrame:
    """Atom feed to one row per entry: title, up to three authors, day, abstract, id."""
    parts = F.split(F.col(xml), r"<entry[^>]*>")
    entries = F.slice(parts, F.lit(2), F.size(parts))
    entry = F.concat(F.lit("<entry>"), F.regexp_extract(F.col("raw"), r"(?s)^(.*?</entry>)", 1))
    e = F.col("entry")
    names = _texts(e, "/entry/author/name/text()")
    count = F.xpath_int(e, F.lit("count(/entry/author)"))
    shown = F.coalesce(F.nullif(F.array_join(F.slice(names, 1, 3), ", "), F.lit("")), F.lit("Unknown"))
    flat = lambda c: F.replace(F.trim(c), F.lit("\n"), F.lit(" "))
    url = _one(e, "/entry/id/text()", "https://arxiv.org")
    return (
        texts.select(F.posexplode(entries).alias("i", "raw"))
        .select((F.col("i") + 1).alias("entry_no"), entry.alias("entry"))
        .select(
            "entry_no", flat(_one(e, "/entry/title/text()", "Unknown")).alias("title"),
            F.when(count > 3, F.concat(shown, F.lit(" et al."))).otherwise(shown).alias("authors"),
            F.substring(_one(e, "/entry/published/text()", "Unknown"), 1, 10).alias("published"),
            flat(_one(e, "/entry/summary/text()", "No abstract")).alias("abstract"),
            F.element_at(F.split(url, "/"), -1).alias("arxiv_id"), url.alias("url"))
    )


def search_results(texts: DataFrame, json: str = "text") -> DataFrame:
    """Web-search reply to one row per organic result, with defaults for absent fields."""
    reply = F.from_json(json, "organic_results array<struct<title:string,snippet:string,link:string>>")
    return texts.select(F.posexplode(reply["organic_results"]).alias("i", "r")).select(
        (F.col("i") + 1).alias("place"), F.coalesce("r.title", F.lit("Unknown Title")).alias("title"),
        F.coalesce("r.snippet", F.lit("No description")).alias("snippet"), F.coalesce("r.link", F.lit("")).alias("url"))
