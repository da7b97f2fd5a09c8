"""Sources and sinks: text tables, HTML tables, PDF bytes and Markdown files.

Documents become pages of ``LINES_PER_PAGE`` lines by array functions alone, so
that pagination never shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T

LINES_PER_PAGE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files make fewer partitions than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def page_texts(text, per_page: int = LINES_PER_PAGE):
    """The array of a text's pages; the text is split once, whatever its length."""
    count = lambda ls: F.ceil(F.size(ls) / per_page).cast("int")
    page = lambda ls, i: F.array_join(F.slice(ls, i * per_page + 1, F.lit(per_page)), "\n")
    return T.let(T.lines(text), lambda ls: F.transform(F.sequence(F.lit(0), count(ls) - 1), lambda i: page(ls, i)))


def page_count(text, per_page: int = LINES_PER_PAGE):
    """The number of a text's pages, without building them."""
    return F.ceil((F.length(T.col(text)) - F.length(F.replace(T.col(text), F.lit("\n"), F.lit(""))) + 1) / per_page).cast("long")


def paginate(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, page, text) with pages from 1; documents with a null text have none."""
    found = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(page_texts("text", per_page)).alias("p", "text"))
    return found.select("doc_id", (F.col("p") + 1).cast("long").alias("page"), "text")


def paged_documents(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, n, pages): a row for each document with the array of its page texts; documents with a null text have none."""
    return docs.where("text IS NOT NULL").select("doc_id", page_count("text", per_page).alias("n"), page_texts("text", per_page).alias("pages"))


def exploded_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with lines from 0."""
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(T.lines("text")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def page_range(pages: DataFrame, first, last) -> DataFrame:
    """Pages first to last, both included."""
    return pages.where(F.col("page").between(first, last))


def read_pdf_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the PDF files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def stream_pdf_bytes(spark: SparkSession, path: str) -> DataFrame:
    """As read_pdf_bytes, over files that keep arriving."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(name, expected fields ...) of the expectation files one folder below a path, by name."""
    found = spark.read.option("multiLine", "true").json(f"{path}/*/expected.json").withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return found.orderBy("name")


def write_markdown(documents: DataFrame, path: str, folders: bool = False) -> None:
    """Documents (doc_id, markdown) as Parquet files of many documents each, or one folder with a text file for each document,
    which only suits as many documents as a file system takes folders."""
    if folders:
        documents.select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
    else:
        documents.select("doc_id", "markdown").write.mode("overwrite").option("compression", "zstd").parquet(path)


def html_to_markdown(html):
    """Title or h1 to ``# ``, other headings to their level, list items to ``- ``; scripts, styles, comments and tags go."""
    t = F.regexp_replace(T.col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<title>.*?</title>|<nav\b.*?</nav>", "")
    t = F.regexp_replace(t, r"(?is)<h1[^>]*>", "\n# ")
    for level in range(2, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?is)</h[1-6]>|</p>|</div>|</ul>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    return T.trimmed(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
