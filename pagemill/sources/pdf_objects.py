"""PDF files as tables: one row for each object, and what is found by joins over these rows.

Files come as rows (an id and the bytes, as Spark's binaryFile reader gives them, from
any store and as a stream, too); each is split into its objects by a small parser, and
no more is done file by file.  The page tree is walked down a level at a time, outlines
are put in order by list ranking, destinations, resources, fonts and contents are
joined.  Object rows are read many times: write them first (``shared.written``).  Written
tables are far smaller as files than in memory (1.4 bytes a row), so that their size says
nothing about a broadcast: joins are by sort and merge.

Defined cases: a file that is no PDF, or is encrypted, is one row with an error and
nothing else; a damaged one has the objects that can be found, and error "rebuilt" in
the row of its trailer (number 0); an object or a stream that cannot be read has an
error of its own; of repeated ids one file counts, the first by its bytes.  A file is
held in memory whole, as its row is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.ranking import preorder
from pagemill.sources import pdf
from pagemill.sources.shared import written

OBJECTS = "num long, value string, data binary, filters array<string>, error string"
BATCH = 4 << 20  #: bytes of objects handed over at a time
REFERENCE = r"^(\d+) \d+ R$"
LEVELS = 64  #: of a page tree or name tree; deeper ones are cycles or damage


def objects(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, num, value, data, filters, error): value is JSON (see pdf_syntax), data a stream's decoded bytes, filters what is left to decode."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        from pagemill.sources import pdf_syntax

        for b in batches:
            for k in range(b.num_rows):
                raw = b.column(content)[k].as_py()
                try:
                    rows = pdf_syntax.File(raw or b"").objects()
                except pdf_syntax.Damage as e:
                    rows = iter([(0, None, None, [], str(e))])
                held, size = [], 0
                for row in rows:
                    held.append(row)
                    size += len(row[1] or "") + len(row[2] or b"")
                    if size > BATCH:
                        yield batch(b.column(key)[k], held)
                        held, size = [], 0
                if held:
                    yield batch(b.column(key)[k], held)

    def batch(of, rows):
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.string()]
        own = pa.array([of.as_py()] * len(rows), of.type)
        return pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, "num", "value", "data", "filters", "error"])

    one = files.groupBy(key).agg(F.min(content).alias(content)).select(key, content)
    found = one.mapInArrow(run, f"{key} {kind}, {OBJECTS}")
    return found if key == "doc_id" else found.withColumnRenamed(key, "doc_id")


def field(value: Column | str, name: str) -> Column:
    """An entry of a dictionary: a string, or JSON of a dictionary or an array."""
    return F.get_json_object(value if isinstance(value, Column) else F.col(value), f"$['{name}']")


def number_of(value: Column) -> Column:
    """The object that a reference names; null for anything else."""
    return F.regexp_extract(value, REFERENCE, 1).try_cast("long")


def resolved(df: DataFrame, objs: DataFrame, *columns: str) -> DataFrame:
    """df (doc_id, ...) whose columns of JSON values have what a reference names in its place.

    Each join moves all objects, so that columns without a reference are left as they are; df is written to tell.
    """
    df = written(df, "values")
    told = df.agg(*(F.bool_or(number_of(F.col(c)).isNotNull()).alias(f"c{k}") for k, c in enumerate(columns))).first()
    plain = F.when(F.col("value").startswith('"'), F.get_json_object("value", "$")).otherwise(F.col("value"))  # strings stand without quotes, as in field
    held = objs.where("num > 0").select("doc_id", F.col("num").alias("_num"), plain.alias("_held"))
    for c in (c for c, any_ in zip(columns, told, strict=True) if any_):
        df = df.withColumn("_num", number_of(F.col(c))).join(held.hint("merge"), ["doc_id", "_num"], "left")
        df = df.withColumn(c, F.when(F.col("_num").isNull(), F.col(c)).otherwise(F.col("_held"))).drop("_num", "_held")
    return df


def catalogs(objs: DataFrame) -> DataFrame:
    """(doc_id, root): the catalog's dictionary."""
    return resolved(objs.where("num = 0").select("doc_id", field("value", "Root").alias("root")), objs, "root").where("root IS NOT NULL")


def descended(objs: DataFrame, roots: DataFrame, handed: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node, path, value, and handed): the leaves of trees of Kids, from roots (doc_id, node).

    path puts them in order; an entry in handed is that of the nearest node on the way that
    has it.  A node below itself, and all below it, is left out.
    """
    held = objs.where("num > 0").select("doc_id", F.col("num").alias("node"), "value")
    own = [field("value", c).alias(c) for c in handed]
    at = roots.select("doc_id", "node", F.array().cast("array<int>").alias("path"), F.array().cast("array<long>").alias("above"))
    at = at.join(held.hint("merge"), ["doc_id", "node"]).select("*", *own)
    leaves = None
    for _ in range(LEVELS):
        at = written(at.withColumn("kids", F.from_json(field("value", "Kids"), "array<string>")), "nodes")
        ends = at.where("kids IS NULL").select("doc_id", "node", "path", "value", *handed)
        leaves = ends if leaves is None else leaves.unionByName(ends)
        below = at.where("kids IS NOT NULL").select("doc_id", F.col("node").alias("parent"), "path", "above", *(F.col(c).alias(f"_{c}") for c in handed), F.posexplode("kids").alias("k", "kid"))
        below = below.select("doc_id", number_of(F.col("kid")).alias("node"), F.concat("path", F.array("k")).alias("path"), F.concat("above", F.array("parent")).alias("above"), *(f"_{c}" for c in handed))
        below = below.where(~F.array_contains("above", F.col("node")))
        if below.isEmpty():
            break
        below = below.join(held.hint("merge"), ["doc_id", "node"])
        at = below.select("doc_id", "node", "path", "above", "value", *(F.coalesce(field("value", c), F.col(f"_{c}")).alias(c) for c in handed))
    return leaves


def page_nodes(objs: DataFrame) -> DataFrame:
    """(doc_id, page, node, contents, resources, box): the pages, from 1; contents and resources are JSON, the box may be inherited."""
    roots = catalogs(objs).select("doc_id", number_of(field("root", "Pages")).alias("node")).where("node IS NOT NULL")
    found = descended(objs, roots, ("Resources", "MediaBox"))
    found = found.where(F.coalesce(field("value", "Type"), F.lit("/Page")) != "/Pages")
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).cast("long")
    found = found.select("doc_id", page.alias("page"), "node", field("value", "Contents").alias("contents"), F.col("Resources").alias("resources"), F.col("MediaBox").alias("box"))
    return resolved(found, objs, "resources", "box").withColumn("box", F.from_json("box", "array<double>"))


def _text(value: Column) -> Column:
    return F.when(value.startswith("("), F.substring(value, 2, 1 << 30))


def metadata(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, title, author, subject, creator, producer, created, modified, error): the error of a file is that of its trailer.

    Dates stand as in the file ("D:2024..."), null where there is none.
    """
    info = resolved(objs.where("num = 0").select("doc_id", "error", field("value", "Info").alias("info")), objs, "info")
    names = {"title": "Title", "author": "Author", "subject": "Subject", "creator": "Creator", "producer": "Producer", "created": "CreationDate", "modified": "ModDate"}
    info = resolved(info.select("doc_id", "error", *(field("info", v).alias(k) for k, v in names.items())), objs, *names)
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    return info.join(n.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), *(_text(F.col(k)).alias(k) for k in names), "error")


def destinations(objs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, dest, page_index): where names lead, pages from 0; those of the catalog's dictionary and of its name tree."""
    root = catalogs(objs)
    old = resolved(root.select("doc_id", field("root", "Dests").alias("of")), objs, "of")
    old = old.select("doc_id", F.explode(F.from_json("of", "map<string,string>")).alias("dest", "to")).withColumn("dest", F.concat(F.lit("/"), "dest"))
    tree = resolved(root.select("doc_id", field("root", "Names").alias("names")), objs, "names").select("doc_id", field("names", "Dests").alias("top"))
    inline = tree.where(number_of(F.col("top")).isNull() & F.col("top").isNotNull()).select("doc_id", F.col("top").alias("value"))
    kids = inline.select("doc_id", F.explode(F.from_json(field("value", "Kids"), "array<string>")).alias("kid"))
    roots = tree.select("doc_id", number_of(F.col("top")).alias("node")).unionByName(kids.select("doc_id", number_of(F.col("kid")).alias("node"))).where("node IS NOT NULL")
    leaves = descended(objs, roots).select("doc_id", "value").unionByName(inline)
    listed = leaves.select("doc_id", F.from_json(field("value", "Names"), "array<string>").alias("n")).where("n IS NOT NULL")
    new = listed.select("doc_id", F.explode(F.expr("transform(sequence(0, size(n) div 2 - 1), k -> struct(get(n, 2 * k) AS dest, get(n, 2 * k + 1) AS to))")).alias("e")).select("doc_id", "e.dest", "e.to")
    both = resolved(old.unionByName(new), objs, "to")
    return led(both, pages).groupBy("doc_id", "dest").agg(F.min("page_index").alias("page_index"))


def led(df: DataFrame, pages: DataFrame, to: str = "to") -> DataFrame:
    """df with page_index: of the page that an explicit destination (an array, or a dictionary with one as D) begins with; rows that lead nowhere go."""
    first = F.coalesce(F.get_json_object(to, "$[0]"), F.get_json_object(to, "$.D[0]"))
    at = pages.select("doc_id", F.col("node").alias("_node"), (F.col("page") - 1).alias("page_index"))
    return df.withColumn("_node", number_of(first)).join(at.hint("merge"), ["doc_id", "_node"]).drop("_node")


def outline(objs: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, ordinal, depth, node, parent, title, page): outlines in pre-order, depth from 0, the parent null at the top.

    page: from 1; null where a destination does not resolve.  Nodes on cycles, and those
    that no way from the catalog leads to, are left out.
    """
    top = resolved(catalogs(objs).select("doc_id", field("root", "Outlines").alias("of"), number_of(field("root", "Outlines")).alias("top")), objs, "of")
    top = top.where("top IS NOT NULL").select("doc_id", "top", number_of(field("of", "First")).alias("begin"))
    link = lambda c: number_of(field("value", c))
    items = objs.where(F.col("num") > 0).where(field("value", "Title").isNotNull())
    items = items.select("doc_id", F.col("num").alias("node"), link("Parent").alias("parent"), link("First").alias("first"), link("Next").alias("next"), "value")
    items = items.join(top.select("doc_id", "top").hint("merge"), "doc_id")
    # The top itself is a node as well, so that each document's outline is one tree.
    nodes = items.select("doc_id", "node", "parent", "first", "next").unionByName(top.select("doc_id", F.col("top").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("begin").alias("first"), F.lit(None).cast("long").alias("next")))
    nodes = written(nodes, "outline")
    places = preorder(nodes).where("ordinal IS NOT NULL AND depth IS NOT NULL")
    # An item's own tree begins at the top only if the chain of parents ends there.
    found = items.join(places.where("depth > 0").hint("merge"), ["doc_id", "node"])
    to = F.coalesce(field("value", "Dest"), F.get_json_object("value", "$.A.D"))
    found = found.withColumn("to", to).withColumn("action", field("value", "A"))
    found = resolved(found, objs, "action").withColumn("to", F.coalesce("to", F.when(field("action", "S") == "/GoTo", field("action", "D")))).drop("action")
    found = resolved(found, objs, "to")
    title = resolved(found.select("doc_id", "node", field("value", "Title").alias("title")), objs, "title").select("doc_id", "node", _text(F.col("title")).alias("title"))
    direct = led(found.select("doc_id", "node", "to"), pages).select("doc_id", "node", (F.col("page_index") + 1).alias("direct"))
    named = pdf.outline_pages(found.select("doc_id", "node", "parent", F.lit(None).cast("string").alias("title"), F.col("to").alias("dest")), names).select("doc_id", "node", F.col("page").alias("named"))
    out = found.join(title.hint("merge"), ["doc_id", "node"]).join(direct.hint("merge"), ["doc_id", "node"], "left").join(named.hint("merge"), ["doc_id", "node"], "left")
    return out.select("doc_id", (F.col("ordinal") - 1).cast("long").alias("ordinal"), (F.col("depth") - 1).cast("long").alias("depth"), "node", F.when(F.col("parent") != F.col("top"), F.col("parent")).alias("parent"), "title", F.coalesce("direct", "named").cast("long").alias("page"))
