"""Point files in, tables and graphs out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nervemap.functions.sparse import from_pairs
from nervemap.runtime import materialize, numbered, partitions, shared_dir


def lines_in_place(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of the lines that aren't blank, numbered from 0 as they stand: by file in the order of names, then by place in the file.

    A file is read in blocks, and a task numbers the lines of its blocks; a row a block says where each begins. Nothing is sorted but these.
    """
    found = spark.read.text(path)
    meta = found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    held = materialize(meta.where(F.trim("value") != ""), "lines")
    # a row for each block of a file
    blocks = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(blocks.select("file", "block", "least", earlier.alias("before")), "blocks")
    # lines of a block are numbered by how many of it come before; blank ones have left gaps
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return held.withColumn("place", place).join(starts.select("file", "block", "before"), ["file", "block"]).select((F.col("before") + F.col("place")).alias("id"), "value")


def read_points(spark: SparkSession, path: str, dims: int = 2, in_place: bool = False) -> DataFrame:
    """(id, features) of lines of numbers between white space; ids follow the order of values, or, ``in_place``, that of lines and files. Fields beyond ``dims`` are ignored."""
    parts = F.split(F.trim("value"), r"\s+")
    features = F.slice(parts, 1, dims).cast("array<double>").alias("features")
    if in_place:
        return lines_in_place(spark, path).select("id", features)
    out, _ = numbered(spark.read.text(path).where(F.trim("value") != "").select(features), "features", name="points")
    return out.select(F.col("_row").alias("id"), "features")


def read_labelled(spark: SparkSession, path: str, dims: int, sparse: bool = False, in_place: bool = False) -> DataFrame:
    """(id, label, features) of lines ``label index:value ...`` with indices from 0; missing ones are zero, or, ``sparse``, aren't there (``functions.sparse``).

    ``in_place``: ids follow lines and files; they do anyway for sparse features, which have no order.
    """
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("key"), F.split(p, ":")[1].cast("double").alias("value")))
    label = parts[0].cast("int").alias("label")
    if sparse:
        return lines_in_place(spark, path).select("id", label, from_pairs(dims, pairs).alias("features"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))).alias("features")
    if in_place:
        return lines_in_place(spark, path).select("id", label, F.map_from_entries(pairs).alias("m")).select("id", "label", dense(F.col("m")))
    lines = spark.read.text(path).where(F.trim("value") != "").select(label, F.map_from_entries(pairs).alias("m"))
    out, _ = numbered(lines.select("label", dense(F.col("m"))), "label", "features", name="labelled")
    return out.select(F.col("_row").alias("id"), "label", "features")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").csv(path)


def ramp(x: float) -> tuple[int, int, int]:
    """Red, green and blue from 0 (blue) over a half (green) to 1 (red)."""
    high = 2.0 * min(1.0, max(0.0, x)) - 1.0
    red, blue = int(255.0 * max(0.0, high)), int(255.0 * max(0.0, -high))
    return red, 255 - red - blue, blue


def to_gexf(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as GEXF text, in the driver; ``write_gexf`` writes one of any size. Nodes and edges are as large or thick as their rows (20 to 50, as share of 50); nodes have the colour of their lens."""
    from xml.sax.saxutils import quoteattr

    label = F.col("node_label").cast("string") if "node_label" in nodes.columns else F.lit("")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">', '<graph mode="static" defaultedgetype="undirected">', "<nodes>"]
    size = lambda n: min(50.0, max(20.0, float(n))) / 50.0
    for x in nodes.select("cluster_id", "lens_mean", "cardinality", F.coalesce(label, F.lit("")).alias("name")).orderBy("cluster_id").toLocalIterator():
        r, g, b = ramp(x["lens_mean"])
        out.append(f'<node id="{x["cluster_id"]}" label={quoteattr(x["name"])}><viz:size value="{size(x["cardinality"])}"/><viz:color r="{r}" g="{g}" b="{b}"/></node>')
    out += ["</nodes>", "<edges>"]
    for n, x in enumerate(edges.orderBy("src", "dst").toLocalIterator()):
        out.append(f'<edge id="{n}" source="{x["src"]}" target="{x["dst"]}" weight="{size(x["cardinality"]) * 0.1}"><viz:thickness value="{size(x["cardinality"])}"/></edge>')
    return "\n".join([*out, "</edges>", "</graph>", "</gexf>", ""])


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, at, value): the lines of ``to_gexf`` for nodes and edges, and where they stand."""
    label = F.coalesce(F.col("node_label").cast("string"), F.lit("")) if "node_label" in nodes.columns else F.lit("")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        label = F.replace(label, F.lit(sign), F.lit(name))
    both = F.contains(label, F.lit('"')) & F.contains(label, F.lit("'"))
    quote = F.when(F.contains(label, F.lit('"')) & ~both, "'").otherwise('"')
    label = F.concat(quote, F.when(both, F.replace(label, F.lit('"'), F.lit("&quot;"))).otherwise(label), quote)
    size = F.least(F.lit(50.0), F.greatest(F.lit(20.0), F.col("cardinality").cast("double"))) / 50.0
    high = 2.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("lens_mean"))) - 1.0
    red, blue = ((F.greatest(F.lit(0.0), x) * 255.0).cast("int") for x in (high, -high))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    shown = text('<node id="', F.col("cluster_id"), '" label=', label, '><viz:size value="', size, '"/><viz:color r="', red, '" g="', 255 - red - blue, '" b="', blue, '"/></node>')
    placed, _ = numbered(edges.select("src", "dst", "cardinality"), "src", "dst", name="edges")
    drawn = text('<edge id="', F.col("_row"), '" source="', F.col("src"), '" target="', F.col("dst"), '" weight="', size * 0.1, '"><viz:thickness value="', size, '"/></edge>')
    return nodes.select(F.lit(0).alias("kind"), F.col("cluster_id").cast("long").alias("at"), shown.alias("value")).unionByName(placed.select(F.lit(1).alias("kind"), F.col("_row").alias("at"), drawn.alias("value")))


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph of ``to_gexf`` as one file, of any size: tasks write their lines to the shared folder, which then stream into the file one after another."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">\n<graph mode="static" defaultedgetype="undirected">\n<nodes>\n'
    lines = materialize(gexf_lines(nodes, edges), "graph")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    try:
        for kind, before, after in ((0, head, "</nodes>\n<edges>\n"), (1, "", "</edges>\n</graph>\n</gexf>\n")):
            out.write(before.encode())
            parts = f"{shared_dir(spark).rstrip('/')}/nervemap-gexf-{uuid.uuid4().hex}"
            own = lines.where(F.col("kind") == kind)
            own.repartitionByRange(partitions(spark), "at").sortWithinPartitions("at").select("value").write.text(parts)
            folder = jvm.org.apache.hadoop.fs.Path(parts)
            fs = folder.getFileSystem(conf)
            for name in sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")):
                held = fs.open(jvm.org.apache.hadoop.fs.Path(name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, conf, False)
                held.close()
            fs.delete(folder, True)
            out.write(after.encode())
    finally:
        out.close()
