"""Sinks: word lists, anchor tables, shared-match tables, path lists, tracks and a plot page. A folder per family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ends(rows: DataFrame, lengths: DataFrame, n: int, serial: bool = False, order_by: str = "row_id") -> DataFrame:
    """The anchor table of families of n sequences: zeros above, the longest sequence's length below.

    rows: family_id, row_id (or what order_by names, a chain's step), len, pos; lengths: family_id, len. The columns part
    and, with serial, MEM order the rows; without it, place does, which is no column of the written table.
    """
    order = F.row_number().over(Window.partitionBy("family_id").orderBy(order_by))
    name = "MEM" if serial else "place"
    most = lengths.groupBy("family_id").agg(F.max("len").alias("most"))
    columns = lambda value: [value(k).cast("long").alias(f"S_{k + 1}") for k in range(n)]
    body = rows.select("family_id", F.lit(1).alias("part"), order.cast("long").alias(name), F.col("len").cast("long").alias("Length"), *columns(lambda k: F.col("pos")[k]))
    top = most.select("family_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias(name), F.lit(0).cast("long").alias("Length"), *columns(lambda k: F.lit(0)))
    foot = most.select("family_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias(name), F.col("most").cast("long").alias("Length"), *columns(lambda k: F.col("most")))
    return top.unionByName(body).unionByName(foot)


def cns_table(cns: DataFrame, names: list[str]) -> DataFrame:
    """LEN, a coordinate and a chromosome for each sequence, and the word; one row per step of the chain."""
    n = len(names)
    return cns.select("family_id", "step", F.col("len").alias("LEN"), *(F.col("abs_pos")[k].alias(names[k]) for k in range(n)), *(F.col("chr")[k].alias(f"Chr_{names[k]}") for k in range(n)), F.col("word").alias("CNS"))


def labels(genes: DataFrame, length: int | None = None) -> DataFrame:
    """family_id and the column labels of its sequences: gene names, or their first `length` characters."""
    name = F.col("gene") if length is None else F.substring("gene", 1, length)
    return genes.groupBy("family_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq_idx", name.alias("label")))), lambda x: x["label"]).alias("labels"))


def write_words(rows: DataFrame, path: str) -> None:
    rows.sort("family_id", "row_id").select("family_id", "word").write.partitionBy("family_id").text(path)


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """Comma-separated, a folder and one sorted file for each family."""
    rows.repartition("family_id").sortWithinPartitions("family_id", *order).write.partitionBy("family_id").csv(path, header=True)


def anchor_lines(rows: DataFrame, lengths: DataFrame, serial: bool, order_by: str = "row_id") -> DataFrame:
    """family_id, place and line of the anchor tables as text, for families of any number of sequences."""
    pos = lambda value: F.array_join(F.transform(value, lambda x: x.cast("string")), ",")
    joined = lambda *parts: F.concat_ws(",", *(p.cast("string") for p in (parts if serial else parts[1:])))
    sizes = lengths.groupBy("family_id").agg(F.max("len").alias("most"), F.count("*").cast("int").alias("n"))
    order = F.row_number().over(Window.partitionBy("family_id").orderBy(order_by)).cast("long")
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.lit("S_"), k.cast("string"))), ",")
    same = lambda x: F.array_repeat(x, F.col("n"))
    ends = sizes.select("family_id", F.posexplode(F.array(joined(F.lit("MEM"), F.lit("Length"), names), joined(F.lit(0), F.lit(0), pos(same(F.lit(0)))), joined(F.lit(0), F.col("most"), pos(same(F.col("most"))))))).toDF("family_id", "part", "line")
    body = rows.select("family_id", order.alias("serial"), "len", "pos").select("family_id", F.lit(1).alias("part"), "serial", joined(F.col("serial"), F.col("len"), pos(F.col("pos"))).alias("line"))
    ends = ends.select("family_id", F.when(F.col("part") == 2, 2).otherwise(0).alias("part"), F.col("part").cast("long").alias("serial"), "line")
    return body.unionByName(ends).select("family_id", F.struct("part", "serial").alias("place"), "line")


def cns_lines(cns: DataFrame, genes: DataFrame, label: int = 2) -> DataFrame:
    """family_id, place and line: a line for each gene's name, the header with labels of two characters, and the chain's steps."""
    one = F.sort_array(F.collect_list(F.struct("seq_idx", "gene")))
    named = genes.groupBy("family_id").agg(F.transform(one, lambda x: x["gene"]).alias("g"))
    short = F.transform("g", lambda x: F.substring(x, 1, label))
    header = F.concat_ws(",", F.lit("LEN"), F.array_join(short, ","), F.array_join(F.transform(short, lambda x: F.concat(F.lit("Chr_"), x)), ","), F.lit("CNS"))
    top = named.select("family_id", F.posexplode(F.concat("g", F.array(header))).alias("serial", "line")).select("family_id", F.struct(F.lit(0).alias("part"), F.col("serial").cast("long").alias("serial")).alias("place"), "line")
    text = F.concat_ws(",", F.col("len").cast("string"), F.array_join(F.transform("abs_pos", lambda x: x.cast("string")), ","), F.array_join("chr", ","), "word")
    return top.unionByName(cns.select("family_id", F.struct(F.lit(1).alias("part"), F.col("step").cast("long").alias("serial")).alias("place"), text.alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """One sorted text for each family, in a folder of its own."""
    lines.repartition("family_id").sortWithinPartitions("family_id", "place").select("family_id", "line").write.partitionBy("family_id").text(path)


def write_offsets(rows: DataFrame, path: str) -> None:
    """name, start and room of each record of a family's texts put one behind the other."""
    write_table(rows.select("family_id", "seq_idx", "name", "start", "room"), path, ["seq_idx"])


def write_texts(texts: DataFrame, path: str) -> None:
    """The text that a family is searched as: its turned sequences, "#" behind each. The "$" at its very end is left off."""
    texts.repartition("family_id").sortWithinPartitions("family_id", "seq_idx").select("family_id", "bases").write.option("lineSep", "#").partitionBy("family_id").text(path)


def write_tracks(rows: DataFrame, path: str) -> None:
    """kind, seq_idx, start, stop: genes behind the matches of each sequence."""
    rows.repartition("family_id").sortWithinPartitions("family_id", "seq_idx", F.desc("kind"), "start").write.partitionBy("family_id").csv(path, header=True)


def write_paths(chains: DataFrame, path: str) -> None:
    chains.select("family_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("line")).write.partitionBy("family_id").text(path)


def tracks(cns: DataFrame, genes: DataFrame) -> DataFrame:
    """A row for each match in each sequence, and one for each gene: kind, seq_idx, start, stop."""
    each = cns.select("family_id", "len", F.posexplode("abs_pos").alias("seq_idx", "start"))
    matches = each.select("family_id", F.lit("track").alias("kind"), "seq_idx", "start", (F.col("start") + F.col("len") - 1).alias("stop"))
    own = genes.select("family_id", F.lit("gene").alias("kind"), "seq_idx", F.col("gene_start").alias("start"), F.col("gene_end").alias("stop"))
    return matches.unionByName(own)


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title></head><body>
<h1>{title}</h1><svg id="plot" width="960" height="480"></svg>
<script>
const axes = {axes}, rows = {rows};
const svg = document.getElementById("plot"), top = Math.max(1, ...rows.flat());
const x = i => 40 + i * 880 / Math.max(1, axes.length - 1), y = v => 460 - 440 * v / top;
const add = (kind, what) => svg.appendChild(Object.entries(what).reduce((e, [k, v]) => (e.setAttribute(k, v), e), document.createElementNS("http://www.w3.org/2000/svg", kind)));
axes.forEach((name, i) => {{ add("line", {{x1: x(i), x2: x(i), y1: 20, y2: 460, stroke: "black"}}); add("text", {{x: x(i), y: 15, "text-anchor": "middle"}}).textContent = name; }});
rows.forEach(r => add("polyline", {{fill: "none", stroke: "steelblue", points: r.map((v, i) => v ? x(i) + "," + y(v) : "").join(" ")}}));
</script></body></html>
"""


def plot_pages(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """family_id and a page that draws its anchors as lines over parallel axes; 0 leaves an axis out."""
    named = rows.groupBy("family_id").agg(F.sort_array(F.collect_list("pos")).alias("rows")).join(labels(genes), "family_id")
    parts = {"axes": F.to_json("labels"), "rows": F.to_json("rows"), "title": F.concat(F.lit("Family "), F.col("family_id").cast("string"))}
    page = F.lit(PAGE.replace("{{", "{").replace("}}", "}"))
    for name, value in parts.items():
        page = F.replace(page, F.lit("{" + name + "}"), value)
    return named.select("family_id", page.alias("value"))


def write_pages(rows: DataFrame, genes: DataFrame, path: str) -> None:
    plot_pages(rows, genes).write.partitionBy("family_id").text(path)


def brushed(rows: DataFrame, limits: dict[int, tuple[int, int]]) -> DataFrame:
    """Anchors within all the given ranges, by sequence."""
    for k, (low, high) in limits.items():
        rows = rows.where(F.col("pos")[k].between(low, high))
    return rows
