"""Plot pages of parallel axes: scales, what lies between axes, pages of bounded size with brushes, and pages from a template.

A page shows each anchor as a line as long as its family has few of them. Beyond that it shows ribbons: for each two axes
that lines join, and each two stretches of these axes, how many lines go from one to the other. All anchors count in them,
and there are at most axes * stretches^2, however many anchors a family has. A position of 0 is an absent sequence; the
line goes on to the next axis that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources.writers import labels

#: Lines that a page shows one by one; stretches of an axis beyond that; largest template in bytes.
LINES, STRETCHES, TEMPLATE_BYTES = 2_000, 64, 1 << 20


def _points(rows: DataFrame) -> DataFrame:
    return rows.select("family_id", F.posexplode("pos").alias("axis", "at")).where("at <> 0")


def scales(rows: DataFrame) -> DataFrame:
    """family_id, axis, low, high, n: least and greatest position on each axis, and how many there are; axes without any have no row."""
    return _points(rows).groupBy("family_id", "axis").agg(F.min("at").cast("long").alias("low"), F.max("at").cast("long").alias("high"), F.count("*").alias("n"))


def steps(rows: DataFrame) -> DataFrame:
    """family_id, a, b, at_a, at_b: each part of a line, from an axis to the next one where the sequence is not absent."""
    there = F.filter(F.transform("pos", lambda x, k: F.struct(k.alias("axis"), x.cast("long").alias("at"))), lambda p: p["at"] != 0)
    kept = rows.select("family_id", there.alias("p")).where(F.size("p") > 1)
    parts = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda q, k: F.struct(F.get("p", k).alias("a"), q.alias("b")))
    return kept.select("family_id", F.explode(parts).alias("s")).select("family_id", F.col("s.a.axis").alias("a"), F.col("s.b.axis").alias("b"), F.col("s.a.at").alias("at_a"), F.col("s.b.at").alias("at_b"))


def ribbons(rows: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """family_id, a, b, leaves, enters, n: how many lines go from a stretch of axis a to one of axis b; stretches are equal parts of a scale."""
    # A row a family, with an entry an axis.
    ends = scales(rows).groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", F.struct("low", "high")))).alias("ends"))

    def stretch(axis: str, at: str) -> Column:
        return F.expr(f"({at} - ends[{axis}].low) * {stretches} div (ends[{axis}].high - ends[{axis}].low + 1)").cast("int")

    placed = steps(rows).join(ends, "family_id").select("family_id", "a", "b", stretch("a", "at_a").alias("leaves"), stretch("b", "at_b").alias("enters"))
    return placed.groupBy("family_id", "a", "b", "leaves", "enters").agg(F.count("*").alias("n"))


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>svg { font: 11px sans-serif; } .line { fill: none; stroke: steelblue; } .ribbon { fill: none; stroke: steelblue; stroke-opacity: .5; } .axis { stroke: black; } .hold { fill: gray; fill-opacity: .25; } .strip { fill: transparent; cursor: crosshair; }</style>
</head><body><h1>{title}</h1><p id="note"></p><svg id="plot" width="1000" height="520"></svg>
<script>
const axes = {axes}, scales = {scales}, lines = {lines}, ribbons = {ribbons}, stretches = {stretches};
const svg = document.getElementById("plot"), TOP = 40, FOOT = 500;
const held = axes.map(() => null), shown = [];
const draw = (kind, what, text) => {
  const e = document.createElementNS("http://www.w3.org/2000/svg", kind);
  for (const k in what) e.setAttribute(k, what[k]);
  if (text !== undefined) e.textContent = text;
  return svg.appendChild(e);
};
const x = i => 60 + i * 880 / Math.max(1, axes.length - 1);
const span = i => scales[i] || [0, 1];
const y = (i, v) => { const [a, b] = span(i); return FOOT - (FOOT - TOP) * (v - a) / Math.max(1, b - a); };
const value = (i, h) => { const [a, b] = span(i); return a + (FOOT - h) / (FOOT - TOP) * Math.max(1, b - a); };
const middle = (i, k) => { const [a, b] = span(i); return a + (k + 0.5) * (b - a + 1) / stretches; };
for (const [length, pos] of lines) {
  const there = pos.map((v, i) => [i, v]).filter(p => p[1] !== 0);
  const e = draw("polyline", {class: "line", points: there.map(([i, v]) => x(i) + "," + y(i, v)).join(" ")});
  shown.push([e, new Map(there)]);
  for (const [i, v] of there) shown.push([draw("rect", {class: "hold", x: x(i) - 2, y: y(i, v + length), width: 4, height: Math.max(1, y(i, v) - y(i, v + length))}), new Map(there)]);
}
for (const [a, b, from, to, n] of ribbons) {
  const at = new Map([[a, middle(a, from)], [b, middle(b, to)]]);
  shown.push([draw("polyline", {class: "ribbon", "stroke-width": 1 + Math.log2(n), points: x(a) + "," + y(a, at.get(a)) + " " + x(b) + "," + y(b, at.get(b))}), at]);
}
const refresh = () => {
  for (const [e, at] of shown) {
    const inside = held.every((r, i) => !r || (at.has(i) ? r[0] <= at.get(i) && at.get(i) <= r[1] : lines.length === 0));
    e.style.display = inside ? "" : "none";
  }
};
axes.forEach((name, i) => {
  draw("line", {class: "axis", x1: x(i), x2: x(i), y1: TOP, y2: FOOT});
  draw("text", {x: x(i), y: 15, "text-anchor": "middle"}, name);
  if (!scales[i]) { draw("text", {x: x(i), y: 30, "text-anchor": "middle"}, "absent"); return; }
  for (let k = 0; k <= 4; k++) {
    const v = Math.round(span(i)[0] + k * (span(i)[1] - span(i)[0]) / 4);
    draw("line", {class: "axis", x1: x(i) - 4, x2: x(i), y1: y(i, v), y2: y(i, v)});
    draw("text", {x: x(i) - 6, y: y(i, v) + 4, "text-anchor": "end"}, v);
  }
  const mark = draw("rect", {class: "hold", x: x(i) - 8, width: 16, y: TOP, height: 0});
  const strip = draw("rect", {class: "strip", x: x(i) - 12, width: 24, y: TOP, height: FOOT - TOP});
  let from = null;
  const height = e => Math.min(FOOT, Math.max(TOP, e.clientY - svg.getBoundingClientRect().top));
  strip.addEventListener("pointerdown", e => { from = height(e); strip.setPointerCapture(e.pointerId); });
  strip.addEventListener("pointermove", e => {
    if (from === null) return;
    const [a, b] = [Math.min(from, height(e)), Math.max(from, height(e))];
    held[i] = b - a < 2 ? null : [value(i, b), value(i, a)];
    mark.setAttribute("y", a);
    mark.setAttribute("height", held[i] ? b - a : 0);
    refresh();
  });
  strip.addEventListener("pointerup", e => {
    if (Math.abs(height(e) - from) < 2) { held[i] = null; mark.setAttribute("height", 0); refresh(); }
    from = null;
  });
});
document.getElementById("note").textContent = ribbons.length ? "Ribbons: the thicker, the more matches." : lines.length + " matches.";
</script></body></html>
"""


def pages(rows: DataFrame, genes: DataFrame, lines: int = LINES, stretches: int = STRETCHES) -> DataFrame:
    """family_id and value, a page that needs no other file; families of more than `lines` anchors are shown as ribbons."""
    if lines < 1 or stretches < 1:
        raise ValueError("a page needs a line and a stretch at least")
    sized = rows.groupBy("family_id").agg(F.count("*").alias("rows"))
    few = rows.join(sized.where(F.col("rows") <= lines), "family_id", "left_semi")
    many = rows.join(sized.where(F.col("rows") > lines), "family_id", "left_semi")
    long = F.transform("pos", lambda v: v.cast("long"))
    each = few.groupBy("family_id").agg(F.sort_array(F.collect_list(F.struct(long.alias("pos"), F.col("len").cast("long").alias("len")))).alias("x"))
    # Arrays of [length, positions] and of [a, b, from, to, n].
    each = each.select("family_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["len"].cast("string"), F.lit(","), F.to_json(r["pos"]), F.lit("]"))), ","), F.lit("]")).alias("lines"))
    drawn = ribbons(many, stretches).groupBy("family_id").agg(F.to_json(F.sort_array(F.collect_list(F.array("a", "b", "leaves", "enters", "n")))).alias("ribbons"))
    ends = scales(rows).groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", F.array("low", "high")))).alias("ends"))
    named = sized.join(labels(genes), "family_id").join(ends, "family_id", "left").join(each, "family_id", "left").join(drawn, "family_id", "left")
    own = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda k: F.coalesce(F.to_json(F.col("ends")[k]), F.lit("null")))
    # A name must not end the script that it stands in.
    safe = lambda text: F.replace(text, F.lit("</"), F.lit("<\\/"))
    none = F.lit("[]")
    parts = {
        "title": F.concat(F.lit("Family "), F.col("family_id").cast("string")), "scales": F.concat(F.lit("["), F.array_join(own, ","), F.lit("]")),
        "stretches": F.lit(str(stretches)), "lines": F.coalesce("lines", none), "ribbons": F.coalesce("ribbons", none), "axes": safe(F.to_json("labels")),
    }
    page = F.lit(PAGE)
    for name, value in parts.items():
        page = F.replace(page, F.lit("{" + name + "}"), value)
    return named.select("family_id", page.alias("value"))


def write_pages(rows: DataFrame, genes: DataFrame, path: str, **options) -> None:
    pages(rows, genes, **options).write.partitionBy("family_id").text(path)


def read_template(spark: SparkSession, path: str) -> list[str]:
    """The lines of a page template; one file of at most TEMPLATE_BYTES. None there is an empty list, as nothing is written then."""
    whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= TEMPLATE_BYTES).take(2)
    if len(whole) != 1:
        raise ValueError(f"{path} is not one file of at most {TEMPLATE_BYTES} bytes")
    return whole[0].value.replace("\r", "").removesuffix("\n").split("\n")


def template_lines(genes: DataFrame, template: list[str], table: str) -> DataFrame:
    """family_id, place and line: the template for each family, with its axes, their number and the name of its table.

    Lines with the marks CHANGE-1 to CHANGE-5 are written anew: names of axes, two arrays of zeros, the number of
    sequences, and the line that reads the table.
    """
    n = F.col("n")
    listed = lambda of: F.array_join(F.transform(F.sequence(F.lit(1), n), of), ", ")
    zeros = listed(lambda k: F.lit("0"))
    anew = {
        "CHANGE-1": F.concat(F.lit("var spec = ["), listed(lambda k: F.concat(F.lit('"S_'), k.cast("string"), F.lit('"'))), F.lit("];")),
        "CHANGE-2": F.concat(F.lit("var XC = [ "), zeros, F.lit("];")),
        "CHANGE-3": F.concat(F.lit("var YC = [ "), zeros, F.lit("];")),
        "CHANGE-4": F.concat(F.lit("var n = "), n.cast("string"), F.lit(";")),
        "CHANGE-5": F.lit(f'd3.csv("{table}", function(error, cars) {{'),
    }
    marked = lambda line: next((anew[m] for m in anew if m in line), F.lit(line))
    sizes = genes.groupBy("family_id").agg(F.count("*").cast("int").alias("n"))
    return sizes.select("family_id", F.posexplode(F.array(*(marked(line) for line in template))).alias("place", "line"))
