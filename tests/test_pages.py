"""Plot pages: exact lines and ribbons, scales, absent axes, and pages from a template."""

import json
import re

import pytest

from lociweave.sources import pages, writers

ANCHORS = "family_id long, row_id long, len int, pos array<int>"
ROWS = [(1, 0, 3, [5, 0, 9]), (1, 1, 2, [0, 4, 0]), (1, 2, 2, [7, 8, 1]), (2, 0, 4, [3, 0, 0])]


def genes_of(spark):
    return spark.createDataFrame([(f, k, f"g{f}{k}") for f in (1, 2, 3) for k in range(3)] + [(4, 0, "</script>")], "family_id long, seq_idx int, gene string")


def part(page, name):
    return json.loads(re.search(rf"\b{name} = (.*?)(?:, (?:scales|lines|ribbons|stretches) =|;\n)", page)[1])


def test_scales_and_steps_skip_absent_axes(spark):
    rows = spark.createDataFrame(ROWS, ANCHORS)
    assert sorted(map(tuple, pages.scales(rows).where("family_id = 1").collect())) == [(1, 0, 5, 7, 2), (1, 1, 4, 8, 2), (1, 2, 1, 9, 2)]
    assert sorted(map(tuple, pages.steps(rows).collect())) == [(1, 0, 1, 7, 8), (1, 0, 2, 5, 9), (1, 1, 2, 8, 1)]
    assert pages.ribbons(rows.limit(0)).collect() == []


def test_pages_hold_lines_or_ribbons(spark):
    rows = spark.createDataFrame([*ROWS, (4, 0, 1, [6])], ANCHORS)
    got = {r.family_id: r.value for r in pages.pages(rows, genes_of(spark), lines=2, stretches=2).collect()}
    assert sorted(got) == [1, 2, 4]
    assert part(got[1], "lines") == [] and part(got[1], "ribbons") == [[0, 1, 1, 1, 1], [0, 2, 0, 1, 1], [1, 2, 1, 0, 1]]
    assert part(got[2], "lines") == [[4, [3, 0, 0]]] and part(got[2], "ribbons") == [] and part(got[2], "scales") == [[3, 3], None, None]
    assert part(got[1], "axes") == ["g10", "g11", "g12"]
    assert got[4].count("</script>") == 1 and "<\\/script>" in got[4]
    whole = pages.pages(rows, genes_of(spark)).where("family_id = 1").first().value
    assert part(whole, "lines") == [[2, [0, 4, 0]], [3, [5, 0, 9]], [2, [7, 8, 1]]]
    with pytest.raises(ValueError):
        pages.pages(rows, genes_of(spark), lines=0)


def test_ribbons_count_every_line_of_a_large_family(spark):
    rows = spark.range(5_000).selectExpr("1L AS family_id", "id AS row_id", "5 AS len", "array(int(id) + 1, int(id % 100) + 1, 7) AS pos")
    ribbons = pages.ribbons(rows, 8).collect()
    assert sum(r.n for r in ribbons) == 10_000 and len(ribbons) <= 2 * 64
    assert {r.enters for r in ribbons if r.b == 2} == {0}
    page = pages.pages(rows, genes_of(spark), stretches=8).first().value
    assert sum(x[4] for x in part(page, "ribbons")) == 10_000 and len(page) < 20_000


def test_template_pages(spark, tmp_path):
    (tmp_path / "t.html").write_text("<b>\nvar spec = []; // CHANGE-1\r\nx // CHANGE-2\ny // CHANGE-3\nn // CHANGE-4\nd // CHANGE-5\n\n</b>\n")
    template = pages.read_template(spark, str(tmp_path / "t.html"))
    got = [r.line for r in pages.template_lines(genes_of(spark), template, "MEM_2_30.csv").where("family_id = 1").orderBy("place").collect()]
    assert got == ["<b>", 'var spec = ["S_1", "S_2", "S_3"];', "var XC = [ 0, 0, 0];", "var YC = [ 0, 0, 0];", "var n = 3;", 'd3.csv("MEM_2_30.csv", function(error, cars) {', "", "</b>"]
    (tmp_path / "u.html").write_text("two")
    with pytest.raises(ValueError):
        pages.read_template(spark, str(tmp_path / "*.html"))


def test_texts_that_families_are_searched_as(spark, tmp_path):
    texts = spark.createDataFrame([(1, 1, "GG"), (1, 0, "ACG"), (2, 0, "")], "family_id long, seq_idx int, bases string")
    writers.write_texts(texts, str(tmp_path / "t"))
    found = {p.name: "".join(f.read_text() for f in p.glob("part-*")) for p in (tmp_path / "t").glob("family_id=*")}
    assert found == {"family_id=1": "ACG#GG#", "family_id=2": "#"}
