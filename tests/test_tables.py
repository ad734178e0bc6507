"""Sources, selection, joins and reshaping."""

import datetime as dt
from html.parser import HTMLParser
import os
import random
import struct
import time
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import (
    box_outliers, cols_like, drop_empty_columns, five_number, full_join_all, join_lines, latest_column, natural_join,
    ordered_levels, quantiles, recode, rename_like, running_total, split_label, spread, top_k, without_outliers,
)
from panelkit.operators.selection import with_bits
from panelkit.session import checkpoint_dir, settle
from panelkit.sources import acs_table, extract_links, first_links, lookup, read_table, read_wide, read_wide_panel, write_table


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_text_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "city.csv"
    path.write_bytes("\ufeffZip,Population,Cases\n60601,\"6,714\",12\n60602,,\n".encode("utf-8"))
    wide = read_wide(spark, str(path), ["Zip"])
    assert wide.columns == ["Zip", "Population", "Cases"]
    assert rows(wide, "Zip") == [("60601", "6,714", "12"), ("60602", None, None)]
    with pytest.raises(ValueError):
        read_wide(spark, str(path), ["GEOID"])


def test_inferred_and_declared_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("zip,n\n00123,5\n")
    assert dict(read_table(spark, str(path)).dtypes) == {"zip": "int", "n": "int"}
    assert rows(read_table(spark, str(path), "zip string, n double"), "zip") == [("00123", 5.0)]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for fmt, path in (("parquet", "t.parquet"), ("csv", "t.csv")):
        target = str(tmp_path / path)
        write_table(df, target, fmt)
        write_table(df, target, fmt)  # overwrites
        assert rows(read_table(spark, target, "k string, v int"), "k") == [("a", 1), ("b", 2)]
    write_table(df, str(tmp_path / "p"), partition_by=["k"])
    assert sorted(x for x in os.listdir(tmp_path / "p") if x.startswith("k=")) == ["k=a", "k=b"]


def test_links(spark):
    html = "<a class='x' href='/confirmed.csv'>a</a><A HREF=\"/deaths.csv\">b</A><a href='/page'>c</a><a name='n'>d</a>"
    pages = spark.createDataFrame([(1, html), (2, "nothing")], "page_id int, html string")
    links = extract_links(pages)
    assert rows(links, "pos") == [(1, 0, "/confirmed.csv"), (1, 1, "/deaths.csv")]
    assert rows(first_links(links, ["deaths", "population"]), "page_id") == [(1, "/deaths.csv", None)]


def test_census_table_prefix_is_exact(spark):
    acs = spark.createDataFrame([("1", "B01001_001"), ("1", "B01001I_002"), ("2", "B01001_003")], "GEOID string, variable string")
    geos = spark.createDataFrame([("1",), ("1",)], "GEOID string")
    assert rows(acs_table(acs, "B01001"), "variable") == [("1", "B01001_001"), ("2", "B01001_003")]
    assert rows(acs_table(acs, "B01001", geos), "variable") == [("1", "B01001_001")]
    assert rows(acs_table(acs, "B01001", drop=["B01001_001"]), "variable") == [("2", "B01001_003")]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "countyFIPS int, stateFIPS int, prop_x int")
    assert cols_like(df, suffix="FIPS") == ["countyFIPS", "stateFIPS"]
    assert cols_like(df, prefix="prop", contains="x") == ["prop_x"]
    assert rename_like(df, "^prop_", "share_").columns == ["countyFIPS", "stateFIPS", "share_x"]
    assert latest_column(df, ["countyFIPS"], "Cases").columns == ["countyFIPS", "Cases"]


def test_recode_keeps_unknown_codes(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    names = lookup(spark, [("a", "Apple")], "code string, text string")
    assert rows(recode(df, "c", names), "c") == [(None,), ("Apple",), ("z",)]


def test_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b string, c string")
    assert drop_empty_columns(df).columns == ["a", "c"]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x", 10)], "k int, name string, a int")
    b = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "k int, name string, b int")
    assert rows(natural_join(a, b), "k") == [(1, "x", 10, 5)]
    with pytest.raises(ValueError):
        natural_join(a.select("a"), b.select("b"))
    c = spark.createDataFrame([(2, "new")], "k int, name string")
    assert rows(full_join_all([a, c], "k"), "k") == [(1, "x", 10), (2, None, None)]


def test_spread_takes_first_value_present(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0), (1, "a", 5.0, 2.0), (1, "b", 7.0, None)], "k int, n string, v double, w double")
    one = spread(df, ["k"], "n", "v", ["a", "b", "c"])
    assert one.columns == ["k", "a", "b", "c"] and rows(one, "k") == [(1, 5.0, 7.0, None)]
    two = spread(df.where("w is not null or v = 7"), ["k"], "n", ["v", "w"], ["a", "b"])
    assert two.columns == ["k", "v_a", "w_a", "v_b", "w_b"]
    assert rows(two, "k")[0][1] == 5.0 and rows(two, "k")[0][3:] == (7.0, None)


def test_split_label_pads_and_drops(spark):
    df = spark.createDataFrame([("A!!B!!C",), ("A",), (None,)], "label string")
    assert sorted(map(str, rows(split_label(df, "label", ["x", "y"]), "x"))) == sorted(map(str, [(None, None), ("A", None), ("A", "B")]))


def test_without_outliers(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", None)], "k string, v double")
    assert rows(without_outliers(df, "v", above=5), "k") == [("a", 1.0)]
    assert rows(without_outliers(df, "v", ids=("k", ["a"])), "k") == [("b", 9.0), ("c", None)]
    assert rows(without_outliers(df, "v", ids=df.where("k = 'b'").select("k")), "k") == [("a", 1.0), ("c", None)]


def test_running_total_over_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 10).alias("w"))
    got = running_total(df, [F.col("id")], F.col("w"), "upto")
    total, want = 0, {}
    for i in range(1000):
        total += i % 10
        want[i] = total
    assert {r.id: r.upto for r in got.collect()} == want


def test_levels_break_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5), ("d", None)], "k string, v double")
    assert {r.k: r.level for r in ordered_levels(df, "k", "v").collect()} == {"c": 1, "a": 2, "b": 3, "d": 4}
    assert {r.k: r.level for r in ordered_levels(df, "k", "v", descending=True).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert [r.k for r in top_k(df, "v", 2, "k").collect()] == ["a", "b"]


def test_quantiles_and_hinges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 4, 100]] + [(None,)], "v double")
    assert quantiles(df, "v", [0, 0.25, 0.5, 0.75, 1]) == [1.0, 2.0, 2.5, 3.75, 100.0]
    row = five_number(df, "v").first()
    assert (row["min"], row.q1, row.median, row.q3, row["max"], row.missing) == (1.0, 2.0, 2.5, 3.75, 100.0, 1)
    assert rows(box_outliers(df, "v"), "v") == [(100.0,)]
    empty = df.where("v is null")
    assert quantiles(empty, "v", [0.5]) == [None] and box_outliers(empty, "v").count() == 0


def test_one_value_may_fill_most_rows(spark):
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = sorted(5.0 if i % 3 == 0 else float(i) for i in range(9000))
    place = (len(values) - 1) * 0.9
    low = int(place)
    want = values[low] + (place - low) * (values[low + 1] - values[low])
    assert quantiles(df, "v", [0.1, 0.9]) == [5.0, pytest.approx(want)]


def test_joined_lines(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "a", None), (2, "b", "z")], "k int, s string, t string")
    assert rows(join_lines(df, ["k"], "t", "s"), "k") == [(1, "y\nx"), (2, None)]


def test_settled_rows_keep_their_values(spark):
    df = settle(spark.range(5))
    assert rows(df, "id") == [(i,) for i in range(5)]
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


# ---------------------------------------------------------------- wide files as a data source

IDS = ["County Name", "State"]


def long_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_wide_source_reads_any_headers_cut_anywhere(spark, tmp_path):
    (tmp_path / "a.csv").write_text('State,"County Name",2020-01-01,2020-01-02\nIN,"A, b","1,000",2\r\nKY,C,,5\n')
    (tmp_path / "b.csv").write_text("\n \n\ufeffCounty Name,State,note,2020-01-03\nZ,OH,x,7\nY,IN,y,8", encoding="utf-8")
    (tmp_path / "c.csv").write_text("\n")
    (tmp_path / "d.csv").write_text("County Name,State,2020-01-09\n")
    (tmp_path / "_note").write_text("no data")
    want = sorted([("A, b", "IN", dt.date(2020, 1, 1), "1,000"), ("A, b", "IN", dt.date(2020, 1, 2), "2"), ("C", "KY", dt.date(2020, 1, 1), None),
                   ("C", "KY", dt.date(2020, 1, 2), "5"), ("Z", "OH", dt.date(2020, 1, 3), "7"), ("Y", "IN", dt.date(2020, 1, 3), "8")], key=str)
    for size in (1, 2, 7, 20, 41, 1 << 20):
        assert long_rows(read_wide_panel(spark, str(tmp_path), IDS, partitionBytes=size)) == want, size
    some = read_wide_panel(spark, f"file://{tmp_path}", IDS, where={"State": ["IN", "XX"]}, first=dt.date(2020, 1, 2), last=dt.date(2020, 1, 3))
    assert long_rows(some) == [r for r in want if r[1] == "IN" and r[2] >= dt.date(2020, 1, 2)]
    assert read_wide_panel(spark, str(tmp_path / "c.csv"), IDS).count() == 0
    with pytest.raises(ValueError):
        read_wide_panel(spark, str(tmp_path), IDS, where={"Town": ["x"]})
    (tmp_path / "e.csv").write_text("State,2020-01-09\nIN,1\n")
    with pytest.raises(Exception, match="id columns not in"):
        read_wide_panel(spark, str(tmp_path), IDS).collect()


def test_wide_source_takes_filters_from_the_plan(spark, tmp_path, capsys):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    for k in range(4):
        lines = ["County Name,State," + ",".join(map(str, days[k::4]))] + [f"c{i},S{i % 5}," + ",".join(str(i * 100 + j) for j in range(15)) for i in range(50)]
        (tmp_path / f"{k}.csv").write_text("\n".join(lines))
    wanted = (F.col("State") == "S3") & F.col("date").between(dt.date(2020, 1, 10), dt.date(2020, 1, 20)) & (F.col("value") != "5")
    got = read_wide_panel(spark, str(tmp_path), IDS, push=True).filter(wanted)
    got.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(State,S3)" in pushed and "GreaterThanOrEqual(date" in pushed and "LessThanOrEqual(date" in pushed and "value" not in pushed
    assert long_rows(got) == long_rows(read_wide_panel(spark, str(tmp_path), IDS).filter(wanted)) and got.count() == 10 * 11


def test_ten_thousand_small_files_are_planned_without_being_opened(spark, tmp_path):
    for i in range(10_000):
        order = ("County Name,State", f"c{i},IN") if i % 2 else ("State,County Name", f"IN,c{i}")
        (tmp_path / f"{i}.csv").write_text(f"{order[0]},2020-01-{1 + i % 28:02d}\n{order[1]},{i}\n")
    df = read_wide_panel(spark, str(tmp_path), IDS)
    assert df.rdd.getNumPartitions() < 1000
    row = df.agg(F.count("value").alias("n"), F.sum(F.col("value").cast("long")).alias("s"), F.countDistinct("date").alias("d")).first()
    assert tuple(row) == (10_000, sum(range(10_000)), 28)


# ---------------------------------------------------------------- links, beside an independent parser

class Links(HTMLParser):
    """The standard library's parser, told which elements hold text alone."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and any(n == "href" for n, _ in attrs):
            self.found.append((next(v for n, v in attrs if n == "href") or "").strip())


PAGES = [
    """<!-- <a href="/old.csv"> --><script>var x="<a href='/js.csv'>"</script><a href="/new.csv">""",
    """<A HREF=/bare.csv>x</A><a class='b c' data-x="a>b" href='q"uote.csv' href=second.csv>""", "<a title=\"href=/no.csv\" href = '/a&amp;b.csv'>",
    "<style>a[href='/s.csv'] {}</style><title><a href=/t.csv></title><textarea><a href=/u.csv></textarea><a href=/v.csv/>",
    "<a name=x><a href><a href=''><abbr href=/w.csv><area href=/z.csv><a\nhref='/nl.csv'\n>", "text < a href=/no.csv> <a href='/open.csv'",
    "<script>if (a < b) { s = '</scr' + 'ipt>'; t = '<a href=/x.csv>' }</script ><a/href=/slash.csv>", "<!doctype html><?php <a href=/p.csv> ?>",
    "<a href=' /space.csv ' target=_blank>a</a><p><a href=\"x y.csv\">", "", None, "<!-- never closed <a href=/c.csv>"]


def test_links_are_those_a_parser_finds(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")
    got = {}
    for r in extract_links(pages, "").orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["href"])
    for i, page in enumerate(PAGES):
        parser = Links()
        parser.feed(page or "")
        assert got.get(i, []) == parser.found, page
    assert got[0] == ["/new.csv"]


@pytest.mark.parametrize("part", ["<a ", "<a href=x ", "<!--", "<script>", "<a href='", "<a a=b c='d' ", "<", "</", "<a href=/x.csv>"])
def test_long_pages_take_time_in_proportion(spark, part):
    pages = spark.createDataFrame([(1, part * (400_000 // len(part)))], "page_id int, html string")
    begun = time.time()
    assert extract_links(pages).count() == (400_000 // len(part) if part.endswith(".csv>") else 0)
    assert time.time() - begun < 30


def test_addresses_are_made_whole(spark):
    base = "http://h.org/a/b/page.html?q=1#f"
    links = ["x.csv", "/x.csv", "../x.csv", "../../../x.csv", "./x.csv", "//o.org/x.csv", "https://o.org/y", "?z=1", "#t", "", "c/../d/./x.csv", "..", "mailto:a@b"]
    pages = spark.createDataFrame([(i, base, f'<a href="{link}">') for i, link in enumerate(links)]
                                  + [(100, base, '<base href="/data/"><a href="x.csv">'), (101, base, '<base target=_top><a href="x.csv">')],
                                  "page_id int, url string, html string")
    got = {r["page_id"]: r["address"] for r in extract_links(pages, "", base="url").collect()}
    assert [got[i] for i in range(len(links))] == [urljoin(base, link) if link else base.split("#")[0] for link in links]
    assert got[100] == "http://h.org/data/x.csv" and got[101] == "http://h.org/a/b/x.csv"


# ---------------------------------------------------------------- order statistics by bits

def test_bits_are_in_the_order_of_the_numbers(spark):
    draw = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 0.9999999999999999, 1.0000000000000002, 1.7976931348623157e308,
              -1.7976931348623157e308, float("inf"), float("-inf"), 2.0 ** 52, 8.0, 7.999999999999999, 1e-300, 0.1]
    values += [s * 2.0 ** e * (1 + d) for s in (1, -1) for e in range(-1022, 1024, 31) for d in (0.0, 2 ** -52, 1 - 2 ** -52, draw.random())]
    rows = with_bits(spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "v double"), "v", "k").collect()
    known = {r["v"]: r["k"] for r in rows if r["v"] is not None and r["v"] == r["v"]}
    for v, k in known.items():
        raw = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-raw if v < 0 else raw), v
    assert rows[-1]["k"] is None and rows[-2]["k"] > max(known.values())


def test_quantiles_of_groups_and_wide_ranges(spark, capsys):
    draw = np.random.default_rng(2)
    data = {"a": draw.normal(size=501), "b": 10.0 ** draw.uniform(-300, 300, 400) * draw.choice([-1, 1], 400), "c": np.array([7.0]), "d": np.repeat([1.0, 1 + 2 ** -52, 2.0], 5), None: draw.integers(0, 4, 30) * 1.0}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in five_number(df, "v", ["g"]).collect()}
    for g, vs in data.items():
        want = [vs.min(), *np.quantile(vs, [0.25, 0.5]), vs.mean(), np.quantile(vs, 0.75), vs.max()]
        assert list(got[g])[1:7] == pytest.approx(want, rel=1e-12), g
    assert got["a"]["missing"] == 1 and got["e"]["missing"] == 1 and got["e"]["median"] is None
    some = df.filter("g = 'd'")
    assert quantiles(some, "v", [0.5]) == [1 + 2 ** -52] and quantiles(some, "v", [0, 1]) == [1.0, 2.0]
    five_number(df, "v", ["g"]).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan
    assert tuple(five_number(df.limit(0), "v").first()) == (None,) * 6 + (0,) and five_number(df.limit(0), "v", ["g"]).count() == 0
