import pytest

from braidwork.operators import quality
from braidwork.operators.blocking import Refused
from braidwork.operators.store import Store, plan_loads
from braidwork.plans import report
from braidwork.sources import files, html, sites

MAP = {"name": "title", "kind": "category", "cost": "price", "about": "description"}


def test_upsert(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = spark.createDataFrame([("a", "One", "x", "1.5", "long"), ("b", "Two", "", "bad", "")], "id string, name string, kind string, cost string, about string")
    assert store.load(first, "left", MAP, "id") == {"offered": 2, "inserted": 2, "updated": 0}
    assert store.load(first.drop("about"), "left", MAP, "id") == {"offered": 2, "inserted": 0, "updated": 2}
    rows = {r["external_id"]: r for r in store.read("record").collect()}
    assert rows["a"]["description"] == "long" and rows["b"]["price"] is None and rows["b"]["category"] is None
    assert store.load(first, "right", MAP, "id")["inserted"] == 2 and store.read("record").count() == 4
    store.check()
    with pytest.raises(Refused):
        store.source("left", "left_id", "price")
    with pytest.raises(Refused):
        store.source("nobody", "left_id", "price")
    found = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 4)], "record_id long, entity long")
    for _ in range(2):
        store.write_entities(found)
        assert store.read("entity").count() == 3 and store.read("record_entity").count() == 4
    store.check()


def test_keys_and_titles(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    twice = spark.createDataFrame([("a", "One"), ("a", "Two")], "id string, name string")
    store.load(twice, "left", MAP, "id")
    assert {r["external_id"] for r in store.read("record").collect()} == {"row-0", "row-1"}
    with pytest.raises(Refused):
        store.load(spark.createDataFrame([("a", "  ")], "id string, name string"), "left", MAP, "id")
    with pytest.raises(Refused):
        store.load(spark.createDataFrame([("a",)], "id string"), "left", MAP, "id")


def test_rules_can_fail(spark):
    schema = "rating_stars int, price_listing_gbp double, price_excl_tax_gbp double, tax_gbp double, price_incl_tax_gbp double, stock_count int, description string"
    good = spark.createDataFrame([(1, 2.0, 2.0, 0.0, 2.0, 3, "x")] * 2, schema)
    assert quality.validate(good).where("not ok").count() == 0
    quality.gate(quality.validate(good))
    bad = spark.createDataFrame([(None, 2.0, 2.0, 0.0, 99.0, None, "")] * 2, schema)
    assert quality.validate(bad).where("not ok").count() == 5
    with pytest.raises(Refused):
        quality.gate(quality.validate(bad))


def test_pages():
    page = """<article class="product_pod"><h3><a href="x_1/index.html" title="A long title">A lo...</a></h3>
      <p class="star-rating Three"></p><p class="price_color">£1.00</p><p class="availability"> In stock </p></article>"""
    assert html.listing(page) == [{"title": "A long title", "price": "£1.00", "rating": "Three", "availability": "In stock", "detail_url": html.BASE + "x_1/index.html"}]
    assert html.listing("<p>none</p>") == [] and html.quotes(None) == []
    page = """<ul class="breadcrumb"><li><a>Home</a></li><li><a>Books</a></li><li><a>Poetry</a></li></ul><div id="product_description"><h2>x</h2></div>
      <p>Text</p><table class="table-striped"><tr><th>UPC</th><td>u1</td></tr></table>"""
    got = html.detail(page)[0]
    assert (got["upc"], got["category"], got["description"], got["tax"]) == ("u1", "Poetry", "Text", "")


def test_which_sources_load():
    sources = {
        "shop": {"path": "clean.csv", "raw_path": "raw.csv", "required": True}, "extra": {"path": "extra.csv", "required": False},
    }
    assert plan_loads(sources, {"clean.csv", "extra.csv"}.__contains__) == ["shop", "extra"]
    assert plan_loads(sources, {"clean.csv"}.__contains__) == ["shop"]
    with pytest.raises(Refused, match="nothing has been checked"):
        plan_loads(sources, {"raw.csv", "extra.csv"}.__contains__)
    with pytest.raises(Refused):
        plan_loads(sources, {"extra.csv"}.__contains__)


def test_crawl_goes_on_after_failures(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("refused")
        return "page of " + url

    todo = spark.createDataFrame([("u/one", "one"), ("u/bad", "bad"), ("u/two", "two")], "url string, slug string")
    rows = {r["slug"]: (r["html"], r["failure"]) for r in html.crawl(todo, fetch).collect()}
    assert rows == {"one": ("page of u/one", None), "bad": (None, "OSError: refused"), "two": ("page of u/two", None)}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffleft_id,right_id,note\n007,1,\"x, \"\"y\"\"\"\n007,1,\n".encode())
    rows = files.read_csv_text(spark, f"file://{tmp_path}/a.csv").collect()
    assert rows[0].asDict() == {"left_id": "007", "right_id": "1", "note": 'x, "y"'} and rows[1]["note"] == ""
    assert [tuple(r) for r in files.read_labels(spark, f"file://{tmp_path}/a.csv").collect()] == [("007", "1")]
    (tmp_path / "b.csv").write_bytes("name\ncaf\u00e9\n".encode("latin-1"))
    assert files.read_csv_text(spark, f"file://{tmp_path}/b.csv").first()["name"] == "caf\u00e9"
    with pytest.raises(Refused):
        files.read_labels(spark, f"file://{tmp_path}/b.csv")
    (tmp_path / "p.html").write_text("<p>caf\u00e9</p>")
    assert [r["html"] for r in html.saved_pages(spark, f"file://{tmp_path}").collect()] == ["<p>caf\u00e9</p>"]
    with pytest.raises(Refused):
        (tmp_path / "empty").mkdir()
        html.saved_pages(spark, f"file://{tmp_path}/empty")
    run = {"rows": {"b": 1, "a": [0.5, None]}}
    assert files.read_run(files.recorded(run), ["a", "b"]) == run["rows"] or files.read_run(files.recorded(run), ["a", "b"]) == run
    with pytest.raises(Refused):
        files.read_run(files.recorded(run), ["a"])
    with pytest.raises(Refused):
        files.plain(object())
    assert sites.site("books").urls()[0].endswith("page-1.html") and len(sites.site("quotes").urls()) == 20
    with pytest.raises(Refused):
        sites.site("nowhere")


def test_column_review():
    found = quality.review_columns(["id", "name", "colour", "odd"], {"name": "title", "cost": "price"}, "id", {"colour": "not matched on"})
    assert found == {"stored": ["name"], "absent": ["cost"], "key": ["id"], "explained": ["colour"], "unexplained": ["odd"]}


def test_report():
    assert "| a   |" in report.render(["x", "n"], [["a", 1]])
    text = report.splice("<!-- t -->\nold\n<!-- /t -->", {"t": "new"})
    assert text == "<!-- t -->\nnew\n<!-- /t -->"
    with pytest.raises(Refused):
        report.splice("nothing", {"t": "new"})
    with pytest.raises(Refused):
        report.policy_table({"a": (0.1, 0.2, 0.3), "b": (0.2, 0.3, 0.4)}, "a")


def test_report_refusals():
    rows = [("plain", 0.9, 0.8, 0.85), ("veto", 0.95, 0.8, 0.87)]
    assert "**0.870**" in report.model_table(rows, "veto")
    with pytest.raises(Refused):
        report.model_table(rows, "plain")
    ends = [("tight", 0.9, 0.7, 0.8, 0.6), ("wide", 0.6, 0.9, 0.7, 0.9)]
    table = report.opposite_table(ends)
    assert "**0.800**" in table and "**0.900**" in table
    for bad in ([*ends, ("both", 0.9, 0.9, 0.9, 0.95)], [*ends, ("tie", 0.9, 0.7, 0.8, 0.5)]):
        with pytest.raises(Refused):
            report.opposite_table(bad)
    layers = report.layers_table({"all": (0.7, 0), "few": (0.6, 3)}, {"all": (0.9, 0), "few": (0.8, 1)}, 20, 9)
    assert "all 9 features" in layers and "3/20" in layers
    with pytest.raises(Refused):
        report.layers_table({"few": (0.6, 3)}, {"few": (0.8, 1)}, 20, 9)
    assert "1,234" in report.search_space_table([("k = 3", 0.9, 1234, 0.05)]) and "5.00%" in report.search_space_table([("k = 3", 0.9, 1234, 0.05)])
    text = "before\n| model | precision | recall | F1 |\n|-|-|-|-|\n| old | 1 | 1 | 1 |\nafter"
    new = report.splice(text, report.built({"model": {"rows": rows, "shipped": "veto"}}))
    assert new.startswith("before\n<!-- model -->\n| model") and new.endswith("<!-- /model -->\nafter") and "old" not in new
    assert report.splice(new, report.built({"model": {"rows": rows, "shipped": "veto"}})) == new
    for bad in ("no table here", text + "\n\n" + text):
        with pytest.raises(Refused):
            report.splice(bad, {"model": "x"})
    with pytest.raises(Refused):
        report.built({"nothing": {}})
