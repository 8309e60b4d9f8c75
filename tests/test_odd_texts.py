"""Queries over texts that are rare in the tables, against their SQL's rules in plain Python."""

import re

from braidwork.plans import catalogue
from braidwork.sources import files

TEXTS = [
    "one\r\ntwo", "a\rb", "\r\n", " leads", "trails \t", "\ttab", "   ", "", "ends\n", "\nstarts", '"quoted"', '"', 'a "b", c', "back\\slash\\", "\\", '\\"',
    "a,b", "bad � sign", "﻿mark", "#no comment", " wide　", "nul\x00l", "NULL", "null", "x y\x85z\x0bv",
]


def documents(spark, folder, texts):
    rows = [(i + 1, t, "en" if i % 3 else "fr") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_csv_text(spark, tmp_path):
    for name, texts in (("all", TEXTS), *((f"{i}", [t, "second", t]) for i, t in enumerate(TEXTS[:10]))):
        documents(spark, f"{tmp_path}/{name}", texts)
        got = {(r["doc_id"], r["lang"], r["text"]) for r in catalogue.csv_text(spark, f"{tmp_path}/{name}").collect()}
        assert got == {(str(i + 1), "" if (i + 1) % 7 == 0 else "en" if i % 3 else "fr", t) for i, t in enumerate(texts)}


def test_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8"), ("b", "latin-1")):
        rows = "".join(f"{i},plain\n" for i in range(1500))
        (tmp_path / f"{name}.csv").write_bytes(f"n,t\n{rows}1500,é\n".encode(encoding))  # beyond any head
        assert files.read_csv_text(spark, f"{tmp_path}/{name}.csv").where("n = 1500").first()["t"] == "é"
    (tmp_path / "c.csv").write_text("n,t\n1,�é\n", encoding="utf-8")
    assert files.read_csv_text(spark, f"{tmp_path}/c.csv").first()["t"] == "�é"


def test_page_titles(spark, tmp_path):
    pages = ["<title>a &amp; b</title>", "<title> cut &amp</title>", "<title>&quot;q&quot; &#38; &lt;</title>", "no title", "", "<title>x<b>y</title>", "<title>\n z </title>", "<title>1</title><title>2</title>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def title(page):
        found = re.search("<title>([^<]*)</title>", page)
        return found[1].replace("&amp;", "&").strip(" ") if found else ""

    got = {(r["page_id"], r["position"], r["title"]) for r in catalogue.page_titles(spark, str(tmp_path)).collect()}
    assert got == {(i, 0, None if p is None else title(p)) for i, p in enumerate(pages)}
