"""Wrappers are inferred from every structure of a host, however many there are."""

import json

from haystrata.llm import html_extract as H


def test_all_structures_of_a_host_are_in_its_wrapper(spark):
    name = lambda i: f"box{chr(97 + i // 26)}{chr(97 + i % 26)}"
    pages = [(f"http://h.example/{i}", f"<html><body><div class='{name(i)}'><p>one {i}</p></div><article><p>text {i}</p></article></body></html>") for i in range(70)]
    pages.append(("http://two.example/", "<html><body><p>x</p></body></html>"))
    found = H.structures(spark.createDataFrame(pages, "url string, html string")).where("shape is not null")
    got = {r["host"]: r["wrapper"] for r in H.wrappers(found).collect()}
    assert set(got) == {"h.example", "two.example"}
    labels = {row[2] for row in json.loads(got["h.example"])}
    assert all(any(name(i) in x for x in labels) for i in range(70))  # before: 8 of them at most
    assert sum(row[1] == "article" for row in json.loads(got["h.example"])) == 1
