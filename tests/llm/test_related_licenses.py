"""Related licenses are told apart."""

from blockloom.llm import licenses

from .fixtures import documents

BY = "This work is licensed under a Creative Commons Attribution 4.0 International License."


def test_related_licenses(spark):
    rows = [
        (1, "Licensed under CC BY 4.0"), (2, BY), (3, BY.replace("Attribution", "Attribution-ShareAlike")), (4, "Licensed under CC BY-NC 4.0"),
        (5, BY.replace("Attribution", "Attribution-NonCommercial")), (6, "Licensed under the Mozilla Public License, version 2.0"),
        (7, "Licensed under the Apache License, Version 2.0"),
    ]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert got[1] == {"cc-by"} and got[2] == {"cc-by-notice"} and "cc-by-sa" in got[3] and got[4] == {"cc-by", "cc-by-nc"}
    assert "cc-by-sa" not in got[5] and got[6] == set() and got[7] == {"apache-2.0"}
