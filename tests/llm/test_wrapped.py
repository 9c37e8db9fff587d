"""Notices whose lines are wrapped."""

import pytest

from meterlake.llm import license_scan

BSD = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
MPL = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy"
FILL = " ".join(f"f{i}" for i in range(31))


@pytest.mark.parametrize("before", [0, 5, 17, 18, 29, 31])
def test_wrapped_notices(spark, before):
    lead = " ".join(FILL.split()[:before]) + "\n"
    texts = {BSD: "bsd-3-clause", MPL: "mpl-2", BSD.replace(" ", "\n"): "bsd-3-clause", MPL.replace(" ", "\r\n\r\n"): "mpl-2", FILL: ""}
    df = spark.createDataFrame([(i, f"{lead}{x}\n{FILL}") for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["base_labels"], r["score"] >= 0.8) for r in license_scan.scan(df).collect()}
    assert got == {i: (v, "", v != "") for i, v in enumerate(texts.values())}
