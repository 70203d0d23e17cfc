"""Licence texts with hard line breaks."""

import textwrap

from chartmill.llm import license_scan

BSD2 = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL = textwrap.fill(license_scan.CLAUSES["GPL-3.0"], 60)


def test_licences_across_line_ends(spark):
    rows = [
        ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("MIT", MIT), ("ISC", ISC), ("GPL-3.0", GPL), ("Apache-2.0", "Licensed under the Apache License,\nVersion 2.0\n"),
        ("BSD-2-Clause", BSD2.replace("\n", "\r\n")), ("ISC", "".join(f" * {x}\n" for x in ISC.splitlines())), ("MIT", textwrap.fill(MIT, 30)),
        ("", "Licensed under the Apache License,\n\n--\nVersion 2.0\n"), ("", "The driver renewed her\nlicense last week. She studied at MIT\nfor four years."),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, (want, text) in enumerate(rows):
        assert want in got[i]["licences"].split(","), (i, got[i])
        assert got[i]["n_passages"] == sum(any(c.isalnum() for c in x) for x in text.split("\n"))
        assert (got[i]["n_licence_passages"] > 0) == bool(want)
    assert got[6]["licences"] == got[0]["licences"] and got[0]["n_licence_passages"] == 1


def test_anchors_miss_no_template():
    anchors = set(license_scan._anchors())
    for note in [n for ns in license_scan.NAMES.values() for n in ns] + list(license_scan.CLAUSES.values()):
        parts = license_scan._parts_of(note)
        assert sum(not anchors & set(p.split()) for p in parts) < license_scan.COVER * len(parts)
