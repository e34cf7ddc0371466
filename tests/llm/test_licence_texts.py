"""Standard headers as they stand in files, wrapped and in comments, and whole licence files."""

import pytest

from cratewise.llm import licences

GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os
"""
BSD3 = """/*
 * Copyright (c) 2020, The Authors
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 */
int main() { return 0; }
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
const a = 1
"""
SPDX = "// SPDX-License-Identifier: GPL-2.0-or-later\nint b;\n"
MIT = """MIT License

Copyright (c) 2021 Some Body

""" + "\n".join(t for n, t in licences.TEMPLATES if n == "MIT" and t.startswith("Permission") and len(t) > 300).replace(", ", ",\n").replace(". ", ".\n\n") + "\n"
APACHE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + "Terms of some paragraph that no template has.\n" * 40


@pytest.fixture(scope="module")
def got(spark):
    files = {
        "p/gpl.py": GPL3, "p/bsd.c": BSD3, "p/mpl.js": MPL, "p/spdx.c": SPDX, "p/plain.txt": "Only words\nof prose here.\n" * 30,
        "m/LICENSE.txt": MIT, "m/src/a.py": "x = 1", "n/terms": MIT, "n/b.py": "y = 2", "q/COPYING": APACHE, "q/deep/c.py": "z = 3",
    }
    rows = [(i, path, text) for i, (path, text) in enumerate(files.items())]
    return {r.path: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}


def test_wrapped_headers(got):
    assert {p: got[f"p/{p}"].licence for p in ("gpl.py", "bsd.c", "mpl.js", "spdx.c", "plain.txt")} == {
        "gpl.py": "GPL-3.0", "bsd.c": "BSD-3-Clause", "mpl.js": "MPL-2.0", "spdx.c": "GPL-2.0", "plain.txt": None}


def test_licence_files_of_many_lines_are_inherited(got):
    assert {p: (got[p].licence, got[p].via) for p in got if p[0] in "mnq"} == {
        "m/LICENSE.txt": ("MIT", "licence file"), "m/src/a.py": ("MIT", "inherited"), "n/terms": ("MIT", "licence file"), "n/b.py": ("MIT", "inherited"),
        "q/COPYING": ("Apache-2.0", "licence file"), "q/deep/c.py": ("Apache-2.0", "inherited")}
