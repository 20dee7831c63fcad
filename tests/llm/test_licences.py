"""Licence scans on notice files, headers and tags as they occur."""

from __future__ import annotations

import time

import pytest

from turnmill.llm import licence_scan

BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."


def licences(spark, *texts):
    rows = licence_scan.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r["licence"] for r in rows]


@pytest.mark.parametrize("copies", [2_000])
def test_many_copies_in_one_file(spark, copies):
    began = time.time()
    assert licences(spark, BSD2 * copies, NOTICE * 5_000) == ["BSD-2-Clause", None]
    assert time.time() - began < 60


def test_headers(spark):
    copy = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
    assert licences(spark, APACHE, f"{APACHE} {copy}", f"# {APACHE}\n# {copy}", f"dnl {APACHE}", "not " + APACHE[:52]) == ["Apache-2.0"] * 4 + [None]


def test_grants_behind_numbers_and_notices(spark):
    assert licences(
        spark,
        f"1) {GRANT}\n2) {NOTICE}\n3) {AS_IS}",
        f"Copyright (c) 2020 Some One {GRANT}\n{NOTICE}\n{AS_IS}",
        "\n".join("rem " + x for x in (GRANT, NOTICE, AS_IS)),
        f"{AS_IS}\n{NOTICE}\n{GRANT}",
    ) == ["MIT", "MIT", "MIT", None]


def test_tags(spark):
    tags = ["// SPDX-License-Identifier: MIT", "/* SPDX-License-Identifier: Apache-2.0 */", "# SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "SPDX-License-Identifier: Unknown", "# SPDX-License-Identifier: 0BSD", "SPDX-License-Identifier: BSD-3-Clause"]
    assert licences(spark, *tags) == ["MIT", "Apache-2.0", "GPL-2.0", None, "0BSD", "BSD-3-Clause"]
