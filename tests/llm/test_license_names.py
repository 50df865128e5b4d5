"""Which licence a notice states: versions and modifiers tell licences of one wording apart, and what is negated or unknown states none."""

import pytest

from chronoplate.llm import license_scan

GNU = "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
NOTICES = [
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("This work is licensed under the Creative Commons Attribution 3.0 License.", "CC-BY-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-NC 2.0.", None),
    ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', "MPL-1.1"),
    ("This library is free software; " + GNU.format("Library General", "2"), "LGPL-2.0-or-later"),
    ("This library is free software; " + GNU.format("Lesser General", "2.1"), "LGPL-2.1-or-later"),
    ("This program is free software; " + GNU.format("General", "2"), "GPL-2.0-or-later"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "EPL-1.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This program is licensed under the GNU General Public License, version 1.", None),
    ("This software is not licensed under the MIT License.", None),
    ("Licensed under the MIT License or the Apache License, Version 2.0, at your option.", "MIT OR Apache-2.0"),
    ("Parts fall under the MIT License and parts under the BSD 3-Clause License.", "MIT AND BSD-3-Clause"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections.", "GFDL-1.3-or-later"),
    ("Licensed under the Apache License.", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0-only"),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, (t, _) in enumerate(NOTICES)], "key INT, path STRING, text STRING")
    return {r.key: r.license for r in license_scan.scan(files).collect()}


@pytest.mark.parametrize("i", range(len(NOTICES)))
def test_a_notice_names_its_licence(found, i):
    assert found[i] == NOTICES[i][1], NOTICES[i][0]
