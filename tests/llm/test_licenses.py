"""Licence sentences as the public licences have them, and SPDX lines: what is recognised is stated by hand, not taken from the rules."""

import glob
import os

import duckdb
import pytest

from pagelens.llm import op7_licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be
included in all copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of merchantability.

You should have received a copy of the GNU General Public License along with this program."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{end}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
CASES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0\n#include <isc.h>": "Apache-2.0",
    "# spdx-license-identifier: (MIT OR Apache-2.0)\nimport os": "Apache-2.0,MIT",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL-2.0-or-later",
    "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0",
    "/* SPDX-License-Identifier: BSD-3-Clause */": "BSD-3-Clause",
    "SPDX-License-Identifier: CC0-1.0.": "CC0-1.0",
    "SPDX-License-Identifier: LicenseRef-Own": "UnknownLicence",
    MIT: "MIT",
    BSD.format(more=""): "BSD-2-Clause",
    BSD.format(more="3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products."): "BSD-3-Clause",
    BSD.format(more="3. All advertising materials mentioning features or use of this software must display the following acknowledgement."): "BSD-4-Clause",
    GPL: "GPL-or-later",
    GPL.replace("GNU General", "GNU Lesser General").replace("program", "library"): "LGPL",
    GPL.replace("GNU General", "GNU Affero General"): "AGPL",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n http://e.org": "Apache-2.0",
    "This product includes software developed by the Apache Software Foundation.": "Apache-1.1",
    ISC.format(end=", provided that the above copyright notice and this permission notice appear in all copies."): "ISC",
    ISC.format(end="."): "0BSD",
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it.": "Zlib",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "BSL-1.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted": "PostgreSQL",
    "Subject to the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "Subject to the Mozilla Public License Version 1.1": "MPL-1.1",
    "made available under the terms of the Eclipse Public License 2.0": "EPL",
    "the Common Development and Distribution License applies": "CDDL",
    "under the same terms as Perl or the Artistic License": "Artistic",
    "Licensed under the European Union Public Licence": "EUPL",
    "Microsoft Public License (Ms-PL)": "MS-PL",
    "University of Illinois/NCSA Open Source License": "NCSA",
    "Python Software Foundation License Version 2": "PSF",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0": "CC-BY-NC-ND",
    "Creative Commons Attribution-NoDerivs 3.0": "CC-BY-ND",
    "Creative Commons Attribution 4.0 International": "CC-BY",
    "To the extent possible this is dedicated to the public domain.": "CC0",
    "The licence fee: paid. Open permission slips are provided": "",
    "": "",
}


def test_licences_as_they_are_written(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)) + [(None, None)], "doc_id long, text string")
    rows = op7_licenses.scan_licenses(docs.withColumnRenamed("doc_id", "licenses")).collect()
    got = {r.text: r.licenses for r in rows if r.text is not None}
    assert {k[:60]: v for k, v in got.items() if v != CASES[k]} == {}
    assert [r.licenses for r in rows if r.text is None] == [""]


def test_long_texts_are_scanned_whole(spark):
    text = "plain words go on. " * 40_000 + MIT
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[:-400])], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in op7_licenses.scan_licenses(docs).collect()} == {1: "MIT", 2: "MIT", 3: ""}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_are_as_the_sql(spark, sf):
    c = duckdb.connect()
    for f in glob.glob(f"/root/testdata/{sf}/documents.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = op7_licenses.op7_licenses(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(op7_licenses.ORACLE).project("doc_id, sentence_ids, licenses, unmatched").fetchall())
    assert any(r.licenses for r in got)
