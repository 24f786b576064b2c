"""Licences and versions whose notices differ in few words."""

import pytest
from helpers import documents

from quillmere.llm import license_scan
from quillmere.llm.license_scan import _BSD_ADVERT, _BSD_END, _BSD_NAME, _BSD_START, _BSD_TWO, _MIT_END

GNU = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as"
       " published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.")
FILLER = " ".join(f"filler{i}" for i in range(200))
CASES = {
    GNU.format("program", ":", "", ",", "3"): {"GPL-3.0"},
    GNU.format("program", ";", "", ";", "2"): {"GPL-2.0"},
    GNU.format("library", ";", "Lesser ", ";", "2.1"): {"LGPL-2.1"},
    GNU.format("program", ":", "Lesser ", ",", "3"): {"LGPL-3.0"},
    GNU.format("program", ":", "Affero ", ",", "3"): {"AGPL-3.0"},
    GNU.format("program", ";", "", ";", "2") + " " + GNU.format("program", ":", "", ",", "3"): {"GPL-2.0", "GPL-3.0"},
    GNU.format("program", ":", "", ",", "9"): set(),
    "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
    _BSD_START + _BSD_TWO.format("1.", "2.") + _BSD_END: {"BSD-2-Clause"},
    _BSD_START + _BSD_TWO.format("*", "*") + "* " + _BSD_NAME + _BSD_END: {"BSD-3-Clause"},
    _BSD_START + _BSD_TWO.format("(a)", "(b)") + "(c) " + _BSD_NAME + _BSD_END: {"BSD-3-Clause"},
    _BSD_START + _BSD_TWO.format("1.", "2.") + "3. " + _BSD_ADVERT + "4. " + _BSD_NAME + _BSD_END: {"BSD-4-Clause"},
    _BSD_END: {"BSD"},
    _MIT_END.format("AUTHORS OR COPYRIGHT HOLDERS"): {"MIT"},
    _MIT_END.format("AUTHORS"): {"Unlicense"},
    license_scan._ISC + ", provided that the above copyright notice and this permission notice appear in all copies.": {"ISC"},
    license_scan._ISC + ".": {"0BSD"},
    "# SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0"},
    "// SPDX-License-Identifier: MIT": {"MIT"},
    "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0"},
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"CC-BY-4.0"},
    "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.": {"CC-BY-ND-3.0"},
    "see https://creativecommons.org/licenses/by-nc-nd/4.0/ for terms": {"CC-BY-NC-ND-4.0"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": set(),  # half of the notice
}


@pytest.mark.parametrize("around", ["", FILLER])
def test_versions(spark, around):
    texts = [f"{around} {text} {around}" for text in CASES]
    got = license_scan.scan(documents(spark, list(enumerate(texts)))).toPandas()
    found = [set(got[got["doc_id"] == i]["license_id"]) for i in range(len(texts))]
    assert dict(zip(CASES, found)) == CASES


def test_every_template_is_found(spark):
    rows = list(enumerate(text for _, text in license_scan.TEMPLATES))
    got = license_scan.scan(documents(spark, [(i, f"{FILLER} {t} {FILLER}") for i, t in rows])).toPandas()
    found = set(zip(got["doc_id"], got["license_id"]))
    short = license_scan.NOTICES[8]  # how all BSD licences begin
    assert [t for i, t in enumerate(license_scan.TEMPLATES) if (i, t[0]) not in found and t != short] == []
