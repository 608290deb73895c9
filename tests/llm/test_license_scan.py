import re

from riskframe.llm import license_scan
from riskframe.llm.license_scan import BASE_PHRASES, scan_licenses

SCHEMA = "doc_id long, text string, words string, label string"
TEXTS = [
    "Released under the MIT License. And again: under the\nMIT   license!",
    "Licensed under the Apache License, Version 2.0.",
    "CC BY-NC cc by nc cc by-nc",
    "no licence here",
    "",
    None,
    "under the mit",
    "This work is licensed under the (well known) GNU General Public License, version 3.",
    "x" * 5000 + " under the MIT license " + "ü " * 3000,
    "under the mit licenseé",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for label, p in BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_match_brute_force(spark):
    rows = [(k, t, "w", "l") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "w", "l"), (None, TEXTS[1], "w", "l")]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == want


def test_votes_bridge_inserted_words_and_label_notices(spark):
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(k, t, "", "") for k, t in enumerate(TEXTS)], SCHEMA)).collect()}
    assert got[7].base_labels == "" and got[7].labels == "gpl-3" and 0.6 <= got[7].score < 1
    assert got[1].labels == "apache-2" and got[1].score == 1.0
    assert got[3].labels == "" and got[3].score == 0.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.values())


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_misses_get_their_own_licence_or_none(spark):
    gpl = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or any later version"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = {
        "This file is licensed under the GNU General Public License version 2": "gpl-2",
        "This file is licensed under the GNU General Public License version 3": "gpl-3",
        "licensed under the GNU Lesser General Public License version 3": "lgpl",
        "licensed under the GNU Affero General Public License version 3": "agpl",
        "under the terms of version 2 of the GNU General Public License": "gpl-2",
        gpl.format("", 3): "gpl-3",
        gpl.format("", 2): "gpl-2",
        gpl.format("Lesser ", 3): "lgpl",
        cc.format(""): "cc-by",
        cc.format("-NonCommercial"): "cc-by-nc",
        cc.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        cc.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa",
        cc.format("-NoDerivatives"): "cc-by-nd",
        cc.format("-ShareAlike"): "cc-by-sa",
        "Licensed under CC BY-SA 4.0": "cc-by-sa",
        "Licensed under the Apache License, Version 1.1": "",
        "Licensed under the Apache License, Version 2.0": "apache-2",
        "subject to the terms of the Mozilla Public License, v. 1.1": "",
        "subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    }
    rows = [(k, t, "", "") for k, t in enumerate(texts)]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[k] for k, t in enumerate(texts)} == texts


def test_short_forms_identifiers_and_whole_texts(spark):
    body = {label: text for label, text in license_scan.BODIES if len(text) > 200}
    cut = lambda label, a, b: " ".join(w for k, w in enumerate(body[label].split()) if not a <= k < b)
    texts = {
        "Licensed under the Apache License 2.0": "apache-2",
        "Licensed under the Apache License 1.1": "",
        "// SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
        "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2",
        "# SPDX-License-Identifier: LGPL-2.1": "lgpl",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc,cc-by-nc-sa",
        "SPDX-License-Identifier: Unknown-1.0": "",
        "GNU General Public License v3.0": "gpl-3",
        "GNU Lesser General Public License v3.0": "lgpl",
        "Mozilla Public License Version 2.0": "mpl-2",
        "Mozilla Public License Version 1.1": "",
        "The MIT License (MIT)": "mit",
        "CC0 1.0 Universal": "cc0",
        "Eclipse Public License - v 2.0": "epl-2",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        # Whole texts with words put in, left out, and a stretch missing at the head: the diagonals shift and are merged again.
        body["mit"].replace("merge publish", "merge and also publish").replace("whether in an action of", "in an action of"): "mit",
        "lead " * 300 + cut("mit", 0, 30) + " tail" * 50: "mit",
        cut("bsd", 0, 20): "bsd",
        cut("isc", 0, 20): "isc",
        cut("mit", 60, 200): "mit",  # the short grant alone
    }
    rows = [(k, t, "", "") for k, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, r.base_labels) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[k][0] for k, t in enumerate(texts)} == texts
    assert all(len(p.replace("_", " ").split()) >= 3 for _, p in license_scan.TEMPLATES) and max(len(p.split()) for _, p in license_scan.TEMPLATES) > 100
