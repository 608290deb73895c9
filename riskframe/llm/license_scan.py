"""License scan by diagonal voting.

Every rolling word 3-gram of every text is joined on its hash with the word
positions of the phrase and notice templates (a fixed table, broadcast). A hit
votes for the diagonal ``word position - template position``. Votes are summed
per (document, template, diagonal); neighbouring diagonals are merged, which
bridges inserted or missing words; and merged spans are verified against the
template's length, coverage and deciding words. 3-gram words are compared themselves in the
join, so a hash collision cannot vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower, clean_text

GRAM = 3
# Base phrases and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Notices of well-known licences, lower case, words only. Words joined
# by "_" decide between licences: they must stand side by side in the text.
NOTICES = (
    ("agpl", "gnu_affero_general public license"),
    ("apache-2", "licensed under the apache_license version_2_0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons_attribution_4_0 international license"),
    ("cc-by", "licensed under a creative commons_attribution_3_0 unported license"),
    ("cc-by", "licensed under cc_by_4_0"),
    ("cc-by-nc", "licensed under a creative commons_attribution_noncommercial_4_0 international license"),
    ("cc-by-nc", "licensed under a creative commons_attribution_noncommercial_3_0 unported license"),
    ("cc-by-nc", "licensed under cc_by_nc_4_0"),
    ("cc-by-nc-nd", "creative commons_attribution_noncommercial_noderivatives license"),
    ("cc-by-nc-nd", "creative commons_attribution_noncommercial_noderivs license"),
    ("cc-by-nc-nd", "licensed under cc_by_nc_nd_4_0"),
    ("cc-by-nc-sa", "creative commons_attribution_noncommercial_sharealike license"),
    ("cc-by-nc-sa", "licensed under cc_by_nc_sa_4_0"),
    ("cc-by-nd", "creative commons_attribution_noderivatives license"),
    ("cc-by-nd", "creative commons_attribution_noderivs license"),
    ("cc-by-nd", "licensed under cc_by_nd_4_0"),
    ("cc-by-sa", "creative commons_attribution_sharealike license"),
    ("cc-by-sa", "licensed under cc_by_sa_4_0"),
    ("gpl-2", "under the terms of the gnu_general_public license version_2"),
    ("gpl-2", "licensed under the gnu_general_public license version_2"),
    ("gpl-2", "under the terms of version_2 of the gnu_general_public license"),
    ("gpl-2", "under the terms of the gnu_general_public license as published by the free software foundation either version_2 of the license"),
    ("gpl-3", "under the terms of the gnu_general_public license version_3"),
    ("gpl-3", "licensed under the gnu_general_public license version_3"),
    ("gpl-3", "under the terms of version_3 of the gnu_general_public license"),
    ("gpl-3", "under the terms of the gnu_general_public license as published by the free software foundation either version_3 of the license"),
    ("lgpl", "gnu_lesser_general public license"),
    ("mit", "released under the_mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla_public license v_2_0"),
    ("reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache_license_2_0"),
    ("gpl-2", "gnu_general_public license_v2_0"),
    ("gpl-3", "gnu_general_public license_v3_0"),
    ("mpl-2", "mozilla_public license version_2_0"),
    ("epl-2", "eclipse_public license version_2_0"),
    ("epl-2", "eclipse_public license v_2_0"),
    ("epl-2", "eclipse_public license_2_0"),
    ("mit", "the_mit license mit"),
    ("cc0", "cc0_1_0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
# Identifiers of the software package data exchange format, as words, with their labels.
SPDX = (
    ("agpl", "agpl_3_0"), ("apache-2", "apache_2_0"), ("bsd", "bsd_2_clause"), ("bsd", "bsd_3_clause"), ("cc-by", "cc_by_3_0"), ("cc-by", "cc_by_4_0"),
    ("cc-by-nc", "cc_by_nc_3_0"), ("cc-by-nc", "cc_by_nc_4_0"), ("cc-by-nc-nd", "cc_by_nc_nd_4_0"), ("cc-by-nc-sa", "cc_by_nc_sa_4_0"), ("cc-by-nd", "cc_by_nd_4_0"),
    ("cc-by-sa", "cc_by_sa_4_0"), ("cc0", "cc0_1_0"), ("epl-2", "epl_2_0"), ("gpl-2", "gpl_2_0"), ("gpl-3", "gpl_3_0"), ("isc", "isc"), ("lgpl", "lgpl_2_1"),
    ("lgpl", "lgpl_3_0"), ("mit", "mit"), ("mpl-2", "mpl_2_0"), ("unlicense", "unlicense"),
)
# Whole licence texts, lower case, words only, without the copyright line.
BODIES = (
    ("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
        holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or
        in connection with the software or the use or other dealings in the software"""),
    ("bsd", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by the copyright holders and
        contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct
        indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage"""),
    ("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
        all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
        author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
        or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software"""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
TEMPLATES = BASE_PHRASES + NOTICES + tuple((label, "spdx license identifier_" + name) for label, name in SPDX) + BODIES
WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_grams(spark) -> DataFrame:
    """``tid, exact, label, t_grams, need, tpos, bits, a, b, c, th``: a row per template 3-gram.

    ``need`` has a bit for each two neighbouring words of the template that decide
    between licences, ``bits`` those that the 3-gram holds both words of.
    """
    rows = []
    for tid, (label, phrase) in enumerate(TEMPLATES):
        w = phrase.replace("_", " ").split()
        pairs = deciding(phrase)
        for p in range(len(w) - GRAM + 1):
            bits = sum(1 << i for i, k in enumerate(pairs) if p <= k and k + 1 < p + GRAM)
            rows.append((tid, tid < len(BASE_PHRASES), label, len(w) - GRAM + 1, (1 << len(pairs)) - 1, p, bits, *w[p : p + GRAM]))
    t = spark.createDataFrame(rows, "tid int, exact boolean, label string, t_grams int, need long, tpos int, bits long, a string, b string, c string")
    return t.withColumn("th", F.xxhash64("a", "b", "c"))


def deciding(phrase: str) -> list[int]:
    """The place of the first of each two words joined by "_", at most 63 of them."""
    out, q = [], 0
    for block in phrase.split():
        n = block.count("_")
        out.extend(range(q, q + n))
        q += n + 1
    if len(out) > 63:
        raise ValueError(f"too many deciding words in {phrase!r}")
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", merge_gap: int = 2, coverage: float = 0.6) -> DataFrame:
    """One row per input row: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts places where a base phrase's words stand consecutively;
    ``labels`` adds the notices found by voting: a merged span counts when it
    holds at least ``coverage`` of the template's 3-grams within the template's
    length plus ``merge_gap`` words per merge, and among them one over each two
    neighbouring words that decide between licences (a version, "noncommercial"), so
    that no other word stands there or between them. ``score`` is the best coverage (1 for
    a base phrase, 0 for none). Null and empty texts have no words. Repeated
    rows and null ids are scanned one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    words = F.array_remove(F.split(ascii_lower(clean_text(text_col)), WORD_BREAK), "")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), words.alias("words"))
    at = rows.select("id", "rid", "words", F.posexplode_outer("words").alias("pos", "word"))
    w1, w2 = F.get("words", F.col("pos") + 1), F.get("words", F.col("pos") + 2)
    grams = at.select("id", "rid", F.size("words").alias("n_words"), "pos", "word", w1.alias("w1"), w2.alias("w2"), F.xxhash64("word", w1, w2).alias("h"))
    same = (F.col("h") == F.col("th")) & (F.col("word") == F.col("a")) & (F.col("w1") == F.col("b")) & (F.col("w2") == F.col("c"))
    votes = grams.join(F.broadcast(template_grams(spark)), same, "left").where(  # a fixed table
        F.col("tid").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True))  # a row for each document at least
    )
    diagonals = votes.groupBy("rid", "id", "n_words", "tid", "exact", "label", "t_grams", "need", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.bit_or("bits").alias("seen")
    )
    along = Window.partitionBy("rid", "tid").orderBy("diag")
    # A new span begins where a diagonal is no neighbour of the one before, or lies elsewhere in the text.
    step = (
        F.col("exact")
        | F.coalesce(F.col("diag") - F.lag("diag").over(along) > merge_gap, F.lit(True))
        | (F.abs(F.col("lo") - F.lag("lo").over(along)) > F.col("t_grams") + merge_gap)
    )
    spans = (
        diagonals.withColumn("starts", step.cast("int"))
        .withColumn("span", F.sum("starts").over(along))
        .groupBy("rid", "id", "n_words", "tid", "exact", "label", "t_grams", "need", "span")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diag").alias("d0"), F.max("diag").alias("d1"), F.bit_or("seen").alias("seen"))
    )
    share = F.least(F.col("votes") / F.col("t_grams"), F.lit(1.0))
    fits = (F.col("hi") - F.col("lo") + 1) <= F.col("t_grams") + F.abs(F.col("d1") - F.col("d0"))
    decided = F.col("seen") == F.col("need")
    found = F.when(F.col("exact"), F.col("votes") == F.col("t_grams")).otherwise((share >= coverage) & fits & decided)
    base = F.col("exact") & found
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("rid")
        .agg(
            F.first("id").alias(id_col),
            F.first("n_words").cast("long").alias("n_words"),
            F.count(F.when(base, F.lit(1))).alias("n_base"),
            F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(found).alias("labels"),
            F.round(F.coalesce(F.max(F.when(found, share)), F.lit(0.0)), 6).alias("score"),
        )
        .select(id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
