"""License notices in texts, with DataFrame operations only.

A template of n words is sought in windows of 2n words that start every n words, so every occurrence lies in a window.
MinHash bands of one row over the windows' shingles retrieve templates of that length; their number is set so that a
window holding enough of a template misses it with a probability of one in a million at most. Exact containment of the
template's shingles in the window verifies. Windows that share no shingle with any template have similarity 0 to all,
so they are removed before they are hashed.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import once

#: Short notices of common licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "All rights reserved"),
]
#: Licenses whose wording is close to one of these, titles and grants of license texts, and whole short texts.
GRANT = "{0} under the terms of the GNU {1}General Public License as published by {2}"
LATER = "the Free Software Foundation, either version {} of the License, or (at your option) any later version"
TEXTS = [
    *[(f"{a}-{v}.0", f"This work is licensed under the GNU {b}General Public License, version {v}") for a, b, v in (("GPL", "", 2), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))],
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    *[(f"CC-{a}-4.0", f"This work is licensed under a Creative Commons Attribution-{b} 4.0 International License") for a, b in (
        ("BY-NC", "NonCommercial"), ("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives"))],
    *[(f"CC-{a}-4.0", f"Licensed under CC {a} 4.0") for a in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    *[(f"{a}-3.0", GRANT.format("redistribute it and/or modify it", b, LATER.format(3))) for a, b in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero "))],
    ("GPL-2.0", GRANT.format("redistribute it and/or modify it", "", LATER.format(2).replace("either", "; either"))),
    ("LGPL-2.1", GRANT.format("redistribute it and/or modify it", "Lesser ", LATER.format("2.1").replace("either", "; either"))),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
]
WIDTH = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII digits and letters and of characters beyond ASCII."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def shingles(value: Column) -> Column:
    """A hash of each run of three words, in order; none for fewer words."""
    last = F.size(value) - WIDTH
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(value, i + k) for k in range(WIDTH)]))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def bands(value: Column, count: int) -> Column:
    """One MinHash a band, the band's number hashed in."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda j: F.xxhash64(j, F.array_min(F.transform(value, lambda s: F.xxhash64(s, j)))),
    )


def band_count(lengths: list[int], tenths: int, miss: float = 1e-6) -> int:
    """Bands that retrieve a template of each length with probability 1 - ``miss`` from a window that holds enough of it."""
    most = 1
    for n in lengths:
        m = n - WIDTH + 1
        held = -(-tenths * m // 10)
        similarity = held / (2 * n - WIDTH + 1 + m - held)
        most = max(most, math.ceil(math.log(miss) / math.log(1 - similarity)))
    return most


def license_notices(docs: DataFrame, notices: list[tuple[str, str]] | None = None, tenths: int = 8, whole: int = 60) -> DataFrame:
    """Notices found in ``docs`` (doc_id, text): doc_id, license_id, first_word, n_windows, containment.

    A notice is found where a window holds at least ``tenths`` tenths of its distinct shingles of three words. If it has
    fewer than ``whole`` words, that window or one beside it has to hold all of them: licenses differ in one word. There is
    a row per document and notice: the first word of its first window, how many windows hold it, and the largest share
    held. Null texts, texts of fewer than three words and an empty table give no rows; rows that repeat a doc_id count
    as one document; other columns are not read. Notices of fewer than three words are refused.
    """
    spark = docs.sparkSession
    notices = NOTICES + TEXTS if notices is None else notices
    lengths = sorted({len([w for w in re.split(GAP, text.lower()) if w]) for _, text in notices})
    if not lengths or lengths[0] < WIDTH:
        raise ValueError(f"a notice needs at least {WIDTH} words")
    count = band_count(lengths, tenths)
    listed = F.posexplode(F.array(*[F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("text")) for a, b in notices]))
    # the notices are given as literals, so everything made of them may be broadcast
    templates = spark.range(1).select(listed.alias("template", "t")).select("template", "t.license_id", once(words(F.col("t.text"))).alias("w"))
    templates = templates.select("template", "license_id", F.size("w").alias("n"), once(F.array_distinct(shingles(F.col("w")))).alias("wanted"))
    known = templates.select(F.flatten(F.collect_set("wanted")).alias("known"))
    cells = templates.select("template", "license_id", "n", "wanted", F.explode(bands(F.col("wanted"), count)).alias("band"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), once(words(F.col("text").cast("string"))).alias("w"))
    rows = rows.select("doc_id", once(shingles(F.col("w"))).alias("s"))
    rows = rows.join(F.broadcast(known)).filter(F.arrays_overlap("s", "known"))

    def starts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(n)), lambda i: F.struct(F.lit(n).alias("n"), i.alias("first")))

    windows = rows.select("doc_id", "s", "known", F.explode(F.concat(*map(starts, lengths))).alias("at"))
    held = F.expr(f"slice(s, at.first + 1, 2 * at.n - {WIDTH - 1})")
    windows = windows.select("doc_id", "known", "at.n", "at.first", once(held).alias("held"))
    windows = windows.filter(F.arrays_overlap("held", "known")).drop("known")
    hashed = windows.select("doc_id", "n", "first", "held", F.explode(bands(F.col("held"), count)).alias("band"))
    pairs = hashed.join(F.broadcast(cells), ["n", "band"])
    common = F.size(F.array_intersect("wanted", "held"))
    found = pairs.withColumn("common", common).filter(F.col("common") * 10 >= F.size("wanted") * tenths)
    found = found.groupBy("doc_id", "license_id", "template", "n", "first").agg(F.max(F.col("common") / F.size("wanted")).alias("containment"))
    # the windows beside one that holds a notice hold parts of the same
    beside = Window.partitionBy("doc_id", "template").orderBy("first")
    near = [F.when(F.abs(f("first").over(beside) - F.col("first")) == F.col("n"), f("containment").over(beside)) for f in (F.lag, F.lead)]
    found = found.withColumn("most", F.greatest("containment", *near)).filter((F.col("most") == 1) | (F.col("n") >= whole))
    return found.groupBy("doc_id", "license_id").agg(
        F.min("first").cast("long").alias("first_word"), F.count("*").alias("n_windows"), F.max("containment").alias("containment")
    )


def twin_sql(notices: list[tuple[str, str]] = NOTICES, tenths: int = 8) -> str:
    """The short notices by plain comparison of every window with every template, at ``tenths`` tenths for all."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in notices)
    split = rf"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"""
with t as (select license_id, {split.format("text")} as w from (values {values}) v(license_id, text)),
n as (select license_id, len(w) as n, list_distinct({runs}) as wanted from t),
d as (select doc_id, {runs} as s from (select doc_id, {split.format("text")} as w from documents where text is not null) where len(w) >= 3),
l as (select distinct n from n),
o as (select doc_id, n, s, unnest(range(0, len(s), n)) as first from d, l),
h as (select doc_id, n, first, s[first + 1 : first + 2 * n - 2] as held from o),
c as (select doc_id, license_id, first, len(list_intersect(wanted, held)) as common, len(wanted) as m from h join n using (n))
select doc_id, license_id, min(first) as first_word, count(*) as n_windows, max(common / m) as containment
from c where common * 10 >= m * {tenths} group by doc_id, license_id
"""
