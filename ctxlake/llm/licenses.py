"""License scans by sparse TF-IDF cosine, then inheritance from the nearest directory; DataFrame operations only.

Passages are the lines of a text that carry a license cue, and the whole text of licence files (by base name). Passages
and license templates become sparse vectors of words, weighted by frequencies over all passages of the corpus and the
templates, and a passage takes the template with the greatest cosine if it is at least ``least``. A file takes its best
passage; one without any inherits from the licence file in the nearest directory above it. For that, distinct
directories, not files, are spread over their ancestors and joined with the licensed directories by path. A passage that
only reserves all rights, as those above a BSD license do, counts where no other passage names a license.

Null texts have no passages. A null path has no directory and inherits nothing. Repeated rows are judged each; ties go to
the greater score, then the smaller license name. Where a directory has several licence files, the best score counts.
Other columns aren't read. An empty table gives an empty result. Words, notices and folders that very many rows share are
joined by broadcast, where that is counted and small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.columns import literal
from ctxlake.llm.common import join_hot, small_side, staged

#: Every template has a cue; lines without one are never scored.
CUE = r"(?i)licen[cs]|copyright|spdx-|permission is hereby|redistribut|warrant(?:y|ies)\b|all\s+rights\s+reserved|public\s+domain|\bcc0\b|\bcc[ -]by\b|creative\s+commons|proprietary"
FILE_NAME, LEAST = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$", 0.35
#: (license, text): short notices and the openings of the licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Proprietary and confidential."),
]
#: In passages of proprietary licenses that do more than reserve all rights.
CLOSED = "(?i)proprietary|confidential"
#: Words, with version numbers kept whole.
WORD = "[a-z0-9]+(?:\\.[0-9]+)*"


def _terms(passages: DataFrame) -> DataFrame:
    """(passage, token, tf) of rows (passage, body)."""
    words = passages.select("passage", F.explode(F.expr(f"regexp_extract_all(lower(body), {literal(WORD)}, 0)")).alias("token"))
    return words.groupBy("passage", "token").agg(F.count("*").alias("tf"))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, license, score, origin (header, file, inherited or
    none) and licensed_by, the path of the licence file inherited from."""
    spark = files.sparkSession
    rows = files.selectExpr("cast(doc_id as long) doc_id", "cast(path as string) path", "cast(text as string) text")
    name = "element_at(split(path, '/'), -1)"
    rows = rows.withColumn("is_file", F.expr(f"coalesce({name} rlike {literal(FILE_NAME)}, false)")).withColumn("dir", F.expr("if(path is null, null, if(instr(path, '/') = 0, '', substr(path, 1, length(path) - length(element_at(split(path, '/'), -1)) - 1)))"))
    lines = f"if(text rlike {literal(CUE)}, array_distinct(filter(split(text, '\\n'), l -> l rlike {literal(CUE)})), cast(array() as array<string>))"
    found = f"if(is_file and text is not null, array_distinct(concat({lines}, array(text))), {lines})"
    kept = staged(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "dir", "is_file", F.expr(f"coalesce({found}, cast(array() as array<string>))").alias("passages")), "passages")

    # Equal passages are scored once, however many files have them.
    each = kept.select("row", F.explode("passages").alias("body")).withColumn("passage", F.sha2("body", 256))
    counts = each.groupBy("passage").agg(F.count("*").alias("n"), F.any_value("body").alias("body"))
    templates = spark.createDataFrame([(f"template {i}", lic, body) for i, (lic, body) in enumerate(TEMPLATES)], "passage string, license string, body string")
    everything = counts.select("passage", "n", "body").unionByName(templates.selectExpr("passage", "1L n", "body"))
    terms = staged(_terms(everything).join(everything.select("passage", "n"), "passage"), "terms")
    total = everything.agg(F.sum("n").alias("total"))
    df = terms.groupBy("token").agg(F.sum("n").alias("df"), F.count("*").alias("rows"))
    idf = staged(df.crossJoin(F.broadcast(total)).select("token", "rows", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    weighed = staged(join_hot(terms, idf, "token", "rows").select("passage", "token", (F.col("tf") * F.col("idf")).alias("w")), "weighed")
    norms = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # The templates' vectors are as many as the constant list above has words, so they may be broadcast.
    known = F.broadcast(weighed.join(templates.select("passage", "license"), "passage").join(norms, "passage").select(F.col("passage").alias("template"), "license", "token", (F.col("w") / F.col("norm")).alias("u")))
    dots = weighed.where(~F.startswith("passage", F.lit("template "))).join(known, "token").groupBy("passage", "template", "license").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scored = dots.join(norms, "passage").select("passage", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license"))
    licensed = scored.groupBy("passage").agg(best.alias("b")).select("passage", "b.license", (-F.col("b.minus")).alias("score"))
    # False sorts before true, so that what only reserves rights comes last.
    reserved = (F.col("license") == "Proprietary") & ~F.col("body").rlike(CLOSED)
    first = F.min(F.struct(reserved.alias("reserved"), (-F.col("score")).alias("minus"), "license"))
    # A notice that very many files share meets its license by broadcast.
    known_passages = staged(licensed.join(counts.select("passage", "n"), "passage"), "known")
    own = join_hot(each, known_passages, "passage", "n").groupBy("row").agg(first.alias("b")).select("row", F.col("b.license").alias("own"), (-F.col("b.minus")).alias("own_score"), F.col("b.reserved").alias("reserved"))
    judged = staged(kept.drop("passages").join(own, "row", "left"), "licensed")

    from_files = judged.where("is_file and own is not null").groupBy("dir").agg(F.min(F.struct("reserved", (-F.col("own_score")).alias("minus"), "own", "path")).alias("b"))
    above = from_files.select(F.col("dir").alias("ancestor"), F.col("b.own").alias("license"), (-F.col("b.minus")).alias("score"), F.col("b.path").alias("licensed_by"))
    dirs = judged.where("own is null and dir is not null").select("dir").distinct()
    spread = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")).alias("ancestor"))
    nearest = spread.join(above, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "license", "score", "licensed_by")).alias("b")).select("dir", "b.license", "b.score", "b.licensed_by")
    out = judged.join(small_side(staged(nearest, "nearest")), "dir", "left")
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "license").alias("license"), F.coalesce("own_score", "score").alias("score"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("licensed_by")).alias("licensed_by"))
