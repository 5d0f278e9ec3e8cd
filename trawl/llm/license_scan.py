"""License scans by diagonal voting.

Every rolling k-gram of a document's words is hashed and joined with the k-grams of license templates. A match at
document position p and template position t votes for the diagonal p - t. Each diagonal is merged with those at most
NEAR words away (words may be missing or added inside a span, whose length is bounded by that), and what is merged
is verified by the share of the template's k-grams that stand in it word for word, each template position counted
once. Short phrases (k = 2) count only when every k-gram of the phrase votes for one diagonal, which is a place where
its words stand consecutively.

The templates are a table (label, text) of any size; without one, the notices below are taken. Spark cuts it into k-grams,
whose rows are broadcast: up to MOST_GRAMS of them at once (counted; some thousand whole licenses), more in blocks, each of
which is one reading of the documents. A document's words are never dealt out to meet a template. A document adds one row of its own
(an empty word behind its last one) to the first pass, which carries its word count. A k-gram that stands in many templates
votes for each of them, so votes grow with the templates that share a document's wording.

Defined cases: a null or empty text has no words, no labels and score 0. Rows with equal or null doc_id are separate
documents. A template of null or fewer than three words has no k-grams and is never found; one without a label is labelled
`unknown`; repeated templates count once each. An empty table gives no rows, empty templates leave the phrases. Columns other than
doc_id and text, or label and text, are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import staged
from ._words import SQL_WORDS, word_array

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of license notices, then whole notices, and their labels.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
]

#: Length of a notice's k-grams; words by which merged diagonals may differ; least share of a notice that must be there.
NOTICE_K, NEAR, LEAST_SHARE = 3, 6, 0.6
#: Rows of templates' k-grams that are broadcast at once (some 100 bytes each).
MOST_GRAMS = 1_000_000


def _own_texts(spark: SparkSession, with_notices: bool) -> DataFrame:
    """label, text, k: the phrases, and the notices above."""
    texts = [(label, phrase, 2) for phrase, label in PHRASES.items()] + [(label, text, NOTICE_K) for label, text in NOTICES if with_notices]
    rows = json.dumps([{"label": label, "text": text, "k": k} for label, text, k in texts])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<label:string,text:string,k:int>>")))


def template_grams(spark: SparkSession, templates: DataFrame | None = None) -> DataFrame:
    """A row for each k-gram of each phrase and template: template, tpos, gram (a hash of its words), w1, w2, w3, k, total, label."""
    texts = _own_texts(spark, templates is None)
    if templates is not None:
        label = F.coalesce(F.col("label").cast("string"), F.lit("unknown")).alias("label")
        texts = texts.unionByName(templates.select(label, F.col("text").cast("string").alias("text"), F.lit(NOTICE_K).alias("k")))
    worded = texts.select("label", "k", word_array(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("template"))
    total = (F.size("words") - F.col("k") + 1).alias("total")
    placed = worded.filter(total > 0).select("template", "k", "label", "words", total, F.posexplode("words").alias("tpos", "w1")).filter("tpos < total")
    third = F.when(F.col("k") == NOTICE_K, F.get("words", F.col("tpos") + 2))
    rows = placed.select("template", "tpos", "w1", F.get("words", F.col("tpos") + 1).alias("w2"), third.alias("w3"), "k", "total", "label")
    # xxhash64 passes over nulls, so a phrase's hash is one of two words.
    return rows.withColumn("gram", F.xxhash64("w1", "w2", "w3"))


def _blocks(grams: DataFrame) -> list[DataFrame]:
    """The k-grams in blocks that may be broadcast, the first with the row that each document's own row meets."""
    spark = grams.sparkSession
    own = spark.range(1).select(
        *[F.lit(v).cast(t).alias(c) for c, v, t in (("template", -1, "long"), ("tpos", 0, "int"), ("w1", "", "string"), ("w2", None, "string"), ("w3", None, "string"))],
        *[F.lit(v).cast(t).alias(c) for c, v, t in (("k", 0, "int"), ("total", 1, "int"), ("label", None, "string"), ("gram", 0, "long"))],
    )
    n = -(-grams.count() // MOST_GRAMS)
    block = F.pmod(F.xxhash64("template", "tpos"), F.lit(max(n, 1)))
    return [(grams if n <= 1 else grams.filter(block == k)).unionByName(own.filter(F.lit(k == 0))) for k in range(max(n, 1))]


def votes(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, row_id, pos and the template k-gram that stands there; and each document's own row."""
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.array_append(word_array(F.col("text")), F.lit("")).alias("words"))
    placed = words.select("doc_id", "row_id", "words", F.posexplode("words").alias("pos", "w"))
    second, third = F.get("words", F.col("pos") + 1), F.get("words", F.col("pos") + 2)
    grams = placed.select("doc_id", "row_id", "pos", "w", second.alias("x2"), third.alias("x3"))
    two = F.when(F.col("w") == "", F.lit(0)).otherwise(F.xxhash64("w", "x2"))
    grams = grams.withColumn("gram", F.explode(F.array(two, F.xxhash64("w", "x2", "x3"))))
    same = (F.col("w") == F.col("w1")) & (F.col("w2").isNull() | (F.col("x2") == F.col("w2"))) & (F.col("w3").isNull() | (F.col("x3") == F.col("w3")))
    # Written, as templates must have the same numbers in each block.
    rows = staged(template_grams(docs.sparkSession, templates), "template-grams")
    met = [grams.join(F.broadcast(block), "gram").filter(same) for block in _blocks(rows)]
    return reduce(DataFrame.unionByName, met).select("doc_id", "row_id", "pos", "template", "tpos", "k", "total", "label")


def license_spans(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """A row for each document, template and diagonal: n_places (1 where a phrase stands), and share, start and end (in words)
    of what stands of a notice on this diagonal and those near it."""
    found = votes(docs, templates).repartition("row_id")
    keys = ["doc_id", "row_id", "template", "k", "total", "label"]
    lines = found.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*keys, "diagonal")
    lines = lines.agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("start"), (F.max("pos") + F.first("k")).alias("end"))
    near = Window.partitionBy("row_id", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    held = F.size(F.array_distinct(F.flatten(F.collect_list("at").over(near))))
    spans = lines.select(
        *keys,
        "diagonal",
        ((F.col("k") == 2) & (F.size("at") == F.col("total"))).cast("int").alias("n_places"),
        (held / F.col("total")).alias("held"),
        F.min("start").over(near).alias("start"),
        F.max("end").over(near).alias("end"),
    )
    real = (F.col("k") == NOTICE_K) & (F.col("held") >= LEAST_SHARE)
    return spans.withColumn("share", F.when(F.col("n_places") > 0, 1.0).when(real, F.col("held")).otherwise(0.0)).drop("held")


def license_labels(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per document, with the columns of the query below; templates: a table (label, text) in place of the notices."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    place = F.when(F.col("n_places") > 0, F.col("diagonal"))
    out = license_spans(docs, templates).groupBy("row_id", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("start"))).cast("long").alias("n_words"),
        F.sum("n_places").alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        joined(F.when(F.col("n_places") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("share") > 0, F.col("label"))).alias("labels"),
        F.max(F.when(F.col("template") >= 0, F.col("share")).otherwise(0.0)).alias("score"),
    )
    return out.drop("row_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    texts = [(phrase, 2, label) for phrase, label in PHRASES.items()] + [(text, NOTICE_K, label) for label, text in NOTICES]
    rows = ", ".join(f"({n}, '{text}', {k}, '{label}')" for n, (text, k, label) in enumerate(texts))
    return f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
t(template, text, k, label) AS (VALUES {rows}),
t2 AS (SELECT template, string_split(text, ' ') AS ws, k, label FROM t),
g AS (SELECT template, tpos, ws[tpos + 1] AS w1, ws[tpos + 2] AS w2, CASE WHEN k = 3 THEN ws[tpos + 3] END AS w3, k, len(ws) - k + 1 AS total, label
  FROM (SELECT *, unnest(range(len(ws) - k + 1)) AS tpos FROM t2)),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
x AS (SELECT doc_id, pos, w AS w1, lead(w) OVER q AS w2, lead(w, 2) OVER q AS w3 FROM p WINDOW q AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT doc_id, template, k, total, label, tpos, pos - tpos AS diagonal FROM x JOIN g ON x.w1 = g.w1 AND x.w2 = g.w2 AND (g.w3 IS NULL OR x.w3 = g.w3)),
a AS (SELECT doc_id, template, k, total, label, diagonal, count(*) AS votes FROM v GROUP BY ALL),
h AS (SELECT a.*, (SELECT count(DISTINCT tpos) FROM v WHERE v.doc_id = a.doc_id AND v.template = a.template AND abs(v.diagonal - a.diagonal) <= {NEAR}) AS held FROM a),
r AS (SELECT *, k = 2 AND votes = total AS place, CASE WHEN k = 2 AND votes = total THEN 1.0
  WHEN k = {NOTICE_K} AND CAST(held AS DOUBLE) / total >= {LEAST_SHARE} THEN CAST(held AS DOUBLE) / total ELSE 0.0 END AS share FROM h)
SELECT d.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (place) AS n_base,
  CAST(min(diagonal) FILTER (place) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (place) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share > 0), '') AS labels, CAST(coalesce(max(share), 0) AS DOUBLE) AS score
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""


OP3_SQL = _sql()
