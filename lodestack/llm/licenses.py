"""Licence scans by diagonal voting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import grams
from lodestack.llm.shared import saved

K = 3

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wordings of public licences and notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
]

#: Diagonals at most so far apart join: so many words may be put in or left out in between.
SLACK = 2
#: Part of a template's grams that a merged span must show.
COVERAGE = 0.6


def known_texts(spark: SparkSession, templates: DataFrame | list | None = None, phrases: dict | None = None) -> DataFrame:
    """(tid, label, text, base) of templates (label, text; a table of any size) and phrases."""
    phrases = PHRASES if phrases is None else phrases
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(TEMPLATES if templates is None else templates, "label string, text string")
    rows = templates.select("label", "text", F.lit(False).alias("base"))
    if phrases:
        rows = spark.createDataFrame([(label, said, True) for said, label in phrases.items()], "label string, text string, base boolean").union(rows)
    return rows.where("label is not null and text is not null").distinct().withColumn("tid", F.xxhash64("label", "text", "base"))


def spans(docs: DataFrame, templates: DataFrame | list | None = None, phrases: dict | None = None, keys=("doc_id",), text: str = "text") -> DataFrame:
    """One row per merged span: keys, n_words, label, base, start, end, coverage; or a row with a null label.

    Grams vote for the diagonal (place in the document less place in the template); neighbouring
    diagonals merge, and a span counts if the grams that it shows, each checked word by word, cover
    enough of the template. A phrase counts where all its grams stand on one diagonal. Templates and
    phrases under K words have no gram: such a template is never found, such a phrase raises.
    """
    spark, keys = docs.sparkSession, list(keys)
    for said in PHRASES if phrases is None else phrases:
        if len(said.split()) < K:
            raise ValueError(f"A phrase needs {K} words or more: {said!r}")
    known = known_texts(spark, templates, phrases).select("tid", "label", "base", grams.small_grams(F.col("text"), K).alias("_g"))
    known = saved(known, "licence-templates")
    reference = known.select("tid", F.inline("_g")).select("h", "tid", "tpos", "words")
    n_reference = known.agg(F.coalesce(F.sum(F.size("_g")), F.lit(0))).first()[0]
    about = known.select("tid", "label", "base", F.size("_g").alias("need"))
    met = grams.join_grams(docs, keys, text, K, reference, n_reference)
    votes = met.groupBy(*keys, "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.max("n_words").alias("n_words"), F.collect_set("tpos").alias("seen"))
    order = Window.partitionBy(*keys, "tid").orderBy("diagonal")
    votes = votes.join(F.broadcast(about) if n_reference <= grams.BROADCAST_ROWS else about, "tid", "left")
    gap = F.coalesce(F.col("base"), F.lit(False)) | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK)
    votes = votes.withColumn("island", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(order))
    merged = votes.groupBy(*keys, "tid", "island").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("need").alias("need"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("start"), F.max(F.col("diagonal") + F.array_max("seen") + K).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("shown"),
    )
    return merged.withColumn("coverage", F.col("shown") / F.col("need"))


def scan_licenses(docs: DataFrame, templates: DataFrame | list | None = None, phrases: dict | None = None) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    docs needs doc_id and text; other columns are not read. Null or empty text: no words, no labels
    (''), score 0. Rows that repeat doc_id and text give one row; a null doc_id is a document of its
    own text. An empty table gives no rows. Texts of any length are scanned whole. score: the best coverage of a template, 1 for a phrase.
    """
    grams.bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_copy"), "text")
    found = spans(keyed, templates, phrases, ("doc_id", "_copy"))
    base = F.col("base") & (F.col("coverage") >= 1)
    more = ~F.col("base") & (F.col("coverage") >= COVERAGE)
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("doc_id", "_copy").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count_if(F.coalesce(base, F.lit(False))).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        names(base).alias("base_labels"),
        names(base | more).alias("labels"),
        F.coalesce(F.max(F.when(~F.col("base") | base, F.least(F.lit(1.0), F.col("coverage")))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(base | more, F.struct("start", "end", "label", "coverage")))).alias("spans"),
    ).drop("_copy")
