"""Licence scans: an exact set-similarity join of text blocks and licence templates.

Words are runs of letters and digits (every non-ASCII character counts as a
letter), ASCII-lower-cased. Each template has text blocks of its own length: half_block() words or more than it has, and
as many again; blocks start every half, so that a template that stands in a
text stands in one block, however long it is. A block meets a template if it holds at least ``threshold`` of
the template's distinct words.

The join is exact. Words are ordered by how many documents hold them, rarest
first. A block that meets a template of n words holds m = ceil(threshold * n) of them, so
it holds one of the first n - m + 1 in that order (prefix filter), at least m words of
any template (length filter), and after the first shared word enough words are left
in both (positional filter). Pairs that pass are confirmed on the full sets. Only
documents with a prefix word are cut into blocks at all.

Everything is DataFrame operations. Templates are few and given with the code, so what is made of them is broadcast. Null and empty texts have no words, no label and
score 0; an empty table gives an empty result, and so do templates without a word. Rows with equal ids are kept apart by a digest of their text; equal rows get equal results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The shortest half of a block.
HALF = 16
THRESHOLD = 0.8
#: label: template. Common short notices, and whole texts and file headers as they are published.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-notice": "This source code form is subject to the terms of the Mozilla Public License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see https://www.gnu.org/licenses/.""",
}
#: phrase: label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_words(text: Column) -> Column:
    """The words of a text, each with one space on both sides of it; one space if there are none. Case is kept."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+", " ")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(plain: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of ASCII-lower-cased plain words."""
    count, first, last, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle = F.lit(f" {phrase} ")
        there = F.contains(plain, needle)
        words = len(phrase.split())
        # A phrase's last space may be the next one's first.
        count.append(F.regexp_count(plain, F.lit(f" {phrase}(?= )")).cast("long"))
        first.append(F.when(there, _spaces(F.substring_index(plain, f" {phrase} ", 1))).cast("long"))
        last.append(F.when(there, _spaces(plain) - _spaces(F.substring_index(plain, f" {phrase} ", -1)) - (words + 1)).cast("long"))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": sum(count[1:], count[0]),
        "first_word": F.least(*first) if len(first) > 1 else first[0],
        "last_word": F.greatest(*last) if len(last) > 1 else last[0],
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def half_block(template: str) -> int:
    """The words between the starts of a template's blocks: HALF doubled until the template fits."""
    n, half = len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", template)), HALF
    while half < n:
        half *= 2
    return half


def template_order(plain: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(label, word, place, n, least, rank, half): each template's distinct words by rising document frequency.

    plain: one column ``plain`` of ASCII-lower-cased plain words. rank: the word's place in the global order.
    """
    spark = plain.sparkSession
    words = spark.createDataFrame([(k, t, half_block(t)) for k, t in sorted(templates.items())], "label string, template string, half int").select("label", "half", F.explode(F.array_distinct(F.filter(F.split(ascii_lower(plain_words(F.col("template"))), " "), lambda w: w != ""))).alias("word"))
    vocabulary = sorted({r["word"] for r in words.collect()})  # of the templates
    held = plain.select(F.explode(F.array_intersect(F.split("plain", " "), F.array(*[F.lit(w) for w in vocabulary]))).alias("word"))
    counts = held.groupBy("word").agg(F.count("*").alias("n_docs"))
    order = words.join(F.broadcast(counts), "word", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    by_label = Window.partitionBy("label").orderBy("n_docs", "word")
    order = order.withColumns({"place": F.row_number().over(by_label) - 1, "n": F.count("*").over(Window.partitionBy("label")), "rank": F.dense_rank().over(Window.orderBy("n_docs", "word"))})
    return order.select("label", "word", "place", "n", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int").alias("least"), "rank", "half")


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks): one row a row of ``docs``.

    labels: of phrases and of met templates, sorted. score: the largest share of a met template's words in a
    block. blocks: the met templates as (label, first word of the block, share).
    """
    order = template_order(docs.select(ascii_lower(plain_words(F.col(text_column))).alias("plain")), templates, threshold)
    rows = [r.asDict() for r in order.collect()]  # of the templates
    rank = {r["word"]: r["rank"] for r in rows}
    prefix = sorted({r["word"] for r in rows if r["place"] <= r["n"] - r["least"]})
    plain = ascii_lower(plain_words(F.col(text_column)))
    base = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("digest"), plain.alias("plain"))
    places = phrase_places(F.col("plain"), phrases)

    # A space on each side is looked ahead for, so that neighbours share it.
    has_prefix = F.col("plain").rlike(" (" + "|".join(prefix) + ") ") if prefix else F.lit(False)
    kept = F.create_map(*[F.lit(x) for w in sorted(rank) for x in (w, rank[w])])
    found = base.where(has_prefix).dropDuplicates(["id", "digest"]).select("id", "digest", F.posexplode(F.split(F.trim("plain"), " ")).alias("at", "word")).where(F.col("word").isin(sorted(rank)))
    halves = sorted({r["half"] for r in rows})
    fewest = F.create_map(*[F.lit(x) for h in halves or [HALF] for x in (h, min((r["least"] for r in rows if r["half"] == h), default=1))])
    places_of = F.array(*[F.struct(F.lit(h).alias("half"), (F.floor(F.col("at") / h) - back).alias("block")) for h in halves or [HALF] for back in (0, 1)])
    found = found.withColumn("rank", kept[F.col("word")]).select("id", "digest", "rank", F.explode(places_of).alias("b")).select("id", "digest", "rank", "b.half", "b.block").where("block >= 0")
    blocks = found.groupBy("id", "digest", "half", "block").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))  # template words only: few
    blocks = blocks.where(F.size("ranks") >= fewest[F.col("half")])

    sets = order.groupBy("label", "n", "least", "half").agg(F.array_sort(F.collect_list("rank")).alias("template"))
    starts = order.where("place <= n - least").select("label", "rank", "place")
    starts = F.broadcast(starts.join(F.broadcast(sets), "label"))  # templates: their size is fixed
    pairs = blocks.select("*", F.posexplode("ranks").alias("own_place", "rank")).join(starts, ["rank", "half"])
    pairs = pairs.where(F.size("ranks") >= F.col("least"))  # length
    left = F.least(F.col("n") - F.col("place"), F.size("ranks") - F.col("own_place"))
    pairs = pairs.groupBy("id", "digest", "half", "block", "label", "n", "least", "ranks", "template").agg(F.max(left).alias("left"))
    pairs = pairs.where(F.col("left") >= F.col("least"))  # position: of the first shared word all shared ones are left
    share = F.size(F.array_intersect("ranks", "template")) / F.col("n")
    met = pairs.withColumn("share", share).where(F.col("share") >= F.col("least") / F.col("n"))
    met = met.groupBy("id", "digest").agg(F.array_sort(F.collect_set("label")).alias("met"), F.max("share").alias("score"), F.array_sort(F.collect_list(F.struct("label", (F.col("block") * F.col("half")).alias("word"), "share"))).alias("blocks"))

    counted = base.select("id", "digest", F.greatest(_spaces(F.col("plain")) - 1, F.lit(0)).cast("long").alias("n_words"), *[c.alias(k) for k, c in places.items()])
    met = met.withColumnsRenamed({"id": "met_id", "digest": "met_digest"})
    out = counted.join(met, counted["id"].eqNullSafe(met["met_id"]) & (counted["digest"] == met["met_digest"]), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("met", F.array().cast("array<string>"))))
    return out.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "blocks",
    )
