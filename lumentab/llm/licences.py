"""Licence scans: canonical texts hashed and joined to known licence digests.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent
spellings do not count) and its digest is joined to the digests of known notices. Whole
documents and their single lines are looked up alike; texts that stand inside a document, over
several lines or within one, are found in its canonical words. Known are one-sentence notices
and the full licence texts in the folder ``licence_texts``.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumentab.llm.words import lower_ascii

#: Known notices, each in the wording projects use; a caller may pass a longer table.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
]
#: Equivalent spellings: pattern of whole words in the canonical form, and what stands for it.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("creative commons", "cc"), ("attribution", "by"), ("noncommercial", "nc"), ("non commercial", "nc"), ("sharealike", "sa"), ("share alike", "sa"), ("v", "version")]
#: A line that states a copyright holder: it opens with the word or a sign and names a year.
COPYRIGHT = r"^[\x00-\x2F\x3A-\x40]*(copyright|\(c\)|©).*[0-9][0-9][0-9][0-9]"
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spelled(text: Column) -> Column:
    """Equivalent spellings in a text whose words stand between two spaces each."""
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(text, " +", " "))


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for copyright lines."""
    low = lower_ascii(line)
    text = F.concat(F.lit(" "), F.regexp_replace(low, SIGNS, "  "), F.lit(" "))
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(_spelled(text))


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines that say something."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def canonical_words(lines: Column) -> Column:
    """All canonical lines as one; spellings of two words may stand on two lines."""
    return _spelled(F.concat(F.lit(" "), F.replace(F.array_join(lines, " "), F.lit(" "), F.lit("  ")), F.lit(" ")))


def known_digests(notices: DataFrame) -> DataFrame:
    """``digest, licence`` from ``licence, text``; a digest of two licences goes to the first by name."""
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    table = notices.select(whole.alias("canonical"), "licence").filter("canonical <> ''")
    return table.groupBy(F.sha2("canonical", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def default_notices(spark: SparkSession) -> DataFrame:
    """Notices and full texts; the texts are read where the plan is made, not in tasks."""
    texts = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    return spark.createDataFrame(NOTICES + texts, "licence string, text string")


def _inside(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """``id, key, inside``: licences whose canonical words are a part of a row's, but not all of them.

    Rows without the first two words of any known text are passed over before the comparison.
    """
    known = notices.select("licence", canonical_words(canonical_lines(F.col("text"))).alias("known")).filter("known <> ''").groupBy("known").agg(F.min("licence").alias("licence")).collect()
    if not known:
        return rows.select("id", "key", F.array().cast("array<string>").alias("inside")).limit(0)
    openings = sorted({re.escape(" ".join(r["known"].split(" ")[:2])) for r in known})
    table = rows.sparkSession.createDataFrame([(r["known"], r["licence"]) for r in known], "known string, licence string")
    some = rows.select("id", "key", canonical_words(F.col("lines")).alias("words")).filter(F.col("words").rlike(f"(?:^| )(?:{'|'.join(openings)})(?: |$)"))
    part = (F.col("words") != F.col("known")) & F.concat(F.lit(" "), "words", F.lit(" ")).contains(F.concat(F.lit(" "), "known", F.lit(" ")))
    return some.join(F.broadcast(table), part).groupBy("id", "key").agg(F.collect_set("licence").alias("inside"))


def scan_licences(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, whole_licence, licences, n_lines``: one row per row of ``docs``.

    ``whole_licence`` names the licence whose canonical text is the document's entire canonical
    text (null else); ``licences`` lists, sorted, those whose canonical text is one of its lines
    or a run of its words, within a line or over several; ``n_lines`` counts the lines that are a
    known text by themselves. The digests of whole texts and lines are exploded and joined
    to the table of known digests; only hits are grouped, and only ids meet them again.

    Defined cases: null and empty texts, and texts of copyright lines alone, match nothing;
    repeated rows give the same answer each; null ids are kept; an empty table of notices
    matches nothing; other columns are not read.
    """
    # the digests of a line never leave the row; a copy of a text gives the copy's answer
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.length(text_col)).alias("key"), canonical_lines(F.col(text_col)).alias("lines"))
    # unit 0 is the whole text, the lines follow
    units = F.concat(F.array(F.array_join("lines", " ")), F.col("lines"))
    parts = rows.select("id", "key", F.posexplode(F.transform(units, lambda x: F.sha2(x, 256))).alias("unit", "digest")).withColumn("whole", F.col("unit") == 0)
    hits = parts.join(known_digests(notices), "digest").groupBy("id", "key").agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence"),
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("licences"),
        F.count_distinct(F.when(~F.col("whole"), F.col("unit"))).alias("hit_lines"),
    )
    inside = _inside(rows, notices)
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.length(text_col)).alias("key"))
    per_row = ids.alias("d")
    for name, found in (("h", hits), ("i", inside)):
        per_row = per_row.join(found.alias(name), F.col("d.id").eqNullSafe(F.col(f"{name}.id")) & (F.col("d.key") == F.col(f"{name}.key")), "left")
    none = F.array().cast("array<string>")
    return per_row.select(
        F.col("d.id").alias(id_col), "h.whole_licence",
        F.sort_array(F.array_union(F.coalesce("h.licences", none), F.coalesce("i.inside", none))).alias("licences"),
        F.coalesce("h.hit_lines", F.lit(0)).cast("bigint").alias("n_lines"),
    )
