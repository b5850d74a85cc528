"""Licence scans by canonical digest, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings) and its SHA-256 is hash-joined to the digests of known
licences. Two sorts of text are looked up whole: documents, joined to licence
texts, and single lines, looked up among the few licence notices.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.licence_texts import NOTICES, TEXTS

#: Equivalent spellings (word -> word), applied to canonical text.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "merchantibility": "merchantability", "organisation": "organization", "organisations": "organizations", "acknowledgement": "acknowledgment", "favour": "favor", "whilst": "while", "http": "https"}
#: Known digests beyond which they are joined by shuffle rather than broadcast.
BROADCAST_DIGESTS = 100_000


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters and digits in the common spelling, one space between."""
    lines = F.regexp_replace(F.lower(text), r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", " ")
    words = F.concat(F.lit(" "), F.regexp_replace(lines, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where that is empty."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """(license, known) for each known text by licence name."""
    rows = [(name, text) for name, forms in texts.items() for text in forms]
    found = spark.createDataFrame(rows, "license string, text string").select("license", digest(F.col("text")).alias("known"))
    return found.filter("known is not null").groupBy("known").agg(F.min("license").alias("license"))


def _small(known: DataFrame) -> DataFrame:
    """known, broadcast only if its size was counted and is bounded."""
    return F.broadcast(known) if known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else known


def _needles(spark: SparkSession, notices: dict[str, list[str]]) -> list[str]:
    """Words of which each notice has one, in all their spellings: a line without any can't be a notice."""
    rows = spark.createDataFrame([(n,) for forms in notices.values() for n in forms], "text string")
    left = [set(r[0].split()) for r in rows.select(canonical(F.col("text"))).collect() if r[0]]  # as large as the argument
    found = []
    while left:
        counts = Counter(w for words in left for w in words)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        found += [best, *(old for old, new in SPELLINGS.items() if new == best)]
        left = [words for words in left if best not in words]
    return sorted(found)


def scan_licenses(docs: DataFrame, doc: str = "doc_id", text: str = "text", texts: dict | None = None, notices: dict | None = None) -> DataFrame:
    """One row per document: doc, text_digest, license, n_notices, notices.

    license names the licence that the whole text is, else null. n_notices counts
    the lines that are a known notice; notices joins their distinct licences by
    commas, sorted, empty if none. A null text, or one without letters or digits,
    has a null digest and no licence. Repeated rows give repeated results, an
    empty table an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = _small(known_digests(spark, TEXTS if texts is None else texts))
    lines_known = NOTICES if notices is None else notices
    slim = docs.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("__text"))
    needles = _needles(spark, lines_known)
    lines = F.filter(F.split("__text", "\n"), lambda line: F.lower(line).rlike("|".join(needles) or "$^"))
    form = F.transform(lines, digest)
    rows = slim.select("__doc", digest(F.col("__text")).alias("text_digest"), F.coalesce(form, F.array().cast("array<string>")).alias("__lines"))
    rows = rows.join(whole.withColumnRenamed("known", "text_digest"), "text_digest", "left")
    table = known_digests(spark, lines_known).collect()  # as large as the argument notices
    entries = F.create_map(*[F.lit(x) for known, name in table for x in (known, name)]) if table else F.lit(None).cast("map<string,string>")
    named = F.coalesce(F.filter(F.transform("__lines", lambda d: F.try_element_at(entries, d)), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return rows.withColumn("__named", named).select(F.col("__doc").alias(doc), "text_digest", "license", F.size("__named").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("__named")), ",").alias("notices"))
