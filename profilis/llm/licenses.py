"""Licence scans as Spark expressions only.

A cheap gate of literal searches lets most texts pass unread. For the rest the text is
normalised to lower-case words joined by one space; a rule runs only if its keyword
stands in the text; every match is an interval of words. Of overlapping detections one
that lies inside another of the same or a better priority is suppressed; among equal
intervals the better priority, then the earlier rule, stays.

Matches are marked in the text before it is cut into words, so that their places come from
the words' numbers, and the suppression is one running fold: both are near linear in the
length of a text and in the number of its matches.

Base phrases are always kept. Defined results: null texts are empty (no words, no
places, score 0); repeated rows are scanned alike; labels are distinct and sorted; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import scanned
from profilis.llm.license_rules import PRIORITIES, rules

# The base phrases with their labels, and the characters that words lack.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Any text with a base phrase or a rule's match holds one of these (ASCII, either case).
GATES = (
    "licen", "spdx", "gpl", "public", "wtfpl", "rights", "proprietary", "permission", "redistribution", "free software", "altered", "opensource",
    "creative", "copyleft", "eupl", "cddl", "cc0", "beerware", "rail", "boost", "microsoft", "commons", "polyform", "mozilla", "apache",
)
#: Or one of these marks, for which a literal search alone would let too many texts in.
SHORT = r"(?i)(?<![0-9A-Za-z])(?:cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|ms[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[pr]l|mplv?(?:ersion)?)(?![A-Za-z])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _gate(text: Column) -> Column:
    """Whether any phrase or rule could match; never false for a text with a match."""
    low = F.lower(text)
    sure = F.lit(False)
    for g in GATES:
        sure |= F.contains(low, F.lit(g))
    return sure | ((F.contains(low, F.lit("cc")) | F.contains(low, F.lit("mpl")) | F.contains(low, F.lit("ms"))) & text.rlike(SHORT))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(words: Column) -> Column:
    """For each base phrase, its label and the first words of its places."""
    out = []
    for phrase, label in BASE:
        pieces = F.split(words, f"(?<= ){phrase}(?= )")
        n = F.size(pieces) - 1
        first = _spaces(pieces[0]) - 1
        last = _spaces(words) - _spaces(F.element_at(pieces, -1)) - phrase.count(" ") - 1
        out.append(F.struct(F.lit(label).alias("label"), n.cast("bigint").alias("n"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last")))
    return F.filter(F.array(*out), lambda p: p["n"] > 0)


def _rule_groups() -> Column:
    by: dict[str, list] = defaultdict(list)
    for at, r in enumerate(rules()):
        entry = F.struct(F.lit(at).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.regex).alias("regex"))
        by[r.keyword].append(entry)
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by.items()])


#: Marks around a match; words never hold them.
OPEN, CLOSE = "\x01", "\x02"
DETECTION = "struct<first:int,back:int,priority:int,rule:int,label:string,confidence:double>"


def _matches(words: Column) -> Column:
    """All detections: rule, label, priority, confidence, first word, word after the last."""
    active = F.flatten(F.transform(F.filter(_rule_groups(), lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    marked = F.transform(active, lambda r: F.struct(r.alias("r"), F.regexp_replace(words, r["regex"], F.lit(f"{OPEN}$0{CLOSE}")).alias("text")))

    def of_rule(found):
        r = found["r"]
        # words begin with a space, so the first one is number 1 of the split text
        at = lambda test: F.array_compact(F.transform(F.split(found["text"], " "), lambda w, i: F.when(test(w), i)))
        place = lambda first, last: F.struct(
            r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"),
            (first - 1).alias("first"), last.alias("end"),
        )
        return F.zip_with(at(lambda w: F.startswith(w, F.lit(OPEN))), at(lambda w: F.endswith(w, F.lit(CLOSE))), place)

    return F.flatten(F.transform(F.filter(marked, lambda m: F.contains(m["text"], F.lit(OPEN))), of_rule))


def _suppressed(matches: Column) -> Column:
    """Detections left once contained ones of no better priority are gone."""
    order = F.array_sort(F.transform(matches, lambda m: F.struct(m["first"].alias("first"), (-m["end"]).alias("back"), m["priority"].alias("priority"), m["rule"].alias("rule"), m["label"].alias("label"), m["confidence"].alias("confidence"))))

    def step(reach, m):
        # reach[p]: the furthest end of detections so far of priority p or better
        further = F.transform(reach, lambda x, p: F.when(p >= m["priority"], F.greatest(x, -m["back"])).otherwise(x))
        return further, F.when(reach[m["priority"]] < -m["back"], m)

    return scanned(order, F.array(*[F.lit(-1)] * PRIORITIES), DETECTION, step)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places and labels, kept detections, labels and score; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))
    seen = docs.select(id_col, F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"), F.when(_gate(text), words).alias("words"))
    # the matches of the few gated texts; arrays stay null elsewhere, and nothing is evaluated
    gated = seen.select(id_col, "n_words", F.when(F.col("words").isNotNull(), F.struct(_places(F.col("words")).alias("places"), _matches(F.col("words")).alias("matches"))).alias("found"))
    kept = gated.select(id_col, "n_words", F.col("found.places").alias("places"), F.when(F.col("found").isNotNull(), _suppressed(F.col("found.matches"))).alias("detections"))
    none = F.expr("cast(array() as array<string>)")
    base = F.coalesce(F.transform("places", lambda p: p["label"]), none)
    all_labels = F.concat(base, F.coalesce(F.transform("detections", lambda d: d["label"]), none))
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return kept.select(
        id_col,
        "n_words",
        F.coalesce(F.aggregate("places", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(all_labels)), ",").alias("labels"),
        F.when(F.size(base) > 0, F.greatest(score, F.lit(0.95))).otherwise(score).alias("score"),
        F.transform("detections", lambda d: F.struct(d["rule"].alias("rule"), d["label"].alias("label"), d["first"].alias("first"), (-d["back"]).alias("end"))).alias("detections"),
    )
