"""License scan: ordered signature rules, a keyword gate, priorities and interval containment.

A text is brought to its words, each between two spaces, so that a phrase is a
plain substring and a rule a short regular expression over words. Stems gate
the texts, keywords gate the rules, and only then are regular expressions run.
A detection is an interval of words. It is dropped if a detection of higher
priority, or a longer one of the same rank, contains its interval; what is left
gives the labels. Base phrases are counted apart and always stay.

Defined results: a null or empty text has no words, no places and score 0; texts
are scanned whole; equal intervals keep the rule that comes first; repeated
rows get equal results; an empty table gives an empty result; columns of any
name pass through, since a row travels as one struct.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import lower_ascii

#: Phrases of the base labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: What separates words, after A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: One of these stands in every text that a rule can fit; the last four are for the forms that end in a name.
STEMS = (
    *("licen", "gpl", "copyright", "spdx", "public domain", "cc by"),
    *("released under", "distributed under", "available under", "provided under"),
)

#: label, names in texts, versions. Keyword: the first word of a name.
FAMILIES = (
    ("mit", ("mit", "expat", "x11"), ()),
    ("apache", ("apache", "apache software"), ("1 0", "1 1", "2 0", "2")),
    ("gpl", ("gnu general public", "general public", "gnu gpl", "gpl"), ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", ("gnu lesser general public", "lesser general public", "gnu library general public", "lgpl"), ("2", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public", "affero general public", "agpl"), ("1", "3", "3 0")),
    ("gfdl", ("gnu free documentation", "free documentation"), ("1 1", "1 2", "1 3")),
    ("bsd-2-clause", ("simplified bsd", "bsd 2 clause", "2 clause bsd"), ()),
    ("bsd-3-clause", ("new bsd", "modified bsd", "bsd 3 clause", "3 clause bsd"), ()),
    ("bsd", ("bsd", "berkeley software distribution"), ()),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public",), ("1 0",)),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("boost", ("boost software",), ("1 0",)),
    ("artistic", ("artistic", "perl artistic"), ("1 0", "2 0")),
    ("eupl", ("european union public", "eupl"), ("1 1", "1 2")),
    ("osl", ("open software",), ("2 1", "3 0")),
    ("ofl", ("sil open font", "open font"), ("1 0", "1 1")),
    ("odbl", ("open database", "odc open database"), ("1 0",)),
    ("wtfpl", ("do what the fuck you want to public",), ("2",)),
    ("unlicense", ("unlicense",), ()),
    ("python", ("python software foundation", "psf"), ("2",)),
    ("php", ("php",), ("3 0", "3 01")),
    ("ruby", ("ruby",), ()),
    ("bsl", ("business source",), ("1 0", "1 1")),
    ("sspl", ("server side public",), ("1",)),
    ("elastic", ("elastic",), ("1", "2", "2 0")),
    ("cc-by", ("cc by", "creative commons attribution"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
)

#: label, keyword, words as a regular expression (``_`` between words, ``<n>`` for n words at most), priority, confidence.
#: The standard texts leave 62 words (MIT), 14 (ISC) and 22 (BSD) in their gaps.
NOTICES = (
    ("proprietary", "reserved", "copyright<27>_all_rights_reserved", 30, 0.6),
    ("proprietary", "confidential", "proprietary_and_confidential<14>_licen[cs]e", 30, 0.7),
    ("public-domain", "domain", "(released_into|placed_in|dedicated_to)_the_public_domain", 50, 0.8),
    ("mit", "permission", "permission_is_hereby_granted_free_of_charge<134>_copyright", 60, 0.95),
    ("isc", "permission", "permission_to_use_copy_modify_and_or_distribute_this_software<67>_copyright", 60, 0.9),
    ("bsd", "redistribution", "redistribution_and_use_in_source_and_binary_forms<67>_copyright", 60, 0.9),
    ("see-license", "file", "see_(the_)?licen[cs]e_file", 20, 0.3),
)

#: Forms of a name: words before and after it, priority, confidence. Names alone need the word license.
FORMS = (
    ("spdx_licen[cs]e_identifier_", "", 90, 1.0),
    ("(licen[cs]ed|released|distributed|available|provided)_under_(the_)?(terms_of_the_)?", "(_licen[cs]e)?", 80, 0.95),
    ("", "_licen[cs]e", 40, 0.7),
)

#: Names of one word that a version may be attached to, as in gplv3, lgplv2 1 or apache2.
SHORT = tuple(name for _, names, versions in FAMILIES if versions for name in names if name.isalpha())

RULE = "array<struct<place:int, label:string, keyword:string, pattern:string, priority:int, confidence:double>>"


def signature_rules() -> list[dict]:
    """Every form of every name with every version, then the notices; order settles ties of priority and length."""
    rules = []
    for before, after, priority, confidence in FORMS:
        for label, names, versions in FAMILIES:
            for name in names:
                words = name.replace(" ", "_")
                if after == "_licen[cs]e" and words.endswith(("gpl", "unlicense")):
                    after_name = "(_licen[cs]e)?"  # the name has a stem itself
                else:
                    after_name = after
                for version in (*versions, ""):
                    number = version.replace(" ", "_")
                    tail = f"_(version_|v(_)?)?{number}(_or_later)?" if version else ""
                    ending = after_name + tail
                    if name.split()[-1] in SHORT:
                        fused = f"(v(_)?)?{number}(_or_later)?" if version else "(v|v?[0-9]+)"
                        ending = f"({ending}|{fused}{after_name})"
                    rank = priority + (5 if version else 0)
                    rules.append({"label": label, "keyword": name.split()[0], "pattern": f"{before}{words}{ending}", "priority": rank, "confidence": confidence})
    rules += [{"label": a, "keyword": k, "pattern": p, "priority": r, "confidence": c} for a, k, p, r, c in NOTICES]
    for place, rule in enumerate(rules):
        rule["pattern"] = _spaced(rule["pattern"])
        rule["place"] = place
    return rules


def _spaced(pattern: str) -> str:
    """``_`` becomes the two spaces between words, ``<n>`` a gap of whole words; the ends must be word ends."""
    return "(?<= )" + re.sub("<([0-9]+)>", r"(?:_[^ ]+){0,\1}?", pattern).replace("_", "  ") + "(?= )"


def spaced_words(text: Column) -> Column:
    """`` w1  w2 ``: the lower-cased words, each between two spaces; empty if there is none."""
    padded = F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" "))
    bare = F.regexp_replace(padded, BREAKS, "  ")
    # the ends of the text have two spaces each, or it is nothing but two
    return F.when(F.length(bare) <= 2, F.lit("")).otherwise(F.substring(bare, F.lit(2), F.length(bare) - 2))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(words: Column) -> Column:
    return F.floor(_spaces(words) / 2).cast("long")


def _starts(words: Column, phrase: str) -> Column:
    """Words before each place of the phrase: they stand in the pieces between its places."""
    pieces = F.split(words, " " + phrase.replace(" ", "  ") + " ")
    before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: word_count(piece))
    n = len(phrase.split())
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, gap: Column) -> Column:
        start = acc["at"] + gap
        return F.struct((start + n).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    return F.aggregate(before, state, step, lambda acc: acc["starts"])


def _detections(words: Column, rule: Column) -> Column:
    """Intervals (start, end) in words of all places of one rule."""
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    pieces = F.split(words, rule["pattern"], F.lit(-1))
    # side by side, since an expression inside a lambda, such as the split, would be evaluated for every place
    gap, n = (lambda piece: word_count(F.concat(piece, F.lit(" "))) - 1), (lambda text: word_count(text) + 1)
    pairs = F.zip_with(pieces, found, lambda piece, text: F.struct(gap(piece).alias("gap"), n(text).alias("n")))
    pairs = F.filter(pairs, lambda pair: pair["n"].isNotNull())  # behind the last place stands a piece alone
    interval = "array<struct<start:bigint,end:bigint,label:string,place:int,priority:int,confidence:double>>"
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(interval).alias("all"))

    def step(acc: Column, pair: Column) -> Column:
        start, end = acc["at"] + pair["gap"], acc["at"] + pair["gap"] + pair["n"]
        one = F.struct(start.alias("start"), end.alias("end"), *[rule[x].alias(x) for x in ("label", "place", "priority", "confidence")])
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    return F.aggregate(pairs, state, step, lambda acc: acc["all"])


def _beats(a: Column, b: Column) -> Column:
    """Whether detection ``a`` contains ``b`` and comes before it: by priority, then length, then rule order."""
    inside = (a["start"] <= b["start"]) & (a["end"] >= b["end"])
    length_a, length_b = a["end"] - a["start"], b["end"] - b["start"]
    first = (a["priority"] > b["priority"]) | (
        (a["priority"] == b["priority"]) & ((length_a > length_b) | ((length_a == length_b) & (a["place"] < b["place"])))
    )
    return inside & first


def license_scan(docs: DataFrame, carry: Sequence[str] | None = None, text_column: str = "text", rules: Sequence[dict] | None = None) -> DataFrame:
    """Per row ``_row``, ``_n_words``, ``_base`` (start and label of each base place), ``_found`` (detections left).

    The gates leave few texts for the regular expressions; for those all work
    stays within the row, so nothing is shuffled and no hot key can arise.
    """
    rules = signature_rules() if rules is None else rules
    table = F.from_json(F.lit(json.dumps(rules)), RULE)
    keywords = sorted({rule["keyword"] for rule in rules})
    words = F.col("_words")
    gated = F.lit(False)
    for stem in STEMS:
        gated = gated | F.contains(words, F.lit(stem.replace(" ", "  ")))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("_row"), spaced_words(F.col(text_column)).alias("_words"))

    none = F.array().cast("array<struct<start:bigint,label:string>>")

    def places_of(phrase: str, label: str) -> Column:
        places = F.transform(_starts(words, phrase), lambda at: F.struct(at.alias("start"), F.lit(label).alias("label")))
        return F.when(F.contains(words, F.lit(" " + phrase.replace(" ", "  ") + " ")), places).otherwise(none)

    places = F.concat(*[places_of(*base) for base in BASE])
    # beside a short name with a version attached goes the name itself, which is the keyword
    named = F.regexp_replace(words, f" (({'|'.join(SHORT)})(?:v|v?[0-9]+)) ", " $1  $2 ")
    present = F.array_intersect(F.split(named, " +"), F.array(*map(F.lit, keywords)))
    candidates = F.filter(table, lambda rule: F.array_contains(F.col("_present"), rule["keyword"]))
    detected = F.array_sort(F.flatten(F.transform(candidates, lambda rule: _detections(words, rule))))
    left = F.filter("_detected", lambda b: ~F.exists("_detected", lambda a: _beats(a, b)))
    empty = "array<struct<start:bigint,end:bigint,label:string,place:int,priority:int,confidence:double>>"
    return (
        rows.withColumn("_gated", gated)
        .withColumn("_present", F.when(F.col("_gated"), present).otherwise(F.array().cast("array<string>")))
        .withColumn("_detected", F.when(F.size("_present") > 0, detected).otherwise(F.array().cast(empty)))
        .select("_row", word_count(words).alias("_n_words"), F.when(F.col("_gated"), places).otherwise(none).alias("_base"), left.alias("_found"))
    )
