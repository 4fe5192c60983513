"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a regex over the words of a text joined by single spaces, with keywords, a
priority and a label. A text is looked at only where some keyword occurs in it, and by
a rule only where one of the rule's keywords does. A detection is dropped if it lies within one
of the same or higher priority; base phrases always count as base labels.
DataFrame operations only; texts are read once, and only the words of candidates are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_names, stored

_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, the regex of the name as it is written, the words of the SPDX identifier.
NAMES = [
    ("apache-1.1", r"apache (?:software )?license (?:version |v )?1 1", "apache 1 1"),
    ("apache-2.0", r"apache (?:software )?license (?:version |v )?2 0", "apache 2 0"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit", r"(?:mit|expat) license", "mit"),
    ("mit-0", r"mit no attribution(?: license)?", "mit 0"),
    ("bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) license", "bsd 2 clause"),
    ("bsd-3-clause", r"(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd) license", "bsd 3 clause"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd) license", "bsd 4 clause"),
    ("bsd", r"bsd(?: style)? license", "bsd"),
    ("0bsd", r"zero clause bsd license", "0bsd"),
    ("isc", r"isc license", "isc"),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?3(?: 0)?", "gpl 3 0"),
    ("gpl", r"gnu (?:general public license|gpl)", "gpl"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl) (?:version |v )?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?2 1", "lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?3(?: 0)?", "lgpl 3 0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "lgpl"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl) (?:version |v )?3(?: 0)?", "agpl 3 0"),
    ("agpl", r"(?:gnu )?affero general public license", "agpl"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license (?:version |v )?1 3", "gfdl 1 3"),
    ("gfdl", r"(?:gnu )?free documentation license", "gfdl"),
    ("mpl-1.1", r"mozilla public license (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", r"mozilla public license (?:version |v )?2 0", "mpl 2 0"),
    ("mpl", r"mozilla public license", "mpl"),
    ("epl-1.0", r"eclipse public license (?:version |v )?1 0", "epl 1 0"),
    ("epl-2.0", r"eclipse public license (?:version |v )?2 0", "epl 2 0"),
    ("epl", r"eclipse public license", "epl"),
    ("edl-1.0", r"eclipse distribution license(?: (?:version |v )?1 0)?", "edl 1 0"),
    ("cddl-1.0", r"common development and distribution license(?: (?:version |v )?1 0)?", "cddl 1 0"),
    ("cpl-1.0", r"common public license(?: (?:version |v )?1 0)?", "cpl 1 0"),
    ("ipl-1.0", r"ibm public license(?: (?:version |v )?1 0)?", "ipl 1 0"),
    ("eupl-1.2", r"european union public licen[cs]e(?: (?:version |v )?1 2)?", "eupl 1 2"),
    ("artistic-1.0", r"artistic license (?:version |v )?1 0", "artistic 1 0"),
    ("artistic-2.0", r"artistic license (?:version |v )?2 0", "artistic 2 0"),
    ("artistic", r"artistic license", "artistic"),
    ("bsl-1.0", r"boost software license(?: (?:version |v )?1 0)?", "bsl 1 0"),
    ("busl-1.1", r"business source license(?: (?:version |v )?1 1)?", "busl 1 1"),
    ("sspl-1.0", r"server side public license(?: (?:version |v )?1)?", "sspl 1 0"),
    ("elastic-2.0", r"elastic license(?: (?:version |v )?2 0)?", "elastic 2 0"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", r"libpng license", "libpng"),
    ("openssl", r"openssl license", "openssl"),
    ("python-2.0", r"python software foundation license", "python 2 0"),
    ("php-3.01", r"php license(?: (?:version |v )?3 01)?", "php 3 01"),
    ("ruby", r"ruby license", "ruby"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"do what the [^ ]+ you want to public license", "wtfpl"),
    ("ofl-1.1", r"(?:sil )?open font license(?: (?:version |v )?1 1)?", "ofl 1 1"),
    ("odbl-1.0", r"open (?:data commons open )?database license", "odbl 1 0"),
    ("odc-by-1.0", r"open data commons attribution license", "odc by 1 0"),
    ("pddl-1.0", r"public domain dedication and license", "pddl 1 0"),
    ("cdla-permissive-2.0", r"community data license agreement permissive(?: (?:version |v )?2 0)?", "cdla permissive 2 0"),
    ("cdla-sharing-1.0", r"community data license agreement sharing(?: (?:version |v )?1 0)?", "cdla sharing 1 0"),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: license)?(?: 1 0)?", "cc0 1 0"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike(?: license)?)(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial(?: license)?)(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives)(?: license)?)(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike(?: license)?)(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: license)?)(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution(?: international)?(?: license)?) 4 0", "cc by 4 0"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution(?: unported)?(?: license)?) 3 0", "cc by 3 0"),
    ("cc-by-2.0", r"(?:cc by|creative commons attribution(?: generic)?(?: license)?) 2 [05]", "cc by 2 0"),
    ("creative-commons", r"creative commons (?:public )?license", "creative commons"),
    ("ms-pl", r"microsoft public license", "ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "ms rl"),
    ("osl-3.0", r"open software license(?: (?:version |v )?3 0)?", "osl 3 0"),
    ("afl-3.0", r"academic free license(?: (?:version |v )?3 0)?", "afl 3 0"),
    ("ncsa", r"(?:university of illinois|ncsa) open source license", "ncsa"),
    ("upl-1.0", r"universal permissive license(?: (?:version |v )?1 0)?", "upl 1 0"),
    ("vim", r"vim license", "vim"),
    ("w3c", r"w3c software (?:notice and )?license", "w3c"),
    ("x11", r"x11 license", "x11"),
    ("beerware", r"beer ?ware license", "beerware"),
    ("cecill-2.1", r"cecill (?:free software )?license(?: agreement)?", "cecill 2 1"),
    ("mulanpsl-2.0", r"mulan permissive software license(?: (?:version |v )?2)?", "mulanpsl 2 0"),
    ("openrail", r"open ?rail(?: [ms]+)? license", "openrail"),
    ("llama-community", r"llama [23](?: [0-9])? community license(?: agreement)?", "llama community"),
]
_GRANT = r"(?:licensed|released|distributed|available|provided|published|shared|covered)(?: [^ ]+)? (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)? "

#: Statements that name no license: label, regex, keyword.
STATEMENTS = [
    ("public-domain", r"(?:in|into|to) the public domain", "public domain"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?(?: [^ ]+){1,3}", "copyright"),
    ("copyright", r"(?:c )?copyright(?: holders?| owners?)", "copyright"),
    ("reserved", r"some rights reserved", "rights reserved"),
    ("reserved", r"no rights reserved", "rights reserved"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution)[^.]{0,40} prohibited", "prohibited"),
    ("warranty", r"(?:provided )?as is without warrant(?:y|ies) of any kind", "as is without"),
    ("permissive", r"permission is hereby granted free of charge", "permission is hereby granted"),
    ("permissive", r"redistribution and use in source and binary forms", "redistribution and use"),
    ("restricted", r"(?:not for|no) commercial (?:use|redistribution)", "commercial"),
    ("restricted", r"for (?:personal|research|educational|academic) use only", "use only"),
]

#: How sure a detection of each priority is.
SURE = {1: 0.5, 2: 0.7, 3: 0.9, 4: 0.99}
#: Every rule's keyword has one of these in it, except those that are spelled out with gaps.
_TRIGGERS = ["licen", "w3c", "commons", "spdx", "cc0", "public" + _SEP + "+domain", "copyright", "rights" + _SEP + "+reserved",
             "proprietary", "prohibited", "as" + _SEP + "+is" + _SEP + "+without", "hereby" + _SEP + "+granted",
             "redistribution" + _SEP + "+and", "commercial", "use" + _SEP + "+only", "cc" + _SEP + "+by", "cc" + _SEP + "+zero",
             "gpl", "gnu", "cc" + _SEP + "+zero", "mit" + _SEP + "+no"]


def _keywords(pattern: str) -> list[str]:
    """Runs of plain words of which every match has one: the longest outside of groups,
    or one for each alternative where there is none."""
    plain = re.sub(r"\[[^\]]*\][?+*]?|\\.", "\n", pattern)
    while plain != (plain := re.sub(r"\((?:\?:)?[^()]*\)\?", "\n", plain)):
        pass
    plain = re.sub(r"[^(\n]\?", "\n", plain)
    runs = lambda text: max((p.strip() for p in text.split("\n")), key=len)
    outside = runs(re.sub(r"\(\?:[^()]*\)", "\n", plain))
    if re.search("[a-z]{3}", outside):
        return [outside]
    return [runs(x) for x in re.search(r"\(\?:([^()]*)\)", plain)[1].split("|")]


def rules() -> list[tuple[int, str, int, list[str], str, bool]]:
    """Id (the order), label, priority, keywords, regex, base. Highest priority first."""
    out = []
    for label, name, spdx in NAMES:
        out.append((label, 4, ["spdx license identifier"], rf"spdx license identifier {spdx}(?: or later| only)?", False))
    for label, name, _ in NAMES:
        out.append((label, 3, _keywords(name), _GRANT + name, False))
    for label, name, _ in NAMES:
        out.append((label, 2, _keywords(name), name, False))
    out += [(label, 1, [key], pattern, False) for label, pattern, key in STATEMENTS]
    out += [(label, 1, [phrase], phrase, True) for phrase, label in BASE.items()]
    return [(i, *x) for i, x in enumerate(out)]


def _literal(found: list[tuple[int, str, int, list[str], str, bool]]):
    names = ("rule", "label", "priority", "keywords", "pattern", "base")
    return F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, x, strict=True)]) for x in found])


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, and the joined words of texts that some keyword occurs in (else null)."""
    plain = clear_names(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)), " "), F.lit(" "))
    return plain.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("n_words"),
        F.when(F.col("text").rlike("(?i)" + "|".join(_TRIGGERS)), joined).alias("words"))


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(found: DataFrame) -> DataFrame:
    """Every rule's matches in the candidates: row, rule, label, priority, base, first, stop (in words)."""
    gated = F.filter(_literal(rules()), lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("words"), k)))
    hits = found.where("words IS NOT NULL").select("row", "words", F.explode(gated).alias("r")).select("row", "words", "r.*")
    # A match starts with the space before its first word and stops before the space behind its last.
    pattern = F.concat(F.lit(" (?:"), F.col("pattern"), F.lit(")(?= )"))
    parts = F.arrays_zip(F.split("words", pattern, -1).alias("gap"), F.regexp_extract_all("words", pattern, F.lit(0)).alias("match"))
    each = hits.where(F.regexp_like("words", pattern)).select("row", "rule", "label", "priority", "base", F.posexplode(parts).alias("turn", "part")).select(
        "row", "rule", "label", "priority", "base", "turn", _spaces(F.col("part.gap")).alias("gap"), _spaces(F.col("part.match")).alias("long"))
    before = Window.partitionBy("row", "rule").orderBy("turn")
    stop = F.sum(F.col("gap") + F.coalesce("long", F.lit(0))).over(before)
    return each.withColumn("stop", stop).where("long IS NOT NULL").select(
        "row", "rule", "label", "priority", "base", (F.col("stop") - F.col("long")).alias("first"), "stop")


def resolve(found: DataFrame) -> DataFrame:
    """Mark detections that lie within one of the same or higher priority."""
    order = Window.partitionBy("row").orderBy("first", F.desc("stop"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(order) for p in SURE]
    seen = F.element_at(F.array(*reach), F.col("priority"))
    return found.withColumn("suppressed", F.coalesce(seen >= F.col("stop"), F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as empty: no words, no labels, score 0. Rows are told apart by their
    place, so repeated rows and null ids each get their own result. Other columns are
    not read; an empty table gives no rows.
    """
    base = stored(candidates(docs), "license-words")
    found = resolve(detections(base))
    counts = F.col("base") | ~F.col("suppressed")
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv]), F.col("priority"))
    per_row = found.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(counts, F.col("label")))), ",").alias("labels"),
        F.max(F.when(counts, sure)).alias("score"))
    return base.drop("words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


#: The contract's columns that do not depend on the method's own rules, for comparisons.
BASE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
