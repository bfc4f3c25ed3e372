r"""License scan by ordered signature rules.

All of it is DataFrame functions. A text is brought to lower-case words with one
space around each. Rules are regular expressions over such words, made from the
families and forms below; they stand in the order of their priority. A rule is
tried only where the keyword of its family stands in the text, and texts without
any license word are not brought to words at all.

The places of a rule are found by marking its matches in the text and reading off
the words that carry a mark. All places of a text are sorted by start and length;
one that lies inside another of the same or a higher priority is suppressed, of
equal places the earlier rule stays. The sorted places are worked through in runs
of ``RUN``: what reaches furthest in earlier runs is carried along, so the cost
grows with the number of places.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = 64
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: phrases whose places are counted, and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# parts of words; no rule matches a text that has none of them and no word "cc"
GATES = ["licen", "wtfpl", "beer", "permission", "redistribut", "neither", "warrant", "public", "rights", "unauthorized", "cc0", "creative"]

#: family: (keyword that every name has, name as a regular expression over words, identifier words); the label is the family up to a slash
FAMILIES = {
    "mit": ("mit", r"mit(?: x11| expat)?", r"mit(?: 0)?"),
    "mit/expat": ("expat", r"expat", r"expat"),
    "mit/x11": ("x11", r"x11", r"x11"),
    "apache": ("apache", r"apache(?: software)?", r"apache (?:1 [01]|2 0)"),
    "gpl": ("general public", r"(?:gnu )?general public", r"gpl [123] 0(?: only| or later)?"),
    "lgpl": ("general public", r"(?:gnu )?(?:lesser|library) general public", r"lgpl (?:2 [01]|3 0)(?: only| or later)?"),
    "agpl": ("affero", r"(?:gnu )?affero general public", r"agpl [13] 0(?: only| or later)?"),
    "gfdl": ("free documentation", r"(?:gnu )?free documentation", r"gfdl 1 [123](?: only| or later)?"),
    "bsd": ("bsd", r"(?:(?:new|modified|simplified|original|revised|2 clause|3 clause|4 clause|two clause|three clause|four clause) )?bsd(?: style)?(?: [0234] clause)?", r"(?:0bsd|bsd [1234] clause)"),
    "mpl": ("mozilla", r"mozilla(?: public)?", r"mpl [12] [01]"),
    "epl": ("eclipse", r"eclipse(?: public)?", r"epl [12] 0"),
    "cddl": ("common development", r"common development and distribution", r"cddl 1 [01]"),
    "cpl": ("common public", r"common public", r"cpl 1 0"),
    "isc": ("isc", r"isc", r"isc"),
    "zlib": ("zlib", r"zlib(?: libpng)?", r"zlib"),
    "boost": ("boost", r"boost(?: software)?", r"bsl 1 0"),
    "artistic": ("artistic", r"(?:perl )?artistic", r"artistic [12] 0"),
    "python": ("python", r"python(?: software foundation)?", r"(?:psf|python) 2 0"),
    "php": ("php", r"php", r"php 3 0[1]?"),
    "ruby": ("ruby", r"ruby", r"ruby"),
    "w3c": ("w3c", r"w3c(?: software(?: notice and)?)?", r"w3c"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl", r"wtfpl"),
    "eupl": ("european union", r"european union public", r"eupl 1 [012]"),
    "osl": ("open software", r"open software", r"osl [123] [01]"),
    "afl": ("academic free", r"academic free", r"afl [123] [012]"),
    "ms-pl": ("microsoft public", r"microsoft public", r"ms pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal", r"ms rl"),
    "ofl": ("open font", r"(?:sil )?open font", r"ofl 1 [01]"),
    "odbl": ("open database", r"(?:odc )?open database", r"odbl 1 0"),
    "odc-by": ("open data commons", r"open data commons attribution", r"odc by 1 0"),
    "pddl": ("public domain dedication", r"(?:odc )?public domain dedication and", r"pddl 1 0"),
    "openssl": ("openssl", r"openssl(?: ssleay)?", r"openssl"),
    "postgresql": ("postgresql", r"postgresql", r"postgresql"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    "qpl": ("q public", r"q public", r"qpl 1 0"),
    "sleepycat": ("sleepycat", r"sleepycat", r"sleepycat"),
    "vim": ("vim", r"vim", r"vim"),
    "beerware": ("beer", r"beer ?ware", r"beerware"),
    "json": ("json", r"json", r"json"),
    "sspl": ("server side", r"server side public", r"sspl 1 0"),
    "elastic": ("elastic", r"elastic", r"elastic 2 0"),
    "busl": ("business source", r"business source", r"busl 1 1"),
    "cecill": ("cecill", r"cecill(?: [bc])?", r"cecill(?: [bc]| [12] [01])?"),
    "ipl": ("ibm public", r"ibm public", r"ipl 1 0"),
    "latex": ("latex", r"latex project public", r"lppl 1 [0123][abc]?"),
    "upl": ("universal permissive", r"universal permissive", r"upl 1 0"),
    "blueoak": ("blue oak", r"blue oak model", r"blueoak 1 0 0"),
    "mulan": ("mulan", r"mulan (?:permissive|public) software", r"mulanpsl [12] 0"),
    "llama": ("llama", r"llama(?: [234])?(?: [123])?(?: community)?", r"llama [234]"),
    "openrail": ("open", r"(?:bigscience |creativeml )?open ?rail(?: m)?", r"openrail"),
    "proprietary": ("proprietary", r"proprietary", r"proprietary"),
    "proprietary/commercial": ("commercial", r"commercial", r"commercial"),
}
#: Parts of the Creative Commons licenses: label and words
COMMONS = {
    "cc-by": "by", "cc-by-sa": "by sa", "cc-by-nc": "by nc", "cc-by-nd": "by nd", "cc-by-nc-sa": "by nc sa", "cc-by-nc-nd": "by nc nd",
}
COMMONS_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ative works|atives|s)"}
#: label: (keyword, regular expression) of sentences from the licenses themselves
BODIES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribut", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name", r"neither the name (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache", "as is", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "redistribut", r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribut", r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribut", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|put|is|are) (?:in|into|to) the public domain"),
    ("public-domain", "no rights", r"no rights reserved"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("wtfpl", "what the", r"do what the (?:fuck|hell) you want to public license"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("proprietary", "all rights", r"all rights reserved"),
    ("proprietary", "permission", r"(?:no part of this|may not be reproduced)(?: [^ ]+){0,20} without (?:the )?(?:prior |express )?(?:written )?permission"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|redistribution)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited"),
]
VERSION = r"(?: (?:version|v|ver|v ?\d+) ?\d*(?: \d+){0,2}| \d+ \d+)"
LATER = r"(?: or (?:\(?at your option\)? )?(?:any )?later(?: version)?)?"
GRANT = r"(?:licensed|released|distributed|available|published|provided|redistributed|covered|made available|dual licensed)(?: [^ ]+){0,3} under(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: gnu)?"
LICENSE = r"(?: public)? (?:software )?licen[cs]e"
#: priority and weight of the forms a rule can have; a lower priority number is the stronger
IDENTIFIER, BODY, GRANTED, VERSIONED, NAMED, NOTICE = (1, 1.0), (1, 1.0), (1, 0.95), (2, 0.9), (2, 0.8), (3, 0.3)
LEVELS = 3


def rules() -> list[tuple[str, str, int, float, str, bool]]:
    """(label, keyword, priority, weight, regular expression, whether its places are base places) in order.

    An expression stands for whole words and never matches a word or gap outside them.
    """
    out = [(label, phrase, *NAMED, phrase, True) for phrase, label in BASE.items()]
    for family, (keyword, name, spdx) in FAMILIES.items():
        label = family.partition("/")[0]
        full = name if label in ("unlicense", "wtfpl", "beerware") else name + LICENSE
        out.append((label, "spdx", *IDENTIFIER, rf"spdx license identifier {spdx}", False))
        out.append((label, keyword, *GRANTED, rf"{GRANT} {full}{VERSION}?{LATER}", False))
        out.append((label, keyword, *VERSIONED, rf"{full}{VERSION}{LATER}", False))
        out.append((label, keyword, *NAMED, full, False))
        out.append((label, "opensource", *VERSIONED, rf"opensource org licenses {spdx}(?: php| html)?", False))
    for label, words in COMMONS.items():
        named = "(?: and)? ".join(COMMONS_NAMES[w] for w in words.split())
        version = r"(?: (?:1 0|2 0|2 1|2 5|3 0|4 0))?"
        keyword = "creative"
        out.append((label, "spdx", *IDENTIFIER, rf"spdx license identifier cc {words}{version}", False))
        out.append((label, "cc", *GRANTED, rf"{GRANT} (?:a )?(?:creative commons )?cc {words}{version}(?: licen[cs]e)?", False))
        out.append((label, keyword, *GRANTED, rf"{GRANT} (?:a )?creative commons {named}{version}(?: international| unported| generic)?(?: licen[cs]e)?", False))
        out.append((label, keyword, *VERSIONED, rf"creative ?commons org licenses {words}{version}", False))
        out.append((label, keyword, *NAMED, rf"creative commons {named}{version}(?: international| unported| generic)?", False))
        out.append((label, "cc", *NAMED, rf"cc {words}{version}", False))
    out += [(label, keyword, *BODY, text, False) for label, keyword, text in BODIES]
    out.append(("unknown", "licen", *NOTICE, rf"{GRANT}(?: [^ ]+){{0,4}} licen[cs]e", False))
    out.append(("unknown", "license", *NOTICE, r"(?:see|read|in|refer to)(?: the)? license(?: file| txt| md)?(?: for details| for more| for the full| in the project root)", False))
    return sorted(out, key=lambda r: r[2])  # stable: the order above within a priority


RULES = rules()


def _rule_table() -> Column:
    """Rules under their keyword, as a constant."""
    table: dict[str, list[dict]] = {}
    for number, (label, keyword, priority, weight, text, base) in enumerate(RULES):
        pattern = rf"(?<= )(?:{text})(?= )"
        rule = {"label": label, "priority": priority, "weight": weight, "pattern": pattern, "base": base, "number": number}
        table.setdefault(f" {keyword}", []).append(rule)
    kind = "array<struct<keyword string, rules array<struct<label string, priority int, weight double, pattern string, base boolean, number int>>>>"
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in table.items()])), kind)


def normal_words(text: Column) -> Column:
    """The words of a text in lower case, one space before, between and after them."""
    words = F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAPS, " "), F.lit(" "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def word_total(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def may_have_license(text: Column) -> Column:
    """True where a gate stands; what only A-Z in lower case shows, full lower case shows too."""
    low = F.lower(text)
    hit = F.lit(False)
    for gate in GATES:
        hit = hit | F.contains(low, F.lit(gate))
    return hit | F.rlike(low, F.lit(r"(?<![a-z0-9])cc(?![a-z0-9])"))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named; in a lambda it would be again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(norm: Column, rule: Column) -> Column:
    """Structs of first and last word of each match of a rule, in order."""
    marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit("\x01$0\x02")), " ")
    spots = F.transform(marked, lambda w, i: F.struct(i.alias("at"), F.startswith(w, F.lit("\x01")).alias("first"), F.endswith(w, F.lit("\x02")).alias("last")))
    return _with(F.filter(spots, lambda s: s["first"] | s["last"]), lambda ends: _spans(ends, rule))


def _spans(ends: Column, rule: Column) -> Column:
    first = F.transform(F.filter(ends, lambda s: s["first"]), lambda s: s["at"])
    last = F.transform(F.filter(ends, lambda s: s["last"]), lambda s: s["at"])
    return F.transform(
        F.arrays_zip(first.alias("a"), last.alias("z")),
        lambda p: F.struct(
            (p["a"] - 1).cast("bigint").alias("start"), (-p["z"]).cast("bigint").alias("back"), rule["priority"].alias("priority"),
            rule["number"].alias("number"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
        ),
    )


def _found(norm: Column) -> Column:
    """All places of all rules, by start, then the longer, the stronger and the earlier rule first."""

    def of(n: Column) -> Column:
        gated = F.filter(_rule_table(), lambda g: F.contains(n, g["keyword"]))
        tried = F.filter(F.flatten(F.transform(gated, lambda g: g["rules"])), lambda r: F.rlike(n, r["pattern"]))
        return F.array_sort(F.flatten(F.transform(tried, lambda r: _places(n, r))))

    return _with(norm, of)


def _reach(places: Column, level: Column) -> Column:
    """The furthest last word of places of at least this priority; -1 without any."""
    ends = F.transform(F.filter(places, lambda p: p["priority"] <= level), lambda p: -p["back"])
    return F.coalesce(F.array_max(ends), F.lit(-1).cast("bigint"))


def _standing(places: Column) -> Column:
    """``places`` without those inside another of the same or a stronger priority; they must be sorted."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(places) - 1) / RUN).cast("int")), lambda c: F.slice(places, c * RUN + 1, F.lit(RUN))
    )
    levels = F.sequence(F.lit(1), F.lit(LEVELS))
    none = F.array(*[F.lit(-1).cast("bigint")] * LEVELS)

    def before(runs: Column) -> Column:
        """What reaches furthest in the runs before each run."""
        reach = F.transform(runs, lambda run: F.transform(levels, lambda v: _reach(run, v)))
        further = lambda done, here: F.array(F.zip_with(F.element_at(done, -1), here, lambda a, b: F.greatest(a, b)))
        return F.aggregate(reach, F.array(none), lambda done, here: F.concat(done, further(done, here)))

    def stands(run: Column, place: Column, i: Column, reach: Column) -> Column:
        over = F.exists(F.slice(run, F.lit(1), i), lambda p: (p["priority"] <= place["priority"]) & (p["back"] <= place["back"]))
        return (F.element_at(reach, place["priority"]) < -place["back"]) & ~over

    def kept(runs: Column) -> Column:
        with_reach = F.arrays_zip(runs.alias("run"), F.slice(before(runs), F.lit(1), F.size(runs)).alias("reach"))
        return F.flatten(F.transform(with_reach, lambda x: F.filter(x["run"], lambda p, i: stands(x["run"], p, i, x["reach"]))))

    return _with(runs, kept)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__words`` (how many), ``__base`` (places of the base phrases) and ``__licenses``.

    Both are arrays of structs in the order of the text: start (number of the first word), last (that of the last
    word), label, priority, weight and rule. ``__base`` has every place of a base phrase; ``__licenses`` has the
    places of all rules that no other suppresses. A null text counts as empty; an
    empty one has no place. Rows are judged alone: repeated rows, ids and other
    columns do not matter. An empty table stays empty.
    """
    rows = docs.withColumn("__words", word_total(F.col(f"`{text}`")))
    rows = rows.withColumn("__norm", F.when(may_have_license(F.col(f"`{text}`")), normal_words(F.col(f"`{text}`"))))
    rows = rows.withColumn("__found", F.when(F.col("__norm").isNotNull(), _found(F.col("__norm"))))
    some = F.coalesce(F.size("__found") > 0, F.lit(False))

    def spans(places: Column) -> Column:
        return F.transform(places, lambda p: F.struct(
            p["start"].alias("start"), (-p["back"] - 1).alias("last"), p["label"].alias("label"), p["priority"].alias("priority"),
            p["weight"].alias("weight"), p["number"].alias("rule"),
        ))

    base = F.filter(F.col("__found"), lambda p: p["base"])
    kept = _standing(F.col("__found"))
    return rows.withColumn("__base", F.when(some, spans(base))).withColumn("__licenses", F.when(some, spans(kept))).drop("__norm", "__found")


def op11(spark, folder: str) -> DataFrame:
    """Words, base places and labels of every document; ``score`` is the greatest weight among what stands, 0 without any."""
    rows = scan(table(spark, folder, "documents").select("doc_id", "text"))
    starts = F.transform(F.col("__base"), lambda p: p["start"])
    base = F.transform(F.col("__base"), lambda p: p["label"])
    kept = F.transform(F.col("__licenses"), lambda p: p["label"])
    return rows.select(
        "doc_id", F.col("__words").alias("n_words"), F.when(F.col("__base").isNull(), F.lit(0)).otherwise(F.size("__base")).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.coalesce(_joined(base), F.lit("")).alias("base_labels"),
        F.coalesce(_joined(F.concat(base, kept)), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("__licenses"), lambda p: p["weight"])), F.lit(0.0)).alias("score"),
    )
