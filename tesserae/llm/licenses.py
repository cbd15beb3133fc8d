r"""License scans: ordered signature rules with DataFrame functions alone.

A text becomes its words in lower case, one space apart.  Texts without any rule
keyword go no further.  On the others, each rule whose keyword is there is run as
a regular expression; a detection inside another one of the same or a higher
priority is suppressed.  Labels are those of the detections that are left and of
the base phrases.

Null and empty texts have no words and no labels.  Repeated rows are scanned each
for itself, and very long texts whole.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import aside, lower_ascii

#: What is no part of a word, before and after A-Z turn into a-z.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int

    @property
    def stem(self) -> str:
        """What any text that the pattern matches has, after a space before its words: a long word, or how the pattern begins."""
        plain = re.sub(r".\?", " ", re.sub(r"\((?:\?:)?[^()]*\)\??|\[[^]]*\](?:\{[^}]*\}|[+*?])?", " ", self.pattern))
        longest = max(re.findall(r"[a-z0-9]+", plain), key=len)
        begun = re.match(r"[a-z0-9 ]*", self.pattern)[0]
        begun = begun[:-1] if self.pattern[len(begun) :].startswith("?") else begun
        return longest if len(longest) >= 5 or len(begun) < 3 else f" {begun}".rstrip()


def _family(label: str, keyword: str, *patterns: str, priority: int = 50) -> list[Signature]:
    """Patterns of one licence, the surest first: each one further down stands a step lower."""
    return [Signature(label, keyword if keyword in p else Signature(label, "", p, 0).stem.strip(), p, priority - k) for k, p in enumerate(patterns)]


_V = r"(?: version| v)? ?"
SIGNATURES: tuple[Signature, ...] = tuple(
    [
        # names with a version say more than names alone
        *_family("apache-2.0", "apache", rf"apache license{_V}2(?: 0)?", r"apache software license 2(?: 0)?", r"licensed under the apache license", r"apache 2(?: 0)? license", r"www apache org licenses license 2 0", r"spdx license identifier apache 2 0", priority=90),
        *_family("apache-1.1", "apache", rf"apache(?: software)? license{_V}1 1", r"apache 1 1 license", r"spdx license identifier apache 1 1", priority=90),
        *_family("apache-1.0", "apache", rf"apache(?: software)? license{_V}1 0", r"spdx license identifier apache 1 0", priority=90),
        *_family("apache", "apache", r"apache software foundation license", r"apache license", r"apache licence", r"apache style license", priority=40),
        *_family("mit", "mit", r"(?:the )?mit license(?: mit)?", r"mit licence", r"licensed under (?:the )?mit", r"under the terms of the mit license", r"spdx license identifier mit", r"mit licensed", r"dual licensed mit", r"license mit", r"mit expat license", r"mit x11 license", priority=60),
        *_family("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", r"the above copyright notice and this permission notice shall be included", r"the software is provided as is without warranty of any kind express or implied", priority=60),
        *_family("mit-0", "mit", r"mit no attribution", r"spdx license identifier mit 0", r"mit 0 license", priority=80),
        *_family("gpl-3.0", "general public", rf"gnu general public license{_V}3(?: 0)?", rf"general public license{_V}3", r"gnu general public license as published by the free software foundation either version 3", r"general public license version 3 or (?:any )?later", priority=90),
        *_family("gpl-3.0", "gpl", r"gpl ?v?3(?: 0)?(?: only| or later)?", r"spdx license identifier gpl 3 0", r"gnu gpl version 3", priority=88),
        *_family("gpl-2.0", "general public", rf"gnu general public license{_V}2(?: 0)?", rf"general public license{_V}2", r"gnu general public license as published by the free software foundation either version 2", r"general public license version 2 or (?:any )?later", priority=90),
        *_family("gpl-2.0", "gpl", r"gpl ?v?2(?: 0)?(?: only| or later)?", r"spdx license identifier gpl 2 0", r"gnu gpl version 2", priority=88),
        *_family("gpl-1.0", "gpl", r"gpl ?v?1(?: 0)?", r"spdx license identifier gpl 1 0", priority=88),
        *_family("gpl", "general public", r"gnu general public license", r"general public license", r"general public licence", priority=40),
        *_family("gpl", "gpl", r"gnu gpl", r"licensed under (?:the )?gpl", r"gpl license", r"gpl compatible", priority=35),
        *_family("lgpl-3.0", "lesser general", rf"(?:gnu )?lesser general public license{_V}3", priority=95),
        *_family("lgpl-3.0", "lgpl", r"lgpl ?v?3(?: 0)?", r"spdx license identifier lgpl 3 0", priority=94),
        *_family("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general public license{_V}2 1", priority=95),
        *_family("lgpl-2.1", "lgpl", r"lgpl ?v?2 1", r"spdx license identifier lgpl 2 1", priority=94),
        *_family("lgpl-2.0", "library general", rf"(?:gnu )?library general public license(?:{_V}2)?", priority=95),
        *_family("lgpl", "lesser general", r"(?:gnu )?lesser general public license", priority=70),
        *_family("lgpl", "lgpl", r"gnu lgpl", r"lgpl license", r"licensed under (?:the )?lgpl", priority=69),
        *_family("agpl-3.0", "affero", rf"(?:gnu )?affero general public license{_V}3", priority=95),
        *_family("agpl-3.0", "agpl", r"agpl ?v?3(?: 0)?", r"spdx license identifier agpl 3 0", priority=94),
        *_family("agpl", "affero", r"(?:gnu )?affero general public license", priority=70),
        *_family("agpl", "agpl", r"gnu agpl", r"agpl license", priority=69),
        *_family("bsd-3-clause", "bsd", r"bsd 3 clause(?: new or revised)? ?(?:license)?", r"3 clause bsd license", r"new bsd license", r"modified bsd license", r"revised bsd license", r"three clause bsd", r"spdx license identifier bsd 3 clause", priority=85),
        *_family("bsd-3-clause", "endorse", r"neither the name of [a-z0-9 ]{1,60} nor the names of its contributors may be used to endorse", priority=85),
        *_family("bsd-2-clause", "bsd", r"bsd 2 clause(?: simplified)? ?(?:license)?", r"2 clause bsd license", r"simplified bsd license", r"freebsd license", r"two clause bsd", r"spdx license identifier bsd 2 clause", priority=85),
        *_family("bsd-4-clause", "bsd", r"bsd 4 clause", r"original bsd license", r"four clause bsd", r"old bsd license", r"spdx license identifier bsd 4 clause", priority=85),
        *_family("bsd-0-clause", "bsd", r"zero clause bsd", r"0bsd license", r"spdx license identifier 0bsd", priority=85),
        *_family("bsd", "bsd", r"bsd license", r"bsd style license", r"bsd licence", r"licensed under (?:the )?bsd", r"berkeley software distribution license", priority=40),
        *_family("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice", priority=40),
        *_family("isc", "isc", r"isc license", r"isc licence", r"licensed under (?:the )?isc", r"spdx license identifier isc", priority=70),
        *_family("isc", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", priority=70),
        *_family("mpl-2.0", "mozilla", rf"mozilla public license{_V}2(?: 0)?", r"mozilla org mpl 2 0", priority=90),
        *_family("mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?", r"spdx license identifier mpl 2 0", priority=88),
        *_family("mpl-1.1", "mozilla", rf"mozilla public license{_V}1 1", priority=90),
        *_family("mpl-1.1", "mpl", r"mpl ?v?1 1", r"spdx license identifier mpl 1 1", priority=88),
        *_family("mpl-1.0", "mozilla", rf"mozilla public license{_V}1 0", priority=90),
        *_family("mpl", "mozilla", r"mozilla public license", r"mozilla public licence", priority=40),
        *_family("epl-2.0", "eclipse", rf"eclipse public license{_V}2(?: 0)?", priority=90),
        *_family("epl-2.0", "epl", r"epl ?v?2(?: 0)?", r"spdx license identifier epl 2 0", priority=88),
        *_family("epl-1.0", "eclipse", rf"eclipse public license{_V}1(?: 0)?", priority=90),
        *_family("epl-1.0", "epl", r"epl ?v?1(?: 0)?", r"spdx license identifier epl 1 0", priority=88),
        *_family("epl", "eclipse", r"eclipse public license", priority=40),
        *_family("edl-1.0", "eclipse", r"eclipse distribution license(?: v? ?1 0)?", priority=85),
        *_family("cddl-1.1", "cddl", r"cddl ?v?1 1", r"spdx license identifier cddl 1 1", priority=88),
        *_family("cddl-1.0", "cddl", r"cddl ?v?1 0", r"spdx license identifier cddl 1 0", priority=88),
        *_family("cddl", "common development", r"common development and distribution license", priority=60),
        *_family("cpl-1.0", "common public", r"common public license(?: version| v)? ?1(?: 0)?", r"common public license", priority=70),
        *_family("cpal-1.0", "common public", r"common public attribution license(?: version 1 0)?", priority=80),
        *_family("eupl-1.2", "european union", rf"european union public licen[cs]e{_V}1 2", priority=90),
        *_family("eupl-1.1", "european union", rf"european union public licen[cs]e{_V}1 1", priority=90),
        *_family("eupl", "european union", r"european union public licen[cs]e", priority=60),
        *_family("eupl", "eupl", r"licensed under (?:the )?eupl", r"eupl 1 [0-9]", priority=58),
        *_family("unlicense", "unlicense", r"the unlicense", r"spdx license identifier unlicense", r"unlicense org", priority=70),
        *_family("unlicense", "encumbered", r"free and unencumbered software released into the public domain", priority=70),
        *_family("wtfpl", "wtfpl", r"wtfpl", r"spdx license identifier wtfpl", priority=70),
        *_family("wtfpl", "what the", r"do what the f[a-z]{3} you want to public license", priority=75),
        *_family("zlib", "zlib", r"zlib license", r"zlib libpng license", r"spdx license identifier zlib", r"zlib licence", priority=70),
        *_family("zlib", "express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", priority=70),
        *_family("libpng", "libpng", r"libpng license", r"png reference library license", priority=65),
        *_family("bsl-1.0", "boost", r"boost software license(?: version| v)? ?1(?: 0)?", r"boost software license", r"www boost org license", priority=80),
        *_family("bsl-1.0", "bsl", r"spdx license identifier bsl 1 0", priority=80),
        *_family("busl-1.1", "business source", r"business source license(?: version| v)? ?1 1", r"business source license", priority=80),
        *_family("busl-1.1", "busl", r"spdx license identifier busl 1 1", priority=80),
        *_family("sspl-1.0", "server side", r"server side public license(?: version| v)? ?1?", priority=85),
        *_family("elastic-2.0", "elastic", rf"elastic license{_V}2(?: 0)?", r"elastic license", priority=75),
        *_family("artistic-2.0", "artistic", rf"artistic license{_V}2(?: 0)?", r"spdx license identifier artistic 2 0", priority=90),
        *_family("artistic-1.0", "artistic", rf"artistic license{_V}1(?: 0)?", r"spdx license identifier artistic 1 0", priority=90),
        *_family("artistic", "artistic", r"(?:the )?(?:clarified )?artistic license", r"same terms as perl itself", priority=50),
        *_family("perl", "perl", r"same terms as perl(?: 5)?(?: itself)?", r"perl license", priority=50),
        *_family("psf-2.0", "python", r"python software foundation license(?: version 2)?", r"psf license", r"python license", priority=70),
        *_family("php-3.01", "php", rf"php license{_V}3 01", r"php license", priority=70),
        *_family("ruby", "ruby", r"ruby license", r"same terms as ruby(?: itself)?", priority=60),
        *_family("vim", "vim", r"vim license", r"vim charityware", priority=60),
        *_family("w3c", "w3c", r"w3c software (?:notice and )?license", r"w3c license", priority=65),
        *_family("x11", "x11", r"x11 license", r"x consortium license", r"spdx license identifier x11", priority=62),
        *_family("openssl", "openssl", r"openssl license", r"openssl and ssleay license", priority=65),
        *_family("ofl-1.1", "font", r"sil open font license(?: version| v)? ?1 1", r"sil open font license", r"open font license", priority=80),
        *_family("ofl-1.1", "ofl", r"spdx license identifier ofl 1 1", priority=80),
        *_family("ipa", "ipa", r"ipa font license", priority=60),
        *_family("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database license(?: v? ?1 0)?", r"odc open database license", priority=80),
        *_family("odbl-1.0", "odbl", r"odbl(?: v? ?1 0)?", priority=75),
        *_family("odc-by-1.0", "attribution", r"open data commons attribution license(?: v? ?1 0)?", priority=80),
        *_family("pddl-1.0", "public domain", r"public domain dedication and license", priority=80),
        *_family("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?(?: license)?", r"creative commons zero", r"spdx license identifier cc0 1 0", priority=85),
        *_family("cc0-1.0", "zero", r"creative commons zero(?: v? ?1 0)?(?: universal)?", priority=85),
        *_family("cc-by-sa-4.0", "sharealike", r"creative commons attribution sharealike 4 0(?: international)?", priority=95),
        *_family("cc-by-sa-3.0", "sharealike", r"creative commons attribution sharealike 3 0(?: unported)?", priority=95),
        *_family("cc-by-sa", "sharealike", r"creative commons attribution sharealike", priority=75),
        *_family("cc-by-sa-4.0", "cc by", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0", priority=94),
        *_family("cc-by-sa-3.0", "cc by", r"cc by sa 3 0", priority=94),
        *_family("cc-by-sa", "cc by", r"cc by sa", priority=74),
        *_family("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?", priority=97),
        *_family("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?", priority=97),
        *_family("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?", priority=90),
        *_family("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?", priority=90),
        *_family("cc-by-4.0", "cc by", r"cc by 4 0", priority=88),
        *_family("cc-by-3.0", "cc by", r"cc by 3 0", priority=88),
        *_family("cc-by", "cc by", r"cc by license", r"licensed under cc by", priority=60),
        *_family("cc-by-nc-sa", "noncommercial", r"creative commons attribution noncommercial sharealike(?: [1-4] 0)?", priority=97),
        *_family("cc-by-nc-nd", "noncommercial", r"creative commons attribution noncommercial no ?derivatives(?: [1-4] 0)?", priority=97),
        *_family("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1-4] 0)?", priority=92),
        *_family("cc-by-nd", "derivatives", r"creative commons attribution no ?derivatives(?: [1-4] 0)?", priority=92),
        *_family("cc-by-4.0", "creative commons", r"creative commons attribution 4 0(?: international)?(?: license)?", priority=88),
        *_family("cc-by-3.0", "creative commons", r"creative commons attribution 3 0(?: unported)?(?: license)?", priority=88),
        *_family("cc-by-2.5", "creative commons", r"creative commons attribution 2 5(?: generic)?(?: license)?", priority=88),
        *_family("cc-by-2.0", "creative commons", r"creative commons attribution 2 0(?: generic)?(?: license)?", priority=88),
        *_family("cc", "creative commons", r"creative commons license", r"creative commons licence", r"creative commons attribution", r"under a creative commons", priority=30),
        *_family("cc", "creativecommons", r"creativecommons org licenses [a-z ]{2,12} [1-4] 0", r"creativecommons org publicdomain", priority=32),
        *_family("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"this work is in the public domain", r"public domain software", priority=30),
        *_family("gfdl-1.3", "documentation", rf"gnu free documentation license{_V}1 3", priority=90),
        *_family("gfdl-1.2", "documentation", rf"gnu free documentation license{_V}1 2", priority=90),
        *_family("gfdl", "documentation", r"gnu free documentation license", r"free documentation license", priority=60),
        *_family("ms-pl", "microsoft", r"microsoft public license", r"ms pl license", priority=70),
        *_family("ms-rl", "microsoft", r"microsoft reciprocal license", priority=70),
        *_family("apsl-2.0", "apple", rf"apple public source license(?:{_V}2(?: 0)?)?", priority=70),
        *_family("nposl", "non profit", r"non profit open software license(?: 3 0)?", priority=70),
        *_family("osl-3.0", "open software", rf"open software license{_V}3 0", r"open software license", priority=65),
        *_family("afl-3.0", "academic", rf"academic free license{_V}3 0", r"academic free license", priority=65),
        *_family("ecl-2.0", "educational", rf"educational community license{_V}2(?: 0)?", r"educational community license", priority=70),
        *_family("ncsa", "illinois", r"university of illinois ncsa open source license", r"illinois open source license", priority=70),
        *_family("ncsa", "ncsa", r"ncsa open source license", r"spdx license identifier ncsa", priority=68),
        *_family("upl-1.0", "universal permissive", r"universal permissive license(?: v? ?1 0)?", priority=70),
        *_family("mulan-2.0", "mulan", r"mulan (?:psl|permissive software license)(?: v? ?2)?", priority=70),
        *_family("blueoak-1.0", "blue oak", r"blue oak model license(?: 1 0 0)?", priority=70),
        *_family("beerware", "beer", r"the beer ware license", r"beerware license", priority=60),
        *_family("json", "good", r"the software shall be used for good not evil", priority=75),
        *_family("postgresql", "postgresql", r"postgresql licen[cs]e", priority=65),
        *_family("qpl-1.0", "q public", r"q public license(?: version 1 0)?", priority=65),
        *_family("sleepycat", "sleepycat", r"sleepycat license", priority=65),
        *_family("unicode", "unicode", r"unicode license(?: v3)?", r"unicode inc license agreement", priority=60),
        *_family("zpl-2.1", "zope", rf"zope public license(?:{_V}2 [01])?", priority=65),
        *_family("ncl", "nokia", r"nokia open source license", priority=60),
        *_family("rpl-1.5", "reciprocal", rf"reciprocal public license(?:{_V}1 5)?", priority=65),
        *_family("ijg", "jpeg", r"independent jpeg group license", priority=60),
        *_family("curl", "curl", r"curl license", r"spdx license identifier curl", priority=60),
        *_family("ftl", "freetype", r"freetype (?:project )?license", priority=60),
        *_family("hpnd", "historical", r"historical permission notice and disclaimer", priority=65),
        *_family("llvm", "llvm", r"llvm exceptions?", r"apache 2 0 with llvm exceptions?", priority=92),
        *_family("classpath-exception", "classpath", r"classpath exception(?: 2 0)?", r"gpl with classpath exception", priority=60),
        *_family("llama", "llama", r"llama [234](?: [0-9])? community license(?: agreement)?", r"llama community license", priority=70),
        *_family("openrail", "rail", r"(?:creative ml |bigscience )?open ?rail(?: m)?(?: license)?", priority=65),
        *_family("gemma", "gemma", r"gemma terms of use", priority=60),
        *_family("proprietary", "proprietary", r"proprietary (?:software )?license", r"proprietary and confidential", r"this software is proprietary", priority=30),
        *_family("commercial", "commercial", r"commercial license(?: agreement)?", r"not for commercial use", r"non commercial use only", priority=25),
        *_family("all-rights-reserved", "rights", r"all rights reserved", priority=20),
        *_family("eula", "end user", r"end user licen[cs]e agreement", priority=30),
        *_family("shareware", "shareware", r"shareware license", priority=25),
        *_family("freeware", "freeware", r"freeware license", priority=25),
        *_family("spdx", "spdx", r"spdx license identifier [a-z0-9]+(?: [0-9]){0,2}", r"spdx filecopyrighttext", priority=15),
        *_family("see-license", "license", r"see (?:the )?license(?: file)?(?: for details)?", r"license file for (?:more )?details", r"subject to the license", r"this license applies", r"terms of (?:the|this) license", priority=10),
        *_family("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", r"copyright notice", priority=5),
    ]
)


def words_text(text: Column) -> Column:
    """The words of a text, one space apart."""
    return F.trim(F.regexp_replace(text, NO_WORD, " "))


def _places(words: Column, pattern: Column) -> Column:
    """array<struct<start, end>> in characters of the words' text: leftmost matches on word bounds, without overlap."""
    whole = F.concat(F.lit(r"\G(.*?)((?<![^ ])(?:"), pattern, F.lit(r")(?![^ ]))"))
    steps = F.arrays_zip(F.regexp_extract_all(words, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(words, whole, F.lit(2)).alias("found"))
    kind = "array<struct<start:int,end:int>>"

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).cast(kind).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])


def _detections(words: Column, signatures: tuple[Signature, ...]) -> Column:
    """All detections of the rules whose keyword is there, then those left after suppression."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rules = F.expr("array(" + ", ".join(f"named_struct('label', {quoted(s.label)}, 'keyword', {quoted(s.keyword)}, 'pattern', {quoted(s.pattern)}, 'priority', {s.priority})" for s in signatures) + ")")
    asked = F.filter(rules, lambda r: F.contains(words, r["keyword"]))
    found = F.flatten(F.transform(asked, lambda r: F.transform(_places(words, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["label"].alias("label")))))
    kind = "array<struct<start:int,minus_end:int,minus_priority:int,label:string>>"

    def step(state: Column, d: Column) -> Column:
        inside = (-d["minus_end"] <= state["end"]) & (-d["minus_priority"] <= state["priority"])
        further = -d["minus_end"] > state["end"]
        return F.struct(
            F.when(further, -d["minus_end"]).otherwise(state["end"]).alias("end"),
            F.when(further, -d["minus_priority"]).otherwise(state["priority"]).alias("priority"),
            F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).cast(kind).alias("kept"),
        )

    begin = F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("priority"), F.array().cast(kind).alias("kept"))
    return F.aggregate(F.array_sort(found), begin, step, lambda s: s["kept"])


def detect(df: DataFrame, text_column: str = "text", signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """df with n_words long and detections array<struct<start, end, first_word, words, label, priority>>.

    start and end: in characters of the text's words one space apart. Starts come in order, the widest first.
    Columns of df called n_words or detections are replaced; others keep their names and values.
    """
    made = ("n_words", "detections")
    df = df.drop(*[c for c in df.columns if c.lower() in made and c != text_column])
    df, new, back = aside(df, ("_plain", "_low", "_words", "_found", *made))
    return back(_detected(df, new[text_column], signatures).drop("_words"))


def _detected(df: DataFrame, text_column: str, signatures: tuple[Signature, ...]) -> DataFrame:
    """As detect, with the lower-case words of texts that have a keyword in _words."""
    rows = df.withColumn("_plain", words_text(F.coalesce(F.col(text_column), F.lit(""))))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    rows = rows.withColumn("n_words", F.when(F.col("_plain") == "", F.lit(0)).otherwise(spaces(F.col("_plain")) + 1).cast("long"))
    # the prefilter: lower() maps more than A-Z, which can only let more texts pass
    rows = rows.withColumn("_low", F.concat(F.lit(" "), F.lower("_plain")))
    gate = reduce(Column.__or__, (F.contains("_low", F.lit(x)) for x in sorted({s.stem for s in signatures})))
    rows = rows.withColumn("_words", F.when(gate, lower_ascii(F.col("_plain")))).drop("_low", "_plain")
    words, none = F.col("_words"), F.array().cast("array<struct<start:int,minus_end:int,minus_priority:int,label:string>>")
    rows = rows.withColumn("_found", F.when(words.isNotNull(), _detections(words, signatures)).otherwise(none))
    told = F.transform(
        "_found",
        lambda d: F.struct(
            d["start"].alias("start"), (-d["minus_end"]).alias("end"), spaces(F.substring(words, F.lit(1), d["start"])).alias("first_word"),
            (spaces(F.substring(words, d["start"] + 1, -d["minus_end"] - d["start"])) + 1).alias("words"), d["label"].alias("label"), (-d["minus_priority"]).alias("priority"),
        ),
    )
    return rows.withColumn("detections", told).drop("_found")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of documents.

    score: the part of a text's words that lie in kept detections, at most 1.
    """
    rows = _detected(df.select("doc_id", "text"), "text", SIGNATURES)
    words = F.col("_words")
    base = F.lit("|".join(BASE))
    begun = F.when(words.contains("license"), _places(words, base)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    word = lambda p: (F.length(F.substring(words, F.lit(1), p["start"])) - F.length(F.replace(F.substring(words, F.lit(1), p["start"]), F.lit(" ")))).cast("long")
    named = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))
    rows = rows.withColumn("_base", begun)
    rows = rows.withColumn("_at", F.array_sort(F.transform("_base", word))).withColumn("_base_labels", F.array_sort(F.array_distinct(F.transform("_base", lambda p: F.element_at(named, F.substring(words, p["start"] + 1, p["end"] - p["start"]))))))
    labels = F.array_sort(F.array_union("_base_labels", F.transform("detections", lambda d: d["label"])))
    covered = F.aggregate("detections", F.lit(0).cast("bigint"), lambda s, d: s + d["words"])
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.try_element_at("_at", F.lit(1)).alias("first_word"), F.try_element_at("_at", F.lit(-1)).alias("last_word"),
        F.array_join("_base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), covered / F.greatest(F.col("n_words"), F.lit(1))).alias("score"),
    )
