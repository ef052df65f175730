"""Signature rules of the license scan.

A rule is a label, a priority, a confidence, keywords and a regular
expression. Expressions see a text as its lower-case words (runs of letters,
digits and non-ASCII characters) with one space between them, so "CC BY-NC
4.0" reads "cc by nc 4 0". A rule is tried only where one of its keywords is a
word of the text, so every match of its expression must hold one of them; a
keyword of several words below stands for its last one.
Priorities: 3 a notice or an identifier with its version, 2 a name, 1 a hint.
"""

from __future__ import annotations

NOTICE, NAME, HINT = 3, 2, 1
CONFIDENCE = {NOTICE: 1.0, NAME: 0.9, HINT: 0.5}

#: Phrases of the fixed part of the contract, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Keywords that stand for several words.
WORDS = {
    "licen": ("license", "licence", "licensed", "licenced", "licenses", "licences"),
    "gpl": ("gpl", "gplv1", "gplv2", "gplv3"), "lgpl": ("lgpl", "lgplv2", "lgplv3"), "agpl": ("agpl", "agplv1", "agplv3"),
    "beer": ("beer", "beerware"), "openrail": ("openrail", "rail"), "eupl": ("eupl",),
    "wtfpl": ("wtfpl", "wtfpl2", "wtfplv2", "wtfplver2", "wtfplversion2", "wtfplv", "wtfplver", "wtfplversion"),
    "copying": ("license", "licence", "copying"),
}

V = r"(?:,? ?v(?:ersion|er)?)? ?"
LIC = r"licen[cs]e"
OPEN = r"(?:licen[cs]ed|released|distributed|available|provided|published|dual licen[cs]ed) under (?:the )?(?:terms of (?:the )?)?"

#: label, keyword, expressions of notices and full names, expressions of short names.
_LICENSES = [
    ("mit", "mit", [OPEN + r"mit(?: " + LIC + r")?", r"the mit " + LIC, r"spdx " + LIC + r" identifier mit", r"mit expat " + LIC],
     [r"mit " + LIC + r"d?", r"mit x11 " + LIC]),
    ("mit", "expat", [], [r"expat " + LIC]),
    ("mit", "permission", [r"permission is hereby granted free of charge to any person obtaining a copy"], []),
    ("mit-0", "mit", [r"mit no attribution(?: " + LIC + ")?", r"spdx " + LIC + r" identifier mit 0"], [r"mit 0"]),
    ("x11", "x11", [r"x11 " + LIC, r"spdx " + LIC + r" identifier x11"], []),
    ("x11", "consortium", [], [r"x consortium " + LIC]),
    ("isc", "isc", [OPEN + r"isc(?: " + LIC + ")?", r"spdx " + LIC + r" identifier isc"], [r"isc " + LIC]),
    ("isc", "permission", [r"permission to use copy modify and or distribute this software for any purpose"], []),
    ("apache-1.0", "apache", [r"apache (?:software )?" + LIC + V + r"1 0", r"apache 1 0"], []),
    ("apache-1.1", "apache", [r"apache (?:software )?" + LIC + V + r"1 1", r"apache 1 1"], []),
    ("apache-2.0", "apache", [r"apache (?:software )?" + LIC + V + r"2(?: 0)?", r"spdx " + LIC + r" identifier apache 2 0",
                              r"apache v?2(?: 0)? " + LIC, r"apache org licenses " + LIC + " 2 0"],
     [r"apache v?2(?: 0)?"]),
    ("apache-2.0", "asl", [], [r"asl 2 0"]),
    ("apache-2.0", "apl", [], [r"apl 2 0"]),
    ("apache", "apache", [], [r"apache (?:software )?" + LIC, r"apache licensed"]),
    ("bsd-2-clause", "bsd", [r"(?:2|two) clause bsd(?: " + LIC + ")?", r"simplified bsd " + LIC,
                             r"spdx " + LIC + r" identifier bsd 2 clause"], [r"bsd 2(?: clause)?"]),
    ("bsd-2-clause", "freebsd", [r"freebsd " + LIC], []),
    ("bsd-3-clause", "bsd", [r"(?:3|three) clause bsd(?: " + LIC + ")?", r"(?:new|modified|revised) bsd " + LIC,
                             r"spdx " + LIC + r" identifier bsd 3 clause"], [r"bsd 3(?: clause)?"]),
    ("bsd-4-clause", "bsd", [r"(?:4|four) clause bsd(?: " + LIC + ")?", r"(?:original|old) bsd " + LIC], [r"bsd 4(?: clause)?"]),
    ("0bsd", "0bsd", [r"spdx " + LIC + r" identifier 0bsd"], [r"0bsd"]),
    ("0bsd", "zero", [r"bsd zero clause(?: " + LIC + ")?"], []),
    ("bsd", "bsd", [OPEN + r"(?:a )?bsd(?: style)?(?: " + LIC + ")?"], [r"bsd(?: style)? " + LIC]),
    ("bsd", "redistribution", [r"redistribution and use in source and binary forms with or without modification"], []),
    ("boost-1.0", "boost", [r"boost software " + LIC + V + r"1 0"], [r"boost (?:software )?" + LIC]),
    ("boost-1.0", "bsl", [r"spdx " + LIC + r" identifier bsl 1 0"], []),
    ("zlib", "zlib", [r"zlib libpng " + LIC, r"spdx " + LIC + r" identifier zlib"], [r"zlib " + LIC]),
    ("libpng", "png", [r"png reference library " + LIC], []),
    ("libpng", "libpng", [], [r"libpng " + LIC]),
    ("unlicense", "unlicense", [r"spdx " + LIC + r" identifier unlicense", OPEN + "unlicense"], [r"the unlicense"]),
    ("unlicense", "unencumbered", [r"free and unencumbered software released into the public domain"], []),
    ("wtfpl", "wtfpl", [r"wtfpl" + V + "2"], [r"wtfpl"]),
    ("public-domain", "public domain", [r"(?:released|placed|dedicated) (?:in|into|to) the public domain",
                                        r"this (?:work|file|software) is (?:in )?(?:the )?public domain"], [r"public domain dedication"]),
    ("cc0-1.0", "cc0", [r"cc0 1 0(?: universal)?", r"creative commons cc0(?: 1 0)?", r"spdx " + LIC + r" identifier cc0 1 0"], [r"cc0"]),
    ("cc0-1.0", "zero", [r"creative commons zero(?: v?1 0)?"], []),
    ("mpl-1.0", "mozilla", [r"mozilla public " + LIC + V + "1 0"], []),
    ("mpl-1.1", "mozilla", [r"mozilla public " + LIC + V + "1 1"], []),
    ("mpl-2.0", "mozilla", [r"mozilla public " + LIC + V + r"2(?: 0)?"], [r"mozilla public " + LIC]),
    ("mpl-2.0", "mpl", [r"mpl v?2(?: 0)?", r"spdx " + LIC + r" identifier mpl 2 0"], []),
    ("epl-1.0", "eclipse", [r"eclipse public " + LIC + V + "1 0"], [r"eclipse public " + LIC]),
    ("epl-2.0", "eclipse", [r"eclipse public " + LIC + V + r"2(?: 0)?"], []),
    ("epl-2.0", "epl", [r"epl v?2(?: 0)?", r"spdx " + LIC + r" identifier epl 2 0"], []),
    ("edl-1.0", "eclipse", [r"eclipse distribution " + LIC + V + "1 0"], [r"eclipse distribution " + LIC]),
    ("cddl-1.0", "development and distribution", [r"common development and distribution " + LIC + V + r"1(?: 0)?"],
     [r"common development and distribution " + LIC]),
    ("cddl-1.1", "cddl", [r"cddl v?1 1"], [r"cddl"]),
    ("cpl-1.0", "common public", [r"common public " + LIC + V + "1 0"], [r"common public " + LIC]),
    ("eupl-1.1", "european union public", [r"european union public " + LIC + V + "1 1"], []),
    ("eupl-1.2", "european union public", [r"european union public " + LIC + V + "1 2"], [r"european union public " + LIC]),
    ("eupl-1.2", "eupl", [r"eupl v?1 2"], [r"eupl"]),
    ("artistic-1.0", "artistic", [r"artistic " + LIC + V + r"1(?: 0)?"], [r"the artistic " + LIC, r"perl artistic " + LIC]),
    ("artistic-2.0", "artistic", [r"artistic " + LIC + V + r"2(?: 0)?"], []),
    ("perl", "same terms as perl", [r"same terms as perl(?: itself)?"], []),
    ("python-2.0", "python", [r"python software foundation " + LIC + r"(?:" + V + "2)?"], [r"python " + LIC]),
    ("python-2.0", "psf", [r"psf " + LIC], []),
    ("php-3.01", "php", [r"php " + LIC + V + r"3(?: 01)?"], [r"php " + LIC]),
    ("ruby", "ruby", [r"same terms as ruby"], [r"ruby " + LIC]),
    ("postgresql", "postgresql", [r"spdx " + LIC + r" identifier postgresql"], [r"postgresql " + LIC]),
    ("openssl", "openssl", [r"openssl and ssleay " + LIC + "s?"], [r"openssl " + LIC]),
    ("curl", "curl", [r"spdx " + LIC + r" identifier curl"], [r"curl " + LIC]),
    ("ftl", "freetype", [r"freetype project " + LIC], [r"freetype " + LIC]),
    ("ijg", "jpeg group", [r"independent jpeg group s? ?" + LIC], []),
    ("info-zip", "info zip", [r"info zip " + LIC], []),
    ("ncsa", "illinois", [r"university of illinois(?: ncsa)? open source " + LIC], []),
    ("ncsa", "ncsa", [], [r"ncsa (?:open source )?" + LIC]),
    ("ofl-1.1", "open font", [r"sil open font " + LIC + r"(?:" + V + "1 1)?"], [r"open font " + LIC]),
    ("ofl-1.1", "ofl", [r"ofl v?1 1"], [r"sil ofl"]),
    ("afl-3.0", "academic free", [r"academic free " + LIC + V + r"3(?: 0)?"], [r"academic free " + LIC]),
    ("osl-3.0", "open software", [r"open software " + LIC + V + r"3(?: 0)?"], [r"open software " + LIC]),
    ("ms-pl", "microsoft", [r"microsoft public " + LIC], []),
    ("ms-pl", "ms", [r"ms pl"], []),
    ("ms-rl", "microsoft", [r"microsoft reciprocal " + LIC], []),
    ("ms-rl", "ms", [r"ms rl"], []),
    ("upl-1.0", "universal permissive", [r"universal permissive " + LIC + r"(?:" + V + "1 0)?"], []),
    ("sleepycat", "sleepycat", [], [r"sleepycat(?: public)? " + LIC]),
    ("qpl-1.0", "q public", [r"q public " + LIC + V + "1 0"], [r"the q public " + LIC]),
    ("apsl-2.0", "apple public", [r"apple public source " + LIC + r"(?:" + V + "2(?: 0)?)?"], []),
    ("lppl-1.3c", "latex project", [r"latex project public " + LIC + r"(?:" + V + "1 3c?)?"], []),
    ("ipl-1.0", "ibm public", [r"ibm public " + LIC + r"(?:" + V + "1 0)?"], []),
    ("nposl-3.0", "non profit open", [r"non profit open software " + LIC], []),
    ("rpl-1.5", "reciprocal public", [r"reciprocal public " + LIC + r"(?:" + V + "1 5)?"], []),
    ("sspl-1.0", "server side public", [r"server side public " + LIC + r"(?:" + V + "1)?"], []),
    ("busl-1.1", "business source", [r"business source " + LIC + r"(?:" + V + "1 1)?"], []),
    ("elastic-2.0", "elastic", [r"elastic " + LIC + V + r"2(?: 0)?"], [r"elastic " + LIC]),
    ("commons-clause", "commons clause", [r"commons clause " + LIC + " condition"], [r"commons clause"]),
    ("polyform", "polyform", [r"polyform (?:noncommercial|shield|small business|strict) " + LIC], [r"polyform"]),
    ("json", "good not evil", [r"shall be used for good not evil"], []),
    ("beerware", "beer", [r"the beer ware " + LIC], [r"beerware"]),
    ("odbl-1.0", "open database", [r"open (?:data commons open )?database " + LIC + r"(?:" + V + "1 0)?"], []),
    ("odc-by-1.0", "open data commons", [r"open data commons attribution " + LIC], []),
    ("pddl-1.0", "dedication", [r"public domain dedication and " + LIC], []),
    ("ogl-uk-3.0", "open government", [r"open government " + LIC + V + r"3(?: 0)?"], [r"open government " + LIC]),
    ("gfdl-1.1", "free documentation", [r"gnu free documentation " + LIC + V + "1 1"], []),
    ("gfdl-1.2", "free documentation", [r"gnu free documentation " + LIC + V + "1 2"], []),
    ("gfdl-1.3", "free documentation", [r"gnu free documentation " + LIC + V + "1 3"], [r"(?:gnu )?free documentation " + LIC]),
    ("openrail", "openrail", [r"(?:bigscience|creativeml) open ?rail m?(?: " + LIC + ")?"], [r"openrail(?: m)?"]),
    ("llama", "llama", [r"llama (?:\d )?community " + LIC + "(?: agreement)?"], []),
    ("gpl-exception", "exception", [r"gcc runtime library exception", r"classpath exception", r"linking exception"], []),
    ("all-rights-reserved", "rights reserved", [], [r"all rights reserved"]),
    ("proprietary", "proprietary", [r"proprietary and confidential"], [r"proprietary " + LIC]),
    ("proprietary", "unauthorized", [r"unauthorized copying of this file"], []),
    ("copyright", "copyright", [r"copyright c \d{4}"], [r"copyright \d{4}", r"copyright by"]),
]

#: Expressions of texts that speak of a license without naming one.
_HINTS = [
    ("license-hint", "copying", r"see (?:the )?(?:file )?(?:licen[cs]e|copying)(?: file)?(?: for (?:more )?details)?"),
    ("license-hint", "licen", r"all licen[cs]es"), ("license-hint", "licen", r"spdx licen[cs]e identifier(?: \S+){1,3}"),
    ("license-hint", "licen", r"end user licen[cs]e agreement"), ("license-hint", "licen", r"released under the \S+ licen[cs]e(?: version(?: \d+){1,2})?"),
    ("license-hint", "licen", r"licen[cs]ed under the(?: \S+){1,6}? licen[cs]e(?: version(?: \d+){1,2})?"), ("license-hint", "licen", r"open source licen[cs]e"),
    ("license-hint", "licen", r"this licen[cs]e does not grant"),
]


def _gnu() -> list[tuple[str, int, str, str]]:
    """GNU licenses by kind and version: names, notices and short identifiers."""
    out = []
    kinds = [("gpl", "", ("1.0", "2.0", "3.0")), ("lgpl", "(?:lesser|library) ", ("2.0", "2.1", "3.0")), ("agpl", "affero ", ("1.0", "3.0"))]
    for short, word, versions in kinds:
        full = rf"(?:gnu )?{word}general public {LIC}"
        for version in versions:
            major, minor = version.split(".")
            number = major + (f" {minor}" if minor != "0" else "(?: 0)?")
            out += [(f"{short}-{version}", NOTICE, "general public", rf"{full}{V}{number}"),
                    (f"{short}-{version}", NOTICE, short, rf"(?:gnu )?{short}(?: |v| v){number}"),
                    (f"{short}-{version}-only", NOTICE, short, rf"{short} {number} only"),
                    (f"{short}-{version}-or-later", NOTICE, short, rf"{short} {number} or later"),
                    (f"{short}-{version}-or-later", NOTICE, "later version",
                     rf"{full}(?: as published by the free software foundation)? either version {number} of the licen[cs]e or at your option any later version")]
        out += [(short, NAME, "general public", full), (short, NAME, short, rf"(?:gnu )?{short} licen[cs]ed?")]
    return out


def _creative_commons() -> list[tuple[str, int, str, str]]:
    """Creative Commons licenses by elements and version."""
    out = []
    words = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?"}
    for elements in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = "cc-" + elements.replace(" ", "-")
        long = " ".join(words[e] for e in elements.split())
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            out += [(f"{label}-{version}", NOTICE, "cc", rf"cc {elements}(?: v)? ?{number}"),
                    (f"{label}-{version}", NOTICE, "creative commons", rf"creative commons {long} {number}(?: (?:international|unported|generic))?")]
        out += [(label, NAME, "cc", rf"cc {elements}(?: " + LIC + ")?"), (label, NAME, "creative commons", rf"creative commons {long}(?: " + LIC + ")?")]
    return out + [("cc", NAME, "creative commons", r"creative commons(?: " + LIC + ")?")]


def rules() -> list[dict]:
    """All rules in order: base phrases first."""
    own = [(label, NAME, phrase, phrase) for phrase, label in BASE]
    for label, keyword, notices, names in _LICENSES:
        own += [(label, NOTICE, keyword, r) for r in notices] + [(label, NAME, keyword, r) for r in names]
    own += _gnu() + _creative_commons() + [(label, HINT, keyword, r) for label, keyword, r in _HINTS]
    return [{"number": i, "label": label, "priority": priority, "confidence": CONFIDENCE[priority], "keywords": WORDS.get(keyword, (keyword.split()[-1],)),
             "base": i < len(BASE), "regex": f"(?<= )(?:{regex})(?= )"} for i, (label, priority, keyword, regex) in enumerate(own)]
