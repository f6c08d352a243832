"""License notices found by ordered signature rules.

A text becomes one line of its words, lower-cased in A-Z and set apart by single blanks. Rules are
regular expressions over that line, each with a priority, a label and keywords. Two prefilters keep
them off most texts: a text that holds the stems of no rule is not turned into a line at all, and a rule
runs only where one of its keywords is a word of the text. A detection that lies within a detection
of the same or a higher priority is suppressed (of equal spans the earlier rule stays). All of
this happens inside the row, so nothing is shuffled and a long text costs its own row only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtally.llm.tables import documents_of

# Phrases whose places are always reported, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Words of the contract: digits, a to z, and everything beyond ASCII (A to Z before lowering).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

class Rule(NamedTuple):
    priority: int  # 0 is the highest
    label: str
    keywords: tuple[str, ...]  # every match holds one of them as a word; without any the rule always runs
    pattern: str  # over words set apart by single blanks
    confidence: float
    # Every matching text holds one stem of each group in lower case, parts of words; without groups all
    # texts are looked at.
    stems: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()  # words of the text without which the rule does not hold


# label, words of which every name holds one, name as a pattern, version as a pattern ("" where there is none).
FAMILIES = (
    ("mit", "mit expat", "(?:mit|expat)", ""),
    ("mit-0", "mit", "mit (?:no attribution|0)", ""),
    ("x11", "x11", "x11", ""),
    ("isc", "isc", "isc", ""),
    ("zlib", "zlib", "zlib(?: libpng)?", ""),
    ("boost-1", "boost", "boost software", "1(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?", "1 1"),
    ("apache-2", "apache", "apache(?: software)?", "2(?: 0)?"),
    ("bsd-2-clause", "bsd freebsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)", ""),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", ""),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)", ""),
    ("bsd", "bsd", "bsd(?: style)?", ""),
    ("gpl-1", "gpl", "gpl", "v?1(?: 0)?"),
    ("gpl-2", "gpl", "gpl", "v?2(?: 0)?"),
    ("gpl-3", "gpl", "gpl", "v?3(?: 0)?"),
    ("gpl-2", "gnu", "gnu general public", "2(?: 0)?"),
    ("gpl-3", "gnu", "gnu general public", "3(?: 0)?"),
    ("gpl", "gnu", "gnu general public", ""),
    ("lgpl-2", "lgpl", "lgpl", "v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", "lgpl", "v?2 1"),
    ("lgpl-3", "lgpl", "lgpl", "v?3(?: 0)?"),
    ("lgpl-2.1", "gnu", "gnu (?:lesser|library) general public", "2 1"),
    ("lgpl-3", "gnu", "gnu (?:lesser|library) general public", "3(?: 0)?"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public", ""),
    ("agpl-3", "agpl", "agpl", "v?3(?: 0)?"),
    ("agpl-3", "affero", "gnu affero general public", "3(?: 0)?"),
    ("agpl", "affero", "gnu affero general public", ""),
    ("gfdl-1.2", "gnu", "gnu free documentation", "1 2"),
    ("gfdl-1.3", "gnu", "gnu free documentation", "1 3"),
    ("gfdl", "gnu", "gnu free documentation", ""),
    ("mpl-1.1", "mozilla", "mozilla public", "1 1"),
    ("mpl-2", "mozilla", "mozilla public", "2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public", ""),
    ("epl-1", "eclipse", "eclipse public", "1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public", "2(?: 0)?"),
    ("cddl-1", "cddl", "cddl", "1(?: [01])?"),
    ("cddl-1", "distribution", "common development and distribution", "1(?: [01])?"),
    ("cpl-1", "common", "common public", "1(?: 0)?"),
    ("eupl-1.1", "eupl", "eupl", "v? ?1 1"),
    ("eupl-1.2", "eupl", "eupl", "v? ?1 2"),
    ("eupl", "european", "european union public", ""),
    ("artistic-1", "artistic", "artistic", "1(?: 0)?"),
    ("artistic-2", "artistic", "artistic", "2(?: 0)?"),
    ("osl-3", "open", "open software", "3(?: 0)?"),
    ("afl-3", "academic", "academic free", "3(?: 0)?"),
    ("ofl-1.1", "sil", "sil open font", "1 1"),
    ("ofl", "sil", "sil open font", ""),
    ("ms-pl", "microsoft", "microsoft public", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("python-2", "python", "python(?: software foundation)?", "2(?: 0)?"),
    ("psf", "psf", "psf", ""),
    ("openssl", "openssl", "openssl", ""),
    ("php-3", "php", "php", "3(?: 0[01]?)?"),
    ("ruby", "ruby", "ruby", ""),
    ("vim", "vim", "vim", ""),
    ("w3c", "w3c", "w3c(?: software)?", ""),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ""),
    ("cecill-2", "cecill", "cecill", "2(?: [01])?"),
    ("bsl-1.1", "business", "business source", "1 1"),
    ("sspl-1", "sspl", "sspl", "v?1"),
    ("sspl-1", "server", "server side public", "1"),
    ("elastic-2", "elastic", "elastic", "2(?: 0)?"),
    ("odbl-1", "database", "open (?:data commons open )?database", "1(?: 0)?"),
    ("odc-by-1", "attribution", "open data commons attribution", "1(?: 0)?"),
    ("pddl-1", "pddl", "pddl", "1(?: 0)?"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", ""),
    ("beerware", "beerware", "beerware", ""),
)

CREATIVE = (
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no derivatives"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no derivatives"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
)

# Wordings of the licenses themselves: label, a rare word of the wording, the wording (a pattern over words).
WORDINGS = (
    # MIT and its kin
    ("mit-0", "furnished", "to whom the software is furnished to do so the software is provided as is"),
    ("mit", "furnished", "to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used"),
    ("x11", "advertising", "the names? of the above copyright holders? shall not be used in advertising"),
    ("boost-1", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1", "executable", "unless such copies or derivative works are solely in the form of machine executable object code"),
    ("isc", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software"),
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", "documentation", "permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("postgresql", "california", "in no event shall the university of california be liable to any party for direct indirect special incidental"),
    ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of(?: the)? unicode(?: s)? data files"),
    ("curl", "holder", "except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    # BSD
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse", "nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", "the name of the (?:author|copyright holder) may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "procurement", "procurement of substitute goods or services loss of use data or profits or business interruption however caused"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", "nuclear", "not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("apache-1.1", "foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "appear", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("php-3", "php", "products derived from this software may not be called php nor may php appear in their name"),
    ("ncsa", "restriction", "to deal with the software without restriction including without limitation the rights to use"),
    # Apache
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "patent", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2", "basis", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "distribution", "if the work includes a notice text file as part of its distribution"),
    # GPL family
    ("gpl-1", "gnu", "gnu general public license as published by the free software foundation(?: inc)? (?:either )?version 1"),
    ("gpl-2", "gnu", "gnu general public license as published by the free software foundation(?: inc)? (?:either )?version 2"),
    ("gpl-3", "gnu", "gnu general public license as published by the free software foundation(?: inc)? (?:either )?version 3"),
    ("gpl-2", "gnu", "gnu general public license version 2(?: 0)? as published by the free software foundation"),
    ("gpl-3", "gnu", "gnu general public license version 3(?: 0)? as published by the free software foundation"),
    ("gpl-2", "gnu", "version 2 of the gnu general public license"),
    ("gpl-3", "gnu", "version 3 of the gnu general public license"),
    ("lgpl-2", "gnu", "gnu (?:lesser|library) general public license as published by the free software foundation(?: inc)? (?:either )?version 2"),
    ("lgpl-2.1", "gnu", "gnu (?:lesser|library) general public license as published by the free software foundation(?: inc)? (?:either )?version 2 1"),
    ("lgpl-3", "gnu", "gnu (?:lesser|library) general public license as published by the free software foundation(?: inc)? (?:either )?version 3"),
    ("lgpl-2.1", "gnu", "version 2 1 of the gnu (?:lesser|library) general public license"),
    ("lgpl-3", "gnu", "version 3 of the gnu (?:lesser|library) general public license"),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation(?: inc)? (?:either )?version 3"),
    ("agpl-3", "affero", "version 3 of the gnu affero general public license"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", "gnu", "you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this"),
    ("gpl-2", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "verbatim", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("lgpl-2.1", "verbatim", "you may copy and distribute verbatim copies of the library s complete source code as you receive it in any medium"),
    ("gpl-3", "convey", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("agpl-3", "remotely", "prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl-3", "convey", "you may convey a covered work under sections 3 and 4 of this license without being bound by section 3"),
    ("classpath-exception", "executable", "permission to link this library with independent modules to produce an executable"),
    ("gcc-exception", "propagate", "permission to propagate a work of target code formed by combining the runtime library with independent modules"),
    ("gfdl", "invariant", "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gfdl-1.2", "gnu", "gnu free documentation license version 1 2 or any later version"),
    ("gfdl-1.3", "gnu", "gnu free documentation license version 1 3 or any later version"),
    # Mozilla, Eclipse and other file-wise licenses
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl", "contributor", "each contributor hereby grants you a world wide royalty free non exclusive license"),
    ("npl", "netscape", "the contents of this file are subject to the netscape public license"),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("epl", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl-1", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", "distribution", "subject to the terms of the common development and distribution license"),
    ("cpl-1", "common", "made available under the terms of the common public license v(?:ersion)? ?1 0"),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("eupl", "licensor", "the licensor hereby grants you a world wide royalty free non exclusive sub ?licensable licence"),
    ("artistic-1", "intent", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder"),
    ("artistic-2", "permitted", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("osl-3", "licensed", "licensed under the open software license version 3 0"),
    ("afl-3", "academic", "licensed under the academic free license version 3 0"),
    ("qpl-1", "distributed", "may be distributed under the terms of the q public license"),
    ("cecill-2", "cecill", "this software is governed by the cecill license under french law"),
    ("cecill-b", "cecill", "this software is governed by the cecill b license under french law"),
    ("cecill-c", "cecill", "this software is governed by the cecill c license under french law"),
    ("python-2", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("zpl-2.1", "zope", "this software is subject to the provisions of the zope public license version 2 1"),
    # Short permissive texts
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "relinquishment", "we intend this dedication to be an overt act of relinquishment in perpetuity"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("libpng", "png", "the png reference library is supplied as is"),
    ("w3c", "licensee", "by obtaining and or copying this work you the licensee agree that you have read understood and will comply"),
    ("fsf-all-permissive", "royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsf-unlimited", "foundation", "the free software foundation gives unlimited permission to copy and or distribute it"),
    ("public-domain", "dedicated", "to the extent possible under law the authors? (?:has|have) dedicated all copyright"),
    ("cc0", "waived", "(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("public-domain", "copyright", "the author disclaims copyright to this source code"),
    ("public-domain", "copyright", "this (?:file|work|software|code) is not subject to copyright protection"),
    # Creative Commons and data
    ("cc", "creative", "the work as defined below is provided under the terms of this creative commons public license"),
    ("cc", "creative", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc-by", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("odbl-1", "database", "this database is made available under the open database license"),
    ("odc-by-1", "database", "this database is made available under the open data commons attribution license"),
    ("pddl-1", "dedication", "made available under the public domain dedication and license"),
    ("ogl-uk-3", "sector", "contains public sector information licensed under the open government licence v3 0"),
    # Source available and proprietary
    ("bsl-1.1", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl-1", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", "commons clause license condition"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license 1 0 0"),
    ("polyform-small-business", "polyform", "polyform small business license 1 0 0"),
    ("llama", "llama", "llama (?:[23](?: [1-4])? )?community license agreement"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)? license"),
    ("proprietary", "proprietary", "this software is (?:the )?confidential and proprietary (?:information|property)"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", "no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", "permission", "may not be (?:reproduced|copied|published|redistributed) (?:in whole or in part |in any form |by any means ){0,2}without (?:the )?(?:prior )?(?:express )?written permission"),
)

# Exceptions that follow WITH in an SPDX expression, in words.
EXCEPTIONS = (
    ("classpath-exception", "classpath exception 2 0"),
    ("gcc-exception", "gcc exception (?:2 0|3 1)"),
    ("llvm-exception", "llvm exception"),
    ("linux-syscall-note", "linux syscall note"),
    ("autoconf-exception", "autoconf exception (?:2 0|3 0)"),
    ("bison-exception", "bison exception 2 2"),
    ("font-exception", "font exception 2 0"),
    ("openssl-exception", "openssl exception"),
)

LICENSE = "licen[cs]e"
GRANT = (f"(?:licen[cs]ed|released|distributed|available|published|provided) under "
         f"(?:the )?(?:terms of (?:the )?)?")
# Stems of tags and titles, and of grants.
NAMED = (("licen",),)
GRANTED = (("under",), ("licen", "released", "distributed", "available", "published", "provided"))


def _glued(words: tuple[str, ...], version: str) -> tuple[str, ...]:
    """The words, and what they become where a version follows without a blank (gpl2, gplv2)."""
    if not version:
        return words
    digit = re.search("[0-9]", version)[0]
    return words + tuple(word + end for word in words for end in ("v", digit, "v" + digit))


# Parts of words of which every wording holds one, apart from a few whose rare word serves.
COMMON_STEMS = ("licen", "copyright", "permi", "warrant", "redistribut")


def wording_rules() -> list[Rule]:
    """Openings, grants, conditions and disclaimers of the licenses' own texts. Every match holds the rare
    word."""
    rules = []
    for label, rare, wording in WORDINGS:
        plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)(?:\{[0-9,]*\}|\?)?", " ", wording)
        sure = re.findall("[a-z0-9]+(?![a-z0-9?])", plain)
        if rare not in sure:
            raise ValueError(f"not every match of {wording!r} holds {rare!r}")
        stem = next((stem for stem in COMMON_STEMS if any(stem in word for word in sure)), rare)
        rules.append(Rule(1, label, (rare,), wording, 0.9, ((stem,),)))
    return rules


def expression_rules() -> list[Rule]:
    """Operands of SPDX expressions after the first: an identifier's last word, AND or OR, the next identifier.
    Only in texts with a tag, and where the next words name a license, so that prose after a tag is left alone."""
    before = ("(?:[0-9]|clause|only|later|exception|note|mit|expat|isc|x11|zlib|unlicense|wtfpl|ncsa|vim|ruby|psf|openssl|"
              "postgresql|curl|gpl|lgpl|agpl|mpl|epl|cpl|eupl|osl|afl|ofl|sspl)")
    names = [(label, words.split(), name, version) for label, words, name, version in FAMILIES]
    names += [(label, ["cc"], f"cc {short}", "[1-4](?: [05])?") for label, short, _ in CREATIVE]
    names += [("cc0", ["cc0"], "cc0", "1 0")]
    rules = [
        Rule(0, label, _glued(tuple(words), version),
             f"{before} (?:or|and) {name} ?{version}(?: only| or later)?", 1.0, (("spdx",),), ("spdx",))
        for label, words, name, version in names
    ]
    return rules + [
        Rule(0, label, (wording.split()[0],), f"{before} with {wording}", 1.0, (("spdx",),), ("spdx",))
        for label, wording in EXCEPTIONS
    ]


def signature_rules() -> list[Rule]:
    """All rules, in order: tags, then wordings and grants, then titles, then names in passing."""
    rules: list[Rule] = [*expression_rules(), *wording_rules()]
    for label, words, name, version in FAMILIES:
        known = tuple(words.split())
        edition = f"(?: {LICENSE})?(?: version)? {version}" if version else f"(?: {LICENSE})?"
        rules += [
            Rule(0, label, _glued(known, version), f"spdx {LICENSE} identifier {name} ?{version}(?: only| or later)?", 1.0, NAMED),
            Rule(1, label, known, f"{GRANT}{name}{edition}(?: or (?:any )?later(?: version)?)?", 0.95,
                 GRANTED),
            Rule(2, label, known, f"{LICENSE} {name}{' ' + version if version else ''}", 0.8, NAMED),
            Rule(2, label, known,
                 f"{name} {LICENSE}(?: version)? {version}" if version else f"{name} {LICENSE}", 0.85, NAMED),
        ]
    for label, short, long in CREATIVE:
        edition = "(?: [1-4](?: [05])?)?"
        rules += [
            Rule(0, label, ("cc",), f"spdx {LICENSE} identifier cc {short}{edition}", 1.0, NAMED),
            Rule(1, label, ("cc",), f"{GRANT}(?:an? )?cc {short}{edition}", 0.95, GRANTED),
            Rule(1, label, ("creative",), f"{GRANT}(?:an? )?creative commons {long}{edition}", 0.95, GRANTED),
            Rule(2, label, ("creative",), f"creative commons {long}(?: {edition})?(?: {LICENSE})?", 0.85,
                 (("commons",),)),
            Rule(3, label, ("cc",), f"cc {short}{edition}", 0.7, (("cc",),)),
        ]
    rules += [
        Rule(0, "cc0", ("cc0",), f"spdx {LICENSE} identifier cc0(?: 1 0)?", 1.0, NAMED),
        Rule(1, "cc0", ("cc0",), f"{GRANT}cc0(?: 1 0)?", 0.95, GRANTED),
        Rule(2, "cc0", ("cc0",), "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", 0.85, (("cc0",),)),
        Rule(2, "public-domain", ("domain",), "(?:released into|dedicated to|placed in|in) the public domain", 0.8,
             (("domain",),)),
        Rule(2, "proprietary", ("reserved",), "all rights reserved", 0.6, (("rights",), ("reserved",))),
        Rule(3, "copyright-notice", ("copyright",), "copyright(?: c)?(?: by)? (?:19|20)[0-9]{2}", 0.4,
             (("copyright",),)),
        Rule(3, "unknown-license", ("license", "licence"), f"(?:{GRANT})(?:the |a |this )?{LICENSE}", 0.3,
             GRANTED),
    ]
    return rules


def _gate(text: Column, rules: list[Rule], phrases: Mapping[str, str]) -> Column:
    """False for texts that hold neither all stems of a rule nor the longest word of a phrase."""
    lowered = F.lower(text)

    def holds(group: tuple[str, ...]) -> Column:
        return reduce(or_, (F.contains(lowered, F.lit(stem)) for stem in group))

    groups = [(word,) for word in dict.fromkeys(max(p.split(), key=len) for p in phrases)]
    sought = dict.fromkeys([*((group,) for group in groups), *(rule.stems for rule in rules)])
    return reduce(or_, (reduce(and_, map(holds, stems), F.lit(True)) for stems in sought), F.lit(False))


def _rule_array(rules: list[Rule]) -> Column:
    """Rules as one literal, written as JSON since a column per field takes long to plan; a match is a
    place, not a stretch, so that matches may overlap."""
    kind = ("array<struct<priority:int,rule:int,label:string,keywords:array<string>,"
            "required:array<string>,confidence:double,pattern:string>>")
    fields = [
        {"priority": rule.priority, "rule": number, "label": rule.label, "keywords": rule.keywords,
         "required": rule.required, "confidence": rule.confidence, "pattern": f"(?<= )(?=({rule.pattern}) )"}
        for number, rule in enumerate(rules)
    ]
    return F.from_json(F.lit(json.dumps(fields)), kind)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(line: Column, pattern: Column) -> Column:
    """Word spans (start, stop) of all matches: text between matches gives the places, counted in
    blanks, and the captured text gives the lengths."""
    between = F.split(line, pattern, -1)
    matched = F.regexp_extract_all(line, pattern, F.lit(1))
    steps = F.zip_with(
        F.slice(between, 1, F.size(matched)), matched,
        lambda piece, match: F.struct(_blanks(piece).alias("skip"), (_blanks(match) + 1).alias("width")))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state: Column, one: Column) -> Column:
        blanks = state["blanks"] + one["skip"]
        span = F.struct((blanks - 1).alias("start"), (blanks - 1 + one["width"]).alias("stop"))
        return F.struct(blanks.alias("blanks"), F.concat(state["spans"], F.array(span)).alias("spans"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("blanks"), none.alias("spans")), step)
    return walked["spans"]


def _detections(line: Column, rules: Column) -> Column:
    def of_rule(rule: Column) -> Column:
        return F.transform(_spans(line, rule["pattern"]), lambda span: F.struct(
            span["start"].alias("start"), (-span["stop"]).alias("minus_stop"),
            rule["priority"].alias("priority"), rule["rule"].alias("rule"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    return F.flatten(F.transform(rules, of_rule))


def _unsuppressed(found: Column, priorities: int) -> Column:
    """In the order of start and falling stop a detection lies within an earlier one exactly if that
    one ends no sooner; the furthest stop per priority is all that has to be known."""
    kind = "array<struct<start:int,minus_stop:int,priority:int,rule:int,label:string,confidence:double>>"

    def step(state: Column, one: Column) -> Column:
        stop = -one["minus_stop"]
        inside = F.exists(
            F.slice(state["furthest"], F.lit(1), one["priority"] + 1), lambda reached: reached >= stop)
        furthest = F.transform(state["furthest"], lambda reached, at: F.when(
            at == one["priority"], F.greatest(reached, stop)).otherwise(reached))
        kept = F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(one)))
        return F.struct(furthest.alias("furthest"), kept.alias("kept"))

    start = F.struct(
        F.array_repeat(F.lit(0), priorities).alias("furthest"), F.array().cast(kind).alias("kept"))
    return F.aggregate(F.sort_array(found), start, step)["kept"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: Mapping[str, str] = BASE_PHRASES, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, places, detections, one row per row of `docs`.

    `places` are all places of the phrases (start, label), `detections` the rules' spans that were not
    suppressed (start, stop, rule, label, confidence), words counted from 0. A text that is missing
    or empty has no words and empty lists. Repeated rows give repeated rows, an empty table none;
    only the id and the text are looked at.
    """
    rules = signature_rules() if rules is None else rules
    known = _rule_array(rules)
    phrase_rules = _rule_array([Rule(0, label, (), re.escape(phrase).replace(r"\ ", " "), 1.0)
                                for phrase, label in phrases.items()])
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    words = F.regexp_extract_all(
        F.translate("text", capitals, capitals.lower()), F.lit(WORD), F.lit(0))
    lines = documents_of(docs, id_col, text_col).select(
        "doc_id",
        F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(_gate(F.col("text"), rules, phrases), words).alias("words"),
    )
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    every = dict.fromkeys(k for r in rules for k in (*r.keywords, *r.required))
    keywords = F.from_json(F.lit(json.dumps(list(every))), "array<string>")
    lines = lines.select(
        "doc_id", "n_words", F.when(F.size("words") > 0, line).alias("line"),
        F.array_intersect(keywords, F.col("words")).alias("keywords"))
    chosen = F.filter(known, lambda rule: (
        (F.size(rule["keywords"]) == 0) | F.arrays_overlap(rule["keywords"], F.col("keywords")))
        & (F.size(F.array_except(rule["required"], F.col("keywords"))) == 0))
    priorities = 1 + max((r.priority for r in rules), default=0)
    result = F.when(F.col("line").isNotNull(), F.struct(
        F.transform(F.sort_array(_detections(F.col("line"), phrase_rules)), lambda d: F.struct(
            d["start"].alias("start"), d["label"].alias("label"))).alias("places"),
        F.transform(_unsuppressed(_detections(F.col("line"), chosen), priorities), lambda d: F.struct(
            d["start"].alias("start"), (-d["minus_stop"]).alias("stop"), d["rule"].alias("rule"),
            d["label"].alias("label"), d["confidence"].alias("confidence"))).alias("detections"),
    ))
    places = "array<struct<start:int,label:string>>"
    spans = "array<struct<start:int,stop:int,rule:int,label:string,confidence:double>>"
    return lines.select("doc_id", "n_words", result.alias("found")).select(
        "doc_id", "n_words",
        F.coalesce("found.places", F.array().cast(places)).alias("places"),
        F.coalesce("found.detections", F.array().cast(spans)).alias("detections"),
    )


def summarize(scanned: DataFrame) -> DataFrame:
    """One row per scanned row: counts, first and last place, labels, and the surest detection's score."""
    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    starts, base = F.col("places.start"), F.col("places.label")
    return scanned.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("detections.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(
            F.coalesce(F.array_max("detections.confidence"), F.lit(0.0))).alias("score"),
    )
