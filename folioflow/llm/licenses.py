"""License and copyright statements by ordered signature rules, in DataFrame functions only.

A text is reduced to its words: ASCII letters in lower case, digits and all other characters beyond ASCII, one blank
between words. A few short stems, looked for first, decide whether any rule can match; then each rule's own
keyword decides whether its regular expression is tried. A match is an interval of words. Of overlapping
matches, one goes if another of higher priority (a lower number), or a longer one of the same, contains it.

Base phrases are counted apart from the rules; nothing suppresses them.

Everything stays in the row: no shuffle, no Python. The work for a text grows with its length and its matches.

Defined results: null and empty texts have no words and no labels (empty strings), null places and score 0; texts of any length
are scanned whole; of matches with equal places and priority the one whose label comes first stays; repeated rows are scanned each for itself;
an empty table gives no rows; other columns are kept, those called ``n_words``, ``base`` or ``detections`` are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases, in words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Names of licenses in words. Label, keyword that every match holds, the name's expression.
NAMES = [
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?(?:2 0|2|v2 0|v2)"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit", "mit", r"(?:mit|mit x11|x11 mit) (?:style )?licen[cs]e"),
    ("mit", "expat", r"expat (?:style )?licen[cs]e"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?"),
    ("0bsd", "bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd (?:style |type |like )?licen[cs]e"),
    ("isc", "isc licen", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("agpl-3.0", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e (?:version |v )?(?:3 0|3|v3)"),
    ("agpl", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?(?:agpl 3 0|agpl 3|agplv3|agpl v3)"),
    ("lgpl-2.1", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1"),
    ("lgpl-3.0", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?(?:3 0|3|v3)"),
    ("lgpl-2.0", "library general public licen", r"(?:gnu )?library general public licen[cs]e(?: (?:version |v )?(?:2 0|2))?"),
    ("lgpl", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?(?:lgpl 2 1|lgplv2 1|lgpl v2 1)"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?(?:lgpl 3 0|lgpl 3|lgplv3|lgpl v3)"),
    ("gpl-1.0", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v )?(?:1 0|1|v1)"),
    ("gpl-2.0", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v )?(?:2 0|2|v2)"),
    ("gpl-2.0-or-later", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v )?(?:2 0|2|v2) or (?:\(?at your option\)? )?(?:any )?later(?: version)?"),
    ("gpl-3.0", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v )?(?:3 0|3|v3)"),
    ("gpl-3.0-or-later", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v )?(?:3 0|3|v3) or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?(?:gpl 2 0|gpl 2|gplv2|gpl v2)"),
    ("gpl-3.0", "gpl", r"(?:gnu )?(?:gpl 3 0|gpl 3|gplv3|gpl v3)"),
    ("gnu-gpl", "gnu", r"gnu general public licen[cs]e"),
    ("gfdl-1.3", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e (?:version |v )?1 3"),
    ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla public licen", r"mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla public licen", r"mozilla public licen[cs]e (?:version |v )?2 0"),
    ("mpl", "mozilla public licen", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse public licen", r"eclipse public licen[cs]e (?:version |v )?1 0"),
    ("epl-2.0", "eclipse public licen", r"eclipse public licen[cs]e (?:version |v )?2 0"),
    ("epl", "eclipse public licen", r"eclipse public licen[cs]e"),
    ("eupl-1.2", "european union public licen", r"european union public licen[cs]e(?: (?:version |v )?1 2)?"),
    ("cddl-1.0", "common development and distribution licen", r"common development and distribution licen[cs]e(?: (?:version |v )?1 0)?"),
    ("cpl-1.0", "common public licen", r"common public licen[cs]e(?: (?:version |v )?1 0)?"),
    ("artistic-2.0", "artistic licen", r"artistic licen[cs]e (?:version |v )?2 0"),
    ("artistic", "artistic licen", r"(?:perl )?artistic licen[cs]e"),
    ("bsl-1.0", "boost software licen", r"boost software licen[cs]e(?: (?:version |v )?1 0)?"),
    ("ms-pl", "microsoft public licen", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal licen", r"microsoft reciprocal licen[cs]e"),
    ("psf-2.0", "python software foundation licen", r"python software foundation licen[cs]e(?: (?:version |v )?2)?"),
    ("php-3.0", "php licen", r"php licen[cs]e(?: (?:version |v )?3 0\d?)?"),
    ("ruby", "ruby licen", r"ruby licen[cs]e"),
    ("openssl", "openssl licen", r"openssl licen[cs]e"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("w3c", "w3c", r"w3c (?:software (?:notice and )?)?licen[cs]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("ofl-1.1", "open font licen", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?"),
    ("odbl-1.0", "open database licen", r"open database licen[cs]e(?: (?:version |v )?1 0)?"),
    ("odc-by-1.0", "open data commons attribution licen", r"open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?"),
    ("pddl-1.0", "public domain dedication and licen", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("ogl-uk", "open government licen", r"open government licen[cs]e(?: (?:version |v )?\d 0)?"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail (?:m )?licen[cs]e"),
    ("openrail", "responsible ai", r"(?:creativeml |bigscience )?responsible ai (?:m )?licen[cs]e"),
    ("llama-community", "community licen", r"llama (?:\d )*community licen[cs]e"),
    ("busl-1.1", "business source licen", r"business source licen[cs]e(?: (?:version |v )?1 1)?"),
    ("sspl-1.0", "server side public licen", r"server side public licen[cs]e(?: (?:version |v )?1)?"),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-plain", "cc by", r"cc by(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?(?: international)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: international)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?(?: international)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: international)?"),
    ("cc-by-plain", "creative commons", r"creative commons attribution(?: [1-4] 0)?(?: international)?"),
    ("creative-commons", "creative commons", r"creative commons(?: licen[cs]e)?"),
]

#: Ways to state a license by its name: priority, confidence, words before, words after.
FORMS = [
    (1, 0.95, r"(?:licen[cs]ed|released|distributed|available|provided|published|offered|covered|shared|made available|redistributed) "
              r"(?:under|by|on|according to|subject to|pursuant to) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?", r"(?: licen[cs]e)?"),
    (2, 0.85, r"(?:see|read|use|under|accept|terms of|copy of|conditions of) (?:the )?(?:terms of )?(?:the )?", r"(?: for (?:more )?details)?"),
    (3, 0.75, "", ""),
]

#: Ids after "SPDX-License-Identifier:", as words.
SPDX = """apache 2 0|mit|mit 0|bsd 2 clause|bsd 3 clause|0bsd|isc|zlib|gpl 2 0 only|gpl 2 0 or later|gpl 3 0 only|gpl 3 0 or later|lgpl 2 1 only|lgpl 2 1 or later
lgpl 3 0 only|lgpl 3 0 or later|agpl 3 0 only|agpl 3 0 or later|mpl 2 0|epl 1 0|epl 2 0|eupl 1 2|cddl 1 0|artistic 2 0|bsl 1 0|ms pl|psf 2 0|unlicense|wtfpl|cc0 1 0
cc by 4 0|cc by sa 4 0|cc by nc 4 0|cc by nd 4 0|cc by nc sa 4 0|cc by nc nd 4 0|ofl 1 1|odbl 1 0|pddl 1 0|postgresql|busl 1 1|sspl 1 0""".replace("\n", "|").split("|")

#: Other statements: label, keyword, expression, priority, confidence.
OTHERS = [
    ("url-apache-2.0", "apache org licenses", r"(?:www )?apache org licenses license 2 0(?: html| txt)?", 0, 0.95),
    ("url-mit", "opensource org licenses mit", r"opensource org licenses mit(?: license)?(?: php| html)?", 0, 0.95),
    ("url-bsd", "opensource org licenses bsd", r"opensource org licenses bsd(?: \d clause| license)?(?: php| html)?", 0, 0.95),
    ("url-gpl", "gnu org licenses", r"(?:www )?gnu org licenses (?:old licenses )?a?l?gpl(?: \d \d)?(?: html| txt)?", 0, 0.95),
    ("url-mpl", "mozilla org mpl", r"(?:www )?mozilla org mpl(?: \d \d)?", 0, 0.95),
    ("url-cc", "creativecommons org licenses", r"creativecommons org licenses by(?: nc| nd| sa)*(?: \d \d)?", 0, 0.95),
    ("url-cc0", "creativecommons org publicdomain", r"creativecommons org publicdomain (?:zero|mark)(?: \d \d)?", 0, 0.95),
    ("url-unlicense", "unlicense org", r"unlicense org", 0, 0.9),
    ("mit-text", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0, 0.95),
    ("isc-text", "permission to use copy modify", r"permission to use copy modify and or distribute this software", 0, 0.9),
    ("bsd-text", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?", 0, 0.95),
    ("gpl-text", "this program is free software", r"this program is free software(?: you can redistribute it and or modify it)?", 0, 0.9),
    ("unlicense-text", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 0, 0.95),
    ("warranty-disclaimer", "warrant", r"(?:without (?:any )?warrant(?:y|ies)(?: of any kind)?|provided as is without warranty)", 4, 0.4),
    ("copyright-year", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 3, 0.6),
    ("copyright-by", "copyright", r"copyright by", 4, 0.5),
    ("copyright-holder", "copyright", r"(?:the )?copyright (?:holders?|owners?)", 4, 0.4),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 3, 0.6),
    ("some-rights-reserved", "rights reserved", r"some rights reserved", 3, 0.6),
    ("no-rights-reserved", "rights reserved", r"no rights reserved", 3, 0.6),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 3, 0.7),
    ("public-domain", "public domain", r"public domain(?: mark| work| dedication)", 3, 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 3, 0.7),
    ("proprietary", "proprietary", r"proprietary licen[cs]e", 3, 0.7),
    ("no-reproduction", "may be reproduced", r"no part of this (?:publication|work|book|document|site) may be reproduced", 3, 0.7),
    ("no-redistribution", "distribut", r"(?:do not|may not be|not to be) (?:re ?)?distributed?", 4, 0.5),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial use only", 3, 0.6),
    ("terms-of-service", "terms of", r"terms of (?:service|use) apply", 4, 0.4),
    ("license-file", "licen", r"see (?:the )?licen[cs]e(?: txt| md)? file", 4, 0.4),
    ("licensed", "licen", r"licen[cs]ed (?:under|to)", 5, 0.3),
]

#: Sentences of license texts, grants, conditions and notices: label, keyword, expression. They count as much as a name in a grant.
SENTENCES = [
    ("apache-2.0", "compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "distributed under the licen", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("apache-2.0", "language governing permission", r"see the licen[cs]e for the specific language governing permissions and limitations"),
    ("apache-2.0", "irrevocable copyright licen", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache-2.0", "patent licen", r"(?:irrevocable )?(?:except as stated in this section )?patent licen[cs]e to make have made use offer to sell"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies"),
    ("mit", "copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", "written permission", r"be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("isc", "copyright notice and this permission notice appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "all warranties with regard", r"the author disclaims all warranties with regard to this software"),
    ("zlib", "implied warrant", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("gpl", "terms of the gnu general public licen", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl-2.0-or-later", "either version 2 of the licen", r"either version 2 of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "either version 3 of the licen", r"either version 3 of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl", "useful but without any warrant", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "received a copy of the gnu", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("lgpl", "work that uses the library", r"a program that contains no derivative of any portion of the library .{1,120}? is called a work that uses the library"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of"),
    ("mpl-2.0", "mozilla public licen", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-1.1", "mozilla public licen", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("epl", "eclipse public licen", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl-1.0", "common development and distribution licen", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("eupl-1.2", "european union public licen", r"this work is (?:licensed|provided) under the terms of (?:this|the) european union public licen[cs]e"),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("artistic", "standard version", r"you may (?:distribute|make and give away) verbatim copies of the (?:source form of the )?standard version"),
    ("psf-2.0", "python software foundation", r"this licen[cs]e agreement is between the python software foundation"),
    ("php-3.0", "includes php software", r"this product includes php software freely available from"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("w3c", "copying this work you the licen", r"by obtaining (?:using )?and or copying this work you the licen[cs]ee agree"),
    ("wtfpl", "you want to public licen", r"do what the \S+ you want to public licen[cs]e"),
    ("unlicense", "dedicate any and all copyright", r"the author or authors of this software dedicate any and all copyright interest"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "dedicated the work to the public domain", r"dedicated the work to the public domain"),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font names?"),
    ("ofl-1.1", "reserved font name", r"with reserved font names?"),
    ("odbl-1.0", "database are licen", r"any rights in individual contents of the database are licen[cs]ed under"),
    ("ogl-uk", "public sector information licen", r"contains public sector information licen[cs]ed under"),
    ("creative-commons", "substitute for the licen", r"this is a human readable summary of and not a substitute for the licen[cs]e"),
    ("creative-commons", "exercising the licen", r"by exercising the licen[cs]ed rights you accept and agree to be bound by"),
    ("cc-by-plain", "link to the licen", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", "under the same licen", r"you must distribute your contributions under the same licen[cs]e as the original"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("busl-1.1", "licensor may make", r"(?:the )?licensor may make an additional use grant"),
    ("sspl-1.0", "terms of", r"service source code under the terms of (?:this|the server side public) licen[cs]e"),
    ("elastic-2.0", "limitations of the licen", r"provide the software to third parties as a hosted or managed service (?:\S+ ){0,20}?limitations of the licen[cs]e"),
    ("commons-clause", "grant of rights under the licen", r"the grant of rights under the licen[cs]e will not include .{1,80}? right to sell the software"),
    ("openrail", "copyright and use based", r"copyright and use based restrictions (?:as )?(?:set forth|referenced|contained) in"),
    ("llama-community", "must request a licen", r"greater than 700 million monthly active users .{1,80}? must request a licen[cs]e"),
    ("proprietary", "copyright law", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|software|document|material|work) (?:\S+ ){0,12}?copyright laws?"),
    ("proprietary", "proprietary", r"contains (?:confidential and )?proprietary (?:information and )?trade secrets"),
    ("all-rights-reserved", "rights reserved", r"all (?:other |international )?rights reserved worldwide"),
    ("no-reproduction", "prior written permission", r"without (?:the )?(?:express )?prior written permission of the (?:publisher|author|copyright (?:holder|owner))s?"),
    ("non-commercial", "commercial use only", r"for personal (?:and )?non ?commercial use only"),
    ("fair-use", "copyright disclaimer", r"copyright disclaimer under section 107 of the copyright act"),
    ("crown-copyright", "crown copyright", r"(?:this is )?crown copyright(?: material)?(?: (?:19|20)\d\d)?"),
    ("eula", "end user licen", r"(?:this )?end user licen[cs]e agreement"),
]

#: One of these stands in every keyword.
STEMS = ["licen", "copyright", "reserved", "cc by", "creative", "gpl", "apache", "mit ", "bsd", "gnu", "spdx", "public domain", "warrant", "permission",
         "redistribution", "distribut", "proprietary", "cc0", "libpng", "wtfpl", "w3c", "zlib", "rail", "expat", "responsible ai", "commons clause", "reproduced", "commercial",
         "free software", "unencumbered", "terms of", "opensource org", "mozilla org", "misrepresented", "altered source", "advertising materials", "remotely", "uses the library",
         "invariant sections", "standard version", "python software", "php software", "openssl toolkit"]

#: Priorities run from 0 to one less than this.
LEVELS = 6


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    expression: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """Hundreds of rules in order: ids, addresses and texts, then names in each form."""
    out = [Rule("spdx:" + x.replace(" ", "-"), "spdx license identifier", f"spdx license identifier {x}", 0, 1.0) for x in SPDX]
    out += [Rule(*x) for x in OTHERS] + [Rule(*x, 1, 0.95) for x in SENTENCES]
    for priority, confidence, before, after in FORMS:
        out += [Rule(label, keyword, before + name + after, priority, confidence) for label, keyword, name in NAMES]
    return out


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(words: str, expression: str, made: str) -> str:
    """SQL for an array of ``made``, of s and e, the start and the end (exclusive) as word indexes of each match of an expression.

    Marks, which no word holds, are put round every match; then the words are numbered. The lambda makes Spark do that once.
    """
    marked = f"split(regexp_replace({words}, concat('(?<= )(?:', {expression}, ')(?= )'), '\u0002$0\u0003'), ' ')"
    starts = "filter(transform(m, (w, i) -> IF(startswith(w, '\u0002'), i - 1, NULL)), v -> v IS NOT NULL)"
    ends = "filter(transform(m, (w, i) -> IF(endswith(w, '\u0003'), i, NULL)), v -> v IS NOT NULL)"
    return f"flatten(transform(array({marked}), m -> zip_with({starts}, {ends}, (s, e) -> {made})))"


def scan(df: DataFrame, text: str = "text", signatures: list[Rule] | None = None, base: dict[str, str] = BASE) -> DataFrame:
    """``df`` with ``n_words``, ``base`` and ``detections``, arrays of struct with start, end (words, exclusive) and label.

    ``detections`` also have priority and confidence; they are what suppression has left, in order of place.
    """
    signatures = rules() if signatures is None else signatures
    stems = [s for s in STEMS if any(s in f" {r.keyword} " for r in signatures)]
    for r in signatures:
        if not any(s in f" {r.keyword} " for s in stems):
            raise ValueError(f"no stem for the keyword {r.keyword!r}")
        re.compile(r.expression)
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), NOT_WORD, " ")), F.lit(" "))
    table = "array(" + ", ".join(f"named_struct('label', {_text(r.label)}, 'keyword', {_text(r.keyword)}, 'expression', {_text(r.expression)}, "
                                 f"'priority', {r.priority}, 'confidence', {r.confidence}D)" for r in signatures) + ")"
    spans = _spans("__words_", "r.expression", "named_struct('start', s, 'back', -e, 'priority', r.priority, 'label', r.label, 'confidence', r.confidence)")
    found = f"flatten(transform(filter({table}, r -> contains(__words_, r.keyword)), r -> {spans}))"
    gate = " OR ".join(f"contains(__words_, {_text(s)})" for s in stems)
    empty = "filter(array(named_struct('start', 0, 'back', 0, 'priority', 0, 'label', '', 'confidence', 0D)), x -> false)"
    # In order of start, longest first, whatever contains a match stands before it; the fold keeps the farthest end by priority.
    levels = f"array_repeat(-1, {LEVELS})"
    gone = "exists(slice(a.ends, 1, x.priority + 1), e -> e >= -x.back)"
    fold = (f"aggregate(array_sort(__found_), named_struct('ends', {levels}, 'kept', {empty}), (a, x) -> IF({gone}, a, named_struct("
            "'ends', transform(a.ends, (e, i) -> IF(i = x.priority, greatest(e, -x.back), e)), 'kept', concat(a.kept, array(x)))), a -> a.kept)")
    found_base = []
    for phrase, label in base.items():
        spans = _spans("__words_", _text(phrase), f"named_struct('start', s, 'end', e, 'label', {_text(label)})")
        found_base.append(f"IF(contains(__words_, {_text(f' {phrase} ')}), {spans}, "
                          "filter(array(named_struct('start', 0, 'end', 0, 'label', '')), x -> false))")
    out = df.withColumn("__words_", words)
    out = out.withColumns({
        "n_words": F.expr("CAST(IF(__words_ = '  ', 0, length(__words_) - length(replace(__words_, ' ', '')) - 1) AS BIGINT)"),
        "base": F.expr(f"concat({', '.join(found_base)})") if found_base else F.expr("array()"),
        "__found_": F.expr(f"IF({gate}, {found}, {empty})"),
    })
    out = out.withColumn("detections", F.expr(f"transform({fold}, x -> named_struct('start', x.start, 'end', -x.back, 'label', x.label, 'priority', x.priority, 'confidence', x.confidence))"))
    return out.drop("__words_", "__found_")
