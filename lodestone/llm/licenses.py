"""License detection by ordered signature rules.

Regular expressions over the words of a text: some 260 hand-written signatures
of notices, headers, clauses and short names, and patterns generated from
families of names, versions and phrasings. Each rule has a keyword; a text is
scanned by a rule only if it holds a word that begins with it. Matches compete:
higher priority first, then longer, then earlier; a match inside the interval
of one that stands is suppressed.

Three base phrases are reported whatever the rules say: every place where
their words stand consecutively. Rules add labels, base labels stay.

Defined results: null text is empty (0 words, no labels); of matches with equal
interval and priority the label that sorts first stands; repeated rows give
repeated results; texts of any length are scanned whole; only doc_id and text
are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbuf import ALNUM, TextSlice, text_slices, runs
from lodestone.session import load

#: Fixed by the contract of the query.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_EDGE = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


def phrase_regex(words: str) -> bytes:
    """A pattern over lower-cased bytes in which ``words`` stand as whole consecutive words.

    (a|b c) is an alternative of words, [a b] words that may be missing.
    """
    parts = re.findall(r"\([^)]*\)|\[[^\]]*\]|\S+", words)
    out = b""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        spaced = lambda x: _GAP.join(w.encode() for w in x.split())
        if part[0] == "[":
            out += rb"(?:" + (_GAP if last else b"") + spaced(part[1:-1]) + (b"" if last else _GAP) + rb")?"
            continue
        out += rb"(?:" + b"|".join(spaced(x) for x in part[1:-1].split("|")) + rb")" if part[0] == "(" else part.encode()
        if not last and not (i == len(parts) - 2 and parts[-1][0] == "["):
            out += _GAP
    return rb"(?<!" + _EDGE + rb")" + out + rb"(?!" + _EDGE + rb")"


class Rule:
    def __init__(self, label: str, words: str, keyword: str, priority: int, score: float):
        self.label, self.words, self.keyword, self.priority, self.score = label, words, keyword.encode(), priority, score
        self.regex = re.compile(phrase_regex(words))


#: label, name as written in prose (words, alternatives in brackets), keyword, versions ("" if none)
_FAMILIES = [
    ("gpl", "gnu (general public license|gpl)", "gnu", ["1", "2", "3"]),
    ("lgpl", "gnu (lesser|library) general public license", "gnu", ["2", "2 1", "3"]),
    ("agpl", "gnu affero general public license", "affero", ["3"]),
    ("gfdl", "gnu free documentation license", "gnu", ["1 1", "1 2", "1 3"]),
    ("apache", "apache [software] license", "apache", ["1 0", "1 1", "2", "2 0"]),
    ("mpl", "mozilla public license", "mozilla", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse public license", "eclipse", ["1 0", "2 0"]),
    ("cddl", "common development and distribution license", "distribution", ["1 0", "1 1"]),
    ("cpl", "common public license", "common", ["1 0"]),
    ("eupl", "european union public (license|licence)", "european", ["1 1", "1 2"]),
    ("osl", "open software license", "software", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic free license", "academic", ["1 2", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic license", "artistic", ["1 0", "2 0"]),
    ("boost", "boost software license", "boost", ["1 0"]),
    ("zpl", "zope public license", "zope", ["1 1", "2 0", "2 1"]),
    ("psf", "python software foundation license", "python", ["2"]),
    ("php", "php license", "php", ["3 0", "3 01"]),
    ("wtfpl", "do what the fuck you want to public license", "want", ["2"]),
    ("unlicense", "the unlicense", "unlicense", [""]),
    ("isc", "isc license", "isc", [""]),
    ("zlib", "zlib [libpng] license", "zlib", [""]),
    ("mit", "mit license", "mit", [""]),
    ("bsd-2", "(bsd 2 clause|simplified bsd|freebsd) license", "bsd", [""]),
    ("bsd-3", "(bsd 3 clause|modified bsd|new bsd|revised bsd) license", "bsd", [""]),
    ("bsd-4", "(bsd 4 clause|original bsd) license", "bsd", [""]),
    ("cc0", "cc0 [1 0]", "cc0", [""]),
    ("ofl", "sil open font license", "font", ["1 0", "1 1"]),
    ("upl", "universal permissive license", "permissive", ["1 0"]),
    ("ncsa", "university of illinois ncsa open source license", "ncsa", [""]),
    ("ms-pl", "microsoft public license", "microsoft", [""]),
    ("ms-rl", "microsoft reciprocal license", "microsoft", [""]),
    ("odbl", "open database license", "database", ["1 0"]),
    ("proprietary", "all rights reserved", "reserved", [""]),
    ("public-domain", "(dedicated to|released into|in) the public domain", "domain", [""]),
]
#: Phrasings around a name; {n} is the name with its version.
_PHRASINGS = [("{n}", 1, 0.7), ("under [the] {n}", 2, 0.85), ("licensed under [the] [terms of the] {n}", 3, 0.95), ("spdx license identifier {n}", 4, 1.0), ("distributed under [the] [terms of the] {n}", 3, 0.95)]
_CC = [("by", "attribution"), ("by-sa", "attribution (sharealike|share alike)"), ("by-nd", "attribution (noderivatives|noderivs|no derivatives)"), ("by-nc", "attribution (noncommercial|non commercial)"), ("by-nc-sa", "attribution (noncommercial|non commercial) (sharealike|share alike)"), ("by-nc-nd", "attribution (noncommercial|non commercial) (noderivatives|noderivs|no derivatives)")]
_SPDX = ["mit", "isc", "0bsd", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "agpl 3 0 only", "agpl 3 0 or later", "apache 2 0", "mpl 2 0", "bsd 2 clause", "bsd 3 clause", "cc by 4 0", "cc by sa 4 0", "cc0 1 0", "epl 2 0", "unlicense", "zlib"]

#: Notices, headers, clauses and short names as they stand in the licenses and beside code: label, words, keyword, priority, score.
_SIGNATURES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission", 8, 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "copyright", 6, 0.8),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "permission", 8, 1.0),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted", "permission", 8, 1.0),
    ("mit", "x11 license", "x11", 4, 0.8),
    ("mit", "expat license", "expat", 4, 0.8),
    ("mit", "mit (licence|licensed)", "mit", 3, 0.7),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 7, 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 6, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", 6, 0.9),
    ("bsd-3", "neither the name of", "neither", 2, 0.4),
    ("bsd-3", "be used to endorse or promote products derived from this software", "endorse", 7, 0.9),
    ("bsd-4", "all advertising materials mentioning features or use of this software", "advertising", 8, 1.0),
    ("bsd", "bsd (style license|license|licence|licensed)", "bsd", 3, 0.7),
    ("bsd-2", "(2|two) clause bsd [license]", "clause", 5, 0.9),
    ("bsd-3", "(3|three) clause bsd [license]", "clause", 5, 0.9),
    ("bsd-4", "(4|four) clause bsd [license]", "clause", 5, 0.9),
    ("bsd-2", "bsd 2 clause", "bsd", 5, 0.9),
    ("bsd-3", "bsd 3 clause", "bsd", 5, 0.9),
    ("bsd-4", "bsd 4 clause", "bsd", 5, 0.9),
    ("as-is", "provided as is without warranty", "warranty", 3, 0.5),
    ("as-is", "provided as is without any (warranty|warranties)", "provided", 3, 0.5),
    ("as-is", "provided by the (copyright holders|author|authors|regents) and contributors as is", "contributors", 3, 0.5),
    ("zlib", "this software is provided as is without any express or implied warranty", "implied", 6, 0.9),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 8, 1.0),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 8, 1.0),
    ("apache-2", "apache (2 0|2) [license]", "apache", 5, 0.9),
    ("apache-2", "(apache2|apachev2) [license]", "apache", 5, 0.9),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable", 8, 0.95),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance", 7, 0.9),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements", "contributor", 8, 1.0),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "program", 6, 0.95),
    ("gpl", "you should have received a copy of the gnu general public license", "gnu", 6, 0.9),
    ("lgpl", "you should have received a copy of the gnu (lesser|library) general public license", "gnu", 6, 0.9),
    ("agpl", "you should have received a copy of the gnu affero general public license", "affero", 6, 0.9),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license", "library", 6, 0.95),
    ("gpl", "gpl (license|licence|licensed)", "gpl", 2, 0.7),
    ("gpl-1", "(gplv1|gpl v1|gpl 1 0|gpl version 1)", "gpl", 5, 0.9),
    ("gpl-2", "(gplv2|gpl v2|gpl v 2|gpl 2 0|gpl 2|gpl version 2)", "gpl", 5, 0.9),
    ("gpl-3", "(gplv3|gpl v3|gpl v 3|gpl 3 0|gpl 3|gpl version 3)", "gpl", 5, 0.9),
    ("lgpl", "lgpl (license|licence|licensed)", "lgpl", 2, 0.7),
    ("lgpl-2.1", "(lgplv2 1|lgpl v2 1|lgpl v 2 1|lgpl 2 1|lgpl version 2 1)", "lgpl", 6, 0.9),
    ("lgpl-2", "(lgplv2|lgpl v2|lgpl 2 0|lgpl 2|lgpl version 2)", "lgpl", 5, 0.9),
    ("lgpl-3", "(lgplv3|lgpl v3|lgpl v 3|lgpl 3 0|lgpl 3|lgpl version 3)", "lgpl", 5, 0.9),
    ("agpl-3", "(agplv3|agpl v3|agpl 3 0|agpl 3|agpl version 3)", "agpl", 5, 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission", 8, 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 8, 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 8, 1.0),
    ("mpl-2.0", "(mplv2|mpl v2|mpl 2 0|mpl 2|mpl version 2)", "mpl", 5, 0.9),
    ("mpl-1.1", "mpl 1 1", "mpl", 5, 0.9),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "program", 8, 1.0),
    ("epl-2.0", "(epl v2|epl 2 0)", "epl", 5, 0.9),
    ("epl-1.0", "(epl v1|epl 1 0)", "epl", 5, 0.9),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "distribution", 8, 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 9, 1.0),
    ("cc0", "no rights reserved", "rights", 3, 0.6),
    ("cc0", "has waived all copyright and related or neighboring rights", "waived", 8, 1.0),
    ("cc0", "creative commons (zero|cc0)", "commons", 5, 0.9),
    ("wtfpl", "you just do what the fuck you want to", "fuck", 8, 1.0),
    ("ofl", "this font software is licensed under the sil open font license", "font", 8, 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent", 8, 1.0),
    ("psf-2", "psf is making python available to licensee on an as is basis", "psf", 8, 1.0),
    ("php", "this product includes php software", "php", 7, 0.9),
]
# fmt: off
#: More notices and clauses, family by family.
_PERMISSIVE = [
    ("mit", "subject to the following conditions the above copyright notice and this permission notice", "permission", 7, 0.9),
    ("mit", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "sublicense", 8, 1.0),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability", 4, 0.4),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "liable", 5, 0.6),
    ("mit", "mit x11", "mit", 4, 0.8),
    ("mit", "license mit", "mit", 3, 0.7),
    ("mit", "(opensource|opensource org) licenses mit", "licenses", 6, 0.9),
    ("mit-0", "mit no attribution", "attribution", 6, 0.9),
    ("mit-advertising", "mit license with advertising clause", "advertising", 7, 0.9),
    ("jquery", "dual licensed under the mit (and|or) gpl", "dual", 7, 0.9),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims", 6, 0.9),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages", "consequential", 4, 0.5),
    ("isc", "license isc", "isc", 3, 0.7),
    ("0bsd", "zero clause bsd [license]", "clause", 6, 0.9),
    ("0bsd", "bsd zero clause", "bsd", 6, 0.9),
    ("bsd", "redistributions must retain the above copyright notice", "redistributions", 5, 0.8),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", "contributors", 6, 0.8),
    ("bsd", "this software is provided by the regents and contributors as is", "regents", 7, 0.9),
    ("bsd", "the regents of the university of california", "regents", 5, 0.8),
    ("bsd-3", "without specific prior written permission this software is provided by", "permission", 6, 0.8),
    ("bsd-4", "this product includes software developed by the university of california", "university", 8, 1.0),
    ("bsd-4", "must display the following acknowledgement", "acknowledgement", 7, 0.9),
    ("bsd-source-code", "redistributions of source code must retain the copyright notices as they appear in each source code file", "redistributions", 8, 1.0),
    ("bsd-3-clear", "no express or implied licenses to any party s patent rights are granted by this license", "patent", 8, 1.0),
    ("bsd-2-patent", "bsd 2 clause plus patent", "patent", 7, 0.9),
    ("bsd", "(opensource|opensource org) licenses bsd license", "licenses", 6, 0.9),
    ("apache-2", "licensed under the apache license version 2 0 the license", "apache", 7, 1.0),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache", 8, 1.0),
    ("apache-2", "you may obtain a copy of the license at https www apache org licenses license 2 0", "apache", 8, 1.0),
    ("apache-2", "www apache org licenses license 2 0", "apache", 6, 0.9),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license", "governing", 6, 0.8),
    ("apache-2", "asl 2 0", "asl", 4, 0.8),
    ("apache-2", "terms and conditions for use reproduction and distribution", "reproduction", 6, 0.7),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "irrevocable", 8, 1.0),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache", 7, 0.9),
    ("apache-1.1", "products derived from this software may not be called apache", "apache", 7, 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "permission", 8, 1.0),
    ("zlib", "this notice may not be removed or altered from any source distribution", "altered", 7, 0.9),
    ("libpng", "the origin of this source code must not be misrepresented", "misrepresented", 8, 1.0),
    ("libpng", "png reference library license", "png", 6, 0.9),
    ("boost", "boost software license version 1 0", "boost", 7, 1.0),
    ("boost", "www boost org license 1 0 txt", "boost", 8, 1.0),
    ("boost", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", "executable", 8, 1.0),
    ("boost", "bsl 1 0", "bsl", 4, 0.8),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "permission", 8, 0.9),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "documentation", 8, 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "documentation", 8, 0.9),
    ("hpnd", "historical permission notice and disclaimer", "historical", 7, 0.9),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "dealings", 8, 1.0),
    ("icu", "permission notice appear in all copies of the software and that both the above copyright notice", "permission", 7, 0.9),
    ("unicode", "unicode inc license agreement data files and software", "unicode", 8, 1.0),
    ("unicode", "unicode terms of use", "unicode", 5, 0.7),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "agreement", 9, 1.0),
    ("postgresql", "postgresql license", "postgresql", 5, 0.9),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "authors", 8, 1.0),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 8, 1.0),
    ("openssl", "openssl license", "openssl", 5, 0.9),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic", 8, 1.0),
    ("psf-2", "python software foundation license version 2", "python", 7, 1.0),
    ("psf-2", "psf license agreement", "psf", 6, 0.9),
    ("python", "beopen com license agreement for python", "beopen", 8, 1.0),
    ("cnri", "cnri license agreement for python", "cnri", 8, 1.0),
    ("ruby", "you may distribute the software in object code or binary form provided that you do at least one of the following", "binary", 7, 0.8),
    ("ruby", "ruby s license", "ruby", 5, 0.8),
    ("perl", "under the same terms as perl itself", "perl", 7, 0.95),
    ("artistic-2.0", "the artistic license 2 0", "artistic", 6, 0.9),
    ("artistic-1.0", "the clarified artistic license", "clarified", 7, 0.9),
    ("php-3.01", "the php license version 3 01", "php", 7, 1.0),
    ("zend", "the zend engine license", "zend", 7, 0.9),
    ("vim", "vim license", "vim", 5, 0.8),
    ("wtfpl", "do what the fuck you want to public license", "fuck", 7, 1.0),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "beer", 8, 1.0),
    ("beerware", "(beer ware|beerware) license", "beer", 6, 0.9),
    ("json", "the software shall be used for good not evil", "evil", 8, 1.0),
    ("ftl", "the freetype project license", "freetype", 7, 1.0),
    ("ftl", "portions of this software are copyright the freetype project", "freetype", 7, 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg", 8, 1.0),
    ("imagemagick", "imagemagick license", "imagemagick", 6, 0.9),
    ("naist", "nara institute of science and technology", "nara", 5, 0.6),
    ("ncsa", "university of illinois ncsa open source license", "illinois", 7, 1.0),
    ("w3c", "w3c software notice and license", "w3c", 7, 1.0),
    ("w3c", "w3c software and document notice and license", "w3c", 7, 1.0),
    ("zpl", "zope corporation and contributors", "zope", 5, 0.7),
    ("blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others", "forgiveness", 8, 1.0),
    ("ecl-2.0", "educational community license version 2 0", "educational", 7, 1.0),
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic", 7, 1.0),
    ("mulan", "mulan (psl|permissive software license)", "mulan", 6, 0.9),
    ("blue-oak", "blue oak model license", "oak", 6, 0.9),
    ("upl", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation", "condition", 8, 0.9),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works", "instrument", 8, 1.0),
    ("ms-pl", "microsoft public license ms pl", "microsoft", 6, 1.0),
    ("intel", "intel simplified software license", "intel", 6, 0.9),
    ("nvidia", "nvidia software license agreement", "nvidia", 6, 0.9),
]
_COPYLEFT = [
    ("gpl-2+", "either version 2 of the license or at your option any later version", "option", 8, 1.0),
    ("gpl-3+", "either version 3 of the license or at your option any later version", "option", 8, 1.0),
    ("lgpl-2.1+", "either version 2 1 of the license or at your option any later version", "option", 8, 1.0),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "merchantability", 7, 0.9),
    ("lgpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (lesser|library) general public license", "merchantability", 8, 0.95),
    ("agpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license", "merchantability", 8, 0.95),
    ("gpl-2", "as published by the free software foundation version 2", "published", 7, 0.9),
    ("gpl-3", "as published by the free software foundation version 3", "published", 7, 0.9),
    ("gpl", "if not write to the free software foundation inc", "foundation", 5, 0.8),
    ("gpl", "www gnu org licenses gpl", "gnu", 6, 0.9),
    ("gpl-2", "www gnu org licenses old licenses gpl 2 0", "gnu", 7, 1.0),
    ("gpl-3", "www gnu org licenses gpl 3 0", "gnu", 7, 1.0),
    ("lgpl", "www gnu org licenses lgpl", "gnu", 6, 0.9),
    ("lgpl-2.1", "www gnu org licenses old licenses lgpl 2 1", "gnu", 7, 1.0),
    ("agpl", "www gnu org licenses agpl", "gnu", 6, 0.9),
    ("gfdl", "www gnu org licenses fdl", "gnu", 6, 0.9),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", 6, 0.7),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom", 8, 1.0),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft", 9, 1.0),
    ("agpl-3", "the gnu affero general public license is a free copyleft license", "copyleft", 9, 1.0),
    ("agpl-3", "remote network interaction use with the gnu general public license", "remote", 8, 1.0),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "incorporates", 9, 1.0),
    ("lgpl", "this license the lesser general public license applies to some specially designated software packages", "lesser", 9, 1.0),
    ("gpl-2", "gnu gpl (v2|version 2|2 0)", "gnu", 6, 0.9),
    ("gpl-3", "gnu gpl (v3|version 3|3 0)", "gnu", 6, 0.9),
    ("lgpl", "gnu lgpl", "gnu", 4, 0.8),
    ("agpl", "gnu agpl", "gnu", 4, 0.8),
    ("gpl", "gpl compatible", "gpl", 2, 0.3),
    ("gpl-2-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", "exception", 9, 1.0),
    ("gpl-2-classpath", "classpath exception", "classpath", 6, 0.9),
    ("gpl-gcc-exception", "gcc runtime library exception", "gcc", 7, 1.0),
    ("gpl-autoconf-exception", "as a special exception the free software foundation gives unlimited permission to copy distribute and modify", "exception", 8, 0.9),
    ("gpl-bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison", 9, 1.0),
    ("gpl-font-exception", "if you create a document which uses this font and embed this font", "embed", 8, 0.9),
    ("gpl-linking-exception", "linking exception", "linking", 3, 0.5),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant", 8, 1.0),
    ("gfdl-1.3", "gnu fdl 1 3", "gnu", 6, 0.9),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights", "governing", 8, 0.9),
    ("mpl", "alternatively the contents of this file may be used under the terms of either the gnu general public license", "alternatively", 8, 0.9),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 9, 1.0),
    ("mpl-2.0", "mozilla org mpl 2 0", "mozilla", 7, 1.0),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses", "incompatible", 8, 1.0),
    ("npl", "netscape public license", "netscape", 6, 0.9),
    ("epl-1.0", "eclipse public license v1 0 which accompanies this distribution", "eclipse", 8, 1.0),
    ("epl-2.0", "the eclipse public license 2 0 which is available at", "eclipse", 8, 1.0),
    ("epl", "www eclipse org legal epl", "eclipse", 7, 0.9),
    ("edl-1.0", "eclipse distribution license v 1 0", "eclipse", 7, 1.0),
    ("cddl", "you can obtain a copy of the license at usr src opensolaris license", "opensolaris", 9, 1.0),
    ("cddl", "cddl header", "cddl", 5, 0.8),
    ("cddl-1.0", "cddl (1 0|version 1 0)", "cddl", 6, 0.9),
    ("cpl-1.0", "cpl (1 0|v1 0)", "cpl", 5, 0.8),
    ("ipl-1.0", "ibm public license version 1 0", "ibm", 7, 1.0),
    ("spl", "sun public license", "sun", 6, 0.9),
    ("apsl", "apple public source license", "apple", 6, 0.9),
    ("rpl", "reciprocal public license", "reciprocal", 6, 0.9),
    ("qpl", "q public license", "public", 5, 0.8),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "accompanied", 9, 1.0),
    ("sleepycat", "sleepycat (license|software)", "sleepycat", 6, 0.9),
    ("eupl-1.2", "licensed under the eupl version 1 2", "eupl", 8, 1.0),
    ("eupl", "licensed under the eupl", "eupl", 6, 0.9),
    ("cecill", "cecill [free software] license", "cecill", 6, 0.9),
    ("cecill", "governed by the cecill", "cecill", 7, 0.9),
    ("osl-3.0", "licensed under the open software license version 3 0", "software", 7, 1.0),
    ("cpal", "common public attribution license", "attribution", 6, 0.9),
    ("sspl", "server side public license", "server", 6, 0.9),
    ("elastic", "elastic license", "elastic", 5, 0.9),
    ("busl", "business source license", "business", 6, 0.9),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor", 9, 1.0),
    ("commons-clause", "commons clause license condition", "commons", 7, 0.9),
    ("polyform", "polyform (noncommercial|shield|strict|perimeter|small business) license", "polyform", 7, 0.9),
    ("ofl-1.1", "reserved font name", "font", 5, 0.8),
    ("ofl-1.1", "scripts sil org ofl", "ofl", 7, 1.0),
    ("ofl-1.1", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "collaborative", 9, 1.0),
    ("lppl", "latex project public license", "latex", 6, 0.9),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license", "latex", 9, 1.0),
]
_CONTENT = [
    ("cc", "creativecommons org licenses", "creativecommons", 4, 0.8),
    ("cc-by", "creativecommons org licenses by (2 0|2 5|3 0|4 0)", "creativecommons", 6, 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa (2 0|2 5|3 0|4 0)", "creativecommons", 6, 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc (2 0|2 5|3 0|4 0)", "creativecommons", 6, 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd (2 0|2 5|3 0|4 0)", "creativecommons", 6, 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa (2 0|2 5|3 0|4 0)", "creativecommons", 6, 1.0),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd (2 0|2 5|3 0|4 0)", "creativecommons", 6, 1.0),
    ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons", 7, 1.0),
    ("cc0", "cc0 1 0 universal", "cc0", 6, 1.0),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons", 7, 1.0),
    ("cc", "this work is licensed under a creative commons", "creative", 5, 0.9),
    ("cc", "some rights reserved", "reserved", 3, 0.5),
    ("cc-by-sa", "text is available under the creative commons attribution (sharealike|share alike) license", "commons", 8, 1.0),
    ("public-domain", "this (work|file|software|code) is in the public domain", "domain", 5, 0.9),
    ("public-domain", "placed in the public domain", "domain", 5, 0.9),
    ("public-domain", "released to the public domain", "domain", 5, 0.9),
    ("public-domain", "no copyright is claimed", "claimed", 5, 0.8),
    ("public-domain", "the author disclaims copyright to this source code", "disclaims", 7, 0.9),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone", 8, 1.0),
    ("unlicense", "unlicense org", "unlicense", 5, 0.9),
    ("odbl", "opendatacommons org licenses odbl", "opendatacommons", 7, 1.0),
    ("odc-by", "open data commons attribution license", "commons", 6, 0.9),
    ("pddl", "public domain dedication and license", "dedication", 6, 0.9),
    ("ogl-uk", "open government licence", "government", 6, 0.9),
    ("fal", "free art license", "art", 5, 0.8),
    ("opl", "open publication license", "publication", 5, 0.8),
    ("ogl", "open game license", "game", 5, 0.8),
    ("cdla", "community data license agreement (permissive|sharing)", "agreement", 6, 0.9),
    ("etalab", "etalab (open licence|2 0)", "etalab", 6, 0.9),
    ("openrail", "(openrail|openrail m) license", "openrail", 6, 0.9),
    ("openrail", "responsible ai license", "responsible", 6, 0.9),
    ("llama", "llama (2|3|3 1) community license", "llama", 6, 0.9),
    ("gutenberg", "project gutenberg license", "gutenberg", 6, 0.9),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized", 7, 0.9),
    ("proprietary", "proprietary and confidential", "proprietary", 5, 0.8),
    ("proprietary", "may not be reproduced in whole or in part without", "reproduced", 5, 0.7),
    ("proprietary", "no part of this publication may be reproduced", "publication", 6, 0.8),
    ("proprietary", "end user license agreement", "user", 4, 0.6),
    ("proprietary", "for personal use only", "personal", 3, 0.5),
    ("non-commercial", "for (non commercial|noncommercial) use only", "use", 4, 0.7),
    ("non-commercial", "not for commercial use", "commercial", 4, 0.7),
    ("editorial", "reprinted with permission", "reprinted", 3, 0.5),
]
# fmt: on


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out = []
    for label, name, keyword, versions in _FAMILIES:
        for version in versions:
            forms = [name] if not version else [f"{name} v{version}", f"{name} {version}", f"{name} version {version}", f"{name} v {version}"]
            tag = f"{label}-{version.replace(' ', '.')}" if version and not (label == "apache" and version.startswith("2")) else "apache-2" if version else label
            for form in forms:
                for phrasing, priority, score in _PHRASINGS:
                    out.append(Rule(tag, phrasing.replace("{n}", form), keyword, priority + bool(version), score))
        if versions != [""]:
            out += [Rule(label, phrasing.replace("{n}", name), keyword, priority, score * 0.9) for phrasing, priority, score in _PHRASINGS]
    for short, long in _CC:
        key = short.replace("-", " ")
        for version in ("", " 1 0", " 2 0", " 2 5", " 3 0", " 4 0"):
            tag = f"cc-{short}" + (f"-{version.strip().replace(' ', '.')}" if version else "")
            out.append(Rule(tag, f"cc {key}{version}", "cc", 3 + bool(version), 0.9))
            out.append(Rule(tag, f"creative commons {long}{version}", "commons", 4 + bool(version), 1.0))
    out += [Rule(x.replace(" ", "-").replace("-or-later", "+").replace("-only", ""), f"spdx license identifier {x}", "spdx", 9, 1.0) for x in _SPDX]
    out += [Rule(*x) for x in (*_SIGNATURES, *_PERMISSIVE, *_COPYLEFT, *_CONTENT)]
    return tuple(sorted(out, key=lambda r: (-r.priority, -len(r.words), r.label)))


_BASE_REGEX = [(label, re.compile(phrase_regex(words))) for label, words in BASE.items()]
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


@cache
def _prefilter() -> tuple[re.Pattern, re.Pattern, dict[bytes, tuple[Rule, ...]]]:
    """Keywords at the start of a word, keywords at the start of a row, rules by keyword."""
    by: dict[bytes, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    keys = sorted(by, key=len, reverse=True)
    return re.compile(rb"(?<!" + _EDGE + rb")(?:" + b"|".join(keys) + rb")"), re.compile(b"|".join(keys)), {k: tuple(v) for k, v in by.items()}


def detect(low: bytes, keywords: set[bytes]) -> list[tuple[int, int, Rule]]:
    """The matches that stand, in order of position; ``keywords`` are those that the text holds."""
    found = []
    table = _prefilter()[2]
    for key in sorted(keywords):
        for rule in table[key]:
            found += [(m.start(), m.end(), rule) for m in rule.regex.finditer(low)]
    return stand(found)


def stand(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Matches that no other of higher priority, or of equal priority and longer or equal, contains.

    One pass by position: what contains a match begins no later, so the furthest end of each priority so far decides.
    """
    kept, furthest = [], {}
    for a, b, rule in sorted(found, key=lambda x: (x[0], -x[1], -x[2].priority, x[2].label)):
        if not any(p >= rule.priority and end >= b for p, end in furthest.items()):
            kept.append((a, b, rule))
        furthest[rule.priority] = max(furthest.get(rule.priority, -1), b)
    return kept


def _scan(s: TextSlice) -> dict[str, list]:
    data = _UPPER[s.data] if len(s.data) else s.data
    starts, _, word_at = runs(ALNUM[data], s.offs)
    n = s.n
    out = {"n_words": np.diff(word_at), "n_base": np.zeros(n, np.int64), "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": np.zeros(n)}
    raw = data.tobytes()
    pattern, at_start, _ = _prefilter()
    row_keys: dict[int, set[bytes]] = {}
    for m in pattern.finditer(raw):
        row = int(np.searchsorted(s.offs, m.start(), "right")) - 1
        row_keys.setdefault(row, set()).add(m.group())
    for row, at in enumerate(s.offs[:-1].tolist()):
        if m := at_start.match(raw, at, int(s.offs[row + 1])):
            row_keys.setdefault(row, set()).add(m.group())
    for row, keys in row_keys.items():
        low = raw[s.offs[row] : s.offs[row + 1]]
        base, places = set(), []
        for label, regex in _BASE_REGEX:
            at = [m.start() for m in regex.finditer(low)]
            places += at
            if at:
                base.add(label)
        kept = detect(low, keys)
        labels = base | {r.label for _, _, r in kept}
        if places:
            words = np.searchsorted(starts, s.offs[row] + np.array([min(places), max(places)])) - word_at[row]
            out["first_word"][row], out["last_word"][row] = int(words[0]), int(words[1])
        out["n_base"][row] = len(places)
        out["base_labels"][row], out["labels"][row] = ",".join(sorted(base)), ",".join(sorted(labels))
        out["score"][row] = max([1.0 if base else 0.0, *(r.score for _, _, r in kept)])
    return out


_FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _run(batches):
    for s in text_slices(batches):
        found = _scan(s)
        yield pa.record_batch([s.column("doc_id"), *(pa.array(found[k], _TYPES[t]) for k, t in _FIELDS)], names=["doc_id", *(k for k, _ in _FIELDS)])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_run, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in _FIELDS))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))
