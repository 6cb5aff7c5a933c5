"""License scans by ordered signature rules, in DataFrame functions only.

Texts become lower-case words with single spaces. A rule is a regular
expression over those, gated by words that the text must hold: one pass over a
text's words finds which of all rules' keywords stand in it. Matches inside a match of at least the same priority (and, at the same, a longer one or
an earlier rule) are suppressed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: ASCII but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that are always found, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    #: Words that stand in every text that the pattern matches; alternatives are parted by bars.
    keyword: str
    label: str
    #: 3: license with its version; 2: license; 1: a hint.
    priority: int
    pattern: str


CONFIDENCE = {3: 1.0, 2: 0.9, 1: 0.5}
#: Score of a text in which only a base phrase stands.
BASE_SCORE = 0.8


def _version(v: str) -> str:
    """'2.0' as words: the zero may be missing."""
    major, _, minor = v.partition(".")
    return f"(?:version |v |ver )?v?{major}" + (f" {minor}" if minor and minor != "0" else "(?: 0)?")


#: Keyword, label, names (regular expressions over words), versions.
FAMILIES = (
    ("apache", "apache", (r"apache (?:software )?licen[sc]e", r"apache"), ("1.0", "1.1", "2.0")),
    ("asl", "apache", (r"asl",), ("1.0", "1.1", "2.0")),
    ("mozilla", "mpl", (r"mozilla public licen[sc]e",), ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", (r"mpl",), ("1.0", "1.1", "2.0")),
    ("eclipse", "epl", (r"eclipse public licen[sc]e",), ("1.0", "2.0")),
    ("epl", "epl", (r"epl",), ("1.0", "2.0")),
    ("common development distribution", "cddl", (r"common development and distribution licen[sc]e",), ("1.0", "1.1")),
    ("cddl", "cddl", (r"cddl",), ("1.0", "1.1")),
    ("common public", "cpl", (r"common public licen[sc]e",), ("1.0",)),
    ("european union", "eupl", (r"european union public licen[sc]e",), ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", (r"eupl",), ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", (r"artistic licen[sc]e",), ("1.0", "2.0")),
    ("academic free", "afl", (r"academic free licen[sc]e",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("open software", "osl", (r"open software licen[sc]e",), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("boost", "bsl", (r"boost software licen[sc]e",), ("1.0",)),
    ("business source", "busl", (r"business source licen[sc]e",), ("1.0", "1.1")),
    ("open font", "ofl", (r"(?:sil )?open font licen[sc]e",), ("1.0", "1.1")),
    ("zope", "zpl", (r"zope public licen[sc]e",), ("1.1", "2.0", "2.1")),
    ("php", "php", (r"php licen[sc]e",), ("3.0", "3.01")),
    ("python", "psf", (r"python software foundation licen[sc]e", r"python licen[sc]e"), ("2.0",)),
    ("ruby", "ruby", (r"ruby licen[sc]e",), ()),
    ("netscape", "npl", (r"netscape public licen[sc]e",), ("1.0", "1.1")),
    ("ibm public", "ipl", (r"ibm public licen[sc]e",), ("1.0",)),
    ("lucent", "lpl", (r"lucent public licen[sc]e",), ("1.0", "1.02")),
    ("sun public", "spl", (r"sun public licen[sc]e",), ("1.0",)),
    ("q public|qt public", "qpl", (r"qt? public licen[sc]e",), ("1.0",)),
    ("reciprocal public", "rpl", (r"reciprocal public licen[sc]e",), ("1.1", "1.5")),
    ("latex", "lppl", (r"latex project public licen[sc]e",), ("1.0", "1.1", "1.2", "1.3")),
    ("mulan", "mulan", (r"mulan (?:permissive software|psl) ?(?:licen[sc]e)?",), ("1.0", "2.0")),
    ("cecill", "cecill", (r"cecill(?: b| c)?(?: licen[sc]e)?",), ("1.0", "1.1", "2.0", "2.1")),
    ("open database", "odbl", (r"open database licen[sc]e",), ("1.0",)),
    ("open data commons attribution", "odc-by", (r"open data commons attribution(?: licen[sc]e)?",), ("1.0",)),
    ("server side public", "sspl", (r"server side public licen[sc]e",), ("1.0",)),
    ("elastic", "elastic", (r"elastic licen[sc]e",), ("2.0",)),
    ("polyform", "polyform", (r"polyform (?:noncommercial|small business|shield|perimeter|strict)(?: licen[sc]e)?",), ("1.0",)),
    ("universal permissive", "upl", (r"universal permissive licen[sc]e",), ("1.0",)),
    ("ncsa", "ncsa", (r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e",), ()),
    ("w3c", "w3c", (r"w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e",), ()),
    ("intel open source", "intel", (r"intel open source licen[sc]e",), ()),
    ("free documentation", "gfdl", (r"(?:gnu )?free documentation licen[sc]e",), ("1.1", "1.2", "1.3")),
    ("public domain dedication", "pddl", (r"(?:open data commons )?public domain dedication (?:and )?licen[sc]e",), ("1.0",)),
    ("open government", "ogl", (r"open government licen[sc]e",), ("1.0", "2.0", "3.0")),
    ("etalab", "etalab", (r"(?:etalab )?(?:licence ouverte|open licen[sc]e) etalab", r"etalab"), ("1.0", "2.0")),
    ("microsoft", "ms-pl", (r"microsoft public licen[sc]e",), ()),
    ("microsoft", "ms-rl", (r"microsoft reciprocal licen[sc]e",), ()),
)

GNU = (
    ("general public", "gpl", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lesser general", "lgpl", r"(?:gnu )?lesser general public licen[sc]e"),
    ("library general", "lgpl", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("affero", "agpl", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
)
GNU_VERSIONS = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0")}

CC_PARTS = (
    ("by", r"by", r"attribution"),
    ("by-sa", r"by sa", r"attribution share ?alike"),
    ("by-nd", r"by nd", r"attribution no ?deriv(?:ative)?s?"),
    ("by-nc", r"by nc", r"attribution non ?commercial"),
    ("by-nc-sa", r"by nc sa", r"attribution non ?commercial share ?alike"),
    ("by-nc-nd", r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

SINGLE = (
    Rule("mit license|mit licence", "mit", 2, r"(?:the )?mit(?: x11)? licen[sc]e"),
    Rule("licensed under mit|licenced under mit", "mit", 2, r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit"),
    Rule("free of charge", "mit", 2, r"permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("provided without warranty", "no-warranty", 1, r"(?:is )?provided as is without warranty of any kind"),
    Rule("bsd", "bsd-4-clause", 3, r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?"),
    Rule("bsd", "bsd-3-clause", 3, r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?"),
    Rule("bsd", "bsd-2-clause", 3, r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?"),
    Rule("bsd", "bsd-3-clause", 3, r"bsd 3 clause(?: licen[sc]e)?"),
    Rule("bsd", "bsd-2-clause", 3, r"bsd 2 clause(?: licen[sc]e)?"),
    Rule("bsd", "bsd-4-clause", 3, r"bsd 4 clause(?: licen[sc]e)?"),
    Rule("0bsd|zero clause bsd", "0bsd", 3, r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?"),
    Rule("bsd", "bsd", 2, r"bsd(?: style)? licen[sc]e"),
    Rule("redistribution and use", "bsd", 2, r"redistribution and use in source and binary forms"),
    Rule("isc", "isc", 2, r"isc licen[sc]e"),
    Rule("with or without fee", "isc", 2, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Rule("zlib", "zlib", 2, r"zlib(?: libpng)? licen[sc]e"),
    Rule("unlicense", "unlicense", 2, r"(?:the )?unlicense"),
    Rule("unencumbered", "unlicense", 2, r"free and unencumbered software released into the public domain"),
    Rule("wtfpl", "wtfpl", 2, r"wtfpl"),
    Rule("what want public", "wtfpl", 2, r"do what the f\w+ you want to public licen[sc]e"),
    Rule("cc0", "cc0-1.0", 3, r"cc0(?: 1 0)?(?: universal)?"),
    Rule("public domain", "public-domain", 1, r"(?:dedicated to|released into|in) the public domain"),
    Rule("creative commons", "cc", 1, r"creative commons"),
    Rule("sil ofl", "ofl", 2, r"sil ofl"),
    Rule("beerware", "beerware", 2, r"beerware(?: licen[sc]e)?"),
    Rule("json", "json", 2, r"json licen[sc]e"),
    Rule("openssl", "openssl", 2, r"openssl licen[sc]e"),
    Rule("postgresql", "postgresql", 2, r"postgresql licen[sc]e"),
    Rule("vim", "vim", 2, r"vim licen[sc]e"),
    Rule("x11", "x11", 2, r"x11 licen[sc]e"),
    Rule("curl", "curl", 2, r"curl licen[sc]e"),
    Rule("icu", "icu", 2, r"icu licen[sc]e"),
    Rule("unicode", "unicode", 2, r"unicode(?: data files and software)? licen[sc]e"),
    Rule("proprietary", "proprietary", 1, r"proprietary and confidential"),
    Rule("proprietary", "proprietary", 1, r"(?:this is )?proprietary (?:software|information|material)"),
    Rule("unauthorized", "proprietary", 1, r"unauthorized (?:copying|use|reproduction|distribution)"),
    Rule("without permission", "proprietary", 1, r"(?:reproduced|copied|distributed|used) (?:\w+ ){0,4}without (?:\w+ ){0,2}permission"),
    Rule("no part of", "proprietary", 1, r"no part of this (?:publication|work|book|document) may be reproduced"),
    Rule("some rights reserved", "some-rights", 1, r"some rights reserved"),
    Rule("no rights reserved", "no-rights", 1, r"no rights reserved"),
    Rule("copyright", "copyright", 1, r"copyright (?:c )?\d{4}(?: \d{4})*"),
    Rule("copyleft", "copyleft", 1, r"copyleft"),
    Rule("open source license|open source licence", "open-source", 1, r"open source licen[sc]e"),
    Rule("licensed under|licenced under", "licensed", 1, r"licen[sc]ed under(?: the)?"),
    Rule("released under", "licensed", 1, r"released under(?: the)?"),
    Rule("distributed under", "licensed", 1, r"distributed under(?: the)?"),
    Rule("spdx", "spdx", 1, r"spdx licen[sc]e identifier"),
)


#: Names of licenses, each a rule of its own: keyword, label, pattern.
NAMED = (
    ("adobe glyph", "adobe-glyph", r"adobe glyph list licen[sc]e"),
    ("adobe utopia", "adobe-utopia", r"adobe utopia font licen[sc]e"),
    ("aladdin", "aladdin", r"aladdin free public licen[sc]e"),
    ("apple public source", "apsl", r"apple public source licen[sc]e"),
    ("apple sample", "apple-sample", r"apple sample code licen[sc]e"),
    ("arphic", "arphic", r"arphic public licen[sc]e"),
    ("attribution assurance", "aal", r"attribution assurance licen[sc]e"),
    ("bitstream vera", "bitstream-vera", r"bitstream vera (?:fonts? )?(?:licen[sc]e|copyright)"),
    ("bittorrent", "bittorrent", r"bittorrent open source licen[sc]e"),
    ("blue oak", "blueoak", r"blue oak model licen[sc]e"),
    ("bigscience rail", "bigscience-rail", r"bigscience (?:open )?rail licen[sc]e"),
    ("cern", "cern-ohl", r"cern open hardware licen[sc]e"),
    ("cnri", "cnri-python", r"cnri (?:python |open source )?licen[sc]e"),
    ("attribution public common", "cpal", r"common public attribution licen[sc]e"),
    ("trusted open source", "catosl", r"computer associates trusted open source licen[sc]e"),
    ("commons clause", "commons-clause", r"commons clause(?: licen[sc]e)?(?: condition)?"),
    ("condor", "condor", r"condor public licen[sc]e"),
    ("confluent", "confluent", r"confluent community licen[sc]e"),
    ("creativeml", "openrail", r"creativeml open ?rail m(?: licen[sc]e)?"),
    ("cryptix", "cryptix", r"cryptix general licen[sc]e"),
    ("cua office", "cua-opl", r"cua office public licen[sc]e"),
    ("deutsche freie", "d-fsl", r"deutsche freie software lizenz"),
    ("design science", "dsl", r"design science licen[sc]e"),
    ("detection rule", "drl", r"detection rule licen[sc]e"),
    ("docbook", "docbook", r"docbook (?:schema |stylesheet )?licen[sc]e"),
    ("do no harm", "no-harm", r"do no harm licen[sc]e"),
    ("ecos", "ecos", r"ecos licen[sc]e"),
    ("educational community", "ecl", r"educational community licen[sc]e"),
    ("eiffel forum", "efl", r"eiffel forum licen[sc]e"),
    ("entessa", "entessa", r"entessa public licen[sc]e"),
    ("erlang", "erlang", r"erlang public licen[sc]e"),
    ("eu datagrid", "eudatagrid", r"eu datagrid software licen[sc]e"),
    ("fair license|fair licence", "fair", r"fair licen[sc]e"),
    ("fair source", "fair-source", r"fair source licen[sc]e"),
    ("functional source", "fsl", r"functional source licen[sc]e"),
    ("frameworx", "frameworx", r"frameworx open licen[sc]e"),
    ("free art", "lal", r"free art licen[sc]e"),
    ("licence art libre", "lal", r"licence art libre"),
    ("freetype", "ftl", r"freetype (?:project )?licen[sc]e"),
    ("giftware", "giftware", r"giftware licen[sc]e"),
    ("gl2ps", "gl2ps", r"gl2ps licen[sc]e"),
    ("good luck", "glwtpl", r"good luck with that public licen[sc]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
    ("historical permission", "hpnd", r"historical permission notice and disclaimer"),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"),
    ("independent jpeg", "ijg", r"independent jpeg group(?: s)?(?: licen[sc]e)?"),
    ("info zip", "info-zip", r"info zip licen[sc]e"),
    ("intel simplified", "issl", r"intel simplified software licen[sc]e"),
    ("interbase", "interbase", r"interbase public licen[sc]e"),
    ("ipa font", "ipa", r"ipa font licen[sc]e"),
    ("jabber", "jabber", r"jabber open source licen[sc]e"),
    ("jasper", "jasper", r"jasper licen[sc]e"),
    ("java research", "jrl", r"java research licen[sc]e"),
    ("knuth", "knuth", r"knuth ctan licen[sc]e"),
    ("leptonica", "leptonica", r"leptonica licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("libtiff", "libtiff", r"libtiff licen[sc]e"),
    ("libre quebec", "liliq", r"licence libre du quebec"),
    ("llama", "llama", r"llama (?:\d )*community licen[sc]e"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("matlab", "matlab", r"matlab central file exchange licen[sc]e"),
    ("microsoft limited", "ms-lpl", r"microsoft limited public licen[sc]e"),
    ("microsoft software terms", "ms-terms", r"microsoft software licen[sc]e terms"),
    ("miros", "miros", r"miros licen[sc]e"),
    ("mit no attribution|mit 0", "mit-0", r"mit (?:no attribution|0)(?: licen[sc]e)?"),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("multics", "multics", r"multics licen[sc]e"),
    ("nasa open", "nasa", r"nasa open source agreement"),
    ("naumen", "naumen", r"naumen public licen[sc]e"),
    ("net snmp", "net-snmp", r"net snmp licen[sc]e"),
    ("netcdf", "netcdf", r"netcdf licen[sc]e"),
    ("nethack", "nethack", r"nethack general public licen[sc]e"),
    ("nokia", "nokia", r"nokia open source licen[sc]e"),
    ("non profit open", "nposl", r"non profit open software licen[sc]e"),
    ("nvidia", "nvidia", r"nvidia (?:open model |source code |software )?licen[sc]e"),
    ("oclc", "oclc", r"oclc research public licen[sc]e"),
    ("open gaming", "ogl-gaming", r"open gaming licen[sc]e"),
    ("open group", "opengroup", r"open group test suite licen[sc]e"),
    ("openldap", "openldap", r"openldap public licen[sc]e"),
    ("open publication", "opl", r"open publication licen[sc]e"),
    ("open rail|openrail", "openrail", r"open ?rail(?: m)? licen[sc]e"),
    ("oracle binary", "oracle-bcl", r"oracle binary code licen[sc]e"),
    ("oracle technology network", "oracle-otn", r"oracle technology network licen[sc]e"),
    ("oset", "oset", r"oset public licen[sc]e"),
    ("parity", "parity", r"parity public licen[sc]e"),
    ("peer production", "ppl", r"peer production licen[sc]e"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("plexus", "plexus", r"plexus classworlds licen[sc]e"),
    ("prosperity", "prosperity", r"prosperity public licen[sc]e"),
    ("python imaging", "pil", r"python imaging library (?:software )?licen[sc]e"),
    ("redis source", "rsal", r"redis source available licen[sc]e"),
    ("ricoh", "rscpl", r"ricoh source code public licen[sc]e"),
    ("rsa md5|rsa message digest", "rsa-md", r"rsa (?:md5|message digest) licen[sc]e"),
    ("sax public", "sax-pd", r"sax public domain notice"),
    ("sendmail", "sendmail", r"sendmail licen[sc]e"),
    ("sgi free", "sgi-b", r"sgi free software licen[sc]e b"),
    ("simple public", "simpl", r"simple public licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("standard ml", "smlnj", r"standard ml of new jersey licen[sc]e"),
    ("sugarcrm", "sugarcrm", r"sugarcrm public licen[sc]e"),
    ("sun binary", "sun-bcl", r"sun binary code licen[sc]e"),
    ("sun industry", "sissl", r"sun industry standards source licen[sc]e"),
    ("watcom", "watcom", r"sybase open watcom public licen[sc]e"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e"),
    ("tcp wrappers", "tcp-wrappers", r"tcp wrappers licen[sc]e"),
    ("timescale", "timescale", r"timescale licen[sc]e"),
    ("tmate", "tmate", r"tmate open source licen[sc]e"),
    ("ubuntu font", "ufl", r"ubuntu font licen[sc]e"),
    ("unity companion", "unity", r"unity companion licen[sc]e"),
    ("vovida", "vsl", r"vovida software licen[sc]e"),
    ("wordnet", "wordnet", r"wordnet licen[sc]e"),
    ("x net", "xnet", r"x net licen[sc]e"),
    ("xerox", "xerox", r"xerox licen[sc]e"),
    ("xfree86", "xfree86", r"xfree86 licen[sc]e"),
    ("yahoo", "ypl", r"yahoo public licen[sc]e"),
    ("zend", "zend", r"zend licen[sc]e"),
    ("zimbra", "zimbra", r"zimbra public licen[sc]e"),
    ("classpath exception", "classpath-exception", r"(?:gnu )?classpath exception"),
    ("gcc runtime exception", "gcc-exception", r"gcc runtime library exception"),
    ("linking exception", "linking-exception", r"(?:static |dynamic )?linking exception"),
    ("font exception", "font-exception", r"gpl font exception"),
    ("autoconf exception", "autoconf-exception", r"autoconf (?:configure )?(?:script )?exception"),
    ("bison exception", "bison-exception", r"bison exception"),
    ("openssl exception", "openssl-exception", r"openssl (?:linking )?exception"),
    ("llvm", "llvm-exception", r"llvm exceptions?"),
    ("end user agreement", "eula", r"end user licen[sc]e agreement"),
)

#: Sentences of notices and grants: keyword, label, pattern.
NOTICES = (
    ("merchantability", "no-warranty", r"(?:without even the )?implied warrant(?:y|ies) of merchantability"),
    ("fitness purpose", "no-warranty", r"fitness for a particular purpose"),
    ("event liable", "no-liability", r"in no event shall (?:the )?(?:authors?|copyright holders?|copyright owners?|regents|contributors)(?: or (?:the )?(?:authors?|copyright holders?|contributors))? be liable"),
    ("above copyright notice", "notice", r"above copyright notice and this permission notice shall be included"),
    ("redistributions retain", "notice", r"redistributions of source code must retain"),
    ("redistributions reproduce", "notice", r"redistributions in binary form must reproduce"),
    ("neither endorse", "bsd-3-clause", r"neither the name of (?:\w+ ){1,8}nor the names of (?:its )?contributors may be used to endorse"),
    ("advertising materials", "bsd-4-clause", r"all advertising materials mentioning features or use of this software"),
    ("compliance with", "apache", r"you may not use this file except in compliance with the licen[sc]e"),
    ("obtain copy", "notice", r"you may obtain a copy of the licen[sc]e at"),
    ("unless applicable", "apache", r"unless required by applicable law or agreed to in writing software"),
    ("free redistribute", "gpl", r"(?:this program|this library|it) is free software you can redistribute it and or modify it"),
    ("should received copy", "gpl", r"you should have received a copy of the gnu(?: (?:lesser|library|affero))? general public licen[sc]e"),
    ("source form subject", "mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("origin misrepresented", "zlib", r"the origin of this software must not be misrepresented"),
    ("altered plainly marked", "zlib", r"altered source versions must be plainly marked as such"),
    ("granted documentation", "hpnd", r"permission to use copy modify and distribute this software and its documentation (?:for any purpose )?(?:and )?(?:without fee )?is hereby granted"),
    ("provided holders contributors", "bsd", r"this software is provided by the copyright holders and contributors as is"),
    ("granted charge organization", "bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("see license file|see licence file", "see-file", r"see (?:the )?licen[sc]e file"),
    ("see copying", "see-file", r"see (?:the )?(?:file )?copying(?: file)?"),
    ("license details|licence details", "see-file", r"licen[sc]e (?:file )?for (?:more )?details"),
    ("trademarks property", "trademark", r"(?:all )?(?:other )?trademarks (?:are|is) (?:the )?property of"),
    ("registered trademark|registered trademarks", "trademark", r"registered trademarks? of"),
    ("personal only", "restricted", r"(?:for )?personal use only"),
    ("commercial only|noncommercial only", "restricted", r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("not for redistribution|not for distribution", "restricted", r"not for (?:re)?distribution"),
    ("do not distribute|do not redistribute", "restricted", r"do not (?:re)?distribute"),
    ("evaluation only", "restricted", r"evaluation (?:use|purposes) only"),
    ("internal only", "restricted", r"internal use only"),
    ("research only", "restricted", r"(?:academic )?research (?:use|purposes) only"),
    ("trade secret|trade secrets", "proprietary", r"trade secrets?"),
    ("confidential", "proprietary", r"confidential (?:and proprietary|information)"),
    ("patent pending|patents pending", "patent", r"patents? pending"),
    ("with permission", "permission", r"(?:used|reprinted|reproduced) (?:here )?with (?:kind )?permission"),
    ("by permission", "permission", r"(?:used|reprinted|reproduced) by (?:kind )?permission"),
    ("copyrighted", "copyright", r"copyrighted (?:material|work|content)"),
    ("copyright by", "copyright", r"copyright (?:c )?(?:\d{4} )?by"),
    ("copyright holder|copyright holders", "copyright", r"copyright holders?"),
    ("source available", "source-available", r"source available(?: licen[sc]e)?"),
    ("royalty free", "royalty-free", r"royalty free(?: licen[sc]e)?"),
    ("share alike|sharealike", "share-alike", r"share ?alike"),
    ("attribution required", "attribution", r"attribution (?:is )?required"),
    ("free personal", "restricted", r"free for personal use"),
    ("commercial license|commercial licence", "commercial", r"commercial licen[sc]e"),
    ("dual licensed|dual licenced", "dual", r"dual licen[sc]ed"),
    ("under license from|under licence from", "sublicensed", r"under licen[sc]e from"),
    ("terms conditions license|terms conditions licence", "terms", r"terms and conditions of (?:the|this) licen[sc]e"),
    ("terms license|terms licence", "terms", r"under the terms of (?:the|this) licen[sc]e"),
    ("license agreement|licence agreement", "agreement", r"licen[sc]e agreement"),
    ("all copyrights", "copyright", r"all copyrights (?:are )?(?:acknowledged|reserved)"),
    ("moral right|moral rights", "moral-rights", r"moral rights? (?:of|has|have)"),
    ("crown copyright", "crown", r"crown copyright"),
    ("public domain", "public-domain", r"(?:placed|is) in the public domain"),
    ("copyright expired", "public-domain", r"copyright (?:has |have )?expired"),
    ("fair use", "fair-use", r"fair use (?:notice|policy|doctrine)"),
    ("takedown", "dmca", r"(?:dmca )?takedown (?:notice|request)s?"),
)


def rules() -> list[Rule]:
    """All rules, in their order: hand-written ones, and each family's name with each of its versions and without."""
    found: list[Rule] = []
    for keyword, label, names, versions in FAMILIES:
        for name in names:
            found += [Rule(keyword, f"{label}-{v}", 3, f"{name} (?:licen[sc]e )?{_version(v)}") for v in versions]
        if len(names[0]) > 5:
            found.append(Rule(keyword, label, 2, names[0]))
    for keyword, label, name in GNU:
        for v in GNU_VERSIONS[label]:
            found.append(Rule(keyword, f"{label}-{v}-or-later", 3, rf"{name} (?:as published by the free software foundation )?(?:either )?{_version(v)}(?: of the licen[sc]e)? or (?:\(at your option\) )?(?:at your option )?(?:any )?later(?: version)?"))
            found.append(Rule(keyword, f"{label}-{v}", 3, f"{name} {_version(v)}(?: only)?"))
        found.append(Rule(keyword, label, 2, name))
    for part, short, long in CC_PARTS:
        for v in CC_VERSIONS:
            found.append(Rule("cc by", f"cc-{part}-{v}", 3, f"cc {short} {_version(v)}"))
            found.append(Rule("creative commons", f"cc-{part}-{v}", 3, f"creative commons {long}(?: international| unported)?(?: licen[sc]e)? {_version(v)}(?: international| unported| generic)?(?: licen[sc]e)?"))
            found.append(Rule("creativecommons", f"cc-{part}-{v}", 3, f"creativecommons org licenses {short} {_version(v)}"))
        found.append(Rule("cc by", f"cc-{part}", 2, f"cc {short}"))
        found.append(Rule("creative commons", f"cc-{part}", 2, f"creative commons {long}(?: licen[sc]e)?"))
    found += [Rule(keyword, label, 2, pattern) for keyword, label, pattern in NAMED]
    return found + list(SINGLE) + [Rule(keyword, label, 1, pattern) for keyword, label, pattern in NOTICES]


def gate_of(rule: Rule) -> list[list[str]]:
    """Alternatives of words, all of which must stand in a text; no alternative asks for nothing."""
    return [x.split() for x in rule.keyword.split("|")] if rule.keyword else []


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", book: list[Rule] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for each row.

    ``matches`` lists what was not suppressed as (first word, last word, label, priority). A null text is empty and has
    no words; texts of any length are scanned whole. Rows with equal ids, or a null id, are scanned each for itself, and
    so are repeated rows. Only the two columns named are read, so others may have any name; an empty table gives an
    empty result.
    """
    book, base = rules() if book is None else book, BASE if base is None else base
    norm = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAPS, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm")).withColumn("row", F.monotonically_increasing_id())
    # Lower-casing of a text of single bytes is that of A-Z.
    exact = F.when(F.octet_length("norm") == F.length("norm"), F.lower("norm")).otherwise(F.translate("norm", UPPER, LOWER))
    rows = rows.select("row", "id", F.split(F.concat(F.lit(" "), exact, F.lit(" ")), " ").alias("words"))
    n_words = F.greatest(F.size("words") - F.when(F.get("words", F.lit(1)) == "", 3).otherwise(2), F.lit(0)).cast("long")
    # Which of all keywords' words stand in the text, by one pass over its words.
    asked = sorted({w for r in book for alternative in gate_of(r) for w in alternative} | {w for phrase in base for w in phrase.split(" ")})
    rows = rows.select("row", "id", n_words.alias("n_words"), "words", F.array_intersect("words", F.lit(asked) if asked else F.array().cast("array<string>")).alias("present"))
    here = lambda w: F.array_contains("present", w)
    phrases = [_all([F.array_contains("present", F.lit(w)) for w in phrase.split(" ")]) for phrase in base]
    gates = sorted({tuple(alternative) for r in book for alternative in gate_of(r)})
    # Rows are live if one rule or phrase can match; only their text is put together again.
    single = sorted({g[0] for g in gates if len(g) == 1})
    live = F.lit(any(not gate_of(r) for r in book))
    if single:
        live = live | F.arrays_overlap("present", F.lit(single))
    for g in [F.forall(F.lit(list(g)), here) for g in gates if len(g) > 1 and not set(g) & set(single)] + phrases:
        live = live | g
    rows = rows.select("row", "id", "n_words", "present", F.when(live, F.col("words")).alias("words")).withColumn("text", F.array_join("words", " "))

    def stands(parts: list[str]):
        # The text's words stand from the second place on, so that places count from 1 and words from 0.
        return lambda i: _all([F.get(F.col("words"), i + k) == p for k, p in enumerate(parts)])

    def placed(label: str, n: int):
        return lambda i: F.struct((i - 1).cast("long").alias("a"), (i + (n - 2)).cast("long").alias("z"), F.lit(label).alias("label"))

    places = []
    for phrase, label in base.items():
        parts = phrase.split(" ")
        found = F.when(F.col("text").contains(f" {phrase} "), F.filter(F.sequence(F.lit(1), F.size("words") - 1), stands(parts)))
        places.append(F.transform(F.coalesce(found, F.array().cast("array<int>")), placed(label, len(parts))))

    # No array constructor per row: the rules are one literal.
    quoted = lambda words: "array(" + ",".join(map(_quoted, words)) + ")"
    table = F.expr("array(" + ",".join(f"named_struct('gate',array({','.join(quoted(g) for g in gate_of(r) or [[]])}),'label',{_quoted(r.label)},'priority',{r.priority},'rule',{i},'pattern',{_quoted(' ' + r.pattern.strip() + '(?= )')})" for i, r in enumerate(book)) + ")") if book else None
    kind = "array<struct<a:bigint,z:bigint,label:string,priority:int,rule:int>>"
    if book:
        able = F.filter(table, lambda r: F.exists(r["gate"], lambda g: F.forall(g, here)))
        live = F.filter(able, lambda r: F.rlike(F.col("text"), r["pattern"]))

        def spans(r: Column) -> Column:
            # Marks before and after each match, then its words by the places of the marks.
            tokens = F.split(F.regexp_replace(F.col("text"), r["pattern"], F.lit("\x01$0\x02")), F.lit(" "))
            marks = lambda c: F.filter(F.transform(tokens, lambda t, i: F.when(F.contains(t, F.lit(c)), i)), lambda i: i.isNotNull())
            return F.transform(F.arrays_zip(marks("\x01").alias("a"), marks("\x02").alias("z")), lambda m: F.struct(m["a"].cast("long").alias("a"), (m["z"] - 1).cast("long").alias("z"), r["label"].alias("label"), r["priority"].alias("priority"), r["rule"].alias("rule")))

        matches = F.when(F.col("text").isNotNull(), F.flatten(F.transform(live, spans))).cast(kind)
    else:
        matches = F.lit(None).cast(kind)
    found = rows.select("row", "id", "n_words", F.when(F.col("text").isNotNull(), F.concat(*places)).alias("places"), matches.alias("matches"))
    # One row per match; a running maximum over ends tells which ones an earlier start of enough priority contains.
    flat = found.select("row", "id", "n_words", "places", F.explode_outer("matches").alias("m")).select("row", "id", "n_words", "places", "m.*")
    order = Window.partitionBy("row").orderBy("a", F.desc("z"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for p in sorted({r.priority for r in book}):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("z"))).over(order)).otherwise(reach)
    kept = flat.withColumn("reach", reach).withColumn("kept", F.col("a").isNotNull() & (F.col("reach").isNull() | (F.col("reach") < F.col("z"))))
    own = F.when(F.col("kept"), F.struct("a", "z", "label", "priority"))
    grouped = kept.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("places").alias("places"), F.sort_array(F.collect_list(own)).alias("matches"))
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.col("places")["label"], F.array().cast("array<string>"))))
    labels = F.array_sort(F.array_union(base_labels, F.col("matches")["label"]))
    score = F.greatest(F.when(F.size(base_labels) > 0, F.lit(BASE_SCORE)).otherwise(0.0), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.array_max(F.col("matches")["priority"])), F.lit(0.0)))
    return grouped.select(
        "id",
        "n_words",
        F.greatest(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.col("places")["a"]).alias("first_word"),
        F.array_max(F.col("places")["a"]).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "matches",
    )


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
