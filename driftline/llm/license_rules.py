"""Signature rules of licences, in the order they are tried.

A rule is a regular expression over the normalised words of a text, joined by
single spaces. It is tried only on texts that hold a word of each of its keyword
sets. Names of
licences are combined with the ways in which texts state one; the other rules
are worded after the texts, file headers, exceptions and notices themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    confidence: float
    keywords: tuple[frozenset[bytes], ...]
    pattern: re.Pattern[bytes]


#: Phrases whose places are reported for every text, and their labels.
BASE = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

#: Licence, the expression of its name, words that any text with that name holds (``a|b``: one of them)
#: and the words of its tag. "bare" marks names that say enough by themselves.
LICENSES = [
    ("mit", r"mit(?: x11)?", "mit", "mit", ""),
    ("mit-0", r"mit no attribution|mit 0", "mit", "mit 0", ""),
    ("expat", r"expat", "expat", "expat", ""),
    ("apache-2", r"apache(?: software)?(?: license| licence)?(?: version)? 2(?: 0)?", "apache 2", "apache 2 0", ""),
    ("apache-1.1", r"apache(?: software)?(?: license| licence)?(?: version)? 1 1", "apache 1", "apache 1 1", ""),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?2(?: 0)?", "gpl|gpl2|gplv2|general", "gpl 2 0", "bare"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?3(?: 0)?", "gpl|gpl3|gplv3|general", "gpl 3 0", "bare"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?2 1", "lgpl|lgpl2|lgplv2|lesser", "lgpl 2 1", "bare"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?3(?: 0)?", "lgpl|lgpl3|lgplv3|lesser", "lgpl 3 0", "bare"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?v?3(?: 0)?", "agpl|agpl3|agplv3|affero", "agpl 3 0", "bare"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license(?: version)? 1 3", "free documentation", "gfdl 1 3", "bare"),
    ("bsd-2-clause", r"(?:simplified |freebsd |2 clause |two clause )bsd|bsd (?:2|two) clause", "bsd", "bsd 2 clause", ""),
    ("bsd-3-clause", r"(?:new |modified |revised |3 clause |three clause )bsd|bsd (?:3|three) clause", "bsd", "bsd 3 clause", ""),
    ("bsd-4-clause", r"(?:original |4 clause |four clause )bsd|bsd (?:4|four) clause", "bsd", "bsd 4 clause", ""),
    ("0bsd", r"(?:zero clause |0 clause )bsd|0bsd", "0bsd|bsd", "0bsd", ""),
    ("isc", r"isc", "isc", "isc", ""),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version| v)? ?v?1 1", "mpl|mpl1|mplv1|mozilla", "mpl 1 1", "bare"),
    ("mpl-2.0", r"(?:mozilla public license|mpl)(?: version| v)? ?v?2(?: 0)?", "mpl|mpl2|mplv2|mozilla", "mpl 2 0", "bare"),
    ("epl-1.0", r"(?:eclipse public license|epl)(?: version| v)? ?v?1(?: 0)?", "epl|epl1|eplv1|eclipse", "epl 1 0", "bare"),
    ("epl-2.0", r"(?:eclipse public license|epl)(?: version| v)? ?v?2(?: 0)?", "epl|epl2|eplv2|eclipse", "epl 2 0", "bare"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?v?1 2", "eupl|eupl1|euplv1|european", "eupl 1 2", "bare"),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?: version| v)? ?v?1(?: 0)?", "cddl|cddl1|cddlv1|distribution", "cddl 1 0", "bare"),
    ("cpl-1.0", r"common public license(?: version)? 1(?: 0)?", "common public", "cpl 1 0", "bare"),
    ("artistic-2.0", r"artistic license(?: version)? 2(?: 0)?", "artistic", "artistic 2 0", "bare"),
    ("bsl-1.0", r"boost software license(?: version)? 1(?: 0)?", "boost software", "bsl 1 0", "bare"),
    ("busl-1.1", r"business source license(?: version)? 1 1", "business source", "busl 1 1", "bare"),
    ("zlib", r"zlib(?: libpng)?", "zlib", "zlib", ""),
    ("unlicense", r"unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", "wtfpl|fuck", "wtfpl", "bare"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)? 1 1", "open font", "ofl 1 1", "bare"),
    ("odbl-1.0", r"(?:odc )?open (?:data commons )?(?:open )?database license(?: version)?(?: 1 0)?", "database", "odbl 1 0", "bare"),
    ("ms-pl", r"microsoft public license", "microsoft public", "ms pl", "bare"),
    ("postgresql", r"postgresql", "postgresql", "postgresql", ""),
    ("python-2.0", r"python software foundation license(?: version 2)?", "python foundation", "python 2 0", "bare"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", "ncsa", ""),
    ("upl-1.0", r"universal permissive license(?: version)?(?: 1 0)?", "universal permissive", "upl 1 0", "bare"),
    ("cc0-1.0", r"(?:creative commons |cc )(?:zero|cc0|0)(?: 1 0)?(?: universal)?|cc0(?: 1 0)?", "cc0|cc|creative", "cc0 1 0", "bare"),
    ("cc-by", r"(?:creative commons attribution|cc by)(?: [1-4] [05])?(?! (?:nc|nd|sa|non|no|share))(?: international| unported)?", "cc|creative", "cc by 4 0", "bare"),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported)?", "cc|creative", "cc by sa 4 0", "bare"),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1-4] [05])?(?: international| unported)?", "cc|creative", "cc by nd 4 0", "bare"),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?(?! (?:nd|sa|no|share))(?: international| unported)?", "cc|creative", "cc by nc 4 0", "bare"),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?(?: international| unported)?", "cc|creative", "cc by nc sa 4 0", "bare"),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1-4] [05])?(?: international| unported)?", "cc|creative", "cc by nc nd 4 0", "bare"),
]

#: The ways of stating a licence: priority, confidence, words that must be there, expression around the name.
STATEMENTS = [
    (5, 1.0, "spdx identifier", r"spdx licen[sc]e identifier {tag}"),
    (4, 0.95, "under", r"(?:(?:this|the) \w+ (?:is|are) )?(?:made )?(?:licen[sc]ed|relicensed|released|distributed|redistributed|published|provided|available|offered|covered|shared|used|usable) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?: (?:software )?(?:public )?licen[sc]e)?(?: version \d+(?: \d+)?)?"),
    (4, 0.9, "subject", r"subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?: licen[sc]e)?"),
    (3, 0.8, "license|licence", r"(?:the )?(?:{name}) (?:style |type )?licen[sc]e(?: agreement)?"),
    (3, 0.85, "license|licence", r"licen[sc]e (?:is )?(?:the )?(?:{name})"),
    (2, 0.6, "", r"(?:{name})"),
]

#: Rules from how licences, their headers, exceptions and notices are worded: priority, confidence, label, words, expression.
SINGLE = [
    (4, 0.9, "mit", "permission granted charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (3, 0.7, "mit", "portions notice software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (2, 0.5, "mit", "merchantability noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    (4, 0.9, "x11", "consortium advertising", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    (4, 0.9, "isc", "permission fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    (3, 0.7, "isc", "disclaims warranties author", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    (4, 0.9, "hpnd", "permission documentation fee", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that"),
    (4, 0.9, "ntp", "permission documentation fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    (4, 0.9, "tcl", "authors license documentation", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    (4, 0.9, "bsd-3-clause", "neither endorse", r"neither the name of .{1,120}? may be used to endorse or promote products"),
    (3, 0.8, "bsd-2-clause", "redistribution permitted", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (2, 0.6, "bsd-2-clause", "redistributions retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (2, 0.6, "bsd-2-clause", "redistributions reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    (4, 0.9, "bsd-4-clause", "advertising acknowledgement|acknowledgment", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (4, 0.9, "bsd-3-clause-clear", "patent granted", r"no express or implied licenses to any party s patent rights are granted by this license"),
    (4, 0.9, "bsd-2-clause-patent", "receiving contributor", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license"),
    (4, 0.9, "sleepycat", "accompanied obtain complete", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    (4, 0.9, "zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    (3, 0.7, "zlib", "altered plainly", r"altered source versions must be plainly marked as such"),
    (3, 0.7, "zlib", "held liable damages", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    (4, 0.9, "bsl-1.0", "organization accompanying", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (4, 0.9, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (3, 0.7, "unlicense", "anyone compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    (3, 0.8, "wtfpl", "fuck", r"you just do what the fuck you want to"),
    (4, 0.9, "beerware", "retain whatever stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    (4, 0.9, "json", "good evil used", r"the software shall be used for good not evil"),
    (4, 0.9, "blessing", "forgiveness forgive", r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    (4, 0.9, "fair", "instrument retained", r"usage of the works is permitted provided that this instrument is retained with the works"),
    (4, 0.9, "fsfap", "medium royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    (4, 0.9, "fsful", "configure unlimited", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it"),
    (4, 0.9, "gnu-all-permissive", "verbatim article", r"verbatim copying and distribution of this entire article (?:is|are) permitted"),
    (4, 0.9, "apache-2", "compliance license", r"you may not use this (?:file|software|work) except in compliance with the license"),
    (3, 0.8, "apache-2", "basis agreed writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (3, 0.8, "apache-2", "apache org", r"(?:www )?apache org licenses license 2 0"),
    (3, 0.8, "apache-1.1", "apache product includes", r"this product includes software developed by the apache (?:software foundation|group)"),
    (4, 0.9, "gpl", "redistribute gnu program", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (3, 0.8, "gpl", "received gnu general", r"you should have received a copy of the gnu general public license"),
    (2, 0.6, "gpl", "gnu general details", r"see the gnu general public license for more details"),
    (4, 0.9, "lgpl", "redistribute gnu library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (3, 0.8, "lgpl", "received gnu lesser|library", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    (2, 0.6, "lgpl", "lesser details", r"see the gnu lesser general public license for more details"),
    (3, 0.8, "lgpl-2.0", "gnu library general", r"gnu library general public license(?: version 2(?: 0)?)?"),
    (3, 0.8, "agpl", "received affero", r"you should have received a copy of the gnu affero general public license"),
    (3, 0.8, "agpl", "interacting network remotely", r"all users interacting with it remotely through a computer network"),
    (3, 0.8, "gpl-2.0-or-later", "license later version", r"(?:either )?version 2 of the license or (?:at your option )?any later version"),
    (3, 0.8, "gpl-3.0-or-later", "license later version", r"(?:either )?version 3 of the license or (?:at your option )?any later version"),
    (3, 0.8, "lgpl-2.1-or-later", "license later version", r"(?:either )?version 2 1 of the license or (?:at your option )?any later version"),
    (3, 0.8, "gpl-2.0-only", "published foundation version", r"gnu general public license version 2 as published by the free software foundation"),
    (3, 0.8, "gpl-1.0", "general public", r"(?:gnu )?general public license version 1(?: 0)?"),
    (4, 0.9, "classpath-exception", "link independent modules", r"give you permission to link this library with independent modules to produce an executable"),
    (4, 0.9, "gcc-exception", "gcc runtime exception", r"gcc runtime library exception(?: version 3 1)?"),
    (4, 0.9, "openssl-exception", "exception|permission openssl portions", r"permission to link the code of portions of this program with the openssl library"),
    (4, 0.9, "font-exception", "font embed", r"if you create a document which uses this font and embed this font"),
    (4, 0.9, "autoconf-exception", "configuration autoconf", r"part of a program that contains a configuration script generated by autoconf"),
    (4, 0.9, "bison-exception", "bison skeleton", r"create a larger work that contains part or all of the bison parser skeleton"),
    (4, 0.9, "libtool-exception", "libtool built", r"part of a program or library that is built using gnu libtool"),
    (4, 0.9, "llvm-exception", "llvm exception|exceptions", r"apache license v?(?:ersion )?2 0 with llvm exceptions?"),
    (4, 0.9, "linux-syscall-note", "kernel services", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    (4, 0.9, "gfdl", "document modify documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (3, 0.7, "gfdl", "invariant texts", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    (4, 0.9, "mpl-1.1", "contents mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    (4, 0.9, "mpl-2.0", "form mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (3, 0.8, "mpl-2.0", "mpl obtain", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    (4, 0.9, "mpl-2.0-no-copyleft-exception", "incompatible secondary", r"this source code form is incompatible with secondary licenses"),
    (3, 0.8, "npl-1.1", "netscape public", r"netscape public license(?: version 1 [01])?"),
    (4, 0.9, "epl", "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (3, 0.8, "edl-1.0", "eclipse distribution", r"eclipse distribution license(?: v(?:ersion)? ?1 0)?"),
    (4, 0.9, "cddl", "opensolaris", r"you can obtain a copy of the license at usr src opensolaris license"),
    (3, 0.8, "cddl", "cddl header covered", r"when distributing covered code include this cddl header notice"),
    (3, 0.8, "ipl-1.0", "ibm public", r"ibm public license(?: version 1 0)?"),
    (3, 0.8, "cpal-1.0", "attribution common public", r"common public attribution license(?: version 1 0)?"),
    (4, 0.9, "artistic-1.0", "intent package copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    (3, 0.8, "artistic-1.0", "clarified artistic", r"clarified artistic license"),
    (3, 0.8, "perl", "same perl", r"(?:under )?the same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)?(?: itself)?"),
    (3, 0.8, "ruby", "same ruby", r"(?:under )?the same (?:terms|license) as ruby(?: itself)?"),
    (3, 0.8, "php-3.01", "php version", r"subject to version 3 (?:0|01) of the php license"),
    (3, 0.8, "zend-2.0", "zend license", r"subject to version 2 00 of the zend license"),
    (4, 0.9, "python-2.0", "psf licensee", r"psf is making python available to licensee on an as is basis"),
    (3, 0.8, "cnri-python", "cnri agreement", r"cnri (?:open source )?(?:python )?license agreement"),
    (4, 0.9, "openssl", "openssl project includes", r"this product includes software developed by the openssl project"),
    (4, 0.9, "ssleay", "cryptographic eric", r"this product includes cryptographic software written by eric young"),
    (4, 0.9, "libpng", "png reference", r"the png reference library is supplied as is"),
    (4, 0.9, "ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    (4, 0.9, "ftl", "freetype portions", r"portions of this software are copyright .{1,60}? the freetype project"),
    (3, 0.8, "curl", "curl license", r"(?:the )?curl license"),
    (3, 0.8, "vim", "vim license", r"(?:the )?vim license"),
    (4, 0.9, "info-zip", "info zip", r"(?:version \d+ \w+ \d+ of the )?info zip (?:copyright and )?license"),
    (4, 0.9, "bzip2", "bzip2 libbzip2", r"this program bzip2 the associated library libbzip2"),
    (3, 0.8, "w3c", "w3c software", r"w3c software (?:and document )?(?:notice and )?license"),
    (3, 0.8, "w3c-document", "w3c document", r"w3c document license"),
    (4, 0.9, "unicode", "unicode data", r"unicode inc license agreement data files and software"),
    (3, 0.8, "icu", "icu license", r"icu license(?: icu 1 8 1 and later)?"),
    (4, 0.9, "nist", "standards developed institute", r"this software was developed at the national institute of standards and technology"),
    (3, 0.8, "nasa-1.3", "nasa agreement", r"nasa open source agreement(?: version 1 3)?"),
    (4, 0.9, "us-government-work", "government copyright", r"works? of the (?:united states|u s) government and (?:is|are) not subject to (?:domestic )?copyright"),
    (3, 0.8, "lppl-1.3", "latex project", r"latex project public license(?: version 1 3[ac]?)?"),
    (3, 0.8, "cecill", "cecill", r"cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?(?: version 2 [01])?"),
    (3, 0.8, "osl-3.0", "open software", r"open software license(?: version| v)? 3 0"),
    (3, 0.8, "afl-3.0", "academic free", r"academic free license(?: version| v)? 3 0"),
    (3, 0.8, "ecl-2.0", "educational community", r"educational community license(?: version 2 0)?"),
    (3, 0.8, "qpl-1.0", "q public", r"q public license(?: version 1 0)?"),
    (3, 0.8, "zpl-2.1", "zope public", r"zope public license(?: version 2 1)?"),
    (3, 0.8, "oldap-2.8", "openldap public", r"openldap public license(?: version 2 8)?"),
    (3, 0.8, "rpl-1.5", "reciprocal public", r"reciprocal public license(?: version 1 5)?"),
    (3, 0.8, "ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    (3, 0.8, "ms-eula", "microsoft terms", r"microsoft software license terms"),
    (3, 0.8, "apsl-2.0", "apple source", r"apple public source license(?: version 2 0)?"),
    (3, 0.8, "sissl", "sun industry", r"sun industry standards source license"),
    (3, 0.8, "sun-bcl", "sun binary", r"sun (?:microsystems inc )?binary code license(?: agreement)?"),
    (3, 0.8, "otn", "oracle network", r"oracle technology network license agreement"),
    (3, 0.8, "nftc", "oracle fee", r"oracle no fee terms and conditions"),
    (3, 0.8, "efl-2.0", "eiffel forum", r"eiffel forum license(?: version 2)?"),
    (3, 0.8, "watcom-1.0", "watcom", r"sybase open watcom public license(?: version 1 0)?"),
    (3, 0.8, "miros", "miros", r"(?:the )?miros licen[cs]e"),
    (3, 0.8, "mulanpsl-2.0", "mulan", r"mulan (?:psl v ?2|permissive software license(?: version)? v?2)"),
    (3, 0.8, "blueoak-1.0.0", "oak model", r"blue oak model license(?: 1 0 0)?"),
    (3, 0.8, "eudatagrid", "datagrid", r"eu datagrid software license"),
    (3, 0.8, "intel-simplified", "intel simplified", r"intel simplified software license"),
    (3, 0.8, "nvidia-eula", "nvidia", r"nvidia (?:software )?(?:end user )?license agreement"),
    (3, 0.8, "hippocratic", "hippocratic", r"hippocratic license(?: version)?(?: [123] [0-9])?"),
    (3, 0.8, "anti-996", "996", r"anti 996 license(?: version 1 0)?"),
    (4, 0.9, "commons-clause", "grant sell", r"the license does not include and the license does not grant to you the right to sell the software"),
    (3, 0.8, "sspl-1.0", "server side", r"server side public license(?: version 1)?"),
    (3, 0.8, "elastic-2.0", "elastic license", r"elastic license(?: version)?(?: 2 0)?"),
    (3, 0.8, "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter) license(?: 1 0 [01])?"),
    (3, 0.8, "busl", "change date license", r"change date .{1,60}? change license"),
    (3, 0.8, "confluent-community", "confluent community", r"confluent community license(?: agreement)?"),
    (3, 0.8, "redis-source-available", "redis source", r"redis source available license(?: agreement)?"),
    (4, 0.9, "cc", "work creative commons", r"this work is licensed under a creative commons"),
    (3, 0.8, "cc-by-sa", "attribution sharealike international|unported", r"attribution sharealike [1-4] 0 (?:international|unported)"),
    (3, 0.8, "cc-by-nc", "attribution noncommercial international|unported", r"attribution noncommercial [1-4] 0 (?:international|unported)"),
    (3, 0.8, "cc-by-nc-sa", "attribution noncommercial sharealike", r"attribution noncommercial sharealike [1-4] 0"),
    (3, 0.8, "cc-by-nc-nd", "attribution noncommercial noderivatives|noderivs", r"attribution noncommercial noderiv(?:ative)?s [1-4] 0"),
    (4, 0.9, "cc0-1.0", "extent possible", r"to the extent possible under law .{1,80}? has (?:dedicated|waived) all copyright"),
    (2, 0.6, "cc0-1.0", "no rights reserved", r"no rights reserved"),
    (3, 0.8, "cc-pdm", "public domain mark", r"public domain mark(?: 1 0)?"),
    (3, 0.8, "odc-by-1.0", "commons attribution open", r"open data commons attribution license(?: v1 0)?"),
    (3, 0.8, "pddl-1.0", "domain dedication", r"(?:open data commons )?public domain dedication and license"),
    (3, 0.8, "ogl-uk-3.0", "government open", r"open government licen[cs]e(?: v?3 0)?"),
    (3, 0.8, "cdla-permissive", "community agreement permissive", r"community data license agreement permissive(?: version [12] 0)?"),
    (3, 0.8, "cdla-sharing", "community agreement sharing", r"community data license agreement sharing(?: version 1 0)?"),
    (3, 0.8, "etalab-2.0", "licence ouverte", r"licence ouverte(?: 2 0)?"),
    (3, 0.8, "dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    (4, 0.9, "ofl-1.1", "font sil", r"this font software is licensed under the sil open font license"),
    (3, 0.8, "ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e(?: version 1 0)?"),
    (4, 0.9, "bitstream-vera", "fonts font", r"fonts accompanying this license fonts and associated documentation files the font software"),
    (3, 0.8, "gust-font", "gust font", r"gust font licen[cs]e"),
    (3, 0.8, "openrail", "openrail|rail", r"(?:(?:creativeml|bigscience|bigcode) )?open ?rail(?: m)?(?: licen[cs]e)?(?: v1)?"),
    (3, 0.8, "llama-community", "llama community", r"(?:meta )?llama [234](?: [0-9])? community license(?: agreement)?"),
    (3, 0.8, "gemma-terms", "gemma terms", r"gemma terms of use"),
    (3, 0.8, "falcon", "falcon license", r"(?:tii )?falcon(?: 180b)? (?:tii )?license"),
    (3, 0.7, "research-only", "research purposes|use only", r"for (?:non ?commercial )?research (?:purposes|use) only"),
    (3, 0.7, "non-commercial", "commercial purposes|use", r"(?:free )?for (?:personal and )?non commercial (?:use|purposes) only"),
    (3, 0.7, "personal-use", "personal only", r"for personal (?:and private )?use only"),
    (3, 0.8, "proprietary", "proprietary confidential", r"(?:this (?:software|file|document) is )?proprietary and confidential"),
    (3, 0.8, "proprietary", "unauthorized|unauthorised prohibited", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    (3, 0.8, "proprietary", "copied|reproduced|distributed|transmitted written", r"(?:may|shall) not be (?:copied|reproduced|distributed|transmitted) .{0,80}?without (?:the )?(?:express |prior )*written (?:permission|consent)"),
    (3, 0.8, "proprietary", "trade secret|secrets", r"contains (?:confidential )?(?:information and )?trade secrets? (?:of|belonging to)"),
    (3, 0.7, "eula", "end user agreement", r"end user licen[sc]e agreement"),
    (2, 0.6, "freeware", "freeware", r"(?:this (?:software|program) is )?freeware"),
    (2, 0.6, "shareware", "shareware", r"(?:this (?:software|program) is )?shareware"),
    (2, 0.6, "evaluation", "evaluation purposes|use|license", r"(?:for evaluation (?:purposes|use) only|evaluation license)"),
    (3, 0.8, "dual-license", "either|dual", r"(?:dual licen[sc]ed (?:under|as)|licen[sc]ed under either of)"),
    (2, 0.5, "dual-license", "option|choice either|any licenses|licences", r"at your (?:option|choice) (?:either|any) of the (?:following )?licen[sc]es"),
    (2, 0.5, "see-license", "license|licence|copying see", r"see (?:the )?(?:accompanying )?(?:file )?(?:licen[sc]e|copying)(?: file| txt| md| rst)? (?:file )?for (?:details|more details|more information|licen[sc]e details|the full licen[sc]e(?: text)?|terms)"),
    (2, 0.5, "third-party-notices", "third notices", r"third party (?:software )?(?:licenses and )?notices"),
    (3, 0.8, "public-domain", "public domain", r"(?:dedicated|released|placed|put) (?:in|into|to) the public domain"),
    (2, 0.6, "public-domain", "public domain", r"(?:is|are) in the public domain"),
    (2, 0.6, "public-domain", "disclaim|disclaims copyright", r"the authors? (?:hereby )?disclaims? (?:all )?copyright to this source code"),
    (2, 0.6, "copyleft-next", "copyleft next", r"copyleft next(?: 0 3 [01])?"),
    (2, 0.5, "no-license", "license|licence without|no", r"(?:without|no) (?:any )?licen[sc]e (?:is )?(?:granted|given)"),
    (1, 0.5, "all-rights-reserved", "rights reserved", r"all rights reserved"),
]


def _rule(number: int, priority: int, confidence: float, label: str, words: str, expression: str) -> Rule:
    keywords = tuple(frozenset(w.encode() for w in word.split("|")) for word in words.split())
    return Rule(number, label, priority, confidence, keywords, re.compile(f"(?<= )(?:{expression})(?= )".encode()))


def _rules() -> tuple[Rule, ...]:
    made = []
    for (priority, confidence, words, around), (label, name, held, tag, kind) in product(STATEMENTS, LICENSES):
        if around == r"(?:{name})" and kind != "bare":
            continue
        by_tag = "{tag}" in around
        expression = around.replace("{name}", name).replace("{tag}", f"{tag}(?: or later| only)?")
        made.append((priority, confidence, label, f"{words} {tag if by_tag else held}", expression))
    made += SINGLE
    rules = [_rule(number, *values) for number, values in enumerate(made)]
    return tuple(sorted(rules, key=lambda r: (-r.priority, r.number)))


#: All rules, first those of the highest priority.
RULES = _rules()
