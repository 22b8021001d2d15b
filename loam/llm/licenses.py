"""License scans by ordered signature rules (operator 6).

A rule is a regular expression over the document's words joined by single spaces, with a keyword that must be among
the words before the expression is tried, a priority and a label. ``BODIES`` and ``NOTICES`` have signatures of license
bodies, notices, short declarations and addresses, written one by one, and ``FAMILIES`` has names, laid out by version and form
(name with version, "or later", joined short form, identifier line, "licensed under", name alone), some hundreds in all.
Overlapping detections are resolved by priority: a detection inside the interval of one of higher priority, or of the
same priority and greater length, is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, rows_of, tune
from .decontamination import words

# Fixed values of the base contract: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> (keyword, names, versions). The keyword is one word that every form of the name contains.
FAMILIES: dict[str, tuple[str, list[str], list[str]]] = {
    "gpl": ("general", ["gnu general public licen[sc]e", "general public licen[sc]e"], ["1.0", "2.0", "3.0"]),
    "gpl-short": ("gpl", ["gnu gpl", "gpl"], ["1.0", "2.0", "3.0"]),
    "lgpl": ("lesser", ["gnu lesser general public licen[sc]e", "lesser general public licen[sc]e"], ["2.1", "3.0"]),
    "lgpl-library": ("library", ["gnu library general public licen[sc]e", "library general public licen[sc]e"], ["2.0"]),
    "lgpl-short": ("lgpl", ["gnu lgpl", "lgpl"], ["2.0", "2.1", "3.0"]),
    "agpl": ("affero", ["gnu affero general public licen[sc]e", "affero general public licen[sc]e"], ["1.0", "3.0"]),
    "agpl-short": ("agpl", ["gnu agpl", "agpl"], ["1.0", "3.0"]),
    "gfdl": ("documentation", ["gnu free documentation licen[sc]e", "free documentation licen[sc]e"], ["1.1", "1.2", "1.3"]),
    "apache": ("apache", ["apache software licen[sc]e", "apache licen[sc]e"], ["1.0", "1.1", "2.0"]),
    "mit": ("mit", ["mit licen[sc]e", "expat mit licen[sc]e"], []),
    "bsd-2-clause": ("bsd", ["bsd 2 clause(?: licen[sc]e)?", "two clause bsd(?: licen[sc]e)?", "simplified bsd(?: licen[sc]e)?"], []),
    "bsd-3-clause": ("bsd", ["bsd 3 clause(?: licen[sc]e)?", "three clause bsd(?: licen[sc]e)?", "new bsd(?: licen[sc]e)?", "modified bsd(?: licen[sc]e)?"], []),
    "bsd-4-clause": ("bsd", ["bsd 4 clause(?: licen[sc]e)?", "four clause bsd(?: licen[sc]e)?", "original bsd(?: licen[sc]e)?"], []),
    "bsd": ("bsd", ["bsd licen[sc]e", "bsd style licen[sc]e"], []),
    "isc": ("isc", ["isc licen[sc]e"], []),
    "zlib": ("zlib", ["zlib licen[sc]e", "zlib libpng licen[sc]e"], []),
    "mpl": ("mozilla", ["mozilla public licen[sc]e"], ["1.0", "1.1", "2.0"]),
    "mpl-short": ("mpl", ["mpl"], ["1.0", "1.1", "2.0"]),
    "epl": ("eclipse", ["eclipse public licen[sc]e"], ["1.0", "2.0"]),
    "edl": ("eclipse", ["eclipse distribution licen[sc]e"], ["1.0"]),
    "cddl": ("common", ["common development and distribution licen[sc]e"], ["1.0", "1.1"]),
    "cpl": ("common", ["common public licen[sc]e"], ["1.0"]),
    "eupl": ("european", ["european union public licen[sc]e"], ["1.0", "1.1", "1.2"]),
    "cecill": ("cecill", ["cecill(?: free software)?(?: licen[sc]e)?"], ["1.0", "2.0", "2.1"]),
    "artistic": ("artistic", ["artistic licen[sc]e"], ["1.0", "2.0"]),
    "boost": ("boost", ["boost software licen[sc]e"], ["1.0"]),
    "openssl": ("openssl", ["openssl licen[sc]e"], []),
    "postgresql": ("postgresql", ["postgresql licen[sc]e"], []),
    "python": ("python", ["python software foundation licen[sc]e", "python licen[sc]e"], ["2.0", "2.1"]),
    "php": ("php", ["php licen[sc]e"], ["3.0", "3.1"]),
    "ruby": ("ruby", ["ruby licen[sc]e"], []),
    "ofl": ("font", ["sil open font licen[sc]e", "open font licen[sc]e"], ["1.0", "1.1"]),
    "odbl": ("database", ["open database licen[sc]e"], ["1.0"]),
    "osl": ("open", ["open software licen[sc]e"], ["1.0", "2.0", "2.1", "3.0"]),
    "afl": ("academic", ["academic free licen[sc]e"], ["1.1", "2.0", "2.1", "3.0"]),
    "apsl": ("apple", ["apple public source licen[sc]e"], ["1.0", "1.2", "2.0"]),
    "ms-pl": ("microsoft", ["microsoft public licen[sc]e"], []),
    "ms-rl": ("microsoft", ["microsoft reciprocal licen[sc]e"], []),
    "ncsa": ("illinois", ["university of illinois ncsa open source licen[sc]e"], []),
    "upl": ("universal", ["universal permissive licen[sc]e"], ["1.0"]),
    "wtfpl": ("wtfpl", ["wtfpl"], ["1.0", "2.0"]),
    "unlicense": ("unlicense", ["the unlicense", "unlicense"], []),
    "cc0": ("zero", ["creative commons zero"], ["1.0"]),
    "cc0-short": ("cc0", ["cc0"], ["1.0"]),
    "cc-by": ("commons", ["creative commons attribution(?: international)?(?: licen[sc]e)?"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc-by-sa": ("commons", ["creative commons attribution share ?alike(?: licen[sc]e)?"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc-by-nc": ("commons", ["creative commons attribution non ?commercial(?: licen[sc]e)?"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc-by-nd": ("commons", ["creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    "cc-by-short": ("cc", ["cc by"], ["2.0", "3.0", "4.0"]),
    "cc-by-sa-short": ("cc", ["cc by sa"], ["2.0", "3.0", "4.0"]),
    "cc-by-nc-short": ("cc", ["cc by nc"], ["2.0", "3.0", "4.0"]),
    "cc-by-nc-sa-short": ("cc", ["cc by nc sa"], ["2.0", "3.0", "4.0"]),
    "cc-by-nc-nd-short": ("cc", ["cc by nc nd"], ["2.0", "3.0", "4.0"]),
    "cc-by-nd-short": ("cc", ["cc by nd"], ["2.0", "3.0", "4.0"]),
    "proprietary": ("reserved", ["all rights reserved"], []),
}
#: label, keyword, signature: phrases of license texts, notices and addresses, as lower-cased words with single spaces.
BODIES: list[tuple[str, str, str]] = [
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,16}may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", "the names? of (?:[^ ]+ ){1,8}may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-views", "views", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-patent", "perpetual", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual"),
    ("bsd-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "limitations", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "reproduction", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl-2.0-or-later", "redistribute", "this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute", "this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "published", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2.0-only", "only", "under the terms of version 2 of the gnu general public license only"),
    ("gpl-3.0", "published", "under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this (?:program|library|software|package)"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "gnu", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu", "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", "gnu", "gnu general public license version 1 february 1989"),
    ("lgpl-2.1-or-later", "redistribute", "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "redistribute", "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", "either", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|package)"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0-or-later", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "affero", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gcc-exception-3.1", "exception", "gcc runtime library exception version 3 1"),
    ("classpath-exception", "dynamically", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("mpl-2.0", "form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1 the license"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0 the license"),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-1.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0"),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("edl-1.0", "distribution", "made available under the terms of the eclipse distribution license v 1 0"),
    ("cddl-1.0", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "accompanying", "the accompanying program is provided under the terms of this common public license"),
    ("zlib", "liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "plainly", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "libpng", "this code is released under the libpng license"),
    ("boost-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", "to the extent possible under law (?:[^ ]+ ){1,10}waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", "public", "this (?:software|file|work|code|document|text|image|book|article) is in the public domain"),
    ("public-domain", "public", "(?:placed|released|put) (?:this |it )?(?:[^ ]+ ){0,3}(?:in|into) the public domain"),
    ("public-domain", "public", "dedicated to the public domain"),
    ("public-domain", "copyright", "no copyright is claimed"),
    ("wtfpl-2.0", "fuck", "do what the fuck you want to public license"),
    ("beerware", "beer", "the beer ware license"),
    ("beerware", "stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "documentation", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("x11", "contained", "except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising"),
    ("ncsa", "university", "university of illinois open source license"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("python-2.0", "nonexclusive", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ruby", "verbatim", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "preamble", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
    ("perl", "perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("perl", "perl", "under the same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", "none of the font software may be sold by itself|the font software may not be sold by itself"),
    ("odbl-1.0", "database", "is made available under the open database license"),
    ("pddl-1.0", "dedication", "is made available under the public domain dedication and license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("cecill", "cecill", "this software is governed by the cecill(?: [bc])? license"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("apsl-2.0", "apple", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license version 2 0"),
    ("upl-1.0", "lrgrwrks", "and any piece of software and or hardware listed in the lrgrwrks txt file"),
    ("bsl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "server", "server side public license version 1"),
    ("elastic-2.0", "elastic", "elastic license 2 0"),
    ("commons-clause", "licensor", "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license 1 0 0"),
    ("cc-by", "commons", "this work is licensed under (?:a|the) creative commons attribution(?: [34] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-sa", "commons", "this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [34] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nc", "commons", "this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: [34] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-sa-3.0", "commons", "text is available under the creative commons attribution share ?alike"),
    ("proprietary", "confidential", "this (?:document|file|software) (?:contains|is) (?:proprietary and )?confidential"),
    ("proprietary", "prohibited", "(?:unauthori[sz]ed )?(?:copying|reproduction|distribution|redistribution) (?:[^ ]+ ){0,8}(?:is )?strictly prohibited"),
    ("proprietary", "reproduced", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("gpl-2.0", "gnu", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu", "gnu org licenses agpl 3 0"),
    ("mit", "opensource", "opensource org licenses? mit"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("isc", "opensource", "opensource org licenses? isc"),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "eclipse org legal epl 2 0|eclipse org legal epl v20"),
    ("boost-1.0", "boost", "boost org license 1 0"),
    ("unlicense", "unlicense", "unlicense org"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("wtfpl-2.0", "wtfpl", "wtfpl net"),
]
#: The same for short declarations, further notices and names that have no versions laid out.
NOTICES: list[tuple[str, str, str]] = [
    ("mit", "mit", "licen[sc]es? mit(?! licen[sc]e)"),
    ("mit", "mit", "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit"),
    ("mit", "mit", "(?:released|distributed|available) under (?:the )?mit"),
    ("mit", "mit", "mit licen[sc]ed"),
    ("mit", "mit", "mit x11 licen[sc]e"),
    ("mit", "expat", "expat licen[sc]e"),
    ("mit-0", "attribution", "mit no attribution"),
    ("mit-cmu", "cmu", "cmu licen[sc]e"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "isc", "licen[sc]es? isc"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software"),
    ("bsd", "bsd", "licen[sc]es? bsd"),
    ("bsd", "bsd", "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?bsd"),
    ("bsd", "bsd", "bsd licen[sc]ed"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "contributors", "this software is provided by the copyright holders? and contributors as is and any express or implied warranties"),
    ("bsd", "regents", "this software is provided by the regents and contributors as is"),
    ("bsd-3-clause", "regents", "copyright c (?:[0-9]{4} ){1,4}the regents of the university of california"),
    ("0bsd", "clause", "bsd zero clause licen[sc]e|zero clause bsd"),
    ("apache", "apache", "licen[sc]es? apache"),
    ("apache", "apache", "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?apache"),
    ("apache", "asf", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2.0", "notice", "if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", "llvm", "apache licen[sc]e v2 0 with llvm exceptions"),
    ("gpl", "gpl", "licen[sc]es? gpl"),
    ("gpl", "gpl", "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("gpl", "merchantability", "implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e for more details"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl", "franklin", "free software foundation inc 51 franklin (?:street|st)"),
    ("gpl", "temple", "free software foundation inc 59 temple place"),
    ("gpl", "mass", "free software foundation inc 675 mass ave"),
    ("gpl", "copyleft", "this is a copyleft licen[sc]e"),
    ("gpl-2.0", "syscall", "linux syscall note"),
    ("gpl-font-exception", "font", "if you create a document which uses this font and embed this font"),
    ("bison-exception", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "autoconf", "if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("openssl-exception", "openssl", "permission to link (?:the code of portions of )?this program with the openssl"),
    ("lgpl", "fitness", "fitness for a particular purpose see the gnu (?:lesser|library) general public licen[sc]e for more details"),
    ("lgpl", "lgpl", "licen[sc]es? lgpl"),
    ("agpl", "agpl", "licen[sc]es? agpl"),
    ("agpl-3.0", "remotely", "prominently offer all users interacting with it remotely through a computer network"),
    ("mpl-2.0", "incompatible", "incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    ("mpl", "mpl", "licen[sc]es? mpl"),
    ("epl", "eclipse", "eclipse foundation software user agreement"),
    ("ipl-1.0", "ibm", "ibm public licen[sc]e"),
    ("spl-1.0", "sun", "sun public licen[sc]e"),
    ("sissl", "sun", "sun industry standards source licen[sc]e"),
    ("zpl", "zope", "zope public licen[sc]e"),
    ("vim", "vim", "vim licen[sc]e"),
    ("tcl", "tcl", "tcl tk licen[sc]e"),
    ("w3c", "w3c", "w3c software (?:and document )?notice and licen[sc]e"),
    ("unicode", "unicode", "unicode (?:inc )?licen[sc]e agreement"),
    ("icu", "icu", "icu licen[sc]e"),
    ("curl", "curl", "curl and libcurl are licen[sc]ed"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "freetype project licen[sc]e"),
    ("libtiff", "leffler", "copyright c 1988 1997 sam leffler"),
    ("info-zip", "zip", "info zip licen[sc]e"),
    ("bzip2", "bzip2", "bzip2 licen[sc]e"),
    ("sleepycat", "sleepycat", "sleepycat (?:software )?(?:public )?licen[sc]e"),
    ("qpl-1.0", "public", "q public licen[sc]e"),
    ("lppl", "latex", "latex project public licen[sc]e"),
    ("ufl-1.0", "ubuntu", "ubuntu font licen[sc]e"),
    ("bitstream-vera", "bitstream", "bitstream vera is a trademark of bitstream"),
    ("intel", "intel", "intel open source licen[sc]e"),
    ("nasa", "nasa", "nasa open source agreement"),
    ("blueoak-1.0.0", "oak", "blue oak model licen[sc]e"),
    ("mulanpsl", "mulan", "mulan (?:permissive|psl)"),
    ("cern-ohl", "cern", "cern open hardware licen[sc]e"),
    ("solderpad", "solderpad", "solderpad hardware licen[sc]e"),
    ("odc-by", "commons", "open data commons attribution licen[sc]e"),
    ("ogl", "government", "open government licen[sc]e"),
    ("etalab", "ouverte", "licence ouverte"),
    ("cdla", "community", "community data licen[sc]e agreement"),
    ("openrail", "rail", "open rail m"),
    ("openrail", "responsible", "responsible ai licen[sc]es?"),
    ("llama", "llama", "llama (?:[0-9] )*community licen[sc]e"),
    ("gemma", "gemma", "gemma terms of use"),
    ("bsl-1.1", "business", "business source licen[sc]e"),
    ("parity", "parity", "parity public licen[sc]e"),
    ("prosperity", "prosperity", "prosperity public licen[sc]e"),
    ("hippocratic", "hippocratic", "hippocratic licen[sc]e"),
    ("cc", "rights", "some rights reserved"),
    ("cc", "creativecommons", "licen[sc]ed under creativecommons"),
    ("public-domain", "restrictions", "no known copyright restrictions"),
    ("public-domain", "government", "(?:is|as) a work of the (?:united states|u s) government"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unpublished", "this is an unpublished work"),
    ("proprietary", "internal", "for internal use only"),
    ("proprietary", "redistribution", "not for redistribution"),
    ("proprietary", "evaluation", "for evaluation (?:purposes )?only"),
    ("proprietary", "agreement", "end user licen[sc]e agreement"),
    ("proprietary", "written", "without (?:the )?(?:express |prior )+written (?:permission|consent) of the (?:publisher|authors?|copyright holders?|owner)"),
    ("proprietary", "medium", "copying of this file via any medium is strictly prohibited"),
]
#: Short forms written in one word ("gplv3") or with a bare number ("apache 2 0"): label -> names and versions.
SHORT: dict[str, tuple[str, list[str]]] = {
    "gpl": ("gpl", ["2.0", "3.0"]), "lgpl": ("lgpl", ["2.0", "2.1", "3.0"]), "agpl": ("agpl", ["3.0"]), "mpl": ("mpl", ["1.1", "2.0"]), "epl": ("epl", ["1.0", "2.0"]),
    "apache": ("apache", ["1.1", "2.0"]), "cddl": ("cddl", ["1.0", "1.1"]), "eupl": ("eupl", ["1.1", "1.2"]), "artistic": ("artistic", ["1.0", "2.0"]), "ofl": ("ofl", ["1.0", "1.1"]),
}
CREATIVE = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
BODY, IDENTIFIER, LATER, VERSIONED, GRANTED, DECLARED, NAMED = 60, 50, 40, 30, 20, 15, 10
CONFIDENCE = {BODY: 1.0, IDENTIFIER: 0.99, LATER: 0.95, VERSIONED: 0.95, GRANTED: 0.9, DECLARED: 0.8, NAMED: 0.7, 0: 0.6}


@dataclass(frozen=True)
class Rule:
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    label: str


def signature_rules() -> list[Rule]:
    """All rules, by falling priority."""
    out = []

    def rule(keyword: str, body: str, priority: int, label: str) -> None:
        out.append(Rule(keyword.encode(), re.compile(rb"(?<![^ ])(?:" + body.encode() + rb")(?![^ ])"), priority, label))

    for key, (keyword, names, versions) in FAMILIES.items():
        label = key.removesuffix("-short").removesuffix("-library")
        name = "(?:" + "|".join(names) + ")"
        spdx = label.replace("-", " ")
        rule("spdx", rf"spdx licen[sc]e identifier {spdx}", IDENTIFIER, label)
        rule(keyword, rf"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}", GRANTED, label)
        rule(keyword, name, NAMED, label)
        for v in versions:
            major, minor = v.split(".")
            number = rf"(?:version |v |v)?{major}(?: {minor})" + ("?" if minor == "0" else "")
            rule("spdx", rf"spdx licen[sc]e identifier {spdx} {major} {minor}(?: only)?", IDENTIFIER + 1, f"{label}-{v}")
            rule("spdx", rf"spdx licen[sc]e identifier {spdx} {major} {minor} or later", IDENTIFIER + 2, f"{label}-{v}-or-later")
            rule(keyword, rf"{name} {number}", VERSIONED, f"{label}-{v}")
            rule("later", rf"{name} {number} or (?:any |at your option any )?later(?: version)?", LATER, f"{label}-{v}-or-later")
    for label, keyword, body in BODIES:
        rule(keyword, body, BODY, label)
    for label, keyword, body in NOTICES:
        rule(keyword, body, BODY if body.count(" ") >= 8 else DECLARED, label)
    for label, (name, versions) in SHORT.items():
        for v in versions:
            major, minor = v.split(".")
            tail = f"(?: {minor})" + ("?" if minor == "0" else "")
            rule(f"{name}v{major}", rf"(?:gnu )?{name}v{major}{tail}", VERSIONED, f"{label}-{v}")
            rule(f"{name}v{major}", rf"(?:gnu )?{name}v{major}{tail} or (?:any )?later(?: version)?", LATER, f"{label}-{v}-or-later")
            rule(f"{name}{major}", rf"{name}{major}{tail}", VERSIONED, f"{label}-{v}")
            rule(name, rf"{name} {major} {minor}", VERSIONED, f"{label}-{v}")
            rule(name, rf"{name} {major} {minor} only", VERSIONED + 1, f"{label}-{v}-only")
            rule(name, rf"{name} {major} {minor} or later", LATER, f"{label}-{v}-or-later")
    for kind in CREATIVE:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            rule("creativecommons", f"creativecommons org licenses {kind} {v.replace('.', ' ')}", BODY, f"cc-{kind.replace(' ', '-')}-{v}")
    return sorted({(r.keyword, r.pattern.pattern, r.label): r for r in out}.values(), key=lambda r: -r.priority)


class MostEnd:
    """Largest end among the intervals that start at or before a word."""

    def __init__(self, starts: list[int]) -> None:
        self.at = {v: i + 1 for i, v in enumerate(sorted(set(starts)))}
        self.tree = [0] * (len(self.at) + 1)

    def add(self, start: int, end: int) -> None:
        i = self.at[start]
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], end)
            i += i & -i

    def reach(self, start: int) -> int:
        i, out = self.at[start], 0
        while i:
            out = max(out, self.tree[i])
            i -= i & -i
        return out


def word_starts(ws: list[bytes]) -> np.ndarray:
    """Byte offset of each word of the words joined by single spaces."""
    return np.cumsum([0, *(len(w) + 1 for w in ws)])[:-1]


def detect(ws: list[bytes], rules: list[Rule]) -> list[tuple[int, int, int, str]]:
    """(start word, end word, priority, label) of the detections that no stronger one contains."""
    there = set(ws)
    live = [r for r in rules if r.keyword in there]
    if not live:
        return []
    text, starts, found = b" ".join(ws), word_starts(ws), []
    for r in live:
        spans = [m.span() for m in r.pattern.finditer(text)]
        if spans:
            low, high = np.searchsorted(starts, np.array(spans).T, "right") - [[1], [0]]
            found += [(a, b, r.priority, r.label) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    found.sort(key=lambda d: (-d[2], d[0] - d[1], d[0], d[3]))
    kept: list[tuple[int, int, int, str]] = []
    ends = MostEnd([d[0] for d in found])
    for d in found:
        if ends.reach(d[0]) < d[1]:
            kept.append(d)
            ends.add(d[0], d[1])
    return sorted(kept)


def base_places(ws: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase."""
    there, out, text, starts = set(ws), [], b"", None
    for phrase, label in BASE.items():
        if not there.issuperset(phrase.encode().split()):
            continue
        if starts is None:
            text, starts = b" " + b" ".join(ws) + b" ", word_starts(ws)
        at, want, places = -1, b" " + phrase.encode() + b" ", []
        while (at := text.find(want, at + 1)) >= 0:
            places.append(at)
        out += [(k, label) for k in np.searchsorted(starts, places).tolist()]
    return sorted(out)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections; one row per input row.

    A null or empty text has no words, no places, empty label strings and score 0. ``detections`` lists
    label:start:end of the rules' detections in words, comma-joined. Repeated rows repeat, a null doc_id is a row like
    any other, other columns are not read, and the time of a text grows with its length, long or not.
    """
    tune(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        rules, out = signature_rules(), []
        gate = {r.keyword for r in rules} | {w for p in BASE for w in p.encode().split()}
        for doc, text in rows_of(batches):
            ws = words(text)
            if gate.isdisjoint(ws):
                out.append((doc, len(ws), 0, None, None, "", "", 0.0, ""))
            else:
                base, found = base_places(ws), detect(ws, rules)
                own = {x for _, x in base}
                score = max([CONFIDENCE[p // 10 * 10] for _, _, p, _ in found] + [CONFIDENCE[0]] * bool(base), default=0.0)
                out.append((doc, len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {d[3] for d in found})), score, ",".join(f"{d[3]}:{d[0]}:{d[1]}" for d in found)))
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")
