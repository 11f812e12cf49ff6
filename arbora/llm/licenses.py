"""License scans: ordered signature rules with keyword prefilter, priority and interval containment.

A text becomes its lower-case words joined by single spaces; hundreds of signature expressions run over that
word string, each only where its keyword occurs. A detection is dropped when it lies inside a detection of
the same or a higher priority. Everything is one native row expression: no shuffle, whole texts.

Defined cases: null text counts as empty; texts without words have no detection and score 0; rows that repeat
an id are scanned each; extra columns are ignored; equal intervals of one priority keep the first rule's.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_runs, let, lower_ascii

#: Phrases that every scan reports, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"

#: Hand-written names in word form (words apart by a space): label, keyword, expression of the name.
NAMES = [
    ("mit", "mit", r"mit(?: x11)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: public)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("gpl-3", "general public", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?3(?: 0)?"),
    ("gpl-2", "general public", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("lgpl-3", "lesser", r"gnu lesser general public license (?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license (?:version |v)?2 1"),
    ("lgpl-2", "library general", r"gnu library general public license (?:version |v)?2(?: 0)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("agpl-3", "affero", r"gnu affero general public license (?:version |v)?3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2", "freebsd", r"freebsd"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd-0", "bsd", r"(?:zero clause bsd|bsd 0 clause)"),
    ("bsd-0", "0bsd", r"0bsd"),
    ("mpl-2", "mozilla", r"mozilla public license (?:version |v)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v)?1 1"),
    ("mpl-2", "mpl", r"mpl ?(?:version |v)?2(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license (?:version |v)?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license (?:version |v)?1(?: 0)?"),
    ("cddl-1.0", "distribution license", r"common development and distribution license(?: version| v)? ?1(?: 0)?"),
    ("cpl-1.0", "common public", r"common public license(?: version| v)? ?1(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version| v)?(?: 2)?"),
    ("bsl-1.0", "boost", r"boost software license(?: version| v)?(?: 1 0)?"),
    ("artistic-2", "artistic", r"artistic license (?:version |v)?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic license(?: (?:version |v)?1(?: 0)?)?"),
    ("eupl-1.2", "european union", r"european union public licence(?: version| v)?(?: 1 2)?"),
    ("ofl-1.1", "font license", r"sil open font license(?: version| v)?(?: 1 1)?"),
    ("python-2", "python", r"python software foundation license(?: version| v)?(?: 2)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "cc 0", r"cc 0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "all rights", r"all rights reserved"),
]
#: Forms around a name: priority (0 highest), weight, expression before and after the name.
FORMS = [
    (0, 0.95, r"spdx license identifier ", r""),
    (1, 0.9, r"(?:is |are )?(?:licensed|released|distributed|available|published|provided|made available|dual licensed) under (?:the )?(?:terms of )?(?:the )?", r"(?: or later| only)?(?: licen[cs]e)?(?: version [0-9](?: [0-9])?)?"),
    (1, 0.85, r"(?:subject to|governed by|covered by|permitted by|in accordance with) (?:the )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?"),
    (2, 0.8, r"under (?:the )?(?:terms of )?(?:the )?", r" licen[cs]e(?: version [0-9](?: [0-9])?)?"),
    (2, 0.75, r"licen[cs]ed? (?:is |as )?(?:the )?", r""),
    (3, 0.6, r"(?:the )?", r" licen[cs]e(?: version [0-9](?: [0-9])?)?"),
]
#: Whole texts of licenses by sentences of their own: label, keyword, expression, weight.
SENTENCES = [
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "deal in", r"to deal in the software without restriction", 0.9),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd-3", "endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", 0.95),
    ("bsd-2", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0.8),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software", 0.95),
    ("gpl", "general public", r"gnu general public license", 0.7),
    ("lgpl", "lesser general", r"gnu lesser general public license", 0.7),
    ("agpl", "affero", r"gnu affero general public license", 0.7),
    ("apache", "apache", r"apache license", 0.7),
    ("mpl", "mozilla", r"mozilla public license", 0.7),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "fuck you want", r"do what the fuck you want to public license", 0.95),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors", 0.9),
    ("bsl-1.0", "boost", r"boost software license", 0.9),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
]

#: Notices, headings, addresses and further names, an expression each: label, keyword, expression, weight.
NOTICES = [
    ("mit", "above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("mit", "without limitation the", r"including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 0.95),
    ("mit", "permit persons", r"to permit persons to whom the software is furnished to do so", 0.9),
    ("mit", "the warranties", r"the warranties of merchantability fitness for a particular purpose and non ?infringement in no event shall the authors or copyright holders", 0.85),
    ("mit", "otherwise arising", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software", 0.85),
    ("mit", "expat", r"(?:the )?expat license", 0.85),
    ("mit", "opensource org", r"opensource org licenses mit(?: license)?(?: php| html)?", 0.9),
    ("mit", "mit license", r"(?:the )?mit license mit", 0.9),
    ("mit-0", "mit no", r"mit no attribution(?: license)?", 0.95),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 0.95),
    ("x11", "x11 license", r"(?:the )?x11 license", 0.8),
    ("bsd-2", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.75),
    ("bsd-2", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.75),
    ("bsd-2", "opensource org", r"opensource org licenses bsd 2 clause", 0.9),
    ("bsd-3", "opensource org", r"opensource org licenses bsd 3 clause", 0.9),
    ("bsd-3", "without specific", r"to endorse or promote products derived from this software without specific prior written permission", 0.85),
    ("bsd-3", "neither the", r"neither the name of the copyright holder nor the names of its contributors may be used", 0.95),
    ("bsd-3", "neither the", r"neither the name of the university nor the names of its contributors may be used", 0.95),
    ("bsd-3-clear", "clear bsd", r"(?:the )?clear bsd license", 0.9),
    ("bsd-3-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license", 0.95),
    ("bsd-4", "acknowledgement", r"must display the following acknowledgement(?: s)? this product includes software developed by", 0.95),
    ("bsd-patent", "bsd plus", r"bsd plus patent(?: license)?", 0.9),
    ("bsd", "bsd style", r"(?:a )?bsd style license", 0.7),
    ("bsd", "bsd license", r"(?:the )?bsd license(?:s)?", 0.7),
    ("bsd", "bsd licensed", r"bsd licensed", 0.7),
    ("0bsd", "without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 0.9),
    ("isc", "without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", 0.95),
    ("isc", "author disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties", 0.85),
    ("isc", "opensource org", r"opensource org licenses isc(?: license)?", 0.9),
    ("apache-2", "apache org", r"(?:www )?apache org licenses license 2 0(?: txt| html)?", 0.95),
    ("apache-2", "may not use", r"you may not use this file except in compliance with the license you may obtain a copy", 0.9),
    ("apache-2", "unless required", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "terms and conditions for", r"terms and conditions for use reproduction and distribution", 0.75),
    ("apache-2", "patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 0.95),
    ("apache-2", "grant of copyright", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants", 0.95),
    ("apache-2", "each contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.9),
    ("apache-2", "opensource org", r"opensource org licenses apache 2 0", 0.9),
    ("apache-2", "asl", r"asl ?2(?: 0)?", 0.7),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group", 0.9),
    ("apache", "apache licensed", r"apache licensed", 0.7),
    ("gpl-2-plus", "either version", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 0.95),
    ("gpl-3-plus", "either version", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.95),
    ("gpl-1-plus", "either version", r"under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version", 0.95),
    ("gpl-2", "version 2 of", r"under the terms of version 2 of the gnu general public license", 0.95),
    ("gpl-3", "version 3 of", r"under the terms of version 3 of the gnu general public license", 0.95),
    ("gpl-2", "june 1991", r"gnu general public license version 2 june 1991", 0.95),
    ("gpl-3", "june 2007", r"gnu general public license version 3 29 june 2007", 0.95),
    ("gpl-2", "opensource org", r"opensource org licenses gpl 2 0(?: php| html)?", 0.9),
    ("gpl-3", "opensource org", r"opensource org licenses gpl 3 0(?: php| html)?", 0.9),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?", 0.9),
    ("gpl-3", "gnu org", r"gnu org licenses gpl 3 0(?: txt| html)?", 0.9),
    ("gpl", "gnu org", r"gnu org licenses gpl(?: txt| html)?", 0.75),
    ("gpl", "distributed in the hope", r"this program is distributed in the hope that it will be useful but without any warranty", 0.85),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public license along with this (?:program|software|library|file)", 0.9),
    ("gpl", "this program is free", r"this program is free software you can redistribute it and or modify", 0.85),
    ("gpl", "our general", r"our general public licenses are designed to make sure that you have the freedom", 0.85),
    ("gpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("gpl-2-plus", "gpl v2", r"(?:gnu )?gpl v2 or later", 0.9),
    ("gpl-3-plus", "gpl v3", r"(?:gnu )?gpl v3 or later", 0.9),
    ("gpl-2", "gpl 2", r"gpl 2 0 only", 0.9),
    ("gpl-2-plus", "gpl 2", r"gpl 2 0 or later", 0.9),
    ("gpl-3", "gpl 3", r"gpl 3 0 only", 0.9),
    ("gpl-3-plus", "gpl 3", r"gpl 3 0 or later", 0.9),
    ("gpl-2-classpath", "classpath", r"(?:gpl 2 0 with )?classpath exception(?: 2 0)?", 0.9),
    ("gpl-linking", "linking exception", r"(?:with )?(?:a )?linking exception", 0.7),
    ("gpl-gcc", "gcc runtime", r"gcc runtime library exception(?: 3 1)?", 0.9),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file)", 0.9),
    ("lgpl-2.1-plus", "lesser general", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 0.95),
    ("lgpl-3-plus", "lesser general", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.95),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public license version 2 1 february 1999", 0.95),
    ("lgpl-2", "library general", r"gnu library general public license", 0.85),
    ("lgpl-2.1", "opensource org", r"opensource org licenses lgpl 2 1", 0.9),
    ("lgpl-3", "opensource org", r"opensource org licenses lgpl 3 0", 0.9),
    ("lgpl", "gnu org", r"gnu org licenses lgpl(?: txt| html)?", 0.75),
    ("lgpl-2.1", "lgpl 2", r"lgpl 2 1 only", 0.9),
    ("lgpl-2.1-plus", "lgpl 2", r"lgpl 2 1 or later", 0.9),
    ("lgpl-3", "lgpl 3", r"lgpl 3 0 only", 0.9),
    ("lgpl-3-plus", "lgpl 3", r"lgpl 3 0 or later", 0.9),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file)", 0.9),
    ("agpl-3", "november 2007", r"gnu affero general public license version 3 19 november 2007", 0.95),
    ("agpl-3", "affero general", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.95),
    ("agpl-3", "remote network", r"remote network interaction use with the gnu general public license", 0.95),
    ("agpl", "gnu org", r"gnu org licenses agpl(?: 3 0)?(?: txt| html)?", 0.85),
    ("agpl-1", "affero general", r"affero general public license version 1", 0.9),
    ("gfdl", "free documentation", r"gnu free documentation license(?: version 1 [1-3])?", 0.9),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 0.95),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    ("mpl-2", "if a copy", r"if a copy of the mpl was not distributed with this file you can obtain one at", 0.95),
    ("mpl-2", "incompatible with", r"incompatible with secondary licenses as defined by the mozilla public license v 2 0", 0.95),
    ("mpl-1.1", "contents of this", r"the contents of this file are subject to the mozilla public license version 1 1", 0.95),
    ("mpl-1.0", "contents of this", r"the contents of this file are subject to the mozilla public license version 1 0", 0.95),
    ("mpl-2", "opensource org", r"opensource org licenses mpl 2 0", 0.9),
    ("npl-1.1", "netscape", r"netscape public license(?: version)?(?: 1 [01])?", 0.9),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10(?: html)?", 0.95),
    ("epl-2", "eclipse org", r"(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?", 0.95),
    ("epl-1", "accompanying materials", r"the accompanying materials are made available under the terms of the eclipse public license v1 0", 0.95),
    ("edl-1", "eclipse distribution", r"eclipse distribution license(?: v| version)? ?1(?: 0)?", 0.9),
    ("cddl-1.0", "cddl", r"cddl(?: version)?(?: 1 0)?", 0.85),
    ("cddl-1.1", "cddl", r"cddl(?: version)? 1 1", 0.9),
    ("cpl-1.0", "cpl 1", r"cpl 1 0", 0.8),
    ("ipl-1.0", "ibm public", r"ibm public license(?: version)?(?: 1 0)?", 0.9),
    ("apsl-2", "apple public", r"apple public source license(?: version)?(?: 2 0)?", 0.9),
    ("osl-3", "open software license", r"open software license(?: v| version)?(?: ?3 0)?", 0.9),
    ("afl-3", "academic free", r"academic free license(?: v| version)?(?: ?3 0)?", 0.9),
    ("ecl-2", "educational community", r"educational community license(?: version)?(?: 2 0)?", 0.9),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: v| version)?(?: ?1 0)?", 0.9),
    ("ncsa", "university of illinois", r"university of illinois ncsa open source license", 0.95),
    ("ncsa", "ncsa", r"ncsa license", 0.8),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.95),
    ("zlib", "opensource org", r"opensource org licenses zlib", 0.9),
    ("libpng", "libpng", r"libpng license(?: version 2)?", 0.9),
    ("bsl-1.0", "boost org", r"(?:www )?boost org license 1 0(?: txt)?", 0.95),
    ("bsl-1.0", "machine executable", r"in the form of machine executable object code generated by a source language processor", 0.95),
    ("busl-1.1", "business source", r"business source license(?: 1 1)?", 0.95),
    ("busl-1.1", "change date", r"change date (?:the )?change license", 0.8),
    ("sspl-1", "server side public", r"server side public license(?: version)?(?: 1)?", 0.95),
    ("elastic-2", "elastic license", r"elastic license(?: version)?(?: 2 0)?", 0.95),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?(?: v1 0)?", 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license(?: 1 0 0)?", 0.95),
    ("confluent", "confluent community", r"confluent community license(?: agreement)?", 0.95),
    ("unlicense", "unlicense org", r"unlicense org", 0.9),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("unlicense", "relinquish", r"relinquishment in perpetuity of all present and future rights to this software", 0.9),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 0.95),
    ("cc0-1.0", "cc0 public", r"cc0 public domain dedication", 0.95),
    ("cc0-1.0", "dedicated the", r"has dedicated the work to the public domain by waiving all of his or her rights", 0.95),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v1 0)?(?: universal)?", 0.95),
    ("pddl-1", "public domain dedication", r"open data commons public domain dedication and license", 0.95),
    ("odbl-1", "open database", r"open database license(?: v1 0)?", 0.95),
    ("odc-by", "open data commons", r"open data commons attribution license(?: v1 0)?", 0.95),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [05]", 0.95),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]", 0.95),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]", 0.95),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]", 0.95),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]", 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]", 0.95),
    ("cc-by", "this work is", r"this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic) license", 0.95),
    ("cc-by-sa", "this work is", r"this work is licensed under a creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|unported|generic) license", 0.95),
    ("cc-by-nc", "this work is", r"this work is licensed under a creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international|unported|generic) license", 0.95),
    ("cc", "some rights", r"some rights reserved", 0.6),
    ("cc", "creative commons license", r"(?:a )?creative commons license", 0.65),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: version)?(?: 1 1)?", 0.85),
    ("ofl-1.1", "reserved font", r"with reserved font name", 0.9),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", 0.95),
    ("bitstream-vera", "bitstream vera", r"bitstream vera (?:fonts )?(?:copyright|license)", 0.9),
    ("artistic-2", "perlfoundation", r"perlfoundation org artistic license 2 0", 0.95),
    ("perl", "same terms", r"(?:it )?under the same terms as perl itself", 0.95),
    ("python-2", "psf", r"psf license(?: agreement)?(?: for python)?(?: 2| version 2)?", 0.85),
    ("python-2", "python software", r"this license agreement is between the python software foundation", 0.95),
    ("ruby", "ruby", r"(?:the )?ruby(?: s)? license", 0.85),
    ("php-3.01", "php license", r"(?:the )?php license(?: version)?(?: 3 01| 3 0)?", 0.9),
    ("php-3.01", "php net", r"(?:www )?php net license 3 01(?: txt)?", 0.95),
    ("zend-2", "zend", r"zend (?:engine )?license(?: version)?(?: 2 0)?", 0.9),
    ("vim", "vim license", r"(?:the )?vim license", 0.9),
    ("tcl", "tcl", r"tcl tk license", 0.9),
    ("lppl-1.3", "latex project", r"latex project public license(?: version| v)?(?: ?1 3c?)?", 0.95),
    ("knuth", "knuth", r"knuth ctan license", 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 0.95),
    ("beerware", "beerware", r"beerware license(?: revision 42)?", 0.9),
    ("beerware", "buy me a", r"you can buy me a beer in return", 0.95),
    ("wtfpl", "you just", r"you just do what the fuck you want to", 0.95),
    ("w3c", "w3c software", r"w3c software (?:notice and )?(?:document )?license", 0.9),
    ("w3c", "w3c software notice", r"w3c software notice and license", 0.9),
    ("curl", "curl license", r"(?:the )?curl license", 0.9),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group", 0.95),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 0.95),
    ("ssleay", "cryptographic software", r"this product includes cryptographic software written by eric young", 0.95),
    ("postgresql", "without fee and", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 0.95),
    ("hpnd", "above copyright notice appear", r"provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear", 0.9),
    ("ms-pl", "ms pl", r"ms pl", 0.8),
    ("ms-rl", "ms rl", r"ms rl", 0.8),
    ("ms-limited", "microsoft limited", r"microsoft limited public license", 0.9),
    ("eupl-1.1", "eupl", r"eupl(?: v| version)? ?1 1", 0.95),
    ("eupl-1.2", "eupl", r"eupl(?: v| version)? ?1 2", 0.95),
    ("cecill-2.1", "cecill", r"cecill(?: version)?(?: ?2 1| ?2 0)?", 0.9),
    ("cecill-b", "cecill b", r"cecill b(?: version)?(?: 1 0)?", 0.95),
    ("cecill-c", "cecill c", r"cecill c(?: version)?(?: 1 0)?", 0.95),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software license)(?: v2| version 2)?", 0.95),
    ("qpl-1", "q public", r"q public license(?: version)?(?: 1 0)?", 0.9),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat license", 0.95),
    ("oracle-bcl", "binary code license", r"oracle binary code license agreement", 0.9),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m| s)?(?: license)?", 0.9),
    ("llama", "llama", r"llama (?:2|3|3 [12]) community license(?: agreement)?", 0.95),
    ("gemma", "gemma terms", r"gemma terms of use", 0.9),
    ("ogl-uk", "open government", r"open government licence(?: v| version)?(?: ?[123] 0)?", 0.95),
    ("etalab-2", "licence ouverte", r"(?:etalab )?licence ouverte(?: version| v)? ?2 0", 0.9),
    ("dual", "dual licensed", r"dual licensed under (?:the )?mit and (?:the )?apache", 0.9),
    ("public-domain", "dedicated to the public", r"(?:is )?dedicated to the public domain", 0.85),
    ("public-domain", "in the public", r"(?:is |are )?in the public domain", 0.7),
    ("public-domain", "placed in", r"(?:has been |is )?placed in the public domain", 0.85),
    ("public-domain", "no copyright is", r"no copyright is claimed", 0.8),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 0.95),
    ("proprietary", "contains", r"contains (?:proprietary|confidential) (?:information|trade secrets) of", 0.85),
    ("proprietary", "without the express", r"may not be (?:reproduced|copied|distributed) without the express (?:prior )?written (?:permission|consent)", 0.85),
    ("proprietary", "end user", r"end user licen[cs]e agreement", 0.85),
    ("proprietary", "no part of", r"no part of this (?:publication|document|work|book) may be reproduced", 0.85),
    ("proprietary", "commercial license", r"(?:under a |requires a )commercial license", 0.75),
    ("see-license", "see the licen", r"see the licen[cs]e (?:file |text )?(?:for (?:details|more)|in (?:the root|this))", 0.6),
    ("see-license", "in the licen", r"(?:found|available|included) in the licen[cs]e file", 0.6),
    ("see-license", "license txt", r"see (?:the )?(?:accompanying |included )?license txt(?: file)?", 0.65),
]


@lru_cache(1)
def rules() -> list[tuple[str, str, str, int, float]]:
    """Label, keyword, expression over the word string (leading space kept), priority, weight; in order."""
    out = [(label, phrase, phrase, 0, 0.95) for phrase, label in PHRASES.items()]
    for priority, weight, before, after in FORMS:
        out += [(label, keyword, before + name + after, priority, weight) for label, keyword, name in NAMES]
    out += [(label, keyword, expr, 4, weight) for label, keyword, expr, weight in SENTENCES + NOTICES]
    return [(label, keyword, f" {expr}(?= )", priority, weight) for label, keyword, expr, priority, weight in out]


def word_string(text: Column) -> Column:
    """Lower-case words between single spaces, with one space at each end; a single space without words."""
    bare = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP, " "))
    return F.when(bare == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """Array of (start word, words) of a pattern's matches."""
    def located(found):
        def with_pieces(pieces):
            steps = F.zip_with(found, pieces, lambda m, p: (_blanks(m) + _blanks(p)).cast("bigint"))
            starts = F.zip_with(fold_runs(steps), pieces, lambda s, p: s + _blanks(p))
            return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("at"), _blanks(m).cast("bigint").alias("n")))
        return let(F.slice(F.split(words, pattern, -1), 1, F.size(found)), with_pieces)
    return let(F.regexp_extract_all(words, pattern, F.lit(0)), located)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``license_words`` (n_words, base places) and ``licenses``: kept detections
    (start, end, priority, label, weight) in words, by start."""
    return docs.withColumn("_ls", let(word_string(F.col(f"`{text}`")), _scan)).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_ls.license_words", "_ls.licenses")


def _scan(words: Column) -> Column:
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")
    base = F.array(*[F.struct(F.lit(label).alias("label"), F.when(F.contains(words, F.lit(f" {phrase} ")), _places(words, F.lit(f" {phrase}(?= )"))).otherwise(none).alias("places"))
                     for phrase, label in PHRASES.items()])
    # Every expression holds its keyword behind a space, so rules of keywords that do not occur match nothing.
    groups = {}
    for i, (label, keyword, expr, priority, weight) in enumerate(rules()):
        groups.setdefault(keyword, []).append(dict(rank=i, label=label, expr=expr, priority=priority, weight=weight))
    table = F.from_json(F.lit(json.dumps([dict(keyword=f" {keyword}", rules=found) for keyword, found in groups.items()])),
                        "array<struct<keyword:string,rules:array<struct<rank:int,label:string,expr:string,priority:int,weight:double>>>>")
    live = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    hits = F.flatten(F.transform(live, lambda r: F.transform(_places(words, r["expr"]), lambda p: F.struct(
        p["at"].alias("start"), (-p["at"] - p["n"]).alias("back"), r["priority"].alias("priority"), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight")))))

    levels = max(r[3] for r in rules()) + 1
    zero = F.struct(F.expr(f"array_repeat(0L, {levels})").alias("ends"),
                    F.array().cast("array<struct<start:bigint,end:bigint,priority:int,label:string,weight:double>>").alias("kept"))

    def sweep(acc, x):
        end = -x["back"]
        inside = F.exists(F.slice(acc["ends"], 1, x["priority"] + 1), lambda e: e >= end)
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == x["priority"], F.greatest(e, end)).otherwise(e))
        one = F.struct(x["start"].alias("start"), end.alias("end"), x["priority"].alias("priority"), x["label"].alias("label"), x["weight"].alias("weight"))
        return F.struct(ends.alias("ends"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(one))).alias("kept"))
    kept = F.aggregate(F.array_sort(hits), zero, sweep, lambda acc: acc["kept"])
    return F.struct(F.struct(F.greatest(F.lit(0), _blanks(words) - 1).cast("long").alias("n_words"), base.alias("base")).alias("license_words"),
                    kept.alias("licenses"))


def digest(scanned: DataFrame) -> DataFrame:
    """One row a document with counts, places and labels."""
    places = F.flatten(F.transform(F.col("license_words.base"), lambda b: b["places"]))
    base = F.transform(F.filter(F.col("license_words.base"), lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    extra = F.transform("licenses", lambda d: d["label"])
    miss = F.aggregate("licenses", F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    out = scanned.withColumn("_ls_places", places).withColumn("_ls_base", F.array_sort(F.array_distinct(base)))
    return out.select(
        "doc_id", F.col("license_words.n_words").alias("n_words"), F.size("_ls_places").cast("long").alias("n_base"),
        F.array_min(F.transform("_ls_places", lambda p: p["at"])).alias("first_word"), F.array_max(F.transform("_ls_places", lambda p: p["at"])).alias("last_word"),
        F.array_join("_ls_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("_ls_base", extra))), ",").alias("labels"),
        F.round(F.when(F.size("_ls_base") > 0, F.greatest(1 - miss, F.lit(0.95))).otherwise(1 - miss), 6).alias("score"),
        F.size("licenses").cast("long").alias("n_detections"))


def brute_force(text: str | None) -> dict:
    """Plain model of the scan for tests, every rule on the whole text: labels and detections of one text."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + "".join(w + " " for w in words)
    found = []
    for rank, (label, _, expr, priority, weight) in enumerate(rules()):
        for m in re.finditer(expr, line):
            at = line[:m.start()].count(" ")
            found.append((at, at + m[0].count(" "), priority, rank, label, weight))
    kept = [x for x in found if not any(y is not x and y[2] <= x[2] and y[0] <= x[0] and y[1] >= x[1] and
                                        ((y[0], y[1]) != (x[0], x[1]) or (y[2], y[3]) < (x[2], x[3])) for y in found)]
    return {"n_words": len(words), "labels": sorted({x[4] for x in kept}), "n": len(kept)}
