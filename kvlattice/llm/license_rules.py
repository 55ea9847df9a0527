"""The signatures of license_scan: hand-written regexes over words.

A text is its words with one space between (A-Z lower-cased, every other ASCII
character a gap), so "Apache-2.0" is "apache 2 0" and "GPLv3" is "gplv3". A regex
is made of literals, ``(?:a|b)`` and ``?``; ``^`` and ``$`` tie it to the whole
text. It matches whole words. ``V`` stands for what may come before a version.
Within a group the order does not matter; groups are in the order of priority.
"""

from __future__ import annotations

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Before a version: "version 2", "v2", "v 2", "2", or nothing between.
V = "(?: version| ?v)? ?"
#: Around names that are words of other meanings, too.
GRANT = "(?:licensed|released|distributed|available|published|provided|covered|shared|offered) (?:under|by|with) (?:the )?(?:terms of (?:the )?)?"
BOUND = "(?:subject to|according to|permitted by|governed by|terms of) the "

# Names in SPDX notation, as words, and their labels.
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "x11": "mit", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2", "bsd 2 clause": "bsd-2-clause",
    "bsd 2 clause patent": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 3 clause clear": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause",
    "0bsd": "bsd-0", "isc": "isc", "zlib": "zlib", "libpng": "zlib", "bsl 1 0": "boost-1", "busl 1 1": "bsl-1.1", "unlicense": "unlicense",
    "wtfpl": "wtfpl", "cc0 1 0": "cc0-1", "artistic 1 0": "artistic-1", "artistic 2 0": "artistic-2", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2",
    "epl 1 0": "epl-1", "epl 2 0": "epl-2", "cddl 1 0": "cddl-1", "cddl 1 1": "cddl-1", "cpl 1 0": "cpl-1", "gpl 1 0": "gpl-1",
    "gpl 2 0": "gpl-2", "gpl 2 0 only": "gpl-2", "gpl 2 0 or later": "gpl-2", "gpl 3 0": "gpl-3", "gpl 3 0 only": "gpl-3",
    "gpl 3 0 or later": "gpl-3", "lgpl 2 0": "lgpl-2", "lgpl 2 1": "lgpl-2.1", "lgpl 2 1 only": "lgpl-2.1", "lgpl 2 1 or later": "lgpl-2.1",
    "lgpl 3 0": "lgpl-3", "lgpl 3 0 only": "lgpl-3", "lgpl 3 0 or later": "lgpl-3", "agpl 3 0": "agpl-3", "agpl 3 0 only": "agpl-3",
    "agpl 3 0 or later": "agpl-3", "ofl 1 1": "ofl-1.1", "psf 2 0": "psf-2", "python 2 0": "psf-2", "postgresql": "postgresql",
    "ms pl": "ms-pl", "ms rl": "ms-rl", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "osl 3 0": "osl-3", "upl 1 0": "upl-1",
    "sspl 1 0": "sspl-1", "elastic 2 0": "elastic-2", "odbl 1 0": "odbl-1", "pddl 1 0": "pddl-1", "ncsa": "ncsa", "vim": "vim",
    "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd",
    "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd",
}
#: SPDX names that are words of other meanings: alone they count as a whole text only.
AMBIGUOUS = {"mit", "isc", "zlib", "x11", "vim", "ncsa", "libpng", "unlicense", "postgresql", "ms pl", "ms rl", "python 2 0", "elastic 2 0", "artistic 1 0", "artistic 2 0", "mit 0"}

# A license's own words. Priority 6.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsd-0", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd-3-clause", "neither the name of (?:the )?(?:copyright holder|author|university|company|organization) nor the names of (?:its|his|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "either version 2 1 of the license or at your option any later version"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("psf-2", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("odbl-1", "any rights in individual contents of the database are licensed under the database contents license"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
]
# Addresses of licenses. Priority 5.
ADDRESSES = [
    ("mit", "opensource org licenses? mit"),
    ("bsd-2-clause", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource org licenses? bsd license"),
    ("isc", "opensource org licenses? isc"),
    ("apache-2", "(?:apache|opensource) org licenses? (?:license|apache) 2 0"),
    ("apache-2", "choosealicense com licenses apache 2 0"),
    ("mit", "choosealicense com licenses mit"),
    ("gpl-3", "choosealicense com licenses gpl 3 0"),
    ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu org licenses gpl"),
    ("gpl", "gnu org copyleft gpl"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu org licenses lgpl"),
    ("agpl-3", "gnu org licenses agpl(?: 3 0)?"),
    ("mpl-2", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl mpl 1 1"),
    ("epl-1", "eclipse org legal epl v10"),
    ("epl-2", "eclipse org legal epl (?:v20|2 0)"),
    ("boost-1", "boost org license 1 0"),
    ("unlicense", "unlicense org"),
    ("wtfpl", "wtfpl net"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("ofl-1.1", "openfontlicense org"),
    ("eupl-1.2", "joinup ec europa eu collection eupl"),
    ("odbl-1", "opendatacommons org licenses odbl"),
    ("pddl-1", "opendatacommons org licenses pddl"),
    ("cc0-1", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org licenses by (?:1|2|2 5|3|4) ?0?"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
]
# Notices with names that mean something else elsewhere. Priority 4.
NOTICES = [
    ("mit", f"{GRANT}(?:x11 )?mit(?: x11| expat)?(?: style)?(?: licen(?:s|c)e)?"),
    ("mit", f"{BOUND}mit licen(?:s|c)e"),
    ("mit", "mit licensed"),
    ("mit", "(?:expat|x11) licen(?:s|c)e"),
    ("mit", "licen(?:s|c)e(?: is)? mit(?: licen(?:s|c)e)?"),
    ("mit-0", "mit no attribution(?: licen(?:s|c)e)?"),
    ("isc", f"{GRANT}isc(?: licen(?:s|c)e)?"),
    ("isc", "licen(?:s|c)e(?: is)? isc"),
    ("zlib", f"{GRANT}zlib(?: libpng)?(?: licen(?:s|c)e)?"),
    ("zlib", "licen(?:s|c)e(?: is)? zlib"),
    ("apache-2", f"{GRANT}apache(?: software)?(?: licen(?:s|c)e)?{V}2(?: 0)?(?: licen(?:s|c)e)?"),
    ("apache", f"{GRANT}apache(?: software)? licen(?:s|c)e"),
    ("bsd", f"{GRANT}bsd(?: style)?(?: licen(?:s|c)e)?"),
    ("gpl-2", f"{GRANT}(?:gnu )?gpl{V}2(?: 0)?"),
    ("gpl-3", f"{GRANT}(?:gnu )?gpl{V}3(?: 0)?"),
    ("gpl", f"{GRANT}(?:gnu )?gpl(?: licen(?:s|c)e)?"),
    ("lgpl", f"{GRANT}(?:gnu )?lgpl(?: licen(?:s|c)e)?"),
    ("agpl", f"{GRANT}(?:gnu )?agpl(?: licen(?:s|c)e)?"),
    ("unlicense", f"{GRANT}unlicense"),
    ("unlicense", "licen(?:s|c)e(?: is)? unlicense"),
    ("wtfpl", f"{GRANT}wtfpl"),
    ("python", f"{GRANT}python(?: software foundation)? licen(?:s|c)e"),
    ("postgresql", f"{GRANT}postgresql licen(?:s|c)e"),
    ("artistic-2", f"{GRANT}artistic licen(?:s|c)e{V}2(?: 0)?"),
    ("vim", f"{GRANT}vim licen(?:s|c)e"),
    ("public-domain", "(?:released|placed|dedicated|contributed|put) (?:in|into|to) the public domain"),
    ("public-domain", "(?:code|software|work|file|program|text|document|image|data|library) is (?:hereby )?in the public domain"),
    ("public-domain", "public domain dedication"),
]
# Names that mean a license wherever they stand. Priority 3.
NAMES = [
    ("apache-2", f"apache(?: software)? licen(?:s|c)e{V}2(?: 0)?"),
    ("apache-1.1", f"apache(?: software)? licen(?:s|c)e{V}1 1"),
    ("apache-2", f"asl{V}2 0"),
    ("bsd-2-clause", "(?:2|two) clause bsd(?: licen(?:s|c)e)?"),
    ("bsd-2-clause", "bsd(?: licen(?:s|c)e)? (?:2|two) clause"),
    ("bsd-2-clause", "simplified bsd(?: licen(?:s|c)e)?"),
    ("bsd-2-clause", "freebsd licen(?:s|c)e"),
    ("bsd-3-clause", "(?:3|three) clause bsd(?: licen(?:s|c)e)?"),
    ("bsd-3-clause", "bsd(?: licen(?:s|c)e)? (?:3|three) clause"),
    ("bsd-3-clause", "(?:new|modified|revised) bsd licen(?:s|c)e"),
    ("bsd-4-clause", "(?:4|four) clause bsd(?: licen(?:s|c)e)?"),
    ("bsd-4-clause", "(?:original|old) bsd licen(?:s|c)e"),
    ("bsd-0", "(?:zero|0) clause bsd(?: licen(?:s|c)e)?"),
    ("gpl-1", f"gnu general public licen(?:s|c)e{V}1(?: 0)?"),
    ("gpl-2", f"gnu general public licen(?:s|c)e{V}2(?: 0)?"),
    ("gpl-3", f"gnu general public licen(?:s|c)e{V}3(?: 0)?"),
    ("gpl", "gnu general public licen(?:s|c)e"),
    ("gpl-2", "gpl(?: version| ?v) ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl(?: version| ?v) ?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", f"gnu gpl{V}2(?: 0)?"),
    ("gpl-3", f"gnu gpl{V}3(?: 0)?"),
    ("gpl-2", "gpl ?2 licen(?:s|c)e"),
    ("gpl-3", "gpl ?3 licen(?:s|c)e"),
    ("gpl-2", "gpl2"),
    ("gpl-3", "gpl3"),
    ("lgpl-2", f"gnu library general public licen(?:s|c)e(?:{V}2(?: 0)?)?"),
    ("lgpl-2.1", f"gnu lesser general public licen(?:s|c)e{V}2 1"),
    ("lgpl-3", f"gnu lesser general public licen(?:s|c)e{V}3(?: 0)?"),
    ("lgpl", "gnu lesser general public licen(?:s|c)e"),
    ("lgpl-2.1", f"(?:gnu )?lgpl{V}2 1"),
    ("lgpl-2", "(?:gnu )?lgpl(?: version| ?v)? ?2(?: 0)?"),
    ("lgpl-3", "(?:gnu )?lgpl(?: version| ?v)? ?3(?: 0)?"),
    ("agpl-3", f"(?:gnu )?affero general public licen(?:s|c)e(?:{V}3(?: 0)?)?"),
    ("agpl-3", "(?:gnu )?agpl(?: version| ?v)? ?3(?: 0)?"),
    ("fdl", f"gnu free documentation licen(?:s|c)e(?:{V}1 (?:1|2|3))?"),
    ("mpl-1.1", f"mozilla public licen(?:s|c)e{V}1 1"),
    ("mpl-2", f"mozilla public licen(?:s|c)e{V}2(?: 0)?"),
    ("mpl", "mozilla public licen(?:s|c)e"),
    ("mpl-2", "mpl(?: version| ?v) ?2(?: 0)?"),
    ("mpl-1.1", "mpl(?: version| ?v) ?1 1"),
    ("epl-1", f"eclipse public licen(?:s|c)e{V}1(?: 0)?"),
    ("epl-2", f"eclipse public licen(?:s|c)e{V}2(?: 0)?"),
    ("epl", "eclipse public licen(?:s|c)e"),
    ("epl-1", "epl(?: version| ?v) ?1(?: 0)?"),
    ("epl-2", "epl(?: version| ?v) ?2(?: 0)?"),
    ("edl-1", f"eclipse distribution licen(?:s|c)e(?:{V}1 0)?"),
    ("cddl-1", "common development and distribution licen(?:s|c)e"),
    ("cddl-1", f"cddl{V}1(?: (?:0|1))?"),
    ("cpl-1", f"common public licen(?:s|c)e(?:{V}1 0)?"),
    ("ipl-1", f"ibm public licen(?:s|c)e(?:{V}1 0)?"),
    ("boost-1", f"boost software licen(?:s|c)e(?:{V}1 0)?"),
    ("artistic-1", f"artistic licen(?:s|c)e{V}1(?: 0)?"),
    ("artistic-2", f"artistic licen(?:s|c)e{V}2(?: 0)?"),
    ("zlib", "zlib(?: libpng)? licen(?:s|c)e"),
    ("ofl-1.1", f"(?:sil )?open font licen(?:s|c)e(?:{V}1 1)?"),
    ("ofl-1.1", f"sil ofl(?:{V}1 1)?"),
    ("psf-2", "python software foundation licen(?:s|c)e(?: version 2)?"),
    ("postgresql", "postgresql licen(?:s|c)e"),
    ("ms-pl", "microsoft public licen(?:s|c)e"),
    ("ms-rl", "microsoft reciprocal licen(?:s|c)e"),
    ("eupl-1.1", f"european union public licen(?:s|c)e{V}1 1"),
    ("eupl-1.2", f"european union public licen(?:s|c)e(?:{V}1 2)?"),
    ("eupl-1.2", "eupl(?: version| ?v) ?1 2"),
    ("osl-3", f"open software licen(?:s|c)e(?:{V}3 0)?"),
    ("afl-3", f"academic free licen(?:s|c)e(?:{V}3 0)?"),
    ("upl-1", f"universal permissive licen(?:s|c)e(?:{V}1 0)?"),
    ("bsl-1.1", f"business source licen(?:s|c)e(?:{V}1 1)?"),
    ("sspl-1", f"server side public licen(?:s|c)e(?:{V}1)?"),
    ("elastic-2", f"elastic licen(?:s|c)e(?:{V}2(?: 0)?)?"),
    ("ncsa", "(?:university of illinois )?ncsa open source licen(?:s|c)e"),
    ("wtfpl", "do what the fuck you want to public licen(?:s|c)e"),
    ("ecl-2", f"educational community licen(?:s|c)e(?:{V}2 0)?"),
    ("qpl-1", f"q public licen(?:s|c)e(?:{V}1 0)?"),
    ("odbl-1", f"open (?:data commons open )?database licen(?:s|c)e(?:{V}1 0)?"),
    ("pddl-1", "public domain dedication and licen(?:s|c)e"),
    ("cdla", "community data licen(?:s|c)e agreement"),
    ("cc0-1", "(?:cc0|cc zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc-by", "cc by(?: (?:1|2|2 5|3|4) 0)?"),
    ("cc-by-sa", "cc by sa(?: (?:1|2|2 5|3|4) 0)?"),
    ("cc-by-nc", "cc by nc(?: (?:1|2|2 5|3|4) 0)?"),
    ("cc-by-nd", "cc by nd(?: (?:1|2|2 5|3|4) 0)?"),
    ("cc-by-nc-sa", "cc by nc sa(?: (?:1|2|2 5|3|4) 0)?"),
    ("cc-by-nc-nd", "cc by nc nd(?: (?:1|2|2 5|3|4) 0)?"),
    ("cc-by", "creative commons attribution(?: (?:1|2|3|4) 0)?(?: international| generic| unported)?(?: licen(?:s|c)e)?"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: (?:1|2|3|4) 0)?(?: international| generic| unported)?"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: (?:1|2|3|4) 0)?(?: international| generic| unported)?"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:atives|ative works|s)(?: (?:1|2|3|4) 0)?(?: international| generic| unported)?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: (?:1|2|3|4) 0)?(?: international| generic| unported)?"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:atives|ative works|s)(?: (?:1|2|3|4) 0)?(?: international| generic| unported)?"),
]
# Weaker marks. Priority 2, 1.
HINTS = [
    ("mit", "(?:the )?mit licen(?:s|c)e"),
    ("apache", "(?:the )?apache licen(?:s|c)e"),
    ("bsd", "(?:the )?bsd licen(?:s|c)e"),
    ("isc", "(?:the )?isc licen(?:s|c)e"),
    ("gpl", "(?:the )?(?:gnu )?gpl licen(?:s|c)e"),
    ("gpl", "gnu gpl"),
    ("lgpl", "gnu lgpl"),
    ("creative-commons", "creative commons licen(?:s|c)e"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this (?:file|software|document)"),
    ("proprietary", "may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    ("proprietary", "internal use only"),
]
RIGHTS = [
    ("proprietary", "all rights reserved"),
    ("copyleft", "copyleft"),
]
#: Group, priority, weight.
GROUPS = [(TEXTS, 6, 0.97), (ADDRESSES, 5, 0.9), (NOTICES, 4, 0.9), (NAMES, 3, 0.8), (HINTS, 2, 0.5), (RIGHTS, 1, 0.3)]
