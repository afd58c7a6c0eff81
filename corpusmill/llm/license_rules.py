"""Signatures of licences: regular expressions over a text's words, a single space between two.

Own rules, written by hand. A pattern's words are lower case and may hold ``(?:..)``
groups, optional parts and ``\\S+`` for any word; alternatives stand inside groups. The
tier says how specific a signature is: 0 machine-readable tags, 1 sentences of a licence's
own text, 2 full names and addresses, 3 short names. ``keyword`` is the longest literal part
of a pattern: no text without it can match.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: tier -> how much a detection is trusted
CONFIDENCE = (1.0, 0.95, 0.9, 0.6)

_L = "licen[cs]e"
_V = "(?: version| v)?"

#: label, words of the tag's identifier
TAGS = (
    ("0bsd", "0bsd"), ("afl-3", "afl 3 0"), ("agpl-3", "agpl 3 0"), ("agpl-1", "agpl 1 0"), ("apache-1.1", "apache 1 1"),
    ("apache-2", "apache 2 0"), ("artistic-1", "artistic 1 0"), ("artistic-2", "artistic 2 0"), ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("bsl-1", "bsl 1 0"), ("busl-1.1", "busl 1 1"),
    ("cc-by-3", "cc by 3 0"), ("cc-by-4", "cc by 4 0"), ("cc-by-nc-3", "cc by nc 3 0"), ("cc-by-nc-4", "cc by nc 4 0"),
    ("cc-by-nc-nd-4", "cc by nc nd 4 0"), ("cc-by-nc-sa-3", "cc by nc sa 3 0"), ("cc-by-nc-sa-4", "cc by nc sa 4 0"),
    ("cc-by-nd-4", "cc by nd 4 0"), ("cc-by-sa-3", "cc by sa 3 0"), ("cc-by-sa-4", "cc by sa 4 0"), ("cc0-1", "cc0 1 0"),
    ("cddl-1", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("cecill-2", "cecill 2 0"), ("cecill-2.1", "cecill 2 1"), ("cecill-b", "cecill b"),
    ("cecill-c", "cecill c"), ("cpl-1", "cpl 1 0"), ("ecl-2", "ecl 2 0"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("eupl-1.1", "eupl 1 1"),
    ("eupl-1.2", "eupl 1 2"), ("gfdl-1.2", "gfdl 1 2"), ("gfdl-1.3", "gfdl 1 3"), ("gpl-1", "gpl 1 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"),
    ("isc", "isc"), ("lgpl-2", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("lppl-1.3c", "lppl 1 3c"), ("mit", "mit"),
    ("mit-0", "mit 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2", "mpl 2 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("mulanpsl-2", "mulanpsl 2 0"),
    ("ncsa", "ncsa"), ("odbl-1", "odbl 1 0"), ("odc-by-1", "odc by 1 0"), ("ofl-1.1", "ofl 1 1"), ("openssl", "openssl"), ("osl-3", "osl 3 0"),
    ("pddl-1", "pddl 1 0"), ("php-3.01", "php 3 01"), ("postgresql", "postgresql"), ("psf-2", "python 2 0"), ("qpl-1", "qpl 1 0"),
    ("ruby", "ruby"), ("sspl-1", "sspl 1 0"), ("unicode-3", "unicode 3 0"), ("unlicense", "unlicense"), ("upl-1", "upl 1 0"), ("vim", "vim"),
    ("w3c", "w3c"), ("wtfpl", "wtfpl"), ("x11", "x11"), ("zlib", "zlib"), ("zpl-2.1", "zpl 2 1"),
)

#: label, pattern: sentences that stand in the text of one licence
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit-0", "hereby granted free of charge to any person(?: \\S+){20,45} to do so the software is provided as is"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software"),
    ("apache-2", "you may not use this file except in compliance with the license(?: \\S+){0,12} apache org licenses license 2 0"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice(?: \\S+){10,20} provided with the distribution this software is provided"),
    ("bsd-3-clause", "neither the name of(?: \\S+){1,14} may be used to endorse or promote products"),
    ("bsd-3-clause", "the names? of(?: \\S+){1,10} may not be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-2", "gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3"),
    ("gfdl-1.2", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1", "to use reproduce display distribute execute and transmit the software and to prepare derivative works"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1", "to the extent possible under law(?: \\S+){1,12} waived all copyright and related"),
    ("artistic-2", "you may distribute verbatim copies of the source form of the standard version of this package"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("sspl-1", "server side public license as published by mongodb"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("psf-2", "psf is making python available to licensee on an as is basis"),
    ("unicode-3", "obtaining a copy of data files and any associated documentation"),
    ("all-rights-reserved", "copyright(?: c)? \\d{4}(?: \\S+){1,8} all rights reserved"),
    ("proprietary", "this software is the (?:confidential and )?proprietary information of"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)

#: label, pattern: full names, grants by name, addresses
NAMES = (
    ("mit", "under the mit licen[cs]e"), ("mit", "the mit licen[cs]e mit"), ("mit", "opensource org licenses mit"), ("mit", "the expat licen[cs]e"),
    ("mit", "licensed under the mit"), ("mit", "licensed under mit"), ("x11", "the x11 licen[cs]e"), ("isc", "the isc licen[cs]e"), ("isc", "opensource org licenses isc"),
    ("apache-2", f"apache {_L}{_V} 2(?: 0)?"), ("apache-2", "apache org licenses license 2 0"), ("apache-2", f"apache software {_L}{_V} 2(?: 0)?"),
    ("apache-1.1", f"apache software {_L}{_V} 1 1"), ("apache-1.1", f"apache {_L}{_V} 1 1"), ("apache-1", f"apache {_L}{_V} 1 0"), ("apache", "the apache software licen[cs]e"),
    ("gpl-1", f"gnu general public {_L}{_V} 1"), ("gpl-2", f"gnu general public {_L}{_V} 2"), ("gpl-3", f"gnu general public {_L}{_V} v?3"), ("gpl", f"gnu general public {_L}"),
    ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0"), ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl", "gnu org licenses gpl html"), ("gpl", "gnu org copyleft gpl"),
    ("lgpl-2", f"gnu (?:lesser|library) general public {_L}{_V} 2(?: 0)?"), ("lgpl-2.1", f"gnu lesser general public {_L}{_V} 2 1"), ("lgpl-3", f"gnu lesser general public {_L}{_V} 3"),
    ("lgpl", f"gnu (?:lesser|library) general public {_L}"), ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"), ("lgpl-3", "gnu org licenses lgpl 3 0"),
    ("agpl-3", f"gnu affero general public {_L}{_V} 3"), ("agpl", f"gnu affero general public {_L}"), ("agpl-1", f"affero general public {_L}{_V} 1"), ("agpl-3", "gnu org licenses agpl 3 0"),
    ("gfdl-1.1", f"gnu free documentation {_L}{_V} 1 1"), ("gfdl-1.2", f"gnu free documentation {_L}{_V} 1 2"), ("gfdl-1.3", f"gnu free documentation {_L}{_V} 1 3"), ("gfdl", f"gnu free documentation {_L}"),
    ("bsd-0-clause", f"zero clause bsd {_L}"), ("bsd-2-clause", f"(?:2|two) clause bsd {_L}"), ("bsd-2-clause", f"simplified bsd {_L}"), ("bsd-2-clause", f"freebsd {_L}"),
    ("bsd-3-clause", f"(?:3|three) clause bsd {_L}"), ("bsd-3-clause", f"(?:new|modified|revised) bsd {_L}"), ("bsd-4-clause", f"(?:4|four) clause bsd {_L}"), ("bsd-4-clause", f"original bsd {_L}"),
    ("bsd", f"bsd style {_L}"), ("bsd", f"under (?:the |a )?bsd {_L}"), ("bsd-3-clause", "opensource org licenses bsd 3 clause"), ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("mpl-1", f"mozilla public {_L}{_V} 1 0"), ("mpl-1.1", f"mozilla public {_L}{_V} 1 1"), ("mpl-2", f"mozilla public {_L}{_V} 2(?: 0)?"), ("mpl", f"mozilla public {_L}"), ("mpl-2", "mozilla org mpl 2 0"),
    ("epl-1", f"eclipse public {_L}{_V} (?:v1|1)(?: 0)?"), ("epl-2", f"eclipse public {_L}{_V} (?:v2|2)(?: 0)?"), ("epl", f"eclipse public {_L}"), ("epl-2", "eclipse org legal epl 2 0"), ("epl-1", "eclipse org legal epl v10"),
    ("eupl-1.1", f"european union public {_L}{_V} 1 1"), ("eupl-1.2", f"european union public {_L}{_V} 1 2"), ("eupl", f"european union public {_L}"),
    ("cddl-1", f"common development and distribution {_L}{_V} 1 0"), ("cddl-1.1", f"common development and distribution {_L}{_V} 1 1"), ("cddl", f"common development and distribution {_L}"),
    ("cpl-1", f"common public {_L}{_V} 1 0"), ("cpl", f"common public {_L}"), ("ipl-1", f"ibm public {_L}"), ("afl-3", f"academic free {_L}{_V} 3 0"), ("afl", f"academic free {_L}"),
    ("artistic-1", f"artistic {_L}{_V} 1 0"), ("artistic-2", f"artistic {_L}{_V} 2 0"), ("artistic", f"the artistic {_L}"), ("osl-3", f"open software {_L}{_V} 3 0"), ("osl", f"open software {_L}"),
    ("bsl-1", f"boost software {_L}{_V} 1 0"), ("bsl-1", f"boost software {_L}"), ("bsl-1", "boost org license 1 0"), ("zlib", f"zlib libpng {_L}"), ("zlib", f"the zlib {_L}"), ("libpng", f"libpng {_L}"),
    ("ofl-1.1", f"open font {_L}{_V} 1 1"), ("ofl-1", f"open font {_L}{_V} 1 0"), ("ofl", f"sil open font {_L}"), ("ofl", "scripts sil org ofl"), ("wtfpl", "do what the fuck you want to public licen[cs]e"),
    ("unlicense", "unlicense org"), ("unlicense", "the unlicense licen[cs]e"), ("ms-pl", f"microsoft public {_L}"), ("ms-rl", f"microsoft reciprocal {_L}"), ("ncsa", f"university of illinois ncsa open source {_L}"),
    ("openssl", f"openssl {_L}"), ("ssleay", f"original ssleay {_L}"), ("php-3", f"php {_L}{_V} 3 0"), ("php-3.01", f"php {_L}{_V} 3 01"), ("psf-2", f"python software foundation {_L}"), ("python", f"python {_L}{_V} 2"),
    ("ruby", f"ruby {_L}"), ("vim", f"vim {_L}"), ("qpl-1", f"q public {_L}"), ("w3c", f"w3c software notice and {_L}"), ("w3c", f"w3c software and document {_L}"), ("zpl-2.1", f"zope public {_L}{_V} 2 1"), ("zpl", f"zope public {_L}"),
    ("lppl-1.3c", f"latex project public {_L}{_V} 1 3c"), ("lppl", f"latex project public {_L}"), ("cecill-2", f"cecill(?: free software)? {_L}(?: agreement)?{_V} 2"), ("cecill", f"cecill(?: free software)? {_L}"),
    ("ecl-2", f"educational community {_L}"), ("upl-1", f"universal permissive {_L}"), ("mulanpsl-2", f"mulan permissive software {_L}"), ("postgresql", f"postgresql {_L}"), ("sspl-1", f"server side public {_L}"),
    ("busl-1.1", f"business source {_L}"), ("elastic-2", f"elastic {_L}(?: 2 0)?"), ("commons-clause", f"commons clause {_L}"), ("odbl-1", f"open (?:data commons open )?database {_L}"), ("odbl-1", "opendatacommons org licenses odbl"),
    ("odc-by-1", f"open data commons attribution {_L}"), ("odc-by-1", "opendatacommons org licenses by"), ("pddl-1", f"public domain dedication and {_L}"), ("pddl-1", "opendatacommons org licenses pddl"),
    ("ogl-uk-3", f"open government {_L}{_V} v?3(?: 0)?"), ("ogl-uk", f"open government {_L}"), ("etalab-2", f"licence ouverte"), ("cdla-permissive", f"community data {_L} agreement permissive"), ("cdla-sharing", f"community data {_L} agreement sharing"),
    ("openrail-m", f"open responsible ai {_L}"), ("openrail-m", f"openrail m {_L}"), ("bloom-rail", f"bigscience rail {_L}"), ("json", f"the json {_L}"), ("beerware", f"beer ?ware {_L}"), ("fal-1.3", f"free art {_L}"),
    ("cc0-1", "creativecommons org publicdomain zero"), ("cc0-1", "creative commons zero"), ("cc-pdm", "creativecommons org publicdomain mark"),
    ("cc-by-2", "creativecommons org licenses by 2"), ("cc-by-3", "creativecommons org licenses by 3 0"), ("cc-by-4", "creativecommons org licenses by 4 0"), ("cc-by-sa-2", "creativecommons org licenses by sa 2"),
    ("cc-by-sa-3", "creativecommons org licenses by sa 3 0"), ("cc-by-sa-4", "creativecommons org licenses by sa 4 0"), ("cc-by-nd-3", "creativecommons org licenses by nd 3 0"), ("cc-by-nd-4", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-2", "creativecommons org licenses by nc 2"), ("cc-by-nc-3", "creativecommons org licenses by nc 3 0"), ("cc-by-nc-4", "creativecommons org licenses by nc 4 0"), ("cc-by-nc-sa-2", "creativecommons org licenses by nc sa 2"),
    ("cc-by-nc-sa-3", "creativecommons org licenses by nc sa 3 0"), ("cc-by-nc-sa-4", "creativecommons org licenses by nc sa 4 0"), ("cc-by-nc-nd-3", "creativecommons org licenses by nc nd 3 0"), ("cc-by-nc-nd-4", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-3", "creative commons attribution 3 0"), ("cc-by-4", "creative commons attribution 4 0"), ("cc-by", "creative commons attribution"), ("cc-by-sa-3", "creative commons attribution share ?alike 3 0"),
    ("cc-by-sa-4", "creative commons attribution share ?alike 4 0"), ("cc-by-sa", "creative commons attribution share ?alike"), ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc", "creative commons attribution non ?commercial"), ("cc-by-nc-4", "creative commons attribution non ?commercial 4 0"), ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-sa-4", "creative commons attribution non ?commercial share ?alike 4 0"), ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"), ("cc-by-nc-nd-4", "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0"),
    ("public-domain", "(?:in|into|to) the public domain"), ("public-domain", "public domain dedication"), ("all-rights-reserved", "all rights reserved"),
)

#: label, pattern: short names
SHORT = (
    ("mit", "mit licen[cs]ed?"), ("apache", "apache licen[cs]ed"), ("gpl-2", "gpl(?: version)? v?2"), ("gpl-2", "gplv2"), ("gpl-3", "gpl(?: version)? v?3"), ("gpl-3", "gplv3"), ("gpl", f"gnu gpl"),
    ("gpl", "under gpl"), ("gpl", "under the gpl"), ("lgpl-2.1", "lgpl(?: version)? v?2 1"), ("lgpl-2.1", "lgplv2 1"), ("lgpl-3", "lgpl(?: version)? v?3"), ("lgpl-3", "lgplv3"), ("lgpl", "gnu lgpl"), ("lgpl", "under lgpl"), ("lgpl", "under the lgpl"),
    ("agpl-3", "agpl(?: version)? v?3"), ("agpl-3", "agplv3"), ("agpl", "gnu agpl"), ("gfdl", "gnu fdl"), ("gfdl", "under gfdl"), ("gfdl", "under the gfdl"), ("bsd", "bsd licen[cs]ed?"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-2-clause", "bsd 2 clause"),
    ("mpl-2", "mplv2"), ("mpl-2", "mpl 2 0"), ("mpl-1.1", "mpl 1 1"), ("epl-2", "epl 2 0"), ("epl-1", "epl 1 0"), ("eupl", "under the eupl"), ("cc0-1", "cc0(?: 1 0)?"), ("cc0-1", "cc zero"), ("ofl-1.1", "ofl 1 1"), ("odbl-1", "odbl licen[cs]ed?"),
    ("cc-by", "cc by licen[cs]ed?"), ("cc-by-2", "cc by 2(?: 0)?"), ("cc-by-3", "cc by 3(?: 0)?"), ("cc-by-4", "cc by 4(?: 0)?"), ("cc-by-sa", "cc by sa"), ("cc-by-sa-2", "cc by sa 2(?: 0)?"), ("cc-by-sa-3", "cc by sa 3(?: 0)?"), ("cc-by-sa-4", "cc by sa 4(?: 0)?"),
    ("cc-by-nd", "cc by nd"), ("cc-by-nd-4", "cc by nd 4(?: 0)?"), ("cc-by-nc", "cc by nc"), ("cc-by-nc-3", "cc by nc 3(?: 0)?"), ("cc-by-nc-4", "cc by nc 4(?: 0)?"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc-sa-3", "cc by nc sa 3(?: 0)?"),
    ("cc-by-nc-sa-4", "cc by nc sa 4(?: 0)?"), ("cc-by-nc-nd", "cc by nc nd"), ("cc-by-nc-nd-3", "cc by nc nd 3(?: 0)?"), ("cc-by-nc-nd-4", "cc by nc nd 4(?: 0)?"), ("sspl-1", "sspl licen[cs]ed?"), ("unlicense", "the unlicense"), ("wtfpl", "wtfpl licen[cs]ed?"),
)


class Rule(NamedTuple):
    tier: int
    label: str
    pattern: str

    @property
    def keyword(self) -> str:
        """The longest part of the pattern that stands outside of groups and classes and is not optional."""
        plain, depth = re.sub(r"\\S\+|\\d\{\d+\}|\{\d+,\d+\}", "\0", self.pattern), 0
        out = []
        for ch, after in zip(plain, plain[1:] + " "):
            depth += (ch in "([") - (ch in ")]")
            out.append(ch if depth == 0 and ch.isalnum() | (ch == " ") and after not in "?*" else "\0")
        return max((x.strip() for x in "".join(out).split("\0")), key=len)

    @property
    def regex(self) -> str:
        """Over words that bear their number: ``0:some 1:words ``."""
        return r"\d+:(?:" + re.sub(r" (?!\?)", r" \\d+:", self.pattern).replace(" ?", r"(?: \d+:)?") + ") "


RULES = (
    *(Rule(0, label, f"spdx license identifier {words}(?: only| or later)?") for label, words in TAGS),
    *(Rule(1, *x) for x in TEXTS),
    *(Rule(2, *x) for x in NAMES),
    *(Rule(3, *x) for x in SHORT),
)
_COMMON = (
    "licen", "spdx", "gpl", "cc by", "cc0", "creative", "public domain", "hereby grant", "rights reserved", "without fee", "opensource org", "gnu", "mozilla org",
    "mplv2", "mpl 2 0", "mpl 1 1", "epl ", "eupl", "bsd", "boost org", "cc zero", "opendatacommons", "openssl", "copyright notice",
)
#: Every keyword holds one of these; a text without any has no licence.
STEMS = (*_COMMON, *sorted({r.keyword for r in RULES if not any(s in r.keyword for s in _COMMON)}))
