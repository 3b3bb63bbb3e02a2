"""Licence signatures: hand-written regexes over lower-case words joined by single blanks.

A rule is (label, priority, regex).  Priority 1 is a licence named with its version or by its
own wording, 2 a bare family name or a general notice.  A regex starts with a plain word, its
anchor, and ends at a word's end.  In the tables, "{v}" stands for each listed version, where
"3" also matches "3 0"; OPTIONAL words are written in (?: ...)? groups.
"""

from __future__ import annotations

import re

# label with version, regex with version, versions
VERSIONED = (
    ("gpl-{l}-or-later", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )?{v}(?: of the license)? or (?:any |at your option any )?later(?: version)?", "1 2 3"),
    ("gpl-{l}-only", "gnu general public license (?:as published by the free software foundation )?(?:v|version )?{v} only", "1 2 3"),
    ("gpl-{l}", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )?{v}", "1 2 3"),
    ("gpl-{l}", "general public license (?:v|version )?{v}", "1 2 3"),
    ("gpl-{l}", "gnu gpl (?:v|version )?{v}", "1 2 3"),
    ("gpl-{l}-or-later", "gpl (?:v|version )?{v} or later", "1 2 3"),
    ("gpl-{l}", "gpl (?:v|version )?{v}", "1 2 3"),
    ("gpl-{l}", "gplv{v}", "1 2 3"),
    ("lgpl-{l}-or-later", "gnu (?:lesser|library) general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )?{v}(?: of the license)? or (?:any |at your option any )?later(?: version)?", "2 2.1 3"),
    ("lgpl-{l}", "gnu (?:lesser|library) general public license (?:v|version )?{v}", "2 2.1 3"),
    ("lgpl-{l}", "lesser general public license (?:v|version )?{v}", "2 2.1 3"),
    ("lgpl-{l}", "gnu lgpl (?:v|version )?{v}", "2 2.1 3"),
    ("lgpl-{l}", "lgpl (?:v|version )?{v}", "2 2.1 3"),
    ("lgpl-{l}", "lgplv{v}", "2 2.1 3"),
    ("agpl-{l}-or-later", "gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )?{v}(?: of the license)? or (?:any |at your option any )?later(?: version)?", "3"),
    ("agpl-{l}", "gnu affero general public license (?:v|version )?{v}", "1 3"),
    ("agpl-{l}", "agpl (?:v|version )?{v}", "1 3"),
    ("agpl-{l}", "agplv{v}", "1 3"),
    ("gfdl-{l}", "gnu free documentation license (?:v|version )?{v}", "1.1 1.2 1.3"),
    ("gfdl-{l}", "gfdl (?:v|version )?{v}", "1.1 1.2 1.3"),
    ("apache-{l}", "apache (?:software )?license (?:v|version )?{v}", "1 1.1 2"),
    ("apache-{l}", "apache {v}", "1.1 2"),
    ("mpl-{l}", "mozilla public license (?:v|version )?{v}", "1 1.1 2"),
    ("mpl-{l}", "mpl (?:v|version )?{v}", "1 1.1 2"),
    ("epl-{l}", "eclipse public license (?:v|version )?{v}", "1 2"),
    ("epl-{l}", "epl (?:v|version )?{v}", "1 2"),
    ("edl-{l}", "eclipse distribution license (?:v|version )?{v}", "1"),
    ("cpl-{l}", "common public license (?:v|version )?{v}", "1"),
    ("cddl-{l}", "common development and distribution license (?:v|version )?{v}", "1 1.1"),
    ("cddl-{l}", "cddl (?:v|version )?{v}", "1 1.1"),
    ("eupl-{l}", "european union public licen[cs]e (?:v|version )?{v}", "1 1.1 1.2"),
    ("eupl-{l}", "eupl (?:v|version )?{v}", "1 1.1 1.2"),
    ("artistic-{l}", "artistic license (?:v|version )?{v}", "1 2"),
    ("afl-{l}", "academic free license (?:v|version )?{v}", "1.1 2.1 3"),
    ("osl-{l}", "open software license (?:v|version )?{v}", "1 2 2.1 3"),
    ("bsl-{l}", "boost software license (?:v|version )?{v}", "1"),
    ("busl-{l}", "business source license (?:v|version )?{v}", "1.1"),
    ("cecill-{l}", "cecill (?:v|version )?{v}", "1 2 2.1"),
    ("ofl-{l}", "sil open font license (?:v|version )?{v}", "1 1.1"),
    ("ofl-{l}", "open font license (?:v|version )?{v}", "1 1.1"),
    ("php-{l}", "php license (?:v|version )?{v}", "3 3.01"),
    ("zpl-{l}", "zope public license (?:v|version )?{v}", "1.1 2 2.1"),
    ("lppl-{l}", "latex project public license (?:v|version )?{v}", "1 1.3"),
    ("qpl-{l}", "q public license (?:v|version )?{v}", "1"),
    ("ecl-{l}", "educational community license (?:v|version )?{v}", "1 2"),
    ("odbl-{l}", "open (?:data commons open )?database license (?:v|version )?{v}", "1"),
    ("odbl-{l}", "odbl (?:v|version )?{v}", "1"),
    ("odc-by-{l}", "open data commons attribution license (?:v|version )?{v}", "1"),
    ("pddl-{l}", "public domain dedication and license (?:v|version )?{v}", "1"),
    ("cdla-permissive-{l}", "community data license agreement permissive (?:v|version )?{v}", "1 2"),
    ("cdla-sharing-{l}", "community data license agreement sharing (?:v|version )?{v}", "1"),
    ("sspl-{l}", "server side public license (?:v|version )?{v}", "1"),
    ("elastic-{l}", "elastic license (?:v|version )?{v}", "1 2"),
    ("mulan-psl-{l}", "mulan permissive software license (?:v|version )?{v}", "1 2"),
    ("psf-{l}", "python software foundation license (?:v|version )?{v}", "2"),
    ("ogl-uk-{l}", "open government licen[cs]e (?:v|version )?{v}", "1 2 3"),
    ("openrail-{l}", "open rail m(?: license)? (?:v|version )?{v}", "1"),
    ("cc0-{l}", "cc0 {v}(?: universal)?", "1"),
    ("cc0-{l}", "creative commons zero (?:v|version )?{v}", "1"),
)

# Creative Commons: elements of the licence in short and in long form, and versions.
CC_ELEMENTS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(?:ative|ative work|atives|s)", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative|ative work|atives|s)",
}
CC_VERSIONS = "1 2 2.5 3 4"

# label, priority, regex
PLAIN = (
    ("gpl", 2, "gnu general public license"), ("gpl", 2, "gnu gpl"), ("gpl", 2, "gpl"), ("lgpl", 2, "gnu (?:lesser|library) general public license"),
    ("lgpl", 2, "lgpl"), ("agpl", 2, "gnu affero general public license"), ("agpl", 2, "agpl"), ("gfdl", 2, "gnu free documentation license"),
    ("gpl-exception", 1, "gnu general public license with (?:the )?(?:classpath|linking|runtime library) exception"),
    ("apache", 2, "apache (?:software )?license"), ("mit", 1, "mit licen[cs]e"), ("mit", 2, "expat license"), ("mit", 2, "x11 license"),
    ("mit-0", 1, "mit no attribution"), ("mit", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", 2, "bsd licen[cs]e"), ("bsd-0-clause", 1, "(?:zero|0) clause bsd"), ("bsd-0-clause", 1, "bsd (?:zero|0) clause"),
    ("bsd-1-clause", 1, "bsd 1 clause"), ("bsd-2-clause", 1, "bsd (?:2|two) clause"), ("bsd-2-clause", 1, "simplified bsd"),
    ("bsd-2-clause", 1, "freebsd license"), ("bsd-3-clause", 1, "bsd (?:3|three) clause"), ("bsd-3-clause", 1, "new bsd license"),
    ("bsd-3-clause", 1, "modified bsd license"), ("bsd-3-clause", 1, "revised bsd license"), ("bsd-4-clause", 1, "bsd (?:4|four) clause"),
    ("bsd", 1, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, "neither the name of [^ ]+ ?(?:[^ ]+ ){0,8}nor the names of its contributors may be used to endorse or promote"),
    ("isc", 1, "isc licen[cs]e"), ("isc", 1, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", 2, "mozilla public license"), ("epl", 2, "eclipse public license"), ("cddl", 2, "common development and distribution license"),
    ("eupl", 2, "european union public licen[cs]e"), ("artistic", 2, "artistic license"), ("artistic-perl", 1, "same terms as perl itself"),
    ("zlib", 1, "zlib (?:libpng )?license"), ("zlib", 1, "software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", 2, "boost software license"), ("unlicense", 1, "unlicense"), ("unlicense", 1, "free and unencumbered software released into the public domain"),
    ("wtfpl", 1, "wtfpl"), ("wtfpl", 1, "do what the fuck you want to public license"), ("beerware", 1, "beer ?ware license"),
    ("ofl", 2, "open font license"), ("psf", 2, "psf license"), ("psf", 2, "python software foundation license"), ("php", 2, "php license"),
    ("openssl", 1, "openssl license"), ("ssleay", 1, "ssleay license"), ("curl", 1, "curl license"), ("ncsa", 1, "university of illinois ncsa open source license"),
    ("postgresql", 1, "postgresql license"), ("ms-pl", 1, "microsoft public license"), ("ms-rl", 1, "microsoft reciprocal license"),
    ("ms-pl", 2, "ms pl"), ("ruby", 1, "ruby license"), ("vim", 1, "vim license"), ("tcl", 1, "tcl tk license"), ("w3c", 1, "w3c software (?:notice and )?license"),
    ("w3c", 2, "w3c document license"), ("unicode", 1, "unicode license agreement"), ("icu", 1, "icu license"), ("libpng", 1, "libpng license"),
    ("ijg", 1, "independent jpeg group"), ("ibm-pl", 1, "ibm public license"), ("apsl", 1, "apple public source license"), ("sun-spl", 1, "sun public license"),
    ("netscape", 1, "netscape public license"), ("nasa", 1, "nasa open source agreement"), ("intel", 1, "intel open source license"),
    ("sleepycat", 1, "sleepycat license"), ("watcom", 1, "sybase open watcom public license"), ("json", 1, "json license"),
    ("json", 1, "software shall be used for good not evil"), ("commons-clause", 1, "commons clause"), ("parity", 1, "parity public license"),
    ("polyform", 1, "polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial) license"), ("hippocratic", 1, "hippocratic license"),
    ("anti-996", 1, "anti 996 license"), ("upl", 1, "universal permissive license"), ("blueoak", 1, "blue oak model license"), ("naist", 1, "naist license"),
    ("openrail", 2, "openrail(?: license)?"), ("llama", 1, "llama (?:2|3|3 1|3 2) community license(?: agreement)?"), ("gemma", 1, "gemma terms of use"),
    ("odbl", 2, "open database license"), ("odc-by", 1, "odc by"), ("cdla", 2, "community data license agreement"), ("etalab", 1, "licence ouverte"),
    ("dl-de", 1, "datenlizenz deutschland"), ("ogl-uk", 2, "open government licen[cs]e"), ("crown", 2, "crown copyright"),
    ("cc", 2, "creative commons licen[cs]e"), ("cc", 2, "creative commons"), ("cc0", 2, "cc0"), ("cc0", 2, "creative commons zero"),
    ("public-domain", 2, "public domain"), ("public-domain", 1, "dedicated to the public domain"), ("public-domain", 1, "placed in the public domain"),
    ("public-domain", 1, "released into the public domain"), ("copyleft", 2, "copyleft"), ("copyright", 2, "copyright (?:c )?[0-9]{4}"),
    ("copyright", 2, "copyright by"), ("copyright", 2, "copyrighted (?:material|work)"), ("reserved", 2, "some rights reserved"),
    ("reserved", 1, "all rights reserved"), ("no-rights-reserved", 1, "no rights reserved"), ("no-copying", 1, "unauthorized (?:copying|reproduction|distribution|use) (?:of this [^ ]+ )?(?:is )?(?:strictly )?prohibited"),
    ("no-copying", 1, "may not be reproduced (?:[^ ]+ ){0,12}without (?:the )?(?:prior )?(?:express )?written permission"), ("proprietary", 1, "proprietary and confidential"),
    ("proprietary", 1, "confidential and proprietary"), ("proprietary", 2, "proprietary license"), ("noncommercial", 2, "non commercial (?:use|purposes) only"),
    ("noncommercial", 2, "noncommercial (?:use|purposes) only"), ("personal-use", 2, "personal use only"), ("research-only", 2, "research (?:use|purposes) only"),
    ("eula", 2, "end user license agreement"), ("eula", 2, "software license agreement"), ("cla", 2, "contributor license agreement"),
    ("warranty-disclaimer", 2, "provided as is without warranty of any kind"), ("dual", 2, "dual licensed under"), ("licensed", 2, "licensed under the terms of"),
    ("licensed", 2, "licensed under"), ("licensed", 2, "released under the [^ ]+(?: [^ ]+){0,3} licen[cs]e"), ("licensed", 2, "distributed under the [^ ]+(?: [^ ]+){0,3} licen[cs]e"),
    ("license-file", 2, "see (?:the )?licen[cs]e(?: txt| md)? file"), ("license-id", 2, "spdx license identifier"),
)

# Keywords: every signature holds one of these words; texts without any are not looked at.
KEYWORDS = (
    "license licence licensed gpl gplv1 gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv1 agplv3 gfdl cc cc0 creative apache copyright copyrighted "
    "copyleft reserved domain permission redistribution mpl epl cddl eupl cecill odbl odc datenlizenz bsd mit ms perl openrail rail gemma "
    "neither unlicense warranty evil jpeg commons prohibited reproduced confidential noncommercial commercial personal research unencumbered wtfpl nasa"
).split()


def _version(text: str) -> tuple[str, str]:
    """A version as label and as regex: "3" is 3.0, written "3" or "3 0"."""
    whole, dot, part = text.partition(".")
    return (text, f"{whole} {part}") if dot else (f"{whole}.0", f"{whole}(?: 0)?")


def rules() -> list[tuple[str, int, str]]:
    """All rules in order: those with versions, Creative Commons, the others."""
    out = []
    for label, regex, versions in VERSIONED:
        for name, pattern in map(_version, versions.split()):
            out.append((label.replace("{l}", name), 1, regex.replace("{v}", pattern)))
    for short, long in CC_ELEMENTS.items():
        words = short.replace("-", " ")
        for name, pattern in map(_version, CC_VERSIONS.split()):
            out.append((f"cc-{short}-{name}", 1, f"cc {words} {pattern}"))
            out.append((f"cc-{short}-{name}", 1, f"creative commons {long} {pattern}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"))
        out.append((f"cc-{short}", 2, f"cc {words}"))
        out.append((f"cc-{short}", 2, f"creative commons {long}(?: licen[cs]e)?"))
    return out + list(PLAIN)


def anchored() -> list[tuple[int, str, str, int, str]]:
    """(number, anchor word, label, priority, regex) with the regex tied to both ends of words.

    A rule that begins with a choice of words counts once for each.
    """
    out = []
    for label, priority, regex in rules():
        choice = re.match(r"\(\?:([a-z0-9|]+)\)(?= )", regex)
        starts = choice[1].split("|") if choice else [re.match(r"[a-z0-9]+", regex)[0]]
        for word in starts:
            rest = regex[choice.end() :] if choice else regex[len(word) :]
            out.append((len(out), word, label, priority, f"^{word}{rest}(?: |$)"))
    return out
