"""Signature rules of the licence scan, as text.

Grammar of a pattern: words in lower case separated by single spaces, each a regular expression
over letters and digits that both Java and RE2 read; a word that ends in ``?`` is optional.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    tier: int  #: 1 is the strongest; a detection hides what it contains of its own or a weaker tier
    keyword: str  #: must occur in the lower-cased text, else the pattern isn't tried
    pattern: str
    base: bool = False


CONFIDENCE = {1: 0.99, 2: 0.95, 3: 0.8, 4: 0.5}

#: Phrases whose places are always reported, hidden or not.
BASE = (
    Rule("mit", 4, "license", "mit license", True),
    Rule("apache", 4, "license", "apache license", True),
    Rule("gpl", 4, "license", "general public license", True),
)

#: label ; keyword ; name. Each name also makes a rule of tier 2 when a grant leads up to it.
NAMES = """
mit ; mit ; mit x11? licen[cs]e
mit ; expat ; expat licen[cs]e
mit-0 ; attribution ; mit no attribution licen[cs]e?
x11 ; x11 ; x11 licen[cs]e
isc ; isc ; isc licen[cs]e
isc ; internet ; internet (?:systems|software) consortium licen[cs]e
0bsd ; 0bsd ; 0bsd licen[cs]e?
0bsd ; bsd ; (?:zero|0) clause bsd licen[cs]e?
bsd-2-clause ; bsd ; (?:2|two) clause bsd licen[cs]e?
bsd-2-clause ; simplified ; simplified bsd licen[cs]e
bsd-2-clause ; freebsd ; freebsd licen[cs]e
bsd-2-clause ; bsd ; bsd (?:2|two) clause licen[cs]e?
bsd-3-clause ; bsd ; (?:3|three) clause bsd licen[cs]e?
bsd-3-clause ; bsd ; bsd (?:3|three) clause licen[cs]e?
bsd-3-clause ; bsd ; (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause ; bsd ; (?:4|four) clause bsd licen[cs]e?
bsd-4-clause ; bsd ; (?:original|old) bsd licen[cs]e
bsd ; bsd ; bsd style? licen[cs]e
apache-1.0 ; apache ; apache (?:software)? licen[cs]e version? v?1 0
apache-1.1 ; apache ; apache software? licen[cs]e version? v?1 1
apache-2.0 ; apache ; apache software? licen[cs]e version? v?2 0?
apache-2.0 ; apache ; apache v?2 0? licen[cs]e
apache ; apache ; apache software? foundation? licen[cs]e
gpl-1.0 ; gpl ; gnu? gpl version? v?1 0?
gpl-2.0 ; gpl ; gnu? gpl version? v?2 0?
gpl-2.0 ; gplv2 ; gnu? gplv2
gpl-3.0 ; gpl ; gnu? gpl version? v?3 0?
gpl-3.0 ; gplv3 ; gnu? gplv3
gpl-1.0 ; general ; gnu? general public licen[cs]e gpl? version? v?1 0?
gpl-2.0 ; general ; gnu? general public licen[cs]e gpl? version? v?2 0?
gpl-3.0 ; general ; gnu? general public licen[cs]e gpl? version? v?3 0?
gpl ; general ; gnu general public licen[cs]e
gpl ; gpl ; gnu gpl licen[cs]e?
lgpl-2.0 ; library ; gnu? library general public licen[cs]e version? v?2? 0?
lgpl-2.1 ; lesser ; gnu? lesser general public licen[cs]e lgpl? version? v?2 1
lgpl-3.0 ; lesser ; gnu? lesser general public licen[cs]e lgpl? version? v?3 0?
lgpl-2.1 ; lgpl ; gnu? lgpl version? v?2 1
lgpl-3.0 ; lgpl ; gnu? lgpl version? v?3 0?
lgpl ; lesser ; gnu? lesser general public licen[cs]e
lgpl ; lgpl ; gnu? lgpl licen[cs]e?
agpl-3.0 ; affero ; gnu? affero general public licen[cs]e agpl? version? v?3 0?
agpl-3.0 ; agpl ; gnu? agpl version? v?3 0?
agpl-1.0 ; affero ; affero general public licen[cs]e version? v?1 0?
agpl ; affero ; gnu? affero general public licen[cs]e
gfdl-1.1 ; documentation ; gnu? free documentation licen[cs]e version? v?1 1
gfdl-1.2 ; documentation ; gnu? free documentation licen[cs]e version? v?1 2
gfdl-1.3 ; documentation ; gnu? free documentation licen[cs]e version? v?1 3
gfdl ; documentation ; gnu? free documentation licen[cs]e
mpl-1.0 ; mozilla ; mozilla public licen[cs]e mpl? version? v?1 0
mpl-1.1 ; mozilla ; mozilla public licen[cs]e mpl? version? v?1 1
mpl-2.0 ; mozilla ; mozilla public licen[cs]e mpl? version? v?2 0?
mpl-2.0 ; mpl ; mpl version? v?2 0?
mpl ; mozilla ; mozilla public licen[cs]e
epl-1.0 ; eclipse ; eclipse public licen[cs]e epl? version? v?1 0?
epl-2.0 ; eclipse ; eclipse public licen[cs]e epl? version? v?2 0?
epl ; eclipse ; eclipse public licen[cs]e
edl-1.0 ; eclipse ; eclipse distribution licen[cs]e version? v?1? 0?
cddl-1.0 ; common ; common development and distribution licen[cs]e cddl? version? v?1 0?
cddl-1.1 ; common ; common development and distribution licen[cs]e cddl? version? v?1 1
cddl ; common ; common development and distribution licen[cs]e
cpl-1.0 ; common ; common public licen[cs]e version? v?1? 0?
cpal-1.0 ; common ; common public attribution licen[cs]e version? v?1? 0?
ipl-1.0 ; ibm ; ibm public licen[cs]e version? v?1? 0?
osl-3.0 ; open ; open software licen[cs]e version? v?3 0?
osl ; open ; open software licen[cs]e
afl-3.0 ; academic ; academic free licen[cs]e version? v?3 0?
afl ; academic ; academic free licen[cs]e
artistic-1.0 ; artistic ; artistic licen[cs]e version? v?1 0
artistic-2.0 ; artistic ; artistic licen[cs]e version? v?2 0?
artistic ; artistic ; (?:perl|clarified)? artistic licen[cs]e
zlib ; zlib ; zlib libpng? licen[cs]e
libpng ; libpng ; libpng licen[cs]e version? v?2? 0?
bsl-1.0 ; boost ; boost software licen[cs]e version? v?1? 0?
busl-1.1 ; business ; business source licen[cs]e version? v?1? 1?
sspl-1.0 ; server ; server side public licen[cs]e version? v?1? 0?
elastic-2.0 ; elastic ; elastic licen[cs]e version? v?2? 0?
unlicense ; unlicense ; the? unlicense
wtfpl ; wtfpl ; wtfpl version? v?2? 0?
wtfpl ; fuck ; do what the fuck you want to public licen[cs]e
psf-2.0 ; python ; python software foundation licen[cs]e version? v?2? 0?
python-2.0 ; python ; python licen[cs]e version? v?2? 0?
php-3.0 ; php ; php licen[cs]e version? v?3 0
php-3.01 ; php ; php licen[cs]e version? v?3 01
ruby ; ruby ; ruby licen[cs]e
openssl ; openssl ; openssl (?:ssleay)? licen[cs]e
postgresql ; postgresql ; postgresql licen[cs]e
w3c ; w3c ; w3c software (?:notice)? and? licen[cs]e
ofl-1.1 ; sil ; sil open font licen[cs]e ofl? version? v?1? 1?
ofl-1.1 ; font ; open font licen[cs]e version? v?1 1
ncsa ; ncsa ; (?:university)? of? illinois? ncsa open source licen[cs]e
ecl-2.0 ; educational ; educational community licen[cs]e version? v?2? 0?
eupl-1.1 ; european ; european union public licen[cs]e eupl? version? v?1 1
eupl-1.2 ; european ; european union public licen[cs]e eupl? version? v?1 2
eupl ; european ; european union public licen[cs]e
cecill-2.1 ; cecill ; cecill (?:free)? software? licen[cs]e agreement? version? v?2 1
cecill ; cecill ; cecill (?:free)? software? licen[cs]e
ms-pl ; microsoft ; microsoft public licen[cs]e
ms-rl ; microsoft ; microsoft reciprocal licen[cs]e
vim ; vim ; vim licen[cs]e
beerware ; beer ; beer ware licen[cs]e
beerware ; beerware ; beerware licen[cs]e
mulan-psl-2.0 ; mulan ; mulan permissive software licen[cs]e version? v?2? 0?
upl-1.0 ; universal ; universal permissive licen[cs]e version? v?1? 0?
cc0-1.0 ; cc0 ; cc0 1? 0? universal?
cc0-1.0 ; commons ; creative commons zero version? v?1? 0?
cc-by-1.0 ; commons ; creative commons attribution 1 0
cc-by-2.0 ; commons ; creative commons attribution 2 0
cc-by-2.5 ; commons ; creative commons attribution 2 5
cc-by-3.0 ; commons ; creative commons attribution 3 0
cc-by-4.0 ; commons ; creative commons attribution 4 0
cc-by-sa-2.0 ; commons ; creative commons attribution sharealike 2 0
cc-by-sa-2.5 ; commons ; creative commons attribution sharealike 2 5
cc-by-sa-3.0 ; commons ; creative commons attribution sharealike 3 0
cc-by-sa-4.0 ; commons ; creative commons attribution sharealike 4 0
cc-by-sa ; commons ; creative commons attribution sharealike
cc-by-sa ; commons ; creative commons attribution share alike
cc-by-nc-4.0 ; commons ; creative commons attribution noncommercial 4 0
cc-by-nc ; commons ; creative commons attribution noncommercial
cc-by-nc-sa-4.0 ; commons ; creative commons attribution noncommercial sharealike 4 0
cc-by-nc-sa ; commons ; creative commons attribution noncommercial sharealike
cc-by-nc-nd-4.0 ; commons ; creative commons attribution noncommercial noderivatives 4 0
cc-by-nc-nd ; commons ; creative commons attribution noncommercial (?:noderivatives|noderivs)
cc-by-nd-4.0 ; commons ; creative commons attribution noderivatives 4 0
cc-by-nd ; commons ; creative commons attribution (?:noderivatives|noderivs)
cc-by ; commons ; creative commons attribution licen[cs]e?
cc ; commons ; creative commons licen[cs]e
cc-by-1.0 ; cc ; cc by 1 0
cc-by-2.0 ; cc ; cc by 2 0
cc-by-3.0 ; cc ; cc by 3 0
cc-by-4.0 ; cc ; cc by 4 0
cc-by-sa-3.0 ; cc ; cc by sa 3 0
cc-by-sa-4.0 ; cc ; cc by sa 4 0
cc-by-sa ; cc ; cc by sa
cc-by-nc-3.0 ; cc ; cc by nc 3 0
cc-by-nc-4.0 ; cc ; cc by nc 4 0
cc-by-nc ; cc ; cc by nc
cc-by-nc-sa-3.0 ; cc ; cc by nc sa 3 0
cc-by-nc-sa-4.0 ; cc ; cc by nc sa 4 0
cc-by-nc-sa ; cc ; cc by nc sa
cc-by-nc-nd-3.0 ; cc ; cc by nc nd 3 0
cc-by-nc-nd-4.0 ; cc ; cc by nc nd 4 0
cc-by-nc-nd ; cc ; cc by nc nd
cc-by-nd-3.0 ; cc ; cc by nd 3 0
cc-by-nd-4.0 ; cc ; cc by nd 4 0
cc-by-nd ; cc ; cc by nd
odbl-1.0 ; open ; open database licen[cs]e odbl? version? v?1? 0?
odc-by-1.0 ; open ; open data commons attribution licen[cs]e
pddl-1.0 ; public ; public domain dedication and licen[cs]e
cdla-permissive-2.0 ; community ; community data licen[cs]e agreement permissive version? v?2? 0?
ogl-uk-3.0 ; open ; open government licen[cs]e version? v?3 0?
ogl ; open ; open government licen[cs]e
openrail-m ; openrail ; (?:bigscience)? openrail m? licen[cs]e?
llama-community ; llama ; llama [0-9]? community licen[cs]e agreement?
etalab-2.0 ; ouverte ; licence ouverte version? 2? 0?
""".strip()

#: tier ; label ; keyword ; pattern: sentences of licence texts and notices.
SENTENCES = """
1 ; mit ; permission ; permission is hereby granted free of charge to any person obtaining a copy
1 ; mit ; substantial ; copyright notice and this permission notice shall be included in all copies or substantial portions
1 ; isc ; permission ; permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
1 ; bsd ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
1 ; bsd-2-clause ; redistributions ; redistributions of source code must retain the above copyright notice
1 ; bsd-2-clause ; redistributions ; redistributions in binary form must reproduce the above copyright notice
1 ; bsd-3-clause ; endorse ; may be used to endorse or promote products derived from this software
1 ; bsd-4-clause ; advertising ; all advertising materials mentioning features or use of this software must display
1 ; apache-2.0 ; compliance ; you may not use this file except in compliance with the licen[cs]e
1 ; apache-2.0 ; warranties ; distributed on an as is basis without warranties or conditions of any kind
1 ; apache-2.0 ; irrevocable ; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
1 ; gpl ; redistribute ; this (?:program|library|file|software) is free software you can redistribute it and or modify it
1 ; gpl ; verbatim ; everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
1 ; gpl ; merchantability ; without even the implied warranty of merchantability or fitness for a particular purpose
2 ; gpl-2.0-or-later ; either ; either version 2 of the licen[cs]e or at your option any later version
2 ; gpl-3.0-or-later ; either ; either version 3 of the licen[cs]e or at your option any later version
2 ; lgpl-2.1-or-later ; either ; either version 2 1 of the licen[cs]e or at your option any later version
1 ; agpl-3.0 ; interacting ; users interacting with it remotely through a computer network
1 ; mpl-2.0 ; subject ; this source code form is subject to the terms of the mozilla public licen[cs]e
1 ; epl-2.0 ; accompanying ; this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
1 ; cddl ; subject ; the contents of this file are subject to the terms of the common development and distribution licen[cs]e
1 ; zlib ; plainly ; altered source versions must be plainly marked as such
1 ; zlib ; misrepresented ; the origin of this software must not be misrepresented
1 ; bsl-1.0 ; boost ; distributed under the boost software licen[cs]e
1 ; unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
1 ; wtfpl ; fuck ; you just do what the fuck you want to
1 ; cc0-1.0 ; waived ; (?:has|have) waived all copyright and related or neighboring rights
1 ; cc0-1.0 ; domain ; dedicated the work to the public domain
1 ; ofl-1.1 ; font ; this font software is licensed under the sil open font licen[cs]e
2 ; public-domain ; domain ; (?:released|placed|dedicated|put) (?:into|in|to) the public domain
3 ; public-domain ; domain ; (?:is|are) in the public domain
2 ; all-rights-reserved ; reserved ; copyright c? [0-9]+ .?[a-z]+ all rights reserved
3 ; all-rights-reserved ; reserved ; all rights reserved
3 ; proprietary ; proprietary ; proprietary and confidential
3 ; proprietary ; proprietary ; proprietary licen[cs]e
3 ; proprietary ; prohibited ; unauthorized (?:copying|reproduction|distribution) of this (?:file|document|work) is strictly prohibited
3 ; no-redistribution ; redistribute ; may not (?:be)? (?:copied|copy|redistribute|redistributed) without (?:prior)? written permission
3 ; non-commercial ; commercial ; for non commercial use only
3 ; non-commercial ; noncommercial ; for noncommercial use only
3 ; research-only ; research ; for research (?:use|purposes) only
4 ; copyright-notice ; copyright ; copyright c? (?:19|20)[0-9][0-9]
4 ; see-license-file ; licen ; see (?:the)? licen[cs]e file
4 ; licensed ; licensed ; licensed under
4 ; licensed ; licenced ; licenced under
4 ; no-warranty ; warranty ; provided as is without (?:any)? warranty of any kind
4 ; no-warranty ; liable ; in no event shall the authors? or copyright holders be liable
""".strip()

#: Keywords that are too short to tell anything are looked for in these forms.
_SHORT = {"cc": ("cc by", "cc-by"), "mpl": ("mpl 2", "mpl-2")}

_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|shared|used) (?:under|through|by) (?:the|a|an)? (?:terms)? (?:of)? (?:the)? (?:gnu)?"


def rules() -> list[Rule]:
    """All rules in order of priority; names stand thrice: as a mention, a grant and an SPDX tag."""
    out = list(BASE)
    ids: dict[str, str] = {}
    for line in NAMES.splitlines():
        label, keyword, name = line.split(" ; ")
        for written in _SHORT.get(keyword, (keyword,)):
            out.append(Rule(label, 2, written, f"{_GRANT} {name}"))
            out.append(Rule(label, 3, written, name))
        ids.setdefault(label, label.replace(".", " ").replace("-", " "))
    out += [Rule(label, 1, "spdx", f"spdx licen[cs]e identifier {words}") for label, words in ids.items()]
    for line in SENTENCES.splitlines():
        tier, label, keyword, pattern = line.split(" ; ")
        out.append(Rule(label, int(tier), keyword, pattern))
    return out


def compiled(pattern: str) -> str:
    """The pattern over a text in which word k is written `` k#word ``."""
    units = []
    for word in pattern.split(" "):
        optional = word.endswith("?")
        units.append(f"(?: [0-9]+#(?:{word.removesuffix('?')}) )" + "?" * optional)
    return "".join(units)
