"""The signature table of the license scan: written name, tag and address patterns of licenses, and the rule forms they fill."""

from __future__ import annotations

from dataclasses import dataclass

#: The phrases whose places are counted in any case, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_L = "licen[cs]e"
_V = "(?:v|version |v )?"

#: label | keyword that every match holds | name pattern | tag pattern | address pattern (- for none).
#: Patterns stand over words in lower case with one space between; digits of a version are words of their own.
TABLE = f"""
gpl-1.0 | gpl | gpl {_V}1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2.0 | gpl | (?:gnu )?gpl ?{_V}2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gpl | (?:gnu )?gpl ?{_V}3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl(?: 3 0)?
gpl-2.0 | general public | gnu general public {_L} {_V}2(?: 0)? | gpl2 | -
gpl-3.0 | general public | gnu general public {_L} {_V}3(?: 0)? | gpl3 | -
gpl | general public | (?:gnu )?general public {_L} | gpl | -
lgpl-2.0 | general public | (?:gnu )?library general public {_L}(?: {_V}2)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lesser | (?:gnu )?lesser general public {_L} {_V}2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public {_L} {_V}3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl(?: 3 0)?
lgpl | lesser | (?:gnu )?lesser general public {_L} | lgpl | -
agpl-3.0 | affero | (?:gnu )?affero general public {_L}(?: {_V}3(?: 0)?)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl(?: 3 0)?
gfdl | documentation | (?:gnu )?free documentation {_L}(?: {_V}1 [123])? | gfdl 1 [123](?: only| or later)? | gnu org licenses fdl(?: 1 3)?
apache-1.1 | apache | apache (?:software )?{_L} {_V}1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache (?:software )?{_L} {_V}2(?: 0)? | apache 2 0 | apache org licenses license 2 0
apache | apache | apache (?:software )?{_L} | apache | apache org licenses
mit | mit | (?:the )?mit {_L} | mit | opensource org licenses? mit
mit-0 | mit | mit no attribution(?: {_L})? | mit 0 | opensource org licenses? mit 0
x11 | x11 | x11 {_L} | x11 | -
isc | isc | isc {_L} | isc | opensource org licenses? isc
bsd-2-clause | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) {_L} | bsd 2 clause | opensource org licenses? bsd 2 clause
bsd-3-clause | bsd | (?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd) {_L} | bsd 3 clause | opensource org licenses? bsd 3 clause
bsd-4-clause | bsd | (?:original bsd|bsd 4 clause|4 clause bsd) {_L} | bsd 4 clause | -
0bsd | bsd | (?:zero clause bsd|0bsd|bsd zero clause) {_L} | 0bsd | opensource org licenses? 0bsd
bsd | bsd | bsd(?: style)? {_L} | bsd | -
mpl-1.1 | mozilla | mozilla public {_L} {_V}1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0 | mozilla | mozilla public {_L} {_V}2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
mpl | mozilla | mozilla public {_L} | mpl | mozilla org mpl
epl-1.0 | eclipse | eclipse public {_L} {_V}1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse | eclipse public {_L} {_V}2(?: 0)? | epl 2 0 | eclipse org legal epl (?:2 0|v20)
epl | eclipse | eclipse public {_L} | epl | -
cddl-1.0 | distribution | common development and distribution {_L}(?: {_V}1 0)? | cddl 1 0 | opensource org licenses? cddl 1
cddl-1.1 | distribution | common development and distribution {_L} {_V}1 1 | cddl 1 1 | -
cpl-1.0 | common public | common public {_L}(?: {_V}1 0)? | cpl 1 0 | opensource org licenses? cpl1 0
eupl-1.2 | european union | european union public {_L}(?: {_V}1 [012])? | eupl 1 [012] | -
cecill | cecill | cecill(?: b| c)?(?: free software)? {_L} | cecill (?:1 [01]|2 [01]|b|c) | cecill info licences
artistic-1.0 | artistic | artistic {_L} {_V}1(?: 0)? | artistic 1 0 | opensource org licenses? artistic 1 0
artistic-2.0 | artistic | artistic {_L}(?: {_V}2(?: 0)?)? | artistic 2 0 | opensource org licenses? artistic 2 0
zlib | zlib | zlib(?: libpng)? {_L} | zlib | opensource org licenses? zlib
libpng | libpng | libpng {_L} | libpng(?: 2 0)? | -
bsl-1.0 | boost | boost software {_L}(?: {_V}1 0)? | bsl 1 0 | boost org license 1 0
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | what the | do what the f[a-z]+ you want to public {_L} | wtfpl | wtfpl net
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero
cc-by-3.0 | cc by | cc by 3 0 | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | cc by | cc by 4 0 | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa | cc by sa | cc by sa(?: [1-4] [05])? | cc by sa [1-4] [05] | creativecommons org licenses by sa
cc-by-nc | cc by nc | cc by nc(?: [1-4] [05])? | cc by nc [1-4] [05] | creativecommons org licenses by nc
cc-by-nd | cc by nd | cc by nd(?: [1-4] [05])? | cc by nd [1-4] [05] | creativecommons org licenses by nd
cc-by-nc-sa | cc by nc | cc by nc sa(?: [1-4] [05])? | cc by nc sa [1-4] [05] | creativecommons org licenses by nc sa
cc-by-nc-nd | cc by nc | cc by nc nd(?: [1-4] [05])? | cc by nc nd [1-4] [05] | creativecommons org licenses by nc nd
cc-by | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: {_L})? | cc by | creativecommons org licenses by
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: {_L})? | - | -
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: {_L})? | - | -
odbl-1.0 | open data | open (?:data commons open )?database {_L} | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | open data | open data commons attribution {_L} | odc by 1 0 | opendatacommons org licenses by
pddl-1.0 | open data | open data commons public domain dedication(?: and {_L})? | pddl 1 0 | opendatacommons org licenses pddl
ofl-1.1 | open font | (?:sil )?open font {_L}(?: {_V}1 1)? | ofl 1 1 | scripts sil org ofl
openssl | openssl | openssl {_L} | openssl | -
openldap | openldap | openldap public {_L} | oldap 2 [0-8] | -
postgresql | postgresql | postgresql {_L} | postgresql | opensource org licenses? postgresql
psf-2.0 | python | python (?:software foundation )?{_L}(?: {_V}2)? | (?:psf|python) 2 0 | docs python org 3 license
ruby | ruby | ruby {_L} | ruby | -
php-3.01 | php | php {_L}(?: {_V}3 0?1)? | php 3 0?1 | php net license
vim | vim | vim {_L} | vim | -
tcl | tcl | tcl(?: tk)? {_L} | tcl | -
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? {_L} | ncsa | opensource org licenses? ncsa
w3c | w3c | w3c(?: software(?: notice)?(?: and)?)? {_L} | w3c | w3 org consortium legal
ms-pl | microsoft | microsoft public {_L} | ms pl | opensource org licenses? ms pl
ms-rl | microsoft | microsoft reciprocal {_L} | ms rl | opensource org licenses? ms rl
apsl-2.0 | apple | apple public source {_L}(?: {_V}2 0)? | apsl 2 0 | opensource apple com apsl
afl-3.0 | academic | academic free {_L}(?: {_V}[123] [01])? | afl [123] [01] | opensource org licenses? afl 3 0
osl-3.0 | open software | open software {_L}(?: {_V}[123] 0)? | osl [123] 0 | opensource org licenses? osl 3 0
qpl-1.0 | q public | q public {_L} | qpl 1 0 | -
sleepycat | sleepycat | sleepycat {_L} | sleepycat | -
zpl-2.1 | zope | zope public {_L}(?: {_V}2 [01])? | zpl 2 [01] | -
curl | curl | curl {_L} | curl | -
icu | icu | icu {_L} | icu | -
unicode | unicode | unicode (?:terms of use|{_L}) | unicode (?:dfs 201[56]|3 0) | unicode org copyright
json | json | json {_L} | json | json org license
beerware | beer | the beer ?ware {_L} | beerware | -
busl-1.1 | business source | business source {_L}(?: 1 1)? | busl 1 1 | mariadb com bsl11
sspl-1.0 | server side | server side public {_L}(?: {_V}1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic {_L}(?: 2 0)? | elastic 2 0 | elastic co licensing elastic license
proprietary | all rights | all rights reserved | - | -
proprietary | proprietary | proprietary(?: and confidential| {_L}| software) | - | -
public-domain | public domain | (?:in|into|to) the public domain | - | -
copyright | copyright | copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])* | - | -
"""

#: Rule forms: name, priority, weight, which part of a license they need, the pattern around it, keyword of their own.
FORMS = (
    ("tag", 4, 1.0, "tag", "spdx licen[cs]e identifiers? {}", "spdx"),
    ("grant", 3, 0.9, "name", "(?:licensed|released|distributed|available|published|provided|redistributed)(?: to you)? (?:under|with|according to|subject to|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}", None),
    ("address", 3, 0.8, "address", "(?:https? )?(?:www )?{}(?: (?:html|txt|legalcode|deed))*", None),
    ("field", 2, 0.7, "tag", "licen[cs]es?(?: type| name| id| expression)? {}", "licen"),
    ("mention", 1, 0.6, "name", "{}", None),
)
#: A base phrase is a mention too.
BASE_PRIORITY, BASE_WEIGHT = 1, 0.6

#: Document gate: a text without any of these or of GATE_SPLIT, in lower case, holds no match of any rule.
GATE = ("licen", "copyright", "spdx", "gpl", "creative", "proprietary", "cc0", "mozilla", "eclipse", "wtfpl", "ofl", "w3", "apsl", "bsl11", " org ", ".org", ".com", ".net", ".info")
_S = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Terms of several words, which any separators may part: a part that is looked for first, and the whole.
GATE_SPLIT = tuple((part, words.replace(" ", _S)) for part, words in (("cc", "cc by"), ("domain", "public domain"), ("rights", "all rights"), ("commons", "open data commons"), ("terms", "terms of use"), ("attribution", "no attribution")))


@dataclass(frozen=True)
class Signature:
    order: int
    label: str
    form: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    base: bool


def signatures() -> list[Signature]:
    """All rules in order: base phrases, then each license in table order under each form."""
    found: list[tuple[str, str, int, float, str, str, bool]] = [(label, "base", BASE_PRIORITY, BASE_WEIGHT, phrase, phrase, True) for phrase, label in BASE]
    rows = [[part.strip() for part in line.split(" | ")] for line in TABLE.strip().splitlines()]
    for label, keyword, name, tag, address in rows:
        parts = {"name": name, "tag": tag, "address": address}
        for form, priority, weight, part, around, own in FORMS:
            if parts[part] != "-":
                needs = own or (keyword if part == "name" else address.split(" ")[0].split("(")[0])
                found.append((label, form, priority, weight, needs, around.format(f"(?:{parts[part]})"), False))
    return [Signature(i, label, form, priority, weight, keyword, pattern, base) for i, (label, form, priority, weight, keyword, pattern, base) in enumerate(found)]
