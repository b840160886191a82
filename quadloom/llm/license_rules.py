"""The signature rules of the license scan.

Two kinds, both written by hand: ``SIGNATURES`` are passages of license texts,
notices, headers and addresses, one regular expression each; ``NAMES`` are names
of licenses, which count in each of ``PHRASINGS`` ("licensed under ...").

All patterns run over lower-cased words joined by single spaces (punctuation is
gone), padded with a space at both ends. A rule is (keyword, pattern, label,
priority, weight); the keyword must occur for the pattern to be tried.
"""

from __future__ import annotations

import re._constants as _sre
import re._parser as _parser
from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str
    pattern: str
    label: str
    priority: int
    weight: float


_LICENSE = "licen[cs]es?"
_VERSION = "(?: v| version)?"

#: Names: label, keyword, pattern of the name. Fixed values, hand-written.
NAMES = [
    ("apache-1.0", "apache", f"apache(?: software)?(?: {_LICENSE})?{_VERSION} ?1 0"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: {_LICENSE})?{_VERSION} ?1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: {_LICENSE})?{_VERSION} ?2(?: 0)?"),
    ("apache", "apache", f"apache(?: software)? {_LICENSE}"),
    ("mit", "mit", f"(?:expat|mit(?: x11)?) {_LICENSE}"),
    ("mit-0", "mit", "mit no attribution"),
    ("x11", "x11", f"x11 {_LICENSE}"),
    ("bsd-2-clause", "bsd", f"(?:simplified|freebsd|2 clause|two clause)(?: bsd)? {_LICENSE}|bsd 2 clause(?: {_LICENSE})?"),
    ("bsd-3-clause", "bsd", f"(?:new|modified|revised|3 clause|three clause) bsd(?: {_LICENSE})?|bsd 3 clause(?: {_LICENSE})?"),
    ("bsd-4-clause", "bsd", f"(?:original|4 clause|four clause) bsd(?: {_LICENSE})?|bsd 4 clause(?: {_LICENSE})?"),
    ("0bsd", "bsd", f"(?:zero clause bsd|0bsd)(?: {_LICENSE})?"),
    ("bsd", "bsd", f"bsd(?: style)? {_LICENSE}"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public {_LICENSE}{_VERSION} ?1(?: 0)?"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public {_LICENSE}{_VERSION} ?2(?: 0)?"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public {_LICENSE}{_VERSION} ?3(?: 0)?"),
    ("gpl-2.0-short", "gpl", f"(?:gnu )?gpl{_VERSION} ?v?2(?: 0)?"),
    ("gpl-3.0-short", "gpl", f"(?:gnu )?gpl{_VERSION} ?v?3(?: 0)?"),
    ("gpl-any", "general public", f"gnu general public {_LICENSE}"),
    ("lgpl-2.0", "general public", f"(?:lesser|library) general public {_LICENSE}{_VERSION} ?2(?: 0)?"),
    ("lgpl-2.1", "general public", f"lesser general public {_LICENSE}{_VERSION} ?2 1"),
    ("lgpl-3.0", "general public", f"lesser general public {_LICENSE}{_VERSION} ?3(?: 0)?"),
    ("lgpl", "gpl", f"(?:gnu )?lgpl(?:{_VERSION} ?v?[23](?: [01])?)?"),
    ("agpl-3.0", "general public", f"affero general public {_LICENSE}(?:{_VERSION} ?3(?: 0)?)?"),
    ("agpl", "gpl", f"(?:gnu )?agpl(?:{_VERSION} ?v?3(?: 0)?)?"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {_LICENSE}"),
    ("mpl-1.0", "mozilla", f"mozilla public {_LICENSE}{_VERSION} ?1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LICENSE}{_VERSION} ?1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_LICENSE}{_VERSION} ?2(?: 0)?"),
    ("mpl", "mozilla", f"mozilla public {_LICENSE}"),
    ("epl-1.0", "eclipse", f"eclipse public {_LICENSE}{_VERSION} ?1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public {_LICENSE}{_VERSION} ?2(?: 0)?"),
    ("cddl-1.0", "common development", f"common development and distribution {_LICENSE}"),
    ("cpl-1.0", "common public", f"common public {_LICENSE}"),
    ("eupl", "european", f"european union public {_LICENSE}"),
    ("isc", "isc", f"isc {_LICENSE}"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}"),
    ("bsl-1.0", "boost", f"boost software {_LICENSE}"),
    ("busl-1.1", "business source", f"business source {_LICENSE}"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("artistic-1.0", "artistic", f"artistic {_LICENSE}{_VERSION} ?1 0"),
    ("artistic-2.0", "artistic", f"artistic {_LICENSE}{_VERSION} ?2(?: 0)?"),
    ("artistic", "artistic", f"artistic {_LICENSE}"),
    ("psf-2.0", "python", f"python(?: software foundation)? {_LICENSE}"),
    ("php-3.0", "php", f"php {_LICENSE}"),
    ("ruby", "ruby", f"ruby {_LICENSE}"),
    ("ofl-1.1", "open font", f"(?:sil )?open font {_LICENSE}"),
    ("odbl-1.0", "open database", f"open database {_LICENSE}"),
    ("ms-pl", "microsoft public", f"microsoft public {_LICENSE}"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_LICENSE}"),
    ("cecill", "cecill", f"cecill(?: [abc])?(?: {_LICENSE})?"),
    ("public-domain", "public domain", "public domain"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
]
#: Creative Commons: element, its words; with each version and none.
CC_ELEMENTS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:atives|s)?(?: works)?"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)?(?: works)?"),
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0", ""]

_GRANT = "(?:licensed|released|distributed|published|available|provided|offered|covered|redistribute)(?: (?:it|to you))?"
_TERMS = "(?:the )?(?:terms (?:and conditions )?of )?(?:(?:the|an?) )?"
#: What announces a name in the same line.
HEADING = f"{_LICENSE}(?: is| type| name)? "
#: Phrasings: what stands around a name, its priority and weight. The higher priority holds.
PHRASINGS = [
    (f"spdx {_LICENSE} identifier {{name}}", 50, 1.0),
    (f"{_GRANT} under {_TERMS}{{name}}(?: {_LICENSE})?", 40, 0.95),
    (f"{HEADING}{{name}}", 30, 0.85),
    (f"under {_TERMS}{{name}}", 20, 0.7),
    ("{name}", 10, 0.5),
]
#: Passages: keyword, pattern, label, priority. Fixed values, hand-written; .{m,n}? stands for a name.
SIGNATURES = """apache | apache license version 2 0 january 2004 | apache-2.0 | 46
apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license | apache-2.0 | 48
apache | you may obtain a copy of the license at http www apache org licenses license 2 0 | apache-2.0 | 46
apache | www apache org licenses license 2 0 | apache-2.0 | 35
apache | apache software foundation asf under one or more contributor license agreements | apache-2.0 | 44
as is | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | apache-2.0 | 42
perpetual | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license | apache-2.0 | 44
perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license | apache-2.0 | 44
apache | apache software license version 1 1 | apache-1.1 | 46
apache | this product includes software developed by the apache software foundation | apache-1.1 | 42
apache | the names apache and apache software foundation must not be used to endorse | apache-1.1 | 44
permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | mit | 48
permission | permission is hereby granted free of charge | mit-text | 45
permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | mit | 46
sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software | mit | 44
as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | mit | 40
opensource | opensource org licenses mit | mit | 35
permission | permission is hereby granted without written agreement and without license or royalty fees | mit-modern-variant | 45
permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | isc | 48
permission | permission to use copy modify and or distribute this software | isc-text | 45
as is | the software is provided as is and the author disclaims all warranties with regard to this software | isc | 42
loss of use | in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits | isc | 42
permission | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted | hpnd | 46
permission | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee | hpnd-sell | 46
redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met | bsd-text | 46
redistribution | redistribution and use in source and binary forms | bsd-text | 45
redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | bsd-text | 44
redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer | bsd-text | 44
endorse | neither the name of .{1,60}? nor the names of its contributors may be used to endorse or promote products derived from this software | bsd-3-clause | 47
endorse | the name of the author may not be used to endorse or promote products derived from this software | bsd-3-clause | 46
advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | bsd-4-clause | 47
regents | regents of the university of california | bsd-uc | 30
as is | this software is provided by the copyright holders and contributors as is and any express or implied warranties | bsd-text | 42
exemplary | in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages | bsd-text | 42
perpetual | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide | bsd-2-clause-patent | 46
opensource | opensource org licenses bsd license | bsd | 35
free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version | gpl-2.0-or-later | 49
free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version | gpl-3.0-or-later | 49
free software | under the terms of the gnu general public license version 2 as published by the free software foundation | gpl-2.0 | 47
free software | under the terms of the gnu general public license version 3 as published by the free software foundation | gpl-3.0 | 47
later version | either version 2 of the license or at your option any later version | gpl-2.0-or-later | 40
later version | either version 3 of the license or at your option any later version | gpl-3.0-or-later | 40
free software | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license | lgpl-any | 47
free software | this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license | lgpl-2.0 | 47
later version | either version 2 1 of the license or at your option any later version | lgpl-2.1-or-later | 41
general public | you should have received a copy of the gnu general public license along with this program | gpl-any | 44
general public | you should have received a copy of the gnu lesser general public license along with this (?:library|program) | lgpl-any | 44
general public | you should have received a copy of the gnu affero general public license along with this program | agpl-3.0 | 44
general public | gnu general public license version 2 june 1991 | gpl-2.0 | 46
general public | gnu general public license version 3 29 june 2007 | gpl-3.0 | 46
general public | gnu lesser general public license version 2 1 february 1999 | lgpl-2.1 | 46
general public | gnu lesser general public license version 3 29 june 2007 | lgpl-3.0 | 46
general public | gnu library general public license version 2 june 1991 | lgpl-2.0 | 46
general public | gnu affero general public license version 3 19 november 2007 | agpl-3.0 | 46
share and change | the licenses for most software are designed to take away your freedom to share and change it | gpl-any | 42
verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed | gpl-family | 40
gnu org | gnu org licenses gpl 2 0 | gpl-2.0 | 36
gnu org | gnu org licenses gpl 3 0 | gpl-3.0 | 36
gnu org | gnu org licenses lgpl 2 1 | lgpl-2.1 | 36
gnu org | gnu org licenses lgpl 3 0 | lgpl-3.0 | 36
gnu org | gnu org licenses agpl 3 0 | agpl-3.0 | 36
gnu org | gnu org licenses(?: gpl)? | gpl-family | 25
exception | with the special exception that .{1,80}? linking this (?:library|program) | gpl-linking-exception | 43
classpath | gnu classpath exception|the classpath exception | classpath-exception | 43
exception | gcc runtime library exception | gcc-exception | 43
exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules | classpath-exception | 46
remotely | interacting with it remotely through a computer network | agpl-3.0 | 43
documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1 | gfdl-1.1 | 47
documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 | gfdl-1.2 | 47
documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 | gfdl-1.3 | 47
invariant | with no invariant sections no front cover texts and no back cover texts | gfdl | 42
mozilla | this source code form is subject to the terms of the mozilla public license v 2 0 | mpl-2.0 | 48
mozilla | if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0 | mpl-2.0 | 46
mozilla | mozilla org mpl 2 0 | mpl-2.0 | 36
mozilla | the contents of this file are subject to the mozilla public license version 1 1 | mpl-1.1 | 48
mozilla | the contents of this file are subject to the mozilla public license version 1 0 | mpl-1.0 | 48
netscape | the contents of this file are subject to the netscape public license version 1 1 | npl-1.1 | 47
incompatible | incompatible with secondary licenses as defined by the mozilla public license | mpl-2.0-no-copyleft | 47
eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0 | epl-1.0 | 48
eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license ?(?:v|version )? ?2 0 | epl-2.0 | 48
eclipse | eclipse org legal epl v10 | epl-1.0 | 36
eclipse | eclipse org legal epl 2 0 | epl-2.0 | 36
eclipse | eclipse distribution license v(?:ersion)? ?1 0 | edl-1.0 | 46
common development | the contents of this file are subject to the terms of the common development and distribution license | cddl-1.0 | 47
common development | common development and distribution license (?:cddl )?version 1 1 | cddl-1.1 | 46
common public | common public license version 1 0|common public license v 1 0 | cpl-1.0 | 45
ibm public | ibm public license version 1 0 | ipl-1.0 | 45
eupl | licensed under the eupl version 1 1 | eupl-1.1 | 46
eupl | licensed under the eupl version 1 2|licensed under the eupl v ?1 2 | eupl-1.2 | 46
altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | zlib | 46
origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software | zlib | 46
as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable | zlib | 44
libpng | this code is released under the libpng license | libpng | 46
boost | boost software license version 1 0 august 17th 2003 | bsl-1.0 | 46
boost | distributed under the boost software license version 1 0 | bsl-1.0 | 45
boost | boost org license 1 0 | bsl-1.0 | 36
machine executable | unless such copies or derivative works are solely in the form of machine executable object code | bsl-1.0 | 45
business source | business source license 1 1 | busl-1.1 | 45
change date | on the change date or the fourth anniversary of the first publicly available distribution | busl-1.1 | 45
server side | server side public license version 1 | sspl-1.0 | 45
sspl | sspl version 1 | sspl-1.0 | 45
elastic | elastic license 2 0|elastic license v2 | elastic-2.0 | 44
managed service | you may not provide the software to third parties as a hosted or managed service | elastic-2.0 | 46
commons clause | commons clause license condition v1 0|the commons clause | commons-clause | 43
confluent | confluent community license | confluent-community | 40
polyform | polyform noncommercial license | polyform-noncommercial | 42
polyform | polyform small business license | polyform-small-business | 42
unencumbered | this is free and unencumbered software released into the public domain | unlicense | 48
benefit | for the benefit of the public at large and to the detriment of our heirs and successors | unlicense | 46
unlicense | unlicense org | unlicense | 35
do what | do what the fuck you want to public license | wtfpl | 48
public domain | dedicated to the public domain|placed in the public domain|released into the public domain | public-domain | 38
public domain | this (?:file|code|work|software) is in the public domain | public-domain | 38
public domain | united states government work .{1,80}? public domain | us-government | 38
dedication | public domain dedication and license | pddl-1.0 | 44
artistic | the artistic license 2 0 copyright c 2000 2006 the perl foundation | artistic-2.0 | 47
perl | under the same terms as perl(?: itself)? | perl | 42
artistic | the clarified artistic license | artistic-1.0-clarified | 44
python | python software foundation license version 2 | psf-2.0 | 46
cnri | cnri open source license agreement|cnri python license | cnri-python | 42
python | license agreement for python | psf | 42
php | this source file is subject to version 3 01 of the php license | php-3.01 | 47
php | this source file is subject to version 3 0 of the php license | php-3.0 | 47
php | this product includes php software freely available from | php-3.0 | 43
zend | zend engine license version 2 00 | zend-2.0 | 44
ruby | under the same terms as ruby|ruby s licen[cs]e | ruby | 42
open font | this font software is licensed under the sil open font license version 1 1 | ofl-1.1 | 48
font software | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself | ofl-1.1 | 45
reserved font | reserved font name | ofl-1.1 | 34
bitstream | bitstream vera fonts copyright | bitstream-vera | 42
open database | made available under the open database license | odbl-1.0 | 46
open data commons | open data commons attribution license | odc-by-1.0 | 44
opendatacommons | opendatacommons org licenses odbl | odbl-1.0 | 40
open data commons | open data commons open database license | odbl-1.0 | 40
community data | community data license agreement permissive version 2 0 | cdla-permissive-2.0 | 45
community data | community data license agreement permissive version 1 0 | cdla-permissive-1.0 | 45
community data | community data license agreement sharing version 1 0 | cdla-sharing-1.0 | 45
open government | open government licen[cs]e v(?:ersion)? ?3 0|open government licen[cs]e v3 | ogl-uk-3.0 | 44
open government | contains public sector information licensed under the open government licen[cs]e | ogl-uk | 46
open government | open government licen[cs]e canada | ogl-canada | 44
datenlizenz | datenlizenz deutschland (?:namensnennung )?(?:version )?2 0 | dl-de-by-2.0 | 44
licence ouverte | licence ouverte(?: open licence)?(?: version)? ?(?:2 0|v2 0)? | etalab-2.0 | 42
microsoft | microsoft public license ms pl | ms-pl | 46
microsoft | microsoft reciprocal license ms rl | ms-rl | 46
microsoft | microsoft limited public license | ms-lpl | 44
microsoft | microsoft software license terms | microsoft-eula | 38
oracle | oracle binary code license agreement | oracle-bcl | 42
oracle | oracle technology network license agreement | otn | 42
sun | sun industry standards source license | sissl | 44
sun | sun microsystems inc binary code license agreement | sun-bcl | 42
non warranted | international license agreement for non warranted programs | ibm-ilan | 42
intel | intel open source license | intel | 42
intel | intel simplified software license | intel-simplified | 42
nvidia | nvidia software license agreement|nvidia source code license | nvidia | 40
qualcomm | qualcomm technologies inc proprietary | proprietary | 38
cecill | ce logiciel est regi par la licence cecill b | cecill-b | 47
cecill | ce logiciel est r[eé]gi par la licence cecill | cecill | 45
cecill | governed by the cecill(?: [abc])? license under french law | cecill | 45
academic | academic free license version 3 0|licensed under the academic free license | afl-3.0 | 45
open software | open software license version 3 0|licensed under the open software license version 3 0 | osl-3.0 | 45
open software | open software license version 2 1 | osl-2.1 | 45
educational | educational community license version 2 0 | ecl-2.0 | 46
universal permissive | universal permissive license v(?:ersion)? ?1 0|the universal permissive license | upl-1.0 | 45
blue oak | blue oak model license | blueoak-1.0.0 | 45
mulan | mulan psl v2|mulan permissive software license v(?:ersion)? ?2 | mulanpsl-2.0 | 45
vim | this is the vim license|vim license | vim | 36
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | openssl | 46
eric young | this package is an ssl implementation written by eric young | ssleay | 46
curl | curl and libcurl are licensed under|curl license | curl | 36
icu | icu license icu 1 8 1 and later | icu | 44
unicode | unicode license v3|unicode inc license agreement data files and software | unicode | 44
w3c | w3c software notice and license|w3c software and document notice and license | w3c | 44
w3c | w3c document license | w3c-document | 42
ietf | this document is subject to bcp 78 and the ietf trust s legal provisions | ietf-trust | 44
not evil | the software shall be used for good not evil | json | 48
beer ware | the beer ware license revision 42 | beerware | 44
beerware | beerware license | beerware | 40
postgresql | postgresql is released under the postgresql license|postgresql license | postgresql | 40
blessing | the author disclaims copyright to this source code in place of a legal notice here is a blessing | sqlite-blessing | 47
delaware | the university of delaware makes no representations about the suitability this software | ntp | 44
freetype | freetype project license|the freetype license ftl | ftl | 44
jpeg | this software is based in part on the work of the independent jpeg group | ijg | 45
imagemagick | imagemagick license | imagemagick | 40
hereby grant | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose | tcl | 46
x net | x net license | xnet | 40
xfree86 | xfree86 project inc license|xfree86 license | xfree86-1.0 | 42
x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising | x11 | 46
ncsa | university of illinois ncsa open source license | ncsa | 46
llvm | llvm release license|apache license v2 0 with llvm exceptions | llvm | 44
latex | latex project public license | lppl | 44
lppl | lppl version 1 3c|conditions of the lppl | lppl-1.3c | 43
db software | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software | sleepycat | 47
sgi | sgi free software license b | sgi-b-2.0 | 44
apple | apple public source license version 2 0|apple public source license | apsl-2.0 | 44
reciprocal | reciprocal public license 1 5|reciprocal public license | rpl-1.5 | 43
common public attribution | common public attribution license | cpal-1.0 | 44
adaptive public | adaptive public license | apl-1.0 | 42
nasa | nasa open source agreement | nasa-1.3 | 44
cern | cern open hardware licen[cs]e(?: version)? ?(?:2|v1 2)? | cern-ohl | 42
solderpad | solderpad hardware licen[cs]e | shl | 42
open publication | open publication license | opubl-1.0 | 42
free art | free art license | lal-1.3 | 42
art libre | licence art libre | lal-1.3 | 42
openrail | bigscience openrail m | openrail | 43
open rail | creativeml open rail m|open rail license | openrail | 43
llama | llama (?:2|3) community license(?: agreement)? | llama-community | 43
gemma | gemma terms of use | gemma | 40
responsible | responsible ai license | rail | 40
hippocratic | hippocratic license version 2 1|hippocratic license | hippocratic-2.1 | 43
anti 996 | anti 996 license | anti-996 | 42
research | for non ?commercial research purposes only|for research purposes only | research-only | 30
commercial use only | for non ?commercial use only | non-commercial | 30
evaluation | for evaluation purposes only | evaluation-only | 30
internal use | for internal use only | internal-only | 26
trade secret | contains trade secrets (?:and|or) proprietary information | proprietary | 36
confidential | confidential and proprietary | proprietary | 36
proprietary | proprietary and confidential | proprietary | 25
unauthorized | unauthorized copying of this file via any medium is strictly prohibited | proprietary | 46
unauthorized | any unauthorized (?:copying|use|reproduction|distribution) .{0,40}?is (?:strictly )?prohibited | proprietary | 36
reproduced | no part of this (?:book|publication|document|work) may be reproduced | all-rights-reserved | 42
written permission | without (?:the )?prior written permission of the (?:publisher|author|copyright holder) | all-rights-reserved | 34
reserved | all rights reserved | all-rights-reserved | 20
reserved | all rights are reserved | all-rights-reserved | 20
vorbehalten | alle rechte vorbehalten | all-rights-reserved | 20
droits | tous droits r[eé]serv[eé]s | all-rights-reserved | 20
derechos | todos los derechos reservados | all-rights-reserved | 20
copyright | copyright (?:c )?(?:19|20)[0-9][0-9] | copyright-notice | 15
end user | end user license agreement | eula | 24
agree to be bound | by (?:installing|downloading|using) .{1,60}? you agree to be bound by the terms | eula | 34
shareware | this program is shareware|shareware version | shareware | 28
freeware | this (?:program|software) is freeware | freeware | 28
creativecommons | creativecommons org licenses by sa 4 0 | cc-by-sa-4.0 | 36
creativecommons | creativecommons org licenses by sa 3 0 | cc-by-sa-3.0 | 36
creativecommons | creativecommons org licenses by nc sa 4 0 | cc-by-nc-sa-4.0 | 37
creativecommons | creativecommons org licenses by nc sa 3 0 | cc-by-nc-sa-3.0 | 37
creativecommons | creativecommons org licenses by nc nd 4 0 | cc-by-nc-nd-4.0 | 37
creativecommons | creativecommons org licenses by nc nd 3 0 | cc-by-nc-nd-3.0 | 37
creativecommons | creativecommons org licenses by nc 4 0 | cc-by-nc-4.0 | 36
creativecommons | creativecommons org licenses by nd 4 0 | cc-by-nd-4.0 | 36
creativecommons | creativecommons org licenses by 4 0 | cc-by-4.0 | 36
creativecommons | creativecommons org licenses by 3 0 | cc-by-3.0 | 36
creativecommons | creativecommons org licenses by 2 0 | cc-by-2.0 | 36
creativecommons | creativecommons org publicdomain zero 1 0 | cc0-1.0 | 37
creativecommons | creativecommons org publicdomain mark 1 0 | cc-pdm-1.0 | 37
waived | has waived all copyright and related or neighboring rights | cc0-1.0 | 45
possible under law | to the extent possible under law .{1,60}? has waived all copyright | cc0-1.0 | 46
commons | this work is licensed under a creative commons | cc-any | 28
redistribute the material | you are free to share copy and redistribute the material in any medium or format | cc-any | 38
appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made | cc-any | 38
remix | if you remix transform or build upon the material you must distribute your contributions under the same license as the original | cc-by-sa-any | 42
the material for commercial | you may not use the material for commercial purposes | cc-by-nc-any | 42
remix | if you remix transform or build upon the material you may not distribute the modified material | cc-by-nd-any | 42
dual | dual licensed under (?:the )?(?:mit and gpl|gpl and mit)(?: licenses)? | mit-or-gpl | 44
either | licensed under either of apache license version 2 0 or mit license | apache-2.0-or-mit | 48
"""
#: Words that most rules hold; of the others the keyword itself tells whether a text may hold them.
GENERAL = ["licen", "software", "copyright", "permission", "public", "agree", "commons", "reserved", "redistribut", "warrant", "attribution", "purposes", "written"]


def _names() -> list[tuple[str, str, str]]:
    out = list(NAMES)
    for label, short, long in CC_ELEMENTS:
        for v in CC_VERSIONS:
            number = f" {v.replace('.', ' ')}" if v else ""
            full = f"cc-{label}-{v}" if v else f"cc-{label}-any"
            out.append((full, " cc ", f"cc {short}{number}"))
            out.append((full, "commons", f"creative commons {long}{number}"))
    return out


def _signatures() -> list[Rule]:
    out = []
    for line in SIGNATURES.strip().splitlines():
        keyword, pattern, label, priority = line.split(" | ")
        out.append(Rule(keyword, f"(?:{pattern})", label, int(priority), round(0.45 + int(priority) / 100, 2)))
    return out


def rules() -> list[Rule]:
    """Every name in every phrasing, then the signatures; the order breaks ties."""
    made = [Rule(k, p.format(name=f"(?:{name})"), label, priority, weight) for p, priority, weight in PHRASINGS for label, k, name in _names()]
    return made + _signatures()


def _holds(parsed, word: str) -> bool:
    """Whether every match of a parsed pattern surely contains a word."""
    run = ""
    for op, value in parsed:
        if op is _sre.LITERAL:
            run += chr(value)
            if word in run:
                return True
            continue
        run = ""
        if op is _sre.SUBPATTERN and _holds(value[3], word):
            return True
        if op is _sre.BRANCH and all(_holds(x, word) for x in value[1]):
            return True
        if op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and value[0] > 0 and _holds(value[2], word):
            return True
    return False


def gates() -> list[str]:
    """A text without any of these holds no rule's match."""
    out = list(GENERAL)
    for r in rules():
        parsed = _parser.parse(r.pattern)
        if any(g in f" {r.keyword} " or _holds(parsed, g.strip()) for g in GENERAL) or r.keyword in out or f" {r.keyword} " in out:
            continue
        # a name that stands alone is a word of its own, so that it is not found within others
        alone = f" {r.keyword} "
        out.append(alone if _holds(_parser.parse(f" (?:{r.pattern}) "), alone) else r.keyword)
    return out


def most_words() -> int:
    """The most words that a match can have."""
    return max(r.pattern.count(" ") + 2 + 45 * r.pattern.count("{") for r in rules())
