"""Signature rules of licenses, written by hand: ``label | priority | keyword | pattern``.

They see lower-case words joined by one space, so that "Version 2.0" reads "version 2 0". The
keyword is a string that every match holds. A higher priority is a surer sign.
"""

NAMES = r"""
apache-2.0|90|apache license|licensed under the apache license version 2 0
apache-2.0|95|apache license|apache license version 2 0(?: january 2004)?(?: http s? ?www apache org licenses)?
apache-2.0|95|apache org licenses license 2 0|(?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0|80|apache 2 0|\bapache 2 0 (?:license|licence)
apache-2.0|80|apache software license|apache software license(?: version)? 2 0
apache-2.0|75|apache|\b(?:license|licence) apache(?: license)? ?(?:v|version )?2(?: 0)?\b
apache-1.1|90|apache software license|apache software license(?: version)? 1 1
apache-1.0|90|apache|apache (?:software )?license(?: version)? 1 0
apache|40|apache license|\bapache license\b
apache|40|apache software license|\bapache software license\b
mit|90|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|85|the software is provided as is|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit|80|mit license|(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
mit|70|mit license|\b(?:the )?mit license\b
mit|70|mit licence|\b(?:the )?mit licence\b
mit|60|license mit|\blicense mit\b
mit|85|opensource org licenses mit|opensource org licenses mit(?: license)?
mit-0|92|mit no attribution|\bmit no attribution\b
expat|80|expat license|\bexpat license\b
x11|80|x11 license|\bx11 license\b
isc|90|permission to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|75|isc license|\b(?:the )?isc licen[sc]e\b
isc|75|isc licence|\bisc licence\b
0bsd|92|zero clause bsd|\bzero clause bsd\b
bsd|85|redistribution and use in source and binary forms|redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-3-clause|92|neither the name|neither the names? of .{0,120}? may be used to endorse or promote products
bsd-4-clause|92|all advertising materials|all advertising materials mentioning features or use of this software must display
bsd-3-clause|88|3 clause bsd|\b3 clause bsd(?: licen[sc]e)?
bsd-3-clause|88|bsd 3 clause|\bbsd 3 clause(?: licen[sc]e)?
bsd-3-clause|88|new bsd|\bnew bsd licen[sc]e
bsd-3-clause|88|modified bsd|\bmodified bsd licen[sc]e
bsd-3-clause|88|revised bsd|\brevised bsd licen[sc]e
bsd-3-clause|88|bsd style|\bbsd style licen[sc]e
bsd-2-clause|88|2 clause bsd|\b2 clause bsd(?: licen[sc]e)?
bsd-2-clause|88|bsd 2 clause|\bbsd 2 clause(?: licen[sc]e)?
bsd-2-clause|88|simplified bsd|\bsimplified bsd licen[sc]e
bsd-2-clause|88|freebsd license|\bfreebsd license
bsd-4-clause|88|4 clause bsd|\b4 clause bsd
bsd-4-clause|88|original bsd|\boriginal bsd licen[sc]e
bsd|60|bsd license|\bbsd license\b
bsd|60|bsd licence|\bbsd licence\b
gpl-2.0-or-later|95|general public license|general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later|95|general public license|general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2.0|90|general public license|\bgnu general public license(?: gpl)?(?: as published by the free software foundation)? version 2\b
gpl-3.0|90|general public license|\bgnu general public license(?: gpl)?(?: as published by the free software foundation)? version 3\b
gpl-1.0|90|general public license|\bgnu general public license version 1\b
gpl-2.0|80|gpl|\bgpl ?(?:v|version )? ?2(?: 0)?\b
gpl-3.0|80|gpl|\bgpl ?(?:v|version )? ?3(?: 0)?\b
gpl-2.0|85|gnu gpl|\bgnu gpl ?(?:v|version )? ?2(?: 0)?\b
gpl-3.0|85|gnu gpl|\bgnu gpl ?(?:v|version )? ?3(?: 0)?\b
gpl-2.0|90|gnu org licenses|gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0|90|gnu org licenses|gnu org licenses gpl 3 0
gpl|60|gnu general public licen|\bgnu general public licen[sc]e\b
gpl|55|gnu gpl|\bgnu gpl\b
gpl|50|general public licence|\bgeneral public licence\b
lgpl-2.1-or-later|95|lesser general public license|lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-2.1|92|lesser general public license|\b(?:gnu )?lesser general public license version 2 1\b
lgpl-3.0|92|lesser general public license|\b(?:gnu )?lesser general public license version 3\b
lgpl-2.0|92|library general public license|\b(?:gnu )?library general public license (?:version |v)?2\b
lgpl|70|library general public license|\b(?:gnu )?library general public license\b
lgpl|70|lesser general public licen|\b(?:gnu )?lesser general public licen[sc]e\b
lgpl-2.1|85|lgpl|\blgpl ?(?:v|version )? ?2 1\b
lgpl-3.0|85|lgpl|\blgpl ?(?:v|version )? ?3(?: 0)?\b
lgpl|55|lgpl|\b(?:gnu )?lgpl\b
agpl-3.0|92|affero general public license|\b(?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? version 3\b
agpl-1.0|92|affero general public license|\baffero general public license version 1\b
agpl|70|affero general public licen|\b(?:gnu )?affero general public licen[sc]e\b
agpl-3.0|85|agpl|\bagpl ?(?:v|version )? ?3(?: 0)?\b
agpl|55|agpl|\bagpl\b
gfdl-1.3|92|free documentation license|\bgnu free documentation license version 1 3\b
gfdl-1.2|92|free documentation license|\bgnu free documentation license version 1 2\b
gfdl-1.1|92|free documentation license|\bgnu free documentation license version 1 1\b
gfdl|70|free documentation licen|\b(?:gnu )?free documentation licen[sc]e\b
mpl-2.0|92|mozilla public license|\bmozilla public license v? ?(?:version )?2 0\b
mpl-1.1|92|mozilla public license|\bmozilla public license v? ?(?:version )?1 1\b
mpl-1.0|92|mozilla public license|\bmozilla public license v? ?(?:version )?1 0\b
mpl-2.0|92|mozilla org mpl|\bmozilla org mpl 2 0\b
mpl-2.0|80|mpl 2 0|\bmpl 2 0\b
mpl|65|mozilla public licen|\bmozilla public licen[sc]e\b
epl-2.0|92|eclipse public license|\beclipse public license v? ?(?:version )?2 0\b
epl-1.0|92|eclipse public license|\beclipse public license v? ?(?:version )?1 0\b
epl|65|eclipse public licen|\beclipse public licen[sc]e\b
edl-1.0|90|eclipse distribution license|\beclipse distribution license\b
cpl-1.0|90|common public license|\bcommon public license (?:version |v)?1 0\b
cpl|65|common public license|\bcommon public license\b
ipl-1.0|90|ibm public license|\bibm public license\b
cddl-1.1|92|common development and distribution license|\bcommon development and distribution license (?:version )?1 1\b
cddl-1.0|90|common development and distribution license|\bcommon development and distribution license (?:cddl )?(?:version |v)?1 0\b
cddl|65|common development and distribution license|\bcommon development and distribution license\b
cddl|60|cddl|\bcddl\b
cpal-1.0|90|common public attribution license|\bcommon public attribution license\b
artistic-2.0|92|artistic license|\bartistic license 2 0\b
artistic-1.0|92|artistic license|\bartistic license 1 0\b
artistic|65|artistic licen|\b(?:perl )?artistic licen[sc]e\b
perl|85|same terms as perl|\bunder the same terms as perl(?: itself)?\b
zlib|92|this software is provided as is|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|80|zlib license|\bzlib license\b
zlib|85|zlib libpng license|\bzlib libpng license\b
libpng|80|libpng license|\blibpng license\b
bsl-1.0|92|boost software license|\bboost software license (?:version |v)?1 0\b
bsl|65|boost software license|\bboost software license\b
bsl-1.0|85|boost org license|\bboost org license 1 0\b
unlicense|92|free and unencumbered software|this is free and unencumbered software released into the public domain
unlicense|80|the unlicense|\bthe unlicense\b
unlicense|85|unlicense org|\bunlicense org\b
wtfpl|90|do what the fuck you want to public license|\bdo what the fuck you want to public license\b
wtfpl|75|wtfpl|\bwtfpl\b
public-domain|70|public domain|\b(?:released|placed|dedicated|is) (?:in|into|to) the public domain\b
public-domain|50|public domain|\bpublic domain\b
cc0-1.0|92|cc0 1 0|\bcc0 1 0(?: universal)?\b
cc0-1.0|85|creative commons zero|\bcreative commons zero\b
cc0-1.0|90|creativecommons org publicdomain zero|\bcreativecommons org publicdomain zero 1 0\b
cc0-1.0|70|cc0|\bcc0\b
pddl-1.0|90|public domain dedication and license|\bpublic domain dedication and license\b
cc-by-4.0|90|attribution 4 0 international|\bcreative commons attribution 4 0 international\b
cc-by-sa-4.0|93|sharealike 4 0 international|\bcreative commons attribution sharealike 4 0 international\b
cc-by-nc-4.0|93|noncommercial 4 0 international|\bcreative commons attribution noncommercial 4 0 international\b
cc-by-nd-4.0|93|noderivatives 4 0 international|\bcreative commons attribution noderivatives 4 0 international\b
cc-by-nc-sa-4.0|94|noncommercial sharealike 4 0|\bcreative commons attribution noncommercial sharealike 4 0(?: international)?\b
cc-by-nc-nd-4.0|94|noncommercial noderivatives 4 0|\bcreative commons attribution noncommercial noderivatives 4 0(?: international)?\b
cc-by-3.0|90|attribution 3 0|\bcreative commons attribution 3 0(?: unported)?\b
cc-by-sa-3.0|93|creative commons attribution share|\bcreative commons attribution share ?alike 3 0(?: unported)?\b
cc-by-2.5|90|attribution 2 5|\bcreative commons attribution 2 5\b
cc-by-2.0|90|attribution 2 0|\bcreative commons attribution 2 0\b
cc-by-4.0|92|creativecommons org licenses by 4 0|\bcreativecommons org licenses by 4 0\b
cc-by-3.0|92|creativecommons org licenses by 3 0|\bcreativecommons org licenses by 3 0\b
cc-by-sa-4.0|92|creativecommons org licenses by sa 4 0|\bcreativecommons org licenses by sa 4 0\b
cc-by-sa-3.0|92|creativecommons org licenses by sa 3 0|\bcreativecommons org licenses by sa 3 0\b
cc-by-nc-4.0|92|creativecommons org licenses by nc 4 0|\bcreativecommons org licenses by nc 4 0\b
cc-by-nc-sa-4.0|93|creativecommons org licenses by nc sa 4 0|\bcreativecommons org licenses by nc sa 4 0\b
cc-by-nc-nd-4.0|93|creativecommons org licenses by nc nd 4 0|\bcreativecommons org licenses by nc nd 4 0\b
cc-by-nd-4.0|92|creativecommons org licenses by nd 4 0|\bcreativecommons org licenses by nd 4 0\b
cc-by-nc-nd|75|cc by nc nd|\bcc by nc nd\b
cc-by-nc-sa|75|cc by nc sa|\bcc by nc sa\b
cc-by-nc|72|cc by nc|\bcc by nc\b
cc-by-sa|72|cc by sa|\bcc by sa\b
cc-by-nd|72|cc by nd|\bcc by nd\b
cc-by-sa-4.0|78|cc by sa 4 0|\bcc by sa 4 0\b
cc-by-sa-3.0|78|cc by sa 3 0|\bcc by sa 3 0\b
cc-by-nc-4.0|78|cc by nc 4 0|\bcc by nc 4 0\b
cc-by-nd-4.0|78|cc by nd 4 0|\bcc by nd 4 0\b
cc-by-nc-sa-4.0|80|cc by nc sa 4 0|\bcc by nc sa 4 0\b
cc-by-nc-nd-4.0|80|cc by nc nd 4 0|\bcc by nc nd 4 0\b
cc-by-4.0|76|cc by 4 0|\bcc by 4 0\b
cc-by-3.0|76|cc by 3 0|\bcc by 3 0\b
cc-by-2.0|76|cc by 2 0|\bcc by 2 0\b
creative-commons|45|creative commons|\bcreative commons(?: attribution)?(?: licen[sc]e)?\b
odbl-1.0|90|open database license|\bopen database license\b
odc-by-1.0|90|open data commons attribution license|\bopen data commons attribution license\b
cdla-permissive-1.0|90|community data license agreement permissive|\bcommunity data license agreement permissive version 1 0\b
cdla-permissive|70|community data license agreement permissive|\bcommunity data license agreement permissive\b
cdla-permissive-2.0|93|community data license agreement permissive|\bcommunity data license agreement permissive version 2 0\b
cdla-sharing-1.0|90|community data license agreement sharing|\bcommunity data license agreement sharing\b
ogl-3.0|88|open government licen|\bopen government licen[sc]e v?(?:ersion )?3 0\b
ogl|75|open government licen|\bopen government licen[sc]e\b
ofl-1.1|92|sil open font license|\bsil open font license (?:version |v)?1 1\b
ofl|70|sil open font license|\bsil open font license\b
ofl-1.1|80|open font license|\bopen font license (?:version |v)?1 1\b
ofl|65|open font license|\bopen font license\b
ufl-1.0|90|ubuntu font licen|\bubuntu font licen[sc]e\b
eupl-1.2|92|european union public licen|\beuropean union public licen[sc]e (?:v|version )? ?1 2\b
eupl-1.1|92|european union public licen|\beuropean union public licen[sc]e (?:v|version )? ?1 1\b
eupl|70|european union public licen|\beuropean union public licen[sc]e\b
cecill-2.1|92|cecill|\bcecill(?: free software)?(?: license)?(?: agreement)?(?: version)? 2 1\b
cecill-b|90|cecill b|\bcecill b\b
cecill-c|90|cecill c|\bcecill c\b
cecill|65|cecill|\bcecill\b
ms-pl|90|microsoft public license|\bmicrosoft public license\b
ms-rl|90|microsoft reciprocal license|\bmicrosoft reciprocal license\b
nasa-1.3|90|nasa open source agreement|\bnasa open source agreement (?:version |v)?1 3\b
nasa|70|nasa open source agreement|\bnasa open source agreement\b
ncsa|90|university of illinois ncsa|\buniversity of illinois ncsa open source license\b
osl-3.0|90|open software license|\bopen software license(?: v| version)? ?3 0\b
osl|65|open software license|\bopen software license\b
afl-3.0|90|academic free license|\bacademic free license(?: v| version)? ?3 0\b
afl|65|academic free license|\bacademic free license\b
ecl-2.0|90|educational community license|\beducational community license (?:version |v)?2 0\b
ecl|65|educational community license|\beducational community license\b
python-2.0|90|python software foundation license|\bpython software foundation license (?:version |v)?2\b
psf|70|python software foundation license|\bpython software foundation license\b
psf|70|psf license|\bpsf license\b
php-3.01|90|php license|\bphp license(?: version)? 3 01\b
php|65|php license|\bphp license\b
ruby|70|ruby license|\bruby license\b
ruby|80|same terms as ruby|\bsame terms as ruby\b
postgresql|85|postgresql licen|\bpostgresql licen[sc]e\b
openssl|80|openssl license|\bopenssl license\b
ssleay|80|ssleay license|\bssleay license\b
ijg|85|independent jpeg group|\bwork of the independent jpeg group\b
curl|70|curl license|\bcurl license\b
unicode-dfs|85|license agreement|\bunicode(?: inc)? license agreement\b
w3c|80|w3c software|\bw3c software (?:notice|and document notice) and license\b
vim|80|vim license|\bvim license\b
tcl|70|tcl tk license|\btcl tk license\b
ntp|70|ntp license|\bntp license\b
hpnd|80|historical permission notice|\bhistorical permission notice and disclaimer\b
qpl-1.0|85|q public license|\bq public license (?:version |v)?1 0\b
qpl|65|q public license|\bq public license\b
sleepycat|85|sleepycat license|\bsleepycat license\b
intel|70|intel open source license|\bintel open source license\b
apsl-2.0|90|apple public source license|\bapple public source license (?:version |v)?2 0\b
apsl|65|apple public source license|\bapple public source license\b
nokia|80|nokia open source license|\bnokia open source license\b
sissl|80|sun industry standards source license|\bsun industry standards source license\b
spl-1.0|80|sun public license|\bsun public license\b
upl-1.0|90|universal permissive license|\buniversal permissive license\b
mulanpsl-2.0|90|mulan psl|\bmulan psl(?: v| version)? ?2\b
mulanpsl-1.0|90|mulan psl|\bmulan psl(?: v| version)? ?1\b
blueoak-1.0.0|90|blue oak model license|\bblue oak model license\b
sspl-1.0|90|server side public license|\bserver side public license\b
busl-1.1|90|business source license|\bbusiness source license (?:version |v)?1 1\b
busl|65|business source license|\bbusiness source license\b
elastic-2.0|90|elastic license|\belastic license (?:2 0|v2)\b
elastic|65|elastic license|\belastic license\b
commons-clause|85|commons clause|\bcommons clause(?: license)?(?: condition)?\b
polyform|85|polyform|\bpolyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) license\b
confluent|85|confluent community license|\bconfluent community license\b
hippocratic|85|hippocratic license|\bhippocratic license\b
openrail|85|openrail|\b(?:creativeml |bigscience )?openrail(?: m)?(?: license)?\b
json|85|shall be used for good|the software shall be used for good not evil
beerware|85|beer ware license|\bthe beer ware license\b
fair|70|fair license|\bfair license\b
ecos|75|ecos license|\becos license\b
wxwindows|85|wxwindows library licen|\bwxwindows library licen[sc]e\b
latex-1.3|85|latex project public license|\blatex project public license\b
gfsl|60|general free software|\bgeneral free software licen[sc]e\b
proprietary|60|proprietary and confidential|\bproprietary and confidential\b
proprietary|65|unauthorized copying|\bunauthorized copying of this file via any medium is strictly prohibited\b
proprietary|55|no part of this|\bno part of this (?:publication|book|document|work) may be reproduced\b
reserved|50|all rights reserved|\bcopyright (?:c )?(?:[0-9]{4} )?.{0,80}?all rights reserved\b
reserved|50|tous droits|\btous droits réservés\b
reserved|50|alle rechte|\balle rechte vorbehalten\b
reserved|50|todos los derechos|\btodos los derechos reservados\b
see-license|30|see the license|\bsee the license(?: file)? for (?:the specific language|details)\b
see-license|30|see license|\bsee license(?: file)? (?:for|in)\b
"""

#: Identifiers after "SPDX-License-Identifier:".
SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0
CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0
CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0
CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1-only
GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND IJG IPL-1.0 ISC
JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-1.0 MulanPSL-2.0 NASA-1.3 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01
PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""
