"""Signatures of licences: one line each, ``label | keyword | pattern``, in order of priority.

Patterns are matched against whole words: lower case, every ASCII sign and blank a separator, so ``GPL-2.0`` reads
``gpl 2 0``. A space stands between words, ``\\S+`` for any word. The keyword is a word that every match holds.
"""

from __future__ import annotations

#: What a match of each section is worth.
WEIGHTS = {"text": 1.0, "notice": 0.9, "identifier": 0.85, "version": 0.75, "name": 0.6, "mention": 0.3}

SIGNATURES = r"""
[text]
mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
mit-style-disclaimer | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
x11 | advertising | except as contained in this notice the name(?: \S+){1,8} shall not be used in advertising or otherwise to promote the sale use or other dealings
isc | granted | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
ntp | fee | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? with(?: or without)? fee is hereby granted
hpnd | documentation | permission to use copy modify and distribute this software and its documentation for any purpose(?: \S+){0,4} is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-source-clause | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-binary-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse | (?:neither )?the names?(?: \S+){1,14} may(?: not)? be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
apache-1.1 | acknowledgment | the end user documentation included with the redistribution if any must include the following acknowledgment
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | patent | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license
apache-2.0 | derivative | you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0 | freedom | by contrast the gnu general public license is intended to guarantee your freedom to share and change free software
gpl-3.0 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 | freedom | the gnu general public license is intended to guarantee your freedom to share and change all versions of a program
gpl-3.0 | covered | you may convey covered works to others for the sole purpose of having them make modifications exclusively for you
agpl-3.0 | network | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3.0 | affero | the gnu affero general public license is a free copyleft license for software and other kinds of works
lgpl-2.1 | lesser | this license the lesser general public license applies to some specially designated software packages
lgpl-3.0 | lesser | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
gfdl | document | the purpose of this license is to make a manual textbook or other functional and useful document free
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | source | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1.0 | agreement | the accompanying program is provided under the terms of this eclipse public license agreement
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0
cddl-1.0 | development | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | common | the accompanying program is provided under the terms of this common public license agreement
zlib | origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | want | you just do what the fuck you want to
cc0-1.0 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc-by | credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | transform | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | transform | if you remix transform or build upon the material you may not distribute the modified material
cc-by-nc | primarily | in any manner that is primarily intended for or directed toward commercial advantage or private monetary compensation
boost-1.0 | accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic-2.0 | package | the intent is that the copyright holder maintains some artistic control over the development of that package
artistic-1.0 | package | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | font | the fonts? (?:and derivatives )?(?:is|are)(?: \S+){0,4} licensed under the sil open font license
ofl-1.1 | font | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
python-2.0 | python | psf is making python available to licensee on an as is basis
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ms-pl | accompanying | this license governs use of the accompanying software if you use the software you accept this license
odbl-1.0 | database | the licensor is not liable for any use of the database
bsl-1.1 | production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
openrail | violates | you agree not to use the model or derivatives of the model in any way that violates
all-rights-reserved | reproduced | no part of this (?:publication|book|work|document) may be reproduced(?: \S+){0,12} without(?: the)? prior(?: written)? permission
proprietary | information | this (?:document|file|software) (?:is|contains)(?: \S+){0,3} (?:confidential|proprietary)(?: and (?:confidential|proprietary))? information
[notice]
apache-2.0 | apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | apache | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache license(?: version 2| v 2| v2| 2)(?: 0)?
apache-2.0 | asf | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | limitations | see the license for the specific language governing permissions and limitations under the license
gpl-2.0-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
gpl-3.0-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl-2.0-only | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license version 2
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl-2.1-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version
lgpl-3.0-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl-3.0-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-3.0 | gnu | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license(?: version 3| v 3| v3| 3)(?: 0)?
gpl-2.0 | gnu | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license(?: version 2| v 2| v2| 2)(?: 0)?
gpl | gnu | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license
gpl-3.0 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl(?: version 3| v 3| v3| 3)(?: 0)?
gpl-2.0 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl(?: version 2| v 2| v2| 2)(?: 0)?
gpl | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl
gnu-notice | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:affero |lesser |library )?general public license for more details
gnu-notice | received | you should have received a copy of the gnu (?:affero |lesser |library )?general public license along with this (?:program|library|file|package)
gfdl-1.3 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mit | mit | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit(?: expat| x11)? licen[cs]e
mit | mit | subject to (?:the )?(?:terms of the )?mit licen[cs]e
mit | mit | this (?:source code|software|project|file|code) is licensed under the mit licen[cs]e(?: found in the license file)?
bsd-3-clause | bsd | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
bsd-2-clause | bsd | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e
bsd | bsd | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:a )?bsd(?: style| type)? licen[cs]e
bsd | bsd | use of this source code is governed by a bsd style license that can be found in the license file
mpl-2.0 | mozilla | (?:licensed|released|distributed|available|subject) (?:under|to) (?:the )?(?:terms of the )?mozilla public license(?: version 2| v 2| v2| 2)(?: 0)?
mpl | mozilla | (?:licensed|released|distributed|available|subject) (?:under|to) (?:the )?(?:terms of the )?mozilla public license
epl | eclipse | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?eclipse public license
cddl | cddl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?cddl
isc | isc | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?isc licen[cs]e
zlib | zlib | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?zlib(?: libpng)? licen[cs]e
boost-1.0 | boost | distributed under the boost software license version 1 0
artistic | artistic | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:perl )?artistic licen[cs]e
perl | perl | you can redistribute it and or modify it under the same terms as perl(?: itself)?
unlicense | unlicense | (?:licensed|released|distributed|available) (?:under|into|with) (?:the )?unlicense
wtfpl | wtfpl | (?:licensed|released|distributed|available) under (?:the )?wtfpl
ofl-1.1 | font | (?:licensed|released|distributed|available) under (?:the )?(?:sil )?open font licen[cs]e
cc-by-nc-sa | creative | (?:licensed|released|distributed|available|published) under (?:a|the) creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | derivs | (?:licensed|released|distributed|available|published) under (?:a|the) creative commons attribution non ?commercial no derivs
cc-by-nc | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc(?: [1234] [05])?
cc-by-sa | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by sa(?: [1234] [05])?
cc-by-nd | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nd(?: [1234] [05])?
cc-by-nc-sa | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc nd(?: [1234] [05])?
cc-by | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by(?: [1234] [05])?
cc-by-sa | creative | (?:licensed|released|distributed|available|published) under (?:a|the) creative commons attribution share ?alike
cc-by | creative | (?:licensed|released|distributed|available|published) under (?:a|the) creative commons attribution
cc | creative | (?:licensed|released|distributed|available|published) under (?:a|the) creative commons licen[cs]e
cc0-1.0 | cc0 | (?:licensed|released|distributed|available|published|dedicated) (?:under|to|with) (?:the )?(?:creative commons )?cc0
cc0-1.0 | law | to the extent possible under law(?: \S+){1,8} (?:has|have) waived all copyright and related or neighbou?ring rights
public-domain | domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | domain | this (?:work|file|code|software|document) is (?:in|part of) the public domain
odbl-1.0 | odbl | (?:licensed|released|distributed|available) under (?:the )?odbl
odbl-1.0 | database | (?:licensed|released|distributed|available) under (?:the )?open database licen[cs]e
openrail | openrail | (?:licensed|released|distributed|available) under (?:the )?(?:creativeml |bigscience |bigcode )?openrail(?: m)?
llama | llama | (?:licensed|released|distributed|available) under (?:the )?llama \S+ community licen[cs]e
eupl-1.2 | eupl | licensed under the eupl(?: version 1 2| v 1 2| v1 2| 1 2)
eupl | eupl | licensed under the eupl
bsl-1.1 | business | use of this software is governed by the business source license
elastic-2.0 | elastic | licensed under the elastic license(?: version)? 2 0
sspl-1.0 | sspl | (?:licensed|released|distributed|available) under (?:the )?sspl
sspl-1.0 | server | (?:licensed|released|distributed|available) under (?:the )?server side public licen[cs]e
all-rights-reserved | reserved | copyright(?: c)? (?:19|20)\S+(?: \S+){0,6} all rights reserved
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \S+){0,8} (?:is )?(?:strictly )?prohibited
[identifier]
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit
isc | spdx | spdx license identifier isc
0bsd | spdx | spdx license identifier 0bsd
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
gfdl-1.3 | spdx | spdx license identifier gfdl 1 3(?: only| or later)?
mpl-2.0 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
zlib | spdx | spdx license identifier zlib
boost-1.0 | spdx | spdx license identifier bsl 1 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
artistic-2.0 | spdx | spdx license identifier artistic 2 0
ofl-1.1 | spdx | spdx license identifier ofl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-3.0 | spdx | spdx license identifier cc by 3 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | spdx | spdx license identifier cc by nc nd 4 0
spdx-reference | spdx | spdx license identifier \S+
apache-2.0 | apache | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
gpl | gnu | (?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: \S+)?
lgpl | gnu | (?:https? )?(?:www )?gnu org (?:licenses|copyleft) lgpl(?: \S+)?
agpl | gnu | (?:https? )?(?:www )?gnu org licenses agpl(?: \S+)?
gfdl | gnu | (?:https? )?(?:www )?gnu org (?:licenses|copyleft) fdl(?: \S+)?
mit | opensource | (?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php)?
bsd | opensource | (?:https? )?(?:www )?opensource org licenses? bsd(?: \S+)?
isc | opensource | (?:https? )?(?:www )?opensource org licenses? isc
mpl-2.0 | mozilla | (?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0
epl | eclipse | (?:https? )?(?:www )?eclipse org (?:legal|org documents) epl \S+
boost-1.0 | boost | (?:https? )?(?:www )?boost org license 1 0 txt
unlicense | unlicense | (?:https? )?(?:www )?unlicense org
wtfpl | wtfpl | (?:https? )?(?:www )?wtfpl net
ofl-1.1 | sil | (?:https? )?scripts sil org ofl
cc0-1.0 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
public-domain | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
cc-by-nc-sa | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc-nd | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc nd(?: [1234] [05])?
cc-by-nc | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc(?: [1234] [05])?
cc-by-sa | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by sa(?: [1234] [05])?
cc-by-nd | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nd(?: [1234] [05])?
cc-by | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by(?: [1234] [05])?
odbl-1.0 | opendatacommons | (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?
[version]
apache-2.0 | apache | apache(?: software)? licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)?
apache-2.0 | apache | apache 2 0(?: licen[cs]e)?
apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version 1 1| v 1 1| v1 1| 1 1)
gpl-3.0-or-later | gnu | gnu general public licen[cs]e(?: version 3| v 3| v3| 3)(?: 0)? or(?: any)? later
gpl-3.0 | gnu | gnu general public licen[cs]e(?: version 3| v 3| v3| 3)(?: 0)?
gpl-3.0 | gnu | gnu general public licen[cs]e v3
gpl-2.0-or-later | gnu | gnu general public licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)? or(?: any)? later
gpl-2.0 | gnu | gnu general public licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)?
gpl-2.0 | gnu | gnu general public licen[cs]e v2
gpl-3.0-or-later | gpl | (?:gnu )?gpl(?: version 3| v 3| v3| 3)(?: 0)? or later
gpl-3.0 | gpl | (?:gnu )?gpl(?: version 3| v 3| v3| 3)(?: 0)?(?: only)?
gpl-2.0-or-later | gpl | (?:gnu )?gpl(?: version 2| v 2| v2| 2)(?: 0)? or later
gpl-2.0 | gpl | (?:gnu )?gpl(?: version 2| v 2| v2| 2)(?: 0)?(?: only)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | gplv2 | (?:gnu )?gplv2
lgpl-3.0 | lesser | gnu lesser general public licen[cs]e(?: version 3| v 3| v3| 3)(?: 0)?
lgpl-2.1 | lesser | gnu lesser general public licen[cs]e(?: version 2 1| v 2 1| v2 1| 2 1)
lgpl-2.0 | library | gnu library general public licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)?
lgpl-3.0 | lgpl | (?:gnu )?lgpl(?: version 3| v 3| v3| 3)(?: 0)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version 2 1| v 2 1| v2 1| 2 1)
agpl-3.0 | affero | gnu affero general public licen[cs]e(?: version 3| v 3| v3| 3)(?: 0)?
agpl-3.0 | agpl | (?:gnu )?agpl(?: version 3| v 3| v3| 3)(?: 0)?
gfdl-1.3 | documentation | gnu free documentation licen[cs]e(?: version 1 3| v 1 3| v1 3| 1 3)
gfdl-1.2 | documentation | gnu free documentation licen[cs]e(?: version 1 2| v 1 2| v1 2| 1 2)
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version 1 1| v 1 1| v1 1| 1 1)
mpl-2.0 | mpl | mpl(?: version 2 0| v 2 0| v2 0| 2 0)
epl-2.0 | eclipse | eclipse public licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e(?: version 1| v 1| v1| 1)(?: 0)?
cddl-1.1 | cddl | cddl(?: version 1 1| v 1 1| v1 1| 1 1)
cddl-1.0 | cddl | cddl(?: version 1 0| v 1 0| v1 0| 1 0)
boost-1.0 | boost | boost software licen[cs]e(?: version 1 0| v 1 0| v1 0| 1 0)
artistic-2.0 | artistic | artistic licen[cs]e(?: version 2| v 2| v2| 2)(?: 0)?
ofl-1.1 | font | (?:sil )?open font licen[cs]e(?: version 1 1| v 1 1| v1 1| 1 1)
eupl-1.2 | european | european union public licen[cs]e(?: version 1 2| v 1 2| v1 2| 1 2)
bsd-4-clause | bsd | (?:original|4 clause) bsd(?: licen[cs]e)?
bsd-4-clause | bsd | bsd 4 clause(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-2-clause | bsd | (?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc0-1.0 | cc0 | (?:creative commons )?(?:zero )?cc0 1 0(?: universal)?
cc-by-sa-4.0 | creative | creative commons attribution share ?alike 4 0(?: international)?
cc-by-nc-4.0 | creative | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-4.0 | creative | creative commons attribution 4 0(?: international)?
cc-by-3.0 | creative | creative commons attribution 3 0(?: unported)?
odbl-1.0 | database | open database licen[cs]e(?: version 1 0| v 1 0| v1 0| 1 0)
[name]
apache | apache | apache(?: software)? licen[cs]e
gpl | gnu | gnu general public licen[cs]e
gpl | gnu | gnu gpl
lgpl | lesser | gnu lesser general public licen[cs]e
lgpl | library | gnu library general public licen[cs]e
agpl | affero | (?:gnu )?affero general public licen[cs]e
gfdl | documentation | gnu free documentation licen[cs]e
mit | mit | (?:the )?mit(?: expat| x11)? licen[cs]e
mit | expat | expat licen[cs]e
bsd | bsd | bsd(?: style)? licen[cs]es?
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cddl | development | common development and distribution licen[cs]e
cpl | common | common public licen[cs]e
ibm-pl | ibm | ibm public licen[cs]e
isc | isc | isc licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
boost | boost | boost software licen[cs]e
artistic | artistic | artistic licen[cs]e
python | python | python software foundation licen[cs]e
php | php | php licen[cs]e
ruby | ruby | ruby licen[cs]e
openssl | openssl | openssl licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
eupl | european | european union public licen[cs]e
ofl | font | (?:sil )?open font licen[cs]e
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc | cc | cc by nc
cc-by-sa | cc | cc by sa
cc-by-nd | cc | cc by nd
cc-by | cc | cc by
cc0 | cc0 | cc0
cc-by-sa | creative | creative commons attribution share ?alike
cc-by-nc | creative | creative commons attribution non ?commercial
cc-by | creative | creative commons attribution
cc | creative | creative commons(?: licen[cs]e)?
odbl | database | open database licen[cs]e
bsl | business | business source licen[cs]e
sspl | server | server side public licen[cs]e
elastic | elastic | elastic licen[cs]e
openrail | openrail | openrail(?: m)?
[mention]
copyleft | copyleft | copyleft
public-domain | domain | public domain
all-rights-reserved | reserved | all rights reserved
permissive | permissive | permissive(?: open source| free software)? licen[cs]e
open-source | source | open source licen[cs]e
free-software | software | free software licen[cs]e
license-file | file | see(?: the)? licen[cs]e file(?: for details)?
license-reference | under | (?:licensed|released) under(?: the| a)?(?: \S+){1,4}? licen[cs]e
terms-of-use | terms | subject to (?:the|these|our) terms (?:of use|of service|and conditions)
copyright | copyright | copyright(?: c)? (?:19|20)\S+
"""

#: Phrases whose every place is reported, and their labels (fixed values).
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def parse_signatures(text: str = SIGNATURES) -> list[dict]:
    """Rules as rows: ``rank`` (place in the table), ``section``, ``weight``, ``label``, ``keyword`` and ``pattern``.

    The pattern is laid out for words that have a space of their own on either side.
    """
    rules, section = [], ""
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("["):
            section = line.strip("[]")
            continue
        label, keyword, pattern = (part.strip() for part in line.split(" | "))
        rules.append({"rank": len(rules), "section": section, "weight": WEIGHTS[section], "label": label, "keyword": keyword,
                      "pattern": " (?:" + pattern.replace(" ?", "(?: )?").replace(" ", "  ") + ") "})
    return rules
