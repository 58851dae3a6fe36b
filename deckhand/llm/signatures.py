"""Hand-written signatures of licences: titles, notices in files, grants, conditions and disclaimers.

A line has a label, a strength and a pattern over lower-case words with single spaces. Strengths: ``t``
a title or a notice that names the licence, ``g`` a grant, ``c`` a condition, ``d`` a disclaimer, which
several licences may share. Longer detections win over those they cover, so that a notice's own words beat
a bare name in it.
"""

from __future__ import annotations

import re

#: Strength: priority (less is stronger) and confidence.
STRENGTHS = {"t": (4, 1.0), "g": (6, 0.95), "c": (8, 0.9), "d": (16, 0.7)}

TABLE = """
mit t the mit licen[cs]e mit copyright
mit t licensed under the mit licen[cs]e see licen[cs]e (?:file )?in the project root
mit t use of this source code is governed by an mit style licen[cs]e
mit t this project is licensed under the (?:terms of the )?mit licen[cs]e
mit g permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit g to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies
mit c the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit c and to permit persons to whom the software is furnished to do so subject to the following conditions
mit d in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit d the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit d whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit-0 t mit no attribution licen[cs]e
mit-advertising c except as contained in this notice the name of the above copyright holders shall not be used in advertising
x11 c except as contained in this notice the name of the x consortium shall not be used in advertising
x11 t x window system is a trademark of (?:x consortium inc|the open group)
isc g permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc c provided that the above copyright notice and this permission notice appear in all copies
isc d the software is provided as is and the author disclaims all warranties with regard to this software
isc d in no event shall the author be liable for any special direct indirect or consequential damages
0bsd t bsd zero clause licen[cs]e
0bsd t zero clause bsd
bsd t use of this source code is governed by a bsd style licen[cs]e that can be found in the licen[cs]e file
bsd g redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd c redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd c redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd d this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd d this software is provided by the regents and contributors as is and any express or implied warranties
bsd d in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
bsd-2-clause t bsd 2 clause licen[cs]e
bsd-2-clause t the views and conclusions contained in the software and documentation are those of the authors
bsd-3-clause t bsd 3 clause licen[cs]e
bsd-3-clause c nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause c the name of the author may not be used to endorse or promote products derived from this software
bsd-3-clause-clear c no express or implied licenses to any party s patent rights are granted by this licen[cs]e
bsd-4-clause c all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause c this product includes software developed by the university of california berkeley and its contributors
bsd-patent t bsd 2 clause plus patent licen[cs]e
apache t licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache t you may obtain a copy of the licen[cs]e at (?:http|https) www apache org licenses licen[cs]e 2 0
apache t licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements
apache t see the notice file distributed with this work for additional information regarding copyright ownership
apache t apache licen[cs]e version 2 0 january 2004
apache c unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache c see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
apache c licen[cs]e shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9
apache g each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
apache c you must cause any modified files to carry prominent notices stating that you changed the files
apache c if the work includes a notice text file as part of its distribution
apache-1.0 c this product includes software developed by the apache group for use in the apache http server project
apache-1.1 c this product includes software developed by the apache software foundation
apache-1.1 c products derived from this software may not be called apache nor may apache appear in their name
gpl t this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl t gnu general public licen[cs]e version [123]
gpl t everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gpl t you should have received a copy of the gnu general public licen[cs]e along with
gpl c this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e
gpl c the licenses for most software are designed to take away your freedom to share and change it
gpl c the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl c you must give any other recipients of the work a copy of this licen[cs]e
gpl c this general public licen[cs]e does not permit incorporating your program into proprietary programs
gpl c if the program does not specify a version number of the gnu general public licen[cs]e you may choose any version ever published
gpl c activities other than copying distribution and modification are not covered by this licen[cs]e
gpl-2.0 t gnu general public licen[cs]e version 2 june 1991
gpl-2.0 t either version 2 of the licen[cs]e or at your option any later version
gpl-2.0 t free software foundation inc 5[19] (?:franklin street|temple place)
gpl-3.0 t gnu general public licen[cs]e version 3 29 june 2007
gpl-3.0 t either version 3 of the licen[cs]e or at your option any later version
gpl-3.0 c to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement
gpl-3.0 c no covered work shall be deemed part of an effective technological measure
gpl-exception t linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-classpath t as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-gcc t gcc runtime library exception version 3 1
gpl-font t this exception does not however invalidate any other reasons why the executable file might be covered by the gnu general public licen[cs]e
lgpl t this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl t you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)
lgpl t gnu lesser general public licen[cs]e version [23]
lgpl c this licen[cs]e the lesser general public licen[cs]e applies to some specially designated software packages
lgpl c a work that uses the library that is an original or derived work
lgpl c this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e
agpl t it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
agpl t you should have received a copy of the gnu affero general public licen[cs]e along with
agpl t gnu affero general public licen[cs]e version 3 19 november 2007
agpl c if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl c the gnu affero general public licen[cs]e is designed specifically to ensure that
gfdl t permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl c with no invariant sections no front cover texts and no back cover texts
gfdl t gnu free documentation licen[cs]e version 1 [123]
gfdl c a secondary section is a named appendix or a front matter section of the document
mpl t this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl t if a copy of the mpl was not distributed with this file you can obtain one at
mpl t the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]
mpl t mozilla public licen[cs]e version (?:1 0|1 1|2 0)
mpl c software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[cs]e for the specific language governing rights and limitations
mpl c this source code form is incompatible with secondary licenses as defined by the mozilla public licen[cs]e
mpl g each contributor hereby grants you a world wide royalty free non exclusive licen[cs]e
npl t netscape public licen[cs]e version 1 [01]
epl t this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
epl t eclipse public licen[cs]e v (?:1 0|2 0)
epl c the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement
epl c any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
edl t eclipse distribution licen[cs]e v 1 0
cpl t the accompanying program is provided under the terms of this common public licen[cs]e agreement
cpl t common public licen[cs]e (?:version |v )?1 0
ipl t the accompanying program is provided under the terms of this ibm public licen[cs]e agreement
cddl t the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl t common development and distribution licen[cs]e cddl version 1 [01]
cddl t you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e
cddl c when distributing covered code include this cddl header in each file
eupl t licensed under the eupl version 1 [12]
eupl t european union public licen[cs]e v 1 [12]
eupl c this european union public licen[cs]e the eupl applies to the work or software
eupl c the licensor hereby grants you a world wide royalty free non exclusive sub licensable licen[cs]e
cecill t this software is governed by the cecill (?:b |c )?licen[cs]e under french law and abiding by the rules of distribution of free software
cecill t cecill free software licen[cs]e agreement
artistic t the artistic licen[cs]e preamble
artistic t artistic licen[cs]e 2 0 copyright c 2000 2006 the perl foundation
artistic c the intent of this document is to state the conditions under which a package may be copied
artistic c you may charge a reasonable copying fee for any distribution of this package
perl t this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself
zlib c altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib c the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib g permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib d this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
libpng t this copy of the libpng notices is provided for your convenience
ijg t this software is based in part on the work of the independent jpeg group
ijg c the authors make no warranty or representation either express or implied with respect to this software its quality accuracy
boost t distributed under the boost software licen[cs]e version 1 0
boost g permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
boost c unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
ncsa t university of illinois ncsa open source licen[cs]e
ncsa c neither the names of the contributors nor the names of their institutions may be used to endorse
ncsa g to deal with the software without restriction including without limitation the rights to use copy modify merge
llvm t part of the llvm project under the apache licen[cs]e v2 0 with llvm exceptions
ofl t this font software is licensed under the sil open font licen[cs]e version 1 1
ofl t sil open font licen[cs]e version 1 1 26 february 2007
ofl c neither the font software nor any of its individual components in original or modified versions may be sold by itself
ofl c no modified version of the font software may use the reserved font name
odbl t open data commons open database licen[cs]e
odbl t this data(?:base)? is made available under the open database licen[cs]e
odc-by t open data commons attribution licen[cs]e
pddl t open data commons public domain dedication and licen[cs]e
python t python software foundation licen[cs]e version 2
python t this licen[cs]e agreement is between the python software foundation psf and the individual or organization licensee
python g psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e to reproduce analyze test perform
python t cnri open source licen[cs]e agreement
python t beopen python open source licen[cs]e agreement version 1
php t this source file is subject to version (?:2 02|3 0|3 01) of the php licen[cs]e
php c products derived from this software may not be called php nor may php appear in their name without prior written permission
php c this product includes php software freely available from
ruby t ruby is copyrighted free software by yukihiro matsumoto
ruby t you can redistribute it and or modify it under either the terms of the 2 clause bsdl
openssl c this product includes software developed by the openssl project for use in the openssl toolkit
openssl c the names openssl toolkit and openssl project must not be used to endorse or promote products
ssleay c this product includes cryptographic software written by eric young
postgresql g permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql d in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
unicode t unicode inc licen[cs]e agreement data files and software
unicode g permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c t w3c software notice and licen[cs]e
w3c g by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms
w3c t w3c document licen[cs]e
curl g permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
hpnd g permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
hpnd c and that both that copyright notice and this permission notice appear in supporting documentation
ntp g permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
tcl t this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation
tcl c the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation for any purpose
sleepycat c redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
sleepycat t the sleepycat licen[cs]e copyright
qpl t this file may be distributed under the terms of the q public licen[cs]e
qpl c the intent of this licen[cs]e is to establish freedom to share and change the software regulated by this licen[cs]e under the open source model
lppl t this work may be distributed and or modified under the conditions of the latex project public licen[cs]e
lppl t the latest version of this licen[cs]e is in http www latex project org lppl txt
lppl c this work has the lppl maintenance status
vim t vim is charityware you can use and copy it as much as you like
ms-pl t microsoft public licen[cs]e ms pl
ms-pl c if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent licen[cs]e
ms-rl t microsoft reciprocal licen[cs]e ms rl
osl t licensed under the open software licen[cs]e version (?:2 0|2 1|3 0)
osl c this open software licen[cs]e the licen[cs]e applies to any original work of authorship
afl t licensed under the academic free licen[cs]e version (?:1 2|2 0|2 1|3 0)
afl c this academic free licen[cs]e the licen[cs]e applies to any original work of authorship
apsl t this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[cs]e
apsl t apple public source licen[cs]e ver(?:sion)? [12]
rpl t reciprocal public licen[cs]e 1 [135]
cpal t common public attribution licen[cs]e version 1 0
sissl t sun industry standards source licen[cs]e
spl t sun public licen[cs]e version 1 0
upl t universal permissive licen[cs]e v 1 0
upl g to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights
mulan t you can use this software according to the terms and conditions of the mulan psl v[12]
unlicense t this is free and unencumbered software released into the public domain
unlicense g anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense c in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
unlicense c we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
cc0 t to the extent possible under law the (?:author|authors|person) (?:has|have|who) (?:dedicated|waived|associated) all copyright
cc0 t cc0 1 0 universal public domain dedication
cc0 t statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights
cc0 c affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
cc-by t this work is licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by t licensed under cc by [1-4] [05]
cc-by c creative commons corporation is not a law firm and does not provide legal services
cc-by-sa t this work is licensed under a creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by-sa t text is available under the creative commons attribution share ?alike licen[cs]e
cc-by-sa t licensed under cc by sa [1-4] [05]
cc-by-nc t this work is licensed under a creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by-nd t this work is licensed under a creative commons attribution no ?derivatives [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by-nc-sa t this work is licensed under a creative commons attribution non ?commercial share ?alike [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by-nc-nd t this work is licensed under a creative commons attribution non ?commercial no ?derivatives [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by c you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc-by-nc c you may not use the material for commercial purposes
cc-by-sa c if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
public-domain t this (?:file|code|work|software|program|data) (?:is|has been) (?:released|placed|put) (?:into|in) the public domain
public-domain t this is a work of the united states government and is not subject to copyright protection
public-domain t this work is free of known copyright restrictions
wtfpl t do what the fuck you want to public licen[cs]e version 2 december 2004
wtfpl c terms and conditions for copying distribution and modification 0 you just do what the fuck you want to
beerware t the beer ware licen[cs]e revision 42
beerware c if we meet some day and you think this stuff is worth it you can buy me a beer in return
json c the software shall be used for good not evil
sspl t server side public licen[cs]e version 1 october 16 2018
sspl c if you make the functionality of the program or a modified version available to third parties as a service
busl t business source licen[cs]e 1 1 parameters
busl t use of this software is governed by the business source licen[cs]e
busl c the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic t one or more contributor licen[cs]e agreements licensed under the elastic licen[cs]e
elastic c you may not provide the software to third parties as a hosted or managed service
commons-clause t commons clause licen[cs]e condition v1 0
commons-clause c the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software
polyform t polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e 1 0 0
polyform t required notice copyright
confluent t confluent community licen[cs]e (?:agreement )?version 1 0
timescale t timescale licen[cs]e agreement
redis t redis source available licen[cs]e
llama t llama (?:2|3|3 1|3 2|4) community licen[cs]e agreement
llama c if the monthly active users of the products or services made available by or for licensee
openrail t (?:bigscience|creativeml|bigcode) open ?rail (?:m )?licen[cs]e
openrail c you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law
gemma t gemma is provided under and subject to the gemma terms of use
proprietary t this software is the confidential and proprietary information of
proprietary t unauthorized copying of this file via any medium is strictly prohibited
proprietary t no part of this (?:publication|document|software) may be reproduced distributed or transmitted in any form or by any means without the prior written permission
proprietary c you may not reverse engineer decompile or disassemble the software
proprietary t this software is licensed not sold
eula t end user licen[cs]e agreement
eula c by installing copying or otherwise using the software you agree to be bound by the terms of this agreement
dfsg t on debian systems the complete text of the gnu general public licen[cs]e can be found in usr share common licenses
dual t dual licensed under the mit (?:licen[cs]e )?and (?:the )?apache licen[cs]e
dual t at your option under (?:either )?the terms of the mit licen[cs]e or the apache licen[cs]e version 2 0
copyleft-next t copyleft next 0 3 1
opl t open publication licen[cs]e v(?:1 0| 1 0|ersion 1 0)
oasl t open audio licen[cs]e version 1
fal t free art licen[cs]e 1 [123]
free-use t you are free to use this (?:code|software|script|font) for (?:any|personal|commercial) (?:and commercial )?(?:use|purpose|purposes)
academic t for academic and non commercial research (?:use|purposes) only
non-commercial t free for (?:personal and )?non commercial use only
"""


def literal_words(pattern: str) -> list[str]:
    """The words that every match of a pattern has, as they stand outside its groups and classes."""
    outside = pattern
    while (less := re.sub(r"[^ ]*\(\?:[^()]*\)\??[^ ]*", " ", outside)) != outside:
        outside = less
    return [w for w in outside.split() if re.fullmatch("[a-z0-9]+", w)]


def signatures() -> list[tuple[str, str, int, float, tuple[str, ...]]]:
    """label, pattern, priority, confidence, keywords: of its own words the longest, as that is likely the rarest."""
    found = []
    for line in TABLE.split("\n"):
        if line:
            label, strength, pattern = line.split(" ", 2)
            words = literal_words(pattern)
            found.append((label, pattern, *STRENGTHS[strength], (max(words, key=len),)))
    return found
