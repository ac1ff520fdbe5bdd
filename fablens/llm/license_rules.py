"""License rules written by hand, where families differ: (label, keyword, pattern) over lower-case words and single spaces.

The keyword occurs in whatever the pattern matches. A mark + behind a version stands as "+" at the end of its word.
"""

# Notices that say which version they mean.
NOTICES = (
    ("gpl-2-or-later", "free software foundation", r"general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", "free software foundation", r"general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-1-or-later", "free software foundation", r"general public license as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2", "free software foundation", r"general public license(?: version 2)? as published by the free software foundation(?: version 2(?: of the license)?)?(?! either| version)"),
    ("gpl-3", "free software foundation", r"general public license as published by the free software foundation version 3(?: of the license)?(?! or)"),
    ("gpl-2", "version 2 of the gnu", r"version 2 of the gnu general public licen[sc]e"),
    ("gpl-3", "version 3 of the gnu", r"version 3 of the gnu general public licen[sc]e"),
    ("lgpl-2-or-later", "library general public", r"library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "lesser general public", r"lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3-or-later", "lesser general public", r"lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-or-later", "affero general public", r"affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl-1.3-or-later", "free documentation", r"free documentation license version 1 3 or any later version published by the free software foundation"),
    ("gfdl-1.2-or-later", "free documentation", r"free documentation license version 1 2 or any later version published by the free software foundation"),
    ("gfdl-1.1-or-later", "free documentation", r"free documentation license version 1 1 or any later version published by the free software foundation"),
    ("apache-2.0", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", r"(?:apache|asl) (?:version |v)?2(?: 0)? licen[sc]ed?"),
    ("apache-2.0", "apachev2", r"apachev2"),
    ("apache-2.0", "asl 2", r"asl 2 0"),
    ("mpl-2.0", "mozilla public", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public", r"subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla public", r"subject to the mozilla public license version 1 0"),
    ("epl-1.0", "eclipse public", r"made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse public", r"made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("cpl-1.0", "common public", r"made available under the terms of the common public license v1 0"),
    ("cddl-1.0", "common development", r"subject to the terms of the common development and distribution license version 1 0 only"),
    ("eupl-1.1", "eupl", r"licensed under the eupl version 1 1"),
    ("eupl-1.2-or-later", "eupl", r"licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions"),
    ("afl-3.0", "academic free", r"licensed under the academic free license version 3 0"),
    ("osl-3.0", "open software license", r"licensed under the open software license version 3 0"),
    ("boost-1.0", "boost software", r"distributed under the boost software license version 1 0"),
    ("ofl-1.1", "open font", r"licensed under the sil open font license version 1 1"),
    ("ecl-2.0", "educational community", r"licensed under the educational community license version 2 0"),
    ("upl-1.0", "universal permissive", r"licensed under the universal permissive license v ?1 0"),
    ("php-3.01", "php license", r"subject to version 3 01 of the php license"),
    ("php-3.0", "php license", r"subject to version 3 0 of the php license"),
    ("zpl-2.1", "zope public", r"subject to the provisions of the zope public license version 2 1"),
    ("artistic-2.0", "artistic license", r"terms of the artistic license version 2 0"),
    ("sspl-1", "server side public", r"server side public license version 1 as published by mongodb"),
    ("wtfpl-2", "do what the fuck", r"terms of the do what the fuck you want to public license version 2 as published by sam hocevar"),
    ("cc0-1.0", "cc0 1 0", r"cc0 1 0 universal"),
    ("elastic-2.0", "elastic license", r"elastic license (?:version |v)?2(?: 0)?"),
    ("polyform-noncommercial-1.0", "polyform noncommercial", r"polyform noncommercial license 1 0(?: 0)?"),
    ("blueoak-1.0", "blue oak", r"blue oak model license(?: version)? 1 0(?: 0)?"),
    ("cecill-2.1", "cecill", r"cecill (?:free software licen[sc]e agreement )?(?:version |v)?2 1"),
    ("cecill-b", "cecill b", r"cecill b(?: licen[sc]e)?"),
    ("cecill-c", "cecill c", r"cecill c(?: licen[sc]e)?"),
    ("gpl-2-with-classpath-exception", "classpath exception", r"(?:gpl|general public license)(?: version)? v?2(?: 0)?(?: only)? with (?:the )?classpath exception(?: 2 0)?"),
    ("gpl-2-with-linux-syscall-note", "linux syscall note", r"gpl 2 0(?: only)? with linux syscall note"),
    ("apache-2.0-with-llvm-exception", "llvm exception", r"apache (?:license )?v?2 0 with llvm exceptions?"),
)

# Passages of license texts and of notices without a version.
PASSAGES = (
    ("mit", "sublicense and or sell", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "this permission notice shall be", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "authors or copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "notice appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "author disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", "with or without fee is hereby granted", r"for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "its documentation for any purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", "retain the above copyright", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "use of this source code is governed", r"use of this source code is governed by a bsd style licen[sc]e"),
    ("bsd", "contributors as is", r"this software is provided by the (?:copyright holders|regents) and contributors as is"),
    ("bsd-2-clause", "views and conclusions", r"views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-3-clause", "to endorse or promote products", r"names? of (?:the )?(?:copyright holder|university|author|company|contributors|its contributors).{0,60}? may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "must display the following", r"must display the following acknowledge?ment this product includes software developed by"),
    ("apache", "grants to you a perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "express or implied see the license", r"without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "apache software foundation http", r"this product includes software developed by the apache software foundation http www apache org"),
    ("apache-1.1", "names apache and apache software", r"the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache", "licensed to the apache software", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "see the gnu general public", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "received a copy of the gnu general", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2", "version 2 june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3", "version 3 29 june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl", "freedom to share and change", r"licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "free copyleft license for software", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "convey verbatim copies", r"you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-2", "copy and distribute verbatim", r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("lgpl", "see the gnu lesser", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", "received a copy of the gnu library", r"you should have received a copy of the gnu library general public license along with"),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "incorporates the terms and conditions", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", "see the gnu affero", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("agpl-3", "interacting with it remotely", r"prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license"),
    ("mpl-2.0", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-2.0", "a copy of the mpl was not", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this eclipse public", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl", "accompanies this distribution", r"which accompanies this distribution and is available at https? (?:www )?eclipse org"),
    ("cpl", "this common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", "this ibm public license", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", "include this cddl header", r"when distributing covered code include this cddl header in each file"),
    ("eupl", "in compliance with the licence", r"you may not use this work except in compliance with the licence"),
    ("artistic", "under which a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("artistic-2.0", "artistic license 2 0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the artistic license 2 0"),
    ("boost-1.0", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "freely subject to the following", r"to alter it and redistribute it freely subject to the following restrictions"),
    ("libpng", "libpng", r"this copy of the libpng notices is provided for your convenience"),
    ("unlicense", "anyone is free to copy modify", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense org", r"refer to https? unlicense org"),
    ("wtfpl", "you just do what the fuck", r"you just do what the fuck you want to"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "extent possible under law", r"to the extent possible under law(?: the)? .{1,80}? (?:has|have) (?:waived|dedicated) all copyright"),
    ("cc-by", "creative commons attribution", r"this work is licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported)? license(?! to)"),
    ("ofl", "fonts and derivatives", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("ofl", "reserved font name", r"no modified version of the font software may use the reserved font names?"),
    ("psf", "python software foundation psf", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("ms-pl", "contributor grants you a non exclusive", r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("postgresql", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "deal with the software", r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons .{0,60}? deal with the software"),
    ("ncsa", "university of illinois", r"neither the names of .{1,60}? university of illinois"),
    ("w3c", "by obtaining using and or copying this work", r"by obtaining using and or copying this work you the licensee agree"),
    ("vim", "unmodified copies of vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("ruby", "under either the terms", r"you can redistribute it and or modify it under either the terms of the (?:gpl|2 clause bsdl)"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("sleepycat", "accompanying software that uses", r"obtain complete source code for the db software and any accompanying software that uses the db software"),
    ("sspl", "program as a service", r"offering the program as a service"),
    ("busl", "non production use", r"licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?"),
    ("public-domain", "public domain", r"(?:this (?:work|file|code|software) is|hereby place it) in the public domain"),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", "not subject to copyright", r"work of the (?:united states|u s) government (?:and )?(?:is )?not subject to copyright"),
    ("proprietary", "confidential and proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software) via any medium is strictly prohibited"),
    ("proprietary", "reverse engineer", r"you (?:may|shall) not reverse engineer decompile or disassemble the software"),
    ("copyright", "copyright", r"copyright (?:c )?(?:by )?the .{1,40}? authors"),
)

# Addresses, classifiers of package indexes and identifiers whose words are not the family's label.
MARKS = (
    ("mit", "opensource org licen", r"opensource org licenses?(?: php)? mit(?: license(?: php| html)?)?"),
    ("mit-0", "mit 0", r"(?:spdx license identifier|licen[sc]e) mit 0"),
    ("mit", "choosealicense", r"choosealicense com licenses mit"),
    ("isc", "opensource org licen", r"opensource org licenses? isc"),
    ("bsd-2-clause", "opensource org licen", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org licen", r"opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource org licen", r"opensource org licenses? bsd license(?: php)?"),
    ("apache-2.0", "opensource org licen", r"opensource org licenses? apache 2 0"),
    ("apache-2.0", "apache org licen", r"apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache org licen", r"apache org licenses license 1 1"),
    ("gpl-3", "gnu org", r"gnu org (?:licenses|copyleft) gpl 3 0(?: (?:html|txt|en html))?"),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0(?: (?:html|txt|en html))?"),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl(?: html| txt)?(?! [0-9])"),
    ("lgpl-3", "gnu org", r"gnu org licenses lgpl 3 0(?: (?:html|txt|en html))?"),
    ("lgpl-2.1", "gnu org", r"gnu org licenses (?:old licenses )?lgpl 2 1(?: (?:html|txt|en html))?"),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: html| txt)?(?! [0-9])"),
    ("agpl-3", "gnu org", r"gnu org licenses agpl 3 0(?: (?:html|txt|en html))?"),
    ("gfdl-1.3", "gnu org", r"gnu org licenses fdl 1 3(?: html)?"),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl", r"mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("epl-1.0", "eclipse org", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse org", r"eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("boost-1.0", "boost org", r"boost org license 1 0 txt"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl net", r"wtfpl net"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("cc-by-4.0", "creativecommons org", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.0", "creativecommons org", r"creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", "creativecommons org", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org", r"creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("mit", "osi approved", r"osi approved mit license"),
    ("bsd", "osi approved", r"osi approved bsd license"),
    ("isc", "osi approved", r"osi approved isc license(?: iscl)?"),
    ("apache", "osi approved", r"osi approved apache software license"),
    ("gpl-3", "osi approved", r"osi approved gnu general public license v3 gplv3"),
    ("gpl-3-or-later", "osi approved", r"osi approved gnu general public license v3 or later gplv3\+?"),
    ("gpl-2", "osi approved", r"osi approved gnu general public license v2 gplv2"),
    ("gpl-2-or-later", "osi approved", r"osi approved gnu general public license v2 or later gplv2\+?"),
    ("lgpl-3", "osi approved", r"osi approved gnu lesser general public license v3 lgplv3"),
    ("lgpl-3-or-later", "osi approved", r"osi approved gnu lesser general public license v3 or later lgplv3\+?"),
    ("lgpl-2-or-later", "osi approved", r"osi approved gnu lesser general public license v2 or later lgplv2\+?"),
    ("agpl-3", "osi approved", r"osi approved gnu affero general public license v3"),
    ("mpl-2.0", "osi approved", r"osi approved mozilla public license 2 0 mpl 2 0"),
    ("psf", "osi approved", r"osi approved python software foundation license"),
    ("zlib", "osi approved", r"osi approved zlib libpng license"),
    ("unlicense", "osi approved", r"osi approved the unlicense unlicense"),
    ("proprietary", "other proprietary license", r"license other proprietary license"),
    ("boost-1.0", "bsl 1 0", r"(?:spdx license identifier|licen[sc]e) bsl 1 0"),
    ("0bsd", "0bsd", r"0bsd"),
    ("psf-2", "psf 2 0", r"(?:spdx license identifier|licen[sc]e) psf 2 0"),
    ("mit", "expat", r"licen[sc]e expat"),
    ("proprietary", "licen", r"licen[sc]e (?:proprietary|unlicensed)"),
    ("unlicense", "licen", r"(?:spdx license identifier|licen[sc]e) (?:the )?unlicense"),
    ("gpl-2-or-later", "module license", r"module license gpl v2 or later"),
    ("gpl-2", "module license gpl", r"module license gpl v2"),
    ("mit", "license badge", r"license badge mit"),
    ("mit", "license mit", r"img shields io badge license mit(?: [a-z]+ svg)?"),
)

# Names beside those of the families.
NAMES = (
    ("mit", "mit", r"mit licen[sc]ed|mit style licen[sc]e|mit x11 licen[sc]e|x11 mit licen[sc]e|mit expat licen[sc]e"),
    ("mit", "under", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit"),
    ("bsd", "bsd", r"bsd licen[sc]ed|bsd style licen[sc]e|bsd like licen[sc]e"),
    ("bsd", "under", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?bsd"),
    ("isc", "isc", r"isc licen[sc]ed|internet systems consortium licen[sc]e"),
    ("gpl", "gpl", r"gpl licen[sc]ed|gpl ed|gpled"),
    ("apache", "apache", r"apache licen[sc]ed|apache style licen[sc]e"),
    ("apache", "under", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:apache|asl)(?! licen)"),
    ("unlicense", "unlicense", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?unlicense"),
    ("zlib", "under", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?zlib"),
    ("artistic", "perl license", r"perl licen[sc]e"),
    ("cc0", "creative commons public domain", r"creative commons public domain dedication"),
    ("public-domain", "public domain", r"public domain (?:software|dedication|work)"),
    ("beerware", "beer", r"beer ?ware licen[sc]e"),
    ("json", "json license", r"json licen[sc]e"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("busl", "busl", r"busl"),
    ("cecill", "cecill", r"cecill licen[sc]e"),
    ("proprietary", "proprietary licen", r"proprietary licen[sc]e"),
    ("elastic", "elastic licen", r"elastic licen[sc]e"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ms-rl", "ms rl", r"ms rl"),
)
