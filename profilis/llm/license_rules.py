"""Ordered signature rules for licence texts.

Signatures are regexes over normalised text: lower case, words joined by one space. They
are of two kinds, both written by hand: texts that stand for themselves (a licence's own
wording, notices and links, priority 1; full titles, priority 2), and names, each of which
stands in several phrasings: a tag (priority 0), a grant (1), a title (2) or a mere
mention (3).
"""

from __future__ import annotations

from dataclasses import dataclass

#: Label, keyword that any of its texts holds, regex of its names.
LICENCES: list[tuple[str, str, str]] = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 0"),
    ("gpl-3", "gpl", "gpl ?v?(?:ersion )?3(?: 0)?"),
    ("gpl-2", "gpl", "gpl ?v?(?:ersion )?2(?: 0)?"),
    ("gpl-1", "gpl", "gpl ?v?(?:ersion )?1(?: 0)?"),
    ("gpl-3", "general public", "(?<!lesser )(?<!affero )general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3"),
    ("gpl-2", "general public", "(?<!lesser )(?<!affero )general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2"),
    ("gpl", "general public", "gnu general public license(?! v)"),
    ("lgpl-3", "lgpl", "lgpl ?v?(?:ersion )?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?(?:ersion )?2 1"),
    ("lgpl-2", "lgpl", "lgpl ?v?(?:ersion )?2(?: 0)?(?! 1)"),
    ("lgpl-3", "lesser general", "(?:gnu )?lesser general public license v(?:ersion )?3"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public license v(?:ersion )?2 1"),
    ("lgpl", "lesser general", "gnu lesser general public license(?! v)"),
    ("agpl-3", "agpl", "agpl ?v?(?:ersion )?3?(?: 0)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: v(?:ersion )?3)?"),
    ("bsd-2-clause", "bsd", "(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:3 clause|three clause|new|revised|modified) bsd|bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:4 clause|four clause|original|old) bsd|bsd 4 clause"),
    ("bsd-zero", "bsd", "(?:0|zero) ?clause bsd|0bsd|bsd 0 clause"),
    ("bsd", "bsd", "bsd(?: style)?(?! [0-9])"),
    ("isc", "isc", "isc"),
    ("mpl-2", "mozilla", "mozilla public license(?: v(?:ersion )?)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: v(?:ersion )?)? ?1 1"),
    ("mpl-2", "mpl", "mpl ?v?(?:ersion )?2(?: 0)?"),
    ("mpl-1.1", "mpl", "mpl ?v?(?:ersion )?1 1"),
    ("epl-2", "eclipse", "eclipse public license(?: v(?:ersion )?)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public license(?: v(?:ersion )?)? ?1(?: 0)?"),
    ("edl-1", "eclipse", "eclipse distribution license(?: v(?:ersion )?)? ?1(?: 0)?"),
    ("cddl-1", "cddl", "cddl ?v?(?:ersion )?1(?: [01])?"),
    ("cddl-1", "common development", "common development and distribution license"),
    ("cpl-1", "common public", "common public license(?: v(?:ersion )?)? ?1(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl ?v?(?:ersion )?1 2"),
    ("eupl-1.1", "eupl", "eupl ?v?(?:ersion )?1 1"),
    ("eupl", "european union", "european union public licen[cs]e"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa"),
    ("cc-by-nc", "cc by", "cc by nc(?! nd)(?! sa)"),
    ("cc-by-nd", "cc by", "cc by nd"),
    ("cc-by-sa", "cc by", "cc by sa"),
    ("cc-by", "cc by", "cc by(?! nc)(?! nd)(?! sa)"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?! no ?deriv)(?! share)"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"),
    ("cc-by", "creative", "creative commons attribution(?! non)(?! no)(?! share)"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc0", "creative", "creative commons zero"),
    ("public-domain", "public domain", "public domain"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1", "boost", "boost software license(?: v(?:ersion )?1(?: 0)?)?"),
    ("boost-1", "bsl 1 0", "bsl 1 0"),
    ("artistic-2", "artistic", "artistic license(?: v(?:ersion )?)? ?2(?: 0)?"),
    ("artistic-1", "artistic", "artistic license(?: v(?:ersion )?)? ?1(?: 0)?"),
    ("python-2", "python", "python(?: software foundation)? license(?: v(?:ersion )?2)?"),
    ("python-2", "psf license", "psf license"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl-1.1", "open font", "sil open font license(?: v(?:ersion )?1 1)?"),
    ("odbl-1", "open database", "open database license"),
    ("odc-by-1", "open data commons", "open data commons attribution(?: license)?"),
    ("pddl-1", "open data commons", "open data commons public domain dedication"),
    ("gfdl-1.3", "free documentation", "gnu free documentation license(?: v(?:ersion )?1 3)?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-pl", "ms pl", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ms-rl", "ms rl", "ms rl"),
    ("busl-1.1", "business source", "business source license(?: 1 1)?"),
    ("sspl-1", "server side", "server side public license(?: v(?:ersion )?1)?"),
    ("elastic-2", "elastic", "elastic license(?: v(?:ersion )?2(?: 0)?)?"),
    ("polyform-nc", "polyform", "polyform noncommercial(?: license)?"),
    ("openrail", "rail", "(?:bigscience |creativeml )?open ?rail(?: m)?"),
    ("afl-3", "academic free", "academic free license(?: v(?:ersion )?3(?: 0)?)?"),
    ("osl-3", "open software", "open software license(?: v(?:ersion )?3(?: 0)?)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1", "universal permissive", "universal permissive license(?: v(?:ersion )?1(?: 0)?)?"),
    ("ecl-2", "educational community", "educational community license(?: v(?:ersion )?2(?: 0)?)?"),
    ("qpl-1", "q public", "q public license"),
    ("w3c", "w3c", "w3c(?: software(?: notice and)?)?"),
    ("vim", "vim", "vim"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php", "php(?: license)?(?: v(?:ersion )?3(?: 0?1)?)?"),
    ("x11", "x11", "x11"),
    ("curl", "curl", "curl"),
    ("beerware", "beerware", "beerware"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
]

#: Phrasings: priority (less wins), confidence, and the regex around a name.
TAG = (0, 1.0, "spdx license identifier (?:{name})(?= )")
_TERMS = "under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?(?:gnu )?"
_VERSION = "(?: v(?:ersion )?[0-9])?(?: [0-9])?(?= )"
GRANT = (
    1,
    0.95,
    f"(?:(?:dual )?licensed {_TERMS}(?:{{name}})(?: licen[cs]e)?|(?:released|distributed|available|provided|covered|published) {_TERMS}(?:{{name}}) licen[cs]e){_VERSION}",
)
TITLE = (2, 0.9, "(?:the )?(?:{name}) (?:public )?licen[cs]e(?: v(?:ersion)? ?[0-9]+)?(?= )")
MENTION = (3, 0.6, "(?:{name})(?= )")
#: Names that are ordinary words or short marks say nothing by a mere mention.
WORDLIKE = {"mit", "expat", "isc", "bsd", "zlib", "postgresql", "openssl", "vim", "ruby", "php", "x11", "curl", "python", "w3c", "apache", "elastic", "boost", "bsl 1 0", "psf license", "ncsa", "public domain"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float


#: Texts of a licence's own wording: label, keyword, regex.
BODIES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "apache org", "(?:www )?apache org licenses license 2 0"),
    ("gpl", "gnu org", "(?:www )?gnu org licenses gpl"),
    ("lgpl", "gnu org", "(?:www )?gnu org licenses lgpl"),
    ("agpl-3", "gnu org", "(?:www )?gnu org licenses agpl"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it"),
    ("mpl-2", "mozilla org", "mozilla org mpl 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("mit", "opensource org", "opensource org licenses mit"),
    ("bsd-3-clause", "opensource org", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource org", "opensource org licenses bsd 2 clause"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?! nd)(?! sa)"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa"),
    ("cc-by", "creativecommons", "creativecommons org licenses by(?! nc)(?! nd)(?! sa)"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero"),
    ("public-domain", "dedicated to the public", "dedicated to the public domain"),
    ("copyleft", "copyleft", "copyleft licen[cs]e"),
]


#: Further wording of licences and notices, each a signature by itself: label, keyword, regex.
NOTICES: list[tuple[str, str, str]] = [
    ("apache-2", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2", "distributed under the license", "software distributed under the license is distributed on an as is basis"),
    ("apache-2", "apache software foundation", "licensed to the apache software foundation(?: asf)? under one or more contributor license agreements"),
    ("apache-2", "january 2004", "apache license version 2 0 january 2004"),
    ("apache-2", "irrevocable copyright license", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "patent license", "royalty free irrevocable except as stated in this section patent license"),
    ("apache-2", "contribution s alone", "patent claims licensable by such contributor that are necessarily infringed by their contribution s alone"),
    ("gpl-2", "version 2 of the license", "either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3", "version 3 of the license", "either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2", "version 2 of the license", "(?:under|only) version 2 of the license(?: only)?"),
    ("gpl", "copy of the gnu general", "you should have received a copy of the gnu general public license"),
    ("gpl-2", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", "june 1991", "gnu general public license version 2 june 1991"),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-3", "gnu gpl version 3", "additional permission under gnu gpl version 3 section 7"),
    ("gpl-classpath", "special exception", "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gpl-linking", "special exception", "as a special exception (?:the copyright holders )?give permission to link the code"),
    ("gpl", "gplv", "released under gplv[23](?: or later)?"),
    ("lgpl", "copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2", "copy of the gnu library", "you should have received a copy of the gnu library general public license"),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it"),
    ("lgpl-2", "library general public", "gnu library general public license(?: version 2(?: 0)?)?"),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl", "specially designated software", "this license the lesser general public license applies to some specially designated software packages"),
    ("agpl-3", "copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "network server software", "affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("mit", "this permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense and or sell", "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-modern", "without written agreement", "permission is hereby granted without written agreement and without license or royalty fees"),
    ("hpnd", "its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("isc", "with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-zero", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "specific prior written permission", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "specific prior written permission", "names? of the authors? may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "secondary licenses", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "accompanying program", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1", "accompanying program", "the accompanying program is provided under the terms of this common public license"),
    ("cddl-1", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "anyone is free to copy", "released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "extent possible under law", "to the extent possible under law (?:the author has )?waived all copyright and related or neighboring rights"),
    ("cc-by", "creative commons", "this work is licensed under a creative commons attribution [1-4] 0(?: international| unported)? license"),
    ("cc-by-sa", "creative commons", "this work is licensed under a creative commons attribution share ?alike [1-4] 0(?: international| unported)? license"),
    ("cc-by-nc", "creative commons", "this work is licensed under a creative commons attribution non ?commercial [1-4] 0(?: international| unported)? license"),
    ("cc-by-nd", "creative commons", "this work is licensed under a creative commons attribution no ?derivatives [1-4] 0(?: international| unported)? license"),
    ("creative-commons", "creative commons", "licensed under a creative commons licen[cs]e"),
    ("cc-by", "creative commons", "open access article distributed under the terms of the creative commons attribution license"),
    ("gfdl-1.3", "this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "reserved font name", "no modified version of the font software may use the reserved font name s unless explicit written permission is granted"),
    ("ogl-uk", "public sector information", "contains public sector information licensed under the open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?"),
    ("odbl-1", "open database", "made available under the open database license"),
    ("odbl-1", "openstreetmap", "openstreetmap contributors(?: and)? available under the open database licen[cs]e"),
    ("perl-5", "perl itself", "is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself"),
    ("ijg", "independent jpeg group", "independent jpeg group s free software"),
    ("wtfpl", "want to public license", "do what the fuck you want to public license(?: version 2)?"),
    ("beerware", "the beer ware license", "the beer ware license(?: revision 42)?"),
    ("zlib", "misrepresented", "this software must not be misrepresented you must not claim that you wrote the original software(?: and)? altered source versions"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary information of"),
    ("proprietary", "strictly prohibited", "strictly prohibited proprietary and confidential"),
    ("proprietary", "prior written permission of", "without the prior written permission of the (?:publisher|copyright (?:holder|owner)|author)"),
    ("proprietary", "licensed materials", "licensed materials property of"),
    ("proprietary", "licensed not sold", "(?:software|product) is licensed not sold"),
    ("eula", "end user licen", "end user licen[cs]e agreement"),
    ("by-permission", "with permission", "(?:reproduced|reprinted|republished) with permission"),
    ("commons-clause", "commons clause", "commons clause license condition v1 0"),
    ("mit", "opensource org", "opensource org license mit"),
    ("isc", "opensource org", "opensource org licenses isc license"),
    ("artistic-2", "opensource org", "opensource org licenses artistic license 2 0"),
    ("mpl-2", "opensource org", "opensource org licenses mpl 2 0"),
    ("apache-2", "opensource org", "opensource org licenses apache 2 0"),
    ("gfdl-1.3", "gnu org", "gnu org licenses fdl"),
    ("cc-pdm", "creativecommons", "creativecommons org publicdomain mark"),
    ("odbl-1", "opendatacommons", "opendatacommons org licenses odbl"),
    ("odc-by-1", "opendatacommons", "opendatacommons org licenses by"),
    ("pddl-1", "opendatacommons", "opendatacommons org licenses pddl"),
    ("boost-1", "boost org", "boost org license 1 0(?: txt)?"),
    ("eclipse", "eclipse org", "eclipse org legal epl v(?:10|20)(?: html)? licen[cs]e"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("agpl-3", "license agpl", "license agpl ?v?3(?: 0)?(?: or later)?"),
]

#: Full titles that name a licence wherever they stand: label, keyword, regex.
TITLES: list[tuple[str, str, str]] = [
    ("ibm-public", "ibm public", "ibm public license(?: version 1 0)?"),
    ("lucent-public", "lucent public", "lucent public license(?: version 1 02?)?"),
    ("sun-public", "sun public", "sun public license(?: version 1 0)?"),
    ("sissl", "sun industry", "sun industry standards source license"),
    ("nokia", "nokia open source", "nokia open source license"),
    ("npl-1", "netscape public", "netscape public license(?: version 1 [01])?"),
    ("apsl-2", "apple public source", "apple public source license(?: version [12] [012])?"),
    ("intel", "intel open source", "intel open source license"),
    ("rpsl-1", "realnetworks", "realnetworks public source license"),
    ("ricoh", "ricoh source", "ricoh source code public license"),
    ("rpl-1", "reciprocal public", "reciprocal public license(?: 1 [15])?"),
    ("cpal-1", "common public attribution", "common public attribution license(?: version 1 0)?"),
    ("openldap", "openldap public", "openldap public license(?: version 2 8)?"),
    ("sleepycat", "sleepycat", "sleepycat license"),
    ("zpl-2", "zope public", "zope public license(?: version [12] [01])?"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("cnri-python", "cnri", "cnri (?:open source )?(?:gpl compatible )?license(?: agreement)?"),
    ("naumen", "naumen", "naumen public license"),
    ("nethack", "nethack", "nethack general public license"),
    ("motosoto", "motosoto", "motosoto open source license"),
    ("multics", "multics", "multics license"),
    ("fair", "fair license", "fair license"),
    ("frameworx", "frameworx", "frameworx open license"),
    ("entessa", "entessa", "entessa public license"),
    ("eiffel", "eiffel forum", "eiffel forum license(?: version 2)?"),
    ("eudatagrid", "eu datagrid", "eu datagrid software license"),
    ("aal", "attribution assurance", "attribution assurance license"),
    ("apl-1", "adaptive public", "adaptive public license"),
    ("catosl", "trusted open source", "computer associates trusted open source license"),
    ("cua-opl", "cua office", "cua office public license"),
    ("condor", "condor public", "condor public license"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: free software)? licen[cs]e(?: agreement)?"),
    ("lal", "licence art libre", "licence art libre"),
    ("fal", "free art license", "free art license"),
    ("dsl", "design science", "design science license"),
    ("opl", "open publication", "open publication license"),
    ("open-content", "open content license", "open content license"),
    ("cdla-permissive", "community data license", "community data license agreement permissive(?: version [12] 0)?"),
    ("cdla-sharing", "community data license", "community data license agreement sharing(?: version 1 0)?"),
    ("ogl-uk", "open government licen", "open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?"),
    ("etalab", "etalab", "etalab open licen[cs]e(?: 2 0)?"),
    ("dl-de-by", "germany attribution", "data licen[cs]e germany attribution(?: version)? 2 0"),
    ("dl-de-zero", "germany zero", "data licen[cs]e germany zero(?: version)? 2 0"),
    ("llama", "llama", "llama (?:2|3|3 1|3 2|3 3|4) community license(?: agreement)?"),
    ("openrail", "bigscience", "bigscience (?:open )?rail license(?: v1 0)?"),
    ("mistral-research", "mistral ai", "mistral ai (?:research|non production) license"),
    ("qwen", "qianwen", "tongyi qianwen (?:research )?license agreement"),
    ("falcon", "tii license", "falcon (?:180b|llm) tii license"),
    ("nvidia-open-model", "nvidia open model", "nvidia open model license"),
    ("deepseek", "deepseek license", "deepseek license agreement"),
    ("stability", "stability ai", "stability ai (?:community|non commercial research community) license(?: agreement)?"),
    ("polyform-shield", "polyform shield", "polyform shield license(?: 1 0 0)?"),
    ("polyform-perimeter", "polyform perimeter", "polyform perimeter license(?: 1 0 [01])?"),
    ("polyform-small-business", "polyform small", "polyform small business license(?: 1 0 0)?"),
    ("polyform-strict", "polyform strict", "polyform strict license(?: 1 0 0)?"),
    ("polyform-free-trial", "polyform free", "polyform free trial license(?: 1 0 0)?"),
    ("polyform-internal-use", "polyform internal", "polyform internal use license(?: 1 0 0)?"),
    ("confluent-community", "confluent community", "confluent community license(?: agreement)?(?: version 1 0)?"),
    ("rsal", "redis source available", "redis source available license(?: agreement)?(?: 2 0)?"),
    ("timescale", "timescale", "timescale license(?: agreement)?"),
    ("fsl-1.1", "functional source", "functional source license(?: version)?(?: 1 1)?"),
    ("prosperity-3", "prosperity public", "prosperity public license(?: 3 0 0)?"),
    ("parity-7", "parity public", "parity public license(?: 7 0 0)?"),
    ("hippocratic", "hippocratic", "hippocratic license(?: 2 [01])?"),
    ("anti-996", "anti 996", "anti 996 license(?: version 1 0)?"),
    ("blue-oak-1", "blue oak", "blue oak model license(?: 1 0 0)?"),
    ("mulan-psl", "mulan permissive", "mulan permissive software license(?: v(?:ersion )?2)?"),
    ("mulan-publ", "mulan public", "mulan public license(?: v(?:ersion )?[12])?"),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[cs]e(?: version 1 0)?"),
    ("gust-font", "gust font", "gust font (?:source )?license"),
    ("arphic", "arphic", "arphic public license"),
    ("ipa-font", "ipa font", "ipa font license(?: agreement)?(?: v1 0)?"),
    ("bitstream-vera", "bitstream vera", "bitstream vera (?:fonts )?(?:copyright )?license"),
    ("json", "json license", "json license"),
    ("glide", "glide", "3dfx glide (?:source code )?general public license"),
    ("info-zip", "info zip", "info zip license"),
    ("libpng", "libpng", "libpng license(?: version 2)?"),
    ("libtiff", "libtiff", "libtiff license"),
    ("ssleay", "ssleay", "(?:original )?ssleay license"),
    ("tcl", "tcl tk", "tcl tk license"),
    ("unicode", "unicode", "unicode (?:data files and software )?license(?: agreement| v3)"),
    ("xfree86", "xfree86", "xfree86 license(?: 1 1)?"),
    ("zend", "zend", "zend (?:engine )?license(?: version 2 0)?"),
    ("imagemagick", "imagemagick", "imagemagick license"),
    ("latex-lppl", "latex project", "latex project public license(?: version)?(?: 1 3c?)?"),
    ("artistic-1-cl", "clarified artistic", "clarified artistic license"),
    ("upl-1", "universal permissive", "universal permissive license upl(?: version)? 1 0"),
    ("watcom-1", "sybase", "sybase open watcom public license(?: version)?(?: 1 0)?"),
    ("vsl-1", "vovida", "vovida software license(?: v(?:ersion )?1 0)?"),
    ("simpl-2", "simple public license", "simple public license(?: 2 0)?"),
    ("spl-1", "sun solaris", "sun solaris source code public license"),
    ("oclc-2", "oclc", "oclc (?:office )?research public license(?: 2 0)?"),
    ("miros", "miros", "miros licen[cs]e"),
    ("lpl-1", "licence libre", "licence libre du quebec(?: permissive| reciprocite)?"),
    ("jabber", "jabber open source", "jabber open source license(?: 1 0)?"),
    ("ecos-2", "ecos license", "ecos license(?: version 2 0)?"),
    ("openmdw-1", "openmdw", "openmdw license(?: agreement)?(?: version 1 0)?"),
    ("eclipse-edl", "eclipse distribution", "eclipse distribution license v 1 0"),
]


def rules() -> list[Rule]:
    """All rules by priority, then in the order written above."""
    found = [Rule(label, key, f"(?<= ){body}(?= )", 1, 0.95) for label, key, body in BODIES + NOTICES]
    found += [Rule(label, key, f"(?<= )(?:the )?{title}(?= )", 2, 0.9) for label, key, title in TITLES]
    for label, key, name in LICENCES:
        kinds = [TAG, GRANT, TITLE] + ([] if key in WORDLIKE else [MENTION])
        found += [Rule(label, key, "(?<= )" + regex.format(name=name), p, c) for p, c, regex in kinds]
    return sorted(found, key=lambda r: r.priority)


#: Priorities that rules may have: 0 to this, exclusive.
PRIORITIES = 4
