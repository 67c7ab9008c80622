"""License scans by ordered signature rules, in built-in functions alone.

Every rule is a regular expression with keywords without which it cannot match, a label and a priority.  Only
documents that hold the keywords of some rule are looked at, and each rule only where its own stand.  A rule's
pattern is a literal of the plan, compiled once in a task.  Of overlapping detections, one that lies inside
another of higher priority is suppressed; of the same priority the longer stays, of equal places the earlier rule.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import NO_SPANS, let, placed, running

#: Phrases that are counted wherever their words stand, and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are what is not ASCII, letters and digits: everything else of ASCII becomes a space.
_ASCII = "".join(map(chr, range(128)))
_WORDLY = "".join(c.lower() if c.isalnum() else " " for c in _ASCII)

#: What rules see: A-Z in lower case, and each run of what does not print in ASCII as one space.
UNSEEN, SIGN = r"[^\x21-\x7E]+", "©"

#: How versions are written: "2", "2.0", "-2.0", ", version 2", " v. 2.0"; the number goes in the middle.
_V = r"(?:[ -]public)?(?:[ -]licen[cs]e)?(?: \((?:the )?\W?\w+\W?\))?,?[ -]?(?:version |ver\.? ?|v\.? ?)?"
#: What ends a GPL identifier.
_SFX = r"(?:-only|-or-later|\+)?"


class License(NamedTuple):
    """How a license is named: words of which a name or identifier holds one, names, identifiers (both expressions)."""

    keywords: tuple[str, ...]
    name: str
    spdx: str
    #: A word that means other things too: "{name} license" alone says nothing then.
    common: bool = False


LICENSES = {
    "mit": License(("mit", "expat"), r"(?:mit(?:/x11)?|expat)(?: \(?expat\)?)?", "mit"),
    "mit-0": License(("mit",), r"mit[ -](?:0|no attribution)", "mit-0"),
    "apache-1.0": License(("apache",), rf"apache(?: software)?{_V}1\.0", r"apache-1\.0"),
    "apache-1.1": License(("apache",), rf"apache(?: software)?{_V}1\.1", r"apache-1\.1"),
    "apache-2.0": License(("apache", "asl"), rf"(?:apache(?: software)?(?: foundation)?|asl){_V}2(?:\.0)?", r"apache-2\.0"),
    "apache": License(("apache",), r"apache(?: software)?", r"apache"),
    "0bsd": License(("bsd",), r"(?:zero|0)[ -]clause bsd", "0bsd"),
    "bsd-2-clause": License(("bsd",), r"(?:2|two)[ -]clause bsd|(?:simplified|freebsd) bsd|bsd[ -](?:2|two)[ -]clause", r"bsd-2-clause(?:-patent)?"),
    "bsd-3-clause": License(("bsd",), r"(?:3|three)[ -]clause bsd|(?:new|revised|modified) bsd|bsd[ -](?:3|three)[ -]clause", r"bsd-3-clause(?:-clear)?"),
    "bsd-4-clause": License(("bsd",), r"(?:4|four)[ -]clause bsd|(?:original|old) bsd|bsd[ -](?:4|four)[ -]clause", "bsd-4-clause"),
    "bsd": License(("bsd",), r"bsd", "bsd"),
    "gpl-1.0": License(("gpl", "general public"), rf"(?:gnu )?(?:gpl|general public license){_V}1(?:\.0)?", rf"gpl-1\.0{_SFX}"),
    "gpl-2.0": License(("gpl", "general public"), rf"(?:gnu )?(?:gpl|general public license){_V}2(?:\.0)?(?: or later| or any later version|\+)?", rf"gpl-2\.0{_SFX}"),
    "gpl-3.0": License(("gpl", "general public"), rf"(?:gnu )?(?:gpl|general public license){_V}3(?:\.0)?(?: or later| or any later version|\+)?", rf"gpl-3\.0{_SFX}"),
    "gpl": License(("gpl", "general public"), r"(?:gnu )?(?:gpl|general public)", "gpl"),
    "lgpl-2.0": License(("lgpl", "general public"), rf"(?:gnu )?(?:lgpl|(?:lesser|library) general public license){_V}2(?:\.0)?", rf"lgpl-2\.0{_SFX}"),
    "lgpl-2.1": License(("lgpl", "general public"), rf"(?:gnu )?(?:lgpl|(?:lesser|library) general public license){_V}2\.1(?: or later| or any later version|\+)?", rf"lgpl-2\.1{_SFX}"),
    "lgpl-3.0": License(("lgpl", "general public"), rf"(?:gnu )?(?:lgpl|lesser general public license){_V}3(?:\.0)?(?: or later| or any later version|\+)?", rf"lgpl-3\.0{_SFX}"),
    "lgpl": License(("lgpl", "general public"), r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)", "lgpl"),
    "agpl-3.0": License(("agpl", "affero"), rf"(?:gnu )?(?:agpl|affero general public license){_V}3(?:\.0)?", rf"agpl-3\.0{_SFX}"),
    "agpl": License(("agpl", "affero"), r"(?:gnu )?(?:agpl|affero general public)", "agpl"),
    "fdl-1.3": License(("fdl", "free documentation"), rf"(?:gnu )?(?:gfdl|free documentation license){_V}1\.[123]", rf"gfdl-1\.[123]{_SFX}"),
    "mpl-1.1": License(("mpl", "mozilla"), rf"(?:mozilla public license|mpl){_V}1\.[01]", r"mpl-1\.[01]"),
    "mpl-2.0": License(("mpl", "mozilla"), rf"(?:mozilla public license|mpl){_V}2(?:\.0)?", r"mpl-2\.0"),
    "epl-1.0": License(("epl", "eclipse"), rf"(?:eclipse public license|epl){_V}1(?:\.0)?", r"epl-1\.0"),
    "epl-2.0": License(("epl", "eclipse"), rf"(?:eclipse public license|epl){_V}2(?:\.0)?", r"epl-2\.0"),
    "cddl-1.0": License(("cddl", "common development"), r"(?:common development and distribution license|cddl)(?:,? (?:version |v)?1\.[01])?", r"cddl-1\.[01]"),
    "cpl-1.0": License(("cpl", "common public"), r"common public license", r"cpl-1\.0"),
    "eupl-1.2": License(("eupl", "european union"), r"(?:european union public licen[cs]e|eupl)(?:,? (?:version |v\.? ?)?1\.[12])?", r"eupl-1\.[12]"),
    "isc": License(("isc",), r"isc", "isc"),
    "zlib": License(("zlib",), r"zlib(?:/libpng)?", "zlib"),
    "libpng": License(("libpng",), r"libpng", r"libpng(?:-2\.0)?"),
    "bsl-1.0": License(("boost", "bsl-"), r"boost software(?: licen[cs]e)?(?:,? ?(?:-|version |v)?1\.0)?", r"bsl-1\.0"),
    "busl-1.1": License(("business source", "busl-"), r"business source licen[cs]e(?:,? (?:version |v)?1\.1)?", r"busl-1\.1"),
    "sspl-1.0": License(("sspl", "server side public"), r"server side public license|sspl", r"sspl-1\.0"),
    "elastic-2.0": License(("elastic",), r"elastic license(?: (?:version |v)?2(?:\.0)?)?", r"elastic-2\.0"),
    "unlicense": License(("unlicense",), r"unlicense", "unlicense"),
    "wtfpl": License(("wtfpl", "do what the"), r"wtfpl|do what the fuck you want to public license", "wtfpl"),
    "beerware": License(("beer",), r"beer-?ware", "beerware"),
    "artistic-1.0": License(("artistic",), rf"(?:perl )?artistic{_V}1(?:\.0)?", r"artistic-1\.0"),
    "artistic-2.0": License(("artistic",), rf"(?:perl )?artistic{_V}2(?:\.0)?", r"artistic-2\.0"),
    "artistic": License(("artistic",), r"(?:perl )?artistic", "artistic", True),
    "postgresql": License(("postgresql",), r"postgresql", "postgresql", True),
    "python-2.0": License(("psf", "python"), r"python software foundation|psf", r"(?:python|psf)-2\.0"),
    "ruby": License(("ruby",), r"ruby", "ruby", True),
    "php-3.01": License(("php",), r"php(?: license)?,? (?:version |v)?3(?:\.0\d?)?", r"php-3\.01?"),
    "openssl": License(("openssl",), r"openssl", "openssl", True),
    "curl": License(("curl",), r"curl", "curl", True),
    "ncsa": License(("ncsa",), r"(?:university of illinois/)?ncsa(?: open source)?", "ncsa"),
    "ms-pl": License(("microsoft", "ms-pl"), r"microsoft public|ms-pl", "ms-pl"),
    "ms-rl": License(("microsoft", "ms-rl"), r"microsoft reciprocal|ms-rl", "ms-rl"),
    "ofl-1.1": License(("ofl", "open font"), r"(?:sil )?open font(?: license)?(?:,? (?:version )?1\.1)?|(?:sil )?ofl(?: 1\.1)?", r"ofl-1\.1"),
    "odbl-1.0": License(("odbl", "open database"), r"(?:open data commons )?open database|odbl", r"odbl-1\.0"),
    "odc-by-1.0": License(("odc", "open data commons"), r"open data commons attribution|odc-by", r"odc-by-1\.0"),
    "pddl-1.0": License(("pddl", "public domain dedication"), r"public domain dedication and license|pddl", r"pddl-1\.0"),
    "cc0-1.0": License(("cc0", "creative commons"), r"(?:cc0|creative commons(?: cc0| zero))(?:[ -]1\.0)?", r"cc0-1\.0"),
    "cc-by": License(("cc by", "cc-by", "creative commons"), r"(?:cc[ -]by|creative commons attribution)(?:[ -][1-4]\.[05])?", r"cc-by-[1-4]\.[05]"),
    "cc-by-sa": License(("cc by", "cc-by", "creative commons"), r"(?:cc[ -]by[ -]sa|creative commons attribution[ -]share[ -]?alike)(?:[ -][1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]"),
    "cc-by-nc": License(("cc by", "cc-by", "creative commons"), r"(?:cc[ -]by[ -]nc|creative commons attribution[ -]non-?commercial)(?:[ -][1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]"),
    "cc-by-nd": License(("cc by", "cc-by", "creative commons"), r"(?:cc[ -]by[ -]nd|creative commons attribution[ -]no ?-?deriv(?:ative)?s?)(?:[ -][1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]"),
    "cc-by-nc-sa": License(("cc by", "cc-by", "creative commons"), r"(?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non-?commercial[ -]share[ -]?alike)(?:[ -][1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]"),
    "cc-by-nc-nd": License(("cc by", "cc-by", "creative commons"), r"(?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non-?commercial[ -]no ?-?deriv(?:ative)?s?)(?:[ -][1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]"),
    "proprietary": License(("proprietary",), r"(?:a |our )?proprietary", "licenseref-proprietary"),
}
#: What a name stands in: (keyword, expression, priority); {any} is a name or an identifier. With every license these are rules.
TEMPLATES = (
    ("spdx-license-identifier", r"spdx-license-identifier: ?(?:[\w.+-]+ (?:and|or|with) )?{spdx}(?:[^\w+-]|$)", 100),
    ("opensource.org", r"opensource\.org/licen[cs]es?/{spdx}(?:[^\w+-]|$)", 90),
    ("spdx.org", r"spdx\.org/licenses/{spdx}(?:[^\w+-]|$)", 90),
    (" under ", r"\b(?:licensed|released|distributed|available|published|covered|shared|provided|offered|redistributable|open[ -]sourced)(?: \w+){{0,3}} under (?:either )?(?:(?:the|a) )?(?:terms (?:and conditions )?of )?(?:(?:the|a) )?(?:{any})(?:[ -]style)?(?: licen[cs]e)?", 80),
    ("licen", r"\blicen[cs]e ?[:=] ?\W?(?:the )?(?:{any})(?:[^\w+-]|$)", 70),
    ("licen", r"\b(?:the )?(?:{any})(?:[ -]style)? licen[cs]ed?\b", 60),
)
#: Rules that are written one by one: (label, keyword, expression, priority).
OTHER = (
    # texts and notices
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 95),
    ("mit", "merchantability", r"the software is provided \W?as is\W?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability", 88),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies", 88),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 95),
    ("0bsd", "without fee", r"with or without fee is hereby granted\. the software is provided", 85),
    ("bsd", "redistribution", r"redistributions? (?:and use )?in source and binary forms", 85),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 84),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,80}? may be used to endorse or promote", 95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software", 95),
    ("zlib", "in no event will the authors", r"in no event will the authors be held liable for any damages arising from the use of this software", 90),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 90),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 95),
    ("bsl-1.0", "executable object code", r"machine-executable object code generated by a source language processor", 95),
    ("apache-2.0", "license", r"you may not use this file except in compliance with the license.{0,60}?apache", 90, ("except in compliance",)),
    ("apache-2.0", "apache license", r"apache license,? version 2\.0", 62),
    ("apache-2.0", "january 2004", r"version 2\.0, january 2004", 92),
    ("gpl-3.0", "license", r"under the terms of (?:version 3 of )?the gnu general public license as published by the free software foundation, (?:either )?version 3", 96, ("version 3",)),
    ("gpl-2.0", "license", r"under the terms of (?:version 2 of )?the gnu general public license as published by the free software foundation[;,] (?:either )?version 2", 96, ("version 2",)),
    ("gpl-3.0", "license", r"gnu general public license version 3, 29 june 2007", 96, ("29 june 2007",)),
    ("gpl-2.0", "license", r"gnu general public license version 2, june 1991", 96, ("june 1991",)),
    ("gpl", "general public license", r"under the terms of the gnu general public license", 82),
    ("gpl", "general public license", r"should have received a copy of the gnu general public license", 82),
    ("lgpl-2.1", "license", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 2\.1", 96, ("version 2.1",)),
    ("lgpl-3.0", "license", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 3", 96, ("version 3",)),
    ("lgpl", "general public license", r"under the terms of the gnu (?:lesser|library) general public license", 83),
    ("agpl-3.0", "license", r"under the terms of the gnu affero general public license as published by the free software foundation, (?:either )?version 3", 96, ("affero",)),
    ("agpl", "license", r"under the terms of the gnu affero general public license", 83, ("affero",)),
    ("fdl-1.3", "free documentation license", r"under the terms of the gnu free documentation license", 83),
    ("mpl-2.0", "license", r"this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0", 96, ("mozilla public",)),
    ("mpl-1.1", "license", r"the contents of this file are subject to the mozilla public license version 1\.1", 96, ("mozilla public",)),
    ("mpl-2.0", "license", r"mozilla public license,? (?:version|v\.?) ?2\.0", 62, ("mozilla public",)),
    ("mpl-1.1", "license", r"mozilla public license,? (?:version|v\.?) ?1\.1", 62, ("mozilla public",)),
    ("epl-2.0", "license", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\.? ?|version )?2\.0", 96, ("eclipse public",)),
    ("epl-1.0", "license", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\.? ?|version )?1\.0", 96, ("eclipse public",)),
    ("epl-2.0", "license", r"eclipse public license,? (?:-|version|v\.?) ?2\.0", 62, ("eclipse public",)),
    ("epl-1.0", "license", r"eclipse public license,? (?:-|version|v\.?) ?1\.0", 62, ("eclipse public",)),
    ("cddl-1.0", "license", r"subject to the terms of the common development and distribution license", 95, ("common development",)),
    ("wtfpl", "license", r"do what the fuck you want to public license", 90, ("do what the",)),
    ("beerware", "beer", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer", 95),
    ("python-2.0", "psf license", r"\bpsf license agreement", 85),
    ("python-2.0", "license", r"python software foundation license", 85, ("python software",)),
    ("ofl-1.1", "license", r"this font software is licensed under the sil open font license", 95, ("open font",)),
    ("artistic-2.0", "license", r"artistic license,? (?:version )?2\.0", 62, ("artistic",)),
    ("busl-1.1", "license", r"business source license,? (?:version )?1\.1", 62, ("business source",)),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related (?:or|and) neighbou?ring rights", 92),
    # gnu general public license with a version, anywhere
    ("gpl-3.0", "general public license", r"gnu general public license,? (?:\(gpl\) )?(?:version|v\.?) ?3(?:\.0)?\b", 62),
    ("gpl-2.0", "general public license", r"gnu general public license,? (?:\(gpl\) )?(?:version|v\.?) ?2(?:\.0)?\b", 62),
    ("lgpl-2.1", "general public license", r"gnu (?:lesser|library) general public license,? (?:version|v\.?) ?2\.1\b", 63),
    ("lgpl-3.0", "general public license", r"gnu lesser general public license,? (?:version|v\.?) ?3(?:\.0)?\b", 63),
    ("agpl-3.0", "license", r"gnu affero general public license,? (?:version|v\.?) ?3(?:\.0)?\b", 63, ("affero",)),
    # identifiers by themselves, where they can mean nothing else
    ("apache-2.0", "apache-2.0", r"\bapache-2\.0(?:[^\w+-]|$)", 45),
    ("bsd-2-clause", "bsd-2", r"\bbsd-2-clause(?:[^\w+-]|$)", 45),
    ("bsd-3-clause", "bsd-3", r"\bbsd-3-clause(?:[^\w+-]|$)", 45),
    ("gpl-2.0", "gpl-2", r"\bgpl-2\.0(?:-only|-or-later|\+)?(?:[^\w+-]|$)", 45),
    ("gpl-3.0", "gpl-3", r"\bgpl-3\.0(?:-only|-or-later|\+)?(?:[^\w+-]|$)", 45),
    ("gpl-2.0", "gplv2", r"\bgplv2\+?(?:[^\w-]|$)", 45),
    ("gpl-3.0", "gplv3", r"\bgplv3\+?(?:[^\w-]|$)", 45),
    ("lgpl-2.1", "lgpl-2.1", r"\blgpl-2\.1(?:-only|-or-later|\+)?(?:[^\w+-]|$)", 45),
    ("lgpl-3.0", "lgpl-3", r"\blgpl-3\.0(?:-only|-or-later|\+)?(?:[^\w+-]|$)", 45),
    ("lgpl-3.0", "lgplv3", r"\blgplv3\+?(?:[^\w-]|$)", 45),
    ("agpl-3.0", "agpl", r"\bagpl(?:v3|-3\.0(?:-only|-or-later)?)\+?(?:[^\w-]|$)", 45),
    ("mpl-2.0", "mpl-2", r"\bmpl-2\.0(?:[^\w+-]|$)", 45),
    ("epl-2.0", "epl-2", r"\bepl-2\.0(?:[^\w+-]|$)", 45),
    ("cc0-1.0", "cc0", r"\bcc0(?:-1\.0)?(?:[^\w+-]|$)", 45),
    ("cc-by-sa", "by", r"\bcc[ -]by[ -]sa[ -][1-4]\.[05]\b", 46, ("cc by", "cc-by")),
    ("cc-by-nc", "by", r"\bcc[ -]by[ -]nc[ -][1-4]\.[05]\b", 46, ("cc by", "cc-by")),
    ("cc-by-nd", "by", r"\bcc[ -]by[ -]nd[ -][1-4]\.[05]\b", 46, ("cc by", "cc-by")),
    ("cc-by-nc-sa", "by", r"\bcc[ -]by[ -]nc[ -]sa[ -][1-4]\.[05]\b", 47, ("cc by", "cc-by")),
    ("cc-by-nc-nd", "by", r"\bcc[ -]by[ -]nc[ -]nd[ -][1-4]\.[05]\b", 47, ("cc by", "cc-by")),
    # addresses
    ("cc-by", "license", r"creativecommons\.org/licenses/by/[1-4]\.[05]", 90, ("creativecommons.org",)),
    ("cc-by-sa", "license", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]", 90, ("creativecommons.org",)),
    ("cc-by-nc", "license", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]", 90, ("creativecommons.org",)),
    ("cc-by-nd", "license", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]", 90, ("creativecommons.org",)),
    ("cc-by-nc-sa", "license", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", 90, ("creativecommons.org",)),
    ("cc-by-nc-nd", "license", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", 90, ("creativecommons.org",)),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0", 90),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0", 90),
    ("gpl-3.0", "license", r"gnu\.org/licenses/gpl-3\.0", 91, ("gnu.org",)),
    ("gpl-2.0", "license", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", 91, ("gnu.org",)),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:gpl|\W|$)", 90),
    ("lgpl-2.1", "license", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", 91, ("gnu.org",)),
    ("lgpl-3.0", "license", r"gnu\.org/licenses/lgpl-3\.0", 91, ("gnu.org",)),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)", 90),
    ("agpl-3.0", "license", r"gnu\.org/licenses/agpl(?:-3\.0)?", 90, ("gnu.org",)),
    ("fdl-1.3", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl", 90),
    ("apache-2.0", "license", r"apache\.org/licenses/license-2\.0", 90, ("apache.org",)),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0", 90),
    ("mpl-1.1", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/(?:1\.1|mpl-1\.1)", 90),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)", 90),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10", 90),
    ("ofl-1.1", "org/ofl", r"(?:scripts|openfontlicense)\.(?:sil\.)?org/ofl", 90),
    ("unlicense", "unlicense.org", r"unlicense\.org", 90),
    ("bsl-1.0", "license", r"boost\.org/license_1_0", 90, ("boost.org",)),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net", 90),
    # rights without a license
    ("public-domain", "public domain", r"\b(?:released|dedicated|placed|put|is|are) (?:in|in ?to|to) the public domain", 50),
    ("copyright", "copyright", r"\bcopyright (?:\(c\) ?)?(?:by )?(?:19|20)\d\d", 20),
    ("copyright", "(c)", r"\(c\) ?(?:copyright )?(?:19|20)\d\d", 20),
    ("copyright", "spdx-filecopyrighttext", r"spdx-filecopyrighttext:", 30),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 75),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use)(?: or \w+)? of this (?:file|software|document|material)", 75),
    ("no-reproduction", "may be reproduced", r"no part of (?:this|the) \w+ may be reproduced", 70),
    ("reserved", "rights reserved", r"\b(?:all|some|no other) rights reserved\b", 40),
    ("no-commercial-use", "commercial use", r"\b(?:for non-?commercial use only|not for commercial use|no commercial use)\b", 55),
    ("academic", " purposes only", r"\bfor (?:academic|educational|research)(?: (?:and|or) \w+)? purposes only\b", 55),
)


#: What stands in many keywords.
STEMS = ("licen", "general public", ".org", "copyright", "rights reserved", "gpl")


class Rule(NamedTuple):
    """A signature over what rules see; ``keyword`` and one of ``also`` (if there are any) must stand there."""

    label: str
    keyword: str
    pattern: str
    priority: int
    also: tuple[str, ...] = ()


def signature_rules() -> list[Rule]:
    """All rules: each license in each template, then the others; a rule's place breaks ties of priority."""
    out = []
    for label, license_ in LICENSES.items():
        either = f"{license_.name}|{license_.spdx}"
        for keyword, template, priority in TEMPLATES:
            if not (license_.common and priority <= 60):
                sure = 5 if any(c.isdigit() for c in label) or label.count("-") > 1 else 0
                out.append(Rule(label, keyword, template.format(any=either, spdx=license_.spdx), priority + sure, license_.keywords))
    return out + [Rule(*x) for x in OTHER]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _detections(rules: list[Rule], seen: str) -> str:
    """SQL: array of SPAN of what all rules find; rank is the rule's place by priority, kind its label, n its level of priority.

    Whether a rule matches is asked of a literal pattern; only those that do are taken apart.
    """
    levels = sorted({r.priority for r in rules}, reverse=True)
    ranked = sorted(rules, key=lambda r: -r.priority)
    of: dict[tuple[str, ...], list[str]] = {}
    for rank, r in enumerate(ranked):
        of.setdefault(r.also, []).append(f"if(contains({seen}, {_quoted(r.keyword)}) and rlike({seen}, {_quoted(r.pattern)}), {rank}, null)")
    groups = [f"if({' or '.join(f'contains({seen}, {_quoted(k)})' for k in also) or 'true'}, array({', '.join(parts)}), array(cast(null as int)))" for also, parts in of.items()]
    matching = f"filter(concat({', '.join(groups)}), i -> i is not null)"
    table = "array(" + ", ".join(f"named_struct('label', {_quoted(r.label)}, 'pattern', {_quoted(r.pattern)}, 'rank', {rank}, 'level', {levels.index(r.priority)})" for rank, r in enumerate(ranked)) + ")"
    found = f"named_struct('found', regexp_extract_all({seen}, rule.pattern, 0), 'between', split({seen}, rule.pattern), 'value', regexp_extract_all({seen}, rule.pattern, 0))"
    spans = let("f", found, f"transform({placed('f', 'rule.label', 'rule.rank')}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind, 'n', rule.level))")
    return let("hits", matching, f"if(size(hits) = 0, {NO_SPANS}, {let('rules', table, f'flatten(transform(hits, i -> {let("rule", "rules[i]", spans)}))')})")


def _kept(spans: str, levels: int) -> str:
    """SQL: the spans that lie in none of higher priority, nor in a longer one of the same, nor in the place of an earlier rule."""
    ordered = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'less', -s.end, 'rank', s.rank, 'end', s.end, 'level', s.n, 'kind', s.kind)))"
    ends = f"transform(sequence(0, {levels - 1}), l -> if(e.level <= l, e.end, -1))"
    return f"transform(filter({running(ordered, f'array_repeat(-1, {levels})', ends, 'zip_with({x}, {y}, (p, q) -> greatest(p, q))')}, r -> r.before[r.e.level] < r.e.end), r -> r.e)"


def _phrase(i: int, phrase: str, words: Column, n_words: Column) -> list[Column]:
    """Of a phrase in ``words`` (the words with single spaces around each): number of places, first and last place, or nulls."""
    pieces = F.when(words.isNotNull(), F.split(words, f" {phrase}(?= )"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    n = F.when(F.size(pieces) > 1, F.size(pieces) - 1)
    first = F.when(n.isNotNull(), spaces(F.element_at(pieces, 1)))
    last = F.when(n.isNotNull(), n_words - (spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split()))
    return [n.cast("long").alias(f"n{i}"), first.cast("long").alias(f"first{i}"), last.cast("long").alias(f"last{i}")]


def find_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs`` (doc_id, text).

    Phrases are counted in all their places; labels are distinct, sorted and comma-joined; score is the highest
    priority of a kept detection, in hundredths, at least 0.5 with a phrase, else 0.  A null or empty text has
    no words, nulls for the places, empty labels and score 0; a null doc_id stays null; repeated rows give a row
    each; an empty table gives none; other columns are ignored.  Everything is computed within the row.
    """
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.col("low")
    any_of = lambda tests: reduce(Column.__or__, tests, F.lit(False))
    # the prefilters are searches for plain strings, first for parts that many keywords share; what has none of them is not matched against anything
    words_in = lambda k: reduce(Column.__and__, [low.contains(w) for w in sorted(k.split(), key=len, reverse=True)])  # noqa: E731  (what does not print may stand between them)
    by_keyword: dict[str, set[str]] = {}
    for r in rules:
        by_keyword.setdefault(r.keyword, set()).update(r.also or ("",))
    gate = any_of([words_in(k) & any_of([words_in(a) for a in sorted(also)]) if "" not in also else words_in(k) for k, also in sorted(by_keyword.items())])
    first = {k for r in rules for k in (r.also if r.keyword == "by" else (r.keyword,))}
    first = {next((s for s in STEMS if s in k), k) for k in first}
    gate = any_of([words_in(k) for k in sorted(first)]) & gate
    phrase_gate = any_of([words_in(p) for p in PHRASES])
    wordly = F.col("wordly")
    counted = docs.select("doc_id", F.translate(F.replace(text, F.lit(SIGN), F.lit("(c)")), UPPER, LOWER).alias("low"), F.trim(F.translate(text, _ASCII, _WORDLY)).alias("wordly")).select(
        "doc_id",
        F.when(wordly == "", 0).otherwise(F.size(F.split(wordly, " +"))).cast("long").alias("n_words"),
        F.when(phrase_gate, F.concat(F.lit(" "), F.regexp_replace(wordly, " +", " "), F.lit(" "))).alias("words"),
        F.when(gate, F.regexp_replace(low, UNSEEN, " ")).alias("seen"),
    )
    columns = [c for i, p in enumerate(PHRASES) for c in _phrase(i, p, F.col("words"), F.col("n_words"))]
    levels = len({r.priority for r in rules})
    found = counted.select("doc_id", "n_words", *columns, F.expr(f"if(seen is null, {NO_SPANS}, {_detections(rules, 'seen')})").alias("found"))
    kept = found.withColumn("kept", F.expr(f"if(size(found) < 2, transform(found, s -> named_struct('start', s.start, 'less', -s.end, 'rank', s.rank, 'end', s.end, 'level', s.n, 'kind', s.kind)), {_kept('found', levels)})"))
    ids = range(len(PHRASES))
    n_base = sum((F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in ids), F.lit(0)).cast("long")
    base = F.filter(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    priorities = ", ".join(str(p) for p in sorted({r.priority for r in rules}, reverse=True))
    best = F.expr(f"if(size(kept) = 0, 0, element_at(array({priorities}), array_min(transform(kept, s -> s.level)) + 1))") / 100.0
    return kept.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*[F.col(f"first{i}") for i in ids]).alias("first_word"),
        F.greatest(*[F.col(f"last{i}") for i in ids]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.expr("transform(kept, s -> s.kind)"))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(best, F.when(n_base > 0, F.lit(0.5)).otherwise(F.lit(0.0)))).cast("double").alias("score"),
    )
