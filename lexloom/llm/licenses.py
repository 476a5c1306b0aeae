"""Known licences: names, notices, tags, headers and sentences of their texts, and the ordered rules over them."""

from __future__ import annotations

import re

_OTHER, _PLUS = re.compile(r"[^a-z0-9]+"), re.compile(r"([0-9])\+")


def normalise(sentence: str) -> str:
    """a-z and 0-9 in words parted by single spaces; a plus behind a version is "or later"."""
    return _OTHER.sub(" ", _PLUS.sub(r"\1 or later ", sentence.lower())).strip()


#: SPDX identifier -> names it goes by in notices.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT", "Expat License"], "MIT-0": ["MIT No Attribution License", "MIT-0"], "ISC": ["ISC License", "ISC"], "0BSD": ["Zero-Clause BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"], "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "Apache-1.1": ["Apache Software License, Version 1.1", "Apache License 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License, v2.0", "Apache 2.0 License", "Apache Software License 2.0", "Apache-2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL-2.0"], "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GPLv2+", "GNU GPL version 2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0"], "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GPLv3+", "GNU GPL version 3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"], "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "LGPLv2.1+"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"], "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "LGPLv3+"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0"], "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "AGPLv3+"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL 1.1"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"], "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2", "EUPL, version 1.2"], "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "Zlib": ["zlib License", "zlib/libpng License"], "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal License", "CC0 1.0", "CC0"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"], "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License", "CC BY 4.0", "CC-BY 4.0 License"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"], "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"], "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"], "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
    "Artistic-2.0": ["Artistic License 2.0"], "PostgreSQL": ["PostgreSQL License"], "Python-2.0": ["Python Software Foundation License", "PSF License"], "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "MS-PL": ["Microsoft Public License"], "NCSA": ["University of Illinois/NCSA Open Source License"], "ODbL-1.0": ["Open Database License 1.0", "ODbL 1.0"], "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License 1.0"], "UPL-1.0": ["Universal Permissive License 1.0"],
}
_SUBJECTS = ["", "this work is ", "this software is ", "this project is ", "this program is ", "this file is ", "this code is ", "this repository is "]
_VERBS = ["licensed under", "released under", "distributed under", "available under", "published under"]
_ARTICLES = ["the ", "a ", ""]

_MIT = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_ISC = "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ENDORSE = "neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_FSF = "this {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}"
#: identifier -> wordings of one sentence of a text or header.
TEXTS = {
    "mit-grant": [_MIT + ", subject to the following conditions"], "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit0-grant": [_MIT], "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "isc-grant": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies", _ISC.replace("and/or", "and") + ", provided that the above copyright notice and this permission notice appear in all copies"], "0bsd-grant": [_ISC],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": [_ENDORSE.format(x) for x in ("the copyright holder nor the names of its contributors", "the copyright holder nor the names of their contributors", "the University nor the names of its contributors", "the author nor the names of its contributors", "the authors nor the names of their contributors", "the copyright owner nor the names of its contributors")],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "apache-1-acknowledge": ["The end-user documentation included with the redistribution, if any, must include the following acknowledgment"],
    "apache-2-header": ["Licensed under the Apache License, Version 2.0 (the 'License')"], "apache-2-comply": ["you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at"], "apache-2-title": ["Apache License Version 2.0, January 2004"],
    "gpl-title-2": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"], "gpl-title-3": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"], "lgpl-title-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-title-3": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"], "agpl-title-3": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "mpl-2-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"], "mpl-1.1-header": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the 'License')"],
    "epl-1-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl-2-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"],
    "cddl-header": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the 'License')"],
    "eupl-header": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the 'Licence')"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the 'Software') to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"], "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "cc0-dedicated": [f"To the extent possible under law, the author{s} {have} dedicated all copyright and related and neighboring rights to this {w} to the public domain worldwide" for s, have in (("(s)", "have"), ("s", "have"), ("", "has")) for w in ("software", "work")],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "python-parties": ["This LICENSE AGREEMENT is between the Python Software Foundation ('PSF'), and the Individual or Organization ('Licensee') accessing and otherwise using this software ('Python') in source or binary form and its associated documentation"],
    "ofl-font": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "ncsa-grant": [_MIT.replace("deal in", "deal with") + ", subject to the following conditions"],
    "all-rights": ["All rights reserved"],
}
for _short, _name, _versions in (("gpl", "General Public License", ("2", "3")), ("lgpl", "Lesser General Public License", ("2.1", "3")), ("agpl", "Affero General Public License", ("3",))):
    for _v in _versions:
        _written = [_v] if "." in _v else [_v, _v + ".0"]
        TEXTS[f"{_short}-{_v}-later"] = [_AS_FSF.format(w, _name, f"{e}version {v} of the License, or (at your option) any later version") for w in ("program", "library", "software", "file") for v in _written for e in ("either ", "")]
        TEXTS[f"{_short}-{_v}-only"] = [_AS_FSF.format(w, _name, f"version {v} of the License") for w in ("program", "library", "software", "file") for v in _written]
        TEXTS[f"{_short}-{_v}-only"] += [_AS_FSF.format(w, f"{_name}{c} version {v}", "").strip(" ,") for w in ("program", "library", "software", "file") for v in _written for c in ("", ",")]
#: Ordered: (rule, licence, identifiers that must follow one another, others between allowed).
RULES = [
    ("mit-text", "MIT", ("mit-grant", "mit-condition")), ("mit0-text", "MIT-0", ("mit0-grant",)), ("isc-text", "ISC", ("isc-grant",)), ("0bsd-text", "0BSD", ("0bsd-grant",)),
    ("apache-1-text", "Apache-1.1", ("bsd-redistribute", "bsd-source", "apache-1-acknowledge")), ("bsd-4-text", "BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-advertising")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-endorse")), ("bsd-2-text", "BSD-2-Clause", ("bsd-redistribute", "bsd-source")),
    ("apache-2-header", "Apache-2.0", ("apache-2-header", "apache-2-comply")), ("apache-2-line", "Apache-2.0", ("apache-2-header",)), ("apache-2-text", "Apache-2.0", ("apache-2-title",)),
    *((f"{s}-{v}-{w}-header", f"{s.upper()}-{v if '.' in v else v + '.0'}-{o}", (f"{s}-{v}-{w}",)) for s, v in (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")) for w, o in (("later", "or-later"), ("only", "only"))),
    ("gpl-2-text", "GPL-2.0-only", ("gpl-title-2",)), ("gpl-3-text", "GPL-3.0-only", ("gpl-title-3",)), ("lgpl-2.1-text", "LGPL-2.1-only", ("lgpl-title-2.1",)), ("lgpl-3-text", "LGPL-3.0-only", ("lgpl-title-3",)), ("agpl-3-text", "AGPL-3.0-only", ("agpl-title-3",)),
    ("mpl-2-header", "MPL-2.0", ("mpl-2-header",)), ("mpl-1.1-header", "MPL-1.1", ("mpl-1.1-header",)), ("epl-1-header", "EPL-1.0", ("epl-1-header",)), ("epl-2-header", "EPL-2.0", ("epl-2-header",)), ("cddl-header", "CDDL-1.0", ("cddl-header",)),
    ("eupl-header", "EUPL-1.2", ("eupl-header",)), ("boost-text", "BSL-1.0", ("boost-grant",)), ("unlicense-text", "Unlicense", ("unlicense-domain",)), ("zlib-text", "Zlib", ("zlib-as-is", "zlib-origin")), ("cc0-text", "CC0-1.0", ("cc0-dedicated",)),
    ("postgresql-text", "PostgreSQL", ("postgresql-grant",)), ("python-text", "Python-2.0", ("python-parties",)), ("ofl-text", "OFL-1.1", ("ofl-font",)), ("ncsa-text", "NCSA", ("ncsa-grant",)),
    *((f"{x.lower()}-notice", x, (f"{x.lower()}-notice",)) for x in NAMES), *((f"{x.lower()}-tag", x, (f"{x.lower()}-tag",)) for x in NAMES), ("mit-named", "MIT", ("mit-title",)), ("reserved", "LicenseRef-all-rights-reserved", ("all-rights",)),
]
#: Licence -> licences whose text it contains; these don't count beside it.
CONTAINS = {"BSD-3-Clause": ["BSD-2-Clause"], "BSD-4-Clause": ["BSD-2-Clause", "BSD-3-Clause"], "Apache-1.1": ["BSD-2-Clause", "BSD-3-Clause"], "OFL-1.1": []}


def known() -> dict[str, str]:
    """Sentence in normal form -> identifier; where two identifiers share one, that of the text or the first name counts."""
    out: dict[str, str] = {}
    for ident, wordings in TEXTS.items():
        for w in wordings:
            out.setdefault(normalise(w), ident)
    for spdx, names in NAMES.items():
        for name in names:
            for s in _SUBJECTS:
                for v in _VERBS:
                    for a in _ARTICLES:
                        out.setdefault(normalise(f"{s}{v} {a}{name}"), f"{spdx.lower()}-notice")
            out.setdefault(normalise(f"License: {name}"), f"{spdx.lower()}-notice")
        for tag in (spdx, spdx.removesuffix("-only")):
            out.setdefault(normalise(f"SPDX-License-Identifier: {tag}"), f"{spdx.lower()}-tag")
    return out
