"""Known licence sentences, licence names and the ordered rules over them, as data and as rules that make data.

A star stands for a few words that differ from text to text, such as a holder's name.
"""

from __future__ import annotations

# Sentences of published licences and licence notices, by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit-0-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies"),
    ("mit-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-warranty", "The software is provided as is, without warranty of any kind"),
    ("mit-liability", "In no event shall * be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("x11-endorse", "Except as contained in this notice, the name of * shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from *"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", "The software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc-liability", "In no event shall * be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"),
    ("hpnd-grant", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation *"),
    ("postgresql-grant", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-grant", "Redistribution and use in source and binary forms of the software as well as documentation, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-clear-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-endorse", "Neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "Neither the names of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "Neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "The names of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-warranty", "This software is provided by * as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "In no event shall * be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services"),
    ("apache-2-comply", "You may not use this file except in compliance with the License"),
    ("apache-2-comply", "You may not use these files except in compliance with the License"),
    ("apache-2-comply", "You may not use this work except in compliance with the License"),
    ("apache-2-copy", "You may obtain a copy of the License at"),
    ("apache-2-asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mpl-2-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("epl-2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at"),
    ("epl-1-ref", "All rights reserved This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("epl-1-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("cddl-ref", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License)"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("zlib-warranty", "This software is provided as-is, without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "The origin of this software must not be misrepresented"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("unlicense-release", "This is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc0-waiver", "To the extent possible under law, * has waived all copyright and related or neighboring rights to *"),
    ("cc0-dedication", "This * is dedicated to the public domain under CC0"),
    ("public-domain", "This * is hereby placed in the public domain"),
    ("public-domain", "This * is in the public domain"),
    ("public-domain", "This * has been placed in the public domain"),
    ("gnu-warranty", "This * is distributed in the hope that it will be useful, but without any warranty"),
    ("gnu-implied", "Without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("title MIT", "MIT License"),
    ("title MIT", "The MIT License"),
    ("title MIT", "The MIT License (MIT)"),
    ("title ISC", "ISC License"),
    ("title BSD-2-Clause", "BSD 2-Clause License"),
    ("title BSD-3-Clause", "BSD 3-Clause License"),
    ("title Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("title MPL-2.0", "Mozilla Public License Version 2.0"),
    ("title BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("title CC0-1.0", "CC0 1.0 Universal"),
    ("title CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("title GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("title GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("title LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("title LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("title AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("title Python-2.0", "Python Software Foundation License Version 2"),
]
#: Titles that name a licence by themselves; the others only head a text that has its own sentences.
TITLED = ("Apache-2.0", "MPL-2.0", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Python-2.0")

GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "LGPL ": "GNU Library General Public License", "AGPL": "GNU Affero General Public License"}
VERSIONS = {"1": "1.0", "2": "2.0", "2.0": "2.0", "2.1": "2.1", "3": "3.0", "3.0": "3.0"}


def gnu_sentences() -> list[tuple[str, str]]:
    """The sentences of the usual notices, for each licence of the family and each version."""
    out = []
    for code, name in GNU.items():
        code, terms = code.strip(), f"You can redistribute it and/or modify it under the terms of the {name}"
        out += [(f"gnu-terms {code}", f"{terms} as published by the Free Software Foundation"), (f"gnu-more {code}", f"See the {name} for more details"), (f"gnu-more {code}", f"You should have received a copy of the {name} along with this program")]
        for written, version in VERSIONS.items():
            out += [
                (f"gnu-later {code}-{version}", f"{terms} as published by the Free Software Foundation, either version {written} of the License, or (at your option) any later version"),
                (f"gnu-later {code}-{version}", f"{terms}, version {written} or later, as published by the Free Software Foundation"),
                (f"gnu-only {code}-{version}", f"{terms} version {written} as published by the Free Software Foundation"),
                (f"gnu-only {code}-{version}", f"{terms}, version {written} only, as published by the Free Software Foundation"),
                (f"gnu-only {code}-{version}", f"{terms} as published by the Free Software Foundation, version {written}"),
                (f"gnu-only {code}-{version}", f"{terms} as published by the Free Software Foundation, version {written} of the License"),
            ]
    for written, version in VERSIONS.items():
        out += [(f"gnu-either {version}", f"Either version {written} of the License, or (at your option) any later version"), (f"gnu-version {version}", f"Version {written} of the License"), (f"gnu-version {version}", f"Version {written}")]
    return out


def names() -> dict[str, str]:
    """Licence names as references give them (without license, version and the like) -> identifier."""
    # Common names of licences.
    out = dict(line.rsplit(" = ", 1) for line in """mit = MIT|expat = MIT|mit expat = MIT|x11 = X11|isc = ISC|zlib = Zlib|zlib libpng = Zlib|unlicense = Unlicense|wtfpl = WTFPL|0bsd = 0BSD|mit 0 = MIT-0|postgresql = PostgreSQL
apache 2 0 = Apache-2.0|apache 2 = Apache-2.0|apache software 2 0 = Apache-2.0|asl 2 0 = Apache-2.0|apache 1 1 = Apache-1.1|bsd = BSD|bsd 3 clause = BSD-3-Clause|3 clause bsd = BSD-3-Clause|new bsd = BSD-3-Clause|modified bsd = BSD-3-Clause|revised bsd = BSD-3-Clause|bsd 3 = BSD-3-Clause
bsd 2 clause = BSD-2-Clause|2 clause bsd = BSD-2-Clause|simplified bsd = BSD-2-Clause|freebsd = BSD-2-Clause|bsd 4 clause = BSD-4-Clause|boost software 1 0 = BSL-1.0|boost 1 0 = BSL-1.0|boost software = BSL-1.0|mozilla public 2 0 = MPL-2.0|mpl 2 0 = MPL-2.0|mozilla public 1 1 = MPL-1.1|mpl 1 1 = MPL-1.1
eclipse public 2 0 = EPL-2.0|epl 2 0 = EPL-2.0|eclipse public 1 0 = EPL-1.0|epl 1 0 = EPL-1.0|artistic 2 0 = Artistic-2.0|artistic = Artistic-1.0|python software foundation = PSF-2.0|psf = PSF-2.0|cc0 = CC0-1.0|cc0 1 0 = CC0-1.0|cc0 1 0 universal = CC0-1.0|creative commons zero = CC0-1.0|european union public 1 2 = EUPL-1.2|eupl 1 2 = EUPL-1.2|common development and distribution = CDDL-1.0|cddl 1 0 = CDDL-1.0|open database = ODbL-1.0|odbl = ODbL-1.0|sil open font 1 1 = OFL-1.1""".replace("\n", "|").split("|"))
    words = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        long = " ".join(words[w] for w in kind.split())
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            code, v = f"CC-{kind.upper().replace(' ', '-')}-{version}", version.replace(".", " ")
            for form in (f"cc {kind} {v}", f"creative commons {kind} {v}", f"creative commons {long} {v}", f"cc {long} {v}"):
                out[form] = code
                out[form.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")] = code
    for code, name in GNU.items():
        short = code.strip().lower()
        long = name.lower().replace(" license", "")
        for written, version in VERSIONS.items():
            v = written.replace(".", " ")
            for form in (f"{long} {v}", f"{long.removeprefix('gnu ')} {v}", f"gnu {short} {v}", f"{short} {v}", f"{short}{v}", f"gnu {short}{v}"):
                out[form] = f"{code.strip()}-{version}"
        for form in (long, f"gnu {short}", short):
            out[form] = code.strip()
    return out


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """(licence, the identifiers that make it, in this order), in the order in which they are tried."""
    out: list[tuple[str, tuple[str, ...]]] = [
        ("Apache-2.0", ("ref Apache-2.0", "apache-2-comply", "apache-2-copy", "apache-2-asis", "apache-2-see")),
        ("Apache-2.0", ("ref Apache-2.0", "apache-2-comply")),
        ("Apache-2.0", ("title Apache-2.0", "apache-2-asis")),
        ("X11", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability", "x11-endorse")),
        ("MIT", ("title MIT", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
        ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
        ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
        ("MIT", ("mit-grant", "mit-notice")),
        ("MIT-0", ("mit-0-grant", "mit-warranty", "mit-liability")),
        ("MIT-0", ("mit-0-grant",)),
        ("ISC", ("title ISC", "isc-grant", "isc-warranty", "isc-liability")),
        ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
        ("ISC", ("isc-grant",)),
        ("0BSD", ("0bsd-grant", "isc-warranty", "isc-liability")),
        ("0BSD", ("0bsd-grant",)),
        ("HPND", ("hpnd-grant",)),
        ("PostgreSQL", ("postgresql-grant",)),
        ("BSD-3-Clause-Clear", ("bsd-clear-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ]
    for heads in (("title BSD-3-Clause",), ("title BSD-2-Clause",), ()):
        for ends in (("bsd-warranty", "bsd-liability"), ("bsd-warranty",), ()):
            out += [
                ("BSD-4-Clause", (*heads, "bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", *ends)),
                ("BSD-3-Clause", (*heads, "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", *ends)),
                ("BSD-2-Clause", (*heads, "bsd-grant", "bsd-source", "bsd-binary", *ends)),
            ]
    out += [
        ("Zlib", ("zlib-warranty", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
        ("Zlib", ("zlib-grant", "zlib-origin")),
        ("BSL-1.0", ("title BSL-1.0", "boost-grant")),
        ("BSL-1.0", ("boost-grant",)),
        ("Unlicense", ("unlicense-release", "unlicense-grant")),
        ("Unlicense", ("unlicense-release",)),
        ("CC0-1.0", ("cc0-waiver",)),
        ("CC0-1.0", ("cc0-dedication",)),
        ("MPL-2.0", ("mpl-2-ref", "mpl-2-copy")),
        ("MPL-2.0", ("mpl-2-ref",)),
        ("EPL-2.0", ("epl-2-ref",)),
        ("EPL-1.0", ("epl-1-ref",)),
        ("CDDL-1.0", ("cddl-ref",)),
        ("public-domain", ("public-domain",)),
    ]
    for code in dict.fromkeys(c.strip() for c in GNU):
        ends = ("gnu-warranty", "gnu-implied", f"gnu-more {code}", f"gnu-more {code}")
        for version in dict.fromkeys(VERSIONS.values()):
            for cut in (4, 3, 2, 0):
                out += [
                    (f"{code}-{version}-or-later", (f"gnu-later {code}-{version}", *ends[:cut])),
                    (f"{code}-{version}-or-later", (f"gnu-terms {code}", f"gnu-either {version}", *ends[:cut])),
                    (f"{code}-{version}-only", (f"gnu-only {code}-{version}", *ends[:cut])),
                    (f"{code}-{version}-only", (f"gnu-terms {code}", f"gnu-version {version}", *ends[:cut])),
                ]
    out += [(code, (f"title {code}",)) for code in TITLED]
    return out
