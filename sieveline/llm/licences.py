"""Licence scans: Aho-Corasick for identifier tags and notice phrases, shunting-yard for expressions.

One automaton over lower-case words finds notice phrases ("apache license version 2 0") and the SPDX
identifier tag; of overlapping hits the leftmost longest counts. Phrases are names with versions, the
headers of files ("as published by the Free Software Foundation, either version 3 ...") and passages of full
texts; of BSD texts, which contain each other, the longest counts. The expression after a tag is
parsed by Dijkstra's shunting-yard algorithm (WITH binds tighter than AND, AND than OR; ids are
case-insensitive; "+" means or later) and evaluated to a class: a choice (OR) is as free as its freest
side, a conjunction (AND) as strict as its strictest, and a known exception (WITH) makes copyleft
weak. An expression ends where it stops parsing ("MIT in this file"); what it took up is not looked at again. All
findings of a document hold together, so its class is the strictest. Identifiers are those of the public SPDX list
that are in use; families of licences (GNU, CC, BSD, Mozilla ...) are also found by their short ids ("gpl-3.0") in
running text, others, whose ids are names of products, before the word "license" only.

One pass, no shuffle; only the identifier, licence and class columns leave the worker.

Defined cases: null, empty and licence-free texts give class ``none`` and no expression; a malformed
expression or unknown id gives class ``unknown``, the strictest; a licence found again counts once in
``licences`` and each time in ``hits``; of phrases that tie (same place and length) there is one only, since no phrase
belongs to two licences; rows that repeat are each judged; texts are read whole whatever their length; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, lowered, read, string_buffer
from .decontam import squeeze

CLASSES = ("none", "public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "restricted", "proprietary", "unknown")
_LEVEL = {c: i for i, c in enumerate(CLASSES)}

LICENCES = {
    "public-domain": "CC0-1.0 Unlicense 0BSD PDDL-1.0 CC-PDDC blessing SAX-PD ANTLR-PD NIST-PD NLPL libselinux-1.0",
    "permissive": """MIT MIT-0 MIT-CMU MIT-Modern-Variant MIT-advertising MIT-enna MIT-feh MIT-open-group MITNFA Apache-1.0 Apache-1.1 Apache-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution
BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Nuclear-License BSD-3-Clause-No-Nuclear-Warranty BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-Shortened BSD-4-Clause-UC BSD-Source-Code LicenseRef-BSD ISC Zlib zlib-acknowledgement BSL-1.0
PSF-2.0 Python-2.0 Python-2.0.1 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0 PostgreSQL X11 X11-distribute-modifications-variant NCSA WTFPL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AML AMPAS AAL ADSL APAFML Abstyles Adobe-2006 Adobe-Glyph Afmparse
Bahyph Barr Beerware BitTorrent-1.0 BitTorrent-1.1 BlueOak-1.0.0 Borceux CECILL-B CNRI-Jython CNRI-Python CNRI-Python-GPL-Compatible Caldera ClArtistic Condor-1.1 Crossword CrystalStacker Cube curl DOC DSDP Dotseqn dvipdfm ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 Entessa Eurosym
FSFAP FSFUL FSFULLR FTL Fair Giftware Glulxe HPND HPND-sell-variant HaskellReport IBM-pibs ICU IJG ImageMagick Imlib2 Info-ZIP Intel Intel-ACPI JasPer-2.0 JSON Jam Leptonica Libpng libpng-2.0 libtiff Linux-OpenIB MTLL MakeIndex MirOS MS-PL MulanPSL-1.0 MulanPSL-2.0 Multics Mup
NAIST-2003 NBPL-1.0 NLOD-1.0 NRL NTP NTP-0 Naumen Net-SNMP NetCDF Newsletr Noweb OFL-1.1-RFN OGC-1.0 OLDAP-2.0 OLDAP-2.1 OLDAP-2.2 OLDAP-2.3 OLDAP-2.4 OLDAP-2.5 OLDAP-2.6 OLDAP-2.7 OLDAP-2.8 OML OpenSSL PHP-3.0 PHP-3.01 Plexus psfrag psutils Qhull RSA-MD Rdisc Ruby
SCEA SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SHL-0.5 SHL-0.51 SMLNJ SNIA SSH-OpenSSH SSH-short SWL Saxpath Sendmail Spencer-86 Spencer-94 Spencer-99 StandardML-NJ TCL TCP-wrappers TOSL TU-Berlin-1.0 TU-Berlin-2.0 UPL-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unicode-TOU VSL-1.0
W3C W3C-19980720 W3C-20150513 Wsuipa XFree86-1.1 XSkat Xerox Xnet ZPL-1.1 ZPL-2.0 ZPL-2.1 Zed Zend-2.0 Zimbra-1.3 Zimbra-1.4 bzip2-1.0.6 eGenix etalab-2.0 gnuplot iMatix OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0 ODC-By-1.0""",
    "weak-copyleft": """MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 IPL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 OFL-1.0 OFL-1.1 MS-RL ErlPL-1.1 NPL-1.0 NPL-1.1 SPL-1.0 Nokia CUA-OPL-1.0 LPL-1.0 LPL-1.02
LGPLLR LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c Motosoto EUDatagrid gSOAP-1.3b Interbase-1.0 YPL-1.0 YPL-1.1 ODbL-1.0 CATOSL-1.1 CECILL-C OSET-PL-2.1 SISSL SISSL-1.2 Watcom-1.0 RPSL-1.0 RHeCos-1.1 wxWindows NASA-1.3 OCLC-2.0 OPL-1.0 UCL-1.0 LiLiQ-R-1.1 FreeImage Frameworx-1.0 CDLA-Sharing-1.0 HPL""",
    "copyleft": "EUPL-1.0 EUPL-1.1 EUPL-1.2 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 QPL-1.0 Sleepycat SimPL-2.0 OGTSL LiLiQ-Rplus-1.1 TMate Vim BSD-Protection copyleft-next-0.3.0 copyleft-next-0.3.1 TAPR-OHL-1.0 CERN-OHL-S-2.0 LAL-1.2 LAL-1.3",
    "network-copyleft": "SSPL-1.0 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 RPL-1.1 RPL-1.5 CPAL-1.0 Parity-6.0.0 Parity-7.0.0 NPOSL-3.0 APL-1.0",
    "restricted": "BUSL-1.1 Elastic-2.0 Hippocratic-2.1 Aladdin NCGL-UK-2.0 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 CAL-1.0 Crystal-NC",
    "proprietary": "LicenseRef-All-Rights-Reserved LicenseRef-Proprietary",
}
for _f, _c in (("", "permissive"), ("-SA", "weak-copyleft"), ("-NC", "restricted"), ("-NC-SA", "restricted"), ("-NC-ND", "restricted"), ("-ND", "restricted")):
    LICENCES[_c] += "".join(f" CC-BY{_f}-{v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0"))
#: Families of the GNU project: versions, each only or any later one.
GNU = {"GPL": ("copyleft", ("1.0", "2.0", "3.0")), "LGPL": ("weak-copyleft", ("2.0", "2.1", "3.0")), "AGPL": ("network-copyleft", ("1.0", "3.0")), "GFDL": ("copyleft", ("1.1", "1.2", "1.3"))}
for _f, (_c, _vs) in GNU.items():
    LICENCES[_c] += "".join(f" {_f}-{v}-only {_f}-{v}-or-later" for v in _vs)
CLASS_OF = {i.lower(): (i, c) for c, ids in LICENCES.items() for i in ids.split()}
#: Older names of the same licences.
ALIASES = {f"{f}-{v}".lower(): f"{f}-{v}-only".lower() for f, (_, vs) in GNU.items() for v in vs} | {"bsd": "licenseref-bsd", "bsd-2-clause-freebsd": "bsd-2-clause-views", "bsd-2-clause-netbsd": "bsd-2-clause", "apache2": "apache-2.0", "apache-2": "apache-2.0", "expat": "mit"}
EXCEPTIONS = {
    e.lower(): e
    for e in """389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception CLISP-exception-2.0 Classpath-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 FLTK-exception Fawkes-Runtime-exception Font-exception-2.0 freertos-exception-2.0
GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception GPL-3.0-linking-source-exception GPL-CC-1.0 GStreamer-exception-2005 GStreamer-exception-2008 i2p-gpl-java-exception KiCad-libraries-exception LGPL-3.0-linking-exception Libtool-exception
Linux-syscall-note LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0 openvpn-openssl-exception OpenSSL-exception PS-or-PDF-font-exception-20170817 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1
Qwt-exception-1.0 SHL-2.0 SHL-2.1 Swift-exception Texinfo-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 vsftpd-openssl-exception WxWindows-exception-3.1 x11vnc-openssl-exception""".split()
}

TAG = "spdx license identifier"
PHRASES = {
    "LicenseRef-All-Rights-Reserved": ["all rights reserved"],
    "LicenseRef-Proprietary": ["proprietary and confidential", "unauthorized copying of this file"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache org licenses license 2 0"],
    "MIT": ["mit license", "permission is hereby granted free of charge to any person obtaining a copy"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gplv2"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gplv3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or any later version", "gnu general public license version 3 or later"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or any later version", "gnu general public license version 2 or later"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgplv2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgplv3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd license", "three clause bsd license"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd license", "simplified bsd license"],
    "ISC": ["isc license"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero", "creative commons cc0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "CC-BY-SA-3.0": ["cc by sa 3 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0"],
    "CC-BY-ND-4.0": ["cc by nd 4 0"],
    "BSL-1.0": ["boost software license version 1 0"],
    "BUSL-1.1": ["business source license 1 1"],
    "SSPL-1.0": ["server side public license"],
    "EUPL-1.2": ["european union public licence v 1 2"],
    "OFL-1.1": ["sil open font license version 1 1"],
    "WTFPL": ["do what the fuck you want to public license"],
}
#: Notices of files and full texts, in words.
NOTICES = {
    "Apache-1.1": ["apache software license version 1 1", "apache license version 1 1"],
    "Apache-2.0": ["apache license v2 0", "apache license v 2 0", "apache software license version 2 0", "apache software license 2 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license v 1 1", "mozilla public license v1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mozilla public license v 2 0", "mozilla public license v2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v 1 0", "eclipse public license v1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license v 2 0", "eclipse public license 2 0"],
    "CDDL-1.0": ["common development and distribution license", "common development and distribution license cddl version 1 0", "common development and distribution license version 1 0", "cddl version 1 0"],
    "CDDL-1.1": ["common development and distribution license cddl version 1 1", "common development and distribution license version 1 1", "cddl version 1 1"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"],
    "0BSD": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "bsd zero clause license", "zero clause bsd license"],
    "MIT-0": ["mit no attribution", "mit 0 license"],
    "Zlib": ["zlib license", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "BSL-1.0": ["boost software license 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "NCSA": ["university of illinois ncsa open source license", "ncsa open source license"],
    "X11": ["x11 license"],
    "PostgreSQL": ["postgresql license", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "PSF-2.0": ["psf license agreement", "psf license version 2", "python software foundation license version 2"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "Python-2.0": ["python license 2 0"],
    "OSL-3.0": ["open software license version 3 0", "open software license v 3 0", "open software license 3 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public licence v1 2", "eupl version 1 2", "eupl v1 2"],
    "BSD-3-Clause": ["new bsd license", "modified bsd license"],
    "BSD-4-Clause": ["bsd 4 clause", "4 clause bsd license", "original bsd license"],
    "GFDL-1.3-or-later": ["gnu free documentation license version 1 3 or any later version"],
    "GFDL-1.3-only": ["gnu free documentation license version 1 3", "gnu free documentation license v1 3"],
    "OFL-1.1": ["sil open font license 1 1", "sil ofl 1 1"],
    "BUSL-1.1": ["business source license version 1 1"],
    "SSPL-1.0": ["server side public license version 1"],
    "CC0-1.0": ["creative commons org publicdomain zero 1 0", "creativecommons org publicdomain zero 1 0", "cc0 1 0 universal"],
}
NOTICES["LicenseRef-BSD"] = ["bsd license", "bsd licensed", "bsd style license", "bsd licence"]
for _f, _w in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by sa", "attribution share alike"), ("by nc", "attribution noncommercial"), ("by nc", "attribution non commercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"), ("by nc nd", "attribution noncommercial noderivs"), ("by nd", "attribution noderivatives"), ("by nd", "attribution noderivs")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _i, _n = f"CC-{_f.upper().replace(' ', '-')}-{_v}", _v.replace(".", " ")
        if _i.lower() in CLASS_OF:
            NOTICES.setdefault(_i, []).extend([f"cc {_f} {_n}", f"creative commons {_w} {_n}", f"creative commons {_w} {_n} international", f"creative commons {_w} {_n} unported", f"creativecommons org licenses {_f} {_n}"])


def gnu() -> dict[str, list[str]]:
    """Notices of the GPL, LGPL and AGPL: file headers as published, the version before or after the name,
    and short forms; "or any later version" makes another licence."""
    out: dict[str, list[str]] = {}
    names = {"GPL": ["general"], "LGPL": ["lesser general", "library general"], "AGPL": ["affero general"], "GFDL": ["free documentation"]}
    fsf = "as published by the free software foundation"
    later = ("or any later version", "or at your option any later version", "or later", "or newer", "or higher", "or above")
    for f, (_, vs) in GNU.items():
        low = f.lower()
        end = "license" if f == "GFDL" else "public license"
        full = [f"gnu {n} {end}" for n in names[f]] + [f"{n} {end}" for n in names[f] if f not in ("GPL", "GFDL")]
        for v in vs:
            only, more = [], []
            for n in {v.replace(".", " "), v.removesuffix(".0").replace(".", " ")}:
                for name in [low, f"gnu {low}", *full, *[f"{x} {low}" for x in full]]:
                    only += [f"{name} {g}{n}" for g in ("version ", "v", "v ", "")]
                only += [f"{low}v{n}", f"gnu {low}v{n}"]
                for x in full:
                    only += [f"{x} {g}version {n}{end}" for g in ("", "either ", "only ", f"{fsf} ", f"{fsf} either ", f"{fsf} only ") for end in ("", " of the license")]
                    only += [f"{x} version {n} {fsf}", f"version {n} of the {x}", f"version {n} of the {x} {fsf}"]
                    more += [f"version {n} {y} of the {x}" for y in later]
            out[f"{f}-{v}-only"] = only + [f"{low} {v.replace('.', ' ')} only"]
            out[f"{f}-{v}-or-later"] = more + [f"{x} {y}" for x in only for y in later]
    return out


#: Full texts of the BSD family: each holds the opening and the clauses of the shorter ones; the longest counts.
BSD_TEXTS = {
    "redistribution and use in source and binary forms": (0, "BSD-2-Clause"),
    "may be used to endorse or promote products derived from this software without specific prior written permission": (1, "BSD-3-Clause"),
    "may be used to endorse or promote products derived from this software without prior written permission": (1, "BSD-3-Clause"),
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": (2, "BSD-4-Clause"),
}
#: Beginnings of ids that are names of licences alone.
_PLAIN = ("apache ", "mpl ", "epl ", "cddl ", "bsd ", "eupl ", "osl ", "afl ", "busl ", "sspl ", "ofl ", "ecl ", "upl ", "cpl ", "lppl ", "cecill ", "cc ", "artistic ", "apsl ", "odbl ", "polyform ", "npl ", "cpal ", "ms pl", "ms rl")


def ids() -> dict[str, list[str]]:
    """Each licence by its own id: as it stands if it can only be a licence, else before "license"."""
    out = {}
    for low, (i, _) in CLASS_OF.items():
        words = re.sub("[^a-z0-9]+", " ", low).strip()
        if low.startswith("licenseref") or any(low.startswith(f"{f.lower()}-") for f in GNU):
            continue
        out[i] = [f"{words} license", f"{words} licence"] + ([words] if f"{words} ".startswith(_PLAIN) and re.search("[0-9]|clause", words) else [])
    return out


for _more in (NOTICES, gnu(), *({i: [p]} for p, (_, i) in BSD_TEXTS.items())):
    for _i, _p in _more.items():
        PHRASES[_i] = list(dict.fromkeys([*PHRASES.get(_i, []), *_p]))
_SAID = {p for ps in PHRASES.values() for p in ps}
for _i, _p in ids().items():
    PHRASES[_i] = [*PHRASES.get(_i, []), *[p for p in _p if p not in _SAID]]
    _SAID.update(_p)

_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.:\-]+\+?)")
_RANK = {"or": 1, "and": 2, "with": 3}
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*+([^\n\r]*+)")


class Malformed(ValueError):
    """An expression that does not parse."""


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Malformed(text)
        out.append(m[1])
        at = m.end()
    return out


def postfix(text: str) -> list[str]:
    """Shunting-yard: operands and operators (lower case) in postfix order."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for t in tokens(text):
        op = t.lower()
        if op in _RANK:
            if operand:
                raise Malformed(text)
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif t == "(":
            if not operand:
                raise Malformed(text)
            held.append(t)
        elif t == ")":
            if operand:
                raise Malformed(text)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise Malformed(text)
            held.pop()
        else:
            if not operand:
                raise Malformed(text)
            out.append(t)
            operand = False
    if operand or "(" in held:
        raise Malformed(text)
    return out + held[::-1]


def leading(text: str) -> tuple[str, int]:
    """The expression that a text begins with, up to where it stops parsing, and its length."""
    at, end, depth, operand = 0, 0, 0, True
    while m := _TOKEN.match(text, at):
        t = m[1].lower()
        if t in _RANK or t == ")":
            if operand or t == ")" and not depth:
                break
            depth -= t == ")"
            operand = t != ")"
        elif not operand:
            break
        else:
            depth += t == "("
            operand = t == "("
        at = end = m.end()
    return text[:end].strip(), end


def licence(name: str) -> tuple[str, int]:
    """(canonical id, level) of one id."""
    low = name.lower()
    later = low.endswith("+")
    low = low.rstrip("+")
    low = ALIASES.get(low, low)
    if later and low.endswith("-only"):
        low = low[:-5] + "-or-later"
    if low in CLASS_OF:
        i, c = CLASS_OF[low]
        return i, _LEVEL[c]
    return name, _LEVEL["unknown"]


def evaluate(text: str) -> tuple[str, int, list[str]]:
    """(canonical expression, level, ids) of an expression."""
    held: list[tuple[str, int, int, list[str]]] = []  # text, level, rank of its last operator, ids
    for t in postfix(text):
        if t not in _RANK:
            i, level = licence(t)
            held.append((i, level, 9, [i]))
            continue
        b, a = held.pop(), held.pop()
        if t == "with":
            if a[2] != 9 or b[2] != 9:
                raise Malformed(text)
            known = EXCEPTIONS.get(b[3][0].lower())
            level = _LEVEL["unknown"] if not known else min(a[1], _LEVEL["weak-copyleft"]) if a[1] == _LEVEL["copyleft"] else a[1]
            held.append((f"{a[0]} WITH {known or b[0]}", level, 3, a[3]))
        else:
            wrap = lambda x: f"({x[0]})" if x[2] < _RANK[t] else x[0]
            held.append((f"{wrap(a)} {t.upper()} {wrap(b)}", (max if t == "and" else min)(a[1], b[1]), _RANK[t], a[3] + b[3]))
    x = held.pop()
    return x[0], x[1], x[3]


def automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for i, phrases in PHRASES.items():
        for p in phrases:
            auto.add_word(f" {p} ", (len(p), BSD_TEXTS.get(p, i)))
    auto.add_word(f" {TAG} ", (len(TAG), None))
    auto.make_automaton()
    return auto


_AUTO = None


def phrases(off: np.ndarray, data: np.ndarray) -> dict[int, list]:
    """What the automaton finds in consecutive lowered texts: of overlapping hits the leftmost longest."""
    global _AUTO
    if _AUTO is None:
        _AUTO = automaton()
    at, s = squeeze(off, data)
    s = " " + s.replace("\n", " \n ")
    at = at + 2 * np.arange(len(at)) + 1
    ends = [(e - k, e, i) for e, (k, i) in _AUTO.iter(s)]
    ends.sort(key=lambda x: (x[0], -x[1]))
    found: dict[int, list] = {}
    last = -1
    docs = np.searchsorted(at, np.array([x[0] for x in ends], np.int64), "right") - 1 if ends else []
    for (b, e, i), d in zip(ends, docs):
        if b < last:
            continue
        last = e - 1
        found.setdefault(int(d), []).append(i)
    return found


def scan(off: np.ndarray, data: np.ndarray) -> list[list]:
    """licences, expression, class and hits of consecutive lowered texts."""
    n = len(off) - 1
    names, text, cls, hits = [""] * n, [None] * n, ["none"] * n, np.zeros(n, np.int32)
    for d, got in phrases(off, data).items():
        terms, ids, level, count, tags = [], [], 0, 0, []
        if None in got:
            # expressions are taken out, the rest is scanned again
            body, out, last = data[off[d] : off[d + 1]].tobytes().decode(), [], 0
            for m in _TAG_LINE.finditer(body):
                x, size = leading(re.sub(r"\*/.*|-->.*|[\"';#].*", "", m[1]))
                tags.append(x)
                out.append(body[last : m.start()])
                last = m.start(1) + size
            rest = np.frombuffer(("\x1f ".join([*out, body[last:]])).encode(), np.uint8)
            got = phrases(np.array([0, len(rest)]), rest).get(0, [])
        text_of = max((i for i in got if isinstance(i, tuple)), default=None)
        for i in got:
            if isinstance(i, tuple):
                if i != text_of:
                    continue
                i = i[1]
            if i is not None:
                count += 1
                terms.append(i)
                ids.append(i)
                level = max(level, licence(i)[1])
        for x in tags:
            count += 1
            try:
                x, k, more = evaluate(x)
                terms.append(f"({x})" if " OR " in x else x)
                ids += more
            except Malformed:
                k = _LEVEL["unknown"]
            level = max(level, k)
        names[d] = ";".join(sorted(set(ids)))
        text[d] = " AND ".join(dict.fromkeys(terms)) or None
        if text[d] and len(set(terms)) == 1:
            text[d] = text[d].removeprefix("(").removesuffix(")") if text[d].startswith("(") and text[d].count("(") == 1 else text[d]
        cls[d] = CLASSES[level]
        hits[d] = count
    return [names, text, cls, hits]


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, expression, class, hits) of every document."""
    names = ["doc_id", "licences", "expression", "class", "hits"]

    def run(batches):
        for b in batches:
            off, data = string_buffer(b.column(1))
            for i, j in chunks(off):
                got = scan(off[i : j + 1], data)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(x, k) for x, k in zip(got, (pa.string(), pa.string(), pa.string(), pa.int32()))]], names=names)

    given = docs.select("doc_id", lowered(F.col("text")).alias("low"))
    return given.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licences string, expression string, class string, hits int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))
