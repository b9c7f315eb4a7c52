"""Licence scan by sentence rules.

Known licence sentences are found as runs of words anywhere in a text's words, so line ends, comment
signs and punctuation within them hide nothing; each is given its identifier. Licence rules are ordered sequences of identifiers; at
each place of a text's identifier sequence the first rule of the list that matches there, its sentences at most GAP words apart, is reported,
and the scan goes on behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strophe.llm import frames

#: Licence sentences in their public wording, lower-cased and without punctuation.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind express or implied", "this software is provided by the copyright holders and contributors as is"),
    "isc-ref": ("licensed under the isc license", "spdx license identifier isc"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is",),
    "zlib-ref": ("licensed under the zlib license", "spdx license identifier zlib"),
    "zlib-as-is": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost-ref": ("distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0"),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "unlicense": ("this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"),
    "apache-ref": ("licensed under the apache license version 2 0", "released under the apache license version 2 0", "spdx license identifier apache 2 0"),
    "apache-may": ("you may not use this file except in compliance with the license",),
    "apache-basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",),
    "agpl3-ref": ("licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"),
    "agpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",),
    "gpl3-ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"),
    "gpl2-ref": ("licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later"),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "version-3": ("either version 3 of the license or at your option any later version",),
    "version-2": ("either version 2 of the license or at your option any later version",),
    "version-2-1": ("either version 2 1 of the license or at your option any later version",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    "lgpl-ref": ("licensed under the gnu lesser general public license version 2 1", "licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later"),
    "lgpl-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    "bsd-redist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-ref": ("licensed under the bsd license", "released under the bsd license"),
    "bsd3-ref": ("spdx license identifier bsd 3 clause",),
    "bsd2-ref": ("spdx license identifier bsd 2 clause",),
    "mpl-ref": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"),
    "epl-ref": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "spdx license identifier epl 2 0"),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "spdx license identifier cc by sa 4 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "this work is dedicated to the public domain", "spdx license identifier cc0 1 0"),
    "reserved": ("all rights reserved",),
}
#: Ordered rules: licence name and the identifiers that stand for it in a row; longer evidence first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Zlib", ("zlib-ref",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-ref",)),
    ("Unlicense", ("unlicense",)),
    ("Apache-2.0", ("apache-ref", "apache-may", "apache-basis")),
    ("Apache-2.0", ("apache-ref", "apache-may")),
    ("Apache-2.0", ("apache-ref",)),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names", "as-is")),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "as-is")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-redist", "as-is")),
    ("BSD", ("bsd-redist",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD", ("bsd-ref",)),
    ("AGPL-3.0", ("agpl-free", "version-3", "gpl-hope")),
    ("AGPL-3.0", ("agpl-free", "version-3")),
    ("AGPL-3.0", ("agpl3-ref",)),
    ("AGPL-3.0", ("agpl-free",)),
    ("GPL-3.0", ("gpl-free", "version-3", "gpl-hope")),
    ("GPL-3.0", ("gpl-free", "version-3")),
    ("GPL-2.0", ("gpl-free", "version-2", "gpl-hope")),
    ("GPL-2.0", ("gpl-free", "version-2")),
    ("GPL", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL", ("gpl-free",)),
    ("LGPL", ("lgpl-free", "version-3", "gpl-hope")),
    ("LGPL", ("lgpl-free", "version-2-1", "gpl-hope")),
    ("LGPL", ("lgpl-free", "version-2-1")),
    ("LGPL", ("lgpl-ref",)),
    ("LGPL", ("lgpl-free",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("EPL-2.0", ("epl-ref",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC0-1.0", ("cc0",)),
    ("All-Rights-Reserved", ("reserved",)),
)
#: Further licences by SPDX identifier, with their names in sentences of the FORMS and what their own texts or notices say.
FORMS = ("spdx license identifier {id}", "licensed under the {name}", "released under the {name}", "distributed under the {name}", "under the terms of the {name}", "covered by the {name}")
NAMED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "LGPL-3.0": (("lgpl version 3",), ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",)),
    "GPL-3.0": (("gplv3",), ("the gnu general public license is a free copyleft license for software and other kinds of works",)),
    "GPL-2.0": (("gplv2",), ("the licenses for most software are designed to take away your freedom to share and change it",)),
    "AGPL-3.0": (("agplv3",), ("the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",)),
    "Apache-2.0": (("apache 2 0 license",), ("you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions",)),
    "X11": (("x11 license",), ()),
    "BSL-1.0": (("boost software license",), ()),
    "WTFPL": (("wtfpl", "do what the fuck you want to public license"), ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",)),
    "Artistic-2.0": (("artistic license 2 0", "artistic license version 2 0"), ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",)),
    "Artistic-1.0": (("artistic license 1 0",), ()),
    "EUPL-1.2": (("european union public licence version 1 2", "eupl version 1 2"), ("this european union public licence the eupl applies to the work as defined below which is provided under the terms of this licence",)),
    "EPL-1.0": (("eclipse public license v1 0", "eclipse public license version 1 0"), ()),
    "MPL-1.1": (("mozilla public license version 1 1",), ("the contents of this file are subject to the mozilla public license version 1 1",)),
    "CDDL-1.0": (("common development and distribution license",), ("the contents of this file are subject to the terms of the common development and distribution license",)),
    "MS-PL": (("microsoft public license",), ("this license governs use of the accompanying software if you use the software you accept this license",)),
    "MS-RL": (("microsoft reciprocal license",), ()),
    "OFL-1.1": (("sil open font license version 1 1", "sil open font license"), ("this font software is licensed under the sil open font license version 1 1",)),
    "PostgreSQL": (("postgresql license",), ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",)),
    "Python-2.0": (("python software foundation license", "psf license"), ()),
    "NCSA": (("university of illinois ncsa open source license",), ()),
    "OpenSSL": (("openssl license",), ()),
    "PHP-3.01": (("php license version 3 01",), ("this source file is subject to version 3 01 of the php license",)),
    "Ruby": (("ruby license",), ()),
    "LPPL-1.3c": (("latex project public license",), ("this work may be distributed and or modified under the conditions of the latex project public license",)),
    "GFDL-1.3": (("gnu free documentation license version 1 3",), ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",)),
    "ODbL-1.0": (("open database license", "odc open database license"), ("this database is made available under the open database license",)),
    "UPL-1.0": (("universal permissive license",), ()),
    "AFL-3.0": (("academic free license version 3 0",), ("licensed under the academic free license version 3 0",)),
    "OSL-3.0": (("open software license version 3 0",), ("licensed under the open software license version 3 0",)),
    "BlueOak-1.0.0": (("blue oak model license 1 0 0",), ()),
    "0BSD": (("zero clause bsd license",), ()),
}
#: The public licences of one family, by the words of their names.
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
COMMONS_VERSIONS = {"4.0": "4 0 international", "3.0": "3 0 unported", "2.0": "2 0 generic"}


def all_sentences() -> dict[str, tuple[str, ...]]:
    """SENTENCES, and those that FORMS makes of the named licences; a sentence that two have belongs to the first."""
    out, taken = dict(SENTENCES), {s for all_ in SENTENCES.values() for s in all_}

    def add(key: str, sentences: list[str]) -> None:
        new = tuple(dict.fromkeys(s for s in sentences if s not in taken))
        taken.update(new)
        out[key] = new

    for name, (names, own) in NAMED.items():
        words = re.sub(r"[^a-z0-9]+", " ", name.lower())
        add(f"name:{name}", [f.format(id=words, name=n) for f in FORMS for n in names])
        add(f"text:{name}", list(own))
    for code, words in COMMONS.items():
        for version, tail in COMMONS_VERSIONS.items():
            short = f"cc {code.lower().replace('-', ' ')} {version.replace('.', ' ')}"
            add(f"name:CC-{code}-{version}", [f"spdx license identifier {short}", f"licensed under {short}", *(f"licensed under a creative commons {words} {t}" for t in (f"{tail} license", f"{version.replace('.', ' ')} license"))])
    return {k: v for k, v in out.items() if v}


def all_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """RULES, then one for each identifier that all_sentences() adds."""
    return (*RULES, *((k.split(":", 1)[1], (k,)) for k in all_sentences() if ":" in k))


#: Words that may stand between a rule's sentences.
GAP = 200

_BREAK = re.compile(r"\n|(?<=[.;!?:])\s+")
_WORD = re.compile(r"[^\W_]+")
#: What makes an SPDX identifier longer than the known one: MIT-0 is not MIT.
_LONGER = re.compile(r"\+|-[^\W_]")


class Recogniser:
    def __init__(self, sentences: dict[str, tuple[str, ...]] | None = None, rules: tuple[tuple[str, tuple[str, ...]], ...] | None = None, gap: int = GAP):
        self.gap = gap
        known = {s: k for k, all_ in (all_sentences() if sentences is None else sentences).items() for s in all_}
        # a text without any of these words holds none of the known sentences
        self.rare, self.known = ahocorasick.Automaton(), ahocorasick.Automaton()
        for s, k in known.items():
            self.rare.add_word(max(s.split(), key=len), True)
            self.known.add_word(f" {s} ", (k, len(s), s.count(" "), s.startswith("spdx ")))
        self.rare.make_automaton()
        self.known.make_automaton()
        #: Rules by their first identifier, in order.
        self.rules: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for name, ids in all_rules() if rules is None else rules:
            self.rules.setdefault(ids[0], []).append((name, tuple(ids)))

    def identify(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, start, end, first word, last word) of the known sentences in a lower-cased text, in order; of one within another only the longer.

        One pass of an automaton over the text's words, joined by one space each.
        """
        spans = [m.span() for m in _WORD.finditer(text)]
        stream = f" {' '.join([text[a:b] for a, b in spans])} "
        found = list(self.known.iter(stream))
        if not found:
            return []
        sizes = np.array([v[1] for _, v in found])
        places = np.cumsum([0, *(b - a + 1 for a, b in spans)])  # of the space before each word
        firsts = np.searchsorted(places, np.array([end for end, _ in found]) - sizes - 1).tolist()
        hits = [(first, -(first + more), k, spdx) for first, (_, (k, _, more, spdx)) in zip(firsts, found, strict=True)]
        out, most = [], -1
        for first, last, k, spdx in sorted(hits):
            end = spans[-last][1]
            if -last > most and not (spdx and _LONGER.match(text, end)):
                out.append((k, spans[first][0], end, first, -last))
                most = -last
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, list[str]]]:
        """(licence, first sentence, sentences, identifiers) of each match, in order; sentences count from 0."""
        text = text.lower()
        if next(self.rare.iter(text), None) is None or not (found := self.identify(text)):
            return []
        begins, at = [], 0
        for m in _BREAK.finditer(text):
            if text[at : m.start()].strip():
                begins.append(at)
            at = m.end()
        begins.append(at)
        first, last = (np.searchsorted(begins, [x[c] - c + 1 for x in found], "right").tolist() for c in (1, 2))
        ids = [(x[0], a - 1, b - 1) for x, a, b in zip(found, first, last, strict=True)]
        near = [b[3] - a[4] <= self.gap for a, b in zip(found, found[1:], strict=False)]
        out, at = [], 0
        while at < len(ids):
            for name, want in self.rules.get(ids[at][0], ()):
                if tuple(x for x, _, _ in ids[at : at + len(want)]) == want and all(near[at : at + len(want) - 1]):
                    out.append((name, ids[at][1], ids[at + len(want) - 1][2] - ids[at][1] + 1, list(want)))
                    at += len(want)
                    break
            else:
                at += 1
        return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    know = Recogniser()
    for b in batches:
        rows = [(r, *m) for at in range(0, b.num_rows, 128) for r, t in enumerate(b.column(1).slice(at, 128).to_pylist(), at) if t for m in know.scan(t)]
        if rows:
            r, name, first, n, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(name), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(ids)], names=["doc_id", "license", "first_sentence", "n_sentences", "sentence_ids"])


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row per licence match in documents (doc_id, text): doc_id, license, first_sentence, n_sentences, sentence_ids.

    Sentences are counted from line ends and . ; ! ? : with white space behind; a licence sentence may go over several. Null and empty texts match nothing;
    repeated rows are each reported. Texts are scanned whole; other columns are not read.
    """
    documents = frames.pick(documents, "doc_id", "text")
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("license string, first_sentence int, n_sentences int, sentence_ids array<string>")])
    return documents.mapInArrow(_scan, schema)
