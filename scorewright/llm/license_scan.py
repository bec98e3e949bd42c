"""Licences named in texts, by sentence rules.

A text is cut into sentences in two ways: at sentence ends and line ends, and at sentence ends and
empty lines only (for sentences that run over lines). A sentence in normal form (ASCII letters and
digits in lower case, all else one space) that is known has an identifier. A text is then the sequence
of its known sentences, and rules are matched against it in order: a rule is a licence and the
sequence of identifiers that names it. What a rule matches is taken out before the next rule, so the
rules of longer sequences come first. A licence is found if either cut finds it. The normal form has no
``+``, so the old SPDX names GPL-2.0 and GPL-2.0+ (and so on) are one sentence, and are not in the table.
Numbers of a list are no sentences; they may stand between those of a rule.

All of it are expressions of one row, with no shuffle; the table of sentences and the rules are
bounded by ``MOST_SENTENCES`` and ``MOST_RULES``, since they are part of the plan.

Rows: one output row per input row; null and empty texts have no sentences and no licences. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import UPPER, lower_ascii

MOST_SENTENCES = 1_000
MOST_RULES = 200

LINES = r"[.!?;]+[\x20\x09-\x0D]+|[\x0A\x0D]+"
PARAGRAPHS = r"[.!?;]+[\x20\x09-\x0D]+|\x0A[\x20\x09\x0D]*\x0A[\x20\x09-\x0D]*"

# Sentences of public licences and notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache_short": "Licensed under the Apache License, Version 2.0",
    "apache_head": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache_use": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_place": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache_title": "Apache License",
    "apache_dated": "Version 2.0, January 2004",
    "gpl_title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl_title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl_title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gnu3_dated": "Version 3, 29 June 2007",
    "gnu2_dated": "Version 2, June 1991",
    "lgpl21_dated": "Version 2.1, February 1999",
    "agpl3_dated": "Version 3, 19 November 2007",
    "as_is_unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit_short": "Released under the MIT License",
    "mit_under": "Licensed under the MIT License",
    "mit_title": "The MIT License (MIT)",
    "mit_name": "MIT License",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_short": "Released under the BSD License",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3",
    "gpl2_short": "This work is licensed under the GNU General Public License, version 2",
    "gpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_free": "This program is free software",
    "gpl2_or_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2_version": "either version 2 of the License, or (at your option) any later version",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl_short": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl_short": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl2_source": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "ccby_short": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa_short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbync_short": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0_short": "This work is dedicated to the public domain",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "spdx_mit": "SPDX-License-Identifier: MIT",
    "spdx_apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx_bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx_gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx_gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3_version": "either version 3 of the License, or (at your option) any later version",
    "gpl2_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2_this": "version 2 of the License",
    "library_free": "This library is free software",
    "lgpl_or_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "library_or_later": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "lgpl21_version": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3_program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3_library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl_or_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "isc_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}

# Licences that one sentence of their own names.
ONE_SENTENCE: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Released under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "This project is licensed under the Apache License 2.0", "Licensed under the Apache License, Version 2.0 (see LICENSE)", "This code is released under the Apache License, Version 2.0"),
    "MIT": ("This project is licensed under the MIT License", "This work is licensed under the MIT License", "Licensed under MIT", "Licensed under the MIT License (see LICENSE)", "This code is released under the MIT License"),
    "BSD": ("Licensed under the BSD License",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    "ISC": ("Licensed under the ISC License", "Released under the ISC License", "SPDX-License-Identifier: ISC"),
    "GPL-2.0-only": ("Licensed under the GNU General Public License, version 2",),
    "GPL-3.0-only": ("Licensed under the GNU General Public License, version 3",),
    "LGPL-2.1-only": ("Licensed under the GNU Lesser General Public License, version 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    "LGPL-3.0-only": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0-only": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"),
    "CC0-1.0": ("Licensed under CC0 1.0", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    **{name: (f"SPDX-License-Identifier: {name}",) for name in (
        "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later",
        "AGPL-3.0-or-later", "Unlicense", "Zlib",
    )},
}

# The Creative Commons licences, their versions and the word their long names end with.
CC_KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def _creative_commons() -> dict[str, tuple[str, ...]]:
    found = {}
    for kind, name in CC_KINDS.items():
        for version, scope in CC_VERSIONS.items():
            # Before version 4.0 the long name is NoDerivs.
            long = f"{name if version == '4.0' else name.replace('NoDerivatives', 'NoDerivs')} {version} {scope}"
            forms = [f"Licensed under CC {kind} {version}", f"This work is licensed under a Creative Commons {long} License"]
            if version in ("4.0", "3.0"):
                forms.append(f"This work is licensed under CC {kind} {version}")
            if version == "4.0":
                forms += [f"CC {kind} {version}", f"This work is licensed under Creative Commons {long}", f"SPDX-License-Identifier: CC-{kind}-{version}"]
            found[f"CC-{kind}-{version}"] = tuple(forms)
        found[f"CC-{kind}"] = (f"Licensed under CC {kind}",)
    return found


#: Licence and sentence by the identifier of the sentence; a form listed above keeps its identifier there.
_SINGLE = {
    f"{licence}:{k}": (licence, form)
    for licence, forms in (*ONE_SENTENCE.items(), *_creative_commons().items())
    for k, form in enumerate(forms)
    if form not in SENTENCES.values()
}
SENTENCES |= {name: form for name, (_, form) in _SINGLE.items()}

# Licences and the sentence sequences that name them, the longer ones first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("Apache-2.0", ("apache_title", "apache_dated")),
    ("GPL-3.0-only", ("gpl_title", "gnu3_dated")),
    ("GPL-2.0-only", ("gpl_title", "gnu2_dated")),
    ("LGPL-3.0-only", ("lgpl_title", "gnu3_dated")),
    ("LGPL-2.1-only", ("lgpl_title", "lgpl21_dated")),
    ("AGPL-3.0-only", ("agpl_title", "agpl3_dated")),
    ("Apache-2.0", ("apache_head", "apache_use", "apache_copy", "apache_place", "as_is_unless")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl2_or_later", "gpl2_version")),
    ("GPL-3.0-or-later", ("gpl2_free", "gpl2_or_later", "gpl3_version")),
    ("GPL-2.0-only", ("gpl2_free", "gpl2_or_later", "gpl2_this")),
    ("LGPL-2.1-or-later", ("library_free", "lgpl_or_later", "lgpl21_version")),
    ("LGPL-2.1-or-later", ("gpl2_free", "lgpl_or_later", "lgpl21_version")),
    ("LGPL-3.0-or-later", ("library_free", "lgpl_or_later", "gpl3_version")),
    ("LGPL-3.0-or-later", ("gpl2_free", "lgpl_or_later", "gpl3_version")),
    ("LGPL-2.0-or-later", ("library_free", "library_or_later", "gpl2_version")),
    ("AGPL-3.0-or-later", ("gpl2_free", "agpl_or_later", "gpl3_version")),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_name", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("GPL-3.0-or-later", ("gpl3_or_later", "gpl_warranty")),
    ("ISC", ("isc_grant",)),
    ("GPL-2.0-only", ("gpl2_free", "gpl2_only")),
    ("ISC", ("isc_and",)),
    ("GPL-3.0-or-later", ("gpl3_or_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_program",)),
    ("LGPL-3.0-or-later", ("lgpl3_library",)),
    ("AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("Apache-2.0", ("apache_head",)),
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_under",)),
    ("MIT", ("spdx_mit",)),
    ("BSD", ("bsd_short",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("GPL-3.0-only", ("gpl3_short",)),
    ("GPL-3.0-only", ("spdx_gpl3",)),
    ("GPL-2.0-only", ("gpl2_short",)),
    ("GPL-2.0-only", ("spdx_gpl2",)),
    ("LGPL-3.0-only", ("lgpl_short",)),
    ("AGPL-3.0-only", ("agpl_short",)),
    ("MPL-2.0", ("mpl2_source",)),
    ("CC-BY-4.0", ("ccby_short",)),
    ("CC-BY-SA-4.0", ("ccbysa_short",)),
    ("CC-BY-NC-4.0", ("ccbync_short",)),
    ("CC0-1.0", ("cc0_short",)),
    ("Unlicense", ("unlicense",)),
    *((licence, (name,)) for name, (licence, _) in _SINGLE.items()),
)


def normal(sentence: str) -> str:
    """Normal form of a sentence."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, UPPER.lower()))).strip()


def _known(text: Column, cut: str, table: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    found = F.transform(F.split(text, cut), lambda part: F.element_at(table, F.trim(F.regexp_replace(lower_ascii(part), "[^a-z0-9]+", " "))))
    return F.filter(found, lambda name: name.isNotNull())


def _matched(names: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Licences whose rules match the sequence, each rule taking out what it matches."""
    sequence = F.concat(F.lit("|"), F.array_join(F.transform(names, lambda name: F.concat(name, F.lit("|"))), "|"))
    state = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    steps = F.array(*[
        F.struct(F.lit(licence).alias("licence"), F.lit("|" + "||".join(part) + "|").alias("part")) for licence, part in rules
    ])
    return F.aggregate(
        steps,
        state,
        lambda at, rule: F.when(
            F.contains(at["left"], rule["part"]),
            F.struct(
                F.replace(at["left"], rule["part"], F.lit("|*|")).alias("left"),
                F.array_append(at["found"], rule["licence"]).alias("found"),
            ),
        ).otherwise(at),
        lambda at: at["found"],
    )


def scan_licenses(
    docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES
) -> DataFrame:
    """Per document: doc_id, n_sentences (known ones, of the cut at lines) and licenses (sorted, distinct)."""
    if len(sentences) > MOST_SENTENCES or len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_SENTENCES} sentences and {MOST_RULES} rules")
    forms = {normal(sentence): name for name, sentence in sentences.items()}
    table = F.create_map(*[F.lit(value) for pair in forms.items() for value in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("doc_id", _known(text, LINES, table).alias("a"), _known(text, PARAGRAPHS, table).alias("b"))
    none = F.array().cast("array<string>")
    found = F.when(
        (F.size("a") > 0) | (F.size("b") > 0), F.array_sort(F.array_union(_matched(F.col("a"), rules), _matched(F.col("b"), rules)))
    ).otherwise(none)
    return held.select("doc_id", F.size("a").cast("bigint").alias("n_sentences"), found.alias("licenses"))
