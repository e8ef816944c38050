"""License notices found by conditional compression.

A candidate block is what stands around a license word: the text of its paragraph (lines that hold a word, with or without
comment marks) up to ``REACH`` characters before and after it; blocks that touch are one. Of each template, every
stretch of the block that could hold ``LEAST`` of its words is compared word by word. The best stretch of a template is
compressed once alone and once with the template as a raw zstandard dictionary: text that the template holds costs
almost nothing, so a notice saves ``LEAST_SAVING`` bytes at least. Of the templates that fit, the one with the longest wording held
wins, then the larger saving, and the finding lists the exact words missing and the words put between. What is left of the
block before and after the notice is searched in the same way, until no template fits. A finding's span is the notice
itself with the signs that touch its last word.

Defined cases: null and empty texts have no blocks; equal blocks are judged once per task (bounded table); ties in wording
and saving go to the first template by name; repeated rows each get their findings; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import json
import math
import re
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import column, map_batches

REACH, LEAST, LEAST_SAVING, MAX_BLOCKS = 400, 0.8, 4, 100_000
#: Public license notices by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
SIGN = re.compile(r"licen[sc]e|copyright|permission|redistribut|(?:public[\W_]{1,12}domain|free[\W_]{1,12}software|creative[\W_]{1,12}commons)|warrant", re.I | re.A)
STEMS = (("licen",), ("copyright",), ("permission",), ("redistribut",), ("public", "domain"), ("free", "software"), ("creative", "commons"), ("warrant",))
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", re.I | re.A)
BLANK = re.compile(r"\n[\W_]*\n")
TAIL = re.compile(r"[^\w\s]*")


def blocks(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Code-point spans of the candidate blocks of a text, in order."""
    low = text.lower()
    if not any(all(w in low for w in s) for s in STEMS):                # most texts; the expression below decides on the rest
        return []
    out: list[list[int]] = []
    for m in SIGN.finditer(text):
        left, right = max(0, m.start() - reach), min(len(text), m.end() + reach)
        left = max((x.end() for x in BLANK.finditer(text, left, m.start())), default=left)
        after = BLANK.search(text, m.end(), right)
        right = after.start() if after else right
        while left and text[left - 1].isalnum() and text[left].isalnum():          # no word is cut
            left -= 1
        while right < len(text) and text[right - 1].isalnum() and text[right].isalnum():
            right += 1
        if out and left <= out[-1][1]:
            out[-1][1] = max(out[-1][1], right)
        else:
            out.append([left, right])
    return [(a, b) for a, b in out]


class Matcher:
    """Ranks the templates for a block by saved bytes and confirms by wording."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 3):
        self.names = sorted(templates)
        self.reach = max([REACH, *(2 * len(t) for t in templates.values())])
        self.words = {n: WORDS.findall(templates[n].lower()) for n in self.names}
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = {n: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(templates[n].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in self.names}
        self.sets = {n: frozenset(w) for n, w in self.words.items()}
        self.seen: dict[str, list[tuple]] = {}

    def savings(self, block: str) -> list[tuple[int, str]]:
        """(bytes saved, template), best first."""
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        return sorted(((alone - len(c.compress(raw)), n) for n, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def saving(self, part: str, name: str) -> int:
        raw = part.lower().encode()
        return len(self.plain.compress(raw)) - len(self.given[name].compress(raw))

    def wording(self, own: list[str], name: str) -> tuple[float, list[str], list[str], int, int]:
        """Share of the template's words that ``own`` holds in order, words missing, words between them, and where it begins and ends."""
        theirs = self.words[name]
        match = [m for m in difflib.SequenceMatcher(None, own, theirs, autojunk=False).get_matching_blocks() if m.size]
        if not match:
            return 0.0, theirs, [], 0, 0
        kept = {k for m in match for k in range(m.b, m.b + m.size)}
        inside = {k for m in match for k in range(m.a, m.a + m.size)}
        first, last = match[0].a, match[-1].a + match[-1].size
        return len(kept) / len(theirs), [w for k, w in enumerate(theirs) if k not in kept], [own[k] for k in range(first, last) if k not in inside], first, last

    def fits(self, own: list[str], name: str) -> list[tuple]:
        """(words held less those missing or between, begin, end, share, missing, between) of the stretches that fit a template, best first."""
        theirs, kinds = self.words[name], self.sets[name]
        least = math.ceil(LEAST * len(theirs) - 1e-9)
        if not theirs or len(kinds - set(own)) > len(theirs) - least:
            return []
        hits = [w in kinds for w in own]
        upto, width, out = [0, *accumulate(hits)], len(theirs) + len(theirs) // 2, {}
        for at, hit in enumerate(hits):
            if hit and upto[min(len(own), at + width)] - upto[at] >= least:
                share, missing, between, first, last = self.wording(own[at:at + width], name)
                if share >= LEAST and len(between) <= len(theirs) // 2:
                    out.setdefault((at + first, at + last), (len(theirs) - 2 * len(missing) - len(between), at + first, at + last, share, missing, between))
        return sorted(out.values(), key=lambda x: (-x[0], x[1], x[2]))

    def notices(self, block: str) -> list[tuple]:
        """(start, end, (template, bytes saved, share, missing, between)) of every notice in a block, by start."""
        if block in self.seen:
            return self.seen[block]
        found, tokens = [], [(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(block)]
        left = [(0, len(tokens))]
        while left:
            low, high = left.pop()
            own, best = [w for _, _, w in tokens[low:high]], None
            for name in self.names:
                for held, a, b, share, missing, between in self.fits(own, name):
                    if best and held < best[0][0]:
                        break
                    start, end = tokens[low + a][0], tokens[low + b - 1][1]
                    saved = self.saving(block[start:end], name)
                    if saved >= LEAST_SAVING:
                        if best is None or (held, saved) > best[0]:
                            best = (held, saved), low + a, low + b, (start, TAIL.match(block, end).end(), (name, saved, round(share, 4), missing, between))
                        break
            if best:
                found.append(best[3])
                left += [(low, best[1]), (best[2], high)]
        if len(self.seen) > MAX_BLOCKS:
            self.seen.clear()
        self.seen[block] = found = sorted(found, key=lambda x: x[:2])
        return found

    def judge(self, block: str) -> tuple | None:
        """(template, bytes saved, share, missing, between) of the notice with the largest saving, or None."""
        return max((x for _, _, x in self.notices(block)), key=lambda x: x[1], default=None)


def license_notices(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_blocks, n_found, licenses (names, sorted, comma-joined), findings (name:start:end:saved by start), differences (JSON)."""
    def build():
        matcher = Matcher(templates)

        def step(batch):
            n_blocks, n_found, names, findings, differences = [], [], [], [], []
            for text in column(batch, text_col).to_pylist():
                spans = blocks(text or "", matcher.reach)
                found = [(a + x, a + y, w) for a, b in spans for x, y, w in matcher.notices(text[a:b])]
                n_blocks.append(len(spans))
                n_found.append(len(found))
                names.append(",".join(sorted({w[0] for _, _, w in found})))
                findings.append(",".join(f"{w[0]}:{a}:{b}:{w[1]}" for a, b, w in found))
                differences.append(json.dumps([{"template": w[0], "share": w[2], "missing": w[3], "between": w[4]} for _, _, w in found if w[3] or w[4]]))
            return {id_col: column(batch, id_col), "n_blocks": pa.array(n_blocks, pa.int64()), "n_found": pa.array(n_found, pa.int64()), "licenses": names, "findings": findings, "differences": differences}
        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), build, f"{id_col} long, n_blocks long, n_found long, licenses string, findings string, differences string")
