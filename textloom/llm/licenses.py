"""License scans: an exact set-similarity join of text blocks with license texts. SQL functions only.

Licenses come as whole texts or file headers (``TEMPLATES``), joined as sets of words, and as short
notices (``NOTICES``), which a bag of words would not tell from chance: their words have to stand
consecutively, as those of the base phrases.

A text's blocks are windows of its words, wherever lines end: for templates of up to 2^c words, windows of
2^(c+1) words that begin at every multiple of 2^c, so that a notice of a template's length lies whole in a
block. A block meets a template if it contains at least ``CONTAINMENT`` of the template's distinct words.
The template's words are put in one order by their frequency in the whole corpus, rarest first; a block
that meets a template of n words must hold one of the template's first n - ceil(t n) + 1 words (prefix
filter), have as many words as are needed (length filter), and at its first shared prefix word the words
still to come on both sides must suffice (positional filter). What passes is checked exactly, so no pair
is lost. The template index is broadcast: its size is that of the templates, checked against
``MAX_TEMPLATE_WORDS``.

Every text is split into words once; which template words it holds is kept in a table in the shared
folder, together with the few texts that hold enough of some template as a whole.

Nulls: a null text counts as empty; a null doc_id stays. Texts without words have no blocks. Repeated rows
get equal results; templates tied in frequency are ordered by the word itself; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize

#: Fixed phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed short notices, found by their words in sequence.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "gpl-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gplv3"),
    "gpl-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gplv2"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license"),
    "agpl": ("gnu affero general public license",),
    "mpl-2.0": ("mozilla public license v 2 0", "mozilla public license version 2 0"),
    "cc-by-4.0": ("licensed under cc by 4 0", "creative commons attribution 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0"),
    "cc0-1.0": ("cc0 1 0", "creative commons zero"),
    "all-rights-reserved": ("all rights reserved",),
}
#: Fixed texts of well-known licenses and file headers; all may be replaced by the caller.
TEMPLATES = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "mit-grant": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-grant": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""",
    "isc-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    "apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    "gpl-or-later": """
        GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version""",
    "mpl-2.0-header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense-text": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "cc0-notice": """
        To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work""",
}
CONTAINMENT = 0.9
MAX_TEMPLATE_WORDS = 10_000

#: A word and a separator in text as it is; A-Z are letters of words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_words(text: str) -> list[str]:
    return re.findall(f"{WORD}+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _phrase(phrase: str) -> str:
    return f"{GAP}+".join(phrase.split())


def _whole(inner: str) -> str:
    return f"(?i)(?<!{WORD})(?:{inner})(?!{WORD})"


def needed(n: int, share: float = CONTAINMENT) -> int:
    return max(1, math.ceil(share * n - 1e-9))


def stride(text: str) -> int:
    """The least power of two that the template's words don't exceed."""
    return 1 << (len(lower_words(text)) - 1).bit_length()


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_array(text: Column) -> Column:
    """Words with A-Z in lower case; the Kelvin sign is the one letter that lower() would make one of a-z."""
    low = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, f"{GAP}+"), "")


def _holds(held: Column, phrase: str) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(held, w) for w in phrase.split()])


def phrase_columns(text: Column, held: Column, notices: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Counts of base phrases by regular expressions over the whole text, and labels of notices. No base
    phrase holds another's first word, so that matches never overlap; a place is the number of words before
    it. Texts that lack a phrase's words are not searched for it."""
    any_phrase = _whole("|".join(map(_phrase, PHRASES)))
    may = reduce(lambda a, b: a | b, [_holds(held, p) for p in PHRASES])
    found = may & text.rlike(any_phrase)
    before_first = F.get(F.split(text, any_phrase, 2), F.lit(0))
    before_last = F.regexp_extract(text, f"(?s)^(.*){any_phrase.removeprefix('(?i)')}".replace("(?s)", "(?is)"), 1)
    count = lambda part: F.regexp_count(part, F.lit(f"{WORD}+")).cast("long")
    there = lambda p: _holds(held, p) & text.rlike(_whole(_phrase(p)))
    labels = [F.when(there(p), F.lit(label)) for p, label in PHRASES.items()]
    own = [F.when(reduce(lambda a, b: a | b, map(there, ps)), F.lit(label)) for label, ps in notices.items()]
    none = F.array().cast("array<string>")
    return {
        "n_base": F.when(found, F.regexp_count(text, F.lit(any_phrase))).otherwise(0).cast("long"),
        "first_word": F.when(found, count(before_first)),
        "last_word": F.when(found, count(before_last)),
        "base_set": F.array_sort(F.array_compact(F.array(*labels))),
        "notice_set": F.array_compact(F.array(*own)) if own else none,
    }


def scanned(docs: DataFrame, sets: dict[str, list[str]], notices: dict[str, tuple[str, ...]], share: float) -> DataFrame:
    """One row for each document: its counts, the template words that it holds, and its text if it holds
    enough words of some template as a whole."""
    words = {w for ws in sets.values() for w in ws} | {w for p in [*PHRASES, *(p for ps in notices.values() for p in ps)] for w in p.split()}
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    split = base.withColumn("words", word_array(F.col("text")))
    held = split.select("doc_id", "text_hash", "text", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _strings(sorted(words))).alias("held"))
    least = min((needed(len(ws), share) for ws in sets.values()), default=1)
    enough = [F.size(F.array_intersect("held", _strings(ws))) >= needed(len(ws), share) for ws in sets.values()]
    whole = (F.size("held") >= least) & reduce(lambda a, b: a | b, enough, F.lit(False))
    columns = phrase_columns(F.col("text"), F.col("held"), notices)
    return materialize(
        held.select("doc_id", "text_hash", "n_words", "held", *[c.alias(k) for k, c in columns.items()], F.when(whole, F.col("text")).alias("candidate")),
        "license-words",
    )


def word_order(table: DataFrame, words: list[str]) -> dict[str, int]:
    """Ranks of the template words by the number of documents of the whole corpus that hold them, rarest
    first. The result has one row for each template word at most."""
    rows = table.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in rows}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (df.get(w, 0), w)))}


def join_blocks(table: DataFrame, sets: dict[str, list[str]], strides: dict[str, int], share: float) -> DataFrame:
    """Every (doc_id, text_hash, stride, block, label, containment) with containment of at least ``share``."""
    spark = table.sparkSession
    order = word_order(table, sorted({w for ws in sets.values() for w in ws}))
    index, universe = [], {}
    for label, ws in sets.items():
        ranked, step = sorted(ws, key=order.__getitem__), strides[label]
        need = needed(len(ranked), share)
        first = ranked[: len(ranked) - need + 1]
        universe.setdefault(step, set()).update(first)
        index += [(step, w, label, i, need, ranked) for i, w in enumerate(first)]
    schema = "step int, p_word string, label string, place int, need int, ranked array<string>"
    prefixes = F.broadcast(spark.createDataFrame(index, schema))  # MAX_TEMPLATE_WORDS rows at most
    ranks = F.create_map(*[F.lit(x) for w, r in order.items() for x in (w, r)])
    known = sorted(order)

    def blocks(step: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size("words") / step).cast("int") - 1)
        cut = lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.slice("words", b * step + 1, 2 * step).alias("words"))
        return F.filter(F.transform(F.sequence(F.lit(0), last), cut), lambda x: F.exists(x.words, lambda w: w.isin(*sorted(universe[step]))))

    found = (
        table.where("candidate is not null")
        .select("doc_id", "text_hash", word_array(F.col("candidate")).alias("words"))
        .select("doc_id", "text_hash", F.inline(F.concat(*[blocks(s) for s in sorted(universe)])))
        .select("doc_id", "text_hash", "step", "block", F.array_distinct("words").alias("words"))
        .withColumn("known_words", F.filter("words", lambda w: w.isin(*known)))
        .withColumn("known_words", F.array_sort("known_words", lambda a, b: ranks[a] - ranks[b]))
        .select("doc_id", "text_hash", "step", "block", F.size("words").alias("n"), "known_words", F.posexplode("known_words").alias("at", "p_word"))
    )
    pairs = (
        found.join(prefixes, ["step", "p_word"])
        .where(F.col("n") >= F.col("need"))
        .where(F.least(F.size("ranked") - F.col("place"), F.size("known_words") - F.col("at")) >= F.col("need"))
        .withColumn("overlap", F.size(F.array_intersect("known_words", "ranked")))
        .where(F.col("overlap") >= F.col("need"))
    )
    # a pair met at several prefix words is one pair; the positional filter holds at the first of them
    return pairs.groupBy("doc_id", "text_hash", "step", "block", "label").agg(F.max(F.col("overlap") / F.size("ranked")).alias("containment"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, notices: dict[str, tuple[str, ...]] = NOTICES, share: float = CONTAINMENT) -> DataFrame:
    """doc_id, counts of base phrases, their labels, all labels, and the best containment (1 for a phrase)."""
    sets = {label: sorted(set(lower_words(t))) for label, t in templates.items() if lower_words(t)}
    if sum(map(len, sets.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates hold more words than may be broadcast; scan with fewer at a time")
    table = scanned(docs, sets, notices, share)
    none = F.array().cast("array<string>")
    phrases = F.array_union("base_set", "notice_set")
    if not sets:
        found = table.select("doc_id", "text_hash", none.alias("found"), F.lit(0.0).alias("best")).limit(0)
    else:
        pairs = join_blocks(table, sets, {label: stride(templates[label]) for label in sets}, share)
        # labels: as many as templates
        found = pairs.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    keys = F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_hash") == F.col("f.text_hash"))
    return (
        table.drop("held", "candidate")
        .withColumn("phrases", phrases)
        .alias("b")
        .join(found.alias("f"), keys, "left")
        .select(
            "b.doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join("base_set", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("phrases", F.coalesce("found", none))), ",").alias("labels"),
            F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0)).alias("score"),
        )
    )
