"""Licence recognition by sentences and rules, in SQL expressions only.

A text is cut into sentences at lines without a word and at marks followed by white space,
but not after "v."; a copyright line starts a sentence and an SPDX line is one. A single
line end does not cut, so wrapped texts and comment blocks are read whole. A sentence is
normalised (ASCII letters lowered, every other ASCII character a single space, trimmed)
and searched for known licence sentences: whole words, all that occur, by position, the
longest at each. Patterns cover sentences with free parts and come first. The identifiers
of a text's known sentences, in order, are matched against ordered rules; what a rule has
matched is used up, so a later, weaker rule cannot claim it again. Identifiers left over
are reported.

Everything is an expression over one row: no join, no shuffle, and a licence line in a
third of all documents makes no hot key. Texts without any trigger word are not cut.

Rows: a null or empty text has no sentences and no licence. Repeated rows are scanned one
by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence wording, normalised, and the identifier of each sentence.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("as-is", "the software is provided as is without warranty of any kind"),
    ("mit-ref", "released under the mit license"),
    ("mit-ref", "licensed under the mit license"),
    ("mit-ref", "under the terms of the mit license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2-ref", "licensed under the apache license version 2 0"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("agpl-3-ref", "gnu affero general public license version 3"),
    ("lgpl-3-ref", "gnu lesser general public license version 3"),
    ("lgpl-2-ref", "gnu lesser general public license version 2 1"),
    ("gpl-3-ref", "gnu general public license version 3"),
    ("gpl-2-ref", "gnu general public license version 2"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2-ref", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-sa-4", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4", "cc by nc nd 4 0"),
    ("cc-by-nc-4", "cc by nc 4 0"),
    ("cc-by-sa-4", "cc by sa 4 0"),
    ("cc-by-4", "cc by 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("public-domain", "released into the public domain"),
    ("reserved", "all rights reserved"),
)
# Wording of standard headers that is known besides the list above.
_PUBLISHED = "public license as published by the free software foundation"
HEADERS: tuple[tuple[str, str], ...] = tuple(
    (name, f"gnu {kind}{_PUBLISHED} {either}version {version}")
    for name, kind, version in (
        ("agpl-3-ref", "affero general ", "3"),
        ("lgpl-3-ref", "lesser general ", "3"),
        ("lgpl-2-ref", "lesser general ", "2 1"),
        ("gpl-3-ref", "general ", "3"),
        ("gpl-2-ref", "general ", "2"),
    )
    for either in ("either ", "")
) + (("as-is", "the software is provided as is and the author disclaims all warranties"),)
# Sentences with free parts, as patterns over the normalised sentence.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("spdx", "^spdx license identifier [a-z0-9 ]+$"),
    ("copyright", "^(portions )?copyright (c )?([0-9 ]+ )?[^ ]+"),
)
# Licence by sequence of sentence identifiers, strongest first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "as-is")),
    ("Apache-2.0", ("apache-2-ref", "apache-comply")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("AGPL-3.0", ("agpl-3-ref",)),
    ("LGPL-3.0", ("lgpl-3-ref",)),
    ("LGPL-2.1", ("lgpl-2-ref",)),
    ("GPL-3.0", ("gpl-redistribute", "gpl-3-ref")),
    ("GPL-3.0", ("gpl-3-ref",)),
    ("GPL-2.0", ("gpl-redistribute", "gpl-2-ref")),
    ("GPL-2.0", ("gpl-2-ref",)),
    ("MPL-2.0", ("mpl-2-ref",)),
    ("MIT", ("mit-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("copyright", "reserved")),
    ("Proprietary", ("reserved",)),
)
# Every known sentence and pattern holds one of these.
TRIGGERS = "licen|copyright|permission|redistribut|warranty|endorse|spdx|compliance|public domain|rights reserved|cc by|cc0"
_RAW_TRIGGERS = "(?i)licen|copyright|permission|redistribut|warranty|endorse|spdx|compliance|domain|reserved|cc[^a-z0-9]+by|cc0|holders"
# Where the SQL twin cuts: line by line. It agrees where every notice stands on one line.
SENTENCE_END = r"[\n\r]+|[.!?;]+[ \t\n\r]+"
# Where the scan cuts, after line ends became \n and SPDX lines stand alone: lines without
# a word, line ends in front of a copyright line, and marks in front of white space.
_WORD = r"a-zA-Z0-9\x{80}-\x{10FFFF}"
BREAKS = (
    rf"\n[^{_WORD}]*\n|\n(?=[^{_WORD}\n]*(?i:portions )?(?i:copyright)[^{_WORD}\n]+(?!(?i:notice|holder|owner|law|licen|statement|and|or)))"
    r"|(?<!\b[vV])[.!?]+[ \t\n]+"
)
SPDX_LINE = r"(?i)(spdx-license-identifier:[^\n]*)"
# The licences of all SPDX lines of a text, exceptions and brackets left out.
SPDX_NAMES = (
    "filter(transform(flatten(transform(regexp_extract_all(coalesce(text, ''), r'(?i)spdx-license-identifier:[ \\t]*([a-z0-9.+() \\t-]+)', 1), "
    "v -> split(regexp_replace(v, r'(?i)[ \\t]with[ \\t]+[^ \\t()]+|[()]', ' '), r'(?i)[ \\t]+(?:or|and)[ \\t]+'))), "
    "x -> rtrim('.', regexp_extract(trim(x), '^[A-Za-z0-9.+-]+', 0))), x -> x <> '')"
)
# Words that start comment lines; marks are spaces anyway.
COMMENT_WORDS = r"(?m)^[ \t]*(?i:rem|dnl)[ \t]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sentence_id(sentences: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]], contains: str, like: str) -> str:
    cases = [f"WHEN {contains.format(_quoted(f' {words} '))} THEN {_quoted(name)}" for name, words in sentences]
    cases += [f"WHEN {like.format(_quoted(pattern))} THEN {_quoted(name)}" for name, pattern in patterns]
    return f"CASE {' '.join(cases)} END"


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), sentences=SENTENCES + HEADERS, patterns=PATTERNS, rules=RULES, triggers: tuple[str, str] = (_RAW_TRIGGERS, TRIGGERS), spdx: bool = False) -> DataFrame:
    """The ``keep`` columns with the sentence identifiers and licences of each text.

    ``sentence_ids`` is the sequence in text order, ``licenses`` the licences in rule
    order, each once per match, ``left_over`` the number of identifiers that no rule took.
    ``triggers`` are two patterns, over the raw text and over a normalised sentence, that
    every text or sentence with a known sentence must match. With ``spdx`` the licences
    named on SPDX lines follow those of the rules, as they are written and without
    exceptions, and their identifiers count as taken.
    """
    raw, normal = triggers
    text = f"CASE WHEN text RLIKE {_sql(raw)} THEN text ELSE '' END"
    cleaned = "concat(' ', trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\\\x{80}-\\\\x{10FFFF}]+', ' ')), ' ')"
    lines = f"regexp_replace(replace(replace({text}, '\\r\\n', '\\n'), '\\r', '\\n'), {_sql(COMMENT_WORDS)}, '')"
    lines = f"regexp_replace({lines}, {_sql(SPDX_LINE)}, '\\n\\n$1\\n\\n')"
    parts = f"filter(transform(split({lines}, {_sql(BREAKS)}), s -> {cleaned}), s -> s RLIKE {_sql(normal)})"
    # The space in front is looked at, not taken, so that sentences may overlap.
    longest = sorted(sentences, key=lambda x: -len(x[1]))
    known = f"map({', '.join(f'{_quoted(words)}, {_quoted(name)}' for name, words in dict((w, (n, w)) for n, w in longest).values())})"
    held = _sql("(?= (" + "|".join(words for _, words in longest) + ") )")
    fixed = [f"CASE WHEN trim(s) RLIKE {_quoted(pattern)} THEN {_quoted(name)} END" for name, pattern in patterns]
    every = f"concat(array({', '.join(fixed)}), transform(regexp_extract_all(s, {held}, 1), w -> element_at({known}, w)))"
    named = f"filter(flatten(transform({parts}, s -> {every})), x -> x IS NOT NULL)"
    found = docs.select(*keep, F.expr(named).alias("__ids"), F.expr(SPDX_NAMES if spdx else "CAST(array() AS array<string>)").alias("__spdx"))
    found = found.withColumn("sentence_ids", F.coalesce(F.array_join("__ids", ","), F.lit("")))
    state = "concat('<', array_join(__ids, '><'), '>')"
    # One pass over the rules: the state is what is left of the sequence and what was found.
    table = ", ".join(f"struct({_quoted(name)} AS name, {_quoted(''.join(f'<{x}>' for x in ids))} AS ids)" for name, ids in rules)
    step = (
        "(a, r) -> named_struct('rest', replace(a.rest, r.ids, '|'), 'found', "
        "concat(a.found, repeat(concat(r.name, ','), CAST((length(a.rest) - length(replace(a.rest, r.ids, ''))) / length(r.ids) AS INT))))"
    )
    matched = f"CASE WHEN size(__ids) > 0 THEN aggregate(array({table}), named_struct('rest', {state}, 'found', ''), {step}) END"
    found = found.withColumn("__m", F.expr(matched))
    taken = "CASE WHEN size(__spdx) > 0 THEN size(filter(__ids, x -> x = 'spdx')) ELSE 0 END"
    return found.select(
        *keep,
        F.size(F.coalesce("__ids", F.array().cast("array<string>"))).cast("long").alias("n_sentences"),
        "sentence_ids",
        F.expr("concat_ws(',', nullif(rtrim(',', __m.found), ''), __spdx)").alias("licenses"),
        F.coalesce(F.expr(f"length(__m.rest) - length(replace(__m.rest, '<', '')) - {taken}"), F.lit(0)).cast("long").alias("left_over"),
    )


def _sql(pattern: str) -> str:
    """A pattern as a raw SQL string, whose backslashes stay."""
    return 'r"' + pattern + '"'


def duckdb_sql(sentences=SENTENCES, patterns=PATTERNS, rules=RULES) -> str:
    """The same scan for DuckDB, one step per rule."""
    cleaned = "concat(' ', trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g')), ' ')"
    case = _sentence_id(sentences, patterns, "contains(s, {})", "regexp_matches(trim(s), {})")
    steps = ["r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN concat('<', array_to_string(ids, '><'), '>') ELSE '' END AS rest, '' AS found FROM named)"]
    for i, (name, ids) in enumerate(rules):
        mark = _quoted("".join(f"<{x}>" for x in ids))
        count = f"CAST((length(rest) - length(replace(rest, {mark}, ''))) / length({mark}) AS BIGINT)"
        steps.append(f"r{i + 1} AS (SELECT doc_id, ids, replace(rest, {mark}, '|') AS rest, concat(found, repeat({_quoted(name + ',')}, {count})) AS found FROM r{i})")
    return (
        f"WITH cut AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}'), lambda s: {cleaned}) AS parts FROM documents),\n"
        f"named AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: {case}), lambda x: x IS NOT NULL) AS ids FROM cut),\n"
        + ",\n".join(steps)
        + f"\nSELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, rtrim(found, ',') AS licenses, "
        f"(length(rest) - length(replace(rest, '<', '')))::BIGINT AS left_over FROM r{len(rules)}"
    )
