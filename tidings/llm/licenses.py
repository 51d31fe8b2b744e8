"""Licence scan by sentence rules.

Licence-like sentences are normalised and looked up among known licence sentences; the identifiers
found, in text order, are matched against ordered rules. A rule that matches takes its sentences away,
so a longer rule, which comes first, is not reported again by a shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of public licences, normalised (lower case, signs as blanks).
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-short": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited "
    "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-name": "licensed under the apache license version 2.0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without "
    "even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync-name": "licensed under cc by-nc 4.0",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution",
}

#: Licences by the sentences that tell them, longer rules first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl3-terms", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-terms",)),
    ("Apache-2.0", ("apache-name", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-name", "apache-use")),
    ("BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-name",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-short",)),
    ("CC-BY-NC-4.0", ("ccbync-name",)),
)

#: Sentences without one of these are not looked at.
LIKELY = "(?i)licen[sc]e|permission|copyright|redistribut|warrant|free software"
#: Sentences end at a line's end, or at a stop that white space follows.
SENTENCE_END = r"[.!?;:]+[ \t\r]+|[.!?;:]*\n+"
UNKNOWN = "?"


def likely_sentences(text: Column) -> Column:
    """A text's licence-like sentences, in order (none for a null text)."""
    cut = F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(LIKELY))
    return F.when(text.rlike(LIKELY), cut).otherwise(F.array().cast("array<string>"))


def normal_sentence(sentence: Column) -> Column:
    """Lower case, with everything but letters, digits and inner ``.+-`` as single blanks."""
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.+-]+", " ")
    return F.regexp_replace(plain, r"^[ .+-]+|[ .+-]+$", "")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence-like sentences; ``?`` for a sentence that is not known."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    found = F.transform(likely_sentences(text), normal_sentence)
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(UNKNOWN)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that every row names.

    ``n_sentences`` counts licence-like sentences, ``n_known`` the known ones, ``licenses`` lists the
    licences in the order of the rules (each once, comma-joined, empty for none) and ``n_unmatched``
    counts known sentences that no rule took. One pass without a shuffle; null and empty texts name
    nothing; null ids and repeated rows are kept as they are; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), sentence_ids(F.col(text_col)).alias("ids"))
    rows = rows.withColumn("left", F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")))
    names: dict[str, list[Column]] = {}
    for i, (name, ids) in enumerate(RULES):
        pattern = F.lit("<" + "><".join(ids) + ">")
        rows = rows.withColumn(f"hit{i}", F.contains("left", pattern))
        rows = rows.withColumn("left", F.replace("left", pattern, F.lit("|")))
        names.setdefault(name, []).append(F.col(f"hit{i}"))
    found = []
    for name, hits in names.items():
        either = hits[0]
        for hit in hits[1:]:
            either = either | hit
        found.append(F.when(either, F.lit(name)))
    known = F.size(F.filter("ids", lambda s: s != UNKNOWN))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("bigint").alias("n_sentences"),
        known.cast("bigint").alias("n_known"),
        F.concat_ws(",", *found).alias("licenses"),
        F.regexp_count("left", F.lit("<[a-z]")).cast("bigint").alias("n_unmatched"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """The same rows in SQL."""
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(n)}" for n, s in SENTENCES.items()) + "}"
    steps = [
        f"""cut AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''),
          '{SENTENCE_END}'), lambda s: regexp_matches(s, '{LIKELY}')), lambda s: regexp_replace(regexp_replace(lower(s),
          '[^a-z0-9.+-]+', ' ', 'g'), '^[ .+-]+|[ .+-]+$', '', 'g')) AS s FROM documents)""",
        f"""r0 AS (SELECT doc_id, list_transform(s, lambda x: coalesce({known}[x], '{UNKNOWN}')) AS ids,
          '<' || coalesce(array_to_string(list_transform(s, lambda x: coalesce({known}[x], '{UNKNOWN}')), '><'), '')
          || '>' AS l FROM cut)""",
    ]
    for i, (_, ids) in enumerate(RULES):
        pattern = quoted("<" + "><".join(ids) + ">")
        steps.append(
            f"r{i + 1} AS (SELECT * EXCLUDE (l), contains(l, {pattern}) AS hit{i}, "
            f"replace(l, {pattern}, '|') AS l FROM r{i})"
        )
    names = dict.fromkeys(name for name, _ in RULES)
    found = ", ".join(
        f"CASE WHEN {' OR '.join(f'hit{i}' for i, (n, _) in enumerate(RULES) if n == name)} THEN {quoted(name)} END"
        for name in names
    )
    return f"""WITH {", ".join(steps)} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences,
        CAST(len(list_filter(ids, lambda x: x <> '{UNKNOWN}')) AS BIGINT) AS n_known, concat_ws(',', {found}) AS licenses,
        CAST(len(regexp_extract_all(l, '<[a-z]')) AS BIGINT) AS n_unmatched FROM r{len(RULES)}"""
