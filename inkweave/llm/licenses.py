"""Licence scan by a positional index of templates' rarest words. DataFrame functions only.

A template is a sequence of words with a mandatory key phrase. The index has postings (template,
place in the phrase) for the two words of highest IDF of every phrase. A file looks its words up
in it; each hit gives a template and the word where its phrase would start. Starts that both
words of a template agree on are intersected, and the phrase is verified there word by word. The
index is a constant of the plan, whose size does not grow with the number of templates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.session import stage

#: What parts two words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``key`` is the mandatory phrase within ``text``; a base template counts places instead of adding a label of its own."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> list[str]:
        return self.key.split()

    @property
    def at(self) -> int:
        """Place of the phrase in the text."""
        n = len(self.phrase)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.phrase)


#: Phrases and labels of the base count.
BASE = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
]
#: Opening words of public licences.
TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("agpl-3.0", "this program is licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("boost", "boost software license version 1 0", "boost software license"),
    Template("artistic-2.0", "you may copy and distribute verbatim copies under the terms of the artistic license 2 0", "artistic license 2 0"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]


def _index(every: list[Template], idf: dict[str, float]) -> dict[str, list[str]]:
    """Postings ``template:place:turn`` of each phrase's two rarest words; a phrase of one word has it in both turns."""
    out: dict[str, list[str]] = {}
    for t, template in enumerate(every):
        rare = sorted(set(template.phrase), key=lambda w: (-idf[w], w))[:2]
        for turn, word in enumerate((rare * 2)[:2]):
            out.setdefault(word, []).extend(f"{t}:{place}:{turn}" for place, w in enumerate(template.phrase) if w == word)
    return out


def _starts(tokens: Column, index: dict[str, list[str]]) -> Column:
    """struct(t, o): template and the word its phrase would start with, where both of its rarest words agree."""
    postings = F.str_to_map(F.lit(";".join(f"{w}={' '.join(p)}" for w, p in index.items())), F.lit(";"), F.lit("="))
    seen = F.filter(F.transform(tokens, lambda x, i: F.when(x.isin(*index), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull())

    def looked_up(hit: Column) -> Column:
        def start(posting: Column) -> Column:
            part = F.split(posting, ":")
            return F.struct(part[2].alias("turn"), F.struct(part[0].cast("int").alias("t"), (hit["i"] - part[1].cast("int")).alias("o")).alias("at"))

        return F.transform(F.split(F.element_at(postings, hit["w"]), " "), start)

    hits = F.flatten(F.transform(seen, looked_up))
    turn = lambda all_hits, n: F.transform(F.filter(all_hits, lambda x: x["turn"] == n), lambda x: x["at"])
    return F.element_at(F.transform(F.array(hits), lambda h: F.array_intersect(turn(h, "0"), turn(h, "1"))), 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[Template] | None = None, templates: list[Template] | None = None) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    The labels are distinct, sorted and joined by commas; first_word and last_word are the
    smallest and largest start of a base phrase, null without one; score is the largest share of
    a found template's words that stand in place. A null or empty text has no words. Rows are
    independent: repeated rows and null ids stay, other columns are ignored, an empty table gives
    an empty result. ``lower`` equals lower-casing A-Z here: no other sign becomes a word of a
    template without the letter k.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    every = [*base, *templates]
    vocabulary = sorted({w for t in every for w in t.phrase})
    constant = lambda values: F.split(F.lit("\n".join(map(str, values))), "\n")
    # the split is a column of its own, used several times below it
    tokens = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), GAP, -1), "")
    split = docs.select(F.col(id_col).alias("key"), tokens.alias("tokens"))
    known = split.select("key", "tokens", F.size("tokens").cast("long").alias("n_words"), F.array_distinct(F.filter("tokens", lambda x: x.isin(*vocabulary))).alias("known"))
    # only a file with all words of some phrase keeps its tokens
    phrases = constant([" ".join(t.phrase) for t in every])
    able = F.exists(phrases, lambda p: F.size(F.array_except(F.split(p, " "), F.col("known"))) == 0)
    rows = stage(known.select("key", "n_words", "known", F.when(able, F.col("tokens")).alias("tokens")))

    # at most one row for each word of the templates
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = rows.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}

    sizes = constant([len(t.phrase) for t in every])
    texts, before, labels = constant([" ".join(t.words) for t in every]), constant([t.at for t in every]), constant([t.label for t in every])

    def whole(c: Column) -> Column:
        """The phrase stands there, word by word."""
        size = F.get(sizes, c["t"]).cast("int")
        return F.when(c["o"] >= 0, F.array_join(F.slice("tokens", c["o"] + 1, size), " ") == F.get(phrases, c["t"])).otherwise(False)

    def share(c: Column) -> Column:
        """Share of the template's words that stand where the template has them."""
        words = F.split(F.get(texts, c["t"]), " ")
        first = c["o"] - F.get(before, c["t"]).cast("int")
        return F.size(F.filter(F.transform(words, lambda w, j: F.get(F.col("tokens"), first + j) == w), lambda x: x)) / F.size(words)

    starts = F.when(F.col("tokens").isNotNull(), F.filter(_starts(F.col("tokens"), _index(every, idf)), whole)).otherwise(F.expr("cast(array() as array<struct<t:int,o:int>>)"))
    found = rows.withColumn("at", starts)
    of_base = F.transform(F.filter("at", lambda c: c["t"] < len(base)), lambda c: c["o"])
    named = lambda chosen: F.array_join(F.sort_array(F.array_distinct(F.transform(chosen, lambda c: F.get(labels, c["t"])))), ",")
    return found.select(F.col("key").alias(id_col), "n_words", F.size(of_base).cast("long").alias("n_base"), F.array_min(of_base).cast("long").alias("first_word"),
                        F.array_max(of_base).cast("long").alias("last_word"), named(F.filter("at", lambda c: c["t"] < len(base))).alias("base_labels"), named(F.col("at")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("at", share)), F.lit(0.0)).alias("score"))
