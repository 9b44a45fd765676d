"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text is joined, by hash and then by its words, to the places where templates
hold it. A match votes for the diagonal text position - template position. An exact copy of a template puts all its votes on
one diagonal; dropped or added words move the rest to a neighbouring one, so diagonals a few words apart are merged and the
merged band is verified by the share of the template's grams that it covers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import fixed, places, words

#: The phrases of the contract with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices that the method looks for besides, in the words of the licenses' own recommended notices.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-text"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2-text"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]


def _grams(df: DataFrame, text_words: str, k: int) -> Column:
    return F.transform(places(F.size(text_words) - k + 1), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *(F.get(text_words, i + x) for x in range(k))).alias("gram")))


def spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES, k: int = 3, slack: int = 3,
) -> DataFrame:
    """Merged bands: (id, text_hash, copies, n_words, template, label, base, size, first_word, diagonals, grams_hit, places).

    A row with a null template stands for the text itself, so every text has one. ``places``: the diagonals that hold every gram of
    the template, which are the places where its words stand consecutively. Templates shorter than k words aren't allowed.
    """
    spark = df.sparkSession
    listed = [(n, text, label, n < len(phrases)) for n, (text, label) in enumerate([*phrases.items(), *notices])]
    if any(len(text.split()) < k for _, text, _, _ in listed):
        raise ValueError(f"a template has fewer than {k} words")
    rows = [(" ".join(w[q : q + k]), n, label, base, len(w) - k + 1, q) for n, text, label, base in listed for w in [text.split()] for q in range(len(w) - k + 1)]
    # As many rows as the templates given have words: their size doesn't depend on the texts.
    templates = spark.createDataFrame(rows, "words string, template int, label string, base boolean, size int, q int")
    templates = F.broadcast(templates.withColumn("mark", F.xxhash64("words")))
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_t"))
    texts = fixed(texts, tokens=words(F.col("_t"))).drop("_t")
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("gram")))
    sent = texts.select("id", "text_hash", F.size("tokens").alias("n"), F.inline(F.concat(own, _grams(texts, "tokens", k))))
    sent = sent.withColumn("mark", F.when(F.col("at") >= 0, F.xxhash64("gram")))
    votes = sent.join(templates, "mark", "left").where("at < 0 or gram = words")
    diagonals = votes.groupBy("id", "text_hash", "template", (F.col("at") - F.col("q")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.first("n").alias("n"),
        F.collect_set("q").alias("hit"), F.count_if(F.col("at") < 0).alias("copies"),
    )
    order = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > slack) | F.lag("diagonal").over(order).isNull()
    banded = diagonals.withColumn("band", F.sum(apart.cast("int")).over(order))
    return banded.groupBy("id", "text_hash", "template", "band").agg(
        F.max("copies").alias("copies"), F.first("n").cast("long").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"),
        F.min("diagonal").alias("first_diagonal"), F.max("diagonal").alias("last_diagonal"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("grams_hit"),
        F.array_sort(F.collect_list(F.when(F.size("hit") == F.col("size"), F.col("diagonal")))).alias("places"),
    )


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, whole_below: int = 10, **how) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row a row of ``df``.

    ``base`` templates count wherever their words stand consecutively, and ``base_labels`` are those found. ``labels`` adds the label of every notice of
    which a band covers at least ``threshold`` of the grams (all, where it has fewer than ``whole_below``,
    since short notices differ by a word). ``score``: the largest covered share over all templates, 1 where a base one is whole. A null text is
    empty: no words, no labels, score 0. Rows equal in id and text get equal results; a null id is kept.
    """
    found = spans(df, id_col, text_col, **how)
    whole = F.col("base") & (F.size("places") > 0)
    near = ~F.col("base") & (F.col("grams_hit") >= F.when(F.col("size") < whole_below, F.col("size")).otherwise(threshold * F.col("size")))
    out = found.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"),
        F.coalesce(F.sum(F.when(F.col("base"), F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(whole, F.array_min("places"))).cast("long").alias("first_word"), F.max(F.when(whole, F.array_max("places"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole | near, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.col("grams_hit") / F.col("size")), F.lit(0.0)).alias("score"),
    )
    out = out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
