"""License scans: MinHash bands over overlapping windows find templates, containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.decontaminate import spaced
from quarrylight.llm.store import saved

# Public notices, as their licences ask to have them written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WIDTH = 5
AT_WORDS = r"(?=([^ ]+(?: [^ ]+){4}))[^ ]+"
#: Long templates are found by windows of so many shingles, at half of that apart.
WINDOW = 16
#: One MinHash value a band. Windows that share four tenths of their shingles meet in one of eight
#: bands with probability 0.983, at six tenths with 0.9993; a window of one shingle always meets.
BANDS = 8
#: Constants of the bands' hash orders: bits of the golden ratio's multiples.
ORDERS = tuple((k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(1, BANDS + 1))
BROADCAST_ROWS = 2_000_000


def least_hash(hashes: Column, order: int) -> Column:
    """The MinHash value of a set of hashes in one of the hash orders."""
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(order))))


def shingles_of(text: Column) -> Column:
    """Word shingles in order, lower-cased, one for each word that four more follow."""
    return F.regexp_extract_all(F.lower(spaced(text)), F.lit(AT_WORDS), F.lit(1))


def _bands(hashes: Column, starts: Column) -> Column:
    """Per window start (from 1): a struct of band and least hash, for every band."""
    def window(start: Column) -> Column:
        part = F.slice(hashes, start, WINDOW)
        return F.array(*[F.struct(F.lit(b).alias("band"), least_hash(part, order).alias("value")) for b, order in enumerate(ORDERS)])

    return F.flatten(F.transform(starts, window))


def _keys(hashes: Column, every: int) -> Column:
    """What a text is found by: single shingles (band -1), and windows' bands where it is long."""
    single = F.transform(hashes, lambda x: F.struct(F.lit(-1).alias("band"), x.alias("value")))
    empty = F.array().cast("array<struct<band:int,value:bigint>>")
    last = F.greatest(F.lit(1), F.size(hashes) - WINDOW + 1 + (every - 1))  # the last window may be shorter
    return F.concat(single, F.when(F.size(hashes) >= WINDOW // 2, _bands(hashes, F.sequence(F.lit(1), last, F.lit(every)))).otherwise(empty))


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, text); a parameter's size, not the corpus's."""
    return spark.createDataFrame(sorted(texts.items()), "license string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Licenses in whole documents: id_col, license, n_shared, n_shingles, containment.

    One row per document and template of which the document holds at least ``least`` of the
    distinct five-word shingles. Words are those of ``decontaminate``, lower-cased. Templates under
    WINDOW shingles are found by windows of one shingle at every word, longer ones by MinHash bands
    of windows of WINDOW shingles at half of that apart, against the template's windows at every
    offset; both are verified by the texts' own shingles. Templates of fewer than five words match
    nothing. Null and empty texts match nothing; null ids are kept; rows that share id and text
    give their rows each; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    cut = known.select("license", F.array_distinct(shingles_of(F.col("text"))).alias("wanted"), F.transform(shingles_of(F.col("text")), lambda s: F.xxhash64(s)).alias("h")).where(F.size("wanted") > 0)
    cut = saved(cut, "templates")
    long = F.size("h") >= WINDOW
    keys = cut.withColumn("key", F.explode(_keys(F.col("h"), 1))).where((F.col("key.band") >= 0) == long).select("license", "key.*").distinct()
    keys = saved(keys, "keys")
    fits = F.broadcast if keys.count() <= BROADCAST_ROWS else (lambda df: df)
    values = keys.select("band", "value").distinct()
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    hashed = docs.select(row.alias("row"), F.transform(shingles_of(F.col(text_col)), lambda s: F.xxhash64(s)).alias("h"))
    held = hashed.select("row", F.explode(_keys(F.col("h"), WINDOW // 2)).alias("key")).select("row", "key.band", "key.value")
    met = held.join(fits(values), ["band", "value"], "left_semi").distinct().join(fits(keys), ["band", "value"]).select("row", "license").distinct()
    met = saved(met, "candidates")
    some = met.select("row").distinct()
    again = F.broadcast(some) if met.count() <= BROADCAST_ROWS else some
    texts = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text")).join(again, "row", "left_semi").select("id", "row", F.array_distinct(shingles_of(F.col("text"))).alias("has"))
    found = texts.join(met, "row").join(F.broadcast(cut.select("license", "wanted")) if cut.count() <= 10_000 else cut.select("license", "wanted"), "license")
    shared = found.select("id", "license", F.size(F.array_intersect("wanted", "has")).cast("long").alias("n_shared"), F.size("wanted").cast("long").alias("n_shingles"))
    return shared.where(F.col("n_shared") >= least * F.col("n_shingles")).select(F.col("id").alias(id_col), "license", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))
