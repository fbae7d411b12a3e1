"""Fill-in-the-middle transformation by escaped marker injection, in built-in functions only.

A delimiter is escaped in the text, ``regexp_replace`` appends it after every unit, its count is the
number of units, and ``substring_index`` takes the ranked parts; then the injected delimiters go and
the escapes are undone. Cuts follow from the row's id alone, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import apart

#: A line with its end, or the last one without.
LINES = r"[^\n]*\n|[^\n]+"
#: A word with the white space before it, or white space at the end.
WORDS = r"\s*\S+|\s+"
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    """Without the delimiter: it and the escape become the escape and a letter."""
    return _swap(_swap(text, ESCAPE, ESCAPE + "e"), DELIMITER, ESCAPE + "d")


def unescaped(part: Column) -> Column:
    """A part of the marked text as it was: the injected delimiters go before the escapes are undone."""
    return _swap(_swap(_swap(part, DELIMITER, ""), ESCAPE + "d", DELIMITER), ESCAPE + "e", ESCAPE)


def group(digest: Column, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES) -> DataFrame:
    """Every row with its columns n, form, prefix, middle, suffix, output and restored.

    ``rate`` and ``spm_rate`` are percentages. A null text is an empty one, a null key an empty one;
    equal keys get equal cuts. An empty text, or one that holds a marker, stays plain: then the parts
    are null. Of a text without units (none fits ``unit``) nothing is cut. Texts of any length are
    cut whole. Columns of the input that have the names of results are replaced.
    """
    made = ["n", "form", "prefix", "middle", "suffix", "output", "restored"]
    taken = {c.lower() for c in docs.columns} | set(made)
    t, mk, lo, hi, dg = (apart(taken, c) for c in ("whole", "marked", "first", "second", "digest"))
    col = lambda c: F.col(f"`{c}`")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit(""))), 256)
    whole = F.coalesce(col(text), F.lit(""))
    df = docs.withColumns({t: whole, dg: digest})
    df = df.withColumn(mk, F.regexp_replace(escaped(F.col(t)), F.lit(unit), F.lit("$0" + DELIMITER)))
    n = (F.length(mk) - F.length(_swap(F.col(mk), DELIMITER, ""))).cast("long")
    df = df.withColumn("n", n)
    one, two = (group(F.col(dg), k) % (F.col("n") + 1) for k in (0, 1))
    df = df.withColumns({lo: F.least(one, two).cast("int"), hi: F.greatest(one, two).cast("int")})
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(F.col(t), F.lit(marker))
    plain = (F.col(t) == "") | held | (F.col("n") == 0) | (group(F.col(dg), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(group(F.col(dg), 3) % 100 < spm_rate, "spm").otherwise("psm")
    ranked = lambda s, k: F.call_function("substring_index", s, F.lit(DELIMITER), k)
    head = ranked(F.col(mk), F.col(hi))
    parts = {
        "prefix": ranked(F.col(mk), F.col(lo)),
        "middle": F.when(F.col(hi) > F.col(lo), ranked(head, F.col(lo) - F.col(hi))).otherwise(""),
        "suffix": ranked(F.col(mk), F.col(hi) - F.col("n").cast("int") - 1),
    }
    df = df.withColumn("form", form)
    df = df.withColumns({c: F.when(F.col("form") != "plain", unescaped(part)) for c, part in parts.items()})
    p, s, m = (F.concat(F.lit(marker), F.col(c)) for marker, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col(t))
    df = df.withColumn("output", output)
    kept = [col(c) for c in docs.columns if c.lower() not in made]
    return df.withColumn("restored", restore(F.col("output"), F.col("form"))).select(*kept, *made)


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form only."""
    after = lambda s, marker: F.substring_index(s, marker, -1)
    first = lambda s, marker: F.substring_index(s, marker, 1)
    middle = after(output, MIDDLE)
    body = first(output, MIDDLE)
    psm = F.concat(after(first(body, SUFFIX), PREFIX), middle, after(body, SUFFIX))
    spm = F.concat(after(body, PREFIX), middle, after(first(body, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    length = lambda c: F.length(c).cast("long")
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", length("prefix").alias("prefix_chars"), length("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )
