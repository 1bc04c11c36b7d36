"""Fill-in-middle transformation by markers that are injected after every unit of an escaped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import table, text_of

#: A unit: a run of ASCII letters, or any other code point.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: The delimiter that is injected, and the character that escapes it and itself; any text may hold both.
MARK, ESCAPE = "\x01", "\x02"
#: What stands for the escape character and for the delimiter in an escaped text.
ESCAPED_ESCAPE, ESCAPED_MARK = ESCAPE + "0", ESCAPE + "1"
#: What starts a prefix, a suffix and a middle in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that stay plain, and of the others those that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def escaped(text: Column) -> Column:
    """The text without a delimiter in it."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))


def unescaped(text: Column) -> Column:
    """What ``escaped`` was made of, injected delimiters taken out."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPED_MARK), F.lit(MARK)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def marked(escaped_text: Column) -> Column:
    """An escaped text with a delimiter after every unit; an escaped character is one unit."""
    return F.regexp_replace(escaped_text, f"{ESCAPE}[01]|{UNIT}", f"$0{MARK}")


def draws(id_text: Column, seed: int) -> list[Column]:
    """Four integers of 32 bits for an id: the first hexadecimal digits of a SHA-256, eight each."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output): one row for each row of ``docs``.

    A text is cut into n units (``UNIT``) at two places that the id and ``seed`` draw. The text is escaped, a
    delimiter injected after each unit and counted, and the parts are taken by the delimiters' ranks. form: psm
    (prefix, suffix, middle), spm (suffix, prefix, middle), or plain, the text unchanged, for ``plain`` of a
    hundred ids and for texts that are empty or hold a part's marker; parts of plain texts are null.
    Null texts are empty; a null id draws as the empty text; rows that repeat an id are cut alike if their texts
    are equal; an empty table gives no rows; other columns aren't read. All in one pass without a shuffle, a text of any length.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed))))
    rows = rows.withColumn("escaped", escaped(F.col("text"))).withColumn("marked", marked(F.col("escaped")))
    rows = rows.withColumn("n", (F.length("marked") - F.length("escaped")).cast("bigint"))
    first, second = F.col("h0") % (F.col("n") + 1), F.col("h1") % (F.col("n") + 1)
    rows = rows.withColumn("low", F.least(first, second).cast("int")).withColumn("high", F.greatest(first, second).cast("int"))
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | holds | (F.col("h2") % 100 >= 100 - plain), "plain").when(F.col("h3") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    ranked = lambda text, count: F.call_function("substring_index", text, F.lit(MARK), count)
    head = ranked(F.col("marked"), F.col("high"))
    # The marked text ends with a delimiter: what follows it counts as one more, empty, part.
    tail = F.when(F.col("high") < F.col("n"), ranked(F.col("marked"), (F.col("high") - F.col("n") - 1).cast("int"))).otherwise("")
    cut = lambda part: F.when(F.col("form") != "plain", unescaped(part))
    rows = rows.withColumn("prefix", cut(ranked(F.col("marked"), F.col("low")))).withColumn("middle", cut(ranked(head, F.col("low") - F.col("high")))).withColumn("suffix", cut(tail))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Its parts hold no marker, so the first of each kind is the one that was put there."""
    between = lambda start, end: F.call_function("substring_index", F.call_function("substring_index", output, F.lit(start), F.lit(-1)), F.lit(end), F.lit(1))
    middle = F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(-1))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fim(spark, sf_dir: str) -> DataFrame:
    """The documents' forms and digests, as the contract of this query asks."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_H = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i}" for i in range(4))
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS a, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, a, len(a) AS n, {_H} FROM d),
c AS (SELECT *, least(h0 % (n + 1), h1 % (n + 1)) AS low, greatest(h0 % (n + 1), h1 % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h2 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h3 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(a[1:low], '') AS p, array_to_string(a[low + 1:high], '') AS m, array_to_string(a[high + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
