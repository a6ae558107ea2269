"""Small tables that hold the cases every operator must bear."""
import re

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

PROSE = ("the quick brown fox jumps over the lazy dog while twelve grey wolves sleep near a frozen lake and dream of "
         "long summer evenings by the river where otters play among reeds until night falls on every quiet village")

#: (doc_id, text): nulls, empty and blank texts, a very long text and word,
#: repeated rows, a repeated id, a null id, other scripts, control characters.
DOCS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE + " once more"),
    (6, "one"), (7, "Ünïcödé 日本語 текст \x1c odd\x0bspace"), (8, "x" * 70_000), (9, (PROSE + "\n") * 400),
    (10, "a b  c\n\nd \n e"), (11, PROSE.upper()), (-5, "negative id, some words here"), (2 ** 53 + 1, "a large id " * 30),
]

#: Names that operators use inside.
CLASHING = ["n_words", "score", "token", "tokens", "block", "part", "piece", "length", "row", "path", "place", "shard",
            "bucket", "kept", "rule", "component", "group", "label", "run", "__b", "__label", "__measures", "ids"]


def docs_table(spark, rows=None, extra=True):
    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F
        df = df.select(*[F.lit(7).alias(c) for c in CLASHING], "doc_id", F.lit("en").alias("lang"), "text")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def given(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
