"""Table schemas at the edges of the library."""

from pyspark.sql import types as T

# One JSON object per line. A record whose inverted index has another shape (a
# JSON string, or positions that are no list) loses only that field and keeps its
# whole line in _corrupt_record, from which the abstract is read again.
WORK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField(
            "abstract_inverted_index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
        ),
        T.StructField("publication_year", T.IntegerType()),
        T.StructField("publication_date", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("cited_by_count", T.IntegerType()),
        T.StructField("counts_by_year", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

PAPER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("publication_year", T.IntegerType()),
        T.StructField("publication_date", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("cited_by_count", T.IntegerType()),
        T.StructField("counts_by_year", T.StringType()),
        T.StructField("matched_concepts", T.ArrayType(T.StringType())),
        T.StructField("num_matched_concepts", T.IntegerType()),
        T.StructField("processed_date", T.TimestampType()),
    ]
)

# Stored with consolidated papers: title and abstract both hold text.
READABLE = "readable"

CONSOLIDATED_COLUMNS = [f.name for f in PAPER if f.name != "matched_concepts"]

SUMMARY = T.StructType(
    [
        T.StructField("concept", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("key_themes", T.ArrayType(T.StringType())),
        T.StructField("typical_applications", T.ArrayType(T.StringType())),
        T.StructField("related_fields", T.ArrayType(T.StringType())),
        T.StructField("summary", T.StringType()),
        T.StructField("research_trends", T.StringType()),
    ]
)

RAW_RESPONSE = T.StructType(
    [
        T.StructField("concept", T.StringType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("tokens_generated", T.IntegerType()),
        T.StructField("finish_reason", T.StringType()),
    ]
)
